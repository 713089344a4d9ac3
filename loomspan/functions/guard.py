"""Signed capabilities checked on the driver before a query is planned (F8)."""

from __future__ import annotations

import hashlib
import hmac
from collections.abc import Callable
from dataclasses import dataclass

WORLD = "world"


class Refused(PermissionError):
    """A capability that does not allow what is asked for."""


@dataclass(frozen=True)
class Capability:
    tenant: str
    scopes: frozenset[str]
    signature: str = ""


def _sign(tenant: str, scopes: frozenset[str], key: bytes) -> str:
    body = "\x1f".join([tenant, *sorted(scopes)])
    return hmac.new(key, body.encode("utf-8"), hashlib.sha256).hexdigest()


def issue(tenant: str, scopes: set[str], key: bytes) -> Capability:
    return Capability(tenant, frozenset(scopes), _sign(tenant, frozenset(scopes), key))


def guarded(capability: Capability, key: bytes, query: Callable[[str], object], scope: str | None = None) -> object:
    """``query(tenant)`` if the signature holds, the tenant is one of its own and the scope is granted; else an error."""
    if not capability.tenant or capability.tenant == WORLD:
        raise Refused("a capability names a tenant of its own")
    if not hmac.compare_digest(capability.signature, _sign(capability.tenant, capability.scopes, key)):
        raise Refused(f"wrong signature for {capability.tenant!r}")
    if scope is not None and scope not in capability.scopes:
        raise Refused(f"{capability.tenant!r} lacks {scope!r}")
    return query(capability.tenant)
