"""Named things that are registered once (T4), and catalogues of what works and what waits (E5)."""

from __future__ import annotations

from dataclasses import dataclass, field


class Conflict(ValueError):
    """Another thing is registered under the name."""


@dataclass
class Registry:
    """Registering the same thing again is fine; another one of a name is an error."""

    things: dict[str, object] = field(default_factory=dict)

    def register(self, name: str, thing: object) -> object:
        if not name:
            raise ValueError("a name is needed")
        if self.things.setdefault(name, thing) != thing:
            raise Conflict(f"{name!r} is registered as another one")
        return self.things[name]

    def get(self, name: str) -> object:
        if name not in self.things:
            raise KeyError(f"unknown {name!r}, known: {', '.join(sorted(self.things))}")
        return self.things[name]

    def names(self) -> list[str]:
        return sorted(self.things)


@dataclass(frozen=True)
class Algorithm:
    """An entry of a catalogue: live ones run, deferred ones say what they wait for."""

    name: str
    run: object = None
    waits_for: str = ""

    @property
    def live(self) -> bool:
        return self.run is not None


def catalogue(entries: list[Algorithm]) -> dict[str, list[str]]:
    """Names of the live and the deferred entries; an entry that neither runs nor waits is an error."""
    for e in entries:
        if e.live == bool(e.waits_for):
            raise ValueError(f"{e.name} must either run or wait for something")
    return {"live": sorted(e.name for e in entries if e.live), "deferred": sorted(e.name for e in entries if not e.live)}
