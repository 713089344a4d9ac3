"""Content identities and the canonical tag-length-value form."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the form: numbers and byte strings.
NUMBER, BYTES = 0, 2


def varint(n: int) -> bytes:
    """Unsigned LEB128 in its shortest form."""
    if n < 0:
        raise ValueError("a varint is not negative")
    groups = max(1, -(-n.bit_length() // 7))
    return bytes((n >> (7 * i) & 0x7F) | (0x80 if i < groups - 1 else 0) for i in range(groups))


def read_varint(data: bytes, at: int = 0) -> tuple[int, int]:
    """(value, next position); longer than needed, cut off or beyond 64 bits is an error."""
    end = at
    while end < len(data) and data[end] & 0x80:
        end += 1
    if end >= len(data):
        raise ValueError("varint is cut off")
    if end - at >= 10:
        raise ValueError("varint is beyond 64 bits")
    value = sum((b & 0x7F) << (7 * i) for i, b in enumerate(data[at : end + 1]))
    if varint(value) != data[at : end + 1]:
        raise ValueError("varint is longer than needed")
    return value, end + 1


def encode(fields: list[tuple[int, int | bytes]]) -> bytes:
    """Fields (number from 1, value) in canonical order: by number, numbers before bytes."""

    def piece(number: int, value: int | bytes) -> tuple[int, int, bytes, bytes]:
        if number < 1:
            raise ValueError("field numbers begin at 1")
        if isinstance(value, int):
            body = varint(value)
            return number, NUMBER, body, varint(number << 3 | NUMBER) + body
        return number, BYTES, bytes(value), varint(number << 3 | BYTES) + varint(len(value)) + bytes(value)

    return b"".join(p[3] for p in sorted(piece(n, v) for n, v in fields))


def decode(data: bytes) -> list[tuple[int, int | bytes]]:
    """Fields of canonical bytes; anything else is an error."""
    out: list[tuple[int, int | bytes]] = []
    at = 0
    while at < len(data):
        tag, at = read_varint(data, at)
        number, kind = tag >> 3, tag & 7
        value, at = read_varint(data, at)
        if kind == BYTES:
            if at + value > len(data):
                raise ValueError("field runs past the end")
            value, at = data[at : at + value], at + value
        elif kind != NUMBER:
            raise ValueError(f"unknown kind {kind}")
        out.append((number, value))
    if encode(out) != data:
        raise ValueError("bytes are not canonical")
    return out


def canonical_json(value) -> str:
    """JSON with sorted keys, without blanks, in ASCII."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=True)


def canonical_struct(df_columns: list[str]) -> Column:
    """The same of a row, with built-ins: a struct of the columns in order of their names."""
    return F.to_json(F.struct(*sorted(df_columns)))


def blake_id(x: Column, size: int = 32) -> Column:
    """BLAKE2b in hex, which is no built-in: an Arrow function over batches."""

    @F.pandas_udf("string")
    def run(col: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else hashlib.blake2b(v if isinstance(v, bytes) else str(v).encode(), digest_size=size).hexdigest() for v in col])

    return run(x)


def record_cid(kind: Column, payload: Column) -> Column:
    """Identity of a record (V7): BLAKE2b-256 of its canonical form, field 1 the kind, field 2 the payload."""

    @F.pandas_udf("string")
    def run(k: pd.Series, p: pd.Series) -> pd.Series:
        forms = (encode([(1, str(a).encode()), (2, b if isinstance(b, bytes) else str(b).encode())]) for a, b in zip(k, p, strict=True))
        return pd.Series(["b2b256:" + hashlib.blake2b(f, digest_size=32).hexdigest() for f in forms])

    return run(kind, payload)
