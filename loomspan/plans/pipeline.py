"""A verb pipeline language, compiled to a chain of DataFrame functions (Q3).

    verb.sub[key: value, ...] | verb[...]

Values are quoted or bare strings, numbers, true, false and null. A verb is a
function ``(DataFrame, **args) -> DataFrame`` with the columns it needs and
gives, its risk and its argument names; a chain whose step needs a column that
no step before gives is refused before anything runs. A column may be written
with its type, ``name:type``; what is given must be that type or a narrower one.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_VERB = re.compile(r"[a-z][a-z0-9_]*(?:\.[a-z][a-z0-9_]*)*")
_KEY = re.compile(r"\s*([A-Za-z_]\w*)\s*:\s*")
_NUMBER = re.compile(r"-?\d+(?:\.\d+)?(?![\w.])")
_BARE = re.compile(r"[A-Za-z0-9_./@+\-]+")
_SHELL = re.compile(r"[;&`$<>\\]|\|\||\n")


class PipelineError(ValueError):
    """A chain that cannot be read or does not fit together."""


@dataclass(frozen=True)
class Verb:
    run: Callable[..., DataFrame]
    needs: tuple[str, ...] = ()
    gives: tuple[str, ...] = ()
    args: tuple[str, ...] = ()
    risk: int = 0


@dataclass
class Registry:
    verbs: dict[str, Verb] = field(default_factory=dict)

    def add(self, name: str, verb: Verb) -> None:
        if name in self.verbs and self.verbs[name] != verb:
            raise PipelineError(f"{name} is already registered")
        self.verbs[name] = verb


def _value(src: str, at: int):
    if src[at : at + 1] in "\"'":
        quote, out, at = src[at], [], at + 1
        while at < len(src) and src[at] != quote:
            if src[at] == "\\" and at + 1 < len(src):
                at += 1
            out.append(src[at])
            at += 1
        if at >= len(src):
            raise PipelineError(f"open quote at {at}")
        return "".join(out), at + 1
    m = _NUMBER.match(src, at)
    if m:
        return (float if "." in m.group() else int)(m.group()), m.end()
    m = _BARE.match(src, at)
    if not m:
        raise PipelineError(f"expected a value at {at}: {src[at : at + 12]!r}")
    return {"true": True, "false": False, "null": None}.get(m.group(), m.group()), m.end()


def parse(src: str) -> list[tuple[str, dict]]:
    """(verb, arguments) of each step."""
    steps, at = [], 0
    while True:
        m = _VERB.match(src, at)
        if not m:
            raise PipelineError(f"expected a verb at {at}: {src[at : at + 12]!r}")
        args: dict = {}
        at = m.end()
        if src[at : at + 1] == "[":
            at += 1
            while src[at : at + 1] != "]":
                k = _KEY.match(src, at)
                if not k or k.group(1) in args:
                    raise PipelineError(f"expected a new key at {at}: {src[at : at + 12]!r}")
                args[k.group(1)], at = _value(src, k.end())
                if isinstance(args[k.group(1)], str) and _SHELL.search(args[k.group(1)]):
                    raise PipelineError(f"forbidden characters in {k.group(1)}")
                gap = re.compile(r"\s*(,)?\s*").match(src, at)
                at = gap.end()
                if not gap.group(1) and src[at : at + 1] != "]":
                    raise PipelineError(f"expected ] at {at}")
            at += 1
        steps.append((m.group(), args))
        if at == len(src):
            return steps
        if src[at : at + 3] != " | ":
            raise PipelineError(f"unexpected {src[at : at + 12]!r} at {at}")
        at += 3


def canonical(steps: list[tuple[str, dict]]) -> str:
    """One spelling of equal chains."""
    return json.dumps([[v, a] for v, a in steps], sort_keys=True, separators=(",", ":"))


def plan_id(steps: list[tuple[str, dict]]) -> str:
    return hashlib.sha256(canonical(steps).encode()).hexdigest()[:16]


#: Which types may stand in for which, each for itself and for those after it.
_WIDER = (("tinyint", "smallint", "int", "bigint", "double"), ("float", "double"), ("date", "timestamp"))


def fits(given: str | None, wanted: str | None) -> bool:
    """Whether a column of one type may be used as another; unknown types fit."""
    if given is None or wanted is None or given == wanted:
        return True
    if given.startswith("array<") and wanted.startswith("array<"):
        return fits(given[6:-1], wanted[6:-1])
    return any(given in row and wanted in row[row.index(given) :] for row in _WIDER)


def check(steps: list[tuple[str, dict]], registry: Registry, columns: list[str] | dict[str, str]) -> int:
    """Highest risk of the steps, after verbs, arguments, columns and their types were checked in order."""
    split = lambda c: (c.split(":", 1)[0], c.split(":", 1)[1] if ":" in c else None)
    have: dict[str, str | None] = dict(columns) if isinstance(columns, dict) else dict.fromkeys(columns)
    risk = 0
    for i, (name, args) in enumerate(steps):
        verb = registry.verbs.get(name)
        if verb is None:
            raise PipelineError(f"step {i}: unknown verb {name}")
        unknown = set(args) - set(verb.args)
        if unknown:
            raise PipelineError(f"step {i}: {name} takes no {', '.join(sorted(unknown))}")
        needs = dict(map(split, verb.needs))
        missing = [c for c in needs if c not in have]
        if missing:
            raise PipelineError(f"step {i}: {name} needs {', '.join(missing)}")
        wrong = [f"{c} as {t}, not {have[c]}" for c, t in needs.items() if not fits(have[c], t)]
        if wrong:
            raise PipelineError(f"step {i}: {name} needs {', '.join(wrong)}")
        have |= dict(map(split, verb.gives))
        risk = max(risk, verb.risk)
    return risk


def execute(src: str, df: DataFrame, registry: Registry) -> DataFrame:
    steps = parse(src)
    check(steps, registry, dict(df.dtypes))
    for name, args in steps:
        df = df.transform(registry.verbs[name].run, **args)
    return df


def standard() -> Registry:
    """Verbs over documents."""
    from loomspan.operators import chunking, text

    r = Registry()
    r.add("text.score", Verb(lambda df: df.withColumn("fact_score", F.round(text.fact_score(F.coalesce("text", F.lit(""))), 6)), ("text:string",), ("fact_score:double",)))
    r.add("text.redact", Verb(lambda df: df.withColumn("text", text.redact(F.col("text"))), ("text:string",), ("text:string",)))
    r.add("text.contains", Verb(lambda df, query="": df.filter(F.lower("text").contains(query.lower())), ("text:string",), (), ("query",)))
    r.add("chunk.window", Verb(lambda df, size=320, overlap=48: df.select(*[c for c in df.columns if c != "text"], F.posexplode(chunking.windows(F.col("text"), size, overlap)).alias("position", "text")), ("text:string",), ("position:int", "text:string"), ("size", "overlap")))
    r.add("rows.top", Verb(lambda df, by="fact_score", n=10, then="doc_id": df.orderBy(F.desc(by), then).limit(n), (), (), ("by", "n", "then")))
    r.add("rows.keep", Verb(lambda df, least=0.0: df.filter(F.col("fact_score") >= least), ("fact_score:double",), (), ("least",)))
    return r
