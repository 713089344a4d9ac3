"""Broken prompt and response pairs: a multi-label linear classifier.

Features are hashed word n-grams (the end and the whole of the response) and
pair features in buckets: how many of the names and numbers of the source, and
of its last sentence, the response repeats; how much of its other wording is the
source's; the share of its text in the target language; length against what is
usual between the two languages; how it ends. One logistic regression per
defect is trained on a bounded sample of pairs (``sample_rows``, the rows of
the smallest hashes) that agree with themselves, and on defects made from
them: placeholders, refusals composed from a grammar (``refusals``), copies, responses asked for in another language,
and cut responses; harmless variants stay negative. Thresholds are those of the
best F1 on a held-out fifth. The languages are told apart by a softmax on word
and character n-grams, trained on the same sample. Every row is scored.

The defect that comes out is the first that applies of empty, refusal, copy,
wrong_language, truncated. Repeated ids count once (the least response of
different ones); a null response is empty, a null source is an empty one, a
null or unknown target language is never the wrong one.
"""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.llm.refusals import refusal

DEFECTS = ("empty", "refusal", "copy", "wrong_language", "truncated")
DIM = 1 << 17
LID_DIM = 1 << 16

# What stands for a missing response.
PLACEHOLDERS = ("", " ", "\n", " ", "​", "-", "--", "—", ".", "...", "…", '""', "''", "[]", "{}", "()", "N/A", "n/a", "None", "none", "null", "NULL", "nil", "NaN", "undefined", "(empty)", "[empty]", "<empty>", "(none)", "[no output]", "no output", "[no translation]", "(no translation)", "TODO", "TBD", "???", "```\n```", "<p></p>", "<br>", "<br/>", "<div></div>", "Translation:", "Traduction :", "Übersetzung:", "Traducción:", "翻译：", "译文：", "(leer)", "(vide)", "(vacío)", "无", "空")
LABELS = ("Translation: ", "Traduction : ", "Übersetzung: ", "Traducción: ", "翻译：", "译文：", "Here is the translation: ", "Output: ", "Answer: ", "> ", "- ")
STOPS = ".!?。！？"

_TOKEN = re.compile(r"https?://\S+|[\w][\w.@/-]*[\w]|\w", re.UNICODE)
_CJK = re.compile(r"[぀-ヿ㐀-鿿]")
_FENCE = re.compile(r"```.*?(```|\Z)", re.S)
_TAG = re.compile(r"<[^<>]{0,40}>")
_SENT = re.compile(r"(?<=[.!?])[\"”»)]*\s+|(?<=[。！？])|\n+")
_MIXED = re.compile(r"[A-Za-z0-9_][A-Za-z0-9_./:?=&%@#-]*")


def tokens(text: str) -> list[str]:
    """Lower-case words; each Chinese character is a word, identifiers and addresses stay whole."""
    text = text.lower()
    if not _CJK.search(text):
        return _TOKEN.findall(text)
    out = []
    for t in _TOKEN.findall(text):
        if _CJK.search(t):
            at = 0
            for m in _MIXED.finditer(t):
                out += t[at : m.start()]
                out.append(m.group().strip("./:-"))
                at = m.end()
            out += t[at:]
        else:
            out.append(t)
    return [t for t in out if t and t[0].isalnum() or "_" in t]


def sentences(text: str) -> list[str]:
    return [s for s in (x.strip() for x in _SENT.split(text)) if s and re.search(r"\w", s)]


def language(code: str | None) -> str | None:
    """Primary language of a code such as fr, FR, fr-FR or fr_CA."""
    m = re.match(r"\s*([A-Za-z]{2,3})(?:[-_].*)?\s*$", code or "")
    return m.group(1).lower() if m else None


def _bucket(name: str, dim: int) -> int:
    return xxhash.xxh3_64_intdigest(name) % dim


class Languages:
    """Softmax over languages on hashed words and character trigrams."""

    def __init__(self, names: list[str]):
        self.names = names
        self.w = np.zeros((LID_DIM, max(1, len(names))), np.float32)
        self._seen: dict[str, list[int]] = {}
        self._sums: dict[str, tuple[np.ndarray, int]] = {}

    def features(self, words: list[str]) -> np.ndarray:
        ids: list[int] = []
        for w in words:
            got = self._seen.get(w)
            if got is None:
                got = [_bucket(f"w{w}", LID_DIM)] + [_bucket(f"{' ' + w + ' '}"[i : i + 3], LID_DIM) for i in range(len(w)) if w.isalpha()]
                if len(self._seen) < 200_000:
                    self._seen[w] = got
            ids += got
        return np.array(ids, np.int64)

    def _logits(self, words: list[str]) -> np.ndarray:
        """Sums of each word's weights, which are looked up once a word."""
        total, n = np.zeros(self.w.shape[1], np.float32), 0
        for w in words:
            got = self._sums.get(w)
            if got is None:
                ids = self.features([w])
                if len(self._sums) > 200_000:
                    self._sums.clear()
                got = self._sums[w] = (self.w[ids].sum(axis=0), len(ids))
            total += got[0]
            n += got[1]
        return total / max(1.0, n**0.5)

    def scores(self, words: list[str]) -> np.ndarray:
        s = self._logits(words)
        e = np.exp(s - s.max())
        return e / e.sum()

    def train(self, texts: list[list[str]], labels: list[int], epochs: int = 2) -> None:
        feats = [self.features(t) for t in texts]
        grad2 = np.full_like(self.w, 1e-2)
        rng = np.random.default_rng(5)
        for _ in range(epochs):
            for i in rng.permutation(len(feats)):
                ids = feats[i]
                if not len(ids):
                    continue
                scale = len(ids) ** -0.5
                s = self.w[ids].sum(axis=0) * scale
                p = np.exp(s - s.max())
                p /= p.sum()
                p[labels[i]] -= 1
                g = (p * scale).astype(np.float32)
                u = np.unique(ids)
                grad2[u] += g * g
                self.w[u] -= 0.5 * g / np.sqrt(grad2[u])
        self._sums.clear()

    def best(self, words: list[str]) -> str | None:
        return self.names[int(np.argmax(self._logits(words)))] if words and self.names else None


class Model:
    def __init__(self, langs: Languages, vocab: set[str]):
        self.langs, self.vocab = langs, vocab
        self._names: dict[str, bool] = {}
        self._buckets: dict[str, int] = {}
        self._source: tuple | None = None
        self.ratio: dict[tuple[str | None, str | None], tuple[float, float]] = {}
        self.w = np.zeros((DIM, len(DEFECTS)), np.float32)
        self.bias = np.zeros(len(DEFECTS), np.float32)
        self.threshold = np.full(len(DEFECTS), 0.5)

    def is_name(self, t: str) -> bool:
        """Names, numbers and identifiers pass through a translation unchanged."""
        if t in self.vocab:  # which holds no such words
            return False
        known = self._names.get(t)
        if known is None:
            if len(self._names) > 200_000:
                self._names.clear()
            known = self._names[t] = not _CJK.match(t) or any(c.isdigit() or c == "_" for c in t)
        return known

    def pair(self, source: str | None, output: str | None, target: str | None) -> dict:
        s, o = source or "", output or ""
        if self._source is None or self._source[0] != s:
            # Pairs of one source come in a row where defects are made from it.
            every = tokens(s)
            plain = [t for t in (tokens(_FENCE.sub(" ", s)) if "```" in s else every) if not self.is_name(t)]
            parts = sentences(s)
            last = [t for t in tokens(parts[-1]) if self.is_name(t)] if parts else []
            self._source = (s, plain, [t for t in every if self.is_name(t)], parts, last, self.langs.best(plain), Counter(plain))
        _, s_plain, names, parts, last, src, s_count = self._source
        o_bare = _TAG.sub(" ", o) if "<" in o else o
        fenced = "```" in o_bare
        # Words never run over the end of a sentence, so those of the sentences are all.
        o_parts = sentences(_FENCE.sub(" ", o_bare) if fenced else o_bare)
        by_part = [tokens(p) for p in o_parts]
        ow = [t for w in by_part for t in w]
        o_plain = [t for t in ow if not self.is_name(t)]
        have = set(tokens(o_bare)) if fenced else set(ow)
        joined = o.lower()
        found = [n for n in names if n in have or (len(n) > 3 and n in joined)]
        last_found = [n for n in last if n in have or (len(n) > 3 and n in joined)]
        common = sum(min(c, s_count[t]) for t, c in Counter(o_plain).items() if t in s_count)
        share, total = 0.0, 0
        known = target in self.langs.names
        for w in by_part:
            w = [t for t in w if not self.is_name(t)]
            n = sum(map(len, w))
            if n and self.langs.names:
                k = 3 if _CJK.match(w[0]) else 1
                total += n * k
                if not known or self.langs.best(w) == target:
                    share += n * k
        return {
            "words": len(ow), "name": len(names), "recall": len(found) / len(names) if names else 1.0,
            "last": len(last_found) / len(last) if last else 1.0, "plain": len(s_plain),
            "overlap": common / len(o_plain) if o_plain else 0.0, "cover": common / len(s_plain) if s_plain else 0.0,
            "share": share / total if total else 1.0, "total": total, "src": src, "o": o, "ow": ow, "o_plain": o_plain,
            "s_end": s.rstrip().rstrip("\"”»)’'`")[-1:], "o_end": o.rstrip().rstrip("\"”»)’'")[-1:], "sent": (len(parts), len(o_parts)),
            "log": float(np.log(max(1, len(o.strip())) / max(1, len(s.strip())))), "same": bool(s.strip()) and o.strip().lower() == s.strip().lower(), "target": target,
        }

    def features(self, p: dict) -> np.ndarray:
        f: list[str] = []
        cut5 = lambda x: min(5, int(x * 5 + 1e-9))
        nothing = p["plain"] == 0
        mean, sd = self.ratio.get((p["src"], p["target"]), self.ratio.get((None, None), (0.0, 0.3)))
        z = max(-6, min(6, round((p["log"] - mean) / max(0.05, sd))))
        f += ["nowords"] if p["words"] == 0 else []
        whole = " ".join(p["o"].split()).lower()
        if len(whole) <= 24:
            f += [f"all {whole}", f"all {re.sub(r'[^a-zäöüß ]', '', whole)}", "tiny"]
        f.append(f"r{cut5(p['recall'])}")
        f.append(f"l{cut5(p['last'])}")
        f.append("r=1" if p["recall"] == 1 else "r<1")
        f.append("l=1" if p["last"] == 1 else "l<1")
        f.append(f"n{min(3, p['name'])} r{cut5(p['recall'])}")
        f.append(f"c{'-' if nothing else cut5(p['overlap'])}{'-' if nothing else cut5(p['cover'])}")
        f.append(f"o{'-' if nothing else cut5(p['overlap'])}")
        f.append(f"lang{cut5(p['share'])}" + ("-" if nothing else ""))
        f.append(f"z{z}")
        stop = bool(p["o_end"]) and p["o_end"] in STOPS
        wants = bool(p["s_end"]) and p["s_end"] in STOPS
        end = "stop" if stop else "dots" if p["o_end"] in "…-[]" or p["o"].rstrip().endswith(("...", "[...]")) else "word"
        f += [f"end {end} {wants}", f"end {end} l{'=' if p['last'] == 1 else '<'}", f"end {end} z{max(-3, min(1, z))}"]
        whole_end = "=" if p["recall"] == 1 and p["last"] == 1 else "<"
        f.append(f"end {end} {wants} all{whole_end} {p['sent'][1] >= p['sent'][0]}")
        f.append(f"mostly {p['share'] < 0.5} {p['total'] >= 20} {nothing}")
        f.append(f"mostly {p['share'] < 0.5}")
        f.append(f"s{max(-3, min(3, p['sent'][1] - p['sent'][0]))} {end}")
        f.append(f"s{max(-3, min(3, p['sent'][1] - p['sent'][0]))} l{cut5(p['last'])}")
        if nothing and p["same"]:
            f.append("rightly same")
        ow = ["#" if self.is_name(t) else t for t in p["ow"]]
        # Whether the names come back decides what the wording says, so n-grams are told apart by it.
        gate = "b" if p["name"] and p["recall"] >= 0.5 else "u"
        f += [f"{gate} {w}" for w in set(ow)]
        f += [f"{gate}{gate} {a} {b}" for a, b in set(zip(ow, ow[1:], strict=False))]
        for k in (1, 2, 3):
            if len(ow) >= k:
                f.append(f"e{k} {'s' if stop else 'n'}{whole_end} {' '.join(ow[-k:])}")
        return np.array([self.bucket(x) for x in f], np.int64)

    def bucket(self, feature: str) -> int:
        b = self._buckets.get(feature)
        if b is None:
            if len(self._buckets) > 500_000:
                self._buckets.clear()
            b = self._buckets[feature] = _bucket(feature, DIM)
        return b

    def probabilities(self, ids: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.w[ids].sum(axis=0) + self.bias)))

    def defects(self, sources: list[str | None], outputs: list[str | None], targets: list[str | None]) -> list[str | None]:
        """The defect of each pair of a batch; all weights are summed at once."""
        out: list[str | None] = [None] * len(outputs)
        rows, ids = [], []
        for i, (s, o, t) in enumerate(zip(sources, outputs, targets, strict=True)):
            p = self.pair(s, o, t)
            if p["words"] == 0 and not p["same"]:
                out[i] = "empty"  # by definition: blanks, markup or punctuation only
            else:
                rows.append(i)
                ids.append(self.features(p))
        if rows:
            at = np.cumsum([0] + [len(x) for x in ids[:-1]])
            score = np.add.reduceat(self.w[np.concatenate(ids)], at, axis=0) + self.bias
            hit = 1 / (1 + np.exp(-score)) >= self.threshold
            for i, any_, first in zip(rows, hit.any(axis=1).tolist(), hit.argmax(axis=1).tolist(), strict=True):
                if any_:
                    out[i] = DEFECTS[first]
        return out

    def defect(self, source: str | None, output: str | None, target: str | None) -> str | None:
        return self.defects([source], [output], [target])[0]


def corrupt(rng: random.Random, s: str, o: str, t: str, others: list[str], names: list[str]) -> list[tuple[str, str, str, str | None]]:
    """(source, output, target, defect) made from a sound pair, harmless variants included."""
    out: list[tuple[str, str, str, str | None]] = [(s, o, t, None)]
    quote = rng.choice(['"{}"', "“{}”", "« {} »", "{}\n", "  {}", " {} ", "> {}"])
    out.append((s, quote.format(o), t, None))
    out.append((s, rng.choice(LABELS) + o, t, None))
    if o.rstrip()[-1:] in ".。!?":
        out.append((s, o.rstrip()[:-1], t, None))
    out.append((s, rng.choice(PLACEHOLDERS), t, "empty"))
    for _ in range(2):
        r = refusal(rng, rng.choice(names) if names else "this")
        if rng.random() < 0.35:
            r += rng.choice([" ", "\n\n"]) + refusal(rng, rng.choice(names) if names else "this")
        r = rng.choice(["{}", "{}", "{}", "> {}", '"{}"']).format(r.upper() if rng.random() < 0.1 else r)
        out.append((s, r, t, "refusal"))
    words = s.split(" ")
    if len(words) > 5 and rng.random() < 0.5:
        for _ in range(rng.choice([1, 2])):
            words[rng.randrange(len(words))] = rng.choice(o.split() or ["x"])
    c = " ".join(words) if rng.random() < 0.4 else s
    c = rng.choice([c, c, c.upper(), c.lower(), "  ".join(c.split(" ")), f'"{c}"', f"{c}\n\n{c}", rng.choice(LABELS) + c, c.rstrip(".")])
    out.append((s, c, t, "copy"))
    if others:
        # The language is asked for before the end, so cut ones are of the wrong language too.
        w = rng.choice([o, o, o.rstrip().rstrip(STOPS), o[: max(12, len(o) * 4 // 5)]])
        out.append((s, rng.choice(["{}", "{}", '"{}"']).format(w), rng.choice(others), "wrong_language"))
    body = o.rstrip()
    spans = sentences(body)
    for _ in range(3):
        kind = rng.random()
        if kind < 0.35 and len(spans) >= 2:
            keep = rng.randrange(1, len(spans))
            at = body.find(spans[keep])
            if at > 0:
                out.append((s, body[:at].rstrip(), t, "truncated"))
                continue
        n = len(body)
        if n < 24:
            continue
        at = rng.randrange(n // 6, n - 2) if kind < 0.75 else max(4, n - rng.randrange(4, 40))
        cut = body[:at].rstrip()
        if cut.endswith((".", "。", "!", "?")):
            continue
        out.append((s, cut + rng.choice(["", "", "", "...", "…", " [...]", "-"]), t, "truncated"))
    return out


def fit(rows: list[tuple[str, str, str]], seed: int = 3) -> Model:
    """The classifier of a bounded list of (source, output, target language)."""
    rng = random.Random(seed)
    rows = [(s or "", o or "", t) for s, o, t in rows if t]
    count: Counter[str] = Counter()
    for s, o, _ in rows:
        count.update(set(tokens(s)) | set(tokens(o)))
    vocab = {w for w, c in count.items() if c >= max(4, 0.001 * len(rows)) and not any(ch.isdigit() or ch == "_" for ch in w)}
    names = sorted({t for _, _, t in rows if sum(1 for x in rows if x[2] == t) >= 0.002 * len(rows)}) if rows else []
    langs = Languages(names)
    plain = lambda x: [w for w in tokens(x) if w in vocab or _CJK.match(w)]
    parts = lambda x: [w for w in (plain(p) for p in sentences(_FENCE.sub(" ", x))) if w]
    data = [(w, names.index(t)) for _, o, t in rows if t in names for w in parts(o)]
    for turn in range(2):  # the second time without what the first found mislabelled, and with the sources
        if not data:
            break
        langs.w[:] = 0
        langs._sums.clear()
        langs.train([d for d, _ in data], [y for _, y in data])
        if turn == 0:
            data = [(d, y) for d, y in data if int(np.argmax(langs.scores(d))) == y] or data
            for s, _, _ in rows:
                for w in parts(s):
                    p = langs.scores(w)
                    if p.max() > 0.9:
                        data.append((w, int(np.argmax(p))))
    model = Model(langs, vocab)
    sound = []
    ratios: dict = {}
    for s, o, t in rows:
        p = model.pair(s, o, t)
        if p["words"] == 0 or p["recall"] < 1 or p["share"] < 0.9 or (p["overlap"] >= 0.6 and p["plain"]) or (p["s_end"] in STOPS and p["o_end"] not in STOPS):
            continue
        if p["plain"] and p["src"] == t:
            continue
        sound.append((s, o, t, p))
        for key in ((p["src"], t), (None, None)):
            ratios.setdefault(key, []).append(p["log"])
    model.ratio = {k: (float(np.median(v)), float(np.std(v))) for k, v in ratios.items() if len(v) >= 5 or k == (None, None)}
    x, y, held = [], [], []
    for k, (s, o, t, p) in enumerate(sound):
        marks = [w for w in tokens(s) if model.is_name(w) and "_" not in w and w.isalpha()]
        others = [n for n in names if n not in (t, p["src"])] if p["plain"] and p["total"] else []
        for cs, co, ct, d in corrupt(rng, s, o, t, others, marks):
            if p["plain"] == 0 and d in ("copy", "wrong_language"):
                d = None
            x.append(model.features(model.pair(cs, co, ct)))
            y.append([float(d == n) for n in DEFECTS])
            held.append(k % 5 == 0)
    if not x:
        return model
    labels, held = np.array(y, np.float32), np.array(held)
    grad2, bias2 = np.full_like(model.w, 1e-3), np.full(len(DEFECTS), 1e-3, np.float32)
    train = np.flatnonzero(~held)
    r = np.random.default_rng(seed)
    for _ in range(6):
        for i in r.permutation(train):
            ids = x[i]
            g = model.probabilities(ids) - labels[i]
            if np.abs(g).max() < 0.02:
                continue
            grad2[ids] += g * g
            model.w[ids] -= (0.3 * g / np.sqrt(grad2[ids])).astype(np.float32)
            bias2 += g * g
            model.bias -= (0.3 * g / np.sqrt(bias2)).astype(np.float32)
    test = np.flatnonzero(held)
    if len(test):
        p = np.array([model.probabilities(x[i]) for i in test])
        for d in range(len(DEFECTS)):
            grid, true = np.linspace(0.05, 0.95, 37), labels[test, d] > 0
            f1 = [2 * ((p[:, d] >= th) & true).sum() / max(1, (p[:, d] >= th).sum() + true.sum()) for th in grid]
            # The middle of all thresholds that are as good as the best.
            model.threshold[d] = float(np.mean(grid[np.array(f1) >= max(f1) - 1e-3]))
    langs._seen, langs._sums, model._names, model._buckets, model._source = {}, {}, {}, {}, None
    return model


def find(pairs: DataFrame, sample_rows: int = 4000) -> DataFrame:
    """id, defect of the defective rows of ``pairs`` (id long, source string, output string, target string)."""
    one = pairs.filter("id is not null").groupBy("id").agg(F.min(F.struct(F.coalesce("output", F.lit("")).alias("output"), "source", "target")).alias("r")).select("id", "r.*")
    # A fixed number of rows goes to the driver to be learnt from.
    some = one.orderBy(F.xxhash64("id"), "id").limit(sample_rows).collect()
    model = fit([(r["source"], r["output"], language(r["target"])) for r in some])
    shared = pairs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for b in batches:
            sources, outputs, targets = (b.column(c).to_pylist() for c in ("source", "output", "target"))
            found = m.defects(sources, outputs, [language(t) for t in targets])
            keep = pa.array([i for i, f in enumerate(found) if f], pa.int64())
            yield pa.record_batch([b.column("id").take(keep), pa.array([f for f in found if f], pa.string())], names=["id", "defect"])

    return one.mapInArrow(run, "id long, defect string")
