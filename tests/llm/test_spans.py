import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from loomspan.llm import chars, spans


def brute_pairs(rows, length):
    seen = {}
    for i, t in rows:
        for k in range(len(t or "") - length + 1):
            seen.setdefault(t[k : k + length], set()).add(i)
    return {(a, b) for ids in seen.values() for a in ids for b in ids if a < b}


def brute_cover(rows, length):
    where = {}
    for i, t in rows:
        for k in range(len(t or "") - length + 1):
            where.setdefault(t[k : k + length], set()).add(i)
    out = {}
    for i, t in rows:
        mark = [False] * len(t or "")
        for k in range(len(t or "") - length + 1):
            if len(where[t[k : k + length]]) > 1:
                mark[k : k + length] = [True] * length
        out[i] = sum(mark)
    return out


def corpus(seed=2):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choices("abcdefgh \n数é", k=n))
    shared = [text(rng.randrange(20, 90)) for _ in range(6)]
    rows = []
    for i in range(50):
        rows.append((i, "".join(rng.choice([text(rng.randrange(5, 60)), rng.choice(shared), rng.choice(shared)[:38]]) for _ in range(rng.randrange(1, 6)))))
    rows += [(60, "ab" * 80), (61, "x" + "ab" * 70), (62, "ab" * 30 + "q" * 40), (63, "z" * 200), (64, "z" * 45), (65, ""), (66, None), (67, "ab" * 80)]
    return rows


def test_pairs_and_report_equal_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "extra") for i, t in rows], "id long, text string, class string")
    for limit in (8192, 5):
        got = {tuple(r) for r in spans.sharing_pairs(df, 40, run_limit=limit).collect()}
        assert got == brute_pairs(rows, 40)
    report = {r["id"]: r for r in spans.share_report(df, 40).collect()}
    want = brute_cover(rows, 40)
    assert {i: r["shared_chars"] for i, r in report.items()} == want
    assert report[66]["n_chars"] == 0 and report[66]["shared_fraction"] == 0


def test_spans_are_maximal(spark):
    s = "The quick brown fox jumps over the lazy dog again and again. "
    rows = [(1, "AAAA" + s + "BBBBBBB"), (2, "CC" + s + "D"), (3, "nothing of this here at all, really nothing of it to be seen")]
    got = {(r["id"], r["span_start"], r["span_end"], r["partners"]) for r in spans.shared_spans(spark.createDataFrame(rows, "id long, text string"), 30).collect()}
    assert got == {(1, 4, 4 + len(s), 1), (2, 2, 2 + len(s), 1)}


def test_empty_table(spark):
    df = spark.createDataFrame([], "id long, text string")
    assert spans.sharing_pairs(df).count() == 0 and spans.share_report(df).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.text("ab", min_size=12, max_size=60), st.text("ab", min_size=0, max_size=20), st.text("ab", min_size=0, max_size=20))
def test_shared_run_always_has_a_common_key(run, left, right):
    a, b = left + run, run + right
    keys = [set(spans.keys_of([t], 12, 4)[1].tolist()) for t in (a, b)]
    assert keys[0] & keys[1]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 50), min_size=1, max_size=80), st.integers(1, 20))
def test_sliding_min(values, width):
    h = np.array(values, np.uint64)
    want = [min(values[i : i + width]) for i in range(len(values) - width + 1)]
    assert chars.sliding_min(h, width).tolist() == want


@settings(max_examples=30, deadline=None)
@given(st.text(max_size=80), st.integers(1, 9))
def test_window_hashes_tell_windows_apart(text, width):
    h = chars.window_hashes(chars.code_points([text])[0], width)
    want = [text[i : i + width] for i in range(len(text) - width + 1)]
    assert len(h) == len(want)
    assert len(set(h.tolist())) == len(set(want))
