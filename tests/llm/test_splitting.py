from hypothesis import given, settings
from hypothesis import strategies as st

from loomspan.llm import splitting

TEXT = (
    "Intro sentence with e.g. one abbreviation and 3.5 in it. Second one, cf. No. 12 in x_1.json! “Quoted one?” (In brackets.) The run stopped ... then went on.\n"
    "\n## A heading\n\nPara one is\nwrapped here. Next.\n\n* item one. More of it.\n* item two\n\n1. first\n2. second\n\n```\ncode. Not here.\n\n# nor here\n```\nAfter code.\n\nOpen questions about x\n======\nDie Quote stieg d. h. um ca. 34 Punkte, vgl. Nr. 5. Neuer Satz.\n\n第一句。第二句？“第三句。”第四句"
)


def starts(text):
    return [text[p : p + 12].split("\n")[0] for p, _ in splitting.natural_places(text)]


def test_places():
    got = starts(TEXT)
    want = ["Second one, ", "“Quoted one?", "(In brackets", "The run stop", "## A heading", "Para one is", "Next.", "* item one. ", "More of it.", "* item two", "1. first", "2. second", "```", "After code.", "Open questio", "Die Quote st", "Neuer Satz.", "第一句。第二句？“第三句"[:12], "第二句？“第三句。”第四句"[:12], "“第三句。”第四句", "第四句"]
    assert got == want


def test_no_place():
    assert splitting.natural_places("a,b,c," * 500) == []
    assert splitting.natural_places("") == [] and splitting.natural_places("\n\nOnly one sentence.") == []


@settings(max_examples=60, deadline=None)
@given(st.text(st.sampled_from("ab. \n!?数。"), max_size=900), st.integers(40, 120), st.integers(0, 15))
def test_pieces_cover_the_text(text, limit, overlap):
    p = splitting.split_points(text, limit, overlap)
    assert p[0][0] == 0 and p[-1][1] == len(text)
    assert all(0 <= e - s <= limit for s, e in p)
    assert all(a < c <= b < d for (a, b), (c, d) in zip(p, p[1:], strict=False))


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("ab. \n!?数。"), max_size=600), st.sampled_from(["", "x" * 900, "数" * 700, " " * 800, "word " * 160]), st.integers(8, 120), st.floats(0, 1))
def test_pieces_cover_unbroken_texts_for_every_overlap(text, more, limit, share):
    text, overlap = text + more, int(share * (limit // 2 - 1))
    p = splitting.split_points(text, limit, overlap)
    assert p[0][0] == 0 and p[-1][1] == len(text)
    assert all(0 <= e - s <= limit for s, e in p)
    assert all(a < c <= b < d for (a, b), (c, d) in zip(p, p[1:], strict=False))


def test_large_overlaps_lose_no_text():
    for text in ("x" * 5000, "数" * 5000, " " * 5000, "y" * 2500, "Plain words go on. " * 400, "w" * 2500 + " and more"):
        for overlap in (0, 200, 600, 1100, 1199):
            p = splitting.split_points(text, 2400, overlap)
            assert p[0][0] == 0 and p[-1][1] == len(text) and all(e - s <= 2400 for s, e in p)
            assert all(a < c <= b < d for (a, b), (c, d) in zip(p, p[1:], strict=False))


def test_overlap_and_natural_starts():
    text = " ".join(f"Sentence number {i} says a little more than the one before it did." for i in range(200))
    places = {p for p, _ in splitting.natural_places(text)}
    pieces = splitting.split_points(text, 2400, 200)
    assert all(s in places for s, _ in pieces[1:])
    assert all(120 <= b - c <= 280 for (_, b), (c, _) in zip(pieces, pieces[1:], strict=False))


def test_tables(spark):
    long = " ".join(f"Sentence {i} goes on for a while." for i in range(120))
    rows = [("c1", "d1", 0, long, "x"), ("c1", "d1", 0, long, "x"), ("c2", "d1", 1, "short", "x"), ("c3", "d2", None, None, "x"), ("c4", "d2", 3, "", "x"), ("c5", None, 0, "orphan", "x")]
    chunks = spark.createDataFrame(rows, "chunk_id string, document_id string, position int, text string, piece string")
    got = splitting.split(chunks, 2400, 200).collect()
    d1 = sorted((r["position"], r["text"]) for r in got if r["document_id"] == "d1")
    assert [p for p, _ in d1] == list(range(len(d1))) and d1[-1][1] == "short" and all(len(t) <= 2400 for _, t in d1)
    assert len({r["chunk_id"] for r in got}) == len(got)
    docs = spark.createDataFrame([(1, "d1"), (2, "d2"), (3, "none"), (4, None)], "doc_id long, document_id string")
    counts = {r["doc_id"]: r["chunk_count"] for r in splitting.chunk_counts(docs, splitting.split(chunks)).collect()}
    assert counts == {1: len(d1), 2: 2, 3: 0, 4: 0}
    places = splitting.places(chunks).collect()
    assert {r["chunk_id"] for r in places} == {"c1"} and len(places) == 119
    assert splitting.split(chunks.limit(0)).count() == 0
