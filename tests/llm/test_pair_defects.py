import random

import pytest

from loomspan.llm import pair_defects as P
from loomspan.sources.tables import table

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def rows(spark):
    t = table(spark, SF, "translation_feedback").dropDuplicates(["id"]).select("source_text", "model_output", "target_lang").collect()
    return [(r[0], r[1], P.language(r[2])) for r in t]


@pytest.fixture(scope="module")
def model(rows):
    return P.fit(rows[:600])


def test_held_out_accuracy(model, rows):
    rng = random.Random(1)
    hits = total = wrong = clean = 0
    for s, o, t in rows[600:]:
        p = model.pair(s, o, t)
        if model.defect(s, o, t) is not None or p["recall"] < 1 or p["plain"] == 0 or p["src"] == t:
            continue
        names = [w for w in P.tokens(s) if model.is_name(w) and w.isalpha()]
        for cs, co, ct, d in P.corrupt(rng, s, o, t, [x for x in model.langs.names if x not in (t, p["src"])], names):
            got = model.defect(cs, co, ct)
            if d is None:
                clean += 1
                wrong += got is not None
            else:
                total += 1
                hits += got == d
    assert hits / total >= 0.9 and wrong / clean <= 0.06


def test_plain_cases(model):
    s = "The reviewer of velmakr asked why the hooks ignore tape_head_60f18 although run_1 lists 1551 of them."
    assert model.defect(s, "", "fr") == "empty" and model.defect(s, None, "fr") == "empty" and model.defect(s, "```\n```", "fr") == "empty"
    assert model.defect(s, "I'm sorry, but I can't translate this text.", "fr") == "refusal"
    assert model.defect(s, s.upper(), "fr") == "copy" and model.defect(s, f"{s}\n\n{s}", "fr") == "copy"
    assert model.defect("run_49d6b", "run_49d6b", "fr") is None and model.defect("547 / 387", '"547 / 387"', "de") is None


# Written for this test alone; neither the grammar nor the supplied rows hold these sentences.
UNSEEN = (
    "It would be irresponsible of me to put these lines into another language.",
    "Sadly that lies beyond what I can do for you here.",
    "I have been told not to touch passages of this kind, so I shall leave it.",
    "Sorry - not something I'm willing to translate.",
    "We regret that translating the above is not possible.",
    "Please understand that I can not produce a translation for you.",
    "I do not translate content like this.",
    "Dafür bin ich nicht zuständig, bitte haben Sie Verständnis.",
    "Ich bedaure, aber eine Übertragung dieses Textes ist mir untersagt.",
    "Solche Inhalte übersetze ich grundsätzlich nicht.",
    "Bitte verzeihen Sie, das kann ich so nicht übersetzen.",
    "Je crains de ne pouvoir traduire un tel passage.",
    "Cette traduction dépasse ce que mes consignes autorisent.",
    "Je ne traduis pas ce genre de contenu, désolé.",
    "Me temo que no me corresponde traducir algo así.",
    "No traduzco este tipo de contenido, lo siento.",
    "Siento decirle que esta traducción no está permitida.",
    "非常抱歉，这类内容我无法为您翻译。",
    "恐怕我不能把它翻译出来。",
    "这样的文字我不予翻译，请谅解。",
)


def test_refusals_in_words_of_their_own(model):
    sources = ["The reviewer of velmakr asked why the hooks ignore tape_head_60f18 although run_1 lists 1551 of them."] * len(UNSEEN)
    for target, least in (("fr", 0.8), ("de", 0.8), ("es", 0.8)):
        got = model.defects(sources, list(UNSEEN), [target] * len(UNSEEN))
        recall = sum(g == "refusal" for g in got) / len(UNSEEN)
        assert all(g is not None for g in got) and recall >= least, (recall, [u for u, g in zip(UNSEEN, got, strict=True) if g != "refusal"])


def test_grammar_makes_many_sentences():
    rng = random.Random(4)
    for lang in ("en", "de", "fr", "es", "zh"):
        made = {P.refusal(rng, "velmakr", lang) for _ in range(2000)}
        assert len(made) > 500 and not any("{" in m for m in made)


def test_batches_equal_single_rows(model, rows):
    part = rows[600:660]
    batch = model.defects([r[0] for r in part], [r[1] for r in part], [r[2] for r in part])
    assert batch == [model.defect(*r) for r in part]


def test_languages_by_code():
    assert [P.language(c) for c in ("fr", "FR", "fr-FR", "fr_CA", "zh_Hans", None, "", "??")] == ["fr", "fr", "fr", "fr", "zh", None, None, None]


def test_tables(spark):
    rows = table(spark, SF, "translation_feedback").selectExpr("id", "source_text AS source", "model_output AS output", "target_lang AS target", "domain AS defect")
    odd = spark.createDataFrame([(10**9, None, None, None, "x"), (10**9 + 1, None, "", "fr", "x"), (None, "a", "b", "fr", "x"), (10**9 + 2, "x" * 50000, "", "", "x")], rows.schema)
    got = {r["id"]: r["defect"] for r in P.find(rows.union(odd), 400).collect()}
    assert got[10**9] == "empty" and got[10**9 + 1] == "empty" and got[10**9 + 2] == "empty" and None not in got
    assert set(got.values()) <= set(P.DEFECTS)
    assert P.find(rows.limit(0)).count() == 0
