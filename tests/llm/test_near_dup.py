import random
import re
import unicodedata

from loomspan.llm import near_dup

SCHEMA = "kind int, id string, text string, size int"


def words(t):
    return frozenset(re.findall(r"[^\W_]+", unicodedata.normalize("NFC", (t or "").lower())))


def brute(rows, threshold):
    out = set()
    for k, a, x, _ in rows:
        for k2, b, y, _ in rows:
            if k == k2 and a is not None and b is not None and a < b:
                s, t = words(x), words(y)
                if s and t and len(s & t) / len(s | t) >= threshold - 1e-12:
                    out.add((k, a, b))
    return out


def corpus(seed=1, n=120):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)] + ["été", "Größe", "数据"]
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.5:
            t = rng.choice(rows)[2].split()
            for _ in range(rng.randrange(0, 6)):
                t[rng.randrange(len(t))] = rng.choice(vocab)
            rng.shuffle(t)
        else:
            t = rng.choices(vocab, k=rng.choice([5, 12, 30, 60]))
        rows.append((i % 2, f"id{i:04d}", " ".join(t), 7))
    return rows


def test_pairs_equal_brute_force(spark):
    rows = corpus()
    rows += [(0, "empty", "", 1), (0, "null", None, 1), (0, "blank", " _ - ", 1), (0, None, "a b", 1), (0, "id0000", rows[0][2], 1)]
    for threshold in (0.8, 0.5):
        got = {tuple(r) for r in near_dup.similar_pairs(spark.createDataFrame(rows, SCHEMA), threshold).collect()}
        assert got == brute(rows, threshold)


def test_tiles_cut_into_blocks_lose_nothing(spark):
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    rows = [(0, f"r{i:03d}", " ".join([*base, f"x{i}"]), 0) for i in range(60)]
    got = {tuple(r) for r in near_dup.similar_pairs(spark.createDataFrame(rows, SCHEMA), 0.8, tile_limit=8).collect()}
    assert got == brute(rows, 0.8) and len(got) == 60 * 59 // 2


def test_copies_are_one_class(spark):
    rows = [(0, f"c{i:03d}", "one two three four five", 0) for i in range(200)] + [(0, "near", "one two three four five six", 0)]
    members, pairs = near_dup.similar_sets(spark.createDataFrame(rows, SCHEMA), 0.8)
    assert members.count() == 201 and pairs.count() == 1


def test_many_copies_take_the_class_form(spark):
    rows = [(0, f"c{i:04d}", "one two three four five six", 0) for i in range(700)] + [(0, f"d{i}", "one two three four five seven six", 0) for i in range(3)]
    got = {(r["id_a"], r["id_b"]) for r in near_dup.similar_pairs(spark.createDataFrame(rows, SCHEMA), 0.8).collect()}
    assert got == {("c0000", f"c{i:04d}") for i in range(1, 700)} | {("c0000", f"d{i}") for i in range(3)} | {("d0", "d1"), ("d0", "d2"), ("d1", "d2")}


def test_every_pair_of_copies_where_asked_for(spark):
    rows = [(0, f"c{i:04d}", "one two three four five six", 0) for i in range(300)] + [(0, "d", "one two three four five seven six", 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r["id_a"], r["id_b"]) for r in near_dup.similar_pairs(df, 0.8, paired_copies=None).collect()}
    ids = [r[1] for r in rows]
    assert got == {(a, b) for a in ids for b in ids if a < b}
    forms = near_dup.similar_pairs(df, 0.8, form=True).groupBy("form").count().collect()
    assert {r["form"]: r["count"] for r in forms} == {"copy": 299, "pair": 1}


def test_classes_and_links(spark):
    chain = ["a b c d e f g h i j", "a b c d e f g h i k", "a b c d e f g h l k", "z y x w v u t s"]
    rows = [(0, f"n{i}", t, 0) for i, t in enumerate(chain)]
    got = {r["id"]: (r["class_id"], r["links"]) for r in near_dup.duplicate_classes(spark.createDataFrame(rows, SCHEMA), 0.8).collect()}
    assert got == {"n0": ("n0", 1), "n1": ("n0", 2), "n2": ("n0", 1), "n3": ("n3", 0)}


def test_empty_table(spark):
    assert near_dup.similar_pairs(spark.createDataFrame([], SCHEMA)).count() == 0
    assert near_dup.duplicate_classes(spark.createDataFrame([], SCHEMA)).count() == 0


def test_long_text_and_bitmap_width(spark):
    rng = random.Random(3)
    long = " ".join(f"t{rng.randrange(10**6)}" for _ in range(20000))
    rows = [(0, "a", long, 0), (0, "b", long + " more", 0), (0, "c", long[: len(long) // 2], 0)]
    for n in (1, 4):
        assert [tuple(r) for r in near_dup.similar_pairs(spark.createDataFrame(rows, SCHEMA), 0.8, bitmap_words=n).collect()] == [(0, "a", "b")]


def test_different_texts_of_one_word_set_are_all_paired(spark):
    rng = random.Random(6)
    names, rows = "one two three four five six seven".split(), []
    orders = set()
    while len(orders) < 300:
        orders.add(" ".join(rng.sample(names, 7)))
    rows = [(0, f"t{i:03d}", t, 0) for i, t in enumerate(sorted(orders))] + [(0, f"u{i}", "one two three four five six seven eight", 0) for i in range(2)]
    got = {tuple(r) for r in near_dup.similar_pairs(spark.createDataFrame(rows, SCHEMA), 0.8).collect()}
    assert got == {(0, a, b) for a in (r[1] for r in rows) for b in (r[1] for r in rows) if a < b}


def test_copies_among_different_texts_of_one_word_set(spark):
    same = [(0, f"c{i:03d}", "one two three four five", 0) for i in range(300)]
    other = [(0, f"d{i}", f"five four three two one{'!' * i}", 0) for i in range(3)]
    got = {(r["id_a"], r["id_b"]) for r in near_dup.similar_pairs(spark.createDataFrame(same + other, SCHEMA), 0.8).collect()}
    assert got == {("c000", f"c{i:03d}") for i in range(1, 300)} | {("c000", f"d{i}") for i in range(3)} | {("d0", "d1"), ("d0", "d2"), ("d1", "d2")}


def test_large_classes_in_blocks_lose_nothing(spark):
    from loomspan.llm import copies

    members = spark.createDataFrame([(f"m{i:03d}", i // 50, i) for i in range(103)], "id string, class long, same long")
    got = sorted(tuple(r) for r in copies.expand(members, spark.createDataFrame([(0, 2)], "class_a long, class_b long"), [], block_rows=7).collect())
    ids = [f"m{i:03d}" for i in range(103)]
    want = [(a, b) for i, a in enumerate(ids) for j, b in enumerate(ids) if i < j and (i // 50 == j // 50 or (i // 50, j // 50) == (0, 2))]
    assert got == sorted(want)
