"""From pairs of classes to pairs of records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Up to so many exact copies of one record, all of them are paired with each other.
PAIRED_COPIES = 256
#: A class of more records is paired in blocks of about so many, each pair of blocks a task's key of its own.
BLOCK_ROWS = 1024


def expand(members: DataFrame, pairs: DataFrame, scope: list[str], most: int | None = PAIRED_COPIES, block_rows: int = BLOCK_ROWS, form: bool = False) -> DataFrame:
    """scope, id_a, id_b (smaller first) of class pairs and of the members of one class.

    ``members``: scope, id, class and, where a class is wider than exact copies,
    same (equal for exact copies only); ``pairs``: scope, class_a, class_b. More
    than ``most`` exact copies take the class form: each copy is paired with the
    smallest id of its copies, which stands for it in all other pairs. So one
    group of copies that holds a third of all rows costs a row each, and no link
    between different records is lost: those of one class are all paired. With
    ``most`` None every pair comes out, however many copies there are. ``form``
    adds a column that tells the rows of the class form ("copy") from pairs
    ("pair").
    """
    few = F.lit(True) if most is None else F.col("_n") <= most
    m = members if "same" in members.columns else members.withColumn("same", F.col("class"))
    m = m.select(*scope, "id", "class", "same").distinct()
    sized = m.groupBy(*scope, "class", "same").agg(F.count("*").alias("_n"), F.min("id").alias("_first"))
    m = m.join(sized, [*scope, "class", "same"])
    seen = m.filter(few | (F.col("id") == F.col("_first"))).select(*scope, "class", "id").distinct()
    a = seen.select(*scope, F.col("class").alias("class_a"), F.col("id").alias("x"))
    b = seen.select(*scope, F.col("class").alias("class_b"), F.col("id").alias("y"))
    across = pairs.join(a, [*scope, "class_a"]).join(b, [*scope, "class_b"]).select(*scope, "x", "y").filter("x <> y")
    blocks = seen.groupBy(*scope, "class").agg(F.count("*").alias("_n")).filter("_n > 1").select(*scope, "class", F.ceil(F.col("_n") / block_rows).cast("long").alias("_blocks"))
    spread = seen.join(blocks, [*scope, "class"]).withColumn("_block", F.pmod(F.xxhash64("id"), F.col("_blocks"))).withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)))
    key = [*scope, "class", "_low", "_high"]
    left, right = (spread.select(*scope, "class", F.least("_block", "_other").alias("_low"), F.greatest("_block", "_other").alias("_high"), F.col("id").alias(i), F.col("_block").alias(f"_{i}")) for i in ("x", "y"))
    within = left.join(right, key).filter("x < y and (_low = _high or _x <> _y)").select(*scope, "x", "y")
    star = m.filter(~few & (F.col("id") != F.col("_first"))).select(*scope, F.col("_first").alias("x"), F.col("id").alias("y"))
    kinds = [F.lit("copy").alias("form")] if form else []
    pair = [F.lit("pair").alias("form")] if form else []
    every = across.union(within).select("*", *pair).union(star.select("*", *kinds))
    return every.select(*scope, F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"), *(["form"] if form else [])).distinct()
