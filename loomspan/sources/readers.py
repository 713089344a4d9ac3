"""Readers: a dataset by its address, with the columns id, text and source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNK_FIELDS = ["id", "url", "source", "text", "content", "body"]
#: Files whose text is read, and folders that are not entered.
TEXT_SUFFIXES = ("txt", "md", "rst", "py", "rs", "ts", "js", "json", "toml", "yaml", "yml", "html")
SKIPPED = (".git", "node_modules", "__pycache__", ".venv", "target", "dist", "build")


def _schema(names: list[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def _shaped(df: DataFrame) -> DataFrame:
    """id and text from whichever of their columns is there."""
    first = lambda *cs: F.coalesce(*(F.when(F.trim(c) != "", F.col(c)) for c in cs if c in df.columns), F.lit(None).cast("string"))
    text = first("text", "content", "body")
    ident = F.coalesce(first("id", "url", "source"), F.concat(F.lit("row-"), F.substring(F.sha2(F.coalesce(text, F.lit("")), 256), 1, 16)))
    return df.select(ident.alias("id"), text.alias("text"), first("source", "url").alias("source")).filter("text is not null")


def jsonl(spark: SparkSession, path: str, schema: T.StructType | str | None = None, limit: int | None = None) -> DataFrame:
    """JSON lines; malformed lines are left out, a missing file is no rows."""
    schema = schema or _schema(CHUNK_FIELDS)
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    df = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    return df if limit is None else df.limit(limit)


def jsonl_dataset(spark: SparkSession, path: str) -> DataFrame:
    return _shaped(jsonl(spark, path))


def csv_dataset(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header (S3)."""
    return _shaped(spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path))


def text_tree(spark: SparkSession, path: str, max_chars: int | None = None) -> DataFrame:
    """path, text, n_chars of the text files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{" + ",".join(TEXT_SUFFIXES) + "}").load(path)
    for name in SKIPPED:
        files = files.filter(~F.col("path").contains(f"/{name}/"))
    text = F.decode("content", "UTF-8")
    return files.select("path", (text if max_chars is None else F.substring(text, 1, max_chars)).alias("text")).withColumn("n_chars", F.length("text"))


def run_artifacts(spark: SparkSession, path: str) -> DataFrame:
    """Chunks of a run with their stored vectors, null where there is none."""
    chunks = spark.read.parquet(f"{path}/chunks")
    vectors = spark.read.parquet(f"{path}/vectors").select("chunk_id", "vector")
    return chunks.join(vectors, "chunk_id", "left")


def dataset(spark: SparkSession, address: str) -> DataFrame:
    """Reader by suffix (S6): jsonl, csv, parquet, else a text tree."""
    low = address.lower().rstrip("/")
    if low.startswith(("http://", "https://")):
        raise ValueError("network sources arrive as tables of pages")
    if low.endswith((".jsonl", ".ndjson", ".json")):
        return jsonl_dataset(spark, address)
    if low.endswith(".csv"):
        return csv_dataset(spark, address)
    if low.endswith(".parquet"):
        return spark.read.parquet(address)
    return text_tree(spark, address)


def graph_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(vertices, links) of a graph document: nodes and links arrays."""
    g = spark.read.option("multiLine", True).json(path)
    nodes = g.select(F.explode("nodes").alias("n"))
    fields = nodes.schema["n"].dataType.fieldNames()
    ident = F.coalesce(*(F.col(f"n.{c}").cast("string") for c in ("id", "node_id") if c in fields))
    links = g.select(F.explode("links").alias("l"))
    lf = links.schema["l"].dataType.fieldNames()
    conf = F.coalesce(*(F.col(f"l.{c}").cast("double") for c in ("confidence_score", "weight") if c in lf), F.lit(1.0))
    return nodes.select(ident.alias("id")), links.select(F.col("l.source").alias("src"), F.col("l.target").alias("dst"), (F.col("l.relation") if "relation" in lf else F.lit(None)).cast("string").alias("relation"), conf.alias("confidence"))


def embeddings_json(df: DataFrame, column: str) -> DataFrame:
    """A text column with JSON arrays as vectors."""
    return df.withColumn(column, F.from_json(F.col(column), "array<float>"))


def modality(content: str = "content"):
    """Kind of a file by its first bytes (S13): text, image, video, archive or quarantine."""
    head = F.hex(F.substring(F.col(content), 1, 12))
    starts = lambda *xs: F.greatest(*(head.startswith(x) for x in xs), F.lit(False))
    return (
        F.when(F.length(content) == 0, "quarantine")
        .when(starts("89504E47", "FFD8FF", "47494638", "424D"), "image")
        .when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "image")
        .when((F.substring(head, 9, 8) == "66747970") | head.startswith("1A45DFA3"), "video")
        .when(starts("504B0304", "1F8B", "25504446"), "archive")
        .when(F.locate("00", head) % 2 == 1, "quarantine")
        .otherwise("text")
    )


def transcript_tail(turns: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """The last ``n`` turns of each transcript with a role."""
    from pyspark.sql import Window

    role = F.lower(F.coalesce("role", F.lit("")))
    who = F.when(role.isin("user", "human"), "user").when(role.isin("assistant", "model", "ai"), "assistant").otherwise("system")
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return turns.withColumn("role", who).withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p))


def parallel_corpus(spark: SparkSession, path: str, source: str = "source_text", target: str = "target_text") -> DataFrame:
    """source_text, target_text, source_lang, target_lang, pair_id of aligned sentences in JSON lines.

    Pairs without either side are left out; languages are lower-case primary
    codes, null where they are not given; the id is the pair's own content.
    """
    names = [source, target, "source_lang", "target_lang"]
    df = jsonl(spark, path, _schema(names))
    code = lambda c: F.lower(F.regexp_extract(F.trim(c), "^([A-Za-z]{2,3})", 1))
    some = lambda c: F.coalesce(F.trim(c) != "", F.lit(False))
    pair = F.substring(F.sha2(F.concat_ws("\x1f", source, target), 256), 1, 16)
    lang = lambda c: F.when(code(c) != "", code(c)).alias(c)
    return df.filter(some(source) & some(target)).select(F.col(source).alias("source_text"), F.col(target).alias("target_text"), lang("source_lang"), lang("target_lang"), pair.alias("pair_id"))
