"""Queries that write tables with the sinks and read them back, and over content caches, logs and file kinds."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspan.operators import events as ev
from loomspan.plans.registry import query
from loomspan.session import shared_folder
from loomspan.sources import code, extract, html, readers, sinks
from loomspan.sources.tables import table, texts

_DOC = "(SELECT CAST(doc_id AS VARCHAR) AS id, text, url, title FROM documents)"


def _docs(spark, sf):
    return texts(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("id"), "text", "url", "title")


@query(f"SELECT id, length(text) AS n_chars, md5(text) AS digest FROM {_DOC} WHERE trim(text, ' ') <> ''")
def jsonl_round_trip(spark, sf):
    """Documents as JSON lines and back through the dispatcher."""
    path = f"{shared_folder(spark)}/documents.jsonl"
    sinks.jsonl(_docs(spark, sf).select("id", "text", "url"), path)
    back = readers.dataset(spark, path)
    return back.select("id", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("digest"))


@query(f"SELECT id, title AS text, CASE WHEN trim(url, ' ') <> '' THEN url END AS source FROM {_DOC} WHERE trim(title, ' ') <> ''")
def csv_round_trip(spark, sf):
    """Titles as CSV with a header and back."""
    path = f"{shared_folder(spark)}/titles.csv"
    _docs(spark, sf).select("id", F.col("title").alias("text"), "url").write.option("header", True).option("escape", '"').csv(path)
    return readers.dataset(spark, path)


@query("SELECT c.chunk_id, c.n, v.cid IS NOT NULL AS stored FROM (SELECT chunk_id, count(*) AS n FROM chunks GROUP BY 1) c LEFT JOIN (SELECT source_cid, min(cid) AS cid FROM vector_records GROUP BY 1) v ON v.source_cid = c.chunk_id")
def run_artifact_vectors(spark, sf):
    """A run's chunks and vectors written as artifacts, chunks read with the vectors they have."""
    chunks = table(spark, sf, "chunks").groupBy("chunk_id").agg(F.count("*").alias("n"))
    vectors = table(spark, sf, "vector_records").groupBy(F.col("source_cid").alias("chunk_id")).agg(F.min("cid").alias("vector"))
    path = shared_folder(spark)
    sinks.run_artifacts({"chunks": chunks, "vectors": vectors.filter("chunk_id is not null")}, path)
    return readers.run_artifacts(spark, path).select("chunk_id", "n", F.col("vector").isNotNull().alias("stored"))


@query("SELECT 'facts' AS artifact, count(*) AS n FROM global_facts UNION ALL SELECT 'sources', count(*) FROM sources")
def run_manifest(spark, sf):
    """The manifest of a run's row counts (K2)."""
    path = shared_folder(spark)
    sinks.run_artifacts({"facts": table(spark, sf, "global_facts"), "sources": table(spark, sf, "sources")}, path)
    return readers.jsonl(spark, f"{path}/manifest", "artifact string, n long")


@query("SELECT count(*) AS lines, CAST(sum(length(s_name) + 1) AS BIGINT) AS chars FROM supplier")
def text_tree_scan(spark, sf):
    """Text files below a folder."""
    path = shared_folder(spark)
    table(spark, sf, "supplier").select("s_name").write.text(f"{path}/names")
    files = readers.text_tree(spark, path)
    return files.agg(F.sum(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))).alias("lines"), F.sum("n_chars").cast("long").alias("chars"))


@query("SELECT CAST(n_regionkey AS VARCHAR) AS src, CAST(n_nationkey + 100 AS VARCHAR) AS dst, 'holds' AS relation, n_nationkey / 25.0 AS confidence FROM nation")
def graph_document(spark, sf):
    """A graph written as one document of nodes and links, and loaded."""
    n = table(spark, sf, "nation")
    ids = n.select(F.col("n_regionkey").alias("k")).union(n.select(F.col("n_nationkey") + 100)).distinct()
    nodes = ids.agg(F.collect_list(F.struct(F.col("k").cast("string").alias("id"))).alias("nodes"))
    link = F.struct(F.col("n_regionkey").cast("string").alias("source"), (F.col("n_nationkey") + 100).cast("string").alias("target"), F.lit("holds").alias("relation"), (F.col("n_nationkey") / 25.0).alias("confidence_score"))
    links = n.agg(F.collect_list(link).alias("links"))
    path = shared_folder(spark)
    nodes.crossJoin(links).write.json(path)  # one row each
    vertices, edges = readers.graph_json(spark, path)
    return edges.join(vertices.select(F.col("id").alias("src")), "src", "left_semi").select("src", "dst", "relation", "confidence")


@query("SELECT vec_id, len(embedding) AS n, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 4) AS total FROM embeddings")
def embeddings_as_text(spark, sf):
    """Vectors kept as JSON text, read back as arrays."""
    t = table(spark, sf, "embeddings").select("vec_id", F.to_json("embedding").alias("embedding"))
    v = readers.embeddings_json(t, "embedding")
    return v.select("vec_id", F.size("embedding").cast("long").alias("n"), F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double")), 4).alias("total"))


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'image' WHEN 1 THEN 'archive' WHEN 2 THEN 'video' ELSE CASE WHEN coalesce(text, '') = '' THEN 'quarantine' ELSE 'text' END END AS kind FROM documents")
def file_kinds(spark, sf):
    """Kinds of contents by their first bytes."""
    body = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    head = F.when(F.col("doc_id") % 4 == 0, F.unhex(F.lit("89504E470D0A1A0A"))).when(F.col("doc_id") % 4 == 1, F.unhex(F.lit("504B0304"))).when(F.col("doc_id") % 4 == 2, F.unhex(F.lit("1A45DFA3"))).otherwise(F.unhex(F.lit("")))
    d = texts(spark, sf, "documents").select("doc_id", F.concat(head, body).alias("content"))
    return d.select("doc_id", readers.modality().alias("kind"))


@query("SELECT event_id, CASE event_type WHEN 'view' THEN 'user' WHEN 'click' THEN 'assistant' ELSE 'system' END AS role FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n <= 5")
def transcript_tails(spark, sf):
    """The last five turns of each transcript with their roles."""
    role = F.when(F.col("event_type") == "view", "Human").when(F.col("event_type") == "click", "assistant").otherwise(F.lit(None))
    return readers.transcript_tail(table(spark, sf, "events").withColumn("role", role), "user_id", "event_id", 5).select("event_id", "role")


@query("SELECT DISTINCT cid FROM vector_records WHERE cid NOT IN (SELECT cid FROM vector_records WHERE tenant = 'world' AND cid IS NOT NULL) AND cid IS NOT NULL")
def insert_ignored_vectors(spark, sf):
    """Vectors to append to a store that holds the world's already (K3, K4)."""
    r = table(spark, sf, "vector_records").filter("cid is not null")
    return sinks.insert_ignore(r.filter("tenant = 'world'"), r, ["cid"]).select("cid")


@query("SELECT id, kind FROM (SELECT id, kind, row_number() OVER (PARTITION BY id ORDER BY new DESC, seq DESC) AS n FROM (SELECT o_custkey AS id, o_orderstatus AS kind, o_orderkey AS seq, o_orderdate >= TIMESTAMP '1998-01-01' AS new FROM orders)) WHERE n = 1")
def replaced_rows(spark, sf):
    """A table after an upsert in which the last writer wins (K5)."""
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderstatus").alias("kind"), F.col("o_orderkey").alias("seq"), "o_orderdate")
    new = F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp_ntz")
    return sinks.replace_rows(o.filter(~new).drop("o_orderdate"), o.filter(new).drop("o_orderdate"), ["id"], "seq").select("id", "kind")


@query("SELECT id, coalesce(max(t), 'UNKNOWN') AS type FROM (SELECT c_custkey AS id, c_mktsegment AS t FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT o_custkey, NULL FROM orders UNION ALL SELECT o_orderkey + 1000000, NULL FROM orders) GROUP BY 1")
def completed_endpoints(spark, sf):
    """Vertices with unknown ones for the ends of edges that are missing (K5): half of the customers are known."""
    v = table(spark, sf, "customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("type"))
    e = table(spark, sf, "orders").select(F.col("o_custkey").alias("src"), (F.col("o_orderkey") + 1000000).alias("dst"))
    return sinks.with_endpoints(v, e)


@query("SELECT 'broken' AS target, false AS ok, 0 AS n UNION ALL SELECT 'counts', true, count(*) FROM nation")
def fan_out_receipt(spark, sf):
    """A batch handed to two targets, one of which fails."""
    seen = {"n": 0}

    def broken(df):
        raise RuntimeError("no space")

    def counts(df):
        seen["n"] = df.count()

    receipt = sinks.fan_out(table(spark, sf, "nation"), {"broken": broken, "counts": counts})
    return spark.createDataFrame([(t, r == "ok", seen["n"] if r == "ok" else 0) for t, r in receipt.items()], "target string, ok boolean, n long")


_FLOW = "(SELECT n_regionkey AS src, 100 + n_nationkey AS dst, count(*) AS weight FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2)"


def _flow(spark, sf):
    n, c = table(spark, sf, "nation"), table(spark, sf, "customer")
    return n.join(c, n.n_nationkey == c.c_nationkey).groupBy(F.col("n_regionkey").alias("src"), (F.col("n_nationkey") + 100).alias("dst")).agg(F.count("*").alias("weight"))


@query(f"SELECT line FROM (SELECT unnest(['digraph g {{', '}}']) AS line UNION ALL SELECT '  \"' || src || '\" -> \"' || dst || '\";' FROM {_FLOW} UNION ALL SELECT unnest(['graph TD']) UNION ALL SELECT '  n' || src || ' --> n' || dst FROM {_FLOW})")
def graph_exports(spark, sf):
    """Lines of a graph's Graphviz and Mermaid texts (K9)."""
    e = _flow(spark, sf)
    return spark.createDataFrame([(x,) for x in (sinks.dot(e) + sinks.mermaid(e)).split("\n") if x], "line string")


@query(f"""WITH v AS (SELECT 100 + n_nationkey AS id, n_name AS label, count(*) AS weight FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2 UNION ALL SELECT r_regionkey, r_name, (SELECT count(*) FROM customer) FROM region),
    t AS (SELECT * FROM v ORDER BY weight DESC, id LIMIT 10), e AS (SELECT * FROM {_FLOW} ORDER BY weight DESC, src, dst LIMIT 12)
    SELECT 'graph TD' AS line UNION ALL SELECT '  n' || id || '["' || label || '"]' FROM t UNION ALL SELECT '  n' || src || ' -->|holds| n' || dst FROM e WHERE src IN (SELECT id FROM t) AND dst IN (SELECT id FROM t)""")
def graph_top_map(spark, sf):
    """The weightiest vertices and the links among them (K11); the bounds are the feature."""
    n, c = table(spark, sf, "nation"), table(spark, sf, "customer")
    v = n.join(c, n.n_nationkey == c.c_nationkey).groupBy((F.col("n_nationkey") + 100).cast("long").alias("id"), F.col("n_name").alias("label")).agg(F.count("*").alias("weight"))
    r = table(spark, sf, "region").select(F.col("r_regionkey").cast("long").alias("id"), F.col("r_name").alias("label"), c.select(F.count("*")).scalar().alias("weight"))
    text = sinks.graph_map(v.union(r), _flow(spark, sf).withColumn("kind", F.lit("holds")), 10, 12)
    return spark.createDataFrame([(x,) for x in text.split("\n") if x], "line string")


@query("SELECT n_nationkey AS id, n_name AS label, 'nation' AS kind, CAST(n_regionkey AS DOUBLE) AS weight FROM nation")
def learning_export_nodes(spark, sf):
    """Nodes of a graph exported for learning, read back."""
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("label"), F.lit("nation").alias("kind"), F.col("n_regionkey").cast("double").alias("weight"))
    path = shared_folder(spark)
    sinks.learning_export(n, _flow(spark, sf).withColumn("kind", F.lit("holds")), n.select("id", F.array("weight").alias("features")), path)
    return spark.read.schema("id int, label string, kind string, weight double").option("header", True).csv(f"{path}/nodes")


@query("""SELECT r_regionkey, sha256('{"r_name":"' || r_name || '","r_regionkey":' || r_regionkey || '}') AS sha FROM region""")
def export_manifest(spark, sf):
    """Digests that an export is verified against."""
    return sinks.content_manifest(table(spark, sf, "region"), "r_regionkey")


@query("SELECT count(DISTINCT sha256(fact_text)) FILTER (sha256(fact_text) NOT IN (SELECT sha256(fact_text) FROM global_facts WHERE modality = 'text' AND fact_text IS NOT NULL)) AS put, (SELECT count(DISTINCT sha256(text)) FROM documents WHERE doc_id % 2 = 0 AND text IS NOT NULL) AS got FROM global_facts WHERE fact_text IS NOT NULL")
def content_cache(spark, sf):
    """Contents a cache takes up, and those it gives out: altered ones stay inside."""
    f = table(spark, sf, "global_facts").filter("fact_text is not null").select(F.col("fact_text").alias("content"), "modality")
    empty = sinks.cache_put(f.select("content").limit(0).withColumn("hash", F.lit("")), f.filter("modality = 'text'").select("content"))
    put = sinks.cache_put(empty, f.select("content"))
    d = texts(spark, sf, "documents").filter("text is not null").select("doc_id", F.col("text").alias("content")).withColumn("hash", F.sha2("content", 256))
    stored = d.withColumn("content", F.when(F.col("doc_id") % 2 == 0, F.col("content")).otherwise(F.concat("content", F.lit("!"))))
    got = sinks.cache_get(stored, d.select("hash"))
    return put.agg(F.count("*").alias("put")).select("put", got.agg(F.count_distinct("hash")).scalar().alias("got"))


@query("""WITH RECURSIVE b AS (SELECT n_regionkey AS k, n_nationkey AS i, n_name AS body, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS s FROM nation),
    c AS (SELECT k, i, s, sha256('|' || body) AS h FROM b WHERE s = 1 UNION ALL SELECT b.k, b.i, b.s, sha256(c.h || '|' || b.body) FROM c JOIN b ON b.k = c.k AND b.s = c.s + 1) SELECT k, i, CAST(s AS INT) AS sequence, h AS entry_hash FROM c""")
def chained_append(spark, sf):
    """A verified log with the second half of its entries appended."""
    n = table(spark, sf, "nation").select(F.col("n_regionkey").alias("k"), F.col("n_nationkey").alias("i"), F.col("n_name").alias("body"))
    log = ev.chain(n.filter("i < 12"), ["k"], "i", "body")
    return sinks.append_chained(log, n.filter("i >= 12"), ["k"], "i", "body").select("k", "i", "sequence", "entry_hash")


_ESC = "replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


@query("""WITH l AS (SELECT doc_id, i, trim(regexp_replace(replace(x, chr(13), ' '), '\\s+', ' ', 'g'), ' ') AS x FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL AND regexp_full_match(text, '[\\x00-\\x7F]*')))
    SELECT doc_id, string_agg(x, chr(10) ORDER BY i) FILTER (x <> '') AS text, 1 AS links FROM l GROUP BY 1 HAVING count(*) FILTER (x <> '') > 0""")
def html_pages(spark, sf):
    """Plain texts set as HTML pages with a menu, and their text and links read back."""
    d = texts(spark, sf, "documents").filter(F.col("text").rlike(r"^[\x00-\x7F]*$"))
    safe = F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    body = F.concat(F.lit("<html><head><title>T</title></head><body><nav><a href='/home'>Home</a></nav><p>"), F.regexp_replace(safe, "\n", "</p>\n<p>"), F.lit("</p><a href='/next#x'></a></body></html>"))
    pages = html.pages(d.select("doc_id", body.alias("html"), F.lit("https://a.example/x/y").alias("url")), "doc_id")
    return pages.filter("text <> ''").select("doc_id", "text", F.size("links").alias("links"))


@query("SELECT doc_id, length(regexp_replace(repeat('A fact stands here. ', 20), ' $', '')) + CASE WHEN doc_id % 2 = 0 THEN 0 ELSE 3 END AS n_chars FROM documents")
def html_main_content(spark, sf):
    """Pages with link lists around one paragraph (P28, P30): lists go, a short plain box scores high enough to stay."""
    filler = F.lit("<div class='sidebar'><a href='/a'>One</a> <a href='/b'>Two</a></div>")
    body = F.concat(F.lit("<html><body><header>Site</header>"), filler, F.lit("<article><p>" + "A fact stands here. " * 20 + "</p></article>"), F.when(F.col("doc_id") % 2 == 0, filler).otherwise(F.lit("<div class='cookie-banner'>ok</div>")), F.lit("<footer>end</footer></body></html>"))
    pages = texts(spark, sf, "documents").select("doc_id", body.alias("html"), F.lit("https://a.example/").alias("url"))
    return html.main_content(pages, "doc_id").select("doc_id", F.length("text").cast("long").alias("n_chars"))


def _code(spark, sf):
    k, n = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    lines = [F.concat(F.lit("import m"), n), F.concat(F.lit("class C"), k, F.lit("(C"), (F.col("p_partkey") % 7).cast("string"), F.lit("):")), F.lit("    def run(self):"), F.concat(F.lit("        return helper_"), n, F.lit("(1)")), F.concat(F.lit("def helper_"), k, F.lit("(x):")), F.lit("    return x")]
    return code.entities(table(spark, sf, "part").select(F.concat(F.lit("m"), k, F.lit(".py")).alias("file"), F.concat_ws("\n", *lines).alias("text")))


@query("""SELECT 'm' || p_partkey || '.py' AS file, 'module' AS kind, 'm' || p_partkey AS name, 1 AS line FROM part UNION ALL SELECT 'm' || p_partkey || '.py', 'class', 'C' || p_partkey, 2 FROM part
    UNION ALL SELECT 'm' || p_partkey || '.py', 'method', 'run', 3 FROM part UNION ALL SELECT 'm' || p_partkey || '.py', 'function', 'helper_' || p_partkey, 5 FROM part""")
def code_entities(spark, sf):
    """Modules, classes, methods and functions of a file for each part."""
    return _code(spark, sf).select("file", "kind", "name", "line")


@query("""WITH f AS (SELECT p_partkey AS a, p_size AS b FROM part) SELECT DISTINCT 'm' || a || '.py' AS src, 'm' || b || '.py' AS dst, k AS kind FROM f CROSS JOIN (SELECT unnest(['import', 'call']) AS k) WHERE a <> b AND b IN (SELECT p_partkey FROM part)""")
def code_edges(spark, sf):
    """Imports and calls led to the files they mean."""
    e = _code(spark, sf)
    return code.import_edges(e).union(code.call_edges(e))


@query("""WITH p AS (SELECT p_partkey AS k, p_size AS n, 'm' || p_partkey || '.py:' AS f FROM part), h AS (SELECT k AS n, f || 'helper_' || k AS dst FROM p), c AS (SELECT k AS b, f || 'C' || k AS dst FROM p)
    SELECT kind, count(*) AS n, count(DISTINCT dst) AS ends FROM (SELECT 'contains' AS kind, f || 'm' || k AS src, f || 'C' || k AS dst FROM p UNION ALL SELECT 'contains', f || 'm' || k, f || 'C' || k || ':run' FROM p UNION ALL SELECT 'contains', f || 'm' || k, f || 'helper_' || k FROM p
    UNION ALL SELECT 'inherits', f || 'C' || k, dst FROM p JOIN c ON b = k % 7 AND b <> k UNION ALL SELECT 'calls', f || 'C' || k || ':run', dst FROM p JOIN h USING (n) UNION ALL SELECT 'imports', f || 'm' || k, 'm' || n FROM p) GROUP BY 1""")
def code_relations(spark, sf):
    """Relations among entities."""
    return code.relations(_code(spark, sf)).groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("dst").alias("ends"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'docx' WHEN 1 THEN 'zip' WHEN 2 THEN 'gzip' ELSE 'text' END AS format, CASE p_partkey % 4 WHEN 1 THEN p_name || chr(10) || chr(10) || p_type ELSE p_name END AS text FROM part")
def extracted_files(spark, sf):
    """Texts of office files, archives and plain files."""
    p = table(spark, sf, "part").select("p_partkey", "p_name", "p_type")

    def pack(batches):
        import gzip
        import io
        import zipfile

        def zipped(members):
            out = io.BytesIO()
            with zipfile.ZipFile(out, "w") as z:
                for n, t in members.items():
                    z.writestr(n, t)
            return out.getvalue()

        for pdf in batches:
            body = []
            for k, n, t in zip(pdf["p_partkey"], pdf["p_name"], pdf["p_type"], strict=True):
                doc = f"<w:document xmlns:w='w'><w:p><w:r><w:t>{n}</w:t></w:r></w:p></w:document>"
                body.append([zipped({"word/document.xml": doc}), zipped({"a.txt": n, "b.txt": t}), gzip.compress(n.encode()), n.encode()][k % 4])
            yield pdf[["p_partkey"]].assign(content=body)

    return extract.texts(p.mapInPandas(pack, "p_partkey long, content binary"), "p_partkey")


@query("SELECT md5(source_text || chr(31) || model_output) AS pair, CASE WHEN regexp_matches(trim(target_lang, ' '), '^[A-Za-z]{2}') THEN lower(regexp_extract(trim(target_lang, ' '), '^([A-Za-z]{2,3})', 1)) END AS target_lang, count(*) AS n FROM translation_feedback WHERE trim(source_text, ' ') <> '' AND trim(model_output, ' ') <> '' GROUP BY 1, 2")
def parallel_pairs(spark, sf):
    """Aligned pairs written as JSON lines and read as a corpus."""
    path = f"{shared_folder(spark)}/pairs.jsonl"
    t = table(spark, sf, "translation_feedback")
    sinks.jsonl(t.select("source_text", F.col("model_output").alias("target_text"), "target_lang"), path)
    c = readers.parallel_corpus(spark, path)
    return c.groupBy(F.md5(F.concat_ws("\x1f", "source_text", "target_text")).alias("pair"), "target_lang").agg(F.count("*").alias("n"))
