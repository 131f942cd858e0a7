"""Queries that write and read back, and streams that must agree with batches."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators.shared import shared_root
from textloom.operators.pairs import parts_of
from textloom.plans.registry import Tables, query
from textloom.sources import readers as R
from textloom.sources import writers as W
from textloom.streaming import replay


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/textloom/io-{name}-{uuid.uuid4().hex[:12]}"


@query("jsonl_round_trip", "SELECT doc_id, md5(text) AS digest FROM documents")
def jsonl_round_trip(t: Tables) -> DataFrame:
    path = _folder(t._spark, "jsonl")
    W.write_jsonl(t.documents.select("doc_id", "text"), path)
    return R.read_jsonl(t._spark, path, "doc_id long, text string").select("doc_id", F.md5("text").alias("digest"))


@query("jsonl_bad_lines", "SELECT count(*) AS n, count(*) FILTER (WHERE doc_id % 10 <> 0) AS good FROM documents")
def jsonl_bad_lines(t: Tables) -> DataFrame:
    path = _folder(t._spark, "bad")
    line = F.when(F.col("doc_id") % 10 == 0, F.lit("{broken")).otherwise(F.to_json(F.struct("doc_id", "text")))
    t.documents.select(line.alias("value")).write.text(path)
    return R.read_jsonl_keeping_bad(t._spark, path).agg(F.count(F.lit(1)).alias("n"), F.count_if("ok").alias("good"))


@query("sniff_lines", "SELECT count(*) AS n FROM conversations WHERE length(trim(replace(text, chr(10), ' '))) >= 6")
def sniff_lines(t: Tables) -> DataFrame:
    path = _folder(t._spark, "sniff")
    flat = F.replace("text", F.lit("\n"), F.lit(" "))
    value = F.when(F.col("turn") % 2 == 0, flat).otherwise(F.to_json(F.struct(flat.alias("sentence"))))
    t.conversations.select(value.alias("value")).write.text(path)
    return R.read_any_lines(t._spark, path).agg(F.count(F.lit(1)).alias("n"))


@query("word_scan", r"SELECT w AS word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[\p{L}]+')) AS w FROM benchmark) GROUP BY w")
def word_scan(t: Tables) -> DataFrame:
    path = _folder(t._spark, "words")
    t.benchmark.select("text").write.text(path)
    return R.read_words(t._spark, path).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


@query("paragraph_scan", "SELECT count(*) AS n FROM (SELECT unnest(string_split(text, chr(10))) AS p FROM conversations) WHERE trim(p) <> ''")
def paragraph_scan(t: Tables) -> DataFrame:
    path = _folder(t._spark, "paragraphs")
    t.conversations.select(F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("value")).write.option("lineSep", "\n\n").text(path)
    return R.read_paragraphs(t._spark, path).agg(F.count(F.lit(1)).alias("n"))


@query("wiki_dump", "SELECT page_id AS article_id, 'Title ' || page_id AS article_title, length(trim(regexp_replace(html, '<[^>]*>|&[a-z]+;', '', 'g'))) > 0 AS has_text FROM pages WHERE page_id % 7 <> 0")
def wiki_dump(t: Tables) -> DataFrame:
    path = _folder(t._spark, "wiki")
    plain = F.regexp_replace(F.regexp_replace("html", r"<[^>]*>|&[a-z]+;", " "), r"[^\p{L}\p{N} .,;]", " ")
    text = F.when(F.col("page_id") % 7 == 0, F.lit("#REDIRECT [[x]]")).otherwise(F.concat(F.lit("x "), plain))
    body = F.concat(F.lit("<page><title>Title "), "page_id", F.lit("</title><id>"), "page_id", F.lit("</id><revision><timestamp>2024-01-01T00:00:00Z</timestamp><text>"), text, F.lit("</text></revision></page>"))
    # A dump has one root element: each file here is one of a hundred pages at most.
    nth = F.floor(F.row_number().over(Window.partitionBy(F.col("page_id") % 64).orderBy("page_id")) / 100)
    dumps = t.pages.select(body.alias("b"), (F.col("page_id") % 64).alias("k"), nth.alias("j")).groupBy("k", "j").agg(F.array_join(F.collect_list("b"), "").alias("b"))
    whole = F.concat(F.lit("<mediawiki>"), "b", F.lit("</mediawiki>"))
    dumps.select(whole.alias("value")).write.option("compression", "bzip2").option("maxRecordsPerFile", 1).text(path)
    return R.read_wiki_dump(t._spark, path).select("article_id", "article_title", (F.length("text") > 2).alias("has_text"))


@query("route_files", "SELECT CASE WHEN CAST(substr(source, 4) AS INT) % 7 + 1 IN (1, 2, 3) THEN 'authoritative' WHEN CAST(substr(source, 4) AS INT) % 7 + 1 = 5 THEN 'literature' ELSE 'general' END AS category, count(*) AS n FROM documents GROUP BY 1")
def route_files(t: Tables) -> DataFrame:
    from textloom.plans.corpus_queries import tier_of

    path = _folder(t._spark, "routed")
    W.write_routed(t.documents, path, tier_of(F.col("source")))
    return t._spark.read.parquet(path).groupBy("category").agg(F.count(F.lit(1)).alias("n"))


@query("split_files", "SELECT CASE WHEN n_chars > 1000 THEN 'ok' ELSE 'failed' END AS status, count(*) AS n FROM documents GROUP BY 1")
def split_files(t: Tables) -> DataFrame:
    path = _folder(t._spark, "split")
    W.write_split(t.documents, path, F.col("n_chars") > 1000)
    return t._spark.read.parquet(path).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("counts_beside", "SELECT lang, count(*) AS n FROM documents GROUP BY lang")
def counts_beside(t: Tables) -> DataFrame:
    path = _folder(t._spark, "meta")
    W.write_with_counts(t.documents, path, ["lang"])
    return t._spark.read.schema("lang string, n long").json(f"{path}.meta")


@query("replace_sources", "SELECT source, count(*) AS n FROM documents GROUP BY source")
def replace_sources(t: Tables) -> DataFrame:
    path = _folder(t._spark, "sources")
    W.write_by_source(t.documents, path)
    W.write_by_source(t.documents.filter("source = 'src1'"), path)
    return t._spark.read.parquet(path).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("dictionary_scan", "SELECT p_type AS english, count(*) AS n FROM part GROUP BY p_type")
def dictionary_scan(t: Tables) -> DataFrame:
    path = _folder(t._spark, "dictionary")
    t.part.select(F.concat("p_type", F.lit("="), F.replace("p_name", F.lit(","), F.lit(" "))).alias("value")).write.text(path)
    return R.read_dictionary(t._spark, path).groupBy("english").agg(F.count(F.lit(1)).alias("n"))


def _files(rows: DataFrame, path: str, name: str, text: str) -> None:
    """One file for each row, ``name`` its folder, ending with the byte 1."""
    rows.select(F.col(name).cast("string").alias("name"), F.col(text).alias("value")).repartition(F.col("name")).write.partitionBy("name").option("maxRecordsPerFile", 1).option("lineSep", "\u0001").text(path)


@query("whole_texts", "SELECT item_id, md5(text) AS digest FROM benchmark")
def whole_texts(t: Tables) -> DataFrame:
    """Whole files, one for each item, read as they are."""
    path = _folder(t._spark, "files")
    _files(t.benchmark, path, "item_id", "text")
    rows = R.read_texts(t._spark, path)
    return rows.select(F.regexp_extract("path", "name=([0-9]+)", 1).cast("long").alias("item_id"), F.md5(F.rtrim(F.regexp_replace("text", "\u0001$", ""))).alias("digest"))


@query("texts_ignoring_errors", "SELECT item_id, length(text) AS n FROM benchmark")
def texts_ignoring_errors(t: Tables) -> DataFrame:
    """Bytes that are no UTF-8 are left out: every text has two of them put before it."""
    path = _folder(t._spark, "bytes")
    broken = F.concat(F.unhex(F.lit("E9DF")), F.encode("text", "UTF-8")).cast("string")
    _files(t.benchmark.select("item_id", broken.alias("text")), path, "item_id", "text")
    rows = R.read_texts_ignoring_errors(t._spark, f"{path}/*/*")
    text = F.regexp_replace("text", "\u0001$", "")
    return rows.select(F.regexp_extract("path", "name=([0-9]+)", 1).cast("long").alias("item_id"), F.length(text).cast("long").alias("n"))


@query("root_map_scan", "SELECT p_type AS root, count(*) AS n FROM part GROUP BY p_type")
def root_map_scan(t: Tables) -> DataFrame:
    """A JSON document {"roots": {root: {..}}}; its keys are the distinct types."""
    path = _folder(t._spark, "map")
    counts = t.part.groupBy("p_type").agg(F.count(F.lit(1)).cast("string").alias("n"))
    entry = F.map_from_entries(F.collect_list(F.struct("p_type", F.create_map(F.lit("n"), F.col("n")))))
    counts.agg(F.to_json(F.struct(entry.alias("roots"))).alias("value")).write.text(path)
    return R.read_root_map(t._spark, path).select("root", F.col("entry")["n"].cast("long").alias("n"))


@query("lexicon_scan", "SELECT root, p_brand AS en FROM (SELECT lower(p_name) AS root, p_brand, row_number() OVER (PARTITION BY lower(p_name) ORDER BY p_partkey) AS rk FROM part) WHERE rk = 1")
def lexicon_scan(t: Tables) -> DataFrame:
    """Lines root|fr|en|de|ru|pl; the first line of a root wins."""
    path = _folder(t._spark, "lexicon")
    line = F.concat_ws(" | ", "p_name", F.lit("x"), "p_brand", F.lit("y"), F.lit("z"), F.lit("w"))
    t.part.groupBy().agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", line.alias("l")))), lambda x: x["l"]), "\n").alias("value")).write.text(path)
    return R.read_lexicon(t._spark, path).select("root", F.col("translations")["en"].alias("en"))


@query("folder_scan", "SELECT source, count(*) AS n FROM documents WHERE source IN (SELECT DISTINCT source FROM documents ORDER BY source LIMIT 5) GROUP BY source")
def folder_scan(t: Tables) -> DataFrame:
    """The first files of a folder in the order of their names; the limit is the feature."""
    path = _folder(t._spark, "folder")
    jvm = t._spark._jvm.org.apache.hadoop.fs
    docs = t.documents.select("doc_id", "source")
    names = [r["source"] for r in docs.select("source").distinct().orderBy("source").limit(6).collect()]
    for name in names:
        docs.filter(F.col("source") == name).coalesce(1).write.json(f"{path}-parts/{name}")
    fs = jvm.Path(path).getFileSystem(t._spark._jsc.hadoopConfiguration())
    fs.mkdirs(jvm.Path(path))
    for name in names:
        part = [f.getPath() for f in fs.globStatus(jvm.Path(f"{path}-parts/{name}/part-*"))]
        fs.rename(part[0], jvm.Path(f"{path}/{name}.json"))
    return R.read_folder(t._spark, path, "doc_id long, source string", most_files=5).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("listed_scan", "SELECT 'lang=' || lang AS folder, CASE lang WHEN 'fr' THEN 0 ELSE 1 END AS nth, count(*) AS n FROM documents WHERE lang IN ('fr', 'de') GROUP BY lang")
def listed_scan(t: Tables) -> DataFrame:
    """Named sources in the order of the list; the others are not read."""
    path = _folder(t._spark, "listed")
    t.documents.select("lang", F.col("doc_id").cast("string").alias("value")).write.partitionBy("lang").text(path)
    folders = ["lang=fr", "lang=de"]
    rows = t._spark.read.option("basePath", path).text([f"{path}/{f}" for f in folders]).select("value", F.concat(F.lit("lang="), "lang").alias("folder"))
    order = F.create_map(*[F.lit(x) for i, n in enumerate(folders) for x in (n, i)])
    return rows.groupBy("folder", F.try_element_at(order, F.col("folder")).alias("nth")).agg(F.count(F.lit(1)).alias("n"))


@query("refuse_overwrite", "SELECT 1 AS refused, count(*) AS n FROM documents")
def refuse_overwrite(t: Tables) -> DataFrame:
    """A second write to an output that exists is an error, and the first one stays."""
    from pyspark.errors import AnalysisException

    path = _folder(t._spark, "refuse")
    W.write_jsonl(t.documents.select("doc_id"), path)
    try:
        W.write_jsonl(t.documents.select("doc_id"), path)
        refused = 0
    except AnalysisException:
        refused = 1
    return R.read_jsonl(t._spark, path, "doc_id long").agg(F.lit(refused).alias("refused"), F.count(F.lit(1)).alias("n"))


@query("word_dump", r"SELECT DISTINCT w FROM (SELECT unnest(regexp_extract_all(lower(text), '[\p{L}]+')) AS w FROM benchmark)")
def word_dump(t: Tables) -> DataFrame:
    path = _folder(t._spark, "dump")
    W.write_words(t.benchmark.select(F.explode(T.words(F.col("text"))).alias("w")).distinct(), path, "w")
    return t._spark.read.text(path).withColumnRenamed("value", "w")


@query("skip_present", "SELECT source, count(*) AS n, CASE source WHEN 'src1' THEN 'old' ELSE 'new' END AS batch FROM documents GROUP BY source")
def skip_present(t: Tables) -> DataFrame:
    """Sources that are there are left as they are."""
    path = _folder(t._spark, "present")
    W.write_missing_sources(t.documents.filter("source = 'src1'").withColumn("batch", F.lit("old")), path)
    W.write_missing_sources(t.documents.withColumn("batch", F.lit("new")), path)
    return t._spark.read.parquet(path).groupBy("source", "batch").agg(F.count(F.lit(1)).alias("n"))


@query("memory_lifecycle", "SELECT event_type AS memory_type, count(*) AS n, 0 AS left_ FROM events GROUP BY event_type")
def memory_lifecycle(t: Tables) -> DataFrame:
    """A memory table made, filled, counted by its partitions, and emptied."""
    path = _folder(t._spark, "memory")
    W.create_memory(t._spark, path)
    rows = t.events.select(F.concat(F.lit("LTM-"), F.lpad(F.col("event_id").cast("string"), 9, "0")).alias("entry_id"), F.col("event_type").alias("memory_type"), F.col("ts").alias("timestamp"), F.col("props").alias("text"))
    W.insert_memory(rows, path)
    counts = _folder(t._spark, "memory-counts")
    W.read_memory(t._spark, path).groupBy("memory_type").agg(F.count(F.lit(1)).alias("n")).write.parquet(counts)
    W.delete_memory(t._spark, path)
    left = W.read_memory(t._spark, path).agg(F.count(F.lit(1)).cast("int").alias("left_"))
    return t._spark.read.parquet(counts).join(F.broadcast(left), F.lit(True))  # one row


# ---- streams: each equals its batch


@query("stream_counts", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def stream_counts(t: Tables) -> DataFrame:
    base = _folder(t._spark, "stream")
    t.events.repartition(4).write.parquet(f"{base}/in")
    replay.run_counts(replay.stream_parquet(t._spark, f"{base}/in", t.events.schema, 1), ["event_type"], f"{base}/out", f"{base}/cp")
    return t._spark.read.parquet(f"{base}/out")


@query("stream_dedup", "SELECT md5(text) AS digest, length(text) AS n FROM documents GROUP BY text")
def stream_dedup(t: Tables) -> DataFrame:
    base = _folder(t._spark, "dedup")
    docs = t.documents.select("doc_id", "text")
    n = 3 * -(-parts_of(docs) // 3)  # files, so that three triggers have many each
    docs.repartition(n).write.parquet(f"{base}/in")
    replay.run_available(replay.first_copies(replay.stream_parquet(t._spark, f"{base}/in", docs.schema, n // 3)), f"{base}/out", f"{base}/cp")
    return t._spark.read.parquet(f"{base}/out").select(F.md5("text").alias("digest"), F.length("text").cast("long").alias("n"))


@query("stream_phases", "SELECT 0 AS phase, count(*) AS n FROM benchmark UNION ALL SELECT 1, count(*) FROM documents")
def stream_phases(t: Tables) -> DataFrame:
    """Two triggers in order into one table: the authoritative phase first."""
    base = _folder(t._spark, "phases")
    for phase, df in enumerate((t.benchmark.select("text"), t.documents.select("text"))):
        df.write.parquet(f"{base}/in{phase}")
        # A streaming sink keeps a log of its own, so each phase has a folder of the table.
        replay.run_available(replay.stream_parquet(t._spark, f"{base}/in{phase}", df.schema), f"{base}/out/phase={phase}", f"{base}/cp{phase}")
    return t._spark.read.parquet(f"{base}/out").groupBy("phase").agg(F.count(F.lit(1)).alias("n"))


@query("stream_unknown_roots", r"""SELECT w AS word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[\p{L}]+')) AS w FROM conversations)
WHERE w NOT IN (SELECT unnest(regexp_extract_all(lower(text), '[\p{L}]+')) FROM benchmark) GROUP BY w""")
def stream_unknown_roots(t: Tables) -> DataFrame:
    base = _folder(t._spark, "unknown")
    words = t.conversations.select(F.explode(T.words(F.col("text"))).alias("word"), F.lit("2024-01-01").cast("timestamp").alias("ts"), F.left("text", F.lit(40)).alias("context"))
    words.write.parquet(f"{base}/in")
    lexicon = t.benchmark.select(F.explode(T.words(F.col("text"))).alias("word")).distinct()
    counts = replay.unknown_roots(replay.stream_parquet(t._spark, f"{base}/in", words.schema), lexicon)

    def replace(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out")

    counts.writeStream.outputMode("complete").foreachBatch(replace).option("checkpointLocation", f"{base}/cp").trigger(availableNow=True).start().awaitTermination()
    return t._spark.read.parquet(f"{base}/out").select("word", "n")


@query("event_windows", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY 1, 2")
def event_windows(t: Tables) -> DataFrame:
    return replay.event_windows(t.events).withColumn("value", F.round("value", 4))
