"""Sources: JSON lines, plain text, markup dumps, lexicons, partitioned folders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CORPUS_SCHEMA = "text string, sentence string, original_text string, source string, source_name string, paragraph int, line int, word_count int, parse_rate double"


def read_jsonl(spark: SparkSession, path: str, schema: str = CORPUS_SCHEMA) -> DataFrame:
    """Rows of JSON lines; lines that are no JSON are left out. The text field goes by three names."""
    # Parsed from text lines: the JSON source itself can't be asked for nothing but whether a line is bad, as a count would.
    parsed = F.from_json("value", schema + ", _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    rows = spark.read.text(path).filter(F.ltrim("value").startswith("{")).select(parsed.alias("row")).filter("row is not null and row._corrupt_record is null")
    rows = rows.select("row.*").drop("_corrupt_record")
    names = [c for c in ("text", "sentence", "original_text") if c in rows.columns]
    return rows.withColumn("text", F.coalesce(*names)) if names else rows


def read_jsonl_keeping_bad(spark: SparkSession, path: str, schema: str = CORPUS_SCHEMA) -> DataFrame:
    """(value, ok, row): every line, with its parsed row where it is JSON."""
    lines = spark.read.text(path)
    ok = F.expr("try_parse_json(value)").isNotNull() & F.ltrim("value").startswith("{")
    return lines.select("value", ok.alias("ok"), F.when(ok, F.from_json("value", schema)).alias("row"))


def read_any_lines(spark: SparkSession, path: str, shortest: int = 6) -> DataFrame:
    """text of each line, whether it is JSON with a text field or plain; lines under six characters go."""
    lines = spark.read.text(path)
    text = F.coalesce(*[F.get_json_object("value", f"$.{f}") for f in ("text", "sentence", "original_text")])
    is_json = F.ltrim("value").startswith("{") & F.expr("try_parse_json(value)").isNotNull()
    return lines.select(F.trim(F.when(is_json, text).otherwise(F.col("value"))).alias("text")).filter(F.length("text") >= shortest)


def decode(content: Column) -> Column:
    """UTF-8 where it is valid, else Latin-1."""
    return F.coalesce(F.try_validate_utf8(content.cast("string")), F.decode(content, "ISO-8859-1"))


def read_texts(spark: SparkSession, path: str, glob: str = "*.txt") -> DataFrame:
    """(path, text) of whole files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.select("path", decode(F.col("content")).alias("text"))


def read_texts_ignoring_errors(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) with invalid bytes left out."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.replace(F.make_valid_utf8(F.col("content").cast("string")), F.lit("�"), F.lit("")).alias("text"))


def read_paragraphs(spark: SparkSession, path: str) -> DataFrame:
    """One paragraph a row, of files of any size: the blank line is the record separator."""
    rows = spark.read.option("lineSep", "\n\n").text(path)
    return rows.select(F.col("_metadata.file_name").alias("file"), F.trim(F.regexp_replace("value", r"\s*\n\s*", " ")).alias("text")).filter("text <> ''")


def read_words(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.explode(F.regexp_extract_all(F.lower("value"), F.lit(r"[\p{L}]+"), F.lit(0))).alias("word"))


def read_wiki_dump(spark: SparkSession, path: str) -> DataFrame:
    """article_title, article_id, timestamp, text of a (compressed) page dump; redirects and empty pages go."""
    schema = "title string, id long, revision struct<timestamp:string, text:string>"
    pages = spark.read.format("xml").option("rowTag", "page").schema(schema).load(path)
    rows = pages.select(F.col("title").alias("article_title"), F.col("id").alias("article_id"), F.try_to_timestamp(F.col("revision.timestamp")).alias("timestamp"), F.col("revision.text").alias("text"))
    return rows.filter(F.col("text").isNotNull() & F.col("article_id").isNotNull() & ~F.upper(F.ltrim("text")).startswith("#REDIRECT"))


def read_relations(spark: SparkSession, url: str, table: str, kind: str | None = None) -> DataFrame:
    """Rows of a lexicon database; the kind is filtered in the database."""
    rows = spark.read.format("jdbc").option("url", url).option("dbtable", table).load()
    return rows if kind is None else rows.filter(F.col("tip") == kind)


def read_root_map(spark: SparkSession, path: str, value: str = "map<string,string>") -> DataFrame:
    """(root, entry) of a JSON document {"roots": {root: {..}}}."""
    rows = spark.read.option("multiLine", "true").schema(f"roots map<string,{value}>").json(path)
    return rows.select(F.explode("roots").alias("root", "entry"))


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(english, word) of lines english=word, word."""
    parts = F.split("value", "=", 2)
    rows = spark.read.text(path).filter(F.col("value").contains("=")).select(F.trim(F.get(parts, F.lit(0))).alias("english"), F.get(parts, F.lit(1)).alias("rhs"))
    return rows.select("english", F.explode(F.split("rhs", "[,;]")).alias("word")).select("english", F.trim("word").alias("word")).filter("word <> ''")


LANGUAGES = ("fr", "en", "de", "ru", "pl")


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """(root, translations, line): lines of a root and five translations parted by bars; first line of a root wins."""
    from textloom.operators.corpus import first_of

    rows = spark.read.option("wholetext", "true").text(path).select(F.posexplode(F.split("value", "\n")).alias("line", "value"))
    parts = F.transform(F.split("value", r"\|"), lambda x: F.trim(x))
    rows = rows.withColumn("p", parts).filter(F.size("p") >= 5)
    made = rows.select(F.lower(F.get("p", F.lit(0))).alias("root"), F.map_from_arrays(F.array(*map(F.lit, LANGUAGES)), F.slice(F.concat("p", F.array(F.lit(None).cast("string"))), 2, 5)).alias("translations"), "line")
    return first_of(made, ["root"], ["line"])


def read_folder(spark: SparkSession, path: str, schema: str, most_files: int | None = None) -> DataFrame:
    """JSON files of a folder with their names, in the order of names; at most the first ``most_files``."""
    rows = spark.read.schema(schema).json(path).select("*", F.col("_metadata.file_name").alias("file"))
    if most_files is None:
        return rows
    names = rows.select("file").distinct().orderBy("file").limit(most_files)
    return rows.join(F.broadcast(names), "file", "left_semi")  # at most most_files rows


def read_listed(spark: SparkSession, path: str, names: Sequence[str]) -> DataFrame:
    """(file, order, line): lines of the named files, in the order of the list."""
    order = F.create_map(*[F.lit(x) for i, n in enumerate(names) for x in (n, i)])
    rows = spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("line"))
    return rows.filter(F.col("file").isin(*names)).withColumn("order", F.try_element_at(order, F.col("file")))


def missing_files(spark: SparkSession, path: str, names: Sequence[str]) -> DataFrame:
    listed = spark.createDataFrame([(n,) for n in names], "file string")
    return listed.join(spark.read.text(path).select(F.col("_metadata.file_name").alias("file")).distinct(), "file", "left_anti")


def attach_vectors(metadata: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    """Metadata and vector in one row, by key instead of by position."""
    return metadata.join(vectors, key)
