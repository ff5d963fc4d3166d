"""Lexicons, word lists, documents as JSON, training texts; tables of metrics and of features as files."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from colloquy.sources.documents import FORM


def lexicon(spark: SparkSession, path: str) -> DataFrame:
    """``word, parts`` of a CSV file without header: the first field and the others of each row.  Fields of a row that is
    shorter than the longest one end where the row does; of rows with one word the last in the file's order counts."""
    rows = spark.read.text(path).where("trim(value) <> ''").select(F.monotonically_increasing_id().alias("n"), F.from_csv("value", F.lit(", ".join(f"c{k} string" for k in range(64)))).alias("x"))
    fields = F.array(*[F.col(f"x.c{k}") for k in range(1, 64)])
    return rows.groupBy(F.col("x.c0").alias("word")).agg(F.max_by(F.array_compact(fields), "n").alias("parts"))


def wordlist(spark: SparkSession, path: str) -> DataFrame:
    """``original, main, lemma`` of a list of words: three fields by spaces a line, ``#`` begins a comment.  A list that is
    not there is empty."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], "original string, main string, lemma string")
    parts = F.split(F.trim("value"), " +")
    return spark.read.text(path).where("NOT trim(value) LIKE '#%'").select(parts.alias("x")).where("size(x) >= 3").select(*[F.col("x")[k].alias(c) for k, c in enumerate(("original", "main", "lemma"))])


DOCUMENT = f"""langs array<string>, pid string, media struct<name:string,type:string,url:string>,
content array<struct<tier:struct<lang:string,corpus:string,id:string,name:string,birthday:string,additional:array<string>>,content:array<{FORM}>,text:string,time:array<bigint>,translation:string>>"""


def json_documents(rows: DataFrame) -> DataFrame:
    """``doc_id, langs, pid, media, content, error`` of documents written as JSON (doc_id, text); one that does not fit the
    schema is an error of its row.  Without languages it is in English."""
    read = F.from_json("text", f"{DOCUMENT}, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    out = rows.withColumn("d", read)
    langs = F.when(F.size("d.langs") > 0, F.col("d.langs")).otherwise(F.array(F.lit("eng")))
    return out.select("doc_id", langs.alias("langs"), "d.pid", "d.media", "d.content", F.when(F.col("d").isNull() | F.col("d._bad").isNotNull(), "no document").alias("error"))


def json_lines(docs: DataFrame) -> DataFrame:
    """``doc_id, line_no, tier, text, start_ms, end_ms, forms`` of :func:`json_documents`."""
    rows = docs.select("doc_id", F.posexplode("content").alias("line_no", "u"))
    return rows.select("doc_id", F.col("line_no").cast("bigint").alias("line_no"), F.col("u.tier.id").alias("tier"), F.col("u.text").alias("text"), F.get("u.time", F.lit(0)).alias("start_ms"), F.get("u.time", F.lit(1)).alias("end_ms"), F.col("u.content").alias("forms"))


def training_lines(files: DataFrame) -> DataFrame:
    """``doc_id, line_no, text`` of what is said in transcripts (doc_id, text): main lines without bullets and codes, words
    alone, with the ending mark; lines without words go."""
    from colloquy.sources import chat, documents

    said = documents.utterances(chat.lines(files)).where("error IS NULL")
    return said.select("doc_id", "line_no", documents.stripped(F.col("forms")).alias("text")).where(r"text RLIKE '[\\p{L}\\p{N}]'")


def training_split(lines: DataFrame, share: float = 0.1) -> DataFrame:
    """``lines`` with ``part``: val for about ``share`` of the documents (by a hash of their ids), train for the others."""
    return lines.withColumn("part", F.when(F.pmod(F.xxhash64("doc_id"), F.lit(10_000)) < int(share * 10_000), "val").otherwise("train"))


def training_windows(lines: DataFrame, window: int, least: int = 1) -> DataFrame:
    """``doc_id, window, text``: texts of consecutive lines of a document, ``window`` places each of which 1 to ``window``
    lines are taken, as a hash of the place says; texts of fewer than ``least`` words go."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("line_no")) - 1
    rows = lines.withColumn("n", n).withColumns({"window": F.floor(F.col("n") / window), "k": F.pmod("n", F.lit(window))})
    rows = rows.where(F.col("k") <= F.pmod(F.xxhash64("doc_id", "window"), F.lit(window)))
    out = rows.groupBy("doc_id", "window").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), " ").alias("text"))
    return out.where(F.size(F.split(F.trim("text"), r"\s+")) >= least)


# --- sinks -----------------------------------------------------------------------------------------------------------


def metrics_table(rows: DataFrame, key: str, name: str, value: str, columns: Iterable[str] | None = None) -> DataFrame:
    """Metrics in long form (key, name, value) as one row a key, absent ones as empty strings.  ``columns`` gives the
    columns and their order; else they are the names that occur, sorted (a few hundred at most, as metrics go)."""
    names = list(columns) if columns is not None else sorted(r[0] for r in rows.select(name).distinct().collect())
    wide = rows.groupBy(key).pivot(name, names).agg(F.first(value))
    return wide.select(key, *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in names])


def write_csv(table: DataFrame, path: str) -> None:
    table.write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def write_texts(rows: DataFrame, path: str, **columns: Column) -> None:
    """One text file per document and extension: ``columns`` says what stands in each (``wer_txt`` is ``.wer.txt``)."""
    named = F.explode(F.array(*[F.struct(F.lit("." + n.replace("_", ".")).alias("extension"), F.regexp_replace(c.cast("string"), "\n$", "").alias("value")) for n, c in columns.items()]))
    out = rows.select(F.regexp_replace(F.col("doc_id").cast("string"), "[^A-Za-z0-9_.-]", "_").alias("doc_id"), named.alias("x")).select("doc_id", "x.*").where("value IS NOT NULL")
    out.repartition("doc_id").write.mode("overwrite").partitionBy("extension", "doc_id").text(path)


def features_long(rows: DataFrame, features: str) -> DataFrame:
    """Feature maps (doc_id, map of name and value) as rows ``doc_id, feature, value``, sorted by name within a document."""
    return rows.select("doc_id", F.explode(F.array_sort(F.map_entries(features))).alias("x")).select("doc_id", F.col("x.key").alias("feature"), F.col("x.value").alias("value"))
