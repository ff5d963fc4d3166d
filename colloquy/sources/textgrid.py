"""Praat TextGrid (long form): scan and sink, as column expressions on whole files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from colloquy.schema import ENDING_PUNCT, MOR_PUNCT

_ITEM = r'item \[\d+\]:'
_INTERVAL = r'xmin = ([\d.]+)\s+xmax = ([\d.]+)\s+text = "((?:[^"]|"")*)"'


#: What an interval of a file is: an utterance, or a word of a speaker's turn.
STYLES = ("utterance", "word")


def scan(spark: SparkSession, path: str, style: str = "utterance") -> DataFrame:
    """All ``.TextGrid`` files below ``path``: :func:`intervals`, or :func:`turns` where intervals are words."""
    if style not in STYLES:
        raise ValueError(f"style must be one of {STYLES}")
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.TextGrid").text(path, wholetext=True)
    found = intervals(files.select(F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("text")))
    return found if style == "utterance" else turns(found)


def turns(words: DataFrame) -> DataFrame:
    """``doc_id, turn, tier, start_ms, end_ms, n, words`` of timed words (doc_id, tier, start_ms, end_ms, text; of all tiers):
    in order of their starts the words of one tier up to where another one begins are a turn.  Ties go by end, tier and
    text."""
    order = Window.partitionBy("doc_id").orderBy("start_ms", "end_ms", "tier", "text")
    change = F.coalesce((F.col("tier") != F.lag("tier").over(order)).cast("int"), F.lit(0))
    rows = words.withColumn("change", change).withColumn("turn", F.sum("change").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    x = F.array_sort(F.collect_list(F.struct("start_ms", "end_ms", "text")))
    out = rows.groupBy("doc_id", "turn", "tier").agg(x.alias("words"))
    return out.select("doc_id", "turn", "tier", F.col("words")[0]["start_ms"].alias("start_ms"), F.array_max(F.transform("words", lambda w: w["end_ms"])).alias("end_ms"), F.size("words").alias("n"), "words")


def filled(items: DataFrame) -> DataFrame:
    """Items (doc_id, tier, item_no, start_ms, end_ms, text) as a file can hold them: without punctuation, and with the time
    from the end of the last timed item of their tier to the start of the next one where they have none; items that
    nothing gives a time go."""
    words = items.where(~F.trim("text").isin(ENDING_PUNCT + MOR_PUNCT))
    w = Window.partitionBy("doc_id", "tier").orderBy("item_no")
    before = F.coalesce(F.last("end_ms", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("bigint"))
    after = F.first("start_ms", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    out = words.withColumns({"s": F.coalesce("start_ms", before), "e": F.coalesce("end_ms", after)}).where("e > s")
    return out.withColumns({"start_ms": F.col("s"), "end_ms": F.col("e")}).drop("s", "e")


def intervals(files: DataFrame) -> DataFrame:
    """``doc_id, tier_no, tier, seq, start_ms, end_ms, text`` of all intervals that hold text."""
    parts = F.split("text", _ITEM)
    tiers = files.select("doc_id", F.posexplode(F.slice(parts, F.lit(2), F.size(parts))).alias("tier_no", "body"))
    tiers = tiers.withColumn("tier", F.regexp_extract("body", r'name = "((?:[^"]|"")*)"', 1))
    hits = tiers.select("doc_id", "tier_no", "tier", F.posexplode(F.regexp_extract_all("body", F.lit(_INTERVAL), F.lit(0))).alias("seq", "hit"))
    ms = lambda k: F.floor(F.regexp_extract("hit", _INTERVAL, k).cast("decimal(20,6)") * 1000).cast("bigint")
    return hits.select("doc_id", "tier_no", "tier", "seq", ms(1).alias("start_ms"), ms(2).alias("end_ms"), F.replace(F.regexp_extract("hit", _INTERVAL, 3), F.lit('""'), F.lit('"')).alias("text")).where("trim(text) <> ''")


def documents(items: DataFrame) -> DataFrame:
    """``doc_id, text``: TextGrid files of timed items (doc_id, tier, start_ms, end_ms, text)."""
    sec = lambda c: F.format_string("%d.%03d", (c / 1000).cast("bigint"), (c % 1000).cast("bigint"))
    per = items.groupBy("doc_id", "tier").agg(F.array_sort(F.collect_list(F.struct("start_ms", "end_ms", "text"))).alias("x"))
    one = lambda v, k: F.concat(F.lit("        intervals ["), (k + 1).cast("string"), F.lit("]:\n            xmin = "), sec(v["start_ms"]), F.lit("\n            xmax = "), sec(v["end_ms"]), F.lit('\n            text = "'), F.replace(v["text"], F.lit('"'), F.lit('""')), F.lit('"'))
    body = F.concat(F.lit('        class = "IntervalTier"\n        name = "'), F.replace("tier", F.lit('"'), F.lit('""')), F.lit('"\n        xmin = 0\n        xmax = '), sec(F.array_max(F.transform("x", lambda v: v["end_ms"]))), F.lit("\n        intervals: size = "), F.size("x").cast("string"), F.lit("\n"), F.array_join(F.transform("x", one), "\n"))
    docs = per.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("tier", body.alias("body"), F.array_max(F.transform("x", lambda v: v["end_ms"])).alias("end")))).alias("t"))
    items_ = F.transform("t", lambda v, k: F.concat(F.lit("    item ["), (k + 1).cast("string"), F.lit("]:\n"), v["body"]))
    return docs.select("doc_id", F.concat(F.lit('File type = "ooTextFile"\nObject class = "TextGrid"\n\nxmin = 0\nxmax = '), sec(F.array_max(F.transform("t", lambda v: v["end"]))), F.lit("\ntiers? <exists>\nsize = "), F.size("t").cast("string"), F.lit("\nitem []:\n"), F.array_join(items_, "\n"), F.lit("\n")).alias("text"))
