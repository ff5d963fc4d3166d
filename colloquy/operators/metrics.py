"""Aggregates: transcript comparison, segmentation, overlaps, votes, medians."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def compare(tokens: DataFrame, *by: str) -> DataFrame:
    """Counts by status (match, extra_main, extra_gold) and the rates, unrounded; punctuation does not count."""
    c = lambda s: F.count_if(F.col("status") == s)
    out = tokens.where("pos <> 'PUNCT'").groupBy(*by).agg(c("match").alias("matches"), c("extra_main").alias("insertions"), c("extra_gold").alias("deletions"))
    gold = F.col("matches") + F.col("deletions")
    wer = F.when(gold > 0, (F.col("insertions") + F.col("deletions")) / gold).otherwise(0.0)
    return out.withColumns({"total": gold, "wer": wer, "accuracy": 1 - wer})


def segmentation(rows: DataFrame, gold: str, found: str) -> DataFrame:
    """True and false boundaries, precision, recall and F1 of two boolean columns."""
    g, f = F.col(gold), F.col(found)
    out = rows.agg(F.count_if(g & f).alias("tp"), F.count_if(~g & f).alias("fp"), F.count_if(g & ~f).alias("fn"), F.count_if(~g & ~f).alias("tn"))
    div = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return out.withColumns({"acc": div(tp + tn, tp + tn + fp + fn), "prec": div(tp, tp + fp), "rec": div(tp, tp + fn), "f1": div(2 * tp, 2 * tp + fp + fn)})


def overlap(a: DataFrame, b: DataFrame, keys: list[str], token: str) -> DataFrame:
    """Multiset overlap of two bags of tokens per key."""
    n = a.groupBy(*keys, token).agg(F.count(F.lit(1)).alias("n"))
    m = b.groupBy(*keys, token).agg(F.count(F.lit(1)).alias("m"))
    return n.join(m, [*keys, token]).groupBy(*keys).agg(F.sum(F.least("n", "m")).alias("overlap"))


def majority(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The most frequent value per key, the smallest of equally frequent ones."""
    n = rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(*keys).agg(F.min_by(value, F.struct(-F.col("n"), F.col(value))).alias(value), F.max("n").alias("votes"))


#: Ranges of values that a median is looked for in.
RANGES = 1024


def upper_median(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The element at index n // 2 of the sorted values, never interpolated; and ``n``, how many there are.  Nulls don't
    count.

    Values of a key are counted by RANGES ranges between its least and its largest one, then only the range that holds
    the element is sorted: no task gets all values of a key."""
    rows = rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("v"))
    ends = rows.groupBy(*keys).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count(F.lit(1)).alias("n"))
    place = F.when(F.col("hi") > F.col("lo"), F.floor((F.col("v") - F.col("lo")).cast("double") / (F.col("hi") - F.col("lo")).cast("double") * (RANGES - 1))).otherwise(0).cast("int")
    ranged = rows.join(ends, keys).withColumn("place", place)
    counts = ranged.groupBy(*keys, "n", "place").agg(F.count(F.lit(1)).alias("m"))
    before = F.sum("m").over(Window.partitionBy(*keys).orderBy("place")) - F.col("m")
    target = F.floor(F.col("n") / 2)
    held = counts.withColumn("before", before).where((F.col("before") <= target) & (target < F.col("before") + F.col("m"))).select(*keys, "place", "before")
    own = ranged.join(held, [*keys, "place"]).groupBy(*keys, "n", "before", "v").agg(F.count(F.lit(1)).alias("m"))
    upto = F.col("before") + F.sum("m").over(Window.partitionBy(*keys).orderBy("v"))
    return own.withColumn("upto", upto).where((F.col("upto") - F.col("m") <= target) & (target < F.col("upto"))).select(*keys, F.col("v").alias("median"), "n")


def best(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row per key in the given order."""
    return rows.withColumn("k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("k = 1").drop("k")
