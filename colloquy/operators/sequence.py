"""Operators on ordered rows: windows per document, so the documents of a corpus are independent of each other."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from colloquy.operators.files import small
from colloquy.schema import ENDING_PUNCT


def _repeated(words: list, n_max: int | None, n_min: int = 1) -> list[int]:
    """Places of ``words`` that a repetition right after covers."""
    codes: dict = {}
    w = np.array([codes.setdefault(x, len(codes)) for x in words], np.int64)
    marked = np.zeros(len(w), bool)
    for n in range(n_min, (len(w) // 2 if n_max is None else min(n_max, len(w) // 2)) + 1):
        same = w[n:] == w[:-n]
        if np.count_nonzero(same) >= n:
            edges = np.flatnonzero(np.diff(np.concatenate(([0], same.view(np.int8), [0]))))
            for begin, end in edges.reshape(-1, 2):
                if end - begin >= n:
                    marked[begin:end] = True
    return np.flatnonzero(marked).tolist()


def retraces(forms: DataFrame, n_max: int | None = None, n_min: int = 1) -> DataFrame:
    """Positions (doc_id, line_no, form_no) that a repetition right after makes a retrace: position p is one if for some
    n and b with b <= p < b + n the n tokens from b on equal the next n.

    For each n the places where a token equals the one n places on form runs; a run of n or more marks all of itself.
    An utterance of m tokens has no retrace longer than m / 2, so n goes up to there, or to ``n_max`` if that is less;
    this is done in Arrow batches, as rows for each token and n would grow with the square of an utterance.
    """

    @F.pandas_udf("array<int>")
    def places(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for lines in batches:
            yield pd.Series([_repeated(list(x), n_max, n_min) for x in lines], dtype=object)

    lines = forms.groupBy("doc_id", "line_no").agg(F.array_sort(F.collect_list(F.struct("form_no", F.lower("text").alias("w")))).alias("x"))
    found = lines.select("doc_id", "line_no", F.col("x.form_no").alias("no"), places(F.col("x.w")).alias("places"))
    return found.select("doc_id", "line_no", "no", F.explode("places").alias("k")).select("doc_id", "line_no", F.get("no", F.col("k")).alias("form_no"))


#: Languages in which a single word said twice is no retrace.
DOUBLING = ("yue", "zho")


def marked_retraces(forms: DataFrame, lang: str = "eng") -> DataFrame:
    """``forms`` with the type and text that retraces give them: words, punctuation and filled pauses take part; filled
    pauses keep their type, other marked forms are retraces and lose their punctuation."""
    from colloquy.schema import FP, MOR_PUNCT, PUNCT, REGULAR, RETRACE

    part = forms.where(F.col("type").isin(REGULAR, PUNCT, FP))
    found = retraces(part, n_min=2 if lang in DOUBLING else 1).withColumn("marked", F.lit(True))
    joined = forms.join(found, ["doc_id", "line_no", "form_no"], "left")
    marked = F.coalesce("marked", F.lit(False)) & (F.col("type") != FP)
    signs = "".join(m for m in [*MOR_PUNCT, *ENDING_PUNCT] if len(m) == 1)
    return joined.withColumns({"text": F.when(marked, F.translate("text", signs, "")).otherwise(F.col("text")), "type": F.when(marked, RETRACE).otherwise(F.col("type"))}).drop("marked")


def ordered(items: DataFrame) -> DataFrame:
    """``doc_id, ordered``: whether no item ends before it starts, or starts before the one before it ends.  Items without
    times are passed over; a document without timed items is in order."""
    timed = F.col("start_ms").isNotNull() & F.col("end_ms").isNotNull()
    w = Window.partitionBy("doc_id").orderBy("item_no").rowsBetween(Window.unboundedPreceding, -1)
    before = F.last(F.when(timed, F.col("end_ms")), ignorenulls=True).over(w)
    fine = (F.col("end_ms") >= F.col("start_ms")) & (F.col("start_ms") >= F.coalesce("before", F.lit(0)))
    return items.withColumn("before", before).groupBy("doc_id").agg(F.bool_and(F.when(timed, fine).otherwise(True)).alias("ordered"))


def repaired_times(items: DataFrame) -> DataFrame:
    """Starts moved up to the end of the item right before (its raw end, not the largest so far); ``ok`` is false where
    nothing is left of the span."""
    order = Window.partitionBy("doc_id").orderBy("start_ms", "item_no")
    start = F.greatest("start_ms", F.coalesce(F.lag("end_ms").over(order), F.lit(0)))
    return items.withColumn("new_start", start).withColumn("ok", F.col("end_ms") > F.col("new_start"))


def cleared_times(lines: DataFrame, forms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lines, forms) with repaired times: lines (doc_id, item_no, start_ms, end_ms) as :func:`repaired_times` moves them, a
    line of which nothing is left without times, and its words (doc_id, line_no, form_no, start_ms, end_ms) too; words
    that end before they begin lose theirs."""
    timed = lines.where("start_ms IS NOT NULL AND end_ms IS NOT NULL")
    moved = repaired_times(timed).select("doc_id", "item_no", F.when(F.col("ok"), F.col("new_start")).alias("s"), F.when(F.col("ok"), F.col("end_ms")).alias("e"), "ok")
    new = lines.join(moved.drop("ok"), ["doc_id", "item_no"], "left").drop("start_ms", "end_ms").withColumnsRenamed({"s": "start_ms", "e": "end_ms"})
    flags = moved.select("doc_id", F.col("item_no").alias("line_no"), "ok")
    good = F.coalesce("ok", F.lit(True)) & (F.col("end_ms") > F.col("start_ms"))
    words = forms.join(flags, ["doc_id", "line_no"], "left").withColumns({"s": F.when(good, F.col("start_ms")), "e": F.when(good, F.col("end_ms"))})
    return new, words.drop("start_ms", "end_ms", "ok").withColumnsRenamed({"s": "start_ms", "e": "end_ms"})


def word_ends(items: DataFrame, tail_ms: int = 500) -> DataFrame:
    """End = the next start, or ``tail_ms`` after the start where there is none; cut at the item's own end; null if empty."""
    order = Window.partitionBy("doc_id").orderBy("start_ms", "item_no")
    end = F.least(F.coalesce(F.lead("start_ms").over(order), F.col("start_ms") + tail_ms), "end_ms")
    return items.withColumn("new_end", F.when(end > F.col("start_ms"), end))


def max_span_groups(items: DataFrame, span_ms: int) -> DataFrame:
    """Group numbers per document: a new group starts with the item that ends more than ``span_ms`` after its group's
    start (the first group starts at 0).  A fold over each document's ordered items, in Arrow batches: two arrays of
    numbers for each document."""

    @F.pandas_udf("array<int>")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for starts, ends in batches:
            out = []
            for s, e in zip(starts, ends, strict=True):
                begin, group, own = 0, 0, []
                for x, y in zip(s.tolist(), e.tolist(), strict=True):
                    if y - begin > span_ms:
                        begin, group = x, group + 1
                    own.append(group)
                out.append(own)
            yield pd.Series(out, dtype=object)

    lists = items.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start_ms", "item_no", "end_ms"))).alias("x"))
    found = lists.select("doc_id", F.col("x.item_no").alias("item_no"), run("x.start_ms", "x.end_ms").alias("group"))
    return found.select("doc_id", F.explode(F.arrays_zip("item_no", "group")).alias("z")).select("doc_id", "z.item_no", "z.group")


def islands(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """Number of the run of equal ``key`` that a row stands in, per document, from 0."""
    w = Window.partitionBy("doc_id").orderBy(*order)
    change = F.coalesce((F.col(key) != F.lag(key).over(w)).cast("int"), F.lit(0))
    return rows.withColumn("change", change).withColumn("island", F.sum("change").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("change")


def punct_split(forms: DataFrame) -> DataFrame:
    """Utterance numbers within each line: an ending punctuation mark closes its utterance."""
    w = Window.partitionBy("doc_id", "line_no").orderBy("form_no").rowsBetween(Window.unboundedPreceding, -1)
    return forms.withColumn("utt", F.coalesce(F.sum(F.col("text").isin(ENDING_PUNCT).cast("int")).over(w), F.lit(0)))


def interpolated(items: DataFrame) -> DataFrame:
    """Missing times: from the end of the last timed item before to the start of the next one after."""
    w = Window.partitionBy("doc_id").orderBy("item_no")
    before = F.last("end_ms", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first("start_ms", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    return items.withColumns({"start_filled": F.coalesce("start_ms", before), "end_filled": F.coalesce("end_ms", after)})


def document_spans(items: DataFrame) -> DataFrame:
    """``doc_id, start_ms, end_ms``: the first start and the last end that are there, in the order of items; every
    document has a row, with nulls where no item is timed."""
    first, last = (F.when(F.col(c).isNotNull(), F.col("item_no")) for c in ("start_ms", "end_ms"))
    return items.groupBy("doc_id").agg(F.min_by("start_ms", first).alias("start_ms"), F.max_by("end_ms", last).alias("end_ms"))


def carried_short(pieces: DataFrame, least: int) -> DataFrame:
    """Pieces with fewer than ``least`` words join the next piece that has enough; trailing ones join the last that has
    (none if no piece has enough)."""
    w = Window.partitionBy("doc_id", "line_no").orderBy("piece")
    enough = F.when(F.col("n") >= least, F.col("piece"))
    ahead = F.first(enough, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    behind = F.last(enough, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return pieces.withColumn("target", F.coalesce(ahead, behind))


def glued_letters(forms: DataFrame) -> DataFrame:
    """Consecutive one-letter tokens as one: ``doc_id, line_no, first, text``."""
    w = Window.partitionBy("doc_id", "line_no").orderBy("form_no")
    single = F.length("text") == 1
    new = F.when(single & F.coalesce(F.lag(F.length("text")).over(w) == 1, F.lit(False)), 0).otherwise(1)
    grouped = forms.withColumn("new", new).withColumn("g", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("form_no", "text"))), lambda x: x["text"]), "")
    return grouped.groupBy("doc_id", "line_no", "g").agg(F.min("form_no").alias("first"), text.alias("text")).drop("g")


def merged_compounds(forms: DataFrame, pairs: DataFrame) -> DataFrame:
    """Adjacent words that form a listed pair, merged greedily from the left: ``doc_id, line_no, form_no, text``.  In a
    run of overlapping pairs every other one counts, from the first on."""
    w = Window.partitionBy("doc_id", "line_no").orderBy("form_no")
    hit = forms.withColumn("next", F.lead("text").over(w)).join(small(pairs), (F.lower("text") == F.col("left")) & (F.lower("next") == F.col("right")), "left")
    hit = hit.withColumn("pair", F.col("left").isNotNull())
    run = F.sum((~F.col("pair")).cast("int")).over(w)
    hit = hit.withColumn("run", run).withColumn("k", F.row_number().over(Window.partitionBy("doc_id", "line_no", "run", "pair").orderBy("form_no")))
    takes = F.col("pair") & (F.col("k") % 2 == 1)
    hit = hit.withColumn("takes", takes)
    hit = hit.withColumn("eaten", F.coalesce(F.lag("takes").over(w), F.lit(False)))
    return hit.where(~F.col("eaten")).select("doc_id", "line_no", "form_no", F.when(F.col("takes"), F.concat("text", "next")).otherwise(F.col("text")).alias("text"))


def nearest_segment(utts: DataFrame, segments: DataFrame) -> DataFrame:
    """Speaker of the last segment that ends no later than the utterance; the utterance's tier where none does.

    An as-of join by union: segments and utterances in one order, the last speaker before each utterance carried on.
    No pair of rows is formed, so it is one shuffle by document however many segments there are.
    """
    both = utts.select("doc_id", F.col("end_ms").alias("at"), F.lit(1).alias("kind"), "item_no", "tier", F.lit(None).cast("string").alias("speaker")).unionByName(
        segments.select("doc_id", F.col("end_ms").alias("at"), F.lit(0).alias("kind"), F.col("item_no"), F.lit(None).cast("string").alias("tier"), "speaker")
    )
    w = Window.partitionBy("doc_id").orderBy("at", "kind", "item_no").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("found", F.last("speaker", ignorenulls=True).over(w)).where("kind = 1").select("doc_id", "item_no", F.coalesce("found", "tier").alias("speaker"))
