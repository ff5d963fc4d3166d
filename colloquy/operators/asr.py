"""Recognised speech made into utterances: compounds, times, numbers, chunks, utterance ends, speakers' turns.

A recognised document is rows of elements (doc_id, turn_no, elem_no, speaker, value, ts, end_ts in seconds), whatever
engine they come from.  Everything is column expressions and windows within a turn; numbers and a given splitter of
utterances run in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from colloquy.functions.numbers import spelled_numbers
from colloquy.operators.files import small
from colloquy.schema import ENDING_PUNCT, MOR_PUNCT

# Marks of Arabic script, and what they are written as.
FOREIGN = {"؟": "?", "۔": ".", "،": ",", "؛": ";"}
#: Words of a turn that make one chunk.
CHUNK = 300
_TURN = ["doc_id", "turn_no"]


def merged(elements: DataFrame, pairs: DataFrame) -> DataFrame:
    """Adjacent elements that form a listed compound (left, right), merged greedily from the left: from the first one's
    start to the second one's end."""
    w = Window.partitionBy(*_TURN).orderBy("elem_no")
    listed = small(pairs.select(F.col("left").alias("l"), F.col("right").alias("r")).distinct())
    hit = elements.withColumns({"next": F.lead("value").over(w), "next_end": F.lead("end_ts").over(w)}).join(listed, (F.col("value") == F.col("l")) & (F.col("next") == F.col("r")), "left")
    hit = hit.withColumn("pair", F.col("l").isNotNull())
    hit = hit.withColumn("run", F.sum((~F.col("pair")).cast("int")).over(w))
    # in a run of overlapping pairs every other one counts, from the first on
    hit = hit.withColumn("takes", F.col("pair") & (F.row_number().over(Window.partitionBy(*_TURN, "run", "pair").orderBy("elem_no")) % 2 == 1))
    hit = hit.withColumn("eaten", F.coalesce(F.lag("takes").over(w), F.lit(False))).where("NOT eaten")
    joined = hit.withColumns({"value": F.when(F.col("takes"), F.concat("value", "next")).otherwise(F.col("value")), "end_ts": F.when(F.col("takes"), F.col("next_end")).otherwise(F.col("end_ts"))})
    return joined.select(elements.columns)


def words(elements: DataFrame) -> DataFrame:
    """``doc_id, turn_no, speaker, word_no, word, start_ms, end_ms``: elements without blanks and ``<tags>``, times in
    half-even milliseconds; a word that begins with a dash joins the one before it, a value of several words gets equal
    floor slices of its time."""
    w = Window.partitionBy(*_TURN).orderBy("elem_no")
    ms = lambda c: F.bround(F.col(c) * 1000, 0).cast("bigint")
    kept = elements.where("value IS NOT NULL AND trim(value) <> '' AND NOT value RLIKE '^<.*>'").withColumns({"value": F.trim("value"), "b": ms("ts"), "e": ms("end_ts")})
    first = F.row_number().over(w) == 1
    kept = kept.withColumn("joins", F.col("value").startswith("-") & ~first)
    kept = kept.withColumn("g", F.sum((~F.col("joins")).cast("int")).over(w))
    x = F.array_sort(F.collect_list(F.struct("elem_no", "value", "b", "e")))
    one = kept.groupBy(*_TURN, "g").agg(F.first("speaker").alias("speaker"), x.alias("x"))
    one = one.withColumns({"parts": F.split(F.array_join(F.transform("x", lambda v: v["value"]), ""), " "), "b": F.col("x")[0]["b"], "e": F.element_at("x", -1)["e"]})
    step = F.floor((F.col("e") - F.col("b")) / F.size("parts"))
    several = F.size("parts") > 1
    out = one.withColumn("step", step).select(*_TURN, "speaker", "g", "b", "e", "step", several.alias("several"), F.posexplode("parts").alias("k", "word"))
    start, end = F.col("b") + F.col("k") * F.col("step"), F.col("b") + (F.col("k") + 1) * F.col("step")
    out = out.withColumns({"start_ms": F.when(F.col("several"), start).otherwise(F.col("b")), "end_ms": F.when(F.col("several"), end).otherwise(F.col("e"))})
    return out.withColumn("word_no", F.row_number().over(Window.partitionBy(*_TURN).orderBy("g", "k")) - 1).select(*_TURN, "speaker", "word_no", "word", "start_ms", "end_ms")


def chunked(rows: DataFrame, size: int = CHUNK) -> DataFrame:
    """``chunk``: the words of a turn in runs of ``size``."""
    return rows.withColumn("chunk", F.floor(F.col("word_no") / size))


def _ends(word: Column) -> Column:
    return word.isin(*ENDING_PUNCT, *FOREIGN)


def retokenized(rows: DataFrame) -> DataFrame:
    """``utt, form_no`` within each chunk: an ending mark, or a word with one at its end (split off, without times), closes
    its utterance; what is left at the end of a chunk loses a trailing comma and gets a full stop."""
    marks = "".join([*"?!.", *FOREIGN])
    word = F.translate(F.replace("word", F.lit("。"), F.lit(".")), "¿¡", "  ")
    rows = rows.withColumn("word", F.trim(word)).where("word <> ''")
    suffixed = F.col("word").rlike(f"[{marks}]$") & ~_ends(F.col("word"))
    null = F.lit(None).cast("bigint")
    cell = lambda t, s, e: F.struct(t.alias("text"), s.alias("start_ms"), e.alias("end_ms"))
    whole = cell(F.col("word"), F.col("start_ms"), F.col("end_ms"))
    head, tail = cell(F.expr("substring(word, 1, length(word) - 1)"), F.col("start_ms"), F.col("end_ms")), cell(F.substring("word", -1, 1), null, null)
    keys = [*_TURN, "speaker", "chunk"]
    parts = rows.select(*keys, "word_no", F.posexplode(F.when(suffixed, F.array(head, tail)).otherwise(F.array(whole))).alias("part", "x")).select(*keys, "word_no", "part", "x.*")
    w = Window.partitionBy(*keys).orderBy("word_no", "part")
    closed = F.sum(_ends(F.col("text")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.withColumn("utt", F.coalesce(closed, F.lit(0)))
    lists = parts.groupBy(*keys, "utt").agg(F.array_sort(F.collect_list(F.struct("word_no", "part", "text", "start_ms", "end_ms"))).alias("x"))
    last = F.element_at("x", -1)["text"]
    cut = F.when(last.isin(MOR_PUNCT), F.slice("x", F.lit(1), F.size("x") - 1)).otherwise(F.col("x"))
    plain = lambda c: F.transform(c, lambda v: cell(v["text"], v["start_ms"], v["end_ms"]))
    full = F.when(_ends(last), plain(F.col("x"))).otherwise(F.concat(plain(cut), F.array(cell(F.lit("."), null, null))))
    return lists.select(*keys, "utt", F.posexplode(full).alias("form_no", "x")).select(*keys, "utt", "form_no", "x.*")


def split_by_engine(rows: DataFrame, engine: Callable[[], Callable[[str], list[str]]]) -> DataFrame:
    """Like :func:`retokenized`, with utterances that a splitter names: it gets the chunk's words in lower case without
    punctuation, in one string, and returns strings of words; words and times are matched by their running number.
    ``engine`` is called once per task and returns the splitter."""
    keys = [*_TURN, "speaker", "chunk"]
    marks = "".join({c for m in [*MOR_PUNCT, *ENDING_PUNCT, *FOREIGN] for c in m})
    bare = rows.withColumn("word", F.lower(F.btrim(F.col("word"), F.lit(marks)))).where("trim(word) <> ''")
    chunks = bare.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("word_no", "word", "start_ms", "end_ms"))).alias("x"))

    @F.pandas_udf("array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        split = engine()
        for texts in batches:
            yield pd.Series([list(split(t)) for t in texts], dtype=object)

    joined = F.array_join(F.transform("x", lambda v: v["word"]), " ")
    parts = chunks.withColumn("parts", run(joined)).select(*keys, "x", F.posexplode("parts").alias("utt", "piece"))
    ended = F.substring("piece", -1, 1).isin("?", "!", ".", *FOREIGN)
    parts = parts.withColumns({"delim": F.when(ended, F.substring("piece", -1, 1)).otherwise("."), "own": F.split(F.trim(F.when(ended, F.expr("substring(piece, 1, length(piece) - 1)")).otherwise(F.col("piece"))), " +")})
    before = F.coalesce(F.sum(F.size("own")).over(Window.partitionBy(*keys).orderBy("utt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.withColumn("before", before.cast("int"))
    null = F.lit(None).cast("bigint")
    timed = F.transform("own", lambda t, k: F.struct(t.alias("text"), F.get("x", F.col("before") + k)["start_ms"].alias("start_ms"), F.get("x", F.col("before") + k)["end_ms"].alias("end_ms")))
    full = F.concat(timed, F.array(F.struct(F.col("delim").alias("text"), null.alias("start_ms"), null.alias("end_ms"))))
    return parts.select(*keys, "utt", F.posexplode(full).alias("form_no", "x")).select(*keys, "utt", "form_no", "x.*")


def forms(rows: DataFrame) -> DataFrame:
    """Utterances' words as forms: marks of other scripts as ASCII, punctuation out of words, punctuation without times;
    ``doc_id, turn_no, chunk, utt, tier, form_no, text, type, start_ms, end_ms``."""
    from colloquy.schema import PUNCT, REGULAR

    mark = F.col("text").isin(*ENDING_PUNCT, *MOR_PUNCT, *FOREIGN)
    bare = F.col("text")
    for m in [*ENDING_PUNCT, *MOR_PUNCT, *FOREIGN]:
        bare = F.replace(bare, F.lit(m), F.lit(""))
    text = F.when(mark, F.translate("text", "".join(FOREIGN), "".join(FOREIGN.values()))).otherwise(bare)
    timed = ~mark & F.col("start_ms").isNotNull() & F.col("end_ms").isNotNull()
    out = rows.select(*_TURN, "chunk", "utt", F.concat(F.lit("PAR"), F.col("speaker").cast("string")).alias("tier"), "form_no", text.alias("text"), F.when(mark, PUNCT).otherwise(REGULAR).alias("type"), *[F.when(timed, F.col(c)).alias(c) for c in ("start_ms", "end_ms")])
    return out.where("text <> ''")


def process(elements: DataFrame, *, lang: str = "eng", compounds: DataFrame | None = None, table: list[tuple[str, str]] = (), engine: Callable[[], Callable[[str], list[str]]] | None = None) -> DataFrame:
    """The whole chain: compounds, words, numbers in ``lang``, chunks, utterances by punctuation or by ``engine``, forms."""
    rows = words(merged(elements, compounds) if compounds is not None else elements)
    rows = chunked(rows.withColumn("word", spelled_numbers(F.col("word"), lang, table)))
    return forms(split_by_engine(rows, engine) if engine else retokenized(rows))


# --- other shapes of recognised speech --------------------------------------------------------------------------------


def swept(words_: DataFrame, segments: DataFrame) -> DataFrame:
    """Turns of one speaker each out of recognised words (doc_id, word_no, word, start_ms, end_ms) and speaker segments
    (doc_id, speaker, start_ms): in order of their starts a word belongs to the last segment that began (the first one
    before any has), punctuation at its edges stands apart without times, words without length and ``…`` go, and a turn
    ends where the speaker changes.  ``doc_id, turn_no, speaker, elem_no, value, start_ms, end_ms``."""
    null = F.lit(None)
    both = words_.select("doc_id", "start_ms", F.lit(1).alias("kind"), "word_no", "word", "end_ms", null.cast("string").alias("speaker")).unionByName(
        segments.select("doc_id", "start_ms", F.lit(0).alias("kind"), null.cast("bigint").alias("word_no"), null.cast("string").alias("word"), null.cast("bigint").alias("end_ms"), F.col("speaker").cast("string").alias("speaker"))
    )
    order = Window.partitionBy("doc_id").orderBy("start_ms", "kind", "word_no")
    said = F.coalesce(F.last("speaker", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)), F.first("speaker", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    rows = both.withColumn("speaker", said).where("kind = 1 AND end_ms > start_ms AND trim(word) NOT IN ('', '…')").withColumn("word", F.trim("word"))
    cut = F.filter(F.array(F.regexp_extract("word", r"^([.,!?…]*)", 1), F.regexp_extract("word", r"^[.,!?…]*(.*?)[.,!?…]*$", 1), F.when(F.col("word").rlike(r"^[.,!?…]+$"), "").otherwise(F.regexp_extract("word", r"([.,!?…]*)$", 1))), lambda x: (x != "") & (x != "…"))
    rows = rows.select("doc_id", "speaker", "start_ms", "end_ms", "word_no", F.posexplode(cut).alias("part", "value"))
    w = Window.partitionBy("doc_id").orderBy("start_ms", "word_no", "part")
    change = F.coalesce((F.col("speaker") != F.lag("speaker").over(w)).cast("int"), F.lit(0))
    rows = rows.withColumn("change", change).withColumn("turn_no", F.sum("change").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    mark = F.col("value").rlike(r"^[.,!?…]+$")
    number = F.row_number().over(Window.partitionBy("doc_id", "turn_no").orderBy("start_ms", "word_no", "part")) - 1
    return rows.select("doc_id", "turn_no", "speaker", number.alias("elem_no"), "value", *[F.when(~mark, F.col(c)).alias(c) for c in ("start_ms", "end_ms")])


def in_windows(rows: DataFrame, window_ms: int = 60_000) -> DataFrame:
    """Items as a recogniser with a fixed window sees them: ``window`` and times within it.  :func:`from_windows` undoes
    it."""
    number = F.floor(F.col("start_ms") / window_ms)
    return rows.withColumns({"window": number, "start_ms": F.col("start_ms") - number * window_ms, "end_ms": F.col("end_ms") - number * window_ms})


def from_windows(rows: DataFrame, window_ms: int = 60_000) -> DataFrame:
    """Times of items of windows, on the recording's clock."""
    return rows.withColumns({c: F.col(c) + F.col("window") * window_ms for c in ("start_ms", "end_ms")})


def segment_turns(segments: DataFrame, timed_only: bool = False) -> DataFrame:
    """Elements of recognised segments (doc_id, seg_no, words: array of word, ts, end_ts): one turn a segment, all of
    speaker 0; ``timed_only`` drops words without times."""
    words_ = F.filter("words", lambda x: x["ts"].isNotNull()) if timed_only else F.col("words")
    return segments.select("doc_id", F.col("seg_no").alias("turn_no"), F.lit(0).alias("speaker"), F.posexplode(words_).alias("elem_no", "x")).select("doc_id", "turn_no", "elem_no", "speaker", F.col("x.word").alias("value"), "x.ts", "x.end_ts")
