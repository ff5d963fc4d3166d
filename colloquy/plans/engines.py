"""What stands around models: which rows an engine gets, which it gives, and what is done before and after.

A model is a function of Arrow batches that ``load`` makes once per task (see :func:`colloquy.plans.stages.infer`); none is
part of the package.  Engines with a cache compute only what it does not hold.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from colloquy.functions import text as T
from colloquy.operators import asr, cache, sequence, transfer
from colloquy.plans.stages import infer
from colloquy.schema import ENDING_PUNCT, MOR_PUNCT

Load = Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]]
ELEMENT = "doc_id bigint, turn_no bigint, elem_no bigint, speaker int, value string, ts double, end_ts double"
PIECE = "doc_id bigint, `group` bigint, piece_no bigint, piece string, ts double, end_ts double"
SEGMENT = "doc_id bigint, item_no bigint, speaker string, start_ms bigint, end_ms bigint"


def recognised(files: DataFrame, load: Load, **options) -> DataFrame:
    """Recognition: sound (doc_id, content) to forms in utterances, with options of :func:`colloquy.operators.asr.process`;
    the model gives elements (:data:`ELEMENT`)."""
    return asr.process(infer(files, ELEMENT, load), **options)


def recovered_times(lines: DataFrame, forms: DataFrame, files: DataFrame, load: Load) -> DataFrame:
    """Recovery of times: forms (doc_id, line_no, form_no, text) of documents without any timed line get those of what a
    recogniser hears (elements, as above); the others keep theirs, as null here.  ``lines`` has doc_id and start_ms."""
    untimed = lines.groupBy("doc_id").agg(F.bool_or(F.col("start_ms").isNotNull()).alias("timed")).where("NOT timed").select("doc_id")
    clean = F.lower(T.annotation_clean(F.col("value")))
    heard = infer(files.join(untimed, "doc_id", "left_semi"), ELEMENT, load).where("ts IS NOT NULL AND trim(value) <> ''")
    heard = heard.select("doc_id", (F.col("turn_no") * 1_000_000 + F.col("elem_no")).alias("word_no"), clean.alias("word"), "ts", "end_ts")
    open_forms = forms.join(untimed, "doc_id", "left_semi").select("doc_id", "line_no", "form_no", F.lower(T.annotation_clean(F.col("text"))).alias("text"))
    found = transfer.timing_transfer(open_forms, heard).select("doc_id", "line_no", "form_no", "start_ms", "end_ms")
    return forms.join(found, ["doc_id", "line_no", "form_no"], "left")


#: Longest group of lines, in ms, that aligners take.
SPANS = {"points": 20_000, "pauses": 20_000, "spans": 15_000}


def aligned(lines: DataFrame, forms: DataFrame, sounds: DataFrame, entries: DataFrame, load: Load, *, version: str, now: str, kind: str = "spans") -> tuple[DataFrame, DataFrame]:
    """Forced alignment, cached by group: (forms with times, the new cache).

    lines: doc_id, item_no (the line's number), start_ms, end_ms; forms: doc_id, line_no, form_no, text, type; sounds:
    doc_id, group, digest and what the model needs.  Lines are dealt to groups of SPANS at most.  A group's key is the
    digest of its sound and its text; groups that the cache holds are not aligned again.  The model gets doc_id, group,
    text and the columns of ``sounds`` and gives pieces (:data:`PIECE`).  Words end where the next begins at the latest;
    punctuation has no times."""
    timed = lines.where("start_ms IS NOT NULL AND end_ms IS NOT NULL")
    grouped = sequence.max_span_groups(timed, SPANS[kind]).select("doc_id", F.col("item_no").alias("line_no"), F.col("group").cast("bigint").alias("group"))
    words = forms.join(grouped, ["doc_id", "line_no"]).where(F.col("type").isin(0, 1, 3))
    base = timed.join(grouped.withColumnRenamed("line_no", "item_no"), ["doc_id", "item_no"]).groupBy("doc_id", "group").agg(F.min_by("start_ms", "item_no").alias("base_ms"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "form_no", F.replace("text", F.lit("_"), F.lit(" ")).alias("t")))), lambda x: x["t"]), " ")
    asked = words.groupBy("doc_id", "group").agg(text.alias("text")).join(sounds, ["doc_id", "group"]).join(base, ["doc_id", "group"])
    asked = asked.withColumn("key", cache.alignment_key(F.col("text"), F.col("digest"), F.lit(kind == "pauses")))

    def compute(todo: DataFrame) -> DataFrame:
        pieces = infer(todo.drop("key"), PIECE, load)
        own = words.join(todo.select("doc_id", "group", "base_ms", "key"), ["doc_id", "group"])
        times = transfer.forced_alignment(own.select("doc_id", "group", "base_ms", "line_no", "form_no", "text"), pieces, kind)
        # times are kept as the group's sound has them, so that the same sound elsewhere finds them
        rel = times.join(todo.select("doc_id", "group", "base_ms", "key"), ["doc_id", "group"]).withColumns({c: F.col(c) - F.col("base_ms") for c in ("start_ms", "end_ms")})
        pair = F.when(F.col("start_ms").isNotNull(), F.struct("start_ms", "end_ms"))
        lists = rel.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "form_no", pair.alias("t")))), lambda x: x["t"]).alias("t"))
        return lists.select("key", cache.timings_data(F.col("t")).alias("data"))

    done, new = cache.resolve(asked.select("key", "doc_id", "group", "text", "base_ms", *[c for c in sounds.columns if c not in ("doc_id", "group")]), entries, "forced_alignment", version, now, compute)
    order = F.array_sort(F.collect_list(F.struct("line_no", "form_no")))
    places = words.groupBy("doc_id", "group").agg(order.alias("w")).join(done.select("doc_id", "group", "base_ms", cache.timings(F.col("data")).alias("t")), ["doc_id", "group"])
    flat = places.select("doc_id", "base_ms", F.explode(F.arrays_zip("w", "t")).alias("x")).select("doc_id", "x.w.line_no", "x.w.form_no", (F.col("x.t.start_ms") + F.col("base_ms")).alias("start_ms"), (F.col("x.t.end_ms") + F.col("base_ms")).alias("end_ms"))
    return _ended(forms.join(flat, ["doc_id", "line_no", "form_no"], "left"), lines, kind), new


def _ended(forms: DataFrame, lines: DataFrame, kind: str) -> DataFrame:
    """Forms' times inside their lines: to the next word's start (not for pauses, which say it), the last one's end some
    time later; what is empty then goes."""
    from pyspark.sql import Window

    bounds = lines.select("doc_id", F.col("item_no").alias("line_no"), F.col("start_ms").alias("lo"), F.col("end_ms").alias("hi"))
    w = Window.partitionBy("doc_id", "line_no").orderBy("form_no").rowsBetween(1, Window.unboundedFollowing)
    after = F.first("start_ms", ignorenulls=True).over(w)
    end = F.col("end_ms") if kind == "pauses" else F.coalesce(after, F.greatest("end_ms", F.col("start_ms") + transfer.TAIL_MS))
    out = forms.withColumn("e", end).join(bounds, ["doc_id", "line_no"], "left")
    start, stop = F.greatest("start_ms", F.coalesce("lo", "start_ms")), F.least("e", F.coalesce("hi", "e"))
    good = F.col("type").isin(0, 1, 3) & F.col("start_ms").isNotNull() & (start < stop)
    return out.withColumns({"s": F.when(good, start), "t": F.when(good, stop)}).drop("start_ms", "end_ms", "e", "lo", "hi").withColumnsRenamed({"s": "start_ms", "t": "end_ms"})


def taggable(text: Column, skip_languages: bool = True) -> Column:
    """Whether a tagger gets a line: no bare punctuation and, if asked, no line in another language."""
    plain = ~F.trim(text).isin(ENDING_PUNCT + MOR_PUNCT)
    return plain & T.language_override(text).isNull() if skip_languages else plain


def tagged(lines: DataFrame, entries: DataFrame, load: Load, *, lang: str, version: str, now: str, retokenize: bool = False, lexicon_digest: str = "") -> tuple[DataFrame, DataFrame]:
    """Morphology, cached by line: (lines with their tags, the new cache).  lines: doc_id, line_no, text, forms; the model
    gets key, line (as :func:`colloquy.functions.text.tagging_parts` makes it), ending and special, and gives key and data
    (an entry as :func:`colloquy.operators.cache.tags_data` writes it)."""
    from colloquy.sources.documents import stripped

    key = cache.tag_key(stripped(F.col("forms")), F.lit(lang), F.lit(retokenize), F.lit(lexicon_digest))
    own = lines.where(taggable(F.coalesce("text", F.lit("")))).withColumn("key", key)

    def compute(todo: DataFrame) -> DataFrame:
        line, ending, special = T.tagging_parts(F.col("text"))
        return infer(todo.select("key", line.alias("line"), ending.alias("ending"), special.alias("special")), "key string, data string", load)

    done, new = cache.resolve(own, entries, "morphosyntax", version, now, compute)
    rest = lines.where(~F.coalesce(taggable(F.coalesce("text", F.lit(""))), F.lit(False)))
    return cache.tagged(done).select(lines.columns).unionByName(rest), new


def split_lines(lines: DataFrame, entries: DataFrame, load: Load, *, lang: str, version: str, now: str) -> tuple[DataFrame, DataFrame]:
    """Utterances, cached by line: (pieces of the lines, the new cache).  lines: doc_id, line_no, tier, forms; the model gets
    key and text and gives key and data (an entry as :func:`colloquy.operators.cache.split_data` writes it)."""
    from colloquy.sources.documents import stripped

    own = lines.withColumns({"text": stripped(F.col("forms"))}).withColumn("key", cache.split_key(F.col("text"), F.lit(lang)))
    done, new = cache.resolve(own.select("key", "doc_id", "line_no", "tier", "text"), entries, "utterance_segmentation", version, now, lambda todo: infer(todo.select("key", "text"), "key string, data string", load))
    return cache.split_lines(done), new


def corefered(forms: DataFrame, langs: list[str], load: Load) -> DataFrame:
    """Coreference, for English alone: forms (doc_id, line_no, form_no, text) with their chains; other documents' forms have
    none.  The model gets doc_id and text and gives doc_id, word_no, word and chains."""
    if "eng" not in langs:
        return forms.withColumn("coreference", F.lit(None).cast("array<struct<start:boolean,end:boolean,chain:int>>"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "form_no", "text"))), lambda x: x["text"]), " ")
    words = infer(forms.groupBy("doc_id").agg(text.alias("text")), "doc_id bigint, word_no bigint, word string, chains array<struct<start:boolean,end:boolean,chain:int>>", load)
    return transfer.chains_transfer(forms, words)


def rttm(rows: DataFrame) -> DataFrame:
    """Speaker segments (:data:`SEGMENT`) of RTTM lines (doc_id, line_no, line)."""
    x = F.split(F.trim("line"), r"\s+")
    ms = lambda c: F.bround(c.cast("double") * 1000, 0).cast("bigint")
    found = rows.where("trim(line) LIKE 'SPEAKER %'").select("doc_id", F.col("line_no").alias("item_no"), x.alias("x"))
    return found.select("doc_id", "item_no", F.get("x", F.lit(7)).alias("speaker"), ms(F.get("x", F.lit(3))).alias("start_ms"), (ms(F.get("x", F.lit(3))) + ms(F.get("x", F.lit(4)))).alias("end_ms"))


def diarized(items: DataFrame, files: DataFrame, load: Load, advance: bool = False) -> DataFrame:
    """Speakers of timed items (doc_id, item_no, tier, end_ms): that of the last segment that ended by then; with
    ``advance`` by two pointers, of which the segments' moves on once an item at most.  The model gives :data:`SEGMENT`."""
    segments = infer(files, SEGMENT, load)
    if not advance:
        return sequence.nearest_segment(items, segments)
    left = items.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("item_no", "end_ms"))).alias("u"))
    right = segments.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("end_ms", "item_no", "speaker"))).alias("s"))

    @F.pandas_udf("array<string>")
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for ends, stops, speakers in batches:
            yield pd.Series([transfer.single_advance([(0, e) for e in u], list(zip([] if s is None else s, [] if who is None else who, strict=True))) for u, s, who in zip(ends, stops, speakers, strict=True)], dtype=object)

    found = left.join(right, "doc_id", "left").select("doc_id", F.col("u.item_no").alias("item_no"), run("u.end_ms", "s.end_ms", "s.speaker").alias("speaker"))
    return found.select("doc_id", F.explode(F.arrays_zip("item_no", "speaker")).alias("z")).select("doc_id", "z.item_no", "z.speaker")


def translated(lines: DataFrame, load: Load, lang: str) -> DataFrame:
    """Lines (doc_id, line_no, text, translation) with a translation where they have none.  The model gets doc_id, line_no
    and text, prepared for ``lang``, and gives doc_id, line_no and text."""
    todo = lines.where("translation IS NULL").select("doc_id", "line_no", T.translation_input(F.col("text"), F.lit(lang)).alias("text"))
    new = infer(todo, "doc_id bigint, line_no bigint, text string", load).select("doc_id", "line_no", T.translation_output(F.col("text"), MOR_PUNCT + ENDING_PUNCT).alias("new"))
    return lines.join(new, ["doc_id", "line_no"], "left").withColumn("translation", F.coalesce("translation", "new")).drop("new")


def segmented(lines: DataFrame, split: Callable[[], Callable[[str], list[str]]], lang: str) -> DataFrame:
    """Words of Cantonese lines by a segmenter; lines in other languages stay as they are."""
    return transfer.segmented_words(lines, split) if lang == "yue" else lines


def features(files: DataFrame, load: Load) -> DataFrame:
    """Acoustic features: ``doc_id, feature, value`` of sound (doc_id, content); the model gives doc_id and a map."""
    from colloquy.sources.lexicons import features_long

    return features_long(infer(files, "doc_id bigint, features map<string,double>", load), "features")


def voice_quality(files: DataFrame, load: Load, speech: str = "cs", vowel: str = "sv") -> DataFrame:
    """``name, avqi, error`` of speech files (name, content) with their vowel files.  The model gets name, content and
    vowel_content and gives name, cpps, hnr, shim, shdb, slope and tilt."""
    from colloquy.operators.files import paired

    pairs = paired(files.select("name"), speech, vowel)
    both = pairs.where("error IS NULL").join(files.select("name", "content"), "name").join(files.select(F.col("name").alias("partner"), F.col("content").alias("vowel_content")), "partner")
    names = ["cpps", "hnr", "shim", "shdb", "slope", "tilt"]
    measured = infer(both.select("name", "content", "vowel_content"), "name string, " + ", ".join(f"{n} double" for n in names), load)
    return pairs.join(measured, "name", "left").select("name", T.avqi(*map(F.col, names)).alias("avqi"), "error")
