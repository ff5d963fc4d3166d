"""Operators that carry something across an alignment: times, word borders; and the assembly of recognised speech."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from colloquy.operators.alignment import align

_TIMES = "doc_id bigint, line_no bigint, form_no bigint, text string, start_ms bigint, end_ms bigint"


def timing_transfer(forms: DataFrame, recognised: DataFrame) -> DataFrame:
    """Times of recognised words (doc_id, word_no, word, ts, end_ts in seconds) on the forms of the same document, by
    alignment of the lower-cased words.  Words without a start give nothing; a start of 0 counts.

    One document is one task's work (the alignment is a sequential fold over both its sides); documents are independent.
    """

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty:
            return pd.DataFrame(columns=["doc_id", "line_no", "form_no", "text", "start_ms", "end_ms"])
        left = left.sort_values(["line_no", "form_no"], kind="stable").reset_index(drop=True)
        if right.empty:
            return left[["doc_id", "line_no", "form_no", "text"]].assign(start_ms=pd.array([None] * len(left), "Int64"), end_ms=pd.array([None] * len(left), "Int64"))
        right = right.dropna(subset=["ts"]).sort_values(["ts", "word_no"], kind="stable").reset_index(drop=True)
        start: list[Any] = [None] * len(left)
        end: list[Any] = [None] * len(left)
        for op, p, r in align(right["word"].str.lower().tolist(), left["text"].str.lower().tolist()):
            if op == "match":
                start[r] = round(right["ts"][p] * 1000)
                end[r] = None if pd.isna(right["end_ts"][p]) else round(right["end_ts"][p] * 1000)
        return left[["doc_id", "line_no", "form_no", "text"]].assign(start_ms=pd.array(start, "Int64"), end_ms=pd.array(end, "Int64"))

    recognised = recognised.select(*[F.col(c).alias(c) for c in recognised.columns])  # both sides may come from one DataFrame
    return forms.groupBy("doc_id").cogroup(recognised.groupBy("doc_id")).applyInPandas(run, _TIMES)


def char_transfer(words: list[str], timed: list[tuple[str, float, float]]) -> list[tuple[float, float] | None]:
    """Span of each word: from the first to the last of its characters that align with a timed piece's characters."""
    chars = [(c, k) for k, w in enumerate(words) for c in w.lower()]
    other = [(c, k) for k, (w, _, _) in enumerate(timed) for c in w.lower()]
    spans: list[tuple[float, float] | None] = [None] * len(words)
    for op, p, r in align([c for c, _ in other], [c for c, _ in chars]):
        if op == "match":
            w, (_, s, e) = chars[r][1], timed[other[p][1]]
            old = spans[w]
            spans[w] = (s, e) if old is None else (min(old[0], s), max(old[1], e))
    return spans


def assembled(elements: DataFrame) -> DataFrame:
    """Recognised elements (doc_id, turn_no, elem_no, speaker, value, ts, end_ts in seconds) as timed words: blanks and
    ``<tags>`` go, times in half-even ms, a value of several words gets equal floor slices, foreign signs become ASCII.

    ``doc_id, turn_no, tier, elem_no, part, word, start_ms, end_ms``; all native.
    """
    clean = elements.where("value IS NOT NULL AND trim(value) <> '' AND NOT trim(value) RLIKE '^<.*>$'")
    ms = lambda c: F.bround(F.col(c) * 1000, 0).cast("bigint")
    split = clean.select("doc_id", "turn_no", F.concat(F.lit("PAR"), F.col("speaker").cast("string")).alias("tier"), "elem_no", ms("ts").alias("b"), ms("end_ts").alias("e"), F.filter(F.split(F.trim("value"), " +"), lambda x: x != "").alias("parts"))
    step = F.floor((F.col("e") - F.col("b")) / F.size("parts"))
    out = split.withColumn("step", step).select("doc_id", "turn_no", "tier", "elem_no", "b", "step", F.posexplode("parts").alias("part", "raw"))
    word = F.translate(F.col("raw"), "؟۔،؛", "?.,;")
    punct = word.isin(".", "?", "!", ",", ";")
    return out.select("doc_id", "turn_no", "tier", "elem_no", "part", word.alias("word"), F.when(~punct, F.col("b") + F.col("part") * F.col("step")).alias("start_ms"), F.when(~punct, F.col("b") + (F.col("part") + 1) * F.col("step")).alias("end_ms"))


def single_advance(utterances: list[tuple[int, int]], segments: list[tuple[int, str]]) -> list[str | None]:
    """Speakers by two pointers: per utterance the segment pointer moves on at most once, when its end is passed."""
    out, k = [], 0
    for _, end in utterances:
        if k < len(segments) - 1 and segments[k][0] < end:
            k += 1
        out.append(segments[k][1] if segments else None)
    return out


# --- across characters -----------------------------------------------------------------------------------------------


def character_matches(words: list[str], others: list[str]) -> list[tuple[int, int]]:
    """(word, other) for each character that the alignment of both sides' characters matches, in order."""
    chars = [(c, k) for k, w in enumerate(words) for c in w]
    theirs = [(c, k) for k, w in enumerate(others) for c in w]
    return [(chars[r][1], theirs[p][1]) for op, p, r in align([c for c, _ in theirs], [c for c, _ in chars]) if op == "match"]


#: Milliseconds that the last word lasts where nothing says how long.
TAIL_MS = 500
FORCED = ("points", "spans", "pauses")


def forced_times(words: list[str], pieces: list[tuple[str, float, float | None]], base_ms: int, kind: str = "spans") -> list[tuple[int, int] | None]:
    """Times of words from recognised pieces (text, start and end in seconds from ``base_ms``): those of the piece that a
    word's first matched character is of; null for a word without one.

    points: a piece has a start alone, and so has the word; pauses: it lasts to the next other piece that matches, the
    last one TAIL_MS; spans: the piece's own start and end."""
    found = character_matches(words, [p for p, _, _ in pieces])
    out: list[tuple[int, int] | None] = [None] * len(words)
    ms = lambda x: int(round(x * 1000 + base_ms))
    for i, (w, p) in enumerate(found):
        if out[w] is not None:
            continue
        _, start, end = pieces[p]
        if kind == "pauses":
            after = next((q for _, q in found[i + 1 :] if q != p), None)
            out[w] = (ms(start), ms(start) + TAIL_MS if after is None else ms(pieces[after][1]))
        else:
            out[w] = (ms(start), ms(end) if kind == "spans" and end is not None else ms(start))
    return out


def forced_alignment(forms: DataFrame, pieces: DataFrame, kind: str = "spans") -> DataFrame:
    """``forms`` (doc_id, group, base_ms, line_no, form_no, text) with ``start_ms, end_ms`` out of the ``pieces`` (doc_id,
    group, piece_no, piece, ts, end_ts) that an aligner gave for each group; null where nothing matches, or the group has
    no pieces.  A group (see ``sequence.max_span_groups``) is some seconds of speech, so its arrays are short."""
    if kind not in FORCED:
        raise ValueError(f"kind must be one of {FORCED}")
    keys = ["doc_id", "group"]
    left = forms.groupBy(*keys).agg(F.min("base_ms").alias("base_ms"), F.array_sort(F.collect_list(F.struct("line_no", "form_no", "text"))).alias("f"))
    right = pieces.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("piece_no", "piece", F.col("ts").cast("double").alias("ts"), F.col("end_ts").cast("double").alias("end_ts")))).alias("p"))

    @F.pandas_udf("array<struct<start_ms:bigint,end_ms:bigint>>")
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for words, said, base in batches:
            rows = []
            for w, p, b in zip(words, said, base, strict=True):
                times = forced_times([*w], [(x["piece"], x["ts"], x["end_ts"]) for x in ([] if p is None else p)], int(b), kind)
                rows.append([None if t is None else {"start_ms": t[0], "end_ms": t[1]} for t in times])
            yield pd.Series(rows, dtype=object)

    joined = left.join(right, keys, "left").withColumn("t", run(F.transform("f", lambda x: x["text"]), "p", "base_ms"))
    out = joined.select(*keys, F.explode(F.arrays_zip("f", "t")).alias("x"))
    return out.select(*keys, "x.f.line_no", "x.f.form_no", "x.f.text", "x.t.start_ms", "x.t.end_ms")


_NEW = "array<struct<text:string,type:int,start_ms:bigint,end_ms:bigint>>"


def resegmented(forms: list[dict], words: list[str]) -> list[dict]:
    """``words`` as forms in place of ``forms`` with the same characters: from the start of the first form that a word's
    characters match to the end of the last, with the first one's type; punctuation at the end of ``forms`` stays there."""
    tail = len(forms)
    while tail and forms[tail - 1]["type"] != 0:
        tail -= 1
    own = forms[:tail]
    matched: dict[int, list[int]] = {}
    for f, w in character_matches([f["text"] for f in own], words):
        matched.setdefault(w, []).append(f)
    out = []
    for k, w in enumerate(words):
        at = matched.get(k)
        first, last = (own[at[0]], own[at[-1]]) if at else ({}, {})
        start = first.get("start_ms") if first.get("start_ms") is not None else last.get("start_ms")
        end = last.get("end_ms") if last.get("end_ms") is not None else first.get("end_ms")
        out.append({"text": w, "type": first.get("type", 0), "start_ms": start, "end_ms": end})
    return out + [{x: f[x] for x in ("text", "type", "start_ms", "end_ms")} for f in forms[tail:]]


def segmented_words(lines: DataFrame, split: Callable[[], Callable[[str], list[str]]]) -> DataFrame:
    """``lines`` (with forms: array of text, type, start_ms, end_ms) whose words are those that a segmenter finds in them
    written without spaces.  ``split`` is called once per task and returns the segmenter; lines without words stay."""

    @F.pandas_udf(_NEW)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        cut = split()
        for lines_ in batches:
            rows = []
            for forms in lines_:
                forms = [dict(f) for f in forms]
                plain = "".join(f["text"] for f in forms[: len(forms) - next((k for k, f in enumerate(reversed(forms)) if f["type"] == 0), len(forms))])
                rows.append(resegmented(forms, list(cut(plain))) if plain.strip() else forms)
            yield pd.Series(rows, dtype=object)

    return lines.withColumn("forms", run(F.transform("forms", lambda x: F.struct(x["text"].alias("text"), x["type"].cast("int").alias("type"), x["start_ms"].cast("bigint").alias("start_ms"), x["end_ms"].cast("bigint").alias("end_ms")))))


def chains_transfer(forms: DataFrame, words: DataFrame) -> DataFrame:
    """``forms`` (doc_id, line_no, form_no, text) with ``coreference``: the chains (array of start, end, chain) of the
    recognised ``words`` (doc_id, word_no, word, chains) that they align with, null where they match none."""

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left = left.sort_values(["line_no", "form_no"], kind="stable").reset_index(drop=True)
        right = right.sort_values("word_no", kind="stable").reset_index(drop=True)
        found: list[Any] = [None] * len(left)
        for op, p, r in align(right["word"].tolist(), left["text"].tolist()):
            if op == "match":
                found[r] = [] if right["chains"][p] is None else [dict(x) for x in right["chains"][p]]
        return left.assign(coreference=found)[["doc_id", "line_no", "form_no", "text", "coreference"]]

    words = words.select(*[F.col(c).alias(c) for c in words.columns])
    schema = "doc_id bigint, line_no bigint, form_no bigint, text string, coreference array<struct<start:boolean,end:boolean,chain:int>>"
    return forms.groupBy("doc_id").cogroup(words.groupBy("doc_id")).applyInPandas(run, schema)


# --- phrases ---------------------------------------------------------------------------------------------------------


def distinct_phrases(phrases: list[str]) -> list[list[str]]:
    """Phrases that remain when the ones found inside larger ones are cut out of these, the last of the longest first;
    phrases that another one holds, and single words, go."""
    kept: list[str] = []
    for phrase in reversed(sorted(phrases, key=len)):
        for inside in [x for x in kept if x in phrase]:
            phrase = phrase.replace(inside, "")
        if phrase.strip() and not any(phrase in x for x in kept):
            kept.append(phrase)
    split = [[w for w in p.split(" ") if w] for p in reversed(kept)]
    return [p for p in split if len(p) != 1]


#: Words that an utterance has at least.
LEAST_WORDS = 3


def phrase_groups(words: list[str], phrases: list[str]) -> list[list[int]]:
    """Words of an utterance dealt to shorter utterances by the ``phrases`` of its parse: a word belongs to the phrase that
    it aligns with, one that aligns with none to that of the next word that does.  Pieces of fewer than LEAST_WORDS words
    join the next one, at the end the last one."""
    flat = [(w, k) for k, p in enumerate(distinct_phrases(phrases)) for w in p]
    of: dict[int, int] = {r: flat[p][1] for op, p, r in align([w for w, _ in flat], words) if op == "match"}
    pieces: list[list[int]] = []
    current: int | None = None
    for i in range(len(words)):
        own = of.get(i)
        if own is None:
            own = next((of[j] for j in range(i + 1, len(words)) if j in of), current)
        if not pieces or own != current:
            pieces.append([])
            current = own
        pieces[-1].append(i)
    out: list[list[int]] = []
    waiting: list[int] = []
    for piece in pieces:
        waiting += piece
        if len(piece) >= LEAST_WORDS:
            out.append(waiting)
            waiting = []
    if waiting:
        if out:
            out[-1] += waiting
        else:
            out.append(waiting)
    return out


def phrase_split(lines: DataFrame) -> DataFrame:
    """``doc_id, line_no, utt, words`` of lines (doc_id, line_no, words, phrases: arrays of strings): the utterances that
    :func:`phrase_groups` makes of them."""

    @F.pandas_udf("array<array<string>>")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for words, phrases in batches:
            yield pd.Series([[[w[i] for i in g] for g in phrase_groups([*w], [*p])] for w, p in zip(words, phrases, strict=True)], dtype=object)

    return lines.withColumn("x", run("words", "phrases")).select("doc_id", "line_no", F.posexplode("x").alias("utt", "words"))
