"""Whole CHAT documents: headers, utterances with their tiers joined word by word, and back to one file a document.

Headers, the owners of dependent lines, and writing are column expressions over the lines of :mod:`colloquy.sources.chat`;
reading the words of a main line is a recursive grammar, so it runs in Arrow batches, together with the joins by position
of its tiers.  What cannot be read becomes an ``error`` of its utterance or document, never a failed job.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from colloquy.functions.text import bullet, language_override, written_line
from colloquy.schema import ENDING_PUNCT, FP, PUNCT, REGULAR, RETRACE
from colloquy.sources import chat

_MORPHOLOGY = "array<struct<lemma:string,pos:string,feats:string>>"
_DEPENDENCY = "array<struct<id:int,dep_id:int,dep_type:string>>"
FORM = f"struct<text:string,type:int,start_ms:bigint,end_ms:bigint,morphology:{_MORPHOLOGY},dependency:{_DEPENDENCY}>"
_READ = f"struct<forms:array<{FORM}>,delim:string,error:string>"
#: Types of forms that are spoken, and of those that have morphology.
SPOKEN, TAGGED = (REGULAR, RETRACE, PUNCT, FP), (REGULAR, PUNCT)
#: Extensions of media files, as transcripts name them without one.
MEDIA = ["mp3", "wav", "mp4"]


# --- lines -> documents and utterances -------------------------------------------------------------------------------


def _body(rows: DataFrame) -> DataFrame:
    """The lines of :func:`chat.lines` with ``at``: begin and end of each document, and whether a line lies between."""
    marks = rows.groupBy("doc_id").agg(
        F.min(F.when((F.col("kind") == "header") & (F.col("id") == "Begin"), F.col("line_no"))).alias("begin"),
        F.max(F.when((F.col("kind") == "header") & (F.col("id") == "End"), F.col("line_no"))).alias("end"),
    )
    return rows.join(marks, "doc_id").withColumn("inside", F.coalesce((F.col("line_no") > F.col("begin")) & (F.col("line_no") < F.col("end")), F.lit(False)))


def documents(rows: DataFrame) -> DataFrame:
    """``doc_id, pid, langs, options, media, participants, customs, error``: one row per document.

    media is its name and link state (audio or video, unlinked or missing; null without a ``@Media`` line), participants
    are the ``@ID`` lines in order, customs the other header lines with their line numbers, options what ``@Options``
    says unless it names CA (then it is a custom line)."""
    rows = _body(rows).withColumn("content", F.trim("content"))
    header = (F.col("kind") == "header") & F.col("inside")
    pick = lambda name, test: F.first(F.when((F.col("id") == name) & test, F.col("content")), ignorenulls=True)
    options = F.first(F.when((F.col("id") == "Options") & header & ~F.col("content").contains("CA"), F.col("content")), ignorenulls=True)
    known = F.col("id").isin("Participants", "Languages", "ID", "Media") | ((F.col("id") == "Options") & ~F.col("content").contains("CA"))
    ordered = lambda test, *cols: F.array_sort(F.collect_list(F.when(test, F.struct("line_no", *cols))))
    out = rows.groupBy("doc_id").agg(
        pick("PID", F.col("line_no") < F.col("begin")).alias("pid"),
        pick("Languages", header).alias("langs"),
        options.alias("options"),
        pick("Media", header).alias("media"),
        ordered(header & (F.col("id") == "ID"), "content").alias("ids"),
        ordered(header & ~known, "id", "content").alias("customs"),
        F.min(F.when(F.col("begin").isNull(), "there is no @Begin").when(F.col("end").isNull(), "there is no @End")).alias("error"),
        F.min(F.when((F.col("kind") == "other") & F.col("inside"), F.concat(F.lit("unknown line "), F.col("line_no").cast("string")))).alias("unknown"),
    )
    field = lambda x, k: F.coalesce(F.get(F.split(x["content"], r"\|", -1), F.lit(k)), F.lit(""))
    person = lambda x: F.struct(field(x, 2).alias("id"), field(x, 7).alias("name"), field(x, 0).alias("lang"), field(x, 1).alias("corpus"), field(x, 3).alias("birthday"), F.array(*[field(x, k) for k in (4, 5, 6, 8, 9)]).alias("additional"))
    langs = F.filter(F.split(F.coalesce("langs", F.lit("")), "[ ,]+"), lambda x: x != "")
    state = F.when(F.col("media").contains("unlinked"), "unlinked").when(F.col("media").contains("missing"), "missing").otherwise("linked")
    kind = F.when(F.col("media").contains("video"), "video").otherwise("audio")
    media = F.when(F.col("media").isNotNull(), F.struct(F.trim(F.substring_index("media", ",", 1)).alias("name"), F.when(F.col("media").rlike("audio|video"), kind).otherwise("audio").alias("type"), F.when(F.col("media").rlike("audio|video"), state).otherwise("unlinked").alias("state")))
    customs = F.transform("customs", lambda x: F.struct(x["line_no"].alias("line_no"), F.trim(x["id"]).alias("id"), F.nullif(x["content"], F.lit("")).alias("content")))
    return out.select("doc_id", "pid", langs.alias("langs"), "options", media.alias("media"), F.transform("ids", person).alias("participants"), customs.alias("customs"), F.coalesce("error", "unknown").alias("error"))


def _words(text: str) -> list[tuple[str, int]]:
    """Forms of a main line as it stands in a file: without its bullet, a linker at its begin, CA marks and pauses."""
    line = re.sub("\x15\\d+_\\d+\x15", "", text).strip()
    first = line.split(" ")[0]
    if ("<" in first or "+" in first) and not re.search(r"\w", first) and first not in ENDING_PUNCT:
        line = line[len(first) :]
    for old, new in (("< ", "<"), (" ]", "]"), ("[ ", "["), (" >", ">")):
        line = line.replace(old, new)
    line = re.sub(r"⌊[&-]=[\w '-]+⌋|↫.*?↫", "", line).strip()
    pause = re.search(r"\(\.\)$", line)
    line = re.sub(r"\([\d.:]+\)", "", line).replace(",", " ,")
    # an ending mark stands apart; of marks inside each other the longest
    end = next((e for e in sorted(ENDING_PUNCT, key=len, reverse=True) if line.endswith(e)), None)
    if end:
        line = f"{line[: -len(end)]} {end}"
    forms = chat.lex(re.sub(" +", " ", line).strip())
    return forms + [("(.)", PUNCT)] if pause else forms


def _morphology(item: str) -> list[dict]:
    if item in ENDING_PUNCT:
        return [{"lemma": item, "pos": "PUNCT", "feats": ""}]
    out = []
    for x in re.split("[~$]", item):
        pos, bar, rest = x.partition("|")
        if not bar:
            raise ValueError(f"no part of speech: {item}")
        lemma, _, feats = rest.partition("-")
        out.append({"lemma": lemma, "pos": pos, "feats": feats})
    return out


def _times(wor: str) -> list[tuple[int, int] | None]:
    """Times of the words of a %wor line; single ending marks are no words."""
    marks = "".join(re.escape(e) for e in ENDING_PUNCT if len(e) == 1)
    out: list[tuple[int, int] | None] = []
    for word in re.findall(rf"[^{marks} \x15]+ ?(?:\x15\d+_\d+\x15)?", wor):
        found = re.search("\x15(\\d+)_(\\d+)\x15", word)
        out.append((int(found[1]), int(found[2])) if found else None)
    return out


def read_line(text: str, mor: str | None = None, gra: str | None = None, wor: str | None = None) -> tuple[list[dict], str]:
    """(forms, end mark) of an utterance: the n-th item of %mor belongs to the n-th word that has morphology, %gra's to
    its parts one after the other, %wor's n-th word to the n-th spoken one."""
    words = [(t, k) for t, k in _words(text) if k in SPOKEN]
    forms = [{"text": t, "type": k, "start_ms": None, "end_ms": None, "morphology": None, "dependency": None} for t, k in words]
    delim = words[-1][0] if words and words[-1][0] in ENDING_PUNCT else "."
    tagged = [f for f in forms if f["type"] in TAGGED]
    if mor is not None:
        items = mor.split()
        if len(items) != len(tagged):
            raise ValueError(f"{len(tagged)} words, {len(items)} items of %mor")
        for f, item in zip(tagged, items, strict=True):
            f["morphology"] = _morphology(item)
        if gra is not None:
            edges = [x.split("|") for x in gra.split()]
            if len(edges) != sum(len(f["morphology"]) for f in tagged) or any(len(e) != 3 for e in edges):
                raise ValueError(f"{sum(len(f['morphology']) for f in tagged)} parts of %mor, {len(edges)} edges of %gra")
            k = 0
            for f in tagged:
                own, k = edges[k : k + len(f["morphology"])], k + len(f["morphology"])
                f["dependency"] = [{"id": int(a), "dep_id": int(b), "dep_type": c} for a, b, c in own]
    if wor is not None:
        times = _times(wor)
        if len(times) not in (len(forms), len(forms) - (forms[-1]["type"] == PUNCT if forms else 0)):
            # inner punctuation has no word on the line either
            spoken = [f for f in forms if f["type"] != PUNCT]
            if len(times) != len(spoken):
                raise ValueError(f"{len(forms)} spoken words, {len(times)} words of %wor")
        else:
            spoken = forms
        for f, t in zip(spoken, times, strict=False):
            if t:
                f["start_ms"], f["end_ms"] = t
    return forms, delim


def _read(*tiers: str) -> Column:
    @F.pandas_udf(_READ)
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for columns in batches:
            out = []
            for text, mor, gra, wor in zip(*columns, strict=True):
                try:
                    forms, delim = read_line(text or "", mor, gra, wor)
                    out.append((forms, delim, None))
                except ValueError as e:
                    out.append((None, None, str(e)))
            yield pd.DataFrame(out, columns=["forms", "delim", "error"])

    return run(*tiers)


def compared(xsrep: Column, xsmor: Column) -> Column:
    """Tokens of a comparison: a sign in front of a word (and of its part of speech) says on which side it is extra.  A mark
    that stands for its own part of speech is punctuation."""
    words, pos = F.filter(F.split(xsrep, " +"), lambda x: x != ""), F.filter(F.split(F.coalesce(xsmor, F.lit("")), " +"), lambda x: x != "")
    status = lambda x: F.when(x.startswith("+"), "extra_main").when(x.startswith("-"), "extra_gold").otherwise("match")
    bare = lambda x: F.regexp_replace(x, "^[+-]", "")
    one = lambda x, k: F.struct(F.when(status(x) == "match", x).otherwise(bare(x)).alias("text"), F.when((status(x) == "match") & x.isin(ENDING_PUNCT) & (F.get(pos, k) == x), "PUNCT").when(status(x) == "match", F.get(pos, k)).otherwise(bare(F.get(pos, k))).alias("pos"), status(x).alias("status"))
    return F.when(xsrep.isNotNull(), F.transform(words, one))


def utterances(rows: DataFrame, special_mor: bool = False) -> DataFrame:
    """``doc_id, line_no, tier, text, override_lang, start_ms, end_ms, forms, delim, translation, comparison, customs,
    error``: the main lines between begin and end, each with the dependent lines that follow it.

    special_mor: in documents whose first language is eng, %umor and %ugra are read in place of %mor and %gra."""
    from pyspark.sql import Window

    rows = _body(rows).where("inside").withColumn("content", F.trim("content"))
    order = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    owner = F.last(F.when(F.col("kind") != "dependent", F.struct("line_no", "kind")), ignorenulls=True).over(order)
    english = F.last(F.when((F.col("kind") == "header") & (F.col("id") == "Languages"), F.regexp_extract("content", "^[^ ,]*", 0) == "eng"), ignorenulls=True).over(order)
    own = rows.withColumns({"owner": owner, "english": F.coalesce(english, F.lit(False)) & F.lit(special_mor)})
    tiers = rows.where("kind = 'header' AND id = 'ID'").groupBy("doc_id").agg(F.collect_set(F.get(F.split("content", r"\|", -1), F.lit(2))).alias("declared"))
    own = own.where("kind IN ('main', 'dependent') AND owner.kind = 'main'")
    dependent = F.col("kind") == "dependent"
    name = F.trim("id")
    special = F.when(F.col("english"), F.when(name.isin("umor", "ugra"), F.substring(name, 2, 3)).when(~name.isin("mor", "gra"), name)).otherwise(name)
    own = own.withColumn("name", F.when(dependent, special))
    pick = lambda *names: F.last(F.when(F.col("name").isin(*names), F.col("content")), ignorenulls=True)
    known = ["mor", "gra", "wor", "xwor", "xtra", "xsrep", "xsmor"]
    other = F.when(dependent & (F.col("name").isNull() | ~F.col("name").isin(known)), F.struct("line_no", name.alias("id"), "content"))
    got = own.groupBy("doc_id", F.col("owner.line_no").alias("line_no")).agg(
        F.max(F.when(~dependent, name)).alias("tier"),
        F.max(F.when(~dependent, F.col("content"))).alias("text"),
        *[pick(n).alias(n) for n in ("mor", "gra", "xtra", "xsrep", "xsmor")],
        pick("wor", "xwor").alias("wor"),
        F.transform(F.array_sort(F.collect_list(other)), lambda x: F.struct(x["id"], x["content"])).alias("customs"),
    )
    got = got.join(tiers, "doc_id", "left").withColumn("read", _read("text", "mor", "gra", "wor"))
    start, end = bullet(F.col("text"))
    undeclared = F.when(~F.array_contains(F.coalesce("declared", F.array().cast("array<string>")), F.col("tier")), F.concat(F.lit("undeclared tier "), "tier"))
    return got.select("doc_id", "line_no", "tier", "text", language_override(F.col("text")).alias("override_lang"), start.alias("start_ms"), end.alias("end_ms"), "read.forms", "read.delim", F.col("xtra").alias("translation"), compared(F.col("xsrep"), F.col("xsmor")).alias("comparison"), "customs", F.coalesce("read.error", undeclared).alias("error"))


def linked_media(docs: DataFrame, files: DataFrame) -> DataFrame:
    """``docs`` with ``url``: the media file (path) in the transcript's folder that has the name of its ``@Media`` line, or
    else the transcript's own; null without either.  doc_id is the transcript's path; of several files the first path."""
    folder = lambda c: F.regexp_replace(c, "[^/]*$", "")
    stem = lambda c: F.regexp_replace(F.regexp_extract(c, "([^/]*)$", 1), r"\.[^.]*$", "")
    media = files.where(F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1)).isin(MEDIA)).groupBy(folder(F.col("path")).alias("folder"), stem(F.col("path")).alias("stem")).agg(F.min("path").alias("path"))
    named = media.select(F.col("folder").alias("f1"), F.col("stem").alias("s1"), F.col("path").alias("p1"))
    same = media.select(F.col("folder").alias("f2"), F.col("stem").alias("s2"), F.col("path").alias("p2"))
    found = docs.join(named, (folder(F.col("doc_id")) == F.col("f1")) & (F.col("media.name") == F.col("s1")), "left").join(same, (folder(F.col("doc_id")) == F.col("f2")) & (stem(F.col("doc_id")) == F.col("s2")), "left")
    return found.withColumn("url", F.when(F.col("media").isNotNull(), F.coalesce("p1", "p2"))).drop("f1", "s1", "p1", "f2", "s2", "p2")


# --- utterances -> lines -> files ------------------------------------------------------------------------------------


def detokenize(forms: list[tuple[str, int]]) -> str:
    """The main line of (text, type) forms: filled pauses get their mark; of a run of retraced words each that comes again
    at once, and each run of others as a group, is marked as repeated."""
    out: list[str] = []
    k = 0
    while k < len(forms):
        text, kind = forms[k]
        if kind == FP:
            out.append(f"&-{text}")
        elif kind != RETRACE:
            out.append(text)
        else:
            group = [text]
            again = k + 1 < len(forms) and forms[k + 1][0] == text
            while not again and k + 1 < len(forms) and forms[k + 1][1] == RETRACE and not (k + 2 < len(forms) and forms[k + 2][0] == forms[k + 1][0]):
                k += 1
                group.append(forms[k][0])
            out.append(f"<{' '.join(group)}> [/]" if len(group) > 1 else f"{text} [/]")
        k += 1
    return " ".join(out)


def _detokenized(forms: Column) -> Column:
    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for lines in batches:
            yield pd.Series([None if x is None else detokenize([(f["text"], f["type"]) for f in x]) for x in lines], dtype=object)

    return run(forms)


def detokenized(forms: Column, start: Column, end: Column) -> Column:
    """:func:`detokenize` of an array of forms, and the time bullet where there are times."""
    plain = _detokenized(F.transform(forms, lambda x: F.struct(x["text"].alias("text"), x["type"].cast("int").alias("type"))))
    return F.concat(plain, F.when(start.isNotNull() & end.isNotNull(), F.concat(F.lit(" \x15"), start.cast("string"), F.lit("_"), end.cast("string"), F.lit("\x15"))).otherwise(F.lit("")))


def stripped(forms: Column, include_retrace: bool = False, include_fp: bool = False) -> Column:
    """Words and punctuation of an array of forms, with retraces and filled pauses if asked for, joined by spaces."""
    kinds = [REGULAR, PUNCT] + [RETRACE] * include_retrace + [FP] * include_fp
    return F.array_join(F.transform(F.filter(forms, lambda x: x["type"].isin(kinds)), lambda x: x["text"]), " ")


def transcript(lines: DataFrame, include_tiers: bool = False, strip: bool = False) -> DataFrame:
    """``doc_id, line_no, line`` of utterances with text or forms; a line without either has no row."""
    line = stripped(F.col("forms")) if strip else F.coalesce("text", detokenized(F.col("forms"), F.col("start_ms"), F.col("end_ms")))
    return lines.select("doc_id", "line_no", F.concat("tier", F.lit(": "), line).alias("line") if include_tiers else line.alias("line")).where("line IS NOT NULL")


def mor_tier(forms: Column) -> Column:
    """A %mor line: the parts of a word joined by ``~``, features by ``-``; a final punctuation mark without its tag; null
    where no word has morphology."""
    part = lambda m: F.concat(m["pos"], F.lit("|"), m["lemma"], F.when(m["feats"] != "", F.concat(F.lit("-"), m["feats"])).otherwise(F.lit("")))
    items = F.transform(F.filter(forms, lambda x: x["morphology"].isNotNull()), lambda x: F.when(x["morphology"][0]["pos"] == "PUNCT", x["morphology"][0]["lemma"]).otherwise(F.array_join(F.transform(x["morphology"], part), "~")))
    return F.when(F.size(items) > 0, F.array_join(items, " "))


def gra_tier(forms: Column) -> Column:
    edges = F.flatten(F.transform(F.filter(forms, lambda x: x["dependency"].isNotNull()), lambda x: x["dependency"]))
    return F.when(F.size(edges) > 0, F.array_join(F.transform(edges, lambda d: F.concat_ws("|", d["id"].cast("string"), d["dep_id"].cast("string"), d["dep_type"])), " "))


def wor_tier(forms: Column) -> Column:
    """A %wor line: spoken words with their times; null where no word has any."""
    word = lambda x: F.regexp_replace(F.concat(x["text"], F.when(x["start_ms"].isNotNull(), F.concat(F.lit(" \x15"), x["start_ms"].cast("string"), F.lit("_"), x["end_ms"].cast("string"), F.lit("\x15"))).otherwise(F.lit(""))), r"@(\w)(\w\w\w)", "@$1:$2")
    return F.when(F.exists(forms, lambda x: x["start_ms"].isNotNull()), F.array_join(F.transform(forms, word), " "))


def utterance_lines(lines: DataFrame, *, special_mor: Column | None = None, write_wor: bool = True, write_mor: bool = True, abbreviations: list[str] = ()) -> Column:
    """The lines of an utterance in a file: main line, %mor, %gra, %wor, %xtra, other tiers, comparison."""
    main = written_line(F.coalesce("text", detokenized(F.col("forms"), F.col("start_ms"), F.col("end_ms"))), list(abbreviations))
    for old, new in (("^,", ""), ("«", "“"), ("»", "”"), ("[—–]", "-")):
        main = F.regexp_replace(main, old, new)
    u = F.when(special_mor, "u").otherwise("") if special_mor is not None else F.lit("")
    tier = lambda name, body: F.when(body.isNotNull(), F.concat(F.lit("%"), name, F.lit(":\t"), body))
    empty = F.lit(None).cast("string")
    sign = lambda x: F.when(x["status"] == "extra_main", "+").when(x["status"] == "extra_gold", "-").otherwise("")
    has = {c.lower() for c in lines.columns}
    c = F.col("comparison") if "comparison" in has else F.lit(None).cast("array<struct<text:string,pos:string,status:string>>")
    last = F.size(c) - 1
    xsmor = F.array_join(F.transform(c, lambda x, k: F.when((k == last) & (x["pos"] == "PUNCT") & (x["status"] == "match"), x["text"]).otherwise(F.concat(sign(x), F.coalesce(x["pos"], F.lit("?"))))), " ")
    customs = F.transform(F.filter(F.col("customs"), lambda x: x["content"] != ""), lambda x: F.concat(F.lit("%"), x["id"], F.lit(":\t"), x["content"])) if "customs" in has else F.array().cast("array<string>")
    translation = F.when(~F.trim("translation").isin("", ".", "!", "?"), F.col("translation")) if "translation" in has else empty
    forms = F.col("forms")
    parts = [
        F.concat(F.lit("*"), F.col("tier"), F.lit(":\t"), F.trim(main)),
        tier(F.concat(u, F.lit("mor")), mor_tier(forms)) if write_mor else empty,
        tier(F.concat(u, F.lit("gra")), gra_tier(forms)) if write_mor else empty,
        tier(F.lit("wor"), wor_tier(forms)) if write_wor else empty,
        tier(F.lit("xtra"), translation),
    ]
    compare = F.array(tier(F.lit("xsrep"), F.when(c.isNotNull(), F.array_join(F.transform(c, lambda x: F.concat(sign(x), x["text"])), " "))), tier(F.lit("xsmor"), F.when(c.isNotNull(), xsmor)))
    return F.array_join(F.array_compact(F.concat(F.array(*parts), F.coalesce(customs, F.array().cast("array<string>")), compare)), "\n")


def preamble() -> Column:
    """The header lines of a document (a row of :func:`documents`)."""
    people = F.col("participants")
    ids = F.transform(people, lambda p: F.concat(F.lit("@ID:\t"), F.array_join(F.concat(F.array(p["lang"], p["corpus"], p["id"], p["birthday"]), F.slice(p["additional"], 1, 3), F.array(p["name"]), F.slice(p["additional"], 4, 2)), "|"), F.lit("|")))
    birth = F.transform(F.filter("customs", lambda x: F.lower(x["id"]).contains("birth")), lambda x: F.concat(F.lit("@"), x["id"], F.lit(":\t"), F.coalesce(x["content"], F.lit(""))))
    media = F.when(F.col("media").isNotNull(), F.concat(F.lit("@Media:\t"), F.col("media.name"), F.lit(", "), F.col("media.type"), F.when(F.col("media.state") != "linked", F.concat(F.lit(", "), F.col("media.state"))).otherwise(F.lit(""))))
    first = [F.lit("@UTF8"), F.when(F.col("pid") != "", F.concat(F.lit("@PID:\t"), F.col("pid"))), F.lit("@Begin"), F.concat(F.lit("@Languages:\t"), F.array_join("langs", ", ")), F.concat(F.lit("@Participants:\t"), F.array_join(F.transform(people, lambda p: F.concat_ws(" ", p["id"], p["name"])), ", ")), F.when(F.col("options") != "", F.concat(F.lit("@Options:\t"), F.col("options")))]
    return F.array_join(F.array_compact(F.concat(F.array(*first), ids, birth, F.array(media))), "\n")


def files(docs: DataFrame, lines: DataFrame, *, special_mor: bool = False, **options) -> DataFrame:
    """``doc_id, text``: whole files of :func:`documents` and :func:`utterances`.  Custom header lines stand where their
    line numbers say, those about births behind the participants; utterances that are one ending mark are left out.

    special_mor: %umor and %ugra in documents whose first language is eng.  Options as in :func:`utterance_lines`."""
    lines = lines.join(docs.select("doc_id", F.coalesce(F.get("langs", F.lit(0)) == "eng", F.lit(False)).alias("eng")), "doc_id", "left")
    body = utterance_lines(lines, special_mor=F.col("eng") & F.lit(special_mor), **options)
    single = F.trim(F.regexp_replace(F.coalesce("text", stripped(F.col("forms"))), "\x15\\d+_\\d+\x15", "")).isin(ENDING_PUNCT)
    main = lines.where(~F.coalesce(single, F.lit(False))).select("doc_id", "line_no", body.alias("x"))
    custom = docs.select("doc_id", F.explode("customs").alias("c")).where(~F.lower("c.id").contains("birth")).select("doc_id", "c.line_no", F.concat(F.lit("@"), F.col("c.id"), F.when(F.col("c.content").isNotNull(), F.concat(F.lit(":\t"), F.col("c.content"))).otherwise(F.lit(""))).alias("x"))
    rows = main.unionByName(custom).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "x"))).alias("rows"))
    text = F.array_join(F.concat(F.array(preamble()), F.transform(F.coalesce("rows", F.array().cast("array<struct<line_no:bigint,x:string>>")), lambda r: r["x"]), F.array(F.lit("@End\n"))), "\n")
    return docs.join(rows, "doc_id", "left").select("doc_id", F.replace(text, F.lit("‫"), F.lit("‏")).alias("text"))


def write(files_: DataFrame, path: str) -> None:
    """One file per document below ``path``, in a folder named after it (``doc_id=...``)."""
    files_.select(F.regexp_replace(F.col("doc_id").cast("string"), "[^A-Za-z0-9_.-]", "_").alias("doc_id"), F.regexp_replace("text", "\n$", "").alias("value")).repartition("doc_id").write.partitionBy("doc_id").text(path)


def directory(spark: SparkSession, path: str, extensions: list[str]) -> DataFrame:
    """``path, length, taken, reason`` of all files below ``path``: those with one of the extensions are taken, but for
    transcripts that say ``@Options: dummy`` and videos whose sound stands beside them as wav.  Empty files have no row."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    low = F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1))
    head = F.when(low == "cha", F.decode("content", "utf-8").rlike("(?m)^@Options:\\s.*dummy"))
    rows = found.select("path", "length", low.alias("kind"), head.alias("dummy"), F.regexp_replace("path", r"\.[^./]*$", "").alias("stem"))
    sound = rows.where("kind = 'wav'").select("stem", F.lit(True).alias("sound")).distinct()
    reason = F.when(~F.col("kind").isin(extensions), "extension").when(F.coalesce("dummy", F.lit(False)), "dummy").when((F.col("kind") == "mp4") & F.coalesce("sound", F.lit(False)), "sound is there")
    return rows.join(sound, "stem", "left").select("path", "length", reason.isNull().alias("taken"), reason.alias("reason"))
