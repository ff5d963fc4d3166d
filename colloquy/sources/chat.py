"""CHAT transcripts: scan, lexer, dependent tiers, sink.

Lines are handled natively; only the lexer, a recursive grammar, runs in Arrow batches.  A line that cannot be lexed
becomes an error row, never a failed job.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from colloquy.functions.text import ANNOTATION_CHARS, bullet, language_override
from colloquy.schema import ANNOT, CORRECTION, ENDING_PUNCT, FEAT, FP, MOR_PUNCT, NO_CONTENT, NORMAL_MARKS, PUNCT, REGULAR, REPEAT_MARKS, RETRACE

_MARKS = re.compile("[" + re.escape(ANNOTATION_CHARS) + "]")


def clean_word(text: str, special: bool = False) -> str:
    """:func:`colloquy.functions.text.annotation_clean` for one string."""
    text = re.sub("\x15\\d+_\\d+\x15", "", text.replace("[/]", ""))
    text = text if special else re.sub(r"&~\w+", "", text)
    return re.sub("@[^abcefpoqsw]", "", _MARKS.sub("", text).replace("//", ""))


def pieces(line: str) -> Iterator[str]:
    """Words, ``<groups>`` and ``[codes]`` of a line, groups and codes whole with what they hold."""
    k, n = 0, len(line)
    while k < n:
        if line[k] == " ":
            k += 1
            continue
        start = k
        if line[k] in "<[":
            opening, closing, depth = line[k], ">" if line[k] == "<" else "]", 0
            while k < n:
                mark = next((m for m in (*REPEAT_MARKS, *NORMAL_MARKS) if opening == "<" and line.startswith(m, k)), None)
                if mark:
                    k += len(mark)
                    continue
                depth += (line[k] == opening) - (line[k] == closing)
                k += 1
                if not depth:
                    break
            if depth:
                raise ValueError(f"a group does not end: {line[start:]}")
        else:
            while k < n and line[k] != " ":
                k += 1
        yield line[start:k]


def lex(line: str) -> list[tuple[str, int]]:
    """(text, type) of the forms of a main line."""
    clauses: list[list[tuple[str, int]]] = []
    for x in pieces(line.strip()):
        bare = x.lstrip("⌈")
        if bare.startswith("&-"):
            clauses.append([(clean_word(x), FP)])
        elif x in ENDING_PUNCT:
            clauses.append([(x, PUNCT)])
        elif bare.startswith("&"):
            clauses.append([(x, ANNOT)])
        elif x in REPEAT_MARKS:  # what stands before is repeated: all of it
            if not clauses:
                raise ValueError(f"nothing stands before {x}: {line}")
            clauses[-1] = [(t, RETRACE) for t, _ in clauses[-1]]
        elif x in NORMAL_MARKS:
            last = clauses.pop() if clauses else []
            if not (len(last) == 1 and last[0][1] == FP):
                clauses += [[f] for f in last if f[0] not in NO_CONTENT and not f[0].startswith("&")]
        elif x[0] == "<":
            clauses.append(lex(x[1:-1]))
        elif x.startswith("[:"):
            if not clauses:
                raise ValueError(f"nothing stands before {x}: {line}")
            clauses[-1] = lex(x[1:-1].lstrip(":"))
        elif x[0] == "[":
            continue
        elif x in MOR_PUNCT:
            clauses.append([(x, PUNCT)])
        else:
            word = clean_word(x).strip()
            kind = FEAT if not word else ANNOT if word in NO_CONTENT else REGULAR
            if kind == REGULAR and word.startswith("0") and len(word) > 1:
                word, kind = word[1:], CORRECTION
            clauses.append([(x if kind == FEAT else word, kind)])
    return [f for c in clauses for f in c]


@F.pandas_udf(StructType([StructField("forms", ArrayType(StructType([StructField("text", StringType()), StructField("type", IntegerType())]))), StructField("error", StringType())]))
def lexed(line: pd.Series) -> pd.DataFrame:
    out = []
    for x in line:
        try:
            out.append(([{"text": t, "type": k} for t, k in lex(x or "")], None))
        except ValueError as e:
            out.append((None, str(e)))
    return pd.DataFrame(out, columns=["forms", "error"])


def scan(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, line_no, kind, id, content`` of all ``.cha`` files below ``path``; continuation lines are joined."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.cha").text(path, wholetext=True)
    return lines(files.select(F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("text")))


def lines(files: DataFrame) -> DataFrame:
    joined = F.regexp_replace(F.regexp_replace("text", "\r\n?", "\n"), "\n\t", " ")
    rows = files.select("doc_id", F.posexplode(F.split(joined, "\n")).alias("line_no", "line")).where("trim(line) <> ''")
    head, first = F.substring_index("line", ":\t", 1), F.substring("line", 1, 1)
    kind = F.when(first == "@", "header").when(first == "*", "main").when(first == "%", "dependent").otherwise("other")
    has = F.instr("line", ":\t") > 0
    return rows.select("doc_id", "line_no", kind.alias("kind"), F.when(kind == "other", F.lit(None)).otherwise(F.regexp_replace(head, "^[@*%]", "")).alias("id"), F.when(has, F.expr("substr(line, instr(line, ':\t') + 2)")).otherwise(F.lit("")).alias("content"))


def headers(rows: DataFrame) -> DataFrame:
    """``doc_id, langs, media, participants`` from the header lines."""
    h = rows.where("kind = 'header'")
    pick = lambda name: F.first(F.when(F.col("id") == name, F.col("content")), ignorenulls=True)
    langs = F.transform(F.split(pick("Languages"), ","), lambda x: F.trim(x))
    return h.groupBy("doc_id").agg(langs.alias("langs"), pick("Media").alias("media"), F.sort_array(F.collect_list(F.when(F.col("id") == "ID", F.col("content")))).alias("participants"))


def mains(rows: DataFrame) -> DataFrame:
    """``doc_id, line_no, tier, text, override_lang, start_ms, end_ms, mor, gra``: main lines with their dependent tiers."""
    w = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    owner = F.last(F.when(F.col("kind") == "main", F.col("line_no")), ignorenulls=True).over(w)
    owned = rows.withColumn("owner", owner).where("kind IN ('main', 'dependent') AND owner IS NOT NULL")
    pick = lambda test: F.first(F.when(test, F.col("content")), ignorenulls=True)
    out = owned.groupBy("doc_id", F.col("owner").alias("line_no")).agg(
        F.first(F.when(F.col("kind") == "main", F.col("id")), ignorenulls=True).alias("tier"), pick(F.col("kind") == "main").alias("raw"), pick(F.col("id") == "mor").alias("mor"), pick(F.col("id") == "gra").alias("gra")
    )
    start, end = bullet(F.col("raw"))
    text = F.trim(F.regexp_replace("raw", "\x15\\d+_\\d+\x15", ""))
    return out.select("doc_id", "line_no", "tier", text.alias("text"), language_override(text).alias("override_lang"), start.alias("start_ms"), end.alias("end_ms"), "mor", "gra")


def utterances(rows: DataFrame) -> DataFrame:
    """:func:`mains` with ``forms`` and ``error`` from the lexer."""
    got = mains(rows).withColumn("lexed", lexed("text"))
    return got.select("*", "lexed.forms", "lexed.error").drop("lexed")


def mor_items(mor: Column) -> Column:
    """Structs (pos, lemma, feats) of a ``%mor`` line, clitics as items of their own."""
    feats = lambda x: F.split(F.element_at(F.split(x, r"\|"), -1), "-")
    one = lambda x: F.struct(F.substring_index(x, "|", 1).alias("pos"), feats(x)[0].alias("lemma"), F.array_join(F.slice(feats(x), F.lit(2), F.size(feats(x))), "-").alias("feats"))
    return F.transform(F.split(mor, "[ ~$]"), one)


def main_line(tier: Column, text: Column, start: Column, end: Column) -> Column:
    return F.concat(F.lit("*"), tier, F.lit(":\t"), text, F.when(start.isNotNull() & end.isNotNull(), F.concat(F.lit(" \x15"), start.cast("string"), F.lit("_"), end.cast("string"), F.lit("\x15"))).otherwise(F.lit("")))


def documents(lines: DataFrame, lang: str = "eng", corpus: str = "corpus") -> DataFrame:
    """``doc_id, text``: plain CHAT files of utterances (doc_id, line_no, tier, text, start_ms, end_ms) alone; see
    :mod:`colloquy.sources.documents` for headers, dependent tiers and one file a document."""
    line = main_line(F.col("tier"), F.col("text"), F.col("start_ms"), F.col("end_ms"))
    body = lines.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("line_no", line.alias("x")))).alias("x"), F.array_sort(F.collect_set("tier")).alias("tiers"))
    ids = F.transform("tiers", lambda t: F.concat(F.lit(f"@ID:\t{lang}|{corpus}|"), t, F.lit("|||||"), t, F.lit("|||")))
    head = F.concat(F.array(F.lit("@UTF8"), F.lit("@Begin"), F.lit(f"@Languages:\t{lang}"), F.concat(F.lit("@Participants:\t"), F.array_join(F.transform("tiers", lambda t: F.concat_ws(" ", t, t)), ", "))), ids)
    return body.select("doc_id", F.array_join(F.concat(head, F.transform("x", lambda v: v["x"]), F.array(F.lit("@End"))), "\n").alias("text"))


def write(lines: DataFrame, path: str) -> None:
    """One text file per partition, documents whole."""
    documents(lines).select(F.col("text").alias("value")).write.text(path)
