"""Operators on lists of files and lexicons: pairing by name, expansion by a lexicon, union of unlike tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from colloquy.schema import FP, REGULAR

#: Bytes of a lexicon that may be broadcast after measuring them.
LEXICON_BYTES = 32 << 20


def small(df: DataFrame) -> DataFrame:
    """``df``, broadcast if its rows, written as JSON, are few bytes."""
    size = df.agg(F.sum(F.octet_length(F.to_json(F.struct(*df.columns))))).first()[0] or 0
    return F.broadcast(df) if size <= LEXICON_BYTES else df


def replaced(forms: DataFrame, lexicon: DataFrame, kind: int) -> DataFrame:
    """Forms whose lower-case text is listed (original, main, lemma; one row a word) with the lemma as their text and
    ``kind`` as their type; :func:`replaced_text` does the same to the lines."""
    found = forms.join(small(lexicon.select("original", "lemma")), F.lower("text") == F.col("original"), "left")
    return found.withColumns({"text": F.coalesce("lemma", "text"), "type": F.when(F.col("lemma").isNull(), F.col("type")).otherwise(kind)}).drop("original", "lemma")


def replaced_text(text: Column, entries: list[tuple[str, str]]) -> Column:
    """A line in which each listed word (original, main), as part of it and whatever its case, is written as main says."""
    return reduce(lambda c, e: F.regexp_replace(c, f"(?iu)\\Q{e[0]}\\E", e[1].replace("\\", r"\\\\").replace("$", r"\$")), entries, text)


def disfluencies(forms: DataFrame, pauses: DataFrame, replacements: DataFrame) -> DataFrame:
    """Forms in which listed filled pauses are filled pauses, then listed words stand for what they replace (both lists:
    original, main, lemma); lists for other languages than English are the caller's."""
    return replaced(replaced(forms, pauses, FP), replacements, REGULAR)


def paired(files: DataFrame, mark: str, other: str) -> DataFrame:
    """``name, partner, error`` of each file: its partner has ``.other.`` where the name has ``.mark.``.  A file without
    the mark, or whose partner is missing, has an error instead."""
    want = F.when(F.col("name").contains(f".{mark}."), F.replace("name", F.lit(f".{mark}."), F.lit(f".{other}.")))
    there = files.select(F.col("name").alias("partner")).distinct()
    found = files.select("name", want.alias("want")).join(there, F.col("want") == F.col("partner"), "left")
    error = F.when(F.col("want").isNull(), f"not a .{mark}. file").when(F.col("partner").isNull(), F.concat(F.lit("missing: "), "want"))
    return found.select("name", "partner", error.alias("error"))


def expanded(forms: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Forms whose lower-case text is in ``lexicon`` (word, parts) with their parts, other forms with themselves alone.
    A word has one row in the lexicon."""
    found = forms.join(small(lexicon), F.lower("text") == F.col("word"), "left")
    return found.withColumn("parts", F.coalesce("parts", F.array("text"))).drop("word")


def table_union(tables: list[DataFrame]) -> DataFrame:
    """All rows; the columns are those of the first table, then new ones in the order in which they come up."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def summary(rows: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """Peak, least, mean and number of samples."""
    return rows.groupBy(*keys).agg(F.max(value).alias("peak"), F.min(value).alias("least"), F.avg(value).alias("mean"), F.count(value).alias("n"))
