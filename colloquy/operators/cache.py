"""Content-addressed result cache: look up by key, compute the misses, write back; the last write wins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from colloquy.functions.text import cache_key

ENTRY = "key string, task string, engine_version string, created_at string, data string"


def tag_key(text: Column, lang: Column, retokenize: Column, mwt: Column) -> Column:
    return cache_key(text, lang, F.when(retokenize, "1").otherwise("0"), mwt)


def parts_digest(lexicon: DataFrame) -> str:
    """Digest of a lexicon of words that stand for several (word, parts), whatever the order of its rows; empty for an
    empty one.  A lexicon is a dimension table of bounded size: one row comes to the driver."""
    line = F.to_json(F.struct("word", "parts"))
    found = lexicon.agg(F.sha2(F.array_join(F.array_sort(F.collect_set(line)), "\n"), 256).alias("x"), F.count(F.lit(1)).alias("n")).first()
    return found["x"] if found["n"] else ""


def split_key(text: Column, lang: Column) -> Column:
    """Key of a line's split into utterances."""
    return cache_key(text, lang)


def alignment_key(text: Column, audio: Column, pauses: Column) -> Column:
    """Key of a group's forced alignment; ``audio``: digest of its sound."""
    return cache_key(audio, text, F.when(pauses, "1").otherwise("0"))


_TAGS = "morphology:array<array<struct<lemma:string,pos:string,feats:string>>>,dependency:array<array<struct<id:int,dep_id:int,dep_type:string>>>,retokenized_text:string"
_BULLET = "\x15\\d+_\\d+\x15"


def tags_data(forms: Column, text: Column, retokenize: Column) -> Column:
    """Entry of a tagged line: morphology and dependency of each form, and the retokenized text without its bullet."""
    plain = F.trim(F.regexp_replace(text, _BULLET, ""))
    return F.to_json(F.struct(F.transform(forms, lambda x: x["morphology"]).alias("morphology"), F.transform(forms, lambda x: x["dependency"]).alias("dependency"), F.when(retokenize, plain).alias("retokenized_text")))


def tagged(lines: DataFrame) -> DataFrame:
    """Lines (forms, text, data) with the entry's tags on their forms; an entry for another number of forms is ignored.
    The entry's text replaces the line's, whose own bullet stays."""
    read = lines.withColumn("d", F.from_json("data", f"struct<{_TAGS}>"))
    fits = F.size("d.morphology") == F.size("forms")
    # joined by position, so that the entry is read once for a line and not once for each form
    tags = F.arrays_zip(F.col("d.morphology").alias("morphology"), F.coalesce(F.col("d.dependency"), F.array().cast("array<array<struct<id:int,dep_id:int,dep_type:string>>>")).alias("dependency"))
    forms = F.zip_with("forms", tags, lambda x, t: x.withField("morphology", F.coalesce(t["morphology"], x["morphology"])).withField("dependency", F.coalesce(t["dependency"], x["dependency"])))
    bullet = F.regexp_extract(F.coalesce("text", F.lit("")), f"({_BULLET})", 1)
    text = F.trim(F.concat_ws(" ", F.trim(F.regexp_replace("d.retokenized_text", _BULLET, "")), bullet))
    return read.withColumns({"forms": F.when(fits, forms).otherwise(F.col("forms")), "text": F.when(fits & F.col("d.retokenized_text").isNotNull(), text).otherwise(F.col("text"))}).drop("d")


_SPLIT = "utterances:array<struct<content:array<struct<text:string,type:int,time:array<bigint>>>,text:string,time:array<bigint>>>"


def split_data(pieces: Column) -> Column:
    """Entry of a line that became several: ``pieces`` is an array of (forms, text, start_ms, end_ms)."""
    time = lambda x: F.when(x["start_ms"].isNotNull(), F.array(x["start_ms"], x["end_ms"]))
    one = lambda u: F.struct(F.transform(u["forms"], lambda f: F.struct(f["text"].alias("text"), f["type"].cast("int").alias("type"), time(f).alias("time"))).alias("content"), u["text"].alias("text"), time(u).alias("time"))
    return F.to_json(F.struct(F.transform(pieces, one).alias("utterances")))


def split_lines(lines: DataFrame) -> DataFrame:
    """The pieces of lines (doc_id, line_no, tier, data): ``doc_id, line_no, tier, piece, forms, text, start_ms, end_ms``."""
    read = lines.withColumn("d", F.from_json("data", f"struct<{_SPLIT}>")).select("doc_id", "line_no", "tier", F.posexplode("d.utterances").alias("piece", "u"))
    form = lambda f: F.struct(f["text"].alias("text"), f["type"].alias("type"), F.get(f["time"], F.lit(0)).alias("start_ms"), F.get(f["time"], F.lit(1)).alias("end_ms"))
    return read.select("doc_id", "line_no", "tier", "piece", F.transform("u.content", form).alias("forms"), F.col("u.text").alias("text"), F.get("u.time", F.lit(0)).alias("start_ms"), F.get("u.time", F.lit(1)).alias("end_ms"))


def timings_data(times: Column) -> Column:
    """Entry of a group's forced alignment: ``times`` is an array of (start_ms, end_ms) or null."""
    return F.to_json(F.struct(F.transform(times, lambda t: F.when(t.isNotNull(), F.array(t["start_ms"], t["end_ms"]))).alias("timings")), {"ignoreNullFields": "false"})


def timings(data: Column) -> Column:
    read = F.from_json(data, "struct<timings:array<array<bigint>>>")["timings"]
    return F.transform(read, lambda t: F.when(t.isNotNull(), F.struct(F.get(t, F.lit(0)).alias("start_ms"), F.get(t, F.lit(1)).alias("end_ms"))))


def cleared(cache: DataFrame) -> tuple[DataFrame, int]:
    """(an empty cache, bytes of data that the old one held)."""
    return cache.limit(0), cache.agg(F.coalesce(F.sum(F.octet_length("data")), F.lit(0))).first()[0]


def _current(cache: DataFrame, task: str, version: str) -> DataFrame:
    return cache.where((F.col("task") == task) & (F.col("engine_version") == version))


def hits(rows: DataFrame, cache: DataFrame, task: str, version: str) -> DataFrame:
    """Rows with ``data``, for the keys that the cache holds for this task and version."""
    return rows.join(latest(_current(cache, task, version)).select("key", "data"), "key")


def misses(rows: DataFrame, cache: DataFrame, task: str, version: str) -> DataFrame:
    return rows.join(_current(cache, task, version).select("key"), "key", "left_anti")


def latest(cache: DataFrame) -> DataFrame:
    """One entry per (key, task): the newest; of equally new ones the largest data.  Aggregated, so that a key with very
    many entries is merged where they lie first."""
    rest = [c for c in cache.columns if c not in ("key", "task", "created_at", "data")]
    newest = cache.groupBy("key", "task").agg(F.max(F.struct("created_at", "data", *rest)).alias("x"))
    return newest.select(*[c if c in ("key", "task") else F.col(f"x.{c}").alias(c) for c in cache.columns])


def resolve(rows: DataFrame, cache: DataFrame, task: str, version: str, now: str, compute: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(all rows with data, the new cache).  ``compute`` gets one row for each missing key (of several the smallest as
    JSON) and adds ``data``; its result is kept, so a model runs once although both frames read it."""
    row = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
    todo = misses(rows, cache, task, version).groupBy("key").agg(F.min_by(row, F.to_json(row)).alias("x")).select("x.*")
    added = compute(todo).select("key", F.lit(task).alias("task"), F.lit(version).alias("engine_version"), F.lit(now).alias("created_at"), "data").persist()
    new = latest(cache.unionByName(added))
    return rows.join(_current(new, task, version).select("key", "data"), "key"), new


def stats(cache: DataFrame) -> DataFrame:
    """Counts overall, by task, and by task and version, in one pass."""
    return cache.groupingSets([["task", "engine_version"], ["task"], []], "task", "engine_version").agg(F.count(F.lit(1)).alias("n"))
