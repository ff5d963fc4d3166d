"""Operator 3: exact dedup, with DataFrame operations alone.

Method: an extendible-hash index on shared files.  A text's key is a 64-bit hash of its normalised bytes (A-Z in lower
case, nothing else changed).  The index's directory starts with one bucket and global depth 0.  In each round the buckets
that hold more keys than their capacity split by their next bit; where one of them has the directory's own depth, the
directory doubles.  Rounds go on until no bucket is overfull: a bucket at the full 64 bits holds one key, so there is an end
whatever the number of keys.

Every key is entered.  The directory says which bucket a key belongs to, and the tasks that own the buckets write them to
the shared folder, a bucket's entries side by side in one file, in order of key and chain.  Under a key that occurs once
there is nothing to compare: its entry has the digest alone.  Of the other keys' rows the owner compares the bytes: equal
texts become one entry, texts that differ are chained one after the other, so a collision of hashes never joins two
texts.  Then each row looks its entry up: by the directory to its bucket, by its key, along the chain to its text (whose
SHA-256 the entry keeps).

Equal texts of one task become one row before any shuffle.  A key with more than ``spread`` rows is merged by several
tasks first, so a group of copies, however large, reaches its owner as one row for each ``spread`` copies at most.

Null counts as empty, and empty texts are equal to each other; long texts are compared whole.  Of equal texts the row with
the largest doc_id stays (of several rows with that doc_id and text, all say so: they are one document; rows without
doc_id are less than any, and where no row has one all of them say that they stay).  Every input row gives one row, an
empty table an empty one.  Columns other than the id and the text are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from colloquy.llm.shared import fits, forget, hinted, rows_of, written
from colloquy.llm.urls import LOWER, UPPER

#: Keys that a bucket holds before it splits, at least; and buckets that a directory has, about: with more keys than these
#: hold the capacity is larger, so the directory (24 bytes a bucket) always fits where it is sent.
CAPACITY = 10_000
BUCKETS = 50_000
#: Rows of one key that are merged in one task before they go to their owner.
SPREAD = 10_000
#: Bits by which the table of counts goes deeper than buckets of even size would.
FINE = 4
#: Bytes of repeated keys that may be sent to all executors (keys that fewer bytes hold spare a shuffle of the texts).
KEY_BYTES = 64 << 20


def normalised(text: Column) -> Column:
    """A-Z in lower case.  Texts without other letters than ASCII take the faster way to the same bytes."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def prefix(key: Column, depth: int) -> Column:
    """The first ``depth`` bits (0 to 64) of a key."""
    return F.shiftrightunsigned(key, 64 - depth) if depth else F.lit(0).cast("bigint")  # a shift by 64 would be none at all


def directory(keys: DataFrame, total: int, capacity: int) -> DataFrame:
    """``depth, prefix, n``: the buckets in use, which cover all ``total`` ``keys`` (key; all different), each with at most
    ``capacity`` of them.

    The rounds work on counts by prefix, some 2**FINE to a bucket; only where one of these alone overfills a bucket are
    its keys counted anew by more bits."""

    def counted(some: DataFrame, bits: int) -> DataFrame:
        return written(some.groupBy(prefix(F.col("key"), bits).alias("slot")).agg(F.count(F.lit(1)).alias("n")), "slots")

    fine = min(64, (total // capacity).bit_length() + FINE)
    slots, full, over, depth = counted(keys, fine), None, None, 0
    while True:
        if depth > fine:
            keys = keys.withColumn("prefix", prefix(F.col("key"), depth - 1)).join(hinted(over), "prefix", "left_semi").select("key")
            fine = min(64, fine + FINE)
            slots, over = counted(keys, fine), None
        at = slots.withColumn("prefix", F.shiftrightunsigned("slot", fine - depth) if fine > depth else F.col("slot")) if depth else slots.withColumn("prefix", F.lit(0).cast("bigint"))
        if over is not None:  # the halves of the buckets that were overfull
            at = at.withColumn("parent", F.shiftrightunsigned("prefix", 1)).join(hinted(over).withColumnRenamed("prefix", "parent"), "parent", "left_semi")
        sizes = written(at.groupBy("prefix").agg(F.sum("n").alias("n")), "buckets")
        stand = sizes if depth == 64 else sizes.where(F.col("n") <= capacity)
        stand = stand.select(F.lit(depth).alias("depth"), "prefix", "n")
        full = stand if full is None else full.unionByName(stand)
        over = written(sizes.where(F.col("n") > capacity).select("prefix"), "over")
        if depth == 64 or not rows_of(over):
            return written(full, "directory")
        depth += 1


def placed(rows: DataFrame, buckets: DataFrame) -> DataFrame:
    """``rows`` (with key), and ``depth, prefix`` of the bucket that the directory names for each of them."""
    depths = sorted(r[0] for r in buckets.select("depth").distinct().collect())  # 65 at most, a handful as hashes go
    names = buckets.select("depth", "prefix")
    ways = F.array(*[F.struct(F.lit(d).alias("depth"), prefix(F.col("key"), d).alias("prefix")) for d in depths]).cast("array<struct<depth:int,prefix:bigint>>")
    tried = rows.withColumn("way", F.explode(ways)).select(*rows.columns, "way.depth", "way.prefix")
    return tried.join(F.broadcast(names) if fits(buckets) else names, ["depth", "prefix"])


def index(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", capacity: int = CAPACITY, spread: int = SPREAD, key: Callable[[str], Column] = F.xxhash64) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, directory, entries): ``rows`` has ``doc_id, key, digest`` per input row; ``entries`` has ``depth, prefix`` of
    the bucket, ``key, chain, digest, keep_id, group_size`` per different text.  ``key`` makes the 64-bit key of a text."""
    norm = normalised(F.col(text_column))
    texts = docs.select(F.col(id_column).alias("doc_id"), norm.alias("norm")).withColumns({"key": key("norm").cast("bigint"), "task": F.spark_partition_id()})
    rows = written(texts.select("doc_id", "key", F.unhex(F.sha2("norm", 256)).alias("digest")), "rows")
    keys = written(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("keep_id"), F.max("digest").alias("digest")), "keys")
    buckets = directory(keys.select("key"), rows_of(keys), max(capacity, rows_of(keys) // BUCKETS))
    once = keys.where("n = 1").select("key", "digest", F.lit(None).cast("string").alias("norm"), "keep_id", F.col("n").alias("group_size"))
    again = written(keys.where("n > 1").select("key", "n"), "again")
    found = texts.join(F.broadcast(again) if 16 * rows_of(again) <= KEY_BYTES else again, "key")
    # equal texts of one task become one row here; a task adds to one part of a large group, so parts make no more rows
    part = F.pmod(F.col("task"), F.ceil(F.col("n") / spread)).alias("part")
    found = found.groupBy("key", "norm", part).agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    several = found.select("key", F.lit(None).cast("binary").alias("digest"), "norm", "keep_id", "group_size")
    # one exchange: the owner of a bucket gets all that goes into it, and merges what has equal bytes under one key
    owned = placed(once.unionByName(several), buckets).repartition("depth", "prefix").groupBy("depth", "prefix", "key", "norm")
    owned = owned.agg(F.max("digest").alias("digest"), F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    owned = owned.withColumn("digest", F.coalesce("digest", F.unhex(F.sha2("norm", 256)))).drop("norm")
    chain = F.row_number().over(Window.partitionBy("depth", "prefix", "key").orderBy("digest")) - 1
    entries = owned.withColumn("chain", chain).select("depth", "prefix", "key", "chain", "digest", "keep_id", "group_size")
    entries = written(entries.sortWithinPartitions("depth", "prefix", "key", "chain"), "entries")
    forget(keys, again)
    return rows, buckets, entries


def dedup(docs: DataFrame, **options) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` for each row of ``docs``."""
    rows, buckets, entries = index(docs, **options)
    on = ["depth", "prefix", "key", "digest"]
    rows = placed(rows, buckets)
    # entries that many rows ask for go to the rows, the others meet theirs by bucket and key
    large = entries.where(F.col("group_size") > options.get("spread", SPREAD)).drop("chain")
    if fits(large):
        rest = rows.join(F.broadcast(large.select(on)), on, "left_anti").join(entries.where(F.col("group_size") <= options.get("spread", SPREAD)).drop("chain"), on)
        found = rows.join(F.broadcast(large), on).unionByName(rest)
    else:
        found = rows.join(entries.drop("chain"), on)
    keep = F.coalesce("keep_id", "doc_id")
    return found.select("doc_id", keep.alias("keep_id"), F.col("group_size").cast("bigint").alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def op3_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row and whole text of ``documents``."""
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP3_SQL = f"""
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents),
g AS (SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size, sha256(t) AS text_sha256 FROM n)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""
