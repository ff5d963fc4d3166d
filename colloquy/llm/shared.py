"""Tables in the folder that the driver and all executors share.

Intermediate results that several jobs read are written as Parquet below ``spark.checkpoint.dir``, so a lost
executor costs a reread, never a wrong answer.  Where the setting is missing in a session that runs in one process
(tests), a folder below the warehouse is chosen and recorded in the session; on a cluster that is an error.
"""

from __future__ import annotations

import atexit
import re
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.types import AtomicType, BinaryType, NumericType, StringType

#: Bytes of a table that may be broadcast, measured before: rows times columns of 8 bytes, and the bytes of strings.
BROADCAST_BYTES = 4 << 20
#: Rows and bytes of an Arrow batch.
BATCH_ROWS, BATCH_BYTES = 1_000, 16 << 20
_left: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, from the session; own folder below the warehouse only where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def bounded(df: DataFrame) -> SparkSession:
    """The session, in which Arrow batches are from now on BATCH_ROWS rows and BATCH_BYTES bytes at most (a row that is
    longer is a batch of its own): a batch of texts fits in memory."""
    spark, key = df.sparkSession, "spark.sql.execution.arrow.max{}PerBatch"
    if not 0 < int(spark.conf.get(key.format("Records"))) <= BATCH_ROWS:
        spark.conf.set(key.format("Records"), str(BATCH_ROWS))
    spark.conf.set(key.format("Bytes"), str(BATCH_BYTES))
    return spark


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back; the lineage ends there.  The rows are counted, and a checksum
    of them is taken, as they are written: see :func:`rows_of` and :func:`mark_of`.

    A table goes when it is given to :func:`forget`, or else when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/colloquy-{name}-{uuid.uuid4().hex}"
    seen = Observation()
    counted = df.observe(seen, F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64(*[f.name for f in df.schema if isinstance(f.dataType, NumericType)] or [F.lit(0)])).alias("mark"))
    counted.write.option("compression", "zstd").parquet(path)
    if not _left:
        atexit.register(_remove_all, spark)
    _left.add(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._colloquy = (path, seen.get["n"], seen.get["mark"])  # noqa: SLF001
    return out


def rows_of(df: DataFrame) -> int:
    """Rows of a table of :func:`written`, without a job."""
    return df._colloquy[1]


def mark_of(df: DataFrame) -> tuple[int, int | None]:
    """Rows and checksum of the numbers of a table of :func:`written`, in any order of its rows."""
    return df._colloquy[1:]


def forget(*tables: DataFrame) -> None:
    """Remove tables of :func:`written` that nothing will read again."""
    for t in tables:
        path = getattr(t, "_colloquy", (None,))[0]
        if path in _left:
            _left.discard(path)
            _remove(t.sparkSession, path)


def _remove_all(spark: SparkSession) -> None:
    for path in _left:
        _remove(spark, path)


def fits(df: DataFrame) -> bool:
    """Whether the measured size of ``df`` allows to broadcast it; columns other than strings and numbers never do."""
    if not all(isinstance(f.dataType, AtomicType) for f in df.schema):
        return False
    long = [f.name for f in df.schema if isinstance(f.dataType, StringType | BinaryType)]
    if hasattr(df, "_colloquy") and (not long or 8 * len(df.columns) * rows_of(df) > BROADCAST_BYTES):
        return 8 * len(df.columns) * rows_of(df) <= BROADCAST_BYTES
    n, *sizes = df.agg(F.count(F.lit(1)), *[F.sum(F.octet_length(c)) for c in long]).first()
    return 8 * len(df.columns) * n + sum(x or 0 for x in sizes) <= BROADCAST_BYTES


def hinted(df: DataFrame) -> DataFrame:
    """``df``, to be broadcast if it fits."""
    return F.broadcast(df) if fits(df) else df


def keyed_semi(df: DataFrame, keys: DataFrame, on: str, how: str = "left_semi") -> DataFrame:
    """Semi or anti join with a table of keys that is broadcast only if it fits."""
    return df.join(F.broadcast(keys) if fits(keys) else keys, on, how)


def deal(spark: SparkSession, n: int) -> list[int]:
    """``n`` different integers such that an exchange by one of them as a key (int) gives each partition the same number of
    them, as near as can be: groups that are dealt by these labels never meet in one partition while another has none."""
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    per = -(-n // partitions)
    found: list[list[int]] = [[] for _ in range(partitions)]
    low, left = 0, n
    while left > 0:
        size = max(1024, 2 * n)
        some = spark.range(low, low + size, 1, 1).select("id", F.pmod(F.hash(F.col("id").cast("int")), F.lit(partitions)).alias("p")).toPandas()
        for label, p in zip(some["id"].tolist(), some["p"].tolist(), strict=True):
            if len(found[p]) < per:
                found[p].append(label)
        low += size
        left = n - sum(map(len, found))
    return [x for row in zip(*[f + [None] * (per - len(f)) for f in found], strict=True) for x in row if x is not None][:n]


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # noqa: BLE001  the application is ending; the folder's owner removes what is left
        pass
