"""Operator 5: substring dedup.

Method: the Rabin-Karp hash of every window of ``width`` words goes, with its document and position, to the task that
owns its range of hashes; there the windows are counted, and a window that also starts in a document with a smaller
doc_id is due for removal.  The positions go back to their documents, where overlapping windows merge into maximal
removal intervals.

Windows are judged on the input.  The words (runs without ASCII white space) are taken as they are.  Null counts as a
text without words; a text with fewer than ``width`` words has no window and loses nothing; long texts are taken whole.
Repeats inside one document alone stay.  Equal rows have equal results.  Rows with one doc_id and different texts are one
document as to which is smaller, so they remove nothing from each other, and each loses its own words; a row without
doc_id comes after every other (with 2**63-1) and loses what starts in one of those.  An empty table gives an empty
table.  Columns other than doc_id and text are not read, whatever their names.

Windows are told apart by 64-bit hashes of their words' 64-bit hashes, rows by 64 bits of doc_id and text: among n
different ones n*n/2**65 pairs are expected to be mistaken for each other (0.001 among 2*10**8).

Shuffled are some 10 bytes a window, in packed rows.  The ranges of hashes are as many as the bytes of all texts ask for,
so that a range's windows fit in a bounded part of a task's memory, and each goes to a partition of its own.  A window
that is very frequent inside one chunk of a task (shared boilerplate) goes as one entry for the chunk; what it has to
remove is found in another pass over the documents, in blocks of a bounded number of such windows.  So no task's share
grows with the frequency of a window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from colloquy.llm.packing import batch as record, binaries, bucket_of, planes, runs, unplanes
from colloquy.llm.shared import bounded, deal, fits, keyed_semi, written
from colloquy.llm.words import buffers, mix, rolling, slices, word_hashes

WIDTH = 13
#: Words of a chunk, whose windows are packed together; occurrences in a chunk that make a window frequent.
CHUNK_WORDS = 1 << 19
FREQUENT = 256
#: Frequent windows that one more pass handles.
FREQUENT_BLOCK = 500_000
#: Stands for a missing doc_id where ids are compared.
LAST_ID = 2**63 - 1
#: Bytes of texts whose windows one range of hashes takes, and bytes of removals' texts that one group of rows takes.
RANGE_BYTES = 24 << 20
_PACKED = "bucket int, kind int, hashes binary, docs binary, rows binary, sizes binary, steps binary"
_STARTS = "row bigint, positions binary"


def windows(batches: Iterator[pa.RecordBatch], width: int, chunk: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(hash, doc_id, row, position) of all windows, chunk by chunk; a document lies in one chunk."""
    kept, words = [], 0
    for whole in batches:
        for part in slices(whole, "text"):
            hashes, firsts = word_hashes(*buffers(part.column(1)), lower=False)
            rolled = rolling(hashes, width)
            size = np.diff(firsts)
            n = np.maximum(size - width + 1, 0)
            ids, own = (np.repeat(part.column(c).to_numpy(zero_copy_only=False).astype(np.int64), n) for c in (0, 2))
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            kept.append((rolled[np.repeat(firsts[:-1], n) + at], ids, own, at.astype(np.int32)))
            words += len(hashes)
            if words >= chunk:
                yield tuple(np.concatenate(x) for x in zip(*kept, strict=True))
                kept, words = [], 0
    if kept:
        yield tuple(np.concatenate(x) for x in zip(*kept, strict=True))


def _pack(width: int, chunk: int, frequent: int, labels: list[int], keyed: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, doc, row, at in windows(batches, width, chunk):
            order = np.argsort(h, kind="stable")
            hs = h[order]
            begin = runs(hs)
            count = np.diff(np.append(begin, len(hs)))
            # windows that are frequent in this chunk: one entry, with the smallest document
            often = np.flatnonzero(count > frequent)
            if len(often):
                least = np.minimum.reduceat(doc[order], begin)[often]
                for b, one in _by_bucket(hs[begin[often]], labels):
                    yield _row(b, 1, hs[begin[often]][one], least[one], None, np.zeros(len(one), np.int64))
                keep = np.ones(len(h), bool)
                keep[order[np.repeat(count > frequent, count)]] = False
                h, doc, row, at = h[keep], doc[keep], row[keep], at[keep]
            for b, some in _by_bucket(h, labels):
                yield _row(b, 0, h[some], doc[some], row[some] if keyed else None, at[some])

    return run


def _by_bucket(h: np.ndarray, labels: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    bucket = bucket_of(h, len(labels))
    order = np.argsort(bucket.astype(np.uint16 if len(labels) < 1 << 16 else np.int64), kind="stable")
    for s in np.split(order, runs(bucket[order])[1:]):
        if len(s):
            yield labels[int(bucket[s[0]])], s


def _row(label: int, kind: int, h: np.ndarray | None, doc: np.ndarray, row: np.ndarray | None, at: np.ndarray) -> pa.RecordBatch:
    """A packed row; without ``row`` the ids in ``doc`` stand for rows too."""
    plain, row = row is None, doc if row is None else row
    begin = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (row[1:] != row[:-1])])) if len(doc) else np.zeros(0, np.int64)
    size = np.diff(np.append(begin, len(doc)))
    # the first position in a document stands as it is, the next ones as distances
    step = np.diff(at.astype(np.int64), prepend=0)
    step[begin] = at[begin]
    low = step.astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes()
    return record(
        bucket=pa.array([label], pa.int32()),
        kind=pa.array([kind], pa.int32()),
        hashes=pa.array([None if h is None else h.astype("<u8").tobytes()], pa.binary()),
        docs=pa.array([planes(doc[begin])], pa.binary()),
        rows=pa.array([None if plain else row[begin].astype("<i8").tobytes()], pa.binary()),
        sizes=pa.array([planes(np.cumsum(size), 4)], pa.binary()),
        steps=pa.array([low], pa.binary()),
    )


def _unpacked(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, doc_id, row, position, kind) of packed rows; no hashes where the rows have none."""
    hs, docs, rows, ats, kinds = [], [], [], [], []
    for k, h, d, r, n, s in zip(table.column("kind").to_pylist(), *(binaries(table.column(c)) for c in ("hashes", "docs", "rows", "sizes", "steps")), strict=True):
        size = np.diff(unplanes(n, 4), prepend=0)
        step = np.frombuffer(s, np.uint8).reshape(4, -1).T.copy().view("<i4").ravel()
        total = np.cumsum(step, dtype=np.int64)
        first = np.cumsum(size) - size
        hs.append(np.frombuffer(h, "<u8"))
        docs.append(np.repeat(unplanes(d), size))
        rows.append(np.repeat(np.frombuffer(r, "<i8"), size) if r else docs[-1])
        ats.append((total - np.repeat(total[first] - step[first], size)).astype(np.int32))
        kinds.append(np.full(len(step), k, np.int8))
    return tuple(np.concatenate(x) for x in (hs, docs, rows, ats, kinds))


def _resolve(labels: list[int]):
    """The owner of a range of hashes: what is due for removal, packed for groups of rows, one for each label (kind 0), and
    frequent windows with their smallest document (kind 1)."""

    def run(table: pa.Table) -> pa.Table:
        h, doc, row, at, k = _unpacked(table)
        order = np.argsort(h, kind="stable")
        sorted_h = h[order]
        again = np.zeros(len(h), bool)
        same = sorted_h[1:] == sorted_h[:-1]
        again[1:] |= same
        again[:-1] |= same
        order = order[again | (k[order] == 1)]
        h, doc, row, at, k = h[order], doc[order], row[order], at[order], k[order]
        begin = runs(h)
        out = []
        if len(begin):
            least = np.repeat(np.minimum.reduceat(doc, begin), np.diff(np.append(begin, len(h))))
            often = np.flatnonzero(k == 1)
            if len(often):
                _, one = np.unique(h[often], return_index=True)
                often = often[one]
                out.append(_row(0, 1, h[often], least[often], None, np.zeros(len(often), np.int64)))
            gone = np.flatnonzero((k == 0) & (doc > least))
            group = bucket_of(mix(row[gone].view(np.uint64)), len(labels))
            gone = gone[np.lexsort((at[gone], row[gone], group))]
            group = np.sort(group)
            out += [_row(labels[int(group[s[0]])], 0, None, row[gone[s]], None, at[gone[s]]) for s in np.split(np.arange(len(gone)), runs(group)[1:]) if len(s)]
        return pa.Table.from_batches(out) if out else table.slice(0, 0).select(["bucket", "kind", "hashes", "docs", "rows", "sizes", "steps"])

    return run


def _starts(row: np.ndarray, at: np.ndarray) -> pa.Table:
    """One row per document; ``row`` in runs."""
    first = runs(row)
    lists = [x.astype("<i4").tobytes() for x in np.split(at, first[1:])] if len(row) else []
    return pa.table({"row": pa.array(row[first], pa.int64()), "positions": pa.array(lists, pa.binary())})


def _gather(table: pa.Table) -> pa.Table:
    _, _, row, at, _ = _unpacked(table)
    order = np.lexsort((at, row))
    row, at = row[order], at[order]
    new = np.ones(len(row), bool)  # equal rows have said the same
    new[1:] = (row[1:] != row[:-1]) | (at[1:] != at[:-1])
    return _starts(row[new], at[new])


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        h, least, _, _, _ = _unpacked(pa.Table.from_batches([b]))
        yield record(hash=pa.array(h.view(np.int64)), least=pa.array(least))


def _frequent(docs: DataFrame, heavy: list[tuple[int, int]], width: int, chunk: int) -> DataFrame:
    keys = np.array([x[0] for x in heavy], np.int64).view(np.uint64)
    order = np.argsort(keys)
    shipped = docs.sparkSession.sparkContext.broadcast((keys[order], np.array([x[1] for x in heavy], np.int64)[order]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, least = shipped.value
        for h, doc, row, at in windows(batches, width, chunk):
            k = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            gone = np.flatnonzero((keys[k] == h) & (doc > least[k]))
            if len(gone):
                yield from _starts(row[gone], at[gone]).to_batches()

    return docs.mapInArrow(run, _STARTS)


def repeated(docs: DataFrame, keyed: bool, *, width: int = WIDTH, chunk: int = CHUNK_WORDS, frequent: int = FREQUENT) -> DataFrame:
    """``row, positions`` (list of binary, 32-bit word numbers): starts of the windows to remove, for the rows that have
    any.  ``docs``: doc_id without nulls, text, row (the same for equal rows alone; ``keyed``: it is not just the doc_id)."""
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    labels = deal(spark, max(2 * partitions, -(-size // RANGE_BYTES)))
    packed = docs.mapInArrow(_pack(width, chunk, frequent, labels, keyed), _PACKED)
    found = written(packed.groupBy("bucket").applyInArrow(_resolve(labels[: max(partitions, len(labels) // 2)]), _PACKED), "repeated")
    starts = found.where("kind = 0").groupBy("bucket").applyInArrow(_gather, _STARTS)
    heavy = found.where("kind = 1").mapInArrow(_spread, "hash bigint, least bigint")
    blocks = -(-heavy.count() // FREQUENT_BLOCK)
    for b in range(blocks):  # each block is bounded; there are several only if very many windows are frequent
        own = heavy.where(F.pmod("hash", F.lit(blocks)) == b) if blocks > 1 else heavy
        starts = starts.unionByName(_frequent(docs, [(r[0], r[1]) for r in own.collect()], width, chunk))
    return starts.groupBy("row").agg(F.collect_set("positions").alias("positions"))


_KEPT = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, kept string, spans array<struct<start:int,end:int>>"


def _remove(width: int, keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, "text"):
                out = []
                for doc, text, lists in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    words = (text or "").encode().split()
                    n, spans = len(words), []
                    if lists:
                        at = np.unique(np.frombuffer(b"".join(lists), "<i4")).astype(np.int64)
                        breaks = np.flatnonzero(np.diff(at) > width) + 1
                        begin, end = at[np.concatenate([[0], breaks])], at[np.concatenate([breaks - 1, [len(at) - 1]])] + width
                        spans = list(zip(begin.tolist(), end.tolist(), strict=True))
                        left, k = [], 0
                        for s, e in spans:
                            left += words[k:s]
                            k = e
                        words = left + words[k:]
                    kept = b" ".join(words)
                    out.append((doc, n, n - len(words), hashlib.sha256(kept).hexdigest(), kept.decode() if keep_text else None, [{"start": s, "end": e} for s, e in spans] if keep_text else None))
                columns = list(zip(*out, strict=True))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept", "spans"])

    return run


def dedup_substrings(docs: DataFrame, *, width: int = WIDTH, keep_text: bool = True, chunk: int = CHUNK_WORDS, frequent: int = FREQUENT) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` and, with ``keep_text``, ``kept`` and the removed ``spans`` of words."""
    bounded(docs)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    # where doc_ids name rows they are enough; else rows are told apart by their texts too, at 8 more bytes for each range
    keyed = not docs.groupBy("doc_id").count().where("doc_id IS NULL OR count > 1").isEmpty()
    docs = docs.withColumn("row", F.xxhash64("doc_id", F.coalesce("text", F.lit(""))) if keyed else F.col("doc_id"))
    asked = docs.select(F.coalesce("doc_id", F.lit(LAST_ID)).alias("doc_id"), "text", "row")
    hits = written(repeated(asked, keyed, width=width, chunk=chunk, frequent=frequent), "removed")
    # only rows that lose something are shuffled to their positions
    ids = hits.select("row")
    if fits(ids):
        touched = keyed_semi(docs, ids, "row").join(hits, "row").select("doc_id", "text", "positions")
        rest = keyed_semi(docs, ids, "row", "left_anti").select("doc_id", "text", F.expr("CAST(NULL AS array<binary>)").alias("positions"))
        both = touched.unionByName(rest)
    else:
        both = docs.join(hits, "row", "left").select("doc_id", "text", "positions")
    return both.mapInArrow(_remove(width, keep_text), _KEPT)


def op5_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All windows of 13 words of ``documents``."""
    return dedup_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep_text=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


OP5_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, i, array_to_string(w[i:i + {WIDTH - 1}], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WIDTH - 2})) AS i FROM d)),
m AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS least FROM s),
r AS (SELECT DISTINCT doc_id, unnest(range(i, i + {WIDTH})) AS k FROM m WHERE doc_id > least),
e AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS k, unnest(w) AS x FROM d),
k AS (SELECT e.doc_id, count(r.k) AS n_removed, string_agg(CASE WHEN r.k IS NULL THEN e.x END, ' ' ORDER BY e.k) AS kept
      FROM e LEFT JOIN r ON e.doc_id = r.doc_id AND e.k = r.k GROUP BY e.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON d.doc_id = k.doc_id
"""
