"""Operator 8: benchmark decontamination.

Method: Wu-Manber search for many patterns, on words.  The patterns are the windows of the test items.  For each window
length there is a table of shifts, indexed by the hash of a block of words: how far the window's end may move before
the block could end a pattern's prefix.  Positions within a shift are skipped; at shift 0 the hash of the whole window
selects a bucket of test strings, and the words themselves are compared.

Words: runs of ASCII letters and digits and of everything beyond ASCII, A-Z in lower case.  An item with fewer words than
``width`` is one window; an item without words, or null, has none.  A null or empty text has no words and is clean; long
texts are searched whole.  Repeated items are one pattern with several ids; items without id are searched too.  Repeated
documents each give their own row, and so do rows without doc_id; an empty table of either kind gives a result all the
same (no rows, or none hit).  Columns other than ids and texts are not read, whatever their names.

The documents are read in one pass without any shuffle.  The items are sent to the executors in blocks of ITEM_BYTES at
most, in a compact form: the items' bytes once, and some 60 bytes of arrays for each of their words.  Where they exceed
one block, each further block searches all documents; what it finds is joined to them by doc_id and the text's digest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from colloquy.llm.packing import batch as record
from colloquy.llm.shared import bounded, written
from colloquy.llm.words import _LOWER, NOT_ALNUM, U, buffers, rolling, slices, word_hashes, word_spans

WIDTH = 10
#: Words of a block.
BLOCK = 3
#: Bytes of item texts that are sent at once.
ITEM_BYTES = 8 << 20
#: Places of a table of shifts for each window: with so many hardly a block meets another's place.
PLACES = 16
#: Windows from which on a bucket is kept.
LARGE = 8


def _words(data: np.ndarray, offsets: np.ndarray):
    low = _LOWER[data]
    starts, ends, firsts = word_spans(low, offsets, NOT_ALNUM)
    hashes, _ = word_hashes(low, offsets, NOT_ALNUM, lower=False)
    return low.tobytes(), starts, ends, firsts, hashes


class Table:
    """All windows of one length: the table of shifts; and the windows in order of their hashes, which makes those of one
    hash a bucket, each as the number of its first word."""

    def __init__(self, length: int, heads: np.ndarray, hashes: np.ndarray) -> None:
        self.length, self.block = length, min(BLOCK, length)
        own = rolling(hashes, self.block)
        size = 1 << max(8, (PLACES * len(heads) - 1).bit_length())
        self.mask = U(size - 1)
        self.shift = np.full(size, length - self.block + 1, np.uint8)
        for j in range(length - self.block + 1):  # the block of words j .. j+block-1 of each window; later ones shift less
            self.shift[(own[heads + j] & self.mask).astype(np.int64)] = length - self.block - j
        whole = rolling(hashes, length)[heads]
        order = np.argsort(whole, kind="stable")
        self.whole, self.heads = whole[order], heads[order].astype(np.int32)


class Patterns:
    """Tables of all windows of the items, by window length; the items' words; and whose each word is."""

    def __init__(self, items: list[tuple[str, str]], width: int = WIDTH) -> None:
        low, starts, ends, firsts, hashes = _words(*buffers(pa.array([t for _, t in items], pa.large_string())))
        self.low, self.starts, self.ends, self.firsts = low, starts.astype(np.int32), ends.astype(np.int32), firsts
        self.items = [i for i, _ in items]
        self.large: dict[tuple[int, int], dict] = {}
        size = np.diff(firsts)
        lengths = np.minimum(size, width)
        self.tables = []
        for length in np.unique(lengths[lengths > 0]).tolist():
            own = np.flatnonzero(lengths == length)
            n = size[own] - length + 1
            heads = np.repeat(firsts[:-1][own], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            self.tables.append(Table(length, heads, hashes))

    def spelled(self, head: int, length: int) -> list[bytes]:
        return [self.low[s:e] for s, e in zip(self.starts[head : head + length].tolist(), self.ends[head : head + length].tolist(), strict=True)]

    def bucket(self, t: Table, begin: int, over: int) -> dict[tuple, set]:
        """The test strings of one hash, word by word, and whose they are; large buckets are kept once made."""
        if (t.length, begin) in self.large:
            return self.large[t.length, begin]
        out: dict[tuple, set] = {}
        for h in t.heads[begin:over].tolist():
            out.setdefault(tuple(self.spelled(h, t.length)), set()).add(self.items[int(np.searchsorted(self.firsts, h, "right")) - 1])
        if over - begin > LARGE:
            self.large[t.length, begin] = out
        return out

    def search(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, list[tuple[int, int]], list[str]]]:
        """For each text: words, merged spans of hit words, sorted item ids."""
        low, starts, ends, firsts, hashes = _words(data, offsets)
        ready = []
        for t in self.tables:
            own = rolling(hashes, t.block)
            ready.append((t, t.shift[(own & t.mask).astype(np.int64)].tobytes(), rolling(hashes, t.length)))
        for k in range(len(offsets) - 1):
            first, last = int(firsts[k]), int(firsts[k + 1])
            found: list[tuple[int, int]] = []
            items: set[str] = set()
            for t, skip, whole in ready:
                length, stands = t.length, []
                at, end = first + length - t.block, last - t.block  # ``at``: the first word of the window's last block
                while at <= end:
                    step = skip[at]
                    if not step:
                        stands.append(at - length + t.block)
                        step = 1
                    at += step
                if not stands:
                    continue
                heads = np.array(stands)
                begin, over = (np.searchsorted(t.whole, whole[heads], side) for side in ("left", "right"))
                for x in np.flatnonzero(begin < over).tolist():
                    head = int(heads[x])
                    words = [low[s:e] for s, e in zip(starts[head : head + length].tolist(), ends[head : head + length].tolist(), strict=True)]
                    whose = self.bucket(t, int(begin[x]), int(over[x])).get(tuple(words))
                    if whose:
                        found.append((head - first, head - first + length))
                        items |= whose
            found.sort()
            merged: list[tuple[int, int]] = []
            for s, e in found:
                if merged and s <= merged[-1][1]:
                    merged[-1] = (merged[-1][0], max(merged[-1][1], e))
                else:
                    merged.append((s, e))
            yield last - first, merged, sorted(items, key=lambda x: (x is None, x or ""))


_SPANS = "array<struct<start:int,end:int>>"


_FOUND = f"doc_id bigint, digest binary, n_words bigint, spans {_SPANS}, items array<string>"


def _search(docs: DataFrame, items: list[tuple[str, str]], width: int, digests: bool) -> DataFrame:
    """One row per document; ``digests``: with the digest of its text."""
    patterns = docs.sparkSession.sparkContext.broadcast(Patterns(items, width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                n, spans, ids = zip(*patterns.value.search(*buffers(batch.column(1))), strict=True)
                yield record(
                    doc_id=batch.column(0),
                    digest=pa.array([hashlib.blake2b((t or "").encode(), digest_size=16).digest() for t in batch.column(1).to_pylist()] if digests else [None] * batch.num_rows, pa.binary()),
                    n_words=pa.array(n, pa.int64()),
                    spans=pa.array([[{"start": s, "end": e} for s, e in x] for x in spans], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                    items=pa.array(ids, pa.list_(pa.string())),
                )

    return docs.mapInArrow(run, _FOUND)


def _merged(spans: Column) -> Column:
    """Sorted spans, those that touch as one."""
    return F.aggregate(
        F.array_sort(spans),
        F.array().cast(_SPANS),
        lambda acc, x: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["end"] >= x["start"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], x["end"]).alias("end"))))).otherwise(F.concat(acc, F.array(x))),
    )


def find_items(docs: DataFrame, benchmark: DataFrame, *, width: int = WIDTH, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """``doc_id, n_words, n_hit, spans, items`` per document: hit words, their merged spans (word numbers from 0, the end
    exclusive) and the sorted ids of the items that have an occurring window.  Items without id are searched too; together
    they are one null at the end of ``items``, which counts in n_items and adds nothing to items_sha256."""
    bounded(docs)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("text IS NOT NULL")
    blocks = max(1, -(-(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // item_bytes))
    found = None
    for k in range(blocks):
        own = items.where(F.pmod(F.xxhash64(F.coalesce("item_id", "text")), F.lit(blocks)) == k) if blocks > 1 else items
        part = _search(docs, [(r[0], r[1]) for r in own.collect()], width, blocks > 1)
        if found is None:
            found, more = part, []
        else:  # of the further blocks' findings only those with a hit count; equal rows have equal ones
            more.append(part.where(F.size("spans") > 0))
    if more:
        hits = reduce(DataFrame.unionByName, more).groupBy("doc_id", "digest").agg(F.flatten(F.collect_set("spans")).alias("spans_"), F.flatten(F.collect_set("items")).alias("items_"))
        hits = written(hits, "hits").select(F.col("doc_id").alias("id"), F.col("digest").alias("of"), "spans_", "items_")
        none = lambda c, kind: F.coalesce(c, F.array().cast(kind))
        found = found.join(hits, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("digest") == F.col("of")), "left")
        spans, ids = F.concat("spans", none("spans_", _SPANS)), F.concat("items", none("items_", "array<string>"))
        found = found.select("doc_id", "n_words", _merged(spans).alias("spans"), F.array_sort(F.array_distinct(ids)).alias("items"))
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda acc, x: acc + (x["end"] - x["start"]))
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), "spans", "items")


def op8_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against all benchmark items."""
    found = find_items(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP8_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
bl AS (SELECT item_id, w, least(len(w), {WIDTH}) AS n FROM b WHERE len(w) > 0),
p AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM (SELECT item_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM bl)),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM p) WHERE len(w) >= n)),
o AS (SELECT doc_id, item_id, dw.n, i FROM dw JOIN p USING (n, s)),
h AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM o) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM o) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""
