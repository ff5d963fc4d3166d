"""Operator 10: n-gram Jaccard join and its components.

A document's set: its distinct 5-word shingles; with fewer words the whole sequence as one; without words none, and then
it links with nothing.  Two documents link when 100 * intersection >= 75 * union.  No link is lost:

1. Documents with the same set are one class, which one row stands for (the join returns classes, not pairs of copies).
2. Prefixes: in a fixed order of all shingles (those of rare words first, very frequent shingles last), two sets that
   link share one of the first ``n // 4 + 1`` shingles.  Classes that share such a shingle form a block.
3. Signature trees: in each block and class of sizes, documents ordered by size are the leaves of a tree whose nodes hold
   the OR of their token bitmaps and their range of sizes.  Two trees are walked together; a pair of nodes is dropped
   if the overlap that their bitmaps allow at most is less than their sizes need, or if all of both is one component.
   Pairs of leaves that are left over are compared exactly.  All links between different sets come from here.

The walk goes in rounds.  In the first, a large block is dealt in parts to tasks, each part with the same few pivots of
its block; a document has its best pair compared, one with a pivot first.  So a group of near copies becomes one
component at a cost in proportion to its size.  Pairs that were put off, and those across parts, are the further
rounds': there the documents outside of the block's largest component meet all others, with wider bitmaps, in those
blocks that still hold different components.  The last round puts nothing off.

Shingles are told apart by 64-bit hashes, and so are rows that share a doc_id or have none (by doc_id and text): among n of
them n*n/2**65 pairs are expected to be taken for one.  Null counts as an empty text.  Rows with one doc_id and different texts, or without
doc_id, are documents of their own; the component's id is the smallest doc_id in it, null if there is none.  Equal rows
each give their own row; an empty table gives an empty table; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from colloquy.llm.graph import components
from colloquy.llm.packing import batch as record, binaries, bucket_of, planes, runs, unplanes
from colloquy.llm.shared import bounded, deal, forget, hinted, keyed_semi, rows_of, written
from colloquy.llm.words import U, buffers, rolling, slices, word_hashes

SHINGLE = 5
#: A link needs PERCENT * union <= 100 * intersection.
PERCENT = 75
#: Words of a chunk; documents of a chunk beyond which a shingle is frequent; frequent shingles that are known to all tasks
#: (at most, the most frequent ones: others keep their place in the order, which changes the work, not the result).
CHUNK_WORDS = 1 << 20
FREQUENT = 2
FREQUENT_SHINGLES = 500_000
#: Slots of hashed words whose counts, over all documents, say how common a shingle's words are.
SLOTS = 1 << 14
#: Place in the order of shingles (0 to 255) from which on the frequent ones stand.
LAST = 192
#: Documents of a block that one task takes, those of them that all its tasks get, leaves and children of a tree's node.
BLOCK, PIVOTS = 96, 8
LEAVES, FAN = 8, 8
#: Rounds in blocks: pairs for each document of the smaller component (None: all), bits of a bitmap per token.
ROUNDS = ((1, 2), (16, 4), (None, 8))
#: 64-bit words of bitmaps that a step of a walk compares.
WALK_WORDS = 1 << 20
#: Windows of prefixes that one group of the exchange takes, as bytes of text.
BUCKET_BYTES = 64 << 20


def slot_of(words: np.ndarray) -> np.ndarray:
    return (words >> U(50)).astype(np.int64)


def shingles(batches: Iterator[pa.RecordBatch], k: int, counts: np.ndarray | None = None, weights: np.ndarray | None = None) -> Iterator[list[tuple]]:
    """Lists of (doc_id, sorted distinct shingle hashes) of about a chunk; with ``weights`` of word slots also the sum of
    each shingle's weights.  ``counts``: gets the words of each slot."""
    out, words = [], 0
    for whole in batches:
        for part in slices(whole, "text"):
            hashes, firsts = word_hashes(*buffers(part.column(1)))
            rolled = rolling(hashes, k)
            if counts is not None:
                counts += np.bincount(slot_of(hashes), minlength=SLOTS)
            if weights is not None:
                total = np.concatenate([[0], np.cumsum(weights[slot_of(hashes)])])
            for doc, first, last in zip(part.column(0).to_pylist(), firsts[:-1].tolist(), firsts[1:].tolist(), strict=True):
                n = last - first
                if weights is not None:
                    if n >= k:
                        own, at = np.unique(rolled[first : last - k + 1], return_index=True)
                        out.append((doc, own, total[first + at + k] - total[first + at]))
                    else:
                        out.append((doc, rolling(hashes[first:last], n) if n else np.zeros(0, np.uint64), np.zeros(min(n, 1), np.int64)))
                    continue
                out.append((doc, np.unique(rolled[first : last - k + 1]) if n >= k else rolling(hashes[first:last], n) if n else np.zeros(0, np.uint64)))
            words += len(hashes)
            if words >= CHUNK_WORDS:
                yield out
                out, words = [], 0
    if out:
        yield out


_PROFILE = "kind int, row bigint, doc_id bigint, n bigint, d1 bigint, d2 bigint"


def row_key(docs: DataFrame) -> tuple[Column, bool]:
    """(what tells rows apart, whether each row has one of its own): the doc_id if so (such ids pack well), else 64 bits of
    doc_id and text."""
    own = docs.groupBy("doc_id").count().where("doc_id IS NULL OR count > 1").isEmpty()
    return (F.col("doc_id").cast("bigint") if own else F.xxhash64(F.col("doc_id").cast("bigint"), F.coalesce("text", F.lit("")))), own


def _profile(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SLOTS, np.int64)

        def both() -> Iterator[pa.RecordBatch]:
            for b in batches:
                ids.extend(b.column(2).to_pylist())
                yield b

        ids: list = []
        for chunk in shingles(both(), k, counts):
            rows = []
            for (row, s), doc in zip(chunk, ids, strict=False):
                if len(s):
                    d = np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64)
                    rows.append((0, row, doc, len(s), int(d[0]), int(d[1])))
                else:
                    rows.append((0, row, doc, 0, None, None))
            del ids[: len(chunk)]
            every = np.sort(np.concatenate([s for _, s in chunk])) if chunk else np.zeros(0, np.uint64)
            begin = runs(every)
            count = np.diff(np.append(begin, len(every)))
            often = np.flatnonzero(count > FREQUENT)
            rows += [(1, None, None, c, h, None) for h, c in zip(every[begin[often]].view(np.int64).tolist(), count[often].tolist(), strict=True)]
            yield _profiles(rows)
        # slots with far more words than most; the others are as good as equal
        common = np.flatnonzero(counts > 4 * counts.mean()).tolist()
        if common:
            yield _profiles([(2, None, None, int(counts[x]), x, None) for x in common])

    return run


def _profiles(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if i == 0 else pa.int64()) for i, c in enumerate(columns)], names=["kind", "row", "doc_id", "n", "d1", "d2"])


def _arrays(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in shingles(batches, k):
            chunk = [*dict(chunk).items()]  # repeated rows once
            for low in range(0, len(chunk), 256):
                some = chunk[low : low + 256]
                yield record(id=pa.array([d for d, _ in some], pa.int64()), n=pa.array([len(s) for _, s in some], pa.int64()), tokens=pa.array([s.tobytes() for _, s in some], pa.binary()))

    return run


def _chosen(docs: DataFrame, ids: DataFrame, make, schema: str, keys: list[str], unique: bool) -> DataFrame:
    """What ``make`` gives for the rows named in ``ids`` (row), written to the shared folder.  Unless rows are ``unique``
    repeated ones may have met in several tasks: one result of theirs stays."""
    found = keyed_semi(docs, written(ids.distinct(), "chosen"), "row").mapInArrow(make, schema)
    return written(found if unique else found.dropDuplicates(keys), "chosen-rows")


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        linked = []
        for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
            s, t = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(np.intersect1d(s, t, assume_unique=True))
            linked.append(100 * both >= PERCENT * (len(s) + len(t) - both))
        yield b.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))


def linked(pairs: DataFrame, tokens: DataFrame) -> DataFrame:
    """The pairs (a, b) that link, by exact comparison."""
    left = tokens.select(F.col("id").alias("a"), F.col("tokens").alias("s"))
    right = tokens.select(F.col("id").alias("b"), F.col("tokens").alias("t"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "s", "t")
    return written(both.mapInArrow(_compare, "a bigint, b bigint"), "linked")


def _prefixes(k: int, labels: list[int], shipped):
    buckets = len(labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, last, weights = shipped.value  # sorted hashes of frequent shingles, their place in the order; words' weights
        for chunk in shingles(batches, k, weights=weights):
            known: dict[bytes, int] = {}
            for doc, s, _ in chunk:  # documents with the same set, as far as they meet here, are one
                if len(s):
                    key = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                    known[key] = min(known.get(key, doc), doc)
            keep = {*known.values()}
            hs, ids, rare = [], [], []
            for doc, s, place in sorted(chunk, key=lambda x: x[0]):  # in order, so that ids pack well
                if doc not in keep or not len(s):
                    continue
                keep.discard(doc)
                p = len(s) * (100 - PERCENT) // 100 + 1
                common = np.zeros(len(s), bool)
                if len(keys):
                    at = np.minimum(np.searchsorted(keys, s), len(keys) - 1)
                    common = keys[at] == s
                    place = np.where(common, last[at], np.minimum(place, LAST - 1))
                # the order of all shingles: place, then hash
                first = np.argsort((place.astype(np.uint64) << U(56)) | (s >> U(8)), kind="stable")[:p]
                hs.append(s[first])
                ids.append(np.full(p, doc, np.int64))
                rare.append(~common[first])
            if not hs:
                continue
            h, doc, seldom = np.concatenate(hs), np.concatenate(ids), np.concatenate(rare)
            bucket = bucket_of(h, buckets)
            bucket[~seldom] += buckets  # these are dealt by document and never gathered by shingle in one task
            order = np.argsort(bucket, kind="stable")
            for some in np.split(order, runs(bucket[order])[1:]):
                b = int(bucket[some[0]])
                begin = runs(doc[some])
                yield record(
                    bucket=pa.array([labels[b] if b < buckets else labels[int(doc[some[0]] % buckets)]], pa.int32()),
                    kind=pa.array([int(b >= buckets)], pa.int32()),
                    hashes=pa.array([h[some].tobytes()], pa.binary()),
                    docs=pa.array([planes(doc[some][begin])], pa.binary()),
                    sizes=pa.array([planes(np.append(begin[1:], len(some)), 4)], pa.binary()),
                )

    return run


def _shared_prefixes(table: pa.Table) -> pa.Table:
    """(hash, block, row): for a shingle that stands in the prefixes of two rows or more the least of them as its block,
    once for all shingles with the same rows; frequent shingles pass as they are, with their hash."""
    parts: dict[int, list] = {0: [], 1: []}
    for kind, h, d, n in zip(table.column("kind").to_pylist(), *(binaries(table.column(c)) for c in ("hashes", "docs", "sizes")), strict=True):
        parts[kind].append((np.frombuffer(h, np.uint64), np.repeat(unplanes(d), np.diff(unplanes(n, 4), prepend=0))))
    none = np.zeros(0, np.int64)
    block, doc = none, none
    if parts[0]:
        h, doc = (np.concatenate(x) for x in zip(*parts[0], strict=True))
        order = np.lexsort((doc, h))
        h, doc = h[order], doc[order]
        begin = runs(h)
        count = np.diff(np.append(begin, len(h)))
        block = np.repeat(doc[begin], count)
        # two different rows at least; the shingles of one passage have nearly the same rows, and become one block
        several = np.repeat(doc[begin] < np.maximum.reduceat(doc, begin), count)
        block, doc = block[several], doc[several]
        order = np.lexsort((doc, block))
        block, doc = block[order], doc[order]
        new = np.ones(len(doc), bool)
        new[1:] = (block[1:] != block[:-1]) | (doc[1:] != doc[:-1])
        block, doc = block[new], doc[new]
    often = [np.concatenate(x) for x in zip(*parts[1], strict=True)] if parts[1] else [none.view(np.uint64), none]
    size = len(doc), len(often[1])
    return pa.table(
        {
            "hash": pa.array(np.concatenate([np.zeros(size[0], np.int64), often[0].view(np.int64)]), mask=np.repeat([True, False], size)),
            "block": pa.array(np.concatenate([block, np.zeros(size[1], np.int64)]), mask=np.repeat([False, True], size)),
            "row": pa.array(np.concatenate([doc, often[1]])),
        }
    )


class Tree:
    """A signature tree over documents in order of size; nodes are kept level by level, leaves first."""

    def __init__(self, bits: np.ndarray, sizes: np.ndarray, comps: np.ndarray) -> None:
        excess = sizes - np.bitwise_count(bits).sum(axis=1)
        self.levels = [(bits, excess, sizes, sizes, comps, comps)]
        step = LEAVES
        while len(self.levels[-1][0]) > 1:
            b, x, low, high, first, last = self.levels[-1]
            at = np.arange(0, len(b), step)
            self.levels.append((np.bitwise_or.reduceat(b, at), np.maximum.reduceat(x, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.minimum.reduceat(first, at), np.maximum.reduceat(last, at)))
            step = FAN

    def fan(self, level: int) -> int:
        return LEAVES if level == 1 else FAN


def walk(p: Tree, q: Tree, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of leaves whose bitmaps allow a link and whose components differ, and the overlap that they allow; ``same``:
    the trees are one."""
    stack = [(len(p.levels) - 1, np.zeros(1, np.int64), len(q.levels) - 1, np.zeros(1, np.int64))]
    most_pairs = max(64, min(16_384, WALK_WORDS // p.levels[0][0].shape[1]))
    while stack:
        i, a, j, b = stack.pop()
        if len(a) > most_pairs:
            half = len(a) // 2
            stack += [(i, a[:half], j, b[:half]), (i, a[half:], j, b[half:])]
            continue
        pb, px, pl, ph, pf, pt = p.levels[i]
        qb, qx, ql, qh, qf, qt = q.levels[j]
        # sizes: the smaller of one side against the larger of the other; components: all of both the same
        ok = (100 * ph[a] >= PERCENT * ql[b]) & (100 * qh[b] >= PERCENT * pl[a]) & ~((pf[a] == pt[a]) & (qf[b] == qt[b]) & (pf[a] == qf[b]))
        if same and i == j:
            ok &= a <= b if i else a < b
        a, b = a[ok], b[ok]
        if not len(a):
            continue
        most = np.bitwise_count(pb[a] & qb[b]).sum(axis=1) + np.minimum(px[a], qx[b])
        ok = (100 + PERCENT) * most >= PERCENT * (pl[a] + ql[b])
        a, b, most = a[ok], b[ok], most[ok]
        if not len(a):
            continue
        if not i and not j:
            yield a, b, most
            continue
        down_p, down_q = i >= j and i > 0, j >= i and j > 0
        for tree, level, down, side in ((p, i, down_p, 0), (q, j, down_q, 1)):
            if down:
                fan = tree.fan(level)
                x = a if side == 0 else b
                child = (x[:, None] * fan + np.arange(fan)).ravel()
                fits = child < len(tree.levels[level - 1][0])
                a, b = (child[fits], np.repeat(b, fan)[fits]) if side == 0 else (np.repeat(a, fan)[fits], child[fits])
        stack.append((i - down_p, a, j - down_q, b))


def bitmap(tokens: np.ndarray, width: int) -> bytes:
    """``width`` bits, with the bit of each token's hash modulo the width."""
    out = np.zeros(width, np.uint8)
    out[(tokens & U(width - 1)).astype(np.int64)] = 1
    return np.packbits(out).tobytes()


def _walk_block(limit: int | None):
    """The pairs of one part of a block; ``more``: whether some were put off."""

    def run(table: pa.Table) -> pa.Table:
        ids, n, comp = (table.column(c).to_numpy().astype(np.int64) for c in ("id", "n", "comp"))
        home, part, pivot = table.column("home").to_numpy(zero_copy_only=False), table.column("part").to_numpy(), table.column("pivot").to_numpy(zero_copy_only=False)
        bits = np.frombuffer(b"".join(table.column("bits").to_pylist()), np.uint64).reshape(len(ids), -1)
        crossed = table.column("lo")[0].as_py() != table.column("hi")[0].as_py()
        sides = [np.flatnonzero(home & (part == x)) for x in np.unique(part)], [np.flatnonzero(~home & (part == x)) for x in np.unique(part)]
        trees = [[(o := s[np.lexsort((comp[s], n[s]))], Tree(bits[o], n[o], comp[o])) for s in side if len(s)] for side in sides]
        found = [(np.zeros(0, np.int64),) * 3]

        def meet(x, y, same) -> None:
            found.extend((x[0][a], y[0][b], most) for a, b, most in walk(x[1], y[1], same))

        for i, x in enumerate(trees[0]):
            for j, y in enumerate(trees[0][i:], i):
                if crossed != (i == j):
                    meet(x, y, i == j)
            for y in trees[1]:
                if crossed == (part[x[0][0]] != part[y[0][0]]):
                    meet(x, y, False)
        a, b, most = (np.concatenate(x) for x in zip(*found, strict=True))
        more = False
        if limit is not None and len(a):
            # a pair counts for the document that is no pivot, or for that in the component that has fewer documents here
            _, index, count = np.unique(comp, return_inverse=True, return_counts=True)
            size = count[index]
            less = (size[a] < size[b]) | ((size[a] == size[b]) & (ids[a] < ids[b]))
            whose = np.where(np.where(pivot[a] == pivot[b], less, pivot[b]), a, b)
            order = np.lexsort((-most, ~(pivot[a] | pivot[b]), whose))
            first = runs(whose[order])
            place = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
            keep = order[place < limit]
            more = len(keep) < len(a)
            a, b = a[keep], b[keep]
        one = lambda c: pa.array(np.full(len(a), table.column(c)[0].as_py(), np.int64))
        return pa.table({"block": one("block"), "cls": one("cls"), "a": pa.array(np.minimum(ids[a], ids[b])), "b": pa.array(np.maximum(ids[a], ids[b])), "more": pa.array(np.full(len(a), more))})

    return run


def _bits(k: int, factor: int):
    """Each set's bitmap among its own class of sizes and among the guests of the class below."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in shingles(batches, k):
            chunk = [*dict(chunk).items()]  # repeated rows once
            for low in range(0, len(chunk), 1024):
                rows = []
                for doc, s in chunk[low : low + 1024]:
                    c = class_of(len(s))
                    rows += [(doc, len(s), x, x == c, bitmap(s, width_of(x, factor))) for x in (c, c - 1)]
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["id", "n", "cls", "home", "bits"])

    return run


def class_of(n: int) -> int:
    """Sets that link are of the same class of sizes or of neighbouring ones."""
    c = 0
    while n * PERCENT**c >= 100**c:
        c += 1
    return c - 1


def width_of(size_class: int, factor: int) -> int:
    """Bits of a bitmap: ``factor`` times the largest set of the class, as a power of two; 256 to 65,536."""
    return min(1 << 16, max(256, 1 << (int(factor * (100 / PERCENT) ** (size_class + 1))).bit_length()))


_DEALT = ["block", "cls", "lo", "hi", "part", "id", "comp", "n", "home", "pivot"]


def _first_round(members: DataFrame) -> DataFrame:
    """Each member in the task of its part, pivots in those of all parts of their block."""
    counts = members.groupBy("block", "cls").agg(F.count(F.lit(1)).alias("m"), F.min("comp").alias("least"), F.max("comp").alias("most"), F.max("home").alias("own")).where("least < most AND own")
    counts = hinted(written(counts.select("block", "cls", "m", F.ceil(F.col("m") / BLOCK).cast("bigint").alias("parts")), "parts"))
    members = members.join(counts, ["block", "cls"]).withColumns({"part": F.pmod(F.xxhash64("id"), F.col("parts")), "pivot": (F.col("parts") > 1) & (F.pmod(F.xxhash64("id", F.lit(1)), F.col("m")) < PIVOTS)})
    parts = F.when(F.col("pivot"), F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).otherwise(F.array("part"))
    return members.withColumn("part", F.explode(parts)).withColumns({"lo": F.col("part"), "hi": F.col("part")}).select(_DEALT)


def _later_round(members: DataFrame) -> DataFrame:
    """In blocks that hold several components: documents outside of the largest meet each other and all of that one."""
    comps = members.groupBy("block", "cls", "comp").agg(F.count(F.lit(1)).alias("m"), F.max("home").alias("own"))
    total = comps.groupBy("block", "cls").agg(F.max_by("comp", F.struct("m", "comp")).alias("largest"), F.sum("m").alias("m"), F.max("m").alias("most"), F.count(F.lit(1)).alias("c"), F.max("own").alias("own")).where("c > 1 AND own")
    sizes = total.select("block", "cls", "largest", F.ceil((F.col("m") - F.col("most")) / BLOCK).cast("bigint").alias("few"), F.ceil(F.col("most") / BLOCK).cast("bigint").alias("many"))
    members = members.join(hinted(written(sizes, "parts")), ["block", "cls"])
    large, place, zero = F.col("comp") == F.col("largest"), F.xxhash64("id"), F.lit(0).cast("bigint")
    members = members.withColumn("part", F.when(large, F.col("few") + F.pmod(place, F.col("many"))).otherwise(F.pmod(place, F.col("few"))))
    others = F.sequence(zero, F.col("few") - 1 + F.when(large, zero).otherwise(F.col("many")))
    members = members.withColumn("other", F.explode(others))
    return members.withColumns({"lo": F.least("part", "other"), "hi": F.greatest("part", "other"), "pivot": F.lit(False)}).select(_DEALT)


def _walked(dealt: DataFrame, bits: DataFrame, limit: int | None) -> DataFrame:
    """``block, cls, a, b, more``: the pairs that the trees of each task leave over."""
    joined = dealt.join(bits.select("id", "home", "bits"), ["id", "home"])
    return written(joined.groupBy("block", "cls", "lo", "hi").applyInArrow(_walk_block(limit), "block bigint, cls bigint, a bigint, b bigint, more boolean"), "pairs")


def _block_links(docs: DataFrame, blocks: DataFrame, k: int, unique: bool) -> DataFrame:
    """All links that are needed: between classes that share a block (block, id), until all that link are connected."""
    links, members = None, None
    for limit, factor in ROUNDS:
        ids = (blocks if members is None else members).select(F.col("id").alias("row"))
        bits = _chosen(docs, ids, _bits(k, factor), "id bigint, n bigint, cls bigint, home boolean, bits binary", ["id", "home"], unique)
        first = members is None
        if first:  # documents of a class of sizes meet each other and those of the next class: other sizes cannot link
            members = written(blocks.join(bits.select("id", "n", "cls", "home"), "id").withColumn("comp", F.col("id")), "members")
        walked = _walked(_first_round(members) if first else _later_round(members), bits, limit)
        pairs = written(walked.select("a", "b").distinct(), "compared")
        tokens = _chosen(docs, pairs.select(F.explode(F.array("a", "b")).alias("row")), _arrays(k), "id bigint, n bigint, tokens binary", ["id"], unique)
        new = linked(pairs, tokens)
        links = new if links is None else links.unionByName(new)
        forget(tokens, pairs, bits)
        if limit is None:
            break
        again = walked.where("more").select("block", "cls")
        if first:  # the parts of a block have not met each other yet
            again = again.unionByName(members.groupBy("block", "cls").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > BLOCK).select("block", "cls"))
        again = written(again.distinct(), "again")
        if not rows_of(again):
            break
        found = components(links, rounds=2)  # labels that are right as far as they go
        left = members.join(hinted(again), ["block", "cls"], "left_semi").drop("comp").join(hinted(found), "id", "left")
        before, members = members, written(left.select("block", "id", F.coalesce("component", "id").alias("comp"), "n", "cls", "home"), "members")
        forget(before, walked, again, found)
    return links


def groups(docs: DataFrame, *, k: int = SHINGLE, row: tuple[Column, bool] | None = None) -> DataFrame:
    """``row, doc_id, n_shingles, root, component_id`` for each row of ``docs`` (doc_id, text): ``row`` is :func:`row_key`,
    ``root`` the same for all rows of a component and null for a text without words."""
    spark = bounded(docs)
    row, unique = row_key(docs) if row is None else row
    docs = docs.select(row.alias("row"), "text", F.col("doc_id").cast("bigint").alias("doc_id"))
    profile = written(docs.mapInArrow(_profile(k), _PROFILE), "profile")
    rows = profile.where("kind = 0")
    # 1. classes of equal sets
    same = rows.where("n > 0").groupBy("d1", "d2", "n").agg(F.min("row").alias("id"), F.max("row").alias("last")).where("id < last").drop("last")
    classed = rows.join(hinted(written(same, "same")), ["d1", "d2", "n"], "left")
    classed = written(classed.select("row", "doc_id", "n", F.coalesce("id", F.when(F.col("n") > 0, F.col("row"))).alias("id")), "classes")
    # 2. prefixes
    often = profile.where("kind = 1").groupBy("d1").agg(F.sum("n").alias("c")).orderBy(F.desc("c"), "d1").limit(FREQUENT_SHINGLES).toArrow()
    hashes, count = often.column("d1").to_numpy().astype(np.int64).view(np.uint64), often.column("c").to_numpy().astype(np.float64)
    order = np.argsort(hashes)
    last = (LAST + np.minimum(np.log2(np.maximum(count, 1)).astype(np.int64), 255 - LAST)).astype(np.uint8)
    weights = np.zeros(SLOTS, np.int64)
    size = 0
    for kind, slot, n in profile.where("kind <> 1").groupBy("kind", F.when(F.col("kind") == 2, F.col("d1")).alias("slot")).agg(F.sum("n")).collect():  # a row for each of SLOTS at most
        if kind == 0:
            size = n or 0
        else:
            weights[slot] = min(int(n).bit_length(), (LAST - 1) // k)
    shipped = spark.sparkContext.broadcast((hashes[order], last[order], weights))
    # the prefixes are a quarter of the sets; an entry takes some 50 bytes unpacked
    buckets = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size * 13 // BUCKET_BYTES))
    packed = docs.select("row", "text").mapInArrow(_prefixes(k, deal(spark, buckets), shipped), "bucket int, kind int, hashes binary, docs binary, sizes binary")
    shared = written(packed.groupBy("bucket").applyInArrow(_shared_prefixes, "hash bigint, block bigint, row bigint"), "shared")
    forget(profile)
    # one row stands for a class; most rows stand for themselves
    others = written(classed.where("id <> row").select("row", "id").distinct(), "others")
    shared = shared.join(hinted(others), "row", "left").select("hash", "block", F.coalesce("id", "row").alias("id"))
    frequent = shared.where("hash IS NOT NULL")
    ends = frequent.groupBy("hash").agg(F.min("id").alias("block"), F.max("id").alias("most")).where("block < most").drop("most")
    blocks = shared.where("hash IS NULL").select("block", "id").unionByName(frequent.drop("block").join(hinted(written(ends, "ends")), "hash").select("block", "id"))
    blocks = written(blocks.distinct(), "blocks")
    # 3. signature trees
    rooted = classed.withColumn("root", F.col("id"))
    if rows_of(blocks):
        found = components(_block_links(docs.select("row", "text"), blocks, k, unique))
        rooted = classed.join(hinted(found), "id", "left").withColumn("root", F.coalesce("component", "id"))
        forget(blocks)
    rooted = written(rooted.select("row", "doc_id", F.col("n").alias("n_shingles"), "root"), "rooted")
    least = rooted.where("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("m")).where("m > 1").drop("m")
    return rooted.join(hinted(written(least, "least")), "root", "left").select("row", "doc_id", "n_shingles", "root", F.coalesce("least", "doc_id").alias("component_id"))


def join(docs: DataFrame, *, k: int = SHINGLE) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for each row of ``docs`` (doc_id, text)."""
    return groups(docs, k=k).select("doc_id", "n_shingles", "component_id")


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents``."""
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP10_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + {SHINGLE - 1}], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {SHINGLE - 2}, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
      GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= {PERCENT} * (x.n + y.n - count(*))),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM d UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.doc_id WHERE r.c < l.b)
SELECT d.doc_id, coalesce(max(n.n), 0) AS n_shingles, min(r.c) AS component_id FROM d LEFT JOIN n USING (doc_id) JOIN r USING (doc_id) GROUP BY d.doc_id
"""
