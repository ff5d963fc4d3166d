"""Operator 4: quality classifier.

Method: random indexing.  Text is cut into runs of letters, of digits and of signs; a word is a run (A-Z in lower case)
with its shape (all capitals, repeated like the one before, ...).  Every word has a sparse random index vector, which
follows from its hash; its word vector is the sum of the index vectors of its neighbours over all documents, brought to
length one.  A document's vector pools the word vectors of its words (mean and spread).  A two-layer numpy network gives
a logit, and a temperature, fitted on training rows that the network did not see, makes it a probability.

The network learns from at most TRAIN_ROWS labelled rows (those with the smallest hashes of doc_id) outside the held-out
fold.  It can tell apart no more words than these rows hold: the VOCABULARY words that stand in most of them have vectors
of their own, all others one for each shape.  The word vectors come from all whole texts, without labels.  Scores use the
text alone.

Counts are integers, word vectors multiples of 1/SCALE, and sums of them exact, so a score does not depend on how the rows
are batched or dealt out.

Null counts as empty; an empty text has a vector of zeros and gets a score like any other; long texts are pooled whole.
Where the training rows have one label only, or there are none, every score is the share of 1 among them (0.5 without
any).  A document labelled several times counts once, with its largest label; of several rows with a labelled doc_id the
one whose vector's bytes come first is learned from.  Rows without doc_id are scored and not learned from.  Repeated rows
each give their own row; an empty table gives an empty table.  Other columns are passed through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from colloquy.llm.packing import batch as record
from colloquy.llm.shared import bounded, forget, written
from colloquy.llm.words import U, buffers, mix, slices, span_hashes

FOLDS, HELD = 5, 0
#: Score from which on the predicted class is 1.
THRESHOLD = 0.3
#: Labelled rows that the network learns from.
TRAIN_ROWS = 20_000
#: Words with a vector of their own; kinds of shapes.
VOCABULARY = 1 << 13
SHAPES = 8
DIMENSIONS = 32
#: Non-zero places of an index vector; neighbours on either side.
PLACES, REACH = 2, 2
HIDDEN = 24
#: Bytes of text handled at a time.
PIECE = 1 << 18
#: Word vectors are rounded to multiples of 1/SCALE.
SCALE = 1 << 12

_CLASS = np.full(256, 3, np.uint8)
_CLASS[[0x20, *range(0x09, 0x0E)]] = 0
_CLASS[[b for b in range(256) if b >= 0x80 or chr(b).isalpha()]] = 1
_CLASS[range(0x30, 0x3A)] = 2
_SHAPE = mix(np.arange(1, SHAPES + 1, dtype=np.uint64))


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % FOLDS == HELD


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(64-bit key of each word, its shape, index of each text's first word, one more at the end)."""
    kind = _CLASS[data]
    change = np.ones(len(data) + 1, bool)
    change[1:-1] = kind[1:] != kind[:-1]
    change[offsets[(offsets > 0) & (offsets < len(data))]] = True
    edges = np.flatnonzero(change)
    starts, ends = edges[:-1], edges[1:]
    on = kind[starts] != 0 if len(starts) else np.zeros(0, bool)
    starts, ends = starts[on], ends[on]
    firsts = np.searchsorted(starts, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), firsts
    hashes = span_hashes(data, starts, ends)
    upper = np.concatenate([[0], np.cumsum((data >= 65) & (data <= 90))])
    lower = np.concatenate([[0], np.cumsum((data >= 97) & (data <= 122))])
    up, low, size, k = upper[ends] - upper[starts], lower[ends] - lower[starts], ends - starts, kind[starts]
    shape = np.where(k == 2, 3, np.where(k == 3, np.where(size > 1, 5, 4), np.where((up > 1) & (low == 0), 2, np.where(up > 0, 1, 0))))
    text = np.searchsorted(firsts, np.arange(len(starts)), "right")
    word = np.flatnonzero(k == 1)
    again = word[1:][(hashes[word[1:]] == hashes[word[:-1]]) & (text[word[1:]] == text[word[:-1]])]
    shape[again] = 6
    return mix(hashes ^ _SHAPE[shape]), shape, firsts


class Lexicon:
    """Words with vectors: the vocabulary's keys in order, then the shapes."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys = np.sort(keys.astype(np.uint64))
        every = np.concatenate([self.keys, _SHAPE])
        self.at = np.stack([(mix(every ^ U(2 * p + 1)) % U(DIMENSIONS)).astype(np.int64) for p in range(PLACES)])
        self.sign = np.stack([1.0 - 2.0 * (mix(every ^ U(2 * p + 2)) & U(1)).astype(np.float64) for p in range(PLACES)])

    def __len__(self) -> int:
        return len(self.keys) + SHAPES

    def of(self, keys: np.ndarray, shape: np.ndarray) -> np.ndarray:
        """Number of each word."""
        if not len(self.keys):
            return shape
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, at, len(self.keys) + shape)


def _document_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many texts of a piece each word stands."""
    for whole in batches:
        for part in slices(whole, "text", PIECE):
            keys, _, firsts = words_of(*buffers(part.column(0)))
            text = np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))
            order = np.lexsort((text, keys))
            k, t = keys[order], text[order]
            new = np.ones(len(k), bool)
            new[1:] = (k[1:] != k[:-1]) | (t[1:] != t[:-1])
            word, n = np.unique(k[new], return_counts=True)
            yield record(word=pa.array(word.view(np.int64)), n=pa.array(n.astype(np.int64)))


def vocabulary(texts: DataFrame, size: int) -> np.ndarray:
    """Keys of the ``size`` words that stand in most ``texts`` (text); of equally frequent ones the smaller keys."""
    counts = texts.mapInArrow(_document_words, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return np.array([r[0] for r in counts.orderBy(F.desc("n"), "word").limit(size).collect()], np.int64).view(np.uint64)


def _context(shipped):
    """Sums of the neighbours' index vectors, one row per word of this task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = shipped.value
        sums = np.zeros(len(lexicon) * DIMENSIONS)
        for whole in batches:
            for part in slices(whole, "text", PIECE):
                keys, shape, firsts = words_of(*buffers(part.column(0)))
                word = lexicon.of(keys, shape)
                text = np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))
                for d in range(1, REACH + 1):
                    near = text[d:] == text[:-d]
                    left, right = word[:-d][near], word[d:][near]
                    for a, b in ((left, right), (right, left)):
                        for p in range(PLACES):
                            sums += np.bincount(a * DIMENSIONS + lexicon.at[p][b], weights=lexicon.sign[p][b], minlength=len(sums))
        table = sums.reshape(-1, DIMENSIONS).astype(np.int64)
        some = np.flatnonzero(np.abs(table).sum(axis=1))
        yield record(word=pa.array(some, pa.int32()), **{f"v{j}": pa.array(table[some, j]) for j in range(DIMENSIONS)})

    return run


def word_vectors(docs: DataFrame, lexicon: Lexicon) -> np.ndarray:
    """One row per word of the lexicon, from all texts: of length one, or zero for a word that has no neighbours; in whole
    multiples of 1/SCALE.  Tasks' sums are integers and are added natively, word by word."""
    names = [f"v{j}" for j in range(DIMENSIONS)]
    sums = docs.select("text").mapInArrow(_context(docs.sparkSession.sparkContext.broadcast(lexicon)), "word int, " + ", ".join(f"{v} bigint" for v in names))
    table = np.zeros((len(lexicon), DIMENSIONS))
    got = sums.groupBy("word").agg(*[F.sum(v).alias(v) for v in names]).toPandas()  # VOCABULARY + SHAPES rows at most
    table[got["word"].to_numpy(np.int64)] = got[names].to_numpy(np.float64)
    return np.round(table / np.maximum(np.sqrt((table**2).sum(axis=1, keepdims=True)), 1e-9) * SCALE).astype(np.float32)


def pooled(data: np.ndarray, offsets: np.ndarray, lexicon: Lexicon, vectors: np.ndarray) -> np.ndarray:
    """Vectors of texts: mean and spread of their words' vectors; zeros for a text without words."""
    keys, shape, firsts = words_of(data, offsets)
    word = lexicon.of(keys, shape)
    size = np.diff(firsts)
    out = np.zeros((len(size), 2 * DIMENSIONS))
    some = np.flatnonzero(size)
    step = 1 << 15
    sums = np.zeros((len(size), 2 * DIMENSIONS))  # whole numbers below 2**53: exact in any order
    text = np.repeat(np.arange(len(size)), size)
    for low in range(0, len(word), step):
        own = vectors[word[low : low + step]]
        of = text[low : low + step]
        begin = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        sums[of[begin], :DIMENSIONS] += np.add.reduceat(own, begin, dtype=np.float64)
        sums[of[begin], DIMENSIONS:] += np.add.reduceat(own * own, begin, dtype=np.float64)
    mean = sums[some] / size[some, None]
    out[some, :DIMENSIONS] = mean[:, :DIMENSIONS] / SCALE
    out[some, DIMENSIONS:] = np.sqrt(np.maximum(mean[:, DIMENSIONS:] - mean[:, :DIMENSIONS] ** 2, 0)) / SCALE
    return out


class Network:
    """Two layers on standardised vectors, and a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, fold: np.ndarray, steps: int = 600) -> None:
        self.share = float(y.mean()) if len(y) else 0.5
        self.constant = len(np.unique(y)) < 2
        if self.constant:
            return
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-4
        rng = np.random.Generator(np.random.PCG64(44))
        z, own = (x - self.mean) / self.scale, fold
        p = {"a": rng.normal(0, 1 / np.sqrt(z.shape[1]), (z.shape[1], HIDDEN)), "b": np.zeros(HIDDEN), "c": rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), "d": np.zeros(1)}
        m, v = ({k: np.zeros_like(w) for k, w in p.items()} for _ in range(2))
        self.p, self.temperature = p, 1.0
        rows = np.flatnonzero(~own)
        for t in range(1, steps + 1):  # Adam on random batches
            i = rng.choice(rows, min(len(rows), 512), replace=False)
            h = np.tanh(z[i] @ p["a"] + p["b"])
            e = (1 / (1 + np.exp(-(h @ p["c"] + p["d"]))) - y[i]) / len(i)
            back = np.outer(e, p["c"]) * (1 - h * h)
            g = {"a": z[i].T @ back + 1e-4 * p["a"], "b": back.sum(axis=0), "c": h.T @ e + 1e-4 * p["c"], "d": np.array([e.sum()])}
            for k in p:
                m[k] += 0.1 * (g[k] - m[k])
                v[k] += 0.01 * (g[k] ** 2 - v[k])
                p[k] -= 0.02 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)
        if own.any() and len(np.unique(y[own])) > 1:
            logit, labels = self.logit(x[own]), y[own]
            grid = np.exp(np.linspace(np.log(0.25), np.log(8), 60))
            loss = [np.logaddexp(0, -np.where(labels > 0, 1, -1) * logit / t).mean() for t in grid]
            self.temperature = float(grid[int(np.argmin(loss))])

    def logit(self, x: np.ndarray) -> np.ndarray:
        # sums in one order whatever the number of rows, unlike those of a matrix product
        z, h, out = (x - self.mean) / self.scale, np.tile(self.p["b"], (len(x), 1)), np.full(len(x), self.p["d"][0])
        for j, w in enumerate(self.p["a"]):
            h += z[:, j, None] * w
        for j, w in enumerate(self.p["c"]):
            out += np.tanh(h[:, j]) * w
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.share) if self.constant else 1 / (1 + np.exp(-self.logit(x) / self.temperature))


def _vectors(shipped):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, "text", PIECE):
                x = pooled(*buffers(part.column(1)), *shipped.value)
                yield record(doc_id=part.column(0), x=pa.array([r.astype("<f8").tobytes() for r in x], pa.binary()))

    return run


def fit(docs: DataFrame, labels: DataFrame, *, train_rows: int = TRAIN_ROWS, words: int = VOCABULARY) -> tuple[Lexicon, np.ndarray, Network]:
    """(lexicon, word vectors, network)."""
    send = docs.sparkSession.sparkContext.broadcast
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    known = written(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows), "labels")
    rows = written(docs.join(F.broadcast(known), "doc_id", "left_semi").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), "labelled")
    lexicon = Lexicon(vocabulary(rows.select("text"), words))
    vectors = word_vectors(docs, lexicon)
    # a fifth of the training rows (another remainder of the same checksum) is kept for the temperature
    fold = F.crc32(F.col("doc_id").cast("string")) % FOLDS == (HELD + 1) % FOLDS
    pooled_rows = rows.mapInArrow(_vectors(send((lexicon, vectors))), "doc_id bigint, x binary").groupBy("doc_id").agg(F.min("x").alias("x"))
    got = pooled_rows.join(F.broadcast(known), "doc_id").select("doc_id", "x", F.col("quality").cast("int").alias("y"), fold.alias("fold")).toPandas().sort_values("doc_id")
    forget(rows)
    x = np.frombuffer(b"".join(got["x"]), "<f8").reshape(len(got), 2 * DIMENSIONS)
    return lexicon, vectors, Network(x, got["y"].to_numpy(np.float64), got["fold"].to_numpy(bool))


def _scores(shipped, names: list[str], column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, vectors, network = shipped.value
        for whole in batches:
            for part in slices(whole, "text", PIECE):
                score = network.score(pooled(*buffers(part.column(part.schema.get_field_index("text"))), lexicon, vectors))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score)], names=[*names, column])

    return run


def classify(docs: DataFrame, labels: DataFrame, *, column: str = "score", train_rows: int = TRAIN_ROWS, words: int = VOCABULARY) -> DataFrame:
    """The columns of ``docs`` (doc_id, text and any others; one named ``column`` is replaced) and ``column``, 0 to 1."""
    bounded(docs)
    model = fit(docs.select("doc_id", "text"), labels.select("doc_id", "quality"), train_rows=train_rows, words=words)
    docs = docs.drop(column)
    schema = StructType([*docs.schema.fields, StructField(column, DoubleType())])
    # names of our own on the way, as Arrow functions take no name with a dot in it
    plain = docs.toDF(*["text" if c == "text" else f"c{k}" for k, c in enumerate(docs.columns)])
    return plain.mapInArrow(_scores(docs.sparkSession.sparkContext.broadcast(model), docs.columns, column), schema)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents``."""
    scored = classify(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
