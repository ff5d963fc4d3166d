"""Operator 9: language-model scoring.

Method: a hidden Markov model over words.  Baum-Welch trains it in rounds; in each, tasks sum the expected counts over
their parts of all training texts (cut into runs of SEGMENT tokens, which are trained as sequences of their own), and the
counts are added across partitions.  The first rounds tell common words apart (those that make up at least 1/COMMON of
the training tokens; the others share a symbol): these counts fit on the driver, and they settle the states.  The last
round gathers the expected counts of every word in every state.  They grow with the corpus and stay with the tasks that
own ranges of words; each word with LEAST training tokens or more gets emission probabilities of its own from them,
mixed with its share among all tokens (MIX), so no state rules a word out.  Rarer words share one symbol, whose words an
add-one unigram spells out, with one unknown word among them.  So the model gives every text a probability.

Scoring runs the scaled forward recursion over each whole text, which gives its exact likelihood under the model.

Tokens: words without ASCII white space, A-Z in lower case, then one end per text.  Null counts as empty: one token, the
end.  Equal rows give equal rows; a null doc_id counts as the empty text when the folds are dealt, that is as training,
and stays null.  Without any training text every token is the unknown word.  An empty table gives an empty table; columns
other than doc_id and text are not read, whatever their names.  Words are told apart by 64-bit hashes: among n different
ones n*n/2**65 pairs are expected to be taken for one.

The corpus is written to the shared folder once, as blocks of some million tokens, each with a dictionary of its own
words; training and scoring read the blocks.  A word of a block is one entry when counts are added, so no task gets more
than an entry for each block however frequent a word is; ranges of words are as many as the entries ask for.  For scoring
the blocks go to their words' probabilities in one shuffle.  The driver gets the common words (COMMON at most), their
expected counts (STATES for each) and a few sums.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from colloquy.llm.packing import batch as record, binaries, bucket_of, planes, runs, unplanes
from colloquy.llm.shared import bounded, deal, written
from colloquy.llm.words import U, buffers, slices, word_hashes

FOLDS, HELD = 7, 2
#: Common words are at least 1/COMMON of the training tokens; words with LEAST training tokens have emissions of their own.
COMMON, LEAST = 8192, 2
STATES = 6
#: Rounds of Baum-Welch, the last one included.
ITERATIONS = 4
SEGMENT = 64
#: Probability, before training, that a state stays.
STAY = 0.97
#: Part of an emission probability that is the word's share among all training tokens.
MIX = 0.2
#: Tokens of a block; entries of dictionaries that one range of words takes.
BLOCK_TOKENS = 1 << 20
RANGE_ENTRIES = 1 << 20
#: Stands for the end of a text; added to expected counts.
END = U(0x5EED0FE11D0FF1CE)
PRIOR = 0.05
#: A word's share in each state is kept in parts of this.
PARTS = 255

_BLOCK = "block bigint, n_train bigint, n_words bigint, docs binary, flags binary, sizes binary, tokens binary, words binary, counts binary"


def held_out(doc_id: Column, folds: int = FOLDS, held: int = HELD) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds == held


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, flags, text -> blocks."""
    parts: list = []
    total = 0
    for whole in batches:
        for part in slices(whole, "text"):
            hashes, firsts = word_hashes(*buffers(part.column(2)))
            size = np.diff(firsts) + 1
            tokens = np.insert(hashes, firsts[1:], END)
            parts.append((part.column(0).to_numpy(zero_copy_only=False).astype(np.int64), part.column(1).to_numpy(zero_copy_only=False).astype(np.uint8), size, tokens))
            total += len(tokens)
            if total >= BLOCK_TOKENS:
                yield _block(parts)
                parts, total = [], 0
    if parts:
        yield _block(parts)


def _block(parts: list) -> pa.RecordBatch:
    docs, flags, size, tokens = (np.concatenate(x) for x in zip(*parts, strict=True))
    words, index = np.unique(tokens, return_inverse=True)
    trained = np.repeat(flags & 1 == 0, size)
    counts = np.bincount(index[trained], minlength=len(words))
    one = lambda x: pa.array([x], pa.binary())
    number = lambda x: pa.array([int(x)], pa.int64())
    return record(
        block=number(int.from_bytes(os.urandom(8), "little", signed=True)),
        n_train=number(trained.sum()),
        n_words=number(len(words)),
        docs=one(planes(docs)),
        flags=one(flags.tobytes()),
        sizes=one(planes(np.cumsum(size), 4)),
        tokens=one(_bytes(index, 4)),
        words=one(words.astype("<u8").tobytes()),
        counts=one(_bytes(counts, 4)),
    )


def _bytes(values: np.ndarray, width: int) -> bytes:
    """Unsigned integers, byte plane by byte plane."""
    return values.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T.tobytes()


def _numbers(data: bytes, width: int) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(width, -1).T.copy().view(f"<u{width}").ravel().astype(np.int64)


def _common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words that are common in a block, with their training tokens there."""
    for b in batches:
        for n, words, counts in zip(b.column(0).to_pylist(), binaries(b.column(1)), binaries(b.column(2)), strict=True):
            w, c = np.frombuffer(words, "<u8"), _numbers(counts, 4)
            some = (c * COMMON >= n) & (c > 0)
            yield record(word=pa.array(w[some].view(np.int64)), n=pa.array(c[some]))


class Model:
    """Parameters over common words: their hashes, sorted; start, transitions, emissions (the last one of all other words)."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, n: int) -> None:
        self.words = words
        rng = np.random.Generator(np.random.PCG64(7))
        share = np.append(counts, max(0, n - int(counts.sum()))) + 1.0
        noise = np.exp(rng.normal(0.0, 0.7, (STATES, len(share))))
        self.emit = share * noise / (share * noise).sum(axis=1, keepdims=True)
        # states that last are told apart sooner: they come to stand for kinds of text
        self.move = np.full((STATES, STATES), (1 - STAY) / (STATES - 1)) + np.eye(STATES) * (STAY - (1 - STAY) / (STATES - 1))
        self.start = np.full(STATES, 1 / STATES)
        self.any = np.full(STATES, 1 / STATES)

    def cells(self) -> int:
        return STATES * (2 + STATES + self.emit.shape[1]) + 1

    def update(self, sums: np.ndarray) -> float:
        """New parameters from expected counts; returns the log-likelihood of the old ones."""
        cuts = np.cumsum([STATES, STATES, STATES * STATES, STATES * (len(self.words) + 1)])
        start, anywhere, move, emit, like = np.split(sums, cuts)
        norm = lambda x: (x + PRIOR) / (x + PRIOR).sum(axis=-1, keepdims=True)
        self.start, self.any = norm(start), norm(anywhere)
        self.move, self.emit = norm(move.reshape(STATES, STATES)), norm(emit.reshape(STATES, -1))
        return float(like[0])

    def symbols(self, words: np.ndarray) -> np.ndarray:
        """Symbol of each word of a block's dictionary."""
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        return np.where(self.words[at] == words, at, len(self.words)).astype(np.int64)


def posteriors(model: Model, symbols: np.ndarray, firsts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """(probability of each state at each token, expected starts, expected transitions, log-likelihood) of the texts, cut
    into segments."""
    per = -(-sizes // SEGMENT)
    k = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
    begin = np.repeat(firsts, per) + k * SEGMENT
    size = np.minimum(SEGMENT, np.repeat(firsts + sizes, per) - begin)
    order = np.argsort(-size, kind="stable")
    begin, size, first = begin[order], size[order], (k == 0)[order]
    n, steps = len(begin), int(size[0]) if len(size) else 0
    live = np.searchsorted(-size, -np.arange(steps), "left")
    emit, move = model.emit.T.astype(np.float32).copy(), model.move.astype(np.float32)
    alpha = np.empty((steps, n, STATES), np.float32)
    scale = np.empty((steps, n), np.float32)
    like = 0.0
    for t in range(steps):
        m = live[t]
        e = emit[symbols[begin[:m] + t]]
        a = (np.where(first[:m, None], model.start, model.any).astype(np.float32) if t == 0 else alpha[t - 1, :m] @ move) * e
        s = a.sum(axis=1)
        alpha[t, :m] = a / s[:, None]
        scale[t, :m] = s
        like += float(np.log(s, dtype=np.float64).sum())
    gamma = np.zeros((len(symbols), STATES), np.float32)
    beta = np.ones((n, STATES), np.float32)
    xi = np.zeros((STATES, STATES))
    start = np.zeros(STATES)
    for t in range(steps - 1, -1, -1):
        m = live[t]
        at = begin[:m] + t
        g = alpha[t, :m] * beta[:m]
        g /= g.sum(axis=1, keepdims=True)
        gamma[at] = g
        if t == 0:
            start = g[first[:m]].sum(axis=0, dtype=np.float64)
        else:
            w = emit[symbols[at]] * beta[:m] / scale[t, :m, None]
            xi += model.move * (alpha[t - 1, :m].T @ w)
            beta[:m] = w @ move.T
    return gamma, start, xi, like


def _by_label(gamma: np.ndarray, labels: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(labels, weights=gamma[:, j], minlength=n) for j in range(STATES)])


def expected(model: Model, symbols: np.ndarray, firsts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Expected counts over the texts: start, any, transitions, emissions, log-likelihood."""
    gamma, start, xi, like = posteriors(model, symbols, firsts, sizes)
    out = _by_label(gamma, symbols, len(model.words) + 1)
    return np.concatenate([start, gamma.sum(axis=0, dtype=np.float64), xi.ravel(), out.ravel(), [like]])


def forward(start: np.ndarray, move: np.ndarray, emit: np.ndarray, symbols: np.ndarray, firsts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """log10 probability of each text's symbols (emit: a row for each): the scaled forward recursion over the whole text,
    all texts of the block in step; the longest go first, so that those that go on are a prefix."""
    order = np.argsort(-sizes, kind="stable")
    begin, size = firsts[order], sizes[order]
    live = np.searchsorted(-size, -np.arange(int(size[0]) if len(size) else 0), "left")
    total = np.zeros(len(size))
    a = np.zeros((len(size), STATES))
    for t, m in enumerate(live.tolist()):
        a = (a[:m] @ move if t else np.broadcast_to(start, (m, STATES))) * emit[symbols[begin[:m] + t]]
        s = a.sum(axis=1)
        a /= s[:, None]
        total[:m] += np.log10(s)
    out = np.empty(len(size))
    out[order] = total
    return out


def _texts(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(doc ids, flags, first tokens, sizes, token indices, dictionary)."""
    ends = unplanes(row["sizes"], 4)
    size = np.diff(ends, prepend=0)
    return unplanes(row["docs"]), np.frombuffer(row["flags"], np.uint8), ends - size, size, _numbers(row["tokens"], 4), np.frombuffer(row["words"], "<u8")


def _training(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(token indices, first tokens, sizes, dictionary) of the texts outside the held-out fold."""
    _, flags, _, size, index, words = _texts(row)
    on = flags & 1 == 0
    own = size[on]
    return index[np.repeat(on, size)], np.cumsum(own) - own, own, words


def _train(shipped):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shipped.value
        sums = np.zeros(model.cells())
        for b in batches:
            for row in b.to_pylist():
                index, first, size, words = _training(row)
                if len(size):
                    sums += expected(model, model.symbols(words)[index], first, size)
        yield record(cell=pa.array(np.arange(len(sums)), pa.int32()), value=pa.array(sums))

    return run


def train(blocks: DataFrame, model: Model, iterations: int = ITERATIONS) -> list[float]:
    """Baum-Welch over common words, in place; returns the log-likelihood before each step."""
    likes = []
    for _ in range(iterations):
        shipped = blocks.sparkSession.sparkContext.broadcast(model)
        sums = np.zeros(model.cells())
        for cell, value in blocks.select("docs", "flags", "sizes", "tokens", "words").mapInArrow(_train(shipped), "cell int, value double").groupBy("cell").agg(F.sum("value")).collect():
            sums[cell] = value
        likes.append(model.update(sums))
    return likes


def in_parts(share: np.ndarray) -> np.ndarray:
    """Rows of shares, which add up to one each, as whole parts that add up to PARTS."""
    parts = np.floor(share * PARTS + 0.5).astype(np.int64)
    most = share.argmax(axis=1)
    parts[np.arange(len(parts)), most] += PARTS - parts.sum(axis=1)
    return parts.astype(np.uint8)


_DEALT = "label int, place int, block bigint, words binary, counts binary, parts binary"


def _deal(shipped, labels: list[int]):
    """The last round's expected counts: for each block and range of words the words, their training tokens and the states'
    parts in these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shipped.value
        for b in batches:
            for row in b.to_pylist():
                index, first, size, words = _training(row)
                counts = _numbers(row["counts"], 4)
                sums = np.zeros((len(words), STATES))
                if len(size):
                    sums = _by_label(posteriors(model, model.symbols(words)[index], first, size)[0], index, len(words)).T
                parts = in_parts(sums / np.maximum(sums.sum(axis=1, keepdims=True), 1e-30))
                parts[counts == 0] = 0
                place = bucket_of(words, len(labels))  # words are sorted, and so are their ranges
                for s in np.split(np.arange(len(words)), runs(place)[1:]):
                    if len(s):
                        k = int(place[s[0]])
                        one = lambda x: pa.array([x], pa.binary())
                        yield record(label=pa.array([labels[k]], pa.int32()), place=pa.array([k], pa.int32()), block=pa.array([row["block"]], pa.int64()), words=one(words[s].tobytes()), counts=one(_bytes(counts[s], 4)), parts=one(parts[s].T.tobytes()))

    return run


_OWNED = "block bigint, place int, totals binary, parts binary, sums array<double>"


def _own(least: int):
    """The owner of a range of words: for each block its words' training tokens and parts (zeros for rare words); and, in a
    row without block, sums: tokens, types, those of rare words, expected counts by state of rare words and of others."""

    def run(table: pa.Table) -> pa.Table:
        words = [np.frombuffer(x, "<u8") for x in binaries(table.column("words"))]
        counts = np.concatenate([_numbers(x, 4) for x in binaries(table.column("counts"))])
        parts = np.concatenate([np.frombuffer(x, np.uint8).reshape(STATES, -1).T for x in binaries(table.column("parts"))])
        every, index = np.unique(np.concatenate(words), return_inverse=True)
        add = lambda x: np.bincount(index, weights=x, minlength=len(every))
        total = add(counts).astype(np.int64)
        sums = np.stack([add(counts * parts[:, j].astype(np.int64)) for j in range(STATES)], axis=1) / PARTS
        share = in_parts(sums / np.maximum(sums.sum(axis=1, keepdims=True), 1e-30))
        rare = total < least
        share[rare] = 0
        states = (share * (total / PARTS)[:, None]).sum(axis=0)
        whole = [float(total.sum()), float((total > 0).sum()), float(total[rare].sum()), float((rare & (total > 0)).sum()), *sums[rare].sum(axis=0).tolist(), *states.tolist()]
        cuts = np.cumsum([len(x) for x in words])[:-1]
        place = table.column("place")[0].as_py()
        blocks = table.column("block").to_pylist()
        totals = [_bytes(x, 8) for x in np.split(total[index], cuts)]
        shares = [x.T.tobytes() for x in np.split(share[index], cuts)]
        n = len(blocks)
        return pa.table(
            {
                "block": pa.array([*blocks, None], pa.int64()),
                "place": pa.array([place] * (n + 1), pa.int32()),
                "totals": pa.array([*totals, None], pa.binary()),
                "parts": pa.array([*shares, None], pa.binary()),
                "sums": pa.array([None] * n + [whole], pa.list_(pa.float64())),
            }
        )

    return run


class Scorer:
    """What scoring needs besides a block's own words: start, transitions, and sums over all words."""

    def __init__(self, model: Model, sums: np.ndarray) -> None:
        self.start, self.move = model.start, model.move
        self.n, self.types, self.rare_n, self.rare_types = sums[:4]
        self.rare, self.states = sums[4 : 4 + STATES], sums[4 + STATES :]

    def emissions(self, totals: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(probability of each word's symbol in each state, log10 probability of the word in its symbol)."""
        all_of = self.states + self.rare + 1
        emit = (1 - MIX) * totals[:, None] * parts / PARTS / all_of + (MIX * totals / (self.n + 1))[:, None]
        shared = parts.sum(axis=1) == 0
        emit[shared] = (1 - MIX) * (self.rare + 1) / all_of + MIX * (self.rare_n + 1) / (self.n + 1)
        return emit, np.where(shared, np.log10((totals + 1) / (self.rare_n + self.rare_types + 1)), 0.0)


def _score(shipped):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = shipped.value
        for b in batches:
            for row in b.to_pylist():
                docs, flags, first, size, index, words = _texts(row)
                own = sorted(row["owned"], key=lambda x: x["place"])
                totals = np.concatenate([_numbers(x["totals"], 8) for x in own]).astype(np.float64)
                parts = np.concatenate([np.frombuffer(x["parts"], np.uint8).reshape(STATES, -1).T for x in own]).astype(np.float64)
                emit, spelled = scorer.emissions(totals, parts)
                add = lambda x: np.add.reduceat(x[index], first) if len(first) else np.zeros(0)
                yield record(
                    doc_id=pa.array(docs, pa.int64(), mask=flags & 2 > 0),
                    held_out=pa.array(flags & 1 > 0),
                    n_tokens=pa.array(size, pa.int64()),
                    n_known=pa.array(add((totals > 0).astype(np.int64)), pa.int64()),
                    train_tokens=pa.array(np.full(len(docs), int(scorer.n)), pa.int64()),
                    base_score=pa.array(add(np.log10(totals + 1)) - size * np.log10(scorer.n + scorer.types + 1)),
                    score=pa.array(forward(scorer.start, scorer.move, emit, index, first, size) + add(spelled)),
                )

    return run


def encode_corpus(docs: DataFrame, folds: int = FOLDS, held: int = HELD) -> DataFrame:
    """The corpus as blocks, in the shared folder."""
    flags = held_out(F.col("doc_id"), folds, held).cast("int") + F.when(F.col("doc_id").isNull(), 2).otherwise(0)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0)).alias("doc_id"), flags.alias("flags"), "text")
    return written(rows.mapInArrow(_blocks, _BLOCK), "corpus")


_SCORED = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def score_texts(docs: DataFrame, *, folds: int = FOLDS, held: int = HELD, iterations: int = ITERATIONS, least: int = LEAST) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for each row of ``docs`` (doc_id, text);
    trained on the rows outside the held-out fold."""
    spark = bounded(docs)
    blocks = encode_corpus(docs, folds, held)
    n, entries = (x or 0 for x in blocks.agg(F.sum("n_train"), F.sum("n_words")).first())
    common = blocks.select("n_train", "words", "counts").mapInArrow(_common, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    often = {np.uint64(np.int64(w).view(np.uint64)): c for w, c in common.where(F.col("n") * COMMON >= n).collect()}
    often.setdefault(END, 0)
    words = np.array(sorted(often), np.uint64)
    model = Model(words, np.array([often[w] for w in words], np.float64), int(n))
    if n:
        train(blocks, model, iterations - 1)
    labels = deal(spark, max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-entries // RANGE_ENTRIES)))
    dealt = blocks.select("block", "docs", "flags", "sizes", "tokens", "words", "counts").mapInArrow(_deal(spark.sparkContext.broadcast(model), labels), _DEALT)
    owned = written(dealt.groupBy("label").applyInArrow(_own(least), _OWNED), "owned")
    sums = owned.where("block IS NULL").select(F.posexplode("sums").alias("k", "x")).groupBy("k").agg(F.sum("x").alias("x")).collect()
    whole = np.zeros(4 + 2 * STATES)
    for k, x in sums:
        whole[k] = x
    parts = owned.where("block IS NOT NULL").groupBy("block").agg(F.collect_list(F.struct("place", "totals", "parts")).alias("owned"))
    joined = blocks.drop("n_train", "n_words", "counts").join(parts, "block").select("docs", "flags", "sizes", "tokens", "words", "owned")
    return joined.mapInArrow(_score(spark.sparkContext.broadcast(Scorer(model, whole))), _SCORED)


def op9_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All whole texts of ``documents``."""
    return score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
