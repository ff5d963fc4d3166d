"""Operator 1: byte-level BPE encoding and decoding.

Method: contiguous rank array.  A word's parts stand side by side in an array, and a second array holds the rank of
each adjacent pair.  Again and again the smallest rank is found by a scan, the boundary between its two parts is
deleted, and the ranks of the two neighbours are looked up anew.  All new words of one length are handled at the same
time as rows of a matrix, so each step is one numpy operation over all of them.  That fits short words; a word longer
than :data:`SHORT` bytes (its scans would cost the square of its length) uses a heap of pairs with the same order.

Every text is encoded whole.  Special tokens of the file are recognised in texts as the tokenizers library does by
default.  Null counts as empty; an empty text has no tokens, and decodes to an empty text.  Repeated rows, and rows without
id, each give their own row; an empty table gives an empty table.  Columns of the input other than the id and the text
are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from colloquy.llm.shared import bounded
from colloquy.llm.words import slices

#: Longest word, in bytes, for the rank array.
SHORT = 48
#: Short words whose ids a worker keeps; long ones are encoded anew in each piece of text, so what is kept is bounded.
CACHE_WORDS = 150_000
#: The byte-level pre-tokenizer's pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_NONE = np.int32(2**31 - 1)


def byte_letters() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies: printable bytes stand for
    themselves, the others follow from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return {chr(b if b in plain else next(others)): b for b in range(256)}


class Words(dict):
    """Ids of words as bytes (little-endian, 32 bits each)."""


class ByteBPE:
    """A byte-level BPE vocabulary from a ``tokenizers`` JSON file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, model = byte_letters(), spec["model"]
        spell = {s: bytes(letters[c] for c in s) for s in model["vocab"] if all(c in letters for c in s)}
        self.size = 1 + max([*model["vocab"].values(), *(t["id"] for t in spec.get("added_tokens", []))])
        self.spelling: list[bytes] = [b""] * self.size
        for s, i in model["vocab"].items():
            self.spelling[i] = spell.get(s, s.encode())
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        for s, i in self.special.items():
            self.spelling[i] = s.encode()
        self.byte_id = np.zeros(256, dtype=np.int64)
        for c, b in letters.items():
            self.byte_id[b] = model["vocab"][c]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        vocab = model["vocab"]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys = np.append(keys[order], np.int64(2**62))
        self.ranks = np.append(order.astype(np.int32), _NONE)
        self.made = np.array([vocab[a + b] for a, b in pairs] + [0], dtype=np.int64)
        # Most pairs that are asked for are no merge: one bit of a hashed table answers them.
        self.seen = np.zeros(1 << 20, dtype=bool)
        self.seen[self._slot(keys)] = True
        self.pairs: dict[int, int] | None = None
        self.words = Words()
        self.find = regex.compile(PATTERN).findall
        self.cut = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")").split if self.special else None

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids; the largest number where a pair is no merge."""
        keys = left * self.size + right
        out = np.full(keys.shape, _NONE, dtype=np.int32)
        maybe = np.nonzero(self.seen[self._slot(keys)])
        asked = keys[maybe]
        at = np.searchsorted(self.keys, asked)
        out[maybe] = np.where(self.keys[at] == asked, self.ranks[at], _NONE)
        return out

    def rank_array(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows of ids, ids in each row) for words of one length, given as rows of byte ids."""
        parts = parts.copy()
        n, width = parts.shape
        size = np.full(n, width)
        if width < 2:
            return parts, size
        ranks = self.rank(parts[:, :-1], parts[:, 1:])
        live = np.arange(n)
        columns = np.arange(width)
        while len(live):
            p, r = parts[live], ranks[live]
            at = r.argmin(axis=1)
            least = r[np.arange(len(live)), at]
            on = least != _NONE
            live, p, r, at, least = live[on], p[on], r[on], at[on], least[on]
            if not len(live):
                break
            row = np.arange(len(live))
            made = self.made[least]
            # delete the boundary: what stands right of it moves one place to the left
            source = np.minimum(columns[None, :] + (columns[None, :] > at[:, None]), width - 1)
            p = np.take_along_axis(p, source, 1)
            p[row, at] = made
            r = np.take_along_axis(r, np.minimum(source[:, :-1], width - 2), 1)
            size[live] -= 1
            m = size[live]
            # refresh the neighbouring ranks; places beyond the word's end hold none
            left, right = at > 0, at < m - 1
            r[row[left], at[left] - 1] = self.rank(p[row[left], at[left] - 1], p[row[left], at[left]])
            r[row[right], at[right]] = self.rank(p[row[right], at[right]], p[row[right], at[right] + 1])
            r[columns[None, :-1] >= (m - 1)[:, None]] = _NONE
            parts[live], ranks[live] = p, r
        return parts, size

    def heap(self, word: bytes) -> bytes:
        """A long word: the pair of least rank, the leftmost of equals, merges first, as in the rank array."""
        if self.pairs is None:
            self.pairs = dict(zip(self.keys[:-1].tolist(), self.ranks[:-1].tolist()))
        ids = self.byte_id[np.frombuffer(word, np.uint8)].tolist()
        n, size, pairs, made = len(ids), self.size, self.pairs, self.made
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(k, i, ids[i], ids[i + 1]) for i in range(n - 1) if (k := pairs.get(ids[i] * size + ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            k, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = int(made[k]), -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for x in (before[i], i):
                if x >= 0 and (y := after[x]) < n and (k := pairs.get(ids[x] * size + ids[y])) is not None:
                    heapq.heappush(heap, (k, x, ids[x], ids[y]))
        return np.array([x for x in ids if x >= 0], dtype="<u4").tobytes()

    def learn(self, words: set[str]) -> dict[str, bytes]:
        """Encode words that aren't kept yet, and keep the short ones; long ones are returned."""
        by_length: dict[int, list[tuple[str, bytes]]] = {}
        long: dict[str, bytes] = {}
        for w in words:
            raw = w.encode()
            if len(raw) > SHORT:
                long[w] = self.heap(raw)
            else:
                by_length.setdefault(len(raw), []).append((w, raw))
        for length, group in by_length.items():
            for low in range(0, len(group), 1 << 14):
                some = group[low : low + (1 << 14)]
                rows = np.frombuffer(b"".join(raw for _, raw in some), np.uint8).reshape(-1, length)
                parts, size = self.rank_array(self.byte_id[rows])
                flat, step = parts.astype("<u4").tobytes(), 4 * length
                for k, ((w, _), m) in enumerate(zip(some, size.tolist())):
                    self.words[w] = flat[k * step : k * step + 4 * m]
        return long

    def pieces(self, text: str) -> list[tuple[int | None, list[str]]]:
        """(special id, or None and the words) in order."""
        if self.cut is None or not any(s in text for s in self.special):
            return [(None, self.find(text))]
        return [(self.special[x], []) if x in self.special else (None, self.find(x)) for x in self.cut(text) if x]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts, as little-endian unsigned 32-bit integers."""
        split = [self.pieces(t) for t in texts]
        need: set[str] = set()
        for doc in split:
            for _, words in doc:
                need.update(words)
        if len(self.words) > CACHE_WORDS:
            self.words.clear()
        long = self.learn(need - self.words.keys())
        kept = self.words
        get = kept.__getitem__ if not long else lambda w: long[w] if w in long else kept[w]
        return [b"".join(b"".join(map(get, words)) if i is None else np.uint32(i).astype("<u4").tobytes() for i, words in doc) for doc in split]

    def decode_bytes(self, ids: bytes) -> bytes:
        return b"".join(map(self.spelling.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def decode(self, ids: bytes) -> str:
        """The text of ids, special tokens too; bytes that are no UTF-8 become U+FFFD."""
        return self.decode_bytes(ids).decode("utf-8", "replace")


_loaded: dict[str, ByteBPE] = {}


def load(path: str) -> ByteBPE:
    """The vocabulary at ``path`` on this machine, once for each worker."""
    if path not in _loaded:
        _loaded[path] = ByteBPE(path)
    return _loaded[path]


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode_decode(docs: DataFrame, path: str, *, keep_ids: bool = True, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: its id, ``n_tokens``, ``ids_sha256``, ``decoded_sha256``; with ``keep_ids`` also the real
    outputs, ``ids`` (array of int) and ``decoded`` (the text read back from the ids).

    A map over the documents without any shuffle; a task holds one Arrow batch and handles a megabyte of text at a time.
    """
    bounded(docs)
    schema = f"doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string{', ids array<int>, decoded string' if keep_ids else ''}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for whole in batches:
            for batch in slices(whole, "text"):
                encoded = bpe.encode([t or "" for t in batch.column(1).to_pylist()])
                decoded = [bpe.decode(x) for x in encoded]
                columns = [
                    batch.column(0).cast(pa.int64()),
                    pa.array([len(x) // 4 for x in encoded], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in encoded]),
                    pa.array([hashlib.sha256(x.encode()).hexdigest() for x in decoded]),
                ]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if keep_ids:
                    at = np.cumsum([0, *(len(x) // 4 for x in encoded)]).astype(np.int32)
                    columns += [pa.ListArray.from_arrays(pa.array(at), pa.array(np.frombuffer(b"".join(encoded), "<u4").astype(np.int32))), pa.array(decoded, pa.string())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.selectExpr(f"`{id_column}` AS doc_id", f"`{text_column}` AS text").mapInArrow(run, schema)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents``, encoded and decoded."""
    return encode_decode(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary(), keep_ids=False)
