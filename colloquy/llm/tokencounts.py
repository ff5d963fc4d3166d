"""Operator 7: token counts of sections.

Method: offset-mapped attribution.  A document is encoded whole, once; each token's place in the text follows from the
bytes that it stands for.  The spans of the tokens are then joined with the spans of the document's sections, by binary
search on both ends.  A token that crosses a boundary is allocated by an explicit rule:

* ``first`` (the default): it belongs to the section that holds its first byte, whole;
* ``share``: each section gets the part of it that its bytes are of the token's.

Sections may overlap or leave gaps; what lies in a gap counts nowhere, what lies in two sections counts in both.  Spans
are code points, the end exclusive; ends beyond the text are cut.  Null counts as an empty text.  A document without
sections gives no row; by :func:`lines` an empty text has one empty section.  Repeated rows, and rows without doc_id, each
give their own rows; an empty table gives an empty table.  Long texts are encoded whole.  Columns other than doc_id, text
and the sections are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from colloquy.llm.bpe import load, vocabulary
from colloquy.llm.packing import batch as record
from colloquy.llm.shared import bounded
from colloquy.llm.words import slices

RULES = ("first", "share")


def lines(text: str) -> list[tuple[int, int]]:
    """Lines with their line feeds as sections."""
    cuts = [0, *(k + 1 for k in _find_all(text)), len(text)]
    return [(s, e) for s, e in zip(cuts, cuts[1:]) if e > s] or [(0, 0)]


def _find_all(text: str) -> Iterator[int]:
    k = text.find("\n")
    while k >= 0:
        yield k
        k = text.find("\n", k + 1)


def attribute(sizes: np.ndarray, starts: np.ndarray, ends: np.ndarray, rule: str = "first") -> tuple[np.ndarray, np.ndarray]:
    """(tokens of each section, tokens that reach over one of its edges); ``sizes``: bytes of the tokens in order, starts
    and ends: sections in bytes."""
    edges = np.concatenate([[0], np.cumsum(sizes)])
    begin = edges[:-1]
    if rule == "share":
        at = np.arange(len(edges), dtype=np.float64)
        count = np.interp(ends, edges, at) - np.interp(starts, edges, at) if len(sizes) else np.zeros(len(starts))
    else:
        count = np.searchsorted(begin, ends, "left") - np.searchsorted(begin, starts, "left")
    # a token crosses where an edge falls strictly between its ends; one that crosses both edges counts once
    over = [np.searchsorted(edges, x, "right") - 1 for x in (starts, ends)]
    inside = [(edges[o] < x) & (x < edges[-1]) for o, x in zip(over, (starts, ends), strict=True)]
    crossing = inside[0].astype(np.int64) + (inside[1] & ~(inside[0] & (over[0] == over[1])))
    return count, np.where(ends > starts, crossing, 0)


def count_tokens(docs: DataFrame, path: str, *, rule: str = "first", sections: str | None = None) -> DataFrame:
    """``doc_id, section, start, end, tokens, crossing, doc_tokens`` for each section of each document, numbered from 0.

    sections: name of a column of ``docs`` (array of struct with start and end); by default the sections are the lines.
    A map without any shuffle; ``tokens`` is a double, whole under ``first``.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    bounded(docs)
    schema = "doc_id bigint, section int, start int, `end` int, tokens double, crossing bigint, doc_tokens bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        size_of = np.array([len(x) for x in bpe.spelling], np.int64)
        for whole in batches:
            for batch in slices(whole, "text"):
                texts = [t or "" for t in batch.column(1).to_pylist()]
                given = batch.column(2).to_pylist() if sections else [None] * len(texts)
                out = []
                for doc, text, own, ids in zip(batch.column(0).to_pylist(), texts, given, bpe.encode(texts), strict=True):
                    spans = lines(text) if not sections else [(max(0, min(x["start"], len(text))), max(0, min(x["end"], len(text)))) for x in own or []]
                    if not spans:
                        continue
                    sizes = size_of[np.frombuffer(ids, "<u4")]
                    raw = np.frombuffer(text.encode(), np.uint8)
                    byte = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))
                    s, e = (np.array(x, np.int64) for x in zip(*spans, strict=True))
                    count, crossing = attribute(sizes, byte[s], byte[e], rule)
                    out.append((np.full(len(s), -1 if doc is None else doc), np.full(len(s), doc is None), np.arange(len(s)), s, e, count, crossing, np.full(len(s), len(sizes))))
                if out:
                    doc, null, k, s, e, count, crossing, total = (np.concatenate(x) for x in zip(*out, strict=True))
                    yield record(doc_id=pa.array(doc, pa.int64(), mask=null), section=pa.array(k, pa.int32()), start=pa.array(s, pa.int32()), end=pa.array(e, pa.int32()), tokens=pa.array(count, pa.float64()), crossing=pa.array(crossing, pa.int64()), doc_tokens=pa.array(total, pa.int64()))

    return docs.select("doc_id", "text", *([sections] if sections else [])).mapInArrow(run, schema)


def op7_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of ``documents``."""
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary())
