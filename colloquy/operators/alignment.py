"""Sequence-alignment join: minimum-edit alignment of two ordered token lists (match 0, insert or delete 1, replace 2)."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from colloquy.functions import text as T
from colloquy.operators import sequence

#: Cells up to which the whole table is kept; beyond, the problem is split in linear space.
TABLE_CELLS = 2048
Item = tuple[str, int, int]


def _same(x, y) -> bool:
    return x == y


class _Problem:
    """Two lists as codes, and which other codes the predicate takes for the same as one."""

    def __init__(self, payload: list, reference: list, same: Callable) -> None:
        codes: dict = {}
        self.p, self.r = (np.array([codes.setdefault(x, len(codes)) for x in side], np.int64) for side in (payload, reference))
        self.also: dict[int, list[int]] = {}
        if same is not _same:
            words = list(codes)
            plain = getattr(same, "plain", None)  # items that are the same as other such items only if they are equal
            for k in (k for k, w in enumerate(words) if not (plain and plain(w))):
                for j, x in enumerate(words):
                    if j != k:
                        if same(words[k], x):
                            self.also.setdefault(j, []).append(k)
                        if same(x, words[k]):
                            self.also.setdefault(k, []).append(j)

    def hits(self, i: int, columns: slice) -> np.ndarray:
        """Where the payload is the same as the i-th item of the reference."""
        own = self.p[columns]
        hit = own == self.r[i]
        for other in self.also.get(int(self.r[i]), ()):
            hit |= own == other
        return hit

    def rows(self, p0: int, p1: int, r0: int, r1: int, backwards: bool = False) -> Iterator[np.ndarray]:
        """Rows of costs of all prefixes of the payload's part against longer and longer ones of the reference's part; from
        the ends on if ``backwards``."""
        m = p1 - p0
        steps = np.arange(m + 1)
        row = steps.copy()
        yield row
        columns = slice(p0, p1)
        for i in range(r1 - 1, r0 - 1, -1) if backwards else range(r0, r1):
            hit = self.hits(i, columns)
            if backwards:
                hit = hit[::-1]
            new = row + 1
            new[1:] = np.minimum(new[1:], row[:-1] + np.where(hit, 0, 2))
            row = np.minimum.accumulate(new - steps) + steps  # an insertion costs one for each column
            yield row


def _last(rows: Iterator[np.ndarray]) -> np.ndarray:
    for row in rows:
        pass
    return row


def _row(payload: list, reference: list, same: Callable = _same) -> list[int]:
    """Last row of costs of all prefixes of ``payload`` against the whole ``reference``."""
    return _last(_Problem(payload, reference, same).rows(0, len(payload), 0, len(reference))).tolist()


def matches(payload: list, reference: list, same: Callable = _same) -> int:
    """How many items of a best alignment match."""
    if payload == reference:
        return len(payload)
    return (len(payload) + len(reference) - _row(payload, reference, same)[-1]) // 2


def _table(problem: _Problem, p0: int, p1: int, r0: int, r1: int) -> list[Item]:
    cost = np.stack(list(problem.rows(p0, p1, r0, r1))).tolist()
    out: list[Item] = []
    i, j = r1 - r0, p1 - p0
    hits = [problem.hits(r0 + k, slice(p0, p1)).tolist() for k in range(i)]
    while i or j:
        here = cost[i][j]
        if i and j:
            hit = hits[i - 1][j - 1]
            if here == cost[i - 1][j - 1] + (0 if hit else 2):
                if hit:
                    out.append(("match", p0 + j - 1, r0 + i - 1))
                else:
                    out += [("payload", p0 + j - 1, -1), ("reference", -1, r0 + i - 1)]
                i, j = i - 1, j - 1
                continue
        if i and here == cost[i - 1][j] + 1:
            out.append(("reference", -1, r0 + i - 1))
            i -= 1
        else:
            out.append(("payload", p0 + j - 1, -1))
            j -= 1
    return out[::-1]


def align(payload: list, reference: list, same: Callable = _same) -> list[Item]:
    """(op, payload index, reference index) in order; op: match, payload (only there), reference (only there).

    Ties: diagonal, then an extra of the reference, then of the payload.  Large problems are halved at the middle of the
    reference and at the first payload split of least cost, so memory grows with a side's length alone.
    """
    if payload == reference:  # every item is the same as itself: there is no other best alignment
        return [("match", k, k) for k in range(len(payload))]
    problem = _Problem(payload, reference, same)
    out: list[Item] = []
    todo = [(0, len(payload), 0, len(reference))]
    while todo:
        p0, p1, r0, r1 = todo.pop()
        n, m = r1 - r0, p1 - p0
        if not n or not m:
            out += [("payload", j, -1) for j in range(p0, p1)] + [("reference", -1, i) for i in range(r0, r1)]
        elif n <= 1 or m <= 1 or n * m <= TABLE_CELLS:
            out += _table(problem, p0, p1, r0, r1)
        else:
            half = r0 + n // 2
            total = _last(problem.rows(p0, p1, r0, half)) + _last(problem.rows(p0, p1, half, r1, backwards=True))[::-1]
            k = p0 + int(total.argmin())
            todo += [(k, p1, half, r1), (p0, k, r0, half)]
    return out


def word_errors(items: list[Item], reference: list[str]) -> tuple[int, int, int]:
    """(substitutions, deletions, insertions): neighbouring extras of different sides are one substitution.  An extra of
    the reference that holds a placeholder name (``name`` inside, not at the start) matches the payload's extra next to it."""
    sub = dele = ins = 0
    previous, before, waiting = None, None, False
    for op, _, r in items:
        if op == "match":
            previous = before = None
            continue
        if op == "reference" and "name" in reference[r] and not reference[r].startswith("name"):
            waiting, before = before != "payload", None
            continue
        if op == "payload" and waiting:
            waiting = False
            continue
        if previous is not None and previous != op:
            sub += 1
            ins, dele = (ins - 1, dele) if previous == "reference" else (ins, dele - 1)
            previous = None
        else:
            previous = op
            ins, dele = (ins + 1, dele) if op == "reference" else (ins, dele + 1)
        before = op
    return sub, dele, ins


def same_word(x: str, y: str) -> bool:
    """:func:`colloquy.functions.text.same_word` for two words in lower case."""
    if x == y or not ("(" in x or ")" in x or "(" in y or ")" in y):
        return x == y
    bare = lambda w: w.replace("(", "").replace(")", "")
    cut = lambda w: re.sub(r"\(.*\)", "", w)
    return bare(x) == bare(y) or cut(x) == y or x == cut(y)


same_word.plain = lambda w: "(" not in w and ")" not in w


def diff_lines(items: list[Item], payload: list[str], reference: list[str]) -> str:
    sign = {"match": "  ", "payload": "- ", "reference": "+ "}
    return "\n".join(sign[op] + (reference[r] if op == "reference" else payload[p]) for op, p, r in items)


_ALIGNED = "array<struct<op:string,payload_idx:int,reference_idx:int>>"


def aligned(payload: Column, reference: Column) -> Column:
    """The alignment of two arrays of strings, in Arrow batches: the path is a sequential fold, so it is no native form."""

    @F.pandas_udf(_ALIGNED)
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for p, r in batches:
            yield pd.Series([[{"op": o, "payload_idx": x, "reference_idx": y} for o, x, y in align(list(a), list(b))] for a, b in zip(p, r, strict=True)])

    return run(payload, reference)


def distance(payload: Column, reference: Column) -> Column:
    """Edit distance of two arrays, natively: a fold over the reference whose state is the row of costs."""
    first = F.sequence(F.lit(0), F.size(payload))

    def step(row: Column, r: Column) -> Column:
        start = F.struct(F.array(F.element_at(row, 1) + 1).alias("out"), F.lit(1).alias("j"))

        def cell(acc: Column, p: Column) -> Column:
            j = acc["j"]
            best = F.least(F.element_at(row, j + 1) + 1, F.element_at(acc["out"], -1) + 1, F.element_at(row, j) + F.when(p == r, 0).otherwise(2))
            return F.struct(F.concat(acc["out"], F.array(best)).alias("out"), (j + 1).alias("j"))

        return F.aggregate(payload, start, cell, lambda acc: acc["out"])

    return F.when((F.size(payload) == 0) | (F.size(reference) == 0), F.size(payload) + F.size(reference)).otherwise(F.element_at(F.aggregate(reference, first, step), -1))


def indels(payload: list, reference: list) -> int:
    """The same distance in a few operations on long integers for each item of the reference: with replacements at 2 it
    is what a longest common subsequence leaves over on both sides.  A zero bit is an item of it."""
    places: dict = {}
    for j, p in enumerate(payload):
        places[p] = places.get(p, 0) | 1 << j
    full = (1 << len(payload)) - 1
    row = full
    for r in reference:
        hit = row & places.get(r, 0)
        row = (row + hit | row - hit) & full
    return len(payload) + len(reference) - 2 * (len(payload) - row.bit_count())


def whole_distance(payload: Column, reference: Column) -> Column:
    """Edit distance of two arrays of any length, in Arrow batches: :func:`distance` copies its row for every cell."""

    @F.pandas_udf("int")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for p, r in batches:
            yield pd.Series([indels(list(a), list(b)) for a, b in zip(p, r, strict=True)], dtype="int32")

    return run(payload, reference)


def plain_words(forms: DataFrame) -> DataFrame:
    """Forms that are no punctuation, without hyphens inside."""
    return forms.where("type <> 5").withColumn("text", F.replace("text", F.lit("-"), F.lit("")))


def adjacent_turns(forms: DataFrame) -> DataFrame:
    """Each turn's words (payload) and those of the turn before (reference): ``doc_id, line_no, payload, reference``."""
    from pyspark.sql import Window

    lists = forms.where("type = 0").groupBy("doc_id", "line_no").agg(F.array_sort(F.collect_list(F.struct("form_no", F.lower("text").alias("w")))).alias("x"))
    lists = lists.select("doc_id", "line_no", F.transform("x", lambda x: x["w"]).alias("payload"))
    return lists.withColumn("reference", F.lag("payload").over(Window.partitionBy("doc_id").orderBy("line_no"))).where("reference IS NOT NULL")


_ERRORS = "struct<match:bigint,payload:bigint,reference:bigint,substitutions:bigint,deletions:bigint,insertions:bigint>"


def errors(payload: Column, reference: Column) -> Column:
    """What the alignment of two arrays of words by the fuzzy predicate counts: matches, extras, and word errors."""

    @F.pandas_udf(_ERRORS)
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for p, r in batches:
            rows = []
            for a, b in zip(p, r, strict=True):
                items = align([w.lower() for w in a], [w.lower() for w in b], same_word)
                ops = [o for o, _, _ in items]
                rows.append([*(ops.count(o) for o in ("match", "payload", "reference")), *word_errors(items, list(b))])
            yield pd.DataFrame(rows, columns=["match", "payload", "reference", "substitutions", "deletions", "insertions"])

    return run(payload, reference)


def compared_turns(forms: DataFrame) -> DataFrame:
    """Each turn's words (payload) and those of the turn before (reference) as the word error rate compares them: without
    hyphens, the payload's single letters glued, both conformed; ``words`` counts those of the reference before that."""
    from pyspark.sql import Window

    plain = plain_words(forms)

    def turns(rows: DataFrame, order: str, name: str) -> DataFrame:
        x = F.array_sort(F.collect_list(F.struct(order, T.conform(F.col("text")).alias("w"))))
        return rows.groupBy("doc_id", "line_no").agg(F.flatten(F.transform(x, lambda x: x["w"])).alias(name), F.count(F.lit(1)).alias("words"))

    before = Window.partitionBy("doc_id").orderBy("line_no")
    gold = turns(plain, "form_no", "reference").select("doc_id", "line_no", *[F.lag(c).over(before).alias(c) for c in ("reference", "words")]).where("reference IS NOT NULL")
    return turns(sequence.glued_letters(plain), "first", "payload").drop("words").join(gold, ["doc_id", "line_no"])
