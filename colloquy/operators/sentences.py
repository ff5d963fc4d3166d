"""Tagged sentences as transcript tiers, and tokens of a tagger brought back to the words of a line.

Each function works on one sentence; the DataFrame forms run them in Arrow batches over arrays of words, so sentences are
independent rows and no group of them meets in a task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from colloquy.operators.transfer import character_matches
from colloquy.schema import ENDING_PUNCT, MOR_PUNCT, NO_CONTENT

#: Stands for a special form while a line is tagged.
PLACEHOLDER = "xbxxx"
#: Words that join the next one, by language; and beginnings that join the one before.
JOINS_NEXT = {"fr": r"(?:jusqu|puisqu|quelqu|aujourd)'|.'", "it": r".*ll'|gliel'|d'|c['’]|qual'"}
JOINS_BEFORE = ("-", "_", "~")


def tiers(words: list[dict], tokens: list[dict], delimiter: str = ".", special: list[tuple[str, str]] = (), lang: str = "") -> tuple[str, str]:
    """(%mor, %gra) of a tagged sentence.

    words: id (from 1), text, mor (``pos|lemma-...`` or None for one that is not written), head, deprel.  tokens: first and
    last word id, text.  special: (form, code) of the special forms in the order of their placeholders.

    A word that is not written, or a lone 0 (the mark of an omitted word: it is written in front of the next), has no
    place in %gra: numbers close up, and what depended on it depends on the root.  Words of one token, and clitics that
    were split off, are joined by ``~``.  The delimiter ends both tiers.  A sentence without content has neither."""
    left = list(special)
    items: list[str | None] = []
    number: list[int | None] = []
    flat: set[int] = set()
    for w in words:
        text = w["text"].strip()
        if text == "0":
            items.append("0")
            number.append(None)
            continue
        mor = {"‡": "cm|begin", "„": "cm|end"}.get(text, w["mor"])
        if PLACEHOLDER in text:
            form, code = left.pop(0) if left else (text, "x")
            mor = "L2|xxx" if code.startswith("s") else f"{code.strip()}|{form.strip().replace(',', 'cm')}"
        items.append(mor)
        number.append(1 + sum(n is not None for n in number) if mor else None)
        if PLACEHOLDER in text:
            flat.add(len(items) - 1)
    root = next((number[k] for k, w in enumerate(words) if number[k] and w["deprel"].upper() == "ROOT"), 0)
    edges = []
    for k, w in enumerate(words):
        if number[k] is None:
            continue
        head = w["head"]
        to = 0 if not head else root if number[head - 1] is None else number[head - 1]
        rel = "FLAT" if k in flat else re.sub("[<>]", "", w["deprel"].upper().replace(":", "-"))
        edges.append(f"{number[k]}|{to}|{rel}")
    edges.append(f"{len(edges) + 1}|{root}|PUNCT")
    # what belongs to one word
    joined = [False] * len(items)
    for k, t in enumerate(tokens):
        for i in range(t["first"], t["last"]):
            joined[i] = True
        text = t["text"].strip()
        if text.startswith(JOINS_BEFORE) and t["first"] > 1:
            joined[t["first"] - 1] = True
        if lang in JOINS_NEXT and re.fullmatch(JOINS_NEXT[lang], text) and k + 1 < len(tokens):
            joined[t["last"]] = True
    out: list[str] = []
    omitted = False
    for item, with_last in zip(items, joined, strict=True):
        if item is None:
            continue
        if item == "0":
            omitted = True
            continue
        item = item.replace(",", "").replace("<UNK>", "")
        if with_last and out and not omitted:
            out[-1] += "~" + item
        else:
            out.append("0" + item if omitted else item)
        omitted = False
    if not out or (len(out) == 1 and out[0] in ENDING_PUNCT):
        return "", ""
    return " ".join(out) + " " + delimiter, " ".join(edges).replace("<UNK>", "")


def realigned(tokens: list[str], line: str, lang: str = "en") -> list[tuple[str, bool]]:
    """(token, whether a tagger may split it) for a tagger's tokens, put together as the words of ``line`` stand: tokens
    that share a word are one, by an alignment of the characters.  What a language writes as one word, or as several,
    against its tokens follows."""
    pieces = [p for t in tokens for p in t.split(" ") if p]
    words = [w for w in line.split(" ") if w]
    of: dict[int, list[int]] = {}
    seen: set[int] = set()
    for w, t in character_matches(words, pieces):
        if t not in seen:
            seen.add(t)
            of.setdefault(w, []).append(t)
    merged = [("".join(pieces[t] for t in of[w]), False) for w in sorted(of)]
    out: list[tuple[str, bool]] = []
    for text, _ in merged:
        if lang == "it" and text == "i" and out and out[-1][0] == "le":
            out[-1] = ("lei", False)
        elif lang == "fr" and text.startswith("aujourd'"):
            out.append(("aujourd'hui", False))
        elif lang == "fr" and text == "hui" and out and out[-1][0] == "aujourd'hui":
            continue
        elif (lang == "fr" and text == "au") or (lang == "pt" and text == "d'água"):
            out.append((text, True))
        elif lang == "fr" and (re.fullmatch(r"(?:\w')+\w+", text) or text.split("'")[0] in ("jusqu", "puisqu", "quelqu")):
            out += [(p, False) for p in re.findall(r"[^']+'|[^']+", text)]
        else:
            out.append((text, lang == "en" and "'" in text and text.split("'")[0].strip() != "o"))
    return out


def _written(chunk: str) -> bool:
    """Whether a piece of a line is a word that a tagger saw: no group mark, code, filled pause, special form or sign."""
    return bool(chunk) and chunk[0] not in "<[&\x15()" and chunk[-1] != "]" and "@" not in chunk and chunk not in [*MOR_PUNCT, *NO_CONTENT, "++"]


def retokenized_line(line: str, tokens: list[str]) -> str:
    """``line`` with a tagger's ``tokens`` in place of the words that they were made of; everything else stays where it is.
    A token belongs to the piece that its first matched character is of; a piece that no token matches stays."""
    chunks = line.split(" ")
    own = [k for k, c in enumerate(chunks) if _written(c)]
    first: dict[int, int] = {}
    for c, t in character_matches([chunks[k] for k in own], tokens):
        first.setdefault(t, own[c])
    out = []
    for k, chunk in enumerate(chunks):
        mine = [tokens[t] for t in sorted(first) if first[t] == k]
        out += mine if mine else [chunk] if chunk and (k not in own or k not in first.values()) else []
    return re.sub(" +", " ", " ".join(out)).replace("< ", "<").replace(" >", ">").replace("+ ,", "+,").strip()


_SENTENCE = "words array<struct<id:int,text:string,mor:string,head:int,deprel:string>>, tokens array<struct<first:int,last:int,text:string>>"


def tier_columns(sentences: DataFrame, lang: str = "") -> DataFrame:
    """``sentences`` (words, tokens, delimiter, special: array of form and code) with ``mor`` and ``gra``."""

    @F.pandas_udf("struct<mor:string,gra:string>")
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for columns in batches:
            rows = [tiers([dict(x) for x in w], [dict(x) for x in t], d, [(x["form"], x["code"]) for x in s], lang) for w, t, d, s in zip(*columns, strict=True)]
            yield pd.DataFrame(rows, columns=["mor", "gra"])

    return sentences.withColumn("x", run("words", "tokens", "delimiter", "special")).select(*sentences.columns, "x.mor", "x.gra")


def realigned_tokens(lines: DataFrame, lang: str = "en") -> DataFrame:
    """``lines`` (text, tokens) with ``realigned``: array of token and whether it may be split."""

    @F.pandas_udf("array<struct<token:string,split:boolean>>")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, tokens in batches:
            yield pd.Series([[{"token": a, "split": b} for a, b in realigned([*k], t, lang)] for t, k in zip(texts, tokens, strict=True)], dtype=object)

    return lines.withColumn("realigned", run("text", "tokens"))


def retokenized_lines(lines: DataFrame) -> DataFrame:
    """``lines`` (text, tokens) with ``line``: :func:`retokenized_line`."""

    @F.pandas_udf("string")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, tokens in batches:
            yield pd.Series([retokenized_line(t, [*k]) for t, k in zip(texts, tokens, strict=True)], dtype=object)

    return lines.withColumn("line", run("text", "tokens"))
