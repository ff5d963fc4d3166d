"""Numbers as words: Chinese and English numerals by rule, others by a table."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

# Digits and units, plain and financial, simplified and traditional.
DIGITS = {(False, True): "零一二三四五六七八九", (False, False): "零一二三四五六七八九", (True, True): "零壹贰叁肆伍陆柒捌玖", (True, False): "零壹貳參肆伍陸柒捌玖"}
UNITS = {(False, True): ["", "十", "百", "千"], (False, False): ["", "十", "百", "千"], (True, True): ["", "拾", "佰", "仟"], (True, False): ["", "拾", "佰", "仟"]}
GROUPS = {True: ["", "万", "亿", "兆"], False: ["", "萬", "億", "兆"]}
#: Digits that the names of groups reach.
_RUN = 16


def chinese(n: int | str, financial: bool = False, simplified: bool = True, zero: str = "", pair: bool = False) -> str:
    """A number in Chinese: groups of four digits, one zero for a gap, 10 to 19 without a leading one; the digits behind a
    point one by one.  Numbers of more than 16 digits are read digit by digit, as no unit is left for them.

    zero: the sign of a zero (〇, for example) in place of the usual one.  pair: two before a hundred, a thousand or a group
    is 两 (兩)."""
    text = str(n)
    if text.startswith("-"):
        return ("负" if simplified else "負") + chinese(text[1:], financial, simplified, zero, pair)
    whole, _, part = text.partition(".")
    digits = DIGITS[financial, simplified]
    if zero:
        digits = zero + digits[1:]
    if part:
        return chinese(whole or "0", financial, simplified, zero, pair) + ("点" if simplified else "點") + "".join(digits[int(c)] for c in part)
    whole = whole.lstrip("0") or "0"
    if whole == "0":
        return digits[0]
    if len(whole) > _RUN:
        return "".join(digits[int(c)] for c in whole)
    units, groups = UNITS[financial, simplified], GROUPS[simplified]
    two = "两" if simplified else "兩"
    value, out, gap = int(whole), "", False
    for g in range(len(groups) - 1, -1, -1):
        four = value // 10 ** (4 * g) % 10_000
        if not four:
            gap = bool(out)
            continue
        for u in range(3, -1, -1):
            d = four // 10**u % 10
            if d:
                alone = d == 2 and pair and not financial and (u >= 2 or (u == 0 and g > 0 and four == 2))
                out += (digits[0] if gap else "") + (two if alone else digits[d]) + units[u]
                gap = False
            elif out:
                gap = True
        out += groups[g]
        gap = False if four % 10 else gap
    if not financial and out.startswith(digits[1] + units[1]):
        out = out[1:]
    return out


def _mapped(text: Column, spell: Callable[[str], str]) -> Column:
    @F.pandas_udf(StringType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield b.map(lambda s: None if s is None else spell(s))

    return run(text)


def chinese_numbers(text: Column, simplified: bool = True) -> Column:
    """Runs of digits replaced by Chinese numerals."""
    return _mapped(text, lambda s: re.sub(r"\d+", lambda m: chinese(m[0], simplified=simplified), s))


# English numerals and groups of three digits.
ONES = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
THOUSANDS = ["", "thousand", "million", "billion", "trillion", "quadrillion", "quintillion"]


def english(n: int) -> str:
    """A whole number in English words, as ``one thousand, two hundred and thirty-four``."""
    if n < 0:
        return "minus " + english(-n)
    if n < 20:
        return ONES[n]
    if n < 100:
        return TENS[n // 10 - 2] + ("-" + ONES[n % 10] if n % 10 else "")
    if n < 1000:
        return f"{ONES[n // 100]} hundred" + (f" and {english(n % 100)}" if n % 100 else "")
    if n >= 1000 ** len(THOUSANDS):  # beyond the names there are, by halves
        low = n % 1000 ** (len(THOUSANDS) - 1)
        return f"{english(n // 1000 ** (len(THOUSANDS) - 1))} {THOUSANDS[-1]}" + (f", {english(low)}" if low else "")
    parts = []
    for g in range(len(THOUSANDS) - 1, -1, -1):
        three = n // 1000**g % 1000
        if three:
            parts.append((f"{english(three)} {THOUSANDS[g]}".strip(), three, g))
    words = [w for w, _, _ in parts]
    if len(parts) > 1 and parts[-1][2] == 0 and parts[-1][1] < 100:
        return ", ".join(words[:-1]) + " and " + words[-1]
    return ", ".join(words)


def spell_number(word: str, lang: str, table: list[tuple[str, str]] = ()) -> str:
    """A word of digits in words: English, Chinese, Japanese and Cantonese by rule, other languages by ``table`` (numeral,
    word; replaced from the last entry on).  Dashes split a word into parts that are spelled by themselves."""
    word = word.replace("—", "-").replace("–", "-")
    parts = word.split("-")
    if len(parts) > 1:
        return " ".join(spell_number(p, lang, table) for p in parts)
    if not word.isascii() or not word.isdigit():
        return word
    if lang == "eng":
        return english(int(word))
    if lang in ("zho", "jpn", "yue"):
        return chinese(word, simplified=lang == "zho")
    for numeral, name in reversed(table):
        word = word.replace(numeral, name).strip()
    return word


def spelled_numbers(text: Column, lang: str, table: list[tuple[str, str]] = ()) -> Column:
    """:func:`spell_number` of each word; words that hold neither digits nor dashes don't leave the JVM's expression."""
    entries = list(table)
    return F.when(text.rlike("[0-9—–-]"), _mapped(text, lambda s: spell_number(s, lang, entries))).otherwise(text)
