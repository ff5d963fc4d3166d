"""Column expressions on words, lines and numbers; all of them stay inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from colloquy.schema import CORRECTION, ENDING_PUNCT

# Characters that annotations use, which cleaning removes.
ANNOTATION_CHARS = "()[]<>“”,!?.+&:^$\"∬-≠↑↓⇗↗→↘⇘∞≋≡∙⌈⌉⌊⌋∆∇*°◉▁▔☺♋Ϋ∲§∾↻Ἡ„‡ạʰāʔʕˈˌ‹›〔~〕;"

# Fillers, and words that stand for several words or another one.
FILLERS = ["um", "uhm", "em", "mhm", "uhhm", "eh", "uh", "hm"]
CLITICS = [("'s", "is"), ("'ve", "have"), ("'d", "had"), ("'m", "am")]
CONTRACTIONS = {
    "ok": "okay", "gimme": "give me", "hafta": "have to", "havta": "have to", "dunno": "don't know", "wanna": "want to", "mba": "m b a", "tli": "t l i", "bbc": "b b c", "ii": "i i",
    "alright": "all right", "sorta": "sort of", "alrightie": "all right", "mm": "hm", "ai": "a i", "this'll": "this will", "gotta": "got to", "hadta": "had to", "kinda": "kind of",
    "ed": "education", "til": "until", "gonna": "going to", "shoulda": "should have", "sposta": "supposed to", "farmhouse": "farm house", "aa": "a a", "hmm": "hm",
}


def _re(chars: str) -> str:
    return "[" + "".join("\\" + c if c in "[]\\^-&" else c for c in chars) + "]"


def bullet(text: Column) -> tuple[Column, Column]:
    """Start and end in ms of the first time bullet, null without one."""
    return tuple(F.nullif(F.regexp_extract(text, "\x15(\\d+)_(\\d+)\x15", k), F.lit("")).cast("bigint") for k in (1, 2))


def rebulleted(text: Column, start: Column, end: Column) -> Column:
    """A line with another time bullet: in place of its own, at its end if it has none; without times it loses its own."""
    old = "\x15\\d+_\\d+\x15"
    new = F.concat(F.lit("\x15"), start.cast("string"), F.lit("_"), end.cast("string"), F.lit("\x15"))
    there = F.when(text.contains("\x15"), F.regexp_replace(text, F.lit(old), new)).otherwise(F.concat(text, F.lit(" "), new))
    return F.trim(F.when(start.isNotNull() & end.isNotNull(), there).otherwise(F.regexp_replace(text, old, "")))


def delimiter(tokens: Column) -> Column:
    """The last of an array of tokens if it ends utterances, else a full stop."""
    last = F.try_element_at(tokens, F.lit(-1))
    return F.when(last.isin(ENDING_PUNCT), last).otherwise(".")


def zero_form(text: Column, kind: Column) -> tuple[Column, Column]:
    """(text, type) of a form: one that begins with 0 is a correction, without its 0."""
    zero = text.startswith("0") & (F.length(text) > 1)
    return F.when(zero, F.substring(text, F.lit(2), F.length(text))).otherwise(text), F.when(zero, CORRECTION).otherwise(kind)


def sentences(text: Column) -> Column:
    """Pieces that end in a full stop, a question or an exclamation mark; the rest is the last piece."""
    return F.regexp_extract_all(text, F.lit("([^.!?]+[.!?]|[^.!?]+$)"), F.lit(1))


# Three letters for two-letter codes of languages, and the other way round where the short form differs.
LONG = {"en": "eng", "fr": "fra", "de": "deu", "es": "spa", "it": "ita", "pt": "por", "nl": "nld", "ja": "jpn", "zh": "zho", "ko": "kor", "ru": "rus", "tr": "tur", "ar": "ara", "he": "heb", "hi": "hin", "pl": "pol", "da": "dan", "sv": "swe", "el": "ell", "hu": "hun", "id": "ind", "vi": "vie", "ca": "cat", "hr": "hrv"}
TAGGER = {"yue": "zh-hant", "zho": "zh-hans"}


def long_language(code: Column) -> Column:
    """The three letters of a language's two-letter code; ``und`` where there are none."""
    return F.coalesce(F.create_map(*[F.lit(x) for kv in LONG.items() for x in kv])[code], F.lit("und"))


def tagger_language(code: Column) -> Column:
    """What taggers call a language of three letters: its two letters, Chinese by script; null if unknown."""
    names = {v: k for k, v in LONG.items()} | TAGGER
    return F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[code]


def mended_mor(text: Column) -> Column:
    """A %mor line in which the clitic of a progressive verb is the auxiliary: ``~part|s verb|X-Ger-S`` becomes
    ``~aux|is verb|X-Part-Pres-S``."""
    return F.regexp_replace(text, r"~part\|s verb\|(\w+)-Ger-S", r"~aux|is verb|$1-Part-Pres-S")


def annotation_clean(text: Column, special: bool = False) -> Column:
    """A word without annotation marks.  Marks go before ``@x`` codes, as single characters; ``//`` goes as a pair."""
    text = F.regexp_replace(F.replace(text, F.lit("[/]"), F.lit("")), "\x15\\d+_\\d+\x15", "")
    if not special:
        text = F.regexp_replace(text, r"&~[\p{L}\p{N}_]+", "")
    text = F.regexp_replace(F.regexp_replace(text, _re(ANNOTATION_CHARS), ""), "//", "")
    return F.regexp_replace(text, "@[^abcefpoqsw]", "")


def language_override(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"^\[- (\w+)\]", 1), F.lit(""))


def conform(
    word: Column, names: list[str] = (), compounds: dict[str, str] | None = None, abbreviations: list[str] = (), clitics: list[tuple[str, str]] = CLITICS, contractions: dict[str, str] = CONTRACTIONS
) -> Column:
    """One word as the words it is compared as: the first rule that fits wins.

    Names, compounds (joined -> parts with a space) and case-sensitive abbreviations are given by the caller, who may have
    clitics and contractions of their own, too.
    """
    low = F.lower(F.trim(word))
    rules = F.when(F.lit(False), F.array(F.lit("")))
    if compounds:
        rules = rules.when(low.isin(list(compounds)), F.split(F.create_map(*[F.lit(x) for kv in compounds.items() for x in kv])[low], " "))
    if abbreviations:
        rules = rules.when(F.trim(word).isin(list(abbreviations)), F.filter(F.split(F.trim(word), ""), lambda x: x != ""))
    head = F.substring_index(word, "'", 1)
    for mark, full in clitics:
        rules = rules.when(low.contains(mark), F.array(head, F.lit(full)))
    rules = rules.when(low.isin(FILLERS), F.array(F.lit("um"))).when(low.contains("-"), F.transform(F.split(low, "-"), lambda x: F.trim(x)))
    if names:
        rules = rules.when(low.isin(list(names)), F.array(F.lit("name")))
    if contractions:
        rules = rules.when(low.isin(list(contractions)), F.split(F.create_map(*[F.lit(x) for kv in contractions.items() for x in kv])[low], " "))
    return rules.when(low.contains("_"), F.split(low, "_")).otherwise(F.array(low))


def same_word(x: Column, y: Column) -> Column:
    """The fuzzy word predicate of transcript comparison: equal, equal without parentheses, or equal without what stands
    between them; case aside."""
    x, y = F.lower(x), F.lower(y)
    bare = lambda c: F.regexp_replace(c, "[()]", "")
    cut = lambda c: F.regexp_replace(c, r"\(.*\)", "")
    return (x == y) | (bare(x) == bare(y)) | (cut(x) == y) | (x == cut(y))


def cache_key(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *parts), 256)


def number_words(text: Column, words: list[tuple[str, str]]) -> Column:
    """Numerals replaced by the words of an ordered table, the last entry first."""
    return reduce(lambda c, kv: F.replace(c, F.lit(kv[0]), F.lit(kv[1])), reversed(words), text)


def boundary_label(word: Column) -> Column:
    """1 capital, 2 full stop, 3 question, 4 exclamation, 5 comma, 0 none; the sign at the end decides first."""
    last = F.substring(word, -1, 1)
    return F.when(last == ".", 2).when(last == "?", 3).when(last == "!", 4).when(last == ",", 5).when(word.rlike(r"^\p{Lu}"), 1).otherwise(0)


def human_bytes(n: Column) -> Column:
    """Size in the largest unit of 1024 that keeps it at 1 or more, as floor of tenths and the unit."""
    out = F.concat(n.cast("bigint").cast("string"), F.lit(" B"))
    for power, unit in ((1, "KB"), (2, "MB"), (3, "GB")):
        tenths = F.floor(n * 10 / 1024**power).cast("bigint")
        out = F.when(n >= 1024**power, F.concat((F.floor(tenths / 10)).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit(f" {unit}"))).otherwise(out)
    return out


def features(feats: Column) -> Column:
    """``A=B|C=D`` as a map."""
    return F.str_to_map(feats, F.lit(r"\|"), F.lit("="))


def avqi(cpps: Column, hnr: Column, shim: Column, shdb: Column, slope: Column, tilt: Column) -> Column:
    """Acoustic voice quality index; the coefficients are fixed values."""
    return 2.8902 * (4.152 - 0.177 * cpps - 0.006 * hnr - 0.037 * shim + 0.941 * shdb + 0.01 * slope + 0.093 * tilt)


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def tagging_parts(text: Column) -> tuple[Column, Column, Column]:
    """A line made ready for a tagger: (line, end mark, special forms).

    The last piece is the end mark if it holds no letter, digit or underscore; a line without one ends in a full stop.
    Linkers go, special forms (``word@code``) become one placeholder each and come back as a list, commas stand apart.
    """
    last = F.element_at(F.split(text, " "), -1)
    marked = ~last.rlike(r"[\p{L}\p{N}_]")
    cut = _stripped(F.substring(text, F.lit(1), F.char_length(text) - F.char_length(last)))
    alone = marked & (cut == "")
    line = F.when(marked & ~alone, cut).otherwise(text)
    line = F.regexp_replace(line, r'\+,|\+\+|\+"', "")
    special = F.regexp_extract_all(line, F.lit(r"([\p{L}\p{N}_]+@[\p{L}\p{N}_:]+)"), F.lit(1))
    line = F.regexp_replace(line, r"[\p{L}\p{N}_]+@[\p{L}\p{N}_:]+", "xbxxx")
    line = F.regexp_replace(F.when(line == "", ".").otherwise(line), "'$", "")
    for old, new in ((",", " ,"), ("+ ,", "+,"), ("  ", " ")):
        line = F.replace(line, F.lit(old), F.lit(new))
    return line, F.when(marked & ~alone, last).otherwise("."), special


def written_line(text: Column, abbreviations: list[str] = ()) -> Column:
    """A main line as it is written: trailing-off signs, commas apart, single spaces; spelled-out abbreviations merged."""
    for old, new in ((". . .", "+..."), (" ' ", "'"), ("¿", ""), ("¡", "")):
        text = F.replace(text, F.lit(old), F.lit(new))
    text = _stripped(F.regexp_replace(_stripped(text), r"^\+\.\.\.", ""))
    text = F.replace(_stripped(F.regexp_replace(F.replace(text, F.lit(","), F.lit(" , ")), " +", " ")), F.lit("+ ,"), F.lit("+,"))
    for a in abbreviations:
        apart = f" {' '.join(a)} "
        for old in (apart, apart.lower()):
            text = F.replace(text, F.lit(old), F.lit(f" {a} "))
    return text


def keyword_chunks(text: Column, marks: list[str]) -> Column:
    """Pieces that each end behind the earliest mark (of marks at one place the first in the list); the rest is the last
    piece.  An empty text has no pieces."""
    any_mark = "|".join(f"\\Q{m}\\E" for m in marks)
    return F.regexp_extract_all(text, F.lit(f"(?s)(.*?(?:{any_mark})|.+$)"), F.lit(1))


def translation_input(text: Column, lang: Column) -> Column:
    """What a translator gets: Chinese without spaces and with its own full stop."""
    chinese = F.replace(F.replace(text, F.lit(" "), F.lit("")), F.lit("."), F.lit("。"))
    return F.when(lang.isin("yue", "zho"), chinese).otherwise(text)


def translation_output(text: Column, marks: list[str]) -> Column:
    """A translation as a tier: plain signs, and a space in front of each punctuation mark, mark after mark."""
    for old, new in (("。", "."), ("’", "'"), ("\t", " "), ("​", "")):
        text = F.replace(text, F.lit(old), F.lit(new))
    return reduce(lambda c, m: F.replace(c, F.lit(m), F.lit(" " + m)), marks, text)
