"""Universal Dependencies features as %mor suffixes: ordered features per part of speech, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from colloquy.functions.text import features

# For each part of speech its features in order, with the value where one is absent.
ORDER = {
    "PRON": [("PronType", "Int"), ("Case", "")],
    "DET": [("Gender", ""), ("Definite", "Def"), ("PronType", "")],
    "ADJ": [("Degree", ""), ("Case", "")],
    "NOUN": [("Gender", ""), ("Number", ""), ("Case", ""), ("PronType", "")],
    "PROPN": [("Gender", ""), ("Number", ""), ("Case", ""), ("PronType", "")],
    "VERB": [("VerbForm", "Inf"), ("Aspect", ""), ("Mood", ""), ("Tense", ""), ("Polarity", ""), ("Polite", ""), ("HebBinyan", ""), ("HebExistential", "")],
}
ORDER["AUX"] = ORDER["VERB"]
#: Values that are the unmarked case and are not written.
UNMARKED = {("ADJ", "Degree"): "Pos", ("NOUN", "Number"): "Sing", ("PROPN", "Number"): "Sing", ("NOUN", "Gender"): "Com", ("PROPN", "Gender"): "Com"}


def _person(m: Column, number: str, person: str) -> Column:
    p = F.coalesce(F.try_element_at(m, F.lit("Person")), F.lit(person))
    return F.concat(F.substring(F.coalesce(F.try_element_at(m, F.lit("Number")), F.lit(number)), 1, 1), F.when(p == "0", "4").otherwise(p))


def mor(pos: Column, lemma: Column, feats: Column) -> Column:
    """``pos|lemma-Feature-...``; punctuation as it is written in transcripts; null where a sign has no place there."""
    m = features(feats)
    lemma = F.regexp_replace(F.regexp_replace(lemma, r"[$.<>|_]", ""), "-", "–")
    suffix = F.lit("")
    for p, order in ORDER.items():
        parts = []
        for name, default in order:
            v = F.coalesce(F.try_element_at(m, F.lit(name)), F.lit(default))
            parts.append(F.when(v == UNMARKED[p, name], "").otherwise(v) if (p, name) in UNMARKED else v)
        if p in ("PRON", "ADJ"):
            parts.append(_person(m, "S", "1"))
        elif p in ("VERB", "AUX"):
            parts.append(F.when(F.try_element_at(m, F.lit("Person")).isNotNull(), _person(m, "Sing", "1")).otherwise(""))
        joined = F.array_join(F.transform(F.filter(F.array(*parts), lambda x: x != ""), lambda x: F.concat(F.lit("-"), F.replace(x, F.lit(","), F.lit("")))), "")
        suffix = F.when(pos == p, joined).otherwise(suffix)
    sign = F.when(lemma == ",", "cm|cm").when(lemma.isin("‡", "„"), "end|end").when(lemma.rlike(r"^[\p{L}\p{N}]"), F.concat(F.lit("x|"), lemma))
    plain = F.concat(F.lower(pos), F.lit("|"), lemma, suffix)
    return F.when(pos.isin("PUNCT", "SYM"), sign).otherwise(plain)
