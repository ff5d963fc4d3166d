"""Sentences as tiers, tokens on lines, language-dependent forms, inference contracts: inputs of our own."""

from pyspark.sql import functions as F

from colloquy.functions import forms
from colloquy.operators import sentences


def word(k, text, mor, head, rel):
    return {"id": k, "text": text, "mor": mor, "head": head, "deprel": rel}


def token(first, text, last=None):
    return {"first": first, "last": last or first, "text": text}


def test_tiers():
    words = [word(1, "he", "pron|he", 3, "nsubj"), word(2, "'s", "aux|be", 3, "aux"), word(3, "here", "adv|here", 0, "root"), word(4, "\"", None, 3, "punct"), word(5, "today", "adv|today", 4, "obl:tmod")]
    tokens = [token(1, "he's", 2), token(3, "here"), token(4, '"'), token(5, "today")]
    assert sentences.tiers(words, tokens, "?") == ("pron|he~aux|be adv|here adv|today ?", "1|3|NSUBJ 2|3|AUX 3|0|ROOT 4|3|OBL-TMOD 5|3|PUNCT")
    assert sentences.tiers([word(1, ".", ".", 0, "root")], [token(1, ".")]) == ("", "") and sentences.tiers([], []) == ("", "")


def test_special_forms_and_omissions():
    words = [word(1, "0", None, 2, "dep"), word(2, "is", "aux|be", 3, "cop"), word(3, "xbxxx", "x|x", 0, "root"), word(4, "xbxxx", "x|x", 3, "dep")]
    got = sentences.tiers(words, [token(k, w["text"]) for k, w in enumerate(words, 1)], special=[("gum,ma", "c"), ("foo", "s:x")])
    assert got == ("0aux|be c|gumcmma L2|xxx .", "1|2|COP 2|0|FLAT 3|2|FLAT 4|2|PUNCT")


def test_joined_clitics():
    words = [word(k, t, f"x|{t.strip(chr(39))}", 0 if k == 1 else 1, "root" if k == 1 else "dep") for k, t in enumerate(["jusqu'", "ici", "dit", "-il"], 1)]
    tokens = [token(k, w["text"]) for k, w in enumerate(words, 1)]
    assert sentences.tiers(words, tokens, lang="fr")[0] == "x|jusqu~x|ici x|dit~x|-il ."
    assert sentences.tiers(words, tokens)[0] == "x|jusqu x|ici x|dit~x|-il ."


def test_realigned():
    assert sentences.realigned(["ca", "n't", "stop", "o", "'clock"], "can't stop o'clock") == [("can't", True), ("stop", False), ("o'clock", False)]
    assert sentences.realigned(["le", "i", "va"], "lei va", "it") == sentences.realigned(["le", "i", "va"], "le i va", "it") == [("lei", False), ("va", False)]
    assert sentences.realigned(["d'l'attraper"], "d'l'attraper", "fr") == [("d'", False), ("l'", False), ("attraper", False)]


def test_retokenized():
    assert sentences.retokenized_line("<I> [/] I &-um go gumma@c .", ["I", "go", "."]) == "<I> [/] I &-um go gumma@c ."
    line = sentences.retokenized_line("we can't [*] stop .", ["we", "ca", "n't", "stop", "."])
    assert line == "we ca n't [*] stop ."


def test_sentence_columns(spark):
    rows = [([(1, "hi", "intj|hi", 0, "root")], [(1, 1, "hi")], ".", [], "hi there", ["h", "i", "there"])]
    df = spark.createDataFrame(rows, f"{sentences._SENTENCE}, delimiter string, special array<struct<form:string,code:string>>, text string, pieces array<string>")
    got = sentences.tier_columns(df).first()
    assert (got.mor, got.gra) == ("intj|hi .", "1|0|ROOT 2|1|PUNCT")
    lines = df.select("text", F.col("pieces").alias("tokens"))
    assert [tuple(x) for x in sentences.realigned_tokens(lines).first().realigned] == [("hi", False), ("there", False)]
    assert sentences.retokenized_lines(lines).first().line == "h i there"


def test_forms(spark):
    words = spark.createDataFrame([("go", "Went", "il"), ("go", "goes", "Leur"), ("see", "saw", "dog")], "lemma string, text string, fr string")
    got = forms.irregular(words, spark.createDataFrame([("go", "went"), ("go", "gone"), ("see", "SAW")], "lemma string, form string")).collect()
    assert {r.text: r.irregular for r in got} == {"Went": True, "goes": False, "saw": True}
    assert {r[0] for r in words.select(forms.french_case(F.col("fr"))).collect()} == {"Nom", "Acc", ""}
    ja = spark.createDataFrame([("verb", "x", "飲ん"), ("part", "x", "な"), ("adj", "x", "速い"), ("noun", "x", "速い"), ("noun", "猫", "猫")], "pos string, lemma string, text string")
    pos, lemma = forms.japanese(F.col("pos"), F.col("lemma"), F.col("text"))
    assert [tuple(r) for r in ja.select(pos, lemma).collect()] == [("verb", "飲む"), ("aux", "な"), ("adj", "速い"), ("noun", "x"), ("noun", "猫")]
    nouns = forms.listed_nouns(spark.createDataFrame([(" Cheval",), ("chat",)], "text string"), spark.createDataFrame([("cheval",)], "word string"))
    assert {r.text: r.listed for r in nouns.collect()} == {" Cheval": True, "chat": False}
