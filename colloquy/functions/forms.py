"""Language-dependent corrections of tags: irregular forms by lexicon, French case, Japanese verb forms by rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from colloquy.operators.files import small

# French pronouns in the nominative and in the accusative.
FRENCH_NOMINATIVE = ["qui", "je", "tu", "il", "elle", "ils", "elles", "moi", "toi", "lui", "eux"]
FRENCH_ACCUSATIVE = ["que", "quoi", "me", "te", "le", "la", "les", "leur"]

# Japanese forms as (where the value is looked for, value, whole or part of it, part of speech or any, new
# part of speech, new lemma), the first that fits counts.
JAPANESE = [
    ("text", "ちゃ", "in", "", "sconj", "ば"), ("text", "なきゃ", "in", "", "sconj", "なきゃ"), ("text", "じゃ", "in", "", "sconj", "ちゃ"), ("text", "れる", "in", "", "aux", "られる"),
    ("text", "じゃう", "in", "", "aux", "ちゃう"), ("text", "よう", "in", "", "aux", "おう"), ("text", "だら", "in", "", "aux", "たら"), ("lemma", "だ", "in", "", "aux", "た"),
    ("lemma", "無い", "in", "", "aux", "ない"), ("lemma", "せる", "in", "", "aux", "させる"), ("text", "撮る", "in", "", "verb", "撮る"), ("text", "貼る", "in", "", "verb", "貼る"),
    ("text", "混ぜ", "in", "", "verb", "混ぜる"), ("text", "釣る", "in", "", "verb", "釣る"), ("text", "速い", "in", "adj", "adj", "速い"), ("text", "治ま", "in", "", "verb", "治まる"),
    ("text", "刺す", "in", "", "verb", "刺す"), ("text", "降り", "in", "", "verb", "降りる"), ("text", "降", "in", "", "verb", "降る"), ("text", "載せ", "in", "", "verb", "載せる"),
    ("text", "帰", "in", "", "verb", "帰る"), ("text", "はい", "in", "", "intj", "はい"), ("text", "うん", "in", "", "intj", "うん"), ("text", "おっ", "in", "", "intj", "おっ"),
    ("text", "ほら", "in", "", "intj", "ほら"), ("text", "ただいま", "in", "", "intj", "ただいま"), ("text", "あたし", "in", "", "pron", "あたし"), ("text", "舐め", "in", "", "verb", "舐める"),
    ("text", "下さい", "in", "", "noun", "下さい"), ("text", "掻く", "is", "", "part", "かい"), ("text", "遣", "in", "noun", "verb", "遣る"), ("text", "死", "in", "", "verb", "死ぬ"),
    ("text", "立", "in", "", "verb", "立つ"), ("text", "引", "in", "", "verb", "引く"), ("text", "出", "in", "", "verb", "出す"), ("text", "飲", "in", "", "verb", "飲む"),
    ("text", "呼", "in", "", "verb", "呼ぶ"), ("text", "脱", "in", "", "verb", "脱ぐ"), ("text", "な", "is", "part", "aux", "な"), ("text", "だり", "is", "", "aux", "たり"),
    ("text", "たり", "is", "", "aux", "たり"), ("text", "たら", "is", "", "sconj", "たら"), ("text", "たっ", "is", "", "sconj", "たっ"), ("lemma", "ちゃ", "is", "", "sconj", "ちゃ"),
    ("lemma", "ない", "is", "", "aux", "ない"), ("text", "で", "is", "", "sconj", "で"),
]


def french_case(word: Column) -> Column:
    """Nom, Acc or nothing for a French pronoun."""
    clean = F.trim(F.btrim(F.lower(word), F.lit("'")))
    return F.when(clean.isin(FRENCH_NOMINATIVE), "Nom").when(clean.isin(FRENCH_ACCUSATIVE), "Acc").otherwise("")


def japanese(pos: Column, lemma: Column, text: Column) -> tuple[Column, Column]:
    """(part of speech, lemma) after the first rule of :data:`JAPANESE` that fits; as they were if none does."""
    new_pos, new_lemma = pos, lemma
    for where, value, how, kind, p, form in reversed(JAPANESE):
        column = text if where == "text" else lemma
        test = column.contains(value) if how == "in" else column == value
        test = test & (pos == kind) if kind else test
        new_pos, new_lemma = F.when(test, p).otherwise(new_pos), F.when(test, form).otherwise(new_lemma)
    return new_pos, new_lemma


def irregular(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """``words`` (lemma, text) with ``irregular``: whether the form is listed for the lemma (lemma, form), case aside."""
    listed = small(lexicon.select(F.lower("lemma").alias("l"), F.lower("form").alias("f")).distinct()).withColumn("listed", F.lit(True))
    found = words.join(listed, (F.lower("lemma") == F.col("l")) & (F.lower("text") == F.col("f")), "left")
    return found.withColumn("irregular", F.coalesce("listed", F.lit(False))).drop("l", "f", "listed")


def listed_nouns(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """``words`` (text) with ``listed``: whether the word is in a list (word), case and blanks aside: French nouns with a
    plural that is heard, for example."""
    words_ = small(lexicon.select(F.lower(F.trim("word")).alias("w")).distinct()).withColumn("there", F.lit(True))
    return words.join(words_, F.lower(F.trim("text")) == F.col("w"), "left").withColumn("listed", F.coalesce("there", F.lit(False))).drop("w", "there")
