"""Whole documents, recognised speech, transfers, verbs, lexicons and sound on small inputs of our own."""

import hashlib
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.functions import numbers
from colloquy.operators import asr, cache, transfer
from colloquy.plans import verbs
from colloquy.schema import FP, PUNCT, REGULAR, RETRACE
from colloquy.sources import audio, chat, documents, lexicons

FILE = "\n".join(
    [
        "@UTF8", "@PID:\t11312/x-1", "@Begin", "@Languages:\teng, fra", "@Participants:\tMOT Mother, CHI Child", "@Options:\tbullets",
        "@ID:\teng|home|MOT||female||x|Mother|||", "@ID:\teng|home|CHI|2;06.|||y|Child|z|w|", "@Birth of CHI:\t01-JAN-2001", "@Media:\ttape, video, unlinked", "@Comment:\tin the kitchen",
        "*MOT:\twhere's the , red ball ? \x151000_2500\x15",
        "%mor:\tadv|where~aux|be-Fin-S3 det|the-Def cm|cm adj|red noun|ball ?", "%gra:\t1|2|ADVMOD 2|5|AUX 3|5|DET 4|5|PUNCT 5|0|ROOT 6|5|NSUBJ 7|5|PUNCT",
        "%com:\tpoints at it",
        "*CHI:\t<my my> [/] my &-um ball", "\tgone (1.2) . ", "%wor:\tmy my my um \x152600_2700\x15 ball \x152700_2900\x15 gone .", "%xtra:\tma balle est partie",
        "@Situation:\tlater", "*MOT:\t[- fra] oui +...", "%xsrep:\toui +non -si .", "%xsmor:\tintj +adv -adv PUNCT", "*CHI:\t.", "*CHI:\t<broken .", "*DAD:\thello .", "%mor:\tco|hello .", "@End", "",
    ]
)


@pytest.fixture(scope="module")
def rows(spark):
    other = "@UTF8\n@Begin\n@Languages:\teng\n@ID:\teng|c|A|||||P|||\n*A:\thi .\n%mor:\tx|wrong .\n%umor:\tintj|hi .\n%ugra:\t1|0|ROOT 2|1|PUNCT\nnonsense\n@End\n"
    return chat.lines(spark.createDataFrame([("a", FILE), ("b", other), ("c", "@UTF8\n*A:\thi .\n")], "doc_id string, text string")).persist()


def test_headers(rows):
    a, b, c = documents.documents(rows).orderBy("doc_id").collect()
    assert (a.pid, a.langs, a.options, a.error) == ("11312/x-1", ["eng", "fra"], "bullets", None)
    assert (a.media.name, a.media.type, a.media.state) == ("tape", "video", "unlinked")
    assert [(p.id, p.name, p.birthday, p.additional) for p in a.participants] == [("MOT", "Mother", "", ["female", "", "x", "", ""]), ("CHI", "Child", "2;06.", ["", "", "y", "z", "w"])]
    assert [x.id for x in a.customs] == ["Birth of CHI", "Comment", "Situation"]
    assert "unknown line" in b.error and c.error == "there is no @Begin"


def test_utterances(rows):
    got = [r for r in documents.utterances(rows).orderBy("doc_id", "line_no").collect() if r.doc_id == "a"]
    first, second, third, mark, broken, dad = got
    assert [(f.text, f.type) for f in first.forms] == [("where's", 0), ("the", 0), (",", 5), ("red", 0), ("ball", 0), ("?", 5)]
    assert [[m.pos for m in f.morphology] for f in first.forms] == [["adv", "aux"], ["det"], ["cm"], ["adj"], ["noun"], ["PUNCT"]]
    assert [[(d.id, d.dep_id) for d in f.dependency] for f in first.forms][0] == [(1, 2), (2, 5)] and (first.start_ms, first.end_ms, first.delim) == (1000, 2500, "?")
    assert first.forms[0].morphology[1].feats == "Fin-S3" and [(c.id, c.content) for c in first.customs] == [("com", "points at it")]
    assert [(f.text, f.type, f.start_ms) for f in second.forms] == [("my", 1, None), ("my", 1, None), ("my", 0, None), ("um", 3, 2600), ("ball", 0, 2700), ("gone", 0, None), (".", 5, None)]
    assert second.translation == "ma balle est partie" and third.override_lang == "fra" and third.delim == "+..."
    assert [(c.text, c.pos, c.status) for c in third.comparison] == [("oui", "intj", "match"), ("non", "adv", "extra_main"), ("si", "adv", "extra_gold"), (".", "PUNCT", "match")]
    assert mark.error is None and "does not end" in broken.error and "undeclared" in dad.error


def test_special_morphology(rows):
    plain, special = ([r for r in documents.utterances(rows, s).collect() if r.doc_id == "b"] for s in (False, True))
    assert plain[0].forms[0].morphology[0].lemma == "wrong" and special[0].forms[0].morphology[0].lemma == "hi"
    assert special[0].forms[0].dependency[0].dep_type == "ROOT" and [c.id for c in special[0].customs] == ["mor"]


@pytest.mark.parametrize(
    ("line", "tiers", "message"),
    [("a b .", {"mor": "x|a ."}, "3 words, 2 items"), ("a .", {"mor": "x|a .", "gra": "1|0|ROOT"}, "2 parts of %mor, 1 edges"), ("a b .", {"wor": "a \x151_2\x15"}, "words of %wor"), ("a .", {"mor": "a ."}, "no part of speech")],
)
def test_tiers_that_do_not_fit(line, tiers, message):
    with pytest.raises(ValueError, match=message):
        documents.read_line(line, **tiers)


def test_files_and_back(spark, rows, tmp_path):
    docs, lines = documents.documents(rows).where("doc_id = 'a'"), documents.utterances(rows).where("doc_id = 'a' AND error IS NULL")
    text = documents.files(docs, lines).first().text
    assert text.startswith("@UTF8\n@PID:\t11312/x-1\n@Begin\n@Languages:\teng, fra\n@Participants:\tMOT Mother, CHI Child\n@Options:\tbullets\n@ID:\teng|home|MOT||female||x|Mother|||\n")
    assert "@ID:\teng|home|CHI|2;06.|||y|Child|z|w|\n@Birth of CHI:\t01-JAN-2001\n@Media:\ttape, video, unlinked\n@Comment:\tin the kitchen\n*MOT:" in text
    assert "%xtra:\tma balle est partie\n@Situation:\tlater\n*MOT:\t[- fra] oui +..." in text and text.endswith("@End\n") and "\n*CHI:\t.\n" not in text
    assert "%mor:\tadv|where~aux|be-Fin-S3 det|the-Def cm|cm adj|red noun|ball ?\n%gra:\t1|2|ADVMOD 2|5|AUX" in text and "%wor:\tmy my my um \x152600_2700\x15 ball \x152700_2900\x15 gone ." in text
    assert "%xsrep:\toui +non -si .\n%xsmor:\tintj +adv -adv ." in text
    again = documents.utterances(chat.lines(spark.createDataFrame([("a", text)], "doc_id string, text string")))
    key = lambda r: (r.tier, r.forms, r.start_ms, r.translation, r.comparison, r.error)
    assert [key(r) for r in again.orderBy("line_no").collect()] == [key(r) for r in lines.where("text <> '.'").orderBy("line_no").collect()]
    assert "%umor" in documents.files(docs, lines, special_mor=True).first().text and "%mor" not in documents.files(docs, lines, write_mor=False).first().text
    documents.write(documents.files(docs, lines), f"file://{tmp_path}/out")
    (file,) = [f for f in (tmp_path / "out").rglob("*.txt")]
    assert file.read_text(encoding="utf-8") == text and "doc_id=a" in str(file)


def test_detokenized_lines_read_back():
    rng = random.Random(4)
    for _ in range(300):
        n = rng.randint(1, 5)
        forms = []
        for _ in range(n):
            kind = rng.choice([REGULAR, REGULAR, FP, RETRACE])
            word = rng.choice("abcde")
            if kind == RETRACE:
                group = [rng.choice("abcde") for _ in range(rng.randint(1, 3))]
                forms += [(w, RETRACE) for w in group] + [(w, REGULAR) for w in group]
            else:
                forms.append((word, kind))
        forms.append((".", PUNCT))
        assert chat.lex(documents.detokenize(forms)) == forms
    assert documents.detokenize([("no", 1), ("no", 1), ("no", 0)]) == "no [/] no [/] no"
    assert documents.detokenize([("a", 1), ("b", 1), ("a", 0), ("b", 0)]) == "<a b> [/] a b"


def test_strip_and_transcript(spark):
    forms = [("um", FP), ("I", RETRACE), ("I", REGULAR), ("go", REGULAR), (".", PUNCT)]
    schema = f"doc_id bigint, line_no bigint, tier string, text string, start_ms bigint, end_ms bigint, forms array<{documents.FORM}>"
    one = [(t, k, None, None, None, None) for t, k in forms]
    df = spark.createDataFrame([(1, 0, "A", None, 5, 9, one), (1, 1, "B", "as it stands .", None, None, one), (1, 2, "C", None, None, None, None)], schema)
    both = df.select(*[documents.stripped(F.col("forms"), r, p) for r, p in ((False, False), (True, True))]).first()
    assert tuple(both) == ("I go .", "um I I go .")
    assert [r.line for r in documents.transcript(df, include_tiers=True).orderBy("line_no").collect()] == ["A: &-um I [/] I go . \x155_9\x15", "B: as it stands ."]


def test_media_and_directory(spark, tmp_path):
    for name, text in {"a.cha": "@Options:\tdummy\n", "b.cha": "x", "b.wav": "x", "b.mp4": "x", "c.txt": "x"}.items():
        (tmp_path / name).write_text(text)
    got = {r.path.split("/")[-1]: r.reason for r in documents.directory(spark, f"file://{tmp_path}", ["cha", "mp4", "wav"]).collect()}
    assert got == {"a.cha": "dummy", "b.cha": None, "b.wav": None, "b.mp4": "sound is there", "c.txt": "extension"}
    docs = spark.createDataFrame([("/x/a.cha", ("tape",)), ("/x/b.cha", ("none",)), ("/x/c.cha", None), ("/x/d.cha", ("none",))], "doc_id string, media struct<name:string>")
    files = spark.createDataFrame([("/x/tape.mp3",), ("/x/tape.wav",), ("/x/b.wav",), ("/x/c.wav",), ("/y/d.wav",)], "path string")
    assert {r.doc_id[3]: r.url for r in documents.linked_media(docs, files).collect()} == {"a": "/x/tape.mp3", "b": "/x/b.wav", "c": None, "d": None}


# --- recognised speech -----------------------------------------------------------------------------------------------


def heard(spark, turns):
    rows = [(1, t, k, 0, v, None if s is None else float(s), None if e is None else float(e)) for t, turn in enumerate(turns) for k, (v, s, e) in enumerate(turn)]
    return spark.createDataFrame(rows, "doc_id bigint, turn_no bigint, elem_no bigint, speaker int, value string, ts double, end_ts double")


def test_recognised_speech(spark):
    turn = [("air", 0, 1), ("port", 1, 2), ("<pause>", 2, 3), ("is 21", 3, 5), ("-st", 5, 6), ("big.", 6, 7), (" ", 7, 8), ("so", 8, 9), ("¿no؟", 9, 10), ("bye", None, None), (",", None, None)]
    pairs = spark.createDataFrame([("air", "port"), ("port", "air")], "left string, right string")
    got = asr.process(heard(spark, [turn]), compounds=pairs).orderBy("utt", "form_no").collect()
    assert [(r.utt, r.text, r.start_ms, r.end_ms) for r in got] == [(0, "airport", 0, 2000), (0, "is", 3000, 4500), (0, "twenty-one st", 4500, 6000), (0, "big", 6000, 7000), (0, ".", None, None), (1, "so", 8000, 9000), (1, "no", 9000, 10000), (1, "?", None, None), (2, "bye", None, None), (2, ".", None, None)]
    assert {r.tier for r in got} == {"PAR0"} and [r.type for r in got if r.text in ".?"] == [PUNCT] * 3


def test_greedy_compounds(spark):
    words = "a a a b a a".split()
    pairs = spark.createDataFrame([("a", "a"), ("a", "b")], "left string, right string")
    got = asr.merged(heard(spark, [[(w, k, k + 1) for k, w in enumerate(words)]]), pairs).orderBy("elem_no").collect()
    assert [(r.value, r.ts, r.end_ts) for r in got] == [("aa", 0, 2), ("ab", 2, 4), ("aa", 4, 6)]


def test_chunks_and_splitter(spark):
    turn = [(f"w{k}", k, k + 1) for k in range(650)]
    rows = asr.chunked(asr.words(heard(spark, [turn])))
    assert [r["count"] for r in rows.groupBy("chunk").count().orderBy("chunk").collect()] == [300, 300, 50]
    split = lambda: lambda t: [" ".join(t.split()[:2]) + "?", " ".join(t.split()[2:])]
    got = asr.split_by_engine(asr.chunked(asr.words(heard(spark, [[("Hello,", 0, 1), ("THERE.", 1, 2), ("!", 2, 3), ("Friend", 3, 4)]]))), split).orderBy("utt", "form_no").collect()
    assert [(r.utt, r.text, r.start_ms) for r in got] == [(0, "hello", 0), (0, "there", 1000), (0, "?", None), (1, "friend", 3000), (1, ".", None)]


def test_turns(spark):
    words = spark.createDataFrame([(1, 0, "Hi,", 0, 10), (1, 1, "you…", 20, 30), (1, 2, "…", 30, 40), (1, 3, "x", 40, 40), (1, 4, "yes.", 55, 60), (1, 5, "ok", 70, 80)], "doc_id bigint, word_no bigint, word string, start_ms bigint, end_ms bigint")
    segments = spark.createDataFrame([(1, "A", 5), (1, "B", 50), (1, "A", 65)], "doc_id bigint, speaker string, start_ms bigint")
    got = asr.swept(words, segments).orderBy("turn_no", "elem_no").collect()
    assert [(r.turn_no, r.speaker, r.value, r.start_ms) for r in got] == [(0, "A", "Hi", 0), (0, "A", ",", None), (0, "A", "you", 20), (1, "B", "yes", 55), (1, "B", ".", None), (2, "A", "ok", 70)]
    w = asr.in_windows(words)
    assert [tuple(r) for r in asr.from_windows(w).select(words.columns).orderBy("word_no").collect()] == [tuple(r) for r in words.orderBy("word_no").collect()]
    segs = spark.createDataFrame([(1, 4, [("a", 0.0, 1.0), ("b", None, None)])], "doc_id bigint, seg_no bigint, words array<struct<word:string,ts:double,end_ts:double>>")
    assert [asr.segment_turns(segs, t).count() for t in (False, True)] == [2, 1]


def test_number_words():
    spelled = {0: "zero", 21: "twenty-one", 100: "one hundred", 110: "one hundred and ten", 1001: "one thousand and one", 1234: "one thousand, two hundred and thirty-four", 1_000_100: "one million, one hundred", 2_000_003: "two million and three"}
    assert {n: numbers.english(n) for n in spelled} == spelled and numbers.english(-5) == "minus five"
    assert numbers.spell_number("20—3", "eng") == "twenty three" and numbers.spell_number("3rd", "eng") == "3rd" and numbers.spell_number("12", "zho") == "十二" and numbers.spell_number("10000", "yue") == "一萬"
    assert numbers.spell_number("12", "xxx", [("1", "un"), ("2", "deux"), ("12", "douze")]) == "douze"
    assert numbers.chinese("3.05") == "三点零五" and numbers.chinese("1" * 17) == "一" * 17 and numbers.chinese(2200, pair=True) == "两千两百" and numbers.chinese(101, zero="〇") == "一百〇一" and numbers.chinese(20_002, pair=True) == "两万零二"


# --- transfers -------------------------------------------------------------------------------------------------------


def test_forced_times():
    words, pieces = ["hello", "you", "there"], [("hel", 0.0, 0.4), ("lo", 0.4, 0.9), ("you", 1.0, 1.5)]
    assert transfer.forced_times(words, pieces, 100) == [(100, 500), (1100, 1600), None]
    assert transfer.forced_times(words, pieces, 100, "points") == [(100, 100), (1100, 1100), None]
    assert transfer.forced_times(words, pieces, 100, "pauses") == [(100, 500), (1100, 1600), None]


def test_forced_alignment(spark):
    forms = spark.createDataFrame([(1, 0, 100, 0, k, w) for k, w in enumerate(["hello", "you"])] + [(1, 1, 900, 1, 0, "alone")], "doc_id bigint, group bigint, base_ms bigint, line_no bigint, form_no bigint, text string")
    pieces = spark.createDataFrame([(1, 0, 1, "you", 1.0, 1.5), (1, 0, 0, "hello", 0.0, 0.5)], "doc_id bigint, group bigint, piece_no bigint, piece string, ts double, end_ts double")
    got = {(r.line_no, r.form_no): (r.start_ms, r.end_ms) for r in transfer.forced_alignment(forms, pieces).collect()}
    assert got == {(0, 0): (100, 600), (0, 1): (1100, 1600), (1, 0): (None, None)}
    with pytest.raises(ValueError):
        transfer.forced_alignment(forms, pieces, "other")


def test_segmented_words(spark):
    forms = [("ab", 0, 0, 10), ("c", 0, 10, 20), ("de", 4, None, None), (".", 5, None, None)]
    new = transfer.resegmented([dict(zip(("text", "type", "start_ms", "end_ms"), f)) for f in forms[:2] + forms[3:]], ["a", "bc"])
    assert [tuple(x.values()) for x in new] == [("a", 0, 0, 10), ("bc", 0, 0, 20), (".", 5, None, None)]
    df = spark.createDataFrame([(1, forms), (2, [])], "doc_id bigint, forms array<struct<text:string,type:int,start_ms:bigint,end_ms:bigint>>")
    got = {r.doc_id: [f.text for f in r.forms] for r in transfer.segmented_words(df, lambda: lambda t: [t[:1], t[1:]]).collect()}
    assert got == {1: ["a", "bc", "de", "."], 2: []}


def test_chains(spark):
    forms = spark.createDataFrame([(1, 0, 0, "she"), (1, 0, 1, "um"), (1, 1, 0, "left")], "doc_id bigint, line_no bigint, form_no bigint, text string")
    words = spark.createDataFrame([(1, 0, "she", [(True, True, 3)]), (1, 1, "left", [])], "doc_id bigint, word_no bigint, word string, chains array<struct<start:boolean,end:boolean,chain:int>>")
    assert [None if r.coreference is None else [c.chain for c in r.coreference] for r in transfer.chains_transfer(forms, words).orderBy("line_no", "form_no").collect()] == [[3], None, []]


def test_phrases(spark):
    assert transfer.distinct_phrases(["b c", "a b c d e", "b"]) == [["a", "b", "c", "d", "e"]] and transfer.distinct_phrases(["x", "p q"]) == [["p", "q"]]
    words = "i went home and she slept well".split()
    groups = transfer.phrase_groups(words, ["i went home", "she slept well", " ".join(words)])
    assert sorted(sum(groups, [])) == list(range(7)) and all(len(g) >= 3 for g in groups)
    assert transfer.phrase_groups(["a", "b"], []) == [[0, 1]]
    df = spark.createDataFrame([(1, 0, words, ["i went home", "she slept well"])], "doc_id bigint, line_no bigint, words array<string>, phrases array<string>")
    assert [" ".join(r.words) for r in transfer.phrase_split(df).orderBy("utt").collect()] == ["i went home", "and she slept well"]


# --- cache, verbs, lexicons, sound -----------------------------------------------------------------------------------


def test_cache_entries(spark):
    one = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = spark.range(1).select(cache.split_key(F.lit("t"), F.lit("eng")), cache.alignment_key(F.lit("t"), F.lit("a"), F.lit(True))).first()
    assert tuple(got) == (one("t|eng"), one("a|t|1"))
    lex = lambda rows: cache.parts_digest(spark.createDataFrame(rows, "word string, parts array<string>"))
    assert lex([("au", ["à", "le"]), ("du", ["de", "le"])]) == lex([("du", ["de", "le"]), ("au", ["à", "le"])]) != lex([("du", ["de"])]) and lex([]) == ""
    forms = [("a", 0, None, None, [("a", "x", "")], [(1, 0, "ROOT")]), (".", 5, None, None, None, None)]
    lines = spark.createDataFrame([(forms, "a . \x151_2\x15")], f"forms array<{documents.FORM}>, text string")
    entry = lines.select(cache.tags_data(F.col("forms"), F.col("text"), F.lit(True)).alias("data")).first().data
    assert json.loads(entry)["retokenized_text"] == "a ."
    bare = [("a", 0, None, None, None, None), (".", 5, None, None, None, None)]
    got = cache.tagged(spark.createDataFrame([(bare, "A . \x153_4\x15", entry), (bare[:1], "A", entry)], f"forms array<{documents.FORM}>, text string, data string")).collect()
    assert got[0].text == "a . \x153_4\x15" and got[0].forms[0].morphology[0].pos == "x" and got[0].forms[0].dependency[0].dep_type == "ROOT"
    assert got[1].text == "A" and got[1].forms[0].morphology is None
    pieces = [([("a", 0, 1, 2)], "a", 1, 2), ([("b", 0, None, None)], None, None, None)]
    df = spark.createDataFrame([(1, 0, "T", pieces)], "doc_id bigint, line_no bigint, tier string, p array<struct<forms:array<struct<text:string,type:int,start_ms:bigint,end_ms:bigint>>,text:string,start_ms:bigint,end_ms:bigint>>")
    back = cache.split_lines(df.withColumn("data", cache.split_data(F.col("p")))).orderBy("piece").collect()
    assert [([tuple(f) for f in r.forms], r.text, r.start_ms, r.end_ms) for r in back] == [([("a", 0, 1, 2)], "a", 1, 2), ([("b", 0, None, None)], None, None, None)]
    times = spark.createDataFrame([([(1, 2), None],)], "t array<struct<start_ms:bigint,end_ms:bigint>>").select(cache.timings(cache.timings_data(F.col("t"))).alias("t")).first().t
    assert [None if t is None else tuple(t) for t in times] == [(1, 2), None]
    empty, freed = cache.cleared(spark.createDataFrame([("k", "t", "1", "d", "12345")], cache.ENTRY))
    assert empty.count() == 0 and freed == 5


def test_model_runs_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def compute(df):
        def run(batches):
            for b in batches:
                seen.add(b.num_rows)
                yield b

        return df.mapInArrow(run, df.schema).withColumn("data", F.col("key"))

    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "key string, n int")
    done, new = cache.resolve(rows, spark.createDataFrame([], cache.ENTRY), "t", "1", "d", compute)
    assert done.count() == 3 and new.count() == 2 and seen.value == 2


def test_verbs(tmp_path, spark):
    assert verbs.packages("asr", "eng") == [("asr", "whisper_oai"), ("disfluency", "replacement"), ("retracing", "ngram"), ("utterance", "stanza_utt")]
    assert [t for t, _ in verbs.packages("asr", "deu")] == ["asr", "disfluency", "retracing"] and [t for t, _ in verbs.packages("asr", "eng", boundary_models=frozenset({"eng"}))] == ["asr", "disfluency", "retracing"]
    assert [t for t, _ in verbs.packages("fa", "yue")] == ["fa", "utr", "segment"]
    assert verbs.packages("asr,disfluency,retracing", "deu", config={"asr": {"engine": "rev"}}, retracing="own") == [("asr", "rev"), ("disfluency", "replacement"), ("retracing", "own")]
    with pytest.raises(ValueError):
        verbs.packages("nonsense", "eng")
    registry = verbs.Registry()
    seen = []
    for name in {*verbs.PACKAGES.values()}:
        registry.add(name)(lambda lang, name=name: lambda df: (seen.append(name), df)[1])
    registry.run("transcribe_s", spark.range(1), "eng")
    assert seen == ["whisper_oai", "stanza_utt", "pyannote", "replacement", "ngram"]
    for bad in (lambda: registry.run("no", spark.range(1), "eng"), lambda: verbs.Registry().plan("fa", "eng")):
        with pytest.raises(ValueError):
            bad()
    (tmp_path / "s.ini").write_text("[asr]\nengine = rev\n")
    assert verbs.settings(str(tmp_path / "s.ini"), "m1") == {"asr": {"engine": "rev", "engine.model": "m1"}}
    with pytest.raises(FileNotFoundError):
        verbs.settings(str(tmp_path / "none.ini"))
    assert verbs.Options(workers=3, memory_guard_mb=500).session()["spark.executor.memory"] == "500m"


def test_lexicons(spark, tmp_path):
    (tmp_path / "l.csv").write_text('du,de,le\n"a,b",x\nau,à,le\nau,a\n')
    assert {r.word: r.parts for r in lexicons.lexicon(spark, f"file://{tmp_path}/l.csv").collect()} == {"du": ["de", "le"], "a,b": ["x"], "au": ["a"]}
    (tmp_path / "w.txt").write_text("# list\num &-um um\nshort one\nuh  &-uh uh more\n")
    assert sorted(tuple(r) for r in lexicons.wordlist(spark, f"file://{tmp_path}/w.txt").collect()) == [("uh", "&-uh", "uh"), ("um", "&-um", "um")]
    assert lexicons.wordlist(spark, f"file://{tmp_path}/none").count() == 0


def test_json_documents(spark):
    good = {"langs": [], "content": [{"tier": {"id": "A"}, "text": "hi .", "time": [1, 2], "content": [{"text": "hi", "type": 0}]}]}
    docs = lexicons.json_documents(spark.createDataFrame([(1, json.dumps(good)), (2, "{nonsense")], "doc_id bigint, text string"))
    assert {r.doc_id: (r.langs, r.error) for r in docs.collect()} == {1: (["eng"], None), 2: (["eng"], "no document")}
    (line,) = lexicons.json_lines(docs).collect()
    assert (line.tier, line.text, line.start_ms, line.end_ms, line.forms[0].text) == ("A", "hi .", 1, 2, "hi")


def test_training_texts(spark, rows):
    files = spark.createDataFrame([("a", FILE)], "doc_id string, text string")
    lines = lexicons.training_lines(files)
    assert [r.text for r in lines.orderBy("line_no").collect()] == ["where's the , red ball ?", "my ball gone .", "oui +..."]
    many = spark.range(40).select(F.lit("d").alias("doc_id"), F.col("id").alias("line_no"), F.concat(F.lit("w"), F.col("id").cast("string")).alias("text"))
    windows = lexicons.training_windows(many, 8).orderBy("window").collect()
    assert [r.window for r in windows] == [0, 1, 2, 3, 4] and all(r.text.split()[0] == f"w{8 * r.window}" and 1 <= len(r.text.split()) <= 8 for r in windows)
    parts = lexicons.training_split(spark.range(2000).select(F.col("id").alias("doc_id")), 0.1).groupBy("part").count().collect()
    assert 120 < {r.part: r["count"] for r in parts}["val"] < 280


def test_tables_as_files(spark, tmp_path):
    long = spark.createDataFrame([("a", "wer", 0.5), ("a", "NOUN:matches", 2.0), ("b", "wer", 1.0)], "doc_id string, name string, value double")
    table = lexicons.metrics_table(long, "doc_id", "name", "value")
    assert table.columns == ["doc_id", "NOUN:matches", "wer"] and sorted(tuple(r) for r in table.collect()) == [("a", "2.0", "0.5"), ("b", "", "1.0")]
    lexicons.write_csv(table, f"file://{tmp_path}/csv")
    assert any("doc_id,NOUN:matches,wer" in f.read_text() for f in (tmp_path / "csv").glob("*.csv"))
    lexicons.write_texts(spark.createDataFrame([("d", "0.25", "  a")], "doc_id string, w string, x string"), f"file://{tmp_path}/t", wer_txt=F.col("w"), diff=F.col("x"), asr_cha=F.lit(None))
    assert sorted((f.parent.parent.name, f.read_text()) for f in (tmp_path / "t").rglob("*.txt") if f.is_file()) == [("extension=.diff", "  a\n"), ("extension=.wer.txt", "0.25\n")]
    m = spark.createDataFrame([(1, {"b": 2.0, "a": 1.0})], "doc_id bigint, m map<string,double>")
    assert [tuple(r) for r in lexicons.features_long(m, "m").collect()] == [(1, "a", 1.0), (1, "b", 2.0)]


def test_sound(spark, tmp_path):
    x = np.stack([np.linspace(-0.5, 0.5, 16_000), np.zeros(16_000)], axis=1)
    (tmp_path / "a.wav").write_bytes(audio.encode_wav(16_000, x))
    (tmp_path / "b.wav").write_bytes(b"no sound at all")
    rate, back = audio.decode_wav((tmp_path / "a.wav").read_bytes())
    assert rate == 16_000 and np.abs(back - x).max() < 1e-4
    files = audio.scan(spark, f"file://{tmp_path}")
    got = {r.path.split("/")[-1]: r.i for r in files.select("path", audio.info(F.col("content")).alias("i")).collect()}
    assert (got["a.wav"].rate, got["a.wav"].channels, got["a.wav"].frames, got["a.wav"].error) == (16_000, 2, 16_000, None) and got["b.wav"].error
    path = [r.path for r in files.collect() if r.path.endswith("a.wav")][0]
    spans = spark.createDataFrame([(path, 0, 0, 500), (path, 1, 500, 1000), (path, 2, 5000, 6000), (path, 3, 0, 500)], "path string, group bigint, start_ms bigint, end_ms bigint")
    digests = {r.group: (r.frames, r.digest) for r in audio.span_digests(files, spans).collect()}
    assert digests[0] == digests[3] != digests[1] and digests[0][0] == 8000 and digests[2][0] == 0


def test_textgrid_styles(spark, tmp_path):
    from colloquy.sources import textgrid

    rows = [("d", "A", 0, 0, 100, "hi"), ("d", "A", 1, None, None, "you"), ("d", "A", 2, 300, 400, "there"), ("d", "A", 3, None, None, "."), ("d", "B", 0, 150, 250, "yes"), ("d", "B", 1, None, None, "lost")]
    items = textgrid.filled(spark.createDataFrame(rows, "doc_id string, tier string, item_no bigint, start_ms bigint, end_ms bigint, text string"))
    got = [tuple(r) for r in items.select("tier", "text", "start_ms", "end_ms").orderBy("tier", "item_no").collect()]
    assert got == [("A", "hi", 0, 100), ("A", "you", 100, 300), ("A", "there", 300, 400), ("B", "yes", 150, 250)]
    (tmp_path / "x.TextGrid").write_text(textgrid.documents(items).first().text, encoding="utf-8")
    turns = textgrid.scan(spark, f"file://{tmp_path}", "word").orderBy("turn").collect()
    assert [(r.tier, r.start_ms, r.end_ms, [w.text for w in r.words]) for r in turns] == [("A", 0, 300, ["hi", "you"]), ("B", 150, 250, ["yes"]), ("A", 300, 400, ["there"])]
    assert textgrid.scan(spark, f"file://{tmp_path}").count() == 4
    with pytest.raises(ValueError):
        textgrid.scan(spark, "x", "other")
