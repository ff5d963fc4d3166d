"""Single operators on small inputs."""

import random

import pytest
from pyspark.sql import functions as F

from colloquy.functions import text as T
from colloquy.functions.morphology import mor
from colloquy.functions.numbers import chinese
from colloquy.operators import alignment, cache, comparison, sequence, transfer
from colloquy.plans import catalog
from colloquy.plans.stages import Plan, Stage, expand, infer
from colloquy.schema import FP, PUNCT, REGULAR, RETRACE
from colloquy.sources import chat, tables, textgrid
from colloquy.streaming import live


def test_lexer():
    got = chat.lex("  so <we saw> [/] we saw &-er cats [//] dogs  there   !  ")
    assert got == [("so", REGULAR), ("we", RETRACE), ("saw", RETRACE), ("we", REGULAR), ("saw", REGULAR), ("er", FP), ("cats", RETRACE), ("dogs", REGULAR), ("there", REGULAR), ("!", PUNCT)]
    assert chat.lex("he gonna [: going to] xxx <a <b c> [//] d> [/] go +...") == [("he", 0), ("going", 0), ("to", 0), ("xxx", 4), ("a", 1), ("b", 1), ("c", 1), ("d", 1), ("go", 0), ("+...", 5)]
    with pytest.raises(ValueError):
        chat.lex("<never ends .")


def test_chat_files(spark, tmp_path):
    text = "@UTF8\n@Begin\n@Languages:\teng, fra\n@Participants:\tCHI Child\n@ID:\teng|corpus|CHI|||||Child|||\n@Media:\tx, audio\n*CHI:\thello <you>\n\t[/] you . \x15100_900\x15\n%mor:\tco|hello pro|you-2S .\n%gra:\t1|0|ROOT\n*CHI:\t[- fra] oui <x .\n@End\n"
    (tmp_path / "a.cha").write_text(text, encoding="utf-8")
    rows = chat.scan(spark, f"file://{tmp_path}")
    assert chat.headers(rows).first().langs == ["eng", "fra"]
    first, second = chat.utterances(rows).orderBy("line_no").collect()
    assert (first.tier, first.start_ms, first.end_ms, first.mor) == ("CHI", 100, 900, "co|hello pro|you-2S .")
    assert [(f.text, f.type) for f in first.forms] == [("hello", 0), ("you", 1), ("you", 0), (".", 5)]
    assert second.override_lang == "fra" and second.forms is None and "does not end" in second.error


def test_textgrid(spark):
    rows = [("d", "A", 0, 1500, 'say "hi"'), ("d", "A", 1500, 2000, "x"), ("d", "B", 100, 250, "y")]
    files = textgrid.documents(spark.createDataFrame(rows, "doc_id string, tier string, start_ms bigint, end_ms bigint, text string"))
    assert sorted(map(tuple, textgrid.intervals(files).select("doc_id", "tier", "start_ms", "end_ms", "text").collect())) == sorted(rows)


def test_retrace_definition(spark):
    rng = random.Random(1)
    lines = ["no no no no more no more".split(), *[[rng.choice("abc") for _ in range(rng.randint(1, 14))] for _ in range(30)]]
    rows = [(0, n, "t", k, w, 0) for n, x in enumerate(lines) for k, w in enumerate(x)]
    got = {(r.line_no, r.form_no) for r in sequence.retraces(spark.createDataFrame(rows, "doc_id bigint, line_no bigint, tier string, form_no int, text string, type int"), 10).collect()}
    want = {(n, p) for n, x in enumerate(lines) for m in range(1, len(x)) for b in range(len(x)) if len(x[b + m : b + 2 * m]) == m and x[b : b + m] == x[b + m : b + 2 * m] for p in range(b, b + m)}
    assert got == want


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        old = row[:]
        for j, y in enumerate(b, 1):
            row[j] = old[j - 1] + 1 if x == y else max(row[j - 1], old[j])
    return row[-1]


def test_alignment():
    rng = random.Random(2)
    for n in [0, 1, 2, 5, 20, 60]:
        for m in [0, 1, 3, 40, 70]:
            a, b = [rng.choice("abcd") for _ in range(n)], [rng.choice("abcd") for _ in range(m)]
            items = alignment.align(a, b)
            assert [p for o, p, _ in items if o != "reference"] == list(range(n)) and [r for o, _, r in items if o != "payload"] == list(range(m))
            assert all(a[p] == b[r] for o, p, r in items if o == "match")
            assert sum(o == "match" for o, _, _ in items) == lcs(a, b) == alignment.matches(a, b)
    assert alignment.align(["x"], ["y"]) == [("reference", -1, 0), ("payload", 0, -1)]
    items = alignment.align("the cat sat".split(), "the dog sat down".split())
    assert alignment.word_errors(items, "the dog sat down".split()) == (1, 0, 1)
    assert alignment.diff_lines(items, "the cat sat".split(), "the dog sat down".split()) == "  the\n+ dog\n- cat\n  sat\n+ down"


def test_distance_native(spark):
    rng = random.Random(3)
    rows = [([rng.choice("abc") for _ in range(rng.randint(0, 9))], [rng.choice("abc") for _ in range(rng.randint(0, 9))]) for _ in range(40)]
    df = spark.createDataFrame(rows, "p array<string>, r array<string>")
    for x in df.select("p", "r", alignment.distance(F.col("p"), F.col("r")).alias("d")).collect():
        assert x.d == len(x.p) + len(x.r) - 2 * lcs(x.p, x.r)


def test_words(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(T.conform(F.lit("He's"))) == ["He", "is"] and one(T.conform(F.lit("GONNA"))) == ["going", "to"] and one(T.conform(F.lit("USA"), abbreviations=["USA"])) == ["U", "S", "A"]
    assert one(T.conform(F.lit("ice_cream"))) == ["ice", "cream"] and one(T.conform(F.lit("bathroom"), compounds={"bathroom": "bath room"})) == ["bath", "room"]
    assert one(T.same_word(F.lit("(be)cause"), F.lit("Because"))) and one(T.same_word(F.lit("(be)cause"), F.lit("cause"))) and not one(T.same_word(F.lit("a"), F.lit("b")))
    assert one(mor(F.lit("NOUN"), F.lit("dog"), F.lit("Number=Plur"))) == "noun|dog-Plur" and one(mor(F.lit("PUNCT"), F.lit(","), F.lit("_=_"))) == "cm|cm"
    assert [one(T.annotation_clean(F.lit(w))) for w in ("(be)cause", "wo:rd@l", "&~ab", "a\x151_2\x15")] == ["because", "word", "", "a"]


def test_numbers():
    assert [chinese(n) for n in (0, 10, 12, 20, 101, 110, 1001, 10_000, 10_010, 100_000_001, 12_345)] == ["零", "十", "十二", "二十", "一百零一", "一百一十", "一千零一", "一万", "一万零一十", "一亿零一", "一万二千三百四十五"]
    assert chinese(10, financial=True) == "壹拾" and chinese(-3, simplified=False) == "負三"


def test_comparison():
    main = [(w, "N", k) for k, line in enumerate(["the cat sat down here", "dogs bark"]) for w in line.split()]
    gold = [[(w, "G") for w in line.split()] for line in ["the cat sat there", "dogs bark"]]
    got = comparison.compare_tokens(main, gold)
    assert [(x[2], x[4]) for x in got if x[0] == 1] == [("dogs", "match"), ("bark", "match")]
    assert {x[2]: x[4] for x in got if x[0] == 0}["there"] == "extra_gold" and sum(x[4] == "match" for x in got) == 5
    assert comparison.compare_tokens([], gold)[0][4] == "extra_gold"


def test_comparison_windows():
    # words of a neighbour raise no score: the window ends where its utterance does
    assert comparison.best_segment("x a b c d e".split(), [0, 1, 1, 1, 1, 1], "a b c x q r".split(), 0) == (1, 6)
    # a replaced first word is taken in, an earlier copy of the whole is not
    main = "she sat down".split()
    begin, end = comparison.best_segment(main, [0] * 3, "he sat down".split(), 0)
    assert comparison.snapped(main, [0] * 3, "he sat down".split(), 0, begin, end) == 0 and comparison.snapped(main, [0] * 3, "he sat down".split(), 0, 1, 3) == 0
    twice = "the cat sat the cat sat".split()
    assert comparison.best_segment(twice, [0] * 6, "the cat sat".split(), 0) == (3, 6)
    assert comparison.snapped(twice, [0] * 6, "the cat sat".split(), 0, 3, 6) == 3
    assert comparison.best_segment(["(be)cause"], [0], ["because"], 0) == (0, 0)  # no overlap as bags


def test_comparison_of_what_is_said_twice(spark):
    # the first line is said again inside the third one: the first of two windows as good has it, and no line is passed over
    said = ["yes we can", "who is there", "well yes we can go", "who is there", "yes we can yes we can"]
    main = [(w, "N", k) for k, line in enumerate(said) for w in line.split()]
    got = comparison.compare_tokens(main, [[(w, "N") for w in line.split()] for line in said])
    assert [x[4] for x in got] == ["match"] * len(main) and [x[5] for x in got] == list(range(len(main)))
    # inside an utterance the later one still counts, and a better window is found however far off
    far = [("x", k // 3) for k in range(90)] + [(w, 30) for w in "yes we can yes we can".split()] + [("yes", 31), ("we", 31), ("can", 31)]
    words, owner = [w for w, _ in far], [u for _, u in far]
    assert comparison.best_segment(words, owner, "yes we can".split(), 0, first=True) == (93, 96)
    assert comparison.best_segment(words, owner, "yes we can".split(), 0) == (96, 99)
    # turns that are there twice, or have no number
    turns = [(1, 0, "user", "b a. c"), (1, 0, "user", "a b d"), (1, None, "user", "x y"), (1, 3, "user", "z a b c"), (2, None, "user", "p q"), (None, 0, "user", "r s t")]
    plain = spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string")
    forms = tables.forms(plain.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("line_no"), F.col("role").alias("tier"), "text")).where("type = 0").withColumn("pos", F.lit("X"))
    found = comparison.compare(forms, forms.repartition(7, "text")).groupBy("doc_id").agg(F.count_if(F.col("status") == "match").alias("n"), F.count(F.lit(1)).alias("of"))
    assert sorted(map(tuple, found.collect()), key=str) == [(1, 12, 12), (2, 2, 2), (None, 3, 3)]


def test_comparison_of_transcripts(spark):
    schema = "doc_id bigint, line_no bigint, form_no bigint, tier string, text string, pos string, start_ms bigint, end_ms bigint"
    rows = lambda tier, *lines: [(1, n, k, tier[n], w, "punct" if w in ".?" else "n", 100 * n + k, 100 * n + k + 1) for n, x in enumerate(lines) for k, w in enumerate(x.split())]
    main = spark.createDataFrame(rows("AB", "um he's gonna go .", "the dog barked ."), schema)
    gold = spark.createDataFrame(rows("GG", "he is going to go ?", "a dog barked loudly ."), schema)
    tokens = comparison.compare_transcripts(main.drop("tier", "start_ms", "end_ms"), gold.drop("tier", "start_ms", "end_ms"))
    got = [(r.line_no, r.place, r.text, r.status) for r in tokens.orderBy("line_no", "place", "text").collect()]
    assert got[:6] == [(0, 0.0, "he", "match"), (0, 1.0, "is", "match"), (0, 2.0, "going", "match"), (0, 3.0, "to", "match"), (0, 4.0, "go", "match"), (0, 5.0, "?", "match")]
    assert [(t, s) for n, _, t, s in got if n == 1] == [("a", "extra_gold"), ("the", "extra_main"), ("dog", "match"), ("barked", "match"), ("loudly", "extra_gold"), (".", "match")]
    words = lambda df: df.where("text NOT IN ('.', '?', 'um')").select("doc_id", "line_no", "form_no", "text", F.upper("pos").alias("pos"))
    said = comparison.spoken_lines(comparison.compare(words(main), words(gold)), main, gold).orderBy("line_no").collect()
    assert [(r.line_no, r.tier, [f.text for f in r.forms], r.start_ms, r.end_ms) for r in said][-1] == (1, "B", ["the", "dog", "barked", "."], 100, 103)


def test_transfer(spark):
    forms = spark.createDataFrame([(1, 0, k, w) for k, w in enumerate("hello my dear friend".split())], "doc_id bigint, line_no bigint, form_no int, text string")
    heard = spark.createDataFrame([(1, k, w, k * 0.5, k * 0.5 + 0.4) for k, w in enumerate("Hello dear friends friend".split())], "doc_id bigint, word_no bigint, word string, ts double, end_ts double")
    got = [(r.start_ms, r.end_ms) for r in transfer.timing_transfer(forms, heard).orderBy("form_no").collect()]
    assert got == [(0, 400), (None, None), (500, 900), (1500, 1900)]
    assert transfer.char_transfer(["hello", "you"], [("hel", 0.0, 1.0), ("lo", 1.0, 2.0), ("you", 3.0, 4.0)]) == [(0.0, 2.0), (3.0, 4.0)]
    assert transfer.single_advance([(0, 10), (10, 20), (20, 30)], [(5, "a"), (8, "b"), (25, "c")]) == ["b", "c", "c"]


def test_cache(spark):
    rows = spark.createDataFrame([("k1", 1), ("k2", 2), ("k2", 3), ("k3", 4)], "key string, n int")
    old = spark.createDataFrame([("k1", "t", "1", "2026-01-01", "old"), ("k3", "t", "0", "2026-01-01", "stale"), ("k2", "u", "1", "2026-01-01", "other")], cache.ENTRY)
    done, new = cache.resolve(rows, old, "t", "1", "2026-02-01", lambda x: x.withColumn("data", F.concat(F.lit("new"), "key")))
    assert sorted((r.key, r.n, r.data) for r in done.collect()) == [("k1", 1, "old"), ("k2", 2, "newk2"), ("k2", 3, "newk2"), ("k3", 4, "newk3")]
    assert {(r.key, r.task): r.data for r in new.collect()} == {("k1", "t"): "old", ("k2", "t"): "newk2", ("k2", "u"): "other", ("k3", "t"): "newk3"}


def test_plan(spark):
    seen = []
    stage = lambda t: Stage(t, lambda df: (seen.append(t), df)[1])
    Plan([stage("wer"), stage("retrace"), stage("asr"), stage("disfluency")])(spark.range(1))
    assert seen == ["asr", "disfluency", "retrace", "wer"] and expand(["asr", "fa"]) == ["asr", "utr", "fa", "disfluency", "retrace"]
    for bad in (["asr", "asr"], ["wer", "compare_report"]):
        with pytest.raises(ValueError):
            Plan([stage(t) for t in bad])
    with pytest.raises(ValueError):
        Stage("no such task", lambda df: df)
    import pyarrow as pa

    got = infer(spark.range(3), "id bigint, twice bigint", lambda: lambda b: pa.RecordBatch.from_arrays([b.column(0), pa.array([2 * x for x in b.column(0).to_pylist()])], names=["id", "twice"]))
    assert [r.twice for r in got.orderBy("id").collect()] == [0, 2, 4]


def test_streams(spark, tmp_path):
    spark.createDataFrame([(1, 1, 0, 100), (1, 2, 50, 200), (2, 3, 10, 20)], "doc_id bigint, item_no bigint, start_ms bigint, end_ms bigint").coalesce(1).write.parquet(f"{tmp_path}/in/1")
    spark.createDataFrame([(1, 4, 150, 180)], "doc_id bigint, item_no bigint, start_ms bigint, end_ms bigint").coalesce(1).write.parquet(f"{tmp_path}/in/2")
    stream = spark.readStream.schema("doc_id bigint, item_no bigint, start_ms bigint, end_ms bigint").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    q = live.repaired(stream).writeStream.format("memory").queryName("repaired").outputMode("append").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r.item_no: (r.new_start, r.ok) for r in spark.table("repaired").collect()}
    assert got == {1: (0, True), 2: (100, True), 3: (10, True), 4: (200, False)}


def test_lines_for_models(spark):
    from colloquy.functions import text as T

    cases = ["a, b gumma@c +...", "no mark", "...", "", "+, yes 'm ?", "it'", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "i int, t string")
    line, ending, special = T.tagging_parts(F.col("t"))
    got = [tuple(r) for r in rows.select(line, ending, special).orderBy("i").collect()]
    assert got[:4] == [("a , b xbxxx", "+...", ["gumma@c"]), ("no mark", ".", []), ("...", ".", []), (".", ".", [])]
    assert got[4][:2] == (" yes 'm", "?") and got[5][:2] == ("it", ".") and got[6][0] is None
    said = {r.t: r.w for r in rows.select("t", T.written_line(F.lit(" +... ¿x,y . . . the U S A and"), ["USA"]).alias("w")).collect()}
    assert {*said.values()} == {"x , y +... the USA and"}
    chunks = spark.range(1).select(T.keyword_chunks(F.lit("b㗎喇c㗎d"), ["㗎喇", "㗎"]), T.keyword_chunks(F.lit(""), ["a"])).first()
    assert chunks[0] == ["b㗎喇", "c㗎", "d"] and chunks[1] == []


def test_files(spark):
    from colloquy.operators import files

    names = spark.createDataFrame([(n,) for n in ("a.cs.wav", "a.sv.wav", "b.cs.wav", "c.wav", None)], "name string")
    got = {r.name: (r.partner, r.error) for r in files.paired(names, "cs", "sv").collect()}
    assert got["a.cs.wav"] == ("a.sv.wav", None) and got["b.cs.wav"] == (None, "missing: b.sv.wav") and got["c.wav"][1] and got[None][1]
    lexicon = spark.createDataFrame([("du", ["de", "le"])], "word string, parts array<string>")
    forms = spark.createDataFrame([("Du",), ("x",), (None,)], "text string")
    assert {r.text: r.parts for r in files.expanded(forms, lexicon).collect()} == {"Du": ["de", "le"], "x": ["x"], None: [None]}


def test_distance_of_whole_turns(spark, tmp_path):
    rng = random.Random(40)
    turns = [[rng.choice("abcdef") for _ in range(n)] for n in (60, 41, 130, 1, 75)] + [["x"] * 45, ["x"] * 40 + ["y"] * 5]
    rows = [(1, n, "t", " ".join(t)) for n, t in enumerate(turns)]
    spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").write.parquet(f"file://{tmp_path}/conversations.parquet")
    got = {r.line_no: r.distance for r in catalog.QUERIES["edit_distance"](spark, f"file://{tmp_path}").collect()}
    assert got == {n: alignment._row(b, a, lambda x, y: x == y)[-1] for n, (a, b) in enumerate(zip(turns, turns[1:]), 1)}
    assert got[6] == 10  # only words after the 40th differ


def conversations(spark, path, turns):
    rows = [(1, n, "t", t) for n, t in enumerate(turns)]
    spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").write.parquet(f"file://{path}/conversations.parquet")
    return f"file://{path}"


def test_long_retraces(spark, tmp_path):
    phrase = [f"w{k}" for k in range(14)]
    turns = [phrase + phrase + ["end"], phrase[:11] * 2, ["x", *phrase, "y", *phrase], ["a"], phrase[:5] * 3]
    got = {(r.line_no, r.form_no) for r in catalog.QUERIES["retrace_ngram"](spark, conversations(spark, tmp_path, map(" ".join, turns))).collect()}
    assert got == {(0, k) for k in range(14)} | {(1, k) for k in range(11)} | {(4, k) for k in range(10)}


def test_word_error_rate(spark, tmp_path):
    turns = ["The dog sat down.", "the cat sat!", "He's gonna watch the BBC", "He is going to watch, the b b c"]
    got = {r.line_no: r for r in catalog.QUERIES["wer"](spark, conversations(spark, tmp_path, turns)).collect()}
    assert (got[1].substitutions, got[1].deletions, got[1].insertions, got[1].words, got[1].rate) == (1, 0, 1, 4, 0.5)
    assert (got[3].match, got[3].payload, got[3].reference, got[3].words, got[3].rate) == (9, 0, 0, 5, 0.0)
    assert alignment.same_word("(be)cause", "because") and alignment.same_word("(be)cause", "cause") and not alignment.same_word("a", "b")
    items = alignment.align(["(be)cause", "so"], ["because", "no"], alignment.same_word)
    assert items[0] == ("match", 0, 0) and alignment.word_errors(items, ["because", "no"]) == (1, 0, 0)


def test_many_tiers_and_features(spark):
    text = "".join(f'    item [{k}]:\n        name = "t{k}"\n            xmin = 0\n            xmax = 1.000\n            text = "x"\n' for k in range(1, 10_003))
    assert textgrid.intervals(spark.createDataFrame([("d", text)], "doc_id string, text string")).count() == 10_002
    feats = [f"F{k}" for k in range(120)]
    (item,) = spark.range(1).select(chat.mor_items(F.lit("noun|dog-" + "-".join(feats))).alias("x")).first().x
    assert (item.pos, item.lemma, item.feats) == ("noun", "dog", "-".join(feats))


def test_document_spans(spark, tmp_path):
    rows = [(1, 1, None, None), (1, 2, 5, None), (1, 3, 7, 9), (1, 4, None, None), (2, 1, None, None)]
    got = sequence.document_spans(spark.createDataFrame(rows, "doc_id bigint, item_no bigint, start_ms bigint, end_ms bigint"))
    assert sorted(map(tuple, got.collect())) == [(1, 5, 9), (2, None, None)]
    events = spark.sql("SELECT 4L AS event_id, 9L AS user_id, 'x' AS event_type, TIMESTAMP'2024-01-02 00:00:00' AS ts, 1.0D AS value")
    events.write.parquet(f"file://{tmp_path}/events.parquet")
    assert [tuple(r) for r in catalog.QUERIES["utterance_alignment"](spark, f"file://{tmp_path}").collect()] == [(9, None, None)]


def test_window_search_plainly():
    from collections import Counter

    def plain(main, owner, gold, start):
        want, spans = Counter(gold), {}
        for size in range(max(1, len(gold) - comparison.SLACK), min(len(main) - start, len(gold) + comparison.SLACK) + 1):
            for b in range(start, len(main) - size + 1):
                most = Counter(owner[b : b + size]).most_common(1)[0][0]
                inside = [k for k in range(b, b + size) if owner[k] == most]
                x, y = inside[0], inside[-1] + 1
                spans[x, y] = sum((want & Counter(main[x:y])).values())
        top = max(spans.values(), default=0)
        rank = {(b, e): (alignment.matches(main[b:e], gold), e, b - e) for (b, e), n in spans.items() if n == top}
        return max(rank, key=rank.__getitem__) if top else (start, start)

    rng = random.Random(7)
    for _ in range(300):
        owner = [i for i in range(rng.randint(1, 5)) for _ in range(rng.randint(1, 9))]
        main, gold = [rng.choice("abcdef") for _ in owner], [rng.choice("abcdefg") for _ in range(rng.randint(1, 8))]
        start = rng.randint(0, len(main))
        assert comparison.best_segment(main, owner, gold, start) == plain(main, owner, gold, start)


def test_window_search_no_farther_than_needed():
    rng = random.Random(8)
    for _ in range(300):
        owner = [i for i in range(rng.randint(1, 12)) for _ in range(rng.randint(1, 9))]
        main = [rng.choice("abcd") for _ in owner]
        start = rng.randrange(len(main))
        at = rng.randrange(start, len(main))
        gold = main[at : at + rng.randint(1, 4)] if rng.random() < 0.7 else [rng.choice("abcde") for _ in range(rng.randint(1, 8))]
        assert comparison.best_segment(main, owner, gold, start, first=True) == comparison._searched(main, owner, gold, start, comparison.same_word, True)[:2]


def test_conform_tokens_of_all_lexicons(spark, tmp_path):
    import duckdb

    words = [*T.CONTRACTIONS, *T.FILLERS, "the", "He's", "the's", "I've", "I'd", "I'm", "'s", "this'll's"]
    text = " ".join(w for x in words for w in (x, x.upper(), x.capitalize())) + " a_b c-d"
    table = spark.createDataFrame([(1, 0, "user", text), (1, 1, "user", None), (2, 0, "user", "")], "conv_id bigint, turn bigint, role string, text string")
    table.coalesce(1).write.parquet(f"file://{tmp_path}/conversations.parquet")
    got = catalog.QUERIES["conform_tokens"](spark, f"file://{tmp_path}").select("doc_id", "line_no", "form_no", "word", "part").collect()
    c = duckdb.connect()
    c.execute(f"create view conversations as select * from read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    assert sorted(map(tuple, got)) == sorted(c.execute(catalog.SQL["conform_tokens"]).fetchall())
    # by default the operator has all of them
    full = {**T.CONTRACTIONS, **{w: "um" for w in T.FILLERS}, "i've": "i have", "i'd": "i had", "i'm": "i am"}
    x = spark.createDataFrame([(k,) for k in full], "w string")
    assert {r.w: " ".join(r.x) for r in x.select("w", T.conform(F.col("w")).alias("x")).collect()} == full
