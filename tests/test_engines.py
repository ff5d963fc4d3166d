"""Contracts around models, with models of a line or two."""

import json

import pyarrow as pa

from colloquy.operators import cache
from colloquy.plans import engines
from colloquy.sources import documents


def model(f, *names):
    """A loader whose model makes a row or more of each row."""

    def load():
        def run(batch):
            rows = [y for x in batch.to_pylist() for y in f(x)]
            return pa.RecordBatch.from_pydict({n: [r[k] for r in rows] for k, n in enumerate(names)}) if rows else pa.RecordBatch.from_pydict({n: [] for n in names})

        return run

    return load


ELEMENTS = ("doc_id", "turn_no", "elem_no", "speaker", "value", "ts", "end_ts")


def hear(x):
    return [(x["doc_id"], 0, k, 0, w, float(k), k + 0.5) for k, w in enumerate(x["content"].split())]


def test_recognition_and_times(spark):
    files = spark.createDataFrame([(1, "Hello you . yes"), (2, "never asked")], "doc_id bigint, content string")
    said = engines.recognised(files.where("doc_id = 1"), model(hear, *ELEMENTS)).orderBy("utt", "form_no").collect()
    assert [(r.utt, r.text, r.start_ms) for r in said] == [(0, "Hello", 0), (0, "you", 1000), (0, ".", None), (1, "yes", 3000), (1, ".", None)]
    lines = spark.createDataFrame([(1, None), (2, 5), (2, None)], "doc_id bigint, start_ms bigint")
    forms = spark.createDataFrame([(1, 0, 0, "hello"), (1, 0, 1, "(yo)u"), (2, 0, 0, "never")], "doc_id bigint, line_no bigint, form_no bigint, text string")
    got = engines.recovered_times(lines, forms, files, model(hear, *ELEMENTS)).orderBy("doc_id", "form_no").collect()
    assert [(r.text, r.start_ms) for r in got] == [("hello", 0), ("(yo)u", 1000), ("never", None)]


def test_alignment_by_groups(spark):
    lines = spark.createDataFrame([(1, 0, 1000, 4000), (1, 1, 4000, 9000), (1, 2, 30_000, 33_000), (1, 3, None, None)], "doc_id bigint, item_no bigint, start_ms bigint, end_ms bigint")
    forms = spark.createDataFrame([(1, n, k, w, 5 if w == "." else 0) for n, t in enumerate(["ab cd .", "ef", "gh", "zz"]) for k, w in enumerate(t.split())], "doc_id bigint, line_no bigint, form_no bigint, text string, type int")
    sounds = spark.createDataFrame([(1, 0, "d0"), (1, 1, "d1")], "doc_id bigint, group bigint, digest string")
    calls = spark.sparkContext.accumulator(0)

    def say(x):
        calls.add(1)
        return [(x["doc_id"], x["group"], k, w, k * 1.0, k + 0.5) for k, w in enumerate(x["text"].split())]

    load = model(say, "doc_id", "group", "piece_no", "piece", "ts", "end_ts")
    empty = spark.createDataFrame([], cache.ENTRY)
    got, new = engines.aligned(lines, forms, sounds, empty, load, version="1", now="d")
    want = {(0, 0): (1000, 2000), (0, 1): (2000, 2500), (0, 2): (None, None), (1, 0): (None, None), (2, 0): (30_000, 30_500), (3, 0): (None, None)}
    have = {(r.line_no, r.form_no): (r.start_ms, r.end_ms) for r in got.collect()}
    assert have == want  # what is heard of line 1 lies before it
    entries = spark.createDataFrame(new.collect(), cache.ENTRY)
    assert entries.count() == 2 and json.loads(entries.where("data LIKE '%[0,%'").first().data)["timings"][0] == [0, 500]
    before = calls.value
    again, _ = engines.aligned(lines, forms, sounds, entries, load, version="1", now="e")
    assert {(r.line_no, r.form_no): (r.start_ms, r.end_ms) for r in again.collect()} == want and calls.value == before


def test_tagging(spark):
    schema = f"doc_id bigint, line_no bigint, tier string, text string, forms array<{documents.FORM}>"
    form = lambda *ws: [(w, 5 if w == "." else 0, None, None, None, None) for w in ws]
    lines = spark.createDataFrame([(1, 0, "A", "go on .", form("go", "on", ".")), (1, 1, "A", "[- fra] oui .", form("oui", ".")), (1, 2, "A", "go on .", form("go", "on", "."))], schema)
    seen = spark.sparkContext.accumulator(0)

    def tag(x):
        seen.add(1)
        words = [*x["line"].split(), x["ending"]]
        return [(x["key"], json.dumps({"morphology": [[{"lemma": w, "pos": "x", "feats": ""}] for w in words], "dependency": [None for _ in words]}))]

    got, new = engines.tagged(lines, spark.createDataFrame([], cache.ENTRY), model(tag, "key", "data"), lang="eng", version="1", now="d")
    rows = got.orderBy("line_no").collect()
    assert [[f.morphology[0].lemma if f.morphology else None for f in r.forms] for r in rows] == [["go", "on", "."], [None, None], ["go", "on", "."]]
    assert new.count() == 1 and seen.value == 1


def test_splitting(spark):
    schema = "doc_id bigint, line_no bigint, tier string, forms array<struct<text:string,type:int,start_ms:bigint,end_ms:bigint>>"
    lines = spark.createDataFrame([(1, 0, "A", [(w, 0, None, None) for w in "a b c d".split()])], schema)

    def split(x):
        ws = x["text"].split()
        return [(x["key"], json.dumps({"utterances": [{"content": [{"text": w, "type": 0} for w in part]} for part in (ws[:2], ws[2:])]}))]

    got, new = engines.split_lines(lines, spark.createDataFrame([], cache.ENTRY), model(split, "key", "data"), lang="eng", version="1", now="d")
    assert [[f.text for f in r.forms] for r in got.orderBy("piece").collect()] == [["a", "b"], ["c", "d"]] and new.count() == 1


def test_speakers(spark):
    lines = spark.createDataFrame([("SPEAKER f 1 0.0 1.0 <NA> <NA> s1 <NA> <NA>",), ("SPEAKER f 1 1.0 1.5 <NA> <NA> s2 <NA> <NA>",), (";; comment",)], "line string").selectExpr("1L AS doc_id", "monotonically_increasing_id() AS line_no", "line")
    segments = engines.rttm(lines.coalesce(1)).orderBy("start_ms").collect()
    assert [(r.speaker, r.start_ms, r.end_ms) for r in segments] == [("s1", 0, 1000), ("s2", 1000, 2500)]
    files = spark.createDataFrame([(1, "x")], "doc_id bigint, content string")
    load = model(lambda x: [(x["doc_id"], k, s, b, e) for k, (s, b, e) in enumerate([("s1", 0, 1000), ("s2", 1000, 2500)])], "doc_id", "item_no", "speaker", "start_ms", "end_ms")
    items = spark.createDataFrame([(1, 0, "A", 500), (1, 1, "A", 1200), (1, 2, "A", 3000)], "doc_id bigint, item_no bigint, tier string, end_ms bigint")
    near = {r.item_no: r.speaker for r in engines.diarized(items, files, load).collect()}
    step = {r.item_no: r.speaker for r in engines.diarized(items, files, load, advance=True).collect()}
    assert near == {0: "A", 1: "s1", 2: "s2"} and step == {0: "s1", 1: "s2", 2: "s2"}


def test_other_engines(spark):
    lines = spark.createDataFrame([(1, 0, "你 好.", None), (1, 1, "x", "there")], "doc_id bigint, line_no bigint, text string, translation string")
    got = engines.translated(lines, model(lambda x: [(x["doc_id"], x["line_no"], "<" + x["text"] + ">。")], "doc_id", "line_no", "text"), "zho").orderBy("line_no").collect()
    assert [r.translation for r in got] == ["<你好 .> .", "there"]
    forms = spark.createDataFrame([(1, 0, 0, "she")], "doc_id bigint, line_no bigint, form_no bigint, text string")
    load = model(lambda x: [(x["doc_id"], 0, "she", [{"start": True, "end": True, "chain": 1}])], "doc_id", "word_no", "word", "chains")
    assert engines.corefered(forms, ["eng"], load).first().coreference[0].chain == 1 and engines.corefered(forms, ["fra"], load).first().coreference is None
    one = spark.createDataFrame([(1, [("ab", 0, None, None)])], "doc_id bigint, forms array<struct<text:string,type:int,start_ms:bigint,end_ms:bigint>>")
    assert engines.segmented(one, lambda: lambda t: [*t], "eng").first().forms[0].text == "ab" and len(engines.segmented(one, lambda: lambda t: [*t], "yue").first().forms) == 2
    files = spark.createDataFrame([(1, "xx")], "doc_id bigint, content string")
    maps = lambda: lambda b: pa.RecordBatch.from_arrays([b.column(0), pa.array([[("n", 2.0), ("a", 1.0)]] * b.num_rows, pa.map_(pa.string(), pa.float64()))], names=["doc_id", "features"])
    assert [tuple(r) for r in engines.features(files, maps).collect()] == [(1, "a", 1.0), (1, "n", 2.0)]
    sound = spark.createDataFrame([("a.cs.wav", "s"), ("a.sv.wav", "v"), ("b.cs.wav", "s")], "name string, content string")
    quality = {r.name: (r.avqi, r.error) for r in engines.voice_quality(sound, model(lambda x: [(x["name"], *[0.0] * 6)], "name", "cpps", "hnr", "shim", "shdb", "slope", "tilt")).collect()}
    assert abs(quality["a.cs.wav"][0] - 2.8902 * 4.152) < 1e-9 and quality["b.cs.wav"] == (None, "missing: b.sv.wav")
