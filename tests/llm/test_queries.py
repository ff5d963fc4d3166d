"""The queries over the smallest tables, against SQL where there is some; and the pipeline against brute force."""

import os
import re

import duckdb
import pytest

import corpus_pipeline
from colloquy.llm import queries
from tests.llm.test_operators import brute_components

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(D):
        path = f"{D}/{f}" + ("/*.parquet" if os.path.isdir(f"{D}/{f}") else "")
        c.execute(f"create view {f[:-8]} as select * from read_parquet('{path}')")
    return c


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_against_sql(spark, duck, name):
    got, want = queries.QUERIES[name](spark, D).toPandas(), duck.execute(queries.SQL[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    plain = lambda df: sorted(repr([None if x is None or x != x else str(x) for x in r]) for r in df[columns].astype(object).itertuples(index=False))
    assert plain(got) == plain(want)


def test_pipeline(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()} if "text" in docs.columns else {}
        docs = stage(spark, docs, D)
        kept[name] = (before, {r.doc_id for r in docs.select("doc_id").collect()})
        docs = docs.cache()
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    before, after = kept["exact dedup"]
    last = {}
    for i in sorted(before):
        last[low(before[i])] = i
    assert after == {*last.values()}
    before, after = kept["n-gram Jaccard join"]
    assert after == {c for _, c in brute_components(list(before.items())).values()}
    before, after = kept["BPE encoding and decoding"]
    assert after == {*before} and "ids" in docs.columns
    quality_in, quality_out = kept["quality classifier"]
    assert 0.7 * len(quality_in) < len(quality_out) < len(quality_in)


ODD = "doc_id bigint, text string, score string, dedup_key string, near_key int, leak_key string, quality_score double, row bigint, root string, `a.b` string"


def odd_docs(spark, rows):
    """Rows whose further columns have the names of the stages' own."""
    return spark.createDataFrame([(i, t, "s", f"k{n % 3}", n, "l", 0.5, n, "r", "dot") for n, (i, t) in enumerate(rows)], ODD).repartition(3)


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """A folder with labels and benchmark of our own."""
    top = f"file://{tmp_path_factory.mktemp('tables')}"
    spark.createDataFrame([(i, i % 2, 0) for i in range(40)] + [(None, 1, 0), (3, None, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    spark.createDataFrame([(1, "one two three four five six seven eight nine ten"), (None, "lonely"), (3, None)], "item_id bigint, text string").write.parquet(f"{top}/benchmark.parquet")
    return top


def kept(spark, stage, rows, top):
    docs = odd_docs(spark, rows)
    got = stage(spark, docs, top)
    assert got.columns == docs.columns and got.schema.simpleString() == docs.schema.simpleString()
    assert all((r.score, r.quality_score, r.root, r["a.b"]) == ("s", 0.5, "r", "dot") for r in got.collect())
    return sorted(repr((r.doc_id, r.text)) for r in got.collect())


CASES = [(1, "aaa"), (1, "aaa"), (1, "bbb"), (5, "ccc"), (7, "ccc"), (5, "ddd"), (None, "n"), (None, "n"), (None, "CCC"), (8, None), (2, ""), (None, "only me"), (9, "AaA"), (9, "aAa")]


def test_exact_stage(spark, small):
    got = kept(spark, corpus_pipeline.without_copies, CASES, small)
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    texts: dict = {}
    for i, t in CASES:
        texts.setdefault(low(t), []).append((-1 if i is None else i, t))
    assert len(got) == len(texts)
    for own in texts.values():
        top = max(i for i, _ in own)
        assert sum(repr((None if top < 0 else top, t)) in got for t in {t for i, t in own if i == top}) == 1
    assert kept(spark, corpus_pipeline.without_copies, [(3, "x")] * 5, small) == [repr((3, "x"))]


def test_near_stage(spark, small):
    words = [f"q{k}" for k in range(40)]
    near, other = " ".join(words[:39] + ["x"]), " ".join(words[:20])
    rows = [(5, " ".join(words)), (5, near), (5, other), (None, near.upper()), (4, other), (4, other), (None, "only"), (None, "ONLY"), (None, None), (6, None), (6, "")]
    got = kept(spark, corpus_pipeline.without_near_copies, rows, small)
    # of the texts of all words one stays: that of doc 5 with the smaller hash; of the half ones doc 4, both rows
    assert sum(x in got for x in (repr((5, " ".join(words))), repr((5, near)))) == 1 and repr((None, near.upper())) not in got
    assert got.count(repr((4, other))) == 2 and repr((5, other)) not in got
    assert sum(x in got for x in (repr((None, "only")), repr((None, "ONLY")))) == 1
    assert [x for x in got if "None, None" in x or "6," in x] == [repr((6, "")), repr((6, None)), repr((None, None))] and len(got) == 7


def test_benchmark_stage(spark, small):
    passage = "One two three four five six, seven eight nine ten"
    rows = [(1, passage), (1, "clean"), (None, passage + " and more"), (None, "clean"), (2, "so lonely here"), (2, None), (3, "one two three"), (3, "one two three")]
    assert kept(spark, corpus_pipeline.without_benchmark, rows, small) == sorted(map(repr, [(1, "clean"), (None, "clean"), (2, None), (3, "one two three"), (3, "one two three")]))


def test_quality_stage(spark, small):
    rows = [(i, "plain words of text " * 3 if i % 2 else "!!! ### JUNK ???" * 4) for i in range(40)] + [(None, "plain words of text " * 3), (None, "!!! ### JUNK ???" * 4), (77, None), (1, "plain words of text " * 3)]
    got = kept(spark, corpus_pipeline.good_quality, rows, small)
    assert repr((None, "plain words of text " * 3)) in got and repr((None, "!!! ### JUNK ???" * 4)) not in got
    assert got.count(repr((1, "plain words of text " * 3))) == 2 and not any("JUNK" in x for x in got)


def test_token_stage(spark, small):
    rows = [(1, "a b"), (1, "a b"), (None, "c"), (2, None), (3, "")]
    got = corpus_pipeline.tokenized(spark, odd_docs(spark, rows), small).collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in got) == sorted((str(i), len((t or "").split())) for i, t in rows)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_empty_stage(spark, small, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    assert stage(spark, odd_docs(spark, []), small).count() == 0
