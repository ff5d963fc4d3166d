"""Operators of the training-data pipeline against brute force, with nulls, empty and long texts, ties and repeats."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from colloquy.llm import bpe, chat, decontam, exact, jaccard, lm, quality, shared, substring, tokencounts, urls
from colloquy.llm.graph import components

DOC = "doc_id bigint, text string, score string, items string"


def docs_of(spark, rows):
    """Documents with further columns whose names clash with those of results."""
    return spark.createDataFrame([(i, t, "s", "x") for i, t in rows], DOC).repartition(3)


def words_of(rng, n, vocabulary=300):
    return [f"w{int(rng.paretovariate(0.6)) % vocabulary}é" if rng.random() < 0.1 else f"w{rng.randrange(vocabulary)}" for _ in range(n)]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    texts = [" ".join(words_of(rng, rng.randint(0, 120))) for _ in range(60)]
    passage = " ".join(words_of(rng, 40))
    texts += [texts[3], texts[3].upper(), texts[5], passage + " " + texts[7], texts[8] + "\n" + passage, passage, None, None, "", " \n\t ", "one", "one two", "one two", " ".join(words_of(rng, 4000))]
    for k in (10, 11, 12, 13):  # near copies
        w = texts[k].split() or ["x"] * 30
        for _ in range(3):
            v = w[:]
            v[rng.randrange(len(v))] = "changed"
            texts.append(" ".join(v))
    return list(enumerate(texts))


EMPTY: list = []


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_bpe(spark, corpus):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.vocabulary())
    rows = corpus + [(1000, "<|endoftext|>a <|endoftext|>"), (1001, "x" * 3000 + " " * 500 + "é" * 700 + "\u2028\U0001f600"), (1002, "it's  I'LL\r\n 's")]
    got = by_id(bpe.encode_decode(docs_of(spark, rows), bpe.vocabulary()))
    for i, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids
        assert got[i].ids == ids and got[i].decoded == t.decode(ids, skip_special_tokens=False) == (text or "")
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest() and got[i].n_tokens == len(ids)
    b = bpe.load(bpe.vocabulary())
    for w in ("hello" * 30, "ab" * 100, "ééé" * 20):  # both ways of merging agree
        rows_ = np.frombuffer(w.encode(), np.uint8)[None, :]
        parts, size = b.rank_array(b.byte_id[rows_])
        assert parts[0, : size[0]].astype("<u4").tobytes() == b.heap(w.encode())
    assert b.decode(np.array([b.byte_id[0xC3]], "<u4").tobytes()) == "\ufffd"
    assert bpe.encode_decode(docs_of(spark, EMPTY), bpe.vocabulary()).count() == 0


def test_urls(spark):
    rules = [("com/", "allow"), ("bad.example.com/x", "block"), ("example.com/en/", "block"), ("example.com/en/", "allow"), ("net", "block")]
    cases = {None: "", "nothing": "", "http://A.Com": "allow", "http://a.com/": "com/", "x://bad.EXAMPLE.com/xyz?q#f": "bad.example.com/x", "x://www.example.com/en/1": "example.com/en/", "x://b.net#f": "net", "x://com.b.org/": "", "a://://x.com/": "", "x://": ""}
    pages = spark.createDataFrame([(k, u, "r") for k, u in enumerate(cases)] + [(0, None, "r")], "page_id bigint, url string, rule string")
    got = [(r.page_id, r.host, r.path, r.rule, r.verdict) for r in urls.filter_urls(pages, spark.createDataFrame(rules, "rule string, verdict string")).orderBy("page_id").collect()]
    want = [(0, "", "", None, "allow")] * 2 + [(1, "", "", None, "allow"), (2, "a.com", "", None, "allow"), (3, "a.com", "/", "com/", "allow"), (4, "bad.example.com", "/xyz", "bad.example.com/x", "block")]
    want += [(5, "www.example.com", "/en/1", "example.com/en/", "block"), (6, "b.net", "", "net", "block"), (7, "com.b.org", "/", None, "allow"), (8, ":", "//x.com/", None, "allow"), (9, "", "", None, "allow")]
    assert got == want
    assert urls.filter_urls(pages.limit(0), spark.createDataFrame([], "rule string, verdict string")).count() == 0


LOW = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def poor_key(c):
    """A key under which many different texts collide."""
    return F.shiftleft(F.length(c).cast("bigint"), 60)


@pytest.mark.parametrize("options", [{}, {"capacity": 3}, {"capacity": 3, "spread": 1}, {"capacity": 1, "key": poor_key}])
def test_exact(spark, corpus, options):
    rows = corpus + [(500, "ÉTÉ"), (501, "été"), (502, "ÉtÉ"), (500, "ÉTÉ"), (None, "alone"), (None, "twice"), (None, "TWICE"), (3, "one")]
    groups: dict = {}
    for i, t in rows:
        groups.setdefault(LOW(t), []).append(i)
    largest = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    got = exact.dedup(docs_of(spark, rows), **options).collect()
    want = [(i, largest[LOW(t)], len(groups[LOW(t)]), i == largest[LOW(t)], hashlib.sha256(LOW(t).encode()).hexdigest()) for i, t in rows]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert exact.dedup(docs_of(spark, EMPTY)).count() == 0


def test_exact_index(spark, corpus):
    _, buckets, entries = exact.index(docs_of(spark, corpus * 3), capacity=3, spread=2)
    owners: dict = {}
    for r in entries.withColumn("file", F.input_file_name()).collect():
        owners.setdefault((r.depth, r.prefix), []).append(r)
    assert len(owners) > 16 and all(len({r.file for r in own}) == 1 for own in owners.values())  # a bucket has one owner
    texts = {LOW(t) for _, t in corpus}
    assert sum(map(len, owners.values())) == len(texts)  # every different text is entered, those that occur once too
    assert {(r.depth, r.prefix): r.n for r in buckets.collect()} == {k: len(own) for k, own in owners.items()}
    _, _, entries = exact.index(docs_of(spark, corpus), capacity=1, key=poor_key)
    chains: dict = {}
    for r in entries.collect():
        chains.setdefault(r.key, []).append(r.chain)
    assert max(map(len, chains.values())) > 3 and all(sorted(c) == list(range(len(c))) for c in chains.values())


@pytest.mark.parametrize(("n", "capacity"), [(5000, 100), (3, 1), (1, 1), (0, 5), (40, 1)])
def test_directory(spark, n, capacity):
    keys = spark.range(n).select(F.xxhash64("id").alias("key"))
    d = exact.directory(keys, n, capacity).collect()
    assert sum(r.n for r in d) == n and all(0 < r.n <= capacity for r in d)
    whole = lambda r, x: ((r.prefix + x) << (64 - r.depth)) % (1 << 64)
    spans = sorted((whole(r, 0), whole(r, 1) or 1 << 64) for r in d)
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
    named = exact.placed(keys, spark.createDataFrame(d, "depth int, prefix bigint, n bigint")).collect() if d else []
    assert len(named) == n and all((r.key % (1 << 64)) >> (64 - r.depth) == r.prefix % (1 << 64) for r in named if r.depth)


def quality_corpus():
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(600):
        w, good = words_of(rng, rng.randint(5, 80)), rng.random() < 0.7
        rows.append((i, " ".join(w) + "." if good else " ".join(x.upper() + "!!" for x in w)))
        labels.append((i, int(good)))
    return rows + [(9000, None), (9001, ""), (9002, "word " * 30_000), (None, "some words"), (5, "another text of 5"), (5, "another text of 5"), (9003, "Aa AA aa aa 12 -- ,é")], labels + [(7, 0), (7, 1), (None, 1), (8, None)]


def test_quality(spark):
    rows, labels = quality_corpus()
    labels = spark.createDataFrame(labels, "doc_id bigint, quality int")
    got = quality.classify(docs_of(spark, rows), labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r["items"] == "x" for r in got)
    truth = {r.doc_id: r.quality for r in labels.collect()}
    held = [(r.score >= 0.3) == bool(truth[r.doc_id]) for r in got if truth.get(r.doc_id) is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert len(held) > 60 and sum(held) / len(held) > 0.95
    other = quality.classify(docs_of(spark, rows).repartition(7), labels, column="own").select("doc_id", "text", "score", "own").collect()
    assert sorted((str(r.doc_id), str(r.text), r.score) for r in got) == sorted((str(r.doc_id), str(r.text), r.own) for r in other) and {r.score for r in other} == {"s"}
    none = quality.classify(docs_of(spark, rows[:3]), labels.limit(0)).collect()
    assert [r.score for r in none] == [0.5] * 3
    one = quality.classify(docs_of(spark, rows[:9]), labels.where("quality = 1")).collect()
    assert [r.score for r in one] == [1.0] * 9
    assert quality.classify(docs_of(spark, EMPTY), labels).count() == 0


def test_quality_plainly(spark):
    """Lexicon, word vectors, pooling and scores against plain loops over words."""
    rows, labels = quality_corpus()
    rows = rows[:80] + rows[600:602] + rows[603:]
    docs, marks = docs_of(spark, rows).select("doc_id", "text"), spark.createDataFrame(labels, "doc_id bigint, quality int")
    lexicon, vectors, network = quality.fit(docs, marks, words=40)

    def words(text):
        out, before = [], None
        for m in re.finditer(rb"(?P<l>[A-Za-z\x80-\xff]+)|(?P<d>[0-9]+)|(?P<s>[^A-Za-z\x80-\xff0-9\x20\x09-\x0D]+)", (text or "").encode()):
            x, low = m[0], m[0].lower()
            if m["d"]:
                shape = 3
            elif m["s"]:
                shape = 5 if len(x) > 1 else 4
            else:
                up = sum(65 <= c <= 90 for c in x)
                shape = 6 if low == before else 2 if up > 1 and not any(97 <= c <= 122 for c in x) else 1 if up else 0
                before = low
            out.append((low, shape))
        return out

    def key(word):
        raw = np.frombuffer(word[0], np.uint8)
        return int(quality.mix(quality.span_hashes(raw, np.array([0]), np.array([len(raw)])) ^ quality._SHAPE[word[1]])[0])

    learned = {i for i, q in labels if i is not None and q is not None and zlib.crc32(str(i).encode()) % 5}
    count: dict = {}
    for i, t in rows:
        if i in learned:
            for w in {*words(t)}:
                count[key(w)] = count.get(key(w), 0) + 1
    signed = lambda k: k - (1 << 64) if k >> 63 else k
    want = sorted(sorted(count, key=lambda k: (-count[k], signed(k)))[:40])
    assert lexicon.keys.tolist() == want
    number = lambda w: want.index(key(w)) if key(w) in want else len(want) + w[1]
    texts = [[number(w) for w in words(t)] for _, t in rows]
    sums = [[0] * quality.DIMENSIONS for _ in range(len(lexicon))]
    for t in texts:
        for i, a in enumerate(t):
            for j in range(max(0, i - quality.REACH), min(len(t), i + quality.REACH + 1)):
                if j != i:
                    for p in range(quality.PLACES):
                        sums[a][lexicon.at[p][t[j]]] += int(lexicon.sign[p][t[j]])
    for got, s in zip(vectors.tolist(), sums):
        norm = sum(x * x for x in s) ** 0.5
        assert got == pytest.approx([round(x / max(norm, 1e-9) * quality.SCALE) for x in s], abs=1)
    by_text: dict = {}
    for r in quality.classify(docs, marks, words=40).collect():
        by_text[r.text] = r.score
    for (_, text), t in zip(rows, texts):
        mean = [sum(vectors[w][d] / quality.SCALE for w in t) / max(1, len(t)) for d in range(quality.DIMENSIONS)]
        square = [sum((vectors[w][d] / quality.SCALE) ** 2 for w in t) / max(1, len(t)) for d in range(quality.DIMENSIONS)]
        x = [*mean, *(max(0, s - m * m) ** 0.5 for s, m in zip(square, mean))]
        z = [(v - m) / s for v, m, s in zip(x, network.mean, network.scale)]
        h = [np.tanh(sum(z[j] * network.p["a"][j][k] for j in range(len(z))) + network.p["b"][k]) for k in range(quality.HIDDEN)]
        logit = sum(a * b for a, b in zip(h, network.p["c"])) + network.p["d"][0]
        assert by_text[text] == pytest.approx(1 / (1 + np.exp(-logit / network.temperature)), abs=1e-5)


@pytest.mark.parametrize("options", [{}, {"chunk": 500, "frequent": 1}])
@pytest.mark.parametrize("odd", [False, True])
def test_substring(spark, corpus, options, odd):
    rows = list(corpus)
    if odd:  # repeated rows, one id with different texts, rows without id, and the largest id there is
        rows += [(3, corpus[3][1]), (4, corpus[6][1]), (None, corpus[3][1]), (None, corpus[7][1] + " z"), (None, "x " * 20), (2**63 - 1, corpus[9][1]), (None, "x " * 20)]
    split = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    order = lambda i: 2**63 - 1 if i is None else i
    least: dict = {}
    for i, w in split:
        for k in range(len(w) - 12):
            x = tuple(w[k : k + 13])
            least[x] = min(order(i), least.get(x, 2**63))
    want = []
    for i, w in split:
        gone = {j for k in range(len(w) - 12) if least[tuple(w[k : k + 13])] < order(i) for j in range(k, k + 13)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        want.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept, sorted(gone)))
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept_sha256, r.kept, [j for s in r.spans for j in range(s.start, s.end)]) for r in substring.dedup_substrings(docs_of(spark, rows), **options).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert substring.dedup_substrings(docs_of(spark, EMPTY)).count() == 0


def test_chat(spark):
    nasty = "a\\b\\\\. <|im_end|>\n<|im_start|>user\n[INST]</s>\\n<s>"
    rows = [(1, 0, "system", "be"), (1, 1, "user", nasty), (1, 2, "assistant", nasty), (1, 3, "user", None), (1, 4, "assistant", ""), (1, 5, "user", "bye"), (2, 0, "us\ner\\n", "x"), (3, 1, None, None), (None, 0, "assistant", "é" * 50_000), (4, 0, "assistant", "same"), (4, 0, "assistant", "same")]
    df = spark.createDataFrame([(*r, "t") for r in rows], "conv_id bigint, turn bigint, role string, text string, example string")
    examples = chat.expand(df)
    back = {r.conv_id: r for r in chat.read_back(examples).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted((t, r or "", x or "") for c, t, r, x in rows if c == conv)
        assert [(t.role, t.text) for t in back[conv].turns] == [(r, x) for _, r, x in own]
        assert "".join(back[conv].loss) == "".join(x for _, r, x in own if r == "assistant")
    one = [r for r in examples.where("conv_id = 1").orderBy("example").collect()]
    assert [r.n_turns for r in one] == [3, 5, 6] and one[2].loss_start is None and one[1].text.startswith(one[0].text)
    assert all(c not in chat_text for c in ("[INST]", "</s>") for chat_text in (r.text for r in one))
    assert chat.expand(df.limit(0)).count() == 0 and chat.read_back(examples.limit(0)).count() == 0


@pytest.mark.parametrize("rule", ["first", "share"])
def test_token_counts(spark, corpus, rule):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.vocabulary())
    rows = corpus[:20] + [(900, "a\n\nbé\n"), (901, None), (902, "no feed"), (903, "\n"), (904, "\n\n\n  x")]
    got: dict = {}
    for r in tokencounts.count_tokens(docs_of(spark, rows), bpe.vocabulary(), rule=rule).collect():
        got.setdefault(r.doc_id, []).append(r)
    for i, text in rows:
        text = text or ""
        spans = [(len(x.encode()), x) for x in text.splitlines(keepends=True)] if "\r" not in text else None
        own = sorted(got[i], key=lambda r: r.section)
        assert [text[r.start : r.end] for r in own] == ([x for _, x in spans] or [""])
        ids = t.encode(text, add_special_tokens=False).ids
        assert own[0].doc_tokens == len(ids) and sum(r.tokens for r in own) == pytest.approx(len(ids))
        if rule == "first":
            b, at = bpe.load(bpe.vocabulary()), 0
            edges = np.cumsum([0, *(n for n, _ in spans)])
            count = [0] * max(1, len(spans))
            for x in ids:
                count[int(np.searchsorted(edges, at, "right")) - 1] += 1
                at += len(b.spelling[x])
            assert [r.tokens for r in own] == count
    with pytest.raises(ValueError):
        tokencounts.count_tokens(docs_of(spark, rows), bpe.vocabulary(), rule="half")


def test_token_sections(spark):
    kind = "doc_id bigint, text string, spans array<struct<start:int,end:int>>, tokens string, section int"
    rows = [(1, "ab cd\nef", [(0, 2), (2, 99), (0, 0)], "t", 7), (1, "ab cd\nef", [(0, 2), (2, 99), (0, 0)], "t", 7), (None, "x y", [(0, 3)], "t", 7), (2, "zz", None, "t", 7), (3, None, [(0, 5)], "t", 7), (4, "q", [], "t", 7)]
    df = spark.createDataFrame(rows, kind)
    got = sorted((str(r.doc_id), r.section, r.start, r.end, r.tokens) for r in tokencounts.count_tokens(df, bpe.vocabulary(), sections="spans").collect())
    n = {t: len(np.frombuffer(bpe.load(bpe.vocabulary()).encode([t])[0], "<u4")) for t in ("ab", " cd\nef", "x y")}
    one = [("1", 0, 0, 2, n["ab"]), ("1", 1, 2, 8, n[" cd\nef"]), ("1", 2, 0, 0, 0.0)]
    assert got == sorted([*one, *one, ("None", 0, 0, 3, n["x y"]), ("3", 0, 0, 0, 0.0)])
    assert tokencounts.count_tokens(docs_of(spark, EMPTY), bpe.vocabulary()).count() == 0
    again = tokencounts.count_tokens(docs_of(spark, [(1, "a\nb"), (1, "a\nb")]), bpe.vocabulary()).collect()
    assert sorted(r.section for r in again) == [0, 0, 1, 1]


def test_long_words_are_not_kept():
    b = bpe.ByteBPE(bpe.vocabulary())
    text = "short " + "ACGT" * 5000 + " words"
    first = b.encode([text, text])
    assert first[0] == first[1] == b.encode([text])[0] and b.decode(first[0]) == text
    assert all(len(w.encode()) <= bpe.SHORT for w in b.words)


def test_token_attribution():
    count, crossing = tokencounts.attribute(np.array([2, 4, 2]), np.array([0, 3, 0]), np.array([3, 8, 8]), "share")
    assert count.tolist() == [1.25, 1.75, 3.0] and crossing.tolist() == [1, 1, 0]


@pytest.mark.parametrize("item_bytes", [1 << 20, 200])
def test_decontam(spark, corpus, item_bytes):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda t: word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    items = [(1, corpus[3][1]), (2, " ".join(corpus[4][1].split()[:25])), (10, "W1 w2"), (11, None), (12, " .. "), (13, corpus[3][1]), (14, "one"), (None, "x")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = by_id(decontam.find_items(docs_of(spark, corpus), bench, item_bytes=item_bytes))
    windows = {}
    for i, t in items:
        w = low(t)
        n = min(10, len(w))
        if i is not None and n:
            windows[str(i)] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
    for i, t in corpus:
        w = low(t)
        hit, found = set(), set()
        for item, ws in windows.items():
            for n in {len(x) for x in ws}:
                for k in range(len(w) - n + 1):
                    if tuple(w[k : k + n]) in ws:
                        hit |= {*range(k, k + n)}
                        found.add(item)
        assert (got[i].n_words, got[i].n_hit, got[i]["items"]) == (len(w), len(hit), sorted(found))
        assert {j for s in got[i].spans for j in range(s.start, s.end)} == hit
    assert decontam.find_items(docs_of(spark, corpus), bench.limit(0)).where("n_hit > 0").count() == 0


@pytest.mark.parametrize("item_bytes", [1 << 20, 20])
def test_decontam_without_id(spark, item_bytes):
    passage = " ".join(f"p{k}" for k in range(12))
    bench = spark.createDataFrame([(None, passage), (None, "lone word"), (5, passage)], "item_id bigint, text string")
    got = by_id(decontam.find_items(docs_of(spark, [(1, "a " + passage), (2, "lone word"), (3, "clean")]), bench, item_bytes=item_bytes))
    assert [(got[i].n_hit, got[i]["items"]) for i in (1, 2, 3)] == [(12, ["5", None]), (2, [None]), (0, [])]


def test_decontam_rows(spark, corpus):
    """Rows without id, repeated rows and one id with two texts, dealt anew by a shuffle, in several blocks of items."""
    passage, other = " ".join(f"p{k}" for k in range(12)), " ".join(f"o{k}" for k in range(12))
    rows = [(None, passage), (None, other), (None, "clean"), (1, passage + " " + other), (1, passage + " " + other), (2, passage), (2, other), (2, None), (None, None)]
    bench = spark.createDataFrame([(1, passage), (2, other), (3, "and a third one")], "item_id int, text string")
    for size in (1 << 20, 10):
        got = decontam.find_items(docs_of(spark, rows).repartition(5, F.rand()), bench, item_bytes=size).collect()
        want = [(None, 12, 12, ["1"]), (None, 12, 12, ["2"]), (None, 1, 0, []), (1, 24, 24, ["1", "2"]), (1, 24, 24, ["1", "2"]), (2, 12, 12, ["1"]), (2, 12, 12, ["2"]), (2, 0, 0, []), (None, 0, 0, [])]
        assert sorted(repr((r.doc_id, r.n_words, r.n_hit, r["items"])) for r in got) == sorted(map(repr, want))
        assert decontam.find_items(docs_of(spark, EMPTY), bench, item_bytes=size).count() == 0


def test_decontam_size():
    """A block of items stays compact."""
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefghijklmnop", k=5)) for _ in range(20_000)]
    items = [(str(k), " ".join(rng.choices(words, k=300))) for k in range(600)]
    size, patterns = sum(len(t) for _, t in items), decontam.Patterns(items)
    (t,) = patterns.tables
    held = len(patterns.low) + sum(x.nbytes for x in (patterns.starts, patterns.ends, t.whole, t.heads, t.shift))
    assert held < 16 * size and (t.shift == 0).mean() < 0.1


def test_language_model(spark, corpus):
    rows = [(i, t) for i, t in corpus] + [(corpus[0][0], corpus[0][1]), (None, "w1 w2"), (2**63 - 1, "w1 w2")]
    got = lm.score_texts(docs_of(spark, rows)).collect()
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    tokens = {i: [*re.findall(r"[^\x20\x09-\x0D]+", low(t)), None] for i, t in rows}
    fold = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    count: dict = {}
    for i, _ in rows:
        if not fold(i):
            for w in tokens[i]:
                count[w] = count.get(w, 0) + 1
    n, v = sum(count.values()), len(count)
    assert len(got) == len(rows)
    for r in got:
        own = tokens[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (fold(r.doc_id), len(own), sum(w in count for w in own), n)
        assert r.base_score == pytest.approx(sum(np.log10((count.get(w, 0) + 1) / (n + v + 1)) for w in own)) and r.score < 0
    assert lm.score_texts(docs_of(spark, EMPTY)).count() == 0


def test_hidden_markov():
    rng = np.random.default_rng(1)
    model = lm.Model(np.arange(3, dtype=np.uint64), np.array([5.0, 4.0, 3.0]), 20)
    sizes = np.array([4, 1, 3])
    symbols = rng.integers(0, 4, 8)
    firsts = np.cumsum(sizes) - sizes

    def likelihood(s):  # sum over all paths
        total = 0.0
        for path in np.ndindex(*[lm.STATES] * len(s)):
            p = model.start[path[0]] * model.emit[path[0], s[0]]
            for a, b, x in zip(path, path[1:], s[1:]):
                p *= model.move[a, b] * model.emit[b, x]
            total += p
        return np.log10(total)

    got = lm.forward(model.start, model.move, model.emit.T, symbols, firsts, sizes)
    assert got == pytest.approx([likelihood(symbols[f : f + n]) for f, n in zip(firsts, sizes)])
    long = rng.integers(0, 4, 500)
    likes = [model.update(lm.expected(model, long, np.array([0, 300]), np.array([300, 200]))) for _ in range(6)]
    assert all(b > a for a, b in zip(likes, likes[1:]))


def test_language_model_is_a_distribution():
    """The probabilities of all words and of one unknown word add up to one in every state; parts add up too."""
    rng = np.random.default_rng(3)
    counts = np.array([50, 9, 7, 3, 2, 1, 1])
    share = rng.dirichlet(np.ones(lm.STATES), len(counts))
    parts = lm.in_parts(share)
    assert (parts.sum(axis=1) == lm.PARTS).all() and np.abs(parts / lm.PARTS - share).max() < lm.STATES / lm.PARTS
    rare = counts < 3
    parts[rare] = 0
    whole = [counts.sum(), len(counts), counts[rare].sum(), rare.sum(), *(counts[rare] @ share[rare]), *(counts @ (parts / lm.PARTS))]
    model = lm.Model(np.arange(2, dtype=np.uint64), np.array([50.0, 9.0]), 73)
    emit, spelled = lm.Scorer(model, np.array(whole)).emissions(np.append(counts, 0).astype(float), np.vstack([parts, np.zeros(lm.STATES)]))
    assert (emit * 10.0 ** spelled[:, None]).sum(axis=0) == pytest.approx(np.ones(lm.STATES))


@pytest.mark.parametrize("least", [2, 4])
def test_language_model_by_loops(spark, least, monkeypatch):
    """The last round's counts and the scores against plain loops, given the model of common words."""
    monkeypatch.setattr(lm, "BLOCK_TOKENS", 150)
    rng = random.Random(8)
    docs = [(i, " ".join(rng.choices([f"{'ab'[i % 2]}{k}" for k in range(12)] + ["c", f"rare{i}"], k=rng.randint(0, 60)))) for i in range(40)]
    kept: list = []
    real = lm.Model.update
    monkeypatch.setattr(lm.Model, "update", lambda self, sums: (kept.append(self), real(self, sums))[1])
    got = by_id(lm.score_texts(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3), least=least))
    model = kept[-1]
    tokens = {i: [*t.split(), None] for i, t in docs}
    name = lambda w: int(lm.END) if w is None else int(lm.word_hashes(*lm.buffers(pa.array([w])))[0][0])
    training = [i for i, _ in docs if zlib.crc32(str(i).encode()) % 7 != 2]
    count: dict = {}
    states: dict = {}
    for i in training:
        symbols = model.symbols(np.array([name(w) for w in tokens[i]], np.uint64))
        gamma, *_ = lm.posteriors(model, symbols, np.array([0]), np.array([len(symbols)]))
        for w, g in zip(tokens[i], gamma):
            count[w] = count.get(w, 0) + 1
            states[w] = states.get(w, 0) + g.astype(float)
    n, rare = sum(count.values()), {w for w, c in count.items() if c < least}
    seen = {w: states[w] for w in count if w not in rare}
    other = sum((states[w] for w in rare), np.zeros(lm.STATES))
    whole = sum(seen.values()) + other + 1
    rare_n = sum(count[w] for w in rare)

    def emit(w):
        if w in seen:
            return 0.8 * seen[w] / whole + 0.2 * count[w] / (n + 1)
        return (0.8 * (other + 1) / whole + 0.2 * (rare_n + 1) / (n + 1)) * (count.get(w, 0) + 1) / (rare_n + len(rare) + 1)

    for i, _ in docs:
        a, total = model.start, 0.0
        for k, w in enumerate(tokens[i]):
            a = (a @ model.move if k else a) * emit(w)
            total += np.log10(a.sum())
            a = a / a.sum()
        assert got[i].score == pytest.approx(total, abs=0.02 * len(tokens[i]))  # shares are kept in parts of 1/255


def test_language_model_gains(spark):
    """Over held-out documents the model beats the unigram."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    held = [r for r in lm.score_texts(docs).collect() if r.held_out]
    assert len(held) > 10 and sum(r.score for r in held) > sum(r.base_score for r in held)
    assert sum(r.score > r.base_score for r in held) > 0.9 * len(held)


def brute_components(rows):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    top = {i: i for i in sets}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                top[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("settings", [{}, {"BLOCK": 4, "FREQUENT": 1, "ROUNDS": ((1, 2), (2, 16), (None, 16))}, {"BLOCK": 2, "PIVOTS": 1, "FREQUENT": 1, "ROUNDS": ((1, 1), (None, 1))}])
def test_jaccard(spark, corpus, settings, monkeypatch):
    rng = random.Random(9)
    rows = list(corpus)
    base = words_of(rng, 60)
    for k in range(40):  # a chain of texts that drift apart, and texts that share half
        rows.append((2000 + k, " ".join(base)))
        base[rng.randrange(60)] = f"drift{k}"
        rows.append((3000 + k, " ".join(base[:30] + words_of(rng, 30))))
    for name, value in settings.items():
        monkeypatch.setattr(jaccard, name, value)
    want = brute_components(rows)
    got = by_id(jaccard.join(docs_of(spark, rows)))
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == want


def test_jaccard_ids(spark):
    words = [f"q{k}" for k in range(40)]
    near = " ".join(words[:39] + ["other"])
    rows = [(None, "a b"), (None, None), (5, " ".join(words)), (5, near), (5, "quite another text"), (None, near.upper()), (9, " ".join(words)), (9, " ".join(words)), (7, "A b"), (None, "alone"), (None, "alone"), (8, "")]
    got = sorted(map(repr, map(tuple, jaccard.join(docs_of(spark, rows)).collect())))
    want = [(None, 1, 7), (None, 0, None), (5, 36, 5), (5, 36, 5), (5, 1, 5), (None, 36, 5), (9, 36, 5), (9, 36, 5), (7, 1, 7), (None, 1, None), (None, 1, None), (8, 0, 8)]
    assert got == sorted(map(repr, want))
    assert jaccard.join(docs_of(spark, EMPTY)).count() == 0


@pytest.mark.parametrize("rounds", [None, 1, 2])
def test_components(spark, rounds):
    rng = random.Random(11)
    edges = [(k, k + 1) for k in range(100, 160)] + [(1000, 1000 + k) for k in range(1, 40)] + [(rng.randrange(300, 420), rng.randrange(300, 420)) for _ in range(90)] + [(7, 7), (5, 6), (6, 5)]
    top: dict = {}

    def find(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        top[y] = x
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint"), rounds).collect()}
    assert all(find(k) == find(v) and v < k for k, v in got.items())
    if rounds is None:
        assert got == {k: find(k) for k in top if find(k) != k}
    assert components(spark.createDataFrame([], "a bigint, b bigint"), rounds).count() == 0


def test_shared_folder(spark):
    where = shared.shared_dir(spark)
    assert spark.conf.get("spark.checkpoint.dir").rstrip("/") == where
    t = shared.written(spark.range(3), "test")
    assert t.count() == shared.rows_of(t) == 3 and shared.mark_of(t) == shared.mark_of(shared.written(spark.range(3).repartition(3), "test")) != shared.mark_of(shared.written(spark.range(1, 4), "test"))
    assert shared.rows_of(shared.written(spark.range(0), "test")) == 0
    assert t.count() == 3 and where.split(":")[-1].lstrip("/") in t.inputFiles()[0]
    shared.forget(t)
    with pytest.raises(Exception):  # noqa: B017
        t.count()
    assert shared.fits(spark.range(10)) and not shared.fits(spark.range(10).select(F.repeat(F.lit("x"), 1 << 20).alias("x")))


@pytest.mark.parametrize("n", [1, 3, 8, 9, 30])
def test_dealt_evenly(spark, n):
    labels = shared.deal(spark, n)
    assert len(set(labels)) == n
    parts = spark.createDataFrame([(x,) for x in labels], "x int").repartition(4, "x").groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in parts) == -(-n // 4)
