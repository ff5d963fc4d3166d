"""Further queries of the catalogue: lines made ready for models, files, lexicons, summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from colloquy.functions import text as T
from colloquy.operators import cache, files
from colloquy.plans.catalog import _CACHE, _KEYED, _cache, _forms, _keyed, _words, query
from colloquy.schema import ENDING_PUNCT, MOR_PUNCT
from colloquy.sources import tables


def _chain(text: str, pairs: list[tuple[str, str]]) -> str:
    """SQL of replacements one after the other."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    return reduce(lambda s, p: f"replace({s}, {q(p[0])}, {q(p[1])})", pairs, text)


_LINE = """'+, go ' || text || ' gumma@c:x, it''' || CASE turn % 3 WHEN 0 THEN ' +...' WHEN 1 THEN ' ?' ELSE '' END"""


@query(rf"""WITH a AS (SELECT conv_id AS doc_id, turn AS line_no, {_LINE} AS t FROM conversations), b AS (SELECT *, string_split(t, ' ')[-1] AS last FROM a),
c AS (SELECT *, NOT regexp_matches(last, '[\p{{L}}\p{{N}}_]') AS marked FROM b), d AS (SELECT *, CASE WHEN marked THEN regexp_replace(left(t, length(t) - length(last)), '^\s+|\s+$', '', 'g') ELSE t END AS cut FROM c),
e AS (SELECT *, regexp_replace(cut, '\+,|\+\+|\+"', '', 'g') AS x FROM d)
SELECT doc_id, line_no, {_chain(r"regexp_replace(regexp_replace(x, '[\p{L}\p{N}_]+@[\p{L}\p{N}_:]+', 'xbxxx', 'g'), '''$', '')", [(",", " ,"), ("+ ,", "+,"), ("  ", " ")])} AS line,
CASE WHEN marked THEN last ELSE '.' END AS ending, array_to_string(regexp_extract_all(x, '[\p{{L}}\p{{N}}_]+@[\p{{L}}\p{{N}}_:]+'), ' ') AS special FROM e""")
def tagging_text(spark, d):
    """Every turn, with a linker, a special form and an end mark put around it, made ready for a tagger."""
    u = tables.table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("line_no"), F.expr(_LINE.replace("''' ", "\\'' ")).alias("t"))
    line, ending, special = T.tagging_parts(F.col("t"))
    return u.select("doc_id", "line_no", line.alias("line"), ending.alias("ending"), F.array_join(special, " ").alias("special"))


_SPELLED = "'+... ¿' || text || ' . . .,the U S A and u s a '"


@query(rf"""WITH a AS (SELECT doc_id, {_chain(_SPELLED, [(". . .", "+..."), (" ' ", "'"), ("¿", ""), ("¡", "")])} AS t FROM documents),
b AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(t, '^\s+|\s+$', '', 'g'), '^\+\.\.\.', ''), '^\s+|\s+$', '', 'g') AS t FROM a),
c AS (SELECT doc_id, replace(regexp_replace(regexp_replace(replace(t, ',', ' , '), ' +', ' ', 'g'), '^\s+|\s+$', '', 'g'), '+ ,', '+,') AS t FROM b)
SELECT doc_id, sha256({_chain("t", [(" U S A ", " USA "), (" u s a ", " USA ")])}) AS digest FROM c""")
def written_lines(spark, d):
    """Every document as a written main line."""
    x = tables.table(spark, d, "documents").select("doc_id", F.expr(_SPELLED).alias("t"))
    return x.select("doc_id", F.sha2(T.written_line(F.col("t"), ["USA"]), 256).alias("digest"))


_MARKS = ["lla", "ll", "es", "on"]


@query(f"""WITH c AS (SELECT doc_id, regexp_extract_all(text, '(?s)(.*?(?:{"|".join(_MARKS)})|.+$)') AS p FROM documents)
SELECT doc_id, CAST(len(p) AS BIGINT) AS n, sha256(array_to_string(p, chr(1))) AS digest FROM c""")
def keyword_chunks(spark, d):
    """Every document cut behind marks."""
    c = tables.table(spark, d, "documents").select("doc_id", T.keyword_chunks(F.col("text"), _MARKS).alias("p"))
    return c.select("doc_id", F.size("p").cast("bigint").alias("n"), F.sha2(F.array_join("p", "\x01"), 256).alias("digest"))


_TR = [("。", "."), ("’", "'"), ("\t", " "), ("​", ""), *((m, " " + m) for m in MOR_PUNCT + ENDING_PUNCT)]


@query(f"""WITH i AS (SELECT doc_id, CASE WHEN lang = 'es' THEN replace(replace(text, ' ', ''), '.', '。') ELSE text END AS t FROM documents)
SELECT doc_id, sha256(t) AS asked, sha256({_chain("t", _TR)}) AS tier FROM i""")
def translate_texts(spark, d):
    """Texts before and after translation by a model that changes nothing; Spanish stands for Chinese."""
    x = tables.table(spark, d, "documents").select("doc_id", T.translation_input(F.col("text"), F.when(F.col("lang") == "es", "zho").otherwise(F.col("lang"))).alias("t"))
    return x.select("doc_id", F.sha2("t", 256).alias("asked"), F.sha2(T.translation_output(F.col("t"), MOR_PUNCT + ENDING_PUNCT), 256).alias("tier"))


@query(f"""WITH $FORMS SELECT doc_id, line_no, count(*) AS n, count(*) FILTER (type = 5) AS punct FROM f WHERE type = 5 OR lower(text) NOT IN ({", ".join(f"'{w}'" for w in ["the", *T.FILLERS])}) GROUP BY doc_id, line_no""")
def comparable_words(spark, d):
    """Words that count in a comparison, and the punctuation that is kept aside; ``the`` is one more filler here."""
    f = _forms(spark, d).where((F.col("type") == 5) | ~F.lower("text").isin(["the", *T.FILLERS]))
    return f.groupBy("doc_id", "line_no").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("type") == 5).alias("punct"))


@query("SELECT conv_id AS doc_id, turn AS line_no, turn % 3 <> 0 AND turn % 4 <> 0 AS taggable FROM conversations")
def taggable_lines(spark, d):
    """Which lines a tagger gets: not those in another language, not bare punctuation."""
    k = F.col("line_no")
    u = tables.utterances(spark, d).withColumn("text", F.when(k % 3 == 0, F.concat(F.lit("[- spa] "), "text")).when(k % 4 == 0, "+...").otherwise(F.concat(F.lit("x "), "text")))
    return u.select("doc_id", "line_no", (T.language_override(F.col("text")).isNull() & ~F.trim("text").isin(ENDING_PUNCT + MOR_PUNCT)).alias("taggable"))


@query("WITH $TIMED SELECT tier, max(end_ms - start_ms) AS peak, min(end_ms - start_ms) AS least, avg(end_ms - start_ms) AS mean, count(*) AS n FROM t GROUP BY tier")
def run_summary(spark, d):
    """Average of a benchmark's runs, with peak and least sample."""
    return files.summary(tables.timed(spark, d), ["tier"], F.col("end_ms") - F.col("start_ms"))


_NAME = "'d' || (doc_id // 2) || CASE WHEN doc_id % 2 = 0 THEN '.cs.wav' WHEN doc_id % 3 = 0 THEN '.sv.wav' ELSE '.wav' END"


@query(f"""WITH n AS (SELECT {_NAME} AS name FROM documents)
SELECT n.name, p.name AS partner, CASE WHEN n.name NOT LIKE '%.cs.%' THEN 'not a .cs. file' WHEN p.name IS NULL THEN 'missing: ' || replace(n.name, '.cs.', '.sv.') END AS error
FROM n LEFT JOIN (SELECT DISTINCT name FROM n) p ON n.name LIKE '%.cs.%' AND p.name = replace(n.name, '.cs.', '.sv.')""")
def file_pairs(spark, d):
    """Speech files and their vowel files."""
    return files.paired(tables.table(spark, d, "documents").select(F.expr(_NAME.replace("//", "DIV")).alias("name")), "cs", "sv")


_PARTS = {"au": ["à", "le"], "du": ["de", "le"], "zum": ["zu", "dem"], "del": ["de", "el"], "cannot": ["can", "not"]}


@query(f"""WITH $FORMS, l(word, parts) AS (VALUES {", ".join(f"('{w}', '{' '.join(p)}')" for w, p in _PARTS.items())})
SELECT doc_id, line_no, form_no, f.text, coalesce(l.parts, f.text) AS parts FROM f LEFT JOIN l ON lower(f.text) = l.word WHERE type = 0""")
def multiword_parts(spark, d):
    """Words that stand for several, by a lexicon."""
    lexicon = spark.createDataFrame([*_PARTS.items()], "word string, parts array<string>")
    return files.expanded(_words(spark, d), lexicon).select("doc_id", "line_no", F.col("form_no").cast("bigint").alias("form_no"), "text", F.array_join("parts", " ").alias("parts"))


@query("SELECT doc_id, lang, CAST(NULL AS INTEGER) AS quality, CAST(NULL AS INTEGER) AS toxic FROM documents UNION ALL SELECT doc_id, NULL, quality, toxic FROM labels")
def report_union(spark, d):
    """Reports with unlike columns as one table."""
    return files.table_union([tables.table(spark, d, "documents").select("doc_id", "lang"), tables.table(spark, d, "labels")])


@query("""WITH $FORMS, g AS (SELECT doc_id, line_no, lower(text) AS w, min(form_no) AS k FROM f GROUP BY ALL) SELECT doc_id, line_no, string_agg(w, ' ' ORDER BY k) AS words FROM g GROUP BY doc_id, line_no""")
def distinct_ordered(spark, d):
    """Distinct words of each turn in the order in which they come up."""
    u = tables.utterances(spark, d).select("doc_id", "line_no", F.array_distinct(F.transform(tables.tokens(F.col("text")), lambda x: F.lower(x))).alias("w"))
    return u.where(F.size("w") > 0).select("doc_id", "line_no", F.array_join("w", " ").alias("words"))


@query(f"WITH {_KEYED}, {_CACHE} SELECT key, min(doc_id) AS doc_id, count(*) AS n FROM kx WHERE key NOT IN (SELECT key FROM cx WHERE task = 'morphosyntax' AND engine_version = '1.1') GROUP BY key")
def cache_warm(spark, d):
    """Entries that warming the cache adds: one for each key that is not there yet."""
    return cache.misses(_keyed(spark, d), _cache(spark, d), "morphosyntax", "1.1").groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n"))
