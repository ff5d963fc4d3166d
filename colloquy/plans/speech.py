"""Queries of whole documents, recognised speech, transfers and cache entries."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy.functions import numbers, text as T
from colloquy.operators import asr, cache, comparison, files, metrics, sequence, transfer
from colloquy.plans.catalog import _RETRACE, _forms, _joined, _words, query
from colloquy.sources import chat, documents, lexicons, tables, textgrid

# --- documents -------------------------------------------------------------------------------------------------------

_MARKED = """sp AS (SELECT doc_id, line_no, tier, string_agg(text, ' ' ORDER BY form_no) AS text, count(*) AS n FROM f GROUP BY doc_id, line_no, tier)"""


def _documents(spark, d):
    """Conversations as documents and utterances: each word of a line has a time, a part of speech and an edge."""
    f = _forms(spark, d)
    null = F.lit(None)
    at = F.col("line_no") * 100_000 + F.col("form_no") * 10
    spoken = F.col("type") == 0
    mor = F.when(spoken, F.array(F.struct(F.lower("text").alias("lemma"), F.lit("noun").alias("pos"), F.lit("Plur").alias("feats")))).otherwise(F.array(F.struct(F.col("text").alias("lemma"), F.when(F.col("text") == ",", "cm").otherwise("PUNCT").alias("pos"), F.lit("").alias("feats"))))
    edge = F.array(F.struct((F.col("form_no") + 1).cast("int").alias("id"), F.col("form_no").cast("int").alias("dep_id"), F.when(F.col("form_no") == 0, "ROOT").otherwise("DEP").alias("dep_type")))
    form = F.struct("text", F.col("type").cast("int").alias("type"), F.when(spoken, at).alias("start_ms"), F.when(spoken, at + 9).alias("end_ms"), mor.alias("morphology"), edge.alias("dependency"))
    lines = f.groupBy("doc_id", "line_no", "tier").agg(F.transform(F.array_sort(F.collect_list(F.struct("form_no", form.alias("x")))), lambda v: v["x"]).alias("forms"))
    lines = lines.withColumns({"text": null.cast("string"), "start_ms": F.col("line_no") * 100_000, "end_ms": F.col("line_no") * 100_000 + 99_999, "translation": F.concat(F.lit("line "), F.col("line_no").cast("string"))})
    person = F.struct(F.col("tier").alias("id"), F.initcap("tier").alias("name"), F.lit("eng").alias("lang"), F.lit("talk").alias("corpus"), F.lit("").alias("birthday"), F.array(*[F.lit("")] * 5).alias("additional"))
    docs = lines.groupBy("doc_id").agg(F.array_sort(F.collect_set(person)).alias("participants"))
    custom = F.array(F.struct(F.lit(-1).cast("bigint").alias("line_no"), F.lit("Comment").alias("id"), F.concat(F.lit("talk "), F.col("doc_id").cast("string")).alias("content")))
    docs = docs.withColumns({"pid": F.concat(F.lit("11312/"), F.col("doc_id").cast("string")), "langs": F.array(F.lit("eng"), F.lit("fra")), "options": null.cast("string"), "media": F.struct(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("name"), F.lit("audio").alias("type"), F.lit("unlinked").alias("state")), "customs": custom})
    return docs, lines


def _read_back(spark, d):
    docs, lines = _documents(spark, d)
    return chat.lines(documents.files(docs, lines))


@query("""SELECT conv_id AS doc_id, '11312/' || conv_id AS pid, 'eng fra' AS langs, 'd' || conv_id AS media, 'unlinked' AS state, string_agg(DISTINCT role, ' ' ORDER BY role) AS people, 'talk ' || conv_id AS comment, CAST(NULL AS VARCHAR) AS error
FROM conversations WHERE len(regexp_extract_all(text, '[\\p{L}\\p{N}'']+|[.,!?]')) > 0 GROUP BY conv_id""")
def document_headers(spark, d):
    """Headers of conversations written as files and read back."""
    h = documents.documents(_read_back(spark, d))
    return h.select("doc_id", "pid", F.array_join("langs", " ").alias("langs"), F.col("media.name").alias("media"), F.col("media.state").alias("state"), F.array_join(F.transform("participants", lambda p: p["id"]), " ").alias("people"), F.col("customs")[0]["content"].alias("comment"), "error")


def _back(spark, d):
    return documents.utterances(_read_back(spark, d)).where("error IS NULL").withColumn("line", F.regexp_extract("translation", r"line (\d+)", 1).cast("bigint"))


@query(r"""WITH $FORMS, one AS (SELECT doc_id, line_no, count(*) AS n, max(text) AS t FROM f GROUP BY doc_id, line_no)
SELECT f.doc_id, f.line_no AS line, f.tier, f.text, CASE WHEN f.type = 0 THEN f.line_no * 100000 + f.form_no * 10 END AS start_ms, CASE WHEN f.type = 0 THEN 'noun' WHEN f.text = ',' THEN 'cm' ELSE 'PUNCT' END AS pos, CASE WHEN f.type = 0 THEN lower(f.text) ELSE f.text END AS lemma, f.form_no + 1 AS id, CASE WHEN f.form_no = 0 THEN 'ROOT' ELSE 'DEP' END AS dep
FROM f JOIN one USING (doc_id, line_no) WHERE NOT (one.n = 1 AND one.t IN ('.', '?', '!')) AND NOT EXISTS (SELECT 1 FROM f g WHERE g.doc_id = f.doc_id AND g.line_no = f.line_no AND (NOT regexp_matches(g.text, '^([\p{L}\p{N}]+|[.,!?])$') OR g.text = ',' OR regexp_matches(g.text, '^0.')))""")
def tiers_round_trip(spark, d):
    """Words with their times, morphology and edges, written as main line, %mor, %gra and %wor and joined again when the
    files are read back; lines with commas or apostrophes, whose signs the format writes otherwise, are left to tests."""
    plain = _forms(spark, d).groupBy("doc_id", F.col("line_no").alias("line")).agg(F.bool_and(F.col("text").rlike(r"^([\p{L}\p{N}]+|[.!?])$") & ~F.col("text").rlike("^0.")).alias("plain")).where("plain")
    back = _back(spark, d).join(plain, ["doc_id", "line"], "left_semi")
    x = back.select("doc_id", "line", "tier", F.explode("forms").alias("x"))
    return x.select("doc_id", "line", "tier", "x.text", "x.start_ms", F.col("x.morphology")[0]["pos"].alias("pos"), F.col("x.morphology")[0]["lemma"].alias("lemma"), F.col("x.dependency")[0]["id"].cast("bigint").alias("id"), F.col("x.dependency")[0]["dep_type"].alias("dep"))


@query("WITH $FORMS," + _RETRACE.replace("$N", "m // 2") + r""", k2 AS (SELECT f.doc_id, f.line_no, CASE WHEN marked.form_no IS NULL THEN f.type ELSE 1 END AS type, f.text FROM f LEFT JOIN marked USING (doc_id, line_no, form_no)),
odd AS (SELECT DISTINCT doc_id, line_no FROM k2 WHERE NOT regexp_matches(text, '^[\p{L}\p{N}]+$') AND (type = 1 OR text NOT IN ('.', '?', '!')) OR regexp_matches(text, '^0.'))
SELECT doc_id, line_no, type, count(*) AS n FROM k2 WHERE NOT EXISTS (SELECT 1 FROM odd WHERE odd.doc_id = k2.doc_id AND odd.line_no = k2.line_no) GROUP BY doc_id, line_no, type""")
def retraces_written(spark, d):
    """Lines whose retraces are marked, written with ``[/]`` and read again: each word has its type as before."""
    f = sequence.marked_retraces(_forms(spark, d))
    whole = _forms(spark, d).join(f.select("doc_id", "line_no", "form_no", F.col("type").alias("new")), ["doc_id", "line_no", "form_no"])
    odd = (~F.col("text").rlike(r"^[\p{L}\p{N}]+$") & ((F.col("new") == 1) | ~F.col("text").isin(".", "?", "!"))) | F.col("text").rlike("^0.")
    kept = whole.groupBy("doc_id", "line_no").agg(F.max(odd).alias("odd"), F.transform(F.array_sort(F.collect_list(F.struct("form_no", "text", F.col("new").alias("type")))), lambda x: F.struct(x["text"].alias("text"), x["type"].alias("type"))).alias("forms")).where("NOT odd")
    written = kept.select("doc_id", "line_no", documents.detokenized(F.col("forms"), F.lit(None), F.lit(None)).alias("line"))
    read = written.select("doc_id", "line_no", F.explode(chat.lexed("line")["forms"]).alias("x"))
    return read.groupBy("doc_id", "line_no", F.col("x.type").alias("type")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH $FORMS SELECT doc_id, line_no, tier || ': ' || string_agg(text, ' ' ORDER BY form_no) AS line FROM f WHERE type IN (0, 5) GROUP BY doc_id, line_no, tier""")
def transcript_stripped(spark, d):
    _, lines = _documents(spark, d)
    return documents.transcript(lines, include_tiers=True, strip=True)


@query("SELECT conv_id AS doc_id, turn AS line_no, role AS tier, text, turn * 10 AS start_ms, turn * 10 + 9 AS end_ms FROM conversations")
def json_documents(spark, d):
    """Conversations as JSON documents, read to the schema of transcripts."""
    u = tables.utterances(spark, d)
    one = F.struct("line_no", F.struct(F.struct(F.col("tier").alias("id")).alias("tier"), "text", F.array(F.col("line_no") * 10, F.col("line_no") * 10 + 9).alias("time")).alias("u"))
    docs = u.groupBy("doc_id").agg(F.array_sort(F.collect_list(one)).alias("x"))
    # the line's number stands in its time: places in the list are not turns where turns are missing
    text = F.to_json(F.struct(F.array(F.lit("eng")).alias("langs"), F.transform("x", lambda v: v["u"]).alias("content")))
    read = lexicons.json_lines(lexicons.json_documents(docs.select("doc_id", text.alias("text"))))
    return read.select("doc_id", (F.col("start_ms") / 10).cast("bigint").alias("line_no"), "tier", "text", "start_ms", "end_ms")


# --- recognised speech -----------------------------------------------------------------------------------------------

_DIGITS = [(str(k), w) for k, w in enumerate("zero one two three four five six seven eight nine".split())]


def _spell(x: str) -> str:
    for k, w in reversed(_DIGITS):
        x = f"replace({x}, '{k}', '{w}')"
    return x


@query(f"""WITH $FORMS, n AS (SELECT doc_id, line_no, form_no, form_no // 300 AS chunk, CASE WHEN regexp_full_match(text, '[0-9]+') THEN {_spell("text")} ELSE text END AS text FROM f),
e AS (SELECT *, coalesce(sum(CASE WHEN text IN ('.', '?', '!') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, line_no, chunk ORDER BY form_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS utt FROM n),
l AS (SELECT doc_id, line_no, chunk, utt, list(text ORDER BY form_no) AS x FROM e GROUP BY doc_id, line_no, chunk, utt),
w AS (SELECT doc_id, line_no, chunk, utt, CASE WHEN x[-1] IN ('.', '?', '!') THEN x WHEN x[-1] = ',' THEN list_append(x[:-2], '.') ELSE list_append(x, '.') END AS x FROM l)
SELECT doc_id, line_no AS turn_no, CAST(chunk AS BIGINT) AS chunk, CAST(utt AS BIGINT) AS utt, array_to_string(x, ' ') AS text FROM w""")
def asr_utterances(spark, d):
    """Turns as a recogniser's elements, through the whole chain to utterances; numerals of a language that has no rule are
    spelled by a table of digits."""
    f = _forms(spark, d)
    heard = f.select("doc_id", F.col("line_no").alias("turn_no"), F.col("form_no").alias("elem_no"), F.lit(0).alias("speaker"), F.col("text").alias("value"), F.col("form_no").cast("double").alias("ts"), (F.col("form_no") + 1).cast("double").alias("end_ts"))
    said = asr.process(heard, lang="xxx", table=_DIGITS)
    return said.groupBy("doc_id", "turn_no", "chunk", "utt").agg(_joined("form_no", "text").alias("text"))


@query("""WITH $TIMED, s AS (SELECT doc_id, start_ms, tier FROM t WHERE item_no % 3 = 0), w AS (SELECT *, (SELECT count(*) FROM s WHERE s.doc_id = t.doc_id) AS any_of FROM t WHERE item_no % 3 <> 0 AND end_ms > start_ms),
b AS (SELECT w.doc_id, w.item_no, w.start_ms, coalesce(max_by(s.tier, (s.start_ms, s.tier)) FILTER (s.start_ms <= w.start_ms), (SELECT min_by(x.tier, (x.start_ms, x.tier)) FROM s x WHERE x.doc_id = w.doc_id)) AS speaker FROM w LEFT JOIN s ON s.doc_id = w.doc_id WHERE any_of > 0 GROUP BY w.doc_id, w.item_no, w.start_ms)
SELECT doc_id, count(*) AS words, count(DISTINCT speaker) AS speakers FROM b GROUP BY doc_id""")
def swept_turns(spark, d):
    """Words dealt to the speakers' segments that began before them."""
    t = tables.timed(spark, d)
    segments = t.where("item_no % 3 = 0").groupBy("doc_id", "start_ms").agg(F.max("tier").alias("speaker"))
    words = t.where("item_no % 3 <> 0").select("doc_id", F.col("item_no").alias("word_no"), F.lit("w").alias("word"), "start_ms", "end_ms")
    return asr.swept(words, segments).where("speaker IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("words"), F.countDistinct("speaker").alias("speakers"))


@query("WITH $TIMED SELECT doc_id, item_no, start_ms, end_ms, start_ms // 60000 AS \"window\", start_ms % 60000 AS inside FROM t")
def windowed_times(spark, d):
    """Items as a recogniser with windows of a minute sees them, and on the recording's clock again."""
    w = asr.in_windows(tables.timed(spark, d)).withColumn("inside", F.col("start_ms"))
    return asr.from_windows(w).select("doc_id", "item_no", "start_ms", "end_ms", "window", "inside")


@query("""WITH $TIMED, c AS (SELECT *, 'item ' || item_no AS text FROM t), o AS (SELECT *, CASE WHEN lag(tier) OVER w <> tier THEN 1 ELSE 0 END AS ch FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY start_ms, end_ms, tier, text)),
i AS (SELECT *, sum(ch) OVER (PARTITION BY doc_id ORDER BY start_ms, end_ms, tier, text ROWS UNBOUNDED PRECEDING) AS turn FROM o)
SELECT doc_id, CAST(turn AS BIGINT) AS turn, min(tier) AS tier, min(start_ms) AS start_ms, max(end_ms) AS end_ms, CAST(count(*) AS INTEGER) AS n FROM i GROUP BY doc_id, turn""")
def textgrid_turns(spark, d):
    """Words of all tiers of TextGrid files as speakers' turns."""
    t = tables.timed(spark, d).select("doc_id", "tier", "start_ms", "end_ms", F.concat(F.lit("item "), F.col("item_no").cast("string")).alias("text"))
    return textgrid.turns(textgrid.intervals(textgrid.documents(t))).drop("words")


@query("""WITH $TIMED, p AS (SELECT *, coalesce(lag(end_ms) OVER (PARTITION BY doc_id ORDER BY start_ms, item_no), 0) AS before FROM t)
SELECT doc_id, item_no, CASE WHEN end_ms > greatest(start_ms, before) THEN greatest(start_ms, before) END AS line_start, CASE WHEN end_ms > greatest(start_ms, before) AND item_no % 5 <> 0 THEN start_ms END AS word_start FROM p""")
def cleared_times(spark, d):
    """Items as lines of one word each: what overlaps is moved or loses its times, with the words; every fifth word ends
    before it begins."""
    t = tables.timed(spark, d).select("doc_id", "item_no", "start_ms", "end_ms")
    words = t.select("doc_id", F.col("item_no").alias("line_no"), F.lit(0).alias("form_no"), "start_ms", F.when(F.col("item_no") % 5 == 0, F.col("start_ms") - 1).otherwise(F.col("end_ms")).alias("end_ms"))
    lines, words = sequence.cleared_times(t, words)
    both = lines.select("doc_id", "item_no", F.col("start_ms").alias("line_start")).join(words.select("doc_id", F.col("line_no").alias("item_no"), F.col("start_ms").alias("word_start")), ["doc_id", "item_no"])
    return both


@query("""WITH $FORMS SELECT doc_id, line_no, form_no, CASE WHEN lower(text) = 'cuz' THEN 'because' WHEN lower(text) = 'the' THEN 'thee' WHEN lower(text) IN ('um', 'ur', 'uh', 'is') THEN lower(text) ELSE text END AS text, CASE WHEN lower(text) IN ('um', 'ur', 'uh', 'is') THEN 3 WHEN lower(text) = 'the' THEN 0 ELSE type END AS type FROM f""")
def disfluencies(spark, d):
    """Filled pauses marked, then replacements; ``is`` counts as a pause here and ``the`` as said for ``thee``."""
    schema = "original string, main string, lemma string"
    pauses = spark.createDataFrame([("um", "&-um", "um"), ("ur", "&-ur", "ur"), ("uh", "&-uh", "uh"), ("is", "&-is", "is")], schema)
    words = spark.createDataFrame([("cuz", "(be)cause", "because"), ("the", "the", "thee")], schema)
    return files.disfluencies(_forms(spark, d), pauses, words).select("doc_id", "line_no", "form_no", "text", "type")


# --- transfers -------------------------------------------------------------------------------------------------------


@query("WITH $FORMS SELECT doc_id, line_no, form_no, f.text, line_no * 1000 + form_no * 40 AS start_ms, line_no * 1000 + form_no * 40 + 30 AS end_ms FROM f WHERE type = 0")
def forced_times(spark, d):
    """Times of an aligner's pieces, two to a word, carried over to the words by their characters."""
    f = _words(spark, d).select("doc_id", F.col("line_no").alias("group"), (F.col("line_no") * 1000).alias("base_ms"), "line_no", "form_no", "text")
    half = F.ceil(F.length("text") / 2)
    parts = F.array(F.struct(F.lit(0).alias("k"), F.substring("text", F.lit(1), half).alias("piece")), F.struct(F.lit(1).alias("k"), F.substring("text", half + 1, F.length("text")).alias("piece")))
    at = F.col("form_no") * 0.04
    pieces = f.select("doc_id", "group", "form_no", F.explode(parts).alias("x")).select("doc_id", "group", (F.col("form_no") * 2 + F.col("x.k")).alias("piece_no"), "x.piece", at.alias("ts"), (at + 0.03).alias("end_ts")).where("piece <> ''")
    return transfer.forced_alignment(f, pieces).select("doc_id", "line_no", "form_no", "text", "start_ms", "end_ms")


@query("""WITH $FORMS SELECT doc_id, count(*) AS forms, CAST(count(*) FILTER (form_no % 2 = 0) AS BIGINT) AS timed, true AS ordered FROM f WHERE type = 0 GROUP BY doc_id""")
def timing_counts(spark, d):
    """What every best alignment of ``timing_transfer`` has in common: each recognised word gives its time to one form, and
    the forms' times come in order."""
    from colloquy.plans.catalog import QUERIES

    from pyspark.sql import Window

    t = QUERIES["timing_transfer"](spark, d)
    before = F.last("start_ms", ignorenulls=True).over(Window.partitionBy("doc_id").orderBy("line_no", "form_no").rowsBetween(Window.unboundedPreceding, -1))
    return t.withColumn("before", before).groupBy("doc_id").agg(F.count(F.lit(1)).alias("forms"), F.count("start_ms").alias("timed"), F.bool_and(F.coalesce(F.col("start_ms") >= F.col("before"), F.lit(True))).alias("ordered"))


@query("""WITH $FORMS SELECT doc_id, line_no, count(*) AS gold, string_agg(lower(text), ' ' ORDER BY form_no) AS words FROM f WHERE type = 0 GROUP BY doc_id, line_no""")
def compare_gold(spark, d):
    """What a comparison keeps whatever it finds: the gold's words, each once, in their order."""
    from colloquy.plans.catalog import QUERIES

    t = QUERIES["transcript_compare"](spark, d).where("status <> 'extra_main'")
    return t.groupBy("doc_id", "line_no").agg(F.count(F.lit(1)).alias("gold"), _joined("place", "text").alias("words"))


@query("""WITH $FORMS, w AS (SELECT doc_id, count(*) AS n FROM f WHERE type = 0 GROUP BY doc_id) SELECT doc_id, n AS matches, CAST(0 AS BIGINT) AS insertions, CAST(0 AS BIGINT) AS deletions, n AS total, CAST(0 AS DOUBLE) AS wer, CAST(1 AS DOUBLE) AS accuracy FROM w""")
def compare_itself(spark, d):
    """A transcript compared with itself, line by line, by the whole chain from window search to metrics."""
    f = _words(spark, d).select("doc_id", "line_no", "form_no", F.lower("text").alias("text"), F.lit("X").alias("pos"))
    return metrics.compare(comparison.compare(f, f.select(*[F.col(c).alias(c) for c in f.columns])), "doc_id")


# --- numbers, keys ---------------------------------------------------------------------------------------------------

_GROUP = """CASE WHEN {g} = 0 THEN '' ELSE regexp_replace(regexp_replace(
 CASE WHEN {g} // 1000 > 0 THEN substr('零一二三四五六七八九', {g} // 1000 + 1, 1) || '千' ELSE '' END ||
 CASE WHEN {g} // 100 % 10 > 0 THEN substr('零一二三四五六七八九', {g} // 100 % 10 + 1, 1) || '百' WHEN {g} >= 1000 THEN '零' ELSE '' END ||
 CASE WHEN {g} // 10 % 10 > 0 THEN substr('零一二三四五六七八九', {g} // 10 % 10 + 1, 1) || '十' WHEN {g} >= 100 THEN '零' ELSE '' END ||
 CASE WHEN {g} % 10 > 0 THEN substr('零一二三四五六七八九', {g} % 10 + 1, 1) ELSE '' END, '零+', '零', 'g'), '零$', '') END"""


@query(f"""WITH k AS (SELECT DISTINCT doc_id * 977 % 100000000 AS n FROM documents WHERE doc_id > 0), g AS (SELECT n, n // 10000 AS hi, n % 10000 AS lo FROM k),
s AS (SELECT n, CASE WHEN hi > 0 THEN {_GROUP.format(g="hi")} || '万' ELSE '' END || CASE WHEN hi > 0 AND lo > 0 AND (lo < 1000 OR hi % 10 = 0) THEN '零' ELSE '' END || {_GROUP.format(g="lo")} AS t FROM g)
SELECT n, CASE WHEN n = 0 THEN '零' WHEN t LIKE '一十%' THEN substr(t, 2) ELSE t END AS spelled FROM s""")
def chinese_keys(spark, d):
    """Numbers of up to eight digits in Chinese."""
    n = tables.table(spark, d, "documents").where("doc_id > 0").select((F.col("doc_id") * 977 % 100_000_000).alias("n")).distinct()
    return n.select("n", numbers.chinese_numbers(F.col("n").cast("string")).alias("spelled"))


@query("SELECT doc_id, sha256(text || '|' || lang) AS split_key, sha256(sha256(source) || '|' || text || '|' || CASE WHEN doc_id % 2 = 0 THEN '1' ELSE '0' END) AS alignment_key FROM documents")
def cache_keys(spark, d):
    """Keys of a line's split and of a group's alignment."""
    t = tables.table(spark, d, "documents")
    return t.select("doc_id", cache.split_key(F.col("text"), F.col("lang")).alias("split_key"), cache.alignment_key(F.col("text"), F.sha2("source", 256), F.col("doc_id") % 2 == 0).alias("alignment_key"))


@query("WITH $FORMS SELECT doc_id, line_no, form_no, text, CASE WHEN line_no % 3 = 0 THEN NULL ELSE lower(text) END AS lemma FROM f")
def cache_tags(spark, d):
    """Tags of lines as cache entries, and back on lines; every third line's entry is for another number of forms."""
    _, lines = _documents(spark, d)
    data = cache.tags_data(F.when(F.col("line_no") % 3 == 0, F.concat("forms", "forms")).otherwise(F.col("forms")), F.lit("x"), F.lit(False))
    bare = F.transform("forms", lambda x: x.withField("morphology", F.lit(None).cast("array<struct<lemma:string,pos:string,feats:string>>")).withField("dependency", F.lit(None).cast("array<struct<id:int,dep_id:int,dep_type:string>>")))
    back = cache.tagged(lines.withColumns({"data": data, "forms": bare, "text": F.lit("x")}))
    x = back.select("doc_id", "line_no", F.posexplode("forms").alias("form_no", "x"))
    return x.select("doc_id", "line_no", F.col("form_no").cast("bigint").alias("form_no"), "x.text", F.lower(F.col("x.morphology")[0]["lemma"]).alias("lemma"))


@query("SELECT DISTINCT lang, CASE lang WHEN 'en' THEN 'en' WHEN 'fr' THEN 'fr' WHEN 'de' THEN 'de' WHEN 'es' THEN 'es' END AS tagger FROM documents")
def tagger_languages(spark, d):
    t = tables.table(spark, d, "documents").select("lang").distinct()
    return t.select("lang", T.tagger_language(T.long_language(F.col("lang"))).alias("tagger"))
