"""Operator 2: URL filters.

Method: a URL is expanded into every host suffix times every path prefix that a rule could have; the expressions are
joined with the rules on a short hash prefix (the first 4 bytes of SHA-256), and a candidate counts only if the full
digest agrees.  Of the rules that fit, the longest wins; of equally long ones (a rule listed twice with both verdicts)
``block`` wins.  Where no rule fits, the method's own verdict is ``allow``.

A null URL or one without ``://`` has empty host and path, and no rule fits it.  Repeated rows, and rows without id, each
give their own row; an empty table of pages gives an empty table, without rules every URL gets the method's verdict.
Columns other than id and URL are not read, whatever their names.  URLs are taken whole, however long; one gives labels x
(distinct lengths of rule paths) expressions, no more.  A null rule is none; a rule with a null verdict counts as allow.

All of it is DataFrame operations.  Rules whose measured size allows it are broadcast.  Others are joined by their hash
prefix: expressions that very many URLs have (``com/``) then meet in one key, which Spark's skewed-join handling splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from colloquy.llm.shared import hinted

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Hex digits of the digest that the join compares first.
PREFIX = 8
#: The rules of the query: (rule, verdict).
RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]


def lower_ascii(c: Column) -> Column:
    """A-Z in lower case, nothing else changed."""
    return F.translate(c, UPPER, LOWER)


def host_and_path(url: Column) -> tuple[Column, Column]:
    after = F.when(F.instr(url, "://") > 0, url.substr(F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(after, r"^[^/?#]*", 0)
    path = F.regexp_extract(after.substr(F.length(host) + 1, F.length(after) + 1), r"^[^?#]*", 0)
    return lower_ascii(host), path


def filter_urls(pages: DataFrame, rules: DataFrame, *, id_column: str = "page_id", url_column: str = "url", default: str = "allow") -> DataFrame:
    """``page_id, host, path, rule, verdict`` for each row of ``pages``.

    rules: ``rule`` (host, then a path from the first ``/`` on) and ``verdict`` (allow or block).  They are broadcast
    only if measured to be small; the distinct lengths of their paths (a few thousand at most, as URLs go) come to the driver.
    """
    slash = F.instr("rule", "/")
    rules = rules.where("rule IS NOT NULL").select(
        "rule",
        "verdict",
        F.concat(lower_ascii(F.when(slash > 0, F.col("rule").substr(F.lit(1), slash - 1)).otherwise(F.col("rule"))), F.when(slash > 0, F.col("rule").substr(slash, F.length("rule"))).otherwise(F.lit(""))).alias("expression"),
        F.when(slash > 0, F.length("rule") - slash + 1).otherwise(F.lit(0)).alias("path_length"),
    )
    lengths = sorted(r[0] for r in rules.select("path_length").distinct().collect())
    rules = rules.select(F.sha2("expression", 256).alias("rule_digest"), "rule", "verdict", F.length("rule").alias("size")).withColumn("short", F.substring("rule_digest", 1, PREFIX))
    rules = hinted(rules)
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col(id_column).alias("page_id"), F.coalesce(F.col(url_column), F.lit("")).alias("url")).withColumns({"row": F.monotonically_increasing_id(), "host": host, "path": path})
    labels = F.split("host", r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    prefixes = F.array_compact(F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths])) if lengths else F.array().cast("array<string>")
    spelled = F.when(F.col("host") == "", F.array().cast("array<string>")).otherwise(F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.concat(h, p)))))
    asked = rows.select("row", "page_id", "host", "path", F.explode_outer(spelled).alias("expression")).withColumn("digest", F.sha2("expression", 256)).withColumn("short", F.substring("digest", 1, PREFIX))
    fits = F.col("rule_digest") == F.col("digest")
    best = F.max(F.when(fits, F.struct("size", (F.col("verdict") == "block").alias("blocks"), "rule", "verdict"))).alias("best")
    return (
        asked.join(rules, "short", "left")
        .groupBy("row", "page_id", "host", "path")
        .agg(best)
        .select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
    )


def op2_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every URL of ``pages`` under the five rules."""
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), spark.createDataFrame(RULES, "rule string, verdict string"))


OP2_SQL = f"""
WITH rules(rule, verdict) AS (VALUES {", ".join(f"('{r}', '{v}')" for r, v in RULES)}),
r AS (SELECT rule, verdict, split_part(rule, '/', 1) AS rh, substr(rule, position('/' IN rule)) AS rp FROM rules),
a AS (SELECT page_id, row_number() OVER () AS k, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS s FROM pages),
h AS (SELECT page_id, k, s, regexp_extract(s, '^[^/?#]*') AS raw FROM a),
p AS (SELECT page_id, k, translate(raw, '{UPPER}', '{LOWER}') AS host, regexp_extract(substr(s, length(raw) + 1), '^[^?#]*') AS path FROM h),
m AS (SELECT p.*, r.rule, r.verdict, row_number() OVER (PARTITION BY k ORDER BY length(r.rule) DESC NULLS LAST, r.verdict DESC) AS n
      FROM p LEFT JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE n = 1
"""
