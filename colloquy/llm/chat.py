"""Operator 6: chat formatting.

Method: prefix-target expansion.  Every assistant turn becomes an example of its own: all turns before it are context,
and its text alone is trainable.  What follows the last assistant turn, or a conversation without one, becomes a last
example without any trainable text, so that no turn is lost.

A turn is written as ``<|im_start|>role``, a line feed, the text, ``<|im_end|>`` and a line feed.  Inside roles and
texts a backslash is doubled, and each control string is broken by ``\\.`` after its first character; in roles a line
feed becomes ``\\n``.  Reading back undoes this exactly.

Null texts and roles count as empty, long texts are written whole.  Turns are ordered by (turn, role, text), a null turn
first; equal turns stay, each as a turn.  Rows without a conv_id form one conversation.  An empty table has no examples,
and none are read back.  Columns other than conv_id, turn, role and text are not read, whatever their names.  An example repeats what came before it, so a conversation's output grows with
the square of its turns, as the method wants; one conversation is a single row of Spark's, as its last example is.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

BEGIN, END = "<|im_start|>", "<|im_end|>"
#: Strings that models' templates give a meaning: none of them stands unbroken inside a written text.
CONTROL = (BEGIN, END, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_ANY = "|".join(re.escape(c) for c in CONTROL)


def escaped(c: Column, role: bool = False) -> Column:
    c = F.regexp_replace(F.coalesce(c, F.lit("")), r"\\", r"\\\\")
    c = F.regexp_replace(c, f"(?=(?:{_ANY}))(.)", r"$1\\.")
    return F.regexp_replace(c, "\n", r"\\n") if role else c


def unescaped(c: Column) -> Column:
    """Undo :func:`escaped`: after each doubled backslash is taken out, every other one is an escape."""
    return F.array_join(F.transform(F.split(c, r"\\\\", -1), lambda p: F.replace(F.replace(p, F.lit(r"\n"), F.lit("\n")), F.lit(r"\."), F.lit(""))), "\\")


def expand(conversations: DataFrame) -> DataFrame:
    """``conv_id, example, n_turns, target_turn, text, loss_start, loss_end``: examples in order; the trainable part is
    the code points from loss_start up to loss_end of ``text`` (both null in an example without any)."""
    turns = conversations.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    whole = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    heads = F.transform("t", lambda x: F.concat(F.lit(BEGIN), escaped(x["role"], True), F.lit("\n")))
    whole = whole.withColumns({"head": heads, "body": F.transform("t", lambda x: escaped(x["text"]))})
    whole = whole.withColumn("written", F.transform(F.arrays_zip("head", "body"), lambda x: F.concat(x["head"], x["body"], F.lit(f"{END}\n"))))
    at = F.filter(F.transform("t", lambda x, k: F.when(x["role"] == "assistant", k + 1)), lambda k: k.isNotNull())
    whole = whole.withColumn("at", at)
    whole = whole.withColumn("at", F.when(F.coalesce(F.array_max("at"), F.lit(0)) < F.size("t"), F.concat("at", F.array(F.size("t")))).otherwise(F.col("at")))
    each = whole.select("conv_id", "t", "head", "body", "written", F.posexplode("at").alias("example", "n_turns"))
    before = F.coalesce(F.length(F.array_join(F.slice("written", 1, F.col("n_turns") - 1), "")), F.lit(0)) + F.length(F.element_at("head", F.col("n_turns")))
    target = F.element_at("t", F.col("n_turns"))
    trained = target["role"] == "assistant"
    return each.select(
        "conv_id",
        "example",
        "n_turns",
        F.when(trained, target["turn"]).alias("target_turn"),
        F.array_join(F.slice("written", 1, F.col("n_turns")), "").alias("text"),
        F.when(trained, before).alias("loss_start"),
        F.when(trained, before + F.length(F.element_at("body", F.col("n_turns")))).alias("loss_end"),
    )


def read_back(examples: DataFrame) -> DataFrame:
    """``conv_id, turns, loss, formatted_chars`` per conversation, from the written examples alone: its turns (role,
    text) and the trainable texts in order, unescaped."""
    loss = F.when(F.col("loss_start").isNotNull(), unescaped(F.col("text").substr(F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start"))))
    each = examples.select("conv_id", "example", "n_turns", "text", F.struct("example", loss.alias("loss")).alias("loss"), F.length("text").cast("bigint").alias("chars"))
    whole = each.groupBy("conv_id").agg(F.max_by("text", "n_turns").alias("text"), F.array_sort(F.collect_list("loss")).alias("loss"), F.sum("chars").alias("formatted_chars"))
    pieces = F.split("text", re.escape(BEGIN), -1)
    pieces = F.slice(pieces, 2, F.size(pieces) - 1)

    def turn(x: Column) -> Column:
        head = F.instr(x, "\n")
        return F.struct(unescaped(x.substr(F.lit(1), head - 1)).alias("role"), unescaped(x.substr(head + 1, F.length(x) - head - len(END) - 1)).alias("text"))

    return whole.select("conv_id", F.transform(pieces, turn).alias("turns"), F.transform("loss", lambda x: F.coalesce(x["loss"], F.lit(""))).alias("loss"), "formatted_chars")


#: The conversation that the query adds.
OWN = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -7, formatted and read back."""
    own = spark.createDataFrame(OWN, "conv_id bigint, turn bigint, role string, text string")
    back = read_back(expand(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").unionByName(own)))
    loss = F.array_join("loss", "")
    return back.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length(loss).cast("bigint").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        "formatted_chars",
    )


def _sql_size(c: str) -> str:
    return f"length({c}) + length({c}) - length(replace({c}, '\\', '')) + 2 * len(regexp_extract_all({c}, '{_ANY}'))"


OP6_SQL = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
s AS (SELECT *, {len(BEGIN) + len(END) + 2} + {_sql_size("role")} + length(role) - length(replace(role, chr(10), '')) + {_sql_size("text")} AS size,
             row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS n FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
e AS (SELECT *, sum(size) OVER (PARTITION BY conv_id ORDER BY k) AS upto FROM s)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
       CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY k), '')) AS loss_sha256,
       CAST(sum(CASE WHEN role = 'assistant' OR k = n THEN upto ELSE 0 END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
