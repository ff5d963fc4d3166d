"""Queries of the operators in this subpackage, and the SQL that says the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from colloquy.llm.bpe import op1_bpe
from colloquy.llm.chat import OP6_SQL, op6_chat
from colloquy.llm.decontam import OP8_SQL, op8_decontam
from colloquy.llm.exact import OP3_SQL, op3_exact
from colloquy.llm.jaccard import OP10_SQL, op10_jaccard
from colloquy.llm.lm import op9_lm
from colloquy.llm.quality import op4_quality
from colloquy.llm.substring import OP5_SQL, op5_substring
from colloquy.llm.tokencounts import op7_tokens
from colloquy.llm.urls import OP2_SQL, op2_urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_urls": op2_urls,
    "op3_exact": op3_exact,
    "op4_quality": op4_quality,
    "op5_substring": op5_substring,
    "op6_chat": op6_chat,
    "op7_tokens": op7_tokens,
    "op8_decontam": op8_decontam,
    "op9_lm": op9_lm,
    "op10_jaccard": op10_jaccard,
}

SQL: dict[str, str] = {
    "op2_urls": OP2_SQL,
    "op3_exact": OP3_SQL,
    "op5_substring": OP5_SQL,
    "op6_chat": OP6_SQL,
    "op8_decontam": OP8_SQL,
    "op10_jaccard": OP10_SQL,
}
