"""Connected components of a table of links, as DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from colloquy.llm.shared import forget, hinted, mark_of, rows_of, written


def components(links: DataFrame, rounds: int | None = None) -> DataFrame:
    """``id, component`` for every end of a link but the components' own smallest ids; ``links``: a, b.

    Alternating large and small stars: each round links all of a node's neighbours to their smallest, until a round changes
    nothing.  The number of rounds grows with the logarithm of the longest chain.  Each round's links are written to the
    shared folder, and so are nodes with their least neighbours: where these don't fit a broadcast, the join with them is
    one that Spark can split at nodes with very many links.  With ``rounds`` it ends after so many: then rows of one component may have different labels, but rows
    with one label are of one component.
    """
    e = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
    while rows_of(e) and (rounds is None or rounds > 0):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.join(hinted(least), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large, "large")
        low = written(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = large.join(hinted(low), "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.*")
        before, e = e, written(small.where("u <> v").distinct(), "links")
        forget(before, least, large, low)
        if mark_of(before) == mark_of(e):
            break
        rounds = None if rounds is None else rounds - 1
    if rounds is not None:  # the label of a node that has several
        labels = e.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component"))
        out = written(labels, "labels")
        forget(e)
        return out
    out = e.select(F.col("u").alias("id"), F.col("v").alias("component"))
    out._colloquy = e._colloquy  # noqa: SLF001  a table of the same rows
    return out
