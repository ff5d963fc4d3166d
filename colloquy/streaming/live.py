"""Structured Streaming forms of operators that keep little state: caching by key, timing repair, windowed counts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def new_keys(rows: DataFrame, key: str, at: str, delay: str) -> DataFrame:
    """Rows whose key was not seen within the watermark: the misses of a cache that the stream itself fills."""
    return rows.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def counts(rows: DataFrame, at: str, width: str, delay: str, *by: str) -> DataFrame:
    """Items per window and group, late ones up to the delay included."""
    return rows.withWatermark(at, delay).groupBy(F.window(at, width), *by).agg(F.count(F.lit(1)).alias("n"))


def repaired(items: DataFrame) -> DataFrame:
    """Timing repair per document across micro-batches: the state is the raw end of the last item.  Items of a document
    are ordered inside a micro-batch; a batch's items come after those of the batches before."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        end = state.get[0] if state.exists else 0
        rows = pd.concat(frames).sort_values(["start_ms", "item_no"], kind="stable")
        previous = rows["end_ms"].shift(fill_value=end)
        rows["new_start"] = rows["start_ms"].where(rows["start_ms"] >= previous, previous)
        rows["ok"] = rows["end_ms"] > rows["new_start"]
        state.update((int(rows["end_ms"].iloc[-1]),))
        yield rows[["doc_id", "item_no", "new_start", "end_ms", "ok"]]

    return items.groupBy("doc_id").applyInPandasWithState(step, "doc_id bigint, item_no bigint, new_start bigint, end_ms bigint, ok boolean", "end_ms bigint", "append", GroupStateTimeout.NoTimeout)
