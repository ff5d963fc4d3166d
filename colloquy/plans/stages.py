"""Stages and their order: a stage turns a DataFrame into another; a plan is one generator, processors in the order of
their tasks, one analyzer.  Model inference plugs in as a callable on Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

# Tasks in the order of execution, and what kind each is.
TASKS = ["asr", "utterance_segmentation", "speaker", "utr", "fa", "word_segmentation", "disfluency", "retrace", "morphosyntax", "coref", "translate", "feature_extract", "wer", "compare", "compare_report"]
GENERATORS, ANALYZERS = {"asr"}, {"feature_extract", "wer", "compare_report"}
#: Tasks that bring others along.
IMPLIED = {"asr": ["disfluency", "retrace"], "fa": ["utr"]}


@dataclass(frozen=True)
class Stage:
    task: str
    run: Callable[[DataFrame], DataFrame]
    options: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.task not in TASKS:
            raise ValueError(f"unknown task: {self.task}")


@dataclass
class Plan:
    """Checked and ordered stages; lazy: nothing runs before the result is written."""

    stages: list[Stage]

    def __post_init__(self) -> None:
        tasks = [s.task for s in self.stages]
        if again := {t for t in tasks if tasks.count(t) > 1}:
            raise ValueError(f"more than one stage for {sorted(again)}")
        for kind, name in ((GENERATORS, "generator"), (ANALYZERS, "analyzer")):
            if sum(t in kind for t in tasks) > 1:
                raise ValueError(f"more than one {name}")
        place = lambda s: (s.task in ANALYZERS, s.task not in GENERATORS, TASKS.index(s.task))
        self.stages = sorted(self.stages, key=place)

    def __call__(self, df: DataFrame) -> DataFrame:
        for s in self.stages:
            df = s.run(df)
        return df


def expand(names: Iterable[str]) -> list[str]:
    """Task names with those they imply, each once, in the order of execution."""
    asked = {n.strip() for n in names}
    if unknown := asked - {*TASKS}:
        raise ValueError(f"unknown tasks: {sorted(unknown)}")
    for n in list(asked):
        asked.update(IMPLIED.get(n, []))
    return sorted(asked, key=TASKS.index)


def infer(df: DataFrame, schema: str, load: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]]) -> DataFrame:
    """Apply a model: ``load`` runs once per task and returns the function for Arrow batches.

    The contract of all model-backed operators (recognition, alignment, diarization, tagging, translation, acoustic
    features): rows in, rows of ``schema`` out, in columns of these names; numbers are cast to its types.  No model is
    part of this package.
    """
    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        model = load()
        for b in batches:
            out = model(b)
            yield from pa.table({f.name: out.column(f.name).cast(f.type) for f in target}, schema=target).to_batches()

    return df.mapInArrow(run, schema)
