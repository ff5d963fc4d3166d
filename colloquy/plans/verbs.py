"""Verbs, the packages behind tasks, and settings: which stages a command runs, and with which engines."""

from __future__ import annotations

import configparser
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame

# The engine that a task's short name stands for unless something else is asked for.
PACKAGES = {
    "asr": "whisper_oai", "utr": "whisper_utr", "fa": "whisper_fa", "segment": "cantonese_seg", "speaker": "pyannote", "morphosyntax": "stanza", "disfluency": "replacement",
    "retracing": "ngram", "eval": "evaluation", "utterance": "stanza_utt", "coref": "stanza_coref", "translate": "gtrans", "opensmile": "opensmile_egemaps", "compare": "compare_engine",
    "compare_analysis": "compare_analysis_engine",
}
# The tasks that a command runs.
VERBS = {
    "align": "fa", "transcribe": "asr", "transcribe_s": "asr,speaker", "morphotag": "morphosyntax", "benchmark": "asr,eval", "utseg": "utterance", "coref": "coref", "translate": "translate",
    "opensmile": "opensmile", "compare": "compare,compare_analysis", "segment": "segment",
}
# Languages whose recognised speech a parser splits into utterances.
SPLIT_LANGUAGES = ["cho", "eng", "ind", "ita", "jpn", "por", "spa", "tur", "vie"]
#: Languages for which a model of utterance boundaries is at hand, so that recognition splits by itself.
BOUNDARY_MODELS: frozenset[str] = frozenset()
#: By language, packages that differ from the default ones.
BY_LANGUAGE: dict[str, dict[str, str]] = {"eng": {}}


def packages(tasks: str, lang: str, *, config: Mapping[str, Mapping[str, str]] | None = None, boundary_models: frozenset[str] = BOUNDARY_MODELS, **overrides: str) -> list[tuple[str, str]]:
    """(task, engine) of a comma-separated list of tasks, with the ones they bring along.

    Recognition brings the replacement of disfluencies and retraces, and the splitting of utterances for languages that
    have a parser but no boundary model; forced alignment brings the recovery of utterances' times, and for Cantonese the
    segmentation of words.  An engine named in ``overrides`` wins over the settings' (section task, key engine), over the
    language's, over the default.  A task without any engine is an error."""
    names = [n.strip() for n in tasks.split(",")]

    def bring(*others: str) -> None:
        names.extend(o for o in others if o not in names)

    if "asr" in names:
        bring("disfluency", "retracing")
        if lang in SPLIT_LANGUAGES and lang not in boundary_models:
            bring("utterance")
    if "fa" in names:
        bring("utr")
        if lang == "yue":
            bring("segment")
    out = []
    for n in names:
        engine = overrides.get(n) or (config or {}).get(n, {}).get("engine") or BY_LANGUAGE.get(lang, {}).get(n) or PACKAGES.get(n)
        if engine is None:
            raise ValueError(f"no package for the task {n!r}")
        out.append((n, engine))
    return out


@dataclass
class Registry:
    """Engines by name: each makes a function of DataFrames."""

    engines: dict[str, Callable[..., Callable[[DataFrame], DataFrame]]] = field(default_factory=dict)

    def add(self, name: str):
        def put(make):
            self.engines[name] = make
            return make

        return put

    def plan(self, tasks: str, lang: str, **options):
        """The checked and ordered plan of a list of tasks (see :class:`colloquy.plans.stages.Plan`)."""
        from colloquy.plans.stages import Plan, Stage

        stages = []
        for task, engine in packages(tasks, lang, **options):
            if engine not in self.engines:
                raise ValueError(f"the engine {engine!r} of the task {task!r} is not registered")
            stages.append(Stage(STAGE_OF.get(task, task), self.engines[engine](lang=lang)))
        return Plan(stages)

    def run(self, verb: str, df: DataFrame, lang: str, **options) -> DataFrame:
        """A command's plan over ``df``."""
        if verb not in VERBS:
            raise ValueError(f"unknown verb: {verb}")
        return self.plan(VERBS[verb], lang, **options)(df)


# The kind of stage that a task's short name stands for.
STAGE_OF = {"segment": "word_segmentation", "utterance": "utterance_segmentation", "retracing": "retrace", "eval": "wer", "opensmile": "feature_extract", "compare_analysis": "compare_report"}


@dataclass(frozen=True)
class Options:
    """Settings of a run that Spark has its own words for: ``session`` gives them."""

    workers: int | None = None
    memory_guard_mb: int | None = None
    adaptive: bool = True
    pool: bool = True
    cpu_only: bool = False

    def session(self) -> dict[str, str]:
        """Spark settings: cores, executors' memory, the runtime's own re-planning, Python workers that are kept."""
        out = {"spark.sql.adaptive.enabled": str(self.adaptive).lower(), "spark.python.worker.reuse": str(self.pool).lower()}
        if self.workers:
            out |= {"spark.cores.max": str(self.workers), "spark.default.parallelism": str(self.workers)}
        if self.memory_guard_mb:
            out["spark.executor.memory"] = f"{self.memory_guard_mb}m"
        return out


def settings(path: str, model: str | None = None) -> dict[str, dict[str, str]]:
    """The sections of a settings file; with ``model`` that is the recogniser's where the file names none.  A file that
    isn't there is an error: nothing is asked for or made up."""
    if not Path(path).is_file():
        raise FileNotFoundError(f"no settings at {path}")
    parser = configparser.ConfigParser()
    parser.read(path, encoding="utf-8")
    out = {s: dict(parser[s]) for s in parser.sections()}
    if model:
        out.setdefault("asr", {}).setdefault("engine.model", model)
    return out
