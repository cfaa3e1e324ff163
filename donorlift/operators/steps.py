"""Preprocessing steps as a registry.

A step is declared once: its fitted stages, the columns that it drops, the name
under which its table and its model are stored, and hooks that run on the table
before and after it.  A ``Chain`` fits the steps in order on learning data,
storing each step's table and model, and applies the stored models, and nothing
else, to later data.  A step whose table is there already is not computed again.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import DataFrame, SparkSession

from donorlift.sources.files import StageStore

Hook = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Step:
    """A named step.  ``stages`` are pyspark.ml estimators or transformers;
    ``before`` and ``after`` are row-preserving or row-changing table functions
    without anything learned; ``drop`` is applied last and skips absent columns."""

    name: str
    stages: Sequence = ()
    drop: Sequence[str] = ()
    before: Hook | None = None
    after: Hook | None = None
    file: str | None = None
    #: types that columns must have when the step is done, as in a schema
    types: dict[str, str] = field(default_factory=dict)

    @property
    def stored_as(self) -> str:
        return self.file or self.name


class Chain:
    """Steps in order, over one folder of tables and models."""

    RAW = "raw"

    def __init__(self, spark: SparkSession, root: str, steps: Sequence[Step]):
        files = [self.RAW, *[s.stored_as for s in steps]]
        if len(set(files)) < len(files):
            raise ValueError(f"two steps have one name: {', '.join(files)}")
        self.spark, self.root, self.steps = spark, root.rstrip("/"), list(steps)
        self.names = files

    def model_path(self, step: Step) -> str:
        return f"{self.root}/models/{step.stored_as}"

    def _done(self, step: Step, model: PipelineModel, rows: DataFrame) -> DataFrame:
        out = model.transform(rows)
        if step.after:
            out = step.after(out)
        out = out.drop(*step.drop)
        got = dict(out.dtypes)
        wrong = {c: (t, got.get(c)) for c, t in step.types.items() if got.get(c) != t}
        if wrong:
            raise TypeError(f"step {step.name}: wanted and found types {wrong}")
        return out

    def _provide(self, part: str, raw: Callable[[], DataFrame], step_of: Callable[[Step, DataFrame], DataFrame]) -> DataFrame:
        build = {self.RAW: lambda _: raw()} | {s.stored_as: (lambda prev, s=s: step_of(s, s.before(prev) if s.before else prev)) for s in self.steps}
        return StageStore(self.spark, f"{self.root}/{part}").provide(self.names[-1], self.names, build)

    def learn(self, raw: Callable[[], DataFrame], part: str = "learning") -> DataFrame:
        """Fit every step on the one before, store models and tables."""

        def fit(step: Step, rows: DataFrame) -> DataFrame:
            Pipeline(stages=list(step.stages)).fit(rows).write().overwrite().save(self.model_path(step))
            return self._done(step, PipelineModel.load(self.model_path(step)), rows)

        return self._provide(part, raw, fit)

    def apply(self, raw: Callable[[], DataFrame], part: str) -> DataFrame:
        """The stored models on other data; tables under ``part``."""
        return self._provide(part, raw, lambda step, rows: self._done(step, PipelineModel.load(self.model_path(step)), rows))
