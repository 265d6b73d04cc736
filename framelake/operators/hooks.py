"""Where a user's own code joins in: routines, stages and models over DataFrames."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

#: A stage's name to what it does with its input.
Routine = Callable[[DataFrame], "DataFrame | Result"]


class Result(NamedTuple):
    """What a routine may give besides its output: aggregates of it by name, and other tables by name."""

    outputs: DataFrame
    metrics: dict[str, Column] = {}
    artifacts: dict[str, DataFrame] = {}


class Stages:
    """Routines by stage name; a stage has one."""

    def __init__(self) -> None:
        self.routines: dict[str, Routine] = {}

    def register(self, stage: str) -> Callable[[Routine], Routine]:
        def add(routine: Routine) -> Routine:
            if stage in self.routines:
                raise ValueError(f"stage {stage!r} has a routine already")
            self.routines[stage] = routine
            return routine

        return add

    def run(self, stage: str, df: DataFrame) -> DataFrame:
        if stage not in self.routines:
            raise KeyError(f"no routine for stage {stage!r}")
        made = self.routines[stage](df)
        return made.outputs if isinstance(made, Result) else made

    def run_measured(self, stage: str, df: DataFrame) -> tuple[DataFrame, Observation | None, dict[str, DataFrame]]:
        """The output, its metrics, and the artifacts.

        Metrics are computed by the job that computes the output, and are there once it has run: observation.get.
        """
        if stage not in self.routines:
            raise KeyError(f"no routine for stage {stage!r}")
        made = self.routines[stage](df)
        if not isinstance(made, Result):
            made = Result(made)
        if not made.metrics:
            return made.outputs, None, made.artifacts
        seen = Observation(f"{stage}-{uuid.uuid4().hex}")
        return made.outputs.observe(seen, *[c.alias(n) for n, c in made.metrics.items()]), seen, made.artifacts

    def run_jobs(self, jobs: DataFrame) -> DataFrame:
        """Each registered stage over its own jobs, as one result; jobs of other stages stay out."""
        parts = [self.run(s, jobs.where(F.col("stage") == s)) for s in sorted(self.routines)]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p, allowMissingColumns=True)
        return out


def identity_model(x: np.ndarray) -> np.ndarray:
    """A refinement model that gives the mask it got, its second channel, or the only one."""
    return x[..., -1] if x.ndim == 4 else x


def callable_model(function: Callable[[np.ndarray], np.ndarray]) -> Callable[[np.ndarray], np.ndarray]:
    """A function of one tile as a model of many."""
    return lambda x: np.stack([function(t) for t in x]) if len(x) else x


def classify(rois: DataFrame, model: Callable[[np.ndarray], np.ndarray] | None, labels: list[str], model_id: str, batch: int = 256) -> DataFrame:
    """Scores of each region's features by a model of (regions, features) to (regions, labels).

    Returns detection_id, model_id, label (the likeliest), score and scores, a
    row for each row of rois; without a model it raises NotImplementedError.
    """
    if model is None:
        raise NotImplementedError("no classification model is given")

    @F.pandas_udf("array<double>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            out: list[np.ndarray] = []
            for i in range(0, len(part), batch):
                out.extend(np.asarray(model(np.stack(part.iloc[i : i + batch].to_list())), np.float64))
            yield pd.Series(out, dtype=object)

    x = rois.select("detection_id", run("features").alias("p"))
    top = F.array_position("p", F.array_max("p")).cast("int")
    named = F.map_from_arrays(F.array(*map(F.lit, labels)), F.col("p"))
    return x.select("detection_id", F.lit(model_id).alias("model_id"), F.element_at(F.array(*map(F.lit, labels)), top).alias("label"), F.array_max("p").alias("score"), named.alias("scores"))
