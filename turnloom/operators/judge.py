"""An external judge or model, given as a function of a batch of rows; what fails stays open and is asked again in the next run."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.operators.corpus import pending

Ask = Callable[[list[dict]], list]


def judged(items: DataFrame, key: str, batch: list[str], ask: Ask, result: str, done: DataFrame | None = None, attempts: int = 1, wait_s: float = 0.0) -> DataFrame:
    """(key, result, error): what `ask` says of each row of items, batch by batch.

    ask gets the rows of a batch (columns `batch`, as of corpus.constrained_batches()) as dicts and gives as many results, of the SQL type `result`.
    If it raises or gives another number of them, it is asked again up to `attempts` times, after wait_s, doubled each time; then the batch's results are
    null and error says why. done (key, result): rows of earlier runs; those with a result are not asked again. A batch is held by one task at a time, so
    its size bounds the memory; where it ends does not depend on Arrow's own batches. A lost task asks its batches again.
    """
    todo = pending(items, done, key, "result") if done is not None else items
    rows = todo.repartition(*[F.col(c) for c in batch]).sortWithinPartitions(*batch, key)
    kind = todo.schema[key].dataType.simpleString()

    def answers(held: list[dict]) -> pd.DataFrame:
        error = None
        for k in range(attempts):
            try:
                got = list(ask(held))
                if len(got) != len(held):
                    raise ValueError(f"{len(got)} results for {len(held)} rows")
                return pd.DataFrame({key: [r[key] for r in held], "result": pd.Series(got, dtype=object), "error": None})
            except Exception as e:  # noqa: BLE001  whatever the user's function raises leaves the batch open
                error = f"{type(e).__name__}: {e}"
                if k + 1 < attempts:
                    time.sleep(wait_s * 2**k)
        return pd.DataFrame({key: [r[key] for r in held], "result": None, "error": error})

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, name = [], None
        for part in parts:
            for row in part.to_dict("records"):
                if held and tuple(row[c] for c in batch) != name:
                    yield answers(held)
                    held = []
                name = tuple(row[c] for c in batch)
                held.append(row)
        if held:
            yield answers(held)

    return rows.mapInPandas(run, f"`{key}` {kind}, result {result}, error string")


def resumed(done: DataFrame | None, more: DataFrame, key: str) -> DataFrame:
    """Results of earlier runs and of the last one: those that have one, else the last error."""
    if done is None:
        return more
    every = done.withColumn("__run", F.lit(0)).unionByName(more.withColumn("__run", F.lit(1)))
    best = F.max_by(F.struct("result", "error"), F.struct(F.col("result").isNotNull(), F.col("__run")))
    return every.groupBy(key).agg(best.alias("b")).select(key, "b.result", "b.error")
