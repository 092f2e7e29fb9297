"""Scorers given by the user, run over chunks or over bounded batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType


def score_chunks(chunked: DataFrame, scorer: Callable[[pd.DataFrame], pd.DataFrame], schema: str, priors: tuple[str, ...] = ()) -> DataFrame:
    """Runs ``scorer`` on all rows of each chunk at once, with the columns of ``priors`` if given.

    A chunk holds a fixed number of frames, so it fits a task. Rows come in frame order.
    """
    used = chunked.select("scene", "chunk", "frame", *[c for c in chunked.columns if c.startswith("input_")], *priors)
    return used.groupBy("scene", "chunk").applyInPandas(lambda rows: scorer(rows.sort_values("frame", ignore_index=True)), schema)


def score_batches(df: DataFrame, scorer: Callable[[pd.DataFrame], pd.DataFrame], schema: str, size: int = 64) -> DataFrame:
    """Runs ``scorer`` on at most ``size`` rows at a time; results keep the order of their rows."""
    if size < 1:
        raise ValueError("size must be positive")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), size):
                yield scorer(batch.iloc[at : at + size].reset_index(drop=True))

    return df.mapInPandas(run, schema)


def score_tensors(df: DataFrame, make: Callable[[], Callable], inputs: dict[str, list[int] | None], name: str, kind: DataType, size: int = 64) -> DataFrame:
    """Adds ``name``: what a function that ``make`` builds, once for each worker, says of the columns ``inputs``.

    It gets arrays of at most ``size`` rows, one for each column in order, in the shapes given (None for numbers), and
    returns an array with as many rows. Rows are scored one by one, so no shuffle is needed. A row with a null in one of
    the columns has null and is not scored; a column called ``name`` is replaced.
    """
    if size < 1:
        raise ValueError("size must be positive")
    shapes = list(inputs.values())
    udf = predict_batch_udf(make, return_type=kind, batch_size=size, input_tensor_shapes=shapes if any(s is not None for s in shapes) else None)
    known = F.lit(True)
    for c in inputs:
        known = known & F.col(c).isNotNull()
    df = df.drop(name) if name not in inputs else df
    good, bad = df.where(known), df.where(~known)
    return good.withColumn(name, udf(*[F.col(c) for c in inputs])).unionByName(bad.withColumn(name, F.lit(None).cast(kind)))
