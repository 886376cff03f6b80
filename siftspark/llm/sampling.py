"""A bounded sample of rows, and a model fitted to it in one task.

The sample is the rows with the least hash, so it doesn't depend on how files are split. Hashes below a share of their range that
leaves about twice the rows wanted are kept in the scan, so a task sends only its few; only keys reach the driver. Texts of the
sample go straight to the task that fits the model, and the driver gets the model.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def least_hashed(rows: DataFrame, hash_: Column, key: str, n: int, total: int) -> list[tuple[int, int]]:
    """The ``n`` least (hash, key) of ``total`` rows, each once; all where there are fewer. ``key`` is a long."""
    share = min(1.0, (2 * n + 64) / max(total, 1))
    while True:
        most = -(1 << 63) + int(share * ((1 << 64) - 1))
        held = rows.select(hash_.alias("h"), F.col(key).alias("k"))
        held = (held.where(F.col("h") <= most) if share < 1 else held).distinct()
        found = [(r["h"], r["k"]) for r in held.orderBy("h", "k").limit(n).collect()]
        if len(found) == n or share >= 1:
            return found
        share = min(1.0, share * 8)  # many rows repeat


def fitted(sample: DataFrame, fit: Callable[[list[dict]], Any]) -> Any:
    """What ``fit`` makes of all rows of a bounded sample, computed in one task of the cluster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        for batch in batches:
            rows += batch.to_pylist()
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(rows))], pa.binary())], names=["model"])

    return pickle.loads(sample.repartition(1).mapInArrow(run, "model binary").collect()[0]["model"])
