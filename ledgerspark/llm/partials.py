"""Sums of fixed size over a whole table: one row per task, added up in two steps in the order of the tasks.

What a task sends does not grow with its rows (sums, Gram matrices). The rows of the tasks meet in at most SLOTS slots first, so
the driver gets SLOTS rows a name at most, however many tasks there were; each slot is added in the order of the tasks, so equal
inputs and partitions give equal bits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLOTS = 32
SCHEMA = "name long, task int, body binary"
_SCHEMA = pa.schema([("name", pa.int64()), ("task", pa.int32()), ("body", pa.binary())])

Table = Iterator[pa.RecordBatch]


def summed(df: DataFrame, add: Callable[[pa.RecordBatch, dict[int, np.ndarray]], None], dtype) -> dict[int, np.ndarray]:
    """Flat arrays of ``dtype`` by name: ``add(batch, sums)`` adds a batch to its task's arrays, and all tasks' arrays are added."""

    def partial(batches: Table) -> Table:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            add(batch, sums)
        task = TaskContext.get().partitionId()
        rows = [{"name": n, "task": task, "body": x.astype(dtype).tobytes()} for n, x in sorted(sums.items())]
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)

    def merged(batches: Table) -> Table:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for row in batch.to_pylist():
                key, body = (row["name"], row["task"] % SLOTS), np.frombuffer(row["body"], dtype=dtype)
                sums[key] = sums[key] + body if key in sums else body
        rows = [{"name": n, "task": s, "body": x.tobytes()} for (n, s), x in sorted(sums.items())]
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)

    slot = F.col("task") % SLOTS
    rows = df.mapInArrow(partial, SCHEMA).repartition(SLOTS, "name", slot).sortWithinPartitions("name", "task")
    out: dict[int, np.ndarray] = {}
    for row in sorted(rows.mapInArrow(merged, SCHEMA).collect(), key=lambda r: (r.name, r.task)):
        body = np.frombuffer(bytes(row.body), dtype=dtype)
        out[row.name] = out[row.name] + body if row.name in out else body
    return out
