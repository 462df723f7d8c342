"""Blocks of an index and the queries that meet them, streamed through tasks.

Both sides are dealt by a unit: a block of the index with a chunk of the queries. Within a task rows come sorted,
each unit's index rows before its queries, so that a task holds one block of the index and a batch of queries at a
time. How large blocks and chunks are is the caller's; every query meets every row of its group once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Queries that are answered at once.
QUERIES = 4096


def meet(index: DataFrame, queries: DataFrame, unit: list[str], answer: Callable, schema: str, parts: int) -> DataFrame:
    """answer(index rows, query rows) -> iterator of record batches, called with tables of one unit: first with its
    index rows and no queries to get a handle, then for each table of queries with that handle. Both frames have
    the columns of unit; columns that only one has are null in the other's rows. Units without an index row or
    without a query give nothing."""
    rows = index.withColumn("_asks", F.lit(False)).unionByName(queries.withColumn("_asks", F.lit(True)), allowMissingColumns=True)
    rows = rows.repartition(parts, *unit).sortWithinPartitions(*unit, "_asks")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, asked, handle = None, [], [], None
        for batch in batches:
            for key, ask, rows in _runs(batch, unit):
                if key != now:
                    yield from _answered(answer, handle, asked)
                    now, held, asked, handle = key, [], [], None
                if not ask:
                    held.append(rows)
                    continue
                if held:
                    handle, held = answer(pa.Table.from_batches(held), None), []
                if handle is not None:
                    asked.append(rows)
                    if sum(x.num_rows for x in asked) >= QUERIES:
                        yield from _answered(answer, handle, asked)
                        asked = []
        yield from _answered(answer, handle, asked)

    return rows.mapInArrow(task, schema)


def _answered(answer: Callable, handle, asked: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    if handle is not None and asked:
        yield from answer(handle, pa.Table.from_batches(asked))


def _runs(batch: pa.RecordBatch, unit: list[str]) -> Iterator[tuple[tuple, bool, pa.RecordBatch]]:
    """Slices of a sorted batch with one unit and one kind of rows."""
    n = batch.num_rows
    if not n:
        return
    columns = [batch.column(c) for c in (*unit, "_asks")]
    new = None
    for c in columns:
        d = pc.not_equal(c.slice(1), c.slice(0, n - 1)) if n > 1 else pa.array([], pa.bool_())
        new = d if new is None else pc.or_(new, d)
    cuts = [0, *(pc.indices_nonzero(new).to_numpy() + 1).tolist(), n]
    for a, b in zip(cuts, cuts[1:], strict=False):
        *key, ask = (c[a].as_py() for c in columns)
        yield tuple(key), ask, batch.slice(a, b - a)
