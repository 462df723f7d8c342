"""Sharding by minimax contiguous partition.

Rows are ordered by a digest of their text, then id, so that equal texts stand side by side and form
one atomic group; the order needs no join and a hot group may span range partitions. The smallest
capacity for which a greedy pass needs no more than the wanted shards is found by binary search, and
the cuts are made there: each as near to an equal share of what is left as the capacity allows.

The driver never holds the groups. It sees the groups' starts (running sums of sizes) as blocks of
about equal bytes and runs the greedy check twice: cutting at block edges only (surely feasible), and
as if blocks could be cut anywhere (surely a lower bound). Only blocks between these two answers are
read in finer blocks, down to single groups, until both agree: the capacity is exact.

Defined results: null text has 8 bytes and groups with other nulls, apart from empty text; rows with
the same id and text stand in the order of nothing but are each placed; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docaudit.llm.common import partitions, persisted

#: Blocks the driver asks for at once, at most about so many rows a round.
BLOCKS = 8192


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Within one sorted partition: bytes and rows before each row, and whether its digest is new."""
    from pyspark import TaskContext

    part, bytes_, rows, last = TaskContext.get().partitionId(), 0, 0, None
    for b in batches:
        if not b.num_rows:
            continue
        size = b.column("size").to_numpy()
        digest = b.column("digest").to_numpy(zero_copy_only=False)
        new = np.ones(b.num_rows, bool)
        new[1:] = digest[1:] != digest[:-1]
        new[0] = last is None or digest[0] != last
        ends = np.cumsum(size)
        out = [*b.columns, pa.array(np.full(b.num_rows, part)), pa.array(bytes_ + ends - size), pa.array(rows + np.arange(b.num_rows)), pa.array(new)]
        yield pa.RecordBatch.from_arrays(out, names=[*b.schema.names, "part", "before", "nth", "new"])
        bytes_, rows, last = bytes_ + int(ends[-1]), rows + b.num_rows, digest[-1]


class Positions:
    """Known group starts, ascending, the last one the total; gaps[i]: whether starts may be unknown
    between edge i and edge i + 1."""

    def __init__(self, edges: list[int], gaps: list[bool]):
        self.edges, self.gaps = edges, gaps

    def sure(self, start: int, most: int) -> int:
        """The last known edge within the capacity."""
        return self.edges[bisect_right(self.edges, start + most) - 1]

    def loose(self, start: float, most: int) -> float:
        """No true cut lies beyond."""
        x = start + most
        if x >= self.edges[-1]:
            return self.edges[-1]
        i = bisect_right(self.edges, x) - 1
        return x if self.gaps[i] else self.edges[i]

    def cuts(self, most: int, shards: int, step, start: float = 0) -> list[float] | None:
        """Ends of the shards of a greedy pass, or None if they don't suffice."""
        out, total = [], self.edges[-1]
        while start < total:
            if len(out) == shards or (to := step(start, most)) <= start:
                return None
            out.append(to)
            start = to
        return out

    def smallest(self, shards: int, step) -> int:
        lo, hi = -(-self.edges[-1] // shards) - 1, self.edges[-1]
        while hi - lo > 1:
            mid = (lo + hi) // 2
            lo, hi = (lo, mid) if self.cuts(mid, shards, step) is not None else (mid, hi)
        return hi


def balanced(p: Positions, most: int, shards: int) -> tuple[list[int], set[int]]:
    """Cuts for the capacity, each the known edge nearest to an equal share of the rest that leaves the
    rest feasible; and the gaps that hide edges near such a share."""
    start, out, hidden, total = 0, [], set(), p.edges[-1]
    for left in range(shards, 0, -1):
        if start >= total:
            break
        if left == 1:
            out.append(total)
            break
        ideal = start + (total - start) / left
        i = max(0, bisect_right(p.edges, ideal) - 1)
        if p.gaps[i]:
            hidden.add(i)
        near = sorted({p.edges[i], p.edges[min(i + 1, len(p.edges) - 1)]}, key=lambda x: (abs(x - ideal), x))
        far = p.sure(start, most)
        for x in [*near, far]:
            if start < x <= start + most and (x == far or p.cuts(most, left - 1, p.sure, x) is not None):
                break
        out.append(int(x))
        start = x
    return out, hidden


def find_cuts(read, total: int, shards: int) -> tuple[int, list[int]]:
    """read(width, ranges): for each number start // width of groups whose start lies in the ranges, the
    least start, and whether there are more. Returns the capacity and the shards' ends."""
    if total == 0:
        return 0, []
    width = max(1, -(-total // BLOCKS))
    found = {s: more for s, more in read(width, [(0, total)])}
    while True:
        edges = [*sorted(found), total]
        p = Positions(edges, [found[s] for s in edges[:-1]] + [False])
        low, high = p.smallest(shards, p.loose), p.smallest(shards, p.sure)
        if low == high:
            ends, unsure = balanced(p, high, shards)
            if not unsure:
                return high, ends
        else:
            least, most = p.cuts(low, shards, p.sure), p.cuts(high, shards, p.loose)
            unsure, a, b = set(), 0.0, 0.0
            for _ in range(shards):  # where the shards of any capacity from low to high may end
                a, b = p.sure(int(a), low) if least is None and a < total else a, p.loose(b, high)
                unsure |= {i for i in range(max(0, bisect_right(edges, a) - 1), min(len(edges) - 1, bisect_left(edges, b) + 1)) if p.gaps[i]}
                if least is not None:
                    a = least[min(_, len(least) - 1)]
            unsure = unsure or {i for i, g in enumerate(p.gaps) if g}
        width = max(1, width // 64)
        ranges = []
        for i in sorted(unsure):
            found[edges[i]] = False
            if ranges and ranges[-1][1] == edges[i]:
                ranges[-1][1] = edges[i + 1]
            else:
                ranges.append([edges[i], edges[i + 1]])
        found |= {s: more for s, more in read(width, ranges)}


def minimax_shards(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law (bytes), shard, slot, grown_shard (null), text_digest, capacity."""
    text = F.col(text_col)
    small = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.coalesce(F.md5(text.cast("binary")), F.lit("")).alias("digest"),
    )
    dealt = small.repartitionByRange(partitions(docs.sparkSession), "digest", "doc_id").sortWithinPartitions("digest", "doc_id")
    schema = ", ".join(f"`{c}` {kind}" for c, kind in dealt.dtypes) + ", part long, before long, nth long, new boolean"
    rows = persisted(dealt.mapInArrow(_running, schema), "shards")
    # one row for each range partition: their number is a setting, not the data's
    parts = rows.groupBy("part").agg(
        F.sum("size").alias("size"), F.count("*").alias("n"), F.min("digest").alias("first"), F.max("digest").alias("last")
    ).orderBy("part").collect()
    bytes_ = n = 0
    base, last = {}, None
    for r in parts:
        base[r["part"]] = (bytes_, n, last == r["first"])
        bytes_, n, last = bytes_ + r["size"], n + r["n"], r["last"]
    offsets = docs.sparkSession.createDataFrame(
        [(p, *x) for p, x in base.items()] or [(0, 0, 0, False)], "part long, bytes_before long, rows_before long, goes_on boolean"
    )
    at = rows.join(F.broadcast(offsets), "part").withColumns({
        "start": F.col("before") + F.col("bytes_before"),
        "row": F.col("nth") + F.col("rows_before"),
        "head": F.col("new") & ~((F.col("nth") == 0) & F.col("goes_on")),
    })

    def read(width: int, ranges: list) -> list[tuple[int, bool]]:
        inside: Column = F.lit(False)
        for a, b in ranges:
            inside = inside | ((F.col("start") >= a) & (F.col("start") < b))
        got = at.where(F.col("head") & inside).groupBy(F.expr(f"start div {width}").alias("k")).agg(F.min("start").alias("s"), F.count("*").alias("n"))
        return [(r["s"], r["n"] > 1) for r in got.collect()]

    capacity, ends = find_cuts(read, bytes_, shards)
    # groups never straddle an end, so a row's shard is the number of ends at or before its start
    inner = [e for e in ends if e < bytes_]
    shard = sum([(F.col("start") >= e).cast("int") for e in inner], F.lit(0))
    placed = at.withColumn("shard", shard)
    first = placed.groupBy("shard").agg(F.min("row").alias("shard_row"))
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("row") - F.col("shard_row")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), F.col("digest").alias("text_digest"), F.lit(capacity).cast("long").alias("capacity"),
    )
