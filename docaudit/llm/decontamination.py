"""Benchmark decontamination by pigeonhole edit matching.

Items and texts are folded (lower case, every run of other than letters and digits one space). An item
of m characters may occur with up to k = m * ERRORS // 100 edits; cut into k + 1 pieces, at least one
piece of any such occurrence stands in the text unchanged. An Aho-Corasick automaton of all pieces
finds these, and Myers' bit-parallel algorithm takes the least edit distance of the item to any
substring around the hit. Chance hits end early: pieces are leaves of a binary tree in which a node of
L pieces may have L - 1 edits, and an occurrence within the budget has a leaf all of whose ancestors
keep to theirs, so a hit is tried on its ancestors first, the smallest one first. All hits are tried, so
no occurrence within the budget is missed.

Items are a query set against all rows. They are read in blocks of at most BLOCK characters, one pass
of the texts for each, so what a task holds has a size that doesn't depend on the benchmark.

Defined results: null texts and items match nothing, nor do items that are empty when folded; an item
too short for pieces of MIN_PIECE characters gets fewer edits, and at least 0; items with equal text
match under each of their ids; an item without an id matches with a null item_id and counts in without_items as any
other; rows of documents with equal ids are searched each on its own; empty
tables give no matches; other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ERRORS = 10
MIN_PIECE = 8
BLOCK = 2_000_000
_OTHER = re.compile(r"[\W_]+")


def fold(text: str | None) -> str:
    return _OTHER.sub(" ", (text or "").lower()).strip()


def budget(m: int, errors: int = ERRORS, piece: int = MIN_PIECE) -> int:
    """Edits an item of m characters may have: pieces stay at least `piece` long."""
    return max(0, min(m * errors // 100, m // piece - 1))


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """k + 1 pieces of about equal length with their offsets."""
    cuts = [len(item) * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def myers(pattern: str, text: str) -> tuple[int, int]:
    """Least edit distance of the pattern to a substring of the text, and where the first best one ends.
    One integer holds a column's vertical differences."""
    m = len(pattern)
    eq: dict[str, int] = {}
    for i, c in enumerate(pattern):
        eq[c] = eq.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score, best, at = full, 0, m, m, 0
    for j, c in enumerate(text):
        e = eq.get(c, 0)
        x = e | down
        d = (((e & up) + up) ^ up) | e
        h_up = down | (full & ~(d | up))
        h_down = up & d
        if h_up & top:
            score += 1
        elif h_down & top:
            score -= 1
        h_up = (h_up << 1) & full
        h_down = (h_down << 1) & full
        up = h_down | (full & ~(x | h_up))
        down = h_up & x
        if score < best:
            best, at = score, j + 1
    return best, at


def ancestors(leaf: int, leaves: int) -> list[tuple[int, int]]:
    """Ranges of leaves of the nodes above a leaf, the smallest first, the root (the whole item) left out."""
    out, a, b = [], 0, leaves
    while b - a > 1:
        out.append((a, b))
        mid = (a + b) // 2
        a, b = (a, mid) if leaf < mid else (mid, b)
    return out[:0:-1]


class Matcher:
    def __init__(self, items: list[tuple[int, str]], errors: int = ERRORS, piece: int = MIN_PIECE):
        self.items = [(i, t, budget(len(t), errors, piece)) for i, t in items if t]
        self.parts: dict[str, list[tuple[int, int, list[tuple[str, int, int]]]]] = {}
        for n, (_, t, k) in enumerate(self.items):
            cut = pieces(t, k)
            ends = [off for off, _ in cut] + [len(t)]
            for leaf, (off, p) in enumerate(cut):
                if p:
                    above = [(t[ends[a] : ends[b]], ends[a] - off, b - a - 1) for a, b in ancestors(leaf, k + 1)]
                    self.parts.setdefault(p, []).append((n, off, above))
        self.machine = None

    def __getstate__(self) -> dict:
        return {"items": self.items, "parts": self.parts, "machine": None}

    def find(self, text: str) -> list[tuple[int, int, int]]:
        """(item id, distance, end in the folded text) of every item within its budget."""
        if not self.parts or not text:
            return []
        if self.machine is None:
            import ahocorasick

            self.machine = ahocorasick.Automaton()
            for p, of in self.parts.items():
                self.machine.add_word(p, (len(p), of))
            self.machine.make_automaton()
        best: dict[int, tuple[int, int]] = {}
        tried: dict[int, list[int]] = {}
        for end, (size, of) in self.machine.iter(text):
            here = end - size + 1
            for n, off, above in of:
                _, item, k = self.items[n]
                start = here - off
                starts = tried.setdefault(n, [])
                i = bisect_right(starts, start)
                if n in best and best[n][0] == 0 or i and starts[i - 1] + k >= start:
                    continue
                if any(myers(node, text[max(0, here + at - e) : here + at + len(node) + e])[0] > e for node, at, e in above):
                    continue
                # hits of one alignment differ by at most k, so the window covers those up to k further; a start may
                # lie before the text, and before one that a later piece's or a chance hit led to
                lo, hi = max(0, start - k), start + len(item) + 2 * k
                starts.insert(i, start)
                if text.startswith(item, max(0, start)):
                    d, at = 0, len(item) + max(0, start) - lo
                else:
                    d, at = myers(item, text[lo:hi])
                if d <= k and (n not in best or d < best[n][0]):
                    best[n] = (d, lo + at)
        return [(self.items[n][0], d, at) for n, (d, at) in sorted(best.items())]


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", errors: int = ERRORS) -> DataFrame:
    """One row for each document and item found in it: doc_id, item_id, distance, text_end (in the folded text)."""
    spark = docs.sparkSession
    x = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("text is not null")
    schema = "doc_id long, item_id long, distance int, text_end long"

    def searched(block: list[tuple[int, str]]) -> DataFrame:
        shared = spark.sparkContext.broadcast(Matcher(block, errors))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m = shared.value
            for b in batches:
                out = [(i, *hit) for i, t in zip(b.column("doc_id").to_pylist(), b.column("text")) for hit in m.find(fold(t.as_py()))]
                if out:
                    cols = list(zip(*out))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int64()))], names=["doc_id", "item_id", "distance", "text_end"])

        return x.mapInArrow(run, schema)

    out = None
    for block in item_blocks(benchmark, item_col, item_text_col):
        found = searched(block)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else searched([])


def item_blocks(benchmark: DataFrame, item_col: str = "item_id", item_text_col: str = "text", size: int = BLOCK) -> Iterator[list[tuple[int | None, str]]]:
    """Folded items in blocks of about `size` characters."""
    block, held = [], 0
    for r in benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(item_text_col).alias("t")).where("t is not null").orderBy("i", "t").toLocalIterator():
        block.append((r["i"], fold(r["t"])))
        held += len(r["t"])
        if held >= size:
            yield block
            block, held = [], 0
    if block:
        yield block


def without_items(docs: DataFrame, benchmark: DataFrame, errors: int = ERRORS) -> DataFrame:
    """The rows of docs in which no item occurs within its budget; one pass for each block of items."""
    spark, out = docs.sparkSession, docs
    schema = ", ".join(f"`{c}` {kind}" for c, kind in docs.dtypes)
    for block in item_blocks(benchmark):
        shared = spark.sparkContext.broadcast(Matcher(block, errors))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            m = shared.value
            for b in batches:
                yield b.filter(pa.array([not m.find(fold(t.as_py())) for t in b.column("text")], pa.bool_()))

        out = out.mapInArrow(run, schema)
    return out
