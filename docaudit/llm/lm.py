"""Language-model scoring: prediction by partial matching over bytes, beside a unigram base score.

The model is a trie of byte contexts up to ORDER long. Escape estimation is by method D (of 2n, an escape
gets one for each distinct symbol left and a symbol seen k times 2k - 1), with exclusion of the symbols
that longer contexts have already offered. Counts come from all training texts: every byte, and an end of text, is counted
in its context of ORDER bytes (shorter at the text's start), and shorter contexts' counts are sums of these. Every
counted context stays. What the last three bytes of a context share is all that orders 3 and 4 need, so the
table is dealt out by these; orders 0 to 2 have at most 258 * 258 * 257 counts and go to every task. A symbol
in its context has one probability in the corpus, so texts ask for it as they ask for word counts: each group
of texts gets its distinct symbols in context back with their logarithms. model() holds a whole
model in memory; adaptive_bits() is the adaptive code of one text, which learns as it goes.

Defined results: null text is empty and has only its end; ids may be null or repeat, each row is
scored on its own; with no training text every symbol is uniform over 257; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docaudit.llm import bytewords as B
from docaudit.llm.common import partitions, persisted, residue

ORDER = 4
END = 256
START = 257
BASE = 258  # symbols and the start mark, as digits of a context


def _symbols(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, each led by ORDER start marks and closed by its end, and where the texts begin."""
    n = len(offsets) - 1
    size = np.diff(offsets) + ORDER + 1
    at = np.zeros(n + 1, np.int64)
    np.cumsum(size, out=at[1:])
    s = np.full(at[-1], START, np.int64)
    s[np.arange(len(raw)) + np.repeat(at[:-1] + ORDER - offsets[:-1], np.diff(offsets))] = raw
    s[at[1:] - 1] = END
    return s, at


def _keys(s: np.ndarray, at: np.ndarray) -> np.ndarray:
    """ORDER + 1 digits in base BASE for each symbol but the start marks: context, then symbol."""
    k = s[: len(s) - ORDER].copy() if len(s) > ORDER else np.zeros(0, np.int64)
    for j in range(1, ORDER + 1):
        k *= BASE
        k += s[j : len(s) - ORDER + j]
    real = np.ones(len(s), bool)
    for j in range(ORDER):
        real[at[:-1] + j] = False
    return k[real[ORDER:]]


def _merge(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, c = np.concatenate(keys), np.concatenate(counts)
    o = np.argsort(k, kind="stable")
    k, c = k[o], c[o]
    head = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.zeros(0, np.int64)
    return k[head], (np.add.reduceat(c, head) if len(k) else c)


#: Distinct keys held before a task hands them on; sums go on in Spark.
HELD = 600_000


def count_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keys: list[np.ndarray] = []
    counts: list[np.ndarray] = []

    def out() -> pa.RecordBatch:
        k, c = _merge(keys, counts)
        keys.clear(), counts.clear()
        return pa.RecordBatch.from_arrays([pa.array(k), pa.array(c.astype(np.int64))], names=["k", "c"])

    for batch in batches:
        for part in B.blocks(batch, "text"):
            s, at = _symbols(*B.bytes_of(part.column("text")))
            k, c = np.unique(_keys(s, at), return_counts=True)
            keys.append(k), counts.append(c)
            if sum(map(len, keys)) > 2 * HELD:
                k, c = _merge(keys, counts)
                keys[:], counts[:] = [k], [c]
                if len(k) > HELD:
                    yield out()
    if keys:
        yield out()


class Order:
    """Counts of symbols in contexts of one length, sparse: a count for each key, and for each context how
    many kinds of symbols it has, how often any occurs, and how often these kinds occur in the next shorter context."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, shorter: Order | None):
        self.keys, self.counts = keys, counts
        context = keys // BASE
        head = np.flatnonzero(np.r_[True, context[1:] != context[:-1]]) if len(keys) else np.zeros(0, np.int64)
        self.contexts = context[head]
        self.kinds = np.diff(np.r_[head, len(keys)])
        add = lambda x: np.add.reduceat(x, head) if len(head) else np.zeros(0, np.int64)
        self.total = add(counts)
        self.below = add(shorter.count(keys % shorter.base)) if shorter else np.zeros(len(head), np.int64)
        self.base = BASE * (shorter.base if shorter else 1)

    def count(self, keys: np.ndarray) -> np.ndarray:
        at, known = _found(self.keys, keys)
        return np.where(known, self.counts[at], 0) if len(self.keys) else np.zeros(len(keys), np.int64)

    def context(self, contexts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not len(self.keys):
            return (np.zeros(len(contexts), np.int64),) * 3
        at, known = _found(self.contexts, contexts)
        return tuple(np.where(known, x[at], 0) for x in (self.kinds, self.total, self.below))


def _found(held: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of keys in the sorted array held, and whether they are there."""
    at = np.minimum(np.searchsorted(held, keys), max(0, len(held) - 1))
    return at, (held[at] == keys if len(held) else np.zeros(len(keys), bool))


def orders(keys: np.ndarray, counts: np.ndarray, longest: int, shorter: list[Order] = []) -> list[Order]:
    """Orders up to the longest one, whose keys and counts are given, on top of those that are there."""
    out = list(shorter)
    for k in range(len(shorter), longest + 1):
        out.append(Order(*_merge([keys % BASE ** (k + 1)], [counts]), out[-1] if out else None))
    return out


class Model:
    def __init__(self, of: list[Order]):
        self.of = of

    def log_p(self, keys: np.ndarray) -> np.ndarray:
        """log10 P of each key's symbol in its context, by method D with exclusion. Symbols that a context
        offers are offered by all shorter ones too, so what is excluded follows from sums."""
        p, open_ = np.zeros(len(keys)), np.ones(len(keys), bool)
        kinds, below = np.zeros((2, len(keys)), np.int64)
        for order in reversed(self.of):
            own = keys % order.base
            n = order.count(own)
            k, total, b = order.context(own // BASE)
            left, whole = k - kinds, 2.0 * (total - below)
            hit = open_ & (n > 0)
            p[hit] += np.log10((2 * n[hit] - 1) / whole[hit])
            open_ &= ~hit
            escapes = open_ & (left > 0)
            p[escapes] += np.log10(left[escapes] / whole[escapes])
            kinds, below = k, b
        p[open_] -= np.log10(np.maximum(257 - kinds[open_], 1))
        return p

    def score(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """log10 probability of each text with its end."""
        keys, at = np.unique(_keys(*_symbols(raw, offsets)), return_inverse=True)
        return summed(self.log_p(keys)[at], offsets)


def summed(lp: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of each text's symbols, its end included."""
    return np.add.reduceat(lp, offsets[:-1] + np.arange(len(offsets) - 1)) if len(offsets) > 1 else np.zeros(0)


def adaptive_bits(text: str, order: int = ORDER) -> float:
    """Adaptive code length of one text in bits: the same estimates, from what came before in it."""
    seen: dict[tuple, dict[int, int]] = {}
    past, bits = (START,) * order, 0.0
    for s in [*text.encode(), END]:
        excluded: set[int] = set()
        p = 1.0
        for k in range(order, -1, -1):
            x = {y: n for y, n in seen.get(past[order - k :], {}).items() if y not in excluded}
            if x:
                whole = 2 * sum(x.values())
                if s in x:
                    p *= (2 * x[s] - 1) / whole
                    break
                p *= len(x) / whole
                excluded |= set(x)
        else:
            p /= 257 - len(excluded)
        bits -= math.log2(p)
        for k in range(order + 1):
            node = seen.setdefault(past[order - k :], {})
            node[s] = node.get(s, 0) + 1
        past = (*past, s)[1:] if order else past
    return bits


def model(train: DataFrame) -> Model:
    """The model of all training texts, held in memory: for texts on one machine. score() deals it out."""
    t = train.select("text").mapInArrow(count_contexts, "k long, c long").groupBy("k").agg(F.sum("c").alias("c")).toArrow()
    return Model(orders(t["k"].to_numpy(), t["c"].to_numpy(), ORDER))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of a task in groups, under the number of the group: kind 0, a row for each distinct word (hash,
    count in training texts); kind 2, a row for each distinct symbol in context (key, count likewise); kind 1,
    a row for each text."""
    from pyspark import TaskContext

    names = ["part", "kind", "hash", "n", "doc_id", "held_out", "text"]
    part, size = TaskContext.get().partitionId() * (1 << 20), 0
    seen: dict[int, tuple[list, list]] = {0: ([], []), 2: ([], [])}
    rows: list[pa.RecordBatch] = []

    def flush() -> Iterator[pa.RecordBatch]:
        for kind, (keys, counts) in seen.items():
            k, c = _merge(keys, counts)
            for lo in range(0, len(k), SLICE):
                v, n = k[lo : lo + SLICE].view(np.int64), c[lo : lo + SLICE]
                z = len(v)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(z, part)), pa.array(np.full(z, kind, np.int8)), pa.array(v), pa.array(n), *[pa.nulls(z, t) for t in (pa.int64(), pa.bool_(), pa.string())],
                ], names=names)
            keys.clear(), counts.clear()
        for b in rows:
            z = b.num_rows
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(z, part)), pa.array(np.ones(z, np.int8)), pa.nulls(z, pa.int64()), pa.nulls(z, pa.int64()), b.column("doc_id"), b.column("held_out"), b.column("text").cast(pa.string()),
            ], names=names)
        rows.clear()

    for batch in batches:
        for b in B.blocks(batch, "text"):
            held = b.column("held_out").to_numpy(zero_copy_only=False)
            w = B.words(b.column("text"))
            raw, offsets = B.bytes_of(b.column("text"))
            symbols = _keys(*_symbols(raw, offsets))
            for kind, k, train in ((0, w.hash, ~np.repeat(held, np.diff(w.first))), (2, symbols, ~np.repeat(held, np.diff(offsets) + 1))):
                k, c = _merge([k], [train.astype(np.int64)])
                keys, counts = seen[kind]
                keys.append(k), counts.append(c)
                if len(keys) > 8:
                    k, c = _merge(keys, counts)
                    keys[:], counts[:] = [k], [c]
            rows.append(b)
            size += len(raw)
            if size >= GROUP or len(seen[2][0][0]) > HELD:
                yield from flush()
                part, size = part + 1, 0
    if rows:
        yield from flush()


def _log_p(batches: Iterator[pa.RecordBatch], low: list[Order]) -> Iterator[pa.RecordBatch]:
    """Distinct symbols in context (hash, c) in the order of the contexts' last three bytes -> kind, hash, v: log10 P."""
    held: list[pa.RecordBatch] = []

    def out(t: pa.Table) -> Iterator[pa.RecordBatch]:
        k, c = t["hash"].to_numpy(), t["c"].to_numpy()
        o = np.argsort(k)
        k, c = k[o], c[o]
        v = Model(orders(k[c > 0], c[c > 0], ORDER, low)).log_p(k)
        yield from pa.table([pa.array(np.full(len(k), 2, np.int8)), pa.array(k), pa.array(v)], names=["kind", "hash", "v"]).to_batches(SLICE)

    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= SLICE:
            t = pa.Table.from_batches(held)
            tail = t["hash"].to_numpy() % BASE**ORDER // BASE
            cut = int(np.flatnonzero(tail == tail[-1])[0])  # its last three bytes may go on in the next batch
            if cut:
                yield from out(t.slice(0, cut))
                held = t.slice(cut).to_batches()
    if held:
        yield from out(pa.Table.from_batches(held))


#: Rows handed on at once.
SLICE = 100_000
#: Bytes of text whose words and contexts are looked up together; bounds what one later task holds.
GROUP = 32_000_000


def _scored(key, left: pa.Table, right: pa.Table) -> pa.Table:
    """left: texts of a group; right: its words with the corpus counts (kind 0) and its symbols in context
    with their log10 P (kind 2)."""
    kind, hashes, value = (right[x].to_numpy() for x in ("kind", "hash", "v"))
    of = {}
    for k, h in ((0, hashes.view(np.uint64)), (2, hashes)):
        h, v = h[kind == k], value[kind == k]
        o = np.argsort(h)
        of[k] = h[o], v[o]
    n, v = (int(left[x][0].as_py() or 0) for x in ("train_tokens", "train_words"))
    end = int(left["train_docs"][0].as_py() or 0)
    parts: list[tuple] = []
    for batch in left.select(["text"]).to_batches():
        for b in B.blocks(batch, "text"):
            w = B.words(b.column("text"))
            c = of[0][1][np.searchsorted(of[0][0], w.hash)]
            sums = lambda x: np.diff(np.r_[0, np.cumsum(x)][w.first])
            raw, offsets = B.bytes_of(b.column("text"))
            k, at = np.unique(_keys(*_symbols(raw, offsets)), return_inverse=True)
            lp = of[2][1][np.searchsorted(of[2][0], k)][at]
            parts.append((np.diff(w.first) + 1, sums(c > 0), sums(np.log10(c + 1.0)), summed(lp, offsets)))
    tokens, known, base, score = (np.concatenate(x) for x in zip(*parts))
    base = base + np.log10(end + 1.0) - tokens * np.log10(n + v + 1.0)
    out = left.select(["doc_id", "held_out"])
    for name, x in (("n_tokens", tokens), ("n_known", known + (end > 0)), ("train_tokens", np.full(len(base), n)), ("base_score", base), ("score", score)):
        out = out.append_column(name, pa.array(x))
    return out


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mod: int = 7, held: int = 2) -> DataFrame:
    """One row for each document, as the contract of op2 has it. Counts of words and of symbols in context
    over all training texts are summed by word and by context and come back to the groups of texts that
    asked for them, so no task and no driver holds the vocabulary or the trie."""
    spark = docs.sparkSession
    x = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("held_out", residue("doc_id", mod) == held)
    got = persisted(x.mapInArrow(_scan, "part long, kind byte, hash long, n long, doc_id long, held_out boolean, text string"), "scanned", "zstd")
    asked = got.where("kind <> 1")
    # sums come before anything meets by key, so a common word or context costs no task more than its groups
    counts = persisted(asked.groupBy("kind", "hash").agg(F.sum("n").alias("c")), "counts", "zstd")
    totals = counts.where("kind = 0").agg(F.sum("c").alias("t"), F.count_if(F.col("c") > 0).alias("v")).first()
    n_docs = got.where("kind = 1 and not held_out").count()
    low = counts.where("kind = 2 and c > 0").groupBy((F.col("hash") % F.lit(BASE**3)).alias("k")).agg(F.sum("c").alias("c")).toArrow()
    shared = spark.sparkContext.broadcast(orders(low["k"].to_numpy(), low["c"].to_numpy(), 2))
    tail = F.expr(f"hash % {BASE**ORDER} div {BASE}")
    contexts = counts.where("kind = 2").select("hash", "c").repartition(partitions(spark), tail).sortWithinPartitions(tail).mapInArrow(
        lambda it: _log_p(it, shared.value), "kind byte, hash long, v double"
    )
    values = contexts.unionByName(counts.where("kind = 0").select("kind", "hash", F.col("c").cast("double").alias("v")))
    values = asked.select("part", "kind", "hash").join(values, ["kind", "hash"]).select(F.col("part").alias("of"), "kind", "hash", "v")
    texts = got.where("kind = 1").select(
        "part", "doc_id", "held_out", "text",
        F.lit((totals["t"] or 0) + n_docs).cast("long").alias("train_tokens"),
        F.lit((totals["v"] or 0) + (n_docs > 0)).cast("long").alias("train_words"), F.lit(n_docs).cast("long").alias("train_docs"),
    )
    return (
        texts.groupBy("part").cogroup(values.groupBy("of"))
        .applyInArrow(_scored, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    )
