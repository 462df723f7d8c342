"""Toxicity by a convolutional text classifier, trained in numpy.

A word's embedding joins vectors from three hashed tables: two independent hashes of the whole word and
one of its first PREFIX bytes. Filters of widths 1, 2 and 3 run over the words, with ReLU and max pooling over the whole
text, then one logistic layer. Max pooling sends each filter's gradient to one place of a text, so
training touches few rows of the tables. Thresholds for decisions are calibrated by language on all labelled
training rows, from a histogram of their scores that Spark makes; those that the classifier was fitted on count only
where the others are too few. The score itself sees the text alone.

The classifier is fitted on at most `sample` labelled rows a class, taken by a hash of the id; its bias is then
shifted by the log ratio of what of each class was taken to all there is, so that scores mean the same at
every size. Every document is scored over its whole text.

Defined results: null or blank text has no words: its pooled values are zero and its score is what the
bias gives; labels that are null or not 0/1 aren't learned from; several labels of an id each count;
without labels of both classes the score is 0.5 for all and no row is rejected; other columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docaudit.llm import bytewords as B
from docaudit.llm.common import persisted, removed, residue, small_batches, unused

PREFIX = 4
BUCKETS = 1 << 17
DIM = 6
WIDTHS = (1, 2, 3)
FILTERS = 12
EPOCHS = 10
SAMPLE = 2000

def word_features(w: B.Words) -> np.ndarray:
    """Three table rows for each word."""
    n = len(w.start)
    out = np.empty((n, 3), np.int32)
    if n:
        head = w.span_hash(w.start, np.minimum(w.end, w.start + PREFIX))
        out[:, 0] = w.hash & np.uint64(BUCKETS - 1)
        out[:, 1] = BUCKETS + ((w.hash >> np.uint64(24)) & np.uint64(BUCKETS - 1)).astype(np.int64)
        out[:, 2] = 2 * BUCKETS + (head & np.uint64(BUCKETS - 1)).astype(np.int64)
    return out


class Classifier:
    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.table = np.zeros((3 * BUCKETS, DIM), np.float32)
        self.conv = [rng.normal(0, 0.3, (k * 3 * DIM, FILTERS)).astype(np.float32) for k in WIDTHS]
        self.conv_bias = [np.full(FILTERS, 0.0, np.float32) for _ in WIDTHS]
        self.out = rng.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32)
        self.bias = np.float32(0)
        self.trained = False
        self.thresholds: dict[str, float] = {}
        #: Ids of the rows that it was fitted on.
        self.fitted: list = []

    def _pool(self, feats: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pooled activations of each text and the places of the maxima (-1: none above zero)."""
        docs = len(first) - 1
        n = len(feats)
        pooled = np.zeros((docs, len(WIDTHS) * FILTERS), np.float32)
        place = np.full(pooled.shape, -1, np.int64)
        if not n:
            return pooled, place
        e = np.ascontiguousarray(self.table[feats].reshape(n, 3 * DIM).T)
        full = np.flatnonzero(np.diff(first) > 0)
        for k, width in enumerate(WIDTHS):
            y = np.repeat(self.conv_bias[k][:, None], n, 1)
            for j in range(width):
                part = self.conv[k][j * 3 * DIM : (j + 1) * 3 * DIM].T @ e
                for i in range(1, j + 1):  # words of the next text are not this text's
                    part[:, (at := first[full] + i - 1)[at < n]] = 0
                y[:, : n - j] += part[:, j:]
            best = np.maximum.reduceat(y, first[full], axis=1)
            cols = slice(k * FILTERS, (k + 1) * FILTERS)
            pooled[full, cols] = np.maximum(best, 0).T
            if self.training:
                for i, d in enumerate(full):
                    place[d, cols] = np.where(best[:, i] > 0, first[d] + y[:, first[d] : first[d + 1]].argmax(1), -1)
        return pooled, place

    training = False

    def __getstate__(self) -> dict:
        """Of the tables only the rows that are not zero, which are those of the words that it was fitted on."""
        at = np.flatnonzero(self.table.any(1)).astype(np.int32)
        return self.__dict__ | {"table": (len(self.table), at, self.table[at])}

    def __setstate__(self, state: dict) -> None:
        n, at, rows = state["table"]
        self.__dict__.update(state)
        self.table = np.zeros((n, DIM), np.float32)
        self.table[at] = rows

    def logits(self, feats: np.ndarray, first: np.ndarray) -> np.ndarray:
        return self._pool(feats, first)[0] @ self.out + self.bias

    def fit(self, feats: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, rate: float = 0.1, batch: int = 16, seed: int = 5) -> None:
        """AdaGrad on the logistic loss. Tables start at small random values for the words that occur."""
        if len(labels) == 0 or labels.min() == labels.max():
            return
        rng = np.random.default_rng(seed)
        there = np.zeros(len(self.table), bool)  # no copy of all features
        for f in feats:
            there[f] = True
        used = np.flatnonzero(there)
        self.table[used] = rng.normal(0, 0.1, (len(used), DIM)).astype(np.float32)
        self.training = True
        grad2 = {id(a): np.full(a.shape, 1e-3, np.float32) for a in [self.table, *self.conv, *self.conv_bias, self.out]}
        bias2 = 1e-3

        def step(a: np.ndarray, g: np.ndarray, at=slice(None)) -> None:
            s = grad2[id(a)]
            s[at] += g * g
            a[at] -= rate * g / np.sqrt(s[at])

        n = len(labels)
        for _ in range(epochs):
            order = rng.permutation(n)
            for lo in range(0, n, batch):
                idx = order[lo : lo + batch]
                x = [feats[i] for i in idx]
                first = np.r_[0, np.cumsum([len(f) for f in x])]
                f = np.concatenate(x)
                pooled, place = self._pool(f, first)
                p = 1 / (1 + np.exp(-np.clip(pooled @ self.out + self.bias, -30, 30)))
                d = ((p - labels[idx]) / len(idx)).astype(np.float32)
                up = d[:, None] * self.out[None, :]
                step(self.out, pooled.T @ d)
                g = float(d.sum())
                bias2 += g * g
                self.bias -= np.float32(rate * g / np.sqrt(bias2))
                rows, vals = [], []
                for k, width in enumerate(WIDTHS):
                    gw = np.zeros_like(self.conv[k])
                    gb = np.zeros(FILTERS, np.float32)
                    pl = place[:, k * FILTERS : (k + 1) * FILTERS]
                    doc, flt = np.nonzero(pl >= 0)
                    at, u = pl[doc, flt], up[doc, k * FILTERS + flt]
                    np.add.at(gb, flt, u)
                    for j in range(width):
                        ok = at + j < first[doc + 1]
                        a, c, v = at[ok] + j, flt[ok], u[ok]
                        e = self.table[f[a]].reshape(len(a), 3 * DIM)
                        block = slice(j * 3 * DIM, (j + 1) * 3 * DIM)
                        np.add.at(gw[block].T, c, e * v[:, None])
                        back = (self.conv[k][block].T[c] * v[:, None]).reshape(-1, DIM)
                        rows.append(f[a].ravel()), vals.append(back)
                    step(self.conv[k], gw), step(self.conv_bias[k], gb)
                if rows and (r := np.concatenate(rows)).size:
                    ids, inv = np.unique(r, return_inverse=True)
                    g2 = np.zeros((len(ids), DIM), np.float32)
                    np.add.at(g2, inv, np.concatenate(vals))
                    step(self.table, g2, ids)
        self.training, self.trained = False, True

    def probability(self, logits: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(logits, -30, 30))) if self.trained else np.full(len(logits), 0.5)


#: Thresholds to choose from; a score's bin is the number of them that it reaches.
STEPS = np.linspace(0.05, 0.95, 19)
#: Rows of each class that a threshold of its own needs.
ENOUGH = 10


def best_threshold(counts: np.ndarray, at_most: float = 0.02) -> float:
    """counts: rows by label and bin of their scores. The threshold with the best F1 among those that flag
    at most that part of the clean rows."""
    reach = counts[:, ::-1].cumsum(1)[:, ::-1]  # rows that reach each threshold, after all rows
    best = (0.0, 0.5)
    for t, fp, tp in zip(STEPS, reach[0, 1:], reach[1, 1:]):
        if fp <= at_most * max(1, reach[0, 0]) and tp and (f1 := 2 * tp / (tp + fp + reach[1, 0])) > best[0]:
            best = (f1, float(t))
    return best[1]


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text's word features as bytes. A word that a text repeats next to the same neighbours adds
    nothing to its maxima, but its order matters to wide filters, so texts are kept whole."""
    for batch in batches:
        for b in B.blocks(batch, "text"):
            w = B.words(b.column("text"))
            f = word_features(w)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("lang"), b.column("toxic"), pa.array([f[i:j].tobytes() for i, j in zip(w.first[:-1], w.first[1:])], pa.binary())],
                names=["doc_id", "lang", "toxic", "words"],
            )


def _fitted(fit):
    """The classifier, pickled, that `fit` makes of all examples that come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got)
        feats = [np.frombuffer(x.as_buffer(), np.int32).reshape(-1, 3) for x in t["words"]]  # views of what came
        model = Classifier()
        fit(model, feats, t["toxic"].to_numpy().astype(np.float32))
        model.fitted = t["doc_id"].unique().to_pylist()
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    return run


def labelled(labels: DataFrame, id_col: str = "doc_id", label_col: str = "toxic") -> DataFrame:
    """doc_id, toxic: the labels that may be learned from."""
    mine = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("toxic")).where("toxic in (0, 1) and doc_id is not null")
    return mine.where(residue("doc_id", 4) != 2)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang", label_col: str = "toxic") -> Classifier:
    """Fits on up to `sample` rows of each class of the labelled training rows; which ones, a hash of
    the id decides. One task fits it on their features; only the model comes to the driver, whose memory this spares."""
    mine = labelled(labels, id_col, label_col).withColumn("h", F.xxhash64("doc_id"))
    chosen = [mine.where(F.col("toxic") == v).orderBy("h", "doc_id").limit(sample) for v in (0, 1)]
    chosen = persisted(chosen[0].unionByName(chosen[1]).drop("h"), "labels")
    texts = docs.select(
        F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), (F.col(lang_col).cast("string") if lang_col else F.lit(None).cast("string")).alias("lang")
    ).join(F.broadcast(chosen), "doc_id").select("doc_id", "lang", "toxic", "text")  # at most 2 * sample ids
    # sampled rows hold whole texts, so they come over in pieces
    got = persisted(texts.mapInArrow(_examples, "doc_id long, lang string, toxic int, words binary"), "examples")
    # at most 2 * sample rows, in order, as the fit goes by it
    made = got.coalesce(1).sortWithinPartitions("doc_id", "toxic").mapInArrow(_fitted(Classifier.fit), "model binary").head()
    there = {r["toxic"]: r["count"] for r in mine.groupBy("toxic").count().collect()}
    removed(chosen, got)
    if made is None:
        return Classifier()
    model = pickle.loads(made["model"])
    if model.trained:
        model.bias += np.float32(np.log(max(1.0, there[1] / sample)) - np.log(max(1.0, there[0] / sample)))
    return model


def calibrate(model: Classifier, scored: DataFrame, labels: DataFrame, score_col: str = "score") -> None:
    """Sets the thresholds from all labelled training rows of scored (doc_id, lang, score). Rows that the
    model was fitted on count only where fewer than ENOUGH others of a class are there."""
    spark = scored.sparkSession
    fitted = spark.createDataFrame([(i,) for i in model.fitted], scored.select("doc_id").schema).withColumn("fitted", F.lit(1))
    bins = sum((F.col(score_col) >= float(t)).cast("int") for t in STEPS)
    x = scored.select("doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), bins.alias("bin")).join(labelled(labels), "doc_id")
    x = x.join(F.broadcast(fitted), "doc_id", "left").groupBy("lang", F.coalesce("fitted", F.lit(0)).alias("fitted"), "toxic", "bin").agg(F.count("*").alias("n"))
    x = persisted(x, "scores")

    def threshold(rows: list, least: int = ENOUGH) -> float | None:
        n = np.zeros((2, 2, len(STEPS) + 1), np.int64)
        for r in rows:
            n[r["fitted"], r["toxic"], r["bin"]] += r["n"]
        for counts, need in ((n[0], ENOUGH), (n.sum(0), least)):
            if (counts.sum(1) >= need).all():
                return best_threshold(counts)
        return None

    by_all = x.groupBy("fitted", "toxic", "bin").agg(F.sum("n").alias("n")).collect()
    own: dict[str, list] = {}
    # a row for each language that is labelled, score bin and label: the names of languages bound it, not the corpus
    for r in x.collect():
        own.setdefault(r["lang"], []).append(r)
    removed(x)
    found = {"": threshold(by_all, 0)} | {name: threshold(rows) for name, rows in own.items() if name}
    model.thresholds = {name: t for name, t in found.items() if t is not None}


def scores(docs: DataFrame, model: Classifier, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), out: str = "score") -> DataFrame:
    """The columns id_col and `keep`, and the score under the name `out`."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    (held,) = unused(docs.select(id_col, *keep).withColumn(out, F.lit(0)), "text_to_score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for b in B.blocks(batch, held):
                w = B.words(b.column(held))
                p = m.probability(m.logits(word_features(w), w.first))
                at = b.schema.get_field_index(held)
                yield b.set_column(at, pa.field(out, pa.float64()), pa.array(p.astype(np.float64)))

    x = docs.select(id_col, *keep, F.col(text_col).alias(held))
    schema = ", ".join(f"`{c}` {kind}" for c, kind in x.dtypes if c != held) + f", `{out}` double"
    return x.mapInArrow(run, schema)


def thresholds_column(model: Classifier, lang):
    """Each row's threshold by its language."""
    base = F.lit(model.thresholds.get("", 0.5))
    pairs = [y for kv in model.thresholds.items() if kv[0] for y in (F.lit(kv[0]), F.lit(kv[1]))]
    return F.coalesce(F.element_at(F.create_map(*pairs), lang), base) if pairs else base


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the classifier, fitted on labels, doesn't reject at their language's threshold."""
    model = train(docs, labels)
    if not model.trained:
        return docs
    rest = tuple(c for c in docs.columns if c != "doc_id")
    (score,) = unused(docs, "toxic_score")
    scored = persisted(scores(docs, model, keep=rest, out=score), "scored")
    calibrate(model, scored, labels, score)
    lang = F.coalesce(F.col("lang").cast("string"), F.lit(""))
    return scored.where(F.col(score) < thresholds_column(model, lang)).select(*docs.columns)
