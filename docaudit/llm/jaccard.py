"""N-gram Jaccard join with vertical partitioning: near-duplicate components of word-shingle sets.

Exact: no link between two sets of similarity 0.8 or more is missed, and every link used is counted.

1. Each text gives its set of shingle hashes. Sets are known by a 64-bit id of their content.
2. The global order of shingles is by class, then hash. The class is about the logarithm of how many
   texts have the shingle: each task counts those that several of its texts share, the sums go into a
   table of SLOTS slots by hash. A slot may hold several shingles; any order serves, a better one only
   spares work. Two sets that must share t of n shingles share one among the first n - t + 1 of each,
   so only these leading shingles are handed on, and of them those that some other set has too.
3. Rows of a leading shingle are compared star-wise in rounds: each with one row of the shingle that
   belongs to another component so far, picked anew each round; sizes and places in the order must
   allow the overlap. Within a component nothing more is compared.
   Sets still outside the largest component of a shingle then go by their difference from that component's
   hub, the set with most links. Two sets differ by as much as their differences do, and what a group has in
   common is gone from these, so a prefix filter over differences pairs few sets even of a group whose
   members are all alike. It serves sets that have half or more in common with the hub, and by the triangle
   inequality all that are similar to one of these; the rest meet by leading shingle.
4. Candidate pairs are counted by vertical partitioning: the order of hashes is cut into FRAGMENTS,
   each text's set into segments of these; overlaps of segments are counted apart and summed by pair.

Ids of sets, not of documents, run through all this, so repeated and null document ids need no care.

Defined results: null or blank text has an empty set and stands alone; rows with equal id take part
as one document each; where all ids of a component are null its id is null; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docaudit.llm import bytewords as B
from docaudit.llm.common import persisted, removed, small_batches, unused
from docaudit.llm.components import components

WIDTH = 5
PERCENT = 80
#: Slots of the table of classes, 4 MB whatever the corpus, and the texts of a block that make a shingle count.
SLOT_BITS = 22
FREQUENT = 3
FRAGMENTS = 8
ROUNDS = 2
#: Rows of a shingle's largest component beyond which its rows go by their difference from the hub.
SMALL = 64
#: Largest Jaccard distance in percent from its hub at which a set goes by its difference.
NEAR = 50
#: Bits of the filter that spares texts without a candidate a second reading; more texts only blunt it.
FILTER_BITS = 1 << 24
#: Ids of sets that a task remembers, so that equal ones give their hashes once.
REMEMBERED = 1 << 18
SETS = "doc_id long, n long, sid long, h array<long>"


def required(n, percent: int = PERCENT):
    """Least overlap that a set of n needs with any set: ceil(percent n / 100)."""
    return -(-percent * n // 100)


def _slot(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def _texts(batch: pa.RecordBatch, width: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for b in B.blocks(batch, "text"):
        s, at = B.shingles(B.words(b.column("text")), width)
        yield b, [np.unique(s[at[d] : at[d + 1]]) for d in range(b.num_rows)]


def _frequent(width: int):
    """Slots of shingles that FREQUENT or more different sets of a block have, and how many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, sets in _texts(batch, width):
                unlike = {(len(x), int(x.sum(dtype=np.uint64))): x for x in sets}
                h, c = np.unique(np.concatenate([*unlike.values(), np.zeros(0, np.uint64)]), return_counts=True)
                on = c >= FREQUENT
                yield pa.RecordBatch.from_arrays([pa.array(_slot(h[on])), pa.array(h[on].view(np.int64)), pa.array(c[on])], names=["slot", "g", "c"])

    return run


def set_id(x: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        pair = B.mix(np.array([x.sum(dtype=np.uint64), len(x)], np.uint64)).sum(dtype=np.uint64, keepdims=True)
        return int(B.mix(pair ^ B.mix(x ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64))[0])


def _sets(width: int, percent: int, classes):
    """Size and id of each text's set, with its leading hashes in order. A task gives the hashes of equal
    sets once, then null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given: set[int] = set()
        for batch in batches:
            for b, sets in _texts(batch, width):
                if len(given) > REMEMBERED:
                    given.clear()
                ids, parts, null = [], [], []
                for x in sets:
                    n, i = len(x), set_id(x)
                    ids.append(i)
                    null.append(n == 0 or i in given)
                    given.add(i)
                    parts.append(x[:0] if null[-1] else x[np.lexsort((x, classes.value[_slot(x)]))[: n - required(n, percent) + 1]])
                ends = np.r_[0, np.cumsum([len(x) for x in parts])].astype(np.int32)
                flat = np.concatenate([*parts, np.zeros(0, np.uint64)])
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)), mask=pa.array(np.array(null, bool)))
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), pa.array([len(x) for x in sets], pa.int64()), pa.array(np.array(ids, np.uint64).view(np.int64)), lists], names=["doc_id", "n", "sid", "h"]
                )

    return run


def _segments(width: int, wanted):
    """Whole sets of the texts that the filter has, cut where the order of hashes is cut."""
    cuts = np.array([i * (2**64 // FRAGMENTS) for i in range(1, FRAGMENTS)], np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("bit").to_numpy()
            batch = batch.filter(pa.array((wanted.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1))
            for _, sets in _texts(batch, width):
                ids, parts = [], []
                for x in sets:
                    ids.append(set_id(x))
                    parts += np.split(x, np.searchsorted(x, cuts))
                ends = np.r_[0, np.cumsum([len(x) for x in parts])].astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*parts, np.zeros(0, np.uint64)]).view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(np.array(ids, np.uint64), FRAGMENTS).view(np.int64)), pa.array(np.tile(np.arange(FRAGMENTS, dtype=np.int32), len(ids))), lists], names=["sid", "f", "h"]
                )

    return run


def _fits(percent: int):
    """Sizes allow the similarity."""
    return 100 * F.least("n", "on") >= percent * F.greatest("n", "on")


def _first(percent: int):
    """A shingle in places k and ok may be the first that the sets share: with what follows it in the set
    with less room, the overlap is enough. Of two similar sets their first shared shingle passes."""
    return (100 + percent) * (1 + F.least(F.col("n") - F.col("k"), F.col("on") - F.col("ok"))) >= percent * (F.col("n") + F.col("on"))


def _enough(c: str, percent: int):
    """The number of leading shingles that two sets share allows the similarity: past the end of the leading
    ones of either set, no more can follow than that set has left."""
    need = F.ceil(percent * (F.col("n") + F.col("on")) / (100 + percent))
    left = lambda n: F.ceil(percent * F.col(n) / 100) - 1
    return F.col(c) >= need - F.greatest(left("n"), left("on"))


def overlaps(pairs: DataFrame, segments: DataFrame) -> DataFrame:
    """pairs (a, b) -> (a, b, n): overlaps of the segments (sid, f, h) counted by fragment, then summed.
    Segments of a set may come more than once, from copies of the text."""
    left = segments.select(F.col("sid").alias("a"), "f", F.col("h").alias("ha"))
    right = segments.select(F.col("sid").alias("b"), "f", F.col("h").alias("hb"))
    counted = pairs.join(left, "a").join(right, ["b", "f"]).select("a", "b", "f", F.size(F.array_intersect("ha", "hb")).cast("long").alias("n"))
    return counted.groupBy("a", "b", "f").agg(F.max("n").alias("n")).groupBy("a", "b").agg(F.sum("n").alias("n"))


def frequency_classes(base: DataFrame, width: int) -> np.ndarray:
    """The table of classes: at most as many rows come to the driver as it has slots."""
    counts = base.select("text").mapInArrow(_frequent(width), "slot long, g long, c long").groupBy("slot", "g").agg(F.sum("c").alias("c"))
    slots = counts.groupBy("slot").agg(F.max(F.floor(F.log2(F.col("c").cast("double")) * 2)).alias("k")).toArrow()
    out = np.zeros(1 << SLOT_BITS, np.uint8)
    out[slots["slot"].to_numpy()] = slots["k"].to_numpy()
    return out


def _shared(rows: DataFrame) -> DataFrame:
    """Rows of shingles that more than one row has."""
    return rows.join(rows.groupBy("g").agg(F.count("*").alias("c")).where("c > 1").select("g"), "g")


def _pairs(rows: DataFrame) -> DataFrame:
    """Adds the pair in the order of ids and the sum of its sizes; n and on follow that order."""
    turned = F.col("sid") > F.col("o")
    return rows.withColumns({
        "a": F.least("sid", "o"), "b": F.greatest("sid", "o"), "both": F.col("n") + F.col("on"),
        "n": F.when(turned, F.col("on")).otherwise(F.col("n")), "on": F.when(turned, F.col("n")).otherwise(F.col("on")),
    })


def _differences(at: DataFrame, segments: DataFrame, percent: int) -> DataFrame:
    """at (sid, n, c, hub, apart) -> what each set lacks of its hub and has beyond it, in the order of a prefix
    filter: what the hub lacks first, then by hash. Adds size (of the difference), near, similar and lone."""
    own = segments.select("sid", "f", "h")
    hubs = segments.select(F.col("sid").alias("hub"), "f", F.col("h").alias("hh"))
    less = lambda x, y: F.sort_array(F.flatten(F.collect_list(F.array_except(x, y))))
    x = at.join(own, "sid").join(hubs, ["hub", "f"]).groupBy("sid", "n", "c", "hub", "apart").agg(
        F.concat(less("h", "hh"), less("hh", "h")).alias("d"), F.sum(F.size("hh")).alias("n_hub")
    ).withColumn("size", F.size("d").cast("long"))
    union2 = F.col("n") + F.col("n_hub") + F.col("size")  # twice the union of the set and its hub
    similar = (100 + percent) * F.col("size") <= (100 - percent) * (F.col("n") + F.col("n_hub"))
    x = x.withColumns({"near": 200 * F.col("size") <= NEAR * union2, "mid": 200 * F.col("size") <= (NEAR + 100 - percent) * union2, "similar": similar})
    return x.withColumn("lone", F.col("apart") & ~F.col("similar"))


def _by_difference(x: DataFrame, percent: int) -> DataFrame:
    """Pairs (sid, n, o, on) whose differences from a common hub may overlap enough. With Q the share of both
    sizes by which similar sets may differ, differences of sizes s and t must share (s + t - Q (n + on)) / 2. A
    lone set has s > Q (n + n_hub), and no set has t < |on - n_hub|; this bounds what each side must share."""
    q, whole = 100 - percent, 100 + percent
    least = lambda sizes: F.ceil((whole * F.col("size") - q * sizes) / (2 * whole))
    short = F.col("size") - least(F.col("n") - F.col("n_hub")) + 1
    long = F.col("size") - least(F.col("n") + F.col("n_hub")) + 1
    rows = x.where("size > 0").withColumns({"short": short, "to": F.when(F.col("lone"), F.greatest(long, short)).otherwise(short)})
    rows = rows.select("hub", "sid", "n", "c", "size", "near", "lone", "short", F.posexplode(F.slice("d", F.lit(1), F.col("to").cast("int"))).alias("k", "g"))
    rows = rows.withColumn("early", F.col("k") < F.col("short")).drop("short")
    names = {y: f"o_{y}" for y in ("sid", "n", "c", "size", "near", "lone", "k")}
    other = rows.where("early").drop("early").withColumnsRenamed(names)
    room = F.least(F.col("size") - F.col("k"), F.col("o_size") - F.col("o_k"))  # k counts from 0
    enough = 2 * whole * room >= whole * (F.col("size") + F.col("o_size")) - q * (F.col("n") + F.col("o_n"))
    once = ~F.col("o_lone") | (F.col("early") & (F.col("sid") < F.col("o_sid")))
    sizes = 100 * F.least("n", "o_n") >= percent * F.greatest("n", "o_n")
    met = (F.col("c") != F.col("o_c")) & (F.col("near") | F.col("o_near")) & sizes & enough & once
    return rows.where("lone").join(other, ["hub", "g"]).where(met).select("sid", "n", F.col("o_sid").alias("o"), F.col("o_n").alias("on"))


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links), set_id."""
    spark = docs.sparkSession
    small_batches(spark)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    classes = spark.sparkContext.broadcast(frequency_classes(base, width))
    sets = persisted(base.mapInArrow(_sets(width, percent, classes), SETS), "sets")
    lead = sets.where("h is not null").select("sid", "n", F.posexplode("h").alias("k", "g")).withColumn("k", F.col("k") + 1)
    # copies of a set in other tasks count as others at first
    some = persisted(_shared(lead).distinct(), "leading")
    rows = persisted(_shared(some), "leading")
    removed(some)

    leads = persisted(rows.groupBy("sid").agg(F.collect_list("g").alias("h")), "leads")
    ones = persisted(sets.where("n > 0").groupBy("sid").agg(F.min("doc_id").alias("doc_id")), "ones")
    bit = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS))

    def enough(pairs: DataFrame) -> DataFrame:
        """Pairs that share enough leading shingles."""
        x = pairs.join(leads.select(F.col("sid").alias("a"), F.col("h").alias("ha")), "a").join(leads.select(F.col("sid").alias("b"), F.col("h").alias("hb")), "b")
        return x.withColumn("shared", F.size(F.array_intersect("ha", "hb"))).where(_enough("shared", percent)).select("a", "b", "both")

    def whole(ids: DataFrame) -> DataFrame:
        """Segments of the whole sets: one text of each is read again."""
        bits = ones.join(ids, "sid", "left_semi").select(bit.alias("b"))
        bits = bits.groupBy(F.shiftright("b", 3).alias("at")).agg(F.bit_or(F.expr("shiftleft(1, cast(b & 7 as int))")).alias("v")).toArrow()
        wanted = np.zeros(FILTER_BITS // 8, np.uint8)
        wanted[bits["at"].to_numpy()] = bits["v"].to_numpy().astype(np.uint8)
        shared = spark.sparkContext.broadcast(wanted)
        return persisted(base.select("text", bit.alias("bit")).mapInArrow(_segments(width, shared), "sid long, f int, h array<long>"), "segments")

    def linked(pairs: DataFrame, segments: DataFrame) -> DataFrame:
        """Pairs of sets that are similar."""
        found = overlaps(pairs.select("a", "b"), segments).join(pairs, ["a", "b"])
        return found.where((100 + percent) * F.col("n") >= percent * F.col("both")).select("a", "b")

    def merged(found: DataFrame, roots: DataFrame) -> DataFrame:
        """The components with more links. Those so far count as stars, whatever links made them."""
        return components(found.unionByName(roots.where("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b"))))

    def open_rows(roots: DataFrame) -> DataFrame:
        """Rows of shingles that more than one component has."""
        now = rows.join(roots, rows["sid"] == roots["id"], "left").select(*rows.columns, F.coalesce("root", "sid").alias("c"))
        mixed = now.groupBy("g").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 <> c1").select("g")
        return persisted(now.join(mixed, "g", "left_semi"), "open")

    # known to be empty, these fall out of the plans that they stand in
    none = spark.range(0).select(F.col("id").alias("a"), F.col("id").alias("b")).where(F.lit(False))
    tested, links, roots = none, none, none.toDF("id", "root")
    for turn in range(ROUNDS):
        # at first each set is a component, and each shingle has two or more
        now = open_rows(roots) if turn else rows.withColumn("c", F.col("sid"))
        # first the row whose set has least of its own before the shingle, which lies nearest to the
        # middle of a group; then others, by a number that changes with the round
        pick = F.xxhash64("sid", F.lit(turn)) if turn else F.struct("k", "sid")
        star = now.groupBy("g").agg(F.min_by(F.struct("sid", "n", "k", "c"), pick).alias("s"))
        pairs = now.join(star, "g").where("c <> s.c").select("sid", "n", "k", F.col("s.sid").alias("o"), F.col("s.n").alias("on"), F.col("s.k").alias("ok"))
        pairs = enough(_pairs(pairs.where(_fits(percent) & _first(percent))).select("a", "b", "both", "n", "on").distinct())
        pairs = persisted(pairs.join(tested, ["a", "b"], "left_anti"), "pairs")
        if not pairs.isEmpty():
            segments = whole(pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct())
            found = persisted(linked(pairs, segments), "links")
            removed(segments)
            links, roots = links.unionByName(found), merged(found, roots)
        tested = tested.unionByName(pairs.select("a", "b"))
        if turn:
            removed(now)

    now = open_rows(roots)
    if not now.isEmpty():
        main = now.groupBy("g", "c").agg(F.count("*").alias("m")).groupBy("g").agg(F.max(F.struct("m", "c")).alias("x")).select("g", F.col("x.c").alias("main"), "x.m")
        ends = links.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("links"))
        hubs = ends.join(roots, "id").groupBy("root").agg(F.max_by("id", F.struct("links", "id")).alias("hub"))
        main = main.join(hubs, F.col("main") == F.col("root"), "left").select(
            "g", "main", F.when(F.col("m") > SMALL, F.col("hub")).alias("hub")
        )
        last = persisted(now.join(main, "g"), "last")
        removed(now)
        large = last.where("hub is not null")
        at = large.where("sid <> hub").select("sid", "n", "c", "hub", (F.col("c") != F.col("main")).alias("apart")).distinct()
        segments = whole(large.select(F.explode(F.array("sid", "hub")).alias("sid")).distinct())
        from_hub = persisted(_differences(at, segments.dropDuplicates(["sid", "f"]), percent).where("mid"), "differences")
        removed(segments)
        near = _pairs(_by_difference(from_hub, percent)).select("a", "b", "both").distinct()
        far = large.where("sid <> hub").join(from_hub.where("near").select("sid", "hub"), ["sid", "hub"], "left_anti").select(*last.columns)
        # one plan for all of this has so many stages under way at once that the driver's memory grows by them
        left = persisted(last.where("hub is null").unionByName(far), "left")
        other = left.select("g", F.col("sid").alias("o"), F.col("n").alias("on"), F.col("k").alias("ok"), F.col("c").alias("oc"))
        meet = (F.col("c") != F.col("oc")) & ((F.col("oc") == F.col("main")) | (F.col("sid") < F.col("o"))) & _fits(percent) & _first(percent)
        apart = persisted(enough(_pairs(left.where("c <> main").join(other, "g").where(meet)).select("a", "b", "both", "n", "on").distinct()), "apart")
        removed(left)
        pairs = persisted(near.unionByName(apart).distinct().join(tested, ["a", "b"], "left_anti"), "pairs")
        to_hub = from_hub.where("apart and similar").select(F.least("sid", "hub").alias("a"), F.greatest("sid", "hub").alias("b"))
        segments = whole(pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct())
        found = persisted(linked(pairs, segments).unionByName(to_hub), "links")
        removed(last, segments, from_hub, apart, pairs)
        roots = merged(found, roots)
    removed(leads, rows)
    mine = sets.select("doc_id", "n", "sid").join(roots, F.col("sid") == F.col("id"), "left").select(
        "doc_id", "n", "sid", F.coalesce("root", "sid").alias("c")
    )
    # an empty set stands alone: its own id, whatever other empty sets there are
    least = mine.where("n > 0").groupBy("c").agg(F.min("doc_id").alias("least"))
    return mine.join(least, "c", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"),
        F.col("sid").alias("set_id"),
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs whose id is the smallest of its component; of rows with equal id and text one
    stays. Rows without an id stay where no id is in their component."""
    best = near_components(docs).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    k, t = unused(docs, "key", "text_hash")
    best = best.select(key.alias(k)).distinct()
    found = docs.withColumns({k: key, t: F.xxhash64("text")}).join(best, k, "left_semi")
    return found.dropDuplicates([k, t]).select(*docs.columns)
