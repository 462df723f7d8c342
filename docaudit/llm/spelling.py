"""Spelling variants: words one edit apart, by a bit-sliced index of letters at positions.

A block of the vocabulary is held as bit sets, one for each position and letter, with a bit for each word. A query
word walks over its letters and keeps three sets of words at once: those that agree so far (zero errors), those that
differ in one letter (one error, positions as they are) and those that have one letter more (one error, positions
shifted by one). Each step is a few AND and OR over whole sets.

Two words one edit apart agree in the first or in the last half of the shorter one. Words are therefore dealt by
length and half, as queries to the words of their length and of one letter more; a pair that agrees in both halves
counts at the first. Groups over BLOCK words are cut into blocks of the index and chunks of queries, every chunk
meeting every block, so that no task holds a whole group and no pair is lost.

Defined results: null and empty texts have no words; a null id counts as empty text in the slips' checksum; repeated
rows count each; an empty table gives an empty result; ties of n go to the word smallest by code points; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docaudit.llm.blockjoin import meet
from docaudit.llm.common import partitions, persisted, removed

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of a block of the index, and queries of a chunk.
BLOCK = 4096


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 6, min_count: int = 5, slip: int = 199) -> DataFrame:
    """word, n: runs of Latin letters, A-Z folded, of at least min_length code points and min_count occurrences. A
    run whose crc32 of `<doc_id>:<run>` slip divides loses one code point, as a typing error would."""
    runs = F.regexp_extract_all(F.translate(F.col(text_col), UPPER, LOWER), F.lit(f"[a-zÀ-ÿ]{{{min_length},}}+"), F.lit(0))
    x = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    x = x.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    word = F.when(F.col("h") % slip == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))).otherwise(F.col("run"))
    x = x.select(word.alias("word")).where(F.length("word") >= min_length)
    return x.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


class Sliced:
    """Bit sets of a block of words by position and letter, from position skip on; words are turned round where
    they share their end."""

    def __init__(self, words: list[str], counts: list[int], size: int, skip: int, turned: bool):
        self.words, self.counts, self.size, self.skip, self.turned = words, counts, size, skip, turned
        self.letters: dict[tuple[int, str], int] = {}
        self.heads: dict[str, int] = {}  # words by the half that another group finds them by
        self.equal = self.longer = 0
        for i, word in enumerate(words):
            bit = 1 << i
            if len(word) == size:
                self.equal |= bit
            else:
                self.longer |= bit
            if turned:
                self.heads[word[:skip]] = self.heads.get(word[:skip], 0) | bit
                word = word[::-1]
            for p in range(skip, len(word)):
                key = p, word[p]
                self.letters[key] = self.letters.get(key, 0) | bit

    def near(self, word: str) -> int:
        """Words one edit from a word of size letters that shares the group's half: of its length, or one longer."""
        agree, changed, more = self.equal | self.longer, 0, 0
        spelt = word[::-1] if self.turned else word
        letters = self.letters
        for i in range(self.skip, self.size):
            here, next_ = letters.get((i, spelt[i]), 0), letters.get((i + 1, spelt[i]), 0)
            changed = (changed & here) | (agree & ~here)
            more = (more | agree) & next_
            agree &= here
            if not (agree | changed | more):
                break
        found = (changed & self.equal) | ((more | agree) & self.longer)
        return found & ~self.heads.get(word[: self.skip], 0) if self.turned else found


def _answer(unit_rows, asked):
    if asked is None:
        size, side = unit_rows["size"][0].as_py(), unit_rows["side"][0].as_py()
        return Sliced(unit_rows["word"].to_pylist(), unit_rows["n"].to_pylist(), size, size // 2, side == 1)
    return _found(unit_rows, asked["word"].to_pylist(), asked["n"].to_pylist())


def _found(index: Sliced, words: list[str], counts: list[int]) -> Iterator[pa.RecordBatch]:
    """For each word with near words in the block, and each longer word of the block that a query is near: their
    number and the best of them."""
    best: dict[str, tuple[int, int, str]] = {}

    def note(word: str, n: int, other: str) -> None:
        old = best.get(word)
        best[word] = (1, -n, other) if old is None else (old[0] + 1, *min(old[1:], (-n, other)))

    for word, n in zip(words, counts, strict=True):
        found = index.near(word)
        while found:
            bit = found & -found
            i = bit.bit_length() - 1
            note(word, index.counts[i], index.words[i])
            if bit & index.longer:
                note(index.words[i], n, word)
            found ^= bit
    yield pa.RecordBatch.from_arrays(
        [pa.array(best.keys(), pa.string()), *(pa.array([b[k] for b in best.values()], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string())))],
        ["word", "n_near", "minus", "other"],
    )


def near_words(words: DataFrame) -> DataFrame:
    """word, n -> word, n_near, best (struct of minus n and word: the near word of largest n), partial by block; to be
    summed by word."""
    size = F.length("word")

    def member(longer: int) -> list:
        k = ((size - longer) / 2).cast("int")
        return [
            F.struct((size - longer).alias("size"), F.lit(0).alias("side"), F.substring("word", F.lit(1), k).alias("piece")),
            F.struct((size - longer).alias("size"), F.lit(1).alias("side"), F.substring("word", size - k + 1, k).alias("piece")),
        ]

    index = words.select("word", "n", F.explode(F.array(*member(0), *member(1))).alias("g")).select("word", "n", "g.*").where("size > 0")
    asks = words.select("word", "n", F.explode(F.array(*member(0))).alias("g")).select("word", "n", "g.*")
    group = ["size", "side", "piece"]
    large = index.groupBy(*group).agg(F.count("*").alias("rows")).where(F.col("rows") > BLOCK)
    cut = F.ceil(F.coalesce("rows", F.lit(1)) / F.lit(BLOCK)).cast("int")
    index, asks = (x.join(large, group, "left").withColumn("cuts", cut) for x in (index, asks))
    mine, every = F.pmod(F.xxhash64("word"), "cuts").cast("int"), F.explode(F.sequence(F.lit(0), F.col("cuts") - 1))
    index = index.withColumn("block", mine).withColumn("chunk", every)
    asks = asks.withColumn("chunk", mine).withColumn("block", every)
    columns = ["word", "n", *group, "block", "chunk"]
    unit = [*group, "block", "chunk"]
    found = meet(index.select(*columns), asks.select(*columns), unit, _answer, "word string, n_near long, minus long, other string", partitions(words.sparkSession))
    return found.select("word", "n_near", F.struct("minus", "other").alias("best"))


def forms(words: DataFrame, ratio: int = 5) -> DataFrame:
    """word, n -> word, n, n_near, form, form_n."""
    own = words.select("word", F.col("n"), F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("struct<minus:long,other:string>").alias("best"))
    near = near_words(words).select("word", F.lit(None).cast("long").alias("n"), "n_near", "best")
    x = own.unionByName(near).groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), F.min("best").alias("best"))
    takes = -F.col("best.minus") >= ratio * F.col("n")
    return x.select("word", "n", "n_near", F.when(takes, F.col("best.other")).alias("form"), F.when(takes, -F.col("best.minus")).alias("form_n"))


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 6, min_count: int = 5, ratio: int = 5, slip: int = 199) -> DataFrame:
    """word, form, root, n, n_near, form_n for each word of the vocabulary (see vocabulary). root is where the forms
    lead to; as n grows at least ratio times from word to form, its search ends after few rounds, in each of which
    the words whose root has a form look one step twice as far."""
    words = persisted(vocabulary(docs, id_col, text_col, min_length, min_count, slip), "words")
    found = persisted(forms(words, ratio), "forms")
    removed(words)
    return with_roots(found)


def with_roots(found: DataFrame) -> DataFrame:
    """Adds root to word, form: pointers doubled until none has a form of its own. Only words with a form take part."""
    ends, hops = None, persisted(found.where("form is not null").select("word", F.col("form").alias("root")), "hops")
    while True:
        far = hops.alias("a").join(hops.alias("b"), F.col("a.root") == F.col("b.word"), "left").select(
            F.col("a.word").alias("word"), F.coalesce("b.root", "a.root").alias("root"), F.col("b.root").isNotNull().alias("moved"))
        far = persisted(far, "hops")
        moved = far.where("moved").limit(1).count()
        removed(hops)
        hops = far.drop("moved")
        if not moved:
            ends = hops
            break
    x = found.unionByName(ends.select("word", F.lit(None).cast("string").alias("form"), "root"), allowMissingColumns=True)
    x = x.groupBy("word").agg(*[F.max(c).alias(c) for c in ("form", "root", "n", "n_near", "form_n")])
    return x.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
