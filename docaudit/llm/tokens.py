"""Token-id output as a content-addressed store.

Each text's ids (with an end id) are cut into chunks where a rolling hash of the last 32 ids matches a
mask, so that equal passages give equal chunks wherever they stand. A chunk's address is the BLAKE2b
digest of its bytes. A store is a folder:

  raw/            kind=chunk: address and ids (little-endian, 2 bytes an id where all fit, else 4),
                  each address once; kind=recipe: what a document is made of
  recipes/        a row for each document in ascending id order: id, ids before it, ids, the chunks'
                  addresses in order, Merkle root of these; file n holds the n-th range of ids
  manifest/       a row for each range: Merkle root over its documents' roots, documents, ids

read_back() verifies every chunk against its address, every recipe against its root and every range
against the manifest, and gives each document's position, length and CRC-32 (by CRC combination of its
chunks, which is exact); documents() rebuilds the ids themselves.

Defined results: null text has only the end id; rows with equal ids stand one after the other in the
order of their roots; null ids come first; an empty table gives an empty store; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docaudit.llm.common import BATCH_ROWS, new_path, partitions, small_batches

END_ID = 1
#: Chunks end where the hash has MASK_BITS zero bits, after at least LEAST ids and at most MOST.
MASK_BITS, LEAST, MOST, WINDOW = 9, 64, 4096, 32
#: Stems and other words whose ids a worker keeps from texts to texts; of a full table the half used last stays. Longer
#: ones aren't kept, so both numbers bound bytes as well.
HELD_STEMS, HELD_WORDS, HELD_LENGTH = 200_000, 100_000, 40
#: Bytes of texts that are encoded at once; a longer text stands alone.
AT_ONCE = 4_000_000
# Normalizers and pre-tokenizers of a file whose words may be encoded one by one.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
PRE_TOKENIZERS = [
    {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]
_GEAR = np.random.default_rng(20240301).integers(0, 2**32, 1 << 16, dtype=np.uint32)
# Letters, then signs of ASCII but the apostrophe, which begins pieces with letters in them.
_LETTERS, _SIGNS = "[A-Za-zÀ-ÖØ-öø-ÿ]", r"[!-&(-/:-@\[-`{-~]"
_LETTERS_LIST, _SIGNS_LIST = ("".join(c for c in map(chr, range(256)) if re.fullmatch(x, c)) for x in (_LETTERS, _SIGNS))
_BYTE = {b: chr(b) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174 else None for b in range(256)}
_encoders: dict[str, Encoder] = {}


def _word_wise(file: dict) -> bool:
    """Whether the file cuts and folds texts as the quick way does; any other goes to the tokenizer as a whole."""
    model = file["model"]
    plain = model["type"] == "BPE" and model["end_of_word_suffix"] == "</w>" and not (model["dropout"] or model["unk_token"] or model["ignore_merges"])
    cuts = file["pre_tokenizer"] or {}
    added = all(t["special"] and not re.search(r"\s", t["content"]) and not re.fullmatch(f"{_LETTERS}*{_SIGNS}*", t["content"]) for t in file["added_tokens"])
    return plain and added and (file["normalizer"] or {}).get("normalizers") == NORMALIZERS and cuts.get("pretokenizers") == PRE_TOKENIZERS


def _gather(ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Runs of ids, one after the other."""
    ends = np.cumsum(sizes)
    return ids[np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]


class _Held:
    """Ids by key, in flat arrays; what isn't held is made. The keys of one call are distinct."""

    def __init__(self, make: Callable[[str], list[int]], most: int):
        self.make, self.most, self.calls = make, most, 0
        self.keys, self.ids = pa.array([], pa.string()), np.zeros(0, np.uint32)
        self.sizes, self.used = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def find(self, keys: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and where in them each key's start and how many it has."""
        at = pc.index_in(keys, value_set=self.keys).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        new = np.flatnonzero(at < 0)
        made = [self.make(k) for k in keys.take(pa.array(new)).to_pylist()]
        at[new] = len(self.keys) + np.arange(len(new))
        self.keys = pa.concat_arrays([self.keys, keys.take(pa.array(new))])
        self.ids = np.concatenate([self.ids, np.fromiter(itertools.chain.from_iterable(made), np.uint32)])
        self.sizes = np.concatenate([self.sizes, np.fromiter(map(len, made), np.int64)])
        self.used = np.concatenate([self.used, np.zeros(len(new), np.int64)])
        self.calls += 1
        self.used[at] = self.calls
        starts = np.cumsum(self.sizes) - self.sizes
        found = self.ids, starts[at], self.sizes[at]
        self._trim(starts)
        return found

    def _trim(self, starts: np.ndarray) -> None:
        stay = pc.less_equal(pc.utf8_length(self.keys), HELD_LENGTH).to_numpy(zero_copy_only=False)
        if stay.sum() > self.most:
            stay[np.argsort(np.where(stay, -self.used, 0), kind="stable")[self.most // 2 :]] = False
        if not stay.all():
            self.ids = _gather(self.ids, starts[stay], self.sizes[stay])
            self.keys, self.sizes, self.used = self.keys.filter(pa.array(stay)), self.sizes[stay], self.used[stay]


class Encoder:
    """Text -> ids as little-endian uint32, equal to encode(text, add_special_tokens=False) of the tokenizer
    in that file: its pieces never span white space, so each distinct word is encoded once. Words of plain
    Latin letters are one piece each (then signs another) and go straight to the model, whatever their case."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        merge = tok.model.tokenize
        spare = {b: c for b, c in zip((b for b in range(256) if _BYTE[b] is None), map(chr, range(256, 512)))}
        letters = str.maketrans({b: _BYTE[b] or spare[b] for b in range(256)})

        def whole(text: str) -> list[int]:
            return tok.encode(text, add_special_tokens=False).ids

        def merged(stem: str) -> list[int]:
            return [t.id for t in merge(stem if stem.isascii() else stem.encode().decode("latin-1").translate(letters))]

        self.word_wise, self.whole = _word_wise(json.loads(tok.to_str())), whole
        self.stems, self.others = _Held(merged, HELD_STEMS), _Held(whole, HELD_WORDS)

    def __call__(self, text: str) -> bytes:
        return self.all(pa.array([text], pa.string()))[0].tobytes()

    def all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (null: empty), one after the other, and how many each has."""
        texts = texts.cast(pa.string()).fill_null("")
        if not self.word_wise:
            parts = [self.whole(t) for t in texts.to_pylist()]
            return np.fromiter(itertools.chain.from_iterable(parts), np.uint32), np.fromiter(map(len, parts), np.int64)
        split = pc.ascii_split_whitespace(texts)
        words = split.flatten().dictionary_encode()
        ids, sizes = self._words(words.dictionary)
        at = words.indices.to_numpy()
        upto = np.concatenate([[0], np.cumsum(sizes[at])])
        ends = np.cumsum(pc.list_value_length(split).to_numpy())
        return _gather(ids, (np.cumsum(sizes) - sizes)[at], sizes[at]), np.diff(upto[ends], prepend=0)

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """As all(), of distinct words: a plain one is its stem's ids, then its signs'."""
        stem = pc.utf8_rtrim(words, characters=_SIGNS_LIST)
        plain = pc.match_substring_regex(stem, f"^{_LETTERS}+$")
        parts = [pc.if_else(plain, pc.utf8_lower(stem), words), pc.if_else(plain, pc.utf8_ltrim(words, characters=_LETTERS_LIST), "")]
        keys = pa.concat_arrays(parts).dictionary_encode()
        first, then = keys.indices.to_numpy().reshape(2, -1)
        is_stem = np.zeros(len(keys.dictionary), bool)
        is_stem[first[plain.to_numpy(zero_copy_only=False)]] = True
        stems, starts, sizes = self.stems.find(keys.dictionary.filter(pa.array(is_stem)))
        others, starts_, sizes_ = self.others.find(keys.dictionary.filter(pa.array(~is_stem)))
        start, size = np.zeros(len(is_stem), np.int64), np.zeros(len(is_stem), np.int64)
        start[is_stem], size[is_stem] = starts, sizes
        start[~is_stem], size[~is_stem] = starts_ + len(stems), sizes_
        both = np.stack([first, then], 1).ravel()
        return _gather(np.concatenate([stems, others]), start[both], size[both]), size[first] + size[then]


def encoder(path: str) -> Encoder:
    """The encoder of a file, which keeps what it has met until the stage is over."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def cut(ids: np.ndarray, streams: np.ndarray | None = None) -> np.ndarray:
    """Ends of the chunks of streams of ids that lie one after the other (streams: their ends; by default one). The hash
    of a place sums table values of the last 32 ids, each shifted by its distance, so it depends on these ids alone; no chunk
    is so short that they reach into another stream."""
    n = len(ids)
    h = _GEAR[ids & 0xFFFF] ^ (ids >> np.uint32(16))
    step = 1
    while step < WINDOW:
        shifted = np.zeros(n, np.uint32)
        if step < n:
            shifted[step:] = h[: n - step] << np.uint32(step)
        h = h + shifted
        step *= 2
    marks = np.flatnonzero((h >> np.uint32(32 - MASK_BITS)) == 0) + 1
    ends, at = [], 0
    last = set([n] if streams is None else streams.tolist())
    for m in sorted(last | set(marks.tolist())):
        while m - at > MOST:
            at += MOST
            ends.append(at)
        if m - at >= LEAST or (m in last and m > at):
            ends.append(m)
            at = m
    return np.array(ends, np.int64)


def merkle(parts: list[bytes]) -> bytes:
    """Root of a binary tree of BLAKE2b digests; a leaf is hashed apart from a pair."""
    level = [hashlib.blake2b(b"\0" + p, digest_size=16).digest() for p in parts] or [bytes(16)]
    while len(level) > 1:
        level = [
            hashlib.blake2b(b"\1" + level[i] + level[i + 1], digest_size=16).digest() if i + 1 < len(level) else level[i]
            for i in range(0, len(level), 2)
        ]
    return level[0]


#: A recipe's chunks column as an array of addresses.
ADDRESSES = "transform(sequence(0, cast(length(chunks) div 16 as int) - 1), i -> substring(chunks, i * 16 + 1, 16))"
RAW = "kind string, address binary, ids binary, doc_id long, n long, chunks binary, root binary"


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Rows from and to, of AT_ONCE bytes at most or one row."""
    lo, held = 0, 0
    for i, size in enumerate(pc.binary_length(texts).fill_null(0).to_pylist()):
        if held and held + size > AT_ONCE:
            yield lo, i
            lo, held = i, 0
        held += size
    if len(texts):
        yield lo, len(texts)


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Small batches become one, of AT_ONCE bytes of texts at most and until it has BATCH_ROWS rows."""
    held: list[pa.RecordBatch] = []
    size = rows = 0
    for b in batches:
        more = b.column("text").nbytes
        alone = more > AT_ONCE or b.num_rows >= BATCH_ROWS
        if held and (alone or size + more > AT_ONCE or rows >= BATCH_ROWS):
            yield pa.concat_batches(held)
            held, size, rows = [], 0, 0
        if alone:
            yield b
            continue
        held.append(b)
        size, rows = size + more, rows + b.num_rows
    if held:
        yield pa.concat_batches(held)


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = encoder(path)
        sent: set[bytes] = set()
        part, nth = TaskContext.get().partitionId().to_bytes(8), 0

        for batch in _together(batches):
            chunks: list[tuple] = []
            rows: list[tuple] = []

            def out() -> pa.RecordBatch:
                cols = list(zip(*[*chunks, *rows]))
                arrays = [pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.binary()))]
                chunks.clear(), rows.clear()
                return pa.RecordBatch.from_arrays(arrays, names=["kind", "address", "ids", "doc_id", "n", "chunks", "root"])

            held = 0
            for lo, hi in _slices(batch.column("text")):
                ids, counts = encode.all(batch.column("text")[lo:hi])
                ids = np.insert(ids, np.cumsum(counts), END_ID)
                ends = np.cumsum(counts + 1)
                wide = np.maximum.reduceat(ids, ends - counts - 1) >> 16 > 0
                small, at, cuts = ids.astype("<u2"), 0, iter(cut(ids, ends).tolist())
                for doc_id, last, is_wide, n in zip(batch.column("doc_id")[lo:hi].to_pylist(), ends.tolist(), wide.tolist(), (counts + 1).tolist()):
                    addresses, of = [], ids if is_wide else small
                    while at < last:
                        end = next(cuts)
                        data = of.dtype.itemsize.to_bytes(1) + of[at:end].tobytes()
                        address = hashlib.blake2b(data, digest_size=16).digest()
                        addresses.append(address)
                        if address not in sent:
                            if len(sent) > 50_000:
                                sent.clear()
                            sent.add(address)
                            chunks.append(("chunk", address, data, None, end - at, None, None))
                            held += len(data)
                        at = end
                    nth += 1  # a recipe's key: 17 bytes, so never a digest, and the same when the task runs again
                    rows.append(("recipe", b"r" + part + nth.to_bytes(8), None, doc_id, n, b"".join(addresses), merkle(addresses)))
                if held > 4_000_000:
                    yield out()
                    held = 0
            if rows:
                yield out()
            pa.default_memory_pool().release_unused()

    return run


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Within a sorted range: its number, ids and documents before each row."""
    from pyspark import TaskContext

    _encoders.clear()  # workers are used again; the words of the stage before lie in their memory
    part, before, nth = TaskContext.get().partitionId(), 0, 0
    for b in batches:
        ends = np.cumsum(b.column("n").to_numpy())
        if len(ends):
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(np.full(len(ends), part)), pa.array(before + ends - b.column("n").to_numpy()), pa.array(nth + np.arange(len(ends)))],
                names=[*b.schema.names, "range", "before", "nth"],
            )
            before, nth = before + int(ends[-1]), nth + len(ends)


def _manifest(table: pa.Table) -> pa.Table:
    table = table.sort_by("nth")
    root = merkle(table["root"].to_pylist())
    return pa.table({
        "range": pa.array([table["range"][0].as_py()], pa.int64()), "root": pa.array([root], pa.binary()),
        "documents": pa.array([table.num_rows], pa.int64()), "ids": pa.array([pc.sum(table["n"]).as_py()], pa.int64()),
    })


MANIFEST = "range long, root binary, documents long, ids long"


def write_store(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Writes the store of all texts; equal chunks meet in one shuffle of what each task found new."""
    spark = docs.sparkSession
    small_batches(spark)
    raw = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_encode(tokenizer), RAW)
    # recipes have addresses of their own; a chunk's copies share one
    raw = raw.repartition(partitions(spark), "address").dropDuplicates(["address"])
    raw.write.partitionBy("kind").parquet(f"{path}/raw")
    recipes = spark.read.schema(RAW).parquet(f"{path}/raw").where("kind = 'recipe'").select("doc_id", "n", "chunks", "root")
    by = recipes.repartitionByRange(partitions(spark), F.col("doc_id").asc_nulls_first(), "root")
    by = by.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "root").mapInArrow(_ranges, "doc_id long, n long, chunks binary, root binary, range long, before long, nth long")
    by.write.parquet(f"{path}/recipes")
    rows = spark.read.parquet(f"{path}/recipes")
    rows.select("range", "nth", "n", "root").groupBy("range").applyInArrow(_manifest, MANIFEST).write.parquet(f"{path}/manifest")
    return path


def _crc_shift() -> list[np.ndarray]:
    """For k: the images of each byte of a CRC (4 x 256) under 2^k zero bytes."""
    one = np.zeros(32, np.uint32)
    one[0] = 0xEDB88320
    one[1:] = [1 << i for i in range(31)]
    value = np.arange(256)

    def tables(m: np.ndarray) -> np.ndarray:
        """From the images of the 32 bits to those of the bytes."""
        out = np.zeros((4, 256), np.uint32)
        for i in range(32):
            out[i // 8] ^= np.where(value >> (i % 8) & 1 == 1, m[i], np.uint32(0))
        return out

    def square(m: np.ndarray) -> np.ndarray:
        return _shifted(m, tables(m))

    m = square(square(square(one)))
    out = []
    for _ in range(40):
        out.append(tables(m))
        m = square(m)
    return out


def _shifted(crc: np.ndarray, table: np.ndarray) -> np.ndarray:
    return table[0][crc & 255] ^ table[1][crc >> 8 & 255] ^ table[2][crc >> 16 & 255] ^ table[3][crc >> 24]


def crc_combine(crc: np.ndarray, size: np.ndarray, count: np.ndarray, shift: list[np.ndarray]) -> np.ndarray:
    """CRC-32 of each run of parts (count: parts of each run, none of 0) from the parts' CRCs and bytes: a part's CRC is moved
    by the bytes that follow it in its run, and those of a run are added."""
    crc, ends = crc.astype(np.uint32), np.cumsum(count)
    upto = np.cumsum(size)
    after = np.repeat(upto[ends - 1], count) - upto
    for k in range(int(after.max(initial=0)).bit_length()):
        on = after >> k & 1 == 1
        crc[on] = _shifted(crc[on], shift[k])
    return np.bitwise_xor.reduceat(crc, ends - count) if len(crc) else crc


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    _encoders.clear()
    for b in batches:
        good, crc, n = [], [], []
        for address, data in zip(b.column("address").to_pylist(), b.column("ids").to_pylist()):
            if hashlib.blake2b(data, digest_size=16).digest() != address:
                raise ValueError(f"chunk {address.hex()} doesn't match its address")
            ids = np.frombuffer(data, "<u2" if data[0] == 2 else "<u4", offset=1)
            good.append(address)
            crc.append(zlib.crc32(ids.astype("<u4").tobytes()))
            n.append(len(ids))
        yield pa.RecordBatch.from_arrays([pa.array(good, pa.binary()), pa.array(crc, pa.int64()), pa.array(n, pa.int64())], names=["address", "crc", "m"])


def _document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a document with its chunks' CRCs and lengths in order -> its CRC and length."""
    _encoders.clear()
    shift = _crc_shift()
    for b in batches:
        crcs, sizes, addresses = b.column("crcs"), b.column("sizes"), b.column("chunks").to_pylist()
        count = pc.list_value_length(crcs).to_numpy(zero_copy_only=False)
        flat = sizes.flatten().to_numpy()
        total = np.zeros(b.num_rows, np.int64)
        total[count > 0] = crc_combine(crcs.flatten().to_numpy(), 4 * flat, count[count > 0], shift)
        upto = np.concatenate([[0], np.cumsum(flat)])
        ends = np.cumsum(count)
        long = upto[ends] - upto[ends - count]
        for i, root in enumerate(b.column("root").to_pylist()):
            if merkle([addresses[i][j : j + 16] for j in range(0, len(addresses[i]), 16)]) != root or long[i] != b.column("n")[i].as_py():
                raise ValueError("a recipe doesn't match its root")
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), b.column("start"), b.column("n"), pa.array(total), b.column("root")],
            names=["doc_id", "start", "n_tokens", "ids_crc32", "root"],
        )


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """recipes with `start`, the ids of all documents before; checked against the manifest."""
    rows = spark.read.parquet(f"{path}/recipes")
    manifest = spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    again = rows.select("range", "nth", "n", "root").groupBy("range").applyInArrow(_manifest, MANIFEST)
    if not again.exceptAll(manifest).isEmpty() or not manifest.exceptAll(again).isEmpty():
        raise ValueError("a range of recipes doesn't match the manifest")
    starts, total = [], 0
    for r in manifest.select("range", "ids").orderBy("range").collect():  # as many rows as ranges, which is a setting
        starts.append((r["range"], total))
        total += r["ids"]
    offsets = spark.createDataFrame(starts, "range long, base long")
    return rows.join(F.broadcast(offsets), "range").withColumn("start", F.col("before") + F.col("base"))


def read_back(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, root of every document, from the store's files alone. Chunks'
    CRCs and lengths go to the recipes, not their ids."""
    rows = read_store(spark, path)
    chunks = spark.read.schema(RAW).parquet(f"{path}/raw").where("kind = 'chunk'").select("address", "ids").mapInArrow(_verify, "address binary, crc long, m long")
    places = rows.select(
        "range", "nth", F.posexplode(F.expr(ADDRESSES)).alias("k", "address")
    )
    found = places.join(chunks, "address").groupBy("range", "nth").agg(F.array_sort(F.collect_list(F.struct("k", "crc", "m"))).alias("x"))
    full = rows.join(found, ["range", "nth"], "left").select(
        "doc_id", "start", "n", "root", "chunks", F.coalesce("x.crc", F.expr("cast(array() as array<long>)")).alias("crcs"), F.coalesce("x.m", F.expr("cast(array() as array<long>)")).alias("sizes")
    )
    return full.mapInArrow(_document, "doc_id long, start long, n_tokens long, ids_crc32 long, root binary")


def documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, ids (array) of every document, rebuilt from its chunks."""
    rows = read_store(spark, path)
    chunks = spark.read.schema(RAW).parquet(f"{path}/raw").where("kind = 'chunk'").select("address", "ids")
    places = rows.select(
        "range", "nth", "doc_id", F.posexplode(F.expr(ADDRESSES)).alias("k", "address")
    )

    def joined(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            ids = [np.concatenate([np.frombuffer(d, "<u2" if d[0] == 2 else "<u4", offset=1).astype(np.int64) for d in x]) for x in b.column("parts").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.list_(pa.int64()))], names=["doc_id", "ids"])

    full = places.join(chunks, "address").groupBy("range", "nth", "doc_id").agg(F.array_sort(F.collect_list(F.struct("k", "ids"))).alias("x"))
    return full.select("doc_id", F.col("x.ids").alias("parts")).mapInArrow(joined, "doc_id long, ids array<long>")


def token_output(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes a store in the shared folder and reads it back."""
    path = write_store(docs, new_path(docs.sparkSession, "tokens"), tokenizer, id_col, text_col)
    return read_back(docs.sparkSession, path)
