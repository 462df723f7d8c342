"""Licence scan, spelling variants, hard negatives and the estimates of quality rules against brute force."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from docaudit.llm import licences, negatives, quality, spelling, tokens

FOLD = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ("n", "word", "size", "block", "chunk", "phrases", "spans", "v", "label_", "best", "_asks")


def docs_of(spark, texts):
    x = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in texts], SCHEMA)
    return x.select("*", *[F.lit(1).alias(c) for c in CLASH])


# ---- licences

def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(FOLD))


def longest(words, sequences):
    """By force: for each place, the longest stretch that ends there and stands in some sequence."""
    stands = {tuple(s[a:b]) for s in sequences for a in range(len(s)) for b in range(a + 1, len(s) + 1)}
    return [max((n for n in range(1, i + 2) if tuple(words[i + 1 - n : i + 1]) in stands), default=0) for i in range(len(words))]


def test_automaton_tells_the_longest_match():
    rnd = random.Random(5)
    for _ in range(60):
        sequences = [[rnd.randrange(3) for _ in range(rnd.randint(1, 9))] for _ in range(rnd.randint(1, 4))]
        machine = licences.Automaton()
        for k, s in enumerate(sequences):
            machine.add(k, s)
        text = [rnd.randrange(4) for _ in range(40)]
        got = list(machine.match(text))
        assert [n for n, _ in got] == longest(text, sequences)
        for i, (n, state) in enumerate(got):
            if n:
                part = text[i + 1 - n : i + 1]
                want = {(k, e) for k, s in enumerate(sequences) for e in range(n, len(s) + 1) if s[e - n : e] == part}
                assert set(machine.ends(state)) == want and len(machine.ends(state)) == len(want)


def test_licences(spark):
    rnd = random.Random(1)
    bits = ["MIT", "License", "mit license", "Apache", "General Public License", "GNU", "general public", "naïve", ". ", "\n", "-", "License, Version 2.0", "All rights", "reserved", "日本"]
    texts = [(i, " ".join(rnd.choice(bits) for _ in range(rnd.randint(0, 60)))) for i in range(200)]
    mit = licences.TEMPLATES[0][1]
    texts += [(500, None), (501, ""), (None, "MIT License"), (None, "MIT License"), (502, "word " * 300_000 + "MIT  LICENSE"), (503, f"before {mit.upper()} after")]
    cut = mit.split()
    texts.append((504, " ".join(cut[:30] + ["changed", "words"] + cut[32:])))  # a template with two other words still is one
    texts.append((505, " ".join(cut[:20])))
    texts.append((506, "Licensed under CC BY-NC 4.0."))
    got = licences.licences(docs_of(spark, texts)).collect()
    assert len(got) == len(texts)
    want = []
    for i, t in texts:
        w = words_of(t)
        base = [(k, label) for label, p in licences.PHRASES for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        starts = [k for k, _ in base]
        want.append((i, len(w), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted({b for _, b in base}))))
    assert sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got), key=str) == sorted(want, key=str)
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r for r in got}
    assert by[503].labels == "mit" and by[503].n_base == 0 and by[503].score == 1
    assert by[504].labels == "mit" and 0.9 < by[504].score < 1
    assert by[505].labels == "" and 0 < by[505].score < licences.SHARE
    assert by[506].labels == "cc-by-nc-4.0" and by[500].score == 0
    (span,) = [r for r in licences.licence_spans(docs_of(spark, [(1, f"before {mit} after")])).collect()]
    assert (span.first_word, span.last_word, span.share) == (1, len(words_of(mit)), 1.0)
    assert licences.licences(docs_of(spark, [(1, "a")]).limit(0)).count() == 0


def test_matches_chain_past_a_change():
    machine = licences.Scanner((("t", "a b c d e f g h i j"), ("u", "x y z")), (("p", "c d"),))
    import pyarrow as pa

    ((n, base, chains),) = machine.scan(pa.array(["a b c d NEW f g h i j; x y z", ])).__iter__().__next__(),
    assert n == 13 and [b["word"] for b in base] == [2]
    best = {c["label"]: (c["first_word"], c["last_word"], c["covered"]) for c in chains}
    assert best == {"t": (0, 9, 9), "u": (10, 12, 3)}
    assert [c["label"] for c in licences.spans_of(chains)] == ["t", "u"]


# ---- spelling

def by_force(texts, min_length=6, min_count=5, ratio=5, slip=199):
    n = collections.Counter()
    for i, t in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(FOLD)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % slip == 0 else run] += 1
    v = {w: c for w, c in n.items() if len(w) >= min_length and c >= min_count}

    def apart(a, b):
        if abs(len(a) - len(b)) > 1 or a == b:
            return False
        p = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        return a[p + 1 :] == b[p + 1 :] or a[p:] == b[p + 1 :] or a[p + 1 :] == b[p:]

    near = {w: [x for x in v if apart(w, x)] for w in v}
    best = {w: min(near[w], key=lambda x: (-v[x], x)) for w in v if near[w]}
    form = {w: best[w] if w in best and v[best[w]] >= ratio * v[w] else None for w in v}
    root = {}
    for w in v:
        r = w
        while form[r]:
            r = form[r]
        root[w] = r
    return sorted((w, form[w], root[w], v[w], len(near[w]), v[form[w]] if form[w] else None) for w in v)


def spelled():
    rnd = random.Random(2)
    stems = ["".join(rnd.choice("abcé") for _ in range(rnd.randint(6, 9))) for _ in range(25)] + ["aaaaaa", "aaaaaaa", "aaaaaaaa", "abababab", "bababab"]
    texts = []
    for i in range(150):
        out = []
        for _ in range(60):
            w, k = rnd.choice(stems), rnd.randrange(6)
            out.append({0: w[:k] + w[k + 1 :], 1: w[:k] + rnd.choice("abc") + w[k:], 2: w[:k] + rnd.choice("abc") + w[k + 1 :]}.get(rnd.randrange(12), w))
        texts.append((i if i % 11 else None, " ".join(out).title()))
    # forms that lead on: 5, then 5 times as many, then again
    texts += [(900, "stepper " * 5 + "steppers " * 25 + "stepperst " * 125), (901, None), (902, ""), (903, "x" * 300_000), (904, ("É" * 7 + " ") * 6 + "short ab")]
    return texts


@pytest.mark.parametrize("block", [4096, 7])
def test_spelling(spark, monkeypatch, block):
    monkeypatch.setattr(spelling, "BLOCK", block)
    texts = spelled()
    got = spelling.variants(docs_of(spark, texts)).collect()
    want = by_force(texts)
    assert len(want) > 100 and sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in got) == want
    assert {r.word: r.root for r in got}["stepper"] == "stepperst"


def test_spelling_of_nothing(spark):
    assert spelling.variants(docs_of(spark, [(1, "a b c")])).count() == 0
    assert spelling.variants(docs_of(spark, [(1, "a")]).limit(0)).count() == 0


# ---- hard negatives

def mined(rows, positives=5, negatives_=10, every=100):
    live = {}
    for i, v, label in rows:
        if i is None or label is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        item = (label, [math.floor(256 * x) for x in v])
        live[i] = min(live.get(i, item), item)
    out = []
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    for a, (label, v) in live.items():
        if a % every:
            continue
        score = {i: dot(v, w) for i, (_, w) in live.items() if i != a}
        first = sorted((i for i in score if live[i][0] == label), key=lambda i: (-score[i], i))[:positives]
        for p in first:
            inside = [i for i in score if live[i][0] != label and 30 * score[p] <= 100 * score[i] <= 90 * score[p]]
            for k, i in enumerate(sorted(inside, key=lambda i: (-score[i], i))[:negatives_], 1):
                out.append((a, p, k, i, score[p], score[i]))
    return sorted(out)


@pytest.mark.parametrize("values,anchors", [(1 << 19, 512), (1 << 9, 2)])
def test_negatives(spark, monkeypatch, values, anchors):
    monkeypatch.setattr(negatives, "BLOCK_VALUES", values)
    monkeypatch.setattr(negatives, "ANCHORS", anchors)
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(4, 8)) * 0.4
    rows = [(i, (centre[i % 4] + rng.normal(size=8) * 0.2).round(2).tolist(), int(i % 4)) for i in range(900)]
    rows += [(1000 + i, rows[i][1], rows[i][2]) for i in range(60)]  # ties
    rows += [(1000, rows[5][1], 3), (None, rows[0][1], 1), (1101, None, 1), (1102, [0.1] * 8, None), (1103, [0.1, None] * 4, 1), (1104, [float("nan")] * 8, 1), (1105, [float("inf")] * 8, 1)]
    rows += [(1200, [0.0] * 8, 1), (1300, [], 1), (1400, [0.5, 0.5], 2), (1500, [1e12, -1e12], 77)]
    x = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").select("*", *[F.lit(1).alias(c) for c in (*CLASH, "id", "rank", "anchor_id")])
    bound = negatives.BOUND / 256
    clipped = [(i, v and [x and (min(max(x, -bound), bound) if math.isfinite(x) else x) for x in v], label) for i, v, label in rows]
    got = sorted(tuple(r) for r in negatives.hard_negatives(x).collect())
    want = mined(clipped)
    assert len(want) > 200 and got == want
    assert negatives.hard_negatives(x.limit(0)).count() == 0


def test_threshold_stops_before_the_end():
    rng = np.random.default_rng(1)
    values = np.zeros((5000, 4), np.int64)
    values[:, 0] = rng.permutation(5000)
    block = negatives.Lists(np.arange(5000), np.zeros(5000, np.int64), values)
    read = []
    block.bound = lambda anchor, depth, of=block.bound: read.append(depth) or of(anchor, depth)
    ((at, scores),) = block.search(np.array([3, 0, 0, 0]), np.ones(5000, bool), [(negatives.LEAST, negatives.MOST)], 10)
    assert scores.tolist() == [3 * x for x in range(4999, 4989, -1)] and max(read) <= 32


# ---- quality

def em_by_numpy(votes, n, names, tolerance, alarm):
    """The same model over arrays."""
    q = np.where((votes == 0).any(1), 0.05, 0.95)
    old = None
    while True:
        w = np.stack([q * n, (1 - q) * n])
        p = np.stack([(w[:, :, None] * (votes == v)).sum(1) + 1 for v in range(3)], -1) / (w.sum(1)[:, None, None] + 3)
        over = p[0, :, 0] > alarm
        p[0, over, 1:] *= ((1 - alarm) / (1 - p[0, over, 0]))[:, None]
        p[0, over, 0] = alarm
        good = (w[0].sum() + 1) / (w.sum() + 2)
        now = np.concatenate([p.ravel(), [good]])
        if old is not None and abs(now - old).max() < tolerance:
            return good, p
        old = now
        j = np.arange(len(names))
        odds = np.log(good / (1 - good)) + (np.log(p[0]) - np.log(p[1]))[j, votes].sum(1)
        q = 1 / (1 + np.exp(-odds))


def test_a_weak_rules_bad_vote_is_overruled(spark):
    """Two rules know junk, a third votes bad on a few good documents at random as well."""
    rnd = random.Random(7)
    rules = tuple((f"r{k}", f"f{k}", 0.5, 0.1) for k in range(3))
    rows = []
    for i in range(2000):
        junk = i % 10 == 0
        strong = [1.0 if junk and rnd.random() < 0.95 else 0.0 for _ in range(2)]
        weak = 1.0 if rnd.random() < (0.5 if junk else 0.02) else 0.0
        rows.append((i, junk, 100, *strong, weak))
    x = quality.votes(spark.createDataFrame(rows, "i int, junk boolean, n_words int, f0 double, f1 double, f2 double"), rules)
    params = quality.fit(x, rules, tolerance=1e-6)
    got = x.withColumn("p", quality.posterior(params, rules)).collect()
    overruled = [r for r in got if not r.junk and r.v_r2 == 0 and r.v_r0 == 1 and r.v_r1 == 1]
    assert len(overruled) > 10 and all(r.p > 0.5 for r in overruled)
    assert all(r.p < 0.5 for r in got if r.v_r0 == 0 and r.v_r1 == 0)
    votes = np.array([[r.v_r0, r.v_r1, r.v_r2] for r in got])
    good, p = em_by_numpy(votes, np.ones(len(got)), "abc", 1e-6, quality.FALSE_ALARM)
    assert abs(params["good"] - good) < 1e-4
    for k in range(3):
        for c, name in enumerate(("good", "bad")):
            for v in range(3):
                assert abs(params[f"r{k}", name, v] - p[c, k, v]) < 1e-4


def test_fit_says_so_when_it_does_not_settle(spark):
    rules = (("r", "f", 0.5, 0.1),)
    x = quality.votes(spark.createDataFrame([(100, 1.0), (100, 0.0), (100, 0.3)], "n_words int, f double"), rules)
    with pytest.raises(RuntimeError):
        quality.fit(x, rules, tolerance=0.0, sweeps=3)


def test_benchmark_items_without_an_id_count(spark):
    from docaudit.llm import decontamination as D

    item = "one two three four five six seven eight nine ten eleven twelve"
    docs = docs_of(spark, [(1, f"before {item} after"), (2, "nothing of it"), (3, None), (4, ("word " * 200_000) + item)])
    bench = spark.createDataFrame([(None, item), (5, None)], "item_id long, text string")
    assert sorted((r.doc_id, r.item_id, r.distance) for r in D.matches(docs, bench).collect()) == [(1, None, 0), (4, None, 0)]
    assert sorted(r.doc_id for r in D.without_items(docs, bench).collect()) == [2, 3]


def test_other_tokenizer_files_are_not_cut_by_words(tmp_path):
    """A file with the same suffix but other cuts gives the tokenizer's own ids."""
    import json

    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    file = json.loads(Tokenizer.from_file(path).to_str())
    assert tokens._word_wise(file)
    file["normalizer"]["normalizers"] = file["normalizer"]["normalizers"][:1]
    other = tmp_path / "cased.json"
    other.write_text(json.dumps(file))
    assert not tokens._word_wise(file)
    for text in ("Hello there, it's THE End of 2024", "", "ÀB c"):
        for p in (path, str(other)):
            want = np.array(Tokenizer.from_file(p).encode(text, add_special_tokens=False).ids, np.uint32).tobytes()
            assert tokens.encoder(p)(text) == want


def test_full_tables_of_words_change_no_ids(monkeypatch):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    for name, value in (("HELD_STEMS", 2), ("HELD_WORDS", 2), ("HELD_LENGTH", 5), ("_encoders", {})):
        monkeypatch.setattr(tokens, name, value)
    encode, tok = tokens.encoder(path), Tokenizer.from_file(path)
    words = ["Whon,###", "whon", "WHON!!", "it's", "don't.", "a_b", "x&&&", "É`", "ÀÉÎ~~", "(249)", "'", "''s", "ß|", "y" * 90 + "...", "<|endoftext|>", "<|", "a<|", "7", "日本", "ſ.", "İx", "Σας", "á!"]
    for k in range(len(words)):
        text = " ".join(words[k:] + words[: k + 1])
        assert np.frombuffer(encode(text), np.uint32).tolist() == tok.encode(text, add_special_tokens=False).ids


def test_crcs_of_runs_equal_those_of_their_bytes():
    rng = random.Random(3)
    runs = [[rng.randbytes(rng.choice([1, 4, 100, 5000, 70_000])) for _ in range(rng.randint(1, 9))] for _ in range(100)]
    parts = [x for r in runs for x in r]
    got = tokens.crc_combine(
        np.array([zlib.crc32(x) for x in parts], np.int64), np.array([len(x) for x in parts], np.int64), np.array([len(r) for r in runs]), tokens._crc_shift()
    )
    assert got.tolist() == [zlib.crc32(b"".join(r)) for r in runs]
    none = np.zeros(0, np.int64)
    assert len(tokens.crc_combine(none, none, none, tokens._crc_shift())) == 0


def test_words_that_a_worker_keeps_take_few_bytes(monkeypatch):
    """60,000 distinct words, as many stems: what stays when a task's batches are through, in Python's and Arrow's memory."""
    import tracemalloc

    import pyarrow as pa
    import pyspark

    public_tokenizers = pytest.importorskip("public_tokenizers")
    monkeypatch.setattr(pyspark.TaskContext, "get", classmethod(lambda cls: type("T", (), {"partitionId": lambda self: 0})()))
    monkeypatch.setattr(tokens, "_encoders", {})
    encode = tokens._encode(public_tokenizers.path("word_bpe_49k.json"))
    word = lambda i: "".join("abcdefghij"[int(c)] for c in f"{i:06d}")
    batches = lambda lo, hi: (pa.RecordBatch.from_pydict({"doc_id": [i], "text": [" ".join(map(word, range(i, i + 1000)))]}) for i in range(lo, hi, 1000))
    rows = sum(b.num_rows for b in encode(batches(900_000, 901_000)))
    tracemalloc.start()
    before = tracemalloc.get_traced_memory()[0] + pa.total_allocated_bytes()
    rows += sum(b.num_rows for b in encode(batches(0, 60_000)))
    kept = tracemalloc.get_traced_memory()[0] + pa.total_allocated_bytes() - before
    tracemalloc.stop()
    assert rows > 61 and kept < 100 * 60_000


def test_batches_of_texts_give_the_ids_of_each(monkeypatch):
    """Texts of a batch share words, signs and white space; a batch is cut by bytes; streams are cut as each alone."""
    import pyarrow as pa
    from tokenizers import Tokenizer

    public_tokenizers = pytest.importorskip("public_tokenizers")
    path = public_tokenizers.path("word_bpe_49k.json")
    tok, encode, rnd = Tokenizer.from_file(path), tokens.encoder(path), random.Random(8)
    pool = ["Whon,###", "whon", " ", "\n", "\x1c", "\x85", " ", "́", "don't", "<|endoftext|>", "É`", "ÀÉ~~", "7", "日本", "İ", "|", "\x00", "ÿ", "×"]
    texts = [None, "", " ", *("".join(rnd.choices(pool, k=rnd.randint(1, 9))) for _ in range(2000))]
    ids, counts = encode.all(pa.array(texts, pa.string()))
    want = [tok.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert counts.tolist() == list(map(len, want)) and ids.tolist() == [i for w in want for i in w]
    monkeypatch.setattr(tokens, "AT_ONCE", 10)
    assert list(tokens._slices(pa.array(["x" * 6, "x" * 4, None, "y" * 30, "", "z"]))) == [(0, 3), (3, 4), (4, 6)]
    assert not list(tokens._slices(pa.array([], pa.string())))
    streams = [np.random.default_rng(n).integers(0, 3 if n == 20_000 else 90_000, n).astype(np.uint32) for n in (1, 63, 20_000, 64, 3000, 1, 9000)]
    ends = np.cumsum([len(s) for s in streams])
    assert tokens.cut(np.concatenate(streams), ends).tolist() == [c + e - len(s) for s, e in zip(streams, ends.tolist()) for c in tokens.cut(s).tolist()]


def test_small_batches_are_encoded_together(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(tokens, "AT_ONCE", 200)
    monkeypatch.setattr(tokens, "BATCH_ROWS", 4)
    sizes = [1, 1, 2, 1, 300, 0, 1, 1, 5, 1]  # rows; 300: one row of so many bytes
    rows = [["x" * 300] if n == 300 else ["ab", None, "c", "", "d"][:n] for n in sizes]
    batches = [pa.RecordBatch.from_arrays([pa.array(r, pa.string())], names=["text"]) for r in rows]
    got = list(tokens._together(iter(batches)))
    assert [b.num_rows for b in got] == [4, 1, 1, 2, 5, 1]
    assert [t for b in got for t in b.column("text").to_pylist()] == [t for r in rows for t in r]
    assert not list(tokens._together(iter([])))
