"""Each operator against a brute-force version, and on nulls, ties, repeated rows, empty tables and extra columns."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docaudit.llm import bytewords as B
from docaudit.llm import decontamination, jaccard, langid, lm, mixing, quality, sharding, tokens, toxicity, warc

WORD = re.compile(r"[^\x20\x09-\x0d]+")
FOLD = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
TOKENIZER = __import__("public_tokenizers").path("word_bpe_49k.json")


def prose(rnd, n, lang="en"):
    parts = {"en": ["the", "an", "er", "tion", "ing", "wh", "st"], "fr": ["que", "eau", "oi", "é", "mentre", "la", "ou"]}[lang]
    return " ".join("".join(rnd.choice(parts) for _ in range(rnd.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(4)
    out = []
    for i in range(120):
        lang = "fr" if i % 3 == 0 else "en"
        out.append((i, prose(rnd, rnd.randint(5, 160), lang), lang, f"s{min(i % 7, 3)}", 0))
    base = prose(rnd, 120).split()
    for i in range(120, 150):  # near copies of one text
        w = list(base)
        for _ in range(rnd.randint(0, 4)):
            w[rnd.randrange(len(w))] = rnd.choice("xyz")
        out.append((i, " ".join(w), "en", "s0", 0))
    out += [(150, out[3][1], "en", "s1", 0), (151, out[3][1].upper(), "en", "s1", 0), (152, None, None, None, None), (153, "", "en", "s0", 0), (154, " \n\t", "en", "s0", 0), (None, "one two", "en", "s0", 0)]
    out += [(155, "same row", "en", "s0", 0)] * 2 + [(156, "long " * 30000, "en", "s2", 0), (157, "über ß Σ 日本語\nüber ß", "de", "s0", 0)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    x = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for name in ("score", "n", "h", "g", "sid", "kind", "topic", "draw", "shard", "digest", "words", "row", "k"):
        x = x.withColumn(name, F.lit("clash"))
    return x


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words_of(t):
    return WORD.findall((t or "").translate(FOLD))


def test_word_hashes_tell_words_apart():
    texts = ["The the a", None, "", "b\tThe c\nd e f g"]
    w = B.words(pa.array(texts))
    want = [words_of(t) for t in texts]
    assert np.diff(w.first).tolist() == [len(x) for x in want]
    flat = [x for ws in want for x in ws]
    assert len({(a, int(h)) for a, h in zip(flat, w.hash)}) == len(set(flat)) == len(set(w.hash.tolist()))


def test_warc_round_trip(spark, none):
    pages = [(3, "http://a.b.c/x?y=1", "p" * 150), (1, "https://a.b.c:443/", "p" * 150), (2, None, None), (4, "http://b/ü x", "short"), (5, "http://b/", "short"), (None, "u", "p" * 150), (6, "http://b/", "")]
    x = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("digest", F.lit(1))
    got = {r["page_id"]: r for r in warc.archive(x).collect()}
    for i, _, html in pages:
        raw = (html or "").encode()
        assert (got[i]["payload_bytes"], got[i]["payload_digest"]) == (len(raw), hashlib.sha256(raw).hexdigest()) and got[i]["in_index"]
    assert [(i, got[i]["refers_to"]) for i in got if got[i]["record_type"] == "revisit"] and got[3]["refers_to"] == got[None]["refers_to"] == 1
    assert got[4]["record_type"] == got[5]["record_type"] == got[1]["record_type"] == "response"
    assert warc.archive(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_url_keys():
    assert warc.url_key("http://www.Example.com:80/a?b") == "com,example,www)/a?b" and warc.url_key("https://x.y:8443") == "y,x:8443)/" and warc.url_key(None) == "-"


def test_lm_base_is_exact_and_model_sums_to_one(spark, docs, rows, none):
    got = lm.score(docs).collect()
    assert len(got) == len(rows)
    tokens_, counts = [], collections.Counter()
    for i, t, *_ in rows:
        w = [*words_of(t), "\n"]
        tokens_.append((i, w))
        if zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2:
            counts.update(w)
    n, v = sum(counts.values()), len(counts)
    by = {r["doc_id"]: r for r in got}
    for i, w in tokens_:
        r = by[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(counts[x] > 0 for x in w), n)
        assert math.isclose(r["base_score"], sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w), rel_tol=1e-9)
        assert r["score"] < 0
    assert lm.score(none).count() == 0


def brute_ppm(train, text, order=lm.ORDER):
    seen = collections.defaultdict(collections.Counter)
    for t in train:
        s = [lm.START] * order + [*t.encode(), lm.END]
        for i in range(order, len(s)):
            for k in range(order + 1):
                seen[tuple(s[i - k : i])][s[i]] += 1
    s, total = [lm.START] * order + [*text.encode(), lm.END], 0.0
    for i in range(order, len(s)):
        p, gone = 1.0, set()
        for k in range(order, -1, -1):
            x = {y: c for y, c in seen.get(tuple(s[i - k : i]), {}).items() if y not in gone}
            if x:
                if s[i] in x:
                    p *= (2 * x[s[i]] - 1) / (2 * sum(x.values()))
                    break
                p *= len(x) / (2 * sum(x.values()))
                gone |= set(x)
        else:
            p /= 257 - len(gone)
        total += math.log10(p)
    return total


def test_lm_score_equals_trie(spark):
    rnd = random.Random(2)
    train = [prose(rnd, 12) for _ in range(8)]
    m = lm.model(spark.createDataFrame([(t,) for t in train], "text string"))
    for t in [prose(rnd, 9), "", "Zebra! é", train[0]]:
        assert math.isclose(m.score(*B.bytes_of(pa.array([t])))[0], brute_ppm(train, t), rel_tol=1e-4)
    assert lm.adaptive_bits("aaaaaaaaaaaaaaaaaaaa") < lm.adaptive_bits("qwertyuiopasdfghjklz")


def test_lm_keeps_every_context(spark):
    rnd = random.Random(3)
    texts = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789 é") for _ in range(400)) for _ in range(200)]
    train = [t for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 7 != 2]
    assert len({t[i : i + 4] for t in train for i in range(396)}) > 1 << 15
    got = {r["doc_id"]: r["score"] for r in lm.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()}
    for i in [0, 1, 2, 3, 50, 120, 199] + [i for i in range(200) if texts[i] not in train][:5]:
        assert math.isclose(got[i], brute_ppm(train, texts[i]), rel_tol=1e-9)


def edit_distance(p, t):
    r = list(range(len(p) + 1))
    best = r[-1]
    for c in t:
        q = [0]
        for i in range(1, len(p) + 1):
            q.append(min(r[i] + 1, q[-1] + 1, r[i - 1] + (p[i - 1] != c)))
        r, best = q, min(best, q[-1])
    return best


def test_decontamination_equals_edit_distance(spark, docs, none):
    rnd = random.Random(6)
    for _ in range(150):
        item = prose(rnd, rnd.randint(3, 20))
        k, t = decontamination.budget(len(item)), list(item)
        for _ in range(rnd.randint(0, k + 2)):
            t[rnd.randrange(len(t))] = rnd.choice("XYZ").lower()
        body = prose(rnd, 12) + " " + "".join(t) + " " + prose(rnd, 12)
        got, d = decontamination.Matcher([(1, item)]).find(body), edit_distance(item, body)
        assert bool(got) == (d <= k) and (not got or got[0][1] == d)
    first = docs.where("doc_id = 5").first()["text"]
    bench = spark.createDataFrame([(9, first), (10, None), (11, "")], "item_id long, text string")
    assert [(r["doc_id"], r["item_id"], r["distance"]) for r in decontamination.matches(docs, bench).collect()] == [(5, 9, 0)]
    left = decontamination.without_items(docs, bench)
    assert left.columns == docs.columns and left.where("doc_id = 5").count() == 0 and left.count() == docs.count() - 1
    assert decontamination.matches(none, bench).count() == 0 and decontamination.without_items(docs, bench.where("false")).count() == docs.count()


def test_decontamination_at_the_ends_of_a_text():
    rnd = random.Random(8)
    for case in range(200):
        item = prose(rnd, rnd.randint(8, 20))
        k, t = decontamination.budget(len(item)), item
        for _ in range(rnd.randint(1, k)):
            at = rnd.choice((0, len(t) - 1))
            t = t[:at] + t[at + 1 :] if case % 2 else t[:at] + rnd.choice("xyz") + t[at:]
        for text in (t, decontamination.fold(t + " " + prose(rnd, 4)), decontamination.fold(prose(rnd, 4) + " " + t)):
            d = edit_distance(item, text)
            assert d > k or [x[:2] for x in decontamination.Matcher([(1, item)]).find(text)] == [(1, d)]


def test_decontamination_after_a_chance_hit():
    a, b, c, d = "abcdefghijklmnop", "qrstuvwxyzabqrst", "0123456789012345", "zyxwvutsrqponmlk"
    item = a + b + c + d
    # the halves of the item come in the wrong order first: hits that lead to later starts
    text = a + b + "!" * 3 + item[3:40] + a[:8] + item[40:]
    for t in (text, item[1:], item[:20] + a[:3] + item[20:]):
        want, k = edit_distance(item, t), decontamination.budget(len(item))
        assert [x[:2] for x in decontamination.Matcher([(1, item)]).find(t)] == ([(1, want)] if want <= k else [])


def test_language_id(spark, docs, none):
    got = {r["doc_id"]: r for r in langid.identify(docs).collect()}
    held = [r for r in docs.where("lang in ('en', 'fr') and doc_id < 120").collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert np.mean([got[r["doc_id"]]["lang_pred"] == r["lang"] for r in held]) >= 0.9
    assert all(got[r["doc_id"]]["held_out"] for r in held)
    assert {got[i]["lang_pred"] for i in (152, 153, 154)} == {"und"} and all(0 <= r["score"] <= 1 for r in got.values())
    assert langid.identify(none).count() == 0


def smallest(groups, shards):
    lo, hi = max(groups), sum(groups)
    while lo < hi:
        mid, n, held = (lo + hi) // 2, 1, 0
        for g in groups:
            n, held = (n + 1, g) if held + g > mid else (n, held + g)
        lo, hi = (lo, mid) if n <= shards else (mid + 1, hi)
    return lo


def test_shards_are_minimax_and_whole(spark, docs, rows, none, monkeypatch):
    for blocks in (8192, 4):
        monkeypatch.setattr(sharding, "BLOCKS", blocks)
        got = sharding.minimax_shards(docs, 5).collect()
        assert len(got) == len(rows)
        groups = collections.defaultdict(int)
        for r in got:
            groups[r["text_digest"]] += r["size"]
        assert {r["capacity"] for r in got} == {smallest([groups[k] for k in sorted(groups)], 5)}
        shards = collections.defaultdict(list)
        for r in got:
            shards[r["shard"]].append(r)
        for of in shards.values():
            assert sorted(r["slot"] for r in of) == list(range(len(of))) and sum(r["size"] for r in of) <= got[0]["capacity"]
        assert all(len({r["shard"] for r in got if r["text_digest"] == k}) == 1 for k in groups)
    assert sharding.minimax_shards(none).count() == 0


def test_raking_meets_the_marginals(spark, docs, rows, none):
    got = mixing.mix(docs, share=0.5).collect()
    assert len(got) == len(rows) and all(r["kept"] == (r["draw"] < r["probability"]) or abs(r["draw"] - r["probability"]) < 1e-6 for r in got)
    cells = mixing.rake(docs.select("source", "lang", mixing.topic_of(F.coalesce("text", F.lit(""))).alias("topic"), F.lit(3).alias("t")).fillna("").groupBy("source", "lang", "topic").agg(F.sum("t").alias("tokens")), mixing.TEMPER, {"lang": {"fr": 0.5}}, sweeps=60)
    total = cells.agg(F.sum("tokens")).first()[0]
    fr = cells.where("lang = 'fr'").agg(F.sum("weight")).first()[0]
    assert abs(cells.agg(F.sum("weight")).first()[0] - total) < 1e-6 * total and abs(fr / total - 0.5) < 0.05
    assert mixing.mix(none).count() == 0 and mixing.sampled(docs).columns == docs.columns


def components_by_force(rows):
    sets = {}
    for n, (i, t, *_) in enumerate(rows):
        w = words_of(t)
        sets[n] = frozenset(tuple(w[j : j + 5]) for j in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    root = {n: n for n in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                root[max(top(a), top(b))] = min(top(a), top(b))
    least = collections.defaultdict(list)
    for n in sets:
        if rows[n][0] is not None:
            least[top(n)].append(rows[n][0])
    return sorted(((rows[n][0], len(sets[n]), min(least[top(n)], default=None) if sets[n] else rows[n][0]) for n in sets), key=str)


def test_jaccard_components_equal_brute_force(spark, docs, rows, none):
    got = jaccard.near_components(docs).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == components_by_force(rows)
    left = jaccard.one_of_each(docs)
    assert left.columns == docs.columns and left.where("doc_id = 155").count() == 1 and left.where("doc_id = 150").count() == 0
    assert jaccard.near_components(none).count() == 0


def test_token_store_round_trip(spark, docs, rows, none, tmp_path):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(TOKENIZER)
    path = tokens.write_store(docs, tmp_path.as_uri() + "/store", TOKENIZER)
    got = {(r["doc_id"], r["ids_crc32"]): r for r in tokens.read_back(spark, path).collect()}
    ids = {(r["doc_id"], tuple(r["ids"])) for r in tokens.documents(spark, path).collect()}
    for i, t, *_ in rows:
        want = [*tok.encode(t or "", add_special_tokens=False).ids, tokens.END_ID]
        r = got[(i, zlib.crc32(np.array(want, "<u4").tobytes()))]
        assert r["n_tokens"] == len(want) and (i, tuple(want)) in ids
    order = sorted(tokens.read_back(spark, path).collect(), key=lambda r: r["start"])
    assert [r["start"] for r in order] == np.r_[0, np.cumsum([r["n_tokens"] for r in order])][:-1].tolist()
    assert [r["doc_id"] for r in order] == sorted((r["doc_id"] for r in order), key=lambda x: -1 if x is None else x)
    assert tokens.token_output(none, TOKENIZER).count() == 0


@pytest.mark.parametrize("text", ["Hello, World!!  don't it's", "<|endoftext|> a<|startoftext|>b", "Straße ÉCOLE x́ ΑΣ Σς İ", "123 a1b2 ... 'll O'Reilly", "ª º µ \x1c\x85 z", "日本語 한국"])
def test_encoder_equals_the_library(text):
    from tokenizers import Tokenizer

    want = Tokenizer.from_file(TOKENIZER).encode(text, add_special_tokens=False).ids
    assert np.frombuffer(tokens.encoder(TOKENIZER)(text), np.uint32).tolist() == want


def test_chunks_are_cut_by_content():
    ids = np.random.default_rng(1).integers(0, 40000, 60000).astype(np.uint32)
    a, b = tokens.cut(ids), tokens.cut(np.r_[ids[:5].copy() + 1, ids])
    assert a[-1] == len(ids) and len(set((b - 5).tolist()) & set(a.tolist())) > 0.9 * len(a) and np.diff(np.r_[0, a]).max() <= tokens.MOST


def test_toxicity_learns_held_out_words(spark, none):
    rnd = random.Random(8)
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        w = prose(rnd, rnd.randint(10, 60)).split()
        for _ in range(3 * bad):
            w.insert(rnd.randrange(len(w)), "zorg" + rnd.choice(["a", "el", "um"]))
        rows.append((i, " ".join(w), "en", "s", 0))
        labels.append((i, int(bad)))
    docs = spark.createDataFrame([*rows, (999, None, None, None, 0)], SCHEMA).withColumn("score", F.lit("clash"))
    y = spark.createDataFrame([*labels, (7, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, y)
    got = {r["doc_id"]: r["score"] for r in toxicity.scores(docs, model).collect()}
    held = [(i, t) for i, t in labels if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([(got[i] >= 0.3) == (t == 1) for i, t in held]) >= 0.95 and 0 <= got[999] <= 1
    kept = toxicity.without_toxic(docs, y)
    assert kept.columns == docs.columns and 290 <= kept.count() <= 310
    assert toxicity.scores(none, toxicity.train(none, y.where("false"))).count() == 0


def counts_by_force(t):
    t = t or ""
    w = WORD.findall(t)
    at = collections.defaultdict(list)
    for i in range(len(w) - 2):
        at[tuple(w[i : i + 3])].append(i)
    hit = {j for p in at.values() if len(p) > 1 for i in p for j in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(hit)


def test_toxicity_thresholds_cover_all_labelled_rows(spark):
    score = lambda i: (i * 7919 % 1000) / 1000
    # language b: clean rows score up to 0.7; only a few of its rows are fitted on
    rows = [(i, "b" if i % 2 else "a", 0.3 + 0.4 * score(i) if i % 3 else 0.75 + 0.2 * score(i)) for i in range(1200)]
    labels = spark.createDataFrame([(i, 1 - min(i % 3, 1)) for i in range(1200)], "doc_id long, toxic int")
    model = toxicity.Classifier()
    model.fitted = list(range(12))
    toxicity.calibrate(model, spark.createDataFrame(rows, "doc_id long, lang string, score double"), labels)
    assert set(model.thresholds) == {"", "a", "b"}
    for lang, t in model.thresholds.items():
        of = [(p, i) for i, l, p in rows if lang in ("", l) and i >= 12 and zlib.crc32(str(i).encode()) % 4 != 2]
        f1 = {}
        for s in toxicity.STEPS:
            tp, fp = (sum(p >= s and (i % 3 == 0) == bad for p, i in of) for bad in (True, False))
            if fp <= 0.02 * sum(i % 3 > 0 for _, i in of) and tp:
                f1[float(s)] = 2 * tp / (tp + fp + sum(i % 3 == 0 for _, i in of))
        assert t == max(f1, key=lambda s: (f1[s], -s))


def test_toxicity_bias_follows_the_share_of_all_labels(spark, monkeypatch):
    monkeypatch.setattr(toxicity.Classifier, "fit", lambda self, feats, labels: setattr(self, "trained", True))
    docs = spark.createDataFrame([(i, "word", "en", "s0", 0) for i in range(600)], SCHEMA)
    model = toxicity.train(docs, spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(600)], "doc_id long, toxic int"), 20)
    n = collections.Counter(i % 10 == 0 for i in range(600) if zlib.crc32(str(i).encode()) % 4 != 2)
    assert math.isclose(model.bias, math.log(n[True] / n[False]), rel_tol=1e-5)  # 20 of each were taken


def test_untrained_toxicity_rejects_nothing(spark, docs, rows):
    schema = "doc_id long, toxic int"
    for labels in ([], [(i, 0) for i in range(100)], [(i, 1) for i in range(100)], [(10**6, 1), (10**6 + 1, 0)]):
        kept = toxicity.without_toxic(docs, spark.createDataFrame(labels, schema))
        assert kept.columns == docs.columns and kept.count() == len(rows)


def test_quality_counts_and_votes(spark, docs, rows, none):
    got = quality.quality(docs).collect()
    mine = sorted(((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in got), key=str)
    assert mine == sorted(((i, *counts_by_force(t)) for i, t, *_ in rows), key=str)
    assert all(r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]) and not (r["base_failed"] and r["kept"]) for r in got)
    rnd = random.Random(3)
    junk = [(i, prose(rnd, 80).replace(" ", "&&& ") if i % 5 == 0 else prose(rnd, 80), "en", "s", 0) for i in range(300)]
    kept = {r["doc_id"]: r["kept"] for r in quality.quality(spark.createDataFrame(junk, SCHEMA)).collect()}
    assert not any(kept[i] for i in kept if i % 5 == 0) and sum(kept[i] for i in kept if i % 5) > 200
    assert quality.quality(none).count() == 0


def test_warc_index_splits_hot_keys_and_finds_repeated_ids(spark, monkeypatch):
    monkeypatch.setattr(warc.build_index, "__defaults__", (20,))
    pages = [(i, "http://hot.example/", f"{i} " * 3) for i in range(900)] + [(i, None, "x" * (i % 3)) for i in range(300)]
    pages += [(7, "http://hot.example/", "another payload"), (7, "http://hot.example/", "another payload"), (None, "http://hot.example/", "no id"), (5000, "http://a.b/", "y" * 3_000_000)]
    x = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("file", F.lit("clash")).withColumn("offset", F.lit(1))
    got = warc.archive(x).collect()
    assert len(got) == len(pages) and all(r["in_index"] for r in got)
    assert sum(r["payload_bytes"] for r in got) == sum(len(h or "") for *_, h in pages)
    path, index = warc.new_path(spark, "w"), warc.new_path(spark, "i")
    captures = warc.persisted(warc.read_archives(spark, path, warc.write_archives(x, path)), "captures")
    directory = warc.build_index(captures, index)
    cuts = warc._cuts(directory, 4)
    assert len(cuts) == 3 and len({k for k, _ in cuts}) < 3
    lost = spark.createDataFrame([("com,none)/", 1), ("example,hot)/", 899), ("example,hot)/", 90000)], "url_key string, page_id long")
    found = {(r["url_key"], r["page_id"]): r["file"] for r in warc.lookup(lost, directory, index).collect()}
    assert len(found) == 3 and [k for k, v in found.items() if v] == [("example,hot)/", 899)]


def test_helper_columns_never_clash(spark, docs, none):
    clash = docs.select("*", *[F.lit(1).alias(c) for c in ("key", "text_hash", "text_to_score", "toxic_score", "__source", "__draw", "__probability", "__key")])
    assert jaccard.one_of_each(clash).columns == clash.columns
    assert sorted(r["doc_id"] or -1 for r in jaccard.one_of_each(clash).collect()) == sorted(r["doc_id"] or -1 for r in jaccard.one_of_each(docs).collect())
    assert sorted(str(r["doc_id"]) for r in mixing.sampled(clash).collect()) == sorted(str(r["doc_id"]) for r in mixing.sampled(docs).collect())
    labels = clash.where("doc_id is not null").select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    assert toxicity.without_toxic(clash, labels).columns == clash.columns
