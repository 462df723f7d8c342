import random

import corpus_pipeline as P


def test_stages_take_effect_and_keep_the_columns(spark, tmp_path):
    rnd = random.Random(1)
    parts = ["the", "an", "er", "tion", "ing", "wh", "st"]
    prose = lambda n: " ".join("".join(rnd.choice(parts) for _ in range(rnd.randint(2, 3))) for _ in range(n))
    rows, labels = [], []
    for i in range(200):
        w = prose(40).split()
        if i % 5 == 0:
            w[3:3] = ["zorga", "zorgel"]
        rows.append((i, " ".join(w), "en", f"s{i % 3}", 0))
        labels.append((i, 1, int(i % 5 == 0)))
    item = prose(30)
    rows += [(300, rows[1][1], "en", "s0", 0), (301, prose(20) + " " + item + " " + prose(20), "en", "s1", 0), (302, None, None, None, None), (303, "", "en", "s0", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, ids = docs.columns, [{r["doc_id"] for r in docs.collect()}]
    for k, (name, stage) in enumerate(P.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        ids.append({r["doc_id"] for r in docs.collect()})
        assert k == len(P.STAGES) - 1 or docs.columns == columns
        assert ids[-1] <= ids[-2]
    assert len({i for i in range(200) if i % 5 == 0} & ids[1]) <= 2 and len({i for i in range(200) if i % 5} - ids[1]) <= 4
    assert 300 not in ids[2] and 1 in ids[2] and 301 in ids[2] and 301 not in ids[3] and ids[5] == ids[4]
    assert 0.5 < len(ids[4]) / len(ids[3]) < 1


def test_stages_on_odd_tables(spark, tmp_path):
    """Empty tables; then null and repeated ids, null and empty texts, a very long text and clashing columns."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, key int, sid int, toxic_score int, block int, text_hash int"
    rnd = random.Random(2)
    prose = lambda n: " ".join("".join(rnd.choice(("the", "an", "er", "tion")) for _ in range(3)) for _ in range(n))
    one = prose(60)
    odd = [(i, prose(30), "en", "s", 0) for i in range(30)] + [(7, one, "en", "s", 0), (7, one, "en", "s", 0), (7, prose(40), None, None, None)]
    odd += [(None, None, None, None, None), (None, one, "en", "s", 0), (40, "", "en", "s", 0), (41, "  \n", "en", "s", 0), (42, prose(40_000), "en", "s", 0), (43, "x" * 300_000, "en", "s", 0)]
    for n, rows in enumerate(([], [(*r, 1, 2, 3, 4, 5) for r in odd])):
        d = f"{tmp_path}/{n}"
        spark.createDataFrame(rows, schema).write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame([(r[0], 1, 0) for r in rows], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
        spark.createDataFrame([(None, prose(30)), (1, None), (2, "")] if rows else [], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
        docs = spark.read.parquet(f"{d}/documents.parquet")
        columns = docs.columns
        for k, (name, stage) in enumerate(P.STAGES):
            stage(spark, docs, d).write.parquet(f"{d}/{name}")
            docs = spark.read.parquet(f"{d}/{name}")
            assert k == len(P.STAGES) - 1 or docs.columns == columns
        left = docs.collect()
        assert bool(left) == bool(rows) and all(r["n_tokens"] >= 1 for r in left)


def test_the_last_stage_keeps_few_bytes_of_words(monkeypatch):
    """More distinct words than tables hold: what a worker of token_output has at the end takes 100 bytes a place at most."""
    import tracemalloc

    import pyarrow as pa
    import pyspark
    import pytest

    from docaudit.llm import tokens

    public_tokenizers = pytest.importorskip("public_tokenizers")
    monkeypatch.setattr(pyspark.TaskContext, "get", classmethod(lambda cls: type("T", (), {"partitionId": lambda self: 0})()))
    for name, value in (("_encoders", {}), ("HELD_STEMS", 10_000), ("HELD_WORDS", 10_000)):
        monkeypatch.setattr(tokens, name, value)
    encode = tokens._encode(public_tokenizers.path("word_bpe_49k.json"))
    word = lambda i: "".join("abcdefghij"[int(c)] for c in f"{i:06d}") + "!,"
    batches = lambda lo, hi: (pa.RecordBatch.from_pydict({"doc_id": [i], "text": [" ".join(map(word, range(i, i + 1000)))]}) for i in range(lo, hi, 1000))
    assert sum(b.num_rows for b in encode(batches(900_000, 901_000))) > 1
    tracemalloc.start()
    held = []
    for k in range(3):
        before = tracemalloc.get_traced_memory()[0] + pa.total_allocated_bytes()
        assert sum(b.num_rows for b in encode(batches(k * 30_000, k * 30_000 + 30_000))) > 30
        held.append(tracemalloc.get_traced_memory()[0] + pa.total_allocated_bytes() - before)
    tracemalloc.stop()
    assert sum(held) < 100 * 2 * 10_000


def test_components_write_no_round_that_changes_nothing(spark, monkeypatch):
    """What the driver keeps of a round is its stages and tasks: stars need none, others end with the round that makes stars."""
    from docaudit.llm import components as C

    written = []
    monkeypatch.setattr(C, "persisted", lambda df, name, f=C.persisted: written.append(name) or f(df, name))
    rnd = random.Random(3)
    links = [(rnd.randint(-60, 60), rnd.randint(-60, 60)) for _ in range(70)] + [(i, i + 1) for i in range(100, 130)] + [(7, 7), (200, 201), (201, 200)]
    for pairs, most in ((links, 9), ([(9, 3), (3, 5), (3, 9), (4, 20)], 1), ([(1, 2), (2, 3)], 2), ([], 1)):
        written.clear()
        got = C.components(spark.createDataFrame(pairs, "a long, b long")).collect()
        root = {x: x for p in pairs if p[0] != p[1] for x in p}
        for _ in root:
            for a, b in pairs:
                if a != b:
                    root[a] = root[b] = min(root[a], root[b])
        assert sorted(map(tuple, got)) == sorted(root.items())
        assert len(written) <= most


def test_the_fit_copies_no_features():
    """The driver fits the classifier: beside the features that came it holds the tables and their squared gradients only."""
    import tracemalloc

    import numpy as np

    from docaudit.llm import toxicity

    rng = np.random.default_rng(1)
    feats = [rng.integers(0, 3 * toxicity.BUCKETS, (40_000, 3), np.int32) for _ in range(50)]  # 24 MB
    model = toxicity.Classifier()
    tracemalloc.start()
    model.fit(feats, np.arange(50, dtype=np.float32) % 2, epochs=0)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 3.5 * model.table.nbytes
    assert (model.table[np.unique(np.concatenate(feats))] != 0).any(1).all()


def test_the_fit_runs_in_a_task(spark, monkeypatch):
    """Neither the features nor the fit take the driver's memory; what comes of the model are the rows of words that occur."""
    import os
    import pickle

    import numpy as np
    import pyarrow as pa

    from docaudit.llm import toxicity

    whole = toxicity.Classifier.fit

    def fit(self, feats, labels):
        whole(self, feats, labels)
        self.pid = os.getpid()

    monkeypatch.setattr(toxicity.Classifier, "fit", fit)
    docs = spark.createDataFrame([(i, f"some {'bad' if i % 3 == 0 else 'good'} word {i}", "en") for i in range(60)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    assert model.trained and model.pid != os.getpid()
    assert model.fitted == sorted(model.fitted) and 30 < len(model.fitted) < 60
    sent = pickle.dumps(model)
    assert len(sent) < 100_000 < model.table.nbytes and (pickle.loads(sent).table == model.table).all()
    # the same model as a fit on the same rows in this process
    rows = [r for r in docs.orderBy("doc_id").collect() if r["doc_id"] in model.fitted]
    there = toxicity.Classifier()
    batch = pa.RecordBatch.from_pydict({"doc_id": [r["doc_id"] for r in rows], "lang": ["en"] * len(rows), "toxic": [int(r["doc_id"] % 3 == 0) for r in rows], "text": [r["text"] for r in rows]})
    (got,) = toxicity._examples(iter([batch]))
    whole(there, [np.frombuffer(x, np.int32).reshape(-1, 3) for x in got.column("words").to_pylist()], got.column("toxic").to_numpy().astype(np.float32))
    assert np.allclose(there.table, model.table, atol=1e-5) and np.allclose(there.out, model.out, atol=1e-5)


def test_near_copies_scan_nothing_needless(spark, tmp_path, monkeypatch):
    """Each scan and stage takes the driver's memory: empty tables are in no plan, and a round of components scans its edges four times at most."""
    from docaudit.llm import components as C
    from docaudit.llm import jaccard

    plans = []

    def kept(df, name, f=C.persisted):
        plans.append((name, df._jdf.queryExecution().sparkPlan().toString()))
        return f(df, name)

    monkeypatch.setattr(C, "persisted", kept)
    monkeypatch.setattr(jaccard, "persisted", kept)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join([*words[:i], f"x{i}", *words[i + 1 :]]) for i in (10, 30, 50)] + [" ".join(words), " ".join(words), "alone", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = jaccard.near_components(spark.read.parquet(f"{tmp_path}/documents.parquet"))
    assert sorted((r["doc_id"], r["component_id"]) for r in got.collect()) == [(0, 0), (1, 0), (2, 0), (3, 0), (4, 0), (5, 5), (6, 6)]
    assert len(plans) > 8 and not [name for name, plan in plans if "ExistingRDD" in plan]
    plans.clear()
    assert C.components(spark.createDataFrame([(i, i + 1) for i in range(9)], "a long, b long")).where("root = 0").count() == 10
    assert max(plan.count("FileScan") for name, plan in plans[1:]) <= 4
