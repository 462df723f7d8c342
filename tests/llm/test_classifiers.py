"""The classifiers' arithmetic against plain Python."""

import math
import random

import numpy as np
import pyarrow as pa

from docaudit.llm import bytewords as B
from docaudit.llm import langid, toxicity

TEXTS = ["", "a", "Der Hund läuft", "the dog runs, the dog", "le chien court", "der hund", "x" * 300, "perro corre y corre"]


def buckets(text):
    raw = text.encode()
    raw = bytes(c + 32 if 65 <= c <= 90 else c for c in raw)
    out = set()
    for n in range(1, langid.NGRAM + 1):
        for i in range(len(raw) - n + 1):
            key = 0
            for c in raw[i : i + n]:
                key = (key * 257 + c + 1) % 2**32
            h = key * 2654435761 % 2**32
            h ^= h >> 15
            out.add((h * 2246822519 % 2**32) >> (32 - (langid.FEATURES.bit_length() - 1)))
    return out


def test_presence_equals_sets_of_ngrams():
    x = langid.presence(pa.array(TEXTS))
    assert [set(np.flatnonzero(r)) for r in x] == [buckets(t) for t in TEXTS]


def test_kernel_and_ridge_equal_the_exact_ones():
    rnd = random.Random(4)
    texts = [" ".join(rnd.choice(ws) for _ in range(8)) for ws in (["der", "hund", "und"], ["the", "dog", "and"], ["le", "chien", "et"]) for _ in range(6)]
    y = sorted(["de", "en", "fr"] * 6)
    x = langid.presence(pa.array(texts))
    m = langid.Classifier(x, y, landmarks=len(texts))
    exact = np.array([[len(buckets(a) & buckets(b)) / math.sqrt(len(buckets(a)) * len(buckets(b))) for b in texts] for a in texts])
    assert np.allclose(m.kernel(x), exact, atol=1e-5)
    # with every text a landmark, ridge regression on the Nystroem features is kernel ridge regression with a free bias
    z = np.c_[m.kernel(x).astype(float) @ m.root, np.ones(len(x))]
    assert np.allclose(z[:, :-1] @ z[:, :-1].T, exact, atol=1e-3)
    t = np.where(np.array(y)[:, None] == np.array(m.langs)[None, :], 1.0, -1.0)
    lam = langid.RIDGE * len(x) / z.shape[1]
    values = z @ z.T @ np.linalg.solve(z @ z.T + lam * np.eye(len(x)), t)
    assert np.allclose(m.kernel(x) @ m.weights[:-1] + m.weights[-1], values, atol=1e-2)
    assert [m.langs[i] for i in m.predict(x)[0]] == y


def test_ties_and_many_languages():
    texts, y = [chr(0x4E00 + i) * 5 for i in range(300)], [f"l{i:03}" for i in range(300)]
    m = langid.Classifier(langid.presence(pa.array(texts)), y, landmarks=300)
    assert len(m.langs) == 300 and [m.langs[i] for i in m.predict(langid.presence(pa.array(texts)))[0]] == y
    same = langid.Classifier(langid.presence(pa.array(["abc", "abc"])), ["a", "b"])
    best, score = same.predict(langid.presence(pa.array(["abc", ""])))
    assert best[0] in (0, 1) and 0 <= score.min() and score.max() <= 1


def pooled(model, feats):
    out = []
    for k, width in enumerate(toxicity.WIDTHS):
        for f in range(toxicity.FILTERS):
            best = 0.0
            for a in range(len(feats)):
                y = float(model.conv_bias[k][f])
                for j in range(min(width, len(feats) - a)):
                    e = model.table[feats[a + j]].ravel()
                    y += float(e @ model.conv[k][j * len(e) : (j + 1) * len(e), f])
                best = max(best, y)
            out.append(best)
    return out


def test_filters_and_pooling_equal_loops():
    rng = np.random.default_rng(1)
    w = B.words(pa.array([*TEXTS[:6], None, "one"]))
    feats = toxicity.word_features(w)
    m = toxicity.Classifier()
    m.table[:] = rng.normal(0, 1, m.table.shape)
    m.conv_bias = [rng.normal(0, 1, toxicity.FILTERS).astype(np.float32) for _ in toxicity.WIDTHS]
    want = np.array([pooled(m, feats[i:j]) for i, j in zip(w.first[:-1], w.first[1:])])
    m.training = True
    got, place = m._pool(feats, w.first)
    assert np.allclose(got, want, atol=1e-4) and np.allclose(m.logits(feats, w.first), want @ m.out + m.bias, atol=1e-3)
    assert ((place >= 0) == (got > 0)).all() and all(w.first[d] <= a < w.first[d + 1] for d, row in enumerate(place) for a in row if a >= 0)


def test_one_step_of_the_fit_follows_the_gradient():
    """A tiny step changes the loss as the finite differences of the output weights say: it falls."""
    w = B.words(pa.array(["bad word here", "good word here"] * 8))
    feats = [toxicity.word_features(w)[i:j] for i, j in zip(w.first[:-1], w.first[1:])]
    labels = np.array([1, 0] * 8, np.float32)

    def loss(m):
        z = m.logits(toxicity.word_features(w), w.first)
        return float(np.mean(np.log1p(np.exp(-np.where(labels == 1, z, -z)))))

    losses = []
    for epochs in (1, 3, 10):
        m = toxicity.Classifier()
        m.fit(feats, labels, epochs=epochs)
        losses.append(loss(m))
    assert losses[0] < math.log(2) and losses == sorted(losses, reverse=True) and losses[-1] < 0.1
