import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from farebox.llm import toxicity as tx


def brute_grams(text):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    data = b" " + b" ".join(w.encode() for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)) + b" "
    return [data[k : k + tx.GRAM] for k in range(len(data) - tx.GRAM + 1) if b" " not in data[k + 1 : k + tx.GRAM - 1]]


@pytest.mark.parametrize("seed", range(6))
def test_grams_stay_in_words_and_rows(seed):
    rng = random.Random(seed)
    texts = ["".join(rng.choice("aBcdé1 .\n") for _ in range(rng.choice([0, 1, 3, 30, 90]))) for _ in range(20)] + [None, "", "abc", "abcd", "abcde", " abc def "]
    code, limits = tx.word_grams(pa.array(texts, pa.string()))
    got = [sorted(int(c).to_bytes(tx.GRAM, "big") for c in code[a:b]) for a, b in zip(limits, limits[1:])]
    # A blank at either end may be doubled where the text itself begins or ends with one.
    for mine, text in zip(got, texts):
        assert set(mine) == set(brute_grams(text)), (mine, brute_grams(text), text)


def corpus(n=900):
    rng = random.Random(6)
    plain = ["tram", "line", "stop", "ticket", "route", "garden", "river", "morning", "window", "paper"]
    rows, labels = [], []
    for k in range(n):
        words = [rng.choice(plain) for _ in range(rng.randint(5, 40))]
        bad = rng.random() < 0.15
        if bad:
            words.insert(rng.randrange(len(words)), "vileword" + rng.choice(["a", "os", "en"]))
        rows.append((k, " ".join(words), bad))
        if rng.random() < 0.6:
            labels.append((k, int(bad)))
    return rows, labels


def test_learns_toxic_words_from_positives_alone(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame([(k, t, 1.0) for k, t, _ in rows], "doc_id long, text string, score double")
    marks = spark.createDataFrame(labels + [(None, 1), (5, None)], "doc_id long, toxic int")
    model = tx.fit(docs, marks)
    got = {r.doc_id: r.score for r in tx.rate(docs, model).collect()}
    assert len(got) == len(rows) and all(0 <= s <= 1 for s in got.values())
    assert all((got[k] >= tx.DECIDE) == bad for k, _, bad in rows)
    # The held-out labels change nothing.
    flipped = [(k, 1 - t) if zlib.crc32(str(k).encode()) % 4 == 2 else (k, t) for k, t in labels]
    again = tx.fit(docs, spark.createDataFrame(flipped, "doc_id long, toxic int"))
    assert np.array_equal(again.grams, model.grams) and np.allclose(again.weights, model.weights, atol=1e-6)
    few = tx.fit(docs, marks, positives=40, unlabelled=100, chosen=20)
    assert len(few.grams) <= 20


def test_edges(spark):
    rows, labels = corpus(60)
    docs = spark.createDataFrame([(k, t) for k, t, _ in rows] + [(None, "tram"), (900, None), (901, ""), (3, rows[3][1])], "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    for model in (tx.fit(docs, marks), tx.fit(docs, marks.limit(0)), tx.fit(docs, marks.where("toxic = 0")), tx.fit(docs.limit(0), marks)):
        got = tx.rate(docs, model).collect()
        assert len(got) == 64 and all(0 <= r.score <= 1 for r in got)
        assert len({r.score for r in got if not r.text}) == 1
        assert tx.rate(docs.limit(0), model).count() == 0


def test_risk_correction_holds_back():
    """With features that only mark single positives, the estimate would go far below zero."""
    positive = np.arange(120) < 20
    number, counts = np.arange(120), np.ones(120, np.int64)
    w, b = tx.train(number, counts, positive, 120, 0.3)
    z = b + w
    harmless = np.logaddexp(0.0, z)
    assert harmless[~positive].mean() - 0.3 * harmless[positive].mean() > -0.05
    assert np.isfinite(w).all()


def brute_train(documents, positive, width, prior, steps):
    """The same descent with the risk written out and its slope taken by differences; also which branches were seen."""
    x = np.zeros((len(documents), width))
    for k, numbers in enumerate(documents):
        x[k, numbers] = 1.0

    def parts(v):
        z = x @ v[:-1] + v[-1]
        found = prior * np.mean(np.log1p(np.exp(-z[positive])))
        rest = np.mean(np.log1p(np.exp(z[~positive]))) - prior * np.mean(np.log1p(np.exp(z[positive])))
        return found, rest

    v = np.append(np.zeros(width), np.log(prior / (1 - prior)))
    moment, square, mean, seen = np.zeros(width + 1), np.zeros(width + 1), np.zeros(width + 1), set()
    for step in range(1, steps + 1):
        whole = parts(v)[1] >= 0
        seen.add(bool(whole))
        risk = (lambda u: sum(parts(u))) if whole else (lambda u: -parts(u)[1])
        g = np.zeros(width + 1)
        for k in range(width + 1):
            up, down = v.copy(), v.copy()
            up[k], down[k] = up[k] + 1e-5, down[k] - 1e-5
            g[k] = (risk(up) - risk(down)) / 2e-5
        g[:-1] += tx.PENALTY * v[:-1]
        moment, square = 0.9 * moment + 0.1 * g, 0.999 * square + 0.001 * g * g
        v = v - tx.SPEED * (1 - step / (steps + 1)) * (moment / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
        if 2 * step > steps:
            mean += v / (steps - steps // 2)
    return mean, seen


@pytest.mark.parametrize("seed, prior", [(0, 0.1), (1, 0.6), (2, 0.6)])
def test_training_equals_the_risk_written_out(seed, prior):
    rng = np.random.default_rng(seed)
    width, n = 6, 60
    positive = np.arange(n) < 15
    chance = np.where(positive[:, None], np.linspace(0.9, 0.2, width), np.linspace(0.05, 0.4, width))
    documents = [np.flatnonzero(row) for row in rng.random((n, width)) < chance]
    want, seen = brute_train(documents, positive, width, prior, 120)
    number, counts = np.concatenate(documents), np.array([len(d) for d in documents])
    weights, bias = tx.train(number, counts, positive, width, prior, steps=120)
    assert np.allclose([*weights, bias], want, rtol=1e-3, atol=1e-4)
    assert seen == {True, False}  # the plain risk and its correction both acted


def test_scores_equal_direct_sums():
    rng = random.Random(2)
    texts = ["".join(rng.choice("abcd ") for _ in range(rng.randint(0, 60))) for _ in range(40)] + [None, "", "abcabc abcabc"]
    grams = sorted({int.from_bytes(g, "big") for t in texts[:20] for g in brute_grams(t)})[::3]
    weights = np.linspace(-1, 1, len(grams))
    model = tx.Classifier(np.array(grams, np.uint64), weights, -0.4)
    weight = dict(zip(grams, weights))
    for text, score in zip(texts, model.score(pa.array(texts, pa.string()))):
        z = -0.4 + sum(weight.get(int.from_bytes(g, "big"), 0.0) for g in set(brute_grams(text)))
        assert abs(score - 1 / (1 + np.exp(-z))) < 1e-9
