import random
import re
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from farebox.llm import decontaminate as dc


def words(text):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(texts, items, window):
    out = []
    for text in texts:
        w, hit, ids = words(text), set(), set()
        for item_id, item in items:
            v = words(item)
            m = min(window, len(v))
            for p in range(len(v) - m + 1 if m else 0):
                for q in range(len(w) - m + 1):
                    if w[q : q + m] == v[p : p + m]:
                        hit.update(range(q, q + m))
                        ids.add(str(item_id))
        out.append((len(w), len(hit), sorted(ids)))
    return out


def some_texts(rng, n, longest):
    vocabulary = ["a", "B", "é", "x1", "über", "THE"]
    texts = [rng.choice([" ", ". ", ", "]).join(rng.choice(vocabulary) for _ in range(rng.randint(0, longest))) for _ in range(n)]
    return texts + texts[:3]


@pytest.mark.parametrize("seed", range(12))
def test_matches_equal_brute_force(seed):
    rng = random.Random(seed)
    texts = some_texts(rng, 12, 40) + [None, "", "...", "word"]
    items = list(enumerate(some_texts(rng, 6, 14))) + [(9, None), (10, "word")]
    window = rng.choice([1, 2, 3, 4, 5, 7])
    prepared = dc.Items([t for _, t in items], window)
    shard, row, found = dc.find_matches(pa.array(texts, pa.string()), prepared)
    for r, (n, hit, ids) in enumerate(brute(texts, items, window)):
        mine = found[row == r]
        covered = {w for _, _, d, k in mine for w in range(d, d + k)}
        assert shard.limits[r + 1] - shard.limits[r] == n
        assert (len(covered), sorted({str(items[i][0]) for i in mine[:, 0]})) == (hit, ids)
        for i, p, d, k in mine:
            assert words(texts[r])[d : d + k] == words(items[i][1])[p : p + k]


@pytest.mark.parametrize("seed", range(5))
def test_longest_match_of_every_suffix(seed):
    rng = random.Random(100 + seed)
    texts, items = some_texts(rng, 8, 30), some_texts(rng, 3, 20)
    prepared = dc.Items(items, 5)
    shard = dc.split_words(pa.array(texts))
    lookup = dc.Lookup(shard, prepared.words, prepared.depth)
    got = lookup.longest(prepared.query)
    every = [words(t) for t in texts]
    expected = []
    for item in items:
        v = words(item)
        for p in range(len(v)):
            best = 0
            for w in every:
                for q in range(len(w)):
                    k = 0
                    while p + k < len(v) and q + k < len(w) and v[p + k] == w[q + k]:
                        k += 1
                    best = max(best, k)
            expected.append(best)
    assert got.tolist() == expected


@pytest.mark.parametrize("block_bytes", [20, 1 << 20])
def test_frames_blocks_and_edges(spark, block_bytes):
    rng = random.Random(3)
    texts = some_texts(rng, 20, 60) + [None, ""]
    items = list(enumerate(some_texts(rng, 8, 12))) + [(None, "the the"), (3, None)]
    docs = spark.createDataFrame([(k, t, 1, "x") for k, t in enumerate(texts)], "doc_id long, text string, n_words int, found string")
    bench = spark.createDataFrame([(k, t, "y") for k, t in items], "item_id long, text string, doc_id string")
    got = dc.match_benchmark(docs, bench, window=4, block_bytes=block_bytes)
    assert got.columns == ["doc_id", "text", "found", "n_words", "matches"]
    rows = got.select("doc_id", "n_words", dc.n_hit("matches").alias("h"), dc.item_list("matches").alias("i")).orderBy("doc_id").collect()
    expected = brute(texts, items, 4)
    assert [(r.n_words, r.h, r.i) for r in rows] == [(n, h, [x for x in i if x != "None"]) for n, h, i in expected]
    clean = dc.drop_contaminated(docs, bench, window=4)
    assert clean.columns == docs.columns
    assert {r.doc_id for r in clean.collect()} == {k for k, (n, h, _) in enumerate(expected) if not (h and 20 * h >= n)}
    assert dc.match_benchmark(docs.limit(0), bench).count() == 0
    none = dc.match_benchmark(docs, bench.limit(0)).agg(F.sum(F.size("matches")), F.count("*")).first()
    assert tuple(none) == (0, len(texts))


def test_repeated_words_cost_no_more_than_their_matches(spark):
    """An item of one word over and over, and a document of it: every pair of window and place would be 400 million."""
    many = 20_000
    docs = spark.createDataFrame([(1, "la " * many), (2, "la " * 30 + "li " + "la " * 12), (3, "lo")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "la " * many), (2, "la " * 13 + "li"), (3, "la la")], "item_id long, text string")
    start = time.time()
    got = dc.match_benchmark(docs, bench).select("doc_id", "n_words", dc.n_hit("matches").alias("h"), dc.item_list("matches").alias("i"))
    assert sorted((r.doc_id, r.n_words, r.h, r.i) for r in got.collect()) == [
        (1, many, many, ["1", "2", "3"]), (2, 43, 43, ["1", "2", "3"]), (3, 1, 0, [])
    ]
    assert time.time() - start < 60


def test_periodic_texts_equal_brute_force():
    rng = random.Random(9)
    for _ in range(30):
        unit = [rng.choice("ab") for _ in range(rng.randint(1, 3))]
        texts = [" ".join((unit * 12)[: rng.randint(0, 25)] + [rng.choice("abc")] + unit * 4) for _ in range(4)]
        items = list(enumerate(" ".join((unit * 10)[rng.randint(0, 2) : rng.randint(5, 25)]) for _ in range(3)))
        window = rng.randint(1, 6)
        shard, row, found = dc.find_matches(pa.array(texts), dc.Items([t for _, t in items], window))
        for r, (n, hit, ids) in enumerate(brute(texts, items, window)):
            mine = found[row == r]
            assert (len({w for _, _, d, k in mine for w in range(d, d + k)}), sorted({str(i) for i in mine[:, 0]})) == (hit, ids)
            assert len({(i, p, d) for i, p, d, _ in mine.tolist()}) == len(mine)
            for i, p, d, k in mine.tolist():  # maximal: neither side goes on
                v, w = words(items[i][1]), words(texts[r])
                assert v[p : p + k] == w[d : d + k]
                assert p == 0 or d == 0 or v[p - 1] != w[d - 1]
                assert p + k == len(v) or d + k == len(w) or v[p + k] != w[d + k]
