import math
import random
import zlib
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from farebox.llm import kneser_ney as kn
from farebox.llm.sieve import sieve

ORDER = kn.ORDER


def brute_model(texts):
    """p(byte | context) straight from the definition."""
    counts = {k: Counter() for k in range(1, ORDER + 1)}
    for text in texts:
        data = bytes(ORDER - 1) + (text or "").encode()
        for i in range(ORDER - 1, len(data)):
            counts[ORDER][data[i - ORDER + 1 : i + 1]] += 1
    for k in range(ORDER - 1, 0, -1):
        for gram in counts[k + 1]:
            counts[k][gram[1:]] += 1
    cuts, contexts = {}, {}
    for k, table in counts.items():
        t = [sum(n == j for n in table.values()) for j in (1, 2, 3, 4)]
        y = t[0] / (t[0] + 2 * t[1]) if t[0] and t[1] else 0.5
        d = [j + 1 - (j + 2) * y * t[j + 1] / t[j] if t[j] else (j + 1) / 2 for j in range(3)]
        d = [min(max(x, 0.1), j + 0.9) for j, x in enumerate(d)]
        cuts[k] = lambda n, d=d: d[min(n, 3) - 1]
        contexts[k] = defaultdict(list)
        for gram, n in table.items():
            contexts[k][gram[:-1]].append(n)

    def p(gram):
        k = len(gram)
        if not k:
            return 1 / 256
        seen = contexts[k].get(gram[:-1])
        if not seen:
            return p(gram[1:])
        n, cut = counts[k][gram], cuts[k]
        own = (n - cut(n)) / sum(seen) if n else 0.0
        return own + sum(map(cut, seen)) / sum(seen) * p(gram[1:])

    def mean_logp(text):
        data = bytes(ORDER - 1) + (text or "").encode()
        logs = [math.log(p(data[i - ORDER + 1 : i + 1])) for i in range(ORDER - 1, len(data))]
        return sum(logs) / len(logs) if logs else None

    return mean_logp


@pytest.mark.parametrize("shard_entries", [40, 2_000_000])
def test_scores_equal_the_definition(spark, shard_entries):
    rng = random.Random(4)
    texts = ["".join(rng.choice("abé c") for _ in range(rng.randint(0, 60))) for _ in range(30)] + [None, ""]
    frame = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id long, text string")
    model = kn.Model(kn.count_grams(frame.where("id < 20"), "text"), shard_entries)
    assert (len(model.groups) > 1) == (shard_entries == 40)
    expected = brute_model(texts[:20])
    for row in model.score(frame).collect():
        want = expected(texts[row.id])
        assert row.n_bytes == len((texts[row.id] or "").encode())
        assert (row.mean_logp is None and want is None) or math.isclose(row.mean_logp, want, abs_tol=1e-5)


def corpus(n=400):
    rng = random.Random(2)
    rows, labels = [], []
    for k in range(n):
        words = [rng.choice(["the", "tram", "goes", "to", "town", "and", "back"]) for _ in range(rng.randint(5, 60))]
        bad = k % 10 == 0
        rows.append((k, " ".join(w + "%%&" if bad else w for w in words), rng.choice(["en", "xx"]), 1))
        if k % 2 or k % 20 == 0:
            labels.append((k, 0 if bad else 1, "y"))
    extra = [(None, "the tram goes", "en", 1), (n, None, "en", 1), (n + 1, "", None, 1), (n + 2, "the town and back to the tram", None, 1), (7, "the tram", "zz", 1)]
    return rows + extra, labels + [(None, 1, "y"), (3, None, "y")]


def test_filter_keeps_clean_and_drops_junk(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, kept int")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, text string")
    kept = kn.keep_good(docs, marks)
    assert kept.columns == docs.columns
    got = Counter((r.doc_id, r.text) for r in kept.collect())
    assert got == Counter((r[0], r[1]) for r in rows if not (r[1] and "%%&" in r[1]))
    assert kn.keep_good(docs.limit(0), marks).count() == 0
    assert kn.keep_good(docs, marks.limit(0)).count() == len(rows)


def test_sieve_passes_every_wanted_row(spark):
    docs = spark.range(5000).withColumn("bits", F.lit(1))
    wanted = spark.range(0, 5000, 7)
    left = sieve(docs, wanted, "id")
    assert left.columns == docs.columns
    ids = {r.id for r in left.collect()}
    assert ids >= set(range(0, 5000, 7)) and len(ids) < 1000


def test_held_out_rule(spark):
    got = [r.h for r in spark.range(50).select(kn.held_out("id").alias("h")).collect()]
    assert got == [zlib.crc32(str(k).encode()) % kn.HELD_OUT == 0 for k in range(50)]


def test_grams_respect_rows():
    texts = pa.array(["ab", None, "", "cdefgh"])
    from farebox.llm.arrays import text_buffer

    raw, limits = text_buffer(texts)
    got = [int(g).to_bytes(5, "big") for g in kn.grams(raw, limits)]
    assert got == [b"\0\0\0\0a", b"\0\0\0ab", b"\0\0\0\0c", b"\0\0\0cd", b"\0\0cde", b"\0cdef", b"cdefg", b"defgh"]
