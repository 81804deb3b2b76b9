import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from farebox.llm import quality_rules as qr
from farebox.llm import queries

SPACE = "[^ \t-\r]+"


def brute_form(text):
    text = text or ""
    found = re.findall(SPACE, text)
    windows = [tuple(found[k : k + 3]) for k in range(len(found) - 2)]
    often = Counter(windows)
    marked = {k + s for k, w in enumerate(windows) if often[w] > 1 for s in range(3)}
    lines = [x for x in text.split("\n") if re.search(SPACE, x)]
    return [len(found), sum(map(len, found)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(marked)]


def brute_buckets(text):
    code = [xxhash.xxh3_64_intdigest(w.encode().lower()) for w in re.findall(SPACE, text or "")]
    pairs = [((a * 0x9E3779B97F4A7C15 ^ b) % 2**64 * 0xD6E8FEB86659FD93) % 2**64 for a, b in zip(code, code[1:])]
    return [c >> (64 - qr.BUCKET_BITS) for c in code + pairs]


def texts(seed, n):
    rng = random.Random(seed)
    vocabulary = ["a", "b", "Ä", "den", "x#", "$%", "été", "\x1c", "漢字", "\xa0"]
    return ["".join(rng.choice(vocabulary) + rng.choice([" ", " ", "\n", "\t", "\n\n", " \n", "\x0b", ""]) for _ in range(rng.randint(0, 60))) for _ in range(n)]


@pytest.mark.parametrize("seed", range(8))
def test_form_equals_brute_force(seed):
    rows = texts(seed, 30) + ["", None, "\n", "\n\n", "a\na\na", "a\n", "\na", " a\na ", "a b c a b c", "a a a a"]
    got = [list(map(int, x)) for x in zip(*qr.form(pa.array(rows)))]
    assert got == [brute_form(t) for t in rows]
    code, row = qr.buckets(pa.array(rows))
    for k, t in enumerate(rows):
        assert sorted(code[row == k].tolist()) == sorted(brute_buckets(t))


def test_long_text_in_linear_time():
    text = "la " * 400_000 + "\n" + "x\n" * 100_000
    assert [int(x[0]) for x in qr.form(pa.array([text]))] == [500_000, 900_000, 0, 99_999, 500_000]


def brute_rate(docs, labels):
    trusted = {i for i, q in labels if q == 1}
    held = lambda i: zlib.crc32(str(i).encode()) % qr.HELD_OUT == 0
    table = []
    for part in ([t for i, t, _ in docs if i in trusted and not held(i)], [t for _, t, _ in docs]):
        n = np.full(qr.BUCKETS, qr.SMOOTHING)
        for t in part:
            for b in brute_buckets(t):
                n[b] += 1
        table.append(np.log(n / n.sum()))
    weight = (table[0] - table[1]).astype(np.float32)
    scores, steps = {}, {}
    for i, t, lang in docs:
        b = brute_buckets(t)
        scores[i, t] = (sum(map(float, weight[b])) / len(b), len(b)) if b else None
        if b and i in trusted and held(i):
            s = np.floor((scores[i, t][0] + qr.ALLOWANCE / len(b) ** 0.5) * qr.STEPS)
            for key in (lang, "every"):
                steps.setdefault(key, []).append(s)
    bound = {k: np.floor(np.percentile(v, 100 * qr.QUANTILE)) / qr.STEPS - qr.MARGIN for k, v in steps.items()}
    out = {}
    for i, t, lang in docs:
        n, _, _, _, again = brute_form(t)
        failed = n < 50 or 100 * again > 50 * n
        score = scores[i, t]
        least = bound.get(lang if lang else "every", bound.get("every"))
        passed = score is None or least is None or score[0] >= least - qr.ALLOWANCE / score[1] ** 0.5
        out[i] = (failed, passed and not failed, score and score[0])
    return out


def test_whole_table_against_brute_force(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality").collect()]
    want = brute_rate(docs, labels)
    got = queries.op13_quality_rules(spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        failed, kept, score = want[r.doc_id]
        assert (r.base_failed, r.kept) == (failed, kept)
        assert score is None and r.score is None or abs(score - r.score) < 1e-5


def test_odd_tables(spark):
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(1, text, "en", 7, "x"), (1, text, "en", 7, "x"), (2, None, None, 8, "y"), (3, "", "en", 9, "z"), (None, text, None, 1, "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, kept int, ratio string")
    labels = spark.createDataFrame([(1, 1), (1, 1), (None, 1), (2, None)], "doc_id long, quality int")
    got = qr.rate(docs, labels).collect()
    assert sorted((r.doc_id or -1, r.n_words, r.base_failed, r.kept, r.ratio) for r in got) == [
        (-1, 60, False, True, "w"), (1, 60, False, True, "x"), (1, 60, False, True, "x"), (2, 0, True, False, "y"), (3, 0, True, False, "z")
    ]
    kept = qr.keep_good(docs, labels)
    assert kept.columns == docs.columns and sorted(r.kept for r in kept.collect()) == [1, 7, 7]
    assert qr.rate(docs.limit(0), labels).count() == 0
    assert qr.rate(docs, labels.limit(0)).where("kept").count() == 3
