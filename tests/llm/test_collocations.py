import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from farebox.llm import collocations as co


def brute(rows, least, top):
    """Rows (text, lang) to (lang, rank, phrase, a, l, r, n, score) by direct counting."""
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for size in range(1, 5):
                f[lang].update(tuple(words[k : k + size]) for k in range(len(words) - size + 1))
    out = []
    for lang, counts in f.items():
        many = {p: c for p, c in counts.items() if c >= least}
        found = []
        for phrase, a in many.items():
            size = len(phrase)
            around = [c for q, c in many.items() if len(q) > size and any(q[k : k + size] == phrase for k in range(len(q) - size + 1))]
            if size < 2 or any(100 * c >= 80 * a for c in around):
                continue
            score, _, left, right = min((2000000 * a // (counts[phrase[:k]] + counts[phrase[k:]]), k, counts[phrase[:k]], counts[phrase[k:]]) for k in range(1, size))
            found.append((-score, -a, " ".join(phrase).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def as_rows(df):
    return sorted((r.lang, r.rank, r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect())


def table(seed, n, vocabulary, langs):
    rng = random.Random(seed)
    make = lambda: "".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", "\t", "  ", ". ", "\n", ""]) for _ in range(rng.randint(0, 25)))
    return [(make(), rng.choice(langs)) for _ in range(n)]


@pytest.mark.parametrize(
    "seed, least, top, vocabulary, langs",
    [(1, 5, 2000, ["a", "B", "b", "Ä"], ["en", None, "und"]), (2, 3, 7, ["la", "LA", "x"], ["en"]), (3, 2, 2000, ["ein", "zwei", "drei", "vier", "\xa0", "漢"], ["de", "fr"])],
)
def test_collocations_equal_brute_force(spark, seed, least, top, vocabulary, langs):
    rows = table(seed, 120, vocabulary, langs) + [(None, "en"), ("", None), ("a b " * 500, "en"), ("a " * 300, "en")]
    docs = spark.createDataFrame(rows, "text string, lang string")
    assert as_rows(co.collocations(docs, least=least, top=top)) == brute(rows, least, top)


def test_full_bins_change_nothing(spark):
    """With hardly any bins little is cut, and the counts are the same."""
    rows = table(5, 150, [f"w{k}" for k in range(40)], ["en"]) * 2
    docs = spark.createDataFrame(rows, "text string, lang string")
    assert as_rows(co.collocations(docs, least=4, bin_bits=12)) == brute(rows, 4, 2000)


def test_bins_never_miss_a_frequent_phrase():
    part = pa.RecordBatch.from_pydict({"text": ["a b c a b c. a b c", "A b c"], "lang": ["en", "en"]})
    found, piece = co.cut_words(part)
    pairs, triples, fours = co.phrase_bins(found, piece, co.languages(part), co.BIN_BITS)
    assert [len(x[0]) for x in (pairs, triples, fours)] == [9, 6, 3]
    assert sorted(Counter(triples[1].tolist()).values()) == [1, 1, 4]


@pytest.mark.parametrize("bin_bits", [3, 12, 26, co.BIN_BITS])
def test_packed_bins_unpack(bin_bits):
    bins = np.random.default_rng(bin_bits).integers(0, 1 << bin_bits, 3000)
    bins = np.concatenate([bins, bins[:500], bins[:20].repeat(40), [0, (1 << bin_bits) - 1]])
    known, n = np.unique(bins, return_counts=True)
    rows = [(block << co.span_bits(bin_bits), *co.unpack(*row)) for block, *row in co.pack(bins.copy(), 30, bin_bits)]
    assert np.concatenate([start + at for start, at, _ in rows]).tolist() == known.tolist()
    assert np.concatenate([times for *_, times in rows]).tolist() == np.minimum(n, 30).tolist()
    assert co.pack(bins[:0], 30, bin_bits) == []


def test_bins_outnumber_the_phrases_of_large_tables(spark):
    """Six gigabytes have some 50 phrases for each of 2 ** 26 bins, so that little was cut; many more bins cost a task no more memory."""
    assert 2**co.BIN_BITS >= 10**10
    docs = spark.createDataFrame([("one two three", "en")] * 30 + [("one two four", "en")] * 29, "text string, lang string")
    frequent = co.frequent_bins(docs, 30)
    assert len(frequent.value) == 2**co.TABLE_BITS // 8
    full = {"one", "two", "three", "one two", "two three", "one two three"}
    assert int(np.unpackbits(frequent.value).sum()) == len(full)
    rows = [(r.w1, r.w2, r.w3, r.w4) for r in co.windows(docs, frequent).select("w1", "w2", "w3", "w4").distinct().collect()]
    assert set(rows) == {("one", "two", "three", None), ("one", "two", None, None), ("two", "three", None, None), ("two", None, None, None), ("three", None, None, None), (None,) * 4}


def test_counts_add_up_over_tasks_and_packings(spark):
    """A phrase is counted in several packings of several tasks; one less than the least is not enough."""
    docs = spark.createDataFrame([("a b",)] * 29 + [("c d",)] * 30, "text string").selectExpr("text", "'en' AS lang").repartition(4)
    for held in (1, 7, co.HELD):
        bits = b"".join(r.bits for r in co.count_bins(docs, 30, 20, held).collect())
        assert int(np.unpackbits(np.frombuffer(bits, np.uint8)).sum()) == 3


def test_odd_tables(spark):
    rows = [("one two", "en", 1, "x"), (None, None, 2, "y")] * 40
    docs = spark.createDataFrame(rows, "text string, lang string, n int, w1 string")
    assert as_rows(co.collocations(docs)) == [("en", 1, "one two", 40, 40, 40, 80, 1000000)]
    assert co.collocations(docs.limit(0)).count() == 0
    assert co.collocations(docs.limit(3)).count() == 0


def test_counts_beyond_64_bits(spark):
    """The score's product passes 64 bits; plain longs would wrap."""
    big = 2**61
    row = spark.createDataFrame([(big, big, big + 1)], "a long, l long, r long")
    score = "(cast(a AS decimal(20,0)) * 2000000) div (cast(l AS decimal(20,0)) + cast(r AS decimal(20,0)))"
    assert row.selectExpr(f"{score} AS s").first().s == 2000000 * big // (2 * big + 1)
