import random

import pytest
import xxhash

from farebox.llm import simhash as sh


def brute_fingerprint(text, size=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in low).split(" ") if w]
    shingles = [" ".join(words[k : k + size]) for k in range(len(words) - size + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(nodes, radius=2):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a in nodes:
        for b in nodes:
            if bin((a ^ b) & (2**64 - 1)).count("1") <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("text", ["", "One", "one TWO", "One two\x0bthree", "a b c d e a b c d e", "Äpfel ÉTÉ x\x1cy z \xa0 w"])
def test_fingerprint(text):
    assert sh.fingerprint(text.encode()) & (2**64 - 1) == brute_fingerprint(text)


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 5])
def test_bit_planes_equal_direct_distances(radius):
    rng = random.Random(radius)
    seeds = [rng.getrandbits(64) for _ in range(6)]
    entries = sorted({sh.signed(s ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 4))) & (2**64 - 1)) for s in seeds for _ in range(30)})
    planes = [sum((e >> p & 1) << j for j, e in enumerate(entries)) for p in range(64)]
    full = (1 << len(entries)) - 1
    for e in entries:
        near = sh.within(planes, e & (2**64 - 1), radius, full)
        assert near == sum(1 << j for j, o in enumerate(entries) if bin((e ^ o) & (2**64 - 1)).count("1") <= radius)
    links, expected = sh.forest(entries, radius), brute_components(entries, radius)
    root = {n: n for n in entries} | dict(links)
    assert {n: expected[n] for n in entries} == {n: min(m for m in entries if root[m] == root[n]) for n in entries}


def near_rows(seed, n):
    rng = random.Random(seed)
    base = [rng.getrandbits(64) for _ in range(n)]
    out = []
    for b in base:
        out.append(b)
        for _ in range(rng.randint(0, 5)):
            b ^= 1 << rng.randrange(64)
            b ^= 1 << rng.randrange(64)
            out.append(b)
    return [sh.signed(x) for x in out]


@pytest.mark.parametrize("bucket", [1, 3, 4096])
def test_components_with_cut_buckets(spark, bucket):
    fps = near_rows(7, 12) + [0, 0, 1, 3]
    rows = spark.createDataFrame([(k, f) for k, f in enumerate(fps)], "id long, fp long")
    got = {r.fp: r.component for r in sh.assign_components(rows, "id", bucket=bucket).collect()}
    roots = brute_components(sorted(set(fps)))
    least = {}
    for k, f in enumerate(fps):
        least[roots[f]] = min(least.get(roots[f], k), k)
    assert got == {f: least[roots[f]] for f in set(fps)}


def test_documents_and_keep_one(spark):
    texts = ["a b c d e f", "A B C D E F", "other words entirely here now", "", None, "other words  entirely here now", "solo text of its own"]
    rows = [(10 + k, t, k) for k, t in enumerate(texts)] + [(None, "solo text of its own", 1), (None, "null id only text here", 2), (10, "a b c d e f", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component long")
    got = sh.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    assert sorted((r.doc_id or -1, r.component or -1) for r in got) == [
        (-1, -1), (-1, 16), (10, 10), (10, 10), (11, 10), (12, 12), (13, 13), (14, 13), (15, 12), (16, 16)
    ]
    kept = sh.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or -1, r.text) for r in kept.collect()) == [
        (-1, "null id only text here"), (10, "a b c d e f"), (12, texts[2]), (13, ""), (16, texts[6])
    ]
    assert sh.near_duplicates(docs.limit(0)).count() == 0
    assert sh.keep_one(docs.limit(0)).count() == 0
