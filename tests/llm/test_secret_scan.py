import hashlib
import math
import random
import re
import time
from collections import Counter

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from farebox.llm import secret_scan as ss
from farebox.llm.arrays import span_digests


def base(text):
    text, found = text or "", []
    assign = r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
    found += [(m.start(), 0, m.end()) for m in re.finditer(assign, text, re.I | re.A) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return [(ss.BASE_KINDS[k], s, e) for s, k, e in sorted(found)]


PARTS = ["é", " ", "token", "PASSWORD", "ſecret", "api_key", "apikey", ":", "=", "'", '"', "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "x", "日", ".", "\n", "Kq9"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=14).map("".join), max_size=5))
def test_patterns_equal_direct_search(texts):
    spans = ss.Scanner().scan(pa.array(texts + [None], pa.string())).to_pylist()
    assert [[(s["kind"], s["start"], s["end"]) for s in row if s["base"]] for row in spans] == [base(t) for t in texts + [None]]


@pytest.mark.parametrize("cls", ss.CLASSES)
def test_windows_equal_direct_entropy(cls):
    rng = random.Random(1)
    for _ in range(200):
        alphabet = rng.choice([b"0123456789abcdef", b"ab1", b"abcdefghijklmnopqrstuvwxyz0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ+/"])
        data = bytes(rng.choice(alphabet) for _ in range(rng.randint(0, 90)))
        marked = set()
        for k in range(len(data) - cls.window + 1):
            window = data[k : k + cls.window]
            bits = -sum(n / cls.window * math.log2(n / cls.window) for n in Counter(window).values())
            if all(b in cls.members for b in window) and bits >= cls.bits - 1e-9 and all(any(b in g for b in window) for g in cls.groups):
                marked |= set(range(k, k + cls.window))
        spans = ss.entropy_windows(data, cls)
        assert {p for a, b in spans for p in range(a, b)} == marked


def test_entropy_adds_what_patterns_miss_and_words_stay():
    secret = "Zx9Qw7Lk2Vb8Nm4Rt6Yp1Sd3Fg5Hj0"
    texts = [
        f"bearer {secret} end", "é" + secret, "Donaudampfschifffahrtsgesellschaftskapitaen und so weiter",
        "123e4567-e89b-12d3-a456-426614174000", "snake_case_name_that_is_rather_long_indeed", "1234567890123456789012345",
    ]
    spans = ss.Scanner().scan(pa.array(texts)).to_pylist()
    assert [[texts[k][s["start"] : s["end"]] for s in row if not s["base"]] for k, row in enumerate(spans)] == [[secret], [secret], [], [], [], []]
    allowed = ss.Scanner(allow=[secret]).scan(pa.array(texts)).to_pylist()
    assert not any(s["kind"].startswith("entropy") for row in allowed for s in row)


def test_frames(spark):
    rows = [(1, "a token = 0123456789ab!", 5), (2, None, 6), (None, "", 7), (1, "a token = 0123456789ab!", 5), (3, "x" * 50_000 + " AKIA" + "Z9" * 10, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, secrets int")
    found = ss.find_secrets(docs, keep=["doc_id"]).select("doc_id", *span_digests("secrets", ss.BASE_KINDS)).collect()
    assert len(found) == 5
    for row, (doc_id, text, _) in zip(found, rows):
        expected = base(text)
        assert row.doc_id == doc_id and row.n_assign == sum(k == "assign" for k, _, _ in expected)
        assert row.base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in expected).encode()).hexdigest()
    clean = ss.redact(docs)
    assert clean.columns == docs.columns
    assert [r.text for r in clean.collect()] == ["a [secret]!", None, "", "a [secret]!", "x" * 50_000 + " [secret]"]
    assert ss.redact(docs.limit(0)).count() == 0


def test_many_keys_in_one_text_take_linear_time():
    rng = random.Random(4)
    keys = ["".join(rng.choice("0123456789abcdef") for _ in range(32)) for _ in range(1000)]
    scan = ss.Scanner()

    def took(n):
        text = " ".join(f"token={keys[k % 1000]}" if k % 2 else keys[k % 1000] for k in range(n))
        start = time.perf_counter()
        found = scan.scan(pa.array([text]))
        assert len(found[0]) == n + n // 2  # a hex span each, and an assignment for every other
        return time.perf_counter() - start

    took(1000)
    assert took(100_000) < 60 and took(40_000) < 9 * max(took(10_000), 0.05)


def test_covered_spans_equal_direct_search():
    rng = random.Random(8)
    for _ in range(50):
        spans = [(s, s + rng.randint(1, 9), "x") for s in (rng.randint(0, 40) for _ in range(rng.randint(0, 8)))]
        covered = ss.Covered(spans)
        for a in range(45):
            for b in range(a + 1, 50):
                assert covered.holds(a, b) == any(s <= a and b <= e for s, e, _ in spans)


def test_upper_case_keys():
    keys = ["JBSWY3DPEHPK3PXP", "K7QZ2MXW5VRT4NHB", "GEZDGNBVGY3TQOJQGEZDGNBVGY3TQOJQ"]
    text = "Codes: " + ", ".join(keys) + "; ABCDEFGHIJKLMNOPQRST, VERSION_2024, AAAA1111AAAA1111, ISO9001"
    spans = ss.Scanner().scan(pa.array([text])).to_pylist()[0]
    assert [text[s["start"]:s["end"]] for s in spans if s["kind"] == "entropy_base32"] == keys
