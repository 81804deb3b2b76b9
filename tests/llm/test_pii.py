import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from farebox.llm import pii
from farebox.llm.arrays import span_digests


def base(text):
    text, found = text or "", []
    rules = [
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda d, m: True),
        (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda d, m: all(int(p) <= 255 for p in m.split("."))),
        (r"[0-9]([\x20-]?[0-9])+", lambda d, m: 13 <= len(d) <= 19 and pii.luhn(d.encode())),
        (r"\+[0-9][\x20().0-9-]+[0-9]", lambda d, m: 9 <= len(d) <= 15),
    ]
    for kind, (pattern, good) in zip(pii.KINDS, rules):
        for m in re.finditer(pattern, text):
            if good(re.sub("[^0-9]", "", m[0]), m[0]):
                found.append((kind, m.start(), m.end()))
    return found


PARTS = ["é", " ", "a.b", "@", "x-y", ".", "com", "1", "22", "255", "256", "4111", "1111", "+", "(", ")", "-", "555", "\n", "4111111111111111", "at", "dot", "0099", "%"]


@settings(max_examples=600, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=18).map("".join), max_size=4))
def test_patterns_equal_direct_search(texts):
    spans = pii.scan(pa.array(texts + [None], pa.string()), pii.Weights.start()).to_pylist()
    assert [[(s["kind"], s["start"], s["end"]) for s in row if s["base"]] for row in spans] == [base(t) for t in texts + [None]]


def test_long_texts_take_linear_time():
    texts = ["1" * 200_000, "1." * 100_000, "a" * 200_000, "a@" * 100_000, "+1" * 100_000, "1 " * 100_000, "a at " * 40_000 + " dot "]
    assert pii.scan(pa.array(texts), pii.Weights.start()).to_pylist()[2] == []


def test_luhn():
    for n in range(2000):
        digits = str(n)
        doubled = [int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(digits))]
        assert pii.luhn(digits.encode()) == (sum(doubled) % 10 == 0)


def exact_marginals(w, x, observed, chain, skip):
    n, labels = len(x), len(pii.LABELS)
    p = np.zeros((n, labels))
    for state in np.ndindex(*[labels] * n):
        if any(o and s != o for o, s in zip(observed, state)):
            continue
        score = sum(x[i] @ w.unary[:, s] for i, s in enumerate(state) if not observed[i])
        score += sum(w.chain[state[a], state[b]] for a, b in chain) + sum(w.skip[state[a], state[b]] for a, b in skip)
        for i, s in enumerate(state):
            p[i, s] += np.exp(score)
    return p / p.sum(axis=1, keepdims=True)


@pytest.mark.parametrize("seed", range(4))
def test_messages_are_exact_on_trees(seed):
    rng = np.random.default_rng(seed)
    w = pii.Weights(rng.normal(size=(pii.N_FEATURES, 5)), rng.normal(size=(5, 5)), rng.normal(size=(5, 5)))
    x, observed = rng.normal(size=(5, pii.N_FEATURES)), np.array([0, 2, 0, 0, 0])
    chain, skip = np.array([[0, 1], [1, 2]]), np.array([[0, 3], [2, 4]])
    assert np.allclose(pii.marginals(w, x, observed, chain, skip), exact_marginals(w, x, observed, chain, skip), atol=1e-4)


def some_documents():
    rng = random.Random(8)
    rows = []
    for k in range(300):
        phone = f"+1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}"
        mail, ip = f"user{k}@host{k % 7}.example.com", ".".join(str(rng.randint(1, 250)) for _ in range(4))
        rows.append((k, f"Call {phone} or write {mail}; host {ip}, order 20{rng.randint(10, 99)}-{rng.randint(100, 999)}-{k:04d}99."))
    return rows


def test_field_finds_repeated_forms_and_leaves_others(spark):
    extra = [
        (1001, "Phone +1 (415) 555-2671. Some words stand between the two numbers of this text. Again (415) 555-2671 here."),
        (1002, "Card 4111 1111 1111 1111 was charged. Later on, and far away, it reads 4111/1111/1111/1111 in the log."),
        (1003, "Mail jo.doe@example.com first. After a good number of other words: jo.doe at example dot com again."),
        (1004, "Order 2024-555-0099 shipped in version 1.2.300.4 with parts 123456789012345678901."),
        (1005, None), (1006, ""), (None, "no data"), (1001, "Phone +1 (415) 555-2671."),
    ]
    docs = spark.createDataFrame(some_documents() + extra, "doc_id long, text string")
    got = pii.find_personal_data(docs)
    rows = [r for r in got.collect() if r.doc_id is None or r.doc_id > 1000]
    added = [[r.text[s.start : s.end] for s in r.personal if not s.base] for r in rows]
    assert added[:3] == [["(415) 555-2671"], ["4111/1111/1111/1111"], ["jo.doe at example dot com"]]
    assert not any(added[3:])
    digests = got.select("doc_id", "text", *span_digests("personal", pii.KINDS)).collect()
    for r in digests:
        want = base(r.text)
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in want).encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == w[0] for w in want) for k in pii.KINDS)
    assert pii.find_personal_data(docs.limit(0)).count() == 0
