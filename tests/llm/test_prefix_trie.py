import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from farebox.llm import prefix_trie as pt


def brute_trie(seqs):
    """``seqs``: {conv: [(role, text), ...]}; rows as the operator returns them."""
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in seqs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    kids = defaultdict(int)
    for node in members:
        if node:
            kids[node[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for node, have in members.items():
        own = (len(have) - 1) * len(re.findall("[^ \t-\r]+", node[-1][1])) if node else 0
        for a in range(len(node) + 1):
            leaves[node[:a]] += not kids[node]
            saved[node[:a]] += own
    return sorted(
        (
            min(have), len(node), min(members[node[:-1]]) if node else -1, len(have), kids[node], leaves[node], saved[node],
            hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest(),
        )
        for node, have in members.items()
    )


def brute_rebuild(rows):
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, r or "", hashlib.sha256((x or "").encode()).hexdigest(), x or ""))
    own = {c: [(r, x) for _, _, r, _, x in sorted(v)] for c, v in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = int(c - (abs(c) % 20) * (1 if c >= 0 else -1))
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


def as_rows(df):
    return sorted(
        (r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256)
        for r in df.collect()
    )


def talk(seed, convs, longest, vocabulary):
    rng = random.Random(seed)
    return [(c, t, rng.choice(["user", "assistant", None]), rng.choice(vocabulary)) for c in convs for t in range(rng.randint(0, longest))]


@pytest.mark.parametrize(
    "seed, convs, longest, vocabulary",
    [(1, range(60), 7, ["a b", "c"]), (2, range(-25, 25), 3, ["x", "", None, "two\x0bwords"]), (3, [5, 20, 21, 40], 40, ["a"]), (4, [1, 2, 3, 99], 1, ["q"])],
)
def test_trie_equals_brute_force(spark, seed, convs, longest, vocabulary):
    rows = talk(seed, convs, longest, vocabulary)
    talks = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert as_rows(pt.conversation_trie(talks)) == brute_trie(brute_rebuild(rows))


def test_odd_tables(spark):
    """Nulls anywhere, ties of turns, repeated rows, columns named like the operator's own."""
    rows = [
        (None, 0, "user", "lost", 1), (7, None, None, None, 2), (7, 1, "b", "x y", 3), (7, 1, "a", "x", 4), (7, 1, "a", "x", 4),
        (20, 0, "user", "m " * 5000, 5), (21, 0, "user", "m " * 5000, 6), (22, 3, "user", "m " * 5000, 7),
    ]
    talks = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, conv int")
    assert as_rows(pt.conversation_trie(talks)) == brute_trie(brute_rebuild([r[:4] for r in rows]))
    assert pt.conversation_trie(talks.limit(0)).count() == 0


def test_hot_beginning_and_many_ends(spark):
    """Most conversations are equal or share their first turn: parents joined as a broadcast, ends over many blocks."""
    rows = [(c, t, "user", x) for c in range(0, 60_000, 20) for t, x in enumerate(["same", "also the same"])]
    rows += [(c, t, "user", x) for c in range(10, 42_000, 20) for t, x in enumerate(["same", "same", "same", f"own {c}"])]
    talks = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert as_rows(pt.conversation_trie(talks)) == brute_trie(brute_rebuild(rows))
