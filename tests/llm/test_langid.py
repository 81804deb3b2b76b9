import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from farebox.llm import langid as li


def plain(text):
    out = []
    for c in text or "":
        c = (c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else "\0"
        if c != "\0" or not out or out[-1] != "\0":
            out.append(c)
    return "".join(out)


def brute_phrases(text, reference):
    """Greedy parse of every segment by searching the reference itself."""
    count = 0
    for k in range(0, len(text), li.SEGMENT):
        part, i = text[k : k + li.SEGMENT], 0
        while i < len(part):
            n = 1
            while i + n < len(part) and part[i : i + n + 1] in reference and part[i : i + n] in reference:
                n += 1
            i, count = i + n, count + 1
    return count


@pytest.mark.parametrize("seed", range(6))
def test_phrases_equal_direct_parsing(seed):
    rng = random.Random(seed)
    make = lambda n: "".join(rng.choice("aabÉz ,.日") for _ in range(n))
    references = {"x": make(300), "y": make(40), "z": "q"}
    texts = [make(rng.choice([0, 1, 5, 100, 511, 512, 513, 1500])) for _ in range(12)] + [None, "", "!!", "ß𝔘ſ"]
    automata = li.Automata(references)
    text, limits = li.normalised(pa.array(texts, pa.string()))
    got = automata.phrases(text, limits)
    rows = ["".join(chr(c) for c in text[a:b]) for a, b in zip(limits, limits[1:])]
    assert rows == [plain(t) for t in texts]
    for k, name in enumerate(automata.languages):
        assert got[k].tolist() == [brute_phrases(r, plain(references[name])) for r in rows]


def test_suffix_automaton_spells_all_substrings():
    steps = li.suffix_automaton([1, 2, 1, 1, 2, 3])
    paths, todo = set(), [(0, ())]
    while todo:
        state, path = todo.pop()
        paths.add(path)
        todo += [(b, (*path, a)) for a, b in steps[state].items()]
    s = (1, 2, 1, 1, 2, 3)
    assert paths == {s[i:j] for i in range(7) for j in range(i, 7)}


def corpus():
    rng = random.Random(1)
    words = {"en": ["the", "this", "with", "thing", "wash"], "es": ["para", "señor", "que", "niño", "llama"]}
    rows = [(k, " ".join(rng.choice(words[l]) for _ in range(rng.randint(3, 40))), l, "s") for k in range(200) for l in [rng.choice(["en", "es"])]]
    return rows + [(None, "the thing with this", None, "s"), (900, None, "en", "s"), (901, "", "es", "s"), (902, "12 !?", "en", "s"), (3, rows[3][1], rows[3][2], "s")]


def test_frames(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    known = li.references(docs)
    learned = {plain(t) for i, t, l, _ in rows if i is not None and l and t and zlib.crc32(str(i).encode()) % 5}
    assert all(set(plain(x).split("\0")) <= {w for t in learned for w in t.split("\0")} for x in known.values())
    got = li.identify(docs, known).collect()
    assert len(got) == len(rows)
    for r in got:
        if not any(c.isalpha() for c in r.text or ""):
            assert (r.lang_pred, r.score, r.bits) == ("und", 0.0, None)
        else:
            assert r.lang_pred == (r.lang or "en") and 0.5 <= r.score <= 1
    assert li.identify(docs.limit(0), known).count() == 0
    none = li.identify(docs, li.references(docs.limit(0))).select("lang_pred").distinct().collect()
    assert [r.lang_pred for r in none] == ["und"]
    bounded = li.references(docs, size=100)
    assert all(len(t.replace("\n", "")) <= 100 for t in bounded.values())


def test_held_out(spark):
    got = [r.h for r in spark.range(40).select(li.held_out("id").alias("h")).collect()]
    assert got == [zlib.crc32(str(k).encode()) % 5 == 0 for k in range(40)]
    assert np.all(li.letters()[[65, 97, 48, 0xC9]] == [97, 97, 0, 0xE9])


def test_reference_from_few_long_documents(spark):
    """A language in one long document, and one with most of its characters in it, get all they are due."""
    one = "".join(f"palabra{k} " for k in range(180_000))[:2_000_000]
    ids = [k for k in range(200) if zlib.crc32(str(k).encode()) % 5]
    rows = [(k, one, f"l{k}") for k in ids[:8]] + [(k, one[: 900 * (j + 1)], "mixed") for j, k in enumerate(ids[8:60])] + [(ids[60], one, "mixed")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    known = li.references(docs)
    assert sorted(known) == sorted([f"l{k}" for k in ids[:8]] + ["mixed"])
    assert all(len(t.replace("\n", "")) == li.REFERENCE for t in known.values())
    assert known == li.references(docs.repartition(5))


def test_many_letters_stay_small():
    """Eight languages, three of them with 3,000 letters: dense tables would be some 3 GB."""
    rng = random.Random(5)
    plain = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(li.REFERENCE))
    wide = lambda: "".join(chr(0x4E00 + min(int(rng.expovariate(1 / 400)), 2999)) for _ in range(li.REFERENCE))
    known = {f"l{k}": plain() if k < 5 else wide() for k in range(8)}
    automata = li.Automata(known)
    assert automata.nbytes() < 200 << 20 and sorted(automata.hashed) == [5, 6, 7]
    texts = pa.array([known["l2"][100:900], known["l6"][5000:5400], known["l7"][:50] + "zq"])
    assert automata.predict(texts)[0].to_pylist() == ["l2", "l6", "l7"]


@pytest.mark.parametrize("table_cells", [0, 150, 1 << 20])
def test_tables_and_hashes_agree(table_cells):
    rng = random.Random(table_cells)
    known = {x: "".join(rng.choice(letters + " ") for _ in range(60)) for x, letters in (("a", "abc"), ("b", "abcdefgh"), ("c", "xyz"))}
    text, limits = li.normalised(pa.array(["".join(rng.choice("abcdefghxyzñ ") for _ in range(n)) for n in (0, 3, 40, 1500)]))
    got = li.Automata(known, table_cells).phrases(text, limits)
    assert (got == li.Automata(known).phrases(text, limits)).all()
