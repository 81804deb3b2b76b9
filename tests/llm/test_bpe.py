import base64
import random

import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from farebox.llm import bpe

LINES = open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb").read()
VOCAB = bpe.vocabulary(LINES)
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, LINES.splitlines())}
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})

HARD = [
    "", " ", "  ", "a", " a", "a ", "a  b", "a\nb", "a \n b", "a\n\n  b\t c ", "don't  they'll I'm", "\x1c\x1d a\x1fb",
    "a\xa0b \xa0 c", " x　y", "x" * 1000, "=" * 777, "ab" * 500, "日本語のテキスト 一二三", "٣٤٥ ½ Ⅳ", "é" * 200,
    "emoji 👩‍👩‍👧 ok", "a\r\n\r\nb", "tab\tsep\t\tx", "<|endoftext|>", " " * 300 + "x", "\n" * 50, "von Donaudampfschifffahrtsgesellschaft!!!",
]


@pytest.mark.parametrize("leaf", [1, 3, 24])
def test_equals_library_on_hard_texts(leaf):
    got = bpe.encode_texts(pa.array(HARD + [None]), VOCAB, public_tokenizers.PATTERN, leaf).to_pylist()
    assert got == [LIBRARY.encode_ordinary(t) for t in HARD] + [[]]
    back = bpe.decode_ids(pa.array(got, pa.list_(pa.int32())), VOCAB).to_pylist()
    assert back == [t.encode() for t in HARD] + [b""]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(), max_size=4), st.sampled_from([1, 2, 5, 24]))
def test_equals_library_on_any_text(texts, leaf):
    got = bpe.encode_texts(pa.array(texts, pa.string()), VOCAB, public_tokenizers.PATTERN, leaf).to_pylist()
    assert got == [LIBRARY.encode_ordinary(t) for t in texts]


def test_join_equals_encoding_of_the_whole():
    rng = random.Random(5)
    for _ in range(300):
        data = bytes(rng.choice(b"aabbcdethn =0") for _ in range(rng.randint(0, 60)))
        cut = rng.randint(0, len(data))
        joined = VOCAB.join(VOCAB.encode_bytes(data[:cut]), VOCAB.encode_bytes(data[cut:]))
        assert joined == VOCAB.encode_bytes(data) == (LIBRARY._encode_single_piece(data) if data else [])


def test_frame_round_trip(spark, sf):
    docs = spark.createDataFrame(
        [(1, "Two  words\n", 9), (2, None, 8), (None, "", 7), (1, "Two  words\n", 9)], "doc_id long, text string, ids long"
    )
    rows = bpe.decode(bpe.encode(docs, LINES, public_tokenizers.PATTERN), LINES).collect()
    assert [r.ids for r in rows] == [LIBRARY.encode_ordinary(r.text or "") for r in rows]
    assert [bytes(r.decoded) for r in rows] == [(r.text or "").encode() for r in rows]
    assert len(rows) == 4
    again = bpe.round_trip(docs, LINES, public_tokenizers.PATTERN).collect()
    assert [(r.ids, bytes(r.decoded)) for r in again] == [(r.ids, bytes(r.decoded)) for r in rows]
    empty = bpe.decode(bpe.encode(docs.limit(0), LINES, public_tokenizers.PATTERN), LINES)
    assert empty.columns == ["doc_id", "text", "ids", "decoded"] and empty.count() == 0
