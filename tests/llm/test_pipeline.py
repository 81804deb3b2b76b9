"""The pipeline against plain Python on whole tables, stage by stage."""

import base64
import math
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pyarrow as pa
import tiktoken

import corpus_pipeline
from farebox.llm import kneser_ney as kn
from farebox.llm import secret_scan
from tests.llm.test_decontaminate import brute as hits
from tests.llm.test_kneser_ney import brute_model
from tests.llm.test_simhash import brute_components, brute_fingerprint


def good(docs, labels):
    trusted = {i for i, q, _ in labels if q == 1}
    held = lambda i: zlib.crc32(str(i).encode()) % kn.HELD_OUT == 0
    mean_logp = brute_model([d["text"] for d in docs if d["doc_id"] in trusted and not held(d["doc_id"])])
    score = lambda t: mean_logp(t) + kn.ALLOWANCE / math.sqrt(len(t.encode()))
    scores = {d["doc_id"]: score(d["text"]) for d in docs if d["text"]}
    groups = defaultdict(list)
    for d in docs:
        if d["doc_id"] in trusted and held(d["doc_id"]) and d["text"]:
            for key in (d["lang"], "every language"):
                groups[key].append(math.floor(scores[d["doc_id"]] * kn.STEPS))
    bound = {}
    for key, steps in groups.items():
        steps.sort()
        bound[key] = next(s for n, s in enumerate(steps, 1) if n >= kn.QUANTILE * len(steps)) / kn.STEPS - kn.MARGIN
    return [d for d in docs if not d["text"] or scores[d["doc_id"]] >= bound.get(d["lang"], bound["every language"])]


def test_pipeline_equals_plain_python(spark, sf):
    rows = [r.asDict() for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    kept = good(rows, labels)
    fps = {d["doc_id"]: brute_fingerprint(d["text"]) for d in kept}
    roots = brute_components(sorted(set(fps.values())))
    least = {}
    for i, f in fps.items():
        least[roots[f]] = min(least.get(roots[f], i), i)
    kept = [d for d in kept if d["doc_id"] == least[roots[fps[d["doc_id"]]]]]
    found = hits([d["text"] for d in kept], items, 13)
    kept = [d for d, (n, h, _) in zip(kept, found) if not (h and 20 * h >= n)]
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {}
    for d in kept:
        text = d["text"] or ""
        spans = secret_scan.Scanner().scan(pa.array([text])).to_pylist()[0]
        covered = sorted({p for s in spans for p in range(s["start"], s["end"])})
        starts = {s["start"] for s in spans}
        out = "".join("[secret]" if p in starts and p - 1 not in covered else "" if p in covered else c for p, c in enumerate(text))
        want[d["doc_id"]] = (d["lang"], d["source"], len(out), library.encode_ordinary(out))
    got = corpus_pipeline.run(spark, sf).collect()
    assert all(r.round_trip and r.n_tokens == len(r.ids) for r in got)
    assert {r.doc_id: (r.lang, r.source, r.n_chars, r.ids) for r in got} == want
    assert len(got) == len(want) and 50 < len(got) < len(rows)


def test_stages_take_odd_tables(spark, sf, tmp_path):
    """Nulls, empty texts, repeated rows and extra columns go through every stage."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(40)
    odd = spark.createDataFrame(
        [(None, None, None, None, None), (5000, "", "en", "s", 0), (5001, None, "en", "s", None), (None, "", None, None, 0)], docs.schema
    )
    docs = docs.unionByName(odd).unionByName(docs.limit(3)).selectExpr("*", "1 AS kept", "'x' AS fp", "2 AS matches", "3 AS redacted")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        assert stage(spark, docs.limit(0), sf).count() == 0
        rows = out.collect()
        assert Counter(r.doc_id for r in rows)[5000] <= 1 or name != "near_duplicates"
        if name != "tokens":
            assert out.columns == corpus_pipeline.COLUMNS
