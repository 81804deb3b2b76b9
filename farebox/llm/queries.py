"""Registered queries of this subpackage: each name has a Spark function and, where SQL can say it, its SQL."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from farebox.llm import bpe, collocations, kneser_ney, langid, mtree, pii, prefix_trie, quality_rules, secret_scan, simhash, toxicity, warc
from farebox.llm import decontaminate as dc
from farebox.llm.arrays import span_digests
from farebox.session import checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rank_file(name: str = "byte_bpe_50k.tiktoken") -> bytes:
    """A vocabulary file of fixed size; tasks get its content with their code."""
    with open(public_tokenizers.path(name), "rb") as file:
        return file.read()


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document as spans."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find_personal_data(docs, keep=["doc_id"])
    return found.select("doc_id", *span_digests("personal", pii.KINDS))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document as spans."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secret_scan.find_secrets(docs, keep=["doc_id"])
    return found.select("doc_id", *span_digests("secrets", secret_scan.BASE_KINDS))


def op3_mtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five largest inner products of every fiftieth vector."""
    return mtree.top_inner_products(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


OP3_SQL = """
WITH e AS (SELECT vec_id, [floor(256 * x::DOUBLE)::BIGINT for x in embedding] AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
    FROM e q JOIN e c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text and the bytes they decode to, as digests."""
    ranks = rank_file()
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.round_trip(docs, ranks, public_tokenizers.PATTERN, keep=["doc_id"]).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as archives in the shared folder and read back."""
    path = f"{checkpoint_dir(spark)}/archives-{uuid.uuid4().hex}"
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    records = warc.read_archives(spark.read.parquet(path), payload=False)
    return records.select(
        F.col("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to", "problem"
    )


OP5_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
w AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS last FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, sha1(html) AS payload_digest,
    CASE WHEN n >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN n >= 1000 AND page_id <> last THEN last END AS refers_to, NULL::VARCHAR AS problem
FROM w
"""


def op6_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity of every document, and whether it is within its language's bound."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return kneser_ney.rate(docs, labels, keep=["doc_id", "lang"])


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate class of every document."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id")
    )


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from those that aren't held out."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels)
    found = toxicity.rate(docs.select("doc_id", "text"), model, keep=["doc_id"])
    return found.select(
        "doc_id",
        toxicity.held_out("doc_id").alias("held_out"),
        "score",
        (F.col("score") >= toxicity.DECIDE).cast("int").alias("predicted"),
    )


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from those that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    known = langid.references(docs)
    found = langid.identify(docs.select("doc_id", "text"), known, keep=["doc_id"])
    return found.select("doc_id", langid.held_out("doc_id").alias("held_out"), "lang_pred", "score")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside benchmark passages."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = dc.match_benchmark(docs, table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    found = marked.select("doc_id", "n_words", dc.n_hit("matches").alias("n_hit"), dc.item_list("matches").alias("items"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        dc.contaminated(F.col("n_words"), F.col("n_hit")).alias("contaminated"),
    )


# Words of documents and items; A-Z alone are lower-cased.
_WORDS = """regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"""
OP9_SQL = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
items AS (
    SELECT item_id, least(len(w), 13) AS m,
        unnest([array_to_string(w[i:i + 12], ' ') for i in range(1, greatest(len(w) - 12, 1) + 1)]) AS win
    FROM b WHERE len(w) > 0),
sizes AS (SELECT DISTINCT m FROM items),
places AS (
    SELECT r, m, unnest(range(1, len(w) - m + 2)) AS p,
        unnest([array_to_string(w[i:i + m - 1], ' ') for i in range(1, len(w) - m + 2)]) AS win
    FROM d, sizes WHERE len(w) >= m),
hits AS (SELECT r, p, m, item_id FROM places JOIN items USING (m, win)),
hit_words AS (SELECT r, count(DISTINCT q) AS n FROM (SELECT r, unnest(range(p, p + m)) AS q FROM hits) GROUP BY r),
found AS (SELECT r, list_sort(list(DISTINCT item_id::VARCHAR)) AS ids FROM hits GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_hit, coalesce(len(ids), 0)::BIGINT AS n_items,
    sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256,
    coalesce(n, 0) > 0 AND 20 * coalesce(n, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit_words USING (r) LEFT JOIN found USING (r)
"""


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 phrases of each language whose words hang together most."""
    return collocations.collocations(table(spark, sf_dir, "documents").select("text", "lang"))


OP11_SQL = """
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents),
lists AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM lists),
parts AS (SELECT lang, m, w[i:i + m - 1] AS words FROM starts, range(1, 5) t(m) WHERE i + m - 1 <= len(w)),
counts AS (SELECT lang, m, words, count(*) AS f FROM parts GROUP BY ALL),
totals AS (SELECT lang, sum(f) AS n FROM counts WHERE m = 1 GROUP BY lang),
many AS (SELECT * FROM counts WHERE f >= 30),
inner_parts AS (
    SELECT lang, words[s:s + k - 1] AS words, max(f) AS longer
    FROM many, range(2, 4) a(k), range(1, 4) b(s) WHERE m > 2 AND k < m AND s + k - 1 <= m GROUP BY ALL),
kept AS (
    SELECT many.* FROM many LEFT JOIN inner_parts USING (lang, words)
    WHERE m > 1 AND (longer IS NULL OR 100 * longer::HUGEINT < 80 * f::HUGEINT)),
cuts AS (
    SELECT k.lang, k.words, k.f AS a, c.k AS cut, l.f AS l, r.f AS r, (2000000 * k.f::HUGEINT) // (l.f + r.f) AS score
    FROM kept k JOIN range(1, 4) c(k) ON c.k < k.m
    JOIN many l ON l.lang = k.lang AND l.words = k.words[1:c.k]
    JOIN many r ON r.lang = k.lang AND r.words = k.words[c.k + 1:]),
worst AS (SELECT *, row_number() OVER (PARTITION BY lang, words ORDER BY score, cut) AS o FROM cuts),
ranked AS (
    SELECT lang, array_to_string(words, ' ') AS phrase, a, l, r, score,
        row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(words, ' ')) AS rank
    FROM worst WHERE o = 1)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of all conversations' beginnings."""
    return prefix_trie.conversation_trie(table(spark, sf_dir, "conversations"))


# The checksum's table of 256 steps, and the checksum of a string of ASCII characters.
_CRC_TABLE = """list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"""
_CRC = """xor(list_reduce(list_prepend(4294967295, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295)"""
OP12_SQL = f"""
WITH own AS (
    SELECT conv_id AS c, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}}
        ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(coalesce(text, ''))) AS turns
    FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1),
sums AS (SELECT c, turns, ({_CRC} % 4)::INTEGER AS h FROM own, (SELECT {_CRC_TABLE} AS t)),
seqs AS (
    SELECT s.c, list_concat(coalesce(b.turns, [])[1:s.h], s.turns[s.h + 1:]) AS turns
    FROM sums s LEFT JOIN own b ON b.c = s.c - s.c % 20),
places AS (SELECT c, len(turns) AS size, unnest(range(len(turns) + 1)) AS d, turns FROM seqs),
heads AS (SELECT c, size, d, turns[1:d] AS head FROM places),
nodes AS (
    SELECT head, any_value(d) AS d, min(c) AS first, count(*) AS n,
        coalesce(sha256(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE size = d)), sha256('')) AS ends
    FROM heads GROUP BY head),
kids AS (SELECT head[1:d - 1] AS head, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY 1),
full_nodes AS (
    SELECT nodes.*, coalesce(n_children, 0) AS n_children,
        CASE WHEN d > 0 THEN (n - 1) * len(regexp_extract_all(head[d].text, '[^\x20\x09-\x0D]+')) ELSE 0 END AS own
    FROM nodes LEFT JOIN kids USING (head)),
ways AS (SELECT head, d, n_children, own, unnest(range(d + 1)) AS a FROM full_nodes),
below AS (
    SELECT head[1:a] AS head, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(own) AS saved
    FROM ways GROUP BY 1)
SELECT f.first::BIGINT AS conv_id, f.d::BIGINT AS depth, p.first::BIGINT AS parent_conv_id, f.n::BIGINT AS n_convs,
    f.n_children::BIGINT AS n_children, b.n_leaves::BIGINT AS n_leaves, b.saved::BIGINT AS saved_tokens, f.ends AS ends_sha256
FROM full_nodes f JOIN below b ON b.head = f.head LEFT JOIN nodes p ON f.d > 0 AND p.head = f.head[1:f.d - 1]
"""


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form of every document, its likelihood ratio, and whether it is kept."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality_rules.rate(docs, labels, keep=["doc_id"])


QUERIES = {
    "op1_pii": (op1_pii, None),
    "op2_secret_scan": (op2_secret_scan, None),
    "op3_mtree": (op3_mtree, OP3_SQL),
    "op4_bpe": (op4_bpe, None),
    "op5_warc": (op5_warc, OP5_SQL),
    "op6_kneser_ney": (op6_kneser_ney, None),
    "op7_simhash": (op7_simhash, None),
    "op8_toxicity": (op8_toxicity, None),
    "op9_decontaminate": (op9_decontaminate, OP9_SQL),
    "op10_langid": (op10_langid, None),
    "op11_collocations": (op11_collocations, OP11_SQL),
    "op12_prefix_trie": (op12_prefix_trie, OP12_SQL),
    "op13_quality_rules": (op13_quality_rules, None),
}
