"""The trie of shared conversation beginnings, by the recursion of van Emde Boas.

A sequence of turns is rows (conversation, position), so no conversation is ever one value. The
depth is rounded up to a power of two and cut at half: the beginnings up to the cut are the upper
trie, what follows each of them is a lower forest, and both are cut again, all tries of a level in
one job, down to single turns.

* Up: the names of aligned stretches of turns, each a digest of its two halves' names.
* Down: a cut prefix is named by the prefix at which its trie starts and the stretch from there to
  the cut. Equal prefixes get equal names, whatever conversation they come from, so grouping by
  name merges them; names are the first 128 bits of SHA-256.
* Graft: at every level a node of a lower forest hands its own figures to the cut prefix at which
  that forest is grafted, their sum is handed on to the prefix and those above it in the upper
  trie. Two depths are parted by one level alone, so nothing counts twice, and levels don't wait
  for each other.

Positions come from a window over a conversation's turns, which streams and spills. Every other
step groups or joins by (conversation, position) or combines before its shuffle; the parents of
very many nodes (over a ``HOT``-th of all, so fewer than ``HOT``) are joined as a broadcast.
Conversations that end at a node are digested in ascending order from blocks of ids, so a task holds
but a batch of blocks however many end there.

Turns are ordered by turn number (null first), equal ones by role and the text's SHA-256; null role
or text is empty. Rows with a null conversation id belong to no conversation. Repeated rows are turns of their
own. An empty table has no nodes, not even a root. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from farebox.session import materialize

HOT = 1000
BLOCK_BITS = 9
WORD = r"[^\x20\x09-\x0D]+"


def digest(*parts: Column) -> Column:
    return F.substring(F.unhex(F.sha2(F.concat(*parts), 256)), 1, 16)


def root_name() -> Column:
    return digest(F.lit("root").cast("binary"))


def turns_of(talks: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, pos, turn, words): a digest and the number of words of every turn, positions from 0."""
    who, said = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role, text))
    rows = talks.where(F.col(f"`{conv_id}`").isNotNull()).select(
        F.col(f"`{conv_id}`").cast("long").alias("conv"), F.col(f"`{turn}`").alias("at"), who.alias("who"),
        F.sha2(said, 256).alias("said"), said.alias("text"),
    )
    order = Window.partitionBy("conv").orderBy(F.col("at").asc_nulls_first(), "who", "said")
    words = F.regexp_count("text", F.lit(WORD)).cast("long")
    rows = rows.select("conv", "at", "who", "said", words.alias("words"))
    return rows.select(
        "conv",
        (F.row_number().over(order) - 1).cast("long").alias("pos"),
        digest(F.unhex("said"), F.col("who").cast("binary")).alias("turn"),
        "words",
    )


def rebuild(turns: DataFrame, group: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin like the first of their ``group``, and (conv, length) of each.

    The first h turns (crc32 of the id, modulo ``most``) become those of that conversation.
    """
    heads = [F.max(F.when(F.col("pos") == k, F.struct("turn", "words"))).alias(f"t{k}") for k in range(most - 1)]
    first = turns.where((F.col("conv") % group == 0) & (F.col("pos") < most - 1)).groupBy("conv").agg(*heads)
    first = first.withColumnRenamed("conv", "base")
    sizes = turns.groupBy("conv").agg(F.count("*").alias("size")).withColumn("base", F.col("conv") - F.col("conv") % group)
    sizes = sizes.withColumn("h", (F.crc32(F.col("conv").cast("string").cast("binary")) % most).cast("int"))
    taken = F.filter(F.slice(F.array(*[f"t{k}" for k in range(most - 1)]), F.lit(1), F.col("h")), lambda t: t.isNotNull())
    shared = materialize(sizes.join(first, "base", "left").select("conv", "size", "h", taken.alias("taken")))
    begin = shared.select("conv", F.posexplode("taken").alias("pos", "t")).select("conv", F.col("pos").cast("long").alias("pos"), "t.*")
    shift = F.size("taken") - F.col("h")
    rest = turns.join(shared.select("conv", "h", shift.alias("shift")), "conv").where("pos >= h")
    rest = rest.select("conv", (F.col("pos") + F.col("shift")).alias("pos"), "turn", "words")
    length = F.size("taken") + F.greatest(F.col("size") - F.col("h"), F.lit(0))
    return begin.unionByName(rest), shared.select("conv", length.cast("long").alias("length"))


def name_prefixes(turns: DataFrame) -> tuple[DataFrame, int]:
    """(conv, depth, name, words, parent) of every beginning of every sequence, and the number of levels."""
    deepest = turns.agg(F.max("pos")).first()[0]
    levels = 0 if deepest is None else (deepest + 1).bit_length()
    stretches = [turns.select("conv", F.col("pos").alias("j"), F.col("turn").alias("s"))]
    for _ in range(1, levels):
        half = [F.max(F.when(F.col("j") % 2 == k, F.col("s"))).alias(f"s{k}") for k in (0, 1)]
        pairs = stretches[-1].groupBy("conv", F.shiftright("j", 1).alias("j")).agg(*half)
        stretches.append(materialize(pairs.where("s0 IS NOT NULL AND s1 IS NOT NULL").select("conv", "j", digest(F.col("s0"), F.col("s1")).alias("s"))))
    names = turns.where("pos = 0").select("conv", F.lit(0).cast("long").alias("i"), root_name().alias("name"))
    for stretch in reversed(stretches):
        # Known are the prefixes that end at multiples of twice the stretch; its first halves lead to the cuts.
        cut = names.join(stretch.where("j % 2 = 0").select("conv", F.shiftright("j", 1).alias("i"), "s"), ["conv", "i"])
        cut = cut.select("conv", (F.col("i") * 2 + 1).alias("i"), digest(F.col("name"), F.col("s")).alias("name"))
        names = materialize(names.select("conv", (F.col("i") * 2).alias("i"), "name").unionByName(cut))
    path = names.where("i > 0").withColumnRenamed("i", "depth")
    path = path.join(turns.select("conv", (F.col("pos") + 1).alias("depth"), "words"), ["conv", "depth"])
    above = F.lag("name").over(Window.partitionBy("conv").orderBy("depth"))
    return materialize(path.withColumn("parent", F.coalesce(above, root_name()))), levels


def graft(path: DataFrame, nodes: DataFrame, levels: int) -> DataFrame:
    """(name, leaves, saved): what the nodes below each node have of their ``leaf`` and ``own``."""
    level = F.explode(F.sequence(F.lit(0), F.lit(max(levels - 1, 0)))).alias("k")
    ends = F.expr("shiftleft(shiftright(depth - 1, k), k)")
    # A node in the second half of its trie belongs to the forest at the cut before it.
    lower = nodes.select(F.col("first").alias("conv"), "depth", "leaf", "own", level).where("shiftright(depth - 1, k) % 2 = 1")
    lower = lower.select("conv", ends.alias("depth"), "k", "leaf", "own")
    lower = lower.groupBy("conv", "depth", "k").agg(F.sum("leaf").alias("leaf"), F.sum("own").alias("own"))
    forests = lower.join(path.select("conv", "depth", "name"), ["conv", "depth"])
    forests = forests.groupBy("k", "depth", "name").agg(F.sum("leaf").alias("leaf"), F.sum("own").alias("own"), F.min("conv").alias("conv"))
    forests = forests.select("conv", "k", F.expr("shiftright(depth - 1, k)").alias("part"), "leaf", "own")
    # The cut prefix and those above it in the upper trie, along a conversation that has them all.
    upper = path.select("conv", "name", "depth", level).select("conv", "name", "k", F.expr("shiftright(depth - 1, k)").alias("part"))
    handed = upper.where("part % 2 = 0").join(forests, ["conv", "k", "part"])
    return handed.groupBy("name").agg(F.sum("leaf").alias("leaves"), F.sum("own").alias("saved"))


def ends_digest(ends: DataFrame) -> DataFrame:
    """(name, ends_sha256) from (name, conv): the ids of each name, ascending, comma-joined."""
    texts = F.array_join(F.transform(F.sort_array(F.collect_list("conv")), lambda c: c.cast("string")), ",")
    blocks = ends.groupBy("name", F.shiftright("conv", BLOCK_BITS).alias("block")).agg(texts.alias("ids"))
    blocks = blocks.repartition("name").sortWithinPartitions("name", "block").select("name", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None
        for batch in batches:
            names, done = [], []
            for name, ids in zip(batch.column("name").to_pylist(), batch.column("ids")):
                if name == last:
                    state.update(b",")
                else:
                    if last is not None:
                        names.append(last)
                        done.append(state.hexdigest())
                    last, state = name, hashlib.sha256()
                state.update(ids.as_py().encode())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(done, pa.string())], names=["name", "ends_sha256"])
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([last], pa.binary()), pa.array([state.hexdigest()])], names=["name", "ends_sha256"])

    return blocks.mapInArrow(run, "name binary, ends_sha256 string")


def with_parent(nodes: DataFrame) -> DataFrame:
    """Add the smallest member of each node's parent, null for the root."""
    total = nodes.agg(F.count("*")).first()[0]
    above = nodes.select(F.col("name").alias("parent"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    hot = above.where(F.col("n_children") * HOT > total).drop("n_children")
    rest = above.where((F.col("n_children") * HOT <= total) & (F.col("n_children") > 0)).drop("n_children")
    found = nodes.join(F.broadcast(hot), "parent", "left")
    return found.where("parent_conv_id IS NOT NULL").unionByName(
        found.where("parent_conv_id IS NULL").drop("parent_conv_id").join(rest, "parent", "left")
    )


def build(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """One row per node of the trie of the sequences ``turns`` (conv, pos, turn, words), ``lengths`` (conv, length)."""
    turns, lengths = materialize(turns), materialize(lengths)
    path, levels = name_prefixes(turns)
    nodes = path.groupBy("name").agg(
        F.min("conv").alias("first"), F.count("*").alias("n_convs"),
        *[F.first(c).alias(c) for c in ("depth", "words", "parent")],
    )
    root = lengths.agg(F.min("conv").alias("first"), F.count("*").alias("n_convs")).where("n_convs > 0")
    root = root.select(root_name().alias("name"), "first", "n_convs", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("words"), F.lit(None).cast("binary").alias("parent"))
    nodes = nodes.unionByName(root)
    children = nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("name")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, "name", "left").na.fill(0, ["n_children"])
    nodes = materialize(nodes.withColumn("leaf", (F.col("n_children") == 0).cast("long")).withColumn("own", (F.col("n_convs") - 1) * F.col("words")))
    below = graft(path, nodes.where("depth > 0"), levels)
    # All other nodes are below the root.
    all_nodes = nodes.where("depth > 0").agg(F.sum("leaf").alias("leaves"), F.sum("own").alias("saved"))
    below = below.unionByName(all_nodes.select(root_name().alias("name"), "leaves", "saved"))
    last = path.join(lengths.withColumnRenamed("length", "depth"), ["conv", "depth"]).select("name", "conv")
    last = last.unionByName(lengths.where("length = 0").select(root_name().alias("name"), "conv"))
    found = nodes.join(below, "name", "left").join(ends_digest(last), "name", "left").select(
        "name", "parent", F.col("first").alias("conv_id"), "depth", "n_convs", "n_children",
        (F.col("leaf") + F.coalesce("leaves", F.lit(0))).alias("n_leaves"),
        (F.col("own") + F.coalesce("saved", F.lit(0))).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )
    return with_parent(materialize(found)).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"
    )


def conversation_trie(talks: DataFrame, **names: str) -> DataFrame:
    """The trie of all conversations, rebuilt with the beginnings that their groups share."""
    turns = materialize(turns_of(talks, **names))
    return build(*rebuild(turns))
