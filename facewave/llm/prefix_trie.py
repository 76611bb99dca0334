"""Prefix trie of conversations by hashing blocks of turns.

A turn is a digest of its role and text, so texts are read once and never shuffled. Turns go into blocks of eight; conversations are grouped by their successive block digests first (each with
the digests before it), and a group of any size is one row from then on. Turn boundaries are refined only below a block after which several different blocks follow: there the distinct blocks,
not the conversations, are cut into turns and grouped again. Where one block follows, its turns are nodes as they stand.

What a subtree holds is summed block by block: within a block a node adds to at most seven others, and the tree of whole blocks is folded by doubled steps, in as many rounds as the longest
conversation's number of blocks has binary digits.

Odd rows: a null role or text is empty; rows without conv_id are left out; a null turn comes first; rows of one conversation with the same turn stand in the order of their digests, repeated
rows are repeated turns; extra columns are not read. An empty table has no nodes, conversations without turns are members of the root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from facewave.llm._shared import stored
from facewave.llm._text import tidy

BLOCK = 8
#: Turn numbers in a stretch that is numbered by itself, and ids in one text of ids.
STRETCH, IDS = 256, 4096
KEY = ["depth", "a", "b"]


def turn_digests(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, digest, bytes) of every row with a conv_id."""
    role, text = (F.coalesce(conversations[c].cast("string"), F.lit("")) for c in ("role", "text"))
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    rows = conversations.select(conversations["conv_id"].cast("long").alias("conv_id"), conversations["turn"].cast("long").alias("turn"), F.unhex(F.substring(F.sha2(whole, 256), 1, 32)).alias("digest"), F.octet_length(text).cast("long").alias("bytes"))
    return rows.where("conv_id is not null")


def numbered(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The turns with their number ``i`` in their conversation (from 0), and (conv_id, n). Turns are numbered in stretches of turn numbers, whose counts are added up apart: a long
    conversation is numbered in many tasks."""
    turns = turns.withColumn("stretch", F.coalesce(F.expr(f"turn div {STRETCH}"), F.lit(-(2**62))))
    counts = turns.groupBy("conv_id", "stretch").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("conv_id").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    here = F.row_number().over(Window.partitionBy("conv_id", "stretch").orderBy(F.asc_nulls_first("turn"), "digest")) - 1
    rows = turns.withColumn("here", here).join(counts.select("conv_id", "stretch", before.alias("before")), ["conv_id", "stretch"])
    return rows.select("conv_id", (F.col("here") + F.col("before")).alias("i"), "digest", "bytes"), counts.groupBy("conv_id").agg(F.sum("n").alias("n"))


def spliced(turns: DataFrame, convs: DataFrame, family: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt from the one that begins their family (the id less its remainder by ``family``): its first h turns, then their own after the first h, with h the id's crc32
    modulo ``most``."""
    convs = convs.withColumns({"h": F.crc32(F.col("conv_id").cast("string").cast("binary")) % most, "base": F.col("conv_id") - F.col("conv_id") % family})
    first = convs.where("conv_id = base").select("base", F.col("n").alias("n_base"))
    convs = stored(convs.join(first, "base", "left").withColumn("taken", F.least("h", F.coalesce("n_base", F.lit(0)))).drop("n_base"), "conversations")
    own = turns.join(convs.select("conv_id", "h", "taken"), "conv_id").where("i >= h").select("conv_id", (F.col("taken") + F.col("i") - F.col("h")).alias("i"), "digest", "bytes")
    head = turns.where((F.col("i") < most - 1) & (F.col("conv_id") % family == 0)).withColumnRenamed("conv_id", "base")
    lent = head.join(convs.where("taken > 0").select("conv_id", "base", "taken"), "base").where("i < taken").select("conv_id", "i", "digest", "bytes")
    return own.unionByName(lent), convs.select("conv_id", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n"))


def _hash(salt: int, digests: Column) -> Column:
    """64 bits of a block's number and the digests of its turns; two salts make up a key."""
    return F.xxhash64(F.lit(salt), F.col("k"), digests)


def blocks_of(turns: DataFrame) -> DataFrame:
    """(conv_id, k, turns, p1, p2, f1, f2, last): the k-th block's turns, the key of all blocks before it and its own; ``last`` ends the conversation."""
    rows = turns.groupBy("conv_id", F.expr(f"i div {BLOCK}").alias("k")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "digest", "bytes"))), lambda t: F.struct(t["digest"].alias("digest"), t["bytes"].alias("bytes"))).alias("turns"))
    rows = rows.withColumns({f"f{s}": _hash(s, F.col("turns.digest")) for s in (1, 2)})
    w = Window.partitionBy("conv_id").orderBy("k")
    before = {f"p{s}": F.coalesce(F.bit_xor(f"f{s}").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long")) for s in (1, 2)}
    return rows.withColumns(before | {"last": F.lead("k").over(w).isNull()})


def _turn_nodes(groups: DataFrame) -> DataFrame:
    """A row for each turn of each group of equal blocks: its own key, its parent's, and those of the nodes from the block's first turn to itself."""
    key = lambda j: F.struct(*[F.col(f"p{s}").bitwiseXOR(_hash(s, F.slice("turns.digest", F.lit(1), j))).alias(n) for s, n in ((1, "a"), (2, "b"))])
    rows = groups.withColumn("keys", F.transform(F.sequence(F.lit(1), F.size("turns")), key)).withColumn("j", F.explode(F.sequence(F.lit(1), F.size("turns"))))
    at, parent = F.col("keys")[F.col("j") - 1], F.when(F.col("j") > 1, F.get("keys", F.col("j") - 2)).otherwise(F.struct(F.col("p1").alias("a"), F.col("p2").alias("b")))
    return rows.select((F.col("k") * BLOCK + F.col("j")).alias("depth"), at["a"].alias("a"), at["b"].alias("b"), parent["a"].alias("pa"), parent["b"].alias("pb"), "n_convs", "conv_id",
                       F.get("turns", F.col("j") - 1)["bytes"].alias("bytes"), F.slice("keys", F.lit(1), F.col("j")).alias("up"), "k", "p1", "p2")


def trie_nodes(blocks: DataFrame) -> DataFrame:
    """The nodes below the root: conversations meet by whole blocks, then distinct blocks by turns where several follow the same block."""
    groups = stored(blocks.groupBy("k", "p1", "p2", "f1", "f2").agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.first("turns").alias("turns")).drop("f1", "f2"), "block_groups")
    deep = groups.where("k > 0")
    follow = deep.groupBy("k", "p1", "p2").agg(F.count("*").alias("c"), *[F.first(x).alias(x) for x in ("n_convs", "conv_id", "turns")])
    lone = follow.where("c = 1").drop("c")
    parting = groups.where("k = 0").unionByName(deep.join(follow.where("c > 1").select("k", "p1", "p2"), ["k", "p1", "p2"], "left_semi"))
    refined = _turn_nodes(parting)
    refined = refined.groupBy(KEY).agg(F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id"), *[F.first(c).alias(c) for c in refined.columns if c not in (*KEY, "n_convs", "conv_id")])
    return refined.unionByName(_turn_nodes(lone))


def _below(nodes: DataFrame) -> DataFrame:
    """(key, saved, leaves) of every end of a block (and the root) that has nodes below it: sums over all of them."""
    x = nodes.groupBy((F.col("k") * BLOCK).alias("depth"), F.col("p1").alias("a"), F.col("p2").alias("b")).agg(F.sum("saved").alias("saved"), F.sum("leaf").alias("leaves"))
    ends = nodes.where(F.col("depth") % BLOCK == 0).select(*KEY, (F.col("k") * BLOCK).alias("u_depth"), F.col("p1").alias("u_a"), F.col("p2").alias("u_b"))
    x = x.join(ends, KEY, "left")
    levels, step = (nodes.agg(F.max("k")).first()[0] or 0) + 1, 1
    while step < levels:
        # each row holds the sum over fewer than ``step`` blocks below it, and its ancestor ``step`` blocks up
        x = stored(x, "block_sums")
        up = x.where("u_depth is not null").groupBy("u_depth", "u_a", "u_b").agg(F.sum("saved").alias("more"), F.sum("leaves").alias("more_leaves")).toDF(*KEY, "more", "more_leaves")
        far = x.where(F.col("depth") >= 2 * step * BLOCK).select(*KEY, F.col("u_depth"), F.col("u_a"), F.col("u_b"))
        to = x.select(*[F.col(c).alias(f"u_{c}") for c in KEY], *[F.col(f"u_{c}").alias(f"v_{c}") for c in KEY])
        far = far.join(to, [f"u_{c}" for c in KEY]).select(*KEY, *[F.col(f"v_{c}").alias(f"u_{c}") for c in KEY])
        x = x.drop("u_depth", "u_a", "u_b").join(up, KEY, "left").select(*KEY, (F.col("saved") + F.coalesce("more", F.lit(0))).alias("saved"), (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("leaves")).join(far, KEY, "left")
        step *= 2
    return stored(x.select(*KEY, "saved", "leaves"), "block_sums")


def _end_hashes(blocks: DataFrame, convs: DataFrame) -> DataFrame:
    """(key, ends_sha256) of every node where conversations end. Ids are joined in texts of at most ``IDS`` ids or so; the few nodes with several texts hash them one after the other."""
    zero = [F.lit(0).cast("long").alias(c) for c in KEY]
    ends = blocks.where("last").select("conv_id", (F.col("k") * BLOCK + F.size("turns")).alias("depth"), F.col("p1").bitwiseXOR(F.col("f1")).alias("a"), F.col("p2").bitwiseXOR(F.col("f2")).alias("b"))
    ends = ends.unionByName(convs.where("n = 0").select("conv_id", *zero))
    texts = stored(ends.groupBy(*KEY, F.expr(f"conv_id div {IDS}").alias("part")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda i: i.cast("string")), ",").alias("ids")), "end_ids")
    count = texts.groupBy(KEY).agg(F.count("*").alias("c"), F.first("ids").alias("ids"))
    once = count.where("c = 1").select(*KEY, F.sha2("ids", 256).alias("ends_sha256"))
    many = texts.join(count.where("c > 1").select(KEY), KEY, "left_semi").select(*KEY, "part", "ids")

    @tidy
    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, done = None, None, []
        for batch in batches:
            for *key, ids in zip(*(batch.column(c).to_pylist() for c in (*KEY, "ids")), strict=True):
                if key != now:
                    if now:
                        done.append((*now, state.hexdigest()))
                    now, state = key, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.encode())
        if now:
            done.append((*now, state.hexdigest()))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], names=[*KEY, "ends_sha256"])

    many = many.repartition(*KEY).sortWithinPartitions(*KEY, "part").mapInArrow(joined, once.schema)
    return once.unionByName(many)


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """The trie of turns (conv_id, i from 0 without gaps, digest, bytes) and all conversations (conv_id, n): a row for each node as the contract of ``op12`` has them."""
    blocks = stored(blocks_of(turns), "blocks")
    nodes = stored(trie_nodes(blocks), "nodes")
    children = nodes.groupBy((F.col("depth") - 1).alias("depth"), F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, KEY, "left").withColumns({"n_children": F.coalesce("n_children", F.lit(0).cast("long")), "saved": (F.col("n_convs") - 1) * F.col("bytes")})
    nodes = stored(nodes.withColumn("leaf", (F.col("n_children") == 0).cast("long")), "nodes")
    below = _below(nodes)
    # within a block a node adds itself, and all below it if it ends the block, to the nodes from the block's first turn on
    own = nodes.select("k", "up", "saved", F.col("leaf").alias("leaves"))
    whole = nodes.where(F.col("depth") % BLOCK == 0).select(*KEY, "k", "up").join(below, KEY).select("k", "up", "saved", "leaves")
    sums = own.unionByName(whole).select("k", F.posexplode("up").alias("j", "at"), "saved", "leaves")
    sums = sums.groupBy((F.col("k") * BLOCK + F.col("j") + 1).alias("depth"), F.col("at.a").alias("a"), F.col("at.b").alias("b")).agg(F.sum("saved").alias("saved_tokens"), F.sum("leaves").alias("n_leaves"))
    # the root holds every conversation; it alone may have no turn below it
    top = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    zero = [F.lit(0).cast("long").alias(c) for c in KEY]
    root = top.select(*zero, "conv_id", "n_convs").join(children, KEY, "left").join(below, KEY, "left")
    root = root.select(*KEY, "conv_id", F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), F.coalesce("leaves", F.lit(1)).alias("n_leaves"), F.coalesce("saved", F.lit(0)).alias("saved_tokens"))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("parent_conv_id"))
    deep = nodes.where("depth > 1").join(parents, ["depth", "pa", "pb"])
    first = nodes.where("depth = 1").crossJoin(F.broadcast(top.select(F.col("conv_id").alias("parent_conv_id"))))  # one row
    rest = deep.unionByName(first).select(*KEY, "conv_id", "parent_conv_id", "n_convs", "n_children").join(sums, KEY)
    out = rest.unionByName(root).join(_end_hashes(blocks, convs), KEY, "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of conversations as they are."""
    turns, convs = numbered(stored(turn_digests(conversations), "turns"))
    return prefix_trie(turns, convs)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns, convs = numbered(stored(turn_digests(spark.read.parquet(f"{sf_dir}/conversations.parquet")), "turns"))
    return prefix_trie(*spliced(turns, convs))
