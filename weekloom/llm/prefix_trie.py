"""Conversation prefix trie by the Euler-tour technique.

A node is a sequence of first turns. Conversations that begin alike share its fingerprint: the sums, up to the
turn, of four 32-bit lanes of a digest of place, role and text, which add up in chunks. A node's name is
(smallest member, depth). Siblings are numbered by their smallest member, so the arcs of the tour follow from the
numbers: enter arc 2 i leads to the first child or to exit arc 2 i + 1, an exit arc to the next sibling or to the
parent's exit. The list of arcs is ranked distributedly (``ranking.list_rank``); leaves and savings below a node
are differences of running sums between its two arcs.

Turns are ordered by number (null first), then role, then text; rows that repeat are turns of their own. Rows
without a conversation id belong to none and are left out. A null role or text is empty. An empty table gives
no node. Further columns are not read. Texts are read and sorted once and never travel again.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekloom.llm.common import release_memory, stored
from weekloom.llm.ranking import list_rank, numbered, ranked, running_sums

LANES = ["_l1", "_l2", "_l3", "_l4"]
#: Characters of a text that decide which range of the sort it goes to.
RANGE_CHARS = 64
#: Member ids that stand in one row while they are hashed in order.
ID_BLOCK = 8192


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn_no from 1, n_turns, content, n_chars): every turn at its place, the text as a digest."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    rows = conversations.where(F.col("conv_id").isNotNull()).select("conv_id", "turn", role.alias("role"), text.alias("text"))
    rows = rows.withColumn("_start", F.substring("text", 1, RANGE_CHARS))
    order = [F.asc_nulls_first("turn"), F.col("role"), F.col("text")]
    coarse = [F.asc_nulls_first("turn"), F.col("role"), F.col("_start")]
    # The digest goes on with the sorted rows; role and text stay behind in the sort.
    content = F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")))
    keep = ["conv_id", content.alias("content"), F.length("text").cast("long").alias("n_chars")]
    return stored(ranked(rows, "conv_id", order, "turns", "turn_no", "n_turns", coarse, keep), "ordered-turns")


def rebuilt_turns(turns: DataFrame, every: int = 100, heads: int = 6) -> tuple[DataFrame, DataFrame]:
    """Every conversation with the first turns of its hundred's first one in place of its own.

    Of conversation ``c - c % every`` the first ``crc32(c) % heads`` turns come first (all, if it has fewer; none if it
    does not exist), then those of ``c`` behind as many of its own. Returns turns (conv_id, turn_no, content, n_chars) and
    conversations (conv_id, n_turns).
    """
    c = F.col("conv_id")
    sizes = turns.groupBy("conv_id").agg(F.max("n_turns").alias("own"))
    wanted = sizes.select("conv_id", "own", (c - c % every).alias("base"), (F.crc32(c.cast("string")) % heads).alias("h"))
    bases = sizes.where(c % every == 0).select(F.col("conv_id").alias("base"), F.col("own").alias("base_turns"))
    plan = wanted.join(bases, "base", "left").withColumn("taken", F.least("h", F.coalesce("base_turns", F.lit(0).cast("long"))))
    plan = stored(plan.withColumn("n_turns", F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))), "rebuilt")
    first = turns.where((c % every == 0) & (F.col("turn_no") < heads)).select(F.col("conv_id").alias("base"), "turn_no", "content", "n_chars")
    lent = plan.where("taken > 0").select("conv_id", "base", F.explode(F.sequence(F.lit(1).cast("long"), F.col("taken"))).alias("turn_no"))
    lent = lent.join(first, ["base", "turn_no"]).select("conv_id", "turn_no", "content", "n_chars")
    own = turns.join(plan.select("conv_id", "h", "taken"), "conv_id").where("turn_no > h")
    own = own.select("conv_id", (F.col("turn_no") - F.col("h") + F.col("taken")).alias("turn_no"), "content", "n_chars")
    return stored(lent.unionByName(own), "rebuilt-turns"), plan.select("conv_id", "n_turns")


def _print(depth, lanes: list) -> object:
    return F.unhex(F.md5(F.concat_ws(":", depth.cast("string"), *[x.cast("string") for x in lanes])))


def _paths(turns: DataFrame, sizes: DataFrame) -> DataFrame:
    """A row for each conversation and depth, 0 included: fingerprint of the turns so far and of those before the last."""
    place = F.md5(F.concat(F.col("turn_no").cast("string"), F.lit(":"), F.hex("content")))
    lanes = [F.conv(F.substring(place, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]
    own = [f"{n}_own" for n in LANES]
    rows = turns.select("conv_id", "turn_no", "n_chars", *[x.alias(n) for x, n in zip(lanes, own, strict=True)])
    rows = rows.select("*", *[F.col(o).alias(n) for o, n in zip(own, LANES, strict=True)])
    # Places begin at 1; chunks need no gap, not a start at 0.
    sums = running_sums(rows, ["conv_id"], "turn_no", LANES)
    key = _print(F.col("turn_no"), [F.col(n) for n in LANES])
    before = _print(F.col("turn_no") - 1, [F.col(n) - F.col(o) for n, o in zip(LANES, own, strict=True)])
    none = F.lit(0).cast("long")
    steps = sums.select("conv_id", F.col("turn_no").cast("long").alias("depth"), "n_chars", key.alias("key"), before.alias("parent"))
    roots = sizes.select(
        "conv_id", none.alias("depth"), none.alias("n_chars"), _print(none, [none] * 4).alias("key"), F.lit(None).cast("binary").alias("parent")
    )
    return steps.unionByName(roots)


def _digests(batches):
    """For mapInArrow over id blocks sorted by (key, block): SHA-256 of each key's comma-joined ids, block by block."""
    key, digest = None, None
    for batch in batches:
        out = []
        for k, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if k == key:
                digest.update(b"," + text.encode())
                continue
            if digest:
                out.append((key, digest.hexdigest()))
            key, digest = k, hashlib.sha256(text.encode())
        if out:
            yield pa.record_batch([pa.array([o[0] for o in out], pa.binary()), pa.array([o[1] for o in out])], ["key", "ends_sha256"])
    if digest:
        yield pa.record_batch([pa.array([key], pa.binary()), pa.array([digest.hexdigest()])], ["key", "ends_sha256"])
    release_memory()


def end_blocks(paths: DataFrame, sizes: DataFrame) -> DataFrame:
    """(key, block, ids): conversations that end at each node, ids ascending, ``ID_BLOCK`` to a row."""
    ends = paths.join(sizes.select("conv_id", F.col("n_turns").alias("depth")), ["conv_id", "depth"]).select("key", "conv_id")
    placed = ranked(ends, "key", [F.col("conv_id")], "ends", "_place", "_members")
    block = F.floor((F.col("_place") - 1) / ID_BLOCK).alias("block")
    return placed.groupBy("key", block).agg(F.array_sort(F.collect_list("conv_id")).alias("ids"))


def trie(turns: DataFrame, sizes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and the ids that end at them, from turns (conv_id, turn_no, content, n_chars) and conversations (conv_id, n_turns).

    Nodes: key, conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens. Ends: key,
    block, ids.
    """
    paths = stored(_paths(turns, sizes), "paths")
    nodes = paths.groupBy("key").agg(
        F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.min("parent").alias("parent"),
        F.count(F.lit(1)).alias("n_convs"), F.max("n_chars").alias("n_chars"),
    )
    nodes = numbered(nodes, [F.asc_nulls_first("parent"), F.col("conv_id")], "nodes", "i")
    nodes = stored(nodes, "numbered-nodes")
    # Children of one node have neighbouring numbers.
    families = nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("key")).agg(
        F.min("i").alias("first"), F.max("i").alias("last"), F.count(F.lit(1)).alias("n_children")
    )
    nodes = nodes.join(families, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    nodes = stored(nodes, "families")
    enter = nodes.select((2 * F.col("i")).alias("arc"), F.coalesce(2 * F.col("first"), 2 * F.col("i") + 1).alias("to"))
    closing = nodes.where("last IS NOT NULL").select(F.col("last").alias("i"), (2 * F.col("i") + 1).alias("up"))
    end = F.when(F.col("parent").isNull(), -1).otherwise(2 * F.col("i") + 2)
    leave = nodes.select("i", "parent").join(closing, "i", "left").select((2 * F.col("i") + 1).alias("arc"), F.coalesce("up", end).alias("to"))
    arcs = stored(enter.unionByName(leave).withColumn("dist", F.lit(1).cast("long")), "arcs")
    places = list_rank(arcs).select(F.floor(F.col("arc") / 2).alias("i"), (F.col("arc") % 2).alias("side"), "position")
    gain = (F.col("n_convs") - 1) * F.col("n_chars")
    weights = nodes.select("i", (F.col("n_children") == 0).cast("long").alias("leaves"), gain.alias("saved"))
    tour = places.join(weights, "i")
    entering = F.col("side") == 0
    tour = tour.select("i", "side", "position", *[F.when(entering, F.col(c)).otherwise(0).alias(c) for c in ("leaves", "saved")])
    own = stored(tour.select("*", F.col("leaves").alias("own_leaves"), F.col("saved").alias("own_saved")), "tour")
    sums = running_sums(own, [], "position", ["leaves", "saved"])
    # From before the enter arc up to the exit arc.
    part = lambda c: F.sum(F.when(entering, F.col(f"own_{c}") - F.col(c)).otherwise(F.col(c)))
    below = sums.groupBy("i").agg(part("leaves").alias("n_leaves"), part("saved").alias("saved_tokens"))
    named = nodes.join(below, "i").join(_parent_names(nodes), "i", "left")
    columns = ["key", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    return named.select(*columns), end_blocks(paths, sizes)


def _parent_names(nodes: DataFrame) -> DataFrame:
    """(i, parent_conv_id): each parent hands its name to the run of its children's numbers, a block of them at a time."""
    runs = nodes.where("first IS NOT NULL").select("first", "last", F.col("conv_id").alias("parent_conv_id"))
    blocks = runs.select("*", F.explode(F.expr(f"sequence(first, last, {ID_BLOCK}L)")).alias("lo"))
    return blocks.select("parent_conv_id", F.explode(F.expr(f"sequence(lo, least(lo + {ID_BLOCK - 1}, last))")).alias("i"))


def prefix_trie(conversations: DataFrame, every: int = 100, heads: int = 6) -> DataFrame:
    """One row per node of the trie of the rebuilt conversations, with the SHA-256 of the ids that end at it."""
    turns, sizes = rebuilt_turns(ordered_turns(conversations), every, heads)
    nodes, ends = trie(turns, sizes)
    ids = ends.select("key", "block", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))
    sums = ids.repartition("key").sortWithinPartitions("key", "block").mapInArrow(_digests, "key binary, ends_sha256 string")
    empty = hashlib.sha256(b"").hexdigest()
    return nodes.join(sums, "key", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(empty))).drop("key")
