"""Trie of conversation prefixes with figures of every subtree, by the Euler tour of the tree.

A node is a distinct sequence of first turns; its members are the conversations that start with it. A prefix is named by its
length and 128 bits: hashes of (place, role, text) of its turns, joined by exclusive or, so that the names of all prefixes are
running totals. Every node gets an enter and an exit arc; each arc points to the next one of the tour, the list of arcs is
ranked (``listrank``), and a subtree's leaves and savings are differences of running totals at its two arcs. No step
goes level by level, so depth does not matter.

Hot spots: turns are dealt in ranges of (conversation, turn), so a conversation may span tasks; prefixes are counted before they
are shuffled; parents and ends are looked up with heavy nodes broadcast (fewer than ``skew.HEAVY``); children of one parent are
ordered in ranges; the ids that end at a node are joined in pieces of 1,024.

Defined results: a null role or text is empty; turns are ordered by the order column, null first, then role and text; repeated
rows are turns of their own; rows without a conversation id take no part; an empty table has no nodes.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memberlens.llm.common import column
from memberlens.llm.listrank import BLOCK, FINISH, ranked
from memberlens.llm.order import earlier, in_ranges, numbered, prefix_sums
from memberlens.llm.skew import HEAVY, lookup
from memberlens.sources.tables import stored

#: Ids joined to one piece of text.
PIECE = 1_024

NO_ENDS = hashlib.sha256(b"").hexdigest()


class Trie(NamedTuple):
    #: node (0 is the root), conv_id, depth, parent, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens
    nodes: DataFrame
    #: node, conv: where each conversation ends
    ends: DataFrame


def turns_of(df: DataFrame, key: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, role, text) without nulls but in ``turn``."""
    filled = [F.coalesce(column(c).cast("string"), F.lit("")).alias(n) for c, n in ((role, "role"), (text, "text"))]
    return df.select(column(key).cast("long").alias("conv"), column(order).alias("turn"), *filled).where("conv is not null")


def positioned(turns: DataFrame) -> DataFrame:
    """Stored turns with their ``position`` in the conversation (from 1), and the range (``part``) they lie in."""
    rows = in_ranges(turns, ["conv", F.asc_nulls_first("turn"), "role", "text"], "turns")
    parts = rows.groupBy("part", "conv").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
    before = earlier(parts.drop("first"), "part", ["n"], ["conv"]).join(parts.drop("n"), ["conv", "part"])
    found = rows.join(before, ["part", "conv"]).withColumn("position", F.col("before_n") + F.col("place") - F.col("first") + 1)
    return stored(found.select("conv", "part", "position", "role", "text"), "positions")


def rebuilt(conversations: DataFrame, shared: int = 6, family: int = 100) -> tuple[DataFrame, DataFrame]:
    """(conv, turn, role, text) of conversations whose first turns are those of their family's first one, and all ids.

    Conversation c takes the first h = crc32(c) % ``shared`` turns of conversation c - c % ``family`` (all if fewer, none
    if absent) and goes on with its own turns after its first h.
    """
    turns = positioned(turns_of(conversations))
    lengths = turns.groupBy("conv").agg(F.count(F.lit(1)).alias("n"))
    convs = lengths.select("conv", (F.col("conv") - F.col("conv") % family).alias("base"), (F.crc32(F.col("conv").cast("string")) % shared).alias("h"))
    based = convs.join(lengths.select(F.col("conv").alias("base"), "n"), "base", "left")
    convs = stored(based.select("conv", "base", "h", F.least("h", F.coalesce("n", F.lit(0))).alias("taken")), "convs")
    heads = turns.where((F.col("conv") % family == 0) & (F.col("position") < shared)).select(F.col("conv").alias("base"), "position", "role", "text")
    from_base = convs.join(heads, "base").where(F.col("position") <= F.col("taken")).select("conv", F.col("position").alias("turn"), "role", "text")
    parts = turns.groupBy("part", "conv").agg(F.lit(1)).select("part", "conv").join(convs, "conv")
    own = turns.join(parts, ["part", "conv"]).where(F.col("position") > F.col("h"))
    own = own.select("conv", (F.col("taken") + F.col("position") - F.col("h")).alias("turn"), "role", "text")
    return from_base.unionByName(own), convs.select("conv")


def prefixes(turns: DataFrame) -> DataFrame:
    """Stored (conv, depth, a, b, parent_a, parent_b, chars, last): the prefix that every turn ends, by name."""
    rows = positioned(turns)
    named = rows.select("conv", "part", "position", F.length("text").alias("chars"), F.xxhash64("position", "role", "text").alias("x"),
                        F.xxhash64(F.lit(1), "position", "role", "text").alias("y"))
    sums = named.groupBy("conv", "part").agg(F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"))
    before = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("conv").orderBy("part").rowsBetween(1, 1)
    offsets = sums.select("conv", "part", *[F.coalesce(F.bit_xor(c).over(before), F.lit(0)).alias(f"before_{c}") for c in "xy"], F.count("x").over(after).alias("later"))
    here = Window.partitionBy("part", "conv").orderBy("position")
    inside = here.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = [F.bit_xor(c).over(inside).bitwiseXOR(F.col(f"before_{c}")).alias(n) for c, n in (("x", "a"), ("y", "b"))]
    final = F.lead("position").over(here).isNull() & (F.col("later") == 0)
    found = named.join(offsets, ["conv", "part"]).select("conv", F.col("position").alias("depth"), "chars", "x", "y", *total, final.alias("last"))
    return stored(found.select("conv", "depth", "a", "b", F.col("a").bitwiseXOR(F.col("x")).alias("parent_a"), F.col("b").bitwiseXOR(F.col("y")).alias("parent_b"), "chars", "last"), "prefixes")


def next_siblings(nodes: DataFrame) -> DataFrame:
    """(node, sibling): the next child of the same parent, null for the last. ``nodes`` has parent and node."""
    rows = in_ranges(nodes.select("parent", "node"), ["parent", "node"], "siblings")
    firsts = rows.groupBy("part").agg(F.min(F.struct("parent", "node")).alias("next_first"))
    following = firsts.select("part", F.lead("next_first").over(Window.orderBy("part")).alias("next_first"))  # a row per range
    step = F.coalesce(F.lead(F.struct("parent", "node")).over(Window.partitionBy("part").orderBy("place")), F.col("next_first"))
    return rows.join(F.broadcast(following), "part").select("parent", "node", step.alias("step")).select("node", F.when(F.col("step.parent") == F.col("parent"), F.col("step.node")).alias("sibling"))


def prefix_trie(turns: DataFrame, convs: DataFrame, heavy: int = HEAVY, block: int = BLOCK, finish: int = FINISH) -> Trie:
    """The trie of ``turns`` (conv, turn, role, text, as ``turns_of`` gives them); ``convs`` has every conv, with turns or not."""
    steps = prefixes(turns)
    groups = steps.groupBy("depth", "a", "b").agg(F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.min("parent_a").alias("parent_a"),
                                                  F.min("parent_b").alias("parent_b"), F.min("chars").alias("chars"))
    named = stored(numbered(groups, ["conv_id", "depth"], "nodes").withColumn("node", F.col("number") + 1).drop("number"), "numbered-nodes")
    members = convs.distinct()
    root = stored(members.agg(F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0"), "root")
    first = root.first()
    top = root.select(F.lit(0).cast("long").alias("node"), "conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent"),
                      F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", F.lit(0).alias("chars"))
    above = named.select((F.col("depth") + 1).alias("depth"), F.col("a").alias("parent_a"), F.col("b").alias("parent_b"), F.col("node").alias("parent"),
                         F.col("conv_id").alias("parent_conv_id"), F.col("n_convs").alias("weight"))
    below = lookup(named.where("depth > 1"), above, ["depth", "parent_a", "parent_b"], "weight", heavy)
    above_all = {"parent": F.lit(0).cast("long"), "parent_conv_id": F.lit(first and first["conv_id"]).cast("long")}
    under_root = named.where("depth = 1").withColumns(above_all)
    tree = stored(below.select(top.columns).unionByName(under_root.select(top.columns)).unionByName(top), "tree")

    children = tree.where("node > 0").groupBy("parent").agg(F.count(F.lit(1)).alias("n_children"), F.min("node").alias("first_child"))
    siblings = next_siblings(tree.where("node > 0"))
    around = tree.join(children.withColumnRenamed("parent", "node"), "node", "left").join(siblings, "node", "left")
    around = stored(around.withColumn("n_children", F.coalesce("n_children", F.lit(0))), "around")
    node, enter_after = F.col("node"), F.coalesce(F.col("first_child") * 2, F.col("node") * 2 + 1)
    exit_after = F.coalesce(F.col("sibling") * 2, F.col("parent") * 2 + 1, F.lit(-1))
    arcs = around.select(F.explode(F.array(F.struct((node * 2).alias("id"), enter_after.alias("next")), F.struct((node * 2 + 1).alias("id"), exit_after.alias("next")))).alias("arc"))
    places = ranked(arcs.select("arc.*"), block, finish)

    own = around.select("node", (F.col("n_children") == 0).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("chars")).cast("long").alias("saved"))
    at_enter = places.where("id % 2 = 0").select("place", F.floor(F.col("id") / 2).alias("node")).join(own, "node")
    at_exit = places.where("id % 2 = 1").select("place", F.floor(F.col("id") / 2).alias("node"), *[F.lit(0).cast("long").alias(c) for c in ("leaves", "saved")])
    sums = prefix_sums(at_enter.unionByName(at_exit), "place", ["leaves", "saved"], block)
    within = [(F.max(f"sum_{c}") - F.min(F.col(f"sum_{c}") - F.col(c))).alias(n) for c, n in (("leaves", "n_leaves"), ("saved", "saved_tokens"))]
    nodes = stored(around.drop("chars", "first_child", "sibling").join(sums.groupBy("node").agg(*within), "node"), "trie")

    final = steps.where("last").select("conv", "depth", "a", "b")
    last = lookup(final, named.select("depth", "a", "b", "node", F.col("n_convs").alias("weight")), ["depth", "a", "b"], "weight", heavy).select("node", "conv")
    turnless = members.join(final.select("conv"), "conv", "left_anti").select(F.lit(0).cast("long").alias("node"), "conv")
    return Trie(nodes, stored(last.unionByName(turnless), "ends"))


def ends_digest(ends: DataFrame, node: str = "node", conv: str = "conv", piece: int = PIECE) -> DataFrame:
    """(node, ends_sha256): digest of the ids that end at each node, ascending, comma-joined.

    Ids are joined in bounded pieces; a task reads a node's pieces in order and holds one batch of them.
    """
    rows = in_ranges(ends.select(node, conv), [node, conv], "ends-in-order").withColumn("piece", F.floor(F.col("place") / F.lit(piece)))
    pieces = rows.groupBy(node, "part", "piece").agg(F.array_join(F.transform(F.sort_array(F.collect_list(conv)), lambda x: x.cast("string")), ",").alias("ids"))

    def run(batches):
        current, state = None, None
        for frame in batches:
            done = []
            for n, ids in zip(frame[node], frame["ids"]):
                if n != current:
                    if state is not None:
                        done.append((current, state.hexdigest()))
                    current, state = n, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.encode())
            yield pd.DataFrame(done, columns=[node, "ends_sha256"])
        if state is not None:
            yield pd.DataFrame([(current, state.hexdigest())], columns=[node, "ends_sha256"])

    return pieces.repartition(node).sortWithinPartitions(node, "part", "piece").select(node, "ids").mapInPandas(run, f"{node} long, ends_sha256 string")


def digest(trie: Trie) -> DataFrame:
    found = trie.nodes.join(ends_digest(trie.ends), "node", "left")
    whole: list[Column] = [F.col(c).cast("long").alias(c) for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")]
    return found.select(*whole, F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"))
