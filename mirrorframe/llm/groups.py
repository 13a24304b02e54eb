"""Jaccard join of word n-gram sets over a token-group matrix.

1. Every text becomes its set of shingles; texts with equal sets are one node.
2. A node publishes the first tokens of its set in the order of their hashes: as many as a
   partner may lack, and some more.  Two linked nodes have at least that surplus of
   published tokens in common, so a node that shares fewer with all others together is done.
   A passage or a line that many texts have doesn't keep them here.
3. The other nodes are partitioned into groups of similar ones: those that share their
   most common published token and have about one size.  A group is stored as one block, the
   sets of its members.  The token-group matrix names the groups that publish a token.
4. A query is a node with a group in whose column of the matrix it has a token.  The
   number of its tokens in the union of the group's sets bounds what it can have in common with
   any member.  Only groups whose bound reaches what a link needs are opened, and the
   query is compared with their members on the full sets.
5. Every group is a query to itself, first.  Then every node asks one group, that of the
   smallest name for most of its tokens, which joins families of copies along a star.
   Last come the nodes of which enough tokens stand in a node of another component: for
   the rarest published tokens of each, of which a partner has one, those outside the
   largest component of a token ask all its groups; so every pair of nodes that may be
   linked and isn't in one component by then has been looked at.

No pair is lost: published tokens and bounds leave out nothing that reaches the threshold.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mirrorframe.llm.components import components
from mirrorframe.llm.frames import broadcast_if_small, named, release_memory, text_blocks, written
from mirrorframe.llm.near import Shingles
from mirrorframe.llm.phrases import Proposal
from mirrorframe.llm.texts import U64

SHINGLE, PERCENT = 3, 90
#: A set publishes one token for so many of its own beyond those that a partner may lack.
SURPLUS = 20
#: Bits of the filter that keeps tokens of one node from being sent to the others: 4 MB in a task.
BITS = 1 << 25
#: Rounds of leaving out nodes that share too few tokens with those still there.
ROUNDS = 2
#: Members and tokens of a group; one set of more tokens is a group of its own.
MEMBERS, TOKENS = 64, 1 << 17
#: Ratio of the largest to the smallest set of a group.
SIZE_STEP = 1.05
#: Queries that a group's block answers in one place; it is copied for more.
QUERIES = 4096


def needed(n, m, percent: int = PERCENT):
    """Least number of common tokens with which sets of ``n`` and ``m`` are linked."""
    return -(-percent * (n + m) // (100 + percent))


def smallest_partner(n, percent: int = PERCENT):
    return -(-percent * n // 100)


def surplus(n: int) -> int:
    return max(1, n // SURPLUS)


def published(n: int, percent: int = PERCENT) -> int:
    """How many tokens a set of ``n`` publishes."""
    return min(n, n - needed(n, smallest_partner(n, percent), percent) + surplus(n))


def least_shared(n: int, percent: int = PERCENT) -> int:
    """How many published tokens a set of ``n`` has in common with any set it is linked with, at least."""
    return surplus(smallest_partner(n, percent))


def _least_shared(percent: int) -> Column:
    """``least_shared`` of a column ``n``."""
    return F.expr(f"greatest(1, (({percent} * n + 99) div 100) div {SURPLUS})")


def _node(values: np.ndarray) -> bytes:
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()


def shingle_sets(docs: DataFrame, key_type: T.DataType, size: int, percent: int) -> DataFrame:
    """(key, n, node, alias, tokens) of every row of (key, text); the last three are null without words.

    ``node`` is 128 bits of the set's digest, ``alias`` half of them, ``tokens`` those published.
    """
    schema = T.StructType([
        T.StructField("key", key_type), T.StructField("n", T.LongType()), T.StructField("node", T.BinaryType()), T.StructField("alias", T.LongType()),
        T.StructField("tokens", T.ArrayType(T.LongType())),
    ])

    def run(batches):
        for batch in batches:
            for block in text_blocks(batch, "text"):
                sets = list(Shingles(block.column("text"), size).sets())
                nodes = [_node(s) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([
                    block.column("key"), pa.array([len(s) for s in sets], pa.int64()), pa.array(nodes, pa.binary()),
                    pa.array([None if x is None else int.from_bytes(x[:8], "little", signed=True) for x in nodes], pa.int64()),
                    pa.array([s[: published(len(s), percent)].view(np.int64) if len(s) else None for s in sets], pa.list_(pa.int64())),
                ], names=schema.names)
        release_memory()

    return docs.mapInArrow(run, schema)


def _maybe_shared(filled: DataFrame, counts: DataFrame) -> DataFrame:
    """(alias, token) of the published tokens, without most of those that aren't in ``counts``: what ``BITS`` bits can tell apart stays at home."""
    bits = Proposal(BITS)
    bits.add(counts.select(F.col("token").alias("a")))

    def run(batches):
        for batch in batches:
            tokens = batch.column("tokens")
            flat = tokens.flatten().to_numpy(zero_copy_only=False)
            held = np.flatnonzero(bits.holds(flat.view(U64)))
            owner = np.repeat(np.arange(len(tokens)), tokens.value_lengths().to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([batch.column("alias").take(pa.array(owner[held])), pa.array(flat[held])], names=["alias", "token"])

    return filled.mapInArrow(run, "alias LONG, token LONG")


def shared_tokens(features: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """(token, alias, n, df) of the published tokens that several nodes have, for nodes that share enough of them.

    Halves of names stand for nodes: where two nodes have one half, both stay and have the tokens of both.
    """
    sizes = nodes.groupBy("alias").agg(F.min("n").alias("n"))
    filled = features.filter("node is not null").select("alias", "tokens")
    rows = filled.select("alias", F.explode("tokens").alias("token"))
    for k in range(ROUNDS):
        # copies count in df, which only orders tokens, but don't make a token shared
        counts = rows.groupBy("token").agg(F.count("*").alias("df"), F.min("alias").alias("_a"), F.max("alias").alias("_b")).filter("_a <> _b").select("token", "df")
        if k == 0:
            counts = written(counts, "token-counts")
            rows = _maybe_shared(filled, counts)
        found = written(rows.join(counts, "token").dropDuplicates(["token", "alias"]).select("token", "alias", "df"), "shared-tokens")
        enough = found.groupBy("alias").count().join(sizes, "alias").filter(F.col("count") >= _least_shared(percent)).select("alias", "n")
        enough = broadcast_if_small(written(enough, "sharing"))
        rows = found.select("alias", "token").join(enough.select("alias"), "alias", "left_semi")
    return written(found.join(enough, "alias"), "shared-tokens")


def full_sets(docs: DataFrame, live: DataFrame, size: int) -> DataFrame:
    """(node, g, tokens) for the nodes of ``live`` (node, g, key): the texts of their keys are read again."""

    def run(batches):
        for batch in batches:
            for block in text_blocks(batch, "text"):
                sets = list(Shingles(block.column("text"), size).sets())
                yield pa.RecordBatch.from_arrays([pa.array([_node(s) if len(s) else None for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "tokens"])
        release_memory()

    keys = broadcast_if_small(written(live.select(F.col("key").alias("_key")).distinct(), "live-keys"))
    texts = docs.join(keys, F.col("key").eqNullSafe(F.col("_key")), "left_semi").select("text")
    return texts.mapInArrow(run, "node BINARY, tokens BINARY").join(broadcast_if_small(live.select("node", "g")), "node")


# -- groups ------------------------------------------------------------------------------


def assign_groups(shared: DataFrame) -> DataFrame:
    """(alias, family, g) from the shared tokens (token, alias, n, df): nodes of one most common token and about one size.

    These are a family; one with more members or tokens than a group holds is cut into groups by a hash of the node.
    """
    top = shared.groupBy("alias").agg(F.max(F.struct("df", "token"))["token"].alias("token"), F.first("n").alias("n"))
    top = top.withColumn("step", F.floor(F.log(F.col("n").cast("double")) / math.log(SIZE_STEP)))
    sizes = top.groupBy("token", "step").agg(F.greatest(F.ceil(F.count("*") / MEMBERS), F.ceil(F.sum("n") / TOKENS)).alias("parts")).filter("parts > 1")
    dealt = top.join(sizes, ["token", "step"], "left")
    part = F.pmod(F.xxhash64("alias"), F.coalesce("parts", F.lit(1)))
    return dealt.select("alias", F.xxhash64("token", "step").alias("family"), F.xxhash64("token", "step", part).alias("g"))


class Block:
    """The sets of a group's members."""

    def __init__(self, nodes: list[bytes], sets: list[np.ndarray]):
        self.nodes, self.sizes = nodes, np.array([len(s) for s in sets], np.int64)
        self.tokens = np.concatenate(sets)
        self.owner = np.repeat(np.arange(len(sets)), self.sizes)

    def common(self, query: np.ndarray, among: np.ndarray | None = None) -> np.ndarray:
        """How many tokens of a sorted query each member has; zero for those not ``among``."""
        tokens, owner = self.tokens, self.owner
        if among is not None:
            inside = among[owner]
            tokens, owner = tokens[inside], owner[inside]
        at = np.minimum(np.searchsorted(query, tokens), len(query) - 1)
        return np.bincount(owner[query[at] == tokens], minlength=len(self.sizes))

    def linked(self, query: np.ndarray, percent: int, among: np.ndarray | None = None) -> np.ndarray:
        """The members that a query is linked with."""
        c = self.common(query, among)
        return np.flatnonzero((c > 0) & (100 * c >= percent * (len(query) + self.sizes - c)))

    def components(self, percent: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
        """The first member of each member's component within the group, and the links found; members of one component aren't compared."""
        label, links = np.arange(len(self.nodes)), []
        first = np.concatenate([[0], np.cumsum(self.sizes)])
        for k in range(len(self.nodes) - 1):
            among = label != label[k]
            among[:k] = False
            among &= (100 * np.minimum(self.sizes, self.sizes[k]) >= percent * np.maximum(self.sizes, self.sizes[k]))
            if among.any():
                for j in self.linked(self.tokens[first[k] : first[k + 1]], percent, among).tolist():
                    if label[j] != label[k]:
                        a, b = sorted((label[k], label[j]))
                        label[label == b] = a
                        links.append((k, j))
        return label, links


BLOCK = "g LONG, nodes ARRAY<BINARY>, labels ARRAY<INT>, sizes ARRAY<LONG>, tokens BINARY, links ARRAY<STRUCT<u: BINARY, v: BINARY>>"


def group_blocks(sets: DataFrame, percent: int) -> DataFrame:
    """One row for each group: its members' sets and the links among them; a node that comes several times counts once."""

    def block(g: int, members: list) -> pa.RecordBatch:
        own = Block([m[0] for m in members], [np.frombuffer(m[1], U64) for m in members])
        label, links = own.components(percent)
        row = {
            "g": g, "nodes": own.nodes, "labels": label.tolist(), "sizes": own.sizes.tolist(), "tokens": own.tokens.tobytes(),
            "links": [{"u": own.nodes[a], "v": own.nodes[b]} for a, b in links],
        }
        return pa.RecordBatch.from_pylist([row], schema=arrow)

    arrow = pa.schema([
        ("g", pa.int64()), ("nodes", pa.list_(pa.binary())), ("labels", pa.list_(pa.int32())), ("sizes", pa.list_(pa.int64())), ("tokens", pa.binary()),
        ("links", pa.list_(pa.struct([("u", pa.binary()), ("v", pa.binary())]))),
    ])

    def run(batches):
        at, members = None, []
        for batch in batches:
            for g, node, tokens in zip(*(batch.column(c).to_pylist() for c in ("g", "node", "tokens")), strict=True):
                if members and g != at:
                    yield block(at, members)
                    members = []
                at = g
                if not members or members[-1][0] != node:
                    members.append((node, tokens))
        if members:
            yield block(at, members)
        release_memory()

    return sets.select("g", "node", "tokens").repartition("g").sortWithinPartitions("g", "node").mapInArrow(run, BLOCK)


# -- queries -----------------------------------------------------------------------------


def qualifies(query: np.ndarray, union: np.ndarray, low: int, percent: int = PERCENT) -> bool:
    """Whether a group may hold a partner: the query's tokens in its union reach what its smallest possible partner there needs."""
    at = np.minimum(np.searchsorted(union, query), len(union) - 1)
    overlap = int((union[at] == query).sum())
    return overlap >= needed(len(query), max(low, smallest_partner(len(query), percent)), percent)


def _members(blocks: DataFrame) -> DataFrame:
    """(node, tokens) of all members of all blocks."""

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                sizes = np.array(batch.column("sizes")[k].as_py())
                sets = np.split(np.frombuffer(batch.column("tokens")[k].as_buffer(), U64), np.cumsum(sizes)[:-1])
                yield pa.RecordBatch.from_arrays([batch.column("nodes")[k].values, pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "tokens"])

    return blocks.select("nodes", "sizes", "tokens").mapInArrow(run, "node BINARY, tokens BINARY")


def ask(pairs: DataFrame, blocks: DataFrame, percent: int) -> DataFrame:
    """The links (u, v) that queries (node, g) find: one for each component of the group's members that they are linked with.

    Queries travel to their group's block, or to one of its copies where there are many.
    """
    asked = pairs.groupBy("g").agg(F.floor(F.count("*") / QUERIES).alias("_more"))
    asked = broadcast_if_small(written(asked, "asked"))
    empty = {"nodes": "array<binary>", "labels": "array<int>", "sizes": "array<bigint>"}
    queries = _members(blocks).join(broadcast_if_small(pairs), "node").join(asked, "g")
    queries = queries.select("g", F.pmod(F.xxhash64("node"), F.col("_more") + 1).alias("copy"), F.lit(1).alias("kind"), "node", "tokens", *[F.lit(None).cast(t).alias(c) for c, t in empty.items()])
    held = blocks.join(asked, "g").select("g", F.explode(F.sequence(F.lit(0).cast("long"), "_more")).alias("copy"), F.lit(0).alias("kind"), F.lit(None).cast("binary").alias("node"), "tokens", *empty)

    def run(batches):
        block = union = low = labels = None
        for batch in batches:
            kinds, nodes, tokens = (batch.column(c) for c in ("kind", "node", "tokens"))
            u, v = [], []
            for k, kind in enumerate(kinds.to_pylist()):
                values = np.frombuffer(tokens[k].as_buffer(), U64)
                if kind == 0:
                    sizes = batch.column("sizes")[k].as_py()
                    block = Block(batch.column("nodes")[k].as_py(), np.split(values, np.cumsum(sizes)[:-1]))
                    labels, low, union = np.array(batch.column("labels")[k].as_py()), min(sizes), np.unique(values)
                elif qualifies(values, union, low, percent):
                    found = block.linked(values, percent)
                    for j in found[np.unique(labels[found], return_index=True)[1]].tolist():
                        u.append(nodes[k].as_py())
                        v.append(block.nodes[j])
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.binary()), pa.array(v, pa.binary())], names=["u", "v"])
        release_memory()

    both = held.select(*queries.columns).unionByName(queries).repartition("g", "copy").sortWithinPartitions("g", "copy", "kind")
    return both.mapInArrow(run, "u BINARY, v BINARY").filter("u <> v")


def _labels(nodes: DataFrame, links: DataFrame) -> DataFrame:
    found = components(links)
    return written(nodes.select("node").join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component")), "labels")


def _top(rows: DataFrame, by: str, value: str, size: str) -> DataFrame:
    """For each ``by`` the ``value`` with the most rows, of equal ones the largest."""
    counts = rows.groupBy(by, value).agg(F.count("*").alias(size))
    return counts.groupBy(by).agg(F.max(F.struct(size, value))[value].alias(f"_{value}"), F.count("*").alias("_several"))


def _mixed(rare: DataFrame) -> DataFrame:
    """The rows (token, node, component, ...) of tokens in several components, with the largest one of the token."""
    tops = _top(rare, "token", "component", "_size").filter("_several > 1").select("token", "_component")
    return rare.join(tops, "token")


def _able(mixed: DataFrame, blocks: DataFrame, percent: int) -> DataFrame:
    """The nodes of ``mixed`` that may still be linked: enough tokens of their whole set stand in a node of another component.

    A link across components needs so many common tokens with the smallest possible
    partner; only nodes of ``mixed`` can be partners.
    """
    low = mixed.groupBy("token").agg(F.min("n").alias("_low"))
    seen = mixed.join(low, "token").groupBy("node").agg(F.first("n").alias("n"), F.first("component").alias("component"), F.min("_low").alias("_low"))
    seen = written(seen, "mixed-nodes")

    def spread(batches, bits=None):
        for batch in batches:
            for k in range(batch.num_rows):
                tokens = np.frombuffer(batch.column("tokens")[k].as_buffer(), np.int64)
                tokens = tokens if bits is None else tokens[bits.holds(tokens.view(U64))]
                at, of = np.full(len(tokens), batch.column("at")[k].as_py(), np.int32), np.full(len(tokens), batch.column("of")[k].as_py(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(tokens), pa.array(at), pa.array(of)], names=["h", "at", "of"])
        release_memory()

    # short names: nodes that share one count as one with the tokens of both, components are told apart by 64 bits
    seen = seen.select("node", "n", "_low", F.hash("node").alias("at"), F.xxhash64("component").alias("of"))
    sets = _members(blocks).join(broadcast_if_small(seen.select("node", "at", "of")), "node").select("tokens", "at", "of")
    several = sets.mapInArrow(spread, "h LONG, at INT, of LONG").groupBy("h").agg(F.min("of").alias("_a"), F.max("of").alias("_b"))
    several = written(several.filter("_a <> _b").select("h"), "mixed-hashes")
    bits = Proposal(BITS)
    bits.add(several.select(F.col("h").alias("a")))
    tokens = sets.mapInArrow(lambda batches: spread(batches, bits), "h LONG, at INT, of LONG").select("h", "at")
    across = tokens.join(several, "h").groupBy("at").agg(F.count("*").alias("across"))
    partner = F.greatest(F.col("_low"), F.expr(f"({percent} * n + 99) div 100"))
    return seen.join(across, "at").filter((100 + percent) * F.col("across") >= percent * (F.col("n") + partner)).select("node")


def link_nodes(features: DataFrame, nodes: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """(node, component) of all nodes (node, alias, n, key) that share enough published tokens with others."""
    shared = shared_tokens(features, nodes, percent)
    live = written(nodes.join(assign_groups(shared), "alias"), "live")
    blocks = written(group_blocks(full_sets(docs, live, size), percent), "blocks")
    inside = blocks.select(F.explode("links").alias("l")).select("l.u", "l.v")

    # the token-group matrix, with the nodes that have the token
    placed = written(shared.select("token", "alias", "df").join(live.select("alias", "node", "n", "family", "g"), "alias").drop("alias"), "placed")
    hubs = placed.groupBy("token").agg(F.min("g").alias("hub"), F.max("g").alias("_g")).filter("hub <> _g").select("token", "hub")
    own = live.select("node", "g")
    first = _top(placed.join(hubs, "token").select("node", "hub"), "node", "hub", "_size").join(own, "node").filter("g <> _hub")
    first = written(first.select("node", F.col("_hub").alias("g")), "asked-first")
    labels = _labels(live, written(inside.unionByName(ask(first, blocks, percent)), "links"))

    # two linked nodes lack so few of each other's published tokens that they share one of the rarest of both;
    # those that no other node has are the rarest of all
    all_shared = F.count("*").over(Window.partitionBy("node"))
    rank = F.row_number().over(Window.partitionBy("node").orderBy("df", "token"))
    rare = placed.withColumns({"_rank": rank, "_all": all_shared}).filter(F.col("_rank") <= F.col("_all") - _least_shared(percent) + 1)
    rare = written(rare.join(labels, "node").select("token", "node", "n", "family", "g", "component"), "rare-tokens")
    mixed = written(_mixed(rare), "mixed-tokens")
    mixed = _mixed(mixed.select(*rare.columns).join(_able(mixed, blocks, percent), "node", "left_semi"))
    # first the families that a token names, each once for a node, then the groups they were cut into
    sizes = (F.min("n").alias("low"), F.max("n").alias("high"))
    fits = (100 * F.col("high") >= percent * F.col("n")) & (100 * F.col("n") >= percent * F.col("low"))
    families = mixed.groupBy("token", "family").agg(*sizes)
    minor = mixed.filter("component <> _component").select("token", "node", "n", F.col("g").alias("_own"))
    asked = minor.join(families, "token").filter(fits).select("node", "n", "_own", "family").distinct()
    groups = live.groupBy("family", "g").agg(*sizes)
    rest = asked.join(groups, "family").filter(fits & (F.col("g") != F.col("_own"))).select("node", "g")
    rest = written(rest.join(first, ["node", "g"], "left_anti"), "asked-last")
    if rest.isEmpty():
        return labels
    links = written(ask(rest, blocks, percent), "links")
    u, v = (labels.select(F.col("node").alias(x), F.col("component").alias(f"_{x}")) for x in "uv")
    merged = components(links.join(u, "u").join(v, "v").select(F.col("_u").alias("u"), F.col("_v").alias("v")))
    merged = merged.select(F.col("node").alias("component"), F.col("component").alias("_to"))
    return written(labels.join(merged, "component", "left").select("node", F.coalesce("_to", "component").alias("component")), "labels")


def jaccard_classes(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The class of every row under links of ``100 * intersection >= percent * union``: (key, n_shingles, component_id).

    Words are ``[^\\\\x20\\\\x09-\\\\x0D]+`` after lower-casing A-Z; a shingle is ``size`` of them, or
    all of a shorter text.  ``component_id`` is the smallest non-null key that links reach.  A text
    without words (null, empty, blank) has an empty set, is linked with nothing and has
    its own key.  Rows of one key are classed one by one; a null key is a key like any
    other, and is a class's name only where no other key is reached.  An empty table gives no rows.
    Other columns are not read.
    """
    rows = docs.select(named(key).alias("key"), named(text).alias("text"))
    found = written(shingle_sets(rows, docs.schema[key].dataType, size, percent), "features")
    nodes = written(found.filter("node is not null").groupBy("node").agg(F.min("key").alias("key"), F.first("n").alias("n"), F.first("alias").alias("alias")), "nodes")
    labels = link_nodes(found, nodes, rows, size, percent)
    lead = nodes.select("node", "key").join(labels, "node").groupBy("component").agg(F.min("key").alias("_lead"))
    leads = labels.join(lead, "component").select("node", "_lead")
    named_ = nodes.select("node", "key").join(leads, "node", "left").select("node", F.coalesce("_lead", "key").alias("_component"))
    out = found.select("key", "n", "node").join(named_, "node", "left")
    return out.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("node").isNull(), F.col("key")).otherwise(F.col("_component")).alias("component_id"))
