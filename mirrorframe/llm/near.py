"""MinHash near-duplicates: many universal hash minima, bands, verification and components.

1. Every text becomes its set of word shingles; texts with equal sets are one node.
2. Minima of many universal hash functions, in bands: nodes that agree in all
   minima of a band share a bucket.
3. Each bucket's best-connected member is its hub; every member is compared with it:
   first by signature, then on the full sets.  Components of the links follow by
   large-star and small-star.
4. Buckets that still hold several components are gone through again until every
   pair of their members is in one component, compared, or can't be linked.  A node
   can't be linked when too few of its shingles stand in any other node; two nodes
   can't when what each has of their common hub, and outside of it, is too little.

So a group of copies costs about one comparison for each member and bucket, and
never one for each pair.  Bands miss a pair at the threshold itself with a chance
of (1 - 0.75**4)**32, about 5 in a million, and less above it.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from mirrorframe.llm.components import components
from mirrorframe.llm.frames import append_columns, broadcast_if_small, named, release_memory, set_aside, text_blocks, written
from mirrorframe.llm.texts import SPACED_LOWER, U64, WORD_POWERS, Words, mix, spans_hash

SHINGLE = 5
#: A pair is linked when 100 * intersection >= PERCENT * union.
PERCENT = 75
BANDS, BAND_ROWS, SEED = 32, 4, 1
#: A pair is not looked at further when so many deviations fewer minima agree than the threshold gives.
DEVIATIONS = 5.7
#: Members of a bucket that one later round compares with all others of other components.
HUBS = 512


class Shingles:
    """The shingles of a block of texts: ``hashes``, those of row i at ``first[i]:first[i + 1]``."""

    def __init__(self, column: pa.Array, size: int = SHINGLE):
        words = Words(column, SPACED_LOWER)
        counts = words.counts
        own = np.minimum(counts, size)[words.rows()]
        at = np.flatnonzero(words.left() >= own)
        self.hashes = spans_hash(words.hashes, at, at + own[at], WORD_POWERS)
        self.first = np.concatenate([[0], np.cumsum(np.where(counts > 0, np.maximum(counts - size + 1, 1), 0))])

    def sets(self):
        """The sorted distinct shingles of each row."""
        for a, b in zip(self.first[:-1].tolist(), self.first[1:].tolist(), strict=True):
            yield np.unique(self.hashes[a:b])


class MinHash:
    """Minima of ``bands * rows`` multiply-shift hash functions."""

    def __init__(self, bands: int = BANDS, rows: int = BAND_ROWS, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        self.a = rng.integers(0, 2**63, bands * rows, dtype=np.uint64) * U64(2) + U64(1)
        self.b = rng.integers(0, 2**63, bands * rows, dtype=np.uint64)

    def minima(self, shingles: Shingles) -> np.ndarray:
        """One row of minima for each text; zeros for texts without words."""
        filled = np.flatnonzero(np.diff(shingles.first))
        out = np.zeros((len(shingles.first) - 1, len(self.a)), np.uint64)
        if len(filled):
            starts = shingles.first[filled]
            for k, (a, b) in enumerate(zip(self.a, self.b, strict=True)):
                out[filled, k] = np.minimum.reduceat((shingles.hashes * a + b) >> U64(32), starts)
        return out

    def buckets(self, minima: np.ndarray) -> np.ndarray:
        """One 64-bit bucket for each text and band."""
        out = np.zeros((len(minima), self.bands), U64)
        for band in range(self.bands):
            h = np.full(len(minima), band + 1, U64)
            for k in range(band * self.rows, (band + 1) * self.rows):
                h = mix(h * U64(0x9E3779B97F4A7C15) + minima[:, k])
            out[:, band] = h
        return out


def least_agreeing(minima: int) -> int:
    """Agreeing minima below which a pair is not looked at further: 68 of 128."""
    p = PERCENT / 100
    return max(0, int(minima * p - DEVIATIONS * (minima * p * (1 - p)) ** 0.5))


def _node(values: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(values.tobytes(), digest_size=8).digest(), "little", signed=True)


def features(docs: DataFrame, key: str, text: str, hashes: MinHash) -> DataFrame:
    """(key, n_shingles, node, buckets, signature) of every row; the last three are null without words.

    ``node`` names the shingle set: 64 bits of its digest.
    """
    schema = T.StructType([
        T.StructField("key", docs.schema[key].dataType), T.StructField("n_shingles", T.LongType()), T.StructField("node", T.LongType()),
        T.StructField("buckets", T.ArrayType(T.LongType())), T.StructField("signature", T.BinaryType()),
    ])

    def run(batches):
        for batch in batches:
            for block in text_blocks(batch, "text"):
                shingles = Shingles(block.column("text"))
                minima = hashes.minima(shingles)
                buckets, signature = hashes.buckets(minima).view(np.int64), minima.astype(np.uint16)
                sizes, nodes = [], []
                for values in shingles.sets():
                    sizes.append(len(values))
                    nodes.append(_node(values) if len(values) else None)
                filled = [n > 0 for n in sizes]
                yield pa.RecordBatch.from_arrays([
                    block.column("key"), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()),
                    pa.array([b if ok else None for b, ok in zip(buckets, filled, strict=True)], pa.list_(pa.int64())),
                    pa.array([s.tobytes() if ok else None for s, ok in zip(signature, filled, strict=True)], pa.binary()),
                ], names=[f.name for f in schema.fields])
        release_memory()

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, schema)


def full_sets(docs: DataFrame, key: str, text: str, crowded: DataFrame) -> DataFrame:
    """(node, shingles) for the nodes of ``crowded`` (node, key): the texts of these keys are read again, a null key like any other.

    Nodes that share a key with one of ``crowded`` may come as well.
    """

    def run(batches):
        for batch in batches:
            for block in text_blocks(batch, "text"):
                sets = list(Shingles(block.column("text")).sets())
                yield pa.RecordBatch.from_arrays([pa.array([_node(s) if len(s) else None for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "shingles"])
        release_memory()

    keys = broadcast_if_small(crowded.select(F.col("key").alias("_key")).distinct())
    texts = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(keys, F.col("key").eqNullSafe(F.col("_key")), "left_semi")
    return texts.mapInArrow(run, "node LONG, shingles BINARY")


def compare(pairs: DataFrame, cards: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes as (u, v, common, linked); pairs whose signatures are too far apart are left out.

    ``cards`` has each node's signature and full set; ``common`` is the size of the intersection.
    """
    a = cards.select(F.col("node").alias("a"), F.col("signature").alias("sa"), F.col("shingles").alias("xa"))
    b = cards.select(F.col("node").alias("b"), F.col("signature").alias("sb"), F.col("shingles").alias("xb"))

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            sa, sb = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(batch.num_rows, -1) for c in ("sa", "sb"))
            near = np.flatnonzero((sa == sb).sum(axis=1) >= least_agreeing(sa.shape[1]))
            xa, xb = batch.column("xa"), batch.column("xb")
            common, linked = [], []
            for k in near.tolist():
                x, y = (np.frombuffer(v[k].as_buffer(), U64) for v in (xa, xb))
                common.append(len(np.intersect1d(x, y, assume_unique=True)))
                linked.append(100 * common[-1] >= PERCENT * (len(x) + len(y) - common[-1]))
            at = pa.array(near, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("a").take(at), batch.column("b").take(at), pa.array(common, pa.int64()), pa.array(linked, pa.bool_())], names=["u", "v", "common", "linked"])
        release_memory()

    return pairs.join(a, "a").join(b, "b").mapInArrow(run, "u LONG, v LONG, common LONG, linked BOOLEAN")


def _relabel(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Components after some more links: those of the links between the components so far, carried over."""
    u, v = (labels.select(F.col("node").alias(x), F.col("component").alias(f"c{x}")) for x in "uv")
    merged = components(links.join(u, "u").join(v, "v").select(F.col("cu").alias("u"), F.col("cv").alias("v")))
    merged = merged.select(F.col("node").alias("component"), F.col("component").alias("_to"))
    return written(labels.join(merged, "component", "left").select("node", F.coalesce("_to", "component").alias("component")), "labels")


def _shared(live: DataFrame, cards: DataFrame) -> DataFrame:
    """(node, n, least, shared) for the nodes of ``live``: how many of a node's shingles stand in some other node of it."""
    sized = live.groupBy("node").agg(F.min("least").alias("least"), F.min("n").alias("n"))

    def spread(batches):
        for batch in batches:
            nodes = batch.column("node").to_numpy(zero_copy_only=False)
            for k in range(batch.num_rows):
                h = np.frombuffer(batch.column("shingles")[k].as_buffer(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(np.full(len(h), nodes[k]))], names=["h", "node"])
        release_memory()

    shingles = cards.select("node", "shingles").join(sized.select("node"), "node", "left_semi").mapInArrow(spread, "h LONG, node LONG")
    owned = shingles.groupBy("h").agg(F.min("node").alias("node"), F.max("node").alias("_other")).filter(F.col("node") == F.col("_other"))
    alone = owned.groupBy("node").agg(F.count("*").alias("alone"))
    return sized.join(alone, "node", "left").select("node", "n", "least", (F.col("n") - F.coalesce("alone", F.lit(0))).alias("shared"))


def _enough(common, sizes):
    """Whether so many common shingles can make a link between sets of these sizes together."""
    return (100 + PERCENT) * common >= PERCENT * sizes


def _bounds(live: DataFrame, cards: DataFrame, main: DataFrame, compared: DataFrame, nodes: DataFrame) -> DataFrame:
    """What is known of the nodes that may still be linked: (node, hub, in_hub, outside, buckets).

    A node is out when too few of its shingles stand in any other, even for its
    smallest possible partner.  ``in_hub`` counts its shingles in its main hub's set,
    ``outside`` the others that some node shares; two nodes of one hub have at most
    the smaller of each in common.  Where the hub was too far to count, it is null.
    """
    shared = _shared(live, cards)
    partner = F.greatest(F.col("least").cast("double"), F.col("n") * (PERCENT / 100))
    able = shared.filter(_enough(F.col("shared"), F.col("n") + partner - 1e-6))
    counts = compared.select(F.col("u").alias("node"), F.col("v").alias("hub"), "common").unionByName(compared.select(F.col("v").alias("node"), F.col("u").alias("hub"), "common"))
    known = able.join(main, "node").join(counts, ["node", "hub"], "left")
    own = F.col("node") == F.col("hub")
    in_hub = F.when(own, F.col("n")).otherwise(F.col("common"))
    known = known.select("node", F.when(in_hub.isNotNull(), F.col("hub")).alias("hub"), in_hub.alias("in_hub"), F.greatest(F.col("shared") - in_hub, F.lit(0)).alias("outside"))
    return known.join(nodes.select("node", "buckets"), "node")


def _cross_pairs(live: DataFrame, hubs: DataFrame) -> DataFrame:
    """Pairs of a hub and a member of another component in its bucket that may be linked, each in the first bucket that both share."""
    h = hubs.select("bucket", *[F.col(c).alias(f"h_{c}") for c in ("node", "component", "n", "hub", "in_hub", "outside", "buckets")])
    sizes = F.col("n") + F.col("h_n")
    most = F.least("in_hub", "h_in_hub") + F.least("outside", "h_outside")
    fits = (
        (F.col("component") != F.col("h_component")) & (100 * F.least("n", "h_n") >= PERCENT * F.greatest("n", "h_n"))
        & F.coalesce((F.col("hub") != F.col("h_hub")) | _enough(most, sizes), F.lit(True))
        & (F.col("bucket") == F.array_min(F.array_intersect("buckets", "h_buckets")))
    )
    return live.join(h, "bucket").filter(fits).select(F.least("node", "h_node").alias("a"), F.greatest("node", "h_node").alias("b")).distinct()


def _mixed(live: DataFrame, labels: DataFrame, name: str) -> DataFrame:
    """The members, with their components, of the buckets that hold more than one component."""
    seen = live.join(labels, "node")
    mixed = seen.groupBy("bucket").agg(F.min("component").alias("_a"), F.max("component").alias("_b")).filter("_a <> _b").select("bucket")
    return written(seen.join(mixed, "bucket", "left_semi"), name)


def link_nodes(nodes: DataFrame, docs: DataFrame, key: str, text: str) -> DataFrame:
    """(node, component) for all nodes that share a bucket with another."""
    members = nodes.select("node", F.col("n_shingles").alias("n"), F.explode("buckets").alias("bucket"))
    counts = members.groupBy("bucket").agg(F.count("*").alias("size"), F.min("n").alias("least")).filter("size > 1")
    live = written(members.join(counts, "bucket"), "crowded")

    degree = live.groupBy("node").agg(F.sum("size").alias("degree"))
    crowded = written(nodes.join(degree, "node").select("node", "key", "signature", "degree"), "crowded-nodes")
    cards = written(full_sets(docs, key, text, crowded).dropDuplicates(["node"]).join(crowded.select("node", "signature"), "node"), "cards")
    hubs = live.join(crowded.select("node", "degree"), "node").groupBy("bucket").agg(F.max(F.struct("degree", "node")).alias("_hub"))
    led = live.select("bucket", "node").join(hubs, "bucket").select("node", "_hub").distinct()
    led = written(led.select("node", F.col("_hub.node").alias("hub"), F.col("_hub.degree").alias("degree")), "led")
    checked = led.filter("node <> hub").select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()
    compared = written(compare(checked, cards), "compared")
    labels = _relabel(crowded.select("node", F.col("node").alias("component")), compared.filter("linked"))

    live = _mixed(live.select("bucket", "node", "n", "least"), labels, "mixed")
    if live.isEmpty():
        return labels
    main = led.groupBy("node").agg(F.max(F.struct("degree", "hub"))["hub"].alias("hub"))
    bounds = written(_bounds(live, cards, main, compared, nodes), "bounds")
    live = live.select("bucket", "node", "n").join(bounds, "node")
    while True:
        live = _mixed(live, labels, "mixed")
        if live.isEmpty():
            return labels
        # the members of the smallest components of a bucket are compared with all others there
        sizes = live.groupBy("bucket", "component").agg(F.count("*").alias("_size"))
        largest = sizes.groupBy("bucket").agg(F.max(F.struct("_size", "component"))["component"].alias("_top"))
        minor = live.join(sizes, ["bucket", "component"]).join(largest, "bucket").filter("component <> _top")
        ranked = minor.withColumn("_rank", F.row_number().over(Window.partitionBy("bucket").orderBy("_size", "component", "node")))
        hubs = written(ranked.filter(F.col("_rank") <= HUBS).drop("_size", "_top", "_rank"), "hubs")
        links = written(compare(_cross_pairs(live, hubs), cards).filter("linked"), "links")
        if not links.isEmpty():
            labels = _relabel(labels, links)
        live = live.drop("component").join(hubs.select("bucket", "node"), ["bucket", "node"], "left_anti")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", bands: int = BANDS, rows: int = BAND_ROWS) -> DataFrame:
    """The class of every row: (key, n_shingles, component_id, kept).

    Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; a shingle is five of
    them, or all of a shorter text.  ``component_id`` is the smallest key that links
    reach; ``kept`` says that it is the row's own.  A text without words (null, empty,
    blank) has an empty set, is linked with nothing and is kept.  Rows of one key are
    classed one by one; the smallest key is over the non-null ones, and a null key is
    kept only where no other key is reached.  Other columns are not read.
    """
    classed = _classes(docs, key, text, MinHash(bands, rows))
    return classed.select(F.col("key").alias(key), "n_shingles", "component_id", "kept")


def _classes(docs: DataFrame, key: str, text: str, hashes: MinHash) -> DataFrame:
    """(key, n_shingles, node, class, component_id, kept) of every row; ``class`` names the class by one of its nodes, null without words."""
    found = written(features(docs, key, text, hashes), "features")
    filled = found.filter("node is not null")
    nodes = filled.groupBy("node").agg(F.min("key").alias("key"), F.first("n_shingles").alias("n_shingles"), F.first("buckets").alias("buckets"), F.first("signature").alias("signature"))
    nodes = written(nodes, "nodes")
    labels = link_nodes(nodes, docs, key, text)
    lead = nodes.select("node", "key").join(labels, "node").groupBy("component").agg(F.min("key").alias("_lead"))
    leads = labels.join(lead, "component").select("node", "component", "_lead")
    class_of = nodes.select("node", "key").join(leads, "node", "left").select("node", F.coalesce("component", "node").alias("class"), F.coalesce("_lead", "key").alias("component_id"))
    classed = found.select("key", "n_shingles", "node").join(class_of, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("key")).otherwise(F.col("component_id"))
    return classed.select("key", "n_shingles", "node", "class", component.alias("component_id"), F.col("key").eqNullSafe(component).alias("kept"))


def _with_nodes(docs: DataFrame, text: str) -> DataFrame:
    """The rows with the node of their text as a column ``node``."""

    def work(block: pa.RecordBatch):
        return [[_node(s) if len(s) else None for s in Shingles(block.column(text)).sets()]]

    return append_columns(docs, [T.StructField("node", T.LongType())], text, lambda: work)


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each class, as it is: of its smallest key, and where rows share that key, of one of their shingle sets.

    Rows are told apart by key and shingle set, so rows of one key and of different
    classes stay or go each by its own class; null keys are a key like any other.
    Texts without words all stay, of those of equal key and text one.
    """
    classed = written(_classes(docs, key, text, MinHash()).select("key", "node", "class", "kept"), "classed")
    plain, restore = set_aside(docs, text)
    own = F.col(f"_{docs.columns.index(key)}")
    many = written(classed.groupBy("key").count().filter("count > 1").select(F.col("key").alias("many")), "many")
    gone = broadcast_if_small(written(classed.filter(~F.col("kept")).select(F.col("key").alias("gone")).distinct(), "gone"))
    if many.isEmpty():
        return restore(plain.join(gone, own.eqNullSafe(F.col("gone")), "left_anti"))
    many = broadcast_if_small(many)
    repeated = own.eqNullSafe(F.col("many"))
    single = plain.join(many, repeated, "left_anti").join(gone, own.eqNullSafe(F.col("gone")), "left_anti")
    # rows of repeated keys: all of a class that are kept have one key
    stay = classed.filter("kept and node is not null").groupBy("class").agg(F.min("key").alias("key"), F.min("node").alias("node"))
    named_rows = classed.filter("node is not null").join(many, F.col("key").eqNullSafe(F.col("many")), "left_semi").select("key", "node").distinct()
    stays = F.col("s.node").eqNullSafe(F.col("r.node")) & F.col("s.key").eqNullSafe(F.col("r.key"))
    lost = named_rows.alias("r").join(stay.alias("s"), stays, "left_anti").select(F.col("key").alias("lost_key"), F.col("node").alias("lost_node"))
    lost = broadcast_if_small(written(lost, "lost"))
    rows = _with_nodes(plain.join(many, repeated, "left_semi"), text)
    rows = rows.join(lost, (F.col("node") == F.col("lost_node")) & own.eqNullSafe(F.col("lost_key")), "left_anti")
    rows = rows.withColumn("wordless", F.when(F.col("node").isNull(), named(text))).dropDuplicates([f"_{docs.columns.index(key)}", "node", "wordless"])
    return restore(single.unionByName(rows.select(*[named(c) for c in plain.columns])))
