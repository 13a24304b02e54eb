"""Substring dedup: passages of a document that an earlier document also has.

Every document is cut into reference blocks of ``BLOCK`` words that don't overlap;
these are the index.  Rolling windows of the same size probe it.  A repeat of
``WINDOW`` words covers at least ``PROBED`` blocks of the other document in a row,
whatever their alignment, so it is enough that one in ``PROBED`` of the rolling
windows of each alignment probes.  Hits are extended to whole windows: each window
of ``WINDOW`` words around a hit is looked up with its smallest document, and the
confirmed windows are joined to maximal exact repeats.

Both lookups work on packs, rows of about a megabyte of documents, which are written
first.  A pack sends each distinct key once to the bucket of the key, whatever the
number of copies in it, and gets back one bit for each; so no key gathers more rows
than there are packs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mirrorframe.llm.frames import BLOCK_BYTES, text_blocks, written
from mirrorframe.llm.texts import SPACED, U64, Words, windows

WINDOW, BLOCK = 50, 10
#: Blocks of the other document that a repeat covers at least, however they are aligned.
PROBED = (WINDOW - BLOCK + 1) // BLOCK
#: Keys that a bucket holds about.
BUCKET_KEYS = 1_000_000
#: Bytes of answers that may be broadcast to the packs; beyond it the packs are joined with them by a shuffle.
ANSWER_BYTES = 32 << 20


def pack_documents(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Rows of many documents each: (pack, keys, texts, n_words)."""

    def run(batches):
        from pyspark import TaskContext

        at = TaskContext.get().partitionId() << 33
        for batch in batches:
            for block in text_blocks(batch, "text", BLOCK_BYTES // 2):
                offsets = pa.array([0, block.num_rows], pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, block.column(c)) for c in ("key", "text")]
                n = len(Words(block.column("text"), SPACED).hashes)
                yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), *lists, pa.array([n], pa.int64())], names=["pack", "keys", "texts", "n_words"])
                at += 1

    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "pack LONG, keys ARRAY<LONG>, texts ARRAY<STRING>, n_words LONG")


class Pack:
    """The words of a pack's documents; words of documents without a key take no part in lookups."""

    def __init__(self, batch: pa.RecordBatch, k: int):
        self.id = batch.column("pack")[k].as_py()
        self.keys, self.texts = batch.column("keys")[k].values, batch.column("texts")[k].values
        self.words = Words(self.texts, SPACED)
        self.row, self.left = self.words.rows(), self.words.left()
        self.at = np.arange(len(self.row)) - self.words.first[:-1][self.row]
        self.key = self.keys.fill_null(0).to_numpy(zero_copy_only=False)[self.row]
        self.has_key = self.keys.is_valid().to_numpy(zero_copy_only=False)[self.row]

    def anchors(self) -> "Lookup":
        """The reference blocks and the probing windows."""
        whole = (self.left >= BLOCK) & self.has_key
        block, probe = whole & (self.at % BLOCK == 0), whole & (self.at // BLOCK % PROBED == 0)
        at = np.flatnonzero(block | probe)
        return Lookup(at, windows(self.words.hashes, BLOCK)[at], self.key[at], block[at] * 1 + probe[at] * 2)

    def around(self, hits: np.ndarray) -> "Lookup":
        """The whole windows that hold a hit."""
        starts = np.zeros(len(self.row) + 1, np.int64)
        np.add.at(starts, np.maximum(hits - (WINDOW - BLOCK), self.words.first[:-1][self.row[hits]]), 1)
        np.add.at(starts, hits + 1, -1)
        at = np.flatnonzero((np.cumsum(starts)[:-1] > 0) & (self.left >= WINDOW))
        return Lookup(at, windows(self.words.hashes, WINDOW)[at], self.key[at])


class Lookup:
    """Positions with a hash each, and the distinct hashes in order, with the least key and the kinds of each."""

    def __init__(self, at: np.ndarray, hashes: np.ndarray, key: np.ndarray, kind: np.ndarray | None = None):
        self.at, self.key = at, key
        order = np.argsort(hashes)
        ordered = hashes[order]
        head = np.ones(len(at), bool)
        head[1:] = ordered[1:] != ordered[:-1]
        first = np.flatnonzero(head)
        self.hashes = ordered[first]
        self.of = np.empty(len(at), np.int64)
        self.of[order] = np.cumsum(head) - 1
        empty = not len(at)
        self.least = key if empty else np.minimum.reduceat(key[order], first)
        self.several = np.zeros(0, bool) if empty else np.maximum.reduceat(key[order], first) > self.least
        if kind is not None:
            self.kinds = np.zeros(0, np.uint8) if empty else np.bitwise_or.reduceat(kind.astype(np.uint8)[order], first)

    def rows(self, pack: int, buckets: int, keys: np.ndarray, marks: np.ndarray) -> pa.RecordBatch:
        """What to send: a row for each bucket, which is a range of hashes, that any key falls into."""
        width = (1 << 64) // buckets + 1
        inner = np.searchsorted(self.hashes, np.array([b * width for b in range(1, buckets)], U64))
        edges = [0, *inner.tolist(), len(keys)]
        filled = [b for b in range(buckets) if edges[b] < edges[b + 1]]
        cut = [[v[edges[b] : edges[b + 1]].tobytes() for b in filled] for v in (keys, marks)]
        return pa.RecordBatch.from_arrays([pa.array(filled, pa.int32()), pa.array([pack] * len(filled), pa.int64()), *[pa.array(c, pa.binary()) for c in cut]], names=["bucket", "pack", "keys", "marks"])


SENT = "bucket INT, pack LONG, keys BINARY, marks BINARY"
ANSWER = "pack LONG, bucket INT, bits BINARY, hits LONG"


def _send_anchors(buckets: int):
    """Each pack's distinct anchors: 32 bits of the hash besides those that name the bucket, and marks: is a block, is a probe, two documents here have it."""

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                pack = Pack(batch, k)
                found = pack.anchors()
                yield found.rows(pack.id, buckets, (found.hashes >> U64(8)).astype(np.uint32), found.kinds | found.several.astype(np.uint8) << 2)

    return run


def _send_windows(buckets: int):
    """Each pack's distinct windows around hits, with the smallest key that has each here."""

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                pack = Pack(batch, k)
                hit = _answers(batch, k, "anchor_hits")
                anchors = pack.anchors()
                found = pack.around(anchors.at[hit[anchors.of]])
                if len(found.at):
                    yield found.rows(pack.id, buckets, found.hashes, found.least)

    return run


def _grouped(table: pa.Table, key_type, mark_type):
    """All keys and marks of a bucket, ordered by key, with the bounds of equal keys and the way back to the rows."""
    sizes = np.array([len(x) for x in table.column("keys").to_pylist()], np.int64) // np.dtype(key_type).itemsize
    keys = np.frombuffer(b"".join(table.column("keys").to_pylist()), key_type)
    marks = np.frombuffer(b"".join(table.column("marks").to_pylist()), mark_type)
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    head = np.ones(len(keys), bool)
    head[1:] = ordered[1:] != ordered[:-1]
    return sizes, marks, order, np.flatnonzero(head), np.cumsum(head) - 1


def _reply(table: pa.Table, sizes: np.ndarray, order: np.ndarray, ordered_hit: np.ndarray) -> pa.Table:
    hit = np.empty(len(order), bool)
    hit[order] = ordered_hit
    cut = np.split(hit, np.cumsum(sizes)[:-1])
    return pa.table({"pack": table.column("pack"), "bucket": table.column("bucket"), "bits": pa.array([np.packbits(c).tobytes() for c in cut], pa.binary()), "hits": pa.array([int(c.sum()) for c in cut], pa.int64())})


def _match_anchors(table: pa.Table) -> pa.Table:
    """Which anchors are a block in some document and a probe in some, and stand in two documents."""
    sizes, marks, order, first, group = _grouped(table, np.uint32, np.uint8)
    kinds = np.bitwise_or.reduceat(marks[order], first)
    packs = np.diff(np.append(first, len(order)))
    good = (kinds & 3 == 3) & ((packs > 1) | (kinds & 4 > 0))
    return _reply(table, sizes, order, good[group])


def _match_windows(table: pa.Table) -> pa.Table:
    """For which windows another pack has a smaller key."""
    sizes, least, order, first, group = _grouped(table, U64, np.int64)
    return _reply(table, sizes, order, np.minimum.reduceat(least[order], first)[group] < least[order])


def _answers(batch: pa.RecordBatch, k: int, column: str) -> np.ndarray:
    """The bits that came back for a pack, in the order of its distinct hashes."""
    parts = batch.column(column)[k].as_py() or []
    return np.concatenate([np.zeros(0, bool), *[np.unpackbits(np.frombuffer(p["bits"], np.uint8), count=p["keys"]).astype(bool) for p in sorted(parts, key=lambda p: p["bucket"])]])


def _with_answers(packs: DataFrame, sent: DataFrame, match, key_bytes: int, name: str) -> tuple[DataFrame, int]:
    """Look the sent keys up in their buckets and put the answers beside the packs; also the number of hits."""
    answers = sent.withColumn("n_keys", (F.octet_length("keys") / key_bytes).cast("int"))

    def run(table: pa.Table) -> pa.Table:
        return match(table).append_column("keys", table.column("n_keys"))

    answers = written(answers.groupBy("bucket").applyInArrow(run, f"{ANSWER}, keys INT"), name)
    hits, size = answers.agg(F.coalesce(F.sum("hits"), F.lit(0)), F.coalesce(F.sum(F.octet_length("bits") + 24), F.lit(0))).first()
    by_pack = answers.groupBy("pack").agg(F.collect_list(F.struct("bucket", "keys", "bits")).alias(name))
    return packs.join(F.broadcast(by_pack) if size <= ANSWER_BYTES else by_pack, "pack", "left"), hits


def _buckets(keys: int) -> int:
    return max(1, -(-int(keys) // BUCKET_KEYS))


RESULT = T.StructType([
    T.StructField("key", T.LongType()), T.StructField("n_words", T.LongType()),
    T.StructField("removed", T.ArrayType(T.ArrayType(T.LongType()))), T.StructField("kept_text", T.StringType()),
])


def _cut(batches):
    for batch in batches:
        for k in range(batch.num_rows):
            pack = Pack(batch, k)
            words = pack.words
            hit, anchors = _answers(batch, k, "anchor_hits"), pack.anchors()
            gone = np.zeros(len(words.hashes) + 1, np.int64)
            if hit.any():
                found = pack.around(anchors.at[hit[anchors.of]])
                elsewhere = _answers(batch, k, "window_hits")
                repeated = found.at[(found.key > found.least[found.of]) | elsewhere[found.of]] if len(found.at) else found.at
                gone[repeated] += 1
                np.add.at(gone, repeated + WINDOW, -1)
            gone = np.cumsum(gone)[:-1] > 0
            removed, kept = [], []
            data = words.data.tobytes()
            for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
                edge = np.flatnonzero(np.diff(np.concatenate([[0], gone[a:b], [0]])))
                removed.append(edge.reshape(-1, 2).tolist())
                stay = np.flatnonzero(~gone[a:b]) + a
                kept.append(b" ".join([data[x:y] for x, y in zip(words.starts[stay].tolist(), words.ends[stay].tolist(), strict=True)]).decode())
            yield pa.RecordBatch.from_arrays([
                pack.keys, pa.array(words.counts, pa.int64()), pa.array(removed, pa.list_(pa.list_(pa.int64()))), pa.array(kept, pa.string()),
            ], names=RESULT.names)


def cut_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every document without the passages that a document with a smaller key also has: (key, n_words, removed, kept_text).

    Words are ``[^\\x20\\x09-\\x0D]+``.  A word goes if some run of ``WINDOW`` words
    that holds it stands in a document with a smaller key; ``removed`` has the maximal
    runs [first word, end) that go, ``kept_text`` the other words joined by one space.
    All runs are judged on the input.  A null or blank text has no words; keys are
    integers, a document with a null key keeps all words and takes none from others; documents of equal
    key take none from one another.  Other columns are not read.

    A window is known by a 64-bit hash of its words.
    """
    packs = written(pack_documents(docs, key, text), "packs")
    n_words = packs.agg(F.coalesce(F.sum("n_words"), F.lit(0))).first()[0]
    buckets = _buckets(n_words * (BLOCK + PROBED) / (BLOCK * PROBED))
    probed, hits = _with_answers(packs, packs.mapInArrow(_send_anchors(buckets), SENT), _match_anchors, 4, "anchor_hits")
    sent = probed.filter("anchor_hits is not null").mapInArrow(_send_windows(_buckets(3 * hits)), SENT)
    found, _ = _with_answers(probed, sent, _match_windows, 8, "window_hits")
    return found.mapInArrow(_cut, RESULT).withColumnRenamed("key", key)
