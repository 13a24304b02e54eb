"""Byte-level BPE by replaying the merges over a whole corpus of words.

All words of a batch that the task hasn't met before are laid out side by side, each
once, and an inverted index says for each mergeable pair of neighbouring tokens at which
positions it stands.  The pairs are then merged in the order of their ranks, each at all
its positions at once; only the two neighbours of a merged pair change, and only they are
looked up again.
"""

from __future__ import annotations

import base64
import heapq
from collections import defaultdict
from itertools import count, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from mirrorframe.llm.frames import append_columns

#: Words that a task remembers; beyond it the memory starts anew.  Results don't depend on it.
REMEMBERED = 600_000
#: Bytes of text encoded together: the larger, the more positions share one step of the replay.
ENCODE_BYTES = 8 << 20
#: Spans or places worked on at a time, so that what is needed on the way stays small beside the text.
AT_ONCE = 1 << 17


def read_ranks(path: str) -> dict[bytes, int]:
    """A vocabulary file: a base64 token and its rank in each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, lines))}


def join_spans(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``values[start:start + size]`` of many spans, one after another."""
    out, done = np.empty(int(sizes.sum()), values.dtype), 0
    for k in range(0, len(sizes), AT_ONCE):
        n = sizes[k : k + AT_ONCE]
        ends = np.cumsum(n)
        shift = starts[k : k + AT_ONCE] - (ends - n)
        out[done : done + ends[-1]] = values[np.arange(ends[-1]) + np.repeat(shift, n)]
        done += int(ends[-1])
    return out


class Merges:
    """Which two neighbouring tokens make which token."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.narrow = max(ranks.values(), default=0) < 1 << 31
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"the vocabulary has no token for the bytes {missing[:5]}")
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        made = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    made[left << 32 | right] = rank
        pairs = np.array(sorted(made.items()), np.int64).reshape(-1, 2)
        self.pairs, self.made = np.append(pairs[:, 0], np.iinfo(np.int64).max), np.append(pairs[:, 1], -1)

    def look_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of the joined tokens, or -1; also where either is no token but -1."""
        pair = left.astype(np.int64) << 32 | right
        at = np.searchsorted(self.pairs, pair)
        return np.where((self.pairs[at] == pair) & (left >= 0) & (right >= 0), self.made[at], -1)


def replay_flat(words: list[bytes], merges: Merges) -> tuple[np.ndarray, np.ndarray]:
    """All token ids of non-empty words, one after another, and how many each word has.

    In every word the lowest rank goes first and the leftmost of equal ones.
    """
    # all words side by side, each followed by an end mark; pair[k]: the rank that place k and the next one make
    sizes = np.array([len(w) + 1 for w in words], np.int64)
    letters = np.frombuffer(b"\0".join(words) + b"\0", np.uint8)
    # ranks and places of the usual block take 32 bits
    kind = np.int32 if len(letters) < 1 << 31 and merges.narrow else np.int64
    word = np.repeat(np.arange(len(words), dtype=kind), sizes)
    token = merges.single.astype(kind)[letters]
    token[np.cumsum(sizes) - 1] = -1
    pair = np.full(len(token), -1, kind)
    for k in range(0, len(token) - 1, AT_ONCE):
        end = min(k + AT_ONCE, len(token) - 1)
        pair[k:end] = merges.look_up(token[k:end], token[k + 1 : end + 1])
    by_rank = np.flatnonzero(pair >= 0).astype(kind)
    by_rank = by_rank[np.argsort(pair[by_rank], kind="stable")]
    cut = np.flatnonzero(np.diff(pair[by_rank])) + 1
    # places known from the start, and those that arise
    begun = {int(pair[g[0]]): g for g in np.split(by_rank, cut) if len(g)}
    index: dict[int, list[int]] = {rank: [] for rank in begun}
    order = list(index)
    heapq.heapify(order)
    after, before = np.arange(1, len(token) + 1, dtype=kind), np.arange(-1, len(token) - 1, dtype=kind)

    def file(ranks: np.ndarray, places: np.ndarray) -> None:
        for rank, at in zip(ranks.tolist(), places.tolist(), strict=True):
            if rank >= 0:
                if rank in index:
                    index[rank].append(at)
                else:
                    index[rank] = [at]
                    heapq.heappush(order, rank)

    while order:
        rank = heapq.heappop(order)
        at = np.concatenate([begun.pop(rank, word[:0]), np.array(index.pop(rank), kind)])
        at = at[pair[at] == rank]  # not merged away, nor with another neighbour since
        if not at.size:
            continue
        at.sort()
        # one merge a word: its next place of this rank may come after a lower rank that arises here
        first = np.ones(len(at), bool)
        first[1:] = word[at[1:]] != word[at[:-1]]
        if not first.all():
            index[rank] = at[~first].tolist()
            heapq.heappush(order, rank)
            at = at[first]
        right = after[at]
        beyond = after[right]
        token[at], token[right], pair[right], after[at], before[beyond] = rank, -2, -1, beyond, at
        made = merges.look_up(token[at], token[beyond])
        pair[at] = made
        file(made, at)
        left = before[at]
        at, left = at[left >= 0], left[left >= 0]
        made = merges.look_up(token[left], token[at])
        pair[left] = made
        file(made, left)

    whole = np.flatnonzero(token >= 0)
    return token[whole], np.bincount(word[whole], minlength=len(words))


def replay(words: list[bytes], merges: Merges) -> list[list[int]]:
    """Token ids of each non-empty word."""
    ids, sizes = replay_flat(words, merges)
    return [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] if words else []


class Encoder:
    """Encodes blocks of texts and remembers the words it has met."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, remembered: int = REMEMBERED):
        import regex

        self.merges, self.find, self.remembered = Merges(ranks), regex.compile(pattern).findall, remembered
        self.forget()

    def forget(self):
        # a word met for the first time gets the next place
        self.place: dict[str, int] = defaultdict(count().__next__)
        self.ids, self.start, self.used, self.learned = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int64), 0, 0

    def learn(self):
        """Replay the merges of the words that have a place, but no ids yet."""
        new = list(islice(self.place, self.learned, None))
        if not new:
            return
        whole = self.merges.ranks
        ids = [whole.get(w, -1) for w in (w.encode() for w in new)]
        sizes, flat = np.ones(len(new), np.int64), np.array(ids, np.int64)
        open_words = np.flatnonzero(flat < 0)
        if len(open_words):
            coded, counts = replay_flat([new[k].encode() for k in open_words.tolist()], self.merges)
            sizes[open_words] = counts
            out = np.empty(sizes.sum(), np.int64)
            inside = np.zeros(len(new), bool)
            inside[open_words] = True
            inside = np.repeat(inside, sizes)
            out[inside], out[~inside] = coded, flat[flat >= 0]
            flat = out
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while len(self.place) + 1 > len(self.start):
            self.start = np.concatenate([self.start, np.zeros_like(self.start)])
        self.ids[self.used : self.used + len(flat)] = flat
        self.start[self.learned + 1 : len(self.place) + 1] = self.used + np.cumsum(sizes)
        self.used += len(flat)
        self.learned = len(self.place)

    def encode(self, texts: list[str] | pa.Array) -> pa.ListArray:
        if len(self.place) > self.remembered:
            self.forget()
        parts, bounds = [np.zeros(0, np.int64)], [0]
        for t in texts:
            words = self.find(t.as_py() if isinstance(t, pa.Scalar) else t)
            parts.append(np.fromiter(map(self.place.__getitem__, words), np.int64, len(words)))
            bounds.append(bounds[-1] + len(words))
        self.learn()
        at = np.concatenate(parts)
        start = self.start[at]
        sizes = self.start[at + 1] - start
        ends = np.concatenate([[0], np.cumsum(sizes)])
        flat = join_spans(self.ids, start, sizes)
        return pa.ListArray.from_arrays(pa.array(ends[bounds], pa.int32()), pa.array(flat, pa.int32()))


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text", out: str = "token_ids") -> DataFrame:
    """Add the token ids of every text, without special tokens.

    ``pattern`` cuts a text into words, each encoded separately.  ``ranks`` is the
    vocabulary: of fixed size, whatever the data, so it is broadcast.  A null or empty
    text has no ids; a column of the name ``out`` is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast((ranks, pattern))

    def make():
        encoder = Encoder(*shared.value)
        return lambda block: [encoder.encode(block.column(text).fill_null(""))]

    return append_columns(docs, [T.StructField(out, T.ArrayType(T.IntegerType()))], text, make, ENCODE_BYTES)


class Decoder:
    """Turns lists of ids into the bytes of their tokens."""

    def __init__(self, ranks: dict[bytes, int]):
        token = [b""] * (max(ranks.values()) + 1)
        for t, r in ranks.items():
            token[r] = t
        self.lengths = np.array([len(t) for t in token], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])[:-1]
        self.letters = np.frombuffer(b"".join(token), np.uint8)

    def decode(self, lists: pa.ListArray) -> pa.Array:
        counts = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        flat = lists.flatten().to_numpy(zero_copy_only=False)
        if len(flat) and not (0 <= flat.min() and flat.max() < len(self.lengths) and self.lengths[flat].all()):
            raise ValueError("a token id is not in the vocabulary")
        sizes = self.lengths[flat]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        data = join_spans(self.letters, self.starts[flat], sizes)
        offsets = ends[np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)]
        return pa.Array.from_buffers(pa.large_binary(), len(lists), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)])


def decode(tokens: DataFrame, ranks: dict[bytes, int], ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """Add the bytes that the ids stand for; null or empty lists give empty bytes, an unknown id fails the job."""
    shared = tokens.sparkSession.sparkContext.broadcast(ranks)

    def make():
        decoder = Decoder(shared.value)
        return lambda block: [decoder.decode(block.column(ids))]

    return append_columns(tokens, [T.StructField(out, T.BinaryType())], ids, make)


def round_trip(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text", ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """``encode`` and ``decode`` of its ids in one worker: adds both columns."""
    shared = docs.sparkSession.sparkContext.broadcast((ranks, pattern))

    def make():
        encoder, decoder = Encoder(*shared.value), Decoder(shared.value[0])

        def work(block):
            coded = encoder.encode(block.column(text).fill_null(""))
            return [coded, decoder.decode(coded)]

        return work

    return append_columns(docs, [T.StructField(ids, T.ArrayType(T.IntegerType())), T.StructField(out, T.BinaryType())], text, make, ENCODE_BYTES)
