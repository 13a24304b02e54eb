"""Phrase collocations by Toivonen's sampling: a sample proposes, the whole corpus decides.

1. A sample of the documents is counted level by level; its phrases that reach a lowered
   threshold are the proposal.
2. One pass over all documents counts exactly every proposed phrase and every phrase
   of the negative border: one that isn't proposed although both its parts, without the
   last and without the first word, are.  Single words are always counted.
3. A phrase of the border that reaches the threshold was missed by the sample.  It joins
   the proposal, and an expansion pass counts the phrases that the larger proposal
   adds, and at once those that these would add in turn.  So nothing frequent is left
   uncounted after it: a frequent phrase has frequent parts, and each of them was either counted
   before, and is in the proposal now, or counted by the same pass.

The proposal travels to the tasks as a table of ``PROPOSAL_BITS`` bits, whatever its size;
phrases that share a bit with a proposed one are counted as well, which costs a row and
changes no result.  Phrases are known by 128 bits of (language, words); counts combine in
blocks and in tasks before they are shuffled by these bits.  As most words and most of the border are rare,
a pass first counts 32 bits of each name, exactly: a phrase whose 32 bits stay below the
threshold does so itself, and only the others are counted by their whole name.  Whether a place
belongs to the border depends on its words alone, so a phrase is counted at all its places by one pass or by none of them.  The number of a language's
words is counted as that of its empty phrase, so it comes with the rest.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mirrorframe.llm.frames import broadcast_if_small, named, release_memory, text_blocks, written
from mirrorframe.llm.texts import U64, Alphabet, Powers, buffers, mix, word_spans

LONGEST, THRESHOLD, REPORTED = 5, 100, 2000
#: One in so many documents is in the sample; its threshold is its share of the whole one, less so many deviations.
SAMPLED, DEVIATIONS = 8, 2.0
#: Bits of the proposal: 4 MB in a task.
PROPOSAL_BITS = 1 << 25
#: Places of missed phrases up to which one scan expands and names them: a few rows for each place, beside the pass before.
FEW_PLACES = 1 << 24
#: Bytes of text counted together.
COUNT_BYTES = 1 << 20
#: Cells and rows that a task adds up before it sends them on.
HELD_CELLS, HELD_ROWS = 1 << 22, 1 << 20
#: Cells are sent by their first bits, packed; a bucket is added up in one array of all its cells.
BUCKET_BITS = 10
_INNER = 32 - BUCKET_BITS
#: A bucket of fewer cells than that is read by them, not from end to end.
FEW_CELLS = 1 << 18

_BREAKS = [0x2E, 0x2C, 0x3B, 0x3A, 0x21, 0x3F, *range(0x0A, 0x0E)]
#: Words ``[^\\x20\\x09]+`` of pieces between ``[.,;:!?\\x0A-\\x0D]``.
PIECE_WORDS = Alphabet([0x20, 0x09, *_BREAKS], lower=True)
_BREAK = np.zeros(256, bool)
_BREAK[_BREAKS] = True
#: Bytes as they are compared, and the bits of a word's last eight bytes that are its own.
_LOWERED = np.arange(256, dtype=np.uint8)
_LOWERED[65:91] += np.uint8(32)
_OWN = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)
#: Both halves of a name: what is added to eight bytes, and the powers of bytes, lengths and words.
_HALVES = [
    (U64(0x2545F4914F6CDD1D), Powers(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F), Powers(0xD6E8FEB86659FD93)),
    (U64(0x8CB92BA72F3D8DD7), Powers(0xA24BAED4963EE407), U64(0x165667B19E3779F9), Powers(0x9FB21C651E98DF25)),
]
UNKNOWN = "und"
_LOWER = {c: c + 32 for c in range(65, 91)}


def _halves(lang: str) -> tuple[int, int]:
    """128 bits that tell a language's phrases from those of others."""
    name = int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=16).digest(), "little")
    return name & (1 << 64) - 1, name >> 64


class PieceWords:
    """The words of a block of texts, and how many words of its piece follow each, itself included."""

    def __init__(self, texts: pa.Array, langs: pa.Array):
        self.data, offsets = buffers(texts)
        self.starts, self.ends = word_spans(self.data, offsets, PIECE_WORDS)
        n, first = len(self.starts), np.searchsorted(self.starts, offsets)
        new = np.zeros(n + 1, bool)
        new[first] = new[np.searchsorted(self.starts, np.flatnonzero(_BREAK[self.data]))] = True
        new[[0, n]] = True
        edge = np.flatnonzero(new)
        self.left = np.repeat(edge[1:], np.diff(edge)) - np.arange(n)
        codes = langs.fill_null(UNKNOWN).dictionary_encode()
        self.langs, code = codes.dictionary.to_pylist(), codes.indices.to_numpy(zero_copy_only=False)
        self.code = np.repeat(code, np.diff(first))
        self.halves = np.array([_halves(x) for x in self.langs], U64).reshape(-1, 2)
        self.hashes = [None, None]

    def _hashes(self, half: int) -> np.ndarray:
        """A hash of each word: its bytes eight at a time, mixed, times powers, and its length."""
        if self.hashes[half] is None:
            salt, powers, by_length, _ = _HALVES[half]
            padded = np.concatenate([_LOWERED[self.data], np.zeros(8, np.uint8)])
            eight = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
            size = self.ends - self.starts
            out = mix((eight[self.starts] & _OWN[np.minimum(size, 8)]) + salt) + size.astype(U64) * by_length
            more = np.flatnonzero(size > 8)
            if len(more):
                parts = (size[more] - 1) >> 3  # after the first eight bytes
                head = np.cumsum(parts) - parts
                k = np.arange(int(parts.sum())) - np.repeat(head, parts) + 1
                at = np.repeat(self.starts[more], parts) + 8 * k
                own = np.minimum(np.repeat(self.ends[more], parts) - at, 8)
                out[more] += np.add.reduceat(mix((eight[at] & _OWN[own]) + salt) * powers.upto(int(k.max()) + 1)[0][k], head)
            self.hashes[half] = out
        return self.hashes[half]

    def _names(self, half: int, size: int, at: np.ndarray) -> np.ndarray:
        words, up, out = self._hashes(half), _HALVES[half][3].upto(size + 1)[0], self.halves[self.code[at], half]
        for k in range(size):
            out += words[at + k] * up[k]
        return mix(out)

    def name(self, size: int, at: np.ndarray) -> np.ndarray:
        """The first half of the name of the ``size`` words from some places on, each with ``left >= size``."""
        return self._names(0, size, at)

    def other_half(self, size: int, at: np.ndarray) -> np.ndarray:
        """The second half of these names."""
        return self._names(1, size, at)

    def places(self, size: int) -> np.ndarray:
        """Where phrases of ``size`` words are; of the empty one the first place of each language."""
        return np.flatnonzero(self.left >= size) if size else np.unique(self.code, return_index=True)[1]

    def totals(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Names (a, b) of the empty phrases, and how often each occurs: before every word."""
        at = self.places(0)
        return self.name(0, at), self.other_half(0, at), np.bincount(self.code, minlength=len(self.langs))[self.code[at]]

    def longer(self, parts: np.ndarray, size: int) -> np.ndarray:
        """Of the places ``parts`` of phrases of ``size - 1`` words, in order: those whose next place is one too, so that both make ``size`` words."""
        known = np.zeros(len(self.left) + 1, bool)
        known[parts] = True
        return parts[known[parts + 1] & (self.left[parts] >= size)]

    def text(self, at: int, size: int) -> tuple[str, str]:
        """(language, phrase) of the words from one on."""
        span = range(at, at + size)
        words = (self.data[self.starts[i] : self.ends[i]].tobytes().decode().translate(_LOWER) for i in span)
        return self.langs[self.code[at]], " ".join(words)


#: Places of phrases of one size, with the first half of their names.
Places = tuple[int, np.ndarray, np.ndarray]


class Proposal:
    """A set of phrase names as bits; it may hold some more than were put in, never fewer."""

    def __init__(self, bits: int = PROPOSAL_BITS):
        self.cells = np.zeros(bits // 64, np.int64)

    def add(self, names: DataFrame) -> None:
        """Put in the names ``a`` of a table: tasks join the bits of a cell, and no more than the cells come to the driver."""
        at = F.col("a").bitwiseAND(F.lit(64 * len(self.cells) - 1))
        cells = names.select(F.shiftright(at, 6).alias("cell"), F.expr("shiftleft(1L, CAST(a & 63 AS INT))").alias("bit"))
        found = cells.groupBy("cell").agg(F.bit_or("bit").alias("bits")).toArrow()
        self.cells[found["cell"].to_numpy()] |= found["bits"].to_numpy()

    def holds(self, names: np.ndarray) -> np.ndarray:
        at = names & U64(64 * len(self.cells) - 1)
        return (self.cells.view(U64)[(at >> U64(6)).astype(np.int64)] >> (at & U64(63)) & U64(1)).astype(bool)

    def copy(self) -> Proposal:
        out = Proposal(64 * len(self.cells))
        out.cells[:] = self.cells
        return out


def _rows_of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Names (a, b) with their numbers and where each is first; a name may come twice where another shares its first half."""
    order = np.argsort(a)
    a, b = a[order], b[order]
    at = np.flatnonzero(np.concatenate([np.ones(min(len(a), 1), bool), (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
    return a[at], b[at], np.diff(np.append(at, len(a))), order[at]


def _added_up(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Names (a, b, n) of several blocks, added up."""
    a, b, n = (np.concatenate(x) for x in zip(*rows, strict=True))
    order = np.argsort(a)
    a, b, n = a[order], b[order], n[order]
    at = np.flatnonzero(np.concatenate([np.ones(min(len(a), 1), bool), (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
    if len(at):
        whole = pa.RecordBatch.from_arrays([pa.array(a[at].view(np.int64)), pa.array(b[at].view(np.int64)), pa.array(np.add.reduceat(n, at))], names=["a", "b", "n"])
        yield from (whole.slice(k, 1 << 18) for k in range(0, len(at), 1 << 18))


def count_phrases(docs: DataFrame, wanted: Callable[[PieceWords], list[Places]], block: int, empty: bool = False) -> DataFrame:
    """(a, b, n): how often the phrases occur at the places that ``wanted`` gives for each block, and the empty phrase if asked."""

    def run(batches):
        rows, held = [], 0
        for batch in batches:
            for part in text_blocks(batch, "text", block):
                words = PieceWords(part.column("text"), part.column("lang"))
                new = [words.totals()] * empty + [_rows_of(a, words.other_half(size, at))[:3] for size, at, a in wanted(words)]
                rows += new
                held += sum(len(a) for a, _, _ in new)
                if held >= HELD_ROWS:
                    yield from _added_up(rows)
                    rows, held = [], 0
        if rows:
            yield from _added_up(rows)
        release_memory()

    return docs.mapInArrow(run, "a LONG, b LONG, n LONG").groupBy("a", "b").agg(F.sum("n").alias("n"))


def _packed(cells: np.ndarray, most: int) -> pa.RecordBatch:
    """Cells with their numbers, no more than ``most`` each, as one row for each bucket: (bucket, cells, n), the last two packed."""
    cells = np.sort(cells)
    at = np.flatnonzero(np.concatenate([np.ones(min(len(cells), 1), bool), cells[1:] != cells[:-1]]))
    n = np.minimum(np.diff(np.append(at, len(cells))), most).astype(np.uint32)
    cells = cells[at]
    edges = np.searchsorted(cells, np.arange(1 << BUCKET_BITS, dtype=U64) << U64(_INNER))
    edges = np.append(edges, len(cells))
    used = np.flatnonzero(np.diff(edges))
    offsets = pa.py_buffer((4 * np.append(edges[used], len(cells))).astype(np.int32))
    inner = cells & np.uint32((1 << _INNER) - 1)
    return pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), *[pa.Array.from_buffers(pa.binary(), len(used), [None, offsets, pa.py_buffer(x)]) for x in (inner, n)]], names=["bucket", "cells", "n"])


def count_cells(docs: DataFrame, wanted: Callable[[PieceWords], list[Places]], block: int, threshold: float) -> DataFrame:
    """(a): the last 32 bits of names, which several phrases may share, that occur ``threshold`` times at the places of ``wanted``.

    Tasks send their cells packed by bucket.  A bucket has a place for each of its cells, whatever
    the corpus, and numbers stop at the threshold, so adding up takes the same memory for any input.
    """
    most = max(1, math.ceil(threshold))

    def pack(batches):
        cells, held = [], 0
        for batch in batches:
            for part in text_blocks(batch, "text", block):
                words = PieceWords(part.column("text"), part.column("lang"))
                for _, _, a in wanted(words):
                    cells.append(a.astype(np.uint32))
                    held += len(a)
                if held >= HELD_CELLS:
                    yield _packed(np.concatenate(cells), most)
                    cells, held = [], 0
        if held:
            yield _packed(np.concatenate(cells), most)
        release_memory()

    def add_up(batches):
        numbers, seen, held, bucket = np.zeros(1 << _INNER, np.uint32), [], 0, None

        def frequent():
            some = np.unique(np.concatenate(seen)) if held <= FEW_CELLS else np.arange(len(numbers))
            found = some[numbers[some] >= most].astype(np.int64) | (bucket << _INNER)
            numbers[some] = 0
            return pa.RecordBatch.from_arrays([pa.array(found)], names=["a"])

        for batch in batches:
            for k, c, n in zip(*(batch.column(x).to_pylist() for x in ("bucket", "cells", "n")), strict=True):
                if k != bucket:
                    if bucket is not None:
                        yield frequent()
                    seen, held, bucket = [], 0, k
                c, n = np.frombuffer(c, np.uint32), np.frombuffer(n, np.uint32)
                numbers[c] = np.minimum(numbers[c] + n, np.uint32(most))
                held += len(c)
                seen = [*seen, c] if held <= FEW_CELLS else []
        if bucket is not None:
            yield frequent()
        release_memory()

    packed = docs.mapInArrow(pack, "bucket INT, cells BINARY, n BINARY")
    return packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(add_up, "a LONG")


def _border(words: PieceWords, proposal: Proposal, longest: int) -> list[Places]:
    """All words, and the longer phrases both parts of which are proposed and here themselves."""
    at = words.places(1)
    out = [(1, at, words.name(1, at))]
    for size in range(2, longest + 1):
        _, at, names = out[-1]
        at = words.longer(at[proposal.holds(names)], size)
        out.append((size, at, words.name(size, at)))
    return out


def _added(words: PieceWords, border: list[Places], before: Proposal, larger: Proposal) -> list[Places]:
    """What ``larger`` adds to the border of ``before``: phrases with a part that only it holds, or that is added itself."""
    out, new = [], np.zeros(0, np.int64)
    for (_, at, names), (size, known, _) in zip(border, border[1:], strict=False):
        held = larger.holds(names)
        if len(new) or (held & ~before.holds(names)).any():
            parts = words.longer(np.sort(np.concatenate([at[held], new])), size)
            new = np.setdiff1d(parts, known, assume_unique=True)
        out.append((size, new, words.name(size, new)))
    return out


def proposed(docs: DataFrame, threshold: float, longest: int = LONGEST, bits: int = PROPOSAL_BITS, block: int = COUNT_BYTES) -> Proposal:
    """The phrases of a sample that occur ``threshold`` times, counted level by level: a longer one only where both its parts are in."""
    proposal = Proposal(bits)
    for size in range(1, longest + 1):

        def wanted(words, size=size, known=proposal.copy()):
            return _border(words, known, size)[-1:]

        proposal.add(count_phrases(docs, wanted, block, size == 1).filter(F.col("n") >= threshold))
    return proposal


def count_with_border(docs: DataFrame, proposal: Proposal, before: Proposal | None, threshold: int, longest: int, block: int) -> DataFrame:
    """(a, b, n) of the phrases of the proposal and its border that occur ``threshold`` times in all documents.

    With ``before``, an earlier proposal whose counts are known, only what is new is
    counted: phrases with a part that is not in it, where parts that are new
    themselves count like proposed ones.
    """

    def border(words):
        return _border(words, proposal, longest) if before is None else _added(words, _border(words, before, longest), before, proposal)

    common = Proposal(64 * len(proposal.cells))
    common.add(count_cells(docs, border, block, threshold))

    def wanted(words):
        return [(size, at[held], a[held]) for size, at, a in border(words) for held in [common.holds(a)]]

    return count_phrases(docs, wanted, block, before is None).filter(F.col("n") >= threshold)


def name_phrases(docs: DataFrame, frequent: DataFrame, longest: int, bits: int, block: int) -> DataFrame:
    """(a, b, size, lang, phrase) of phrases (a, b) that occur in ``docs``; every task writes down each of them once."""
    looked_for = Proposal(bits)
    looked_for.add(frequent)

    def run(batches):
        seen = np.zeros(0, U64)
        for batch in batches:
            for rows in text_blocks(batch, "text", block):
                words = PieceWords(rows.column("text"), rows.column("lang"))
                for size in range(longest + 1):
                    at = words.places(size)
                    a = words.name(size, at)
                    held = looked_for.holds(a)
                    at, a = at[held], a[held]
                    b = words.other_half(size, at)
                    both, first = np.unique(a ^ (b << U64(1)), return_index=True)
                    new = ~np.isin(both, seen, assume_unique=True)
                    seen, first = np.union1d(seen, both[new]), first[new]
                    texts = [words.text(i, size) for i in at[first].tolist()]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(a[first].view(np.int64)), pa.array(b[first].view(np.int64)), pa.array(np.full(len(first), size, np.int32)),
                        pa.array([t[0] for t in texts], pa.string()), pa.array([t[1] for t in texts], pa.string()),
                    ], names=["a", "b", "size", "lang", "phrase"])
        release_memory()

    rows = docs.mapInArrow(run, "a LONG, b LONG, size INT, lang STRING, phrase STRING").join(frequent.select("a", "b"), ["a", "b"], "left_semi")
    return rows.groupBy("a", "b").agg(*[F.first(c).alias(c) for c in ("size", "lang", "phrase")])


def expand_and_name(docs: DataFrame, larger: Proposal, before: Proposal, unnamed: Proposal, longest: int, block: int) -> DataFrame:
    """(a, b, size, lang, phrase, n): the phrases that ``larger`` adds to ``before``, as ``count_with_border`` counts them, and with n = 0 the unnamed ones.

    One scan for few missed phrases: each adds places beside its own alone, so all their
    phrases are counted by whole name, and written down once for each block.  ``unnamed``
    are phrases that were counted with ``before``, so they are looked for in its border alone.
    """

    def batch_of(words, size, a, b, n, at):
        texts = [words.text(i, size) for i in at.tolist()]
        return pa.RecordBatch.from_arrays([
            pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(np.full(len(at), size, np.int32)),
            pa.array([t[0] for t in texts], pa.string()), pa.array([t[1] for t in texts], pa.string()), pa.array(n),
        ], names=["a", "b", "size", "lang", "phrase", "n"])

    def run(batches):
        seen = np.zeros(0, U64)
        for batch in batches:
            for rows in text_blocks(batch, "text", block):
                words = PieceWords(rows.column("text"), rows.column("lang"))
                border, empty = _border(words, before, longest), words.places(0)
                for size, at, names in _added(words, border, before, larger):
                    a, b, n, first = _rows_of(names, words.other_half(size, at))
                    yield batch_of(words, size, a, b, n, at[first])
                for size, at, names in [(0, empty, words.name(0, empty)), *border]:
                    held = unnamed.holds(names)
                    at = at[held]
                    a, b, n, first = _rows_of(names[held], words.other_half(size, at))
                    both = a ^ (b << U64(1))
                    new = ~np.isin(both, seen)
                    seen = np.union1d(seen, both[new])
                    yield batch_of(words, size, a[new], b[new], 0 * n[new], at[first[new]])
        release_memory()

    found = docs.mapInArrow(run, "a LONG, b LONG, size INT, lang STRING, phrase STRING, n LONG")
    return found.groupBy("a", "b").agg(*[F.first(c).alias(c) for c in ("size", "lang", "phrase")], F.sum("n").alias("n"))


def _missed(found: DataFrame, proposal: Proposal) -> DataFrame:
    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(~proposal.holds(batch.column("a").to_numpy().view(U64))))

    return found.mapInArrow(run, found.schema)


def frequent_phrases(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", threshold: int = THRESHOLD, longest: int = LONGEST,
                     sampled: int = SAMPLED, bits: int = PROPOSAL_BITS, block: int = COUNT_BYTES, few: int = FEW_PLACES) -> tuple[DataFrame, int]:
    """((lang, phrase, size, n) of all phrases of up to ``longest`` words that occur ``threshold`` times, passes over the corpus).

    Words are ``[^\\x20\\x09]+`` of the pieces between ``[.,;:!?\\x0A-\\x0D]``, after lower-casing
    A-Z; a phrase is written with single spaces.  Size 0 is a language's empty phrase, with
    the number of all its words.  A null language is ``und``, a null or empty text has no words,
    repeated rows count each, and an empty table has no phrases.  The sample takes one in
    ``sampled`` documents by a hash of key and text, and all if that is 1; what it
    proposes decides the number of passes (one or two), not the result.  Phrases that it missed at
    no more than ``few`` places are expanded and named in one scan, others in several.
    """
    rows = docs.select(named(text).alias("text"), F.coalesce(named(lang).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.xxhash64(named(key), named(text)).alias("_h"))
    texts = rows.select("text", "lang")
    sample = written(rows.filter(F.pmod("_h", F.lit(sampled)) == 0).select("text", "lang"), "phrase-sample")
    share = threshold / sampled
    proposal = proposed(sample, max(1.0, share - DEVIATIONS * share**0.5) if sampled > 1 else threshold, longest, bits, block)
    counted = written(count_with_border(texts, proposal, None, threshold, longest, block), "phrase-counts")
    missed = _missed(counted, proposal)
    places = missed.agg(F.sum("n")).first()[0]
    closed = places is None
    # nearly all frequent phrases occur in the sample; the corpus is searched for the others alone, in the scan that expands if there is one
    names = written(name_phrases(sample, counted, longest, bits, block), "phrase-names")
    if not closed:
        larger, extra = proposal.copy(), Proposal(bits)
        extra.add(missed)
        larger.cells |= extra.cells
        if places <= few:
            unnamed = Proposal(bits)
            unnamed.add(counted.join(names, ["a", "b"], "left_anti"))
            found = written(expand_and_name(texts, larger, proposal, unnamed, longest, block), "phrase-expansion")
            more = found.filter(F.col("n") >= threshold).select("a", "b", "n")
            names = names.unionByName(found.drop("n").join(names, ["a", "b"], "left_anti"))
        else:
            more = written(count_with_border(texts, larger, proposal, threshold, longest, block), "phrase-counts")
        counted = counted.unionByName(more)
    rest = written(counted.join(names, ["a", "b"], "left_anti"), "phrases-unnamed")
    if not rest.isEmpty():
        names = names.unionByName(written(name_phrases(texts, rest, longest, bits, block), "phrase-names"))
    return written(counted.join(names, ["a", "b"]).select("lang", "phrase", "size", "n"), "phrases"), 1 if closed else 2


def cut_score(a: str, n: str, left: str, right: str) -> Column:
    """``floor(1000 a n / (left right))``, exactly: the products are decimals of 38 digits."""
    a, n, left, right = (F.col(c).cast("decimal(19,0)") for c in (a, n, left, right))
    return F.call_function("div", F.lit(1000) * (a * n), left * right)


def collocations(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", threshold: int = THRESHOLD, longest: int = LONGEST,
                 reported: int = REPORTED, sampled: int = SAMPLED, bits: int = PROPOSAL_BITS) -> DataFrame:
    """The ``reported`` phrases of each language that hold together best: (lang, rank, phrase, a, l, r, n, score).

    Candidates are the frequent phrases of two words or more (see ``frequent_phrases``).  Cutting one into
    a first part and the rest gives ``floor(1000 a n / (l r))``; the lowest of its cuts counts,
    of equal ones the first.  A candidate inside a longer one that is as frequent is
    dropped.  Equal scores go by ``a``, then by the phrase's bytes.
    """
    phrases, _ = frequent_phrases(docs, key, text, lang, threshold, longest, sampled, bits)
    words = F.split("phrase", " ")
    candidates = phrases.filter("size >= 2").withColumn("w", words)
    places = F.expr("flatten(transform(sequence(2, size - 1), m -> transform(sequence(1, size - m + 1), s -> array_join(slice(w, s, m), ' '))))")
    inner = candidates.filter("size > 2").select("lang", F.explode(F.array_distinct(places)).alias("phrase"), F.col("n").alias("_longer"))
    inner = inner.groupBy("lang", "phrase").agg(F.max("_longer").alias("_longer"))
    alone = candidates.join(inner, ["lang", "phrase"], "left").filter(F.col("_longer").isNull() | (F.col("_longer") < F.col("n")))
    cuts = alone.select("lang", "phrase", F.col("n").alias("a"), "w", "size", F.explode(F.expr("sequence(1, size - 1)")).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.expr("array_join(slice(w, 1, k), ' ')").alias("_first"), F.expr("array_join(slice(w, k + 1, size - k), ' ')").alias("_rest"))
    parts = broadcast_if_small(phrases)
    for part, count in (("_first", "l"), ("_rest", "r")):
        cuts = cuts.join(parts.select("lang", F.col("phrase").alias(part), F.col("n").alias(count)), ["lang", part])
    totals = broadcast_if_small(phrases.filter("size = 0").select("lang", "n"))
    scored = cuts.join(totals, "lang").withColumn("score", cut_score("a", "n", "l", "r"))
    best = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("_cut"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("_cut.score"), F.desc("a"), "phrase")).cast("long")
    ranked = best.withColumn("rank", rank).filter(F.col("rank") <= reported)
    return ranked.select("lang", "rank", "phrase", "a", "_cut.l", "_cut.r", "n", "_cut.score")
