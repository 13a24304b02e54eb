"""Benchmark decontamination with suffix arrays over the training texts.

Every task sorts the suffixes of its training words (one start for each word) and
binary-searches every suffix of the test items in them.  That gives each test
suffix's longest verbatim match with its places, and all places of each window of
test words; the documents that hold a window are then marked or removed.

Test items go to the tasks in parts of bounded size, so neither a part nor a shard
grows with its table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mirrorframe.llm.frames import append_columns, set_aside
from mirrorframe.llm.texts import ALNUM_LOWER, Words

WINDOW = 10
#: Test words in one broadcast part (about 40 bytes each); a longer item is a part of its own.
PART_WORDS = 1_000_000

MATCH = T.StructType([T.StructField(n, t) for n, t in (("item_id", T.StringType()), ("item_word", T.LongType()), ("doc_word", T.LongType()), ("n_words", T.LongType()))])


class TestPart:
    """Some test items: the suffixes of their words and the window that starts at each.

    Words are numbered by the part's own vocabulary, from 1; 0 ends an item.
    """

    __test__ = False

    def __init__(self, ids: list[str], texts: list[str], window: int):
        words = Words(pa.array(texts, pa.string()), ALNUM_LOWER)
        self.ids = ids
        self.vocabulary, number = np.unique(words.hashes, return_inverse=True)
        spelled = dict(zip(words.hashes.tolist(), zip(words.starts.tolist(), words.ends.tolist(), strict=True), strict=True))
        lowered = bytes(words.data).lower()
        self.spelling = [lowered[slice(*spelled[h])] for h in self.vocabulary.tolist()]
        counts = words.counts
        item, left = words.rows(), words.left()
        gaps = item  # one end mark after each item
        self.at = np.arange(len(item)) + gaps
        self.numbers = np.zeros(len(item) + len(ids) + 1, np.int32)
        self.numbers[self.at] = number + 1
        self.item, self.left = item, left
        self.word = np.arange(len(item)) - words.first[:-1][item]
        size = np.minimum(counts[item], window)
        self.window = np.where(left >= size, size, 0)  # 0: too near the item's end to start a window
        self.shortest = int(counts[counts > 0].min(initial=window))
        pairs = (self.numbers[self.at].astype(np.int64) << 32) | self.numbers[self.at + 1]
        self.pairs = np.unique(pairs)


def _compare(train, places, test, at, depth):
    """Sign of train suffix minus test suffix over ``depth`` words, and the words they share."""
    shared = np.zeros(len(places), np.int64)
    sign = np.zeros(len(places), np.int8)
    live = np.flatnonzero(depth > 0)
    k = 0
    while len(live):
        a, b = train[places[live] + k], test[at[live] + k]
        same = a == b
        sign[live[~same]] = np.where(a < b, -1, 1)[~same]
        live = live[same]
        k += 1
        shared[live] = k
        live = live[depth[live] > k]
    return sign, shared


def _search(train, suffixes, test, at, depth, right):
    """First place in the suffix array whose suffix is above (``right``) or not below each test suffix."""
    low, high = np.zeros(len(at), np.int64), np.full(len(at), len(suffixes), np.int64)
    live = np.flatnonzero(low < high)
    while len(live):
        middle = (low[live] + high[live]) // 2
        sign, _ = _compare(train, suffixes[middle], test, at[live], depth[live])
        below = sign <= 0 if right else sign < 0
        low[live[below]] = middle[below] + 1
        high[live[~below]] = middle[~below]
        live = live[low[live] < high[live]]
    return low


def suffix_array(train: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """The starts in the order of the words from there on, exact to ``depth`` words; several words make one sort key."""
    bits = max(1, int(train.max(initial=0)).bit_length())
    step, keys = max(1, 62 // bits), []
    for k in range(0, depth, step):
        key = np.zeros(len(starts), np.int64)
        for j in range(k, min(k + step, depth)):
            key = (key << bits) | train[np.minimum(starts + j, len(train) - 1)]
        keys.append(key)
    return starts[np.lexsort(keys[::-1])]


def _find(words: Words, part: TestPart):
    """Hits (first word, words, item) of windows in the block, and the longest match of each test suffix."""
    place = np.searchsorted(part.vocabulary, words.hashes)
    place[place == len(part.vocabulary)] = 0
    known = part.vocabulary[place] == words.hashes if len(part.vocabulary) else np.zeros(len(words.hashes), bool)
    row = words.rows()
    at = np.arange(len(row)) + row
    train = np.zeros(len(row) + len(words.first) + 1, np.int32)
    train[at] = np.where(known, place + 1, 0)
    # suffixes that share no window's first words with any item can't hold a window
    if part.shortest == 1:
        keep = known
    else:
        pair = (train[at].astype(np.int64) << 32) | train[at + 1]
        slot = np.searchsorted(part.pairs, pair)
        slot[slot == len(part.pairs)] = 0
        keep = (part.pairs[slot] == pair) & known
    suffixes = suffix_array(train, at[keep], int(part.window.max()))
    wanted = np.flatnonzero(part.window > 0)
    where, size = part.at[wanted], part.window[wanted]
    low = _search(train, suffixes, part.numbers, where, size, False)
    high = _search(train, suffixes, part.numbers, where, size, True)
    found = low < high
    wanted, low, high, size = wanted[found], low[found], high[found], size[found]
    many = high - low
    source = np.repeat(wanted, many)
    inside = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)
    mark = suffixes[inside]
    _, shared = _compare(train, mark, part.numbers, part.at[source], part.left[source])
    return np.searchsorted(at, mark), np.repeat(size, many), source, shared


def _verified(words: Words, part: TestPart, first, size, source):
    """Which hits spell the same words, byte by byte; equal hashes alone are not taken as proof."""
    spelled: dict[int, bool] = {}
    good = np.ones(len(first), bool)
    data = words.data
    for k in range(int(size.max(initial=0))):
        live = np.flatnonzero(size > k)
        w, v = first[live] + k, part.numbers[part.at[source[live]] + k] - 1
        for x, y in set(zip(w.tolist(), v.tolist(), strict=True)):
            if x not in spelled:
                spelled[x] = bytes(data[words.starts[x] : words.ends[x]]).lower() == part.spelling[y]
        good[live] &= np.fromiter((spelled[x] for x in w.tolist()), bool, len(live))
    return good


FIELDS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("hit_spans", T.ArrayType(T.ArrayType(T.LongType()))),
    T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("matches", T.ArrayType(MATCH)),
]


def _union(spans):
    """Overlapping or touching (start, end) spans become one."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def _parts(benchmark: DataFrame, item: str, text: str, window: int, part_words: int):
    """Bounded parts of the test items, one after the other; items without words are left out."""
    rows = benchmark.select(F.col(item).cast("string").alias("i"), F.col(text).cast("string").alias("t")).filter("t is not null")
    ids, texts, size = [], [], 0
    for r in rows.toLocalIterator():
        n = len(r["t"]) // 2 + 1
        if texts and size + n > part_words:
            yield TestPart(ids, texts, window)
            ids, texts, size = [], [], 0
        ids.append(r["i"])
        texts.append(r["t"])
        size += n
    if texts:
        yield TestPart(ids, texts, window)


def find_matches(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, part_words: int = PART_WORDS) -> DataFrame:
    """Add to every row the places it shares with the test items.

    Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z.  An
    item's windows are its runs of ``window`` words; a shorter item with any word is
    one window.  Adds ``n_words``; ``hit_spans``, the maximal runs [first word, end)
    of words in some occurrence of a window; ``items``, the distinct non-null ids (as
    text, sorted) with an occurring window; ``matches``, for each run and item the
    longest verbatim match that covers a window there (ties: the first in the item).
    Columns of these names are replaced.  A null or wordless text has no words, spans,
    items or matches; so has every text when there are no items.  Items with equal
    texts are all reported; rows with equal keys are judged one by one.
    """
    spark = docs.sparkSession
    parts = [spark.sparkContext.broadcast(p) for p in _parts(benchmark, item, item_text, window, part_words)]
    if not parts:
        parts = [spark.sparkContext.broadcast(None)]

    def make():
        def work(block: pa.RecordBatch):
            words = Words(block.column(text), ALNUM_LOWER)
            row, start, n = words.rows(), words.first[:-1], block.num_rows
            spans, items, matches = [[] for _ in range(n)], [set() for _ in range(n)], [[] for _ in range(n)]
            for handle in parts:
                part = handle.value
                if part is None or not len(words.hashes) or not len(part.item):
                    continue
                hits = _find(words, part)
                good = _verified(words, part, *hits[:3])
                first, size, source, shared = (x[good] for x in hits)
                order = np.lexsort((source, first))
                reach: dict = {}  # of the match on each (row, item, diagonal): its windows follow one another
                for f, s, t, m in zip(first[order].tolist(), size[order].tolist(), source[order].tolist(), shared[order].tolist(), strict=True):
                    r, k, word = int(row[f]), int(part.item[t]), int(part.word[t])
                    f -= int(start[r])
                    spans[r].append((f, f + s))
                    if f < reach.get((r, k, f - word), 0):
                        continue
                    reach[r, k, f - word] = f + m
                    matches[r].append({"item_id": part.ids[k], "item_word": word, "doc_word": f, "n_words": m})
                    if part.ids[k] is not None:
                        items[r].add(part.ids[k])
            return [words.counts.tolist(), [_union(x) for x in spans], [sorted(x) for x in items], matches]

        return work

    return append_columns(docs, FIELDS, text, make)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, as they are, that hold no window of any test item."""
    plain, restore = set_aside(docs, text)
    return restore(find_matches(plain, benchmark, text, **options).filter(F.size("hit_spans") == 0))
