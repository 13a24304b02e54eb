"""Language ID by multilingual mixture inference.

Each learned language is a distribution over letter trigrams.  A document's
trigrams are taken as drawn from a mixture of languages; expectation-maximisation
finds the proportions.  A document starts with its one likeliest language and takes
up another only while that raises the log-likelihood by more than a penalty that
grows with its length, so the set of languages is chosen by penalised likelihood.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mirrorframe.llm.frames import append_columns, release_memory, set_aside, text_blocks
from mirrorframe.llm.texts import buffers

#: Cells that hashed trigrams of bytes fall into: the size of a learned language.
CELLS = 1 << 15
#: Counts added to every cell; EM steps for a pair of languages and at the end; gain in log-likelihood asked for each log of the trigrams.
SMOOTHING, STEPS, PENALTY = 0.5, 12, 4.0
#: Bytes of text whose mixtures are inferred together.
INFERRED_BYTES = 1 << 19
#: More than the rounding of the stored log-probabilities.
ROUNDING = 1e-3
#: Labels whose counts the driver may hold, 256 KB for each.
MOST_LABELS = 256
UNKNOWN = "und"


def _letters() -> np.ndarray:
    """Bytes as they count in trigrams: lower-case ASCII letters, bytes of non-ASCII characters, 0 for all others."""
    table = np.zeros(256, np.uint32)
    table[97:123] = np.arange(97, 123)
    table[65:91] = np.arange(97, 123)
    table[128:] = np.arange(128, 256)
    return table


_TABLE = _letters()


def trigrams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Cells of all trigrams that touch a letter, and the row of each.  Breaks between words are one byte of their own."""
    data, offsets = buffers(column)
    rows = len(column)
    # each text between two breaks, and a run of breaks is one
    value = np.zeros(len(data) + rows + 1, np.uint32)
    row = np.repeat(np.arange(rows), np.diff(offsets))
    value[np.arange(len(data)) + row + 1] = _TABLE[data]
    owner = np.repeat(np.arange(rows), np.diff(offsets) + 1)
    owner = np.concatenate([[0], owner]) if rows else np.zeros(1, np.int64)
    keep = (value > 0) | np.concatenate([[True], value[:-1] > 0])
    value, owner = value[keep], owner[keep]
    a, b, c = value[:-2], value[1:-1], value[2:]
    good = b > 0
    h = ((a * np.uint32(0x9E3779B1)) ^ (b * np.uint32(0x85EBCA6B)) ^ (c * np.uint32(0xC2B2AE35))) * np.uint32(0x27D4EB2F)
    return (h >> np.uint32(17))[good].astype(np.int64), owner[1:-1][good]


def learn(docs: DataFrame, labelled: Column, text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray]:
    """Learned languages (sorted) and the log-probability of each cell in each of them; see ``count_cells``."""
    return model_of(*count_cells(docs, labelled, text, lang))


def model_of(names: list[str], counts: np.ndarray) -> tuple[list[str], np.ndarray]:
    smooth = counts + SMOOTHING
    return names, np.log(smooth / smooth.sum(axis=1, keepdims=True)).astype(np.float32)


def count_cells(docs: DataFrame, labelled: Column, text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages (sorted) and how often each cell stands in the texts of each.

    Counts all labelled rows with a non-null label; a label none of whose texts has a
    letter is not learned.  The result has ``CELLS`` numbers for each label, whatever the
    rows; more than ``MOST_LABELS`` labels are an error.
    """
    rows = docs.filter(labelled & F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))

    def count(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for block in text_blocks(batch, "text"):
                cell, row = trigrams(block.column("text"))
                names, code = np.unique(np.array(block.column("lang").to_pylist(), object).astype(str), return_inverse=True)
                found = np.bincount(code[row] * CELLS + cell, minlength=len(names) * CELLS).reshape(len(names), CELLS)
                for name, n in zip(names.tolist(), found, strict=True):
                    total[name] = total[name] + n if name in total else n
        for name, n in total.items():
            at = np.flatnonzero(n)
            yield pa.record_batch([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], names=["lang", "cell", "n"])
        release_memory()

    counts = rows.mapInArrow(count, "lang STRING, cell INT, n LONG").groupBy("lang", "cell").agg(F.sum("n").alias("n"))
    labels = counts.select("lang").distinct().limit(MOST_LABELS + 1).count()
    if labels > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} labels")
    table: dict[str, np.ndarray] = {}
    for lang_, cell, n in counts.select("lang", "cell", "n").toLocalIterator():
        table.setdefault(lang_, np.zeros(CELLS))[cell] = n
    names = sorted(table)
    return names, np.array([table[n] for n in names]).reshape(len(names), CELLS)


def least_likelihoods(counts: np.ndarray) -> np.ndarray:
    """For each language the mean log-likelihood of a trigram below which it doesn't explain a text.

    Halfway between what a training trigram has when it is left out itself and what one has that never
    occurs.  With few training rows the two are close, and hardly a text is turned down.
    """
    total = counts.sum(axis=1) + SMOOTHING * counts.shape[1]
    left_out = np.log(np.maximum(counts - 1, 0) + SMOOTHING) - np.log(total - 1)[:, None]
    usual = (counts * left_out).sum(axis=1) / np.maximum(counts.sum(axis=1), 1)
    return 0.5 * (usual + np.log(SMOOTHING / total)) - ROUNDING


def likelihood(cell: np.ndarray, row: np.ndarray, share: np.ndarray, log_p: np.ndarray) -> np.ndarray:
    """Mean log-likelihood of the trigrams of each row under its mixture; -inf for rows without any."""
    p = (np.exp(log_p[:, cell].T.astype(np.float64)) * share[row]).sum(axis=1)
    n = np.bincount(row, minlength=len(share))
    total = np.bincount(row, np.log(np.maximum(p, 1e-300)), minlength=len(share))
    return np.where(n > 0, total / np.maximum(n, 1), -np.inf)


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of each run of values; runs may be empty."""
    total = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0, dtype=np.float64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def _em(p: np.ndarray, n: np.ndarray, bounds: np.ndarray, share: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions after some EM steps and their log-likelihood; ``p``: likelihoods (cell, language), ``n``: how often each cell stands."""
    counts = np.diff(bounds)
    size = np.maximum(_sums(n, bounds), 1e-12)[:, None]
    for _ in range(steps):
        joint = np.repeat(share, counts, axis=0) * p
        share = _sums(joint * (n / np.maximum(joint.sum(axis=1), 1e-300))[:, None], bounds) / size
    mixed = (np.repeat(share, counts, axis=0) * p).sum(axis=1)
    return share, _sums(n * np.log(np.maximum(mixed, 1e-300)), bounds)


def infer(cell: np.ndarray, row: np.ndarray, rows: int, log_p: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """Proportions of each language in each row (rows x languages); rows without trigrams are all 0."""
    langs = len(log_p)
    share = np.zeros((rows, langs))
    if not langs or not len(cell):
        return share
    key, n = np.unique(row * CELLS + cell, return_counts=True)
    row, cell = key // CELLS, key % CELLS
    bounds = np.searchsorted(row, np.arange(rows + 1))
    logs = log_p[:, cell].T.astype(np.float64)
    p = np.exp(logs - logs.max(axis=1, keepdims=True))  # each cell's likelihoods on a scale of its own: no share depends on it
    alone = _sums(n[:, None] * np.log(np.maximum(p, 1e-300)), bounds)
    best = alone.argmax(axis=1)
    chosen = np.zeros((rows, langs), bool)
    filled = np.diff(bounds) > 0
    chosen[np.flatnonzero(filled), best[filled]] = True
    fit = alone[np.arange(rows), best]
    cost = penalty * np.log(np.maximum(_sums(n, bounds), 2))
    open_rows = np.flatnonzero(filled)
    while len(open_rows) and langs > 1:
        # the best further language of each open row
        at = np.concatenate([np.arange(bounds[r], bounds[r + 1]) for r in open_rows])
        inner = np.concatenate([[0], np.cumsum(np.diff(bounds)[open_rows])])
        gain, pick = np.full(len(open_rows), -np.inf), np.zeros(len(open_rows), int)
        for k in range(langs):
            tried = chosen[open_rows].copy()
            free = ~tried[:, k]
            tried[:, k] = True
            start = tried / tried.sum(axis=1, keepdims=True)
            _, found = _em(p[at], n[at], inner, start, STEPS)
            better = free & (found - fit[open_rows] > gain)
            gain[better], pick[better] = (found - fit[open_rows])[better], k
        grown = gain > cost[open_rows]
        fit[open_rows[grown]] += gain[grown]
        chosen[open_rows[grown], pick[grown]] = True
        open_rows = open_rows[grown & (chosen[open_rows].sum(axis=1) < langs)]
    share[filled] = chosen[filled] / chosen[filled].sum(axis=1, keepdims=True)
    mixed = np.flatnonzero(chosen.sum(axis=1) > 1)
    if len(mixed):
        at = np.concatenate([np.arange(bounds[r], bounds[r + 1]) for r in mixed])
        inner = np.concatenate([[0], np.cumsum(np.diff(bounds)[mixed])])
        share[mixed] = _em(p[at], n[at], inner, share[mixed], 2 * STEPS)[0]
    return share


FIELDS = [
    T.StructField("lang_pred", T.StringType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("lang_mix", T.MapType(T.StringType(), T.DoubleType())),
]


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text", penalty: float = PENALTY) -> DataFrame:
    """Add the chief language of every text, its share, and the shares of all languages in the text.

    ``und`` with score 0 and no shares: null texts, texts without a letter, and all
    texts when nothing was learned.  Ties go to the language first in order.  A text
    whose letters are all new gets its likeliest language all the same.  Columns of
    these names are replaced; no other column than the text is looked at.
    """
    import regex

    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make() -> Callable:
        names, log_p = shared.value
        letter = regex.compile(r"\p{L}").search

        def work(block: pa.RecordBatch):
            column = block.column(text)
            share = infer(*trigrams(column), block.num_rows, log_p, penalty)
            langs, scores, mixes = [], [], []
            for t, s in zip(column.to_pylist(), share, strict=True):
                known = bool(names) and s.any() and letter(t) is not None
                k = int(s.argmax()) if known else 0
                langs.append(names[k] if known else UNKNOWN)
                scores.append(min(1.0, float(s[k])) if known else 0.0)
                mixes.append([(names[j], float(s[j])) for j in np.flatnonzero(s)] if known else [])
            return [langs, scores, mixes]

        return work

    return append_columns(docs, FIELDS, text, make, INFERRED_BYTES)


def held_out(key: str = "doc_id") -> Column:
    """One in five rows by the checksum of the key's text: never learned from.  A null key counts as ''."""
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))), F.lit(5)) == 0


def with_letters(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows, as they are, whose text has a letter, as ``predict`` looks for it."""
    import regex

    def make() -> Callable:
        letter = regex.compile(r"\p{L}").search
        return lambda block: [[t is not None and letter(t) is not None for t in block.column(text).to_pylist()]]

    plain, restore = set_aside(docs, text)
    return restore(append_columns(plain, [T.StructField("lettered", T.BooleanType())], text, make).filter("lettered"))


def keep_explained(docs: DataFrame, names: list[str], counts: np.ndarray, text: str = "text") -> DataFrame:
    """The rows, as they are, whose text the learned languages explain (``names`` and ``counts`` from ``count_cells``).

    A text stays when it has a letter and the mean log-likelihood of its trigrams, under the
    mixture inferred for it, reaches the bound of its languages (``least_likelihoods``, by their
    shares).  So a text that several languages share stays; keyboard noise, encoded
    bytes and scripts that were never learned go.  When nothing was learned no text
    can be told apart, and all with a letter stay.
    """
    import regex

    if not names:
        return with_letters(docs, text)
    shared = docs.sparkSession.sparkContext.broadcast((model_of(names, counts)[1], least_likelihoods(counts)))

    def make() -> Callable:
        log_p, least = shared.value
        letter = regex.compile(r"\p{L}").search

        def work(block: pa.RecordBatch):
            column = block.column(text)
            cell, row = trigrams(column)
            share = infer(cell, row, block.num_rows, log_p)
            fits = likelihood(cell, row, share, log_p) >= share @ least
            return [[bool(ok) and t is not None and letter(t) is not None for t, ok in zip(column.to_pylist(), fits, strict=True)]]

        return work

    plain, restore = set_aside(docs, text)
    return restore(append_columns(plain, [T.StructField("explained", T.BooleanType())], text, make, INFERRED_BYTES).filter("explained"))
