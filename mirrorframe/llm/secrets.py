"""Secret scans: fixed patterns, and a battery of randomness tests for what they miss.

A long run of characters that some encoding could have made is tested twice.  It
must look random: letter counts (chi-squared against a uniform alphabet), runs
above and below the middle of the alphabet, and the correlation of neighbours are
each plausible for a random string.  And it must not look like ordinary text: the
same three statistics have p-values under the corpus's own letters and pairs of
letters, joined by Fisher's method.  Among all candidates of a class of lengths the
Benjamini-Hochberg step then holds the share of ordinary strings reported.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mirrorframe.llm.frames import append_columns, set_aside, text_blocks
from mirrorframe.llm.texts import buffers

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
# a greedy run of at least so many characters: what is left of all runs when the shorter ones are dropped
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
#: What joins a key to its neighbours in paths and names, and the pieces between; the last one keeps its padding.
SEPARATOR, PIECE = re.compile(r"[+/_-]"), re.compile(r"[A-Za-z0-9]{20,}(?:=+\Z)?")
KINDS = ("assign", "access", "hex", "random")
#: Alphabets in the order in which they are tried; an inferred encoding is the first that holds all characters.
ENCODINGS = {
    "hex": "0123456789abcdef",
    "HEX": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base62": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
}
#: Least chance, under randomness, of each statistic of a reported string; share of ordinary strings tolerated among the reported.
PLAUSIBLE, FALSE_SHARE = 1e-4, 0.05
#: Classes of length (at least so many characters), and the fine steps of -log10 p in which p-values are counted.
LENGTHS, STEP, TOP = (20, 32, 48, 64, 128), 0.05, 600
SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
_DIGIT, _LETTER = re.compile(r"[0-9]"), re.compile(r"[A-Za-z]")


def encoding_of(text: str) -> str | None:
    """The encoding that could have made a candidate; None for digits alone or letters alone of one case."""
    body = text.rstrip("=")
    if not _DIGIT.search(body) or not _LETTER.search(body):
        if body.isdigit() or body.lower() == body or body.upper() == body:
            return None
    for name, alphabet in ENCODINGS.items():
        if set(body) <= set(alphabet):
            return name
    return None


def _normal_below(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2))


def _two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


class Ordinary:
    """How ordinary text looks in one alphabet, from the corpus's counts of pairs of neighbouring bytes.

    Every pair has one count more than seen, so an empty corpus looks uniform and nothing stands out.
    """

    def __init__(self, alphabet: str, pairs: np.ndarray):
        places = np.frombuffer(alphabet.encode(), np.uint8)
        self.size = n = len(places)
        b = pairs[np.ix_(places, places)].astype(float) + 1.0
        b /= b.sum()
        q = pairs[places].sum(axis=1).astype(float) + 1.0
        q /= q.sum()
        self.square, self.cube = float((q**2).sum()), float((q**3).sum())
        high = np.arange(n) >= n / 2
        self.change = float(b[high][:, ~high].sum() + b[~high][:, high].sum())
        left, right, v = b.sum(axis=1), b.sum(axis=0), np.arange(n)
        ml, mr = left @ v, right @ v
        self.serial = float((v @ b @ v - ml * mr) / math.sqrt(max(1e-12, (left @ v**2 - ml**2) * (right @ v**2 - mr**2))))


class Battery:
    """The three tests of one string, under randomness and under ordinary text."""

    def __init__(self, pairs: np.ndarray):
        self.ordinary = {k: Ordinary(a, pairs) for k, a in ENCODINGS.items()}
        self.index = {k: {c: i for i, c in enumerate(a)} for k, a in ENCODINGS.items()}

    @staticmethod
    def _pairs_equal(n, square, cube):
        """Mean and deviation of the number of equal ordered pairs among n draws."""
        mean = n * (n - 1) * square
        var = 2 * n * (n - 1) * (square - square**2) + 4 * n * (n - 1) * (n - 2) * max(0.0, cube - square**2)
        return mean, math.sqrt(max(var, 1e-9))

    def test(self, text: str, encoding: str) -> tuple[float, float]:
        """(least p under randomness, joint p under ordinary text)."""
        own, model = self.index[encoding], self.ordinary[encoding]
        v = np.array([own[c] for c in text.rstrip("=")])
        n, size = len(v), model.size
        counts = np.bincount(v, minlength=size)
        # chi-squared against uniform cells is this number times size / n, and a constant
        equal = float((counts * (counts - 1)).sum())
        changes = int((np.diff((v >= size / 2).astype(int)) != 0).sum())
        centred = v - v.mean()
        serial = float((centred[1:] * centred[:-1]).sum() / max(1e-9, (centred**2).sum()))

        mean, sd = self._pairs_equal(n, 1 / size, 1 / size**2)
        z_runs = (changes - (n - 1) / 2) / math.sqrt((n - 1) / 4)
        z_serial = (serial + 1 / n) * math.sqrt(n)
        random = min(1 - _normal_below((equal - mean) / sd) if equal > mean else 1.0, _two_sided(z_runs), _two_sided(z_serial))

        mean, sd = self._pairs_equal(n, model.square, model.cube)
        c, r = model.change, model.serial
        p = [
            _normal_below((equal - mean) / sd),
            _normal_below((changes - (n - 1) * c) / math.sqrt((n - 1) * c * (1 - c)) * (-1 if c < 0.5 else 1)),
            _normal_below((serial + 1 / n - r) * math.sqrt(n) * (1 if r > 0 else -1)),
        ]
        x = -sum(math.log(max(q, 1e-300)) for q in p)
        return random, math.exp(-x) * (1 + x + x * x / 2)  # Fisher: chi-squared with 6 degrees of freedom


def _step_of(p: float) -> int:
    """The p-value rounded up to a step: one that is counted as larger than it is can't add a report."""
    return min(TOP, int(-math.log10(max(p, 1e-300)) / STEP))


def _class_of(n: int) -> int:
    return max(k for k, least in enumerate(LENGTHS) if n >= least)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Leftmost non-overlapping matches of each fixed kind, as (start, kind's place, end) in code points."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    return found + [(m.start(), 2, m.end()) for m in HEX.finditer(text)]


def candidates(text: str, base: list[tuple[int, int, int]]):
    """Runs that an encoding could have made and that no base span holds: (start, end, string, encoding, place of the run).

    A run is one candidate if some alphabet holds it.  Where it has separators, each of its
    pieces of 20 characters or more is another: a key may stand in a path or behind a name.
    """
    for place, m in enumerate(CANDIDATE.finditer(text)):
        found = [(m.start(), m.end())]
        if SEPARATOR.search(m[0]):
            found += [(m.start() + x.start(), m.start() + x.end()) for x in PIECE.finditer(m[0])]
        for a, b in found:
            encoding = encoding_of(text[a:b])
            if encoding and not any(x <= a and b <= y for x, _, y in base):
                yield a, b, text[a:b], encoding, place


def letter_pairs(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Counts of neighbouring ASCII bytes over all texts (128 x 128, whatever the data)."""

    def count(batches):
        total = np.zeros(1 << 14, np.int64)
        for batch in batches:
            for block in text_blocks(batch, text):
                data, offsets = buffers(block.column(0))
                if len(data) > 1:
                    ascii_pair = (data[:-1] < 128) & (data[1:] < 128)
                    border = offsets[1:-1]
                    ascii_pair[border[(border > 0) & (border < len(data))] - 1] = False  # two texts, not two neighbours
                    total += np.bincount((data[:-1].astype(np.int64) << 7 | data[1:])[ascii_pair], minlength=1 << 14)
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["pair", "n"])

    rows = docs.select(text).mapInArrow(count, "pair INT, n LONG").groupBy("pair").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(1 << 14, np.int64)
    for r in rows:
        out[r["pair"]] = r["n"]
    return out.reshape(128, 128)


def cuts(docs: DataFrame, pairs: np.ndarray, text: str = "text", false_share: float = FALSE_SHARE) -> list[float]:
    """For each class of lengths, the least step of -log10 p that the Benjamini-Hochberg rule reports."""
    shared = docs.sparkSession.sparkContext.broadcast(pairs)

    def count(batches):
        battery = Battery(shared.value)
        total = np.zeros((len(LENGTHS), TOP + 1), np.int64)
        for batch in batches:
            for t in batch.column(0).to_pylist():
                if t:
                    for _, _, s, encoding, _ in candidates(t, base_spans(t)):
                        total[_class_of(len(s)), _step_of(battery.test(s, encoding)[1])] += 1
        c, k = np.nonzero(total)
        yield pa.record_batch([pa.array(c, pa.int32()), pa.array(k, pa.int32()), pa.array(total[c, k], pa.int64())], names=["c", "k", "n"])

    rows = docs.select(text).mapInArrow(count, "c INT, k INT, n LONG").groupBy("c", "k").agg(F.sum("n").alias("n")).collect()
    total = np.zeros((len(LENGTHS), TOP + 1), np.int64)
    for r in rows:
        total[r["c"], r["k"]] = r["n"]
    out = []
    for counts in total:
        reported = counts[::-1].cumsum()[::-1]
        least = 10.0 ** (-STEP * np.arange(TOP + 1))
        good = np.flatnonzero((reported > 0) & (least * counts.sum() <= false_share * np.maximum(reported, 1)))
        out.append(float(good[0]) if len(good) else math.inf)
    return out


def find_secrets(docs: DataFrame, text: str = "text", out: str = "secrets", false_share: float = FALSE_SHARE) -> DataFrame:
    """Add the spans of secrets, ordered by start and then as the kinds are listed: array of (kind, start, end), in code points.

    The base kinds are ``assign``, ``access`` and ``hex``; ``random`` are the spans
    that the battery adds outside of them.  Null and empty texts have none; a column
    of the name ``out`` is replaced; repeated rows are scanned one by one and count
    each in the corpus's statistics, which don't depend on how the table is split.  Three passes over the texts, and no shuffle but of counts.
    """
    pairs = letter_pairs(docs, text)
    shared = docs.sparkSession.sparkContext.broadcast((pairs, cuts(docs, pairs, text, false_share)))

    def make():
        table, least = shared.value
        battery = Battery(table)

        def scan(t):
            found = base_spans(t)
            added, whole = [], -1
            for a, b, s, encoding, place in candidates(t, found):
                if place == whole:
                    continue  # a piece of a run that is reported
                random, ordinary = battery.test(s, encoding)
                if random >= PLAUSIBLE and _step_of(ordinary) >= least[_class_of(len(s))]:
                    added.append((a, 3, b))
                    whole = place if SEPARATOR.search(s) else -1
            return [{"kind": KINDS[k], "start": a, "end": b} for a, k, b in sorted(found + added)]

        return lambda block: [[scan(t) if t else [] for t in block.column(text).to_pylist()]]

    return append_columns(docs, [T.StructField(out, T.ArrayType(SPAN))], text, make)


def mask(text: str, spans: list[tuple[int, int]], instead: str) -> str:
    """The text with each run of overlapping spans replaced once."""
    pieces, at = [], 0
    for a, b in sorted(spans):
        if a >= at or not pieces:
            pieces += [text[at:a], instead]
        at = max(at, b)
    return "".join(pieces) + text[at:]


def redact(docs: DataFrame, text: str = "text", instead: str = "[SECRET]", length: str | None = None, false_share: float = FALSE_SHARE) -> DataFrame:
    """All rows and columns, with every found span of the text replaced; null texts stay null.

    A column named by ``length`` gets the number of characters of the texts that changed.
    """
    plain, restore = set_aside(docs, text)
    found = find_secrets(plain, text, "_spans", false_share)

    def make():
        def work(block):
            spans = block.column("_spans").to_pylist()
            return [[mask(t, [(s["start"], s["end"]) for s in x], instead) if x else t for t, x in zip(block.column(text).to_pylist(), spans, strict=True)]]

        return work

    masked = append_columns(found, [T.StructField(text, T.StringType())], text, make)
    if length is None:
        return restore(masked)
    return restore(masked, **{length: lambda old: F.when(F.size("_spans") > 0, F.length(text)).otherwise(old).cast(docs.schema[length].dataType)})
