import random

import numpy as np
import pyarrow as pa
import pytest

from mirrorframe.llm.frames import text_blocks
from mirrorframe.llm.texts import ALNUM_LOWER, SPACED, SPACED_LOWER, Words, windows
from tests.llm import brute

RNG = random.Random(4)
TEXTS = [None, "", " ", "a", "\n\t a b\x0b", "é ü\x00x", *["".join(RNG.choice("aB1 .\n\té漢\x7f_") for _ in range(RNG.randrange(40))) for _ in range(60)]]


@pytest.mark.parametrize("alphabet,split", [(SPACED, lambda t: brute.spaced_words(t)), (SPACED_LOWER, lambda t: brute.spaced_words(t, True)), (ALNUM_LOWER, brute.alnum_words)])
def test_words_and_hashes(alphabet, split):
    words = Words(pa.array(["skip", *TEXTS], pa.string()).slice(1), alphabet)
    by_hash = {}
    for r, text in enumerate(TEXTS):
        want = split(text)
        a, b = words.first[r : r + 2]
        got = [bytes(words.data[x:y]).decode() for x, y in zip(words.starts[a:b], words.ends[a:b], strict=True)]
        assert [g.translate(brute.UPPER) if alphabet is not SPACED else g for g in got] == want
        for w, h in zip(want, words.hashes[a:b].tolist(), strict=True):
            assert by_hash.setdefault(w, h) == h
    assert len(set(by_hash.values())) == len(by_hash)


def test_windows_tell_sequences_apart():
    h = np.array([1, 2, 3, 1, 2, 3, 9], np.uint64)
    w = windows(h, 3)
    assert w[0] == w[3] and len(set(w.tolist())) == 6


def test_blocks_hold_every_row_once():
    batch = pa.record_batch([pa.array(["x" * n if n else None for n in (0, 5, 100, 1, 0, 30)])], names=["text"])
    for limit in (1, 10, 1000):
        assert [t for b in text_blocks(batch, "text", limit) for t in b.column(0).to_pylist()] == batch.column(0).to_pylist()
