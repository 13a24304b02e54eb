import random
import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from mirrorframe.llm import bpe
from mirrorframe.llm.queries import token_digests
from tests.llm import brute

RNG = random.Random(6)
RANKS = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
WANTED = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
TEXTS = ["", " ", "the cat's  hat\n\n", "a" * 3000, "ab" * 500, "<|endoftext|>", "\x00\x1c\x85é漢字🎉", "   x",
         *["".join(chr(RNG.choice([RNG.randrange(32, 127), RNG.randrange(0x20, 0x2FFF)])) for _ in range(80)) for _ in range(150)],
         *["".join(RNG.choice("abcdehinorst") for _ in range(RNG.randrange(1, 60))) for _ in range(3000)]]


def test_ids_equal_the_library():
    encoder = bpe.Encoder(RANKS, public_tokenizers.PATTERN)
    assert encoder.encode(TEXTS).to_pylist() == [WANTED.encode_ordinary(t) for t in TEXTS]


def test_forgetting_words_changes_nothing():
    encoder = bpe.Encoder(RANKS, public_tokenizers.PATTERN, remembered=10)
    for t in TEXTS[:60]:
        assert encoder.encode([t]).to_pylist() == [WANTED.encode_ordinary(t)]


def test_a_pair_of_lower_rank_goes_first():
    ranks = {bytes([b]): b for b in range(256)} | {b"bc": 300, b"abc": 299, b"abcd": 260, b"cd": 301}
    encoding = tiktoken.Encoding("small", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
    words = ["".join(RNG.choice("abcd") for _ in range(n)) for n in range(1, 60)]
    assert bpe.replay([w.encode() for w in words], bpe.Merges(ranks)) == [encoding.encode_ordinary(w) for w in words]


def test_memory_beside_the_text_is_bounded():
    """What decoding and replaying need on the way is a few times the text, not tens of times."""
    text = " interesting" * 400_000
    encoder, decoder = bpe.Encoder(RANKS, public_tokenizers.PATTERN), bpe.Decoder(RANKS)
    coded = encoder.encode(pa.array([text]))
    words = [("%030x" % RNG.getrandbits(120)).encode() for _ in range(40_000)]
    tracemalloc.start()
    decoded = decoder.decode(coded)
    decoding = tracemalloc.get_traced_memory()[1]
    tracemalloc.reset_peak()
    ids, counts = bpe.replay_flat(words, encoder.merges)
    replaying = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert decoded[0].as_py() == text.encode()
    assert len(ids) == counts.sum() and len(counts) == len(words)
    assert decoding < 10 * len(text), decoding / len(text)
    assert replaying < 60 * sum(map(len, words)), replaying / sum(map(len, words))


def test_spans_longer_than_a_step_are_joined():
    values = np.arange(10, dtype=np.int32)
    sizes = np.array([3, 0, 10, 1] * (bpe.AT_ONCE // 2))
    starts = np.array([2, 9, 0, 7] * (bpe.AT_ONCE // 2))
    got = bpe.join_spans(values, starts, sizes)
    assert got.tolist() == [2, 3, 4, *range(10), 7] * (bpe.AT_ONCE // 2)
    assert bpe.join_spans(values, starts[:0], sizes[:0]).tolist() == []


def test_round_trip_on_rows(spark):
    rows = [(1, None, "x"), (2, "", "y"), (3, "héllo wörld", "z"), (3, "héllo wörld", "z"), (4, "word " * 20000, None)]
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING, n_tokens STRING").repartition(2)
    got = token_digests(docs, keep_ids=True)
    assert got.columns == ["doc_id", "text", "token_ids", "n_tokens", "ids_sha256", "decoded_sha256"]
    for r in got.collect():
        ids = WANTED.encode_ordinary(r["text"] or "")
        assert r["token_ids"] == ids and r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == brute.sha(" ".join(map(str, ids))) and r["decoded_sha256"] == brute.sha(r["text"] or "")
    assert token_digests(docs.limit(0)).count() == 0


def test_decode_rejects_unknown_ids(spark):
    lists = spark.createDataFrame([(1, None), (2, []), (3, [50_300])], "doc_id LONG, token_ids ARRAY<INT>")
    assert [bytes(r["decoded"]) for r in bpe.decode(lists.filter("doc_id < 3"), RANKS).collect()] == [b"", b""]
    with pytest.raises(Exception, match="not in the vocabulary"):
        bpe.decode(lists, RANKS).collect()
