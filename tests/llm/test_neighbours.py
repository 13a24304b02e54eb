import numpy as np
from pyspark.sql import functions as F

from mirrorframe.llm import neighbours

SCHEMA = "vec_id LONG, embedding ARRAY<FLOAT>"


def brute(rows, queries, k=10):
    ids = np.array([i for i, _ in rows])
    x = np.array([np.float32(v) for _, v in rows], float)
    out = {}
    for q in queries:
        d = np.sqrt(((x - x[np.flatnonzero(ids == q)[0]]) ** 2).sum(axis=1))
        order = [i for i in np.lexsort((ids, d)) if ids[i] != q][:k]
        out[q] = [(int(ids[i]), float(d[i])) for i in order]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        assert r["rank"] == len(out.setdefault(r["query_id"], [])) + 1
        out[r["query_id"]].append((r["vec_id"], r["score"]))
    return out


def test_recall_against_brute_force(spark, small):
    vectors = spark.read.parquet(f"{small}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in vectors.collect()]
    got = found(neighbours.nearest(vectors, F.col("vec_id") % 25 == 0))
    want = brute(rows, [i for i, _ in rows if i % 25 == 0])
    assert set(got) == set(want)
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 10 for q in want]) >= 0.9


def test_clusters_are_found_in_few_parts(spark):
    rng = np.random.default_rng(0)
    centres = rng.standard_normal((16, 8)) * 10
    x = np.repeat(centres, 60, axis=0) + rng.standard_normal((960, 8))
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    got = found(neighbours.nearest(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 40 == 0, probes=2))
    want = brute(rows, range(0, 960, 40))
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 10 for q in want]) >= 0.9


def test_ties_repeats_and_unusable_vectors(spark):
    same = [(i, [1.0, 0.0]) for i in range(400, 0, -1)]
    odd = [(1000, None), (1001, []), (1002, [0.0, 0.0]), (1003, [1.0, None]), (1004, [float("nan"), 1.0]), (1005, [float("inf"), 1.0]), (1006, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (100, [1.0, 0.0])]
    df = spark.createDataFrame(same + odd, SCHEMA).withColumns({"part": F.lit("x"), "q": F.lit(1), "score": F.lit(2)})
    got = found(neighbours.nearest(df, F.col("vec_id") % 100 == 0))
    assert got == {q: [(i, 0.0) for i in range(1, 11)] for q in (100, 200, 300, 400)}


def test_few_rows(spark):
    three = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 2.0]), (2, [0.0, 1.0])], SCHEMA)
    assert found(neighbours.nearest(three, F.col("vec_id") == 0)) == {0: [(2, 2**0.5), (1, 2.0)]}
    assert neighbours.nearest(three.limit(1), F.col("vec_id") == 0).count() == 0
    assert neighbours.nearest(three.limit(0), F.col("vec_id") == 0).count() == 0
    assert neighbours.nearest(three, F.lit(None).cast("boolean")).count() == 0


def test_tiles_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "TILE_ROWS", 16)
    monkeypatch.setattr(neighbours, "TILE_QUERIES", 4)
    rng = np.random.default_rng(1)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(rng.standard_normal((200, 4)))]
    got = found(neighbours.nearest(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 10 == 0))
    want = brute(rows, range(0, 200, 10))
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}


def test_a_tiny_part_is_left_for_further_ones(spark, monkeypatch):
    router = neighbours.Router.__new__(neighbours.Router)
    router.mean, router.scale = np.zeros(2), np.ones(2)
    # part 0 where the first component is above 0.5, else part 1; the others hold nothing
    router.w = [np.array([[1.0], [0.0]]), np.zeros(1), np.array([[1.0, -1.0, 0, 0, 0, 0, 0, 0]]), np.array([0.0, 1.0, *[-9.0 + k for k in range(6)]])]
    monkeypatch.setattr(neighbours, "learn", lambda *a: (router, 1))
    rng = np.random.default_rng(4)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(rng.uniform(1, 2, (300, 2)))] + [(1000 + i, [-0.25, 1.0 + i / 8]) for i in range(3)] + [(1000, [-0.25, 5.0])]
    got = found(neighbours.nearest(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") >= 1001))
    want = brute(rows, [1001, 1002])
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}


def test_a_hot_vector_leaves_no_query_short(spark):
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((40, 8)) * 20
    x = np.concatenate([np.tile(centres[0], (400, 1)), np.repeat(centres[1:], 20, axis=0) + rng.standard_normal((780, 8))])
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    got = found(neighbours.nearest(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 3 == 0, probes=1))
    assert set(got) == set(range(0, len(rows), 3)) and {len(v) for v in got.values()} == {10}


def test_rows_of_one_id_and_distance_are_one(spark):
    rows = [(0, [1.0, 0.0])] + [(1, [1.0 + s, t]) for s, t in ((2, 0.0), (-2, 0.0), (0, 2.0), (0, -2.0))] * 3 + [(i, [1.0, float(i + 1)]) for i in range(2, 15)]
    got = found(neighbours.nearest(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") == 0))
    assert got == {0: [(1, 2.0), *[(i, float(i + 1)) for i in range(2, 11)]]}


def test_parts_reached():
    ranked = np.array([[0, 1, 2], [2, 1, 0], [1, 0, 2]])
    assert [r.tolist() for r in neighbours.reached(ranked, np.array([3, 0, 20]), 1, 4)] == [[0, 1, 2], [2], [1, 0, 2]]
    assert [r.tolist() for r in neighbours.reached(ranked, np.array([3, 0, 1]), 2, 11)] == [[0, 1, 2], [2, 1, 0], [1, 0, 2]]
