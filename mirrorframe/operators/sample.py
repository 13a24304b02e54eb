"""Exact seeded samples, contiguous batches, within-row shuffles and categorical draws."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mirrorframe.functions import draws, ranges
from mirrorframe.functions.orderstats import order_statistics
from mirrorframe.functions.ranges import ROWS_PER_RANGE, with_position
from mirrorframe.functions.vectors import let

BUCKET_BITS = 12
HASH_BITS = 53
BOUNDARY_ROWS = 20_000
FEW_BATCHES = 64


@dataclass(frozen=True)
class SampleCut:
    """Membership rule of an exact sample: the pairs (hash, key) up to a fixed one."""

    seed: int
    key: str
    n: int
    k: int
    last_hash: int | None
    last_key: object

    def condition(self, df: DataFrame) -> Column:
        """Whether a row of ``df`` belongs to the sample."""
        if self.k == 0:
            return F.lit(False)
        if self.k == self.n:
            return F.lit(True)
        h = draws.hash_bits(self.seed, draws.row_key(df, self.key))
        tie = (h == F.lit(self.last_hash)) & (F.col(self.key) <= F.lit(self.last_key))
        return (h < F.lit(self.last_hash)) | tie


def sample_cut(df: DataFrame, key: str, frac: float | None = None, k: int | None = None, seed: int = 200,
               boundary_rows: int = BOUNDARY_ROWS) -> SampleCut:
    """Find the (hash, key) pair of the k-th smallest hash; ``key`` must be unique.

    Each round counts rows per 4096 hash ranges of the current interval (a
    map-side aggregate, no row is shuffled) and keeps the range in which the
    k-th row lies, until that range holds few enough rows to order directly.
    """
    hashed = df.select(F.col(key).alias("k"), draws.hash_bits(seed, draws.row_key(df, key)).alias("h"))
    low, shift, before, n = 0, HASH_BITS, 0, None
    while True:
        # The current interval is [low, low + 2**shift).
        inside = hashed if n is None else hashed.where((F.col("h") >= low) & (F.col("h") < low + 2**shift))
        step = max(0, shift - BUCKET_BITS)
        table = inside.groupBy(F.shiftright(F.col("h") - F.lit(low), step).alias("b")).count().collect()
        table = sorted((r["b"], r["count"]) for r in table)
        if n is None:
            n = sum(c for _, c in table)
            if k is None:
                k = round(frac * n)  # half-even
            if not 0 <= k <= n:
                raise ValueError(f"cannot draw {k} of {n} rows")
            if k in (0, n):
                return SampleCut(seed, key, n, k, None, None)
        for bucket, count in table:
            if before + count >= k:
                break
            before += count
        low, shift = low + (bucket << step), step
        if count <= boundary_rows or shift == 0:
            break
    inside = hashed.where((F.col("h") >= low) & (F.col("h") < low + 2**shift))
    last = inside.orderBy("h", "k").limit(k - before).agg(F.max(F.struct("h", "k")).alias("m")).head()["m"]
    return SampleCut(seed, key, n, k, last["h"], last["k"])


def sample_exact(df: DataFrame, frac: float, key: str, seed: int = 200) -> DataFrame:
    """Exactly ``round(frac * n)`` rows (half-even) without replacement."""
    return df.where(sample_cut(df, key, frac=frac, seed=seed).condition(df))


def train_holdout_split(df: DataFrame, frac: float, key: str, seed: int = 200, out: str = "is_train") -> DataFrame:
    """All rows, flagged with membership in the exact sample; one scan gives both parts."""
    return df.withColumn(out, sample_cut(df, key, frac=frac, seed=seed).condition(df))


def assign_batches(df: DataFrame, key: str, batch_size: int | None = None, batch_frac: float | None = None,
                   out: str = "batch_id") -> DataFrame:
    """Number contiguous blocks of rows in key order; the last block may be short.

    ``key`` must be a unique number.  A few large batches need only the exact key at each
    block border (no row moves).  Many small batches use global positions.
    """
    n = df.count()
    if batch_size is None:
        batch_size = int(batch_frac * n)
    if batch_size < 1:
        raise ValueError("batch size must be at least 1")
    n_batches = -(-n // batch_size)
    if n_batches > FEW_BATCHES:
        placed = with_position(df, key)
        return placed.withColumn(out, F.floor(F.col("position") / batch_size).cast("long")).drop("position")
    batch = F.lit(0).cast("long")
    if n_batches > 1:
        firsts = [b * batch_size for b in range(1, n_batches)]
        cuts = order_statistics(df.select(key), {key: firsts}, {key: n})[key]
        for r in firsts:
            batch = batch + (F.col(key) >= F.lit(cuts[r])).cast("long")
    return df.withColumn(out, batch)


def neighbour_pairs(df: DataFrame, key: str, values: list[str], rows_per_range: int = ROWS_PER_RANGE,
                    keys: DataFrame | None = None) -> DataFrame:
    """Rows taken two by two in the order of a unique numeric key: ``(a, b)`` structs of the value columns.

    Range borders are moved by one row where needed so that no pair crosses one;
    then a single shuffle by range is enough.  A last odd row is paired with the
    row before it, which is then in two pairs; a single row has no pair.
    ``keys`` is a cheaper table with the same keys, if there is one, for finding
    the borders.
    """
    keys = df if keys is None else keys
    edges = ranges.range_edges(keys, key, rows_per_range)
    if edges:
        table = keys.groupBy(ranges.range_of(key, edges).alias("r")).agg(F.count("*").alias("n"), F.min(key).alias("first")).collect()
        table = sorted((row["r"], row["n"], row["first"]) for row in table)
        moved, before = [], 0
        for (r, n, _), (_, _, first) in zip(table, table[1:], strict=False):
            before += n
            moved.append(first if before % 2 else edges[r])
        edges = sorted(set(moved))
    local = Window.partitionBy("_range").orderBy(key)
    row = df.select(key, ranges.range_of(key, edges).alias("_range"), F.struct(*values).alias("a"))
    row = row.select("a", F.lead("a").over(local).alias("b"), F.lag("a").over(local).alias("_before"), F.row_number().over(local).alias("_n"))
    odd = (F.col("_n") % 2 == 1) & F.coalesce("b", "_before").isNotNull()
    return row.where(odd).select(F.when(F.col("b").isNotNull(), F.col("a")).otherwise(F.col("_before")).alias("a"), F.coalesce("b", "a").alias("b"))


def shuffle_within_row(df: DataFrame, x: str, key: str, seed: int) -> DataFrame:
    """Permute the values of each row independently of the other rows."""
    row = draws.row_key(df, key)
    tagged = F.transform(x, lambda v, i: F.struct(draws.hash_bits(seed, row, i.cast("long")).alias("h"), i.alias("i"), v.alias("v")))
    return df.withColumn(x, F.transform(F.array_sort(tagged), lambda s: s["v"]))


def soft_probs(df: DataFrame, logits: str, key: str, tau: float, seed: int, chunk_list: list[int] | None = None,
               out: str = "probs", eps: float = 1e-20) -> DataFrame:
    """``softmax((logits + g) / tau)`` with Gumbel noise ``g``, per chunk of the logits."""
    def softmax(c):
        # the largest exponent is 0, so the sum is at least 1
        powers = let(F.array_max(c), lambda top: F.transform(c, lambda v: F.exp(v - top)))
        return let(powers, lambda e: let(_total(e), lambda t: F.transform(e, lambda v: v / t)))

    return df.withColumn(out, _per_chunk(_noisy(logits, draws.row_key(df, key), tau, seed, eps), chunk_list, softmax))


def gumbel_onehot(df: DataFrame, logits: str, key: str, tau: float, seed: int, chunk_list: list[int] | None = None,
                  out: str = "onehot", eps: float = 1e-20) -> DataFrame:
    """Hard one-hot at the largest noisy logit of each chunk (the first one on a tie)."""
    def harden(c):
        return let(F.array_position(c, F.array_max(c)), lambda best: F.transform(c, lambda _, i: (i + 1 == best).cast("double")))

    return df.withColumn(out, _per_chunk(_noisy(logits, draws.row_key(df, key), tau, seed, eps), chunk_list, harden))


def _total(array: Column) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda a, v: a + v)


def _noisy(logits, row, tau, seed, eps):
    def noise(i):
        return draws.gumbel(draws.uniform(seed, row, i.cast("long")), eps)

    return F.transform(logits, lambda v, i: (v.cast("double") + noise(i)) / F.lit(float(tau)))


def _per_chunk(values: Column, chunk_list: list[int] | None, fn) -> Column:
    """``fn`` applied to consecutive slices of an array, put together again."""
    if chunk_list is None:
        return let(values, fn)
    starts = [1 + sum(chunk_list[:k]) for k in range(len(chunk_list))]
    wrong = F.raise_error(F.lit(f"expected {sum(chunk_list)} logits")).cast("array<double>")

    def split(y):
        parts = [let(F.slice(y, a, length), fn) for a, length in zip(starts, chunk_list, strict=True)]
        return F.when(F.size(y) == sum(chunk_list), F.concat(*parts)).otherwise(wrong)

    return let(values, split)
