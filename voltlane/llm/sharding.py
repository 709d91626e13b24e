"""A uniform random shuffle into shards of exact sizes, by a hypergeometric communication matrix.

How many rows of each stored partition go to each shard is drawn first, from the law that a uniform shuffle would give:
row by row a multivariate hypergeometric draw from what is left of each shard. Then each partition is permuted and cut by
its row of the matrix, the parts are exchanged, and each shard is permuted again. No row is looked at to decide this, and
sizes are exact. The second permutation is a range sort by a random key, so one shard spreads over many tasks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.rows import global_rank
from ..operators.storage import materialize

SHARDS = 16


#: Up to so many rows numpy's own draws are used, which refuse more.
DRAWN = 10**9 - 1
#: Standard deviations on both sides that a larger draw looks at; beyond lies less than one part in 10**30.
REACH = 12


def communication_matrix(rows: list[int], shards: int, seed: int, drawn: int = DRAWN) -> np.ndarray:
    """Rows of each partition for each shard; row sums are ``rows``, column sums differ by one at most. Exact draws at any
    size: while more than ``drawn`` rows are left, the partitions are halved and the places of each shard dealt between the
    halves, so that large draws are few."""
    rng = np.random.Generator(np.random.PCG64(seed))
    total = sum(rows)
    out = np.zeros((len(rows), shards), dtype=np.int64)
    open_ = [(0, len(rows), np.array([total // shards + (s < total % shards) for s in range(shards)], dtype=np.int64))]
    while open_:
        lo, hi, left = open_.pop()
        if hi - lo > 1 and int(left.sum()) > drawn:
            mid = (lo + hi) // 2
            first = _deal(rng, left, sum(rows[lo:mid]), drawn)
            open_ += [(mid, hi, left - first), (lo, mid, first)]
            continue
        for p in range(lo, hi):
            out[p] = left if p == hi - 1 else _deal(rng, left, rows[p], drawn)
            left = left - out[p]
    return out


def _deal(rng: np.random.Generator, left: np.ndarray, n: int, drawn: int) -> np.ndarray:
    """How many of ``n`` rows get places of each shard: shard by shard, its places against those of the later ones."""
    out = np.zeros_like(left)
    after = int(left.sum())
    for s, places in enumerate(left.tolist()):
        after -= places
        out[s] = n if after == 0 else _hypergeometric(rng, places, after, n, drawn)
        n -= int(out[s])
    return out


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, sample: int, drawn: int = DRAWN) -> int:
    """One draw from the hypergeometric law. Beyond ``drawn`` by inversion: the ratios of neighbouring probabilities are
    simple, so the probabilities around the mode follow from it by sums of logarithms; no factorial is needed, and the
    error is that of the sums, about one part in 10**10."""
    if good + bad <= drawn:
        return int(rng.hypergeometric(good, bad, sample))
    n = good + bad
    least, most = max(0, sample - bad), min(good, sample)
    mode = min(max((sample + 1) * (good + 1) // (n + 2), least), most)
    reach = int(REACH * (sample * (good / n) * (bad / n) * ((n - sample) / (n - 1))) ** 0.5) + 30
    lo, hi = max(least, mode - reach), min(most, mode + reach)
    x = np.arange(lo, hi, dtype=np.float64)
    up = np.log(((good - x) / (x + 1)) * ((sample - x) / (bad - sample + x + 1)))
    at = mode - lo
    logs = np.concatenate([-np.cumsum(up[:at][::-1])[::-1], [0.0], np.cumsum(up[at:])])
    sums = np.cumsum(np.exp(logs))
    return lo + int(np.searchsorted(sums, rng.random() * sums[-1], side="right"))


def shard_rows(docs: DataFrame, columns: list[str], shards: int = SHARDS, seed: int = 11) -> DataFrame:
    """``columns`` of every row of ``docs`` with ``shard`` and ``slot`` (gapless from 0 in its shard).

    Every assignment of rows to (shard, slot) with shard sizes at most one apart is equally likely, over seeds. Nulls,
    ties and repeated rows make no difference: rows are told apart by their stored place. An empty table gives none.
    Columns that are not named may be called anything. The rows are stored before they are counted; the driver sees one
    number per stored partition."""
    own = docs.select(F.struct(*columns).alias("_row"), F.monotonically_increasing_id().alias("_rid"))
    base = materialize(own).withColumn("_part", F.shiftright("_rid", 33))
    counts = sorted((r["_part"], r["n"]) for r in base.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect())
    rows = [n for _, n in counts]
    matrix = communication_matrix(rows, shards, seed)
    bounds = docs.sparkSession.createDataFrame(
        [(p, [int(x) for x in np.cumsum(m)]) for (p, _), m in zip(counts, matrix, strict=True)], "_part bigint, _bounds array<bigint>")
    local = F.row_number().over(Window.partitionBy("_part").orderBy(F.xxhash64("_rid", F.lit(seed)), "_rid"))
    placed = (base.withColumn("_n", local.cast("bigint")).join(bounds, "_part")
              .withColumn("shard", F.size(F.filter("_bounds", lambda b: b < F.col("_n")))))
    total = sum(rows)
    each, more = total // shards, total % shards
    ranked = global_rank(placed.select("_row", "_rid", "shard"),
                         [F.col("shard"), F.xxhash64("_rid", F.lit(seed + 1)), F.col("_rid")], "_rank")
    before = F.col("shard") * F.lit(each).cast("bigint") + F.least(F.col("shard"), F.lit(more))
    return ranked.select("_row.*", "shard", (F.col("_rank") - 1 - before).cast("bigint").alias("slot"))
