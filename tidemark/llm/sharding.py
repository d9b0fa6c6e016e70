"""A uniform shuffle into shards of exact size, by a hypergeometric communication matrix.

1. The rows are written once with the partition they came from and a random order inside it.
2. From the partitions' row counts the driver draws how many rows each partition sends to each shard: a
   multivariate hypergeometric draw per partition, so that every shard gets exactly its size and the result is
   distributed like a uniform permutation.  The matrix has partitions x shards numbers and no row data.
3. Every partition permutes its rows and deals them out by its row of the matrix.
4. Every shard is permuted again: rows fall into random bins of about ``bin_rows`` rows, are ordered at random
   inside their bin, and slots count on from bin to bin.  No task holds a whole shard.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import cut

BIN_ROWS = 250_000


def communication_matrix(rows: list[int], shards: int, seed: int) -> np.ndarray:
    """Rows sent from each partition to each shard; column sums differ by one at most, row sums are ``rows``."""
    rng = np.random.Generator(np.random.PCG64(seed))
    total = sum(rows)
    left = np.array([total // shards + (i < total % shards) for i in range(shards)], dtype=np.int64)
    rng.shuffle(left)                                        # which shards get the odd rows is random, too
    out = np.zeros((len(rows), shards), dtype=np.int64)
    for i, n in enumerate(rows):
        rest, todo = int(left.sum()), int(n)
        for j in range(shards):                              # one hypergeometric draw after another: any size
            mine = int(left[j])
            rest -= mine
            got = todo if rest == 0 else _hypergeometric(rng, mine, rest, todo)
            out[i, j], todo = got, todo - got
        left -= out[i]
    return out


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """Inversion at any size.  Weights relative to the mode follow from the ratios of neighbouring ones; 40 standard
    deviations to either side hold all that doubles can tell from zero, and their own sum is the norm."""
    low, high = max(0, n - bad), min(good, n)
    if low == high:
        return low
    total = good + bad
    mode = min(max((n + 1) * (good + 1) // (total + 2), low), high)
    reach = 40 * int(1 + math.sqrt(n * (good / total) * (bad / total) * ((total - n) / max(1, total - 1)))) + 40
    low, high = max(low, mode - reach), min(high, mode + reach)
    up = np.arange(mode, high, dtype=np.float64)               # the ratio of x + 1 to x
    down = np.arange(mode, low, -1, dtype=np.float64)          # and of x - 1 to x
    rise = np.cumprod((good - up) * (n - up) / ((up + 1) * (bad - n + up + 1)))
    fall = np.cumprod(down * (bad - n + down) / ((good - down + 1) * (n - down + 1)))
    sums = np.cumsum(np.concatenate([fall[::-1], [1.0], rise]))
    return low + int(np.searchsorted(sums, rng.random() * sums[-1], "right"))


def shuffle_shards(rows: DataFrame, shards: int = 24, seed: int = 42, bin_rows: int = BIN_ROWS) -> DataFrame:
    """``rows`` plus ``shard`` (0 to ``shards`` - 1) and ``slot`` (gapless from 0 in each shard).

    Shard sizes differ by one row at most, whatever the values: nulls, repeated rows and long texts are rows
    like any other, no column decides.  Columns named ``shard`` or ``slot`` are replaced.  An empty table gives
    no rows; with fewer rows than shards some shards are empty.  Project first: all columns are carried.
    """
    spark = rows.sparkSession
    rows = rows.drop("shard", "slot")
    placed = cut(rows.withColumn("_part", F.spark_partition_id()).withColumn("_id", F.monotonically_increasing_id()))
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).toArrow().sort_by("_part")
    parts, counts = sizes["_part"].to_pylist(), sizes["n"].to_pylist()
    ends = np.cumsum(communication_matrix(counts, shards, seed), axis=1)
    matrix = spark.createDataFrame(
        pa.table({"_part": pa.array(parts, pa.int32()), "_ends": pa.array(ends.tolist(), pa.list_(pa.int64()))}),
        "_part int, _ends array<bigint>")
    draw = lambda what: F.xxhash64(F.lit(seed), F.lit(what), "_id")
    local = Window.partitionBy("_part").orderBy(draw("deal"), "_id")
    dealt = placed.withColumn("_at", F.row_number().over(local)).join(matrix, "_part").withColumn(
        "shard", F.size(F.filter("_ends", lambda e: e < F.col("_at"))))
    bins = max(1, -(-sum(counts) // (shards * bin_rows)))
    dealt = cut(dealt.withColumn("_bin", F.pmod(draw("bin"), F.lit(bins)).cast("int")).drop("_ends", "_at", "_part"))
    filled = dealt.groupBy("shard", "_bin").agg(F.count(F.lit(1)).alias("_n"))
    before = filled.withColumn("_before", F.sum("_n").over(Window.partitionBy("shard").orderBy("_bin")) - F.col("_n")).drop("_n")
    inside = Window.partitionBy("shard", "_bin").orderBy(draw("slot"), "_id")
    return dealt.withColumn("_at", F.row_number().over(inside)).join(before, ["shard", "_bin"]).withColumn(
        "slot", (F.col("_before") + F.col("_at") - 1).cast("long")).drop("_bin", "_id", "_at", "_before")
