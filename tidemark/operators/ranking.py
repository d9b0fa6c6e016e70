"""Top-N per group, latest per key and exact quantiles, written so that one hot group cannot fill a task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import cut

#: up to this N Spark itself cuts each map task to N rows per group before the shuffle
_MAP_SIDE_LIMIT = 1000
_SALTS = 1024
PARTS = 64
_BINS_PER_E, _BIN_OFFSET = 1024, 800_000
_SUB_BINS = 1 << 16


def salt(column: str) -> Column:
    """The part of a hot key that a row belongs to."""
    return F.pmod(F.xxhash64(column), F.lit(PARTS))


def salted_lookup(rows: DataFrame, key: str, spread_by: str, table: DataFrame) -> DataFrame:
    """Inner join of ``rows`` with ``table`` (unique ``key``); a key that most rows share is spread over tasks.

    The table is first joined to the parts of each key that occur, so nothing is copied that is not asked for.
    """
    salted = rows.withColumn("_salt", salt(spread_by))
    asked = salted.select(key, "_salt").distinct().join(table, key)
    return salted.join(asked, [key, "_salt"]).drop("_salt")


def top_n(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str | None = None) -> DataFrame:
    """First ``n`` rows of each group; ``rank`` keeps the row number under that name.

    ``row_number() <= n`` is cut per map task before the shuffle for small ``n``.  For a larger ``n``
    a first pass over salted groups does the same, so the final task of a group sees at most
    ``_SALTS * n`` rows however large the group is.
    """
    name = rank or "_rn"
    if n > _MAP_SIDE_LIMIT:
        # any salt gives the same result; the partition id spreads identical rows too
        salted = df.withColumn("_salt", F.pmod(F.xxhash64(F.spark_partition_id(), *df.columns), F.lit(_SALTS)))
        first = Window.partitionBy(*keys, "_salt").orderBy(*order)
        df = salted.withColumn(name, F.row_number().over(first)).where(F.col(name) <= n).drop(name, "_salt")
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    kept = ranked.where(F.col(name) <= n)
    return kept if rank else kept.drop(name)


def latest_per_key(df: DataFrame, keys: list[str], newest_first: list[Column]) -> DataFrame:
    """One row per key: the first in ``newest_first`` order (give a total order for a stable result)."""
    return top_n(df, keys, newest_first, 1)


def _value_bin(v: Column) -> Column:
    """Order-preserving integer bin of a finite double, about 0.1 % of the value wide."""
    magnitude = F.floor(F.ln(F.abs(v)) * _BINS_PER_E) + _BIN_OFFSET
    return F.when(v == 0, F.lit(0).cast("long")).when(v > 0, magnitude).otherwise(-magnitude)


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Linear-interpolation quantiles per group as columns named by ``probs``; only finite values count.

    The built-in exact percentile keeps every distinct value of a group in one buffer.  Here a first pass
    counts rows per (group, value bin), which combines on the map side, and finds the bins that hold the
    wanted ranks.  A second pass keeps only rows of those bins.  Since a column may lie in one bin as a whole
    (years, epoch seconds), each wanted bin is cut again into ``_SUB_BINS`` equal parts between its least and
    largest value, and only the values of the parts that hold a wanted rank are put in order.  The wanted bins are
    written, so that their size decides the join.

    The input is read twice: cut it first if it is costly to compute.
    """
    number = F.col(value).cast("double")
    finite = df.where(number.isNotNull() & ~F.isnan(number) & (F.abs(number) != float("inf"))).select(
        *keys, number.alias("_v")).withColumn("_bin", _value_bin(F.col("_v")))
    by_group = Window.partitionBy(*keys)
    bins = (
        finite.groupBy(*keys, "_bin").agg(F.count(F.lit(1)).alias("_in"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        .select(*keys, "_bin", "_in", "_lo", "_hi", F.sum("_in").over(by_group.orderBy("_bin")).alias("_end"),
                F.sum("_in").over(by_group).alias("_total")))
    ranks = [f"{edge}((_total - 1) * {float(p)!r}D)" for p in probs.values() for edge in ("floor", "ceil")]
    wanted = " OR ".join(f"(_end - _in <= {r} AND {r} < _end)" for r in dict.fromkeys(ranks))
    targets = cut(bins.where(wanted).select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_bin").alias("_b"),
        (F.col("_end") - F.col("_in")).alias("_before"), "_total", "_lo", "_hi"))

    def matched(*pairs: tuple[str, str]) -> Column:
        same = F.lit(True)
        for ours, theirs in (*pairs, *[(k, f"_k{i}") for i, k in enumerate(keys)]):
            same = same & F.col(ours).eqNullSafe(F.col(theirs))
        return same

    part = F.least(F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * _SUB_BINS), F.lit(_SUB_BINS - 1))
    counted = finite.join(targets, matched(("_bin", "_b"))).withColumn(
        "_sub", F.when(F.col("_hi") > F.col("_lo"), part).otherwise(0).cast("int")).groupBy(
        *keys, "_bin", "_before", "_total", "_sub", "_v").agg(F.count(F.lit(1)).alias("_n"))
    parts = (
        counted.groupBy(*keys, "_bin", "_before", "_total", "_sub").agg(F.sum("_n").alias("_in"))
        .withColumn("_end", F.col("_before") + F.sum("_in").over(Window.partitionBy(*keys, "_bin").orderBy("_sub")))
        .where(wanted).select(
            *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_bin").alias("_b"), F.col("_sub").alias("_s"),
            (F.col("_end") - F.col("_in")).alias("_start")))
    running = Window.partitionBy(*keys, "_bin", "_sub").orderBy("_v")
    placed = counted.join(parts, matched(("_bin", "_b"), ("_sub", "_s"))).withColumn(
        "_stop", F.col("_start") + F.sum("_n").over(running))
    picks, out = [], []
    for name, p in probs.items():
        at = f"((_total - 1) * {float(p)!r}D)"
        for tag, edge in (("lo", "floor"), ("hi", "ceil")):
            rank = f"{edge}{at}"
            picks.append(F.expr(f"max(CASE WHEN _stop - _n <= {rank} AND {rank} < _stop THEN _v END)").alias(f"_{tag}_{name}"))
        out.append(F.expr(f"`_lo_{name}` + (`_hi_{name}` - `_lo_{name}`) * ({at} - floor{at})").alias(name))
    return placed.groupBy(*keys).agg(F.max("_total").alias("_total"), *picks).select(*keys, *out)


def modal_value(df: DataFrame, keys: list[str], value: str, out: str, count: str | None = None) -> DataFrame:
    """Most frequent non-null value per group, smallest on ties."""
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    best = top_n(counted, keys, [F.col("_n").desc(), F.col(value).asc()], 1)
    return best.select(*keys, F.col(value).alias(out), *([F.col("_n").alias(count)] if count else []))
