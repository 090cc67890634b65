"""Run-length encoded relations: tables of runs (start_vid, length, values), and relational operators on the runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a chunk that one task orders when it encodes.
CHUNK = 1 << 16
#: Ids that one array holds when a run is cut into ids or buckets.
BLOCK = 1 << 16


def _numbers(runs: DataFrame, low: Column, high: Column, name: str) -> DataFrame:
    """A row for each number from low to high. Long stretches go block by block, and blocks are dealt to tasks: a generated
    stage holds all that one of its input rows explodes to, so no row may explode to more than a block."""
    parts = int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = runs.withColumns({"_low": low.cast("long"), "_high": high.cast("long")})
    short = own.where(F.col("_high") - F.col("_low") < BLOCK).withColumn(name, F.explode(F.sequence("_low", "_high")))
    long = own.where(F.col("_high") - F.col("_low") >= BLOCK)
    for to, size in (("_outer", BLOCK * BLOCK), ("_block", BLOCK)):
        a, b = F.floor(F.col("_low") / size), F.floor(F.col("_high") / size)
        if to == "_block":
            a, b = F.greatest(a, F.col("_outer") * BLOCK), F.least(b, F.col("_outer") * BLOCK + (BLOCK - 1))
        long = long.withColumn(to, F.explode(F.sequence(a, b))).repartition(parts, "_low", to)
    first = F.col("_block") * BLOCK
    long = long.withColumn(name, F.explode(F.sequence(F.greatest(F.col("_low"), first), F.least(F.col("_high"), first + (BLOCK - 1))))).drop("_outer", "_block")
    return short.unionByName(long).drop("_low", "_high")


def _same(columns: Sequence[str], order: Window) -> Column:
    same = F.lit(True)
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.lag(c).over(order))
    return same


def encode(df: DataFrame, vid: str, values: Sequence[str], chunk: int = CHUNK) -> DataFrame:
    """Runs of equal values over consecutive ids. Ids are unique; a gap ends a run. Chunks of ids are encoded in parallel;
    only the first and last run of each chunk are then compared across chunks."""
    rows = df.select(F.col(vid).cast("long").alias("_vid"), *values, F.floor(F.col(vid) / chunk).cast("long").alias("_chunk"))
    order = Window.partitionBy("_chunk").orderBy("_vid")
    change = ~(_same(values, order) & (F.col("_vid") == F.lag("_vid").over(order) + 1))
    rows = rows.withColumn("_new", F.coalesce(change, F.lit(True)).cast("long"))
    rows = rows.withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = rows.groupBy("_chunk", "_run").agg(F.min("_vid").alias("start_vid"), F.count("*").alias("length"), *[F.first(c).alias(c) for c in values])
    number = Window.partitionBy("_chunk")
    runs = runs.withColumn("_last", F.max("_run").over(number))
    inner = runs.where("_run > 1 AND _run < _last").select("start_vid", "length", *values)
    edges = runs.where("_run = 1 OR _run = _last")
    along = Window.orderBy("start_vid")  # two rows a chunk
    joined = _same(values, along) & (F.col("start_vid") == F.lag("start_vid").over(along) + F.lag("length").over(along))
    edges = edges.withColumn("_new", (~F.coalesce(joined, F.lit(False))).cast("long")).withColumn("_group", F.sum("_new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    edges = edges.groupBy("_group").agg(F.min("start_vid").alias("start_vid"), F.sum("length").alias("length"), *[F.first(c).alias(c) for c in values])
    return inner.unionByName(edges.drop("_group"))


def values_of(runs: DataFrame) -> list[str]:
    return [c for c in runs.columns if c not in ("start_vid", "length")]


def decode(runs: DataFrame, vid: str = "vid") -> DataFrame:
    """One row for each id of each run, whatever its length."""
    out = _numbers(runs.where("length > 0"), F.col("start_vid"), F.col("start_vid") + F.col("length") - 1, "_vid")
    return out.select(F.col("_vid").alias(vid), *values_of(runs))


def filter_runs(runs: DataFrame, condition: Column | str) -> DataFrame:
    """Whole runs by their values; ids stay."""
    return runs.where(condition)


def project_runs(runs: DataFrame, *exprs: Column | str) -> DataFrame:
    """Other values for the same runs; equal neighbours are not merged."""
    return runs.select("start_vid", "length", *exprs)


def reconstruct(left: DataFrame, right: DataFrame, width: int | None = None) -> DataFrame:
    """Runs of both sides' values over the ids that both have. Ids are cut into buckets, runs meet by bucket, and a pair
    counts in the bucket where its overlap begins. Without a width, it is the longer mean length of the two sides, with
    which neither side grows to more than twice its runs, plus one row a run. That width is a column of the same plan (an
    aggregate of a row), so no side is run beforehand; where a side is read more than once, Spark reuses its exchange."""
    last = F.col("start_vid") + F.col("length") - 1
    if width is None:
        means = left.select("length", F.lit(0).alias("_side")).unionByName(right.select("length", F.lit(1).alias("_side")))
        found = means.groupBy("_side").agg(F.avg("length").alias("m")).agg(F.greatest(F.lit(1), F.round(F.max("m"))).cast("long").alias("_width"))
        left, right, wide = left.crossJoin(F.broadcast(found)), right.crossJoin(F.broadcast(found)), F.col("_width")  # one row
    else:
        wide = F.lit(width).cast("long")

    def bucketed(df: DataFrame, side: str) -> DataFrame:
        own = df.where("length > 0").withColumn("_w", wide)
        cut = _numbers(own, F.floor(F.col("start_vid") / F.col("_w")), F.floor(last / F.col("_w")), "_bucket")
        return cut.select(F.col("start_vid").alias(f"_{side}_s"), last.alias(f"_{side}_e"), F.col("_w").alias(f"_{side}_w"), *[c for c in values_of(df) if c != "_width"], "_bucket")

    both = bucketed(left, "l").join(bucketed(right, "r"), "_bucket")
    start, end = F.greatest("_l_s", "_r_s"), F.least("_l_e", "_r_e")
    met = both.where((start <= end) & (F.floor(start / F.col("_l_w")) == F.col("_bucket")))
    return met.select(start.alias("start_vid"), (end - start + 1).alias("length"), *[c for x in (left, right) for c in values_of(x) if c != "_width"])


def weighted(function: str, column: str | None = None) -> Column:
    """An aggregate over decoded rows, from runs: count, sum, avg, min or max."""
    n = F.col("length")
    if function == "count":
        return F.coalesce(F.sum(n if column is None else F.when(F.col(column).isNotNull(), n).otherwise(0)), F.lit(0).cast("long"))
    if function in ("min", "max"):
        return getattr(F, function)(column)
    total = F.sum(F.col(column) * n)
    if function == "sum":
        return total
    if function == "avg":
        return F.try_divide(total, F.sum(F.when(F.col(column).isNotNull(), n)))
    raise ValueError(f"no weighted {function}")


def aggregate_runs(runs: DataFrame, keys: Sequence[str], aggs: Sequence[Column]) -> DataFrame:
    """Aggregates of weighted() by key, each row a run of length 1 with ids from 0 in the order of the keys."""
    out = runs.groupBy(*keys).agg(*aggs) if keys else runs.agg(*aggs)
    out = numbered(out.withColumn("length", F.lit(1).cast("long")), [F.col(k).asc_nulls_last() for k in keys] or [F.lit(0)])
    return out.select("start_vid", "length", *[c for c in out.columns if c not in ("start_vid", "length")])


def numbered(runs: DataFrame, order: Sequence[Column]) -> DataFrame:
    """start_vid as a running sum of length in an order. Rows are dealt to ranges of the order, each is summed on its own,
    and only the ranges' totals (a row each) are summed together. The ranges are held, so that both sums see the same."""
    dealt = runs.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()).persist(StorageLevel.MEMORY_AND_DISK)
    until = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = dealt.withColumn("_own", F.coalesce(F.sum("length").over(until), F.lit(0).cast("long")))
    along = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy("_part").agg(F.sum("length").alias("_sum")).select("_part", F.coalesce(F.sum("_sum").over(along), F.lit(0).cast("long")).alias("_before"))
    return own.join(F.broadcast(totals), "_part").withColumn("start_vid", F.col("_before") + F.col("_own")).drop("_part", "_own", "_before")


def join_runs(left: DataFrame, right: DataFrame, keys: Sequence[tuple[str, str]], chunk: int = CHUNK) -> DataFrame:
    """Inner equi-join of runs: lengths multiply. Ids are dense from 0 in the order of (left id, right id): summed within
    chunks of left ids in parallel, the chunks' sums summed over the (few) chunks."""
    l = left.select(F.col("start_vid").alias("_l"), F.col("length").alias("_ln"), *values_of(left))
    r = right.select(F.col("start_vid").alias("_r"), F.col("length").alias("_rn"), *values_of(right))
    condition = None
    for a, b in keys:
        condition = (l[a] == r[b]) if condition is None else condition & (l[a] == r[b])
    both = l.join(r, condition).withColumn("length", F.col("_ln") * F.col("_rn")).withColumn("_chunk", F.floor(F.col("_l") / chunk))
    sums = both.groupBy("_chunk").agg(F.sum("length").alias("_sum"))
    before = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))).select("_chunk", "_before")
    own = Window.partitionBy("_chunk").orderBy("_l", "_r").rowsBetween(Window.unboundedPreceding, -1)
    out = both.withColumn("_own", F.coalesce(F.sum("length").over(own), F.lit(0).cast("long"))).join(before, "_chunk")
    return out.select((F.col("_before") + F.col("_own")).alias("start_vid"), "length", *values_of(left), *values_of(right))
