"""Labels, ranks, intervals and unique names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import cut


def make_unique(names: DataFrame, sep: str = ".") -> DataFrame:
    """(id, name) with repeated names told apart by ``sep`` and a number, skipping names in use.

    Later rows (by id) of a name get 1, 2, ... as suffix.  A suffixed name that
    exists already moves to the next free number, round by round.
    """
    w = Window.partitionBy("name").orderBy("id")
    rows = names.select("id", "name").withColumn("n", F.row_number().over(w) - 1)
    taken = names.select(F.col("name").alias("new")).distinct()
    # Candidate numbers of a name: as many as it needs beyond those that are in use.
    need = rows.groupBy("name").agg(F.max("n").alias("need")).filter("need > 0")
    used = taken.select("new", F.regexp_extract("new", r"^(.*)" + "\\" + sep + r"([1-9][0-9]{0,8})$", 1).alias("name"), F.regexp_extract("new", "\\" + sep + r"([1-9][0-9]{0,8})$", 1).alias("k")).filter("k <> ''").select("name", F.col("k").cast("long").alias("k"))
    extra = used.groupBy("name").agg(F.count("*").alias("extra"))
    room = need.join(extra, "name", "left").select("name", F.explode(F.sequence(F.lit(1).cast("long"), F.col("need") + F.coalesce("extra", F.lit(0)))).alias("k"))
    free = room.join(used, ["name", "k"], "left_anti").withColumn("n", F.row_number().over(Window.partitionBy("name").orderBy("k")))
    out = rows.join(free, ["name", "n"], "left")
    return out.select("id", F.when(F.col("n") == 0, F.col("name")).otherwise(F.concat("name", F.lit(sep), F.col("k").cast("string"))).alias("name"))


def running(rows: DataFrame, order: str, weight: Column) -> DataFrame:
    """Adds ``upto``, the sum of ``weight`` over the rows up to each one by ``order``, without one task seeing all rows.

    Rows are dealt by ranges; sums of the ranges before (one number a task) are
    added to the sums within.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(rows.withColumn("w", weight.cast("long")).repartitionByRange(n, order).withColumn("part", F.spark_partition_id()), "running")
    sums = dealt.groupBy("part").agg(F.sum("w").alias("s"))
    before = sums.select("part", (F.sum("s").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("s")).alias("before"))
    within = F.sum("w").over(Window.partitionBy("part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return dealt.withColumn("within", within).join(F.broadcast(before), "part").withColumn("upto", F.col("within") + F.col("before")).drop("w", "part", "within", "before")


def counting_sort(rows: DataFrame) -> DataFrame:
    """(id, v, position) with the 1-based position in the stable order by v.

    Counts per value are summed up over the distinct values; rows are only
    ordered within their value.
    """
    n = rows.groupBy("v").agg(F.count("*").alias("n"))
    before = running(n, "v", F.col("n")).select("v", (F.col("upto") - F.col("n")).alias("before"))
    own = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    return rows.select("id", "v", own.alias("own")).join(before, "v").select("id", "v", (F.col("before") + F.col("own")).cast("int").alias("position"))


def relabel(rows: DataFrame) -> DataFrame:
    """(id, label, dense) with labels numbered from 1 by first appearance (smallest id)."""
    first = rows.groupBy("label").agg(F.min("id").alias("first"))
    dense = running(first, "first", F.lit(1)).select("label", F.col("upto").cast("int").alias("dense"))
    return rows.join(dense, "label").select("id", "label", "dense")


def interval(v: Column, breaks: list[float]) -> Column:
    """U4: number of the interval (a, b] that holds v; 0 outside and for null."""
    out = F.lit(0)
    ordered = sorted(breaks)
    for i in range(len(ordered) - 1, 0, -1):
        out = F.when((v > ordered[i - 1]) & (v <= ordered[i]), i).otherwise(out)
    return F.coalesce(out, F.lit(0))


def cut_width(rows: DataFrame, column: str, n: int) -> DataFrame:
    """U5 (width): adds ``bin``, 1 to n, intervals of equal width whose ends are widened by a thousandth of the range."""
    # The ends come by a join with one row, so that nothing is computed ahead of the query.
    lo, hi, v = F.col("ends.lo"), F.col("ends.hi"), F.col(column)
    ends = rows.agg(F.struct(F.min(column).alias("lo"), F.max(column).alias("hi")).alias("ends"))
    breaks = [lo - (hi - lo) / 1000, *(lo + (hi - lo) * i / n for i in range(1, n)), hi + (hi - lo) / 1000]
    passed = F.aggregate(F.array(*breaks), F.lit(0), lambda acc, b: acc + (b < v).cast("int"))
    inside = F.when(lo == hi, 1).when(passed > n, 0).otherwise(passed)
    return rows.crossJoin(F.broadcast(ends)).withColumn("bin", F.when(v.isNull(), 0).otherwise(inside)).drop("ends")


def cut_frequency(rows: DataFrame, column: str, n: int) -> DataFrame:
    """U5 (frequency): adds ``bin`` by n quantile edges, so n - 1 intervals; the minimum is in the first."""
    edges = rows.agg(F.percentile(column, [i / (n - 1) for i in range(n)]).alias("q")).first().q
    if not edges:
        return rows.withColumn("bin", F.lit(0))
    return rows.withColumn("bin", F.when(F.col(column) == edges[0], 1).otherwise(interval(F.col(column), edges)))


def rep_each(rows: DataFrame, each: int) -> DataFrame:
    """Every row ``each`` times, numbered 1 to ``each``."""
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(each)))) if each > 0 else rows.withColumn("copy", F.lit(1)).limit(0)


def tied_rank(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """Adds ``rank``, the average rank of ``value`` (within ``by``)."""
    same = Window.partitionBy(*by, value)
    order = Window.partitionBy(*by).orderBy(value)
    return rows.withColumn("rank", F.rank().over(order) + (F.count("*").over(same) - 1) / 2.0)


def arg_max(rows: DataFrame, by: str, key: str, value: str) -> DataFrame:
    """U8: for each ``by`` the row with the largest value; ties go to the smaller key."""
    order = Window.partitionBy(by).orderBy(F.desc(value), key)
    return rows.withColumn("__r", F.row_number().over(order)).filter("__r = 1").select(by, key, value)
