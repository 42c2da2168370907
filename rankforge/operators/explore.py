"""Exploratory aggregates over ratings, items and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import numeric
from .ordering import global_positions


def counts_and_means(df: DataFrame, key: str, value: str = "rating") -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))


def distinct_counts(df: DataFrame, columns: list[str], approximate: bool = False) -> DataFrame:
    """One row: number of distinct values of each column."""
    count = F.approx_count_distinct if approximate else F.count_distinct
    return df.agg(*[count(F.col(c)).alias(c) for c in columns])


def null_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return df.agg(*[F.sum(F.col(c).isNull().cast("bigint")).alias(c) for c in columns or df.columns])


def exact_quantiles(df: DataFrame, column: str, shares: list[float]) -> DataFrame:
    """Quantiles with linear interpolation, one row per share.

    Distinct values are counted and placed in one distributed order; only the rows at the wanted
    positions leave it, so that no task sees all values.
    """
    counts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("_v")).agg(F.count("*").alias("_n"))
    placed = global_positions(counts, ["_v"], "_position", running={"_n": "_to"})
    total = counts.agg(F.sum("_n")).scalar()
    at = [F.struct(F.lit(float(s)).alias("share"), (F.lit(float(s)) * (total - 1)).alias("p")) for s in shares]

    def covered(x: Column) -> Column:
        # A value takes the positions [_to - _n, _to); interpolation needs floor(p) and ceil(p).
        first = F.col("_to") - F.col("_n")
        return (F.ceil(x["p"]) >= first) & (F.floor(x["p"]) < F.col("_to"))

    hits = placed.withColumn("_at", F.array(*at)).select("_v", F.explode(F.filter("_at", covered)).alias("_x"))
    low, high, p = F.min("_v"), F.max("_v"), F.max("_x.p")
    return hits.groupBy(F.col("_x.share").alias("share")).agg(
        (low + (high - low) * (p - F.floor(p))).alias("value"))


def numeric_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """count, mean, std (sample), min, quartiles and max, one row per column.

    One scan and one distributed order of (column, value) serve all columns.
    """
    cells = df.select(F.posexplode(F.array(*[F.col(c).cast("double") for c in columns])).alias("_c", "_v")).filter("_v IS NOT NULL")
    counts = cells.groupBy("_c", "_v").agg(F.count("*").alias("_n"))
    placed = global_positions(counts, ["_c", "_v"], "_position", running={"_n": "_to"})
    n = F.col("_n")
    stats = placed.groupBy("_c").agg(
        F.sum(n).alias("count"), (F.sum(F.col("_v") * n) / F.sum(n)).alias("mean"), F.min("_v").alias("min"), F.max("_v").alias("max"),
        F.min(F.col("_to") - n).alias("_first"))
    spread = cells.groupBy("_c").agg(F.stddev_samp("_v").alias("std"))
    shares = F.array(*[F.struct(F.lit(s).alias("share"), (F.lit(s) * (F.col("count") - 1)).alias("p")) for s in (0.25, 0.5, 0.75)])
    low = F.col("_to") - n - F.col("_first")  # a value takes the positions [low, high) of its column
    high = F.col("_to") - F.col("_first")
    hits = placed.join(F.broadcast(stats.select("_c", "count", "_first")), "_c").withColumn(  # one row per column
        "_x", F.explode(F.filter(shares, lambda x: (F.ceil(x["p"]) >= low) & (F.floor(x["p"]) < high))))
    p = F.max("_x.p")
    quantiles = hits.groupBy("_c", F.col("_x.share").alias("share")).agg(
        (F.min("_v") + (F.max("_v") - F.min("_v")) * (p - F.floor(p))).alias("value"))
    wide = quantiles.groupBy("_c").agg(*[F.max(F.when(F.col("share") == s, F.col("value"))).alias(name)
                                         for s, name in ((0.25, "q25"), (0.5, "q50"), (0.75, "q75"))])
    names = df.sparkSession.createDataFrame(list(enumerate(columns)), "_c int, column string")
    found = stats.join(spread, "_c").join(wide, "_c").drop("_first")
    return names.join(found, "_c", "left").select(
        "column", F.coalesce("count", F.lit(0)).cast("bigint").alias("count"), "mean", "std", "min", "q25", "q50", "q75", "max")


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """Equal-width bins between min and max, empty bins included; the last bin is closed."""
    low, high = df.agg(F.min(column)).scalar(), df.agg(F.max(column)).scalar()
    width = (high - low) / bins
    at = F.least(F.floor((F.col(column) - low) / width), F.lit(bins - 1)).cast("int")
    counted = (df.filter(F.col(column).isNotNull())
               .groupBy(F.when(high > low, at).otherwise(0).alias("bin")).agg(F.count("*").alias("n")))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(counted, "bin", "left").select(
        "bin", (low + F.col("bin") * width).alias("bin_from"), F.coalesce("n", F.lit(0)).alias("n"))


def per_exploded(df: DataFrame, column: Column, name: str, value: str = "rating") -> DataFrame:
    """Count and mean per element of an array column."""
    return counts_and_means(df.select(F.explode(column).alias(name), value), name, value)


def crosstab(df: DataFrame, row: str, column: str, values: list) -> DataFrame:
    """Counts of `column` values (listed) per `row`; missing = 0."""
    return df.groupBy(row).pivot(column, values).agg(F.count(F.lit(1))).na.fill(0)


def share_per_row(df: DataFrame, row: str, column: str) -> DataFrame:
    """Long form: count of each (row, column) and its share of the row."""
    counted = df.groupBy(row, column).agg(F.count("*").alias("n"))
    totals = counted.groupBy(row).agg(F.sum("n").alias("_total"))
    return counted.join(totals, row).select(row, column, "n", (F.col("n") / F.col("_total")).alias("share"))


def counts_in_order(df: DataFrame, bucket: Column, order: tuple, name: str = "bucket",
                    fill_zero: bool = False) -> DataFrame:
    """Counts per bucket in the given order; buckets without rows appear with null (or 0)."""
    counted = df.groupBy(bucket.alias(name)).agg(F.count("*").alias("n"))
    kind = "int" if isinstance(order[0], int) else "string"
    every = df.sparkSession.createDataFrame(list(enumerate(order)), f"position int, {name} {kind}")
    out = every.join(counted, name, "left")
    return out.select("position", name, F.coalesce("n", F.lit(0)).alias("n") if fill_zero else F.col("n"))


def daily_counts(df: DataFrame, ts: str = "ts") -> DataFrame:
    return df.groupBy(F.to_date(ts).alias("day")).agg(F.count("*").alias("n"))


def weekday(ts: Column) -> Column:
    return F.element_at(F.array(*[F.lit(d) for d in numeric.WEEKDAY_ORDER]), F.weekday(ts) + 1)


def daypart_counts(df: DataFrame, genre: str, ts: str = "ts") -> DataFrame:
    return df.groupBy(numeric.daypart(F.hour(ts)).alias("daypart"), genre).agg(F.count("*").alias("n"))


def matrix_stats(ratings: DataFrame, users: DataFrame, items: DataFrame) -> DataFrame:
    """Shape, filled cells, density and empty rows and columns of the user-item matrix."""
    cells = ratings.select("user_id", "item_id").distinct()
    per_item = cells.groupBy("item_id").agg(F.count("*").alias("_n"))
    n_users, n_items = users.agg(F.count("*")).scalar(), items.agg(F.count("*")).scalar()
    active = cells.agg(F.count_distinct("user_id")).scalar()
    used = per_item.agg(F.count("*")).scalar()
    few = per_item.agg(F.count_if(F.col("_n").between(1, 5))).scalar()
    return per_item.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("nnz")).select(
        n_users.alias("n_users"), n_items.alias("n_items"), "nnz",
        (F.col("nnz") / (n_users * n_items)).alias("density"),
        active.alias("active_users"), (n_users - active).alias("empty_users"),
        (n_items - used).alias("empty_items"), few.alias("items_1_to_5"))


def request_majority(requests: DataFrame, column: str) -> DataFrame:
    """Values of a request list ranked by frequency, ties by value: `(query_id, rank, value, n)`."""
    counted = requests.groupBy("query_id", column).agg(F.count("*").alias("n"))
    order = Window.partitionBy("query_id").orderBy(F.desc("n"), F.asc(column))
    return counted.select("query_id", F.row_number().over(order).alias("rank"), F.col(column).alias("value"), "n")


def trailing_mean(events: DataFrame, days: int, bucket_seconds: int = 3600) -> DataFrame:
    """Per rating event: mean of the user's ratings of the same genre in [t - days, t].

    `events(user_id, genre, ts, rating)`. A window over a whole (user, genre) would put a hot pair
    into one task. Time is cut into buckets instead, and the sum over [t - w, t] is put together
    from running sums inside the bucket of t, whole buckets in between, and running sums inside the
    bucket of t - w; each window sees one bucket of rows, or one row per bucket.
    """
    size, width = bucket_seconds * 1_000_000, days * 86_400_000_000
    if width % size:
        raise ValueError("the bucket must divide the window")
    base = (events.groupBy("user_id", "genre", numeric.micros(F.col("ts")).alias("t"))
            .agg(F.sum("rating").alias("s"), F.count("rating").alias("c")))
    pair = ["user_id", "genre"]
    # kind 1: the event itself; kind 0: a probe at t - w, which must not count rows at its own time.
    own = base.select(*pair, "t", F.col("t").alias("at"), F.lit(1).alias("kind"), "s", "c")
    probe = base.select(*pair, "t", (F.col("t") - width).alias("at"), F.lit(0).alias("kind"),
                        F.lit(0.0).alias("s"), F.lit(0).cast("bigint").alias("c"))
    both = own.unionByName(probe).withColumn("b", F.floor(F.col("at") / size))
    inside = (Window.partitionBy(*pair, "b").orderBy("at", "kind")
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    run = both.select(*pair, "t", "b", "kind", F.sum("s").over(inside).alias("rs"), F.sum("c").over(inside).alias("rc"))
    # Whole buckets before a bucket: one row per bucket, also for the buckets probes fall into.
    totals = both.groupBy(*pair, "b").agg(F.sum("s").alias("bs"), F.sum("c").alias("bc"))
    earlier = Window.partitionBy(*pair).orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(*pair, "b", F.coalesce(F.sum("bs").over(earlier), F.lit(0.0)).alias("ps"),
                           F.coalesce(F.sum("bc").over(earlier), F.lit(0)).alias("pc"))
    sign = F.when(F.col("kind") == 1, 1).otherwise(-1)
    return (run.join(before, [*pair, "b"])
            .groupBy(*pair, "t")
            .agg(F.sum(sign * (F.col("ps") + F.col("rs"))).alias("sum_rating"),
                 F.sum(sign * (F.col("pc") + F.col("rc"))).alias("n"))
            .select(*pair, F.timestamp_micros("t").cast("timestamp_ntz").alias("ts"), "n",
                    (F.col("sum_rating") / F.col("n")).alias("mean_rating")))
