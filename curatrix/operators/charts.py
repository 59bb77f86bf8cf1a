"""Label/value aggregation for charts: pie, bars, shares, bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .sampling import running_total


def label_or_nan(column: Column | str) -> Column:
    """A label as text; a missing one is the group 'nan', as in a frame read from CSV."""
    return F.coalesce(F.col(column).cast("string") if isinstance(column, str) else column.cast("string"), F.lit("nan"))


def pie(df: DataFrame, label: str, value: str | None = None, top: int = 9, most: int = 10) -> DataFrame:
    """Sums of value by label, or counts where the sums say nothing, largest first, the tail as 'Other'.

    Counts are taken if there is no value column, the total is 0 or all values
    are one. With more than `most` labels, `top` stay and the others fold into
    'Other'. Only what is above 0 is returned. Ties break by label.
    The one shuffle over rows is the partial aggregate by label; the statistics
    over everything come from the aggregated labels.
    """
    v = F.coalesce(F.col(value).cast("double"), F.lit(0.0)) if value else F.lit(0.0)
    by = df.groupBy(label_or_nan(label).alias("label")).agg(F.sum(v).alias("s"), F.count(F.lit(1)).alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi"))
    whole = by.agg(F.sum("s").alias("total"), F.min("lo").alias("lo_all"), F.max("hi").alias("hi_all"), F.count(F.lit(1)).alias("labels"))
    use_count = F.lit(value is None) | (F.col("total") == 0) | (F.col("lo_all") == F.col("hi_all"))
    chosen = by.join(F.broadcast(whole)).withColumn("v", F.when(use_count, F.col("n").cast("double")).otherwise(F.col("s")))
    head = chosen.orderBy(F.desc("v"), "label").limit(most).withColumn("rn", F.row_number().over(W.orderBy(F.desc("v"), "label"))).filter((F.col("labels") <= most) | (F.col("rn") <= top))
    rest = chosen.join(head.select("label"), "label", "left_anti").groupBy().agg(F.sum("v").alias("v")).filter(F.col("v").isNotNull())
    return head.select("label", "v").unionByName(rest.select(F.lit("Other").alias("label"), "v")).groupBy("label").agg(F.sum("v").alias("value")).filter("value > 0")


def bars(df: DataFrame, label: str, value: str | None, k: int = 12, numeric: bool = True) -> DataFrame:
    """The k largest positive label sums (counts without a numeric value), to be read in rising order; ties break by label."""
    measure = F.sum(F.col(value).cast("double")) if value and numeric else F.count(F.lit(1)).cast("double")
    return df.groupBy(label_or_nan(label).alias("label")).agg(measure.alias("value")).filter("value > 0").orderBy(F.desc("value"), "label").limit(k)


def grouped_measures(df: DataFrame, label: str, measures: list[str], k: int = 10) -> DataFrame:
    """Sums of at most three measures by label, the k labels with the largest row total."""
    chosen = measures[:3]
    by = df.groupBy(label_or_nan(label).alias("label")).agg(*[F.sum(F.col(m).cast("double")).alias(m) for m in chosen])
    total = sum((F.coalesce(F.col(m), F.lit(0.0)) for m in chosen), F.lit(0.0))
    return by.withColumn("total", total).filter(F.greatest(*[F.coalesce(F.col(m), F.lit(0.0)) for m in chosen], F.lit(0.0)) > 0).orderBy(F.desc("total"), "label").limit(k)


def count_by(df: DataFrame, column: str) -> DataFrame:
    """How often each value occurs; missing values aren't counted."""
    return df.filter(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))


def first_seen_sums(df: DataFrame, label: str, value: str, order: str) -> DataFrame:
    """Sums by label with the place where each label was first seen."""
    return df.groupBy(label_or_nan(label).alias("label")).agg(F.sum(F.col(value).cast("double")).alias("value"), F.min(order).alias("first_seen"))


def shares(df: DataFrame, label: str, value: str, order: str, top: int | None = None, threshold: float | None = None, dropna_labels: bool = False, other: str = "Other") -> DataFrame:
    """Shares of the total by label; labels beyond the top and shares below the threshold fold into `other`.

    Both foldings may each add a row named `other`, as in the reference: kind
    tells them apart. Raises if the total isn't positive.
    """
    src = df.filter(F.col(label).isNotNull()) if dropna_labels else df
    by = first_seen_sums(src, label, value, order)
    total = by.agg(F.sum("value")).collect()[0][0]
    if total is None or total <= 0:
        raise ValueError("the total of the values must be positive")
    by = by.withColumn("share", F.col("value") / F.lit(total)).withColumn("kind", F.lit("label"))
    if top is not None:
        head = by.orderBy(F.desc("share"), "first_seen", "label").limit(top)
        rest = by.join(head.select("label"), "label", "left_anti").groupBy().agg(F.sum("value").alias("value"), F.sum("share").alias("share")).filter("value IS NOT NULL")
        by = head.unionByName(rest.select(F.lit(other).alias("label"), "value", F.lit(None).cast("long").alias("first_seen"), "share", F.lit("beyond_top").alias("kind")))
    if threshold is not None:
        small = by.filter(F.col("share") < threshold).groupBy().agg(F.sum("value").alias("value"), F.sum("share").alias("share")).filter("value IS NOT NULL")
        by = by.filter(F.col("share") >= threshold).unionByName(small.select(F.lit(other).alias("label"), "value", F.lit(None).cast("long").alias("first_seen"), "share", F.lit("below_threshold").alias("kind")))
    return by.select("label", "value", "share", "kind")


def histogram(df: DataFrame, column: str) -> DataFrame:
    """How often each whole number from 0 to the largest occurs, zeros included; an empty input gives 0: 0."""
    by = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    top = by.agg(F.coalesce(F.max("bin"), F.lit(0)).alias("top"))
    grid = top.select(F.explode(F.sequence(F.lit(0), F.col("top"))).alias("bin"))
    return grid.join(by, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def series_slice(df: DataFrame, key: str, order: str, first: int, columns: list[str]) -> DataFrame:
    """The rows of the first so many distinct keys in order of appearance."""
    keys = df.groupBy(key).agg(F.min(order).alias("_at")).orderBy("_at", key).limit(first).select(key)
    return df.join(F.broadcast(keys), key, "left_semi").select(*columns)


def clip_and_scale(df: DataFrame, key: str, value: str, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Values clipped to two percentiles of their group and scaled to 0..1; in a flat group the share of its values below, ties alike.

    A missing value stays one. Equal values are counted first, and their counts
    added up in ranges, so no task holds or sorts a group; percentiles lie
    between the two values around their place, in proportion.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(F.col(key).alias("_k"), F.col(value).cast("double").alias("_x")).agg(F.count(F.lit(1)).alias("_c"))
    upto = running_total(counts, ["_k", "_x"], F.col("_c"), "_upto")
    whole = upto.groupBy(F.col("_k").alias("_g")).agg(F.min(F.col("_upto") - F.col("_c")).alias("_base"), F.sum("_c").alias("_n"))
    places = upto.join(whole, F.col("_k").eqNullSafe(F.col("_g"))).withColumn("_below", F.col("_upto") - F.col("_c") - F.col("_base"))

    def at(place: Column) -> Column:
        return F.max(F.when((F.col("_below") <= place) & (place < F.col("_below") + F.col("_c")), F.col("_x")))

    bounds = []
    for name, p in (("_lo", low), ("_hi", high)):
        exact = (F.col("_n") - 1) * F.lit(p)
        bounds += [at(F.floor(exact)).alias(name), at(F.ceil(exact)).alias(name + "2"), F.max(exact - F.floor(exact)).alias(name + "f")]
    by = places.groupBy("_g", "_n").agg(*bounds).select("_g", "_n", *[(F.col(b) + (F.col(b + "2") - F.col(b)) * F.col(b + "f")).alias(b) for b in ("_lo", "_hi")])
    flat = by.filter("_hi <= _lo").select(F.col("_g").alias("_f"))
    below = places.join(flat, F.col("_k").eqNullSafe(F.col("_f")), "left_semi").select(F.col("_k").alias("_bk"), "_x", "_below")
    out = df.join(by, F.col(key).eqNullSafe(F.col("_g")), "left").join(below, F.col(key).eqNullSafe(F.col("_bk")) & (F.col(value).cast("double") == F.col("_x")), "left")
    clipped = F.greatest("_lo", F.least("_hi", F.col(value)))
    scaled = F.when(F.col("_hi") > F.col("_lo"), (clipped - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(F.col("_below") / F.greatest(F.col("_n") - 1, F.lit(1)))
    return out.withColumn("scaled", F.when(F.col(value).isNotNull(), scaled)).drop("_g", "_n", "_lo", "_hi", "_bk", "_x", "_below")


def flatness(df: DataFrame, key: str, value: str, limit: float = 0.03) -> DataFrame:
    """The coefficient of variation of each group (population deviation), and whether it is flat."""
    cv = F.stddev_pop(value) / (F.abs(F.avg(value)) + 1e-9)
    return df.groupBy(key).agg(cv.alias("cv")).withColumn("flat", F.col("cv") < limit)


def equal_width_bins(df: DataFrame, key: str, value: str, most: int = 10, least: int = 4) -> DataFrame:
    """Counts of each group's values in equal right-closed bins, min(most, max(least, floor(sqrt(n)))) of them."""
    by = df.filter(F.col(value).isNotNull()).groupBy(key).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.count(value).alias("_n"))
    bins = F.least(F.lit(most), F.greatest(F.lit(least), F.floor(F.sqrt("_n")))).cast("int")
    width = (F.col("_hi") - F.col("_lo")) / bins
    bin_ = F.when(F.col("_hi") == F.col("_lo"), F.lit(1)).otherwise(F.least(bins, F.greatest(F.lit(1), F.ceil((F.col(value) - F.col("_lo")) / width)))).cast("int")
    return df.filter(F.col(value).isNotNull()).join(by, key).withColumn("bin", bin_).groupBy(key, "bin").agg(F.count(F.lit(1)).alias("n"))


def best_parameter(df: DataFrame, score: str, order: str) -> DataFrame:
    """The row of the highest score above 0, the first of equals."""
    return df.filter(F.col(score) > 0).groupBy().agg(F.max_by(order, F.struct(F.col(score), -F.col(order))).alias("best"), F.max(score).alias("score"))


def numeric_and_other(df: DataFrame) -> tuple[str | None, str | None]:
    """The first non-numeric and the first numeric column."""
    numbers = {"tinyint", "smallint", "int", "bigint", "float", "double"}
    is_number = [(c, t in numbers or t.startswith("decimal")) for c, t in df.dtypes]
    return next((c for c, n in is_number if not n), None), next((c for c, n in is_number if n), None)


def chart_shape(df: DataFrame) -> str:
    """'grouped' with a label column and two or more numeric ones, else 'single'."""
    numbers = {"tinyint", "smallint", "int", "bigint", "float", "double"}
    n = sum(t in numbers or t.startswith("decimal") for _, t in df.dtypes)
    return "grouped" if n >= 2 and n < len(df.columns) else "single"


def column_of(df: DataFrame, names: list[str] | None = None, index: int | None = None) -> str:
    """The first of the candidate names that the frame has, or the column at a 0-based place."""
    if index is not None:
        return df.columns[index]
    for name in names or []:
        if name in df.columns:
            return name
    raise KeyError(f"none of {names} is a column")


def finite_or_null(df: DataFrame, columns: list[str]) -> DataFrame:
    """Infinities become null; rows without any value in the columns go."""
    def clean(c: str) -> Column:
        return F.when(~F.col(c).isin(float("inf"), float("-inf")) & ~F.isnan(c), F.col(c))

    return df.withColumns({c: clean(c) for c in columns}).dropna("all", subset=columns)


def enough_categories(df: DataFrame, dataset: str, label: str, least: int = 3) -> DataFrame:
    """Only the rows of datasets with at least so many labels."""
    fine = df.groupBy(dataset).agg(F.count_distinct(label).alias("_n")).filter(F.col("_n") >= least).select(dataset)
    return df.join(fine, dataset, "left_semi")


def downsample(n: Column, target: Column | int) -> Column:
    """Row numbers (from 0) of target evenly spread points out of n, rounded half to even."""
    t = F.lit(target) if isinstance(target, int) else target
    return F.when(n <= t, F.sequence(F.lit(0).cast("long"), n.cast("long") - 1)).otherwise(F.transform(F.sequence(F.lit(0).cast("long"), t.cast("long") - 1), lambda i: F.bround(i * (n - 1) / (t - 1), 0).cast("long")))
