"""Operators over series in long form: rows (series, t, x), ordered by t within a series. Window functions only, so a series may span any length that one task can stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec


def order(series: str = "series", t: str = "t") -> WindowSpec:
    return Window.partitionBy(series).orderBy(t)


def differences(df: DataFrame, x: str = "x") -> DataFrame:
    """dx: the next value less this one; the last row of a series is left out."""
    return df.withColumn("dx", F.lead(x).over(order()) - F.col(x)).filter("dx is not null")


def running(df: DataFrame, x: str = "x") -> DataFrame:
    """cumsum, cummean and cumsxx (sum of squares about the running mean)."""
    w = order().rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({"cumsum": F.sum(x).over(w), "cummean": F.avg(x).over(w), "cumsxx": F.var_pop(x).over(w) * F.count(x).over(w)})


def extreme_filter(df: DataFrame, radius: int, x: str = "x") -> DataFrame:
    """lo and hi: least and largest value within ``radius`` rows, cut off at the ends."""
    w = order().rowsBetween(-radius, radius)
    return df.withColumns({"lo": F.min(x).over(w), "hi": F.max(x).over(w)})


def sliding_argmin(df: DataFrame, length: int, x: str = "x", ahead: bool = False, largest: bool = False) -> DataFrame:
    """at: t of the least (or largest) of the last (or next) ``length`` values; the latest on ties."""
    w = order().rowsBetween(0, length - 1) if ahead else order().rowsBetween(-(length - 1), 0)
    key = F.struct((F.col(x) if largest else -F.col(x)).alias("v"), F.col("t"))
    return df.withColumn("at", F.max(key).over(w)["t"])


def profiles(df: DataFrame, query: list[float], named: dict[str, str], x: str = "x", stride: int = 1) -> DataFrame:
    """A column for each name: distance (l1, l2, l2sq) or cross-correlation (dot) of ``query`` with the window that begins at each row, all from one pass;
    short windows are left out."""
    w = order()
    ahead = [F.col(x) if not j else F.lead(x, j).over(w) for j in range(len(query))]
    held = df.withColumn("_ahead", F.array(*ahead)).filter(F.forall("_ahead", lambda v: v.isNotNull()) & (F.col("t") % stride == 0))
    terms = {"dot": lambda v, q: v * q, "l1": lambda v, q: F.abs(v - q), "l2": lambda v, q: (v - q) * (v - q), "l2sq": lambda v, q: (v - q) * (v - q)}

    def total(metric: str) -> Column:
        out = None
        for j, q in enumerate(query):
            term = terms[metric](F.get("_ahead", F.lit(j)), F.lit(float(q)))
            out = term if out is None else out + term
        return F.sqrt(out) if metric == "l2" else out

    return held.withColumns({n: total(metric) for n, metric in named.items()}).drop("_ahead")


def profile(df: DataFrame, query: list[float], metric: str = "l2sq", x: str = "x", stride: int = 1) -> DataFrame:
    """d: one of ``profiles``."""
    return profiles(df, query, {"d": metric}, x, stride)


def runs(df: DataFrame, value: str) -> DataFrame:
    """series, start, end (exclusive), value: maximal stretches of one value; t must count rows from 0."""
    new = (F.lag(value).over(order()).eqNullSafe(F.col(value)) & (F.row_number().over(order()) > 1)).cast("int")
    marked = df.withColumn("run", F.sum(1 - new).over(order().rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy("series", "run").agg(F.min("t").alias("start"), (F.max("t") + 1).alias("end"), F.first(value).alias("value")).drop("run")


def relative_extrema(df: DataFrame, x: str = "x", allow_equal: bool = False) -> DataFrame:
    """Rows whose value is above both neighbours (kind max) or below both (kind min); at the ends one neighbour decides."""
    w = order()
    before, after = F.lag(x).over(w), F.lead(x).over(w)
    def beats(op) -> Column:
        left, right = F.coalesce(op(F.col(x), before), F.lit(True)), F.coalesce(op(F.col(x), after), F.lit(True))
        return left & right & (before.isNotNull() | after.isNotNull())

    high = beats(lambda a, b: a >= b) if allow_equal else beats(lambda a, b: a > b)
    low = beats(lambda a, b: a <= b) if allow_equal else beats(lambda a, b: a < b)
    return df.withColumn("kind", F.when(high, "max").when(low, "min")).filter("kind is not null")


def ngrams(df: DataFrame, n: int, value: str) -> DataFrame:
    """gram: the ``n`` values from each row on, as an array; incomplete ones are left out."""
    w = order().rowsBetween(0, n - 1)
    return df.withColumn("gram", F.collect_list(value).over(w)).filter(F.size("gram") == n)


def predecessors(df: DataFrame, n: int, value: str) -> DataFrame:
    """value, gram, n: how often each ``n``-gram stands right before a value."""
    w = order().rowsBetween(-n, -1)
    return df.withColumn("gram", F.collect_list(value).over(w)).filter(F.size("gram") == n).groupBy(value, "gram").agg(F.count("*").alias("n"))


def last_n(df: DataFrame, n: int, x: str = "x") -> DataFrame:
    """buffer: the last ``n`` values up to each row, oldest first."""
    return df.withColumn("buffer", F.collect_list(x).over(order().rowsBetween(-(n - 1), 0)))


def asof_forward(left: DataFrame, right: DataFrame) -> DataFrame:
    """left's rows with the first t of right (same series) at or after their own time: a union and a backward window, not a range join."""
    both = left.select("series", "time", F.lit(0).alias("side"), F.struct(*left.columns).alias("row"), F.lit(None).cast("long").alias("found")).unionByName(
        right.select("series", "time", F.lit(1).alias("side"), F.lit(None).cast(left.select(F.struct(*left.columns)).schema[0].dataType).alias("row"), F.col("t").cast("long").alias("found"))
    )
    w = Window.partitionBy("series").orderBy("time", "side", F.col("found").asc_nulls_first()).rowsBetween(0, Window.unboundedFollowing)
    return both.withColumn("t", F.first("found", ignorenulls=True).over(w)).filter("side = 0").select("row.*", "t")


def detrend(df: DataFrame, x: str = "x") -> DataFrame:
    """resid: the value less the least-squares line of its series; slope is the line's."""
    line = df.groupBy("series").agg(F.regr_slope(x, "t").alias("slope"), F.regr_intercept(x, "t").alias("level"))
    return df.join(line, "series").withColumn("resid", F.col(x) - F.col("level") - F.col("slope") * F.col("t")).drop("level")


def unique_counts(df: DataFrame, value: str, within: str) -> DataFrame:
    """value, n, groups: how often each value occurs, and in how many groups. Values are counted by group first, so that a task sends one row for each pair."""
    each = df.groupBy(value, within).agg(F.count("*").alias("_n"))
    return each.groupBy(value).agg(F.sum("_n").alias("n"), F.count(within).alias("groups"))


def unique_places(df: DataFrame, value: str, within: str, place: str) -> DataFrame:
    """within, value, places: where each value stands in its group, in order."""
    return df.groupBy(within, value).agg(F.array_sort(F.collect_list(place)).alias("places"))


def dense_rows(df: DataFrame, by: str, name: str, value: str, names: list[str]) -> DataFrame:
    """A row for each group with a column for each name: sums of its values, null where there are none."""
    return df.groupBy(by).pivot(name, names).agg(F.sum(value))
