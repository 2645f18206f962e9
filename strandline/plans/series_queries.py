"""Queries over series and intervals: the events of a user, in order of time, are a series."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandline.operators import intervals, ranks, series
from strandline.plans._register import Register, table

register = Register()
QUERIES, ORACLE_SQL = register.queries, register.sql


def _series(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").select(F.col("user_id").alias("series"), (F.row_number().over(w) - 1).cast("long").alias("t"), F.col("value").alias("x"), F.col("event_type").alias("k"), "event_id", F.col("ts").alias("time"))


def _ranges(spark, d, kind):
    """Two rows around each event of a kind."""
    return _series(spark, d).filter(F.col("k") == kind).select("series", F.col("event_id").alias("id"), F.greatest(F.lit(0), F.col("t") - 1).alias("start"), (F.col("t") + 2).alias("end"), F.lit(kind).alias("label"))


def _kinds(spark, d):
    """The first and the last kind of event."""
    return list(table(spark, d, "events").agg(F.min("event_type"), F.max("event_type")).first())


_S = "s as (select user_id as series, row_number() over (partition by user_id order by ts, event_id) - 1 as t, value as x, event_type as k, event_id, ts from events)"
_W = "over (partition by series order by t"
_K = "k0 as (select min(event_type) as a, max(event_type) as b from events)"
_R = f"{_S}, {_K}, ra as (select series, event_id as id, greatest(0, t - 1) as s, t + 2 as e from s, k0 where k = a), rb as (select series, event_id as id, greatest(0, t - 1) as s, t + 2 as e from s, k0 where k = b)"


@register(f"with {_S} select event_id, round(dx, 6) as dx from (select event_id, lead(x) {_W}) - x as dx from s) where dx is not null")
def w04_differences(spark, d):
    return series.differences(_series(spark, d)).select("event_id", F.round("dx", 6).alias("dx"))


@register(f"with {_S} select event_id, round(sum(x) {_W}), 4) as cumsum, round(avg(x) {_W}) + 1e-9, 4) as cummean, round(var_pop(x) {_W}) * (t + 1) + 1e-6, 1) as cumsxx from s")
def w05_running(spark, d):
    return series.running(_series(spark, d)).select("event_id", F.round("cumsum", 4).alias("cumsum"), F.round(F.col("cummean") + 1e-9, 4).alias("cummean"), F.round(F.col("cumsxx") + 1e-6, 1).alias("cumsxx"))


@register(f"with {_S} select event_id, min(x) {_W} rows between 3 preceding and 3 following) as lo, max(x) {_W} rows between 3 preceding and 3 following) as hi from s")
def w06_extreme_filter(spark, d):
    return series.extreme_filter(_series(spark, d), 3).select("event_id", "lo", "hi")


@register(f"with {_S} select event_id, arg_max(t, (-x, t)) {_W} rows between 4 preceding and current row) as at from s")
def w08_sliding_argmin(spark, d):
    return series.sliding_argmin(_series(spark, d), 5).select("event_id", "at")


@register(f"with {_S} select event_id, round(x * 1 + lead(x, 1) {_W}) * 2 + lead(x, 2) {_W}) * 3, 4) as cross_corr, round(sqrt(pow(x - 1, 2) + pow(lead(x, 1) {_W}) - 2, 2) + pow(lead(x, 2) {_W}) - 3, 2)), 4) as dist, round(abs(x - 1) + abs(lead(x, 1) {_W}) - 2) + abs(lead(x, 2) {_W}) - 3), 4) as l1 from s qualify lead(x, 2) {_W}) is not null")
def w02_profiles(spark, d):
    out = series.profiles(_series(spark, d), [1.0, 2.0, 3.0], {"cross_corr": "dot", "dist": "l2", "l1": "l1"})
    return out.select("event_id", *(F.round(c, 4).alias(c) for c in ("cross_corr", "dist", "l1")))


@register(f"with {_S}, c as (select *, case when k is distinct from lag(k) {_W}) or t = 0 then 1 else 0 end as new from s), n as (select *, sum(new) {_W}) as run from c) select series, min(t) as start, max(t) + 1 as \"end\", min(k) as value from n group by series, run")
def w07_runs(spark, d):
    return series.runs(_series(spark, d), "k")


@register(f"with {_S}, n as (select *, lag(x) {_W}) as p, lead(x) {_W}) as q from s where true) select event_id, case when coalesce(x > p, true) and coalesce(x > q, true) then 'max' else 'min' end as kind from n where (p is not null or q is not null) and ((coalesce(x > p, true) and coalesce(x > q, true)) or (coalesce(x < p, true) and coalesce(x < q, true)))")
def w11_relative_extrema(spark, d):
    return series.relative_extrema(_series(spark, d)).select("event_id", "kind")


@register(f"with {_S}, g as (select k, lead(k, 1) {_W}) as k1, lead(k, 2) {_W}) as k2 from s) select concat_ws('|', k, k1, k2) as gram, count(*) as n from g where k2 is not null group by all")
def a12_ngram_counts(spark, d):
    return series.ngrams(_series(spark, d), 3, "k").groupBy(F.concat_ws("|", "gram").alias("gram")).agg(F.count("*").alias("n"))


@register(f"with {_S}, g as (select k, lag(k, 2) {_W}) as k1, lag(k, 1) {_W}) as k2 from s) select k, concat_ws('|', k1, k2) as gram, count(*) as n from g where k1 is not null group by all")
def a13_predecessor_counts(spark, d):
    return series.predecessors(_series(spark, d), 2, "k").select("k", F.concat_ws("|", "gram").alias("gram"), "n")


@register(f"with {_S} select event_id, round(sum(x) {_W} rows between 4 preceding and current row), 4) as total, count(*) {_W} rows between 4 preceding and current row) as held from s")
def x01_last_values(spark, d):
    out = series.last_n(_series(spark, d), 5)
    return out.select("event_id", F.round(F.aggregate("buffer", F.lit(0.0), lambda s, v: s + v), 4).alias("total"), F.size("buffer").cast("long").alias("held"))


@register(f"with {_S}, {_K}, l as (select series, event_id, ts from s, k0 where k = a), r as (select series, t, ts from s, k0 where k = b) select l.event_id, min(r.t) as t from l left join r on l.series = r.series and r.ts >= l.ts group by l.event_id")
def s14_asof_forward(spark, d):
    kinds, s = _kinds(spark, d), _series(spark, d)
    left, right = s.filter(F.col("k") == kinds[0]).select("series", "time", "event_id"), s.filter(F.col("k") == kinds[-1]).select("series", "time", "t")
    return series.asof_forward(left, right).select("event_id", "t")


@register(f"with {_S}, l as (select series, regr_slope(x, t) as b, regr_intercept(x, t) as a from s group by series) select event_id, round(x - a - b * t, 4) as resid from s join l using (series)")
def p23_detrend(spark, d):
    return series.detrend(_series(spark, d)).select("event_id", F.round("resid", 4).alias("resid"))


@register(f"with {_S}, m as (select series, x, t, sum(x - 50) {_W}) as c from s), f as (select series, c - least(0, min(c) {_W} rows between unbounded preceding and 1 preceding)) as g, c from m), b as (select series, round(greatest(0, max(c - coalesce(least(0, pm), 0))), 4) as best from (select series, c, min(c) {_W} rows between unbounded preceding and 1 preceding) as pm from m) group by series) select * from b")
def w12_maximum_subarray(spark, d):
    from strandline.functions.arrays import maximum_subarray

    rows = _series(spark, d).groupBy("series").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "x"))), lambda s: s["x"] - 50).alias("a"))
    return rows.select("series", F.round(maximum_subarray(F.col("a"))["sum"], 4).alias("best"))


@register(f"with {_R}, o as (select *, case when s >= max(e) over (partition by series order by s, e rows between unbounded preceding and 1 preceding) then 1 else 0 end as new from ra), i as (select *, sum(new) over (partition by series order by s, e) as n from o) select series, min(s) as start, max(e) as \"end\" from i group by series, n")
def u03_union_of_ranges(spark, d):
    return intervals.union_of_ranges(_ranges(spark, d, _kinds(spark, d)[0]))


@register(f"with {_R} select distinct s.event_id from s join ra r on s.series = r.series and s.t >= greatest(0, r.s - 1) and s.t < r.e + 1")
def p25_samples_near(spark, d):
    return intervals.samples_near(_series(spark, d), _ranges(spark, d, _kinds(spark, d)[0]), 1).select("event_id")


@register(f"with {_R} select ra.id, max(case when rb.s is null then 0 else greatest(0, least(ra.e, rb.e) - greatest(ra.s, rb.s)) end) as overlap from ra left join rb on ra.series = rb.series and ra.s < rb.e and rb.s < ra.e group by ra.id")
def j13_best_overlap(spark, d):
    kinds = _kinds(spark, d)
    return intervals.best_overlaps(_ranges(spark, d, kinds[0]), _ranges(spark, d, kinds[-1])).select("id", F.col("overlap").cast("long").alias("overlap"))


@register(f"with {_R}, g as (select distinct series, (t // 10) * 10 as lo, (t // 10) * 10 + 10 as hi from s) select ra.id, g.lo from ra join g on ra.series = g.series and s >= lo and e <= hi")
def j15_contained(spark, d):
    tens = _series(spark, d).select("series", (F.floor(F.col("t") / 10) * 10).alias("lo")).distinct().withColumn("hi", F.col("lo") + 10)
    return intervals.contained(_ranges(spark, d, _kinds(spark, d)[0]), tens).select("id", "lo")


#: Each reported interval in turn takes the first free true one: a list of what is taken goes along in a recursion over the pairs of a series.
_GREEDY = """pairs as ({pairs}), n as (select *, row_number() over (partition by series order by rid, tid) as r, count(*) over (partition by series) as of from pairs),
 walk as (select series, 0::bigint as r, []::bigint[] as rids, []::bigint[] as tids from (select distinct series from n)
  union all select w.series, w.r + 1, case when list_contains(rids, n.rid) or list_contains(tids, n.tid) then rids else list_append(rids, n.rid) end,
  case when list_contains(rids, n.rid) or list_contains(tids, n.tid) then tids else list_append(tids, n.tid) end from walk w join n on n.series = w.series and n.r = w.r + 1),
 taken as (select series, unnest(rids) as rid, unnest(tids) as tid from walk w where r = (select max(r) from n where n.series = w.series))"""
_NEAR = "select ra.series, ra.id as rid, rb.id as tid from ra join rb on ra.series = rb.series and ra.s < rb.e and rb.s < ra.e where (least(ra.e, rb.e) - greatest(ra.s, rb.s)) / ((ra.e - ra.s) + (rb.e - rb.s) - (least(ra.e, rb.e) - greatest(ra.s, rb.s))) >= 0.5"


@register(f"with recursive {_R}, {_GREEDY.format(pairs=_NEAR)} select series, rid, tid from taken")
def j12_greedy_matches(spark, d):
    kinds = _kinds(spark, d)
    return intervals.greedy_matches(_ranges(spark, d, kinds[0]), _ranges(spark, d, kinds[-1]), with_labels=False)


@register(f"with {_S}, r as (select series, t, x, ntile(5) over (order by hash_order) as fold from (select *, event_id as hash_order from s)) select k, fold, count(*) as n from (select k, (row_number() over (partition by k order by event_id) - 1) % 5 as fold from s) group by all")
def e08_stratified_folds(spark, d):
    w = Window.partitionBy("k").orderBy("event_id")
    return _series(spark, d).withColumn("fold", (F.row_number().over(w) - 1).cast("long") % 5).groupBy("k", "fold").agg(F.count("*").alias("n"))


@register("select event_type, count(*) as n, count(distinct user_id) as users, round(avg(value), 4) as mean, round(stddev_pop(value), 4) as sd, round(min(value), 4) as lo, round(max(value), 4) as hi, round(quantile_cont(value, 0.5), 4) as median, count_if(value > 50)::bigint as large from events group by event_type")
def a01_group_statistics(spark, d):
    e = table(spark, d, "events")
    rest = e.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("mean"), F.round(F.stddev_pop("value"), 4).alias("sd"), F.round(F.min("value"), 4).alias("lo"), F.round(F.max("value"), 4).alias("hi"), F.count_if(F.col("value") > 50).alias("large"))
    # distinct pairs first, so that no task holds a kind's users; the median by counts in bins
    users = e.select("event_type", "user_id").filter("user_id is not null").distinct().groupBy("event_type").agg(F.count("*").alias("users"))
    median = ranks.percentiles(e, "event_type", "value", [0.5]).select("event_type", F.round(F.get("cuts", F.lit(0)), 4).alias("median"))
    return rest.join(users, "event_type").join(median, "event_type")


@register("select user_id, count(*) as n from events group by user_id having count(*) between 5 and 20")
def a19_group_filter(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n")).filter("n between 5 and 20")


@register("select user_id, sum(value) filter (event_type = k0.a) as first_kind, sum(value) filter (event_type = k0.b) as last_kind from events, (select min(event_type) as a, max(event_type) as b from events) k0 group by user_id")
def p26_dense_rows(spark, d):
    kinds = _kinds(spark, d)
    out = series.dense_rows(table(spark, d, "events"), "user_id", "event_type", "value", [kinds[0], kinds[-1]])
    return out.select("user_id", F.col(kinds[0]).alias("first_kind"), F.col(kinds[-1]).alias("last_kind"))


@register(f"with {_R}, n as (select (select count(*) from ra) as reported, (select count(*) from rb) as true_n, (select count(distinct ra.id) from ra join rb on ra.series = rb.series and ra.s = rb.s) as hit) select round(hit / reported, 6) as precision, round(hit / true_n, 6) as recall, round(2 * (hit / reported) * (hit / true_n) / ((hit / reported) + (hit / true_n)), 6) as f1 from n where hit > 0 union all select 0.0, 0.0, 0.0 from n where hit = 0")
def a20_precision_recall(spark, d):
    kinds = _kinds(spark, d)
    a, b = _ranges(spark, d, kinds[0]), _ranges(spark, d, kinds[-1])
    hit = a.join(b.select("series", "start"), ["series", "start"], "left_semi").agg(F.count("*").alias("hit"))
    one = hit.join(F.broadcast(a.agg(F.count("*").alias("reported")))).join(F.broadcast(b.agg(F.count("*").alias("true_n"))))  # one row each
    s = intervals.scores(F.col("hit"), F.col("reported"), F.col("true_n"))
    return one.select(*(F.round(s[c], 6).alias(c) for c in ("precision", "recall", "f1")))
