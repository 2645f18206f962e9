"""Queries over sketches, learned quantizers, indexes, windows that meet a condition, special functions and scores."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from strandline.functions import arrays as A
from strandline.functions import special
from strandline.operators import evaluate, linear, quantize, search, sketches, subsequences, vectors
from strandline.plans import search_queries as Q
from strandline.plans import series_queries as T
from strandline.plans._register import Register, table

register = Register()
QUERIES, ORACLE_SQL = register.queries, register.sql

_V, _S, _K, _R, _W = Q._V, T._S, T._K, T._R, T._W
_PLANES = "p as (select vec_id as i, e as w from v where vec_id < 16)"


def _planes(spark, d, n=16):
    """The first vectors as planes: a model of fixed size."""
    rows = table(spark, d, "embeddings").filter(f"vec_id < {n}").orderBy("vec_id").select("embedding").collect()
    return np.array([r[0] for r in rows], float)


@register(f"with {_V}, {_PLANES}, x as (select vec_id, i, list_inner_product(e, w) as d from v, p), w as (select i, (max(d) - min(d)) / 3 as w from x group by i) select vec_id, sum(((floor(d / w)::bigint % 2 + 2) % 2) << i)::bigint as bits from x join w using (i) group by vec_id")
def h10_striped_projections(spark, d):
    projected = sketches.project(Q._data(spark, d).select("vec_id", "embedding"), _planes(spark, d))
    return projected.select("vec_id", sketches.striped_bits(F.col("p"), sketches.stripe_widths(projected)).alias("bits"))


@register(f"with {_V}, f as (select e as r from v where vec_id = 0), g as (select list_transform(range(1, 65), lambda k: case when e[k] < 0 then -1.0 else 1.0 end) as s from v where vec_id = 1), y as (select vec_id, list_transform(range(1, 65), lambda k: e[k] * s[k]) as e, r from v, f, g) select vec_id, sum((list_inner_product(e, list_transform(range(1, 65), lambda k: r[(k - 1 - i + 64) % 64 + 1])) > 0)::bigint << i)::bigint as bits from y, range(32) t(i) group by vec_id")
def h08_circulant_sketch(spark, d):
    first, signs = _planes(spark, d, 2)
    planes = sketches.circulant_planes(first, np.where(signs < 0, -1.0, 1.0), 32)
    return sketches.project(Q._data(spark, d).select("vec_id", "embedding"), planes).select("vec_id", sketches.sign_of(F.col("p"), 32).alias("bits"))


_SUPERBIT = sketches.superbit_planes(64, 32, 8)  # drawn from a fixed seed


@register(f"with {_V}, p as (select * from (values {', '.join(f'({i}, {row.tolist()})' for i, row in enumerate(_SUPERBIT))}) t(i, w)) select vec_id, sum((list_inner_product(e, w) > 0)::bigint << i)::bigint as bits from v, p group by vec_id")
def h11_superbit_sketch(spark, d):
    return sketches.project(Q._data(spark, d).select("vec_id", "embedding"), _SUPERBIT).select("vec_id", sketches.sign_of(F.col("p"), 32).alias("bits"))


@register()
def h13_principal_components(spark, d):
    mean, axes = sketches.principal_planes(Q._data(spark, d), 8)
    return sketches.project(Q._data(spark, d).select("vec_id", "embedding"), axes, mean)


@register()
def h12_rotated_components(spark, d):
    mean, axes = sketches.principal_planes(Q._data(spark, d), 32, rotate=True)
    return sketches.project(Q._data(spark, d).select("vec_id", "embedding"), axes, mean).select("vec_id", sketches.sign_of(F.col("p"), 32).alias("bits"))


@register(f"with {_V}, u as (select generate_subscripts(e, 1) - 1 as dim, unnest(e) as x from v), c as (select dim, quantile_cont(x, 0.25) as a, quantile_cont(x, 0.75) as b from u group by dim), m as (select dim, avg(x) filter (x < (a + b) / 2) as a, avg(x) filter (x >= (a + b) / 2) as b from u join c using (dim) group by dim) select dim, round((a + b) / 2, 6) as cut from m")
def h04_means_thresholds(spark, d):
    cuts = sketches.thresholds_kmeans(Q._data(spark, d), 2, rounds=1)
    return cuts.select(F.col("dim").cast("long").alias("dim"), F.round(F.get("thresholds", F.lit(0)), 6).alias("cut"))


_BINS = "u as (select vec_id, generate_subscripts(e, 1) - 1 as dim, unnest(e) as x from v), t as (select dim, quantile_cont(x, 0.25) as a, quantile_cont(x, 0.5) as b, quantile_cont(x, 0.75) as c from u group by dim), z as (select vec_id, dim, x, (x >= a)::int + (x >= b)::int + (x >= c)::int as bin from u join t using (dim))"


@register(f"with {_V}, {_BINS}, y as (select qid, generate_subscripts(q, 1) - 1 as dim, unnest(q) as x from q) select qid, dim, bin, round(avg((y.x - z.x) * (y.x - z.x)), 6) as d from y join z using (dim) group by qid, dim, bin")
def a17_learned_tables(spark, d):
    data = Q._data(spark, d)
    moments = sketches.bin_moments(data, sketches.thresholds(data, "quantile", 4))
    return sketches.learned_tables(moments, Q._queries(spark, d)).select("qid", F.col("dim").cast("long").alias("dim"), "bin", F.round("d", 6).alias("d"))


@register(f"with {_V}, {_BINS}, y as (select qid, generate_subscripts(q, 1) - 1 as dim, unnest(q) as x from q), l as (select qid, dim, bin, avg((y.x - z.x) * (y.x - z.x)) as d from y join z using (dim) group by qid, dim, bin) select qid, vec_id, round(sum(d), 6) as dist from z join l using (dim, bin) group by qid, vec_id")
def h16_learned_distances(spark, d):
    data = Q._data(spark, d)
    cuts = sketches.thresholds(data, "quantile", 4)
    tables = sketches.table_arrays(sketches.learned_tables(sketches.bin_moments(data, cuts), Q._queries(spark, d)), 4)
    codec = quantize.Codec(spark, np.zeros((64, 4, 1)))
    return codec.distances(sketches.digitized(data, cuts), tables).select("qid", "vec_id", F.round("safe", 6).alias("dist"))


@register(f"""with {_V}, c as (select vec_id as cell, e as c from v where vec_id < 4), f as (select vec_id // 4 as cell, vec_id % 4 as sub, e as c from v where vec_id < 16),
 a as (select vec_id, e, cell from (select vec_id, e, cell, row_number() over (partition by vec_id order by list_distance(e, c), cell) as r from v, c) where r = 1),
 b as (select vec_id, e, cell, sub from (select vec_id, e, cell, sub, row_number() over (partition by vec_id order by list_distance(e, c), sub) as r from a join f using (cell)) where r = 1),
 w as (select qid, q, cell from (select qid, q, cell, row_number() over (partition by qid order by list_distance(q, c), cell) as r from q, c) where r <= 2),
 y as (select qid, q, cell, sub from (select qid, q, cell, sub, row_number() over (partition by qid order by list_distance(q, c), cell, sub) as r from w join f using (cell)) where r <= 4),
 p as (select qid, vec_id, round(list_sum(list_transform(list_zip(e, q), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 6) as dist from b join y using (cell, sub)) """ + Q._TOP.format(order="dist", where="", k=5))
def j07_two_level_cells(spark, d):
    cells = Q._centroids(spark, d, 16)
    coarse, fine = cells.filter("cell < 4"), cells.select(F.floor(F.col("cell") / 4).cast("int").alias("cell"), (F.col("cell") % 4).alias("sub"), "centroid")
    return Q._out(search.two_level_knn_join(spark, Q._data(spark, d), Q._queries(spark, d), coarse, fine, 5, 0.5, 0.5))


@register(f"{Q._PAIRS} " + Q._TOP.format(order="dist", where="where qid <> vec_id", k=7))
def j09_projection_knn(spark, d):
    return Q._out(search.ProjectionIndex(spark, Q._data(spark, d), axes=8).knn(Q._queries(spark, d), 7, exclude_self=True))


@register()
def v22_rotated_codes(spark, d):
    codec = quantize.Codec.fit_rotated(spark, Q._data(spark, d), 8, turns=2, start="gauss", rounds=5)
    return codec.encode(Q._data(spark, d)).select("vec_id", F.array_join("codes", ",").alias("codes"))


@register()
def v23_block_rotated_codes(spark, d):
    codec = quantize.Codec.fit_rotated(spark, Q._data(spark, d), 8, turns=2, blocks=4, rounds=5)
    return codec.encode(Q._data(spark, d)).select("vec_id", F.array_join("codes", ",").alias("codes"))


@register(f"with {_V} select vec_id, round(list_sum(list_transform(range(1, 65), lambda k: abs(e[k]))), 6) as size, round(e[64], 6) as last from v")
def v26_overlap_round_trip(spark, d):
    there = Q._data(spark, d).withColumn("o", quantize.overlapped(F.col("embedding").cast("array<double>"), 8, 4))
    return there.withColumn("e", quantize.merged(F.col("o"), 8, 4)).select("vec_id", F.round(A.norm(F.col("e"), 1), 6).alias("size"), F.round(F.get("e", F.lit(63)), 6).alias("last"))


@register(f"{Q._B}{Q._LUT} select qid, m, c, greatest(0, least(255, round_even((d - 0.5 / 8) * 255 / 3.5, 0)))::int as d from lut")
def v29_tables_between(spark, d):
    t = quantize.quantize_tables_between(quantize.Codec(spark, Q._books(spark, d)).tables(Q._queries(spark, d)), 0.5, 4.0)
    return t.select("qid", F.posexplode("lut").alias("m", "row")).select("qid", F.col("m").cast("long").alias("m"), F.posexplode("row").alias("c", "d")).select("qid", "m", F.col("c").cast("long").alias("c"), "d")


@register(f"""{Q._B}{Q._LUT}, p as (select qid, vec_id, sum(d) as dist from codes join lut using (m, c) group by all), t as (select qid, vec_id, list_sum(list_transform(list_zip(e, q), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) as true from v, q)
 select round(corr("true", dist), 5) as corr, round(avg(("true" - dist) * ("true" - dist)), 5) as mse, round(avg(abs("true" - dist) / "true") filter ("true" <> 0), 5) as rel_error from p join t using (qid, vec_id)""".replace("as true from", 'as "true" from'))
def e06_fidelity(spark, d):
    codec = quantize.Codec(spark, Q._books(spark, d))
    return codec.fidelity(codec.encode(Q._data(spark, d)), Q._queries(spark, d)).select(*(F.round(c, 5).alias(c) for c in ("corr", "mse", "rel_error")))


@register(f"with {_S}, n as (select series, t, x, lead(x, 1) {_W}) as a, lead(x, 2) {_W}) as b from s) select series, t as start from n where b is not null and x < a and a < b")
def w15_rising_windows(spark, d):
    return subsequences.where(T._series(spark, d), 3, lambda g: (F.get(g, F.lit(0)) < F.get(g, F.lit(1))) & (F.get(g, F.lit(1)) < F.get(g, F.lit(2))))


@register(f"with {_S}, {_K}, n as (select series, t, k, lead(k) {_W}) as k2 from s) select series, t as start from n, k0 where k = a and k2 = b")
def w17_find(spark, d):
    kinds = T._kinds(spark, d)
    return subsequences.find(T._series(spark, d), [kinds[0], kinds[-1]], "k")


@register(f"with {_S}, {_K}, m as (select series, t from s, k0 where k = a), c as (select series, coalesce(lag(e) over (partition by series order by t), 0) as start, t as \"end\" from (select series, t, t + 1 as e from m union all select series, max(t) + 1, max(t) + 1 from s group by series)) select * from c where \"end\" > start")
def w16_between_matches(spark, d):
    s = T._series(spark, d)
    return subsequences.between(s, subsequences.find(s, T._kinds(spark, d)[:1], "k"), 1)


@register(f"with {_S}, {_K}, n as (select series, t, k, lag(x, 2) {_W}) as p, x + lag(x, 1) {_W}) + lag(x, 2) {_W}) + lead(x, 1) {_W}) as total from s) select series, t as start, round(total, 4) as total from n, k0 where k = a and total is not null")
def w18_around_matches(spark, d):
    s = T._series(spark, d)
    near = subsequences.around(s, subsequences.find(s, T._kinds(spark, d)[:1], "k"), 2, 2)
    return near.select("series", "start", F.round(A.total(F.col("near")), 4).alias("total"))


@register(f"with {_S}, n as (select series, t, x, max(x) {_W} rows between 2 preceding and 1 preceding) as p, max(x) {_W} rows between 1 following and 2 following) as f from s) select series, t as i from n where x > coalesce(p, -1e300) and x > coalesce(f, -1e300)")
def w10_separate_maxima(spark, d):
    rows = T._series(spark, d).groupBy("series").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "x"))), lambda s: s["x"]).alias("a"))
    return rows.select("series", F.explode(F.transform(subsequences.separate_maxima(F.col("a"), 3), lambda i: i.cast("long"))).alias("i"))


@register(f"with {_S}, l as (select event_type as g, user_id as series, count(*) as n from events group by all) select g, series, coalesce(sum(n + 5) over (partition by g order by series rows between unbounded preceding and 1 preceding), 0)::bigint as \"offset\" from l")
def u04_concatenated(spark, d):
    rows = table(spark, d, "events").groupBy(F.col("event_type").alias("g"), F.col("user_id").alias("series")).agg(F.collect_list("value").alias("values"))
    return subsequences.concatenated(rows, "g", "series", 5).select("g", "series", "offset")


_UNION = "select series, min(s) as s, max(e) as e from (select *, sum(new) over (partition by series order by s, e) as n from (select *, case when s >= max(e) over (partition by series order by s, e rows between unbounded preceding and 1 preceding) then 1 else 0 end as new from {t})) group by series, n"


@register(f"with {_R}, a as ({_UNION.format(t='ra')}), b as ({_UNION.format(t='rb')}), i as (select coalesce(sum(greatest(0, least(a.e, b.e) - greatest(a.s, b.s))), 0)::bigint as inter from a join b on a.series = b.series and a.s < b.e and b.s < a.e), n as (select inter, (select sum(e - s) from a)::bigint + (select sum(e - s) from b)::bigint - inter as total from i) select inter, total, round(inter / total, 6) as iou from n")
def e03_total_iou(spark, d):
    kinds = T._kinds(spark, d)
    return evaluate.total_iou(T._ranges(spark, d, kinds[0]), T._ranges(spark, d, kinds[-1])).select("inter", "total", F.round("iou", 6).alias("iou"))


@register(f"""with recursive {_R}, {T._GREEDY.format(pairs=T._NEAR)}, c as (select (select count(*) from ra) as reported, (select count(*) from rb) as true_n, (select count(*) from taken) as matches)
 select reported, true_n, matches, matches / reported as precision, matches / true_n as recall, 2 * matches / (reported + true_n) as f1 from c""")
def e04_match_stats(spark, d):
    kinds = T._kinds(spark, d)
    return evaluate.match_stats(T._ranges(spark, d, kinds[0]), T._ranges(spark, d, kinds[-1]))


@register("select event_type, chunk, count(*) as n from (select event_type, (row_number() over (partition by event_type order by event_id) - 1) // 100 as chunk from events) group by all")
def e09_chunks(spark, d):
    return subsequences.chunked(table(spark, d, "events"), "event_type", "event_id", 100).groupBy("event_type", "chunk").agg(F.count("*").alias("n"))


@register("select event_id, round(gamma(1 + value / 100), 6) as gamma, round(lgamma(1 + value), 6) as lgamma, round(pow(2, value / 50), 6) as power, (value > 20) and not (value > 60) as both, not ((value > 20) or (value > 60)) as nor from events")
def f09_special(spark, d):
    x = F.col("value")
    return table(spark, d, "events").select("event_id", F.round(special.tgamma(1 + x / 100), 6).alias("gamma"), F.round(special.lgamma(1 + x), 6).alias("lgamma"), F.round(special.exp2(x / 50), 6).alias("power"), special.LOGIC["and"](x > 20, ~(x > 60)).alias("both"), special.LOGIC["nor"](x > 20, x > 60).alias("nor"))


@register("select o_orderkey, (o_orderkey & o_custkey)::bigint as both, (o_orderkey | o_custkey)::bigint as either, (-1 - (o_orderkey & o_custkey))::bigint as nand, (-1 - xor(o_orderkey, o_custkey))::bigint as xnor, (o_orderkey & (o_orderkey - 1))::bigint as less from orders")
def f05_bit_logic(spark, d):
    a, b = F.col("o_orderkey").cast("long"), F.col("o_custkey").cast("long")
    return table(spark, d, "orders").select("o_orderkey", *(special.BITS[op](a, b).alias(n) for op, n in (("and", "both"), ("or", "either"), ("nand", "nand"), ("xnor", "xnor"))), special.unset_lowest(a).alias("less"))


@register("with m as (select l_orderkey, list(distinct l_linenumber) as ks from lineitem group by l_orderkey) select l_orderkey, list_max(list_filter(ks, lambda k: k < 4))::int as below, list_min(list_filter(ks, lambda k: k >= 4))::int as at, len(ks) as n from m")
def f17_small_maps(spark, d):
    m = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.map_from_entries(F.array_distinct(F.collect_list(F.struct(F.col("l_linenumber").cast("int").alias("k"), F.lit(1).alias("v"))))).alias("m"))
    return m.select("l_orderkey", special.keys_below(F.col("m"), F.lit(4)).alias("below"), special.keys_from(F.col("m"), F.lit(4)).alias("at"), F.size("m").cast("long").alias("n"))


@register(f"with {_V} select vec_id, e[4]::double as a, e[1]::double as b, e[4]::double as c from v")
def p27_sampled_dims(spark, d):
    s = sketches.sample_dims(F.col("embedding").cast("array<double>"), [3, 0, 3])
    return Q._data(spark, d).select("vec_id", *(F.get(s, F.lit(i)).alias(n) for i, n in enumerate("abc")))


@register(f"with {_V}, u as (select generate_subscripts(e, 1) - 1 as dim, unnest(e) as x from v), s as (select list(m order by dim) as ms, max(sd) as sd from (select dim, avg(x) as m, stddev_pop(x) as sd from u group by dim)) select vec_id, round((e[2] - ms[2]) / sd, 6) as z from v, s")
def p04_one_scale(spark, d):
    """Dimensions less their means, over the largest of their deviations."""
    data = Q._data(spark, d)
    return vectors.one_scale(data, data).select("vec_id", F.round(F.get("embedding", F.lit(1)), 6).alias("z"))
