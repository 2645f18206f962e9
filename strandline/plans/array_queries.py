"""Queries over array and scalar functions, relational basics and text n-grams."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandline.functions import arrays as A
from strandline.operators import intervals, series
from strandline.plans._register import Register, table

register = Register()
QUERIES, ORACLE_SQL = register.queries, register.sql


def _orders(spark, d):
    """The quantities of an order, by line number, as an array."""
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", F.col("l_quantity").cast("double").alias("q"), F.col("l_discount").cast("double").alias("c")))).alias("r"))
    return rows.select("l_orderkey", F.transform("r", lambda s: s["q"]).alias("a"), F.transform("r", lambda s: s["c"]).alias("b"))


_A = "o as (select l_orderkey, list(l_quantity::double order by l_linenumber, l_quantity, l_discount) as a, list(l_discount::double order by l_linenumber, l_quantity, l_discount) as b from lineitem group by l_orderkey)"


@register(f"with {_A} select l_orderkey, round(list_sum(list_transform(list_zip(a, b), lambda z: z[1] + z[2])), 4) as added, round(list_sum(list_transform(list_zip(a, b), lambda z: z[1] * z[2])), 4) as product, round(list_sum(list_transform(a, lambda x: x / 4)), 4) as quarter, round(list_sum(list_transform(list_zip(a, b), lambda z: greatest(z[1], z[2] * 300))), 4) as larger from o")
def f01_elementwise(spark, d):
    a, b = F.col("a"), F.col("b")
    return _orders(spark, d).select("l_orderkey", F.round(A.total(A.elementwise(a, b, lambda x, y: x + y)), 4).alias("added"), F.round(A.total(A.elementwise(a, b, lambda x, y: x * y)), 4).alias("product"), F.round(A.total(A.scalar(a, 4.0, lambda x, c: x / c)), 4).alias("quarter"), F.round(A.total(A.elementwise(a, b, lambda x, y: F.greatest(x, y * 300))), 4).alias("larger"))


@register(f"with {_A} select l_orderkey, list_sum(a) as total, list_sum(list_transform(a, lambda x: x * x)) as squares, list_min(a) as lo, list_max(a) as hi, (list_position(a, list_min(a)) - 1)::bigint as at_lo, len(list_distinct(a)) as kinds, len(list_filter(a, lambda x: x > 25)) as large from o")
def a04_array_statistics(spark, d):
    a = F.col("a")
    return _orders(spark, d).select("l_orderkey", A.total(a).alias("total"), A.sum_squares(a).alias("squares"), F.array_min(a).alias("lo"), F.array_max(a).alias("hi"), A.argmin(a).cast("long").alias("at_lo"), F.size(F.array_distinct(a)).cast("long").alias("kinds"), F.size(F.filter(a, lambda x: x > 25)).cast("long").alias("large"))


@register(f"with {_A} select l_orderkey, array_to_string(list_transform(list_sort(list_transform(range(1, len(a) + 1), lambda i: (a[i] * 1000 + i)::bigint)), lambda v: (v % 1000 - 1)::bigint), ',') as places, array_to_string(list_transform(list_reverse_sort(a), lambda x: x::bigint), ',') as sorted from o")
def t01_argsort(spark, d):
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("long").cast("string")), ",")
    return _orders(spark, d).select("l_orderkey", text(A.argsort(F.col("a"))).alias("places"), text(A.sort_by_magnitude(F.col("a"))).alias("sorted"))


@register(f"with {_A} select l_orderkey, array_to_string(list_transform(list_reverse(a), lambda x: x::bigint), ',') as turned, array_to_string(list_transform(range(0, 5), lambda i: a[floor(i * len(a) / 5.0)::int + 1]::bigint), ',') as five, array_to_string(list_transform(list_concat([a[1], a[1]], list_concat(a, [a[-1]])), lambda x: x::bigint), ',') as edged, array_to_string(list_transform(list_concat([0.0], list_concat(a, [0.0])), lambda x: x::bigint), ',') as zeroed from o")
def p19_reshaped(spark, d):
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("long").cast("string")), ",")
    a = F.col("a")
    return _orders(spark, d).select("l_orderkey", text(F.reverse(a)).alias("turned"), text(A.resample(a, 5)).alias("five"), text(A.pad(a, 2, 1, "edge")).alias("edged"), text(A.pad(a, 1, 1)).alias("zeroed"))


@register(f"with {_A} select l_orderkey, (list_position(a, 30.0) - 1)::bigint as found, list_contains(a, 30.0) as has, len(list_filter(a, lambda x: x >= 1)) = len(a) as every, len(list_filter(a, lambda x: x > 45)) > 0 as any_large, coalesce(list_sum(list_transform(list_filter(range(1, len(a) + 1), lambda i: i % 2 = 1), lambda i: a[i])), 0.0) as odd from (select l_orderkey, a, coalesce(a, []) from o)".replace("(list_position(a, 30.0) - 1)", "(coalesce(list_position(a, 30.0), 0) - 1)"))
def p07_find_and_test(spark, d):
    a = F.col("a")
    return _orders(spark, d).select("l_orderkey", A.find(a, F.lit(30.0)).cast("long").alias("found"), F.array_contains(a, 30.0).alias("has"), F.forall(a, lambda x: x >= 1).alias("every"), F.exists(a, lambda x: x > 45).alias("any_large"), A.total(F.get(A.deinterleave(a, 2), F.lit(0))).alias("odd"))


@register("select o_orderkey, round(sqrt(o_totalprice), 6) as root, round(ln(o_totalprice), 6) as log_e, round(log2(o_totalprice), 6) as log_2, round(cbrt(o_totalprice), 6) as cube, round(sin(o_totalprice / 1000), 6) as sine, round(atan(o_totalprice / 1e5), 6) as arc, ceil(o_totalprice / 7)::bigint as up, floor(o_totalprice / 7)::bigint as down from orders")
def f07_scalar_functions(spark, d):
    x = F.col("o_totalprice").cast("double")
    return table(spark, d, "orders").select("o_orderkey", F.round(F.sqrt(x), 6).alias("root"), F.round(F.ln(x), 6).alias("log_e"), F.round(F.log2(x), 6).alias("log_2"), F.round(F.cbrt(x), 6).alias("cube"), F.round(F.sin(x / 1000), 6).alias("sine"), F.round(F.atan(x / 1e5), 6).alias("arc"), F.ceil(x / 7).cast("long").alias("up"), F.floor(x / 7).cast("long").alias("down"))


@register("select o_orderkey, bit_count(o_orderkey)::int as ones, (o_orderkey & 255)::bigint as low, xor(o_orderkey, 85)::bigint as flipped, (o_orderkey | 1024)::bigint as raised, (o_orderkey << 3)::bigint as moved, case when o_orderkey = 0 then -1 else floor(log2(greatest(o_orderkey, 1)))::int end as top, case when o_orderkey = 0 then -1 else (bit_count((o_orderkey & -o_orderkey) - 1))::int end as bottom from orders")
def f16_bits(spark, d):
    k = F.col("o_orderkey").cast("long")
    return table(spark, d, "orders").select("o_orderkey", F.bit_count(k).alias("ones"), k.bitwiseAND(F.lit(255)).alias("low"), k.bitwiseXOR(F.lit(85)).alias("flipped"), k.bitwiseOR(F.lit(1024)).alias("raised"), F.shiftleft(k, 3).alias("moved"), A.highest_bit(k).cast("int").alias("top"), A.lowest_bit(k).cast("int").alias("bottom"))


@register("""select event_id, round(0.5 * (1 + sign(z) * (1 - ((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t * exp(-z * z / 2))), 6) as p
 from (select event_id, z, 1 / (1 + 0.3275911 * abs(z) / sqrt(2)) as t from (select event_id, (value - 50) / 25 as z from events))""")
def f15_normal_cdf(spark, d):
    return table(spark, d, "events").select("event_id", F.round(A.normal_cdf((F.col("value") - 50) / 25), 6).alias("p"))


@register("select i::int as i, round(0.54 - 0.46 * cos(2 * pi() * i / 15), 6) as hamming, round(0.5 - 0.5 * cos(2 * pi() * i / 15), 6) as hann, round(3 * pow(1.5, i), 6) as geometric from range(16) r(i)")
def w20_window_weights(spark, d):
    rows = list(zip(range(16), A.window_weights("hamming", 16), A.window_weights("hann", 16), strict=True))
    return spark.createDataFrame(rows, "i int, hm double, hn double").select("i", F.round("hm", 6).alias("hamming"), F.round("hn", 6).alias("hann"), F.round(3 * F.pow(F.lit(1.5), "i"), 6).alias("geometric"))


@register("select a.l_orderkey, a.l_linenumber::int as i, b.l_linenumber::int as j, greatest(0, least(a.e, b.e) - greatest(a.s, b.s)) as common, round(greatest(0, least(a.e, b.e) - greatest(a.s, b.s)) / ((a.e - a.s) + (b.e - b.s) - greatest(0, least(a.e, b.e) - greatest(a.s, b.s))), 6) as iou from (select l_orderkey, l_linenumber, l_linenumber * 5 as s, l_linenumber * 5 + l_quantity::double as e from lineitem) a join (select l_orderkey, l_linenumber, l_linenumber * 5 as s, l_linenumber * 5 + l_quantity::double as e from lineitem) b on a.l_orderkey = b.l_orderkey and a.l_linenumber < b.l_linenumber")
def u05_interval_overlap(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("int").alias("i"), (F.col("l_linenumber") * 5).cast("double").alias("s"), (F.col("l_linenumber") * 5 + F.col("l_quantity").cast("double")).alias("e"))
    other = rows.select("l_orderkey", F.col("i").alias("j"), F.col("s").alias("s2"), F.col("e").alias("e2"))
    both = rows.join(other, "l_orderkey").filter("i < j")
    s, e, s2, e2 = (F.col(c) for c in ("s", "e", "s2", "e2"))
    return both.select("l_orderkey", "i", "j", intervals.intersection(s, e, s2, e2).cast("double").alias("common"), F.round(intervals.iou(s, e, s2, e2), 6).alias("iou"))


@register("select s_nationkey as key from supplier union select c_nationkey from customer")
def u02_distinct_union(spark, d):
    return table(spark, d, "supplier").select(F.col("s_nationkey").alias("key")).union(table(spark, d, "customer").select("c_nationkey")).distinct()


@register("select c_custkey from customer where c_custkey not in (select o_custkey from orders)")
def u06_difference(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey")


@register("select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as quantity, round(avg(l_extendedprice), 2) as price, round(corr(l_quantity::double, l_extendedprice::double), 6) as r, count(*) as n from lineitem group by all")
def a10_grouped_correlation(spark, d):
    q, p = F.col("l_quantity").cast("double"), F.col("l_extendedprice").cast("double")
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum(q), 2).alias("quantity"), F.round(F.avg(p), 2).alias("price"), F.round(F.corr(q, p), 6).alias("r"), F.count("*").alias("n"))


@register("select o_custkey, rank::bigint as rank, o_orderkey from (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as rank from orders) where rank <= 3")
def t06_top_k(spark, d):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, d, "orders").withColumn("rank", F.row_number().over(w)).filter("rank <= 3").select("o_custkey", F.col("rank").cast("long").alias("rank"), "o_orderkey")


@register("select word, count(*) as n, count(distinct doc_id) as docs from (select doc_id, unnest(string_split(lower(text), ' ')) as word from documents) where word <> '' group by word")
def a11_unique_words(spark, d):
    words = table(spark, d, "documents").select("doc_id", F.explode(F.split(F.lower("text"), " ", -1)).alias("word")).filter("word <> ''")
    return series.unique_counts(words, "word", "doc_id").withColumnRenamed("groups", "docs")


@register(f"with {_A} select l_orderkey, pos::bigint as pos, round(total, 4) as total from (select l_orderkey, unnest(range(0, len(a) - 1)) as pos, unnest(list_transform(range(1, len(a)), lambda i: a[i] + a[i + 1])) as total from o)")
def w13_sliding_windows(spark, d):
    rows = _orders(spark, d).select("l_orderkey", F.posexplode(A.subsequences(F.col("a"), 2)).alias("pos", "w"))
    return rows.select("l_orderkey", F.col("pos").cast("long").alias("pos"), F.round(A.total(F.col("w")), 4).alias("total"))


@register(f"with {_A}, w as (select l_orderkey, unnest(range(0, len(a))) as i, a from o), p as (select l_orderkey, i from w where a[i + 1] >= coalesce(case when i > 0 then a[i] end, a[i + 1]) and a[i + 1] >= coalesce(a[i + 2], a[i + 1])) select l_orderkey, i::bigint as i from p")
def w09_local_maxima(spark, d):
    return _orders(spark, d).select("l_orderkey", F.explode(F.transform(A.local_maxima(F.col("a")), lambda i: i.cast("long"))).alias("i"))
