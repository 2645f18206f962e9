"""Queries over files: tables are written in the formats that the readers know, to the session's shared folder, and read back."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import functions as F

from strandline.plans import search_queries as Q
from strandline.plans import series_queries as T
from strandline.plans._register import Register, table
from strandline.plans.model_queries import _summed, _sums
from strandline.operators import search
from strandline.sources import catalog, recordings, vectors

register = Register()
QUERIES, ORACLE_SQL = register.queries, register.sql
_V, _S, _K, _R, _W = Q._V, T._S, T._K, T._R, T._W


def _folder(spark, name: str) -> str:
    """A new folder where all executors see it: below ``spark.checkpoint.dir``, or on this machine where a local session names none."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = tempfile.mkdtemp(prefix="strandline-files-")
        atexit.register(shutil.rmtree, shared, True)
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _lines(df, *columns, sep: str = " "):
    return df.select(F.concat_ws(sep, *columns).alias("value"))


def _numbers(sep: str = " "):
    """A vector as text, with all digits that its doubles need."""
    return F.concat_ws(sep, F.transform(F.col("embedding").cast("array<double>"), lambda x: x.cast("string")))


@register(f"with {_V}, w as (select vec_id, e from v) {_sums('w').replace('vec_id, ', '')}")
def s01_matrix_text(spark, d):
    path = _folder(spark, "matrix") + ".txt"
    _lines(Q._data(spark, d), _numbers()).write.text(path)
    return _summed(vectors.read_matrix(spark, path).withColumnRenamed("row", "vec_id")).drop("vec_id")


@register(f"with {_V}, w as (select label as vec_id, e from v) {_sums('w')}")
def s08_labelled_series(spark, d):
    path = _folder(spark, "series")
    _lines(Q._data(spark, d), F.col("label").cast("string"), _numbers(","), sep=",").write.text(path)
    read = vectors.read_labelled_series(spark, path)
    return _summed(read.select(F.col("label").alias("vec_id"), F.col("values").alias("embedding")))


@register("select round(least(80, greatest(20, value)), 4) as value, case when user_id = 7 then null else least(80, greatest(20, user_id))::double end as \"user\" from events")
def s10_recording(spark, d):
    """A table of samples without its time column, a sentinel of the users missing, and values clipped."""
    path = _folder(spark, "recording")
    table(spark, d, "events").select("event_id", F.round("value", 4), "user_id", F.lit(1)).write.csv(path)
    read = vectors.read_recording(spark, path, sentinel={"user": 7.0}, clip=(20.0, 80.0), columns=["at", "value", "user", "null_1"])
    return read.select("value", "user")


@register(f"with {_R}, o as (select series, s as start, e as \"end\", k0.a as label from ra, k0 union all select series, s, e, k0.b from rb, k0), n as (select *, lead(label) over w as l2, lead(start) over w as s2, lead(\"end\") over w as e2 from o window w as (partition by series order by start, \"end\", label)) select label, count(*) as n, sum(\"end\" - start)::bigint as size from (select label, start, \"end\" from o union all select 'both', start, e2 from n, k0 where label = k0.a and l2 = k0.b and s2 - \"end\" <= 1) group by label")
def s11_composite_labels(spark, d):
    """Annotations in a text file, with one more for each first kind that the last kind follows closely."""
    kinds, path = T._kinds(spark, d), _folder(spark, "annotations")
    both = T._ranges(spark, d, kinds[0]).unionByName(T._ranges(spark, d, kinds[-1]))
    _lines(both, *(F.col(c).cast("string") for c in ("start", "end")), F.concat_ws("|", F.col("series").cast("string"), "label")).write.text(path)
    read = vectors.read_annotations(spark, path).select(F.split("label", r"\|")[0].cast("long").alias("series"), "start", "end", F.split("label", r"\|")[1].alias("label"))
    out = vectors.composite_labels(read, (kinds[0],), kinds[-1], 1, "both")
    return out.groupBy("label").agg(F.count("*").alias("n"), F.sum(F.col("end") - F.col("start")).alias("size"))


@register("select user_id as time, round(value, 4) as x, -event_id::double as y from events where value <> 0 or event_id <> 0")
def s13_frames(spark, d):
    """Frames in text files, first their time; those of zeros alone go."""
    path = _folder(spark, "frames")
    _lines(table(spark, d, "events"), F.col("user_id").cast("string"), F.round("value", 4).cast("string"), (-F.col("event_id")).cast("string")).write.text(path)
    read = recordings.read_frames(spark, path)
    return read.select(F.col("time").cast("long").alias("time"), F.get("values", F.lit(0)).alias("x"), F.get("values", F.lit(1)).alias("y"))


@register(f"with {_S} select event_id, k from s where t < 2")
def s14_tags(spark, d):
    """Lines ``ticks;label`` behind a header, whose time is told from ticks."""
    path = _folder(spark, "tags")
    first = T._series(spark, d).filter("t < 2")
    spark.range(1).select(F.lit("ticks;label").alias("value")).union(_lines(first, (F.col("event_id") * 10 + 5).cast("string"), F.col("k"), sep=";")).write.text(path)
    read = recordings.read_tags(spark, path, ticks=10.0, origin=5.0)
    return read.select(F.col("time").cast("long").alias("event_id"), F.col("label").alias("k"))


@register("select user_id as speaker, event_type as word, count(*) as n from events group by all")
def s17_name_parts(spark, d):
    """Speaker and word, from names of files like ``12_click_7.wav``."""
    names = table(spark, d, "events").select(F.concat(F.lit("/sound/"), F.col("user_id").cast("string"), F.lit("_"), "event_type", F.lit("_"), F.col("event_id").cast("string"), F.lit(".wav")).alias("path"))
    speaker, word = recordings.name_parts(F.col("path"), r"^(\d+)_(.+)_\d+\.wav$", ["speaker", "word"])
    return names.select(speaker.cast("long").alias("speaker"), word).groupBy("speaker", "word").agg(F.count("*").alias("n"))


_FRAME = "list_transform(range(0, 16), lambda k: e[f * 8 + k + 1] * (0.5 - 0.5 * cos(2 * pi() * k / 15)))"


@register(f"with {_V}, f as (select vec_id, f, {_FRAME} as w from v, range(0, 7) r(f)) select vec_id, f as frame, round(list_sum([sqrt(pow(list_sum([w[k + 1] * cos(2 * pi() * j * k / 16) for k in range(0, 16)]), 2) + pow(list_sum([w[k + 1] * sin(2 * pi() * j * k / 16) for k in range(0, 16)]), 2)) for j in range(0, 9)]), 6) as total from f")
def s18_spectra(spark, d):
    """Magnitudes of the Fourier transform of windowed frames, summed, of the vectors as short sounds."""
    sound = Q._data(spark, d).select(F.col("vec_id").cast("string").alias("path"), F.lit(100).alias("rate"), F.col("embedding").cast("array<double>").alias("samples"))
    made = recordings.audio_features(sound, "stft", window=16, step=8)
    return made.select(F.col("path").cast("long").alias("vec_id"), "frame", F.round(F.aggregate("features", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@register("select o_orderkey, o_custkey, round(o_totalprice, 2) as o_totalprice from orders")
def s22_sink(spark, d):
    """Written as CSV with sorted columns, and read back."""
    path = vectors.save_table(table(spark, d, "orders").select("o_totalprice", "o_orderkey", "o_custkey"), _folder(spark, "sink"))
    read = spark.read.csv(path, header=True, schema="o_custkey bigint, o_orderkey bigint, o_totalprice double")
    return read.select("o_orderkey", "o_custkey", F.round("o_totalprice", 2).alias("o_totalprice"))


@register("select 'scan ' || o_orderkey as name, i as trial, (o_custkey % 100 + i + 0.5)::double as ms from orders, range(0, 2) r(i) where o_orderkey < 2000")
def s23_profiler_text(spark, d):
    path = _folder(spark, "times")
    o = table(spark, d, "orders").filter("o_orderkey < 2000")
    ms = [(F.col("o_custkey") % 100 + i + 0.5).cast("string") for i in range(2)]
    o.select(F.concat(F.lit("scan "), F.col("o_orderkey").cast("string"), F.lit(" (10x5): "), ms[0], F.lit(" (3.1/s), "), ms[1], F.lit(" (2.9/s)")).alias("value")).write.text(path)
    return vectors.profiler_times(spark, path).select("name", F.col("trial").cast("long").alias("trial"), "ms")


@register("select part, count(*) as n from (select 'train' as part from embeddings where vec_id % 10 <> 0 union all select 'test' from embeddings where vec_id % 10 <> 0 union all select 'queries' from embeddings where vec_id % 10 = 0) group by part")
def s05_named_set(spark, d):
    """A named set without training rows, which are then the test rows, and without truth."""
    root = _folder(spark, "sets")
    data = Q._data(spark, d)
    data.filter("vec_id % 10 <> 0").write.parquet(f"{root}/own/test.parquet")
    data.filter("vec_id % 10 = 0").write.parquet(f"{root}/own/queries.parquet")
    out = None
    for name, df in vectors.load_bundle(spark, root, "own").items():
        if df is not None:
            part = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n")
            out = part if out is None else out.unionAll(part)
    return out


@register("select vec_id, round(x, 6) as x from (select i as vec_id, (i // 8 % 2)::double as x from range(0, 100) r(i))")
def s07_synthetic_grid(spark, d):
    """Where the points of a grid lie that made-up blobs are drawn about: the fourth dimension, to the next whole number."""
    made = vectors.synthetic(spark, "blobs", 100, 5, seed=4)
    return made.select("vec_id", F.round(F.rint(F.get("embedding", F.lit(3))), 6).alias("x"))


@register(f"with {_S}, r as (select k, series, t, row_number() over (partition by series order by t) - row_number() over (partition by series, k order by t) as g from s), n as (select series, k, min(t) as start, max(t) + 1 as \"end\" from r group by series, k, g) select series, start, \"end\", k as label from n where \"end\" - start >= 2")
def s16_segments(spark, d):
    return recordings.segments(T._series(spark, d), "k", 2)


@register(f"with {_S}, n as (select series, t, row_number() over (partition by series, k order by t) as r, k, k0.a as a from s, k0) select series, t as start from n where k <> a or r <= 2".replace("from s, k0", "from s, k0").replace("with s as", f"with {_K}, s as"))
def s12_first_of_each(spark, d):
    """Annotations of which only the first two of one kind are kept in each series."""
    marks = T._series(spark, d).select("series", F.col("t").alias("start"), F.col("k").alias("label"))
    return recordings.first_of_each(marks, 2, T._kinds(spark, d)[0]).select("series", "start")



@register("select label, count(*) as n, min(size)::bigint as least, max(size)::bigint as most from (select 1 as label, 30 as size from range(0, 4) union all select 0, 30 from range(0, 5)) group by label")
def s19_named_labelled_set(spark, d):
    """Stretches of a series with planted shapes, at most four instances of them, cut to 30 values."""
    rows = catalog.load(spark, "planted_triangle", fewest=2, most=5, longest=30).filter("label = 0 or series < 8")
    return rows.groupBy("label").agg(F.count("*").alias("n"), F.min(F.size("values")).cast("long").alias("least"), F.max(F.size("values")).cast("long").alias("most"))


_DECIMATED = "list_transform(range(-40, 41), lambda k: case when k = 0 then 1.0 else sin(pi() * k / 2) / (pi() * k / 2) end * (0.54 - 0.46 * cos(2 * pi() * (k + 40) / 80)))"


@register(f"with {_V}, f as (select list_transform(w, lambda x: x / list_sum(w)) as w from (select {_DECIMATED} as w)), o as (select vec_id, i, list_sum([w[k + 41] * e[greatest(1, least(64, 2 * i + 1 + k))] for k in range(-40, 41)]) as x from v, f, range(0, 32) r(i)) select vec_id, round(sum(x), 6) as total, round(sum(x * x), 6) as squares from o group by vec_id")
def p22_decimated(spark, d):
    """Every second value after a low-pass filter, with the ends held."""
    made = recordings.decimate(Q._data(spark, d).select("vec_id", "embedding"), 2, "embedding")
    return made.select("vec_id", F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x), 6).alias("total"), F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x), 6).alias("squares"))


@register(f"{Q._PAIRS} " + Q._TOP.format(order="dist", where="where qid <> vec_id", k=4))
def n09_index_of_parts(spark, d):
    """Dimensions by variance first, then the abandoning scan."""
    index = search.Index(spark, Q._data(spark, d), search.by_variance)
    return Q._out(index.knn(Q._queries(spark, d), 4, exclude_self=True, how="abandon"))


@register(f"{Q._PAIRS} select qid, vec_id, dist from p where dist < 1.3")
def n10_index_radius(spark, d):
    """Vectors and queries less the means, which leaves distances as they are."""
    found = search.Index(spark, Q._data(spark, d), search.less_means).radius(Q._queries(spark, d), 1.3)
    return found.select("qid", "vec_id", F.round("dist", 6).alias("dist"))
