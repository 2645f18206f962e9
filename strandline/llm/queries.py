"""The registered queries of the training-data operators: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strandline.llm import ann, bpe, flac, langid, packing, pii, quality, sharding, simhash, suffix

SHARDS = 40
#: Files of the public tokenizers, found by the package that ships them; pass another path to use other ones.
RANKS, WORDS = "byte_bpe_multi_50k.tiktoken", "word_bpe_49k.json"


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def split_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_rp_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.neighbours(spark, _table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 20 == 0, k=20)


def op2_byte_bpe(spark: SparkSession, sf_dir: str, ranks: str | None = None) -> DataFrame:
    return bpe.digests(_table(spark, sf_dir, "documents"), ranks or tokenizer_file(RANKS), split_pattern(), at_blanks=True)


def op3_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(spark, _table(spark, sf_dir, "documents"), SHARDS)


def op4_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flac.digests(_table(spark, sf_dir, "documents"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.removed_spans(spark, _table(spark, sf_dir, "documents")).drop("removed")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.predictions(spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_packing(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    return packing.pack(spark, _table(spark, sf_dir, "documents"), tokenizer or tokenizer_file(WORDS))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predictions(spark, _table(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.clusters(spark, _table(spark, sf_dir, "documents"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(spark, _table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_rp_forest, op2_byte_bpe, op3_byte_shards, op4_flac, op5_suffix_dedup, op6_quality, op7_packing, op8_language, op9_simhash, op10_pii)
}
#: Sizes summed in the order of the file, cut at equal targets; the checksum is folded over a text's bytes, by a table that its rule gives.
_OP3 = """with t as (select list(c order by i) as t from (select i, list_reduce(list_prepend(i, range(0, 8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as c from range(0, 256) r(i))),
 d as (select row_number() over () as r, doc_id, hex(encode(coalesce(text, ''))) as h from documents),
 s as (select r, doc_id, h, (length(h) // 2 + 16)::bigint as size from d),
 m as (select *, sum(size) over (order by r) * 2 - size as middle, sum(size) over () as whole from s),
 p as (select *, least(39, middle * 40 // (2 * whole))::int as shard from m),
 c as (select r, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, length(h) // 2), lambda k: ('0x' || substring(h, 2 * k + 1, 2))::bigint)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)::bigint as crc from s, t)
 select doc_id, size, crc as text_crc32, 'bytes' as law, shard, row_number() over (partition by shard order by r) - 1 as slot, null::int as grown_shard from p join c using (r)"""
#: Every window of 200 bytes as hexadecimal text, those that stand twice, the runs that they cover, and what is left between the runs.
_OP5 = """with d as (select row_number() over () as r, doc_id, hex(encode(coalesce(text, ''))) as h from documents),
 n as (select r, doc_id, h, length(h) // 2 as n from d),
 w as (select r, i, substring(h, 2 * i - 1, 400) as s from n, unnest(range(1, greatest(n - 198, 1))) t(i)),
 twice as (select s from w group by s having count(*) > 1),
 hits as (select r, i, case when i > coalesce(lag(i) over (partition by r order by i) + 200, 0) then 1 else 0 end as new from w join twice using (s)),
 runs as (select r, min(i) as a, max(i) + 199 as z from (select r, i, sum(new) over (partition by r order by i) as k from hits) group by r, k),
 cuts as (select r, coalesce(lag(z) over (partition by r order by a), 0) + 1 as x, a - 1 as y from runs union all select n.r, coalesce(max(z), 0) + 1, any_value(n) from n left join runs on n.r = runs.r group by n.r),
 kept as (select cuts.r, string_agg(substring(h, 2 * x - 1, 2 * (y - x + 1)), '' order by x) as k from cuts join n on n.r = cuts.r where y >= x group by cuts.r),
 sums as (select r, sum(z - a + 1)::bigint as n_removed, count(*) as n_spans from runs group by r)
 select doc_id, n as n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans, sha256(unhex(coalesce(k, ''))) as kept_sha256 from n left join sums using (r) left join kept using (r)"""
#: The others can't be said in SQL (learned or fitted models, rank tables, hashes that SQL lacks); their tests hold them against brute force, round trips
#: or held-out labels.
ORACLE_SQL: dict[str, str] = {"op3_byte_shards": _OP3, "op5_suffix_dedup": _OP5}
