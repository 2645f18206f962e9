"""The registered operators and the pipeline on small tables with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from strandline.llm import ann, bpe, flac, langid, packing, pii, quality, queries, sharding, simhash, suffix

RNG = np.random.default_rng(1)
WORDS = ["the", "river", "house", "and", "walks", "green", "often", "stone", "light", "from"]
AUTRES = ["le", "fleuve", "maison", "et", "marche", "vert", "souvent", "pierre", "lumière", "depuis"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, u1 string, score string, rank int, chunk string"


def prose(n, words=WORDS):
    return " ".join(RNG.choice(words, n))


@pytest.fixture(scope="module")
def rows():
    shared = prose(80)
    texts = [prose(60) for _ in range(30)] + [prose(60, AUTRES) for _ in range(20)]
    texts += [texts[0], texts[0], None, "", "   ", "12 34", "x" * 700, prose(9000), shared, prose(40) + " " + shared + " " + prose(40), texts[1] + " end", "é" * 300, "mail me at a.b@c.org"]
    out = [(i, t, "fr" if 30 <= i < 50 else "en", f"s{i % 3}", 1, 5, "u", "sc", 3, "c") for i, t in enumerate(texts)]
    return out + [(None, "no id here", "en", "s", 1, 5, "u", "sc", 3, "c"), (7, texts[7], "en", "s", 1, 5, "u", "sc", 3, "c"), (8, "the same id again", None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def texts_by_row(rows):
    return Counter((r[0], r[1] or "") for r in rows)


def test_bpe(docs, none, rows):
    path, pattern = queries.tokenizer_file(queries.RANKS), queries.split_pattern()
    got = Counter((r.doc_id, r.decoded_sha256) for r in bpe.digests(docs, path, pattern).collect())
    assert got == Counter((i, hashlib.sha256((t or "").encode()).hexdigest()) for i, t, *_ in rows)
    assert bpe.digests(none, path, pattern).count() == 0
    back = bpe.detokenize(bpe.tokenize(docs.select("doc_id", "text"), path, pattern), path, pattern).collect()
    assert all(bytes(r.decoded).decode() == (r.text or "") for r in back)


def test_shards(spark, docs, none, rows):
    got = sharding.shard_documents(spark, docs, 5).collect()
    assert Counter((r.doc_id, r.text_crc32) for r in got) == Counter((i, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    sizes = [sum(r.size for r in got if r.shard == k) for k in range(5)]
    assert max(sizes) - min(sizes) <= 2 * max(r.size for r in got)
    for k in range(5):
        mine = sorted(r.slot for r in got if r.shard == k)
        assert mine == list(range(len(mine)))
    assert sharding.shard_documents(spark, none, 5).count() == 0
    # the same by hand, over the rows as they are read
    table = docs.select("doc_id", "text").collect()
    sizes = np.array([len((t or "").encode()) + 16 for _, t in table])
    middle = np.cumsum(sizes) * 2 - sizes
    shard = np.minimum(4, middle * 5 // (2 * sizes.sum()))
    slot = np.arange(len(table)) - np.searchsorted(shard, shard)
    want = Counter((i, int(n), zlib.crc32((t or "").encode()), "bytes", int(k), int(j), None) for (i, t), n, k, j in zip(table, sizes, shard, slot, strict=True))
    assert Counter(map(tuple, got)) == want


def plain_feature(payload):
    x = [b - 128 for b in payload]
    return f"energy={sum(v * v for v in x)};crossings={sum((a < 0) != (b < 0) for a, b in zip(x, x[1:], strict=False))};peak={max(map(abs, x))}"


def test_flac(docs, none, rows):
    got, want = Counter(), Counter()
    for r in flac.digests(docs).collect():
        got[r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256, r.feature] += 1
        assert [x.first_sample for x in r.blocks] == list(range(0, r.payload_bytes, 4096)) and sum(x.samples for x in r.blocks) == r.payload_bytes
    for i, t, *_ in rows:
        data = (t or "").encode()
        payload = flac.payload_of(data)
        assert len(payload) % 64 == 0 and payload.startswith(data) and not payload[len(data) :].strip(b"\0") and 0 <= len(payload) - len(data) <= 64
        stream = flac.encode([payload])[0]
        want[i, len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(stream), hashlib.sha256(stream).hexdigest(), plain_feature(payload)] += 1
    assert got == want
    assert flac.digests(none).count() == 0
    media = flac.to_media(docs.select("doc_id", F.col("text").cast("binary").alias("data")))
    blocks = flac.pcm_blocks(media).orderBy("doc_id", "block").filter("doc_id = 57").collect()
    whole = b"".join((np.frombuffer(b.pcm, np.int8).view(np.uint8) ^ 0x80).tobytes() for b in blocks)
    assert whole.rstrip(b"\0").decode() == rows[57][1] and [b.first_sample for b in blocks] == [4096 * i for i in range(len(blocks))]


def brute_repeats(texts, length=200):
    data = [(t or "").encode() for t in texts]
    seen = Counter(x[i : i + length] for x in data for i in range(len(x) - length + 1))
    out = []
    for x in data:
        gone = bytearray(len(x))
        for i in range(len(x) - length + 1):
            if seen[x[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        out.append((len(x), sum(gone), sum(1 for i in range(len(x)) if gone[i] and (not i or not gone[i - 1])), hashlib.sha256(bytes(b for b, g in zip(x, gone, strict=True) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize(("crowd", "crowded"), [(512, 2048), (1, 2048), (1, 1)])
def test_suffix(spark, docs, none, rows, crowd, crowded, monkeypatch):
    monkeypatch.setattr(suffix, "CROWD", crowd)
    monkeypatch.setattr(suffix, "CROWDED", crowded)
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.removed_spans(spark, docs).collect())
    assert got == Counter((r[0], *x) for r, x in zip(rows, brute_repeats([r[1] for r in rows]), strict=True))
    assert suffix.removed_spans(spark, none).count() == 0


def test_suffix_of_crowds_and_runs(spark):
    """A passage in more contexts than an anchor's shard takes, runs and periods, and a text that is cut into pieces."""
    passage = prose(50)
    texts = [prose(3) + " " + passage + " " + prose(3) for _ in range(600)] + [None, "", "x" * 3000, "x" * 199 + "y", "ab" * 1000, "abc" * 500, passage[:190] + "z" * 50]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    assert len(suffix.segments(["x".encode() * 3000])[0]) == 1
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.removed_spans(spark, table).collect()}
    assert [got[i] for i in range(len(texts))] == brute_repeats(texts)
    assert got[0][1] >= 200


def test_quality(spark, docs, none):
    good = spark.createDataFrame([(i, int(i < 30), 0) for i in range(50)] + [(3, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.predictions(spark, docs, good).collect()
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 50 and r.doc_id not in (7, 8)]
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert np.mean([(r.score > 0.5) == (r.doc_id < 30) for r in held]) > 0.9
    assert all(r.score == 0.5 for r in quality.predictions(spark, docs, good.filter("false")).collect())
    assert quality.predictions(spark, none, good).count() == 0


def test_packing(spark, docs, none, rows):
    path = queries.tokenizer_file(queries.WORDS)
    got = packing.pack(spark, docs, path, with_ids=True).collect()
    words = packing.WordIds(path)
    want = Counter()
    for (i, *_), ids in zip(rows, words.encode([r[1] or "" for r in rows]), strict=True):
        ids = [*np.frombuffer(ids, "<u4").tolist(), 2]
        want += Counter((i, s, tuple(ids[s : s + 4096]), len(ids)) for s in range(0, len(ids), 4096))
    assert Counter((r.doc_id, r.start, tuple(r.ids), r.doc_tokens) for r in got) == want
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in got)
    for s in {r.sequence_id for r in got}:
        at = 0
        for r in sorted((r for r in got if r.sequence_id == s), key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096
    assert packing.pack(spark, none, path).count() == 0


def test_language(spark, docs, none):
    got = langid.predictions(spark, docs).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == docs.count() and all(by[i].lang_pred == ("en" if i < 30 else "fr") for i in range(50) if i not in (7, 8))
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (52, 53, 54, 55))
    assert all(r.lang_pred == "und" for r in langid.predictions(spark, docs.withColumn("lang", F.lit(None).cast("string"))).collect())
    assert langid.predictions(spark, none).count() == 0


def brute_components(rows):
    fp = simhash.fingerprints([r[1] or "" for r in rows]).tolist()
    near = np.array([[bin(a ^ b).count("1") <= 2 for b in fp] for a in fp])
    label = np.arange(len(rows))
    while True:
        new = np.array([label[near[i]].min() for i in range(len(rows))])
        if (new == label).all():
            return fp, label
        label = new


@pytest.mark.parametrize("bucket", [256, 1])
def test_simhash(spark, docs, none, rows, bucket, monkeypatch):
    fp, label = brute_components(rows)
    least = {k: min((rows[i][0] for i in np.flatnonzero(label == k) if rows[i][0] is not None), default=None) for k in set(label.tolist())}
    monkeypatch.setattr(simhash.links, "__defaults__", (simhash.RADIUS, bucket))
    got = Counter((r.doc_id, r.fingerprint, r.component_id) for r in simhash.clusters(spark, docs).collect())
    assert got == Counter((r[0], f"{f:016x}", least[k]) for r, f, k in zip(rows, fp, label.tolist(), strict=True))
    assert simhash.clusters(spark, none).count() == 0


def test_pii(spark, docs, none):
    field = pii.train()
    got = {r.doc_id: r for r in pii.detect(spark, docs, field).collect()}
    assert got[62].n_email == 1 and got[62].spans == "email:11:20" and got[52].spans == ""
    assert pii.detect(spark, none, field).count() == 0


def brute_neighbours(ids, x, k):
    """query_id: (vec_id, score) of its k nearest; an id stands for all its vectors."""
    out, s = {}, np.array([[(a * b).sum() for b in x] for a in x])
    for q in sorted({i for i in ids if i % 20 == 0}):
        best = {}
        for i in np.flatnonzero(ids == q):
            for j in np.flatnonzero(ids != q):
                best[ids[j]] = max(best.get(ids[j], -np.inf), s[i, j])
        out[q] = sorted(best.items(), key=lambda y: (-y[1], y[0]))[:k]
    return out


def test_neighbours(spark):
    assert ann.leaves(900) >= 16 and ann.leaves(500) >= 16 and ann.leaves(1) == 1
    x = RNG.normal(size=(900, 12)).astype(np.float32)
    x[500:800] = x[500]
    table = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(900, None, 0), (901, [0.0] * 12, 0), (902, [float("nan")] + [1.0] * 11, 0), (903, [1.0], 0), (None, [1.0] * 12, 0)]
    got = ann.neighbours(spark, spark.createDataFrame(table, "vec_id long, embedding array<float>, score int"), lambda v: v % 20 == 0, k=20).collect()
    found, exact = Counter(r.query_id for r in got), 0
    assert set(found) == set(range(0, 900, 20)) and set(found.values()) == {20}
    brute = brute_neighbours(np.arange(900), x.astype(float), 20)
    for q, best in brute.items():
        mine = [(r.vec_id, r.score) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)]
        assert mine == sorted(mine, key=lambda y: (-y[1], y[0])) and len({v for v, _ in mine}) == 20
        exact += len({v for v, _ in best} & {v for v, _ in mine})
    assert exact / (45 * 20) >= 0.9
    assert ann.neighbours(spark, spark.createDataFrame([], "vec_id long, embedding array<float>"), lambda v: v % 20 == 0).count() == 0


def test_neighbours_of_repeated_ids(spark):
    """Rows given twice, ids with two vectors, and fewer candidates than k, with all leaves searched."""
    x = RNG.normal(size=(60, 6))
    ids = np.concatenate([np.arange(50), [40, 40, 7, 7, 20, 3, 3, 3, 3, 3]])
    x[50:52], x[52:54] = x[40], x[7]  # the same rows again; 20 and 3 have several vectors
    table = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>")
    for k in (5, 100):
        got = ann.neighbours(spark, table, lambda v: v % 20 == 0, k=k, share=1.0).collect()
        mine = {q: [(r.vec_id, r.score) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])] for q in (0, 20, 40)}
        for q, best in brute_neighbours(ids, x, k).items():
            assert [v for v, _ in mine[q]] == [v for v, _ in best] and np.allclose([s for _, s in mine[q]], [s for _, s in best])


def test_texts_longer_than_a_batch(spark):
    """A text of two MiB between short ones, whole in every operator that takes texts one by one."""
    long = "".join(prose(30) + "\n" for _ in range(14_000)) + "write to a.b@c.org"
    assert len(long) > 2 * (1 << 20)
    table = spark.createDataFrame([(1, "short", "en"), (2, long, "en"), (3, None, None), (4, prose(20), "en"), (6, prose(20, AUTRES), "fr"), (7, prose(20, AUTRES), "fr")], "doc_id long, text string, lang string").coalesce(1)
    data = long.encode()
    one = lambda df: df.filter("doc_id = 2").first()
    r = one(flac.digests(table))
    assert (r.n_bytes, r.payload_sha256) == (len(data), hashlib.sha256(flac.payload_of(data)).hexdigest()) and r.blocks[-1].first_sample == (r.payload_bytes - 1) // 4096 * 4096
    assert one(bpe.digests(table, queries.tokenizer_file(queries.RANKS), queries.split_pattern(), True)).decoded_sha256 == hashlib.sha256(data).hexdigest()
    assert one(simhash.clusters(spark, table)).fingerprint == f"{int(simhash.fingerprints([long])[0]):016x}"
    r = one(pii.detect(spark, table))
    assert (r.n_email, r.spans.split(",")[0]) == (1, f"email:{len(long) - 9}:{len(long)}")
    assert 0 <= one(quality.predictions(spark, table, spark.createDataFrame([(1, 1), (4, 0)], "doc_id long, quality int"))).score <= 1
    assert one(langid.predictions(spark, table)).lang_pred == "en"
    assert one(sharding.shard_documents(spark, table, 3)).size == len(data) + 16
    r = one(suffix.removed_spans(spark, table))
    assert r.n_bytes == len(data)


def test_pipeline(spark, docs, none, rows, tmp_path):
    """Each stage against a plain version, on what the stage before it kept."""
    model = langid.train(docs)
    kept = corpus_pipeline.language(spark, docs, "")
    want = [r for r in rows if (lambda a: a[0][0] != "und" and a[1][0] >= langid.ACCEPT)(langid.score([r[1] or ""], *model))]
    assert kept.columns == docs.columns and texts_by_row([tuple(r) for r in kept.collect()]) == texts_by_row(want)
    left = corpus_pipeline.near_copies(spark, kept, "")
    now = [tuple(r) for r in left.collect()]
    _, label = brute_components(with_ids := [r for r in want if r[0] is not None])
    assert len([r for r in now if r[0] is not None]) == len(set(label.tolist())) and len([r for r in now if r[0] is None]) == len(want) - len(with_ids)
    cut = corpus_pipeline.passages(spark, left, "")
    gone = {(r[0], r[1]): x[1] for r, x in zip(now, brute_repeats([r[1] for r in now]), strict=True)}
    assert sum(len(r[1].encode()) for r in now) - sum(len(r.text.encode()) for r in cut.collect()) == sum(gone.values())
    clean = corpus_pipeline.privacy(spark, cut, "")
    assert not any("a.b@c.org" in r.text for r in clean.collect()) and clean.columns == docs.columns
    odd = docs.select("doc_id", "text", "lang", *(F.concat(F.lit("mine"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))).alias(n) for n in ("__own0", "__OWN1", "__language", "__likely", "__id", "__th", "__n", "__u1", "__u2", "__spans")))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        odd = stage(spark, odd, "")
        kept_too = odd.filter("doc_id is not null").collect()
        assert kept_too and all(v == f"mine{r.doc_id}" for r in kept_too for v in tuple(r)[3:])
    path = tmp_path / "sf"
    docs.write.parquet(str(path / "documents.parquet"))
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(path)).collect()} == {r[0] for r in now}
    none.write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
