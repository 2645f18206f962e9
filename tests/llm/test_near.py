"""Near copies of the pipeline against all pairs."""

import numpy as np
import pytest

import corpus_pipeline
from strandline.llm import near


def plain(text):
    parts = text.lower().split()
    return {tuple(parts[i : i + 5]) for i in range(max(1, len(parts) - 4))} if parts else set()


def components(texts):
    sets, label = [plain(t or "") for t in texts], np.arange(len(texts))
    alike = np.array([[(not a and not b) or 5 * len(a & b) >= 4 * len(a | b) > 0 for b in sets] for a in sets])
    while True:
        new = np.array([label[alike[i]].min() for i in range(len(texts))])
        if (new == label).all():
            return label
        label = new


def edited(rng, text, n):
    parts = text.split()
    for i in rng.choice(len(parts), n, replace=False):
        parts[i] = f"edit{rng.integers(10**6)}"
    return " ".join(parts)


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(3)
    base = [" ".join(f"w{i}" for i in rng.integers(0, 3000, n)) for n in rng.integers(30, 300, 40)]
    out = [*base, None, "", " ", "two words", "Two  words", "other pair"]
    out += [edited(rng, t, 1) for t in base] + [edited(rng, t, int(rng.integers(2, 12))) for t in base]  # at, below and above 0.8
    step = base[0]
    for _ in range(8):  # a chain whose ends are far apart
        step = edited(rng, step, 2)
        out.append(step)
    return out + [edited(rng, base[1], 1) for _ in range(30)]


def test_links_in(texts):
    some = [t for t in texts if t and t.split()]
    left, right = near.links_in(near.shingles(some))
    label = np.arange(len(some))
    for _ in some:
        for a, b in zip(left.tolist(), right.tolist(), strict=True):
            label[[a, b]] = label[[a, b]].min()
    assert label.tolist() == components(some).tolist()


@pytest.mark.parametrize(("crowd", "block"), [(near.CROWD, near.BLOCK), (2000, 4)])
def test_one_of_each_group_stays(spark, texts, crowd, block):
    docs = spark.createDataFrame([(i, t, "kept", 7, "mine") for i, t in enumerate(texts)], "doc_id long, text string, __own0 string, __id long, __th string")
    got = near.keep_one(spark, docs, crowd, block)
    assert got.columns == docs.columns and sorted(r.doc_id for r in got.collect()) == sorted(set(components(texts).tolist()))
    assert {tuple(r)[2:] for r in got.collect()} == {("kept", 7, "mine")}


def test_fingerprints_equal_plain_ones():
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 2**63, n).astype(np.uint64)) for n in (1, 2, 5, 300)]
    got = near.fingerprints(sets)
    for s, words in zip(sets, got, strict=True):
        for w in (0, near.BITS // 64 - 1):
            hashes = [int(x) for x in near._mixed(near._mixed((s ^ near._MASKS[w]) * near._FACTORS[w]) * near._FACTORS[w])]
            assert int(words[w]) == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_pairs_of_similarity_0_8_meet_within_the_radius():
    """Sets of 90 shingles, 80 of them shared: the least similarity that counts."""
    rng, picks = np.random.default_rng(7), near.tables(50_000)
    x = rng.integers(0, 2**63, (2000, 100)).astype(np.uint64)
    a, b = near.fingerprints([np.unique(r[:90]) for r in x]), near.fingerprints([np.unique(np.append(r[:80], r[90:])) for r in x])
    bits = np.unpackbits((a ^ b).view(np.uint8), axis=1, bitorder="little")
    far = bits[:, : near.PLANES].sum(1)
    meets = np.any([~bits[:, p].any(1) for p in picks], axis=0)
    assert np.mean(meets & (far <= near.RADIUS)) > 0.98


def test_one_word_edit_goes(spark):
    rng = np.random.default_rng(4)
    text = " ".join(f"w{i}" for i in rng.integers(0, 3000, 200))
    docs = spark.createDataFrame([(i, edited(rng, text, 1) if i else text) for i in range(6)], "doc_id long, text string")
    assert [r.doc_id for r in corpus_pipeline.near_copies(spark, docs, "").collect()] == [0]


def test_rows_without_an_id_are_grouped_too(spark):
    rng = np.random.default_rng(5)
    one, two, three = (" ".join(f"w{i}" for i in rng.integers(0, 3000, 100)) for _ in range(3))
    rows = [(7, one), (None, one), (None, edited(rng, one, 1)), (None, two), (None, two), (None, edited(rng, two, 1)), (None, three), (None, None), (None, None)]
    got = near.keep_one(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 4 and (7, one) in [tuple(r) for r in got] and (None, three) in [tuple(r) for r in got]
    assert [r.doc_id for r in got].count(None) == 3
