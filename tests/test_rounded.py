"""Queries against their SQL on tables whose distances are equal only once they are rounded, and whose samples hold a column's sentinel elsewhere."""

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from strandline.operators import search
from strandline.plans import registry


def same(spark, folder, name):
    con = duckdb.connect()
    for file in folder.glob("*.parquet"):
        con.execute(f"create view {file.stem} as select * from '{file}'")
    found = registry.QUERIES[name](spark, str(folder))
    rows = con.execute(f"select {', '.join(f'"{c}"' for c in found.columns)} from ({registry.ORACLE_SQL[name]})").fetchall()
    key = lambda r: tuple((v is None, v) for v in r)
    assert sorted(map(tuple, found.collect()), key=key) == sorted(rows, key=key)
    return rows


@pytest.fixture(scope="module")
def close(tmp_path_factory):
    """Vectors in crowds whose distances from any query differ by less than a millionth, the nearer ones under the larger ids."""
    rng = np.random.default_rng(8)
    x = np.repeat(rng.normal(size=(12, 64)), 25, axis=0)
    x += np.linspace(4e-9, 1e-9, 25).repeat(12).reshape(25, 12).T.reshape(-1, 1) * rng.normal(size=(300, 64))
    folder = tmp_path_factory.mktemp("close")
    table = pa.table({"vec_id": pa.array(range(300)), "embedding": pa.array(x.tolist(), pa.list_(pa.float64())), "label": pa.array([i % 7 for i in range(300)], pa.int32())})
    pq.write_table(table, folder / "embeddings.parquet")
    return folder


@pytest.mark.parametrize("name", ["j01_knn_join", "n02_naive_scan", "n03_abandoning_scan", "j03_nearest_join", "j10_inner_product_join", "t07_knn_by_l1", "d15_nearest_label", "j06_cells_all_probed", "n04_fitted_cells"])
def test_ties_of_rounded_distances(spark, close, name):
    assert same(spark, close, name)


def test_rounded():
    assert search.rounded(np.array([0.5, -0.5, 2.5, 1.4999, -1.5]), 0).tolist() == [1, -1, 3, 1, -2]
    assert search.rounded(np.array([1.23456749, 1.2345675]), 6).tolist() == [1.234567, 1.234568]


def test_sentinel_of_one_column(spark, tmp_path):
    table = pa.table({"event_id": pa.array([0, 1, 2, 3]), "user_id": pa.array([7, 30, 99, 5]), "value": pa.array([50.0, 7.0, 7.00004, 81.0])})
    pq.write_table(table, tmp_path / "events.parquet")
    assert (20.0, 30.0) in same(spark, tmp_path, "s10_recording")
