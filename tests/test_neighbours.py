"""Nearest vectors in blocks against SQL, with copies, zeros, nulls and repeated ids."""

import duckdb
import numpy as np
import pytest

from glyphloom.operators import neighbours as N
from glyphloom.plans.measures import KNN

from .oracle import rows_of


@pytest.mark.parametrize("most", [(4, 16), (4096, 16384)])
def test_nearest(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(N, "TILE", 8)
    rng = np.random.default_rng(3)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=4)], i % 3) for i in range(200)]
    rows = [(i, rows[i % 7][1] if i % 2 else v, l) for i, v, l in rows]  # many are the same
    rows[3], rows[20], rows[41] = (3, None, 1), (20, None, 2), (41, [0.0] * 4, None)
    rows += [(40, rows[5][1], 1), (None, rows[6][1], 1)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    df.write.parquet(str(tmp_path / "e"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/e/*.parquet')")
    cur = con.execute(f"WITH {KNN} SELECT query, rank, cosine FROM rk WHERE rank <= 5 AND query <> 40")  # two rows of one id leave ties open
    want = rows_of([x[0] for x in cur.description], cur.fetchall())
    got = N.nearest(df, df.where("vec_id % 20 = 0"), 5, most).where("query <> 40").select("query", "rank", "cosine")
    assert rows_of(got.columns, [tuple(r) for r in got.collect()]) == want
    ids = con.execute(f"WITH {KNN} SELECT query, rank, vec_id FROM rk WHERE rank <= 5 AND query <> 40 AND vec_id <> 40").fetchall()
    mine = {(r["query"], r["rank"]): r["vec_id"] for r in N.nearest(df, df.where("vec_id % 20 = 0"), 5, most).collect()}
    assert all(mine[q, r] == v for q, r, v in ids)
    assert "NestedLoop" not in got._jdf.queryExecution().simpleString()
