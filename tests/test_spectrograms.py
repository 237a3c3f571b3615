"""The spectrograms query against its SQL, over recordings that lack channels."""

import duckdb
import numpy as np
import pandas as pd

from sigevents.plans import queries, signal_queries  # noqa: F401 - registers the query


def test_spectrograms_equal_sql(spark, tmp_path):
    r = np.random.default_rng(0)
    ids = [i for i in range(60) if i % 7 != 3]
    pd.DataFrame({"vec_id": ids, "embedding": [r.normal(0, 0.2, 64).astype(np.float32) for _ in ids]}).to_parquet(tmp_path / "embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet'")
    want = sorted(con.sql(queries.SQL["spectrograms"]).fetchall())
    assert sorted(map(tuple, queries.QUERIES["spectrograms"](spark, str(tmp_path)).collect())) == want
