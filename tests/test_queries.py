"""Each registered query against its SQL in DuckDB, over the smallest tables."""

from __future__ import annotations

import duckdb
import numpy as np
import pandas as pd
import pytest

from boxfusion.plans import queries as Q
from tests.conftest import DATA

SF = f"{DATA}/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def even(df: pd.DataFrame) -> pd.DataFrame:
    out = df[sorted(df)].copy()
    for c in out:
        if out[c].dtype.kind == "f" or str(out[c].dtype).startswith(("Int", "Float")):
            out[c] = out[c].astype(float).round(9)
    return out.sort_values(list(out), kind="stable").reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_equals_sql(spark, duck, name):
    mine, sql = even(Q.QUERIES[name](spark, SF).toPandas()), even(duck.execute(Q.ORACLES[name]).fetchdf())
    assert list(mine) == list(sql) and len(mine) == len(sql)
    for c in mine:
        same = (mine[c] == sql[c]) | (mine[c].isna() & sql[c].isna())
        assert same.all(), (c, mine[~same].head(), sql[~same].head())


def test_suppression_is_idempotent_and_matches_are_unique(spark):
    from boxfusion.operators import nms

    kept = nms.suppress(Q.X.boxes(spark, SF), Q.FRAME, "class_ix", order=Q.ORDER).select(*Q.X.boxes(spark, SF).columns).toPandas()
    again = nms.suppress(spark.createDataFrame(kept), Q.FRAME, "class_ix", order=Q.ORDER).count()
    assert again == len(kept)
    m = Q.recovery_match(spark, SF).toPandas()
    assert not m.duplicated(["scene_id", "frame_idx", "gt_pos"]).any()
    t = Q.track_hits(spark, SF).toPandas()
    assert np.isclose((1 / t.hit_count).sum() % 1, 0) or (1 / t.hit_count).sum() > 0
