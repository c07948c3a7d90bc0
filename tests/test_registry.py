"""Registered queries against their SQL, on the smallest tables where these are there."""

from pathlib import Path

import pandas as pd
import pytest

DATA = Path("/root/testdata/sf0.001")
SOME = ["grid_scan", "hist2d", "max_slope", "contour_curvature", "flow_direction_d8", "drainage_area", "flow_length", "mosaic_last_wins", "nearest_at_least", "outlet_upsert", "downhill_walk", "ks_smoothed", "equal_regions", "valley_area", "deflection"]


def test_every_statement_has_a_query():
    from talusgrid.plans import registry

    assert set(registry.oracle_sql()) <= set(registry.queries())


@pytest.mark.skipif(not DATA.exists(), reason="the given tables are not here")
@pytest.mark.parametrize("name", SOME)
def test_query_equals_its_sql(spark, name):
    import duckdb

    from talusgrid.plans import registry

    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    a, b = registry.queries()[name](spark, str(DATA)).toPandas(), con.execute(registry.oracle_sql()[name]).df()
    columns = sorted(a.columns)
    assert columns == sorted(b.columns)
    rows = lambda df: [tuple(None if pd.isna(v) else v for v in r) for r in df[columns].itertuples(index=False)]
    key = lambda rs: sorted(str([float(v) if isinstance(v, (int, float)) else v for v in (x.item() if hasattr(x, "item") else x for x in r)]) for r in rs)
    assert key(rows(a)) == key(rows(b))


@pytest.mark.skipif(not DATA.exists(), reason="the given tables are not here")
def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 32000
