"""One query of each family, and those that no other test calls, give what DuckDB gives on the smallest tables. Skipped where these aren't there."""

import glob
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__
from grovewise.queries import oracle_sql, queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
#: One of each family; the comparison over all queries is the driver's.
NAMES = ["jn04_nearest_other", "jn05_nearest_kept", "jn09_stem_tree_offsets", "jn14_left_over", "grf01_components", "dml01_edits_applied", "p3_regions", "p6_found", "p6_changes", "prj11_voxel_cell", "prj14_saved_colour", "prj21_stem_cylinders", "flt02_polygon", "flt03_lasso_select", "agg02_tree_records", "agg06_rows_by_tree", "agg07_voxel_thinning", "agg15_stem_circle", "jn02_overlapping_boxes", "jn03_eps_pairs", "jn11_candidate_pairs", "win01_colour_ranks", "win04_best_stems", "win09_tree_in_name", "win14_click_chains", "uni01_merged_set", "dml02_undo_redo", "itr06_updated_records", "src03_ply_round_trip", "snk05_patched_file", "p3_found", "p4_found"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def rows(df: pd.DataFrame) -> list:
    def cell(v):
        if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, (float, np.floating)) and np.isnan(v)):
            return ""
        return str(bool(v)) if isinstance(v, (bool, np.bool_)) else f"{float(v):.6f}".replace("-0.000000", "0.000000") if isinstance(v, (int, float, np.number)) else str(v)

    return sorted(tuple(cell(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    got = queries()[name](spark, SF).toPandas()
    want = duck.execute(oracle_sql()[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def test_entry_and_names(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
