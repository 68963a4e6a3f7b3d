"""Every query against its SQL twin on the smallest tables; those without one must give a stable schema."""

import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as entry
from tools.check import TABLES, rows_of

duckdb = pytest.importorskip("duckdb")
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
QUICK = [n for n in QUERIES if n.split("_")[0] in {"str", "num", "dat", "bin", "map", "col", "so", "st", "ar"}]
NAMES = list(QUERIES) if os.environ.get("LEDGERLIFT_ALL_QUERIES") else QUICK + [
    "tg_01_customer_target", "tg_02_weighted_target", "sg_02_segment_lift", "ft_08_history_features", "sc_04_prospect_ranking", "rec_05_white_space", "rec_06_profile_submodel",
    "rec_07_product_recommendations", "rec_08_next_groups", "alc_02_capped_weights", "fc_02_calendar_forecast", "bt_04_group_calibration", "cr_01_crm_validation", "jn_10_cascading_match",
    "en_01_fill_cascade", "tx_05_tree_codes", "qa_06_review_queues", "ag_18_min_leaf_consolidation", "sm_01_change_upsert", "sm_03_stream_months", "ml_09_classification_metrics",
]


@pytest.fixture(scope="module")
def con(sf_dir):
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    if name in ORACLES:
        cur = con.execute(ORACLES[name])
        columns = [d[0] for d in cur.description]
        assert sorted(columns) == sorted(df.columns)
        assert rows_of(df.columns, rows) == rows_of(columns, cur.fetchall())


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
