"""Every registered query with an oracle, at the smallest scale."""

import pytest
from check_oracle import compare, open_tables

from eventcast import catalog

FOLDER = "/root/testdata/sf0.001"
ORACLES = catalog.oracle_sql()
HEAVY = {"h9_setting_sweep", "h8_length_ablation", "h7_span_ablation", "h5_feature_ablation"}


@pytest.fixture(scope="module")
def con():
    return open_tables(FOLDER)


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_matches_sql(spark, con, key):
    outcome = compare(catalog.queries()[key](spark, FOLDER), con, ORACLES[key])
    assert outcome.startswith("ok"), outcome


@pytest.mark.parametrize("key", sorted(set(catalog.queries()) - set(ORACLES) - HEAVY))
def test_runs_without_sql(spark, key):
    assert catalog.queries()[key](spark, FOLDER).count() > 0


def test_entry(spark):
    from __spark_entry__ import entry

    rows = entry(spark)
    assert rows.count() == 1725
    assert rows.filter("attack_count_lag_52 is not null").count() == 1725 - 5 * 52


def test_every_inventory_row_has_a_query():
    from __spark_entry__ import queries

    built = {key.split("_")[0] for key in queries()}
    rows = (
        [f"a{i}" for i in range(1, 11)] + [f"b{i}" for i in range(1, 24)] + [f"j{i}" for i in range(1, 7)]
        + [f"c{i}" for i in range(1, 8)] + [f"w{i}" for i in range(1, 10)] + [f"d{i}" for i in range(1, 19)]
        + [f"k{i}" for i in range(1, 8)] + [f"u{i}" for i in range(1, 4)] + [f"t{i}" for i in range(1, 8)]
        + [f"e{i}" for i in range(1, 24)] + ["x1"] + [f"g{i}" for i in range(1, 11)] + [f"h{i}" for i in range(1, 20)]
        + [f"n{i}" for i in range(1, 11)]
    )
    assert [r for r in rows if r not in built] == []
