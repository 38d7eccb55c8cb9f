"""The registered queries: contract checks and a side-by-side run on the smallest tables."""

import os

import pytest

from tests.compare import compare, duck

FOLDER = "/root/testdata/sf0.001"
QUICK = (
    "risk_by_source", "r3_url_inspection", "r15_rule_totals", "f4_url_features", "t9_strip_reply_structure", "t14_language_test",
    "h9_header_signals", "j1_exact_dedup", "a3_roc_auc", "w4_grouped_folds", "w10_plateau_threshold", "c3_review_bands",
)


def test_contract():
    import __spark_entry__ as entry
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert len(queries) > 150 and set(oracles) <= set(queries)
    assert all(sql.strip() for sql in oracles.values())


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables not present")
@pytest.mark.parametrize("name", QUICK)
def test_query_equals_its_sql(spark, name):
    import __spark_entry__ as entry
    problems, got, _ = compare(spark, duck(FOLDER), FOLDER, entry.queries()[name], entry.oracle_sql()[name])
    assert not problems and got
