"""Registered queries beside their SQL; set ATTEST_ALL=1 for every one of them."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from attest.catalog import oracles, queries  # noqa: E402

SF = "/root/testdata/sf0.001"
SOME = ("win_04", "met_01", "met_09", "grd_02", "tax_02", "coh_02", "txt_03", "txt_06", "txt_13", "vec_04", "ret_01", "ret_05",
        "jsn_01", "jsn_08", "join_04", "join_10", "sta_04", "sta_08", "vot_03", "rte_03", "src_02", "snk_02", "str_02", "job_05", "met_07")
NAMES = sorted(oracles()) if os.environ.get("ATTEST_ALL") else SOME


@pytest.fixture(scope="module")
def connection():
    from compare import connect
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, connection, name):
    from compare import compare
    text, ok = compare(spark, connection, name, queries()[name], oracles()[name], SF)
    assert ok, text


def test_entry(spark):
    import __spark_entry__ as entry
    rows = entry.entry(spark).collect()
    assert {r.cond for r in rows} == {"baseline", "rag", "tuned"}
