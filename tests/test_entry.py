import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def test_names():
    q, s = entry.queries(), entry.oracle_sql()
    assert set(s) <= set(q) and {"p1_found", "p4_found", "p5_found"} <= set(q)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_sql_agrees_on_smallest_tables():
    import verify

    names = [n for n in entry.oracle_sql() if n in ("p1_found", "p5_found", "line_stats_by_language", "symbol_references", "debounced_bursts", "dependency_cycles")]
    assert verify.main(["--sf", SF, *names]) == 0
