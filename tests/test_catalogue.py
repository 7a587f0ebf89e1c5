import sys

import __spark_entry__ as entry


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    assert entry.entry(spark).count() == 4


def test_core_queries_run_on_the_small_tables(spark, small):
    from segloom import plans

    for name in ("seg_confusion", "flt_drop_reason", "adv_per_request", "prj_reshape", "smp_hash_split", "graph_faults", "bootstrap", "p5_coverage", "p6_pairs"):
        assert plans.QUERIES[name](spark, small).count() > 0, name


def test_core_does_not_need_the_llm_package(monkeypatch):
    for m in [m for m in sys.modules if m.startswith("segloom.llm")]:
        monkeypatch.delitem(sys.modules, m)
    monkeypatch.setitem(sys.modules, "segloom.llm", None)
    from segloom import plans

    assert set(entry.queries()) == set(plans.QUERIES)
