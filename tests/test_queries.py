"""Some queries of the catalogue against their SQL on the smallest tables; the rest are held against it by the driver."""

import os
import subprocess
import sys

import pytest

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = ["scalar_partial_date_parse", "evidence_tiers", "pair_decision", "metrics_macro", "connected_components", "gini_hhi", "joint_coldness", "table_flow", "table_attribution", "table_denominator_faults"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", NAMES)
def test_against_sql(spark, name):
    import duckdb

    from quillrank.plans import catalog, reports

    assert reports.query is catalog.query  # its tables are in the catalogue too
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = catalog.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in columns)} FROM ({catalog.ORACLE[name]})").fetchall()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted((tuple(r) for r in got.select(columns).collect()), key=key) == sorted(want, key=key)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_without_the_subpackage():
    """The entry point still imports when the subpackage and the pipeline are gone."""
    code = "import sys; sys.modules['quillrank.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert not [n for n in e.queries() if n.startswith('op') or n == 'pipeline']; assert len(e.queries()) > 90"
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", code], cwd=top, check=True)


def test_pcg64_bootstrap_draws_as_many_replicates_as_the_reference(monkeypatch):
    import inspect
    from types import SimpleNamespace

    from quillrank.plans import catalog

    drawn = inspect.signature(catalog.resample.query_intervals)
    asked = []
    monkeypatch.setattr(catalog.metrics, "per_query", lambda *a: None)
    monkeypatch.setattr(catalog.resample, "query_intervals", lambda *a, **k: asked.append(drawn.bind(*a, **k)))
    catalog.bootstrap_pcg64(SimpleNamespace(relevant=None))
    asked[0].apply_defaults()
    assert asked[0].arguments["replicates"] == 10_000


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_policy_effects_rank_no_ledger(spark, monkeypatch):
    """Effects of a policy need leading ranks alone: neither ledger, a product of queries and targets, is made."""
    from quillrank.plans import binding, catalog

    monkeypatch.setattr(binding.Binding, "ledger", lambda *a, **k: pytest.fail("a full ledger is ranked"))
    assert catalog.QUERIES["policy_effect_split"](spark, SF).count() == 5
