import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402


def test_registry_and_oracles_line_up():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 60


def test_entry_runs_on_smoke_data(spark):
    df = entry.entry(spark)
    assert df.count() == 6000
    assert "proporcion_relaciones_congrupo_fin" in df.columns
