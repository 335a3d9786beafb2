import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_entry_smoke(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() >= 0
    assert "top_moa" in df.columns and "pert_id" in df.columns


def test_oracle_keys_are_registered():
    import __spark_entry__ as E
    assert set(E.oracle_sql()) <= set(E.queries())
    assert len(E.queries()) >= 100
