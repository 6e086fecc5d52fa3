import importlib.util
import os


def test_entry_contract(spark):
    path = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "__spark_entry__.py")
    spec = importlib.util.spec_from_file_location("spark_entry", path)
    mod = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(mod)
    df = mod.entry(spark)
    assert df.count() == 20  # one full page
    assert "id" in df.columns
    qs, sql = mod.queries(), mod.oracle_sql()
    assert set(sql) <= set(qs)
    assert len(qs) >= 80
