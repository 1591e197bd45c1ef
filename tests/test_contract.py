"""Driver contract and the golden feature width."""

import importlib.util
import os

from cirro.plans import views as V
from cirro.plans.features import engineer_features

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def _entry():
    spec = importlib.util.spec_from_file_location("spark_entry", os.path.join(ROOT, "__spark_entry__.py"))
    mod = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(mod)
    return mod


def test_entry_runs(spark):
    m = _entry()
    df = m.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert "label_next_4" in df.columns


def test_oracle_keys_are_queries():
    m = _entry()
    q, o = m.queries(), m.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 80


def test_feature_width_golden(spark):
    wx = V.ev_weather(spark, "/root/testdata/sf0.001")
    f = engineer_features(wx, pca_k=5)
    new = [c for c in f.columns if c not in wx.columns]
    assert len(new) == 211
