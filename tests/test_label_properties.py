"""Property test: Spark's name parsing equals a plain-Python reading of the same rules."""

import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from setscore.functions import labels as L

TOKEN = st.text(alphabet="abcXYZ_ -.()/0123456789", min_size=0, max_size=8)


def _py_sample(name, n_lead, n_trail):
    for _ in range(n_trail):
        name = re.sub(L.TRAILING_TOKEN, "", name, count=1)
    for _ in range(n_lead):
        name = re.sub(L.LEADING_TOKEN, "", name, count=1, flags=re.DOTALL)
    return name


def _py_first(name, rules):
    return next((lab for pat, lab in rules if pat in name), None)


@settings(max_examples=1, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(TOKEN, min_size=1, max_size=7).map("_".join), min_size=40, max_size=40))
def test_parse_matches_python(spark, names):
    names = names + ["Mesenchymallike_NonResponders_BT_scr_GC3_57", "T/NKcell_S1_44", "", "_", "a__b_"]
    df = spark.createDataFrame([(n,) for n in names], "unit string")
    u = df["unit"]
    rows = df.select("unit", L.sample_of(u, 3, 2).alias("s32"), L.sample_of(u, 1, 1).alias("s11"),
                     L.human_cell_type(u).alias("ct"), L.timepoint_of(u).alias("tp"),
                     L.response_of(u).alias("rp")).collect()
    for r in rows:
        n = r["unit"]
        assert r["s32"] == _py_sample(n, 3, 2), n
        assert r["s11"] == _py_sample(n, 1, 1), n
        assert r["ct"] == _py_first(n, L.HUMAN_CELL_TYPE_RULES)
        assert r["tp"] == _py_first(n, L.TIMEPOINT_RULES)
        assert r["rp"] == _py_first(n, L.RESPONSE_RULES)
