"""Property tests: the lenient number reader against pandas' reader."""

import math

import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from innsight.functions.clean import numeric0

_text = st.one_of(
    st.from_regex(r"\s?[+-]?\d{1,6}(\.\d{0,4})?([eE][+-]?\d{1,2})?\s?", fullmatch=True),
    st.from_regex(r"[+-]?\.\d{1,4}", fullmatch=True),
    st.text(alphabet="0123456789.eEdf+- xn/a", min_size=0, max_size=6),
)


@settings(max_examples=5, deadline=None)
@given(st.lists(_text, min_size=20, max_size=60))
def test_numeric0_agrees_with_pandas(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x string")
    got = [r[0] for r in df.select(numeric0(F.col("x"), T.StringType())).collect()]
    want = pd.to_numeric(pd.Series(values, dtype=object), errors="coerce").fillna(0).astype(float).tolist()
    for v, g, w in zip(values, got, want):
        if math.isinf(w) and not v.strip().lower().lstrip("+-").startswith("inf"):
            w = 0.0  # overflow: pandas keeps inf only for spelled-out infinity in our reading
        assert g == w or math.isclose(g, w, rel_tol=1e-12), (v, g, w)


_counts = st.lists(
    st.tuples(st.integers(min_value=0, max_value=10**7), st.integers(min_value=1, max_value=10**7)),
    min_size=50, max_size=200,
)


@settings(max_examples=5, deadline=None)
@given(_counts)
def test_percent_text_agrees_with_python(spark, pairs):
    """Rates of counts rendered as the application renders them."""
    import numpy as np

    from innsight.functions.formats import one_decimal_pct, pct
    from innsight.operators.measures import ratio

    df = spark.createDataFrame(pairs, "a bigint, b bigint")
    r = ratio(F.col("a"), F.col("b"))
    got = [(row.p, row.q) for row in df.select(pct(r).alias("p"), one_decimal_pct(r).alias("q")).collect()]
    for (a, b), (p, q) in zip(pairs, got):
        x = a / b
        assert p == f"{x:.2%}", (a, b, p)
        assert q == str(np.round(x * 100, 1)) + "%", (a, b, q)
