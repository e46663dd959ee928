"""Randomised properties (fixed seed), one Spark job per generated batch."""

from __future__ import annotations

from hypothesis import given, seed, settings
from hypothesis import strategies as st

from provlens.functions.text import format_postal
from provlens.operators import claims as C


def postal_rule(s: str | None) -> str | None:
    """The display rule in plain Python: zero-fill to 5, longer codes to 9,
    9 characters split as ddddd-dddd, longer ones unchanged."""
    if s is None:
        return None
    if len(s) <= 5:
        return s.zfill(5)
    if len(s) <= 9:
        s = s.zfill(9)
        return f"{s[:5]}-{s[5:]}"
    return s


@seed(42)
@settings(max_examples=5, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="0123456789", max_size=12)), min_size=1, max_size=200))
def test_postal_format_matches_the_rule(spark, codes):
    df = spark.createDataFrame([(c,) for c in codes], "postal_code string")
    got = [r[0] for r in df.select(format_postal("postal_code")).collect()]
    assert got == [postal_rule(c) for c in codes]


row = st.tuples(st.integers(1, 50), st.sampled_from(["A", "B", "C"]),
                st.one_of(st.none(), st.integers(0, 9)), st.integers(0, 9))


@seed(7)
@settings(max_examples=5, deadline=None)
@given(st.lists(row, max_size=60), st.lists(row, max_size=60))
def test_union_order_does_not_matter(spark, b_rows, d_rows):
    schema = "npi bigint, drug string, patients bigint, claims bigint"
    b = spark.createDataFrame(b_rows, schema)
    d = spark.createDataFrame(d_rows, schema)
    one = sorted(map(tuple, C.claims_by_provider_drug(C.claims_union(b, d)).collect()), key=repr)
    two = sorted(map(tuple, C.claims_by_provider_drug(C.claims_union(d, b)).collect()), key=repr)
    assert one == two
