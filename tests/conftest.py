from __future__ import annotations

import os
import sys
from types import SimpleNamespace

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from provlens.session import build_session  # noqa: E402
from provlens.sources.files import SCHEMAS  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"
SF_MEDIUM = "/root/testdata/sf0.01"

PROVIDERS_SCHEMA = ("NPI bigint, last_name_legal string, first_name string, middle_name string, "
                    "postal_code string, tax_code_1 string, tax_code_2 string, tax_code_3 string")


@pytest.fixture(scope="session")
def spark():
    s = build_session("local[4]", shuffle_partitions=8, app_name="provlens-tests")
    yield s
    s.stop()


@pytest.fixture
def make_src(spark):
    """Hand-made inputs: lists of tuples in the declared schemas."""
    def make(part_b=(), part_d=(), payments=(), providers=(), taxonomy=(), affiliations=()):
        def df(rows, schema):
            return spark.createDataFrame([tuple(r) for r in rows], schema)
        return SimpleNamespace(
            part_b=df(part_b, SCHEMAS["part_b"]),
            part_d=df(part_d, SCHEMAS["part_d"]),
            payments=df(payments, SCHEMAS["payments"]),
            providers=df(providers, PROVIDERS_SCHEMA),
            taxonomy=df(taxonomy, SCHEMAS["taxonomy"]),
            affiliations=df(affiliations, SCHEMAS["affiliations"]),
        )
    return make
