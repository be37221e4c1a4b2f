"""Property tests: generated inputs against small Python models."""

import uuid

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from deskpark.functions import text as X
from test_traps import _pg_ilike_contains

ALPHABET = st.sampled_from(list("ab%_\\Xé. "))


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.text(ALPHABET, max_size=6), st.text(ALPHABET, max_size=4)), min_size=1, max_size=80))
def test_ilike_contains_matches_postgres_model(spark, pairs):
    rows = spark.createDataFrame(pairs, "s string, q string").select(
        "s", "q", X.ilike_contains(F.col("s"), F.col("q")).alias("m")).collect()
    for r in rows:
        assert r.m == _pg_ilike_contains(r.s, r.q), (r.s, r.q)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.one_of(st.uuids().map(str), st.uuids().map(lambda u: u.hex.upper()),
                          st.uuids().map(lambda u: "{" + str(u) + "}"), st.uuids().map(lambda u: "urn:uuid:" + str(u)),
                          st.text(st.sampled_from(list("0123456789abcdefABCDEFxyz-{}:")), max_size=40)),
                min_size=1, max_size=60))
def test_uuid_guard_matches_python(spark, ids):
    def model(x):
        try:
            return str(uuid.UUID(x))
        except ValueError:
            return None
    got = spark.createDataFrame([(x,) for x in ids], "x string").select(
        "x", X.uuid_or_null("x").alias("u")).collect()
    for r in got:
        assert r.u == model(r.x), r.x
