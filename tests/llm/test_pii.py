"""Personal data: base rules against the contract's patterns, gradients, recall of the model, edge rows."""

import hashlib
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from deskpark.llm import pii
from deskpark.llm.queries import queries
from llm.cases import EDGE, SF_SMALL


def contract_spans(text):
    """The contract's patterns, applied as they stand."""
    text, found = text or "", []
    digits = lambda s: re.sub("[^0-9]", "", s)

    def luhn(d):
        return sum(sum(divmod(int(c) * 2, 10)) if k % 2 else int(c) for k, c in enumerate(reversed(d))) % 10 == 0

    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        found.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        if 12 <= len(digits(m[0])) <= 19 and luhn(digits(m[0])):
            found.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(digits(m[0])) <= 15:
            found.append((m.start(), 3, m.end()))
    return sorted(found)


PIECES = st.sampled_from(["a", "Z.", "@", "x@y.z", ".", "-", "+", "1", "23", "255", "256", "0001", "4111 1111-11111111", "+1 (284) 555-0850", "10.0.0.1", " ", "é", "\n", "@@", "a@b"])


@settings(max_examples=500, deadline=None)
@given(st.lists(PIECES, max_size=14).map("".join))
def test_base_rules_equal_the_contract(text):
    assert pii.base_spans(text) == contract_spans(text)


def test_long_runs_take_linear_time():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 200_000, "+1" * 200_000, "@" * 300_000, "a@" * 200_000):
        pii.base_spans(text)


def test_gradients():
    rng, model = np.random.default_rng(2), pii.Model.new(3)
    x = rng.integers(1, 98, (5, 9)).astype(np.uint8)
    x[0, 5:] = 0
    y = rng.integers(0, pii.TAGS, x.shape) * (x > 0)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    _, g = model.gradients(x, y)
    for k, v in model.p.items():
        for _ in range(5):
            at = tuple(rng.integers(0, n) for n in v.shape) if k[0] != "x" else (int(x[1, 3]), int(rng.integers(12)))
            near = []
            for step in (1e-4, -2e-4):
                v[at] += step
                near.append(model.gradients(x, y)[0])
            v[at] += 1e-4
            assert abs((near[0] - near[1]) / 2e-4 - g[k][at]) < 1e-4


def test_windows_cover_all_near_an_anchor():
    codes = pii.codes_of("x" * 50 + "1" + "x" * 400 + "@" + "y" * 90 + "7" * 500 + "z" * 10)
    covered = np.zeros(len(codes) + pii.WIDTH, bool)
    for s in pii.windows(codes):
        covered[s: s + pii.WIDTH] = True
    for at in np.flatnonzero((codes == 33) | (codes >= 17) & (codes <= 26)):
        assert covered[max(0, at - pii.REACH): min(len(codes), at + pii.REACH)].all()


def test_model_finds_what_it_was_shown_and_variants(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    model = pii.train(docs.where("doc_id < 8000"), 6000)
    fresh = [r.text for r in docs.where(docs.text.rlike("[0-9@]")).where("doc_id >= 8000").collect()]
    want = {(n, *x) for n, t in enumerate(fresh) for x in pii.base_spans(t)}
    got = {(n, *x) for n, a in enumerate(pii.added_spans(model, fresh)) for x in a}
    assert len(want) > 50 and len(want & got) >= 0.95 * len(want) and len(got - want) <= 0.02 * len(want) + 1
    found = pii.find_all(model, ["and the thing of it call (415) 555-0199 now on the edge of"])[0]
    assert [(pii.KINDS[k], base) for _, k, _, base in found] == [("phone", False)]


def test_query_digests(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    got = queries()["op6_pii"](spark, SF_SMALL).collect()
    assert {r.doc_id for r in got} == set(docs)
    for r in got:
        own = contract_spans(docs[r.doc_id])
        listed = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in own)
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(x[1] == k for x in own) for k in range(4))
        assert set(filter(None, listed.split(","))) <= set(r.spans.split(","))


def test_edge_rows_and_empty_table(make, edge, empty):
    assert pii.train(empty) is None and pii.train(edge) is None
    assert pii.find(empty, None).count() == 0
    rows = [*EDGE, (20, "mail a.b@c.example and 10.0.0.1"), (21, "+1 (284) 555-0850")]
    got = pii.find(make(rows), None).collect()
    assert sorted((r.doc_id or -1, len(r.spans)) for r in got) == sorted((d or -1, len(contract_spans(t))) for d, t in rows)
    masked = make(rows).select("doc_id", pii.masked_column(F.col("text"), None).alias("t")).collect()
    texts = {r.doc_id: r.t for r in masked}
    assert texts[20] == "mail [EMAIL] and [IP]" and texts[21] == "[PHONE]" and texts[1] is None and texts[2] == "" and texts[5] == EDGE[5][1]
