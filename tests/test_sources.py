"""Production sources: domain tables read back with their fixed schemas."""

import datetime
import tempfile

import pytest

from deskpark.operators import hydrate as H
from deskpark.sources import schemas as S
from deskpark.sources.snapshots import SnapshotStore
from deskpark.sources.tables import TABLES, ParquetTables


def test_parquet_tables_round_trip(spark, small):
    root = tempfile.mkdtemp(prefix="tables-")
    for name in TABLES:
        getattr(small, name).write.parquet(f"{root}/{name}")
    t = ParquetTables(spark, root)
    for name, schema in TABLES.items():
        assert t.read(name).schema == schema
    args = lambda d: (d.ticket, d.colaborador, d.external, d.cliente, d.cliente_servicio, d.servicio)
    a, b = H.hydrate_page(*args(t)), H.hydrate_page(*args(small))
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_conform_rejects_missing_columns(spark):
    df = spark.createDataFrame([(1, "x")], "id_cliente bigint, other string")
    with pytest.raises(ValueError):
        S.conform(df, S.CLIENTE)


def test_snapshot_versions(spark, small):
    store = SnapshotStore(spark, tempfile.mkdtemp(prefix="snap-"))
    assert store.versions() == []
    store.write(small.cliente, 0)
    store.write(small.cliente.limit(3), 2)
    assert store.versions() == [0, 2] and store.has(2) and not store.has(1)
    assert store.read_latest().count() == 3


def test_snapshot_replaces_only_incomplete_versions(spark, small):
    import os

    root = tempfile.mkdtemp(prefix="snap2-")
    store = SnapshotStore(spark, root)
    os.makedirs(store.path(1))                      # a failed attempt left a partial directory
    open(os.path.join(store.path(1), "part-0.parquet"), "w").write("junk")
    assert store.versions() == []
    store.write(small.cliente, 1)
    assert store.versions() == [1] and store.read(1).count() == small.cliente.count()
    with pytest.raises(FileExistsError):
        store.write(small.cliente, 1)


def test_every_purchase_is_an_accepted_login(spark):
    """No purchase is lost to the issuer test; logins of other issuers come on top and change nothing."""
    import duckdb

    from deskpark.operators import identity as ID
    from deskpark.plans import registry
    from deskpark.sources.fixtures import TestData

    root, day = tempfile.mkdtemp(prefix="logins-"), datetime.datetime(2024, 1, 1)
    tables = {
        "events": ([(i, day, i, "purchase" if i % 10 else "view") for i in range(60)],
                   "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string"),
        "customer": ([(i, f"Customer {i}") for i in range(1, 30)], "c_custkey bigint, c_name string"),
        "supplier": ([(1, "Supplier 1")], "s_suppkey bigint, s_name string")}
    con = duckdb.connect()
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{root}/{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{root}/{name}.parquet/*.parquet')")
    data = TestData(spark, root)
    bought = {i for i in range(60) if i % 10}
    assert {r.login_id for r in ID.accepted_logins(data.login).collect()} == bought
    assert data.login.count() > len(bought)
    for key in ("identity_upsert", "role_analyst"):
        got = registry.queries()[key](spark, root)
        want = con.sql(registry.oracle_sql()[key])
        assert sorted(map(tuple, got.select(want.columns).collect()), key=repr) == sorted(want.fetchall(), key=repr)
    used = registry.queries()["identity_upsert"](spark, root)
    assert {r.login_id for r in used.where("login_id is not null").collect()} == bought
