"""Appends: a batch run again adds nothing, tables become visible together, rows keep the table's schema."""

import pytest

from deskpark.operators import appends as AP
from deskpark.sources import schemas as S
from deskpark.sources.appends import AppendTables

TICKET = (1, 2, 3, 4, "a", "t", "n", "e", None, None, None, None)


@pytest.fixture
def tables(spark, tmp_path):
    return AppendTables(spark, str(tmp_path), AP.TABLES)


def ids(df):
    return sorted(r.id_ticket for r in df.collect())


def tickets(spark, *keys):
    return spark.createDataFrame([(k, *TICKET[1:]) for k in keys], S.TICKET)


def talk(spark, *keys):
    return spark.createDataFrame([(k, [("user", "hola")]) for k in keys], S.CONVERSACION)


def test_batch_run_twice_adds_its_rows_once(spark, tables):
    assert ids(tables.read("ticket")) == []
    for batch, keys in (("b 1/x", (1, 2)), ("b2", (3,)), ("b 1/x", (1, 2)), ("b3", ())):
        tables.append(batch, {"ticket": tickets(spark, *keys), "conversacion": talk(spark, *keys)})
    assert ids(tables.read("ticket")) == ids(tables.read("conversacion")) == [1, 2, 3]
    assert ids(tables.read("ticket", but="b2")) == [1, 2]
    assert tables.read("ticket").schema == S.TICKET and tables.read("conversacion").first().contenido[0].content == "hola"
    assert sorted(r.batch for r in tables.committed().collect()) == ["b 1/x", "b2", "b3"]


def test_batch_without_a_commit_is_not_seen_and_can_be_run_again(spark, tables):
    class Lost(Exception):
        pass

    def fails(name, rows, mode, write=tables._write):
        if name == "conversacion":
            raise Lost
        write(name, rows, mode)

    whole = tables._write
    tables._write = fails
    with pytest.raises(Lost):
        tables.append("b", {"ticket": tickets(spark, 7), "conversacion": talk(spark, 7)})
    assert ids(tables.read("ticket")) == []
    tables._write = whole
    tables.append("b", {"ticket": tickets(spark, 8), "conversacion": talk(spark, 8)})  # a repeated run replaces what was left
    assert ids(tables.read("ticket")) == ids(tables.read("conversacion")) == [8]


def test_other_columns_are_an_error(spark, tables):
    with pytest.raises(ValueError):
        tables.append("b", {"ticket": talk(spark, 1)})


def test_conversations_of_created_tickets(spark):
    intake = spark.createDataFrame([(1, "created", 10, 5), (2, "rejected", None, 6), (3, "created", 11, 7), (4, "created", 12, 8)],
                                   "req_id bigint, outcome string, id_ticket bigint, thread_id bigint")
    turns = spark.createDataFrame([(5, 2, "assistant", "b"), (5, 1, "user", None), (5, 0, "system", "x"), (6, 1, "user", "no"), (7, 1, "system", "x")],
                                  "thread_id bigint, turn bigint, role string, content string")
    got = {r.id_ticket: [tuple(m) for m in r.contenido] for r in AP.new_conversations(intake, turns).collect()}
    assert got == {10: [("user", None), ("agent", "b")], 11: [], 12: []}
