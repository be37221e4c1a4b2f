"""Streaming forms equal the batch operators (ST1, ST2)."""

import datetime as dt
import tempfile

from pyspark.sql import Window
from pyspark.sql import functions as F

from deskpark.operators import commands as CM
from deskpark.operators import transcripts as TR
from deskpark.sources import schemas as S
from deskpark.sources.snapshots import BucketStore, SnapshotStore
from deskpark.streaming import status_stream, transcripts_stream


def _split_files(df, keys, parts, root):
    """Write ``df`` as ``parts`` files in ``keys`` order, one file per slice (test input only)."""
    w = df.withColumn("_b", F.ntile(parts).over(Window.orderBy(*keys)))
    for b in range(1, parts + 1):
        w.where(F.col("_b") == b).drop("_b").coalesce(1).write.parquet(f"{root}/part{b:03d}")
    return root


def test_transcripts_stream_equals_batch(spark, small):
    scratch = tempfile.mkdtemp(prefix="st1-")
    msgs = small.mensaje
    src = _split_files(msgs, ["turn", "id_ticket"], 4, f"{scratch}/in")
    latest = {}

    def sink(batch, epoch):
        for r in batch.collect():
            latest[r.id_ticket] = (r.n_messages, r.contenido)

    q = transcripts_stream.start(spark, f"{src}/*", f"{scratch}/ckpt", sink, max_files_per_trigger=1)
    q.awaitTermination(300)
    want = {r.id_ticket: (r.n_messages, r.contenido) for r in TR.transcripts(msgs).collect()}
    assert latest == want


def test_status_stream_equals_batch(spark, mid):
    scratch = tempfile.mkdtemp(prefix="st2-")
    cmds = mid.status_cmd
    src = _split_files(cmds, ["ts", "cmd_id"], 3, f"{scratch}/cmds")
    store = BucketStore(spark, f"{scratch}/tickets", S.TICKET, "id_ticket", 16)
    store.write(mid.ticket, 0)
    q = status_stream.start(spark, f"{src}/*", store, mid.analista, f"{scratch}/ckpt", max_files_per_trigger=1)
    q.awaitTermination(600)
    assert len(store.versions()) == 4
    got = store.read_latest()
    want = CM.status_apply(mid.ticket, CM.status_validate(cmds, mid.analista, mid.ticket))
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_status_stream_drops_replayed_commands(spark, small):
    scratch = tempfile.mkdtemp(prefix="st2d-")
    cmds = small.status_cmd
    cmds.unionByName(cmds).coalesce(1).write.parquet(f"{scratch}/cmds/part001")  # every command twice
    store = BucketStore(spark, f"{scratch}/tickets", S.TICKET, "id_ticket", 16)
    store.write(small.ticket, 0)
    q = status_stream.start(spark, f"{scratch}/cmds/*", store, small.analista, f"{scratch}/ckpt",
                            applied_log=f"{scratch}/applied")
    q.awaitTermination(600)
    got = store.read_latest()
    want = CM.status_apply(small.ticket, CM.status_validate(cmds, small.analista, small.ticket))
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def _commands(spark, rows, path):
    spark.createDataFrame([(c, dt.datetime(2024, 1, day), t, 1010, "Cerrado", None, text) for c, day, t, text in rows],
                          S.STATUS_CMD).coalesce(1).write.mode("append").parquet(path)


def _small_store(spark, scratch):
    store = BucketStore(spark, f"{scratch}/tickets", S.TICKET, "id_ticket", 16)
    row = lambda i: (i, 1, None, 10, "s", "solicitud", "alto", "aceptado", None, dt.datetime(2024, 1, 1), None, None)
    store.write(spark.createDataFrame([row(i) for i in range(1, 6)], S.TICKET))
    return store, spark.createDataFrame([(10, 1010, 1)], S.ANALISTA)


def _diagnoses(store):
    return {r.id_ticket: r.diagnostico for r in store.read_latest().collect() if r.diagnostico}


def test_new_checkpoint_on_an_old_store_applies_its_commands_and_late_ones(spark):
    scratch = tempfile.mkdtemp(prefix="st2r-")
    store, analista = _small_store(spark, scratch)
    log = f"{scratch}/applied"
    _commands(spark, [(1, 20, 1, "a"), (2, 21, 2, "b")], f"{scratch}/one")
    status_stream.start(spark, f"{scratch}/one", store, analista, f"{scratch}/c1", applied_log=log).awaitTermination(300)
    assert _diagnoses(store) == {1: "a", 2: "b"} and store.versions() == [0, 1]
    # A second stream, epochs from 0 again: an older command, a repeated one and a new one.
    _commands(spark, [(3, 2, 3, "late"), (2, 25, 2, "again"), (4, 26, 4, "new")], f"{scratch}/two")
    status_stream.start(spark, f"{scratch}/two", store, analista, f"{scratch}/c2", applied_log=log).awaitTermination(300)
    assert _diagnoses(store) == {1: "a", 2: "b", 3: "late", 4: "new"} and store.versions() == [0, 1, 2]
    # The first stream goes on where it was.
    _commands(spark, [(5, 3, 5, "very late")], f"{scratch}/one")
    status_stream.start(spark, f"{scratch}/one", store, analista, f"{scratch}/c1", applied_log=log).awaitTermination(300)
    assert _diagnoses(store) == {1: "a", 2: "b", 3: "late", 4: "new", 5: "very late"}


def test_replayed_epoch_applies_once(spark):
    scratch = tempfile.mkdtemp(prefix="st2e-")
    store, analista = _small_store(spark, scratch)
    _commands(spark, [(1, 20, 1, "a")], f"{scratch}/one")
    batch = spark.read.schema(S.STATUS_CMD).parquet(f"{scratch}/one")
    log = SnapshotStore(spark, f"{scratch}/applied")
    run = status_stream.apply_batch(store, analista, "abc", log)
    log.write(batch.select("cmd_id"), origin=("abc", 0))  # the first attempt died between log and snapshot
    run(batch, 0)
    run(batch, 0)
    assert store.versions() == [0, 1] and _diagnoses(store) == {1: "a"}
    run(batch, 1)  # the same commands delivered again, as a new epoch
    assert store.versions() == [0, 1, 2] and _diagnoses(store) == {1: "a"}


def test_one_command_rewrites_one_bucket(spark, small):
    scratch = tempfile.mkdtemp(prefix="st2b-")
    store = BucketStore(spark, f"{scratch}/tickets", S.TICKET, "id_ticket", 16)
    store.write(small.ticket)
    first = store.locations()
    ticket = small.ticket.where("id_analista is not null").first()
    analista = spark.createDataFrame([(ticket.id_analista, 77, 1)], S.ANALISTA)
    cmd = spark.createDataFrame([(1, dt.datetime(2024, 1, 1), ticket.id_ticket, 77, "Cerrado", None, "done")], S.STATUS_CMD)
    status_stream.apply_batch(store, analista, "s", None)(cmd, 0)
    moved = {b for b, path in store.locations().items() if path != first[b]}
    assert len(moved) == 1 and store.versions() == [0, 1]
    assert store.read_latest().count() == small.ticket.count()
    assert store.read_latest().where(f"id_ticket = {ticket.id_ticket}").first().diagnostico == "done"
    before = store.read_latest()
    store.compact()
    assert before.exceptAll(store.read_latest()).count() == 0 and len({p.split("/v=")[1][:12] for p in store.locations().values()}) == 1
