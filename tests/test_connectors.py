"""Sources that follow pages, the file sink, the fetch cache, the outbox and keyed streams, with failures in between."""

import json
import os
import random
import subprocess
import sys
import uuid

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from leafwright.operators import state
from leafwright.shelf import Shelf
from leafwright.sources import cache, connectors, payloads
from leafwright.streaming import outbox, requests, watching


def pages(at):
    """Three pages of two books for a, one for b, an endless chain for c; calls are noted as files."""
    book = lambda k: {"id": k, "title": f" T{k} ", "authors": [{"name": "A"}, {"name": "B"}], "formats": {"application/epub+zip": f"u{k}"}}
    held = {f"a{k}": {"next": f"a{k + 1}" if k < 2 else None, "results": [book(10 * k), book(10 * k + 1)]} for k in range(3)}
    held |= {"b0": {"results": [book(50)]}, "c0": {"next": "c0", "results": [book(70)]}, "d0": {"next": None}}
    held = {k: json.dumps(v) for k, v in held.items()}

    def fetch(name):
        with open(os.path.join(at, f"{name}-{uuid.uuid4().hex}"), "w"):
            return held[name]

    return fetch


def test_pages_are_followed_until_the_limit(spark, tmp_path):
    connectors.register(spark, connectors.page_source(pages(str(tmp_path)), lambda q: f"{q}0", name="pages_of_test"))
    read = lambda limit: spark.read.format("pages_of_test").option("limit", limit).load()
    chosen = read(3).where("query = 'a' and page_no >= 0")
    found = payloads.catalogue(chosen, 3).orderBy("pos").collect()
    assert [(r["source_id"], r["title"], r["author"], r["fetch_url"]) for r in found] == [("0", "T0", "A, B", "u0"), ("1", "T1", "A, B", "u1"), ("10", "T10", "A, B", "u10")]
    assert sorted(f.name[:2] for f in tmp_path.iterdir()) == ["a0", "a1"]  # the third page isn't asked for
    both = read(4).where(F.col("query").isin("b", "c", "d"))
    assert sorted((r["query"], r["page_no"]) for r in both.collect()) == [("b", 0), ("c", 0), ("c", 1), ("c", 2), ("c", 3), ("d", 0)]
    assert both.rdd.getNumPartitions() == 3  # a task for each query
    assert read(4).where("query = 'a' and query = 'b'").count() == 0
    with pytest.raises(Exception, match="no query"):
        read(4).count()
    plan = chosen._jdf.queryExecution().executedPlan().toString()
    kept = next(line for line in plan.splitlines() if "Filter (" in line)
    assert "page_no" in kept and "query" not in kept  # Spark doesn't check again what the source took over


def file_rows(spark, names):
    return spark.createDataFrame([(n, n.encode() * 3) for n in names], "name string, content binary")


def test_files_are_published_once_and_together(spark, tmp_path):
    at = str(tmp_path / "out")
    connectors.register(spark, connectors.FileSink)
    save = lambda rows, mode="append": rows.write.format("named_files").mode(mode).option("path", at).save()
    names = [f"b{k}.epub" for k in range(20)]
    save(file_rows(spark, names).repartition(5))
    shelf = Shelf(at)
    assert shelf.names() == sorted(names) and shelf.read("b3.epub") == b"b3.epub" * 3
    with pytest.raises(Exception, match="there already"):
        save(file_rows(spark, ["new.epub", "b3.epub"]))
    with pytest.raises(Exception, match="there already"):
        save(file_rows(spark, ["x.epub", "x.epub"]))
    with pytest.raises(Exception, match="no file name"):
        save(file_rows(spark, ["y.epub", "../z.epub"]))
    assert shelf.names() == sorted(names)  # none of these left anything
    save(file_rows(spark, ["b3.epub", "other.epub"]), "overwrite")
    assert shelf.names() == ["b3.epub", "other.epub"]


def test_a_task_that_dies_publishes_nothing(tmp_path):
    """What Spark does with a failed and repeated task: the first attempt's draft is never named."""

    class Options(dict):
        pass

    writer = connectors._Files(Options(path=str(tmp_path / "out")), overwrite=False)
    first = writer.write([{"name": "a.epub", "content": b"1"}])
    with pytest.raises(ValueError):
        writer.write([{"name": "b.epub", "content": b"2"}, {"name": None, "content": b"3"}])
    again = writer.write([{"name": "b.epub", "content": b"2"}])
    writer.commit([first, again, None])
    shelf = Shelf(str(tmp_path / "out"))
    assert shelf.names() == ["a.epub", "b.epub"] and shelf.read("b.epub") == b"2"
    lost = writer.write([{"name": "c.epub", "content": b"4"}])
    writer.abort([lost, None])
    assert shelf.names() == ["a.epub", "b.epub"] and not os.path.exists(lost.files[0][1])


def test_each_address_is_fetched_once(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()

    def fetch(url):
        (calls / f"{url.replace('/', '_')}-{uuid.uuid4().hex}").touch()
        if "bad" in url and sum(1 for f in calls.iterdir() if "bad" in f.name) < 2:
            raise OSError("down")
        return url.encode()

    rows = [(k, u) for k, u in enumerate(["s/x.epub", "s/y.txt", "s/x.epub", None, "", "s/bad", "s/x.epub", "s/epub/z"])]
    frame = spark.createDataFrame(rows, "n long, fetch_url string").repartition(4)
    got = {r["n"]: (r["format"], r["error"]) for r in cache.fetched(frame, str(tmp_path / "cache"), fetch).collect()}
    assert got == {0: ("epub", None), 1: ("txt", None), 2: ("epub", None), 3: ("txt", "no address"), 4: ("txt", "no address"), 5: ("txt", "OSError: down"), 6: ("epub", None), 7: ("epub", None)}
    again = {r["n"]: (r["path"], r["error"]) for r in cache.fetched(frame, str(tmp_path / "cache"), fetch).collect()}
    assert again[5][1] is None and open(again[5][0]).read() == "s/bad" and again[0][0] == again[2][0]
    count = {}
    for f in calls.iterdir():
        count[f.name.split("-")[0]] = count.get(f.name.split("-")[0], 0) + 1
    assert count == {"s_x.epub": 1, "s_y.txt": 1, "s_bad": 2, "s_epub_z": 1}


def test_messages_are_told_once(spark, tmp_path):
    sent = tmp_path / "sent"
    sent.mkdir()

    def send(message):
        (sent / f"{message}-{uuid.uuid4().hex}").touch()
        if message == "m3":
            raise OSError("away")

    folder = str(tmp_path / "box")
    box = outbox.Outbox(spark, folder, send)
    frame = lambda *ids: spark.createDataFrame([(f"{k}", f"m{k}") for k in ids], outbox.MESSAGES)
    box.post(frame(1, 2, 1), 0)
    # Batch 1 is kept and its run dies: before any call, and for one message between mark and result.
    frame(3, 4, 5).write.parquet(f"{folder}/posted/batch=1")
    assert {r["id"]: r["result"] for r in box.status().collect()} == {"1": "sent", "2": "sent", "3": "waiting", "4": "waiting", "5": "waiting"}
    import hashlib

    Shelf(f"{folder}/marks").put(hashlib.sha256(b"5").hexdigest(), b"")
    box.post(frame(3, 4, 5, 2), 1)  # the batch comes again, with what batch 0 had
    box.post(frame(4, 6), 2)
    assert {r["id"]: (r["result"], r["error"]) for r in box.status().collect()} == {"1": ("sent", None), "2": ("sent", None), "3": ("failed", "OSError: away"), "4": ("sent", None), "5": ("in doubt", None), "6": ("sent", None)}
    assert sorted(f.name.split("-")[0] for f in sent.iterdir()) == ["m1", "m2", "m3", "m4", "m6"]


def request_events(rnd, n):
    return [(rnd.randrange(6), k, rnd.choice([None, *state.STATES]), k % 50, rnd.choice([50, 60, 0, None])) for k in range(n)]


def test_judged_is_the_batch_rule(spark):
    rows = request_events(random.Random(5), 400)
    frame = spark.createDataFrame(rows, requests.EVENTS)
    steps = {(r["id"], r["seq"]): tuple(r[c] for c in ("before", "status", "allowed")) for r in state.transitions(frame.select("id", "seq", "status")).collect()}
    crossed = {(r["id"], r["seq"]): tuple(r[c] for c in ("done", "total", "pct", "bucket")) for r in state.crossings(frame.where("total is not null").select("id", "seq", "done", "total")).collect()}
    got = {key: requests.judged({r[1]: r[2:] for r in rows if r[0] == key}) for key in range(6)}
    assert {(key, seq): v[:3] for key, out in got.items() for (seq, kind), v in out.items() if kind == "transition"} == steps
    assert {(key, seq): v[3:] for key, out in got.items() for (seq, kind), v in out.items() if kind == "crossing"} == crossed


def test_requests_in_any_order_with_a_restart(spark, tmp_path):
    rnd = random.Random(6)
    rows = request_events(rnd, 90)
    events, store, checkpoint = (str(tmp_path / x) for x in ("events", "store", "checkpoint"))
    dealt = rows + rnd.sample(rows, 15)  # some come twice
    rnd.shuffle(dealt)
    for k in range(2):
        spark.createDataFrame(dealt[k::2], requests.EVENTS).coalesce(1).write.mode("append").parquet(events)
        assert requests.run(spark, events, store, checkpoint).awaitTermination(120)
    judged = {key: requests.judged({r[1]: r[2:] for r in rows if r[0] == key}) for key in range(6)}
    steps = sorted((r["id"], r["seq"], r["before"], r["status"], r["allowed"]) for r in requests.transitions(spark, store).collect())
    assert repr(steps) == repr(sorted((key, seq, *v[:3]) for key, out in judged.items() for (seq, kind), v in out.items() if kind == "transition"))
    crossed = sorted((r["id"], r["seq"], r["done"], r["total"], r["pct"], r["bucket"]) for r in requests.crossings(spark, store).collect())
    assert crossed == sorted((key, seq, *v[3:]) for key, out in judged.items() for (seq, kind), v in out.items() if kind == "crossing")
    # The worker that plans the state can't import this package where it isn't installed.
    (tmp_path / "processor").write_bytes(cloudpickle.dumps(requests.Requests()))
    script = "import sys, pickle; p = pickle.load(open('processor', 'rb')); assert p.idle is None and 'leafwright' not in sys.modules"
    environment = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    assert subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=environment, timeout=60).returncode == 0


def test_idle_requests_are_forgotten(spark, tmp_path):
    import time

    events, store = str(tmp_path / "events"), tmp_path / "store"
    add = lambda seq, status: spark.createDataFrame([(1, seq, status, None, None)], requests.EVENTS).coalesce(1).write.mode("append").parquet(events)
    add(1, "requested")
    with pytest.raises(ValueError, match="every"):
        requests.run(spark, events, str(store), str(tmp_path / "checkpoint"), idle=5)
    running = requests.run(spark, events, str(store), str(tmp_path / "checkpoint"), idle=100, every="500 milliseconds")
    steps = lambda: sorted(tuple(r) for r in requests.transitions(spark, str(store)).collect()) if store.exists() and any(store.iterdir()) else []
    try:
        end = time.time() + 90
        while not steps() and time.time() < end:
            time.sleep(0.5)
        batches = len(list(store.iterdir()))
        while len(list(store.iterdir())) < batches + 2 and time.time() < end:  # batches in which timers can fire
            time.sleep(0.5)
        add(2, "selected")
        while len(steps()) < 2 and time.time() < end:
            time.sleep(0.5)
        assert steps() == [(1, 1, None, "requested", True), (1, 2, None, "selected", False)]  # the first event isn't known any more
    finally:
        running.stop()


def test_progress_of_a_stream(spark, tmp_path):
    events, folder = str(tmp_path / "pairs"), str(tmp_path / "progress")
    schema = "n long, translation string"
    for rows in ([(1, "a"), (2, " "), (3, None)], [(4, "b")], [(5, "c"), (6, "d")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(events)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(events)
    with watching.ProgressTable(spark, folder) as table:
        watching.tracked(stream).writeStream.option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).format("parquet").start(str(tmp_path / "out")).awaitTermination(60)
    assert [tuple(r) for r in table.read().orderBy("batch").collect()] == [(0, 1, 3, 1, 3), (1, 1, 1, 2, 4), (2, 2, 2, 4, 6)]


def test_what_a_delivery_takes_out(spark):
    pushes = spark.createDataFrame([("a", 9, True), ("b", 9, False), ("c", 9, None)], "path string, seq long, pushed boolean")
    assert [tuple(r) for r in state.removals(pushes).collect()] == [("a", 9, "remove", None)]
    rows = spark.createDataFrame([(True, True), (True, None), (False, True), (False, False)], "f boolean, b boolean")
    said = [r[0] for r in rows.select(state.delivery_summary(F.lit("G"), F.col("f"), F.col("b"))).collect()]
    assert said == ["On the device: font G, book", "On the device: font G", "On the device: book", None]
