import base64
import datetime
import json
import random

import pytest
from pyspark.sql import functions as F

from tessera.sources import sinks
from tessera.sources.paged import PagedStudies
from tessera.streaming import events, requests, upserts


def test_upsert_log(spark, tmp_path):
    log = upserts.UpsertLog(spark, f"file://{tmp_path}/s", "k string, v int, t string", "k", "v")
    schema = "k string, v int, t string"
    assert log.read().count() == 0 and log.compact() == -1
    for _ in range(2):  # the batch comes again
        log.write(spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), (None, 9, "z")], schema), 0)
    log.write(spark.createDataFrame([("a", 2, "late"), ("b", 1, "x"), ("b", 1, "y")], schema), 1)
    want = [("a", 3, "y"), ("b", 1, "y")]
    assert sorted(tuple(r) for r in log.read().collect()) == want
    assert log.compact() == 1 and sorted(tuple(r) for r in log.read().collect()) == want
    log.write(spark.createDataFrame([("a", 4, "new")], schema), 2)
    assert sorted(tuple(r) for r in log.read().collect()) == [("a", 4, "new"), ("b", 1, "y")]


def test_upserts_from_a_stream(spark, tmp_path):
    """An older version that comes later changes nothing, and a batch writes what it touched, not the table."""
    schema = "k long, v long, t string"
    log = upserts.UpsertLog(spark, f"file://{tmp_path}/log", schema, "k", "v")

    def feed(rows, name):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/in/{name}")
        upserts.run_upsert(spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*"), log, f"file://{tmp_path}/c").awaitTermination()

    feed([(k, 5, "first") for k in range(200)], "a")
    feed([(1, 4, "older"), (2, 6, "newer"), (2, 6, "newest")], "b")
    table = {r.k: (r.v, r.t) for r in log.read().collect()}
    assert len(table) == 200 and table[1] == (5, "first") and table[2] == (6, "newest")
    assert spark.read.schema(schema).parquet(log.folder(0)).count() == 200 and spark.read.schema(schema).parquet(log.folder(1)).count() == 2


def test_messages_are_parsed_once(spark, tmp_path):
    data = base64.b64encode(json.dumps({"patient_id": "p"}).encode()).decode()
    spark.createDataFrame([("m1", "2020-01-01 00:00:00", data), ("m1", "2020-01-01 00:00:01", data)], "message_id string, ts string, data string").write.parquet(f"{tmp_path}/in")
    raw = spark.readStream.schema("message_id string, ts string, data string").parquet(f"{tmp_path}/in")
    query = events.messages(raw).writeStream.format("memory").queryName("parsed").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c").start()
    query.awaitTermination()
    assert [r.patient_id for r in spark.sql("select * from parsed").collect()] == ["p"]


def test_windows_and_alerts(spark):
    df = spark.createDataFrame([("2020-01-01 00:01:00", 1.0), ("2020-01-01 00:09:59", 3.0), ("2020-01-01 00:10:00", 9.0)], "ts string, v double")
    made = events.window_average(df, "ts", "v")
    assert sorted(r.average for r in made.collect()) == [2.0, 9.0] and events.threshold_alerts(made, below=3.0).count() == 1


def test_status(spark):
    asked = spark.createDataFrame([("a", "t"), ("b", "t"), ("c", None), ("d", "t")], "k string, requested_at string")
    done = spark.createDataFrame([("a", "passed"), ("d", "failed")], "k string, status string")
    assert {r.k: r.state for r in events.request_status(asked, done, "k").collect()} == {"a": "completed", "b": "processing", "c": "not_started", "d": "failed"}


def test_metrics_and_files(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.0, float("nan"))], "run int, a double, b double")
    assert sinks.to_metrics(df, ["a"], ["run"]).first().value == 2.0
    sinks.write_records(df, f"file://{tmp_path}/r", "diabetes", "2020-01-01")
    assert spark.read.json(f"file://{tmp_path}/r").select("a").first().a == 2.0
    sinks.write_report(df, f"file://{tmp_path}/report")
    assert json.loads(spark.read.text(f"file://{tmp_path}/report").first().value)["run"] == 1
    sinks.write_csv(df.select(F.lit('q"\n').alias("x")), f"file://{tmp_path}/csv", 1000)
    assert spark.read.option("multiLine", True).option("header", True).option("quote", '"').option("escape", '"').csv(f"file://{tmp_path}/csv").first().x == 'q"\n'


def test_corrupt_messages_are_told_apart(spark, tmp_path):
    good = base64.b64encode(b'{"patient_id": "p"}').decode()
    rows = [("m1", "2020-01-01 00:00:00", good), ("m2", "2020-01-01 00:00:01", base64.b64encode(b"{").decode()), ("m3", "2020-01-01 00:00:02", "%%%"), ("m4", "2020-01-01 00:00:03", None), ("m5", "2020-01-01 00:00:04", base64.b64encode(b"\xff\xfe").decode())]
    found = events.messages(spark.createDataFrame(rows, "message_id string, ts string, data string"), corrupt="corrupt")
    assert {r.message_id: (r.patient_id, r.corrupt) for r in found.collect()} == {"m1": ("p", False)} | {f"m{i}": (None, True) for i in (2, 3, 4, 5)}


T0 = datetime.datetime(2024, 1, 1)


def test_polls_in_any_order_within_the_delay(spark, tmp_path):
    rng = random.Random(3)
    kinds = ["request", "completed", "failed", "poll", "poll", "other"]
    rows = [(rng.randrange(4), i, T0 + datetime.timedelta(seconds=rng.randrange(0, 1800) + 1800 * (i // 60)), rng.choice(kinds)) for i in range(180)]
    tick = [(-1, -1, T0 + datetime.timedelta(days=1), "other")]
    schema = "key long, event long, ts timestamp, kind string"
    for n, part in enumerate([rows[:60], rows[60:120], rows[120:], tick]):
        spark.createDataFrame(part, schema).repartition(3).write.parquet(f"{tmp_path}/in/s{n}")
        told = requests.stream_poll_states(spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*"), "1 hour").writeStream.option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True)
        requests.with_state_store(spark, lambda: told.start(f"{tmp_path}/out", "parquet")).awaitTermination()
    want = []
    for key in range(4):
        state = "not_started"
        for _, event, ts, kind in sorted((r for r in rows if r[0] == key), key=lambda r: (r[2], r[1])):
            if kind == "poll":
                want.append((key, event, ts, state))
            state = requests.STATES.get(kind, state)
    assert sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == sorted(want)
    assert sorted(tuple(r) for r in requests.poll_states(spark.createDataFrame(rows, schema)).collect()) == sorted(want)
    assert {w[3] for w in want} == {"not_started", "processing", "completed", "failed"}


def test_alerts_need_a_run(spark):
    hours = [(0, 9), (1, 9), (2, 9), (3, 9), (4, 1), (5, 9), (6, 9), (8, 9), (9, 9), (10, 9), (12, 9), (13, 9), (14, 9)]
    windows = spark.createDataFrame([("a", T0 + datetime.timedelta(hours=h), float(v)) for h, v in hours], "key string, start timestamp, average double")
    found = sorted((r.at.hour, r.event, r.since.hour, r.windows) for r in requests.sustained(windows, width="1 hour", runs=3, above=5.0).collect())
    assert found == [(3, "firing", 0, 3), (4, "recovered", 0, 4), (11, "firing", 8, 3), (11, "recovered", 8, 3), (15, "firing", 12, 3)]  # the last is open


def test_paged_stream_goes_on_where_it_stopped(spark, tmp_path):
    spark.dataSource.register(PagedStudies)

    def page(n, more, text=None):
        (tmp_path / f"page-{n}.json").write_text(text or json.dumps({"studies": [{"i": n * 10 + k} for k in range(3)] + ["bad"]} | ({"nextPageToken": f"t{n + 1}"} if more else {})))

    def run(mode):
        stream = spark.readStream.format("paged_studies").options(url=f"file://{tmp_path}", query="x", sleep="0", mode=mode, pages_per_batch="2").load()
        stream.writeStream.option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start(f"{tmp_path}/out", "parquet").awaitTermination()
        return sorted(json.loads(r.study)["i"] for r in spark.read.parquet(f"{tmp_path}/out").collect())

    for n in range(5):
        page(n, n < 4, "{" if n == 3 else None)
    assert run("permissive") == [0, 1, 2, 10, 11, 12]  # two pages a batch
    assert run("permissive") == [0, 1, 2, 10, 11, 12, 20, 21, 22]  # the page before the broken one
    with pytest.raises(Exception):
        run("failfast")
    page(3, True)
    (tmp_path / "page-0.json").write_text("{")  # no page is read again
    for _ in range(2):
        found = run("failfast")
    assert found == [n * 10 + k for n in range(5) for k in range(3)]


def test_paged_stream_takes_more_pages_while_the_interface_is_ahead(spark, tmp_path):
    """A run of one small batch after another never ended on a long interface."""
    spark.dataSource.register(PagedStudies)
    for q in "ab":
        for n in range(40):
            (tmp_path / f"query={q}/page={n}").mkdir(parents=True)
            (tmp_path / f"query={q}/page={n}/part-0").write_text(json.dumps({"studies": [{"i": n}]} | ({"nextPageToken": "t"} if n < 39 else {})))
    stream = spark.readStream.format("paged_studies").options(url=f"file://{tmp_path}", query="a;b", sleep="0", pages_per_batch="2", max_pages_per_batch="16").load()
    query = stream.writeStream.option("checkpointLocation", f"{tmp_path}/c").start(f"{tmp_path}/out", "parquet")
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    found = sorted((r.query, r.page) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert found == [(q, n) for q in "ab" for n in range(40)]
    assert len([f for f in (tmp_path / "c/commits").iterdir() if f.name.isdigit()]) <= 8  # 2, 4, 8, 16, the rest, and one without pages; 20 before


def test_a_poll_state_is_one_value_read_and_written_once_a_call():
    """Each call to the state store is a round trip for each key; a list beside the state made ten of them."""
    import types

    import pandas as pd

    class Store:
        value, calls, timers = None, 0, []

        def get(self):
            self.calls += 1
            return self.value

        def update(self, value):
            self.calls, self.value = self.calls + 1, value

    store = Store()
    handle = types.SimpleNamespace(getValueState=lambda *a: store, registerTimer=store.timers.append)
    machine = requests.RequestStates()
    machine.init(handle)
    frame = pd.DataFrame({"us": [5_000, 1_000, 9_000], "event": [2, 1, 3], "kind": ["poll", "request", "poll"]})
    list(machine.handleInputRows((7,), iter([frame]), None))
    assert store.calls == 2 and store.timers == [2]
    out = pd.concat(machine.handleExpiredTimer((7,), types.SimpleNamespace(getCurrentWatermarkInMs=lambda: 6), None))
    assert out.values.tolist() == [[7, 2, 5_000, "processing"]] and store.calls == 4 and store.timers == [2, 10]
    list(machine.handleExpiredTimer((7,), types.SimpleNamespace(getCurrentWatermarkInMs=lambda: 6), None))
    assert store.calls == 5 and store.timers == [2, 10]
