import datetime as dt

from pyspark.sql import functions as F

from fleetscope.operators import timeline
from fleetscope.operators.detect import Rule, detect_tumbling
from fleetscope.sources.checks import check, registry
from fleetscope.streaming import streams


def drain(df, path, mode="append"):
    df.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/c").trigger(availableNow=True).format("parquet").option("path", f"{path}/rows").start().awaitTermination()
    return df.sparkSession.read.parquet(f"{path}/rows")


def source(spark, df, path, files=3):
    df.repartition(files).write.parquet(f"{path}/in")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")


def events(spark, n=300):
    start = dt.datetime(2026, 1, 1)
    rows = [("h", str(k), start + dt.timedelta(minutes=k), "authentication", "failure" if k % 3 else "success", f"u{k % 4}") for k in range(n)]
    return spark.createDataFrame(rows, "host_id string, event_id string, ts timestamp, event_category string, event_outcome string, subject_name string")


def test_windowed_detection_equals_the_batch(spark, tmp_path):
    rule = Rule("r", "event_outcome = 'failure'", ("subject_name",), 3, 3600)
    e = events(spark)
    batch = {r.event_id: r["count"] for r in detect_tumbling(e, rule).collect()}
    stream = {r.event_id: r["count"] for r in drain(streams.detect_stream(source(spark, e.orderBy("ts").coalesce(1), tmp_path, 1), rule, "1 minute"), tmp_path).collect()}
    assert stream and stream.items() <= batch.items()
    assert len(batch) - len(stream) <= 4


def test_append_sink_is_idempotent(spark, tmp_path):
    e = events(spark, 50)
    both = e.unionByName(e)
    sink = streams.append_sink(f"{tmp_path}/table")
    for k in range(2):
        streams.start(source(spark, both, f"{tmp_path}/{k}"), sink, f"{tmp_path}/c{k}").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/table").count() == 50


def test_state_sink_emits_changes(spark, tmp_path):
    schema = "k string, v string"
    seen = []
    sink = streams.state_sink(f"{tmp_path}/state", ["k"], "w", "t", lambda df: seen.extend(df.collect()))
    sink(spark.createDataFrame([("a", "1"), ("b", "2")], schema), 0)
    sink(spark.createDataFrame([("a", "9"), ("c", "3")], schema), 1)
    assert {(r.event_action, r.object_name, r.change_field) for r in seen} == {("state_changed", "a", "v"), ("state_added", "c", ""), ("state_removed", "b", "")}
    assert {r.k for r in spark.read.parquet(f"{tmp_path}/state/v1").collect()} == {"a", "c"}


def test_snapshot_events_keep_the_last_snapshot(spark, tmp_path):
    rows = [("h", 1, minute(0), ["a", "b"]), ("h", 2, minute(1), ["b", "c"]), ("h", 3, minute(2), []), ("h", 4, minute(60 * 24 * 9), ["z"]), ("h", 5, minute(60 * 24 * 9 + 1), ["z", "y"])]
    df = spark.createDataFrame(rows, "host_id string, run bigint, ts timestamp, names array<string>").select("host_id", "run", "ts", F.transform("names", lambda x: F.struct(x.alias("k"))).alias("rows"))
    got = drain(streams.snapshot_events(source(spark, df.orderBy("ts").coalesce(1), tmp_path, 1), ["k"]), tmp_path)
    # The fourth comes after a silence beyond the horizon: a new baseline.
    assert {(r.run, r.k, r.action) for r in got.collect()} == {(2, "c", "appeared"), (2, "a", "vanished"), (3, "b", "vanished"), (3, "c", "vanished"), (5, "y", "appeared")}


def minute(k):
    return dt.datetime(2026, 1, 1) + dt.timedelta(minutes=k)


def test_chain_stream_equals_the_batch(spark, tmp_path):
    rows = [("h", str(k), minute(k), "7" if k == 0 else "", "s" if k in (0, 1) else "", "o" if k in (1, 2) else "btop" if k == 5 else "", "dnf install 'btop'" if k == 4 else "", "u" if k in (2, 3) else "", "m") for k in range(6)]
    df = spark.createDataFrame(rows, CHAIN_EVENT)
    got = {r.event_id: (r.chain_id, r.how) for r in drain(streams.chain_stream(source(spark, df, tmp_path, 1)), tmp_path).collect()}
    state = timeline.ChainState()
    want = {r[1]: state.assign(*r[3:]) for r in rows}
    assert got == want


CHAIN_EVENT = "host_id string, event_id string, ts timestamp, root string, socket string, object string, command string, user string, module string"


def test_chain_state_is_bounded_by_the_horizon(spark, tmp_path):
    """Every batch is ten minutes of events with sockets of their own; the horizon is twenty."""
    want, seen, at_socket = {}, [], {}
    for batch in range(12):
        rows = []
        for k in range(10):
            m, event = batch * 10 + k, f"{batch:02}-{k}"
            # Now and then a socket of half the horizon or of twice the horizon ago.
            socket = f"s{m}" if k else f"s{m - 9}" if batch % 2 else f"s{m - 39}"
            root = str(m) if k % 2 else ""
            led = at_socket.get(socket)
            chain = f"proc:{root}" if root else led[0] if led and m - led[1] <= 20 else "mod:m"
            want[event] = (chain, "ancestry" if root else "socket" if led and m - led[1] <= 20 else "time")
            at_socket[socket] = (chain, m)
            rows.append(("h", event, minute(m), root, socket, "", "", "", "m"))
        spark.createDataFrame(rows, CHAIN_EVENT).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(CHAIN_EVENT).parquet(f"{tmp_path}/in")
        q = streams.chain_stream(stream, horizon_ms=20 * 60_000, late="1 minute").writeStream.outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).format("parquet").option("path", f"{tmp_path}/rows").start()
        q.awaitTermination()
        seen += [sum(x["numRowsTotal"] for x in p["stateOperators"]) for p in q.recentProgress if p["stateOperators"]][-1:]
    got = {r.event_id: (r.chain_id, r.how) for r in spark.read.parquet(f"{tmp_path}/rows").collect()}
    assert got == want and {h for _, h in want.values()} == {"ancestry", "socket", "time"}
    assert max(seen[6:]) <= max(seen[:6]) and max(seen) < 60


def test_checks_and_registry(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "x int, y string")
    got = {r.detail: r.ok for r in check(df, {"rows": 2, "min_rows": 3, "contains": {"y": "b"}, "row1": {"x": 1}, "row0": {"x": 1}}, ["x"]).collect()}
    assert got == {"rows": True, "min_rows": False, "contains": True, "row1": False, "row0": True}
    assert {(r.table, r.n_rows) for r in registry({"a": df, "b": df.limit(0)}, "2026-01-01").collect()} == {("a", 2), ("b", 0)}
