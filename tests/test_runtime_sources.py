import json

import pandas as pd
import pyarrow as pa
import pytest
from helpers import rows

from weftplan import InputBinding, OutputBinding, PlanBuilder, Resource, Runtime, Schema, col
from weftplan import functions as fn
from weftplan import types as t
from weftplan.errors import AdapterError, BindingError, CancelledError, CapabilityError, ExtensionError, PartlyWrittenError, ResourceError, SchemaError, TimedOutError, UnknownOutcomeError
from weftplan.runtime import CancellationToken, Event, MemorySink, Mode
from weftplan.runtime.evidence import classify, redact
from weftplan.sources import ReadRequest, Registry, Root, WriteMode, WriteResult, infer_format, pushdown, read, write_file

S = Schema.of(("id", t.INT64), ("status", t.STRING))


def plan(outputs=1):
    b = PlanBuilder("p")
    x = b.filter("f", b.input("x", S), col("id") > 0)
    for i in range(outputs):
        b.output(f"o{i}", b.limit(f"l{i}", x, 10 + i) if i else x)
    return b.build()


@pytest.fixture
def df(spark):
    return spark.createDataFrame([(1, "a"), (0, "b"), (2, None)], S.to_spark())


def test_events_manifest_and_bindings(spark, df):
    sink = MemorySink()
    got = Runtime(spark, [sink]).execute(plan(), [InputBinding.from_native("x", df)], correlation="c1", mode=Mode.EAGER)
    assert rows(got.output()) == [(1, "a"), (2, None)] and got.manifest.status == "succeeded" and got.manifest.correlation == "c1"
    assert sink.names() == [Event.BEGUN, Event.RESOLVED, Event.BOUND, Event.LOWERED, Event.ENDED] and got.manifest.retries == ()
    assert [n.code for n in got.manifest.diagnostics] == []
    assert [r.attributes["status"] for r in sink.records if "status" in r.attributes] == ["created", "running", "succeeded"]
    assert [r.value for r in sink.records if r.kind == "gauge"] == [2.0] and "Physical Plan" in got.explain()
    got.close()
    for value in (pa.table({"id": [1], "status": ["a"]}), pd.DataFrame({"id": [1], "status": ["a"]})):
        assert rows(Runtime(spark).execute(plan(), {"x": value}).output()) == [(1, "a")]
    for bad in ({}, {"x": df, "y": df}, {"y": df}, {"x": object()}):
        with pytest.raises(BindingError):
            Runtime(spark).execute(plan(), bad)
    assert set(Runtime(spark).execute(plan(2), {"x": df}).outputs) == {"o0", "o1"}


def test_drift_is_an_error_and_widening_is_not(spark, df):
    assert rows(Runtime(spark).execute(plan(), {"x": df.selectExpr("status", "cast(id as int) id")}).output()) == [(1, "a"), (2, None)]
    for bad in (df.drop("status"), df.selectExpr("status as id", "status")):
        with pytest.raises(SchemaError):
            Runtime(spark).execute(plan(), {"x": bad})


def test_failures_are_classified(spark, df):
    class Broken:
        def emit(self, record):
            raise RuntimeError

    with pytest.raises(BindingError) as e:
        Runtime(spark, [Broken()]).execute(plan(), {})
    assert e.value.manifest.failure.category == "configuration" and e.value.manifest.status == "failed"
    b = PlanBuilder("p")
    b.output("o", b.cast("c", b.input("x", S), "status", t.INT64))
    with pytest.raises(AdapterError) as e:
        Runtime(spark).execute(b.build(), {"x": df}, mode=Mode.EAGER)
    assert e.value.__cause__ is not None and classify(e.value).category == "external_provider"
    token = CancellationToken()
    token.cancel()
    sink = MemorySink()
    with pytest.raises(CancelledError) as e:
        Runtime(spark, [sink]).execute(plan(), {"x": df}, token=token)
    last = sink.records[-1]
    assert e.value.manifest.status == "cancelled" and Event.STOP_ASKED in sink.names() and last.name == Event.ENDED and last.attributes["confirmed"] and last.attributes["status"] == "cancelled"
    assert classify(PermissionError("x")).decision == "do_not_retry" and classify(TimeoutError()).decision == "retry"


def test_uncertain_writes_ask_for_reconciliation(spark, df, tmp_path):
    def run(writer, outputs=1, sink=None):
        reg = Registry()
        reg.register("file", writer)
        out = [OutputBinding.to_resource(f"o{i}", Resource(str(tmp_path / f"{i}.parquet"))) for i in range(outputs)]
        return Runtime(spark, [sink] if sink else [], writers=reg).execute(plan(outputs), {"x": df}, out)

    sink = MemorySink()
    with pytest.raises(UnknownOutcomeError) as e:
        run(lambda spark, r, df, mode, safety: WriteResult(r.uri, "parquet", mode, "unknown_outcome"), sink=sink)
    m = e.value.manifest
    assert m.status == "unknown_outcome" and m.failure.category == "unknown_outcome" and m.failure.uncertainty == "requires_reconciliation" and m.failure.decision == "reconcile"
    assert sink.records[-1].attributes["uncertainty"] == "requires_reconciliation" and Event.TARGET_WRITTEN not in sink.names()

    def second_fails(spark, r, df, mode, safety):
        if r.uri.endswith("1.parquet"):
            raise PermissionError("no")
        return write_file(spark, r, df, mode, safety)

    with pytest.raises(PartlyWrittenError) as e:
        run(second_fails, 2)
    assert e.value.manifest.status == "requires_reconciliation" and e.value.manifest.failure.decision == "reconcile" and e.value.written == (str(tmp_path / "0.parquet"),)
    with pytest.raises(AdapterError) as e:  # nothing was written
        run(lambda *a: (_ for _ in ()).throw(PermissionError("no")))
    assert e.value.manifest.status == "failed" and e.value.manifest.failure.category == "authorization"


def test_a_run_that_takes_too_long(spark):
    slow = spark.range(0, 200_000, numPartitions=4).selectExpr("id", "cast(java_method('java.lang.Thread', 'sleep', bigint(if(id % 100 = 0, 50, 0))) as string) status")
    sink = MemorySink()
    with pytest.raises(TimedOutError) as e:
        Runtime(spark, [sink]).execute(plan(), {"x": slow}, mode=Mode.EAGER, timeout=1.0)
    m = e.value.manifest
    assert m.status == "timed_out" and m.failure.category == "timeout" and m.failure.decision == "retry" and sink.records[-1].attributes["confirmed"]
    assert Runtime(spark).execute(plan(), {"x": spark.createDataFrame([(1, "a")], S.to_spark())}, mode=Mode.EAGER, timeout=600).manifest.status == "succeeded"


@pytest.mark.parametrize(("text", "category"), [("[PATH_NOT_FOUND] x", "not_found"), ("Status Code: 403, AccessDenied", "authorization"), ("InvalidAccessKeyId", "authentication"), ("503 SlowDown", "rate_limited"), ("java.net.ConnectException", "transient"), ("java.lang.OutOfMemoryError", "resource_exhausted"), ("x is not a Parquet file", "integrity"), ("FileAlreadyExistsException: y", "conflict"), ("read: SocketTimeoutException", "timeout"), ("odd", "external_provider")])
def test_causes_by_what_spark_says(text, category):
    e = AdapterError("Spark failed")
    e.__cause__ = RuntimeError(text)
    assert classify(e).category == category


def test_repeated_tasks_are_reported():
    from types import SimpleNamespace as N

    from weftplan.runtime.execute import repeated, running

    some = lambda x: N(isDefined=lambda: True, get=lambda: x)
    stages = {1: N(currentAttemptId=lambda: 0, numFailedTasks=lambda: 0), 2: N(currentAttemptId=lambda: 1, numFailedTasks=lambda: 3)}
    job = lambda status: some(N(status=lambda: N(toString=lambda: status), stageIds=lambda: [1, 2]))
    tracker = N(getJobIdsForTag=lambda tag: [7], getJobInfo=lambda j: job("RUNNING"), getStageInfo=lambda s: some(stages[s]))
    spark = N(sparkContext=N(_jsc=N(sc=lambda: N(statusTracker=lambda: tracker))))
    assert repeated(spark, "t") == ("stage 2: attempt 1, 3 failed tasks",) and running(spark, "t", 0.1)
    tracker.getJobInfo = lambda j: job("SUCCEEDED")
    assert not running(spark, "t", 0.1)


def test_order_without_a_key_is_noted(spark, df):
    b = PlanBuilder("p")
    b.output("o", b.deduplicate("d", b.input("x", S), ["status"]))
    got = Runtime(spark).execute(b.build(), {"x": df})
    assert [n.code for n in got.manifest.diagnostics] == ["WEFT-ORDER-001"]


def test_replace_keeps_the_old_data_until_the_new_is_there(spark, df, tmp_path, monkeypatch):
    from weftplan.sources import files

    r = Resource(str(tmp_path / "x.parquet"))
    write_file(spark, r, df)
    # a plan may replace what it reads
    b = PlanBuilder("p")
    b.output("o", b.derive("d", b.input("x", S), "id", col("id") + 10, replace_existing=True))
    Runtime(spark).execute(b.build(), {"x": r}, [OutputBinding.to_resource("o", r, WriteMode.REPLACE)])
    want = [(10, "b"), (11, "a"), (12, None)]
    assert rows(read(spark, ReadRequest(r, S)).df) == want
    bad = spark.range(5).selectExpr("id", "cast(raise_error('stop') as string) status")
    with pytest.raises(ResourceError) as e:
        write_file(spark, r, bad, WriteMode.REPLACE)
    assert not isinstance(e.value, UnknownOutcomeError) and rows(read(spark, ReadRequest(r, S)).df) == want
    new = Resource(str(tmp_path / "new.parquet"))
    with pytest.raises(ResourceError):
        write_file(spark, new, bad)
    assert sorted(p.name for p in tmp_path.iterdir()) == ["x.parquet"]

    def move(self, a, b, f=files._Files.move):
        if ".new-" in a:
            raise OSError("gone")
        f(self, a, b)

    monkeypatch.setattr(files._Files, "move", move)
    with pytest.raises(UnknownOutcomeError):
        write_file(spark, r, df, WriteMode.REPLACE)
    assert rows(read(spark, ReadRequest(r, S)).df) == want  # put back


def test_evidence_is_what_the_scan_got(spark, tmp_path):
    path = str(tmp_path / "p.parquet")
    spark.createDataFrame([(i, f"A{i}", "FR" if i % 2 else "US") for i in range(10)], "id long, name string, country string").write.partitionBy("country").parquet(path)

    def evidence(**kw):
        return read(spark, ReadRequest(Resource(path), **kw)).evidence

    assert evidence() == {"projection": "not_requested", "predicate": "not_requested", "partition_pruning": "not_requested"}
    assert evidence(predicate=fn.lower(col("name")) == "a3")["predicate"] == "post_scan"
    assert evidence(predicate=(col("id") > 3) & (fn.lower(col("name")) == "a3"))["predicate"] == "post_scan"
    assert evidence(predicate=(col("id") > 3) & (col("name") == "A5"))["predicate"] == "source"
    assert evidence(predicate=col("name").is_not_null())["predicate"] == evidence(predicate=col("name").is_null())["predicate"] == "source"
    assert evidence(predicate=col("country") == "FR")["predicate"] == "source"
    assert evidence(columns=("id",), predicate=col("name") == "A5") == {"projection": "source", "predicate": "source", "partition_pruning": "not_requested"}


def test_large_arrow_files_do_not_go_through_the_driver(spark, df, tmp_path, monkeypatch):
    from weftplan.sources import files

    r = Resource(str(tmp_path / "x.arrow"))
    write_file(spark, r, df)
    assert read(spark, ReadRequest(r, S)).df.count() == 3
    monkeypatch.setattr(files, "ARROW_LIMIT", 10)
    with pytest.raises(ResourceError):
        read(spark, ReadRequest(r, S))


def test_redaction():
    assert redact("password=abc https://u:p@h/x") == "password=*** https://***@h/x"
    assert redact({"api_key": "abc", "a": ["token: x"]}) == {"api_key": "***", "a": ["token: ***"]}


@pytest.mark.parametrize("suffix", ["csv", "jsonl", "parquet", "arrow"])
def test_round_trip(spark, df, tmp_path, suffix):
    r = Resource(str(tmp_path / f"x.{suffix}"))
    got = Runtime(spark).execute(plan(), {"x": df}, [OutputBinding.to_resource("o0", r)])
    assert got.writes[0].format == suffix and got.lineage.resources == (("output", "o0", r.uri),)
    assert rows(Runtime(spark).execute(plan(), {"x": r}).output()) == [(1, "a"), (2, None)]
    for mode in (WriteMode.CREATE_NEW, WriteMode.FAIL_IF_EXISTS):
        with pytest.raises(ResourceError):
            write_file(spark, r, df, mode)
    write_file(spark, r, df.limit(1), WriteMode.REPLACE)
    assert read(spark, ReadRequest(r, S)).df.count() == 1
    if suffix in ("csv", "jsonl"):
        write_file(spark, r, df, WriteMode.APPEND)
        assert read(spark, ReadRequest(r, S)).df.count() == 4
        with pytest.raises(ResourceError):
            write_file(spark, r, df, WriteMode.APPEND, "safe")
    else:
        with pytest.raises(ResourceError):
            write_file(spark, r, df, WriteMode.APPEND)


def test_pushdown_and_partitions(spark, tmp_path):
    path = str(tmp_path / "p.parquet")
    spark.createDataFrame([(i, i * 10, "FR" if i % 2 else "US") for i in range(10)], "id long, amount long, country string").write.partitionBy("country").parquet(path)
    got = read(spark, ReadRequest(Resource(path), columns=("id",), predicate=col("amount") > 20, partition_filters=(("country", "FR"),)))
    assert rows(got.df) == [(3,), (5,), (7,), (9,)] and got.evidence == {"projection": "source", "predicate": "source", "partition_pruning": "source"}
    seen = pushdown(got.df)
    assert "GreaterThan(amount,20)" in seen["PushedFilters"][0] and "country" in seen["PartitionFilters"][0] and seen["ReadSchema"] == ["struct<id:bigint,amount:bigint>"]
    csv = Resource(str(tmp_path / "x.csv"))
    write_file(spark, csv, got.df)
    assert read(spark, ReadRequest(csv, columns=("id",))).evidence["projection"] == "post_scan"
    for bad in (lambda: read(spark, ReadRequest(csv, partition_filters=(("id", "1"),))), lambda: ReadRequest(csv, columns=("a", "a"))):
        with pytest.raises(ResourceError):
            bad()


def test_formats_roots_and_registries(spark, df, tmp_path):
    assert infer_format(Resource("x.bin", "text/csv; charset=utf-8")) == "csv" and infer_format(Resource("a/b.FEATHER")) == "arrow"
    with pytest.raises(ResourceError):
        infer_format(Resource("x.txt"))
    root = Root(str(tmp_path))
    assert root.resolve(Resource("a/x.csv")) == str(tmp_path.resolve() / "a/x.csv")
    for bad in ("../x.csv", "/etc/passwd", "s3://b/x.csv"):
        with pytest.raises(ResourceError):
            root.resolve(Resource(bad))
    reg = Registry()
    reg.register("mem", lambda spark, r, schema, credential: df)
    assert Runtime(spark, readers=reg).execute(plan(), {"x": Resource("mem://x")}).output().count() == 2
    with pytest.raises(ExtensionError):
        reg.freeze().register("y", None)
    with pytest.raises(ResourceError):
        Runtime(spark).execute(plan(), [InputBinding.from_resource("x", Resource("x.csv"), "secret-id")])
    with pytest.raises(ResourceError):
        Runtime(spark).execute(plan(), {"x": Resource("ftp://h/x.csv")})


def test_streaming(spark, df, tmp_path):
    from weftplan.streaming import read_stream, start, transform

    df.write.parquet(str(tmp_path / "in"))
    b = PlanBuilder("s")
    x = b.derive("d", b.filter("f", b.input("x", S), col("id") > 0), "up", fn.upper(col("status")))
    b.output("o", b.rename("r", x, {"up": "UP"}))
    stream = read_stream(spark, str(tmp_path / "in"), S)
    q = start(b.build(), {"x": stream}, "o", "memory", str(tmp_path / "cp"), queryName="streamed")
    q.processAllAvailable()
    q.stop()
    assert rows(spark.table("streamed")) == [(1, "a", "A"), (2, None, None)]
    b = PlanBuilder("s")
    b.output("o", b.sort("z", b.input("x", S), ["id"]))
    with pytest.raises(CapabilityError):
        transform(b.build(), {"x": stream})
    assert json.dumps(1) == "1"
