import json

from lodestar.streaming import streams


def test_append_is_idempotent(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    rows = [
        {"event_id": "1", "kind": "Click", "tech_id": "5", "value": "x", "at": "2024-01-01T00:00:00Z"},
        {"event_id": "1", "kind": "Click", "tech_id": "5", "value": "x", "at": "2024-01-01T00:00:00Z"},
        {"event_id": "2", "kind": "dwell", "tech_id": "6", "value": "2.5", "at": "2024-01-01T00:01:00Z"},
        {"event_id": "3", "kind": "dwell", "tech_id": "99", "value": "1", "at": "2024-01-01T00:01:00Z"},
        {"event_id": "4", "kind": "odd", "tech_id": "5", "value": "1", "at": "2024-01-01T00:01:00Z"},
    ]
    (src / "a.json").write_text("\n".join(map(json.dumps, rows)))
    items = spark.createDataFrame([(5,), (6,)], "tech_id long")
    run = lambda c: streams.append_existing(streams.validated(streams.events(spark, str(src))), items, out, str(tmp_path / c)).awaitTermination()
    run("c1")
    run("c2")  # all files again, from another checkpoint: nothing is added
    got = {(r.event_id, r.kind, r.tech_id, r.value) for r in spark.read.parquet(out).collect()}
    assert got == {("1", "click", 5, None), ("2", "dwell", 6, 2.5)}
    assert spark.read.parquet(out).count() == 2
    assert streams.new_since(spark.read.parquet(out), 1704067200).first().n == 1


def test_once_and_windows(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    rows = [{"event_id": str(i % 3), "kind": "click", "tech_id": "5", "value": None, "at": f"2024-01-0{i % 3 + 1}T00:00:00Z"} for i in range(6)]
    (src / "a.json").write_text("\n".join(map(json.dumps, rows)))
    df = streams.once(streams.validated(streams.events(spark, str(src))))
    q = df.writeStream.format("memory").queryName("once").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("once").count() == 3
    q = streams.rolling_counts(streams.validated(streams.events(spark, str(src)))).writeStream.format("memory").queryName("win").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("win").agg({"n": "max"}).first()[0] == 6


def test_alert_once(spark):
    pairs = spark.createDataFrame([(1, 2), (1, 3)], "asset_id long, other_id long")
    history = spark.createDataFrame([(1, "2")], "asset_id long, changed_from string")
    assert [tuple(r) for r in streams.alert_once(pairs, history).collect()] == [(1, 3)]


def test_queue_is_carried(spark, tmp_path):
    """New rows are staged once, rows for another try stay over runs, processed ones go."""
    src, path, schema = tmp_path / "in", str(tmp_path / "queue"), "source_url string, published_s long"
    src.mkdir()
    known = spark.createDataFrame([("k",)], "source_url string")

    def run(name, *urls):
        (src / f"{name}.json").write_text("\n".join(json.dumps({"source_url": u, "published_s": 1}) for u in urls))
        streams.stage(streams.events(spark, str(src), schema), known, path, schema, str(tmp_path / "c")).awaitTermination()
        return sorted(r.source_url for r in streams.queue_of(spark, path, schema).collect())

    assert streams.queue_of(spark, path, schema).count() == 0
    assert run("a", "k", "x", "x", "y") == ["x", "y"]
    streams.next_queue(streams.queue_of(spark, path, schema).where("source_url <> 'x'"), path)
    assert run("b", "y", "z") == ["y", "z"]


def test_transitions_keep_state(spark, tmp_path):
    """Statuses live over micro-batches; the outcomes are those of the batch operator over all requests."""
    from lodestar.operators import ingest

    src, schema = tmp_path / "in", "request_id long, tech_id long, wanted string, at_s long"
    src.mkdir()
    rows = [(i, i * 7 % 5, ["Keep", "Archived", "Keep"][i * i % 3], 100 * (i // 4)) for i in range(40)]
    before = [(None, 1, "Tracking", 0), (None, 2, "Keep", 0)]
    for name, some in (("a", before), ("b", rows[:18]), ("c", rows[18:])):
        (src / f"{name}.json").write_text("\n".join(json.dumps(dict(zip(("request_id", "tech_id", "wanted", "at_s"), r))) for r in some))
        out = streams.transitions(streams.events(spark, str(src), schema)).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c"))
        out.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select("request_id", "tech_id", "wanted", "old_status", "outcome", "writes_history").collect()))
    requests = spark.createDataFrame(rows, "request_id long, tech_id long, wanted string, at_s long")
    assets = spark.createDataFrame([(i, w) for _, i, w, _ in before], "tech_id long, status string")
    assert len(got) == 40 and {r[4] for r in got} == {"CREATED", "NOOP", "TRANSITIONED"}
    for block in (1, 150, 10**9):
        assert got == sorted(map(tuple, ingest.outcomes_in_turn(requests, assets, block).collect()))
