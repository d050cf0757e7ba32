"""Readers, writers and streaming jobs."""

import json
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import TimerValues

from riskweave.operators import labeling as B
from riskweave.plans.message_view import messages
from riskweave.sources import files, sinks
from riskweave.streaming import batch_states, jobs


def _write(path, lines):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write("\n".join(lines) + "\n")


def _message(i, **more):
    return json.dumps({"msg_id": i, "channel": "email", "user": {"role": "HR"}, "recipients": ["a@gmail.com"], "subject": "s", "body": f"body {i} ana@x.org", "attachments": [], "links": [], **more})


def test_read_messages_and_split_dir(spark, tmp_path):
    _write(f"{tmp_path}/d/train_examples_augmented.jsonl", [_message(1), "{broken", "", "[1]", _message(2)])
    _write(f"{tmp_path}/d/val_examples_augmented.jsonl", [_message(3)])
    _write(f"{tmp_path}/d/other.txt", ["x"])
    assert files.read_messages(spark, f"{tmp_path}/d/train_examples_augmented.jsonl").count() == 2
    report = files.read_report(files.read_messages(spark, f"{tmp_path}/d/train_examples_augmented.jsonl", keep_bad=True)).first()
    assert (report["read"], report["skipped"]) == (2, 2)
    splits = {(r["split"], r["msg_id"]) for r in files.read_split_dir(spark, f"{tmp_path}/d").select("split", "msg_id").collect()}
    assert splits == {("train", 1), ("train", 2), ("val", 3)}


def _result(i, content):
    return json.dumps({"custom_id": f"request-{i}", "response": {"body": {"choices": [{"message": {"content": content}}]}}})


def test_read_batch_results_with_line_numbers(spark, tmp_path):
    _write(f"{tmp_path}/r/a_val.jsonl", [_result(0, '{"body": "zero"}'), "oops", "", _result(1, ' {"body": "one"}'), _result(5, "no JSON"), _result(6, "[1]")])
    _write(f"{tmp_path}/r/b.jsonl", [_result(2, '{"body": "two"}')])
    rows = files.read_batch_results(spark, f"{tmp_path}/r").select("*", F.try_variant_get("example", "$.body", "string").alias("body")).collect()
    assert {(r["batch_file"], r["split"], r["line_number"], r["body"]) for r in rows} == {("a_val.jsonl", "val", 1, "zero"), ("a_val.jsonl", "val", 4, "one"), ("b.jsonl", "b.jsonl", 1, "two")}
    assert {r["split"] for r in files.read_batch_results(spark, f"{tmp_path}/r", "train").collect()} == {"train"}
    alt = [json.dumps({"custom_id": "x", "result": {"type": t, "message": {"content": [{"type": "text", "text": "hi"}]}}}) for t in ("succeeded", "errored")]
    _write(f"{tmp_path}/s/a.jsonl", alt)
    assert [r["content"] for r in files.read_batch_results_alt(spark, f"{tmp_path}/s").collect()] == ["hi"]


def test_line_numbers_over_many_blocks(spark, tmp_path, monkeypatch):
    lines = ["" if i % 11 == 0 else _result(i, json.dumps({"n": i, "pad": "x" * (i * 37 % 500)})) for i in range(3000)]
    _write(f"{tmp_path}/r/train.jsonl", lines)
    _write(f"{tmp_path}/r/sub.jsonl", lines[:5])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40k")
    try:
        for most in (1_000_000, 0):
            monkeypatch.setattr(files, "MOST_BLOCKS", most)
            numbered = files.numbered_lines(files.read_lines(spark, f"{tmp_path}/r"))
            rows = files.read_batch_results(spark, f"{tmp_path}/r").select("batch_file", "line_number", F.try_variant_get("example", "$.n", "int").alias("n")).collect()
            assert numbered.rdd.getNumPartitions() > 10 or not most
            assert {(r["batch_file"], r["line_number"] - 1) for r in rows if r["line_number"] - 1 == r["n"]} == {
                (f, i) for f, n in (("train.jsonl", 3000), ("sub.jsonl", 5)) for i in range(n) if i % 11
            }
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_sessions_logs_and_puzzles(spark, tmp_path):
    for i in (1, 2):
        _write(f"{tmp_path}/runs/run_{i}/session.json", [json.dumps({"session_id": f"s{i}", "start_time": float(i), "status": "active"})])
    _write(f"{tmp_path}/runs/run_3/session.json", ["{"])
    assert [r["session_id"] for r in files.read_sessions(spark, f"{tmp_path}/runs").collect()] == ["s2", "s1"]
    _write(f"{tmp_path}/log/a.json", [json.dumps({"active_batches": {"b1": {"status": "created", "request_count": 3}}, "completed_batches": {"b2": {"status": "completed"}}})])
    assert {(r["batch_id"], r["status"]) for r in files.read_batch_log(spark, f"{tmp_path}/log").collect()} == {("b1", "created"), ("b2", "completed")}
    _write(f"{tmp_path}/puz/evaluation/q1.json", [json.dumps({"train": [{"input": [[1]], "output": [[2]]}], "test": [{"input": [[3]], "output": [[4]]}]})])
    p = files.read_puzzle_json(spark, f"{tmp_path}/puz").first()
    assert (p["puzzle_id"], p["subset"], [e["kind"] for e in p["examples"]]) == ("q1", "evaluation", ["train", "test"])
    board = "." * 80 + "7"
    _write(f"{tmp_path}/b.csv", ["source,q,a,rating", f"x,{board},{'1' * 81},5", f"x,{board},{'1' * 81},1"])
    rows = files.read_puzzle_csv(spark, f"{tmp_path}/b.csv", min_difficulty=2).collect()
    assert len(rows) == 1 and rows[0]["q"][79:] == [0, 7] and len(rows[0]["a"]) == 81


def test_writers_round_trip(spark, sf_dir, tmp_path):
    m = messages(spark, sf_dir).withColumn("batch_id", F.lit("b")).withColumn("_hidden", F.lit(1))
    sinks.write_split_files(m, f"{tmp_path}/out")
    back = spark.read.json(f"{tmp_path}/out/examples")
    assert back.count() == m.count() and "_hidden" not in back.columns
    assert {r["split"] for r in spark.read.json(f"{tmp_path}/out/metadata").collect()} == {"train", "val", "test"}
    sinks.write_jsonl(m, f"{tmp_path}/jsonl")
    again = files.read_messages(spark, f"{tmp_path}/jsonl")
    assert again.count() == m.count()
    assert again.join(m.select(F.md5("body").alias("h")), F.md5(again["body"]) == F.col("h"), "left_anti").count() == 0
    sinks.write_dsl_corpus(m, f"{tmp_path}/dsl")
    assert spark.read.text(f"{tmp_path}/dsl").count() >= m.count()
    grid = spark.createDataFrame(
        [("train", x, g, f"p{p}", p, e, [p, e], [e]) for x in ("a", "b") for g in range(3) for p in range(g * 4 + 1, g * 4 + 1 + g) for e in range(p % 3 + 1)],
        "split string, set string, group_id int, puzzle_id string, identifier int, example_no int, inputs array<int>, labels array<int>",
    )
    sinks.write_grid_dataset(grid.repartition(5), f"{tmp_path}/grid")
    flat = sorted(((r["group_id"], r["puzzle_id"], r["example_no"], r["inputs"]) for r in spark.read.parquet(f"{tmp_path}/grid/examples").filter("set = 'b'").collect()))
    puzzles = sorted(spark.read.parquet(f"{tmp_path}/grid/puzzles").filter("set = 'b'").collect(), key=lambda r: r["puzzle_no"])
    assert [r["puzzle_no"] for r in puzzles] == list(range(3)) and puzzles[-1]["example_end"] == len(flat)
    for r in puzzles:
        assert {x[1] for x in flat[r["example_start"] : r["example_end"]]} == {r["puzzle_id"]}
    groups = sorted(spark.read.parquet(f"{tmp_path}/grid/groups").filter("set = 'b'").collect(), key=lambda r: r["group_no"])
    assert [(r["group_id"], r["puzzle_start"], r["puzzle_end"]) for r in groups] == [(1, 0, 1), (2, 1, 3)]
    meta = spark.read.json(f"{tmp_path}/grid/metadata").first()
    assert (meta["total_groups"], meta["total_puzzles"], meta["total_examples"], meta["sets"]) == (4, 6, 2 * len(flat), ["a", "b"])
    assert {r["puzzle_id"] for r in spark.read.parquet(f"{tmp_path}/grid/identifiers").filter("identifier = 0").collect()} == {"<blank>"}


def test_stream_label_equals_batch_and_resumes(spark, sf_dir, tmp_path):
    m = messages(spark, sf_dir)
    source = f"{tmp_path}/in"
    full = m.select(F.to_json(F.struct("msg_id", "channel", "user", "recipients", "thread", "subject", "body", "attachments", "links")).alias("value"), "msg_id")
    full.filter("msg_id < 100").select("value").write.text(f"{source}/a")
    run = lambda: jobs.stream_label(jobs.stream_messages(spark, f"{source}/*"), f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination(120)
    run()
    first = spark.read.parquet(f"{tmp_path}/out").count()
    full.filter("msg_id >= 100").select("value").write.text(f"{source}/b")
    _write(f"{source}/c/bad.json", ["{broken"])
    run()
    run()  # nothing new: nothing is labelled twice
    streamed = spark.read.parquet(f"{tmp_path}/out")
    batch = B.label_spans(m).select("msg_id", F.to_json("labels").alias("a"))
    assert first == 100 and streamed.count() == m.count()
    assert streamed.select("msg_id", F.to_json("labels").alias("b")).join(batch, "msg_id").filter("a <> b").count() == 0


def _stream(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(folder)


def _drain(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()


def test_stream_dedup_and_throughput(spark, tmp_path):
    _write(f"{tmp_path}/e/1.json", ['{"custom_id":"a","ts":"2024-01-01T00:00:00Z","status":"in_progress"}', '{"custom_id":"b","ts":"2024-01-01T00:10:00Z","status":"completed"}'])
    _write(f"{tmp_path}/e/2.json", ['{"custom_id":"a","ts":"2024-01-01T00:20:00Z","status":"completed"}', '{"custom_id":"c","ts":"2024-01-01T03:20:00Z","status":"completed"}'])
    s = "custom_id string, ts timestamp, status string"
    _drain(jobs.stream_dedup_results(_stream(spark, f"{tmp_path}/e", s)), "once")
    assert sorted(r["custom_id"] for r in spark.sql("select * from once").collect()) == ["a", "b", "c"]
    _drain(jobs.stream_throughput(_stream(spark, f"{tmp_path}/e", s)), "hours", "update")
    assert max(r["n"] for r in spark.sql("select * from hours").collect()) == 3


def _pieces(folder, pieces):
    """One file per micro-batch, oldest first."""
    for i, lines in enumerate(pieces):
        _write(f"{folder}/{i}.json", lines)
        os.utime(f"{folder}/{i}.json", (1_700_000_000 + i, 1_700_000_000 + i))


LOG = "batch_id string, status string, ts timestamp"


def _states(spark, folder, *more, **options):
    """Runs the stream over one file after another, with a restart before each of ``more``; the current states."""
    run = lambda: jobs.run_available(batch_states.stream_batch_state(_stream(spark, f"{folder}/in", LOG), **options), f"{folder}/out", f"{folder}/ck")
    run()
    for i, lines in enumerate(more):
        _write(f"{folder}/in/more{i}.json", lines)
        run()
    changes = spark.read.parquet(f"{folder}/out")
    return changes, {r["batch_id"]: (r["status"], r["at_ms"]) for r in batch_states.current_states(changes).collect()}


def _line(b, s, day, clock):
    return json.dumps({"batch_id": b, "status": s, "ts": f"2024-01-0{day}T{clock}:00Z"})


T0 = 1_704_067_200_000  # 2024-01-01


def test_stream_batch_state(spark, tmp_path):
    _pieces(f"{tmp_path}/in", [
        [_line("x", "created", 1, "00:00"), _line("y", "created", 1, "00:00"), _line("w", "created", 1, "00:30")],
        [_line("x", "completed", 1, "01:00"), _line("y", "in_progress", 1, "00:30"), _line("w", "failed", 1, "03:00"), _line("w", "completed", 1, "03:00")],
        [_line("x", "in_progress", 1, "01:30"), _line("y", "completed", 2, "00:01"), _line("z", "created", 3, "00:00")],
        [_line("z", "in_progress", 3, "00:10"), _line("v", "created", 3, "00:20"), _line("x", "failed", 1, "00:05")],
    ])
    changes, states = _states(spark, tmp_path, [_line("clock", "created", 3, "03:00")], [_line("clock", "in_progress", 3, "03:30")])
    hour = 3600 * 1000
    assert states["x"] == ("completed", T0 + hour)  # final: what comes later, or too late, changes nothing
    assert states["w"] == ("completed", T0 + 3 * hour)  # two finals at one time: by name
    assert states["y"] == ("expired", T0 + 24 * hour)  # its end came after a day
    assert states["z"] == ("stuck", T0 + 49 * hour)
    assert states["v"] == ("stuck", T0 + 49 * hour + 20 * 60 * 1000)
    assert "clock" not in states  # its windows haven't closed
    assert changes.filter("batch_id = 'x' and status = 'completed'").count() == 1


def test_batch_state_does_not_depend_on_micro_batches(spark, tmp_path):
    lines = [_line(f"b{i % 7}", ["created", "in_progress", "validating", "completed", "failed"][(i * i + i // 7) % 5 if i > 20 else i % 3], 1 + i // 40, f"{i * 7 % 24:02d}:{i % 60:02d}") for i in range(160)]
    lines.sort(key=lambda x: json.loads(x)["ts"])
    _pieces(f"{tmp_path}/a/in", [lines])
    _pieces(f"{tmp_path}/b/in", [lines[i : i + 40] for i in range(0, 160, 40)])
    assert _states(spark, f"{tmp_path}/a")[1] == _states(spark, f"{tmp_path}/b")[1]


def test_one_batch_with_most_records_is_reduced_first(spark):
    log = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("batch_id"),
        F.element_at(F.array(F.lit("created"), F.lit("in_progress")), (F.col("id") % 2 + 1).cast("int")).alias("status"),
        F.timestamp_seconds(F.col("id") / 100).alias("ts"),
    )
    reduced = batch_states.status_windows(log).filter("batch_id = 'hot'").collect()
    assert len(reduced) == 2 and sum(r["n"] for r in reduced) == 10_000  # one window, two statuses


def test_forgotten_batches_begin_anew(spark, tmp_path):
    _pieces(f"{tmp_path}/in", [
        [_line("x", "completed", 1, "00:00")], [_line("c", "created", 4, "00:00")], [_line("c", "created", 4, "04:00")],
        [_line("x", "created", 5, "00:00")], [_line("c", "created", 5, "02:00")], [_line("c", "created", 5, "02:30")],
    ])
    changes, _ = _states(spark, tmp_path, keep_ms=2 * batch_states.DAY_MS)
    assert {r["status"] for r in changes.filter("batch_id = 'x'").collect()} == {"completed", "created", "stuck"}


class _Handle:
    """Stands for the state of one key and notes every call, each a round trip on a cluster."""

    def __init__(self):
        self.calls, self.value = [], None

    def getValueState(self, name, schema):
        assert not isinstance(schema, str)  # text is parsed again, by a call, with every update
        return self

    def __getattr__(self, name):
        def call(*args):
            self.calls.append((name, *args))
            self.value = args[0] if name == "update" else None if name == "clear" else self.value
            return self.value if name == "get" else None

        return call


@pytest.mark.parametrize(("status", "now_h", "says", "n_calls"), [
    ("completed", 2, ["completed"], 3), ("created", 1, ["created"], 4), ("created", 2, ["created", "stuck"], 3), ("created", 30, ["created", "stuck", "expired"], 3),
])
def test_a_batch_makes_few_calls_of_its_state(status, now_h, says, n_calls):
    handle, states = _Handle(), batch_states.BatchStates()
    states.init(handle)
    rows = iter([{"status": status, "first_ms": T0, "last_ms": T0 + 1}])
    changes = states.handleInputRows(("b",), rows, TimerValues(0, T0 + now_h * batch_states.HOUR_MS))
    assert [c["status"] for c in changes] == says and len(handle.calls) == n_calls, handle.calls
