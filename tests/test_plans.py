import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from frameloom.plans.pipeline import Parameter, Stage, default_registry, merged_manifests, parameter_hash, sweep
from frameloom.sources import readers, writers
from frameloom.streaming import stages


def test_specification_is_checked_before_it_runs(spark):
    registry = default_registry()
    bad = {"steps": [{"id": "a", "stage": "robust_z"}, {"id": "a", "stage": "nothing"}, {"id": "b", "stage": "pixels", "params": {"x": 1}}]}
    found = registry.problems(bad)
    assert any("needs pixels" in x for x in found) and any("twice" in x for x in found) and any("no stage nothing" in x for x in found)
    with pytest.raises(ValueError, match="no stage"):
        registry.run(bad, spark.range(1))
    assert Parameter("number", 1, 0, 2).problem(True) == "is no number" and Parameter("integer", 1, 0, 2).problem(5) == "is above 2"
    with pytest.raises(ValueError, match="already"):
        registry.add(Stage("pixels", lambda d: d, 1, "any", "same"))


def test_specification_runs_as_one_plan(spark):
    frames = readers.synthetic_frames(spark, 6, 12, 12, [(5, 6, 2, 3, 9.0)])
    spec = {"steps": [{"id": "d", "stage": "components", "params": {"threshold": 5.0}}, {"id": "off", "stage": "pixels", "enabled": False}]}
    out = default_registry().run(spec, frames).collect()
    assert sorted(r.frame for r in out) == [2, 3] and all(abs(r.x - 5) < 1 and abs(r.y - 6) < 1 for r in out)


def test_sweep_and_hash():
    spec = {"id": "s", "steps": [{"id": "z", "stage": "robust_z", "params": {"floor": 1.0}}, {"id": "p", "stage": "projections"}]}
    runs = sweep(spec, {"z.floor": [1.0, 2.0], "p.active": [1.0, 3.0]})
    assert [r["id"] for r in runs] == [f"s__sweep_{k:03d}" for k in (1, 2, 3, 4)]
    assert [(r["steps"][0]["params"]["floor"], r["steps"][1]["params"]["active"]) for r in runs] == [(1.0, 1.0), (1.0, 3.0), (2.0, 1.0), (2.0, 3.0)]
    assert parameter_hash(spec) == parameter_hash(spec | {"id": "other", "label": "x"}) != parameter_hash(runs[1])
    with pytest.raises(ValueError, match="fits 0 steps"):
        sweep(spec, {"q.x": [1]})


def test_manifests_merge_in_place():
    a, b = [{"run_id": 1, "v": 1}, {"run_id": 2, "v": 1}], [{"run_id": 1, "v": 2}, {"run_id": 3, "v": 2}]
    assert [(x["run_id"], x["v"]) for x in merged_manifests(a, b, replace=True)] == [(1, 2), (2, 1), (3, 2)]
    with pytest.raises(ValueError, match="both"):
        merged_manifests(a, b)


def test_intervals_become_points(spark, tmp_path):
    (tmp_path / "gt.csv").write_text("X, Y ,Start Frame,End Frame,ID\n1.5,2,3,5,7\n1,1,9,8,2\n")
    rows = readers.ground_truth(readers.intervals(spark, str(tmp_path / "gt.csv")))
    assert sorted(tuple(r) for r in rows.collect()) == [(3, 7, 1.5, 2.0), (4, 7, 1.5, 2.0), (5, 7, 1.5, 2.0)]


def test_stacks_and_chunks(spark, tmp_path):
    stack = np.arange(13 * 2 * 3).reshape(13, 2, 3).astype(np.float32)
    np.save(tmp_path / "a.npy", stack)
    frames = readers.chunked(readers.npy_frames(spark, str(tmp_path), 5), 5)
    got = frames.orderBy("frame").collect()
    assert [r.chunk for r in got] == [0] * 5 + [1] * 5 + [2] * 3 and got[12].pixels == stack[12].ravel().tolist()
    with pytest.raises(ValueError, match="at least one"):
        readers.chunked(frames, 0)


def test_archives_checksums_documents(spark, tmp_path):
    np.savez(tmp_path / "s.npz", other=np.zeros((2, 2)), spks=np.zeros((3, 4)))
    found = {r.array: (r.shape, r.chosen) for r in readers.archive_shapes(spark, str(tmp_path)).collect()}
    assert found == {"other": ("2,2", False), "spks": ("3,4", True)}
    (tmp_path / "d.json").write_text(json.dumps({"a": 1, "b": {"c": "x"}}))
    assert readers.documents(spark, str(tmp_path / "d.json"), "a int, b struct<c string>").select("a", "b.c").first() == (1, "x")
    assert readers.checksums(spark, [str(tmp_path / "d.json")]).first().bytes == (tmp_path / "d.json").stat().st_size
    assert readers.input_paths({"video": "v", "output_dir": "o", "gt_csv": "g"}) == {"video": "v", "gt_csv": "g"}
    (tmp_path / "m.json").write_text(json.dumps({"paths": {"video": "v.npy", "far": "/x/y"}}))
    assert readers.manifest(str(tmp_path / "m.json"))["paths"] == {"video": f"{tmp_path}/v.npy", "far": "/x/y"}


def test_tsv_round_trip_and_profile(spark, tmp_path):
    regions = spark.createDataFrame([(1, ["a", "b"], "x\ty"), (2, [], None), (10, ["c"], "z")], "region_id int, tags array<string>, note string")
    events = spark.createDataFrame([(1, 4), (1, 8), (2, 5)], "region_id int, frame int")
    states = spark.createDataFrame([(1, "accepted"), (2, "rejected")], "region_id int, state string")
    event_states = spark.createDataFrame([("1:4", "accepted"), ("1:8", "rejected"), ("2:5", "accepted")], "event_key string, state string")
    out = writers.export_bundle(str(tmp_path / "out"), "accepted_only", regions, events, states, event_states)
    assert (out["regions"], out["events"]) == (1, 1)
    row = readers.candidates_tsv(spark, str(tmp_path / "out/regions")).first()
    assert (row.region_id, row.tags, row.note, row.state) == (1, "a, b", "x y", "accepted")
    assert writers.export_bundle(str(tmp_path / "all"), "all_reviewed", regions, events, states, event_states)["events"] == 3


def test_traces_latest_and_results(spark, tmp_path):
    rois = spark.createDataFrame([(1, [0.1, 0.2], [1.0])], "id int, dff array<double>, z array<double>")
    assert [tuple(r) for r in writers.trace_rows(rois, "id", ["dff", "z"], 5.0).orderBy("frame").collect()] == [(1, 1, 0.0, 0.1, 1.0), (1, 2, 0.2, 0.2, None)]
    log = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "k string, at int, v string")
    assert sorted(r.v for r in writers.latest(log, ["k"], "at").collect()) == ["y", "z"]
    results = spark.sql("SELECT 'c' config_id, named_struct('s', 4) params, array(named_struct('tpr', 1D), named_struct('tpr', 0D)) roc_points")
    assert [tuple(r) for r in writers.flat_results(results).collect()] == [("c", 4, 1.0), ("c", 4, 0.0)]
    writers.write_json(str(tmp_path / "x.json"), {"b": 1, "a": 2})
    assert (tmp_path / "x.json").read_text().index('"a"') < (tmp_path / "x.json").read_text().index('"b"')


def test_stream_scores_as_the_batch_does(spark, tmp_path):
    schema = "key string, frame int, value double"
    rows = [(k, t, float((t * 7 + len(k)) % 5) + (12 if t == 8 else 0)) for t in range(12) for k in ("a", "bb")]
    for part in range(3):
        spark.createDataFrame(rows[part * 8 : part * 8 + 8], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = stages.ewma_stream(stages.frame_stream(spark, str(tmp_path / "in"), schema, 10.0).drop("timestamp_sec"), 0.05, 3.0)
    query = stream.writeStream.format("memory").queryName("scored").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    query.stop()
    got = sorted(tuple(r) for r in spark.table("scored").collect())
    want = sorted(tuple(r) for r in stages.ewma_batch(spark.createDataFrame(rows, schema), 0.05, 3.0).collect())
    assert got == want and {r[1] for r in got if r[4]} == {8}


def test_event_time_windows(spark):
    df = spark.sql("SELECT timestamp '2024-01-01 00:00:00' + make_interval(0,0,0,0,0,id,0) ts, 'k' k FROM range(90)")
    assert [r.n for r in stages.windowed_counts(df, "ts", "k", "1 hour", "5 minutes").orderBy("start").collect()] == [60, 30]
    assert stages.windowed_counts(df, "ts", "k", "1 hour", "5 minutes", "30 minutes").agg(F.sum("n")).first()[0] == 180
    assert [r.n for r in stages.sessions(df, "ts", "k", "2 minutes", "5 minutes").collect()] == [90]
