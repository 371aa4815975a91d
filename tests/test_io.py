import json

import pytest
from pyspark.sql import functions as F

from plumbline.sources import io
from plumbline.streaming import resume


def test_triplets_round_trip(spark, tmp_path):
    for name, split in (("triplet_001", "train"), ("triplet_001", "val"), ("triplet_001", "validation"), ("triplet_002", "val")):
        (tmp_path / name).mkdir(exist_ok=True)
        (tmp_path / name / f"{split}.json").write_text(json.dumps([{"text": f"{name} {split} {i}"} for i in range(2)]))
    rows = {(r["triplet"], r["split"], r["sample_idx"]): r["text"] for r in io.read_triplets(spark, str(tmp_path)).collect()}
    assert rows["triplet_001", "validation", 1] == "triplet_001 validation 1"
    assert rows["triplet_002", "validation", 0] == "triplet_002 val 0"
    assert len(rows) == 6
    chosen = io.select_triplets(io.read_triplets(spark, str(tmp_path)), "2")
    assert {r["triplet"] for r in chosen.collect()} == {"triplet_002"}


def test_missing_text_fails(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"text": "x"}, {"other": 1}]')
    with pytest.raises(Exception, match="no text"):
        io.read_json_array(spark, str(tmp_path / "a.json")).collect()


def test_bad_line_fails(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"source_row_id": 1, "text": "x"}\nnot json\n')
    with pytest.raises(Exception, match="(?i)malformed"):
        io.read_jsonl(spark, str(tmp_path / "a.jsonl")).collect()


def test_assignments(spark, tmp_path):
    df = spark.createDataFrame([(1, 0, "", False, 0.5, 'a "q", b\nc'), (2, -1, "noise", True, None, "t")], io.ASSIGNMENT)
    io.write_assignments(df, str(tmp_path / "csv"), str(tmp_path / "json"))
    rows = {r["text_id"]: r for r in io.read_assignments(spark, str(tmp_path / "csv")).collect()}
    assert rows[1]["domain"] == "cluster_0" and rows[1]["text"] == 'a "q", b\nc' and rows[1]["distance_to_centroid"] == 0.5
    assert rows[2]["distance_to_centroid"] is None


def test_index_is_dense_in_order(spark):
    df = spark.range(100).select((F.col("id") * 37 % 101).alias("k"))
    rows = [(r["k"], r["index"]) for r in io.add_index(df, "k").collect()]
    assert [i for _, i in sorted(rows)] == list(range(100))


def test_manifest_keeps_created(spark):
    m = io.manifest(spark, {"created": "then", "a": "1"}, a="2").first()[0]
    assert m["created"] == "then" and m["a"] == "2" and m["updated"]
    assert "created" in io.manifest(spark, {}).first()[0]


def test_stream_takes_new_files_once(spark, tmp_path):
    src, sink, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    spark.range(5).write.parquet(src)
    run = lambda: resume.process_new(spark, src, spark.range(1).schema, lambda d: d.withColumn("x", F.col("id") + 1), sink, ck, ("id",))
    run()
    spark.range(3, 8).write.mode("append").parquet(src)
    run()
    run()
    assert sorted(r["id"] for r in spark.read.parquet(sink).collect()) == list(range(8))
    assert {r["id"] for r in io.resumable(spark.range(10), spark.read.parquet(sink), "id").collect()} == {8, 9}


def test_small_sinks_and_invalidation(spark, tmp_path):
    root = str(tmp_path)
    for name in ("embed", "reduce", "cluster"):
        spark.range(1).write.parquet(f"{root}/{name}")
    assert io.invalidate(spark, root, ["embed", "reduce", "cluster", "export"], "embed") == ["reduce", "cluster"]
    assert io.exists(spark, f"{root}/embed") and not io.exists(spark, f"{root}/cluster")
    assert io.read_if_exists(spark, f"{root}/cluster", "id long").count() == 0
    io.write_object(spark.range(1).withColumns({"x": F.lit(None).cast("string"), "é": F.lit("ü中")}), f"{root}/obj")
    body = spark.read.text(f"{root}/obj", wholetext=True).first()[0]
    assert json.loads(body) == {"id": 0, "x": None, "é": "ü中"} and "\n  " in body and "ü中" in body  # indented, and no escapes
    assert tuple(io.read_object(spark, f"{root}/obj", "id long, x string, `é` string").first()) == (0, None, "ü中")
    for _ in range(2):
        io.append_log(spark.range(2), f"{root}/log")
    assert spark.read.csv(f"{root}/log", header=True).count() == 4


def test_ports(spark):
    import numpy as np

    from plumbline.operators import ports

    df = spark.createDataFrame([(i, f"m{i % 3}", "ab" * i) for i in range(9)], "id long, model string, text string")
    load = lambda m: lambda pdf: pdf[["id"]].assign(score=len(m) + pdf["text"].str.len())
    got = ports.apply_scorer(df, "model", load, "id long, score long").collect()
    assert {r["id"]: r["score"] for r in got} == {i: 2 + 2 * i for i in range(9)}
    e = ports.embed(df, "id", "text", lambda ts: np.array([[len(t), 1.0] for t in ts]))
    assert all(abs(np.linalg.norm(r["embedding"]) - 1) < 1e-6 for r in e.collect())
    t = ports.tokenize(df, "text", lambda s: [ord(c) for c in s], 3).collect()
    assert max(len(r["ids"]) for r in t) == 3


def test_old_split_names(spark, tmp_path):
    a = [{"loss": 1.0, "ppl": 2.0, "n_tokens": 3}]
    row = {"model_triplet": "m", "eval_triplet": "e", "model_dir": "d", "base": {"forget": a, "retain": a}, "unlearn": {"train": a, "test": a}}
    (tmp_path / "p.json").write_text(json.dumps(row))
    r = io.read_pairs(spark, str(tmp_path / "p.json")).first()
    assert set(r["base"]) == {"train", "validation"} and set(r["unlearn"]) == {"train", "test"}
