from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from folioscope.operators import embeddings, images, service
from folioscope.sources import files
from folioscope.streaming import events as E


def test_jsonl(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"a": 1, "b": "x"}\n\nnot json\n{"a": 2}\n')
    assert files.read_jsonl(spark, str(p), "a int, b string").where("a IS NOT NULL").count() == 2
    with pytest.raises(Exception):
        files.read_jsonl(spark, str(p), "a int, b string", strict=True).collect()
    assert tuple(files.validate_jsonl(spark, str(p), ["a", "b"]).first()) == (3, 1, 1)
    df = spark.createDataFrame([(1, None), (2, "y")], "a int, b string")
    files.write_jsonl(df, str(tmp_path / "out"))
    assert sorted(map(tuple, files.read_jsonl(spark, str(tmp_path / "out"), "a int, b string").collect())) == [(1, None), (2, "y")]


def test_csv_ddl_flatten_manifest(spark, tmp_path):
    df = spark.createDataFrame([(1, ("x", (2.5,)))], "a int, s struct<b:string,t:struct<c:double>>")
    flat = files.flatten(df)
    assert flat.columns == ["a", "s_b", "s_t_c"]
    assert '"s_t_c" DOUBLE PRECISION' in files.create_table(flat, "cells")
    files.write_csv(flat, str(tmp_path / "csv"))
    assert files.read_csv(spark, str(tmp_path / "csv"), "a int, s_b string, s_t_c double").first().s_t_c == 2.5
    (tmp_path / "docs" / "skip").mkdir(parents=True)
    (tmp_path / "docs" / "b.pgm").write_bytes(b"x")
    (tmp_path / "docs" / "A.pgm").write_bytes(b"xy")
    (tmp_path / "docs" / "skip" / "c.pgm").write_bytes(b"x")
    got = files.list_files(spark, str(tmp_path / "docs"), ["pgm"], ["skip"])
    assert [r.path.rsplit("/", 1)[1] for r in got.collect()] == ["A.pgm", "b.pgm"]
    m = files.manifest(spark, str(tmp_path / "docs"))
    assert m.count() == 3 and m.where("length(sha256) = 64").count() == 3
    assert json.loads(files.provenance(m, "export", "me").first().json)["wasGeneratedBy"]["id"] == "activity:export"
    seen = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(str(tmp_path / "docs")).select("path", "length", "modificationTime")
    recorded = spark.createDataFrame(seen.collect(), seen.schema)
    assert not files.stale(spark, str(tmp_path / "docs"), recorded)
    (tmp_path / "docs" / "b.pgm").write_bytes(b"longer")
    assert files.stale(spark, str(tmp_path / "docs"), recorded)


def test_aliases(spark):
    df = spark.createDataFrame([(None, "x"), ("t", None)], "text string, label string")
    assert sorted(r.text for r in files.with_aliases(df, {"text": ["expected", "text", "label"], "none": ["nowhere"]}).collect()) == ["t", "x"]


@pytest.fixture()
def stream_folder(spark, sf, tmp_path):
    folder = str(tmp_path / "in")
    spark.read.parquet(f"{sf}/events.parquet").repartition(4).write.parquet(folder)
    return folder


def test_metrics_stream_equals_batch(spark, sf, stream_folder):
    q = E.windowed_metrics(E.event_stream(spark, stream_folder)).writeStream.format("memory").queryName("metrics").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    batch = spark.read.parquet(f"{sf}/events.parquet").groupBy(F.date_trunc("hour", "ts").alias("h"), "event_type").count()
    assert spark.table("metrics").count() == batch.count()
    assert spark.table("metrics").agg(F.sum("n")).first()[0] == batch.agg(F.sum("count")).first()[0]


def test_upsert_and_append(spark, sf, stream_folder, tmp_path):
    target = str(tmp_path / "state")
    q = E.upsert_into(E.event_stream(spark, stream_folder, 2), target, str(tmp_path / "cp"))
    q.awaitTermination()
    last = max(int(p.name.split("=")[1]) for p in (tmp_path / "state").iterdir())
    got = spark.read.parquet(f"{target}/version={last}")
    want = service.newest(spark.read.parquet(f"{sf}/events.parquet").select("user_id", "ts", "event_id", "event_type"), "user_id", "ts", "event_id")
    assert {(r.user_id, r.event_id) for r in got.collect()} == {(r.user_id, r.event_id) for r in want.collect()}
    q = E.append_to(E.event_stream(spark, stream_folder), str(tmp_path / "log"), str(tmp_path / "cp2"))
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "log")).count() == spark.read.parquet(f"{sf}/events.parquet").count()


def test_limited_stream_equals_batch(spark, sf, tmp_path):
    folder = str(tmp_path / "one")
    spark.read.parquet(f"{sf}/events.parquet").coalesce(1).write.parquet(folder)
    q = E.limited(E.event_stream(spark, folder), 3600, 1).writeStream.format("memory").queryName("limited").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    want = service.sliding_limit(spark.read.parquet(f"{sf}/events.parquet"), "user_id", "ts", 3600, 1)
    assert {(r.event_id, r.allowed) for r in spark.table("limited").collect()} == {(r.event_id, r.allowed) for r in want.collect()}


def test_embeddings(spark):
    df = spark.createDataFrame([("a b",), (None,)], "text string")
    got = embeddings.encode(df, "text", embeddings.hashed_bag, batch=1).collect()
    assert len(got[0].vector) == 64 and abs(sum(x * x for x in got[0].vector) - 1) < 1e-9 and sum(got[1].vector) == 0
    with pytest.raises(Exception):
        embeddings.encode(df, "text", lambda texts: []).collect()
    v = spark.createDataFrame([([1.0, 0.0], [3.0, 4.0, 5.0], [0, 0, 50, 100])], "a array<double>, b array<double>, box array<int>")
    r = v.select(
        embeddings.late_fusion([F.col("a"), F.col("b")], [2.0, 1.0]).alias("f"), embeddings.concat_project([F.col("a"), F.col("b")], [[1, 0, 0, 0, 1], [0, 0, 1, 0, 0]]).alias("p"),
        embeddings.layout_features(F.col("box"), F.lit(100.0), F.lit(100.0), F.lit(1), F.lit(3)).alias("l"),
    ).first()
    assert [round(x, 6) for x in r.f] == [round(5 / 3, 6), round(4 / 3, 6), round(5 / 3, 6)] and r.p == [6.0, 3.0] and r.l == [0, 0, 0.5, 1, 0.5]


def test_images(spark):
    import numpy as np

    page = np.full((60, 80), 250, np.uint8)
    page[10:20, 10:30] = 5
    page[10:20, 40:60] = 5
    page[40:50, 10:60] = 5
    data = b"P5\n# page\n80 60\n255\n" + page.tobytes()
    rows = images.profile(spark.createDataFrame([("a", bytearray(data)), ("b", bytearray(b"broken")), ("c", None)], "path string, content binary")).collect()
    a = next(r for r in rows if r.key == "a")
    assert (a.n_components, a.n_bands) == (3, 2) and 5 <= a.threshold < 250 and len(a.small) == 256
    assert all(r.phash64 is None for r in rows if r.key != "a")
    mask = page < 100
    assert images.components(images.dilate(mask, 1, 15))[0][4] > 400 and len(images.components(images.dilate(mask, 1, 15))) == 2
    noisy = page.astype(float) + np.random.default_rng(1).normal(0, 3, page.shape)
    assert bin((images.perceptual_hash(page.astype(float)) ^ images.perceptual_hash(noisy)) & (2**64 - 1)).count("1") <= 8
