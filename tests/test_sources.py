"""Sources, sinks, manifests, validators, streams and the place for a model, on small files."""

import gzip
import hashlib
import json
import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from ordinex.operators import inference, manifests, validators
from ordinex.operators import resampling as R
from ordinex.sources import files
from ordinex.streaming import upsert


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # models of this file go to the workers as they are


def write(path, text):
    path.write_text(text)
    return str(path)


PAIR = '{"id": %s, "clean_candidates": [], "perturbed_candidates": [{"box": [0, 0, 1, 1], "score": 0.5}]}'


def test_json_lines(spark, tmp_path):
    df = files.read_pairs(spark, write(tmp_path / "a.jsonl", PAIR % '"x"' + "\n\n  \n" + PAIR % "7" + "\n"))
    assert sorted(r["id"] for r in df.collect()) == ["7", "x"] and df.first()["perturbed_candidates"][0]["label"] is None
    for bad in ("5", "[1]", "null", '{"id": ', '"text"'):
        with pytest.raises(Exception, match="line 3 of .*is not a JSON object"):
            files.read_pairs(spark, write(tmp_path / "bad.jsonl", PAIR % 1 + "\n\n" + bad + "\n")).collect()


def test_json_documents(spark, tmp_path):
    assert files.read_pairs(spark, write(tmp_path / "one.json", " " + PAIR % 1 + "\n")).count() == 1
    assert files.read_pairs(spark, write(tmp_path / "list.json", "[" + PAIR % 1 + ",\n" + PAIR % 2 + "]")).count() == 2
    assert files.read_pairs(spark, write(tmp_path / "none.json", "[]")).count() == 0
    for bad, message in (("5", "neither an object nor a list"), ('"x"', "neither"), ("[" + PAIR % 1 + ", 5]", "item 1 of")):
        with pytest.raises(Exception, match=message):
            files.read_pairs(spark, write(tmp_path / "bad.json", bad)).collect()


def record(ref, eligible=1, probes=(), **more):
    return {"model": "m", "image_id": 1, "ref_id": ref, "clean_eligible": eligible, "clean_correct": 1, "tracked_clean_candidates": [{"box": [0, 0, 1, 1], "score": 1, "label": ""}] * 2, "probes": list(probes), **more}


def probe(split="reference", coverage=1, stable=1, **more):
    return {"split": split, "spec": {"family": "blur", "severity": 1.0, "seed": 3}, "outcome": {"coverage": coverage, "rank_stable": stable if coverage else None, "operational_stable": stable, "primary_failure": "stable", "mapping": [0, 1], "matched_scores": [0.5, None], "missing_clean_indices": [], **more}, "candidates": []}


def traced(tmp_path, *records, name="t.jsonl.gz"):
    p = tmp_path / name
    with gzip.open(p, "wt") as f:
        f.write("".join(json.dumps(r) + "\n" for r in records))
    return str(p)


def test_traces(spark, tmp_path):
    path = traced(tmp_path, record(1, reason="old"), record(2), record(1, reason="new"))
    assert {(r["ref_id"], r["reason"]) for r in files.read_trace(spark, path).collect()} == {(1, "new"), (2, None)}
    assert files.read_trace(spark, path, "keep").count() == 3
    with pytest.raises(Exception, match="not unique"):
        files.read_trace(spark, path, "error").collect()
    p = files.probes(files.read_trace(spark, traced(tmp_path, record(1, probes=[probe(), probe("diagnostic")])))).collect()
    assert [(r["ord"], r["split"], r["spec"]["family"]) for r in p] == [(0, "reference", "blur"), (1, "diagnostic", "blur")]


def test_compact_traces_are_whole(spark, tmp_path):
    counts = {"reference": 2, "diagnostic": 1}
    whole = record(1, probes=[probe(), probe(), probe("diagnostic")])
    rows = files.compact(files.read_trace(spark, traced(tmp_path, whole, record(2, 0)), "keep"), counts).collect()
    assert sorted((r["ref_id"], r["eligible"], r["split"]) for r in rows if r["split"]) == [(1, 1, "diagnostic"), (1, 1, "reference"), (1, 1, "reference")]
    assert [r["ord"] for r in rows if r["ref_id"] == 2] == [None]
    for bad, message in ((record(1, probes=[probe()]), "as many probes"), (record(1, probes=[probe(), probe(coverage=0), probe("diagnostic")]), "without coverage")):
        with pytest.raises(Exception, match=message):
            files.compact(files.read_trace(spark, traced(tmp_path, bad), "keep"), counts).collect()
    with pytest.raises(Exception, match="not unique"):
        files.compact(files.read_trace(spark, traced(tmp_path, whole, whole), "keep"), counts).collect()


def test_tables_splits_and_manifests(spark, tmp_path):
    p = write(tmp_path / "t.csv", "a,b\n1,x\n2,\n")
    assert [tuple(r) for r in files.read_table(spark, p, "a int, b string").collect()] == [(1, "x"), (2, None)]
    with pytest.raises(Exception):
        files.read_table(spark, write(tmp_path / "u.csv", "a,b\nno,x\n"), "a int, b string").collect()
    m = files.read_manifest(spark, write(tmp_path / "m.json", '[{"image_id": 1, "ref_id": 2, "query": "q", "target_box": [0, 0, 2, 3]}]'))
    assert m.first()["target_box"] == [0, 0, 2, 3]
    spark.createDataFrame([(1, "test"), (2, "test")], "i int, split string").write.parquet(str(tmp_path / "s"))
    assert files.read_split(spark, str(tmp_path / "s"), "test").count() == 2
    with pytest.raises(Exception, match="unexpected split"):
        files.read_split(spark, str(tmp_path / "s"), "train").collect()


def test_images_and_hashes(spark, tmp_path):
    for name in ("x/a.jpg", "y/b.jpg", "y/c.png"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(name.encode())
    assert {r["name"] for r in files.index_images(spark, str(tmp_path)).collect()} == {"a.jpg", "b.jpg"}
    assert {(r["name"], bytes(r["content"])) for r in files.read_images(spark, str(tmp_path), "*.png").collect()} == {("c.png", b"y/c.png")}
    assert {r["sha256"] for r in files.hashes(spark, str(tmp_path / "y")).collect()} == {hashlib.sha256(x).hexdigest() for x in (b"y/b.jpg", b"y/c.png")}
    (tmp_path / "y/a.jpg").write_bytes(b"again")
    with pytest.raises(Exception, match="occurs twice"):
        files.index_images(spark, str(tmp_path)).collect()


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("b", 1.5, None), ("a", 2.0, 3)], "k string, v double, n int")
    files.write_table(df, str(tmp_path / "t"), ["k"])
    files.write_table(df, str(tmp_path / "t"), ["k"])
    (part,) = (tmp_path / "t").glob("part-*")
    assert part.read_text() == "k,v,n\na,2.0,3\nb,1.5,\n"
    files.write_json(df, str(tmp_path / "j"))
    assert sorted(x for f in (tmp_path / "j").glob("part-*") for x in f.read_text().splitlines()) == ['{"k":"a","v":2.0,"n":3}', '{"k":"b","v":1.5,"n":null}']
    assert files.markdown(df.orderBy("k"), 2) == "| k | v | n |\n| --- | --- | --- |\n| a | 2.00 | 3 |\n| b | 1.50 |  |"
    files.write_matrix(spark.createDataFrame([(r, c, r * c / 2) for r in range(3) for c in range(2)], "ref_id int, setting_index int, v double"), str(tmp_path / "m"), ["ref_id"], "setting_index", "v")
    assert (tmp_path / "m/setting_index=1").exists() and spark.read.parquet(str(tmp_path / "m")).filter("setting_index = 1").agg(F.sum("v")).first()[0] == 1.5
    audit = files.write_audit(df.agg(F.count("*").alias("rows")), str(tmp_path / "deep/audit.json"), status="passed")
    assert json.loads((tmp_path / "deep/audit.json").read_text()) == audit == {"rows": 2, "status": "passed"}
    for bad in (df, df.limit(0)):
        with pytest.raises(ValueError):
            files.write_audit(bad, str(tmp_path / "x.json"))


def test_runs_append_traces_before_summaries(spark, tmp_path):
    keys = spark.createDataFrame([(1,), (2,), (3,), (4,)], "ref_id int")
    for k in (1, 2):
        own = keys.filter(f"ref_id = {k}")
        files.append_run(own, own, str(tmp_path))
    trace = spark.read.parquet(str(tmp_path / "trace"))
    assert trace.count() == spark.read.parquet(str(tmp_path / "summary")).count() == 2
    r = files.progress(keys, trace, ["ref_id"], 30.0).first()
    assert (r["total"], r["done"], r["fraction"], r["seconds_left"]) == (4, 2, 0.5, 30.0)
    assert files.progress(keys, trace.limit(0), ["ref_id"], 1.0).first()["seconds_left"] is None


# Manifests


def test_queries_and_names(spark):
    rows = [(" a red  car.. ", "x_000123.jpg"), ("", "none.jpg"), (None, "7.png"), ("one", "a/12.b.jpg")]
    df = spark.createDataFrame(rows, "q string, f string").select(manifests.normalized_query(F.col("q")).alias("q"), manifests.word_count(F.col("q")).alias("n"), manifests.id_in_name(F.col("f")).alias("i"))
    assert [tuple(r) for r in df.collect()] == [("a red  car", 3, 123), ("", 0, None), (None, 0, 7), ("one", 1, None)]
    named = spark.createDataFrame([("a",)], "m string").select(manifests.labelled(F.col("m"), {"a": "Model A"}).alias("l"))
    assert named.first()["l"] == "Model A"
    with pytest.raises(Exception, match="no label for z"):
        spark.createDataFrame([("z",)], "m string").select(manifests.labelled(F.col("m"), {"a": "A"})).collect()


def test_seeded_orders(spark):
    rows = [(i % 7, i) for i in range(60)]
    df = spark.createDataFrame(rows, "image_id long, ref_id long").repartition(5)
    u = dict(zip(range(60), R.uniform(np.arange(60), np.arange(1), 0, 3)[:, 0]))
    order = sorted(range(60), key=lambda k: (u[k], k))
    assert [r["ref_id"] for r in manifests.shuffled(df, "ref_id", 3, 25).orderBy("position").collect()] == order[:25]
    first = {}
    for k in order:
        first.setdefault(k % 7, k)
    assert {r["image_id"]: r["ref_id"] for r in manifests.one_per_image(df, 3).collect()} == first
    assert [r["ref_id"] for r in manifests.sliced(df, ["ref_id"], 10, 99, 14).collect()] == [10, 11, 12, 13]
    assert manifests.exactly(df, 60).count() == 60
    with pytest.raises(ValueError, match="60 of the requested 61"):
        manifests.exactly(df, 61)
    with pytest.raises(ValueError, match="empty"):
        manifests.sliced(df, ["ref_id"], 5, 5)


# Validators


def broken(df):
    return {r["rule"]: r["n"] for r in df.collect()}


def test_trace_rules(spark, tmp_path):
    two = {"box": [0, 0, 1, 1], "score": 1, "label": ""}
    rows = [
        record(1, probes=[probe()]),
        record(2, 0, probes=[probe()]),
        record(3, probes=[probe(mapping=[0])]),
        record(4, probes=[probe(missing_clean_indices=[0])]),
        record(5) | {"tracked_clean_candidates": [two]},
        record(6) | {"tracked_clean_candidates": [two] * 6},
        record(7, probes=[probe() | {"candidates": [two] * 9}]),
    ]
    t = files.read_trace(spark, traced(tmp_path, *rows))
    assert broken(validators.trace_rules(t, 5, 8)) == {"too_many_tracked": 1, "ineligible_with_probes": 1, "eligible_with_fewer_than_two": 1, "too_many_exposed": 1, "mapping_length": 1, "imputed_score": 1}
    good = t.filter("ref_id = 1")
    assert broken(validators.trace_rules(good, 5, 8)) == {}
    validators.require(validators.trace_rules(good, 5, 8))
    with pytest.raises(AssertionError, match="rule=imputed_score, n=1"):
        validators.require(validators.trace_rules(t, 5, 8))


def test_registry_and_summary_rules(spark):
    rows = [("m", 1, "d", f) for f in "ab"] + [("m", 2, "d", "a"), ("m", 2, "d", "a")]
    p = spark.createDataFrame(rows, "model string, ref_id int, split string, family string")
    assert {(r["ref_id"], r["rule"], r["n"]) for r in validators.registry_rules(p, {"d": 1}, ["a", "b"]).collect()} == {(2, "unbalanced_d", 2)}
    s = spark.createDataFrame([("m", 1, k, b) for k, bs in ((1, (5, 10)), (2, (5, 5, 10)), (3, (5, 7))) for b in bs], "model string, image_id int, ref_id int, diagnostic_budget int")
    assert {(r["ref_id"], r["rule"], r["n"]) for r in validators.summary_rules(s, [5, 10]).collect()} == {(2, "budget_twice", 1), (3, "budget_missing", 1), (3, "budget_unknown", 1)}
    c = spark.createDataFrame([("m", 1, 1, "d", 1, 1, 1), ("m", 1, 1, "r", 1, 0, 1), ("m", 1, 2, "d", 0, 0, 0)], "model string, image_id int, ref_id int, split string, eligible int, coverage int, stable int")
    assert {(r["rule"], r["n"]) for r in validators.compact_rules(c, {"d": 1, "r": 2}).collect()} == {("count_r", 1), ("stable_without_coverage", 1)}


def test_agreement_and_manifest_rules(spark):
    a = spark.createDataFrame([(1, 0.5), (2, 0.25), (3, None), (4, 1.0)], "k int, v double")
    b = spark.createDataFrame([(1, 0.5 + 1e-14), (2, 0.26), (3, None), (5, 1.0)], "k int, v double")
    assert broken(validators.agreement_rules(a, b, ["k"], ["v"])) == {"left_only": 1, "right_only": 1, "v_differs": 1}
    rows = [(1, 1, "q", [0.0, 0.0, 5.0, 5.0], 10, 10, "coco"), (1, 2, " ", [0.0, 0.0, 11.0, 5.0], 10, 10, "coco"), (2, 3, "q", [3.0, 0.0, 3.0, 5.0], 10, 10, "o365")]
    m = spark.createDataFrame(rows, "image_id int, ref_id int, query string, target_box array<double>, image_width int, image_height int, source_split string")
    got = broken(validators.manifest_rules(m, ["image_id", "ref_id"], {"coco": 2, "o365": 3}, m.filter("ref_id = 3")))
    assert got == {"box_outside": 2, "empty_query": 1, "repeated_image_id": 1, "count_o365": 2, "excluded_image": 1}
    assert broken(validators.manifest_rules(m.filter("ref_id = 1"), ["image_id"])) == {}


# Streams


def test_stream_keeps_the_last_record(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([(1, "a", 0), (1, "b", 1), (2, "c", 2)], "k int, v string, n int").coalesce(1).write.json(src)
    schema = "k int, v string, n int"
    upsert.start(spark.readStream.schema(schema).json(src), ["k"], "n", str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination()
    spark.createDataFrame([(2, "d", 3)], schema).write.mode("append").json(src)
    upsert.start(spark.readStream.schema(schema).json(src), ["k"], "n", str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination()
    assert {r["k"]: r["v"] for r in upsert.current(spark, str(tmp_path / "t"), ["k"], "n").collect()} == {1: "b", 2: "d"}


def test_counts_by_event_time(spark):
    df = spark.createDataFrame([("2024-01-01 10:05:00", "a"), ("2024-01-01 10:55:00", "a"), ("2024-01-01 11:00:00", "a"), ("2024-01-01 10:30:00", "b")], "ts string, event_type string").withColumn("ts", F.to_timestamp("ts"))
    got = {(str(r["start"])[11:16], r["event_type"]): r["n"] for r in upsert.windowed_counts(df).collect()}
    assert got == {("10:00", "a"): 2, ("11:00", "a"): 1, ("10:00", "b"): 1}


# The place for a model


def bright():
    """The mean of an image as the score of three boxes; made where the model runs."""

    class Bright(inference.Adapter):
        def predict(self, image, query, top_k):
            return [((0.0, 0.0, float(image.shape[1]), float(image.shape[0])), float(image.mean()), query)] * 3

        def predict_batch(self, images, query, top_k):
            assert len(images) <= 2
            return super().predict_batch(images, query, top_k)

    return Bright()


def short():
    class Short(inference.Adapter):
        def predict(self, image, query, top_k):
            return []

        def predict_batch(self, images, query, top_k):
            return [[]]

    return Short()


def decode(raw):
    return np.frombuffer(raw, np.uint8).reshape(6, 8, 3)


def test_models_run_in_batches(spark):
    image = np.random.default_rng(0).integers(0, 256, (6, 8, 3), dtype=np.uint8)
    rows = [(1, image.tobytes(), "q", None, None, None), (2, image.tobytes(), "q", "brightness", 0.5, 1), (3, image.tobytes(), "q", "gaussian_noise", 0.0, 1), (4, image.tobytes(), "other", "resolution", 1.0, 1)]
    df = spark.createDataFrame(rows, "ref_id int, image binary, query string, family string, severity double, seed int").coalesce(1)
    got = {r["ref_id"]: r["candidates"] for r in inference.infer(df, ["ref_id"], bright, decode, top_k=2, batch_size=2).collect()}
    assert all(len(x) == 2 for x in got.values()) and got[1][0]["box"] == [0, 0, 8, 6] and got[4][0]["label"] == "other"
    assert got[1][0]["score"] == got[3][0]["score"] == got[4][0]["score"] == pytest.approx(image.mean()) and got[2][0]["score"] == pytest.approx(image.mean() / 2, abs=1)
    with pytest.raises(Exception, match="answered 1 of 3"):
        inference.infer(df, ["ref_id"], short, decode, batch_size=3).collect()


def test_probes_keep_the_size():
    image = np.random.default_rng(1).integers(0, 256, (9, 7, 3), dtype=np.uint8)
    for family, severity in (("blur", 1.5), ("brightness", 1.3), ("resolution", 0.5), ("gaussian_noise", 0.04)):
        out = inference.perturbed(image, family, severity, 5)
        assert out.shape == image.shape and out.dtype == np.uint8 and (out != image).any()
        assert (out == inference.perturbed(image, family, severity, 5)).all()
    flat = np.full((5, 5, 3), 77, np.uint8)
    assert (inference.perturbed(flat, "blur", 2.0, 0) == 77).all() and (inference.perturbed(flat, "resolution", 0.5, 0) == 77).all()
    assert (inference.perturbed(image, "jpeg", 50.0, 0, codec=lambda x, q: x // 2 + q) == image // 2 + 50).all()
    for family, message in (("fog", "unknown family"), ("jpeg", "codec")):
        with pytest.raises(ValueError, match=message):
            inference.perturbed(image, family, 1.0, 0)


def test_thresholds():
    config = {"box_threshold": 0.2, "inference_thresholds": {"owlv2": {"box_threshold": 0.3}}}
    assert inference.thresholds("owlv2", config) == {"box_threshold": 0.3}
    assert inference.thresholds("groundingdino", config) == {"box_threshold": 0.2, "text_threshold": 0.05}
    assert inference.thresholds("x", {}) == {"box_threshold": 0.05}
