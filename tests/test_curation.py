import re

import pytest
from helpers import values
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from veritable.functions.naming import Rule, family_of
from veritable.operators import canonical, filters, joins, reports, sets
from veritable.plans.evaluation import benchmark_table
from veritable.plans.prompts import segment_contexts
from veritable.schemas import SAMPLES


def test_first_present_counts_empty_text(spark):
    df = spark.createDataFrame([(None, "b"), ("", "b"), (None, None)], "a string, b string")
    got = df.select(canonical.first_present(df, ["zz", "a", "b"], "d")).collect()
    assert [r[0] for r in got] == ["b", "", "d"]


def test_canonicalize(spark):
    rows = [("p.jpg", 1, None, "2024-05-06T01", None), ("q.jpg", 0, "", None, "hi")]
    df = spark.createDataFrame(rows, "image_path string, is_fake int, generator string, date string, caption string")
    got = canonical.canonicalize(df, "cfg").collect()
    assert [tuple(r) for r in got] == [
        ("p.jpg", "", "fake", "cfg", "image", "2024-05-06"), ("q.jpg", "hi", "real", "cfg", "image", ""),
    ]
    with pytest.raises(ValueError, match="no label column"):
        canonical.canonicalize(df.drop("is_fake"), "cfg")
    with pytest.raises(PySparkException, match="row without path"):
        canonical.canonicalize(spark.createDataFrame([("", 1)], "path string, label int"), "c").collect()


def test_conform(spark):
    df = spark.createDataFrame([("real", None)], "label string, model string")
    assert tuple(canonical.conform(df).first()) == ("", "", "real", "", "", "")
    assert tuple(canonical.conform(df, SAMPLES, None).first()) == (None, None, "real", None, None, None)


def test_retag(spark):
    rows = [("a/1900000.jpg", "Real", "real"), ("1900000.jpg", "fake", "g"), ("000000012.jpg", "real", "REAL"), ("x1.jpg", "real", "cam"), ("9" * 30 + ".jpg", "real", "cam")]
    df = spark.createDataFrame(rows, "file_name string, label string, model string").withColumn("type", F.lit("image"))
    got = canonical.retag_provenance(df, [canonical.StemRange(1872218, 2438962, "stock")]).collect()
    assert [(r["model"], r["type"]) for r in got] == [("stock", "real"), ("g", "image"), ("laion", "image"), ("cam", "image"), ("cam", "image")]
    only = canonical.retag_provenance(df, [canonical.StemRange(1, 99, "stock", path_like="b/%")]).collect()
    assert only[2]["model"] == "laion"


def test_keyed_adapter_handles_masks(spark):
    df = spark.createDataFrame([("A/b/c", "u/mask.tar"), ("A/b/c", "u/original"), ("A/b", "u/x"), (None, None)], "k string, u string")
    got = canonical.adapt_keyed_archive(df, "k", "u", "/r", "t").select("file_name", "label", "model").collect()
    assert [tuple(r) for r in got] == [("/r/A__b__c.png", "real", "real"), ("/r/A__b.png", "fake", "A"), ("/r/.png", "fake", "")]


def test_post_records(spark):
    rows = [("p1", "AiArt", "http://a/x.PNG", False, 0), ("p2", "pics", "http://v", True, 2), ("p3", "pics", "http://a/x.gif", False, 0), ("p4", "other", "a.jpg", False, 0)]
    posts = spark.createDataFrame(rows, "id string, channel string, url string, is_video boolean, total_frames int").withColumn(
        "created", F.lit("2024-03-01 23:59:59").cast("timestamp")
    )
    channels = spark.createDataFrame([("aiart", "fake"), ("Pics", "real")], "channel string, label string")
    got = canonical.post_records(posts, channels, frames=3)
    assert values(got, "filename", "label") == [
        ("reddit_aiart_2024-03-01_p1.PNG", "fake"),
        ("reddit_pics_2024-03-01_p2_frame_0.jpg", "real"),
        ("reddit_pics_2024-03-01_p2_frame_1.jpg", "real"),
        ("reddit_pics_2024-03-01_p2_frame_2.jpg", "real"),
    ]


def test_registry_takes_longest_valid_id(spark):
    ids = spark.createDataFrame([("a/b",), ("a/b_2024-01-01",), ("a/b_7",)], "model string")
    names = ["hf_a_b_2024-01-01_5.png", "hf_a_b_2024-01-02_5.png", "hf_a_b_7_5.png", "hf_a_b_7.png", "hf_a_bc_7.png", "hf_a_b_7.jpg", "x_a_b_7.png"]
    files = spark.createDataFrame([(n,) for n in names], "f string")
    got = {r["f"]: (r["model"], r["date"]) for r in joins.match_registry(files, ids, "f").collect()}
    assert [got[n] for n in names] == [
        ("a/b_2024-01-01", None), ("a/b", "2024-01-02"), ("a/b_7", None), ("a/b", None), (None, None), (None, None), (None, None),
    ]


def test_contexts_use_the_best_tier(spark):
    segments = spark.createDataFrame([(i, f"m{i}", "L1" if i < 5 else "zz") for i in range(1, 6)], "ImageID int, MaskPath string, LabelName string")
    classes = spark.createDataFrame([("L1", "Dog"), ("L2", "Cat")], "LabelName string, ClassName string")
    narratives = spark.createDataFrame([(1, "x" * 400, 2), (1, "first", 1), (2, "", 0)], "image_id int, caption string, ordinal int")
    triples = spark.createDataFrame([(2, "L1", "zz", "on", i) for i in range(10)], "ImageID int, LabelName1 string, LabelName2 string, RelationshipLabel string, o int")
    got = segment_contexts(segments, classes, narratives, triples, ["o"]).orderBy("ImageID").collect()
    assert [r["tier"] for r in got] == [1, 2, 3, 3, 4]
    assert got[0]["context"] == 'Image description: "first"\nObject to replace: Dog'
    assert got[1]["context"].count("Dog on Object") == 8
    assert got[4]["context"] == "Object to replace: nan"
    counts = reports.tier_counts(spark.createDataFrame(got[:3])).collect()
    assert {r["tier"]: r["rows"] for r in counts} == {1: 1, 2: 1, 3: 1, 4: 0}


def test_hot_image_list_stays_capped(spark):
    df = spark.range(3000).select((F.col("id") % 1).alias("k"), F.col("id").alias("o"), F.col("id").cast("string").alias("v"))
    got = joins.capped_list(df.repartition(6), "k", "v", ["o"], 8).first()
    assert got["items"] == [str(i) for i in range(8)]
    plan = joins.capped_list(df, "k", "v", ["o"], 8)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_eligible(spark):
    rows = [("a", 40000, None, ["x.safetensors"]), ("b", 40000, "AUDIO-x", ["x.safetensors"]), ("c", None, "", ["x.safetensors"]), ("d", 30000, "t", ["x.bin"]), ("e", 99999, "t", ["x.safetensors"]), ("f", 99999, "t", None)]
    catalog = spark.createDataFrame(rows, "model string, downloads bigint, pipeline_tag string, files array<string>")
    registry = spark.createDataFrame([("e", "COMPLETED"), ("a", "INFRASTRUCTURE_FAULT")], "model string, status string")
    assert values(filters.eligible_models(catalog, registry), "model") == [("a",)]
    reasons = {r["model"]: r["reason"] for r in filters.judge_models(catalog, registry).collect()}
    assert reasons["b"] == "Incompatible task: AUDIO-x" and reasons["d"] == reasons["f"] == "No safetensors found"


def test_moderation_keeps_what_has_no_score(spark):
    rows = [("a", [("nsfw", 0.7)]), ("b", [("nsfw", 0.69), ("safe", 0.9)]), ("c", []), ("d", None)]
    df = spark.createDataFrame(rows, "f string, scores array<struct<label:string,score:double>>")
    passed, quarantine = filters.moderate(df, "scores")
    assert values(quarantine, "f") == [("a",)] and passed.count() == 3


def test_listing_filters(spark):
    meta = spark.createDataFrame([("a",), ("a",), ("b",)], "f string")
    listing = spark.createDataFrame([("a",), ("a",), ("z",)], "f string")
    kept, missing = filters.keep_existing(meta, listing, "f")
    assert kept.count() == 2 and values(missing, "f") == [("b",)]
    assert tuple(filters.existing_counts(meta, listing, "f").first()) == (3, 2, 1)
    assert sets.difference(meta, listing, "f").count() == 1
    paths = spark.createDataFrame([("x",), ("y",), ("z",)], "m string")
    there = spark.createDataFrame([("/b/x",), ("/a/x",), ("/b/y",)], "path string")
    layouts = [F.concat(F.lit("/a/"), "m"), F.concat(F.lit("/b/"), "m")]
    assert values(joins.locate_asset(paths, there, "m", layouts), "m", "found") == [("x", "/a/x"), ("y", "/b/y"), ("z", None)]


def test_reports(spark):
    rows = [("m", 1, "tr", "", "", "fake"), ("m", 2, "tr", "2024-02-01", "lora", "fake"), ("m", 3, "te", "2024-01-01", "x", "real"), ("n", 4, "te", "", "", "")]
    df = spark.createDataFrame(rows, "model string, o int, split string, release_date string, type string, label string")
    stats = reports.source_stats(df, "o", "split", ["tr", "te"])
    assert values(stats, "model", "count", "release", "type", "label") == [("m", 3, "2024-01-01", "lora", "fake"), ("n", 1, "", "", "")]
    grouped = reports.grouped_stats(stats, family_of("model", [Rule("f", equals=("m",))]))
    assert values(grouped, "level", "family", "count", "release") == [
        ("family", "f", 3, "2024-01"), ("model", "f", 3, "2024-01"), ("total", None, 3, None),
    ]
    seen = spark.createDataFrame([("A", "2024-01-02"), ("a", "2024-01-03"), ("a", "bad"), ("b", "")], "c string, d string")
    assert [(r["channel"], str(r["last_seen"])[:10]) for r in reports.last_seen(seen, "c", "d").collect()] == [("a", "2024-01-03")]
    matched = spark.range(12000).select(F.when(F.col("id") < 8000, "a").otherwise("b").alias("model"))
    assert values(reports.infer_source_type(matched).distinct(), "model", "type") == [("a", "Base"), ("b", "Fine-tune")]


def test_benchmark_table_ignores_matched_pairs(spark):
    rows = [("d1", "t1", 10, 0.9), ("d2", "t1", 10, 0.7), ("d3", "t1", 10, 0.7), ("d1", "t2", 10, 0.1)]
    df = spark.createDataFrame(rows, "detector string, test string, n bigint, accuracy double")
    got = {(r["detector"], r["test"]): r for r in benchmark_table(df, ["t1", "t2"], [("d1", "t1")]).collect()}
    assert len(got) == 6
    assert got[("d1", "t1")]["matched"] and not got[("d1", "t1")]["best"]
    assert got[("d2", "t1")]["best"] and got[("d3", "t1")]["best"] and got[("d1", "t2")]["best"]
    assert got[("d2", "t2")]["value"] is None and not got[("d2", "t2")]["best"]
    assert got[("d2", "t1")]["best_average"] and not got[("d1", "t1")]["best_average"]


def test_label_of_the_first_alias_that_is_set(spark):
    df = spark.createDataFrame([(None, "fake", "a"), (1, "real", "b"), (0, "fake", "c"), (None, "real", "d")], "label int, class string, path string")
    got = canonical.canonicalize(df, "cfg")
    assert values(got, "file_name", "label") == [("a", "fake"), ("b", "fake"), ("c", "real"), ("d", "real")]


def test_every_image_with_a_triple_gets_its_relations(spark):
    import __spark_entry__ as entry

    folder = "/root/testdata/sf0.001"
    rows = entry.queries()["best_context_whole"](spark, folder).collect()
    # Each segment row of lineitem is a triple too, so no image is left to the lower tiers.
    assert {r["tier"] for r in rows} <= {1, 2} and any(r["tier"] == 2 and r["ImageID"] % 3 for r in rows)
    counts = {r["tier"]: r["rows"] for r in entry.queries()["tier_counts_whole"](spark, folder).collect()}
    assert counts[3] == counts[4] == 0 and sum(counts.values()) == len(rows)


def test_images_are_not_shuffled_for_their_index(spark, tmp_path):
    rows = [(i, bytes(50) if i % 2 else None, "fake", f"p{i}") for i in range(20)]
    spark.createDataFrame(rows, "i long, image binary, label string, path string").write.parquet(f"{tmp_path}/rows")
    got = canonical.canonicalize(spark.read.parquet(f"{tmp_path}/rows"), "c", image_folder="/im", order=["i"])
    want = sorted(f"/im/{i:09d}.jpg" if i % 2 else f"p{i}" for i in range(20))
    assert sorted(r["file_name"] for r in got.collect()) == want
    plan = got._jdf.queryExecution().optimizedPlan().toString().splitlines()
    window = next(i for i, line in enumerate(plan) if "Window" in line)
    # The window reads a projection of the flag, not the images.
    assert not any(re.search(r"(?<!_)\bimage#", line.replace("isnotnull(image#", "")) for line in plan[: window + 2]), "\n".join(plan)
