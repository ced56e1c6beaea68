import json
import random

import duckdb
import pytest
from helpers import values
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import EqualTo, In

import __spark_entry__ as entry
from veritable import schemas
from veritable.catalog import files
from veritable.operators.reports import overall_auc
from veritable.plans.packaging import package
from veritable.sources import listing, readers, writers

PAIR = T.StructType([T.StructField("a", T.StringType()), T.StructField("b", T.StringType())])


def test_metadata_csv_with_quotes_and_newlines(spark, tmp_path):
    path = tmp_path / "m.csv"
    path.write_text('a,b\n1,"say ""x"", then\nnew line"\n,2\n')
    assert values(readers.read_metadata(spark, str(path), PAIR), "a", "b") == [("", "2"), ("1", 'say "x", then\nnew line')]
    path.write_text("a,b\n1,2\n1,2,3\n")
    assert readers.read_metadata(spark, str(path), PAIR, "skip").count() == 1
    with pytest.raises(Exception, match="MALFORMED|FAILED_READ_FILE"):
        readers.read_metadata(spark, str(path), PAIR).collect()


def test_small_readers(spark, tmp_path):
    (tmp_path / "c.csv").write_text("/m/1,Dog\n/m/2,Cat\n")
    assert readers.read_headerless(spark, str(tmp_path / "c.csv"), ["LabelName", "ClassName"]).count() == 2
    (tmp_path / "n.jsonl").write_text('{"image_id":"1","caption":"c"}\n{"image_id":"2","z":1}\n')
    got = readers.read_jsonl(spark, str(tmp_path / "n.jsonl"), schemas.NARRATIVES)
    assert values(got, "image_id", "caption") == [("1", "c"), ("2", "")]
    registry = {"a/b": {"status": "COMPLETED", "date": "2026-01-01"}, "c": {"status": "MODEL_FAULT", "reason": "r"}}
    (tmp_path / "r.json").write_text(json.dumps(registry, indent=4))
    got = readers.read_registry(spark, str(tmp_path / "r.json"))
    assert values(got, "model", "status", "reason") == [("a/b", "COMPLETED", None), ("c", "MODEL_FAULT", "r")]


def test_parquet_glob(spark, tmp_path):
    for name in ("train-0", "train-1", "test-0"):
        spark.range(3).coalesce(1).write.parquet(str(tmp_path / "tmp" / name))
        part = next((tmp_path / "tmp" / name).glob("*.parquet"))
        (tmp_path / f"{name}.parquet").write_bytes(part.read_bytes())
    folder = str(tmp_path)
    assert readers.read_parquet_glob(spark, folder, "train").count() == 6
    with pytest.raises(PySparkException):
        readers.read_parquet_glob(spark, folder, "valid")
    assert readers.read_records(spark, str(tmp_path / "train-0.parquet"), ["id"], 2).count() == 2


def test_listing_and_payloads(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name, body in (("b.JPG", b"12"), ("a.png", b"1"), ("x.txt", b"z"), ("sub/c.jpg", b"123")):
        (tmp_path / name).write_bytes(body)
    flat = readers.list_media(spark, str(tmp_path), ["jpg", "png"])
    assert values(flat, "name", "length") == [("a.png", 1), ("b.JPG", 2)]
    assert readers.list_media(spark, str(tmp_path), ["jpg", "png"], recursive=True).count() == 3
    plain = spark.read.format("binaryFile").load(str(tmp_path)).filter("path like '%b.JPG'").select("path", "modificationTime")
    assert values(flat.filter("name = 'b.JPG'"), "path", "modificationTime") == values(plain, "path", "modificationTime")
    meta = spark.createDataFrame([("a.png", "real"), ("zz.png", "fake")], "filename string, label string")
    embedded, missing = readers.embed_payload(meta, readers.read_payloads(spark, str(tmp_path)), "filename")
    assert [(bytes(r["image"]["bytes"]), r["image"]["path"], r["label"]) for r in embedded.collect()] == [(b"1", "a.png", "real")]
    assert values(missing, "filename") == [("zz.png",)]


def test_tagged_union_and_shard_merge(spark, tmp_path):
    for name in ("one", "two.x"):
        (tmp_path / f"{name}.csv").write_text("a,b\n1,2\n")
    tagged = readers.read_tagged_union(spark, str(tmp_path / "*.csv"), PAIR, "run")
    assert values(tagged, "run", "a") == [("one", "1"), ("two.x", "1")]
    rows, counts = readers.merge_shards(spark, str(tmp_path / "*.csv"), PAIR)
    assert rows.count() == 2 and values(counts, "shard", "rows") == [("one", 1), ("two.x", 1)]


def test_manifests_under_three_names(spark, tmp_path):
    for name, body in (("a", {"roc_auc": 0.5, "rows": 3}), ("b", {"roc_AUC": 0.6}), ("c", {"auc_roc": 0.7}), ("d", {})):
        (tmp_path / f"{name}.json").write_text(json.dumps(body, indent=2))
    got = overall_auc(readers.read_manifests(spark, str(tmp_path / "*.json")))
    assert values(got, "run", "auc") == [("a", 0.5), ("b", 0.6), ("c", 0.7), ("d", None)]


def test_split_and_manifest(spark, tmp_path):
    df = spark.createDataFrame([("1", 'x "y"\nz'), ("2", "")], PAIR)
    body = writers.write_split(df, str(tmp_path), "train", {"seed": 42})
    assert body["rows"] == 2 and body["seed"] == 42
    assert values(readers.read_metadata(spark, str(tmp_path / "train.csv"), PAIR), "a", "b") == [("1", 'x "y"\nz'), ("2", "")]
    assert json.loads(spark.read.text(str(tmp_path / "train.csv.json"), wholetext=True).first()[0])["rows"] == 2


def test_shards_have_exact_sizes_and_resume(spark, tmp_path):
    folder = str(tmp_path / "shards")
    df = spark.range(1050).select(F.col("id").cast("string").alias("k"))
    sizes = {r["shard"]: r["rows"] for r in writers.write_shards(df, folder, "k", 100, 42).collect()}
    assert sizes == {i: 100 for i in range(10)} | {10: 50}
    assert all(len(list((tmp_path / "shards" / f"shard={i}").glob("*.parquet"))) == 1 for i in range(11))
    before = values(spark.read.parquet(folder), "k", "shard")
    for part in (tmp_path / "shards" / "shard=3").iterdir():
        part.unlink()
    (tmp_path / "shards" / "shard=3").rmdir()
    assert values(writers.write_shards(df.repartition(3), folder, "k", 100, 42), "rows").count((100,)) == 10
    assert values(spark.read.parquet(folder), "k", "shard") == before


def test_append_publish_and_records(spark, tmp_path):
    path = str(tmp_path / "meta")
    row = spark.createDataFrame([("f", "fake", "s", "2024-01-02", "i", "false")], "filename string, label string, subreddit string, post_date string, reddit_id string, packaged string")
    for _ in range(2):
        writers.append_metadata(row, path, schemas.POSTS)
    assert spark.read.parquet(path).count() == 2
    assert dict(spark.read.parquet(path).dtypes)["packaged"] == "boolean"

    split = spark.range(50).select(F.col("id").cast("string").alias("file_name"), F.lit("fake").alias("label"))
    layout = writers.publish_layout({"train": split, "test": split.limit(5)}, "core", schemas.SAMPLES, "file_name", 1)
    assert values(writers.layout_shares(layout), "split", "n", "fake_pct") == [("test", 5, 100.0), ("train", 50, 100.0)]
    writers.write_layout(layout, str(tmp_path / "hub"), "file_name")
    back = spark.read.parquet(str(tmp_path / "hub"))
    assert back.filter("split = 'train' and config = 'core'").count() == 50 and back.filter("model is null").count() == 55

    writers.write_records(split.withColumn("raw", F.lit("x")), str(tmp_path / "records"), ["raw"])
    assert spark.read.json(str(tmp_path / "records")).columns == ["file_name", "label"]


def test_packaging_end_to_end(spark, tmp_path):
    meta = spark.createDataFrame([(f"f{i}.jpg", i == 0) for i in range(12)], "filename string, packaged boolean")
    media = spark.createDataFrame([(f"f{i}.jpg", b"x" * i) for i in range(11)], "name string, content binary")
    scores = spark.createDataFrame([("f1.jpg", [("nsfw", 0.9)])], "filename string, scores array<struct<label:string,score:double>>")
    out = package(meta, media, scores, str(tmp_path / "out"), rows_per_shard=4)
    assert values(out["shards"], "rows") == [(1,), (4,), (4,)]
    assert values(out["quarantine"], "filename") == [("f1.jpg",)] and values(out["missing"], "filename") == [("f11.jpg",)]
    flags = dict(values(out["meta"], "filename", "packaged"))
    assert not flags["f1.jpg"] and not flags["f11.jpg"] and sum(flags.values()) == 10


def test_batches_of_equal_names_agree_over_reruns(spark, shuffled):
    rows = [(f"s{i // 7:03d}", i * 37 % 101) for i in range(700)]
    want = {}
    for place, (name, length) in enumerate(sorted(rows)):
        want.setdefault(place // 10 + 1, []).append((name, length))
    shards = spark.createDataFrame([*rows, (None, 5)], "name string, length int")
    for parts in (1, 4, 9):
        _, batches = writers.pending_batches(shuffled(shards, parts), shards.limit(0), 10)
        got = {r["batch"]: (r["files"], r["bytes"], r["first"], r["last"]) for r in batches.collect()}
        assert got == {b: (len(x), sum(n for _, n in x), x[0][0], x[-1][0]) for b, x in want.items()}


def test_pages_of_one_address_are_embedded(spark, tmp_path):
    pages = [(i, f"https://a.{'net' if i % 3 == 0 else 'org'}/{i // 4}", None if i == 7 else f"<p>{i}</p>") for i in range(40)]
    spark.createDataFrame([*pages, (40, None, "x")], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = con.sql(entry.oracle_sql()["embed_payload"]).fetchall()
    got = entry.queries()["embed_payload"](spark, str(tmp_path))
    assert values(got, "path", "page_id", "bytes", "digest") == sorted(want, key=repr) and len(want) == 26


def test_pending_batches(spark):
    shards = spark.createDataFrame([(f"s{i:02d}", i) for i in range(25)], "name string, length int")
    numbered, batches = writers.pending_batches(shards, shards.limit(2), 10)
    assert numbered.count() == 23
    assert values(batches, "batch", "files") == [(1, 10), (2, 10), (3, 3)]
    assert writers.mark_packaged(shards).filter("packaged").count() == 25


def test_package_never_loses_rows_of_a_second_run(spark, tmp_path):
    folder = str(tmp_path / "out")
    media = spark.createDataFrame([(f"f{i}.jpg", bytes([i])) for i in range(16)], "name string, content binary")
    scores = spark.createDataFrame([], "filename string, scores array<struct<label string, score double>>")
    first = spark.createDataFrame([(f"f{i}.jpg", False) for i in range(8)], "filename string, packaged boolean")
    package(first, media, scores, folder, rows_per_shard=4)
    grown = spark.createDataFrame([(f"f{i}.jpg", False) for i in range(16)], "filename string, packaged boolean")
    out = package(grown, media, scores, folder, rows_per_shard=4)
    on_disk = spark.read.parquet(folder)
    assert values(on_disk, "path") == sorted((f"f{i}.jpg",) for i in range(16))
    assert values(out["shards"], "shard", "rows") == [(i, 4) for i in range(4)]
    assert out["meta"].filter("packaged").count() == 16
    missing = spark.createDataFrame([("none.jpg", False)], "filename string, packaged boolean")
    assert package(missing, media, scores, folder)["meta"].filter("packaged").count() == 0


def test_grown_input_goes_to_new_shards(spark, tmp_path):
    folder = str(tmp_path / "out")
    writers.write_shards(spark.range(8).withColumnRenamed("id", "k"), folder, "k", 4, 42)
    sizes = writers.write_shards(spark.range(11).withColumnRenamed("id", "k"), folder, "k", 4, 42)
    assert values(sizes, "shard", "rows") == [(0, 4), (1, 4), (2, 3)]


def test_one_name_in_two_folders_is_an_error(spark):
    meta = spark.createDataFrame([("a.jpg",)], "filename string")
    media = spark.createDataFrame([("a.jpg", b"1"), ("a.jpg", b"2")], "name string, content binary")
    with pytest.raises(Exception, match="several files named a.jpg"):
        readers.embed_payload(meta, media, "filename")[0].collect()


def test_quoted_texts_in_worker_outputs(spark, tmp_path):
    (tmp_path / "w1.csv").write_text('id,text\n1,"two ""quoted""\nlines"\n2,plain\n')
    schema = T.StructType.fromDDL("id string, text string")
    rows, counts = readers.merge_shards(spark, str(tmp_path), schema)
    assert values(rows, "id", "text") == [("1", 'two "quoted"\nlines'), ("2", "plain")]
    assert values(counts, "shard", "rows") == [("w1", 2)]
    (tmp_path / "bad.csv").write_text("id,text\n1,a\n2\n3,b,c\n")
    bad = readers.bad_records(spark, str(tmp_path / "bad.csv"), schema)
    kept = readers.read_metadata(spark, str(tmp_path / "bad.csv"), schema, bad_lines="skip")
    assert bad.count() + kept.count() == 3 and bad.count() > 0


def test_registry_is_written_in_bounded_documents(spark, monkeypatch):
    from veritable.catalog import files

    folder = "/root/testdata/sf0.1"
    names = {r["s_name"] for r in spark.read.parquet(f"{folder}/supplier.parquet").select("s_name").collect()}
    monkeypatch.setattr(files, "REGISTRY_ROWS", len(names) // 5, raising=False)
    got = files.read_registry(spark, folder)
    assert len(got.inputFiles()) > 3
    assert values(got, "model") == sorted(((n,) for n in names), key=repr)


def test_listing_is_shared_out_by_folders(spark, tmp_path, monkeypatch):
    want = []
    for i in range(40):
        for name in (f"d{i}/x{i}.mp4", f"d{i}/e/f/y{i}.MOV", f"d{i}/z.txt", f"d{i}/_hidden.mp4", f"d{i}/.h/q.mp4"):
            file = tmp_path / name
            file.parent.mkdir(parents=True, exist_ok=True)
            file.write_bytes(b"1" * i)
            if name.lower().endswith(("mp4", "mov")) and "hidden" not in name and ".h/" not in name:
                want.append((f"file:{file}", i))
    (tmp_path / "top.mp4").write_bytes(b"")
    listed = readers.list_media(spark, str(tmp_path), [".mp4", "MOV"], recursive=True)
    assert values(listed, "path", "length") == sorted([*want, (f"file:{tmp_path}/top.mp4", 0)], key=repr)
    assert listed.rdd.getNumPartitions() >= 40
    reader = listing.ListingReader({"path": str(tmp_path), "recursive": "true"})
    rest = list(reader.pushFilters([In(("extension",), ("mp4", "mov")), EqualTo(("extension",), "mp4"), EqualTo(("name",), "a")]))
    assert rest == [EqualTo(("name",), "a")] and reader.extensions == {"mp4"}
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 41
    monkeypatch.setattr(listing, "PREFIXES", 1)
    assert [(p.folder, p.deep) for p in reader.partitions()] == [(str(tmp_path), True)]
    assert sum(b.num_rows for b in reader.read(reader.partitions()[0])) == 41
    assert readers.list_media(spark, str(tmp_path / "d0" / "e"), ["mp4"]).count() == 0


@pytest.fixture
def small_blocks(spark):
    """Files in blocks of some hundred bytes, each a task."""
    names = {"spark.sql.files.maxPartitionBytes": "300", "spark.sql.files.openCostInBytes": "1"}
    before = {n: spark.conf.get(n) for n in names}
    for name, value in names.items():
        spark.conf.set(name, value)
    yield
    for name, value in before.items():
        spark.conf.set(name, value)


def test_records_over_lines_are_read_by_many_tasks(spark, tmp_path, small_blocks):
    rng = random.Random(6)
    bits = ["a", "b,", '"', "\n", "é", " ", "\n\n", "x" * 40, "\r\n", ",,", '""']
    rows = [("".join(rng.choices(bits, k=rng.randint(0, 12))), f"r{i}") for i in range(400)]
    rows[50] = ("long\n" * 400 + '"', "r50")  # a record over many blocks
    rows[51] = ("", "r51")

    def field(text):
        return '"' + text.replace('"', '""') + '"' if any(c in text for c in ',"\n\r') or rng.random() < 0.2 else text

    for name, part, end in (("one", rows[:300], "\n"), ("two", rows[300:], "\r\n")):
        lines = ["a,b", *(f"{field(a)},{field(b)}" for a, b in part)]
        (tmp_path / f"{name}.csv").write_bytes((end.join(lines) + end + end).encode())
    path = str(tmp_path)
    assert spark.read.text(path).rdd.getNumPartitions() > 20
    split = readers.read_metadata(spark, path, PAIR, multiline="split")
    assert values(split, "a", "b") == sorted(rows, key=repr)
    tagged = readers.read_tagged_union(spark, path, PAIR, "file", split=True)
    assert values(tagged.groupBy("file").count(), "file", "count") == [("one", 300), ("two", 100)]


def test_split_reading_of_bad_records_and_nothing(spark, tmp_path, small_blocks):
    (tmp_path / "x.csv").write_text('a,b\n1,2\n1,2,3\n"q\nq",4\n')
    path = str(tmp_path / "x.csv")
    skipped = readers.read_metadata(spark, path, PAIR, bad_lines="skip", multiline="split")
    assert values(skipped, "a", "b") == [("1", "2"), ("q\nq", "4")]
    assert values(skipped, "a", "b") == values(readers.read_metadata(spark, path, PAIR, bad_lines="skip"), "a", "b")
    with pytest.raises(Exception, match="MALFORMED"):
        readers.read_metadata(spark, path, PAIR, multiline="split").collect()
    (tmp_path / "e.csv").write_text("a,b\n")
    assert readers.read_metadata(spark, str(tmp_path / "e.csv"), PAIR, multiline="split").count() == 0


def _documents(spark, folder):
    rows = [(i, f'line "{i}"\nnext, é' if i % 5 else None, ["en", "fr", None][i % 3], f"s{i % 2}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    docs.repartition(4).write.parquet(f"{folder}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    return con


@pytest.mark.parametrize(("name", "written"), [("read_metadata_split", "*.csv"), ("list_media", "lang=en/*.txt")])
def test_round_trips_write_in_many_tasks(spark, tmp_path, monkeypatch, name, written):
    """No task writes a whole table, or all of a language."""
    con = _documents(spark, tmp_path)
    monkeypatch.setattr(files, "fresh_path", lambda spark, label: f"{tmp_path}/{label}")
    limit = spark.conf.get("spark.sql.files.openCostInBytes"), spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    spark.conf.set("spark.sql.files.openCostInBytes", "2k")
    try:
        got = entry.queries()[name](spark, str(tmp_path))
        result = con.sql(entry.oracle_sql()[name])
        assert values(got, *result.columns) == sorted(result.fetchall(), key=repr)
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", limit[0])
        spark.conf.set("spark.sql.files.maxPartitionBytes", limit[1])
    assert len(list(tmp_path.glob(f"*/{written}"))) >= 3
