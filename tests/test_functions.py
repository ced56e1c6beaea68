import hashlib
import random

import duckdb
import pyarrow as pa
from helpers import values
from pyspark.sql import functions as F

from veritable.functions import feed, labels, media, models, naming, scores, text
from veritable.functions.hashing import order_hash, uniform, uniform_int
from veritable.functions.naming import Rule


def one(spark, data, schema, expr):
    return [r[0] for r in spark.createDataFrame(data, schema).select(expr).collect()]


def test_hash_and_uniform_follow_md5(spark):
    got = one(spark, [("k",)], "k string", order_hash(42, "k"))[0]
    assert got == hashlib.md5(b"42:k").hexdigest()
    u = one(spark, [("k",)], "k string", uniform(42, "k"))[0]
    assert u == int(got[:8], 16) / 2**32
    draws = [r[0] for r in spark.range(2000).select(uniform_int(1, "id", 3, 7)).collect()]
    assert set(draws) == {3, 4, 5, 6, 7}


def test_labels(spark):
    data = [(" Fake\n",), ("TRUE",), ("full_synthetic",), ("1",), ("real",), ("",), (None,)]
    assert one(spark, data, "l string", labels.normalize_label("l")) == ["fake"] * 4 + ["real"] * 3
    assert one(spark, data, "l string", labels.label_to_int("l")) == [1, 0, 0, 0, 0, 0, 0]
    narrow = labels.normalize_label("l", ("fake",))
    assert one(spark, data, "l string", narrow) == ["fake"] + ["real"] * 6
    assert one(spark, [(1,), (0,), (2,)], "l int", labels.normalize_label("l", numeric=True)) == ["fake", "real", "real"]


def test_families_are_tried_in_order(spark):
    rules = [
        Rule("xl", contains=("-xl",)),
        Rule("flow pro", contains_all=("flow", "pro")),
        Rule("flow", contains=("flow",)),
        Rule("exact", equals=("sd-2.1",)),
    ]
    data = [("Flow_XL",), ("flow-1-PRO",), ("flow-dev",), ("SD_2.1",), ("sd-2.1-b",), ("camera",)]
    family = naming.family_of("m", rules, real_sources=["camera"], real_family="Real")
    assert one(spark, data, "m string", family) == ["xl", "flow pro", "flow", "exact", "sd-2.1-b", "Real"]
    assert one(spark, data, "m string", naming.is_video("m", ["flow-"])) == [True, True, True, False, False, False]


def test_display_names(spark):
    models_ = spark.createDataFrame([("a_b",), ("a-b",), ("stable__diffusion-xl-V2a",)], "m string")
    names = spark.createDataFrame([("a-b", "Known")], "name string, display string")
    assert values(naming.display_names(models_, "m", names), "m", "display") == [
        ("a-b", "Known"), ("a_b", "Known"), ("stable__diffusion-xl-V2a", "Stable Diffusion XL v2a"),
    ]


def test_variants_and_months(spark):
    data = [("ft",), (" LoRA ",), ("Video",), ("image",), ("",)]
    assert one(spark, data, "k string", naming.variant_tag("k")) == ["FT", "LoRA", "video", "image", "base"]
    data = [("2024-05-01",), ("2024",), ("unknown",), ("",), (None,)]
    assert one(spark, data, "k string", naming.release_month("k")) == ["2024-05", "2024", "unknown", None, None]


def test_held_out_longest_first(spark):
    match = naming.held_out_match("m", ["img", "img-turbo"], [("im", "img-turbo")])
    data = [("My-IMG-Turbo-2",), ("img-1",), ("imx",), ("other",), ("",), (None,)]
    assert one(spark, data, "m string", match) == ["img-turbo", "img", "img-turbo", None, None, None]


def test_texts(spark):
    data = [("Prompt: The image shows a cat",), ("The image is ",), ("the image is x",), ("Prompt:  x ",)]
    assert one(spark, data, "t string", text.clean_prompt("t")) == ["A cat", "", "the image is x", "x"]
    replies = [
        ('{"prompt": " a \\"b\\" "}',), ('Sure! {"n": 1, "prompt": "c d"} ok',), ("  just text ",), ('{"prompt": ',),
    ]
    assert one(spark, replies, "t string", text.extract_prompt("t")) == ['a "b"', "c d", "just text", '{"prompt":']
    verdicts = [("Humans: Yes, catastrophes: YES",), ("humans: no Catastrophes: yes",), (None,)]
    assert one(spark, verdicts, "t string", text.parse_verdict("t")["category"]) == ["both", "catastrophe", "none"]
    names = [("a/b:c?.",), ("...",), (None,), ("x" * 79 + ". y",)]
    assert one(spark, names, "t string", text.safe_filename("t")) == ["a_b_c_", "untitled", "untitled", "x" * 79]


def test_media(spark):
    urls = [("http://a/b.JPG",), ("x.mp4",), ("x.gif",), (None,)]
    assert one(spark, urls, "u string", media.url_kind("u")) == ["image", "video", "other", "other"]
    paths = [("/a/b.c/d.tar.gz",), ("e",), (".hidden",)]
    assert one(spark, paths, "p string", media.file_stem("p")) == ["d.tar", "e", ".hidden"]
    heads = [(b"\xff\xd8\xff",), (b"\x89PNG\r\n\x1a\n..",), (b"RIFF1234WEBPx",), (b"1234ftypavif",), (b"RIFF1234WAVE",), (b"",)]
    assert one(spark, heads, "b binary", media.sniff_media("b")) == [".jpg", ".png", ".webp", ".avif", ".jpg", ".jpg"]
    sizes = [(4000, 10), (100, 50), (3, 9000)]
    got = spark.createDataFrame(sizes, "w int, h int").select(media.resize_target("w", "h", 1000).alias("t")).select("t.*")
    assert [tuple(r) for r in got.collect()] == [(1000, 2), (100, 50), (1, 1000)]
    rel = [("/abs",), ("rel",)]
    assert one(spark, rel, "p string", media.resolve_path("p", "/root/", "civit")) == ["/abs", "/root/civit/rel"]
    assert one(spark, [("Ab.png",)], "p string", media.asset_url("p", "http://m/")) == ["http://m/a/Ab.png"]


def test_models(spark):
    data = [(["LoRA"], None), (["peft", "base_model:Org/X"], []), ([], ["p", "q"]), (None, None), (["x"], [""])]
    df = spark.createDataFrame(data, "tags array<string>, base array<string>")
    got = df.select(models.classify_model("tags", "base").alias("c")).select("c.*").collect()
    assert [tuple(r) for r in got] == [
        ("LoRA", 2000, "None"), ("LoRA", 2000, "org/x"), ("Fine-tune", 5000, "p"), ("Base", 10000, "None"), ("Base", 10000, "None"),
    ]
    codes = one(spark, [(0,), (14,), (137,), (77,)], "c int", models.run_status("c")["status"])
    assert codes == ["COMPLETED", "HALT", "INFRASTRUCTURE_FAULT", "INFRASTRUCTURE_FAULT"]
    faults = [("CUDA out of memory",), ("no such file or directory: config.json",), ("No such file or directory x",), ("bad Weight",), (None,)]
    assert one(spark, faults, "m string", models.fault_code("m")) == [12, 11, 10, 11, 14]
    assert one(spark, [(10000,), (5000,), (9,)], "q int", models.task_tiers("q", 3)) == [10, 5, 3]


def test_probability_of_extreme_logits(spark):
    data = [([0.0],), ([1000.0, -1000.0],), ([-1000.0, 1000.0],), ([2.0, 2.0],)]
    got = one(spark, data, "l array<double>", scores.fake_probability("l"))
    assert got == [0.5, 0.0, 1.0, 0.5]


def test_posts_use_every_way_to_media(spark):
    posts = [
        '{"id":"1","encodings":{"source":{"path":""},"ld":{"url":"u1","width":7}},"height":5}',
        '{"gen_id":"2","url":"","video_url":"v.mp4"}',
        '{"id":"3","url":"http://videos.test/z","author":{"name":"n"}}',
        '{"id":"4","media":[{"type":"image","url":"i"},{"path":"p4","height":3}]}',
        '{"id":"5","video":{"source":"s5","duration_secs":4.0}}',
        '{"id":"6","generation":{"id":"6b","media":{"url":"u6"}}}',
        '{"id":"7","generations":[{"id":"7b","text":"t","url":"g.mp4"}]}',
        '{"id":"8","url":"nothing"}',
        "not json",
    ]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(posts, 1)], "n int, post string")
    got = feed.normalize_posts(df, "post", hosts=["videos.test"])
    assert values(got, "n", "id", "video_url", "width", "height", "duration", "creator") == [
        (1, "1", "u1", 7, 5, 0.0, "unknown"),
        (2, "2", "v.mp4", 0, 0, 0.0, "unknown"),
        (3, "3", "http://videos.test/z", 0, 0, 0.0, "n"),
        (4, "4", "p4", 0, 3, 0.0, "unknown"),
        (5, "5", "s5", 0, 0, 4.0, "unknown"),
        (6, "6b", "u6", 0, 0, 0.0, "unknown"),
        (7, "7b", "g.mp4", 0, 0, 0.0, "unknown"),
    ]


def test_posts_nest_without_limit(spark):
    def nested(levels):
        body = '{"id":"in","url":"x.mp4"}'
        for i in range(levels):
            body = f'{{"generation":{body}}}' if i % 2 else f'{{"generations":[{body}]}}'
        return body

    df = spark.createDataFrame([(n, nested(n)) for n in range(5)] + [(9, '{"id":"q"}'), (8, "junk"), (7, None)], "n int, post string")
    assert values(feed.normalize_posts(df, "post", hosts=()), "n", "id", "video_url") == [(n, "in", "x.mp4") for n in range(5)]
    left = feed.posts_without_media(df, "post", "n", hosts=())
    assert values(left, "n", "reason") == [(7, "no post"), (8, "not JSON"), (9, "no media at any level")]


def test_prompts_in_prose(spark):
    rows = [('Sure: {"prompt": "say \\"hi\\""} ok',), ('{"a":1} then {"prompt":"b"}',), (" plain ",)]
    df = spark.createDataFrame(rows, "t string")
    assert [r[0] for r in df.select(text.extract_prompt("t")).collect()] == ['say "hi"', "b", "plain"]


def test_pages(spark):
    pages = [
        ('{"items":[{"a":1}],"nextCursor":"c"}',), ('[{"a":1},{"b":2}]',), ('{"posts":"no","data":[1],"hasMore":false,"next":"n"}',),
        ('{"pagination":{"cursor":"p"},"has_more":true}',), ("junk",),
    ]
    df = spark.createDataFrame(pages, "t string").select(feed.unwrap_page("t").alias("p"))
    got = df.select(F.size("p.posts"), "p.cursor").collect()
    assert [tuple(r) for r in got] == [(1, "c"), (2, None), (1, None), (0, "p"), (0, None)]


def test_long_lists_of_held_out_names(spark):
    rng = random.Random(8)
    word = lambda lo, hi: "".join(rng.choices("abcAB-é", k=rng.randint(lo, hi)))
    held = [word(1, 9) for _ in range(400)] + ["", "abc", "ABC"]
    models = [word(0, 14) for _ in range(300)] + [None, " abcab ", "zz" + held[0], held[1], "qq"]
    families = [("q", "Fam"), ("é", "other"), ("zz", "third")]
    df = spark.createDataFrame([(i, m) for i, m in enumerate([*models, *models[:40]])], "i int, m string")
    listed = spark.createDataFrame([(h,) for h in held], "name string")
    told = spark.createDataFrame([(a, b, i) for i, (a, b) in enumerate(families)], "part string, result string, place int")
    plain = df.select("i", naming.held_out_match("m", [h for h in held if h], families).alias("held_out"))
    joined = naming.held_out_join(df, listed, told, "m")
    assert joined.columns == ["i", "m", "held_out"]
    assert values(joined, "i", "held_out") == values(plain, "i", "held_out")
    assert naming.held_out_join(df, listed.limit(0), None, "m").filter("held_out IS NOT NULL").count() == 0
    # The list is data of a join, not part of the plan.
    small = naming.held_out_join(df, listed.limit(5), told, "m")._jdf.queryExecution().optimizedPlan().toString()
    large = joined._jdf.queryExecution().optimizedPlan().toString()
    assert len(large) < len(small) + 200


def test_capitals_are_one_letter(spark):
    letters = [chr(i) for i in range(1, 0x20000) if not 0xD800 <= i <= 0xDFFF]
    replies = [(f"The image shows {c}x",) for c in letters]
    got = one(spark, replies, "t string", text.clean_prompt("t"))
    rows = pa.table({"c": letters})  # noqa: F841
    want = [r[0] for r in duckdb.connect().sql("SELECT upper(c) || 'x' FROM rows").fetchall()]
    assert got == want and len(set(map(len, got))) == 1
    assert one(spark, [("The image is ",), ("an image",), (None,)], "t string", text.clean_prompt("t")) == ["", "an image", None]


def test_grams_are_never_broadcast(spark):
    """The names are few bytes, their grams are many: only the names' size is known before they are made."""
    every = spark.range(6000).select("id", F.concat(F.lit("https://host."), F.sha2(F.col("id").cast("string"), 256)).alias("m"))
    names, held = every.filter("id < 1000").select("m"), every.select(F.substring("m", 9, 40).alias("name"))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100k")
    try:
        joined = naming.held_out_join(names, held, None, "m")
        assert joined.filter("held_out IS NULL").count() == 0
        joined.collect()
        final = joined._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    below, explodes = [], 0
    for line in final.splitlines():
        depth = len(line) - len(line.lstrip(" :+-*()0123456789"))
        below = [d for d in below if d < depth]  # broadcasts that this line stands under
        if "BroadcastExchange" in line:
            below.append(depth)
        if "Generate explode" in line:
            explodes += 1
            assert not below, final
    assert explodes
