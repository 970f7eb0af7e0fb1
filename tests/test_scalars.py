import json
import random

import pytest
from pyspark.sql import functions as F

from veriloom.functions import nested as N
from veriloom.functions import scalars as S

BASE = S.SOURCE_TYPE_BASE
T = lambda x: F.lit(x).cast("string") if x is None else F.lit(x)
CASES = [
    ("hex", lambda: S.bytes_hex(F.array(F.lit(0), F.lit(15), F.lit(255))), "000fff"),
    ("vector text", lambda: S.vector_text(F.array(F.lit(1), F.lit(2))), "[1,2]"),
    ("instance", lambda: S.instance_hash(T("urn:uuid:u1")), "iid_u1"),
    ("composite isn't trained", lambda: S.source_type(T(BASE + "compositeWithTrainedAlgorithmicMedia")), BASE + "compositeWithTrainedAlgorithmicMedia"),
    ("capture", lambda: S.source_type(T(BASE + "digitalCapture")), "digitalCapture"),
    ("label default", lambda: S.source_type_label(T("a/newKey")), "newKey"),
    ("label slash", lambda: S.source_type_label(T("a/")), "a/"),
    ("label null", lambda: S.source_type_label(T(None)), "Unknown"),
    ("hardware", lambda: S.is_hardware(T(BASE + "multipleExposures")), True),
    ("generator", lambda: S.generator_text(T(""), T("App"), T("2")), "App 2"),
    ("generator none", lambda: S.generator_text(T(None), T(None), T(None)), "Unknown"),
    ("generator cleanup", lambda: S.generator_name(T("Some SDK for Android 8.4")), "Some SDK for Android"),
    ("action", lambda: S.action_display(T("c2pa.color_adjustments")), "COLOR ADJUSTMENTS"),
    ("ai words", lambda: S.is_ai_action(T(None), T("Edited with Generative AI")), True),
    ("ai composite", lambda: S.is_ai_action(T(BASE + "compositeWithTrainedAlgorithmicMedia"), T(None)), False),
    ("listed ai composite", lambda: S.is_listed_ai_action(T(BASE + "compositeWithTrainedAlgorithmicMedia"), T(None)), True),
    ("listed ai plain", lambda: S.is_listed_ai_action(T(BASE + "trainedAlgorithmicMedia"), T(None)), False),
    ("composite", lambda: S.is_composite(T(BASE + "compositeWithTrainedAlgorithmicMedia")), True),
    ("trusted", lambda: S.is_trusted_issuer(T("X Google LLC"), ["Google LLC"]), True),
    ("heic store", lambda: S.extension_of(T("image/heic")), "heic"),
    ("heic upload", lambda: S.extension_of(T("image/heic"), S.UPLOAD_EXTENSIONS), "bin"),
    ("path", lambda: S.path_extension(T("media/h/original.jpg")), "jpg"),
    ("sidecar", lambda: S.object_key(T("h"), "sidecar"), "media/h/metadata.c2pa"),
    ("address", lambda: S.truncated(T("ABCDEFGHIJ"), 4, 4), "ABCD...GHIJ"),
    ("price", lambda: S.price_parse(T("1.1")), 1_100_000_000),
    ("price empty", lambda: S.price_parse(T("")), 0),
    ("price prefix", lambda: S.price_parse(T("1.5abc")), 1_500_000_000),
    ("price none", lambda: S.price_parse(T("abc")), None),
    ("price none in edits", lambda: S.price_parse(T("abc"), nan_as_zero=True), 0),
    ("free", lambda: S.price_display(F.lit(0)), "free"),
    ("shown", lambda: S.price_display(F.lit(1_230_000_000)), "1.23 SOL"),
    ("percent", lambda: S.percent(F.lit(0.125)), 13),
    ("percent negative", lambda: S.percent(F.lit(-0.025)), -2),
    ("prefix", lambda: S.without_prefix(T("https://gw/x"), "https://gw/"), "x"),
    ("other prefix stays", lambda: S.without_prefix(T("https://dev/x"), "https://gw/"), "https://dev/x"),
    ("seconds", lambda: S.epoch_seconds(F.lit(1999)), 1),
    ("no seconds", lambda: S.epoch_seconds(F.lit(None).cast("long")), 0),
    ("created", lambda: S.created_at(T(None), F.lit(1)), "1970-01-01T00:00:01.000Z"),
    ("assertion", lambda: S.assertion_label(T("c2pa.soft-binding__1"), {"c2pa.soft-binding": "mark"}), "mark #2"),
    ("assertion unknown", lambda: S.assertion_label(T("x__1"), {"y": "z"}), "x__1"),
    ("preview", lambda: S.binary_preview(F.sequence(F.lit(1), F.lit(9))), "[binary: 9 bytes] (1, 2, 3, 4, 5, 6, 7, 8...)"),
    ("json", lambda: S.looks_like_json(T("{a")), True),
    ("gps", lambda: S.has_gps(T(None), F.lit(1.5)), True),
    ("camera", lambda: S.camera(T("Make"), T(None)), "Make"),
    ("no camera", lambda: S.camera(T(None), T("")), None),
    ("fit", lambda: S.fitted(F.lit(1024), F.lit(333)).getField("height"), 167),
    ("small stays", lambda: S.fitted(F.lit(10), F.lit(20)).getField("width"), 10),
    ("title", lambda: S.title_or_file(T(""), T("a.b.c")), "a"),
    ("pages 1", lambda: S.page_window(F.lit(1), F.lit(10)), list(range(1, 8))),
    ("pages 7", lambda: S.page_window(F.lit(7), F.lit(10)), list(range(4, 11))),
    ("pages 10", lambda: S.page_window(F.lit(10), F.lit(10)), list(range(4, 11))),
    ("no pages", lambda: S.page_window(F.lit(1), F.lit(0)), []),
    ("zero vector", lambda: S.cosine_similarity(F.array(F.lit(0.0)), F.array(F.lit(1.0))), None),
    ("cosine", lambda: S.cosine_similarity(F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(3.0), F.lit(4.0))), 1.0),
    ("missing status is valid", lambda: N.is_valid(F.lit(None).cast("array<struct<code:string,explanation:string>>")), True),
    ("failure", lambda: N.is_valid(F.array(F.struct(F.lit("failure.x").alias("code"), T(None).alias("explanation")))), False),
    ("errors", lambda: N.errors(F.array(F.struct(F.lit("failure.x").alias("code"), T(None).alias("explanation")))), ["failure.x"]),
    ("prefix count", lambda: N.count_prefix(F.array(F.lit("c2pa.soft-binding"), F.lit("c2pa.soft-binding__1"), F.lit("x")), "c2pa.soft-binding"), 2),
]


@pytest.fixture(scope="module")
def results(spark):
    got = spark.range(1).select(*[f().alias(f"c{k}") for k, (_, f, _) in enumerate(CASES)]).head()
    return dict(zip([n for n, *_ in CASES], got, strict=True))


@pytest.mark.parametrize("name,want", [(n, w) for n, _, w in CASES])
def test_scalar(results, name, want):
    assert results[name] == want


KIND = "issuer string, instance_id string, assertions array<struct<label:string,hash:array<int>,val:array<int>,data:array<int>>>"


def test_content_hash(spark):
    a = lambda label, h=None, v=None, d=None: (label, h, v, d)
    rows = [
        ("Google LLC", "urn:uuid:u1", [a("c2pa.hash.data", [1]), a("c2pa.hash.data.part", [2])]),  # the first in order
        ("Google LLC", "urn:uuid:u1", [a("c2pa.hash.data", [])]),  # an empty hash falls back
        ("Google LLC", "urn:uuid:u1", [a("other", [1])]),
        ("Google LLC", "x", [a("c2pa.hash.data", None, [255])]),
        ("Sony", "urn:uuid:u1", [a("c2pa.hash.data", [1])]),
        (None, None, None),
    ]
    got = spark.createDataFrame(rows, KIND).select(N.content_hash("issuer", "assertions", "instance_id").alias("h"))
    assert [r["h"] for r in got.collect()] == ["01", "iid_u1", "iid_u1", "ff", None, None]


def test_attributes_and_actions(spark):
    df = spark.sql("""SELECT array(named_struct('trait_type', 'a', 'value', '1'), named_struct('trait_type', 'a', 'value', '2')) AS at,
     array(named_struct('label', 'x', 'actions', array(named_struct('digitalSourceType', 'no'))), named_struct('label', 'c2pa.actions.v2', 'actions', array(named_struct('digitalSourceType', ''), named_struct('digitalSourceType', 'yes')))) AS s""")
    assert df.select(N.attribute("at", "a"), N.attribute("at", "b"), N.first_action_type("s")).head()[:] == ("1", None, "yes")


def test_byte_arrays_as_hex(spark):
    df = spark.createDataFrame([('{"a": [[1, 255]], "hash": [], "b": [1, 300]}',), ("no json",), (None,)], "t string")
    assert [r[0] for r in df.select(N.byte_arrays_as_hex("t")).collect()] == ['{"a": ["0x01ff"], "hash": "0x", "b": [1, 300]}', "no json", None]


def hexed(x):
    if isinstance(x, list):
        if x and all(type(v) in (int, float) and 0 <= v <= 255 for v in x):
            return "0x" + "".join(f"{int(v):02x}" for v in x)
        return [hexed(v) for v in x]
    if isinstance(x, dict):
        return {k: "0x" + "".join(f"{int(u):02x}" for u in v) if k == "hash" and isinstance(v, list) and all(type(u) in (int, float) for u in v) else hexed(v) for k, v in x.items()}
    return x


def test_byte_arrays_at_any_depth(spark):
    """Random JSON of many depths, strings that look like arrays and keys, escapes, wide numbers, and a long array."""
    rng = random.Random(3)

    def value(depth):
        kind = rng.choice(["list", "bytes", "dict", "dict", "text", "number"]) if depth else "number"
        if kind == "list":
            return [value(depth - 1) for _ in range(rng.randint(0, 3))]
        if kind == "bytes":
            return [rng.choice([0, 7, 255, 255, 1.5, 2e1]) for _ in range(rng.randint(1, 4))]
        if kind == "dict":
            return {rng.choice(["a", "hash", "x hash", '"hash"']): value(depth - 1) if rng.random() < 0.7 else [300, -5, 1][: rng.randint(0, 3)] for _ in range(3)}
        return rng.choice(["[1, 2]", '"hash": [1]', 'a\\"[3]', "\\", "é\n", "[1"]) if kind == "text" else rng.choice([1, 256, -1, 0.5, None, True])

    values = [value(rng.randint(1, 12)) for _ in range(300)] + [{"long": [k % 256 for k in range(50_000)], "text": "[1]\\" * 20_000}]
    texts = [json.dumps(v, indent=rng.choice([None, 1])) for v in values]
    got = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", N.byte_arrays_as_hex("t").alias("t")).collect()
    for r in got:
        assert json.loads(r["t"]) == hexed(values[r["k"]])
