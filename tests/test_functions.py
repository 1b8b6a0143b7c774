import datetime as dt
import urllib.parse

import numpy as np
import pytest
from pyspark.sql import functions as F

from shoebox.config import SearchConfig
from shoebox.functions import bits, metadata, text, vec, visual
from shoebox.functions.paths import canonical_path
from shoebox.operators.feedback import multiplier
from shoebox.schemas import PHOTOS, migrated


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


PATHS = [
    ("/a/b.jpg", "/a/b.jpg"), ("  /a/b.jpg\t", "/a/b.jpg"), ("\\a\\b.jpg", "/a/b.jpg"), ("/a//b.jpg", "/a/b.jpg"), ("/a/./b.jpg", "/a/b.jpg"),
    ("/a%20c/b%5Fd.jpg", "/a c/b_d.jpg"), ("/a/100%.jpg", "/a/100%.jpg"), ("/a/b+c.jpg", "/a/b+c.jpg"), ("/a/x/../b.jpg", "/a/b.jpg"), ("/../b.jpg", "/b.jpg"),
    ("b.jpg", "b.jpg"), ("./b.jpg", "b.jpg"), ("/A/b.JPG", "/A/b.JPG"), ("", ""), ("  ", ""), (None, None), ("/a/b/", "/a/b"), ("/", "/"), ("../b", "../b"), ("a/../../b", "../b"),
    ("/a/././b//c/./d", "/a/b/c/d"), ("/a/%2E%2E/b", "/b"), ("/" + "x/" * 300 + "y", "/" + "x/" * 300 + "y"),
]


def test_canonical_path(spark):
    rows = spark.createDataFrame([(i, p) for i, (p, _) in enumerate(PATHS)], "i int, p string")
    got = {r[0]: r[1] for r in rows.select("i", canonical_path(F.col("p"))).collect()}
    assert [got[i] for i in range(len(PATHS))] == [want for _, want in PATHS]


@pytest.mark.parametrize("pos,neg,want", [(0, 0, 1.0), (0, 1, 0.88), (0, 7, 0.16), (0, 8, 0.1), (1, 0, 1.06), (5, 0, 1.3), (6, 0, 1.3), (1, 1, 0.65), (1, 99, 0.307)])
def test_multiplier(spark, pos, neg, want):
    assert one(spark, x=multiplier(F.lit(pos), F.lit(neg)))[0] == pytest.approx(want)


INTENTS = [
    ("xyzzy", (0, 0, 0), "VISUAL", (0.7, 0.2, 0.1)), ("dog tree", (0, 2, 0), "VISUAL", (0.8, 0.1, 0.1)), ("delhi 2023", (2, 0, 0), "METADATA", (0.2, 0.1, 0.7)),
    ("receipt", (0, 0, 1), "TEXT", (0.2, 0.7, 0.1)), ("samsung beach", (1, 1, 0), "HYBRID", (0.55, 0.1, 0.55)), ("mountain", (1, 1, 0), "HYBRID", (0.55, 0.1, 0.55)),
    ("dog receipt", (0, 1, 1), "HYBRID", (0.55, 0.55, 0.1)), ("receipt 2023", (1, 0, 1), "HYBRID", (0.1, 0.55, 0.55)), ("dog receipt delhi", (1, 1, 1), "HYBRID", (0.5, 0.3, 0.2)),
    ("1920x1080", (1, 0, 0), "METADATA", (0.2, 0.1, 0.7)), ("last week", (0, 0, 0), "VISUAL", (0.7, 0.2, 0.1)), ("dog, tree", (0, 1, 0), "VISUAL", (0.8, 0.1, 0.1)),
]


@pytest.mark.parametrize("query,counts,intent,weights", INTENTS)
def test_intent(spark, query, counts, intent, weights):
    n = text.class_counts(F.lit(query))
    plan = text.intent_and_weights(n["m"], n["v"], n["t"])
    row = one(spark, **n, **plan)
    assert (row["m"], row["v"], row["t"]) == counts and row["intent"] == intent
    assert (row["visual"], row["ocr"], row["metadata"]) == pytest.approx(weights)


@pytest.mark.parametrize("query,want", [("total", 1.0), ("invoice", 0.6), ("dues", 0.3), ("zebra", 0.0), ("total total total total", 3.0), ("ab", 0.0), ("42", 0.0)])
def test_text_score(spark, query, want):
    score = text.text_score(F.lit(query), text.meaningful_tokens(F.lit(query)), F.lit("Total amount due 42 invoices"))
    assert one(spark, x=score)[0] == pytest.approx(want)


def test_text_score_of_nothing(spark):
    q = text.meaningful_tokens(F.lit("total"))
    row = one(spark, a=text.text_score(F.lit("total"), q, F.lit("")), b=text.text_score(F.lit("total"), q, F.lit(None).cast("string")))
    assert tuple(row) == (0.0, 0.0)


def test_words(spark):
    row = one(spark, a=text.meaningful_tokens(F.lit("The photo of my Harbour")), b=text.meaningful_tokens(F.lit("a of")), c=text.cache_key(F.lit(" Dog\t")))
    assert row["a"] == ["harbour"] and row["b"] == ["a", "of"]
    assert row["c"] == "06d80eb0c50b49a509b49f2424e8c805"


def score(spark, query, facts, now=dt.datetime(2024, 2, 1)):
    import json

    m = F.lit(json.dumps(facts) if facts is not None else None).cast("string")
    points, why = metadata.score_and_reasons(query, metadata.parsed(m), now, metadata.is_empty(m))
    row = one(spark, s=points, w=why)
    column, _ = metadata.score_and_reasons(F.lit(query), metadata.parsed(m), now, metadata.is_empty(m))
    assert one(spark, s=column)[0] == pytest.approx(row["s"])  # a column of queries scores as a literal does
    return round(row["s"], 6)


RULES = [
    ("people", {}, 0.0), ("people", None, 0.0), ("people", {"width": 1}, -0.3), ("people", {"has_faces": True}, 1.5),
    ("morning", {"date_taken": "2020:01:01 11:59:00"}, 1.0), ("morning", {"date_taken": "2020:01:01 12:00:00"}, 0.0), ("afternoon", {"date_taken": "2020:01:01 12:00:00"}, 1.0),
    ("night", {"date_taken": "2020:01:01 21:00:00"}, 1.0), ("night", {"date_taken": "2020:01:01 04:59:00"}, 1.0), ("evening", {"date_taken": "2020:01:01 20:59:00"}, 1.0),
    ("2020", {"date_taken": "2020:01:05 12:00:00"}, 1.5), ("march 5", {"date_taken": "2020:03:05 12:00:00"}, 2.0), ("2020", {"date_taken": "2020:02:30 12:00:00"}, 0.0),
    ("recent", {"date_taken": "2024:01:26 00:00:00"}, 1.5), ("recent", {"date_taken": "2024:01:25 00:00:00"}, 1.0), ("recent", {"date_taken": "2024:01:03 00:00:00"}, 1.0),
    ("recent", {"date_taken": "2024:01:02 00:00:00"}, 0.0), ("recent", {"date_taken": "2025:01:02 00:00:00"}, 1.5), ("older", {"date_taken": "2023:01:31 00:00:00"}, 1.0),
    ("older", {"date_taken": "2023:02:01 00:00:00"}, 0.0), ("dark", {"iso": 800}, 1.0), ("dark", {"iso": 799}, 0.0), ("sunny", {"iso": 200}, 0.8), ("sunny", {"iso": 201}, 0.0),
    ("sunny", {"iso": 0}, 0.0), ("bokeh", {"aperture": "f/2.8"}, 1.0), ("bokeh", {"aperture": "f/2.9"}, 0.0), ("sharp", {"aperture": "f/8.0"}, 0.8), ("bokeh", {"aperture": "wide"}, 0.0),
    ("hill", {"altitude": 500.0}, 0.0), ("hill", {"altitude": 500.5}, 1.0), ("hill", {"altitude": 1000.0}, 1.0), ("hill", {"altitude": 1000.5}, 1.5), ("beach", {"altitude": 49.9}, 1.0),
    ("beach", {"altitude": 0}, 0.0), ("large", {"width": 4000, "height": 2000}, 0.0), ("large", {"width": 4050, "height": 2000}, 0.8), ("gps", {"gps_latitude": 0.0, "gps_longitude": 5.0}, 0.0),
    ("gps", {"gps_latitude": 1.0, "gps_longitude": 5.0}, 0.5), ("delhi", {"location_name": "New Delhi"}, 2.5), ("phone pixel", {"device": "Google Pixel 7"}, 2.3),
    ("desaturated", {"dominant_colors": ["red"], "color_vibrance": "vibrant"}, 1.5), ("red", {"dominant_colors": ["red"]}, 1.2), ("red", {"dominant_colors": []}, 0.0),
    ("selfie", {"face_category": "duo"}, 0.5), ("team", {"face_category": "duo"}, 0.8), ("nobody", {"has_faces": False}, 1.0), ("outdoor", {"scene_type": "unknown"}, 0.0),
    ("sky", {"scene_type": "outdoor"}, 1.0), ("flash", {"flash": "Yes"}, 1.0), ("no flash", {"flash": "No"}, 0.8), ("crisp", {"is_blurry": False, "blur_score": 200.1}, 1.5),
    ("square", {"width": 100, "height": 109}, 0.5), ("square", {"width": 100, "height": 110}, 0.0), ("vertical", {"width": 1, "height": 2}, 0.5),
]


@pytest.mark.parametrize("query,facts,want", RULES)
def test_rules(spark, query, facts, want):
    assert score(spark, query, facts) == pytest.approx(want)


def test_malformed_metadata_scores_nothing(spark):
    m = F.lit('{"width": 12, "hei')
    points, why = metadata.score_and_reasons("people", metadata.parsed(m), dt.datetime(2024, 1, 1), metadata.is_empty(m))
    assert tuple(one(spark, s=points, w=why)) == (0.0, [])


def test_hash_matches_the_two_passes(spark):
    """The closed form equals the transform made of two one-dimensional passes of real parts."""
    x = np.random.default_rng(1).random((16, 16)) * 255

    def rows_of(a):
        n = a.shape[1]
        v = np.fft.fft(np.concatenate([a, a[:, ::-1]], axis=1))[:, :n]
        k = np.arange(n)
        spun = v * np.exp(-1j * np.pi * k / (2 * n))
        return spun.real  # a true cosine transform

    m = bits.hash_matrix(16)
    k = np.arange(16)
    true = rows_of(rows_of(x).T).T
    half = 2 * np.cos(np.pi * k / 32) ** 2
    assert np.allclose(m @ x @ m.T, half[:, None] * true * half[None, :])
    assert len(bits.hash_of_grays(x)) == 32 and bits.hash_of_grays(x)[0] < 128


def test_limbs_round_trip(spark):
    value = bytes(range(200, 232))
    row = one(spark, a=bits.from_limbs(bits.limbs(F.lit(value))), b=bits.limbs(F.lit(value[:8])), d=bits.hamming(bits.limbs(F.lit(value)), bits.limbs(F.lit(bytes(32)))))
    assert bytes(row["a"]) == value and row["b"] is None and row["d"] == sum(bin(x).count("1") for x in value)


def test_vectors(spark):
    a = F.array(F.lit(3.0), F.lit(4.0))
    zero = F.array(F.lit(0.0), F.lit(0.0))
    row = one(spark, n=vec.norm(a), u=vec.unit_if_long(a), z=vec.unit_if_long(zero), p=vec.unit_padded(zero), c=vec.cosine(a, zero), ok=vec.is_vector(a, 2), no=vec.is_vector(zero), i=vec.inner_with(a, [1.0, 1.0], 0.0))
    assert row["n"] == 5.0 and row["u"] == [0.6, 0.8] and row["z"] == [0.0, 0.0] and row["p"] == [0.0, 0.0] and row["c"] is None and row["ok"] and not row["no"]
    assert row["i"] == pytest.approx(1.4)


def test_inner_with_odd_rows(spark):
    rows = spark.createDataFrame([(0, None), (1, [1.0]), (2, [1.0, None]), (3, [1.0, 2.0])], "i int, v array<double>")
    got = {r[0]: r[1] for r in rows.select("i", vec.inner_with(F.col("v"), [1.0, 1.0])).collect()}
    assert got == {0: None, 1: None, 2: None, 3: 3.0}


def test_pictures():
    green = np.zeros((8, 8, 3), "uint8")
    green[..., 1] = 200
    m = visual.measures(green)
    assert m["green"] == 1.0 and m["shares"]["green"] == 1.0 and m["blur"] == 0.0 and m["saturation"] == 255
    assert visual.fitted(2000, 1000, 640) == (640, 320) and visual.fitted(10, 10, 640) == (10, 10)
    assert visual.stretched(np.array([[10.0, 20.0]])).tolist() == [[0, 255]]


def test_facts(spark):
    row = one(
        spark, a=metadata.degrees(F.lit(10), F.lit(30), F.lit(0), F.lit("S")), b=metadata.degrees(F.lit("x"), F.lit(0), F.lit(0), F.lit("N")), c=metadata.shutter_text(F.lit(0.005)),
        d=metadata.shutter_text(F.lit(2.0)), e=metadata.aperture_text(F.lit(2.8)), f=metadata.flash_text(F.lit(17)), g=metadata.device_name(F.lit(""), F.lit("X")), h=metadata.focal_text(F.lit(4.2)),
    )
    assert tuple(row) == (-10.5, 0.0, "1/200", "2.0s", "f/2.8", "Yes", "X", "4.2mm")


def test_config():
    with pytest.raises(ValueError):
        SearchConfig(relative_threshold=1.5)
    with pytest.raises(ValueError):
        SearchConfig(max_results=0)
    assert SearchConfig().as_dict()["candidates"] == 100


def test_migration(spark):
    old = spark.createDataFrame([(1, "/a")], "id int, path string")
    new = migrated(old.withColumn("extra", F.lit(1)), PHOTOS)
    assert new.columns[:2] == ["id", "path"] and new.columns[-1] == "extra" and new.first()["metadata"] == "{}" and new.first()["is_duplicate"] == 0


def test_url_escapes_of_all_bytes(spark):
    name = "/a/" + "é ü&=+%".strip() + ".jpg"
    assert one(spark, x=canonical_path(F.lit(urllib.parse.quote(name))))[0] == name


def test_picture_measures_are_dealt_to_all_cores(spark, tmp_path):
    import datetime as dt

    from shoebox.plans.retrieval import picture_measures

    g = np.random.default_rng(4)
    data = [(i, bytearray(g.bytes(32)), dt.datetime(2024, 1, 1)) for i in range(40)]
    spark.createDataFrame(data, "id bigint, phash binary, loaded_at timestamp_ntz").coalesce(1).write.parquet(str(tmp_path / "photos.parquet"))
    found = picture_measures(spark, str(tmp_path))
    assert found.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism and found.count() == 40


def test_hues_by_tables_equal_the_formula():
    x = np.random.default_rng(5).integers(0, 256, (60, 50, 3), dtype="uint8")
    x[:20] = x[:20] // 128 * 255  # many equal channels
    got = visual.hsv_of(x)
    for (r, g, b), hsv in zip(x.reshape(-1, 3).astype(float), got.reshape(-1, 3)):
        high, span = max(r, g, b), max(r, g, b) - min(r, g, b)
        hue = 0 if not span else ((g - b) / span % 6 if high == r else (b - r) / span + 2 if high == g else (r - g) / span + 4) * 30
        assert tuple(hsv) == (np.rint(hue) % 180, np.rint(span / high * 255) if high else 0, high)
