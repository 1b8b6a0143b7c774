"""Files' own data, places, and measures of pictures."""

import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from shoebox.functions import bits, visual
from shoebox.operators import library
from shoebox.operators.places import nearest_places
from shoebox.sources import exif
from tests.test_operators import rows

FACTS = {
    "device_make": "Acme ", "device_model": "One", "software": "v1", "date_taken": "2020:02:03 04:05:06", "date_modified": "2021:01:01 00:00:00", "iso": 400, "orientation": 6, "f_number": 2.8,
    "exposure": 0.004, "focal": 35.0, "flash": 17, "lat": [10.0, 30.0, 36.0], "lat_ref": "S", "lon": [20.0, 15.0, 0.0], "lon_ref": "E", "altitude": 12.5, "gps_date": "2020:02:03", "gps_time": [4.0, 5.0, 6.0],
}


@pytest.mark.parametrize("order", ["<", ">"])
def test_tags_are_read_as_they_were_written(order):
    block = exif.tag_block(FACTS, order)
    got = exif.tagged(block)
    assert {k: v for k, v in got.items() if k != "exposure"} == {k: v for k, v in FACTS.items() if k != "exposure"} and got["exposure"] == pytest.approx(0.004)
    whole = exif.jpeg_with(block, 640, 480)
    assert exif.read(whole)["device_model"] == "One" and exif.read(whole)["width"] == 640
    for n in range(len(whole)):  # cut anywhere
        exif.read(whole[:n])
    r = random.Random(1)
    for _ in range(300):  # spoilt anywhere
        bad = bytearray(whole)
        for _ in range(4):
            bad[r.randrange(20, len(bad))] = r.randrange(256)
        exif.read(bytes(bad))


def test_formats():
    chunk = lambda name, body: struct.pack(">I4s", len(body), name) + body + b"\0" * 4
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 30, 20, 8, 6, 0, 0, 0)) + chunk(b"eXIf", exif.tag_block({"device_make": "A"})) + chunk(b"IEND", b"")
    assert exif.read(png) == {"format": "PNG", "width": 30, "height": 20, "mode": "RGBA", "device_make": "A"}
    body = b"VP8X" + struct.pack("<I", 10) + b"\0" * 4 + (29).to_bytes(3, "little") + (19).to_bytes(3, "little")
    assert exif.read(b"RIFF" + b"\0" * 4 + b"WEBP" + body) == {"format": "WEBP", "mode": "RGB", "width": 30, "height": 20}
    assert exif.read(b"GIF89a" + struct.pack("<HH", 3, 4))["width"] == 3
    assert exif.read(b"BM" + b"\0" * 16 + struct.pack("<ii", 5, -6))["height"] == 6
    assert exif.read(exif.tag_block({"width": 7, "height": 8})) == {"format": "TIFF", "width": 7, "height": 8}
    assert exif.read(None) == exif.read(b"") == exif.read(b"text") == {}


def test_metadata_of_files(spark):
    data = [(1, exif.jpeg_with(exif.tag_block(FACTS), 640, 480)), (2, b"no picture"), (3, None), (4, exif.jpeg_with(exif.tag_block({"device_make": "B"}), 1, 1)[:60])]
    df = spark.createDataFrame(data, "id int, content binary")
    got = {r["id"]: r["f"] for r in df.select("id", exif.file_metadata(exif.raw_metadata(F.col("content"))).alias("f")).collect()}
    one = got[1]
    assert one["device"] == "Acme One" and one["aperture"] == "f/2.8" and one["shutter_speed"] == "1/250" and one["focal_length"] == "35.0mm" and one["flash"] == "Yes"
    assert one["location"] == "-10.510000, 20.250000" and one["gps_altitude"] == "12.5m" and one["gps_timestamp"] == "2020:02:03 4.0:5.0:6.0" and one["mode"] == "RGB"
    assert all(v is None for i in (2, 3) for v in got[i]) and got[4]["format"] == "JPEG" and got[4]["gps_latitude"] is None


def test_nearest_places_equal_brute_force(spark):
    r = random.Random(7)
    spot = lambda: (round(r.uniform(-90, 90), 3), round(r.uniform(-180, 180), 3))
    places = [(i, *spot()) for i in range(60)] + [(60, 89.9, 10.0), (61, 89.9, 10.0), (62, 0.0, 179.99)] + [(100 + i, 48 + r.random() / 9, 11 + r.random() / 9) for i in range(40)]
    asked = [spot() for _ in range(80)] + [(90.0, -170.0), (0.0, -179.99), (48.01, 11.05)] * 2
    ball = lambda lat, lon: np.array([np.cos(np.radians(lat)) * np.cos(np.radians(lon)), np.cos(np.radians(lat)) * np.sin(np.radians(lon)), np.sin(np.radians(lat))])
    far = lambda p, q: float(((ball(*p) - ball(*q)) ** 2).sum())
    a = spark.createDataFrame([*asked, (None, 1.0), (float("nan"), 1.0), (91.0, 1.0)], "lat double, lon double")
    b = spark.createDataFrame([*places, (None, 1.0, 1.0), (7, None, 1.0), (8, 1.0, 200.0)], "place_id bigint, lat double, lon double")
    got = {(x["lat"], x["lon"]): x["place_id"] for x in nearest_places(a, b).collect()}
    assert got == {p: min(places, key=lambda q: (round(far(p, q[1:]), 15), q[0]))[0] for p in asked}
    assert nearest_places(a, b.limit(0)).count() == 0 and nearest_places(a.limit(0), b).count() == 0
    assert got[0.0, -179.99] == 62 and got[90.0, -170.0] == 60


def test_hashes_of_pictures(spark):
    g = np.random.default_rng(3)
    gray = g.integers(0, 256, (16, 16))
    same = np.repeat(gray[:, :, None], 3, axis=2)
    assert (bits.grays_of_picture(same) == gray).all()
    flat = np.full((40, 25, 3), 77)
    assert (bits.grays_of_picture(flat) == 77).all()
    weights = bits.resampling(40, 16)
    assert np.allclose(weights.sum(axis=1), 1) and all(np.count_nonzero(np.abs(w) > 1e-12) <= 15 for w in weights)
    big = np.kron(same, np.ones((9, 9, 1), "int64"))
    away = lambda a, b: (int.from_bytes(a, "big") ^ int.from_bytes(b, "big")).bit_count()
    own, other = bits.hash_of_grays(bits.grays_of_picture(big)), bits.hash_of_grays(g.integers(0, 256, (16, 16)))
    assert away(own, bits.hash_of_grays(gray)) < 30 < away(own, other)
    photos = spark.createDataFrame([(1, "/a", None), (2, "/b", bytearray(b"x" * 32)), (3, "/c", None), (4, "/d", None)], "id bigint, path string, phash binary")
    raw = bytearray(same.astype("uint8").tobytes())
    pictures = spark.createDataFrame([("/a", raw, 16, 16), ("/a", raw, 16, 16), ("/b", raw, 16, 16), ("/c", raw, 16, 15), ("/e", None, 1, 1)], "path string, pixels binary, width int, height int")
    got = {r["id"]: r["phash"] for r in library.backfill_hashes(photos, pictures).collect()}
    assert bytes(got[1]) == bits.hash_of_grays(gray) and bytes(got[2]) == b"x" * 32 and got[3] is None and got[4] is None


def test_edges_and_sizes():
    step = np.zeros((20, 20), "uint8")
    step[:, 10:] = 200
    found = visual.edges(step)
    assert found.any(axis=1).all() and found.sum() == 20 and not visual.edges(np.full((9, 9), 7, "uint8")).any()
    weak = np.zeros((20, 20), "uint8")
    weak[:, 10:] = 20  # a gradient of 80: an edge only where it hangs together with a strong one
    assert not visual.edges(weak).any()
    weak[:4, 10:] = 200
    assert visual.edges(weak).any(axis=1).sum() > 15
    assert not visual.edges(np.zeros((1, 1), "uint8")).any() and visual.edges(step.T).sum() == 20
    assert visual.resized(np.array([[0, 100]], "uint8"), 4, 1).tolist() == [[0, 25, 75, 100]]
    assert visual.scaled_to(np.zeros((10, 40, 3), "uint8"), 128).shape == (32, 128, 3) and visual.scaled_to(np.zeros((400, 1), "uint8"), 128).shape == (128, 1)
    dim = np.zeros((8, 8, 3), "uint8")
    dim[..., 2] = 180  # blue: bright by its largest part, dark by its gray
    m = visual.measures(dim)
    assert m["brightness"] == 180 and m["mean"] < 30 and m["shares"]["blue"] == 1.0


def test_equal_shares_stand_in_the_order_of_the_table(spark):
    shares = F.create_map(*[F.lit(x) for x in ("black", 0.3, "pink", 0.3, "red", 0.3, "white", 0.3, "blue", 0.01)])
    got = spark.range(1).select(visual.colors(shares, F.lit(10.0))["dominant_colors"]).first()[0]
    assert got == ["red", "pink", "white"]
    assert rows(spark.range(1).select(visual.colors(F.create_map(F.lit("red"), F.lit(0.0)), F.lit(0.0))["dominant_colors"])) == [(["mixed"],)]


def test_pictures_to_be_read(spark):
    x = np.zeros((4, 8, 3), "uint8")
    x[:, 4:] = 100
    data = [(1, bytearray(x.tobytes()), 8, 4), (2, bytearray(b"x"), 8, 4), (3, None, 8, 4), (4, bytearray(x.tobytes()), None, 4)]
    df = spark.createDataFrame(data, "id int, pixels binary, w int, h int")
    for most, size in ((640, (8, 4)), (4, (4, 2))):
        got = {r["id"]: r["g"] for r in df.select("id", visual.gray_for_text(F.col("pixels"), F.col("w"), F.col("h"), most).alias("g")).collect()}
        gray = np.frombuffer(got[1]["gray"], "uint8").reshape(size[::-1])
        assert (got[1]["width"], got[1]["height"]) == size and gray.min() == 0 and gray.max() == 255
        assert all(got[i]["gray"] is None for i in (2, 3, 4))
