import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shoebox.engine import Library
from shoebox.functions.enrich import enriched, gated
from shoebox.schemas import FACES, FEEDBACK, PERSONS, PHOTOS, migrated
from shoebox.sources.files import ResultCache
from tests.test_operators import rows


def library_of(spark):
    photos = spark.createDataFrame(
        [(1, "/a", 5, 1.0, [1.0, 0.0], bytearray(32)), (2, "/b", 9, 1.0, [1.0, 0.0], bytearray(32)), (3, "/c", 9, 1.0, [0.0, 1.0], None)],
        "id bigint, path string, size_bytes bigint, modified_time double, embedding array<float>, phash binary",
    )
    faces = spark.createDataFrame([(1, 1, None, [1.0, 0.0]), (2, 2, None, [1.0, 0.1]), (3, 3, 7, [0.0, 1.0]), (4, 3, None, [0.1, 1.0])], "id bigint, photo_id bigint, person_id bigint, embedding array<float>")
    persons = spark.createDataFrame([(7, "Ann", 3)], "id bigint, name string, representative_face_id bigint")
    log = spark.createDataFrame([], FEEDBACK)
    return Library(migrated(photos, PHOTOS), migrated(faces, FACES), migrated(persons, PERSONS), log)


def test_library(spark):
    lib = library_of(spark)
    listed = spark.createDataFrame([("/a", 1.0, 5), ("/b", 9.0, 10), ("/n", 1.0, 1), ("/z", 1.0, 1)], "path string, mtime double, size bigint")
    known = spark.createDataFrame([("/b", [0.0, 0.0]), ("/n", [1.0, 1.0]), ("/z", [0.0, 0.0])], "path string, embedding array<float>")
    after = lib.ingest(listed, known)
    assert rows(after.photos, "id", "path", "size_bytes") == [(1, "/a", 5), (2, "/b", 9), (4, "/n", 1)]
    assert rows(lib.ingest(listed).photos, "id", "path", "size_bytes") == [(1, "/a", 5), (2, "/b", 10), (4, "/n", 1), (5, "/z", 1)]
    groups = lib.find_duplicates()
    assert rows(groups) == [("exact", 1, 1), ("exact", 1, 2)]
    assert rows(lib.mark(groups).list_marked()) == [("/a", "/b")]
    less, gone = lib.delete(groups)
    assert rows(less.photos, "path") == [("/b",), ("/c",)] and rows(gone) == [("/a", "/b", "planned")]
    named = lib.cluster()
    assert rows(named.faces, "id", "person_id") == [(1, 8), (2, 8), (3, 9), (4, 9)] and rows(named.persons, "id") == [(7,), (8,), (9,)]
    assert rows(lib.cluster(reset=True).persons, "id") == [(1,), (2,)]
    assert rows(lib.assign().faces, "id", "person_id") == [(1, None), (2, None), (3, 7), (4, 7)]
    assert rows(lib.rename(7, "Bea").members_of("be")) == [("/c",)]
    assert lib.analyze("receipt").first()["intent"] == "TEXT"


def test_search_and_feedback(spark):
    lib = library_of(spark)
    now = dt.datetime(2024, 1, 1)
    assert [r["path"] for r in lib.search("xyzzy", [1.0, 0.0], now).collect()] == ["/a", "/b"]
    data = [("xyzzy", "VISUAL", 0.7, 0.2, 0.1, "/a", 1, 1.0, 0.0, 0.0, 0.7, "NEGATIVE", dt.datetime(2024, 1, 1))]
    entry = spark.createDataFrame(data, "query string, query_intent string, visual double, ocr double, metadata double, result_path string, result_rank int, v double, o double, m double, final double, feedback_type string, timestamp timestamp_ntz")
    told = lib.record(entry)
    assert told.log.first()["id"] == 1 and [r["path"] for r in told.search("xyzzy", [1.0, 0.0], now).collect()] == ["/b"]
    cache = ResultCache()
    assert lib.cached_search(cache, "xyzzy", [1.0, 0.0], now) == lib.cached_search(cache, " XYZZY", [9.0, 9.0], now)


def test_models(spark):
    files = spark.createDataFrame([("/a", bytearray(b"12")), ("/b", bytearray(b"")), ("/c", bytearray(b"bad"))], "path string, content binary")

    def load():
        def model(contents):
            if any(bytes(c) == b"bad" for c in contents):
                raise ValueError("bad")
            return [{"size": len(c)} if c else None for c in contents]

        return model

    schema = T.StructType([T.StructField("size", T.IntegerType())])
    assert rows(enriched(files, load, schema)) == [("/a", 2, None), ("/b", None, "unreadable"), ("/c", None, "ValueError: bad")]
    photos = files.select("path")
    assert rows(gated(photos, F.col("path") == "/a", files, load, schema)) == [("/a", 2), ("/b", None), ("/c", None)]
    with pytest.raises(Exception):
        enriched(files.drop("content"), load, schema).collect()
