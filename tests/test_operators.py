import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shoebox.config import SearchConfig
from shoebox.operators import dedup, feedback, library, people, search
from shoebox.operators.graph import components, groups, numbered
from shoebox.operators.hamming import near_hash_pairs
from shoebox.operators.orphans import find_orphans, number_key, orphans_by_period, text_key
from shoebox.operators.similarity import approximate_pairs, cosine_pairs, least_marks, nearest, neighbour_counts, top_similar
from shoebox.sources.files import ResultCache, VectorIndex, batches, cache_rows, listing, save_snapshot, with_cached_vectors
from shoebox.session import cut, release
from shoebox.sources.tables import current


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect() if columns else df.collect()), key=str)


def union_find(edges):
    root = {}

    def top(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = top(a), top(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    return {(x, top(x)) for x in list(root)}


# --- current rows --------------------------------------------------------------------------------------------------


def test_current_takes_the_latest_version_with_its_nulls(spark):
    t = lambda n: dt.datetime(2024, 1, n)
    df = spark.createDataFrame([(1, "a", t(1)), (1, None, t(2)), (1, None, t(2)), (2, "b", None), (None, "c", t(1))], "id bigint, x string, loaded_at timestamp_ntz")
    assert rows(current(df, "x")) == [(1, None, t(1)), (2, "b", None)]
    assert rows(current(df.limit(0), "x")) == []


# --- orphans -------------------------------------------------------------------------------------------------------

T = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(days=n)
REF, PARENT = "ref_field string, target int, key {0}, ref_id bigint, ref_time timestamp_ntz, extra int", "target int, key {0}, first_loaded timestamp_ntz"


def brute_orphans(refs, parents):
    first = {}
    for target, key, at in parents:
        if key is not None:
            at = dt.datetime.min if at is None else at
            first[target, key] = min(first.get((target, key), at), at)
    out = []
    for field, target, key, id_, at, _ in refs:
        if key is None:
            continue
        known = first.get((target, key))
        if known is None:
            out.append((field, id_, "missing"))
        elif at is not None and known > at:
            out.append((field, id_, "later"))
    return sorted(out, key=str)


@pytest.mark.parametrize("kind,key,make", [("bigint", number_key, lambda r: r.randrange(60)), ("string", text_key, lambda r: f"/p/{r.randrange(60)}")])
def test_orphans_equal_brute_force(spark, kind, key, make):
    r = random.Random(5)
    refs = [("f", r.randrange(2), r.choice([make(r), make(r), make(r), None]), i, r.choice([T(r.randrange(9)), None]), 1) for i in range(400)]
    refs += [("hot", 0, make(random.Random(1)), 1000 + i, T(4), 1) for i in range(300)] + refs[:20]
    parents = [(r.randrange(2), make(r), r.choice([T(r.randrange(9)), None])) for _ in range(50)] + [(0, None, T(1))]
    a = key(spark.createDataFrame(refs, REF.format(kind)), "key")
    b = key(spark.createDataFrame(parents, PARENT.format(kind)), "key")
    if kind == "string":
        a, b = a.where("key is not null"), b.where("key is not null")
    got = find_orphans(a, b, per_range=7, chunk=50)
    assert rows(got, "ref_field", "ref_id", "reason") == brute_orphans(refs, parents)
    whole = orphans_by_period(got, a)
    assert sum(x["orphans"] for x in whole.collect()) == len(brute_orphans(refs, parents))


def test_orphans_of_empty_tables(spark):
    refs = number_key(spark.createDataFrame([("f", 0, 5, 1, T(1), 0)], REF.format("bigint")), "key")
    parents = number_key(spark.createDataFrame([], PARENT.format("bigint")), "key")
    assert rows(find_orphans(refs, parents), "ref_id", "reason") == [(1, "missing")]
    assert rows(find_orphans(refs.limit(0), parents)) == []
    assert rows(orphans_by_period(find_orphans(refs.limit(0), parents), refs.limit(0))) == []


def test_removed_parents_are_told_from_those_never_stored(spark):
    refs = [("f", 0, k, i, T(5), 0) for i, k in enumerate([1, 2, 3, 3, 4, None])] + [("f", 0, 2, 9, None, 0)]
    a = number_key(spark.createDataFrame(refs, REF.format("bigint")), "key")
    b = number_key(spark.createDataFrame([(0, 1, T(1)), (0, 4, T(9))], PARENT.format("bigint")), "key")
    gone = number_key(spark.createDataFrame([(0, 2), (0, 1), (0, 2), (0, 4), (1, 3), (0, None)], "target int, key bigint"), "key")
    got = find_orphans(a, b, gone, per_range=1, chunk=2)
    want = [(1, "removed"), (2, "missing"), (3, "missing"), (4, "later"), (9, "removed")]
    assert rows(got, "ref_id", "reason") == want
    assert sum(x["removed"] for x in orphans_by_period(got, a).collect()) == 2
    text = lambda data: text_key(spark.createDataFrame(data, REF.format("string")), "key").where("key is not null")
    b = text_key(spark.createDataFrame([], PARENT.format("string")), "key")
    gone = text_key(spark.createDataFrame([(0, "/x")], "target int, key string"), "key")
    assert rows(find_orphans(text([("g", 0, "/x", 1, T(1), 0), ("g", 0, "/y", 2, T(1), 0)]), b, gone), "ref_id", "reason") == [(1, "removed"), (2, "missing")]


def test_written_tables_are_released(spark):
    release(spark)
    df = cut(spark.range(5))
    assert df.count() == 5 and release(spark) == 1 and release(spark) == 0
    with pytest.raises(Exception):
        df.count()


# --- graphs --------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("seed", range(3))
def test_components_equal_union_find(spark, seed):
    r = random.Random(seed)
    edges = [(r.randrange(80), r.randrange(80)) for _ in range(60)] + [(i, i + 1) for i in range(100, 160)] + [(200, i) for i in range(201, 260)] + [(5, 5)]
    df = spark.createDataFrame([*edges, (None, 3)], "a bigint, b bigint")
    assert set(map(tuple, components(df).collect())) == union_find(edges)


def test_groups_are_numbered(spark):
    df = spark.createDataFrame([(7, 9), (3, 4), (4, 5), (1, 1)], "a bigint, b bigint")
    assert rows(groups(df)) == [(3, 3, 0), (4, 3, 0), (5, 3, 0), (7, 7, 1), (9, 7, 1)]
    assert rows(groups(df.limit(0))) == []
    assert rows(numbered(spark.range(5, 300).withColumnRenamed("id", "x").repartition(7), "x", "n"), "x", "n")[:2] == [(10, 5), (100, 95)]


def hashes(r, n):
    base = [r.getrandbits(256) for _ in range(max(1, n // 4))]
    out = []
    for _ in range(n):
        h = r.choice(base)
        for _ in range(r.randrange(14)):
            h ^= 1 << r.randrange(256)
        out.append(h.to_bytes(32, "big"))
    return out


@pytest.mark.parametrize("small,block", [(64, 1024), (2, 4)])
def test_near_hashes_equal_all_pairs(spark, small, block):
    values = sorted(set(hashes(random.Random(3), 120)))
    near = {(i, j): bin(int.from_bytes(values[i], "big") ^ int.from_bytes(values[j], "big")).count("1") for i in range(len(values)) for j in range(i + 1, len(values))}
    near = {p: n for p, n in near.items() if n <= 10}
    df = spark.createDataFrame([(i, bytearray(v)) for i, v in enumerate(values)], "id bigint, hash binary")
    got = {(a, b): n for a, b, n in near_hash_pairs(df, 10, small, block).collect()}
    assert set(got.items()) <= set(near.items())
    assert union_find(got) == union_find(near)
    if small == 64:
        assert got == near
    assert near_hash_pairs(df.limit(0), 10).count() == 0


@pytest.mark.parametrize("small,block", [(64, 50), (64, 1024)])
def test_crowded_buckets_give_all_near_pairs(spark, small, block):
    r = random.Random(4)
    alike = {bytes(32)} | {(1 << r.randrange(256) | 1 << r.randrange(256)).to_bytes(32, "big") for _ in range(90)}
    values = sorted(alike | set(hashes(r, 60)))
    apart = lambda i, j: bin(int.from_bytes(values[i], "big") ^ int.from_bytes(values[j], "big")).count("1")
    near = sorted((i, j, apart(i, j)) for i in range(len(values)) for j in range(i + 1, len(values)) if apart(i, j) <= 10)
    df = spark.createDataFrame([(i, bytearray(v)) for i, v in enumerate(values)], "id bigint, hash binary")
    assert sorted(rows(near_hash_pairs(df, 10, small, block))) == near
    forest = {(a, b) for a, b, _ in near_hash_pairs(df, 10, small, block, forest=True).collect()}
    assert len(forest) < len(near) and union_find(forest) == union_find([(a, b) for a, b, _ in near])


# --- similarity ----------------------------------------------------------------------------------------------------


def test_cosine_pairs_equal_all_pairs(spark):
    g = np.random.default_rng(2)
    x = g.normal(size=(90, 8))
    data = [(i, [float(v) for v in row]) for i, row in enumerate(x)] + [(100, None), (101, [0.0] * 8), (102, [float("nan")] * 8)]
    df = spark.createDataFrame(data, "id bigint, vector array<double>")
    u = x / np.linalg.norm(x, axis=1)[:, None]
    want = {(i, j) for i in range(90) for j in range(i + 1, 90) if u[i] @ u[j] >= 0.6}
    assert {(a, b) for a, b, _ in cosine_pairs(df, 0.6, block=20).collect()} == want
    assert union_find({(a, b) for a, b, _ in cosine_pairs(df, 0.6, forest=True, block=20).collect()}) == union_find(want)
    best = sorted(((-(u[i] @ u[0]), i) for i in range(90)))[:5]
    assert [r["id"] for r in top_similar(df, list(x[0]), 5).collect()] == [i for _, i in best]
    assert cosine_pairs(df.limit(0), 0.6).count() == 0
    other = spark.createDataFrame([(i, [1.0] * (4 + i % 2)) for i in range(200, 204)], "id bigint, vector array<double>")
    both = {(a, b) for a, b, _ in cosine_pairs(df.union(other), 0.6, block=20).collect()}
    assert both == want | {(200, 202), (201, 203)}
    top = {r["id"]: r["other"] for r in nearest(df.union(other), 1, 0.6, block=20).collect()}
    assert {k: v for k, v in top.items() if k < 100} == {i: max((j for j in range(90) if j != i), key=lambda j: (u[i] @ u[j], -j)) for i in {x for p in want for x in p}}
    assert top[200] == 202 and nearest(df.limit(0), 3, 0.6).count() == 0
    n = {i: sum(i in p for p in want) for i in range(90)}
    assert {(r["id"], r["n"]) for r in neighbour_counts(df, 0.6, block=20).collect()} == {(i, k) for i, k in n.items() if k}
    marked = df.withColumn("mark", F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(-1))
    near = {i: min((j for p in want for j in p if i in p and j != i and j % 3 == 0), default=None) for i in range(90) if i % 3}
    assert dict(least_marks(marked, 0.6, block=20).collect()) == {i: j for i, j in near.items() if j is not None}


def test_approximate_pairs_reach_their_recall(spark):
    g = np.random.default_rng(3)
    x = g.normal(size=(400, 128))
    x[200:] = x[:200] + 0.45 * g.normal(size=(200, 128))
    x[:40] = x[0] + 0.3 * g.normal(size=(40, 128))  # more alike than one block holds
    u = x / np.linalg.norm(x, axis=1)[:, None]
    data = [(i, [float(v) for v in row]) for i, row in enumerate(x)] + [(900, None), (901, [0.0] * 128), (902, [1.0] * 3)]
    df = spark.createDataFrame(data, "id bigint, vector array<float>")
    want = {(i, j) for i in range(400) for j in range(i + 1, 400) if u[i] @ u[j] >= 0.9}
    found = {(a, b) for a, b, _ in approximate_pairs(df, 0.9, block=16).collect()}
    assert len(want) > 700 and found <= want and len(found) >= 0.95 * len(want)
    linked = {(a, b) for a, b, _ in approximate_pairs(df, 0.9, block=16, forest=True).collect()}
    assert linked <= want and union_find(linked) == union_find(found)
    assert approximate_pairs(df.limit(0), 0.9).count() == 0


# --- duplicates ----------------------------------------------------------------------------------------------------


def photo(i, path, size, value, vector):
    return i, path, size, bytearray(value), vector


def test_duplicates(spark):
    a, b = bytes(32), bytes([255] * 32)
    near = bytes(31) + b"\x07"
    v, w = [1.0, 0.0], [0.0, 1.0]
    data = [photo(1, "/a", 5, a, v), photo(2, "/b", 5, a, v), photo(3, "/c", 9, near, v), photo(4, "/d", None, b, w), photo(5, "/e", 1, bytes([240] * 32), [0.05, 1.0]), photo(6, "/f", 1, bytes([15] * 32), [-1.0, 0.0])]
    df = spark.createDataFrame(data, "id bigint, path string, size_bytes bigint, phash binary, embedding array<double>")
    found = dedup.find_duplicates(df)
    assert rows(found) == [("exact", 1, 1), ("exact", 1, 2), ("exact", 1, 3), ("semantic", 4, 4), ("semantic", 4, 5)]
    assert rows(dedup.representatives(found, df)) == [(1, "/c", 2, 3), (4, "/e", 1, 2)]
    assert rows(dedup.marks(found, df)) == [("/a", "/c"), ("/b", "/c"), ("/d", "/e")]
    assert rows(dedup.least_distance(found, dedup.hash_links(df))) == [(1, 0), (4, 0)]
    assert rows(dedup.summary(found)) == [(2, 3)]
    tie = dedup.representatives(spark.createDataFrame([(1, 1), (1, 2)], "component bigint, id bigint"), df)
    assert rows(tie) == [(1, "/b", 1, 2)]
    assert rows(dedup.find_duplicates(df, use_embedding=False), "id") == [(1,), (2,), (3,)]
    assert rows(dedup.find_duplicates(df.limit(0))) == []


# --- people --------------------------------------------------------------------------------------------------------


def test_people(spark):
    faces = spark.createDataFrame(
        [(1, 10, 1, [1.0, 0.0], 0.9), (2, 10, 1, [0.0, 1.0], 0.9), (3, 11, None, [1.0, 1.0], 0.9), (4, 12, None, [-1.0, 0.0], 0.4), (5, 99, 2, [0.0, 0.0], 0.9)],
        "id bigint, photo_id bigint, person_id bigint, embedding array<double>, det_score double",
    )
    persons = spark.createDataFrame([(1, "Anna Dal", 1), (2, None, 5), (3, "Dalia", None)], "id bigint, name string, representative_face_id bigint")
    photos = spark.createDataFrame([(10, "/x"), (11, "/y")], "id bigint, path string")
    assert rows(people.person_counts(persons, faces), "id", "face_count") == [(1, 2), (2, 1), (3, 0)]
    assert [r["id"] for r in people.find_person(persons, faces, "dal").collect()] == [1]
    assert [r["id"] for r in people.find_person(persons, faces, "3").collect()] == [3]
    assert people.find_person(persons, faces, "nobody").count() == 0
    assert rows(people.photos_of(persons.where("id = 1"), faces, photos)) == [("/x",)]
    assert rows(people.faces_of(photos, faces, persons), "face_id", "name") == [(1, "Anna Dal"), (2, "Anna Dal"), (3, None)]
    centres = people.centroids(faces)
    half = 2**-0.5
    got = {r["person_id"]: r["centroid"] for r in centres.collect()}
    assert got[1] == pytest.approx([half, half]) and got[2] == [0.0, 0.0]
    assigned = {r["id"]: (r["person_id"], r["distance"]) for r in people.assign(faces.where("person_id is null"), centres).collect()}
    assert assigned[3][0] == 1 and assigned[3][1] == pytest.approx(0, abs=1e-9) and assigned[4] == (None, None)
    assert rows(people.usable_faces(faces), "id") == [(1,), (2,), (3,)]
    assert rows(people.cluster(faces)) == [(1, 0), (2, 0), (3, 0), (4, -1), (5, -1)]
    assert rows(people.density_clusters(faces)) == [(1, 0), (2, 0), (3, 0), (4, -1), (5, -1)]
    new, owners = people.new_persons(people.cluster(faces), 10, 5.0)
    assert rows(new, "id", "representative_face_id") == [(10, 1)] and rows(owners) == [(1, 10), (2, 10), (3, 10)]
    assert rows(people.cluster(faces.limit(1))) == [(1, -1)] and rows(people.cluster(faces.limit(0))) == []


def test_assign_by_blocks_and_density_of_three(spark):
    g = np.random.default_rng(8)
    x, c = g.normal(size=(60, 6)), g.normal(size=(23, 6))
    c[7] = c[3]  # a tie
    u, v = (m / np.linalg.norm(m, axis=1)[:, None] for m in (x, c))
    faces = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)] + [(90, None), (91, [0.0] * 6), (92, [1.0] * 4)], "id bigint, embedding array<double>")
    centres = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(v)] + [(None, v[0].tolist())], "person_id bigint, centroid array<double>")
    want = {i: int((1 - u[i] @ v.T).round(9).argmin()) for i in range(60) if (1 - u[i] @ v.T).min() < 0.3}
    for sent in (100, 5):
        found = {r["id"]: r["person_id"] for r in people.assign(faces, centres, 0.3, sent=sent, block=25).collect()}
        assert {i: p for i, p in found.items() if p is not None} == want and 90 not in found and found[92] is None
    assert people.assign(faces, centres.limit(0), 0.3).where("person_id is not null").count() == 0
    near = u @ u.T >= 1 - 0.2
    core = near.sum(axis=1) >= 3
    label = {r["id"]: r["label"] for r in people.density_clusters(faces.where("id < 60"), 0.2, 3).collect()}
    assert {i for i in label if label[i] >= 0} == {i for i in range(60) if core[i] or (near[i] & core).any()}
    for i in range(60):
        if label[i] >= 0 and not core[i]:
            assert label[i] == min(label[j] for j in range(60) if near[i, j] and core[j])


# --- snapshots -----------------------------------------------------------------------------------------------------


def test_snapshots(spark):
    photos = spark.createDataFrame([(1, "/a/x.jpg", "x.jpg", 5, 10.0), (2, "/a/y.jpg", "y.jpg", 6, 20.0), (3, "/b/z.jpg", "z.jpg", None, 30.0)], "id bigint, path string, filename string, size_bytes bigint, modified_time double")
    listed = spark.createDataFrame([("/a/x.jpg", 11.0, 5), ("/a/y.jpg", 21.5, 6), ("/a/n.jpg", 1.0, 1)], "path string, mtime double, size bigint")
    status = {r["path"]: r["status"] for r in library.diff(listed, photos).collect()}
    assert status == {"/a/x.jpg": "unchanged", "/a/y.jpg": "modified", "/a/n.jpg": "new", "/b/z.jpg": "deleted"}
    assert "/b/z.jpg" not in {r["path"] for r in library.diff(listed, photos, within="/a").collect()}
    more = library.insert(photos, spark.createDataFrame([("/a/x.jpg", 1), ("/c/new.png", 2), ("/b/other.png", 3)], "path string, size_bytes bigint"))
    assert rows(more.where("id > 3"), "id", "path", "filename", "size_bytes") == [(4, "/b/other.png", "other.png", 3), (5, "/c/new.png", "new.png", 2)]
    changed = library.update(photos, spark.createDataFrame([("/a/x.jpg", None), ("/q", 7)], "path string, size_bytes bigint"), "path", ["size_bytes"])
    assert rows(changed, "id", "size_bytes") == [(1, None), (2, 6), (3, None)]
    assert rows(library.remove(photos, photos.where("id = 2").select("path"), "path"), "id") == [(1,), (3,)]
    assert [r["id"] for r in library.by_ids(photos, [3, 9, 1, 3]).collect()] == [3, 1, 3]


# --- feedback and search -------------------------------------------------------------------------------------------


def log_of(spark, kinds, weights='{"visual": 0.0, "ocr": 0.1, "metadata": 0.1}'):
    data = [(i, "q", "VISUAL", weights, "/p", 1, "{}", k, dt.datetime(2024, 1, 1 + i)) for i, k in enumerate(kinds)]
    return spark.createDataFrame(data, "id bigint, query string, query_intent string, weights_used string, result_path string, result_rank int, result_scores string, feedback_type string, timestamp timestamp_ntz")


def test_learning(spark):
    few = {r["preset"]: r for r in feedback.learned_weights(log_of(spark, ["CLICKED", "IGNORED", "IGNORED", "IGNORED"])).collect()}
    assert not any(r["learned"] for r in few.values())
    enough = {r["preset"]: r for r in feedback.learned_weights(log_of(spark, ["CLICKED", "IGNORED", "IGNORED", "IGNORED", "IGNORED"])).collect()}
    assert enough["visual_dominant"]["visual"] == pytest.approx(0.65) and not enough["fallback"]["learned"]
    assert feedback.learning_data(log_of(spark, ["CLICKED"] * 5, "cut {")).first()["visual"] is None
    assert feedback.stats(log_of(spark, [None, "CLICKED"])).where("by = 'total'").first()["n"] == 2
    assert feedback.recent_queries(log_of(spark, ["CLICKED"] * 12)).count() == 10


THRESHOLDS = [
    ([1.0, 0.95, 0.80], 2), ([1.0, 0.96, 0.92, 0.88, 0.84, 0.80, 0.76, 0.72, 0.68], 8), ([-0.1, -0.2], 1), ([1.0] * 60, 50), ([], 0), ([0.0] * 3, 3), ([5.0], 1),
]


@pytest.mark.parametrize("scores,n", THRESHOLDS)
def test_threshold(spark, scores, n):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(scores)], "id bigint, score double")
    assert search.kept(df).count() == n


def test_search(spark):
    photos = spark.createDataFrame(
        [(1, "/a", [1.0, 0.0], "total amount", "{}"), (2, "/b", [1.0, 0.0], "", '{"width": 1}'), (3, "/c", [0.0, 1.0], None, None), (4, "/d", None, "total", "{}"), (5, "/e", [0.0, 0.0], "total", "x{")],
        "id bigint, path string, embedding array<double>, ocr_text string, metadata string",
    )
    log = log_of(spark, ["NEGATIVE"]).withColumn("result_path", F.lit("/a")).withColumn("query", F.lit("total"))
    found = search.search(photos, log, "total", [1.0, 0.0], dt.datetime(2024, 1, 1)).collect()
    assert [r["path"] for r in found] == ["/a"]
    assert found[0]["score"] == pytest.approx((1.0 * 0.7 + 1.0 * 0.2) * 0.88) and found[0]["penalty"] == 0.88
    line = search.report_lines(search.search(photos, log, "total", [1.0, 0.0], dt.datetime(2024, 1, 1))).first()["line"]
    assert line.startswith("[1] Score: 0.7920 (Visual + OCR Text)") and "Downranked" in line
    assert search.search(photos.limit(0), log, "total", [1.0, 0.0], dt.datetime(2024, 1, 1)).count() == 0


def test_boost_of_a_negative_score_lowers_it(spark):
    results = spark.createDataFrame([(1, "/p", -0.1)], "id bigint, path string, score double")
    assert search.with_feedback(results, log_of(spark, ["POSITIVE"]), "q").first()["score"] == pytest.approx(-0.106)


# --- sources -------------------------------------------------------------------------------------------------------


def test_files(spark, tmp_path):
    for name in ("a.JPG", "sub/b.png", "c.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"12345")
    found = listing(spark, str(tmp_path))
    assert sorted(r["path"].rsplit("/", 1)[1] for r in found.collect()) == ["a.JPG", "b.png"] and found.first()["size"] == 5
    save_snapshot(spark.range(3), str(tmp_path / "t"), 1)
    with pytest.raises(Exception):
        save_snapshot(spark.range(3), str(tmp_path / "t"), 1)
    assert [len(b) for b in batches(spark.range(25), 10)] == [10, 10, 5]
    photos = spark.createDataFrame([(1, [3.0, 4.0]), (2, None), (3, [0.0, 0.0])], "id bigint, embedding array<double>")
    index = VectorIndex(spark, str(tmp_path / "index"))
    assert rows(index.load_or_build(photos), "id") == [(1,), (3,)] and index.size() == 2
    index.add(photos.unionByName(spark.createDataFrame([(4, [1.0, 0.0])], "id bigint, embedding array<double>")))
    assert index.size() == 3 and index.load_or_build(photos).count() == 2


def test_caches(spark):
    cache = cache_rows(spark.createDataFrame([(" Dog", [1.0]), ("dog", [1.0])], "query string, embedding array<double>"))
    assert cache.count() == 1
    hit = with_cached_vectors(spark.createDataFrame([("DOG ",), ("cat",)], "query string"), cache)
    assert rows(hit, "query", "embedding") == [("DOG ", [1.0]), ("cat", None)]
    now = [0.0]
    kept = ResultCache(most=2, ttl=10, clock=lambda: now[0])
    for q in "abc":
        kept.set(q, q)
    assert kept.get("a") is None and kept.get(" B ") == "b"
    kept.set("d", "d")
    assert kept.get("c") is None and kept.get("b") == "b"
    now[0] = 10.0
    assert kept.get("b") == "b"
    now[0] = 10.1
    assert kept.get("b") is None and kept.stats()["entries"] == 1


def test_config_is_shared_by_nobody():
    assert SearchConfig().presets is not SearchConfig().presets


# --- stored blocks -------------------------------------------------------------------------------------------------


def _crowd(n: int = 400, dims: int = 96) -> np.ndarray:
    """Vectors of which some are near the limit of 0.6, many are alike and most are far from all."""
    g = np.random.default_rng(11)
    x = g.normal(size=(n, dims))
    x[: n // 4] = x[0] + 0.5 * g.normal(size=(n // 4, dims))  # one crowd
    for k in range(n // 4, n // 2, 2):
        x[k + 1] = x[k] + 1.33 * g.normal(size=dims)  # cosines around 0.6
    return x.astype("float32")


def test_vectors_are_stored_once_whatever_the_number_of_blocks(spark):
    x = _crowd()
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id bigint, vector array<float>")
    u = x.astype("float64") / np.linalg.norm(x.astype("float64"), axis=1)[:, None]
    want = {(i, j) for i, j in zip(*np.nonzero(np.triu(u @ u.T >= 0.6, 1)))}
    assert 3000 < len(want)
    pairs = cosine_pairs(df, 0.6, block=16)
    assert "Exchange" not in pairs._jdf.queryExecution().toString()  # before, each vector was sent once for each block
    got = {(r["a"], r["b"]): r["cosine"] for r in pairs.collect()}
    assert set(got) == want and all(abs(v - u[a] @ u[b]) < 1e-12 for (a, b), v in got.items())
    forest = {(r["a"], r["b"]) for r in cosine_pairs(df, 0.6, forest=True, block=16).collect()}
    assert forest <= want and union_find(forest) == union_find(want)


def test_stored_vectors_less_some_are_as_if_never_stored(spark):
    from shoebox.operators.blocks import store, without
    from shoebox.operators.similarity import near_pairs

    x = _crowd(120)
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)] + [(500, None), (501, [0.0] * 96)], "id bigint, vector array<float>")
    blocks = store(df, 16)
    assert sorted(r["id"] for r in blocks.rows.collect()) == [*range(120), 500, 501] and sum(n for _, _, n in blocks.files) == 120
    gone = df.where("id % 3 = 0 or id between 31 and 70 or id = 500").select("id")
    kept = sorted((r["a"], r["b"]) for r in near_pairs(without(blocks, gone), 0.6).collect())
    assert kept == sorted((r["a"], r["b"]) for r in cosine_pairs(df.join(gone, "id", "left_anti"), 0.6, block=16).collect())


def test_faces_of_one_person_give_about_a_link_each_however_many_blocks_they_fill(spark, monkeypatch):
    from shoebox.operators import blocks

    given = []
    monkeypatch.setattr(blocks, "MOST_BLOCKS", 1)
    monkeypatch.setattr(people, "groups", lambda edges: given.append(cut(edges)) or groups(given[-1]))
    n = 20_000
    one = F.array(F.lit(1.0), *[(F.rand(k) / 10) for k in range(7)]).cast("array<float>")
    faces = spark.range(0, n, 1, 8).select("id", one.alias("embedding")).union(spark.createDataFrame([(n, [0.0] * 7 + [1.0]), (n + 1, None)], "id bigint, embedding array<float>"))
    label = {(r["label"], r["n"]) for r in people.cluster(faces).groupBy("label").agg(F.count("*").alias("n")).collect()}
    assert label == {(0, n), (-1, 2)}
    assert n - 1 <= given[0].count() < 2 * n + 8192  # before, one for each face and group of blocks


@pytest.mark.parametrize("pivots", [1, 7, 64, 8192])
def test_links_connect_what_all_pairs_connect(spark, pivots):
    from shoebox.operators.blocks import store
    from shoebox.operators.similarity import links

    x = _crowd()
    u = x.astype("float64") / np.linalg.norm(x.astype("float64"), axis=1)[:, None]
    want = {(i, j) for i, j in zip(*np.nonzero(np.triu(u @ u.T >= 0.6, 1)))}
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)] + [(500, None), (501, [0.0] * 96), (502, [1.0, 0.0]), (503, [2.0, 0.0])], "id bigint, vector array<float>")
    got = {(min(r["a"], r["b"]), max(r["a"], r["b"])) for r in links(store(df, 16), 0.6, pivots=pivots).collect()}
    assert got <= want | {(502, 503)} and union_find(got) == union_find(want | {(502, 503)})


def test_of_equal_faces_one_is_compared_and_all_are_linked(spark, monkeypatch):
    from shoebox.operators import similarity

    x = np.append(_crowd(), -_crowd()[:1], axis=0)  # the last one is like none, but for its copies
    u = x.astype("float64") / np.linalg.norm(x.astype("float64"), axis=1)[:, None]
    near = {(i, j) for i, j in zip(*np.nonzero(np.triu(u @ u.T > 0.5, 1)))}
    n, compared, over = len(x), [], similarity.over_pairs
    faces = spark.createDataFrame([(i + n * k, [float(v) for v in row]) for k in range(13) for i, row in enumerate(x)] + [(99_000, None), (99_001, [0.0] * 96)], "id bigint, embedding array<float>")
    monkeypatch.setattr(similarity, "over_pairs", lambda blocks, *a: compared.append(sum(m for _, _, m in blocks.files)) or over(blocks, *a))
    got = {r["id"]: r["label"] for r in people.cluster(faces, 0.5).collect()}
    assert compared == [n]  # before, all 13 copies
    edges = near | {(i, i + n * k) for i in range(n) for k in range(1, 13)}
    root = dict(union_find(edges))
    number = {r: k for k, r in enumerate(sorted(set(root.values())))}
    assert got == {i: number[r] for i, r in root.items()} | {99_000: -1, 99_001: -1}


def test_current_rows_of_wide_columns(spark, monkeypatch):
    from shoebox.sources import tables

    t = [dt.datetime(2024, 1, k) for k in range(1, 5)]
    given = [(1, [1.0], t[0]), (2, [2.0], t[1]), (2, None, t[2]), (3, [3.0], None), (3, [4.0], t[0]), (4, None, t[3]), (None, [5.0], t[0]), (5, [6.0], t[1]), (5, [7.0], t[1])]
    df = spark.createDataFrame(given, "id bigint, v array<float>, loaded_at timestamp")
    want = rows(current(df, "v").select("id", "v"))
    assert rows(tables.current_wide(df, "v")) == want and len(want) == 5
    monkeypatch.setattr(tables, "SENT", 0)
    assert rows(tables.current_wide(df, "v")) == want


def test_cluster_faces_shuffles_only_vectors_of_repeated_ids(spark, monkeypatch):
    from shoebox.plans import retrieval
    from shoebox.sources import tables

    given, folder = [], "/root/testdata/sf0.001"
    monkeypatch.setattr(tables, "current", lambda df, *a, **k: given.append(df) or current(df, *a, **k))
    assert retrieval.cluster_faces(spark, folder).count() == spark.read.parquet(f"{folder}/faces.parquet").where("id is not null").select("id").distinct().count()
    ids = [r["id"] for r in spark.read.parquet(f"{folder}/faces.parquet").select("id").collect()]
    assert len(given) == 1 and given[0].count() == sum(ids.count(i) > 1 for i in ids)  # before, the rows of all ids
