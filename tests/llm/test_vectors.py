import numpy as np
import pytest

from shoebox.llm.clusters import hashed_features, similarity_clusters, typical_members
from shoebox.llm import neighbours
from shoebox.llm.neighbours import plan, similar_pairs
from tests.test_operators import rows

SCHEMA = "id bigint, version bigint, vector array<float>, cosine double"


def frame(spark, vectors, start=0):
    return spark.createDataFrame([(start + i, 1, None if v is None else [float(x) for x in v], 0.0) for i, v in enumerate(vectors)], SCHEMA)


def planted(seed, people, each, dims=512, noise=0.6):
    g = np.random.default_rng(seed)
    out, label = [], []
    for p in range(people):
        centre = g.normal(size=dims)
        centre /= np.linalg.norm(centre)
        for _ in range(each if np.isscalar(each) else each[p]):
            x = centre + noise * g.normal(size=dims) / np.sqrt(dims)
            out.append(x * g.uniform(0.2, 9))
            label.append(p)
    return np.array(out), label


def brute(x, least, k):
    u = x / np.linalg.norm(x, axis=1)[:, None]
    s = np.round(u @ u.T, 9)
    np.fill_diagonal(s, -2)
    out = set()
    for i in range(len(x)):
        for j in sorted(range(len(x)), key=lambda j: (-s[i, j], j))[:k]:
            if s[i, j] >= least:
                out.add((min(i, j), max(i, j)))
    return out


def test_pairs_are_those_of_brute_force(spark):
    x, _ = planted(1, 120, 3, noise=0.25)
    x = np.concatenate([x, np.random.default_rng(2).normal(size=(200, 512))])
    df = frame(spark, x)
    want = brute(x, 0.9, 10)
    for settings in ({}, {"shard_rows": 64}):
        got = {(r["id_a"], r["id_b"]) for r in similar_pairs(df, **settings).collect()}
        assert got <= want and len(got) >= 0.98 * len(want)


@pytest.mark.parametrize("shard", [40, 1000])
def test_relax_one_is_exact(spark, shard):
    """Even where relaxed pruning would lose pairs: few dimensions, a wide radius."""
    x = np.random.default_rng(4).normal(size=(150, 6))
    got = similar_pairs(frame(spark, x), least=0.7, dims=6, relax=1, k=200, shard_rows=shard)
    assert {(r["id_a"], r["id_b"]) for r in got.collect()} == brute(x, 0.7, 200)
    few = similar_pairs(frame(spark, x), least=0.7, dims=6, relax=1, k=3, shard_rows=shard)
    assert {(r["id_a"], r["id_b"]) for r in few.collect()} == brute(x, 0.7, 3)


@pytest.mark.parametrize("settings", [{}, {"shard_rows": 300}])
def test_dense_groups_keep_their_nearest(spark, settings):
    """Far more near candidates than 8k for each vector, in one task and over pairs of blocks; and rescaled copies."""
    x, _ = planted(12, 1, 900, noise=0.25)
    x = np.concatenate([x, x[:3] * 1.7, x[3:150] * 0.3, np.random.default_rng(13).normal(size=(20, 512))])
    x = x.astype("float32").astype("float64")
    u = x / np.linalg.norm(x, axis=1)[:, None]
    s = u @ u.T
    np.fill_diagonal(s, -2)
    tenth = np.sort(s, axis=1)[:, -10]
    got = {(r["id_a"], r["id_b"]) for r in similar_pairs(frame(spark, x), **settings).collect()}
    # rescaled copies differ by the rounding of float32: whichever of equals comes out is right
    sure = {(min(i, j), max(i, j)) for i, j in zip(*np.nonzero((s > tenth[:, None] + 1e-6) & (s >= 0.9 + 1e-6)))}
    fine = {(min(i, j), max(i, j)) for i, j in zip(*np.nonzero((s >= tenth[:, None] - 1e-6) & (s >= 0.9 - 1e-6)))}
    assert got <= fine and len(got & sure) >= 0.995 * len(sure)


def test_copies_and_odd_vectors(spark):
    g = np.random.default_rng(5)
    a, b = g.normal(size=512), g.normal(size=512)
    near = a + 0.1 * g.normal(size=512)
    nan, zero = np.full(512, np.nan), np.zeros(512)
    df = frame(spark, [a] * 40 + [near, b, nan, zero, None, a[:256]])
    got = {(r["id_a"], r["id_b"]) for r in similar_pairs(df, k=3).collect()}
    own = {(i, j) for j in range(40) for i in [x for x in range(5) if x != j][:3]}
    assert {p for p in got if max(p) < 40} == {(min(p), max(p)) for p in own}
    assert {p for p in got if 40 in p} == {(0, 40), (1, 40), (2, 40)} and not any(x > 40 for p in got for x in p)
    old = df.unionByName(spark.createDataFrame([(0, 2, [float(x) for x in b], 0.0), (None, 2, [1.0] * 512, 0.0)], SCHEMA))
    assert (0, 41) in {(r["id_a"], r["id_b"]) for r in similar_pairs(old.where("id in (0, 41) or id is null")).collect()}
    assert rows(similar_pairs(df.limit(0))) == []


def sets_of(df):
    out = {}
    for c, i in df.collect():
        out.setdefault(c, set()).add(i)
    return out


@pytest.mark.parametrize("settings", [{}, {"cell_rows": 60, "block_rows": 50, "meet": 4}])
def test_clusters_are_the_planted_ones(spark, settings):
    sizes = [150] + [5] * 30 + [2] * 20 + [1] * 40
    x, label = planted(6, len(sizes), sizes)
    found = sets_of(similarity_clusters(frame(spark, x, 1000), **settings))
    want = {}
    for i, p in enumerate(label):
        want.setdefault(p, set()).add(1000 + i)
    assert sorted(map(sorted, found.values())) == sorted(sorted(m) for m in want.values() if len(m) > 1)
    assert all(c == min(m) for c, m in found.items())


def test_a_bridge_stays_with_its_own(spark):
    x, _ = planted(8, 2, [6, 6], noise=0.55)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    bridge = u[:6].mean(axis=0) * 1.0 + u[6:].mean(axis=0) * 0.75
    found = sets_of(similarity_clusters(frame(spark, [*x, bridge])))
    assert sorted(map(len, found.values())) == [6, 7] and 12 in found[0]


def test_cluster_corner_cases(spark):
    x, _ = planted(9, 1, 4)
    df = frame(spark, [*x, np.zeros(512), None, np.full(512, np.nan), x[0]])
    got = similarity_clusters(df)
    assert sets_of(got) == {0: {0, 1, 2, 3, 7}}
    told = typical_members(df, got, top=2).first()
    assert told["size"] == 5 and len(told["typical"]) == 2
    assert rows(similarity_clusters(df.limit(0))) == []
    assert rows(typical_members(df, got.limit(0))) == []


def test_clusters_do_not_depend_on_partitions(spark):
    """Cells, blocks within cells, and pairs of blocks of fragments, over rows dealt in two ways."""
    sizes = [90] + [6] * 25 + [2] * 20 + [1] * 30
    x, _ = planted(16, len(sizes), sizes, noise=0.6)
    df = frame(spark, x)
    small = {"cell_rows": 60, "block_rows": 25, "width": 64}
    a = rows(similarity_clusters(df.repartition(3), **small))
    b = rows(similarity_clusters(df.repartition(7, "id"), **small))
    assert a == b and len(a) > 200


def test_hashed_features_keep_similarity_about():
    g = np.random.default_rng(1)
    x = g.normal(size=(300, 512))
    y = x + 0.3 * g.normal(size=x.shape)
    f, h = (hashed_features(m, 128, np.ones(512)) for m in (x, y))
    assert f.shape == (300, 128) and np.allclose((f * f).sum(axis=1), 1, atol=1e-5)
    assert (f * h).sum(axis=1).mean() == pytest.approx(1 / np.sqrt(1.09), abs=0.02)
    light = hashed_features(x, 128, np.r_[np.zeros(500), np.ones(12)])
    assert np.allclose(light, hashed_features(np.c_[np.zeros((300, 500)), x[:, 500:]], 128, np.ones(512)), atol=1e-5)


def test_merging_fails_loudly(spark):
    x, _ = planted(17, 1, 40, noise=0.5)
    with pytest.raises(RuntimeError):
        similarity_clusters(frame(spark, x), block_rows=8, most_merges=0)


def test_shards_do_not_grow_with_the_vectors():
    met = []
    for n in (10**5, 10**7, 10**8, 10**9, 10**10):
        depth, sets = plan(n, 0.9, 512, 8, 8192, 11)
        met.append(sets * max(1.0, n / (512**depth * 8192)))
    assert plan(10**5, 0.9, 512, 8, 8192, 11) == (1, 8) and plan(10**9, 0.9, 512, 8, 8192, 11)[0] == 2
    assert met == sorted(met) and met[-1] < 200  # pieces of shards that a vector meets


def test_shards_named_by_two_points(spark, monkeypatch):
    x, label = planted(21, 40, 8, noise=0.3)
    want = {(r["id_a"], r["id_b"]) for r in similar_pairs(frame(spark, x), relax=1).collect()}
    monkeypatch.setattr(neighbours, "plan", lambda *_: (2, 26))
    got = {(r["id_a"], r["id_b"]) for r in similar_pairs(frame(spark, x)).collect()}
    assert len(want) > 500 and got <= want and len(got) >= 0.97 * len(want)
