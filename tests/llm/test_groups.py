import random

import pytest

from shoebox.llm.components import group_pairs, link_pairs, match_groups
from tests.test_operators import hashes, rows, union_find


@pytest.mark.parametrize("seed,beta,steps", [(0, 0.02, 4), (1, 0.5, 1), (2, 2.0, 2)])
def test_decomposition_equals_union_find(spark, seed, beta, steps):
    r = random.Random(seed)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 170)] + [(300, i) for i in range(301, 360)]
    df = spark.createDataFrame([*edges, edges[0], edges[0][::-1], (None, 1), (4, None)], "a bigint, b bigint")
    assert set(map(tuple, group_pairs(df, beta=beta, steps=steps).collect())) == union_find([(a, b) for a, b in edges] + [(a, a) for a, b in edges])


def test_no_pairs(spark):
    none = spark.createDataFrame([], "a bigint, b bigint")
    assert rows(group_pairs(none)) == []
    assert rows(group_pairs(spark.createDataFrame([(3, 3)], "a bigint, b bigint"))) == [(3, 3)]


ITEM = "id bigint, file string, hash binary, link string, group_id int"


def test_match_groups_equal_brute_force(spark):
    r = random.Random(7)
    values = hashes(r, 90)
    data = [(i, f"/f{i}", bytearray(h), None if r.random() < 0.8 else f"/f{r.randrange(120)}", 0) for i, h in enumerate(values)]
    data += [(200, "/x", None, "/f3", 0), (201, "/y", bytearray(32), "/y", 0), (202, "/z", bytearray(8), "", 0), (203, "/w", bytearray(32), None, 0), (204, None, None, None, 0)]
    data += data[:5]
    names = {f: i for i, f, *_ in data if f}
    edges = [(i, names[link]) for i, _, _, link, _ in data if link in names and names[link] != i]
    ints = [int.from_bytes(h, "big") for h in values]
    edges += [(i, j) for i in range(90) for j in range(i + 1, 90) if bin(ints[i] ^ ints[j]).count("1") <= 10]
    want = {(g, i) for i, g in union_find(edges)}
    df = spark.createDataFrame(data, ITEM)
    assert set(map(tuple, match_groups(df).collect())) == want
    assert rows(match_groups(df.limit(0))) == []


def test_a_third_of_all_copies(spark):
    data = [(i, f"/f{i}", bytearray(bytes([7] * 32)), None, 0) for i in range(300)] + [(i, f"/f{i}", bytearray(i.to_bytes(32, "little")), None, 0) for i in range(10**6, 10**6 + 3)]
    got = rows(match_groups(spark.createDataFrame(data, ITEM)))
    assert sum(g == 0 for g, _ in got) == 300


def test_links(spark):
    data = [(1, "/a", None, "/b", 0), (2, "/b", None, "/b", 0), (3, "/c", None, "/nowhere", 0), (4, "/d", None, None, 0)]
    assert rows(link_pairs(spark.createDataFrame(data, ITEM))) == [(1, 2)]
