import random

import pytest
from pyspark.sql import functions as F

from shoebox.llm.truth import said_date, said_number, said_text, survivors
from tests.test_operators import rows

CLAIM = "group_id bigint, id bigint, source string, recency double, field string, value string, support int"


def out(df, *names):
    return rows(df, *(names or ("group_id", "field", "value", "id")))


def test_trusted_sources_win(spark):
    """One good source against two that are wrong together now and then: its reliability decides."""
    data = []
    for g in range(30):
        data += [(g, 3 * g, "good", 1.0, "f", "x", 0), (g, 3 * g + 1, "good", 1.0, "f", "x", 0), (g, 3 * g + 2, f"bad{g % 2}", 1.0, "f", "y", 0)]
    data += [(99, 1000, "good", 1.0, "f", "right", 0), (99, 1001, "bad0", 9.0, "f", "wrong", 0)]
    got = {r["group_id"]: r["value"] for r in survivors(spark.createDataFrame(data, CLAIM)).collect()}
    assert got[99] == "right" and all(got[g] == "x" for g in range(30))


def brute_truth(claims, prior=2.0, tolerance=1e-3):
    """({group: value}, rounds) of claims (group, source, value), each one vote."""
    votes = {}
    for g, s, v in claims:
        votes.setdefault(g, {}).setdefault(v, []).append(s)
    sources = {s for _, s, _ in claims}
    all_ = {s: sum(x == s for _, x, _ in claims) for s in sources}
    trust, seen, states = dict.fromkeys(sources, 1.0), {}, []
    choose = lambda: {g: max(vs, key=lambda v: (round(sum(trust[s] for s in vs[v]), 12), v)) for g, vs in votes.items()}
    while True:
        chosen = choose()
        key = tuple(sorted(chosen.items()))
        if key in seen:
            circle = states[seen[key] :]
            if len(circle) > 1:
                trust = {s: sum(t[s] for t in circle) / len(circle) for s in sources}
            break
        seen[key] = len(states)
        new = {s: (sum(chosen[g] == v for g, x, v in claims if x == s) + prior / 2) / (all_[s] + prior) for s in sources}
        step = max(abs(new[s] - trust[s]) for s in sources)
        trust = new
        states.append(trust)
        if step <= tolerance:
            break
    return choose(), len(states)


def disputed(seed):
    r = random.Random(seed)
    sources, groups = r.randrange(10, 60), r.randrange(30, 200)
    r.random(), [r.random() for _ in range(sources - 1)]
    return [(g, f"s{s:02d}", r.choice("xy" if r.random() < 0.8 else "xyz")) for g in range(groups) for s in r.sample(range(sources), r.randrange(2, 7))]


@pytest.mark.parametrize("seed", [8647, 442])
def test_contested_values_equal_brute_force(spark, seed):
    """Cases that take some ten rounds to settle."""
    claims = disputed(seed)
    want, rounds = brute_truth(claims)
    assert rounds > 8
    data = [(g, i, s, None, "f", v, 0) for i, (g, s, v) in enumerate(claims)]
    df = spark.createDataFrame(data, CLAIM)
    assert {r["group_id"]: r["value"] for r in survivors(df).collect()} == want
    if seed == 442:
        with pytest.raises(RuntimeError):
            survivors(df, most_rounds=3)


def test_planted_truth_is_found_better_than_by_majority(spark):
    r, data, truth, majority = random.Random(5), [], {}, {}
    right = {"a": 0.97, "b": 0.95, "c": 0.5, "d": 0.5, "e": 0.45}
    for g in range(400):
        said = {s: "t" if r.random() < p else f"w{r.randrange(2)}" for s, p in right.items()}
        truth[g], counted = "t", {v: sum(x == v for x in said.values()) for v in said.values()}
        majority[g] = max(counted, key=lambda v: (counted[v], v))
        data += [(g, 5 * g + k, s, 1.0, "f", v, 0) for k, (s, v) in enumerate(said.items())]
    got = {r["group_id"]: r["value"] for r in survivors(spark.createDataFrame(data, CLAIM)).collect()}
    hits = lambda x: sum(x[g] == truth[g] for g in truth) / len(truth)
    assert hits(got) > 0.95 and hits(got) > hits(majority) + 0.02


def test_ties_and_nulls(spark):
    data = [
        (1, 1, "a", 1.0, "f", "old", 0), (1, 2, "a", 2.0, "f", "new", 0), (2, 3, None, None, "f", "b", 0), (2, 4, None, None, "f", "a", 0),
        (3, 5, "a", 1.0, "f", None, 0), (None, 6, "a", 1.0, "f", "x", 0), (4, None, "a", 1.0, "f", "x", 0), (5, 7, "a", 1.0, None, "x", 0),
        (6, 9, "a", 1.0, "f", "same", 0), (6, 8, "a", 1.0, "f", "same", 0), (6, 8, "a", 1.0, "f", "same", 0),
    ]
    df = spark.createDataFrame(data, CLAIM)
    assert out(survivors(df)) == [(1, "f", "new", 2), (2, "f", "b", 3), (6, "f", "same", 8)]
    assert out(survivors(df).where("group_id = 6"), "claimants", "agreeing") == [(2, 2)]
    assert out(survivors(df.limit(0))) == []


def test_largest(spark):
    data = [(1, 1, "a", 1.0, "size", "10", 0), (1, 2, "a", 1.0, "size", "9", 0), (2, 3, "a", 1.0, "size", "5", 0), (2, 4, "b", 1.0, "size", "5", 0), (2, 4, "b", 1.0, "f", "v", 0)]
    got = survivors(spark.createDataFrame(data, CLAIM), largest=("size",))
    assert out(got, "group_id", "field", "value", "id", "agreeing", "claimants") == [(1, "size", "10", 1, 1, 2), (2, "f", "v", 4, 1, 1), (2, "size", "5", 3, 2, 2)]


def test_what_says_something(spark):
    texts = [" Unknown ", "n/a", "", None, " X ", "2019:02:30 10:00:00", "2019:02:28 10:00:00", "0", "0.0", "-5.5", "NaN", "abc"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r[0]: tuple(r)[1:] for r in df.select("i", said_text(F.col("t")), said_date(F.col("t")), said_number(F.col("t"))).collect()}
    assert [got[i][0] is not None for i in range(5)] == [False, False, False, False, True] and got[4][0] == "X"
    assert got[5][1] is None and got[6][1] == "2019:02:28 10:00:00"
    assert [got[i][2] for i in range(7, 12)] == [None, None, "-5.5", None, None]
