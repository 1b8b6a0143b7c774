"""Most similar vectors for every vector: vantage-point trees per shard, with relaxed pruning.

The distance of two vectors is the angle between them. There are several sets of orthogonal vantage points, each point
with its opposite; every vector lies, for each set, in the shard of the vantage point nearest to it. Near vectors mostly
share the nearest point of a set, and of several sets next to always one. The more vectors there are, the more points
in a row name a shard, and the more sets there are to make up for it, so that shards don't grow. Each shard holds a
vantage-point tree over its vectors, described by their angles to fixed vantage points, one byte each: each node splits
at the median angle to the point from which its own vectors spread most, and by the triangle inequality a branch can be
left out if it lies further than the search radius from the asking vector's angle. ``relax`` divides that radius: in many dimensions the angles of near vectors differ by far less than the
inequality allows, so that 6 loses next to nothing. With 1 there is one shard, pruned without loss: exact search. The
vectors themselves aren't moved until a pair is to be checked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shoebox.llm.vectors import cosine, directions, only_listed, packed, slices, unit_rows, unpacked
from shoebox.session import cut

#: An angle is stored as its difference from a right angle in steps of STEP, cut off at 127 steps.
STEP = 0.002
SKETCH = pa.schema([("id", pa.int64()), ("version", pa.int64()), ("same", pa.binary()), ("sketch", pa.binary()), ("shards", pa.list_(pa.int64()))])
#: A pair, or (without id_b) a row of a task that has many candidates there.
FOUND = pa.schema([("id_a", pa.int64()), ("id_b", pa.int64()), ("shard", pa.int64()), *((c, pa.int32()) for c in ("i", "j", "own"))])


def _width(dims: int) -> int:
    return min(256, dims)


def plan(n: int, least: float, dims: int, sets: int, shard_rows: int, seed: int) -> tuple[int, int]:
    """(depth, sets): how many points name a shard of ``n`` vectors, and how many sets of shards then lose no more pairs.

    That is told from how often random pairs at the limit share a point. Of all depths the one is taken at which a vector
    meets fewest others: in ``sets`` shards, each in as many blocks of ``shard_rows`` as it fills.
    """
    rng, width = np.random.default_rng(seed), _width(dims)
    x, away = rng.standard_normal((2, 4000, dims))
    x /= np.sqrt((x * x).sum(axis=1))[:, None]
    away -= (away * x).sum(axis=1)[:, None] * x
    away /= np.sqrt((away * away).sum(axis=1))[:, None]
    y = least * x + np.sqrt(max(0.0, 1 - least * least)) * away
    a, b = (_axis(m @ directions(dims, width, seed)) for m in (x, y))
    share = min(0.99, max(1e-3, float((a == b).mean())))
    need = lambda d: int(np.ceil(sets * np.log(1 - share) / np.log(1 - share**d)))
    return min(((d, need(d)) for d in range(1, 4)), key=lambda x: x[1] * max(1.0, n / ((2 * width) ** x[0] * shard_rows)))


def _axis(near: np.ndarray) -> np.ndarray:
    at = np.abs(near).argmax(axis=1)
    return at * 2 + (near[np.arange(len(at)), at] < 0)


def sketches(vectors: DataFrame, dims: int, points: int, sets: int, seed: int, depth: int = 1) -> DataFrame:
    """(id, version, same, sketch, shards) of the latest version of each id of ``vectors`` (id, version BIGINT, vector) that is a vector.

    ``same`` is a hash of the vector, equal for copies; ``shards`` has the nearest vantage points of each set, ``depth``
    of them in a row.
    """
    width = _width(dims)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows, matrix = unit_rows(batch.column("vector"), dims)
            nearest = np.zeros((len(rows), sets), "int64")
            for number in range(sets):
                nearest[:, number] = number
                for level in range(depth):
                    near = matrix @ directions(dims, width, seed + number * depth + level)
                    if number == level == 0:
                        codes = np.clip(np.rint(np.arcsin(np.clip(near[:, :points], -1, 1)) / STEP), -127, 127).astype("int8")
                    nearest[:, number] = nearest[:, number] * 2 * width + _axis(near)
            at = np.full(batch.num_rows, -1)
            at[rows] = np.arange(len(rows))
            take = pa.array(at, pa.int64(), mask=at < 0)
            hashes = pa.array([xxhash.xxh3_128_digest(v.tobytes()) for v in matrix], pa.binary())
            shards = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype="int32") * sets), pa.array(nearest.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("version"), hashes.take(take), packed(codes).take(take), shards.take(take)], schema=SKETCH)

    rows = vectors.where("id is not null").select("id", F.coalesce("version", F.lit(-(2**62))).alias("version"), "vector")
    named = rows.mapInArrow(describe, "id bigint, version bigint, same binary, sketch binary, shards array<bigint>")
    newest = F.max(F.struct("version", F.col("sketch").isNotNull().alias("is"), "same", "sketch", "shards")).alias("x")
    return named.groupBy("id").agg(newest).where("x.sketch is not null").select("id", "x.version", "x.same", "x.sketch", "x.shards")


def _search(codes: np.ndarray, first: int, slack: int, joint: float, leaf: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, dense): pairs of rows of ``codes`` whose sketches are near, by a vantage-point tree, and which rows have more than ``most`` of them.

    The rows before ``first`` ask those from it on; with 0 all ask all. Pairs of two dense rows are left out: there may
    be as many as the square of the rows, and they are dropped while the search runs.
    """
    home, ask = codes[first:], codes[: first or len(codes)]
    stored, asking = home.astype("float32"), ask.astype("float32")
    norm_s, norm_a = (stored * stored).sum(axis=1), (asking * asking).sum(axis=1)
    stack, found_a, found_b, held = [(np.arange(len(home)), np.arange(len(ask)))], [], [], 0
    near = np.zeros(len(codes), "int64")

    def kept() -> tuple[np.ndarray, np.ndarray]:
        a, b = (np.concatenate(x) if x else np.zeros(0, "int32") for x in (found_a, found_b))
        fine = (near[a] <= most) | (near[b] <= most)
        return a[fine], b[fine]

    while stack:
        s, a = stack.pop()
        if not len(s) or not len(a):
            continue
        if len(s) > leaf:
            # the point from which some of the node's vectors spread most
            point = int(stored[s[:: max(1, len(s) // 256)]].std(axis=0).argmax())
            values = home[s, point]
            middle = int(np.median(values))
            low = values <= middle
            if not low.all():
                asked = ask[a, point].astype("int32")
                stack.append((s[low], a[asked <= middle + slack]))
                stack.append((s[~low], a[asked > middle - slack]))
                continue
        for lo in range(0, len(s), 2048):
            part = s[lo : lo + 2048]
            for la in range(0, len(a), 4096):
                some = a[la : la + 4096]
                d = norm_a[some, None] + norm_s[part] - 2 * (asking[some] @ stored[part].T)
                i, j = np.nonzero(d <= joint)
                i2, j2 = some[i], part[j] + first
                once = i2 < j2
                i2, j2 = i2[once].astype("int32"), j2[once].astype("int32")
                near += np.bincount(i2, minlength=len(near)) + np.bincount(j2, minlength=len(near))
                found_a.append(i2)
                found_b.append(j2)
                held += len(i2)
                if held > 4_000_000:
                    x, y = kept()
                    found_a, found_b, held = [x], [y], 0
    return *kept(), near > most


def _nearest(a: np.ndarray, b: np.ndarray | None, ids_b: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Places (in a, in b) of the ``k`` rows of ``b`` most similar to each row of ``a``; without ``b`` within ``a``. ``ids_b`` ascend."""
    of = a if b is None else b
    out_a, out_b = [], []
    for lo in range(0, len(a), 512):
        # identical rows must tie, in whatever order the products are added
        near = np.round(a[lo : lo + 512] @ of.T, 12)
        if b is None:
            near[np.arange(len(near)), lo + np.arange(len(near))] = -2
        last = np.partition(near, -k, axis=1)[:, -k] if near.shape[1] > k else np.full(len(near), -2.0)
        i, j = np.nonzero((near >= last[:, None]) & (near >= least - 1e-9))
        order = np.lexsort((ids_b[j], -near[i, j], i))
        i, j = i[order], j[order]
        rank = np.arange(len(i)) - np.searchsorted(i, i)
        out_a.append(i[rank < k] + lo)
        out_b.append(j[rank < k])
    return np.concatenate(out_a), np.concatenate(out_b)


def _tasks(batches: Iterator[pa.RecordBatch], column: str, kind: str) -> Iterator[tuple[tuple, np.ndarray, np.ndarray, np.ndarray]]:
    """((shard, i, j), own, ids, rows of ``column``) of batches sorted by shard, i, j, own, id."""
    task, parts = None, []
    for batch in batches:
        keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("shard", "i", "j")], axis=1)
        own, ids = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("own", "id"))
        data = unpacked(batch.column(column).to_pylist(), kind)
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1), len(keys)]
        for lo, hi in zip(cuts, cuts[1:]):
            if lo == hi:
                continue
            if (now := tuple(keys[lo])) != task:
                if parts:
                    yield task, *(np.concatenate(x) for x in zip(*parts))
                task, parts = now, []
            parts.append((own[lo:hi], ids[lo:hi], data[lo:hi]))
    if parts:
        yield task, *(np.concatenate(x) for x in zip(*parts))


def similar_pairs(vectors: DataFrame, k: int = 10, least: float = 0.9, dims: int = 512, relax: float = 6.0, points: int = 160, sets: int = 8, shard_rows: int = 8192, seed: int = 11) -> DataFrame:
    """(id_a, id_b, cosine): pairs, smaller id first, one of which is among the other's ``k`` most similar with at least ``least``.

    vectors: id, version, vector (array of floats); other columns are ignored. The latest version of an id counts (a
    NULL version is the oldest). What isn't a vector of ``dims`` finite elements that aren't all zero takes part in
    nothing; lengths don't matter. Equal similarity is decided by the smaller id. Of more than k + 1 copies of one
    vector only the k + 1 smallest ids are stored, and the others pair with the k smallest: that is what their k most
    similar are, with ties by id. With ``relax`` 1 no pair is lost. Vectors that one shard holds more than 8k near
    candidates for are compared with each other by their exact cosines there, and each keeps its k most similar: no
    candidate is left out by its sketch's rank. No vectors give no rows.

    A shard of more than ``shard_rows`` vectors is searched in pairs of blocks of that size; ``plan`` keeps shards so
    small that a vector meets about as many others whatever their number. With ``relax`` 1 all vectors are one shard:
    the work grows with the square of their number.
    """
    if not -1 <= least <= 1 or relax < 1:
        raise ValueError("least must be a cosine and relax at least 1")
    points, depth = min(points, _width(dims)), 1
    if relax > 1:
        depth, sets = plan(vectors.count(), least, dims, sets, shard_rows, seed)
    else:
        sets = 1
    rows = cut(sketches(vectors, dims, points, sets, seed, depth))
    crowds = cut(rows.groupBy("same").agg(F.count("*").alias("copies")).where(F.col("copies") > k + 1))
    tails = None
    if not crowds.isEmpty():
        inside = rows.join(crowds, "same")
        salt = F.pmod(F.xxhash64("id"), F.lit(64)).alias("salt")
        by_salt = Window.partitionBy("same", "salt").orderBy("id")
        heads = inside.select("same", "id", salt).withColumn("rank", F.row_number().over(by_salt)).where(F.col("rank") <= k + 1)
        heads = heads.withColumn("rank", F.row_number().over(Window.partitionBy("same").orderBy("id"))).where(F.col("rank") <= k + 1)
        heads = cut(heads.select("same", "id", "rank"))
        few = heads.groupBy("same").agg(F.collect_list(F.when(F.col("rank") <= k, F.col("id"))).alias("nearest"))  # k ids at most
        rest = inside.select("same", "id").join(heads.select("id"), "id", "left_anti").join(few, "same")
        tails = rest.select(F.explode("nearest").alias("id_a"), F.col("id").alias("id_b"), F.lit(1.0).alias("cosine"))
        rows = cut(rows.join(rest.select("id"), "id", "left_anti"))
    radius, apart = float(np.arccos(least)), 2 - 2 * least
    slack = int(np.ceil(radius / relax / STEP)) + 1
    # of orthogonal directions the squared differences add up to a share of the squared distance; to all of it at most
    part = 1.07 if relax == 1 else min(1.07, 1.25 * points / dims)
    joint = (np.sqrt(apart * part) / STEP + (np.sqrt(points) if relax == 1 else 1)) ** 2
    most = 8 * k  # of a row's candidates in a task: beyond it the exact way is taken
    stored = rows.select("id", "sketch", F.explode("shards").alias("shard") if relax > 1 else F.lit(0).cast("bigint").alias("shard"))
    blocks = stored.groupBy("shard").agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("blocks"))
    placed = stored.join(F.broadcast(blocks) if depth == 1 else blocks, "shard")  # at depth 1 there are at most 2 * 256 * sets shards
    placed = placed.withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.select("shard", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "sketch")
    placed = placed.repartition("shard", "i", "j").sortWithinPartitions("shard", "i", "j", "own", "id")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for task, own, ids, codes in _tasks(batches, "sketch", "int8"):
            first = 0 if task[1] == task[2] else int((own == task[1]).sum())  # blocks i ask block j
            if task[1] != task[2] and first in (0, len(ids)):
                continue
            a, b, dense = _search(codes, first, slack, joint, 48, most)
            yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[b]), pa.nulls(len(a), pa.int64()), *(pa.nulls(len(a), pa.int32()) for _ in range(3))], schema=FOUND)
            of = [pa.array(np.full(dense.sum(), x, kind)) for x, kind in zip(task, ("int64", "int32", "int32"))]
            yield pa.RecordBatch.from_arrays([pa.array(ids[dense]), pa.nulls(dense.sum(), pa.int64()), *of, pa.array(own[dense])], schema=FOUND)

    found = cut(placed.mapInArrow(search, "id_a bigint, id_b bigint, shard bigint, i int, j int, own int"))
    near = found.where("id_b is not null").select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"))
    near = cut(near.distinct())
    dense = found.where("id_b is null").select("shard", "i", "j", "own", F.col("id_a").alias("id"))
    crowded = not dense.isEmpty()
    # the exact check: only vectors that are in a pair, or dense, are read for it
    listed = near.select(F.col("id_a").alias("id")).union(near.select("id_b"))
    listed = (listed.union(dense.select("id")) if crowded else listed).distinct()
    listed = cut(rows.select("id", "version").join(listed, "id"))

    def scale(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            at, matrix = unit_rows(batch.column("vector"), dims)
            take = pa.array(at)
            yield pa.RecordBatch.from_arrays([batch.column("id").take(take), batch.column("version").take(take), packed(matrix)], names=["id", "version", "unit"])

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for task, own, ids, units in _tasks(batches, "unit", "float32"):
            first = 0 if task[1] == task[2] else int((own == task[1]).sum())
            exact = units.astype("float64")
            if task[1] == task[2]:
                a, b = _nearest(exact, None, ids, k, least)
            elif first in (0, len(ids)):
                continue
            else:
                a, b = _nearest(exact[:first], exact[first:], ids[first:], k, least)
                y, x = _nearest(exact[first:], exact[:first], ids[:first], k, least)
                a, b = np.append(a, x), np.append(b, y) + first
            pair = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
            for lo in range(0, len(pair), 4096):
                a, b = pair[lo : lo + 4096].T
                ends = pa.array(np.minimum(ids[a], ids[b])), pa.array(np.maximum(ids[a], ids[b]))
                yield pa.RecordBatch.from_arrays([*ends, pa.array((exact[a] * exact[b]).sum(axis=1))], names=["id_a", "id_b", "cosine"])

    given = vectors.select("id", F.coalesce("version", F.lit(-(2**62))).alias("version"), "vector")
    units = only_listed(given, listed, "id", "version").mapInArrow(scale, "id bigint, version bigint, unit binary")
    units = units.groupBy("id", "version").agg(F.max("unit").alias("unit"))
    units = units.join(listed, ["id", "version"]).select("id", "unit")
    side = lambda x: units.select(F.col("id").alias(f"id_{x}"), F.col("unit").alias(f"unit_{x}"))
    checked = near.join(side("a"), "id_a").join(side("b"), "id_b")
    checked = checked.select("id_a", "id_b", cosine("unit_a", "unit_b").alias("cosine")).where(F.col("cosine") >= least)
    if crowded:
        exact = dense.join(units, "id").repartition("shard", "i", "j").sortWithinPartitions("shard", "i", "j", "own", "id")
        exact = exact.mapInArrow(rank, "id_a bigint, id_b bigint, cosine double").where(F.col("cosine") >= least)
        checked = checked.unionByName(exact).groupBy("id_a", "id_b").agg(F.max("cosine").alias("cosine"))
    both = checked.select(F.col("id_a").alias("id"), F.col("id_b").alias("other"), "cosine")
    both = both.unionByName(checked.select(F.col("id_b").alias("id"), F.col("id_a").alias("other"), "cosine"))
    ranked = both.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("cosine"), "other"))).where(F.col("rank") <= k)
    pairs = ranked.groupBy(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).agg(F.max("cosine").alias("cosine"))
    return pairs if tails is None else pairs.unionByName(tails.select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"), "cosine"))
