"""Grouping records into similarity clusters: k-means with parallel oversampled seeding, in two levels.

The first level works on hashed weighted features: each element of a vector is weighted by how little it spreads over
all records, and added with a sign to one of fewer places. It finds up to ``most_cells`` centroids by k-means||: in a
few passes each record is drawn as a seed with a probability in proportion to its distance from the seeds so far, the
seeds are weighted by what lies nearest to them and clustered themselves, and Lloyd's step follows until the cost stands
still. Each record goes to the cell of its nearest centroid; centroids only say who meets whom. Within a cell, in blocks
of bounded size, k-means is run again on the vectors themselves, with oversampled seeding until every record is near a
seed, which gives fragments: a fragment is known by its size and the mean of its vectors, and the product of two means is
the average similarity of their members. Fragments meet in the cells of the centroids nearest to them, again in blocks,
and are merged where that average is high enough, until none moves; a record on its own joins only the fragments it is
most similar to. So a cluster that lies across cells, or fills many blocks, is still found. All sums are taken in whole
numbers, so that the result doesn't depend on how the records lie in partitions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shoebox.llm.components import group_pairs
from shoebox.llm.vectors import packed, slices, sums_by, totals, unit_rows, unpacked
from shoebox.session import cut


def hashed_features(matrix: np.ndarray, width: int, weights: np.ndarray | None = None, seed: int = 5) -> np.ndarray:
    """Rows of features times their weights, hashed to ``width`` places with signs, scaled to length one.

    The hash is an odd multiplier modulo ``width``, so that a power of two is filled evenly.
    """
    n = matrix.shape[1]
    rng = np.random.default_rng(seed)
    odd = int(rng.integers(0, max(1, width // 2))) * 2 + 1
    to = np.zeros((n, width), "float32")
    to[np.arange(n), (np.arange(n) * odd) % width] = rng.choice([-1.0, 1.0], n)
    out = matrix.astype("float32") @ (to if weights is None else to * np.asarray(weights, "float32")[:, None])
    length = np.sqrt((out * out).sum(axis=1))[:, None]
    return out / np.where(length > 0, length, 1)


def quantized(rows: np.ndarray) -> np.ndarray:
    """Rows of floats as bytes: a scale, then one signed byte for each."""
    scale = np.abs(rows).max(axis=1, initial=0) / 127
    scale = np.where(scale > 0, scale, 1).astype("float32")
    codes = np.rint(rows / scale[:, None]).astype("int8")
    return np.concatenate([scale[:, None].view("uint8"), codes.view("uint8")], axis=1)


def restored(column) -> np.ndarray:
    raw = unpacked(column, "uint8")
    if not len(raw):
        return np.zeros((0, 1), "float32")
    return raw[:, 4:].view("int8").astype("float32") * np.ascontiguousarray(raw[:, :4]).view("float32")


def units_of(vectors: DataFrame, dims: int) -> DataFrame:
    """(id, unit): the latest version of each id that is a vector, scaled to length one, as bytes."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows, matrix = unit_rows(batch.column("vector"), dims)
            at = np.full(batch.num_rows, -1)
            at[rows] = np.arange(len(rows))
            units = packed(quantized(matrix)).take(pa.array(at, pa.int64(), mask=at < 0))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("version"), units], names=["id", "version", "unit"])

    rows = vectors.where("id is not null").select("id", F.coalesce("version", F.lit(-(2**62))).alias("version"), "vector")
    named = rows.mapInArrow(describe, "id bigint, version bigint, unit binary")
    newest = F.max(F.struct("version", F.col("unit").isNotNull().alias("is"), "unit")).alias("x")
    return named.groupBy("id").agg(newest).where("x.unit is not null").select("id", "x.unit")


def spread_weights(points: DataFrame, dims: int) -> tuple[int, np.ndarray]:
    """(n, weights): the number of points (id, unit), and for each element one over its standard deviation, at most ten times the median."""

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, total, square = 0, np.zeros(dims, "int64"), np.zeros(dims, "int64")
        for frame in frames:
            x = fixed(restored(frame["unit"])).astype("int64") if len(frame) else np.zeros((0, dims), "int64")
            n += len(x)
            total += x.sum(axis=0)
            square += (x * x >> SHIFT).sum(axis=0)
        yield pd.DataFrame({"n": [n], "total": [total.tobytes()], "square": [square.tobytes()]})

    n, total, square = 0, np.zeros(dims, "int64"), np.zeros(dims, "int64")
    for r in points.select("unit").mapInPandas(add, "n bigint, total binary, square binary").toLocalIterator():  # a row per partition
        n, total, square = n + r["n"], total + np.frombuffer(r["total"], "int64"), square + np.frombuffer(r["square"], "int64")
    one = float(1 << SHIFT)
    spread = np.sqrt(np.maximum(square / one / max(n, 1) - (total / one / max(n, 1)) ** 2, 0))
    usual = float(np.median(spread)) or 1.0
    return n, (usual / np.maximum(spread, usual / 10)).astype("float32")


#: Sums are taken in steps of 2**-SHIFT: in whole numbers their order doesn't matter.
SHIFT = 16


def fixed(x: np.ndarray) -> np.ndarray:
    """Numbers between -1 and 1 as steps."""
    return np.rint(x * np.float32(1 << SHIFT)).astype("int32")


def _nearest(x: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The greatest product of each row with a seed, and which seed that is."""
    best, which = np.full(len(x), -1.0, "float32"), np.zeros(len(x), "int64")
    for top in range(0, len(x), 1024):
        rows, own = x[top : top + 1024], slice(top, top + 1024)
        for lo in range(0, len(seeds), 4096):
            s = rows @ seeds[lo : lo + 4096].T
            at = s.argmax(axis=1)
            value = s[np.arange(len(rows)), at]
            better = value > best[own]
            best[own] = np.where(better, value, best[own])
            which[own] = np.where(better, at + lo, which[own])
    return best, which


def oversampled_centroids(points: DataFrame, k: int, n: int, features: Callable, rounds: int = 3, settled: float = 5e-3, most_steps: int = 100, seed: int = 3) -> np.ndarray:
    """At most ``k`` centroids of length one of the ``n`` ``points`` (id, unit), by k-means|| over all of them.

    ``features`` makes rows of the units. Lloyd's step is repeated until the cost falls by less than the share
    ``settled``; should it not after ``most_steps``, this fails.
    """
    spark = points.sparkSession
    first = points.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(1).collect()
    if not first:
        return np.zeros((0, 1), "float32")
    seeds = features([first[0]["unit"]])

    def draw_with(seeds_: np.ndarray, rate: float, number: int):
        shared = spark.sparkContext.broadcast(seeds_)

        def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = 0
            for frame in frames:
                distance = np.maximum(0, 1 - _nearest(features(frame["unit"]), shared.value)[0]) if len(frame) else np.zeros(0)
                total += int(fixed(distance).sum(dtype="int64"))
                chosen = frame["u"].to_numpy() < np.minimum(1, rate * distance)
                yield pd.DataFrame({"id": frame["id"][chosen], "unit": frame["unit"][chosen], "distance": 0})
            yield pd.DataFrame({"id": [-1], "unit": [None], "distance": [total]})

        u = (F.shiftrightunsigned(F.xxhash64("id", F.lit(seed + number)), 11).cast("double") / float(2**53)).alias("u")
        return points.select("id", "unit", u).mapInPandas(draw, "id bigint, unit binary, distance bigint")

    spread = float(n)
    for number in range(rounds):
        rows = draw_with(seeds, 2.0 * k / rounds / max(spread, 1e-9), number + 1).collect()  # about 2k / rounds of them
        found = sorted((r["id"], r["unit"]) for r in rows if r["unit"] is not None)
        spread = sum(r["distance"] for r in rows) / (1 << SHIFT)
        if found:
            seeds = np.concatenate([seeds, features([u for _, u in found])])
    weight = _sums(points, seeds, features)[0]
    seeds = seeds[weight > 0]
    weight = weight[weight > 0].astype("float64")
    rng = np.random.default_rng(seed)
    # the weighted seeds, at most some times k, are clustered here
    start = [int(weight.argmax())]
    distance = 1 - seeds @ seeds[start[0]]
    while len(start) < min(k, len(seeds)):
        mass = np.maximum(distance, 0) * weight
        if mass.sum() <= 1e-9:
            break
        start.append(int(rng.choice(len(seeds), p=mass / mass.sum())))
        distance = np.minimum(distance, 1 - seeds @ seeds[start[-1]])
    centroids = seeds[start]
    for _ in range(5):
        which = _nearest(seeds, centroids)[1]
        sums = np.zeros_like(centroids)
        np.add.at(sums, which, seeds * weight[:, None].astype("float32"))
        centroids = _units(sums, centroids)
    cost = None
    for _ in range(most_steps):
        counts, sums, now = _sums(points, centroids, features)
        centroids = _units(sums, centroids)
        if cost is not None and cost - now <= settled * cost:
            return centroids
        cost = now
    raise RuntimeError(f"the cost still falls after {most_steps} steps")


def _units(sums: np.ndarray, otherwise: np.ndarray) -> np.ndarray:
    length = np.sqrt((sums * sums).sum(axis=1))[:, None]
    return np.where(length > 1e-9, sums / np.where(length > 1e-9, length, 1), otherwise).astype("float32")


def _sums(points: DataFrame, centroids: np.ndarray, features: Callable) -> tuple[np.ndarray, np.ndarray, float]:
    """How many points are nearest to each centroid, their sum, and the sum of all distances: a row per centroid and task."""
    shared = points.sparkSession.sparkContext.broadcast(centroids)

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts, sums, cost = np.zeros(len(shared.value), "int64"), np.zeros(shared.value.shape, "int64"), 0
        for frame in frames:
            if not len(frame):
                continue
            x = features(frame["unit"])
            best, which = _nearest(x, shared.value)
            cost += int(fixed(np.maximum(0, 1 - best)).sum(dtype="int64"))
            counts += np.bincount(which, minlength=len(counts))
            order = np.argsort(which, kind="stable")
            cells, first = np.unique(which[order], return_index=True)
            sums[cells] += np.add.reduceat(fixed(x[order]), first, dtype="int64")
        used = np.flatnonzero(counts)
        yield pd.DataFrame({"c": np.append(used, -1), "n": np.append(counts[used], cost), "s": [*(sums[c].tobytes() for c in used), b""]})

    counts, sums, cost = np.zeros(len(centroids), "int64"), np.zeros(centroids.shape, "int64"), 0

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(s, "int64") for s in frame["s"]], axis=0)
        return pd.DataFrame({"c": [frame["c"].iloc[0]], "n": [frame["n"].sum()], "s": [total.tobytes()]})

    for r in points.select("unit").mapInPandas(add, "c bigint, n bigint, s binary").groupBy("c").applyInPandas(merge, "c bigint, n bigint, s binary").collect():
        if r["c"] < 0:
            cost = r["n"] / (1 << SHIFT)
        else:
            counts[r["c"]], sums[r["c"]] = r["n"], np.frombuffer(r["s"], "int64")
    return counts, sums / float(1 << SHIFT), cost


def _sums_of(x: np.ndarray, label: np.ndarray) -> np.ndarray:
    """The sum of the rows of each label; labels count from 0 without gaps."""
    order = np.argsort(label, kind="stable")
    return np.add.reduceat(x[order], np.unique(label[order], return_index=True)[1])


def local_clusters(x: np.ndarray, sure: float, rng: np.random.Generator, lloyd: int = 2) -> np.ndarray:
    """Labels of rows of length one: k-means with oversampled seeding until each row is near a seed."""
    n = len(x)
    best, label, count = np.full(n, -1.0, "float32"), np.zeros(n, "int64"), 0
    while True:
        open_ = np.flatnonzero(best < sure)
        if not len(open_):
            break
        mass = 1 - best[open_].astype("float64")
        take = min(len(open_), max(8, len(open_) // 4))
        new = rng.choice(open_, take, replace=False, p=mass / mass.sum())
        value, which = _nearest(x, x[new])
        value[new], which[new] = 2.0, np.arange(take)  # a seed is its own, whatever its copies are
        nearer = value > best
        best[nearer], label[nearer] = value[nearer], which[nearer] + count
        count += take
    for _ in range(lloyd):
        used, label = np.unique(label, return_inverse=True)
        size = np.bincount(label)
        label = _merged(_sums_of(x, label) / size[:, None], size, sure)[label]
        count = label.max() + 1
        size, sums = np.bincount(label, minlength=count), _sums_of(x, label)
        # average similarity to the rest of one's own cluster, and to all of any other
        own, means = label, sums / size[:, None]
        mine = np.where(size[own] > 1, ((x * sums[own]).sum(axis=1) - 1) / np.maximum(size[own] - 1, 1), -1)
        label = np.empty(n, "int64")
        for lo in range(0, n, 1024):
            rows = np.arange(lo, min(lo + 1024, n))
            s = x[rows] @ means.T
            s[np.arange(len(rows)), own[rows]] = mine[rows]
            at = s.argmax(axis=1)
            # a row that is similar to no cluster starts one
            label[rows] = np.where(s[np.arange(len(rows)), at] >= sure, at, count + rows)
    return np.unique(label, return_inverse=True)[1]


def _merged(means: np.ndarray, size: np.ndarray, least: float) -> np.ndarray:
    """Labels of clusters after merging, most similar first, all whose average similarity stays at least ``least``.

    Averages of averages follow from the products of the means alone, so these are multiplied once. An average is never
    over what it is made of: a cluster that is similar to none is done with, and only the others are looked at again.
    """
    size, into, ids, g = size.astype("float64"), np.arange(len(means)), np.arange(len(means)), means @ means.T
    while len(ids) > 1:
        np.fill_diagonal(g, -1)
        mate = g.argmax(axis=1)
        near = g[np.arange(len(ids)), mate] >= least
        # pairs that are each other's nearest merge together
        pair = np.flatnonzero((mate[mate] == np.arange(len(ids))) & (np.arange(len(ids)) < mate) & near)
        if not len(pair):
            break
        other = mate[pair]
        share = (size[other] / (size[pair] + size[other])).astype("float32")
        g[pair] += share[:, None] * (g[other] - g[pair])
        g[:, pair] += share * (g[:, other] - g[:, pair])
        size[pair] += size[other]
        into[ids[other]] = ids[pair]
        near[other] = False
        rest = np.flatnonzero(near)
        ids, size, g = ids[rest], size[rest], g[np.ix_(rest, rest)]
    while (into[into] != into).any():
        into = into[into]
    return np.unique(into, return_inverse=True)[1]


PARTS = "fragment bigint, size bigint, first bigint, mean binary, members array<bigint>"


def similarity_clusters(vectors: DataFrame, least: float = 0.5, sure: float | None = None, dims: int = 512, cell_rows: int = 3000, block_rows: int = 4000, most_cells: int = 4096, meet: int = 4, most_merges: int = 60, width: int | None = None, seed: int = 3) -> DataFrame:
    """(cluster_id, id): all members of clusters of two or more, cluster_id being the smallest id among them.

    vectors: id, version, vector; other columns are ignored. The latest version of an id counts (a NULL version is the
    oldest); what isn't a vector of ``dims`` finite elements that aren't all zero is in no cluster; lengths don't
    matter; copies are similar like others. Records join where their average similarity is at least ``sure`` (``least``
    and 0.08); a record on its own joins its most similar fragment from ``least`` on. Records similar to no other are in
    no cluster. No vectors give no rows.

    Who meets whom is decided on features hashed to ``width`` places (half of the elements): fragments meet in the
    ``meet`` cells nearest to them, and later in twice as many. That isn't certain to bring all together that belong
    together; with ``meet`` as large as ``most_cells`` all meet all. Merging goes on until nothing moves; should it not
    end after ``most_merges`` rounds, this fails.
    """
    spark = vectors.sparkSession
    sure = least + 0.08 if sure is None else sure
    width = width or 1 << max(0, (dims // 2 - 1).bit_length())
    points = cut(units_of(vectors, dims))
    n, weights = spread_weights(points, dims)
    features = lambda units: hashed_features(restored(units), width, weights)
    k = int(min(most_cells, max(1, -(-n // cell_rows))))
    centroids = oversampled_centroids(points, k, n, features, seed=seed) if k > 1 else np.zeros((1, width), "float32")
    k = len(centroids)
    shared = spark.sparkContext.broadcast(centroids)

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(cell=_nearest(features(frame["unit"]), shared.value)[1] if len(frame) else [])

    placed = points.mapInPandas(place, "id bigint, unit binary, cell bigint") if k > 1 else points.withColumn("cell", F.lit(0).cast("bigint"))
    blocks = placed.groupBy("cell").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("blocks"))  # a row per cell
    placed = placed.join(F.broadcast(blocks), "cell").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))

    def split(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("id", ignore_index=True)
        x, ids = restored(frame["unit"]), frame["id"].to_numpy()
        label = local_clusters(x, sure, np.random.default_rng(seed))
        order = np.argsort(label, kind="stable")
        _, first = np.unique(label[order], return_index=True)
        size = np.diff(np.append(first, len(label)))
        means = np.add.reduceat(x[order], first) / size[:, None]
        members = np.split(ids[order], first[1:])
        return pd.DataFrame({"fragment": [m.min() for m in members], "size": size, "first": [m.min() for m in members], "mean": [r.tobytes() for r in quantized(means)], "members": members})

    # a fragment is named by its smallest member; it has at most block_rows of them
    fragments = cut(placed.groupBy("cell", "block").applyInPandas(split, PARTS))

    def invite(frames: Iterator[pd.DataFrame], m: int) -> Iterator[pd.DataFrame]:
        for frame in frames:
            s = features(frame["mean"]) @ shared.value.T if len(frame) else np.zeros((0, k))
            cells = np.argpartition(-s, m - 1, axis=1)[:, :m] if m < k else np.tile(np.arange(k), (len(frame), 1))
            row = np.repeat(np.arange(len(frame)), m)
            yield pd.DataFrame({"cell": cells.ravel(), "fragment": frame["fragment"].to_numpy()[row], "size": frame["size"].to_numpy()[row], "mean": frame["mean"].to_numpy()[row]})

    def join(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("fragment", ignore_index=True)
        x, size, ids = restored(frame["mean"]), frame["size"].to_numpy(), frame["fragment"].to_numpy()
        a, b, value = [], [], []
        big, lone = np.flatnonzero(size > 1), np.flatnonzero(size == 1)
        for lo in range(0, len(lone), 2048):
            rows = lone[lo : lo + 2048]
            s = x[rows] @ x.T
            s[np.arange(len(rows)), rows] = -1
            # a record alone offers itself to its most similar fragment; larger ones are linked below
            best = s.argmax(axis=1)
            top = s[np.arange(len(rows)), best]
            near = top >= least
            a.append(ids[rows[near]])
            b.append(ids[best[near]])
            value.append(np.round(top[near], 5))
        if len(big) > 1:
            label = _merged(x[big], size[big].astype("float64"), sure)
            order = np.argsort(label, kind="stable")
            firsts = np.unique(label[order], return_index=True)[1]
            lead = np.repeat(order[firsts], np.diff(np.append(firsts, len(order))))
            linked = order != lead
            a.append(ids[big[order[linked]]])
            b.append(ids[big[lead[linked]]])
            value.append(np.full(linked.sum(), 2.0, "float32"))
        cat = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind)
        return pd.DataFrame({"a": cat(a, "int64"), "b": cat(b, "int64"), "s": cat(value, "float64")})

    def merged(pieces: DataFrame, m: int) -> DataFrame:
        """(fragment, set) of the pieces that join others they meet in ``m`` cells, in pairs of blocks where a cell has many."""
        guests = pieces.mapInPandas(lambda frames: invite(frames, m), "cell bigint, fragment bigint, size bigint, mean binary")
        crowds = pieces.select("fragment", "mean").mapInPandas(lambda frames: (f[["cell"]] for f in invite((g.assign(size=0) for g in frames), m)), "cell bigint")
        crowds = crowds.groupBy("cell").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("parts"))  # a row per cell
        guests = guests.join(F.broadcast(crowds), "cell").withColumn("own", F.pmod(F.xxhash64("fragment"), F.col("parts")).cast("int"))
        guests = guests.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        guests = guests.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).drop("parts", "own", "other")
        met = cut(guests.groupBy("cell", "i", "j").applyInPandas(join, "a bigint, b bigint, s double"))
        offers = met.where("s <= 1.5").withColumn("rank", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("s"), "b"))).where("rank = 1")
        return group_pairs(met.where("s > 1.5").select("a", "b").union(offers.select("a", "b"))).withColumnsRenamed({"node": "fragment", "group_id": "set"})

    def average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                n = batch.column("n").to_numpy(zero_copy_only=False)
                means = totals(batch.column("sum").to_pylist()) / n[:, None]
                yield pa.RecordBatch.from_arrays([batch.column("set"), batch.column("n"), packed(quantized(means))], names=["fragment", "size", "mean"])

    # records that were alone may make sets that are similar to others: merge until nothing moves
    owned, pieces = fragments.select("fragment", "size", "mean", F.col("fragment").alias("set")), fragments.select("fragment", "size", "mean")
    for number in range(most_merges + 1):
        # later there are fewer pieces, which can look further
        groups = cut(merged(pieces, min(k, meet if number == 0 else 2 * meet)))
        if groups.isEmpty():
            break
        if number == most_merges:
            raise RuntimeError(f"clusters still merge after {most_merges} rounds")
        renamed = groups.select(F.col("fragment").alias("set"), F.col("set").alias("into"))
        owned = cut(owned.join(renamed, "set", "left").select("fragment", "size", "mean", F.coalesce("into", "set").alias("set")))
        pieces = cut(sums_by(owned, "set", "size", "mean", restored).mapInArrow(average, "fragment bigint, size bigint, mean binary"))

    sums = sums_by(owned, "set", "size", "mean", restored)
    several = owned.where(F.col("fragment") != F.col("set")).select("set").distinct()
    several = owned.join(several, "set", "left_semi")

    @F.pandas_udf("double")
    def rest(mean: pd.Series, size: pd.Series, sums: pd.Series, n: pd.Series) -> pd.Series:
        x, own, all_ = restored(mean), size.to_numpy("float64"), n.to_numpy("float64")
        s = totals(sums)
        product, square = (x * s).sum(axis=1), (x * x).sum(axis=1)
        return pd.Series((product - own * square) / np.maximum(all_ - own, 1))

    # the check: a fragment that isn't similar to the rest of its set on average stays by itself
    kept = several.join(sums, "set").withColumn("fits", rest("mean", "size", "sum", "n") >= least)
    kept = kept.select("fragment", F.when(F.col("fits"), F.col("set")).otherwise(F.col("fragment")).alias("own"))
    final = fragments.select("fragment", "members").join(kept, "fragment", "left").select(F.coalesce("own", "fragment").alias("own"), F.explode("members").alias("id"))
    sized = final.groupBy("own").agg(F.min("id").alias("cluster_id"), F.count("*").alias("n")).where("n > 1")
    return final.join(sized, "own").select("cluster_id", "id")


def typical_members(vectors: DataFrame, clusters: DataFrame, top: int = 3, dims: int = 512) -> DataFrame:
    """(cluster_id, size, typical): each cluster's size and the ids of its ``top`` members nearest to its centroid.

    Ties go to the smaller id. Members without a vector are counted, but aren't typical.
    """
    points = clusters.join(units_of(vectors, dims), "id").withColumns({"salt": F.pmod(F.xxhash64("id"), F.lit(32)), "one": F.lit(1)})
    sums = sums_by(points, "cluster_id", "one", "unit", restored).drop("n")

    @F.pandas_udf("double")
    def near(unit: pd.Series, sums: pd.Series) -> pd.Series:
        return pd.Series((restored(unit) * totals(sums)).sum(axis=1))

    scored = points.select("cluster_id", "id", "salt", "unit").join(sums, "cluster_id").select("cluster_id", "id", "salt", F.round(near("unit", "sum"), 4).alias("s"))
    for key in (["cluster_id", "salt"], ["cluster_id"]):  # the best of each salt first
        scored = scored.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("s"), "id"))).where(F.col("rank") <= top)
    best = scored.groupBy("cluster_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]).alias("typical"))
    return clusters.groupBy("cluster_id").agg(F.count("*").alias("size")).join(best, "cluster_id", "left")
