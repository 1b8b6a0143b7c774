"""Similarity joins of vectors: exact in blocks, or approximate by hashing to the axes of turned crosses."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shoebox.functions.vec import inner_with, is_vector
from shoebox.operators.blocks import Blocks, Side, marked, over_files, over_pairs, side, store, without
from shoebox.operators.graph import components
from shoebox.session import cut

def _raw(vectors: DataFrame) -> DataFrame:
    """(id, dims, raw): the vectors as bytes of their own type; what isn't a vector is left out."""
    kind = vectors.schema["vector"].dataType.elementType.simpleString()
    width = {"float": 4, "double": 8}[kind]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("vector")
            size = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype("int32")
            data = np.ascontiguousarray(column.flatten().to_numpy(zero_copy_only=False)).view("uint8")
            ends = np.append(0, np.cumsum(size.astype("int64") * width))
            raw = pa.array([data[a:b].tobytes() for a, b in zip(ends, ends[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(size), raw], names=["id", "dims", "raw"])

    rows = vectors.where(F.col("id").isNotNull() & is_vector(F.col("vector")))
    # written once, as sizes and buckets are both made of it
    return cut(rows.select("id", "vector").mapInArrow(pack, "id bigint, dims int, raw binary")).withColumn("kind", F.lit(f"f{width}"))


#: Elements are tried in steps of so many; a tile of the table of cosines is compared by a first part of the elements only
#: if at most SOME of its pairs get past that in vain, and pair by pair if at most MANY do.
STEP, SOME, MANY = 32, 2e-4, 0.02


def _first_part(x: np.ndarray, y: np.ndarray, limit: float) -> int:
    """How many first elements of unit vectors rule out nearly all pairs that lie below the limit: tried on some of them."""
    x, y = x[:: max(1, len(x) // 256)], y[max(1, len(y) // 256) // 2 :: max(1, len(y) // 256)]
    dims, s, below = x.shape[1], np.zeros((len(x), len(y)), "float32"), x @ y.T < limit
    for k in range(STEP, dims, STEP):
        s += x[:, k - STEP : k] @ y[:, k - STEP : k].T
        rest = [np.sqrt((v[:, k:] * v[:, k:]).sum(axis=1)) for v in (x, y)]
        if ((s + rest[0][:, None] * rest[1] >= limit) & below).mean() <= SOME:
            return k
    return dims


class _Tiles:
    """Which pairs of two groups lie over a limit, by tiles of the table of their cosines.

    Products are taken in four bytes, and of the first elements only where these rule out nearly all pairs: the rest of
    two vectors adds at most the product of its lengths, which is taken as one element more. What comes within the
    error of four bytes of the limit is decided by the cosine in eight bytes.
    """

    def __init__(self, left: Side, right: Side, least: float, strict: bool):
        self.left, self.right, self.least, self.strict = left, right, least, strict
        self.dims = left.unit.shape[1]
        self.margin = 1e-5 + 2.5e-7 * self.dims
        self.limit = np.float32(least - self.margin)
        self.k = _first_part(left.unit, right.unit, self.limit) if len(left.ids) and len(right.ids) else self.dims

    def over(self, value: np.ndarray) -> np.ndarray:
        return value > self.least if self.strict else value >= self.least

    def __iter__(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray | None]]:
        """(places on the left, on the right, cosines in four bytes or None) of all pairs that may lie over the limit."""
        x, y, k = self.left.unit, self.right.unit, self.k
        if k < self.dims:
            x, y = (np.concatenate([v[:, :k], np.sqrt((v[:, k:] * v[:, k:]).sum(axis=1))[:, None]], axis=1) for v in (x, y))
        for lo in range(0, len(x), 1024):
            for at in range(0, len(y), 4096):
                s = x[lo : lo + 1024] @ y[at : at + 4096].T
                rows = np.flatnonzero(s.max(axis=1) >= self.limit)
                r, c = np.nonzero(s[rows] >= self.limit)
                if k < self.dims and len(r) > MANY * s.size:
                    s = self.left.unit[lo : lo + 1024] @ self.right.unit[at : at + 4096].T
                    rows = np.arange(len(s))
                    r, c = np.nonzero(s >= self.limit)
                    yield r + lo, c + at, s[r, c]
                else:
                    yield rows[r] + lo, c + at, s[rows[r], c] if k == self.dims else None

    def cosines(self, r: np.ndarray, c: np.ndarray) -> np.ndarray:
        out = np.empty(len(r))
        for some in (slice(n, n + 2048) for n in range(0, len(r), 2048)):
            out[some] = np.einsum("ij,ij->i", self.left.exact(r[some]), self.right.exact(c[some]))
        return out

    def true(self, r: np.ndarray, c: np.ndarray, value: np.ndarray | None) -> np.ndarray:
        """Which of these pairs lie over the limit; ``value``: their cosines in four bytes, if known."""
        if value is None:
            value = np.empty(len(r), "float32")
            for some in (slice(n, n + 2048) for n in range(0, len(r), 2048)):
                value[some] = np.einsum("ij,ij->i", self.left.unit[r[some]], self.right.unit[c[some]])
        out = value >= self.least + self.margin
        doubt = np.flatnonzero(np.abs(value - self.least) <= 2 * self.margin)
        out[doubt] = self.over(self.cosines(r[doubt], c[doubt]))
        return out


def _near(left: Side, right: Side, same: bool, least: float, strict: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Slices of (place on the left, place on the right) of pairs over the limit; within a group each pair once."""
    tiles = _Tiles(left, right, least, strict)
    for r, c, value in tiles:
        p, q = left.ids[r], right.ids[c]
        once = p < q if same else p != q
        r, c, value = r[once], c[once], None if value is None else value[once]
        over = tiles.true(r, c, value)
        yield r[over], c[over]


def _frame(schema: str, *columns: list[np.ndarray]) -> pd.DataFrame:
    kinds = [x.split() for x in schema.split(", ")]
    numpy_kind = {"bigint": "int64", "double": "float64"}
    return pd.DataFrame({name: (np.concatenate(c) if c else np.zeros(0)).astype(numpy_kind[kind]) for (name, kind), c in zip(kinds, columns)})


PAIRS = "a bigint, b bigint, cosine double"


def _connecting(label: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Which of the links (u, v) connect what all connect and ``label`` doesn't yet; ``label`` is brought up to date."""
    kept, at = [], np.arange(len(u))
    while True:
        a, b = label[u[at]], label[v[at]]
        at, a, b = at[a != b], np.minimum(a, b)[a != b], np.maximum(a, b)[a != b]
        if not len(at):
            return np.sort(np.concatenate(kept)) if kept else np.zeros(0, "int64")
        # each label is led to one smaller label: no circles
        _, first = np.unique(b, return_index=True)
        kept.append(at[first])
        lead = np.arange(len(label))
        lead[b[first]] = a[first]
        while (lead != lead[lead]).any():
            lead = lead[lead]
        label[:] = lead[label]


def _forest(left: Side, right: Side, least: float, strict: bool, known: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Slices of places of pairs over the limit that connect what all would connect; pairs connected so far aren't looked at.

    With ``known`` vectors of one mark are connected from the start.
    """
    _, number = np.unique(np.append(*((x.marks if known else x.ids) for x in (left, right))), return_inverse=True)
    label, of_left, of_right = np.arange(len(number)), number[: len(left.ids)], number[len(left.ids) :]
    tiles = _Tiles(left, right, least, strict)
    for r, c, value in tiles:
        for trial in range(4):
            a, b = label[of_left[r]], label[of_right[c]]
            apart = np.flatnonzero(a != b)
            if not len(apart):
                break
            r, c, value, b = r[apart], c[apart], None if value is None else value[apart], np.maximum(a, b)[apart]
            # first one pair for each label, which mostly settles the others; at last all that are left
            some = np.unique(b, return_index=True)[1] if trial < 3 else np.arange(len(r))
            over = some[tiles.true(r[some], c[some], None if value is None else value[some])]
            kept = over[_connecting(label, of_left[r[over]], of_right[c[over]])]
            yield r[kept], c[kept]
            rest = np.ones(len(r), bool)
            rest[some] = False
            r, c, value = r[rest], c[rest], None if value is None else value[rest]


def _pairs_of(least: float, strict: bool, forest: bool, known: bool = False) -> Callable[[Side, Side, bool], pd.DataFrame]:
    def pairs(left: Side, right: Side, same: bool) -> pd.DataFrame:
        p, q, out = left.ids, right.ids, ([], [], [])
        tiles = _Tiles(left, right, least, strict)
        for r, c in _forest(left, right, least, strict, known) if forest else _near(left, right, same, least, strict):
            for column, part in zip(out, (np.minimum(p[r], q[c]), np.maximum(p[r], q[c]), tiles.cosines(r, c))):
                column.append(part)
        return _frame(PAIRS, *out)

    return pairs


def cosine_pairs(vectors: DataFrame, least: float, strict: bool = False, forest: bool = False, block: int = 4096) -> DataFrame:
    """(a, b, cosine): all pairs a < b of ``vectors`` (id, vector) with a cosine of at least (``strict``: above) ``least``.

    The vectors are written once, in blocks of at most ``block``; each task reads two groups of them, compares these by
    matrix products and gives only pairs over the limit. With ``forest`` it gives only as many of them as connect what
    all would connect: for components. NULL and zero vectors and vectors with NULL or NaN are similar to nothing, nor are
    vectors of different lengths. This is the exact join: its work grows with the square of the vectors, its disk
    doesn't; that of ``approximate_pairs`` is less where vectors are many.
    """
    return near_pairs(store(vectors, block), least, strict, forest)


def near_pairs(blocks: Blocks, least: float, strict: bool = False, forest: bool = False) -> DataFrame:
    """``cosine_pairs`` of stored vectors."""
    return over_pairs(blocks, _pairs_of(least, strict, forest), PAIRS)


#: Links to so many vectors are looked for before all are compared (32 MB at 512 elements), so many times.
PIVOTS, ROUNDS = 8192, 2


def _to_pivots(blocks: Blocks, least: float, strict: bool, most: int) -> DataFrame:
    """(a, b): true links of stored vectors, each to the nearest of ``most`` of them, and among these what connects them."""
    picked = blocks.rows.where("_file is not null").select("id").orderBy(F.xxhash64("id"), "id").limit(most).collect()
    wanted, spark = np.array(sorted(r["id"] for r in picked), "int64"), blocks.rows.sparkSession

    def take(given: Side) -> pd.DataFrame:
        at = np.flatnonzero(np.isin(given.ids, wanted))
        raw = given.raw[at]
        return pd.DataFrame({"dims": [raw.shape[1]], "kind": [raw.dtype.str], "ids": [given.ids[at].tobytes()], "raw": [raw.tobytes()]})

    parts: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    for r in over_files(blocks, take, "dims bigint, kind string, ids binary, raw binary").collect():  # at most ``most`` vectors
        parts.setdefault(r["dims"], []).append((np.frombuffer(r["ids"], "int64"), np.frombuffer(r["raw"], r["kind"]).reshape(-1, r["dims"])))
    shared = spark.sparkContext.broadcast({d: tuple(np.concatenate(x) for x in zip(*own)) for d, own in parts.items()})

    def pivots(dims: int) -> Side:
        ids, raw = shared.value[dims]
        return side(ids, raw, ids)

    def task(given: Side) -> pd.DataFrame:
        to = pivots(given.raw.shape[1])
        out: tuple[list, list] = ([], [])
        if len(to.ids):
            tiles = _Tiles(given, to, least, strict)
            for lo in range(0, len(given.ids), 1024):
                s = given.unit[lo : lo + 1024] @ to.unit.T
                s[given.ids[lo : lo + 1024, None] == to.ids[None, :]] = -2
                c = s.argmax(axis=1)
                value = s[np.arange(len(s)), c]
                r = np.flatnonzero(value >= tiles.limit)
                r = r[tiles.true(lo + r, c[r], value[r])]
                out[0].append(given.ids[lo + r])
                out[1].append(to.ids[c[r]])
        return _frame(LINKS, *out)

    def among(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dims in batch.column("id").to_pylist():
                own, out = pivots(dims), ([], [])
                for r, c in _forest(own, own, least, strict):
                    out[0].append(own.ids[r])
                    out[1].append(own.ids[c])
                yield pa.RecordBatch.from_pandas(_frame(LINKS, *out), preserve_index=False)

    lengths = spark.createDataFrame([(d,) for d, own in parts.items() if sum(len(i) for i, _ in own)], "id bigint")
    return over_files(blocks, task, LINKS).union(lengths.mapInArrow(among, LINKS))


LINKS = "a bigint, b bigint"


def _copies(blocks: Blocks) -> DataFrame:
    """(a, b): the first of the stored vectors that are equal byte by byte, with each other one; ``blocks`` have hashes."""
    hashed = blocks.rows.where("_file is not null").select("id", "_hash")
    first = hashed.groupBy("_hash").agg(F.min("id").alias("a"), F.count("*").alias("n")).where("n > 1")
    return cut(hashed.join(first, "_hash").where("id <> a").select("a", F.col("id").alias("b")))


def links(blocks: Blocks, least: float, strict: bool = False, pivots: int = PIVOTS) -> DataFrame:
    """(a, b): pairs of stored vectors over the limit that connect what all such pairs connect, about as many as vectors.

    The forests of all pairs of groups of blocks would hold a large component once for each group. So links to some
    vectors are looked for first, then to some of those that have none, and what these connect is known when all are
    compared: only pairs that connect more come out of that. Where ``blocks`` have hashes, of equal vectors one is
    compared, and the others are linked to it. It is as exact as ``cosine_pairs``.
    """
    if sum(n for _, _, n in blocks.files) <= blocks.block:
        return near_pairs(blocks, least, strict, forest=True).select("a", "b")

    def less(blocks: Blocks, ids: DataFrame) -> Blocks:
        return without(blocks, ids)._replace(rows=blocks.rows.join(ids, "id", "left_anti"))

    equal = None
    if "_hash" in blocks.rows.columns and least < 1 - 1e-9:  # beyond that the cosine of equal vectors may round to less
        equal = _copies(blocks)
        blocks = less(blocks, equal.select(F.col("b").alias("id")))
        blocks = blocks._replace(rows=cut(blocks.rows.drop("_hash")))
    left, found = blocks, []
    for _ in range(ROUNDS):
        if not left.files:
            break
        found.append(cut(_to_pivots(left, least, strict, pivots)))
        ends = found[-1].select(F.explode(F.array("a", "b")).alias("id")).distinct()
        left = less(left, ends) if len(found) < ROUNDS else left
    some = functools.reduce(DataFrame.union, found)
    joined = components(some).select(F.col("node").alias("id"), "component")
    marks = blocks.rows.where("_file is not null").select("id").join(joined, "id", "left").select("id", F.coalesce("component", "id").alias("mark"))
    more = over_pairs(marked(blocks, marks), _pairs_of(least, strict, True, known=True), PAIRS).select("a", "b")
    return cut(functools.reduce(DataFrame.union, [some, more, *[equal] * (equal is not None)]))


NEAREST = "id bigint, other bigint, cosine double"


def nearest(vectors: DataFrame, k: int, least: float, block: int = 4096) -> DataFrame:
    """(id, other, cosine, rank): of each of ``vectors`` (id, vector) its ``k`` most similar with at least ``least``.

    Ties go to the smaller id. Each pair of blocks gives at most ``k`` partners for each vector, so that what comes out
    of it doesn't grow with how many are similar.
    """

    def best_of(s: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        # identical vectors must tie, in whatever order the products are added; ids ascend
        s = np.round(s, 12)
        last = np.partition(s, -k, axis=1)[:, -k] if s.shape[1] > k else np.full(len(s), -2.0)
        r, c = np.nonzero((s >= last[:, None]) & (s >= least - 1e-12))
        order = np.lexsort((ids[c], -s[r, c], r))
        r, c = r[order], c[order]
        first = np.arange(len(r)) - np.searchsorted(r, r) < k
        return r[first], c[first]

    def task(left: Side, right: Side, same: bool) -> pd.DataFrame:
        out: tuple[list, list, list] = ([], [], [])
        for one, other in [(left, right)] if same else [(left, right), (right, left)]:
            p, q = one.ids, other.ids
            best: tuple[list, list, list] = ([], [], [])
            for at in range(0, len(q), 4096):
                y = other.exact(slice(at, at + 4096))
                for lo in range(0, len(p), 1024):
                    s = one.exact(slice(lo, lo + 1024)) @ y.T
                    s[p[lo : lo + 1024, None] == q[None, at : at + 4096]] = -2
                    r, c = best_of(s, q[at : at + 4096])
                    for column, part in zip(best, (p[lo + r], q[at + c], s[r, c])):
                        column.append(part)
            for column, part in zip(out, best):
                column.extend(part)
        return _frame(NEAREST, *out)

    found = over_pairs(store(vectors, block), task, NEAREST)
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc(F.round("cosine", 12)), "other"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def neighbour_counts(vectors: DataFrame, least: float, block: int = 4096) -> DataFrame:
    """(id, n): how many others each of ``vectors`` (id, vector) has with a cosine of at least ``least``; none gives no row."""

    def task(left: Side, right: Side, same: bool) -> pd.DataFrame:
        n, m = np.zeros(len(left.ids), "int64"), np.zeros(len(right.ids), "int64")
        for r, c in _near(left, right, same, least, False):
            n += np.bincount(r, minlength=len(n))
            m += np.bincount(c, minlength=len(m))
        ids, counts = np.append(left.ids, right.ids), np.append(n, m)
        return pd.DataFrame({"id": ids[counts > 0], "n": counts[counts > 0]})

    return over_pairs(store(vectors, block), task, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))


def least_marks(vectors: DataFrame, least: float, block: int = 4096) -> DataFrame:
    """(id, mark): for each of ``vectors`` (id, vector, mark) with a negative mark the smallest other mark near it."""

    def task(left: Side, right: Side, same: bool) -> pd.DataFrame:
        ids, marks = [], []
        for r, c in _near(left, right, same, least, False):
            for at, of, mine, its in ((left, right, r, c), (right, left, c, r)):
                asks = (at.marks[mine] < 0) & (of.marks[its] >= 0)
                ids.append(at.ids[mine[asks]])
                marks.append(of.marks[its[asks]])
        found = _frame("id bigint, mark bigint", ids, marks)
        return found.groupby("id", as_index=False)["mark"].min()

    return over_pairs(store(vectors, block, "mark"), task, "id bigint, mark bigint").groupBy("id").agg(F.min("mark").alias("mark"))


@functools.lru_cache(maxsize=128)
def _rotation(dims: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, dims)))
    return (q * np.sign(np.diag(r))).astype("float32")


def _axes(x: np.ndarray, number: int, depth: int, seed: int) -> np.ndarray:
    """The bucket of each row in one table: the nearest of the axes of ``depth`` turned crosses, each axis both ways."""
    out = np.zeros(len(x), "int64")
    for d in range(depth):
        turned = x @ _rotation(x.shape[1], seed + 64 * number + d)
        at = np.abs(turned).argmax(axis=1)
        out = out * 2 * x.shape[1] + at * 2 + (turned[np.arange(len(x)), at] < 0)
    return out


def tables_for(least: float, dims: int, depth: int, recall: float, seed: int = 5) -> int:
    """How many tables let a pair at the limit share a bucket with probability ``recall``: tried on random pairs."""
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((2000, dims))
    x /= np.sqrt((x * x).sum(axis=1))[:, None]
    away = rng.standard_normal((2000, dims))
    away -= (away * x).sum(axis=1)[:, None] * x
    away /= np.sqrt((away * away).sum(axis=1))[:, None]
    y = least * x + np.sqrt(max(0.0, 1 - least * least)) * away
    share = max(1e-4, float((_axes(x, 0, depth, seed) == _axes(y, 0, depth, seed)).mean()))
    return 1 if share >= recall else int(np.ceil(np.log(1 - recall) / np.log(1 - share)))


def approximate_pairs(vectors: DataFrame, least: float, recall: float = 0.98, forest: bool = False, block: int = 4096, seed: int = 5) -> DataFrame:
    """(a, b, cosine): as ``cosine_pairs``, but a pair just at the limit is found with probability ``recall`` only.

    Vectors are hashed to the nearest axis of randomly turned crosses, in as many tables as the wanted recall takes, with
    more crosses to a table the more vectors there are; only vectors that share a bucket are compared, exactly. Buckets
    of more than ``block`` vectors are compared in pairs of blocks. Vectors of another length are compared apart.
    """
    rows = _raw(vectors)
    # (dims, tables, depth): a row per length; buckets hold some thousands of vectors each
    plan = []
    for r in rows.groupBy("dims").agg(F.count("*").alias("n")).collect():
        depth = max(1, int(np.ceil(np.log(max(r["n"] / block, 1)) / np.log(2 * r["dims"])))) if r["dims"] > 1 else 1
        plan.append((r["dims"], tables_for(least, r["dims"], depth, recall, seed), depth))
    shape = {d: (t, depth) for d, t, depth in plan}

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dims").to_numpy(zero_copy_only=False)
            for d in np.unique(dims):
                own = batch.take(pa.array(np.flatnonzero(dims == d)))
                x = np.frombuffer(b"".join(own.column("raw").to_pylist()), own.column("kind")[0].as_py()).reshape(-1, d).astype("float64")
                tables, depth = shape[int(d)]
                for number in range(tables):
                    columns = [own.column("id"), own.column("dims"), pa.array(np.full(len(x), number, "int32")), pa.array(_axes(x, number, depth, seed))]
                    yield pa.RecordBatch.from_arrays(columns, names=["id", "dims", "number", "bucket"])

    keys = cut(rows.select("id", "dims", "raw", "kind").mapInArrow(hashed, "id bigint, dims int, number int, bucket bigint"))
    sizes = keys.groupBy("dims", "number", "bucket").agg(F.count("*").alias("size")).where("size > 1")
    placed = keys.join(sizes, ["dims", "number", "bucket"]).withColumn("blocks", F.ceil(F.col("size") / block).cast("int"))
    placed = placed.withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).drop("size", "blocks", "other")
    task = _pairs_of(least, False, forest)

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        x = np.frombuffer(b"".join(frame["raw"]), frame["kind"].iloc[0]).reshape(len(frame), -1)
        ids, own = frame["id"].to_numpy(), frame["own"].to_numpy()
        i, j = int(frame["i"].iloc[0]), int(frame["j"].iloc[0])
        left = side(ids[own == i], x[own == i], own[own == i])
        return task(left, left if i == j else side(ids[own == j], x[own == j], own[own == j]), i == j)

    found = placed.join(rows.select("id", "raw", "kind"), "id").groupBy("dims", "number", "bucket", "i", "j").applyInPandas(compare, PAIRS)
    return found.groupBy("a", "b").agg(F.max("cosine").alias("cosine"))


def top_similar(vectors: DataFrame, query: list[float], k: int) -> DataFrame:
    """(id, similarity): the ``k`` vectors most similar to one; ties go to the smaller id."""
    length = float(np.sqrt(np.square(np.asarray(query, "float64")).sum()))
    unit = [float(x) / length for x in query] if length else [0.0] * len(query)
    rows = vectors.where(is_vector(F.col("vector"))).select("id", inner_with(F.col("vector"), unit, 0.0).alias("similarity"))
    scored = rows.where(F.col("similarity").isNotNull())
    return scored.orderBy(F.desc("similarity"), "id").limit(k)
