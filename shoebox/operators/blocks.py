"""Vectors in files of blocks that tasks read by themselves, so that comparing all with all moves and copies nothing.

Each vector is written once, where it is read, to the folder of ``spark.checkpoint.dir``; a task of a join reads the blocks
it compares. So the disk a join takes is that of its vectors, not that times the number of blocks.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pf
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoebox.session import cut, shared_folder


class Side(NamedTuple):
    """Vectors of one length, by id: as they are, scaled to length one in four bytes, one over their length, and marks."""

    ids: np.ndarray
    raw: np.ndarray
    unit: np.ndarray
    inverse: np.ndarray
    marks: np.ndarray

    def exact(self, rows: np.ndarray | slice) -> np.ndarray:
        """Rows scaled to length one in eight bytes."""
        return self.raw[rows].astype("float64") * self.inverse[rows][:, None]


def side(ids: np.ndarray, raw: np.ndarray, marks: np.ndarray) -> Side:
    order = np.argsort(ids, kind="stable")
    raw = raw[order]
    unit, inverse = np.empty(raw.shape, "float32"), np.empty(len(raw))
    for lo in range(0, len(raw), 1024):
        x = raw[lo : lo + 1024].astype("float64")
        inverse[lo : lo + 1024] = 1 / np.sqrt((x * x).sum(axis=1))
        unit[lo : lo + 1024] = x * inverse[lo : lo + 1024, None]
    return Side(ids[order], raw, unit, inverse, marks[order])


def _files(folder: str) -> tuple[pf.FileSystem, str]:
    """The file system of a folder that all executors share, as Python reads it."""
    if folder.startswith("file:") or "://" not in folder:
        return pf.LocalFileSystem(), "/" + folder.removeprefix("file:").lstrip("/")
    return pf.FileSystem.from_uri(folder.replace("s3a://", "s3://"))


def _good(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, which lists are vectors): no NULL, NaN or infinite elements, and not all zero."""
    size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype("int64")
    flat = column.flatten()
    x = flat.to_numpy(zero_copy_only=False)
    good = size > 0
    starts = (np.cumsum(size) - size)[good]
    if len(starts):
        fine = np.logical_and.reduceat(np.isfinite(x), starts)
        good[good] = fine & np.logical_or.reduceat(x != 0, starts)
    return size, good


class Blocks(NamedTuple):
    """Stored vectors. ``rows``: a row for each id, vector or not, with its file and place there; ``files``: (file, dims, n)."""

    folder: str
    rows: DataFrame
    files: list[tuple[str, int, int]]
    block: int


def store(vectors: DataFrame, block: int = 4096, mark: str | None = None, *carried: str, hashed: bool = False) -> Blocks:
    """Write ``vectors`` (id, vector) with the numbers of column ``mark`` as blocks of at most ``block`` of one length.

    The columns ``carried`` go along in ``rows``, so that vectors that take a shuffle to make are made once. With
    ``hashed`` rows have a hash of 16 bytes of their vector, too. Rows without id are left out. What the driver gets is a
    row for each block.
    """
    folder = shared_folder(vectors.sparkSession)
    marks = F.lit(0).cast("bigint") if mark is None else F.col(mark).cast("bigint")
    given = vectors.where("id is not null").select("id", *carried, marks.alias("_mark"), "vector")
    kept = ["id", *carried]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.select(*kept).schema) + ", _file string, _place int, _dims int" + ", _hash binary" * hashed

    def batch_of(rows: pa.Table | pa.RecordBatch, *own: pa.Array) -> pa.RecordBatch:
        columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in (rows.column(n) for n in kept)]
        return pa.RecordBatch.from_arrays([*columns, *own], names=[*kept, "_file", "_place", "_dims", *["_hash"] * hashed])

    def hashes(vectors: pa.ChunkedArray, n: int) -> pa.Array:
        x = np.ascontiguousarray(vectors.combine_chunks().flatten().to_numpy(zero_copy_only=False)).reshape(n, -1)
        return pa.array([hashlib.blake2b(row, digest_size=16).digest() for row in x], pa.binary())

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = _files(folder)
        held: dict[int, list[pa.RecordBatch]] = {}

        def flush(dims: int, least: int) -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(held.pop(dims))
            at = 0
            while rows.num_rows - at >= least:
                part = rows.slice(at, block)
                name = uuid.uuid4().hex
                with files.open_output_stream(f"{path}/{name}") as out:
                    pq.write_table(part.select(["id", "_mark", "vector"]), out, compression="zstd")
                n = part.num_rows
                own = [hashes(part.column("vector"), n)] if hashed else []
                yield batch_of(part, pa.array([name] * n), pa.array(np.arange(n, dtype="int32")), pa.array(np.full(n, dims, "int32")), *own)
                at += n
            if at < rows.num_rows:
                held[dims] = rows.slice(at).to_batches()

        for batch in batches:
            size, good = _good(batch.column("vector"))
            bad = batch.take(pa.array(np.flatnonzero(~good)))
            if bad.num_rows:
                kinds = [pa.string(), pa.int32(), pa.int32(), *[pa.binary()] * hashed]
                yield batch_of(bad, *[pa.nulls(bad.num_rows, kind) for kind in kinds])
            for dims in np.unique(size[good]).tolist():
                held.setdefault(dims, []).append(batch.take(pa.array(np.flatnonzero(good & (size == dims)))))
                if sum(b.num_rows for b in held[dims]) >= block:
                    yield from flush(dims, block)
        for dims in list(held):
            yield from flush(dims, 1)

    rows = cut(given.mapInArrow(write, schema))
    found = rows.where("_file is not null").groupBy("_file", "_dims").agg(F.count("*").alias("n")).collect()
    return Blocks(folder, rows, sorted((r["_file"], r["_dims"], r["n"]) for r in found), block)


def _beside(blocks: Blocks, ids: DataFrame, kind: str, content: Callable[[pd.DataFrame], np.ndarray]) -> dict[str, tuple[str, int]]:
    """Put ``content`` of the places of ``ids`` (id, and more) beside the file of each: file -> (name, how many places)."""
    folder, name = blocks.folder, f"{kind}-{uuid.uuid4().hex}"

    def note(frame: pd.DataFrame) -> pd.DataFrame:
        files, path = _files(folder)
        frame = frame.drop_duplicates("_place").sort_values("_place")
        with files.open_output_stream(f"{path}/{frame['_file'].iloc[0]}-{name}") as out:
            out.write(content(frame).tobytes())
        return pd.DataFrame({"file": [frame["_file"].iloc[0]], "n": [len(frame)]})

    placed = blocks.rows.where("_file is not null").select("id", "_file", "_place").join(ids, "id").drop("id")
    return {r["file"]: (f"{r['file']}-{name}", r["n"]) for r in placed.groupBy("_file").applyInPandas(note, "file string, n int").collect()}


def without(blocks: Blocks, ids: DataFrame) -> Blocks:
    """``blocks`` less the vectors of ``ids`` (id), which are still among its rows: a list of places is put beside each file, the files stay."""
    less = _beside(blocks, ids.select("id").distinct(), "less", lambda frame: frame["_place"].to_numpy("int32"))
    files = []
    for f, dims, n in blocks.files:
        name, gone = less.get(f.split(" ")[0], ("", 0))
        files.append((f"{f} {name}".strip(), dims, n - gone))
    return blocks._replace(files=[x for x in files if x[2]])


def marked(blocks: Blocks, marks: DataFrame) -> Blocks:
    """``blocks`` with the numbers of ``marks`` (id, mark), a row for each vector: they are put beside each file."""
    found = _beside(blocks, marks.select("id", F.col("mark").cast("bigint").alias("mark")), "mark", lambda frame: frame["mark"].to_numpy("int64"))
    return blocks._replace(files=[(f"{f} {found[f.split(' ')[0]][0]}", dims, n) for f, dims, n in blocks.files])


def _load(folder: str, names: list[str]) -> Side:
    files, path = _files(folder)

    def numbers(name: str, kind: str) -> np.ndarray:
        with files.open_input_stream(f"{path}/{name}") as given:
            return np.frombuffer(given.read(), kind)

    parts = []
    for name in names:
        file, *others = name.split(" ")
        table = pq.read_table(f"{path}/{file}", filesystem=files, use_threads=False, partitioning=None)
        marks, at = table.column("_mark").to_numpy(), np.arange(table.num_rows)
        for other in others:
            if "-mark-" in other:
                marks = numbers(other, "int64")
            else:
                kept = ~np.isin(at, numbers(other, "int32"))
                marks, at = marks[kept], at[kept]
        if len(at) < table.num_rows:
            table = table.take(pa.array(at))
        raw = table.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)
        parts.append((table.column("id").to_numpy(), raw, marks))
    return side(*(np.concatenate(x) for x in zip(*parts)))


def over_files(blocks: Blocks, task: Callable[[Side], pd.DataFrame], schema: str) -> DataFrame:
    """``task`` on each block."""
    spark, folder, names = blocks.rows.sparkSession, blocks.folder, [f for f, _, _ in blocks.files]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number in batch.column("id").to_pylist():
                yield pa.RecordBatch.from_pandas(task(_load(folder, [names[number]])), preserve_index=False)

    return spark.range(0, len(names), 1, max(1, min(len(names), spark.sparkContext.defaultParallelism * 8))).mapInArrow(run, schema)


#: Tasks compare groups of up to so many blocks, fewer where that leaves too few tasks.
MOST_BLOCKS, LEAST_GROUPS = 4, 12


def over_pairs(blocks: Blocks, task: Callable[[Side, Side, bool], pd.DataFrame], schema: str) -> DataFrame:
    """``task`` on each pair of groups of blocks of one length; of a group with itself too."""
    spark, folder = blocks.rows.sparkSession, blocks.folder
    groups: list[list[str]] = []
    bounds: list[tuple[int, int]] = []  # of the groups of each length
    for dims in sorted({d for _, d, _ in blocks.files}):
        own = [(f, n) for f, d, n in blocks.files if d == dims]
        size, first, held = min(MOST_BLOCKS * blocks.block, max(blocks.block, sum(n for _, n in own) // LEAST_GROUPS)), len(groups), 0
        for file, n in own:
            if len(groups) == first or held + n > size:
                groups.append([])
                held = 0
            groups[-1].append(file)
            held += n
        bounds.append((first, len(groups)))
    # pairs are numbered by their first group: number starts[i] is that of i with itself
    ends = np.array([hi - i for lo, hi in bounds for i in range(lo, hi)], "int64")
    starts = np.cumsum(ends) - ends
    total = int(ends.sum())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: tuple[int, Side | None] = (-1, None)
        for batch in batches:
            for number in batch.column("id").to_pylist():
                i = int(np.searchsorted(starts, number, "right")) - 1
                j = i + number - int(starts[i])
                if kept[0] != i:
                    kept = (-1, None)
                    kept = (i, _load(folder, groups[i]))
                out = task(kept[1], kept[1] if i == j else _load(folder, groups[j]), i == j)
                yield pa.RecordBatch.from_pandas(out, preserve_index=False)

    parts = max(1, min(total, max(spark.sparkContext.defaultParallelism * 8, total // 8)))
    return spark.range(0, total, 1, parts).mapInArrow(run, schema)
