"""Faces and the persons they belong to."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shoebox.config import SearchConfig
from shoebox.functions.vec import is_vector, unit_if_long
from shoebox.operators.blocks import store
from shoebox.operators.graph import components, groups, numbered
from shoebox.operators.similarity import cosine_pairs, least_marks, links, neighbour_counts
from shoebox.session import cut


def usable_faces(faces: DataFrame, least_score: float = 0.5, least_norm: float = 1e-6) -> DataFrame:
    """Detections worth keeping: sure enough, with a vector that isn't next to zero."""
    from shoebox.functions.vec import norm

    return faces.where((F.col("det_score") >= least_score) & is_vector(F.col("embedding")) & (norm(F.col("embedding")) >= least_norm))


def centroids(faces: DataFrame) -> DataFrame:
    """(person_id, n, centroid): each person's mean vector, scaled to length one unless it is next to zero.

    The sums per element are combined before the shuffle, whatever the number of faces of a person.
    """
    rows = faces.where(F.col("person_id").isNotNull() & F.col("embedding").isNotNull()).select("person_id", F.posexplode("embedding").alias("p", "x"))
    means = rows.groupBy("person_id", "p").agg(F.avg(F.col("x").cast("double")).alias("m"), F.count("*").alias("n"))
    whole = means.groupBy("person_id").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("p", "m"))).alias("v"))
    return whole.select("person_id", "n", unit_if_long(F.transform("v", lambda s: s["m"])).alias("centroid"))


#: So many centroids are sent to all executors (32 MB at 512 elements); more are dealt to tasks.
SENT = 8192


def _units(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(rows, matrix): which lists hold numbers of one length, that of the first, scaled to length one unless next to zero."""
    size = pc.fill_null(pc.list_value_length(lists), -1).to_numpy(zero_copy_only=False)
    dims = size[0] if len(size) else 0
    rows = np.flatnonzero(size == dims)
    x = np.asarray(lists.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False), "float64").reshape(len(rows), -1 if dims else 0)
    length = np.sqrt((x * x).sum(axis=1))
    return rows, np.where(length > 1e-6, 1 / np.where(length > 1e-6, length, 1), 1.0)[:, None] * x


def _nearest_of(faces: np.ndarray, persons: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each face the nearest person and the distance; ``persons`` ascend, so that ties go to the smaller number."""
    who, distance = np.zeros(len(faces), "int64"), np.full(len(faces), 3.0)
    for lo in range(0, len(faces), 1024):
        d = 1 - np.clip(faces[lo : lo + 1024] @ centres.T, -1, 1)
        at = d.argmin(axis=1)
        who[lo : lo + 1024], distance[lo : lo + 1024] = persons[at], d[np.arange(len(d)), at]
    return who, distance


FOUND = "id bigint, d double, person_id bigint"


def assign(new_faces: DataFrame, centres: DataFrame, limit: float | None = None, sent: int = SENT, block: int = 16_384) -> DataFrame:
    """(id, person_id, distance): new faces (id, embedding) with the nearest centroid, or NULL if none is near enough.

    Faces are compared with all centroids by matrix products, batch by batch. Up to ``sent`` centroids go to all
    executors once; more are dealt to blocks of that size, and faces to blocks of ``block``, and each task compares two
    blocks. A face that isn't a vector has no row; one of another length than the centroids is near to none; ties go to
    the smaller person.
    """
    limit = SearchConfig().assign_distance if limit is None else limit
    faces = cut(new_faces.where(is_vector(F.col("embedding"))).select("id", "embedding"))
    known = centres.where(F.col("person_id").isNotNull() & is_vector(F.col("centroid"))).select("person_id", "centroid")
    n = known.count()
    if n <= sent:
        rows = sorted((r["person_id"], r["centroid"]) for r in known.collect())  # at most ``sent``
        names = np.array([p for p, _ in rows], "int64")
        shared = faces.sparkSession.sparkContext.broadcast((names, np.array([c for _, c in rows], "float64")))

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            persons, matrix = shared.value
            for batch in batches:
                at, x = _units(batch.column("embedding"))
                if len(at) and len(persons) and x.shape[1] == matrix.shape[1]:
                    who, d = _nearest_of(x, persons, matrix)
                    yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(at)), pa.array(d), pa.array(who)], names=["id", "d", "person_id"])

        found = faces.mapInArrow(search, FOUND)
    else:
        p, q = -(-n // sent), max(1, -(-faces.count() // block))
        deal = lambda key, parts, name: F.pmod(F.xxhash64(key), F.lit(parts)).cast("int").alias(name)
        every = lambda parts, name: F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias(name)
        asking = faces.select("id", F.col("embedding").cast("array<double>").alias("v"), deal("id", q, "j"), every(p, "i")).withColumn("tag", F.lit(1))
        asked = known.select(F.col("person_id").alias("id"), F.col("centroid").cast("array<double>").alias("v"), deal("person_id", p, "i"), every(q, "j")).withColumn("tag", F.lit(0))

        def compare(frame: pd.DataFrame) -> pd.DataFrame:
            frame = frame.sort_values("id")
            persons, some = frame[frame["tag"] == 0], frame[frame["tag"] == 1]
            if persons.empty or some.empty:
                return pd.DataFrame({"id": [], "d": [], "person_id": []}).astype({"id": "int64", "d": "float64", "person_id": "int64"})
            matrix = np.stack(persons["v"].to_numpy())
            some = some[[len(v) == matrix.shape[1] for v in some["v"]]]
            x = np.stack(some["v"].to_numpy()) if len(some) else np.zeros((0, matrix.shape[1]))
            length = np.sqrt((x * x).sum(axis=1))
            who, d = _nearest_of(x / np.where(length > 1e-6, length, 1)[:, None], persons["id"].to_numpy(), matrix)
            return pd.DataFrame({"id": some["id"].to_numpy(), "d": d, "person_id": who})

        found = asking.unionByName(asked).groupBy("i", "j").applyInPandas(compare, FOUND)
        found = found.groupBy("id").agg(F.min(F.struct("d", "person_id")).alias("x")).select("id", "x.*")
    near = found.where(F.col("d") < limit)
    return faces.select("id").join(near, "id", "left").select("id", "person_id", F.col("d").alias("distance"))


def cluster(faces: DataFrame, limit: float | None = None) -> DataFrame:
    """(id, label): faces (id, embedding) linked by distances under ``limit``; -1 for faces linked to none.

    Labels count from 0 in the order of each cluster's first face.
    """
    limit = SearchConfig().face_distance if limit is None else limit
    vectors = faces.select("id", F.col("embedding").alias("vector"))
    linked = groups(links(store(vectors, hashed=True), 1 - limit, strict=True))
    return faces.select("id").join(linked.select(F.col("node").alias("id"), "label"), "id", "left").select("id", F.coalesce("label", F.lit(-1)).cast("bigint").alias("label"))


def density_clusters(faces: DataFrame, eps: float = 0.45, least: int = 2) -> DataFrame:
    """(id, label): faces by density: cores have ``least`` faces within ``eps``, themselves among them; others join a core.

    What near faces are is only counted; links come out of each pair of blocks as far as they connect cores. Where
    ``least`` is two, whoever has a link is a core, and nothing needs to be counted.
    """
    vectors = faces.select("id", F.col("embedding").alias("vector"))
    if least > 2:
        core = cut(neighbour_counts(vectors, 1 - eps).where(F.col("n") + 1 >= least).select("id"))
        links = cosine_pairs(vectors.join(core, "id", "left_semi"), 1 - eps, forest=True).select("a", "b")
        links = links.union(core.select(F.col("id").alias("a"), F.col("id").alias("b")))  # a core alone is a cluster too
    else:
        links = cosine_pairs(vectors, 1 - eps, forest=True)
    joined = cut(components(links))
    named = numbered(joined.select("component").distinct(), "component", "label")
    linked = found = joined.join(named, "component").select(F.col("node").alias("id"), "label")
    if least > 2:  # else whoever has a neighbour is a core
        marked = vectors.join(linked, "id", "left").select("id", "vector", F.coalesce("label", F.lit(-1)).alias("mark"))
        found = linked.unionByName(least_marks(marked, 1 - eps).select("id", F.col("mark").alias("label")))
    return faces.select("id").join(found, "id", "left").select("id", F.coalesce("label", F.lit(-1)).cast("bigint").alias("label"))


def new_persons(labels: DataFrame, first_id: int, now: float) -> tuple[DataFrame, DataFrame]:
    """Persons to append, one for each label, represented by its first face; and (id, person_id) of the faces."""
    real = labels.where("label >= 0")
    first = real.groupBy("label").agg(F.min("id").alias("representative_face_id"))
    persons = first.select((F.col("label") + first_id).alias("id"), F.lit(None).cast("string").alias("name"), "representative_face_id", F.lit(now).alias("created_at"), F.lit(now).alias("updated_at"))
    return persons, real.select("id", (F.col("label") + first_id).alias("person_id"))


def person_counts(persons: DataFrame, faces: DataFrame) -> DataFrame:
    """(id, name, representative_face_id, face_count), persons with most faces first; persons without faces have 0."""
    n = faces.where("person_id is not null").groupBy("person_id").agg(F.count("id").alias("n"))
    joined = persons.join(n, persons["id"] == n["person_id"], "left")
    return joined.select("id", "name", "representative_face_id", F.coalesce("n", F.lit(0)).alias("face_count")).orderBy(F.desc("face_count"), "id")


def find_person(persons: DataFrame, faces: DataFrame, asked: str) -> DataFrame:
    """The person that is asked for: by number, else the first whose name holds the text, in the order of face counts."""
    ranked = person_counts(persons, faces)
    if asked.isdigit():
        return ranked.where(F.col("id") == int(asked)).limit(1)
    return ranked.where(F.lower("name").contains(asked.lower())).orderBy(F.desc("face_count"), "id").limit(1)


def photos_of(person: DataFrame, faces: DataFrame, photos: DataFrame) -> DataFrame:
    """(path): the photos with a face of the persons (id); faces whose photo is gone have none."""
    mine = faces.join(person.select(F.col("id").alias("person_id")), "person_id", "left_semi").select(F.col("photo_id").alias("id")).distinct()
    return photos.join(mine, "id", "left_semi").select("path").distinct()


def faces_of(photos: DataFrame, faces: DataFrame, persons: DataFrame) -> DataFrame:
    """(path, face_id, person_id, name, det_score): the faces on photos (id, path), with their persons' names."""
    on = faces.join(photos.select(F.col("id").alias("photo_id"), "path"), "photo_id").select("path", F.col("id").alias("face_id"), "person_id", "det_score")
    named = persons.select(F.col("id").alias("person_id"), "name")
    return on.join(named, "person_id", "left").select("path", "face_id", "person_id", "name", "det_score")


def first_faces(labels: DataFrame) -> DataFrame:
    """(label, id): each cluster's first face."""
    rank = F.row_number().over(Window.partitionBy("label").orderBy("id"))
    return labels.where("label >= 0").withColumn("rank", rank).where("rank = 1").select("label", "id")


__all__ = ["assign", "centroids", "cluster", "density_clusters", "faces_of", "find_person", "first_faces", "new_persons", "numbered", "person_counts", "photos_of", "usable_faces"]
