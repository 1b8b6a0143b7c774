"""Changes to a library as new snapshots: a table is never updated in place, its next state is computed from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoebox.functions.bits import picture_hash
from shoebox.functions.text import basename
from shoebox.operators.graph import numbered

NEW, MODIFIED, DELETED, SAME = "new", "modified", "deleted", "unchanged"


def diff(listing: DataFrame, photos: DataFrame, within: str | None = None, tolerance: float = 1.0) -> DataFrame:
    """(path, status, mtime, size): files listed (path, mtime, size) against photos known (path, modified_time, size_bytes).

    A file is modified if its time moved by more than ``tolerance`` seconds or its size changed; a photo that isn't
    listed is deleted, with ``within`` only below that folder. A NULL time or size on one side is a change.
    """
    known = photos.select("path", F.col("modified_time").alias("old_time"), F.col("size_bytes").alias("old_size"), F.lit(True).alias("known"))
    if within is not None:
        known = known.where(F.col("path").startswith(within.rstrip("/") + "/"))
    both = listing.select("path", "mtime", "size", F.lit(True).alias("listed")).join(known, "path", "full_outer")
    moved = F.coalesce(F.abs(F.col("mtime") - F.col("old_time")) > tolerance, ~F.col("mtime").eqNullSafe(F.col("old_time")))
    changed = moved | ~F.col("size").eqNullSafe(F.col("old_size"))
    status = F.when(F.col("known").isNull(), NEW).when(F.col("listed").isNull(), DELETED).when(changed, MODIFIED).otherwise(SAME)
    return both.select("path", status.alias("status"), "mtime", "size")


def insert(photos: DataFrame, rows: DataFrame, ids_of: DataFrame | None = None) -> DataFrame:
    """Photos with ``rows`` (path and other columns) appended; a path that is known already is left as it is.

    New ids follow the largest one, or that of ``ids_of``, in the order of paths; of rows with one path the first in all columns is taken.
    """
    columns = [c for c in photos.columns if c not in ("id", "path", "filename")]
    fresh = rows.join(photos.select("path"), "path", "left_anti").groupBy("path").agg(F.min(F.struct(*[F.col(c) for c in columns if c in rows.columns])).alias("x"))
    ids = numbered(fresh.select("path"), "path", "place")
    top = (photos if ids_of is None else ids_of).agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    new = fresh.join(ids, "path").join(F.broadcast(top))
    kinds = {f.name: f.dataType for f in photos.schema}
    value = {c: (F.col(f"x.{c}") if c in rows.columns else F.lit(None)).cast(kinds[c]) for c in columns}
    value |= {"id": (F.col("top") + F.col("place") + 1).cast("bigint"), "path": F.col("path"), "filename": basename(F.col("path"))}
    return photos.unionByName(new.select(*[value[c].alias(c) for c in photos.columns]))


def update(table: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``table`` with ``columns`` taken from ``changes`` where the key is in it, NULLs too; unknown keys change nothing.

    ``changes`` has each key once.
    """
    new = changes.select(key, *[F.col(c).alias(f"_new_{c}") for c in columns], F.lit(True).alias("_hit"))
    joined = table.join(new, key, "left")
    pick = lambda c: F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c)
    return joined.select(*[pick(c) if c in columns else F.col(c) for c in table.columns])


def remove(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """``table`` without the rows whose key is in ``keys``."""
    return table.join(keys.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti").select(*table.columns)


def set_where(table: DataFrame, condition: Column, **values: Column) -> DataFrame:
    """``table`` with columns set where the condition holds."""
    hit = F.coalesce(condition, F.lit(False))
    return table.withColumns({c: F.when(hit, v).otherwise(F.col(c)).cast(table.schema[c].dataType) for c, v in values.items()})


def mark_duplicates(photos: DataFrame, marks: DataFrame) -> DataFrame:
    """Photos with the flag and the kept path set for the paths of ``marks`` (path, duplicate_of)."""
    return update(photos, marks.withColumn("is_duplicate", F.lit(1)), "path", ["is_duplicate", "duplicate_of"])


def unmark_duplicate(photos: DataFrame, path: str) -> DataFrame:
    return set_where(photos, F.col("path") == path, is_duplicate=F.lit(0), duplicate_of=F.lit(None))


def flagged(photos: DataFrame) -> DataFrame:
    """(path, duplicate_of) of the photos that are flagged."""
    return photos.where("is_duplicate = 1").select("path", "duplicate_of")


def set_hash(photos: DataFrame, hashes: DataFrame) -> DataFrame:
    return update(photos, hashes, "path", ["phash"])


def backfill_hashes(photos: DataFrame, pictures: DataFrame) -> DataFrame:
    """Photos whose missing hashes are made from ``pictures`` (path, pixels, width, height); only those pictures are read.

    Photos that have a hash keep it; those without a picture, or with one that doesn't fit its size, stay without.
    """
    wanted = pictures.join(photos.where("phash is null").select("path"), "path", "left_semi")
    made = wanted.select("path", picture_hash(F.col("pixels"), F.col("width"), F.col("height")).alias("phash"))
    return set_hash(photos, made.where("phash is not null").dropDuplicates(["path"]))


def add_faces(faces: DataFrame, rows: DataFrame) -> DataFrame:
    """Faces with ``rows`` appended, with ids after the largest one in the order of (photo_id, bbox_x1, bbox_y1)."""
    top = faces.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    keyed = rows.withColumn("_key", F.struct("photo_id", "bbox_x1", "bbox_y1", F.xxhash64(*rows.columns)))
    ids = numbered(keyed.select("_key").distinct(), "_key", "place")
    new = keyed.join(ids, "_key").join(F.broadcast(top)).withColumn("id", F.col("top") + F.col("place") + 1)
    kinds = {f.name: f.dataType for f in faces.schema}
    return faces.unionByName(new.select(*[(F.col(c) if c in new.columns else F.lit(None)).cast(kinds[c]).alias(c) for c in faces.columns]))


def set_persons(faces: DataFrame, owners: DataFrame) -> DataFrame:
    """Faces with person_id set, or cleared, for the ids of ``owners`` (id, person_id)."""
    return update(faces, owners, "id", ["person_id"])


def rename_person(persons: DataFrame, person_id: int, name: str) -> DataFrame:
    return set_where(persons, F.col("id") == person_id, name=F.lit(name))


def reset_persons(faces: DataFrame, persons: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Faces that belong to nobody, and no persons."""
    return faces.withColumn("person_id", F.lit(None).cast("bigint")), persons.limit(0)


def by_ids(photos: DataFrame, ids: list[int]) -> DataFrame:
    """Photos in the order of a list of ids, as often as it names them; unknown ids have none."""
    asked = photos.sparkSession.createDataFrame([(i, int(x)) for i, x in enumerate(ids)], "position int, id bigint")
    return photos.join(F.broadcast(asked), "id").orderBy("position")


def searchable(photos: DataFrame) -> DataFrame:
    return photos.where(F.col("embedding").isNotNull())
