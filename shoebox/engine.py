"""A library of photos: its tables, and what can be asked of them and done to them."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoebox.config import SearchConfig
from shoebox.functions.text import class_counts, intent_and_weights
from shoebox.operators import dedup, feedback, library, people, search
from shoebox.sources.files import ResultCache


@dataclass(frozen=True)
class Library:
    """Tables as DataFrames; every change gives a new Library, to be written as the next snapshot."""

    photos: DataFrame
    faces: DataFrame
    persons: DataFrame
    log: DataFrame
    config: SearchConfig = field(default_factory=SearchConfig)

    def ingest(self, listing: DataFrame, enriched: DataFrame | None = None, within: str | None = None) -> Library:
        """After a scan: new files added, changed ones updated, missing ones removed.

        ``enriched`` (path and columns of photos) has what models say of new and changed files. Files whose vector is
        all zero couldn't be decoded: new ones aren't added, changed ones keep their row.
        """
        changes = library.diff(listing, self.photos, within)
        kept = library.remove(self.photos, changes.where(F.col("status") == library.DELETED), "path")
        fresh = changes.where(F.col("status").isin(library.NEW, library.MODIFIED))
        fresh = fresh.select("path", "status", F.col("mtime").alias("modified_time"), F.col("size").alias("size_bytes"))
        columns = ["modified_time", "size_bytes"]
        if enriched is not None:
            from shoebox.functions.vec import is_zero

            extra = [c for c in enriched.columns if c != "path" and c in self.photos.columns and c not in columns]
            fresh = fresh.join(enriched.select("path", *extra), "path")
            if "embedding" in extra:
                fresh = fresh.where(F.col("embedding").isNull() | ~is_zero(F.col("embedding")))
            columns += extra
        moved = library.update(kept, fresh.where(F.col("status") == library.MODIFIED), "path", columns)
        return replace(self, photos=library.insert(moved, fresh.where(F.col("status") == library.NEW).drop("status"), self.photos))

    def search(self, query: str, query_vector: list[float], now: dt.datetime | None = None) -> DataFrame:
        """The ranked results of a query, with weights learned from the log."""
        learned = {r["preset"]: {p: r[p] for p in ("visual", "ocr", "metadata")} for r in feedback.learned_weights(self.log, self.config).collect()}  # five rows
        config = replace(self.config, presets=learned)
        return search.search(self.photos, self.log, query, query_vector, now or dt.datetime.now(), config)

    def cached_search(self, cache: ResultCache, query: str, query_vector: list[float], now: dt.datetime | None = None) -> list:
        found = cache.get(query)
        if found is None:
            found = self.search(query, query_vector, now).collect()  # at most max_results rows
            cache.set(query, found)
        return found

    def analyze(self, query: str) -> DataFrame:
        """(intent, visual, ocr, metadata) of a query."""
        n = class_counts(F.lit(query))
        plan = intent_and_weights(n["m"], n["v"], n["t"], self.config.presets)
        return self.photos.sparkSession.range(1).select(*[c.alias(k) for k, c in plan.items()])

    def find_duplicates(self, use_embedding: bool = True, recall: float | None = None) -> DataFrame:
        """(type, component, id) of all groups; with ``recall`` similar vectors are searched approximately."""
        return dedup.find_duplicates(self.photos, self.config, use_embedding, recall)

    def mark(self, groups: DataFrame) -> Library:
        return replace(self, photos=library.mark_duplicates(self.photos, dedup.marks(groups, self.photos)))

    def list_marked(self) -> DataFrame:
        return library.flagged(self.photos).orderBy("path")

    def delete(self, groups: DataFrame) -> tuple[Library, DataFrame]:
        """The library without the photos that ``groups`` makes superfluous, and the list of their files."""
        gone = dedup.manifest(groups, self.photos)
        return replace(self, photos=library.remove(self.photos, gone, "path")), gone

    def cluster(self, reset: bool = False, now: float = 0.0) -> Library:
        """Faces grouped to new persons; with ``reset`` all earlier persons are forgotten first."""
        faces, persons = library.reset_persons(self.faces, self.persons) if reset else (self.faces, self.persons)
        top = persons.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
        new, owners = people.new_persons(people.cluster(faces, self.config.face_distance), top + 1, now)
        new = new.select(*[F.col(c).cast(persons.schema[c].dataType) if c in new.columns else F.lit(None).cast(persons.schema[c].dataType).alias(c) for c in persons.columns])
        return replace(self, faces=library.set_persons(faces, owners), persons=persons.unionByName(new))

    def assign(self) -> Library:
        """Faces without person given to the nearest one."""
        found = people.assign(self.faces.where("person_id is null"), people.centroids(self.faces), self.config.assign_distance)
        return replace(self, faces=library.set_persons(self.faces, found.where("person_id is not null").select("id", "person_id")))

    def rename(self, person_id: int, name: str) -> Library:
        return replace(self, persons=library.rename_person(self.persons, person_id, name))

    def members_of(self, asked: str) -> DataFrame:
        """The photos of a person, given by number or by a part of the name."""
        return people.photos_of(people.find_person(self.persons, self.faces, asked), self.faces, self.photos).orderBy("path")

    def record(self, entries: DataFrame) -> Library:
        """With feedback appended; ids follow the largest one in the order of timestamps and paths."""
        from shoebox.operators.graph import numbered

        keyed = feedback.entries(entries).withColumn("_key", F.struct("timestamp", "result_path", "query", "result_rank"))
        ids = numbered(keyed.select("_key").distinct(), "_key", "place")
        top = self.log.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
        new = keyed.join(ids, "_key").join(F.broadcast(top)).withColumn("id", F.col("top") + F.col("place") + 1)
        return replace(self, log=self.log.unionByName(new.select(*[F.col(c).cast(self.log.schema[c].dataType) for c in self.log.columns])))
