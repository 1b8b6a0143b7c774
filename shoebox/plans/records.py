"""Queries over the stored records: scans, lookups, joins and counts, and the next states of the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoebox.functions.text import basename, cache_key
from shoebox.functions.vec import is_zero, norm
from shoebox.operators import feedback as fb
from shoebox.operators import library, people
from shoebox.plans.tables import FEEDBACK_SQL, faces, feedback, persons, photos, sql_current
from shoebox.sources.files import VectorIndex, cache_rows, with_cached_vectors
from shoebox.sources.tables import table

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        Q[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return keep


P, FC, PE = (lambda *c: sql_current("photos", *c)), (lambda *c: sql_current("faces", *c)), (lambda *c: sql_current("persons", *c))


@query(f"select path from {P('path')} where path is not null")
def scanned_paths(spark: SparkSession, d: str) -> DataFrame:
    """SRC2: all known paths."""
    return photos(spark, d, "path").select("path").where("path is not null")


@query(f"select path, modified_time, size_bytes from {P('path', 'modified_time', 'size_bytes')}")
def scanned_files(spark: SparkSession, d: str) -> DataFrame:
    """SRC3: known paths with their times and sizes."""
    return photos(spark, d, "path", "modified_time", "size_bytes").drop("id")


@query(f"select path, len(embedding) dims, round(list_sum(list_transform(embedding, lambda x: case when isnan(x) then 0 else x::double end)), 3) total from {P('path', 'embedding')} where embedding is not null")
def all_embeddings(spark: SparkSession, d: str) -> DataFrame:
    """SRC4: paths with their vectors (here as their length and sum)."""
    rows = library.searchable(photos(spark, d, "path", "embedding"))
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + F.when(F.isnan(x), 0.0).otherwise(x.cast("double")))
    return rows.select("path", F.size("embedding").alias("dims"), F.round(total, 3).alias("total"))


@query(f"select path, coalesce(ocr_text, '') ocr_text, case when metadata is null or not json_valid(metadata) then 0 else len(coalesce(json_keys(metadata), [])) end keys from {P('path', 'embedding', 'ocr_text', 'metadata')} where embedding is not null")
def search_data(spark: SparkSession, d: str) -> DataFrame:
    """SRC5, SRC6: what search reads of each photo; malformed metadata is as good as none."""
    rows = library.searchable(photos(spark, d, "path", "embedding", "ocr_text", "metadata"))
    keys = F.coalesce(F.size(F.json_object_keys(F.when(F.try_parse_json("metadata").isNotNull(), F.col("metadata")))), F.lit(0))
    return rows.select("path", F.coalesce("ocr_text", F.lit("")).alias("ocr_text"), F.greatest(keys, F.lit(0)).alias("keys"))


@query(f"select id, len(embedding) dims from {P('embedding')} where embedding is not null")
def embeddings_with_ids(spark: SparkSession, d: str) -> DataFrame:
    """SRC7: ids with their vectors (here their lengths)."""
    return library.searchable(photos(spark, d, "embedding")).select("id", F.size("embedding").alias("dims"))


@query(f"select id, case when octet_length(phash) = 32 then hex(phash) end phash, is_duplicate from {P('phash', 'is_duplicate')}")
def dedup_entries(spark: SparkSession, d: str) -> DataFrame:
    """SRC8, FN2: what deduplication reads; hashes go to numbers and back."""
    from shoebox.functions.bits import from_limbs, limbs

    return photos(spark, d, "phash", "is_duplicate").select("id", F.hex(from_limbs(limbs(F.col("phash")))).alias("phash"), "is_duplicate")


@query(f"select id, photo_id, person_id, det_score from {FC('photo_id', 'person_id', 'det_score', 'embedding')} where embedding is not null")
def faces_with_embeddings(spark: SparkSession, d: str) -> DataFrame:
    """SRC9: faces that have vectors."""
    return faces(spark, d, "photo_id", "person_id", "det_score", "embedding").where("embedding is not null").drop("embedding")


@query(f"select count(*) n from {P('embedding')} where embedding is not null")
def searchable_count(spark: SparkSession, d: str) -> DataFrame:
    """AG1: how many photos can be found."""
    return library.searchable(photos(spark, d, "embedding")).agg(F.count("*").alias("n"))


@query(f"select id, path from (select unnest([7, 3, 9999999, 42, 5]) id, unnest([0, 1, 2, 3, 4]) position) join {P('path')} using (id)")
def batch_by_ids(spark: SparkSession, d: str) -> DataFrame:
    """FLT2, JN13: photos by a list of ids, in its order."""
    return library.by_ids(photos(spark, d, "path"), [7, 3, 9999999, 42, 5]).select("id", "path")


@query(f"select min(id) id from {P('path')} where path = (select min(path) from photos)")
def photo_id_of_path(spark: SparkSession, d: str) -> DataFrame:
    """FLT3: the id of a path."""
    rows = photos(spark, d, "path")
    first = rows.agg(F.min("path").alias("path"))
    return rows.join(F.broadcast(first), "path").agg(F.min("id").alias("id"))


@query(f"select path, duplicate_of from {P('path', 'is_duplicate', 'duplicate_of')} where is_duplicate = 1")
def flagged_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """FLT4: flagged photos, by path."""
    return library.flagged(photos(spark, d, "path", "is_duplicate", "duplicate_of")).orderBy("path")


@query(f"select id from {P('embedding')} where embedding is not null and len(list_filter(embedding, lambda x: x <> 0 or isnan(x))) > 0")
def decoded_photos(spark: SparkSession, d: str) -> DataFrame:
    """FLT5: photos whose vector isn't all zero."""
    return photos(spark, d, "embedding").where(F.col("embedding").isNotNull() & ~is_zero(F.col("embedding"))).select("id")


@query(f"select id, det_score from {FC('det_score', 'embedding')} where det_score >= 0.5 and embedding is not null and sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))) >= 1e-6")
def usable_faces(spark: SparkSession, d: str) -> DataFrame:
    """FLT7: sure detections with a vector."""
    return people.usable_faces(faces(spark, d, "det_score", "embedding")).select("id", "det_score")


@query(f"select md5(lower(trim(query, e' \\t\\n\\r'))) query_key, count(*) n from {FEEDBACK_SQL} where query is not null group by 1")
def cache_keys(spark: SparkSession, d: str) -> DataFrame:
    """FN7: the cache key of each query, and how often it was asked."""
    return feedback(spark, d).where("query is not null").groupBy(cache_key(F.col("query")).alias("query_key")).agg(F.count("*").alias("n"))


@query("select doc_id, len(e.embedding) dims from (select doc_id, md5(lower(trim(text, e' \\t\\n\\r'))) k from documents) d left join (select md5(lower(trim(any_value(text), e' \\t\\n\\r'))) k, max(embedding) embedding from (select text, embedding from documents join embeddings on vec_id = doc_id) group by md5(lower(trim(text, e' \\t\\n\\r')))) e using (k)")
def cached_vectors(spark: SparkSession, d: str) -> DataFrame:
    """SRC11, SNK16: texts with the vectors that a cache has for their keys."""
    asked = table(spark, d, "documents").select("doc_id", F.col("text").alias("query"))
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return with_cached_vectors(asked, cache_rows(asked.join(vectors, "doc_id"))).select("doc_id", F.size("embedding").alias("dims")).withColumn("dims", F.when(F.col("dims") >= 0, F.col("dims")))


@query(f"select p.id, name, representative_face_id, count(f.id) face_count from {PE('name', 'representative_face_id')} p left join {FC('person_id')} f on f.person_id = p.id group by all")
def person_counts(spark: SparkSession, d: str) -> DataFrame:
    """JN1, AG2: persons with the number of their faces."""
    return people.person_counts(persons(spark, d, "name", "representative_face_id"), faces(spark, d, "person_id"))


@query(f"select distinct path from {FC('photo_id', 'person_id')} f join {P('path')} p on p.id = f.photo_id where person_id = 1")
def photos_for_person(spark: SparkSession, d: str) -> DataFrame:
    """JN2, AG13: the photos of person 1."""
    one = spark.createDataFrame([(1,)], "id bigint")
    return people.photos_of(one, faces(spark, d, "photo_id", "person_id"), photos(spark, d, "path"))


@query(f"select path, f.id face_id, person_id, name, det_score from {FC('photo_id', 'person_id', 'det_score')} f join {P('path')} p on p.id = f.photo_id left join {PE('name')} q on q.id = person_id")
def faces_for_photos(spark: SparkSession, d: str) -> DataFrame:
    """JN3: all faces with their photos' paths and persons' names."""
    return people.faces_of(photos(spark, d, "path"), faces(spark, d, "photo_id", "person_id", "det_score"), persons(spark, d, "name"))


_COUNTED = f"(select p.id, name, representative_face_id, count(f.id) face_count from {PE('name', 'representative_face_id')} p left join {FC('person_id')} f on f.person_id = p.id group by all)"


@query(f"select * from (select * from {_COUNTED} where id = 12 limit 1) union all select * from (select * from {_COUNTED} where lower(name) like '%dal%' order by face_count desc, id limit 1)")
def search_person(spark: SparkSession, d: str) -> DataFrame:
    """FLT10, OP9: a person by number and one by a part of the name."""
    who, whose = persons(spark, d, "name", "representative_face_id"), faces(spark, d, "person_id")
    return people.find_person(who, whose, "12").unionByName(people.find_person(who, whose, "DAL"))


@query(f"select case when g = 3 then 'total' when g = 1 then 'intent' else 'kind' end \"by\", case g when 1 then query_intent when 2 then feedback_type end \"value\", n from (select query_intent, feedback_type, count(*) n, grouping(query_intent, feedback_type) g from {FEEDBACK_SQL} group by grouping sets ((), (query_intent), (feedback_type)))")
def feedback_stats(spark: SparkSession, d: str) -> DataFrame:
    """AG3: feedback in all, by intent and by kind."""
    return fb.stats(feedback(spark, d))


_KINDS = ", ".join(f"count(*) filter (feedback_type = '{k}') {k.lower()}" for k in ("POSITIVE", "NEGATIVE", "CLICKED", "IGNORED"))
_MULTIPLIER = """case when neg > 0 and pos = 0 then greatest(0.1::double, 1.0::double - 0.12::double * neg)
when neg > 0 then greatest(0.3::double, 1.0::double - 0.7::double * (neg::double / (pos + neg)))
when pos > 0 then least(1.3::double, 1.0::double + 0.06::double * pos) else 1.0::double end"""


@query(f"select result_path, query, {_KINDS} from {FEEDBACK_SQL} group by all")
def feedback_counts(spark: SparkSession, d: str) -> DataFrame:
    """AG4: kinds of feedback per result and query."""
    return fb.counts(feedback(spark, d), "result_path", "query")


@query(f"select result_path, query, round({_MULTIPLIER}, 9) multiplier from (select result_path, query, count(*) filter (feedback_type in ('POSITIVE', 'CLICKED')) pos, count(*) filter (feedback_type = 'NEGATIVE') neg from {FEEDBACK_SQL} group by all)")
def feedback_penalty(spark: SparkSession, d: str) -> DataFrame:
    """AG4, FN13: what each result's score is multiplied by."""
    return fb.multipliers(feedback(spark, d), "result_path", "query").withColumn("multiplier", F.round("multiplier", 9))


@query(f"select result_path, round({_MULTIPLIER}, 9) multiplier from (select result_path, count(*) filter (feedback_type in ('POSITIVE', 'CLICKED')) pos, count(*) filter (feedback_type = 'NEGATIVE') neg from {FEEDBACK_SQL} group by all)")
def feedback_penalty_any_query(spark: SparkSession, d: str) -> DataFrame:
    """AG4: the same over all queries."""
    return fb.multipliers(feedback(spark, d), "result_path").withColumn("multiplier", F.round("multiplier", 9))


_W = "try_cast(json_extract_string(case when json_valid(weights_used) then weights_used end, '$.{0}') as double)"
_GOOD = "feedback_type in ('POSITIVE', 'CLICKED')"
_LEARN = f"""(select query_intent intent, count(*) samples, count(*) filter ({_GOOD}) successes, {', '.join(f"avg({_W.format(p)}) filter ({_GOOD}) {p}" for p in ('visual', 'ocr', 'metadata'))}
from {FEEDBACK_SQL} group by 1 having count(*) >= 5 and count(*) filter ({_GOOD}) > 0)"""


@query(f"select intent, samples, successes, round(successes::double / samples, 9) success_rate, round(visual, 6) visual, round(ocr, 6) ocr, round(metadata, 6) metadata from {_LEARN}")
def learning_data(spark: SparkSession, d: str) -> DataFrame:
    """AG5: what good results had for weights, by intent."""
    rows = fb.learning_data(feedback(spark, d))
    return rows.select("intent", "samples", "successes", F.round("success_rate", 9).alias("success_rate"), *[F.round(c, 6).alias(c) for c in ("visual", "ocr", "metadata")])


_STEP = "round(coalesce(greatest(0::double, was_{0} + greatest(-0.15::double, least(0.15::double, was_{0} * 0.75::double + {0} * 0.25::double - was_{0}))), was_{0}), 6) {0}"


@query(f"""select preset, {', '.join(_STEP.format(p) for p in ('visual', 'ocr', 'metadata'))}, visual is not null learned from
(values ('metadata_dominant', 'METADATA', 0.2::double, 0.1::double, 0.7::double), ('visual_dominant', 'VISUAL', 0.8, 0.1, 0.1), ('text_dominant', 'TEXT', 0.2, 0.7, 0.1), ('hybrid_balanced', 'HYBRID', 0.5, 0.3, 0.2), ('fallback', null, 0.7, 0.2, 0.1)) b(preset, intent, was_visual, was_ocr, was_metadata)
left join (select * from {_LEARN} where successes::double / samples >= 0.2) using (intent)""")
def updated_weights(spark: SparkSession, d: str) -> DataFrame:
    """FN29, OP12: the presets after learning."""
    return fb.learned_weights(feedback(spark, d)).withColumns({c: F.round(c, 6) for c in ("visual", "ocr", "metadata")})


@query(f'select distinct query, query_intent, "timestamp" from {FEEDBACK_SQL} order by "timestamp" desc, query, query_intent limit 10')
def recent_queries(spark: SparkSession, d: str) -> DataFrame:
    """AG14: the latest queries."""
    return fb.recent_queries(feedback(spark, d))


@query(f"select count(*) samples, count(*) >= 5 should_update from {FEEDBACK_SQL}")
def should_update(spark: SparkSession, d: str) -> DataFrame:
    """AG18: whether there is feedback enough to learn from."""
    return fb.should_update(feedback(spark, d))


def _listing(spark: SparkSession, d: str) -> DataFrame:
    """A later listing of the files: some are gone, some changed, some are new."""
    rows = photos(spark, d, "path", "modified_time", "size_bytes")
    moved = F.col("modified_time") + F.when(F.col("id") % 10 == 3, 1.0).when(F.col("id") % 10 == 4, 1.5).otherwise(0.0)
    grown = F.col("size_bytes") + F.when(F.col("id") % 10 == 2, 1).otherwise(0)
    there = rows.where("id % 10 <> 1").select("path", moved.alias("mtime"), grown.alias("size"))
    new = rows.where("id % 10 = 5").select(F.concat("path", F.lit(".new.jpg")).alias("path"), F.col("modified_time").alias("mtime"), F.col("size_bytes").alias("size"))
    return there.unionByName(new)


_LISTING = f"""(select path, modified_time + case id % 10 when 3 then 1.0 when 4 then 1.5 else 0.0 end mtime, size_bytes + case when id % 10 = 2 then 1 else 0 end size
from {P('path', 'modified_time', 'size_bytes')} where id % 10 <> 1 union all select path || '.new.jpg', modified_time, size_bytes from {P('path', 'modified_time', 'size_bytes')} where id % 10 = 5)"""


@query(f"""select coalesce(l.path, p.path) path, case when p.path is null then 'new' when l.path is null then 'deleted'
when coalesce(abs(mtime - modified_time) > 1.0, mtime is distinct from modified_time) or size is distinct from size_bytes then 'modified' else 'unchanged' end status
from {_LISTING} l full join {P('path', 'modified_time', 'size_bytes')} p on l.path = p.path""")
def scan_diff(spark: SparkSession, d: str) -> DataFrame:
    """JN4, SET1-SET4: what changed between a listing and the table."""
    return library.diff(_listing(spark, d), photos(spark, d, "path", "modified_time", "size_bytes")).select("path", "status")


@query(f"""with p as (select * from {P('path', 'filename', 'size_bytes', 'modified_time')}), l as (select * from {_LISTING}),
n as (select path, size, mtime, row_number() over (order by path) + (select max(id) from p) id from l where path not in (select path from p))
select id, path, regexp_extract(path, '[^/]*$') filename, size size_bytes, mtime modified_time from n
union all select p.id, p.path, p.filename, case when l.path is null then size_bytes else size end, case when l.path is null then modified_time else mtime end
from p left join l on l.path = p.path and (coalesce(abs(mtime - modified_time) > 1.0, mtime is distinct from modified_time) or size is distinct from size_bytes)
where p.path in (select path from l)""")
def upsert_photos(spark: SparkSession, d: str) -> DataFrame:
    """OP1, SNK1-SNK3, SRC1: the table after a scan: changed photos updated, new ones added, missing ones removed."""
    rows = photos(spark, d, "path", "filename", "size_bytes", "modified_time")
    changes = library.diff(_listing(spark, d), rows).select("path", "status", F.col("mtime").alias("modified_time"), F.col("size").alias("size_bytes"))
    kept = library.remove(rows, changes.where(F.col("status") == library.DELETED), "path")
    moved = library.update(kept, changes.where(F.col("status") == library.MODIFIED), "path", ["modified_time", "size_bytes"])
    return library.insert(moved, changes.where(F.col("status") == library.NEW).drop("status"), rows)


@query(f"select id, photo_id from {FC('photo_id')} where photo_id <> 12 and photo_id <> 46 or photo_id is null")
def delete_faces_of_photo(spark: SparkSession, d: str) -> DataFrame:
    """SNK9: faces without those of two photos."""
    gone = spark.createDataFrame([(12,), (46,)], "photo_id bigint")
    return library.remove(faces(spark, d, "photo_id"), gone, "photo_id").select("id", "photo_id")


@query(f"""with f as (select * from {FC('photo_id', 'bbox_x1', 'bbox_y1', 'det_score')}), n as (select * from f where id % 100 = 7)
select id, photo_id, det_score from f union all
select (select max(id) from f) + row_number() over (order by photo_id, bbox_x1, bbox_y1), photo_id, det_score from n""")
def add_faces(spark: SparkSession, d: str) -> DataFrame:
    """SNK8: faces with new ones appended."""
    rows = faces(spark, d, "photo_id", "bbox_x1", "bbox_y1", "det_score")
    return library.add_faces(rows, rows.where("id % 100 = 7").drop("id")).select("id", "photo_id", "det_score")


@query(f"select id, case when id % 10 = 3 then id % 7 when id % 10 = 4 then null else person_id end person_id from {FC('person_id')}")
def set_face_persons(spark: SparkSession, d: str) -> DataFrame:
    """SNK10: persons of faces set and cleared."""
    rows = faces(spark, d, "person_id")
    owners = rows.where("id % 10 in (3, 4)").select("id", F.when(F.col("id") % 10 == 3, F.col("id") % 7).alias("person_id"))
    return library.set_persons(rows, owners)


@query(f"select id, case when id = 4 then 'Ann' else name end \"name\" from {PE('name')}")
def rename_person(spark: SparkSession, d: str) -> DataFrame:
    """SNK12: a person renamed; an unknown number changes nothing."""
    rows = library.rename_person(persons(spark, d, "name"), 4, "Ann")
    return library.rename_person(rows, -1, "Bob")


@query(f"select count(*) faces, count(person_id) named, 0::bigint persons from (select id, null person_id from {FC()})")
def reset_persons(spark: SparkSession, d: str) -> DataFrame:
    """SNK13: nobody is known any more."""
    f, p = library.reset_persons(faces(spark, d, "person_id"), persons(spark, d, "name"))
    return f.agg(F.count("*").alias("faces"), F.count("person_id").alias("named")).join(p.agg(F.count("*").alias("persons")))


@query(f"select id, path, case when path = (select min(path) from photos where is_duplicate = 1) then 0 else is_duplicate end is_duplicate, case when path = (select min(path) from photos where is_duplicate = 1) then null else duplicate_of end duplicate_of from {P('path', 'is_duplicate', 'duplicate_of')}")
def unmark_duplicate(spark: SparkSession, d: str) -> DataFrame:
    """SNK7: one flag taken back."""
    rows = photos(spark, d, "path", "is_duplicate", "duplicate_of")
    first = table(spark, d, "photos").where("is_duplicate = 1").agg(F.min("path")).first()[0]
    return library.unmark_duplicate(rows, first or "")


@query(f"select id, case when id % 2 = 0 then unhex(repeat('AB', 32)) else phash end phash from {P('path', 'phash')}")
def set_hashes(spark: SparkSession, d: str) -> DataFrame:
    """SNK5: hashes set by path."""
    rows = photos(spark, d, "path", "phash")
    new = rows.where("id % 2 = 0").select("path", F.unhex(F.lit("AB" * 32)).alias("phash"))
    return library.set_hash(rows, new).drop("path")


@query(f"select id, regexp_extract(path, '[^/]*$') filename from {P('path')}")
def file_names(spark: SparkSession, d: str) -> DataFrame:
    """FN27: the last step of each path."""
    return photos(spark, d, "path").select("id", basename(F.col("path")).alias("filename"))


@query(f"select id, len(embedding) dims, round(l / (l + 1e-8::double), 3) \"length\" from (select *, sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))) l from {P('embedding')}) where embedding is not null")
def index_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """OP13, SRC10, SNK15: the vector index built, written, added to, and read."""
    import os

    from shoebox.session import use_checkpoint_dir

    use_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/index-{os.urandom(6).hex()}"
    rows, index = photos(spark, d, "embedding"), VectorIndex(spark, path)
    index.build(rows.where("id % 2 = 0"))
    index.add(rows)
    return index.load().select("id", F.size("vector").alias("dims"), F.round(norm(F.col("vector")), 3).alias("length"))


@query(SQL["feedback_penalty"])
def feedback_stream(spark: SparkSession, d: str) -> DataFrame:
    """The log as a stream: multipliers of results over all entries, each counted once."""
    import os

    from shoebox.session import use_checkpoint_dir
    from shoebox.streaming import feedback as stream

    use_checkpoint_dir(spark)
    log = stream.read_table(spark, d, "search_feedback")
    found = stream.multiplier_table(log, f"{spark.sparkContext.getCheckpointDir()}/stream-{os.urandom(6).hex()}")
    return found.withColumn("multiplier", F.round("multiplier", 9))


QUERIES = Q
