"""Queries of ranked search, similarity, duplicates and faces."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoebox.config import SearchConfig
from shoebox.functions import metadata as meta
from shoebox.functions import text as words
from shoebox.functions import visual
from shoebox.functions.bits import bits_to_number, image_hash, median_bits
from shoebox.functions.vec import cosine, is_vector, unit_floored, unit_if_long, unit_padded
from shoebox.operators import dedup, people, search
from shoebox.operators.graph import groups
from shoebox.operators.library import mark_duplicates as marked
from shoebox.operators.similarity import approximate_pairs, cosine_pairs, nearest, top_similar
from shoebox.plans.tables import FEEDBACK_SQL, NOW, face_vectors, faces, feedback, photos, sql_current
from shoebox.session import spread
from shoebox.sources.tables import current, table

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        Q[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return keep


P, FC = (lambda *c: sql_current("photos", *c)), (lambda *c: sql_current("faces", *c))


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


def _vector_of(spark: SparkSession, d: str, id_: int) -> list[float]:
    return list(_vectors(spark, d).where(F.col("id") == id_).first()["vector"])


# --- vectors -------------------------------------------------------------------------------------------------------

_TOP = "select vec_id id, round(list_cosine_similarity(embedding::double[], (select embedding::double[] from embeddings where vec_id = 0)), 6) similarity from embeddings where vec_id <> 0"


@query(f"{_TOP} order by list_cosine_similarity(embedding::double[], (select embedding::double[] from embeddings where vec_id = 0)) desc, vec_id limit 10")
def topk_cosine(spark: SparkSession, d: str) -> DataFrame:
    """TK1: the ten vectors most similar to vector 0."""
    return top_similar(_vectors(spark, d).where("id <> 0"), _vector_of(spark, d, 0), 10).withColumn("similarity", F.round("similarity", 6))


_NORM = "sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double)))"


@query(f"select vec_id id, round(list_sum(list_transform(embedding, lambda x: x::double)) / ({_NORM} + 1e-8::double), 6) padded, round(list_sum(list_transform(embedding, lambda x: x::double)) / {_NORM}, 6) plain, round(list_sum(list_transform(embedding, lambda x: x::double)) / {_NORM}, 6) floored from embeddings")
def l2_normalize(spark: SparkSession, d: str) -> DataFrame:
    """FN3: vectors brought to length one, in three ways (here the sums of their elements)."""
    total = lambda v: F.round(F.aggregate(v, F.lit(0.0), lambda s, x: s + x), 6)
    v = F.col("vector")
    return _vectors(spark, d).select("id", total(unit_padded(v)).alias("padded"), total(unit_if_long(v)).alias("plain"), total(unit_floored(v)).alias("floored"))


_PAIRS = "select a.vec_id a, b.vec_id b, list_cosine_similarity(a.embedding::double[], b.embedding::double[]) cosine from embeddings a join embeddings b on a.vec_id < b.vec_id"


@query(f"select a, b, round(cosine, 6) cosine from ({_PAIRS}) where cosine >= 0.40")
def similar_vectors(spark: SparkSession, d: str) -> DataFrame:
    """JN9, FN4: all pairs of vectors with a cosine of 0.40 and more."""
    return cosine_pairs(_vectors(spark, d), 0.40).withColumn("cosine", F.round("cosine", 6))


@query(f"select a, b, round(1 - cosine, 6) distance from ({_PAIRS}) where 1 - cosine < 0.58")
def near_vectors(spark: SparkSession, d: str) -> DataFrame:
    """JN10, FN5: all pairs with a cosine distance under 0.58."""
    return cosine_pairs(_vectors(spark, d), 0.42, strict=True).select("a", "b", F.round(1 - F.col("cosine"), 6).alias("distance"))


@query(f"""select id, other, round(cosine, 6) cosine, rank from (select id, other, cosine, row_number() over (partition by id order by cosine desc, other) rank
from (select a id, b other, cosine from ({_PAIRS}) where cosine >= 0.30 union all select b, a, cosine from ({_PAIRS}) where cosine >= 0.30)) where rank <= 15""")
def nearest_vectors(spark: SparkSession, d: str) -> DataFrame:
    """JN8, WN4: each vector's 16 nearest, itself not shown, as far as their cosine is 0.30 and more."""
    found = nearest(_vectors(spark, d), SearchConfig().neighbours - 1, 0.30)
    return found.select("id", "other", F.round("cosine", 6).alias("cosine"), "rank")


@query(f"select count(*) pairs, true enough from ({_PAIRS}) where cosine >= 0.40")
def lsh_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """OP18: approximate pairs by hashing, with the share of all pairs that they are."""
    found = approximate_pairs(_vectors(spark, d), 0.40)
    every = cosine_pairs(_vectors(spark, d), 0.40).join(found.select("a", "b", F.lit(1).alias("hit")), ["a", "b"], "left")
    return every.agg(F.count("*").alias("pairs"), (F.count("hit") >= 0.9 * F.count("*")).alias("enough"))


_GATE = "list_cosine_similarity(embedding::double[], (select embedding::double[] from embeddings where vec_id = 0))"


@query(f"select id from (select vec_id id, embedding from embeddings) where {_GATE} > 0.12")
def document_gate(spark: SparkSession, d: str) -> DataFrame:
    """FLT6: what looks enough like an archetype, here vector 0, to be read for text."""
    rows = _vectors(spark, d).withColumnRenamed("vector", "embedding")
    return search.document_gate(rows, _vector_of(spark, d, 0)).select("id")


# --- hashes --------------------------------------------------------------------------------------------------------

_BITS = "list_transform(embedding[2:64], lambda x: case when x > list_sort(embedding[2:64])[32] then 1 else 0 end)"


@query(f"select vec_id id, list_reduce(list_transform({_BITS}, lambda x: x::bigint), lambda s, x: s * 2 + x) bits from embeddings")
def median_hash(spark: SparkSession, d: str) -> DataFrame:
    """FN6: the bits of a hash: which values lie above their median."""
    return _vectors(spark, d).select("id", bits_to_number(median_bits(F.slice("vector", 2, 63))).alias("bits"))


@query()
def image_hashes(spark: SparkSession, d: str) -> DataFrame:
    """FN6, UD6: hashes of gray pictures, here of 16 x 16 values made from vectors."""
    gray = F.transform(F.flatten(F.array_repeat("vector", 4)), lambda x: F.round((x + 1) * 127).cast("int"))
    return _vectors(spark, d).select("id", F.hex(image_hash(gray)).alias("phash"))


_LIMBS = ", ".join(f"cast('0x' || h[{16 * i + 1}:{16 * i + 16}] as ubigint) h{i}" for i in range(4))
_APART = " + ".join(f"cast(bit_count(xor(a.h{i}, b.h{i})) as int)" for i in range(4))
_HASHED = f"(select id, h, {_LIMBS} from (select min(id) id, hex(phash) h from {P('phash', 'embedding')} where octet_length(phash) = 32 and embedding is not null group by 2))"
_EDGES = f"""(select a.id a, b.id b, {_APART} bits from {_HASHED} a join {_HASHED} b on a.id < b.id where {_APART} <= 10
union all select min(id) over (partition by phash), id, 0 from {P('phash', 'embedding')} where octet_length(phash) = 32 and embedding is not null qualify min(id) over (partition by phash) <> id)"""


def _for_dedup(spark: SparkSession, d: str) -> DataFrame:
    return photos(spark, d, "path", "size_bytes", "phash", "embedding").where("embedding is not null")


@query(f"select * from {_EDGES}")
def hamming_pairs(spark: SparkSession, d: str) -> DataFrame:
    """JN7, FN1: photos whose hashes differ in at most 10 bits."""
    return dedup.hash_links(_for_dedup(spark, d))


def _components(edges: str, name: str = "cc") -> str:
    return f"""e_{name} as (select a, b from {edges} union select b, a from {edges}), r_{name} as (select a v, a g from e_{name} union select e.b, r.g from r_{name} r join e_{name} e on e.a = r.v),
{name} as (select v id, min(g) component from r_{name} group by v)"""


@query(f"with recursive {_components(_EDGES)} select component, id from cc")
def phash_groups(spark: SparkSession, d: str) -> DataFrame:
    """OP3, AG8: groups of photos linked by near hashes."""
    return dedup.hash_groups(_for_dedup(spark, d))


_GOOD = "embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0"
_PHOTO_PAIRS = f"""(with v as (select id, embedding::double[] e, len(embedding) n from {P('embedding')} where {_GOOD})
select a.id a, b.id b from v a join v b on a.id < b.id and a.n = b.n where list_cosine_similarity(a.e, b.e) >= 0.90)"""


@query(f"with recursive {_components(_PHOTO_PAIRS)} select component, id from cc")
def embedding_groups(spark: SparkSession, d: str) -> DataFrame:
    """OP4: groups of photos linked by a cosine of 0.90 and more."""
    return dedup.vector_groups(_for_dedup(spark, d))


_BOTH = f"""with recursive {_components(_EDGES, 'h')}, s as (select * from {_PHOTO_PAIRS} where a not in (select id from h) and b not in (select id from h)), {_components('s', 'm')},
k as (select component, case when max(n) > 1 then 'exact' else 'near_exact' end "type" from (select component, hex(phash), count(*) n from h join {P('phash')} using (id) group by 1, 2) group by 1),
f as (select "type", component, id from h join k using (component) union all select 'semantic', component, id from m)"""


@query(f"{_BOTH} select * from f")
def duplicates(spark: SparkSession, d: str) -> DataFrame:
    """OP5, JN12, SET5, SET6: groups by hash, then groups by vector of the rest."""
    return dedup.find_duplicates(_for_dedup(spark, d))


_KEEP = f"(select component, arg_max(path, (coalesce(size_bytes, 0), path)) keep, count(*) size from g join {P('path', 'size_bytes')} using (id) group by 1)"


@query(f"with recursive {_components(_EDGES, 'g')} select component, keep, size - 1 remove, size from {_KEEP}")
def representatives(spark: SparkSession, d: str) -> DataFrame:
    """AG11, WN3: the photo to keep of each group: the largest, of equal ones the last path."""
    rows = _for_dedup(spark, d)
    return dedup.representatives(dedup.hash_groups(rows), rows)


@query(f"with recursive {_components(_EDGES, 'g')} select component, min(bits) distance from {_EDGES} e join g on g.id = e.a group by 1")
def least_distances(spark: SparkSession, d: str) -> DataFrame:
    """AG10: the smallest distance within each group."""
    rows = _for_dedup(spark, d)
    links = dedup.hash_links(rows)
    return dedup.least_distance(dedup.hash_groups(rows), links)


@query(f"""with recursive {_components(_EDGES, 'g')}, k as (select id, keep from g join {_KEEP} using (component))
select p.id, case when keep <> path then 1 else is_duplicate end is_duplicate, case when keep <> path then keep else duplicate_of end duplicate_of
from {P('path', 'is_duplicate', 'duplicate_of')} p left join k using (id)""")
def mark_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """SNK6, OP10: the table with the photos flagged that would go."""
    rows = _for_dedup(spark, d)
    marks = dedup.marks(dedup.hash_groups(rows), rows)
    return marked(photos(spark, d, "path", "is_duplicate", "duplicate_of"), marks).drop("path")


@query(f"with recursive {_components(_EDGES, 'g')} select path, keep, 'planned' status from g join {P('path')} using (id) join {_KEEP} using (component) where path <> keep")
def deletion_manifest(spark: SparkSession, d: str) -> DataFrame:
    """SNK4, SNK18: what a deletion would remove; no file is touched."""
    rows = _for_dedup(spark, d)
    return dedup.manifest(dedup.hash_groups(rows), rows)


@query(f"with recursive {_components(_EDGES, 'g')} select count(*) \"groups\", sum(n - 1) removable from (select component, count(*) n from g group by 1)")
def duplicate_summary(spark: SparkSession, d: str) -> DataFrame:
    """AG16: how many groups and removable photos there are."""
    return dedup.summary(dedup.hash_groups(_for_dedup(spark, d)))


@query(f"with recursive {_components(f'(select a, b from ({_PAIRS}) where cosine >= 0.40)')} select id node, component, dense_rank() over (order by component) - 1 label from cc")
def components(spark: SparkSession, d: str) -> DataFrame:
    """AG8, AG9: components of the graph of similar vectors, numbered by their smallest member."""
    return groups(cosine_pairs(_vectors(spark, d), 0.40, forest=True))


# --- faces ---------------------------------------------------------------------------------------------------------

_CENTRES = f"""(select person_id, max(n) n, list(m order by p) c from (select person_id, p, avg(x) m, count(*) n from
(select person_id, unnest(embedding)::double x, generate_subscripts(embedding, 1) p from {FC('person_id', 'embedding')} where person_id is not null and embedding is not null) group by 1, 2) group by 1)"""


@query(f"select person_id, n, round(list_sum(c) / case when sqrt(list_sum(list_transform(c, lambda x: x * x))) > 1e-6 then sqrt(list_sum(list_transform(c, lambda x: x * x))) else 1 end, 5) total from {_CENTRES}")
def person_centroids(spark: SparkSession, d: str) -> DataFrame:
    """AG6, AG7: each person's mean vector (here the sum of its elements)."""
    rows = people.centroids(faces(spark, d, "person_id", "embedding"))
    return rows.select("person_id", "n", F.round(F.aggregate("centroid", F.lit(0.0), lambda s, x: s + x), 5).alias("total"))


@query(f"""select id, case when d < 0.45 then person_id end person_id, round(case when d < 0.45 then d end, 5) distance from (select f.id, arg_min(c.person_id, (1 - list_cosine_similarity(f.embedding::double[], c.c), c.person_id)) person_id,
min(1 - list_cosine_similarity(f.embedding::double[], c.c)) d from (select * from {FC('person_id', 'embedding')} where person_id is null and {_GOOD}) f, {_CENTRES} c group by f.id)""")
def assign_faces(spark: SparkSession, d: str) -> DataFrame:
    """JN11, OP8: faces without person, given to the nearest one."""
    rows = faces(spark, d, "person_id", "embedding")
    found = people.assign(rows.where("person_id is null"), people.centroids(rows))
    return found.withColumn("distance", F.round("distance", 5))


_FACE_PAIRS = f"(with v as (select id, embedding::double[] e from {FC('embedding')} where {_GOOD}) select a.id a, b.id b from v a join v b on a.id < b.id where 1 - list_cosine_similarity(a.e, b.e) < 0.50)"
_LABELS = f"l as (select id, dense_rank() over (order by component) - 1 label from cc)"


@query(f"with recursive {_components(_FACE_PAIRS)}, {_LABELS} select f.id, coalesce(label, -1) label from {FC()} f left join l using (id)")
def cluster_faces(spark: SparkSession, d: str) -> DataFrame:
    """OP6, AG9: faces linked by distances under 0.50."""
    return people.cluster(face_vectors(spark, d))


@query(f"with recursive {_components(_FACE_PAIRS)}, {_LABELS} select label + 1000 id, min(id) representative_face_id, count(*) n_faces from l group by label")
def group_faces(spark: SparkSession, d: str) -> DataFrame:
    """OP7, SNK11, WN5: new persons for all clusters, represented by their first faces."""
    persons, owners = people.new_persons(people.cluster(face_vectors(spark, d)), 1000, 0.0)
    n = owners.groupBy(F.col("person_id").alias("id")).agg(F.count("*").alias("n_faces"))
    return persons.select("id", "representative_face_id").join(n, "id")


_DENSE = _FACE_PAIRS.replace("< 0.50)", "<= 0.45)")


@query(f"with recursive {_components(_DENSE)}, {_LABELS} select f.id, coalesce(label, -1) label from {FC()} f left join l using (id)")
def density_faces(spark: SparkSession, d: str) -> DataFrame:
    """OP15: faces clustered by density."""
    return people.density_clusters(faces(spark, d, "embedding"))


# --- words and rules -----------------------------------------------------------------------------------------------

_STOP = "['" + "', '".join(words.STOP_WORDS) + "']"
_TOKENS = "list_filter(regexp_split_to_array(lower(query), '\\s+'), lambda w: w <> '')"
_ASKED = f"(select distinct query from {FEEDBACK_SQL} where query is not null)"


@query(f"select query, list_aggregate(case when len(k) > 0 then k else t end, 'string_agg', ' ') words from (select query, t, list_filter(t, lambda w: not list_contains({_STOP}, w) and length(w) >= 3) k from (select query, {_TOKENS} t from {_ASKED}))")
def meaningful_words(spark: SparkSession, d: str) -> DataFrame:
    """FN8, FN9: the words of queries that say something."""
    asked = feedback(spark, d).where("query is not null").select("query").distinct()
    joined = F.array_join(words.meaningful_tokens(F.col("query")), " ")
    return asked.select("query", F.when(joined != "", joined).alias("words"))


def _list(items: list[str]) -> str:
    return "['" + "', '".join(items) + "']"


_COUNTS = f"""(select query, len(list_filter(t, lambda w: list_contains({_list(words.METADATA_WORDS)}, w))) + regexp_matches(query, '\\b(19|20)\\d{{2}}\\b')::int + regexp_matches(query, '\\d+x\\d+')::int m,
len(list_filter(t, lambda w: list_contains({_list(words.VISUAL_WORDS)}, w))) v, len(list_filter(t, lambda w: list_contains({_list(words.TEXT_WORDS)}, w))) t from (select query, {_TOKENS} t from {_ASKED}))"""
_KINDS = "(m > 0)::int + (v > 0)::int + (t > 0)::int"


def _weight(own: str, fallback: float, alone: dict[str, float], all_: float) -> str:
    return f"""case when {_KINDS} = 0 then {fallback} when {_KINDS} = 3 then {all_} when {_KINDS} = 2 then case when {own} > 0 then 0.4 + {own}::double / (m + v + t) * 0.3 else 0.1 end
when m > 0 then {alone['m']} when v > 0 then {alone['v']} else {alone['t']} end::double"""


@query(f"""select query, m, v, t, case when {_KINDS} = 0 then 'VISUAL' when {_KINDS} > 1 then 'HYBRID' when m > 0 then 'METADATA' when v > 0 then 'VISUAL' else 'TEXT' end intent,
round({_weight('v', 0.7, {'m': 0.2, 'v': 0.8, 't': 0.2}, 0.5)}, 6) visual, round({_weight('t', 0.2, {'m': 0.1, 'v': 0.1, 't': 0.7}, 0.3)}, 6) ocr, round({_weight('m', 0.1, {'m': 0.7, 'v': 0.1, 't': 0.1}, 0.2)}, 6) metadata from {_COUNTS}""")
def query_intent(spark: SparkSession, d: str) -> DataFrame:
    """AG15, FN10, FN28: what queries ask for, and the weights they get."""
    asked = feedback(spark, d).where("query is not null").select("query").distinct()
    counted = asked.select("query", *[c.alias(n) for n, c in words.class_counts(F.col("query")).items()])
    plan = words.intent_and_weights(F.col("m"), F.col("v"), F.col("t"))
    return counted.select("query", "m", "v", "t", *[(c if n == "intent" else F.round(c, 6)).alias(n) for n, c in plan.items()])


_OCR = """least(3.0, list_sum(list_transform({0}, lambda w: case when length(w) < 3 then 0.0 when contains(' ' || b || ' ', ' ' || w || ' ') then 1.0 when contains(b, w) then 0.6
when len(list_filter(regexp_split_to_array(b, '\\s+'), lambda x: length(x) >= 3 and contains(w, x) and length(w) - length(x) <= 2)) > 0 then 0.3 else 0.0 end)))::double"""


@query(f"select id, case when b is null or b = '' then 0.0 else round({_OCR.format(_list(['total', 'harbours', 'moonlit', 'ferry']))}, 6) end score from (select id, lower(ocr_text) b from {P('ocr_text')})")
def ocr_score(spark: SparkSession, d: str) -> DataFrame:
    """FN11, AG17: how well the text of photos matches a query."""
    plan = words.meaningful_tokens(F.lit("total harbours moonlit ferry"))
    score = words.text_score(F.lit("total harbours moonlit ferry"), plan, F.col("ocr_text"))
    return photos(spark, d, "ocr_text").select("id", F.round(score, 6).alias("score"))


def _rule_scores(spark: SparkSession, d: str, *asked: str) -> DataFrame:
    rows = photos(spark, d, "metadata").withColumn("m", meta.parsed(F.col("metadata")))
    empty = meta.is_empty(F.col("metadata"))
    return rows.select("id", *[F.round(meta.score_and_reasons(q, F.col("m"), NOW, empty)[0], 6).alias(f"q{i}") for i, q in enumerate(asked)])


_M = f"(select id, case when metadata is not null and json_valid(metadata) and coalesce(len(json_keys(metadata)), 0) > 0 then metadata end j from {P('metadata')})"
_J = lambda key, kind="varchar": f"try_cast(json_extract_string(j, '$.{key}') as {kind})"
_AT = f"try_strptime({_J('date_taken')}, '%Y:%m:%d %H:%M:%S')"
_AGO = f"floor((epoch(timestamp '2024-06-01') - epoch({_AT})) / 86400)"


def _points(*cases: tuple[str, float | str]) -> str:
    return "round(case when j is null then 0.0 else " + " + ".join(f"case when {c} then {p} else 0.0 end" for c, p in cases) + " end::double, 6)"


@query(f"""select id, {_points((f"year({_AT}) = 2016", 1.5), (f"month({_AT}) = 11", 1.5), (f"day({_AT}) = 28", 0.5), (f"hour({_AT}) >= 5 and hour({_AT}) < 12", 1.0))} q0,
{_points((f"{_AGO} < 30", f"case when {_AGO} < 7 then 1.5 else 1.0 end"), (f"hour({_AT}) >= 17 and hour({_AT}) < 21", 1.0))} q1, {_points((f"{_AGO} > 365", 1.0), (f"hour({_AT}) >= 21 or hour({_AT}) < 5", 1.0), (f"json_type(j, '$.iso') <> 'VARCHAR' and json_extract_string(j, '$.iso')::int >= 800", 1.0))} q2 from {_M}""")
def date_rules(spark: SparkSession, d: str) -> DataFrame:
    """D1-D6, FN18, FN19: dates, months, days and times of day."""
    return _rule_scores(spark, d, "28 november 2016 morning", "recent evening", "older night")


_LOC, _DEV = f"lower({_J('location_name')})", f"lower({_J('device')})"


@query(f"""select id, {_points((f"contains({_LOC}, 'dorzan')", 1.0))} q0, {_points((f"coalesce({_J('gps_latitude', 'double')}, 0) <> 0 and coalesce({_J('gps_longitude', 'double')}, 0) <> 0", 0.5))} q1,
{_points((f"contains({_DEV}, 'pixel')", 1.5), (f"regexp_matches({_DEV}, 'oneplus|samsung|iphone|pixel')", 0.8), (f"regexp_matches({_DEV}, 'canon|nikon|sony')", 0.8))} q2 from {_M}""")
def device_location_rules(spark: SparkSession, d: str) -> DataFrame:
    """L1-L3, V1-V3: places and devices."""
    return _rule_scores(spark, d, "Dorzan", "gps map", "pixel phone camera")


_ISO, _F, _ALT, _W, _H = "case when json_type(j, '$.iso') <> 'VARCHAR' then json_extract_string(j, '$.iso')::int end", f"try_cast(replace({_J('aperture')}, 'f/', '') as double)", _J("altitude", "double"), _J("width", "int"), _J("height", "int")
_MP = f"({_W}::double * {_H} / 1000000)"


@query(f"""select id, {_points((f"{_ISO} >= 800", 1.0), (f"{_F} <= 2.8", 1.0), (f"{_H} > {_W}", 0.5), (f"{_J('face_category')} = 'portrait'", 1.5), (f"{_J('face_category')} = 'duo'", 0.5))} q0,
{_points((f"{_ISO} <= 200 and {_ISO} <> 0", 0.8), (f"{_F} >= 8.0", 0.8), (f"{_W} > {_H}", 0.5), (f"coalesce({_ALT}, 0) <> 0 and {_ALT} > 500", f"case when {_ALT} > 1000 then 1.5 else 1.0 end"))} q1,
{_points((f"lower({_J('flash')}) = 'yes'", 1.0), (f"{_MP} > 8", 0.8), (f"abs({_W} - {_H}) < least({_W}, {_H}) * 0.1", 0.5))} q2, {_points((f"coalesce({_ALT}, 0) <> 0 and {_ALT} < 50", 1.0), (f"{_MP} < 1", 0.5))} q3 from {_M}""")
def settings_rules(spark: SparkSession, d: str) -> DataFrame:
    """C1-C6, A1, A2, P1-P5, F2, FN20, FN21: settings, heights and sizes."""
    return _rule_scores(spark, d, "dark portrait", "bright landscape hill", "flash large square", "beach thumbnail")


_HUES = "coalesce(json_extract(j, '$.dominant_colors')::varchar[], [])"


@query(f"""select id, {_points((f"coalesce({_J('has_faces', 'boolean')}, false)", 1.8), ("true", -0.3), (f"{_J('face_category')} = 'group'", 1.5), (f"{_J('face_category')} = 'duo'", 0.8))} q0,
{_points((f"{_J('scene_type')} = 'outdoor'", 1.5), (f"{_J('scene_type')} = 'outdoor' and {_J('scene_type')} <> 'unknown' or coalesce({_J('scene_environment')}, '') = 'sky'", 1.0))} q1,
{_points((f"len({_HUES}) > 0 and {_J('color_tone')} = 'warm'", 1.5), (f"list_contains({_HUES}, 'red')", 1.2))} q2,
{_points((f"coalesce({_J('is_blurry', 'boolean')}, false)", 1.5), (f"not coalesce({_J('is_blurry', 'boolean')}, false) and coalesce({_J('blur_score', 'double')}, 0) > 200", 1.5), (f"{_J('quality_rating')} = 'poor'", 1.0), (f"{_J('exposure')} in ('underexposed', 'dark')", 1.0))} q3,
{_points((f"not coalesce({_J('is_blurry', 'boolean')}, false) and coalesce({_J('blur_score', 'double')}, 0) > 200", 1.5), (f"{_J('quality_rating')} in ('excellent', 'good')", 1.5))} q4 from {_M}""")
def picture_rules(spark: SparkSession, d: str) -> DataFrame:
    """F1-F4, S1-S5, K1-K5, Q1-Q7, OP19: faces, scenes, colours and quality."""
    return _rule_scores(spark, d, "people team", "outdoor sky", "warm red", "unfocused poor underexposed", "crisp excellent")


def _placed(asked: str) -> tuple[str, float]:
    """The SQL of rule L2: a longer word of the query is a part of the place's name."""
    return " or ".join(f"contains({_LOC}, '{w}')" for w in asked.split() if len(w) > 3), 1.0


_SEEN = f"coalesce({_J('scene_type')}, 'unknown') not in ('unknown', '')"
_TINT = f"len({_HUES}) > 0 and {_J('color_tone')}"
_MORE = ["village afternoon", "indoor garden street", "cool muted vivid", "overexposed nobody", "well exposed no flash"]


@query(f"""select id, {_points((f"contains({_LOC}, 'village')", 1.5), _placed(_MORE[0]), (f"hour({_AT}) >= 12 and hour({_AT}) < 17", 1.0))} q0,
{_points(_placed(_MORE[1]), (f"{_J('scene_type')} = 'indoor'", 1.5), (f"{_SEEN} and {_J('scene_environment')} = 'natural'", 1.5), (f"{_SEEN} and {_J('scene_environment')} = 'urban'", 1.5))} q1,
{_points(_placed(_MORE[2]), (f"{_TINT} = 'cool'", 1.5), (f"len({_HUES}) > 0 and {_J('color_vibrance')} = 'vibrant'", 1.5), (f"len({_HUES}) > 0 and {_J('color_vibrance')} = 'muted'", 1.5))} q2,
{_points(_placed(_MORE[3]), (f"{_J('exposure')} = 'overexposed'", 1.0), (f"not coalesce({_J('has_faces', 'boolean')}, false)", 1.0))} q3,
{_points(_placed(_MORE[4]), (f"{_J('exposure')} = 'well_exposed'", 1.0), (f"contains(lower({_J('flash')}), 'yes') or contains(lower({_J('flash')}), 'fired')", 1.0), (f"contains(lower({_J('flash')}), 'no')", 0.8))} q4 from {_M}""")
def further_rules(spark: SparkSession, d: str) -> DataFrame:
    """L1, D4, S2-S4, K2-K4, Q5, Q6, F4, C5, C6: the rules that the queries above don't ask for."""
    return _rule_scores(spark, d, *_MORE)


@query()
def rule_reasons(spark: SparkSession, d: str) -> DataFrame:
    """FN12, OP19: why photos match a query."""
    rows = photos(spark, d, "metadata")
    score, why = meta.score_and_reasons("warm outdoor people at night with flash 2016", meta.parsed(F.col("metadata")), NOW, meta.is_empty(F.col("metadata")))
    return rows.select("id", F.round(score, 6).alias("score"), F.array_join(why, "; ").alias("reasons"))


# --- search --------------------------------------------------------------------------------------------------------

_RANKED = f"""(select id, score, row_number() over (order by score desc, id) rank, max(score) over () top, lag(score) over (order by score desc, id) last
from (select vec_id id, {_GATE} score from embeddings where vec_id <> 0 order by 2 desc, 1 limit 100))"""


@query(f"""with s as (select * from {_RANKED}), g as (select arg_min(last - 0.05::double * (last - score), rank) gap from s where rank <= 30 and last - score >= 0.10::double * top),
t as (select greatest(coalesce(gap, 0), top * 0.70::double, top * (1 - 0.30::double)) thr from g, (select max(top) top from s)) select id, rank, round(score, 6) score, round(thr, 6) threshold from s, t where (score >= thr or rank = 1) and rank <= 50""")
def adaptive_threshold(spark: SparkSession, d: str) -> DataFrame:
    """FLT9, WN1, TK2-TK4: results cut where their scores fall."""
    best = top_similar(_vectors(spark, d).where("id <> 0"), _vector_of(spark, d, 0), 100).withColumnRenamed("similarity", "score")
    return search.kept(best).select("id", "rank", F.round("score", 6).alias("score"), F.round("threshold", 6).alias("threshold"))


_ASK = "sunset over the harbour"
#: In the place of a query's vector stands the mean of the vectors of some photos.
_LIKE = "id <= 1000"
_SEED = f"""(select list(m order by p) embedding from (select p, avg(x) m from (select unnest(embedding)::double x, generate_subscripts(embedding, 1) p
from (select * from {P('embedding')} where {_LIKE}) where {_GOOD} and len(embedding) = 512) group by p))"""


def _search(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "photos").select("id", "loaded_at", "path", "embedding", "ocr_text", "metadata")
    like = current(table(spark, d, "photos").where(_LIKE), "embedding").where("size(embedding) = 512").where(is_vector(F.col("embedding")))
    mean = np.mean([r["embedding"] for r in like.collect()], axis=0)
    log = table(spark, d, "search_feedback").where(F.col("query") == _ASK).dropDuplicates(["id"])  # repeated rows are identical
    return search.search(rows, log, _ASK, mean.tolist(), NOW, version="loaded_at")


_VISION = f"list_inner_product(p.embedding::double[], s.embedding::double[]) / ((sqrt(list_inner_product(p.embedding::double[], p.embedding::double[])) + 1e-8::double) * (sqrt(list_inner_product(s.embedding::double[], s.embedding::double[])) + 1e-8::double))"


_MULTIPLIER = """case when neg > 0 and pos = 0 then greatest(0.1::double, 1.0::double - 0.12::double * neg)
when neg > 0 then greatest(0.3::double, 1.0::double - 0.7::double * (neg::double / (pos + neg))) when pos > 0 then least(1.3::double, 1.0::double + 0.06::double * pos) else 1.0::double end"""


_KIND = """coalesce(nullif(concat_ws(' + ', case when v > 0.2 then 'Visual' end, case when o > 0 then 'OCR Text' end, case when m > 0 then 'Metadata' end), ''), 'Visual')"""
_RESULTS = f"""with c as (select p.id, p.path, lower(p.ocr_text) b, p.metadata, {_VISION} v from {P('path', 'embedding', 'ocr_text', 'metadata')} p, {_SEED} s
where p.embedding is not null and len(p.embedding) = 512 and len(list_filter(p.embedding, lambda x: isnan(x))) = 0 order by v desc, p.id limit 100),
j as (select *, case when metadata is not null and json_valid(metadata) and coalesce(len(json_keys(metadata)), 0) > 0 then metadata end j from c),
m as (select id, path, v, j, case when b is null or b = '' then 0.0 else {_OCR.format("['sunset', 'harbour']")} end o,
{_points((f"contains({_LOC}, 'sunset') or contains({_LOC}, 'over') or contains({_LOC}, 'harbour')", 1.0), (f"{_J('scene_type')} = 'outdoor' or coalesce({_J('scene_environment')}, '') = 'sky'", 1.0))} m from j),
f as (select result_path path, {_MULTIPLIER} x from (select result_path, count(*) filter (feedback_type in ('POSITIVE', 'CLICKED')) pos, count(*) filter (feedback_type = 'NEGATIVE') neg from {FEEDBACK_SQL} where query = '{_ASK}' group by 1)),
w as (select m.*, coalesce(x, 1.0) penalty, v * 0.8::double + o * 0.1::double + m * 0.1::double raw from m left join f using (path)),
s as (select *, raw * penalty score, row_number() over (order by raw * penalty desc, raw desc, v desc, id) rank from w),
l as (select *, max(score) over () top, lag(score) over (order by rank) last from s),
g as (select arg_min(last - 0.05::double * (last - score), rank) gap from l where rank <= 30 and last - score >= 0.10::double * top),
t as (select case when gap is null then share else greatest(gap, share) end thr from g, (select greatest(max(top) * 0.70::double, max(top) * (1 - 0.30::double)) share from l))"""


@query(f"""{_RESULTS} select rank, id, path, round(score, 5) score, round(v, 5) v_score, round(o, 5) o_score, round(m, 5) m_score, round(penalty, 5) penalty,
{_KIND} match_type
from l, t where (score >= thr or rank = 1) and rank <= 50""")
def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    """OP2, JN5, JN6, FN24: the whole search for a query, in the place of whose vector stands a mean of photos'."""
    found = _search(spark, d)
    kind = search.match_type(F.col("v_score"), F.col("o_score"), F.col("m_score"))
    return found.select("rank", "id", "path", *[F.round(c, 5).alias(c) for c in ("score", "v_score", "o_score", "m_score", "penalty")], kind.alias("match_type"))


_FOUND_IN = "list_filter(['sunset', 'over', 'harbour'], lambda w: contains(" + _LOC + ", w))[1]"


@query(f"""{_RESULTS} select rank, concat_ws(' | ', '[' || rank || '] Score: ' || printf('%.4f', score) || ' (' || {_KIND} || ')',
case when penalty > 1 then 'Boosted ' || trunc((penalty - 1) * 100)::int || '%' when penalty < 1 then 'Downranked ' || trunc((1 - penalty) * 100)::int || '%' end, path,
printf('Visual=%.3f, OCR=%.1f, Metadata=%.2f', v, o, m), nullif(concat_ws(', ', 'Location contains: ' || {_FOUND_IN}, case when {_J('scene_type')} = 'outdoor' or coalesce({_J('scene_environment')}, '') = 'sky' then 'Sky visible' end), '')) line
from l, t where (score >= thr or rank = 1) and rank <= 50""")
def report_text(spark: SparkSession, d: str) -> DataFrame:
    """SNK17, FN24, FN25: the results as lines of a report."""
    return search.report_lines(_search(spark, d))


# --- pictures and their files --------------------------------------------------------------------------------------

_E = lambda i: f"(embedding[{i}]::double + 1) / 2"
_SHARE = {name: f"floor({_E(10 + i)} * 12) / 20 - 0.2" for i, name in enumerate(visual.COLOR_RANGES)}
_SORTED = "list_sort(list_filter([" + ", ".join(f"{{'v': -s_{n}, 'p': {i}, 'k': '{n}'}}" for i, n in enumerate(visual.COLOR_RANGES)) + "], lambda x: x.v < -0.05))"
_PART = lambda names: " + ".join(f"s_{n}" for n in names)
_OUT = f"({_E(1)} > 0.60 or {_E(2)} > 0.62 or ({_E(4)} * 255 > 160 and ({_E(1)} > 0.5 or {_E(2)} > 0.5)))"


@query(f"""with m as (select vec_id, 400 * {_E(5)} b, {_E(6)} - 0.2 dk, {_E(7)} - 0.25 br, 255 * {_E(4)} mn, {_E(1)} - 0.5 sky, {_E(2)} - 0.5 gr, {_E(3)} - 0.4 ed, 200 * {_E(8)} sat,
{', '.join(f"{x} s_{n}" for n, x in _SHARE.items())} from embeddings),
x as (select *, case when dk > 0.40 then 'underexposed' when br > 0.40 then 'overexposed' when mn < 60 then 'dark' when mn > 200 then 'bright' else 'well_exposed' end exposure,
sky > 0.10 or gr > 0.15 or (mn > 160 and (sky > 0.05 or gr > 0.08)) outdoor, {_SORTED} hues, {_PART(visual.WARM)} warm, {_PART(visual.COOL)} cool from m)
select vec_id id, case (vec_id % 5)::int when 0 then 'no_faces' when 1 then 'portrait' when 2 then 'duo' else 'group' end face_category,
b < 100 is_blurry, exposure, case when outdoor then 'outdoor' else 'indoor' end scene_type,
case when not outdoor then 'indoor' when gr > 0.15 and ed < 0.12 then 'natural' when ed > 0.15 then 'urban' when sky > 0.20 and gr < 0.05 then 'sky' else 'mixed' end scene_environment,
case when len(hues) = 0 then ['mixed'] else list_transform(hues[1:3], lambda h: h.k) end dominant_colors,
case when warm > cool * 1.5 then 'warm' when cool > warm * 1.5 then 'cool' else 'neutral' end color_tone, case when sat > 120 then 'vibrant' when sat > 60 then 'moderate' else 'muted' end color_vibrance,
case (case when b >= 100 then 2 else 0 end + case when b > 300 then 1 else 0 end + case when exposure = 'well_exposed' then 2 when exposure in ('dark', 'bright') then 1 else 0 end)
when 5 then 'excellent' when 4 then 'excellent' when 3 then 'good' when 2 then 'fair' else 'poor' end quality_rating from x""")
def visual_decisions(spark: SparkSession, d: str) -> DataFrame:
    """FN22, FN23, TK6: decisions on pixel measures, here made from vectors; shares are made so that many are equal."""
    e = lambda i: (F.col("vector")[i - 1].cast("double") + 1) / 2
    shares = F.create_map(*[x for i, n in enumerate(visual.COLOR_RANGES) for x in (F.lit(n), F.floor(e(10 + i) * 12) / 20 - 0.2)])
    said = visual.quality(400 * e(5), e(6) - 0.2, e(7) - 0.25, 255 * e(4)) | visual.scene(e(1) - 0.5, e(2) - 0.5, e(3) - 0.4, 255 * e(4)) | visual.colors(shares, 200 * e(8))
    count = F.when(F.col("id") % 5 > 2, 3).otherwise(F.col("id") % 5)
    return _vectors(spark, d).select("id", visual.face_category(count).alias("face_category"), *[c.alias(n) for n, c in said.items() if n != "blur_score"])


@query()
def picture_measures(spark: SparkSession, d: str) -> DataFrame:
    """AG12, TK6, SRC12: pixel measures of pictures, here of 24 x 16 made from hashes, and the decisions on them."""
    pixels = F.concat(*[F.col("phash")] * 36)
    some = photos(spark, d, "phash").where("octet_length(phash) = 32")
    rows = spread(some, "id").select("id", visual.pixel_measures(pixels, F.lit(24), F.lit(16)).alias("x"))
    decided = visual.colors(F.col("x.shares"), F.col("x.saturation")) | visual.scene(F.col("x.sky"), F.col("x.green"), F.col("x.edge"), F.col("x.brightness"))
    decided |= visual.quality(F.col("x.blur"), F.col("x.dark"), F.col("x.bright"), F.col("x.mean"))
    return rows.select("id", *[c.alias(n) for n, c in decided.items()])


@query(f"""select id, case when coalesce({_J('device_make')}, '') <> '' and coalesce({_J('device_model')}, '') <> '' then {_J('device_make')} || ' ' || {_J('device_model')}
else coalesce(nullif({_J('device_make')}, ''), nullif({_J('device_model')}, '')) end device, printf('%.6f, %.6f', {_J('gps_latitude', 'double')}, {_J('gps_longitude', 'double')}) as "location", printf('%.1fm', {_J('altitude', 'double')}) altitude_text from {_M}""")
def file_facts(spark: SparkSession, d: str) -> DataFrame:
    """SRC14, FN16, FN17, FN26: facts of a file as they are written down."""
    rows = photos(spark, d, "metadata").withColumn("m", F.when(~meta.is_empty(F.col("metadata")), meta.parsed(F.col("metadata"))))
    both = F.col("m.gps_latitude").isNotNull() & F.col("m.gps_longitude").isNotNull()
    return rows.select(
        "id",
        meta.device_name(F.col("m.device_make"), F.col("m.device_model")).alias("device"),
        F.when(both, meta.location_text(F.col("m.gps_latitude"), F.col("m.gps_longitude"))).alias("location"),
        F.when(F.col("m.altitude").isNotNull(), meta.altitude_text(F.col("m.altitude"))).alias("altitude_text"),
    )


@query("select l_orderkey, l_linenumber, round((case when l_linenumber % 2 = 0 then -1 else 1 end) * (l_orderkey % 90 + l_linenumber::double / 60 + l_quantity / 3600), 8) degrees from lineitem")
def gps_degrees(spark: SparkSession, d: str) -> DataFrame:
    """FN14: degrees, minutes and seconds as decimals, here made from orders."""
    ref = F.when(F.col("l_linenumber") % 2 == 0, "S").otherwise("N")
    value = meta.degrees(F.col("l_orderkey") % 90, F.col("l_linenumber"), F.col("l_quantity"), ref)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(value, 8).alias("degrees"))


@query("""select c_custkey, list_aggregate(list_filter([nullif(c_mktsegment, ''), case when n_name is distinct from c_mktsegment then nullif(n_name, '') end, r_name, case n_nationkey % 3 when 0 then 'India' when 1 then 'Germany' else 'XX' end], lambda x: x is not null), 'string_agg', ', ') place
from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey""")
def place_names(spark: SparkSession, d: str) -> DataFrame:
    """FN15: places written out, here made from customers' segments, nations and regions."""
    rows = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    code = F.when(F.col("n_nationkey") % 3 == 0, "IN").when(F.col("n_nationkey") % 3 == 1, "DE").otherwise("XX")
    return rows.select("c_custkey", meta.place_text(F.col("c_mktsegment"), F.col("n_name"), F.col("r_name"), code).alias("place"))


@query("""select doc_id, coalesce(list_aggregate(list_transform(list_filter(l, lambda x, i: (i - 1) % 5 <> 0 and trim(x) <> ''), lambda x: trim(x)), 'string_agg', ' '), '') "text"
from (select doc_id, string_split("text", chr(10)) l from documents where "text" is not null)""")
def kept_lines(spark: SparkSession, d: str) -> DataFrame:
    """FLT8: the lines of a text that were read surely, here all but each fifth."""
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.struct(x.alias("text"), F.when(i % 5 == 0, 0.4).otherwise(0.9).alias("confidence")))
    return table(spark, d, "documents").where("text is not null").select("doc_id", visual.kept_lines(lines).alias("text"))


QUERIES = Q
