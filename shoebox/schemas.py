"""Explicit schemas, and reading tables that lack columns of later versions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


_KINDS = {
    "bigint": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "string": T.StringType(), "boolean": T.BooleanType(), "binary": T.BinaryType(),
    "timestamp_ntz": T.TimestampNTZType(), "array<float>": T.ArrayType(T.FloatType()), "array<string>": T.ArrayType(T.StringType()),
}


def _struct(text: str) -> T.StructType:
    """A schema from "name type, ..."; needs no session."""
    return T.StructType([T.StructField(name, _KINDS[kind]) for name, kind in (part.split() for part in text.split(", "))])


PHOTOS = _struct(
    "id bigint, path string, filename string, size_bytes bigint, modified_time double, embedding array<float>, metadata string, ocr_text string, phash binary, is_duplicate int, duplicate_of string"
)
FACES = _struct(
    "id bigint, photo_id bigint, person_id bigint, bbox_x1 double, bbox_y1 double, bbox_x2 double, bbox_y2 double, det_score double, embedding array<float>, age_estimate int, gender string"
)
PERSONS = _struct("id bigint, name string, representative_face_id bigint, created_at double, updated_at double")
FEEDBACK = _struct(
    "id bigint, query string, query_intent string, weights_used string, result_path string, result_rank int, result_scores string, feedback_type string, timestamp timestamp_ntz"
)
LISTING = _struct("path string, mtime double, size bigint")
WEIGHTS = _struct("visual double, ocr double, metadata double")
SCORES = _struct("visual double, ocr double, metadata double, final double")

#: What is known of a photo from its file and its picture; keys that are absent are NULL.
METADATA = _struct(
    "width int, height int, format string, mode string, device_make string, device_model string, software string, date_taken string, date_modified string, "
    "iso int, orientation int, aperture string, focal_length string, shutter_speed string, flash string, gps_latitude double, gps_longitude double, location string, "
    "location_name string, gps_altitude string, altitude double, gps_timestamp string, device string, face_count int, has_faces boolean, face_category string, "
    "scene_type string, scene_environment string, dominant_colors array<string>, color_tone string, color_vibrance string, blur_score double, is_blurry boolean, "
    "exposure string, quality_rating string"
)
DEFAULTS = {"is_duplicate": 0, "metadata": "{}"}


def migrated(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` with all columns of ``schema`` in its types: missing ones as NULL or their default; others stay behind them."""
    have = set(df.columns)
    wanted = [(F.col(f.name) if f.name in have else F.lit(DEFAULTS.get(f.name))).cast(f.dataType).alias(f.name) for f in schema]
    return df.select(*wanted, *[c for c in df.columns if c not in schema.fieldNames()])
