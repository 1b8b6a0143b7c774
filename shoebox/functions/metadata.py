"""What is known of a photo, as a typed struct, and the rules that match it to a query.

The rules stand in one list: each has a condition on the query, a condition on the photo, its points and its reason. For
a query that is a literal the conditions on it are folded in Python, so that only rules that can apply reach the plan;
for a column of queries the same list gives ``contains`` expressions.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from shoebox.functions.text import tokens
from shoebox.schemas import METADATA

#: Names that rules look for, in the order in which the first match counts.
PLACES = ["delhi", "india", "pitampura", "mumbai", "bangalore", "chennai", "kolkata", "hyderabad", "pune", "ahmedabad", "city", "town", "village", "country", "state"]
BRANDS = ["oneplus", "samsung", "apple", "iphone", "pixel", "google", "xiaomi", "oppo", "vivo", "realme", "nokia", "motorola", "canon", "nikon", "sony", "fujifilm", "olympus"]
COLORS = ["red", "orange", "yellow", "green", "blue", "purple", "pink", "white", "black", "brown"]
MONTHS = {
    "january": 1, "jan": 1, "february": 2, "feb": 2, "march": 3, "mar": 3, "april": 4, "apr": 4, "may": 5, "june": 6, "jun": 6, "july": 7, "jul": 7,
    "august": 8, "aug": 8, "september": 9, "sep": 9, "sept": 9, "october": 10, "oct": 10, "november": 11, "nov": 11, "december": 12, "dec": 12,
}

EXIF_TIME = "yyyy:MM:dd HH:mm:ss"


def parsed(metadata: Column) -> Column:
    """The JSON as a struct; what is malformed or absent gives NULLs."""
    return F.from_json(metadata, METADATA)


def is_empty(metadata: Column) -> Column:
    """Whether there is nothing in the JSON: NULL, blank, malformed, or an empty object."""
    value = F.try_parse_json(metadata)
    return F.coalesce(F.size(F.map_keys(F.from_json(metadata, "map<string,string>"))) <= 0, F.lit(True)) | value.isNull()


def exif_time(text: Column) -> Column:
    return F.try_to_timestamp(text, F.lit(EXIF_TIME))


def days_ago(time: Column, now: Column) -> Column:
    """Whole days from ``time`` to ``now``, rounded down."""
    return F.floor((F.unix_timestamp(now) - F.unix_timestamp(time.cast("timestamp"))) / 86400)


def degrees(d: Column, m: Column, s: Column, ref: Column) -> Column:
    """Degrees, minutes and seconds as a decimal, negative in the south and west; 0 where a part is missing."""
    value = d.try_cast("double") + m.try_cast("double") / 60 + s.try_cast("double") / 3600
    return F.coalesce(F.when(ref.isin("S", "W"), -value).otherwise(value), F.lit(0.0))


def device_name(make: Column, model: Column) -> Column:
    """Make and model, or what there is of them; NULL for neither."""
    full = lambda c: F.when(c != "", c)
    name = F.concat_ws(" ", full(make), full(model))
    return F.when(name != "", name)


def aperture_text(f: Column) -> Column:
    return F.concat(F.lit("f/"), F.format_string("%.1f", f.cast("double")))


def shutter_text(seconds: Column) -> Column:
    """1/N for times under a second, N rounded down; else the seconds."""
    return F.when((seconds < 1) & (seconds > 0), F.concat(F.lit("1/"), (1 / seconds).cast("int").cast("string"))).otherwise(F.concat(seconds.cast("string"), F.lit("s")))


def focal_text(mm: Column) -> Column:
    return F.concat(F.format_string("%.1f", mm.cast("double")), F.lit("mm"))


def flash_text(bits: Column) -> Column:
    return F.when(bits.bitwiseAND(1) == 1, "Yes").otherwise("No")


def location_text(lat: Column, lon: Column) -> Column:
    return F.concat_ws(", ", F.format_string("%.6f", lat), F.format_string("%.6f", lon))


def altitude_text(metres: Column) -> Column:
    return F.concat(F.format_string("%.1f", metres), F.lit("m"))


def place_text(admin2: Column, name: Column, admin1: Column, country: Column) -> Column:
    """District, place, state and country, without the place if it is the district's name."""
    some = lambda c: F.when(c != "", c)
    #: Countries written out.
    countries = {
        "IN": "India", "US": "United States", "GB": "United Kingdom", "CN": "China", "JP": "Japan",
        "DE": "Germany", "FR": "France", "CA": "Canada", "AU": "Australia", "BR": "Brazil",
    }
    named = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in countries.items() for x in pair]), country), country)
    parts = F.array_compact(F.array(some(admin2), F.when(~name.eqNullSafe(admin2), some(name)), some(admin1), some(named)))
    return F.when(F.size(parts) > 0, F.array_join(parts, ", "))


class Query:
    """A query to match: a literal, or a column of queries."""

    def __init__(self, query: str | Column):
        self.text = query.lower() if isinstance(query, str) else None
        self.column = F.lower(query) if isinstance(query, Column) else F.lit(self.text)
        self.tokens = self.text.split() if self.text is not None else tokens(self.column)

    def has(self, *words: str) -> bool | Column:
        """Whether any of the words is a part of the query."""
        if self.text is not None:
            return any(w in self.text for w in words)
        out = F.lit(False)
        for w in words:
            out = out | self.column.contains(w)
        return out

    def contains(self, value: Column) -> Column:
        return self.column.contains(value)

    def is_token(self, value: Column) -> Column:
        if self.text is not None:
            return value.isin(self.tokens) if self.tokens else F.lit(False)
        return F.array_contains(self.tokens, value)

    def token_array(self) -> Column:
        return F.array(*[F.lit(t) for t in self.tokens]).cast("array<string>") if self.text is not None else self.tokens


@dataclass(frozen=True)
class Rule:
    name: str
    asked: bool | Column
    holds: Column
    points: Column | float
    reason: Column | None


def _truthy(c: Column) -> Column:
    return F.coalesce(c != 0, F.lit(False))


def _first(words: list[str], hit: Callable[[str], Column]) -> Column:
    """The first word for which ``hit`` holds, or NULL."""
    return F.coalesce(*[F.when(hit(w), F.lit(w)) for w in words]) if words else F.lit(None).cast("string")


def rules(query: str | Column, m: Column, now: Column) -> list[Rule]:
    """All rules for a query and the struct ``m`` of a photo; ``now`` is the time from which days are counted."""
    q = Query(query)
    yes, text = F.lit(True), lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    f = lambda name: m[name]
    low = lambda name: F.lower(F.coalesce(f(name), F.lit("")))
    any_of = lambda c, *words: F.coalesce(c.rlike("|".join(words)), F.lit(False))
    out: list[Rule] = []
    add = lambda name, asked, holds, points, reason: out.append(Rule(name, asked, holds, points, reason))

    place = low("location_name")
    here = lambda w: (F.lit(q.has(w)) if isinstance(q.has(w), bool) else q.has(w)) & place.contains(w)
    asked_places = [w for w in PLACES if q.has(w)] if q.text is not None else PLACES
    add("L1", bool(asked_places), _first(asked_places, here).isNotNull(), 1.5, text("Location: ", f("location_name")))
    inside = F.filter(q.token_array(), lambda t: (F.length(t) > 3) & place.contains(t))
    add("L2", yes, (place != "") & (F.size(inside) > 0), 1.0, text("Location contains: ", F.get(inside, F.lit(0))))
    add("L3", q.has("gps", "location", "coordinates", "map", "place"), _truthy(f("gps_latitude")) & _truthy(f("gps_longitude")), 0.5, F.lit("Has GPS data"))

    at = exif_time(f("date_taken"))
    year, month, day, hour = F.year(at), F.month(at), F.dayofmonth(at), F.hour(at)
    add("D1", yes, q.contains(year.cast("string")), 1.5, text("Year: ", year.cast("string")))
    named = F.create_map(*[F.lit(x) for pair in MONTHS.items() for x in pair])
    of_month = F.filter(q.token_array(), lambda t: F.element_at(named, t) == month)
    add("D2", yes, F.size(of_month) > 0, 1.5, text("Month: ", F.initcap(F.get(of_month, F.lit(0)))))
    add("D3", yes, q.is_token(day.cast("string")), 0.5, text("Day: ", day.cast("string")))
    parts = [("morning", (hour >= 5) & (hour < 12)), ("afternoon", (hour >= 12) & (hour < 17)), ("evening", (hour >= 17) & (hour < 21)), ("night", (hour >= 21) | (hour < 5))]
    part = _first([w for w, _ in parts], lambda w: (F.lit(q.has(w)) if isinstance(q.has(w), bool) else q.has(w)) & dict(parts)[w])
    add("D4", q.has(*[w for w, _ in parts]), part.isNotNull(), 1.0, text(F.initcap(part), " photo"))
    ago = days_ago(at, now)
    add("D5", q.has("recent", "latest"), ago < 30, F.when(ago < 7, 1.5).otherwise(1.0), text("Recent (", ago.cast("string"), " days ago)"))
    add("D6", q.has("old", "older"), ago > 365, 1.0, text("Old photo (", ago.cast("string"), " days ago)"))

    device = low("device")
    asked_brands = [w for w in BRANDS if q.has(w)] if q.text is not None else BRANDS
    branded = _first(asked_brands, lambda w: (F.lit(q.has(w)) if isinstance(q.has(w), bool) else q.has(w)) & device.contains(w))
    add("V1", bool(asked_brands), branded.isNotNull(), 1.5, text("Device: ", f("device")))
    add("V2", q.has("phone", "mobile", "smartphone"), any_of(device, "oneplus", "samsung", "iphone", "pixel"), 0.8, F.lit("Phone photo"))
    add("V3", q.has("camera", "dslr", "professional"), any_of(device, "canon", "nikon", "sony"), 0.8, F.lit("Camera photo"))

    iso, opening, flash = f("iso"), F.replace(f("aperture"), F.lit("f/"), F.lit("")).try_cast("double"), low("flash")
    add("C1", q.has("low light", "night", "dark"), _truthy(iso) & (iso >= 800), 1.0, text("High ISO (", iso.cast("string"), ") - Low light"))
    add("C2", q.has("bright", "sunny", "daylight"), _truthy(iso) & (iso <= 200), 0.8, text("Low ISO (", iso.cast("string"), ") - Bright conditions"))
    add("C3", q.has("portrait", "bokeh", "blur"), opening <= 2.8, 1.0, text("Wide aperture (", f("aperture"), ") - Portrait/Bokeh"))
    add("C4", q.has("landscape", "sharp"), opening >= 8.0, 0.8, text("Narrow aperture (", f("aperture"), ") - Landscape"))
    add("C5", q.has("flash"), any_of(flash, "yes", "fired"), 1.0, F.lit("Flash used"))
    add("C6", q.has("no flash", "natural light"), any_of(flash, "no"), 0.8, F.lit("No flash"))

    height = f("altitude")
    metres = F.format_string("%.0f", height)
    hills = q.has("mountain", "hill", "peak", "summit", "trek", "hiking")
    add("A1", hills, _truthy(height) & (height > 500), F.when(height > 1000, 1.5).otherwise(1.0),
        F.when(height > 1000, text("High altitude (", metres, "m) - Mountain")).otherwise(text("Elevated (", metres, "m) - Hill")))
    add("A2", q.has("beach", "sea", "ocean", "coast", "shore"), _truthy(height) & (height < 50), 1.0, text("Sea level (", metres, "m) - Beach/Coast"))

    w, h = f("width"), f("height")
    sized = _truthy(w) & _truthy(h)
    mega = w.cast("double") * h / 1_000_000
    add("P1", q.has("high resolution", "hd", "quality", "large"), sized & (mega > 8), 0.8, text("High resolution (", F.format_string("%.1f", mega), "MP)"))
    add("P2", q.has("low resolution", "small", "thumbnail"), sized & (mega < 1), 0.5, text("Low resolution (", F.format_string("%.1f", mega), "MP)"))
    add("P3", q.has("vertical", "portrait"), sized & (h > w), 0.5, F.lit("Vertical orientation"))
    add("P4", q.has("horizontal", "landscape"), sized & (w > h), 0.5, F.lit("Horizontal orientation"))
    add("P5", q.has("square"), sized & (F.abs(w - h) < F.least(w, h) * 0.1), 0.5, F.lit("Square format"))

    faces, kind, people = F.coalesce(f("has_faces"), F.lit(False)), f("face_category"), F.coalesce(f("face_count"), F.lit(0)).cast("string")
    add("F1", q.has("face", "faces", "people", "person", "someone"), yes, F.when(faces, 1.5).otherwise(-0.3), F.when(faces, text("Has ", people, " person(s) detected")))
    add("F2", q.has("selfie", "portrait"), kind.isin("portrait", "duo"), F.when(kind == "portrait", 1.5).otherwise(0.5), F.when(kind == "portrait", "Single person (portrait/selfie)"))
    add("F3", q.has("group", "crowd", "team", "family"), kind.isin("group", "duo"), F.when(kind == "group", 1.5).otherwise(0.8),
        F.when(kind == "group", text("Group photo (", people, " people)")).otherwise("Duo photo (2 people)"))
    add("F4", q.has("no people", "empty", "nobody", "no person"), ~faces, 1.0, F.lit("No people detected"))

    scene, around = f("scene_type"), F.coalesce(f("scene_environment"), F.lit("unknown"))
    seen = F.coalesce(scene != "unknown", F.lit(False)) & (scene != "")
    add("S1", q.has("outdoor", "outside", "open air"), seen & (scene == "outdoor"), 1.5, text("Outdoor scene (", around, ")"))
    add("S2", q.has("indoor", "inside", "room", "interior"), seen & (scene == "indoor"), 1.5, F.lit("Indoor scene"))
    add("S3", q.has("nature", "natural", "green", "vegetation", "forest", "park", "garden"), seen & (around == "natural"), 1.5, F.lit("Natural environment"))
    add("S4", q.has("urban", "city", "street", "building", "architecture"), seen & (around == "urban"), 1.5, F.lit("Urban environment"))
    add("S5", q.has("sky", "clouds", "sunset", "sunrise"), seen & ((around == "sky") | (scene == "outdoor")), 1.0, F.lit("Sky visible"))

    hues = f("dominant_colors")
    tinted = F.coalesce(F.size(hues) > 0, F.lit(False))
    add("K1", q.has("warm"), tinted & (f("color_tone") == "warm"), 1.5, F.lit("Warm color tones"))
    add("K2", q.has("cool"), tinted & (f("color_tone") == "cool"), 1.5, F.lit("Cool color tones"))
    add("K3", q.has("vibrant", "colorful", "saturated", "vivid", "bright color"), tinted & (f("color_vibrance") == "vibrant"), 1.5, F.lit("Vibrant colors"))
    add("K4", q.has("muted", "subtle", "desaturated", "faded", "pastel"), tinted & (f("color_vibrance") == "muted"), 1.5, F.lit("Muted colors"))
    asked_colors = [c for c in COLORS if q.has(c)] if q.text is not None else COLORS
    hue = _first(asked_colors, lambda c: (F.lit(q.has(c)) if isinstance(q.has(c), bool) else q.has(c)) & F.array_contains(hues, c))
    add("K5", bool(asked_colors), tinted & hue.isNotNull(), 1.2, text("Dominant color: ", hue))

    blurry, sharpness, light, rating = F.coalesce(f("is_blurry"), F.lit(False)), F.coalesce(f("blur_score"), F.lit(0.0)), f("exposure"), f("quality_rating")
    add("Q1", q.has("blurry", "blur", "out of focus", "unfocused"), blurry, 1.5, text("Blurry photo (score: ", f("blur_score").cast("string"), ")"))
    add("Q2", q.has("sharp", "clear", "focused", "crisp", "in focus"), ~blurry & (sharpness > 200), 1.5, text("Sharp photo (score: ", f("blur_score").cast("string"), ")"))
    add("Q3", q.has("high quality", "best quality", "excellent", "best photos", "good quality"), rating.isin("excellent", "good"), 1.5, text("Quality: ", rating))
    add("Q4", q.has("low quality", "bad quality", "poor"), rating == "poor", 1.0, F.lit("Low quality photo"))
    add("Q5", q.has("well exposed", "good exposure", "proper exposure"), light == "well_exposed", 1.0, F.lit("Well exposed"))
    add("Q6", q.has("overexposed", "too bright", "blown out"), light == "overexposed", 1.0, F.lit("Overexposed"))
    add("Q7", q.has("underexposed", "too dark"), light.isin("underexposed", "dark"), 1.0, F.lit("Underexposed/dark"))
    return [r for r in out if r.asked is not False]


def score_and_reasons(query: str | Column, m: Column, now: Column | dt.datetime, empty: Column | None = None) -> tuple[Column, Column]:
    """The sum of the points of all rules that hold, and their reasons; 0 and none where ``empty`` holds."""
    live = rules(query, m, F.lit(now) if isinstance(now, dt.datetime) else now)
    score, reasons = F.lit(0.0), []
    for rule in live:
        asked = F.lit(True) if rule.asked is True else rule.asked
        holds = F.coalesce(asked & rule.holds, F.lit(False))
        points = rule.points if isinstance(rule.points, Column) else F.lit(float(rule.points))
        score = score + F.when(holds, points.cast("double")).otherwise(0.0)
        if rule.reason is not None:
            reasons.append(F.when(holds, rule.reason))
    why = F.array_compact(F.array(*reasons)) if reasons else F.array().cast("array<string>")
    if empty is None:
        return score, why
    return F.when(empty, 0.0).otherwise(score), F.when(empty, F.array().cast("array<string>")).otherwise(why)
