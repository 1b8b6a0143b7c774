"""Words of queries and texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shoebox.config import SearchConfig

#: Words of a query that say nothing about the text in a picture.
STOP_WORDS = [
    "a", "an", "the", "and", "or", "but", "of", "at", "by", "for", "with", "about", "as", "into", "through", "during", "before", "after",
    "above", "below", "to", "from", "up", "down", "in", "out", "on", "off", "over", "under", "again", "further", "then", "once", "here", "there",
    "when", "where", "why", "how", "all", "both", "each", "few", "more", "most", "other", "some", "such", "only", "own", "same", "so",
    "than", "too", "very", "can", "will", "just", "should", "now", "photo", "photos", "picture", "pictures", "image", "images",
    "taken", "shot", "showing", "show", "display",
]

#: Words that ask for what is known of a file. Those of two words never match, as queries are matched word by word.
METADATA_WORDS = [
    "location", "gps", "place", "city", "country", "state", "town", "village", "delhi", "mumbai", "bangalore", "chennai", "kolkata", "hyderabad", "pune",
    "india", "coordinates", "map", "january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december",
    "jan", "feb", "mar", "apr", "jun", "jul", "aug", "sep", "oct", "nov", "dec", "morning", "afternoon", "evening", "night",
    "recent", "latest", "old", "older", "yesterday", "today", "last week", "date", "time", "when", "year", "month", "day",
    "oneplus", "samsung", "iphone", "apple", "pixel", "google", "xiaomi", "canon", "nikon", "sony", "fujifilm", "phone", "mobile", "smartphone",
    "camera", "dslr", "device", "taken with", "shot on", "iso", "aperture", "flash", "exposure", "shutter", "focal",
    "resolution", "dimensions", "width", "height", "size", "megapixel", "vertical", "horizontal", "portrait", "landscape", "square",
    "hd", "quality", "large", "small", "altitude", "elevation", "mountain", "hill", "peak", "summit", "sea level",
    "face", "faces", "selfie", "group", "group photo", "people", "crowd", "team", "family", "duo", "nobody", "no people",
    "indoor", "outdoor", "outside", "inside", "room", "interior", "nature", "natural", "urban",
    "warm", "cool", "vibrant", "colorful", "muted", "saturated", "vivid", "faded", "pastel", "warm tone", "cool tone",
    "sharp", "blurry", "blur", "focused", "crisp", "clear", "high quality", "low quality", "overexposed", "underexposed", "well exposed",
]

#: Words that ask for what is to be seen.
VISUAL_WORDS = [
    "cat", "dog", "person", "people", "man", "woman", "child", "baby", "car", "bike", "vehicle", "building", "house", "tree", "flower",
    "food", "plate", "cup", "drink", "animal", "bird", "fish", "temple", "church", "mosque", "beach", "ocean", "sea", "river", "lake",
    "mountain", "forest", "park", "garden", "street", "road", "bridge", "sunset", "sunrise", "sky", "cloud", "water", "snow", "rain",
    "red", "blue", "green", "yellow", "orange", "purple", "pink", "black", "white", "brown", "gray", "colorful", "bright", "dark",
    "beside", "near", "behind", "front", "inside", "outside", "beautiful", "scenic", "amazing", "stunning", "nature",
]

#: Words that ask for text in a picture.
TEXT_WORDS = [
    "screenshot", "text", "document", "sign", "signboard", "board", "caption", "quote", "message", "chat", "email", "letter",
    "note", "writing", "written", "words", "label", "tag", "menu", "list", "receipt", "ticket", "poster", "banner",
    "error", "notification", "alert", "warning",
]


def _literals(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def cache_key(query: Column) -> Column:
    """The key of a query in the caches: case and blanks around it don't matter."""
    return F.md5(F.lower(F.regexp_replace(query, r"^\s+|\s+$", "")))


def tokens(text: Column) -> Column:
    """Lower-case words between blanks, repeated ones as often as they stand."""
    return F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")


def meaningful_tokens(text: Column, least: int = 3) -> Column:
    """Words that aren't stop words and have ``least`` letters; all words if none is left."""
    words, stop = tokens(text), _literals(STOP_WORDS)
    kept = F.filter(words, lambda w: ~F.array_contains(stop, w) & (F.length(w) >= least))
    return F.when(F.size(kept) > 0, kept).otherwise(words)


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def text_score(query: Column, words: Column, text: Column, config: SearchConfig = SearchConfig()) -> Column:
    """How well the text of a picture matches the words of a query, from 0 to ``config.ocr_cap``.

    Each word of three letters and more counts: most as a word of its own, less within another, least if it and a word
    of the text differ only by up to two letters at an end. Queries of up to two letters and NULL texts score 0.
    """
    body = F.lower(text)
    padded = F.concat(F.lit(" "), body, F.lit(" "))
    least, inside = config.ocr_min_token, F.split(body, r"\s+")

    def one(word: Column) -> Column:
        near = F.exists(inside, lambda w: (F.length(w) >= least) & word.contains(w) & (F.length(word) - F.length(w) <= 2))
        return (
            F.when(F.length(word) < least, 0.0)
            .when(padded.contains(F.concat(F.lit(" "), word, F.lit(" "))), config.ocr_exact)
            .when(body.contains(word), config.ocr_partial)
            .when(near, config.ocr_near)
            .otherwise(0.0)
        )

    total = F.aggregate(words, F.lit(0.0), lambda s, w: s + one(w))
    return F.when((F.length(query) > 2) & text.isNotNull() & (body != ""), F.least(total, F.lit(config.ocr_cap))).otherwise(0.0)


def class_counts(query: Column) -> dict[str, Column]:
    """How many words of a query ask for metadata, for what is seen, and for text."""
    words = tokens(query)
    count = lambda known: F.size(F.filter(words, lambda w: F.array_contains(_literals(known), w)))
    year, size = F.coalesce(query.rlike(r"\b(19|20)\d{2}\b"), F.lit(False)), F.coalesce(query.rlike(r"\d+x\d+"), F.lit(False))
    return {"m": count(METADATA_WORDS) + year.cast("int") + size.cast("int"), "v": count(VISUAL_WORDS), "t": count(TEXT_WORDS)}


def intent_and_weights(m: Column, v: Column, t: Column, presets: dict | None = None) -> dict[str, Column]:
    """intent, visual, ocr, metadata of a query by how many of its words ask for what.

    One kind of words takes its preset, none the fallback, all three the balanced one; two kinds share by their counts,
    and the third has 0.1.
    """
    presets = presets or SearchConfig().presets
    m, v, t = F.coalesce(m, F.lit(0)), F.coalesce(v, F.lit(0)), F.coalesce(t, F.lit(0))
    kinds = (m > 0).cast("int") + (v > 0).cast("int") + (t > 0).cast("int")
    one = F.when(kinds == 0, "fallback").when((kinds == 1) & (m > 0), "metadata_dominant").when((kinds == 1) & (v > 0), "visual_dominant")
    preset = one.when(kinds == 1, "text_dominant").when(kinds == 3, "hybrid_balanced")
    intent = F.when(kinds == 0, "VISUAL").when(kinds > 1, "HYBRID").when(m > 0, "METADATA").when(v > 0, "VISUAL").otherwise("TEXT")
    out = {"intent": intent}
    for part, own in (("visual", v), ("ocr", t), ("metadata", m)):
        shared = F.when(own > 0, F.lit(0.4) + own / (m + v + t) * F.lit(0.3)).otherwise(0.1)
        chosen = F.lit(None).cast("double")
        for name, weights in presets.items():
            chosen = F.when(preset == name, F.lit(float(weights[part]))).otherwise(chosen)
        out[part] = F.when(kinds == 2, shared).otherwise(chosen)
    return out
