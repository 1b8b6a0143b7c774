"""What a picture looks like: pixel measures by pandas UDF, and the decisions on them as columns."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ranges of hue (0-179), saturation and value (0-255) of each colour; red has two.
COLOR_RANGES = {
    "red": [((0, 70, 50), (10, 255, 255)), ((170, 70, 50), (179, 255, 255))],
    "orange": [((11, 70, 50), (25, 255, 255))],
    "yellow": [((26, 70, 50), (34, 255, 255))],
    "green": [((35, 70, 50), (85, 255, 255))],
    "blue": [((86, 70, 50), (130, 255, 255))],
    "purple": [((131, 70, 50), (160, 255, 255))],
    "pink": [((161, 50, 50), (169, 255, 255))],
    "white": [((0, 0, 200), (179, 30, 255))],
    "black": [((0, 0, 0), (179, 255, 50))],
    "gray": [((0, 0, 51), (179, 30, 199))],
    "brown": [((10, 50, 30), (30, 200, 150))],
}
#: Ranges of sky and vegetation, and which colours are warm and cool.
SKY, GREEN = ((90, 30, 150), (130, 255, 255)), ((35, 40, 40), (85, 255, 255))
WARM, COOL = ["red", "orange", "yellow", "brown"], ["blue", "green", "purple"]


def face_category(count: Column) -> Column:
    return F.when(count <= 0, "no_faces").when(count == 1, "portrait").when(count == 2, "duo").otherwise("group")


def scene(sky: Column, green: Column, edge: Column, brightness: Column) -> dict[str, Column]:
    """scene_type and scene_environment by the shares of sky, green and edges, and the mean brightness."""
    outdoor = (sky > 0.10) | (green > 0.15) | ((brightness > 160) & ((sky > 0.05) | (green > 0.08)))
    around = F.when((green > 0.15) & (edge < 0.12), "natural").when(edge > 0.15, "urban").when((sky > 0.20) & (green < 0.05), "sky").otherwise("mixed")
    return {"scene_type": F.when(outdoor, "outdoor").otherwise("indoor"), "scene_environment": F.when(outdoor, around).otherwise("indoor")}


def colors(shares: Column, saturation: Column) -> dict[str, Column]:
    """dominant_colors, color_tone and color_vibrance of a map from colour to share."""
    entries = F.filter(F.map_entries(shares), lambda e: e["value"] > 0.05)
    # equal shares stand in the order of the table
    place = lambda name: F.array_position(F.array(*[F.lit(n) for n in COLOR_RANGES]), name)
    order = F.array_sort(F.transform(entries, lambda e: F.struct((-e["value"]).alias("v"), place(e["key"]).alias("p"), e["key"].alias("k"))))
    best = F.transform(F.slice(order, 1, 3), lambda e: e["k"])
    part = lambda names: sum((F.coalesce(F.element_at(shares, n), F.lit(0.0)) for n in names), F.lit(0.0))
    warm, cool = part(WARM), part(COOL)
    return {
        "dominant_colors": F.when(F.size(best) > 0, best).otherwise(F.array(F.lit("mixed"))),
        "color_tone": F.when(warm > cool * 1.5, "warm").when(cool > warm * 1.5, "cool").otherwise("neutral"),
        "color_vibrance": F.when(saturation > 120, "vibrant").when(saturation > 60, "moderate").otherwise("muted"),
    }


def quality(blur: Column, dark: Column, bright: Column, mean: Column) -> dict[str, Column]:
    """blur_score, is_blurry, exposure and quality_rating by the sharpness, the shares of dark and bright pixels, and the mean."""
    blurry = blur < 100
    light = F.when(dark > 0.40, "underexposed").when(bright > 0.40, "overexposed").when(mean < 60, "dark").when(mean > 200, "bright").otherwise("well_exposed")
    points = F.when(~blurry, 2).otherwise(0) + F.when(blur > 300, 1).otherwise(0) + F.when(light == "well_exposed", 2).when(light.isin("dark", "bright"), 1).otherwise(0)
    rating = F.when(points >= 4, "excellent").when(points >= 3, "good").when(points >= 2, "fair").otherwise("poor")
    return {"blur_score": F.round(blur, 1), "is_blurry": blurry, "exposure": light, "quality_rating": rating}


#: By span and highest value the saturation, and by which channel is highest, the difference of the others and the span the
#: hue: bytes have no others.
_SATURATION = np.rint(np.where(np.arange(256) > 0, np.arange(256)[:, None] / np.maximum(np.arange(256), 1), 0) * 255).astype("uint8")
_PARTS = np.arange(-255, 256)[:, None] / np.maximum(np.arange(256), 1)
_HUE = np.where(np.arange(256) > 0, np.rint(np.stack([_PARTS % 6, _PARTS + 2, _PARTS + 4]) * 30) % 180, 0).astype("uint8")


def _planes(rgb: np.ndarray) -> np.ndarray:
    """Hue in 0-179, saturation and value in 0-255 of an (h, w, 3) picture of bytes, each as bytes on its own."""
    r, g, b = (np.ascontiguousarray(rgb[..., i]).astype("int16") for i in range(3))
    high = np.maximum(np.maximum(r, g), b)
    span = high - np.minimum(np.minimum(r, g), b)
    red, green = high == r, high == g
    place = np.where(red, g - b + 255, np.where(green, b - r + (255 + 511), r - g + (255 + 1022))).astype("int64") * 256 + span
    return np.stack([_HUE.ravel().take(place), _SATURATION.ravel().take(span.astype("int64") * 256 + high), high.astype("uint8")])


def hsv_of(rgb: np.ndarray) -> np.ndarray:
    """Hue in 0-179, saturation and value in 0-255 of an (h, w, 3) picture of bytes."""
    return np.moveaxis(_planes(rgb), 0, 2).astype("float64")


def _share(planes: np.ndarray, low: tuple, high: tuple) -> float:
    """The share of pixels within a range; ``planes``: hue, saturation and value, each as bytes on its own."""
    if not planes.size:
        return 0.0
    within = None
    for plane, lo, hi, most in zip(planes, low, high, (179, 255, 255)):
        for part in ([plane >= lo] if lo > 0 else []) + ([plane <= hi] if hi < most else []):
            within = part if within is None else within & part
    return 1.0 if within is None else np.count_nonzero(within) / within.size


def resized(picture: np.ndarray, width: int, height: int) -> np.ndarray:
    """A picture of bytes, linearly interpolated to another size; the corners of the pictures, not of their pixels, meet."""
    out = picture.astype("float64")
    for axis, size in ((0, height), (1, width)):
        old = out.shape[axis]
        at = np.clip((np.arange(size) + 0.5) * old / size - 0.5, 0, old - 1)
        low = np.floor(at).astype(int)
        part = (at - low)[:, None]
        rest = out.shape[:axis] + out.shape[axis + 1 :]
        lines = np.ascontiguousarray(np.moveaxis(out, axis, 0)).reshape(old, -1)  # whole lines are taken at once
        after, mix = lines[np.minimum(low + 1, old - 1)], lines[low]
        after *= part
        mix *= 1 - part
        mix += after
        out = np.moveaxis(mix.reshape(size, *rest), 0, axis)
    return np.ascontiguousarray(np.rint(out).astype("uint8"))


def scaled_to(picture: np.ndarray, longest: int) -> np.ndarray:
    """A picture whose longer side is brought to ``longest``, up or down; sides are cut down to whole pixels."""
    h, w = picture.shape[:2]
    scale = longest / max(h, w)
    return resized(picture, max(1, int(w * scale)), max(1, int(h * scale)))


def gray_of(rgb: np.ndarray) -> np.ndarray:
    return np.rint(rgb.astype("float64") @ [0.299, 0.587, 0.114]).astype("uint8")


def edges(gray: np.ndarray, low: float = 50, high: float = 150) -> np.ndarray:
    """Where the edges of a gray picture are: ridges of the gradient over ``low`` that hang together with one over ``high``."""
    p = np.pad(gray.astype("int16"), 1, mode="edge")
    down = p[2:] - p[:-2]
    right = p[:, 2:] - p[:, :-2]
    dy = down[:, :-2] + 2 * down[:, 1:-1] + down[:, 2:]
    dx = right[:-2] + 2 * right[1:-1] + right[2:]
    strength = np.abs(dx) + np.abs(dy)
    m, wide = np.pad(strength, 1).ravel(), strength.shape[1] + 2
    over = np.flatnonzero(strength.ravel() > low)
    at = over + 2 * (over // max(1, strength.shape[1])) + wide + 1  # the same places in ``m``
    x, y, own = dx.ravel()[over], dy.ravel()[over], strength.ravel()[over]
    flat, steep = np.abs(y) < np.abs(x) * np.tan(np.pi / 8), np.abs(y) > np.abs(x) * np.tan(3 * np.pi / 8)
    step = np.where(flat, 1, np.where(steep, wide, np.where((x >= 0) == (y >= 0), wide + 1, wide - 1)))
    before, after = m[at - step], m[at + step]
    ridge = (own > before) & np.where(~flat & ~steep, own > after, own >= after)
    # from the strong ones on, along the others: a rim of nothing keeps steps inside
    open_, found = np.zeros(len(m), bool), np.zeros(len(m), bool)
    open_[at[ridge]] = True
    found[at[ridge & (own > high)]] = True
    steps = np.array([-wide - 1, -wide, -wide + 1, -1, 1, wide - 1, wide, wide + 1])
    front = np.flatnonzero(found)
    while len(front):
        near = (front[:, None] + steps).ravel()
        front = near[open_[near] & ~found[near]]
        found[front] = True
        front = np.unique(front)
    return found.reshape(-1, wide)[1:-1, 1:-1]


def measures(rgb: np.ndarray) -> dict:
    """The pixel measures of one picture that the decisions above take, each at the scale it is meant for."""
    scene_, color, gray = scaled_to(rgb, 256), scaled_to(rgb, 128), scaled_to(gray_of(rgb), 512)
    hsv, tint = (_planes(x) for x in (scene_, color))
    p = np.pad(gray.astype("int16"), 1, mode="reflect" if min(gray.shape) > 1 else "edge")
    laplace = p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * p[1:-1, 1:-1]
    light = np.bincount(gray.ravel(), minlength=256)
    return {
        "sky": _share(hsv[:, : hsv.shape[1] // 3], *SKY), "green": _share(hsv, *GREEN), "edge": float(edges(gray_of(scene_)).mean()),
        "brightness": float(hsv[2].mean()), "saturation": float(tint[1].mean()), "blur": float(laplace.astype("float64").var()),
        "dark": float(light[:20].sum() / gray.size), "bright": float(light[235:].sum() / gray.size), "mean": float(light @ np.arange(256) / gray.size),
        "shares": {name: sum(_share(tint, *r) for r in ranges) for name, ranges in COLOR_RANGES.items()},
    }


MEASURES = "sky double, green double, edge double, brightness double, saturation double, blur double, dark double, bright double, mean double, shares map<string,double>"


def pixel_measures(pixels: Column, width: Column, height: Column) -> Column:
    """``measures`` of pictures given as bytes of RGB rows; NULL where the bytes don't fit the size."""

    @F.pandas_udf(MEASURES)
    def of(raw: pd.Series, w: pd.Series, h: pd.Series) -> pd.DataFrame:
        out = []
        for data, x, y in zip(raw, w, h):
            fits = data is not None and x and y and len(data) == int(x) * int(y) * 3
            out.append(measures(np.frombuffer(data, "uint8").reshape(int(y), int(x), 3)) if fits else dict.fromkeys(c.split()[0] for c in MEASURES.split(", ")))
        return pd.DataFrame(out)

    return of(pixels, width, height)


def stretched(gray: np.ndarray) -> np.ndarray:
    """A gray picture stretched to 0-255, cut down to whole numbers."""
    low, high = float(gray.min()), float(gray.max())
    return gray.astype("uint8") if high <= low else ((gray - low) * 255.0 / (high - low)).astype("uint8")


def fitted(width: int, height: int, most: int) -> tuple[int, int]:
    """The size of a picture whose longer side is brought down to ``most``."""
    longest = max(width, height)
    return (width, height) if longest <= most else (max(1, int(width * most / longest)), max(1, int(height * most / longest)))


def gray_for_text(pixels: Column, width: Column, height: Column, most: int = 640) -> Column:
    """Pictures as they are given to be read: gray, stretched to 0-255, the longer side at most ``most``: (width, height, gray).

    Pictures come as bytes of RGB rows; NULL where the bytes don't fit the size.
    """

    @F.pandas_udf("width int, height int, gray binary")
    def of(raw: pd.Series, w: pd.Series, h: pd.Series) -> pd.DataFrame:
        out = []
        for data, x, y in zip(raw, w, h):
            if data is None or not x > 0 or not y > 0 or len(data) != int(x) * int(y) * 3:
                out.append((None, None, None))
                continue
            x, y = fitted(int(x), int(y), most)
            gray = gray_of(np.frombuffer(data, "uint8").reshape(int(h.iloc[len(out)]), int(w.iloc[len(out)]), 3))
            out.append((x, y, stretched(gray if gray.shape == (y, x) else resized(gray, x, y)).tobytes()))
        done = pd.DataFrame(out, columns=["width", "height", "gray"], dtype=object)
        return done.astype({"width": "Int32", "height": "Int32"})

    return of(pixels, width, height)


def kept_lines(lines: Column, least: float = 0.5) -> Column:
    """The text of recognised lines (text, confidence) that are sure enough and not blank."""
    good = F.filter(lines, lambda x: (x["confidence"] >= least) & (F.trim(x["text"]) != ""))
    return F.array_join(F.transform(good, lambda x: F.trim(x["text"])), " ")
