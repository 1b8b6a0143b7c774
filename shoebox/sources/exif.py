"""What files of pictures say of themselves: size, format and camera data, read from their bytes without a decoder.

Blocks of tagged values stand in JPEG (APP1), PNG (eXIf), WebP (EXIF) and, as the file itself, in TIFF. What can't be read
is NULL; a damaged block gives what was read before the damage.
"""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from shoebox.functions import metadata as meta

#: Numbers of tags in the main, the camera's and the position's directory, and sizes of the types of values.
MAIN = {256: "width", 257: "height", 271: "device_make", 272: "device_model", 274: "orientation", 305: "software", 306: "date_modified"}
CAMERA, POSITION = 34665, 34853
TAKEN = {33434: "exposure", 33437: "f_number", 34855: "iso", 36867: "date_taken", 37385: "flash", 37386: "focal"}
WHERE = {1: "lat_ref", 2: "lat", 3: "lon_ref", 4: "lon", 6: "altitude", 7: "gps_time", 29: "gps_date"}
WIDTHS = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}
PNG_MODES = {0: "L", 2: "RGB", 3: "P", 4: "LA", 6: "RGBA"}


def _values(block: bytes, at: int, order: str) -> tuple[int, object] | None:
    """(tag, value) of the entry of a directory at a place; None where its value lies outside the block."""
    tag, kind, n = struct.unpack_from(order + "HHI", block, at)
    width = WIDTHS.get(kind)
    if width is None:
        return None
    start = at + 8 if width * n <= 4 else struct.unpack_from(order + "I", block, at + 8)[0]
    if start + width * n > len(block):
        return None
    if kind == 2:
        return tag, block[start : start + n].split(b"\0")[0].decode("utf-8", "replace")
    if kind in (5, 10):
        pairs = struct.unpack_from(f"{order}{2 * n}{'I' if kind == 5 else 'i'}", block, start)
        value = [a / b if b else None for a, b in zip(pairs[::2], pairs[1::2])]
    else:
        value = list(struct.unpack_from(f"{order}{n}{ {1: 'B', 3: 'H', 4: 'I', 7: 'B', 9: 'i'}[kind]}", block, start))
    return tag, value[0] if n == 1 else value


def _directory(block: bytes, at: int, order: str) -> dict[int, object]:
    out: dict[int, object] = {}
    if at + 2 > len(block):
        return out
    for k in range(struct.unpack_from(order + "H", block, at)[0]):
        if at + 14 + 12 * k > len(block):
            break
        if found := _values(block, at + 2 + 12 * k, order):
            out.setdefault(*found)
    return out


def tagged(block: bytes) -> dict[str, object]:
    """The values of a block of tags by name."""
    order = {b"II": "<", b"MM": ">"}.get(block[:2])
    if order is None or len(block) < 8 or struct.unpack_from(order + "H", block, 2)[0] != 42:
        return {}
    first = _directory(block, struct.unpack_from(order + "I", block, 4)[0], order)
    out = {name: first[tag] for tag, name in MAIN.items() if tag in first}
    for pointer, names in ((CAMERA, TAKEN), (POSITION, WHERE)):
        if isinstance(first.get(pointer), int):
            own = _directory(block, first[pointer], order)
            out |= {name: own[tag] for tag, name in names.items() if tag in own}
    return out


def _jpeg(data: bytes) -> dict[str, object]:
    out: dict[str, object] = {"format": "JPEG"}
    at = 2
    while at + 4 <= len(data) and data[at] == 0xFF:
        mark = data[at + 1]
        if mark == 0xFF:  # fill
            at += 1
            continue
        if mark in (0xD9, 0xDA):
            break
        size = struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + size]
        if mark == 0xE1 and body[:6] == b"Exif\0\0":
            out = {k: v for k, v in tagged(body[6:]).items() if k not in ("width", "height")} | out
        elif 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC) and len(body) >= 6:
            out["height"], out["width"] = struct.unpack_from(">HH", body, 1)
            out["mode"] = {1: "L", 3: "RGB", 4: "CMYK"}.get(body[5])
        at += 2 + size
    return out


def _png(data: bytes) -> dict[str, object]:
    out: dict[str, object] = {"format": "PNG"}
    at = 8
    while at + 12 <= len(data):
        size, name = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + size]
        if name == b"IHDR" and len(body) >= 10:
            out["width"], out["height"] = struct.unpack_from(">II", body)
            out["mode"] = PNG_MODES.get(body[9])
        elif name == b"eXIf":
            out = {k: v for k, v in tagged(body).items() if k not in ("width", "height")} | out
        elif name == b"IEND":
            break
        at += 12 + size
    return out


def _webp(data: bytes) -> dict[str, object]:
    out: dict[str, object] = {"format": "WEBP", "mode": "RGB"}
    at = 12
    while at + 8 <= len(data):
        name, size = struct.unpack_from("<4sI", data, at)
        body = data[at + 8 : at + 8 + size]
        if name == b"VP8X" and len(body) >= 10:
            out["width"], out["height"] = (1 + int.from_bytes(body[k : k + 3], "little") for k in (4, 7))
        elif name == b"VP8 " and len(body) >= 10:
            w, h = struct.unpack_from("<HH", body, 6)
            out = {"width": w & 0x3FFF, "height": h & 0x3FFF} | out
        elif name == b"VP8L" and len(body) >= 5:
            bits = int.from_bytes(body[1:5], "little")
            out = {"width": 1 + (bits & 0x3FFF), "height": 1 + (bits >> 14 & 0x3FFF)} | out
        elif name == b"EXIF":
            out = {k: v for k, v in tagged(body.removeprefix(b"Exif\0\0")).items() if k not in ("width", "height")} | out
        at += 8 + size + size % 2
    return out


def read(data: bytes | None) -> dict[str, object]:
    """What the bytes of a file say, by name; nothing for files of no known format."""
    try:
        if not data:
            return {}
        if data[:2] == b"\xff\xd8":
            return _jpeg(data)
        if data[:8] == b"\x89PNG\r\n\x1a\n":
            return _png(data)
        if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
            return _webp(data)
        if data[:6] in (b"GIF87a", b"GIF89a"):
            w, h = struct.unpack_from("<HH", data, 6)
            return {"format": "GIF", "mode": "P", "width": w, "height": h}
        if data[:2] == b"BM":
            w, h = struct.unpack_from("<ii", data, 18)
            return {"format": "BMP", "mode": "RGB", "width": w, "height": abs(h)}
        return {"format": "TIFF"} | found if (found := tagged(data)) else {}
    except struct.error:
        return {}


RAW = (
    "width int, height int, format string, mode string, device_make string, device_model string, software string, date_taken string, date_modified string, iso int, orientation int, "
    "f_number double, exposure double, focal double, flash int, lat array<double>, lat_ref string, lon array<double>, lon_ref string, altitude double, gps_date string, gps_time array<double>"
)
_KINDS = dict(part.split(" ") for part in RAW.split(", "))


def _as(value: object, kind: str) -> object:
    """A value in the kind of its column; of several numbers where one is meant the first; NULL where it is none."""
    if kind == "string":
        return value.strip() if isinstance(value, str) else None
    if kind == "array<double>":
        return [float("nan") if x is None else float(x) for x in value] if isinstance(value, list) else None
    value = value[0] if isinstance(value, list) and value else value
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        return None
    return int(value) if kind == "int" else float(value)


def raw_metadata(content: Column) -> Column:
    """The values of ``read`` as a struct."""

    @F.pandas_udf(RAW)
    def of(files: pd.Series) -> pd.DataFrame:
        found = [read(None if data is None else bytes(data)) for data in files]
        columns = {name: pd.Series([_as(f.get(name), kind) for f in found], dtype=object) for name, kind in _KINDS.items()}
        for name, kind in _KINDS.items():
            if kind in ("int", "double"):
                columns[name] = columns[name].astype("Int32" if kind == "int" else "Float64")
        return pd.DataFrame(columns)

    return of(content)


def file_metadata(raw: Column) -> Column:
    """``raw_metadata`` as what is stored of a photo: a struct of texts and numbers, NULL for what the file doesn't say."""
    r = lambda name: raw[name]
    part = lambda name, i: F.when(~F.isnan(F.get(r(name), F.lit(i))), F.get(r(name), F.lit(i)))
    whole = lambda name: F.size(r(name)) >= 3
    there = whole("lat") & whole("lon")
    lat = F.when(there, meta.degrees(part("lat", 0), part("lat", 1), part("lat", 2), r("lat_ref")))
    lon = F.when(there, meta.degrees(part("lon", 0), part("lon", 1), part("lon", 2), r("lon_ref")))
    clock = F.concat_ws(":", *[F.get(r("gps_time"), F.lit(i)).cast("string") for i in range(3)])
    known = {
        **{n: r(n) for n in ("width", "height", "format", "mode", "device_make", "device_model", "software", "date_taken", "date_modified", "iso", "orientation")},
        "aperture": F.when(r("f_number").isNotNull(), meta.aperture_text(r("f_number"))),
        "shutter_speed": F.when(r("exposure").isNotNull(), meta.shutter_text(r("exposure"))),
        "focal_length": F.when(r("focal").isNotNull(), meta.focal_text(r("focal"))),
        "flash": F.when(r("flash").isNotNull(), meta.flash_text(r("flash"))),
        "gps_latitude": lat,
        "gps_longitude": lon,
        "location": F.when(there, meta.location_text(lat, lon)),
        "gps_altitude": F.when(r("altitude").isNotNull(), meta.altitude_text(r("altitude"))),
        "altitude": r("altitude"),
        "gps_timestamp": F.when(r("gps_date").isNotNull() & whole("gps_time"), F.concat(r("gps_date"), F.lit(" "), clock)),
        "device": meta.device_name(r("device_make"), r("device_model")),
    }
    return F.struct(*[c.alias(n) for n, c in known.items()])


def tag_block(values: dict[str, object], order: str = "<") -> bytes:
    """A block of tags with the named values, as ``tagged`` reads it: texts, whole numbers, and numbers as fractions."""

    def entry(tag: int, value: object) -> tuple[int, int, int, bytes]:
        if isinstance(value, str):
            data = value.encode() + b"\0"
            return tag, 2, len(data), data
        if isinstance(value, int):
            return tag, 4, 1, struct.pack(order + "I", value)
        numbers = value if isinstance(value, list) else [value]
        data = b"".join(struct.pack(order + "ii", round(x * 100_000), 100_000) for x in numbers)
        return tag, 10, len(numbers), data

    def directory(entries: list[tuple[int, int, int, bytes]], at: int) -> bytes:
        head, tail, end = struct.pack(order + "H", len(entries)), b"", at + 2 + 12 * len(entries) + 4
        for tag, kind, n, data in sorted(entries):
            own = data.ljust(4, b"\0") if len(data) <= 4 else struct.pack(order + "I", end + len(tail))
            tail += b"" if len(data) <= 4 else data + b"\0" * (len(data) % 2)
            head += struct.pack(order + "HHI", tag, kind, n) + own
        return head + b"\0" * 4 + tail

    own = lambda names: [entry(tag, values[name]) for tag, name in names.items() if values.get(name) is not None]
    main, more = own(MAIN), b""
    size = len(directory(main + [entry(CAMERA, 0), entry(POSITION, 0)], 8))
    for pointer, names in ((CAMERA, TAKEN), (POSITION, WHERE)):
        main.append(entry(pointer, 8 + size + len(more)))
        more += directory(own(names), 8 + size + len(more))
    return {"<": b"II", ">": b"MM"}[order] + struct.pack(order + "HI", 42, 8) + directory(main, 8) + more


def jpeg_with(block: bytes, width: int, height: int) -> bytes:
    """The head of a JPEG file of a size, with a block of tags; it has no picture."""
    body = b"Exif\0\0" + block
    frame = struct.pack(">BHHB", 8, height, width, 3) + b"\1\x22\0\2\x11\1\3\x11\1"
    return b"\xff\xd8\xff\xe1" + struct.pack(">H", len(body) + 2) + body + b"\xff\xc0" + struct.pack(">H", len(frame) + 2) + frame + b"\xff\xd9"


__all__ = ["file_metadata", "jpeg_with", "raw_metadata", "read", "tag_block", "tagged"]
