"""Camera metadata of JPEG bytes as columns."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S

#: Bytes after the start of the image in which the metadata is looked for.
EXAMINED = 64 << 10
# Fixed values of the EXIF format: tag numbers and value sizes.
MAKE, MODEL, EXIF_IFD, GPS_IFD, TAKEN, ISO, FNUMBER, APERTURE, FOCAL, LENS, USER_COMMENT = 0x010F, 0x0110, 0x8769, 0x8825, 0x9003, 0x8827, 0x829D, 0x9202, 0x920A, 0xA434, 0x9286
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}
_RAW = "taken_text string, camera_make string, camera_model string, lens_model string, iso long, f_number double, focal_mm double, latitude double, longitude double"


def _ifd(tiff: bytes, at: int, order: str) -> dict[int, object]:
    """The entries of a directory; offsets count from the TIFF header. Entries that leave the data are skipped."""
    out: dict[int, object] = {}
    if at + 2 > len(tiff):
        return out
    for k in range(struct.unpack_from(f"{order}H", tiff, at)[0]):
        entry = at + 2 + 12 * k
        if entry + 12 > len(tiff):
            break
        tag, kind, n = struct.unpack_from(f"{order}HHI", tiff, entry)
        size = _SIZES.get(kind, 0) * n
        start = entry + 8 if size <= 4 else struct.unpack_from(f"{order}I", tiff, entry + 8)[0]
        if not size or start + size > len(tiff):
            continue
        raw = tiff[start : start + size]
        if kind in (2, 7):
            out[tag] = raw
        elif kind in (5, 10):
            pairs = struct.unpack(f"{order}{2 * n}{'I' if kind == 5 else 'i'}", raw)
            out[tag] = [a / b if b else None for a, b in zip(pairs[::2], pairs[1::2], strict=True)]
        else:
            out[tag] = list(struct.unpack(f"{order}{n}{ {1: 'B', 3: 'H', 4: 'I', 9: 'i'}[kind] }".replace(" ", ""), raw))
    return out


def _text(value) -> str | None:
    if not isinstance(value, bytes):
        return None
    try:
        return value.split(b"\0")[0].decode("ascii").strip() or None
    except UnicodeDecodeError:
        return None


def _first(value):
    return value[0] if isinstance(value, list) and value else None


def _degrees(value, ref: str | None) -> float | None:
    if not isinstance(value, list) or len(value) < 3 or any(v is None for v in value[:3]):
        return None
    d = value[0] + value[1] / 60 + value[2] / 3600
    return -d if (ref or "").upper() in ("S", "W") else d


def read_exif(data: bytes | None) -> tuple:
    """The columns of _RAW for a JPEG's bytes; all None where there is no readable metadata."""
    none = (None,) * 9
    if not data or data[:2] != b"\xff\xd8":
        return none
    head = data[: 2 + EXAMINED]
    at = head.find(b"Exif\0\0")
    if at < 0:
        return none
    tiff = head[at + 6 :]
    order = {b"II": "<", b"MM": ">"}.get(tiff[:2])
    if order is None or len(tiff) < 8:
        return none
    top = _ifd(tiff, struct.unpack_from(f"{order}I", tiff, 4)[0], order)
    sub = _ifd(tiff, _first(top.get(EXIF_IFD)), order) if isinstance(_first(top.get(EXIF_IFD)), int) else {}
    gps = _ifd(tiff, _first(top.get(GPS_IFD)), order) if isinstance(_first(top.get(GPS_IFD)), int) else {}
    f_number = _first(sub.get(FNUMBER))
    if f_number is None and _first(sub.get(APERTURE)) is not None:
        f_number = 2 ** (_first(sub.get(APERTURE)) / 2)
    lens = _text(sub.get(LENS)) or _text(sub.get(USER_COMMENT))
    return (_text(sub.get(TAKEN)), _text(top.get(MAKE)), _text(top.get(MODEL)), lens, _first(sub.get(ISO)), f_number, _first(sub.get(FOCAL)), _degrees(gps.get(2), _text(gps.get(1))), _degrees(gps.get(4), _text(gps.get(3))))


def extract_exif(files: DataFrame, content: str = "content") -> DataFrame:
    """files (without content) with taken_at, camera and lens, iso, aperture and focal length texts, and position."""
    keep = [c for c in files.columns if c != content]
    names = [x.split()[0] for x in _RAW.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = pd.DataFrame([read_exif(x) for x in frame[content]], columns=names, index=frame.index)
            found["iso"] = found["iso"].astype("Int64")
            yield pd.concat([frame[keep], found], axis=1)

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema.fields if f.name != content], _RAW])
    out = files.mapInPandas(run, schema)
    return out.withColumns({"taken_at": S.exif_time(F.col("taken_text")), "aperture": F.when(F.col("f_number") > 0, S.aperture_text(F.col("f_number"))), "focal_length": F.when(F.col("focal_mm") > 0, S.focal_text(F.col("focal_mm")))}).drop("taken_text", "f_number", "focal_mm")
