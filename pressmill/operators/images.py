"""Image operators on addresses and sizes that come as columns, and sizes read from files' headers."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MIN_AREA, MIN_SIDE = 5000, 90


def area(width: Column, height: Column, url: Column, ratio: float = 16 / 9) -> Column:
    """Width times height; 0 for unknown, small, narrow and thin images, a tenth for sprites and logos."""
    full = (width * height).cast("double")
    known = width.isNotNull() & height.isNotNull() & (full >= MIN_AREA) & (width >= MIN_SIDE)
    thin = F.greatest(width, height) / F.nullif(F.least(width, height), F.lit(0)) > ratio
    small = F.lower(url).rlike("sprite|logo")
    return F.when(~F.coalesce(known, F.lit(False)) | thin, 0.0).when(small, full / 10).otherwise(full)


def is_large_enough(area_: Column) -> Column:
    return area_ > MIN_AREA


def largest_image(images: DataFrame, key: str = "page_id", top: str | None = None) -> DataFrame:
    """key and url of each page's largest image (the first by address among equals; null if all have no area), or the value of column top where it is set.  images: key, url, width, height."""
    each = images.withColumn("__area", area(F.col("width"), F.col("height"), F.col("url")))
    best = F.min(F.when(F.col("__area") > 0, F.struct((-F.col("__area")).alias("a"), F.col("url").alias("url"))))["url"]
    return each.groupBy(key).agg((best if top is None else F.coalesce(F.nullif(F.max(top), F.lit("")), best)).alias("url"))


def clean_url(url: Column) -> Column:
    """Characters outside ASCII percent-encoded, the rest as it is."""
    return F.array_join(F.transform(F.split(url, ""), lambda c: F.when(c.rlike(r"\A[\x00-\x7e]?\z"), c).otherwise(F.regexp_replace(F.hex(F.encode(c, "UTF-8")), "(..)", "%$1"))), "")


def size_of(data: bytes | None) -> tuple[int, int] | None:
    """Width and height from the header of a PNG, GIF or JPEG file."""
    if not data:
        return None
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        return struct.unpack(">II", data[16:24])
    if data[:6] in (b"GIF87a", b"GIF89a") and len(data) >= 10:
        return struct.unpack("<HH", data[6:10])
    if data[:2] == b"\xff\xd8":
        at = 2
        while at + 9 < len(data):
            if data[at] != 0xFF:
                at += 1
                continue
            kind = data[at + 1]
            if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
                h, w = struct.unpack(">HH", data[at + 5 : at + 9])
                return w, h
            if kind in (0x01, 0xFF) or 0xD0 <= kind <= 0xD9:
                at += 1 if kind == 0xFF else 2
                continue
            at += 2 + struct.unpack(">H", data[at + 2 : at + 4])[0]
    return None


@F.pandas_udf(T.StructType([T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType())]))
def dimensions(content: pd.Series) -> pd.DataFrame:
    """struct(width, height) from a file's first bytes; nulls for other kinds of files."""
    found = [size_of(c) or (None, None) for c in content]
    return pd.DataFrame({"width": pd.array([w for w, _ in found], "Int32"), "height": pd.array([h for _, h in found], "Int32")})


def entropy(histogram: Column) -> Column:
    """Bits of information of a histogram (array of counts)."""
    total = F.aggregate(histogram, F.lit(0.0), lambda s, x: s + x)
    return F.aggregate(F.filter(histogram, lambda x: x > 0), F.lit(0.0), lambda s, x: s - x / total * F.log2(x / total))
