"""Sizes and orientation of images, and encrypted columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# EXIF orientation as (flip, clockwise degrees); 0 and 1 leave the image as it is.
ORIENTATIONS = {2: (True, 0), 3: (False, 180), 4: (True, 180), 5: (True, 270), 6: (False, 90), 7: (True, 90), 8: (False, 270)}


def transformation(orientation: Column) -> Column:
    """A struct (flip, rotate, turned) by EXIF orientation; null where nothing is to be done."""
    out = F.lit(None)
    for value, (flip, rotate) in ORIENTATIONS.items():
        kind = F.struct(F.lit(flip).alias("flip"), F.lit(rotate).alias("rotate"), F.lit(rotate % 180 == 90).alias("turned"))
        out = F.when(orientation == value, kind).otherwise(out)
    return out


def shown_size(width: Column, height: Column, orientation: Column) -> Column:
    """Width and height after the orientation is applied."""
    turned = F.coalesce(orientation.isin([k for k, (_, r) in ORIENTATIONS.items() if r % 180 == 90]), F.lit(False))
    return F.struct(F.when(turned, height).otherwise(width).alias("width"), F.when(turned, width).otherwise(height).alias("height"))


def reduced_size(width: Column, height: Column, least: int) -> Column:
    """The size whose smaller side is ``least``; the other is cut to a whole number."""
    wide = width > height
    scaled = lambda a, b: F.floor(a / b * least).cast("int")
    return F.struct(F.when(wide, scaled(width, height)).otherwise(least).alias("width"), F.when(wide, least).otherwise(scaled(height, width)).alias("height"))


def encrypted(df: DataFrame, key: Column, *names: str) -> DataFrame:
    """Text columns as AES-GCM cipher bytes under ``key`` (16, 24 or 32 bytes)."""
    return df.withColumns({n: F.aes_encrypt(F.col(n).cast("binary"), key) for n in names})


def decrypted(df: DataFrame, key: Column, *names: str) -> DataFrame:
    return df.withColumns({n: F.aes_decrypt(F.col(n), key).cast("string") for n in names})
