"""Scalar functions as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def half_even(x, step: float = 1.0) -> Column:
    """x rounded to a multiple of step, halves to even."""
    return F.rint(col(x) / step) * step


def angle_difference(a, b) -> Column:
    """Smallest angle between two directions, in degrees."""
    return F.abs(F.pmod(col(a) - col(b) + 180, F.lit(360)) - 180)


def apparent_dip(dip, angle) -> Column:
    """Dip seen along a direction at an angle to the dip direction, in degrees; 0 where the angle is missing (-1)."""
    return F.when(col(angle) == -1, 0.0).otherwise(F.degrees(F.atan(F.tan(F.radians(col(dip))) * F.cos(F.radians(col(angle))))))


def direction_consistency(sine, cosine) -> Column:
    """Length of the mean direction of a group's unit vectors: 1 where all agree, 0 where they cancel. An aggregate; missing directions are left out."""
    return F.hypot(F.avg(col(sine)), F.avg(col(cosine)))


def shape_index(perimeter, area) -> Column:
    """1 for a circle, more for longer outlines."""
    return F.when(col(area) > 0, col(perimeter) / (2 * F.sqrt(F.lit(math.pi) * col(area))))


def relative_level(elevation, quantile, span: float = 30.0) -> Column:
    return (col(elevation) - col(quantile)) / span


def dms(degrees, minutes, seconds) -> Column:
    """Decimal degrees; null unless minutes and seconds are within [0, 60)."""
    ok = col(minutes).between(0, 59.999999999) & col(seconds).between(0, 59.999999999)
    return F.when(ok, col(degrees) + col(minutes) / 60 + col(seconds) / 3600)


def encode_aspect(slope, aspect) -> tuple[Column, Column]:
    """Sine and cosine of an aspect in degrees, both 0 where the slope is 0; null outside slopes of 0 to 90 and aspects of 0 to 360."""
    ok = col(slope).between(0, 90) & col(aspect).between(0, 360)
    flat = (col(slope) > 0).cast("double")
    return F.when(ok, F.sin(F.radians(col(aspect))) * flat), F.when(ok, F.cos(F.radians(col(aspect))) * flat)


def repaired(text) -> Column:
    """Text of GB18030 bytes that were read as Latin-1, read anew; text that doesn't come from such bytes stays as it is.

    Needs spark.sql.legacy.javaCharsets, as GB18030 isn't among the charsets that are allowed otherwise.
    """
    latin = col(text).rlike(r"^[\u0000-ÿ]*$") & col(text).rlike(r"[\u0080-ÿ]")
    return F.when(latin, F.decode(F.encode(col(text), "ISO-8859-1"), "GB18030")).otherwise(col(text))


def clean_token(text) -> Column:
    """Lower case, other characters than letters and digits as one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(col(text))), r"[^\p{L}\p{N}]+", "_"), "^_+|_+$", "")


def srgb_to_lab(r, g, b) -> tuple[Column, Column, Column]:
    """CIE Lab (D65) of sRGB components in 0..255."""
    lin = [F.when(c > 0.04045, F.pow((c + 0.055) / 1.055, F.lit(2.4))).otherwise(c / 12.92) for c in (col(x) / 255.0 for x in (r, g, b))]
    # Fixed values of the sRGB standard: rows of the matrix to XYZ, each divided by the D65 white point.
    xyz = [
        (0.4124564 * lin[0] + 0.3575761 * lin[1] + 0.1804375 * lin[2]) / 0.95047,
        0.2126729 * lin[0] + 0.7151522 * lin[1] + 0.0721750 * lin[2],
        (0.0193339 * lin[0] + 0.1191920 * lin[1] + 0.9503041 * lin[2]) / 1.08883,
    ]
    f = [F.when(v > 0.008856451679035631, F.cbrt(v)).otherwise(v * 7.787037037037037 + 16 / 116) for v in xyz]
    return 116 * f[1] - 16, 500 * (f[0] - f[1]), 200 * (f[1] - f[2])


def delta_e(a: tuple[Column, Column, Column], b: tuple[Column, Column, Column]) -> Column:
    return F.sqrt(sum(((x - y) * (x - y) for x, y in zip(a, b, strict=True)), F.lit(0.0)))
