"""Colours for shares of samples, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stackloom.model import ColorScheme


def _byte(x: Column) -> Column:
    return F.lpad(F.lower(F.hex(x.cast("int"))), 2, "0")


def _code(r: Column, g: Column, b: Column) -> Column:
    return F.concat(F.lit("#"), _byte(r), _byte(g), _byte(b))


def _bands(x: Column, *bands: tuple[float, Column]) -> Column:
    """The value of the first band whose upper edge lies above x, else of the last."""
    out = bands[-1][1]
    for edge, value in reversed(bands[:-1]):
        out = F.when(x < edge, value).otherwise(out)
    return out


def color(samples: Column, most: Column, scheme: ColorScheme) -> Column:
    """#rrggbb for samples out of most; white where most is 0. Channels are truncated, not rounded."""
    x = samples.cast("double") / most
    full, none = F.lit(255.0), F.lit(0.0)
    if scheme is ColorScheme.Grayscale:
        gray = (1.0 - x) * 255
        code = _code(gray, gray, gray)
    elif scheme is ColorScheme.Heatmap:
        # Blue, cyan, green, yellow, red at quarters.
        red = _bands(x, (0.5, none), (0.75, (x - 0.5) * 4 * 255), (2.0, full))
        green = _bands(x, (0.25, x * 4 * 255), (0.75, full), (2.0, (1.0 - x) * 4 * 255))
        blue = _bands(x, (0.25, full), (0.5, (0.5 - x) * 4 * 255), (2.0, none))
        code = _code(red, green, blue)
    else:
        # Full saturation and value; the hue falls from 270 degrees to 0 as the share grows.
        hue = (1.0 - x) * 270.0
        ramp = (1.0 - F.abs((hue / 60.0) % 2.0 - 1.0)) * 255
        red = _bands(hue, (60, full), (120, ramp), (240, none), (400, ramp))
        green = _bands(hue, (60, ramp), (180, full), (240, ramp), (400, none))
        blue = _bands(hue, (120, none), (180, ramp), (400, full))
        code = _code(red, green, blue)
    return F.when(most > 0, code).otherwise("white")
