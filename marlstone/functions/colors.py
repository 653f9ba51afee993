"""Colours by name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names and their red, green and blue.
PALETTE = {
    "black": (20, 20, 20), "white": (238, 238, 232), "grey": (128, 128, 128), "red": (180, 35, 35), "maroon": (100, 25, 35), "pink": (220, 120, 160), "blue": (45, 95, 180), "navy": (20, 35, 90),
    "green": (45, 130, 70), "olive": (85, 95, 45), "yellow": (220, 190, 45), "gold": (190, 145, 45), "brown": (120, 75, 45), "cream": (225, 210, 175), "purple": (115, 70, 155),
    "orange": (220, 120, 45), "silver": (180, 185, 190),
}


def nearest_color(red: Column, green: Column, blue: Column) -> Column:
    """The name at the least squared distance; ties to the first in the table."""
    far = [((red - r) * (red - r) + (green - g) * (green - g) + (blue - b) * (blue - b)).cast("double") for r, g, b in PALETTE.values()]
    least = F.array_min(F.array(*[F.struct(d.alias("d"), F.lit(i).alias("i"), F.lit(n).alias("n")) for i, (n, d) in enumerate(zip(PALETTE, far, strict=True))]))
    return least["n"]
