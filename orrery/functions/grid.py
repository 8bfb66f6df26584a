"""Column expressions for image grids, pyramids and crops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def nearest_line(x: Column | str, size: Column | str, lines: int) -> Column:
    """The grid line (0 .. lines - 1) nearest to a coordinate; halves go to the even line."""
    x, size = (F.col(c) if isinstance(c, str) else c for c in (x, size))
    return F.least(F.greatest(F.bround(x / F.nullif(size.cast("double"), F.lit(0.0)) * (lines - 1)), F.lit(0)), F.lit(lines - 1)).cast("int")


def grid_size(size: Column | str, step: int) -> Column:
    """The nearest multiple of ``step``, one step at least."""
    size = F.col(size) if isinstance(size, str) else size
    return F.greatest(F.lit(1), F.bround(size / step)).cast("int") * step


def pyramid(images: DataFrame, key: str, width: str, height: str, smallest: int = 224, factor: float = 0.5) -> DataFrame:
    """(key, zoom_level, scale_factor, scaled_width, scaled_height, max_zoom_level): the image at falling scales while its shorter side holds ``smallest``.

    Level 0 is the image itself; one smaller than that has level 0 alone, enlarged so that it holds a tile.
    """
    short = F.least(width, height).cast("double")
    levels = F.greatest(F.lit(0), F.floor(F.log(short / smallest) / F.log(F.lit(1 / factor)) + 1e-9)).cast("int")
    rows = images.select(key, width, height, short.alias("_short"), levels.alias("max_zoom_level")).withColumn("zoom_level", F.explode(F.sequence(F.lit(0), F.col("max_zoom_level"))))
    scale = F.pow(F.lit(factor), F.col("zoom_level")) * F.greatest(F.lit(1.0), F.lit(float(smallest)) / F.col("_short"))
    rows = rows.withColumn("scale_factor", scale)
    size = lambda c: F.floor(F.col(c) * F.col("scale_factor") + 0.5).cast("int")
    return rows.select(key, "zoom_level", "scale_factor", size(width).alias("scaled_width"), size(height).alias("scaled_height"), "max_zoom_level")


def tiles_of(levels: DataFrame, key: str, tile: int = 224) -> DataFrame:
    """(key, zoom_level, patch_id, x1, y1, x2, y2): tiles at half strides of each level, in coordinates of the original image."""
    from pyspark.sql import Window

    step = tile // 2
    starts = lambda c: F.expr(f"if({c} >= {tile}, sequence(0, {c} - {tile}, {step}), cast(array() as array<int>))")
    t = levels.select(key, "zoom_level", "scale_factor", F.explode(starts("scaled_height")).alias("_y"), starts("scaled_width").alias("_xs")).withColumn("_x", F.explode("_xs"))
    order = Window.partitionBy(key).orderBy("zoom_level", "_y", "_x")
    s = F.col("scale_factor")
    return t.select(key, "zoom_level", (F.row_number().over(order) - 1).alias("patch_id"), (F.col("_x") / s).alias("x1"), (F.col("_y") / s).alias("y1"), ((F.col("_x") + tile) / s).alias("x2"), ((F.col("_y") + tile) / s).alias("y2"))


def shifted_interval(start: Column, end: Column, limit: Column) -> tuple[Column, Column]:
    """An interval moved into [0, limit] without a change of length, if it fits."""
    move = F.when(start < 0, -start).when(end > limit, limit - end).otherwise(0.0)
    return start + move, end + move


def random_crop(x1: Column, x2: Column, side: Column, limit: Column, seed: int, *keys: Column) -> tuple[Column, Column]:
    """A segment of length ``side`` inside [0, limit] that holds [x1, x2], at a place that a seed and the row's keys decide."""
    low, high = F.greatest(F.lit(0.0), x2 - side), F.least(x1, limit - side)
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), *keys).cast("binary")), 1, 5), 16, 10).cast("double") / float(1 << 20)
    start = low + (F.greatest(low, high) - low) * u
    return start, start + side
