"""Image chips: from labelled parts in images to padded boxes with species at four levels."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.aggregates import above_group_share, bounds
from ..operators.spatial import BOX, padded_box
from .species import crosswalk


def chip_records(parts: DataFrame, trees: DataFrame, width: Column, height: Column, edge: float = 250, padding: float = 0.02, share: float = 0.5) -> DataFrame:
    """One record per tree seen in an image.

    ``parts``: dataset, image, id, area and a box; parts that are not above ``share`` of the largest of
    their tree are dropped, the others' boxes united, boxes with an edge up to ``edge`` dropped, the
    rest padded and clamped to the image. ``trees``: dataset, id, species; a tree without species, or
    unknown, keeps its record without one.
    """
    parts = parts.withColumn("_tree", F.struct("dataset", "image", "id"))
    boxes = bounds(above_group_share(parts, "_tree", "area", share), ["dataset", "image", "id"], BOX, edge)
    # a row for every tree: however few bytes it is thought to come from, it is too much to be gathered and broadcast
    named = boxes.join(trees.select("dataset", "id", F.col("species").alias("species_original")).hint("merge"), ["dataset", "id"], "left")
    levels = [c for c in crosswalk(F.col("species_original"))]
    return named.select("dataset", "image", "id", "species_original", *levels, *padded_box(tuple(map(F.col, BOX)), padding, width, height))
