"""Pairs by distance, dominance, one-to-one matching, overlap suppression, local maxima."""

from functools import reduce
from itertools import count

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import written
from .graph import components
from .relational import PAIRS, spread
from .spatial import BOX, box_join, distance, in_cells

#: Rounds of a matching or suppression before connected parts are finished one by one.
ROUNDS = 8
#: Edges of a connected part that one task may finish.
PART_EDGES = 1_000_000


def within_reach(owner: DataFrame, other: DataFrame, at: tuple[str, str], to: tuple[str, str], radius: Column, on: list[tuple[str, str]], condition: Column) -> DataFrame:
    """Pairs of an owner and another point that meet ``condition``, which must imply that both |dx| and |dy| are at most the owner's radius.

    Owners are classed by the power of two above their radius, and each class has cells of that size:
    an owner covers at most nine of them, and a point looks in one cell for every class that its
    group has. So a few huge radii cost a class more, not a huge number of cells.
    """
    level = F.ceil(F.log2(F.greatest(radius, F.lit(2.0**-20)))).cast("int")
    size = F.pow(F.lit(2.0), F.col("_level"))
    cell = lambda c: F.floor(c / size).cast("long")
    a = owner.withColumn("_level", level).withColumn("_reach", F.greatest(radius, F.lit(0.0))).where("_level is not null")
    classes = a.select(*[F.col(x).alias(f"_c{i}") for i, (x, _) in enumerate(on)], F.col("_level").alias("_of")).distinct()
    for c, name in zip(at, ("_xl", "_yl"), strict=True):
        a = a.withColumn(name, F.explode(F.sequence(cell(F.col(c) - F.col("_reach")), cell(F.col(c) + F.col("_reach")))))
    b = other.join(classes, reduce(lambda p, q: p & q, [F.col(y) == F.col(f"_c{i}") for i, (_, y) in enumerate(on)]))
    size = F.pow(F.lit(2.0), F.col("_of"))
    for c, name in zip(to, ("_xr", "_yr"), strict=True):
        b = b.withColumn(name, F.floor(F.col(c) / size).cast("long"))
    a, b, keys = spread(a, b, [*on, ("_level", "_of"), ("_xl", "_xr"), ("_yl", "_yr")])
    same = [F.col(x) == F.col(y) for x, y in keys]
    pairs = a.join(b, reduce(lambda p, q: p & q, [*same, condition]))
    return pairs.select(*owner.columns, *other.columns)


def _side(points: DataFrame, prefix: str, columns: tuple[str, ...] = ("ds", "id", "x", "y", "h")) -> DataFrame:
    return points.select(*[F.col(c).alias(f"{prefix}_{c}") for c in columns])


_DISTANCE = ("l_x", "l_y", "r_x", "r_y")


def candidate_pairs(left: DataFrame, right: DataFrame, share: float = 0.5, slope: float = 0.1, intercept: float = 1.0) -> DataFrame:
    """Pairs (ds, left_id, right_id, dist): right heights within ``share`` of the left one, nearer than slope * height + intercept (all strict).

    Both tables: ds, id, x, y, h.
    """
    reach = F.col("l_h") * slope + intercept
    dist = distance(*map(F.col, _DISTANCE))
    near = (F.col("r_h") > F.col("l_h") * (1 - share)) & (F.col("r_h") < F.col("l_h") * (1 + share)) & (dist < reach)
    pairs = within_reach(_side(left, "l"), _side(right, "r"), ("l_x", "l_y"), ("r_x", "r_y"), reach, [("l_ds", "r_ds")], near)
    return pairs.select(F.col("l_ds").alias("ds"), F.col("l_id").alias("left_id"), F.col("r_id").alias("right_id"), dist.alias("dist"))


def overstory(points: DataFrame, slope: float = 0.1, intercept: float = 1.0) -> DataFrame:
    """Points that no higher point of their group dominates: dist < slope * (height difference) + intercept.

    ``points``: ds, id, x, y, h. A point dominates no farther than its height over the group's least allows.
    """
    least = points.groupBy(F.col("ds").alias("_ds")).agg(F.min("h").alias("_least"))
    high = _side(points, "r").join(least, F.col("r_ds") == F.col("_ds")).drop("_ds")
    reach = (F.col("r_h") - F.col("_least")) * slope + intercept
    dominates = (F.col("r_h") > F.col("l_h")) & (distance(*map(F.col, _DISTANCE)) < (F.col("r_h") - F.col("l_h")) * slope + intercept)
    pairs = within_reach(high, _side(points, "l"), ("r_x", "r_y"), ("l_x", "l_y"), reach, [("r_ds", "l_ds")], dominates)
    return points.join(pairs.select(F.col("l_ds").alias("ds"), F.col("l_id").alias("id")).distinct(), ["ds", "id"], "left_anti")


def mutual_best(edges: DataFrame) -> DataFrame:
    """Edges that are the best of both their ends, under the total order (dist, left_id, right_id). ``edges``: ds, left_id, right_id, dist."""
    order = F.struct("dist", "left_id", "right_id")
    a = edges.groupBy("ds", "left_id").agg(F.min(order).alias("_e")).select("ds", "_e.*")
    b = edges.groupBy("ds", "right_id").agg(F.min(order).alias("_e")).select("ds", "_e.*")
    return a.join(b.select("ds", "left_id", "right_id"), ["ds", "left_id", "right_id"], "left_semi")


def _node(side: str, key: str) -> Column:
    return F.xxhash64(F.lit(side), F.col("ds"), F.col(key))


def by_parts(edges: DataFrame, a: Column, b: Column) -> tuple[DataFrame, DataFrame]:
    """``edges`` plus ``root``, their connected part: those of parts that one task can finish, and the others."""
    rooted = edges.withColumn("_a", a)
    rooted = written(rooted.join(components(rooted.select(F.col("_a").alias("a"), b.alias("b"))).withColumnRenamed("node", "_a"), "_a").drop("_a"))
    big = written(rooted.groupBy("root").count().where(F.col("count") > PART_EDGES).select("root"))
    return rooted.join(big, "root", "left_anti"), rooted.join(big, "root", "left_semi")


def _greedy(part: pd.DataFrame) -> pd.DataFrame:
    left, right, kept = set(), set(), []
    part = part.sort_values(["ds", "dist", "left_id", "right_id"]).reset_index(drop=True)
    for i, a, b in zip(range(len(part)), zip(part["ds"], part["left_id"]), zip(part["ds"], part["right_id"])):
        if a not in left and b not in right:
            left.add(a)
            right.add(b)
            kept.append(i)
    return part.loc[kept, ["ds", "left_id", "right_id", "dist"]]


def greedy_match(edges: DataFrame) -> DataFrame:
    """One-to-one matching by ascending distance: rounds of mutually best edges, which equal the sequential greedy under one total order.

    A chain of ever nearer neighbours would take a round for every pair, so after ``ROUNDS`` rounds the
    connected parts that are left are finished one a task; parts of more than ``PART_EDGES`` edges go
    on in rounds. ``edges``: ds, left_id, right_id, dist, none of them null.
    """
    edges = edges.select("ds", "left_id", "right_id", "dist")
    left, done = written(edges), edges.limit(0)
    for n in count(1):
        if left.isEmpty():
            return done
        if n % ROUNDS == 0:
            few, many = by_parts(left, _node("l", "left_id"), _node("r", "right_id"))
            done = done.unionByName(written(few.groupBy("root").applyInPandas(lambda part: _greedy(part), edges.schema)))
            left = written(many.drop("root"))
            continue
        best = written(mutual_best(left))
        done = done.unionByName(best)
        left = written(left.join(best, ["ds", "left_id"], "left_anti").join(best.select("ds", "right_id"), ["ds", "right_id"], "left_anti"))


def _survivors(part: pd.DataFrame) -> pd.DataFrame:
    part = part.sort_values(["ds", "score", "winner"], ascending=[True, False, False])
    gone, out = set(), {}
    for ds, winner, loser in zip(part["ds"], part["winner"], part["loser"]):
        out[(ds, winner)] = out[(ds, loser)] = None
        if (ds, winner) not in gone:
            gone.add((ds, loser))
    return pd.DataFrame([k for k in out if k not in gone], columns=["ds", "id"])


#: Overlapping pairs a box, in the mean, up to which suppression lists all of them.
CROWD = 32


def _shared(a: str, b: str) -> Column:
    """The intersection's part of the smaller area; null where that is none."""
    area = lambda p: (F.col(f"{p}maxx") - F.col(f"{p}minx")) * (F.col(f"{p}maxy") - F.col(f"{p}miny"))
    wide = F.greatest(F.least(f"{a}maxx", f"{b}maxx") - F.greatest(f"{a}minx", f"{b}minx"), F.lit(0.0))
    high = F.greatest(F.least(f"{a}maxy", f"{b}maxy") - F.greatest(f"{a}miny", f"{b}miny"), F.lit(0.0))
    return wide * high / F.nullif(F.least(area(a), area(b)), F.lit(0.0))


def _thinned(open_: DataFrame, threshold: float, cell: float) -> tuple[DataFrame, DataFrame]:
    """(kept, undecided) boxes (ds, id, score, BOX) of crowds: rounds in which the best box of all cells that it covers is kept and what it overlaps goes.

    No better box can overlap such a box, and a cell has one, so a round tests a pair a row of a cell, not all pairs of a crowd. It ends
    when the pairs that are left are few, or when a round decides little.
    """
    kept, before = open_.limit(0), 0
    key = F.struct("score", "id")
    while True:
        cells = in_cells(open_, BOX, cell, ("_x", "_y"))
        top = written(cells.groupBy("ds", "_x", "_y").agg(F.max(key).alias("_top"), F.count("*").alias("_n")))
        size = top.agg(F.sum("_n").alias("rows"), F.sum(F.col("_n").cast("double") * F.col("_n")).alias("pairs")).first()
        rows = size["rows"] or 0
        if (size["pairs"] or 0) <= max(CROWD * rows, PAIRS) or (before and rows > before * 31 / 32):
            return kept, open_
        beaten = cells.join(top, ["ds", "_x", "_y"]).groupBy("ds", "id").agg(F.max(key < F.col("_top")).alias("_beaten"))
        best = written(open_.join(beaten.where("not _beaten").select("ds", "id"), ["ds", "id"], "left_semi"))
        winners = in_cells(best, BOX, cell, ("_x", "_y")).withColumnsRenamed({n: f"w_{n}" for n in ("id", "score", *BOX)})
        losers = cells.withColumnsRenamed({n: f"l_{n}" for n in ("id", "score", *BOX)})
        lost = (F.struct("w_score", "w_id") > F.struct("l_score", "l_id")) & (_shared("w_", "l_") > threshold)
        gone = losers.join(winners, ["ds", "_x", "_y"]).where(lost).select("ds", F.col("l_id").alias("id"))
        decided = gone.unionByName(best.select("ds", "id")).distinct()
        kept, open_, before = kept.unionByName(best), written(open_.join(decided, ["ds", "id"], "left_anti")), rows


def suppressed(boxes: DataFrame, threshold: float, cell: float, group: str = "ds") -> DataFrame:
    """Non-maximum suppression by intersection over the smaller area: the boxes that greedy selection keeps.

    ``boxes``: group, id, score, minx, miny, maxx, maxy. Crowds are thinned first (``_thinned``), so pairs of boxes grow with the boxes
    and not with the square of their number on a spot. Rounds: an undecided box without an undecided
    overlapping neighbour of higher (score, id) is kept, and its neighbours go. After ``ROUNDS`` rounds
    connected parts are finished one a task, as in ``greedy_match``.
    """
    every = written(boxes.select(F.col(group).alias("ds"), "id", "score", *[F.col(c).cast("double").alias(c) for c in BOX]))
    kept, every = _thinned(every, threshold, cell / 2)
    kept = kept.select("ds", "id")
    pick = lambda p: every.select(*[F.col(c).alias(f"{p}{c}") for c in ("ds", "id", "score", *BOX)])
    box = lambda p: tuple(f"{p}{c}" for c in BOX)
    above = F.struct("a_score", "a_id") > F.struct("b_score", "b_id")
    pairs = box_join(pick("a_"), pick("b_"), box("a_"), box("b_"), cell, [("a_ds", "b_ds")], above & (_shared("a_", "b_") > threshold))
    edges = written(pairs.select(F.col("a_ds").alias("ds"), F.col("a_id").alias("winner"), F.col("b_id").alias("loser"), F.col("a_score").alias("score")))
    open_ = written(every.select("ds", "id"))
    for n in count(1):
        if edges.isEmpty():  # nobody is in anybody's way any more
            kept = kept.unionByName(open_)
            break
        if n % ROUNDS == 0:
            few, many = by_parts(edges, _node("", "winner"), _node("", "loser"))
            few = written(few)
            ends = few.select("ds", F.explode(F.array("winner", "loser")).alias("id")).distinct()
            kept = kept.unionByName(written(few.groupBy("root").applyInPandas(lambda part: _survivors(part), open_.schema)))
            open_, edges = written(open_.join(ends, ["ds", "id"], "left_anti")), written(many.drop("root"))
            continue
        losers = edges.select("ds", F.col("loser").alias("id")).distinct()
        best = written(open_.join(losers, ["ds", "id"], "left_anti"))
        kept = kept.unionByName(best)
        gone = written(edges.join(best.withColumnRenamed("id", "winner"), ["ds", "winner"], "left_semi").select("ds", F.col("loser").alias("id")).distinct())
        open_ = written(open_.join(best, ["ds", "id"], "left_anti").join(gone, ["ds", "id"], "left_anti"))
        edges = written(edges.join(open_.withColumnRenamed("id", "winner"), ["ds", "winner"], "left_semi").join(open_.withColumnRenamed("id", "loser"), ["ds", "loser"], "left_semi"))
    return boxes.join(kept.withColumnRenamed("ds", group), [group, "id"], "left_semi")


def local_maxima(points: DataFrame, a: float = 0.0, b: float = 0.0325, c: float = 0.25) -> DataFrame:
    """Points without a higher one within a*h*h + b*h + c (their own height h; our reading of a variable window).

    ``points``: ds, id, x, y, h. Of equally high points the one with the lesser id wins.
    """
    radius = a * F.col("l_h") * F.col("l_h") + b * F.col("l_h") + c
    near = distance(*map(F.col, _DISTANCE)) <= radius
    above = (F.col("r_h") > F.col("l_h")) | ((F.col("r_h") == F.col("l_h")) & (F.col("r_id") < F.col("l_id")))
    pairs = within_reach(_side(points, "l"), _side(points, "r"), ("l_x", "l_y"), ("r_x", "r_y"), radius, [("l_ds", "r_ds")], near & above)
    return points.join(pairs.select(F.col("l_ds").alias("ds"), F.col("l_id").alias("id")).distinct(), ["ds", "id"], "left_anti")


#: Markers that a cell looks at, in the mean, in the first round of a search for the nearest.
LOOKS = 8


def nearest_marker(cells: DataFrame, markers: DataFrame, reach: float) -> DataFrame:
    """Each cell's nearest marker within reach (our substitute for a marker-seeded watershed): ds, id, marker_id, dist.

    A cell that has a marker within some radius needs none beyond, so the radius starts where there are a few markers to a cell and doubles
    for those that found none, up to ``reach``. Of markers on one point only the first is looked at. Pairs grow with the cells.
    """
    four = ("ds", "id", "x", "y")
    dist = distance(*map(F.col, _DISTANCE))
    markers = _side(written(markers.groupBy("ds", "x", "y").agg(F.min("id").alias("id"))), "r", four)
    left = written(_side(cells.where("ds is not null"), "l", four))
    at = lambda p, size: [F.col(f"{p}_ds").alias("ds"), F.floor(F.col(f"{p}_x") / size).alias("x"), F.floor(F.col(f"{p}_y") / size).alias("y")]

    def crowded(size: float) -> bool:
        n = left.groupBy(*at("l", size)).agg(F.count("*").alias("n")).join(markers.groupBy(*at("r", size)).agg(F.count("*").alias("m")), ["ds", "x", "y"])
        n = n.agg(F.sum(F.col("n").cast("double") * F.col("m")).alias("pairs"), F.sum("n").alias("n")).first()
        return (n["pairs"] or 0) > LOOKS * (n["n"] or 0)

    halvings = next((i for i in range(40) if not crowded(reach / 2**i)), 40) if reach > 0 else 0
    done = None
    for i in range(halvings, -1, -1):
        radius = reach / 2**i
        pairs = within_reach(left, markers, ("l_x", "l_y"), ("r_x", "r_y"), F.lit(float(radius)), [("l_ds", "r_ds")], dist <= radius)
        best = pairs.groupBy("l_ds", "l_id").agg(F.min(F.struct(dist.alias("dist"), F.col("r_id").alias("marker_id"))).alias("_m"))
        found = best.select(F.col("l_ds").alias("ds"), F.col("l_id").alias("id"), "_m.marker_id", "_m.dist")
        if i:
            found = written(found)
            left = written(left.join(found.select(F.col("ds").alias("l_ds"), F.col("id").alias("l_id")), ["l_ds", "l_id"], "left_anti"))
        done = found if done is None else done.unionByName(found)
    return done


def attributes_of_matches(left: DataFrame, matches: DataFrame, right: DataFrame, suffixes: tuple[str, str]) -> DataFrame:
    """Left rows with the columns of the right row they are matched with; colliding names get suffixes.

    ``left`` and ``right``: ds, id, ...; ``matches``: ds, left_id, right_id. Unmatched left rows get NULLs.
    """
    both = (set(left.columns) & set(right.columns)) - {"ds", "id"}
    a = left.withColumnsRenamed({c: c + suffixes[0] for c in both}).withColumnRenamed("id", "left_id")
    b = right.withColumnsRenamed({c: c + suffixes[1] for c in both}).withColumnRenamed("id", "right_id")
    return a.join(matches.select("ds", "left_id", "right_id"), ["ds", "left_id"], "left").join(b, ["ds", "right_id"], "left")
