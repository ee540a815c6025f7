"""Queries over polygons with holes: overlay, dissolve, buffer."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import polygons
from .registry import query, table

CORNERS, HOLE = 12, 0.4

# a star-shaped, concave polygon around every point, with a hole of the same shape; hole edges turn the other way
_EDGES = f"""r AS (SELECT CAST(label AS BIGINT) AS ds, vec_id AS id, CAST(embedding[1] AS DOUBLE) * 100.0 + 1000 * (vec_id // 500) AS x, CAST(embedding[2] AS DOUBLE) * 100.0 AS y,
    k, f, m, (2.0 + 20.0 * abs(CAST(embedding[4 + k] AS DOUBLE))) * f AS r0, (2.0 + 20.0 * abs(CAST(embedding[4 + (k + 1) % {CORNERS}] AS DOUBLE))) * f AS r1
    FROM embeddings, unnest(range({CORNERS})) AS u(k), (VALUES (1.0, 1), ({HOLE}, -1)) AS w(f, m)),
  e AS MATERIALIZED (SELECT ds, id, m, x + r0 * cos(2 * pi() * k / {CORNERS}) AS x0, y + r0 * sin(2 * pi() * k / {CORNERS}) AS y0,
    x + r1 * cos(2 * pi() * ((k + 1) % {CORNERS}) / {CORNERS}) AS x1, y + r1 * sin(2 * pi() * ((k + 1) % {CORNERS}) / {CORNERS}) AS y1 FROM r)"""


def _area(k: int) -> str:
    """From g (grp, m, x0, y0, x1, y1): the area of what is wound around at least k times, by slabs between all heights of corners and crossings."""
    cross = "(a.x1 - a.x0) * (b.y1 - b.y0) - (a.y1 - a.y0) * (b.x1 - b.x0)"
    t = f"((b.x0 - a.x0) * (b.y1 - b.y0) - (b.y0 - a.y0) * (b.x1 - b.x0)) / nullif({cross}, 0)"
    u = f"((b.x0 - a.x0) * (a.y1 - a.y0) - (b.y0 - a.y0) * (a.x1 - a.x0)) / nullif({cross}, 0)"
    return f"""n AS MATERIALIZED (SELECT *, row_number() OVER () AS i, least(x0, x1) AS xl, greatest(x0, x1) AS xh, least(y0, y1) AS yl, greatest(y0, y1) AS yh FROM g),
  h AS (SELECT grp, y0 AS y FROM n UNION SELECT grp, y FROM (SELECT a.grp, a.y0 + {t} * (a.y1 - a.y0) AS y, {t} AS t, {u} AS u FROM n a JOIN n b ON a.grp = b.grp AND a.i < b.i AND a.xl <= b.xh AND b.xl <= a.xh AND a.yl <= b.yh AND b.yl <= a.yh) q
    WHERE t > 0 AND t < 1 AND u > 0 AND u < 1),
  s AS (SELECT grp, y AS ya, lead(y) OVER (PARTITION BY grp ORDER BY y) AS yb FROM h),
  x AS (SELECT s.grp, ya, yb, n.x0 + ((ya + yb) / 2 - n.y0) * (n.x1 - n.x0) / (n.y1 - n.y0) AS x, CASE WHEN n.y1 > n.y0 THEN n.m ELSE -n.m END AS up
    FROM s JOIN n ON n.grp = s.grp AND yb > ya AND n.yl < (ya + yb) / 2 AND n.yh > (ya + yb) / 2),
  w AS (SELECT grp, yb - ya AS high, x - lag(x) OVER (PARTITION BY grp, ya ORDER BY x) AS wide, sum(up) OVER (PARTITION BY grp, ya ORDER BY x ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS wound FROM x),
  a AS (SELECT grp, coalesce(sum(high * wide) FILTER (WHERE wound >= {k}), 0) AS area FROM w GROUP BY grp)"""


def _place(e: DataFrame) -> list[Column]:
    """Where a vector lies: 500 of them to a site, so that a larger table has more sites and not more on one spot."""
    x, y = (e["embedding"][i].cast("double") * 100.0 for i in (0, 1))
    return [x + 1000 * F.floor(e["vec_id"] / 500), y]


def stars(spark: SparkSession, d: str) -> DataFrame:
    """(ds, id, ring, hole): a polygon with a hole around every point of ``embeddings``."""
    e = table(spark, d, "embeddings")
    px, py = _place(e)
    angle = lambda k: 2 * F.pi() * k / CORNERS
    radius = lambda k: 2.0 + 20.0 * F.abs(F.element_at("embedding", k + 4).cast("double"))
    x = lambda k: F.col("px") + radius(k) * F.col("f") * F.cos(angle(k))
    y = lambda k: F.col("py") + radius(k) * F.col("f") * F.sin(angle(k))
    rows = e.select(F.col("label").cast("long").alias("ds"), F.col("vec_id").alias("id"), "embedding", px.alias("px"), py.alias("py"), F.explode(F.array(F.lit(1.0), F.lit(HOLE))).alias("f"))
    ring = F.transform(F.sequence(F.lit(0), F.lit(CORNERS - 1)), lambda k: polygons.point(x(k), y(k)))
    return rows.select("ds", "id", ring.alias("ring"), (F.col("f") < 1).alias("hole"))


def star_edges(spark: SparkSession, d: str) -> DataFrame:
    return polygons.ring_edges(stars(spark, d), ["ds", "id"])


@query("q73_polygon_overlay", f"""WITH {_EDGES}, b AS (SELECT ds, id, min(x0) AS minx, min(y0) AS miny, max(x0) AS maxx, max(y0) AS maxy FROM e GROUP BY ds, id),
  p AS (SELECT a.ds, a.id AS id_1, c.id AS id_2, a.id * 100000000 + c.id AS grp FROM b a JOIN b c ON a.ds = c.ds AND a.id % 2 = 0 AND c.id % 2 = 1 AND a.minx <= c.maxx AND c.minx <= a.maxx AND a.miny <= c.maxy AND c.miny <= a.maxy),
  g AS (SELECT grp, m, x0, y0, x1, y1 FROM p JOIN e ON e.id = p.id_1 UNION ALL SELECT grp, m, x0, y0, x1, y1 FROM p JOIN e ON e.id = p.id_2), {_area(2)}
  SELECT ds, id_1, id_2, round(area, 5) AS area, false AS touching FROM a JOIN p ON p.grp = a.grp WHERE area > 1e-9""")
def q73(spark: SparkSession, d: str) -> DataFrame:
    e = star_edges(spark, d)
    out = polygons.overlay(e.where("id % 2 = 0"), e.where("id % 2 = 1"), "id", ["ds"], cell=2.0, boxes=8.0)
    by = ["ds", "id_1", "id_2", "touching"]
    return polygons.area(out, by).select("ds", "id_1", "id_2", F.round(F.coalesce("area", F.lit(0.0)), 5).alias("area"), "touching")


@query("q74_polygon_dissolve", f"""WITH {_EDGES}, g AS (SELECT ds AS grp, m, x0, y0, x1, y1 FROM e WHERE ds IS NOT NULL), {_area(1)},
  b AS (SELECT ds, min(x0) AS minx, max(y0) AS maxy FROM e GROUP BY ds) SELECT ds, round(area, 5) AS area, round(minx, 6) AS minx, round(maxy, 6) AS maxy FROM a JOIN b ON b.ds = a.grp""")
def q74(spark: SparkSession, d: str) -> DataFrame:
    union = polygons.region(star_edges(spark, d).where("ds is not null").drop("id"), ["ds"], 1, cell=2.0)
    rings = polygons.rings(union, ["ds"])
    x, y = F.transform("ring", lambda p: p["x"]), F.transform("ring", lambda p: p["y"])
    out = rings.groupBy("ds").agg(F.sum("area").alias("area"), F.min(F.array_min(x)).alias("minx"), F.max(F.array_max(y)).alias("maxy"))
    return out.select("ds", F.round("area", 5).alias("area"), F.round("minx", 6).alias("minx"), F.round("maxy", 6).alias("maxy"))


# inside of a ring, an odd number of edges is passed on the way to the right; near is the distance to an edge
@query("q75_within_buffer", f"""WITH {_EDGES}, p AS (SELECT CAST(label AS BIGINT) AS ds, vec_id AS id, CAST(embedding[1] AS DOUBLE) * 100.0 + 1000 * (vec_id // 500) AS x, CAST(embedding[2] AS DOUBLE) * 100.0 AS y FROM embeddings), b AS (SELECT ds, id, min(x0) - 1 AS minx, min(y0) - 1 AS miny, max(x0) + 1 AS maxx, max(y0) + 1 AS maxy FROM e GROUP BY ds, id),
  q AS (SELECT b.ds, b.id, p.id AS point_id, x, y FROM b JOIN p ON p.ds = b.ds AND x BETWEEN minx AND maxx AND y BETWEEN miny AND maxy),
  t AS (SELECT q.*, e.*, greatest(0, least(1, ((q.x - x0) * (x1 - x0) + (q.y - y0) * (y1 - y0)) / ((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)))) AS t FROM q JOIN e ON e.id = q.id),
  w AS (SELECT id, point_id, sum(CASE WHEN (y0 <= y) <> (y1 <= y) AND x0 + (y - y0) * (x1 - x0) / (y1 - y0) > x THEN 1 ELSE 0 END) % 2 = 1 AS inside,
    min((x - x0 - t * (x1 - x0)) * (x - x0 - t * (x1 - x0)) + (y - y0 - t * (y1 - y0)) * (y - y0 - t * (y1 - y0))) AS d2 FROM t GROUP BY 1, 2)
  SELECT id, point_id FROM w WHERE inside OR d2 <= 1""")
def q75(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    x, y = _place(e)
    points = e.select(F.col("label").cast("long").alias("point_ds"), F.col("vec_id").alias("point_id"), x.alias("x"), y.alias("y"))
    near = polygons.within_distance(points, star_edges(spark, d), ["ds", "id"], 1.0, 2.0, ["point_ds", "point_id"], condition=F.col("ds") == F.col("point_ds"))
    return near.select("id", "point_id")
