"""Queries over dense tiles, unlike grids and watersheds."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import grids, raster
from ..operators.watershed import watershed
from . import inputs
from .registry import query

RADIUS = 3
_S = f"s AS MATERIALIZED (SELECT row, col, value FROM ({inputs.DSM}) q WHERE value IS NOT NULL)"
_NEAR = f"(a.row - b.row) * (a.row - b.row) + (a.col - b.col) * (a.col - b.col) <= {RADIUS * RADIUS}"
_PEAKS = f"""{_S}, t AS MATERIALIZED (SELECT row, col FROM s a WHERE NOT EXISTS (SELECT 1 FROM s b WHERE {_NEAR} AND (b.value > a.value OR (b.value = a.value AND (b.row < a.row OR (b.row = a.row AND b.col < a.col))))))"""


@query("q76_focal_maximum", f"WITH {_S} SELECT a.row, a.col, round(a.value, 6) AS value, round(max(b.value), 6) AS most FROM s a JOIN s b ON {_NEAR} GROUP BY a.row, a.col, a.value")
def q76(spark: SparkSession, d: str) -> DataFrame:
    out = grids.focal_maximum(inputs.surface(spark, d), RADIUS, size=32)
    return out.select("row", "col", F.round("value", 6).alias("value"), F.round("most", 6).alias("most"))


@query("q76_local_peaks", f"WITH {_PEAKS} SELECT row, col FROM t")
def q76_peaks(spark: SparkSession, d: str) -> DataFrame:
    return grids.local_peaks(inputs.surface(spark, d), RADIUS, size=32).select("row", "col")


def _flood(rounds: int = 9, doublings: int = 14) -> str:
    """Rounds of parts that take their highest edge, with pointers doubled until they end; 2**doublings cells at most."""
    out = [
        f"{_PEAKS}, m AS MATERIALIZED (SELECT row * 2147483648 + col AS top FROM t)",
        """n AS MATERIALIZED (SELECT row, col, row * 2147483648 + col AS cell, value FROM s),
  e AS MATERIALIZED (SELECT a.cell AS x, b.cell AS y, least(a.value, b.value) AS h FROM n a JOIN n b ON b.cell = a.cell + 1 OR b.cell = a.cell + 2147483648),
  l0 AS MATERIALIZED (SELECT cell, cell AS part FROM n)""",
    ]
    for k in range(rounds):
        out.append(f"""w{k} AS MATERIALIZED (SELECT a.part AS a, b.part AS b, h, x, y FROM e JOIN l{k} a ON a.cell = x JOIN l{k} b ON b.cell = y WHERE a.part <> b.part),
  p{k} AS MATERIALIZED (SELECT a, b FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY h DESC, x, y) AS n FROM (SELECT a, b, h, x, y FROM w{k} UNION ALL SELECT b, a, h, x, y FROM w{k}) q WHERE a NOT IN (SELECT top FROM m)) r WHERE n = 1),
  j{k}_0 AS MATERIALIZED (SELECT l.part AS a, CASE WHEN p.a IS NULL OR (o.a IS NOT NULL AND p.a < p.b) THEN l.part ELSE p.b END AS b FROM (SELECT DISTINCT part FROM l{k}) l LEFT JOIN p{k} p ON p.a = l.part LEFT JOIN p{k} o ON o.a = p.b AND o.b = p.a)""")
        out += [f"j{k}_{i + 1} AS MATERIALIZED (SELECT f.a, g.b FROM j{k}_{i} f JOIN j{k}_{i} g ON g.a = f.b)" for i in range(doublings)]
        out.append(f"l{k + 1} AS MATERIALIZED (SELECT cell, j.b AS part FROM l{k} JOIN j{k}_{doublings} j ON j.a = part)")
    return f"WITH {', '.join(out)} SELECT row, col, top AS marker FROM n JOIN l{rounds} l ON l.cell = n.cell LEFT JOIN m ON top = part"


@query("q77_watershed_crowns", _flood())
def q77(spark: SparkSession, d: str) -> DataFrame:
    surface = inputs.surface(spark, d)
    return watershed(surface, grids.local_peaks(surface, RADIUS, size=32)).select("row", "col", "marker")


FINE, COARSE = grids.Grid(0.0, 0.0, 0.7), grids.Grid(0.3, 0.3, 1.0)


# whole heights, so that weights of a few digits make no halves that could be rounded either way
_WHOLE = f"s AS MATERIALIZED (SELECT row, col, floor(value) AS value FROM ({inputs.DSM}) q WHERE value IS NOT NULL)"


def _whole(spark: SparkSession, d: str) -> DataFrame:
    return inputs.surface(spark, d).withColumn("value", F.floor("value").cast("double"))


@query("q78_grid_average", f"""WITH {_WHOLE}, x AS (SELECT unnest(range(-1, 102)) AS i), c AS (SELECT s.row, s.col, value, a.i AS r, b.i AS c,
    least(s.row * 0.7::DOUBLE + 0.7, a.i + 1.3::DOUBLE) - greatest(s.row * 0.7::DOUBLE, a.i + 0.3::DOUBLE) AS high, least(s.col * 0.7::DOUBLE + 0.7, b.i + 1.3::DOUBLE) - greatest(s.col * 0.7::DOUBLE, b.i + 0.3::DOUBLE) AS wide
    FROM s JOIN x a ON abs(s.row * 0.7 + 0.35 - a.i - 0.8) < 0.9 JOIN x b ON abs(s.col * 0.7 + 0.35 - b.i - 0.8) < 0.9)
  SELECT r AS row, c AS col, round(sum(high * wide * value) / sum(high * wide), 4) AS value FROM c WHERE high > 1e-9 AND wide > 1e-9 GROUP BY r, c""")
def q78(spark: SparkSession, d: str) -> DataFrame:
    return grids.averaged(_whole(spark, d), FINE, COARSE).withColumn("value", F.round("value", 4))


_CUBE = "CASE WHEN abs({0}) <= 1 THEN (1.5::DOUBLE * abs({0}) - 2.5) * abs({0}) * abs({0}) + 1 WHEN abs({0}) < 2 THEN ((-0.5::DOUBLE * abs({0}) + 2.5) * abs({0}) - 4) * abs({0}) + 2 ELSE 0.0 END"


# the first grid's cells now have size 1 and the second's 0.7, shifted by 0.3; a centre lies in the cell of its whole part
@query("q78_grid_cubic", f"""WITH {_WHOLE}, x AS (SELECT i, 0.3::DOUBLE + (i + 0.5) * 0.7 AS at, CAST(floor(0.3::DOUBLE + (i + 0.5) * 0.7) AS BIGINT) AS home FROM (SELECT unnest(range(-2, 145)) AS i) q),
  f AS (SELECT a.i AS r, b.i AS c, a.at AS y, b.at AS x, a.home AS hr, b.home AS hc FROM s JOIN x a ON a.home = s.row JOIN x b ON b.home = s.col), o AS (SELECT unnest(range(-2, 3)) AS o),
  w AS (SELECT r, c, value, ({_CUBE.format("(y - 0.5 - s.row)")}) * ({_CUBE.format("(x - 0.5 - s.col)")}) AS w FROM f, o p, o q, s WHERE s.row = hr + p.o AND s.col = hc + q.o)
  SELECT r AS row, c AS col, round(sum(w * value) / sum(w), 2) AS value FROM w WHERE w <> 0 GROUP BY r, c""")
def q78_cubic(spark: SparkSession, d: str) -> DataFrame:
    return grids.cubic(_whole(spark, d), FINE._replace(size=1.0), COARSE._replace(size=0.7)).withColumn("value", F.round("value", 2))


@query("q79_peak_chips", f"""WITH {_PEAKS}, b AS (SELECT row * 2147483648 + col AS chip, greatest(row - 5, 0) AS row0, greatest(col - 5, 0) AS col0, row + 6 AS row1, col + 6 AS col1 FROM t),
  p AS (SELECT chip, row1 - row0 AS rows, col1 - col0 AS cols, unnest(range(row0, row1)) AS row, col0, col1 FROM b), q AS (SELECT chip, rows, cols, row, unnest(range(col0, col1)) AS col FROM p)
  SELECT chip, rows, cols, string_agg(printf('%02X', CASE WHEN value IS NULL THEN 128 ELSE CAST(floor(least(greatest(value / 50000, 0), 1) * 255) AS INTEGER) END), '' ORDER BY q.row, q.col) AS pixels
  FROM q LEFT JOIN s ON s.row = q.row AND s.col = q.col GROUP BY chip, rows, cols""")
def q79(spark: SparkSession, d: str) -> DataFrame:
    surface = inputs.surface(spark, d)
    at = grids.local_peaks(surface, RADIUS, size=32)
    low = lambda k: F.greatest(F.col(k) - 5, F.lit(0)).cast("long")
    boxes = at.select((F.col("row") * (1 << 31) + F.col("col")).alias("chip"), low("row").alias("row0"), low("col").alias("col0"), (F.col("row") + 6).alias("row1"), (F.col("col") + 6).alias("col1"))
    shade = surface.withColumn("value", raster.scaled_to_byte(F.col("value") / 50000))
    return grids.chips(shade, boxes).withColumn("pixels", F.hex("pixels"))
