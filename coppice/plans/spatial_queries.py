"""Queries over boxes, points, rasters and searches."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.nulls import holds
from ..functions.scalars import jaccard
from ..operators import aggregates, pairwise, raster, search, spatial
from ..operators.relational import running
from ..sources import files
from . import inputs
from .registry import query, table

_BOXES = "SELECT p_partkey AS id, p_type LIKE 'SMALL%' AS small, p_type LIKE 'LARGE%' AS large, CAST(p_size AS DOUBLE) AS minx, p_retailprice AS miny, CAST(p_size + p_partkey % 3 AS DOUBLE) AS maxx, p_retailprice + 2 AS maxy FROM part"


def boxes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").startswith("SMALL").alias("small"), F.col("p_type").startswith("LARGE").alias("large"), F.col("p_size").cast("double").alias("minx"), F.col("p_retailprice").alias("miny"), (F.col("p_size") + F.col("p_partkey") % 3).cast("double").alias("maxx"), (F.col("p_retailprice") + 2).alias("maxy"))


def _named(df: DataFrame, s: str) -> DataFrame:
    return df.select(F.col("id").alias(f"id{s}"), *[F.col(c).alias(f"{c}{s}") for c in spatial.BOX])


@query("q12_box_overlap_pairs", f"""WITH b AS ({_BOXES}) SELECT a.id AS id_1, c.id AS id_2, round(greatest(a.minx, c.minx), 4) AS minx, round(greatest(a.miny, c.miny), 4) AS miny, round(least(a.maxx, c.maxx), 4) AS maxx, round(least(a.maxy, c.maxy), 4) AS maxy
  FROM b a JOIN b c ON a.small AND c.large AND a.minx <= c.maxx AND c.minx <= a.maxx AND a.miny <= c.maxy AND c.miny <= a.maxy""")
def q12(spark: SparkSession, d: str) -> DataFrame:
    b = boxes(spark, d)
    names = [tuple(f"{c}{s}" for c in spatial.BOX) for s in ("_1", "_2")]
    common = [F.round(c, 4).alias(n) for c, n in zip(spatial.intersection(*[tuple(map(F.col, n)) for n in names]), spatial.BOX, strict=True)]
    return spatial.repeated_box_join(_named(b.where("small"), "_1"), _named(b.where("large"), "_2"), ("id_1", "id_2"), *names, cell=4.0, made=common)


@query("q15_box_within_join", f"""WITH b AS ({_BOXES}), p AS ({inputs.PTS}) SELECT p.id, b.id AS box_id FROM p JOIN b ON b.small AND abs(x) >= minx - 1.5 AND abs(x) <= maxx + 1.5 AND 900 + h * 4 >= miny - 1.5 AND 900 + h * 4 <= maxy + 1.5""")
def q15(spark: SparkSession, d: str) -> DataFrame:
    b = boxes(spark, d).where("small")
    wide = b.select(F.col("id").alias("box_id"), *spatial.buffered(tuple(map(F.col, spatial.BOX)), 1.5))
    p = inputs.points(spark, d).select("id", F.abs("x").alias("px"), (900 + F.col("h") * 4).alias("py")).withColumns({"qx": F.col("px"), "qy": F.col("py")})
    return spatial.box_join(p, wide, ("px", "py", "qx", "qy"), spatial.BOX, cell=4.0).select("id", "box_id")


@query("q18_triple_intersection", f"SELECT id, ds FROM ({inputs.PTS}) p WHERE x >= greatest(-20.0, -25.0, -12.0) AND x <= least(20.0, 14.0, 30.0) AND y >= greatest(-20.0, -8.0, -30.0) AND y <= least(20.0, 25.0, 11.0)")
def q18(spark: SparkSession, d: str) -> DataFrame:
    lit = lambda *v: tuple(F.lit(float(x)) for x in v)
    common = spatial.intersection(lit(-20, -20, 20, 20), lit(-25, -8, 14, 25), lit(-12, -30, 30, 11))
    p = inputs.points(spark, d)
    return p.where(spatial.contains(common, [F.col("x"), F.col("y"), F.col("x"), F.col("y")])).select("id", "ds")


@query("q22_raster_difference", f"WITH s AS ({inputs.DSM}), t AS ({inputs.DTM}) SELECT s.row, s.col, round(CASE WHEN t.value IS NULL OR s.value IS NULL THEN NULL ELSE greatest(s.value - t.value, 0) END, 6) AS value FROM s LEFT JOIN t ON s.row = t.row AND s.col = t.col")
def q22(spark: SparkSession, d: str) -> DataFrame:
    return raster.difference(inputs.surface(spark, d), inputs.terrain(spark, d)).withColumn("value", F.round("value", 6))


@query("q23_block_average", f"SELECT row // 4 AS row, col // 4 AS col, round(avg(value), 6) AS value FROM ({inputs.DSM}) s GROUP BY 1, 2")
def q23(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.block_average(inputs.surface(spark, d), 4).withColumn("value", F.round("value", 6))


_AT = "SELECT id, h, CAST(floor((100.0 - (y + 50.0)) / 2.0) AS BIGINT) AS row, CAST(floor((x + 50.0) / 2.0) AS BIGINT) AS col FROM ({}) p"


@query("q24_point_sample", f"WITH q AS ({_AT.format(inputs.PTS)}), s AS ({inputs.DSM}) SELECT q.id, s.value IS NOT NULL AS valid, round(q.h * 1000 - s.value, 6) AS above_ground FROM q LEFT JOIN s ON q.row = s.row AND q.col = s.col")
def q24(spark: SparkSession, d: str) -> DataFrame:
    cell = raster.cell_of(F.col("x") + 50.0, F.col("y") + 50.0, 0.0, 100.0, 2.0)
    p = inputs.points(spark, d).select("id", (F.col("h") * 1000).alias("z"), *cell)
    return raster.sampled(p, inputs.surface(spark, d)).select("id", "valid", F.round("above_ground", 6).alias("above_ground"))


_R = "0.2 * a.h + 0.5"


@query("q25_local_max", f"WITH p AS ({inputs.PTS}) SELECT ds, id FROM p a WHERE NOT EXISTS (SELECT 1 FROM p b WHERE b.ds = a.ds AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 0.0 * a.h * a.h + {_R} AND (b.h > a.h OR (b.h = a.h AND b.id < a.id)))")
def q25(spark: SparkSession, d: str) -> DataFrame:
    return pairwise.local_maxima(inputs.points(spark, d), 0.0, 0.2, 0.5).select("ds", "id")


@query("q26_tile_edge", f"""WITH s AS ({inputs.DSM}), t AS (SELECT unnest(generate_series(0, 9)) AS t) SELECT s.row, s.col, a.t AS tile_row, b.t AS tile_col FROM s JOIN t a ON s.row - a.t * 16 >= 2 AND s.row - a.t * 16 < 18 JOIN t b ON s.col - b.t * 16 >= 2 AND s.col - b.t * 16 < 18""")
def q26(spark: SparkSession, d: str) -> DataFrame:
    return raster.off_edge(raster.in_tiles(inputs.surface(spark, d), 20, 16), 20, 16).select("row", "col", "tile_row", "tile_col")


_NMS = f"""SELECT id % 4 AS ds, id, CAST(id * 7919 % 1000 AS DOUBLE) AS score, minx, miny / 10 AS miny, maxx + 3 AS maxx, maxy / 10 + 3 AS maxy FROM ({_BOXES}) b"""


# one box after another, against all that were kept before it
@query("q27_nms", f"""WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY ds ORDER BY score DESC, id DESC) AS n, struct_pack(id := id, score := score, x0 := minx, y0 := miny, x1 := maxx, y1 := maxy) AS box FROM ({_NMS}) q),
  r AS (SELECT ds, n, [box] AS kept FROM o WHERE n = 1 UNION ALL SELECT o.ds, o.n, CASE WHEN len(list_filter(r.kept, lambda k: greatest(least(k.x1, o.maxx) - greatest(k.x0, o.minx), 0) * greatest(least(k.y1, o.maxy) - greatest(k.y0, o.miny), 0)
    / nullif(least((k.x1 - k.x0) * (k.y1 - k.y0), (o.maxx - o.minx) * (o.maxy - o.miny)), 0) > 0.4)) = 0 THEN list_append(r.kept, o.box) ELSE r.kept END FROM r JOIN o ON o.ds = r.ds AND o.n = r.n + 1),
  e AS (SELECT ds, unnest(kept) AS k FROM (SELECT *, row_number() OVER (PARTITION BY ds ORDER BY n DESC) AS last FROM r) z WHERE last = 1) SELECT ds, k.id AS id, k.score AS score FROM e""")
def q27(spark: SparkSession, d: str) -> DataFrame:
    score = (F.col("id") * 7919 % 1000).cast("double").alias("score")
    b = boxes(spark, d).select((F.col("id") % 4).alias("ds"), "id", score, "minx", (F.col("miny") / 10).alias("miny"), (F.col("maxx") + 3).alias("maxx"), (F.col("maxy") / 10 + 3).alias("maxy"))
    return pairwise.suppressed(b, 0.4, cell=8.0).select("ds", "id", "score")


@query("q28_overstory", f"WITH p AS ({inputs.PTS}) SELECT ds, id FROM p a WHERE NOT EXISTS (SELECT 1 FROM p b WHERE b.ds = a.ds AND b.h > a.h AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) < (b.h - a.h) * 0.1 + 1.0)")
def q28(spark: SparkSession, d: str) -> DataFrame:
    return pairwise.overstory(inputs.points(spark, d)).select("ds", "id")


_EDGES = f"""SELECT a.ds, a.id AS left_id, b.id AS right_id, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS dist FROM ({inputs.PTS}) a JOIN ({inputs.PTS}) b ON a.ds = b.ds AND a.id % 2 = 0 AND b.id % 2 = 1
  AND b.h > a.h * 0.5 AND b.h < a.h * 1.5 AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) < a.h * 0.3 + 1.0"""


def _edges(spark: SparkSession, d: str) -> DataFrame:
    p = inputs.points(spark, d)
    return pairwise.candidate_pairs(p.where("id % 2 = 0"), p.where("id % 2 = 1"), slope=0.3)


@query("q29_candidate_pairs", f"SELECT ds, left_id, right_id, round(dist, 6) AS dist FROM ({_EDGES}) e")
def q29(spark: SparkSession, d: str) -> DataFrame:
    return _edges(spark, d).withColumn("dist", F.round("dist", 6))


# one edge after another, against the ends that are taken
@query("q30_greedy_match", f"""WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY ds ORDER BY dist, left_id, right_id) AS n FROM ({_EDGES}) e),
  r AS (SELECT ds, n, left_id, right_id, dist, true AS taken, [left_id] AS a, [right_id] AS b FROM o WHERE n = 1
    UNION ALL SELECT o.ds, o.n, o.left_id, o.right_id, o.dist, free, CASE WHEN free THEN list_append(r.a, o.left_id) ELSE r.a END, CASE WHEN free THEN list_append(r.b, o.right_id) ELSE r.b END
    FROM r JOIN o ON o.ds = r.ds AND o.n = r.n + 1, LATERAL (SELECT NOT list_contains(r.a, o.left_id) AND NOT list_contains(r.b, o.right_id) AS free) f)
  SELECT ds, left_id, right_id, round(dist, 6) AS dist FROM r WHERE taken""")
def q30(spark: SparkSession, d: str) -> DataFrame:
    return pairwise.greedy_match(_edges(spark, d)).withColumn("dist", F.round("dist", 6))


_MUTUAL = f"""WITH e AS ({_EDGES}), r AS (SELECT *, row_number() OVER (PARTITION BY ds, left_id ORDER BY dist, right_id) AS a, row_number() OVER (PARTITION BY ds, right_id ORDER BY dist, left_id) AS b FROM e)"""


@query("q31_mutual_best", f"{_MUTUAL} SELECT ds, left_id, right_id, round(dist, 6) AS dist FROM r WHERE a = 1 AND b = 1")
def q31(spark: SparkSession, d: str) -> DataFrame:
    return pairwise.mutual_best(_edges(spark, d)).withColumn("dist", F.round("dist", 6)).select("ds", "left_id", "right_id", "dist")


@query("q32_attribute_transfer", f"""{_MUTUAL}, m AS (SELECT * FROM r WHERE a = 1 AND b = 1), p AS ({inputs.PTS})
  SELECT d.ds, d.id AS left_id, m.right_id, round(d.h, 6) AS h_drone, round(f.h, 6) AS h_field FROM (SELECT * FROM p WHERE id % 2 = 0) d LEFT JOIN m ON d.ds = m.ds AND d.id = m.left_id LEFT JOIN p f ON f.ds = m.ds AND f.id = m.right_id""")
def q32(spark: SparkSession, d: str) -> DataFrame:
    p = inputs.points(spark, d).select("ds", "id", F.round("h", 6).alias("h"))
    out = pairwise.attributes_of_matches(p.where("id % 2 = 0"), pairwise.mutual_best(_edges(spark, d)), p.where("id % 2 = 1"), ("_drone", "_field"))
    return out.select("ds", "left_id", "right_id", "h_drone", "h_field")


@query("q36_translate", f"""SELECT id, round(x + CAST(ds AS DOUBLE) / 10, 6) AS x, round(y - CAST(ds AS DOUBLE) / 5, 6) AS y FROM ({inputs.PTS}) p""")
def q36(spark: SparkSession, d: str) -> DataFrame:
    p = inputs.points(spark, d)
    pair = F.struct(F.col("ds").cast("string").alias("key"), F.array(F.array(F.col("ds") / 10, -F.col("ds") / 5)).alias("value"))
    doc = p.where("ds is not null").select("ds").distinct().select(F.to_json(F.map_from_entries(F.array(pair))).alias("doc"))
    shifts = doc.select(files.json_rows(F.col("doc"), "array<array<double>>").alias("key", "shift"))
    shifts = shifts.select(F.col("key").cast("long").alias("ds"), F.col("shift")[0][0].alias("dx"), F.col("shift")[0][1].alias("dy"))
    moved = spatial.shifted(F.col("x"), F.col("y"), F.col("dx"), F.col("dy"))
    return p.join(shifts, "ds", "left").select("id", F.round(moved[0], 6).alias("x"), F.round(moved[1], 6).alias("y"))


@query("q39_bbox_dissolve", f"SELECT ds, round(min(x), 6) AS minx, round(min(y), 6) AS miny, round(max(x), 6) AS maxx, round(max(y), 6) AS maxy FROM ({inputs.PTS}) p GROUP BY ds HAVING max(x) - min(x) > 20 AND max(y) - min(y) > 20")
def q39(spark: SparkSession, d: str) -> DataFrame:
    out = aggregates.bounds(inputs.points(spark, d), ["ds"], ("x", "y", "x", "y"), 20)
    return out.select("ds", *[F.round(c, 6).alias(c) for c in spatial.BOX])


@query("q40_bbox_pad_clamp", f"""SELECT id, CAST(greatest(floor(minx - (maxx - minx) * 0.02), 0) AS BIGINT) AS px0, CAST(greatest(floor(miny - (maxy - miny) * 0.02), 0) AS BIGINT) AS py0,
  CAST(least(ceil(maxx + (maxx - minx) * 0.02), 45) AS BIGINT) AS px1, CAST(least(ceil(maxy + (maxy - miny) * 0.02), 1500) AS BIGINT) AS py1 FROM ({_BOXES}) b""")
def q40(spark: SparkSession, d: str) -> DataFrame:
    return boxes(spark, d).select("id", *spatial.padded_box(tuple(map(F.col, spatial.BOX)), 0.02, F.lit(45), F.lit(1500)))


def split_scores(trials: int) -> str:
    return f"""WITH i AS (SELECT plot, species, count(*) AS n FROM ({inputs.INV}) z GROUP BY 1, 2), w AS (SELECT s_suppkey AS plot, 1 + s_suppkey % 3 AS weight FROM supplier),
  t AS (SELECT unnest(range({trials})) AS trial), o AS (SELECT trial, plot, weight, sum(weight) OVER (PARTITION BY trial ORDER BY md5('35:' || trial || ':' || plot), plot ROWS UNBOUNDED PRECEDING) - weight AS before,
    row_number() OVER (PARTITION BY trial ORDER BY md5('35:' || trial || ':' || plot), plot) AS rn FROM t CROSS JOIN w),
  v AS (SELECT trial, plot FROM o WHERE before < (SELECT CAST(floor(sum(weight) * 0.2) AS BIGINT) FROM w) OR rn = 1),
  a AS (SELECT species, sum(n) AS n_all FROM i GROUP BY 1), s AS (SELECT trial, species, sum(n) AS nv FROM v JOIN i USING (plot) GROUP BY 1, 2),
  f AS (SELECT u.trial, a.species, coalesce(nv, 0) AS nv, n_all FROM (SELECT DISTINCT trial FROM v) u CROSS JOIN a LEFT JOIN s ON s.trial = u.trial AND s.species = a.species),
  g AS (SELECT trial, nv, nv / nullif(sum(nv) OVER (PARTITION BY trial), 0) - (n_all - nv) / nullif(sum(n_all - nv) OVER (PARTITION BY trial), 0) AS gap FROM f)"""


_SCORES = split_scores(200)


def _scores(spark: SparkSession, d: str) -> DataFrame:
    plots = table(spark, d, "supplier").select(F.col("s_suppkey").alias("plot"), (1 + F.col("s_suppkey") % 3).alias("weight"))
    counts = inputs.inventory(spark, d).groupBy("plot", "species").agg(F.count("*").alias("n"))
    return search.balanced_split(plots, counts, "plot", "weight", "species", "n")


@query("q44_balanced_split", _SCORES + " SELECT trial, round(sum(gap * gap), 9) AS score, CAST(sum(nv) AS BIGINT) AS n_val FROM g GROUP BY trial HAVING sum(gap * gap) IS NOT NULL")
def q44(spark: SparkSession, d: str) -> DataFrame:
    return _scores(spark, d)


@query("q44_best_split", _SCORES + " SELECT trial, round(sum(gap * gap), 9) AS score, CAST(sum(nv) AS BIGINT) AS n_val FROM g GROUP BY trial ORDER BY round(sum(gap * gap), 9), trial LIMIT 1")
def q44_best(spark: SparkSession, d: str) -> DataFrame:
    return search.best_trial(_scores(spark, d))


@query("q50_plot_centroids", f"""WITH u AS (SELECT 'test' AS type, ds AS plot FROM (SELECT DISTINCT ds FROM ({inputs.PTS}) z WHERE ds % 3 = 0) a UNION ALL SELECT 'train', ds FROM (SELECT DISTINCT ds FROM ({inputs.PTS}) z) b)
  SELECT u.type, u.plot, CASE WHEN u.type = 'test' THEN NULL ELSE u.plot * 2 END AS mission, round(avg(x), 6) AS cx, round(avg(y), 6) AS cy, round(min(x) - 10, 6) AS minx, round(max(y) + 10, 6) AS maxy FROM u LEFT JOIN ({inputs.PTS}) p ON p.ds = u.plot GROUP BY 1, 2""")
def q50(spark: SparkSession, d: str) -> DataFrame:
    p = inputs.points(spark, d)
    plots = p.select(F.col("ds").alias("plot")).distinct()
    test = plots.where("plot % 3 = 0").withColumn("type", F.lit("test"))
    both = test.unionByName(plots.withColumn("type", F.lit("train")).withColumn("mission", F.col("plot") * 2), allowMissingColumns=True)
    shape = p.groupBy(F.col("ds").alias("plot")).agg(F.round(F.avg("x"), 6).alias("cx"), F.round(F.avg("y"), 6).alias("cy"), F.round(F.min("x") - 10, 6).alias("minx"), F.round(F.max("y") + 10, 6).alias("maxy"))
    return both.join(shape, "plot", "left").select("type", "plot", "mission", "cx", "cy", "minx", "maxy")


@query("q53_schedule", "SELECT label, e AS epoch FROM (SELECT label, unnest(range(count(*))) AS e FROM embeddings GROUP BY label) q WHERE e >= 10 AND (e - 10) % 5 = 0")
def q53(spark: SparkSession, d: str) -> DataFrame:
    """Each label trains for as many epochs as it has vectors."""
    runs = table(spark, d, "embeddings").groupBy("label").agg(F.count("*").alias("epochs"))
    return search.schedule(runs, "epochs", 10, 5).select("label", "epoch")


@query("q53_parameter_grid", """SELECT label, CAST(r AS DOUBLE) AS ratio, CAST(w AS BIGINT) AS warm, CAST(i AS BIGINT) AS every, CAST(b AS BIGINT) AS sub, CAST(floor(CAST(r AS DOUBLE) * n) AS BIGINT) AS budget
  FROM (SELECT label, count(*) AS n FROM embeddings GROUP BY label) l, (SELECT unnest([0.05, 0.1, 0.2, 0.3, 0.5, 0.7]) AS r) a, (SELECT unnest([0, 10, 20, 50, 100, 200]) AS w) c, (SELECT unnest([1, 10, 25, 50]) AS i) e, (SELECT unnest([50, 100, 250]) AS b) f""")
def q53_grid(spark: SparkSession, d: str) -> DataFrame:
    """Every label's runs, with how many of its vectors each may take."""
    n = table(spark, d, "embeddings").groupBy("label").agg(F.count("*").alias("n"))
    grid = search.parameter_grid(spark, ratio=[0.05, 0.1, 0.2, 0.3, 0.5, 0.7], warm=[0, 10, 20, 50, 100, 200], every=[1, 10, 25, 50], sub=[50, 100, 250])
    return search.budgeted(n, grid, "n").select("label", "ratio", "warm", "every", "sub", "budget")


@query("q54_omp_select")
def q54(spark: SparkSession, d: str) -> DataFrame:
    columns = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return search.pursuit(columns, 12).withColumn("weight", F.round("weight", 6))


@query("q58_vector_sum", "SELECT CAST(i - 1 AS INTEGER) AS position, round(sum(CAST(embedding[i] AS DOUBLE)), 4) AS total FROM embeddings, (SELECT unnest(generate_series(1, 64)) AS i) s GROUP BY i")
def q58(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.vector_sum(table(spark, d, "embeddings"), "embedding").withColumn("total", F.round("total", 4))


_MASK = f"SELECT row, col, CASE WHEN value > 50000 THEN 1 + row // 10 % 2 ELSE 0 END AS id FROM ({inputs.DSM}) s"


def _mask(spark: SparkSession, d: str) -> DataFrame:
    band = 1 + F.floor(F.col("row") / 10) % 2
    return inputs.surface(spark, d).select("row", "col", F.when(holds(F.col("value") > 50000), band).otherwise(F.lit(0)).cast("long").alias("id"))


@query("q59_mask_components", f"""WITH RECURSIVE m AS MATERIALIZED (SELECT row, col, id, row * 2147483648 + col AS cell FROM ({_MASK}) q WHERE id <> 0),
  e AS MATERIALIZED (SELECT a.cell AS a, b.cell AS b FROM m a JOIN m b ON a.id = b.id AND abs(a.row - b.row) + abs(a.col - b.col) = 1), r AS (SELECT cell, cell AS reach FROM m UNION SELECT r.cell, e.b FROM r JOIN e ON r.reach = e.a),
  l AS (SELECT cell, min(reach) AS part FROM r GROUP BY cell) SELECT id, part, count(*) AS n_cells FROM m JOIN l ON l.cell = m.cell GROUP BY id, part""")
def q59(spark: SparkSession, d: str) -> DataFrame:
    return raster.components(_mask(spark, d)).groupBy("id", "part").agg(F.count("*").alias("n_cells"))


# the shoelace sum of all rings (holes turn the other way) is the number of cells; sides are counted cell by cell
@query("q71_mask_outlines", f"""WITH RECURSIVE m AS MATERIALIZED (SELECT row, col, id, row * 2147483648 + col AS cell FROM ({_MASK}) q WHERE id <> 0),
  e AS MATERIALIZED (SELECT a.cell AS a, b.cell AS b FROM m a JOIN m b ON a.id = b.id AND abs(a.row - b.row) + abs(a.col - b.col) = 1), r AS (SELECT cell, cell AS reach FROM m UNION SELECT r.cell, e.b FROM r JOIN e ON r.reach = e.a),
  l AS (SELECT cell, min(reach) AS part FROM r GROUP BY cell), n AS (SELECT a, count(*) AS beside FROM e GROUP BY a)
  SELECT id, part, count(*) AS n_cells, CAST(count(*) AS DOUBLE) AS area, CAST(sum(4 - coalesce(beside, 0)) AS DOUBLE) AS sides FROM m JOIN l ON l.cell = m.cell LEFT JOIN n ON n.a = m.cell GROUP BY id, part""")
def q71(spark: SparkSession, d: str) -> DataFrame:
    polygons = raster.outlines(raster.components(_mask(spark, d)))
    total = lambda f: F.aggregate(F.transform("rings", f), F.lit(0.0), lambda a, b: a + b)
    return polygons.select("id", "part", "n_cells", total(spatial.signed_area).alias("area"), total(spatial.perimeter).alias("sides"))


@query("q60_nearest_marker", f"""WITH p AS ({inputs.PTS}), e AS (SELECT a.ds, a.id, b.id AS marker_id, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS dist FROM p a JOIN p b ON a.ds = b.ds AND a.id % 5 <> 0 AND b.id % 5 = 0),
  r AS (SELECT *, row_number() OVER (PARTITION BY ds, id ORDER BY dist, marker_id) AS n FROM e WHERE dist <= 15.0) SELECT ds, id, marker_id, round(dist, 6) AS dist FROM r WHERE n = 1""")
def q60(spark: SparkSession, d: str) -> DataFrame:
    p = inputs.points(spark, d)
    return pairwise.nearest_marker(p.where("id % 5 != 0"), p.where("id % 5 = 0"), 15.0).withColumn("dist", F.round("dist", 6))


_CUBIC = "CASE WHEN abs({0}) <= 1 THEN (1.5 * abs({0}) - 2.5) * abs({0}) * abs({0}) + 1 WHEN abs({0}) < 2 THEN ((-0.5 * abs({0}) + 2.5) * abs({0}) - 4) * abs({0}) + 2 ELSE 0.0 END"


@query("q61_refined_raster", f"""WITH s AS MATERIALIZED (SELECT row, col, floor(value) AS value FROM ({inputs.DSM}) q), k AS (SELECT unnest(range(3)) AS i), n AS (SELECT unnest(range(-2, 3)) AS o),
  f AS (SELECT s.row * 3 + a.i AS row, s.col * 3 + b.i AS col, s.row AS r, s.col AS c, (a.i + 0.5) / 3 - 0.5 AS y, (b.i + 0.5) / 3 - 0.5 AS x FROM s, k a, k b WHERE value IS NOT NULL),
  g AS (SELECT f.row, f.col, s.value, ({_CUBIC.format('(y - p.o)')}) * ({_CUBIC.format('(x - q.o)')}) AS w FROM f, n p, n q, s WHERE s.row = f.r + p.o AND s.col = f.c + q.o AND s.value IS NOT NULL)
  SELECT row, col, round(sum(w * value) / sum(w), 4) AS value FROM g WHERE w <> 0 GROUP BY row, col""")
def q61(spark: SparkSession, d: str) -> DataFrame:
    # of whole heights: sums in another order differ in the ninth digit, which means of prices would turn into another last digit
    whole = inputs.surface(spark, d).withColumn("value", F.floor("value").cast("double"))
    return raster.refined(whole, 3).withColumn("value", F.round("value", 4))


# a triangle that no cell centre touches
_TRIANGLE = ((10.25, 10.25), (90.25, 20.25), (40.25, 85.25))


def _side(a: tuple, b: tuple) -> str:
    return f"({b[0]} - {a[0]}) * (row + 0.5 - {a[1]}) - ({b[1]} - {a[1]}) * (col + 0.5 - {a[0]}) > 0"


_INSIDE = " AND ".join(_side(a, b) for a, b in zip(_TRIANGLE, _TRIANGLE[1:] + _TRIANGLE[:1], strict=True))


@query("q62_ring_mask", f"SELECT row, col, {_INSIDE} AS inside, CASE WHEN {_INSIDE} THEN round(value, 6) ELSE 128.0::DOUBLE END AS value, CAST(floor(least(greatest(value / 50000, 0), 1) * 255) AS INTEGER) AS shade FROM ({inputs.DSM}) s")
def q62(spark: SparkSession, d: str) -> DataFrame:
    ring = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in _TRIANGLE])
    shade = raster.scaled_to_byte(F.col("value") / 50000)
    out = raster.masked(inputs.surface(spark, d).withColumn("shade", shade), ring)
    return out.select("row", "col", "inside", F.round("value", 6).alias("value"), "shade")


@query("q63_selection_overlap", """WITH e AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY abs(CAST(embedding[1] AS DOUBLE)) DESC, vec_id) AS a, row_number() OVER (PARTITION BY label ORDER BY abs(CAST(embedding[2] AS DOUBLE)) DESC, vec_id) AS b FROM embeddings)
  SELECT label, round(count_if(a <= 10 AND b <= 10) / count_if(a <= 10 OR b <= 10), 6) AS jaccard FROM e GROUP BY label""")
def q63(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    first = lambda i, s: running(e.select("label", "vec_id", F.abs(F.col("embedding")[i].cast("double")).alias("x")), ["label"], [-F.col("x"), F.col("vec_id")]).where("_rank <= 10").select("label", "vec_id", F.lit(s).alias("of"))
    both = first(0, "a").unionByName(first(1, "b"))
    sets = both.groupBy("label").agg(*[F.collect_list(F.when(F.col("of") == c, F.col("vec_id"))).alias(c) for c in "ab"])
    return sets.select("label", F.round(jaccard(F.col("a"), F.col("b")), 6).alias("jaccard"))
