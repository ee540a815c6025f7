"""Queries over scans, recodes, filters, joins, aggregates, windows and sets."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import classify, nulls, scalars
from ..operators import aggregates, relational
from ..sources import files, sinks
from . import chips, inputs, species
from .registry import query, table

LEVELS = ["l1", "l2", "l3", "l4"]
CODES = species.codes()
CODE_SQL = "[" + ", ".join(f"'{c}'" for c in CODES) + "]"


def _case(column: str, values: dict[str, str], other: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items()) + f" ELSE {other} END"


@query("q01_species_counts", f"SELECT species, count(*) AS n_trees, count(DISTINCT plot) AS n_plots FROM ({inputs.INV}) i WHERE plot IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) GROUP BY species")
def q01(spark: SparkSession, d: str) -> DataFrame:
    plots = table(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("plot"))
    return aggregates.counts_per_group(relational.with_keys(inputs.inventory(spark, d), plots, ["plot"]), "species", "plot", ("n_trees", "n_plots"))


def _coded(spark: SparkSession, d: str) -> DataFrame:
    codes = F.array(*[F.lit(c) for c in CODES])
    return table(spark, d, "part").select("p_partkey", F.element_at(codes, (F.col("p_partkey") % len(CODES) + 1).cast("int")).alias("code"), "p_size")


_CODED = f"SELECT p_partkey, {CODE_SQL}[CAST(p_partkey % {len(CODES)} + 1 AS INTEGER)] AS code, p_size FROM part"


@query(
    "q02_crosswalk_levels",
    f"SELECT code, count(*) AS n_trees, {', '.join('code IN (' + ', '.join(repr(c) for c in p) + f') AS primary_l{k}' for k, p in enumerate(species.primary(), 1))}, "
    f"{', '.join(_case('code', m, 'code') + f' AS code_l{k}' for k, m in enumerate(species.mappings(), 1))} FROM ({_CODED}) c GROUP BY code",
)
def q02(spark: SparkSession, d: str) -> DataFrame:
    counts = _coded(spark, d).groupBy("code").agg(F.count("*").alias("n_trees"))
    return counts.select("code", "n_trees", *species.crosswalk(F.col("code")))


_BRANDS = {"Brand#11": "a", "Brand#12": "a", "Brand#21": "b", "Brand#22": "b", "Brand#33": "c"}


@query("q03_lookup_map", f"SELECT p_partkey, {_case('p_brand', _BRANDS, 'NULL')} AS class FROM part")
def q03(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", scalars.lookup(F.col("p_brand"), _BRANDS).alias("class"))


_SUMMARY = """WITH q AS (SELECT l_suppkey, l_extendedprice AS v, l_quantity AS g FROM lineitem),
  p AS (SELECT l_suppkey, quantile_cont(v, 0.05) AS lo, quantile_cont(v, 0.95) AS hi FROM q GROUP BY 1)
  SELECT q.l_suppkey AS mission_id, round(avg(v), 4) AS mean_altitude, round(stddev_pop(v) / avg(v), 6) AS cv_altitude, round(corr(g, v), 6) AS terrain_correlation,
  round(stddev_pop(CASE WHEN v BETWEEN lo AND hi THEN v END), 4) AS sd_trimmed FROM q JOIN p ON q.l_suppkey = p.l_suppkey GROUP BY 1"""


def _summary(spark: SparkSession, d: str) -> DataFrame:
    out = aggregates.altitude_summary(table(spark, d, "lineitem"), ["l_suppkey"], F.col("l_extendedprice"), F.col("l_quantity"))
    return out.select(F.col("l_suppkey").alias("mission_id"), F.round("mean_altitude", 4).alias("mean_altitude"), F.round("cv_altitude", 6).alias("cv_altitude"), F.round("terrain_correlation", 6).alias("terrain_correlation"), F.round("sd_trimmed", 4).alias("sd_trimmed"))


@query("q04_altitude_summary", _SUMMARY)
def q04(spark: SparkSession, d: str) -> DataFrame:
    return _summary(spark, d)


@query("q05_altitude_gate", "SELECT l_suppkey, count(*) AS n_rows, CAST(count_if(l_discount < 0.095) AS BIGINT) AS n_valid, round(count_if(l_discount < 0.095) / count(*), 6) AS share, count_if(l_discount < 0.095) / count(*) >= 0.9 AS passed FROM lineitem GROUP BY l_suppkey")
def q05(spark: SparkSession, d: str) -> DataFrame:
    return classify.valid_share(table(spark, d, "lineitem"), "l_suppkey", F.col("l_discount") < 0.095).withColumn("share", F.round("share", 6))


@query("q06_summary_left_join", f"SELECT s_suppkey AS mission_id, s_name, mean_altitude, cv_altitude FROM supplier LEFT JOIN (SELECT * FROM ({_SUMMARY}) z WHERE terrain_correlation > 0) y ON s_suppkey = mission_id")
def q06(spark: SparkSession, d: str) -> DataFrame:
    summary = _summary(spark, d).where("terrain_correlation > 0").select("mission_id", "mean_altitude", "cv_altitude")
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("mission_id"), "s_name").join(summary, "mission_id", "left")


@query("q07_first_row_per_file", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS rn FROM lineitem) q WHERE rn = 1")
def q07(spark: SparkSession, d: str) -> DataFrame:
    order = [F.col(c) for c in ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")]
    return relational.first_per_key(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"), ["l_orderkey"], order).select("l_orderkey", "l_linenumber", "l_extendedprice")


@query("q08_classify_ladder", f"SELECT k, {inputs.LADDER} AS kind FROM ({inputs.MISSIONS}) m")
def q08(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    return inputs.missions(spark, d).select("k", classify.flight_class(c("alt"), c("pitch"), c("corr"), c("sd"), c("front"), c("side")).alias("kind"))


@query("q09_min_of_list", "SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN NULL WHEN p_partkey % 5 = 1 THEN CAST(p_size AS DOUBLE) ELSE CAST(least(p_size, p_partkey % 60) AS DOUBLE) END AS overlap FROM part")
def q09(spark: SparkSession, d: str) -> DataFrame:
    size, other = F.col("p_size").cast("string"), (F.col("p_partkey") % 60).cast("string")
    cell = F.when(F.col("p_partkey") % 5 == 0, F.lit(None)).when(F.col("p_partkey") % 5 == 1, size).otherwise(F.concat(size, F.lit(", "), other))
    return table(spark, d, "part").select("p_partkey", scalars.least_of_list(cell).alias("overlap"))


@query("q10_numeric_coerce", """SELECT event_id, TRY_CAST(CASE WHEN event_id % 4 = 0 THEN 'n/a' WHEN event_id % 4 = 1 THEN '' ELSE CAST(user_id AS VARCHAR) || '.5' END AS DOUBLE) AS parsed FROM events""")
def q10(spark: SparkSession, d: str) -> DataFrame:
    text = F.when(F.col("event_id") % 4 == 0, F.lit("n/a")).when(F.col("event_id") % 4 == 1, F.lit("")).otherwise(F.concat(F.col("user_id").cast("string"), F.lit(".5")))
    return table(spark, d, "events").select("event_id", scalars.to_number(text).alias("parsed"))


@query("q11_partial_dates", "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN year(o_orderdate) || '-07-01' WHEN 1 THEN strftime(o_orderdate, '%Y-%m-01') WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%d') END AS surveyed FROM orders")
def q11(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey") % 4
    text = F.when(k == 0, F.date_format("o_orderdate", "yyyy")).when(k == 1, F.date_format("o_orderdate", "yyyyMM")).when(k == 2, F.date_format("o_orderdate", "yyyyMMdd")).otherwise(F.date_format("o_orderdate", "yyyyM").substr(1, 5))
    return table(spark, d, "orders").select("o_orderkey", scalars.partial_date(text).cast("string").alias("surveyed"))


_PAIR_SQL = "SELECT a.o_custkey AS cust, a.o_orderkey AS k1, b.o_orderkey AS k2 FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey"


@query("q13_same_year_pairs_forced", f"{_PAIR_SQL} WHERE year(a.o_orderdate) = year(b.o_orderdate) UNION ALL {_PAIR_SQL} WHERE a.o_custkey = 7")
def q13(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.year("o_orderdate").alias("y"))
    a, b = orders.alias("a"), orders.alias("b")
    pair = [F.col("a.o_custkey").alias("cust"), F.col("a.o_orderkey").alias("k1"), F.col("b.o_orderkey").alias("k2")]
    rising = F.col("a.o_orderkey") < F.col("b.o_orderkey")
    same = a.join(b, (F.col("a.o_custkey") == F.col("b.o_custkey")) & (F.col("a.y") == F.col("b.y")) & rising).select(*pair)
    forced = a.where("o_custkey = 7").join(b.where("o_custkey = 7"), (F.col("a.o_custkey") == F.col("b.o_custkey")) & rising).select(*pair)
    return same.unionByName(forced)


@query("q14_pair_date_diff", "SELECT l_orderkey, l_linenumber, l_partkey, CAST(floor(abs(epoch_us(l_shipdate) - epoch_us(o_orderdate)) / 86400000000.0) AS BIGINT) AS days FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def q14(spark: SparkSession, d: str) -> DataFrame:
    lines, orders = table(spark, d, "lineitem"), table(spark, d, "orders")
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).select("l_orderkey", "l_linenumber", "l_partkey", scalars.elapsed_days(F.col("l_shipdate"), F.col("o_orderdate")).alias("days"))


@query("q16_year_diff_override", """SELECT c_custkey, o_orderkey, CAST(abs(1993 + c_custkey % 9 - year(o_orderdate)) AS BIGINT) AS year_diff FROM customer JOIN orders ON c_custkey = o_custkey
  WHERE c_mktsegment = 'BUILDING' OR abs(1993 + c_custkey % 9 - year(o_orderdate)) <= 2""")
def q16(spark: SparkSession, d: str) -> DataFrame:
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    diff = F.abs(1993 + F.col("c_custkey") % 9 - F.year("o_orderdate")).cast("long")
    return c.join(o, c.c_custkey == o.o_custkey).withColumn("year_diff", diff).where((F.col("c_mktsegment") == "BUILDING") | (F.col("year_diff") <= 2)).select("c_custkey", "o_orderkey", "year_diff")


@query("q17_best_match_dedupe", """SELECT l_partkey, l_suppkey, l_discount, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_discount, l_extendedprice, l_suppkey DESC) AS rn FROM lineitem) q WHERE rn = 1""")
def q17(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_discount", "l_extendedprice")
    return relational.first_per_key(rows, ["l_partkey"], [F.col("l_discount"), F.col("l_extendedprice"), -F.col("l_suppkey")])


@query("q19_join_diff_keys_mean", "SELECT c_nationkey, round(avg(CASE WHEN o_totalprice > 50000 THEN o_totalprice END), 4) AS mean_agl, count(*) AS n_images FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def q19(spark: SparkSession, d: str) -> DataFrame:
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    valid = F.when(F.col("o_totalprice") > 50000, F.col("o_totalprice"))
    return c.join(o, c.c_custkey == o.o_custkey).groupBy("c_nationkey").agg(F.round(F.avg(valid), 4).alias("mean_agl"), F.count("*").alias("n_images"))


@query("q20_exactly_one_match", """WITH k AS (SELECT *, count(*) OVER (PARTITION BY o_custkey, year(o_orderdate), o_orderstatus) AS n FROM orders)
  SELECT o_custkey, o_orderkey, round(o_totalprice - c_acctbal, 4) AS altitude_offset, '{"project":{"name":"' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') || '","altitude_offset":' || CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) || '}}' AS override FROM k JOIN customer ON o_custkey = c_custkey WHERE n = 1""")
def q20(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").withColumn("y", F.year("o_orderdate"))
    rows = classify.only_match(o, ["o_custkey", "y", "o_orderstatus"]).join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    document = sinks.override_document(F.floor("o_totalprice"), scalars.padded(F.col("o_custkey"), 9), {})
    return rows.select("o_custkey", "o_orderkey", F.round(F.col("o_totalprice") - F.col("c_acctbal"), 4).alias("altitude_offset"), document.alias("override"))


@query("q21_composite_key_parse", """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE ltrim(CAST(l_partkey AS VARCHAR), '0') END AS plot, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE printf('%06d', l_suppkey) END AS hn, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE CAST(l_linenumber AS VARCHAR) END AS lo FROM lineitem""")
def q21(spark: SparkSession, d: str) -> DataFrame:
    parts = [scalars.padded(F.col("l_partkey"), 4), scalars.padded(F.col("l_suppkey"), 6), scalars.padded(F.col("l_linenumber"), 6)]
    key = F.when(F.col("l_linenumber") % 3 == 0, F.concat_ws("_", *parts[:2])).otherwise(F.concat_ws("_", *parts))
    plot, hn, lo = scalars.key_parts(F.col("key"), ["plot", "hn", "lo"])
    return table(spark, d, "lineitem").withColumn("key", key).select("l_orderkey", "l_linenumber", "l_partkey", scalars.unpadded(plot).alias("plot"), hn, scalars.unpadded(lo).alias("lo"))


@query("q33_null_safe_filters", """WITH q AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_quantity > 40 THEN NULL ELSE l_quantity END AS decay, nullif(l_returnflag, 'N') AS live FROM lineitem)
  SELECT l_orderkey, l_linenumber, l_partkey, decay, live FROM q WHERE NOT coalesce(decay > 2, false) AND live IS DISTINCT FROM 'R' AND (live IS NULL OR live NOT IN ('X'))""")
def q33(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.when(F.col("l_quantity") <= 40, F.col("l_quantity")).alias("decay"), F.nullif("l_returnflag", F.lit("N")).alias("live"))
    withheld = spark.createDataFrame([("X",)], "live string")
    return relational.without_keys(q.where(nulls.not_greater(F.col("decay"), 2) & nulls.differs(F.col("live"), "R")), F.broadcast(withheld), ["live"])


_GROW = "CASE WHEN d > 0 THEN 1.3 + exp(-0.3136489123372108 + 0.84623571 * ln(CASE WHEN d > 0 THEN d END)) WHEN d = 0 THEN 1.3 END"


@query("q34_height_imputation", f"""WITH q AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN CAST(p_size AS DOUBLE) END AS h, CASE WHEN p_partkey % 5 = 0 THEN CAST(p_size AS DOUBLE) / 2 END AS a, CASE WHEN p_partkey % 7 <> 0 THEN CAST(p_partkey % 50 AS DOUBLE) END AS d FROM part)
  SELECT p_partkey, round(coalesce(h, {_GROW}), 6) AS observed, round(coalesce(h, a, {_GROW}), 6) AS intended FROM q WHERE coalesce(h, a, {_GROW}) IS NOT NULL""")
def q34(spark: SparkSession, d: str) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size").cast("double")
    q = table(spark, d, "part").select(k, F.when(k % 3 == 0, size).alias("h"), F.when(k % 5 == 0, size / 2).alias("a"), F.when(k % 7 != 0, (k % 50).cast("double")).alias("d"))
    both = q.select("p_partkey", F.round(scalars.completed_height(F.col("h"), F.col("d")), 6).alias("observed"), F.round(scalars.completed_height(F.col("h"), F.col("d"), F.col("a")), 6).alias("intended"))
    return both.where("intended is not null")


@query("q35_dataset_gate", """WITH q AS (SELECT o_custkey AS dataset, o_orderkey FROM orders WHERE o_orderpriority IN (SELECT DISTINCT o_orderpriority FROM orders WHERE o_orderpriority LIKE '3%' OR o_orderpriority LIKE '4%') AND o_custkey NOT IN (1, 2, 3))
  SELECT dataset, o_orderkey FROM q WHERE dataset IN (SELECT dataset FROM q GROUP BY dataset HAVING count(*) >= 5)""")
def q35(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").where(F.col("o_orderpriority").rlike("^[34]") & ~F.col("o_custkey").isin(1, 2, 3))
    return sinks.big_enough(rows.select(F.col("o_custkey").alias("dataset"), "o_orderkey"), "dataset", 5)


@query("q37_enumerate_ids", "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS id, row_number() OVER (ORDER BY o_orderkey) AS global_id FROM orders")
def q37(spark: SparkSession, d: str) -> DataFrame:
    rows = relational.enumerated(table(spark, d, "orders").select("o_custkey", "o_orderkey"), [F.col("o_orderkey")], "global_id")
    return sinks.numbered(rows, "o_custkey", [F.col("o_orderkey")])


@query("q38_frac_of_group_max", "SELECT l_orderkey, l_linenumber, l_extendedprice, group_max FROM (SELECT *, max(l_extendedprice) OVER (PARTITION BY l_orderkey) AS group_max FROM lineitem) q WHERE l_extendedprice > 0.5 * group_max")
def q38(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.above_group_share(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice"), "l_orderkey", "l_extendedprice")


@query("q41_levels_and_counters", f"""WITH c AS ({_CODED}), m AS (SELECT *, {', '.join(_case('code', m, 'code') + f' AS l{k}' for k, m in enumerate(species.mappings(), 1))}, code IN ({', '.join(repr(c) for c in species.primary()[3])}) AS labelled FROM c)
  SELECT l4, CAST(count_if(labelled) AS BIGINT) AS n_labelled, CAST(count_if(NOT labelled) AS BIGINT) AS n_unlabelled, count(DISTINCT l1) AS n_l1, count(DISTINCT l2) AS n_l2, count(DISTINCT l3) AS n_l3 FROM m GROUP BY l4""")
def q41(spark: SparkSession, d: str) -> DataFrame:
    names = spark.createDataFrame([(c, *(m.get(c, c) for m in species.mappings()), c in species.primary()[3]) for c in CODES], "code string, l1 string, l2 string, l3 string, l4 string, labelled boolean")
    rows = _coded(spark, d).join(F.broadcast(names), "code", "left")
    return rows.groupBy("l4").agg(F.count_if("labelled").alias("n_labelled"), F.count_if(~F.col("labelled")).alias("n_unlabelled"), *[F.countDistinct(x).alias(f"n_{x}") for x in LEVELS[:3]])


@query("q42_withheld_anti", "SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal < 0)")
def q42(spark: SparkSession, d: str) -> DataFrame:
    withheld = table(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return relational.without_keys(table(spark, d, "orders").select("o_orderkey", "o_custkey"), withheld, ["o_custkey"])


_BRAND_NAMES = [f"Brand#{i}{j}" for i in range(1, 6) for j in range(1, 6)]
_W = "CASE WHEN s_suppkey % 4 = 0 THEN 3 ELSE 1 END"


@query("q43_weighted_pivot", "SELECT s_suppkey AS plot, " + ", ".join(f'CAST(coalesce(sum(CASE WHEN species = \'{b}\' THEN 1 ELSE 0 END), 0) * {_W} AS BIGINT) AS "{b}"' for b in _BRAND_NAMES) + f" FROM supplier LEFT JOIN ({inputs.INV}) i ON plot = s_suppkey GROUP BY s_suppkey")
def q43(spark: SparkSession, d: str) -> DataFrame:
    plots = table(spark, d, "supplier").select(F.col("s_suppkey").alias("plot"), F.when(F.col("s_suppkey") % 4 == 0, 3).otherwise(1).alias("w"))
    return aggregates.weighted_pivot(inputs.inventory(spark, d), plots, "plot", "species", _BRAND_NAMES, "w")


_REPORT = f"""WITH c AS (SELECT species, sum(CASE WHEN plot % 5 <> 0 THEN 1 ELSE 0 END) AS train, sum(CASE WHEN plot % 5 = 0 THEN 1 ELSE 0 END) AS val FROM ({inputs.INV}) i GROUP BY species),
  p AS (SELECT species, CAST(train AS BIGINT) AS train, CAST(val AS BIGINT) AS val, train / sum(train) OVER () AS tp, val / sum(val) OVER () AS vp FROM c)"""


@query("q45_split_report", _REPORT + " SELECT species, train, val, round(tp, 3) AS train_prop, round(vp, 3) AS val_prop, round(abs(tp - vp), 3) AS diff, train + val AS total FROM p")
def q45(spark: SparkSession, d: str) -> DataFrame:
    counts = inputs.inventory(spark, d).groupBy("species", F.when(F.col("plot") % 5 == 0, "val").otherwise("train").alias("split")).agg(F.count("*").alias("n"))
    return aggregates.split_report(counts, "species", "split", "n")


@query("q45_split_gap", _REPORT + """, r AS (SELECT species, train, val, tp, vp, round(abs(tp - vp), 3) AS diff FROM p), t AS (SELECT CAST(sum(train + val) AS BIGINT) AS total FROM r)
  SELECT round(sum((tp - vp) * (tp - vp)), 9) AS balance, max(diff) AS max_diff, (SELECT species FROM r ORDER BY diff DESC, species LIMIT 1) AS max_key, round(avg(diff), 6) AS mean_diff, any_value(total) AS total, format('{:,}', any_value(total)) || ' trees' AS text FROM r, t""")
def q45_gap(spark: SparkSession, d: str) -> DataFrame:
    counts = inputs.inventory(spark, d).groupBy("species", F.when(F.col("plot") % 5 == 0, "val").otherwise("train").alias("split")).agg(F.count("*").alias("n"))
    out = aggregates.split_gap(aggregates.split_report(counts, "species", "split", "n"), "species")
    return out.withColumn("balance", F.round("balance", 9)).withColumn("mean_diff", F.round("mean_diff", 6))


@query("q46_unmatched", f"""SELECT split, count(*) AS n_rows, count(DISTINCT plot) AS n_keys FROM ({inputs.INV}) i LEFT JOIN (SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN 'val' ELSE 'train' END AS split FROM supplier WHERE s_acctbal > 0) s ON s_suppkey = plot GROUP BY split""")
def q46_unmatched(spark: SparkSession, d: str) -> DataFrame:
    splits = table(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("plot"), F.when(F.col("s_suppkey") % 5 == 0, "val").otherwise("train").alias("split"))
    return aggregates.unmatched(inputs.inventory(spark, d), splits, "plot", "split")


@query("q72_label_index", "SELECT p_partkey, p_brand, dense_rank() OVER (ORDER BY p_brand) - 1 AS label FROM part")
def q72(spark: SparkSession, d: str) -> DataFrame:
    return relational.label_index(table(spark, d, "part").select("p_partkey", "p_brand"), "p_brand", "label")


@query("q46_split_consistency", """WITH s AS (SELECT l_suppkey AS plot, CASE WHEN l_suppkey % 5 = 0 THEN CASE l_linenumber % 2 WHEN 0 THEN 'val' ELSE 'train' END WHEN l_suppkey % 5 = 1 THEN NULL ELSE 'train' END AS split FROM lineitem)
  SELECT plot, count(DISTINCT split) AS n_values FROM s GROUP BY plot HAVING count(DISTINCT split) > 1""")
def q46(spark: SparkSession, d: str) -> DataFrame:
    plot = F.col("l_suppkey")
    split = F.when(plot % 5 == 0, F.when(F.col("l_linenumber") % 2 == 0, "val").otherwise("train")).when(plot % 5 != 1, "train")
    return aggregates.inconsistent(table(spark, d, "lineitem").select(plot.alias("plot"), split.alias("split")), "plot", "split")


@query("q47_set_algebra", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE year(o_orderdate) <= 1996) AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def q47(spark: SparkSession, d: str) -> DataFrame:
    o, key = table(spark, d, "orders"), F.col("o_custkey").alias("c_custkey")
    return relational.remainder(table(spark, d, "customer").select("c_custkey"), o.where(F.year("o_orderdate") <= 1996).select(key), o.where("o_orderstatus = 'P'").select(key))


@query("q48_split_composition", _REPORT + " SELECT 'train' AS split, species, round(tp, 6) AS prop FROM p UNION ALL SELECT 'val', species, round(vp, 6) FROM p")
def q48(spark: SparkSession, d: str) -> DataFrame:
    counts = inputs.inventory(spark, d).groupBy(F.when(F.col("plot") % 5 == 0, "val").otherwise("train").alias("split"), "species").agg(F.count("*").alias("n"))
    return counts.select("split", "species", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("split")), 6).alias("prop"))


@query("q49_majority_vote", "SELECT doc_id % 150 AS tree, CASE WHEN count_if(quality = 1) > count_if(quality = 0) THEN 'Live' ELSE 'Dead' END AS status FROM labels GROUP BY 1")
def q49(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.majority(table(spark, d, "labels").select((F.col("doc_id") % 150).alias("tree"), "quality"), "tree", "quality", "Live", "Dead")


@query("q51_class_manifest", """WITH m AS (SELECT CASE WHEN l_suppkey % 5 = 0 THEN 'val' WHEN l_suppkey % 5 = 1 THEN 'test' ELSE 'train' END AS split, l_returnflag AS class, CASE WHEN l_linenumber < 5 THEN '/new/' || l_orderkey || '/' || l_partkey || '.png' END AS source,
  CASE WHEN l_suppkey % 5 = 0 THEN 'val' WHEN l_suppkey % 5 = 1 THEN 'test' ELSE 'train' END || '/' || l_returnflag || '/' || l_partkey || '.png' AS target FROM lineitem) SELECT split, class, count(*) AS n_files, count(source) AS n_moved, count(DISTINCT target) AS n_targets, min(target) AS first_target FROM m GROUP BY split, class""")
def q51(spark: SparkSession, d: str) -> DataFrame:
    plot = F.col("l_suppkey")
    old = F.concat(F.when(F.col("l_linenumber") < 5, F.lit("/old/")).otherwise(F.lit("/elsewhere/")), F.col("l_orderkey").cast("string"), F.lit("/"), F.col("l_partkey").cast("string"), F.lit(".png"))
    rows = table(spark, d, "lineitem").select(F.when(plot % 5 == 0, "val").when(plot % 5 == 1, "test").otherwise("train").alias("split"), F.col("l_returnflag").alias("class"), old.alias("path"))
    listed = sinks.manifest(rows, "path", "/old/", "/new/", ["split", "class"])
    return listed.groupBy("split", "class").agg(F.count("*").alias("n_files"), F.count("source").alias("n_moved"), F.countDistinct("target").alias("n_targets"), F.min("target").alias("first_target"))


@query("q52_chunk_ids", "SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 250 AS batch_id, ((row_number() OVER (ORDER BY o_orderkey) - 1) % 250) // 32 AS sub_id FROM orders")
def q52(spark: SparkSession, d: str) -> DataFrame:
    return relational.chunked(table(spark, d, "orders").select("o_orderkey"), [F.col("o_orderkey")], 250, 32)


@query("q55_topk_abs", "SELECT c_custkey, c_acctbal FROM customer ORDER BY abs(c_acctbal) DESC, c_custkey LIMIT 20")
def q55(spark: SparkSession, d: str) -> DataFrame:
    return relational.top_by_size(table(spark, d, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", "c_custkey", 20)


@query("q56_vector_features", """WITH q AS (SELECT vec_id, CAST(label * 36 AS DOUBLE) AS a, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings)
  SELECT vec_id, round(sin(radians(a)), 6) AS s, round(cos(radians(a)), 6) AS c, round(x * 2 + y + 1, 6) AS tx, round(y - z + 2, 6) AS ty, round(z * 0.5 + 3, 6) AS tz FROM q""")
def q56(spark: SparkSession, d: str) -> DataFrame:
    e = [F.col("embedding")[i].cast("double") for i in range(3)]
    matrix = scalars.numbers(F.lit("2 1 0 1  0 1 -1 2  0 0 0.5 3  0 0 0 1"))
    pair = scalars.angle_pair((F.col("label") * 36).cast("double"))
    moved = scalars.transformed(matrix, e)
    return table(spark, d, "embeddings").select("vec_id", F.round(pair[0], 6).alias("s"), F.round(pair[1], 6).alias("c"), *[F.round(v, 6).alias(n) for v, n in zip(moved, ("tx", "ty", "tz"), strict=True)])


@query("q57_xml_cameras", """WITH s AS (SELECT s_suppkey, unnest(['a', 'b', 'g']) AS part FROM supplier)
  SELECT s_suppkey, s_suppkey || '_' || part AS label, CAST(s_suppkey AS DOUBLE) AS x, CAST(s_suppkey * 2 AS DOUBLE) AS y, CASE part WHEN 'a' THEN 1.5 WHEN 'b' THEN 2.5 ELSE 3.5 END AS z FROM s WHERE part <> 'b' OR s_suppkey % 2 = 0""")
def q57(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey").cast("string")

    def camera(part: str, z: str, some=True):
        numbers = F.concat(F.lit("1 0 0 "), k, F.lit(" 0 1 0 "), (F.col("s_suppkey") * 2).cast("string"), F.lit(f" 0 0 1 {z} 0 0 0 1"))
        inner = F.concat(F.lit("<transform>"), numbers, F.lit("</transform>"))
        return F.concat(F.lit('<camera label="'), k, F.lit(f'_{part}">'), F.when(F.lit(some) if some is True else some, inner).otherwise(F.lit("")), F.lit("</camera>"))

    body = F.concat(F.lit("<document><chunk><cameras>"), camera("a", "1.5"), camera("b", "2.5", F.col("s_suppkey") % 2 == 0), F.lit("<group>"), camera("g", "3.5"), F.lit("</group></cameras></chunk></document>"))
    docs = table(spark, d, "supplier").select("s_suppkey", body.alias("xml"))
    return files.cameras(docs).select("s_suppkey", "label", "x", "y", "z")


@query("q64_not_yet_written", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def q64(spark: SparkSession, d: str) -> DataFrame:
    done = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return relational.not_yet_written(table(spark, d, "orders").select("o_orderkey", "o_custkey"), done, ["o_orderkey"])


@query("q65_disjoint_splits", "SELECT DISTINCT l_suppkey AS plot FROM lineitem WHERE l_suppkey % 5 = 0")
def q65(spark: SparkSession, d: str) -> DataFrame:
    plots = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("plot")).distinct()
    return relational.disjoint(plots.where("plot % 5 = 0"), plots.where("plot % 5 = 1"), "train and val plots")


@query("q66_cumulative_cut", """WITH q AS (SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, CAST(l_quantity AS BIGINT) AS w FROM lineitem),
  c AS (SELECT *, sum(w) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey ROWS UNBOUNDED PRECEDING) - w AS before, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) AS rn, sum(w) OVER (PARTITION BY l_suppkey) AS total FROM q)
  SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, w FROM c WHERE rn = 1 OR (before < CASE WHEN l_suppkey % 4 = 0 THEN 100000000 ELSE 300 END AND total >= CASE WHEN l_suppkey % 4 = 0 THEN 100000000 ELSE 300 END)""")
def q66(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").cast("long").alias("w"))
    target = F.when(F.col("l_suppkey") % 4 == 0, 100_000_000).otherwise(300)  # never reached for every fourth key
    return relational.until_reached(q, ["l_suppkey"], [F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey")], "w", target)


@query("q67_summary_text", f"SELECT plot, count(*) || ' trees from ' || count(DISTINCT species) || ' species' AS summary FROM ({inputs.INV}) i GROUP BY plot")
def q67(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.summary_text(inputs.inventory(spark, d), "plot", "species")


@query("q68_described", "SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, min(value) AS min, max(value) AS max, round(quantile_cont(value, 0.5), 6) AS median FROM events GROUP BY event_type")
def q68(spark: SparkSession, d: str) -> DataFrame:
    out = aggregates.described(table(spark, d, "events"), ["event_type"], "value")
    return out.select("event_type", "n", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "min", "max", F.round("median", 6).alias("median"))


@query("q69_chip_records", f"""WITH c AS ({_CODED}), p AS (SELECT l_suppkey % 7 AS dataset, l_orderkey % 500 AS image, l_partkey AS id, l_quantity AS area, CAST(l_linenumber * 40 AS DOUBLE) AS x, CAST(l_suppkey % 50 * 20 AS DOUBLE) AS y FROM lineitem),
  m AS (SELECT *, max(area) OVER (PARTITION BY dataset, image, id) AS top FROM p), b AS (SELECT dataset, image, id, min(x) AS x0, min(y) AS y0, max(x) + 200 AS x1, max(y) + 220 AS y1 FROM m WHERE area > 0.5 * top GROUP BY 1, 2, 3 HAVING max(x) + 200 - min(x) > 210 AND max(y) + 220 - min(y) > 210)
  SELECT dataset, image, id, code AS species_original, {', '.join('code IN (' + ', '.join(repr(c) for c in p) + f') AS primary_l{k}' for k, p in enumerate(species.primary(), 1))}, {', '.join(_case('code', m, 'code') + f' AS code_l{k}' for k, m in enumerate(species.mappings(), 1))},
  CAST(greatest(floor(x0 - (x1 - x0) * 0.02), 0) AS BIGINT) AS px0, CAST(greatest(floor(y0 - (y1 - y0) * 0.02), 0) AS BIGINT) AS py0, CAST(least(ceil(x1 + (x1 - x0) * 0.02), 500) AS BIGINT) AS px1, CAST(least(ceil(y1 + (y1 - y0) * 0.02), 1200) AS BIGINT) AS py1 FROM b LEFT JOIN c ON p_partkey = id""")
def q69(spark: SparkSession, d: str) -> DataFrame:
    x, y = (F.col("l_linenumber") * 40).cast("double"), (F.col("l_suppkey") % 50 * 20).cast("double")
    parts = table(spark, d, "lineitem").select((F.col("l_suppkey") % 7).alias("dataset"), (F.col("l_orderkey") % 500).alias("image"), F.col("l_partkey").alias("id"), F.col("l_quantity").alias("area"), x.alias("minx"), y.alias("miny"), (x + 200).alias("maxx"), (y + 220).alias("maxy"))
    trees = _coded(spark, d).select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(6).cast("long"))).alias("dataset"), F.col("p_partkey").alias("id"), F.col("code").alias("species"))
    return chips.chip_records(parts, trees, F.lit(500), F.lit(1200), edge=210)


@query("q70_samples_of_chunks", """WITH n AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS r FROM orders) SELECT o_orderkey, r // 250 AS batch_id, (r % 250) // 32 AS sub_id FROM n WHERE (r // 250) % 3 = 0 AND (r % 250) // 32 IN (1, 7)""")
def q70(spark: SparkSession, d: str) -> DataFrame:
    chunks = relational.chunked(table(spark, d, "orders").select("o_orderkey"), [F.col("o_orderkey")], 250, 32)
    chosen = chunks.select("batch_id", "sub_id").distinct().where("batch_id % 3 = 0 and sub_id in (1, 7)")
    return relational.with_keys(chunks, chosen, ["batch_id", "sub_id"])
