"""One query per operator on the star-schema tables, with the SQL that must give the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridfill.functions.text import params_text, position_key, safe_file_name
from gridfill.functions.geo import alpha, triangle_area
from gridfill.operators import aggregate as agg
from gridfill.operators import grid as gr
from gridfill.operators import mesh, natural, neighbors, prep, regions, simple, solvers, summaries, variogram
from gridfill.operators.cubic import minimum_curvature
from gridfill.operators.rbf import tiled_rbf
from gridfill.plans import base, fill, oracle, registry
from gridfill.plans.prepare import prepare
from gridfill.session import materialize, run_folder
from gridfill.sources import tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

KEYS = ["datasetName", "name"]
GRID = base.grid_of("demo", 8.0)
SGRID = base.grid_of("suppliers", 8.0)


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def rounded(c, places: int = 6):
    return F.round(F.col(c) if isinstance(c, str) else c, places)


def digits(c, unit: float = 0.7071):
    """Compared by steps of an odd unit: short decimals, which rounding noise would push to either side, lie inside its steps."""
    return F.round((F.col(c) if isinstance(c, str) else c) / F.lit(unit) + F.lit(0.12345), 3)


def digits_sql(c: str, unit: float = 0.7071) -> str:
    return f"round({c}/{unit!r}::DOUBLE+0.12345::DOUBLE, 3)"


def scratch(spark: SparkSession) -> str:
    return f"{run_folder(spark)}/out-{uuid.uuid4().hex}"


def with_(ctes: str, select: str) -> str:
    return f"WITH {ctes} {select}"


# The order samples' own bounds, grid of 8 km and box centres.
BOUNDS = "b AS (SELECT datasetName, min(lat) AS lat_min, max(lat) AS lat_max, min(lon) AS lon_min, max(lon) AS lon_max FROM s GROUP BY datasetName)"
GAPS = "g/111 AS lat_gap, g/(111*cos(pi()*((lat_max+lat_min)/2)/180)) AS lon_gap"
OWN_SPEC = f"""{oracle.ORDERS}, {BOUNDS}, spec0 AS (SELECT *, {GAPS} FROM (SELECT *, 8e0 AS g FROM b)),
spec AS (SELECT *, CAST(ceil((lat_max-lat_min)/lat_gap) AS BIGINT) AS x_num, CAST(ceil((lon_max-lon_min)/lon_gap) AS BIGINT) AS y_num FROM spec0)"""
CENTRES = "round(lat_min + lat_gap/2 + (i//y_num)*lat_gap,6) AS box_lat, round(lon_min + lon_gap/2 + (i%y_num)*lon_gap,6) AS box_lon"


# ---------------------------------------------------------------- sources and sinks

WIDE = f"SELECT o_orderkey AS index, round({oracle.lat('o_orderkey')},6) AS lat, round({oracle.lon('o_orderkey')},6) AS lon, o_totalprice AS price FROM orders"


@query("s1_read_wide", WIDE)
def s1(spark, sf):
    path = scratch(spark)
    wide = base.order_samples(spark, sf).select(
        F.col("lon").alias("Longitude"), F.col("lat").alias("Latitude"), F.col("index").cast("string").alias("sample"), "price")
    tables.write_csv(wide, path)
    read = tables.read_samples(spark, path, tables.sample_schema(["sample"], ["price"]))
    return read.select(F.col("sample").cast("long").alias("index"), rounded("Latitude").alias("lat"), rounded("Longitude").alias("lon"), "price")


def means_table(spark, sf) -> str:
    path = scratch(spark)
    tables.append_table(base.order_means(spark, sf), path, tables.MEAN_PARTITIONS)
    return path


@query("s2_read_means", with_(oracle.prelude(), "SELECT index, round(lat,6) AS lat, round(lon,6) AS lon, round(value,6) AS value FROM means WHERE name='price'"))
def s2(spark, sf):
    means = tables.read_means(spark, means_table(spark, sf), "demo", 8.0, "mean", "price")
    return means.select("index", rounded("lat").alias("lat"), rounded("lon").alias("lon"), rounded("value").alias("value"))


@query("s3_read_boxes", with_(OWN_SPEC, f"SELECT CAST(i AS BIGINT) AS box_index, {CENTRES} FROM spec, unnest(range(x_num*y_num)) AS u(i)"))
def s3(spark, sf):
    path = scratch(spark)
    # The grid spans the samples, at two resolutions.
    own = gr.Grid.from_samples(base.order_samples(spark, sf), "demo", 8.0)
    for grid in (own, own.coarser(16.0)):
        tables.append_table(grid.boxes(spark), path, ["datasetName", "grid_length"])
    return tables.read_boxes(spark, path, "demo", 8.0).select("box_index", rounded("box_lat").alias("box_lat"), rounded("box_lon").alias("box_lon"))


@query("s4_append", with_(oracle.ORDERS, "SELECT name, count(*) AS n, round(sum(value)/count(*),6) AS mean FROM lng GROUP BY name"))
def s4(spark, sf):
    path = scratch(spark)
    for f in base.FEATURES:
        tables.append_table(prep.one_feature(base.order_long(spark, sf), f), path, KEYS)
    return spark.read.parquet(path).groupBy("name").agg(F.count("*").alias("n"), rounded(F.avg("value")).alias("mean"))


@query("s5_csv_result", with_(oracle.prelude(), "SELECT name, index, round(value,6) AS value FROM means"))
def s5(spark, sf):
    path = scratch(spark)
    tables.write_csv(base.order_means(spark, sf).select("datasetName", "index", "lat", "lon", "name", "value", "grid_length", "aggregate_func"), path)
    return spark.read.schema(tables.MEAN_SCHEMA).csv(path, header=True).select("name", "index", rounded("value").alias("value"))


@query("s6_feature_grids", with_(oracle.prelude(), "SELECT name AS feature, 'linear' AS variogram, CAST(8 AS DOUBLE) AS grid_length, count(*) AS n, round(sum(value)/count(*),6) AS mean FROM means GROUP BY name"))
def s6(spark, sf):
    path = scratch(spark)
    tables.write_feature_grids(base.order_means(spark, sf).withColumn("variogram", F.lit("linear")), path)
    stored = spark.read.parquet(path)
    return stored.groupBy("feature", "variogram", F.col("grid_length").cast("double").alias("grid_length")).agg(
        F.count("*").alias("n"), rounded(F.avg("value")).alias("mean"))


def result_table(spark, sf) -> DataFrame:
    """Nearest-neighbour and moving-average results as method 1 and 2."""
    def build():
        near = base.order_neighbours(spark, sf)
        both = simple.nearest(near, 1).withColumn("method_id", F.lit(1).cast("long")).unionByName(
            simple.moving_average(near, 5).withColumn("method_id", F.lit(2).cast("long")))
        # Methods 3 and 4 are the same for the second feature: a result row has a method, not a feature.
        second = F.when(F.col("name") == "cust", 2).otherwise(0)
        return both.select("box_index", "box_lat", "box_lon", "value", (F.col("method_id") + second).cast("long").alias("method_id"))
    return base.once(spark, sf, "result_table", build)


RESULT = f"""{oracle.knn(5)}, result AS (SELECT box_index, box_lat, box_lon, value, CAST(CASE WHEN name='cust' THEN 3 ELSE 1 END AS BIGINT) AS method_id FROM nn WHERE rn=1
  UNION ALL SELECT box_index, first(box_lat), first(box_lon), avg(value), CASE WHEN name='cust' THEN 4 ELSE 2 END FROM nn GROUP BY name, box_index)"""
RESULT_COLS = "box_index, round(box_lat,6) AS box_lat, round(box_lon,6) AS box_lon, round(value,6) AS value, method_id"


def result_cols(df):
    return df.select("box_index", rounded("box_lat").alias("box_lat"), rounded("box_lon").alias("box_lon"), rounded("value").alias("value"), "method_id")


@query("s7_result_by_method", with_(RESULT, f"SELECT {RESULT_COLS} FROM result WHERE method_id=2"))
def s7(spark, sf):
    path = scratch(spark)
    tables.append_table(result_table(spark, sf), path, tables.RESULT_PARTITIONS)
    stored = tables.read_result(spark, path, 2)
    return result_cols(stored.withColumn("method_id", F.col("method_id").cast("long")))


@query("s8_rectangle", with_(RESULT, f"SELECT {RESULT_COLS} FROM result WHERE method_id=1 AND box_lat BETWEEN 47 AND 49.5 AND box_lon BETWEEN -58 AND -55"))
def s8(spark, sf):
    return result_cols(tables.result_in_rectangle(result_table(spark, sf), 1, (47.0, 49.5, -58.0, -55.0)))


@query("s9_export_neighbours", with_(oracle.knn(5), "SELECT name, box_index, string_agg(CAST(index AS VARCHAR), ';' ORDER BY dist, index) AS neigh FROM nn GROUP BY name, box_index"))
def s9(spark, sf):
    path = scratch(spark)
    near = base.order_neighbours(spark, sf).withColumn("neighbors", F.slice("neighbors", 1, 5))
    tables.export_neighbours(neighbors.neighbour_ids(near.select("name", "box_index", "neighbors"), 5), path)
    return spark.read.schema("name string, box_index long, neigh string").csv(path, header=True)


# ---------------------------------------------------------------- feature preparation

@query("p1_region", with_(oracle.CUSTOMERS, "SELECT region AS datasetName, index, round(lat,6) AS lat, balance FROM c WHERE region='BUILDING'"))
def p1(spark, sf):
    return prep.select_region(base.customer_samples(spark, sf), "region", "BUILDING").select("datasetName", "index", rounded("lat").alias("lat"), "balance")


@query("p2_ratio", "SELECT o_orderkey AS index, round(CASE WHEN o_custkey%7<>0 THEN (o_orderkey%3)/CAST(o_custkey%7 AS DOUBLE) WHEN o_orderkey%3=0 THEN 0e0 END, 6) AS ratio FROM orders")
def p2(spark, sf):
    o = base.table(spark, sf, "orders").select(F.col("o_orderkey").alias("index"), (F.col("o_orderkey") % 3).cast("double").alias("a"), (F.col("o_custkey") % 7).cast("double").alias("b"))
    return prep.add_ratio(o, "ratio", "a", "b").select("index", rounded("ratio").alias("ratio"))


@query("p3_log10", with_(oracle.CUSTOMERS, "SELECT index, round(CASE WHEN balance>0 THEN log10(balance) END, 6) AS log_balance FROM c"))
def p3(spark, sf):
    return prep.add_log10(base.customer_samples(spark, sf), "log_balance", "balance").select("index", rounded("log_balance").alias("log_balance"))


@query("p4_clamp", with_(oracle.CUSTOMERS, "SELECT index, CASE WHEN balance<0 THEN 0e0 ELSE balance END AS balance FROM c"))
def p4(spark, sf):
    return prep.clamp_negatives(base.customer_samples(spark, sf), ["balance"]).select("index", "balance")


@query("p5_to_number", "SELECT o_orderkey AS index, CASE WHEN o_orderkey%11=0 THEN NULL ELSE o_totalprice END AS value FROM orders")
def p5(spark, sf):
    o = base.table(spark, sf, "orders").select(F.col("o_orderkey").alias("index"), F.when(F.col("o_orderkey") % 11 == 0, F.lit("n/a")).when(
        F.col("o_orderkey") % 13 == 0, F.concat(F.lit(" "), F.col("o_totalprice").cast("string"))).otherwise(F.col("o_totalprice").cast("string")).alias("value"))
    return prep.coerce_numbers(o, ["value"])


@query("p6_features_except", with_(oracle.ORDERS, "SELECT name, count(*) AS n FROM lng GROUP BY name"))
def p6(spark, sf):
    wide = base.order_samples(spark, sf)
    return prep.wide_to_long(wide, prep.features_except(wide, ["datasetName", "index", "lat", "lon"])).groupBy("name").agg(F.count("*").alias("n"))


@query("p7_features_by_type", "SELECT 'o_totalprice' AS name, count(*) AS n, round(avg(o_totalprice),6) AS mean FROM orders WHERE o_totalprice IS NOT NULL")
def p7(spark, sf):
    o = base.table(spark, sf, "orders")
    features = prep.features_by_type(o)
    pos = base.position("o_orderkey")
    wide = o.select(F.lit("demo").alias("datasetName"), F.col("o_orderkey").alias("index"), pos["lat"].alias("lat"), pos["lon"].alias("lon"), *features)
    return prep.wide_to_long(wide, features).groupBy("name").agg(F.count("*").alias("n"), rounded(F.avg("value")).alias("mean"))


@query("p8_rename", "SELECT o_orderkey AS sample, o_totalprice AS amount FROM orders")
def p8(spark, sf):
    return prep.rename(base.table(spark, sf, "orders"), {"o_orderkey": "sample", "o_totalprice": "amount"}).select("sample", "amount")


@query("p9_latitude_cut", with_(oracle.ORDERS, "SELECT index, round(lat,6) AS lat FROM s WHERE lat<=47.5"))
def p9(spark, sf):
    return prep.cut_latitude(base.order_samples(spark, sf), 47.5).select("index", rounded("lat").alias("lat"))


STACKED = f"SELECT l_partkey, l_orderkey, l_linenumber, {oracle.lat('l_partkey')} AS lat, {oracle.lon('l_partkey')} AS lon, l_quantity FROM lineitem"


def stacked(spark, sf):
    pos = base.position("l_partkey")
    return base.table(spark, sf, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", pos["lat"].alias("lat"), pos["lon"].alias("lon"), "l_quantity")


@query("p10_exact_duplicates", f"SELECT DISTINCT round(lat,6) AS lat, round(lon,6) AS lon, l_quantity FROM ({STACKED})")
def p10(spark, sf):
    return prep.drop_exact_duplicates(stacked(spark, sf).select(rounded("lat").alias("lat"), rounded("lon").alias("lon"), "l_quantity"))


@query("p11_first_per_position", f"SELECT round(lat,6) AS lat, round(lon,6) AS lon, min(l_orderkey*100+l_linenumber) AS index FROM ({STACKED}) GROUP BY lat, lon")
def p11(spark, sf):
    s = stacked(spark, sf).withColumn("index", F.col("l_orderkey") * 100 + F.col("l_linenumber"))
    return prep.first_per_position(s, "index").select(rounded("lat").alias("lat"), rounded("lon").alias("lon"), "index")


@query("p12_dense_index", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate)-1 AS index FROM lineitem")
def p12(spark, sf):
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]
    return prep.dense_index(base.table(spark, sf, "lineitem"), order).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "index")


@query("p13_wide_to_long", with_(oracle.ORDERS, "SELECT datasetName, index, round(lat,6) AS lat, round(lon,6) AS lon, name, value FROM lng"))
def p13(spark, sf):
    return base.order_long(spark, sf).select("datasetName", "index", rounded("lat").alias("lat"), rounded("lon").alias("lon"), "name", "value")


@query("p14_enough_samples", with_(oracle.CUSTOMERS, "SELECT region AS name, index, balance AS value FROM c WHERE region IN (SELECT region FROM c WHERE balance>0 GROUP BY region HAVING count(*) >= (SELECT count(*)/5e0 FROM c WHERE balance>0)) AND balance>0"))
def p14(spark, sf):
    c = base.customer_samples(spark, sf).where("balance > 0").select("datasetName", F.col("region").alias("name"), "index", F.col("balance").alias("value"))
    return prep.features_with_enough(c, c.count() / 5).select("name", "index", "value")


@query("p15_known_missing", with_(oracle.prelude(), "SELECT name, count(*) AS n_known, CAST(4550 - count(*) AS BIGINT) AS n_missing FROM means GROUP BY name"))
def p15(spark, sf):
    boxes = agg.boxes_with_values(GRID.boxes(spark), base.order_means(spark, sf))
    kn = prep.known(boxes).groupBy("name").agg(F.count("*").alias("n_known"))
    return kn.join(prep.missing(boxes).groupBy("name").agg(F.count("*").alias("n_missing")), "name")


@query("p16_one_feature", with_(oracle.ORDERS, "SELECT index, value FROM lng WHERE name='cust'"))
def p16(spark, sf):
    return prep.one_feature(base.order_long(spark, sf), "cust").select("index", "value")


# ---------------------------------------------------------------- grid

SPECS = f"sp AS (SELECT *, {GAPS} FROM b, unnest([2e0,8e0,32e0]) AS u(g))"


@query("g1_gaps", with_(f"{oracle.ORDERS}, {BOUNDS}, {SPECS}", "SELECT datasetName, g AS grid_length, round(lat_gap,9) AS lat_gap, round(lon_gap,9) AS lon_gap FROM sp"))
def g1(spark, sf):
    return grid_specs(spark, sf).select("datasetName", "grid_length", rounded("lat_gap", 9).alias("lat_gap"), rounded("lon_gap", 9).alias("lon_gap"))


def grid_specs(spark, sf):
    b = gr.bounds(base.order_samples(spark, sf)).withColumn("_g", F.explode(F.array(F.lit(2.0), F.lit(8.0), F.lit(32.0))))
    return gr.grid_spec(b, F.col("_g"))


@query("g2_grid_spec", with_(f"{oracle.ORDERS}, {BOUNDS}, {SPECS}", "SELECT datasetName, g AS grid_length, CAST(ceil((lat_max-lat_min)/lat_gap) AS BIGINT) AS x_num, CAST(ceil((lon_max-lon_min)/lon_gap) AS BIGINT) AS y_num FROM sp"))
def g2(spark, sf):
    return grid_specs(spark, sf).select("datasetName", "grid_length", "x_num", "y_num")




@query("g3_boxes", with_(OWN_SPEC, f"SELECT datasetName, g AS grid_length, CAST(i//y_num AS BIGINT) AS box_x, CAST(i%y_num AS BIGINT) AS box_y, CAST(i AS BIGINT) AS box_index, {CENTRES}, CAST(0 AS BIGINT) AS tag FROM spec, unnest(range(x_num*y_num)) AS u(i)"))
def g3(spark, sf):
    boxes = gr.Grid.from_samples(base.order_samples(spark, sf), "demo", 8.0).boxes(spark)
    return boxes.withColumns({"box_lat": rounded("box_lat"), "box_lon": rounded("box_lon")})


CLAMPED = """m AS (SELECT s.datasetName, index, lat, lon, g, y_num,
  least(CAST(floor((lat-lat_min)/lat_gap) AS BIGINT), CASE WHEN lat<=lat_max THEN x_num-1 ELSE 1000000 END) AS bx,
  least(CAST(floor((lon-lon_min)/lon_gap) AS BIGINT), CASE WHEN lon<=lon_max THEN y_num-1 ELSE 1000000 END) AS gy FROM s, spec)"""


@query("g4_assign_box", with_(f"{OWN_SPEC}, {CLAMPED}", "SELECT datasetName, g AS grid_length, index, bx AS box_indx, gy AS box_indy, bx*y_num+gy AS box_index FROM m"))
def g4(spark, sf):
    s = base.order_samples(spark, sf)
    return gr.Grid.from_samples(s, "demo", 8.0).assign(s).select("datasetName", "grid_length", "index", "box_indx", "box_indy", "box_index")


@query("g5_index_centre", with_(f"{OWN_SPEC}, {CLAMPED}, k AS (SELECT index, bx*spec.y_num+gy AS i, spec.* FROM m, spec)", f"SELECT index, i AS box_index, {CENTRES} FROM k"))
def g5(spark, sf):
    s = base.order_samples(spark, sf)
    g = gr.Grid.from_samples(s, "demo", 8.0)
    at = s.select("index", g.position_to_index(F.col("lat"), F.col("lon")).alias("box_index"))
    return g.index_to_centre(at).select("index", "box_index", rounded("box_lat").alias("box_lat"), rounded("box_lon").alias("box_lon"))


HALF = "6371e0*asin(sqrt(pow(cos(radians((lat_max+lat_min)/2)),2)*pow(sin(radians(lon_max-lon_min)/2),2)))"
LEVELS = f"lv AS (SELECT *, {HALF} AS lim, b0*pow(2,k) AS g FROM b, unnest([2e0,3e0,4e0]) AS u(b0), unnest(range(12)) AS w(k))"
LEVEL_SPEC = f"""lsp AS (SELECT datasetName, b0, g, lat_min, lon_min, lat_max, lon_max, {GAPS} FROM lv WHERE g < lim),
ls AS (SELECT *, CAST(ceil((lat_max-lat_min)/lat_gap) AS BIGINT) AS x_num, CAST(ceil((lon_max-lon_min)/lon_gap) AS BIGINT) AS y_num FROM lsp)"""


@query("g6_pyramid", with_(f"{oracle.ORDERS}, {BOUNDS}, {LEVELS}, {LEVEL_SPEC}", """SELECT index, g AS grid_length,
  least(CAST(floor((lat-lat_min)/lat_gap) AS BIGINT), x_num-1)*y_num + least(CAST(floor((lon-lon_min)/lon_gap) AS BIGINT), y_num-1) AS box_index
  FROM s, ls WHERE b0=4e0"""))
def g6(spark, sf):
    s = base.order_samples(spark, sf)
    return gr.pyramid_map(s, gr.Grid.from_samples(s, "demo", 4.0)).select("index", "grid_length", "box_index")


@query("g7_max_resolution", with_(f"{oracle.ORDERS}, {BOUNDS}", f"SELECT datasetName, round({HALF},6) AS max_grid_length FROM b"))
def g7(spark, sf):
    return gr.max_grid_length(gr.bounds(base.order_samples(spark, sf))).select("datasetName", rounded("max_grid_length").alias("max_grid_length"))


@query("g8_box_count", with_(f"{oracle.ORDERS}, {BOUNDS}, {LEVELS}, {LEVEL_SPEC}", "SELECT datasetName, CAST(sum(x_num*y_num) AS BIGINT) AS all_num FROM (SELECT DISTINCT datasetName, g, x_num, y_num FROM ls) GROUP BY datasetName"))
def g8(spark, sf):
    return gr.pyramid_box_count(gr.bounds(base.order_samples(spark, sf)), [2.0, 3.0, 4.0])


@query("g9_fixed_count_raster", with_(f"{oracle.ORDERS}, {BOUNDS}, st AS (SELECT *, (lat_max-lat_min)/201 AS ls, (lon_max-lon_min)/201 AS os FROM b)",
       """SELECT CAST(i*n_lon+j AS BIGINT) AS box_index, round(lat_min+ls+i*ls,6) AS box_lat, round(lon_min+os+j*os,6) AS box_lon
  FROM (SELECT *, CAST(ceil((lat_max-ls-(lat_min+ls))/ls) AS BIGINT) AS n_lat, CAST(ceil((lon_max-os-(lon_min+os))/os) AS BIGINT) AS n_lon FROM st) q,
  unnest(range(n_lat)) AS u(i), unnest(range(n_lon)) AS w(j)"""))
def g9(spark, sf):
    g = gr.Grid.from_samples(base.order_samples(spark, sf), "demo", 8.0)
    return gr.fixed_count_raster(spark, g, 201, 201).select("box_index", rounded("box_lat").alias("box_lat"), rounded("box_lon").alias("box_lon"))


@query("g10_edge_raster", with_(OWN_SPEC, """SELECT CAST(i*n_lon+j AS BIGINT) AS box_index, round(lat_min+i*lat_gap,6) AS box_lat, round(lon_min+j*lon_gap,6) AS box_lon
  FROM (SELECT *, CAST(ceil((lat_max+lat_gap-lat_min)/lat_gap) AS BIGINT) AS n_lat, CAST(ceil((lon_max+lon_gap-lon_min)/lon_gap) AS BIGINT) AS n_lon FROM spec) q,
  unnest(range(n_lat)) AS u(i), unnest(range(n_lon)) AS w(j)"""))
def g10(spark, sf):
    g = gr.Grid.from_samples(base.order_samples(spark, sf), "demo", 8.0)
    return gr.edge_raster(spark, g).select("box_index", rounded("box_lat").alias("box_lat"), rounded("box_lon").alias("box_lon"))


@query("g11_degree_raster", with_(f"{oracle.ORDERS}, {BOUNDS}", """SELECT CAST(i*n_lon+j AS BIGINT) AS box_index, round(lat_min+i*((lat_max-lat_min)/(n_lat-1)),6) AS box_lat, round(lon_min+j*((lon_max-lon_min)/(n_lon-1)),6) AS box_lon
  FROM (SELECT *, CAST(ceil((lat_max-lat_min)/0.05e0) AS BIGINT)+1 AS n_lat, CAST(ceil((lon_max-lon_min)/0.05e0) AS BIGINT)+1 AS n_lon FROM b) q,
  unnest(range(n_lat)) AS u(i), unnest(range(n_lon)) AS w(j)"""))
def g11(spark, sf):
    g = gr.Grid.from_samples(base.order_samples(spark, sf), "demo", 8.0)
    return gr.degree_raster(spark, g, 0.05).select("box_index", rounded("box_lat").alias("box_lat"), rounded("box_lon").alias("box_lon"))


SMESH = f"{oracle.MESH}, "


def on_raster(spark, sf, raster, method: str, params: dict | None = None):
    """A raster over the suppliers' area, filled from their box means: every point, with a rounded value or NULL."""
    filled = fill.fill_points(base.supplier_means(spark, sf), SGRID, method, raster, params)
    return filled.select("box_index", digits("value").alias("value"))


def raster_sql(ctes: str, found: str) -> str:
    return with_(ctes, f"SELECT bc.box_index, {digits_sql('f.value')} AS value FROM bc LEFT JOIN ({found}) f ON f.box_index=bc.box_index")


@query("g9_raster_linear", raster_sql(f"{SMESH}{oracle.fixed_count(61, 71)}, {oracle.IN_TRIANGLES}", "SELECT box_index, w1*v1+w2*v2+w3*v3 AS value FROM loc"))
def g9_linear(spark, sf):
    return on_raster(spark, sf, gr.fixed_count_raster(spark, SGRID, 61, 71), "triangle")


@query("g9_raster_idw", raster_sql(f"{oracle.prelude(oracle.SUPPLIERS)}, {oracle.fixed_count(61, 71)}, {oracle.near_points(8)}", "SELECT box_index, sum(value/dist)/sum(1/dist) AS value FROM nn GROUP BY box_index"))
def g9_idw(spark, sf):
    return on_raster(spark, sf, gr.fixed_count_raster(spark, SGRID, 61, 71), "idw", {"n_closest_points": 8})


@query("g10_raster_natural", raster_sql(f"{SMESH}{oracle.EDGE_RASTER}, {oracle.IN_TRIANGLES}, {oracle.NATURAL}", "SELECT box_index, value FROM sib"))
def g10_natural(spark, sf):
    return on_raster(spark, sf, gr.edge_raster(spark, SGRID), "natural_neighbor")


@query("g10_raster_linear", raster_sql(f"{SMESH}{oracle.EDGE_RASTER}, {oracle.IN_TRIANGLES}", "SELECT box_index, w1*v1+w2*v2+w3*v3 AS value FROM loc"))
def g10_linear(spark, sf):
    return on_raster(spark, sf, gr.edge_raster(spark, SGRID), "triangle")


@query("g11_raster_curvature", raster_sql(f"RECURSIVE {SMESH}{oracle.degree_raster(0.08)}, {oracle.IN_TRIANGLES}, {oracle.SLOPES}, {oracle.PATCH}", "SELECT box_index, value FROM cur"))
def g11_curvature(spark, sf):
    return on_raster(spark, sf, gr.degree_raster(spark, SGRID, 0.08), "min_curvature", {"tolerance": 1e-10})


@query("g11_raster_mean", raster_sql(f"{oracle.prelude(oracle.SUPPLIERS)}, {oracle.degree_raster(0.08)}, {oracle.near_points(5)}", "SELECT box_index, avg(value) AS value FROM nn GROUP BY box_index"))
def g11_mean(spark, sf):
    return on_raster(spark, sf, gr.degree_raster(spark, SGRID, 0.08), "moving_average", {"n_closest_points": 5})


@query("g11_raster_rbf")
def g11_rbf(spark, sf):
    return on_raster(spark, sf, gr.degree_raster(spark, SGRID, 0.08), "rbf", {"tile": 16})


@query("g12_parent_box", with_(oracle.prelude(), "SELECT name, index, CAST(floor(bx/4e0) AS BIGINT) AS parent_x, CAST(floor(gy/4e0) AS BIGINT) AS parent_y FROM means"))
def g12(spark, sf):
    return gr.parent_box(base.order_means(spark, sf), 4).select("name", "index", F.col("parent_x").cast("long").alias("parent_x"), F.col("parent_y").cast("long").alias("parent_y"))


# ---------------------------------------------------------------- joins

@query("j1_join_map", with_(f"{oracle.ORDERS}, {oracle.spec(8.0)}, {oracle.BOXED}", "SELECT name, index, value, box_index FROM boxed"))
def j1(spark, sf):
    box_map = GRID.assign(base.order_samples(spark, sf).select("datasetName", "index", "lat", "lon"))
    return agg.join_map(base.order_long(spark, sf), box_map).select("name", "index", "value", "box_index")


@query("j2_boxes_with_values", with_(oracle.prelude(), "SELECT f.name, b.box_index, round(b.box_lat,6) AS box_lat, round(m.value,6) AS value FROM boxes b CROSS JOIN feats f LEFT JOIN means m ON m.name=f.name AND m.index=b.box_index"))
def j2(spark, sf):
    return agg.boxes_with_values(GRID.boxes(spark), base.order_means(spark, sf)).select("name", "box_index", rounded("box_lat").alias("box_lat"), rounded("value").alias("value"))


@query("j3_boxes_to_search", with_(oracle.prelude(), "SELECT name, box_index, box_x, box_y FROM targets"))
def j3(spark, sf):
    return agg.boxes_to_search(GRID.boxes(spark), base.order_means(spark, sf)).select("name", "box_index", "box_x", "box_y")


RING_PAIRS = f"{oracle.prelude()}, rp AS (SELECT t.name, t.box_index, m.index, m.value FROM targets t JOIN means m ON m.name=t.name AND abs(t.box_x//4-m.bx//4)<=1 AND abs(t.box_y//4-m.gy//4)<=1)"


@query("j4_ring", with_(RING_PAIRS, "SELECT name, box_index, index FROM rp"))
def j4(spark, sf):
    return neighbors.ring_members(base.order_targets(spark, sf), base.order_means(spark, sf), 4).select("name", "box_index", "index")


@query("j5_ring_attributes", with_(RING_PAIRS, "SELECT name, box_index, count(*) AS n, round(max(value),6) AS most, min(index) AS first_index FROM rp GROUP BY name, box_index"))
def j5(spark, sf):
    ring = neighbors.ring_members(base.order_targets(spark, sf), base.order_means(spark, sf), 4)
    return ring.groupBy("name", "box_index").agg(F.count("*").alias("n"), rounded(F.max("value")).alias("most"), F.min("index").alias("first_index"))


@query("j6_window", with_(oracle.prelude(), "SELECT t.name, t.box_index, m.index, round(m.value,6) AS value FROM targets t JOIN means m ON m.name=t.name AND m.bx BETWEEN t.box_x-3 AND t.box_x+3 AND m.gy BETWEEN t.box_y-3 AND t.box_y+3"))
def j6(spark, sf):
    return neighbors.window_members(base.order_targets(spark, sf), base.order_means(spark, sf), 3).select("name", "box_index", "index", rounded("value").alias("value"))


@query("j7_triangle_vertices", with_(oracle.MESH, """SELECT p1, p2, p3, round(a.lat+b.lat+c.lat,6) AS sum_lat, round(a.value+b.value+c.value,6) AS sum_value
  FROM tri JOIN means a ON a.index=p1 JOIN means b ON b.index=p2 JOIN means c ON c.index=p3"""))
def j7(spark, sf):
    t = mesh.with_vertices(base.supplier_triangles(spark, sf), base.supplier_means(spark, sf))
    ids = F.sort_array(F.array("point1", "point2", "point3"))
    return t.select(ids[0].alias("p1"), ids[1].alias("p2"), ids[2].alias("p3"), rounded(F.col("lat1") + F.col("lat2") + F.col("lat3")).alias("sum_lat"),
                    rounded(F.col("value1") + F.col("value2") + F.col("value3")).alias("sum_value"))


@query("j8_box_triangle", with_(f"{oracle.MESH}, {oracle.LOCATED}", "SELECT box_index, p1, p2, p3 FROM loc"))
def j8(spark, sf):
    located = base.supplier_located(spark, sf).select(*KEYS, "box_index", "tri_index")
    t = located.join(base.supplier_triangles(spark, sf), [*KEYS, "tri_index"])
    return t.select("box_index", *triple())


def triple():
    ids = F.sort_array(F.array("point1", "point2", "point3"))
    return [ids[i].alias(f"p{i + 1}") for i in range(3)]


CONFLICT = """conf AS (SELECT l.box_index, t.p1, t.p2, t.p3 FROM loc l JOIN tri t
  ON (l.qx-t.ox)*(l.qx-t.ox)+(l.qy-t.oy)*(l.qy-t.oy) < t.r2*(1-1e-9))"""


def supplier_conflicts(spark, sf):
    return base.once(spark, sf, "supplier_conflicts", lambda: natural.conflict_triangles(
        base.supplier_located(spark, sf), base.supplier_triangles(spark, sf), SGRID))


@query("j9_map_right_join", with_(f"{oracle.MESH}, {oracle.LOCATED}, {CONFLICT}", "SELECT b.box_index, CAST(count(c.p1) AS BIGINT) AS n_triangles FROM boxes b LEFT JOIN conf c ON c.box_index=b.box_index GROUP BY b.box_index"))
def j9(spark, sf):
    found = supplier_conflicts(spark, sf).select("box_index", F.size("triangles").cast("long").alias("n"))
    there = [r[0] for r in base.supplier_means(spark, sf).select("datasetName").distinct().collect()]
    return found.join(SGRID.boxes(spark).where(F.col("datasetName").isin(there)), "box_index", "right").select("box_index", F.coalesce("n", F.lit(0)).alias("n_triangles"))


@query("j10_exact_knn", with_(oracle.knn(16), "SELECT name, box_index, CAST(rn AS BIGINT) AS rank, index, round(dist,6) AS dist FROM nn"))
def j10(spark, sf):
    return ranked(base.order_neighbours(spark, sf))


def ranked(near):
    return near.select("name", "box_index", F.posexplode("neighbors").alias("pos", "n")).select(
        "name", "box_index", (F.col("pos") + 1).cast("long").alias("rank"), F.col("n.index").alias("index"), rounded("n.dist").alias("dist"))


@query("j11_fill_missing", with_(oracle.knn(1), "SELECT f.name, b.box_index, round(coalesce(m.value, n.value),6) AS value FROM boxes b CROSS JOIN feats f LEFT JOIN means m ON m.name=f.name AND m.index=b.box_index LEFT JOIN nn n ON n.name=f.name AND n.box_index=b.box_index"))
def j11(spark, sf):
    current = agg.boxes_with_values(GRID.boxes(spark), base.order_means(spark, sf))
    computed = simple.nearest(base.order_neighbours(spark, sf), 1)
    return agg.fill_missing(current, computed, [*KEYS, "box_index"]).select("name", "box_index", rounded("value").alias("value"))


LABEL = f"""{oracle.POLYGONS}, q AS (SELECT o_orderkey AS index, {oracle.lat('o_orderkey')} AS lat, {oracle.lon('o_orderkey')} AS lon FROM orders),
hit AS (SELECT q.index, region FROM q, edge GROUP BY q.index, region HAVING {oracle.CROSSES})"""


@query("j12_point_in_region", with_(LABEL, "SELECT q.index, coalesce(min(h.region), 'NULL') AS region FROM q LEFT JOIN hit h ON h.index=q.index GROUP BY q.index"))
def j12(spark, sf):
    return regions.label_regions(base.order_samples(spark, sf), base.polygons(spark, sf), "lat", "lon").select("index", "region")


@query("j13_clip", with_(LABEL, "SELECT DISTINCT index FROM hit WHERE region IN ('BUILDING','MACHINERY')"))
def j13(spark, sf):
    shapes = base.polygons(spark, sf).where(F.col("region").isin("BUILDING", "MACHINERY"))
    return regions.clip_to_polygons(base.order_samples(spark, sf), shapes, "lat", "lon").select("index")


# ---------------------------------------------------------------- aggregations

MEAN_COLS = "datasetName, index, round(lat,6) AS lat, round(lon,6) AS lon, name, round(value,6) AS value, CAST(8 AS DOUBLE) AS grid_length"


def mean_cols(df):
    return df.select("datasetName", "index", rounded("lat").alias("lat"), rounded("lon").alias("lon"), "name", rounded("value").alias("value"), "grid_length", "aggregate_func")


@query("a1_box_mean", with_(oracle.prelude(), f"SELECT {MEAN_COLS}, 'mean' AS aggregate_func FROM means"))
def a1(spark, sf):
    return mean_cols(agg.box_values(base.order_long(spark, sf), GRID))


@query("a2_box_median", with_(oracle.prelude().replace("avg(value) AS v", "median(value) AS v"), f"SELECT {MEAN_COLS}, 'median' AS aggregate_func FROM means"))
def a2(spark, sf):
    return mean_cols(agg.box_values(base.order_long(spark, sf), GRID, "median"))


@query("a3_coarser_values", with_(oracle.prelude(), """SELECT name, CAST(floor((lat-46e0)/(32e0/111)) AS BIGINT)*y + CAST(floor((lon- -60e0)/lg) AS BIGINT) AS index, round(avg(value),6) AS value
  FROM means, (SELECT 32e0/(111*cos(pi()*48.5e0/180)) AS lg, CAST(ceil(7e0/(32e0/(111*cos(pi()*48.5e0/180)))) AS BIGINT) AS y) GROUP BY ALL"""))
def a3(spark, sf):
    return agg.values_on_coarser(base.order_means(spark, sf), base.grid_of("demo", 32.0)).select("name", "index", rounded("value").alias("value"))


@query("a4_count_missing", with_(oracle.prelude(), "SELECT datasetName, name, count(*) AS n_missing FROM targets GROUP BY datasetName, name"))
def a4(spark, sf):
    return agg.count_missing(agg.boxes_with_values(GRID.boxes(spark), base.order_means(spark, sf)))


@query("a5_bounds", with_(f"{oracle.ORDERS}, {BOUNDS}", "SELECT datasetName, round(lat_min,6) AS lat_min, round(lat_max,6) AS lat_max, round(lon_min,6) AS lon_min, round(lon_max,6) AS lon_max FROM b"))
def a5(spark, sf):
    b = gr.bounds(base.order_samples(spark, sf))
    return b.select("datasetName", *[rounded(c).alias(c) for c in b.columns[1:]])


def window_pairs(spark, sf):
    pairs = neighbors.window_members(base.order_targets(spark, sf), base.order_means(spark, sf), 3)
    return pairs.withColumn("dist", neighbors.point_distance(F.col("lat"), F.col("lon"), F.col("box_lat"), F.col("box_lon"))).select(
        *KEYS, "box_index", "index", "lat", "lon", "value", F.round("dist", 6).alias("dist"))


NEAR_PAIRS = f"""{oracle.prelude()}, wp AS (SELECT t.name, t.box_index, m.index, m.value,
  round({oracle.ALPHA.format(lat='m.lat')}*sqrt((t.box_lat-m.lat)*(t.box_lat-m.lat)+(t.box_lon-m.lon)*(t.box_lon-m.lon)),6) AS dist
  FROM targets t JOIN means m ON m.name=t.name AND m.bx BETWEEN t.box_x-3 AND t.box_x+3 AND m.gy BETWEEN t.box_y-3 AND t.box_y+3),
wr AS (SELECT *, row_number() OVER (PARTITION BY name, box_index ORDER BY dist, index) AS rn, count(*) OVER (PARTITION BY name, box_index) AS cnt FROM wp)"""


@query("a6_nearest_collector", with_(NEAR_PAIRS, "SELECT name, box_index, CAST(rn AS BIGINT) AS rank, index, dist FROM wr WHERE rn<=5"))
def a6(spark, sf):
    return ranked(neighbors.collect_neighbours(window_pairs(spark, sf), [*KEYS, "box_index"], 5))


@query("a7_bounded_collector", with_(NEAR_PAIRS, "SELECT name, box_index, index, dist, round(value,6) AS value FROM wr WHERE rn<=5"))
def a7(spark, sf):
    return neighbors.nearest_pairs(window_pairs(spark, sf), [*KEYS, "box_index"], 5).select("name", "box_index", "index", "dist", rounded("value").alias("value"))


@query("a8_neighbour_ids", with_(NEAR_PAIRS, "SELECT name, box_index, CASE WHEN cnt>=20 THEN string_agg(CAST(index AS VARCHAR), ';' ORDER BY dist, index) FILTER (rn<=20) END AS neigh FROM wr GROUP BY name, box_index, cnt"))
def a8(spark, sf):
    ids = neighbors.neighbour_ids(neighbors.collect_neighbours(window_pairs(spark, sf), [*KEYS, "box_index"], 20), 20)
    return tables.neighbours_as_text(ids).select("name", "box_index", "neigh")


FENCE = """f AS (SELECT name, q1, q3, q3-q1 AS iqr, q1-1.5e0*(q3-q1) AS lower_bound, q3+1.5e0*(q3-q1) AS upper_bound
  FROM (SELECT name, quantile_cont(value,0.25) AS q1, quantile_cont(value,0.75) AS q3 FROM lng GROUP BY name))"""


@query("a9_fences", with_(f"{oracle.prelude()}, {FENCE}", "SELECT f.name, round(q1,6) AS q1, round(q3,6) AS q3, round(lower_bound,6) AS lower_bound, round(upper_bound,6) AS upper_bound, count(*) FILTER (l.value<lower_bound OR l.value>upper_bound) AS n_outliers FROM f JOIN lng l ON l.name=f.name GROUP BY ALL"))
def a9(spark, sf):
    long = base.order_long(spark, sf)
    f = summaries.fences(long)
    return f.join(summaries.count_outliers(long, f), "name").select("name", rounded("q1").alias("q1"), rounded("q3").alias("q3"), rounded("lower_bound").alias("lower_bound"), rounded("upper_bound").alias("upper_bound"), "n_outliers")


def edges_sql(n: int, places: int, source: str = "f") -> str:
    return f"""ed AS (SELECT name, i, round(CASE WHEN i={n} THEN upper_bound ELSE lower_bound + i*((upper_bound-lower_bound)/{n}) END,{places}) AS e
  FROM {source}, unnest(range({n}+1)) AS u(i)),
bins AS (SELECT a.name, CAST(a.i AS BIGINT) AS bin, a.e AS bin_from, b.e AS bin_to FROM ed a JOIN ed b ON a.name=b.name AND b.i=a.i+1)"""


@query("a10_histogram", with_(f"{oracle.ORDERS}, {FENCE}, {edges_sql(10, 2)}", "SELECT b.name, bin, bin_from, bin_to, count(l.value) AS n FROM bins b LEFT JOIN lng l ON l.name=b.name AND l.value>=bin_from AND l.value<bin_to GROUP BY ALL"))
def a10(spark, sf):
    long = base.order_long(spark, sf)
    return summaries.histogram(long, summaries.level_edges(summaries.fences(long), 10, 2))


@query("a11_distinct_values", with_(oracle.ORDERS, "SELECT datasetName, name, count(DISTINCT value) AS n_distinct FROM lng GROUP BY datasetName, name"))
def a11(spark, sf):
    return agg.distinct_values(base.order_long(spark, sf))


WINDOW = ", ".join(f"floor(max(CASE WHEN b.box_y={i} THEN m.value*0.99737e0 END)) AS \"{i}\"" for i in range(8))


@query("a13_grid_pivot", with_(oracle.prelude(), f"SELECT f.name, b.box_x, {WINDOW} FROM boxes b CROSS JOIN feats f LEFT JOIN means m ON m.name=f.name AND m.index=b.box_index WHERE b.box_x < 12 AND b.box_y < 8 GROUP BY f.name, b.box_x"))
def a13_pivot(spark, sf):
    window = agg.boxes_with_values(GRID.boxes(spark).where("box_x < 12 AND box_y < 8"), base.order_means(spark, sf))
    scaled = window.withColumn("value", F.floor(F.col("value") * 0.99737).cast("double"))
    return summaries.grid_pivot(scaled.select("name", "box_x", "box_y", "value"), columns=range(8))


@query("a13_grid_rows", with_(oracle.prelude(), """SELECT f.name, round(b.box_lat,6) AS box_lat, string_agg(coalesce(CAST(CAST(floor(m.value*0.99737e0) AS BIGINT) AS VARCHAR),'-'), ';' ORDER BY b.box_lon) AS row
  FROM boxes b CROSS JOIN feats f LEFT JOIN means m ON m.name=f.name AND m.index=b.box_index GROUP BY f.name, b.box_lat"""))
def a13(spark, sf):
    # Scaled before cutting to whole numbers, so that no value sits on a rounding edge.
    rows = summaries.grid_rows(agg.boxes_with_values(GRID.boxes(spark), base.order_means(spark, sf)))
    cell = lambda c: F.coalesce(F.floor(c["value"] * 0.99737).cast("string"), F.lit("-"))
    return rows.select("name", rounded("box_lat").alias("box_lat"), F.array_join(F.transform("row", cell), ";").alias("row"))


# ---------------------------------------------------------------- neighbour search

@query("n1_ring_search", with_(oracle.ring(5, 5, 1), "SELECT name, box_index, string_agg(CAST(index AS VARCHAR), ';' ORDER BY dist, index) AS neigh FROM rnn GROUP BY name, box_index"))
def n1(spark, sf):
    near = neighbors.knn(base.order_targets(spark, sf), base.order_means(spark, sf), GRID, 5, metric="alpha", exact=False)
    return tables.neighbours_as_text(neighbors.neighbour_ids(near, 5)).select("name", "box_index", "neigh")


@query("n2_knn", with_(oracle.knn(5), "SELECT name, box_index, CAST(rn AS BIGINT) AS rank, index, round(dist,6) AS dist FROM nn"))
def n2(spark, sf):
    return ranked(neighbors.knn(base.order_targets(spark, sf), base.order_means(spark, sf), GRID, 5))


@query("n3_distance", with_(oracle.ORDERS, f"SELECT index, round({oracle.ALPHA.format(lat='lat')}*sqrt((48.5e0-lat)*(48.5e0-lat)+(-56.5e0-lon)*(-56.5e0-lon)),4) AS dist FROM s"))
def n3(spark, sf):
    s = base.order_samples(spark, sf)
    return s.select("index", rounded(neighbors.point_distance(F.col("lat"), F.col("lon"), F.lit(48.5), F.lit(-56.5)), 4).alias("dist"))


@query("n4_ring_fill", with_(oracle.ring(5, 1, 2), "SELECT name, box_index, round(avg(value),6) AS value FROM rnn GROUP BY name, box_index UNION ALL SELECT name, index, round(value,6) FROM means"))
def n4(spark, sf):
    p = {"n_closest_points": 5, "metric": "alpha", "exact": False, "start_level": 2}
    return fill.fill(base.order_means(spark, sf), GRID, "nn", p).select("name", "box_index", rounded("value").alias("value"))


# ---------------------------------------------------------------- sorts and set operations

@query("o1_nearest_order", with_(oracle.knn(3), "SELECT name, box_index, CAST(rn AS BIGINT) AS rank, index FROM nn"))
def o1(spark, sf):
    near = base.order_neighbours(spark, sf).withColumn("neighbors", F.slice("neighbors", 1, 3))
    return ranked(near).drop("dist")


@query("o2_by_box", with_(oracle.prelude(), "SELECT name, index AS box_index, round(value,6) AS value FROM means WHERE name IS NOT NULL ORDER BY name, index"))
def o2(spark, sf):
    return base.order_means(spark, sf).select("name", F.col("index").alias("box_index"), rounded("value").alias("value")).orderBy("name", "box_index")


@query("o3_sorted_coordinates", with_(oracle.prelude(), "SELECT DISTINCT round(lon,6) AS lon FROM means ORDER BY 1"))
def o3(spark, sf):
    return summaries.sorted_coordinates(base.order_means(spark, sf).select(rounded("lon").alias("lon")), "lon")


@query("u1_offsets_union", with_(oracle.prelude(), "SELECT name, index, CAST(bx//4+dx AS BIGINT) AS px, CAST(gy//4+dy AS BIGINT) AS py FROM means, unnest([-1,0,1]) AS u(dx), unnest([-1,0,1]) AS w(dy)"))
def u1(spark, sf):
    spread = gr.parent_box(base.order_means(spark, sf), 4).withColumn("_o", neighbors.cell_offsets(1, 1))
    return spread.select("name", "index", (F.col("parent_x") + F.col("_o.dx")).cast("long").alias("px"), (F.col("parent_y") + F.col("_o.dy")).cast("long").alias("py"))


@query("u2_known_and_computed", with_(oracle.knn(5), "SELECT name, box_index, round(avg(value),6) AS value FROM nn GROUP BY name, box_index UNION ALL SELECT name, index, round(value,6) FROM means"))
def u2(spark, sf):
    computed = simple.moving_average(base.order_neighbours(spark, sf), 5).select("name", "box_index", "value")
    return base.order_means(spark, sf).select("name", F.col("index").alias("box_index"), "value").unionByName(computed).withColumn("value", rounded("value"))


@query("u3_distinct_values", with_(oracle.prelude(), "SELECT DISTINCT index AS idx, round(value,6) AS value FROM means"))
def u3(spark, sf):
    m = base.order_means(spark, sf)
    twice = m.unionByName(m)
    return twice.select(F.col("index").alias("idx"), rounded("value").alias("value")).distinct()


# ---------------------------------------------------------------- interpolators

def value_cols(df):
    return df.select("name", "box_index", rounded("value").alias("value"))


@query("i1_nearest", with_(oracle.knn(1), "SELECT name, box_index, round(value,6) AS value FROM nn"))
def i1(spark, sf):
    return value_cols(simple.nearest(base.order_neighbours(spark, sf), 1))


@query("i2_idw", with_(oracle.knn(8), "SELECT name, box_index, round(sum(value/dist)/sum(1/dist),6) AS value FROM nn GROUP BY name, box_index"))
def i2(spark, sf):
    return value_cols(simple.idw(base.order_neighbours(spark, sf), 8, 1.0))


VARIOGRAM = f"""{oracle.prelude()}, vp AS (SELECT a.name, sqrt(((a.bx-b.bx)*lat_gap)*((a.bx-b.bx)*lat_gap)+((a.gy-b.gy)*lon_gap)*((a.gy-b.gy)*lon_gap)) AS d, 0.5e0*(a.value-b.value)*(a.value-b.value) AS h
  FROM means a JOIN means b ON a.name=b.name AND a.index<b.index, spec),
vg AS (SELECT name, CAST(least(floor(d/(0.8e0/6)),5) AS BIGINT) AS lag, count(*) AS n, avg(d) AS dist, avg(h) AS gamma FROM vp WHERE d<=0.8e0 GROUP BY ALL)"""


def order_variogram(spark, sf):
    return base.once(spark, sf, "order_variogram", lambda: variogram.empirical_variogram(base.order_means(spark, sf), GRID, 0.8))


@query("i3_variogram", with_(VARIOGRAM, "SELECT name, lag, n, round(dist,6) AS dist, round(gamma,2) AS gamma FROM vg"))
def i3(spark, sf):
    return variogram.empirical_variogram(base.order_means(spark, sf), GRID, 0.8).select("name", "lag", "n", rounded("dist").alias("dist"), rounded("gamma", 2).alias("gamma"))


@query("i3_variogram_all", with_(oracle.prelude(), f"""SELECT name, lag, round(avg(d),6) AS dist, round(avg(g)/1e6,3) AS gamma, count(*) AS n FROM (
  SELECT name, d, g, CAST(least(floor(d/({variogram.extent(GRID)!r}::DOUBLE/6)),5) AS BIGINT) AS lag FROM (
  SELECT a.name, sqrt(pow((a.bx-b.bx)*{GRID.lat_gap!r}::DOUBLE,2)+pow((a.gy-b.gy)*{GRID.lon_gap!r}::DOUBLE,2)) AS d, 0.5*pow(a.value-b.value,2) AS g
  FROM means a JOIN means b ON a.name=b.name AND a.index<b.index)) GROUP BY ALL"""))
def i3_all(spark, sf):
    v = variogram.full_variogram(base.order_means(spark, sf), GRID)
    return v.select("name", "lag", rounded("dist").alias("dist"), F.round(F.col("gamma") / 1e6, 3).alias("gamma"), "n")


# Customers at their own positions, all pairs.
SCATTERED = f"""{oracle.CUSTOMERS}, p AS (SELECT index, lat, lon, balance AS value FROM c),
ex AS (SELECT sqrt(pow(max(lat)-min(lat),2)+pow(max(lon)-min(lon),2))/6 AS step FROM p),
sp AS (SELECT sqrt(pow(a.lat-b.lat,2)+pow(a.lon-b.lon,2)) AS d, 0.5*pow(a.value-b.value,2) AS h FROM p a JOIN p b ON a.index<b.index),
vg AS (SELECT 'balance' AS name, CAST(least(floor(d/step),5) AS BIGINT) AS lag, count(*) AS n, avg(d) AS dist, avg(h) AS gamma FROM sp, ex GROUP BY ALL)"""


def customer_long(spark, sf):
    return prep.wide_to_long(base.customer_samples(spark, sf), ["balance"])


@query("i3_variogram_scattered", with_(SCATTERED, f"SELECT name, lag, n, round(dist,4) AS dist, {digits_sql('gamma', 7071.0)} AS gamma FROM vg"))
def i3_scattered(spark, sf):
    found = variogram.scattered_variogram(customer_long(spark, sf))
    return found.select("name", "lag", "n", rounded("dist", 4).alias("dist"), digits("gamma", 7071.0).alias("gamma"))


@query("i3_variogram_fit", with_(f"{VARIOGRAM}, fit AS (SELECT name, regr_slope(gamma,dist) AS s, avg(gamma) AS g, regr_intercept(gamma,dist) AS c, sum(dist*gamma)/sum(dist*dist) AS t FROM vg GROUP BY name)",
       "SELECT name, round(CASE WHEN s<0 THEN 0e0 WHEN c<0 THEN t ELSE s END,0) AS slope, round(CASE WHEN s<0 THEN g WHEN c<0 THEN 0e0 ELSE c END,0) AS nugget FROM fit"))
def i3_fit(spark, sf):
    fit = variogram.fit_variogram(order_variogram(spark, sf), "linear")
    return fit.select("name", rounded(F.col("variogram")[0], 0).alias("slope"), rounded(F.col("variogram")[1], 0).alias("nugget"))


@query("i3_variogram_gaussian")
def i3_gaussian(spark, sf):
    fit = variogram.fit_variogram(order_variogram(spark, sf), "gaussian")
    return fit.select("name", *[F.col("variogram")[i].alias(c) for i, c in enumerate(("psill", "range", "nugget"))])


LINEAR_FIT = "fit AS (SELECT name, regr_slope(gamma,dist) AS s, avg(gamma) AS g, regr_intercept(gamma,dist) AS c, sum(dist*gamma)/sum(dist*dist) AS t FROM vg GROUP BY name)"


@query("i4_kriging", with_(f"{VARIOGRAM}, {LINEAR_FIT}{oracle.knn(5)[len(oracle.prelude()):]}, {oracle.kriging(5)}", f"SELECT name, box_index, {digits_sql('value', 707.1)} AS value FROM kr"))
def i4(spark, sf):
    fit = variogram.fit_variogram(order_variogram(spark, sf), "linear")
    found = solvers.ordinary_kriging(base.order_neighbours(spark, sf).join(fit, KEYS, "left"), 5, "linear")
    return found.select("name", "box_index", digits("value", 707.1).alias("value"))


# Kriging from scattered samples: variogram, neighbours and solution all at the samples' own positions.
@query("i4_kriging_scattered", with_(f"""{SCATTERED}, {LINEAR_FIT}, {oracle.spec(8.0)}, {oracle.degree_raster(0.23)},
means AS (SELECT 'balance' AS name, index, lat, lon, value FROM p),
nd AS (SELECT r.box_index, m.name, m.index, m.value, sqrt(pow(m.lat-r.box_lat,2)+pow(m.lon-r.box_lon,2)) AS dist FROM rp r, means m),
nn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY box_index ORDER BY dist, index) AS rn FROM nd) WHERE rn <= 5), {oracle.kriging(5)}""",
       f"SELECT name, box_index, {digits_sql('value', 70.71)} AS value FROM kr"))
def i4_scattered(spark, sf):
    samples = customer_long(spark, sf)
    grid = base.grid_of("customers", 8.0)
    fit = materialize(variogram.fit_variogram(variogram.scattered_variogram(samples), "linear"))
    points = gr.degree_raster(spark, grid, 0.23).withColumn("name", F.lit("balance"))
    near = neighbors.knn(points, samples, grid, 5)
    return solvers.ordinary_kriging(near.join(fit, KEYS, "left"), 5, "linear").select("name", "box_index", digits("value", 70.71).alias("value"))


# With a pure nugget every neighbour weighs the same, which SQL can say.
@query("i4_kriging_nugget", with_(oracle.knn(5), "SELECT name, box_index, round(avg(value),6) AS value FROM nn GROUP BY name, box_index"))
def i4_nugget(spark, sf):
    params = F.array(F.lit(0.0), F.lit(1.0))
    return value_cols(solvers.ordinary_kriging(base.order_neighbours(spark, sf), 5, "linear", params))


@query("i5_local_polynomial", with_(f"{oracle.knn(16)}, {oracle.quadratic(16)}", f"SELECT name, box_index, {digits_sql('x1_1', 707.1)} AS value FROM sol"))
def i5(spark, sf):
    found = solvers.local_polynomial(base.order_neighbours(spark, sf), 16, 2)
    return found.select("name", "box_index", digits("value", 707.1).alias("value"))


# Degree 1 has a closed form: the plane through the 16 neighbours by normal equations at the box.
@query("i5_local_plane", with_(f"""{oracle.knn(16)}, pt AS (SELECT nn.name, nn.box_index, nn.value AS v, m.lat-nn.box_lat AS x, m.lon-nn.box_lon AS y FROM nn JOIN means m ON m.name=nn.name AND m.index=nn.index),
mo AS (SELECT name, box_index, avg(v) AS mv, avg(x) AS mx, avg(y) AS my, covar_pop(x,x) AS xx, covar_pop(y,y) AS yy, covar_pop(x,y) AS xy, covar_pop(x,v) AS xv, covar_pop(y,v) AS yv FROM pt GROUP BY ALL)""",
       "SELECT name, box_index, round((mv - mx*(yy*xv-xy*yv)/(xx*yy-xy*xy) - my*(xx*yv-xy*xv)/(xx*yy-xy*xy))/7, 3) AS value FROM mo"))
def i5_plane(spark, sf):
    return solvers.local_polynomial(base.order_neighbours(spark, sf), 16, 1).select("name", "box_index", rounded(F.col("value") / 7, 3).alias("value"))


@query("i6_rbf")
def i6(spark, sf):
    return value_cols(tiled_rbf(base.order_targets(spark, sf), base.order_means(spark, sf), GRID, "multiquadric", 8))


@query("i6_rbf_gaussian_local")
def i6_local(spark, sf):
    return value_cols(solvers.local_rbf(base.order_neighbours(spark, sf), 16, "gaussian"))


@query("i7_linear_triangles", with_(f"{oracle.MESH}, {oracle.LOCATED}", "SELECT box_index, round(w1*v1+w2*v2+w3*v3,8) AS value FROM loc"))
def i7(spark, sf):
    return mesh.linear_triangulation(base.supplier_located(spark, sf)).select("box_index", rounded("value", 8).alias("value"))


@query("i7_linear_orders")
def i7_orders(spark, sf):
    return value_cols(mesh.linear_triangulation(base.order_located(spark, sf)))


@query("i7_edge_mean")
def i7_edge(spark, sf):
    return value_cols(mesh.linear_triangulation(base.order_located(spark, sf), "edge_mean"))


# The corner order matters here: counter-clockwise from the smallest number.
@query("i7_edge_mean_suppliers", with_(f"{oracle.MESH}, {oracle.LOCATED}, o AS (SELECT *, det > 0 AS ccw FROM loc)", f"""SELECT box_index, {digits_sql("0.5*(abs(CASE WHEN ccw THEN w3 ELSE w2 END)*(v1+CASE WHEN ccw THEN v2 ELSE v3 END) + abs(CASE WHEN ccw THEN w2 ELSE w3 END)*(v1+CASE WHEN ccw THEN v2 ELSE v3 END) + abs(w1)*(v2+v3))")} AS value FROM o"""))
def i7_edge_suppliers(spark, sf):
    return mesh.linear_triangulation(base.supplier_located(spark, sf), "edge_mean").select("box_index", digits("value").alias("value"))


@query("i8_natural_neighbour")
def i8(spark, sf):
    return value_cols(natural.natural_neighbour(base.order_located(spark, sf), base.order_triangles(spark, sf), GRID))


@query("i8_natural_suppliers", with_(f"{oracle.MESH}, {oracle.LOCATED}, {oracle.NATURAL}", f"SELECT l.box_index, {digits_sql('sib.value')} AS value FROM loc l LEFT JOIN sib ON sib.box_index=l.box_index"))
def i8_suppliers(spark, sf):
    found = natural.natural_neighbour(base.supplier_located(spark, sf), base.supplier_triangles(spark, sf), SGRID)
    return found.select("box_index", digits("value").alias("value"))


@query("i9_moving_average", with_(oracle.knn(5), "SELECT name, box_index, round(avg(value),6) AS value FROM nn GROUP BY name, box_index"))
def i9(spark, sf):
    return value_cols(simple.moving_average(base.order_neighbours(spark, sf), 5))


@query("i10_minimum_curvature")
def i10(spark, sf):
    return value_cols(minimum_curvature(base.order_triangles(spark, sf), GRID, targets=base.order_targets(spark, sf)))


@query("i10_curvature_suppliers", with_(f"RECURSIVE {oracle.MESH}, {oracle.LOCATED}, {oracle.SLOPES}, {oracle.PATCH}", f"SELECT box_index, {digits_sql('value')} AS value FROM cur"))
def i10_suppliers(spark, sf):
    return minimum_curvature(base.supplier_triangles(spark, sf), SGRID, 1e-10).select("box_index", digits("value").alias("value"))


# The variance is compared by its logarithm: its rounding noise does not grow with the values.
METRIC_SQL = """SELECT name, box_index, round(median(value),6) AS "median", round(max(value),6) AS "max", round(min(value),6) AS "min", round(quantile_cont(value,0.25),6) AS "Q1",
  round(quantile_cont(value,0.75),6) AS "Q3", round(avg(value),6) AS "mean", round(ln(CASE WHEN var_samp(value)>0 THEN var_samp(value) END),6) AS "var", round(stddev_samp(value),4) AS "std",
  round(stddev_pop(value)/avg(value)*100,6) AS "CV" FROM nn GROUP BY name, box_index"""


@query("i11_metrics", with_(oracle.knn(5), METRIC_SQL))
def i11(spark, sf):
    m = simple.data_metrics(base.order_neighbours(spark, sf), 5).withColumn("var", F.ln(F.when(F.col("var") > 0, F.col("var"))))
    return m.select("name", "box_index", *[rounded(c, 4 if c == "std" else 6).alias(c) for c in simple.METRICS])


@query("i12_fill_metrics", with_(f"""{oracle.knn(5)}, d AS (SELECT name, box_index, 'median' AS func, median(value) AS value FROM nn GROUP BY ALL UNION ALL SELECT name, box_index, 'max', max(value) FROM nn GROUP BY ALL
  UNION ALL SELECT name, box_index, 'Q3', quantile_cont(value,0.75) FROM nn GROUP BY ALL)""",
       "SELECT name, func, box_index, round(value,6) AS value FROM d UNION ALL SELECT name, func, index, round(value,6) FROM means, unnest(['median','max','Q3']) AS u(func)"))
def i12(spark, sf):
    return fill.fill_metrics(base.order_means(spark, sf), GRID, ("median", "max", "Q3"), 5).select("name", "func", "box_index", rounded("value").alias("value"))


# ---------------------------------------------------------------- triangulation

@query("t1_delaunay", with_(oracle.MESH, "SELECT p1, p2, p3 FROM tri"))
def t1(spark, sf):
    return base.supplier_triangles(spark, sf).select(*triple())


@query("t1_delaunay_orders")
def t1_orders(spark, sf):
    return base.order_triangles(spark, sf).select("name", "tri_index", *triple())


@query("t2_locate", with_(f"{oracle.MESH}, {oracle.LOCATED}", "SELECT box_index, p1, p2, p3 FROM loc"))
def t2(spark, sf):
    return mesh.boxes_in_triangles(base.supplier_triangles(spark, sf), SGRID).select("box_index", *triple())


@query("t3_drop_degenerate", with_(f"{oracle.MESH}", "SELECT p1, p2, p3, round(abs(det)/2/(lon_gap/lat_gap),6) AS area FROM tri, spec"))
def t3(spark, sf):
    tri = base.supplier_triangles(spark, sf)
    flat = tri.withColumns({"u3": F.col("u2"), "v3": F.col("v2")})
    kept = mesh.drop_degenerate(tri.unionByName(flat))
    area = F.abs(triangle_area(*[F.col(c) for c in ("u1", "v1", "u2", "v2", "u3", "v3")]))
    return kept.select(*triple(), rounded(area).alias("area"))


@query("t4_conflict_triangles", with_(f"{oracle.MESH}, {oracle.LOCATED}, {CONFLICT}", "SELECT box_index, p1, p2, p3 FROM conf"))
def t4(spark, sf):
    each = supplier_conflicts(spark, sf).select(*KEYS, "box_index", F.explode("triangles.tri_index").alias("tri_index"))
    return each.join(base.supplier_triangles(spark, sf), [*KEYS, "tri_index"]).select("box_index", *triple())


# ---------------------------------------------------------------- method registry and runs

def method_rows(spark, sf):
    """One method per order priority and status: names and parameters come from the data."""
    o = base.table(spark, sf, "orders").select("o_orderpriority", "o_orderstatus").distinct()
    params = F.create_map(F.lit("variogram_model"), F.lower("o_orderstatus"), F.lit("n_closest_points"), F.substring("o_orderpriority", 1, 1))
    return o.select(F.lit("krige").alias("method_name"), params.alias("params"), F.lit("demo").alias("dataset_name"),
                    F.lit(8.0).alias("grid_length"), F.col("o_orderpriority").alias("feature_name"), F.lit("mean").alias("aggregate_func"))


METHODS = """mt AS (SELECT DISTINCT 'krige' AS method_name, 'n_closest_points,variogram_model:' || substr(o_orderpriority,1,1) || ',' || lower(o_orderstatus) AS params,
  'demo' AS dataset_name, CAST(8 AS DOUBLE) AS grid_length, o_orderpriority AS feature_name, 'mean' AS aggregate_func FROM orders),
r1 AS (SELECT row_number() OVER (ORDER BY method_name, params, dataset_name, grid_length, feature_name, aggregate_func) AS method_id, *, true AS is_valid FROM mt)"""


@query("m1_params_text", "SELECT o_orderkey AS index, 'a,n,z:' || o_orderstatus || ',' || CAST(o_custkey AS VARCHAR) || ',' || o_orderpriority AS params FROM orders")
def m1(spark, sf):
    o = base.table(spark, sf, "orders")
    m = F.create_map(F.lit("z"), "o_orderpriority", F.lit("n"), F.col("o_custkey").cast("string"), F.lit("a"), "o_orderstatus")
    return o.select(F.col("o_orderkey").alias("index"), params_text(m).alias("params"))


def registered(spark, sf):
    return base.once(spark, sf, "registered", lambda: registry.register(
        registry.empty_registry(spark), registry.with_params_text(method_rows(spark, sf))))


@query("m2_register", with_(METHODS, "SELECT * FROM r1"))
def m2(spark, sf):
    # Registering the same rows again adds nothing.
    return registry.register(registered(spark, sf), registry.with_params_text(method_rows(spark, sf)))


@query("m3_register_always", with_(METHODS, "SELECT method_id, feature_name, params, is_valid FROM r1 UNION ALL SELECT method_id + (SELECT count(*) FROM r1), feature_name, params, is_valid FROM r1"))
def m3(spark, sf):
    twice = registry.register(registered(spark, sf), registry.with_params_text(method_rows(spark, sf)), dedupe=False)
    return twice.select("method_id", "feature_name", "params", "is_valid")


@query("m4_set_validity", with_(METHODS, "SELECT method_id, method_id<>2 AS is_valid FROM r1"))
def m4(spark, sf):
    return registry.set_validity(registered(spark, sf), 2, False).select("method_id", "is_valid")


@query("m5_next_id", with_(RESULT, "SELECT CAST(coalesce(max(method_id),0)+1 AS BIGINT) AS method_id FROM result"))
def m5(spark, sf):
    return registry.next_method_id(result_table(spark, sf))


@query("m6_start_result", with_(f"{oracle.prelude()}, {METHODS}", "SELECT method_id, feature_name AS name, b.box_index, CAST(NULL AS DOUBLE) AS value FROM boxes b, r1"))
def m6(spark, sf):
    return registry.start_result(GRID.boxes(spark), registered(spark, sf)).select("method_id", "name", "box_index", "value")


@query("m7_stage_rounds", with_(f"{oracle.ring(5, 5, 1)}, tot AS (SELECT name, count(*) AS n FROM home WHERE home<=1 GROUP BY name)", "SELECT h.name, CAST(h.home AS BIGINT) AS level, count(*) AS n_boxes FROM home h GROUP BY ALL"))
def m7(spark, sf):
    # The boxes each search level fills: what the rounds stage one after another.
    staged = neighbors.search_levels(base.order_targets(spark, sf), base.order_means(spark, sf), GRID, 5)
    return staged.groupBy("name", F.col("level").cast("long").alias("level")).agg(F.count("*").alias("n_boxes"))


def run_idw(spark, sf):
    reg = registry.empty_registry(spark)
    return fill.run(reg, base.order_means(spark, sf), GRID, "idw", {"n_closest_points": 8})


RUN_SQL = f"""{oracle.knn(8)}, ids AS (SELECT name, row_number() OVER (ORDER BY name) AS method_id FROM feats),
out AS (SELECT name, box_index, sum(value/dist)/sum(1/dist) AS value FROM nn GROUP BY ALL UNION ALL SELECT name, index, value FROM means)"""


@query("m8_run", with_(RUN_SQL, "SELECT o.name, box_index, round(value,6) AS value, method_id FROM out o JOIN ids ON ids.name=o.name"))
def m8(spark, sf):
    return run_idw(spark, sf)[1].select("name", "box_index", rounded("value").alias("value"), "method_id")


@query("m9_run_many", with_(f"{oracle.prelude()}", "SELECT name AS feature_name, 'n_closest_points:8' AS params, true AS is_valid, CAST(0 AS BIGINT) AS n_missing FROM feats UNION ALL SELECT 'balance', 'n_closest_points:8', true, 0"))
def m9(spark, sf):
    per_dataset = {"demo": (base.order_means(spark, sf), GRID), "suppliers": (base.supplier_means(spark, sf), SGRID)}
    reg, result, _ = fill.run_many(registry.empty_registry(spark), per_dataset, "nn", {"n_closest_points": 8})
    left = fill.missing_per_feature(result).select(F.col("name").alias("feature_name"), "n_missing")
    return reg.join(left, "feature_name").select("feature_name", "params", "is_valid", "n_missing")


# One feature is fine, one has too few samples, one holds infinite values: each has its own outcome.
@query("m9_run_failures", with_(oracle.prelude(), """SELECT 'price' AS name, count(*) AS n_samples, true AS is_valid, CAST(NULL AS VARCHAR) AS reason, (SELECT count(*) FROM boxes) AS n_boxes FROM means WHERE name='price'
  UNION ALL SELECT 'few', count(*), false, 'fewer than 10 samples', 0 FROM (SELECT 1 FROM means WHERE name='price' ORDER BY index LIMIT 6) q
  UNION ALL SELECT 'broken', count(*), false, 'boxes without a finite value', (SELECT count(*) FROM boxes) FROM means WHERE name='price'"""))
def m9_failures(spark, sf):
    price = base.order_means(spark, sf).where("name = 'price'")
    few = price.orderBy("index").limit(6).withColumn("name", F.lit("few"))
    broken = price.withColumns({"name": F.lit("broken"), "value": F.when(F.col("index") % 3 == 0, F.lit(float("inf"))).otherwise(F.col("value"))})
    means = price.unionByName(few).unionByName(broken)
    reg, result, outcomes = fill.run_many(registry.empty_registry(spark), {"demo": (means, GRID)}, "moving_average", {"n_closest_points": 5}, minimum=10)
    boxes = result.groupBy("name").agg(F.count("*").alias("n_boxes"))
    valid = reg.select(F.col("feature_name").alias("name"), "is_valid")
    return outcomes.select("name", "n_samples", "reason").join(valid, "name").join(boxes, "name", "left").select(
        "name", "n_samples", "is_valid", "reason", F.coalesce("n_boxes", F.lit(0)).alias("n_boxes"))


@query("m10_prepare", with_(f"{OWN_SPEC}, {CLAMPED}", "SELECT l.name, m.bx*m.y_num+m.gy AS index, round(avg(l.value),6) AS value FROM m JOIN lng l ON l.index=m.index GROUP BY ALL"))
def m10(spark, sf):
    return prepare(base.order_samples(spark, sf), base.FEATURES, "demo", 8.0).means.select("name", "index", rounded("value").alias("value"))


# ---------------------------------------------------------------- regions and summaries

# Hull corners: ends of sides that have no point on their right, and none further along. Points strictly
# inside the quadrilateral of the four extreme points cannot be corners.
HULL = """k AS (SELECT DISTINCT c_mktsegment AS region, CAST((c_custkey*7919)%5000 AS DOUBLE) AS x, CAST((c_custkey*104729)%7000 AS DOUBLE) AS y FROM customer),
ext AS (SELECT region, min_by(x,x) AS ax, min_by(y,x) AS ay, min_by(x,y) AS bx, min_by(y,y) AS by_, max_by(x,x) AS cx, max_by(y,x) AS cy, max_by(x,y) AS dx, max_by(y,y) AS dy FROM k GROUP BY region),
far AS (SELECT k.* FROM k JOIN ext e ON e.region=k.region WHERE NOT (
  (bx-ax)*(y-ay)-(by_-ay)*(x-ax) > 0 AND (cx-bx)*(y-by_)-(cy-by_)*(x-bx) > 0 AND (dx-cx)*(y-cy)-(dy-cy)*(x-cx) > 0 AND (ax-dx)*(y-dy)-(ay-dy)*(x-dx) > 0)),
side AS (SELECT a.region, a.x, a.y FROM far a JOIN far b ON a.region=b.region AND (a.x<>b.x OR a.y<>b.y)
  WHERE NOT EXISTS (SELECT 1 FROM k q WHERE q.region=a.region AND ((b.x-a.x)*(q.y-a.y)-(b.y-a.y)*(q.x-a.x) < 0
    OR ((b.x-a.x)*(q.y-a.y)-(b.y-a.y)*(q.x-a.x) = 0 AND (q.x-a.x)*(b.x-a.x)+(q.y-a.y)*(b.y-a.y) < 0))))"""


@query("v1_convex_hull", with_(HULL, "SELECT DISTINCT region, x, y FROM side"))
def v1(spark, sf):
    c = base.table(spark, sf, "customer").select(F.col("c_mktsegment").alias("region"), (F.col("c_custkey") * 7919 % 5000).cast("double").alias("lat"),
                                                 (F.col("c_custkey") * 104729 % 7000).cast("double").alias("lon"))
    hulls = regions.convex_hulls(c, ["region"])
    return hulls.select("region", F.explode("vertices").alias("p")).select("region", F.col("p.lat").alias("x"), F.col("p.lon").alias("y"))


@query("v2_point_in_polygon", with_(LABEL, "SELECT region, count(*) AS n FROM hit GROUP BY region"))
def v2(spark, sf):
    hit = regions.points_in_polygons(base.order_samples(spark, sf), base.polygons(spark, sf), "lat", "lon")
    return hit.groupBy("region").agg(F.count("*").alias("n"))


@query("v3_label_boxes", with_(f"{oracle.prelude()}, {oracle.POLYGONS}, q AS (SELECT name, box_index AS index, box_lat AS lat, box_lon AS lon FROM targets), hit AS (SELECT q.name, q.index, region FROM q, edge GROUP BY q.name, q.index, region HAVING {oracle.CROSSES})",
       "SELECT q.name, q.index AS box_index, coalesce(min(h.region),'NULL') AS region FROM q LEFT JOIN hit h ON h.index=q.index AND h.name=q.name GROUP BY q.name, q.index"))
def v3(spark, sf):
    result = simple.nearest(base.order_neighbours(spark, sf), 1)
    return regions.label_regions(result, base.polygons(spark, sf)).select("name", "box_index", "region")


def original(spark, sf):
    return base.order_long(spark, sf).select("name", F.col("lat").alias("box_lat"), F.col("lon").alias("box_lon"), "value")


def interpolated(spark, sf):
    return simple.idw(base.order_neighbours(spark, sf), 8).select("datasetName", "name", "box_index", "box_lat", "box_lon", "value")


IDW = f"{oracle.knn(8)}, idw AS (SELECT name, box_index, sum(value/dist)/sum(1/dist) AS value FROM nn GROUP BY ALL)"


@query("v4_histogram", with_(f"{IDW}, {FENCE}, {edges_sql(10, 2)}, both_ AS (SELECT 'original' AS source, name, value FROM lng UNION ALL SELECT 'interpolation', name, value FROM idw)",
       "SELECT b.name, s.source, bin, bin_from, bin_to, count(v.value) AS n FROM bins b CROSS JOIN (SELECT DISTINCT source FROM both_) s LEFT JOIN both_ v ON v.name=b.name AND v.source=s.source AND v.value>=bin_from AND v.value<bin_to GROUP BY ALL"))
def v4(spark, sf):
    return summaries.compare_histograms(original(spark, sf), interpolated(spark, sf))


@query("v5_contour_levels", with_(f"{IDW}, {FENCE}, {edges_sql(6, 4)}", "SELECT i.name, i.box_index, b.bin AS level FROM idw i LEFT JOIN bins b ON b.name=i.name AND i.value>=bin_from AND i.value<bin_to"))
def v5(spark, sf):
    return summaries.contour_levels(original(spark, sf), interpolated(spark, sf)).select("name", "box_index", "level")


@query("v6_feature_summaries", with_(f"{IDW}, {FENCE}, {edges_sql(8, 4)}", "SELECT i.name, b.bin AS level, count(*) AS n FROM idw i LEFT JOIN bins b ON b.name=i.name AND i.value>=bin_from AND i.value<bin_to GROUP BY ALL"))
def v6(spark, sf):
    imp = interpolated(spark, sf)
    constant = imp.withColumns({"name": F.lit("constant"), "value": F.lit(1.0)})
    return summaries.feature_summaries(original(spark, sf), imp.unionByName(constant), 8)


@query("x1_text_functions", with_(oracle.ORDERS, "SELECT index, round(46e0+CAST((index*7919)%5000 AS DOUBLE)/1000,3) AS lat, regexp_replace('log10(Rb/Sr):' || CAST(index AS VARCHAR), '[\\\\/:*?\"<>|]', '_', 'g') AS file FROM s"))
def x1(spark, sf):
    s = base.order_samples(spark, sf)
    key = position_key(rounded("lat", 3), rounded("lon", 3))
    return s.select("index", F.substring_index(key, ",", 1).cast("double").alias("lat"),
                    safe_file_name(F.concat(F.lit("log10(Rb/Sr):"), F.col("index").cast("string"))).alias("file"))


@query("x2_alpha", with_(oracle.ORDERS, f"SELECT index, {oracle.ALPHA.format(lat='(lat-46e0)*18-0.5e0')} AS alpha FROM s"))
def x2(spark, sf):
    return base.order_samples(spark, sf).select("index", alpha((F.col("lat") - 46.0) * 18 - 0.5).alias("alpha"))
