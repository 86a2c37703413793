"""The method registry: canonical parameter text, ids, validity, and result sets.

Registry tables are immutable snapshots: every operator takes one and returns the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridfill.functions.text import params_text
from gridfill.session import materialize

REGISTRY_SCHEMA = ("method_id long, method_name string, params string, dataset_name string, grid_length double, "
                   "feature_name string, aggregate_func string, is_valid boolean")
IDENTITY = ["method_name", "params", "dataset_name", "grid_length", "feature_name", "aggregate_func"]

# Short method names, the function each of them runs, and the parameter values on offer.
METHOD_FUNCTIONS = {"krige": "kriging", "rbf": "rbf", "nn": "nearest_neighbour", "idw": "idw"}
METHOD_PARAMS = {
    "nn": {},
    "polynomial": {"n_closest_points": ["5", "16"], "degree": ["2", "3"]},
    "rbf": {"function": ["multiquadric", "gaussian", "linear"]},
    "triangle": {},
    "min_curvature": {},
    "DM": {"function": ["min", "max", "Q1", "Q3", "mean", "var", "std", "median"]},
    "natural_neighbor": {},
}


def function_of(method_name: str) -> str:
    """Name -> function by the fixed map; an unknown name is an error."""
    if method_name not in METHOD_FUNCTIONS:
        raise ValueError(f"method {method_name!r} is not known; use one of {sorted(METHOD_FUNCTIONS)}")
    return METHOD_FUNCTIONS[method_name]


# Whole numbers that must be positive, wherever a method takes them.
COUNTS = ("n_closest_points", "degree", "tile")


def check_params(method_name: str, params: dict) -> None:
    """Reject values of the wrong kind. METHOD_PARAMS is a catalogue of common values, not a limit; functions are
    checked by name where they run."""
    for key in COUNTS:
        if key in params:
            try:
                fine = int(params[key]) == float(params[key]) and int(params[key]) > 0
            except (TypeError, ValueError):
                fine = False
            if not fine:
                raise ValueError(f"{method_name}.{key}={params[key]!r} is not a positive whole number")


def params_string(params: dict) -> str | None:
    """The canonical text for one parameter dict on the driver."""
    if not params:
        return None
    keys = sorted(params)
    return ",".join(map(str, keys)) + ":" + ",".join(str(params[k]) for k in keys)


def empty_registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], REGISTRY_SCHEMA)


def with_params_text(df: DataFrame, params: str = "params") -> DataFrame:
    """Replace a map<string,string> column by its canonical text."""
    return df.withColumn(params, params_text(F.col(params)))


def register(registry: DataFrame, new: DataFrame, dedupe: bool = True) -> DataFrame:
    """Registry plus the new methods, numbered on from its highest id.

    dedupe leaves out rows that are already there (NULL params equal NULL). A registry has one row per
    method run, so numbering its new rows in one window is bounded.
    """
    rows = new.select(*IDENTITY)
    if dedupe:
        same = [F.col(f"n.{c}").eqNullSafe(F.col(f"r.{c}")) for c in IDENTITY]
        rows = rows.dropDuplicates().alias("n").join(registry.alias("r"), same, "left_anti")
    last = registry.agg(F.max("method_id")).first()[0] or 0
    number = F.row_number().over(Window.orderBy(*[F.col(c).asc_nulls_first() for c in IDENTITY]))
    added = rows.select(
        (F.lit(last) + number).cast("long").alias("method_id"), *IDENTITY, F.lit(True).alias("is_valid"))
    return registry.unionByName(added)


def set_validity(registry: DataFrame, method_id: int, valid: bool) -> DataFrame:
    return registry.withColumn("is_valid", F.when(F.col("method_id") == method_id, F.lit(valid)).otherwise(F.col("is_valid")))


def next_method_id(result: DataFrame) -> DataFrame:
    return result.agg((F.coalesce(F.max("method_id"), F.lit(0)) + 1).cast("long").alias("method_id"))


def start_result(boxes: DataFrame, registry: DataFrame) -> DataFrame:
    """Every box of the grid, without a value, for every method registered for its dataset and resolution.

    The methods of a dataset and resolution are numbered; each box is exploded into as many numbers as there are methods (one count per dataset
    and resolution comes to the driver) and joined with them by number, so the registry itself stays on Spark.
    """
    place = ["dataset_name", "grid_length"]
    number = F.row_number().over(Window.partitionBy(*place).orderBy("method_id"))
    methods = materialize(registry.select("method_id", *place, F.col("feature_name").alias("name"), number.alias("_m")))
    count = F.lit(0)
    for dataset, length, n in methods.groupBy(*place).agg(F.count("*").alias("n")).collect():
        count = F.when((F.col("datasetName") == dataset) & (F.col("grid_length") == length), n).otherwise(count)
    each = boxes.withColumn("_m", F.explode(F.when(count > 0, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>"))))
    return each.join(methods.withColumnRenamed("dataset_name", "datasetName"), ["datasetName", "grid_length", "_m"]).select(
        "datasetName", "name", "box_index", "box_lat", "box_lon", F.lit(None).cast("double").alias("value"), "method_id")


def validity_from_result(registry: DataFrame, result: DataFrame) -> DataFrame:
    """Valid where the method's result has no box without a value left."""
    status = result.groupBy("method_id").agg((F.count_if(F.col("value").isNull()) == 0).alias("_ok"))
    return registry.join(status, "method_id", "left").withColumn(
        "is_valid", F.coalesce("_ok", "is_valid")).drop("_ok")
