"""Box means and medians, exact quantiles that survive hot groups, and the joins of boxes with means."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridfill.operators.grid import Grid
from gridfill.session import materialize

KEYS = ["datasetName", "name"]
PARTITION = 1 << 18     # (group, value) counts of one range partition

def exact_quantiles(df: DataFrame, keys: Sequence[str], probs: dict[str, float], value: str = "value") -> DataFrame:
    """Exact, linearly interpolated quantiles per group; one way for groups of any size.

    Equal values are counted first, a batch at a time, so no task holds more than a batch however many values differ. The counts are sorted into
    range partitions by (group, value), whose number follows the counts, so a large group spreads over as many partitions as it fills, and there
    the counts of equal values from different batches are added up. A partition answers for the groups that lie inside it. Of the
    groups that reach over its borders it hands on running counts; how many values stand before each
    partition then tells where their ranks are. NaN counts as larger than any number.
    """
    keys = list(keys)
    spark = df.sparkSession
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    rows = rows.withColumn("_g", F.to_json(F.struct(*keys)) if keys else F.lit(""))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = pa.table({"_g": batch.column(batch.schema.get_field_index("_g")), "_v": batch.column(batch.schema.get_field_index("_v")), "at": np.arange(len(batch))})
            found = pairs.group_by(["_g", "_v"], use_threads=False).aggregate([("at", "min"), ("at", "count")])
            first = batch.take(found.column("at_min").combine_chunks())
            yield pa.RecordBatch.from_arrays([*first.columns, found.column("at_count").combine_chunks()], [*first.schema.names, "_n"])

    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    counted = materialize(rows.mapInArrow(count, f"{kinds}{', ' if keys else ''}_v double, _g string, _n long"))
    names, wanted = list(probs), list(probs.values())

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if len(b)]
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        # Equal values of a group stand beside each other; they become one row with the sum of their counts.
        group, value = table.column("_g"), table.column("_v").to_numpy()
        other = pc.not_equal(group.slice(1), group.slice(0, len(group) - 1)).to_numpy(zero_copy_only=False)
        runs = np.flatnonzero(np.concatenate([[True], other | ((value[1:] != value[:-1]) & ~(np.isnan(value[1:]) & np.isnan(value[:-1])))]))
        n = np.add.reduceat(table.column("_n").to_numpy(), runs)
        table = table.take(runs)
        group, value, upto = table.column("_g"), table.column("_v").to_numpy(), np.cumsum(n)
        starts = np.flatnonzero(np.concatenate([[True], pc.not_equal(group.slice(1), group.slice(0, len(group) - 1)).to_numpy(zero_copy_only=False)]))
        before = upto[starts] - n[starts]
        total = np.append(before[1:], upto[-1]) - before
        inner = slice(1, max(1, len(starts) - 1))
        first, base, size = starts[inner], before[inner], total[inner]
        border = np.zeros(len(n), bool)
        border[: starts[1] if len(starts) > 1 else len(n)] = True
        border[starts[-1]:] = True
        at = np.concatenate([first, np.flatnonzero(border)])
        none, k = np.full(border.sum(), np.nan), len(first)
        out = {c: table.column(c).take(at) for c in keys}
        for name, p in zip(names, wanted):
            rank = (size - 1) * p
            low, high = (value[np.searchsorted(upto, base + f(rank).astype(np.int64), "right")] if k else np.empty(0) for f in (np.floor, np.ceil))
            same = low == high  # infinities must not be subtracted
            with np.errstate(invalid="ignore"):
                part = np.where(same, low, low + (high - low) * (rank - np.floor(rank)))
            out[name] = pa.array(np.concatenate([part, none]))
        out["_v"] = pa.array(np.concatenate([np.full(k, np.nan), value[border]]))
        out["_n"] = pa.array(np.concatenate([np.zeros(k, np.int64), n[border]]))
        out["_upto"] = pa.array(np.concatenate([np.zeros(k, np.int64), (upto - np.repeat(before, np.diff(np.append(starts, len(n)))))[border]]))
        out["_g"] = group.take(at)
        out["_part"] = pa.array(np.full(len(at), TaskContext.get().partitionId(), np.int32))
        yield from pa.table({c: out[c] for c in (*keys, *names, "_v", "_n", "_upto", "_g", "_part")}).to_batches()

    schema = f"{kinds}{', ' if keys else ''}{', '.join(f'`{o}` double' for o in names)}, _v double, _n long, _upto long, _g string, _part int"
    # A partition's groups are answered at once, so a partition must be small: its number follows the number of counts.
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1 + counted.count() // PARTITION)
    found = materialize(counted.repartitionByRange(parts, "_g", "_v").sortWithinPartitions("_g", "_v").mapInArrow(select, schema))
    border = found.where("_n > 0")
    pieces = border.groupBy("_g", "_part").agg(F.sum("_n").alias("_there"))
    order = Window.partitionBy("_g").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumns({"_before": F.coalesce(F.sum("_there").over(order), F.lit(0)), "_all": F.sum("_there").over(Window.partitionBy("_g"))})
    ranked = border.join(pieces, ["_g", "_part"]).withColumn("_to", F.col("_before") + F.col("_upto"))
    marks, values = [], []
    for o, p in probs.items():
        rank = (F.col("_all") - 1) * F.lit(float(p))
        for f, end in ((F.floor, "lo"), (F.ceil, "hi")):
            here = (F.col("_to") - F.col("_n") <= f(rank)) & (f(rank) < F.col("_to"))
            marks.append(F.max(F.when(here, F.col("_v"))).alias(f"_{end}_{o}"))
        whole = (F.col("_size") - 1) * F.lit(float(p))
        low, high = F.col(f"_lo_{o}"), F.col(f"_hi_{o}")
        values.append(F.when(low == high, low).otherwise(low + (high - low) * (whole - F.floor(whole))).alias(o))
    over = ranked.groupBy("_g", *keys).agg(F.max("_all").alias("_size"), *marks).select(*keys, *values)
    return found.where("_n = 0").select(*keys, *names).unionByName(over)


def box_values(long: DataFrame, grid: Grid, aggr_func: str = "mean") -> DataFrame:
    """Mean or median of each (dataset, feature, box), placed at the box centre.

    The box columns are computed from the position, so the samples need no join with a map table. Samples outside the
    grid's bounds have no box and are left out; `outside` counts them.
    """
    assigned = grid.assign(long.where(F.col("datasetName") == grid.dataset)).where(F.col("box_index").isNotNull())
    keys = [*KEYS, "box_indx", "box_indy", "box_index"]
    if aggr_func == "mean":
        values = assigned.groupBy(*keys).agg(F.avg("value").alias("value"))
    else:
        values = exact_quantiles(assigned, keys, {"value": 0.5})
    return values.select(
        *KEYS, F.col("box_index").alias("index"), F.col("box_indx").alias("box_x"), F.col("box_indy").alias("box_y"),
        grid.centre_lat(F.col("box_indx")).alias("lat"), grid.centre_lon(F.col("box_indy")).alias("lon"), "value",
        F.lit(grid.grid_length).alias("grid_length"), F.lit(aggr_func).alias("aggregate_func"))


def outside(long: DataFrame, grid: Grid) -> DataFrame:
    """(datasetName, name, n): samples that the grid has no box for."""
    lost = grid.assign(long.where(F.col("datasetName") == grid.dataset)).where(F.col("box_index").isNull())
    return lost.groupBy(*KEYS).agg(F.count("*").alias("n"))


def values_on_coarser(means: DataFrame, grid: Grid, aggr_func: str = "mean") -> DataFrame:
    """Value of the boxes of `grid` that contain box means of a finer origin grid."""
    return box_values(means.select(*KEYS, "index", "lat", "lon", "value"), grid, aggr_func)


def join_map(samples: DataFrame, box_map: DataFrame) -> DataFrame:
    """Samples with their box, by the full key."""
    return samples.join(box_map.select("datasetName", "index", "box_index"), ["datasetName", "index"])


def feature_boxes(boxes: DataFrame, features: DataFrame) -> DataFrame:
    """Every box for every feature of its dataset.

    The features of all datasets are a short list, one entry per measured column. It comes to the driver and each
    box is exploded into its dataset's features where it is: no join, so no cartesian plan when the dataset is a literal.
    """
    names: dict[str, list[str]] = {}
    for dataset, name in features.select(*KEYS).distinct().collect():
        names.setdefault(dataset, []).append(name)
    own = F.array().cast("array<string>")
    for dataset, found in names.items():
        own = F.when(F.col("datasetName") == dataset, F.array(*map(F.lit, sorted(found)))).otherwise(own)
    return boxes.withColumn("name", F.explode(own))


def boxes_with_values(boxes: DataFrame, means: DataFrame) -> DataFrame:
    """Boxes of every feature, with the box value or NULL."""
    wanted = feature_boxes(boxes, means)
    values = means.select(*KEYS, F.col("index").alias("box_index"), "value")
    return wanted.join(values, [*KEYS, "box_index"], "left")


def boxes_to_search(boxes: DataFrame, means: DataFrame) -> DataFrame:
    """Boxes that still have no value."""
    wanted = feature_boxes(boxes, means)
    return wanted.join(means.select(*KEYS, F.col("index").alias("box_index")), [*KEYS, "box_index"], "left_anti")


def fill_missing(current: DataFrame, computed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Known values stay; missing ones come from `computed` where it has them."""
    new = computed.select(*keys, F.col("value").alias("_new"))
    return current.join(new, list(keys), "left").withColumn("value", F.coalesce("value", "_new")).drop("_new")


def count_missing(result: DataFrame, keys: Sequence[str] = ("datasetName", "name")) -> DataFrame:
    return result.groupBy(*keys).agg(F.count_if(F.col("value").isNull()).alias("n_missing"))


def distinct_values(df: DataFrame, keys: Sequence[str] = ("datasetName", "name")) -> DataFrame:
    """Exact number of distinct values, counted in two steps so no group meets in one task."""
    return (df.where(F.col("value").isNotNull()).select(*keys, "value").distinct()
            .groupBy(*keys).agg(F.count("*").alias("n_distinct")))
