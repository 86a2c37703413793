"""Neighbour search on grid cells: the 3x3 ring join, exact k nearest, and the window join.

A target never meets samples through anything but an equi join on cell keys. Which cells a target
looks at is decided on cell counts alone, which are far smaller than samples and targets:

1. Count samples per cell at every level (cell side = 2^level boxes).
2. A target cell takes the finest level whose 3x3 ring holds enough samples.
3. Ring search uses that ring. Exact search derives an upper bound of the k-th distance from the
   counts and keeps every cell that could hold anything nearer.
4. Target cells that would still see too many pairs are split into quarters, together with the cells
   they look at, and pruned again. Nothing is dropped: pruning only removes cells that provably hold no neighbour.
5. The samples of those cells are gathered once per target cell and joined to its targets, and each
   target sorts what it was given.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridfill.functions.geo import alpha, alpha_value, euclidean
from gridfill.operators.grid import Grid
from gridfill.operators.tiles import rolled_up
from gridfill.session import materialize

KEYS = ["datasetName", "name"]
T_CELL = ["home", "level", "tcx", "tcy"]     # home: the level chosen in step 2; level: after splitting
S_CELL = ["level", "scx", "scy"]
MAX_PAIRS = 1 << 20     # (target, sample) pairs of one target cell above which it is split
MIN_LEVEL = -24         # cells smaller than this fraction of a box are not split further
SLACK = 1e-9            # relative allowance for rounding in the pruning bounds


# ---------------------------------------------------------------- distances and collectors

def point_distance(lat1: Column, lon1: Column, lat2: Column, lon2: Column, metric: str = "alpha") -> Column:
    """Degrees, or degrees times the km factor at the first point's latitude."""
    d = euclidean(lat2 - lat1, lon2 - lon1)
    return alpha(lat1) * d if metric == "alpha" else d


def nearest_pairs(pairs: DataFrame, target_keys: list[str], k: int) -> DataFrame:
    """First k rows per target by (dist, index). Spark adds a partial limit before the shuffle."""
    w = Window.partitionBy(*target_keys).orderBy("dist", "index")
    return pairs.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).drop("_rn")


def collect_neighbours(pairs: DataFrame, target_keys: list[str], k: int,
                       fields: tuple[str, ...] = ("dist", "index", "lat", "lon", "value")) -> DataFrame:
    """One row per target with its k nearest as an array of structs, nearest first."""
    top = nearest_pairs(pairs, target_keys, k)
    rest = [c for c in pairs.columns if c not in {*target_keys, *fields}]
    carried = [F.first(c).alias(c) for c in rest]
    return top.groupBy(*target_keys).agg(*carried, F.sort_array(F.collect_list(F.struct(*fields))).alias("neighbors"))


def neighbour_ids(df: DataFrame, k: int) -> DataFrame:
    """Ids only, NULL where there are fewer than k."""
    ids = F.transform("neighbors", lambda n: n["index"])
    return df.withColumn("neigh", F.when(F.size("neighbors") >= k, ids)).drop("neighbors")


# ---------------------------------------------------------------- cells

def _place(df: DataFrame, grid: Grid, lat: str, lon: str) -> DataFrame:
    """Position in box units. Box centres come from integers, so equal distances are equal in bits."""
    if {"u", "v"} <= set(df.columns):
        return df
    if {"box_x", "box_y"} <= set(df.columns):
        return df.withColumns({"u": F.col("box_x") + F.lit(0.5), "v": F.col("box_y") + F.lit(0.5)})
    return df.withColumns({"u": (F.col(lat) - F.lit(grid.lat_min)) / F.lit(grid.lat_gap),
                           "v": (F.col(lon) - F.lit(grid.lon_min)) / F.lit(grid.lon_gap)})


def _cell(position: Column, level) -> Column:
    side = F.pow(F.lit(2.0), level) if isinstance(level, Column) else F.lit(2.0 ** level)
    return F.floor(position / side).cast("long")


def _up(cell: Column, level: Column, base: int) -> Column:
    return F.floor(cell / F.pow(F.lit(2.0), level - F.lit(base))).cast("long")


def cell_offsets(reach_x: int, reach_y: int) -> Column:
    """Generator of every (dx, dy) up to the reach; folded to a constant by the optimizer."""
    return F.expr(f"""explode(flatten(transform(sequence(-{reach_x}L, {reach_x}L), dx ->
        transform(sequence(-{reach_y}L, {reach_y}L), dy -> named_struct('dx', dx, 'dy', dy)))))""")


def _bounds_between(grid: Grid, metric: str) -> tuple[Column, Column]:
    """Smallest and largest possible distance between a point of the target cell and one of the sample cell."""
    side = F.pow(F.lit(2.0), F.col("level"))
    gx, gy = F.abs(F.col("scx") - F.col("tcx")), F.abs(F.col("scy") - F.col("tcy"))
    h, w = side * F.lit(grid.lat_gap), side * F.lit(grid.lon_gap)
    near = euclidean(F.greatest(gx - 1, F.lit(0)) * h, F.greatest(gy - 1, F.lit(0)) * w)
    far = euclidean((gx + 1) * h, (gy + 1) * w)
    if metric == "alpha":
        south = F.lit(grid.lat_min) + F.col("scx") * h
        north = south + h
        low = F.when((south <= 0) & (north >= 0), F.lit(0.0)).otherwise(F.least(F.abs(south), F.abs(north)))
        high = F.least(F.greatest(F.abs(south), F.abs(north)), F.lit(90.0))
        near, far = near * alpha(high + F.lit(1e-9)), far * alpha(F.least(F.greatest(low - F.lit(1e-9), F.lit(0.0)), F.lit(90.0)))
    return near * F.lit(1 - SLACK), far * F.lit(1 + SLACK)


def cell_counts(samples: DataFrame, base: int, top: int) -> DataFrame:
    """Samples per cell at every level: counted once in the finest cells, then rolled up from those counts."""
    finest = samples.groupBy(*KEYS, _cell(F.col("u"), base).alias("cx"), _cell(F.col("v"), base).alias("cy")).agg(F.count("*").alias("n"))
    return rolled_up(finest, base, top)


def _home_levels(targets: DataFrame, counts: DataFrame, need: int, base: int, top: int, exact: bool) -> DataFrame:
    """Finest target cells with the level they search at: (keys, x0, y0, nt, home, most).

    `most` bounds the samples any of their targets can meet: the ring two levels up (four times as
    wide) covers every cell within reach of the search.
    """
    ring = (counts.withColumn("_o", cell_offsets(1, 1))
            .groupBy(*KEYS, "level", (F.col("cx") + F.col("_o.dx")).alias("tcx"), (F.col("cy") + F.col("_o.dy")).alias("tcy"))
            .agg(F.sum("n").alias("ring_n")))
    cells = targets.groupBy(*KEYS, "x0", "y0").agg(F.count("*").alias("nt"))
    climbed = cells.withColumn("level", F.explode(F.sequence(F.lit(base), F.lit(top)))).withColumns({
        "tcx": _up(F.col("x0"), F.col("level"), base), "tcy": _up(F.col("y0"), F.col("level"), base)})
    hit = climbed.join(ring, [*KEYS, "level", "tcx", "tcy"], "left")
    levels = range(base, top + 1)
    wide = hit.groupBy(*KEYS, "x0", "y0").agg(
        F.first("nt").alias("nt"), *[F.expr(f"max(CASE WHEN level = {lv} THEN ring_n END) AS _n{lv}") for lv in levels])
    first = ", ".join(f"CASE WHEN _n{lv} >= {need} THEN {lv} END" for lv in levels)
    # exact: with fewer samples than k in all, look at everything there is
    home = F.expr(f"coalesce({first}{f', {top}' if exact else ''})")
    most = F.expr(f"coalesce({', '.join(f'CASE WHEN home = {lv} THEN _n{min(lv + 2, top)} END' for lv in levels)}, 0L)")
    return (wide.withColumn("home", home).where(F.col("home").isNotNull()).withColumn("most", most)
            .select(*KEYS, "x0", "y0", "nt", "home", "most"))


def _prune(relation: DataFrame, grid: Grid, k: int, metric: str) -> DataFrame:
    """Drop cells that are farther than k samples surely are; keep the relation's columns."""
    near, far = _bounds_between(grid, metric)
    cell = Window.partitionBy(*KEYS, *T_CELL)
    upto = cell.orderBy("_far").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (relation.withColumns({"_near": near, "_far": far})
            .withColumn("_cum", F.sum("n").over(upto))
            .withColumn("_bound", F.min(F.when(F.col("_cum") >= k, F.col("_far"))).over(cell))
            .where(F.col("_bound").isNull() | (F.col("_near") <= F.col("_bound")))
            .drop("_near", "_far", "_cum", "_bound"))


def _reach(grid: Grid, metric: str) -> tuple[int, int]:
    """How many cells the k-th neighbour can lie away when the 3x3 ring holds k samples."""
    h, w = grid.lat_gap, grid.lon_gap
    worst = 2 * math.hypot(h, w)
    if metric == "alpha":
        low = alpha_value(max(abs(grid.lat_min), abs(grid.lat_max)) + 1)
        high = alpha_value(0.0 if grid.lat_min <= 0 <= grid.lat_max else max(min(abs(grid.lat_min), abs(grid.lat_max)) - 1, 0))
        if low <= 0 or high / low > 8:
            raise ValueError("exact search by the km metric needs a latitude range without the poles; use metric='degrees'")
        worst *= high / low
    return math.ceil(worst / h), math.ceil(worst / w)


def _at_levels(points: DataFrame, levels: Column, x: str, y: str) -> DataFrame:
    """One row per point and level, with the cell it lies in."""
    return points.withColumn("level", F.explode(levels)).withColumns({
        x: _cell(F.col("u"), F.col("level")), y: _cell(F.col("v"), F.col("level"))})


def _levels_of_home(used: list[tuple[int, int]]) -> Column:
    """Array of the levels in use for a row's home level."""
    table = F.array(*[F.struct(F.lit(h).alias("h"), F.lit(lv).alias("lv")) for h, lv in used])
    return F.transform(F.filter(table, lambda e: e["h"] == F.col("home")), lambda e: e["lv"])


def _split(relation: DataFrame, samples: DataFrame, targets: DataFrame, grid: Grid, k: int, metric: str,
           used: list[tuple[int, int]]) -> DataFrame:
    """Quarter both sides of the given relation and prune."""
    child = F.col("level") - 1

    def children(points: DataFrame, cell: list[str], x: str, y: str, n: str) -> DataFrame:
        return (points.join(relation.select(*KEYS, *cell).distinct(), [*KEYS, *cell], "left_semi")
                .groupBy(*KEYS, *cell, _cell(F.col("u"), child).alias(f"{x}_c"), _cell(F.col("v"), child).alias(f"{y}_c"))
                .agg(F.count("*").alias(n)))

    levels = F.array(*[F.lit(lv) for lv in sorted({lv for _, lv in used})])
    s_child = children(_at_levels(samples, levels, "scx", "scy"), S_CELL, "scx", "scy", "n")
    t_child = children(_at_levels(targets, _levels_of_home(used), "tcx", "tcy"), T_CELL, "tcx", "tcy", "nt")
    pairs = (relation.drop("n", "nt").join(s_child, [*KEYS, *S_CELL]).join(t_child, [*KEYS, *T_CELL])
             .select(*KEYS, "home", child.cast("int").alias("level"), F.col("tcx_c").alias("tcx"), F.col("tcy_c").alias("tcy"),
                     "nt", F.col("scx_c").alias("scx"), F.col("scy_c").alias("scy"), "n"))
    return _prune(pairs, grid, k, metric)


def plan_cells(targets: DataFrame, samples: DataFrame, grid: Grid, k: int, *, metric: str, exact: bool,
               need: int, start_level: int, max_pairs: int = MAX_PAIRS) -> tuple[DataFrame, DataFrame, list[tuple[int, int]]]:
    """Which sample cells each target cell looks at: (targets with home, relation, (home, level) pairs in use).

    Only counts per cell take part; the driver sees one row per level.
    """
    top = max(start_level, math.ceil(math.log2(max(grid.x_num, grid.y_num, 2))))
    counts = cell_counts(samples, start_level, top)
    based = targets.withColumns({"x0": _cell(F.col("u"), start_level), "y0": _cell(F.col("v"), start_level)})
    homes = materialize(_home_levels(based, counts, need, start_level, top, exact))
    cells = homes.groupBy(*KEYS, "home", _up(F.col("x0"), F.col("home"), start_level).alias("tcx"),
                          _up(F.col("y0"), F.col("home"), start_level).alias("tcy")).agg(F.sum("nt").alias("nt"))
    reach = _reach(grid, metric) if exact else (1, 1)
    around = cells.withColumn("_o", cell_offsets(*reach)).select(
        *KEYS, "home", F.col("home").alias("level"), "tcx", "tcy", "nt",
        (F.col("tcx") + F.col("_o.dx")).alias("scx"), (F.col("tcy") + F.col("_o.dy")).alias("scy"))
    relation = around.join(counts.withColumnsRenamed({"cx": "scx", "cy": "scy"}), [*KEYS, *S_CELL])
    relation = relation.select(*KEYS, *T_CELL, "nt", "scx", "scy", "n")
    if exact:
        relation = _prune(relation, grid, k, metric)
    at_home = based.join(homes.drop("nt", "most"), [*KEYS, "x0", "y0"]).drop("x0", "y0")
    bound = (homes.groupBy(*KEYS, "home", _up(F.col("x0"), F.col("home"), start_level), _up(F.col("y0"), F.col("home"), start_level))
             .agg((F.sum("nt") * F.max("most")).alias("load")).groupBy("home").agg(F.max("load").alias("load")).collect())
    if max(reach) <= 4 and all(r["load"] <= max_pairs for r in bound):
        return at_home, relation, sorted((r["home"], r["home"]) for r in bound)
    done, pending = None, materialize(relation)
    used: set[tuple[int, int]] = set()
    while True:
        load = pending.groupBy(*KEYS, *T_CELL).agg((F.first("nt") * F.sum("n")).alias("load"))
        too_much = (F.col("load") > max_pairs) & (F.col("level") > MIN_LEVEL)
        summary = load.groupBy("home", "level").agg(
            F.count_if(too_much).alias("heavy"), F.count_if(~too_much).alias("light")).collect()
        used |= {(r["home"], r["level"]) for r in summary if r["light"]}
        split = [(r["home"], r["level"]) for r in summary if r["heavy"]]
        if not split:
            return at_home, pending if done is None else done.unionByName(pending), sorted(used)
        heavy = load.where(too_much).select(*KEYS, *T_CELL)
        light = pending.join(heavy, [*KEYS, *T_CELL], "left_anti")
        done = light if done is None else done.unionByName(light)
        pending = materialize(_split(pending.join(heavy, [*KEYS, *T_CELL], "left_semi"), samples, at_home, grid, k, metric, split))


# ---------------------------------------------------------------- searches

def _with_candidates(targets: DataFrame, samples: DataFrame, grid: Grid, k: int, *, metric: str, exact: bool,
                     need: int, start_level: int, max_pairs: int) -> DataFrame:
    """Targets (with u, v) and `cands`: all samples of the cells their target cell looks at.

    The array is built once per target cell, not per target, so (target, sample) pairs are never shuffled.
    Splitting keeps an array below max_pairs / number of targets of its cell.
    """
    placed_t = _place(targets, grid, "box_lat", "box_lon")
    placed_s = _place(samples.where(F.col("value").isNotNull()), grid, "lat", "lon").select(
        *KEYS, "index", "lat", "lon", "value", "u", "v")
    if not {"box_x", "box_y"} <= set(samples.columns):
        # Of samples stacked on one position only the first k by index can ever be among k nearest.
        stack = Window.partitionBy(*KEYS, "u", "v").orderBy("index")
        placed_s = placed_s.withColumn("_rn", F.row_number().over(stack)).where(F.col("_rn") <= k).drop("_rn")
    at_home, relation, used = plan_cells(placed_t, placed_s, grid, k, metric=metric, exact=exact,
                                         need=need, start_level=start_level, max_pairs=max_pairs)
    levels = sorted({lv for _, lv in used}) or [start_level]
    if all(h == lv for h, lv in used):
        found = at_home.withColumn("level", F.col("home")).withColumns({
            "tcx": _cell(F.col("u"), F.col("level")), "tcy": _cell(F.col("v"), F.col("level"))})
    else:
        found = _at_levels(at_home, _levels_of_home(used), "tcx", "tcy").join(
            relation.select(*KEYS, *T_CELL).distinct(), [*KEYS, *T_CELL], "left_semi")
    s_at = _at_levels(placed_s, F.array(*[F.lit(lv) for lv in levels]), "scx", "scy")
    entry = F.struct(F.col("u").alias("su"), F.col("v").alias("sv"), "index", "lat", "lon", "value")
    seen = (relation.select(*KEYS, *T_CELL, "scx", "scy").join(s_at, [*KEYS, *S_CELL])
            .groupBy(*KEYS, *T_CELL).agg(F.collect_list(entry).alias("cands")))
    return found.join(seen, [*KEYS, *T_CELL])


def knn(targets: DataFrame, samples: DataFrame, grid: Grid, k: int, *, metric: str = "degrees", exact: bool = True,
        need: int | None = None, start_level: int = 1, max_pairs: int = MAX_PAIRS) -> DataFrame:
    """Targets with `neighbors`: up to k samples of the same dataset and feature, nearest first.

    `targets`: datasetName, name, box_index, box_lat, box_lon and any further columns (box_x, box_y for box centres).
    `samples`: datasetName, name, index, lat, lon, value (box_x, box_y for box values).
    exact=True gives the true k nearest; exact=False the nearest within the first ring, from
    `start_level` upwards, that holds `need` samples. Targets with no such ring get an empty array.
    """
    target_cols = [c for c in targets.columns if c not in ("u", "v")]
    # The reach of an exact search stands on a ring that holds k samples; fewer would leave out cells with nearer ones.
    need = k if exact or need is None else need
    cands = _with_candidates(targets, samples, grid, k, metric=metric, exact=exact, need=need,
                             start_level=start_level, max_pairs=max_pairs)

    def distance(c: Column) -> Column:
        d = euclidean((c["su"] - F.col("u")) * F.lit(grid.lat_gap), (c["sv"] - F.col("v")) * F.lit(grid.lon_gap))
        return alpha(c["lat"]) * d if metric == "alpha" else d

    order = F.sort_array(F.transform("cands", lambda c, i: F.named_struct(
        F.lit("dist"), distance(c), F.lit("index"), c["index"], F.lit("at"), i)))
    nearest = F.transform(F.slice(order, 1, k), lambda o: F.named_struct(
        F.lit("dist"), o["dist"], F.lit("index"), o["index"],
        *[x for f in ("lat", "lon", "value") for x in (F.lit(f), F.get("cands", o["at"])[f])]))
    # explode of a one-element array: later filters and projections on `neighbors` must not be merged into
    # this projection, where Catalyst would repeat the sort for each of their references.
    found = cands.select(*target_cols, F.explode(F.array(nearest)).alias("neighbors"))
    # The coarsest ring covers the whole grid, so only features with too few samples are left out.
    enough = (samples.where(F.col("value").isNotNull()).groupBy(*KEYS).agg(F.count("*").alias("_n"))
              .where(F.col("_n") >= (1 if exact else need)).select(*KEYS))
    without = targets.select(*target_cols).join(enough, KEYS, "left_anti").withColumn(
        "neighbors", F.array().cast(found.schema["neighbors"].dataType))
    return found.unionByName(without)


def search_levels(targets: DataFrame, samples: DataFrame, grid: Grid, need: int, start_level: int = 1) -> DataFrame:
    """Targets with the level of the ring search that fills them: the first one, from `start_level` upwards, whose 3x3 ring holds `need`
    samples. Targets that no level fills are left out. Only counts per cell take part."""
    placed = _place(targets, grid, "box_lat", "box_lon")
    known = _place(samples.where(F.col("value").isNotNull()), grid, "lat", "lon")
    at_home, _, _ = plan_cells(placed, known, grid, need, metric="degrees", exact=False, need=need, start_level=start_level)
    return at_home.select(*targets.columns, F.col("home").alias("level"))


def ring_members(targets: DataFrame, samples: DataFrame, ratio: int) -> DataFrame:
    """Every (target box, sample) pair of the 3x3 ring of cells `ratio` boxes wide, at one level.

    The samples are copied to the nine cells that see them, so one equi join serves all targets.
    """
    cell = lambda c: F.floor(F.col(c) / F.lit(ratio))
    spread = (samples.withColumn("_o", cell_offsets(1, 1))
              .select(*KEYS, (cell("box_x") + F.col("_o.dx")).alias("px"), (cell("box_y") + F.col("_o.dy")).alias("py"),
                      "index", "lat", "lon", "value"))
    return targets.withColumns({"px": cell("box_x"), "py": cell("box_y")}).join(spread, [*KEYS, "px", "py"]).drop("px", "py")


def window_members(targets: DataFrame, samples: DataFrame, radius: int) -> DataFrame:
    """(target box, sample) pairs no more than `radius` boxes apart on either axis."""
    renamed = samples.withColumnsRenamed({"box_x": "sample_x", "box_y": "sample_y"})
    cell = lambda c: F.floor(F.col(c) / F.lit(radius))
    spread = (renamed.withColumn("_o", cell_offsets(1, 1))
              .select(*KEYS, (cell("sample_x") + F.col("_o.dx")).alias("px"), (cell("sample_y") + F.col("_o.dy")).alias("py"),
                      "sample_x", "sample_y", "index", "lat", "lon", "value"))
    near = (F.abs(F.col("sample_x") - F.col("box_x")) <= radius) & (F.abs(F.col("sample_y") - F.col("box_y")) <= radius)
    return (targets.withColumns({"px": cell("box_x"), "py": cell("box_y")})
            .join(spread, [*KEYS, "px", "py"]).where(near).drop("px", "py"))
