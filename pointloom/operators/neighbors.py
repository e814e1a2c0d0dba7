"""Exact neighbour joins on grid keys.

Distance joins become equi-joins: one side is copied to the adjacent grid cells,
the other stays in its own cell, and the distance is checked in the join
condition.  The copied side and the query side share the partitioning of the
cell, so aggregating or ranking per query needs no further shuffle.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import cell, squared_distance
from ..functions.groups import attach
from ..functions.lineage import cut, discard
from . import tiles, whole

XYZ = ("x", "y", "z")


# ------------------------------------------------------------------- whole scenes

def _complete(scene: str, dims) -> str:
    return " AND ".join(f"`{c}` IS NOT NULL" for c in [scene, *dims])


def large_scenes(scene: str, *tables: DataFrame) -> tuple[DataFrame | None, int]:
    """Scenes with more rows than a task may hold (None: there are none) and the number of all rows."""
    sizes = reduce(DataFrame.unionByName, [t.select(scene) for t in tables]).groupBy(scene).agg(F.count(F.lit(1)).alias("_n"))
    total, most = sizes.where(F.col(scene).isNotNull()).agg(F.coalesce(F.sum("_n"), F.lit(0)), F.coalesce(F.max("_n"), F.lit(0))).first()
    return (cut(sizes.where(F.col("_n") > whole.WHOLE).select(scene)) if most > whole.WHOLE else None), total


def parted(rows: DataFrame, large: DataFrame | None, scene: str) -> tuple[DataFrame, DataFrame | None]:
    """Rows of the small and of the large scenes."""
    if large is None:
        return rows, None
    return attach(rows, large, scene, "left_anti"), attach(rows, large, scene, "left_semi")


def in_scenes(rows: DataFrame, scene: str, total: int) -> DataFrame:
    """Rows dealt to tasks by scene and sorted by it; a task gets ``whole.FEWEST`` rows or more, and not many more than ``whole.DEALT``.

    The number is given, since adaptive execution would fold so few bytes into as many tasks as there are cores.
    """
    usual = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(1, min(usual, -(-total // whole.FEWEST)), -(-total // whole.DEALT))
    return rows.where(F.col(scene).isNotNull()).repartition(parts, scene).sortWithinPartitions(scene)


def _types(df: DataFrame, columns) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)


def _offsets(dims: int, reach: int = 1) -> Column:
    names = [f"o{i}" for i in range(dims)]
    return F.array(*[
        F.struct(*[F.lit(v).cast("long").alias(n) for v, n in zip(t, names)])
        for t in product(range(-reach, reach + 1), repeat=dims)
    ])


def _spread(df: DataFrame, cells: list[str]) -> DataFrame:
    """Copy every row to its own and all adjacent cells."""
    out = df.withColumn("_o", F.explode(_offsets(len(cells))))
    return out.withColumns({c: F.col(c) + F.col(f"_o.o{i}") for i, c in enumerate(cells)}).drop("_o")


# ------------------------------------------------------------- multi-level grid
#
# A scene's finest cells are numbered from its minimum corner; the cell index at
# level l is the fine index shifted right by l, so cells nest.  Level, x and y
# index are packed in one long and z is a second one (28 bits per axis, indices start
# at 1 so that the neighbour below exists): two keys sort, hash and compare fast.

_AXIS_BITS = 28
_CELL = ["_cell", "_cz"]
_DELTAS = [((a << _AXIS_BITS) + b, c) for a, b, c in product((-1, 0, 1), repeat=3)]
#: Target locations that a finest cell may hold.
_TARGETS = 4
#: Levels that a scene's grid gains at a time while a cell is crowded.
_FINER = 3
#: Multiple of the wanted neighbours that a finest cell of a neighbour search may hold: a task compares a cell at once.
_FULL = 16


def _scene_grid(df: DataFrame, base: float, scene: str, *extra: Column, per_cell: float = 0.0) -> DataFrame:
    """Per scene: corner, extent, cell width (coarser only beyond 2^27 cells) and narrowest width.

    With ``per_cell`` the width is at least that of cells which would hold so many rows if they filled the scene's box evenly.
    """
    spans = [F.max(a) - F.min(a) for a in XYZ]
    volume = spans[0] * spans[1] * spans[2]
    grid = df.groupBy(scene).agg(
        *[F.min(a).alias(f"_min_{a}") for a in XYZ], F.greatest(*spans).alias("_extent"),
        F.cbrt(volume * per_cell / F.count(F.lit(1))).alias("_even"), *extra
    )
    narrowest = F.col("_extent") / float(1 << (_AXIS_BITS - 1))
    return grid.withColumn("_base", F.greatest(F.lit(base), narrowest, "_even")).withColumn("_floor", narrowest).drop("_even")


def _top() -> Column:
    return (F.ceil(F.log2(F.col("_extent") / F.col("_base") + 2.0)) + 1).cast("int").alias("_top")


def _fine_index(axis: str) -> Column:
    return F.floor((F.col(axis) - F.col(f"_min_{axis}")) / F.col("_base")).cast("long").alias(f"_i_{axis}")


def _code(level: str) -> dict[str, Column]:
    """Packed cell keys at the level held by column ``level``."""
    x, y, z = [f"(shiftright(_i_{a}, {level}) + 1)" for a in XYZ]
    bits = _AXIS_BITS
    packed = F.expr(f"shiftleft(CAST({level} AS BIGINT), {2 * bits}) + shiftleft({x}, {bits}) + {y}")
    return {"_cell": packed, "_cz": F.expr(z)}


_FINE = [f"_i_{a}" for a in XYZ]


def _all_levels(cells: DataFrame, top: Column) -> DataFrame:
    return cells.withColumn("_l", F.explode(F.sequence(F.lit(0), top))).withColumns(_code("_l"))


def _around(cells: DataFrame, scene: str) -> DataFrame:
    """Each query cell with itself and its 26 neighbours: ``_cell, _cz`` (neighbour), ``_home, _home_z``."""
    deltas = F.explode(F.array(*[
        F.struct(F.lit(d).cast("long").alias("d"), F.lit(z).cast("long").alias("z")) for d, z in _DELTAS
    ]))
    return cells.select(scene, F.col("_cell").alias("_home"), F.col("_cz").alias("_home_z"), deltas.alias("_d")).select(
        scene, "_home", "_home_z", (F.col("_home") + F.col("_d.d")).alias("_cell"), (F.col("_home_z") + F.col("_d.z")).alias("_cz")
    )


def _fitted_grid(df: DataFrame, grid: DataFrame, crowd: int, scene: str, *extra: Column) -> tuple[DataFrame, DataFrame]:
    """``grid`` made finer per scene until no finest cell holds more than ``crowd`` rows, and the occupied cells.

    Each round divides the cell width of the scenes that still have a crowded cell.  It ends when
    none has, or when the width is 2^-27 of the scene's extent, which is as fine as cells can be numbered.
    """
    while True:
        grid = cut(grid)
        occupied = cut(
            attach(df, grid, scene, "inner").groupBy(*[_fine_index(a) for a in XYZ], scene)
            .agg(F.count(F.lit(1)).alias("_n"), F.first(_top()).alias("_top"), *extra)
        )
        crowded = cut(
            occupied.where(F.col("_n") > crowd).select(scene).distinct()
            .join(grid.where(F.col("_base") > F.col("_floor")).select(scene), scene).withColumn("_more", F.lit(True))
        )
        if crowded.isEmpty():
            discard(crowded)
            return grid, occupied
        discard(occupied)
        finer = F.greatest(F.col("_base") / float(1 << _FINER), F.col("_floor"))
        grid = grid.join(crowded, scene, "left").withColumn("_base", F.when(F.col("_more"), finer).otherwise(F.col("_base"))).drop("_more")


# --------------------------------------------------------------------------- kNN

_TILE = ["_tile", "_tz"]


def knn(
    df: DataFrame, k: int, include_self: bool = True, base_cell: float = 0.05,
    scene: str = "scene_id", key: str = "point_id",
) -> DataFrame:
    """Exact k nearest neighbours within each scene, one row a neighbour.

    Returns ``scene_id, point_id, x, y, z, rank, nbr_id, d2, nx, ny, nz`` with ties
    broken by ``nbr_id``.  With ``include_self`` the point itself competes like any
    other candidate; scenes with fewer than ``k`` points give all of them.  :func:`knn_lists` has the same as one row a point.
    """
    lists = knn_lists(df, k if include_self else k + 1, base_cell, scene, key)
    rows = lists.select(scene, key, *XYZ, F.posexplode(F.arrays_zip("ids", "d2s", "nx", "ny", "nz")).alias("_r", "_n"))
    rows = rows.select(scene, key, *XYZ, "_r", F.col("_n.ids").alias("nbr_id"), F.col("_n.d2s").alias("d2"), *[f"_n.n{a}" for a in XYZ])
    if include_self:
        return rows.select(scene, key, *XYZ, (F.col("_r") + 1).alias("rank"), "nbr_id", "d2", "nx", "ny", "nz")
    # Entries behind the point itself move up by one; where copies keep it out of its list, the last entry is one too many.
    place = F.coalesce(F.array_position("ids", F.col(key)), F.lit(0)).cast("int") - 1
    own = lists.select(scene, key, *XYZ, place.alias("_own"), F.posexplode(F.arrays_zip("ids", "d2s", "nx", "ny", "nz")).alias("_r", "_n"))
    before = (F.col("_own") < 0) | (F.col("_r") < F.col("_own"))
    others = own.where(F.col("_r") != F.col("_own")).withColumn("rank", F.when(before, F.col("_r") + 1).otherwise(F.col("_r")))
    return others.where(F.col("rank") <= k).select(
        scene, key, *XYZ, "rank", F.col("_n.ids").alias("nbr_id"), F.col("_n.d2s").alias("d2"), *[f"_n.n{a}" for a in XYZ])


def knn_lists(df: DataFrame, k: int, base_cell: float = 0.05, scene: str = "scene_id", key: str = "point_id") -> DataFrame:
    """The k nearest points (the point itself included) as arrays: ``scene_id, point_id, x, y, z, ids, d2s, nx, ny, nz``.

    ``ids`` are sorted by distance, then id.
    """
    return _searched(df, k, base_cell, scene, key, tiles.list_columns, tiles.LIST_SCHEMA)


def knn_sums(
    df: DataFrame, k: int, include_self: bool = True, base_cell: float = 0.05, scene: str = "scene_id", key: str = "point_id",
) -> DataFrame:
    """Number of the k nearest neighbours, their last and summed squared distance and the sum of their ids: ``scene_id, point_id, n, d2_last, d2_sum, ids``.

    The same neighbours as :func:`knn`, whose lists stay in the task that finds them.  Points without any give no row.
    """
    make = tiles.sum_columns(not include_self)
    found = _searched(df, k if include_self else k + 1, base_cell, scene, key, make, tiles.SUM_SCHEMA)
    return found.where("n > 0").select(scene, key, "n", "d2_last", "d2_sum", "ids")


def knn_moments(
    df: DataFrame, k: int, k_large: int, include_self: bool = True, base_cell: float = 0.05, scene: str = "scene_id", key: str = "point_id",
) -> DataFrame:
    """Sums from which the covariances of the first ``k`` and ``k_large`` neighbours follow, and the ids of the first ``k``.

    The lists of ``k_large`` neighbours live only inside the tile that finds them: ``scene_id, point_id, x, y, z, ids``, the
    columns of :func:`~pointloom.functions.columns.covariance_sums` with prefixes ``s_`` and ``b_`` relative to the point, and the
    largest and smallest y of the first ``k`` as ``hi, lo``.
    """
    make = tiles.moment_columns(k, not include_self)
    return _searched(df, k_large if include_self else k_large + 1, base_cell, scene, key, make, tiles.MOMENT_SCHEMA)


def neighbourhoods(
    df: DataFrame, k: int, k_large: int, describe: Callable[[DataFrame], DataFrame], value: str, include_self: bool = True, radius: float | None = None,
    keep=(), base_cell: float = 0.05, scene: str = "scene_id", key: str = "point_id",
) -> DataFrame:
    """What ``describe`` makes of :func:`knn_moments` row by row, and ``spread``: the population std of its column ``value`` over the first ``k`` neighbours.

    ``describe`` gets the columns ``keep`` of ``df`` as well, and with ``radius`` the number of other points in it as ``within``; it leaves
    ``scene_id, point_id, ids`` in place.  Points without neighbours give no row.  A scene that a task may hold is dealt once: its rows stay
    in the task from the search to the spread.  In larger ones the spread joins ``k`` rows a point.
    """
    want, make, keep = k_large if include_self else k_large + 1, tiles.moment_columns(k, not include_self), tuple(keep)
    pts = cut(df.select(scene, key, *XYZ, *keep).where(_complete(scene, XYZ)))
    large, total = large_scenes(scene, pts)
    small, rest = parted(pts, large, scene)
    kept = "".join(f"{_types(pts, [c])}, " for c in keep)
    schema = f"{_types(pts, [scene, key])}, x double, y double, z double, {kept}{tiles.MOMENT_SCHEMA}" + (", within long" if radius is not None else "")
    found = describe(in_scenes(small, scene, total).mapInArrow(whole.nearest_in_scenes(scene, key, want, make, keep, radius), schema))
    found = found.mapInArrow(whole.spread_in_scenes(scene, key, value), f"{_types(found, [c for c in found.columns if c != 'ids'])}, spread double")
    if rest is None:
        return found
    rest = cut(rest)
    near = _searched_in_tiles(rest.select(scene, key, *XYZ), want, base_cell, scene, key, make, tiles.MOMENT_SCHEMA)
    if keep:
        near = near.join(rest.select(scene, key, *keep), [scene, key])
    if radius is not None:
        near = near.join(_radius_count_in_tiles(rest, radius, list(XYZ), scene, key).withColumnRenamed("n", "within"), [scene, key])
    near = cut(describe(near))
    links = near.select(scene, key, F.explode("ids").alias("_near")).join(near.select(scene, F.col(key).alias("_near"), value), [scene, "_near"])
    spread = links.groupBy(scene, key).agg(F.stddev_pop(value).alias("spread"))
    return found.unionByName(near.drop("ids").join(spread, [scene, key]))


def _searched(df, want, base, scene, key, columns, schema):
    """``columns`` of the ``want`` nearest points of every point: scenes that a task may hold are searched whole, larger ones in tiles."""
    pts = cut(df.select(scene, key, *XYZ).where(_complete(scene, XYZ)))
    large, total = large_scenes(scene, pts)
    small, rest = parted(pts, large, scene)
    found = in_scenes(small, scene, total).mapInArrow(
        whole.nearest_in_scenes(scene, key, want, columns), f"{_types(pts, [scene, key])}, x double, y double, z double, {schema}")
    return found if rest is None else found.unionByName(_searched_in_tiles(cut(rest), want, base, scene, key, columns, schema))


def _searched_in_tiles(pts, want, base, scene, key, columns, schema):
    """``columns`` of the ``want`` nearest points of every point.

    Each point asks at the grid level that fits the local density, and a scene's finest cells shrink
    until they hold few points, so a dense spot does not meet all points of a wide cell.  A point whose neighbours
    reach beyond what its tile's border covers asks once more, at a level that is guaranteed to be wide
    enough; the others keep their first result.  Locations with more copies than can ever be neighbours are searched
    once and the result is shared.
    """
    crowded = pts.groupBy(scene, *XYZ).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > want)
    direct = pts
    has_copies = not crowded.isEmpty()
    if has_copies:
        at = Window.partitionBy(scene, *XYZ).orderBy(key)
        ranked = cut(pts.withColumn("_r", F.row_number().over(at)).where(F.col("_r") <= want))
        direct = ranked.drop("_r")
        # Without itself the last of them has the neighbours of every later copy.
        crowded = ranked.where(F.col("_r") == want).select(scene, *XYZ, F.col(key).alias("_first")).join(crowded, [scene, *XYZ])
    found = _in_tiles(pts, direct, want, base, scene, key, columns, schema)
    if has_copies:
        extra = pts.join(crowded.drop("_n"), [scene, *XYZ]).join(direct.select(scene, key), [scene, key], "left_anti")
        shared = found.drop(*XYZ).withColumnRenamed(key, "_first").join(crowded.select(scene, "_first"), [scene, "_first"], "left_semi")
        found = found.unionByName(attach(extra, shared, [scene, "_first"]).drop("_first"))
    return found


def _in_tiles(pts, direct, want, base, scene, key, columns, schema):
    grid = _scene_grid(pts, base, scene, F.least(F.count(F.lit(1)), F.lit(want)).alias("_k"), per_cell=want / 3)
    grid, occupied = _fitted_grid(direct, grid, _FULL * want, scene, F.first("_k").alias("_k"), F.first("_base").alias("_base"))
    gridded = attach(direct, grid, scene).select(scene, key, *XYZ, *[_fine_index(a) for a in XYZ], "_k", "_base")
    levels = cut(_all_levels(occupied, F.col("_top")))
    filled = (
        levels.groupBy(*_CELL, scene).agg(F.sum("_n").alias("_in"), F.first("_k").alias("_k"))
        .where(F.col("_in") * 3 >= F.col("_k"))
        .select(*_CELL, scene, (F.col("_in") >= F.col("_k")).alias("_sure"))
    )
    # Finest level with a third of the neighbours in the own cell (tried first) and
    # finest one with all of them (one level above it cannot miss a neighbour).
    choice = cut(
        levels.drop("_n", "_k", "_top").join(filled, [*_CELL, scene]).groupBy(*_FINE, scene)
        .agg(F.min("_l").alias("_try"), (F.min(F.when(F.col("_sure"), F.col("_l"))) + 1).alias("_safe"))
    )
    names = [f"{scene} {direct.schema[scene].dataType.simpleString()}", f"{key} {direct.schema[key].dataType.simpleString()}"]
    schema = ", ".join([*names, "x double, y double, z double, settled boolean", schema])

    def asked(rows: DataFrame, level: str) -> DataFrame:
        """Results of the rows with ``_ask`` at the level their cell has in ``choice``."""
        cells = rows.where("_ask").select(scene, *_FINE).distinct().join(choice, [*_FINE, scene]).withColumn("_l", F.col(level))
        at = [f"((shiftright(_i_{a}, _l) + 1) >> {tiles.SIDE.bit_length() - 1})" for a in XYZ]
        homes = cells.selectExpr(
            f"`{scene}`", *_FINE, "_l", *[f"{t} AS _t_{a}" for t, a in zip(at, XYZ)],
            f"shiftleft(CAST(_l AS BIGINT), {2 * _AXIS_BITS}) + shiftleft({at[0]}, {_AXIS_BITS}) + {at[1]} AS _tile", f"{at[2]} AS _tz")
        homes = cut(homes)
        spread = F.explode(F.sequence(F.lit(0), F.lit(tiles.WIDE ** 3 - 1)))
        around = homes.select(scene, "_l", "_tile", "_tz", "_t_x", "_t_y").distinct().withColumn("_rel", spread)
        cell_of = [f"({tiles.SIDE} * {t} + {place} - 1)" for t, place in (
            ("_t_x", f"_rel div {tiles.WIDE ** 2}"), ("_t_y", f"_rel div {tiles.WIDE} % {tiles.WIDE}"), ("_tz", f"_rel % {tiles.WIDE}"))]
        around = around.selectExpr(
            f"`{scene}`", *_TILE, "_rel", "_l",
            f"shiftleft(CAST(_l AS BIGINT), {2 * _AXIS_BITS}) + shiftleft({cell_of[0]}, {_AXIS_BITS}) + {cell_of[1]} AS _cell", f"{cell_of[2]} AS _cz")
        boxes = levels.select(scene, *_FINE, *_CELL).join(around, [*_CELL, scene]).drop(*_CELL)
        mine = homes.select(scene, *_FINE, F.col("_tile").alias("_ht"), F.col("_tz").alias("_hz"))
        here = (F.col("_tile") == F.col("_ht")) & (F.col("_tz") == F.col("_hz"))
        boxes = boxes.join(mine, [*_FINE, scene], "left").select(
            scene, *_FINE, *_TILE, "_rel", "_l", F.coalesce(here, F.lit(False)).alias("_here"))
        width = F.pow(F.lit(2.0), F.col("_l")) * F.col("_base")
        dealt = rows.join(boxes, [*_FINE, scene]).select(
            scene, *_TILE, (F.col("_ask") & F.col("_here")).alias("_ask"), key, *XYZ, "_rel", "_k", (width * width).alias("_reach"))
        dealt = dealt.repartition(scene, *_TILE).sortWithinPartitions(scene, *_TILE, F.desc("_ask"))
        return dealt.mapInArrow(tiles.nearest_in_tiles(scene, key, [scene, *_TILE], columns), schema)

    first = cut(asked(gridded.withColumn("_ask", F.lit(True)), "_try"))
    left = first.where("NOT settled").select(scene, key, F.lit(True).alias("_ask"))
    done = first.where("settled").drop("settled")
    if left.isEmpty():
        return done
    again = attach(gridded, left, [scene, key]).withColumn("_ask", F.coalesce("_ask", F.lit(False)))
    return done.unionByName(asked(again, "_safe").drop("settled"))


# ------------------------------------------------------------------ fixed radius

#: Asking locations of a tile that one task holds; a denser tile is dealt to several.
_ASKING = 1 << 14


def radius_count(
    df: DataFrame, r: float, dims=XYZ, scene: str = "scene_id", key: str = "point_id"
) -> DataFrame:
    """Number of other points within ``r`` (inclusive): ``scene_id, point_id, n``.

    In large scenes copies of one location are counted once with a weight.
    """
    dims = list(dims)
    pts = cut(df.select(scene, key, *dims).where(_complete(scene, dims)))
    large, total = large_scenes(scene, pts)
    small, rest = parted(pts, large, scene)
    found = in_scenes(small, scene, total).mapInArrow(whole.counted_in_scenes(scene, [key], dims, r), f"{_types(pts, [scene, key])}, n long")
    return found if rest is None else found.unionByName(_radius_count_in_tiles(cut(rest), r, dims, scene, key))


def _radius_count_in_tiles(df, r, dims, scene, key):
    places = cut(df.groupBy(scene, *dims).agg(F.count(F.lit(1)).alias("_w")))
    counts = _weighted_counts(places, places, r, dims, scene)
    return df.select(scene, key, *dims).join(counts, [scene, *dims]).select(
        scene, key, (F.col("_found") - 1).alias("n")
    )


def _weighted_counts(queries, places, r, dims, scene, strict: bool = False):
    """Total weight of ``places`` within ``r`` of each distinct query location: ``scene, *dims, _found``."""
    axes = {a: F.col(d).cast("double") for a, d in zip(XYZ, dims)} | {a: F.lit(0.0) for a in XYZ[len(dims):]}
    named = [scene, *[c.alias(a) for a, c in axes.items()]]
    asked = queries.select(*named, F.lit(True).alias("_ask"), F.lit(0).cast("long").alias("_w"))
    rows = cut(asked.unionByName(places.select(*named, F.lit(False).alias("_ask"), F.col("_w").cast("long").alias("_w"))).where(_complete(scene, XYZ)))
    large, total = large_scenes(scene, rows)
    small, rest = parted(rows, large, scene)
    back = [F.col(a).alias(d) for a, d in zip(XYZ, dims)]
    found = in_scenes(small, scene, total).mapInArrow(
        whole.weighed_in_scenes(scene, r, strict), f"{_types(rows, [scene])}, x double, y double, z double, _found long").select(scene, *back, "_found")
    if rest is None:
        return found
    both = cut(rest)
    return found.unionByName(_weighed_in_tiles(both.where("_ask"), both.where("NOT _ask"), r, scene, strict).select(scene, *back, "_found"))


def _weighed_in_tiles(queries, places, r, scene, strict):
    """:func:`_weighted_counts` of large scenes by ``x, y, z``.

    Cells are as wide as the radius.  A tile of cells and its border go to a task, which settles boxes by bounds
    (:class:`~pointloom.operators.tiles.Within`); locations of a dense tile are dealt to several tasks, and each sees the places block by block.
    """
    bits = tiles.SIDE.bit_length() - 1
    at = [F.floor(F.col(a) / F.lit(float(r))).cast("long").alias(f"_c{a}") for a in XYZ]
    tile = [f"_t{a}" for a in XYZ]
    asked = queries.select(scene, *XYZ).select("*", *at).withColumns({t: F.shiftright(f"_c{a}", bits) for t, a in zip(tile, XYZ)})
    asked = cut(asked)
    chunks = cut(asked.groupBy(scene, *tile).agg(F.ceil(F.count(F.lit(1)) / _ASKING).cast("int").alias("_chunks")))
    asked = attach(asked, chunks, [scene, *tile]).withColumn("_chunk", F.pmod(F.xxhash64(*XYZ), F.col("_chunks")).cast("int"))
    given = places.select(scene, *XYZ, "_w", *at)
    for t, a in zip(tile, XYZ):
        around = [F.shiftright(F.col(f"_c{a}") + step, bits) for step in (-1, 1)]
        given = given.withColumn(t, F.explode(F.array_distinct(F.array(*around))))
    given = attach(given, chunks, [scene, *tile], "inner").withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1)))
    rel = None
    for t, a in zip(tile, XYZ):
        step = F.col(f"_c{a}") - F.col(t) * tiles.SIDE + 1
        rel = step if rel is None else rel * tiles.WIDE + step
    columns = [scene, *tile, "_chunk", *XYZ, rel.cast("int").alias("_rel")]
    rows = asked.select(*columns, F.lit(True).alias("_ask"), F.lit(0).cast("long").alias("_w")).unionByName(given.select(*columns, F.lit(False).alias("_ask"), "_w"))
    rows = rows.repartition(scene, *tile, "_chunk").sortWithinPartitions(scene, *tile, "_chunk", F.desc("_ask"))
    scene_type = queries.schema[scene].dataType.simpleString()
    return rows.mapInArrow(
        tiles.within_in_tiles(scene, [scene, *tile, "_chunk"], r, strict), f"`{scene}` {scene_type}, x double, y double, z double, _found long")


def eps_edges(
    df: DataFrame, eps: float, dims=XYZ, scene: str = "scene_id", key: str = "point_id"
) -> DataFrame:
    """All pairs ``a < b`` within ``eps``: ``scene_id, a, b, d2`` (the pairs are the result)."""
    dims = list(dims)
    cells = [f"_c{i}" for i in range(len(dims))]
    keyed = df.select(scene, key, *dims).withColumns({c: cell(d, eps) for c, d in zip(cells, dims)})
    left = keyed.select(scene, *cells, F.col(key).alias("a"), *dims)
    right = _spread(
        keyed.select(scene, *cells, F.col(key).alias("b"), *[F.col(d).alias(f"n{d}") for d in dims]), cells
    )
    d2 = squared_distance(dims, [f"n{d}" for d in dims])
    return (
        left.join(right, [scene, *cells]).where(F.col("a") < F.col("b"))
        .withColumn("d2", d2).where(F.col("d2") <= F.lit(eps * eps)).select(scene, "a", "b", "d2")
    )


def within_distance(
    left: DataFrame, right: DataFrame, r: float, strict: bool = True, dims=XYZ,
    scene: str | None = "scene_id", keep: bool = True,
) -> DataFrame:
    """Rows of ``left`` with (``keep``) or without a ``right`` row closer than ``r``.

    ``scene=None`` measures across scenes.  Distinct locations of both sides meet in tiles; rows without a scene or with a missing
    coordinate are near nothing.
    """
    dims = list(dims)
    own = scene or "_everywhere"
    rows = cut(left if scene else left.withColumn(own, F.lit(0)))
    others = cut((right if scene else right.withColumn(own, F.lit(0))).select(own, *dims).where(_complete(own, dims)))
    large, total = large_scenes(own, rows, others)
    (small, rest), (given, far) = parted(rows, large, own), parted(others, large, own)
    tagged = small.withColumn("_ask", F.lit(True)).unionByName(given.withColumn("_ask", F.lit(False)), allowMissingColumns=True)
    found = in_scenes(tagged, own, total).mapInArrow(
        whole.near_in_scenes(own, rows.columns, dims, r, strict, keep), _types(rows, rows.columns)).select(*left.columns)
    if not keep:
        found = found.unionByName(small.where(F.col(own).isNull()).select(*left.columns))
    return found if rest is None else found.unionByName(_within_in_tiles(cut(rest), cut(far), r, strict, dims, own, keep).select(*left.columns))


def _within_in_tiles(rows, others, r, strict, dims, own, keep):
    places = others.distinct().withColumn("_w", F.lit(1).cast("long"))
    asked = rows.select(own, *dims).where(_complete(own, dims)).distinct()
    near = _weighted_counts(asked, places, r, dims, own, strict).where(F.col("_found") > 0).select(own, *dims)
    return rows.join(near, [own, *dims], "left_semi" if keep else "left_anti")


# ------------------------------------------------------------ nearest in another set

def nearest_transfer(
    left: DataFrame, right: DataFrame, columns, base_cell: float = 0.1,
    scene: str = "scene_id", key: str = "point_id",
) -> DataFrame:
    """Add ``columns`` of the nearest ``right`` row, its id ``nn_id`` and distance ``nn_d2``.

    Ties go to the smallest id.  Scenes that a task may hold are searched whole, larger ones on a grid.  Scenes that
    occur only on the left stay without a match (NULL columns).
    """
    columns = [columns] if isinstance(columns, str) else list(columns)
    left, right = cut(left), cut(right.select(scene, key, *XYZ, *columns))
    base = left.drop(*[c for c in columns if c in left.columns])
    base = base.select(scene, key, *[c for c in base.columns if c not in (scene, key)])
    large, total = large_scenes(scene, left, right)
    (small, rest), (given, far) = parted(base, large, scene), parted(right, large, scene)
    hits = [f"_hit_{c}" for c in columns]
    given = given.select(scene, key, *XYZ, *[F.col(c).alias(h) for c, h in zip(columns, hits)], F.lit(False).alias("_ask"))
    tagged = small.withColumn("_ask", F.lit(True)).unionByName(given, allowMissingColumns=True)
    ends = f"nn_d2 double, nn_id {right.schema[key].dataType.simpleString()}" + "".join(f", {_types(tagged, [h])}" for h in hits)
    found = in_scenes(tagged, scene, total).mapInArrow(
        whole.matched_in_scenes(scene, key, base.columns, hits), f"{_types(base, base.columns)}, {ends}")
    found = found.withColumnsRenamed(dict(zip(hits, columns)))
    found = found.unionByName(small.where(F.col(scene).isNull()), allowMissingColumns=True)
    return found if rest is None else found.unionByName(_transfer_on_grid(cut(rest), cut(far), columns, base_cell, scene, key))


def _transfer_on_grid(left, right, columns, base_cell, scene, key):
    """:func:`nearest_transfer` of large scenes.

    The finest cells shrink until they hold few target locations; each row looks around its cell two levels above the finest one that
    has a target next to it, so the work per row does not grow with the density of the targets.
    """
    both = left.select(scene, *XYZ).unionByName(right.select(scene, *XYZ))
    grid = _scene_grid(both, base_cell, scene).join(right.select(scene).distinct(), scene, "left_semi")

    # Only the lowest id per location can win a tie.
    best = cut(right.groupBy(scene, *XYZ).agg(F.min_by(F.struct(F.col(key).alias("nn_id"), *columns), key).alias("_hit")))
    grid, occupied = _fitted_grid(best, grid, _TARGETS, scene)
    grid = grid.withColumn("_top", _top())

    def on_grid(df):
        return attach(df, grid, scene, "inner").withColumns({f"_i_{a}": _fine_index(a) for a in XYZ})

    targets = on_grid(best)
    asked = on_grid(left.select(scene, key, *XYZ))
    levels = _all_levels(occupied.drop("_n"), F.col("_top") + 2)
    # At the finest level with a target in an adjacent cell, some target lies within
    # 2 * sqrt(3) cell widths; two levels up the adjacent cells cover that distance.
    probes = _all_levels(asked.select(scene, *_FINE, "_top").distinct(), F.col("_top"))
    filled = _around(levels.select(*_CELL, scene).distinct(), scene).select(*_CELL, scene).distinct()
    level = probes.join(filled, [*_CELL, scene]).groupBy(*_FINE, scene).agg((F.min("_l") + 2).alias("_l"))
    queries = asked.join(level, [*_FINE, scene]).withColumns(_code("_l")).select(scene, key, *XYZ, *_CELL)
    around = _around(queries.select(*_CELL, scene).distinct(), scene)
    boxes = levels.select(scene, *_FINE, *_CELL).join(around, [*_CELL, scene]).select(
        scene, *_FINE, F.col("_home").alias("_cell"), F.col("_home_z").alias("_cz")
    )
    near = targets.select(scene, *_FINE, *[F.col(a).alias(f"n{a}") for a in XYZ], "_hit").join(
        boxes, [*_FINE, scene]
    ).drop(*_FINE)
    found = (
        near.join(queries.hint("shuffle_hash"), [*_CELL, scene])
        .withColumn("nn_d2", squared_distance(XYZ, [f"n{a}" for a in XYZ]))
        .groupBy(key, scene, *_CELL)
        .agg(F.min(F.struct("nn_d2", F.col("_hit.nn_id").alias("nn_id"), "_hit")).alias("_m"))
        .select(scene, key, F.col("_m.nn_d2").alias("nn_d2"), "_m._hit.*")
    )
    return left.join(found, [scene, key], "left")


def temporal_diff(a: DataFrame, b: DataFrame, threshold: float = 0.10, scene: str = "scene_id") -> DataFrame:
    """Median nearest distance from capture ``a`` to ``b`` and share beyond the threshold."""
    from ..functions.groups import exact_percentiles

    dist = nearest_transfer(a, b, []).where(F.col("nn_d2").isNotNull()).select(scene, F.sqrt("nn_d2").alias("d"))
    dist = cut(dist)
    share = dist.groupBy(scene).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg((F.col("d") > threshold).cast("int")).alias("share_moved"),
    )
    return share.join(exact_percentiles(dist, scene, "d", {"median_distance": 0.5}), scene)
