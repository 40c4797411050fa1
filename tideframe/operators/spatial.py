"""Points in the plane: an adaptive tree of cells, lookups in it, exact nearest neighbours, scattered cells brought to a
regular grid, and values along a track that moves through frames.

The tree is built from grouped counts: STEP levels in a pass, and only the points of cells that are still over the limit are
counted again. Cells are named by level and whole-number position, so that every join on them is an equality; a cell's
parent is its position shifted by one bit.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideframe.functions.timescales import utc_us
from tideframe.operators.matching import _around
from tideframe.storage import small, stored

#: Bits of a position in the finest cells, and levels that one pass counts.
BITS, STEP = 26, 4
CELL = ["level", "ix", "iy"]
NODE_BYTES = 64
#: Points of a leaf that meet a query in one list.
LISTED = 256


@dataclass(frozen=True)
class Tree:
    """``nodes`` (level, ix, iy, n, leaf, x0, x1, y0, y1) of a square box; the leaves cover it, empty ones too."""

    nodes: DataFrame
    x0: float
    y0: float
    size: float
    levels: int

    def position(self, c: str, start: float) -> Column:
        """Position of a coordinate in the finest cells; null outside of the box."""
        at = F.floor((F.col(c) - start) / self.size * (1 << BITS))
        return F.when((at >= 0) & (at < 1 << BITS), at.cast("long"))

    def with_positions(self, points: DataFrame) -> DataFrame:
        return points.withColumns({"_fx": self.position("x", self.x0), "_fy": self.position("y", self.y0)})

    def leaves(self) -> DataFrame:
        return self.nodes.where("leaf").drop("leaf")


def _valid() -> Column:
    return F.col("x").isNotNull() & F.col("y").isNotNull() & ~F.isnan("x") & ~F.isnan("y") & (F.abs("x") < float("inf")) & (F.abs("y") < float("inf"))


def _at(level: Column | int, fine: str, bits: int = BITS) -> Column:
    """Position at a level of a position in the finest cells."""
    return F.expr(f"shiftright({fine}, {bits - level})") if isinstance(level, int) else F.call_function("shiftright", F.col(fine), (F.lit(bits) - level).cast("int"))


def adaptive_tree(points: DataFrame, limit: int, most: int = 20) -> Tree:
    """The tree whose cells are quartered as long as they hold more than ``limit`` of the points (x, y), down to level ``most``.

    Points without finite coordinates are left out. The box is the square of the larger extent from the smallest
    coordinates. A leaf of level ``most`` can hold more points. No points make one empty leaf, a box of size one.
    """
    points = points.select(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).where(_valid())
    n, low_x, high_x, low_y, high_y = points.agg(F.count("*"), F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    x0, y0 = (low_x, low_y) if n else (0.0, 0.0)
    size = max(high_x - low_x, high_y - low_y) * (1 + 1e-9) if n else 1.0
    tree = Tree(points, x0, y0, size or 1.0, 0)
    active = tree.with_positions(points).select("_fx", "_fy")
    spark = points.sparkSession
    counts = spark.range(1).select(F.lit(0).alias("level"), F.lit(0).cast("long").alias("ix"), F.lit(0).cast("long").alias("iy"), F.lit(n).cast("long").alias("n"))
    level = 0
    while level < most and n > limit:
        down = min(most, level + STEP)
        fine = active.groupBy(_at(down, "_fx").alias("_fx"), _at(down, "_fy").alias("_fy")).agg(F.count("*").alias("n"))
        fine = fine.withColumn("level", F.explode(F.sequence(F.lit(level + 1), F.lit(down))))
        found = fine.groupBy("level", _at(F.col("level"), "_fx", down).alias("ix"), _at(F.col("level"), "_fy", down).alias("iy")).agg(F.sum("n").alias("n"))
        found = stored(found, "cell-counts")
        counts = counts.unionByName(found)
        crowded = found.where((F.col("level") == down) & (F.col("n") > limit)).select("ix", "iy")
        if down == most or crowded.isEmpty():
            break
        crowded = small(crowded, NODE_BYTES)
        active = active.join(crowded, (_at(down, "_fx") == crowded["ix"]) & (_at(down, "_fy") == crowded["iy"]), "left_semi")
        level = down
    over = counts.where((F.col("n") > limit) & (F.col("level") < most))
    quarter = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)))).alias("q")
    below = over.select((F.col("level") + 1).alias("level"), "ix", "iy", quarter).select("level", (2 * F.col("ix") + F.col("q.a")).alias("ix"), (2 * F.col("iy") + F.col("q.b")).alias("iy"))
    nodes = below.join(counts, CELL, "left").unionByName(counts.where("level = 0")).withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    width = F.lit(tree.size) / F.pow(F.lit(2.0), F.col("level"))
    box = {f"{c}{k}": F.lit(start) + (F.col(f"i{c}") + k) * width for c, start in (("x", x0), ("y", y0)) for k in (0, 1)}
    nodes = stored(nodes.withColumn("leaf", (F.col("n") <= limit) | (F.col("level") == most)).withColumns(box), "tree")
    return Tree(nodes, x0, y0, tree.size, nodes.agg(F.max("level")).first()[0])


def locate(points: DataFrame, tree: Tree) -> DataFrame:
    """``points`` (x, y, ...) with ``leaf``, the (level, ix, iy) they are in; null outside of the box.

    For each STEP levels the leaves among them are spread over the cells of the lowest, at most 4 ** STEP each, so that a
    point asks one equality join for each STEP levels, whatever the levels of the leaves.
    """
    rows = tree.with_positions(points).withColumn("leaf", F.lit(None).cast("struct<level:int,ix:bigint,iy:bigint>"))
    leaves = tree.leaves()
    for low in range(0, max(tree.levels, 1), STEP):
        down = min(low + STEP, BITS)
        some = leaves.where((F.col("level") > (low if low else -1)) & (F.col("level") <= down))
        spread = F.expr(f"cast(shiftleft(1L, {down} - level) as bigint)")
        cells = lambda c, w=spread: F.explode(F.sequence(F.col(c) * w, F.col(c) * w + w - 1))
        some = some.select(F.struct(*CELL).alias("_leaf"), "ix", "iy", "level").withColumn("_gx", cells("ix")).withColumn("_gy", cells("iy")).select("_gx", "_gy", "_leaf")
        some = small(some, NODE_BYTES)
        rows = rows.join(some, (_at(down, "_fx") == some["_gx"]) & (_at(down, "_fy") == some["_gy"]), "left")
        rows = rows.withColumn("leaf", F.coalesce("leaf", "_leaf")).drop("_gx", "_gy", "_leaf")
    return rows.drop("_fx", "_fy")


def _kids(nodes: DataFrame) -> DataFrame:
    """Under each inner node those two levels down, or one level where these are leaves: (_level, _ix, _iy, _kid)."""
    kid = F.struct(*CELL, "n", "x0", "x1", "y0", "y1").alias("_kid")
    up = lambda k: [(F.col("level") - k).alias("_level"), F.shiftright("ix", k).alias("_ix"), F.shiftright("iy", k).alias("_iy")]
    some = nodes.where("n > 0")
    return some.where("level >= 2 and level % 2 = 0").select(*up(2), kid).unionByName(some.where("leaf and level % 2 = 1").select(*up(1), kid))


def nearest_points(queries: DataFrame, points: DataFrame, k: int, limit: int = 256, most: int = BITS) -> DataFrame:
    """(id, rank, pid, distance) of the ``k`` nearest ``points`` (pid, x, y) of each of the ``queries`` (id, x, y); exact.

    Every query starts with the cells below the tree's root. Two levels at a time its cells are replaced by those below; of these, the ones
    whose farthest corners are nearest and that hold ``k`` points together bound the k-th distance, and cells beyond it go.
    So a query keeps a few cells whatever lies elsewhere, dense cells are split before their points are touched, and points
    are only met in leaves that can hold a neighbour. Of the points at one place only the ``k`` of smallest pid take part.

    Queries at one place are answered once, and a leaf's points meet a query as lists of at most LISTED points, of which the
    ``k`` nearest go on; so what is shuffled is a few cells and lists for each place.

    Ties go to the smaller pid; fewer points than ``k`` give fewer rows; rows without finite coordinates are left out;
    ids should be unique.
    """
    points = points.select("pid", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).where(_valid())
    place = Window.partitionBy("x", "y").orderBy("pid")
    points = stored(points.withColumn("_r", F.row_number().over(place)).where(F.col("_r") <= k).drop("_r"), "places")
    tree = adaptive_tree(points, max(limit, k), most)
    kids = small(_kids(tree.nodes), 2 * NODE_BYTES)
    asked = queries.select("id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).where(_valid())
    top = tree.nodes.where("level = 0").select(*CELL, "n", "x0", "x1", "y0", "y1") if tree.levels == 0 else kids.where("_level = 0").select("_kid.*")
    top = [F.struct(*(F.lit(r[c]).cast(t).alias(c) for c, t in top.dtypes)) for r in top.collect()]  # at most 16 cells
    asked = asked.withColumns({c: F.col(c) + 0.0 for c in "xy"})  # one zero
    rows = asked.select("x", "y").distinct().select("x", "y", F.explode(F.array(*top)).alias("c"))
    slack = 1e-7 * tree.size  # cells' borders are rounded
    near = lambda c: F.greatest(F.col(f"c.{c}0") - F.col(c), F.col(c) - F.col(f"c.{c}1"), F.lit(0.0))
    far = lambda c: F.greatest(F.abs(F.col(c) - F.col(f"c.{c}0")), F.abs(F.col(c) - F.col(f"c.{c}1")))
    for level in range(0, max(tree.levels, 1), 2):
        if level:
            joined = (F.col("c.level") == kids["_level"]) & (F.col("c.ix") == kids["_ix"]) & (F.col("c.iy") == kids["_iy"])
            rows = rows.join(kids, joined, "left").select("x", "y", F.coalesce("_kid", "c").alias("c"))
        rows = rows.select("*", F.hypot(far("x"), far("y")).alias("_far"), F.hypot(near("x"), near("y")).alias("_near"))
        whose = Window.partitionBy("x", "y")
        held = F.sum("c.n").over(whose.orderBy("_far", "c.level", "c.ix", "c.iy").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        rows = rows.withColumn("_held", held)
        bound = F.min(F.when(F.col("_held") >= k, F.col("_far"))).over(whose)
        rows = rows.withColumn("_bound", bound).where(F.col("_bound").isNull() | (F.col("_near") <= F.col("_bound") + slack)).select("x", "y", "c")
    homes = locate(points, tree).select("leaf", "pid", F.col("x").alias("_px"), F.col("y").alias("_py"))
    many = F.count("*").over(Window.partitionBy("leaf"))
    homes = homes.withColumn("_part", F.pmod(F.xxhash64("pid"), F.ceil(many / LISTED)))
    homes = homes.groupBy("leaf", "_part").agg(F.collect_list(F.struct("pid", "_px", "_py")).alias("_points")).select("leaf", "_points")
    rows = rows.select("x", "y", F.struct("c.level", "c.ix", "c.iy").alias("leaf")).join(homes, "leaf")
    square = lambda p: (p["_px"] - F.col("x")) * (p["_px"] - F.col("x")) + (p["_py"] - F.col("y")) * (p["_py"] - F.col("y"))
    near_ones = F.slice(F.array_sort(F.transform("_points", lambda p: F.struct(square(p).alias("d"), p["pid"].alias("pid")))), 1, k)
    found = rows.select("x", "y", near_ones.alias("_near")).groupBy("x", "y").agg(F.slice(F.array_sort(F.flatten(F.collect_list("_near"))), 1, k).alias("_near"))
    rows = asked.join(found, ["x", "y"]).select("id", F.posexplode("_near").alias("_k", "_p"))
    return rows.select("id", (F.col("_k") + 1).alias("rank"), F.col("_p.pid").alias("pid"), F.sqrt("_p.d").alias("distance"))


def regrid(cells: DataFrame, values: tuple[str, ...], spacing: float, k: int = 4, power: float = 2.0, limit: int = 256) -> DataFrame:
    """Scattered ``cells`` (pid, x, y, values) at the knots of a regular grid from the smallest to the largest coordinates.

    (i, j, x, y, values): each value is the mean of the ``k`` nearest cells' by falling power of distance; at the very
    place of cells it is these cells' mean. A knot near cells whose value is null uses the others.
    """
    n, low_x, high_x, low_y, high_y = cells.where(_valid()).agg(F.count("*"), F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    across = lambda low, high: int((high - low) / spacing - 1e-9) + 2 if n else 0  # noqa: E731  the last knot is at the largest coordinate or behind it
    nx, ny = across(low_x, high_x), across(low_y, high_y)
    i, j = F.floor(F.col("id") / max(ny, 1)), F.col("id") % max(ny, 1)
    knots = cells.sparkSession.range(nx * ny).select("id", i.alias("i"), j.alias("j"), ((low_x or 0.0) + i * spacing).alias("x"), ((low_y or 0.0) + j * spacing).alias("y"))
    found = nearest_points(knots, cells, k, limit)
    weight = F.when(F.col("_least") == 0, (F.col("distance") == 0).cast("double")).otherwise(F.pow("distance", F.lit(-power)))
    found = found.withColumn("_least", F.min("distance").over(Window.partitionBy("id"))).withColumn("_w", weight)
    found = found.join(cells.select("pid", *values), "pid")
    mean = lambda v: F.try_divide(F.sum(F.col("_w") * F.col(v)), F.sum(F.when(F.col(v).isNotNull(), F.col("_w"))))
    return knots.join(found.groupBy("id").agg(*(mean(v).alias(v) for v in values)), "id").drop("id")


def along_track(track: DataFrame, frames: DataFrame, values: tuple[str, ...], x: tuple[Column, Column, Column], y: tuple[Column, Column, Column], bucket_us: int, block: tuple[str, ...] = ()) -> DataFrame:
    """``track`` (id, ts, x, y, block) with the ``values`` of ``frames`` (ts, block, i, j, values): bilinear in space, linear in time.

    ``x`` and ``y`` are (first centre, spacing, number of cells) as expressions over the track's rows, so that each row can
    stand in a block of its own resolution, such as a leaf found by ``locate``. Beyond the outermost centres the outermost cells
    extend. Rows before the first or after the last frame, or of whose corners any is missing, have nulls.

    Times of frames are carried to the rows within buckets of ``bucket_us``; then each row asks for its corners, four in each
    of two frames, by equality.
    """
    times = frames.select("ts").distinct()
    rows = _around(track, times, "ts", (), (), bucket_us)
    before, after, now = F.col("_last.us"), F.col("_next.us"), F.col("_us")
    share = F.when(after == before, 0.0).otherwise((now - before) / (after - before))
    cell = lambda c, g: F.least(F.greatest(F.floor((F.col(c) - g[0]) / g[1]), F.lit(0)), g[2] - 2).cast("long")
    rows = rows.select("id", *block, before.alias("_a"), after.alias("_b"), share.alias("_t"), cell("x", x).alias("_i"), cell("y", y).alias("_j"), *((F.col(c) - g[0]) / g[1] for c, g in (("x", x), ("y", y))))
    rows = rows.toDF("id", *block, "_a", "_b", "_t", "_i", "_j", "_u", "_v").withColumns({"_u": F.col("_u") - F.col("_i"), "_v": F.col("_v") - F.col("_j")})
    moments = F.array_distinct(F.array(F.struct(F.col("_a").alias("us"), (1 - F.col("_t")).alias("w")), F.struct(F.col("_b").alias("us"), F.when(F.col("_a") == F.col("_b"), 1 - F.col("_t")).otherwise(F.col("_t")).alias("w"))))
    corners = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)))
    rows = rows.where("_a is not null and _b is not null").withColumn("_m", F.explode(moments)).withColumn("_c", F.explode(corners))
    side = lambda c, w: F.when(F.col(f"_c.{c}") == 1, F.col(w)).otherwise(1 - F.col(w))
    asked = rows.select("id", *block, F.col("_m.us").alias("_us"), (F.col("_i") + F.col("_c.a")).alias("i"), (F.col("_j") + F.col("_c.b")).alias("j"), (F.col("_m.w") * side("a", "_u") * side("b", "_v")).alias("_w"))
    known = frames.select(utc_us(F.col("ts")).alias("_us"), *block, F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), *values)
    found = asked.join(known, ["_us", *block, "i", "j"], "left").groupBy("id").agg(*(F.when(F.count(v) == F.count("*"), F.sum(F.col("_w") * F.col(v))).alias(v) for v in values))
    return track.join(found, "id", "left")
