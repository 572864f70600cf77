"""Spatial operators on points and polygons.

A polygon is an array of rings, a ring an array of struct<x, y>. Joins go through a grid: polygons are
listed in the cells that their boxes touch, points in their cell, and an equality join on cells finds
the few polygons that the exact test is run on.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def edges(rings: Column) -> Column:
    """Each ring's sides as struct<x1, y1, x2, y2>, rings closed where they are not."""
    def sides(r: Column) -> Column:
        return F.transform(r, lambda p, i: F.struct(p["x"].alias("x1"), p["y"].alias("y1"), F.get(r, F.pmod(i + 1, F.size(r)))["x"].alias("x2"), F.get(r, F.pmod(i + 1, F.size(r)))["y"].alias("y2")))

    return F.flatten(F.transform(rings, sides))


def on_boundary(x: Column, y: Column, sides: Column) -> Column:
    def hit(e: Column) -> Column:
        cross = (e["x2"] - e["x1"]) * (y - e["y1"]) - (e["y2"] - e["y1"]) * (x - e["x1"])
        return (cross == 0) & x.between(F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"])) & y.between(F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"]))

    return F.exists(sides, hit)


def inside(x: Column, y: Column, sides: Column) -> Column:
    """Even-odd rule; points on the boundary may fall either way."""
    def crossed(e: Column) -> Column:
        return ((e["y1"] > y) != (e["y2"] > y)) & (x < (e["x2"] - e["x1"]) * (y - e["y1"]) / (e["y2"] - e["y1"]) + e["x1"])

    return F.size(F.filter(sides, crossed)) % 2 == 1


def within(x: Column, y: Column, sides: Column) -> Column:
    return inside(x, y, sides) & ~on_boundary(x, y, sides)


def covered(x: Column, y: Column, sides: Column) -> Column:
    return inside(x, y, sides) | on_boundary(x, y, sides)


def distance(x: Column, y: Column, sides: Column) -> Column:
    """To the nearest side, in the units of the coordinates; 0 where covered."""
    def to(e: Column) -> Column:
        dx, dy = e["x2"] - e["x1"], e["y2"] - e["y1"]
        n = dx * dx + dy * dy
        t = F.when(n > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - e["x1"]) * dx + (y - e["y1"]) * dy) / n))).otherwise(0.0)
        return F.hypot(x - e["x1"] - t * dx, y - e["y1"] - t * dy)

    return F.when(covered(x, y, sides), 0.0).otherwise(F.array_min(F.transform(sides, to)))


def centroid(rings: Column) -> Column:
    """Area-weighted centroid of the rings as struct<x, y>; null where there is no area."""
    parts = F.transform(edges(rings), lambda e: F.struct((e["x1"] * e["y2"] - e["x2"] * e["y1"]).alias("a"), (e["x1"] + e["x2"]).alias("x"), (e["y1"] + e["y2"]).alias("y")))
    total = lambda f: F.aggregate(parts, F.lit(0.0), lambda s, p: s + f(p))
    area = total(lambda p: p["a"])
    return F.when(area != 0, F.struct((total(lambda p: p["a"] * p["x"]) / (3 * area)).alias("x"), (total(lambda p: p["a"] * p["y"]) / (3 * area)).alias("y")))


def cells(polygons: DataFrame, size: float, margin: float = 0.0) -> DataFrame:
    """polygons (rings, ...) with sides, once for each grid cell (cx, cy) that the box, widened by margin, touches."""
    p = polygons.withColumn("sides", edges(F.col("rings")))
    ends = lambda f, a, b: f(F.concat(F.transform("sides", lambda e: e[a]), F.transform("sides", lambda e: e[b])))
    cell = lambda v: F.floor(v / size).cast("long")
    xs = F.sequence(cell(ends(F.array_min, "x1", "x2") - margin), cell(ends(F.array_max, "x1", "x2") + margin))
    ys = F.sequence(cell(ends(F.array_min, "y1", "y2") - margin), cell(ends(F.array_max, "y1", "y2") + margin))
    return p.withColumn("cx", F.explode(xs)).withColumn("cy", F.explode(ys))


def _in_cell(points: DataFrame, size: float) -> DataFrame:
    return points.withColumns({"cx": F.floor(F.col("lon") / size).cast("long"), "cy": F.floor(F.col("lat") / size).cast("long")})


def point_in_polygon(points: DataFrame, polygons: DataFrame, size: float, key: str = "point_id", poly: str = "poly_id") -> DataFrame:
    """points with the smallest poly_id of the polygons that they are strictly within, null where none."""
    found = _in_cell(points, size).join(cells(polygons, size).select("cx", "cy", poly, "sides"), ["cx", "cy"]).where(within(F.col("lon"), F.col("lat"), F.col("sides")))
    return points.join(found.groupBy(key).agg(F.min(poly).alias(poly)), key, "left")


def located(points: DataFrame, polygons: DataFrame, size: float, priority: tuple[str, ...], key: str = "point_id") -> DataFrame:
    """points with the polygon (kind, name) that covers them, the first kind of priority first."""
    rank = F.array_position(F.array(*map(F.lit, priority)), F.col("kind"))
    found = _in_cell(points, size).join(cells(polygons, size).select("cx", "cy", "kind", "name", "sides"), ["cx", "cy"]).where(covered(F.col("lon"), F.col("lat"), F.col("sides")))
    best = found.groupBy(key).agg(F.min_by(F.struct("kind", "name"), F.struct(rank, F.col("name"))).alias("p")).select(key, "p.kind", "p.name")
    return points.join(best, key, "left")


def snapped(points: DataFrame, polygons: DataFrame, size: float, most: float, key: str = "point_id", poly: str = "poly_id") -> DataFrame:
    """key and the nearest polygon within most of points in none."""
    near = _in_cell(points, size).join(cells(polygons, size, most).select("cx", "cy", poly, "sides"), ["cx", "cy"]).withColumn("d", distance(F.col("lon"), F.col("lat"), F.col("sides"))).where(F.col("d") <= most)
    return near.groupBy(key).agg(F.min_by(poly, F.struct("d", poly)).alias(poly), F.min("d").alias("d"))


def gated(candidates: DataFrame, tiers: list[str], escalate: bool = False) -> DataFrame:
    """candidates (row_id, has_point, and a boolean per tier, null where the tier does not apply) that pass the gate.

    The first tier that applies keeps the candidates inside it and those without a point; with escalate
    a tier that keeps none gives way to the next. A row without tiers keeps all.
    """
    w = Window.partitionBy("row_id")
    out, chosen = candidates, F.lit(None).cast("int")
    for k, t in reversed(list(enumerate(tiers))):
        applies = F.max(F.col(t).isNotNull()).over(w)
        any_kept = F.max(F.coalesce(F.col(t), F.lit(False)) | ~F.col("has_point")).over(w)
        chosen = F.when(applies & (any_kept | ~F.lit(escalate)), F.lit(k)).otherwise(chosen)
    out = out.withColumn("tier_", chosen)
    passes = F.col("tier_").isNull() & ~F.greatest(*[F.max(F.col(t).isNotNull()).over(w) for t in tiers]) if len(tiers) > 1 else F.col("tier_").isNull()
    for k, t in enumerate(tiers):
        passes = passes | ((F.col("tier_") == k) & (F.coalesce(F.col(t), F.lit(False)) | ~F.col("has_point")))
    return out.withColumn("kept", F.coalesce(passes, F.lit(False))).where("kept").drop("kept", "tier_")


def _gap(v: Column, low: Column, high: Column) -> Column:
    return F.greatest(low - v, v - high, F.lit(0.0))


def _length(dx: Column, dy: Column) -> Column:
    return F.sqrt(dx * dx + dy * dy)


#: Others in a leaf of nearest() on average, and the boxes that the search begins with at most.
LEAF, ROOTS = 4, 64


def nearest(points: DataFrame, others: DataFrame, k: int, size: float, same: bool = True) -> DataFrame:
    """The k nearest others (id, x, y) of each point (id, x, y), exactly, itself left out if same: id, other, d, slot.

    Others are dealt to cells of at most size and of LEAF or so on average. A point that has k others
    within a cell's width in the nine cells around it is done. For those that are not, the cells are
    the leaves of a quadtree of boxes around what is in them: from the top down, a point keeps the
    boxes that are no farther than k others surely are, and meets the others of the leaves that are
    left. Where and how dense points and others lie does not matter. Only the first others of one
    place, by id, can be among k.
    """
    spark = points.sparkSession
    most = k + 1 if same else k
    leaf = max(LEAF, most)
    placed = others.where("x is not null and y is not null").select(F.col("id").alias("other"), F.col("x").cast("double").alias("ox"), F.col("y").cast("double").alias("oy"))
    asked = points.where("x is not null and y is not null").select("id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    first = placed.withColumn("n_", F.row_number().over(Window.partitionBy("ox", "oy").orderBy("other"))).where(F.col("n_") <= most).drop("n_").persist()
    n, x0, x1, y0, y1 = first.agg(F.count("*"), F.min("ox"), F.max("ox"), F.min("oy"), F.max("oy")).first()
    if not n:
        return spark.createDataFrame([], "id long, other long, d double, slot int")
    # Cells of half the size hold a quarter: the mean over occupied cells says when they are small enough.
    cell = lambda c, low, at: F.floor((F.col(c) - low) / at).cast("long")
    wide = max(x1 - x0, y1 - y0)
    size = min(size, wide) or 1.0
    while wide / size < 1 << 40:
        held = first.select(cell("ox", x0, size).alias("cx"), cell("oy", y0, size).alias("cy")).distinct().count()
        if n <= held * leaf * 4:
            break
        size /= max(2.0, 2.0 ** int(math.log2(n / held / leaf) / 2))
    leaves = first.withColumns({"cx": cell("ox", x0, size), "cy": cell("oy", y0, size)}).persist()

    def best(pairs: DataFrame) -> DataFrame:
        if same:
            pairs = pairs.where(F.col("id") != F.col("other"))
        pairs = pairs.withColumn("d", _length(F.col("x") - F.col("ox"), F.col("y") - F.col("oy")))
        return pairs.withColumn("slot", F.row_number().over(Window.partitionBy("id").orderBy("d", "other"))).where(F.col("slot") <= k).select("id", "other", "d", "slot")

    around = asked.where(F.col("x").between(x0 - size, x1 + size) & F.col("y").between(y0 - size, y1 + size))
    steps = F.array(*map(F.lit, (-1, 0, 1)))
    looks = around.withColumn("dx", F.explode(steps)).withColumn("dy", F.explode(steps)).select("id", "x", "y", (cell("x", x0, size) + F.col("dx")).alias("cx"), (cell("y", y0, size) + F.col("dy")).alias("cy"))
    top = best(looks.join(leaves, ["cx", "cy"])).persist()
    # A little less than a cell's width: cells are found by a division that rounds.
    done = top.groupBy("id").agg(F.count("*").alias("n_"), F.max("d").alias("far_")).where((F.col("n_") == k) & (F.col("far_") <= 0.999 * size)).select("id")
    asked = asked.join(done, "id", "left_anti").persist()
    if asked.isEmpty():
        return top
    box = [F.sum("n").alias("n"), F.min("xa").alias("xa"), F.max("xz").alias("xz"), F.min("ya").alias("ya"), F.max("yz").alias("yz")]
    levels = [leaves.select("cx", "cy", F.lit(1).alias("n"), F.col("ox").alias("xa"), F.col("ox").alias("xz"), F.col("oy").alias("ya"), F.col("oy").alias("yz")).groupBy("cx", "cy").agg(*box).persist()]
    while levels[-1].count() > ROOTS:
        levels.append(levels[-1].groupBy(F.shiftright("cx", 1).alias("cx"), F.shiftright("cy", 1).alias("cy")).agg(*box).persist())
    boxes = ["cx", "cy", "n", "xa", "xz", "ya", "yz"]
    found = asked.crossJoin(F.broadcast(levels[-1].select(*boxes)))
    by_point = Window.partitionBy("id", "x", "y")
    for level in reversed(levels):
        if level is not levels[-1]:
            up = level.select(F.shiftright("cx", 1).alias("px"), F.shiftright("cy", 1).alias("py"), *boxes)
            found = found.select("id", "x", "y", F.col("cx").alias("px"), F.col("cy").alias("py")).join(up, ["px", "py"])
        far = _length(F.greatest(F.abs(F.col("x") - F.col("xa")), F.abs(F.col("x") - F.col("xz"))), F.greatest(F.abs(F.col("y") - F.col("ya")), F.abs(F.col("y") - F.col("yz"))))
        near = _length(_gap(F.col("x"), F.col("xa"), F.col("xz")), _gap(F.col("y"), F.col("ya"), F.col("yz")))
        found = found.withColumns({"far": far, "near": near})
        found = found.withColumn("sure", F.sum("n").over(by_point.orderBy("far").rangeBetween(Window.unboundedPreceding, Window.currentRow)))
        reach = F.min(F.when(F.col("sure") >= most, F.col("far"))).over(by_point)
        found = found.withColumn("reach", reach).where("reach is null or near <= reach").select("id", "x", "y", "cx", "cy")
    return top.join(done, "id", "left_semi").unionByName(best(found.join(leaves, ["cx", "cy"])))


def ring_polygons(rings: list[list[list[float]]]) -> list[list[list[list[float]]]]:
    """Rings as polygons, each a shell with its holes: clockwise rings are shells, others holes of the smallest shell around them."""
    def area(r: list) -> float:
        return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(r, [*r[1:], r[0]])) / 2

    def has(r: list, p: list) -> bool:
        odd = False
        for (x1, y1), (x2, y2) in zip(r, [*r[1:], r[0]]):
            if (y1 > p[1]) != (y2 > p[1]) and p[0] < (x2 - x1) * (p[1] - y1) / (y2 - y1) + x1:
                odd = not odd
        return odd

    shells = [[r] for r in rings if len(r) >= 3 and area(r) < 0]
    for hole in (r for r in rings if len(r) >= 3 and area(r) > 0):
        around = [s for s in shells if has(s[0], hole[0])]
        if around:
            min(around, key=lambda s: -area(s[0])).append(hole)
        else:  # drawn the wrong way round
            shells.append([hole])
    return shells


def polygons_wkb(rings: list[list[list[float]]]) -> bytes:
    """Rings as well-known binary: a polygon, or a multipolygon where there are several shells."""
    import struct

    def one(p: list) -> bytes:
        out = struct.pack("<BII", 1, 3, len(p))
        for r in p:
            closed = r if r[0] == r[-1] else [*r, r[0]]
            out += struct.pack("<I", len(closed)) + b"".join(struct.pack("<2d", *q) for q in closed)
        return out

    parts = ring_polygons(rings)
    return one(parts[0]) if len(parts) == 1 else struct.pack("<BII", 1, 6, len(parts)) + b"".join(map(one, parts))


def within_buffer(points: DataFrame, polygons: DataFrame, size: float, buffer_m: float, key: str = "point_id", poly: str = "poly_id") -> DataFrame:
    """key and poly of each polygon that covers a point, or is within buffer_m of it (111,000 metres a degree)."""
    most = buffer_m / 111_000
    near = _in_cell(points, size).join(cells(polygons, size, most).select("cx", "cy", poly, "sides"), ["cx", "cy"])
    return near.where(covered(F.col("lon"), F.col("lat"), F.col("sides")) | (distance(F.col("lon"), F.col("lat"), F.col("sides")) <= most)).select(key, poly).distinct()


def spacing(points: DataFrame, size: float) -> DataFrame:
    """One row: quartiles of the distance to the nearest other point. points: id, x, y."""
    d = nearest(points, points, 1, size).select("d")
    return d.agg(F.count("*").alias("n"), *[F.percentile("d", F.lit(p)).alias(n) for n, p in (("p25", 0.25), ("median", 0.5), ("p75", 0.75))])


def with_truth(samples: DataFrame, parcels: DataFrame, docs: DataFrame, polygons: DataFrame, size: float) -> DataFrame:
    """samples (row_id, lon, lat) with the parcel that holds the point, its address, and the document of that address: gt_parcel, gt_address, gt_doc_id, each null where there is none.

    parcels (poly_id, direccion); docs (doc_id, direccion), whose addresses are compared with spaces collapsed, the first document of an address.
    """
    from ..functions.columns import collapsed

    held = point_in_polygon(samples, polygons, size, key="row_id").withColumnRenamed("poly_id", "gt_parcel")
    told = held.join(parcels.select(F.col("poly_id").alias("pp"), collapsed(F.col("direccion")).alias("gt_address")), F.col("gt_parcel") == F.col("pp"), "left").drop("pp")
    first = docs.groupBy(collapsed(F.col("direccion")).alias("da")).agg(F.min("doc_id").alias("gt_doc_id"))
    return told.join(first, F.col("gt_address") == F.col("da"), "left").drop("da")
