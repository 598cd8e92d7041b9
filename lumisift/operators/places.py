"""Nearest place of a point through an octree whose crowded cells are split, descended by all points at once.

Places lie on the unit sphere. A cell with more than LEAF_PLACES places is split, so dense regions get small cells and
empty ones none. All points go down together, one step of the tree per round, as (point, cell) rows: a cell stays with a
point only if its nearest possible place is not farther than the farthest possible place of some other cell, so each
point keeps a few cells, whatever the density. The places of the last cells are compared in a join that keeps the best
of each point before the shuffle; no cell is gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import lookup
from ..session import cut_lineage

LEAF_PLACES = 32
# a step halves the side of a cell STEP times; cells of the last step are some metres wide
STEP, STEPS = 2, 10
AXES = ("x", "y", "z")
# chords are compared in these units: equal distances differ in the last bits, and the place id decides
UNIT = 1e12
_SLACK = 1e-11


def _sphere(lat: Column, lon: Column) -> dict[str, Column]:
    a, o = F.radians(lat), F.radians(lon)
    return {"x": F.cos(a) * F.cos(o), "y": F.cos(a) * F.sin(o), "z": F.sin(a)}


def _cell(step: int, prefix: str = "") -> dict[str, Column]:
    """Cell numbers of a position at a step; the cube around the sphere has side 2."""
    n = 1 << (STEP * step)
    return {f"c{a}": F.least(F.floor((F.col(prefix + a) + 1) * (n / 2)), F.lit(n - 1)).cast("int") for a in AXES}


def _square(parts: list[Column]) -> Column:
    out = F.lit(0.0)
    for p in parts:
        out = out + p * p
    return out


def _range(step: int) -> tuple[Column, Column]:
    """(nearest, farthest) possible squared chord between a point (x, y, z) and the cell (cx, cy, cz)."""
    side = 2.0 / (1 << (STEP * step))
    near, far = [], []
    for a in AXES:
        low = F.col(f"c{a}") * side - 1
        near.append(F.greatest(low - F.col(a), F.col(a) - (low + side), F.lit(0.0)))
        far.append(F.greatest(F.abs(F.col(a) - low), F.abs(F.col(a) - (low + side))))
    return _square(near), _square(far)


def _tree(places: DataFrame) -> list[tuple[DataFrame, DataFrame]]:
    """(cells of each step below split cells, with their number of places; places of the cells that are not split)."""
    rest, out = places, []
    cells = [f"c{a}" for a in AXES]
    for step in range(1, STEPS + 1):
        rest = rest.withColumns(_cell(step))
        sizes = cut_lineage(rest.groupBy(*cells).agg(F.count("*").alias("n")))
        split = (F.col("n") > LEAF_PLACES) if step < STEPS else F.lit(False)
        marked = rest.join(sizes, cells).withColumn("split", split)
        marked = cut_lineage(marked)
        out.append((sizes.withColumn("split", split), marked.filter(~F.col("split")).drop("n", "split")))
        rest = marked.filter("split").drop("n", "split", *cells)
        if rest.isEmpty():
            break
    return out


def nearest_place(
    points: DataFrame, places: DataFrame, overrides: dict[str, str] | None = None, lat: str = "lat", lon: str = "lon",
    name: str = "location",
) -> DataFrame:
    """Nearest place (place_id, name, cc, lat, lon) of each point as ``"name, CC"``; null for a point without coordinates.

    Exact by chord, which orders as the great circle does; equal chords go to the smaller place_id. Distinct coordinates
    of points and of places are handled once. Places without coordinates take no part; without places all are null.
    """
    spots = places.filter(F.col("lat").isNotNull() & F.col("lon").isNotNull()).withColumns(_sphere(F.col("lat"), F.col("lon")))
    # of places at one spot the smallest id wins
    spots = cut_lineage(spots.groupBy(*AXES).agg(F.min(F.struct("place_id", "name", "cc")).alias("p")))
    asked = points.select(F.col(lat).alias("_lat"), F.col(lon).alias("_lon")).filter(
        F.col("_lat").isNotNull() & F.col("_lon").isNotNull()).distinct()
    asked = cut_lineage(asked.withColumns(_sphere(F.col("_lat"), F.col("_lon"))).withColumn("id", F.monotonically_increasing_id()))
    cells, up = [f"c{a}" for a in AXES], [f"u{a}" for a in AXES]
    # (point, cell): a point starts above all cells of the first step
    at = asked.select("id", *AXES, F.lit(float("inf")).alias("most"), *[F.lit(0).alias(u) for u in up])
    leaves = []
    for step, (sizes, held) in enumerate(_tree(spots), 1):
        above = sizes.withColumns({u: F.shiftright(c, STEP) for u, c in zip(up, cells)})
        near, far = _range(step)
        met = at.join(above, up).withColumn("near", near).withColumn("far", far).filter(
            F.col("near") <= F.col("most") + _SLACK)
        met = cut_lineage(met.select("id", *AXES, *cells, "split", "near", "far", "most"))
        # cells kept from earlier steps bound the point as well
        bound = met.groupBy("id").agg(F.min(F.least("far", "most")).alias("most"))
        met = met.drop("most").join(bound, "id").filter(F.col("near") <= F.col("most") + _SLACK)
        leaves.append((step, met.filter(~F.col("split")).select("id", *AXES, *cells, "near"), held))
        at = met.filter("split").select("id", *AXES, "most", *[F.col(c).alias(u) for c, u in zip(cells, up)])
    best = None
    for _, met, held in leaves:
        spot = held.select(*cells, *[F.col(a).alias(f"p{a}") for a in AXES], "p")
        chord = _square([F.col(a) - F.col(f"p{a}") for a in AXES])
        one = met.join(spot, cells).groupBy("id").agg(F.min(F.struct(F.rint(chord * UNIT).alias("d"), F.col("p"))).alias("b"))
        best = one if best is None else best.unionByName(one)
    if best is None:
        return points.withColumn(name, F.lit(None).cast("string"))
    best = best.groupBy("id").agg(F.min("b").alias("b"))
    cc = F.col("b.p.cc")
    if overrides:
        cc = F.coalesce(lookup(cc, overrides, "overrides"), cc)
    found = asked.join(best, "id").select(
        F.col("_lat").alias(f"{name}__lat"), F.col("_lon").alias(f"{name}__lon"), F.concat_ws(", ", F.col("b.p.name"), cc).alias(f"{name}__found"))
    joined = points.join(found, (F.col(lat) == F.col(f"{name}__lat")) & (F.col(lon) == F.col(f"{name}__lon")), "left")
    return joined.withColumn(name, F.col(f"{name}__found")).drop(f"{name}__found", f"{name}__lat", f"{name}__lon")
