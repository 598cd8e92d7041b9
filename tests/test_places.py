"""Nearest places through the octree, against all distances, with crowded cells."""

import math
import random

from lumisift.operators import places as pl


def brute(points, places):
    def xyz(la, lo):
        a, o = math.radians(la), math.radians(lo)
        return math.cos(a) * math.cos(o), math.cos(a) * math.sin(o), math.sin(a)

    at = [(xyz(la, lo), i, n, c) for i, n, c, la, lo in places if la is not None and lo is not None]
    out = {}
    for i, la, lo in points:
        if la is None or lo is None or not at:
            out[i] = None
            continue
        p = xyz(la, lo)
        best = min(at, key=lambda x: (round(sum((u - v) ** 2 for u, v in zip(p, x[0])) * 1e12), x[1]))
        out[i] = f"{best[2]}, {best[3]}"
    return out


def test_crowded_cells(spark):
    rng = random.Random(6)
    # nine of ten places in one town, some at one spot
    places = [(i, f"t{i}", "TT", 48.0 + rng.random() * 1e-3, 11.0 + rng.random() * 1e-3) for i in range(900)]
    places += [(1000 + i, f"s{i}", "SS", 48.0005, 11.0005) for i in range(60)]
    places += [(2000 + i, f"w{i}", "WW", rng.uniform(-90, 90), rng.uniform(-180, 180)) for i in range(100)]
    places += [(3000, "pole", "PP", 90.0, 0.0), (3001, "also pole", "PP", 90.0, 50.0), (3002, "nowhere", "NN", None, 1.0)]
    points = [(i, rng.uniform(-90, 90), rng.uniform(-180, 180)) for i in range(150)]
    points += [(200 + i, 48.0 + rng.uniform(-1, 2) * 1e-3, 11.0 + rng.uniform(-1, 2) * 1e-3) for i in range(100)]
    points += [(400, 48.0005, 11.0005), (401, 90.0, 10.0), (402, -90.0, 0.0), (403, 0.0, 180.0), (404, 0.0, -180.0), (405, None, 1.0), (406, 48.3, 11.4)]
    df = spark.createDataFrame(points + points[:5], "id int, lat double, lon double").repartition(3)
    table = spark.createDataFrame(places, "place_id int, name string, cc string, lat double, lon double").repartition(3)
    rows = pl.nearest_place(df, table).collect()
    assert len(rows) == len(points) + 5
    assert {r.id: r.location for r in rows} == brute(points, places)


def test_cells_stay_small(spark):
    """No unsplit cell of the tree holds more places than a leaf, however dense they lie."""
    rng = random.Random(2)
    places = [(i, f"t{i}", "TT", 48.0 + rng.random() * 1e-2, 11.0 + rng.random() * 1e-2) for i in range(1500)]
    table = spark.createDataFrame(places, "place_id int, name string, cc string, lat double, lon double")
    from pyspark.sql import functions as F

    spots = table.withColumns(pl._sphere(F.col("lat"), F.col("lon"))).select(*pl.AXES, F.struct("place_id", "name", "cc").alias("p"))
    tree = pl._tree(spots)
    assert sum(held.count() for _, held in tree) == 1500
    assert all(s.n <= pl.LEAF_PLACES for sizes, _ in tree for s in sizes.filter("not split").collect())


def test_without_places_or_points(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0), (2, None, None)], "id int, lat double, lon double")
    table = spark.createDataFrame([], "place_id int, name string, cc string, lat double, lon double")
    assert {r.location for r in pl.nearest_place(df, table).collect()} == {None}
    one = spark.createDataFrame([(5, "a", "NA", 1.0, 1.0)], table.schema)
    assert {r.id: r.location for r in pl.nearest_place(df, one, {"NA": "XX"}).collect()} == {1: "a, XX", 2: None}
    assert pl.nearest_place(df.limit(0), one).count() == 0
