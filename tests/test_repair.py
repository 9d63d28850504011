"""Polygon repair and union: areas of exact cases, rings, and random shapes against a count of points."""

import random
from math import isclose

import pytest

from confluo.operators import geo, repair

BOX = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]


def moved(ring, dx, dy, scale=1.0):
    return [(x * scale + dx, y * scale + dy) for x, y in ring]


def shape(*rings):
    """Rings: (is_hole, shell, points)."""
    return [(h, s, pts) for h, s, pts in rings]


CASES = {
    "plain": (shape((False, 0, BOX)), 16.0, 1, 0),
    "turned": (shape((False, 0, BOX[::-1])), 16.0, 1, 0),
    "holed": (shape((False, 0, BOX), (True, 0, moved(BOX, 1, 1, 0.25))), 15.0, 1, 1),
    "bow-tie": (shape((False, 0, [(0.0, 0.0), (2.0, 2.0), (2.0, 0.0), (0.0, 2.0)])), 2.0, 2, 0),
    "star": (shape((False, 0, [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (1.0, -1.0), (0.0, 4.0)])), None, None, None),
    "apart": (shape((False, 0, BOX), (False, 1, moved(BOX, 9, 0))), 32.0, 2, 0),
    "touching in a side": (shape((False, 0, BOX), (False, 1, moved(BOX, 4, 0))), 32.0, 1, 0),
    "touching in part of a side": (shape((False, 0, BOX), (False, 1, moved(BOX, 4, 1, 0.5))), 20.0, 1, 0),
    "touching in a corner": (shape((False, 0, BOX), (False, 1, moved(BOX, 4, 4))), 32.0, 2, 0),
    "overlapping": (shape((False, 0, BOX), (False, 1, moved(BOX, 2, 2))), 28.0, 1, 0),
    "twice": (shape((False, 0, BOX), (False, 1, BOX)), 16.0, 1, 0),
    "one in another": (shape((False, 0, BOX), (False, 1, moved(BOX, 1, 1, 0.5))), 16.0, 1, 0),
    "hole filled by a part": (shape((False, 0, BOX), (True, 0, moved(BOX, 1, 1, 0.5)), (False, 2, moved(BOX, 1, 1, 0.5))), 16.0, 1, 0),
    "part in a hole": (shape((False, 0, BOX), (True, 0, moved(BOX, 1, 1, 0.5)), (False, 2, moved(BOX, 1.5, 1.5, 0.25))), 13.0, 2, 1),
    "hole out of its shell": (shape((False, 0, BOX), (True, 0, moved(BOX, 2, 2))), 24.0, 2, 0),
    "hole that touches its shell": (shape((False, 0, BOX), (True, 0, [(0.0, 2.0), (2.0, 1.0), (2.0, 3.0)])), 14.0, 1, None),
    "spike": (shape((False, 0, [(0.0, 0.0), (4.0, 0.0), (9.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)])), 16.0, 1, 0),
    "repeated places": (shape((False, 0, [BOX[0], BOX[0], *BOX[1:], BOX[0]])), 16.0, 1, 0),
}


@pytest.fixture(scope="module")
def polygons(spark):
    rows = [(k, c[0]) for k, c in CASES.items()] + [("empty", []), ("null", None), ("line", shape((False, 0, [(0.0, 0.0), (1.0, 1.0), (2.0, 2.0)]))), ("two places", shape((False, 0, BOX[:2])))]
    return spark.createDataFrame(rows, f"code string, rings {repair.RINGS}")


def test_areas_of_exact_cases(polygons):
    got = {r.code: r.area for r in repair.areas(repair.valid_sides(polygons)).collect()}
    assert set(got) == set(CASES)
    for k, (_, area, _, _) in CASES.items():
        assert area is None or isclose(got[k], area, abs_tol=1e-6), (k, got[k], area)


def test_rings_of_exact_cases(polygons):
    found = repair.valid_polygons(polygons).cache()
    got = {r.code: r.rings for r in found.collect()}
    for k, (_, _, shells, holes) in CASES.items():
        if shells is not None:
            assert sum(not r.is_hole for r in got[k]) == shells, k
        if holes is not None:
            assert sum(r.is_hole for r in got[k]) == holes, k
    assert {r.shell for r in got["part in a hole"] if r.is_hole} == {max(range(3), key=lambda i: len(got["part in a hole"][i].pts) and max(p.x for p in got["part in a hole"][i].pts))}
    # Valid polygons stay as they are, and the operators that take rings see the repaired areas.
    again = {r.code: r.area for r in repair.areas(repair.valid_sides(found)).collect()}
    plain = {r.code: r.area for r in geo.shoelace(geo.edges(found)).collect()}
    for k, (_, area, _, _) in CASES.items():
        assert area is None or isclose(again[k], area, abs_tol=1e-6) and isclose(plain[k], area, abs_tol=1e-6), k


def test_cells_overlap_valid_polygons(spark, polygons):
    cells = spark.range(20 * 20).selectExpr("id div 20 AS i", "id % 20 AS j", "CAST(id div 20 AS double) - 3.3 AS lat", "CAST(id % 20 AS double) - 3.3 AS lon")
    found = geo.overlap_areas(repair.valid_polygons(polygons), cells, 1.0).selectExpr("code", "km2 / (111.32 * 111.32 * cos(radians(i - 3.3))) AS deg2")
    got = {r.code: r.area for r in found.groupBy("code").agg({"deg2": "sum"}).withColumnRenamed("sum(deg2)", "area").collect()}
    assert all(area is None or isclose(got[k], area, abs_tol=1e-6) for k, (_, area, _, _) in CASES.items())


def crossings(ring, x, y):
    return sum((y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1 for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True))


def test_random_shapes_hold_the_same_points(spark):
    r = random.Random(4)
    shapes, points = {}, {}
    for k in range(12):
        rings = [(False, s, [(r.uniform(0, 10), r.uniform(0, 10)) for _ in range(r.randint(3, 9))]) for s in range(r.randint(1, 4))]
        shapes[f"s{k}"] = rings
        points[f"s{k}"] = [(r.uniform(-1, 11), r.uniform(-1, 11)) for _ in range(60)]
    polygons = spark.createDataFrame(list(shapes.items()), f"code string, rings {repair.RINGS}")
    valid = repair.valid_polygons(polygons)
    asked = spark.createDataFrame([(i, k, *p) for k, some in points.items() for i, p in enumerate(some)], "p int, code string, lon double, lat double")
    sides = repair.valid_sides(polygons).selectExpr("code", "0 AS ring", "false AS is_hole", "x1", "y1", "x2", "y2")
    got = {(x.p, x.code) for x in geo.in_polygon(asked, sides, "p", own=True, band=0.5).collect()}
    want = {(i, k) for k, some in points.items() for i, p in enumerate(some) if any(crossings(ring, *p) % 2 for _, _, ring in shapes[k])}
    assert got == want and len(want) > 100
    areas = {x.code: x.area for x in geo.shoelace(geo.edges(valid)).collect()}
    assert all(isclose(areas[x.code], x.area, rel_tol=1e-6) for x in repair.areas(repair.valid_sides(polygons)).collect())


def test_small_polygons_stay_where_they_are_and_agree_with_the_joins(spark, polygons):
    r = random.Random(9)
    rings = [[(False, s, [(r.uniform(0, 10), r.uniform(0, 10)) for _ in range(r.randint(3, 6))]) for s in range(3)] for _ in range(40)]
    both = polygons.union(spark.createDataFrame([(f"r{k}", x) for k, x in enumerate(rings)], polygons.schema))
    small, joined = repair.valid_sides(both), repair.valid_sides(both, few=0)
    plan = small._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 1
    places = lambda df: sorted((x.code, *(round(v, 6) for v in x[1:])) for x in df.collect())
    assert places(small) == places(joined)
