import hashlib
import random

import pytest
from pyspark.sql import functions as F

from lindero.functions import columns as C
from lindero.functions.hashing import nearest_by_md5
from lindero.operators import augment, evaluation, geo, retrieval, splits
from lindero.sources.readers import geometry_centre, wkb_geometry


def test_ring_polygons():
    shell, hole, other = [[0, 0], [0, 4], [4, 4], [4, 0]], [[1, 1], [2, 1], [2, 2], [1, 2]], [[9, 9], [9, 10], [10, 10], [10, 9]]
    assert geo.ring_polygons([shell, hole, other]) == [[shell, hole], [other]]
    g, _ = wkb_geometry(geo.polygons_wkb([shell, other]))
    assert g["type"] == "MultiPolygon" and len(g["coordinates"]) == 2
    assert geometry_centre(wkb_geometry(geo.polygons_wkb([shell]))[0]) == (2.0, 2.0)


def test_nearest_is_exact(spark):
    rng = random.Random(1)
    pts = [(k, rng.random() * 100, rng.random() * 100) for k in range(60)]
    df = spark.createDataFrame(pts, "id long, x double, y double")
    got = {}
    for r in geo.nearest(df, df, 3, 7.0).collect():
        got.setdefault(r.id, []).append((r.slot, r.other))
    for i, x, y in pts:
        want = sorted((((x - a) ** 2 + (y - b) ** 2) ** 0.5, j) for j, a, b in pts if j != i)[:3]
        assert [o for _, o in sorted(got[i])] == [j for _, j in want]


def _k_nearest(points, others, k, same):
    rows = []
    for i, x, y in points:
        near = sorted((((x - a) * (x - a) + (y - b) * (y - b)) ** 0.5, j) for j, a, b in others if not same or j != i)[:k]
        rows += [(i, j, slot + 1) for slot, (_, j) in enumerate(near)]
    return sorted(rows)


@pytest.mark.parametrize("same", [True, False])
def test_nearest_far_dense_and_equal(spark, same):
    """One point is far from all others, many others share a place, and a grid of whole numbers has many ties."""
    rng = random.Random(6)
    spots = [(7.0, 7.0)] * 60 + [(float(rng.randrange(40)), float(rng.randrange(40))) for _ in range(500)] + [(3e5, -2e5), (3e5 + 1, -2e5)] + [(5 + rng.random() / 1e6, 5.0) for _ in range(200)]
    others = [(k, x, y) for k, (x, y) in enumerate(spots)]
    points = others if same else [(k, x + 0.5 * (k % 2), y) for k, x, y in others[:300]] + [(5000, 1e7, 1e7), (5001, -4.0, 1e6)]
    o, p = (spark.createDataFrame(r, "id long, x double, y double") for r in (others, points))
    assert sorted((r.id, r.other, r.slot) for r in geo.nearest(p, o, 3, 32.0, same).collect()) == _k_nearest(points, others, 3, same)


def test_nearest_of_few(spark):
    o = spark.createDataFrame([(1, 2.0, 3.0), (2, 2.0, 3.0)], "id long, x double, y double")
    assert sorted((r.id, r.other, r.slot) for r in geo.nearest(o, o, 3, 32.0).collect()) == [(1, 2, 1), (2, 1, 1)]
    assert geo.nearest(o, o.where("id > 5"), 3, 32.0).count() == 0


def test_top_k_in_parts(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(k, [rng.gauss(0, 1) for _ in range(8)]) for k in range(80)]
    d = spark.createDataFrame(rows, "doc_id long, vec array<double>")
    q = d.withColumnRenamed("doc_id", "row_id")
    one = sorted(map(tuple, retrieval.top_k_vectors(q, d, 4, 6).collect()))
    monkeypatch.setattr(retrieval, "BROADCAST_BYTES", 8 * 8 * 30)
    assert sorted(map(tuple, retrieval.top_k_vectors(q, d, 4, 6).collect())) == one


def test_projection_and_knots(spark):
    r = spark.range(1).select(*C.to_metric(F.lit(-74.07750791666666), F.lit(4.596200416666666)), C.interpolated(F.lit(0.35), [0.2, 0.5], [0.0, 1.0]), C.interpolated(F.lit(None).cast("double"), [0.2, 0.5], [0.1, 1.0])).first()
    assert r[0] == pytest.approx(1e6, abs=1e-6) and r[1] == pytest.approx(1e6, abs=1e-6) and r[2] == pytest.approx(0.5) and r[3] == 0.1


def test_leakage(spark):
    a = spark.createDataFrame([("x",)], "k string")
    with pytest.raises(splits.LeakageError):
        splits.assert_disjoint({"a": a, "b": a}, "k")


def test_variants_do_not_depend_on_partitions(spark):
    d = spark.createDataFrame([(k, f"CL {k} # 3 - 0{k % 10}") for k in range(30)], "doc_id long, direccion string")
    one = sorted(map(tuple, augment.variants(d.repartition(1), 3, 7).collect()))
    assert one == sorted(map(tuple, augment.variants(d.repartition(5), 3, 7).collect())) and len(one) == 90


def test_ships():
    assert evaluation.ships({"brier": 0.1, "ece": 0.02}, {"brier": 0.2, "ece": 0.02}) and not evaluation.ships({"brier": 0.1, "ece": 0.03}, {"brier": 0.2, "ece": 0.02})


def test_label_quality(spark):
    rows = spark.createDataFrame([(1, "Calle 10 # 20-30", "CL 10 20 30"), (2, "Calle 10 # 20-30", "Calle 11 # 20-30"), (3, "Calle 10 # 20-30", None), (4, "nada", "Calle 10 # 20-30")], "k long, a string, b string")
    parsed = rows.withColumns({"a": C.parse_address("a"), "b": F.when(F.col("b").isNotNull(), C.parse_address("b"))})
    got = {r.k: r.gt_quality for r in splits.label_quality(parsed, F.col("a"), F.col("b")).collect()}
    assert got == {1: "gold", 2: "noisy", 3: "no_gt", 4: "noisy"}


def test_snapped(spark):
    square = lambda x: [[(x, 0.0), (x, 1.0), (x + 1, 1.0), (x + 1, 0.0), (x, 0.0)]]
    polygons = spark.createDataFrame([(1, square(0.0)), (2, square(3.0))], "poly_id long, rings array<array<struct<x:double,y:double>>>")
    points = spark.createDataFrame([(1, 1.4, 0.5), (2, 2.7, 0.5), (3, 9.0, 9.0), (4, 2.0, 0.5)], "point_id long, lon double, lat double")
    got = {r.point_id: (r.poly_id, round(r.d, 6)) for r in geo.snapped(points, polygons, 0.5, 0.5).collect()}
    assert got == {1: (1, 0.4), 2: (2, 0.3)}


def test_md5_of_pairs():
    rng = random.Random(4)
    left = [b"%d|" % rng.randrange(10 ** rng.randrange(1, 12)) for _ in range(30)] + [b"", b"x" * 50, "ñ|".encode()]
    right = [b"%d|7" % rng.randrange(10 ** rng.randrange(1, 12)) for _ in range(90)] + [b"", b"7", b"y" * 70]
    for others in (right, right[:-1], right[:1], []):
        got = {}
        for i, j, digest in nearest_by_md5(left, others, 2):
            got.setdefault(i, []).append((digest, others[j]))
        for i, x in enumerate(left):
            assert sorted(got.get(i, []))[:2] == sorted((hashlib.md5(x + y).digest(), y) for y in others)[:2]


def test_corners_in_lists(spark, monkeypatch):
    monkeypatch.setattr(splits, "CORNER_LIST", 16)
    rng = random.Random(5)
    rows = [(k, rng.randrange(3), rng.randrange(3), rng.randrange(2)) for k in range(400)] + [(400, None, 1, 0), (401, 1, 2, None)]
    got = {}
    found = splits.corner_neighbours(spark.createDataFrame(rows, "doc_id long, via long, cross long, plate long"), 7, 3)
    for r in found.collect():
        got.setdefault(r.doc_id, []).append((r.slot, r.neg_doc_id))
    for k, via, cross, plate in rows:
        others = [j for j, v, c, p in rows if None not in (via, cross, plate) and (v, c, p) == (cross, via, plate) and via != cross]
        want = sorted(others, key=lambda j: hashlib.md5(f"{k}|{j}|7".encode()).hexdigest())[:3]
        assert [o for _, o in sorted(got.get(k, []))] == want
    # All pairs of a corner are ranked where its lists meet, none is sorted or dealt as a row.
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Window") < plan.index("MapInArrow") < plan.index("Join")
