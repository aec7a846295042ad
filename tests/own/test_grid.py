import random

import pytest
from pyspark.sql import functions as F

from quire.operators import align as A


def slow(points, boxes, slack=2.0):
    """Every point against every box of its page."""
    out = {}
    for doc, page, point, x, y in points:
        mine = sorted((b for b in boxes if b[:2] == (doc, page)), key=lambda b: b[2])
        hits = [b for b in mine if b[4] - slack <= x <= b[6] + slack and b[5] - slack <= y <= b[7] + slack]
        near = sorted(mine, key=lambda b: ((x - (b[4] + b[6]) / 2) ** 2 + (y - (b[5] + b[7]) / 2) ** 2, b[2]))
        if mine:
            out[doc, point] = (hits or near)[0][3]
    return out


POINT, BOX = "id long, page int, point long, x double, y double", "id long, page int, ord long, idx int, x0 double, y0 double, x1 double, y1 double"


@pytest.mark.parametrize("seed", range(4))
def test_hits_equal_every_pair(spark, seed):
    rng = random.Random(seed)
    boxes, points = [], []
    for page in range(3):
        spots = [(rng.uniform(0, 600), rng.uniform(0, 800)) for _ in range(rng.choice([1, 4, 60]))]
        for k, (x, y) in enumerate(spots):
            w, h = rng.choice([(0, 0), (30, 8), (30, 8), (700, 900)]) if seed else (30, 8)
            boxes.append((1, page, len(boxes) * 7 % 101, k, x, y, x + w, y + h))
        for _ in range(60):
            x, y = rng.choice(spots) if rng.random() < 0.3 else (rng.uniform(-900, 1500), rng.uniform(-50, 900))
            points.append((1, page, len(points), float(x), float(y)))
    boxes += [(2, 0, k, k, 5.0 * k, 5.0, 5.0 * k, 5.0) for k in range(20)]  # middles on a line, ties between them
    points += [(2, 0, 1000 + k, 2.5 * k, 60.0) for k in range(45)] + [(3, 0, 2000, 1.0, 1.0)]  # and a page without boxes
    got = A.hit(spark.createDataFrame(points, POINT), spark.createDataFrame(boxes, BOX))
    assert {(r.id, r.point): r.idx for r in got.collect()} == slow(points, boxes)


def test_pairs_grow_with_neighbours(spark):
    """Four times the boxes and points of a page make about four times the pairs, not sixteen."""
    pairs = []
    for side in (20, 40):
        boxes = [(1, 0, i * side + j, i * side + j, 30.0 * i, 12.0 * j, 30.0 * i + 25, 12.0 * j + 8) for i in range(side) for j in range(side)]
        points = [(1, 0, i * side + j, 30.0 * i + 27.5, 12.0 * j + 3) for i in range(side) for j in range(side)]
        p, b = spark.createDataFrame(points, POINT), spark.createDataFrame(boxes, BOX)
        grid = A.gridded(b, 0.0)
        placed, there = p.join(grid, ["id", "page"]), b.join(grid, ["id", "page"])
        middles = there.withColumns({"mx": (F.col("x0") + F.col("x1")) / 2, "my": (F.col("y0") + F.col("y1")) / 2})
        pairs.append(A.candidates(placed, there, 0.0).count() + A.neighbours(placed, middles, 0).count())
    assert pairs[1] < 5 * pairs[0] and pairs[1] < 20 * 1600


def test_no_points_and_no_boxes(spark):
    p, b = spark.createDataFrame([], POINT), spark.createDataFrame([], BOX)
    assert A.hit(p, b).count() == 0 and A.hit(spark.createDataFrame([(1, 0, 1, 1.0, 1.0)], POINT), b).count() == 0
