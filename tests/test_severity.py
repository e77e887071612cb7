"""Suppression and view scores against plain recomputation."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from hammerline.operators import severity as S
from hammerline.plans import catalog as C

BOXES = "vin string, class string, box_id long, conf double, x1 double, y1 double, x2 double, y2 double"


def overlap(a, b):
    w, h = max(0.0, min(a[2], b[2]) - max(a[0], b[0])), max(0.0, min(a[3], b[3]) - max(a[1], b[1]))
    whole = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h
    return w * h / whole if whole else 0.0


def greedy(rows, t):
    out = set()
    for key in {r[:2] for r in rows}:
        kept = []
        for r in sorted((r for r in rows if r[:2] == key), key=lambda r: (-r[3], r[2])):
            if all(overlap(k[4:], r[4:]) <= t for k in kept):
                kept.append(r)
        out |= {r[:3] for r in kept}
    return out


@pytest.mark.parametrize("threshold", [0.5, 0.3])
def test_crowded_views(spark, threshold):
    r = random.Random(7)

    def box(vin, i, spread, largest):
        x, y, w, h = r.uniform(0, spread), r.uniform(0, spread), r.uniform(0.5, largest), r.uniform(0.5, largest)
        return vin, r.choice(["dent", "crash"]), i, round(r.random(), 2), x, y, x + w, y + h

    rows = [box("crowd", i, 150, 30) for i in range(2500)] + [box("few", i, 20, 30) for i in range(60)]
    rows += [("equal", "dent", i, 0.5, 1.0, 1.0, 3.0, 4.0) for i in range(700)] + [("flat", "dent", i, 0.5, 1.0, 1.0, 1.0, 4.0) for i in range(300)]
    df = spark.createDataFrame(rows, BOXES).withColumn("_lw", F.lit("x"))
    got = S.suppressed(df, ["vin"], threshold)
    assert got.columns == ["vin", "class", "box_id", "conf", "x1", "y1", "x2", "y2"]
    found = got.select("vin", "class", "box_id").collect()
    assert len(found) == len(set(found)) and {tuple(x) for x in found} == greedy(rows, threshold)
    assert S.suppressed(df.limit(0), ["vin"], threshold).count() == 0


def _area(boxes):
    import math

    cells = {(x, y) for b in boxes for x in range(math.floor(b["x1"]), math.ceil(b["x2"])) for y in range(math.floor(b["y1"]), math.ceil(b["y2"]))}
    return float(len(cells))


def _view(boxes):
    """Severity, extent, raw, and number of boxes of one view; the rules one by one."""
    cfg = S.Scoring()
    anchored = any((b["class"] == "no part" and b["conf"] >= 0.70) or (b["class"] == "crash" and b["conf"] >= 0.60) for b in boxes)
    kept = [b for b in boxes if b["conf"] >= S.CLASS_MIN_CONF.get(b["class"], 0.30) or (anchored and b["class"] in S.SUPPORT and b["conf"] >= 0.25)]
    kept = kept or [b for b in boxes if b["conf"] >= 0.30]
    if not kept:
        return None, 0.0, 0.0, 0
    top = max(b["conf"] for b in kept)
    hull = (max(b["x2"] for b in kept) - min(b["x1"] for b in kept)) * (max(b["y2"] for b in kept) - min(b["y1"] for b in kept))
    floor = 0.10 if anchored or top >= 0.60 else 0.04
    extent = min(_area(kept) / max(hull, floor * 200 * 150), 0.95)
    weights = [S.CLASS_WEIGHT[b["class"]] for b in kept]
    raw = extent * (0.60 * statistics.fmean(weights) + 0.40 * max(weights)) * (1 + 0.02 * min(len(kept), 8))
    s, has = min(1.0, max(0.0, (top - 0.40) / 0.35)), {b["class"] for b in kept}
    raw += s * cfg.crash * ("crash" in has) + s * cfg.no_part * ("no part" in has and (extent > 0.10 or anchored))
    raw += s * cfg.glass * ("glass shatter" in has) + s * cfg.tire * ("tire flat" in has and bool(has & {"dent", "dislocated part", "crash"}))
    if {"no part", "lamp broken"} <= has and extent >= 0.12:
        raw = max(raw, 0.55)
    raw = raw / (raw + 0.35)
    return min(5.0, max(1.0, round((1 + 4 * min(1.0, max(0.0, raw))) * 2) / 2)), extent, raw, len(kept)


@pytest.fixture(scope="module")
def views(spark):
    boxes = C.Given(spark, "/root/testdata/sf0.001").make("boxes")
    found = {}
    for b in boxes.collect():
        found.setdefault((b["vin"], b["channel"], b["view_no"]), []).append(b)
    return boxes, {k: _view(v) for k, v in found.items()}


def test_view_scores(views):
    boxes, want = views
    got = {(r.vin, r.channel, r.view_no): r for r in S.view_scores(boxes, ["vin", "channel", "view_no"]).collect()}
    assert got.keys() == want.keys()
    for k, (severity, extent, raw, n) in want.items():
        assert (got[k].severity, got[k].n_boxes) == (severity, n)
        assert got[k].extent == pytest.approx(extent) and got[k].raw == pytest.approx(raw)


def test_scored_vehicles(spark, views):
    boxes, scored = views
    cars = C.vehicles(C.Given(spark, "/root/testdata/sf0.001"))
    got = {r.vin: r for r in S.score_vehicles(cars, boxes).collect()}
    for car in cars.collect():
        worst = {}
        for channel, asked in (("primary", {1, 2} if car.damage_primary == "FRONT END" else set()), ("secondary", {1, 2, 3, 4})):
            worst[channel] = max((s[0] for (vin, c, view), s in scored.items() if vin == car.vin and c == channel and view in asked and s[0] is not None), default=None)
        assert (got[car.vin].damage_primary_severity, got[car.vin].damage_secondary_severity) == (worst["primary"], worst["secondary"])
