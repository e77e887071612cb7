"""From tables of image detections to damage severity per view and vehicle.

A detection row is one box: keys of its view, class, conf, x1, y1, x2, y2 and a
box_id that is unique in its view.  Boxes of one view are few, so a view's
boxes are one array and everything on them is built-in array expressions.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from hammerline.functions import numbers as N, text as X
from hammerline.operators.prep import checked_broadcast
from hammerline.sources.fix import fixed

# Class weights, and the confidence from which a class counts.
CLASS_WEIGHT = {"scratch": 0.4, "rub": 0.5, "dent": 1.0, "crack": 1.1, "lamp broken": 1.2, "tire flat": 1.2, "dislocated part": 1.3, "no part": 1.4, "glass shatter": 1.4, "crash": 1.5}
CLASS_MIN_CONF = {"crash": 0.60, "no part": 0.60, "glass shatter": 0.50, "dislocated part": 0.45, "lamp broken": 0.45, "tire flat": 0.45}
CRITICAL = ["no part", "crash", "glass shatter", "dislocated part", "tire flat", "lamp broken"]
SUPPORT = ["lamp broken", "dislocated part"]
# Views that a damage region selects, by the number of photos; all others select every view.
REGION_VIEWS = {6: {"FRONT_END": [1, 4, 5], "REAR_END": [2, 3, 6], "SIDE": [1, 2, 3, 4]}, 4: {"FRONT_END": [1, 2], "REAR_END": [3, 4], "SIDE": [1, 2, 3, 4]}}
# What each view shows.
VIEW_NAMES = {6: {1: "front_left", 2: "rear_left", 3: "rear_right", 4: "front_right", 5: "front_center", 6: "rear_center"}, 4: {1: "front_right", 2: "front_left", 3: "rear_left", 4: "rear_right"}}


@dataclass
class Scoring:
    """Parameters of the view score; their usual values are fixed values."""

    base_conf: float = 0.30
    hull_floor: tuple[float, float] = (0.04, 0.10)
    extent_max: float = 0.95
    mix: tuple[float, float] = (0.60, 0.40)
    per_box: float = 0.02
    box_cap: int = 8
    saturation: float = 0.35
    ramp: tuple[float, float] = (0.40, 0.75)
    crash: float = 0.18
    no_part: float = 0.22
    glass: float = 0.12
    tire: float = 0.18
    pair_floor: float = 0.55
    pair_extent: float = 0.12
    half_steps: bool = True


BOX = "struct<box_id:bigint,class:string,conf:double,x1:double,y1:double,x2:double,y2:double>"


def tile_windows(images: DataFrame, grid: int = 2, overlap: float = 0.2, width: str = "img_w", height: str = "img_h") -> DataFrame:
    """The windows of a grid with overlap, the last flush with the edge; one row per image and window."""
    if not 0 <= overlap < 0.5:
        raise ValueError("the overlap must be in [0, 0.5)")

    def starts(size: Column) -> Column:
        tile = F.ceil(size / grid)
        step = F.greatest(F.floor(tile * (1 - overlap)), F.lit(1))
        last = F.greatest(size - tile, F.lit(0))
        return F.array_distinct(F.concat(F.filter(F.sequence(F.lit(0).cast("long"), last, step), lambda x: x < last), F.array(last)))

    w, h = F.col(width).cast("long"), F.col(height).cast("long")
    out = images.withColumn("wx", F.explode(starts(w))).withColumn("wy", F.explode(starts(h)))
    return out.withColumns({"ww": F.least(F.ceil(w / grid), w), "wh": F.least(F.ceil(h / grid), h)})


def to_image(df: DataFrame) -> DataFrame:
    """Boxes in window coordinates (wx, wy) to image coordinates."""
    return df.withColumns({"x1": F.col("x1") + F.col("wx"), "x2": F.col("x2") + F.col("wx"), "y1": F.col("y1") + F.col("wy"), "y2": F.col("y2") + F.col("wy")})


def named_classes(df: DataFrame, names: DataFrame) -> DataFrame:
    """Class ids to names, from a table (class_id, class)."""
    return df.join(checked_broadcast(names), "class_id", "left")


def iou(a: Column, b: Column) -> Column:
    w = F.greatest(F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]), F.lit(0.0))
    h = F.greatest(F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]), F.lit(0.0))
    area = lambda r: (r["x2"] - r["x1"]) * (r["y2"] - r["y1"])
    return F.coalesce(F.try_divide(w * h, area(a) + area(b) - w * h), F.lit(0.0))


#: Boxes of one view and class that are compared as one array; more are compared with those in nearby cells only.
FOLD_BOXES = 256


def _folded(df: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    box = F.struct((-F.col("conf")).alias("neg"), "box_id", "conf", "x1", "y1", "x2", "y2")
    own = df.groupBy(*keys).agg(F.array_sort(F.collect_list(box)).alias("b"))
    empty = F.array().cast("array<struct<neg:double,box_id:bigint,conf:double,x1:double,y1:double,x2:double,y2:double>>")
    fold = F.aggregate("b", empty, lambda kept, x: F.when(F.exists(kept, lambda k: iou(k, x) > threshold), kept).otherwise(F.concat(kept, F.array(x))))
    return own.withColumn("x", F.explode(fold)).select(*keys, *[F.col(f"x.{c}").alias(c) for c in ("box_id", "conf", "x1", "y1", "x2", "y2")])


def _gridded(df: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """Suppression by rounds over cells: the best undecided box of its surroundings stays, and those that it overlaps go.

    Boxes that overlap beyond the threshold have sides of a ratio under 1 / threshold
    and near centres, so a box is dealt to one cell by its sides' size classes and
    its centre, and looks at a bounded number of cells.  In a round it meets only
    the best box of each, and then the few new ones that stay.
    """
    base = 1.01 / threshold
    far = (1 - threshold if threshold >= 0.5 else 0.5 / threshold - 0.5) * (1 + 1e-9)
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    level = lambda side: F.floor(F.log(base, side)).cast("int")
    cell = lambda at, lv: F.floor(at / F.pow(F.lit(base), lv + 1))
    rank = F.struct((-F.col("conf")).alias("neg"), "box_id")
    rows = df.withColumns({"_w": w, "_h": h, "_cx": (F.col("x1") + F.col("x2")) / 2, "_cy": (F.col("y1") + F.col("y2")) / 2, "_rank": rank})
    flat = rows.where(~((F.col("_w") > 0) & (F.col("_h") > 0)))  # without area they overlap with nothing
    rows = rows.where((F.col("_w") > 0) & (F.col("_h") > 0)).withColumns({"_lw": level(F.col("_w")), "_lh": level(F.col("_h"))})
    rows = fixed(rows.withColumns({"_gx": cell(F.col("_cx"), F.col("_lw")), "_gy": cell(F.col("_cy"), F.col("_lh"))}))
    where, plain = [*keys, "_lw", "_lh", "_gx", "_gy"], df.columns
    kept: list[DataFrame] = [flat.select(*plain)]
    near = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    around = lambda at, side, lv: F.sequence(cell(F.col(at) - far * F.col(side), F.col(lv)), cell(F.col(at) + far * F.col(side), F.col(lv)))

    def looking(boxes: DataFrame) -> DataFrame:
        out = boxes.drop("_gx", "_gy").withColumn("_n", F.explode(near)).withColumns({"_lw": F.col("_lw") + F.col("_n.i"), "_lh": F.col("_lh") + F.col("_n.j")})
        return out.withColumn("_gx", F.explode(around("_cx", "_w", "_lw"))).withColumn("_gy", F.explode(around("_cy", "_h", "_lh")))

    while not rows.isEmpty():
        seen = looking(rows)
        best = rows.groupBy(*where).agg(F.min("_rank").alias("_best"))
        top = seen.select(*where, "_rank").join(best, where).groupBy(*keys, "_rank").agg(F.min("_best").alias("_best")).where("_best = _rank").select(*keys, "_rank")
        new = fixed(rows.join(top, [*keys, "_rank"], "left_semi"))
        kept.append(new.select(*plain))
        sides = ("x1", "y1", "x2", "y2")
        met = seen.join(new.select(*where, F.struct(*sides).alias("_by")), where)
        gone = met.where(iou(F.col("_by"), F.struct(*sides)) > threshold).select(*keys, "_rank")
        rows = fixed(rows.join(gone.unionByName(top).distinct(), [*keys, "_rank"], "left_anti"))
    return reduce(DataFrame.unionByName, kept)


def suppressed(df: DataFrame, keys: list[str], threshold: float = 0.5) -> DataFrame:
    """Per view and class the boxes that no better box overlaps beyond the threshold; ties go to the smaller box_id.

    Views of up to FOLD_BOXES boxes of a class are one array each; larger ones,
    at most one for so many rows, are dealt to cells.  Keys and class are not null.
    """
    own = [*keys, "class"]
    df = df.select(*own, "box_id", "conf", "x1", "y1", "x2", "y2")
    large = df.groupBy(*own).count().where(F.col("count") > FOLD_BOXES).drop("count") if 0.05 <= threshold < 1 else None
    if large is None or (large := fixed(large)).isEmpty():
        return _folded(df, own, threshold)
    large = checked_broadcast(large)
    return _folded(df.join(large, own, "left_anti"), own, threshold).unionByName(_gridded(df.join(large, own, "left_semi"), own, threshold))


def _bound(value: Column, use) -> Column:
    """use(value), where the value is worked out once however often use names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def union_area(boxes: Column) -> Column:
    """The area that pixel-snapped boxes cover, strip by strip between their x edges."""
    zero, least = F.lit(0).cast("long"), F.lit(-(1 << 40)).cast("long")
    start = F.struct(zero.alias("len"), least.alias("hi"))
    snapped = F.transform(boxes, lambda r: F.struct(F.floor(r["y1"]).alias("y1"), F.ceil(r["y2"]).alias("y2"), F.floor(r["x1"]).alias("x1"), F.ceil(r["x2"]).alias("x2")))
    snapped = F.array_sort(F.filter(snapped, lambda r: (r["x2"] > r["x1"]) & (r["y2"] > r["y1"])))
    grow = lambda acc, r: F.struct((acc["len"] + F.greatest(zero, r["y2"] - F.greatest(acc["hi"], r["y1"]))).alias("len"), F.greatest(acc["hi"], r["y2"]).alias("hi"))

    def swept(snap: Column, xs: Column) -> Column:
        # A strip lies between an edge and the one before it; boxes are in order of their lower y.
        def strip(b: Column, i: Column) -> Column:
            a = F.get(xs, i - 1)
            return F.when(i > 0, (b - a) * F.aggregate(F.filter(snap, lambda r: (r["x1"] < b) & (r["x2"] >= b)), start, grow)["len"]).otherwise(zero)

        return F.aggregate(F.transform(xs, strip), zero, lambda acc, x: acc + x)

    edges = lambda snap: F.array_sort(F.array_distinct(F.concat(F.transform(snap, lambda r: r["x1"]), F.transform(snap, lambda r: r["x2"]))))
    area = _bound(snapped, lambda snap: _bound(edges(snap), lambda xs: swept(snap, xs)))
    return F.coalesce(area, zero).cast("double")


def hull_area(boxes: Column) -> Column:
    """The area of the box around all boxes."""
    end = lambda f, side: f(F.transform(boxes, lambda r: r[side]))
    w = end(F.array_max, "x2") - end(F.array_min, "x1")
    h = end(F.array_max, "y2") - end(F.array_min, "y1")
    return F.coalesce(F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0)), F.lit(0.0))


def _lookup(table: dict[str, float], key: Column, default: float) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key), F.lit(default))


def is_anchored(boxes: Column) -> Column:
    """A sure missing part or crash among the raw boxes."""
    return F.exists(boxes, lambda r: ((r["class"] == "no part") & (r["conf"] >= 0.70)) | ((r["class"] == "crash") & (r["conf"] >= 0.60)))


def gated(boxes: Column, anchored: Column, cfg: Scoring) -> Column:
    """The boxes that count: by class minimum, weaker support in anchored views; if none does, all above the base."""
    passes = lambda r: r["conf"] >= _lookup(CLASS_MIN_CONF, r["class"], cfg.base_conf)
    first = F.filter(boxes, lambda r: passes(r) | (anchored & r["class"].isin(SUPPORT) & (r["conf"] >= 0.25)))
    return F.when(F.size(first) > 0, first).otherwise(F.filter(boxes, lambda r: r["conf"] >= cfg.base_conf))


def view_scores(df: DataFrame, keys: list[str], cfg: Scoring | None = None) -> DataFrame:
    """One record per view: severity (null without damage), anchor, crit_count, max_conf, extent, raw, classes, n_boxes."""
    cfg = cfg or Scoring()
    box = F.struct("box_id", "class", "conf", "x1", "y1", "x2", "y2")
    v = df.groupBy(*keys).agg(F.array_sort(F.collect_list(box)).alias("all"), F.max("img_w").alias("img_w"), F.max("img_h").alias("img_h"))
    v = v.withColumn("anchor0", is_anchored(F.col("all"))).withColumn("b", gated(F.col("all"), F.col("anchor0"), cfg))
    classes = F.transform("b", lambda r: r["class"])
    v = v.withColumns({"classes": classes, "n_boxes": F.size("b"), "max_conf": F.coalesce(F.array_max(F.transform("b", lambda r: r["conf"])), F.lit(0.0)), "union": union_area(F.col("b")), "hull": hull_area(F.col("b"))})
    floor = F.when(F.col("anchor0") | (F.col("max_conf") >= 0.60), cfg.hull_floor[1]).otherwise(cfg.hull_floor[0])
    sound = (F.col("n_boxes") > 0) & (F.col("union") > 0) & (F.col("hull") > 0)
    v = v.withColumn("extent", F.when(sound, N.clip(F.col("union") / F.greatest("hull", floor * F.col("img_w") * F.col("img_h")), 0.0, cfg.extent_max)).otherwise(0.0))
    weights = F.transform("classes", lambda c: _lookup(CLASS_WEIGHT, c, 1.0))
    mean = F.aggregate(weights, F.lit(0.0), lambda a, x: a + x) / F.col("n_boxes")
    raw = F.col("extent") * (cfg.mix[0] * mean + cfg.mix[1] * F.array_max(weights)) * (1 + cfg.per_box * F.least("n_boxes", F.lit(cfg.box_cap)))
    has = lambda c: F.array_contains("classes", c)
    s = N.ramp(F.col("max_conf"), *cfg.ramp)
    add = lambda cond, w: F.when(cond, s * w).otherwise(0.0)
    raw = raw + add(has("crash"), cfg.crash) + add(has("no part") & ((F.col("extent") > 0.10) | F.col("anchor0")), cfg.no_part)
    raw = raw + add(has("glass shatter"), cfg.glass) + add(has("tire flat") & (has("dent") | has("dislocated part") | has("crash")), cfg.tire)
    raw = F.when(has("no part") & has("lamp broken") & (F.col("extent") >= cfg.pair_extent), F.greatest(raw, F.lit(cfg.pair_floor))).otherwise(raw)
    v = v.withColumn("raw", F.when(sound, N.saturated(raw, cfg.saturation)).otherwise(0.0))
    scale = 1 + 4 * N.clip(F.col("raw"), 0.0, 1.0)
    sev = N.half_steps(scale) if cfg.half_steps else F.bround(scale, 3)
    some = F.col("n_boxes") > 0
    crit = F.size(F.filter("b", lambda r: r["class"].isin(CRITICAL) & (r["conf"] >= 0.40)))
    return v.select(
        *keys, F.when(sound, N.clip(sev, 1.0, 5.0)).alias("severity"), sound.alias("has_damage"), (F.col("anchor0") & some).alias("anchor"), F.when(sound, crit).otherwise(0).alias("crit_count"), "max_conf", "extent", "raw", "classes", "n_boxes"
    )


def selects_view(region: Column, n_views: Column, view: Column) -> Column:
    """Whether a damage region looks at a view of a layout."""
    out = F.lit(True)
    for n, regions in REGION_VIEWS.items():
        for name, views in regions.items():
            out = F.when((n_views == n) & (region == name), view.isin(views)).otherwise(out)
    return out & (view <= n_views)


def visual_only(damage: Column) -> Column:
    """The damage where photos can show it, else null."""
    label = X.damage_label(damage)
    return F.when(label.isin([*N.NON_VISUAL, "NONE"]), None).otherwise(damage)


def layout_photos(auction: Column, urls: Column, at_most: bool = False) -> Column:
    """Photos to score: the house's number, or fewer where there are fewer but a layout's number; else null.

    With at_most, the count of photos alone decides and more than six count as six.
    """
    n = F.size(urls)
    if at_most:
        return F.when(n >= 6, 6).when(n == 4, 4)
    wanted = F.least(X.expected_photos(auction), n)
    return F.when(wanted.isin(4, 6), wanted)


def ordered_photos(auction: Column, urls: Column) -> Column:
    """The first photos by the house's layout; null for a house without one."""
    n = X.expected_photos(auction)
    return F.when(n.isNotNull(), F.slice(urls, F.lit(1), F.coalesce(n, F.lit(1))))


def damage_severity(vehicles: DataFrame, views: DataFrame) -> DataFrame:
    """Per vehicle and channel the worst severity over the views that its damage selects.

    vehicles: vin, auction, n_views, damage_primary, damage_secondary; views: vin,
    channel, view_no, severity.  Vehicles without scored views stay, with nulls.
    """
    channels = F.array(*[F.struct(F.lit(c).alias("channel"), visual_only(F.col(f"damage_{c}")).alias("damage")) for c in ("primary", "secondary")])
    asked = vehicles.select("vin", "auction", "n_views", F.explode(channels).alias("x")).select("vin", "auction", "n_views", "x.*")
    met = asked.join(views, ["vin", "channel"], "left")
    chosen = F.when(F.col("damage").isNotNull() & selects_view(X.damage_region(F.col("damage")), F.col("n_views"), F.col("view_no")), F.col("severity"))
    worst = lambda c: F.max(F.when(F.col("channel") == c, chosen)).alias(f"damage_{c}_severity")
    return met.groupBy("vin", "auction").agg(worst("primary"), worst("secondary"))


def vehicle_severity(views: DataFrame, key: str = "vin", gap: float = 1.5, penalty: float = 0.5, quantile: float = 0.75) -> DataFrame:
    """One severity per vehicle: the worst view if it is anchored, else the upper quartile, damped where views differ widely; in half steps from 1 to 5."""
    scored = F.col("severity")
    top = F.max(scored)
    a = views.groupBy(key).agg(
        top.alias("hi"), F.min(scored).alias("lo"), F.percentile("severity", F.lit(quantile)).alias("q"), F.median("severity").alias("mid"),
        F.max_by(F.col("anchor"), F.struct("severity", F.col("anchor").cast("int").alias("a"))).alias("anchored"), F.count(scored).alias("coverage"),
    )
    spread = F.col("hi") - F.col("lo") >= gap
    value = F.when(F.col("hi").isNull(), 1.0).when(F.col("anchored"), F.col("hi")).otherwise(F.when(spread, F.greatest(F.col("q") - penalty, F.col("mid"))).otherwise(F.col("q")))
    return a.select(key, N.clip(N.half_steps(value), 1.0, 5.0).alias("severity"), "coverage")


def error_rows(df: DataFrame, errors: str = "errors") -> DataFrame:
    """One row per entry of an array<struct<stage, error, url>> column."""
    return df.select("vin", F.explode(errors).alias("x")).select("vin", "x.stage", X.error_text(F.col("x.error")).alias("error"), "x.url")


def score_vehicles(vehicles: DataFrame, detections: DataFrame, cfg: Scoring | None = None) -> DataFrame:
    """Vehicles and detections to severities by vin, in one query.

    Detections of channels whose damage photos cannot show are left out before
    they are grouped, so they are never shuffled.
    """
    wanted = vehicles.select("vin", F.explode(F.array(*[F.struct(F.lit(c).alias("channel"), visual_only(F.col(f"damage_{c}")).alias("d")) for c in ("primary", "secondary")])).alias("x"))
    wanted = wanted.where("x.d is not null").select("vin", F.col("x.channel").alias("channel"))
    views = view_scores(detections.join(wanted, ["vin", "channel"], "left_semi"), ["vin", "channel", "view_no"], cfg)
    return damage_severity(vehicles, views)
