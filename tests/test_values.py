"""Small cases with values known by reading, and recomputation in plain Python."""

import math
import random

import pytest
from pyspark.sql import Row, functions as F

from hammerline.functions import numbers as N, text as X
from hammerline.operators import frontier, metrics, pages, prep, severity as S
from hammerline.sources import tables as T


def values(spark, column, inputs, kind="string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], f"i int, c {kind}")
    return [r[0] for r in df.orderBy("i").select(column(F.col("c"))).collect()]


def test_titles(spark):
    got = values(spark, X.parse_title, ["2019 Land Rover Range Rover Sport Se", "2015 BMW X 5 Premium", "2012 Toyota Camry LE", "Ford F 150", "  ", None, "2014 Ford Fusion 2.0T Se"])
    assert [tuple(r) for r in got] == [(2019, "LAND ROVER", "RANGE ROVER SPORT", "SE"), (2015, "BMW", "X 5", "PREMIUM"), (2012, "TOYOTA", "CAMRY", "LE"), (None, None, "FORD F 150", ""), (None,) * 4, (None,) * 4, (2014, "FORD", "FUSION", "2.0T SE")]


def test_texts(spark):
    assert values(spark, X.digits_as_int, ["1 234.56", "abc", None]) == [123456, None, None]
    assert [tuple(r) for r in values(spark, X.mileage, ["12 345 mi", "9 km", "7"])] == [(12345, "mi"), (9, "km"), (7, None)]
    assert values(spark, X.drive_type, ["All wheel drive", "4x4 w/front whl drv", "Other"]) == ["AWD", "4WD", "Other"]
    assert values(spark, X.normal_vin, [" salwg2rv7ka836801 ", "ioq1"]) == ["SALWG2RV7KA836801", "1"]
    assert values(spark, X.canonical_url, ["https://h/a/b/?x=1#t"]) == ["https://h/a/b"]
    assert [tuple(r) for r in values(spark, X.split_damages, ["FRONT END, UNDERCARRIAGE", " , "])] == [("FRONT END", "UNDERCARRIAGE"), ("", "")]
    assert values(spark, N.photo_list, ['["a"," ","b"]', "['a']", "x", None]) == [["a", "b"], ["a"], [], []]
    assert values(spark, X.clean_category, [None, " a  b ", ""]) == ["UNKNOWN", "A B", "UNKNOWN"]
    assert values(spark, X.natural_key, ["b2", "b10"]) == sorted(values(spark, X.natural_key, ["b2", "b10"]))


def test_numbers(spark):
    labels = values(spark, N.price_class, [99.0, 100.0, 1999.99, 2000.0, 100000.0, 100001.0], "double")
    assert labels == ["nan", "[100, 2000)", "[100, 2000)", "[2000, 5000)", "[80000, 100001)", "nan"]
    assert values(spark, N.half_steps, [2.25, 2.75, 1.25, 3.75], "double") == [2.0, 3.0, 1.0, 4.0]
    w = values(spark, lambda p: N.top_k(N.softened(p, 1.0), 2), [[0.5, 0.3, 0.2]], "array<double>")[0]
    assert w == pytest.approx([0.625, 0.375, 0])
    with pytest.raises(ValueError):
        N.blend(F.lit(1), F.lit(1), 0.5, 0.6)


def test_severity_repair(spark):
    df = spark.createDataFrame([("UNKNOWN", None), ("NONE", None), ("FRONT END", -1.0), ("THEFT", 3.0)], "d string, s double")
    assert [r[0] for r in df.select(N.repaired_severity(F.col("d"), F.col("s"))).collect()] == [1, 0, -1, 3]


def boxes(spark, rows):
    return spark.createDataFrame([Row(vin="v", channel="primary", view_no=1, img_w=100, img_h=100, box_id=i, **{"class": c}, conf=s, x1=float(a), y1=float(b), x2=float(d), y2=float(e)) for i, (c, s, a, b, d, e) in enumerate(rows)])


def test_views(spark):
    score = lambda rows: S.view_scores(boxes(spark, rows), ["vin"]).first()
    one = score([("dent", 0.5, 0, 0, 50, 50)])
    assert one.severity == 4.0 and one.extent == pytest.approx(0.95) and one.raw == pytest.approx(0.969 / (0.969 + 0.35), abs=1e-5)
    weak = score([("dent", 0.29, 0, 0, 50, 50)])
    assert weak.severity is None and not weak.has_damage
    crash = score([("crash", 0.35, 0, 0, 50, 50)])
    assert crash.has_damage and not crash.anchor and crash.n_boxes == 1


def test_vehicle(spark):
    def sev(rows):
        return tuple(S.vehicle_severity(spark.createDataFrame([("v", s, a) for s, a in rows], "vin string, severity double, anchor boolean")).first())

    assert sev([(1.0, False), (2.0, False), (4.0, False)]) == ("v", 2.5, 3)
    assert sev([(1.0, False), (4.0, True)]) == ("v", 4.0, 2)
    assert sev([(None, False)]) == ("v", 1.0, 0)


def test_non_max_suppression_and_area(spark):
    rnd = random.Random(5)
    rows = []
    for _ in range(60):
        a, b = rnd.randint(0, 60), rnd.randint(0, 60)
        rows.append((rnd.choice(["dent", "crash"]), rnd.randint(1, 99) / 100, a, b, a + rnd.randint(1, 30), b + rnd.randint(1, 30)))

    def overlap(p, q):
        w, h = max(0, min(p[4], q[4]) - max(p[2], q[2])), max(0, min(p[5], q[5]) - max(p[3], q[3]))
        area = lambda r: (r[4] - r[2]) * (r[5] - r[3])
        return w * h / (area(p) + area(q) - w * h)

    kept = []
    for i in sorted(range(60), key=lambda i: (-rows[i][1], i)):
        if all(rows[j][0] != rows[i][0] or overlap(rows[i], rows[j]) <= 0.25 for j in kept):
            kept.append(i)
    got = S.suppressed(boxes(spark, rows), ["vin"], 0.25)
    assert {r.box_id for r in got.collect()} == set(kept)
    cells = {(x, y) for r in rows for x in range(r[2], r[4]) for y in range(r[3], r[5])}
    area = boxes(spark, rows).groupBy("vin").agg(F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("b")).select(S.union_area(F.col("b"))).first()[0]
    assert area == len(cells)


def test_tiles(spark):
    got = S.tile_windows(spark.createDataFrame([(100, 100)], "img_w int, img_h int")).collect()
    assert sorted({r.wx for r in got}) == [0, 40, 50] and len(got) == 9 and {r.ww for r in got} == {50}


def test_metrics(spark):
    df = spark.createDataFrame([(100.0, 110.0), (200.0, 160.0)], "y double, p double")
    m = df.agg(*metrics.regression_metrics("y", "p")).first()
    assert (m.MAE, m.ACC_10, m.ACC_20) == (25, 0.5, 1.0) and m.RMSE == pytest.approx(math.sqrt(850)) and m.R2 == pytest.approx(1 - 1700 / 5000)


def test_fold_median_never_sees_its_own_fold(spark):
    rows = [(i, "a" if i % 3 else "b", "m", 2000.0, float(i * i)) for i in range(40)]
    make = lambda r: spark.createDataFrame(r, "id int, make string, model string, year double, sold_price double")
    out = lambda r: {x.id: x.f for x in prep.oof_group_median(make(r), F.col("id") % 5, 5, name="f").collect()}
    a = out(rows)
    b = out([(*r[:4], 1e6) if r[0] == 7 else r for r in rows])
    assert a[7] == b[7] and len(a) == 40 and a != b


def test_upsert_twice_and_ids(spark):
    old = spark.createDataFrame([("a", 1, 0), ("b", 2, 0)], "k string, v int, t int")
    new = spark.createDataFrame([("b", 3, 1), ("c", 4, 1), ("c", 5, 2)], "k string, v int, t int")
    once = T.upsert(old, new, ["k"], ["t"])
    want = [("a", 1, 0), ("b", 3, 1), ("c", 5, 2)]
    assert sorted(map(tuple, once.collect())) == want
    assert sorted(map(tuple, T.upsert(once, new, ["k"], ["t"]).collect())) == want
    assert T.next_id(spark.createDataFrame([], "id int")) == 1
    ids = T.numbered(spark.range(50).withColumnRenamed("id", "x"), 7, ["x"])
    assert [r.id for r in ids.orderBy("x").collect()] == list(range(7, 57))
    with pytest.raises(ValueError):
        T.require_columns(old, ["absent"])
    assert T.require_columns(old, ["k"], [("w", "v")]).columns == ["k", "w", "t"]


def test_elements_follow_the_nesting(spark):
    def cut(html, *selectors, **more):
        return spark.createDataFrame([(html,)], "h string").select(pages.elements(F.col("h"), *selectors, **more)).first()[0]

    assert cut("<div class='a b'>1<div>2</div>3</div><div class=b>4", "div.b") == ["<div class='a b'>1<div>2</div>3", "<div class=b>4"]
    assert cut("<DIV class=a><p>1<p>2</div><p>3", ".a p") == ["<p>1<p>2", "<p>2"]
    assert cut("<!-- <p>1 --><script>'<p>'</script></b><p title='>'>x</p>", "p") == ["<p title='>'>x"]
    assert cut("<i class=a><i class=a><i class=b></i></i></i>", ".a", outer=True) == ["<i class=a><i class=a><i class=b></i></i>"]
    assert cut("<i class=a-b><img class=a><u></u></i>", ".a") == ["<img class=a>"]
    assert cut("<i class=a><u class=b></u></i>", ".b .a") == [] and cut(None, "p") == [] and cut("", "p") == []
    deep = "<div class=a>" * 20000
    assert len(cut(deep, ".a", outer=True)) == 1 and cut("<p>" + "x" * 3_000_000, "p") == ["<p>" + "x" * 3_000_000]


def test_pages(spark):
    html = """<h1>2019 Kia Rio vin: salwg2rv7ka836801</h1><script type="application/ld+json">[{"@type":"Thing"},{"@type":"Vehicle","color":"Red","offers":{"priceCurrency":" cad"}}]</script>
    <div class="lot_information x"><div class="mt-2"><b>Mileage:</b> 12 345 mi</div><ul><li><i class="y"></i><b>Drive:</b> x</li><li><b>Drive</b> All wheel drive</li></ul><table><tr><td><b>Engine</b></td><td>1.6</td></tr></table></div>
    <p class="lot_sold">Winning bet: $1 200</p>"""
    rows = [(1, "https://h/en/car/77-a?x=1", html), (2, None, None), (3, "https://h/", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    v, *bare = pages.vehicle_rows(df).collect()
    assert (v.record_id, v.vin, v.year, v.raw, v.price, v.currency, v.mileage, v.mileage_unit, v.drive, v.engine) == ("77-a", "SALWG2RV7KA836801", 2019, "Kia Rio", 1200, "CAD", 12345, "mi", "AWD", "1.6")
    assert all(r.vin is None and r.price is None and r.currency == "USD" and r["images"] == "" for r in bare)
    d = pages.detail_rows(df).collect()
    assert [(r.color, r.transmission, r.photo_urls_json) for r in d] == [("", "", "[]")] * 3
    assert pages.list_rows(df).count() == 0 and pages.list_rows(df.where("false")).count() == 0


def test_throughput(spark):
    df = spark.createDataFrame([("a", "2024-01-01 00:00:00", 0), ("a", "2024-01-01 00:00:30", 10)], "w string, ts string, done int").withColumn("ts", F.col("ts").cast("timestamp"))
    assert [r.per_minute for r in frontier.throughput(df, ["w"]).orderBy("ts").collect()] == [None, 20.0]


def test_areas_and_severities_over_every_box(spark):
    from hammerline import registry
    from hammerline.plans.standins import standin

    sf = "/root/testdata/sf0.001"
    cells, views = {}, {}
    for b in standin(spark, sf, "boxes").collect():
        own = cells.setdefault((b.vin, b.view_no), set())
        own.update((x, y) for x in range(math.floor(b.x1), math.ceil(b.x2)) for y in range(math.floor(b.y1), math.ceil(b.y2)))
        views.setdefault(b.vin, []).append((b.box_id % 9 / 2 + 1, b.box_id % 5 == 0))
    got = registry.queries()["d5_union_area_all"](spark, sf).collect()
    assert {(r.vin, r.view_no): r.area for r in got} == {k: len(c) for k, c in cells.items()} and len(got) == len(cells)

    def severity(own):
        s = sorted(x for x, _ in own)
        at = lambda q: s[int(q * (len(s) - 1))] + (q * (len(s) - 1) % 1) * (s[min(int(q * (len(s) - 1)) + 1, len(s) - 1)] - s[int(q * (len(s) - 1))])
        if max(own)[1]:
            return s[-1]
        return max(at(0.75) - 0.5, at(0.5)) if s[-1] - s[0] >= 1.5 else at(0.75)

    got = registry.queries()["a17_vehicle_severity_all"](spark, sf).collect()
    assert {r.vin: (r.severity, r.coverage) for r in got} == {v: (pytest.approx(severity(own)), len(own)) for v, own in views.items()}


def test_listing_texts_follow_the_sources_rules(spark):
    assert values(spark, X.drive_type, ["Front-Wheel Drive", "rear wheel", "awd", " Fwd "]) == ["FWD", "RWD", "awd", "Fwd"]
    assert values(spark, X.vin_from_url, ["/en/car/salwg2rv7ka836801_x", "/car/SALWG2RV7KA836801_", "/en/car/SALWG2RV7IO836801_"]) == ["SALWG2RV7KA836801", None, None]
    assert [tuple(r) for r in values(spark, X.mileage, ["9km", "9  mi", "5 KM"])] == [(9, None), (9, "mi"), (5, None)]
    heads = ["2019 Land Rover  Se vin: SALWG2RV7KA836801", "Kia 2019 vin:salwg2rv7ka836801234", "2020", "  "]
    assert [tuple(r) for r in values(spark, X.heading, heads)] == [("Land Rover Se", 2019, "SALWG2RV7KA836801"), ("Kia 2019", None, "SALWG2RV7KA836801234"), ("2020", None, None), (None, None, None)]
    assert values(spark, X.damage_label, [" rear  end\t", "n/a", None]) == ["REAR  END", "NONE", "NONE"]
    assert values(spark, X.damage_region, ["Stripped", "Rear end", "rear  end"]) == ["ALL_OVER", "REAR_END", "OTHER"]


def test_unsupported_house_has_no_photos(spark):
    rows = spark.createDataFrame([("Copart", list("abcdefgh")), ("iaai", ["a"]), ("other", ["a"])], "a string, u array<string>")
    assert [r[0] for r in rows.select(S.ordered_photos(F.col("a"), F.col("u"))).collect()] == [list("abcdef"), ["a"], None]


def test_page_outcomes(spark):
    cases = [
        (200, "Rate limit reached", None, "", "rate_limited"), (200, "", "0", "", "rate_limited"), (200, "", "x", "https://h/en/login", "auth"), (200, 'a class="btn btn-info">Sign in<', None, "", "auth"), (500, "vin", None, "", "http_error"),
        (200, "<b>Primary damage</b>", None, "", "valid"), (200, "Just a moment...", None, "", "challenge"), (200, "<h1>captcha</h1>", None, "", "unexpected"),
    ]
    df = spark.createDataFrame(cases, "s int, h string, r string, u string, want string")
    assert all(r.want == r.got for r in df.withColumn("got", X.page_outcome(F.col("s"), F.col("h"), F.col("r"), F.col("u"))).collect())
    lists = spark.createDataFrame([('<div class="lot_list">', "valid"), ("vin", "unexpected")], "h string, want string")
    assert all(r.want == r.got for r in lists.withColumn("got", X.page_outcome(F.lit(200), F.col("h"), F.lit(None).cast("string"), listing=True)).collect())


def test_files(spark, tmp_path):
    rows = [(1, 'a "b", c', None), (2, "line", "x")]
    df = spark.createDataFrame(rows, "k int, t string, u string")
    T.write_csv(df, str(tmp_path / "c"))
    T.write_csv(df, str(tmp_path / "c"))
    assert sorted(map(tuple, T.read_csv(spark, str(tmp_path / "c"), "k int, t string, u string").collect())) == rows
    for _ in range(2):
        T.append_fixed(df, str(tmp_path / "a"), ["t", "absent"])
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "a")).collect())) == sorted([('a "b", c', ""), ("line", "")] * 2)


def test_scoring_uses_saved_statistics_only(spark):
    train = spark.createDataFrame([("kia", "rio", 2019.0, 5000.0 + i, 10.0 * i) for i in range(120)], "make string, model string, year double, sold_price double, mileage double")
    clean = prep.rowwise(train)
    stats, medians = prep.fit(clean), prep.group_median(clean)
    overall = clean.agg(F.median("sold_price").alias("median"))
    asked = spark.createDataFrame([("Kia ", "rio", "2019", "5"), ("new", "x", "2019", None), ("kia", "rio", "1900", "5")], "make string, model string, year string, mileage string")
    got = prep.scoring_rows(asked, stats, medians, overall)
    assert got.columns == prep.FEATURES
    assert {(r.make, r.make_model_year_price_median, r.engine_volume) for r in got.collect()} == {("KIA", 5059.5, 2.0)} | {("OTHER", 5059.5, 2.0) for r in got.collect() if r.make == "OTHER"}


def test_parsed_title_beside_the_row(spark):
    df = spark.createDataFrame([(1, "2019 Ford F 150 XLT", "x"), (2, None, "y")], "id int, title string, make string")
    out = prep.with_parsed_title(df)
    assert out.columns == ["id", "title", "year", "make", "model", "rest"]
    assert [tuple(r)[2:] for r in out.orderBy("id").collect()] == [(2019, "FORD", "F 150", "XLT"), (None, None, None, None)]
    assert [tuple(r.t) for r in df.select(X.parse_title(F.col("title")).alias("t")).collect()] == [(2019, "FORD", "F 150", "XLT"), (None, None, None, None)]
