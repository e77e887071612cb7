"""A made detector from images to vehicles' severities, and what goes wrong with one."""

import pytest
from pyspark.sql import functions as F

from hammerline.operators import severity as S
from hammerline.operators.detect import DETECTIONS, Found, detections

IMAGES = "vin string, channel string, view_no int, url string, content binary, stage string"


@pytest.fixture
def make():
    """A detector that reads its boxes from the image's bytes, as lines of `class conf x1 y1 x2 y2`; a function of its own, so that tasks get it whole."""

    def made():
        def detector(images):
            out = []
            for i in images:
                if i.content is None:
                    out.append(OSError("no bytes of " + i.url))
                    continue
                if i.content == b"crash":
                    raise MemoryError("too large")
                out.append(Found(100, 100, [x.split() for x in i.content.decode().splitlines()]))
            return out

        return detector

    return made


def test_from_images_to_vehicles(spark, make):
    rows = [
        ("a", "primary", 1, "u1", b"dent 0.5 0 0 50 50", "x"), ("a", "primary", 2, "u2", b"", "x"), ("a", "secondary", 1, "u3", None, "x"),
        ("b", "primary", 1, "u4", b"dent 2 0 0 50 50", "x"), ("b", "primary", 2, "u5", b"crash 0.9 10 10 90 90\ndent 0.4 0 0 5 5", "x"), ("c", "primary", 1, None, b"dent 0.5 9 0 5 5", "x"),
    ]
    good, bad = detections(spark.createDataFrame(rows, IMAGES), make, at_once=2)
    assert good.schema.simpleString() == spark.createDataFrame([], DETECTIONS).schema.simpleString()
    assert {(r.vin, r.view_no, r.box_id, r["class"]) for r in good.collect()} == {("a", 1, 0, "dent"), ("b", 2, 0, "crash"), ("b", 2, 1, "dent")}
    assert {(r.vin, r.stage, r.url) for r in bad.collect()} == {("a", "detect", "u3"), ("b", "contract", "u4"), ("c", "contract", None)}
    assert bad.columns == S.error_rows(spark.createDataFrame([], "vin string, errors array<struct<stage:string,error:string,url:string>>")).columns
    cars = spark.createDataFrame([(v, "iaai", 4, "FRONT END", "THEFT") for v in "abc"], "vin string, auction string, n_views int, damage_primary string, damage_secondary string")
    got = {r.vin: r.damage_primary_severity for r in S.score_vehicles(cars, good).collect()}
    assert got["a"] == 4.0 and got["b"] >= 4.0 and got["c"] is None


def test_a_failing_detector(spark, make):
    rows = [("a", "primary", i, f"u{i}", b"crash" if i == 2 else b"", "x") for i in range(5)]
    good, bad = detections(spark.createDataFrame(rows, IMAGES).coalesce(1), make, at_once=1)
    assert good.count() == 0 and [(r.stage, r.url) for r in bad.collect()] == [("detect", "u2")]
    assert [x.count() for x in detections(spark.createDataFrame([], IMAGES), make)] == [0, 0]
    with pytest.raises(ValueError, match="missing"):
        detections(spark.createDataFrame(rows, IMAGES).drop("url"), make)
    with pytest.raises(Exception, match="results for"):
        detections(spark.createDataFrame(rows, IMAGES).withColumn("content", F.lit(None)), lambda: lambda images: [])[0].count()
