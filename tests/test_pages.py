"""Selectors in one pass, children and first elements, and labels in any element."""

import pandas as pd
from pyspark.sql import functions as F

from hammerline.operators import pages as P


def _cut(spark, html, **selectors):
    return spark.createDataFrame([(html,)], "h string").select(P.selected(F.col("h"), **selectors).alias("x")).first().x.asDict()


def test_children_and_first_elements(spark):
    html = "<div class=a><p>1</p><i><p>2</p></i><div class='a b'><p>3</p></div></div><div class=a><p>4</p></div>"
    got = _cut(spark, html, child="div.a > p", inside="div.a p", both="div.a > div.b > p", first=".a:first p", mixed="div.a > div p, i > p")
    assert got == {"child": ["<p>1", "<p>3", "<p>4"], "inside": ["<p>1", "<p>2", "<p>3", "<p>4"], "both": ["<p>3"], "first": ["<p>1", "<p>2", "<p>3"], "mixed": ["<p>2", "<p>3"]}
    assert _cut(spark, "<u><i class=x></i></u><a data-k=1></a><a></a>", parents="i", i="i.x", k="a[data-k]") == {"i": ["<i class=x>"], "k": ["<a data-k=1>"], "parents": ["<u><i class=x></i>"], "table_rows": [""]}
    # A child step may need an ancestor that is not the nearest.
    assert _cut(spark, "<s><b class=q><i><b class=q><u></u></b></i></b></s>", u="s > b.q u")["u"] == ["<u>"]
    assert _cut(spark, None, a="p", parents="a") == {"a": [], "parents": [], "table_rows": []}


def test_cards_are_children_of_the_list(spark):
    card = lambda k, more="": f'<div class="row py-2"><div class="title"><a class="ajax_link" href="/en/car/{k}">t{k}</a></div>{more}</div>'
    html = f'<div class="lot_list">{card(1, card(2))}<section>{card(3)}</section>{card(4)}</div>{card(5)}'
    df = spark.createDataFrame([(1, "https://h/x", html)], "page_id long, url string, html string")
    assert [r.detail_url for r in P.list_rows(df).orderBy("detail_url").collect()] == ["https://h/en/car/1", "https://h/en/car/4"]


def test_labels_in_any_element(spark):
    html = """<div class="lot_information"><b>Plain</b> one<table><tr><td><b>Engine:</b> 1.6</td><td>cell</td></tr><tr><th><b>Fuel</b></th><td>Gas</td></tr></table><dl><dd><b>Key</b> yes</dd></dl>
    <span><i>Drive</i> <b>no start</b> x</span><section><b> Color : </b><u>Dark</u> red</section><p><b>Key</b> no</p><p><b>:</b> none</p></div><div class="lot_information"><p><b>Other</b> x</p></div>"""
    got = spark.createDataFrame([(html,)], "h string").select(P.lot_labels(F.col("h"))).first()[0]
    assert {k: got[k] for k in ("engine", "fuel", "key", "no start", "color")} == {"engine": "1.6", "fuel": "Gas", "key": "no", "no start": "Drive no start x", "color": "Dark red"}
    assert "other" not in got and "" not in got and got["plain"].startswith("one ")


def test_pages_come_in_bounded_batches(spark):
    """A worker holds a few megabytes of pages at once, however many rows a partition has and however long they are."""
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.unset(size)
    html = P.elements(F.col("html"), "b")
    rows = spark.range(0, 3000, 1, 1).select("id", F.concat(F.lit("<b>x</b>"), F.repeat(F.lit("y"), 20_000)).alias("html"))
    assert rows.select(F.size(html).alias("n")).where("n = 1").count() == 3000

    @F.pandas_udf("long")
    def together(texts: pd.Series) -> pd.Series:
        return pd.Series([texts.str.len().sum()] * len(texts))

    assert rows.select(together("html").alias("n")).agg(F.max("n")).first()[0] <= P.BATCH_BYTES + 30_000
    assert rows.select(together(F.lit("z")).alias("n")).agg(F.max("n")).first()[0] <= P.BATCH_ROWS
