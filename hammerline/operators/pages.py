"""Typed rows from stored pages (page_id, url, html).

Elements nest, which no pattern can follow: ``selected`` cuts all that a row needs out of a page at once, in Arrow batches;
everything else is column expressions.
Absent fields of list and detail pages are empty strings, those of vehicle records null. A null page is one without elements.
"""

from __future__ import annotations

import re

import pandas as pd

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from hammerline.functions import text as X

_VEHICLE = (
    "struct<`@type`:string,vehicleTransmission:string,vehicleEngine:struct<fuelType:string>,driveWheelConfiguration:string,color:string,"
    "knownVehicleDamages:string,offers:struct<priceCurrency:string>>"
)
#: Rows and bytes of a batch of pages that goes to a Python worker, which holds two of them and what it cuts out of one.
BATCH_ROWS, BATCH_BYTES = 500, 4 << 20
# Tags that hold nothing.
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


def visible(c: Column) -> Column:
    """The text of a fragment: tags to spaces, the usual entities decoded, whitespace collapsed."""
    t = F.regexp_replace(F.regexp_replace(c, r"(?is)<(script|style)\b.*?</\1>", " "), r"<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(char))
    return X.collapse(t)


def links(html: Column) -> Column:
    """All link targets in order, each once."""
    return F.array_distinct(F.regexp_extract_all(html, F.lit(r"""(?i)<a\b[^>]*?\bhref\s*=\s*["']([^"']*)["']"""), 1))


class _Step:
    """One step of a selector: tag.class.class[attribute], with `:first` for the first such element of the page only."""

    def __init__(self, text: str, child: bool):
        text, self.first = text.removesuffix(":first"), text.endswith(":first")
        text, _, attribute = text.partition("[")
        self.tag, *classes = text.split(".")
        self.classes, self.attribute, self.child = set(classes), attribute.rstrip("]"), child

    def fits(self, tag: str, classes: set, attributes: str) -> bool:
        return (not self.tag or self.tag == tag) and self.classes <= classes and self.attribute in attributes

    def may_be_in(self, text: str) -> bool:
        return self.attribute in text and all(c in text for c in self.classes)


def _steps(selector: str) -> list[_Step]:
    words = selector.replace(">", " > ").split()
    return [_Step(w, i > 0 and words[i - 1] == ">") for i, w in enumerate(words) if w != ">"]


def selected(html: Column, parents: str | None = None, outer: bool = False, **selectors: str) -> Column:
    """One struct with, for each name, the markup of the elements that its selectors (parted by commas) name, in order.

    The page is gone through once for all of them.  A selector is a row of steps,
    each inside the one before, or right under it after `>`.  `parents` names one
    of them whose elements' parents come too, as the field `parents`, in the same
    order, and as `table_rows` what is around a parent that is a table's cell (else
    empty); outer leaves out what is inside a selected element.  A closing tag also closes what is still open inside; without one, an
    element reaches to the end.  Comments, scripts and styles hold no elements.
    From here on the session hands rows to Python in batches of bounded size.
    """
    conf = SparkSession.active().conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    names = list(selectors)
    wanted = [(n, _steps(s)) for n in names for s in selectors[n].split(",")]
    firsts = [step for _, steps in wanted for step in steps if step.first]
    token = re.compile(r"""<!--.*?-->|<(script|style)\b.*?</\1\s*>|<(/?)([a-z][a-z0-9-]*)((?:"[^"]*"|'[^']*'|[^>"']++)*+)>""", re.I | re.S)
    classed = re.compile(r"""(?<![\w-])class\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
    void = _VOID
    fields = [*names, *(["parents", "table_rows"] if parents else [])]

    def chosen(stack, steps):
        # An open element: tag, classes, attributes, span, the `:first` steps that it is the first of, and whether it is selected.
        fits = lambda element, step: step.fits(*element[:3]) and (not step.first or step in element[4])

        def holds(k, end):
            if k < 0:
                return True
            if steps[k + 1].child:
                return end > 0 and fits(stack[end - 1], steps[k]) and holds(k - 1, end - 1)
            for i in range(end - 1, -1, -1):
                if fits(stack[i], steps[k]):
                    # The nearest leaves most above it; only a step that is a child may need a farther one.
                    if (found := holds(k - 1, i)) or not steps[k].child:
                        return found
            return False

        return fits(stack[-1], steps[-1]) and holds(len(steps) - 2, len(stack) - 1)

    def cut(text):
        spans = {n: [] for n in fields}
        # A page without a selector's classes has no such element; one without any isn't gone through.
        here = [(n, steps) for n, steps in wanted if text and all(x.may_be_in(text) for x in steps)]
        if here:
            stack, count, met, inside = [], {}, set(), 0
            for m in token.finditer(text):
                name = (m.group(3) or "").lower()
                if not name or (m.group(2) and not count.get(name)):
                    continue
                if m.group(2):
                    while True:
                        other = stack.pop()
                        count[other[0]] -= 1
                        other[3][1] = m.start()
                        inside -= other[5]
                        if other[0] == name:
                            break
                    continue
                kind = classed.search(m.group(4))
                classes = set("".join(g or "" for g in kind.groups()).split()) if kind else set()
                span = [m.start(), m.end() if name in void else len(text)]
                own = {step for step in firsts if step not in met and step.fits(name, classes, m.group(4))}
                met |= own
                stack.append([name, classes, m.group(4), span, own, False])
                for n in () if outer and inside else dict.fromkeys(n for n, steps in here if chosen(stack, steps)):
                    stack[-1][5] = True
                    spans[n].append(span)
                    if n == parents:
                        spans["parents"].append(stack[-2][3] if len(stack) > 1 else span)
                        spans["table_rows"].append(stack[-3][3] if len(stack) > 2 and stack[-2][0] in ("td", "th") else (0, 0))
                if name in void:
                    stack.pop()
                else:
                    count[name], inside = count.get(name, 0) + 1, inside + stack[-1][5]
        return [[text[a:b] for a, b in spans[n]] for n in fields]

    @F.pandas_udf(", ".join(f"`{n}` array<string>" for n in fields))
    def found(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(dict(zip(fields, zip(*map(cut, texts), strict=True), strict=True)) if len(texts) else {n: [] for n in fields})

    return found(html)


def elements(html: Column, *selectors: str, outer: bool = False) -> Column:
    """Markup of the elements, in order, that any of the selectors names, as `selected` has them."""
    return selected(html, outer=outer, found=",".join(selectors))["found"]


def _lone(found: Column) -> Column:
    """The first of some elements, empty without."""
    return F.coalesce(F.try_element_at(found, F.lit(1)), F.lit(""))


def _of(value: Column, use) -> Column:
    """use(value), where the value is worked out once however often use names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def attribute(element: Column, name: str) -> Column:
    """An attribute of the opening tag at the start of an element; empty without."""
    opening = F.regexp_extract(element, r"""(?s)^<(?:"[^"]*"|'[^']*'|[^>"'])*>""", 0)
    return F.trim(F.replace(F.regexp_extract(opening, rf"""(?is)(?<![\w-]){name}\s*=\s*(["'])(.*?)\1""", 2), F.lit("&amp;"), F.lit("&")))


def listing_links(html: Column, base: Column, path: str = "/en/car/") -> Column:
    """Links to listings, absolute and canonical, in order, each once."""
    found = F.filter(links(html), lambda u: F.contains(u, F.lit(path)))
    return F.array_distinct(F.transform(found, lambda u: X.canonical_url(X.resolve_url(base, u))))


#: What each part of a page is read from, by name; a page is gone through once for all that a row needs.
_PHOTOS = {"gallery": "a[data-fancybox]", "slides": ".mySwiper2 img, .mySwiper img"}
_LOT = {"bold": ".lot_information:first b", "sold": ".lot_sold", "ranges": ".lot_price_range .text-left"}
_CURRENCY = {"shown": ".lot_sold .currency, .lot_price_range .currency"}
_AUCTION = {"divisions": ".lot_information:first div"}


def _photos(found: Column, formats: bool) -> Column:
    gallery = F.filter(found["gallery"], lambda a: attribute(a, "data-fancybox") == "gallery")
    hrefs = F.array_distinct(F.filter(F.transform(gallery, lambda a: attribute(a, "href")), lambda u: u != ""))
    if formats:
        return F.filter(hrefs, lambda u: u.rlike(r"(?i)\.(jpg|jpeg|png)"))
    images = F.transform(found["slides"], lambda i: X.without_query(attribute(i, "src")))
    return F.when(F.size(hrefs) > 0, hrefs).otherwise(F.array_distinct(F.filter(images, lambda u: u != "")))


def photo_urls(html: Column, formats: bool = False) -> Column:
    """H4: links of the gallery, or else image sources of the sliders without queries; in order, each once.

    With formats, only gallery links that name a jpg, jpeg or png, and no other source.
    """
    return _photos(selected(html, **_PHOTOS), formats)


def vehicles_json(html: Column, lists: bool = True) -> Column:
    """The JSON-LD objects of type Vehicle, as structs in order; lists also reads those inside a list."""
    scripts = F.regexp_extract_all(html, F.lit(r"""(?is)<script\b[^>]*application/ld\+json[^>]*>\s*(.*?)\s*</script>"""), 1)
    many = lambda s: F.from_json(s, f"array<{_VEHICLE}>") if lists else F.array().cast(f"array<{_VEHICLE}>")
    parsed = F.transform(scripts, lambda s: F.when(F.startswith(s, F.lit("[")), many(s)).otherwise(F.array(F.from_json(s, _VEHICLE))))
    return F.filter(F.flatten(F.filter(parsed, lambda a: a.isNotNull())), lambda v: v["@type"] == "Vehicle")


def vehicle_json(html: Column, lists: bool = True) -> Column:
    """JS1: the first JSON-LD object of type Vehicle, as a struct; null without."""
    return F.try_element_at(vehicles_json(html, lists), F.lit(1))


def _pair(row: Column) -> Column:
    """struct(key, value) of a row: its first bold text, lower-cased without colon, and its values element's text or the rest of its own."""
    raw = visible(F.regexp_extract(row, r"(?is)<b\b[^>]*>(.*?)</b>", 1))
    values = F.regexp_extract(row, r"""(?is)<div\b[^>]*\bclass\s*=\s*["'][^"']*(?<![\w-])values(?![\w-])[^>]*>(.*?)(?:</div>|\z)""", 0)
    rest = visible(F.regexp_replace(row, r"(?is)^(.*?)<b\b[^>]*>.*?</b>", "$1 "))
    value = F.when(values != "", visible(values)).otherwise(F.regexp_replace(rest, r"^[ :]+|[ :]+$", ""))
    return F.struct(F.regexp_replace(F.lower(raw), r"[\s:]+$", "").alias("key"), value.alias("value"), (values != "").alias("apart"))


def _pairs(rows: Column) -> Column:
    return F.filter(F.transform(F.filter(rows, lambda r: r.rlike(r"(?i)<b\b")), _pair), lambda p: p["key"] != "")


def _labelled(rows: Column, *labels: str) -> Column:
    """The first text, in the labels' order, that is not empty; of rows with one label the first counts."""
    of = lambda name: F.try_element_at(F.filter(rows, lambda p: p["key"] == name), F.lit(1))["value"]
    return F.coalesce(*[F.nullif(of(x), F.lit("")) for x in labels])


def _lot_labels(found: Column) -> Column:
    def behind(label: Column, markup: Column) -> Column:
        return _of(visible(markup), lambda whole: F.trim(F.when(F.startswith(whole, label), F.substring(whole, F.length(label) + 1, F.length(whole))).otherwise(whole)))

    def pair(x: Column) -> Column:
        value = lambda label: F.coalesce(F.nullif(behind(label, x["parents"]), F.lit("")), behind(label, x["table_rows"]))
        return _of(visible(x["bold"]), lambda label: F.struct(F.lower(F.trim(F.regexp_replace(label, ":+$", ""))).alias("key"), value(label).alias("value")))

    pairs = F.filter(F.transform(F.arrays_zip(found["bold"].alias("bold"), found["parents"].alias("parents"), found["table_rows"].alias("table_rows")), pair), lambda p: p["key"] != "")
    amount = lambda text, label: F.trim(F.regexp_extract(text, rf"(?i){label}:\s*\$?\s*([\d\s]+)", 1))
    ranges = F.transform(found["ranges"], lambda r: amount(visible(r), "average price"))
    average = F.coalesce(F.try_element_at(F.filter(ranges, lambda a: a != ""), F.lit(1)), F.lit(""))
    extra = lambda name, value: F.struct(F.lit(name).alias("key"), value.alias("value"))
    shown = F.array(extra("winning_bet", amount(visible(_lone(found["sold"])), "winning bet")), extra("average_price", average))
    every = F.concat(pairs, F.filter(shown, lambda p: p["value"] != ""))
    none = F.array().cast("array<struct<key:string,value:string>>")
    return F.map_from_entries(F.aggregate(every, none, lambda kept, p: F.concat(F.filter(kept, lambda q: q["key"] != p["key"]), F.array(p))))


def lot_labels(html: Column) -> Column:
    """JS3: label to value of the first lot information on the page, the last of a label wins, with winning_bet and average_price where the page shows them.

    A label is any bold text; its value is the text of the element right around it, without the label at its start.
    Where that is a table's cell with nothing else, it is the rest of the cell's row.
    """
    return _lot_labels(selected(html, parents="bold", **_LOT))


def first_filled(*sources: Column) -> Column:
    """P10: the first text that is not blank."""
    return F.coalesce(*[F.nullif(F.trim(s), F.lit("")) for s in sources])


def currency(html: Column) -> Column:
    """H6: the first currency of a vehicle's offer, else that of the sale's or the price range's element, else USD; in upper case."""
    return _currency(html, selected(html, **_CURRENCY))


def _currency(html: Column, found: Column) -> Column:
    offers = F.filter(F.transform(vehicles_json(html), lambda v: F.trim(v["offers"]["priceCurrency"])), lambda c: c != "")
    return F.coalesce(F.upper(first_filled(F.try_element_at(offers, F.lit(1)), visible(_lone(found["shown"])))), F.lit("USD"))


def auction_source(html: Column) -> Column:
    """H7: COPART, IAAI or OTHER by the link, or else the image, in the Auction row of the lot's information; null without."""
    return _auction(selected(html, **_AUCTION))


def _auction(found: Column) -> Column:
    rows = F.filter(found["divisions"], lambda r: _pair(r)["key"] == "auction")
    row = F.coalesce(F.try_element_at(rows, F.lit(1)), F.lit(""))
    name = lambda x: F.when(F.contains(x, F.lit("copart")), "COPART").when(F.contains(x, F.lit("iaai")), "IAAI").otherwise("OTHER")
    link = lambda r: name(F.regexp_extract(r, r"""(?s)<a\b[^>]*?\bhref\s*=\s*["']([^"']*)["']""", 1))
    image = lambda r: name(F.regexp_extract(r, r"(?s)<img\b([^>]*)>", 1))
    return _of(F.lower(row), lambda r: F.when(r.rlike(r"<a\b[^>]*?\bhref"), link(r)).when(r.rlike(r"<img\b"), image(r)))


def price(lot: Column) -> Column:
    """JS4: the winning bet, else the average price, as a number."""
    at = lambda k: X.digits_as_int(F.try_element_at(lot, F.lit(k)))
    return F.coalesce(at("winning_bet"), at("average_price"))


def list_rows(pages: DataFrame) -> DataFrame:
    """One row per lot card of a list page, absent fields empty; cards without a link and a VIN are dropped."""
    c = pages.select("page_id", "url", F.explode(elements(F.col("html"), "div.lot_list > div.row.py-2")).alias("card"))
    parts = selected(
        F.col("card"), rows="div.params div.mt-1", link=".title a.ajax_link", image=".image_box img", price=".title .text-success", badge=".title .badge", seller=".who_sell",
        buttons="a.btn.btn-info.btn-sm[target]", houses="img[alt]",
    )
    c = c.select("page_id", "url", parts.alias("x")).select(
        "page_id", "url", _pairs(F.col("x.rows")).alias("kv"), _lone(F.col("x.link")).alias("link"), _lone(F.col("x.image")).alias("image"), visible(_lone(F.col("x.price"))).alias("sold_price"),
        visible(_lone(F.col("x.badge"))).alias("status"), visible(_lone(F.col("x.seller"))).alias("seller_type"), F.col("x.buttons").alias("buttons"), F.col("x.houses").alias("images"),
    )
    kv = lambda k: F.coalesce(_labelled(F.filter("kv", lambda p: p["apart"]), k), F.lit(""))
    href = attribute(F.col("link"), "href")
    button = F.try_element_at(F.filter("buttons", lambda b: attribute(b, "target") == "_blank"), F.lit(1))
    house = F.try_element_at(F.filter(F.transform("images", lambda i: attribute(i, "alt")), lambda a: a.isin("copart", "iaai")), F.lit(1))
    out = c.select(
        "page_id", F.when(href != "", X.canonical_url(X.resolve_url(F.col("url"), href))).otherwise("").alias("detail_url"), kv("vin").alias("vin"), visible(F.col("link")).alias("title"), "status", "sold_price", "seller_type",
        kv("engine").alias("engine"), kv("mileage").alias("mileage"), kv("auction date").alias("sale_date"), kv("cost of repair").alias("repair_price"), kv("market value").alias("market_price"), kv("primary damage").alias("primary_damage"),
        F.coalesce(house, F.lit("")).alias("auction"), F.coalesce(attribute(button, "href"), F.lit("")).alias("auction_url"), attribute(F.col("image"), "src").alias("image_url"), attribute(F.col("image"), "alt").alias("image_alt"),
    )
    return out.where((F.col("detail_url") != "") | (F.col("vin") != ""))


def detail_rows(pages: DataFrame) -> DataFrame:
    """H2: transmission, fuel, drive, secondary damage, color and photos of a detail page; structured data first, labels as a fallback.

    Keeps the page's vin where the table has that column.
    """
    own = [F.col("vin")] if "vin" in pages.columns else []
    parts = selected(F.col("html"), rows="div.params div.mt-1, div.params li, table tr", plain="div.mt-2, div.mb-2, div.mb-4", **_PHOTOS)
    p = pages.select("url", *own, vehicle_json(F.col("html"), lists=False).alias("v"), parts.alias("x"))
    p = p.select("url", *own, "v", _pairs(F.col("x.rows")).alias("rows"), _pairs(F.col("x.plain")).alias("plain"), _photos(F.col("x"), False).alias("photos"))

    def field(structured: Column, labels: list[str], simple: str) -> Column:
        return F.coalesce(F.nullif(structured, F.lit("")), _labelled(F.col("rows"), *labels), _labelled(F.col("plain"), simple), F.lit(""))

    return p.select(
        X.canonical_url(F.col("url")).alias("detail_url"), *own, field(F.col("v.vehicleTransmission"), ["transmission"], "transmission").alias("transmission"), field(F.col("v.vehicleEngine.fuelType"), ["fuel type", "fuel"], "fuel").alias("fuel_type"),
        field(F.col("v.driveWheelConfiguration"), ["drive", "drive type"], "drive").alias("drive_type"), field(X.split_damages(F.col("v.knownVehicleDamages"))["secondary"], ["secondary damage"], "secondary damage").alias("secondary_damage"),
        field(F.col("v.color"), ["color"], "color").alias("color"), F.to_json("photos").alias("photo_urls_json"),
    )


def vin_mismatch(url: Column, shown: Column) -> Column:
    """H9: whether the URL names another VIN than the page; false where either has none."""
    return F.coalesce(X.vin_from_url(url) != shown, F.lit(False))


def vehicle_rows(pages: DataFrame) -> DataFrame:
    """H3, H9: one wide record per vehicle page, with a flag where the URL's VIN is another than the page's."""
    x, html = F.col("x"), F.col("html")
    parts = selected(html, parents="bold", heading="h1", seller=".who_sell", **_LOT, **_CURRENCY, **_AUCTION, **_PHOTOS)
    p = pages.select("url", "html", parts.alias("x")).select(
        "url", _lot_labels(x).alias("kv"), _of(visible(_lone(x["heading"])), X.heading).alias("h"), _currency(html, x).alias("currency"), _auction(x).alias("auction_source"),
        F.nullif(visible(_lone(x["seller"])), F.lit("")).alias("seller"), X.join_bar(_photos(x, True)).alias("images"),
    )
    kv = lambda k: F.try_element_at(F.col("kv"), F.lit(k))
    shown = F.nullif(X.normal_vin(first_filled(kv("vin"), F.col("h.vin"))), F.lit(""))
    miles, of_url = X.mileage(kv("mileage")), X.vin_from_url(F.col("url"))
    return p.select(
        X.record_id(F.col("url")).alias("record_id"), "url", F.coalesce(shown, of_url).alias("vin"), F.col("h.year").alias("year"), F.col("h.raw").alias("raw"), price(F.col("kv")).alias("price"), "currency", "seller", "auction_source",
        miles["value"].alias("mileage"), miles["unit"].alias("mileage_unit"), kv("engine").alias("engine"), kv("fuel").alias("fuel"), kv("transmission").alias("transmission"), kv("color").alias("color"),
        kv("primary damage").alias("damage_primary"), kv("secondary damage").alias("damage_secondary"), X.drive_type(kv("drive")).alias("drive"), kv("key").alias("key"), X.digits_as_int(kv("cost of repair")).alias("cost_of_repair"),
        X.digits_as_int(kv("market value")).alias("market_value"), "images", vin_mismatch(F.col("url"), shown).alias("vin_mismatch"),
    )
