"""Text cleaning and parsing as column expressions; a null input gives null unless stated."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Vocabularies for splitting listing titles.
MULTIWORD_MAKES = ["LAND ROVER", "MERCEDES-BENZ", "ALFA ROMEO", "ASTON MARTIN", "ROLLS ROYCE", "AM GENERAL"]
MULTIWORD_MODELS = [
    "RANGE ROVER SPORT", "RANGE ROVER EVOQUE", "RANGE ROVER VELAR", "RANGE ROVER", "GRAND CHEROKEE L", "GRAND CHEROKEE", "GRAND CARAVAN",
    "TOWN & COUNTRY", "SANTA FE", "SANTA CRUZ", "OUTLANDER SPORT", "WRANGLER UNLIMITED", "PRO MASTER CITY", "PRO MASTER", "TRANSIT CONNECT",
    "ECONOLINE WAGON", "SILVERADO 1500", "SILVERADO 1500HD", "SILVERADO 2500", "SILVERADO 2500HD", "SILVERADO 3500", "SILVERADO 3500HD",
    "SIERRA 1500", "SIERRA 1500HD", "SIERRA 2500", "SIERRA 2500HD", "SIERRA 3500", "SIERRA 3500HD", "YUKON XL", "ESCALADE ESV",
    "F 150", "F 250", "F 250 SUPER DUTY", "F 350", "F 350 SUPER DUTY", "F 450", "F 450 SUPER DUTY", "MUSTANG MACH-E",
    "MODEL 3", "MODEL S", "MODEL X", "MODEL Y", "CX 3", "CX 5", "CX 9", "MX 5", "QX 50", "QX 60", "QX 80", "RX 350", "RX 450H",
    "ES 350", "IS 250", "IS 350", "GS 350", "A CLASS", "C CLASS", "E CLASS", "S CLASS",
]
# Words that begin a trim name.
TRIM_STARTERS = [
    "BASE", "L", "LE", "LS", "LT", "LT1", "LT2", "LTZ", "LX", "EX", "EX-L", "EXL", "S", "SE", "SEL", "SES", "SL", "SLE", "SLT", "SV", "SR", "SR5",
    "ST", "STX", "XLT", "XL", "XLE", "XSE", "LIMITED", "PREMIUM", "PRESTIGE", "PLATINUM", "TOURING", "DENALI", "AT4", "ELEVATION", "TRAILHAWK",
    "TRD", "Z71", "ZR2", "RST", "RS", "SS", "SRT", "GT", "GTS", "GTI", "GL", "GLS", "HSE", "HST", "AUTOBIOGRAPHY", "PURE", "DYNAMIC", "X-DYNAMIC",
    "LUX", "LUXURY", "SIGNATURE", "OVERLAND", "ALTITUDE", "SUMMIT", "RUBICON", "MOJAVE", "SAHARA", "WILLYS", "BIG", "HORN", "LARAMIE", "LONGHORN",
    "TRADESMAN", "REBEL", "AWD", "FWD", "RWD", "4WD", "4X4", "2WD", "QUATTRO", "TFSI", "TRONIC", "CVT", "HYBRID", "PHEV", "EV", "DIESEL", "TDI",
    "TSI", "V6", "V8", "I4", "I6", "250", "300", "350", "450", "550", "2500", "3500", "HD", "CLASSIC", "CABRIOLET", "COUPE", "SEDAN",
]
# Labels that mean no damage.
NO_DAMAGE = ["", "NONE", "N/A", "NA", "NULL", "NAN"]
# Damage label to region key; anything else is OTHER.
DAMAGE_REGION = {
    "NONE": "NONE", "FRONT END": "FRONT_END", "REAR END": "REAR_END", "SIDE": "SIDE", "FRONT & REAR": "FRONT_REAR", "ALL OVER": "ALL_OVER",
    "TOP/ROOF": "TOP_ROOF", "UNDERCARRIAGE": "UNDERCARRIAGE", "MINOR DENT/SCRATCHES": "MINOR", "HAIL": "ALL_OVER", "STORM DAMAGE": "ALL_OVER",
    "ROLLOVER": "ALL_OVER", "STRIP": "ALL_OVER", "STRIPPED": "ALL_OVER", "VANDALISM": "ALL_OVER", "BURN": "ALL_OVER", "PARTIAL REPAIR": "ALL_OVER",
    "BURN - ENGINE": "ALL_OVER", "BURN - INTERIOR": "ALL_OVER",
}
# Damage label to ordinal score; anything else is 2.
DAMAGE_SCORE = {
    "NONE": 0, "UNKNOWN": 0, "MINOR DENT/SCRATCHES": 1, "NORMAL WEAR & TEAR": 1, "MISSING/ALTERED VIN": 1, "REPLACED VIN": 1, "REPOSSESSION": 1,
    "CASH FOR CLUNKERS": 1, "HAIL": 1, "VANDALISM": 1, "DAMAGE HISTORY": 1, "PARTIAL REPAIR": 1, "REAR END": 2, "SIDE": 2, "ROOF": 2,
    "UNDERCARRIAGE": 2, "SUSPENSION": 2, "STORM DAMAGE": 2, "FRONT END": 3, "ALL OVER": 3, "FRONT & REAR": 3, "WATER/FLOOD": 4, "THEFT": 4,
    "STRIPPED": 4, "MECHANICAL": 4, "ELECTRICAL": 4, "ENGINE DAMAGE": 4, "TRANSMISSION DAMAGE": 4, "FRAME DAMAGE": 5, "ROLLOVER": 5, "BURN": 5,
    "BURN - ENGINE": 5, "BURN - INTERIOR": 5, "BIOHAZARD": 5,
}


#: All white space, as `(?U)\\s` has it.
WHITE_SPACE = "\t\n\v\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def collapse(c: Column) -> Column:
    """Runs of whitespace to one space, ends trimmed; null to the empty string."""
    return F.coalesce(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")), F.lit(""))


def stripped(c: Column) -> Column:
    """The text without whitespace at its ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def clean_category(c: Column) -> Column:
    """Collapsed and upper-cased; null or blank to UNKNOWN.

    Printable ASCII with single spaces has nothing to collapse: a plain class tells so in a fraction of the time.
    """
    single = F.when(c.rlike("[^!-~ ]|  "), collapse(c)).otherwise(F.trim(c))
    return F.coalesce(F.nullif(F.upper(single), F.lit("")), F.lit("UNKNOWN"))


def normal_title(c: Column) -> Column:
    """Collapsed and upper-cased; null and blank to null."""
    return F.nullif(F.upper(collapse(c)), F.lit(""))


def _one_of(words: list[str]) -> str:
    return "|".join(sorted((_quote(w) for w in dict.fromkeys(words)), key=lambda w: (-len(w.split(" ")), -len(w), w)))


def _quote(word: str) -> str:
    return "".join("\\" + ch if ch in ".&-/" else ch for ch in word)


def title_steps(c: Column) -> list[tuple]:
    """The columns, each from those before it, that end in a title's year, make, model and rest."""
    plain_trim = lambda x, i: (i > 0) & (x.isin(TRIM_STARTERS) | x.rlike(r"^(\d\.\dT?|V\d|I\d)$"))

    def plain(v):
        tokens = F.split(v["tail"], " ")
        cut = F.array_position(F.transform(tokens, plain_trim), F.lit(True)).cast("int")
        return F.when(cut > 0, F.array_join(F.slice(tokens, F.lit(1), F.greatest(cut - 1, F.lit(0))), " ")).otherwise(v["tail"])

    return [
        ("title", lambda v: normal_title(c)),
        ("dated", lambda v: v["title"].rlike(r"^(19|20)\d{2}\b")),
        ("after", lambda v: F.trim(F.substring(v["title"], F.lit(5), F.length(v["title"])))),
        ("many", lambda v: F.regexp_extract(v["after"], f"^({_one_of(MULTIWORD_MAKES)})(?= |$)", 1)),
        ("own_make", lambda v: F.when(v["many"] != "", v["many"]).otherwise(F.substring_index(v["after"], " ", 1))),
        ("tail", lambda v: F.trim(F.substring(v["after"], F.length(v["own_make"]) + 1, F.length(v["after"])))),
        ("known", lambda v: F.regexp_extract(v["tail"], f"^({_one_of(MULTIWORD_MODELS)})(?= |$)", 1)),
        ("pair", lambda v: F.regexp_extract(v["tail"], r"^([A-Z]+ [0-9]{1,4}[A-Z]*)(?= |$)", 1)),
        ("own_model", lambda v: F.when(v["known"] != "", v["known"]).when(v["pair"] != "", v["pair"]).otherwise(plain(v))),
        ("year", lambda v: F.when(v["dated"], F.substring(v["title"], 1, 4).cast("int"))),
        ("make", lambda v: F.when(v["dated"], v["own_make"])),
        ("model", lambda v: F.when(v["dated"], v["own_model"]).otherwise(v["title"])),
        ("rest", lambda v: F.when(v["dated"], F.trim(F.substring(v["tail"], F.length(v["own_model"]) + 1, F.length(v["tail"])))).when(v["title"].isNotNull(), "")),
    ]


def parse_title(c: Column) -> Column:
    """struct(year, make, model, rest) of a listing title."""
    found: dict[str, Column] = {}
    for name, step in title_steps(c):
        found[name] = step(found)
    return F.struct(*[found[n].alias(n) for n in ("year", "make", "model", "rest")])


def canonical_url(c: Column) -> Column:
    """Without query, fragment and trailing slashes."""
    return F.regexp_replace(F.regexp_replace(F.trim(c), r"[?#].*$", ""), "/+$", "")


def resolve_url(base: Column, link: Column) -> Column:
    """Absolute links stay, rooted ones get the base's scheme and host, others its folder."""
    host = F.regexp_extract(base, r"^[a-z]+://[^/]+", 0)
    return F.when(link.rlike("^[a-z]+://"), link).when(F.startswith(link, F.lit("//")), F.concat(F.lit("https:"), link)).when(F.startswith(link, F.lit("/")), F.concat(host, link)).otherwise(F.concat(F.regexp_replace(base, "[^/]*$", ""), link))


def record_id(url: Column, pattern: str = r"/en/car/([^/?#]+)") -> Column:
    """The id in the URL's path, else the URL."""
    return F.coalesce(F.nullif(F.regexp_extract(url, pattern, 1), F.lit("")), url)


def normal_vin(c: Column) -> Column:
    """Upper-cased, without characters a VIN cannot hold (I, O, Q among them)."""
    return F.regexp_replace(F.upper(F.trim(c)), "[^A-HJ-NPR-Z0-9]", "")


def vin_from_url(url: Column) -> Column:
    """11 to 20 characters that a VIN can hold behind the car path, up to an underscore; null without."""
    return F.nullif(F.upper(F.regexp_extract(url, r"(?i)/en/car/([a-hj-npr-z0-9]{11,20})_", 1)), F.lit(""))


def page_of_url(url: Column) -> Column:
    """The page query parameter, 1 when absent or no number."""
    return F.coalesce(F.nullif(F.regexp_extract(url, r"[?&]page=([0-9]+)", 1), F.lit("")).try_cast("int"), F.lit(1))


def drive_type(c: Column) -> Column:
    """X11: AWD, 4WD, FWD or RWD from a description, else the trimmed text; null for an empty one."""
    low = F.lower(c)
    return (
        F.when(c == "", F.lit(None).cast("string"))
        .when(low.rlike("all wheel"), "AWD")
        .when(low.rlike("four wheel|4x4"), "4WD")
        .when(low.rlike("front[- ]wheel"), "FWD")
        .when(low.rlike("rear[- ]wheel"), "RWD")
        .otherwise(stripped(c))
    )


def digits_as_int(c: Column) -> Column:
    """All digits of the text as one number; null without any."""
    return F.nullif(F.regexp_replace(c, "[^0-9]", ""), F.lit("")).try_cast("bigint")


def mileage(c: Column) -> Column:
    """struct(value, unit), unit mi or km where it stands behind a space, in lower case, else null."""
    unit = F.when(c.rlike(r"(?U)\s+mi"), "mi").when(c.rlike(r"(?U)\s+km"), "km")
    return F.struct(digits_as_int(c).alias("value"), unit.alias("unit"))


def heading(c: Column) -> Column:
    """struct(raw, year, vin) of a vehicle page's heading: raw is without a leading year and without the VIN."""
    text = collapse(c)
    vin = F.nullif(F.upper(F.regexp_extract(text, r"(?i)\bvin\s*:\s*([a-hj-npr-z0-9]{11,20})\b", 1)), F.lit(""))
    left = F.trim(F.regexp_replace(text, r"(?i)\bvin\s*:\b.*$", ""))
    year = F.nullif(F.regexp_extract(left, r"^(\d{4})\s+.*$", 1), F.lit("")).cast("int")
    raw = F.regexp_replace(left, r"^\d{4}\s+(?=.*$)", "")
    raw = F.trim(F.regexp_replace(raw, r"(?i)\bvin\s*:\s*[a-hj-npr-z0-9]{11,20}\b", ""))
    return F.struct(F.nullif(raw, F.lit("")).alias("raw"), year.alias("year"), vin.alias("vin"))


def split_damages(c: Column) -> Column:
    """struct(first, second) of a comma list without blanks; empty strings where there is none."""
    parts = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    at = lambda i: F.coalesce(F.try_element_at(parts, F.lit(i)), F.lit(""))
    return F.struct(at(1).alias("primary"), at(2).alias("secondary"))


def damage_label(c: Column) -> Column:
    """Upper-cased label without outer blanks; null, blank and words for nothing become NONE."""
    label = F.upper(stripped(c))
    return F.when(label.isNull() | label.isin(NO_DAMAGE), "NONE").otherwise(label)


def damage_region(c: Column) -> Column:
    """The region of the vehicle that a damage label names."""
    table = F.create_map(*[F.lit(x) for pair in DAMAGE_REGION.items() for x in pair])
    return F.coalesce(F.try_element_at(table, damage_label(c)), F.lit("OTHER"))


def damage_score(c: Column) -> Column:
    """Ordinal score of a cleaned damage label, 2 for unknown labels."""
    table = F.create_map(*[F.lit(x) for pair in DAMAGE_SCORE.items() for x in pair])
    return F.coalesce(F.try_element_at(table, c), F.lit(2))


def expected_photos(c: Column) -> Column:
    """Photos that an auction house shows: copart 6, iaai 4, else null."""
    low = F.lower(F.trim(c))
    return F.when(low == "copart", 6).when(low == "iaai", 4)


def join_bar(c: Column) -> Column:
    """A list joined with bars."""
    return F.array_join(c, "|")


def error_text(c: Column, n: int = 1000) -> Column:
    """The first n characters."""
    return F.substring(c, 1, n)


def without_query(c: Column) -> Column:
    """The part before the first question mark."""
    return F.substring_index(c, "?", 1)


def base_feature(c: Column, categories: list[str]) -> Column:
    """The column that an encoded feature name (column_value) comes from."""
    out = c
    for name in sorted(categories, key=len):
        out = F.when((c == name) | F.startswith(c, F.lit(name + "_")), name).otherwise(out)
    return out


def runtime(c: Column) -> Column:
    """Seconds as MM:SS, or HH:MM:SS from an hour on."""
    s = c.cast("long")
    h, m = F.floor(s / 3600), F.floor(s / 60) % 60
    return F.when(h > 0, F.format_string("%02d:%02d:%02d", h, m, s % 60)).otherwise(F.format_string("%02d:%02d", m, s % 60))


def natural_key(c: Column) -> Column:
    """A text whose order is the natural order of names: digit runs compare as numbers."""
    parts = F.regexp_extract_all(F.lower(c), F.lit(r"([0-9]+|[^0-9]+)"), 1)
    # A number is its length, then its digits: of numbers without leading zeros the longer is the larger.
    number = lambda x: F.concat(F.lpad(F.length(x).cast("string"), 9, "0"), x)
    return F.array_join(F.transform(parts, lambda x: F.when(x.rlike("^[0-9]"), number(F.regexp_replace(x, "^0+(?=.)", ""))).otherwise(x)), "")


def folder_number(c: Column) -> Column:
    """A folder's leading integer; those without come last."""
    return F.coalesce(F.nullif(F.regexp_extract(c, r"^\s*(\d+)", 1), F.lit("")).try_cast("bigint"), F.lit(10**18))


# What pages hold, in lower case, by which they are told apart.
LIMITED_MARKS = ["too many attempts", "please contact support", "rate limit", "too many requests"]
SIGN_IN_MARK = 'class="btn btn-info">sign in<'
LOGIN_FORM_MARKS = ['form method="post" action="https://autohelperbot.com/en/login"', 'name="password"']
LIST_MARKS = ["copart and iaai lot sales history", 'class="lot_list"']
DETAIL_MARKS = ['type="application/ld+json"', 'class="params"', "auction date", "primary damage", "vin"]
CHALLENGE_MARKS = [
    "checking your browser before accessing", "just a moment...", "cf-browser-verification", "attention required!",
    "/cdn-cgi/challenge-platform/", "please enable javascript and cookies to continue",
]


def page_outcome(status: Column, html: Column, remaining: Column, url: Column | None = None, listing: bool = False) -> Column:
    """H8: one label of a fetched list or detail page, the first that holds."""
    low = F.lower(F.coalesce(html, F.lit("")))
    end = F.lower(F.coalesce(url, F.lit(""))) if url is not None else F.lit("")
    marks = lambda words: [F.contains(low, F.lit(w)) for w in words]
    some = lambda words: F.greatest(F.lit(False), *marks(words))
    login = F.endswith(end, F.lit("/login")) | F.contains(end, F.lit("/login?"))
    form = F.least(F.lit(True), *marks(LOGIN_FORM_MARKS))
    return (
        F.when((status == 429) | some(LIMITED_MARKS) | (F.coalesce(remaining.try_cast("int"), F.lit(1)) <= 0), "rate_limited")
        .when(status.isin(401, 403) | login | some([SIGN_IN_MARK]) | form, "auth")
        .when((status >= 400) | status.isNull(), "http_error")
        .when(some(LIST_MARKS if listing else DETAIL_MARKS), "valid")
        .when(some(CHALLENGE_MARKS), "challenge")
        .otherwise("unexpected")
    )
