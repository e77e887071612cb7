"""Personal data and what gives it away, in DataFrame functions only.

Four kinds of personal data, and secrets (long runs of letters and digits mixed),
are found by pattern.  Each value found is a protected entity c with information
content IC(c) = log(N / df(c)) over the N documents of the corpus.  A term t that
stands near, in the line of a find and between its neighbours of the same kind,
reveals PMI(c, t) = log(N * df(c, t) / (df(c) * (df(t) + 1))) of it: smoothed as
if every term stood in one more document, without c.  Where that is more than a
share of IC(c), on the evidence of several documents and different places, or of
all that c has if these are fewer, t discloses c: its occurrences are spans as
well, and sanitising generalises or removes them.

All frequencies count documents: rows that are equal in id and text are one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from hammerline.llm._spark import cut, release

#: The kinds in the order of results, with patterns that find what the leftmost, longest search finds.
#: Possessive repeats and look-behinds only stop retries that cannot succeed, so long texts stay linear.
KINDS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A secret is a run of so many letters and digits at least, with some of both.
SECRET = r"(?<![A-Za-z0-9])[A-Za-z0-9]{24,}+"
PATTERNS = KINDS | {"secret": SECRET}
#: What a text must hold for the kind to be looked for: cheap tests that spare most texts the patterns.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]+\.[0-9]", "card": r"[0-9][0-9 -]{11}", "phone": r"\+[0-9]", "secret": "[A-Za-z0-9]{24}"}

#: A term discloses an entity from this share of its information, seen in so many different places and documents, or in all of
#: an entity that has fewer.
DISCLOSED, PLACES = 0.8, 3
#: Terms are sought in so many code points before and after a find.
NEAR_CHARS = 200
#: Terms are runs of letters and digits of this length at least, lower-cased.
TERM_CHARS = 4
#: Term tables are broadcast up to this many rows.
BROADCAST_ROWS = 500_000

#: Finds are gathered in runs of so many parts, so that a text with very many of them is not copied for each.
RUN = 256

_SPLIT_TERMS = r"(?<![\p{L}\p{N}])(?=[\p{L}\p{N}])"


def _clean(text: Column) -> Column:
    """The text with the two marks used below replaced by another control character: offsets stay."""
    return F.translate(F.coalesce(text, F.lit("")), "\u0001\u0002", "\u0003\u0003")


def _digits(body: Column) -> Column:
    return F.regexp_replace(body, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def add(acc, i):
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = F.when(i % 2 == 1, d * 2).otherwise(d)
        return acc + F.when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def _valid(kind: str, body: Column) -> Column:
    if kind == "ip":
        short = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
        return F.forall(F.split(body, r"\."), lambda p: (F.length(short(p)) <= 3) & (F.substring(short(p), 1, 3).cast("int") <= 255))
    if kind == "card":
        return F.length(_digits(body)).between(13, 19) & _luhn(_digits(body))
    if kind == "phone":
        return F.length(_digits(body)).between(9, 15)
    if kind == "secret":
        return (F.length(_digits(body)) >= 3) & (F.length(_digits(body)) <= F.length(body) - 3)
    return F.lit(True)


def _bound(value: Column, use) -> Column:
    """use(value), with the value worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _gathered(parts: Column, start: dict, empty: Column, step) -> Column:
    """All finds that step(acc, part) appends to acc["out"], part by part; `start` has the other fields of acc."""
    runs = _bound(parts, lambda p: F.transform(F.sequence(F.lit(0), F.greatest(F.size(p) - 1, F.lit(0)), F.lit(RUN)), lambda k: F.slice(p, k + 1, F.lit(RUN))))

    def over(acc, run):
        done = F.aggregate(run, F.struct(*[acc[k].alias(k) for k in start], empty.alias("out")), step)
        return _bound(done, lambda r: F.struct(*[r[k].alias(k) for k in start], F.concat(acc["out"], F.array(r["out"])).alias("out")))

    return F.flatten(F.aggregate(runs, F.struct(*[v.alias(k) for k, v in start.items()], F.slice(F.array(empty), 1, 0).alias("out")), over)["out"])


def found(clean: Column, kind: str, near: bool = False) -> Column:
    """array<struct<s, e, v>>: the kind's valid finds, as code point offsets and the text found.

    With `near` also what stands before and after a find: in its line, up to the
    kind's next match (valid or not) and NEAR_CHARS code points at most.
    """
    marked = F.split(F.regexp_replace(clean, PATTERNS[kind], "\u0001$0\u0002"), "\u0001")
    body = lambda part: F.substring_index(part, "\u0002", 1)
    rest = lambda part: F.substring_index(part, "\u0002", -1)
    tail = lambda part: F.right(F.substring_index(rest(part), "\n", -1), F.lit(NEAR_CHARS))
    head = lambda part: F.left(F.substring_index(rest(part), "\n", 1), F.lit(NEAR_CHARS))

    def step(acc, part):
        more = [acc["tail"].alias("before"), head(part).alias("after")] if near else []
        find = F.struct(acc["at"].alias("s"), (acc["at"] + F.length(body(part))).alias("e"), body(part).alias("v"), *more)
        kept = [tail(part).alias("tail")] if near else []
        return F.struct((acc["at"] + F.length(part) - 1).alias("at"), *kept, F.concat(acc["out"], F.array(find)).alias("out"))

    empty = F.array().cast("array<struct<s:int,e:int,v:string" + (",before:string,after:string" if near else "") + ">>")
    def finds(m):
        start = {"at": F.length(m[0])} | ({"tail": tail(m[0])} if near else {})
        return _gathered(F.slice(m, F.lit(2), F.greatest(F.size(m) - 1, F.lit(0))), start, empty, step)

    wanted = clean.rlike(HINTS[kind])
    return F.when(wanted, F.filter(_bound(marked, finds), lambda x: _valid(kind, x["v"]))).otherwise(empty)


def with_base(docs: DataFrame, text: str, near: bool = False) -> DataFrame:
    """The rows with one column of finds for each kind, named find_<kind>."""
    out = docs.withColumn("_clean", _clean(F.col(text)))
    return out.withColumns({f"find_{k}": found(F.col("_clean"), k, near) for k in PATTERNS}).drop("_clean")


def _terms(text: Column) -> Column:
    """array<string> of words with what follows them, cut before each word."""
    return F.split(text, _SPLIT_TERMS)


def _distinct_terms(text: Column) -> Column:
    """One row for each different term of a text."""
    return F.explode(F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) >= TERM_CHARS)))


def disclosing_terms(rows: DataFrame, disclosed: float = DISCLOSED, places: int = PLACES) -> DataFrame:
    """The terms (term, share) that disclose an entity, from rows (key, text)."""
    # Equal rows share a key and weigh one together; where there are none, no row needs a weight.
    again = cut(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    extra = again.agg(F.sum(F.col("n") - 1)).first()[0] or 0
    n = rows.count() - extra
    finds = F.concat(*[F.col(f"find_{k}") for k in PATTERNS])
    near = with_base(rows, "text", True).select("key", F.explode(finds).alias("f"))
    near = near.select("key", F.col("f.v").alias("entity"), F.concat("f.before", F.lit("\u0001"), "f.after").alias("place"))
    met = near.select("key", "entity", F.xxhash64("place").alias("place"), _distinct_terms(F.col("place")).alias("term"))
    entities = near.groupBy("entity").agg(F.countDistinct("key").alias("df_entity"), F.countDistinct(F.xxhash64("place")).alias("all_places"))
    pairs = met.groupBy("entity", "term").agg(F.countDistinct("place").alias("places"), F.countDistinct("key").alias("both")).join(entities, "entity")
    pairs = cut(pairs.where((F.col("places") >= F.least(F.lit(places), "all_places")) & (F.col("both") >= F.least(F.lit(places), "df_entity"))))
    # All terms are counted, merged in the tasks first, and then met with the pairs.
    held = rows
    weight = F.lit(1.0)
    if extra:
        held = rows.join(_bounded(again.withColumnRenamed("n", "_times")), "key", "left")
        weight = 1.0 / F.coalesce("_times", F.lit(1))
    df_term = held.select(weight.alias("w"), _distinct_terms(F.col("text")).alias("term")).groupBy("term").agg(F.round(F.sum("w")).alias("df_term"))
    # The plans and events of the steps so far are garbage on the driver, which grows its heap rather than collect it.
    release(rows.sparkSession)
    known = df_term.join(_bounded(pairs), "term")
    pmi = F.log(n * F.col("both") / (F.col("df_entity") * (F.col("df_term") + 1)))
    share = known.withColumn("share", F.try_divide(pmi, F.log(n / F.col("df_entity"))))
    return cut(share.where(F.col("share") >= disclosed).groupBy("term").agg(F.max("share").alias("share")))


def _bounded(table: DataFrame) -> DataFrame:
    """The table, to be broadcast if its rows are few; otherwise the join shuffles."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def with_spans(docs: DataFrame, text: str = "text", id_col: str = "doc_id", disclosed: float = DISCLOSED, places: int = PLACES) -> DataFrame:
    """The rows with find_<kind> for the base kinds and secrets, and find_term for disclosing terms."""
    rows = docs.withColumn("_key", F.xxhash64(F.col(id_col), F.col(text)))
    plain = rows.select(F.col("_key").alias("key"), _clean(F.col(text)).alias("text"))
    terms = _bounded(disclosing_terms(plain, disclosed, places))
    held = plain.select("key", _distinct_terms(F.col("text")).alias("term"))
    # A text's terms are sorted, and a word is sought among them by halving: with steps from the largest power of two down.
    held = held.join(terms, "term").groupBy("key").agg(F.sort_array(F.collect_set("term")).alias("_terms"))
    held = held.withColumn("_steps", F.filter(F.array(*[F.lit(1 << i) for i in range(30, -1, -1)]), lambda k: k <= F.size("_terms")))
    # Terms per text are few rows where few terms disclose; their number is checked before they are broadcast.
    held = _bounded(cut(held.withColumnRenamed("key", "_key")))
    release(docs.sparkSession)
    out = with_base(rows, text).join(held, "_key", "left")

    def listed(word):
        halve = lambda at, k: F.when(F.get("_terms", at + k - 1) <= word, at + k).otherwise(at)
        return F.get("_terms", F.aggregate("_steps", F.lit(0), halve) - 1) == word

    def step(acc, part):
        def add(word):
            find = F.struct(acc["at"].alias("s"), (acc["at"] + F.length(word)).alias("e"), word.alias("v"))
            more = F.when(_bound(F.lower(word), listed), F.concat(acc["out"], F.array(find))).otherwise(acc["out"])
            return F.struct((acc["at"] + F.length(part)).alias("at"), more.alias("out"))

        return _bound(F.regexp_extract(part, r"^[\p{L}\p{N}]+", 0), add)

    empty = F.array().cast("array<struct<s:int,e:int,v:string>>")
    own = _gathered(_terms(_clean(F.col(text))), {"at": F.lit(0)}, empty, step)
    return out.withColumn("find_term", F.when(F.col("_terms").isNotNull(), own).otherwise(empty)).drop("_key", "_terms", "_steps")


def _written(kinds) -> Column:
    write = lambda k: F.transform(F.col(f"find_{k}"), lambda x: F.concat_ws(":", F.lit(k), x["s"], x["e"]))
    return F.concat_ws(",", F.concat(*[write(k) for k in kinds]))


def personal_spans(docs: DataFrame, text: str = "text", id_col: str = "doc_id", disclosed: float = DISCLOSED, places: int = PLACES) -> DataFrame:
    """One row per input row: (id, n_email, n_ip, n_card, n_phone, base_spans, spans, n_secret, n_found).

    Spans are kind:start:end in code points, comma-joined by kind and start;
    secrets and terms come last.  n_found counts all finds but terms.  A null
    text is an empty one; ids may be null or repeat; rows equal in id and text
    count as one document in all statistics, but each has its row.  Only the two
    named columns are read; an empty table gives an empty result.
    """
    rows = with_spans(docs.select(F.col(id_col).alias(id_col), F.col(text).alias(text)), text, id_col, disclosed, places)
    count = lambda k: F.size(f"find_{k}").cast("long")
    counts = [count(k).alias(f"n_{k}") for k in KINDS]
    total = sum((count(k) for k in PATTERNS), F.lit(0).cast("long"))
    return rows.select(id_col, *counts, _written(KINDS).alias("base_spans"), _written([*PATTERNS, "term"]).alias("spans"), count("secret").alias("n_secret"), total.alias("n_found"))


def sanitise(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows with personal data replaced by its kind; a disclosing number becomes [NUMBER], another term goes.

    Overlapping spans are replaced once, by the kind of the one that begins
    first.  Null texts stay null, other columns as they are.
    """
    names = docs.columns
    rows = with_spans(docs, text, id_col)
    tag = lambda k: F.transform(
        F.col(f"find_{k}"), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), (F.when(x["v"].rlike("^[0-9]+$"), F.lit("[NUMBER]")).otherwise(F.lit("")) if k == "term" else F.lit(f"[{k.upper()}]")).alias("r"))
    )
    spans = F.array_sort(F.concat(*[tag(k) for k in [*PATTERNS, "term"]]))

    def step(acc, x):
        between = F.substring(F.col(text), acc["at"] + 1, F.greatest(x["s"] - acc["at"], F.lit(0)))
        grown = F.struct(F.greatest(acc["at"], x["e"]).alias("at"), F.when(x["s"] < acc["at"], acc["out"]).otherwise(F.concat(acc["out"], between, x["r"])).alias("out"))
        return grown

    done = F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substring(F.col(text), acc["at"] + 1, F.length(text))))
    return rows.withColumn(text, F.when(F.size(spans) > 0, done).otherwise(F.col(text))).select(*names)
