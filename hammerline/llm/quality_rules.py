"""Quality rules and character n-gram perplexity bands.

The language model is an interpolated modified Kneser-Ney model over folded
characters.  Spark counts the highest order over all documents; lower-order
(continuation) counts, the three discounts of each order and all smoothed
values are DataFrame aggregates over those counts.  The finished model is a
table of (language, n-gram, log-probability, log-backoff); a task holds it as
arrays of n-gram hashes in sorted order beside the values and looks n-grams up
by binary search.

A document is rejected outside its language's band of log-perplexity.  Bands
come from the quartiles over all documents of the language that pass the base
rules.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from hammerline.llm import _text as X
from hammerline.llm._spark import cut, cut_to_tasks, release, small_batches

ORDER = 4
#: The model is broadcast up to this many n-grams; beyond that, documents meet their language's model in groups.
BROADCAST_GRAMS = 4_000_000
#: A band reaches this many quartile distances from the median, and this far at least.
BAND_REACH, BAND_LEAST = 4.0, 0.02
#: A short text's mean varies more, so its band is wider by this much over the root of its characters.
BAND_SHORT = 2.0
_START = 1
NO_LANGUAGE = "und"

_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[np.frombuffer(b"#*$%&|<>", np.uint8)] = True


def base_counts(t: X.Texts) -> dict[str, np.ndarray]:
    """Per text: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    s, e, of = t.pieces(X.SPACE)
    n_words = np.bincount(of, minlength=t.n)
    inside = ~X.SPACE[t.data] & ((t.data & 0xC0) != 0x80)
    total = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[t.offsets])
    ls, le, lof = t.lines()
    words_before = np.concatenate([[0], np.cumsum(~X.SPACE[t.data])])
    full = words_before[le] > words_before[ls]
    key = X.mix(t.hashes(ls[full], le[full]) + lof[full].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    lof = lof[full]
    distinct = np.bincount(lof[np.unique(key, return_index=True)[1]], minlength=t.n)
    w, at = X.windows(t.hashes(s, e), of, 8)
    again = at[X.repeated(X.mix(w + of[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))]
    cover = np.zeros(len(s) + 1, np.int64)
    np.add.at(cover, again, 1)
    np.add.at(cover, again + 8, -1)
    repeated = np.cumsum(cover)[:-1] > 0
    return {
        "n_words": n_words,
        "word_chars": total(inside),
        "n_symbols": total(_SYMBOLS[t.data]),
        "n_dup_lines": np.bincount(lof, minlength=t.n) - distinct,
        "n_repeat_words": np.bincount(of[repeated], minlength=t.n),
    }


def grams(t: X.Texts) -> tuple[np.ndarray, np.ndarray]:
    """The ORDER-grams that end at each character, four 16-bit symbols each, and their text; characters above U+FFFF are two symbols."""
    s = np.frombuffer(t.data.tobytes().decode("utf-8", "replace").encode("utf-16-le"), np.uint16)
    before = np.concatenate([[0], np.cumsum(((t.data & 0xC0) != 0x80).astype(np.int64) + (t.data >= 0xF0))])[t.offsets]
    of = np.repeat(np.arange(t.n), np.diff(before))
    s = np.where((s >= 65) & (s <= 90), s + 32, s)
    s = np.where((s >= 48) & (s <= 57), 48, s)
    s = np.where((s <= 32), 32, s)
    line = np.full(len(s) + (ORDER - 1) * t.n, _START, np.uint64)
    line[np.arange(len(s)) + (ORDER - 1) * (of + 1)] = s
    at = np.arange(len(s)) + (ORDER - 1) * (of + 1)
    code = np.zeros(len(s), np.uint64)
    for j in range(ORDER - 1, -1, -1):
        code = (code << np.uint64(16)) | line[at - j]
    return code, of


def count_grams(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """(lang, g, n): how often each ORDER-gram occurs in the texts of each language."""

    def partial(batches):
        held: dict[str, list] = {}

        def merge(parts):
            g = np.concatenate([p[0] for p in parts])
            n = np.concatenate([p[1] for p in parts])
            o = np.argsort(g, kind="stable")
            g, n = g[o], n[o]
            head = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
            return g[head], np.add.reduceat(n, head)

        for batch in batches:
            langs = np.array(batch.column(1).to_pylist(), object)
            for t in X.texts(batch.column(0)):
                code, of = grams(t)
                own = langs[t.first : t.first + t.n]
                names, which = np.unique(own.astype(str), return_inverse=True)
                for k, name in enumerate(names):
                    c = np.sort(code[which[of] == k])
                    if len(c):
                        head = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
                        held.setdefault(str(name), []).append((c[head], np.diff(np.append(head, len(c)))))
                        if len(held[str(name)]) > 16:
                            held[str(name)] = [merge(held[str(name)])]
        for name, parts in held.items():
            g, n = merge(parts)
            for a in range(0, len(g), 100_000):
                b = slice(a, a + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(g[b])), pa.array(g[b].view(np.int64)), pa.array(n[b].astype(np.int64))], ["lang", "g", "n"])

    rows = docs.select(F.col(text).alias("t"), F.coalesce(F.col(lang), F.lit(NO_LANGUAGE)).alias("l"))
    return rows.mapInArrow(partial, "lang string, g long, n long").groupBy("lang", "g").agg(F.sum("n").alias("n"))


def kneser_ney(counts: DataFrame) -> DataFrame:
    """(lang, k, g, lp, bo): interpolated log-probability of each k-gram and log-backoff weight of it as a context.

    Orders below the highest count distinct left neighbours.  The discounts are
    Chen and Goodman's D1, D2, D3+ from the counts of counts of each language
    and order, with the fallback 0.5, 1, 1.5 where those are too few.
    """
    mask = lambda bits: F.lit((1 << bits) - 1).cast("long")
    level = {ORDER: counts.select("lang", "g", "n")}
    for k in range(ORDER - 1, 0, -1):
        level[k] = level[k + 1].groupBy("lang", F.col("g").bitwiseAND(mask(16 * k)).alias("g")).agg(F.count(F.lit(1)).alias("n"))
    one = lambda k, v: F.sum((F.col("n") == v).cast("long"))
    lower = level[1].groupBy("lang").agg(F.count(F.lit(1)).alias("v")).select("lang", F.lit(0).cast("long").alias("g"), (-F.log("v")).alias("lp"))
    out = []
    for k in range(1, ORDER + 1):
        d = level[k].groupBy("lang").agg(*[one(k, i).alias(f"n{i}") for i in (1, 2, 3, 4)])
        y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
        fair = (F.col("n1") > 0) & (F.col("n2") > 0) & (F.col("n3") > 0) & (F.col("n4") > 0)
        cap = lambda e, i: F.when(fair, F.least(F.greatest(e, F.lit(0.05)), F.lit(i - 0.05))).otherwise(F.lit(i / 2))
        d = d.select("lang", cap(1 - 2 * y * F.try_divide("n2", "n1"), 1).alias("d1"), cap(2 - 3 * y * F.try_divide("n3", "n2"), 2).alias("d2"), cap(3 - 4 * y * F.try_divide("n4", "n3"), 3).alias("d3"))
        # The languages' discounts are a handful of rows; the optimizer sees their size at run time.
        own = level[k].join(d, "lang").withColumn("ctx", F.shiftrightunsigned("g", 16) if k > 1 else F.lit(0).cast("long"))
        own = own.withColumn("d", F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3")))
        over = Window.partitionBy("lang", "ctx")
        own = own.withColumn("total", F.sum("n").over(over)).withColumn("spare", F.sum("d").over(over) / F.col("total"))
        low = lower.select("lang", F.col("g").alias("suffix"), F.col("lp").alias("low"))
        own = own.withColumn("suffix", F.col("g").bitwiseAND(mask(16 * (k - 1))))
        own = own.join(low, ["lang", "suffix"]).withColumn("lp", F.log((F.col("n") - F.col("d")) / F.col("total") + F.col("spare") * F.exp("low")))
        own = cut_to_tasks(own.select("lang", "g", "lp", "ctx", F.log("spare").alias("bo")))
        lower = own.select("lang", "g", "lp")
        out.append(own.select("lang", F.lit(k).alias("k"), "g", "lp", F.lit(None).cast("double").alias("bo")))
        out.append(own.select("lang", F.lit(k - 1).alias("k"), F.col("ctx").alias("g"), F.lit(None).cast("double").alias("lp"), "bo").distinct())
    table = out[0]
    for x in out[1:]:
        table = table.unionByName(x)
    return table.groupBy("lang", "k", "g").agg(F.max("lp").alias("lp"), F.max("bo").alias("bo"))


class GramArrays:
    """One language's model: per order, sorted n-gram hashes with log-probability and backoff."""

    def __init__(self, k: np.ndarray, g: np.ndarray, lp: np.ndarray, bo: np.ndarray):
        self.levels = {}
        for order in range(ORDER + 1):
            at = k == order
            h = X.mix(g[at].view(np.uint64))
            o = np.argsort(h)
            self.levels[order] = (h[o], lp[at][o].astype(np.float32), np.nan_to_num(bo[at][o]).astype(np.float32))

    def find(self, order: int, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = self.levels[order][0]
        if not len(keys):
            return np.zeros(len(code), np.int64), np.zeros(len(code), bool)
        h = X.mix(code)
        at = np.searchsorted(keys, h)
        at[at == len(keys)] = 0
        return at, keys[at] == h

    def log_probability(self, code: np.ndarray) -> np.ndarray:
        out = np.zeros(len(code))
        todo = np.arange(len(code))
        for k in range(ORDER, 0, -1):
            c = code[todo] & np.uint64((1 << 16 * k) - 1)
            at, found = self.find(k, c)
            lp = self.levels[k][1]
            known = found.copy()
            known[found] = ~np.isnan(lp[at[found]])
            out[todo[known]] += lp[at[known]]
            todo = todo[~known]
            if not len(todo):
                return out
            at, found = self.find(k - 1, c[~known] >> np.uint64(16))
            out[todo[found]] += self.levels[k - 1][2][at[found]]
        out[todo] += -np.log(65536.0)
        return out


def _model_arrays(rows: pa.Table) -> dict[str, GramArrays]:
    out = {}
    langs = np.array(rows.column("lang").to_pylist(), object)
    cols = [rows.column(c).to_numpy() for c in ("k", "g", "lp", "bo")]
    for name in dict.fromkeys(langs.tolist()):
        at = langs == name
        out[name] = GramArrays(*[np.asarray(c)[at] for c in cols])
    return out


_STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, log_ppl double"


def _scored(batch: pa.RecordBatch, models: dict[str, GramArrays]) -> pa.RecordBatch:
    """The batch's id and lang columns with the base counts and the mean negative log-probability a character."""
    langs = np.array(batch.column(2).to_pylist(), object)
    parts: dict[str, list] = {}
    for t in X.texts(batch.column(1)):
        for k, v in base_counts(t).items():
            parts.setdefault(k, []).append(v)
        code, of = grams(t)
        lp = np.zeros(len(code))
        own = langs[t.first : t.first + t.n]
        for name in set(own.tolist()):
            at = (own == name)[of]
            if name in models:
                lp[at] = models[name].log_probability(code[at])
        n = np.bincount(of, minlength=t.n)
        sums = np.bincount(of, lp, minlength=t.n)
        parts.setdefault("log_ppl", []).append(np.where(n > 0, -sums / np.maximum(n, 1), np.nan))
    cols = [pa.array(np.concatenate(v).astype(np.int64)) for k, v in parts.items() if k != "log_ppl"]
    ppl = np.concatenate(parts["log_ppl"]) if parts else np.empty(0)
    return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *cols, pa.array(ppl, mask=np.isnan(ppl))], ["id", "lang", *[k for k in parts if k != "log_ppl"], "log_ppl"])


def score_documents(docs: DataFrame, text: str = "text", lang: str = "lang", id_col: str = "doc_id") -> DataFrame:
    """(id, lang, base counts, log_ppl) per row; the model is fitted on all rows."""
    docs = small_batches(docs)
    model = cut_to_tasks(kneser_ney(cut_to_tasks(count_grams(docs, text, lang))))
    release(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"), F.coalesce(F.col(lang), F.lit(NO_LANGUAGE)).alias("lang"))
    kind = f"id {rows.schema['id'].dataType.simpleString()}, lang string, {_STATS}"
    if model.count() <= BROADCAST_GRAMS:
        shared = docs.sparkSession.sparkContext.broadcast(model.toArrow())

        def score(batches):
            models = _model_arrays(shared.value)
            for batch in batches:
                if batch.num_rows:
                    yield _scored(batch, models)

        return rows.mapInArrow(score, kind)

    # Otherwise the model of a language is sent to each of as many groups as its rows need.
    groups = rows.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / 5000).cast("int").alias("m"))
    dealt = rows.join(groups, "lang").withColumn("i", F.pmod(F.xxhash64("id", "text"), F.col("m")).cast("int"))
    copies = model.join(groups, "lang").select(F.col("lang").alias("l2"), F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("i2"), "k", "g", "lp", "bo")

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        models = _model_arrays(right.rename_columns(["lang", *right.column_names[1:]])) if right.num_rows else {}
        return pa.Table.from_batches([_scored(b, models) for b in left.select(["id", "text", "lang"]).to_batches()])

    return dealt.groupBy("lang", "i").cogroup(copies.groupBy("l2", "i2")).applyInArrow(meet, kind)


def quality_verdicts(docs: DataFrame, text: str = "text", lang: str = "lang", id_col: str = "doc_id", reach: float = BAND_REACH, least: float = BAND_LEAST) -> DataFrame:
    """One row per input row: (id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, log_ppl, band_low, band_high, kept).

    A null text has no words and fails the base rules; a null language counts as
    a language of its own.  A language without a band (no document passes the
    base rules) rejects nothing by perplexity.  Ids may be null or repeat; only
    the named columns are read; an empty table gives an empty result.
    """
    stats = score_documents(docs, text, lang, id_col)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    stats = cut(stats.withColumn("base_failed", failed))
    # Quantised values keep the exact percentiles' buffers small whatever the number of documents.
    q = F.percentile(F.round("log_ppl", 3), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    band = stats.where("not base_failed and log_ppl is not null").groupBy("lang").agg(q.alias("q"))
    wide = lambda i, j: F.greatest(reach * (F.col("q")[j] - F.col("q")[i]), F.lit(least))
    band = band.select("lang", (F.col("q")[1] - wide(0, 1)).alias("band_low"), (F.col("q")[1] + wide(1, 2)).alias("band_high"))
    inside = F.coalesce(F.col("log_ppl").between(F.col("band_low"), F.col("band_high")), F.lit(True))
    slack = BAND_SHORT / F.sqrt(F.greatest(F.col("word_chars"), F.lit(1)))
    # A band for each language: few rows, but as many as there are languages, so the number is checked.
    band = cut(band)
    band = F.broadcast(band) if band.count() <= 100_000 else band
    out = stats.join(band, "lang", "left").withColumns({"band_low": F.col("band_low") - slack, "band_high": F.col("band_high") + slack})
    out = out.withColumn("kept", ~F.col("base_failed") & inside)
    return out.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "log_ppl", "band_low", "band_high", "kept")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that quality_verdicts keeps; rows are told apart by id, text and language, so equal rows share a verdict."""
    key = F.struct("doc_id", F.xxhash64("text", "lang").alias("h"))
    kept = quality_verdicts(docs.select(key.alias("key"), "text", "lang"), id_col="key").where("kept").select(F.col("key").alias("_kept")).distinct()
    return docs.join(kept, key.eqNullSafe(F.col("_kept")), "left_semi")
