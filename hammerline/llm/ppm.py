"""Unigram and prediction-by-partial-matching scores of documents.

The model predicts each UTF-8 byte of a lower-cased text, and an end mark, from
the up to ORDER bytes before it.  A context that has seen n symbols, d of them
different, gives a seen symbol its count over n + d and keeps d over n + d for
escaping to the next shorter context, where the symbols of the longer one are
excluded; below the empty context the symbols left are alike.  Spark counts
the contexts of the training texts; a task holds them as the levels of a trie
in sorted arrays.  A trie too large to be broadcast stays a table: its contexts
meet the texts' distinct grams in groups, with the same scores.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from hammerline.llm import _text as X
from hammerline.llm._spark import cut, most_frequent, small_batches

ORDER = 3
#: Symbols: a byte is its value + 2, the end of a text 1; 0 stands before its beginning.
_END, _ALPHABET = 1, 257
#: The trie is broadcast up to this many entries; beyond that it is dealt out in groups of about GROUP_ENTRIES, and
#: of the scores of the texts' grams those of the most frequent are broadcast, COMMON_GRAMS at most.
BROADCAST_ENTRIES, GROUP_ENTRIES, COMMON_GRAMS = 6_000_000, 500_000, 2_000_000
#: Entries of contexts of 0 and 1 symbols: few at every size, so they are at hand in each group.
_SHORT, _LOW_BITS = 2, 18


def held_out(id_col: str = "doc_id"):
    """Rows whose crc32(id as text) mod 10 is 0; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 10 == 0, F.lit(False))


def symbol_codes(t: X.Texts, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """The (order + 1)-grams of symbols, nine bits each, that end at each byte and at each text's end; their text."""
    n = t.lengths + 1
    of = np.repeat(np.arange(t.n), n)
    line = np.zeros(int(n.sum()) + order * t.n, np.uint64)
    stop = np.cumsum(n)
    body = np.arange(len(t.data)) + np.repeat(np.arange(t.n), t.lengths)
    sym = np.empty(int(n.sum()), np.uint64)
    sym[body] = t.data.astype(np.uint64) + np.uint64(2)
    sym[stop - 1] = _END
    at = np.arange(len(sym)) + order * (of + 1)
    line[at] = sym
    code = np.zeros(len(sym), np.uint64)
    for j in range(order, -1, -1):
        code = (code << np.uint64(9)) | line[at - j]
    return code, of


class Trie:
    """Contexts of 0..order symbols with their followers' counts, and code lengths of grams.

    `short` gives codes and counts for the contexts of 0 and 1 symbols where `code` holds only a group of the others.
    """

    def __init__(self, code: np.ndarray, count: np.ndarray, order: int, short: tuple[np.ndarray, np.ndarray] | None = None):
        self.order = order
        self.levels = []
        for k in range(order + 1):
            c, n = short if short is not None and k < _SHORT else (code, count)
            c = c & np.uint64((1 << 9 * (k + 1)) - 1)
            o = np.argsort(c, kind="stable")
            c, n = c[o], n[o].astype(np.float64)
            head = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]])) if len(c) else np.empty(0, np.int64)
            c, n = c[head], np.add.reduceat(n, head) if len(head) else n
            ctx = c >> np.uint64(9)
            first = np.flatnonzero(np.concatenate([[True], ctx[1:] != ctx[:-1]])) if len(c) else np.empty(0, np.int64)
            total = np.add.reduceat(n, first) if len(first) else n
            kinds = np.diff(np.append(first, len(c)))
            self.levels.append((c, n, ctx[first], first, total, kinds.astype(np.float64)))
        # A gram of the longest context that was seen needs one lookup: most of a text.
        _, n, _, _, total, kinds = self.levels[order]
        self.seen = np.log10(n / np.repeat(total + kinds, kinds.astype(np.int64)))

    def _gram(self, k: int, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = self.levels[k][0]
        at = np.searchsorted(keys, code)
        at[at == len(keys)] = 0
        return at, keys[at] == code

    def log10(self, code: np.ndarray) -> np.ndarray:
        """log10 of each gram's last symbol after the others."""
        out = np.zeros(len(code))
        if not len(self.levels[0][0]):
            return out - np.log10(_ALPHABET)
        at, seen = self._gram(self.order, code)
        out[seen] = self.seen[at[seen]]
        todo = np.flatnonzero(~seen)
        parent = np.full(len(code), -1)  # the last context escaped from, at the level above
        for k in range(self.order, -1, -1):
            if not len(todo):
                return out
            c = code[todo] & np.uint64((1 << 9 * (k + 1)) - 1)
            at, seen = self._gram(k, c)
            keys, n, ctxs, first, total, kinds = self.levels[k]
            own = np.searchsorted(ctxs, c >> np.uint64(9))
            own[own == len(ctxs)] = 0
            has = ctxs[own] == c >> np.uint64(9)
            # Totals and kinds without the symbols of the longer context, which are all seen here too.
            full, left = total[own], kinds[own]
            lost_n, lost_k = np.zeros(len(todo)), np.zeros(len(todo))
            p = parent[todo]
            sub = np.flatnonzero(has & (p >= 0))
            if len(sub):
                lost_n[sub], lost_k[sub] = self._excluded(k, p[sub], own[sub])
            size, kind = full - lost_n, left - lost_k
            esc = has & (kind > 0)
            hit = seen & has
            out[todo[hit]] += np.log10(n[at[hit]] / (size[hit] + kind[hit]))
            miss = ~hit
            drop = miss & esc
            out[todo[drop]] += np.log10(kind[drop] / (size[drop] + kind[drop]))
            parent[todo[has]] = own[has]
            todo = todo[miss]
        seen0 = self.levels[0][5][0]
        out[todo] -= np.log10(max(1.0, _ALPHABET - seen0))
        return out

    def _excluded(self, k: int, parent: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts here of the symbols that the context one longer has seen; parent indexes contexts at level k + 1."""
        keys, n, ctxs, _, _, _ = self.levels[k]
        up_keys, _, _, up_first, _, up_kinds = self.levels[k + 1]
        pairs, back = np.unique(parent, return_inverse=True)
        here = np.empty(len(pairs), np.int64)
        here[back] = own
        size = up_kinds[pairs].astype(np.int64)
        row = np.repeat(np.arange(len(pairs)), size)
        inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        symbol = up_keys[np.repeat(up_first[pairs], size) + inner] & np.uint64(511)
        at = np.searchsorted(keys, (ctxs[here[row]] << np.uint64(9)) | symbol)
        return np.bincount(row, n[at], minlength=len(pairs))[back], size.astype(np.float64)[back]


def count_codes(docs: DataFrame, text: str, order: int = ORDER) -> DataFrame:
    """(code, n): how often each (order + 1)-gram of symbols occurs in the texts."""

    def merge(parts):
        g, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        o = np.argsort(g, kind="stable")
        g, n = g[o], n[o]
        head = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else np.empty(0, np.int64)
        return g[head], np.add.reduceat(n, head) if len(head) else n

    def partial(batches):
        held: list = []
        for batch in batches:
            for t in X.texts(batch.column(0)):
                c = np.sort(symbol_codes(t.lower(), order)[0])
                head = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
                held.append((c[head], np.diff(np.append(head, len(c)))))
                if len(held) > 16:
                    held = [merge(held)]
        if held:
            g, n = merge(held)
            for a in range(0, len(g), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(g[a : a + 100_000].view(np.int64)), pa.array(n[a : a + 100_000].astype(np.int64))], ["code", "n"])

    return docs.select(text).mapInArrow(partial, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def gram_scores(counts: DataFrame, asked: DataFrame, entries: int, order: int = ORDER) -> DataFrame:
    """(code, n, score): log10 of each asked gram (code, n) in the trie of `counts`, of so many entries, which stays a table.

    Grams whose contexts end in the same two symbols meet in one group, so contexts
    of two symbols and more are whole there.
    """
    sc = counts.sparkSession.sparkContext
    low = counts.groupBy(F.col("code").bitwiseAND(F.lit((1 << _LOW_BITS) - 1).cast("long")).alias("code")).agg(F.sum("n").alias("n")).toArrow()
    short = sc.broadcast((low.column("code").to_numpy().view(np.uint64), low.column("n").to_numpy()))
    groups = -(-entries // GROUP_ENTRIES)
    ending = F.shiftright("code", 9).bitwiseAND(F.lit((1 << _LOW_BITS) - 1).cast("long"))
    dealt = lambda df: df.select("code", "n", F.pmod(F.xxhash64(ending), F.lit(groups)).alias("part"))

    def score(own: pa.Table, grams: pa.Table) -> pa.Table:
        # Without own contexts the longer ones are all unseen, and the short ones decide.
        k = order if own.num_rows else min(order, _SHORT - 1)
        trie = Trie(own.column("code").to_numpy().view(np.uint64), own.column("n").to_numpy(), k, short.value)
        code = grams.column("code").to_numpy().view(np.uint64)
        out = trie.log10(code & np.uint64((1 << 9 * (k + 1)) - 1))
        return pa.table({"code": grams.column("code"), "n": grams.column("n"), "score": out})

    return dealt(counts).groupBy("part").cogroup(dealt(asked).groupBy("part")).applyInArrow(score, "code long, n long, score double")


#: The most frequent words are broadcast, so many at most; the others are joined.
COMMON_WORDS = 1_000_000


def count_words(docs: DataFrame, text: str) -> DataFrame:
    """(word, n): how often each word (by its hash) occurs; tasks merge their own words first."""

    def partial(batches):
        held: list = []
        size = 0

        def out():
            u, back = np.unique(np.concatenate([h for h, _ in held]), return_inverse=True)
            n = np.bincount(back, np.concatenate([n for _, n in held]), minlength=len(u)).astype(np.int64)
            held.clear()
            for a in range(0, len(u), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(u[a : a + 100_000].view(np.int64)), pa.array(n[a : a + 100_000])], ["word", "n"])

        for batch in batches:
            for t in X.texts(batch.column(0)):
                t = t.lower()
                s, e, _ = t.pieces(X.SPACE)
                u, n = np.unique(t.hashes(s, e), return_counts=True)
                held.append((u, n))
                size += len(u)
            if size > 2_000_000:
                yield from out()
                size = 0
        if held:
            yield from out()

    return docs.select(text).mapInArrow(partial, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _found(keys: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each asked value stands among sorted keys, and whether it does."""
    at = np.searchsorted(keys, asked)
    at[at == len(keys)] = 0
    return at, keys[at] == asked if len(keys) else np.zeros(len(asked), bool)


def _listed(name: str, values: np.ndarray, of: np.ndarray, n: int) -> pa.Array:
    """For each of n texts the different values that it holds, with how many times."""
    o = np.lexsort((values, of))
    values, of = values[o], of[o]
    head = np.flatnonzero(np.concatenate([[True], (values[1:] != values[:-1]) | (of[1:] != of[:-1])])) if len(values) else np.empty(0, np.int64)
    times = np.diff(np.append(head, len(values)))
    pairs = pa.StructArray.from_arrays([pa.array(values[head].view(np.int64)), pa.array(times.astype(np.int32))], [name, "times"])
    return pa.ListArray.from_arrays(np.searchsorted(of[head], np.arange(n + 1)).astype(np.int32), pairs)


def score_documents(docs: DataFrame, text: str = "text", id_col: str = "doc_id", order: int = ORDER, common_words: int = COMMON_WORDS) -> DataFrame:
    """One row per input row: (id, held_out, n_tokens, n_known, train_tokens, base_score, score).

    A null text is an empty one: one token, the end.  Rows that are held out teach
    neither model.  With an empty training set every count is 0 and every symbol
    alike.  Ids may be null or repeat; only the two named columns are read; an
    empty table gives an empty result.

    Texts are never shuffled: a task scores the frequent words itself, and only
    the occurrences of the others meet their counts in a join.  Where the trie is
    too large to be broadcast, the same holds for grams and their scores.
    """
    sc = docs.sparkSession.sparkContext
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).withColumn("held", held_out("id"))
    grams = cut(count_codes(rows.where("not held"), "text", order))
    entries = grams.count()
    dealt = entries > BROADCAST_ENTRIES and order >= _SHORT
    if dealt:
        scores = cut(gram_scores(grams, count_codes(rows, "text", order), entries, order))
        often, *model = most_frequent(scores, COMMON_GRAMS, "code", "score")
    else:
        got = grams.toArrow()
        model = Trie(got.column("code").to_numpy().view(np.uint64), got.column("n").to_numpy(), order)
    trie = sc.broadcast(model)
    counts = cut(count_words(rows.where("not held"), "text"))
    sums = counts.agg(F.sum("n"), F.count(F.lit(1))).first()
    ends = rows.where("not held").count()
    big_n, v = int(sums[0] or 0) + ends, int(sums[1]) + (ends > 0)
    down = float(np.log10(big_n + 0.1 * (v + 1)))
    least, *table = most_frequent(counts, common_words)
    common = sc.broadcast(table)

    def score(batches):
        model, (keys, n) = trie.value, common.value
        for batch in batches:
            cols: list[list] = [[] for _ in range(6)]
            for t in X.texts(batch.column(1)):
                t = t.lower()
                s, e, of = t.pieces(X.SPACE)
                h = t.hashes(s, e)
                at, known = _found(keys, h)
                sums = lambda w, at=of[known], t=t: np.bincount(at, w, minlength=t.n)
                code, cof = symbol_codes(t, order)
                if dealt:
                    where, met = _found(model[0], code)
                    bits, left = np.zeros(len(code)), ~met
                    bits[met] = model[1][where[met]]
                else:
                    bits, left = model.log10(code), np.zeros(len(code), bool)
                cols[0].append(np.bincount(of, minlength=t.n) + 1)
                cols[1].append(sums(None).astype(np.int64) + (ends > 0))
                cols[2].append(sums(np.log10(n[at[known]] + 0.1)) + np.log10(ends + 0.1))
                cols[3].append(np.bincount(cof, bits, minlength=t.n))
                cols[4].append(_listed("word", h[~known], of[~known], t.n))
                cols[5].append(_listed("code", code[left], cof[left], t.n))
            join = lambda x, kind: pa.array(np.concatenate(x).astype(kind) if x else np.empty(0, kind))
            lists = lambda x, name: pa.concat_arrays(x) if x else pa.array([], pa.list_(pa.struct([(name, pa.int64()), ("times", pa.int32())])))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), join(cols[0], np.int64), join(cols[1], np.int64), join(cols[2], float), join(cols[3], float), lists(cols[4], "word"), lists(cols[5], "code")],
                ["id", "held_out", "n_tokens", "known", "logs", "score", "rare", "grams"],
            )

    kind = f"id {rows.schema['id'].dataType.simpleString()}, held_out boolean, n_tokens long, known long, logs double, score double, rare array<struct<word: bigint, times: int>>, grams array<struct<code: bigint, times: int>>"
    # The checkpoint fixes the keys.
    found = cut(rows.select("id", "text", "held").mapInArrow(score, kind).withColumn("key", F.monotonically_increasing_id()))
    rare = found.select("key", F.explode("rare").alias("r")).select("key", "r.word", "r.times").join(counts.where(F.col("n") < least), "word", "left")
    n = F.coalesce("n", F.lit(0))
    rare = rare.groupBy("key").agg(F.sum(F.col("times") * F.log10(n + 0.1)).alias("more"), F.sum(F.when(n > 0, F.col("times")).otherwise(0)).alias("met"))
    out = found.drop("rare", "grams").join(rare, "key", "left")
    if dealt:
        rest = found.select("key", F.explode("grams").alias("r")).select("key", "r.code", "r.times").join(scores.where(F.col("n") < often).select("code", F.col("score").alias("bits")), "code")
        rest = rest.groupBy("key").agg(F.sum(F.col("times") * F.col("bits")).alias("rest"))
        out = out.join(rest, "key", "left").withColumn("score", F.col("score") + F.coalesce("rest", F.lit(0.0)))
    base = F.col("logs") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * F.lit(down)
    return out.select(F.col("id").alias(id_col), "held_out", "n_tokens", (F.col("known") + F.coalesce("met", F.lit(0))).alias("n_known"), F.lit(big_n).cast("long").alias("train_tokens"), base.alias("base_score"), "score")
