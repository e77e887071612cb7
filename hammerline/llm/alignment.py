"""Alignment of two tokenizers' tokens over the same bytes, and how often their ids meet in the corpus.

The tokens of both are intervals of bytes.  Sorted by their starts, with the
running maximum of their ends, they fall into groups where a start reaches
that maximum; within a group the overlapping pairs are expanded.  Neither
tokenizer joins anything over a space that follows other than white space, so
a text is a row of chunks, and a worker aligns each distinct chunk once.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from hammerline.llm import _text as X
from hammerline.llm._spark import cut, small_batches
from hammerline.llm.pieces import task_table

#: Chunks of more bytes are aligned where they stand and not kept.
LONGEST = 256

#: Pairs of ids that are broadcast; rarer ones are joined.
BROADCAST_PAIRS = 2_000_000

#: Distinct pairs that a task counts before it hands them on.
PAIRS_IN_TASK = 1_000_000

#: The size class of a pair's count: 16 of them to each doubling, so that there are about a thousand.
_SIZE = "cast(floor(16 * log2(n)) AS int)"

#: Fields before each chunk's links: whether both sides give its bytes, tokens of A and B, groups, links, bytes of the groups' text.
HEAD = 6


class Pool:
    """Byte strings by number, as one array."""

    def __init__(self, strings: list[bytes]):
        self.size = np.array([len(x) for x in strings], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(strings), np.uint8)

    def of(self, ids: np.ndarray) -> np.ndarray:
        return self.data[X.spread(self.start[ids], self.size[ids])]


def byte_level_alphabet() -> dict[str, int]:
    """The byte of each character of a byte-level vocabulary: printable bytes stand for themselves, the others follow from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {chr(b): b for b in printable}
    rest = (b for b in range(256) if chr(b) not in out)
    return out | {chr(0x100 + k): b for k, b in enumerate(rest)}


def _piece_bytes(sp, i: int) -> bytes:
    piece = sp.id_to_piece(i)
    return bytes([int(piece[1:-1], 16)]) if sp.is_byte(i) else piece.replace("▁", " ").encode()


def coalesce(a_start: np.ndarray, a_end: np.ndarray, b_start: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of two rows of intervals: the group of each A and of each B, and the pairs (index in A, index in B) that overlap."""
    start, end = np.concatenate([a_start, b_start]), np.concatenate([a_end, b_end])
    order = np.lexsort((np.arange(len(start)) >= len(a_start), start))
    reach = np.maximum.accumulate(end[order])
    first = np.ones(len(order), bool)
    first[1:] = start[order][1:] >= reach[:-1]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(first) - 1
    # B's intervals follow one another, so those that overlap an interval of A are a range.
    low, high = np.searchsorted(b_end, a_start, side="right"), np.searchsorted(b_start, a_end, side="left")
    return group[: len(a_start)], group[len(a_start) :], np.repeat(np.arange(len(a_start)), high - low), X.spread(low, high - low)


class Aligner:
    """Both tokenizers, with the bytes of their tokens."""

    def __init__(self, a_vocabulary: str, b_model: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # one task, one core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_vocabulary)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_model)
        alphabet = byte_level_alphabet()
        names = {i: x for x, i in self.a.get_vocab(with_added_tokens=True).items()}
        self.a_bytes = Pool([bytes(alphabet[c] for c in x) if all(c in alphabet for c in x) else x.encode() for x in (names.get(i, "") for i in range(max(names) + 1))])
        self.b_bytes = Pool([_piece_bytes(self.b, i) for i in range(self.b.get_piece_size())])
        most = max(len(self.a_bytes.size), len(self.b_bytes.size))
        if most > 1 << 16:
            raise ValueError("ids of more than 16 bits")
        if any("▁" in self.b.id_to_piece(i).lstrip("▁") for i in range(self.b.get_piece_size())):
            raise ValueError("a piece holds the whitespace marker behind another character")
        self.lone = [self.b.piece_to_id("▁")]
        self.digits = Pool([str(i).encode() for i in range(most)])

    def _ids(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        texts = [x.decode() for x in chunks]
        a = [x.ids for x in self.a.encode_batch_fast(texts, add_special_tokens=False)]
        # B puts a space of its own before what it is given; nothing at all is then one space.
        b = [x or self.lone for x in self.b.encode([x[1:] for x in texts], num_threads=1)]
        flat = lambda rows: (np.fromiter((i for x in rows for i in x), np.int64), np.array([len(x) for x in rows], np.int64))
        return *flat(a), *flat(b)

    @staticmethod
    def _gives(data: np.ndarray, size: np.ndarray, pool: Pool, ids: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Of each chunk, whether the tokens' bytes are the chunk's."""
        of = np.repeat(np.arange(len(n)), n)
        made = np.bincount(of, pool.size[ids], minlength=len(n)).astype(np.int64)
        same = made == size
        own = pool.of(ids[same[of]])
        inside = np.repeat(same, size)
        chunk = np.repeat(np.arange(len(n)), size)[inside]
        same[chunk[own != data[inside]]] = False
        return same

    def align(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Of each chunk, which begins with a space: its fields, links and groups' text as 32-bit numbers; all of them, and the number of each."""
        a, n_a, b, n_b = self._ids(chunks)
        data, size = np.frombuffer(b"".join(chunks), np.uint8), np.array([len(x) for x in chunks], np.int64)
        good = self._gives(data, size, self.a_bytes, a, n_a) & self._gives(data, size, self.b_bytes, b, n_b)
        a, b = a[np.repeat(good, n_a)], b[np.repeat(good, n_b)]
        n_a, n_b = np.where(good, n_a, 0), np.where(good, n_b, 0)
        of_a, of_b = np.repeat(np.arange(len(good)), n_a), np.repeat(np.arange(len(good)), n_b)
        # The chunks' tokens follow one another without gaps, on both sides over the same bytes.
        a_end, b_end = np.cumsum(self.a_bytes.size[a]), np.cumsum(self.b_bytes.size[b])
        group_a, group_b, left, right = coalesce(a_end - self.a_bytes.size[a], a_end, b_end - self.b_bytes.size[b], b_end)
        links, of_link = (a[left] << 16) | b[right], of_a[left]

        ids, group, side, of = np.concatenate([a, b]), np.concatenate([group_a, group_b]), np.repeat([0, 1], [len(a), len(b)]), np.concatenate([of_a, of_b])
        order = np.lexsort((side, group))  # stable: tokens of one side stay in order
        ids, group, side, of = ids[order], group[order], side[order], of[order]
        width = self.digits.size[ids] + 1
        stop = np.cumsum(width)
        text = np.empty(int(stop[-1]) if len(stop) else 0, np.uint8)
        text[X.spread(stop - width, width - 1)] = self.digits.of(ids)
        if len(stop):
            last = np.append(group[1:] != group[:-1], True)
            turns = np.append(side[1:] != side[:-1], True)
            text[stop - 1] = np.where(last, ord(";"), np.where(turns, ord("|"), ord(",")))
        count = lambda of, w=None: np.bincount(of, w, minlength=len(good)).astype(np.int64)
        n_links, n_text = count(of_link), count(of, width)
        n_groups = count(of[np.append(True, group[1:] != group[:-1])] if len(group) else of)

        words = (n_text + 3) // 4
        total = HEAD + n_links + words
        begin = np.cumsum(total) - total
        out = np.zeros(int(total.sum()), np.uint32)
        for k, x in enumerate((good, n_a, n_b, n_groups, n_links, n_text)):
            out[begin + k] = x
        out[X.spread(begin + HEAD, n_links)] = links
        out.view(np.uint8)[X.spread(4 * (begin + HEAD + n_links), n_text)] = text
        return out, total


_aligners: dict[tuple[str, str], Aligner] = {}


def _aligner(*files: str) -> Aligner:
    if files not in _aligners:
        _aligners[files] = Aligner(*files)
    return _aligners[files]


def _spaced(t: X.Texts) -> X.Texts:
    """The texts with a space before each."""
    return X.Texts(np.insert(t.data, t.offsets[:-1], 32), t.offsets + np.arange(t.n + 1), t.first)


def _borders(d: np.ndarray) -> np.ndarray:
    """Where a chunk may begin: at a space behind what is surely not white space.

    Bytes up to 0x20 may be white space, U+0085 and U+00A0 are, and all other
    white space has three bytes of which the first is E1, E2 or E3.
    """
    out = d == 32
    out[1:] &= d[:-1] > 32
    out[2:] &= ~((d[:-2] == 0xC2) & ((d[1:-1] == 0x85) | (d[1:-1] == 0xA0)))
    out[3:] &= ~((d[:-3] >= 0xE1) & (d[:-3] <= 0xE3))
    return out


#: B reads these characters as others, so texts with them are aligned as one chunk.
_RARE = ("▁", "\0", "�")


def _aligned(t: X.Texts, own: Aligner, table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers as of Aligner.align for the chunks of the texts (each with its space); where each chunk's begin, and its text."""
    begin = _borders(t.data)
    raw = t.data.tobytes()
    for mark in _RARE:
        at = raw.find(m := mark.encode())
        while at >= 0:
            i = int(t.text_of(np.array([at]))[0])
            begin[t.offsets[i] : t.offsets[i + 1]] = False
            at = raw.find(m, int(t.offsets[i + 1]))
    begin[t.offsets[:-1]] = True
    s = np.flatnonzero(begin)
    e = np.append(s[1:], len(t.data))
    bytes_of = lambda i: raw[s[i] : e[i]]
    short = e - s <= LONGEST
    flat, start = np.empty(0, np.uint32), np.empty(len(s), np.int64)
    for some, get in ((short, lambda i: table.lookup(t, s[i], e[i], lambda new: own.align([bytes_of(k) for k in i[new]]))[:2]), (~short, lambda i: own.align([bytes_of(k) for k in i]))):
        if some.any():
            more, size = get(np.flatnonzero(some))
            start[some] = len(flat) + np.cumsum(size) - size
            flat = np.concatenate([flat, more])
    return flat, start, t.text_of(s)


def _sum_pairs(batches):
    """Links of all texts of a task, summed by pair; handed on before they are too many."""
    codes, counts = np.empty(0, np.uint64), np.empty(0, np.int64)
    waiting: list[list[np.ndarray]] = []

    def merged():
        keys, back = np.unique(np.concatenate([codes, *(x[0] for x in waiting)]), return_inverse=True)
        return keys, np.bincount(back, np.concatenate([counts, *(x[1] for x in waiting)]), minlength=len(keys)).astype(np.int64)

    rows = lambda: pa.RecordBatch.from_arrays([pa.array(codes.astype(np.int64)), pa.array(counts)], ["code", "n"])
    held = 0
    for batch in batches:
        for x in batch.column(0):
            waiting.append(X.unsqueezed(x.as_py(), (np.uint64, np.int64)))
            held += len(waiting[-1][0])
            if held > PAIRS_IN_TASK:
                codes, counts = merged()
                waiting.clear()
                held = 0
                if len(codes) > PAIRS_IN_TASK:
                    yield rows()
                    codes, counts = codes[:0], counts[:0]
    if waiting:
        codes, counts = merged()
    if len(codes):
        yield rows()


def aligned_texts(docs: DataFrame, a_vocabulary: str, b_model: str, text: str = "text", id_col: str = "doc_id", groups: Callable[[bytes], str] = bytes.decode) -> DataFrame:
    """One row per input row: (id, n_a, n_b, n_groups, n_links, groups, links).

    `groups` makes the column of that name of `a1,a2|b1;a3|b2,b3`; a text without
    tokens has ''.  `links` holds the distinct pairs a << 16 | b and their
    numbers, packed.  A null or empty text has no tokens, nor has one whose
    tokens' bytes, A's or B's, are not the space and the text.  Ids may be null
    or repeat; only the two named columns are read; an empty table gives an
    empty result.
    """

    def run(batches):
        own, table = _aligner(a_vocabulary, b_model), task_table(("aligned", a_vocabulary, b_model))
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for t in X.texts(batch.column(1)):
                filled, t = t.lengths > 0, _spaced(t)
                flat, start, of = _aligned(t, own, table)
                field = lambda k: flat[start + k].astype(np.int64)  # noqa: B023, E731
                some = filled & (np.bincount(of, 1 - field(0), minlength=t.n) == 0)
                n_links, n_text = field(4), field(5)
                total = lambda x: np.where(some, np.bincount(of, x, minlength=t.n), 0).astype(np.int64)  # noqa: B023, E731
                for k in range(4):
                    out[k] += total(field(k + 1)).tolist()
                size = np.bincount(of, n_text, minlength=t.n).astype(np.int64)
                stop = np.cumsum(size)
                written = flat.view(np.uint8)[X.spread(4 * (start + HEAD + n_links), n_text)].tobytes()
                pairs = (np.repeat(of, n_links).astype(np.uint64) << np.uint64(32)) | flat[X.spread(start + HEAD, n_links)]
                pairs, times = np.unique(pairs, return_counts=True)
                cuts = np.searchsorted(pairs, np.arange(t.n + 1).astype(np.uint64) << np.uint64(32))
                code = pairs & np.uint64(0xFFFFFFFF)
                for d in range(t.n):
                    out[4].append(groups(written[stop[d] - size[d] : stop[d] - 1]) if some[d] else "")
                    x = slice(cuts[d], cuts[d + 1] if some[d] else cuts[d])
                    out[5].append(X.squeezed(code[x], times[x].astype(np.int64)))
            kinds = [pa.int64()] * 4 + [pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, out, kinds)], ["id", "n_a", "n_b", "n_groups", "n_links", "groups", "links"])

    rows = small_batches(docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, n_a long, n_b long, n_groups long, n_links long, groups string, links binary").withColumnRenamed("id", id_col)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(code, n, best): how many links of the corpus hold each pair of ids, and whether its B id is linked with no other more often."""
    counts = cut(aligned.select("links").mapInArrow(_sum_pairs, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")))
    b_id = F.col("code").bitwiseAND(0xFFFF).alias("b")
    # B's ids have at most 16 bits, so there are at most 65,536 rows of these.
    most = counts.groupBy(b_id).agg(F.max("n").alias("most"))
    return cut(counts.withColumn("b", b_id).join(F.broadcast(most), "b").select("code", "n", (F.col("n") == F.col("most")).alias("best")))


def _top_pairs(pairs: DataFrame, limit: int) -> tuple[int | None, np.ndarray, np.ndarray]:
    """The most frequent pairs, at most `limit`: the least size class among them (none: all pairs), their codes in order, and 2 n + best."""
    sizes = pairs.groupBy(F.expr(_SIZE).alias("size")).agg(F.count(F.lit(1)).alias("k")).orderBy(F.desc("size")).collect()
    held = np.cumsum([r["k"] for r in sizes])
    fits = int((held <= limit).sum())
    least = sizes[fits - 1]["size"] if 0 < fits < len(sizes) else (1 << 20 if sizes and not fits else None)
    got = (pairs if least is None else pairs.where(F.expr(_SIZE) >= least)).select("code", F.expr("2 * n + cast(best AS long)").alias("value")).toArrow()
    codes = got.column("code").to_numpy().astype(np.uint64)
    order = np.argsort(codes)
    return least, codes[order], got.column("value").to_numpy()[order]


def linked_counts(aligned: DataFrame, limit: int | None = None) -> DataFrame:
    """The rows of `aligned` with n_best and count_sum in place of `links`.

    The most frequent pairs, at most `limit` (BROADCAST_PAIRS), are broadcast;
    where there are more, the others are joined, and of those none has more than
    one in `limit` of all links.
    """
    limit = BROADCAST_PAIRS if limit is None else limit
    spark, columns = aligned.sparkSession, [c for c in aligned.columns if c != "links"]
    aligned = cut(aligned.withColumn("_row", F.monotonically_increasing_id()))
    pairs = pair_counts(aligned)
    least, codes, values = _top_pairs(pairs, limit)
    shared = spark.sparkContext.broadcast((codes, values))

    def score(batches):
        codes, values = shared.value
        for batch in batches:
            best, total, rest = [], [], []
            for x in batch.column("links"):
                code, k = X.unsqueezed(x.as_py(), (np.uint64, np.int64))
                at = np.minimum(np.searchsorted(codes, code), max(len(codes) - 1, 0))
                known = codes[at] == code if len(codes) else np.zeros(len(code), bool)
                value = values[at[known]]
                best.append(int(k[known][value & 1 == 1].sum()))
                total.append(int((k[known] * (value >> 1)).sum()))
                rest.append([{"code": int(c), "k": int(n)} for c, n in zip(code[~known], k[~known], strict=True)])
            arrays = [*(batch.column(c) for c in (*columns, "_row")), pa.array(best, pa.int64()), pa.array(total, pa.int64()), pa.array(rest, pa.list_(pa.struct([("code", pa.int64()), ("k", pa.int64())])))]
            yield pa.RecordBatch.from_arrays(arrays, [*columns, "_row", "n_best", "count_sum", "_rest"])

    kinds = ", ".join(f"`{c}` {aligned.schema[c].dataType.simpleString()}" for c in (*columns, "_row"))
    scored = aligned.mapInArrow(score, f"{kinds}, n_best long, count_sum long, _rest array<struct<code:long,k:long>>")
    if least is None:
        return scored.drop("_row", "_rest")
    rare, scored = pairs.where(F.expr(_SIZE) < least), cut(scored)
    met = scored.select("_row", F.explode("_rest").alias("x")).select("_row", "x.code", "x.k").join(rare, "code")
    more = met.groupBy("_row").agg(F.sum(F.when(F.col("best"), F.col("k")).otherwise(0)).alias("_best"), F.sum(F.col("k") * F.col("n")).alias("_sum"))
    plus = lambda a, b: (F.col(a) + F.coalesce(b, F.lit(0))).cast("long").alias(a)
    return scored.join(more, "_row", "left").select(*columns, plus("n_best", "_best"), plus("count_sum", "_sum"))


def sha256_or_empty(x: bytes) -> str:
    """A digest in place of the groups' text."""
    return hashlib.sha256(x).hexdigest()
