"""Removal of byte strings that already occur in an earlier document.

A byte goes if a `length`-byte string that covers it also starts in a document
with a smaller id.  Suffix arrays of shards find those strings; shards are
made so that equal strings always meet in one shard, so no merge across
shards is needed:

Every `length`-byte string has one anchor, its least-hashed CORE-byte substring
(leftmost on ties), which depends on the string alone.  Consecutive strings
with the same anchor form a piece of text, and pieces are dealt out by anchor.
Every string lies in exactly one piece.

  1. Anchors seen in one document only are told apart with a bit filter of
     fixed size (false hits cost work, not results).
  2. Equal pieces collapse to one with the smallest id that has it: a document
     with a larger id loses the whole piece.
  3. Anchors that hold different pieces are dealt to shards.  A shard's pieces
     are joined to one text, whose suffixes are sorted by external induced
     sorting (`induced`); neighbouring suffixes with `length` common bytes
     form classes, and the class's smallest id decides.
  4. Anchors with very many different pieces need no suffix array: their pieces
     are cut to single strings and grouped, which spreads them over all tasks.

The removed ranges of a document are joined back to its text.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from hammerline.llm import _text as X
from hammerline.llm._spark import cut, release, small_batches
from hammerline.llm.induced import neighbours_share, suffix_array

CORE = 28
#: 2**FILTER_BITS bits are broadcast, whatever the size of the input.
FILTER_BITS = 27
#: Longer texts are searched in overlapping parts of this many bytes.
PART = 1 << 20
#: Anchors with more different pieces are grouped string by string.
CROWDED = 4096
SHARD_BYTES = 1 << 20
#: Entries that a task gathers before they leave, and entries of a group in which equal anchors meet.
GATHERED, GROUP_ENTRIES = 500_000, 300_000
#: Names of pieces that a task remembers, so that it sends their bytes once.
REMEMBERED = 200_000
#: Removed ranges are broadcast up to this many rows; beyond that, texts are shuffled to them.
BROADCAST_ROWS = 300_000
_LAST = (1 << 63) - 1


def _parts(column: pa.Array, length: int) -> Iterator[tuple[X.Texts, int]]:
    for t in X.texts(column):
        if t.n == 1 and len(t.data) > PART:
            for a in range(0, len(t.data) - length + 1, PART):
                d = t.data[a : a + PART + length - 1]
                yield X.Texts(d, np.array([0, len(d)]), t.first), a
        else:
            yield t, 0


def pieces(t: X.Texts, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, start, end and text index of each piece: its strings start at start..end-length."""
    n, empty = len(t.data), np.empty(0, np.int64)
    if n < length:
        return empty.astype(np.uint64), empty, empty, empty
    core = X.byte_windows(t.data, CORE)
    key = (core & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(core), dtype=np.uint64)
    width, span = length - CORE + 1, 1
    low = key
    while span < width:
        step = min(span, width - span)
        low = np.minimum(low[:-step], low[step:])
        span += step
    at = (low & np.uint64(0xFFFFFF)).astype(np.int64)
    p = np.arange(len(at))
    inside = p + length <= np.repeat(t.offsets[1:], t.lengths)[: len(at)]
    change = np.ones(len(at) + 1, bool)
    change[1:-1] = (at[1:] != at[:-1]) | (inside[1:] != inside[:-1])
    bounds = np.flatnonzero(change)
    start, stop = bounds[:-1], bounds[1:]
    keep = inside[start]
    start, stop = start[keep], stop[keep]
    # Least hashes are small numbers; mixed once more they spread evenly over groups and filters.
    return X.mix(core[at[start]]), start, stop - 1 + length, t.text_of(start)


def _packed(bits: np.ndarray) -> bytes:
    """Few bits of a filter are set in small inputs, and what is collected should be as small."""
    return zlib.compress(np.packbits(bits).tobytes(), 1)


def _bit_filter(anchors: DataFrame, name: str) -> np.ndarray:
    """The values' high bits as a bit set: slices are made in tasks, come packed to the driver and are joined to one array of fixed size."""
    shift = 64 - FILTER_BITS
    slices = 64

    def slice_of(key, table):
        bits = np.zeros(1 << (FILTER_BITS - 6), bool)
        bits[(table.column("bit").to_numpy() & (len(bits) - 1))] = True
        return pa.table({"s": [key[0].as_py()], "bits": pa.array([_packed(bits)], pa.binary())})

    bit = F.shiftrightunsigned(F.col(name), shift)
    rows = anchors.select(bit.alias("bit")).distinct().withColumn("s", F.shiftrightunsigned("bit", FILTER_BITS - 6).cast("int"))
    out = np.zeros((slices, 1 << (FILTER_BITS - 9)), np.uint8)
    for row in rows.groupBy("s").applyInArrow(slice_of, "s long, bits binary").collect():
        out[row["s"]] = np.frombuffer(zlib.decompress(row["bits"]), np.uint8)
    return out.ravel()


def _hit(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    b = values >> np.uint64(64 - FILTER_BITS)
    return (bits[(b >> np.uint64(3)).astype(np.int64)] >> (np.uint8(7) - (b & np.uint64(7)).astype(np.uint8))) & 1 > 0


def _groups(docs: DataFrame, length: int) -> int:
    """So many groups that each has about GROUP_ENTRIES pieces: there is one for about every length / 4 bytes."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(1, -(-4 * size // (length * GROUP_ENTRIES)))


def _shared_anchors(docs: DataFrame, length: int, parts: int) -> np.ndarray:
    """A bit filter of the anchors that occur in two or more rows."""

    def blobs(batches):
        held: list[np.ndarray] = []
        twice: list[np.ndarray] = []

        def out():
            # 40 bits of an anchor are enough to find most that occur once; the lowest of 41 says that it is in several rows here.
            v = np.sort(np.concatenate(held) >> np.uint64(24))
            new = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
            multi = np.diff(np.append(new, len(v))) > 1
            u = (v[new] << np.uint64(1)) | multi.astype(np.uint64)
            part = (u >> np.uint64(1)) * np.uint64(parts) >> np.uint64(40)
            cuts = np.searchsorted(part, np.arange(parts + 1))
            p = [k for k in range(parts) if cuts[k + 1] > cuts[k]]
            return pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array([X.squeezed(u[cuts[k] : cuts[k + 1]]) for k in p], pa.binary())], ["p", "blob"])

        n = 0
        for batch in batches:
            for t, _ in _parts(batch.column(0), length):
                anchor, _, _, of = pieces(t, length)
                if len(anchor):
                    # One entry per row and anchor, so that repeats within a row do not count.
                    o = np.lexsort((anchor, of))
                    a, f = anchor[o], of[o]
                    a = a[np.concatenate([[True], (a[1:] != a[:-1]) | (f[1:] != f[:-1])])]
                    held.append(a)
                    n += len(a)
            if n > GATHERED:
                yield out()
                held, n = [], 0
        if held:
            yield out()

    def meet(table: pa.Table) -> pa.Table:
        v = np.sort(np.concatenate([X.unsqueezed(x.as_py())[0] for x in table.column("blob")]))
        whole = v >> np.uint64(1)
        found = np.concatenate([whole[1:][whole[1:] == whole[:-1]], whole[v & np.uint64(1) > 0]])
        return pa.table({"a": (np.unique(found) << np.uint64(24)).view(np.int64)})

    return _bit_filter(docs.select("text").mapInArrow(blobs, "p int, blob binary").groupBy("p").applyInArrow(meet, "a long"), "a")


def _found(docs: DataFrame, length: int):
    """For each batch of (rid, row, text) its parts and their pieces: t, base, rids, rows, anchor, piece, start, end, text index."""

    def each(batches):
        for batch in batches:
            rid, row = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for t, base in _parts(batch.column(2), length):
                anchor, start, end, of = pieces(t, length)
                yield t, base, rid[of + t.first], row[of + t.first], anchor, X.mix(t.hashes(start, end) ^ anchor), start, end, of

    return each


def _merged_kinds(anchor, piece, lo, hi) -> tuple[np.ndarray, ...]:
    """One entry per anchor and piece, in that order, with the smallest lo and the largest hi."""
    o = np.lexsort((piece, anchor))
    anchor, piece, lo, hi = anchor[o], piece[o], lo[o], hi[o]
    head = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (piece[1:] != piece[:-1])])) if len(o) else np.empty(0, np.int64)
    return (anchor[head], piece[head], np.minimum.reduceat(lo, head), np.maximum.reduceat(hi, head)) if len(head) else (anchor, piece, lo, hi)


def _piece_kinds(docs: DataFrame, length: int, bits, parts: int) -> DataFrame:
    """(anchor, piece, lo, n): pieces of shared anchors, their smallest id, and the anchor's number of pieces, negative for a piece of one id.

    Pieces are merged in the task and dealt by anchor, so that all pieces of an
    anchor meet after one shuffle, packed as compressed columns; an anchor has
    one entry for each task and different piece, however often it occurs.
    """
    each = _found(docs, length)

    def rows(batches):
        held: list = []
        n = 0

        def out():
            cols = _merged_kinds(*(np.concatenate(c) for c in zip(*held, strict=True)))
            held.clear()
            part = ((cols[0] >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
            cuts = np.searchsorted(part, np.arange(parts + 1))
            p = [k for k in range(parts) if cuts[k + 1] > cuts[k]]
            anchor, piece, lo, hi = cols
            blobs = [X.squeezed(anchor[b], piece[b], lo[b], hi[b] - lo[b]) for b in (slice(cuts[k], cuts[k + 1]) for k in p)]
            return pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(blobs, pa.binary())], ["p", "blob"])

        for _, _, rid, _, anchor, piece, _, _, _ in each(batches):
            ok = _hit(bits.value, anchor)
            held.append((anchor[ok], piece[ok], rid[ok], rid[ok]))
            n += int(ok.sum())
            if n > GATHERED:
                yield out()
                n = 0
        if held:
            yield out()

    def meet(table: pa.Table) -> pa.Table:
        cols = [X.unsqueezed(x.as_py(), (np.uint64, np.uint64, np.int64, np.int64)) for x in table.column("blob")]
        anchor, piece, lo, wide = (np.concatenate(c) for c in zip(*cols, strict=True))
        anchor, piece, lo, hi = _merged_kinds(anchor, piece, lo, lo + wide)
        head = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        n = np.diff(np.append(head, len(anchor)))
        shared = np.repeat(np.minimum.reduceat(lo, head) < np.maximum.reduceat(hi, head), n)
        n = np.repeat(n, n) * np.where(lo < hi, 1, -1)
        return pa.table({"blob": pa.array([X.squeezed(anchor[shared], piece[shared], lo[shared], n[shared])], pa.binary())})

    def unpacked(batches):
        for batch in batches:
            for x in batch.column(0):
                cols = X.unsqueezed(x.as_py(), (np.int64,) * 4)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["anchor", "piece", "lo", "n"])

    made = docs.select("rid", "row", "text").mapInArrow(rows, "p int, blob binary")
    # The groups are kept packed: they take less than half the space that rows would.
    return cut(made.groupBy("p").applyInArrow(meet, "blob binary")).mapInArrow(unpacked, "anchor long, piece long, lo long, n long")


def _piece_bytes(docs: DataFrame, length: int, bits) -> DataFrame:
    """(anchor, piece, bytes) of the pieces whose anchor passes the filter; a piece comes once from each task that holds it."""
    each = _found(docs, length)

    def rows(batches):
        seen: set[int] = set()
        for t, _, _, _, anchor, piece, start, end, _ in each(batches):
            ok = np.flatnonzero(_hit(bits.value, anchor))
            ok = ok[[not (p in seen or seen.add(p)) for p in piece[ok].tolist()]] if len(ok) else ok
            if len(seen) > REMEMBERED:
                seen.clear()
            blobs = [t.data[a:b].tobytes() for a, b in zip(start[ok].tolist(), end[ok].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(anchor[ok].view(np.int64)), pa.array(piece[ok].view(np.int64)), pa.array(blobs, pa.binary())], ["anchor", "piece", "bytes"])

    return docs.select("rid", "row", "text").mapInArrow(rows, "anchor long, piece long, bytes binary")


def _piece_places(docs: DataFrame, length: int, bits) -> DataFrame:
    """(high, piece, rid, row, at) of the pieces that pass the filter; high has the anchor's upper half, at holds the start in the row and, in the low 16 bits, the length."""
    each = _found(docs, length)

    def rows(batches):
        for t, base, rid, row, anchor, piece, start, end, of in each(batches):
            ok = _hit(bits.value, piece)
            at = ((start - t.offsets[of] + base) << 16) | (end - start)
            cols = ((anchor[ok].view(np.int64) >> 32).astype(np.int32), piece[ok].view(np.int64), rid[ok], row[ok], at[ok])
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["high", "piece", "rid", "row", "at"])

    return docs.select("rid", "row", "text").mapInArrow(rows, "high int, piece long, rid long, row long, at long")


def _shard_runs(known: pa.Table, told: pa.Table, length: int) -> pa.Table:
    """For each piece of a shard the ranges whose strings occur in a piece with a smaller id.

    known: (anchor, piece, lo); told: (piece2, bytes), where a piece may come several times.
    """
    none = pa.table({"anchor": pa.array([], pa.int64()), "piece": pa.array([], pa.int64()), "run": pa.array([], pa.int32())})
    if not known.num_rows or not told.num_rows:
        return none
    key, first = np.unique(told.column("piece2").to_numpy(), return_index=True)
    told = told.take(pa.array(first))
    o = np.argsort(known.column("piece").to_numpy())
    known = known.take(pa.array(o))
    at = np.searchsorted(known.column("piece").to_numpy(), key)
    at[at == known.num_rows] = 0
    both = known.column("piece").to_numpy()[at] == key
    told, piece, lo, anchor = told.filter(pa.array(both)), key[both], *(known.column(c).to_numpy()[at[both]] for c in ("lo", "anchor"))
    if not len(piece):
        return none
    blobs = [x.as_buffer() for x in told.column("bytes")]
    size = np.array([len(b) for b in blobs])
    head = np.cumsum(size + 1) - (size + 1)
    data = np.frombuffer(b"\0".join(blobs) + b"\0", np.uint8)
    text = data.astype(np.int64) + 1
    text[head + size] = 0
    order = suffix_array(text, inductions=1)
    of = np.repeat(np.arange(len(blobs)), size + 1)[order]
    whole = order + length <= (head + size)[of]
    order, of = order[whole], of[whole]
    first = np.flatnonzero(~neighbours_share(data, order, length))
    least = np.repeat(np.minimum.reduceat(lo[of], first), np.diff(np.append(first, len(order))))
    gone = least < lo[of]
    order, of = order[gone], of[gone]
    o = np.argsort(order)
    starts, ends, of = _runs(order[o], order[o] + length, of[o])
    return pa.table({"anchor": anchor[of], "piece": piece[of], "run": pa.array((((starts - head[of]) << 16) | (ends - starts)).astype(np.int32))})


def _runs(a: np.ndarray, b: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union of ranges, sorted by start, that belong to increasing owners."""
    if not len(a):
        return a, b, of
    # An owner's ranges reach no further than its own end, which a running maximum over all owners would.
    owner = np.cumsum(np.concatenate([[0], (of[1:] != of[:-1]).astype(np.int64)]))
    span = int(b.max()) + 1
    top = np.maximum.accumulate(owner * span + b) - owner * span
    new = np.concatenate([[True], (a[1:] > top[:-1]) | (of[1:] != of[:-1])])
    head = np.flatnonzero(new)
    return a[head], np.maximum.reduceat(b, head), of[head]


def _crowded_runs(many: DataFrame, told: DataFrame, length: int) -> DataFrame:
    """(anchor, piece, run) of pieces of crowded anchors, string by string."""
    single = told.join(many, ["anchor", "piece"]).select("anchor", "piece", "lo", F.explode(F.sequence(F.lit(0), F.length("bytes") - length)).alias("a"), "bytes")
    single = single.select("anchor", "piece", "lo", "a", F.unhex(F.sha2(F.substring("bytes", F.col("a") + 1, length), 256)).alias("s"))
    least = single.groupBy("anchor", "s").agg(F.min("lo").alias("least"))
    return single.join(least, ["anchor", "s"]).where("least < lo").select("anchor", "piece", F.shiftleft("a", 16).bitwiseOR(F.lit(length)).alias("run")).distinct()


def _row_keys(docs: DataFrame, id_col: str, text: str) -> tuple[Column, Column]:
    """What tells rows apart: the id, a null one as the largest, and, where ids repeat, a hash of the text."""
    rid = F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST))
    again = docs.groupBy(rid.alias("rid")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count()
    return rid, F.xxhash64(F.coalesce(text, F.lit(""))) if again else F.lit(0).cast("long")


def removed_ranges(docs: DataFrame, keys: tuple[Column, Column], length: int = 50, id_col: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """The input as (id, text, rid, row) and the byte ranges to remove as (rid, row, runs)."""
    keyed = small_batches(docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"), keys[0].alias("rid"), keys[1].alias("row")))
    sc = docs.sparkSession.sparkContext
    parts = _groups(keyed, length)
    kinds = _piece_kinds(keyed, length, sc.broadcast(_shared_anchors(keyed, length, parts)), parts)
    release(docs.sparkSession)
    mixed = kinds.where("abs(n) > 1")
    few, many = mixed.where(F.abs("n") <= CROWDED), mixed.where(F.abs("n") > CROWDED)
    # Bytes are fetched only for anchors with different pieces; a shard's number is part of no result.
    told = _piece_bytes(keyed, length, sc.broadcast(_bit_filter(few.select("anchor"), "anchor")))
    shards = max(1, -(-few.count() * 2 * length // SHARD_BYTES))
    shard = F.pmod(F.xxhash64("anchor"), F.lit(shards))
    told = told.select(shard.alias("s2"), F.col("piece").alias("piece2"), "bytes")
    runs = few.select(shard.alias("s"), "anchor", "piece", "lo").groupBy("s").cogroup(told.groupBy("s2")).applyInArrow(lambda a, b: _shard_runs(a, b, length), "anchor long, piece long, run int")
    if many.limit(1).count():
        runs = runs.unionByName(_crowded_runs(many, _piece_bytes(keyed, length, sc.broadcast(_bit_filter(many.select("anchor"), "anchor"))), length))
    release(docs.sparkSession)
    runs = cut(runs.groupBy("anchor", "piece").agg(F.collect_list("run").alias("runs")))
    del told
    release(docs.sparkSession)

    gone = kinds.where("n > 0").select("piece").union(runs.select("piece"))
    places = _piece_places(keyed, length, sc.broadcast(_bit_filter(gone, "piece")))
    # A piece is told by its own hash and half of its anchor's, 96 bits together.
    runs = F.broadcast(runs) if runs.count() <= BROADCAST_ROWS else runs
    fate = mixed.join(runs, ["anchor", "piece"], "left").where("n > 0 or runs is not null").select("anchor", "piece", "lo", "runs")
    alone = kinds.where("n = 1").select("anchor", "piece", "lo", F.lit(None).cast("array<int>").alias("runs"))
    fate = fate.union(alone).withColumn("high", F.shiftright("anchor", 32).cast("int")).drop("anchor")
    gone = places.join(fate, ["high", "piece"])
    part = lambda r: F.shiftleft(F.shiftright("at", 16) + F.shiftright(r, 16), 16).bitwiseOR(r.bitwiseAND(F.lit(65535)).cast("long"))
    gone = gone.select("rid", "row", F.explode(F.when(F.col("rid") > F.col("lo"), F.array("at")).otherwise(F.transform("runs", part))).alias("at"))

    def merged(batches):
        """Ranges come in the order of rows and starts; each row leaves once, with as few ranges as can be."""

        def out(rid, row, at):
            new = np.concatenate([[True], (rid[1:] != rid[:-1]) | (row[1:] != row[:-1])])
            a, b, of = _runs(at >> 16, (at >> 16) + (at & 65535), np.cumsum(new))
            head = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
            pairs = pa.StructArray.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
            lists = pa.ListArray.from_arrays(pa.array(np.append(head, len(of)).astype(np.int32)), pairs)
            return pa.RecordBatch.from_arrays([pa.array(rid[new]), pa.array(row[new]), lists], ["rid", "row", "runs"])

        held = [np.empty(0, np.int64)] * 3
        for batch in batches:
            held = [np.concatenate([x, y.to_numpy()]) for x, y in zip(held, batch.columns, strict=True)]
            rid, row, at = held
            if len(row) and (row[0], rid[0]) != (row[-1], rid[-1]):
                k = int(np.flatnonzero((rid != rid[-1]) | (row != row[-1]))[-1]) + 1  # the last row may go on in the next batch
                yield out(rid[:k], row[:k], at[:k])
                held = [x[k:] for x in held]
        if len(held[0]):
            yield out(*held)

    # Rows that are equal in id and text have the same ranges, so it does not matter that they are merged.
    runs = gone.repartition("rid", "row").sortWithinPartitions("rid", "row", "at").mapInArrow(merged, "rid long, row long, runs array<struct<a: bigint, b: bigint>>")
    return keyed, runs


def _with_ranges(keyed: DataFrame, runs: DataFrame) -> DataFrame:
    runs = cut(runs)
    small = runs.agg(F.sum(F.size("runs"))).first()[0] or 0
    return keyed.join(F.broadcast(runs) if small <= BROADCAST_ROWS * 4 else runs, ["rid", "row"], "left")


def _row_runs(cell) -> tuple[np.ndarray, np.ndarray]:
    if not cell.is_valid:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    v = cell.values
    a, b = v.field("a").to_numpy(), v.field("b").to_numpy()
    o = np.argsort(a, kind="stable")
    a, b, _ = _runs(a[o], b[o], np.zeros(len(o), np.int64))
    return a, b


def _kept(data: bytes, a: np.ndarray, b: np.ndarray) -> bytes:
    return b"".join(data[x:y] for x, y in zip([0, *b.tolist()], [*a.tolist(), len(data)], strict=True))


def repeated_bytes(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: (id, n_bytes, n_removed, n_spans, kept_sha256, spans as [start, end) byte pairs).

    Ids are integers.  A null text is empty.  A null id is larger than any other; equal ids are not
    smaller than each other, so rows that share an id remove nothing from one
    another.  Texts shorter than `length` bytes are kept whole.  Only the two
    named columns are read; an empty table gives an empty result.
    """
    keyed, runs = removed_ranges(docs, _row_keys(docs, id_col, text), length, id_col, text)

    def out(batches):
        for batch in batches:
            n_bytes, n_removed, sha, spans = [], [], [], []
            for t, cell in zip(batch.column("text"), batch.column("runs"), strict=True):
                data = t.as_py().encode("utf-8", "replace")
                a, b = _row_runs(cell)
                n_bytes.append(len(data))
                n_removed.append(int((b - a).sum()))
                sha.append(hashlib.sha256(_kept(data, a, b)).hexdigest())
                spans.append(np.stack([a, b], 1).tolist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array([len(s) for s in spans], pa.int64()), pa.array(sha, pa.string()), pa.array(spans, pa.list_(pa.list_(pa.int64())))],
                ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"],
            )

    kind = keyed.schema["id"].dataType.simpleString()
    rows = _with_ranges(keyed, runs).select("id", "text", "runs")
    found = rows.mapInArrow(out, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<array<long>>")
    return found.withColumnRenamed("id", id_col)


def drop_repeats(docs: DataFrame, length: int = 50) -> DataFrame:
    """The rows of `docs` with repeated strings cut from `text`; a character that loses a byte goes whole. Null texts stay null."""
    keys = _row_keys(docs, "doc_id", "text")
    keyed = docs.withColumns({"_rid": keys[0], "_row": keys[1]})
    _, runs = removed_ranges(docs, keys, length)
    runs = cut(runs.withColumnsRenamed({"rid": "_rid", "row": "_row"}))
    small = runs.agg(F.sum(F.size("runs"))).first()[0] or 0
    joined = keyed.join(F.broadcast(runs) if small <= BROADCAST_ROWS * 4 else runs, ["_rid", "_row"], "left").drop("_rid", "_row")
    names = docs.columns

    def cut_out(batches):
        for batch in batches:
            texts = []
            for t, cell in zip(batch.column("text"), batch.column("runs"), strict=True):
                s = t.as_py()
                if s is not None and cell.is_valid:
                    s = _kept(s.encode("utf-8", "replace"), *_row_runs(cell)).decode("utf-8", "ignore")
                texts.append(s)
            yield batch.select(names).set_column(names.index("text"), "text", pa.array(texts, pa.string()))

    return joined.mapInArrow(cut_out, docs.schema)
