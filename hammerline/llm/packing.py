"""Best-fit packing of tokenised documents with certified bin counts.

Documents are tokenised where they lie; from then on only lengths move.  Pieces
are dealt to partitions of bounded size and packed by best-fit decreasing.
Dual feasible functions of the lengths give a lower bound on the bins each
partition needs; a partition that meets it is certified and stays.  The others
give up the documents of their unfilled bins, which are dealt anew and packed
again as long as that saves bins.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from hammerline.llm import _text as X
from hammerline.llm._spark import cut
from hammerline.llm.pieces import word_bpe_ids

CAPACITY, END_ID = 4096, 1
#: Pieces of a partition; rounds of exchange at most.
PARTITION_PIECES, ROUNDS = 60_000, 4


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """The bins that items with these counts by length (index 0..capacity) need at least, by dual feasible functions."""
    x = np.arange(len(counts))
    best = -(-int((counts * x).sum()) // capacity)
    # Large items count whole, small ones not at all: the rest cannot share more space than there is.
    from_top = np.concatenate([np.cumsum(counts[::-1])[::-1], [0]])
    mass = np.concatenate([[0], np.cumsum(counts * x)])
    for cut_at in range(1, capacity // 2 + 1):
        large = int(from_top[capacity - cut_at + 1])
        middle = int(mass[capacity - cut_at + 1] - mass[cut_at])
        best = max(best, large - (-middle // capacity))
    # Rounding down to multiples of 1/k, where exact multiples of 1/(k+1) keep their size.
    for k in range(1, 40):
        scaled = (k + 1) * x
        whole = scaled % capacity == 0
        value = np.where(whole, x * k, (scaled // capacity) * capacity)
        best = max(best, -(-int((counts * value).sum()) // (capacity * k)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each item and the number of bins; an item goes where it leaves the least room."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rooms, used = 0, 0
    for i, size in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fit = open_rooms >> size
        if fit:
            room = size + (fit & -fit).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                open_rooms ^= 1 << room
        else:
            room, b, used = capacity, used, used + 1
        bins[i], offsets[i] = b, capacity - room
        rest = room - size
        if rest:
            if not rooms[rest]:
                open_rooms |= 1 << rest
            rooms[rest].append(b)
    return bins, offsets, used


def token_pieces(docs: DataFrame, vocabulary: str, text: str = "text", id_col: str = "doc_id", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(id, piece, start, length, ids_crc32, key) for each piece; key tells rows with equal ids apart."""

    def tokenise(batches):
        encode = word_bpe_ids(vocabulary)
        for batch in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for t in X.texts(batch.column(1)):
                flat, n = encode(t)
                stop = np.cumsum(n)
                for d in range(t.n):
                    ids = np.append(flat[stop[d] - n[d] : stop[d]], np.uint32(end_id)).astype("<u4")
                    for k, a in enumerate(range(0, len(ids), capacity)):
                        own = ids[a : a + capacity]
                        row.append(t.first + d)
                        piece.append(k)
                        start.append(a)
                        length.append(len(own))
                        crc.append(zlib.crc32(own.tobytes()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                ["id", "piece", "start", "length", "ids_crc32"],
            )

    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    kind = f"id {rows.schema['id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long"
    # Fixed with the checkpoint, so that a lost executor does not number pieces anew.
    return cut(rows.mapInArrow(tokenise, kind).withColumn("key", F.monotonically_increasing_id()))


_PACKED = "key long, length long, seq long, offset long, fill long, gap boolean"


def _pack(items: DataFrame, seed: int, capacity: int) -> DataFrame:
    """(key, length, seq, offset, fill, gap) of items (key, length), dealt to partitions and packed there."""
    parts = max(1, -(-items.count() // PARTITION_PIECES))

    def pack(key, table):
        lengths = table.column("length").to_numpy()
        order = np.argsort(table.column("key").to_numpy(), kind="stable")
        table, lengths = table.take(pa.array(order)), lengths[order]
        bins, offsets, used = best_fit_decreasing(lengths, capacity)
        gap = used > lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
        fill = np.bincount(bins, lengths, minlength=used).astype(np.int64)[bins]
        seq = (np.int64(seed) << np.int64(56)) + (np.int64(key[0].as_py()) << np.int64(28)) + bins
        return pa.table({"key": table.column("key"), "length": table.column("length"), "seq": pa.array(seq), "offset": pa.array(offsets), "fill": pa.array(fill), "gap": pa.array(np.full(len(bins), gap))})

    dealt = items.select("key", "length", F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(parts)).alias("p"))
    return cut(dealt.groupBy("p").applyInArrow(pack, _PACKED))


def _bins(packed: DataFrame) -> int:
    return packed.where("offset = 0").count()


def pack_documents(docs: DataFrame, vocabulary: str, text: str = "text", id_col: str = "doc_id", capacity: int = CAPACITY, end_id: int = END_ID, rounds: int = ROUNDS) -> DataFrame:
    """One row per piece: (id, piece, start, length, ids_crc32, sequence_id, offset).

    A document is its ids and the end id; a null text has the end id alone.  Only
    documents longer than the capacity are cut.  Ids may be null or repeat: each
    row is packed by itself.  Only the two named columns are read; an empty
    table gives an empty result.
    """
    pieces = token_pieces(docs, vocabulary, text, id_col, capacity, end_id)
    packed = _pack(pieces.select("key", "length"), 0, capacity)
    done = packed.where("not gap or fill = %d" % capacity)
    loose = packed.where("gap and fill < %d" % capacity)
    before = _bins(loose)
    for seed in range(1, rounds + 1):
        if before < 2:
            break
        again = _pack(loose.select("key", "length"), seed, capacity)
        after = _bins(again)
        if after >= before:
            break
        done = done.unionByName(again.where("not gap or fill = %d" % capacity))
        loose = again.where("gap and fill < %d" % capacity)
        before = _bins(loose)
    packed = done.unionByName(loose).select("key", F.col("seq").alias("sequence_id"), "offset")
    out = pieces.join(packed, "key").withColumnRenamed("id", id_col)
    return out.select(id_col, "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
