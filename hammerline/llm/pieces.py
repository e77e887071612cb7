"""Whole-text encoding through tables of distinct chunks.

Where no token can cross the border of a chunk, each distinct chunk needs to be
encoded once; a text's ids are its chunks' ids joined by position.  A task
keeps the chunks it has met in one table, as sorted hashes beside flat arrays
of bytes and ids, and starts the table anew when it is full, so memory is
bounded.  A hash only finds an entry: the chunk's bytes are compared with it.
"""

from __future__ import annotations

import os
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from hammerline.llm import _text as X
from hammerline.llm._spark import small_batches

#: Chunks kept in a task's table; new ones wait beside the sorted keys until there are so many.
TABLE_CHUNKS, WAITING = 400_000, 20_000

#: Makes the ids of new chunks, given by their index: all ids one after the other, and the number of each chunk's.
Encoder = Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]


class _Grown:
    """An array that is appended to."""

    def __init__(self, kind):
        self.room, self.n = np.empty(1024, kind), 0

    def add(self, x: np.ndarray) -> None:
        if self.n + len(x) > len(self.room):
            self.room = np.concatenate([self.room[: self.n], np.empty(self.n + 2 * len(x), self.room.dtype)])
        self.room[self.n : self.n + len(x)] = x
        self.n += len(x)

    @property
    def all(self) -> np.ndarray:
        return self.room[: self.n]


class _Ranges:
    """Arrays of different lengths, one after the other."""

    def __init__(self, kind):
        self.flat, self.start, self.size = _Grown(kind), _Grown(np.int64), _Grown(np.int64)

    def add(self, flat: np.ndarray, size: np.ndarray) -> None:
        self.start.add(self.flat.n + np.cumsum(size) - size)
        self.size.add(size)
        self.flat.add(flat)

    def of(self, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = self.size.all[entry]
        return self.flat.all[X.spread(self.start.all[entry], size)], size


class ChunkTable:
    """Distinct chunks with their ids.  They are found by hash, and their bytes are compared with the chunk's at every use."""

    def __init__(self, limit: int = TABLE_CHUNKS):
        self.limit = limit
        self._clear()

    def _clear(self) -> None:
        none = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.keys = [none, none]
        self.bytes, self.ids = _Ranges(np.uint8), _Ranges(np.uint32)

    def _find(self, distinct: np.ndarray) -> np.ndarray:
        entry = np.full(len(distinct), -1)
        for keys, own in self.keys:
            if len(keys):
                at = np.searchsorted(keys, distinct)
                at[at == len(keys)] = 0
                entry = np.where(keys[at] == distinct, own[at], entry)
        return entry

    def _insert(self, keys: np.ndarray, entry: np.ndarray) -> None:
        merge = lambda x, y: (np.insert(x[0], np.searchsorted(x[0], y[0]), y[0]), np.insert(x[1], np.searchsorted(x[0], y[0]), y[1]))
        self.keys[1] = merge(self.keys[1], (keys, entry))
        if len(self.keys[1][0]) > WAITING:
            self.keys = [merge(*self.keys), (np.empty(0, np.uint64), np.empty(0, np.int64))]

    def lookup(self, t: X.Texts, s: np.ndarray, e: np.ndarray, encode: Encoder, hashes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all chunks s..e one after the other, the number of each, and each one's entry (-1: none); encode is asked for unknown ones."""
        distinct, first, back = np.unique(t.hashes(s, e) if hashes is None else hashes, return_index=True, return_inverse=True)
        entry = self._find(distinct)
        new = entry < 0
        if new.any():
            if self.bytes.size.n + new.sum() > self.limit:
                self._clear()
                entry[:], new[:] = -1, True
            own = first[new]
            ids, size = encode(own)
            entry[new] = self.bytes.size.n + np.arange(len(own))
            self.ids.add(ids, size)
            self.bytes.add(t.data[X.spread(s[own], (e - s)[own])], (e - s)[own])
            self._insert(distinct[new], entry[new])
        entry = entry[back]
        wrong = self._differs(t, s, e, entry)
        flat, size = self.ids.of(entry)
        if not wrong.any():
            return flat, size, entry
        # Another chunk has this hash: these chunks are encoded by themselves.
        ids, more = encode(np.flatnonzero(wrong))
        start, n = self.ids.start.all[entry].copy(), size.copy()
        start[wrong], n[wrong] = self.ids.flat.n + np.cumsum(more) - more, more
        return np.concatenate([self.ids.flat.all, ids])[X.spread(start, n)], n, np.where(wrong, -1, entry)

    def _differs(self, t: X.Texts, s: np.ndarray, e: np.ndarray, entry: np.ndarray) -> np.ndarray:
        wrong = self.bytes.size.all[entry] != e - s
        size = np.where(wrong, 0, e - s)
        unlike = np.flatnonzero(t.data[X.spread(s, size)] != self.bytes.flat.all[X.spread(self.bytes.start.all[entry], size)])
        wrong[np.searchsorted(np.cumsum(size), unlike, side="right")] = True
        return wrong


_tables: dict[tuple, ChunkTable] = {}


def task_table(name: tuple) -> ChunkTable:
    """The worker's table of that name; it outlives a task where workers are reused."""
    if name not in _tables:
        _tables[name] = ChunkTable()
    return _tables[name]


def _marked(data: np.ndarray) -> np.ndarray:
    """Where a chunk begins: at each space that follows something else."""
    space = data == 32
    out = space.copy()
    out[1:] &= ~space[:-1]
    return out


#: Texts with these characters are encoded and decoded whole by the library.
_RARE = ("▁", "\0", "�")


class PieceTable:
    """The chunks of one model with their ids and the texts that those decode to."""

    def __init__(self, model: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model)
        # The library puts a marker before what it is given, so a chunk is given without its first space; a lone space is one marker.
        self.lone = [self.sp.piece_to_id("▁")]
        self.table = ChunkTable()
        self._begin()

    def _begin(self) -> None:
        # Of each entry the text that its ids decode to, and whether that is the chunk itself.
        self.bytes, self.texts, self.same = self.table.bytes, _Ranges(np.uint8), _Grown(bool)

    def encode(self, t: X.Texts, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        out = [x or self.lone for x in self.sp.encode([t.data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(s.tolist(), e.tolist(), strict=True)], num_threads=1)]
        size = np.array([len(x) for x in out], np.int64)
        return np.fromiter((i for x in out for i in x), np.uint32, int(size.sum())), size

    def lookup(self, t: X.Texts, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        out = self.table.lookup(t, s, e, lambda new: self.encode(t, s[new], e[new]))
        if self.bytes is not self.table.bytes:  # the table began anew
            self._begin()
        for a in range(self.same.n, self.table.ids.size.n, 10_000):
            new = np.arange(a, min(a + 10_000, self.table.ids.size.n))
            flat, size = self.table.ids.of(new)
            made = [x.encode() for x in self.sp.decode([x.tolist() for x in np.split(flat, np.cumsum(size)[:-1])])]
            self.texts.add(np.frombuffer(b"".join(made), np.uint8), np.array([len(x) for x in made]))
            chunks, size = self.bytes.of(new)
            stop = np.cumsum(size)
            self.same.add(np.array([x == chunks[b - n : b].tobytes() for x, b, n in zip(made, stop.tolist(), size.tolist(), strict=True)], bool))
        return out


_pieces: dict[str, PieceTable] = {}


def piece_ids(docs: DataFrame, model: str, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per input row: (id, ids, decoded), ids with the begin and end id.

    The model's pieces must not hold the whitespace marker behind another
    character, which is checked; then no merge crosses from a word into the next
    marker, and each distinct marked word is segmented, and its ids decoded, once.
    A text's ids are those of its words by position, and its decoded text those
    that the words' ids decode to.  Texts with the marker itself, with NUL or
    U+FFFD, or that begin with a space, go through the library whole.  A null
    text is an empty one; ids may be null or repeat; only the two named columns
    are read; an empty table gives an empty result.
    """
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    if any("▁" in sp.id_to_piece(i).lstrip("▁") for i in range(sp.get_piece_size())):
        raise ValueError("a piece holds the whitespace marker behind another character")

    def run(batches):
        if model not in _pieces:
            _pieces[model] = PieceTable(model)
        own = _pieces[model]
        bos, eos = own.sp.bos_id(), own.sp.eos_id()
        for batch in batches:
            ids: list = []
            texts: list = []
            for t in X.texts(batch.column(1)):
                begin = _marked(t.data)
                begin[t.offsets[:-1][t.lengths > 0]] = True
                s = np.flatnonzero(begin)
                e = np.append(s[1:], len(t.data))
                of = t.text_of(s)
                lead = (t.data[s] == 32) & ~np.isin(s, t.offsets[:-1])
                whole = np.zeros(t.n, bool)
                raw = t.data.tobytes()
                for mark in _RARE:
                    at = raw.find(m := mark.encode())
                    while at >= 0:
                        whole[int(t.text_of(np.array([at]))[0])] = True
                        at = raw.find(m, at + 1)
                full = t.lengths > 0
                whole[full] |= t.data[t.offsets[:-1][full]] == 32
                flat, size, entry = own.lookup(t, s + lead, e)
                whole[of[entry < 0]] = True
                total = np.bincount(of, size, minlength=t.n).astype(np.int64)
                stop = np.cumsum(total)
                changed = np.bincount(of[~own.same.all[entry]], minlength=t.n) > 0
                first = np.searchsorted(of, np.arange(t.n + 1))
                for d in range(t.n):
                    if whole[d]:
                        one = own.sp.encode(t.string(d), add_bos=True, add_eos=True)
                        ids.append(np.array(one, np.uint32))
                        texts.append(own.sp.decode(one))
                        continue
                    ids.append(np.concatenate([[bos], flat[stop[d] - total[d] : stop[d]], [eos]]).astype(np.uint32))
                    if changed[d]:
                        at = range(first[d], first[d + 1])
                        texts.append(b"".join(b" " * int(lead[c]) + own.texts.of(entry[c : c + 1])[0].tobytes() for c in at).decode())
                    else:  # every word's ids decode to the word
                        texts.append(t.string(d))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in ids], pa.binary()), pa.array(texts, pa.string())], ["id", "ids", "decoded"])

    rows = small_batches(docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, ids binary, decoded string").withColumnRenamed("id", id_col)


#: ASCII letters, and punctuation that is a token of its own kind wherever it meets one of them.
_LETTER, _MARK = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = True
_MARK[np.frombuffer(b".,;:!?()#*$%&", np.uint8)] = True


def word_bpe_ids(vocabulary: str):
    """A function from Texts to (flat ids, ids per text) for a tokenizer that lower-cases and never joins over whitespace.

    Chunks are words, cut where an ASCII letter meets plain punctuation, in lower
    case.  Chunks of ASCII letters alone are one pre-token and go to the model
    itself; all others go through the whole tokenizer.  A tokenizer that joins over
    such a border is refused.
    """
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # one task, one core
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary)
    model = tokenizer.model
    letters, marks = ([chr(c) for c in np.flatnonzero(x)] for x in (_LETTER, _MARK))
    borders = [x + y for a, b in ((letters, marks), (marks, letters)) for x in a for y in b] + [f"{x} {x}" for x in letters + marks]
    joined = next((x for x in borders if [at for _, at in tokenizer.pre_tokenizer.pre_tokenize_str(x)] != [(0, 1), (len(x) - 1, len(x))]), None)
    if joined is not None:
        raise ValueError(f"{vocabulary} does not cut {joined!r}: its tokens can cross the border of a chunk")
    special = [x.content.encode()[:2] for x in tokenizer.get_added_tokens_decoder().values()]
    table = task_table(("word_bpe", vocabulary))

    def encode_new(t: X.Texts, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        out: list = [None] * len(s)
        rest = []
        for i, (a, b) in enumerate(zip(s.tolist(), e.tolist(), strict=True)):
            w = t.data[a:b].tobytes()
            if w.isalpha():  # of bytes: ASCII letters only
                out[i] = [x.id for x in model.tokenize(w.lower().decode())]
            else:
                rest.append((i, w.decode("utf-8", "replace")))
        for (i, _), x in zip(rest, tokenizer.encode_batch_fast([w for _, w in rest], add_special_tokens=False), strict=True):
            out[i] = x.ids
        size = np.array([len(x) for x in out], np.int64)
        return np.fromiter((i for x in out for i in x), np.uint32, int(size.sum())), size

    def encode(t: X.Texts) -> tuple[np.ndarray, np.ndarray]:
        raw = t.data.tobytes()
        if not any(m in raw for m in special):  # special tokens are told by case
            t = t.lower()
        s, e, of = t.pieces(X.SPACE)
        letter, mark = _LETTER[t.data], _MARK[t.data]
        at = np.flatnonzero((letter[1:] & mark[:-1]) | (mark[1:] & letter[:-1])) + 1
        at = at[~np.isin(at, t.offsets)]
        s, e = np.sort(np.concatenate([s, at])), np.sort(np.concatenate([e, at]))
        of = t.text_of(s)
        flat, size, _ = table.lookup(t, s, e, lambda new: encode_new(t, s[new], e[new]))
        return flat, np.bincount(of, size, minlength=t.n).astype(np.int64)

    return encode
