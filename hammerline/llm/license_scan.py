"""Fuzzy search for short licence notices.

A notice of m characters may be found with k edits.  Cut into k + 1 parts, one
part must stand unchanged in any such find, so exact occurrences of the parts
locate candidates, and the regex library's bounded-error matching verifies the
edits there and gives the span.  Texts are searched as their terms joined by
single spaces, so punctuation and line breaks do not count as edits.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from hammerline.llm import _text as X

#: Phrases whose exact places are counted, and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Short notices in terms, and their labels.
NOTICES = {
    "released under the mit license": "mit",
    "licensed under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "licensed under the apache license version 2 0": "apache",
    "licensed under the gnu general public license": "gpl",
    "under the terms of the gnu general public license": "gpl",
    "under the terms of the gnu lesser general public license": "lgpl",
    "redistribution and use in source and binary forms with or without modification": "bsd",
    "licensed under the bsd 3 clause license": "bsd",
    "licensed under the mozilla public license": "mpl",
    "licensed under a creative commons attribution": "cc",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "licensed under cc by sa 4 0": "cc-by-sa",
    "licensed under cc by 4 0": "cc-by",
    "this is free and unencumbered software released into the public domain": "unlicense",
}

#: One edit is allowed for so many characters of a notice.
CHARS_PER_EDIT = 12


class Notice:
    def __init__(self, text: str, label: str, chars_per_edit: int):
        self.text, self.label = text, label
        self.edits = len(text) // chars_per_edit
        parts, cuts = self.edits + 1, [0]
        for j in range(1, parts):
            cuts.append(len(text) * j // parts)
        cuts.append(len(text))
        self.seeds = [(text[a:b].encode(), a) for a, b in zip(cuts, cuts[1:], strict=False)]
        self.pattern = regex.compile(rf"(?b)\b(?:{regex.escape(text)}){{e<={self.edits}}}\b")


class NoticeSearch:
    def __init__(self, notices: dict[str, str], chars_per_edit: int):
        self.notices = [Notice(t, label, chars_per_edit) for t, label in notices.items()]
        self.seen: dict[tuple[int, bytes], tuple | None] = {}

    def _verify(self, k: int, window: bytes):
        key = (k, window)
        if key not in self.seen:
            if len(self.seen) > 50_000:
                self.seen.clear()
            s = window.decode("utf-8", "replace")
            m = self.notices[k].pattern.search(s)
            self.seen[key] = (len(s[: m.start()].encode()), len(s[: m.end()].encode()), sum(m.fuzzy_counts)) if m else None
        return self.seen[key]

    def find(self, line: bytes) -> list[tuple[int, int, int, int]]:
        """(notice, start, end, edits) in a buffer of texts that end in newlines; no find crosses a newline."""
        out = set()
        for k, notice in enumerate(self.notices):
            starts: set[int] = set()
            for seed, shift in notice.seeds:
                at = line.find(seed)
                while at >= 0:
                    starts.add(max(0, at - shift))
                    at = line.find(seed, at + 1)
            done = -1
            for s in sorted(starts):
                if s <= done:
                    continue
                slack = 2 * notice.edits + 8
                a, b = max(0, s - slack), min(len(line), s + len(notice.text) + slack)
                a = max(a, line.rfind(b"\n", a, s) + 1)
                nl = line.find(b"\n", s, b)
                b = nl if nl >= 0 else b
                # Widen to whole terms, so that the same text gives the same window.
                a = max(line.rfind(b" ", 0, a), line.rfind(b"\n", 0, a)) + 1
                ends = [x for x in (line.find(b" ", b), line.find(b"\n", b)) if x >= 0]
                b = min(ends) if ends else len(line)
                hit = self._verify(k, line[a:b])
                if hit:
                    out.add((k, a + hit[0], a + hit[1], hit[2]))
                    done = a + hit[0]
        return self._apart(out)

    def _apart(self, finds: Iterable[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
        """Of overlapping finds the one with the smallest share of edits stays; a find meets its two neighbours among those kept."""
        kept: list[tuple[int, int, int, int]] = []  # (start, end, notice, edits), which don't overlap and so are in order of their ends too
        for k, a, b, edits in sorted(finds, key=lambda x: (x[3] / len(self.notices[x[0]].text), x[1], -x[2], x[0])):
            at = bisect.bisect_left(kept, (b,))
            if not at or kept[at - 1][1] <= a:
                kept.insert(at, (a, b, k, edits))
        return [(k, a, b, edits) for a, b, k, edits in kept]


def _joined(t: X.Texts, s: np.ndarray, e: np.ndarray, of: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The terms with single spaces between, a newline after each text's last; where each term begins."""
    size = e - s
    at = np.cumsum(size + 1) - (size + 1)
    out = np.full(int(at[-1] + size[-1] + 1) if len(s) else 0, 32, np.uint8)
    inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    out[np.repeat(at, size) + inner] = t.data[np.repeat(s, size) + inner]
    last = np.flatnonzero(np.append(of[1:] != of[:-1], True)) if len(s) else np.empty(0, int)
    out[at[last] + size[last]] = 10
    return out.tobytes(), at


def license_notices(docs: DataFrame, text: str = "text", id_col: str = "doc_id", notices: dict[str, str] = NOTICES, chars_per_edit: int = CHARS_PER_EDIT) -> DataFrame:
    """One row per input row: (id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans).

    Spans are the notices' finds as (label, first word, word after the last,
    edits).  The score is 1 with an exact phrase, else the best find's share of
    unchanged characters, else 0.  A null text is empty and has no labels (empty
    strings) and null places; ids may be null or repeat; only the two named
    columns are read; an empty table gives an empty result.
    """

    def scan(batches):
        search = NoticeSearch(notices, chars_per_edit)
        probe = X.Texts(np.frombuffer(" ".join(PHRASES).encode(), np.uint8), np.array([0, len(" ".join(PHRASES))]), 0)
        ps, pe, _ = probe.pieces(X.NOT_TERM)
        ph = iter(probe.hashes(ps, pe))
        phrases = [([next(ph) for _ in phrase.split()], label) for phrase, label in PHRASES.items()]
        for batch in batches:
            rows: list[tuple] = []
            for t in X.texts(batch.column(1)):
                t = t.lower()
                s, e, of = t.pieces(X.NOT_TERM)
                h = t.hashes(s, e)
                words = np.bincount(of, minlength=t.n)
                head = np.cumsum(words) - words
                base: dict[int, list] = {}
                for phrase, label in phrases:
                    m = len(h) - len(phrase) + 1
                    if m <= 0:
                        continue
                    hit = of[:m] == of[len(phrase) - 1 :]
                    for j, x in enumerate(phrase):
                        hit &= h[j : j + m] == x
                    for i in np.flatnonzero(hit).tolist():
                        base.setdefault(int(of[i]), []).append((i - int(head[of[i]]), label))
                line, at = _joined(t, s, e, of)
                found: dict[int, list] = {}
                for k, a, b, edits in search.find(line):
                    first = int(np.searchsorted(at, a, side="right")) - 1
                    last = int(np.searchsorted(at, b, side="left"))
                    d = int(of[first])
                    found.setdefault(d, []).append((search.notices[k], first - int(head[d]), last - int(head[d]), edits))
                for d in range(t.n):
                    own, more = base.get(d, ()), found.get(d, ())
                    places = [p for p, _ in own]
                    labels = {x for _, x in own}
                    score = 1.0 if own else max((1 - edits / len(n.text) for n, _, _, edits in more), default=0.0)
                    spans = [{"label": n.label, "first": a, "end": b, "edits": x} for n, a, b, x in more]
                    rows.append((int(words[d]), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | {n.label for n, *_ in more})), score, spans))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 8
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("end", pa.int64()), ("edits", pa.int64())]))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names)

    names = ["id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    kind = f"id {rows.schema['id'].dataType.simpleString()}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label: string, first: long, end: long, edits: long>>"
    return rows.mapInArrow(scan, kind).withColumnRenamed("id", id_col)
