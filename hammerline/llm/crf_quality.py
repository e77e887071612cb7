"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad.  A line's score is linear in its own features and
those of the lines before and after it, and neighbouring labels interact
through a transition matrix.  The field is fitted on a bounded sample of
labelled documents, read whole, whose lines carry the document's label; its forward-backward
marginals, averaged with line lengths as weights, give a document's quality, and
a one-variable logistic fit on the same sample turns that into a probability.

The sample's line features are a table in the shared folder; likelihoods and
gradients are summed in tasks, and the driver holds parameters only.  Long
documents are cut to blocks whose transfer matrices are multiplied beside one
another, so passes over a document of n lines take about the root of n steps.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from hammerline.llm import _text as X
from hammerline.llm._spark import cut, small_batches

#: The most labelled rows used in fitting, each with all of its lines.
SAMPLE_ROWS = 8000
#: Lines of a row of the table that is fitted, of one document at least; so many full rows make a task.
CHUNK_LINES, CHUNKS_A_TASK = 20_000, 4
#: Lines of a block of a chain.
BLOCK_LINES = 1024
#: Evaluations of the likelihood, steps remembered, the gradient at which the fit ends, and penalties of weights and transitions.
EVALUATIONS, REMEMBERED, FLAT, RIDGE, STAY = 60, 8, 1e-5, 1e-4, 0.02

FEATURES = 22
_CLASS = {name: np.zeros(256, bool) for name in ("upper", "letter", "digit", "mark", "stop", "bar", "bang", "other", "at")}
_CLASS["upper"][65:91] = True
_CLASS["letter"][65:91] = _CLASS["letter"][97:123] = True
_CLASS["digit"][48:58] = True
_CLASS["mark"][np.frombuffer(b"#*$%&<>~^_=+{}[]\\/", np.uint8)] = True
_CLASS["stop"][np.frombuffer(b".,;:?", np.uint8)] = True
_CLASS["bar"][124] = _CLASS["bang"][33] = _CLASS["at"][64] = True
_CLASS["other"][128:] = True


def line_features(t: X.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of each line, its text and its length in bytes; a text has one line at least."""
    ls, le, lof = t.lines()
    n = (le - ls).astype(np.float64)
    size = np.maximum(n, 1)
    share = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[np.stack([ls, le])], axis=0)[0]
    ws, we, _ = t.pieces(X.SPACE)
    line = np.searchsorted(ls, ws, side="right") - 1
    # Empty lines share their start with nothing: the last line that starts at or before a word holds it.
    words = np.bincount(line, minlength=len(ls)).astype(np.float64)
    per = np.maximum(words, 1)
    h = t.lower().hashes(ws, we)
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (line[1:] == line[:-1])
    key = X.mix(h + line.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    distinct = np.bincount(line[np.unique(key, return_index=True)[1]], minlength=len(ls)) if len(h) else np.zeros(len(ls))
    length = (we - ws).astype(np.float64)
    count = lambda w: np.bincount(line, w, minlength=len(ls))
    last = t.data[we - 1] if len(we) else np.empty(0, np.uint8)
    first = t.data[ws] if len(ws) else np.empty(0, np.uint8)
    lk = X.mix(t.hashes(ls, le) + lof.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    again = np.ones(len(ls), bool)
    again[np.unique(lk, return_index=True)[1]] = False
    upper, letter = share(_CLASS["upper"][t.data]), share(_CLASS["letter"][t.data])
    mean = count(length) / per
    out = np.stack(
        [
            np.log1p(words), np.log1p(n), mean / 8, np.sqrt(np.maximum(count(length**2) / per - mean**2, 0)) / 4,
            upper / np.maximum(letter, 1), letter / size, share(_CLASS["digit"][t.data]) / size * 4, share(_CLASS["mark"][t.data]) / per,
            share(_CLASS["stop"][t.data]) / per * 2, share(_CLASS["bar"][t.data]) / per * 2, share(_CLASS["bang"][t.data]) / per, share(_CLASS["other"][t.data]) / size * 3,
            np.minimum(share(_CLASS["at"][t.data]), 3), count(same) / per * 2, 1 - distinct / per, count(length <= 2) / per,
            count(length >= 14) / per * 3, count(_CLASS["mark"][last] | _CLASS["bang"][last]) / per, count(_CLASS["stop"][last]) / per * 3, count(_CLASS["upper"][first]) / per * 2,
            again & (words > 0), words == 0,
        ],
        1,
    )
    return np.minimum(out, 6).astype(np.float32), lof, n


def ends(of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each line is the first, and the last, of its text."""
    if not len(of):
        return np.empty(0, bool), np.empty(0, bool)
    new = of[1:] != of[:-1]
    return np.concatenate([[True], new]), np.concatenate([new, [True]])


def neighbours_sums(x: np.ndarray, head: np.ndarray, tail: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Sums, weighted by r, of own, previous and next line's features, the flags for first and last lines, and a constant."""
    before, after = np.where(head[1:], 0, r[1:]), np.where(tail[:-1], 0, r[:-1])
    return np.concatenate([r @ x, before @ x[:-1], after @ x[1:], [r[head].sum(), r[tail].sum(), r.sum()]])


def forward_backward(u: np.ndarray, of: np.ndarray, trans: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For all chains (scores u for good, 0 for bad): each line's marginal of the good label, the expected transitions, each
    weighted as the line it leads to, and each line's part of the logarithm of its chain's normaliser.
    """
    head, tail = ends(of)
    emit = np.exp(np.stack([-np.maximum(u, 0), u - np.maximum(u, 0)], 1))
    m = np.exp(trans - trans.max())
    # Blocks: where each begins, its lines, and whether it begins or ends its chain.
    chain, lines = np.flatnonzero(head), np.diff(np.append(np.flatnonzero(head), len(u)))
    per = -(-lines // BLOCK_LINES)
    top = np.cumsum(per) - per
    nth = np.arange(per.sum()) - np.repeat(top, per)
    first = np.repeat(chain, per) + BLOCK_LINES * nth
    size = np.minimum(np.repeat(chain + lines, per) - first, BLOCK_LINES)
    order = np.argsort(-size, kind="stable")
    steps = int(size.max()) if len(size) else 0
    # What meets a block's first scores, and what follows its last line.
    enter, leave = np.ones((len(first), 2)), np.ones((len(first), 2))
    if (per > 1).any():
        inside = order[np.repeat(per > 1, per)[order]]
        live = np.searchsorted(-size[inside], -np.arange(steps), side="left")
        product = np.zeros((len(first), 2, 2))
        for t in range(steps):
            b = inside[: live[t]]
            e = emit[first[b] + t]
            v = (product[b] @ m) * e[:, None, :] if t else e[:, :, None] * np.eye(2)
            product[b] = v / v.sum((1, 2), keepdims=True)
        for k in range(1, int(per.max())):
            b = top[per > k] + k
            v = np.einsum("bi,bij->bj", enter[b - 1], product[b - 1])
            enter[b] = v / v.sum(1, keepdims=True) @ m
            b = (top + per)[per > k] - k
            v = np.einsum("bij,bj->bi", product[b], leave[b]) @ m.T
            leave[b - 1] = v / v.sum(1, keepdims=True)
    a, b, z = np.empty((len(u), 2)), np.empty((len(u), 2)), np.empty(len(u))
    begin, count = first[order], size[order]
    live = np.searchsorted(-count, -np.arange(steps), side="left")
    for t in range(steps):
        i = begin[: live[t]] + t
        v = emit[i] * (a[i - 1] @ m if t else enter[order])
        z[i] = v.sum(1)
        a[i] = v / z[i][:, None]
    b[begin + count - 1] = leave[order]
    for t in range(steps - 1, 0, -1):
        i = begin[: live[t]] + t
        v = (emit[i] * b[i]) @ m.T
        b[i - 1] = v / v.sum(1, keepdims=True)
    p = a * b
    to = np.flatnonzero(~head)
    joint = a[to - 1][:, :, None] * m * (emit[to] * b[to])[:, None, :]
    joint *= ((1 if weight is None else weight[to]) / joint.sum((1, 2)))[:, None, None]
    return p[:, 1] / p.sum(1), joint.sum(0), np.log(z) + np.maximum(u, 0) + np.where(head, 0, trans.max())


@dataclass
class LineField:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    trans: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def line_scores(self, x: np.ndarray, of: np.ndarray) -> np.ndarray:
        # The neighbours' part is the same product, moved by a line: no wide matrix is made.
        w = self.weights / self.scale
        k = x.shape[1]
        own, before, after = (x @ w[:k], x @ w[k : 2 * k], x @ w[2 * k : 3 * k])
        head, tail = ends(of)
        u = own + w[-3] * head + w[-2] * tail + w[-1] - self.mean @ w
        u[1:] += np.where(head[1:], 0, before[:-1])
        u[:-1] += np.where(tail[:-1], 0, after[1:])
        return np.clip(u, -30, 30)

    def marginals(self, x: np.ndarray, of: np.ndarray) -> np.ndarray:
        return forward_backward(self.line_scores(x, of), of, self.trans)[0]

    def raw(self, x: np.ndarray, of: np.ndarray, length: np.ndarray, n: int) -> np.ndarray:
        w = length + 1
        p = np.bincount(of, self.marginals(x, of) * w, minlength=n) / np.maximum(np.bincount(of, w, minlength=n), 1)
        p = np.clip(p, 1e-6, 1 - 1e-6)
        return np.log(p / (1 - p))

    def score(self, x: np.ndarray, of: np.ndarray, length: np.ndarray, n: int) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.raw(x, of, length, n) + self.shift, -30, 30)))


def lowest(f, x: np.ndarray) -> np.ndarray:
    """A minimum of f (which gives value and gradient) by limited-memory quasi-Newton steps, each shortened until it descends."""
    value, g = f(x)
    kept: list[tuple[np.ndarray, np.ndarray]] = []
    left = EVALUATIONS - 1
    while left > 0 and np.abs(g).max() > FLAT:
        d, shares = -g, []
        for s, y in reversed(kept):
            shares.append((s @ d) / (s @ y))
            d = d - shares[-1] * y
        d = d * ((kept[-1][0] @ kept[-1][1]) / (kept[-1][1] @ kept[-1][1]) if kept else 1 / max(1.0, float(np.linalg.norm(g))))
        for (s, y), share in zip(kept, reversed(shares), strict=True):
            d = d + s * (share - (y @ d) / (s @ y))
        step, slope = 1.0, float(g @ d)
        while left > 0:
            new, h = f(x + step * d)
            left -= 1
            if new <= value + 1e-4 * step * slope:
                break
            step /= 2
        else:
            break
        s, y = step * d, h - g
        if s @ y > 1e-12:
            kept = [*kept, (s, y)][-REMEMBERED:]
        x, value, g = x + s, new, h
    return x


def _sums(table: DataFrame, of_row) -> np.ndarray:
    """The sum of what of_row(labels, lines, x, n) gives for the table's rows: one small row a task comes to the driver."""

    def add(batches):
        total = None
        for batch in batches:
            for row in zip(*batch.columns, strict=True):
                y, lines, x, n = (np.frombuffer(c.as_buffer(), k) for c, k in zip(row, (np.int64, np.int64, np.float32, np.float64), strict=True))
                one = of_row(y, lines, x.reshape(-1, FEATURES).astype(np.float64), n)
                total = one if total is None else total + one
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["v"])

    return sum(np.frombuffer(r["v"], np.float64) for r in table.mapInArrow(add, "v binary").collect())


def fit_field(table: DataFrame) -> LineField | None:
    """Maximum likelihood over the table's documents (labels, lines, x, n); each weighs as the root of its number of lines.

    The calibration is fitted on whole documents' scores by Newton steps.  None without labels of both kinds.
    """

    def moments(y, lines, x, n):
        of, one = np.repeat(np.arange(len(y)), lines), np.ones(len(x))
        return np.concatenate([neighbours_sums(x, *ends(of), one), neighbours_sums(x**2, *ends(of), one), [len(x), np.sqrt(lines).sum(), (y == 0).sum(), (y == 1).sum()]])

    total = _sums(table, moments)
    if np.ndim(total) == 0 or not total[-2:].all():
        return None
    k = 3 * FEATURES + 3
    mean, square = total[:k] / total[-4], total[k : 2 * k] / total[-4]
    all_weight = total[-3]
    scale = np.sqrt(np.maximum(square - mean**2, 0))
    mean[-1], scale[scale < 1e-6] = 0, 1

    def value(theta: np.ndarray) -> tuple[float, np.ndarray]:
        field = LineField(mean, scale, theta[:k], theta[k:].reshape(2, 2))

        def one(y, lines, x, n):
            of = np.repeat(np.arange(len(y)), lines)
            weight = 1 / np.sqrt(lines)
            u = field.line_scores(x, of)
            p, met, z = forward_backward(u, of, field.trans, weight[of])
            left = (y[of] - p) * weight[of]
            # Lines carry their document's label, so labels only follow themselves.
            seen = np.diag(np.bincount(y, (lines - 1) * weight, minlength=2))
            likely = (weight[of] * (y[of] * u - z)).sum() + (seen * field.trans).sum()
            return np.concatenate([[likely], (neighbours_sums(x, *ends(of), left) - mean * left.sum()) / scale, (seen - met).ravel()])

        got = _sums(table, one) / all_weight
        penalty = np.concatenate([np.full(k, RIDGE), np.full(4, STAY)]) * theta
        return float(penalty @ theta / 2 - got[0]), penalty - got[1:]

    theta = lowest(value, np.zeros(k + 4))
    field = LineField(mean, scale, theta[:k], theta[k:].reshape(2, 2))

    def raw(batches):
        for batch in batches:
            for row in zip(*batch.columns, strict=True):
                y, lines, x, n = (np.frombuffer(c.as_buffer(), t) for c, t in zip(row, (np.int64, np.int64, np.float32, np.float64), strict=True))
                of = np.repeat(np.arange(len(y)), lines)
                yield pa.RecordBatch.from_arrays([pa.array(field.raw(x.reshape(-1, FEATURES).astype(np.float64), of, n, len(y))), pa.array(y)], ["r", "y"])

    # One number for each document of the sample, which is bounded.
    got = table.mapInArrow(raw, "r double, y long").toArrow()
    r, y = got.column("r").to_numpy(), got.column("y").to_numpy().astype(float)
    design, b = np.stack([r, np.ones(len(r))], 1), np.array([1.0, 0.0])
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(design @ b, -30, 30)))
        h = (design * (q * (1 - q))[:, None]).T @ design + 1e-3 * np.eye(2)
        b = b + np.linalg.solve(h, design.T @ (y - q) - 1e-3 * (b - [1, 0]))
    if b[0] > 0:
        field.slope, field.shift = float(b[0]), float(b[1])
    return field


def held_out(id_col: str = "doc_id"):
    """Rows whose crc32(id as text) mod 3 is 1; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> LineField | None:
    """A field fitted on at most `sample_rows` labelled rows that are not held out, in the order of a hash of their ids."""
    known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    ids = docs.select("doc_id").where(~held_out()).join(known, "doc_id").distinct()
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    rows = small_batches(docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id"))
    most = CHUNK_LINES

    def chunks(batches):
        held: list[tuple[int, np.ndarray, np.ndarray]] = []

        def out() -> pa.RecordBatch:
            y, x, n = zip(*held, strict=True)
            lines = np.array([len(a) for a in n], np.int64)
            held.clear()
            blobs = np.array(y, np.int64), lines, np.concatenate(x), np.concatenate(n)
            return pa.RecordBatch.from_arrays([pa.array([b.tobytes()], pa.binary()) for b in blobs], ["y", "lines", "x", "n"])

        count = 0
        for batch in batches:
            for t in X.texts(batch.column(0)):
                x, of, n = line_features(t)
                begin = np.searchsorted(of, np.arange(t.n + 1))
                for d in range(t.n):
                    own = slice(begin[d], begin[d + 1])
                    if held and count + begin[d + 1] - begin[d] > most:
                        yield out()
                        count = 0
                    held.append((batch.column(1)[t.first + d].as_py(), x[own], n[own]))
                    count += begin[d + 1] - begin[d]
        if held:
            yield out()

    table = cut(rows.select("text", "quality").mapInArrow(chunks, "y binary, lines binary, x binary, n binary"))
    # The sample is read again and again, so its tasks go by its lines and not by the partitions that its documents came from.
    lines = (table.agg(F.sum(F.length("n"))).first()[0] or 0) // 8
    parts = max(1, -(-lines // (CHUNK_LINES * CHUNKS_A_TASK)))
    return fit_field(cut(table.repartitionByRange(parts, F.xxhash64("y", "n")).sortWithinPartitions(F.xxhash64("y", "n"))))


def quality_scores(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per input row: (doc_id, held_out, score, predicted).

    Only texts are inputs of a score: a null text is an empty one, which is one
    empty line.  Labels that are null are ignored, of contradicting labels the
    larger counts; without labels of both kinds every score is 0.5.  Ids may be
    null or repeat; other columns are not read; an empty table gives an empty
    result.
    """
    field = train(docs, labels, sample_rows)
    shared = docs.sparkSession.sparkContext.broadcast(field)
    rows = docs.select("doc_id", held_out().alias("held_out"), "text")

    def score(batches):
        for batch in batches:
            out = []
            for t in X.texts(batch.column(2)):
                x, of, n = line_features(t)
                out.append(shared.value.score(x, of, n, t.n) if shared.value else np.full(t.n, 0.5))
            s = np.concatenate(out) if out else np.empty(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return rows.mapInArrow(score, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")
