"""Shingle Jaccard self-join through count-vector R-trees.

A document is the set of hashes of its word shingles.  Hashing the members of
a set into groups turns it into a point of group counts (larger sets have
more groups, in powers of two, so that any two can be compared), and the
summed coordinate minima of two points (or of the upper corners of two boxes)
bound the overlap of the sets from above.  Points are packed into an R-tree;
whole boxes and then points whose bound is too small are passed over and the
surviving pairs are verified on the sets themselves.

One tree over a corpus would be searched almost whole for every document, as
the boxes of unrelated documents overlap in that many dimensions.  So the
search is dealt out first: two sets with Jaccard >= t share a member among the
first n - ceil(t n) + 1 of each in any common order, so sets meet in the cells
of those members.  Frequent members come last in that order; which ones count
as frequent is told by counts kept in the tasks that read the texts, and
affects cost, not results.  The first member in that order that two sets share
has all their overlap from its place on, so a cell also knows how many members
of each set stand there: form letters, which share frequent members only, meet
in crowded cells but are told apart there without a comparison of pairs.

  1. each set is verified against the cell mate it meets most often, and the
     verified links contract to classes;
  2. each class is compared, as a box, with the largest class of its cells;
  3. the classes that still share a cell are searched through an R-tree for
     each cell: only pairs whose bound allows a link leave it.

Pairs of classes from 2 and 3 are searched set by set through R-trees.  Step 3
covers every pair of classes that meet in any cell, so no link is lost; pairs
inside a class need no more tests.  Copies share one set and are one node
throughout.  Sets are compared as 64-bit hashes of their members.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from hammerline.llm import _text as X
from hammerline.llm._spark import contracted, cut, cut_to_tasks, most_frequent, release, small_batches

#: A point has a group for four members or so, a power of two between these.
GROUPS_LEAST, GROUPS_MOST = 64, 8192
LEAF = 16
#: Sets of a block that is searched at once; classes of a cell's block; queries that go down a tree together.
BLOCK, CELL_BLOCK, TOGETHER = 512, 1024, 32
#: Logarithmic width of the size bands that sum up a crowded cell; so many cells' bands are broadcast.
BAND, BROADCAST_CELLS = 0.04, 5_000
#: Names of nodes, and places where they are compared, are broadcast up to this many.
BROADCAST_NODES, BROADCAST_ROUTES = 2_000_000, 500_000
#: A task counts shingles over so many at a time and reports those it has met so often; so many of them are held as frequent.
COUNTED, OFTEN, FREQUENT_MAX = 1_000_000, 3, 200_000
#: Rows of a group in which equal shingles meet; a frequent shingle is split when it has more.
GROUP_ROWS = 300_000
#: Names that a task remembers, so that copies which it holds are handled once.
REMEMBERED = 200_000


def shingle_sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """For each text its distinct shingle hashes, sorted; empty without words."""
    for t in X.texts(column):
        t = t.lower()
        s, e, of = t.pieces(X.SPACE)
        h = t.hashes(s, e)
        w, at = X.windows(h, of, width)
        d = of[at]
        bound = np.searchsorted(d, np.arange(t.n + 1))
        words = np.searchsorted(of, np.arange(t.n + 1))
        for i in range(t.n):
            a, b = words[i], words[i + 1]
            if 0 < b - a < width:
                own = h[a:b]
                z = np.array([b - a], np.uint64)
                for x in own:
                    z = X.mix(z + x)
                yield z
            else:
                yield np.unique(w[bound[i] : bound[i + 1]])


def node_of(s: np.ndarray) -> int:
    """The 64-bit name of a set: equal sets have equal names."""
    return int(X.mix(np.array([X.mix(s).sum(dtype=np.uint64) + np.uint64(len(s))], np.uint64))[0].view(np.int64))


def groups_for(n: int) -> int:
    g = GROUPS_LEAST
    while g < min(n // 4, GROUPS_MOST):
        g *= 2
    return g


def point(s: np.ndarray, groups: int = 0) -> np.ndarray:
    g = groups or groups_for(len(s))
    return np.minimum(np.bincount((s >> np.uint64(40)).astype(np.int64) & (g - 1), minlength=g), 65535).astype(np.uint16)


def folded(p: np.ndarray, groups: int) -> np.ndarray:
    """Points (the last axis) with fewer groups: a coarser group's count is the sum of the finer ones'."""
    if p.shape[-1] == groups:
        return p
    return np.minimum(p.reshape(*p.shape[:-1], -1, groups).sum(-2, dtype=np.uint32), 65535).astype(np.uint16)


def bounds(p: list[np.ndarray], q: list[np.ndarray]) -> np.ndarray:
    """The summed coordinate minima of each pair of points, in the finest groups that both have."""
    out = np.empty(len(p), np.int64)
    kinds: dict[tuple[int, int], list[int]] = {}
    for i, (x, y) in enumerate(zip(p, q, strict=True)):
        kinds.setdefault((len(x), len(y)), []).append(i)
    for g, at in kinds.items():
        for k in range(0, len(at), 1024):
            some = at[k : k + 1024]
            x, y = np.stack([p[i] for i in some]), np.stack([q[i] for i in some])
            out[some] = np.minimum(folded(x, min(g)), folded(y, min(g))).sum(1, dtype=np.int64)
    return out


def needed(n_a, n_b, percent: int):
    """The least overlap that makes 100 * overlap >= percent * union."""
    return -(-percent * (n_a + n_b) // (100 + percent))


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = int((b[at] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


class CountTree:
    """An R-tree over count vectors, or over the upper corners of boxes of them, packed bottom-up in size order and searched by overlap bound."""

    def __init__(self, points: np.ndarray, low: np.ndarray, high: np.ndarray, most: np.ndarray):
        # Sorting by size and then by the heaviest group keeps boxes tight in the coordinate that prunes most.
        self.order = np.lexsort((points.argmax(1), low))
        self.levels = [(points[self.order], low[self.order], high[self.order], most[self.order])]
        while len(self.levels[-1][0]) > LEAF:
            p, lo, hi, rest = self.levels[-1]
            cuts = np.arange(0, len(p), LEAF)
            self.levels.append((np.maximum.reduceat(p, cuts), np.minimum.reduceat(lo, cuts), np.maximum.reduceat(hi, cuts), np.maximum.reduceat(rest, cuts)))

    @classmethod
    def of_sets(cls, sets: list[np.ndarray]) -> CountTree:
        sizes = np.array([len(s) for s in sets])
        groups = groups_for(int(sizes.min()))
        return cls(np.stack([point(s, groups) for s in sets]), sizes, sizes, sizes)

    @property
    def groups(self) -> int:
        return self.levels[0][0].shape[1]

    def pairs(self, points: np.ndarray, low: np.ndarray, high: np.ndarray, most: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, entry, bound) of the entries whose bound allows a link with a query point (or box) of that size.

        No overlap is above the `most` of either side.
        """
        out = []
        for first in range(0, len(points), TOGETHER):
            n = min(TOGETHER, len(points) - first)
            top = len(self.levels[-1][0])
            q, at = np.repeat(np.arange(first, first + n), top), np.tile(np.arange(top), n)
            for depth in range(len(self.levels) - 1, -1, -1):
                p, lo, hi, rest = self.levels[depth]
                least = np.maximum(lo[at], -(-percent * low[q] // 100))
                fit = (100 * hi[at] >= percent * low[q]) & (percent * lo[at] <= 100 * high[q])
                fit &= np.minimum(rest[at], most[q]) >= needed(least, low[q], percent)
                q, at, least = q[fit], at[fit], least[fit]
                bound = np.minimum(p[at], points[q]).sum(1, dtype=np.int64)
                ok = bound >= needed(least, low[q], percent)
                q, at, bound = q[ok], at[ok], bound[ok]
                if depth:
                    q, at = np.repeat(q, LEAF), (at[:, None] * LEAF + np.arange(LEAF)).ravel()
                    inside = at < len(self.levels[depth - 1][0])
                    q, at = q[inside], at[inside]
            out.append((q, self.order[at], bound))
        return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.empty(0, np.int64),) * 3

    def candidates(self, s: np.ndarray, percent: int) -> np.ndarray:
        """Entries that may link with the set s, the highest bound first."""
        size = np.array([len(s)])
        _, at, bound = self.pairs(point(s, self.groups)[None], size, size, size, percent)
        return at[np.argsort(-bound, kind="stable")]


def _member(sorted_values: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each x stands among the sorted values, and whether it does."""
    if not len(sorted_values):
        return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
    at = np.searchsorted(sorted_values, x)
    at[at == len(sorted_values)] = 0
    return at, sorted_values[at] == x


def _sets(table: pa.RecordBatch, name: str) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column(name)]


def jaccard_components(docs: DataFrame, text: str = "text", id_col: str = "doc_id", percent: int = 75, width: int = 5) -> DataFrame:
    """One row per input row: (id, n_shingles, component_id).

    Rows link when 100 * intersection >= percent * union of their shingle sets;
    component_id is the smallest id reachable by links.  Texts that are null or
    have no words have n_shingles 0 and are components of their own; an id may
    be null or repeat, and ids of null never become a component_id unless all
    members have none.  Only the two named columns are read, so others may have
    any names; an empty table gives an empty result.
    """
    docs = small_batches(docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")))
    sc = docs.sparkSession.sparkContext
    id_type = docs.schema["id"].dataType.simpleString()
    read = cut(docs.mapInArrow(_named(width), f"id {id_type}, n long, node long, corner binary, times binary"))
    named = read.where("n >= 0").select("id", "n", "node")

    def listed(batches):
        for batch in batches:
            for token, times in zip(batch.column(0), batch.column(1), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(x.as_buffer(), np.int64)) for x in (token, times)], ["token", "n"])

    often = read.where("n < 0").select("corner", "times").mapInArrow(listed, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    frequent = sc.broadcast(most_frequent(cut_to_tasks(often), FREQUENT_MAX, "token")[1:])

    total = named.agg(F.sum("n")).first()[0] or 0
    parts = max(1, -(-total * (100 - percent) // 100 // GROUP_ROWS))
    dealt = docs.select("text").mapInArrow(_prefixes(width, percent, parts, frequent), "p int, blob binary")
    cells = cut_to_tasks(dealt.groupBy("p").applyInArrow(lambda t: _meet(t, frequent), "token long, node long, pivot long, rest int"))

    del dealt
    release(docs.sparkSession)

    # Points are small; sets are made anew only for nodes of pairs that the points leave.
    points = read.where("corner is not null and n > 0").join(cells.select("node").distinct(), "node", "left_semi")
    points = cut_to_tasks(points.groupBy("node").agg(F.first("corner").alias("corner"), F.first("n").cast("int").alias("n")))

    # Step 1: each node with the pivot it meets most often.
    met = cells.where("node <> pivot").groupBy("node", "pivot").agg(F.count(F.lit(1)).alias("k"))
    best = met.groupBy("node").agg(F.max_by("pivot", F.struct("k", "pivot")).alias("b")).withColumnRenamed("node", "a")
    best = _allowed(best, points.withColumnRenamed("node", "cls").withColumns({"lo": F.col("n"), "hi": F.col("n")}), percent)
    sets = cut_to_tasks(_of_nodes(docs, named, best.select(F.col("a").alias("node")).union(best.select("b")).distinct(), width))

    def verified(batches):
        for batch in batches:
            a, b = _sets(batch, "members"), _sets(batch, "members2")
            yield batch.select(["a", "b"]).filter(pa.array([linked(x, y, percent) for x, y in zip(a, b, strict=True)], pa.bool_()))

    pairs = best.join(sets.withColumnRenamed("node", "a"), "a").join(sets.select(F.col("node").alias("b"), F.col("members").alias("members2")), "b")
    comp = contracted(pairs.select("a", "b", "members", "members2").mapInArrow(verified, "a long, b long"))

    for exhaustive in (False, True):
        release(docs.sparkSession)
        # A class stays as its links to its smallest node.
        links = comp.select(F.col("node").alias("a"), F.col("comp").alias("b"))
        comp = contracted(links.unionByName(_class_links(docs, named, width, cells, points, comp, percent, exhaustive)))
    release(docs.sparkSession)

    ids = named.join(comp, "node", "left").withColumn("key", F.coalesce("comp", "node"))
    least = ids.where("key is not null").groupBy("key").agg(F.min("id").alias("component_id"))
    # A node can be a third of all rows, so the table is joined to the rows' names as a left side that may be split.
    out = ids.join(least, "key", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))


def _named(width: int):
    """For each text (id, n, node, corner), corner only where the task meets a node first; rows with n = -1 tell frequent shingles."""

    def rows(batches):
        seen: set[int] = set()
        held: list[np.ndarray] = []
        count, kind = 0, pa.null()
        names = ["id", "n", "node", "corner", "times"]

        def often() -> pa.RecordBatch:
            u, c = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            u, c = u[c >= OFTEN], c[c >= OFTEN].astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.nulls(1, kind), pa.array([-1], pa.int64()), pa.nulls(1, pa.int64()), pa.array([u.tobytes()], pa.binary()), pa.array([c.tobytes()], pa.binary())], names)

        for batch in batches:
            kind = batch.column(0).type
            n, node, corner = [], [], []
            for s in shingle_sets(batch.column(1), width):
                n.append(len(s))
                node.append(node_of(s) if len(s) else None)
                corner.append(None)
                if len(s) and node[-1] not in seen:
                    if len(seen) == REMEMBERED:
                        seen.clear()
                    seen.add(node[-1])
                    corner[-1] = point(s).tobytes()
                    held.append(s)
                    count += len(s)
                    if count > COUNTED:
                        yield often()
                        count = 0
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(corner, pa.binary()), pa.nulls(len(n), pa.binary())], names)
        if held:
            yield often()

    return rows


def _prefixes(width: int, percent: int, parts: int, frequent):
    """The prefix members of each node, packed by the group in which equal ones meet."""

    def rows(batches):
        seen: set[int] = set()
        tokens: list[np.ndarray] = []
        nodes: list[np.ndarray] = []
        rests: list[np.ndarray] = []
        often, times = frequent.value

        def out() -> pa.RecordBatch:
            t, node, rest = (np.concatenate(c) for c in (tokens, nodes, rests))
            for c in (tokens, nodes, rests):
                c.clear()
            at, hot = _member(often, t)
            salts = np.ones(len(t), np.uint64)
            salts[hot] += (times[at[hot]] // GROUP_ROWS).astype(np.uint64)
            part = (X.mix(t + X.mix(node.view(np.uint64)) % salts) >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)
            o = np.lexsort((t, part))
            t, node, rest, part = t[o], node[o], rest[o], part[o]
            head = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            blobs = [X.squeezed(t[a:b], node[a:b], rest[a:b]) for a, b in zip(head.tolist(), [*head[1:].tolist(), len(t)], strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(part[head].astype(np.int32)), pa.array(blobs, pa.binary())], ["p", "blob"])

        count = 0
        for batch in batches:
            for s in shingle_sets(batch.column(0), width):
                if not len(s) or (node := node_of(s)) in seen:
                    continue
                if len(seen) == REMEMBERED:
                    seen.clear()
                seen.add(node)
                k = len(s) - -(-percent * len(s) // 100) + 1
                at, hot = _member(often, s)
                if hot.any():
                    s = np.concatenate([s[~hot], s[hot][np.argsort(times[at[hot]], kind="stable")]])
                tokens.append(s[:k].copy())
                nodes.append(np.full(k, node, np.int64))
                rests.append(len(s) - np.arange(k, dtype=np.int64))
                count += k
                if count > COUNTED:
                    yield out()
                    count = 0
        if tokens:
            yield out()

    return rows


def _meet(table: pa.Table, frequent) -> pa.Table:
    """(token, node, pivot, rest): the nodes of each token that several share, or that is frequent and may be split, their smallest, and the members from the token on."""
    t, node, rest = (np.concatenate(c) for c in zip(*[X.unsqueezed(x.as_py(), (np.uint64, np.int64, np.int64)) for x in table.column("blob")], strict=True))
    o = np.lexsort((node, t))
    t, node, rest = t[o], node[o], rest[o]
    new = np.concatenate([[True], t[1:] != t[:-1]])
    one = new.copy()
    one[1:] |= node[1:] != node[:-1]
    t, node, rest, new = t[one], node[one], rest[one], new[one]
    head = np.flatnonzero(new)
    n = np.diff(np.append(head, len(t)))
    keep = np.repeat((n > 1) | _member(frequent.value[0], t[head])[1], n)
    return pa.table({"token": t[keep].view(np.int64), "node": node[keep], "pivot": np.repeat(node[head], n)[keep], "rest": rest[keep].astype(np.int32)})


def _of_nodes(docs: DataFrame, named: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """(node, members) of these nodes, from one text of each; where rows share an id, a node can come once from each task that holds it."""
    nodes = cut_to_tasks(named.join(nodes, "node", "left_semi").groupBy("node").agg(F.min("id").alias("own")))
    # The nodes' names are broadcast only up to a checked count; beyond it the joins shuffle.
    few = (lambda x: F.broadcast(x)) if nodes.count() <= BROADCAST_NODES else (lambda x: x)

    def rows(batches):
        seen: set[int] = set()
        for batch in batches:
            own, blobs = [], []
            for s in shingle_sets(batch.column(0), width):
                if len(s) and (node := node_of(s)) not in seen:
                    if len(seen) == REMEMBERED:
                        seen.clear()
                    seen.add(node)
                    own.append(node)
                    blobs.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(blobs, pa.binary())], ["node", "members"])

    ids = nodes.select("own").distinct()
    texts = docs.join(few(ids), docs["id"].eqNullSafe(ids["own"]), "left_semi").select("text")
    return texts.mapInArrow(rows, "node long, members binary").join(few(nodes.select("node")), "node", "left_semi")


def _allowed(pairs: DataFrame, box: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, ...) whose boxes (cls, corner, lo, hi) may hold two linked sets."""
    names = pairs.columns

    def test(batches):
        for batch in batches:
            if batch.num_rows:
                p, q = ([np.frombuffer(x.as_buffer(), np.uint16) for x in batch.column(c)] for c in ("pa", "pb"))
                lo_a, hi_a, lo_b, hi_b = (batch.column(c).to_numpy().astype(np.int64) for c in ("loa", "hia", "lob", "hib"))
                ok = (bounds(p, q) >= needed(lo_a, lo_b, percent)) & (100 * hi_a >= percent * lo_b) & (100 * hi_b >= percent * lo_a)
                yield batch.select(names).filter(pa.array(ok))

    side = lambda x: box.select(F.col("cls").alias(x), F.col("corner").alias("p" + x), F.col("lo").alias("lo" + x), F.col("hi").alias("hi" + x))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select(*pairs.columns, "pa", "pb", "loa", "hia", "lob", "hib")
    return cut_to_tasks(both.mapInArrow(test, pairs.schema).distinct())


def _class_links(docs: DataFrame, named: DataFrame, width: int, cells: DataFrame, points: DataFrame, comp: DataFrame, percent: int, exhaustive: bool) -> DataFrame:
    """Links (a, b) found between classes (node, comp) that meet in a cell: with its largest class, or (exhaustive) among all."""
    sized = cut_to_tasks(points.select("node", "n").join(comp, "node", "left").select("node", F.coalesce("comp", "node").alias("cls"), "n"))
    member = sized.drop("n")
    weight = cut_to_tasks(sized.groupBy("cls").agg(F.count(F.lit(1)).alias("weight"), F.min("n").alias("lo"), F.max("n").alias("hi")))
    meet = cut_to_tasks(cells.join(member, "node").groupBy("token", "cls").agg(F.max("rest").alias("rest")))
    # Tokens that the same classes share are searched once, with the most that any of them leaves to each class.
    cell = meet.groupBy("token").agg(F.count(F.lit(1)).alias("m"), F.bit_xor(F.xxhash64("cls")).alias("x"), F.bit_xor(F.xxhash64("cls", F.lit(1))).alias("y")).where("m > 1")
    meet = cut_to_tasks(meet.join(cell, "token").groupBy("m", "x", "y", "cls").agg(F.min("token").alias("token"), F.max("rest").alias("rest")).drop("x", "y"))
    if exhaustive:
        meet = _possible(meet, weight, percent)
    pairs = None
    if not exhaustive:
        rows = meet.join(weight, "cls")
        big = rows.groupBy("token").agg(F.max(F.struct("weight", "cls", "lo", "hi")).alias("top"))
        # Classes of too different sizes are no pair; that is known before pairs are made.
        like = (100 * F.col("top.hi") >= percent * F.col("lo")) & (100 * F.col("hi") >= percent * F.col("top.lo"))
        pairs = rows.join(big, "token").where((F.col("top.cls") != F.col("cls")) & like)
        pairs = cut_to_tasks(pairs.select(F.col("top.cls").alias("a"), F.col("cls").alias("b")).distinct())

    def merged(batches):
        for batch in batches:
            if batch.num_rows:
                p = [np.frombuffer(x.as_buffer(), np.uint16) for x in batch.column("corner")]
                yield from _box_batches(batch.column("cls").to_numpy(), p, batch.column("lo").to_numpy(), batch.column("hi").to_numpy())

    kind = "cls long, corner binary, lo int, hi int"
    # Classes are merged before and after the shuffle; one cut by a batch's end is merged once more below.
    wanted = (meet.select("cls") if exhaustive else pairs.select(F.col("a").alias("cls")).union(pairs.select("b"))).distinct()
    box = points.join(member.join(wanted, "cls", "left_semi"), "node").select("cls", "corner", F.col("n").alias("lo"), F.col("n").alias("hi"))
    box = cut_to_tasks(box.sortWithinPartitions("cls").mapInArrow(merged, kind).repartition("cls").sortWithinPartitions("cls").mapInArrow(merged, kind))
    kept = _cell_pairs(meet, box, percent) if exhaustive else _allowed(pairs, box, percent)
    weights = lambda x: weight.select(F.col("cls").alias(x), F.col("weight").alias("w" + x))
    kept = kept.join(weights("a"), "a").join(weights("b"), "b")
    turned = F.struct("wa", "a") < F.struct("wb", "b")
    kept = cut_to_tasks(kept.select(*[F.when(turned, F.col(y)).otherwise(F.col(x)).alias(x) for x, y in (("a", "b"), ("b", "a"), ("wa", "wb"), ("wb", "wa"))]).distinct())

    # Blocks of the larger class against blocks of the smaller ones that may link with it.
    load = kept.groupBy("a").agg(F.sum("wb").alias("load"), F.max("wa").alias("wa"))
    load = load.select("a", F.ceil(F.col("load") / BLOCK).cast("int").alias("nb"), F.ceil(F.col("wa") / BLOCK).cast("int").alias("na"))
    grid = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    left = member.join(load, F.col("cls") == F.col("a")).select("node", "a", F.pmod(F.xxhash64("node"), F.col("na")).cast("int").alias("i"), grid(F.col("nb")).alias("j"))
    right = kept.select("a", "b").join(load, "a").join(member.withColumnRenamed("cls", "b"), "b")
    right = right.select("node", F.col("a").alias("a2"), grid(F.col("na")).alias("i2"), F.pmod(F.xxhash64("node"), F.col("nb")).cast("int").alias("j2"), F.col("b").alias("b2"))
    left, right = cut_to_tasks(left), cut_to_tasks(right)
    # Sets go from where they are made to where they are compared.
    of = cut_to_tasks(_of_nodes(docs, named, left.select("node").union(right.select("node")).distinct(), width))
    near = lambda x: F.broadcast(x) if x.count() <= BROADCAST_ROUTES else x
    left, right = of.join(near(left), "node").drop("node"), of.withColumnRenamed("members", "members2").join(near(right), "node").drop("node")

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple[int, int]] = []
        if left.num_rows and right.num_rows:
            sets = _sets(left, "members")
            tree = CountTree.of_sets(sets)
            a, done = left.column("a")[0].as_py(), set()
            for b, s in zip(right.column("b2").to_pylist(), _sets(right, "members2"), strict=True):
                if b not in done and any(linked(sets[i], s, percent) for i in tree.candidates(s, percent)):
                    done.add(b)
                    found.append((a, b))
        return pa.table({"a": pa.array([x[0] for x in found], pa.int64()), "b": pa.array([x[1] for x in found], pa.int64())})

    return left.groupBy("a", "i", "j").cogroup(right.groupBy("a2", "i2", "j2")).applyInArrow(search, "a long, b long")


def _possible(meet: DataFrame, weight: DataFrame, percent: int) -> DataFrame:
    """meet (m, cls, token, rest) without the classes of a crowded cell that can have no partner in it.

    What a cell holds is told by bands of sizes, a few hundred at most: their least and largest sizes and the most
    members that a class of them has from the token on.
    """
    crowded = F.col("m") > CELL_BLOCK
    many = cut_to_tasks(meet.where(crowded).join(weight.drop("weight"), "cls"))
    bands = many.groupBy("token", F.floor(F.log("lo") / BAND).alias("_band")).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("rest").alias("rest"), F.count(F.lit(1)).alias("n"))
    bands = bands.groupBy("token").agg(F.collect_list(F.struct("_band", "lo", "hi", "rest", "n")).alias("bands"))
    least = lambda x: F.ceil(x * percent / 100)

    def fits(b):
        a, c = F.greatest("lo", least(b["lo"])), F.greatest(b["lo"], least(F.col("lo")))
        enough = F.least("rest", b["rest"]) * (100 + percent) >= percent * (a + c)
        other = (b["n"] > 1) | (b["_band"] != F.floor(F.log("lo") / BAND))
        return enough & other & (100 * F.col("hi") >= percent * b["lo"]) & (100 * b["hi"] >= percent * F.col("lo"))

    bands = cut(bands)
    near = F.broadcast(bands) if bands.count() <= BROADCAST_CELLS else bands
    left = many.join(near, "token").where(F.exists("bands", fits)).select("token", "cls", "rest")
    left = cut_to_tasks(left)
    sizes = left.groupBy("token").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    return cut_to_tasks(meet.where(~crowded).select("token", "cls", "rest", "m").unionByName(left.join(sizes, "token")))


def _cell_pairs(meet: DataFrame, box: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes that share a cell of meet (token, cls, rest, m) and whose boxes may hold two linked sets.

    Each cell is searched through an R-tree over its classes' boxes.  Many small cells share a group; a large one is cut
    to blocks, each of which is searched for every other.
    """
    rows = meet.join(box, "cls").withColumn("k", F.ceil(F.col("m") / CELL_BLOCK).cast("int"))
    groups = max(1, -(-(meet.count()) // 4096))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("cls"), F.col("k")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    rows = rows.select("token", "cls", "corner", "lo", "hi", "rest", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "k")
    key = F.when(F.col("k") == 1, F.pmod(F.xxhash64("token"), F.lit(groups))).otherwise(F.xxhash64("token", "i", "j"))

    def search(table: pa.Table) -> pa.Table:
        token, i, j, own, cls = (table.column(c).to_numpy() for c in ("token", "i", "j", "own", "cls"))
        lo, hi, rest = (table.column(c).to_numpy().astype(np.int64) for c in ("lo", "hi", "rest"))
        corner = [np.frombuffer(x.as_buffer(), np.uint16) for x in table.column("corner")]
        o = np.lexsort((cls, j, i, token))
        new = (token[o][1:] != token[o][:-1]) | (i[o][1:] != i[o][:-1]) | (j[o][1:] != j[o][:-1])
        a, b = [], []
        for cell in np.split(o, np.flatnonzero(new) + 1):
            g = min(len(corner[r]) for r in cell)
            p = np.stack([folded(corner[r], g) for r in cell])
            # A block against itself, or the first block against the second.
            left, right = own[cell] == i[cell], own[cell] == j[cell]
            x, y = cell[left], cell[right]
            q, at, _ = CountTree(p[left], lo[x], hi[x], rest[x]).pairs(p[right], lo[y], hi[y], rest[y], percent) if len(x) and len(y) else (np.empty(0, np.int64),) * 3
            x, y = x[at], y[q]
            once = cls[x] < cls[y] if i[cell[0]] == j[cell[0]] else cls[x] != cls[y]
            x, y = x[once], y[once]
            # The tree has the groups of the cell's coarsest box; what is left is compared in its own.
            ok = bounds([corner[r] for r in x], [corner[r] for r in y]) >= needed(np.maximum(lo[x], -(-percent * lo[y] // 100)), np.maximum(lo[y], -(-percent * lo[x] // 100)), percent)
            a.append(cls[x[ok]])
            b.append(cls[y[ok]])
        return pa.table({"a": np.concatenate(a), "b": np.concatenate(b)})

    return cut_to_tasks(rows.withColumn("g", key).groupBy("g").applyInArrow(search, "a long, b long").distinct())


def _box_batches(cls: np.ndarray, corner: list[np.ndarray], lo: np.ndarray, hi: np.ndarray):
    """One row per class: the upper corner of its members' boxes, in its coarsest member's groups, and their least and largest size."""
    order = np.argsort(cls, kind="stable")
    cls = cls[order]
    cuts = np.flatnonzero(np.concatenate([[True], cls[1:] != cls[:-1]]))
    tops = []
    for own in np.split(order, cuts[1:]):
        g = min(len(corner[i]) for i in own)
        top = folded(corner[own[0]], g)
        for i in own[1:]:
            top = np.maximum(top, folded(corner[i], g))
        tops.append(top.tobytes())
    yield pa.RecordBatch.from_arrays(
        [pa.array(cls[cuts]), pa.array(tops, pa.binary()), pa.array(np.minimum.reduceat(lo[order], cuts).astype(np.int32)), pa.array(np.maximum.reduceat(hi[order], cuts).astype(np.int32))],
        ["cls", "corner", "lo", "hi"],
    )


def keep_one(docs: DataFrame, percent: int = 75, width: int = 5) -> DataFrame:
    """The rows of `docs`, one of each component: the one with the smallest doc_id.

    Rows with repeated ids or without an id stay as they are named: an id that is
    the smallest of its component keeps all its rows, and null ids are kept.
    """
    found = jaccard_components(docs, percent=percent, width=width)
    drop = found.where("doc_id <> component_id").select(F.col("doc_id")).distinct()
    return docs.join(drop, "doc_id", "left_anti")
