"""Plain recomputation of the operators' rules, for small tables."""

from __future__ import annotations

import collections
import hashlib
import math
import re
import zlib


def low(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s or "")


def words(s):
    return re.findall(r"[^\x20\x09-\x0D]+", s or "")


def base_rules(s):
    s = s or ""
    w = words(s)
    seen = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    cover = {j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in s.split("\n") if words(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", s)), len(lines) - len(set(lines)), len(cover)


def shingles(s):
    w = words(low(s))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def classes(sets, percent=75):
    """sets: id to set; the smallest id reachable by links."""
    ids = sorted(sets)
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for k, i in enumerate(ids):
        for j in ids[:k]:
            a, b = sets[i], sets[j]
            both = len(a & b) if a and b else 0
            if both and 100 * both >= percent * (len(a) + len(b) - both):
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def removed(rows, length=50):
    """rows: (id, text); per id (n_bytes, n_removed, n_spans, sha256)."""
    first: dict[bytes, int] = {}
    data = sorted((i, (t or "").encode()) for i, t in rows)
    for i, b in data:
        for p in range(len(b) - length + 1):
            first.setdefault(b[p : p + length], i)
    out = {}
    for i, b in data:
        spans: list[list[int]] = []
        for p in range(len(b) - length + 1):
            if first[b[p : p + length]] < i:
                if spans and p <= spans[-1][1]:
                    spans[-1][1] = p + length
                else:
                    spans.append([p, p + length])
        kept, z = b"", 0
        for x, y in spans:
            kept, z = kept + b[z:x], y
        out[i] = (len(b), sum(y - x for x, y in spans), len(spans), hashlib.sha256(kept + b[z:]).hexdigest())
    return out


PII = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    twice = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(d))]
    return sum(v - 9 * (v > 9) for v in twice) % 10 == 0


def personal(s):
    def ok(kind, m):
        d = re.sub("[^0-9]", "", m)
        return {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m.split(".")), "card": lambda: 13 <= len(d) <= 19 and luhn(d), "phone": lambda: 9 <= len(d) <= 15}[kind]()

    return [f"{k}:{m.start()}:{m.end()}" for k, p in PII.items() for m in re.finditer(p, s or "") if ok(k, m[0])]


def held(i, mod):
    return None if i is None else zlib.crc32(str(i).encode()) % mod


class Unigrams:
    def __init__(self, rows):
        self.c = collections.Counter(w for i, t in rows if held(i, 10) for w in words(low(t)))
        self.ends = sum(1 for i, _ in rows if held(i, 10))
        self.n = sum(self.c.values()) + self.ends
        self.v = len(self.c) + (self.ends > 0)

    def score(self, t):
        counts = [self.c[w] for w in words(low(t))] + [self.ends]
        return len(counts), sum(c > 0 for c in counts), self.n, sum(math.log10((c + 0.1) / (self.n + 0.1 * (self.v + 1))) for c in counts)


class PartialMatching:
    def __init__(self, rows, order=3):
        self.order, self.count = order, [collections.defaultdict(collections.Counter) for _ in range(order + 1)]
        for i, t in rows:
            if held(i, 10):
                y = self.symbols(t)
                for p in range(order, len(y)):
                    for k in range(order + 1):
                        self.count[k][tuple(y[p - k : p])][y[p]] += 1

    def symbols(self, t):
        return [0] * self.order + [b + 2 for b in low(t).encode()] + [1]

    def score(self, t):
        y = self.symbols(t)
        return sum(self._one(y[p - self.order : p], y[p]) for p in range(self.order, len(y)))

    def _one(self, ctx, s):
        out, gone = 0.0, set()
        for k in range(self.order, -1, -1):
            m = self.count[k].get(tuple(ctx[self.order - k :]))
            if not m:
                continue
            left = {a: b for a, b in m.items() if a not in gone}
            n, d = sum(left.values()), len(left)
            if s in left:
                return out + math.log10(left[s] / (n + d))
            if d:
                out += math.log10(d / (n + d))
            gone |= set(m)
        return out - math.log10(max(1, 257 - len(self.count[0][()])))


def copies(rows):
    """rows: (id, text); per row (id, keep_id, group_size, kept, sha256)."""
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[low(t)].append(i)
    keep = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    return [(i, keep[low(t)], len(groups[low(t)]), i == keep[low(t)], hashlib.sha256(low(t).encode()).hexdigest()) for i, t in rows]


def aligned(rows, a_vocabulary, b_model):
    """rows: (id, text); per id (n_a, n_b, n_groups, n_links, n_best, count_sum, groups)."""
    import sentencepiece
    from tokenizers import Tokenizer
    from tokenizers.decoders import ByteLevel

    a, b = Tokenizer.from_file(a_vocabulary), sentencepiece.SentencePieceProcessor(model_file=b_model)
    a.encode_special_tokens = True
    chars = {}
    for k in range(256):
        if 0x21 <= k <= 0x7E or 0xA1 <= k <= 0xAC or 0xAE <= k:
            chars[chr(k)] = k
    for k in range(256):
        if k not in set(chars.values()):
            chars[chr(256 + len(chars) - 188)] = k
    assert ByteLevel().decode(["".join(c for c in chars if chars[c] < 128)]).encode() == bytes(x for x in chars.values() if x < 128)
    found, count = {}, collections.Counter()
    for i, t in rows:
        if not t:
            found[i] = None
            continue
        ea, eb = a.encode(" " + t, add_special_tokens=False), b.encode(t)
        ba = [bytes(chars[c] for c in x) for x in ea.tokens]
        bb = [bytes([int(b.id_to_piece(x)[1:-1], 16)]) if b.is_byte(x) else b.id_to_piece(x).replace("▁", " ").encode() for x in eb]
        if b"".join(ba) != (" " + t).encode() or b"".join(bb) != (" " + t).encode():
            found[i] = None
            continue
        ends_a, ends_b = _sums(ba), _sums(bb)
        both = set(ends_a) & set(ends_b)
        groups, ka, kb, links = [], 0, 0, []
        for end in sorted(both):
            ga, gb = [], []
            while ka < len(ba) and ends_a[ka] <= end:
                ga.append(ka)
                ka += 1
            while kb < len(bb) and ends_b[kb] <= end:
                gb.append(kb)
                kb += 1
            groups.append((ga, gb))
            links += [(ea.ids[x], eb[y]) for x in ga for y in gb if ends_a[x] - len(ba[x]) < ends_b[y] and ends_b[y] - len(bb[y]) < ends_a[x]]
        count.update(links)
        found[i] = (ea.ids, eb, groups, links)
    best = collections.Counter()
    for (_, y), n in count.items():
        best[y] = max(best[y], n)
    out = {}
    for i, x in found.items():
        if x is None:
            out[i] = (0, 0, 0, 0, 0, 0, "")
            continue
        ia, ib, groups, links = x
        text = ";".join(",".join(str(ia[k]) for k in ga) + "|" + ",".join(str(ib[k]) for k in gb) for ga, gb in groups)
        out[i] = (len(ia), len(ib), len(groups), len(links), sum(count[p] == best[p[1]] for p in links), sum(count[p] for p in links), text)
    return out


def _sums(parts):
    out, n = [], 0
    for p in parts:
        n += len(p)
        out.append(n)
    return out


def repaired(rows):
    """rows: (conv_id, turn, role, text); per conv_id the report of the damaged and repaired conversation, by one state and turn at a time."""
    convs = collections.defaultdict(list)
    for c, n, r, t in rows:
        own = convs[c]
        r, t = (" " if r is None else r), (" " if t is None else t)
        code = zlib.crc32(f"{' ' if c is None else c}:{' ' if n is None else n}".encode()) % 20
        if code == 0:
            continue
        t = "" if code == 1 else re.sub("[.!?]", "", t) if code == 2 else t
        own += [(n, "user" if code == 4 else r, t)] * (2 if code == 3 else 1)
    return {c: _repaired(sorted(own, key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode()))) for c, own in convs.items()}


def _repaired(rows):
    nothing = hashlib.sha256(b"").hexdigest()
    if not rows:
        return 0, 0, 0, 0, 0, 0, "", nothing
    faults, seen = [], set()
    for _, r, t in rows:
        w = re.sub(r"[\x20\x09-\x0D]", "", t)
        faults.append("b" if not w else "d" if (r, t) in seen else "t" if w[-1] not in ".!?" else "")
        seen.add((r, t))
    turns = [n for n, _, _ in rows if n is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    follow = {"": "su", "s": "u", "u": "a", "a": "u"}

    def with_inserts(best):
        for _ in range(4):
            for q, (c, e, out) in list(best.items()):
                for r in follow[q].replace("s", ""):
                    new = c + 2, e + "I", (*out, {"u": "user:", "a": "assistant:"}[r])
                    if r not in best or new[:2] < best[r][:2]:
                        best[r] = new
        return best

    # Costs alone are enough for the least audit only backwards, so whole audits are kept for each state: (cost, audit, lines).
    best = with_inserts({"": (0, "", ())})
    for (_, r, t), f in zip(rows, faults):
        new = {}

        def put(q, x):
            if q not in new or x[:2] < new[q][:2]:
                new[q] = x

        for q, (c, e, out) in best.items():
            put(q, (c + 3, e + "D", out))
            if f in ("b", "d"):
                continue
            cut = f == "t"
            if r[:1] and r[:1] in follow[q]:
                put(r[:1], (c + cut, e + "K", (*out, f"{r}:{t}")))
            for x, name in (("u", "user"), ("a", "assistant")):
                if x in follow[q]:
                    put(x, (c + 2 + cut, e + "R", (*out, f"{name}:{t}")))
        best = with_inserts(new)
    cost, audit, lines = min((best[q] for q in ("", "a") if q in best), key=lambda x: x[:2])
    return gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()
