"""Exact copies and aligned tokens against plain recomputation."""

import hashlib
import os
import random
import sys

import public_tokenizers
from pyspark.sql import functions as F
from test_operators import empty, rows, table  # noqa: F401

sys.path.insert(0, os.path.dirname(__file__))
import brute as B

KIND = "doc_id long, text string, id long, node long, piece string"


def _copies(df):
    from hammerline.llm.exact_dedup import equal_texts, folded

    got = equal_texts(df, carry={"text_sha256": F.sha2(folded(F.col("text")).cast("binary"), 256)})
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    return sorted(map(tuple, got.collect()), key=str)


def test_copies(spark, table, rows, empty, monkeypatch):  # noqa: F811
    from hammerline.llm import exact_dedup as E

    long = "Ab" * 60_000
    more = [(1, "x" * 64), (2, "X" * 64), (3, "x" * 65), (4, "x" * 1088), (5, "x" * 1088), (6, "x" * 1089), (7, long), (8, long.lower()), (9, long + "c"), (10, long + "d"), (11, None), (12, ""), (None, ""), (None, "only null"), (None, "only null")]
    more += [(13, "É" * 63 + "a"), (14, "É" * 63 + "A"), (15, "é" * 63 + "a"), (16, "same"), (16, "same"), (16, "other"), (17, "K"), (18, "k"), (19, "K")] + [(100 + i, "hot line " * 30) for i in range(3000)]
    for some in (rows, more):
        df = table if some is rows else spark.createDataFrame([(i, t, 1, 2, "p") for i, t in some], KIND)
        want = sorted(B.copies(some), key=str)
        assert _copies(df) == want
        with monkeypatch.context() as m:  # groups that are too large to broadcast
            m.setattr(E, "BROADCAST_BYTES", 0)
            assert _copies(df) == want
    assert _copies(empty) == []
    kept = E.drop_copies(table)
    assert kept.columns == table.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(x[0] for x in B.copies(rows) if x[3])


def test_copies_on_a_larger_table(spark):
    from hammerline.llm.queries import op12_radix_copies

    sf = "/root/testdata/sf0.01"
    own = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(map(tuple, op12_radix_copies(spark, sf).collect()), key=str) == sorted(B.copies(own), key=str)


FILES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SPACES = [" ", "  ", "\n", "\t", "\r\n", " ", "\u0085", " ", "　", " ", "\x1c", "​"]


def test_alignment(spark, table, rows, empty):  # noqa: F811
    from hammerline.llm import alignment as L

    r = random.Random(5)
    bits = [*SPACES * 2, "a", "Word", "l'eau", "don't", "été", "数据", "🙂", "123", "!!", "<|endoftext|>", "<s>", "<0x41>", "</s>", "ü", "x" * 70]
    made = [(10_000 + i, "".join(r.choice(bits) for _ in range(r.randint(1, 14)))) for i in range(1500)]
    made += [(20_000, "a ▁ b"), (20_001, "nul \0 here"), (20_002, "� bad"), (20_003, " "), (20_004, "   lead"), (20_005, "tail  "), (20_006, "\n"), (20_007, "a" * 5000), (20_008, " ".join(["word"] * 3000)), (20_009, "Ça \n \n"), (20_010, "a\n \nb")]
    every = [*rows, *made]
    df = table.select("doc_id", "text").union(spark.createDataFrame(made, "doc_id long, text string")).withColumns({"links": F.lit("x"), "_row": F.lit(3)}).repartition(7)
    want = B.aligned(every, *FILES)
    for limit in (None, 40):  # beyond the limit rarer pairs are joined
        got = {x.doc_id: x for x in L.linked_counts(L.aligned_texts(df, *FILES), limit).collect()}
        assert len(got) == len(every)
        for i, w in want.items():
            x = got[i]
            assert (x.n_a, x.n_b, x.n_groups, x.n_links, x.n_best, x.count_sum, x.groups) == w, i
    hashed = {x.doc_id: x.groups for x in L.aligned_texts(df, *FILES, groups=L.sha256_or_empty).collect()}
    assert all(hashed[i] == (hashlib.sha256(w[6].encode()).hexdigest() if w[6] else "") for i, w in want.items())
    assert L.linked_counts(L.aligned_texts(empty, *FILES)).count() == 0


def test_coalescing_of_overlaps():
    import numpy as np
    from hammerline.llm.alignment import coalesce

    a, b = np.array([0, 2, 5, 6]), np.array([0, 1, 3, 5])
    ga, gb, left, right = coalesce(a, np.array([2, 5, 6, 9]), b, np.array([1, 3, 5, 9]))
    assert ga.tolist() == [0, 0, 1, 1] and gb.tolist() == [0, 0, 0, 1]
    assert list(zip(left.tolist(), right.tolist(), strict=True)) == [(0, 0), (0, 1), (1, 1), (1, 2), (2, 3), (3, 3)]


def test_notices_of_one_text_are_told_apart_in_proportion(spark):
    import time

    from hammerline.llm.license_scan import NOTICES, CHARS_PER_EDIT, NoticeSearch, license_notices

    search, r = NoticeSearch(NOTICES, CHARS_PER_EDIT), random.Random(3)

    def plain(finds):
        best = []
        for x in sorted(finds, key=lambda x: (x[3] / len(search.notices[x[0]].text), x[1], -x[2], x[0])):
            if all(x[2] <= y[1] or x[1] >= y[2] for y in best):
                best.append(x)
        return sorted(best, key=lambda x: (x[1], x[2], x[0]))

    for spread in (30, 300, 3000):
        finds = {(r.randrange(len(search.notices)), a := r.randrange(spread), a + r.randint(1, 25), r.randint(0, 3)) for _ in range(200)}
        assert search._apart(finds) == plain(finds)
    notice = max(search.notices, key=lambda n: len(n.text)).text
    whole = " ".join(f"{notice} {i}" for i in range(5_000_000 // len(notice)))
    began = time.perf_counter()
    out = license_notices(spark.createDataFrame([(1, whole)], "doc_id long, text string")).first()
    assert len(out.spans) >= 5_000_000 // len(notice) and time.perf_counter() - began < 60
