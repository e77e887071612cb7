"""Each operator against brute force on the smallest tables and on awkward rows."""

import math
import os
import sys
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
import brute as B

SF = "/root/testdata/sf0.001"
KIND = "doc_id long, text string, lang string, source string, n_chars long, id long, node long, row string"
LONG = "the quick brown fox jumps over the lazy dog while seven wizards mix potions near a quiet river bank at dawn "
ODD = [
    (900001, None), (900002, ""), (900003, " \n\t "), (900004, LONG * 3), (900005, LONG * 3), (900006, LONG * 3 + "and then some"), (900007, "One two"), (900008, "one TWO"),
    (900009, "x" * 30000), (900010, "é☃ mail a.b@c.de or +1 (329) 555-7030, 4111 1111 1111 1111, 1.2.3.4.5"), (900011, "a\0b \x01c\x02"), (900012, "word " * 4000), (900013, LONG * 3), (900014, "Released under the MIT License.\nMIT license"),
]


@pytest.fixture(scope="module")
def table(spark):
    """The supplied documents and awkward rows, with columns whose names operators use inside."""
    own = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    odd = spark.createDataFrame([(i, t, None, None, None) for i, t in ODD], "doc_id long, text string, lang string, source string, n_chars long")
    return own.union(odd).withColumns({"id": F.lit(1).cast("long"), "node": F.lit(2).cast("long"), "row": F.lit("x")}).persist()


@pytest.fixture(scope="module")
def rows(table):
    return [(r.doc_id, r.text) for r in table.collect()]


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], KIND)


def test_quality_rules(table, rows, empty):
    from hammerline.llm.quality_rules import keep_good, quality_verdicts

    got = {r.doc_id: r for r in quality_verdicts(table).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        r, want = got[i], B.base_rules(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r.kept and r.base_failed)
    assert sum(r.kept for r in got.values()) > 0.97 * sum(not r.base_failed for r in got.values())
    assert quality_verdicts(empty).count() == 0
    assert {r.doc_id for r in keep_good(table).collect()} == {i for i, r in got.items() if r.kept}


def test_kneser_ney_sums_to_one_and_rejects_noise(spark):
    from hammerline.llm import quality_rules as Q

    texts = [(i, " ".join(np.random.default_rng(i).choice(LONG.split(), 60)), "en") for i in range(80)] + [(99, " ".join("".join(map(chr, np.random.default_rng(1).integers(0x400, 0x480, 7))) for _ in range(60)), "en")]
    docs = spark.createDataFrame(texts, "doc_id long, text string, lang string")
    model = Q.kneser_ney(Q.count_grams(docs, "text", "lang"))
    arrays = Q._model_arrays(model.toArrow())["en"]
    alphabet = np.array([r.g for r in model.where("k = 1").collect()], np.int64).view(np.uint64)
    for ctx in (0, (ord("t") << 32) | (ord("h") << 16) | ord("e"), (ord("q") << 32) | (ord("z") << 16) | ord("x")):
        codes = (np.uint64(ctx) << np.uint64(16)) | alphabet
        assert np.exp(arrays.log_probability(codes)).sum() == pytest.approx(1, abs=1e-3)
    verdict = {r.doc_id: r.kept for r in Q.quality_verdicts(docs).collect()}
    assert not verdict[99] and sum(verdict.values()) == 80
    Q_limit, Q.BROADCAST_GRAMS = Q.BROADCAST_GRAMS, 0
    try:
        assert {r.doc_id: r.kept for r in Q.quality_verdicts(docs).collect()} == verdict
    finally:
        Q.BROADCAST_GRAMS = Q_limit


def test_bands_reject_noise_among_the_supplied_documents(spark):
    from hammerline.llm.quality_rules import quality_verdicts

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    long = docs.where("length(text) between 1500 and 6000").orderBy("doc_id").limit(20).collect()
    noise = [(10**6 + k, "".join(np.random.default_rng(k).permutation(list(r.text))), r.lang) for k, r in enumerate(long)]
    noise += [(10**6 + 50, "\U0001f600\U00020000 \U0001f4a9\U00030000 " * 200, "en")]
    found = quality_verdicts(docs.union(spark.createDataFrame(noise, docs.schema)))
    got = {r.doc_id: r for r in found.collect()}
    assert not any(got[i].kept for i, *_ in noise) and not any(got[i].base_failed for i, *_ in noise[:20])
    good = [r.doc_id for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").where("quality = 1").collect()]
    fine = [got[i].kept for i in good if not got[i].base_failed]
    assert np.mean(fine) > 0.98
    bad = [r.doc_id for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").where("quality = 0").collect()]
    assert np.mean([got[i].kept for i in bad]) < np.mean([not got[i].base_failed for i in bad])


def test_regular_strings_of_two_letters_differ(spark):
    """Words that a polynomial modulo 2**64 cannot tell apart."""
    import public_tokenizers as P
    import sentencepiece
    from hammerline.llm import jaccard_join, packing, pieces, ppm, quality_rules
    from tokenizers import Tokenizer

    word = "a"
    for _ in range(10):
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    texts = {1: word, 2: other, 3: f"{word} {other}", 4: f"{word}\n{other}", 5: " ".join([word] * 8 + [other] * 8)}
    docs = spark.createDataFrame([(i, t, "en") for i, t in texts.items()], "doc_id long, text string, lang string").coalesce(1)
    assert {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(docs).collect()} == B.classes({i: B.shingles(t) for i, t in texts.items()})
    for r in quality_rules.quality_verdicts(docs).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == B.base_rules(texts[r.doc_id])
    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    for r in pieces.piece_ids(docs, P.path("piece_bpe_32k.model")).collect():
        assert np.frombuffer(r.ids, np.uint32).tolist() == sp.encode(texts[r.doc_id], add_bos=True, add_eos=True) and r.decoded == texts[r.doc_id]
    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    for r in packing.pack_documents(docs, P.path("word_bpe_49k.json")).where("piece = 0").collect():
        ids = np.array([*tok.encode(texts[r.doc_id], add_special_tokens=False).ids, 1], "<u4")[:4096]
        assert r.ids_crc32 == zlib.crc32(ids.tobytes())
    uni = B.Unigrams(list(texts.items()))
    for r in ppm.score_documents(docs).collect():
        want = uni.score(texts[r.doc_id])
        assert (r.n_tokens, r.n_known, r.train_tokens) == want[:3] and r.base_score == pytest.approx(want[3], rel=1e-6)


def test_chunks_with_equal_hashes_keep_their_own_ids():
    from hammerline.llm import _text as X
    from hammerline.llm.pieces import ChunkTable

    data = np.frombuffer(b"abcdabxy", np.uint8)
    t = X.Texts(data, np.array([0, 8]), 0)
    s, e = np.array([0, 2, 4, 6]), np.array([2, 4, 6, 8])
    encode = lambda new: (np.repeat(s[new] * 10 + data[s[new]], 2).astype(np.uint32), np.full(len(new), 2))
    flat, size, entry = ChunkTable().lookup(t, s, e, encode, hashes=np.array([7, 7, 7, 9], np.uint64))
    assert size.tolist() == [2, 2, 2, 2] and flat[::2].tolist() == [97, 20 + 99, 97, 60 + 120] and entry.tolist() == [0, -1, 0, 1]


def test_jaccard_components(table, rows, empty):
    from hammerline.llm.jaccard_join import jaccard_components, keep_one

    sets = {i: B.shingles(t) for i, t in rows}
    want = B.classes(sets)
    got = {r.doc_id: r for r in jaccard_components(table).collect()}
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == {i: (len(sets[i]), want[i]) for i in want}
    assert {r.doc_id for r in keep_one(table).collect()} == {i for i, c in want.items() if i == c}
    assert jaccard_components(empty).count() == 0


def test_near_copies_without_a_common_centre(spark):
    from hammerline.llm.jaccard_join import jaccard_components

    rng, base = np.random.default_rng(3), [f"w{i}" for i in range(160)]
    docs = []
    for i in range(120):
        own = list(base)
        for k in rng.choice(160, rng.integers(1, 9), replace=False):
            own[k] = f"v{i}x{k}"
        docs.append((int(1000 - i), " ".join(own)))
    got = {r.doc_id: r.component_id for r in jaccard_components(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == B.classes({i: B.shingles(t) for i, t in docs})


def test_form_letters_are_not_compared_pair_by_pair(spark, monkeypatch):
    from hammerline.llm import jaccard_join as J

    rng, form = np.random.default_rng(5), [f"w{i}" for i in range(160)]
    docs = [(i, " ".join(form + [f"v{i}x{k}" for k in range(rng.integers(36, 60))])) for i in range(1500)]
    # Some do link: near copies of a letter, and letters with little of their own.
    docs += [(2000 + i, docs[i][1] + " more") for i in range(20)] + [(3000 + i, " ".join(form + [f"u{i}x{k}" for k in range(18)])) for i in range(20)]
    left = []
    pairs = J._cell_pairs
    monkeypatch.setattr(J, "_cell_pairs", lambda *a: left.append(pairs(*a)) or left[-1])
    for block in (J.CELL_BLOCK, 256):
        monkeypatch.setattr(J, "CELL_BLOCK", block)
        got = {r.doc_id: r.component_id for r in J.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()}
        want = {i: i for i, _ in docs} | {2000 + i: i for i in range(20)} | {3000 + i: 3000 for i in range(20)}
        assert got == want
    assert all(x.count() < 3000 for x in left)


def test_count_tree_bounds():
    from hammerline.llm.jaccard_join import CountTree, linked

    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 63, 300).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[rng.random(300) < 0.9], rng.integers(0, 1 << 63, rng.integers(0, 60)).astype(np.uint64)])) for _ in range(200)]
    tree = CountTree.of_sets(sets)
    for s in sets[:40]:
        found = set(tree.candidates(s, 75).tolist())
        assert {i for i, x in enumerate(sets) if linked(x, s, 75)} <= found


def test_line_field(spark, table, empty):
    from hammerline.llm.crf_quality import quality_scores

    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = {r.doc_id: r for r in quality_scores(table, labels).collect()}
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r.held_out == (B.held(i, 3) == 1) for i, r in got.items())
    known = {r.doc_id: r.quality for r in labels.collect()}
    unseen = [(got[i].predicted, q) for i, q in known.items() if got[i].held_out]
    assert np.mean([p == q for p, q in unseen]) > 0.85
    assert quality_scores(empty, labels).count() == 0
    assert {r.score for r in quality_scores(table, labels.limit(0)).collect()} == {0.5}


def test_line_field_learns_from_whole_documents(spark, monkeypatch):
    from hammerline.llm import crf_quality as Q

    # Good and bad documents differ only after line 450.
    late = {1: "A plain sentence, with some words in it.\n" * 60, 0: "### $$$ !!! 000\n" * 60}
    docs = spark.createDataFrame([(i, "same words here\n" * 450 + late[i % 2]) for i in range(24)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(24)], "doc_id long, quality int, toxic int")
    scores = lambda: {r.doc_id: r.score for r in Q.quality_scores(docs, labels).collect()}
    once = scores()
    assert all((s >= 0.5) == i % 2 for i, s in once.items())
    monkeypatch.setattr(Q, "CHUNK_LINES", 1100)
    assert scores() == pytest.approx(once, abs=1e-6)


def test_forward_backward():
    import itertools

    from hammerline.llm.crf_quality import forward_backward

    rng = np.random.default_rng(0)
    u, trans = rng.normal(size=5), rng.normal(size=(2, 2))

    def brute(u):
        z, m = 0, np.zeros(len(u))
        for y in itertools.product((0, 1), repeat=len(u)):
            s = math.exp(sum(a * b for a, b in zip(u, y, strict=True)) + sum(trans[a, b] for a, b in itertools.pairwise(y)))
            z, m = z + s, m + s * np.array(y)
        return m / z

    assert forward_backward(u, np.array([0, 0, 0, 1, 1]), trans)[0] == pytest.approx(np.concatenate([brute(u[:3]), brute(u[3:])]))


def test_forward_backward_in_blocks(monkeypatch):
    import time

    from hammerline.llm import crf_quality as Q

    rng = np.random.default_rng(1)
    of, trans = np.repeat(np.arange(40), rng.integers(1, 30, 40)), rng.normal(size=(2, 2))
    u, weight = rng.normal(size=len(of)) * 3, rng.random(len(of))
    whole = Q.forward_backward(u, of, trans, weight)
    for size in (1, 2, 3, 7):
        monkeypatch.setattr(Q, "BLOCK_LINES", size)
        for a, b in zip(Q.forward_backward(u, of, trans, weight), whole, strict=True):
            assert a == pytest.approx(b)
    # The normaliser's gradient is the marginals.
    moved = u.copy()
    moved[17] += 1e-6
    assert (Q.forward_backward(moved, of, trans)[2].sum() - whole[2].sum()) / 1e-6 == pytest.approx(whole[0][17], abs=1e-4)
    monkeypatch.undo()
    begin = time.time()
    p = Q.forward_backward(rng.normal(size=1_000_000), np.zeros(1_000_000, np.int64), trans)[0]
    assert ((p > 0) & (p < 1)).all() and time.time() - begin < 20


def test_license_notices(spark, table, rows, empty):
    import re

    from hammerline.llm.license_scan import PHRASES, license_notices

    got = {r.doc_id: r for r in license_notices(table).collect()}
    for i, t in rows:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", B.low(t))
        at = [(k, label) for p, label in PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(at), min(at)[0] if at else None, max(at)[0] if at else None)
        assert r.base_labels == ",".join(sorted({x for _, x in at})) and set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1
    odd = spark.createDataFrame([(1, "x Relesed under teh MIT License. y"), (2, "permision is hereby granted, free of charge, to any persn obtaining a copy of"), (3, "released under the mat")], "doc_id long, text string")
    one = {r.doc_id: r for r in license_notices(odd).collect()}
    assert (one[1].labels, one[2].labels, one[3].labels) == ("mit", "mit", "") and one[2].spans[0].edits == 2 and (one[2].spans[0].first, one[2].spans[0].end) == (0, 13)
    assert license_notices(empty).count() == 0


def test_suffix_dedup(table, rows, empty):
    from hammerline.llm import suffix_dedup as S

    want = B.removed(rows)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in S.repeated_bytes(table).collect()}
    assert got == want
    crowded, S.CROWDED = S.CROWDED, 1
    try:
        assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in S.repeated_bytes(table).collect()} == want
    finally:
        S.CROWDED = crowded
    assert S.repeated_bytes(empty).count() == 0
    kept = {r.doc_id: r.text for r in S.drop_repeats(table).collect()}
    assert len(kept) == len(rows) and kept[900001] is None and kept[900005] == ""


def test_suffix_arrays_of_all_kinds():
    from hammerline.llm.induced import neighbours_share, suffix_array

    rng = np.random.default_rng(1)
    for k in range(150):
        t = rng.integers(0, rng.integers(1, 5), rng.integers(1, 90))
        want = sorted(range(len(t)), key=lambda i: t[i:].tolist())
        # A queue of 64 bytes spills to disk at once.
        assert suffix_array(t, memory=64).tolist() == want and suffix_array(t, memory=64, inductions=1).tolist() == want
    data = np.frombuffer(b"abcabcabcabc" * 3, np.uint8)
    order = np.array(sorted(range(len(data) - 9), key=lambda i: data[i:].tobytes()))
    assert neighbours_share(data, order, 10).tolist() == [False] + [data[a : a + 10].tobytes() == data[b : b + 10].tobytes() for a, b in zip(order, order[1:], strict=False)]


def test_packing(table, rows, empty):
    import public_tokenizers as P
    from hammerline.llm.packing import CAPACITY, lower_bound, pack_documents
    from tokenizers import Tokenizer

    got = pack_documents(table, P.path("word_bpe_49k.json")).collect()
    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    ids = {i: np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for i, t in rows}
    bins: dict[int, list] = {}
    for r in got:
        own = ids[r.doc_id][r.start : r.start + r.length]
        assert r.length == len(own) and r.start == CAPACITY * r.piece and zlib.crc32(own.tobytes()) == r.ids_crc32
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sum(r.length for r in got) == sum(map(len, ids.values()))
    for own in bins.values():
        own.sort()
        assert [a for a, _ in own] == np.cumsum([0, *[n for _, n in own]])[:-1].tolist() and sum(n for _, n in own) <= CAPACITY
    assert len(bins) <= lower_bound(np.bincount([r.length for r in got], minlength=CAPACITY + 1), CAPACITY) + 1
    assert pack_documents(empty, P.path("word_bpe_49k.json")).count() == 0


def test_best_fit_and_bounds():
    from hammerline.llm.packing import best_fit_decreasing, lower_bound

    rng = np.random.default_rng(2)
    for _ in range(60):
        lengths = rng.integers(1, 41, rng.integers(1, 60))
        bins, offsets, used = best_fit_decreasing(lengths, 40)
        assert np.bincount(bins, lengths).max() <= 40 and used >= lower_bound(np.bincount(lengths, minlength=41), 40)
    assert lower_bound(np.bincount([21] * 7, minlength=41), 40) == 7 and lower_bound(np.bincount([14] * 6, minlength=41), 40) == 3


def test_partial_matching(table, rows, empty):
    from hammerline.llm.ppm import score_documents

    got = {r.doc_id: r for r in score_documents(table).collect()}
    uni, ppm = B.Unigrams(rows), B.PartialMatching(rows)
    for k, (i, t) in enumerate(rows):
        r, want = got[i], uni.score(t)
        assert (r.n_tokens, r.n_known, r.train_tokens) == want[:3] and r.base_score == pytest.approx(want[3], rel=1e-6) and r.held_out == (B.held(i, 10) == 0)
        if k % 9 == 0 or i > 900000:
            assert r.score == pytest.approx(ppm.score(t), rel=1e-5)
    assert score_documents(empty).count() == 0


def test_partial_matching_keeps_its_order_beyond_the_broadcast(spark, monkeypatch):
    from hammerline.llm import ppm

    own = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(60).collect()] + ODD + [(900100, "\u0436\u0437 \u4e2d\u6587 \U0001f600")]
    docs = spark.createDataFrame(own, "doc_id long, text string")
    want = {r.doc_id: r for r in ppm.score_documents(docs).collect()}
    monkeypatch.setattr(ppm, "BROADCAST_ENTRIES", 10)
    monkeypatch.setattr(ppm, "GROUP_ENTRIES", 1000)
    brute = B.PartialMatching(own)
    for common in (0, 500, 10**6):
        monkeypatch.setattr(ppm, "COMMON_GRAMS", common)
        got = {r.doc_id: r for r in ppm.score_documents(docs).collect()}
        assert got.keys() == want.keys()
        for i, r in got.items():
            assert r.score == pytest.approx(want[i].score, rel=1e-9) and r.base_score == pytest.approx(want[i].base_score, rel=1e-9)
    for i, t in own[::9] + own[-8:]:
        assert got[i].score == pytest.approx(brute.score(t), rel=1e-5)


def test_multi_index_recall_where_cells_are_left_out(spark):
    """20,000 vectors around centres, as shipped: most cells stay unvisited, and recall against all rows is at least 0.9."""
    from hammerline.llm.multi_index import LEAST, SAMPLE, TARGET, MultiIndex, nearest_vectors

    rng = np.random.default_rng(11)
    centres = rng.normal(size=(200, 32))
    x = (centres[rng.integers(0, 200, 20_000)] + 0.5 * rng.normal(size=(20_000, 32))).astype(np.float32).astype(float)
    vectors = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>")
    got = nearest_vectors(vectors).toPandas()
    assert len(got) == 1000 * 20 and got.groupby("query_id").size().eq(20).all()
    hit = 0
    for q, mine in got.groupby("query_id"):
        score = x @ x[q]
        score[q] = -np.inf
        hit += len(set(np.argpartition(-score, 20)[:20]) & set(mine.vec_id))
        assert np.allclose(mine.score, x[mine.vec_id] @ x[q])
    share = max(LEAST * 20 / len(x), MultiIndex(x[:SAMPLE], len(x)).share(x[:SAMPLE], 20, TARGET))
    assert share < 0.5 and hit / (1000 * 20) >= 0.9


def test_multi_index_of_many_groups_and_blocks(spark, monkeypatch):
    """Small groups and blocks, of which most do not meet, find what large ones do."""
    from hammerline.llm import multi_index

    rng = np.random.default_rng(5)
    centres = 3 * rng.normal(size=(40, 16))
    x = centres[rng.integers(0, 40, 4000)] + 0.3 * rng.normal(size=(4000, 16))
    # A third of all rows are one vector, and some ids repeat.
    x[rng.random(4000) < 0.33] = centres[0]
    ids = [*range(3990), *range(10)]
    vectors = spark.createDataFrame([(i, v) for i, v in zip(ids, x.tolist(), strict=True)], "vec_id long, embedding array<double>")
    want = sorted(map(tuple, multi_index.nearest_vectors(vectors).collect()))
    for name, value in (("GROUP", 8), ("TOGETHER", 2), ("BLOCK", 64)):
        monkeypatch.setattr(multi_index, name, value)
    for bound in (multi_index.BROADCAST_ROWS, 0):
        monkeypatch.setattr(multi_index, "BROADCAST_ROWS", bound)
        got = sorted(map(tuple, multi_index.nearest_vectors(vectors).collect()))
        assert [r[:3] for r in got] == [r[:3] for r in want] and np.allclose([r[3] for r in got], [r[3] for r in want])
    assert len(want) == 200 * 20 and not any(q == i for q, _, i, _ in want)


def test_multi_index(spark):
    from hammerline.llm.multi_index import MultiIndex, nearest_vectors

    own = spark.read.parquet(f"{SF}/embeddings.parquet")
    n = own.count()
    odd = [(10**6, None), (10**6 + 20, [0.0] * 64), (10**6 + 40, [float("nan")] * 64), (10**6 + 60, [1.0, None] * 32), (10**6 + 80, [1.0] * 3), (None, [1.0] * 64)]
    both = own.select("vec_id", "embedding").union(spark.createDataFrame(odd, "vec_id long, embedding array<float>")).withColumn("cell", F.lit(1))
    got = nearest_vectors(both).collect()
    data = {r.vec_id: np.array(r.embedding, float) for r in own.collect()}
    ids = np.array(sorted(data))
    x = np.stack([data[i] for i in ids])
    hit = total = 0
    for q in ids[ids % 20 == 0]:
        mine = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        score = x @ data[q]
        others = sorted(((-s, i) for s, i in zip(score, ids, strict=True) if i != q))[:20]
        assert [m[0] for m in mine] == list(range(1, 21)) and all(s == pytest.approx(float(data[i] @ data[q]), abs=1e-12) for _, i, s in mine)
        hit += len({i for _, i in others} & {i for _, i, _ in mine})
        total += 20
    assert hit / total >= 0.9 and n == len(ids)
    assert nearest_vectors(both.limit(0)).count() == 0
    few = nearest_vectors(both.where("vec_id < 5")).collect()
    assert [r.query_id for r in few] == [0] * 4
    m = MultiIndex(np.random.default_rng(0).normal(size=(400, 8)), 10_000)
    q = np.random.default_rng(1).normal(size=8)
    walk = m.walk(q, np.inf, np.ones(m.k**2, int).tolist())
    sums = ((m.books[0] @ q[:4])[:, None] + (m.books[1] @ q[4:])[None]).ravel()[walk]
    assert len(set(walk)) == m.k**2 and (np.diff(sums) <= 1e-12).all()


def test_piece_table(spark, table, rows, empty):
    import public_tokenizers as P
    import sentencepiece
    from hammerline.llm.pieces import piece_ids

    odd = ["", " a", "  x  y ", "a  b\n\n  c ", "▁q w", "é́ x", "\t\t hi", "x\0y", "<s> </s> <unk> a", "  a", "日本 語", "a ▁ b", " ", "   "]
    more = spark.createDataFrame(list(enumerate(odd, 10**6)), "doc_id long, text string")
    both = table.select("doc_id", "text").union(more)
    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    texts = dict(rows) | dict(enumerate(odd, 10**6))
    for r in piece_ids(both, P.path("piece_bpe_32k.model")).collect():
        want = sp.encode(texts[r.doc_id] or "", add_bos=True, add_eos=True)
        assert np.frombuffer(r.ids, np.uint32).tolist() == want and r.decoded == sp.decode(want)
    assert piece_ids(empty, P.path("piece_bpe_32k.model")).count() == 0


def test_personal_data(spark, table, rows, empty):
    from hammerline.llm.pii import personal_spans, sanitise

    odd = ["a@b.com_x@y.z", "a@b..c d@e.f", "x 999.1.1.1 1.2.3.4.5 001.002.003.004", "4111 1111 1111 1111 and 4111-1111-1111-1112", "+1 (329) 555-7030. +12", "q@w.eu \U0001f600 z@z.z", "1 " * 3000, "+4111111111111111 5500005555555559", "+49.30.123456789x", "@@@a@b", "1" * 50000, "a" * 50000 + "@b.c"]
    names = [f"mail q@w.eu for zorblat {i} x\nother" for i in range(5)]
    more = spark.createDataFrame(list(enumerate(odd + names, 10**6)), "doc_id long, text string")
    texts = dict(rows) | dict(enumerate(odd + names, 10**6))
    got = {r.doc_id: r for r in personal_spans(table.select("doc_id", "text").union(more)).collect()}
    for i, t in texts.items():
        want = B.personal(t)
        assert got[i].base_spans == ",".join(want)
        assert (got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone) == tuple(sum(x.startswith(k) for x in want) for k in B.PII)
        assert got[i].spans.startswith(got[i].base_spans)
    assert "term:16:23" in got[10**6 + len(odd)].spans
    assert personal_spans(empty).count() == 0
    clean = {r.doc_id: r.text for r in sanitise(more).collect()}
    assert clean[10**6] == "[EMAIL][EMAIL]" and clean[10**6 + 2] == "x 999.1.1.1 [IP].5 [IP]" and clean[10**6 + len(odd)].startswith(" [EMAIL] for  0")
    assert sanitise(table).columns == table.columns


def disclosing(rows, share=0.8, floor=3, near=200):
    """The terms that disclose an entity, by plain recomputation."""
    import collections
    import re

    rows = list(dict.fromkeys(rows))
    kinds = B.PII | {"secret": "(?<![A-Za-z0-9])[A-Za-z0-9]{24,}"}
    terms = lambda s: {w for w in re.findall(r"[^\W_]+", s.lower()) if len(w) >= 4}
    met, entities, df = collections.defaultdict(set), collections.defaultdict(set), collections.Counter(w for _, t in rows for w in terms(t or ""))
    for i, t in rows:
        valid = {tuple(map(int, x.split(":")[1:])) for x in B.personal(t)}
        for kind, pattern in kinds.items():
            finds = list(re.finditer(pattern, t or ""))
            for before, m, after in zip([None, *finds], finds, [*finds[1:], None], strict=False):
                digits = len(re.sub("[^0-9]", "", m[0]))
                if m.span() not in valid if kind != "secret" else not 3 <= digits <= len(m[0]) - 3:
                    continue
                left = t[before.end() if before else 0 : m.start()].split("\n")[-1][-near:]
                right = t[m.end() : after.start() if after else len(t)].split("\n")[0][:near]
                place = left + "\1" + right
                entities[m[0]].add((i, place))
                for w in terms(place):
                    met[m[0], w].add((i, place))
    out = set()
    for (c, w), seen in met.items():
        own, enough = entities[c], [min(floor, len({x[k] for x in entities[c]})) for k in (0, 1)]
        n, both = len({i for i, _ in own}), len({i for i, _ in seen})
        if df[w] and both >= enough[0] and len({x for _, x in seen}) >= enough[1] and n < len(rows) and math.log(len(rows) * both / (n * (df[w] + 1))) >= share * math.log(len(rows) / n):
            out.add(w)
    return out


def test_a_word_tokenizer_that_joins_over_chunks_is_refused(tmp_path):
    import json

    from hammerline.llm.pieces import word_bpe_ids

    import public_tokenizers as P

    with open(P.path("word_bpe_49k.json"), encoding="utf-8") as f:
        model = json.load(f)
    for k, pattern in enumerate([r"\S+", r"[\p{L}]+ ?|[\p{N}]|[^\s\p{L}\p{N}]+ ?"]):
        model["pre_tokenizer"]["pretokenizers"][0].update(pattern={"Regex": pattern})
        path = tmp_path / f"{k}.json"
        path.write_text(json.dumps(model), encoding="utf-8")
        with pytest.raises(ValueError, match="chunk"):
            word_bpe_ids(str(path))


def test_terms_that_disclose_rare_entities(spark):
    from hammerline.llm.pii import personal_spans

    odd = [(i, f"some plain words that many texts hold, number {i}") for i in range(400)]
    odd += [(1000, "write to zq@rare.eu or blimfang about plain words"), (1001, "call +49 30 1234567 kwolp\nplain"), (1002, "call +49 30 1234567 kwolp trinx\nplain"), (1003, "blimfang again")]
    got = {r.doc_id: r.spans for r in personal_spans(spark.createDataFrame(odd, "doc_id long, text string")).collect()}
    at = odd[400][1].index("blimfang")
    assert f"term:{at}:{at + 8}" in got[1000] and got[1003] == "term:0:8" and not any(got[i] for i in range(400))
    # One entity in two texts: the term of both discloses it, that of only one does not.
    assert "term:20:25" in got[1002] and "term:26:31" not in got[1002]
    own = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    own += own[:40] + [(2000, " ".join(f"a{i}@b{i}.eu w{i}rd" for i in range(3000))), (2001, 'key = "0a1b2c3d4e5f60718293a4b5" of grumbold')]
    found = {}
    texts = dict(own)
    for r in personal_spans(spark.createDataFrame(own, "doc_id long, text string")).collect():
        for x in r.spans.split(","):
            if x.startswith("term:"):
                a, b = map(int, x.split(":")[1:])
                found.setdefault(texts[r.doc_id][a:b].lower(), []).append(x)
    assert set(found) == disclosing(own) and "grumbold" in found


def test_terms_of_a_text_with_thousands_of_finds(spark):
    import time

    from hammerline.llm.pii import personal_spans

    name = lambda i: "zo" + "".join(chr(97 + int(c)) for c in f"{i:06d}")
    took = {}
    for n in (1000, 16_000):
        lines = [f"a{i}@b{i}.eu {name(i)}" for i in range(n)]
        text, at = "\n".join(lines), 0
        rows = [(i, text) for i in range(3)] + [(i, "nothing to be told of") for i in range(3, 300)]
        begun = time.time()
        got = {r.doc_id: r for r in personal_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        took[n] = time.time() - begun
        want = []
        for x in lines:
            want.append(f"term:{at + len(x) - 8}:{at + len(x)}")
            at += len(x) + 1
        for i in range(3):
            assert got[i].n_email == n and got[i].spans.split(",")[n:] == want
    # Sixteen times the finds: far from the square.
    assert took[16_000] < 60 + 16 * took[1000]


def test_rows_without_ids_and_repeated_rows(spark):
    from hammerline.llm import crf_quality, jaccard_join, license_scan, packing, pieces, pii, ppm, quality_rules, suffix_dedup
    import public_tokenizers as P

    docs = spark.createDataFrame([(None, LONG * 3, None), (None, None, "en"), (5, LONG * 3, "en"), (5, LONG * 3, "en"), (7, LONG * 3, "en")], "doc_id long, text string, lang string")
    assert [r.n_removed > 0 for r in suffix_dedup.repeated_bytes(docs).orderBy(F.col("doc_id").asc_nulls_last()).collect()][:3] == [False, False, True]
    assert sorted(r.component_id for r in jaccard_join.jaccard_components(docs).collect() if r.n_shingles) == [5] * 4
    labels = spark.createDataFrame([(5, 1, 0), (None, 0, 0)], "doc_id long, quality int, toxic int")
    for out in (
        quality_rules.quality_verdicts(docs), crf_quality.quality_scores(docs, labels), license_scan.license_notices(docs), packing.pack_documents(docs, P.path("word_bpe_49k.json")),
        ppm.score_documents(docs), pieces.piece_ids(docs, P.path("piece_bpe_32k.model")), pii.personal_spans(docs),
    ):
        assert out.count() == 5
    assert jaccard_join.keep_one(docs).count() == 4
