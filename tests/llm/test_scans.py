import math
import random
import zlib

import brute
import numpy as np
import public_tokenizers
import pytest
from conftest import passage

from cairn.llm import common, decontam, license, tokens, topk


def test_license_matches_brute_force(docs, texts):
    phrases = [(t.label, t.text) for t in license.BASE]
    for r in license.license_scan(docs).collect():
        text = texts[r.doc_id][1] or ""
        base = brute.license_base(text, phrases)
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base
        shares = [(t.label, brute.containment(text, t.text, t.threshold)) for t in license.NOTICES]
        assert r.labels == ",".join(sorted(set(filter(None, base[4].split(","))) | {n for n, s in shares if s}))
        assert r.score == pytest.approx(max([1.0 if base[1] else 0.0] + [s for _, s in shares]))


def test_license_notices(spark, empty):
    assert license.license_scan(empty).count() == 0
    rows = [(1, "x. Licensed under CC BY-NC 4.0."), (2, "This WORK is licensed under the GNU General\nPublic License, version 3."), (3, "mit")]
    got = {r.doc_id: (r.base_labels, r.labels) for r in license.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ("", "cc-by-nc"), 2: ("gpl", "gpl"), 3: ("", "")}


def test_license_on_long_repeated_text_null_ids_and_repeated_rows(spark):
    n = 200_000
    rows = [(1, "mit license of the terms " * (n // 5), 1, "q"), (None, "MIT License", 2, "q"), (None, None, 3, "q"), (4, "mit license", 4, "q"), (4, "mit license", 4, "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words int, blocks string")
    got = sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.score) for r in license.license_scan(df).collect()), key=str)
    assert got == [(1, n, n // 5, 0, n - 5, 1.0), (4, 2, 1, 0, 0, 1.0), (4, 2, 1, 0, 0, 1.0), (None, 0, 0, None, None, 0.0), (None, 2, 1, 0, 0, 1.0)]


def test_license_blocks_match_brute_force(spark):
    rng = random.Random(12)
    notices = (license.Template("x", "a b c d e f g h", 0.7), license.Template("y", "d d a k a", 0.6), license.Template("z", "a b a", 1.0, True))
    docs = [(i, " ".join(rng.choice("abcdefghijk") for _ in range(rng.randrange(1, 60)))) for i in range(150)]
    for r in license.license_scan(spark.createDataFrame(docs, "doc_id long, text string"), (), notices).collect():
        words, want = docs[r.doc_id][1].split(), {}
        for t in notices:
            for s in range(max(1, len(words) - len(t.words) + 1)):
                block = words[s : s + len(t.words)]
                share = float(block == t.words) if t.phrase else len(set(block) & t.tokens) / len(t.tokens)
                if share >= t.threshold - 1e-9:
                    want[t.label, s] = share
        got = {(b.label, s): b.share for b in r.blocks or [] for s in range(b.first, b["last"] + 1)}
        assert got == pytest.approx(want)


def test_contaminated_matches_brute_force(spark, empty):
    rng = random.Random(9)
    items = [(i, passage(rng, n)) for i, n in enumerate((20, 20, 33, 3, 5, 50))] + [(6, ""), (7, None), (8, "?!")]
    near = items[2][1].split()
    near[1] = "changed"
    docs = [(i, passage(rng, 80) + " " + items[i % 6][1].upper() + ". " + passage(rng, 40)) for i in range(12)]
    docs += [(20, passage(rng, 40) + " " + " ".join(near)), (21, items[5][1][:-40]), (22, None), (23, ""), (24, passage(rng, 300))]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontam.contaminated(d, b).collect()}
    assert got == pytest.approx(brute.contaminated([x for x in docs if x[1]], [x for x in items if x[1]], 5, 80))
    assert {r.doc_id for r in decontam.drop_contaminated(d, b).collect()} == {i for i, _ in docs} - {i for i, _ in got}
    assert decontam.contaminated(empty, b).count() == 0 == decontam.contaminated(d, b.limit(0)).count()


def test_multi_index_finds_everything_within_the_radius():
    rng = np.random.default_rng(2)
    prints = rng.integers(0, 2**64, 300, dtype=np.uint64)
    queries = prints.copy()
    for i in range(300):
        for bit in rng.choice(64, rng.integers(0, 25), replace=False):
            queries[i] ^= np.uint64(1) << np.uint64(bit)
    q, p = decontam.MultiIndex(prints).near(queries)
    want = {(i, j) for i in range(300) for j in np.flatnonzero(np.bitwise_count(queries[i] ^ prints) <= decontam.RADIUS)}
    assert set(zip(q.tolist(), p.tolist())) == want


def test_radius_keeps_the_miss_probability():
    """At similarity 0.8 the shingle vectors have cosine 8 / 9, so a bit differs with probability acos(8 / 9) / pi."""
    p = math.acos(8 / 9) / math.pi
    miss = sum(math.comb(64, k) * p**k * (1 - p) ** (64 - k) for k in range(decontam.RADIUS + 1, 65))
    assert miss < 2e-5 and decontam.RADIUS < 2 * decontam.BLOCKS


def test_tokens_round_trip(spark, docs, texts, empty, tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    more = [(1000, "A<|endoftext|>b <|ENDOFTEXT|> ÀÉ é İ İ x. y,z .. q.\x1cw  n it's IT'S"), (None, "null id"), (1001, "a b 𝒳 ß"), (-(2**63), "least id"), (7, "again")]
    rows = docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    width = tokens.id_width(path)
    assert width == 2
    start, want = 0, []
    rows_in_order = sorted([*texts, (1000, more[0][1]), (1001, more[2][1]), (7, "again")], key=lambda r: r[0])
    seventh = [r for r in rows.withColumn("rk", common.row_key("doc_id", "text")).where("doc_id = 7").orderBy("rk").collect()]
    rows_in_order = [(i, t) for i, t in rows_in_order if i < 7] + [(7, r.text) for r in seventh] + [(i, t) for i, t in rows_in_order if i > 7]
    for i, t in [(None, "null id"), (-(2**63), "least id"), *rows_in_order]:
        ids = plain.encode(t or "", add_special_tokens=False).ids + [1]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    for n, w in enumerate((2, 4)):
        folder = f"file://{tmp_path}/t{n}"
        got = tokens.read_tokens(tokens.write_tokens(rows, folder, path, 1, width=w), folder, w).collect()
        assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    folder = f"{tmp_path}/none"
    assert tokens.read_tokens(tokens.write_tokens(empty, folder, path, 1), folder).count() == 0


def test_tokenizers_that_join_across_white_space_get_whole_texts(spark, docs, tmp_path):
    from tokenizers import Tokenizer

    cased = public_tokenizers.path("byte_bpe_50k.json")
    assert tokens.splits(public_tokenizers.path("word_bpe_49k.json")) == (True, True) and tokens.splits(cased) == (False, False)
    plain, folder = Tokenizer.from_file(cased), f"file://{tmp_path}/cased"
    got = {r.doc_id: r.ids_crc32 for r in tokens.read_tokens(tokens.write_tokens(docs, folder, cased, 1), folder).collect()}
    for r in docs.collect():
        ids = plain.encode(r.text or "", add_special_tokens=False).ids + [1]
        assert got[r.doc_id] == zlib.crc32(np.array(ids, "<u4").tobytes())


def test_top_k_in_several_blocks_and_with_clashing_columns(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i, v, i, v) for i, v in enumerate(rng.integers(-3, 4, (200, 8)).astype(float).tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, id long, v array<double>")
    want = sorted(map(tuple, topk.top_k(df, df, k=7, factor=1.0).collect()))
    score = np.array([v for _, v, _, _ in rows]) @ np.array([v for _, v, _, _ in rows]).T
    brute_force = [(i, n + 1, j, int(score[i, j])) for i in range(200) for n, j in enumerate(sorted((j for j in range(200) if j != i), key=lambda j: (-score[i, j], j))[:7])]
    assert want == brute_force
    for block, first in ((17, 3), (200, 50)):
        monkeypatch.setattr(topk, "QUERY_BLOCK", block)
        monkeypatch.setattr(topk, "FIRST", first)
        assert sorted(map(tuple, topk.top_k(df, df, k=7, factor=1.0).collect())) == want


def test_top_k_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(i, v) for i, v in enumerate(np.round(rng.normal(0, 0.3, (300, 24)), 1).tolist())]
    rows += [(7, rows[7][1]), (400, None), (401, [None] * 24), (402, [float("nan")] * 24), (None, rows[1][1]), (403, [1.0]), (404, [1e30] * 24), (405, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in topk.top_k(df, df.where("vec_id % 20 = 0"), k=20).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    good = [(i, np.floor(64 * np.array(v)).astype(object)) for i, v in rows if i is not None and v and len(v) == 24 and None not in v and np.isfinite(v).all()]
    for i, q in good:
        if i % 20 == 0:
            best = sorted((-min(int(sum(q * c)), 2**63 - 1), j) for j, c in good if j != i)[:20]
            assert sorted(got[i]) == [(n + 1, j, -s) for n, (s, j) in enumerate(best)]
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0
