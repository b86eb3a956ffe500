import brute
import pytest

from cairn.llm import graph, neardup, substring


@pytest.mark.parametrize("k,percent", [(3, 85), (5, 80)])
def test_near_duplicates_match_brute_force(docs, texts, k, percent):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs, k, percent).collect()}
    assert got == brute.near_duplicates(texts, k, percent)


def test_near_duplicates_edges(spark, docs, empty):
    assert neardup.near_duplicates(empty).count() == 0
    rows = spark.createDataFrame([(None, "a b c d e f"), (7, "a b c d e f"), (7, "a b c d e f"), (9, None)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in neardup.near_duplicates(rows).collect()), key=str)
    assert got == [(7, 7, True), (7, 7, True), (9, 9, True), (None, None, True)]
    assert sorted((r.doc_id is None, r.text) for r in neardup.drop_near_duplicates(rows).collect() if r.text) == [(False, "a b c d e f"), (True, "a b c d e f")]
    kept = neardup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in neardup.near_duplicates(docs).where("kept").collect()}


def test_survivors_of_repeated_ids(spark):
    """Of a doc_id's rows in one group one stays; unrelated texts of one doc_id both stay."""
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = spark.createDataFrame([(7, a, "x"), (7, a, "x"), (7, a + " end", "y"), (7, b, "z"), (8, a, "w"), (None, a, "v"), (9, None, "u"), (9, None, "u")], "doc_id long, text string, rk string")
    got = neardup.drop_near_duplicates(rows)
    assert got.columns == rows.columns
    kept = sorted(((r.doc_id, (r.text or "")[:1]) for r in got.collect()), key=str)
    assert kept == [(7, "a"), (7, "b"), (9, ""), (9, ""), (None, "a")]


@pytest.mark.parametrize("large", [True, False])
def test_buckets_of_several_components(spark, monkeypatch, large):
    """One bucket for all: families of copies with edits of their own, some of them linked through a common member."""
    import random

    rng = random.Random(4)
    docs, i = [], 0
    for family in range(6):
        base = [f"f{family}w{j}" for j in range(80)]
        for _ in range(14):
            w = list(base)
            for _ in range(rng.choice([0, 1, 2, 3])):
                w[rng.randrange(80)] = f"e{rng.randrange(10**6)}"
            docs.append((i, " ".join(["common"] * 3 + w)))
            i += 1
    if large:
        monkeypatch.setattr(neardup, "RARE", 5)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(df, 3, 85, rows=1, bands=3).collect()}
    want = brute.near_duplicates(docs, 3, 85)
    full = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(df, 3, 85).collect()}
    assert full == want and {i: n for i, (n, _) in got.items()} == {i: n for i, (n, _) in want.items()}


def test_pairs_at_the_threshold_are_found(spark):
    """Recall on pairs whose similarity is only just enough."""
    docs = []
    for p in range(150):
        a = [f"p{p}w{j}" for j in range(302)]
        b = list(a)
        for e in range(0, 300, 25)[:8]:  # eight edits, three shingles each: 276 of 324 shared
            b[e + 5] = f"edit{p}x{e}"
        docs += [(2 * p, " ".join(a)), (2 * p + 1, " ".join(b))]
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), 3, 85).collect()}
    assert all(got[2 * p + 1] == 2 * p for p in range(150))


def test_repeats_come_from_the_automata(spark, monkeypatch):
    """Without the automata's matches nothing goes; with few runs a shard, streams split and tiny pieces nothing changes."""
    text = " ".join(f"w{i}" for i in range(90))
    docs = [(i, f"a{i} " + text + f" z{i}") for i in range(12)] + [(20, " ".join(f"u{i % 50}" for i in range(200))), (21, text[: len(text) // 2])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = sorted(brute.remove_repeats(docs, 20))
    run = lambda: sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring.remove_repeats(df, 20).collect())
    assert run() == want
    monkeypatch.setattr(substring, "SHARD_RUNS", 2)
    monkeypatch.setattr(substring, "STREAM_BYTES", 300)
    monkeypatch.setattr(substring, "PIECE_WORDS", 37)
    monkeypatch.setattr(substring, "HOME_WORDS", 16)
    assert run() == want


def test_automata_match_words_not_hashes():
    shard = substring.Shard(3)
    for place, phrase in (((1, 0), b"a b c"), ((2, 5), b"b c d")):
        shard.automata.add(tuple(phrase.split()), place)
    assert shard.stream(1, 0, b"a b c x".split()) == []  # the place itself proves nothing
    assert shard.stream(9, 4, b"x a b c d a b".split()) == [(9, 5, 9)]
    assert shard.stream(9, 0, b"b c e".split()) == []
    assert sorted(shard.origins()) == [(1, 0, 3), (2, 5, 8)]
    shard = substring.Shard(2)
    shard.automata.add((b"a", b"b"), (1, 0))
    assert shard.stream(1, 7, [b"a", b"c"]) == [] == shard.origins()


def test_bands_keep_the_miss_probability():
    assert (1 - 0.85**6) ** neardup.bands_for(0.85) <= 1e-5


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 102), (102, 101), (7, 7)]
    got = {r.node: r.label for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {100: 100, 101: 100, 102: 100}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("window", [35, 5])
def test_repeats_match_brute_force(docs, texts, window):
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring.remove_repeats(docs, window).collect()]
    assert sorted(got) == sorted(brute.remove_repeats(texts, window))


def test_repeats_edges(spark, empty):
    assert substring.remove_repeats(empty).count() == 0
    text = " ".join(map(str, range(40)))
    rows = spark.createDataFrame([(1, text), (1, text), (None, "a"), (None, None)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_words, r.n_removed) for r in substring.remove_repeats(rows).collect()), key=str)
    assert got == [(1, 40, 40), (1, 40, 40), (None, 0, 0), (None, 1, 0)]
