"""Nulls, repeated rows, ties, very long texts, clashing columns and empty tables, operator by operator."""

import random
import sys
from collections import Counter
from pathlib import Path

import brute
import pytest
from conftest import passage
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

from cairn.llm import common, decontam, mixing, sharding


def test_sharding_of_nulls_repeated_rows_and_large_groups(spark):
    rows = [(None, "x" * 900), (None, None), (1, "x" * 900), (1, "x" * 900), (2, "b"), (2, "b"), (3, None), (4, "")]
    df = spark.createDataFrame([(i, t, 9, "law") for i, t in rows], "doc_id long, text string, slot int, law string")
    for shards in (2, 20):
        got = sharding.shard_documents(df, shards).collect()
        assert Counter((r.doc_id, r.text) for r in got) == Counter(rows) and {r.law for r in got} == {"bytes"}
        where = {}
        for r in got:
            assert where.setdefault(r.text, r.shard) == r.shard and 0 <= r.shard < shards
        groups, order = Counter(), []
        for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, str(r[1]))):
            groups[t] += len(t or "") + 1
            order += [t] if t not in order else []
        loads = Counter()
        for r in got:
            loads[r.shard] += r.size
        assert max(loads.values()) == 3 * 901 == max(groups.values())  # one group is above an even share
        for s in loads:
            assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))


def test_mixing_of_nulls_and_repeated_ids_comes_near_its_targets(spark):
    rng = random.Random(1)
    rows = [(i, passage(rng, rng.randrange(1, 40)), s) for i, s in enumerate(rng.choices(["a", "b", "c", None], [6, 1, 1, 1], k=3000))]
    rows += [(None, "one two", "a"), (5, rows[5][1], rows[5][2]), (5, rows[5][1], rows[5][2]), (9000, None, "b"), (9001, "  ", "zero")]
    df = spark.createDataFrame([(*r, 1.0, "n") for r in rows], "doc_id long, text string, source string, target double, size string")
    got = mixing.mix_counts(df).collect()
    assert len(got) == len(rows)
    taken, target = Counter(), {}
    source = {(i, len(brute.space_words(t))): s for i, t, s in rows}
    for r in got:
        s = source[r.doc_id, r.size]
        taken[s] += r.taken
        target[s] = r.target
        assert r.taken <= 3 * r.size
    for s, t in target.items():
        assert taken[s] == pytest.approx(t, rel=0.08)
    assert len({r.taken for r in got if r.doc_id == 5}) == 1
    assert mixing.mix(df).columns == df.columns


def test_decontamination_of_repeats_nulls_long_texts_and_turns(spark, monkeypatch):
    rng = random.Random(2)
    items = [(i, passage(rng, 30)) for i in range(12)] + [(3, passage(rng, 30)), (None, passage(rng, 25))]
    items += [items[0], items[0]]
    long = passage(rng, 30_000)
    docs = [(i, passage(rng, 20) + " " + items[i][1] + " " + passage(rng, 20)) for i in range(14)]
    docs += [docs[1], docs[1], (None, docs[2][1]), (50, long + " " + items[4][1] + " " + long), (51, None), (52, ""), (53, long)]
    d = spark.createDataFrame([(i, t, 0, "z") for i, t in docs], "doc_id long, text string, item_id int, similarity string")
    b = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    run = lambda: Counter((r.doc_id, r.item_id, round(r.similarity, 9)) for r in decontam.contaminated(d, b).collect())
    want = run()
    for i in range(14):
        assert want[i, items[i][0], 1.0] == (3 if i == 1 else 1)
    assert want[None, 2, 1.0] == 1 and want[50, 4, 1.0] == 1 and not any(i in (51, 52, 53) for i, _, _ in want)
    monkeypatch.setattr(decontam, "ITEMS", 8)
    assert run() == want
    kept = decontam.drop_contaminated(d, b)
    assert kept.columns == d.columns and sorted(r.doc_id for r in kept.collect()) == [51, 52, 53]


def test_decontamination_finds_windows_at_the_threshold(spark):
    """Weighted similarity only just 0.8: 96 shingles, of which 86 or more are shared."""
    items, docs = [], []
    for p in range(200):
        w = [f"p{p}w{j}" for j in range(100)]
        v = list(w)
        v[40], v[70] = f"x{p}", f"y{p}"  # ten shingles differ: 86 of 106
        items.append((p, " ".join(w)))
        docs.append((p, " ".join(v)))
    got = decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    found = {(r.doc_id, r.item_id): r.similarity for r in got.collect()}
    assert found == pytest.approx({(p, p): 86 / 106 for p in range(200)})


def test_pipeline_on_empty_tables_and_odd_rows(spark, docs, tmp_path):
    import corpus_pipeline

    base = docs.select("doc_id", "text", "lang", "source", "n_chars")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(0, "no such passage stands in any of these documents")], "item_id long, text string")
    odd = base.limit(30).union(spark.createDataFrame([(None, None, None, None, None), (1, None, "en", "a", 0), (1, None, "en", "a", 0)], base.schema)).union(base.limit(30))
    odd = odd.withColumn("shard", F.lit("clash")).withColumn("_rk", F.lit(1)).withColumn("size", F.lit(None).cast("double"))
    for name, d, y, b in (("none", base.limit(0), labels.limit(0), items.limit(0)), ("odd", odd, labels, items), ("bare", base, labels.limit(0), items.limit(0))):
        for table, df in (("documents", d), ("labels", y), ("benchmark", b)):
            df.write.parquet(f"{tmp_path}/{name}/{table}.parquet")
        got = corpus_pipeline.run(spark, f"{tmp_path}/{name}")
        rows = got.collect()
        assert (not rows) == (name == "none") and set(d.columns) <= set(got.columns)
        assert all(r.law == "bytes" and 0 <= r.shard < corpus_pipeline.SHARDS for r in rows)


def test_scratch_needs_a_shared_folder_on_a_cluster():
    class Cluster:
        class conf:
            get = staticmethod(lambda *_: None)

        class sparkContext:
            master = "spark://somewhere:7077"

    with pytest.raises(ValueError):
        common.scratch(Cluster)
