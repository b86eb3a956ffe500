import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline
from cairn.llm import decontam, mixing, neardup, queries


def test_stages_keep_columns_and_take_effect(spark, docs, tmp_path):
    base = docs.select("doc_id", "text", "lang", "source", "n_chars")
    base.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 9 > 0), 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    passage = base.where("doc_id = 10").first().text
    spark.createDataFrame([(0, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows, kept = base, {}
    for name, stage in corpus_pipeline.STAGES:
        before, rows = rows, stage(spark, rows, str(tmp_path))
        kept[name] = rows.count()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert rows.columns == base.columns
        if name == "near-duplicates":
            assert kept[name] == len({r.component_id for r in neardup.near_duplicates(before).collect()})
        if name == "decontamination":
            assert kept[name] == before.count() - decontam.contaminated(before, spark.createDataFrame([(0, passage)], "item_id long, text string")).count()
        if name == "mixing":
            assert kept[name] == sum(r.copies for r in mixing.mix_counts(before).collect())
    assert kept["sharding"] == kept["mixing"]
    assert {"shard", "slot", "law"} <= set(rows.columns)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == kept["sharding"]


def test_every_operator_has_its_query():
    assert [n.split("_")[0] for n in queries.queries()] == [f"op{i}" for i in range(1, 11)]
    assert set(queries.oracle_sql()) <= set(queries.queries())
