import re

import corpus_pipeline
import __spark_entry__ as entry
from graphloom.llm import mixing, packing, quality
from graphloom.llm.common import table

from test_minhash import brute
from test_secrets import brute_base

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark, tmp_path):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    stages = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        path = str(tmp_path / name)
        out.write.parquet(path)
        before, docs = docs, spark.read.parquet(path)
        stages[name] = before.collect(), docs.collect()
        if name != "packing":
            assert docs.columns == columns
    # quality: the rows that the operator keeps
    kept = {r["doc_id"] for r in quality.resample(table(spark, SF, "documents"), table(spark, SF, "labels")).where("kept").collect()}
    assert {r["doc_id"] for r in stages["quality"][1]} == kept
    # near-duplicates: by all pairs
    before = sorted(stages["dedup"][0], key=lambda r: r["doc_id"])
    expected = {before[c]["doc_id"] for i, (_, c) in enumerate(brute([r["text"] for r in before])) if c == i}
    assert {r["doc_id"] for r in stages["dedup"][1]} == expected and len(stages["dedup"][1]) == len(expected)
    # secrets: no base span is left, texts without one stay
    after = {r["doc_id"]: r["text"] for r in stages["secrets"][1]}
    for r in stages["secrets"][0]:
        if brute_base(r["text"]):
            assert "[SECRET]" in after[r["doc_id"]] and not brute_base(after[r["doc_id"]])
        else:
            assert after[r["doc_id"]] == r["text"]
    # mixing and packing: the numbers of the operators, all words packed
    again = mixing.mix(spark.read.parquet(str(tmp_path / "secrets")), mixing.label_weights(table(spark, SF, "labels"))).collect()
    assert sum(r["taken"] for r in again) == sum(len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) for r in stages["mixing"][1])
    assert sum(r["length"] for r in stages["packing"][1]) == sum(r["taken"] for r in again)
    assert sorted(map(str, corpus_pipeline.run(spark, SF).collect())) == sorted(map(str, stages["packing"][1]))


def test_odd_tables(spark, tmp_path):
    from llm_data import ODD, documents

    df = documents(spark, [*ODD, *ODD]).unionByName(documents(spark, ODD[:3]).selectExpr("cast(null as bigint) as doc_id", "text", "lang", "cast(null as string) as source", "n_chars", "component_id", "score", "kept"))
    for start in (df, df.limit(0)):
        docs = start
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF)
            assert docs.count() >= 0
            if name != "packing":
                assert docs.columns == df.columns


def test_registered():
    names = list(entry.queries())
    assert [n for n in names if n.startswith("op")] == ["op1_media", "op2_toxicity", "op3_packing", "op4_mixing", "op5_langid", "op6_quality", "op7_minhash", "op8_spotsigs", "op9_html", "op10_secrets"]
    assert "pipeline" in names and [n for n, _ in corpus_pipeline.STAGES] == ["quality", "dedup", "secrets", "mixing", "packing"] and packing.MAX_LEN
