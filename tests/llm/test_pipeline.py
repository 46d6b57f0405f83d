"""The pipeline's stages on real and on odd tables, and the registered queries with SQL."""

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from check_queries import compare
from hostpulse.llm import decontamination, quality, queries

from .test_jaccard import brute

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_matches_sql(spark, name):
    same, text = compare(spark, DATA, name, queries.QUERIES[name], queries.SQL[name])
    assert same, text


def test_ten_queries_and_the_pipeline_are_registered():
    names = entry.queries()
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11)) and "pipeline" in names


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet").collect()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r for r in docs.collect()}
        stage(spark, docs, DATA).write.parquet(str(tmp_path / str(k)))
        out = spark.read.parquet(str(tmp_path / str(k)))
        after = {r.doc_id: r for r in out.collect()}
        assert set(after) <= set(before) and len(after) == out.count()
        if name != "sharding":
            assert out.columns == docs.columns and all(after[i] == before[i] for i in after)
        if name == "quality rules":
            model = quality.train(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
            verdict = quality.apply_rules(docs, model).collect()
            assert set(after) == {r.doc_id for r in verdict if r.kept}
        elif name == "n-gram Jaccard join":
            assert set(after) == {c for _, _, c in brute([(i, r.text) for i, r in before.items()])}
        elif name == "benchmark decontamination":
            assert set(before) - set(after) == {i for i, r in before.items() if any(
                decontamination.normalised(b.text) in decontamination.normalised(r.text) for b in bench)}
        elif name == "mixing sources":
            words = lambda rows: sum(len(quality._WORDS.findall(r.text)) for r in rows)
            assert 0.8 * words(before.values()) <= words(after.values()) <= 0.9 * words(before.values())
        else:
            assert set(after) == set(before)
            loads = [sum(r.shard == s for r in after.values()) for s in range(40)]
            assert max(loads) - min(loads) <= 1
        docs = out


def test_stages_take_odd_tables(spark, tmp_path):
    rows = [(None, None, None, None, 1), (1, "", "xx", "src99999999999", 2), (1, "word " * 20000, "en", "src1", 3), (1, "word " * 20000, "en", "src1", 3), (2, "a b", "de", None, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, Shard int")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), DATA).count() == 0, name
        out = stage(spark, docs, DATA)
        assert out.count() <= len(rows)
        if name != "sharding":
            assert out.columns == docs.columns
