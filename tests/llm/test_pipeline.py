"""The pipeline on a small corpus, against what each stage has to do."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loamcast.llm import links, registry

from .test_operators import docs, exact_repeats, prose, words_of


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("sf"))
    passage, item = prose(7000, 70), prose(8000, 30)
    rows = [(i, prose(i, 150)) for i in range(60)]
    rows += [(100 + i, f"{prose(i, 150)} more") for i in range(10)]  # near copies
    rows += [(200, prose(5, 150)), (201, None), (202, ""), (203, "1 2 3")]
    rows += [(300 + i, f"{prose(300 + i, 90)} {passage} {prose(400 + i, 90)}") for i in range(5)]
    rows += [(500, f"{prose(500, 100)} {item}"), (501, f"{prose(501, 4000)} {item} {prose(502, 4000)}")]
    docs(spark, rows).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, dict(rows), item


def test_stages(spark, corpus, tmp_path):
    folder, texts, item = corpus
    table = spark.read.parquet(f"{folder}/documents.parquet")
    kept, columns = {}, table.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, table, folder).write.parquet(f"{tmp_path}/{k}")
        table = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert table.columns == columns
            kept[name] = {r.doc_id: r.text for r in table.collect()}
    assert set(texts) - set(kept["language"]) == {201, 202, 203}
    assert set(kept["language"]) - set(kept["near_duplicates"]) == {200, *range(100, 110)}
    assert set(kept["passages"]) == set(kept["near_duplicates"])
    changed = {i for i, t in kept["passages"].items() if t != texts[i]}
    assert changed == {301, 302, 303, 304} and not exact_repeats(list(kept["passages"].items()))
    assert set(kept["passages"]) - set(kept["decontamination"]) == {500}
    packed = table.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("of")).collect()
    assert {r.doc_id for r in packed} == set(kept["decontamination"]) and all(r.n == r.of for r in packed)
    assert len(words_of(item)) == 30


def test_run_is_the_stages(spark, corpus):
    folder, _, _ = corpus
    got = corpus_pipeline.run(spark, folder)
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert got.select("doc_id").distinct().count() == 60 + 5 + 1


def test_run_of_nothing(spark, tmp_path):
    docs(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_components_both_ways(spark, monkeypatch):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(400, 460)] + [(500, k) for k in range(501, 560)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    expected = sorted((x, find(x)) for x in parent)
    frame = spark.createDataFrame(edges, "u long, v long")
    assert sorted(map(tuple, links.components(frame).collect())) == expected
    monkeypatch.setattr(links, "ONE_TASK", 0)
    assert sorted(map(tuple, links.components(frame).collect())) == expected
    assert links.components(frame.limit(0)).count() == 0


def test_queries_and_their_sql():
    numbers = sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES)
    assert numbers == list(range(1, 14)) and set(registry.ORACLE_SQL) <= set(registry.QUERIES)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "passages", "decontamination", "packing"]
