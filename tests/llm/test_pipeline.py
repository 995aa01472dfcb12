import os
import random

import pytest
from helpers import base_counts, components, deduplicated, documents, prose
from pyspark.sql import functions as F

import corpus_pipeline
from quillmeter.llm import decontaminate, registry

DATA = "/root/testdata/sf0.001"


def test_stages_do_their_work(spark, tmp_path):
    r = random.Random(12)
    item = prose(r, 25)
    clean = [prose(r, 120) for _ in range(20)]
    w = clean[3].split()
    w[60] = "changed"
    line = prose(r, 60)
    texts = [*clean, " ".join(w), clean[0], "too short", prose(r, 80) + " " + item, line + "\n" + prose(r, 70), line.upper() + "\n" + prose(r, 70), "again " * 90, None]
    docs = documents(spark, texts)
    folder = str(tmp_path)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1) for i in range(25)], "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(7, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = docs.columns

    def step(i, docs):
        out = corpus_pipeline.STAGES[i][1](spark, docs, folder)
        return out, {x.doc_id: x.text for x in out.collect()}

    out, kept = step(0, docs)
    assert out.columns == names and set(kept) == {i for i, t in enumerate(texts) if (c := base_counts(t))[0] >= 50 and 100 * c[4] <= 50 * c[0]}
    before = list(kept.items())
    out, kept = step(1, out)
    drops = {d: n for d, _, n, _ in deduplicated(before)}
    assert drops[21] == 1 and 21 not in kept and drops[25] == 1 and line.upper() not in kept[25] and line in kept[24]
    out, left = step(2, out)
    assert set(left) == {d for d, _, c in components(list(kept.items()), 5, 80, 100) if c == d} and 20 not in left and set(range(20)) <= set(left)
    out, rest = step(3, out)
    assert set(left) - set(rest) == {23}
    final, sampled = step(4, out)
    assert set(sampled) <= set(rest) and {"weight", "probability", "copies"} <= set(final.columns)
    assert {x.doc_id for x in corpus_pipeline.run(spark, folder).collect()} == set(sampled)


def test_odd_rows_pass_the_stages(spark, tmp_path):
    r = random.Random(14)
    a, b, item, line = prose(r, 120), prose(r, 120), prose(r, 25), prose(r, 12)
    texts = [(1, a), (1, a), (None, a), (None, b), (None, f"{prose(r, 80)} {item}"), (4, f"{line}\n{prose(r, 80)}"), (None, f"{line}\n{prose(r, 80)}"), (6, None), (7, ""), (8, "word " * 9)]
    folder = str(tmp_path)
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("kept", "n_words", "llr", "n_lines", "n_dropped", "component_id", "distance"):
        docs = docs.withColumn(name, F.lit(f"my {name}"))
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, 1), (4, 1), (None, 0)], "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(7, item), (None, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs = step = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        step = stage(spark, step, folder)
        assert step.columns == docs.columns and step.schema == docs.schema
        assert all(x[c] == f"my {c}" for x in step.collect() for c in docs.columns[5:])
    kept = step.collect()
    assert {(x.doc_id, (x.text or "")[:20]) for x in kept} == {(1, a[:20]), (None, b[:20]), (4, line[:20]), (None, texts[6][1][:20])} and len(kept) == 4
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{folder}/empty/{name}.parquet")
    docs.limit(0).write.parquet(f"{folder}/empty/documents.parquet")
    assert corpus_pipeline.run(spark, f"{folder}/empty").count() == 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_decontamination_query_equals_brute_force(spark):
    items = {x.item_id: decontaminate.canonical(x.text) for x in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()}
    want = set()
    for x in spark.read.parquet(f"{DATA}/documents.parquet").collect():
        text = decontaminate.canonical(x.text)
        if any(i in text for i in items.values()):
            want.add(x.doc_id)
    got = registry.QUERIES["op7_benchmark_decontamination"](spark, DATA).where(F.col("least_distance") == 0)
    assert {x.doc_id for x in got.collect()} == want


def test_all_are_registered():
    assert [n.split("_")[0] for n in registry.QUERIES] == [f"op{i}" for i in range(1, 11)]
    assert [n for n, _ in corpus_pipeline.STAGES] and len(corpus_pipeline.STAGES) == 5
