"""How much work plans do, counted in rows and read from plans, beside what they return."""

import random

from helpers import base_counts, components, documents, prose
from pyspark.sql import functions as F

from quillmeter.llm import jaccard_join, quality_rules


def left_outer_rows(spark, since):
    """Rows that all left outer joins of the queries after ``since`` made."""
    spark._jsc.sc().listenerBus().waitUntilEmpty()
    store, rows = spark._jsparkSession.sharedState().statusStore(), 0
    for i in range(since, store.executionsCount()):
        execution = store.executionsList(i, 1).apply(0)
        values, nodes = store.executionMetrics(execution.executionId()), store.planGraph(execution.executionId()).allNodes()
        for node in (nodes.apply(k) for k in range(nodes.size())):
            if "Join" in node.name() and "LeftOuter" in node.desc():
                metrics = node.metrics()
                for m in (metrics.apply(k) for k in range(metrics.size())):
                    if m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                        rows += int(values.apply(m.accumulatorId()).replace(",", ""))
    return rows


def variants(r, n, changes):
    """``n`` copies of one text with as many words changed, most of them too far from each other to link."""
    base = prose(r, 150).split()
    out = []
    for _ in range(n):
        w = list(base)
        for i in r.sample(range(len(w)), r.randint(1, changes)):
            w[i] = prose(r, 1)
        out.append(" ".join(w))
    return out


def test_members_of_a_group_pass_few_left_joins(spark, monkeypatch):
    counted, regions = [], jaccard_join.region_members

    def counting(*args):
        out = regions(*args)
        counted.append(out.count())
        return out

    monkeypatch.setattr(jaccard_join, "region_members", counting)
    for n in (60, 120):
        texts = variants(random.Random(31), n, 12)
        docs = documents(spark, texts)
        before = spark._jsparkSession.sharedState().statusStore().executionsCount()
        got = {(x.doc_id, x.n_shingles, x.component_id) for x in jaccard_join.jaccard_components(docs, 5, 80, 100).collect()}
        assert got == components(list(enumerate(texts)), 5, 80, 100)
        made = left_outer_rows(spark, before)
        # Each join makes a row a region member or a class; before, they made more than ten together.
        assert counted[-1] > 3 * n and made <= 3 * (counted[-1] + n)


def test_grams_are_hashed_outside_lambdas(spark):
    r = random.Random(32)
    texts = ["", None, " \t ", "one", "a b", prose(r, 60), "a  b\ta\x0bb a b"]
    docs, labels = documents(spark, texts), spark.createDataFrame([(4, 1), (6, 1)], "doc_id long, quality int")
    got = quality_rules.gram_counts(docs, labels)
    assert "lambda" not in got._jdf.queryExecution().executedPlan().toString()
    words = documents(spark, texts).select("doc_id", quality_rules._words(F.coalesce("text", F.lit(""))).alias("w"))
    one, two = quality_rules._hashes(F.col("w"))
    want = words.select("doc_id", F.explode(F.concat(one, two)).alias("h")).groupBy((F.col("h") % 65536 + 65536) % 65536).agg(F.sum(F.col("doc_id").isin(4, 6).cast("int")), F.count("*"))
    assert {(x.bucket, x.trusted, x.corpus) for x in got.collect()} == {tuple(x) for x in want.collect()}


def test_counts_of_characters_take_no_walk_by_character(spark):
    texts = ["", None, " \n\t\n \n", "# one\n#|two$\n# one\n\x0b\n\x0b", "é ü 𝄞x <b>&\r\n<b>&\r\n", "%*%\x1c a b"]
    judged = quality_rules.quality_rules(documents(spark, texts), spark.createDataFrame([], "doc_id long, quality int"))
    assert "translate(" not in judged._jdf.queryExecution().analyzed().toString()
    got = {x.doc_id: (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) for x in judged.collect()}
    assert got == {i: base_counts(t) for i, t in enumerate(texts)}


def test_texts_and_lines_are_handed_on_by_few_steps(spark):
    r = random.Random(33)
    again = prose(r, 9)
    texts = [" \n" + prose(r, 60) + "\x0b\t", f"{again}\n\n {again}\r\n \n{again}", "\n", "a b c\td a b c", None, "x y z x y", "a  b\x0cc a\nb c "]
    judged = quality_rules.quality_rules(documents(spark, texts), spark.createDataFrame([], "doc_id long, quality int"))
    node, carried = judged._jdf.queryExecution().optimizedPlan(), {"__text": 0, "__l": 0}
    while True:
        names = {node.output().apply(i).name() for i in range(node.output().size())}
        carried = {c: n + (c in names) for c, n in carried.items()}
        if node.children().isEmpty():
            break
        node = node.children().head()
    # Before, each step copied whole texts, and lines with them, six and five times.
    assert 0 < carried["__text"] <= 2 and 0 < carried["__l"] <= 1
    got = {x.doc_id: (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) for x in judged.collect()}
    assert got == {i: base_counts(t) for i, t in enumerate(texts)}


def test_grams_are_counted_by_numbers(spark):
    rows = [(0, "a b", "en"), (1, "a b a", "es"), (2, "a b", None), (3, "b a", ""), (4, None, "en"), (5, "a", "nolabel"), (6, "a b", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = quality_rules.gram_counts(docs, spark.createDataFrame([(1, 1), (6, 1)], "doc_id long, quality int"))
    plans, types = [got._jdf.queryExecution().optimizedPlan()], set()
    for plan in plans:
        plans.extend(plan.children().apply(i) for i in range(plan.children().size()))
        if plan.nodeName() == "Aggregate":
            types |= {plan.groupingExpressions().apply(i).dataType().simpleString() for i in range(plan.groupingExpressions().size())}
    # Keys were a language's text and a number before.
    assert types and types <= {"int", "bigint"}
    sums = {x.lang: (x.trusted, x.corpus) for x in got.groupBy("lang").agg(F.sum("trusted").alias("trusted"), F.sum("corpus").alias("corpus")).collect()}
    assert sums == {"en": (3, 6), "es": (5, 5), "": (0, 6), "nolabel": (0, 1)}
    assert got.count() == got.select("lang", "bucket").distinct().count() and got.columns == ["lang", "bucket", "trusted", "corpus"]
