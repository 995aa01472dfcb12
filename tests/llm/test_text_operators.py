import math
import random

import pytest
import xxhash
from helpers import WORD, base_counts, components, deduplicated, documents, edit_distance_within, prose
from pyspark.sql import functions as F

from quillmeter.llm import decontaminate, jaccard_join, line_dedup, quality_rules
from quillmeter.llm.common import seen_twice, twice_filter

ODD = [None, "", " \n\t", "one", "one two three", "ÀÉ ßx 漢字 🙂", "a\x0bb\x0cc\rd\xa0e", "x " * 3000 + "end"]


def near_copies(r, base, n):
    words = base.split()
    out = []
    for _ in range(n):
        w = list(words)
        for _ in range(r.randint(0, 4)):
            w[r.randrange(len(w))] = prose(r, 1)
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize(("packed", "k", "num"), [(1 << 19, 4, 85), (500, 5, 80)])
def test_components_equal_brute_force(spark, packed, k, num):
    r = random.Random(3)
    passage, texts = prose(r, 30), list(ODD)
    for g in range(6):
        base = prose(r, r.choice((12, 60, 150)))
        texts += near_copies(r, base, 12) + [base] * 3
    texts += [prose(r, 40) + " " + passage + " " + prose(r, r.randint(1, 40)) for _ in range(60)]
    texts += [passage.upper(), passage]
    got = jaccard_join.jaccard_components(documents(spark, texts), k, num, 100, packed).collect()
    assert {tuple(x) for x in got} == components(list(enumerate(texts)), k, num, 100)


def test_large_regions_are_cut_without_loss(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 1500)
    r = random.Random(5)
    base = prose(r, 80)
    texts = near_copies(r, base, 90) + near_copies(r, near_copies(r, base, 1)[0], 40)
    got = jaccard_join.jaccard_components(documents(spark, texts)).collect()
    assert {tuple(x) for x in got} == components(list(enumerate(texts)), 4, 85, 100)


def test_recursive_cells_find_what_one_leaf_finds():
    import numpy as np

    r = np.random.default_rng(1)
    base = np.sort(r.integers(0, 2**62, 120).astype(np.uint64))
    sets = [np.unique(np.concatenate([r.choice(base, 110, replace=False), r.integers(0, 2**62, r.integers(0, 14)).astype(np.uint64)])) for _ in range(400)]
    sets += [np.unique(r.integers(0, 2**62, 100).astype(np.uint64)) for _ in range(200)]
    n = len(sets)
    args = (np.ones(n, bool), np.zeros(n, bool), np.zeros(n), np.ones(n), 85, 100)
    a, b = jaccard_join._Region(sets, *args), jaccard_join._Region(sets, *args)
    a.join(np.arange(n))
    b.leaf(np.arange(n))
    groups = lambda region: {frozenset(np.flatnonzero(region.root == x)) for x in set(region.root)}
    assert groups(a) == groups(b)


def test_components_odd_rows(spark):
    docs = spark.createDataFrame([(1, "a b c d e"), (1, "a b c d e"), (None, "a b c d e"), (2, "A B C D E"), (3, None)], "doc_id long, text string").withColumn("n", F.lit("x")).withColumn("component", F.lit(1))
    got = sorted(map(tuple, jaccard_join.jaccard_components(docs).collect()), key=str)
    assert got == sorted([(1, 2, 1), (1, 2, 1), (None, 2, None), (2, 2, 1), (3, 0, 3)], key=str)
    assert jaccard_join.jaccard_components(docs.limit(0)).count() == 0
    assert jaccard_join.keep_one_per_component(docs).where("doc_id = 2").count() == 0


def test_one_row_of_each_group_stays(spark):
    r = random.Random(23)
    a, b, x, y = (prose(r, 60) for _ in range(4))
    near = " ".join([*a.split()[:-1], "other"])
    rows = [(1, a, "p"), (1, a, "q"), (None, a, "r"), (2, near, "s"), (None, near, "t"), (None, b, "u"), (None, b, "v"), (5, x, "w"), (5, y, "w"), (7, None, "z"), (7, None, "z"), (None, " ", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component string").withColumn("m", F.map_from_arrays(F.array(F.lit("k")), F.array("component")))
    kept = jaccard_join.keep_one_per_component(docs)
    got = kept.collect()
    assert kept.columns == docs.columns
    assert sorted((str(g.doc_id), g.text) for g in got if g.text and g.text != " ") == sorted([("1", a), ("None", b), ("5", x), ("5", y)])
    assert sum(not (g.text or "").strip() for g in got) == 3
    assert jaccard_join.keep_one_per_component(docs.limit(0)).count() == 0


def test_two_filters_hold_every_repeat(spark):
    keys = list(range(-3000, 3000)) + list(range(0, 500))
    df = spark.createDataFrame([(k,) for k in keys], "h long").repartition(7)
    import numpy as np

    bitmap = twice_filter(df, 1 << 20)
    found = seen_twice(bitmap, np.array(keys, np.int64).view(np.uint64))
    assert all(f for k, f in zip(keys, found, strict=True) if 0 <= k < 500)
    assert sum(found) < 1100


@pytest.mark.parametrize("bits", [1 << 29, 1 << 10])
def test_line_dedup_equals_brute_force(spark, bits):
    r = random.Random(7)
    pool = [prose(r, r.randint(1, 6)) for _ in range(60)]
    texts = [*ODD, "Short\nShort", "\n\n"] + ["\n".join(r.choice(("", "  ", "\t")) + r.choice((str, str.upper))(r.choice(pool)) for _ in range(r.randint(0, 9))) for _ in range(150)]
    rows = [(i if i % 17 else None, t) for i, t in enumerate(texts)] + [(20, texts[21]), (20, texts[21])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_lines", F.lit("mine"))
    got = line_dedup.drop_repeated_lines(docs, most_bits=bits).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(deduplicated(rows), key=str)
    assert line_dedup.drop_repeated_lines(docs.limit(0)).count() == 0


def test_quality_counts_and_scores_equal_brute_force(spark):
    r = random.Random(9)
    texts = [*ODD, "a b c a b c a b c", "x\nx\n\nx \ny|#", "aa b aab aa b aab"] + [prose(r, r.randint(1, 90), "abc") for _ in range(60)]
    docs = documents(spark, texts)
    labels = spark.createDataFrame([(i, i % 2) for i in range(len(texts))] + [(None, 1), (3, None)], "doc_id long, quality int")
    buckets = 1 << 8
    got = {x.doc_id: x for x in quality_rules.quality_rules(docs, labels, buckets).collect()}

    def hashed(*words):
        h = 42
        for w in words:
            h = xxhash.xxh64_intdigest(w.encode(), h)
        return (h - (1 << 64) if h >> 63 else h) % buckets

    grams = [[hashed(x) for x in w] + [hashed(a, b) for a, b in zip(w, w[1:], strict=False)] for w in (WORD.findall(t or "") for t in texts)]
    t, c = [0] * buckets, [0] * buckets
    for i, g in enumerate(grams):
        for x in g:
            c[x] += 1
            t[x] += i % 2
    for i, g in enumerate(grams):
        row, (n, chars, symbols, lines, again) = got[i], base_counts(texts[i])
        assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words) == (n, chars, symbols, lines, again)
        llr = sum(math.log((t[x] + buckets * c[x] / sum(c)) / (sum(t) + buckets)) - math.log(c[x] / sum(c)) for x in g) / len(g) if g else 0
        assert math.isclose(row.llr, llr, abs_tol=1e-9)
        failed = n < 50 or 100 * again > 50 * n
        assert row.base_failed == failed and row.kept == (not failed and row.llr >= quality_rules.THRESHOLD)


def test_repeats_of_texts_too_long_to_pack(spark, monkeypatch):
    monkeypatch.setattr(quality_rules, "_PLACE", 3)
    r = random.Random(25)
    texts = [*ODD, "a b c a b c a b c"] + [" ".join(r.choice("ab cde") for _ in range(r.randint(1, 40))) for _ in range(40)]
    got = quality_rules.quality_rules(documents(spark, texts), spark.createDataFrame([], "doc_id long, quality int")).collect()
    assert {x.doc_id: x.n_repeat_words for x in got} == {i: base_counts(t)[4] for i, t in enumerate(texts)}


def test_quality_odd_tables(spark):
    docs = documents(spark, ["w " * 60, None]).withColumn("kept", F.lit(1)).withColumn("n_words", F.lit("z"))
    labels = spark.createDataFrame([], "doc_id long, quality int")
    rows = quality_rules.quality_rules(docs, labels, keep_columns=True).orderBy("doc_id").collect()
    assert [r.llr for r in rows] == [0, 0] and [r.base_failed for r in rows] == [True, True]
    assert quality_rules.quality_rules(docs.limit(0), labels).count() == 0


def test_no_python_on_the_native_path(spark):
    docs = documents(spark, ["a b c"])
    plan = quality_rules.quality_rules(docs, spark.createDataFrame([(0, 1)], "doc_id long, quality int"))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_decontamination_equals_brute_force(spark):
    r = random.Random(11)
    items = [prose(r, 20) for _ in range(6)] + [None, "tiny", "", "?!"]
    texts = list(ODD)
    for item in items[:6]:
        for edits in (0, 1, 3, 12):
            s = list(item)
            for _ in range(edits):
                s[r.randrange(len(s))] = r.choice(("", "q", "zz"))
            texts.append(prose(r, 30) + " " + "".join(s).upper().replace(" ", ", \n") + " " + prose(r, 30))
        texts.append(prose(r, 20) + " " + item[: len(item) // 2])
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(x.doc_id, x.item_id, x.distance) for x in decontaminate.matches(documents(spark, texts), benchmark, block_chars=200).collect()}
    want = set()
    for d, t in enumerate(texts):
        for i, item in enumerate(items):
            p, c = decontaminate.canonical(item), decontaminate.canonical(t)
            if len(p) * decontaminate.ERROR_PERCENT >= 100 and c and (n := edit_distance_within(p, c)) <= len(p) * decontaminate.ERROR_PERCENT // 100:
                want.add((d, i, n))
    assert {x[:2] for x in got} == {x[:2] for x in want} and len(want) > 10
    assert got == want


def test_decontamination_odd_tables(spark):
    docs = documents(spark, ["a", None])
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contaminated(docs, empty).count() == 0
    assert decontaminate.drop_contaminated(docs.withColumn("item_id", F.lit(1)), empty).count() == 2
    assert decontaminate.drop_contaminated(docs.limit(0), empty).count() == 0


def test_short_items_match_whole_words(spark):
    items = spark.createDataFrame([(1, "Tiny item"), (2, "?!"), (3, "in")], "item_id long, text string")
    docs = documents(spark, ["a tiny\nITEM!", "a tiny items", "tinyitem", "inside", "tiny item", None, "?!"])
    assert {(x.doc_id, x.item_id, x.distance) for x in decontaminate.matches(docs, items).collect()} == {(0, 1, 0), (4, 1, 0)}


def test_rows_go_by_their_own_text(spark):
    r = random.Random(24)
    item, clean = prose(r, 20), prose(r, 30)
    rows = [(None, clean, 1), (None, f"{clean} {item}", 2), (3, item, 3), (3, clean, 4), (4, None, 5), (3, item, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, place long").withColumn("distance", F.lit("mine"))
    left = decontaminate.drop_contaminated(docs, spark.createDataFrame([(9, item), (9, item), (10, "x" * 90)], "item_id long, text string"), block_chars=100)
    assert left.columns == docs.columns and {x.place for x in left.collect()} == {1, 4, 5}


def test_pieces_make_up_the_item():
    for text in ("abcdefghij" * 9, "x" * 41):
        for budget in (0, 1, 5, 40):
            parts = decontaminate.pieces(text, budget)
            assert "".join(p for _, p in parts) == text and len(parts) == budget + 1


def test_sparse_trust_keeps_clean_documents(spark, tmp_path):
    # Half of the English and a tenth of the Spanish documents are trusted; the others are made alike.
    r = random.Random(17)
    docs = documents(spark, [prose(r, 120) for _ in range(160)]).withColumn("lang", F.when(F.col("doc_id") < 120, "en").otherwise("es"))
    folder = str(tmp_path)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1) for i in range(160) if i % (2 if i < 120 else 10) == 0], "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
    rows = quality_rules.op3_quality_rules(spark, folder).collect()
    assert len(rows) == 160 and all(x.kept for x in rows)


def test_trusted_documents_are_judged_without_their_own_counts(spark):
    r = random.Random(18)
    texts = [prose(r, r.randint(1, 90), "abc") for _ in range(20)]
    docs, labels = documents(spark, texts), spark.createDataFrame([(i, 1) for i in range(10)], "doc_id long, quality int")
    got = {x.doc_id: x.llr for x in quality_rules.quality_rules(docs, labels, 1 << 8, threshold=None).collect()}
    for i in (0, 4, 9):
        # The same corpus with one trusted document less.
        rest = labels.where(F.col("doc_id") != i)
        assert math.isclose(got[i], {x.doc_id: x.llr for x in quality_rules.quality_rules(docs, rest, 1 << 8).collect()}[i], abs_tol=1e-9)


def test_items_without_an_id_count(spark):
    item = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(0, item), (None, item), (None, f"x {item}"), (3, item.replace("w39", "w38")), (3, "clean")], "doc_id long, text string")
    benchmark = spark.createDataFrame([(None, item), (None, item), (5, item), (5, None), (2, "w3 w4 w5")], "item_id long, text string")
    got = {x.doc_id: (x.contaminated, x.n_items, x["items"], x.least_distance) for x in decontaminate.contaminated(docs, benchmark).collect()}
    assert got == {0: (True, 4, "null,2,5", 0), None: (True, 4, "null,2,5", 0), 3: (True, 4, "null,2,5", 0)}
    assert [x.text for x in decontaminate.drop_contaminated(docs, benchmark).collect()] == ["clean"]
    near = decontaminate.matches(spark.createDataFrame([(1, "see quick brown foxy jump here")], "doc_id long, text string"), spark.createDataFrame([(1, "quick brown fox jump")], "item_id long, text string"))
    assert [(x.item_id, x.distance) for x in near.collect()] == [(1, 1)]  # 20 characters allow for one edit
