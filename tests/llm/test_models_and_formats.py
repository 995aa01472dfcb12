import collections
import copy
import gzip
import hashlib
import json
import math
import os
import random
import re
import zlib

import numpy as np
import pytest
from helpers import LOWER, documents, prose
from pyspark.sql import functions as F

from quillmeter.llm import chat_format, cotrain, mixing, registry, token_counts, toxicity, warc
from quillmeter.llm.common import word_hashes


@pytest.fixture(scope="module")
def tokenizer():
    public = pytest.importorskip("public_tokenizers")
    return public.path("byte_bpe_50k.json")


def test_fast_counts_equal_the_library(tokenizer):
    from tokenizers import Tokenizer

    r, library = random.Random(1), Tokenizer.from_file(tokenizer)
    parts = [*"ab  \n\t's é½漢🙂​　\xa0!?.,12", "<|endoftext|>", "don't", "\r\n", "\x85", "straße", " naïve"]
    texts = ["", "x" * 9000, " " * 900, *("".join(r.choice(parts) for _ in range(r.randint(0, 50))) for _ in range(3000))]
    assert token_counts.counter(tokenizer)(texts) == [len(x.ids) for x in library.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model"])
def test_other_files_use_their_library(name):
    public = pytest.importorskip("public_tokenizers")
    assert all(n > 0 for n in token_counts.counter(public.path(name))(["some words", "ein Satz"]))


@pytest.mark.parametrize("skip", [500_000, 0])
def test_cache_is_filled_once_and_used(spark, tokenizer, tmp_path, monkeypatch, skip):
    monkeypatch.setattr(token_counts, "SKIP_ROWS", skip)
    texts = ["a b", "a b", None, "", "c " * 600, "a b"]
    docs = documents(spark, texts).withColumn("digest", F.lit(1)).withColumn("n_tokens", F.lit("x"))
    cache = f"file://{tmp_path}/cache"
    run = lambda d: sorted((x.doc_id, x.n_bytes, x.n_tokens, x.over_limit) for x in token_counts.token_counts(d, tokenizer, cache).collect())
    first = run(docs)
    assert [x[1:] for x in first[:4]] == [(3, 2, False), (3, 2, False), (0, 0, False), (0, 0, False)] and first[4][3]
    stored = lambda: spark.read.parquet(cache).count()
    assert stored() == 3
    assert run(docs) == first and stored() == 3
    more = run(documents(spark, ["new", "a b"], first=10))
    assert stored() == 4 and more[1][2] == 2
    assert run(docs.limit(0)) == []


def test_equal_texts_of_equal_ids_are_stored_once(spark, tokenizer, tmp_path, monkeypatch):
    """Fifty rows without an id and twenty of one id hold two texts: two counts are stored, each encoded once."""
    rows = [(None, "same words here")] * 50 + [(7, "others")] * 20 + [(8, "others"), (9, "own")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    cache = f"file://{tmp_path}/cache"
    got = sorted((str(x.doc_id), x.n_tokens) for x in token_counts.token_counts(docs, tokenizer, cache).collect())
    assert len(got) == 72 and len(set(got)) == 4
    assert spark.read.parquet(cache).count() == 3


def test_query_counts_as_the_library(spark, tokenizer):
    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no test tables")
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer)
    texts = {x.doc_id: x.text or "" for x in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    got = {x.doc_id: (x.n_bytes, x.n_tokens, x.over_limit) for x in token_counts.op5_token_counts(spark, "/root/testdata/sf0.001").collect()}
    want = {i: len(library.encode(t, add_special_tokens=False).ids) for i, t in texts.items()}
    assert got == {i: (len(texts[i].encode()), n, n > 512) for i, n in want.items()}


def test_raking_meets_the_targets(spark):
    r = random.Random(2)
    docs = documents(spark, [prose(r, r.randint(1, 300)) for _ in range(200)])
    want = {"source": {"src0": 0.6, "src1": 0.3, "src2": 0.1}, "topic": {"brief": 0.5, "prose": 0.5}}
    rows = mixing.mix(docs, want, rounds=40).collect()
    total = sum(x.n_tokens for x in rows)
    for name, share in want["source"].items():
        assert abs(sum(x.n_tokens * x.weight for x in rows if x.source == name) / total - share) < 1e-6
    assert all(int(x.weight) <= x.copies <= int(x.weight) + 1 for x in rows)
    again = mixing.mix(docs, want, rounds=40, most_cells=0).collect()
    key = lambda x: x.doc_id
    assert all(abs(a.weight - b.weight) < 1e-9 and a.copies == b.copies for a, b in zip(sorted(rows, key=key), sorted(again, key=key), strict=True))


def test_mixing_odd_rows(spark):
    docs = spark.createDataFrame([(None, None, None, None, 0), (1, "", None, "en", 0), (1, "a | b", "s", "en", 0), (1, "a | b", "s", "en", 0)], "doc_id long, text string, source string, lang string, n_chars long").withColumn("weight", F.lit("w"))
    rows = mixing.mix(docs).collect()
    assert len(rows) == 4 and {x.topic for x in rows} == {"brief", "table"}
    assert mixing.mix(docs.limit(0)).count() == 0


def payloads(r):
    same, short = "<p>" + prose(r, 400), "<p>short</p>"
    return [(1, "http://a", same), (2, "http://b c\r\n", short), (3, None, same), (4, "u", None), (5, "u", short), (7, "u", same), (7, "u", same), (7, "v", "ü" * 700), (None, "n", same), (9, "u", "ü" * 700)]


def test_archive_round_trip_and_determinism(spark, tmp_path):
    rows = payloads(random.Random(3)) + [(100 + i, "u", prose(random.Random(i), 300)) for i in range(30)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("shard", F.lit("mine"))
    sums = []
    for folder, parts in (("a", 3), ("b", 5)):
        place = f"file://{tmp_path}/{folder}"
        manifest = warc.write(pages.repartition(parts), place, roll_bytes=4000, shard_bytes=9000)
        sums.append([(f["name"], f["sha256"]) for f in manifest["files"]])
        assert sum(f["records"] for f in manifest["files"]) == len(rows) and len(manifest["files"]) > 3
        names = sorted(p.name for p in (tmp_path / folder).iterdir())
        assert names == sorted([*(f["name"] for f in manifest["files"]), "manifest.json"])
    assert sums[0] == sums[1]
    got = warc.read(spark, f"file://{tmp_path}/a").collect()
    text = {hashlib.sha1((h or "").encode()).hexdigest(): h or "" for _, _, h in rows}
    assert sorted((x.page_id or -1, text[x.payload_digest], x.payload_bytes) for x in got) == sorted((p or -1, h or "", len((h or "").encode())) for p, _, h in rows)
    assert all(x.payload == text[x.payload_digest] for x in got if x.record_type == "response")
    kinds = sorted((x.page_id or -1, x.record_type, x.refers_to) for x in got if x.payload_bytes >= 1000 and (x.page_id or 0) < 100)
    # A null page revisits like any other; of two equal records of page 7 one is the response.
    assert kinds == [(-1, "revisit", 7), (1, "revisit", 7), (3, "revisit", 7), (7, "response", None), (7, "revisit", 7), (7, "revisit", 9), (9, "response", None)]
    ids = set()
    for name, _ in sums[0]:
        with gzip.open(tmp_path / "a" / name) as f:
            ids |= {h["WARC-Record-ID"] for h, _ in warc.parse(f)}
    assert len(ids) == len(rows)


def test_shards_follow_the_bytes(spark, tmp_path):
    # One far id, one id larger than a shard, and rows without an id.
    rows = [(i, "u", prose(random.Random(i), 40)) for i in range(60)] + [(2**50, "u", "far")] + [(70, "u", prose(random.Random(i), 40)) for i in range(60, 160)] + [(None, "u", prose(random.Random(i), 40)) for i in range(200, 260)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    manifest = warc.write(pages, f"file://{tmp_path}/s", shard_bytes=2000)
    sizes = [f["records"] for f in manifest["files"]]
    assert sum(sizes) == len(rows) and max(sizes) < 30 and len(sizes) > 15
    got = warc.read(spark, f"file://{tmp_path}/s").collect()
    assert sorted((x.page_id or -1, x.payload) for x in got) == sorted((p or -1, h) for p, _, h in rows)


def test_archive_odd_tables(spark, tmp_path):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write(empty, f"file://{tmp_path}/e")
    assert warc.read(spark, f"file://{tmp_path}/e").count() == 0
    raw = warc.member(warc.record(5, 0, "u", b"x\r\n\r\ny", None))
    ((head, block),) = warc.parse(__import__("io").BytesIO(gzip.decompress(raw)))
    assert head["WARC-Record-ID"].startswith("<urn:x-page:5:") and block.endswith(b"x\r\n\r\ny")


def test_toxic_words_are_found(spark):
    r = random.Random(4)
    words = [prose(r, 1) for _ in range(300)]
    make = lambda toxic: " ".join(r.choice(["vile", "wretch", "scum!"]) if toxic and r.random() < 0.08 else r.choice(words) for _ in range(r.randint(30, 120)))
    marks = [i % 4 == 0 for i in range(600)]
    texts = [make(t) for t in marks]
    docs = documents(spark, [*texts, None, "", "vile wretch scum! " * 5])
    labels = spark.createDataFrame([(i, int(t)) for i, t in enumerate(marks)] + [(None, 1), (2, None), (9999, 1)], "doc_id long, toxic int")
    rows = {x.doc_id: x for x in toxicity.toxicity(docs.withColumn("score", F.lit("x")).withColumn("toxic", F.lit("y")), labels).collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(rows[i].held_out == (i in set(held)) for i in range(600))
    assert sum(rows[i].predicted == marks[i] for i in held) > 0.97 * len(held)
    assert rows[600].predicted == rows[601].predicted == 0 and rows[602].predicted == 1
    assert all(0 <= x.score <= 1 for x in rows.values())


def test_held_out_labels_teach_nothing(spark):
    docs = documents(spark, [prose(random.Random(i), 30) for i in range(60)])
    flip = lambda s: spark.createDataFrame([(i, int((i + s * (zlib.crc32(str(i).encode()) % 3 == 1)) % 2)) for i in range(60)], "doc_id long, toxic int")
    a, b = ({x.doc_id: x.score for x in toxicity.toxicity(docs, flip(s)).collect()} for s in (0, 1))
    assert len(a) == 60 and all(math.isclose(a[i], b[i], abs_tol=1e-12) for i in a)


def test_toxicity_without_labels(spark):
    docs = documents(spark, ["a", None])
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [x.predicted for x in toxicity.toxicity(docs, none).collect()] == [0, 0]
    labels = spark.createDataFrame([(0, 1), (1, 0)], "doc_id long, toxic int")
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0


def kneser_ney(docs, marks, doc, toxic):
    """Evidence of one document by plain counting: ``docs`` that taught (without it) and their marks."""
    words = lambda t: re.findall(r"[^\x00-/:-@\[-`{-\x7f]+", t.translate(LOWER))
    taught = [(words(t), marks[i]) for i, t in docs.items() if i != doc]
    pairs = [collections.Counter(), collections.Counter()]
    for w, m in taught:
        pairs[m].update(zip([None, *w], w, strict=False))
    types = collections.Counter(w for v, w in set(pairs[0]) | set(pairs[1]))
    every = [(words(t), marks.get(i)) for i, t in docs.items()]
    all_pairs = {p for w, _ in every for p in zip([None, *w], w, strict=False)}
    all_words = {p[1] for p in all_pairs}
    uni = [collections.Counter(w for ws, m in taught if m == c for w in ws) for c in (0, 1)]
    full = [collections.Counter(w for ws, m in every if m == c for w in ws) for c in (0, 1)]
    out = []
    text = words(toxic)
    for v, w in zip([None, *text], text, strict=False):
        back = (types[w] + 1) / (len(all_pairs) + len(all_words) + 1)
        logs = []
        for c in (1, 0):
            n, total = uni[c][w], max(sum(uni[c].values()), 1)
            p = max(n - 0.75, 0) / total + 0.75 * len(full[c]) / total * back
            follow = sum(k for (a, _), k in pairs[c].items() if a == v)
            different = sum(1 for (a, _) in pairs[c] if a == v)
            both = (0.75 * different / follow if follow else 1) * p + (max(pairs[c][v, w] - 0.75, 0) / follow if follow else 0)
            logs.append((math.log(p), math.log(both)))
        word, whole = logs[0][0] - logs[1][0], logs[0][1] - logs[1][1]
        often = pairs[0][v, w] + pairs[1][v, w] >= toxicity.OFTEN
        out.append((word, whole - word if often else 0, 0 if often else whole - word))
    n = max(len(out), 1)
    columns = [[x[k] for x in out] for k in range(3)]
    return [sum(c) / n for c in columns] + [sum(max(x - toxicity.STRONG, 0) for x in c) / math.sqrt(n) for c in columns]


def test_evidence_equals_plain_kneser_ney(spark):
    r = random.Random(21)
    pool = [prose(r, 1) for _ in range(25)]
    texts = [" ".join(r.choice(pool) for _ in range(r.randint(0, 60))) for _ in range(40)] + ["New words, only here!"]
    marks = {i: i % 2 for i in range(40) if zlib.crc32(str(i).encode()) % 3 != 1}
    docs = documents(spark, [*texts, texts[3]]).withColumn("doc_id", F.when(F.col("doc_id") < 41, F.col("doc_id")))
    model = toxicity.train(docs, spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int"))
    got = [(x.doc_id, x.toxic, x.evidence) for x in toxicity.features(docs, model).collect()]
    assert len(got) == 42
    taught = {i: texts[i] for i in marks}
    for i, toxic, evidence in got:
        assert toxic == marks.get(i, -1)
        assert np.allclose(evidence, kneser_ney(taught, marks, i, texts[3 if i is None else i]), atol=1e-9)


def co_training_rows(spark, r):
    """Words tell the label in most documents; source and capitals do in others."""
    good = [i % 3 > 0 for i in range(600)]
    nice, nasty = [prose(r, 1) for _ in range(60)], [prose(r, 1) for _ in range(60)]
    text = lambda g: " ".join(r.choice(nice if g else nasty) if r.random() < 0.4 else "plain" for _ in range(60))
    texts = [text(g) if g else ". ".join(w.upper() if k % 3 == 0 else w for k, w in enumerate(text(g).split())) for g in good]
    docs = documents(spark, [*texts, None, "", "x " * 5000]).withColumn("source", F.when(F.col("doc_id") % 3 > 0, "clean").otherwise("dirty"))
    docs = docs.withColumn("quality", F.lit("mine")).withColumn("score", F.lit(1))
    return good, docs, spark.createDataFrame([(i, int(good[i])) for i in range(0, 600, 2)] + [(None, 1)], "doc_id long, quality int")


def test_co_training_exchanges_both_ways(spark):
    good, docs, labels = co_training_rows(spark, random.Random(6))
    model = cotrain.train(docs, labels, each=40)
    assert len(model.exchanged) == cotrain.ROUNDS
    # Every round hands rows of both labels in both directions.
    assert all(min(given) > 0 for turn in model.exchanged for given in turn.values())
    assert all(a > 0.9 for a in model.agreement.values())
    rows = {x.doc_id: x for x in cotrain.classify(docs, model).collect()}
    assert all(rows[i].kept == good[i] for i in range(600)) and len(rows) == 603
    again = docs.where("doc_id < 5")
    twice = cotrain.classify(again.union(again), model).collect()
    assert sorted((x.doc_id, x.score) for x in twice) == sorted([(i, rows[i].score) for i in range(5)] * 2)
    # Both views count: without either, scores differ.
    for v in cotrain.VIEWS:
        one = copy.deepcopy(model)
        one.both[1 + cotrain.VIEWS.index(v)] = 0
        assert any(abs(x.score - rows[x.doc_id].score) > 1e-3 for x in cotrain.classify(docs, one).collect())


def test_co_training_scores_equal_plain_python(spark):
    good, docs, labels = co_training_rows(spark, random.Random(7))
    model = cotrain.train(docs, labels, rounds=1, each=40)
    sigmoid = lambda z: 1 / (1 + math.exp(-max(min(z, 30), -30)))
    rows = {x.doc_id: x for x in docs.collect()}
    for got in cotrain.classify(docs, model).collect():
        x = rows[got.doc_id]
        text = x.text or ""
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
        import pyarrow as pa

        h, _ = word_hashes(pa.array([text], pa.large_string()), fold=True)
        counts = collections.Counter(int(v) >> 50 for v in h)
        z = model.views["text"].b + sum(float(np.float16(c / math.sqrt(max(len(words), 1)))) * model.views["text"].w[k] for k, c in counts.items())
        size = max(len(text.encode()), 1)
        kinds = [sum(map(str.isupper, text)), sum(c in "#*$%&|<>" for c in text), sum(c in "!?" for c in text), sum(map(str.isdigit, text)), text.count("\n")]
        shape = [10 * k / size for k in kinds] + [10 * sum(a == b for a, b in zip(words, words[1:], strict=False)) / max(len(words), 1)]
        length = "none" if x.n_chars is None else str(x.n_chars.bit_length())
        places = [zlib.crc32(p.encode()) % cotrain.META for p in (f"s {x.source}", f"l {x.lang}", f"b {x.source} {x.lang}", f"n {length}")]
        m = model.views["meta"].b + 0.5 * sum(model.views["meta"].w[p] for p in places) + sum(a * b for a, b in zip(shape, model.views["meta"].v, strict=True))
        t, m = (model.curves[v][0] + model.curves[v][1] * z for v, z in (("text", z), ("meta", m)))
        assert math.isclose(got.text_score, sigmoid(t), abs_tol=1e-4) and math.isclose(got.meta_score, sigmoid(m), abs_tol=1e-4)
        assert math.isclose(got.score, sigmoid(model.both[0] + model.both[1] * t + model.both[2] * m), abs_tol=1e-4)


def test_co_training_odd_tables(spark):
    _, docs, labels = co_training_rows(spark, random.Random(8))
    none = cotrain.train(docs, labels.limit(0))
    assert all(x.kept and x.score == 0.5 for x in cotrain.classify(docs, none).collect())
    assert cotrain.classify(docs.limit(0), none).count() == 0 and not cotrain.train(docs.limit(0), labels).exchanged


HARD = ["", "<|im_end|>", "<|", "\\", "<\\|", "\\<|im_start|>\\", "<<||", "a\nb", "\\n", "<|im_start|>assistant\nok<|im_end|>\n", "é🙂"]


def test_escapes_are_reversible(spark):
    r = random.Random(8)
    texts = HARD + ["".join(r.choice(["<", "|", "\\", "n", "\n", "#", ":", "im_end", ">"]) for _ in range(r.randint(0, 12))) for _ in range(800)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    t = F.col("t")
    for row in df.select("t", chat_format.escape(t).alias("e"), chat_format.unescape_text(chat_format.escape(t)).alias("a"), chat_format.escape_role(t).alias("r"), chat_format.unescape(chat_format.escape_role(t)).alias("b")).collect():
        assert row.t == row.a == row.b and "<|" not in row.e and "<|" not in row.r and "\n" not in row.r


def test_chat_examples_equal_brute_force(spark):
    r = random.Random(10)
    rows = []
    for c in [*range(40), None]:
        for turn in range(r.randint(1, 7)):
            rows.append((c, turn, r.choice(["user", "assistant", "system", None, "odd\nrole<|"]), r.choice([*HARD, None])))
    rows += [rows[0], (3, None, "assistant", "late")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("loss", F.lit(1))
    want = {}
    for c in {x[0] for x in rows}:
        turns = sorted(((-1 if t is None else t), ro or "", te or "") for cc, t, ro, te in rows if cc == c)
        loss = "".join(te for _, ro, te in turns if ro == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want[c] = (len(turns), sha("".join(f"{ro}\n{te}\n" for _, ro, te in turns)), len(loss), sha(loss))
    got = {x.conv_id: (x.n_turns, x.turns_sha256, x.loss_chars, x.loss_sha256) for x in chat_format.digests(chat_format.format_examples(df)).collect()}
    assert got == want
    assert chat_format.digests(chat_format.format_examples(df.limit(0))).count() == 0


def test_only_the_reply_is_trained(spark):
    df = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "yo <|"), (1, 2, "user", "bye"), (1, 3, "assistant", "ok"), (1, 4, "user", "?")], "conv_id long, turn long, role string, text string")
    a, b, c = chat_format.format_examples(df).orderBy("example").collect()
    assert a.formatted == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nyo <\\|<|im_end|>\n" and a.formatted[a.loss_start : a.loss_end] == "yo <\\|"
    assert b.formatted.startswith(a.formatted) and b.formatted[b.loss_start : b.loss_end] == "ok" and c.loss_end is None


def test_manifest_is_json(spark, tmp_path):
    warc.write(spark.createDataFrame([(1, "u", "x")], "page_id long, url string, html string"), f"file://{tmp_path}/m")
    assert json.loads((tmp_path / "m" / "manifest.json").read_text())["files"][0]["records"] == 1


def test_rare_toxic_pairs_are_evidence(spark):
    # All words are as frequent in both classes; only pairs tell them apart, most of them seen fewer than five times.
    r = random.Random(13)

    def text(toxic):
        pairs = [(r.randrange(30), r.randrange(15)) for _ in range(8)]
        return " zz ".join(f"left{a} right{2 * b + (a + toxic) % 2}" for a, b in pairs)

    marks = [i % 2 for i in range(300)]
    docs = documents(spark, [text(t) for t in marks])
    got = {x.doc_id: x.score for x in toxicity.toxicity(docs, spark.createDataFrame(list(enumerate(marks)), "doc_id long, toxic int")).collect()}
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([(got[i] > 0.5) == marks[i] for i in held]) > 0.85


def test_toxicity_tables_hold_every_pair(spark):
    texts = [prose(random.Random(i), 40) for i in range(30)]
    docs = documents(spark, texts)
    model = toxicity.train(docs, spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, toxic int"))
    words = [t.split() for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 3 != 1]
    assert model.totals[4] == len({p for w in words for p in zip([None, *w], w, strict=False)})
    assert model.totals[5] == len({x for w in words for x in w})


def test_co_training_reaches_rare_sources(spark):
    # One source holds 2 of 4000 documents, the last by hash; it is dealt before the many of the other sources.
    last = [x.id for x in spark.range(4000).orderBy(F.xxhash64("id").desc()).limit(2).collect()]
    rows = [(i, "rare" if i in last else f"s{i % 2}", "en", 0.99 if i % 2 else 0.02) for i in range(4000)]
    found = cotrain.surest(spark.createDataFrame(rows, "doc_id long, source string, lang string, text_score double"), "text", 20, 0.9).collect()
    assert set(last) <= {x["__id"] for x in found} and len(found) == 40


def test_oracles_are_text():
    assert all(isinstance(s, str) for s in registry.SQL.values()) and set(registry.SQL) <= set(registry.QUERIES)


def _auc(marks, scores):
    pairs = sorted(zip(scores, marks, strict=True))
    below, wins, at = 0, 0.0, 0
    while at < len(pairs):
        to = at
        while to < len(pairs) and pairs[to][0] == pairs[at][0]:
            to += 1
        ones = sum(m for _, m in pairs[at:to])
        wins += ones * (below + (to - at - ones) / 2)
        below, at = below + to - at - ones, to
    return wins / (sum(marks) * (len(marks) - sum(marks)))


def test_curve_stays_bounded_on_nearly_separable_rows():
    model = toxicity.Model(None, None, None, None, np.zeros(6))
    rows = np.array([[float(i > 60), i / 100, 0, 0, (i % 7) / 1e3, -i / 50] for i in range(100)])
    toxic = np.array([int(i > 60) for i in range(100)])
    for marks in (toxic, np.where(np.arange(100) == 20, 1, toxic)):
        model.fit(rows, marks)
        assert (model.curve[1:] >= 0).all() and np.abs(model.curve[0] + rows @ model.curve[1:]).max() < 50
        assert _auc(marks.tolist(), (rows @ model.curve[1:]).tolist()) > 0.95


@pytest.mark.parametrize("size, least, found", [("sf0.01", 0.9, 0.5), ("sf0.1", 0.97, 0.85)])
def test_toxicity_of_held_out_labels(spark, size, least, found):
    """The held-out area under the curve is that of the best single piece of evidence at least."""
    folder = f"/root/testdata/{size}"
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    evidence = toxicity.features(docs, model)
    marks = labels.groupBy("doc_id").agg(F.max("toxic").alias("mark"))
    rows = toxicity.score(evidence, toxicity.fit(model, evidence)).join(evidence.select("doc_id", "evidence"), "doc_id").join(marks, "doc_id").where("held_out").collect()
    truth = [x.mark for x in rows]
    area = _auc(truth, [x.score for x in rows])
    assert area >= max(least, *(_auc(truth, [x.evidence[i] for x in rows]) for i in range(6)))
    assert sum(x.predicted for x in rows if x.mark) >= found * sum(truth)
    assert sum(x.predicted for x in rows if not x.mark) <= 0.03 * len(rows)
