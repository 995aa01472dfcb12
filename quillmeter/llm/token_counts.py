"""Token counts through a digest cache.

A count belongs to (SHA-256 of the text, digest of the tokenizer: file content and versions of what counts). Stored counts are
looked up by that key; of the misses, one text per digest is encoded (that of the least ``doc_id``; where several rows share
this too, one of them is taken by an aggregate on the digest), and the new counts are added to the cache in a folder of the
run's own, so runs at the same time do not touch each other's files and a reader never sees half of them. The only
normalisation that leaves all counts as they are is that of null to empty (the tokenizers at hand tell apart any two
texts). A count that is missing at the end fails the query.

Defined cases: empty and null texts have 0 bytes and 0 tokens; very long texts are whole; equal texts share one count; the same row twice gives two
rows; any ``doc_id`` (null, repeated) is carried along; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lookup, save, scratch_path, sized, slices, table

LIMIT = 512
#: The version of ``counter``'s own way of counting; a cache does not outlive it.
FAST_PATH = 1
#: Digests up to which the list of rows to skip is broadcast (32 bytes each); above, texts are shuffled by digest.
SKIP_ROWS = 500_000
BATCH_BYTES = 1 << 20
#: The split pattern of byte-level BPE files that name none (fixed value of that format), with possessive runs.
BYTE_LEVEL = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


def tokenizer_digest(path: str) -> str:
    import sentencepiece
    import tokenizers

    with open(path, "rb") as f:
        content = hashlib.sha256(f.read()).hexdigest()
    import tiktoken

    libraries = (tokenizers.__version__, tiktoken.__version__, FAST_PATH) if path.endswith(".json") else (sentencepiece.__version__,)
    version = " ".join(map(str, libraries))
    return hashlib.sha256(f"{content} {version}".encode()).hexdigest()


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of bytes in byte-level vocabularies: visible Latin-1 for itself, the rest from U+0100 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


def _plain_byte_level(spec: dict) -> bool:
    model, split = spec["model"], spec.get("pre_tokenizer") or {}
    usual = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    added = all(t["special"] and not (t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]) for t in spec.get("added_tokens", []))
    return model["type"] == "BPE" and usual and added and spec.get("normalizer") is None and split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True)


def counter(path: str) -> Callable[[list[str]], list[int]]:
    """A function that counts the tokens of texts as the file's library does, without added begin or end tokens.

    Plain byte-level BPE files run on the ranked merge loop of tiktoken, built from the same vocabulary, several times as
    fast as the tokenizers library and with equal counts; texts with special strings, and all other files, use the
    library itself.
    """
    if path.endswith(".model"):
        import sentencepiece

        processor = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in processor.encode(texts, num_threads=1)]
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()

    def by_library(texts: list[str]) -> list[int]:
        return [len(x.ids) for x in library.encode_batch_fast(texts, add_special_tokens=False)]

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    if not _plain_byte_level(spec):
        return by_library
    import tiktoken

    alphabet = _byte_alphabet()
    special = [t["content"] for t in spec.get("added_tokens", [])]
    vocabulary = {t: i for t, i in spec["model"]["vocab"].items() if t not in special}
    single = sorted((i, t) for t, i in vocabulary.items() if len(t) == 1)
    merged = [a + b for a, b in (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])]
    # Ranks follow the merges, not the ids; the single bytes come first.
    ranks = {bytes(alphabet[c] for c in t): r for r, t in enumerate([t for _, t in single] + merged)}
    if len(ranks) != len(single) + len(merged) or len(single) != 256:
        return by_library
    fast = tiktoken.Encoding("counter", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})

    def count(texts: list[str]) -> list[int]:
        out = [-1 if any(s in t for s in special) else len(fast.encode_ordinary(t)) for t in texts]
        rare = [i for i, n in enumerate(out) if n < 0]
        if rare:
            for i, n in zip(rare, by_library([texts[i] for i in rare]), strict=True):
                out[i] = n
        return out

    return count


def token_counts(docs: DataFrame, path: str, cache: str, limit: int = LIMIT) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row; ``cache`` is a folder that Spark reaches, new or in use."""
    spark = docs.sparkSession
    version = tokenizer_digest(path)
    store = f"{cache}/tokenizer={version}"
    fields = "digest binary, n_tokens long"

    def stored() -> DataFrame:
        folder = spark._jvm.org.apache.hadoop.fs.Path(store)
        if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
            return spark.createDataFrame([], fields)
        # Two runs at once may both store a digest; counts agree, so any one will do.
        return spark.read.schema(fields).parquet(store).groupBy("digest").agg(F.first("n_tokens").alias("n_tokens"))

    text = F.coalesce("text", F.lit(""))
    digest = F.unhex(F.sha2(text, 256))
    ids = save(docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), digest.alias("digest")), "text-digests")
    alike = ids.groupBy("digest", "doc_id").agg(F.count("*").alias("n"))
    groups = alike.groupBy("digest").agg(F.min(F.struct("doc_id", "n")).alias("least"), F.sum("n").alias("copies")).select("digest", F.col("least.doc_id").alias("first"), (F.col("least.n") > 1).alias("tied"), "copies")
    known = stored().select("digest", F.lit(True).alias("known"))
    groups = save(groups.join(known, "digest", "left"), "digest-groups")
    # Rows not to encode: all of a known digest, and all but the first document of a repeated one.
    skip = groups.where(F.col("known") | (F.col("copies") > 1)).select("digest", F.when(F.col("known").isNull(), F.col("first")).alias("first"), "tied", F.coalesce("known", F.lit(False)).alias("known"))
    rows = docs.select(F.col("doc_id").alias("__id"), text.alias("__text"), digest.alias("__digest"))
    rows = rows.join(sized(skip, SKIP_ROWS), F.col("__digest") == F.col("digest"), "left")
    rows = rows.where(F.col("digest").isNull() | (~F.col("known") & F.col("__id").eqNullSafe(F.col("first")))).select("__digest", "__text", F.coalesce("tied", F.lit(False)).alias("tied"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = None
        for batch in batches:
            count = count or counter(path)
            for start, part in slices(batch.column(1), BATCH_BYTES):
                digests, texts, tied = batch.column(0).slice(start, len(part)).to_pylist(), part.to_pylist(), batch.column(2).slice(start, len(part)).to_pylist()
                counts = iter(count([t for t, later in zip(texts, tied, strict=True) if not later]))
                known = [None if later else next(counts) for later in tied]
                yield pa.record_batch([pa.array(digests, pa.binary()), pa.array(known, pa.int64()), pa.array([t if later else None for t, later in zip(texts, tied, strict=True)], pa.string())], names=["digest", "n_tokens", "text"])

    def encode_rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = None
        for batch in batches:
            for start, part in slices(batch.column(2), BATCH_BYTES):
                digests, counts, texts = (batch.column(0).slice(start, len(part)).to_pylist(), batch.column(1).slice(start, len(part)).to_pylist(), part.to_pylist())
                missing = [i for i, n in enumerate(counts) if n is None]
                if missing:
                    count = count or counter(path)
                    for i, n in zip(missing, count([texts[i] for i in missing]), strict=True):
                        counts[i] = n
                yield pa.record_batch([pa.array(digests, pa.binary()), pa.array(counts, pa.int64())], names=["digest", "n_tokens"])

    # Texts travel only where several rows of the least id hold the digest; Spark merges these before the shuffle.
    fresh = rows.mapInArrow(encode, f"{fields}, text string").groupBy("digest").agg(F.first("n_tokens").alias("n_tokens"), F.first("text").alias("text"))
    fresh = fresh.mapInArrow(encode_rest, fields)
    fresh.write.parquet(f"{store}/run={uuid.uuid4().hex}", compression="zstd")
    facts = stored().join(groups.select("digest", "copies"), "digest").select("digest", "n_tokens", "copies")
    out = lookup(ids, facts, "digest", "copies")
    count = F.coalesce("n_tokens", F.raise_error(F.lit("the token cache lost a count")).cast("long"))
    out = out.select("doc_id", "n_bytes", count.alias("n_tokens"))
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op5_token_counts(spark: SparkSession, sf_dir: str, tokenizer: str = "byte_bpe_50k.json") -> DataFrame:
    """Two runs over one cache: texts of even checksum first, then all documents, which find the stored counts of these."""
    import public_tokenizers

    docs, path, cache = table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path(tokenizer), scratch_path(spark, "token-cache")
    token_counts(docs.where(F.crc32(F.coalesce("text", F.lit(""))) % 2 == 0), path, cache)
    return token_counts(docs, path, cache)
