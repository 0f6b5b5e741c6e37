"""Token counts through a digest cache.

A stored count is found by two digests: of the normalised content and of the tokenizer version. Only
contents that the cache lacks are encoded, each distinct one once, and appended to it.
"""

from __future__ import annotations

import hashlib
import importlib.metadata
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rillflow.llm.common import id_and_text, keep, key_filter, passes, tokenizer_file

CACHE_SCHEMA = "content_sha256 string, tokenizer_sha256 string, n_tokens long"
#: Words that a Python worker remembers, and the longest of them.
MEMORY, MEMORY_CHARS = 400_000, 40


def tokenizer_version(name: str) -> str:
    """Digest of the tokenizer's file and of the library's version."""
    data = open(tokenizer_file(name), "rb").read()
    library = "tokenizers" if name.endswith(".json") else "sentencepiece"
    return hashlib.sha256(data + importlib.metadata.version(library).encode()).hexdigest()


@lru_cache(maxsize=8)
def drops_white_space(name: str) -> bool:
    """Whether ASCII white space only parts words and never counts, by the tokenizer's file.

    So it is if the text is first cut into the matches of a plain pattern that no such character is part of, and
    the normaliser changes letters or runs of white space alone.
    """
    if not name.endswith(".json"):
        return False
    import regex

    spec = json.load(open(tokenizer_file(name), encoding="utf-8"))
    if any(t["lstrip"] or t["rstrip"] or t["content"].split() != [t["content"]] for t in spec["added_tokens"]):
        return False
    steps = spec["normalizer"] or {"type": "Sequence", "normalizers": []}
    for step in steps.get("normalizers", [steps]):
        runs = step["type"] == "Replace" and (step["pattern"], step["content"]) == ({"Regex": r"\s+"}, " ")
        if not runs and step["type"] not in ("NFC", "Lowercase"):
            return False
    split = spec["pre_tokenizer"] or {}
    split = split.get("pretokenizers", [split])[0]
    if split.get("type") != "Split" or split["behavior"] != "Removed" or not split["invert"] or "(?" in (pattern := split["pattern"].get("Regex", "(?")):
        return False
    return not any(regex.search(pattern, f"{x}{c}{y}", pos=0) and any(c in m for m in regex.findall(pattern, f"{x}{c}{y}")) for c in " \t\n\v\f\r" for x in ("", "a", "1", "'", ".") for y in ("", "a", "1", "s", "."))


def normalised(text: Column, name: str) -> Column:
    """The content that decides the count: ASCII white space collapses only where the tokenizer drops it anyway."""
    return F.trim(F.regexp_replace(text, r"[ \t-\r]+", " ")) if drops_white_space(name) else text


class _Counter:
    """Counts of whole texts. Where white space is dropped, a text's count is the sum over its words, each distinct word being encoded once."""

    def __init__(self, name: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        path = tokenizer_file(name)
        if name.endswith(".json"):
            from tokenizers import Tokenizer

            tok = Tokenizer.from_file(path)
            tok.no_truncation()
            tok.no_padding()
            self.lengths = lambda texts: [len(e) for e in tok.encode_batch_fast(texts, add_special_tokens=False)]
        else:
            import sentencepiece

            sp = sentencepiece.SentencePieceProcessor(model_file=path)
            self.lengths = lambda texts: [len(ids) for ids in sp.encode(texts, num_threads=1)]
        self.words = re.compile(r"[^ \t-\r]+").findall if drops_white_space(name) else None
        self.known: dict[str, int] = {}

    def count(self, text: str) -> int:
        if self.words is None:
            return self.lengths([text])[0]
        words = self.words(text)
        new = list(set(words).difference(self.known))
        if len(self.known) + len(new) > MEMORY:
            self.known.clear()
            new = list(set(words))
        known = self.known
        known.update(zip(new, self.lengths(new), strict=True))
        total = sum(map(known.__getitem__, words))
        for w in new:
            if len(w) > MEMORY_CHARS:
                del known[w]
        return total


@lru_cache(maxsize=4)
def counter(name: str) -> _Counter:
    return _Counter(name)


def _encode(texts: DataFrame, name: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, seen = counter(name).count, set()  # rows that repeat both id and content meet in one task
        for b in batches:
            out = []
            for digest, text in zip(b.column("content_sha256").to_pylist(), b.column("text").to_pylist(), strict=True):
                if digest not in seen:
                    seen.add(digest)
                    out.append((digest, count(text)))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.int64())], names=["content_sha256", "n_tokens"])

    return texts.mapInArrow(run, "content_sha256 string, n_tokens long")


def open_cache(spark: SparkSession, path: str) -> DataFrame:
    """The cache at ``path``; one without rows is put there if there is none."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        spark.createDataFrame([], CACHE_SCHEMA).write.parquet(path)
    return spark.read.schema(CACHE_SCHEMA).parquet(path)


def count_tokens(docs: DataFrame, cache_path: str, tokenizer: str = "word_bpe_49k.json", limit: int = 2048) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row of ``docs(doc_id, text)``; misses are appended to the cache.

    Null and empty texts have no bytes and no tokens. Repeated rows and null ids are counted like others;
    other columns are not read. Digests and counts are shuffled; texts are encoded where they lie, one row of
    each distinct missing content being picked by a filter of at most 32 MB (it lets about one in 200 others
    through, which costs a repeated encoding). Beyond ``FILTER_KEYS`` misses the texts are joined to them
    instead, and the missing ones move. With a full cache no text is encoded and none moves.
    """
    spark = docs.sparkSession
    version = tokenizer_version(tokenizer)
    digest = F.sha2(normalised(F.col("text"), tokenizer), 256)
    number = F.xxhash64("doc_id", "text")
    rows = id_and_text(docs)
    skinny = keep(rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), digest.alias("content_sha256"), number.alias("h")), "digests")
    cache = open_cache(spark, cache_path).where(F.col("tokenizer_sha256") == version).select("content_sha256", "n_tokens")
    first = skinny.groupBy("content_sha256").agg(F.min(F.struct("doc_id", "h")).alias("first"))
    misses = keep(first.join(cache, "content_sha256", "left_anti"), "misses")
    found = key_filter(misses.select("first.h"))
    if found:
        wanted = passes(rows, number, found).withColumn("content_sha256", digest)
    else:
        keys = misses.select(F.col("first.doc_id").alias("first_id"), F.col("content_sha256").alias("__digest"))
        wanted = rows.withColumn("content_sha256", digest).join(keys.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("content_sha256") == F.col("__digest")), "left_semi")
    new = _encode(wanted.select("content_sha256", "text"), tokenizer).groupBy("content_sha256").agg(F.max("n_tokens").alias("n_tokens"))
    new = new.join(misses.select("content_sha256"), "content_sha256", "left_semi")
    new.select("content_sha256", F.lit(version).alias("tokenizer_sha256"), "n_tokens").write.mode("append").parquet(cache_path)
    counts = open_cache(spark, cache_path).where(F.col("tokenizer_sha256") == version).groupBy("content_sha256").agg(F.max("n_tokens").alias("n_tokens"))
    counts = keep(counts, "counts")
    return skinny.join(counts, "content_sha256").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
