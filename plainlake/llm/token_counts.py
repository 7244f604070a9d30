"""Token counts through a cache that is keyed by digests."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plainlake.llm.pieces import Bounded, Splitter, texts_of
from plainlake.llm.shared import free_names
from plainlake.llm.workers import held, lean
from plainlake.session import ship

CACHE = "tokenizer string, digest string, n_tokens long"


@lru_cache(4)
def tokenizer_version(path: str) -> str:
    """The digest of the tokenizer's file: another file, another cache key."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


class Counter:
    """Counts tokens with the library of the file's kind; it is asked once for each distinct piece that the cache lacks."""

    def __init__(self, path: str, most_cached: int = 200_000):
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.count = lambda text: len(model.encode(text, num_threads=1))
            return
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        library.no_truncation(), library.no_padding()
        try:
            self.splitter = Splitter(path)
            byte_level = type(library.pre_tokenizer).__name__ == "ByteLevel" and library.normalizer is None
        except ValueError:
            byte_level = False
        ask = lambda text: len(library.encode(text, add_special_tokens=False).ids)
        self.cache = Bounded(ask, most_cached)
        self.count = (lambda text: sum(map(self.cache.__getitem__, self.splitter(text)))) if byte_level else ask


def counter(path: str) -> Counter:
    return held(("counter", path), lambda: Counter(path))


def _count(path: str, version: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path).count
        for batch in batches:
            n = [count(t) for t in texts_of(batch)]
            yield pa.RecordBatch.from_arrays([pa.array([version] * len(n), pa.string()), batch.column("digest"), pa.array(n, pa.int64())], names=["tokenizer", "digest", "n_tokens"])

    return run


def digest(text="text"):
    """Normalised content is the text itself with null as empty: the count depends on every byte of it."""
    return F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)


def count_tokens(spark: SparkSession, docs: DataFrame, path: str, cache_path: str, limit: int = 1024) -> DataFrame:
    """`docs` with n_bytes, n_tokens and over_limit (n_tokens > limit); the cache at `cache_path` grows by what it lacked.

    Digests are joined to the cache; of those that miss, one text each goes to the tokenizer (partial aggregation lets
    at most one copy of a text leave a task, so that groups of copies cost nothing), and the counts are appended as one
    Parquet write, which an aborted run leaves without its rows. One writer at a time: a digest is stored once, so the
    last join is left to Spark's skew handling and needs no aggregation. Null text counts as empty and has no tokens; repeated
    rows each get their row back; columns named as the new ones give way; an empty table gives an empty table.
    """
    ship(spark)
    version = tokenizer_version(path)
    if not _exists(spark, cache_path):
        spark.createDataFrame([], CACHE).write.mode("append").parquet(cache_path)
    cache = spark.read.schema(CACHE).parquet(cache_path).filter(F.col("tokenizer") == version).drop("tokenizer")
    texts = docs.select(digest().alias("digest"), F.coalesce("text", F.lit("")).alias("text"))
    missing = texts.groupBy("digest").agg(F.first("text").alias("text")).join(cache.select("digest"), "digest", "left_anti")
    missing.mapInArrow(lean(_count(path, version)), CACHE).write.mode("append").parquet(cache_path)
    keep = [c for c in docs.columns if c not in ("n_bytes", "n_tokens", "over_limit")]
    (key,) = free_names(docs, 1)
    known = spark.read.schema(CACHE).parquet(cache_path).filter(F.col("tokenizer") == version).select(F.col("digest").alias(key), "n_tokens")
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], digest().alias(key), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    return rows.join(known, key, "left").drop(key).withColumn("over_limit", F.col("n_tokens") > limit)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
