"""Caches bounded in bytes, and the bound of learned languages."""

import public_tokenizers
from pyspark.sql import functions as F

from leadloom.llm import byte_bpe, common, language, packing, token_counts


def test_long_words_are_not_cached():
    long = ["x" * n + "é" for n in range(common.CACHED_CHARS, 400)]
    counter = token_counts.PairCounter(token_counts.load(public_tokenizers.path("piece_bpe_32k.model")).scores)
    bpe = byte_bpe.ByteBpe(byte_bpe.load(public_tokenizers.path("byte_bpe_50k.tiktoken")).ranks)
    words = packing.WordIds(public_tokenizers.path("word_bpe_49k.json"))
    for w in long:
        assert counter.tokens(w) and bpe[w] and words.encode(w) == words.whole(w)
    for cache in (counter, counter.parts, bpe, words, words.old):
        assert all(len(k) <= common.CACHED_CHARS for k in cache)


def test_dirty_languages(spark, monkeypatch):
    """Codes outside the table are one family, and only the most frequent languages are learned."""
    monkeypatch.setattr(language, "MOST_LANGUAGES", 4)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", F.when(F.col("lang") == "de", "q1").when(F.col("lang") == "fr", "q2").otherwise(F.col("lang")).alias("lang"))
    dirty = docs.unionByName(docs.limit(30).select(F.col("doc_id") + 10_000_000, "text", F.concat(F.lit("zz"), F.col("doc_id"))).toDF("doc_id", "text", "lang"))
    model = language.train(dirty)
    assert sorted(model.families) == ["germanic", "others", "romance"] and model.families["others"] == ["q1", "q2"]
    held = language.predict(docs, model).where("held_out").join(docs, "doc_id")
    n, right = held.agg(F.count(F.lit(1)), F.count_if(F.col("lang_pred") == F.col("lang"))).first()
    assert right >= 0.95 * n
