"""The pipeline's stages keep the columns of documents, and each stage's decisions take effect."""

import random

import corpus_pipeline
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int"
CLASHING = ["_row", "host", "lines", "words", "bad", "_text", "_doc", "_group", "node", "fp", "key", "_gone", "_spans", "piece", "length"]


def test_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.schema.simpleString() == docs.schema.simpleString(), name
        docs = corpus_pipeline.cut(out, "test")
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[0] > sizes[1] > 0
    assert docs.select("text").distinct().count() == docs.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert packed.select("doc_id").distinct().count() == docs.count()
    assert corpus_pipeline.run(spark, sf).count() == packed.count()


def awkward() -> list[tuple]:
    r = random.Random(11)
    known = ["".join(r.choice("abdegiklmnoprstuvz") for _ in range(r.randint(3, 9))) for _ in range(5000)]
    prose = lambda n: [r.choice(known) for _ in range(n)]
    rows = [(i, " ".join(prose(120)), "src%d" % (i % 3)) for i in range(40)]
    base = prose(400)
    near = [*base[:200], "changed", *base[201:]]
    rows += [(100, " ".join(base), "src1"), (101, " ".join(near), "src2")]  # near copies: 100 stays
    rows += [(200, rows[0][1].upper(), "src1"), (201, rows[1][1], None)]  # copies of 0 and 1: the largest ids stay
    rows += [(300, rows[2][1], "src2")] * 3  # one row, repeated, and a copy of 2
    rows += [(400, " ".join(prose(200_000)), "src0"), (None, " ".join(prose(90)), None)]  # very long; neither id nor source
    rows += [(500, " ".join([*prose(60), 'api_key = "q8Zr2LkV0bXy7TnW4mCs9JdF3hGp6RaE"', *prose(60)]), "config.yml")]
    rows += [(600, None, "src0"), (601, "", None), (602, " \n\t", "src0"), (603, "too short", "src1"), (604, "again and again " * 60, "src1")]  # rejected
    return [(i, t, None, h, None) for i, t, h in rows]


def test_awkward_rows(spark, tmp_path):
    """Nulls, empty and very long texts, ties, repeated rows, and columns named as the operators' own."""
    rows = awkward()
    docs = spark.createDataFrame(rows, SCHEMA).select("*", *(F.lit(i).alias(c) for i, c in enumerate(CLASHING)))
    at = docs
    left = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = corpus_pipeline.cut(stage(spark, at, ""), "test")
        assert at.schema.simpleString() == docs.schema.simpleString(), name
        assert at.where(" or ".join(f"`{c}` <> {i}" for i, c in enumerate(CLASHING))).count() == 0, name
        left[name] = sorted((-1 if r.doc_id is None else r.doc_id) for r in at.select("doc_id").collect())
    rejected, gone = {600, 601, 602, 603, 604}, {0, 1, 2}
    clean = sorted(-1 if i is None else i for i, *_ in rows if i not in rejected)
    assert left["quality rules"] == clean
    assert left["exact dedup"] == sorted(set(clean) - gone)
    assert left["simhash near-dedup"] == left["secret scans"] == sorted(set(clean) - gone - {101})
    texts = {r.doc_id: r.text for r in at.select("doc_id", "text").collect()}
    was = {i: t for i, t, *_ in rows}
    assert all(t == was[i] for i, t in texts.items() if i != 500)
    assert "q8Zr2LkV" not in texts[500] and texts[500].split()[:60] == was[500].split()[:60] and texts[500].split()[-60:] == was[500].split()[-60:]
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    packed = corpus_pipeline.STAGES[-1][1](spark, at, "").groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r.doc_id: r.n for r in packed} == {i: len(library.encode(t, add_special_tokens=False).ids) + 1 for i, t in texts.items()}
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id: r.n for r in corpus_pipeline.run(spark, str(tmp_path)).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()} == {r.doc_id: r.n for r in packed}


def test_empty_table(spark, tmp_path):
    empty = spark.createDataFrame([], SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "").count() == 0, name
    spark.createDataFrame([(1, None, None, None, None)], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0  # nothing is left after the first stage
