"""The pipeline's stages: decisions against brute force, odd tables, one run of the whole."""

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from dispatchtext.llm import language, toxicity

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, count string, row long, _row string, g int"
ODD = [(None, None, None, None, None, "c", 1, "r", 1), (1, "", "en", "s", 0, "c", 1, "r", 1), (1, "", "en", "s", 0, "c", 1, "r", 1), (2, "12 34 !!", None, "s", 8, None, None, None, None), (3, "word " * 30_000, "xx", "s", 9, "c", 1, "r", 1)]


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES[:-1])
def test_stage_on_odd_and_empty_tables(spark, name, stage):
    docs = spark.createDataFrame(ODD, DOCS)
    out = stage(spark, docs, SF)
    assert out.columns == docs.columns and {tuple(r) for r in out.collect()} <= set(ODD)
    assert stage(spark, docs.limit(0), SF).count() == 0


def test_toxicity_stage_drops_what_the_score_says(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    want = sorted(r["doc_id"] for r in toxicity.score(docs, model).filter("predicted = 0").collect())
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_toxic(spark, docs, SF).collect()) == want


def test_language_stage_keeps_clear_languages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.train(docs)
    want = sorted(r["doc_id"] for r in language.predict(docs, model).filter("score >= 0.5").collect())
    got = sorted(r["doc_id"] for r in corpus_pipeline.keep_languages(spark, docs, SF).collect())
    assert got == want and len(got) > 0.95 * docs.filter("length(text) > 20").count()


def test_run(spark):
    """Rows of the whole pipeline: packed pieces of exactly the documents that the stages before keep."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
    left = {r["doc_id"]: r["text"] for r in docs.collect()}
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    size = {i: len(plain.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in left.items()}
    rows = corpus_pipeline.run(spark, SF).collect()
    total, bins = {}, {}
    for r in rows:
        total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["length"]
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert total == size
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) <= 1.05 * -(-sum(size.values()) // 2048) + 1


def test_near_duplicate_stage_takes_five_words(spark):
    words = [f"w{i % 97}x{i}" for i in range(200)]
    near = words[:100] + ["changed"] + words[101:]
    far = [w for i, w in enumerate(words) if i % 4]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(far)), (4, " ".join(words))], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()) == [1, 3]


def test_near_duplicate_stage_links_by_fingerprints(spark, monkeypatch):
    """With min-hash links taken away, the SimHash operator's links alone still find a near copy, and both meet in one group."""
    from dispatchtext.llm import near_text, simhash

    words = [f"w{i % 97}x{i}" for i in range(4000)]
    near = [*words[:2000], "changed", *words[2001:]]
    docs = spark.createDataFrame([(5, " ".join(words)), (3, " ".join(near)), (7, "quite another text of some words"), (8, None)], "doc_id long, text string")
    a, b = (simhash.fingerprint(" ".join(x), near_text.WORDS, True) for x in (words, near))
    assert any((x ^ y).bit_count() <= simhash.RADIUS for x, y in zip(a, b))
    monkeypatch.setattr(near_text, "close_links", lambda *_: spark.createDataFrame([], "src long, dst long"))
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()) == [3, 7, 8]
