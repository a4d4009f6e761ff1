"""Every operator and stage on odd and on empty tables."""

import pytest

import corpus_pipeline
from vectorlint.llm import bpe, decontaminate, fingerprint, langid, license, lmscore, neardup, sharding, toxicity, urlfilter


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 0, 0), (2, None, None), (None, 1, 1), (13, 0, 1), (13, 0, 1), (5, 1, 0)], "doc_id bigint, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, "the idea of the thing and the other ones", "x"), (2, None, "x"), (3, "", "x"), (None, "der einheit und die ordnung", "x"), (5, "word", "x"), (1, "the idea of the thing and the other ones", "x")],
                                 "item_id bigint, text string, doc_id string")


OPERATORS = {
    "license": lambda d, b, m: license.scan(d),
    "sharding": lambda d, b, m: sharding.assign_shards(d, 100),
    "decontaminate": lambda d, b, m: decontaminate.contaminated_pairs(d, b),
    "langid": lambda d, b, m: langid.predict_languages(d),
    "lmscore": lambda d, b, m: lmscore.score_texts(d),
    "toxicity": lambda d, b, m: toxicity.score_documents(d, m),
    "neardup": lambda d, b, m: neardup.near_duplicates(d),
    "fingerprint": lambda d, b, m: fingerprint.fingerprints(d),
    "bpe": lambda d, b, m: bpe.round_trip_digests(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_operator(name, odd_docs, benchmark, labels):
    got = OPERATORS[name](odd_docs, benchmark, labels).collect()
    if name not in ("license", "decontaminate"):
        assert sorted(str(r.doc_id) for r in got) == sorted(str(r.doc_id) for r in odd_docs.collect())
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    if name == "neardup":
        assert by[1][0].component_id == by[2][0].component_id == by[2][1].component_id == 1
        assert not by[2][0].kept and by[4][0].kept and by[4][0].n_shingles == 0 and by[3][0].component_id == 3
        assert by[8][0].n_shingles == 1 and by[9][0].kept
    if name == "langid":
        assert {by[i][0].lang_pred for i in (3, 4, 7, 12)} == {"und"} and by[1][0].lang_pred == "en"
    if name == "fingerprint":
        assert by[1][0].fingerprint == by[2][0].fingerprint and by[2][0].near_next == 1.0 and set(by[4][0].fingerprint) == {"0"}
        assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    if name == "decontaminate":
        assert {(r.doc_id, r.item_id) for r in got} == {(1, 1), (2, 1), (11, 1), (None, None), (9, None), (8, 5)}
        assert sum((r.doc_id, r.item_id) == (2, 1) for r in got) == 4
    if name == "sharding":
        assert all(r.shard_bytes <= 100 or r.shard_rows == 1 for r in got)
    if name == "lmscore":
        assert by[3][0].n_tokens == by[4][0].n_tokens == 1 and all(r.score < 0 for r in got)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty(name, odd_docs, benchmark, labels):
    assert OPERATORS[name](odd_docs.limit(0), benchmark.limit(0), labels.limit(0)).collect() == []


def test_pages(spark):
    rows = [(1, "HTTP://A.Example.NET/en/x?q#f", "x"), (1, "HTTP://A.Example.NET/en/x?q#f", "x"), (2, None, "x"), (None, "nothing", "x"), (3, "", "x"), (4, "http://net", "x"), (5, "s://x.net/://y", "x"),
            (6, "http://notexample.net/en/", "x"), (7, "http://example.com/de", "x"), (8, "http://example.com/de/a\nb", "x")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, host string")
    got = urlfilter.judge(pages).collect()
    assert sorted((str(r.page_id), r.host, r.path, str(r.rule), r.verdict) for r in got) == sorted([
        ("1", "a.example.net", "/en/x", "example.net/en/", "allow"), ("1", "a.example.net", "/en/x", "example.net/en/", "allow"), ("2", "", "", "None", "allow"), ("None", "", "", "None", "allow"),
        ("3", "", "", "None", "allow"), ("4", "net", "", "None", "allow"), ("5", "x.net", "/://y", "net/", "block"), ("6", "notexample.net", "/en/", "net/", "block"),
        ("7", "example.com", "/de", "None", "allow"), ("8", "example.com", "/de/a\nb", "example.com/de/", "block")])
    assert urlfilter.judge(pages.limit(0)).collect() == []


def test_stages(spark, odd_docs, benchmark, labels, tmp_path):
    benchmark.write.parquet(f"{tmp_path}/benchmark.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for docs in (odd_docs, odd_docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            if name != corpus_pipeline.STAGES[-1][0]:
                assert out.columns == docs.columns
            n = out.count()
            assert n <= docs.count()
        assert docs.isEmpty() or n == docs.count()
    kept = corpus_pipeline.drop_near_duplicates(spark, odd_docs, str(tmp_path)).collect()
    # 2 repeats 1 (twice), 11 is near it; rows without words stay.
    assert sorted(str(r.doc_id) for r in kept) == ["1", "10", "12", "13", "3", "4", "5", "7", "8", "9", "None", "None"]


def test_language_stage_without_languages(spark, odd_docs, tmp_path):
    """With nothing to learn from only texts without a letter go."""
    docs = odd_docs.withColumn("lang", odd_docs["lang"].substr(9, 9)).replace("", None, "lang")
    kept = corpus_pipeline.keep_identified(spark, docs, str(tmp_path)).collect()
    assert sorted(str(r.doc_id) for r in kept) == ["1", "10", "11", "13", "2", "2", "5", "8", "9", "None"]
