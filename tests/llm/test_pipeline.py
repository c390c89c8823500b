import hashlib
from collections import Counter

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from shardframe.llm import bpe

SF = "/root/testdata/sf0.001"


def test_stages_in_order(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "bpe":
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
        docs = corpus_pipeline.written(out, f"test-{name}")
        seen[name] = Counter(r["doc_id"] for r in docs.collect())
    assert set(seen["toxicity"]) >= set(seen["exact_dedup"]) >= set(seen["jaccard_join"]) == set(seen["mixing"]) == set(seen["bpe"])
    assert max(seen["jaccard_join"].values()) == 1
    assert seen["mixing"] == seen["bpe"]
    assert corpus_pipeline.run(spark, SF).count() == sum(seen["bpe"].values())


@pytest.fixture
def labelled(tmp_path, spark):
    """A table in which the toxic words are known, with copies, near copies, and odd rows."""
    clean = [f"plain number{k} words about subject{k % 7} and other things of day{k} with more text to fill it {k * 37}" for k in range(120)]
    toxic = [f"some start{k} idiot words then scum after day{k} number{k} and idiot{k % 3} more" for k in range(60)]
    rows = [(k, t, "en", f"src{k % 3}", len(t)) for k, t in enumerate(clean + toxic)]
    rows += [(1000 + k, clean[k], "en", "src0", 1) for k in range(10)]
    long = " ".join(f"w{k}" for k in range(100))
    rows += [(2000, long, "en", "src0", 1), (2001, long + " end", "en", "src1", 1), (2002, None, "en", None, None), (2003, "", "en", None, 0)]
    folder = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    labels = [(k, 1, int(k >= 120)) for k in range(0, 180)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def test_whole_run(labelled, spark):
    out = corpus_pipeline.run(spark, labelled).collect()
    ids = {r["doc_id"] for r in out}
    assert ids == set(range(120)) | {2000, 2002}
    # Every document once, those of small sources up to twice; each row encoded as the library does.
    times = Counter(r["doc_id"] for r in out)
    assert set(times.values()) <= {1, 2}
    library = Tokenizer.from_file(bpe.default_path())
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{labelled}/documents.parquet").collect()}
    for r in out:
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()


def test_empty_documents(labelled, spark, tmp_path):
    docs = spark.read.parquet(f"{labelled}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, labelled)
        assert docs.count() == 0
