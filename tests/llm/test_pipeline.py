"""The corpus pipeline against a plain version of its stages."""

import hashlib
import re

import public_tokenizers
import tiktoken

import __spark_entry__ as entry
import corpus_pipeline
from govlake.llm import bpe, language_id, mixing

from . import brute

SF = "/root/testdata/sf0.001"


def test_rows_against_plain_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    # what the models and the draw decide is taken from the operators; what is left is plain
    model = language_id.train(docs)
    rejected = {r.doc_id for r in language_id.classify(docs, model).where("rejected").collect()}
    rows = [r for r in docs.collect() if r.doc_id not in rejected]
    least = {}
    for r in rows:
        norm = re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "")
        least[norm] = min(least.get(norm, r.doc_id), r.doc_id)
    rows = [r for r in rows if r.doc_id == least[re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "")]]
    stays = {i for i, _, c in brute.jaccard_components([(r.doc_id, r.text) for r in rows], 5, 80) if i == c}
    rows = [r for r in rows if r.doc_id in stays]
    left = spark.createDataFrame(rows, docs.schema)
    kept = {r.doc_id for r in mixing.mix(left, fraction=corpus_pipeline.FRACTION).where("kept").collect()}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    want = []
    for r in rows:
        if r.doc_id in kept:
            ids = library.encode_ordinary(r.text)
            want.append((r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(r.text.encode()).hexdigest()))
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, SF).collect()) == sorted(want)


def test_every_stage_keeps_the_columns_and_takes_odd_rows(spark, tmp_path):
    rows = [(1, "the cat and the dog are here " * 5, "en", "a", 1), (1, "the cat and the dog are here " * 5, "en", "a", 1), (2, None, None, None, None), (None, "the dog walks over there " * 4, "en", None, 2), (3, "", "en", "a", 0), (4, "der Hund ist im Haus und " * 6, "de", "b", 3), (5, "w " * 40_000, "en", "b", 4)]
    docs = spark.createDataFrame([(*r, "extra", 5) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, digest string, component_id int")
    for df in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, df, str(tmp_path))
            assert out.columns == docs.columns and out.count() <= df.count()
        assert corpus_pipeline.encode(spark, df, str(tmp_path)).count() == df.count()


def test_registered_once_and_named_by_number():
    names = entry.queries()
    assert "pipeline" in names
    for n in range(1, 11):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
