"""The pipeline against its stages done by hand, document by document."""

import hashlib

import pandas as pd
import pytest

from factloom.llm import bpe, decontaminate, pii, quality
from test_pairs import plain_components


def test_pipeline(spark, tmp_path):
    import corpus_pipeline
    from tokenizers import Tokenizer

    sf = "/root/testdata/sf0.001"
    docs = pd.read_parquet(f"{sf}/documents.parquet").head(120)
    items = pd.read_parquet(f"{sf}/benchmark.parquet").head(10)
    docs.loc[5, "text"] = None
    docs.loc[7, "text"] = docs.text[8] + " " + items.text[3]
    docs.loc[9, "text"] = docs.text[8] + " mail a.b@c.example"
    docs.to_parquet(tmp_path / "documents.parquet")
    items.to_parquet(tmp_path / "benchmark.parquet")
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    got = sorted((r.doc_id, r.n_tokens, r.ids_sha256) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())

    compress = quality._compressor(quality.Bands())
    rows = [(i, t) for i, t in zip(docs.doc_id.tolist(), docs.text) if quality._judge(t or "", quality.Bands(), compress)[6]]
    whole = {i for i, _, c in plain_components(rows, 5, 80) if i == c}
    rows = [(i, t) for i, t in rows if str(i) in whole]
    fold = lambda t: "".join(map(chr, decontaminate.fold(t)[0]))
    rows = [(i, t) for i, t in rows if not any(fold(x) in fold(t) for x in items.text)]
    library = Tokenizer.from_file(bpe.vocabulary_path())
    want = []
    for i, t in rows:
        ids = library.encode(pii.clean(t, pii.base_spans(t)), add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()))
    assert got == sorted(want)
    assert 7 not in {r[0] for r in got} and 5 not in {r[0] for r in got}


def test_stages_keep_the_columns(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.columns == docs.columns and out.count() == 0


@pytest.mark.parametrize("name", ["op1_chat_formatting"])
def test_sql_is_given(name):
    import __spark_entry__

    assert name in __spark_entry__.oracle_sql() and {f"op{n}" for n in range(1, 11)} <= {q.split("_")[0] for q in __spark_entry__.queries()}
