"""Every registered query of the subpackage, over the whole smallest tables, against plain versions."""

import hashlib
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from conftest import SF
from factloom.llm import bpe, decontaminate, html_text, pii, quality
from test_corpus_ops import folded, plain_spans
from test_pairs import plain_components
from test_repeats import plain
from test_text_ops import plain_counts

NAMES = {n.split("_")[0]: n for n in entry.queries() if n.startswith("op") and n[2].isdigit()}


@pytest.fixture(scope="module")
def rows():
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    return [(int(i), t if isinstance(t, str) else None) for i, t in zip(docs.doc_id, docs.text)]


@pytest.fixture(scope="module")
def ids(rows):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.vocabulary_path())
    return {i: library.encode(t or "", add_special_tokens=False).ids for i, t in rows}


def got(spark, op, key="doc_id"):
    found = entry.queries()[NAMES[op]](spark, SF).collect()
    return {r[key]: r for r in found} if key else found


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_all_are_registered():
    assert {f"op{n}" for n in range(1, 14)} == set(NAMES)


def test_op11(spark):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(entry.oracle_sql()[NAMES["op11"]]).df()
    have = entry.queries()[NAMES["op11"]](spark, SF).toPandas()
    columns = sorted(want.columns)
    assert sorted(have.columns) == columns and len(have) == len(want)
    assert sorted(map(tuple, have[columns].astype(str).values)) == sorted(map(tuple, want[columns].astype(str).values))


def test_op1(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    want = con.execute(entry.oracle_sql()[NAMES["op1"]]).df()
    have = entry.queries()[NAMES["op1"]](spark, SF).toPandas()
    columns = sorted(want.columns)
    assert sorted(have.columns) == columns
    assert sorted(map(tuple, have[columns].astype(str).values)) == sorted(map(tuple, want[columns].astype(str).values))


def test_op2_and_op6(spark, rows, ids):
    counts, coded = got(spark, "op2"), got(spark, "op6")
    assert len(counts) == len(coded) == len(rows)
    for i, t in rows:
        assert (counts[i].n_bytes, counts[i].n_tokens, counts[i].over_limit) == (len((t or "").encode()), len(ids[i]), len(ids[i]) > 512)
        assert (coded[i].n_tokens, coded[i].ids_sha256, coded[i].decoded_sha256) == (len(ids[i]), sha(",".join(map(str, ids[i]))), sha(t or ""))


def test_op3(spark, rows):
    have, compress = got(spark, "op3"), quality._compressor(quality.Bands())
    for i, t in rows:
        words, chars, symbols, lines, repeats = plain_counts(t)
        failed = words < 50 or 100 * repeats > 50 * words
        r = have[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (words, chars, symbols, lines, repeats, failed)
        assert r.kept == (not failed and quality.band_verdict((t or "").encode(), quality.Bands(), compress)[3])


def test_op4(spark, rows, ids):
    have, start = got(spark, "op4"), 0
    for i, _ in sorted(rows):
        own = [*ids[i], 2]
        assert (have[i].start, have[i].n_tokens, have[i].ids_crc32) == (start, len(own), zlib.crc32(np.array(own, "<u4").tobytes()))
        start += len(own)


def test_op5(spark, rows):
    have = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got(spark, "op5", None))
    assert have == plain(rows, 50)


def test_op7(spark, rows):
    have = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got(spark, "op7", None))
    assert have == plain_components(rows, 3, 90)


def test_op8(spark):
    pages = pd.read_parquet(f"{SF}/pages.parquet")
    have = got(spark, "op8", "page_id")
    assert len(have) == len(pages)
    for i, url, html in zip(pages.page_id, pages.url, pages.html):
        own = html_text.extract(html)  # these pages mark their articles, which hold no template
        assert (have[i].url, have[i].text, have[i].n_chars) == (url, own, len(own))
        assert own and "<" not in own and "\n\n" not in own


def test_op9(spark, rows):
    have = got(spark, "op9")
    for i, t in rows:
        base = plain_spans(t or "")
        r = have[i]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[2] == k for s in base) for k in pii.KINDS[:4]]
        assert r.base_sha256 == sha(pii.written(base))
        assert {pii.written([s]) for s in base} <= set(r.spans.split(","))


def test_op10(spark, rows):
    items = pd.read_parquet(f"{SF}/benchmark.parquet")
    have = {(r.doc_id, r.item_id) for r in got(spark, "op10", None)}
    texts = {i: folded(t) for i, t in rows}
    exact = {(i, int(k)) for k, x in zip(items.item_id, items.text) for i, t in texts.items() if x and folded(x) in t}
    assert exact <= have
    index = decontaminate.Index([(int(k), x) for k, x in zip(items.item_id, items.text)], 9, 0.08)
    for i, k in have - exact:  # what is not there as it is shares most of its q-grams
        own = folded(items.text[items.item_id == k].iloc[0])
        grams = {own[j : j + 9] for j in range(len(own) - 8)}
        assert sum(g in texts[i] for g in grams) >= 0.5 * index.least[list(index.ids).index(k)]


def test_pipeline_runs_over_the_whole_table(spark, rows):
    have = entry.queries()["pipeline"](spark, SF).collect()
    assert 0 < len(have) < len(rows) and len({r.doc_id for r in have}) == len(have)
