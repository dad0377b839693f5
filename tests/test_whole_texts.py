"""BLEU and METEOR of whole documents, with matches that only stand far behind their beginning, against brute force."""

import random
import re

import pandas as pd
import pytest

import __spark_entry__ as entry
from conftest import SF
from test_operators import plain_bleu
from test_queries import duck, rows_of  # noqa: F401


def plain_tokens(text):
    return re.findall(r"\w+|[^\w\s]", text.lower())


def plain_meteor(c, r):
    if not c or not r:
        return float(c == r)
    free = {}
    for j, t in enumerate(r):
        free.setdefault(t, []).append(j)
    met = [(i, free[t].pop(0)) for i, t in enumerate(c) if free.get(t)]
    if not met:
        return 0.0
    chunks = 1 + sum(b != (a[0] + 1, a[1] + 1) for a, b in zip(met, met[1:]))
    p, q = len(met) / len(c), len(met) / len(r)
    return 10 * p * q / (q + 9 * p) * (1 - 0.5 * (chunks / len(met)) ** 3)


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    rng = random.Random(6)
    words = lambda n, of: " ".join(rng.choice(of) for _ in range(n))
    head, body = ["lorem", "ipsum", "dolor", "sit,"], ["stone", "water", "Paper", "light.", "green"]
    items = [(10 * i, words(rng.randint(3, 30), body)) for i in range(3)]
    docs = [(i, words(200, head) + " " + words(rng.randint(0, 60), body) + " " + items[i % 3][1], "ab"[i % 2]) for i in range(8)] + [(8, "", "a"), (9, "short water", "b")]
    folder = tmp_path_factory.mktemp("whole")
    pd.DataFrame(docs, columns=["doc_id", "text", "lang"]).to_parquet(folder / "documents.parquet")
    pd.DataFrame(items, columns=["item_id", "text"]).to_parquet(folder / "benchmark.parquet")
    refs = [plain_tokens(t) for _, t in items]
    return str(folder), [(i, lang, plain_tokens(t), [refs[i % 3], refs[(i + 1) % 3]]) for i, t, lang in docs]


def test_bleu_reads_whole_texts(spark, tables):
    folder, cases = tables
    got = {r.lang: r.bleu for r in entry.queries()["bleu4_corpus"](spark, folder).collect()}
    assert got == pytest.approx({x: plain_bleu([(c, r) for _, lang, c, r in cases if lang == x]) for x in "ab"}, abs=1e-6)
    got = {r.doc_id: r.bleu for r in entry.queries()["bleu4_case"](spark, folder).collect()}
    assert got == pytest.approx({i: plain_bleu([(c, r)]) for i, _, c, r in cases}, abs=1e-6) and got[0] > 0


def test_meteor_reads_whole_texts(spark, tables):
    folder, cases = tables
    got = {r.doc_id: r.meteor for r in entry.queries()["meteor_lite"](spark, folder).collect()}
    assert got == pytest.approx({i: max(plain_meteor(c, x) for x in r) for i, _, c, r in cases}, abs=1e-6) and got[0] > 0


@pytest.mark.parametrize("name", ["bleu4_corpus", "bleu4_case", "meteor_lite"])
def test_query_equals_its_sql_on_whole_texts(spark, duck, name):  # noqa: F811
    sql = entry.oracle_sql()[name]
    assert "substr(text" not in sql
    assert rows_of(entry.queries()[name](spark, SF).toPandas()) == rows_of(duck.execute(sql).df())
