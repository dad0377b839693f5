"""Operator 9: copies of a text neither hide nor make a disclosing term."""

import random

from factloom.llm import pii

WORDS = [f"{a}{b}" for a in ("stone", "water", "paper", "light", "green") for b in ("ing", "ed", "er", "ly", "ness")]
D = pii.Disclosure(bits=4)


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def terms(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {(r.term, r.n_near, r.n_all) for r in pii.disclosing_terms(df, D).collect()}


def test_copies_hide_no_term(spark):
    rng = random.Random(12)
    near = [f"{prose(rng, 80)} Zebulon {prose(rng, 1)} z.q@mail.example {prose(rng, 80)}" for _ in range(12)]
    away = f"{prose(rng, 20)} Zebulon {prose(rng, 20)}"
    other = [prose(rng, 200) for _ in range(40)]
    want = {("zebulon", 12, 13)}
    assert terms(spark, [*near, away, *other]) == want
    assert terms(spark, [*near, away, *other, *[near[0]] * 1000]) == want
    assert terms(spark, [*near, away, *other, *[away] * 1000]) == want
    changed = [f"{i} {near[0]} {i}" for i in range(1000)]  # near copies, changed far from the name
    assert ("zebulon", 12, 13) in terms(spark, [*near, away, *other, *changed])


def test_one_phrase_in_different_texts(spark):
    rng = random.Random(13)
    texts = [f"{prose(rng, 80)} Regards, Zebulon z.q@mail.example" for _ in range(12)] + [prose(rng, 200) for _ in range(40)]
    assert {t for t, *_ in terms(spark, texts)} == {"regards", "zebulon"}
    assert terms(spark, ["Regards, Zebulon z.q@mail.example"] * 12 + [prose(rng, 200) for _ in range(40)]) == set()
