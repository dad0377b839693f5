"""Operators 1 to 4 and 6 against plain versions of themselves."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import bpe, bpe_codec, chat, common, id_blocks, quality, token_counts, words

ODD = [None, "", " ", "a", "don't we'll 's ''s", "x y 　 z\n\n  w", "<|endoftext|>", "a<|endoftext|> b<|endoftext|><|endoftext|>", "é漢字 ½²x", "a" * 5000, "\x1c\x1d \x85", "tab\t\tend ", "\0nul\0"]


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, n_tokens string")


@pytest.fixture(scope="module")
def sample(spark):
    rng = random.Random(3)
    alphabet = "ab c'strevml \n\t1é漢!<|>"
    made = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 80))) for _ in range(200)]
    rows = list(enumerate(ODD + made)) + [(None, "no id"), (5, "twice"), (5, "twice")]
    return docs(spark, rows), rows


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.vocabulary_path())


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_counts_match_the_library(sample, library):
    df, rows = sample
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.token_counts(df, limit=20).collect())
    want = sorted((i if i is not None else -1, len((t or "").encode()), n := len(ids_of(library, t)), n > 20) for i, t in rows)
    assert got == want


def test_round_trip_matches_the_library(sample, library):
    df, rows = sample
    got = sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe_codec.round_trip(df).collect())
    want = []
    for i, t in rows:
        ids = ids_of(library, t)
        back = library.decode(ids, skip_special_tokens=False)
        want.append((str(i), len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    assert got == sorted(want)
    encoded = bpe_codec.encode(df)
    assert sorted((str(r.doc_id), r.text) for r in bpe_codec.decode(encoded).collect()) == sorted((str(i), t or "") for i, t in rows)


def test_files_match_the_library(spark, sample, library):
    df, rows = sample
    got = id_blocks.round_trip(df).collect()
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    start, want = 0, []
    for i, t in ordered:
        ids = ids_of(library, t) + [2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want


def test_blocks_of_any_width_and_with_outliers():
    rng = np.random.default_rng(0)
    for high in (1, 2, 200, 65_536, 2**32 - 1):
        for n in (0, 1, 7, 512, 513, 3000):
            ids = rng.integers(0, high, n, dtype=np.uint32)
            if n:
                ids[:: 97] = 2**32 - 1
            first = np.array([0, n // 2, n])
            r = id_blocks.Reader(id_blocks.file_bytes([4, None], first, ids, 64, 0.9))
            assert r.doc_ids == [4, None]
            assert (r.ids(0, n) == ids).all() and (r.ids(n // 3, n) == ids[n // 3 :]).all()


def test_small_files_and_stores_that_overflow(spark, sample, library):
    df, rows = sample
    folder = common.fresh_path(spark, "t")
    manifest = id_blocks.write_files(df, folder, file_ids=50, partitions=3, block=16, chars=60)
    assert manifest.count() > 5
    assert id_blocks.read_files(folder, manifest).count() == len(rows)
    v = bpe.vocabulary(bpe.vocabulary_path())
    store = words.WordStore(lambda new: bpe.merge_rounds([w.encode() for w in new], v), limit=3, bits=1, longest=4)
    for t in ("one two three four two one", "two one six", "a b c d e f one", "x<|endoftext|>y longer words<|endoftext|>"):
        ids, _ = bpe_codec.gather([t], store, v)
        assert ids.tolist() == ids_of(library, t)


def test_file_starts_over_groups_of_parts(spark, monkeypatch):
    monkeypatch.setattr(id_blocks, "GROUP", 3)
    rng = random.Random(0)
    rows = [(p, k, f"f{p}-{k}", 1, rng.randint(0, 9)) for p in (0, 1, 2, 4, 7, 8, 30) for k in range(rng.randint(1, 3))]
    df = spark.createDataFrame(rng.sample(rows, len(rows)), "part int, number int, name string, n_docs long, n_ids long")
    want, total = {}, 0
    for r in rows:
        want[r[2]], total = total, total + r[4]
    assert {r.name: r.base for r in id_blocks.file_starts(df).collect()} == want


def encoders(path):
    return [lambda t: bpe_codec.encode_texts(t, path), lambda t: id_blocks.library_encode(t, path)]


def test_words_are_compared_and_not_only_hashed(library):
    """The Thue-Morse word and its complement have the same polynomial hash modulo 2^64, whatever the base."""
    s = "a"
    for _ in range(11):
        s += s.translate(str.maketrans("ab", "ba"))
    pair = [s, s.translate(str.maketrans("ab", "ba")), s[:40], s[40:80]]
    path = bpe.vocabulary_path()
    for encode in encoders(path):
        ids, at = encode(pair)
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [ids_of(library, t) for t in pair]
        ids, at = encode(pair[::-1])
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [ids_of(library, t) for t in pair[::-1]]
    assert token_counts.count_texts(pair, path).tolist() == [len(ids_of(library, t)) for t in pair]
    assert "".join(bpe_codec.decode_ids(bpe_codec.encode_texts([t], path)[0].tolist(), path) for t in pair) == "".join(pair)


def test_words_whose_hashes_are_equal(library, monkeypatch):
    """Every hash the same: all words of a piece but one are found to differ and are made exactly."""
    path = bpe.vocabulary_path()
    v = bpe.vocabulary(path)
    store = words.WordStore(lambda new: bpe.merge_rounds([w.encode() for w in new], v), bits=4)
    plain = words.split

    def same(*a):
        s = plain(*a)
        s.hash[:] = 7
        return s

    monkeypatch.setattr(words, "split", same)
    for t in ("one two three two", "four one two", " two"):
        assert bpe_codec.gather([t], store, v)[0].tolist() == ids_of(library, t)


def test_long_words_and_long_texts(library, monkeypatch):
    rng = random.Random(8)
    path = bpe.vocabulary_path()
    long_words = ["".join(rng.choice(a) for _ in range(n)) for a in ("ab", "the and", "etaoinshr", "é漢a", "a") for n in (65, 500, 4000)] + ["abab" * 300]
    texts = [" ".join(rng.choice(["alpha", "beta's", "x\n", " ", "1"]) for _ in range(3000)), *long_words]
    monkeypatch.setattr(words.parts, "__defaults__", (70, True))  # texts in many parts
    for encode in encoders(path):
        ids, at = encode(texts)
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [ids_of(library, t) for t in texts]
    assert token_counts.count_texts(texts, path).tolist() == [len(ids_of(library, t)) for t in texts]
    word = "".join(rng.choice("etaoinshrdlu") for _ in range(300_000))
    assert bpe_codec.encode_texts([word], path)[0].tolist() == ids_of(library, word)


def test_other_vocabularies_are_refused_or_followed(tmp_path):
    import json

    from tokenizers import Tokenizer

    j = json.load(open(bpe.vocabulary_path(), encoding="utf-8"))
    more = j | {"added_tokens": j["added_tokens"] + [{**j["added_tokens"][0], "id": 50_257, "content": "<|end"}, {**j["added_tokens"][0], "id": 50_258, "content": "<|x|>"}]}
    (tmp_path / "more.json").write_text(json.dumps(more))
    own = Tokenizer.from_file(str(tmp_path / "more.json"))
    text = "a<|x|>b <|endoftext|><|end<|x|> c"
    for encode in encoders(str(tmp_path / "more.json")):
        assert encode([text])[0].tolist() == own.encode(text, add_special_tokens=False).ids
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"added_tokens": [{**j["added_tokens"][0], "lstrip": True}]}):
        (tmp_path / "other.json").write_text(json.dumps(j | change))
        with pytest.raises(ValueError):
            bpe.Vocabulary(str(tmp_path / "other.json"))


def test_empty_tables(spark):
    empty = docs(spark, []).limit(0)
    assert token_counts.token_counts(empty).count() == bpe_codec.round_trip(empty).count() == id_blocks.round_trip(empty).count() == quality.quality(empty).count() == quality.keep_good(empty).count() == 0


def plain_counts(text):
    text = text or ""
    found = re.findall(common.WORD, text)
    grams = [tuple(found[i : i + 3]) for i in range(len(found) - 2)]
    covered = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
    lines = text.split("\n")
    dup = sum(1 for i, x in enumerate(lines) if re.search(common.WORD, x) and x in lines[:i])
    return len(found), sum(map(len, found)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_quality_counts(sample):
    df, rows = sample
    more = ["a b c a b c d", "x\nx\n \n \ny y y y\nx", "p q r s p q r t p q r", "\x1cword \x85a"]
    for t in [t for _, t in rows] + more:
        assert quality.base_counts(t or "") == plain_counts(t)
    assert quality.quality(df).count() == len(rows)


def test_bands(spark):
    rng = random.Random(1)
    syllables = ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(600)]
    prose = " ".join(rng.choice(syllables) for _ in range(900))
    noise = "".join(chr(rng.randint(33, 126)) + " " * (i % 9 == 8) for i in range(6000))
    repeated = " ".join(f"w{i % 40} and{i % 7}" for i in range(2000))
    half = prose + " " + "spam spam! " * 2000
    df = docs(spark, [(1, prose), (2, noise), (3, repeated), (4, half), (5, None)])
    assert [r.doc_id for r in quality.keep_good(df).collect()] == [1]
    assert {r.doc_id: r.kept for r in quality.quality(df).collect()} == {1: True, 2: False, 3: False, 4: False, 5: False}


def test_every_chunk_is_judged(spark):
    """The verdict against plain zstandard calls, on texts of all lengths; every byte is in one chunk."""
    import zstandard

    b = quality.Bands()
    rng = random.Random(6)
    syllables = ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(600)]
    prose = lambda n: " ".join(rng.choice(syllables) for _ in range(n))
    spam, noise = "spam spam! " * 400, lambda n: "".join(chr(rng.randint(33, 126)) + " " * (i % 9 == 8) for i in range(n))
    texts = [prose(rng.choice([60, 90, 300, 700, 1500])) + rng.choice(["", " " + spam[: rng.choice([90, 300, 1900, 4000])], " " + noise(rng.choice([150, 1000, 3000]))]) for _ in range(150)]
    texts += [prose(900)[:2048] + spam[:1990], prose(1500)[:2048] + noise(1900)]  # what is wrong stands in the tail

    def verdict(text):
        raw, level = text.encode(), zstandard.ZstdCompressor(level=b.level)
        inside = lambda table, x: [lo <= len(level.compress(x)) / len(x) <= hi for least, lo, hi in table if len(x) >= least][-1]
        chunks = [inside(b.by_chunk, raw[i : i + b.chunk]) for i in range(0, len(raw), b.chunk)]
        n, *_, repeats = plain_counts(text)
        return n >= 50 and 100 * repeats <= 50 * n and inside(b.by_length, raw) and chunks.count(False) <= b.chunk_share * len(chunks)

    got = [r.kept for r in quality.quality(docs(spark, list(enumerate(texts)))).orderBy("doc_id").collect()]
    assert got == [verdict(t) for t in texts]
    assert 20 < sum(got) < 140 and not got[-2] and not got[-1]


def chat_plain(text):
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def test_a_conversation_of_many_turns(spark):
    n = 100_000
    df = spark.range(n).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("turn <| "), "id").alias("text"))
    rendered = chat.render(chat.canonical(df))
    r = rendered.select(F.size(chat.parse(F.col("formatted"))).alias("n"), F.sha2(chat.loss_text(F.col("formatted"), F.col("mask")), 256).alias("loss"), F.char_length("formatted").alias("size")).head()
    assert r.n == n and r.loss == hashlib.sha256("".join(f"turn <| {i}" for i in range(1, n, 2)).encode()).hexdigest()
    assert chat.loss_spans(rendered).agg(F.max("end")).head()[0] == r.size - len("<|im_end|>\n")


def test_chat_round_trip(spark):
    texts = ["", None, "hi", "<|im_end|><|im_start|>assistant ok", "<\\|x<|", "<\\\\|im_end|>\n", "a\n<|im_start|>user\n", "漢<|"]
    roles = ["user", "assistant", None, "sys\ntem\\1", "<|im_start|>"]
    rng = random.Random(5)
    rows = [(rng.choice([None, 1, 2, 3]), rng.choice([None, 0, 1, 2, 3]), rng.choice(roles), rng.choice(texts), "x") for _ in range(60)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, turns string")
    rendered = chat.render(chat.canonical(df))
    back = rendered.select("conv_id", "formatted", chat.parse(F.col("formatted")).alias("t"), chat.loss_text(F.col("formatted"), F.col("mask")).alias("loss")).collect()
    spans = {}
    for c, a, b in sorted(map(tuple, chat.loss_spans(rendered).collect()), key=lambda x: (x[0] or 0, x[1])):
        spans.setdefault(c, []).append((a, b))
    for r in back:
        own = sorted(((t is not None, t or 0, role or "", text or "") for c, t, role, text, _ in rows if c == r.conv_id))
        assert [(t.role, t.text) for t in r.t] == [(role, text) for *_, role, text in own]
        assert r.loss == "".join(text for *_, role, text in own if role == "assistant")
        assert r.formatted.count("<|im_start|>") == len(own)
        assert "".join(chat_plain(r.formatted[a:b]) for a, b in spans.get(r.conv_id, [])) == r.loss
    assert chat.canonical(df.limit(0)).count() == 0


def test_layouts(spark):
    table = spark.createDataFrame([(1, "p", "r", 0)], "conv_id long, prompt string, response string, score int")
    assert [tuple(t) for t in chat.canonical(table).head().turns] == [("user", "p"), ("assistant", "r")]
    nested = spark.createDataFrame([(1, [("human", "q"), ("gpt", None)])], "conv_id long, conversations array<struct<from:string,value:string>>")
    assert [tuple(t) for t in chat.canonical(nested).head().turns] == [("user", "q"), ("assistant", "")]
    with pytest.raises(ValueError):
        chat.canonical(spark.range(1))
    lines = ['{"messages":[{"role":"user","content":"a"},{"role":"assistant","content":"b"}]}', '{"instruction":"do","input":"","output":"done"}', '{"output":"o","instruction":"i"}', '{"conversations":[{"from":"human","value":"v"}]}', '{"other":1}', "broken", None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "conv_id long, raw string")
    got = {r.conv_id: (r.layout, r.turns and [tuple(t) for t in r.turns]) for r in chat.canonical_json(df, "raw").collect()}
    assert got == {0: ("messages", [("user", "a"), ("assistant", "b")]), 1: ("instruction", [("user", "do"), ("assistant", "done")]), 2: ("instruction_only", [("user", "i"), ("assistant", "o")]), 3: ("from_value", [("user", "v")]), 4: (None, None), 5: (None, None), 6: (None, None)}
