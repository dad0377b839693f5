"""Operators 8, 9 and 10 against brute force and written-out cases."""

import random
import re

import numpy as np
import pytest

from factloom.llm import decontaminate, html_text, pii


# --- 8

ARTICLE = "<article><header><h1>A &amp; B</h1></header><p>One  two<b>three</b>\n four.<p>Five<br>six</p><div class='ad'>buy</div><section id=comments><p>first!</p></section><ul><li>x<li>y</ul></article>"
PAGE = f"<html><head><title>t</title><script>if (a</b) '</p>'</script></head><body><nav><a href=/>home</a></nav><div class=cookie-notice>ok?</div><!-- <p>no</p> -->{ARTICLE}<aside>s</aside><form><p>mail</p></form><footer>f</footer></body></html>"


def test_article_of_a_page():
    assert html_text.extract(PAGE) == "A & B\nOne twothree four.\nFive six\nx\ny"


@pytest.mark.parametrize("html, text", [(None, ""), ("", ""), ("plain", "plain"), ("<p>a<p>b", "a\nb"), ("<p>a &lt; b &#233;&nbsp;c", "a < b é c"), ("<script>x", ""), ("a<!-- open", "a"), ("<p title='>'>q</p>", "q"), ("<p title='x>q</p>", "q"), ("<div>" * 3000 + "deep" + "</div>" * 3000 + "<p>after", "deep\nafter"), ("<main><p>m</main><p>out", "m"), ("1 < 2 & 3", "1 < 2 & 3"), ("<b>" * 3000 + "x" + "</b>" * 3000 + "<p>y", "x\ny"), ("</div>" * 50 + "<div>" * 50 + "</p></b>" * 50 + "z", "z")])
def test_odd_pages(html, text):
    assert html_text.extract(html) == text


def test_nothing_is_lost_in_depth_or_by_longer_names():
    deep = "<article>" + "<div>" * 210 + "<p>ok</p><nav>menu home</nav><aside>side</aside><form>f</form><p>more</p>"
    assert html_text.extract(deep) == "ok\nmore"
    named = "<article><div class='article-header'><h1>Title</h1><p>Lead.</p></div><p class='notice-of-death'>Obituary</p><div class='share-price'><p>Shares rose.</p></div><p>Body.</p></article>"
    assert html_text.extract(named) == "Title\nLead.\nObituary\nShares rose.\nBody."
    dropped = "".join(f"<div class='{c}'>no</div>" for c in ("ad", "x ad-slot", "commentList", "site-header", "cookie_notice", "related-posts", "Sidebar2"))
    assert html_text.extract(f"<article><p>a</p>{dropped}<div id=comments>no</div><p>b</p></article>") == "a\nb"
    long_page = "<article>" + "".join(f"<p>Paragraph {i} &amp; more.</p>" for i in range(40_000)) + "</article>"
    assert html_text.extract(long_page).count("\n") == 39_999


def plain_counts(pages):
    """Hash counts by another way: every block's tags and words written out as a string, counted over page ids."""
    def spelled(node):
        return (node.tag, *(" ".join(x.split()) if isinstance(x, str) else spelled(x) for x in node.children if (x.split() if isinstance(x, str) else x.tag not in ("script", "style"))))

    def blocks(node):
        for x in node.children:
            if not isinstance(x, str) and x.tag not in ("script", "style"):
                if x.tag in html_text.BLOCK and x.tag != "body" and html_text._text(x).strip():
                    yield spelled(x)
                yield from blocks(x)

    seen = {}
    for i, url, html, *_ in pages:
        root = html_text.parse(html or "")
        for b in {*blocks(root)}:
            seen.setdefault((html_text.host_of(url), b), set()).add(i)
    return sorted(len(s) for s in seen.values())


def test_hash_counts_are_those_of_written_out_subtrees(spark):
    rng = random.Random(3)
    rows = []
    for i in range(60):
        body = "".join(rng.choice(["<p>same</p>", "<div><p>one</p> two</div>", f"<p>own {i}</p>", "<ul><li>x<li>y</ul>", "<p>  spaced\n out</p>", "<div> </div>", "<script>s</script>"]) for _ in range(rng.randint(0, 6)))
        rows.append((i, f"https://{rng.choice('ab')}.example/{i}", f"<body>{body}</body>"))
    rows += [rows[3]] * 5
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    counted = html_text.page_hashes(df).filter("hash IS NOT NULL").select("host", "hash", "whole").distinct().groupBy("host", "hash").count()
    assert sorted(r["count"] for r in counted.collect()) == plain_counts(rows)


def test_counting_decides(spark):
    """Without the counted hashes the same pages keep their boilerplate; with a share above its own it stays too."""
    rows = [page(i, "a.example", f"Text number {i}.") for i in range(12)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    assert {r.text for r in html_text.extract_pages(df).collect()} == {f"Text number {i}." for i in range(12)}
    assert html_text.extract(rows[0][2]) == "Welcome to a.example\nOur partners\nText number 0.\nImprint of a.example"
    rare = [page(100 + i, "b.example", f"Text {i}.") for i in range(4)] + [(200 + i, "https://b.example/y", f"<p>Other {i}.") for i in range(50)]
    got = {r.page_id: r.text for r in html_text.extract_pages(spark.createDataFrame([r[:3] for r in rare], "page_id long, url string, html string")).collect()}
    assert got[100].startswith("Welcome to b.example") and got[230] == "Other 30."


def page(i, host, body):
    return (i, f"https://{host}/x/{i}", f"<html><body><div><p>Welcome to {host}</p><p>Our partners</p></div><div><p>{body}</p></div><div><p>Imprint of {host}</p></div></body></html>", "clash")


def test_templates_of_a_site(spark):
    rows = [page(i, "a.example", f"Text number {i} has its own words {i * 7}.") for i in range(12)] + [page(100, "b.example", "Alone.")]
    copied = "A long story. " * 60
    rows += [page(200 + i, "c.example", copied) for i in range(8)] + [(300, None, None, "x"), (None, "notaurl", "<p>z", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    want = {r[0]: f"Text number {r[0]} has its own words {r[0] * 7}." for r in rows[:12]} | {100: "Welcome to b.example\nOur partners\nAlone.\nImprint of b.example", 300: "", None: "z"} | {200 + i: copied.strip() for i in range(8)}
    for bound in (200_000, 0):  # hashes sent to the executors, and joined
        got = {r.page_id: (r.text, r.n_chars) for r in html_text.extract_pages(df, broadcast_rows=bound).collect()}
        assert got == {k: (t, len(t)) for k, t in want.items()}
    assert html_text.extract_pages(df.limit(0)).count() == 0


# --- 9

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (12 <= len(digits) <= 19 and pii.luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), m.end(), kind))
    return sorted(out, key=lambda s: (s[0], list(PLAIN).index(s[2])))


def test_base_spans():
    rng = random.Random(9)
    parts = ["a", "@", ".", "1", "23", "255", "256", " ", "-", "+1", "(", ")", "x.y@z.w", "1.2.3.4", "4242 4242 4242 4242", "+49 (170) 555-0100", "é", "000", "_"]
    for _ in range(4000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert pii.base_spans(t) == plain_spans(t), t
    assert pii.luhn("4242424242424242") and not pii.luhn("4242424242424241")
    assert pii.base_spans("9" * 200_000 + " " + "a" * 200_000) == []


def test_terms_that_reveal(spark):
    rng = random.Random(2)
    common_words = [f"{a}{b}" for a in ("stone", "water", "paper", "light", "green") for b in ("ing", "ed", "er", "ly", "ness")]
    prose = lambda n: " ".join(rng.choice(common_words) for _ in range(n))
    rows = [(i, f"{prose(80)} Zebulon {prose(1)} z.q@mail.example {prose(80)}") for i in range(12)]
    rows += [(50 + i, "Copied Wording here with k.c@mail.example and more text") for i in range(9)]
    rows += [(100 + i, prose(200)) for i in range(40)] + [(200, None), (201, ""), (None, "Zebulon, alone"), (100, "again")]
    df = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, spans string")
    d = pii.Disclosure(bits=4)  # a corpus of ten thousand words gives no more
    assert {r.term for r in pii.disclosing_terms(df, d).collect()} == {"zebulon"}
    got = {(r.doc_id, r.spans) for r in pii.find(df, d).collect()}
    assert (None, "term:0:7") in got and (200, "") in got and (100, "") in got
    assert all(s.count("term") == 1 for i, s in got if i is not None and i < 12)
    clean = {r.doc_id: r.text for r in pii.sanitise(df, d).collect()}
    assert "Zebulon" not in clean[3] and "[TERM]" in clean[3] and "[EMAIL]" in clean[3] and clean[200] is None
    assert clean[51] == "Copied Wording here with [EMAIL] and more text"
    small = pii.Disclosure(bits=4, block=0)  # joined, they give the same
    assert {(r.doc_id, r.spans) for r in pii.find(df, small).collect()} == got
    assert {r.doc_id: r.text for r in pii.sanitise(df, small).collect()} == clean and pii.sanitise(df, small).columns == df.columns
    assert pii.find(df.limit(0)).count() == 0


def test_information_is_that_of_the_entitys_own_windows(spark):
    """Against a count by hand: n_near / n_all over n_entity windows of all words."""
    import math

    rng = random.Random(4)
    prose = lambda n: " ".join(rng.choice(["stoning", "waters", "papers", "lighted"]) + str(rng.randint(0, 99)) for _ in range(n))
    texts = [f"{prose(60)} {'Zebulon ' if i < 6 else ''}{prose(1)} z.q@mail.example {prose(60)}" for i in range(10)] + [f"{prose(30)} Zebulon {prose(30)}" for _ in range(2)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    d = pii.Disclosure(bits=0, support=6)
    r = {r.term: r for r in pii.disclosing_terms(df, d).collect()}["zebulon"]
    words = sum(len(t.split()) for t in texts)
    assert (r.n_near, r.n_all, r.n_entity) == (6, 8, 10)
    assert abs(r.bits - math.log2(6 / 8 * words / (10 * 2 * d.window))) < 1e-9


def test_terms_through_the_registered_query(spark, tmp_path):
    from factloom.llm import queries

    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(3000)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    texts = [f"{prose(150)} Zebulon {prose(1)} z.q@mail.example {prose(150)}" for _ in range(9)] + [prose(400) for _ in range(120)] + [None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.QUERIES["op9_pii"](spark, str(tmp_path)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        base = pii.base_spans(t or "")
        at = (t or "").find("Zebulon")
        want = sorted(base + ([(at, at + 7, "term")] if at >= 0 else []))
        assert got[i].spans == ",".join(f"{k}:{a}:{b}" for a, b, k in want) and got[i].n_email == len(base)


def test_spans_merge_in_linear_time():
    import time

    text = " ".join(f"a{i}@b.example Zebulon, {i}" for i in range(40_000))
    began = time.process_time()
    found = pii.all_spans(text, {"zebulon"}, 4)
    assert len(found) == 80_000 and time.process_time() - began < 20
    rng = random.Random(1)
    for _ in range(300):
        base = sorted({(a, a + rng.randint(1, 9), "email") for a in rng.sample(range(60), 6)})
        starts = sorted(rng.sample(range(60), 6))  # terms are words: they do not overlap each other
        terms = [(a, min(a + rng.randint(1, 5), b), "term") for a, b in zip(starts, [*starts[1:], 99])]
        assert pii.merged(base, terms) == sorted(base + [t for t in terms if not any(a < t[1] and t[0] < b for a, b, _ in base)], key=lambda s: (s[0], pii._ORDER[s[2]]))


# --- 10

def edit_distance_within(item, text):
    """Least edits between the item and any substring of the text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, x in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != x), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def folded(text):
    return "".join(map(chr, decontaminate.fold(text or "")[0]))


def test_matches_are_those_of_brute_force(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdeéf") for _ in range(rng.randint(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    items = [(0, prose(30)), (1, prose(25)), (2, "Tiny bit"), (3, None), (4, ""), (5, prose(12)), (None, prose(30)), (0, prose(30))]

    def noisy(t, n):
        t = list(t)
        for _ in range(n):
            p = rng.randrange(len(t))
            t[p : p + 1] = rng.choice([[], ["q"], [t[p], "z"], [t[p].upper()]])
        return "".join(t)

    docs = [(0, None), (1, ""), (2, prose(300)), (3, "x tiny \n BIT y")]
    for k in range(40):
        i, t = rng.choice([x for x in items if x[1]])
        docs.append((10 + k, prose(rng.randint(0, 40)) + " " + noisy(t, rng.randint(0, 14)).replace(" ", rng.choice([" ", "\n ", "  "])) + " " + prose(rng.randint(0, 40))))
    docs.append((None, items[0][1]))
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, item_id long")
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.matches(df, bench).collect()
    index = decontaminate.Index([x for x in items if x[1]], 9, 0.08)
    want = set()
    for d, t in docs:
        for k, (i, item) in enumerate([x for x in items if x[1]]):
            if t and edit_distance_within(folded(item), folded(t)) <= index.edits[k]:
                want.add((d, i))
    assert {(r.doc_id, r.item_id) for r in found} == want
    by_id = dict(docs)
    for r in found:
        piece = folded(by_id[r.doc_id][r.begin : r.end])
        assert min(edit_distance_within(folded(t), piece) for i, t in items if t and i == r.item_id) <= r.edits
    many = decontaminate.matches(df, bench, block_chars=1).collect()  # a pass for each item
    assert sorted(map(str, many)) == sorted(map(str, found))
    kept = {r.doc_id for r in decontaminate.keep_clean(df, bench).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _ in want}
    assert decontaminate.matches(df.limit(0), bench).count() == decontaminate.matches(df, bench.limit(0)).count() == 0


def test_folding_keeps_places():
    text = "A  b\n\tÉİx "
    code, origin = decontaminate.fold(text)
    assert "".join(map(chr, code)) == "a b éİx " and [text[i] for i in origin][:3] == ["A", " ", "b"]
    assert np.all(np.diff(origin) > 0)
