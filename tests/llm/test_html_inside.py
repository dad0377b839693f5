"""Operator 8: unmarked boilerplate inside article and main goes, copied articles stay."""

import pytest

from factloom.llm import html_text


@pytest.mark.parametrize("tag", ["article", "main"])
def test_boilerplate_inside(spark, tag):
    body = lambda t: f"<body><{tag}><p>Read our notes every week.</p><div><p>{t}</p></div><p>All rights with us.</p></{tag}></body>"
    rows = [(i, "https://a.example/x", body(f"Text number {i}.")) for i in range(12)]
    rows += [(100 + i, "https://b.example/x", body("One story.")) for i in range(12)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    copied = "Read our notes every week.\nOne story.\nAll rights with us."
    for bound in (200_000, 0):
        got = {r.page_id: r.text for r in html_text.extract_pages(df, broadcast_rows=bound).collect()}
        assert got == {i: f"Text number {i}." for i in range(12)} | {100 + i: copied for i in range(12)}
