"""Nothing of a page, a source or a group of copies is left out."""

import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("html, text", [
    ("<html><head><title>t</title><body><article><p>Body text</p></article>", "Body text"),
    ("<html><head><meta charset=x><style>p{}</style><article>No end of head</article>", "No end of head"),
    ("<html><head><title>t</title><script>'<p>'</script></head><body><article>Closed</article>", "Closed"),
    ("<article>One <svg class='i'/> two</article>", "One two"),
    ("<article>One <svg><svg></svg>x</svg> two</article>", "One two"),
    ("<article><p>One <svg><path d='x'><p>two</article>", "One\n\ntwo"),
    ("<article>One <!-- <style> <svg> --> two</article>", "One two"),
    ("<article>One <a title='<svg>'>two</a> three</article>", "One two three"),
    ("<article>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> be</article>", "Let x=1 be"),
    ("<article><object data=x><p>Fallback</p></object></article>", "Fallback"),
    ("<article><svg-icon></svg-icon><p>Kept</p></article>", "Kept"),
])
def test_pages_lose_nothing_else(html, text):
    from millrace.llm import html_text

    blocks = html_text.blocks_of(html)
    assert all(m for _, m in blocks) and "\n\n".join(t for t, _ in blocks) == text


def test_copies_are_looked_past(spark):
    from millrace.llm import html_text

    page = lambda own: f"<body><div>Menu</div><div>{own}</div><div>Foot</div></body>"
    rows = [(i, f"http://h.example/a/{i:03}", page("Copied")) for i in range(40)] + [(100, "http://h.example/b", page("Other")), (101, "http://lone.example/", page("Copied"))]
    got = {r["page_id"]: r["text"] for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {**{i: "Copied" for i in range(40)}, 100: "Other", 101: "Menu\n\nCopied\n\nFoot"}


def test_every_source_gives_pseudo_labels(spark):
    from millrace.llm import quality

    # 6,000 unlabelled documents of one source, and 3 of another without labels
    text = lambda i: "fine words of many kinds " * 3 + str(i) if i // 3 % 2 else "spam spam spam spam"
    rows = [(i, text(i), "en", "big", len(text(i))) for i in range(6200)] + [(9000 + i, text(i), "fr", "small", len(text(i))) for i in range(3)]
    docs = spark.createDataFrame(rows, DOCUMENTS)
    taken, real = [], quality._surest

    def spy(*args):
        out = real(*args)
        taken.extend(out)
        return out

    quality._surest = spy
    try:
        quality.fit(docs, spark.createDataFrame([(i, i // 3 % 2) for i in range(200)], "doc_id long, quality int"), rounds=1)
    finally:
        quality._surest = real
    assert any(r["doc_id"] >= 9000 for r in taken) and all(r["doc_id"] >= 200 for r in taken)
    assert all(r["y"] == r["doc_id"] // 3 % 2 for r in taken if r["view"] == 0)
