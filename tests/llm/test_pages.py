"""HTML extraction and URL filter."""

import random
import time

import odd
import pytest
from conftest import SMALL
from hypothesis import given
from hypothesis import strategies as st

from millrace.llm import html_text, queries, url_filter

SCHEMA = "page_id long, url string, html string"


@given(st.lists(st.integers(0, 5), max_size=14), st.lists(st.integers(0, 5), max_size=14))
def test_shared_lines_are_a_longest_common_subsequence(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
    at = html_text.shared_lines(a, b)
    assert len(at) == best[-1][-1] and at == sorted(set(at))
    rest = iter(b)
    assert all(any(a[i] == x for x in rest) for i in at)


ARTICLE = """<!doctype html><html><head><title>T</title><style>p{}</style></head><body>
<div class="cookie-notice">We use cookies</div><header><h1>Site</h1></header><nav><ul><li>Home</ul></nav>
<article><header><h2>A &amp; B</h2></header><p>One\n  two&nbsp;three <b>bold</b>.<script>var x = "<p>no</p>";</script>
<p>Caf&eacute; &#8211; 1 &lt; 2<div class="ad-slot">Buy</div><form><input value=x>Sign up</form></article>
<section id="comments"><p>First!</p></section><aside>More</aside><footer>(c)</footer></body></html>"""


def test_article_without_furniture(spark):
    df = spark.createDataFrame([(1, "http://a.example/x", ARTICLE)], SCHEMA)
    row = html_text.main_text(df).head()
    assert row["text"] == "A & B\n\nOne two three bold.\n\nCafé – 1 < 2"
    assert row["n_chars"] == len(row["text"])


def page(*lines):
    return "<body>" + "".join(f"<div>{x}</div>" for x in lines) + "</body>"


def test_unmarked_pages_lose_what_the_nearest_shares(spark):
    rows = [(i, f"http://h.example/{'ab'[i % 2]}/{i}", page("Top", "Menu" + "AB"[i % 2], f"Own text {i}", f"More {i}", "Bottom")) for i in range(20)]
    rows += [(90, "http://other.example/a/0", page("Top", "Alone", "Bottom")), (91, "http://h.example/a/0", rows[0][2])]
    got = {r["page_id"]: r["text"] for r in html_text.main_text(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[i] == f"Own text {i}\n\nMore {i}" for i in range(20))
    assert got[90] == "Top\n\nAlone\n\nBottom" and got[91] == got[0]


SITE = "<body><nav>Menu</nav><article><h1>Title {0}</h1><p>Text {0} of this page</p>{1}</article><div>Foot {0}</div></body>"


def test_markup_has_a_vote(spark):
    hints = '<div class="related-work"><p>Related work of page {0}</p></div><section class="social-history">History {0}</section><div class="share-price">Up {0}</div><div class="ad-story">Subscribe now</div>'
    inside = "<p>Follow us everywhere</p>"  # unnamed, on every page
    rows = [(i, f"http://h.example/a/{i:02}", SITE.format(i, hints.format(i) + inside)) for i in range(9)]
    got = {r["page_id"]: r["text"] for r in html_text.main_text(spark.createDataFrame(rows, SCHEMA)).collect()}
    own = lambda i: f"Title {i}\n\nText {i} of this page\n\nRelated work of page {i}\n\nHistory {i}\n\nUp {i}"
    assert all(got[i] == own(i) for i in range(1, 8))
    # a page at the end of its host has one neighbour: what a name hints at goes, the rest stays
    assert got[0] == own(0) + "\n\nFollow us everywhere" and got[8] == own(8) + "\n\nFollow us everywhere"


def test_edited_copies_keep_their_article(spark):
    rows = [(i, f"http://h.example/a/{i:02}", SITE.format(i, "".join(f"<p>Paragraph {j} that all editions have</p>" for j in range(6)))) for i in range(5)]
    got = html_text.main_text(spark.createDataFrame(rows, SCHEMA)).collect()
    assert all(r["text"].count("all editions") == 6 for r in got)


def test_a_teaser_is_not_the_article(spark):
    body = "".join(f"<p>Long paragraph {{0}}-{j} of the page's real text</p>" for j in range(5))
    rows = [(i, f"http://h.example/a/{i:02}", f"<body><div>Site name</div><article>Read also: story {i}</article>{body.format(i)}</body>") for i in range(4)]
    got = {r["page_id"]: r["text"] for r in html_text.main_text(spark.createDataFrame(rows, SCHEMA)).collect()}
    for i in range(4):
        assert got[i] == "\n\n".join([f"Read also: story {i}", *(f"Long paragraph {i}-{j} of the page's real text" for j in range(5))])


@pytest.mark.parametrize("html, text", [
    ("<ul><li>One<li>Two<p>Three</ul>", "One\n\nTwo\n\nThree"),
    ("<table><tr><td>A<td>B<tr><td>C</table>", "A\n\nB\n\nC"),
    ("<p>One <b>bold <div>Two</div> three", "One bold\n\nTwo\n\nthree"),
    ("<div><p>One<section><p>Two</section>Three</div>Four", "One\n\nTwo\n\nThree\n\nFour"),
    ("<div class='ad-slot'>Buy</div><div class='related-posts'>More</div><p>Kept", "Kept"),
    ("<article><p>In<aside>Out</aside><p>In again", "In\n\nIn again"),
    ("</div></p>Stray<em>phasis</em></article>", "Strayphasis"),
])
def test_blocks_of_loose_markup(html, text):
    assert "\n\n".join(t for t, _ in html_text.blocks_of(html)) == text


def test_deep_pages_take_linear_time():
    n = 20_000
    for page in ("<div>" * n + "x" + "</div>" * n, "<p>" + "<b>" * n + "x" + "<hr>" * n, "<div><p><div>" + "<b>" * n + "x" + "<hr>" * n, "<b><p>" * n + "x" + "</b>" * n):
        began = time.time()
        assert [t for t, _ in html_text.blocks_of(page)] == ["x"]
        assert time.time() - began < 5


def nearest_by_hand(rows):
    """Text of each page, its neighbours found in one sorted list."""
    blocks = {k: html_text.blocks_of(h) for k, (_, h) in rows.items()}
    order = sorted(rows, key=lambda k: (*url_filter.split_url(rows[k][0]), k))
    out = {}
    for at, k in enumerate(order):
        own, best = blocks[k], None
        if any(m for _, m in own):
            out[k] = "\n\n".join(t for t, m in own if m)
            continue
        for n in [order[j] for j in (at - 1, at + 1) if 0 <= j < len(order)]:
            if url_filter.split_url(rows[n][0])[0] == url_filter.split_url(rows[k][0])[0]:
                lost = html_text.shared_lines([t for t, _ in own], [t for t, _ in blocks[n]])
                lost = [] if len(lost) == len(own) else lost
                near = html_text._common_prefix(url_filter.split_url(rows[k][0])[1], url_filter.split_url(rows[n][0])[1])
                best = max(best or (-1,), (near, len(lost), lost))
        out[k] = "\n\n".join(t for i, (t, _) in enumerate(own) if not best or i not in best[2])
    return out


def test_whole_table_equals_one_sorted_list(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet").collect()
    keyed = html_text.F.xxhash64("url", "html")
    keys = {r["page_id"]: r["k"] for r in spark.read.parquet(f"{SMALL}/pages.parquet").select("page_id", keyed.alias("k")).collect()}
    want = nearest_by_hand({keys[r["page_id"]]: (r["url"], r["html"]) for r in pages})
    got = queries.op2_html_text(spark, SMALL).collect()
    assert len(got) == len(pages)
    assert all(r["text"] == want[keys[r["page_id"]]] for r in got)


def test_odd_pages(spark):
    rows = [(1, None, None), (2, "", ""), (3, "no scheme", "plain text  only"), (3, "no scheme", "plain text  only"), (None, "http://a/b", "<p>x"), (4, "http://a/b", "<div " * 500 + "<" * 2000), (5, "http://a/c", "<p>" + "y " * 200_000), (6, "http://a/d", "<!-- open"), (7, "http://a/d", "<script>never closed"), (8, "http://a/e", "&#0;&#xFFFFFFF;&bogus;&amp")]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", *(f"1 AS {c}" for c in odd.CLASHES))
    got = html_text.main_text(df).collect()
    assert len(got) == len(rows)
    assert [r["text"] for r in got if r["page_id"] in (1, 2, 6, 7)] == [""] * 4
    assert {r["text"] for r in got if r["page_id"] == 3} == {"plain text only"}
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert html_text.main_text(df.limit(0)).collect() == []


HOSTS = [url_filter.HostRule(v, r) for v, r in (("block", "com/en/"), ("allow", "example.com/en/7"), ("block", "a.net/"), ("allow", "net/x"))]
PATTERNS = [url_filter.PatternRule(v, p) for v, p in (("block", "||ads.*/x^"), ("block", "-bets."), ("block", "*track*"), ("allow", "/track/ok^"), ("block", "/a/b*c/"))]


def test_index_misses_no_rule():
    rng = random.Random(3)
    parts = ["ads", "a", "b", "bxc", "track", "ok", "x", "en", "7", "best-bets", "example"]
    for counts in ({}, {"ads": 5, "x": 1}, {"track": 9, "ok": 9, "com": 3}):
        index = url_filter.RuleIndex(HOSTS, PATTERNS, counts)
        every = url_filter.RuleIndex([], [], {})
        every.always = index.always + [r for rules in index.by_token.values() for r in rules]
        for _ in range(3000):
            host = ".".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) + rng.choice([".com", ".net", ""])
            path = "".join("/" + rng.choice(parts) for _ in range(rng.randint(0, 4))) + rng.choice(["", "/"])
            assert index.judge(host, path) == every.judge(host, path)


LIST = """[Adblock Plus 2.0]
! comment
# another
||ads.example^
@@||ads.example/ok|
|login.
/pixel.gif|
*track*
0.0.0.0 Bad.example worse.example # hosts file
127.0.0.1\tlocal.example
/script.js$third-party,script
example.com##.banner
||ads.example^
"""


def test_filter_lists():
    rules = url_filter.parse_rules(LIST.splitlines())
    assert [(r.verdict, r.pattern) for r in rules] == [("block", p) for p in ("||ads.example^",)] + [("allow", "||ads.example/ok|")] + [("block", p) for p in ("|login.", "/pixel.gif|", "*track*", "||bad.example^", "||worse.example^", "||local.example^")]
    index = url_filter.RuleIndex([], rules, {})
    judge = lambda host, path: index.judge(host, path)[1:]
    assert judge("a.ads.example", "/x") == ("||ads.example^", "block") and judge("ads.example", "") == ("||ads.example^", "block")
    assert judge("ads.example", "/ok") == ("||ads.example/ok|", "allow") and judge("ads.example", "/okay") == ("||ads.example^", "block")
    assert judge("login.a", "/") == ("|login.", "block") and judge("my.login.a", "/") == (None, "allow")
    assert judge("a", "/pixel.gif") == ("/pixel.gif|", "block") and judge("a", "/pixel.gifs") == (None, "allow")
    assert judge("a", "/xtracky\n") == ("*track*", "block") and judge("notbad.example", "/") == (None, "allow")


def test_exceptions_win_and_options_that_urls_decide_count():
    lines = ["@@||good.com^", "/advertising/banner/", "/Upper/$match-case", "/always/$important", "||ads.com^$third-party", "||page.com^$document,script", "/part.js$script", "||x.com^$domain=a.com|b.com,image", "a.com##.b", "a.com#@#.c", "@@/always/"]
    rules, left = url_filter.parse_list(lines)
    assert left == {"third-party": 1, "script": 1, "domain": 1, "image": 1, "##": 2}
    index = url_filter.RuleIndex([], rules, {})
    judge = lambda host, path: index.judge(host, path)[1:]
    assert judge("good.com", "/advertising/banner/") == ("||good.com^", "allow")
    assert judge("bad.com", "/ADVERTISING/banner/") == ("/advertising/banner/", "block")
    assert judge("a.com", "/Upper/")[1] == "block" and judge("a.com", "/upper/")[1] == "allow"
    assert judge("good.com", "/always/") == ("/always/", "block")
    assert judge("ads.com", "/")[1] == judge("x.com", "/")[1] == "allow" and judge("www.page.com", "/")[1] == "block"
    assert len(queries.PATTERNS) > 200


def test_thousands_of_rules():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.choice([2, 3, 4])))
    forms = ("||{0}.{1}^", "/{0}/{1}/", "-{0}.", "|{0}.{1}/", "/{0}*{1}/", "@@||{0}.{1}/{0}", "/{0}.{1}|", "{0}{1}")
    rules = url_filter.parse_rules(rng.choice(forms).format(word(), word()) for _ in range(6000))
    assert len(rules) > 4000
    counts = {}
    urls = [(f"{word()}.{word()}", "".join(f"/{word()}" for _ in range(rng.randrange(4))) + rng.choice(["", "/", f".{word()}"])) for _ in range(400)]
    for host, path in urls:
        for t in url_filter._TOKEN.findall(f"{host}{path}"):
            counts[t] = counts.get(t, 0) + 1
    index = url_filter.RuleIndex(HOSTS, rules, counts)
    every = url_filter.RuleIndex([], [], {})
    every.always = index.always + [r for filed in index.by_token.values() for r in filed]
    assert all(index.judge(*u) == every.judge(*u) for u in urls)
    tried = [sum(len(index.by_token.get(t, ())) for t in set(url_filter._TOKEN.findall(f"{h}{p}"))) for h, p in urls]
    assert sum(tried) / len(tried) < 0.01 * len(rules)


@pytest.mark.parametrize("url, host, path, rule, verdict", [
    ("http://WWW.Example.COM/en/7?q#f", "www.example.com", "/en/7", "example.com/en/7", "allow"),
    ("https://example.com/en/8", "example.com", "/en/8", "com/en/", "block"),
    ("http://notcom/en/", "notcom", "/en/", None, "allow"),
    ("http://com/en/", "com", "/en/", "com/en/", "block"),
    ("x://É.com#/en/", "É.com", "", None, "allow"),
    ("//example.com/en/", "", "", None, "allow"),
    ("", "", "", None, "allow"),
    (None, "", "", None, "allow"),
])
def test_host_rules(spark, url, host, path, rule, verdict):
    df = spark.createDataFrame([(1, url, 1, 1)], "page_id long, url string, host int, rule int")
    assert tuple(url_filter.judge_urls(df, queries.HOST_RULES).select("page_id", "host", "path", "rule", "verdict").head()) == (1, host, path, rule, verdict)


def test_urls_of_an_empty_table(spark):
    assert url_filter.judge_urls(spark.createDataFrame([], "page_id long, url string"), queries.HOST_RULES, queries.PATTERNS).collect() == []


STORY = "A paragraph of the story that goes on for a while, with words enough to be one. " * 6


@pytest.mark.parametrize("page, want", [
    (f'<body><form id="aspnetForm" action="/x"><input type="hidden" name="v"><nav>Menu</nav><div><h1>T</h1><p>{STORY}</p></div></form></body>', ["T", STORY.strip()]),
    (f'<body><form><input name="v"><article><p>{STORY}</p></article></form></body>', [STORY.strip()]),
    (f'<body><article><p>{STORY}</p><form><label>Name</label><input name="n"><textarea>x</textarea></form></article></body>', [STORY.strip()]),
    (f'<article><p>{STORY}</p><section class="related"><h2>Related work</h2><p>Others did <a href="/a">this</a> and that before.</p></section></article>', [STORY.strip(), "Related work", "Others did this and that before."]),
    (f'<article><p>{STORY}</p><div class="related"><a href="/a">One more story</a> <a href="/b">Another</a></div></article>', [STORY.strip()]),
    ('<article><p>Price <span class="alert">alert</span> now <b class="ad">end</b></p></article>', ["Price alert now end"]),
    (f"<nav data-u=/x/>Home<ul><li>Menu</ul></nav><article><div/><p>{STORY}</p></article>", [STORY.strip()]),
    (f'<article><p>{STORY}</p><div class="ad">Buy</div><div class="comments"><p>First!</p></div></article>', [STORY.strip()]),
])
def test_forms_names_and_slashes(page, want):
    assert [t for t, _ in html_text.blocks_of(page)] == want
