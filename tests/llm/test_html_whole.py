"""Articles stay whole: constant lines, and content in several containers."""

import time

import pytest

from forecastlab.llm import html_extract


def text_of(spark, html, n):
    pages = spark.createDataFrame([(i, f"http://a.example/{i}", html % {"i": f"{i} text"}) for i in range(n)], "page_id long, url string, html string")
    return {r["page_id"]: r["text"] for r in html_extract.extract(pages).collect()}


@pytest.mark.parametrize("n", [1, 4, 5, 9])
@pytest.mark.parametrize("tags", [("<article>", "</article>"), ("<div class='content'>", "</div>"), ("<div class='x'>", "</div>")])
def test_html_keeps_constant_lines_of_articles(spark, n, tags):
    html = f"<body><nav>m</nav><div class='menu'>n</div>{tags[0]}<h1>Recipe</h1><p>a %(i)s</p><h2>Ingredients</h2><p>b %(i)s</p><div class='ad'>buy</div>{tags[1]}<footer>f</footer></body>"
    assert text_of(spark, html, n) == {i: f"Recipe\na {i} text\nIngredients\nb {i} text" for i in range(n)}


@pytest.mark.parametrize("n", [1, 2, 6])
def test_html_content_of_several_containers(spark, n):
    html = "<body><nav>m</nav><div class='content'><h1>T %(i)s</h1><section class='intro'><p>a %(i)s and much more text than elsewhere</p></section><section class='more'><p>b %(i)s</p></section></div><footer>f</footer></body>"
    assert text_of(spark, html, n) == {i: f"T {i} text\na {i} text and much more text than elsewhere\nb {i} text" for i in range(n)}
    html = "<body><nav>m</nav><article class='one'><p>a %(i)s</p></article><div>x</div><article class='two'><p>b %(i)s</p></article></body>"
    assert text_of(spark, html, n) == {i: f"a {i} text\nb {i} text" for i in range(n)}


def test_html_deep_pages(spark):
    """5,000 nested elements, on one page and on all pages of a host."""
    deep = "<body><nav>m</nav>" + "<div>" * 5_000 + "<p>deep %(i)s</p>" + "</div>" * 5_000 + "</body>"
    assert text_of(spark, deep, 3) == {i: f"deep {i} text" for i in range(3)}
    rows = [(0, "http://a.example/", "<article><p>x</p></article>"), (1, "http://a.example/", "<article>" + "<section>" * 5_000 + "y")]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r["page_id"]: r["text"] for r in got} == {0: "x", 1: "y"}


@pytest.mark.parametrize("page,text", [
    ("<p>a</p>" + "<div " * 200_000, "a"), ("<p>a</p>" + "<a '>' " * 100_000, None), ("<p>a</p>" + "<!--" * 200_000, "a"), ("<p>a</p>" + "<script>" * 100_000, "a"),
    ("<p>a</p>" + "<" * 500_000, None), ("<p>a</p>" + "<p><span class=ad>" * 50_000, "a"), ("<p>a</p><p title=\"x" + "b " * 300_000, "a"),
])
def test_html_of_a_megabyte_without_ends_takes_seconds(page, text):
    began = time.time()
    got = html_extract.main_text(page, [])
    assert time.time() - began < 20 and got.startswith("a") and (text is None or got == text)


def test_html_long_sequences_align_within_bounds():
    a = [f"k{i}" for i in range(3_000)]
    b = [x for i, x in enumerate(a) if i % 3] + ["new"] * 2
    began = time.time()
    for x, y in ((a, b), (b, a), (a[::-1], b)):
        pairs = html_extract._matches(x, y)
        assert all(x[i] == y[j] for i, j in pairs) and pairs == sorted(set(pairs)) and all(p < q for (_, p), (_, q) in zip(pairs, pairs[1:]))
    assert len(html_extract._matches(a, b)) == 2_000 and time.time() - began < 5


def test_html_wrappers_round_trip():
    one = html_extract.read("<body><div class='w-1/2 a'><p>x</p><ul><li>1</li><li>2</li></ul></div><p>y</p></body>").wrapper
    assert html_extract.from_json(html_extract.to_json(one)) == one
    assert html_extract.main_text("<body><nav>m</nav><div class='w-1/2'><p>x</p></div></body>", [["body", "div.w-0/0"]]) == "x"


@pytest.mark.parametrize("n", [1, 5])
@pytest.mark.parametrize("inside,text", [
    ("<p>a <span class='ad'>BUY <span>now</span> cheap</span>b %(i)s</p>", "a b {i} text"), ("<section class='related-work'><p>r %(i)s</p></section>", "r {i} text"),
    ("<div class='search-results'><p>r %(i)s</p></div>", "r {i} text"), ("<div class='legal'><p>r %(i)s</p></div>", "r {i} text"),
    ("<div class='related-posts'><p>r</p></div><p>b %(i)s</p>", "b {i} text"), ("<p>a <a class='promo'>x<p>b %(i)s</p>", "a\nb {i} text"),
    ("<div class='search-box'>find</div><div class='comment-list'>c</div><p>b %(i)s</p>", "b {i} text"), ("<p>1 < 2 & b %(i)s", "1 < 2 & b {i} text"),
])
def test_html_names_and_inline_marks(spark, n, inside, text):
    got = text_of(spark, f"<body><nav>m</nav><article><h1>T</h1>{inside}</article><footer>f</footer></body>", n)
    assert got == {i: "T\n" + text.format(i=i) for i in range(n)}


@pytest.mark.parametrize("name", "cookie-recipe navigation-history login-guide subscription-model promo-code social-history sidebar-note has-sidebar with-comments".split())
def test_html_names_about_something_else_keep_their_text(spark, name):
    html = f"<body><nav>m</nav><article><h1>T</h1><section class='{name}'><p>r %(i)s</p></section></article></body>"
    assert text_of(spark, html, 3) == {i: f"T\nr {i} text" for i in range(3)}


@pytest.mark.parametrize("name", "cookie-banner share-buttons post-comments comment-thread comment-17 newsletter-signup-form social-links ad-slot ads navbar-inner comment-author".split())
def test_html_names_of_marked_parts_in_articles(spark, name):
    html = f"<body><nav>m</nav><article><h1>T</h1><section class='{name}'><p>r %(i)s</p></section><p>b</p></article></body>"
    assert text_of(spark, html, 3) == {i: "T\nb" for i in range(3)}


@pytest.mark.parametrize("n", [1, 3])
@pytest.mark.parametrize("html", [
    "<body><div class='sidebar'>side %(i)s</div></body>", "<body><div class='comments'><p>c %(i)s</p></div></body>", "<nav>m %(i)s</nav><footer>f</footer>", "<body><article><div class='comments'>c %(i)s</div></article></body>",
    "<script>var t = '%(i)s'</script>",
])
def test_html_of_marked_parts_alone_has_no_text(spark, n, html):
    assert text_of(spark, html, n) == {i: "" for i in range(n)}


@pytest.mark.parametrize("line,text", [
    ("the sum <math><mi>a</mi><mo>+</mo><semantics><mn>1</mn><annotation>a+1</annotation></semantics></math> is %(i)s", "the sum a+1 is {i} text"),
    ("a <svg class='x'><path d='M0'/><text>icon</text></svg>b <button>press</button>%(i)s<canvas>old</canvas> end", "a b {i} text end"), ("a <svg/>%(i)s", "a {i} text"), ("a <input value='v'>%(i)s <embed src='x'>end", "a {i} text end"),
])
def test_html_formulas_and_unseen_parts_stay_inside_their_line(spark, line, text):
    assert text_of(spark, f"<body><article><p>{line}</p></article></body>", 2) == {i: text.format(i=i) for i in range(2)}


def test_html_fourth_class_counts(spark):
    html = "<body><div class='a b c w'><p>x %(i)s</p></div><div class='a b c sidebar'><p>y %(i)s</p></div></body>"
    assert text_of(spark, html, 3) == {i: f"x {i} text" for i in range(3)}


def test_html_repeated_pages_of_a_host(spark):
    rows = [(1, "http://a.example/1", "<body><nav>m</nav><div class='x'><p>one</p></div></body>")] * 4 + [(2, "http://a.example/2", None), (None, None, "<p>z</p>")]
    got = [tuple(r)[:3] for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()]
    assert sorted(got, key=str) == sorted([(1, "http://a.example/1", "one")] * 4 + [(2, "http://a.example/2", ""), (None, None, "z")], key=str)
