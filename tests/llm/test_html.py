"""Main text of pages: the tolerant parser, wrapper inference and extraction."""

import html as markup
import itertools
import re

import pytest

from clientele.llm.html_tokens import Node, parse
from clientele.llm.html_wrapper import Reader, align, main_text, regex, wrapper_of, wrappers


def page(title, paragraphs, menu=3, notice="We use cookies", article=True, comments=()):
    links = "".join(f"<li><a href=/{i}>m{title}{i}</a>" for i in range(menu))
    body = "".join(f"<p>{p}</p>" if i % 2 else f"<p>{p}" for i, p in enumerate(paragraphs))
    if article:
        body = f"<article><h1>{title}</h1>{body}</article>"
    said = "".join(f"<div class='comment'>{c}</div>" for c in comments)
    return (
        f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style><script>var t='</p>';</script></head><body>"
        f"<nav><ul>{links}</ul></nav><div class='ad box'>buy</div><p>{notice}</p>{body}{said}<form>mail <input></form>"
        "<footer>&copy; all</footer></body></html>"
    )


def text_of(pages, html):
    whole = wrapper_of(parse(pages[0]))
    for other in pages[1:]:
        whole = align(whole, wrapper_of(parse(other)))
    return Reader(whole).blocks(parse(html))


def test_the_article_is_read_without_what_surrounds_it():
    pages = [page(f"T{i}", [f"first {i} &amp; <b>more</b>", "a\n  b<br>c", "x &lt; y"][: i + 1], menu=i + 1, comments=["no"] * i) for i in range(3)]
    assert text_of(pages, pages[2]) == ["T2", "first 2 & more", "a b c", "x < y"]
    assert text_of(pages, pages[0]) == ["T0", "first 0 & more"]


def test_without_an_article_constant_text_and_link_lists_go():
    pages = [page(f"T{i}", [f"only {i}", f"second {i}"], article=False) for i in range(4)]
    assert text_of(pages, pages[1]) == ["only 1", "second 1"]


def test_a_host_of_copies_keeps_its_article():
    pages = [page("T", ["same", "same too"])] * 5
    assert text_of(pages, pages[0]) == ["T", "same", "same too"]
    plain = [page("T", ["same", "same too"], article=False, menu=0)] * 5
    assert text_of(plain, plain[0]) == ["We use cookies", "same", "same too"]


@pytest.mark.parametrize("order", list(itertools.permutations(range(3))))
def test_the_wrapper_covers_every_page_in_any_order(order):
    bodies = [["a"], ["a", "b", "c"], ["a", "b"]]
    pages = [f"<body><h2>{i}</h2>" + "".join(f"<p>{b}{i}</p>" for b in bodies[i]) + ("<ul><li>x<li>y</ul>" if i == 1 else "") for i in order]
    whole = wrapper_of(parse(pages[0]))
    for other in pages[1:]:
        whole = align(whole, wrapper_of(parse(other)))
    assert regex(whole) == "<#page> <body> <h2> # </h2> ( <p> # </p> )+ ( <ul> ( <li> # </li> )+ </ul> )? </body> </#page>"


def test_runs_of_groups_fold_into_one_repeated_group():
    tree = parse("<dl>" + "".join(f"<dt>t{i}<dd>d{i}" for i in range(6)) + "</dl>")
    assert regex(wrapper_of(tree)) == "<#page> <dl> ( <dt> # </dt> <dd> # </dd> )+ </dl> </#page>"


@pytest.mark.parametrize(
    "html",
    [
        "", "<", "<<<>>>", "plain", "<p", "</p></div>", "<div><p>a</div>b", "<!-- open", "<script>never closed", "<a href='x>q",
        "<p class=\"a>b</p>", "<![CDATA[x]]>y", "<textarea><p>t</textarea>z", "<br/><hr><img src=x>a<br>b", "<tr><td>1<td>2<tr><td>3",
        "<b><p>x</b></p>" * 200, "<div>" * 300 + "deep", "<article>&#x41;&eacute;&unknown;&#0;</article>",
    ],
)
def test_broken_pages_do_not_fail(html):
    assert isinstance(parse(html), Node)
    assert isinstance(text_of([html], html), list)


def test_pages_table(spark):
    rows = [(i, f"http://h{i % 2}.example.com/{i}", page(f"T{i}", [f"p{i}"] * (1 + i % 3)), 1) for i in range(12)]
    rows += [(50, None, None, 1), (51, "no host", "", 1), (None, "http://h0.example.com/", rows[0][2], 1), (0, *rows[0][1:])]
    rows += [(52, "http://long.example.com/", page("L", ["word " * 20_000] * 3), 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host int").withColumnRenamed("host", "wrapper")
    found = main_text(pages.repartition(4), pages_a_task=2).collect()
    assert len(found) == len(rows)
    texts = {r["page_id"]: r["text"] for r in found}
    for i in range(12):
        assert texts[i] == "\n".join([f"T{i}"] + [f"p{i}"] * (1 + i % 3))
    assert texts[50] == texts[51] == "" and texts[None] == texts[0]
    assert texts[52].count("\n") == 3 and len(texts[52]) > 290_000
    assert all(r["n_chars"] == len(r["text"]) for r in found)
    assert wrappers(pages).count() == 4
    assert main_text(pages.limit(0)).collect() == []


def test_pages_without_an_article_keep_their_text_beside_pages_with_one():
    pages = [page(f"T{i}", [f"a{i}", f"b{i}"], article=i % 2 == 0) for i in range(8)]
    assert text_of(pages, pages[0]) == ["T0", "a0", "b0"]
    assert text_of(pages, pages[1]) == ["a1", "b1"]
    alone = [page("T", ["x"]), "<p>one</p><p>two</p>"]
    assert text_of(alone, alone[1]) == ["one", "two"]


@pytest.mark.parametrize(
    "tags",
    [
        ["body class=no-sidebar", "article"], ["body class='search-results'", "div"], ["body", "main class=with-sidebar"],
        ["body", "article class='has-comments'"], ["form id=aspnet", "article"], ["form", "div"],
        ["div class='overflow-hidden'", "main"], ["div class=page-sidebar", "div"], ["main", "div class='social'"],
        ["body", "div data-id=sidebar data-role='menu'"],
    ],
)
def test_a_word_on_what_holds_the_article_does_not_lose_it(tags):
    def wrapped(i):
        body = f"<h1>T{i}</h1><p>text {i} of the article</p><p>and {i} more</p>"
        for tag in reversed(tags):
            body = f"<nav>n{i}</nav><{tag}>{body}<div class=ad>buy{i}</div><div class='comment'>long comment {i} by a reader, longer than the article itself, and more</div></{tag.split()[0]}>"
        return f"<html>{body}<footer>f</footer></html>"

    pages = [wrapped(i) for i in range(5)]
    assert text_of(pages, pages[3]) == ["T3", "text 3 of the article", "and 3 more"]
    assert text_of(pages[:1], pages[0]) == ["T0", "text 0 of the article", "and 0 more"]


def test_what_only_copies_of_one_page_hold_is_no_boilerplate():
    extra = "<pre>code</pre><table><tr><td>cell</table><blockquote>said</blockquote>"
    pages = [page(f"T{i}", [f"only {i}"], article=False) for i in range(40)]
    copy = page("T", ["only c"], article=False).replace("<form>", extra + "<form>")
    assert text_of(pages + [copy] * 3, copy) == ["only c", "code", "cell", "said"]
    assert text_of(pages + [copy] * 3, pages[5]) == ["only 5"]
    # The second template's own notice goes, as its other text differs.
    second = [f"<body><section><p>Terms apply</p><h2>h{i}</h2></section></body>" for i in range(25)]
    assert text_of(pages + second, second[4]) == ["h4"]


def test_pages_nested_ten_thousand_deep(spark):
    deep = "<article><p>start</p>" + "<div>" * 10_000 + "<p>deep</p><nav>menu <b>more</b><div>there</div></nav>tail" + "</div>" * 10_000 + "<p>after</p></article>"
    pages = [(1, "http://h/1", deep), (2, "http://h/2", "<div>" * 10_000 + "open"), (3, "http://h/3", "<article>plain</article>")]
    found = {r["page_id"]: r["text"] for r in main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert found == {1: "start\ndeep\ntail\nafter", 2: "open", 3: "plain"}


def test_functions_travel_without_the_package():
    """What tasks run is pickled whole, so that workers need no copy of this package."""
    import pickletools

    from pyspark import cloudpickle

    from clientele.llm import html_wrapper

    shipped = cloudpickle.dumps(html_wrapper._own_wrappers)
    loaded = {arg for op, arg, _ in pickletools.genops(shipped) if op.name in ("GLOBAL", "SHORT_BINUNICODE") and isinstance(arg, str)}
    assert "_kind" in loaded and "lru_cache" not in loaded


def test_pages_are_read_through_the_slots_of_the_wrapper():
    pages = [page(f"T{i}", [f"a{i}"], article=i % 2 == 0) for i in range(6)]
    tree = parse(pages[0])
    assert Reader(["#page", 0, False, False, 0, 0, None, []]).blocks(tree) == []
    # A wrapper of other pages reads what its own slots hold and nothing else.
    other = wrapper_of(parse("<html><body><article><h1>x</h1></article></body></html>"))
    assert Reader(other).blocks(tree) == ["T0"]


def test_the_host_decides_about_doubtful_elements_and_shared_text():
    def doubtful(i, words):
        return f"<body><p>By the paper</p><p>long text number {i} of this page</p><div class=related>{words}</div></body>"

    pages = [doubtful(i, f"see {i}") for i in range(9)]
    # One page with much in it does not make the element an article; shared text goes from two pages on.
    odd = doubtful(9, "other pages " * 4 + "9")
    assert text_of(pages + [odd], odd) == ["long text number 9 of this page"]
    assert text_of(pages[:2], pages[0]) == ["long text number 0 of this page"]
    # Where only a few pages have it, those pages tell how much it holds.
    rare = "<body><div class=promo><p>all the text there is on these pages</p></div></body>"
    assert text_of(pages + [rare], rare) == ["all the text there is on these pages"]


def test_hosts_of_any_size_are_read_alike(spark):
    rows = [(i, f"http://{'big' if i % 3 else f'h{i % 7}'}.example.com/{i}", page(f"T{i}", [f"p{i}"], article=i % 2 > 0)) for i in range(90)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    alike = [{tuple(r) for r in main_text(pages, pages_a_task=n).collect()} for n in (1, 7, 1000)]
    assert alike[0] == alike[1] == alike[2] and len(alike[0]) == 90


def test_given_pages_against_a_plain_reading(spark):
    """On these tables every page has one article element, so a few patterns tell its blocks."""
    from clientele.llm.queries import op5_html_wrapper

    sf_dir = "/root/testdata/sf0.01"
    expected = {}
    for row in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        (body,) = re.findall(r"<article>(.*)</article>", row["html"], re.S)
        body = re.sub(r"<!--.*?-->|<(script|style)\b.*?</\1>", "", body, flags=re.S)
        body = re.sub(r"<br\s*/?>", " ", body)
        runs = re.split(r"</?(?:h\d|p|div|ul|ol|li|blockquote|pre|section|table|tr|td|th|figure|figcaption)\b[^>]*>", body)
        plain = [" ".join(markup.unescape(re.sub(r"<[^>]*>", "", run)).split()) for run in runs]
        expected[row["page_id"]] = "\n".join(t for t in plain if t)
    found = {r["page_id"]: r["text"] for r in op5_html_wrapper(spark, sf_dir).collect()}
    assert found == expected
