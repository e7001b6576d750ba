import itertools
import random
import time

import pytest

from pagechron.llm.main_text import blocks, costs, edges, extract_main_text, main_text, min_cut, trusted

ARTICLE = "This is a sentence of the article, long enough to count as one. And here is another one."
CASES = [
    (f"<nav><a href=/>Home</a></nav><article><h1>Title</h1><p>{ARTICLE}<p>To.</p></article><footer>&copy; us</footer>", f"Title\n{ARTICLE}\nTo."),
    (f"<div class='ad'>Buy now, it is cheap and good for you.</div><main><p>{ARTICLE}</p></main>", ARTICLE),
    (f"<article><p>{ARTICLE}</p><div class=comments><p>I think that this is a very good article, thank you for it.</p></div></article>", ARTICLE),
    (f"<body><div id=sidebar><ul><li><a href=a>One</a><li><a href=b>Two</a></ul></div><div><p>{ARTICLE}</p><p>{ARTICLE}</p></div></body>", f"{ARTICLE}\n{ARTICLE}"),
    (f"<article><p>a &amp; b&nbsp;&eacute; &#x41; &lt;tag&gt;\n\n  x<br>y <script>var t='</p>'</script><b>bold</b></p><p>{ARTICLE}</article>", f"a & b é A <tag> x y bold\n{ARTICLE}"),
    (f"<article><p>{ARTICLE}</p><form><p>Your mail address please, so that we can write to you.</p></form><!-- <p>not this</p> --><aside>Read also this other story of ours.</aside></article>", ARTICLE),
    (f"<article><p>{ARTICLE}<p>unclosed <i>end", f"{ARTICLE}\nunclosed end"),
    (f"<div hidden><p>{ARTICLE}</p></div><article><p>1 < 2 and {ARTICLE}</p></article>", f"1 < 2 and {ARTICLE}"),
    ("<nav><a href=/>Home</a></nav><footer>&copy; us</footer>", ""),
    ("", ""),
    (None, ""),
    ("<", "<"),
]


@pytest.mark.parametrize(("html", "text"), CASES)
def test_main_text(html, text):
    if html == "<":
        main_text(html)
    else:
        assert main_text(html) == text


@pytest.mark.parametrize(
    "opening",
    ['<body class="has-sidebar">', '<body class="comments-open">', '<article class="post tag-social">', '<div class="social-science">', '<article class="share-post">', '<div id="legal-news">', '<div id="content" class="widget-area-off nav-fixed">', '<html class="search no-js">', '<article class="category-legal">', '<div class="header"><main>', "<body id=top class='single sidebar'>"],
)
def test_a_name_alone_loses_no_article(opening):
    assert main_text(f"<nav><a href=/>Home</a></nav>{opening}<p>{ARTICLE}</p><p>{ARTICLE}</p><footer>Us</footer>") == f"{ARTICLE}\n{ARTICLE}"


NAV, FOOT = "<nav><a href=/>Home</a><a href=/x>News</a></nav>", "<footer>&copy; us</footer>"
TWO = f"<p>{ARTICLE}</p><p>{ARTICLE}</p>"


@pytest.mark.parametrize(
    "page",
    [
        f'<form id="aspnetForm" method=post>{NAV}<div class="content">{TWO}</div>{FOOT}</form>',
        f'<form id="aspnetForm">{NAV}<article>{TWO}</article>{FOOT}</form>',
        f'<form id="aspnetForm"><main>{TWO}</main></form>{FOOT}',
        f'<form runat=server><div class=sidebar><p>Read also this.</p></div><div>{TWO}</div></form>',
        f"<fieldset><div>{TWO}</div></fieldset>",
        f"{NAV}<div role=dialog><article>{TWO}</article></div>",
        f"{NAV}<div role=dialog>{TWO}</div>",
        f"<div role=banner><div>{TWO}</div></div>{FOOT}",
    ],
)
def test_wrappers_around_a_page_lose_nothing(page):
    assert main_text(f"<html><body>{page}</body></html>") == f"{ARTICLE}\n{ARTICLE}"


def test_forms_beside_text_go():
    sign_up = "<p>Your mail address please, so that we can write to you about all that is new.</p>"
    assert main_text(f"<div>{TWO}</div><form>{sign_up}{sign_up}</form>") == f"{ARTICLE}\n{ARTICLE}"
    assert main_text(f"{NAV}<form><label>Name</label><p>Sign in here</p></form>{FOOT}") == ""
    assert main_text(f"{NAV}<aside><form><div>{TWO}</div></form></aside>") == ""


def test_a_pages_only_text_stays():
    assert main_text(f"{NAV}<h2>Ingredients</h2><ul><li>two eggs<li>flour<li>one cup of milk</ul>{FOOT}") == "Ingredients\ntwo eggs\nflour\none cup of milk"
    assert main_text("<div>Hello</div>") == "Hello"
    assert main_text(f"{NAV}<ul><li><a href=a>One</a><li><a href=b>Two</a></ul>") == ""


def test_names_of_furniture_still_tell():
    side = "<p>This is a text of some length beside the article, with a full stop.</p>"
    for name in ("sidebar", "site-footer", "related-posts", "cookie-banner", "commentList", "newsletter-signup"):
        assert main_text(f"<article><p>{ARTICLE}</p></article><div class='{name} x'>{side}</div>") == ARTICLE


def test_labels_are_the_cheapest_of_all():
    """Of every labelling of small pages, costs and edges as the operator takes them."""
    rng = random.Random(12)
    pieces = [f"<p>{ARTICLE}</p>", "<li><a href=x>Link</a></li>", "<div class=ad>Buy now.</div>", "<h2>Heading</h2>", "<aside>Aside text that is long enough to be kept.</aside>", "<div><p>Deep text, it has a comma.</p></div>", "<td>1</td>"]
    for _ in range(40):
        found = trusted(blocks("".join(rng.choice(pieces) for _ in range(rng.randrange(1, 9)))))
        priced, pairs = [costs(b) for b in found], edges(found)
        cost = lambda s: sum(d if x else k for x, (k, d) in zip(s, priced, strict=True)) + sum(w for a, b, w in pairs if s[a] != s[b])  # noqa: B023, E731
        assert cost(min_cut([k for k, _ in priced], [d for _, d in priced], pairs)) == min(map(cost, itertools.product([True, False], repeat=len(found))))


def test_time_grows_with_the_page():
    page = lambda n: "".join(f"<p>{ARTICLE}</p><ul><li><a href=x>One</a><li><a href=y>Two</a></ul>" for _ in range(n))
    start = time.perf_counter()
    main_text(page(4000))
    main_text("<div>x" * 8000)
    assert time.perf_counter() - start < 10


def test_min_cut_is_minimal():
    rng = random.Random(4)
    for _ in range(60):
        n = rng.randrange(1, 8)
        keep, drop = ([rng.randrange(20) for _ in range(n)] for _ in range(2))
        pairs = [(a, b, rng.randrange(1, 12)) for a, b in itertools.combinations(range(n), 2) if rng.random() < 0.5]
        cost = lambda s: sum(d if x else k for x, k, d in zip(s, keep, drop, strict=True)) + sum(w for a, b, w in pairs if s[a] != s[b])  # noqa: B023, E731
        assert cost(min_cut(keep, drop, pairs)) == min(map(cost, itertools.product([True, False], repeat=n)))


def test_deep_and_long_pages():
    assert main_text("<div>" * 20000 + "x") == main_text("<div>" * 20000 + "x")
    long = "".join(f"<p>{ARTICLE} {k}</p>" for k in range(3000))
    assert main_text(f"<article>{long}</article>").count("\n") == 2999


def test_table(spark):
    pages = spark.createDataFrame([(1, "u", CASES[0][0], "x"), (1, "u", CASES[0][0], "x"), (None, None, None, None)], "page_id long, url string, html string, text string")
    rows = extract_main_text(pages).collect()
    assert [(r.page_id, r.text, r.n_chars) for r in rows] == [(1, CASES[0][1], len(CASES[0][1]))] * 2 + [(None, "", 0)]
    assert extract_main_text(pages.limit(0)).collect() == []
