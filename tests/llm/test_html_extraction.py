import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm import html_extraction as X

WEIGHTS = X.weights({})


def text_of(page):
    return X.main_text(page, WEIGHTS)[0]


@given(st.lists(st.integers(-5, 5), max_size=30))
@settings(max_examples=200, deadline=None)
def test_best_region_is_the_greatest_sum(scores):
    a, b = X.best_region([float(s) for s in scores])
    sums = [sum(scores[i:j]) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)]
    assert sum(scores[a:b]) == max([0, *sums])


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("<script>var a='<p>x</p>';", ""),
        ("plain words only", "plain words only"),
        ("<p>a &amp; b&lt;c&gt; &eacute;&#233;</p>", "a & b<c> éé"),
        ("<p>one\n two\t<b>three</b></p><p>four five</p>", "one two three\n\nfour five"),
        ("<p>open <b>bold<p>next para<!-- never closed <p>x", "open bold\n\nnext para"),
        ("<h1>Title here</h1><p>First line<br>second line</p>", "Title here\n\nFirst line second line"),
        ('<p>one < two and "quoted</p><p>fine</p>', 'one < two and "quoted\n\nfine'),
    ],
)
def test_texts(page, text):
    assert text_of(page) == text


BODY = "<h1>The title of it</h1><p>First paragraph with several words in it.</p>{}<p>Second paragraph, with just as many words.</p>"
TEXT = "The title of it\n\nFirst paragraph with several words in it.\n\nSecond paragraph, with just as many words."


@pytest.mark.parametrize(
    "noise",
    [
        "<div class='ad'>Buy now and save</div>", "<aside><p>Popular today: this and that</p></aside>",
        "<form><p>Sign up</p><input><button>Go</button></form>", "<div id=comments><p>I disagree with all of this, said a reader.</p></div>",
        "<div class='cookie-notice'>We use cookies</div>", "<nav><ul><li><a href=/a>A</a></li></ul></nav>", "<style>p{x:y}</style>",
        "<noscript>Turn scripts on</noscript>", "<div role=banner>Site name</div>", "<textarea>draft</textarea>",
    ],
)
def test_noise_is_left_out_wherever_it_stands(noise):
    assert text_of(f"<body>{noise}<article>{BODY.format('')}</article>{noise}</body>") == TEXT
    assert text_of(f"<body><div>{BODY.format(noise)}</div></body>") == TEXT


@pytest.mark.parametrize(
    ("part", "text"),
    [
        ("<h2 id='search'>How to search</h2>", "How to search"), ("<h2 id='related-work'>Related work</h2>", "Related work"), ("<h2 id=widget>Widgets</h2>", "Widgets"),
        ("<section id='menu-planning'><p>Plan your menu.</p></section>", "Plan your menu."), ("<p class='notice'>Notice the second step.</p>", "Notice the second step."),
        ("<div class='social-history'><p>A social history.</p></div>", "A social history."), ("<blockquote class='comment'>So it was said.</blockquote>", "So it was said."),
        ("<p>Choose <label>a label</label> and press <button>Go on</button>.</p>", "Choose a label and press Go on."),
        ("<p>Here <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds.</p>", "Here x=1 holds."),
        ("<h2>See also</h2><ul><li><a href=/a>First other page</a></li><li><a href=/b>Second other page</a></li></ul>", "See also\n\nFirst other page\n\nSecond other page"),
    ],
)
def test_what_belongs_to_the_article_stays(part, text):
    first, second = TEXT.rsplit("\n\n", 1)
    assert text_of(f"<body><nav><a href=/>Home</a></nav><article>{BODY.format(part)}</article><footer>foot</footer></body>") == f"{first}\n\n{text}\n\n{second}"
    assert text_of(f"<body><main><article>{BODY.format('')}{part}</article></main></body>") == f"{TEXT}\n\n{text}"


@pytest.mark.parametrize(
    "noise",
    [
        "<div class='ad-slot'>Buy now and save</div>", "<aside>Popular today</aside>", "<section class='comments'><p>I disagree, said a reader.</p></section>",
        "<ul class='share-buttons'><li><a href=/x>Share this</a></li></ul>", "<div class='cookie-notice'>We use cookies</div>", "<footer>Filed under things</footer>",
        "<form><label>Mail</label><button>Subscribe</button></form>", "<nav><a href=/1>Next page</a></nav>", "<div id='newsletter-signup'>Sign up for news</div>",
    ],
)
def test_noise_inside_the_article_is_left_out(noise):
    assert text_of(f"<body><article>{BODY.format(noise)}</article></body>") == TEXT


def test_weights_come_from_marked_pages(spark):
    page = "<nav><a href=x>menu words here</a></nav><article><h1>Head</h1><p>Body text of the page.</p></article><footer>foot</footer>"
    pages = spark.createDataFrame([(i, "u", page + str(i)) for i in range(5)] + [(9, "u", None)], "page_id bigint, url string, html string")
    fitted = X.fit_weights(pages)
    assert fitted["p"] > 0 > fitted["link"]
    assert all(w < 0 for kind, w in fitted.items() if kind[0] == "<")
    assert X.page_counts("<article>a</article><article>b</article>") == {}


def test_every_row_comes_back(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "<p>some words here</p>"), (3, "u", "<p>some words here</p>"), (None, "u", "<p>x y z</p>"),
            (5, "u", "<p>" + "long text " * 50_000 + "</p>"), (6, "u", "<" * 3000 + '<a "' * 3000)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "1 AS text", "2 AS n_chars")
    found = X.extract_pages(pages).collect()
    assert len(found) == len(rows)
    by_id = {r.page_id: r for r in found}
    assert by_id[1].text == by_id[2].text == "" and by_id[2].url is None
    assert by_id[3].text == "some words here" and by_id[3].n_chars == 15
    assert by_id[5].n_chars == 50_000 * 10 - 1
    empty = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert X.extract_pages(empty).collect() == []


def test_marked_pages_of_the_given_tables(spark):
    import html
    import re

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    pages_by_id = {r.page_id: r.html for r in pages.collect()}
    for row in X.extract_pages(pages).collect():
        inner = re.search(r"<article>(.*?)(?:</article>|<footer>|$)", pages_by_id[row.page_id], re.S)[1]
        parts = [re.sub(r"<(?!/?(?:h1|p)>)[^>]*>", " ", x) for x in re.split(r"</?(?:h1|p)>", inner)]
        parts = [" ".join(html.unescape(x).split()) for x in parts]
        assert row.text == "\n\n".join(x for x in parts if x)
        assert row.n_chars == len(row.text)


@pytest.mark.parametrize(
    "page",
    [
        "<html class='no-sidebar'><body class='right-sidebar'>{}<article>{}</article></body></html>", "<body><div id='content' class='has-sidebar'>{}<div>{}</div></div></body>",
        "<body>{}<article class='post comments-open'>{}</article></body>", "<body><div class='menu-open'><div class=share-on>{}<main class='search'>{}</main></div></div></body>",
        "<body>{}<article class='post comments-open'>{}</article><div id=comments><p>" + "Many words said by a reader. " * 40 + "</p></div></body>",
    ],
)
def test_hints_on_the_frame_of_a_page_do_not_empty_it(page):
    noise = "<div class='ad'>Buy now and save</div><nav><ul><li><a href=/a>A</a></li></ul></nav>"
    assert text_of(page.format(noise, BODY.format("<div class='ad'>Buy</div>"))) == TEXT


def test_hints_that_would_leave_no_words():
    post = "<div class='post comments-open'><p>Some words of the {} post.</p></div>"
    assert text_of("".join(post.format(x) for x in ("first", "second"))) == "Some words of the first post.\n\nSome words of the second post."
