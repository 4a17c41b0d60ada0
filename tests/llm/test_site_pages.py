"""Pages as sites write them: harmless marks beside the article, and hosts with copies of one page."""

import random

import pytest

from tessera.llm.site_style import extract_text, main_text

BODY = "<p>A story of some length, told in one paragraph.</p><p>And its end.</p>"
TEXT = "A story of some length, told in one paragraph.\nAnd its end."


@pytest.mark.parametrize("mark", ['class="overflow-hidden"', 'style="overflow:hidden"', 'class="lg:hidden"', 'data-hidden-count="3"', 'data-x="display:none"', 'class="content has-sidebar"', 'class="no-sidebar"', 'class="search-page"', 'id="site-menu-open"', 'aria-hidden="false"', 'class="page sidebar"', "hidden"])
def test_marks_that_say_nothing_of_the_article(mark):
    assert main_text(f"<body><div {mark}>{BODY}</div></body>") == TEXT
    assert main_text(f"<body {mark}><nav>Menu</nav>{BODY}</body>") == TEXT
    assert main_text(f"<body><div {mark}><article {mark.replace('hidden', 'x') if mark == 'hidden' else mark}>{BODY}</article></div></body>") == TEXT


def test_links_to_hidden_places_stay():
    assert main_text('<body><p>see <a href="/hidden/x">this</a> and more of it</p></body>') == "see this and more of it"


def test_a_form_around_the_page():
    assert main_text(f'<body><form id="aspnetForm"><nav>Menu</nav>{BODY}<div class="comments">Great!</div></form></body>') == TEXT
    assert main_text(f'<body><form><nav>Menu</nav><article>{BODY}</article></form></body>') == TEXT


@pytest.mark.parametrize("mark", ['class="sidebar"', 'class="x ad y"', 'id="comments"', "hidden", 'aria-hidden="true"', 'style="color:red; display : none"', 'style="display:none !important"', 'role="search"', 'class=ad', "HIDDEN"])
def test_marks_that_drop(mark):
    assert main_text(f"<body><div {mark}>other</div>{BODY}</body>") == TEXT


@pytest.mark.parametrize("mark", ["comment-list", "user-comments", "comments-area", "commentList", "comments_thread", "ad-slot", "ad_300x250", "adSlot", "cookie-banner", "newsletter-signup", "site-footer", "siteFooter", "share-buttons"])
def test_parts_of_words_that_drop(mark):
    page = f'<body><div class="x {mark}">other words</div>{BODY}</body>'
    assert main_text(page) == TEXT and main_text(page.replace("class=", "id=")) == TEXT
    assert main_text(f'<body><article><div class="{mark}">other words</div>{BODY}</article></body>') == TEXT


@pytest.mark.parametrize("mark", ["no-comments", "has-sidebar", "with_footer", "notice-of-appeal", "social-history", "search-results", "adventure", "download-list", "commentary", "headers", "toggle-menu"])
def test_parts_of_words_that_say_nothing(mark):
    assert main_text(f'<body><div class="{mark}">other words</div>{BODY}</body>') == f"other words\n{TEXT}"


def test_beside_an_article_no_teasers_or_long_comments():
    assert main_text(f'<article>{BODY}</article><aside><article>teaser</article></aside><div class="comments">{"Great! " * 100}</div>') == TEXT


@pytest.mark.parametrize("copies", [40, 300])
def test_copies_of_a_page_are_no_template(spark, copies):
    rng = random.Random(8)
    page = lambda i, t: f"<body><div class=x1><p>Same on all pages</p></div><div class=x2><p>{t}</p></div></body>"
    story = lambda: " ".join(f"w{rng.randrange(900)}" for _ in range(20))
    few, several = [story() for _ in range(3)], [story() for _ in range(12)]
    rows = [("few", t) for t in few] + [("several", t) for t in several] + [(h, "not found") for h in ("few", "several") for _ in range(copies)]
    df = spark.createDataFrame([(i, f"http://{h}.example/{i}", page(i, t)) for i, (h, t) in enumerate(rows)], "page_id long, url string, html string").repartition(3)
    got = {r["page_id"]: r["text"] for r in extract_text(df).collect()}
    assert [got[i] for i in range(len(rows))] == [t if h == "several" else f"Same on all pages\n{t}" for h, t in rows]
