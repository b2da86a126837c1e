"""Hand-written pages: what is article text, and what only seems to be or seems not to be."""

import pytest

from quire.llm import html_text

TREE = html_text.grow(*html_text.labelled())
P1 = ("The river rises in the hills north of the town and runs for sixty miles before it meets the sea at a wide and shallow bay, "
      "where the fishing boats of the coast have found shelter from the winter storms for as long as anyone can remember.")
P2 = ("Its upper course was once lined with mills, of which three still stand, and the oldest of them grinds flour for the "
      "visitors who walk the path along the bank on summer afternoons, often with children and dogs, and sometimes with a map.")
P3 = "Nobody has counted the bridges."
NAV = "<nav><ul><li><a href=/>Home</a></li><li><a href=/news>News</a></li><li><a href=/about>About us</a></li></ul></nav>"
FOOT = "<footer><p>&copy; 2020 The Valley Post. All rights reserved.</p></footer>"
BODY = f"<h1>The river</h1><p>{P1}</p><p>{P2}</p><p>{P3}</p>"
TEXT = f"The river\n{P1}\n{P2}\n{P3}"
COMMENT = ("I walked the whole of that path last spring with my brother and can only say that the second mill is the finest one of them "
           "all, and the bread which they sell there on Sundays is worth the long way up the hill in any weather.")


def page(inner: str, before: str = NAV, after: str = FOOT) -> str:
    return f"<html><head><title>t</title></head><body>{before}{inner}{after}</body></html>"


ARTICLE = f"<article>{BODY}</article>"
PLAIN = f"<div>{BODY}</div>"
SAME = {
    "article tag": page(ARTICLE),
    "main tag": page(f"<main>{BODY}</main>"),
    "no telling tag": page(PLAIN),
    "no chrome at all": page(ARTICLE, "", ""),
    "telling class around the article": page(f"<article><div class='search-algorithms'>{BODY}</div></article>"),
    "telling class, no article tag": page(f"<div class='share-page'>{BODY}</div>"),
    "telling id around the article": page(f"<div id='menu-of-the-day'><article>{BODY}</article></div>"),
    "sponsored post": page(f"<article class='sponsored-post'>{BODY}</article>"),
    "page open for comments": page(f"<div class='post comments-open'>{BODY}</div>"),
    "has-sidebar wrapper": page(f"<div class='content has-sidebar'><article>{BODY}</article></div>"),
    "body class": f"<body class='has-cookie-notice'>{NAV}{ARTICLE}{FOOT}",
    "page in a form": page(f"<article>{BODY}</article>", f"<form id=f>{NAV}", f"{FOOT}</form>"),
    "title in an article header": page(f"<article><header><h1>The river</h1></header><p>{P1}</p><p>{P2}</p><p>{P3}</p></article>"),
    "title in a class header": page(f"<article><div class='entry-header'><h1>The river</h1></div><p>{P1}</p><p>{P2}</p><p>{P3}</p></article>"),
    "advert before": page(f"<div class='ad'>Buy the best boots in the valley for half the price today only.</div>{ARTICLE}"),
    "advert inside": page(f"<article><h1>The river</h1><p>{P1}</p><div class='ad'>Buy boots for half the price today.</div><p>{P2}</p><p>{P3}</p></article>"),
    "advert paragraph": page(f"<article><h1>The river</h1><p>{P1}</p><p class='advert'>Buy boots for half the price today.</p><p>{P2}</p><p>{P3}</p></article>"),
    "cookie notice": page(f"<div class='cookie-notice'>We use cookies. Accept them all?</div>{ARTICLE}"),
    "notice without a telling class": page(f"<div class='x1'>This website uses cookies to give you a better visit. <a href=/p>Privacy policy</a></div>{ARTICLE}"),
    "notice, neither class nor article tag": page(f"<div>We use cookies on this page, see our privacy policy. Accept all?</div>{PLAIN}"),
    "rights line, neither class nor article tag": page(f"{PLAIN}<div>Copyright 2020 The Valley Post. All rights reserved.</div>", NAV, ""),
    "newsletter line in the article": page(f"<article>{BODY}<p>Subscribe to our newsletter!</p></article>"),
    "aside": page(f"<article><h1>The river</h1><p>{P1}</p><aside><p>{COMMENT}</p></aside><p>{P2}</p><p>{P3}</p></article>"),
    "sidebar by class": page(f"{ARTICLE}<div class='sidebar'><h3>Weather</h3><p>Rain in the morning, dry later on.</p></div>"),
    "sidebar by role": page(f"{ARTICLE}<div role='complementary'><p>{COMMENT}</p></div>"),
    "hidden text": page(f"{ARTICLE}<div hidden><p>{COMMENT}</p></div><div style='display: none'>{COMMENT}</div>"),
    "related links": page(f"<article>{BODY}</article><div class='related'><ul><li><a href=/1>The lake and its island</a></li></ul></div>"),
    "share buttons": page(f"<article>{BODY}<div class='share-buttons'><a href=/s>Share</a> <a href=/t>Tweet</a></div></article>"),
    "breadcrumbs": page(f"<div class='breadcrumbs'><a href=/>Home</a> &gt; <a href=/v>Valley</a></div>{ARTICLE}"),
    "search form": page(f"<form><label>Search the site</label><input name=q><button>Go</button></form>{ARTICLE}"),
    "select, textarea, button": page(f"<article>{BODY}<select><option>One<option>Two</select><textarea>Type</textarea><button>Send</button></article>"),
    "script and style": page(f"<article>{BODY}<script>if (a < b) x = '<p>{P1}</p>'</script><style>p {{ }}</style></article>"),
    "comment body": page(f"{ARTICLE}<div class='comment-body'><p>{COMMENT}</p></div>"),
    "comment body in the article": page(f"<article>{BODY}<div class='comment-body'><p>{COMMENT}</p></div></article>"),
    "comment section": page(f"{ARTICLE}<section id='comments'><h2>Two comments</h2><p>{COMMENT}</p><p>{COMMENT}</p></section>"),
    "comments longer than the article": page(f"{ARTICLE}<ol class='comment-list'>{f'<li><p>{COMMENT}</p></li>' * 9}</ol>"),
    "comments as article tags": page(f"{ARTICLE}<ol class='comment-list'><li><article class='comment'><p>{COMMENT}</p></article></li></ol>"),
    "comments, no article tag": page(f"{PLAIN}<div class='comments'><p>{COMMENT}</p></div>"),
    "comment in a has-sidebar wrapper": page(f"<div class='has-sidebar'>{ARTICLE}<div class='comment-content'><p>{COMMENT}</p></div></div>"),
    "unclosed paragraphs": page(f"<article><h1>The river</h1><p>{P1}<p>{P2}<p>{P3}</article>"),
    "line breaks and white space": page(ARTICLE.replace("the hills", "the\n\t <br> hills")),
    "capital tags": page(ARTICLE.replace("<p>", "<P>").replace("</p>", "</P>").replace("article>", "ARTICLE>")),
}


@pytest.mark.parametrize("name", SAME)
def test_the_article_and_nothing_else(name):
    assert html_text.main_text(SAME[name], TREE) == TEXT


@pytest.mark.parametrize("inner, text", [
    ("<p>See <label>the label</label> now.</p>", "See the label now."),
    ("<p>Where <math><mi>x</mi> <mo>=</mo> <mn>2</mn></math> holds.</p>", "Where x = 2 holds."),
    ("<p>A drawing:</p><svg><title>icon</title><text>north bank</text></svg>", "A drawing:\nnorth bank"),
    ("<p>Ale &amp; bread &lt;here&gt; &#233;&#x41;</p>", "Ale & bread <here> éA"),
    ("<p>You can log in to the old terminal with a key.</p>", "You can log in to the old terminal with a key."),
    ("<ul><li>flour</li><li>water</li></ul>", "flour\nwater"),
    ("<table><tr><td>1801</td><td>three mills</td></tr></table>", "1801\nthree mills"),
    ("<h2>Mills</h2><p>None.</p>", "Mills\nNone."),
])
def test_inline_and_short_blocks_of_an_article(inner, text):
    assert html_text.main_text(page(f"<article><p>{P1}</p>{inner}<p>{P2}</p></article>"), TREE) == f"{P1}\n{text}\n{P2}"


@pytest.mark.parametrize("html, text", [
    ("<body><div><p>Short page.</p></div></body>", "Short page."),
    (page("<div><p>Short page.</p></div>"), "Short page."),
    (page("<h1>Title</h1><p>Only a few words.</p>"), "Title\nOnly a few words."),
    ("just text", "just text"),
    (page(""), ""),
    (NAV, ""),
    (FOOT, ""),
    ("", ""),
    (None, ""),
])
def test_short_and_empty_pages(html, text):
    assert html_text.main_text(html, TREE) == text


def test_a_name_counts_by_the_share_it_covers():
    found = dict(html_text.blocks_of(f"<div class='menu'><p>{P1}</p></div><div class='old-menu'><p>{P3}</p></div>"))
    named, share = html_text.FEATURES.index("named") - 4, html_text.FEATURES.index("share") - 4
    assert (found[P1][named], found[P3][named]) == (2, 1)
    assert found[P1][share] > 80 > 20 > found[P3][share] > 0


def test_empty_table_null_rows_repeats_and_clashing_columns(spark):
    pages = spark.createDataFrame([(1, "u", page(ARTICLE), "x", "y"), (1, "u", page(ARTICLE), "x", "y"), (None, None, None, "x", None)],
                                  "page_id long, url string, html string, text string, _html string")
    got = html_text.extract(pages).collect()
    assert sorted((r["page_id"] or 0, r["text"]) for r in got) == [(0, ""), (1, TEXT), (1, TEXT)]
    assert html_text.extract(pages.limit(0)).collect() == []
