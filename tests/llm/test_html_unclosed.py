"""Closing tags behind many unclosed elements."""

import pytest

from quire.llm import html_text

ARTICLE = "<article><h1>Title</h1><p>The article of this page says one thing and then another, at some length, so that it is one.</article>"


@pytest.mark.parametrize("depth", [3, 59, 60, 500])
def test_a_menu_ends_behind_unclosed_elements(depth):
    tree = html_text.grow(*html_text.labelled())
    page = f"<body><nav><a href=/>Home</a>{'<div><ul>' * depth}</nav>{ARTICLE}"
    assert html_text.main_text(page, tree).startswith("Title\nThe article of this page")
    after = f"<body><article>{'<div>' * depth}<p>text</article><p>later"
    assert [b[1][4] for b in html_text.blocks_of(after)] == [1, -1]


def test_stray_closing_tags_close_nothing():
    assert [b[1][4] for b in html_text.blocks_of("<article></nav></ul><div></section></div></div><p>text")] == [1]
