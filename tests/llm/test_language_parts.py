"""Language identification reads the article blocks of whole pages, not their menus and footers."""

from quire.llm import langid


def test_page_parts_are_no_text_evidence(spark):
    docs = spark.createDataFrame([(i, "the cat and this thing " * 4 if i % 2 else "der hund und nicht schon " * 4, "en" if i % 2 else "de")
                                  for i in range(20)], "doc_id long, text string, lang string")
    body = "der hund und nicht schon"
    pages = spark.createDataFrame([(1, "http://a/", f"<nav>the cat and this thing the cat</nav><p>{body}</p><footer>this thing</footer>"),
                                   (2, "http://b/", f"<p>{body}</p>"), (3, "http://c/", None)], "page_id long, url string, html string")
    langs, model = langid.text_model(docs, 100)
    got = {r["page_id"]: r for r in langid.text_evidence(pages, langs, model, ["page_id"]).collect()}
    assert got[1]["n_grams"] == got[2]["n_grams"] == len(body) - 2 and got[3]["n_grams"] == 0
    assert got[1]["likely"] == got[2]["likely"]
    assert {r["page_id"]: r["lang"] for r in langid.identify(pages, docs).collect()}[1] == "de"
