"""The declared language stands wherever the html tag does."""

from quire.llm import langid


def test_declared_language_behind_a_long_prolog(spark):
    pages = {
        "fr": "<!--" + "licence " * 1000 + "--><html class=x lang='FR-ca'><p>t",
        "de": " " * 5000 + "<HTML data-x='a<b'\n" + "data-y='1' " * 400 + "lang = de>",
        "en": "<!--[if IE]><html class=ie><![endif]--><html lang=\"en\"><html lang=es>",
        "it": "<html <html lang='' lang=it>",
        "": "<html><p lang=en>" + "<html " * 20_000,
    }
    df = spark.createDataFrame(list(pages.items()) + [("", None), ("", "")], "want string, html string")
    rows = df.select("want", langid.declared_language(df.html).alias("got")).collect()
    assert len(rows) == 7 and all(r["got"] == r["want"] for r in rows)
