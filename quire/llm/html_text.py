"""Main text of web pages: flat text blocks judged by a decision tree.

A page becomes a list of text blocks, split at block-level tags.  A block is described by its
word count and link density, those of the block before and after it, whether it is a heading,
whether it lies in an article or a page part by tag or role, how much the class and id names around
it speak of a notice, advert, menu or readers' comments and what share of the page they cover, and
how many stock phrases it holds.  A decision tree, grown from the small table ``LABELLED`` below,
weighs these and says which blocks are article text; those are joined in page order.  No name or
phrase decides alone: an article in an element named ``search-algorithms`` stays.

Defined cases: null or empty html gives the empty text, as does a page without article blocks;
unclosed, stray and cut-off tags are tolerated; a tag cut off by the end of the page is no text;
repeated rows give repeated rows; other columns are kept out unless named in ``keep``.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SKIPPED = "script|style|noscript|template|iframe|object|canvas|head|title"
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({_SKIPPED})\b[^>]*+>.*?(?:</\1\s*+>|(?=<body\b)|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:\"[^\"]*+\"|'[^']*+'|[^\"'>])*+)>"
    r"|<[a-zA-Z/!?][^>]*+(?:>|\Z)|([^<]++|<)", re.S | re.I)
_SECTION = frozenset("article main section div nav aside footer header form fieldset ul ol dl table figure button select "
                     "textarea dialog details menu address blockquote center body".split())
_BLOCK = _SECTION | frozenset("p h1 h2 h3 h4 h5 h6 li dt dd tr td th thead tbody tfoot caption figcaption pre hr html option "
                              "summary legend optgroup".split())
_HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
_PART = frozenset("nav aside footer fieldset button select textarea dialog menu".split())
_ROLE = re.compile(r"navigation|banner|contentinfo|complementary|search|dialog|alert|menu|form|toolbar")
_ATTR = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
# words of class and id names and stock phrases: evidence beside other evidence, for the tree to weigh
_WORDS = re.compile(r"[a-z]+")
_NOISE = re.compile(
    r"(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notices?|popup|modal|overlay|newsletter|subscri\w+"
    r"|signup|share|sharing|social|related|recommend\w*|sidebar|widgets?|menu|nav|navbar|navigation|breadcrumbs?|footer|header"
    r"|masthead|topbar|discussion|login|search|pagination|pager|toolbar|copyright|disclaimer|skip|toc)\Z")
_TALK = re.compile(r"(?:comments?|commentlist|disqus|repl(?:y|ies)|respond)\Z")
_PHRASES = ("cookie", "newsletter", "subscribe", "sign up", "log in", "login", "all rights reserved", "copyright", "©", "advertis",
            "sponsored", "privacy policy", "terms of use", "terms of service", "share this", "follow us", "read more",
            "click here", "leave a reply", "leave a comment", "powered by", "accept all", "enable javascript")

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "heading", "part", "place", "named",
            "talk", "share", "alone", "phrases")
#: the labelled table, one block a line: the features in their order, then 1 for article text
LABELLED = """
1 1.00 0 0.00 1 1.00 0 1 -1 0 0 0 0 0 0
2 1.00 1 1.00 1 1.00 0 1 -1 0 0 0 0 0 0
1 1.00 1 1.00 12 0.00 0 1 -1 0 0 0 0 0 0
9 0.00 1 1.00 10 0.00 0 1 -1 0 0 0 0 0 0
14 0.00 2 1.00 80 0.00 0 1 0 0 0 0 0 0 0
35 0.00 60 0.00 20 0.00 0 1 0 0 0 0 0 0 0
60 0.05 20 0.00 0 0.00 0 1 0 0 0 0 1 0 0
25 0.10 40 0.00 30 0.00 0 1 1 0 0 0 0 0 0
3 0.00 50 0.00 20 0.00 1 1 1 0 0 0 0 0 0
40 0.00 3 0.00 12 0.00 0 1 1 0 0 0 1 0 0
6 0.20 90 0.00 0 0.00 0 1 0 0 0 0 0 0 0
120 0.00 10 0.00 14 0.00 0 1 0 0 0 0 1 0 0
9 0.00 12 0.00 10 0.00 1 0 1 0 0 0 0 0 1
12 0.00 8 0.00 60 0.00 0 0 1 0 0 0 0 0 1
80 0.00 10 0.00 40 0.02 0 0 1 0 0 0 1 0 1
2 0.00 40 0.00 55 0.00 0 0 1 0 0 0 0 0 1
1 0.00 2 0.00 9 0.00 0 0 1 0 0 0 0 0 1
55 0.10 30 0.00 6 0.20 0 0 1 0 0 0 0 0 1
20 0.45 60 0.00 70 0.00 0 0 1 0 0 0 0 0 1
7 1.00 60 0.00 70 0.00 0 0 1 0 0 0 0 0 1
300 0.01 1 1.00 6 0.00 0 0 1 0 0 0 1 0 1
4 0.00 0 0.00 0 0.00 0 0 1 0 0 0 1 0 1
5 0.00 7 0.00 9 0.00 0 0 1 0 0 0 0 0 1
1 1.00 1 1.00 1 1.00 0 0 1 0 0 0 0 0 0
3 1.00 4 1.00 3 1.00 0 0 1 0 0 0 0 0 0
2 1.00 30 0.00 2 1.00 0 0 1 0 0 0 0 0 0
1 1.00 0 0.00 1 1.00 0 0 -1 0 0 0 0 0 0
2 1.00 2 1.00 2 1.00 0 0 -1 0 0 0 0 0 0
4 0.90 3 1.00 5 0.80 0 0 -1 0 0 0 0 0 0
3 1.00 4 1.00 45 0.00 0 0 0 0 0 0 0 0 0
6 0.60 50 0.00 4 1.00 0 0 0 0 0 0 0 0 0
18 0.70 20 0.60 16 0.75 0 0 0 0 0 0 0 0 0
30 0.55 12 0.90 25 0.60 0 0 0 0 0 0 0 0 0
3 0.00 2 1.00 4 0.90 0 0 -1 0 0 0 0 0 0
5 0.00 3 1.00 3 1.00 1 0 -1 0 0 0 0 0 0
4 0.00 0 0.00 2 1.00 0 0 -1 0 0 0 0 0 0
6 0.00 4 0.00 0 0.00 0 0 -1 0 0 0 0 0 0
8 0.00 5 0.50 3 0.00 0 0 -1 0 0 0 0 0 0
2 0.00 3 0.00 4 0.00 0 0 -1 0 0 0 0 0 0
7 0.10 2 0.00 6 1.00 0 0 -1 0 0 0 0 0 0
5 0.00 60 0.00 0 0.00 0 0 0 0 0 0 0 0 0
9 0.00 70 0.02 3 1.00 0 0 0 0 0 0 0 0 0
8 0.00 2 1.00 60 0.00 1 0 0 0 0 0 0 0 1
6 0.00 45 0.00 50 0.00 1 0 0 0 0 0 0 0 1
5 0.00 4 0.00 80 0.00 1 0 0 0 0 0 0 0 1
45 0.00 8 0.00 60 0.00 0 0 0 0 0 0 0 0 1
60 0.05 45 0.00 50 0.00 0 0 0 0 0 0 0 0 1
90 0.12 70 0.00 40 0.00 0 0 0 0 0 0 0 0 1
25 0.00 60 0.00 35 0.10 0 0 0 0 0 0 0 0 1
32 0.00 9 0.00 8 0.00 0 0 0 0 0 0 1 0 1
150 0.02 1 1.00 7 0.00 0 0 0 0 0 0 1 0 1
20 0.00 3 1.00 40 0.00 0 0 0 0 0 0 0 0 1
18 0.00 50 0.00 4 0.30 0 0 0 0 0 0 0 0 1
7 0.00 55 0.00 48 0.00 0 0 0 0 0 0 0 0 1
3 0.00 40 0.00 60 0.00 0 0 0 0 0 0 0 0 1
12 0.20 35 0.00 28 0.05 0 0 0 0 0 0 0 0 1
40 0.30 50 0.10 60 0.05 0 0 0 0 0 0 0 0 1
28 0.00 25 0.00 5 0.80 0 0 0 0 0 0 0 0 1
40 0.00 50 0.00 3 1.00 0 0 1 0 0 0 0 0 1
15 0.00 20 0.00 2 1.00 0 0 1 0 0 0 0 0 1
2 0.00 10 0.00 2 1.00 0 0 1 0 0 0 0 0 1
1 0.00 1 0.00 1 1.00 0 0 1 0 0 0 1 0 1
6 0.10 30 0.00 5 0.90 0 0 1 0 0 0 0 0 1
60 0.00 45 0.00 2 1.00 0 0 0 0 0 0 0 0 1
35 0.00 2 1.00 1 1.00 0 0 0 0 0 0 1 0 1
22 0.05 40 0.00 3 1.00 0 0 0 0 0 0 0 0 1
8 0.90 40 0.00 50 0.00 0 0 1 0 0 0 0 0 1
4 1.00 9 0.00 30 0.10 0 0 1 0 0 0 0 0 1
2 0.00 1 1.00 3 1.00 0 0 -1 0 0 0 0 0 0
4 0.10 60 0.00 2 1.00 0 0 0 0 0 0 0 0 0
13 0.00 1 1.00 9 0.00 0 0 -1 2 0 3 0 0 0
20 0.00 1 1.00 30 0.00 0 0 -1 2 0 60 0 0 0
30 0.00 1 1.00 4 0.00 0 0 -1 2 0 80 0 0 0
12 0.10 50 0.00 20 0.00 0 0 -1 1 0 4 0 1 0
45 0.00 60 0.00 10 0.00 0 0 -1 2 0 15 0 0 0
70 0.00 60 0.00 10 0.00 0 0 -1 2 0 25 0 0 0
10 0.00 40 0.00 50 0.00 0 0 1 2 0 4 0 0 0
25 0.00 40 0.00 50 0.00 0 0 1 2 0 8 0 0 0
38 0.00 40 0.00 50 0.00 0 0 1 2 0 12 0 0 0
3 0.00 60 0.00 40 0.00 0 0 1 1 0 1 0 0 0
6 0.80 60 0.00 7 0.90 0 0 1 1 0 3 0 0 0
14 0.10 60 0.00 7 0.90 0 0 1 1 0 4 0 1 0
5 0.00 60 0.00 12 0.00 1 0 1 2 0 3 0 0 0
30 0.60 60 0.00 12 0.60 0 0 1 1 0 18 0 0 0
18 0.00 4 0.50 40 0.00 0 0 0 2 0 10 0 0 0
35 0.00 4 0.50 40 0.00 0 0 0 2 0 14 0 1 0
8 0.00 80 0.00 3 0.00 0 0 0 1 0 5 0 1 0
4 0.00 2 0.00 3 1.00 0 0 0 2 0 55 0 0 0
6 0.00 0 0.00 3 1.00 0 0 0 2 0 70 0 0 0
60 0.00 6 0.00 50 0.02 0 0 1 1 0 95 1 0 1
35 0.00 6 0.00 50 0.02 0 0 1 1 0 80 1 0 1
12 0.00 40 0.00 50 0.02 0 0 1 1 0 85 0 0 1
8 0.00 30 0.00 50 0.02 1 0 1 1 0 75 0 0 1
90 0.05 30 0.00 50 0.00 0 0 1 2 0 90 1 0 1
55 0.00 30 0.00 40 0.00 0 0 1 1 0 40 0 0 1
60 0.00 30 0.00 40 0.00 0 0 1 2 0 32 0 0 1
6 0.00 2 1.00 60 0.00 1 0 1 1 0 4 0 0 1
80 0.02 4 0.00 60 0.00 0 0 0 1 0 85 1 0 1
45 0.02 40 0.00 60 0.00 0 0 0 2 0 90 1 0 1
60 0.02 40 0.00 30 0.00 0 0 0 2 0 75 1 0 1
14 0.00 60 0.00 50 0.00 0 0 0 1 0 80 0 0 1
7 0.00 3 1.00 50 0.00 1 0 0 1 0 85 0 0 1
12 0.00 60 0.00 20 0.00 0 0 1 0 1 20 0 0 0
70 0.00 60 0.00 80 0.00 0 0 1 0 1 50 0 0 0
120 0.00 3 0.00 2 1.00 0 0 1 0 2 80 0 0 0
40 0.00 3 0.00 2 1.00 0 0 -1 0 2 40 0 0 0
90 0.00 2 0.00 30 0.00 0 0 -1 0 1 90 0 0 0
50 0.00 2 0.00 60 0.00 0 0 0 0 2 70 0 0 0
15 0.00 50 0.00 60 0.00 0 0 0 0 1 30 0 0 0
8 0.00 70 0.00 25 0.00 1 0 0 0 2 30 0 0 0
2 0.00 70 0.00 25 0.00 0 0 1 1 1 10 0 0 0
14 0.00 2 1.00 8 0.00 0 0 -1 0 0 0 0 1 0
25 0.05 1 1.00 6 0.00 0 0 -1 0 0 0 0 1 0
30 0.00 80 0.00 3 0.50 0 0 -1 0 0 0 0 0 0
45 0.00 80 0.00 3 0.50 0 0 -1 0 0 0 1 2 0
20 0.00 5 0.00 0 0.00 0 0 -1 0 0 0 1 0 0
5 0.00 80 0.00 30 0.00 1 0 -1 0 0 0 0 0 0
80 0.00 12 0.00 90 0.00 0 0 -1 0 0 0 1 0 1
110 0.00 90 0.00 70 0.00 0 0 -1 0 0 0 1 0 1
16 0.00 1 1.00 6 0.00 0 0 0 0 0 0 0 1 0
24 0.05 4 0.50 70 0.00 0 0 0 0 0 0 0 2 0
32 0.05 90 0.00 2 1.00 0 0 0 0 0 0 0 2 0
9 0.00 90 0.00 0 0.00 0 0 0 0 0 0 0 2 0
8 0.00 60 0.00 40 0.00 0 0 0 0 0 0 0 2 0
9 0.00 60 0.00 40 0.00 0 0 1 0 0 0 0 2 0
15 0.10 60 0.00 40 0.00 0 0 1 0 0 0 0 3 0
28 0.00 60 0.00 40 0.00 0 0 1 0 0 0 0 1 1
12 0.00 30 0.00 40 0.00 0 0 1 0 0 0 0 1 1
70 0.00 60 0.00 40 0.00 0 0 1 0 0 0 1 2 1
60 0.02 60 0.00 40 0.00 0 0 0 0 0 0 1 2 1
50 0.00 40 0.00 60 0.00 0 0 0 0 0 0 1 1 1
2 0.00 0 0.00 0 0.00 0 0 0 0 0 0 1 0 1
5 0.00 1 1.00 4 0.00 0 0 0 0 0 0 1 0 1
6 0.00 0 0.00 9 0.00 1 0 0 0 0 0 1 0 1
9 0.00 6 0.00 0 0.00 0 0 0 0 0 0 1 0 1
8 0.00 9 0.00 7 0.00 0 0 0 0 0 0 1 0 1
2 0.00 0 0.00 8 0.00 1 0 0 0 0 0 0 0 1
1 0.00 0 0.00 12 0.00 1 0 0 0 0 0 0 0 1
7 0.00 0 0.00 0 0.00 0 0 0 0 0 0 1 2 0
3 0.00 300 0.00 200 0.00 0 0 1 0 0 0 0 0 1
10 0.00 20 0.00 10 0.00 0 0 1 0 0 0 0 0 1
24 0.20 15 0.10 8 0.00 0 0 1 0 0 0 0 0 1
2 0.00 2 0.00 2 0.00 0 0 1 0 0 0 0 0 1
1 0.00 120 0.00 9 0.00 0 0 1 0 0 0 0 0 1
6 0.00 13 0.00 250 0.00 1 0 1 0 0 0 0 0 1
9 0.00 13 0.00 2 0.00 1 0 1 0 0 0 1 0 1
12 0.00 40 0.00 9 0.00 0 0 1 0 0 0 1 0 1
50 0.00 4 0.00 3 0.00 0 0 1 0 0 0 0 1 1
13 0.00 2 1.00 8 0.00 0 0 -1 2 0 10 1 0 0
26 0.00 3 1.00 30 0.00 0 0 -1 1 0 20 0 0 0
10 0.00 30 0.00 30 0.00 0 0 -1 2 0 2 0 0 0
16 0.00 25 0.00 60 0.00 0 0 1 1 0 3 0 0 0
22 0.00 25 0.00 25 0.00 0 0 1 2 0 30 1 0 0
9 0.00 30 0.00 30 0.00 0 0 0 2 0 4 0 0 0
15 0.00 20 0.00 2 1.00 0 0 -1 0 0 0 1 0 0
12 0.00 0 0.00 40 0.00 0 0 -1 0 0 0 0 0 0
28 0.00 30 0.00 40 0.00 0 0 -1 0 0 0 0 0 0
40 0.00 30 0.00 40 0.00 0 0 1 0 1 60 0 0 0
20 0.00 30 0.00 40 0.00 0 0 0 0 2 60 0 0 0
20 0.00 30 0.00 40 0.00 0 1 1 0 0 0 0 0 0
9 0.00 30 0.00 40 0.00 0 1 1 0 0 0 0 0 0
3 0.00 300 0.00 2 0.00 0 0 1 0 0 0 0 0 1
7 0.00 90 0.00 0 0.00 0 0 1 0 0 0 0 0 1
2 0.00 150 0.00 5 0.00 0 0 1 0 0 0 0 0 1
14 0.00 70 0.00 20 0.00 0 0 1 0 0 0 0 0 1
5 0.00 1 1.00 3 0.00 0 0 1 0 0 0 0 0 1
8 0.00 1 1.00 70 0.00 0 0 1 0 0 0 0 1 1
30 0.00 2 0.00 3 1.00 0 0 1 0 0 0 1 1 1
6 1.00 50 0.00 20 0.00 0 0 1 0 0 0 0 0 1
5 0.80 35 0.00 15 0.00 0 0 1 0 0 0 0 0 1
20 0.60 10 0.00 20 0.00 0 0 1 0 0 0 0 0 1
11 0.00 2 1.00 300 0.00 0 0 -1 0 0 0 0 0 0
8 0.00 2 1.00 90 0.00 0 0 -1 0 0 0 0 0 0
17 0.00 0 0.00 60 0.00 0 0 -1 2 0 5 0 0 0
13 0.00 1 1.00 120 0.00 0 0 -1 2 0 9 1 0 0
24 0.00 40 0.00 70 0.00 0 0 -1 0 0 0 0 1 0
2 1.00 2 1.00 80 0.00 0 0 -1 0 0 0 0 0 0
35 0.00 60 0.00 90 0.00 0 0 -1 0 2 40 0 0 0
90 0.00 9 0.00 8 0.00 0 0 -1 0 0 0 1 0 1
75 0.00 20 0.00 20 0.00 0 0 -1 0 0 0 0 0 1
120 0.00 40 0.00 2 1.00 0 0 -1 0 0 0 0 0 1
70 0.00 9 0.00 8 0.00 0 0 -1 2 0 30 0 0 0
110 0.00 9 0.00 80 0.00 0 0 -1 0 2 70 0 0 0
200 0.00 9 0.00 80 0.00 0 0 1 0 2 95 0 0 0
60 0.00 50 0.00 55 0.00 0 0 1 0 1 40 0 0 0
56 0.00 50 0.00 80 0.00 0 0 1 0 1 70 0 0 0
20 0.00 40 0.00 60 0.00 0 0 1 0 1 90 0 0 0
30 0.00 40 0.00 60 0.00 0 0 1 0 2 97 0 0 0
200 0.00 40 0.00 60 0.00 0 0 1 1 0 97 0 0 1
130 0.00 2 0.00 60 0.00 0 0 1 2 0 95 1 0 1
64 0.00 20 0.00 60 0.00 0 0 1 1 0 60 1 0 1
80 0.00 20 0.00 70 0.00 0 0 0 2 0 80 1 0 1
20 0.00 1 1.00 70 0.00 0 0 1 2 0 8 0 0 0
30 0.00 1 1.00 20 0.00 0 0 1 1 0 20 0 0 0
40 0.00 40 0.00 20 0.00 0 1 1 0 0 0 1 0 0
30 0.00 40 0.00 20 0.00 0 1 0 0 0 0 1 0 0
100 0.00 40 0.00 90 0.00 0 1 0 0 0 0 1 0 0
45 0.00 60 0.00 55 0.00 0 0 1 2 0 12 0 0 0
50 0.00 60 0.00 80 0.00 0 0 1 2 0 8 0 0 0
60 0.00 90 0.00 80 0.00 0 0 1 2 0 15 0 0 0
48 0.00 90 0.00 80 0.00 0 0 0 2 0 10 0 0 0
100 0.00 90 0.00 20 0.00 0 0 -1 2 0 30 0 0 0
85 0.00 30 0.00 20 0.00 0 0 -1 2 0 20 1 0 0
10 0.00 90 0.00 2 1.00 0 0 1 0 0 0 0 0 1
22 0.00 120 0.00 3 1.00 0 0 1 0 0 0 0 0 1
50 0.00 150 0.00 1 1.00 0 0 1 0 0 0 0 0 1
30 0.00 80 0.00 4 1.00 0 0 0 0 0 0 0 0 1
12 0.35 20 0.00 2 1.00 0 0 1 0 0 0 0 0 1
30 0.30 80 0.00 2 1.00 0 0 1 0 0 0 0 0 1
30 0.00 70 0.00 40 0.00 0 0 1 1 0 85 0 0 1
60 0.00 75 0.00 40 0.00 0 0 1 2 0 95 0 0 1
80 0.00 75 0.00 90 0.00 0 0 1 2 0 40 0 0 1
90 0.00 65 0.00 90 0.00 0 0 0 2 0 45 0 0 1
6 0.00 30 0.00 35 0.00 0 0 1 1 0 96 0 0 1
6 0.00 30 0.00 2 1.00 0 0 1 1 0 92 0 0 1
6 0.00 30 0.00 35 0.00 0 0 0 1 0 88 0 0 1
4 0.00 65 0.00 0 0.00 0 0 1 0 0 0 0 0 1
6 0.00 70 0.00 3 0.00 0 0 1 0 0 0 0 0 1
5 0.00 80 0.00 12 0.00 0 0 1 0 0 0 0 0 1
9 0.00 100 0.00 60 0.00 0 0 1 0 0 0 0 0 1
1 0.00 60 0.00 2 1.00 0 0 1 0 0 0 0 0 1
7 0.00 200 0.00 9 0.00 0 0 1 0 0 0 0 0 1
3 0.00 75 0.00 100 0.00 1 0 1 0 0 0 0 0 1
18 0.00 75 0.00 9 0.00 0 0 1 0 0 0 0 1 1
16 0.00 85 0.00 9 0.00 0 0 1 0 0 0 0 1 1
20 0.00 2 1.00 9 0.00 0 0 1 0 0 0 0 0 1
25 0.00 1 1.00 60 0.00 0 0 1 0 0 0 0 0 1
3 0.00 4 1.00 60 0.00 0 0 1 0 0 0 0 0 1
2 1.00 5 0.00 8 0.00 0 0 1 1 0 1 0 0 0
3 0.67 40 0.00 3 0.00 0 0 1 2 0 1 0 0 0
2 1.00 6 0.00 11 0.00 0 0 1 1 0 1 0 0 0
2 0.50 5 0.00 0 0.00 0 0 1 1 0 1 0 0 0
4 0.00 5 0.00 6 0.00 0 0 1 2 0 2 0 0 0
7 0.00 4 0.00 2 0.00 0 0 0 2 0 8 0 0 0
6 0.90 4 0.00 8 0.00 0 0 0 1 0 3 0 0 0
9 0.00 35 0.00 36 0.00 0 0 1 2 0 7 0 0 0
7 0.00 35 0.00 36 0.00 0 0 1 1 0 5 0 0 0
"""


def labelled() -> tuple[np.ndarray, np.ndarray]:
    rows = np.array([line.split() for line in LABELLED.strip().split("\n")], dtype=float)
    return rows[:, :-1], rows[:, -1].astype(int)


def grow(x: np.ndarray, y: np.ndarray, depth: int = 10, leaf: int = 3) -> tuple | int:
    """A binary tree of (feature, threshold, tree at most it, tree above), by Gini impurity; ``leaf`` rows at least a side."""
    if depth == 0 or y.min() == y.max():
        return int(2 * y.sum() >= len(y))
    best = (np.inf, 0, 0.0)
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for cut in (values[1:] + values[:-1]) / 2:
            left = x[:, f] <= cut
            a, b = y[left], y[~left]
            if min(len(a), len(b)) < leaf:
                continue
            impure = len(a) * a.mean() * (1 - a.mean()) + len(b) * b.mean() * (1 - b.mean())
            if impure < best[0] - 1e-12:
                best = (impure, f, float(cut))
    if best[0] == np.inf:
        return int(2 * y.sum() >= len(y))
    left = x[:, best[1]] <= best[2]
    return best[1], best[2], grow(x[left], y[left], depth - 1, leaf), grow(x[~left], y[~left], depth - 1, leaf)


def decide(tree: tuple | int, row: tuple) -> bool:
    while not isinstance(tree, int):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return bool(tree)


def _attributes(tag: str, attrs: str) -> tuple[bool, int, int]:
    """Whether an element is hidden or takes a page part's role; how much of one of its names is a word for such a part
    (0 no word, 1 some words, 2 all words), and how much a word for readers' comments."""
    part, named, talk = False, 0, 0
    for name, *values in _ATTR.findall(attrs):
        name, value = name.lower(), "".join(values).lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
            part = True
        elif name == "role" and _ROLE.search(value):
            part = True
        elif name in ("class", "id") and tag not in ("body", "main"):
            for one in value.split():
                words = _WORDS.findall(one)
                noise = sum(1 for w in words if _NOISE.match(w))
                reader = sum(1 for w in words if _TALK.match(w))
                named = max(named, (noise > 0) + (0 < noise == len(words)))
                talk = max(talk, (reader > 0) + (0 < reader == len(words)))
    return part, named, talk


def _phrases(text: str) -> int:
    return sum(1 for p in _PHRASES if p in text)


def blocks_of(page: str) -> list[tuple[str, tuple]]:
    """The text and the features (neighbours apart: words, links, heading, part, place, named, talk, share, alone,
    phrases) of each text block in page order.

    ``place`` is 1 inside an article, -1 outside one on a page that has any, else 0.  ``named`` and ``talk`` come from the
    innermost element with a telling name; one that holds a top heading counts a step less, and as no comments.
    ``share`` is the percentage of the page's words in that element; a block is ``alone`` that holds a quarter of the unlinked
    words outside page parts and telling names."""
    out: list[tuple] = []
    marks: list[list[int]] = []                           # elements with a telling name: outer one, named, talk, words, top heading
    stack: list[tuple[str, bool, bool, int]] = [("", False, False, -1)]   # open sectioning element, part, article, mark
    is_open = dict.fromkeys(_SECTION, 0)                  # how many of each are on the stack
    text: list[str] = []
    linked: list[str] = []
    link, heading, own = 0, "", -1

    def mark(attrs: str, tag: str) -> tuple[bool, int]:
        part, named, talk = _attributes(tag, attrs) if attrs else (False, 0, 0)
        if tag == "form":
            named = 2
        if named or talk:
            marks.append([stack[-1][3], named, talk, 0, 0])
            return part, len(marks) - 1
        return part, stack[-1][3]

    def end() -> None:
        if text:
            body = " ".join(html.unescape("".join(text)).split())
            if body:
                words = body.count(" ") + 1
                in_links = len("".join(linked).split()) if linked else 0
                at = own if own >= 0 else stack[-1][3]
                if at >= 0:
                    marks[at][3] += words
                    marks[at][4] |= heading == "h1"
                out.append((body, words, min(1.0, in_links / words), int(heading != ""), int(stack[-1][1]), stack[-1][2], at))
            text.clear()
            linked.clear()

    for m in _TOKEN.finditer(page):
        if m.lastindex == 5:
            text.append(m[5])
            if link:
                linked.append(m[5])
            continue
        tag = m[3]
        if tag is None:
            continue
        tag = tag.lower()
        if tag == "a":
            link = 0 if m[2] else 1
        elif tag == "br" or tag == "img" or tag == "input":
            text.append(" ")
        elif tag in _BLOCK:
            end()
            link = 0
            heading = tag if tag in _HEADING and not m[2] else ""
            own = -1
            if tag not in _SECTION:
                if not m[2] and m[4]:
                    own = mark(m[4], tag)[1]
            elif not m[2]:
                if not m[4].endswith("/"):
                    part, at = mark(m[4], tag)
                    _, was_part, in_article, outer = stack[-1]
                    part = part or was_part or tag in _PART or tag == "header" and not in_article
                    is_open[tag] += 1
                    stack.append((tag, part, in_article or tag in ("article", "main"), at))
            else:
                while is_open[tag]:
                    last = stack.pop()[0]
                    is_open[last] -= 1
                    if last == tag:
                        break
    end()
    for outer, _, _, words, top in reversed(marks):
        if outer >= 0:
            marks[outer][3] += words
            marks[outer][4] |= top
    every = max(1, sum(b[1] for b in out))
    plain = max(1.0, sum(b[1] * (1 - b[2]) for b in out if not b[4] and b[6] < 0))
    has_article = any(b[5] and not b[4] for b in out)
    told: list[tuple[int, int, float]] = []               # named, talk, share by mark; comments go on inwards
    for outer, named, talk, words, top in marks:
        named, talk = (max(named, talk) - 1, 0) if top else (named, talk)
        told.append((named, max(talk, told[outer][1] if outer >= 0 else 0), 100 * words / every))
    blocks = []
    for body, words, links, head, part, in_article, at in out:
        named, talk, share = told[at] if at >= 0 else (0, 0, 0.0)
        blocks.append((body, (words, links, head, part, 1 if in_article else -1 if has_article else 0, named, talk,
                              share if named or talk else 0.0, int(4 * words * (1 - links) >= plain), _phrases(body.lower()) if words < 100 else 0)))
    return blocks


def main_text(page: str | None, tree: tuple | int) -> str:
    found = blocks_of(page) if page else []
    kept = []
    for i, (text, (words, links, *rest)) in enumerate(found):
        before = found[i - 1][1] if i else (0, 0.0)
        after = found[i + 1][1] if i + 1 < len(found) else (0, 0.0)
        if decide(tree, (words, links, before[0], before[1], after[0], after[1], *rest)):
            kept.append(text)
    return "\n".join(kept)


def extract(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns ``keep`` and ``text`` of every page."""
    x, y = labelled()
    tree = grow(x, y)
    pages = pages.select(*keep, F.col(html_col).cast("string").alias("_html"))
    schema = T.StructType([*pages.schema.fields[:-1], T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = pa.array([main_text(h.as_py(), tree) for h in batch.column(batch.num_columns - 1)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], text], names=[*batch.schema.names[:-1], "text"])

    return pages.mapInArrow(run, schema)
