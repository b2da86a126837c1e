"""String functions: LCS similarity ratio (F1), token count (F4), entity text (F5),
answer normalisation (F12).

The similarity ratio is ``2 * LCS(a, b) / (len(a) + len(b))`` (1.0 for two
empty strings): an edit distance where a substitution costs two.  Two
implementations give identical results:

* ``lcs_ratio_native`` -- a JVM-side higher-order expression using the
  bit-parallel LCS recurrence over a 64-bit mask of the *shorter* string.  Valid
  while the shorter string has at most 62 characters.
* ``lcs_ratio_arrow`` -- an Arrow ``pandas_udf`` running the same recurrence on
  Python integers (no length limit), memoised per batch.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NATIVE_MAX_LEN = 62

# Fixed value: a token is a run of ASCII letters/digits, or one other non-space
# character.  The class lists the whitespace explicitly so that Java and RE2
# regular expressions agree on it.
TOKEN_PATTERN = r"[A-Za-z0-9]+|[^\t\n\x0B\f\r A-Za-z0-9]"


def lcs_length(a: str, b: str) -> int:
    """Bit-parallel LCS length (Allison-Dix / Hyyro recurrence)."""
    if not a or not b:
        return 0
    if len(a) < len(b):
        a, b = b, a
    masks: dict[str, int] = {}
    for j, ch in enumerate(b):
        masks[ch] = masks.get(ch, 0) | (1 << j)
    full = (1 << len(b)) - 1
    v = full
    for ch in a:
        m = masks.get(ch)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(b) - v.bit_count()


def lcs_ratio_py(a: str, b: str) -> float:
    total = len(a) + len(b)
    if total == 0:
        return 1.0
    return 2.0 * lcs_length(a, b) / total


@F.pandas_udf(T.DoubleType())
def _lcs_ratio_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    memo: dict[tuple[str, str], float] = {}
    out = []
    for x, y in zip(a, b):
        if x is None or y is None:
            out.append(None)
            continue
        key = (x, y)
        r = memo.get(key)
        if r is None:
            r = lcs_ratio_py(x, y)
            memo[key] = r
        out.append(r)
    return pd.Series(out, dtype="float64")


def lcs_ratio_arrow(a: Column, b: Column) -> Column:
    return _lcs_ratio_udf(a, b)


def _shl1(n: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), n)


def lcs_ratio_native(a: Column, b: Column) -> Column:
    """Same ratio as a Catalyst expression (shorter string <= 62 characters)."""
    la, lb = F.length(a), F.length(b)
    s = F.when(la <= lb, a).otherwise(b)          # bits over the shorter string
    long_ = F.when(la <= lb, b).otherwise(a)
    ls = F.least(la, lb)
    full = _shl1(ls) - F.lit(1).cast("long")
    chars = F.transform(F.sequence(F.lit(1), F.length(long_)), lambda i: long_.substr(i, F.lit(1)))

    def mask_of(c: Column) -> Column:
        return F.aggregate(
            F.sequence(F.lit(1), ls), F.lit(0).cast("long"),
            lambda m, j: m.bitwiseOR(F.when(s.substr(j, F.lit(1)) == c,
                                            _shl1(j - 1))
                                     .otherwise(F.lit(0).cast("long"))))

    masks = F.transform(chars, mask_of)
    v = F.aggregate(masks, full,
                    lambda v, m: ((v + v.bitwiseAND(m)).bitwiseOR(v - v.bitwiseAND(m))).bitwiseAND(full))
    lcs = ls - F.bit_count(v)
    ratio = F.when(la + lb == 0, F.lit(1.0)) \
        .when(ls == 0, F.lit(0.0)) \
        .otherwise(F.lit(2.0) * lcs / (la + lb))
    return ratio


def lcs_ratio(a: Column, b: Column, max_len: int | None = None) -> Column:
    """Pick the native expression when the caller knows strings are short."""
    if max_len is not None and max_len <= NATIVE_MAX_LEN:
        return lcs_ratio_native(a, b)
    return lcs_ratio_arrow(a, b)


def token_count(text: Column) -> Column:
    """Pluggable token count (default rule above); NULL text counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN_PATTERN)), F.lit(0)).cast("int")


def entity_text(entity: Column) -> Column:
    """Render a map as ``"k": "v", "k2": "v2"`` in its own key order."""
    return F.array_join(
        F.transform(F.map_entries(entity),
                    lambda e: F.concat(F.lit('"'), e["key"], F.lit('": "'), e["value"], F.lit('"'))),
        ", ")


def entity_cost(e1: Column, e2: Column) -> Column:
    """ER record cost: tokens of every value of entity1 and the same keys of entity2."""
    return F.aggregate(
        F.map_keys(e1), F.lit(0),
        lambda acc, k: acc + token_count(F.element_at(e1, k)) + token_count(F.element_at(e2, k)))


def normalise_reply(x: Column) -> Column:
    """Model side: drop trailing ';' and all spaces (case kept)."""
    return F.replace(F.regexp_replace(x, r";+\z", ""), F.lit(" "), F.lit(""))


def normalise_gold(x: Column) -> Column:
    return F.replace(x, F.lit(" "), F.lit(""))
