"""Scalar column functions (JVM-side expressions; one Arrow UDF for long-string LCS)."""

from quire.functions.replies import parse_json_reply, parse_yes_no, reply_answer
from quire.functions.strings import (entity_cost, entity_text, lcs_ratio, lcs_ratio_arrow,
                                     lcs_ratio_native, lcs_ratio_py, normalise_gold,
                                     normalise_reply, token_count)
from quire.functions.vectors import (cosine_dist, dot, euclid, norm, reciprocal, sq_euclid,
                                     unit)

__all__ = ["cosine_dist", "dot", "entity_cost", "entity_text", "euclid", "lcs_ratio",
           "lcs_ratio_arrow", "lcs_ratio_native", "lcs_ratio_py", "norm", "normalise_gold",
           "normalise_reply", "parse_json_reply", "parse_yes_no", "reciprocal", "reply_answer",
           "sq_euclid", "token_count", "unit"]
