"""Reply parsing (F10, F11) as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_yes_no(text: Column, strict: bool = False) -> Column:
    """One verdict per line: a line containing ``yes`` -> 1, else containing ``no`` -> 0,
    else skipped.  ``Yes``/``No`` are folded to lower case first; everything is a plain
    substring test (``know`` counts as no).  ``strict=True`` wants whole words."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n")

    def verdict(line: Column) -> Column:
        s = F.replace(F.replace(line, F.lit("No"), F.lit("no")), F.lit("Yes"), F.lit("yes"))
        if strict:
            has_yes = s.rlike(r"\byes\b")
            has_no = s.rlike(r"\bno\b")
        else:
            has_yes = F.instr(s, "yes") > 0
            has_no = F.instr(s, "no") > 0
        return F.when(has_yes, F.lit(1)).when(has_no, F.lit(0))

    return F.filter(F.transform(lines, verdict), lambda x: x.isNotNull())


def parse_json_reply(text: Column) -> Column:
    """JSON object -> map<string,string>; numbers become their text; anything that is not one JSON
    object (single quotes, text after the object) -> NULL."""
    whole = F.rtrim(F.regexp_replace(text, r"\s+$", "")).endswith("}")
    return F.when(whole, F.from_json(text, "map<string,string>", {"allowSingleQuotes": "false"}))


def reply_answer(reply: Column, pos: Column) -> Column:
    """Answer to question ``pos`` (0-based) of a parsed JSON reply."""
    return F.element_at(reply, F.concat(F.lit("Question"), (pos + F.lit(1)).cast("string")))
