"""DuckDB statements for those operators that SQL can express, by other means than the Spark code."""

from __future__ import annotations


def crc32(text: str) -> str:
    """Unsigned CRC-32 of an ASCII string: every byte, then eight shifts (marked -1)."""
    steps = (f"flatten(list_transform(string_split({text}, ''), lambda ch: [ascii(ch)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))")
    return (f"xor(4294967295, list_reduce({steps}, lambda crc, e: CASE WHEN e >= 0 THEN xor(crc, e) "
            f"WHEN crc % 2 = 1 THEN xor(crc >> 1, 3988292384) ELSE crc >> 1 END, 4294967295::BIGINT))")


def _enc(column: str) -> str:
    return f"CASE WHEN {column} IS NULL THEN '-' ELSE strlen({column}::VARCHAR) || ':' || {column}::VARCHAR END"


_LEAF = "sha256(concat(" + ", ".join(_enc(c) for c in ("doc_id", "source", "lang", "n_chars")) + ", {text}))"

#: level by level; ``step`` numbers the levels of a document's way to the root, first its source's, then the upper tree's
OP11 = f"""
WITH RECURSIVE docs AS (
  SELECT *, coalesce('=' || source, '') AS grp,
         CASE WHEN {crc32("doc_id::VARCHAR")} % 5 = 0
              THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS changed
  FROM documents),
leaf AS (
  SELECT doc_id, grp, {_LEAF.format(text=_enc("text"))} AS leaf, {_LEAF.format(text=_enc("changed"))} AS other FROM docs),
placed AS (
  SELECT *, row_number() OVER () AS rid, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place,
         count(*) OVER (PARTITION BY grp) AS n FROM leaf),
tree AS (
  SELECT 0 AS level, grp, place, leaf AS digest, n FROM placed
  UNION ALL
  SELECT level + 1, grp, place // 16, sha256(string_agg(digest, '' ORDER BY place)), (n + 15) // 16
  FROM tree WHERE n > 1 GROUP BY level, grp, place // 16, n),
sub AS (SELECT grp, level AS height, digest AS subroot, row_number() OVER (ORDER BY grp) - 1 AS place, count(*) OVER () AS n FROM tree WHERE n = 1),
upper_tree AS (
  SELECT 0 AS level, place, subroot AS digest, n FROM sub
  UNION ALL
  SELECT level + 1, place // 16, sha256(string_agg(digest, '' ORDER BY place)), (n + 15) // 16
  FROM upper_tree WHERE n > 1 GROUP BY level, place // 16, n),
top AS (SELECT digest AS root FROM upper_tree WHERE n = 1),
run AS (
  SELECT grp, level AS step, place, digest FROM tree WHERE n > 1
  UNION ALL
  SELECT s.grp, s.height + u.level, u.place, u.digest FROM sub s, upper_tree u WHERE u.n > 1),
way AS (
  SELECT p.rid, p.grp, r.step, r.place, r.digest,
         CASE WHEN r.step < s.height THEN p.place >> (4 * r.step) ELSE s.place >> (4 * (r.step - s.height)) END AS own
  FROM placed p JOIN sub s USING (grp) JOIN run r USING (grp)
  WHERE r.place // 16 = CASE WHEN r.step < s.height THEN p.place >> (4 * r.step + 4) ELSE s.place >> (4 * (r.step - s.height) + 4) END),
proof AS (SELECT rid, string_agg(digest, '' ORDER BY step, place) FILTER (WHERE place <> own) AS siblings FROM way GROUP BY rid),
fold AS (
  SELECT rid, 0 AS step, other AS here FROM placed
  UNION ALL
  SELECT f.rid, f.step + 1, sha256(string_agg(CASE WHEN w.place = w.own THEN f.here ELSE w.digest END, '' ORDER BY w.place))
  FROM fold f JOIN way w ON w.rid = f.rid AND w.step = f.step GROUP BY f.rid, f.step),
ends AS (SELECT rid, arg_max(here, step) AS folded_root FROM fold GROUP BY rid)
SELECT p.doc_id, p.leaf, s.subroot, t.root, sha256(coalesce(q.siblings, '')) AS proof_sha256, e.folded_root, e.folded_root = t.root AS verified
FROM placed p JOIN sub s USING (grp) JOIN top t ON true JOIN ends e USING (rid) LEFT JOIN proof q USING (rid)
"""


_WORD = r"[^\x20\x09-\x0D]"


def _rule(name: str, over: str, under: str, slack: int, least_words: int = 0) -> str:
    return (f"SELECT rid, lang_key, source_key, '{name}' AS rule, {slack} AS slack, 1000 * {over} // {under} AS value FROM measured "
            f"WHERE {under} > 0 AND n_words >= {least_words}")


def _quartiles(sketch: str, keys: str) -> str:
    return (f"SELECT {keys}rule, docs, min(CASE WHEN 4 * upto >= docs THEN low END) AS q1, min(CASE WHEN 4 * upto >= 3 * docs THEN high END) AS q3 "
            f"FROM (SELECT *, sum(n) OVER (PARTITION BY {keys}rule ORDER BY low) AS upto, sum(n) OVER (PARTITION BY {keys}rule) AS docs "
            f"FROM (SELECT {keys}rule, low, high, sum(n) AS n FROM {sketch} GROUP BY {keys}rule, low, high)) GROUP BY {keys}rule, docs")


#: figures by splitting and counting; limits from buckets of 128 a doubling, 200 documents a group, 8 quartile distances
OP13 = f"""
WITH base AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce('=' || lang, '') AS lang_key, coalesce('=' || source, '') AS source_key, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '{_WORD}+') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '{_WORD}')) AS ls
  FROM documents),
word AS (SELECT rid, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM base),
five AS (
  SELECT rid, i, w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o || ' ' || lead(w, 3) OVER o || ' ' || lead(w, 4) OVER o AS x
  FROM word WINDOW o AS (PARTITION BY rid ORDER BY i)),
twice AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, x) AS k FROM five WHERE x IS NOT NULL),
repeated AS (SELECT rid, count(DISTINCT i + j) AS n_repeat_words FROM twice, range(5) AS r(j) WHERE k > 1 GROUP BY rid),
measured AS (
  SELECT b.*, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
         (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols, len(ls)::BIGINT AS n_lines,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(r.n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM base b LEFT JOIN repeated r USING (rid)),
figure AS (
  {_rule("word_length", "word_chars", "n_words", 1500, 50)} UNION ALL {_rule("symbols", "n_symbols", "n_words", 250)} UNION ALL
  {_rule("same_lines", "n_dup_lines", "n_lines", 400)} UNION ALL {_rule("repetition", "n_repeat_words", "n_words", 150)}),
bucket AS (SELECT *, greatest(length(bin(value)) - 8, 0)::INTEGER AS shift FROM figure),
sketch AS (
  SELECT lang_key, source_key, rule, (value >> shift) << shift AS low, ((value >> shift) << shift) + (1::BIGINT << shift) - 1 AS high, count(*) AS n
  FROM bucket GROUP BY ALL),
by_source AS ({_quartiles("sketch", "lang_key, source_key, ")}),
by_lang AS ({_quartiles("sketch", "lang_key, ")}),
by_all AS ({_quartiles("sketch", "")}),
chosen AS (
  SELECT s.lang_key, s.source_key, s.rule, CASE WHEN s.docs >= 200 THEN s.q1 WHEN l.docs >= 200 THEN l.q1 ELSE a.q1 END AS q1,
         CASE WHEN s.docs >= 200 THEN s.q3 WHEN l.docs >= 200 THEN l.q3 ELSE a.q3 END AS q3
  FROM by_source s JOIN by_lang l USING (lang_key, rule) JOIN by_all a USING (rule)),
failed AS (
  SELECT DISTINCT rid FROM figure JOIN chosen USING (lang_key, source_key, rule)
  WHERE value > q3 + greatest(8 * (q3 - q1), slack) OR (rule = 'word_length' AND value < q1 - greatest(8 * (q3 - q1), slack))),
based AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM measured)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND f.rid IS NULL AS kept
FROM based LEFT JOIN failed f USING (rid)
"""
