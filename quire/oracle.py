"""DuckDB statements that compute the same results as ``quire.catalog`` by brute force.

They read the driver's pre-registered views directly and spell every fixture rule
out again in SQL; doubles are rounded to 6 digits as on the Spark side.
"""

from __future__ import annotations

from quire.catalog import (AFF_R, BAND_K0, BAND_K1, BOUND_ROUNDS, CODE_CFG, COVER_CNT, ER_CFG, ER_DOMINATED, ER_GROUP, ER_RANDOM, ER_SIMILAR, EPS_SIM, EUC_R, K0_AFF, K0_CORR, K0_DENSE, K0_DIV, K2_REPORT, LSH_R, MANHATTAN_R, PCT,
                           PIVOT_R, PROMPT_DEMOS, QUARTER, SEED, T_COST, TXT_DEMO_MOD, TXT_DEMOS, TXT_GROUP, UPPER, VEC_K1, WEAK_EDGE)
from quire.functions.prompts import (CODE_QUESTIONS_HEADER, CODE_TASK_TEXT, ER_TASK_TEXT, JD_QUESTIONS_HEADER,
                                     JD_TASK_TEXT, QA_QUESTIONS_HEADER, QA_TASK_TEXT)
from quire.functions.strings import TOKEN_PATTERN
from quire.sources.fixtures import EVAL_GROUP, EVAL_JSON_SPAN, GRAPH_RADIUS, GRAPH_SHIFT


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def tok(x: str) -> str:
    return f"coalesce(len(regexp_extract_all({x}, {_lit(TOKEN_PATTERN)})), 0)"


def lcs_ratio(a: str, b: str) -> str:
    """Bit-parallel LCS over a BIGINT mask of ``b`` (values here are <= 62 characters)."""
    mask = (f"list_sum(list_transform(generate_series(1, length({b})), lambda j: "
            f"CASE WHEN substring({b}, j, 1) = c THEN (1::BIGINT << (j - 1)) ELSE 0::BIGINT END))")
    full = f"((1::BIGINT << length({b})) - 1)"
    v = (f"list_reduce(string_split({a}, ''), lambda v, c: (((v + (v & {mask})) | (v - (v & {mask}))) & {full}), "
         f"{full})")
    return (f"(CASE WHEN length({a}) + length({b}) = 0 THEN 1.0 "
            f"WHEN length({a}) = 0 OR length({b}) = 0 THEN 0.0 "
            f"ELSE 2.0 * (length({b}) - bit_count({v})) / (length({a}) + length({b})) END)")


def _ent(n: str, b: str, t: str) -> str:
    return f"""'"name": "' || {n} || '", "brand": "' || {b} || '", "type": "' || {t} || '"'"""


ER = """er AS (
  SELECT a.p_partkey AS id, a.p_name AS n1, a.p_brand AS b1, a.p_type AS t1,
         b.p_name AS n2, b.p_brand AS b2, b.p_type AS t2,
         CASE WHEN a.p_type = b.p_type THEN '1' ELSE '0' END AS answer,
         (a.p_partkey % 5 = 0) AS is_demo
  FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1)"""

COS = "(1 - list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b}))))"


def cos(a: str, b: str) -> str:
    return COS.format(a=a, b=b)


VEC_BASE = f"""vq AS (SELECT vec_id AS ques_id, embedding::DOUBLE[] AS v, label FROM embeddings WHERE vec_id % 5 <> 0),
vd AS (SELECT vec_id AS demo_id, embedding::DOUBLE[] AS v, label FROM embeddings WHERE vec_id % 5 = 0),
vp AS (SELECT q.ques_id, d.demo_id, {cos('q.v', 'd.v')} AS cdist, list_distance(q.v, d.v) AS edist
       FROM vq q CROSS JOIN vd d),
knn AS (SELECT ques_id, demo_id, dist, rank FROM (
          SELECT ques_id, demo_id, cdist AS dist,
                 row_number() OVER (PARTITION BY demo_id ORDER BY cdist, ques_id) AS rank
          FROM vp WHERE cdist <= {VEC_K1}) WHERE rank <= {UPPER})"""
VEC = VEC_BASE + """,
cc AS (SELECT q.label::BIGINT AS cluster_id, k.demo_id, k.ques_id, k.dist FROM knn k JOIN vq q USING (ques_id))"""

GRAPH_BASE = f"""gv AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label FROM embeddings),
gp AS (SELECT a.id AS src, b.id AS dst, {cos('a.v', 'b.v')} AS d FROM gv a JOIN gv b ON a.id < b.id)"""
GRAPH = GRAPH_BASE + f""",
ge AS (SELECT src, dst, {GRAPH_SHIFT} - d AS weight FROM gp WHERE d <= {GRAPH_RADIUS})"""


def reach(nodes: str, und: str) -> str:
    """Recursive reachability ``reach(id, r)``: ``r`` reaches ``id`` (``und(a, b)`` both directions)."""
    return (f"reach(id, r) AS (SELECT id, id FROM {nodes} UNION "
            f"SELECT u.b, reach.r FROM reach JOIN {und} u ON u.a = reach.id)")


def _demo_sets(each: int, out: str = "tgd") -> str:
    """Group g has demo set g modulo the number of sets of ``each`` consecutive demos."""
    return (f"{out}s AS (SELECT demo_id, (row_number() OVER (ORDER BY demo_id) - 1) // {each} AS no FROM td),\n"
            f"{out} AS (SELECT g.group_id, s.demo_id FROM tg g JOIN {out}s s ON s.no = g.group_id % (SELECT max(no) + 1 FROM {out}s))")


TXT_ROWS = f"""tq AS (SELECT doc_id AS ques_id, text, CASE WHEN n_chars > 1000 THEN 'true' ELSE 'false' END AS answer,
              {tok('text')} AS cost, doc_id // {TXT_GROUP} AS group_id FROM documents),
td AS (SELECT item_id AS demo_id, text, CASE WHEN length(text) > 180 THEN 'true' ELSE 'false' END AS answer,
              {tok('text')} AS cost FROM benchmark),
tg AS (SELECT DISTINCT group_id FROM tq)"""
TXT_TOTALS = """tt AS (SELECT g.group_id,
              coalesce((SELECT sum(cost) FROM tq WHERE tq.group_id = g.group_id), 0) AS qtok,
              coalesce((SELECT sum(d.cost) FROM tgd x JOIN td d USING (demo_id) WHERE x.group_id = g.group_id), 0) AS dtok,
              (SELECT count(*) FROM tq WHERE tq.group_id = g.group_id) AS nq,
              (SELECT count(*) FROM tgd x WHERE x.group_id = g.group_id) AS nd
       FROM tg g)"""
# groups with demo sets of TXT_DEMOS; groups with every demo of their residue
TXT = ",\n".join((TXT_ROWS, _demo_sets(TXT_DEMOS), TXT_TOTALS))
TXT_ALL = ",\n".join((TXT_ROWS, f"tgd AS (SELECT g.group_id, d.demo_id FROM tg g JOIN td d ON d.demo_id % {TXT_DEMO_MOD} = g.group_id % {TXT_DEMO_MOD})",
                      TXT_TOTALS))

EVAL = f"""eg AS (SELECT doc_id // {EVAL_GROUP} AS group_id, doc_id, quality AS gold, toxic AS pred,
              (row_number() OVER (PARTITION BY doc_id // {EVAL_GROUP} ORDER BY doc_id) - 1) AS pos FROM labels),
ep AS (SELECT group_id, list(gold::VARCHAR ORDER BY pos) AS answers, count(*) AS n, max(pred) AS any_toxic
       FROM eg GROUP BY group_id),
el AS (SELECT group_id, pos, 'Question ' || (pos + 1) || ', ' ||
              CASE WHEN pred = 1 THEN 'Yes, Product A and Product B are the same product.'
                   ELSE 'No, Product A and Product B are different products.' END AS line FROM eg),
eagg AS (SELECT el.group_id, string_agg(el.line, chr(10) ORDER BY el.pos) AS full_text,
                string_agg(el.line, chr(10) ORDER BY el.pos) FILTER (WHERE el.pos < ep.n - 1) AS short_text,
                any_value(ep.any_toxic) AS any_toxic
         FROM el JOIN ep USING (group_id) GROUP BY el.group_id),
er_resp AS (SELECT group_id, 1 AS attempt, CASE WHEN any_toxic = 1 THEN coalesce(short_text, '') ELSE full_text END AS text FROM eagg
            UNION ALL SELECT group_id, 2, full_text FROM eagg),
yn AS (SELECT group_id, attempt, list_filter(list_transform(string_split(text, chr(10)), lambda l:
          CASE WHEN contains(replace(replace(l, 'No', 'no'), 'Yes', 'yes'), 'yes') THEN 1
               WHEN contains(replace(replace(l, 'No', 'no'), 'Yes', 'yes'), 'no') THEN 0 END), lambda x: x IS NOT NULL) AS v
       FROM er_resp),
fv AS (SELECT yn.group_id, min(yn.attempt) AS attempt FROM yn JOIN ep USING (group_id)
       WHERE len(yn.v) = ep.n AND yn.attempt <= 30 GROUP BY yn.group_id),
fvv AS (SELECT fv.group_id, yn.v FROM fv JOIN yn ON yn.group_id = fv.group_id AND yn.attempt = fv.attempt),
cnt AS (SELECT ep.group_id,
          (SELECT count(*) FROM eg x WHERE x.group_id = ep.group_id AND fvv.v[x.pos + 1] = 1 AND x.gold = 1) AS tp,
          (SELECT count(*) FROM eg x WHERE x.group_id = ep.group_id AND fvv.v[x.pos + 1] = 1 AND x.gold <> 1) AS fp,
          (SELECT count(*) FROM eg x WHERE x.group_id = ep.group_id AND fvv.v[x.pos + 1] = 0 AND x.gold = 0) AS tn,
          (SELECT count(*) FROM eg x WHERE x.group_id = ep.group_id AND fvv.v[x.pos + 1] = 0 AND x.gold <> 0) AS fn,
          fvv.v IS NULL AS unanswered
        FROM ep LEFT JOIN fvv USING (group_id))"""

EJSON = f"""jg AS (SELECT d.source || '-' || (l.doc_id // {EVAL_JSON_SPAN})::VARCHAR AS group_id, d.source AS table_name, l.doc_id,
              CASE WHEN l.quality = 1 THEN 'yes' ELSE 'no' END AS gold, l.toxic
       FROM labels l JOIN documents d USING (doc_id)),
jgp AS (SELECT *, (row_number() OVER (PARTITION BY group_id ORDER BY doc_id) - 1) AS pos FROM jg),
jval AS (SELECT *, CASE WHEN doc_id % 3 = 0 THEN ' ' || (CASE WHEN toxic = 1 THEN 'no' ELSE 'yes' END) || ';;'
                        ELSE (CASE WHEN toxic = 1 THEN 'no' ELSE 'yes' END) END AS val FROM jgp),
jfull AS (SELECT group_id, max(toxic) AS any_toxic,
                 '{{' || coalesce(string_agg('"Question' || (pos + 1) || '": "' || val || '"', ', ' ORDER BY pos)
                                  FILTER (WHERE doc_id % 7 <> 0), '') || '}}' AS full_text
          FROM jval GROUP BY group_id),
jresp AS (SELECT group_id, 1 AS attempt, CASE WHEN any_toxic = 1 THEN substring(full_text, 1, length(full_text) - 1)
                                              ELSE full_text END AS text FROM jfull
          UNION ALL SELECT group_id, 2, full_text FROM jfull),
jok AS (SELECT group_id, attempt, text, CASE WHEN json_valid(text) THEN json_type(text) = 'OBJECT' ELSE false END AS valid FROM jresp),
jfirst AS (SELECT j.group_id, j.text FROM jok j
           JOIN (SELECT group_id, min(attempt) AS a FROM jok WHERE valid AND attempt <= 30 GROUP BY group_id) m
             ON m.group_id = j.group_id AND m.a = j.attempt),
jprompt AS (SELECT group_id, any_value(table_name) AS table_name, count(*) AS n FROM jgp GROUP BY group_id),
jmatch AS (SELECT p.group_id, p.table_name,
             CASE WHEN f.text IS NOT NULL THEN
               (SELECT count(*) FROM jgp x WHERE x.group_id = p.group_id
                  AND replace(regexp_replace(json_extract_string(f.text, '$.Question' || (x.pos + 1)), ';+$', ''), ' ', '')
                      = replace(x.gold, ' ', '')) END AS correct,
             CASE WHEN f.text IS NOT NULL THEN p.n END AS total
           FROM jprompt p LEFT JOIN jfirst f USING (group_id))"""


def _with(*parts: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(parts) + "\n"


def _er_prompt_sql() -> str:
    yes = "Yes, Product A and Product B are the same product."
    no = "No, Product A and Product B are different products."
    closing_a = "Use domain knowledge of Products to help understand the text and answer the "
    closing_b = (" in the format: For Question i, " + yes + "/" + no +
                 " For Question i+1, (repeat the above procedures)")
    return _with(ER, f"""ent AS (SELECT id, id // {ER_GROUP} AS group_id, is_demo, answer,
        {_ent('n1', 'b1', 't1')} AS e1t, {_ent('n2', 'b2', 't2')} AS e2t FROM er)""",
                 """dn AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY id) AS rn FROM ent WHERE is_demo)""",
                 """qn AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY id) AS rn FROM ent WHERE NOT is_demo)""",
                 f"""dl AS (SELECT group_id, string_agg('Demonstration ' || rn || ':' || chr(10) || 'Product A is ' || e1t
          || chr(10) || 'Product B is ' || e2t || chr(10) ||
          CASE WHEN answer = '1' THEN {_lit(yes)} ELSE {_lit(no)} END, chr(10) ORDER BY id) AS demo_txt
        FROM dn GROUP BY group_id)""",
                 """ql AS (SELECT group_id, string_agg('Question ' || rn || ':' || chr(10) || ' Product A is ' || e1t
          || chr(10) || ' Product B is ' || e2t, chr(10) ORDER BY id) AS q_txt, count(*) AS n,
          string_agg(answer, ',' ORDER BY id) AS answers FROM qn GROUP BY group_id)""") + f"""
SELECT ql.group_id, {_lit(ER_TASK_TEXT)} || chr(10) || chr(10) || dl.demo_txt || chr(10) || chr(10) || ql.q_txt
       || chr(10) || chr(10) || {_lit(closing_a)}
       || CASE WHEN ql.n = 1 THEN 'question above' ELSE 'above ' || ql.n || ' questions' END || {_lit(closing_b)} AS prompt,
       ql.answers, ql.n::BIGINT AS n_ques
FROM ql JOIN dl USING (group_id)"""


def _text_prompt_sql() -> str:
    return _with(TXT_ALL, """qn AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY ques_id) AS rn FROM tq)""",
                 """dtx AS (SELECT x.group_id, string_agg('testMethod and totalMethod:' || chr(10) || d.text || chr(10)
          || 'assertLine:' || chr(10) || d.answer || chr(10) || chr(10), '' ORDER BY d.demo_id) AS demo_txt
        FROM tgd x JOIN td d USING (demo_id) GROUP BY x.group_id)""",
                 """qtx AS (SELECT group_id, string_agg('Question' || rn || ':' || chr(10) || 'testMethod and totalMethod:'
          || chr(10) || text || chr(10), '' ORDER BY ques_id) AS q_txt,
          string_agg(answer, ',' ORDER BY ques_id) AS answers FROM qn GROUP BY group_id)""") + f"""
SELECT q.group_id, {_lit(CODE_TASK_TEXT)} || d.demo_txt || {_lit(CODE_QUESTIONS_HEADER)} || q.q_txt AS prompt,
       q.answers, {tok(f"{_lit(CODE_TASK_TEXT)} || d.demo_txt || {_lit(CODE_QUESTIONS_HEADER)} || q.q_txt")}::INTEGER AS tokens
FROM qtx q JOIN dtx d USING (group_id)"""


def balanced(cc: str, picks: str) -> str:
    """The balancing pass over the holders of the picks, one set after the other in pick order:
    a set above floor(questions / sets) of its cluster releases questions with another holder
    left, lowest id first, down to that average; nothing happens to a cluster whose first set
    releases nothing.  ``kept(cluster_id, step, demo_id, ques_id)`` is what the sets still hold."""
    return f"""hold AS (SELECT c.cluster_id, c.demo_id, c.ques_id, p.step FROM {cc} c JOIN {picks} p USING (cluster_id, demo_id)),
hm AS (SELECT *, count(*) OVER (PARTITION BY cluster_id, ques_id) AS m FROM hold),
hav AS (SELECT cluster_id, (count(DISTINCT ques_id) // count(DISTINCT demo_id))::BIGINT AS av FROM hold GROUP BY 1),
hs AS (SELECT cluster_id, step, any_value(av) AS av, list({{'q': ques_id, 'm': m}} ORDER BY ques_id) AS it
       FROM hm JOIN hav USING (cluster_id) GROUP BY 1, 2),
bal(cluster_id, step, gone, rel) AS (
  SELECT DISTINCT cluster_id, 0::BIGINT, []::BIGINT[], []::BIGINT[] FROM hs
  UNION ALL
  SELECT x.cluster_id, x.step, list_concat(x.gone, x.rel), x.rel FROM (
    SELECT s.cluster_id, s.step::BIGINT AS step, b.gone,
           list_transform(list_filter(s.it, lambda t: t.m - len(list_filter(b.gone, lambda y: y = t.q)) > 1),
                          lambda t: t.q)[1:greatest(len(s.it) - s.av, 0)] AS rel
    FROM bal b JOIN hs s ON s.cluster_id = b.cluster_id AND s.step = b.step + 1
    WHERE NOT (b.step = 1 AND len(b.rel) = 0)) x),
brel AS (SELECT cluster_id, step, unnest(rel) AS ques_id FROM bal),
kept AS (SELECT h.* FROM hold h WHERE NOT EXISTS (SELECT 1 FROM brel r WHERE r.cluster_id = h.cluster_id
         AND r.step = h.step AND r.ques_id = h.ques_id))"""


def _task_prompt_sql(task: str, header: str, demo: str) -> str:
    """Prompts of ``catalog._task_prompts``: ``demo`` is the text of one demo ``d`` as an SQL expression."""
    whole = f"{_lit(task)} || dtx.demo_txt || {_lit(header)} || qtx.q_txt"
    return _with(TXT, "qn AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY ques_id) AS rn FROM tq)",
                 _demo_sets(PROMPT_DEMOS, "pgd"),
                 f"""dtx AS (SELECT x.group_id, string_agg({demo}, '' ORDER BY d.demo_id) AS demo_txt
        FROM pgd x JOIN td d USING (demo_id) GROUP BY x.group_id)""",
                 """qtx AS (SELECT group_id, string_agg('Question' || rn || ':' || chr(10) || text || chr(10), '' ORDER BY ques_id) AS q_txt,
          string_agg(answer, ',' ORDER BY ques_id) AS answers FROM qn GROUP BY group_id)""") + f"""
SELECT qtx.group_id, {whole} AS prompt, qtx.answers, {tok(whole)}::INTEGER AS tokens FROM qtx JOIN dtx USING (group_id)"""


# Sequential greedy set cover over the VEC cover with label clusters: one pick per step,
# best newly-covered / cost, ties to the lowest demo id (a recursive CTE with a LATERAL top-1).
GREEDY_T = """sc AS (SELECT cc.cluster_id, cc.demo_id, list(cc.ques_id) AS qs,
              min(10 + d.label) + sum(10 + q.label) AS cost
       FROM cc JOIN vq q USING (ques_id) JOIN vd d USING (demo_id) GROUP BY 1, 2),
g(cluster_id, step, covered, pick, score) AS (
  SELECT DISTINCT cluster_id, 0, []::BIGINT[], NULL::BIGINT, NULL::DOUBLE FROM sc
  UNION ALL
  SELECT g.cluster_id, g.step + 1, list_distinct(list_concat(g.covered, b.qs)), b.demo_id, b.score
  FROM g, LATERAL (SELECT s.demo_id, s.qs,
                          len(list_filter(s.qs, lambda x: NOT list_contains(g.covered, x))) / greatest(s.cost, 1) AS score
                   FROM sc s WHERE s.cluster_id = g.cluster_id ORDER BY score DESC, s.demo_id LIMIT 1) b
  WHERE b.score > 0),
picks AS (SELECT cluster_id, pick AS demo_id, score, step FROM g WHERE step > 0),
{owner},
wt AS (SELECT o.cluster_id, o.demo_id, 10 + any_value(d.label) + sum(10 + q.label) AS weight
       FROM owner o JOIN vq q USING (ques_id) JOIN vd d USING (demo_id) GROUP BY 1, 2),
items AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY weight DESC, demo_id) AS rn FROM wt),
bins(cluster_id, rn, loads, demo_id, weight, bin_no) AS (
  SELECT DISTINCT cluster_id, 0::BIGINT, []::DOUBLE[], NULL::BIGINT, NULL::BIGINT, NULL::INTEGER FROM items
  UNION ALL
  SELECT b.cluster_id, b.rn + 1,
         CASE WHEN f.fit IS NULL THEN list_append(b.loads, i.weight::DOUBLE)
              ELSE list_transform(generate_series(1, len(b.loads)),
                                  lambda j: CASE WHEN j = f.fit THEN b.loads[j] + i.weight ELSE b.loads[j] END) END,
         i.demo_id, i.weight, (coalesce(f.fit, len(b.loads) + 1) - 1)::INTEGER
  FROM bins b JOIN items i ON i.cluster_id = b.cluster_id AND i.rn = b.rn + 1,
  LATERAL (SELECT CASE WHEN list_max(fl) IS NULL THEN NULL ELSE list_position(fl, list_max(fl)) END AS fit FROM (SELECT list_transform(generate_series(1, len(b.loads)),
           lambda j: CASE WHEN b.loads[j] + i.weight <= {cap} THEN b.loads[j] END) AS fl)) f)"""


OWNER_LAST = """owner AS (SELECT cc.cluster_id, cc.ques_id, arg_max(p.demo_id, p.step) AS demo_id
          FROM cc JOIN picks p USING (cluster_id, demo_id) GROUP BY 1, 2)"""
OWNER_BALANCED = balanced("cc", "picks") + """,
owner AS (SELECT cluster_id, ques_id, arg_max(demo_id, step) AS demo_id FROM kept GROUP BY 1, 2)"""


def greedy(cap: float, owner: str = OWNER_LAST) -> str:
    """Sequential greedy cover, one owner per question, item weights and best-fit-decreasing
    packing over the CTE ``cc(cluster_id, demo_id, ques_id)`` with VEC costs."""
    return GREEDY_T.replace("{owner}", owner).replace("{cap}", repr(float(cap)))


GREEDY = greedy(60.0)


def _plan_ctes(cfg) -> str:
    """The whole ER plan of ``cfg`` by brute force: LCS features, all question-demo
    distances, top-k per demo, the clusters (far or identical / near / one) labelled by
    min-label propagation, the sequential greedy cover, the balancing pass, item
    weights and best-fit-decreasing packing."""
    from quire.functions.prompts import task_text_cost
    cap = float(cfg.k2 - task_text_cost("er"))
    k0, k1, k = cfg.k0, cfg.k1, cfg.upper_ques
    d3 = "sqrt(({a}.f1 - {b}.f1) * ({a}.f1 - {b}.f1) + ({a}.f2 - {b}.f2) * ({a}.f2 - {b}.f2) + ({a}.f3 - {b}.f3) * ({a}.f3 - {b}.f3))"
    linked = {"diverse": f"{d3.format(a='a', b='b')} = 0 OR 1.0 / {d3.format(a='a', b='b')} <= {k0}",
              "similar": f"{d3.format(a='a', b='b')} <= {k0}", "random": "true"}[cfg.batch_type]
    label = "0" if cfg.batch_type == "random" else "lab.l"
    return _with(ER, f"""feat AS (SELECT id, is_demo, {lcs_ratio('n1', 'n2')} AS f1, {lcs_ratio('b1', 'b2')} AS f2,
        {lcs_ratio('t1', 't2')} AS f3,
        {tok('n1')} + {tok('b1')} + {tok('t1')} + {tok('n2')} + {tok('b2')} + {tok('t2')} AS cost FROM er)""",
                 "eq AS (SELECT id AS ques_id, f1, f2, f3, cost FROM feat WHERE NOT is_demo)",
                 "ed AS (SELECT id AS demo_id, f1, f2, f3, cost FROM feat WHERE is_demo)",
                 f"ep AS (SELECT q.ques_id, d.demo_id, {d3.format(a='q', b='d')} AS dist FROM eq q CROSS JOIN ed d)",
                 f"""kn AS (SELECT ques_id, demo_id FROM (SELECT ques_id, demo_id,
          row_number() OVER (PARTITION BY demo_id ORDER BY dist, ques_id) AS rk FROM ep WHERE dist <= {k1})
        WHERE rk <= {k})""",
                 "fq AS (SELECT q.* FROM eq q WHERE q.ques_id IN (SELECT ques_id FROM kn))",
                 f"""far AS (SELECT a.ques_id AS a, b.ques_id AS b FROM fq a JOIN fq b ON a.ques_id <> b.ques_id
        WHERE {linked})""",
                 """lab(id, l) USING KEY (id) AS (
  SELECT ques_id, ques_id FROM fq
  UNION
  SELECT far.b, min(lab.l) FROM lab JOIN far ON far.a = lab.id GROUP BY far.b
  HAVING min(lab.l) < (SELECT x.l FROM recurring.lab x WHERE x.id = far.b))""",
                 f"pall AS (SELECT {label}::BIGINT AS cluster_id, kn.demo_id, kn.ques_id FROM kn JOIN lab ON lab.id = kn.ques_id)",
                 """pset AS (SELECT p.cluster_id, p.demo_id, list(p.ques_id) AS qs, any_value(d.cost) AS cost
        FROM pall p JOIN ed d USING (demo_id) GROUP BY 1, 2)""",
                 f"""pdom AS (SELECT DISTINCT i.cluster_id, i.demo_id FROM pset i JOIN pset j ON j.cluster_id = i.cluster_id
        AND j.demo_id > i.demo_id AND j.cost <= i.cost AND list_has_all(j.qs, i.qs) WHERE {str(cfg.is_dominated).lower()})""",
                 "pcc AS (SELECT p.* FROM pall p ANTI JOIN pdom USING (cluster_id, demo_id))",
                 """psc AS (SELECT c.cluster_id, c.demo_id, list(c.ques_id) AS qs, min(d.cost) + sum(q.cost) AS cost
        FROM pcc c JOIN eq q USING (ques_id) JOIN ed d USING (demo_id) GROUP BY 1, 2)""",
                 """pg(cluster_id, step, covered, pick, score) AS (
  SELECT DISTINCT cluster_id, 0, []::BIGINT[], NULL::BIGINT, NULL::DOUBLE FROM psc
  UNION ALL
  SELECT g.cluster_id, g.step + 1, list_distinct(list_concat(g.covered, b.qs)), b.demo_id, b.score
  FROM pg g, LATERAL (SELECT s.demo_id, s.qs,
                          len(list_filter(s.qs, lambda x: NOT list_contains(g.covered, x))) / greatest(s.cost, 1) AS score
                   FROM psc s WHERE s.cluster_id = g.cluster_id ORDER BY score DESC, s.demo_id LIMIT 1) b
  WHERE b.score > 0)""",
                 "pp AS (SELECT cluster_id, pick AS demo_id, step FROM pg WHERE step > 0)",
                 balanced("pcc", "pp"),
                 "po AS (SELECT cluster_id, ques_id, arg_max(demo_id, step) AS demo_id FROM kept GROUP BY 1, 2)",
                 """pw AS (SELECT o.cluster_id, o.demo_id, any_value(d.cost) + sum(q.cost) AS weight
        FROM po o JOIN eq q USING (ques_id) JOIN ed d USING (demo_id) GROUP BY 1, 2)""",
                 "pi AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY weight DESC, demo_id) AS rn FROM pw)",
                 f"""pb(cluster_id, rn, loads, demo_id, weight, bin_no) AS (
  SELECT DISTINCT cluster_id, 0::BIGINT, []::DOUBLE[], NULL::BIGINT, NULL::BIGINT, NULL::INTEGER FROM pi
  UNION ALL
  SELECT b.cluster_id, b.rn + 1,
         CASE WHEN f.fit IS NULL THEN list_append(b.loads, i.weight::DOUBLE)
              ELSE list_transform(generate_series(1, len(b.loads)),
                                  lambda j: CASE WHEN j = f.fit THEN b.loads[j] + i.weight ELSE b.loads[j] END) END,
         i.demo_id, i.weight, (coalesce(f.fit, len(b.loads) + 1) - 1)::INTEGER
  FROM pb b JOIN pi i ON i.cluster_id = b.cluster_id AND i.rn = b.rn + 1,
  LATERAL (SELECT CASE WHEN list_max(fl) IS NULL THEN NULL ELSE list_position(fl, list_max(fl)) END AS fit
           FROM (SELECT list_transform(generate_series(1, len(b.loads)),
                 lambda j: CASE WHEN b.loads[j] + i.weight <= {cap} THEN b.loads[j] END) AS fl)) f)""",
                 """gq AS (SELECT b.cluster_id, b.bin_no, o.ques_id FROM pb b JOIN po o USING (cluster_id, demo_id)
        WHERE b.rn > 0)""",
                 """gd AS (SELECT cluster_id, bin_no, count(*) AS n_demo,
               string_agg(demo_id::VARCHAR, ',' ORDER BY demo_id) AS demo, sum(weight) AS tokens
        FROM pb WHERE rn > 0 GROUP BY 1, 2)""", recursive=True)


def _plan_groups_sql(cfg) -> str:
    """The groups of the plan."""
    from quire.functions.prompts import task_text_cost
    return _plan_ctes(cfg) + f"""
SELECT gd.cluster_id, gd.cluster_id::VARCHAR || '-' || gd.bin_no::VARCHAR AS group_id,
       count(gq.ques_id)::BIGINT AS n_ques, any_value(gd.n_demo)::BIGINT AS n_demo,
       string_agg(gq.ques_id::VARCHAR, ',' ORDER BY gq.ques_id) AS ques, any_value(gd.demo) AS demo,
       any_value(gd.tokens)::BIGINT AS tokens, any_value(gd.tokens) > {float(cfg.k2 - task_text_cost("er"))} AS over_budget
FROM gd JOIN gq USING (cluster_id, bin_no) GROUP BY gd.cluster_id, gd.bin_no"""


def _plan_objective_sql(cfg) -> str:
    """Tokens of the plan, counted from its questions and demos."""
    from quire.functions.prompts import task_text_cost
    t = task_text_cost("er")
    return _plan_ctes(cfg) + f"""
SELECT qt AS ques_tokens, dt AS demo_tokens, n * {t} AS task_tokens, (qt + dt + n * {t})::BIGINT AS objective
FROM (SELECT (SELECT sum(cost) FROM gq JOIN eq USING (ques_id))::BIGINT AS qt,
             (SELECT sum(cost) FROM pb JOIN ed USING (demo_id) WHERE rn > 0)::BIGINT AS dt,
             (SELECT count(*) FROM gd)::BIGINT AS n)"""


def _plan_violations_sql(cfg) -> str:
    """Every constraint on the plan, with its cover; neighbours by id whose answers differ are kept apart."""
    from quire.functions.prompts import task_text_cost
    return _plan_ctes(cfg) + f"""
SELECT 'question_repeated' AS "check", (SELECT count(*) FROM (SELECT ques_id FROM gq GROUP BY 1 HAVING count(*) > 1))::BIGINT AS n
UNION ALL SELECT 'question_unassigned', (SELECT count(*) FROM eq ANTI JOIN gq USING (ques_id))::BIGINT
UNION ALL SELECT 'under_covered', (SELECT count(*) FROM gq g WHERE NOT EXISTS (SELECT 1 FROM pb b JOIN pcc c
  ON c.demo_id = b.demo_id WHERE b.rn > 0 AND b.cluster_id = g.cluster_id AND b.bin_no = g.bin_no AND c.ques_id = g.ques_id))::BIGINT
UNION ALL SELECT 'over_budget', (SELECT count(*) FROM gd WHERE tokens + {task_text_cost("er")} > {cfg.k2})::BIGINT
UNION ALL SELECT 'forbidden_pair', (SELECT count(*) FROM gq a JOIN gq b ON b.cluster_id = a.cluster_id AND b.bin_no = a.bin_no
  AND b.ques_id = a.ques_id + 1 JOIN er x ON x.id = a.ques_id JOIN er y ON y.id = b.ques_id WHERE x.answer <> y.answer)::BIGINT
UNION ALL SELECT 'empty_group', (SELECT count(*) FROM gd ANTI JOIN gq USING (cluster_id, bin_no))::BIGINT"""


def _corr_parts() -> list[str]:
    """CTEs of the correlation clustering over node table ``gv(id)`` and edge table
    ``ge(src, dst, weight)``; the labels end in ``sp(id, l)``."""
    prop = ("{n}(id, l) USING KEY (id) AS (SELECT id, id FROM gv UNION "
            "SELECT {e}.b, min({n}.l) FROM {n} JOIN {e} ON {e}.a = {n}.id GROUP BY {e}.b "
            "HAVING min({n}.l) < (SELECT x.l FROM recurring.{n} x WHERE x.id = {e}.b))")
    return ["pe AS (SELECT src AS a, dst AS b FROM ge WHERE weight >= 0 UNION ALL SELECT dst, src FROM ge WHERE weight >= 0)",
            "sd(seed) AS (VALUES (0::BIGINT), (1::BIGINT), (2::BIGINT))",
            """pr AS (SELECT sd.seed, gv.id, row_number() OVER (PARTITION BY sd.seed
          ORDER BY md5(sd.seed::VARCHAR || ':' || gv.id::VARCHAR), gv.id) AS rn FROM sd CROSS JOIN gv)""",
            """pv(seed, rn, clustered, piv, members) AS (
  SELECT seed, 0::BIGINT, []::BIGINT[], NULL::BIGINT, []::BIGINT[] FROM sd
  UNION ALL
  SELECT p.seed, p.rn + 1,
         CASE WHEN list_contains(p.clustered, x.id) THEN p.clustered ELSE list_concat(p.clustered, m.mem) END,
         CASE WHEN list_contains(p.clustered, x.id) THEN NULL ELSE x.id END,
         CASE WHEN list_contains(p.clustered, x.id) THEN []::BIGINT[] ELSE m.mem END
  FROM pv p JOIN pr x ON x.seed = p.seed AND x.rn = p.rn + 1,
  LATERAL (SELECT list_prepend(x.id, coalesce(list(e.b) FILTER (WHERE NOT list_contains(p.clustered, e.b)),
                                              []::BIGINT[])) AS mem FROM pe e WHERE e.a = x.id) m)""",
            "pl AS (SELECT seed, unnest(members) AS id, piv FROM pv WHERE piv IS NOT NULL)",
            prop.format(n="ccl", e="pe"),
            """runs AS (SELECT seed, id, min(id) OVER (PARTITION BY seed, piv) AS cluster_id FROM pl
        UNION ALL SELECT -1::BIGINT, id, l FROM ccl)""",
            """ls AS (SELECT r1.seed, sum(CASE WHEN ge.weight >= 0 AND r1.cluster_id <> r2.cluster_id THEN ge.weight
          WHEN ge.weight < 0 AND r1.cluster_id = r2.cluster_id THEN abs(ge.weight) ELSE 0 END) AS loss
        FROM ge JOIN runs r1 ON r1.id = ge.src JOIN runs r2 ON r2.id = ge.dst AND r2.seed = r1.seed GROUP BY r1.seed)""",
            """best AS (SELECT seed FROM (SELECT DISTINCT seed FROM runs) r LEFT JOIN ls USING (seed)
        ORDER BY coalesce(loss, 0), seed LIMIT 1)""",
            "ch AS (SELECT r.id, r.cluster_id FROM runs r JOIN best USING (seed))",
            """se AS (SELECT pe.a, pe.b FROM pe JOIN ch c1 ON c1.id = pe.a JOIN ch c2 ON c2.id = pe.b
        WHERE c1.cluster_id = c2.cluster_id)""",
            prop.format(n="sp", e="se")]


def _corr_cluster_sql() -> str:
    """Correlation clustering of ``catalog.corr_cluster``: the sequential pivot algorithm per
    seed (priority md5('seed:id')), the component clustering as one more candidate, the
    smallest linear loss (ties: lowest seed), then split into positive components."""
    return _with(GRAPH, *_corr_parts(), recursive=True) + "SELECT id, l AS cluster_id FROM sp"


def _extra_round(r: int, prev_demos: str) -> list[str]:
    """CTEs of extra-cover round ``r`` (C4) given the group demos so far (``prev_demos``)."""
    stopped = " UNION ALL ".join(f"SELECT group_id FROM stop{i}" for i in range(1, r)) or \
        "SELECT NULL::VARCHAR AS group_id WHERE false"
    return [
        f"""open{r} AS (SELECT n.group_id, n.nq, d.nd FROM gnq n
        JOIN (SELECT group_id, any_value(cluster_id) AS cluster_id, count(*) AS nd FROM {prev_demos} GROUP BY 1) d
          USING (group_id)
        JOIN gncd USING (cluster_id)
        WHERE d.nd <> gncd.ncd AND n.group_id NOT IN ({stopped}))""",
        f"""c{r} AS (SELECT gq.group_id, cc.demo_id, list(gq.ques_id) AS qs, any_value(s.cost) AS cost
        FROM gq JOIN open{r} USING (group_id)
        JOIN cc ON cc.cluster_id = gq.cluster_id AND cc.ques_id = gq.ques_id
        JOIN sc s ON s.cluster_id = cc.cluster_id AND s.demo_id = cc.demo_id
        WHERE NOT EXISTS (SELECT 1 FROM {prev_demos} x WHERE x.group_id = gq.group_id AND x.demo_id = cc.demo_id)
        GROUP BY gq.group_id, cc.demo_id)""",
        f"""ok{r} AS (SELECT o.group_id FROM open{r} o
        JOIN (SELECT group_id, count(DISTINCT q) AS nc FROM (SELECT group_id, unnest(qs) AS q FROM c{r}) GROUP BY 1) k
          USING (group_id) WHERE k.nc = o.nq)""",
        f"""r{r}(group_id, step, covered, pick) AS (
  SELECT group_id, 0, []::BIGINT[], NULL::BIGINT FROM ok{r}
  UNION ALL
  SELECT g.group_id, g.step + 1, list_distinct(list_concat(g.covered, b.qs)), b.demo_id
  FROM r{r} g, LATERAL (SELECT c.demo_id, c.qs,
                          len(list_filter(c.qs, lambda x: NOT list_contains(g.covered, x))) / greatest(c.cost, 1) AS score
                   FROM c{r} c WHERE c.group_id = g.group_id ORDER BY score DESC, c.demo_id LIMIT 1) b
  WHERE b.score > 0)""",
        f"""a{r} AS (SELECT g.group_id, g.pick AS demo_id, {r} AS extra_round, g.step AS pick_no
        FROM r{r} g JOIN open{r} o USING (group_id) WHERE g.step > 0 AND g.step <= greatest(o.nq - o.nd, 1))""",
        f"""stop{r} AS (SELECT a.group_id FROM a{r} a JOIN open{r} o USING (group_id)
        GROUP BY a.group_id, o.nq, o.nd HAVING o.nd + count(*) >= o.nq)""",
    ]


def _group_extra_demos_sql() -> str:
    return _with(VEC, GREEDY,
                 """g0 AS (SELECT cluster_id, cluster_id::VARCHAR || '-' || bin_no::VARCHAR AS group_id, demo_id
        FROM bins WHERE rn > 0)""",
                 "gq AS (SELECT g0.cluster_id, g0.group_id, o.ques_id FROM g0 JOIN owner o USING (cluster_id, demo_id))",
                 "gnq AS (SELECT group_id, count(*) AS nq FROM gq GROUP BY 1)",
                 "gncd AS (SELECT cluster_id, count(DISTINCT demo_id) AS ncd FROM cc GROUP BY 1)",
                 *_extra_round(1, "g0"),
                 """g1 AS (SELECT cluster_id, group_id, demo_id FROM g0
        UNION ALL SELECT g0x.cluster_id, a1.group_id, a1.demo_id FROM a1
        JOIN (SELECT DISTINCT cluster_id, group_id FROM g0) g0x USING (group_id))""",
                 *_extra_round(2, "g1"), recursive=True) + """
SELECT group_id, demo_id, extra_round::INTEGER AS extra_round, pick_no::INTEGER AS pick_no FROM a1
UNION ALL SELECT group_id, demo_id, extra_round::INTEGER, pick_no::INTEGER FROM a2"""


def _refined_sql() -> str:
    """The local search of ``catalog.corr_cluster_refined``, round by round, from the labels of ``corr_cluster``."""
    return _with(GRAPH, *_corr_parts(),
                 "und AS (SELECT src AS u, dst AS v, weight FROM ge WHERE weight <> 0 UNION ALL SELECT dst, src, weight FROM ge WHERE weight <> 0)",
                 """st(rnd, id, l) AS (
  SELECT 0, id, l FROM sp
  UNION ALL
  SELECT rnd + 1, id, min(id) OVER (PARTITION BY fresh, c) FROM (
    WITH pull AS (SELECT und.u, o.l AS own, x.l AS c, round(sum(und.weight), 9) AS s FROM und JOIN st x ON x.id = und.v JOIN st o ON o.id = und.u GROUP BY 1, 2, 3),
    best AS (SELECT u, coalesce(max(s) FILTER (WHERE c = own), 0) AS stay, max(s) FILTER (WHERE c <> own AND s > 0) AS go FROM pull GROUP BY u),
    wish AS (SELECT b.u, round(coalesce(go, 0) - stay, 9) AS gain, (SELECT min(p.c) FROM pull p WHERE p.u = b.u AND p.c <> p.own AND p.s = b.go) AS dest
             FROM best b WHERE round(coalesce(go, 0) - stay, 9) > 0),
    moves AS (SELECT w.u, w.dest FROM wish w WHERE NOT EXISTS (SELECT 1 FROM und JOIN wish o ON o.u = und.v
              WHERE und.u = w.u AND (o.gain > w.gain OR (o.gain = w.gain AND o.u < w.u))))
    SELECT st.rnd, st.id, m.u IS NOT NULL AND m.dest IS NULL AS fresh, CASE WHEN m.u IS NULL THEN st.l ELSE coalesce(m.dest, m.u) END AS c
    FROM st LEFT JOIN moves m ON m.u = st.id WHERE EXISTS (SELECT 1 FROM moves)))""", recursive=True) + \
        "SELECT id, l AS cluster_id FROM st WHERE rnd = (SELECT max(rnd) FROM st)"


def _lower_bound_sql(cfg) -> str:
    """The dual ascent of ``reports.cover_lower_bound``, round by round, beside the plan's objective."""
    from quire.functions.prompts import task_text_cost
    t = task_text_cost("er")
    ctes = [_plan_ctes(cfg).rstrip(), "le AS (SELECT DISTINCT ques_id, demo_id FROM kn WHERE ques_id IN (SELECT ques_id FROM gq))",
            "sl0 AS (SELECT demo_id, cost::DOUBLE AS slack FROM ed WHERE demo_id IN (SELECT demo_id FROM le))", "ri0 AS (SELECT * FROM le)"]
    for r in range(1, BOUND_ROUNDS + 1):
        p = r - 1
        ctes += [f"sh{r} AS (SELECT demo_id, any_value(slack) / count(*) AS share FROM ri{p} JOIN sl{p} USING (demo_id) GROUP BY demo_id)",
                 f"up{r} AS MATERIALIZED (SELECT ques_id, min(share) AS up FROM ri{p} JOIN sh{r} USING (demo_id) GROUP BY ques_id)",
                 f"pa{r} AS (SELECT demo_id, sum(up) AS paid FROM ri{p} JOIN up{r} USING (ques_id) GROUP BY demo_id)",
                 f"sl{r} AS MATERIALIZED (SELECT demo_id, greatest(0.0, round(slack - coalesce(paid, 0), 9)) AS slack FROM sl{p} LEFT JOIN pa{r} USING (demo_id))",
                 f"""ri{r} AS MATERIALIZED (SELECT * FROM ri{p} WHERE ques_id NOT IN
        (SELECT ques_id FROM le JOIN sl{r} USING (demo_id) WHERE slack <= 1e-6))"""]
    bound = " + ".join(f"coalesce((SELECT sum(up) FROM up{r}), 0)" for r in range(1, BOUND_ROUNDS + 1))
    return ",\n".join(ctes) + f"""
SELECT qt AS ques_tokens, round(db, 4) AS demo_bound, tb AS task_bound, round(qt + db + tb, 4) AS lower_bound, objective,
       round((objective - (qt + db + tb)) / objective, 6) AS gap
FROM (SELECT *, (ceil((qt + db) / {float(cfg.k2 - t)}) * {t})::BIGINT AS tb
      FROM (SELECT (SELECT sum(cost) FROM (SELECT DISTINCT ques_id FROM gq) JOIN eq USING (ques_id))::BIGINT AS qt, {bound} AS db,
                   ((SELECT sum(cost) FROM gq JOIN eq USING (ques_id)) + (SELECT sum(cost) FROM pb JOIN ed USING (demo_id) WHERE rn > 0)
                    + (SELECT count(*) FROM gd) * {t})::BIGINT AS objective))"""


def _manhattan_sql() -> str:
    feat = f"""feat AS (SELECT id, is_demo, {lcs_ratio('n1', 'n2')} AS f1, {lcs_ratio('b1', 'b2')} AS f2, {lcs_ratio('t1', 't2')} AS f3 FROM er)"""
    return _with(ER, feat, """mp AS (SELECT q.id AS ques_id, d.id AS demo_id, abs(q.f1 - d.f1) + abs(q.f2 - d.f2) + abs(q.f3 - d.f3) AS dist
        FROM feat q JOIN feat d ON NOT q.is_demo AND d.is_demo)""") + \
        f"SELECT ques_id, demo_id, round(dist, 6) AS dist FROM mp WHERE dist <= {MANHATTAN_R}"


def _plan_groups_code_sql() -> str:
    """``catalog.plan_groups_code``: clusters of at least ``min_cluster_size`` questions, then the plan with one cluster."""
    from quire.functions.prompts import task_text_cost
    first, rest = VEC_BASE.split("\n", 1)
    kept = f"""vq AS (SELECT * FROM vq0 WHERE ques_id IN (SELECT id FROM lab0 JOIN (SELECT l, count(*) AS n FROM lab0 GROUP BY l) USING (l)
        WHERE n >= {CODE_CFG.min_cluster_size})),"""
    base = first.replace("vq AS", "vq0 AS", 1) + f"""
qe0 AS (SELECT a.ques_id AS a, b.ques_id AS b FROM vq0 a JOIN vq0 b ON a.ques_id <> b.ques_id WHERE list_distance(a.v, b.v) <= {CODE_CFG.k0}),
reach0(id, r) AS (SELECT ques_id, ques_id FROM vq0 UNION SELECT u.b, reach0.r FROM reach0 JOIN qe0 u ON u.a = reach0.id),
lab0 AS (SELECT id, min(r) AS l FROM reach0 GROUP BY id),
""" + kept + "\n" + rest
    return _plan_groups_cover_sql(base, [], "cov.ques_id, 0::BIGINT AS cluster_id, cov.demo_id FROM cov", float(CODE_CFG.k2 - task_text_cost("code")))


def _plan_groups_corr_sql(attracts: str = f"<= {EPS_SIM}") -> str:
    """``catalog.plan_groups_corr`` and ``plan_groups_corr_diverse``: QA task on VEC -- kNN filter, threshold cover among the
    kept rows, correlation clustering of the full signed graph (+1 near, -1 beyond eps),
    sequential greedy per cluster, balancing pass, last holder, best-fit-decreasing, two rounds of extra covers, groups."""
    from quire.functions.prompts import task_text_cost
    labels = ["gv AS (SELECT ques_id AS id, v FROM vq WHERE ques_id IN (SELECT ques_id FROM fq))",
              f"""ge AS (SELECT a.id AS src, b.id AS dst, CASE WHEN {cos('a.v', 'b.v')} {attracts} THEN 1.0 ELSE -1.0 END AS weight
        FROM gv a JOIN gv b ON a.id < b.id)""", *_corr_parts()]
    return _plan_groups_cover_sql(VEC_BASE, labels, "sp.l AS cluster_id, cov.demo_id, cov.ques_id FROM cov JOIN sp ON sp.id = cov.ques_id",
                                  float(140 - task_text_cost("qa")))


def _plan_groups_cover_sql(base: str, labels: list[str], cc: str, cap: float) -> str:
    """A plan on VEC from its kNN filter on, with two rounds of extra covers; ``cc``: the cover with clusters."""
    return _with(base,
                 "fq AS (SELECT DISTINCT ques_id FROM knn)",
                 "fd AS (SELECT DISTINCT demo_id FROM knn)",
                 f"""cov AS (SELECT ques_id, demo_id FROM vp WHERE cdist <= {VEC_K1}
        AND ques_id IN (SELECT ques_id FROM fq) AND demo_id IN (SELECT demo_id FROM fd))""",
                 *labels,
                 f"cc AS (SELECT {cc})",
                 greedy(cap, OWNER_BALANCED),
                 """g0 AS (SELECT cluster_id, cluster_id::VARCHAR || '-' || bin_no::VARCHAR AS group_id, demo_id
        FROM bins WHERE rn > 0)""",
                 "gq AS (SELECT g0.cluster_id, g0.group_id, o.ques_id FROM g0 JOIN owner o USING (cluster_id, demo_id))",
                 "gnq AS (SELECT group_id, count(*) AS nq FROM gq GROUP BY 1)",
                 "gncd AS (SELECT cluster_id, count(DISTINCT demo_id) AS ncd FROM cc GROUP BY 1)",
                 *_extra_round(1, "g0"),
                 """g1 AS (SELECT cluster_id, group_id, demo_id FROM g0
        UNION ALL SELECT g0x.cluster_id, a1.group_id, a1.demo_id FROM a1
        JOIN (SELECT DISTINCT cluster_id, group_id FROM g0) g0x USING (group_id))""",
                 *_extra_round(2, "g1"),
                 """gall AS (SELECT DISTINCT group_id, demo_id FROM (SELECT group_id, demo_id FROM g1
        UNION ALL SELECT group_id, demo_id FROM a2))""", recursive=True) + f"""
SELECT t.cluster_id, t.group_id, qn.n_ques, dn.n_demo, qn.ques, dn.demo, t.tokens::BIGINT AS tokens,
       t.tokens > {cap} AS over_budget
FROM (SELECT cluster_id, cluster_id::VARCHAR || '-' || bin_no::VARCHAR AS group_id, sum(weight) AS tokens
      FROM bins WHERE rn > 0 GROUP BY 1, 2) t
JOIN (SELECT group_id, count(*)::BIGINT AS n_ques, string_agg(ques_id::VARCHAR, ',' ORDER BY ques_id) AS ques
      FROM gq GROUP BY 1) qn USING (group_id)
JOIN (SELECT group_id, count(*)::BIGINT AS n_demo, string_agg(demo_id::VARCHAR, ',' ORDER BY demo_id) AS demo
      FROM gall GROUP BY 1) dn USING (group_id)"""


def _assign_balanced_sql() -> str:
    """``catalog.assign_balanced``: the balancing pass over the greedy picks, then the latest holder."""
    return _with(VEC, greedy(60.0, OWNER_BALANCED), recursive=True) + "SELECT cluster_id, ques_id, demo_id FROM owner"


def oracle_sql() -> dict[str, str]:
    e1, e2 = _ent("n1", "b1", "t1"), _ent("n2", "b2", "t2")
    q: dict[str, str] = {}
    q["scan_pairs"] = _with(ER) + f"""SELECT id, is_demo, answer,
  ({tok('n1')} + {tok('b1')} + {tok('t1')} + {tok('n2')} + {tok('b2')} + {tok('t2')})::INTEGER AS cost,
  {e1} AS e1_text, {e2} AS e2_text FROM er"""
    q["render_entity"] = _with(ER) + f"SELECT id, {e1} AS e1_text, {e2} AS e2_text FROM er"
    q["token_cost"] = (f"SELECT 'ques' AS role, doc_id AS id, {tok('text')}::INTEGER AS cost FROM documents "
                       f"UNION ALL SELECT 'demo', item_id, {tok('text')}::INTEGER FROM benchmark")
    q["field_similarity"] = _with(ER) + f"""SELECT id, 'name' AS attr, round({lcs_ratio('n1', 'n2')}, 6) AS ratio FROM er
UNION ALL SELECT id, 'brand', round({lcs_ratio('b1', 'b2')}, 6) FROM er
UNION ALL SELECT id, 'type', round({lcs_ratio('t1', 't2')}, 6) FROM er"""
    q["pair_features"] = _with(ER) + f"""SELECT id, round({lcs_ratio('n1', 'n2')}, 6) AS f_name,
  round({lcs_ratio('b1', 'b2')}, 6) AS f_brand, round({lcs_ratio('t1', 't2')}, 6) AS f_type FROM er"""

    q["pair_features_distinct"] = q["pair_features"]
    q["jsonl_pairs"] = f"""SELECT row_number() OVER (ORDER BY id) - 1 AS ques_id, answer, cost, e1_text, e2_text
FROM ({q["scan_pairs"]})"""
    q["jsonl_texts"] = f"""SELECT row_number() OVER (ORDER BY doc_id) - 1 AS ques_id, source AS table_name, lang AS answer,
  {tok('text')}::INTEGER AS cost, md5(text) AS text_md5 FROM documents"""
    q["parquet_texts"] = f"""SELECT doc_id AS ques_id, 'qa' AS task, 'StrategyQA' AS dataset, lang AS answer,
  {tok('text')}::INTEGER AS cost, md5(text) AS text_md5 FROM documents"""

    q["pair_dist_euclid"] = _with(VEC) + f"SELECT ques_id, demo_id, round(edist, 6) AS dist FROM vp WHERE edist <= {EUC_R}"
    q["pair_dist_cosine"] = _with(VEC) + f"SELECT ques_id, demo_id, round(cdist, 6) AS dist FROM vp WHERE cdist <= {VEC_K1}"
    q["pair_dist_recip"] = _with(VEC) + (f"SELECT ques_id, demo_id, round(CASE WHEN edist = 0 THEN 0 ELSE 1 / edist END, 6)"
                                         f" AS recip FROM vp WHERE edist <= {EUC_R}")
    q["self_dist"] = _with(VEC) + f"""SELECT a.ques_id AS q1, b.ques_id AS q2, round(list_distance(a.v, b.v), 6) AS dist
FROM vq a JOIN vq b ON a.ques_id < b.ques_id WHERE list_distance(a.v, b.v) <= {EUC_R}"""
    q["knn_cover"] = _with(VEC) + "SELECT ques_id, demo_id, round(dist, 6) AS dist, rank::INTEGER AS rank FROM knn"
    q["knn_topk3"] = _with(VEC) + """SELECT demo_id, ques_id, round(cdist, 6) AS dist, rank::INTEGER AS rank FROM (
  SELECT demo_id, ques_id, cdist, row_number() OVER (PARTITION BY demo_id ORDER BY cdist, ques_id) AS rank FROM vp)
WHERE rank <= 3"""
    q["cover_threshold"] = _with(VEC) + "SELECT demo_id, count(*)::BIGINT AS n_ques FROM vp WHERE cdist <= 0.75 GROUP BY demo_id"
    q["topup_cover"] = _with(VEC, "have AS (SELECT ques_id, count(*) AS h FROM knn GROUP BY ques_id)",
                             """fresh AS (SELECT vp.ques_id, vp.demo_id, vp.cdist AS dist,
          row_number() OVER (PARTITION BY vp.ques_id ORDER BY vp.cdist, vp.demo_id) AS r
        FROM vp WHERE NOT EXISTS (SELECT 1 FROM knn k WHERE k.ques_id = vp.ques_id AND k.demo_id = vp.demo_id))""") + f"""
SELECT ques_id, demo_id, round(dist, 6) AS dist FROM knn
UNION ALL
SELECT f.ques_id, f.demo_id, round(f.dist, 6) FROM fresh f LEFT JOIN have h USING (ques_id)
WHERE f.r <= {COVER_CNT} - coalesce(h.h, 0)"""
    q["filter_candidates"] = _with(VEC) + """SELECT 'ques' AS role, ques_id AS id FROM (SELECT DISTINCT ques_id FROM knn)
UNION ALL SELECT 'demo', demo_id FROM (SELECT DISTINCT demo_id FROM knn)"""
    q["filter_demos_topk"] = _with(VEC) + "SELECT DISTINCT demo_id FROM knn"
    q["filter_demos_within"] = _with(VEC) + f"SELECT DISTINCT demo_id FROM vp WHERE cdist <= {VEC_K1}"
    q["group_coverage"] = _with(VEC) + f"""SELECT ques_id // 40 AS group_id, demo_id, count(*)::BIGINT AS n_ques,
  string_agg(ques_id::VARCHAR, ',' ORDER BY ques_id) AS ques FROM vp WHERE cdist <= {VEC_K1} GROUP BY 1, 2"""
    q["pivot_join"] = _with(VEC) + f"SELECT ques_id, demo_id, round(edist, 6) AS dist FROM vp WHERE edist <= {PIVOT_R}"
    q["pair_dist_tree"] = q["pair_dist_euclid"]
    q["lsh_recall"] = _with(GRAPH_BASE) + f"""SELECT count(*) FILTER (WHERE d <= {LSH_R})::BIGINT AS n_exact, 0::BIGINT AS n_outside, true AS recall_ok FROM gp"""
    q["pivot_prune_stats"] = _with(VEC, """pv AS (SELECT ques_id AS pid, v AS pv FROM vq WHERE ques_id = (SELECT min(ques_id) FROM vq)),
pq AS (SELECT ques_id, list_distance(v, pv) AS x FROM vq, pv WHERE ques_id <> pid), pd AS (SELECT list_distance(v, pv) AS y FROM vd, pv),
qs AS (SELECT *, count(*) OVER (ORDER BY x RANGE BETWEEN 0 PRECEDING AND """ + f"{BAND_K0}" + """ FOLLOWING) - 1 AS after,
              row_number() OVER (PARTITION BY x) - 1 AS tied FROM pq)""") + f"""SELECT (SELECT count(*) FROM vq)::BIGINT AS n_left,
  (SELECT count(*) FROM vd)::BIGINT AS n_right, ((SELECT count(*) FROM vq) * (SELECT count(*) FROM vd))::BIGINT AS n_full,
  (SELECT count(*) FROM vp WHERE edist <= {PIVOT_R})::BIGINT AS n_within,
  (SELECT count(*) * (count(*) - 1) // 2 FROM vq)::BIGINT AS n_self_full,
  (SELECT count(*) + sum(after - tied) FROM qs)::BIGINT AS n_self_compared,
  ((SELECT count(*) FROM vq) * (SELECT count(*) FROM vd))::BIGINT AS n_cross_full,
  ((SELECT count(*) FROM vd) + (SELECT count(*) FROM pq JOIN pd ON y >= x - {BAND_K1} AND y <= x + {BAND_K1}))::BIGINT AS n_cross_compared"""
    q["eps_edges"] = _with(GRAPH) + f"SELECT src, dst, round(d, 6) AS dist FROM gp WHERE d <= {EPS_SIM}"
    q["dist_percentile"] = _with(VEC) + f"SELECT ques_id, round(quantile_cont(cdist, {PCT}), 6) AS pct FROM vp GROUP BY ques_id"
    q["dist_percentile_q25"] = _with(VEC) + f"SELECT ques_id, round(quantile_cont(cdist, {QUARTER}), 6) AS pct FROM vp GROUP BY ques_id"
    q["cover_percentile"] = _with(VEC, f"""thr AS (SELECT max(p) AS t FROM (SELECT quantile_cont(cdist, {PCT}) AS p
        FROM vp GROUP BY ques_id))""") + "SELECT ques_id, demo_id, round(cdist, 6) AS dist FROM vp, thr WHERE cdist <= thr.t"

    q["demo_coverage"] = _with(VEC) + """SELECT cluster_id, demo_id, count(*)::BIGINT AS n_ques,
  string_agg(ques_id::VARCHAR, ',' ORDER BY ques_id) AS ques FROM cc GROUP BY 1, 2"""
    q["cover_cost"] = _with(VEC) + """SELECT cc.cluster_id, cc.demo_id, (min(10 + d.label) + sum(10 + q.label))::BIGINT AS set_cost
FROM cc JOIN vq q USING (ques_id) JOIN vd d USING (demo_id) GROUP BY 1, 2"""
    q["cover_overlap"] = _with(VEC, "mult AS (SELECT cluster_id, ques_id, count(*) AS mult FROM cc GROUP BY 1, 2)",
                               """top AS (SELECT cluster_id, ques_id AS top_ques FROM (SELECT *, row_number() OVER
          (PARTITION BY cluster_id ORDER BY mult DESC, ques_id) AS rn FROM mult) WHERE rn = 1)""",
                               "pq AS (SELECT cluster_id, count(*) AS n_ques, max(mult) AS max_mult FROM mult GROUP BY 1)",
                               "pd AS (SELECT cluster_id, count(DISTINCT demo_id) AS n_sets FROM cc GROUP BY 1)") + """
SELECT pq.cluster_id, n_ques::BIGINT AS n_ques, n_sets::BIGINT AS n_sets, floor(n_ques / n_sets)::BIGINT AS avg_size,
       max_mult::BIGINT AS max_mult, top_ques FROM pq JOIN pd USING (cluster_id) JOIN top USING (cluster_id)"""
    q["cluster_demos"] = _with(VEC) + "SELECT DISTINCT cluster_id, demo_id FROM cc"
    q["uncovered_questions"] = _with(VEC) + "SELECT ques_id, 'no_demo' AS reason FROM vq WHERE ques_id NOT IN (SELECT ques_id FROM knn)"
    q["dominated_demos"] = _with(VEC, "sets AS (SELECT DISTINCT cluster_id, demo_id FROM cc)",
                                 "cst AS (SELECT demo_id, 10 + label AS c FROM vd)") + """
SELECT DISTINCT i.cluster_id, i.demo_id FROM sets i JOIN cst ci ON ci.demo_id = i.demo_id
WHERE EXISTS (SELECT 1 FROM sets j JOIN cst cj ON cj.demo_id = j.demo_id
  WHERE j.cluster_id = i.cluster_id AND j.demo_id > i.demo_id AND cj.c <= ci.c
    AND NOT EXISTS (SELECT 1 FROM cc x WHERE x.cluster_id = i.cluster_id AND x.demo_id = i.demo_id
        AND NOT EXISTS (SELECT 1 FROM cc y WHERE y.cluster_id = i.cluster_id AND y.demo_id = j.demo_id
                        AND y.ques_id = x.ques_id)))"""

    q["components"] = _with(GRAPH, "pe AS (SELECT src, dst FROM ge WHERE weight >= 0)",
                            "und AS (SELECT src AS a, dst AS b FROM pe UNION ALL SELECT dst, src FROM pe)",
                            reach("gv", "und"), recursive=True) + "SELECT id, min(r) AS cluster_id FROM reach GROUP BY id"
    sim_edges = (f"qe AS (SELECT a.ques_id AS a, b.ques_id AS b FROM vq a JOIN vq b ON a.ques_id <> b.ques_id "
                 f"WHERE {cos('a.v', 'b.v')} <= {EPS_SIM})")
    qn = "qnodes AS (SELECT ques_id AS id FROM vq)"
    sim = _with(VEC, sim_edges, qn, reach("qnodes", "qe"), recursive=True)
    sim_lab = "lab AS (SELECT id, min(r) AS cluster_id FROM reach GROUP BY id)"
    q["cluster_similar"] = sim + "SELECT id, min(r) AS cluster_id FROM reach GROUP BY id"
    q["cluster_diverse"] = _with(VEC, f"""qe AS (SELECT a.ques_id AS a, b.ques_id AS b FROM vq a JOIN vq b ON a.ques_id <> b.ques_id
        WHERE list_distance(a.v, b.v) = 0 OR 1.0 / list_distance(a.v, b.v) <= {K0_DIV})""", qn,
                                 reach("qnodes", "qe"), recursive=True) + \
        "SELECT id, min(r) AS cluster_id FROM reach GROUP BY id"
    q["corr_cluster_refined"] = _refined_sql()
    q["plan_lower_bound"] = _lower_bound_sql(ER_CFG)
    q["pair_dist_manhattan"] = _manhattan_sql()
    q["plan_groups_code"] = _plan_groups_code_sql()
    q["cluster_diverse_dense"] = _with(VEC, f"""qe AS (SELECT a.ques_id AS a, b.ques_id AS b FROM vq a JOIN vq b ON a.ques_id <> b.ques_id
        WHERE list_distance(a.v, b.v) = 0 OR 1.0 / list_distance(a.v, b.v) <= {K0_DENSE})""",
                                       """lab(id, l) USING KEY (id) AS (SELECT ques_id, ques_id FROM vq UNION
        SELECT qe.b, min(lab.l) FROM lab JOIN qe ON qe.a = lab.id GROUP BY qe.b
        HAVING min(lab.l) < (SELECT x.l FROM recurring.lab x WHERE x.id = qe.b))""", recursive=True) + "SELECT id, l AS cluster_id FROM lab"
    q["cluster_stats"] = _with(VEC, sim_edges, qn, reach("qnodes", "qe"), sim_lab,
                               "sz AS (SELECT cluster_id, count(*) AS size FROM lab GROUP BY 1)", recursive=True) + \
        """SELECT count(*)::BIGINT AS n_clusters, sum(size)::BIGINT AS n_points, max(size)::BIGINT AS max_size,
  count(*) FILTER (WHERE size = 1)::BIGINT AS n_singletons FROM sz"""
    q["cluster_size_filter"] = _with(VEC, sim_edges, qn, reach("qnodes", "qe"), sim_lab,
                                     "sz AS (SELECT cluster_id, count(*) AS size FROM lab GROUP BY 1)", recursive=True) + \
        "SELECT id, cluster_id FROM lab JOIN sz USING (cluster_id) WHERE size > 2"
    q["clusters_by_size"] = _with(VEC, sim_edges, qn, reach("qnodes", "qe"), sim_lab, recursive=True) + \
        "SELECT cluster_id, count(*)::BIGINT AS size, min(id) AS min_member FROM lab GROUP BY 1 ORDER BY size DESC, min_member"
    q["cluster_random"] = _with(VEC) + "SELECT DISTINCT ques_id AS id, 0::BIGINT AS cluster_id FROM knn"
    q["affinity_edges"] = _with(VEC) + f"""SELECT a.ques_id AS src, b.ques_id AS dst,
  CASE WHEN list_distance(a.v, b.v) >= {K0_AFF} THEN 1.0 ELSE -1.0 END::DOUBLE AS weight
FROM vq a JOIN vq b ON a.ques_id < b.ques_id WHERE list_distance(a.v, b.v) <= {AFF_R}"""
    q["edge_transform"] = _with(GRAPH) + "SELECT src, dst, round(abs(weight) * 10, 6) AS weight FROM ge"
    q["label_nodes"] = _with(GRAPH, "pe AS (SELECT src, dst FROM ge WHERE weight >= 0)",
                             "und AS (SELECT src AS a, dst AS b FROM pe UNION ALL SELECT dst, src FROM pe)",
                             "touched AS (SELECT DISTINCT a AS id FROM und)", reach("touched", "und"),
                             recursive=True) + """SELECT gv.id, coalesce(l.c, -1)::BIGINT AS cluster_id FROM gv
LEFT JOIN (SELECT id, min(r) AS c FROM reach GROUP BY id) l USING (id)"""
    q["clusters_without_noise"] = _with(GRAPH, "pe AS (SELECT src, dst FROM ge WHERE weight >= 0)",
                                        "und AS (SELECT src AS a, dst AS b FROM pe UNION ALL SELECT dst, src FROM pe)",
                                        "tn AS (SELECT DISTINCT a AS id FROM und)", reach("tn", "und"),
                                        "lab AS (SELECT id, min(r) AS c FROM reach GROUP BY id)", recursive=True) + \
        "SELECT c AS cluster_id, count(*)::BIGINT AS size, min(id) AS min_member FROM lab GROUP BY c"
    q["components_non_value"] = _with(GRAPH, f"pe AS (SELECT src, dst FROM ge WHERE weight >= 0 AND NOT weight < {WEAK_EDGE})",
                                      "und AS (SELECT src AS a, dst AS b FROM pe UNION ALL SELECT dst, src FROM pe)",
                                      reach("gv", "und"), recursive=True) + "SELECT id, min(r) AS cluster_id FROM reach GROUP BY id"
    q["split_clusters"] = _with(GRAPH, """pe AS (SELECT ge.src, ge.dst FROM ge JOIN gv a ON a.id = ge.src JOIN gv b ON b.id = ge.dst
        WHERE ge.weight >= 0 AND a.label = b.label)""",
                                "und AS (SELECT src AS a, dst AS b FROM pe UNION ALL SELECT dst, src FROM pe)",
                                reach("gv", "und"), recursive=True) + \
        "SELECT id, min(r) AS cluster_id FROM reach GROUP BY id"
    st = "st AS (SELECT ge.*, a.label AS cs, b.label AS cd FROM ge JOIN gv a ON a.id = ge.src JOIN gv b ON b.id = ge.dst)"
    q["corr_loss_linear"] = _with(GRAPH, st) + """SELECT round(coalesce(sum(CASE WHEN weight >= 0 AND cs <> cd THEN weight
  WHEN weight < 0 AND cs = cd THEN abs(weight) ELSE 0 END), 0), 6) AS loss FROM st"""
    q["corr_loss_binary"] = _with(GRAPH, st) + """SELECT round((count(*) FILTER (WHERE weight >= 0 AND cs <> cd)
  + count(*) FILTER (WHERE weight < 0 AND cs = cd))::DOUBLE, 6) AS loss FROM st"""
    q["corr_loss_poles"] = _with(GRAPH, st) + """SELECT round((count(*) FILTER (WHERE weight < 0 AND cs = cd)
  + count(*) FILTER (WHERE weight >= 0 AND cs <> cd))::DOUBLE, 6) AS loss FROM st"""
    q["corr_best"] = _with(GRAPH, """runs AS (SELECT 0::BIGINT AS seed, id, label::BIGINT AS c FROM gv
        UNION ALL SELECT 1, id, label % 2 FROM gv UNION ALL SELECT 2, id, label % 3 FROM gv)""",
                           """ls AS (SELECT r1.seed, sum(CASE WHEN ge.weight >= 0 AND r1.c <> r2.c THEN ge.weight
          WHEN ge.weight < 0 AND r1.c = r2.c THEN abs(ge.weight) ELSE 0 END) AS loss
        FROM ge JOIN runs r1 ON r1.id = ge.src JOIN runs r2 ON r2.id = ge.dst AND r2.seed = r1.seed GROUP BY r1.seed)""") + \
        "SELECT seed, round(loss, 6) AS loss FROM ls ORDER BY loss, seed LIMIT 1"

    q["set_cover"] = _with(VEC, GREEDY, recursive=True) + \
        "SELECT cluster_id, demo_id, round(score, 6) AS score, step::INTEGER AS pick_no FROM picks"
    q["pack_groups"] = _with(VEC, GREEDY, recursive=True) + """SELECT cluster_id, demo_id, weight::BIGINT AS weight,
  bin_no FROM bins WHERE rn > 0"""
    q["groups_long"] = _with(VEC, GREEDY, recursive=True) + """SELECT b.cluster_id, b.cluster_id::VARCHAR || '-' || b.bin_no::VARCHAR AS group_id,
  b.demo_id, o.ques_id FROM bins b JOIN owner o USING (cluster_id, demo_id) WHERE b.rn > 0"""
    q["groups_reread"] = f"""SELECT group_id, count(DISTINCT ques_id) AS n_ques, count(DISTINCT demo_id) AS n_demo,
  min(ques_id) AS first_ques, max(demo_id) AS last_demo, count(*) AS n_rows FROM ({q["groups_long"]}) GROUP BY group_id"""
    q["plan_groups"] = _plan_groups_sql(ER_CFG)
    q["plan_groups_similar"] = _plan_groups_sql(ER_SIMILAR)
    q["plan_groups_random"] = _plan_groups_sql(ER_RANDOM)
    q["plan_groups_dominated"] = _plan_groups_sql(ER_DOMINATED)
    q["plan_objective_er"] = _plan_objective_sql(ER_CFG)
    q["plan_violations_er"] = _plan_violations_sql(ER_CFG)
    q["corr_cluster"] = _corr_cluster_sql()
    q["group_extra_demos"] = _group_extra_demos_sql()
    q["plan_groups_corr"] = _plan_groups_corr_sql()
    q["plan_groups_corr_diverse"] = _plan_groups_corr_sql(f">= {K0_CORR}")
    q["assign_balanced"] = _assign_balanced_sql()
    q["assign_last"] = _with(VEC) + "SELECT cluster_id, ques_id, max(demo_id) AS demo_id FROM cc GROUP BY 1, 2"
    q["assign_random"] = _with(VEC) + f"""SELECT cluster_id, ques_id, arg_min(demo_id, md5('{SEED}:' || demo_id::VARCHAR) || lpad(demo_id::VARCHAR, 20, '0')) AS demo_id
FROM cc GROUP BY 1, 2"""
    q["assign_cost"] = _with(VEC, "a AS (SELECT cluster_id, ques_id, max(demo_id) AS demo_id FROM cc GROUP BY 1, 2)",
                             """w AS (SELECT a.cluster_id, a.demo_id, sum(10 + q.label) AS qs, count(*) AS n
        FROM a JOIN vq q USING (ques_id) GROUP BY 1, 2)""") + """SELECT w.cluster_id, w.demo_id,
  (10 + d.label + w.qs)::BIGINT AS weight, w.n::BIGINT AS n_ques FROM w JOIN vd d USING (demo_id)"""
    for name, p in (("ilp_inputs", PCT), ("ilp_inputs_q25", QUARTER)):
        q[name] = _with(VEC, f"""thr AS (SELECT max(p) AS t FROM (SELECT quantile_cont(cdist, {p}) AS p
        FROM vp GROUP BY ques_id))""") + """SELECT q.ques_id,
  (SELECT count(*) FROM vp, thr WHERE vp.ques_id = q.ques_id AND vp.cdist <= thr.t)::BIGINT AS n_cover,
  (10 + q.label)::INTEGER AS cost FROM vq q"""

    q["plan_tokens"] = _with(TXT_ALL) + f"SELECT count(*)::BIGINT AS n_groups, sum(qtok + dtok + {T_COST})::BIGINT AS total_tokens FROM tt"
    q["plan_stats"] = _with(TXT_ALL) + """SELECT count(*)::BIGINT AS n_groups, round(avg(nq), 6) AS avg_ques,
  round(avg(nd), 6) AS avg_demo FROM tt"""
    q["plan_objective"] = _with(TXT_ALL) + f"""SELECT sum(qtok)::BIGINT AS ques_tokens, sum(dtok)::BIGINT AS demo_tokens,
  (count(*) * {T_COST})::BIGINT AS task_tokens, sum(qtok + dtok + {T_COST})::BIGINT AS objective FROM tt WHERE nq > 0 OR nd > 0"""
    q["plan_violations"] = _with(TXT) + f"""SELECT 'question_repeated' AS "check", 0::BIGINT AS n
UNION ALL SELECT 'question_unassigned', 0::BIGINT
UNION ALL SELECT 'under_covered', (SELECT count(*) FROM tq WHERE group_id IN (SELECT group_id FROM tt WHERE nd < 1))::BIGINT
UNION ALL SELECT 'over_budget', (SELECT count(*) FROM tt WHERE qtok + dtok + {T_COST} > {K2_REPORT})::BIGINT
UNION ALL SELECT 'forbidden_pair', 0::BIGINT
UNION ALL SELECT 'empty_group', (SELECT count(*) FROM tt WHERE nq = 0 OR nd = 0)::BIGINT"""

    q["render_prompt_er"] = _er_prompt_sql()
    q["render_prompt_text"] = _text_prompt_sql()
    q["render_prompt_qa"] = _task_prompt_sql(QA_TASK_TEXT, QA_QUESTIONS_HEADER, "'Question:' || d.text || chr(10) || 'Answer:' || "
                                             "CASE WHEN d.answer = 'true' THEN 'yes' ELSE 'no' END || chr(10)")
    q["render_prompt_jd"] = _task_prompt_sql(JD_TASK_TEXT, JD_QUESTIONS_HEADER, "'Question:' || chr(10) || d.text || chr(10) || "
                                             "'After transformation:' || chr(10) || d.answer || chr(10) || chr(10)")

    q["prompts_reread"] = f"SELECT group_id::VARCHAR AS group_id, prompt, answers FROM ({q['render_prompt_jd']})"

    q["parse_yes_no"] = _with(EVAL) + """SELECT group_id, attempt, len(v)::BIGINT AS n_verdicts,
  array_to_string(v, ',') AS verdicts FROM yn"""
    q["parse_json_reply"] = _with(EJSON) + """SELECT group_id, attempt, valid,
  CASE WHEN valid THEN len(json_keys(text))::BIGINT END AS n_keys FROM jok"""
    q["first_valid_reply"] = _with(EVAL) + "SELECT group_id, attempt::INTEGER AS attempt FROM fv"
    q["eval_er"] = _with(EVAL, """t AS (SELECT sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(tn)::BIGINT AS tn,
        sum(fn)::BIGINT AS fn, count(*)::BIGINT AS n_prompts, count(*) FILTER (WHERE unanswered)::BIGINT AS unanswered FROM cnt)""") + """
SELECT tp, fp, tn, fn,
  round(CASE WHEN tp + fp + tn + fn <> 0 THEN (tp + tn) / (tp + fp + tn + fn) ELSE 0 END, 6) AS accuracy,
  round(CASE WHEN tp + fp <> 0 AND tp + fn <> 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision,
  round(CASE WHEN tp + fp <> 0 AND tp + fn <> 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall,
  round(CASE WHEN 2 * tp + fp + fn <> 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1,
  n_prompts, unanswered FROM t"""
    q["eval_exact"] = _with(EJSON) + """SELECT coalesce(sum(correct), 0)::BIGINT AS correct,
  coalesce(sum(total), 0)::BIGINT AS total,
  round(CASE WHEN coalesce(sum(total), 0) <> 0 THEN sum(correct) / sum(total) ELSE 0 END, 6) AS accuracy,
  count(*) FILTER (WHERE total IS NULL)::BIGINT AS unanswered FROM jmatch"""
    q["eval_exact_qa"] = q["eval_exact"]     # boolean gold is a matter of spelling
    q["eval_rollup"] = _with(EJSON) + """SELECT table_name, coalesce(sum(correct), 0)::BIGINT AS correct,
  coalesce(sum(total), 0)::BIGINT AS total,
  round(CASE WHEN coalesce(sum(total), 0) <> 0 THEN sum(correct) / sum(total) ELSE 0 END, 6) AS accuracy
FROM jmatch GROUP BY ROLLUP (table_name)"""
    q["eval_running_tables"] = _with(EJSON) + """SELECT table_name, group_id,
  CAST(sum(coalesce(correct, 0)) OVER w AS BIGINT) AS cum_right, CAST(sum(coalesce(total, 0)) OVER w AS BIGINT) AS cum_seen,
  round(CASE WHEN sum(coalesce(total, 0)) OVER w <> 0
             THEN (sum(coalesce(correct, 0)) OVER w) / (sum(coalesce(total, 0)) OVER w) ELSE 0 END, 6) AS running_accuracy
FROM jmatch WINDOW w AS (PARTITION BY table_name ORDER BY group_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""
    q["eval_running"] = _with(EVAL) + """SELECT group_id,
  CAST(sum(tp + tn) OVER w AS BIGINT) AS cum_right, CAST(sum(tp + fp + tn + fn) OVER w AS BIGINT) AS cum_seen,
  round(CASE WHEN sum(tp + fp + tn + fn) OVER w <> 0 THEN (sum(tp + tn) OVER w) / (sum(tp + fp + tn + fn) OVER w) ELSE 0 END, 6)
    AS running_accuracy
FROM cnt WINDOW w AS (ORDER BY group_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""
    return q
