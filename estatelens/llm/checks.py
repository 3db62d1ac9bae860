"""The queries in SQL, where SQL can express them."""

from __future__ import annotations

from estatelens.llm.conversations import Costs
from estatelens.llm.hard_negatives import Mining
from estatelens.llm.line_dedup import Alike
from estatelens.llm.quality import SYMBOLS, Rules
from estatelens.llm.secrets import ADDED, KINDS, MADE_UP, Ownership

CHECKS: dict[str, str] = {}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x20\x09-\x0D]+"


def words(text: str, lower: bool = False) -> str:
    if lower:
        text = f"translate({text}, '{UPPER}', '{LOWER}')"
    return f"regexp_extract_all(coalesce({text}, ''), '{WORD}')"


def near_groups(k: int, percent: int) -> str:
    """All similar pairs by shared shingles, then the smallest id each document reaches."""
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, {words("text", lower=True)} AS w FROM documents),
sh AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {k} THEN [array_to_string(w, ' ')]
    ELSE list_transform(generate_series(1, len(w) - {k} + 1), lambda i: array_to_string(w[i:i + {k} - 1], ' ')) END)) AS s
  FROM d),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
  FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (
  SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
  WHERE 100 * c >= {percent} * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach(doc_id, other) AS (
  SELECT a, b FROM both_ways
  UNION SELECT r.doc_id, l.b FROM reach r JOIN both_ways l ON r.other = l.a),
least AS (SELECT doc_id, min(other) AS other FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles,
  least(d.doc_id, coalesce(l.other, d.doc_id)) AS component_id,
  d.doc_id = least(d.doc_id, coalesce(l.other, d.doc_id)) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN least l USING (doc_id)"""


def secret_spans(rule: Ownership) -> str:
    def quoted(text: str) -> str:
        return "'" + text.replace("'", "''") + "'"

    def one(at: int, kind: str, pattern: str, group: int, least: int) -> str:
        value = f"regexp_extract(m, {quoted(pattern)}, {group})" if group else "m"
        p = quoted(pattern)
        return f"""
SELECT doc_id, owner, repo, '{kind}' AS kind, {at} AS place, e - length(m) AS s, e, {value} AS v
FROM (
  SELECT doc_id, owner, repo, m, sum(length(b) + coalesce(length(m), 0)) OVER (
    PARTITION BY doc_id ORDER BY i)::BIGINT AS e
  FROM (
    SELECT doc_id, owner, repo, unnest(range(len(b))) AS i, unnest(b) AS b, unnest(list_resize(m, len(b))) AS m
    FROM (SELECT doc_id, source AS owner, lang AS repo, string_split_regex(t, {p}) AS b,
      regexp_extract_all(t, {p}, 0) AS m FROM (SELECT *, coalesce(text, '') AS t FROM documents))))
WHERE m IS NOT NULL AND length({value}) >= {least}"""

    kinds = "\nUNION ALL".join(one(at, k, *v) for at, (k, v) in enumerate(KINDS.items()))
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in [*KINDS, *ADDED])
    out = ", ".join(f"coalesce(n_{k}, 0)::BIGINT AS n_{k}" for k in [*KINDS, *ADDED])
    return f"""
WITH base AS ({kinds}),
placed AS (
  SELECT v, min({{'owner': coalesce(owner, ''), 'repo': coalesce(repo, '')}}) AS place
  FROM base JOIN documents USING (doc_id) GROUP BY v, text),
used AS (
  SELECT v, count(DISTINCT place.owner) AS owners, count(DISTINCT place) AS repos FROM placed GROUP BY v),
verdict AS (
  SELECT v, CASE
    WHEN owners >= {rule.copied_owners} OR owners > 1 AND repos >= {rule.copied_repos} THEN '{ADDED[1]}'
    WHEN len(list_distinct(string_split(v, ''))) >= {rule.distinct_signs}
      AND regexp_matches(v, '[0-9]') AND NOT regexp_matches(v, '(?i){MADE_UP}') THEN '{ADDED[0]}'
    ELSE '{ADDED[2]}' END AS kind
  FROM used),
spans AS (
  SELECT doc_id, kind, place, s, e FROM base
  UNION ALL
  SELECT DISTINCT b.doc_id, w.kind, {len(KINDS) - 1} + list_position({list(ADDED)}, w.kind),
    e - length(b.v), e
  FROM base b JOIN verdict w USING (v)),
listed AS (
  SELECT doc_id, {counts},
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, place, e) AS spans,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, place, e) FILTER (place < {len(KINDS)}) AS base
  FROM spans GROUP BY doc_id)
SELECT doc_id, {out}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents LEFT JOIN listed USING (doc_id)"""


def line_removal(like: Alike) -> str:
    """Pairs of lines that share one of their rarest words, then compared on their full sets."""
    t = like.percent
    return f"""
WITH l AS (
  SELECT doc_id, generate_subscripts(lines, 1) - 1 AS line, unnest(lines) AS x
  FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents)),
tok AS (
  SELECT doc_id * 1000000 + line AS ord, unnest(w) AS t, len(w) AS n
  FROM (SELECT doc_id, line, list_distinct({words("x")}) AS w FROM l) WHERE len(w) > 0),
df AS (SELECT t, count(*) AS c FROM tok GROUP BY t),
ranked AS (
  SELECT ord, t, n, row_number() OVER (PARTITION BY ord ORDER BY c, t) AS i FROM tok JOIN df USING (t)),
prefix AS (SELECT ord, t, n FROM ranked WHERE i <= n - ((n * {t} + 99) // 100) + 1),
pair AS (
  SELECT DISTINCT a.ord AS a, b.ord AS b, a.n AS n, b.n AS m
  FROM prefix a JOIN prefix b ON a.t = b.t AND a.ord < b.ord
  WHERE least(a.n, b.n) * 100 >= greatest(a.n, b.n) * {t}),
common AS (
  SELECT a, b, pair.n, m, count(*) AS c FROM pair JOIN tok x ON x.ord = a JOIN tok y ON y.ord = b AND x.t = y.t
  GROUP BY ALL),
gone AS (SELECT DISTINCT b AS ord FROM common WHERE c * 100 >= (n + m - c) * {t}),
kept AS (
  SELECT l.doc_id, count(*) AS n_lines, count(g.ord) AS n_removed,
    string_agg(x, chr(10) ORDER BY line) FILTER (g.ord IS NULL) AS text
  FROM l LEFT JOIN gone g ON g.ord = l.doc_id * 1000000 + line GROUP BY l.doc_id)
SELECT doc_id, n_lines::BIGINT AS n_lines, n_removed::BIGINT AS n_removed, coalesce(text, '') AS text FROM kept"""


def document_quality(rules: Rules) -> str:
    k = rules.window
    inside = " OR ".join(f"coalesce(list_contains(r, i - {j}), false)" for j in range(k))
    return f"""
WITH d AS (
  SELECT doc_id, coalesce(source, chr(0)) AS host, coalesce(text, '') AS text, {words("text")} AS w FROM documents),
g AS (
  SELECT doc_id, unnest(range(1, len(w) - {k} + 2)) AS i,
    unnest(list_transform(range(1, len(w) - {k} + 2), lambda i: array_to_string(w[i:i + {k} - 1], ' '))) AS x
  FROM d WHERE len(w) >= {k}),
again AS (
  SELECT doc_id, list(i) AS r FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x) AS c FROM g)
  WHERE c > 1 GROUP BY doc_id),
rep AS (
  SELECT doc_id, len(list_filter(range(1, len(w) + 1), lambda i: {inside})) AS n
  FROM d JOIN again USING (doc_id)),
l AS (SELECT doc_id, host, unnest(string_split(text, chr(10))) AS x FROM d),
lw AS (
  SELECT doc_id, host, x, {words("x", lower=True)} AS w FROM l),
dup AS (
  SELECT doc_id, sum(c - 1) AS n FROM (SELECT doc_id, x, count(*) AS c FROM lw WHERE len(w) > 0 GROUP BY ALL)
  GROUP BY doc_id),
first_copy AS (SELECT host, text, min(doc_id) AS doc_id FROM d GROUP BY ALL),
sizes AS (SELECT host, count(*) AS n FROM first_copy GROUP BY host),
norm AS (SELECT doc_id, host, array_to_string(w, ' ') AS x, len(w) AS n FROM lw WHERE len(w) > 0),
frequent AS (
  SELECT a.host, x FROM norm a JOIN first_copy f ON f.doc_id = a.doc_id JOIN sizes s ON s.host = a.host
  GROUP BY a.host, x, s.n
  HAVING count(DISTINCT a.doc_id) >= {rules.least} AND count(DISTINCT a.doc_id) * 100 > s.n * {rules.share_percent}),
lost AS (SELECT doc_id, sum(n) AS n FROM norm JOIN frequent USING (host, x) GROUP BY doc_id),
counts AS (
  SELECT d.doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda y: length(y))), 0) AS word_chars,
    len(regexp_extract_all(text, '{SYMBOLS}')) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines,
    coalesce(rep.n, 0) AS n_repeat_words, coalesce(lost.n, 0) AS lost
  FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN lost USING (doc_id)),
judged AS (
  SELECT *, n_words < {rules.min_words} OR 100 * n_repeat_words > {rules.repeat_percent} * n_words AS base_failed
  FROM counts)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT base_failed AND 100 * lost <= {rules.lost_percent} * n_words AS kept, lost::BIGINT AS n_removed_words
FROM judged"""


def leaks(window: int) -> str:
    """Item windows met with all word sequences of the documents that are as long."""
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

    def split(text: str) -> str:
        return f"regexp_extract_all(translate(coalesce({text}, ''), '{UPPER}', '{LOWER}'), '{word}')"

    return f"""
WITH d AS (SELECT doc_id, {split("text")} AS w FROM documents),
b AS (SELECT item_id, {split("text")} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), {window}) AS k,
    unnest(list_transform(generate_series(1, greatest(len(w) - {window} + 1, 1)),
      lambda i: array_to_string(w[i:i + {window} - 1], ' '))) AS s
  FROM b WHERE len(w) > 0),
ks AS (SELECT DISTINCT k FROM win),
dw AS (
  SELECT doc_id, k, unnest(generate_series(1, len(w) - k + 1)) AS i,
    unnest(list_transform(generate_series(1, len(w) - k + 1), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS s
  FROM d JOIN ks ON len(w) >= k),
met AS (SELECT dw.doc_id, dw.i, dw.k, win.item_id FROM dw JOIN win ON dw.k = win.k AND dw.s = win.s),
hit AS (SELECT doc_id, count(DISTINCT x) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS x FROM met) GROUP BY doc_id),
found AS (
  SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM met) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(hit.n, 0)::BIGINT AS n_hit, coalesce(found.n, 0)::BIGINT AS n_items,
  sha256(coalesce(found.items, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN found USING (doc_id)"""


def conversation_repair(costs: Costs) -> str:
    """The cheapest repair row by row, with whole lists of edits and whole repaired texts in every state."""
    # states: 0 nothing yet, 1 after s, 2 after u, 3 after a
    kept = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    coming = {0: ("user", 2), 1: ("user", 2), 2: ("assistant", 3), 3: ("user", 2)}
    steps, ends = [], []
    for state in range(4):
        at, edits, cost, text = state, "", 0, ""
        for _ in range(3):
            rows = [("D", None, None, at, costs.delete)]
            rows += [("K", initial, None, to, 0) for (s, initial), to in kept.items() if s == at]
            rows.append(("R", None, coming[at][0], coming[at][1], costs.rerole))
            for edit, initial, role, to, more in rows:
                value = [state, f"'{edits}{edit}'", cost + more, f"'{edit}'", to, f"'{text}'"]
                value += ["NULL" if x is None else f"'{x}'" for x in (initial, role)]
                steps.append(f"({', '.join(map(str, value))})")
            if at in (0, 3):
                ends.append(f"({state}, '{edits}', {cost}, '{text}')")
            role, at = coming[at]
            edits, cost, text = edits + "I", cost + costs.insert, f"{text}|{role}:"
    return f"""
WITH RECURSIVE
step(state, edits, cost, edit, next, added, initial, role) AS (VALUES {", ".join(steps)}),
ending(state, edits, cost, added) AS (VALUES {", ".join(ends)}),
bits AS (
  SELECT list(x ORDER BY i) AS t FROM (
    SELECT i, list_reduce(range(8)::UBIGINT[], lambda c, j:
      CASE WHEN c % 2 = 1 THEN xor(3988292384::UBIGINT, c >> 1) ELSE c >> 1 END, i::UBIGINT) AS x
    FROM range(256) r(i))),
c AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''),
        lambda x: ascii(x)::UBIGINT),
      lambda a, x: xor(t[((xor(a, x) % 256) + 1)::BIGINT], a >> 8), 4294967295::UBIGINT), 4294967295::UBIGINT) % 20 AS f
  FROM conversations, bits),
damaged AS (
  SELECT conv_id, turn, CASE f WHEN 4 THEN 'user' ELSE role END AS role,
    CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE f WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM c WHERE f <> 0),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n,
    regexp_extract(text, '([^\\x20\\x09-\\x0D])[\\x20\\x09-\\x0D]*$', 1) AS last
  FROM damaged),
judged AS (
  SELECT *, CASE WHEN last = '' THEN 'blank'
      WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 THEN 'duplicate'
      WHEN last NOT IN ('.', '!', '?') THEN 'truncated' END AS fault,
    lag(role[1]) OVER (PARTITION BY conv_id ORDER BY n) || role[1] AS pair
  FROM numbered),
survivor(conv_id, n, state, best) AS (
  SELECT DISTINCT conv_id, 0::BIGINT, 0, {{'cost': 0, 'edits': '', 'text': ''}} FROM conversations
  UNION ALL
  SELECT v.conv_id, v.n + 1, p.next, min({{'cost': v.best.cost + p.cost
      + CASE WHEN j.fault = 'truncated' AND p.edit <> 'D' THEN {costs.truncated} ELSE 0 END,
    'edits': v.best.edits || p.edits,
    'text': v.best.text || p.added || CASE p.edit WHEN 'D' THEN '' ELSE '|' || coalesce(p.role, j.role) || ':'
      || replace(j.text, '|', chr(1)) END}})
  FROM survivor v JOIN judged j ON j.conv_id = v.conv_id AND j.n = v.n + 1 JOIN step p ON p.state = v.state
  WHERE (p.initial IS NULL OR p.initial = j.role[1])
    AND (p.edit = 'D' OR j.fault IS NULL OR j.fault = 'truncated')
  GROUP BY v.conv_id, v.n, p.next),
finished AS (
  SELECT v.conv_id, min({{'cost': v.best.cost + e.cost, 'edits': v.best.edits || e.edits, 'text': v.best.text || e.added}}) AS best
  FROM survivor v JOIN ending e USING (state)
  WHERE v.n = (SELECT count(*) FROM judged j WHERE j.conv_id = v.conv_id)
  GROUP BY v.conv_id),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM judged GROUP BY conv_id)
SELECT f.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank,
  coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, f.best.cost::BIGINT AS cost, f.best.edits AS audit,
  sha256(replace(replace(f.best.text[2:], '|', chr(10)), chr(1), '|')) AS repaired_sha256
FROM finished f LEFT JOIN counts USING (conv_id)"""


def hard_negatives(mining: Mining) -> str:
    """All products of the anchors, ranked."""
    return f"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor({mining.scale} * x::DOUBLE)::BIGINT) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS vec_id, a.label = b.label AS same,
    list_sum(list_transform(list_zip(a.x, b.x), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE a.vec_id % 100 = 0),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {mining.positives})
SELECT p.anchor_id, positive_id,
  row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same
  AND 100 * score BETWEEN {mining.low_percent} * positive_score AND {mining.high_percent} * positive_score
QUALIFY rank <= {mining.negatives}"""


CHECKS["op1_minhash_dedup"] = near_groups(3, 85)
CHECKS["op3_secret_scan"] = secret_spans(Ownership())
CHECKS["op5_line_dedup"] = line_removal(Alike())
CHECKS["op9_quality_rules"] = document_quality(Rules())
CHECKS["op11_decontaminate"] = leaks(10)
CHECKS["op12_repair_conversations"] = conversation_repair(Costs())
CHECKS["op13_hard_negatives"] = hard_negatives(Mining())
