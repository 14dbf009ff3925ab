"""The queries that SQL can express, in the dialect of the engine that results are compared with."""

from __future__ import annotations

from vacloom.llm import chat, decontaminate, jaccard, lexical, quality, suffixes

WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def jaccard_sql(how: jaccard.Similarity) -> str:
    lowered = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"
    return f"""
  WITH RECURSIVE w AS (SELECT doc_id, {WORDS.format(lowered)} AS ws FROM documents),
  s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= {how.k} THEN list_transform(range(1, len(ws) - {how.k - 2}), lambda i: array_to_string(ws[i:i + {how.k - 1}], ' '))
      WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM w),
  n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
  p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y USING (g) WHERE x.doc_id <> y.doc_id GROUP BY 1, 2),
  l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE {how.den} * c >= {how.num} * (x.n + y.n - c)),
  r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
  SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m.b, d.doc_id)) AS component_id, coalesce(k.c, 0) AS n_links
  FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS b FROM r GROUP BY 1) m USING (doc_id)
  LEFT JOIN (SELECT a AS doc_id, count(*) AS c FROM l GROUP BY 1) k USING (doc_id)"""


def quality_sql() -> str:
    bits = " + ".join(f"CASE WHEN {r.fails} THEN {1 << i} ELSE 0 END" for i, r in enumerate(quality.RULES))
    return rf"""
  WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
  w AS (SELECT doc_id, t, {WORDS.format('t')} AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
  v AS (SELECT doc_id, i, array_to_string(ws[i:i + {quality.WINDOW - 1}], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {quality.WINDOW - 2})) AS i FROM w)),
  u AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, k) AS c FROM v) WHERE c > 1),
  r AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM u, (SELECT unnest(range(0, {quality.WINDOW})) AS j) GROUP BY 1),
  m AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, length(array_to_string(ws, '')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
      len(ls) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, length(regexp_replace(t, '[^\pL\pM]+', '', 'g')) AS n_letters, coalesce(n, 0) AS n_repeat_words
    FROM w LEFT JOIN r USING (doc_id)),
  f AS (SELECT *, CAST({bits} AS BIGINT) AS fail_bits FROM m)
  SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits & {quality.BASE_POLICY.mask()} <> 0 AS base_failed,
    fail_bits & {quality.STRICT_POLICY.mask()} = 0 AS kept, fail_bits FROM f"""


def passages_sql(least: int = suffixes.LEAST) -> str:
    return rf"""
  WITH w AS (SELECT row_number() OVER () AS row_id, doc_id, {WORDS.format("coalesce(text, '')")} AS ws FROM documents),
  v AS (SELECT row_id, i, md5(array_to_string(ws[i + 1:i + {least}], ' ')) AS k FROM (SELECT row_id, ws, unnest(range(0, len(ws) - {least - 1})) AS i FROM w)),
  u AS (SELECT row_id, i FROM (SELECT *, count(*) OVER (PARTITION BY k) AS c FROM v) WHERE c > 1),
  b AS (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY row_id ORDER BY i) <= {least} THEN 0 ELSE 1 END AS new FROM u),
  g AS (SELECT *, sum(new) OVER (PARTITION BY row_id ORDER BY i) AS span FROM b)
  SELECT doc_id, CAST(len(any_value(ws)) AS BIGINT) AS n_words, min(i) AS start, max(i) + {least} AS "end" FROM g JOIN w USING (row_id) GROUP BY row_id, doc_id, span"""


def chat_sql() -> str:
    escaped = r"regexp_replace(regexp_replace(replace({0}, '\', '\\'), '<(\||/?s>|<SYS|</SYS)', '<\\\1', 'g'), '\[(/?INST\])', '[\\\1', 'g')"
    marks = len(chat.TURN + chat.TEXT + chat.END)
    return f"""
  WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, turn, role, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) AS v(turn, role)),
  n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, count(*) OVER (PARTITION BY conv_id) AS n,
      length({escaped.format('role')}) + length({escaped.format('text')}) + {marks} AS size FROM c),
  s AS (SELECT *, sum(size) OVER (PARTITION BY conv_id ORDER BY i) AS upto FROM n)
  SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (role = '{chat.ASSISTANT}'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = '{chat.ASSISTANT}'), '')) AS loss_sha256,
    CAST(sum(upto) FILTER (role = '{chat.ASSISTANT}' OR i = n) AS BIGINT) AS formatted_chars FROM s GROUP BY conv_id"""


def lexical_sql(k: int = lexical.K) -> str:
    terms = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
  WITH d AS (SELECT doc_id, row_number() OVER () AS row_id, {terms} AS ws FROM documents),
  t AS (SELECT row_id, term, count(*) AS tf FROM (SELECT row_id, unnest(ws) AS term FROM d) GROUP BY 1, 2),
  s AS (SELECT count(*) AS n_docs, sum(len(ws))::BIGINT AS n_terms FROM d WHERE len(ws) > 0),
  m AS (SELECT row_id, doc_id, 10 + ((90 * len(ws)::BIGINT * n_docs) // n_terms) AS m FROM d, s WHERE len(ws) > 0),
  q AS (SELECT DISTINCT item, item_id, term FROM (SELECT item, item_id, unnest(ws) AS term FROM (SELECT row_number() OVER () AS item, item_id, {terms} AS ws FROM benchmark))),
  f AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w
    FROM (SELECT term, count(*) AS df FROM t SEMI JOIN q USING (term) GROUP BY 1), s),
  r AS (SELECT item, item_id, row_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
    FROM q JOIN f USING (term) JOIN t USING (term) JOIN m USING (row_id) GROUP BY 1, 2, 3, 4),
  o AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id, row_id)::INTEGER AS rank FROM r WHERE score > 0)
  SELECT item_id, rank, doc_id, score FROM o WHERE rank <= {k}"""


def contamination_sql(width: int = decontaminate.WIDTH) -> str:
    words = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{decontaminate.WORD}')"
    return f"""
  WITH b AS (SELECT item_id, {words} AS ws FROM benchmark),
  i AS (SELECT DISTINCT item_id, size, array_to_string(ws[pos:pos + size - 1], ' ') AS k
    FROM (SELECT item_id, ws, least(len(ws), {width}) AS size, unnest(range(1, greatest(len(ws) - {width - 1}, 1) + 1)) AS pos FROM b WHERE len(ws) > 0)),
  d AS (SELECT row_number() OVER () AS r, doc_id, {words} AS ws FROM documents),
  z AS (SELECT DISTINCT size FROM i),
  v AS (SELECT r, size, pos, array_to_string(ws[pos:pos + size - 1], ' ') AS k FROM (SELECT r, ws, size, unnest(range(1, len(ws) - size + 2)) AS pos FROM d, z)),
  h AS (SELECT r, pos, size, item_id FROM v JOIN i USING (size, k)),
  n AS (SELECT r, count(DISTINCT pos + j) AS n_hit FROM (SELECT r, pos, unnest(range(0, size)) AS j FROM h) GROUP BY 1),
  g AS (SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT r, item_id::VARCHAR AS id FROM h WHERE item_id IS NOT NULL) GROUP BY 1)
  SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN n USING (r) LEFT JOIN g USING (r)"""


def negatives_sql() -> str:
    return """
  WITH v AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
      list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS w FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
  s AS (SELECT a.r, a.vec_id AS anchor_id, x.vec_id, x.r AS other, a.label = x.label AS same,
      list_sum(list_transform(list_zip(a.w, x.w), lambda p: p[1] * p[2]))::BIGINT AS score FROM v a JOIN v x ON a.vec_id % 100 = 0 AND a.r <> x.r),
  p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS place FROM s WHERE same) WHERE place <= 5),
  n AS (SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
      row_number() OVER (PARTITION BY p.r, p.place ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank
    FROM p JOIN s ON p.r = s.r AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
  SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10"""
