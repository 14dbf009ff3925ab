"""A query log derived from orders, and the user turns of conversations, read as search phrases."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..bindings import table
from ..operators import phrases as op
from .catalog import query

LOG = """SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 'closed remote' WHEN 1 THEN 'Hybrid contract' ELSE 'find open' END
    || CASE o_orderkey % 5 WHEN 0 THEN ' senior chief of staff' WHEN 1 THEN ' c' WHEN 2 THEN ' full-time data research' ELSE ' sales' END
    || ' jobs at Customer' || CAST(o_custkey AS STRING) || CASE o_orderkey % 4 WHEN 0 THEN ' in New York' ELSE '' END
    || CASE o_orderkey % 7 WHEN 0 THEN ' added today since 2026-01-01' WHEN 1 THEN ' this week' WHEN 2 THEN ' since March 5, 2001'
       WHEN 3 THEN ' todayish designer today' ELSE ' since ' || CAST(CAST(o_orderdate AS DATE) AS STRING) END AS phrase FROM {orders}"""


def settled_sql(source: str, key: str, text: str, as_of: str) -> str:
    """The same reading as successive replacements, one step for each topic, period, company and place."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    steps = [f"s0 AS (SELECT {key}, trim(regexp_replace({text}, '\\s+', ' ', 'g')) AS input, trim(regexp_replace({text}, '\\s+', ' ', 'g')) AS rest, NULL AS hit FROM {source})"]
    for i, topic in enumerate(op.TOPICS):
        phrases = [(phrase, value) for t, phrase, value, _ in op.ranked_phrases() if t == topic]
        hit = " ".join(f"WHEN regexp_matches(rest, {quoted(f'(?i)\\b{p}\\b')}) THEN {quoted(p)}" for p, _ in phrases)
        values = " ".join(f"WHEN {quoted(p)} THEN {quoted(v)}" for p, v in phrases)
        cuts = " ".join(f"WHEN {quoted(p)} THEN regexp_replace(rest, {quoted(f'(?i)\\b{p}\\b')}, ' ')" for p, _ in phrases)
        steps.append(f"""s{i + 1} AS (SELECT * EXCLUDE (rest), CASE hit {values} END AS {topic}, CASE hit {cuts} ELSE rest END AS rest
          FROM (SELECT * EXCLUDE (hit), CASE {hit} END AS hit FROM s{i}))""")
    period, date = quoted(f"(?i)\\b{op.PERIOD}\\b"), quoted(f"(?i)\\b{op.EXPLICIT_DATE}\\b")
    company = quoted(f"(?i)\\b(?:{op.BEFORE_COMPANY})\\s+(.+?)(\\s+(?:{op.AFTER_COMPANY})\\b|$)")
    place = quoted(f"(?i)\\b(?:{op.BEFORE_PLACE})\\s+(.+?)(\\s+(?:{op.AFTER_PLACE})\\b|$)")
    filler = quoted(f"(?i)\\b(?:{op.FILLER})\\b")
    steps += [
        f"p1 AS (SELECT * EXCLUDE (rest), nullif(lower(regexp_extract(rest, {period}, 1)), '') AS period, regexp_replace(rest, {period}, ' ') AS rest FROM s4)",
        f"p2 AS (SELECT * EXCLUDE (rest), CASE WHEN period IS NULL THEN nullif(regexp_extract(rest, {date}, 1), '') END AS stated, "
        f"CASE WHEN period IS NULL THEN regexp_replace(rest, {date}, ' ') ELSE rest END AS rest FROM p1)",
        f"""p3 AS (SELECT *, coalesce(CASE period WHEN 'today' THEN date_trunc('day', TIMESTAMP '{as_of}') WHEN 'last 24 hours' THEN TIMESTAMP '{as_of}' - INTERVAL '24' HOUR
          WHEN 'this week' THEN date_trunc('week', TIMESTAMP '{as_of}') END, try_strptime(stated, ['%Y-%m-%d', '%B %d, %Y', '%b %d, %Y'])) AS new_since FROM p2)""",
        f"p4 AS (SELECT * EXCLUDE (rest), nullif(trim(regexp_extract(rest, {company}, 1)), '') AS company, regexp_replace(rest, {company}, ' \\2') AS rest FROM p3)",
        f"p5 AS (SELECT * EXCLUDE (rest), nullif(trim(regexp_extract(rest, {place}, 1)), '') AS location, regexp_replace(rest, {place}, ' \\2') AS rest FROM p4)",
        f"""p6 AS (SELECT *, nullif(trim(regexp_replace(regexp_replace(regexp_replace(rest, '[,.!?]', ' ', 'g'), {filler}, ' ', 'g'), '\\s+', ' ', 'g')), '') AS q FROM p5)""",
        """p7 AS (SELECT *, list_filter([CASE status WHEN 'verified_closed' THEN 'verified closed' WHEN 'all' THEN 'all job states' END, role_family, employment_type,
          remote_status, 'near ' || location, 'at ' || company, 'added since ' || strftime(new_since, '%Y-%m-%d'), 'matching “' || q || '”'], lambda x: x IS NOT NULL) AS parts FROM p6)""",
    ]
    return "WITH " + ",\n".join(steps) + f"""
      SELECT {key}, status, remote_status, employment_type, role_family, company, location, strftime(new_since, '%Y-%m-%d') AS since, q,
        CASE WHEN len(parts) > 0 THEN 'Searching ' || array_to_string(parts, ' · ') ELSE 'Searching for “' || input || '”' END AS interpretation,
        CASE WHEN length(q) < 2 THEN 'The remaining search text “' || q || '” is very short.' ELSE '' END AS warnings FROM p7"""


def shown(rows, *keys):
    return rows.select(
        *keys, "status", "remote_status", "employment_type", "role_family", "company", "location",
        F.date_format("new_since", "yyyy-MM-dd").alias("since"), "q", "interpretation", F.array_join("warnings", " ").alias("warnings"))


@query("interpreted_phrases", settled_sql(f"({LOG.replace('{orders}', 'orders')})", "id", "phrase", "2001-08-01 00:00:00"))
def interpreted_phrases(spark, sf_dir):
    table(spark, sf_dir, "orders")
    log = spark.sql(LOG.format(orders=f"parquet.`{sf_dir}/orders.parquet`"))
    return shown(op.interpret(log, "phrase", "2001-08-01 00:00:00"), "id")


@query("interpreted_conversations", settled_sql("(SELECT * FROM conversations WHERE role = 'user')", "conv_id, turn", "text", "2024-02-01 00:00:00"))
def interpreted_conversations(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").filter("role = 'user'")
    return shown(op.interpret(turns, "text", "2024-02-01 00:00:00"), "conv_id", "turn")
