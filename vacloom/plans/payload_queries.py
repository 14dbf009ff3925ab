"""Board payloads made from orders, one per order, in all seven shapes: sound, broken, repeated and conflicting ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..bindings import table
from ..sources import payloads as op
from .catalog import query

K, C = "CAST(o_orderkey AS STRING)", "CAST(o_custkey AS STRING)"
PLACE = "CASE o_custkey % 3 WHEN 0 THEN 'New York, United States' WHEN 1 THEN 'Berlin, Germany' ELSE 'San Francisco, USA' END"
#: An order's postings: a sound one, and one that differs by order: repeated, without a link, not listed, or in conflict.
ASHBY = f"""'{{"jobs":[{{"id":"' || {K} || '","title":" Engineer ' || {C} || ' ","department":"R&D","location":"' || {PLACE} || '","isRemote":'
  || CASE WHEN o_orderkey % 5 = 0 THEN 'true' ELSE 'false' END || ',"workplaceType":"Hybrid","jobUrl":"https://jobs.example.com/' || {K}
  || '","publishedAt":"2001-02-03T04:05:06Z","descriptionPlain":"Build <b>things</b>  now","compensation":{{"compensationTierSummary":"$1"}}}},'
  || CASE o_orderkey % 4
    WHEN 0 THEN '{{"id":"u' || {K} || '","title":"Hidden","location":"New York, United States","isListed":false,"jobUrl":"https://jobs.example.com/h"}}'
    WHEN 1 THEN '{{"id":"n' || {K} || '","title":"No link","location":"New York, United States","jobUrl":"http://jobs.example.com/n"}}'
    WHEN 2 THEN '{{"id":"c' || {K} || '","title":"A","location":"USA","jobUrl":"https://x.example.com/"}},{{"id":"c' || {K} || '","title":"B","location":"USA","jobUrl":"https://x.example.com/"}}'
    ELSE '{{"id":0,"title":"Sales","location":"USA","jobUrl":"https://x.example.com/7"}},{{"id":0,"title":"Sales","location":"USA","jobUrl":"https://x.example.com/7"}}' END
  || ']}}'"""
GREENHOUSE = f"""'{{"jobs":[{{"id":' || {K} || ',"title":"Engineer ' || {C} || '","departments":[{{"name":"R&D"}},{{"name":""}},{{"name":"Core"}}],"location":{{"name":"' || {PLACE}
  || CASE WHEN o_orderkey % 5 = 0 THEN ' (Remote)' ELSE '' END || '"}},"metadata":[{{"name":"Employment Type","value":"Full"}}],"absolute_url":"https://b.example.com/' || {K}
  || '","updated_at":"2001-02-03T04:05:06Z","content":"<p>Text</p>","pay_input_ranges":{{"formatted_pay_range":"$5"}}}}]}}'"""
LEVER = f"""'[{{"id":"' || {K} || '","text":"Engineer ' || {C} || '","categories":{{"team":"Core","location":"' || {PLACE} || '","commitment":"Full"}},"workplaceType":"'
  || CASE WHEN o_orderkey % 5 = 0 THEN 'Remote' ELSE 'on-site' END || '","salaryRange":{{"min":"10","max":"20","currency":"USD"}},"applyUrl":"https://l.example.com/' || {K}
  || '","createdAt":981173106000,"description":"Text"}}]'"""
WORKABLE = f"""'{{"results":[{{"shortcode":"S' || {K} || '","title":"Engineer ' || {C} || '","country":"Germany","city":"Berlin","url":"https://apply.workable.com/a/j/S' || {K}
  || '","application_url":"https://apply.workable.com/a/j/S' || {K} || '/apply","published_on":"2001-02-03","description":"Text","salary":{{"salary_from":1,"salary_to":2,"salary_currency":"usd"}}}}'
  || CASE WHEN o_orderkey % 2 = 0 THEN ',{{"shortcode":"S' || {K} || '","title":"Engineer ' || {C} || '","locations":[{{"city":"Austin","region":"TX","country":"United States"}},'
    || '{{"city":"Austin","region":"TX","country":"United States"}},{{"city":"Boston","countryCode":"US"}}],"url":"https://apply.workable.com/a/j/S' || {K}
    || '","application_url":"https://apply.workable.com/a/j/S' || {K} || '/apply","published_on":"2001-02-03","description":"Text"}}' ELSE '' END
  || CASE WHEN o_orderkey % 3 = 0 THEN ',{{"shortcode":"P' || {K} || '","title":"General application","country":"US","url":"https://apply.workable.com/a/j/P"}}' ELSE '' END || ']}}'"""
RECRUITEE = f"""'{{"offers":[{{"id":' || {K} || ',"title":"' || CASE WHEN o_orderkey % 4 = 0 THEN 'Open Application' ELSE 'Engineer' END || '","status":"'
  || CASE WHEN o_orderkey % 6 = 1 THEN 'draft' ELSE 'Published' END || '","locations":[{{"name":"HQ","city":"Austin","state":"TX","country":"United States"}},{{"name":"HQ"}}],"hybrid":true,'
  || '"employment_type_code":"fulltime","salary":{{"min":10,"max":null,"currency":"EUR"}},"careers_url":"https://r.example.com/' || {K}
  || '","careers_apply_url":"https://r.example.com/apply","published_at":"2001-02-03T04:05:06Z","description":"<p>A</p>","requirements":"B"}}]}}'"""
PERSONIO = f"""CASE WHEN o_orderkey % 5 = 0 THEN '<workzag-jobs><position><id>1</id>' ELSE '<workzag-jobs><position><id>' || {K} || '</id><office>' || {PLACE} || '</office><department>Core</department><name>'
  || CASE WHEN o_orderkey % 4 = 0 THEN 'Initiativbewerbung' ELSE 'Engineer' END || '</name><jobDescriptions><jobDescription><name>n</name><value>A &amp; B</value></jobDescription>'
  || '<jobDescription><name>m</name><value><![CDATA[<p>C</p>]]></value></jobDescription></jobDescriptions><employmentType>permanent</employmentType><schedule>full-time</schedule>'
  || '<createdAt>2001-02-03T04:05:06Z</createdAt><salaryInformation><min>10</min><currencyCode>EUR</currencyCode><type>monthly</type></salaryInformation></position></workzag-jobs>' END"""
SMART = f"""'[{{"id":"' || {K} || '","name":"Engineer","department":{{"label":"Core"}},"location":{{"city":"Austin","region":"TX","country":"us","hybrid":true}},"active":'
  || CASE WHEN o_orderkey % 4 = 0 THEN 'false' ELSE 'true' END || ',"visibility":"PUBLIC","typeOfEmployment":{{"label":"Full"}},"compensation":{{"min":1,"currency":"usd","period":"YEAR"}},"postingUrl":"https://s.example.com/'
  || {K} || '","applyUrl":"https://s.example.com/apply","releasedDate":"2001-02-03T04:05:06Z","jobAd":{{"sections":{{"companyDescription":{{"text":"A"}},"jobDescription":{{"text":"B"}}}}}}}}]'"""
SHAPES = {"ashby": ASHBY, "greenhouse": GREENHOUSE, "lever": LEVER, "workable": WORKABLE, "recruitee": RECRUITEE, "personio": PERSONIO, "smartrecruiters": SMART}

US = "o_custkey % 3 <> 1"
ROW = """SELECT {k} AS source_id, {external} AS external_id, {title} AS title, {location} AS location, {remote} AS remote_status, {kind} AS employment_type,
  {pay} AS compensation, {url} AS canonical_url, {published} AS published, {text} AS description FROM orders WHERE {test}"""
WHEN = "'2001-02-03 04:05:06'"


def expected(**said: str) -> str:
    return ROW.format(**{"k": K, "published": WHEN, **said})


EXPECTED = {
    "ashby": expected(
        external=K, title=f"'Engineer ' || {C}", location=PLACE, remote="CASE WHEN o_orderkey % 5 = 0 THEN 'Remote' ELSE 'Hybrid' END", kind="'See posting'", pay="'$1'",
        url=f"'https://jobs.example.com/' || {K}", text="'Build things now'", test=f"{US} AND o_orderkey % 4 <> 2") + " UNION ALL " + expected(
        external="'0'", title="'Sales'", location="'USA'", remote="'See posting'", kind="'See posting'", pay="'See posting'", url="'https://x.example.com/7'",
        published="NULL", text="''", test="o_orderkey % 4 = 3"),
    "greenhouse": expected(
        external=K, title=f"'Engineer ' || {C}", location=f"{PLACE} || CASE WHEN o_orderkey % 5 = 0 THEN ' (Remote)' ELSE '' END",
        remote="CASE WHEN o_orderkey % 5 = 0 THEN 'Remote' ELSE 'See posting' END", kind="'Full'", pay="'$5'", url=f"'https://b.example.com/' || {K}", text="'Text'", test=US),
    "lever": expected(
        external=K, title=f"'Engineer ' || {C}", location=PLACE, remote="CASE WHEN o_orderkey % 5 = 0 THEN 'Remote' ELSE 'on-site' END", kind="'Full'", pay="'USD 10–20'",
        url=f"'https://l.example.com/' || {K}", text="'Text'", test=US),
    "workable": expected(
        external=f"'S' || {K}", title=f"'Engineer ' || {C}", location="'Austin, TX, United States; Boston'", remote="'See posting'", kind="'See posting'", pay="'USD 1–2'",
        url=f"'https://apply.workable.com/a/j/S' || {K}", published="'2001-02-03 00:00:00'", text="'Text'", test="o_orderkey % 2 = 0"),
    "recruitee": expected(
        external=K, title="'Engineer'", location="'HQ, Austin, TX, United States'", remote="'Hybrid'", kind="'fulltime'", pay="'EUR 10–10'", url=f"'https://r.example.com/' || {K}",
        text="'A B'", test="o_orderkey % 4 <> 0 AND o_orderkey % 6 <> 1"),
    "personio": expected(
        external=K, title="'Engineer'", location=PLACE, remote="'See posting'", kind="'full-time permanent'", pay="'EUR 10–10 per month'",
        url=f"'https://acme.jobs.personio.de/job/' || {K} || '?language=en'", text="'A & B C'", test=f"{US} AND o_orderkey % 4 <> 0 AND o_orderkey % 5 <> 0"),
    "smartrecruiters": expected(
        external=K, title="'Engineer'", location="'Austin, TX, United States'", remote="'Hybrid'", kind="'Full'", pay="'USD 1–1 per year'", url=f"'https://s.example.com/' || {K}",
        text="'A B'", test="o_orderkey % 4 <> 0"),
}


def payloads(spark, sf_dir, provider):
    """A payload per order; reading payloads outweighs reading orders, so the orders are dealt to all cores."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    dealt = orders.repartition(max(orders.rdd.getNumPartitions(), 3 * spark.sparkContext.defaultParallelism))
    return dealt.select(*[F.expr(e).alias(name) for name, e in {
        "source_id": K, "provider": f"'{provider}'", "board_id": "'Acme.jobs.personio.de'", "payload": SHAPES[provider]}.items()])


def _register(provider: str) -> None:
    @query(f"payload_{provider}", EXPECTED[provider])
    def postings(spark, sf_dir):
        return op.postings(payloads(spark, sf_dir, provider), provider).select(
            "source_id", "external_id", "title", "location", "remote_status", "employment_type", "compensation", "canonical_url",
            F.date_format("published_at", "yyyy-MM-dd HH:mm:ss").alias("published"), "description")


for _provider in SHAPES:
    _register(_provider)

COMPLETE = {
    "ashby": "o_orderkey % 4 IN (0, 2)", "greenhouse": "TRUE", "lever": "TRUE", "workable": "o_orderkey % 3 <> 0",
    "recruitee": "o_orderkey % 6 <> 1", "personio": "o_orderkey % 5 <> 0", "smartrecruiters": "o_orderkey % 4 <> 0",
}


@query("payload_completeness", " UNION ALL ".join(f"SELECT '{p}:' || {K} AS source_id, {test} AS complete FROM orders" for p, test in COMPLETE.items()))
def payload_completeness(spark, sf_dir):
    found = None
    for provider in SHAPES:
        rows = payloads(spark, sf_dir, provider).withColumn("source_id", F.concat_ws(":", F.lit(provider), "source_id"))
        found = rows if found is None else found.unionAll(rows)
    return op.completeness(found)


PAGES = """SELECT CAST(o_custkey AS STRING) AS source_id, CAST(n - 1 AS INT) * 100 AS page_start, CASE WHEN o_custkey % 7 = 3 AND n = 2 THEN 101 ELSE 100 END AS page_limit,
  CASE WHEN o_custkey % 11 = 5 THEN total + n ELSE total END AS total, least(100, total - (n - 1) * 100) AS items
  FROM (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n, count(*) OVER (PARTITION BY o_custkey) * 100 - o_custkey % 50 AS total FROM {orders})
  WHERE NOT (o_custkey % 5 = 2 AND n = 2)"""


@query("payload_pages", f"""
  SELECT source_id, bool_and(page_start = due AND page_limit BETWEEN 1 AND 100) AND min(total) = max(total) AND sum(items) = max(total) AS complete
  FROM (SELECT *, coalesce(sum(items) OVER (PARTITION BY source_id ORDER BY page_start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS due
    FROM ({PAGES.replace('{orders}', 'orders')})) GROUP BY source_id""")
def payload_pages(spark, sf_dir):
    table(spark, sf_dir, "orders")
    return op.assembled_pages(spark.sql(PAGES.replace("{orders}", f"parquet.`{sf_dir}/orders.parquet`")))


ITEMS = "SELECT CAST(o_custkey AS STRING) AS source_id, CAST(o_orderkey AS STRING) AS id, '00000000-0000-4000-8000-' || lpad(CAST(o_orderkey AS STRING), 12, 'a') AS uuid, 'Engineer' AS name FROM {orders}"
DETAILS = """SELECT source_id, id, upper(uuid) AS uuid, CASE WHEN CAST(id AS BIGINT) % 97 = 1 THEN 'Other' ELSE name END AS name, CAST(id AS BIGINT) % 89 <> 2 AS active,
  CASE WHEN CAST(id AS BIGINT) % 83 = 3 THEN 'INTERNAL' ELSE 'PUBLIC' END AS visibility, CASE WHEN CAST(id AS BIGINT) % 79 = 4 THEN ' ' ELSE 'Text' END AS description
  FROM ({items}) WHERE CAST(id AS BIGINT) % 101 <> 5"""


@query("payload_details", """
  SELECT CAST(o_custkey AS STRING) AS source_id, bool_and(o_orderkey % 97 <> 1 AND o_orderkey % 89 <> 2 AND o_orderkey % 83 <> 3 AND o_orderkey % 79 <> 4 AND o_orderkey % 101 <> 5) AS complete
  FROM orders GROUP BY o_custkey""")
def payload_details(spark, sf_dir):
    table(spark, sf_dir, "orders")
    items = ITEMS.replace("{orders}", f"parquet.`{sf_dir}/orders.parquet`")
    return op.reconciled_details(spark.sql(items), spark.sql(DETAILS.replace("{items}", items)))
