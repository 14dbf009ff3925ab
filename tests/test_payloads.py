"""Payloads that are missing, broken, empty or odd."""

import json

from vacloom.sources import payloads as op

SCHEMA = "source_id string, provider string, board_id string, payload string"
JOB = {"id": "1", "title": "Engineer", "location": "New York, United States", "jobUrl": "https://x.example.com/1"}


def rows(spark, *payloads):
    return spark.createDataFrame([(f"s{i}", p, "acme.jobs.personio.de", v) for i, (p, v) in enumerate(payloads)], SCHEMA)


def test_completeness(spark):
    given = [
        ("ashby", None, False), ("ashby", "{oops", False), ("ashby", "{}", False), ("ashby", '{"jobs":[]}', True), ("ashby", '{"jobs":{}}', False),
        ("ashby", json.dumps({"jobs": [JOB]}), True), ("ashby", json.dumps({"jobs": [JOB, {**JOB, "id": 2}]}), False), ("lever", "[]", True),
        ("lever", '{"jobs":[]}', False), ("personio", "<workzag-jobs></workzag-jobs>", True), ("personio", "{}", False), ("personio", None, False),
        ("workable", '{"results":[]}', True), ("smartrecruiters", "[{}]", False), ("recruitee", '{"offers":[null]}', False),
    ]
    found = {r.source_id: r.complete for r in op.completeness(rows(spark, *[(p, v) for p, v, _ in given])).collect()}
    assert found == {f"s{i}": complete for i, (_, _, complete) in enumerate(given)}


def test_fields_of_other_types_read_as_absent(spark):
    jobs = [{**JOB, "location": 7, "isRemote": "yes"}, {**JOB, "id": 3, "isRemote": True, "location": None}, {**JOB, "title": ["x"]}, "text", None]
    found = op.stated_postings(rows(spark, ("ashby", json.dumps({"jobs": jobs}))), "ashby").collect()
    assert [(r.external_id, r.title, r.location) for r in found][:3] == [("1", "Engineer", ""), ("3", "Engineer", ""), ("1", "", "New York, United States")]


def test_conflicting_ids_fail_their_source_only(spark):
    twice = json.dumps({"jobs": [JOB, JOB]})
    clash = json.dumps({"jobs": [JOB, {**JOB, "title": "Other"}]})
    found = op.postings(rows(spark, ("ashby", twice), ("ashby", clash)), "ashby").collect()
    assert [(r.source_id, r.external_id) for r in found] == [("s0", "1")]


def test_pages(spark):
    pages = [("a", 0, 100, 150, 100), ("a", 100, 100, 150, 50), ("b", 0, 100, 150, 100), ("c", 0, 100, 0, 0), ("d", 0, 100, 10, 10), ("d", 10, 100, 10, 0), ("e", 5, 100, 5, 5)]
    table = spark.createDataFrame(pages, "source_id string, page_start int, page_limit int, total int, items int")
    found = {r.source_id: r.complete for r in op.assembled_pages(table).collect()}
    assert found == {"a": True, "b": False, "c": True, "d": False, "e": False}


def test_a_payload_is_read_once_and_its_fields_are_not_read_in_filters(spark):
    found = op.postings(rows(spark, ("ashby", json.dumps({"jobs": [JOB]}))), "ashby")
    plan = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert sum("Generate posexplode" in line for line in plan) == 1
    assert not any("variant" in line for line in plan if line.lstrip(" :+-").startswith("Filter"))


def test_conflicts_and_repeats_across_payloads_of_a_source(spark):
    a, b = json.dumps({"jobs": [JOB]}), json.dumps({"jobs": [{**JOB, "title": "Other"}]})
    given = [("s", a), ("s", b), ("t", a), ("t", a), (None, a), (None, b)]
    payloads = spark.createDataFrame([(s, "ashby", "b", p) for s, p in given], SCHEMA)
    found = sorted((r.source_id or "", r.title) for r in op.postings(payloads, "ashby").collect())
    assert found == [("", "Engineer"), ("", "Other"), ("t", "Engineer")]


def test_locations_of_a_grouped_posting(spark):
    job = {"shortcode": "S1", "title": "Engineer", "url": "https://apply.workable.com/a/j/S1", "country": "US"}
    jobs = [{**job, "locations": [{"city": "Boston"}, {"city": "Paris", "country": "France"}]}, {**job, "location": {"location_str": "Austin, USA"}}, {**job, "city": "Boston"}]
    found = op.stated_postings(rows(spark, ("workable", json.dumps({"jobs": jobs}))), "workable").collect()
    assert [(r.external_id, r.location) for r in found] == [("S1", "Boston, US; Austin, USA")]
