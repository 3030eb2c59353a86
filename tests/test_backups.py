"""Envelopes that can't be read, odd items, unknown and repeated references."""

import json

from folio.sources import backups
from folio.sources.stored import stored
from pyspark.sql import functions as F


def ref(law="L", number="1", **more):
    return {"lawId": law, "articleNumberNormalized": number, **more}


ENVELOPES = {
    "whole": {
        "practiceTopics": [{"name": "by name", "articleRefs": [ref(), ref(), ref(number="9"), "odd", None]}, {"label": "none", "articleRefs": [ref()]}, 7, {"slug": 5, "name": "n"}],
        "drawingNoteTemplates": [ref(title="t"), ref(number=1), {}], "packs": [{"items": [ref(), ref(number="2")]}, {"items": [ref()]}, {"items": "none"}],
        "projects": [{"name": "p", "siteArea": 1.5, "checkItems": [ref(), ref()]}], "highlights": [ref(rangeStart=4, color=None)], "tags": [ref(tagName="a"), ref(tagName="a"), ref(tagName="b"), ref(tagName=""), ref()],
        "activities": [{"type": "view"}, {"type": "other"}, {}], "articleCooccurrences": [{"source": ref(), "related": ref(number="2")}, {"source": ref(), "related": ref(number="9")}, {"source": ref()}],
    },
    "empty": {}, "lists": {"packs": None, "tags": "x"},
}


def test_sections_of_envelopes(spark):
    rows = [(k, json.dumps(v)) for k, v in ENVELOPES.items()] + [("cut", '{"packs": ['), ("array", "[1]"), ("null", None), ("text", '"x"')]
    items = stored(backups.laid_out(spark.createDataFrame(rows, "id string, json string")).withColumn("key", F.monotonically_increasing_id()), "items")
    articles = spark.createDataFrame([("L", "1", "t1"), ("L", "2", "t2")], "law string, number string, target string")
    found = backups.judged(items, articles)
    by = {}
    for r in found.collect():
        by.setdefault(r.section, []).append((r.envelope, r.parent, r.place, r.outcome))
    outcomes = {s: [x[3] for x in sorted(v, key=lambda x: (x[0], x[1] or 0, x[2]))] for s, v in by.items()}
    unknown = "UNKNOWN_REFERENCE"
    assert outcomes == {
        "practiceTopics": ["imported", "MISSING_TEXT", "imported"], "articlePracticeTopics": ["imported", "DUPLICATE", unknown, "NO_PARENT"], "drawingNoteTemplates": ["imported", unknown, unknown],
        "packs": ["imported"] * 3, "packItems": ["imported"] * 3, "projects": ["imported"], "checkItems": ["imported"] * 2, "highlights": ["imported"],
        "tags": ["imported", "DUPLICATE", "imported", "MISSING_TEXT", "MISSING_TEXT"], "activities": ["imported", "UNKNOWN_VALUE", "MISSING_TEXT"], "articleCooccurrences": ["imported", unknown, unknown],
        "envelope": ["UNREADABLE"] * 4,
    }
    assert sorted(x[0] for x in by["envelope"]) == ["array", "cut", "null", "text"]
    projects = backups.values(found, "projects", {"name": "string", "siteArea": "double", "floors": "int"}).collect()
    assert [(r.name, r.siteArea, r.floors) for r in projects] == [("p", 1.5, None)]
    assert [(r.targets, r.rangeStart) for r in backups.values(found, "highlights", {"rangeStart": "int"}).collect()] == [(["t1"], 4)]
    assert sorted(map(tuple, backups.references(items).collect())) == [("L", "1"), ("L", "2"), ("L", "9")]


def test_references_are_looked_up_in_place(spark):
    """No list of targets is put together again from its parts; items that name nothing, many of them, are not one key of the join."""
    envelope = {"activities": [{"type": "view"}] * 300, "articleCooccurrences": [{"source": ref(number="2"), "related": ref()}, {"source": ref(number="8"), "related": ref()}], "tags": [ref(number="2", tagName="a")]}
    items = stored(backups.laid_out(spark.createDataFrame([(1, json.dumps(envelope))], "id int, json string")).withColumn("key", F.monotonically_increasing_id()), "items")
    articles = spark.createDataFrame([("L", "1", "t1"), ("L", "2", "t2")], "law string, number string, target string")
    found = backups.judged(items, articles)
    assert "Aggregate" not in found._jdf.queryExecution().optimizedPlan().toString()
    told = {(r.section, r.place): (r.targets, r.outcome) for r in found.filter("section <> 'activities'").collect()}
    assert told == {("articleCooccurrences", 0): (["t2", "t1"], "imported"), ("articleCooccurrences", 1): ([None, "t1"], "UNKNOWN_REFERENCE"), ("tags", 0): (["t2"], "imported")}
    assert found.filter("section = 'activities' and outcome = 'imported' and size(targets) = 0").count() == 300
