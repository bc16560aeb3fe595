"""Worked examples, one string at a time."""

import pytest
from pyspark.sql import functions as F

from findery.functions import dates as D, paths as P, text as T
from findery.operators.describe import HighlightStyle, css_colour, mark_tag
from findery.operators.extract import culture_of, is_candidate

NOW = "2024-02-01 00:00:00"


def one(spark, make, *values):
    frame = spark.createDataFrame([values], [f"c{i}" for i in range(len(values))])
    return frame.select(make(*[F.col(f"c{i}") for i in range(len(values))]).alias("v")).first()["v"]


@pytest.mark.parametrize("raw, clean", [
    ("one</p><p>two", "one two"), ("a &amp;lt; b &#233;&#xE9;&copy;&nope; x&nbsp;y", "a &lt; b éé©&nope; x y"),
    ("<b>x", "x"), ("  3 > 2\n\t<i>yes</i> ", "3 2 yes"), ("<script>var a;</script>t", "var a; t"), ("a<unclosed", "a"),
])
def test_clean_text(spark, raw, clean):
    assert one(spark, T.clean_text, raw) == clean


def test_short_label_is_not_prose(spark):
    assert one(spark, T.word_count, "Home page-square text layout") == 4
    assert one(spark, T.word_count, "  \n ") == 0


@pytest.mark.parametrize("raw, stamp", [
    ("20260820155959000", "2026-08-20 15:59:59"), ("20260820", "2026-08-20 00:00:00"), ("202608201559", "2026-08-20 15:59:00"),
    ("638000000000000000", "2022-09-28 22:13:20"), ("1234567890", "2009-02-13 23:31:30"),
    ("2024-02-03T04:05:06", "2024-02-03 04:05:06"), ("12", None), ("20261399", None), ("soon", None),
])
def test_parse_date(spark, raw, stamp):
    assert one(spark, lambda c: F.date_format(D.parse_date(c), "yyyy-MM-dd HH:mm:ss"), raw) == stamp


@pytest.mark.parametrize("raw, stamp", [
    ("now", "2024-02-01"), ("now-30d", "2024-01-02"), ("NOW+1m", "2024-03-01"), ("now-2w", "2024-01-18"), ("nowhere", None),
])
def test_date_bound(spark, raw, stamp):
    assert one(spark, lambda c: F.date_format(D.date_bound(c, NOW), "yyyy-MM-dd"), raw) == stamp


@pytest.mark.parametrize("label, bounds", [
    ("25-50", (25, 50)), ("under 25", (None, 25)), ("over 100", (100, None)), ("100+", (100, None)),
    ("less-than 5", (None, 5)), ("blue", (None, None)),
])
def test_inferred_numbers(spark, label, bounds):
    assert tuple(one(spark, lambda a, b: D.inferred_numbers(a, b), "band", label)) == bounds


def test_loose_week_pattern(spark):
    found = one(spark, lambda a: D.inferred_dates(a, F.lit(""), NOW), "27d")
    assert str(found["lower"]) == "2024-01-25 00:00:00"


@pytest.mark.parametrize("field, culture", [
    ("title_en-gb", "en-gb"), ("body_text", ""), ("body_en", "en"), ("a_engl", ""), ("x_en-latn", "en-latn"), ("_en", ""),
])
def test_culture_of(spark, field, culture):
    assert one(spark, culture_of, field) == culture


def test_excluded_field_with_culture(spark):
    assert one(spark, lambda f, c: is_candidate(f, c), "title_en-gb", "en-gb") is False
    assert one(spark, lambda f, c: is_candidate(f, c), "Body_en-GB", "en-gb") is True


@pytest.mark.parametrize("raw, path", [("/A/B/?x=1", "/a/b"), ("//host/x", ""), ("a/", "/a"), ("/", "/"), (" #top", "")])
def test_normalize_path(spark, raw, path):
    assert one(spark, P.normalize_path, raw) == path


def test_terms_and_labels(spark):
    assert one(spark, T.normalize_term, "  Blue   Widget ") == "blue widget"
    assert one(spark, lambda c: T.shorten(c, 8), "3 > 2 <i>yes</i>") == "3 > 2..."
    assert css_colour("url(x)") is None and css_colour("#ABC") == "#abc"
    assert mark_tag(HighlightStyle()) == (
        '<mark style="color:#15803d;background:transparent;font-weight:700;text-decoration:none">'
    )


def test_extraction_cleans_a_value_once(spark):
    """Equal values of a document, its cultures and the filter on empty texts share one cleaning."""
    from findery.operators.extract import extracted_content

    docs = spark.createDataFrame(
        [("main", "1", {"body": "one  two\t three four five &amp; six", "body_en": "one  two\t three four five &amp; six"}),
         ("main", "2", {"body": "too short"}), ("main", "3", None)],
        "index_name string, doc_key string, fields map<string,string>",
    )
    found = extracted_content(docs, structured=False)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("<[^>]*>?|>") == 1
    text = "one two three four five & six"
    assert sorted((r.doc_key, r.culture or "", r.text) for r in found.collect()) == [("1", "", text), ("1", "en", text)]


def test_extracting_a_batch_keeps_every_document_without_a_second_pass(spark):
    """A document without text stays as a row of its own, also beside a row of the same key that has one."""
    from findery.streaming.content import extract_batch

    docs = spark.createDataFrame(
        [("main", "1", {"body": "one two three four five six"}), ("main", "1", {"body": "short"}), ("main", "2", {"body": " "}), ("main", "3", None)],
        "index_name string, doc_key string, fields map<string,string>",
    )
    found = extract_batch(docs, structured=False)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.doc_key, r.text or "") for r in found.collect()) == [("1", ""), ("1", "one two three four five six"), ("2", ""), ("3", "")]
    assert sorted(map(str, extract_batch(docs).collect())) == sorted(map(str, found.collect()))
