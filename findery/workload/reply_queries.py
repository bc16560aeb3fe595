"""Registered queries: model replies and admission budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from findery.operators import replies as RP
from findery.operators.budget import admit_within_budget as admit
from findery.operators.terms import term_groups
from findery.rules import Facet, FacetRange, SortOption
from findery.workload import tables as T
from findery.workload.registry import register

FACETS = (
    Facet("brand", "p_brand", "Brand name"), Facet("Price", "p_retailprice", "", "numeric", (
        FacetRange("P-Low", "Cheap", "", "925"), FacetRange("p-mid", "", "925", "975"))),
    Facet("colour", "colour", enabled=False),
)
OPTIONS = (SortOption("newest", "Newest", "orderdate", "descending"), SortOption("hidden", "Hidden", "x", enabled=False))


def _flat(plans: DataFrame) -> DataFrame:
    filters = F.array_join(F.array_sort(F.transform(
        F.map_entries("filters"), lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], "|"))
    )), ";")
    return plans.select("query_id", "term", F.array_join("expansions", ",").alias("expansions"), filters.alias("filters"), "sort")


# What each of the eight reply shapes holds, worked out from the passage's words; a term has at most 300 characters.
_WORDS = r"""(SELECT item_id AS query_id, item_id % 8 AS kind, w, array_to_string(w, ' ') AS t,
  array_to_string(list_filter(w, lambda x, i: NOT list_contains(w[1:i - 1], x))[1:6], ',') AS u
  FROM (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w
        FROM benchmark))"""


@register(
    "parse_plan_replies",
    f"""SELECT query_id, CASE WHEN kind = 4 OR length(t) > 300 THEN '' ELSE t END AS term,
      CASE WHEN kind IN (0, 1, 2, 4) THEN u ELSE '' END AS expansions,
      CASE WHEN kind IN (0, 1, 2) THEN 'Brand=Brand#1|Brand#2|Brand#3;nothing=x;price=p-mid'
        WHEN kind = 4 THEN 'colour=red;price=p-low|none' WHEN kind = 7 THEN 'price=nowhere' ELSE '' END AS filters,
      CASE WHEN kind IN (0, 1, 2) THEN 'Newest' WHEN kind = 3 THEN 'hidden' END AS sort
    FROM {_WORDS} WHERE kind NOT IN (5, 6)""",
)
def parse_plan_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(RP.parse_plan_replies(T.plan_replies(spark, sf_dir)))


def _valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    plans = RP.parse_plan_replies(T.plan_replies(spark, sf_dir))
    return RP.validate_plan_filters(plans, FACETS, OPTIONS)


_VALID = f"""SELECT query_id, kind, CASE WHEN kind = 4 OR length(t) > 300 THEN '' ELSE t END AS term,
  CASE WHEN kind IN (0, 1, 2, 4) THEN u ELSE '' END AS expansions,
  CASE WHEN kind IN (0, 1, 2) THEN 'Price=p-mid;brand=Brand#1|Brand#2|Brand#3' WHEN kind = 4 THEN 'Price=P-Low' ELSE '' END AS filters,
  CASE WHEN kind IN (0, 1, 2) THEN 'newest' END AS sort
FROM {_WORDS} WHERE kind NOT IN (5, 6) AND NOT (kind IN (3, 7) AND length(t) > 300)"""


@register("validate_plan_filters", f"SELECT query_id, term, expansions, filters, sort FROM ({_VALID})")
def validate_plan_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(_valid(spark, sf_dir))


@register(
    "describe_plans",
    f"""SELECT query_id, array_to_string(list_filter([CASE WHEN term <> '' THEN 'term rewritten to "' || term || '"' END,
        CASE WHEN expansions <> '' THEN 'expanded with ' || replace(expansions, ',', ', ') END,
        CASE WHEN kind IN (0, 1, 2) THEN 'filter brand=Brand#1|Brand#2|Brand#3; filter Price=p-mid' WHEN kind = 4 THEN 'filter Price=P-Low' END,
        'sorted by ' || sort], lambda x: x IS NOT NULL), '; ') AS description,
      CASE WHEN kind IN (0, 1, 2) THEN 'Brand name: Brand#1, Brand#2, Brand#3; Price: p-mid' WHEN kind = 4 THEN 'Price: Cheap' ELSE '' END AS filters_label
    FROM ({_VALID})""",
)
def describe_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return RP.describe_plans(_valid(spark, sf_dir), FACETS)


def _own_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fourth visitor ticked a brand, every third chose a sort."""
    chosen = F.when(F.col("query_id") % 4 == 0, F.create_map(F.lit("BRAND"), F.array(F.lit("Brand#9")))).otherwise(
        F.create_map().cast("map<string,array<string>>")
    )
    rows = T.q_text(spark, sf_dir).select("query_id", "term")
    return T.query_defaults(rows.withColumns({
        "filters": chosen, "sort": F.when(F.col("query_id") % 3 == 0, "price").otherwise(" "),
    }))


@register(
    "apply_query_plan",
    f"""SELECT q.query_id, CASE WHEN v.term <> '' THEN v.term ELSE q.term END AS term, coalesce(v.expansions, '') AS expansions,
      array_to_string(list_sort(list_filter([CASE WHEN q.query_id % 4 = 0 THEN 'BRAND=Brand#9' WHEN v.kind IN (0, 1, 2) THEN 'brand=Brand#1|Brand#2|Brand#3' END,
        CASE v.kind WHEN 4 THEN 'Price=P-Low' WHEN 3 THEN NULL WHEN 7 THEN NULL WHEN 0 THEN 'Price=p-mid' WHEN 1 THEN 'Price=p-mid' WHEN 2 THEN 'Price=p-mid' END],
        lambda x: x IS NOT NULL)), ';') AS filters,
      CASE WHEN q.query_id % 3 = 0 THEN 'price' ELSE v.sort END AS sort
    FROM q_text q LEFT JOIN ({_VALID}) v ON v.query_id = q.query_id""",
)
def apply_query_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(RP.apply_query_plan(_own_queries(spark, sf_dir), _valid(spark, sf_dir)))


@register(
    "plan_expansions",
    f"""WITH p AS (SELECT q.query_id, CASE WHEN v.term <> '' THEN v.term ELSE q.term END AS term, v.expansions
        FROM (SELECT query_id, string_split(term, ' ')[1] AS term FROM q_text) q LEFT JOIN ({_VALID}) v ON v.query_id = q.query_id),
      w AS (SELECT query_id, term, expansions, unnest(range(len(string_split(term, ' ')))) AS group_no, unnest(string_split(term, ' ')) AS word FROM p)
    SELECT query_id, group_no, 0 AS variant_no, word AS variant FROM w
    UNION ALL SELECT query_id, 0, unnest(range(1, 1 + len(string_split(expansions, ',')))), unnest(string_split(expansions, ','))
      FROM w WHERE word = term AND expansions <> ''""",
)
def plan_expansions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expansions reach the words of one-word terms only."""
    queries = T.q_text(spark, sf_dir).withColumn("term", F.get(F.split("term", " "), F.lit(0)))
    return term_groups(RP.apply_query_plan(queries, _valid(spark, sf_dir)))


@register(
    "admit_within_budget",
    """WITH RECURSIVE e AS (SELECT event_id, user_id AS caller, epoch_us(ts) AS us FROM events),
    opens AS (
      SELECT caller, min(us) AS us FROM e GROUP BY caller
      UNION ALL
      SELECT o.caller, min(e.us) FROM opens o JOIN e ON e.caller = o.caller AND e.us >= o.us + 86400000000 GROUP BY o.caller
    ),
    placed AS (SELECT e.event_id, e.caller, e.us, max(o.us) AS opened FROM e JOIN opens o ON o.caller = e.caller AND o.us <= e.us
      GROUP BY ALL)
    SELECT event_id, 'all' AS stage, caller,
      row_number() OVER (PARTITION BY caller, opened ORDER BY us, event_id) <= 2 AS is_admitted FROM placed""",
)
def admit_within_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two events a day and caller."""
    return admit(T.budget_events(spark, sf_dir), 2, 86400)
