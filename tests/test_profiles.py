"""A batch of profiles against each profile searched alone."""

import pytest
from pyspark.sql import functions as F

from findery.plans import search as PL
from findery.plans.profiles import rule_tables, search_profiles
from findery.rules import BestBet, FieldRule, RuleSet
from findery.workload import tables as T

TYPES = ("promo", "economy", "large", "standard", "small", "medium")
PROFILES = {
    "plain": RuleSet(fields=(FieldRule("nodename", 2.0, "prefix"), FieldRule("tags", 1.0, "wildcard")), include_content_types=TYPES),
    "Strict": RuleSet(fields=(FieldRule("nodename", 1.0, "fuzzy"), FieldRule("p_brand", 1.0, "exact")), include_content_types=TYPES,
                      operator="and", all_terms=True, fuzziness=0.5, page_size=3),
    "every": RuleSet(include_content_types=TYPES, exclude_types=("PROMO",), type_boosts=(("Large", 3.0),), page_size=7),
    "scoped": RuleSet(fields=(FieldRule("nodename"),), include_content_types=TYPES, root_ids=(2, 3, 4, 5, 6, 7, 8), excluded_ids=(4, 1010),
                      max_results=40, minimum_score=0.5, synonyms=(("red", "blue"),), stop_words=("bolt",),
                      best_bets=(BestBet(("red",), ("3", "7")),), blocked_terms=("green nut",), index_names=("Parts",)),
    "elsewhere": RuleSet(fields=(FieldRule("nodename"),), include_content_types=TYPES, index_names=("gone",)),
    "nothing": RuleSet(fields=(FieldRule("nodename"),)),
}
TERMS = ["red bolt", "blue", "green nut", "reb", "x", "bolt", "small brand#1", "", "steel screw"]


@pytest.fixture(scope="module")
def answers(spark, sf_dir):
    docs = T.docs_parts(spark, sf_dir)
    rows = [(i * 10 + k, term, alias.upper()) for i, alias in enumerate(PROFILES) for k, term in enumerate(TERMS)]
    queries = T.query_defaults(spark.createDataFrame([*rows, (999, "red", "unknown")], "query_id int, term string, profile_alias string"))
    index = PL.index_for(docs, RuleSet())
    return docs, queries, index, search_profiles(queries, docs, rule_tables(spark, PROFILES), index)


@pytest.mark.parametrize("alias", list(PROFILES))
def test_equals_each_profile_alone(answers, alias):
    docs, queries, index, found = answers
    own = queries.filter(F.lower("profile_alias") == alias.lower()).drop("profile_alias")
    alone = PL.search(own, docs, PROFILES[alias], index=index)
    columns = ["query_id", "doc_key", "score", "rank", "is_best_bet"]
    got = found.page.filter(F.lower("profile_alias") == alias.lower()).select(columns) if "profile_alias" in found.page.columns else None
    want = sorted(map(tuple, alone.page.select(columns).collect()))
    assert sorted(map(tuple, got.collect())) == want
    if alias in ("elsewhere", "nothing"):
        assert not want
    totals = {r.query_id: r.total for r in found.totals.collect()}
    assert all(totals[r.query_id] == r.total for r in alone.totals.collect())


def test_unknown_profiles_find_nothing(answers):
    assert 999 not in {r.query_id for r in answers[3].totals.collect()}


def test_scores_of_profiles_are_made_by_document(answers, monkeypatch):
    """Rows of query, document and word are gone, and hits that cannot repeat another meet no sort."""
    from findery.plans import profiles as PF

    docs, queries, index, found = answers
    assert PF.score_bm25.__module__ == "findery.operators.score"

    def meets(hits):
        raise AssertionError("all hits are sorted by node or key")

    monkeypatch.setattr(PF.ST, "merge_indexes_first_wins", meets)
    monkeypatch.setattr(PF.DD, "dedup_identity", meets)
    again = search_profiles(queries, docs, rule_tables(docs.sparkSession, PROFILES), index)
    columns = ["query_id", "doc_key", "score", "rank"]
    assert again.page.select(columns).exceptAll(found.page.select(columns)).isEmpty() and not again.page.isEmpty()
