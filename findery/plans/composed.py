"""A search with everything a results page shows, composed from one set of shared rows.

Matching runs once. Fetched, scored and surviving rows are written, and page, totals, facets, groups and diagnostics are
taken from them; texts are read for the rows of the page alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from findery.operators import describe as DS, filters as FL, rank as R, terms as TM
from findery.operators.postings import SearchIndex
from findery.plans import search as PL
from findery.rules import RuleSet

#: How many rows a re-ranking may concern.
LEAST_RERANKED, MOST_RERANKED = 5, 50


@dataclass(frozen=True)
class Response:
    """``page`` the described rows in their order, ``totals`` a row a query; the others where the rules ask for them."""

    page: DataFrame
    totals: DataFrame
    facets: DataFrame | None
    groups: DataFrame | None
    diagnostics: DataFrame | None
    suggestions: DataFrame | None


def by_relevance(rules: RuleSet) -> Column:
    """Whether a query is sorted by relevance: no sort is asked for, or one without a field or by the score."""
    other = [o.alias.lower() for o in rules.sort_options if o.field.strip() and o.field.strip().lower() != R.RELEVANCE]
    asked = F.lower(F.trim(F.coalesce("sort", F.lit(""))))
    return ~asked.isin(other) if other else F.lit(True)


def rerankable(queries: DataFrame, rules: RuleSet) -> DataFrame:
    """Queries whose page may be re-ordered: the first page of a term, by relevance."""
    first = F.coalesce("page", F.lit(1)) <= 1
    return queries.filter(first & (F.trim(F.coalesce("term", F.lit(""))) != "") & by_relevance(rules))


def deepened(queries: DataFrame, rules: RuleSet, depth: int) -> DataFrame:
    """The queries with pages deep enough for re-ranking where it may happen, and ``_shown``, the rows to show."""
    sizes = R.wanted_pages(queries, rules.page_size, rules.browse_page_size).select("query_id", F.col("_size").alias("_shown"))
    eligible = rerankable(queries, rules).select("query_id", F.lit(True).alias("_deep"))
    rows = queries.join(sizes, "query_id").join(eligible, "query_id", "left")
    return rows.withColumn("page_size", F.when(F.col("_deep"), F.greatest("_shown", F.lit(depth))).otherwise(F.col("page_size"))).drop("_deep")


def reranked(page: DataFrame, queries: DataFrame, shown: DataFrame, replies: DataFrame, rules: RuleSet, depth: int) -> DataFrame:
    """The page with the replies' order where one may apply, cut to the rows that are shown."""
    allowed = replies.join(rerankable(queries, rules).select("query_id"), "query_id", "left_semi")
    ordered = R.apply_rerank(page, allowed, depth)
    first = F.coalesce("page", F.lit(1)) <= 1
    sizes = shown.select("query_id", "_shown", first.alias("_first"))
    # A later page was never deepened: its ranks start behind the pages before it.
    return ordered.join(sizes, "query_id").filter(~F.col("_first") | (F.col("rank") <= F.col("_shown"))).drop("_shown", "_first")


def curated_totals(totals: DataFrame, page: DataFrame, queries: DataFrame) -> DataFrame:
    """Totals of browse queries that show picked documents: all of them on one page."""
    browse = queries.filter(R.is_browse()).select("query_id")
    picked = page.join(browse, "query_id", "left_semi").groupBy("query_id").agg(F.count(F.lit(1)).alias("_picked"))
    rows = totals.join(picked, "query_id", "left")
    own = {"total": F.col("_picked"), "page": F.lit(1), "page_size": F.col("_picked"), "total_pages": F.lit(1), "has_more": F.lit(False)}
    kinds = dict(totals.dtypes)
    return rows.withColumns({
        c: F.when(F.col("_picked").isNotNull(), value.cast(kinds[c])).otherwise(F.col(c)) for c, value in own.items()
    }).drop("_picked")


def described(page: DataFrame, docs: DataFrame, query_terms: DataFrame, rules: RuleSet, structured: bool = True) -> DataFrame:
    """Page rows with title, summary, dates and type label. A matched snippet is the summary; other rows describe themselves."""
    rows = DS.resolve_titles(PL.with_texts(page, docs), rules.title_fields, structured)
    if rules.highlight:
        h = rules.highlight
        names = PL.searched_names(rules) or list(TM.FALLBACK_FIELDS)
        sources = DS.snippet_source(rows, query_terms, names, h.field or None, structured)
        cut = DS.snippet_window(sources, h.length) if h.mode == "window" else DS.snippet_sentence(sources, h.length, h.context)
        tags = (h.start_tag, h.end_tag) if h.mark else ("", "")
        marked = DS.highlight_matches(cut, *tags)
        keys = ["query_id", "index_name", "doc_key"]
        rows = rows.join(marked.select(*keys, F.col("highlight").alias("summary")), keys, "left")
    rows = DS.describe_hits(rows, rules.description_fields, rules.description_length, structured)
    rows = DS.type_labels(rows, dict(rules.type_labels))
    return FL.trim_fields(rows, rules.return_fields)


def diagnostics(found: PL.SearchResult, words: DataFrame, query_terms: DataFrame) -> DataFrame:
    """Per query: rows after each step, what each removed, and the indexes, fields, terms and clauses searched."""
    counted = None
    for name, frame in found.stages.items():
        counts = frame.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).withColumn("stage", F.lit(name))
        counted = counts if counted is None else counted.unionByName(counts)
    left = {n: F.coalesce(F.sum(F.when(F.col("stage") == n, F.col("n"))), F.lit(0)) for n in found.stages}
    names = list(found.stages)
    removed = dict(zip(names[1:], ("removed_by_sources", "removed_by_facets", "removed_by_score", "removed_as_duplicates"), strict=True))
    totals = counted.groupBy("query_id").agg(
        left["fetched"].alias("fetched"), *[(left[a] - left[b]).alias(removed[b]) for a, b in zip(names, names[1:])], left["kept"].alias("kept"),
    )
    clause = words.groupBy("query_id", "index_name", "rule_no", "field", "match_mode", "boost").agg(
        F.array_join(F.array_sort(F.collect_set("variant")), " ").alias("asked"))
    text = F.concat("field", F.lit(":("), "asked", F.lit(")"), F.when(F.col("match_mode") != "exact", F.concat(F.lit(" "), "match_mode")).otherwise(""),
                    F.lit("^"), F.col("boost").cast("string"))
    searched = clause.groupBy("query_id").agg(
        F.array_join(F.array_sort(F.collect_set("index_name")), ",").alias("indexes"),
        F.array_join(F.array_sort(F.collect_set("field")), ",").alias("fields"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("index_name", "rule_no", "field", text.alias("text")))), lambda c: c["text"]), "; ").alias("clauses"),
    )
    terms = query_terms.groupBy("query_id").agg(F.array_join(F.array_sort(F.collect_set(F.lower("variant"))), ",").alias("terms"))
    return searched.join(terms, "query_id", "full").join(totals, "query_id", "full").fillna(0)


def compose(
    queries: DataFrame, docs: DataFrame, rules: RuleSet, as_of: str | None = None, *, index: SearchIndex | None = None,
    replies: DataFrame | None = None, protected: DataFrame | None = None, node_keys: DataFrame | None = None,
    explain: bool = False, spelling_below: int | None = None, structured: bool = True,
) -> Response:
    """Results, totals, facets, groups, diagnostics and corrections of every query.

    ``replies`` holds re-ranking replies; they act on first pages by relevance. ``spelling_below`` asks for a correction
    of queries with no more results than that.
    """
    index = index or PL.index_for(docs, rules)
    depth = min(max(rules.rerank_depth, LEAST_RERANKED), MOST_RERANKED) if rules.rerank_depth > 0 and replies is not None else 0
    asked = deepened(queries, rules, depth) if depth else queries
    found = PL.search(asked, docs, rules, as_of, index=index, protected=protected, node_keys=node_keys, shared=True)
    page, totals = found.page, found.totals
    if depth:
        page = reranked(page, queries, asked, replies, rules, depth)
        totals = R.page_slice(found.hits, queries, rules.page_size, rules.browse_page_size)[1]
    if rules.curated:
        forward = PL.forward_of(docs, rules, index)
        page = R.curated_browse(page, queries, forward.attributes(rules), rules.curated)
        if not forward.rows.filter(F.lower("doc_key").isin([k.strip().lower() for k in rules.curated])).isEmpty():
            totals = curated_totals(totals, page, queries)
    query_terms = TM.term_groups(queries, rules.stop_words, rules.synonyms)
    suggestions = None
    if spelling_below is not None:
        suggestions = PL.suggest_spelling(queries, totals, docs, rules, threshold=spelling_below)
    explained = None
    if explain:
        explained = diagnostics(found, PL.query_words(PL.runnable(queries, rules, index).filter(~R.is_browse()), rules, index), query_terms)
    return Response(
        described(page, docs, query_terms, rules, structured), totals, found.facets,
        R.group_counts(found.hits) if rules.group_by_type else None, explained, suggestions,
    )
