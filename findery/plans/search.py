"""Whole searches: a table of queries against a frame of documents.

Only keys and scores travel through matching and the fetch window. What the rules need of a
document (flags, dates, facet and sort fields) comes from the index's columns and joins the windowed rows; its texts
join the page. Scored rows are written once, and page, totals and facets are taken from them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from findery.functions import fields as X
from findery.functions.text import tokens
from findery.operators import dedup as DD, facets as FC, filters as FL, rank as R, sets as ST, suggest as SG
from findery.operators import terms as TM
from findery.operators.forward import PLACE, ForwardIndex, build_forward
from findery.operators.match import match_words
from findery.operators.postings import SearchIndex, build_postings
from findery.operators.score import fetch_window, score_bm25, score_documents
from findery.rules import FieldRule, RuleSet
from findery.session import store

#: Documents that may be broadcast to hits, and what a page reads of them after its rows are chosen.
BROADCAST_DOCS = 50_000
LATE = ["node_id", "name", "type_alias", "index_type", "path", "culture", "create_date", "update_date", "fields"]


@dataclass(frozen=True)
class SearchResult:
    """``scored`` all rows before facet filters, ``hits`` the survivors, ``page`` each query's rows with their rank,
    ``totals``, ``facets`` or null; ``stages`` the rows left after each step, in order."""

    scored: DataFrame

    hits: DataFrame
    page: DataFrame
    totals: DataFrame
    facets: DataFrame | None
    stages: dict[str, DataFrame]


def searched_names(rules: RuleSet) -> list[str]:
    return [r.name.strip().lower() for r in rules.fields if r.enabled and r.name.strip()]


def match_modes(rules: RuleSet) -> set[str]:
    # A term may itself hold several tokens (a hyphen), whose first ones match exactly.
    named = {r.match_mode for r in rules.fields if r.enabled and r.name.strip()}
    return (named or {"prefix"}) | {"exact"}


def index_for(docs: DataFrame, rules: RuleSet, cultures: bool = True) -> SearchIndex:
    """Postings of the fields the rules search (every searchable one, where they name none) and the columns they read,
    stored before they are used.

    ``cultures=False`` states that no search asks for a culture, so variants are left out. A site searched again and again keeps its index with ``SearchIndex.write`` and passes it in.
    """
    postings = build_postings(docs, searched_names(rules), cultures or bool(rules.cultures))
    return postings.with_forward(docs, rules).stored(match_modes(rules) != {"exact"})


def windows_index(docs: DataFrame, rules: RuleSet, cultures: bool = True) -> SearchIndex:
    """``index_for`` without the columns that filters and orders read, which fetched windows do not need."""
    return build_postings(docs, searched_names(rules), cultures or bool(rules.cultures)).stored(match_modes(rules) != {"exact"})


def runnable(queries: DataFrame, rules: RuleSet, index: SearchIndex) -> DataFrame:
    """The queries a search is carried out for."""
    classed = TM.classify_queries(queries, rules, index.stats)
    return classed.filter("status = 'ok'").drop("status")


def query_words(queries: DataFrame, rules: RuleSet, index: SearchIndex) -> DataFrame:
    """Every word of every query in every field it searches, with its match mode.

    A synonym of several words matches by each of them; only the last takes the field's mode.
    """
    counted = queries.withColumn("n_groups", F.size(TM.kept_words(F.col("term"), rules.stop_words)))
    groups = TM.term_groups(counted, rules.stop_words, rules.synonyms, ("cultures", "n_groups"))
    parts = groups.withColumn("_tokens", tokens(F.col("variant")))
    words = parts.select(
        "query_id", "cultures", "n_groups", "group_no", F.size("_tokens").alias("_size"),
        F.posexplode("_tokens").alias("_pos", "word"),
    )
    rows = TM.search_fields(words, rules, index.stats)
    mode = F.when(F.col("_pos") == F.col("_size") - 1, F.col("match_mode")).otherwise("exact")
    return rows.select(
        "query_id", "index_name", "field", "group_no", F.col("word").alias("variant"),
        mode.alias("match_mode"), "boost", "rule_no", "n_groups", "n_fields",
    )


def _matching(queries: DataFrame, rules: RuleSet, index: SearchIndex) -> tuple:
    """What scores are made of: the queries' words, how they match, the postings that types let through, and statistics."""
    words = query_words(queries, rules, index)
    modes = match_modes(rules)
    gated = index.postings.filter(FL.type_included(rules) & FL.type_not_excluded(rules))

    def match(asked: DataFrame) -> DataFrame:
        vocab = index.vocab
        if modes == {"exact"} and index.counts is not None:
            vocab = index.vocab_of(asked.select(F.lower("variant").alias("term")).distinct())
        return match_words(asked, vocab, modes, rules.fuzziness, index.keys)

    return words, match, gated, index.stats


def scored_matches(queries: DataFrame, rules: RuleSet, index: SearchIndex, n: int | None = None) -> DataFrame:
    """(query_id, index_name, doc_key, raw_score) before any window; with ``n`` at least what a window of ``n`` takes."""
    return score_bm25(*_matching(queries, rules, index), rules.all_terms, rules.operator, n)


def forward_of(docs: DataFrame, rules: RuleSet, index: SearchIndex) -> ForwardIndex:
    """The index's own columns where they hold all that the rules read; otherwise the documents' field maps."""
    kept = index.forward
    return kept if kept is not None and kept.covers(rules) else build_forward(docs, rules)


def browse_all(queries: DataFrame, docs: DataFrame, rules: RuleSet) -> DataFrame:
    """Empty searches see every document of the profile, or the first ``window`` per index if one is set.

    Each query meets the documents share by share, so the listing of one query is many tasks' work.
    """
    gated = FL.type_exclude(FL.type_gate(docs, rules), rules)
    if rules.index_names:
        gated = gated.filter(F.lower("index_name").isin([n.lower() for n in rules.index_names]))
    first = gated.select("index_name", "doc_key")
    if rules.window is None:
        first = first.withColumn("fetch_rank", F.lit(None).cast("int"))
    else:
        order = Window.partitionBy("index_name").orderBy("doc_key")
        first = first.withColumn("fetch_rank", F.row_number().over(order)).filter(F.col("fetch_rank") <= rules.window)
    # As many shares as shuffle partitions, which grow with the data.
    count = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shares = F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    browse = queries.filter(R.is_browse()).select("query_id", shares.alias("_share"))
    rows = first.withColumn("_share", F.pmod(F.xxhash64("doc_key"), F.lit(count)).cast("int"))
    return browse.join(rows, "_share").select("query_id", "index_name", "doc_key", F.lit(0.0).alias("raw_score"), "fetch_rank")


def windowed(queries: DataFrame, docs: DataFrame, rules: RuleSet, index: SearchIndex, browse: bool | None = None) -> DataFrame:
    """Rows of every query's fetch windows. Browse queries join in where the query table has any; the caller may say so."""
    ok = runnable(queries, rules, index)
    found = fetch_window(scored_matches(ok.filter(~R.is_browse()), rules, index, rules.window), rules.window)
    if browse is None:
        browse = not queries.filter(R.is_browse()).isEmpty()
    if browse:
        found = found.unionByName(browse_all(ok, docs, rules))
    return found


def windowed_with(
    queries: DataFrame, docs: DataFrame, rules: RuleSet, index: SearchIndex, known: DataFrame, browse: bool | None = None,
) -> tuple[DataFrame, DataFrame]:
    """``windowed``, and its rows with what is ``known`` of their documents, which are all different.

    Where every row is fetched, documents meet what is known of them before the queries, so that no row of a query moves.
    """
    if rules.window is not None:
        rows = windowed(queries, docs, rules, index, browse)
        return rows, rows.join(known, PLACE)
    ok = runnable(queries, rules, index)
    found = score_documents(*_matching(ok.filter(~R.is_browse()), rules, index), known, rules.all_terms, rules.operator)
    rows, joined = (fetch_window(f) for f in found)
    joined = joined.select(*PLACE, *[c for c in rows.columns if c not in PLACE], *[F.col(f"`{c}`") for c in known.columns if c not in PLACE])
    if browse is None:
        browse = not queries.filter(R.is_browse()).isEmpty()
    if browse:
        listed = browse_all(ok, docs, rules)
        rows, joined = rows.unionByName(listed), joined.unionByName(listed.join(known, PLACE))
    return rows, joined


def sources(rows: DataFrame, rules: RuleSet, protected: DataFrame | None = None) -> DataFrame:
    """Documents, or hits with their documents' attributes, that the profile's sources let through."""
    rows = FL.filter_subtree(rows, rules.root_ids)
    rows = FL.filter_excluded_nodes(rows, rules.excluded_ids, rules.exclude_descendants)
    flags = [X.NAVI_HIDE] if rules.respect_navi_hide else []
    rows = FL.filter_flags(rows, [*flags, *rules.hide_fields])
    if rules.published_only:
        rows = FL.filter_published(rows)
    return rows if protected is None else FL.filter_protected(rows, protected)


def all_different(docs: DataFrame, queries: DataFrame) -> bool:
    """Whether no two documents share a node or a key and no two queries an id: then no hit can repeat another."""
    node = F.concat_ws("\u0001", F.lit("node"), F.coalesce(F.col("node_id").cast("string"), F.lit("")), "index_type")
    key = F.concat_ws("\u0001", F.lit("key"), DD.identity())
    keys = docs.select(F.explode(F.array(node, key)).alias("key"))
    keys = keys.unionByName(queries.select(F.concat_ws("\u0001", F.lit("query"), "query_id").alias("key")))
    return keys.groupBy("key").count().filter("count > 1").isEmpty()


def sized(docs: DataFrame) -> DataFrame:
    """A stored table of documents; a large one is not broadcast, as its files are far smaller than its rows."""
    kept = store(docs)
    return kept.hint("merge") if kept.count() > BROADCAST_DOCS else kept


def ranked_hits(
    hits: DataFrame, queries: DataFrame, rules: RuleSet, as_of: str | None, protected: DataFrame | None = None,
    different: bool = False,
) -> DataFrame:
    """Fetched rows merged, source-filtered and scored: what facets are counted on.

    ``hits`` hold what the rules need of each document. Where all are ``different``, they are those of the sources alone and
    no row needs merging. No step gathers a query's rows: they are placed by document, by node and by key.
    """
    if not different:
        hits = sources(ST.merge_indexes_first_wins(hits), rules, protected)
    hits = R.boost_types(hits, rules.type_boosts)
    if rules.recency:
        r = rules.recency
        hits = R.boost_recency(hits, r.field, r.half_life_days, r.weight, as_of=as_of)
    hits = hits.withColumns({"score": F.round("score", 6), "is_best_bet": F.lit(False)})
    return R.pin_best_bets(hits, TM.term_groups(queries, rules.stop_words, rules.synonyms), rules.best_bets)


def paged(
    hits: DataFrame, queries: DataFrame, page_size: int, browse_page_size: int, order: list[Column] | None = None, docs: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Pages and totals. With ``docs`` only what the order needs travels, and rows of a page get their documents' attributes there."""
    if docs is None:
        return R.page_slice(hits, queries, page_size, browse_page_size, order)
    late = [c for c in LATE if c in hits.columns]
    page, totals = R.page_slice(hits.drop(*late), queries, page_size, browse_page_size, order)
    return page.join(docs.select(*PLACE, *late), PLACE).select(*hits.columns, "rank"), totals


def search(
    queries: DataFrame, docs: DataFrame, rules: RuleSet, as_of: str | None = None, *,
    index: SearchIndex | None = None, protected: DataFrame | None = None,
    node_keys: DataFrame | None = None, browse: bool | None = None, cultures: bool = True, shared: bool = False,
) -> SearchResult:
    """The whole search, in the order its results depend on: window, source rules, boosts, facet
    counts, facet filters, score floor, de-duplication, sort, page.

    ``shared`` also writes the fetched rows and the survivors once, for results that several frames are taken from.
    """
    keep = store if shared else (lambda frame: frame)
    index = index or index_for(docs, rules, cultures)
    forward = forward_of(docs, rules, index)
    known, different = forward.attributes(rules), all_different(forward.rows, queries)
    if different:
        # What concerns documents alone is decided before they meet the hits.
        known = sized(sources(known, rules, protected))
    if different and not shared:
        rows, joined = windowed_with(queries, forward.rows, rules, index, known, browse)
    else:
        rows = keep(windowed(queries, forward.rows, rules, index, browse))
        joined = rows.join(known, PLACE)
    scored = store(ranked_hits(joined, queries, rules, as_of, protected, different))
    hits, facets = scored, None
    if rules.facets:
        facets = FC.facet_counts_excluding_self(scored, queries, rules.facets, as_of=as_of, node_keys=node_keys)
        hits = FC.apply_facet_filters(
            hits, queries, rules.facets, rules.minimum_active_filters, as_of=as_of, node_keys=node_keys
        )
    narrowed = hits
    hits = relevant = FL.filter_min_score(hits, rules.minimum_score, queries.filter(R.is_browse()))
    if rules.deduplicate:
        if not different:
            hits = DD.dedup_identity(hits)
        if rules.dedup_field:
            hits = DD.dedup_by_field(hits, rules.dedup_field)
    if hits is not scored:
        hits = keep(hits)
    order, placed = R.rank_order(), hits
    if rules.sort_by:
        order = R.sort_order(hits, rules.sort_by, order[1:])
    if rules.sort_options:
        placed = R.with_sort_alias(hits, queries, rules.sort_options)
        order = R.option_order(placed, rules.sort_options, order[1:])
    page, totals = paged(placed, queries, rules.page_size, rules.browse_page_size, order, known if different else None)
    stages = {"fetched": rows, "sources": scored, "facets": narrowed, "score": relevant, "kept": hits}
    return SearchResult(scored, hits, page.drop("sort_alias"), totals, facets, stages)


def with_texts(page: DataFrame, docs: DataFrame) -> DataFrame:
    """Page rows with their documents' whole field maps, for description."""
    return page.drop("fields").join(docs.select(*PLACE, "fields"), PLACE)


def search_batch(
    queries: DataFrame, docs: DataFrame, rules: RuleSet, as_of: str | None = None, *,
    index: SearchIndex | None = None, browse: bool | None = None, cultures: bool = True,
) -> DataFrame:
    """Each query's result page as rows in rank order."""
    return search(queries, docs, rules, as_of, index=index, browse=browse, cultures=cultures).page


def name_rules(rules: RuleSet, mode: str, fuzziness: float, n: int) -> RuleSet:
    """The profile's scope with nothing but names searched."""
    return RuleSet(
        fields=(FieldRule(X.NODE_NAME, 2.0, mode), FieldRule(X.SYSTEM_NODE_NAME, 1.0, mode)),
        fuzziness=fuzziness, minimum_length=1, stop_words=rules.stop_words, synonyms=rules.synonyms,
        blocked_terms=rules.blocked_terms, index_names=rules.index_names,
        include_content_types=rules.include_content_types, include_media_types=rules.include_media_types,
        include_members=rules.include_members, exclude_types=rules.exclude_types, cultures=rules.cultures,
        root_ids=rules.root_ids, excluded_ids=rules.excluded_ids, exclude_descendants=rules.exclude_descendants,
        respect_navi_hide=rules.respect_navi_hide, hide_fields=rules.hide_fields,
        published_only=rules.published_only, page_size=n, max_results=n,
    )


def search_names_only(
    queries: DataFrame, docs: DataFrame, rules: RuleSet, mode: str = "prefix", fuzziness: float = 0.8,
    n: int = 50, index: SearchIndex | None = None,
) -> DataFrame:
    """Name hits of each query: (query_id, index_name, doc_key, name, score, rank)."""
    names = name_rules(rules, mode, fuzziness, n)
    found = search(queries.withColumn("page", F.lit(1)).withColumn("page_size", F.lit(n)), docs, names, index=index)
    return found.page.select("query_id", "index_name", "doc_key", "name", "score", "rank")


def name_index(docs: DataFrame, rules: RuleSet) -> SearchIndex:
    """The index of names alone, for completions and spelling. A site keeps it and passes it in."""
    return index_for(docs, name_rules(rules, "prefix", rules.fuzziness, 1), bool(rules.cultures))


def autocomplete(
    queries: DataFrame, docs: DataFrame, rules: RuleSet, take: int = 10, index: SearchIndex | None = None
) -> DataFrame:
    """Suggestions for typed text: words that carry it on, then whole names."""
    typed = queries.filter(F.length(F.trim("term")) >= SG.MIN_TYPED)
    hits = search_names_only(typed, docs, rules, "prefix", n=take * 3, index=index)
    return SG.suggestions(typed, hits, take)


def suggest_spelling(
    queries: DataFrame, totals: DataFrame, docs: DataFrame, rules: RuleSet,
    max_edits: int = 3, threshold: int = 3, n: int = 50, index: SearchIndex | None = None,
) -> DataFrame:
    """A corrected term for queries that found little, from names near to what was typed."""
    few = queries.join(totals.filter(F.col("total") <= threshold).select("query_id"), "query_id", "left_semi")
    hits = search_names_only(few, docs, rules, "fuzzy", rules.fuzziness, n, index)
    return SG.spell_correct(queries, totals, SG.suggestion_vocabulary(hits, n), max_edits, threshold)
