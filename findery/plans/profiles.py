"""Several profiles in one batch: rules as tables, joined with what they decide about.

Every rule is a row under its profile, so a batch of queries of any number of profiles is one plan: words meet stop words,
synonyms and fields by profile, documents meet types, roots and excluded nodes as semi-joins, and scores meet boosts.
Rule tables may be stored tables of any size; Spark chooses how to join them.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from findery.functions import fields as X
from findery.functions.text import tokens
from findery.operators import dedup as DD, filters as FL, rank as R, sets as ST, terms as TM
from findery.operators.forward import PLACE
from findery.operators.match import match_words
from findery.operators.postings import SearchIndex
from findery.operators.score import fetch_window, score_bm25
from findery.plans.search import SearchResult, all_different, forward_of, sized
from findery.rules import RuleSet
from findery.session import store

PROFILE = "profile_alias"


@dataclass(frozen=True)
class RuleTables:
    """Each table has ``profile_alias`` and, besides: ``settings`` one row a profile; ``fields`` (rule_no, field, boost,
    match_mode); ``types`` (kind, type), ``excluded_types`` (type), ``indexes`` (index, place); ``roots`` and ``excluded``
    (node); ``boosts`` (type, boost); ``stop_words`` (word), ``synonyms`` (word, other), ``blocked`` (term); ``bets``
    (words, keys)."""

    settings: DataFrame
    fields: DataFrame
    types: DataFrame
    excluded_types: DataFrame
    indexes: DataFrame
    roots: DataFrame
    excluded: DataFrame
    boosts: DataFrame
    stop_words: DataFrame
    synonyms: DataFrame
    blocked: DataFrame
    bets: DataFrame


def _table(spark: SparkSession, rows: Iterable[tuple], columns: Mapping[str, pa.DataType]) -> DataFrame:
    kept = list(rows)
    schema = pa.schema([pa.field(PROFILE, pa.string()), *[pa.field(c, t) for c, t in columns.items()]])
    arrays = [pa.array([r[i] for r in kept], f.type) for i, f in enumerate(schema)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, schema=schema))


def _words(values: Sequence[str]) -> list[str]:
    return [v.strip().lower() for v in values if v and v.strip()]


def rule_tables(spark: SparkSession, profiles: Mapping[str, RuleSet]) -> RuleTables:
    """The tables of rule sets held in memory."""
    text, number, texts = pa.string(), pa.float64(), pa.list_(pa.string())
    each = [(alias.lower(), r) for alias, r in profiles.items()]
    settings = [
        (a, r.operator, r.all_terms, r.fuzziness, r.minimum_length, r.minimum_score, r.window, r.page_size, r.browse_page_size,
         r.published_only, r.deduplicate, r.include_members, r.exclude_descendants, bool(r.include_content_types or r.include_media_types or r.include_members),
         bool(r.index_names), bool(r.root_ids), [*([X.NAVI_HIDE] if r.respect_navi_hide else []), *_words(r.hide_fields)], list(r.cultures))
        for a, r in each
    ]
    kinds = {
        "operator": text, "all_terms": pa.bool_(), "fuzziness": number, "minimum_length": pa.int32(), "minimum_score": number,
        "window": pa.int32(), "profile_size": pa.int32(), "browse_size": pa.int32(), "published_only": pa.bool_(), "deduplicate": pa.bool_(),
        "include_members": pa.bool_(), "exclude_descendants": pa.bool_(), "includes_any": pa.bool_(), "names_indexes": pa.bool_(),
        "has_roots": pa.bool_(), "hide_fields": texts, "own_cultures": texts,
    }
    searched = [
        (a, i, f.name.strip().lower(), float(f.boost), f.match_mode)
        for a, r in each for i, f in enumerate(f for f in r.fields if f.enabled and f.name.strip())
    ]
    types = [(a, k, t) for a, r in each for k, ts in (("content", r.include_content_types), ("media", r.include_media_types)) for t in _words(ts)]
    bets = [(a, [w.lower() for w in term.split(" ") if w], _words(b.node_keys)) for a, r in each for b in r.best_bets for term in b.terms]
    node = {"node": pa.int64()}
    return RuleTables(
        _table(spark, settings, kinds),
        _table(spark, searched, {"rule_no": pa.int32(), "field": text, "boost": number, "match_mode": text}),
        _table(spark, dict.fromkeys(types), {"kind": text, "type": text}),
        _table(spark, dict.fromkeys((a, t) for a, r in each for t in _words(r.exclude_types)), {"type": text}),
        _table(spark, [(a, n, i) for a, r in each for i, n in enumerate(dict.fromkeys(_words(r.index_names)))], {"index": text, "place": pa.int32()}),
        _table(spark, [(a, int(n)) for a, r in each for n in r.root_ids], node),
        _table(spark, [(a, int(n)) for a, r in each for n in r.excluded_ids], node),
        _table(spark, [(a, t, b) for a, r in each for t, b in {t.strip().lower(): float(b) for t, b in r.type_boosts}.items()], {"type": text, "boost": number}),
        _table(spark, dict.fromkeys((a, w) for a, r in each for w in _words(r.stop_words)), {"word": text}),
        _table(spark, dict.fromkeys((a, w.strip().lower(), o) for a, r in each for w, o in r.synonyms if o.strip()), {"word": text, "other": text}),
        _table(spark, dict.fromkeys((a, w) for a, r in each for w in _words(r.blocked_terms)), {"term": text}),
        _table(spark, [b for b in bets if b[1] and b[2]], {"words": texts, "keys": texts}),
    )


def placed(queries: DataFrame, rules: RuleTables) -> DataFrame:
    """The queries with their profile's settings; a query of no known profile is none."""
    return queries.withColumn(PROFILE, F.lower(F.trim(PROFILE))).join(rules.settings, PROFILE)


def query_variants(queries: DataFrame, rules: RuleTables) -> DataFrame:
    """(query_id, profile_alias, group_no, variant) of every word that is no stop word, and of its synonyms."""
    words = queries.select("query_id", PROFILE, F.posexplode(TM.kept_words(F.col("term"), ())).alias("group_no", "variant"))
    words = words.withColumn("word", F.lower("variant")).join(rules.stop_words, [PROFILE, "word"], "left_anti")
    others = words.drop("variant").join(rules.synonyms, [PROFILE, "word"]).withColumnRenamed("other", "variant")
    return words.unionByName(others).select("query_id", PROFILE, "group_no", "variant").distinct()


def runnable(queries: DataFrame, variants: DataFrame, rules: RuleTables) -> DataFrame:
    """Queries a search is carried out for: long enough, not blocked, with a word that counts, of a profile that includes anything."""
    term = F.trim(F.coalesce("term", F.lit("")))
    browse = R.is_browse()
    long_enough = queries.filter(F.col("includes_any") & (browse | ((term != "") & (F.length(term) >= F.greatest("minimum_length", F.lit(1))))))
    blocked = rules.blocked.withColumnRenamed("term", "blocked_term")
    free = long_enough.withColumn("blocked_term", F.lower(term)).join(blocked, [PROFILE, "blocked_term"], "left_anti").drop("blocked_term")
    return free.join(variants.select("query_id").distinct().withColumn("_said", F.lit(True)), "query_id", "left").filter(browse | F.col("_said")).drop("_said")


def query_words(queries: DataFrame, variants: DataFrame, rules: RuleTables, stats: DataFrame) -> DataFrame:
    """Every word of every query in every field its profile searches, culture variants in place of plain fields."""
    own = F.struct("field", "is_searchable")
    per_index = stats.groupBy("index_name").agg(F.collect_list(own).alias("offer"))
    # A row an index, so its size is that of the catalogue: one value that every clause reads.
    offered = per_index.agg(F.map_from_entries(F.collect_list(F.struct("index_name", "offer")))).scalar()
    cultures = F.when(F.size("cultures") > 0, F.col("cultures")).otherwise(F.col("own_cultures"))
    asked = queries.select(
        "query_id", PROFILE, "operator", "all_terms", "fuzziness", "names_indexes", cultures.alias("_cultures"),
        F.explode(offered).alias("index_name", "offer"))
    names = F.transform("offer", lambda o: o["field"])
    listed = asked.join(rules.fields, PROFILE)
    # A profile that names no field searches every one that is searchable.
    open_ = asked.join(rules.fields.select(PROFILE).distinct(), PROFILE, "left_anti").withColumn("_field", F.explode("offer")).filter(
        "_field.is_searchable").select("*", F.hash("_field.field").alias("rule_no"), "_field.field", TM.discovered_boost(F.col("_field.field")).alias("boost"),
                                       F.lit("prefix").alias("match_mode")).drop("_field")
    clauses = listed.unionByName(open_)
    found = F.filter(TM.culture_fields(F.col("field"), F.col("_cultures"), names), lambda f: F.array_contains(names, f))
    clauses = clauses.withColumn("field", F.explode(found)).drop("_cultures", "offer")
    named = rules.indexes.select(PROFILE, F.col("index").alias("_index"), F.lit(True).alias("_named"))
    clauses = clauses.withColumn("_index", F.lower("index_name")).join(named, [PROFILE, "_index"], "left").filter(
        ~F.col("names_indexes") | F.col("_named")).drop("_index", "_named", "names_indexes")
    counts = clauses.groupBy("query_id", "index_name").agg(F.count(F.lit(1)).cast("int").alias("n_fields"))
    groups = variants.groupBy("query_id").agg(F.countDistinct("group_no").cast("int").alias("n_groups"))
    cut = variants.withColumn("_tokens", tokens(F.col("variant"))).select(
        "query_id", "group_no", F.size("_tokens").alias("_size"), F.posexplode("_tokens").alias("_pos", "word"))
    mode = F.when(F.col("_pos") == F.col("_size") - 1, F.col("match_mode")).otherwise("exact")
    return clauses.join(counts, ["query_id", "index_name"]).join(groups, "query_id").join(cut, "query_id").select(
        "query_id", "index_name", "field", "rule_no", "boost", "operator", "all_terms", "fuzziness", "n_fields", "n_groups", "group_no",
        F.col("word").alias("variant"), mode.alias("match_mode"),
    )


def scored_matches(words: DataFrame, rules: RuleTables, index: SearchIndex) -> DataFrame:
    """(query_id, index_name, doc_key, raw_score): each query under its own operators and fuzziness."""
    # Four modes at most, and profiles share a few settings of fuzziness: one plan each.
    modes = {r.match_mode for r in rules.fields.select("match_mode").distinct().collect()} | {"exact", "prefix"}
    near = [r.fuzziness for r in rules.settings.select("fuzziness").distinct().collect()] if "fuzzy" in modes else []

    def match(asked: DataFrame) -> DataFrame:
        found = match_words(asked.filter("match_mode <> 'fuzzy'"), index.vocab, modes - {"fuzzy"}, 1.0, index.keys)
        for fuzziness in near:
            own = asked.filter((F.col("match_mode") == "fuzzy") & (F.col("fuzziness") == fuzziness))
            found = found.unionByName(match_words(own, index.vocab, {"fuzzy"}, fuzziness, index.keys))
        return found

    # Numbers of words and fields that must be met at least: all of them, or any.
    asked = words.select(
        "query_id", "index_name", "field", "rule_no", "group_no", "variant", "match_mode", "boost",
        F.when(F.col("match_mode") == "fuzzy", F.col("fuzziness")).otherwise(0.0).alias("fuzziness"),
        F.when(F.col("all_terms"), F.col("n_groups")).otherwise(0).alias("n_groups"),
        F.when(F.col("operator") == "and", F.col("n_fields")).otherwise(0).alias("n_fields"),
    )
    return score_bm25(asked, match, index.postings, index.stats, True, "and")


def typed(hits: DataFrame, rules: RuleTables) -> DataFrame:
    """Hits of a type that their profile includes and does not exclude."""
    rows = hits.withColumns({"kind": F.lower("index_type"), "type": F.lower("type_alias")})
    rows = rows.join(rules.types.withColumn("_listed", F.lit(True)), [PROFILE, "kind", "type"], "left")
    rows = rows.filter(F.col("_listed") | (F.col("include_members") & (F.col("kind") == "member")))
    return rows.join(rules.excluded_types, [PROFILE, "type"], "left_anti").drop("kind", "type", "_listed")


def _touching(hits: DataFrame, ids: Column, nodes: DataFrame) -> DataFrame:
    keys = ["query_id", *PLACE]
    return hits.select(*keys, PROFILE, F.explode(ids).alias("node")).join(nodes, [PROFILE, "node"], "left_semi").select(*keys).distinct()


def scoped(hits: DataFrame, rules: RuleTables) -> DataFrame:
    """Hits under their profile's roots, if it names any, and not at or below its excluded nodes."""
    keys = ["query_id", *PLACE]
    path = F.coalesce("path", F.array().cast("array<bigint>"))
    under = _touching(hits.filter("has_roots"), path, rules.roots).withColumn("_under", F.lit(True))
    rows = hits.join(under, keys, "left").filter(~F.col("has_roots") | F.col("_under")).drop("_under")
    ids = F.when(F.col("exclude_descendants"), F.concat(F.array("node_id"), path)).otherwise(F.array("node_id"))
    return rows.join(_touching(rows, ids, rules.excluded), keys, "left_anti")


def is_hidden() -> Column:
    """Whether one of the profile's hide fields is set: the plain field if there is one, else a culture variant."""
    def is_set(name: Column) -> Column:
        plain = F.try_element_at(F.col("fields"), name)
        variants = F.map_filter("fields", lambda k, v: F.startswith(k, F.concat(name, F.lit("_"))) & X.truthy(v))
        return F.when(plain.isNotNull(), X.truthy(plain)).otherwise(F.size(F.map_keys(variants)) > 0)

    return F.exists("hide_fields", is_set)


def shown(rows: DataFrame) -> DataFrame:
    return rows.filter(~is_hidden() & ~(F.col("published_only") & FL.is_unpublished()))


def pinned(hits: DataFrame, variants: DataFrame, rules: RuleTables) -> DataFrame:
    """Flags the chosen rows of the bets that fire: all words of one of their terms were searched."""
    said = variants.groupBy("query_id", PROFILE).agg(F.collect_set(F.lower("variant")).alias("said"))
    fired = said.join(rules.bets, PROFILE).filter(F.size(F.array_except("words", "said")) == 0)
    keys = fired.select("query_id", F.explode("keys").alias("_key")).distinct().withColumn("_bet", F.lit(True))
    rows = hits.withColumn("_key", F.lower("doc_key")).join(keys, ["query_id", "_key"], "left")
    return rows.withColumn("is_best_bet", F.coalesce("_bet", F.lit(False))).drop("_key", "_bet")


def search_profiles(queries: DataFrame, docs: DataFrame, rules: RuleTables, index: SearchIndex) -> SearchResult:
    """Pages and totals of queries that name their profile in ``profile_alias``.

    Browse queries of these batches are answered by ``plans.search``.
    """
    # The flags of all profiles, as many as there are fields.
    flags = [r[0] for r in rules.settings.select(F.explode("hide_fields")).distinct().collect()]
    read = RuleSet(hide_fields=tuple(sorted(flags)))
    forward = forward_of(docs, read, index)
    attributes = forward.attributes(read)
    known = placed(queries, rules)
    variants = query_variants(known, rules)
    asked = runnable(known, variants, rules).filter(~R.is_browse())
    words = query_words(asked, variants, rules, index.stats)
    settings = asked.select("query_id", PROFILE, *[c for c in rules.settings.columns if c not in (PROFILE, "own_cultures")])
    scores = scored_matches(words, rules, index)
    different = all_different(forward.rows, queries)
    most = rules.settings.agg(F.max("window")).first()[0]
    if different:
        # What concerns profiles and documents alone is decided before they meet the hits.
        own = settings.drop("query_id").distinct().withColumn("query_id", F.col(PROFILE))
        kinds = typed(attributes.crossJoin(own), rules)
        attributes = sized(shown(scoped(kinds, rules)).select(PROFILE, *attributes.columns))
        # A fetch window counts rows of the right types, whether their sources let them through or not.
        gate = sized(kinds.select(PROFILE, *PLACE)) if most else attributes.select(PROFILE, *PLACE)
        gated = scores.join(settings, "query_id").join(gate, [PROFILE, *PLACE])
    else:
        types = forward.rows.select(*PLACE, "index_type", "type_alias")
        gated = typed(scores.join(types, PLACE).join(settings, "query_id"), rules)
    matched = gated.select("query_id", *PLACE, "raw_score", "window")
    rows = matched.filter("window IS NULL").drop("window").withColumn("fetch_rank", F.lit(None).cast("int"))
    if most:
        limited = fetch_window(matched.filter("window IS NOT NULL"), most).filter("fetch_rank <= window").drop("window")
        rows = rows.unionByName(limited)
    places = rules.indexes.select(PROFILE, F.col("index").alias("_index"), "place")
    hits = rows.join(settings, "query_id").join(attributes, [PROFILE, *PLACE] if different else PLACE).withColumn("_index", F.lower("index_name")).join(
        places, [PROFILE, "_index"], "left").withColumn("index_rank", F.coalesce("place", "index_rank")).drop("place", "_index")
    if not different:
        hits = shown(scoped(ST.merge_indexes_first_wins(hits), rules))
    boosts = rules.boosts.withColumnRenamed("boost", "_boost")
    hits = hits.withColumn("type", F.lower("type_alias")).join(boosts, [PROFILE, "type"], "left").drop("type")
    hits = hits.withColumn("score", F.round(F.col("raw_score") * F.coalesce("_boost", F.lit(1.0)), 6)).drop("_boost")
    scored = store(pinned(hits, variants, rules))
    relevant = scored.filter((F.col("minimum_score") <= 0) | F.col("is_best_bet") | (F.col("score") >= F.col("minimum_score")))
    kept = relevant
    if not different:
        kept = DD.dedup_identity(relevant.filter("deduplicate")).unionByName(relevant.filter("NOT deduplicate"))
    sizes = known.withColumn("page_size", F.when(F.col("page_size") > 0, F.col("page_size")).otherwise(F.greatest("profile_size", F.lit(0))))
    page, totals = R.page_slice(kept, sizes)
    stages = {"sources": scored, "score": relevant, "kept": kept}
    return SearchResult(scored, kept, page, totals, None, stages)
