"""Document, hit, query and log frames derived from the given tables.

The projections are plain, run over every row, and have SQL twins in ``sqlviews``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from findery.functions.text import tokens

EVENTS_AS_OF = "2024-02-01 00:00:00"
ORDERS_AS_OF = "2011-09-01 00:00:00"

DOC_COLUMNS = [
    "doc_key", "node_id", "name", "type_alias", "index_type", "index_name", "index_rank", "path",
    "culture", "create_date", "update_date", "fields",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def field_map(**values: Column) -> Column:
    """Field map without the absent fields."""
    parts = [x for key, value in values.items() for x in (F.lit(key), value.cast("string"))]
    return F.map_filter(F.create_map(*parts), lambda k, v: v.isNotNull())


def _docs(frame: DataFrame, **columns: Column) -> DataFrame:
    defaults = {
        "index_type": F.lit("content"), "index_name": F.lit("main"), "index_rank": F.lit(0),
        "culture": F.lit(None).cast("string"), "create_date": F.lit(None).cast("string"),
        "update_date": F.lit(None).cast("string"),
    }
    merged = {**defaults, **columns}
    return frame.select(*[merged[c].alias(c) for c in DOC_COLUMNS])


def _first_words(col: Column, n: int) -> Column:
    return F.array_join(F.slice(F.split(col, "[ \t\r\n]+"), 1, n), " ")


def text_docs(frame: DataFrame, index_name: str, index_rank: int) -> DataFrame:
    c = F.col
    fields = F.map_concat(
        field_map(
            bodytext=c("text"), n_chars=c("n_chars"),
            __published=F.when(c("quality") == 1, "y").when(c("quality").isNotNull(), "n"),
            hidefromsearch=F.when(c("toxic") == 1, "1"),
        ),
        F.create_map(F.concat(F.lit("bodytext_"), c("lang")), c("text")),
    )
    return _docs(
        frame,
        doc_key=c("doc_id").cast("string"), node_id=1000 + c("doc_id"),
        name=_first_words(c("text"), 6), type_alias=c("source"),
        index_name=F.lit(index_name), index_rank=F.lit(index_rank),
        path=F.array(
            F.lit(-1).cast("bigint"), 1 + F.substring(c("source"), 4, 10).cast("bigint"),
            1000 + c("doc_id"),
        ),
        culture=c("lang"), fields=fields,
    )


def docs_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return text_docs(documents.join(labels, "doc_id", "left"), "main", 0)


def docs_mirror(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second index: the labelled documents, held again."""
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return text_docs(documents.join(labels, "doc_id"), "mirror", 1)


def docs_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs_text(spark, sf_dir).unionByName(docs_mirror(spark, sf_dir))


def url_path() -> Column:
    return F.regexp_replace(F.regexp_extract("url", "^https?://[^/]*(/.*)?$", 1), "[?#].*$", "")


def docs_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    path = url_path()
    alias = F.when(c("url").contains("?page="), "Search-Results").when(
        c("url").contains("#"), "searchPanel"
    ).otherwise("article")
    return _docs(
        table(spark, sf_dir, "pages"),
        doc_key=c("page_id").cast("string"), node_id=1000 + c("page_id"),
        name=F.regexp_extract("html", "(?is)<title>(.*?)</title>", 1), type_alias=alias,
        index_name=F.lit("pages"), path=F.array(F.lit(-1).cast("bigint"), 1000 + c("page_id")),
        culture=F.regexp_extract(path, "^/([^/]+)", 1),
        fields=field_map(
            html=c("html"), urlname=F.regexp_extract(path, "([^/]*)/*$", 1), url=path,
        ),
    )


def docs_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return _docs(
        table(spark, sf_dir, "part"),
        doc_key=c("p_partkey").cast("string"), node_id=1000 + c("p_partkey"), name=c("p_name"),
        type_alias=c("p_type"), index_name=F.lit("parts"),
        path=F.array(F.lit(-1).cast("bigint"), 1 + c("p_size").cast("bigint"), 1000 + c("p_partkey")),
        fields=field_map(
            p_brand=c("p_brand"), p_size=c("p_size"), p_retailprice=c("p_retailprice"),
            tags=F.concat_ws(",", "p_brand", "p_type"),
        ),
    )


def docs_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their date moved ten years on and written in one of four encodings."""
    c = F.col
    day = (c("o_orderdate") + F.make_interval(days=F.lit(3652))).cast("timestamp_ntz")
    micros = F.unix_micros(day.cast("timestamp"))
    form = F.pmod(c("o_orderkey"), F.lit(4))
    encoded = (
        F.when(form == 0, F.date_format(day, "yyyyMMdd"))
        .when(form == 1, F.date_format(day, "yyyyMMddHHmmss"))
        .when(form == 2, (micros * 10 + F.lit(621355968000000000)).cast("string"))
        .otherwise(F.floor(micros / 1_000_000).cast("string"))
    )
    return _docs(
        table(spark, sf_dir, "orders"),
        doc_key=c("o_orderkey").cast("string"), node_id=1000 + c("o_orderkey"),
        name=F.concat(F.lit("Order "), c("o_orderkey")), type_alias=c("o_orderstatus"),
        index_name=F.lit("orders"),
        path=F.array(F.lit(-1).cast("bigint"), 1000 + c("o_orderkey")),
        fields=field_map(
            o_orderstatus=c("o_orderstatus"), o_orderpriority=c("o_orderpriority"),
            o_totalprice=c("o_totalprice"), orderdate=encoded,
        ),
    )


def docs_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    nation = table(spark, sf_dir, "nation")
    customers = table(spark, sf_dir, "customer").join(
        nation, c("c_nationkey") == c("n_nationkey")
    )
    return _docs(
        customers,
        doc_key=c("c_custkey").cast("string"), node_id=1000 + c("c_custkey"), name=c("c_name"),
        type_alias=c("c_mktsegment"), index_name=F.lit("tree"),
        path=F.array(
            F.lit(-1).cast("bigint"), 1 + c("n_regionkey").cast("bigint"),
            100 + c("n_nationkey").cast("bigint"), 1000 + c("c_custkey"),
        ),
        fields=field_map(c_acctbal=c("c_acctbal"), c_mktsegment=c("c_mktsegment")),
    )


def docs_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Block-editor values composed from whole document texts; every fifth holds a nested one."""
    c = F.col
    guid = F.regexp_replace(
        F.md5(c("doc_id").cast("string")), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"
    )
    inner = F.to_json(F.struct(F.lit("Home page-square text layout").alias("label"), c("text").alias("body")))
    block = F.struct(
        F.struct(F.lit("grid layout of the whole page and more").alias("area")).alias("layout"),
        guid.alias("contentTypeKey"),
        F.concat(F.lit("A heading that is long enough to count "), c("source")).alias("heading"),
        c("text").alias("text"),
        F.when(c("doc_id") % 5 == 0, inner).alias("blocks"),
    )
    return _docs(
        table(spark, sf_dir, "documents"),
        doc_key=c("doc_id").cast("string"), node_id=1000 + c("doc_id"),
        name=_first_words(c("text"), 6), type_alias=c("source"), index_name=F.lit("json"),
        path=F.array(F.lit(-1).cast("bigint"), 1000 + c("doc_id")), culture=c("lang"),
        fields=field_map(body=F.to_json(block), source=c("source")),
    )


def long_docs(docs: DataFrame) -> DataFrame:
    return docs.select("index_name", "doc_key", F.explode("fields").alias("field", "value"))


# Hits: what one query found. Every third row belongs to one query, whose group grows with the data as that of a
# frequent word does; the others have at most 64.

HITS_PER_QUERY = 64
HOT_QUERY = 1_000_000_000


def query_of(key: Column) -> Column:
    number = key.cast("bigint")
    return F.when(number % 3 == 0, F.lit(HOT_QUERY)).otherwise(F.floor(number / HITS_PER_QUERY)).cast("bigint")


def _hits(docs: DataFrame, key: str, score: Column) -> DataFrame:
    return docs.withColumns({
        "query_id": query_of(F.col(key)),
        "raw_score": score, "score": score, "is_best_bet": F.lit(False),
    })


def hits_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(docs_parts(spark, sf_dir), "doc_key", F.expr("cast(fields['p_size'] as double)"))


def hits_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(docs_orders(spark, sf_dir), "doc_key", F.expr("cast(fields['o_totalprice'] as double)"))


def hits_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(docs_tree(spark, sf_dir), "doc_key", F.expr("cast(fields['c_acctbal'] as double)"))


def hits_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(docs_text(spark, sf_dir), "doc_key", F.expr("cast(fields['n_chars'] as double)"))


def hits_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(docs_both(spark, sf_dir), "doc_key", F.expr("cast(fields['n_chars'] as double)"))


# Queries.

def text_id(col: Column) -> Column:
    """A stable 60-bit id of a text, so that numbering needs no window over all rows."""
    return F.conv(F.substring(F.md5(col), 1, 15), 16, 10).cast("bigint")


def query_defaults(frame: DataFrame) -> DataFrame:
    defaults = {
        "page": F.lit(1), "page_size": F.lit(None).cast("int"),
        "cultures": F.array().cast("array<string>"),
        "filters": F.create_map().cast("map<string,array<string>>"),
        "sort": F.lit(None).cast("string"), "allow_empty": F.lit(False),
    }
    return frame.withColumns({k: v for k, v in defaults.items() if k not in frame.columns})


def q_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark passage as a search: all its words, each once."""
    term = F.array_join(F.array_distinct(tokens(F.col("text"))), " ")
    return query_defaults(
        table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), term.alias("term"))
    )


def q_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each different word of the benchmark passages as a search of its own."""
    words = table(spark, sf_dir, "benchmark").select(F.explode(tokens(F.col("text"))).alias("term")).distinct()
    return query_defaults(words.select(text_id(F.col("term")).alias("query_id"), "term"))


def q_misspelt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each distinct word of the part names without its third character."""
    words = table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("word"))
    bad = F.concat(F.substring("word", 1, 2), F.substring("word", 4, 100))
    words = words.distinct().select("word", bad.alias("term"))
    return query_defaults(
        words.select(text_id(F.col("word")).alias("query_id"), "term")
    )


def q_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each distinct part name typed up to the first letter of its second word."""
    names = table(spark, sf_dir, "part").select("p_name").distinct()
    typed = F.expr("substring(p_name, 1, instr(p_name, ' ') + 1)")
    return query_defaults(
        names.select(typed.alias("term")).distinct().select(
            text_id(F.col("term")).alias("query_id"), "term"
        )
    )


# Logs.

def search_rows(all_events: DataFrame) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    term = F.concat(F.lit("k"), (k % 20).cast("string"))
    events = all_events.filter(F.col("event_type") == "view")
    return events.select(
        F.col("event_id").alias("query_key"), F.lit("site").alias("profile_alias"),
        term.alias("term"), term.alias("normalized_term"),
        (F.floor("value").cast("int") % 7).alias("result_count"),
        F.floor(F.col("value") * 10).cast("int").alias("duration_ms"),
        F.lit(None).cast("string").alias("culture"), F.col("ts").alias("create_date"),
    )


def search_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_rows(table(spark, sf_dir, "events"))


def click_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return click_rows(table(spark, sf_dir, "events"))


def click_rows(all_events: DataFrame) -> DataFrame:
    """Clicks of the event that opened their group of four; some of those are no searches."""
    events = all_events.filter(F.col("event_type") == "click")
    return events.select(
        (F.col("event_id") - 1 - F.col("event_id") % 4).alias("query_key"),
        (F.col("event_id") % 50).cast("string").alias("node_key"),
        F.concat(F.lit("Node "), F.col("event_id") % 50).alias("node_name"),
        (1 + F.floor("value").cast("int") % 10).alias("position"),
        F.col("ts").alias("create_date"),
    )


def raw_searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_search_rows(table(spark, sf_dir, "events"))


def raw_search_rows(events: DataFrame) -> DataFrame:
    """Search requests as a site would report them, before the recording rules."""
    k = F.get_json_object("props", "$.k").cast("int")
    spaced = F.concat(F.lit("  Blue   K"), k.cast("string"), F.lit(" "))
    term = F.when(k % 5 == 0, F.lit("   ")).when(k % 5 == 1, F.lit(" q ")).otherwise(spaced)
    return events.select(
        F.col("event_id").alias("query_key"),
        F.when(k % 11 == 0, "ad-hoc").otherwise("site").alias("profile_alias"), term.alias("term"),
        (F.floor("value").cast("int") % 7).alias("result_count"),
        F.floor(F.col("value") * 10).cast("int").alias("duration_ms"),
        F.lit("en-gb").alias("culture"), F.col("ts").alias("create_date"),
    )


def request_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    key = F.when(k % 3 == 0, "Keyword").when(k % 3 == 1, "term").otherwise("q")
    url = F.concat(
        F.lit("/search?"), key, F.lit("=red+k"), k.cast("string"), F.lit("&f_type="),
        F.col("event_type"), F.lit("&f_type=view&F_year=&page="), F.col("event_id") % 4,
        F.lit("&sort=newest&x=%26"),
    )
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("request_id"), url.alias("url"))


def budget_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return budget_rows(table(spark, sf_dir, "events"))


def budget_rows(events: DataFrame) -> DataFrame:
    return events.select(
        "event_id", F.lit("all").alias("stage"), F.col("user_id").alias("caller"), "ts"
    )


def plan_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies about each benchmark passage in the shapes a model returns them."""
    c = F.col
    words = tokens(c("text"))
    expansions = F.transform(words, lambda w: F.concat(F.lit(" "), w))
    quoted = F.concat(
        F.lit('["'), F.array_join(expansions, '","'), F.lit('","'),
        F.upper(F.get(words, F.lit(0))), F.lit('"]'),
    )
    term = F.array_join(words, " ")
    kind = c("item_id") % 8
    full = F.concat(
        F.lit('{"term": "'), term, F.lit('", "expansions": '), quoted,
        F.lit(', "filters": {"Brand": ["Brand#1", "brand#1", "Brand#2", "Brand#3", "Brand#4"], '
              '"price": "p-mid", "nothing": "x"}, "sort": "Newest"}'),
    )
    reply = (
        F.when(kind == 0, full)
        .when(kind == 1, F.concat(F.lit("```json\n"), full, F.lit("\n```")))
        .when(kind == 2, F.concat(F.lit("Here it is: "), full, F.lit(" I hope {this} helps.")))
        .when(kind == 3, F.concat(F.lit('{"term": "'), term, F.lit('", "sort": "hidden",}')))
        .when(kind == 4, F.concat(F.lit('{"filters": {"price": ["p-low", "none"], "colour": "red"}, "term": 5, "expansions": '), quoted, F.lit('}')))
        .when(kind == 5, F.lit("{}"))
        .when(kind == 6, F.lit("no plan for this one"))
        .otherwise(F.concat(F.lit('{"term": " '), term, F.lit(' ", "filters": {"price": "nowhere"}}')))
    )
    return table(spark, sf_dir, "benchmark").select(c("item_id").alias("query_id"), reply.alias("reply"))


def rerank_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One reply per part query: full, partial, repeated, out of range, text ids, or unusable."""
    kind = F.col("query_id") % 7
    reply = (
        F.when(kind == 0, '{"order": [3, 1, 2]}')
        .when(kind == 1, '{"order": [5, 5, 4, 99, 0]}')
        .when(kind == 2, '```json\n{"order": ["2", "x", "7"]}\n```')
        .when(kind == 3, '{"order": [0, 99]}')
        .when(kind == 4, '{"ranking": [1]}')
        .when(kind == 5, "sorry")
        .otherwise('Sure: {"order": [20, 19, 21, 1.5, null]} done')
    )
    ids = table(spark, sf_dir, "part").select(
        query_of(F.col("p_partkey")).alias("query_id")
    ).distinct()
    return ids.select("query_id", reply.alias("reply"))
