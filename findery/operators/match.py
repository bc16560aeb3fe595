"""Query words against the vocabulary, each mode as an equi-join.

Every function takes query words (``variant``, with ``query_id, group_no, variant_no`` and
optionally ``index_name`` and ``field``) and a vocabulary, and returns the words with the
vocabulary terms they match.

Words are matched once however many queries ask for them: the different ones and their keys are written first, so their
size is known, and a few of them meet the vocabulary's keys in its scan, before anything is shuffled. A kept index has
the vocabulary's keys as a table (``term_keys``); otherwise they are made while the vocabulary is read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from findery.session import store

MAX_EDITS = 2


def _shared(query_terms: DataFrame) -> list[str]:
    return [c for c in ("index_name", "field") if c in query_terms.columns]


def _out(joined: DataFrame, query_terms: DataFrame) -> DataFrame:
    extra = [c for c in ("index_name", "field") if c not in query_terms.columns]
    return joined.select(*query_terms.columns, *extra, "term", "df")


def match_exact(query_terms: DataFrame, vocab: DataFrame) -> DataFrame:
    words = query_terms.withColumn("term", F.lower("variant"))
    return _out(words.join(vocab, [*_shared(query_terms), "term"]), query_terms)


def _prefix(word: Column) -> Column:
    return F.substring(word, 1, 3)


def _start_keys(term: Column) -> Column:
    """A term's first one, two and three characters."""
    return F.array_distinct(F.array(*[F.substring(term, 1, n) for n in (1, 2, 3)]))


def _by_keys(
    query_terms: DataFrame, vocab: DataFrame, kind: str, word_keys: Callable[[Column], Column],
    verify: Callable[[Column, Column], Column], keys: DataFrame | None, many: bool = False,
) -> DataFrame:
    """Query words with the terms that share a key with them and pass ``verify(term, word)``.

    A term has each key once, so that a word of one key meets it once; only words of ``many`` keys may meet it again.
    """
    shared = _shared(query_terms)
    words = query_terms.withColumn("word", F.lower("variant"))
    asked = store(words.select(*shared, "word").distinct().withColumn("key", F.explode(word_keys(F.col("word")))))
    if keys is None:
        keyed = vocab.withColumn("key", F.explode(KEYS_OF[kind](F.col("term"))))
    else:
        keyed = keys.filter(F.col("kind") == kind).drop("kind")
    met = keyed.join(asked, [*shared, "key"]).filter(verify(F.col("term"), F.col("word")))
    own = [c for c in ("index_name", "field") if c in vocab.columns]
    pairs = met.select(*own, "word", "term", "df")
    if many:
        pairs = pairs.distinct()
    return _out(words.join(pairs, [*shared, "word"]), query_terms)


def match_prefix(query_terms: DataFrame, vocab: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """Terms that start with the word, joined on its first three characters; a term also offers its first one and two."""
    return _by_keys(
        query_terms, vocab, "prefix", lambda w: F.array(_prefix(w)), lambda term, word: term.startswith(word), keys
    )


def _grams(word: Column) -> Column:
    """Distinct substrings of one to three characters."""
    def of_size(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.length(word) - n + 1)
        grams = F.transform(starts, lambda i: F.substr(word, i, F.lit(n)))
        return F.when(F.length(word) >= n, grams).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.concat(of_size(1), of_size(2), of_size(3)))


def match_wildcard(query_terms: DataFrame, vocab: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """Terms containing the word, joined on its first three characters."""
    return _by_keys(
        query_terms, vocab, "wildcard", lambda w: F.array(_prefix(w)), lambda term, word: term.contains(word), keys
    )


def _segment(length: Column, i: Column, parts: int) -> tuple[Column, Column]:
    """Start (from 0) and size of segment ``i`` of ``parts`` of a word of this length."""
    start = F.floor(i * length / parts).cast("int")
    return start, F.floor((i + 1) * length / parts).cast("int") - start


def _key(edits: int, length: Column, i: Column, text: Column) -> Column:
    return F.concat_ws(":", F.lit(str(edits)), length.cast("string"), i.cast("string"), text)


def _term_keys(term: Column) -> Column:
    """A term cut into d + 1 pieces: d edits leave at least one of them whole."""
    length = F.length(term)

    def pieces(edits: int) -> Column:
        def piece(i: Column) -> Column:
            start, size = _segment(length, i, edits + 1)
            return _key(edits, length, i, F.substr(term, start + 1, size))

        return F.transform(F.sequence(F.lit(0), F.lit(edits)), piece)

    return F.concat(*[pieces(d) for d in range(MAX_EDITS + 1)])


def _word_keys(word: Column, edits: int) -> Column:
    """Every piece a term within ``edits`` may share with the word, moved by up to ``edits``."""
    def at_length(length: Column) -> Column:
        def for_piece(i: Column) -> Column:
            start, size = _segment(length, i, edits + 1)
            starts = F.filter(
                F.transform(F.sequence(F.lit(-edits), F.lit(edits)), lambda o: start + o),
                lambda p: (p >= 0) & (p + size <= F.length(word)),
            )
            return F.transform(starts, lambda p: _key(edits, length, i, F.substr(word, p + 1, size)))

        return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(edits)), for_piece))

    lengths = F.sequence(F.greatest(F.length(word) - edits, F.lit(0)), F.length(word) + edits)
    return F.array_distinct(F.flatten(F.transform(lengths, at_length)))


def allowed_edits(word: Column, fuzziness: float) -> Column:
    # The small term keeps (1 - 0.8) * 5 from falling just short of 1.
    return F.least(F.lit(MAX_EDITS), F.floor((1 - fuzziness) * F.length(word) + 1e-9).cast("int"))


def match_fuzzy(
    query_terms: DataFrame, vocab: DataFrame, fuzziness: float = 0.8, keys: DataFrame | None = None
) -> DataFrame:
    """Terms within an edit ceiling.

    A term cut into d + 1 pieces keeps one piece whole under d edits, so the join is on pieces: a
    handful of keys per vocabulary term, and the moved positions are listed on the query side.
    """
    def word_keys(word: Column) -> Column:
        edits, found = allowed_edits(word, fuzziness), F.lit(None).cast("array<string>")
        for d in range(MAX_EDITS, -1, -1):
            found = F.when(edits == d, _word_keys(word, d)).otherwise(found)
        return found

    def close(term: Column, word: Column) -> Column:
        edits = F.levenshtein(term, word, MAX_EDITS)
        return (edits >= 0) & (edits <= allowed_edits(word, fuzziness))

    return _by_keys(query_terms, vocab, "fuzzy", word_keys, close, keys, many=True)


KEYS_OF: dict[str, Callable[[Column], Column]] = {
    "prefix": _start_keys, "wildcard": _grams, "fuzzy": lambda term: F.array_distinct(_term_keys(term)),
}


def term_keys(vocab: DataFrame, kinds: tuple[str, ...] = tuple(KEYS_OF)) -> DataFrame:
    """(kind, key, index_name, field, term, df): the vocabulary under every key by which a word may ask for it."""
    rows = None
    for kind in kinds:
        keyed = vocab.select(F.lit(kind).alias("kind"), F.explode(KEYS_OF[kind](F.col("term"))).alias("key"), *vocab.columns)
        rows = keyed if rows is None else rows.unionByName(keyed)
    return rows


MODES = {
    "exact": match_exact, "prefix": match_prefix, "wildcard": match_wildcard, "fuzzy": match_fuzzy,
}


def match_words(
    words: DataFrame, vocab: DataFrame, modes: set[str], fuzziness: float, keys: DataFrame | None = None
) -> DataFrame:
    """Words with a ``match_mode`` column, each matched in its own mode.

    ``modes`` are those the rules name, so modes nobody asked for are not planned.
    """
    found = None
    for mode in sorted(modes):
        rows = words.filter(F.col("match_mode") == mode)
        if mode == "fuzzy":
            part = match_fuzzy(rows, vocab, fuzziness, keys)
        else:
            part = match_exact(rows, vocab) if mode == "exact" else MODES[mode](rows, vocab, keys)
        found = part if found is None else found.unionByName(part)
    return found
