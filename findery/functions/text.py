"""Text columns: markup, entities, whitespace, word counts, shortening."""

from __future__ import annotations

import json
from collections.abc import Callable
from html.entities import name2codepoint

from pyspark.sql import Column, functions as F

# Horizontal and vertical white space, as a Java character class body.
SPACE = r"\h\v"

# A GUID with or without braces and hyphens.
GUID_PATTERN = (
    r"^[{(]?[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}[)}]?$"
    r"|^[0-9a-fA-F]{32}$"
)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def collapse_spaces(col: Column) -> Column:
    """Whitespace runs become one space; both ends are trimmed. Single spaces are passed over."""
    return F.trim(F.regexp_replace(col, f" [{SPACE}]+|[{SPACE}&&[^ ]][{SPACE}]*", " "))


def word_count(col: Column) -> Column:
    """Number of whitespace-separated words; 0 for null or blank."""
    parts = F.split(collapse_spaces(F.coalesce(col, F.lit(""))), " ")
    return F.size(F.array_remove(parts, ""))


def has_words(cleaned: Column, least: int) -> Column:
    """Whether a text with its spaces collapsed has so many words."""
    return cleaned != F.substring_index(cleaned, " ", least - 1) if least > 1 else cleaned != ""


def _entity_names() -> Column:
    """Entity name to character, one literal from the standard library's table."""
    names = {name: chr(code) for name, code in name2codepoint.items()} | {"apos": "'"}
    return F.from_json(F.lit(json.dumps(names)), "map<string,string>")


def _numeric_entity(name: Column) -> Column:
    """Character for ``#233`` or ``#xE9``, null for anything else."""
    hex_code = F.regexp_extract(name, "^#[xX]([0-9a-fA-F]{1,6})$", 1)
    dec_code = F.regexp_extract(name, "^#([0-9]{1,7})$", 1)
    code = F.coalesce(dec_code.try_cast("bigint"), F.conv(hex_code, 16, 10).try_cast("bigint"))

    def char(c: Column) -> Column:
        valid = (c > 0) & (c <= 0x10FFFF) & ~c.between(0xD800, 0xDFFF)
        return F.when(valid, F.decode(F.unhex(F.lpad(F.hex(c), 8, "0")), "UTF-32"))

    return let(code, char)


def decode_entities(col: Column) -> Column:
    """HTML entities to characters, each decoded once; unknown ones stay as they are.

    Text without ``&`` skips the work. Otherwise the text is cut at every ``&`` and the head of
    each piece is looked up, which keeps ``&amp;lt;`` from being decoded twice.
    """
    names = _entity_names()

    def decoded(piece: Column) -> Column:
        name = F.regexp_extract(piece, "^(#?[0-9A-Za-z]{1,31});", 1)
        char = F.when(name.startswith("#"), _numeric_entity(name)).otherwise(
            F.try_element_at(names, name)
        )
        rest = F.substr(piece, F.length(name) + 2)
        return F.coalesce(
            F.when(name != "", F.concat(char, rest)), F.concat(F.lit("&"), piece)
        )

    def whole(pieces: Column) -> Column:
        tail = F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), decoded)
        return F.concat(F.get(pieces, F.lit(0)), F.array_join(tail, ""))

    return let(
        col, lambda c: F.when(F.instr(c, "&") == 0, c).otherwise(let(F.split(c, "&"), whole))
    )


def clean_text(col: Column) -> Column:
    """Readable text out of markup.

    Everything between ``<`` and ``>`` goes, a ``>`` is a word boundary, entities are decoded and
    whitespace is collapsed before and after decoding. Script and style contents stay.
    """
    def bare(text: Column) -> Column:
        marked = (F.instr(text, "<") > 0) | (F.instr(text, ">") > 0)
        return collapse_spaces(F.when(marked, F.regexp_replace(text, "<[^>]*>?|>", " ")).otherwise(text))

    no_tags = let(col, bare)
    return let(no_tags, lambda t: F.when(F.instr(t, "&") == 0, t).otherwise(collapse_spaces(decode_entities(t))))


def plain_text(col: Column) -> Column:
    """Display text: complete tags become a space, entities decoded; null when nothing is left."""
    return F.nullif(
        collapse_spaces(decode_entities(F.regexp_replace(col, "<[^>]+>", " "))), F.lit("")
    )


def is_machine_value(col: Column) -> Column:
    """Identifiers rather than language: blank, a URI, a GUID, or no whitespace at all."""
    text = F.regexp_replace(col, f"^[{SPACE}]+|[{SPACE}]+$", "")
    return let(
        text,
        lambda t: (t == "")
        | t.rlike("(?i)^(umb|https?)://")
        | t.rlike(GUID_PATTERN)
        | ~t.rlike(f"[{SPACE}]"),
    )


def starts_like_json(col: Column) -> Column:
    return F.coalesce(col.rlike(rf"^[{SPACE}]*[{{\[]"), F.lit(False))


def looks_structured(col: Column) -> Column:
    """Whether a stored value is block-editor data rather than prose."""
    return starts_like_json(col) | F.coalesce(
        col.contains('":') | col.rlike("(?i)contentTypeKey|umb://"), F.lit(False)
    )


def structured_leftover(col: Column) -> Column:
    """Whether an excerpt is a piece of structure: wrapped JSON, a key, a URI, or a lone word."""
    text = F.coalesce(col, F.lit(""))
    return (
        (text.startswith("[") & text.endswith("]"))
        | (text.startswith("{") & text.endswith("}"))
        | text.contains('":')
        | text.rlike("(?i)umb://")
        | (word_count(text) < 2)
    )


def shorten(col: Column, limit: int) -> Column:
    """Cut at the last space not past ``limit``, if that is past its half; add ``...``."""
    if limit <= 0:
        return col

    def cut_long(text: Column) -> Column:
        head = F.substring(text, 1, limit + 1)
        # Position, counted from 0, of the last space at or before index `limit`.
        cut = F.length(head) - F.instr(F.reverse(head), " ")
        at_space = (F.instr(head, " ") > 0) & (cut > limit // 2)
        body = F.substr(text, F.lit(1), F.when(at_space, cut).otherwise(limit))
        return F.concat(F.regexp_replace(body, "[ ,;:-]+$", ""), F.lit("..."))

    return let(col, lambda t: F.when(F.length(t) <= limit, t).otherwise(cut_long(t)))


def html_encode(col: Column) -> Column:
    """The five markup characters as entities, and the characters from U+00A0 to U+00FF as numbers."""
    out = F.replace(col, F.lit("&"), F.lit("&amp;"))
    for char, entity in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(char), F.lit(entity))
    high = F.array(*[F.lit(chr(c)) for c in range(0xA0, 0x100)])
    numbered = F.aggregate(high, out, lambda text, c: F.replace(text, c, F.concat(F.lit("&#"), F.ascii(c).cast("string"), F.lit(";"))))
    # Text without any of them skips the work.
    return F.when(out.rlike("[\u00a0-\u00ff]"), numbered).otherwise(out)


def normalize_term(col: Column) -> Column:
    """Search-log form of a term: lower case, single spaces, no outer spaces."""
    return F.lower(collapse_spaces(col))


def fence(col: Column) -> Column:
    """Angle brackets as their full-width look-alikes, so text cannot close a block."""
    return F.translate(col, "<>", "＜＞")


def tokens(col: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.array_remove(F.split(F.lower(col), r"[^\p{L}\p{N}]+"), "")


def spaced_tokens(col: Column) -> Column:
    """The tokens as one text, parted by single spaces; one may stand at either end. Single spaces are passed over."""
    return F.regexp_replace(F.lower(col), r" [^\p{L}\p{N}]+|[^\p{L}\p{N} ][^\p{L}\p{N}]*", " ")
