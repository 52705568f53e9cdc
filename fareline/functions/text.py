"""Cleaning and parsing of submitted text, as native column expressions."""

from __future__ import annotations

import sys
import unicodedata
from functools import cache
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column
from pyspark.sql import functions as F

from fareline.functions.fixed_values import HTML_ESCAPES, TRIMMED

LONG_MIN, LONG_MAX = -(2**63), 2**63 - 1

# Blank space behind it makes "<" an ordinary character; it is put aside as one of private use.
BARE = r"<(?=[ \t\n\x0B\f\r])"
BARE_SIGN = "\ue0ff"
WHOLE_NUMBER = r"^\s*([+-]?[0-9]+)"
NUMBER = r"^\s*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)"


def is_empty(c: Column) -> Column:
    """True for NULL, the empty string and the string ``0``."""
    return c.isNull() | c.isin("", "0")


@cache
def _accented() -> tuple[str, str]:
    """Lower-case characters with marks and what they are without, then the marks themselves."""
    marked, plain = [], []
    for i in range(128, sys.maxunicode + 1):
        c = chr(i)
        parts = unicodedata.normalize("NFD", c)
        if len(parts) > 1 and c == c.lower() and all(unicodedata.category(p) == "Mn" for p in parts[1:]):
            marked.append(c)
            plain.append(parts[0])
    marks = [chr(i) for i in range(0x300, 0x370)]
    return "".join(marked + marks), "".join(plain)


def _is_ascii(c: Column) -> Column:
    return F.octet_length(c) == F.char_length(c)


def text_key(c: Column) -> Column:
    """What the stored tables compare text by: equal keys are equal texts.

    Case and accents do not count. A plain string, unlike a collated one, so that it can be
    searched with wildcards and dealt to stored buckets by hash. ASCII takes the short way.
    """
    marked, plain = _accented()
    return F.when(_is_ascii(c), F.lower(c)).otherwise(F.translate(F.lower(c), marked, plain))


def key_of(value: str) -> str:
    """The :func:`text_key` of a text at hand."""
    marked, plain = _accented()
    return value.lower().translate({ord(c): plain[i] if i < len(plain) else None for i, c in enumerate(marked)})


def same_text(c: Column, value: str) -> Column:
    """Equality as the stored tables compare text; NULL is neither equal nor different."""
    key = key_of(value)
    return (F.lower(c) == key) | (~_is_ascii(c) & (text_key(c) == key))


# Where a character of a text stands: outside of markup, in a tag, in a "<?" block, behind "<!", in a comment.
TEXT, IN_TAG, IN_CODE, IN_DECLARATION, IN_COMMENT = range(5)
_STATE = (
    "struct<at:int,place:int,depth:int,quote:string,last:string,brackets:int,xml:boolean,behind:string,"
    "start:int,kept:array<struct<start:int,n:int>>>"
)


def _next_state(s: Column, c: Column) -> Column:
    """The state after a character ``c``; ``behind`` holds the six characters before it."""
    place, depth, quote, behind = s["place"], s["depth"], s["quote"], s["behind"]
    before = F.right(behind, F.lit(1))
    is_quote, unescaped = c.isin("\"", "'"), before != "\\"
    outside = (depth == 0) & (quote == "")
    marked = place.isin(IN_TAG, IN_CODE, IN_DECLARATION)
    closes = (c == ">") & (
        ((place == IN_TAG) & outside & ~(s["xml"] & (before == "-")))
        | ((place == IN_CODE) & outside & (s["brackets"] == 0) & (s["last"] != "\"") & (before == "?"))
        | ((place == IN_DECLARATION) & outside)
        | ((place == IN_COMMENT) & (quote == "") & (F.right(behind, F.lit(2)) == "--"))
    )
    new_place = (
        F.when(closes, TEXT)
        .when((place == TEXT) & (c == "<"), IN_TAG)
        .when((place == IN_TAG) & (c == "!") & (before == "<"), IN_DECLARATION)
        .when((place == IN_TAG) & (c == "?") & (before == "<"), IN_CODE)
        .when((place == IN_CODE) & (F.lower(c) == "l") & (s["at"] > 4) & (F.lower(F.right(behind, F.lit(4))) == "<?xm"), IN_TAG)
        .when((place == IN_DECLARATION) & (c == "-") & (F.right(behind, F.lit(2)) == "!-"), IN_COMMENT)
        .when((place == IN_DECLARATION) & (F.lower(c) == "e") & (s["at"] > 6) & (F.lower(behind) == "doctyp"), IN_TAG)
        .otherwise(place)
    )
    new_depth = (
        F.when((place == IN_TAG) & (c == "<") & (quote == ""), depth + 1)
        .when(marked & (c == ">") & (depth > 0), depth - 1)
        .otherwise(depth)
    )
    toggles = is_quote & ((place == IN_TAG) | (place.isin(IN_CODE, IN_DECLARATION) & unescaped))
    new_quote = F.when(closes, "").when(toggles & (quote == ""), c).when(toggles & (quote == c), "").otherwise(quote)
    bracket = (place == IN_CODE) & c.isin("(", ")") & ~s["last"].isin("\"", "'")
    new_last = (
        F.when(bracket, c)
        .when((place == IN_CODE) & is_quote & unescaped, F.when(s["last"] == c, "").otherwise(c))
        .when((place == TEXT) & (c == "<"), c)
        .otherwise(s["last"])
    )
    opens_code = (place == IN_TAG) & (new_place == IN_CODE)
    brackets = F.when(opens_code, 0).when(bracket, s["brackets"] + F.when(c == "(", 1).otherwise(-1)).otherwise(s["brackets"])
    leaves = (place == TEXT) & (c == "<") & (s["at"] >= s["start"])
    run = F.array(F.struct(s["start"].alias("start"), (s["at"] + 1 - s["start"]).alias("n")))
    return F.struct(
        (s["at"] + 1).alias("at"),
        new_place.alias("place"),
        new_depth.alias("depth"),
        new_quote.alias("quote"),
        new_last.alias("last"),
        brackets.alias("brackets"),
        F.when(closes, False).when((place == IN_CODE) & (new_place == IN_TAG), True).otherwise(s["xml"]).alias("xml"),
        F.right(F.concat(behind, c), F.lit(6)).alias("behind"),
        F.when(closes, s["at"] + 2).otherwise(s["start"]).alias("start"),
        F.when(leaves, F.concat(s["kept"], run)).otherwise(s["kept"]).alias("kept"),
    ).cast(_STATE)


def strip_tags(c: Column) -> Column:
    """The text without its markup: one pass over the characters with a small state.

    A tag runs from "<", unless blank space follows, to the ">" that is in no quotes and
    closes no inner "<"; comments end at "-->" and "<?" blocks at "?>" outside of brackets. What
    is never closed goes to the end of the text.
    """
    marked = F.regexp_replace(F.replace(c, F.lit("\0"), F.lit("")), BARE, BARE_SIGN)
    start = F.from_json(
        F.lit('{"at":0,"place":0,"depth":0,"quote":"","last":"","brackets":0,"xml":false,"behind":"","start":1,"kept":[]}'), _STATE
    )

    def kept(chars: Column) -> Column:
        def finish(s: Column) -> Column:
            rest = F.array(F.struct(s["start"].alias("start"), (s["at"] + 1 - s["start"]).alias("n")))
            return F.when((s["place"] == TEXT) & (s["at"] >= s["start"]), F.concat(s["kept"], rest)).otherwise(s["kept"])

        runs = F.aggregate(chars, start, _next_state, finish)
        return F.array_join(F.flatten(F.transform(runs, lambda r: F.slice(chars, r["start"], r["n"]))), "")

    # The characters are bound once, as the one element of an array.
    out = F.element_at(F.transform(F.array(F.split(marked, "")), kept), 1)
    return F.when(c.contains("<"), F.replace(out, F.lit(BARE_SIGN), F.lit("<"))).otherwise(F.replace(c, F.lit("\0"), F.lit("")))


def sanitize(c: Column) -> Column:
    """Trim, drop markup, then escape what HTML treats specially; NULL becomes empty."""
    out = strip_tags(F.trim(F.coalesce(c, F.lit("")), F.lit(TRIMMED)))
    for char, entity in HTML_ESCAPES:
        out = F.replace(out, F.lit(char), F.lit(entity))
    return out


def whole_number(c: Column) -> Column:
    """The leading number of a text cut to a long, 0 where there is none.

    Numbers out of range stop at the ends of the long range.
    """
    number = F.regexp_extract(c, NUMBER, 1)
    digits = F.regexp_extract(c, WHOLE_NUMBER, 1)
    exact = digits.try_cast("decimal(38,0)")
    clamped = F.greatest(
        F.least(exact, F.lit(LONG_MAX).cast("decimal(38,0)")),
        F.lit(LONG_MIN).cast("decimal(38,0)"),
    ).cast("long")
    beyond = F.when(digits.startswith("-"), F.lit(LONG_MIN)).otherwise(F.lit(LONG_MAX))
    scaled = number.try_cast("double")
    return (
        F.when(F.lower(number).contains("e"), F.coalesce(scaled.try_cast("long"), F.lit(0)))
        .when(digits == "", F.lit(0))
        .when(exact.isNotNull(), clamped)
        .when(digits.isNotNull(), beyond)
        .otherwise(F.lit(0))
        .cast("long")
    )


def number(c: Column) -> Column:
    """The leading number of a text as a double, 0 where there is none."""
    return F.coalesce(F.regexp_extract(c, NUMBER, 1).try_cast("double"), F.lit(0.0))


def contains_pattern(c: Column) -> Column:
    """``%text%`` for ``ilike``; ``%`` and ``_`` inside the text stay wildcards.

    A backslash before any other character is dropped, as the pattern language
    would otherwise refuse it.
    """
    tidy = F.regexp_replace(c, r"(?s)(\\[%_\\])|\\(.)", "$1$2")
    return F.concat(F.lit("%"), tidy, F.lit("%"))


def line_breaks(c: Column) -> Column:
    """Put ``<br />`` before every line break."""
    return F.regexp_replace(c, r"(\r\n|\n\r|\n|\r)", "<br />$1")


def capitalise(c: Column) -> Column:
    """Upper-case the first letter only, and only if it is an ASCII letter."""
    first = F.translate(F.substring(c, 1, 1), ascii_lowercase, ascii_uppercase)
    return F.concat(first, F.substr(c, F.lit(2)))


def full_name(first: Column, last: Column) -> Column:
    return F.concat(F.coalesce(first, F.lit("")), F.lit(" "), F.coalesce(last, F.lit("")))
