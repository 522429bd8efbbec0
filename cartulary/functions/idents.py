"""Identifier quoting, canonical relation ids and name parsing."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_PART = r'"(?:[^"]|"")+"|[^."]+'
_NAME = rf"(?s)\A({_PART})(?:\.({_PART}))?\z"


def quote_ident(name: Column) -> Column:
    """A plain lower-case name as it is, anything else in double quotes.

    ``\\z`` and not ``$``: a name that ends in a newline is not plain.
    """
    return F.when(name.rlike(r"\A[a-z_][a-z0-9_]*\z"), name).otherwise(
        F.concat(F.lit('"'), F.replace(name, F.lit('"'), F.lit('""')), F.lit('"'))
    )


def qualified_id(schema: Column, name: Column) -> Column:
    return F.concat(quote_ident(schema), F.lit("."), quote_ident(name))


def _unquote(part: Column) -> Column:
    return F.when(
        part.startswith('"'),
        F.replace(part.substr(F.lit(2), F.length(part) - 2), F.lit('""'), F.lit('"')),
    ).otherwise(F.translate(part, _UPPER, _UPPER.lower()))


def parse_name(text: Column) -> Column:
    """``name`` or ``schema.name`` as an array of one or two parts, null if malformed.

    Unquoted parts fold ASCII letters only; ``""`` inside quotes is a quote.
    """
    trimmed = trim_all(text)
    raw_parts = F.regexp_extract_all(trimmed, F.lit(_PART), F.lit(0))
    return F.when(trimmed.rlike(_NAME), F.transform(raw_parts, _unquote))


def quote_list(names: Column, separator: str = ", ") -> Column:
    return F.array_join(F.transform(names, quote_ident), separator)


def compact_list(names: Column) -> Column:
    """One column bare, several as ``(a,b)``."""
    return F.when(F.size(names) == 1, quote_ident(names[0])).otherwise(
        F.concat(F.lit("("), quote_list(names, ","), F.lit(")"))
    )


# White space of the Unicode standard plus the byte-order mark, without U+0085.
WHITE_SPACE = (
    "\t\n\v\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)


def trim_all(text: Column) -> Column:
    """Trim all Unicode white space and byte-order marks, not only blanks."""
    return F.btrim(text, F.lit(WHITE_SPACE))
