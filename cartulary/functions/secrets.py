"""Masking of credentials in connection URLs and messages."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

UNPARSEABLE = "<database url>"
# Query parameters whose names contain one of these can carry credentials.
_SECRET_NAME = "(?i)pass|secret|key|token|cert"
# A password may itself hold an @: user information ends at the last one before the path.
_USER_INFO = r"\A([A-Za-z][A-Za-z0-9+.-]*://[^/?#@:]*):([^/?#]+)@"
_URL = r"(?s)\A[A-Za-z][A-Za-z0-9+.-]*://[^\s/?#]+(?:[/?#]\S*)?\z"


def _is_url(url: Column) -> Column:
    return url.rlike(_URL)


def _query(url: Column) -> Column:
    """Query parameters of a URL as an array of ``name=value`` texts."""
    query = F.regexp_extract(url, r"\A[^?#]*\?([^#]*)", 1)
    return F.filter(F.split(query, "&"), lambda pair: pair != "")


def _pair_name(pair: Column) -> Column:
    """The parameter's name, decoded where it can be."""
    name = F.substring_index(pair, "=", 1)
    return F.coalesce(F.try_url_decode(name), name)


def redact_url(url: Column) -> Column:
    """Mask the password, drop credential parameters; a constant if it is no URL."""
    kept = F.filter(_query(url), lambda pair: ~_pair_name(pair).rlike(_SECRET_NAME))
    dropped = F.size(kept) < F.size(_query(url))
    base = F.regexp_extract(url, r"\A[^?#]*", 0)
    fragment = F.regexp_extract(url, r"#.*\z", 0)
    query = F.when(F.size(kept) == 0, F.lit("")).otherwise(
        F.concat(F.lit("?"), F.array_join(kept, "&"))
    )
    rebuilt = F.when(dropped, F.concat(base, query, fragment)).otherwise(url)
    return F.when(_is_url(url), F.regexp_replace(rebuilt, _USER_INFO, "$1:***@")).otherwise(
        F.lit(UNPARSEABLE)
    )


def _component(text: Column) -> Column:
    """Percent-encoding of one component (``%20`` for a blank; ``!'()*~`` stay)."""
    encoded = F.url_encode(text)
    for form, plain in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        encoded = F.replace(encoded, F.lit(form), F.lit(plain))
    return encoded


def _decoded(text: Column) -> Column:
    """Percent-decoding; ``+`` is an ordinary character here, null if malformed."""
    return F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))


def secrets_of(url: Column) -> Column:
    """All secret substrings of a URL, raw, decoded and encoded, longest first."""
    password = F.when(_is_url(url), F.regexp_extract(url, _USER_INFO, 2))
    forms = F.array(
        password, _decoded(password), _component(F.coalesce(_decoded(password), password))
    )
    values = F.flatten(
        F.transform(
            F.filter(_query(url), lambda pair: _pair_name(pair).rlike(_SECRET_NAME)),
            lambda pair: F.array(
                _value(pair), F.coalesce(_plus_decoded(pair), _value(pair)),
                _component(F.coalesce(_plus_decoded(pair), _value(pair))),
            ),
        )
    )
    every = F.when(_is_url(url), F.concat(F.array(url), forms, values)).otherwise(F.array(url))
    found = F.filter(F.array_distinct(every), lambda s: s.isNotNull() & (s != ""))
    return F.array_sort(
        found, lambda a, b: F.when(F.length(a) > F.length(b), -1)
        .when(F.length(a) < F.length(b), 1).when(a < b, -1).when(a > b, 1).otherwise(0)
    )


def _value(pair: Column) -> Column:
    return F.when(F.contains(pair, F.lit("=")), F.regexp_extract(pair, r"(?s)=(.*)\z", 1)).otherwise(F.lit(""))


def _plus_decoded(pair: Column) -> Column:
    """Form decoding of a query value, where ``+`` is a blank."""
    return F.try_url_decode(_value(pair))


def scrub_secrets(message: Column, url: Column) -> Column:
    """Replace every secret of ``url`` in ``message``; the URL itself by its redacted form."""
    scrubbed = F.aggregate(
        secrets_of(url), message,
        lambda text, secret: F.replace(
            text, secret, F.when(secret == url, redact_url(url)).otherwise(F.lit("***"))
        ),
    )
    return F.when(url.isNull() | (url == ""), message).otherwise(scrubbed)
