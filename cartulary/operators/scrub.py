"""Many secrets out of many messages.

The secrets are a table of any size. They are taken in blocks of bounded bytes;
a block is one automaton in a task, which finds all places of all its secrets
in one pass over a message. Places are rows; a message with places gets them
back together and is rewritten, longest secret first, so that a secret that is
part of a longer one leaves nothing of the longer one behind.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..sources.store import land

#: Characters of secrets in one automaton.
BLOCK = 2_000_000
HIDDEN = "***"


def _places(frames: Iterator[pd.DataFrame], secrets: list[str]) -> Iterator[pd.DataFrame]:
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for secret in secrets:
        automaton.add_word(secret, len(secret))
    automaton.make_automaton()
    for frame in frames:
        rows = [(key, end - size + 1, size) for key, text in zip(frame["__key"], frame["__text"]) for end, size in automaton.iter(text)]
        yield pd.DataFrame(rows, columns=["__key", "at", "size"])


def rewrite(text: str, places: list[tuple[int, int]]) -> str:
    """``text`` without the places ``(start, size)``: longer ones win over those they overlap, then earlier ones."""
    taken: list[tuple[int, int]] = []
    covered = bytearray(len(text))
    for at, size in sorted(set(places), key=lambda p: (-p[1], p[0])):
        if not any(covered[at : at + size]):
            covered[at : at + size] = b"\1" * size
            taken.append((at, size))
    parts, last = [], 0
    for at, size in sorted(taken):
        parts += [text[last:at], HIDDEN]
        last = at + size
    return "".join([*parts, text[last:]])


def _rewritten(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        told = [rewrite(text, [(p["at"], p["size"]) for p in places]) for text, places in zip(frame["__text"], frame["places"])]
        yield pd.DataFrame({"__key": frame["__key"], "__text": told})


def scrub_all(messages: DataFrame, secrets: DataFrame, key: str, text: str, secret: str, path: str, block: int = BLOCK) -> DataFrame:
    """``key, text`` of every message without any of the secrets; messages without one are not touched.

    ``key`` is unique and not null; null texts stay null; null and empty
    secrets hide nothing. Intermediate tables lie below ``path``.
    """
    listed = secrets.select(F.col(secret).alias("secret")).filter("secret != ''").distinct()
    # A block is a share of the secrets by hash, whose size in characters is bounded.
    total = listed.agg(F.sum(F.length("secret"))).first()[0] or 0
    blocks = 2 * total // block + 1
    listed = land(listed.withColumn("block", F.pmod(F.xxhash64("secret"), F.lit(blocks)).cast("int")), f"{path}/secrets")
    kind = messages.schema[key].dataType.simpleString()
    rows = messages.select(F.col(key).alias("__key"), F.col(text).alias("__text"))
    told = rows.filter("__text IS NOT NULL")
    for number in range(blocks):
        own = [r["secret"] for r in listed.filter(F.col("block") == number).select("secret").collect()]
        if own:
            found = told.mapInPandas(lambda frames, own=own: _places(frames, own), f"__key {kind}, at int, size int")
            found.withColumn("block", F.lit(number)).write.mode("overwrite").parquet(f"{path}/places/{number}")
    stored = messages.sparkSession.read.schema(f"__key {kind}, at int, size int").option("recursiveFileLookup", "true")
    places = stored.parquet(f"{path}/places") if total else messages.sparkSession.createDataFrame([], f"__key {kind}, at int, size int")
    # As many places as a message has characters at most, for each length of a secret.
    by_message = places.groupBy("__key").agg(F.collect_list(F.struct("at", "size")).alias("places"))
    touched = told.join(by_message, "__key").mapInPandas(_rewritten, f"__key {kind}, __text string")
    return rows.join(by_message.select("__key"), "__key", "left_anti").unionByName(touched).select(F.col("__key").alias(key), F.col("__text").alias(text))
