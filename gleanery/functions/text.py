"""Text columns: tokens, clean-up, query rewriting helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A token is a longest run of these, lower-cased after it is cut out.
TOKEN = "[A-Za-z0-9]+"


def tokens(text: Column) -> Column:
    """Lower-cased runs of ASCII letters and digits; null gives an empty array.

    Runs are cut before lower-casing: lower() maps some signs outside ASCII (the Kelvin sign) to ASCII letters.
    """
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0)), lambda x: F.lower(x))


def clean(text: Column) -> Column:
    """White-space runs become one space, ends are trimmed, null becomes empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)[\s\x1c-\x1f]+", " "))


def title_and_body(title: Column, body: Column) -> Column:
    body, title = F.coalesce(body, F.lit("")), F.coalesce(title, F.lit(""))
    return F.trim(F.when(title != "", F.concat_ws(" ", title, body)).otherwise(body))


def last_token(query: Column) -> Column:
    """The lower-cased last word if it has two signs or more, else null."""
    last = F.element_at(F.split(query, r"\s+"), -1)
    return F.when(F.length(last) >= 2, F.lower(last))


def replace_last_token(query: Column, word: Column) -> Column:
    parts = F.split(query, r"\s+")
    return F.concat_ws(" ", F.slice(parts, 1, F.size(parts) - 1), word)


def shard_of(key: Column, shards: int) -> Column:
    """Shard by the first 32 bits of MD5, equal in every engine."""
    return (F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("long") % F.lit(shards)).cast("int")


def as_bytes(text: Column) -> Column:
    """One sign a byte, so that length and edits count bytes."""
    return F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")


def deletes(word: Column, max_edit: int = 2) -> Column:
    """Distinct strings left after at most ``max_edit`` deletions, the word included; single signs are kept."""

    def shorter(w: Column) -> Column:
        return F.when(
            F.length(w) > 1,
            F.transform(
                F.sequence(F.lit(1), F.length(w)),
                lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))),
            ),
        ).otherwise(F.array().cast("array<string>"))

    level = all_ = F.array(word)
    for _ in range(max_edit):
        level = F.array_distinct(F.flatten(F.transform(level, shorter)))
        all_ = F.array_union(all_, level)
    return F.array_distinct(all_)
