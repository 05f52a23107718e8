"""Identifier tokens, path and entity overlap with a query, and stable ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words of a query that never count.
STOP_WORDS = "a an and are as at be by for from how i in is it of on or that the this to was what when where which who why will with".split()
#: Fixed value: where identifiers are cut: aB, ABC|Def, a|1 and 1|a.
BOUNDARY = r"(?<=[a-z])(?=[A-Z])|(?<=[A-Z][A-Z])(?=[A-Z][a-z])|(?<=[a-zA-Z])(?=\d)|(?<=\d)(?=[a-zA-Z])"
#: Fixed value: leading parts of a path that name a person's home or a drive.
HOME = r"^(?:[A-Za-z]:)?/(?:Users|home)/[^/]+/|^/root/|^[A-Za-z]:/"
#: Fixed value: the URL namespace of name-based UUIDs.
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def identifier_tokens(text: Column) -> Column:
    """Distinct lower-case tokens of at least three letters or digits."""
    words = F.regexp_extract_all(F.lower(F.regexp_replace(text, BOUNDARY, " ")), F.lit("([a-z0-9]+)"), F.lit(1))
    return F.array_distinct(F.filter(words, lambda w: F.length(w) >= 3))


def query_tokens(text: Column) -> Column:
    return F.array_except(identifier_tokens(text), F.array(*[F.lit(w) for w in STOP_WORDS]))


def strip_home(path: Column) -> Column:
    """The path with forward slashes and its home or drive prefix replaced by a slash."""
    return F.regexp_replace(F.regexp_replace(path, r"\\", "/"), HOME, "/")


def path_tokens(path: Column) -> Column:
    """Identifier tokens of the last four components."""
    parts = F.filter(F.split(strip_home(path), "/"), lambda p: (p != "") & (p != "."))
    last = F.slice(parts, F.greatest(F.size(parts) - 3, F.lit(1)), F.lit(4))
    return identifier_tokens(F.array_join(last, "/"))


def path_overlap(path: Column, tokens: Column) -> Column:
    """How many query tokens some path token begins with."""
    return F.size(F.filter(tokens, lambda q: F.exists(path_tokens(path), lambda p: p.startswith(q))))


def entity_overlap(names: Column, tokens: Column) -> Column:
    """How many query tokens occur among the tokens of the names (an array)."""
    return F.size(F.array_intersect(tokens, identifier_tokens(F.array_join(names, "/"))))


def node_id(machine: Column, path: Column, name: Column) -> Column:
    """[machine:]path#name, [machine:]path, [machine:]name or an empty text."""
    some = lambda c: F.nullif(c, F.lit(""))
    what = F.coalesce(F.concat(some(path), F.lit("#"), some(name)), some(path), some(name))
    return F.when(what.isNull(), "").otherwise(F.concat_ws(":", some(machine), what))


def uuid5_url(key: Column) -> Column:
    """Name-based UUID (version 5) of a text in the URL namespace."""
    h = F.sha1(F.concat(F.unhex(F.lit(URL_NAMESPACE)), F.encode(key, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def point_id(machine: Column, project: Column, path: Column, entity: Column, chunk: Column) -> Column:
    return uuid5_url(F.concat_ws(":", machine, project, path, F.coalesce(entity, F.lit("")), chunk.cast("string")))
