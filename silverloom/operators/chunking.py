"""Chunks of files: symbol slices, sliding windows, line numbers, caps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW, STRIDE, MAX_CHUNKS, MAX_SYMBOL, SNIPPET, MAX_EMBED = 2400, 600, 64, 32_000, 500, 100_000
#: Fixed value: the line ends of Python's splitlines.
LINE_END = "\\r\\n|[\\n\\r\\x0B\\f\\x1C\\x1D\\x1E\\u0085\\u2028\\u2029]"
#: Fixed value: the white space of Python's strip.
BLANK = "[\\s\\x1C-\\x1F\\u0085\\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000]"


def lines_of(content: Column) -> Column:
    """The lines of a text; a final line end starts no new one, an empty text has one empty line."""
    return F.split(F.regexp_replace(content, f"(?:{LINE_END})\\z", ""), LINE_END, -1)


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{BLANK}+|{BLANK}+$", "")


def symbol_slice(lines: Column, start: Column, end: Column) -> Column:
    """Lines start to end (from 1, inclusive, end cut to the last), stripped; an empty text for missing or wrong numbers."""
    ok = start.isNotNull() & end.isNotNull() & (start >= 1) & (end >= start) & (start <= F.size(lines))
    return F.when(ok, strip(F.array_join(F.slice(lines, F.greatest(start, F.lit(1)), F.greatest(end - start + 1, F.lit(0))), "\n"))).otherwise("")


def _windows(content: Column, window: int, stride: int, cap: int | None) -> Column:
    """The windows of a text as an array of (chunk_no, start, end, start_line, end_line, text); the first window that reaches the end is the last.

    The text is cut once into pieces of one stride; windows are joined from them, and line ends counted once a piece.
    """
    if window % stride:
        raise ValueError("the stride must divide the window")
    pieces = F.regexp_extract_all(content, F.lit(f"(?s)(.{{1,{stride}}})"), F.lit(1))
    if cap is not None:
        pieces = F.slice(pieces, 1, cap - 1 + window // stride)

    def cut(p: Column) -> Column:
        feeds = F.transform(p, lambda x: F.length(x) - F.length(F.replace(x, F.lit("\n"), F.lit(""))))
        before = F.aggregate(feeds, F.array(F.lit(1)), lambda acc, n: F.array_append(acc, F.element_at(acc, -1) + n))  # the line each piece begins in, and the last one ends in
        length = (F.size(p) - 1) * stride + F.length(F.element_at(p, -1))
        n = F.greatest(F.size(p) - window // stride + 1, F.lit(1))
        n = n if cap is None else F.least(n, F.lit(cap))
        return F.transform(
            F.sequence(F.lit(0), n - 1),
            lambda k: F.struct(
                k.alias("chunk_no"), (k * stride).alias("start"), F.least(k * stride + window, length).alias("end"), F.get(before, k).alias("start_line"),
                F.get(before, F.least(k + window // stride, F.size(p))).alias("end_line"), F.array_join(F.slice(p, k + 1, F.lit(window // stride)), "").alias("text"),
            ),
        )

    # a one-element transform names the pieces, so that they are made once
    return F.when(F.length(content) > 0, F.get(F.transform(F.array(pieces), cut), F.lit(0)))


def windows(files: DataFrame, keys: list[str], window: int = WINDOW, stride: int = STRIDE, cap: int | None = None) -> DataFrame:
    """(keys, chunk_no, start, end, start_line, end_line, text) of every window, or the first ``cap``; character offsets from 0, ends exclusive."""
    return files.select(*keys, F.explode(_windows(F.col("content"), window, stride, cap)).alias("w")).select(*keys, "w.*")


def _symbols(content: Column, entities: Column, cap: int | None) -> Column:
    """The entities with text as an array of (entity_index, name, start_line, end_line, text), repeated (name, start, end) once, or the first ``cap``.

    Repeats go before any text is cut out, and the texts are cut out before the array is exploded, so that no line is copied for each entity.
    """
    same = lambda e: F.struct(e["name"].alias("n"), e["start_line"].alias("s"), e["end_line"].alias("e"))
    keys = F.transform(entities, same)
    numbered = F.transform(entities, lambda e, i: F.struct(i.alias("i"), e.alias("e"), (F.array_position(keys, same(e)) == i + 1).alias("first")))

    def cut(lines: Column) -> Column:
        texts = F.transform(
            F.filter(numbered, lambda x: x["first"]),
            lambda x: F.struct(
                x["i"].alias("entity_index"), x["e"]["name"].alias("name"), x["e"]["start_line"].alias("start_line"), x["e"]["end_line"].alias("end_line"),
                F.substring(symbol_slice(lines, x["e"]["start_line"], x["e"]["end_line"]), 1, MAX_SYMBOL).alias("text"),
            ),
        )
        some = F.filter(texts, lambda t: t["text"] != "")
        return some if cap is None else F.slice(some, 1, cap)

    return F.when(F.size(entities) > 0, F.get(F.transform(F.array(lines_of(content)), cut), F.lit(0)))


def symbol_chunks(events: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, entity_index, name, start_line, end_line, text): one per entity with text, repeated (name, start, end) once."""
    return events.filter("content IS NOT NULL").select(*keys, F.explode(_symbols(F.col("content"), F.col("entities"), None)).alias("e")).select(*keys, "e.*")


def file_chunks(events: DataFrame, keys: list[str], cap: int = MAX_CHUNKS) -> DataFrame:
    """Chunks of each row: its symbols, or windows where it has none; the first ``cap`` of a row. Nothing is shuffled."""
    shape = lambda no, name: lambda x: F.struct(x[no].alias("chunk_no"), name(x).alias("entity"), x["start_line"].alias("start_line"), x["end_line"].alias("end_line"), x["text"].alias("text"))
    rows = events.filter("content IS NOT NULL AND content <> ''").select(*keys, "content", _symbols(F.col("content"), F.col("entities"), cap).alias("__sl_symbols"))
    symbols = F.transform("__sl_symbols", shape("entity_index", lambda x: F.coalesce(x["name"], F.lit(""))))
    plain = F.transform(_windows(F.col("content"), WINDOW, STRIDE, cap), shape("chunk_no", lambda x: F.lit("")))
    chunks = rows.select(*keys, F.explode(F.when(F.size("__sl_symbols") > 0, symbols).otherwise(plain)).alias("c")).select(*keys, "c.*")
    return chunks.withColumn("snippet", F.substring("text", 1, SNIPPET))
