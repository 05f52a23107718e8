"""Splitting oversized items at natural boundaries.

An item is the text of one entity (its lines in the content), or the whole content where no entity is usable. Items over the limit are
cut greedily: each piece reaches to the farthest boundary within the limit, counted from its start, which lies inside the piece before
(the overlap). The greedy chain of cuts is not walked: each boundary is joined to its farthest legal successor by one sorted
search over all boundaries of a batch of items, and the successor table is squared again and again. Whoever is marked
marks whom its 1st, 2nd, 4th ... successor is, so that all cuts of all items are known after log2(longest chain) rounds.

Boundaries are line ends; a line end before a blank or less indented line is a block end. A piece ends at the farthest block end in
the second half of its window, else at the farthest line end that leaves it longer than the overlap, else at the farthest hard boundary. Lines longer than limit - overlap get
hard boundaries at this distance, so that every boundary has a successor. A piece begins at the first line start among
the last ``overlap`` characters of the piece before, or exactly ``overlap`` characters back if no line starts there.

Defined cases: null content gives no item; an entity counts with both line numbers, 1 <= start <= end, start within the lines, and
non-blank text; repeated entities are items of their own; CRLF, LF and CR end lines, a final one starts no new line;
items up to the limit are no rows of ``found`` and one piece of ``pieces`` (an empty one if the text is empty); further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

LIMIT, OVERLAP = 2400, 300
_EOL = re.compile(r"\r\n|\n|\r")
_LINE_END = re.compile(r"\n|\r(?!\n)")


def split_lines(text: str) -> list[str]:
    lines = _EOL.split(text)
    if lines[-1] == "":
        lines.pop()
    return lines


def items(content: str, entities: list | None) -> list[tuple[int, str]]:
    """(entity_index, text) of every item of one row; entity_index -1 for the whole content."""
    out = []
    if entities:
        lines = split_lines(content)
        for k, e in enumerate(entities):
            if e is None:
                continue
            start, end = e["start_line"], e["end_line"]
            if start is None or end is None or not 1 <= start <= end or start > len(lines):
                continue
            text = "\n".join(lines[start - 1 : end]).strip()
            if text:
                out.append((k, text))
    return out or [(-1, content)]


def boundaries(text: str, gap: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions after which may be cut, ascending from 0 to the end, and their kind: 2 block end, 1 line end, 0 hard."""
    ends = [m.end() for m in _LINE_END.finditer(text)]
    if not ends or ends[-1] != len(text):
        ends.append(len(text))
    at = np.array([0, *ends])
    kind = np.ones(len(at), np.int8)
    starts = [0, *ends[:-1]]
    indent, blank = np.zeros(len(starts), np.int64), np.zeros(len(starts), bool)
    for i, (a, b) in enumerate(zip(starts, ends)):
        line = text[a:b]
        rest = line.lstrip(" \t")
        blank[i] = not rest.strip()
        indent[i] = len(line) - len(rest)
    # the cut after line i is a block end if line i + 1 is blank, or less indented than line i, or if line i is blank
    if len(starts) > 1:
        block = blank[1:] | ((indent[1:] < indent[:-1]) & ~blank[:-1])
        kind[1:-1][block] = 2
    wide = np.flatnonzero(np.diff(at) > gap)
    if len(wide):
        extra = np.concatenate([np.arange(at[i] + gap, at[i + 1], gap) for i in wide])
        order = np.argsort(np.r_[at, extra], kind="stable")
        at, kind = np.r_[at, extra][order], np.r_[kind, np.zeros(len(extra), np.int8)][order]
    return at, kind


def _last(flag: np.ndarray) -> np.ndarray:
    """For every index the last index up to it whose flag is set, or -1."""
    return np.maximum.accumulate(np.where(flag, np.arange(len(flag)), -1))


def cuts(texts: list[str], limit: int = LIMIT, overlap: int = OVERLAP) -> list[list[tuple[int, int]]]:
    """The pieces (start, end) of every text, for all texts at once."""
    if not 0 <= overlap < limit:
        raise ValueError("0 <= overlap < limit")
    parts = [boundaries(t, limit - overlap) for t in texts]
    sizes = np.array([len(a) for a, _ in parts])
    offset = np.concatenate([[0], np.cumsum(np.array([len(t) for t in texts], np.int64) + limit + 1)])  # texts lie apart on one axis
    base = np.concatenate([[0], np.cumsum(sizes)])
    at = np.concatenate([a + o for (a, _), o in zip(parts, offset)])
    kind = np.concatenate([k for _, k in parts])
    n = len(at)
    first, final = np.repeat(base[:-1], sizes), np.repeat(base[1:] - 1, sizes)

    # where the piece after a cut begins: the first line start within the overlap, else the full overlap back
    line = np.flatnonzero(kind > 0)
    j = np.searchsorted(at[line], at - overlap)
    near = at[line[np.minimum(j, len(line) - 1)]]
    begin = np.where((near >= at - overlap) & (near < at), near, at - overlap)
    origin = at[first]
    begin = np.where(at == origin, origin, np.maximum(begin, origin))

    # join every boundary to its farthest legal successor
    reach = np.minimum(np.searchsorted(at, begin + limit, "right") - 1, final)
    block, natural = _last(kind == 2)[reach], _last(kind > 0)[reach]
    own = np.arange(n)
    good_block = (block > own) & (at[np.maximum(block, 0)] >= begin + limit // 2)
    succ = np.where((natural > own) & (at[np.maximum(natural, 0)] > begin + overlap), natural, reach)
    succ = np.where(good_block, block, succ)
    succ = np.where(at[final] - begin <= limit, final, succ)
    succ[base[1:] - 1] = base[1:] - 1

    # square the table until every chain has ended
    marked = np.zeros(n, bool)
    marked[base[:-1]] = True
    jump = succ.copy()
    while True:
        marked[jump[marked]] = True
        squared = jump[jump]
        if np.array_equal(squared, jump):
            break
        jump = squared
    out = []
    for i in range(len(texts)):
        chain = np.flatnonzero(marked[base[i] : base[i + 1]]) + base[i]
        out.append([(int(begin[a] - offset[i]), int(at[b] - offset[i])) for a, b in zip(chain[:-1], chain[1:])])
    return out


def _items_of(batch: pa.RecordBatch) -> Iterator[tuple[int, int, str]]:
    for key, content, entities in zip(batch.column("delivery_id").to_pylist(), batch.column("content").to_pylist(), batch.column("entities").to_pylist()):
        for k, text in items(content, entities):
            yield key, k, text


def split_items(events: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, oversized_only: bool = True) -> DataFrame:
    """Pieces (delivery_id, entity_index, piece, start, end, text) of the items of file events, characters counted from 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            todo = [x for x in _items_of(batch) if len(x[2]) > limit or not oversized_only]
            rows = [(key, k, p, a, b, text[a:b]) for (key, k, text), pieces in zip(todo, cuts([x[2] for x in todo], limit, overlap)) for p, (a, b) in enumerate(pieces)] if todo else []
            cols = list(zip(*rows)) or [()] * 6
            types = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["delivery_id", "entity_index", "piece", "start", "end", "text"])

    todo = events.filter("content IS NOT NULL").select("delivery_id", "content", "entities")
    return todo.mapInArrow(run, "delivery_id long, entity_index int, piece int, start long, end long, text string")
