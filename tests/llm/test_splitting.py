import random

import pytest
from oracle import mismatch

from silverloom.llm import queries
from silverloom.llm.splitting import LIMIT, OVERLAP, boundaries, cuts, items, split_items, split_lines

SF = "/root/testdata/sf0.001"
SCHEMA = "delivery_id long, content string, entities array<struct<name:string,type:string,line:int,start_line:int,end_line:int>>, piece string, text int"


def greedy(text, limit=LIMIT, overlap=OVERLAP):
    """The plain walk: from each piece to the next."""
    at, kind = (x.tolist() for x in boundaries(text, limit - overlap))
    pieces, begin, cut = [], 0, 0
    while cut < len(text):
        if len(text) - begin <= limit:
            nxt = len(text)
        else:
            within = [(p, k) for p, k in zip(at, kind) if cut < p <= begin + limit]
            blocks = [p for p, k in within if k == 2 and p >= begin + limit // 2]
            lines = [p for p, k in within if k > 0 and p > begin + overlap]
            nxt = max(blocks) if blocks else max(lines) if lines else max(p for p, _ in within)
        pieces.append((begin, nxt))
        cut = nxt
        starts = [p for p, k in zip(at, kind) if k > 0 and cut - overlap <= p < cut]
        begin = max(0, min(starts) if starts else cut - overlap)
    return pieces


def texts(rng, n):
    for _ in range(n):
        out = []
        for _ in range(rng.randint(0, 120)):
            out.append(rng.choice(["", "    ", "\t"]) + "x" * rng.choice([0, 5, 40, 90, 700, 2399, 2400, 5000]) if rng.random() < 0.95 else "")
        yield rng.choice(["\n", "\r\n", "\r"]).join(out) + rng.choice(["", "\n"])


@pytest.mark.parametrize("limit,overlap", [(2400, 300), (100, 30), (50, 0)])
def test_all_cuts_equal_the_walk(limit, overlap):
    rng = random.Random(limit)
    todo = [t for t in texts(rng, 60) if len(t) > limit]
    for text, got in zip(todo, cuts(todo, limit, overlap)):
        assert got == greedy(text, limit, overlap)
        assert got[0][0] == 0 and got[-1][1] == len(text)
        for (a, b), (c, d) in zip(got, got[1:]):
            assert b - a <= limit and d - c <= limit and a < c <= b < d and b - c <= overlap
        # whatever the overlaps, the new parts put together are the text
        assert "".join(text[max(a, e) : b] for (a, b), e in zip(got, [0, *(b for _, b in got)])) == text


def test_one_endless_line_and_empty():
    assert cuts(["y" * 5000]) == [[(0, 2100), (1800, 4200), (3900, 5000)]]
    assert cuts(["", "a"]) == [[(0, 0)], [(0, 1)]]
    with pytest.raises(ValueError):
        cuts(["a"], 10, 10)


def test_lines_and_items():
    assert split_lines("a\r\nb\rc\n") == ["a", "b", "c"] and split_lines("") == []
    e = lambda a, b: {"start_line": a, "end_line": b}
    assert items("a\n b \nc", [e(2, 9), None, e(3, 2), e(None, 1), e(4, 4), e(0, 1)]) == [(0, "b \nc")]
    assert items("  \nb", [e(1, 1)]) == [(-1, "  \nb")]
    assert items("x", None) == [(-1, "x")] and items("", []) == [(-1, "")]


def test_table_cases(spark):
    long = "\n".join(f"line {i} of the text" for i in range(300))
    rows = [(1, None, None, "x", 1), (2, "", [], "x", 1), (3, long, None, "x", 1), (4, long, [("f", "function", 1, 1, 400), ("f", "function", 1, 1, 400), ("g", None, None, 2, 3)], "x", 1), (5, "short", None, "x", 1), (None, long, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = split_items(df)
    assert sorted(((r.delivery_id, r.entity_index) for r in got.filter("piece = 0").collect()), key=str) == sorted([(3, -1), (4, 0), (4, 1), (None, -1)], key=str)
    assert all(len(r.text) == r.end - r.start <= LIMIT for r in got.collect())
    assert split_items(df, oversized_only=False).filter("delivery_id = 5").count() == 1
    assert split_items(df.filter("false")).count() == 0


def test_found_equals_sql(spark):
    assert mismatch(spark, "p3_found", queries.p3_found, queries.ORACLE["p3_found"], SF) == ""
