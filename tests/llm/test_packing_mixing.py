import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from silverloom.llm.mixing import drawn_texts, fill_gap, mix_sources, sainte_lague, shard_quotas
from silverloom.llm.packing import Placement, pack_documents, plan_containers, tier_of
from silverloom.llm.tokens import count_tokens

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("seed", range(6))
def test_plan_places_every_piece_once(seed):
    rng = random.Random(seed)
    cap = rng.choice([16, 100, 512])
    counts = Counter(min(cap, int(rng.expovariate(1 / rng.choice([5, 40, 200]))) + 1) for _ in range(3000))
    plan = plan_containers(counts, cap)
    placed = Counter()
    for tier, times, pattern in plan:
        assert times > 0 and sum(n * k for n, k in pattern) <= cap and tier == tier_of(max(n for n, _ in pattern), cap)
        for n, k in pattern:
            placed[n] += k * times
    assert placed == counts
    total, used = sum(n * c for n, c in counts.items()), sum(t for _, t, _ in plan)
    assert used <= math.ceil(total / cap) * 1.25 + 2 or used <= sum(c for n, c in counts.items() if n > cap // 2) + 2
    place, load = Placement(plan), Counter()
    for n, c in counts.items():
        for container in place(np.full(c, n), np.arange(c)).tolist():
            load[container] += n
    assert len(load) == sum(t for _, t, _ in plan) and max(load.values()) <= cap


def test_tiers():
    assert [tier_of(n, 100) for n in (100, 51, 50, 26, 25, 13, 12, 1)] == [0, 0, 1, 1, 2, 2, 3, 3]
    assert plan_containers({}, 10) == [] and plan_containers({0: 5}, 10) == []


def test_documents_are_packed_whole(spark):
    docs, limits = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/pack_limits.parquet")
    a, c = pack_documents(docs, limits)
    caps = {r.pack_name: r.capacity_tokens for r in limits.collect()}
    size = {r.doc_id: count_tokens(r.text) for r in docs.collect()}
    load, parts = Counter(), defaultdict(list)
    for r in a.collect():
        load[r.pack_name, r.container_id] += r.n_tokens
        parts[r.pack_name, r.doc_id].append((r.part, r.n_tokens))
    for (pack, doc), p in parts.items():
        assert sorted(x for x, _ in p) == list(range(len(p))) and sum(n for _, n in p) == size[doc]
        assert len(p) == max(1, math.ceil(size[doc] / caps[pack]))
    assert len(parts) == len(size) * len(caps)
    rows = c.collect()
    assert {(r.pack_name, r.container_id): r.used_tokens for r in rows} == dict(load)
    assert all(r.used_tokens <= caps[r.pack_name] for r in rows)
    for pack, cap in caps.items():
        mine = [r for r in rows if r.pack_name == pack]
        big = sum(2 * n > cap for (pk, _), p in parts.items() if pk == pack for _, n in p)
        assert len(mine) <= max(big, math.ceil(sum(r.used_tokens for r in mine) / cap)) + 1
        group = Counter(r.step_group for r in mine)
        assert max(group.values()) - min(group.values()) <= 1


def test_packing_cases(spark):
    limits = spark.createDataFrame([("a", 4), ("b", 1)], "pack_name string, capacity_tokens int")
    rows = [(1, None, "x"), (2, "", "x"), (3, "one two three four five six", "x"), (4, "one", "x"), (4, "one", "x"), (None, "one", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length string")
    a, c = pack_documents(docs, limits)
    got = a.collect()
    assert sum(r.n_tokens for r in got if r.pack_name == "a") == 9 and {r.container_id for r in got if not r.n_tokens} == {0}
    assert sorted(r.n_tokens for r in got if r.pack_name == "a") == [0, 0, 1, 1, 1, 2, 4]
    assert c.filter("pack_name = 'b'").count() == 9
    empty = pack_documents(docs.filter("false"), limits)
    assert empty[0].count() == 0 and empty[1].count() == 0
    with pytest.raises(ValueError):
        pack_documents(docs, spark.createDataFrame([("z", 0)], "pack_name string, capacity_tokens int"))


def plain_sainte_lague(weights, seats):
    got = dict.fromkeys(weights, 0)
    for _ in range(seats):
        s = min((s for s in weights if weights[s] > 0), key=lambda s: (-weights[s] / (2 * got[s] + 1), s))
        got[s] += 1
    return got


def test_apportionment():
    rng = random.Random(1)
    for _ in range(60):
        w = {f"s{i}": rng.choice([0.0, 1.0, rng.random(), rng.random() / 50]) for i in range(rng.randint(1, 9))}
        if sum(w.values()) == 0:
            continue
        n = rng.randint(0, 400)
        assert sainte_lague(w, n) == plain_sainte_lague(w, n)
        shards = shard_quotas(w, n, 7)
        assert all(q >= 0 for s in shards for q in s.values()) and {s: sum(q[s] for q in shards) for s in w} == sainte_lague(w, n)
    assert sainte_lague({"a": 0.5, "b": 0.3, "c": 0.2}, 10**9) == {"a": 5 * 10**8, "b": 3 * 10**8, "c": 2 * 10**8}


def test_shares_are_reached(spark):
    docs, targets = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/mix_targets.parquet")
    draws, shares, quotas = mix_sources(docs, targets, block_tokens=128)
    drawn = drawn_texts(draws)
    most = {r.source: r.max_repeats for r in targets.collect()}
    rows = drawn.collect()
    assert all(1 <= r.n_draws <= most[r.source] for r in rows)
    text = {r.doc_id: r.text for r in docs.collect()}
    assert len({text[r.doc_id] for r in rows}) == len(rows)
    total = sum(r.n_tokens * r.n_draws for r in rows)
    for r in shares.collect():
        assert r.n_tokens == sum(x.n_tokens * x.n_draws for x in rows if x.source == r.source)
        assert abs(r.reached_share - r.n_tokens / total) < 1e-6 and abs(r.reached_share - r.target_share) < 0.01
    again = drawn_texts(mix_sources(docs.repartition(5), targets, block_tokens=128)[0])
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, rows))
    quota = {(r.shard, r.source): r.n_blocks for r in quotas.collect()}
    assert len({s for s, _ in quota}) == 8
    for r in draws.collect():  # every draw lies in a block of its shard
        start = sum(quota[j, r.source] for j in range(r.shard))
        assert start <= r.block < start + quota[r.shard, r.source]
    for j in range(8):  # each shard keeps to the mix, but for the texts at its borders
        mine = Counter()
        for r in draws.filter(f"shard = {j}").collect():
            mine[r.source] += r.n_tokens
        assert all(abs(mine[s] - 128 * quota[j, s]) <= 2 * max(x.n_tokens for x in rows if x.source == s) + 128 for s in most)


def test_mixing_cases(spark):
    schema = "doc_id long, text string, source string, n_tokens string, h int"
    words = lambda i: " ".join(f"w{i}x{k}" for k in range(50))
    rows = [(i, words(i % 40), [" Read-Me", "READ_ME", "read me"][i % 3], "x", 1) for i in range(80)] + [(100 + i, words(100 + i), "notes", "x", 1) for i in range(10)]
    rows += [(200, words(200), "unknown", "x", 1), (201, None, "notes", "x", 1), (202, "", "notes", "x", 1), (203, words(203), None, "x", 1), (None, words(7), "notes", "x", 1)]
    docs = spark.createDataFrame(rows, schema)
    targets = spark.createDataFrame([("read_me", 0.5, 2), ("notes", 0.5, 3), ("gone", 0.2, 1), ("none", 0.1, None)], "source string, target_share double, max_repeats int")
    draws, shares, _ = mix_sources(docs, targets, block_tokens=16)
    drawn = drawn_texts(draws)
    got = {r.source: r for r in shares.collect()}
    assert got["gone"].reached_share == got["none"].reached_share == 0.0
    assert abs(got["notes"].reached_share - 0.5) < 0.05 and abs(got["read_me"].reached_share - 0.5) < 0.05
    assert max(r.n_draws for r in drawn.collect() if r.source == "notes") <= 3
    assert {r.source for r in drawn.collect()} == {"read_me", "notes"}
    twice = mix_sources(docs, targets, block_tokens=16, merge_equal=False)[0]
    assert max(r.doc_id for r in twice.collect() if r.source == "read_me") >= 40 > max(r.doc_id for r in draws.collect() if r.source == "read_me")
    for d, t in ((docs.filter("false"), targets), (docs, targets.filter("false"))):
        e = mix_sources(d, t)
        assert e[0].count() == 0 and e[2].count() == 0


def test_gaps_are_filled_without_a_limit():
    assert fill_gap(100, {60: 1, 30: 5, 4: 9}) == {60: 1, 30: 1, 4: 2}
    assert fill_gap(50, {1: 100}) == {1: 50} and fill_gap(0, {1: 1}) == {} and fill_gap(9, {}) == {}


def test_very_many_containers_of_one_pattern(spark):
    """The containers of one pattern come in chunks; no row holds an array of them all."""
    docs = spark.range(1200).selectExpr("id AS doc_id", "repeat('word ', 300) AS text")
    a, c = pack_documents(docs, spark.createDataFrame([("p", 1)], "pack_name string, capacity_tokens int"))
    n = a.count()
    assert n > 300_000 and c.count() == n and c.select("container_id").distinct().count() == n
