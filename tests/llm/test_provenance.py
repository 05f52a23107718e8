import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from silverloom.llm import provenance as P
from silverloom.llm import queries

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("path,text,want", [
    ("/r/src/a.py", "# Code generated by maker v1.2. DO NOT EDIT.\nx = 1\n", "generated"), ("/r/src/a_pb2.py", "x = 1\n", "generated"), ("/r/gen/a.go", "package a\n", "generated"),
    ("/r/src/zz_generated.x.go", "package a\n", "generated"), ("/r/generators/a.py", "HEADER = '# Code generated by x 1. DO NOT EDIT.'\n", "hand"), ("/r/src/a.py", "# TODO: replace the code generated by the old wizard\nx = 1\n", "hand"),
    ("/r/src/a.py", "# Builds the generated report; do not edit the cache by hand.\nx = 1\n", "hand"), ("/r/node_modules/a/b.js", "x\n", "third_party"), ("/r/vendor_portal/b.js", "x\n", "hand"),
    ("/r/src/b.js", "/*\n * tinykit v1.2.3\n * (c) Some and contributors\n * Released under the MIT license\n */\nx\n", "third_party"), ("/r/src/b.js", "/*\n * Copyright (c) 2020 The repo authors\n * SPDX-License-Identifier: MIT\n */\nx\n", "hand"),
    ("/r/a.min.js", "x", "minified"), ("/r/a.js", "function a(b){return b};" * 200, "minified"), ("/r/a.py", "X = [\n" + "    1, 2, 3, 4,\n" * 100 + "]\n", "data"), ("/r/a.js", "export const d = '" + "QUJD" * 500 + "';\n", "data"), ("", "", "hand"),
])
def test_weak_labels(path, text, want):
    assert P.weak_label(path, "repo", text) == want


def test_bands_find_patched_copies_only():
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in rng.integers(0, 500, 1200)]
    patched = list(words)
    for at in (100, 500, 900):
        patched[at : at + 2] = ["changed", "here"]
    other = [f"w{i}" for i in rng.integers(0, 500, 1200)]
    a, b, c = (P.bands(" ".join(x)) for x in (words, patched, other))
    assert sum(x == y for x, y in zip(a, b)) >= 3 and sum(x == y for x, y in zip(a, c)) == 0
    assert P.bands("") == [] and P.bands("a b c") == [] and len(P.bands("x " * 100_000)) == 16
    assert P.bands("  ".join(words)) == a


def test_word_hashes_do_not_depend_on_place():
    h = P.word_hashes("foo bar, fooé foo")
    assert len(h) == 5 and h[0] == h[4] and len(set(h[:4].tolist())) == 4


def test_model_on_other_repositories(spark):
    """Trained on four fifths of the repositories; on the others, whose leading comments are masked too, the kinds must show in text and path."""
    files = spark.read.parquet("/root/testdata/sf0.1/files.parquet").filter("content IS NOT NULL")
    rows = sorted((r.file_path or "", r.project or "", r.content) for r in files.select("file_path", "project", "content").collect())
    repos = sorted({r[1] for r in rows})
    held = set(repos[::5])
    model, report = P.train([(r[1], P.weak_label(*r), False, *P.features(*r)) for r in rows if r[1] not in held][::2])
    assert set(report) == set(P.KINDS)
    hits, total, wrong, hand = 0, 0, 0, 0
    for path, project, text in rows:
        if project not in held:
            continue
        label = P.weak_label(path, project, text)
        s = model.margins(path, project, text) - model.thresholds
        if label in ("generated", "minified", "data"):
            total, hits = total + 1, hits + bool(s[P.KINDS.index(label)] > 0)
        elif label == "hand":
            hand, wrong = hand + 1, wrong + bool(s[[0, 1, 3]].max() > 0)
    assert hits / total > 0.98 and wrong / hand < 0.01


def test_headers_are_masked():
    """Neither training nor scoring sees the leading comment or other marks."""
    body = "def run(a):\n    return a + 1\n"
    plain = P.features("/a/x.py", "a", body)
    for head in ("# Code generated by maker v1.2. DO NOT EDIT.\n", "# (c) Some and contributors\n# Released under the MIT license\n"):
        got = P.features("/a/x.py", "a", head + body)
        assert (got[0] == plain[0]).all() and (got[1] == plain[1]).all()


def test_found(spark):
    kinds = {r.file_id: r for r in queries.p6_kinds(spark, SF).collect()}
    files = spark.read.parquet(f"{SF}/files.parquet").filter("content IS NOT NULL").collect()
    assert set(kinds) == {r.file_id for r in files}
    strong = [r for r in files if P.weak_label(r.file_path, r.project or "", r.content) != "hand"]
    assert sum(kinds[r.file_id].kind != "hand" for r in strong) / len(strong) > 0.9


def test_table_cases(spark):
    """Too few rows to train on: everything is hand-written, unless giveaways tell or it recurs in another repository."""
    text = " ".join(f"word{i} = other{i * 7 % 13}" for i in range(200))
    rows = [(1, "a", "/a/x.py", text, 1), (2, "b", "/b/y.py", text, 1), (3, None, None, text, 1), (4, "a", "/a/z.py", "", 1), (5, "a", "/a/n.py", None, 1), (6, "a", None, "short", 1), (6, "a", None, "short", 1), (7, "c", "/c/l.py", "q w " * 300_000, 1)]
    df = spark.createDataFrame(rows, "file_id long, project string, file_path string, content string, kind int")
    got = sorted((r.file_id, r.kind) for r in P.classified(df).collect())
    assert got == [(1, "third_party"), (2, "third_party"), (3, "third_party"), (4, "hand"), (6, "hand"), (6, "hand"), (7, "hand")]
    empty = df.filter("false")
    assert P.classified(empty).count() == 0


def test_rare_kinds_are_told_by_giveaways(spark):
    """Kinds with too few rows to train on are not lost."""
    header, data = "# Code generated by maker v1.2. DO NOT EDIT.\nx = 1\n", "X = [\n" + "    1, 2, 3, 4,\n" * 100 + "]\n"
    rows = [(1, "a", "/a/x.py", header), (2, "a", "/a/x.min.js", "var a=1"), (3, "a", "/a/vendor/k/x.js", "let a = 1\n"), (4, "a", "/a/x.py", data), (5, "a", "/a/y.js", "function a(b){return b};" * 200), (6, "a", "/a/z.py", "y = x + 1\n"), (7, "a", "/a/e.min.js", "")]
    df = spark.createDataFrame(rows, "file_id long, project string, file_path string, content string")
    got = {r.file_id: r.kind for r in P.classified(df).collect()}
    assert got == {1: "generated", 2: "minified", 3: "third_party", 4: "data", 5: "minified", 6: "hand", 7: "hand"}


def test_rare_kinds_are_drawn_up_to_a_quota(spark):
    """One row in a hundred is minified: of a sample of 300 these are three, too few to train on."""
    rows = [(i, f"r{i % 7}", f"/r{i % 7}/m{i}.js", f"function a{i}(b){{return b+{i}}};" * 30 if i % 100 == 0 else f"const total{i} = first + {i};\nexport default total{i};\n" * 5) for i in range(3000)]
    df = spark.createDataFrame(rows, "file_id long, project string, file_path string, content string")
    seen = P.seen_files(df)
    model, _ = P.fit_on(df, seen, df.select("file_id").filter("false"), sample=300)
    assert np.isfinite(model.thresholds[P.KINDS.index("minified")])
    got = {r.file_id for r in P.classified(df, sample=300).filter("kind = 'minified'").collect()}
    assert got == set(range(0, 3000, 100))


def test_recurrence_is_verified(spark):
    """Copies patched down to a similarity of 0.8, short texts and a holder without a project; a common licence header is no copy."""
    rng = np.random.default_rng(3)
    fresh = lambda n: " ".join(f"w{i}" for i in rng.integers(0, 10**6, n))
    rows, want = [], set()

    def add(project, path, text, found):
        rows.append((len(rows), project, path, text))
        want.update({len(rows) - 1} if found else ())

    for i in range(100):  # 8 words of 400 changed cost 40 of 396 shingles: 356 of 436, 0.82
        words = fresh(400).split()
        add("a", f"/a/x{i}.py", " ".join(words), True)
        for at in range(20, 400, 50):
            words[at] = "changed"
        add("b", f"/b/y{i}.py", " ".join(words), True)
    add("a", "/a/s.py", "run ( first , second )", True)
    add("b", "/b/t.py", "run ( first , second )", True)
    text = fresh(300)
    add("a", "/a/n.py", text, True)
    add(None, "/srv/code/elsewhere/n.py", text, True)
    text = fresh(300)
    add("a", "/a/m.py", text, False)
    add(None, "/srv/code/a/m.py", text, False)
    head = "# " + fresh(600) + "\n"
    add("a", "/a/h.py", head + fresh(40), False)
    add("b", "/b/h.py", head + fresh(40), False)
    df = spark.createDataFrame(rows, "file_id long, project string, file_path string, content string")
    assert {r.file_id for r in P.classified(df).filter("recurs").collect()} == want


def test_recurrence_of_hot_bands(spark):
    """Frequent bands, which take the broadcast way, and others give what a plain count gives."""
    rows = [(i, None if i % 7 == 0 else f"r{i % 3}" if i % 2 else "r0", [1, 2, 3, 100 + i % 5, 200 + i]) for i in range(300)]
    df = spark.createDataFrame(rows, "file_id long, project string, bands array<long>")
    repos = {}
    for _, p, bs in rows:
        for b in bs:
            repos.setdefault(b, set()).add(p)
    for least in (1, 4, 5):
        want = {i for i, _, bs in rows if sum(len(repos[b] - {None}) > 1 for b in bs) >= least}
        for often in (10, 1000):
            assert {r.file_id for r in P.recurring(df, least, often).collect()} == want


def test_recurrence_among_many_near_texts(spark):
    """a copy is found beside any number of other texts that share its frequent parts without being alike; blocks of texts and of pairs give the same."""
    rng = np.random.default_rng(5)
    rows, want = [], set()

    def changed(words, times):
        """Five shingles go and five come with each change."""
        out = list(words)
        for at in 6 + 6 * rng.permutation(64)[:times]:
            out[at] = f"c{rng.integers(0, 10**9)}"
        return " ".join(out)

    for g in range(8):
        words = [f"w{i}" for i in rng.integers(0, 10**6, 400)]
        for i in range(60):  # 21 changes: 291 of 501, 0.58
            rows.append((len(rows), f"r{i % 6}", f"/r{i % 6}/d{g}_{i}.py", changed(words, 21)))
        want |= {len(rows), len(rows) + 1}
        rows.append((len(rows), "a", f"/a/x{g}.py", " ".join(words)))
        rows.append((len(rows), "r3", f"/r3/y{g}.py", changed(words, 13)))  # 331 of 461, 0.718
    df = spark.createDataFrame(rows, "file_id long, project string, file_path string, content string")
    assert {r.file_id for r in P.copies(P.seen_files(df), df).collect()} == want


def test_blocks_give_what_a_plain_count_gives(spark, tmp_path, monkeypatch):
    """texts of many sizes around the bound, in small blocks: all pairs are those of a count over all pairs."""
    monkeypatch.setattr(P, "BLOCK_PAIRS", 50)
    rng = np.random.default_rng(6)
    texts = []
    for _ in range(12):
        words = [f"w{i}" for i in rng.integers(0, 60 if rng.random() < 0.3 else 10**6, rng.integers(5, 120))]
        for _ in range(8):
            out = words[: rng.integers(max(5, len(words) // 2), len(words) + 1)]
            for at in rng.integers(0, len(out), rng.integers(0, 4)):
                out[at] = "changed"
            texts.append(" ".join(out))
    texts = sorted(set(texts), key=lambda t: len(set(P.sketch(t)[1].tolist())))
    sets = [set(P.sketch(t)[1].tolist()) for t in texts]
    want = {(i, j) for i in range(len(sets)) for j in range(i) if 10 * len(sets[i] & sets[j]) >= 7 * len(sets[i] | sets[j])}
    places, ends = P._plan({5: 7000, 6: 10, 7: 2000, 8: 2000})
    assert places == [(5, 0, 3), (6, 3, 1), (7, 3, 1), (8, 4, 1)] and ends == [(5, 5)] * 3 + [(6, 7), (8, 8)]
    assert len(want) > 50
    rows = [(P.sketch(t)[0], i, *P.condensed(P.sketch(t)[1], None)) for i, t in enumerate(texts)]
    blocks = []
    for k in range(0, len(rows), 20):
        at = str(tmp_path / f"{k}.parquet")
        pq.write_table(pa.table(dict(zip(("digest", "repo", "n", "rare", "parity"), map(list, zip(*rows[k : k + 20]))))), at)
        blocks.append(P._Block([at]))
    number, found = {r[0]: r[1] for r in rows}, set()
    for i, left in enumerate(blocks):
        for right in blocks[i:]:
            for x, y, _ in left.near(right):
                found |= {tuple(sorted((number[a], number[b]), reverse=True)) for a, b in zip(left.digest[x].tolist(), right.digest[y].tolist())}
    assert want <= found and len(found) < 3 * len(want)


def test_leading_comments_in_linear_time():
    assert P.head_of("#!/bin/x\n/* a */\n// b\n\n# c\nx = 1") == "#!/bin/x\n/* a */\n// b\n\n# c\n"
    for text in (" " * 1_000_000 + "x", "\n" * 1_000_000, "/*" * 500_000, "* " * 500_000, "//\n" * 300_000 + "x"):
        P.weak_label("/a.py", "p", text[:200_000])
        P.features("/a.py", "p", text)
        P.bands(text)


def test_a_pair_of_blocks_costs_what_it_has_in_common(tmp_path):
    """two full blocks with few shingles in common take no time and memory for each of the nine million pairs."""
    import tracemalloc

    rng, blocks = np.random.default_rng(8), []
    for k in range(2):
        rows = []
        for i in range(P.BLOCK_TEXTS):
            own = rng.integers(0, 1 << 63, 40).astype(np.uint64)
            own[:20] = np.arange(20, dtype=np.uint64) * np.uint64(3 << 40) + np.uint64(i // 10 << 50)
            rows.append((k * P.BLOCK_TEXTS + i, k, *P.condensed(own, None)))
        at = str(tmp_path / f"{k}.parquet")
        pq.write_table(pa.table(dict(zip(("digest", "repo", "n", "rare", "parity"), map(list, zip(*rows))))), at)
        blocks.append(P._Block([at]))
    tracemalloc.start()
    x, y, m = blocks[0].common(blocks[1])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(x) and (x // 10 == y // 10).all() and m.max() <= 13
    assert peak < 40e6


def test_cheap_ways_give_what_plain_ones_give():
    """hashes and labels as told by plain definitions."""
    import re

    tricky = ["", "a", "abc", "0123456", "abcdefg", "x = 'é' * 3 # \ud800", "t1rue, f2alse, nul3l", "[true, false, None]\n" * 30, "{'a': 1, \"b\": `two\nlines`, c: -1.5e-3, d: 0xFFab}\n" * 20, "-x+y-1+2" * 40, "١٢٣, ٤٥\n" * 60, "'open\n" + "1, 2\n" * 90, "g" * 29 + "1, " * 90]
    tricky += ["1" * 271 + sign * n for n in (28, 29, 30, 31, 32) for sign in "ghjkmpqvwyzGXxbct=.-+_@\\\"'`"]
    texts = tricky + [t for t in pq.read_table(f"{SF}/files.parquet", columns=["content"]).column("content").to_pylist() if t is not None]
    for text in texts:
        rest = P._NUMBER.sub("", P._STRING.sub(" ", text))
        shares = [1 - len(r.translate(P._BETWEEN)) / max(1, len(text)) for r in (rest, P._CONSTANT.sub("", rest))]
        assert P._mainly_literal(text) == ((shares[0] if shares[0] > 0.9 or shares[0] < 0.5 else shares[1]) > 0.9)
    for text in texts[::7] + tricky:
        raw = re.sub(rb"[0-9]", b"0", text.encode("utf-8", "surrogatepass"))
        want, mask = [], (1 << 64) - 1
        for size, by in ((4, int(P._MULT)), (7, int(P._MULT) ** 2)):
            for i in range(len(raw) - size + 1 if len(raw) >= 4 else 0):
                h = int.from_bytes(raw[i : i + size], "little") * by & mask
                want.append(((h ^ h >> 29) * int(P._MULT) & mask) >> 48)
        assert P._ngrams(text).tolist() == want
        words = re.findall(rb"[0-9A-Za-z_\x80-\xff]+|[^0-9A-Za-z_\x80-\xff\x09-\x0d ]", text.encode("utf-8", "surrogatepass"))
        got = P.word_hashes(text).tolist()
        assert len(got) == len(words) and len(set(got)) == len(set(words)) == len(set(zip(got, words)))
        shingles = P.sketch(text)[1]
        assert (P._distinct(shingles) == np.unique(shingles)).all()
