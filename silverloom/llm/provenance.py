"""Generated, minified, third-party and data-only source files.

One linear support-vector classifier per kind is trained on hashed features: character n-grams of the text, path components with
the pieces of the file name, and whether the file recurs in other repositories. The labels are giveaways (generator and licence
headers, exact path components, suffixes, line and literal statistics). The leading comment, where the giveaway headers stand, and marks such as
``sourceMappingURL`` are masked in every row, when training as when scoring, and no label rule is a feature. The regularisation and the thresholds are chosen on
other repositories than those trained on.

A file is of a kind if its margin is above the kind's threshold. Below the threshold lies a band that reaches down to the margins that labelled rows of
other repositories still had; there, and only there, an exact check follows: the file counts if the giveaways name the kind. (Code of third parties that stands alone in its
repository reads like any other; without the check such files would be missed.)

Recurrence: a file recurs if its text without the leading comment is the same as that of a file of another repository, or if at least ``SAME`` of their
five-word shingles are (intersection by union, counted on the whole sets of 64-bit hashes). The search is exact, no partner is left out. Equal texts are merged first. All texts
keep the rarest 30 % of their shingles, in one order for all; two texts at ``SAME`` must have a number of these in common that follows from their sizes, and bitmaps of parities bound
the difference of their sets from below; pairs that pass both are counted. Texts are sorted by size into blocks, and each block meets all blocks of sizes that can reach ``SAME``, so that the work grows with
the square of the texts, the memory of a task does not. How rare a shingle is, is told by a sample; that decides about speed, not about results.
A row without a project belongs to the first known project that its path names; if it names
none, it stands in a repository of its own. Texts under five words have no shingles and never recur.

The classifiers are fitted on a sample of about ``SAMPLE`` rows of any length, drawn by a hash of file_id; of a
kind that would come out rare, more rows are drawn, up to ``QUOTA``. All rows are labelled for that and all are scored, by their whole texts. Only hashed vectors of the
sample reach the driver. A kind with fewer than ``LEAST`` labelled rows has no classifier; its files are told by the giveaways themselves, third-party ones also by recurrence.

Defined cases: null content gives no row; an empty text is hand-written; a null path or project has no features of its own; copies of a row are
judged one by one; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from silverloom.sources.positions import FILE, ROW, _open, read_rows, row_vectors, scanned, with_position

SAMPLE, QUOTA, LEAST = 4000, 200, 20
#: How far below the threshold, and below the margins that labelled rows of other repositories have, the exact check looks.
BAND = 1.0
BITS = 16
DIM = 1 << BITS
KINDS = ("generated", "minified", "third_party", "data")

#: Share of common shingles from which a text is a copy.
SAME = 0.7
#: Texts and rare shingles in a block, pairs of equal shingles looked at in one go.
BLOCK_TEXTS, BLOCK_RARE, BLOCK_PAIRS = 3000, 2_000_000, 2_000_000
#: Texts of which the shingles are counted to tell rare ones, and counters for them.
COUNTED, COUNTER_BITS = 4000, 22
#: Share of blanks that a minified text stays under (in sf0.1 they are at most 0.05).
MINIFIED_BLANKS = 0.15
#: Kinds a file may be of besides: a table may be generated and data at once, and the text of third-party code is like any other.
NO_COUNTEREXAMPLE = {"generated": ["data", "third_party"], "data": ["generated", "third_party"], "minified": ["third_party"], "third_party": ["generated", "minified", "data"]}

#: Directories and suffixes that give a file away.
VENDOR_DIRS = frozenset("node_modules vendor vendors _vendor third_party thirdparty third-party 3rdparty external externals deps bower_components jspm_packages Godeps _workspace site-packages Pods Carthage".split())
GENERATED_DIRS = frozenset("gen generated __generated__ autogen generated-sources generated_sources generated-src".split())
_GENERATED_NAME = re.compile(r"(?:^|/)zz_generated\.[^/]*$|(\.pb\.\w+|_pb2(_grpc)?\.py|\.g\.\w+|\.gen\.\w+|\.generated\.\w+|_generated\.\w+|\.designer\.\w+)$", re.I)
_MINIFIED_NAME = re.compile(r"[.\-_](min|bundle|chunk|prod)\.\w+$|\.[0-9a-f]{8,}\.\w+$", re.I)
_GENERATED_HEAD = re.compile(
    r"\b(code |file |was |is |were )?(auto(matically)?[ -]?)?(generated|emitted|built|written|produced|created) (by|from|with) \S+ ?v?\d|@generated\b|\bautogenerated\b|\bauto-generated\b|automatically generated|machine[ -]generated"
    r"|code generated by .*do not edit|do not (edit|change|modify)[;,.:]? (re-?run|this file)|do not (edit|change|modify)\W*$|will be (lost|overwritten)|regenerate with|machine-made|produced by a tool|produit automatiquement|automatisch erzeugt|généré automatiquement|generado automáticamente|gerado automaticamente", re.I | re.M
)
_FOREIGN_HEAD = re.compile(r"taken (unchanged|verbatim|with changes)? ?from \S+ v?\d|\(c\) .+ (and )?contributors|released under the|licensed under the .* see LICENSE|^[^\w\n]*+[\w.-]++ v\d+(\.\d+)+[^\S\n]*$", re.I | re.M)
_LEADING = re.compile(r"(?>\s*)(?:#![^\n]*+\n)?(?>(?:\s*+(?:/\*.*?\*/|//[^\n]*+(?:\n|\Z)|\#[^\n]*+(?:\n|\Z)|\"\"\".*?\"\"\"|<!--.*?-->))*)", re.S)
_OTHER_GIVEAWAYS = re.compile(r"sourceMappingURL[^\n]*|sourceURL=[^\n]*|@generated|DO NOT EDIT")
_MARKS = ("sourceMappingURL", "sourceURL=", "@generated", "DO NOT EDIT")
_STRING = re.compile(r"`[^`]*`|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'")
_NUMBER = re.compile(r"[-+]?\d[\d_.,eExXa-fA-F]*")
_CONSTANT = re.compile(r"\b(?:true|false|null|None|nil|True|False)\b")
_BETWEEN = dict.fromkeys(map(ord, "[]{}(),:; \t\n\r\v\f"))
#: Bytes that a constant or what stands between literals may have, and those of numbers besides; letters and signs beyond them stand in no literal.
_MAYBE_CONSTANT = bytes(set(range(256)) - set(range(33, 127)) | set(b"[]{}(),:;truefalsnoiNTF"))
_MAYBE_LITERAL = _MAYBE_CONSTANT + b"+-_.0123456789bcdxABCDEX"
_BLANKS = re.compile(r"\s+")
_LONG_LITERAL = re.compile(r"[\"'`][A-Za-z0-9+/=\\]{200,}[\"'`]")


def head_of(text: str) -> str:
    return _LEADING.match(text)[0]


def giveaways(path: str, project: str, text: str) -> Iterator[str]:
    """The kinds the giveaways speak for, the strongest first."""
    head = head_of(text)
    parts = path.split("/")
    body = text[len(head) :]
    lines = body.count("\n") + 1
    if _MINIFIED_NAME.search(path) or (len(body) > 400 and len(body) / lines > 200 and not _LONG_LITERAL.search(body) and _literal_share(body) < 0.7):
        yield "minified"
    if _GENERATED_NAME.search(path) or GENERATED_DIRS & set(parts[:-1]) or _GENERATED_HEAD.search(head):
        yield "generated"
    if VENDOR_DIRS & set(parts[:-1]) or (_FOREIGN_HEAD.search(head) and not (project and project in head)):
        yield "third_party"
    if len(body) > 200 and _mainly_literal(body):
        yield "data"


def weak_label(path: str, project: str, text: str) -> str:
    """The kind of the strongest giveaway, or "hand"."""
    return next(giveaways(path, project, text), "hand")


def _told(path: str, project: str, text: str, kinds: set[str]) -> list[str]:
    """Which of ``kinds`` the giveaways name; minified by its lines only if it has few blanks, as these are what minifying removes."""
    return [k for k in giveaways(path, project, text) if k in kinds and (k != "minified" or _MINIFIED_NAME.search(path) or sum(map(len, _BLANKS.findall(text))) < MINIFIED_BLANKS * len(text))]


def _literal_share(text: str) -> float:
    """Share of strings, numbers, constants and what stands between them."""
    return _share(_NUMBER.sub("", _STRING.sub(" ", text)), len(text))


def _share(rest: str, size: int) -> float:
    """The same from the text without strings and numbers."""
    share = 1 - len(rest.translate(_BETWEEN)) / max(1, size)
    return share if share > 0.9 or share < 0.5 else 1 - len(_CONSTANT.sub("", rest).translate(_BETWEEN)) / max(1, size)


def _mainly_literal(text: str) -> bool:
    """Whether the literal share is above 0.9. Most code is told by the letters and signs that stand in no literal, before constants, or numbers too, are looked for."""
    rest, most = _STRING.sub(" ", text), 0.1 * len(text) + 1
    if len(rest.encode("utf-8", "surrogatepass").translate(None, _MAYBE_LITERAL)) > most:
        return False
    rest = _NUMBER.sub("", rest)
    if len(rest.encode("utf-8", "surrogatepass").translate(None, _MAYBE_CONSTANT)) > most:
        return False
    return _share(rest, len(text)) > 0.9


_MULT = np.uint64(0x9E3779B97F4A7C15)


_MULT_7 = np.uint64(int(_MULT) ** 2 % (1 << 64))
_DIGITS = bytes(48 if 48 <= i <= 57 else i for i in range(256))


def _ngrams(text: str) -> np.ndarray:
    """Hashes of all character 4- and 7-grams; digits count as 0."""
    raw = text.encode("utf-8", "surrogatepass").translate(_DIGITS)
    n = len(raw)
    if n < 4:
        return np.zeros(0, np.uint32)
    raw += bytes(4)
    four = np.ndarray(n - 3, "<u4", raw, 0, 1).astype(np.uint64)  # the bytes from each place on, as numbers
    seven = np.ndarray(max(0, n - 6), "<u8", raw, 0, 1) & np.uint64((1 << 56) - 1)
    out = np.empty(len(four) + len(seven), np.uint32)
    for part, by, at in ((four, _MULT, out[: len(four)]), (seven, _MULT_7, out[len(four) :])):
        part *= by
        part ^= part >> np.uint64(29)
        part *= _MULT
        part >>= np.uint64(64 - BITS)
        at[:] = part
    return out


def _firsts(a: np.ndarray) -> np.ndarray:
    """Where a sorted array has a new value."""
    new = np.ones(len(a), bool)
    np.not_equal(a[1:], a[:-1], out=new[1:])
    return np.flatnonzero(new)


def _runs(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where a sorted array has a new value, and how often it has it."""
    first = _firsts(a)
    times = np.empty_like(first)
    np.subtract(first[1:], first[:-1], out=times[:-1])
    times[-1:] = len(a) - first[-1:]
    return first, times


def _distinct(a: np.ndarray) -> np.ndarray:
    """The different values, sorted (``np.unique`` takes five times as long for a short array)."""
    a = np.sort(a)
    return a[_firsts(a)]


@lru_cache(1 << 16)
def _hash(token: str) -> int:
    return xxhash.xxh64_intdigest(token.encode("utf-8", "surrogatepass")) >> (64 - BITS)


def _path_tokens(path: str, project: str) -> list[str]:
    """The folders, but for the project's own, and the pieces of the file name."""
    parts = [p for p in path.split("/") if p]
    pieces = re.split(r"(?=[._\-])", parts[-1]) if parts else []
    return [f"dir:{p}" for p in parts[:-1] if p != project] + [f"suffix:{re.sub(r'[0-9a-f]{6,}', '#', p)}" for p in pieces[1:]]


def features(path: str, project: str, text: str) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values: each n-gram of the text without its leading comment by the root of its share (so that they have length 1), each path token by 1."""
    body = text[len(head_of(text)) :]
    grams = np.sort(_ngrams(_OTHER_GIVEAWAYS.sub("", body) if any(m in body for m in _MARKS) else body))
    first, count = _runs(grams)
    tokens = sorted({_hash(t) for t in _path_tokens(path, project)})
    idx, val = np.empty(len(first) + len(tokens), np.int32), np.ones(len(first) + len(tokens), np.float32)
    idx[: len(first)] = grams[first]
    idx[len(first) :] = [t + DIM for t in tokens]
    val[: len(first)] = np.sqrt(count / max(1, len(grams)))
    return idx, val


RECURS, BIAS = 2 * DIM, 2 * DIM + 1


@dataclass
class Model:
    weights: np.ndarray  # (n-grams, path tokens, recurrence, bias) x kinds
    thresholds: np.ndarray  # infinite for a kind without a classifier
    lows: np.ndarray  # where the band of the exact check begins

    def margins(self, path: str, project: str, text: str) -> np.ndarray:
        """Of a file that does not recur; one that does has the weights of RECURS on top."""
        idx, val = features(path, project, text)
        return val @ self.weights.take(idx, axis=0) + self.weights[BIAS]


def _fit(xs: list, y: np.ndarray, lam: float, epochs: int = 6, seed: int = 7) -> np.ndarray:
    """Averaged subgradient descent on the hinge loss of all kinds at once, rare positives weighted up. ``y``: 1, -1 or 0 (left out), rows x kinds."""
    w, total = np.zeros((BIAS + 1, y.shape[1])), np.zeros((BIAS + 1, y.shape[1]))
    rng = np.random.default_rng(seed)
    up = np.clip((y < 0).sum(axis=0) / np.maximum(1, (y > 0).sum(axis=0)), 1.0, 10.0)
    gain = np.where(y > 0, up, 1.0) * y
    scale, step, n = 1.0, 0, 0
    for epoch in range(epochs):
        for i in rng.permutation(len(xs)):
            step += 1
            eta = 1.0 / (lam * (step + 1.0 / lam))
            idx, val = xs[i]
            short = y[i] * scale * (val @ w.take(idx, axis=0)) < 1
            scale *= 1.0 - eta * lam
            g = np.where(short, gain[i], 0.0)
            if g.any():
                w[idx] += np.outer(val, g * (eta / scale))
        if epoch >= epochs // 2:
            total += scale * w
            n += 1
    return total / n


def train(rows: list[tuple[str, str, bool, np.ndarray, np.ndarray]]) -> tuple[Model, dict]:
    """Trains on (project, weak label, recurs, indices, values); gives the model and its figures on held-out repositories. The list is emptied on the way, as it is large."""
    labels, projects, xs = np.array([r[1] for r in rows], dtype=object), [r[0] for r in rows], []
    rows.reverse()
    while rows:
        _, _, recurs, idx, val = rows.pop()
        xs.append((np.concatenate([idx, np.array([RECURS, BIAS] if recurs else [BIAS], np.int32)]), np.concatenate([val, np.ones(1 + recurs, np.float32)])))
    y = np.array([[0.0 if x in NO_COUNTEREXAMPLE[kind] else 1.0 if x == kind else -1.0 for kind in KINDS] for x in labels]).reshape(len(labels), len(KINDS))
    fit = (y > 0).sum(axis=0) >= LEAST
    thresholds, lows, report = np.where(fit, 0.0, np.inf), np.where(fit, 0.0, np.inf), {}
    if not fit.any():
        return Model(np.zeros((BIAS + 1, len(KINDS)), np.float32), thresholds, lows), report
    held = set(sorted(set(projects))[4::5])
    validation = np.array([p in held for p in projects])
    if not validation.any() or validation.all():
        return Model(_fit(xs, y, 1e-3).astype(np.float32), thresholds, lows), report
    there, best = np.flatnonzero(validation), None
    for lam in (3e-4, 1e-3, 3e-3):
        w = _fit([xs[i] for i in np.flatnonzero(~validation)], y[~validation], lam)
        margins = np.array([xs[i][1] @ w.take(xs[i][0], axis=0) for i in there])
        loss = np.where(y[there] != 0, np.maximum(0, 1 - y[there] * margins), 0).mean()
        if best is None or loss < best[0]:
            best = (loss, lam, margins)
    for k in np.flatnonzero(fit):
        true, judged = y[there, k] > 0, y[there, k] != 0
        margin = best[2][:, k]
        if true.any():
            steps = [0.0, 0.25, 0.5, -0.25, 0.75, 1.0]
            f1 = [2 * ((margin > t) & true).sum() / max(1, ((margin > t) & judged).sum() + true.sum()) for t in steps]
            thresholds[k] = steps[int(np.argmax(f1))]
            lows[k] = min(thresholds[k], margin[true].min()) - BAND
        hit = judged & (margin > thresholds[k])
        report[KINDS[k]] = {"hits": int((hit & true).sum()), "labelled": int(true.sum()), "flagged": int(hit.sum()), "threshold": float(thresholds[k]), "low": float(lows[k])}
    return Model(np.ascontiguousarray(_fit(xs, y, best[1]).astype(np.float32)), thresholds, lows), report


# --- recurrence

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xFF51AFD7ED558CCD)
_INVERSE = np.uint64(pow(int(_ODD), -1, 1 << 64))
_CLASS = np.full(256, 2, np.uint8)  # 0 white space, 1 letters, digits and all beyond ASCII, 2 signs
_CLASS[[9, 10, 11, 12, 13, 32]] = 0
_CLASS[[*range(48, 58), *range(65, 91), *range(97, 123), 95, *range(128, 256)]] = 1
_CLASSES = _CLASS.tobytes()


@lru_cache(8)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of an odd number and of its inverse, modulo 2 ** 64."""
    up, down = np.full(size, _ODD, np.uint64), np.full(size, _INVERSE, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of every word and every sign, from running sums over the bytes."""
    raw = text.encode("utf-8", "surrogatepass")
    if not raw:
        return np.zeros(0, np.uint64)
    up, down = _powers(1 << max(12, (len(raw) + 1).bit_length()))
    cls = np.frombuffer(b"\0" + raw.translate(_CLASSES) + b"\0", np.uint8)
    inside = cls[1:] & cls[:-1] & 1  # between two bytes of a word
    start, end = np.flatnonzero(cls[1:-1] > inside[:-1]), np.flatnonzero(cls[1:-1] > inside[1:]) + 1
    total = np.zeros(len(raw) + 1, np.uint64)
    b = np.frombuffer(raw, np.uint8) + np.uint64(1)
    b *= up[: len(raw)]
    np.cumsum(b, out=total[1:])
    h = (total[end] - total[start]) * down[start] * _MIX
    return h ^ (h >> np.uint64(31))


def _shingles(ids: np.ndarray) -> np.ndarray:
    """Hashes of every five words on end, repeated ones too; none under five words."""
    if len(ids) < 5:
        return np.zeros(0, np.uint64)
    h = np.zeros(len(ids) - 4, np.uint64)
    for k in range(5):
        h = (h ^ ids[k : len(ids) - 4 + k]) * _MIX
        h ^= h >> np.uint64(33)
    return h * _ODD


def bands(text: str) -> list[int]:
    """16 band keys of the MinHash signature of the five-word shingles; none for texts under five words.

    The signature is made by one permutation in 64 bins; an empty bin borrows from the next one that is not.
    """
    ids = word_hashes(text)
    return _signature(_shingles(ids)) if len(ids) >= 5 else []


def _signature(h: np.ndarray) -> list[int]:
    """The band keys."""
    keyed = np.sort(((h % np.uint64(64)) << np.uint64(57)) | (h >> np.uint64(7)))
    bins = (keyed >> np.uint64(57)).astype(np.int64)
    first = _firsts(bins)
    full, values = bins[first], keyed[first] & np.uint64((1 << 57) - 1)
    at = np.searchsorted(full, np.arange(64))
    away = np.where(at < len(full), full[np.minimum(at, len(full) - 1)], full[0] + 64) - np.arange(64)
    low = values[at % len(full)] + away.astype(np.uint64) * _ODD
    out = np.arange(16, dtype=np.uint64)
    for k in range(4):
        out = (out ^ low[k::4]) * _MIX
        out ^= out >> np.uint64(29)
    return out.view(np.int64).tolist()


def sketch(text: str) -> tuple[int | None, np.ndarray]:
    """A hash of the words without the leading comment, and their shingles; None and no shingles under five words."""
    ids = word_hashes(text[len(head_of(text)) :])
    return (xxhash.xxh64_intdigest(ids.tobytes()) - (1 << 63) if len(ids) >= 5 else None), _shingles(ids)


def _in_many(all_bands: DataFrame, often: int) -> DataFrame:
    """The rows of ``all_bands`` (repo, band and others; repo null if unknown) whose band occurs in more than one repository.

    Bands of more than ``often`` rows are looked up in a broadcast table, all others by a shuffled join.
    """
    shared = all_bands.groupBy("band").agg(F.min("repo").alias("a"), F.max("repo").alias("b"), F.count(F.lit(1)).alias("n")).filter("a <> b").select("band", "n")
    hot = F.broadcast(shared.filter(F.col("n") > often).select("band", F.lit(1).alias("hot")))
    rows = all_bands.join(hot, "band", "left")
    return rows.filter("hot = 1").drop("hot").unionByName(rows.filter("hot IS NULL").drop("hot").join(shared.filter(F.col("n") <= often), "band", "left_semi"))


def recurring(sketches: DataFrame, least: int = 1, often: int = 50_000) -> DataFrame:
    """file_id of the files of which at least ``least`` bands occur in more than one repository. ``sketches``: file_id, project, bands.

    Rows without a project can recur, but are no repository; at most 2,000 bands are so frequent that they are broadcast.
    """
    often = max(often, 16 * sketches.count() // 2000)
    all_bands = sketches.select("file_id", F.when(F.col("project").isNotNull(), F.xxhash64("project")).alias("repo"), F.explode("bands").alias("band"))
    return _in_many(all_bands, often).groupBy("file_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least).select("file_id")


def _repositories(scored: DataFrame) -> DataFrame:
    """``scored`` with the column repo: a hash of the project, else of the first known project in the path, else of nothing; null without a path."""
    lost = scored.filter("project IS NULL")
    names = scored.filter("project IS NOT NULL").select(F.col("project").alias("part")).distinct()
    parts = lost.select("file_id", F.posexplode(F.split("place", "/")).alias("pos", "part"))
    named = parts.join(names, "part").groupBy("file_id").agg(F.min(F.struct("pos", "part")).alias("first")).select("file_id", F.xxhash64("first.part").alias("named"))
    elsewhere = F.when(F.col("place") != "", F.coalesce("named", F.xxhash64(F.lit("\0"))))
    return scored.filter("project IS NOT NULL").withColumn("repo", F.xxhash64("project")).unionByName(lost.join(named, "file_id", "left").withColumn("repo", elsewhere).drop("named"))


def _least_common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many elements sets of these sizes must have in common to be alike."""
    return np.ceil(SAME / (1 + SAME) * (a + b) - 1e-6).astype(np.int64)


def _rare_size(n):
    """How many of its rarest shingles a text keeps: one at least is in any part of it that a text alike could have."""
    return n - np.ceil(SAME * n - 1e-6).astype(np.int64) + 1


def condensed(shingles: np.ndarray, counts: np.ndarray | None) -> tuple[int, bytes, bytes]:
    """The number of different shingles, the upper halves of the rarest ones, and the parities of all in a bitmap of two to four bits a shingle."""
    h = _distinct(shingles)
    n = len(h)
    rare = h if counts is None else h[np.argsort(counts[(h >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)], kind="stable")]
    size = 1 << max(6, (2 * n - 1).bit_length())
    odd = np.bincount(((h >> np.uint64(16)) & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return n, (rare[: int(_rare_size(n))] >> np.uint64(32)).astype(np.uint32).tobytes(), np.packbits(odd.astype(np.uint8)).tobytes()


def shingle_counts(files: DataFrame) -> np.ndarray:
    """How often shingles occur in about ``COUNTED`` of the files, by the upper bits of their hashes."""
    share = int(1_000_000 * min(1.0, COUNTED / max(1, files.count())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << COUNTER_BITS, np.int32)
        for batch in batches:
            for text in batch.column("content").to_pylist():
                np.add.at(total, (_distinct(sketch(text)[1]) >> np.uint64(64 - COUNTER_BITS)).astype(np.int64), 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int32())], names=["at", "n"])

    drawn = files.filter(F.col("content").isNotNull() & (F.pmod(F.xxhash64("file_id"), F.lit(1_000_000)) < share)).select("content")
    got = drawn.mapInArrow(run, "at long, n int").groupBy("at").agg(F.sum("n").alias("n")).filter("n > 1").toArrow()  # at most one row per counter
    counts = np.zeros(1 << COUNTER_BITS, np.uint16)
    counts[got["at"].to_numpy()] = np.minimum(got["n"].to_numpy(), 65_535)
    return counts


class _Block:
    """Texts of like size: digests, sizes, repositories and the sorted rare shingles, each with its owners. Copies of a text are merged."""

    def __init__(self, uris: list[str]):
        t = pa.concat_tables([_open(uri).read(columns=["digest", "repo", "n", "rare", "parity"]) for uri in uris])
        digests, repos, known = t["digest"].to_numpy(), t["repo"].fill_null(0).to_numpy(), t["repo"].is_valid().to_numpy()
        self.digest, at, owner = np.unique(digests, return_index=True, return_inverse=True)
        self.size = t["n"].to_numpy()[at].astype(np.int64)
        ends = np.iinfo(np.int64)
        self.low, self.high = np.full(len(at), ends.max), np.full(len(at), ends.min)
        np.minimum.at(self.low, owner[known], repos[known])
        np.maximum.at(self.high, owner[known], repos[known])
        self.known = self.low <= self.high  # stands in a repository
        self.lost = np.zeros(len(at), bool)  # has rows of which the repository is not known
        self.lost[owner[~known]] = True
        self.settled = self.low < self.high  # equal texts in two repositories
        picked = t.select(["rare", "parity"]).take(pa.array(at))
        rare = [np.frombuffer(x, np.uint32) for x in picked["rare"].to_pylist()]
        self.kept = np.array([len(x) for x in rare])
        rows = np.sort(np.concatenate(rare).astype(np.uint64) << np.uint64(32) | np.repeat(np.arange(len(at), dtype=np.uint64), self.kept))
        tokens, self.owners = (rows >> np.uint64(32)).astype(np.uint32), (rows & np.uint64(0xFFFFFFFF)).astype(np.int64)
        self.first, self.times = _runs(tokens)
        self.tokens = tokens[self.first]
        self.parity = picked["parity"].to_pylist()
        self.bytes = np.array([len(p) for p in self.parity])

    def common(self, other: "_Block") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs with rare shingles in common, and how many these are at most."""
        at = np.minimum(np.searchsorted(self.tokens, other.tokens), len(self.tokens) - 1)
        both = self.tokens[at] == other.tokens
        owners = other.owners[np.repeat(both, other.times)]
        low, times = (np.repeat(x[at[both]], other.times[both]) for x in (self.first, self.times))
        width, done = len(other.digest), np.cumsum(times)

        def keys(a: int, b: int) -> np.ndarray:
            t = times[a:b]
            mine = self.owners[np.repeat(low[a:b] - (np.cumsum(t) - t), t) + np.arange(t.sum())]
            return mine * width + np.repeat(owners[a:b], t)

        if not len(times) or done[-1] <= BLOCK_PAIRS:
            key = np.sort(keys(0, len(times)))
            first, n = _runs(key)
            key = key[first]
            return key // width, key % width, n
        total, a = np.zeros(len(self.digest) * width, np.int32), 0
        while a < len(times):
            b = max(a + 1, int(np.searchsorted(done, (done[a - 1] if a else 0) + BLOCK_PAIRS, "right")))
            total += np.bincount(keys(a, b), minlength=len(total)).astype(np.int32)
            a = b
        key = np.flatnonzero(total)
        return key // width, key % width, total[key].astype(np.int64)

    def asks(self, x: np.ndarray, other: "_Block", y: np.ndarray) -> np.ndarray:
        """Whether a row of the text x recurs if the text y of the other block is like it."""
        return ~self.settled[x] & other.known[y] & (self.lost[x] | (self.low[x] != other.low[y]) | (self.low[x] != other.high[y]))

    def near(self, other: "_Block") -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Pairs that can be alike, with at least how many shingles they differ by."""
        x, y, m = self.common(other)
        a, b = self.size[x], other.size[y]
        need = _least_common(a, b)
        ok = (np.minimum(a, b) >= need) & (m + np.maximum(a - self.kept[x], b - other.kept[y]) >= need)
        if other is self:
            ok &= x < y
        x, y, differ = x[ok], y[ok], (a + b - 2 * need)[ok]
        ok = self.asks(x, other, y) | other.asks(y, self, x)
        x, y, differ = x[ok], y[ok], differ[ok]
        lengths = self.bytes[x], other.bytes[y]
        for la, lb in set(zip(lengths[0].tolist(), lengths[1].tolist())):
            of = np.flatnonzero((lengths[0] == la) & (lengths[1] == lb))
            step = max(1, (1 << 23) // max(la, lb))
            for at in range(0, len(of), step):
                part = of[at : at + step]
                bits = [np.frombuffer(b"".join([parity[i] for i in which[part].tolist()]), np.uint8).reshape(len(part), -1) for parity, which in ((self.parity, x), (other.parity, y))]
                short = min(la, lb)
                bits = [np.bitwise_xor.reduce(v.reshape(len(part), -1, short), axis=1) for v in bits]  # the larger bitmap folded
                far = np.bitwise_count((bits[0] ^ bits[1]).view(np.uint64)).sum(axis=1, dtype=np.int64)
                can = far <= differ[part]
                yield x[part][can], y[part][can], far[can]


def _plan(sizes: dict[int, int]) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]]]:
    """Blocks for texts by size, of which ``sizes`` has the numbers: (size, first block, blocks) of each, and the least and largest size in each block."""
    places, ends, texts, rare = [], [], 0, 0
    for n, count in sorted(sizes.items()):
        kept = int(_rare_size(n))
        parts = max(-(-count // BLOCK_TEXTS), -(-count * kept // BLOCK_RARE))
        if parts > 1 or not ends or texts + count > BLOCK_TEXTS or rare + count * kept > BLOCK_RARE:
            places.append((n, len(ends), parts))
            ends += [(n, n)] * parts
            texts, rare = (count, count * kept) if parts == 1 else (BLOCK_TEXTS, BLOCK_RARE)
        else:
            places.append((n, len(ends) - 1, 1))
            ends[-1] = (ends[-1][0], n)
            texts, rare = texts + count, rare + count * kept
    return places, ends


_NEAR = "digest long, like long, low long, high long, whole boolean, far long"


def _near(uris: dict[int, list[str]], ends: list[tuple[int, int]], spark) -> DataFrame:
    """Texts (digest) and others (like, its least and largest repository) that can be alike; whole: enough for all rows of the text."""
    last = np.searchsorted([SAME * low - 1e-6 for low, _ in ends], [high for _, high in ends], "right") - 1  # blocks are sorted by size
    tasks = [(i, int(last[i])) for i in sorted(uris)]
    if not tasks:
        return spark.createDataFrame([], _NEAR)
    shared = spark.sparkContext.broadcast(uris)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, last, start in zip(*(batch.column(c).to_pylist() for c in ("i", "last", "start"))):
                left = _Block(shared.value[i])
                for j in range(start, min(start + 7, last) + 1):
                    if j not in shared.value:
                        continue
                    right = left if j == i else _Block(shared.value[j])
                    for x, y, far in left.near(right):
                        for one, u, two, v in ((left, x, right, y), (right, y, left, x)):
                            ok = one.asks(u, two, v)
                            u, v = u[ok], v[ok]
                            whole = ~one.known[u] | (one.low[u] != two.low[v]) | (one.low[u] != two.high[v])
                            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (one.digest[u], two.digest[v], two.low[v], two.high[v], whole, far[ok])], names=["digest", "like", "low", "high", "whole", "far"])

    parts = min(10_000, sum((last - i) // 8 + 1 for i, last in tasks))
    return spark.createDataFrame(tasks, "i int, last int").select("*", F.explode(F.sequence("i", "last", F.lit(8))).alias("start")).repartition(parts).mapInArrow(run, _NEAR)


def copies(scored: DataFrame, files: DataFrame) -> DataFrame:
    """file_id of the files whose text recurs in another repository. ``scored``: ``seen_files`` of ``files``."""
    from silverloom.session import staged

    spark = files.sparkSession
    where = [c for c in (FILE, ROW) if c in scored.columns]
    told = scored.filter("digest IS NOT NULL")
    places, ends = _plan({r[0]: r[1] for r in told.groupBy("n").count().collect()})  # one row per size
    block = F.broadcast(spark.createDataFrame(places, "n int, first int, parts int"))
    rows = _repositories(told.select("file_id", "project", "place", "digest", "n", "rare", "parity", *where)).drop("project", "place").join(block, "n")
    rows = rows.withColumn("block", (F.col("first") + F.pmod(F.col("digest"), F.col("parts"))).cast("int")).drop("first", "parts")
    rows = staged(rows.repartition("block"), "files-blocks", ["block"])
    uris: dict[int, list[str]] = {}
    for uri in sorted(rows.inputFiles()) if places else []:
        uris.setdefault(int(re.search(r"/block=(\d+)/", uri)[1]), []).append(uri)
    rows = rows.drop("rare", "parity", "block")
    equal = rows.groupBy("digest").agg(F.min("repo").alias("a"), F.max("repo").alias("b")).filter("a <> b").select("digest")
    pairs = staged(_near(uris, ends, spark), "files-pairs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sketch(text) for text in batch.column("content").to_pylist()]
            sets = [_distinct(h).view(np.int64) for _, h in found]
            yield pa.RecordBatch.from_arrays([pa.array([digest for digest, _ in found], pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["digest", "shingles"])

    wanted = pairs.select("digest").union(pairs.select("like")).distinct()
    picked = rows.join(wanted, "digest", "left_semi").groupBy("digest").agg(F.min(F.struct("file_id", *where)).alias("m")).select("m.*")
    if where:  # no text is shuffled
        texts = read_rows(row_vectors(files, picked.select(FILE, ROW)), files.select("content").schema)
    else:
        texts = files.filter("content IS NOT NULL").select("file_id", "content").join(picked, "file_id", "left_semi").select("content")
    sets = staged(texts.mapInArrow(run, "digest long, shingles array<long>").dropDuplicates(["digest"]), "files-shingles")

    def counted(some: DataFrame) -> DataFrame:
        both = some.join(sets, "digest").join(sets.select(F.col("digest").alias("like"), F.col("shingles").alias("others")), "like")
        common = F.size(F.array_intersect("shingles", "others"))
        return both.filter(common >= SAME * (F.size("shingles") + F.size("others") - common) - 1e-6).select("digest", "low", "high", "whole")

    # first the nearest other text of each; all others of the texts that this does not settle
    first = pairs.groupBy("digest").agg(F.min(F.struct((~F.col("whole")).alias("part"), "far", "like", "low", "high", "whole")).alias("m")).select("digest", "m.like", "m.low", "m.high", "m.whole")
    first = staged(counted(first), "files-nearest")
    rest = counted(pairs.join(first.filter("whole").select("digest").distinct(), "digest", "left_anti"))
    alike = first.union(rest)
    by_text = rows.join(equal, "digest", "left_semi").select("file_id")
    other = F.col("r.repo").isNull() | (F.col("a.low") != F.col("r.repo")) | (F.col("a.high") != F.col("r.repo"))
    by_part = rows.alias("r").join(alike.alias("a"), (F.col("r.digest") == F.col("a.digest")) & other, "left_semi").select("file_id")
    return by_text.union(by_part).distinct()


def seen_files(files: DataFrame, counts: np.ndarray | None = None) -> DataFrame:
    """A row for each file with content, for fitting and recurrence: file_id, project, place (the path of a file without a project), label, digest, n, rare, parity (``condensed``);
    and, where ``files`` is a plain Parquet scan, its place in the files. ``counts``: ``shingle_counts``."""
    where = [FILE, ROW] if scanned(files) else []
    shared = files.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, places, digests, short = [], [], [], []
            for path, project, text in zip(*(batch.column(c).to_pylist() for c in ("file_path", "project", "content"))):
                labels.append(weak_label(path or "", project or "", text))
                places.append(path if project is None else None)
                digest, shingles = sketch(text)
                digests.append(digest)
                short.append(condensed(shingles, shared.value) if digest is not None else (None, None, None))
            n, rare, parity = zip(*short) if short else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("file_id"), batch.column("project"), pa.array(places, pa.string()), pa.array(labels, pa.string()), pa.array(digests, pa.int64()), pa.array(n, pa.int32()), pa.array(rare, pa.binary()), pa.array(parity, pa.binary()), *map(batch.column, where)],
                names=["file_id", "project", "place", "label", "digest", "n", "rare", "parity", *where],
            )

    rows = (with_position(files) if where else files).filter(F.col("content").isNotNull()).select("file_id", "project", "file_path", "content", *where)
    return rows.mapInArrow(run, "file_id long, project string, place string, label string, digest long, n int, rare binary, parity binary" + "".join(f", {c} long" for c in where))


def fit_on(files: DataFrame, seen: DataFrame, again: DataFrame, sample: int = SAMPLE, quota: int = QUOTA) -> tuple[Model, dict]:
    """Fits on a bounded sample of the files, drawn by a hash of file_id: ``sample`` rows, and of each kind ``quota`` if there are so many.

    ``seen``: ``seen_files`` of the files; ``again``: file_id of those that recur.
    """
    n = {r[0]: r[1] for r in seen.groupBy("label").count().collect()}  # one row per kind
    share = {label: min(1.0, max(sample / sum(n.values()), 0 if label == "hand" else quota / m)) for label, m in n.items()}
    drawn = F.coalesce(*[F.when(F.col("label") == label, F.lit(int(x * 1_000_000))) for label, x in share.items()], F.lit(0))
    picked = seen.filter(F.pmod(F.xxhash64("file_id"), F.lit(1_000_000)) < drawn).groupBy("file_id").agg(F.min("label").alias("label")).limit(2 * (sample + quota * len(KINDS)))
    picked = picked.join(again.withColumn("recurs", F.lit(True)), "file_id", "left").select("file_id", "label", F.coalesce("recurs", F.lit(False)).alias("recurs"))
    rows = files.filter(F.col("content").isNotNull()).join(F.broadcast(picked), "file_id").select("file_id", F.coalesce("file_path", F.lit("")).alias("path"), F.coalesce("project", F.lit("")).alias("project"), "content", "label", "recurs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = []
            for path, project, text in zip(*(batch.column(c).to_pylist() for c in ("path", "project", "content"))):
                idx, val = features(path, project, text)
                grams = idx < DIM
                packed.append(np.r_[np.array([grams.sum()], np.uint32).view(np.uint16), idx[grams].astype(np.uint16), val[grams].astype(np.float16).view(np.uint16), (idx[~grams] - DIM).astype(np.uint16)].tobytes())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("file_id", "project", "label", "recurs")), pa.array(packed, pa.binary())], names=["file_id", "project", "label", "recurs", "packed"])

    def unpacked(p: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Four bytes an n-gram and two a path token, as they travelled."""
        a = np.frombuffer(p, np.uint16)
        n, a = int(a[:2].view(np.uint32)[0]), a[2:]
        idx = np.r_[a[:n].astype(np.int32), a[2 * n :].astype(np.int32) + DIM]
        return idx, np.r_[a[n : 2 * n].view(np.float16).astype(np.float32), np.ones(len(idx) - n, np.float32)]

    got = [(r[0], r[1], r[2], r[3], *unpacked(r[4])) for r in rows.mapInArrow(run, "file_id long, project string, label string, recurs boolean, packed binary").collect()]  # the bounded sample
    got.sort(key=lambda r: (r[0] is None, r[0], r[1], len(r[4]), r[4].tobytes()))
    sampled = [r[1:] for r in got]
    del got
    return train(sampled)


def classified(files: DataFrame, sample: int = SAMPLE, quota: int = QUOTA) -> DataFrame:
    """A row for each file with content: file_id, project, kind ("hand" or one of KINDS), margin above the threshold, recurs."""
    from silverloom.session import staged

    seen = staged(seen_files(files, shingle_counts(files)), "files-seen")
    again = staged(copies(seen, files), "files-again")
    model, _ = fit_on(files, seen, again, sample, quota)
    shared = files.sparkSession.sparkContext.broadcast(model)
    fit = np.isfinite(model.thresholds)
    recurrence = np.where(fit, model.weights[RECURS], 0.0)
    unfit = {kind for kind, f in zip(KINDS, fit) if not f}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            margins, told = [], []
            for path, project, text in zip(*(batch.column(c).to_pylist() for c in ("file_path", "project", "content"))):
                if not text:
                    margins.append(None)
                    told.append([])
                    continue
                s = np.where(fit, m.margins(path or "", project or "", text), 0.0)
                margins.append(s.tolist())
                asked = unfit | {kind for kind, x, r, low, t in zip(KINDS, s, recurrence, m.lows, m.thresholds) if x + max(r, 0.0) > low and x + min(r, 0.0) <= t and np.isfinite(t)}
                told.append(_told(path or "", project or "", text, asked) if asked else [])
            yield pa.RecordBatch.from_arrays([batch.column("file_id"), batch.column("project"), pa.array(margins, pa.list_(pa.float64())), pa.array(told, pa.list_(pa.string()))], names=["file_id", "project", "margins", "told"])

    rows = files.filter(F.col("content").isNotNull()).select("file_id", "project", "file_path", "content")
    scored = rows.mapInArrow(run, "file_id long, project string, margins array<double>, told array<string>")
    scored = scored.join(again.withColumn("recurs", F.lit(True)), "file_id", "left").withColumn("recurs", F.coalesce("recurs", F.lit(False)))
    options = []
    for k, kind in enumerate(KINDS):
        named = F.array_contains("told", kind)
        if fit[k]:
            above = F.col("margins")[k] + F.when(F.col("recurs"), float(recurrence[k])).otherwise(0.0) - float(model.thresholds[k])
            holds = (above > 0) | named & (above > float(model.lows[k] - model.thresholds[k]))
        else:
            above = F.when(F.col("margins").isNotNull(), 0.0)
            holds = (named | F.col("recurs")) if kind == "third_party" else named
        options.append(F.when(holds & above.isNotNull(), F.struct(above.alias("margin"), F.lit(-k).alias("order"), F.lit(kind).alias("kind"))))
    best = F.array_max(F.array_compact(F.array(*options)))
    return scored.withColumn("best", best).select("file_id", "project", F.coalesce("best.kind", F.lit("hand")).alias("kind"), F.col("best.margin").alias("margin"), "recurs")
