"""Entities and relations of source files, by language.

Python is read by the interpreter's own parser. Go, JavaScript and TypeScript are scanned by line patterns at brace depth: declarations that do not begin
a line, and names built at run time, are not seen.
"""

from __future__ import annotations

import ast
import re
import warnings
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Language by extension.
LANGUAGE = {"go": "go", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "ts": "typescript", "tsx": "typescript", "py": "python"}
_GO = [
    (re.compile(r"^func\s+([A-Za-z_]\w*)\s*[\[(]", re.M), "function", None),
    (re.compile(r"^func\s+\(\s*(?:\w+\s+)?\*?([A-Za-z_]\w*)(?:\[[^\]]*\])?\s*\)\s*([A-Za-z_]\w*)\s*\(", re.M), "function", "."),
    (re.compile(r"^(?:type\s+|\t)([A-Za-z_]\w*)(?:\[[^\]\n]*\])?\s+(?:struct|interface)\s*\{", re.M), "type", None),
    (re.compile(r"^type\s+([A-Za-z_]\w*)\s+=?\s*(?!struct|interface)[\w\[*]", re.M), "type", None),
]
_JS = [
    (re.compile(r"^[ \t]*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*([A-Za-z_$][\w$]*)", re.M), "function", None),
    (re.compile(r"^[ \t]*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+([A-Za-z_$][\w$]*)", re.M), "class", None),
    (re.compile(r"^[ \t]+(?:(?:public|private|protected|static|async|get|set)\s+)*\*?(?!if\b|for\b|while\b|switch\b|catch\b|return\b|function\b|super\b|await\b)([A-Za-z_$][\w$]*)\s*\([^;{}]*\)\s*(?::[^{};=]+)?\{", re.M), "method", None),
]
_TS = [(re.compile(r"^[ \t]*(?:export\s+)?(?:default\s+)?(?:declare\s+)?interface\s+([A-Za-z_$][\w$]*)", re.M), "interface", None)]
_GO_IMPORT = re.compile(r"^import\s+(?:[\w.]+\s+)?\"([^\"]+)\"|^\t(?:[\w.]+\s+)?\"([^\"]+)\"$", re.M)
_GO_CALL = re.compile(r"(?<![\w.])([A-Za-z_]\w*(?:\.[A-Za-z_]\w*)*)\(")
_GO_WORDS = frozenset("func if for switch return go defer select range append len cap make new panic recover print println copy delete close map string int byte error".split())


def _python(text: str) -> list[tuple[str, str, int, int]]:
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            module = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    kinds = {ast.FunctionDef: "function", ast.AsyncFunctionDef: "function", ast.ClassDef: "class"}
    return sorted((n.lineno, n.name, kinds[type(n)], n.end_lineno) for n in ast.walk(module) if type(n) in kinds)


def entities_of(path: str, text: str) -> list[tuple[str, str, int, int]]:
    """(name, type, start_line, end_line) in the order of the text; none for unknown extensions."""
    language = LANGUAGE.get(path.rsplit(".", 1)[-1].lower())
    if language == "python":
        return [(name, kind, a, b) for a, name, kind, b in _python(text)]
    if language is None:
        return []
    found = []
    for pattern, kind, joint in _GO if language == "go" else _JS + (_TS if language == "typescript" else []):
        for m in pattern.finditer(text):
            name = joint.join(m.groups()) if joint else m[1]
            found.append((text.count("\n", 0, m.start() + len(m[0]) - len(m[0].lstrip())) + 1, name, kind, _end_line(text, m.end() - 1)))
    return [(name, kind, a, b) for a, name, kind, b in sorted(set(found))]


_BRACES = re.compile(r"[{}]|//[^\n]*|/\*.*?\*/|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`[^`]*`", re.S)


def _end_line(text: str, pos: int) -> int:
    """Line of the brace that closes the first one opened at or after ``pos``."""
    depth = 0
    for m in _BRACES.finditer(text, pos):
        if m[0] == "{":
            depth += 1
        elif m[0] == "}":
            depth -= 1
            if depth <= 0:
                return text.count("\n", 0, m.start()) + 1
    return text.count("\n") + 1


def relations_of(path: str, text: str) -> list[tuple[str, str | None, str, str, int]]:
    """(type, source, target, target_type, line): CONTAINS for every entity; for Go also IMPORTS and CALLS_SYNTAX."""
    ents = entities_of(path, text)
    out = [("CONTAINS", None, name, kind, a) for name, kind, a, _ in ents]
    if path.lower().endswith(".go"):
        out += [("IMPORTS", None, m[1] or m[2], "module", text.count("\n", 0, m.start()) + 1) for m in _GO_IMPORT.finditer(text)]
        lines = text.split("\n")
        for name, kind, a, b in ents:
            if kind == "function":
                for n in range(a, b):
                    for m in _GO_CALL.finditer(re.sub(r"//.*|\"(?:[^\"\\]|\\.)*\"", "", lines[n]) if n < len(lines) else ""):
                        if m[1] not in _GO_WORDS:
                            out.append(("CALLS_SYNTAX", name, m[1], "symbol", n + 1))
    return out


def extract(files: DataFrame, key: str, path: str = "file_path") -> DataFrame:
    """(key, relation fields) of every file with content."""
    kind = dict(files.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, *r) for k, p, text in zip(*(batch.column(c).to_pylist() for c in (key, path, "content"))) for r in relations_of(p or "", text)]
            cols = list(zip(*rows)) or [()] * 6
            types = [batch.schema.field(key).type, pa.string(), pa.string(), pa.string(), pa.string(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=[key, "type", "source", "target", "target_type", "line"])

    return files.filter(F.col("content").isNotNull()).select(key, path, "content").mapInArrow(run, f"{key} {kind}, type string, source string, target string, target_type string, line int")


def embed(text: str, dim: int = 64) -> list[float]:
    """A deterministic stand-in for a model: hashed identifier tokens, of length 1. Says nothing about meaning."""
    import zlib

    v = [0.0] * dim
    for w in re.findall(r"[a-z0-9]+", re.sub(r"(?<=[a-z])(?=[A-Z])|(?<=[a-zA-Z])(?=\d)|(?<=\d)(?=[a-zA-Z])", " ", text).lower()):
        h = zlib.crc32(w.encode())
        v[h % dim] += 1.0 if h & 0x10000 else -1.0
    norm = sum(x * x for x in v) ** 0.5
    return [x / norm for x in v] if norm else v


def embedded(rows: DataFrame, key: str, text: str, prefix: str = "search_document: ") -> DataFrame:
    """(key, embedding) under the stand-in embedder; ``prefix`` as some models ask for it."""
    kind = dict(rows.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = [embed(prefix + t) for t in batch.column("t").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(vectors, pa.list_(pa.float32()))], names=[key, "embedding"])

    return rows.filter(F.col(text).isNotNull() & (F.length(text) < 100_000)).select(key, F.col(text).alias("t")).mapInArrow(run, f"{key} {kind}, embedding array<float>")
