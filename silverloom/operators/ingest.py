"""Folding batches of file events into keyed tables: routing, coalescing, hash short-circuit, upserts and deletes."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from silverloom.functions.text import nfc
from silverloom.operators.changefeed import whole_seconds
from silverloom.sources.positions import FILE, ROW, read_rows, row_vectors, with_position


def clean_events(events: DataFrame) -> DataFrame:
    """One row per event_id (the first delivery), type in upper case, paths in NFC, moment in whole seconds."""
    first = events.groupBy("event_id").agg(F.min_by(F.struct(*[c for c in events.columns if c != "event_id"]), "delivery_id").alias("e")).select("event_id", "e.*")
    return first.withColumns(
        {"event_type": F.upper(F.trim("event_type")), "path": nfc(F.col("path")), "old_path": nfc(F.col("old_path")), "sec": whole_seconds(F.col("timestamp_seconds"))}
    )


def last_contents(scan: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` of the last CREATE or MODIFY with content of each (machine, path), with path in NFC and sec; ``scan`` is a plain Parquet scan of file events.

    The winners are found by narrow rows; their contents are then read by position, so that none is shuffled.
    """
    narrow = clean_events(with_position(scan).select("event_id", "delivery_id", "event_type", "path", "old_path", "machine_id", "timestamp_seconds", F.col("content").isNotNull().alias("full"), FILE, ROW))
    last = narrow.filter(F.col("event_type").isin("CREATE", "MODIFY") & F.col("full")).groupBy("machine_id", "path").agg(F.max(F.struct("sec", "event_id", FILE, ROW)).alias("m"))
    wide = read_rows(row_vectors(scan, last.select(f"m.{FILE}", f"m.{ROW}")), scan.select(*columns, "timestamp_seconds").schema)
    return wide.withColumns({"path": nfc(F.col("path")), "sec": whole_seconds(F.col("timestamp_seconds"))}).select(*columns, "sec")


def delete_fanout(events: DataFrame) -> DataFrame:
    """(machine_id, path, sec, event_id) of everything a DELETE or RENAME removes: the path and, if another, the old path."""
    paths = F.array_distinct(F.array_compact(F.array("path", "old_path")))
    return events.filter(F.col("event_type").isin("DELETE", "RENAME")).select("machine_id", F.explode(paths).alias("path"), "sec", "event_id")


def fold_types(events: DataFrame) -> DataFrame:
    """One pending type per path: the last one, but a MODIFY after anything else is a CREATE."""
    last = F.max_by("event_type", F.struct("sec", "event_id"))
    other = F.bool_or(F.col("event_type") != "MODIFY")
    return events.groupBy("machine_id", "path").agg(F.when(last != "MODIFY", last).when(other, "CREATE").otherwise("MODIFY").alias("folded_type"), F.max(F.struct("sec", "event_id"))["event_id"].alias("last_event_id"))


def deletes_first(files: DataFrame, events: DataFrame) -> DataFrame:
    """A content table after one batch: all deletes, then all upserts, whatever their order (machine_id, path, content_hash)."""
    gone = delete_fanout(events).select("machine_id", F.col("path").alias("file_path")).distinct()
    put = (
        events.filter(F.col("event_type").isin("CREATE", "MODIFY") & F.col("content").isNotNull())
        .groupBy("machine_id", F.col("path").alias("file_path"))
        .agg(F.max_by("content_hash", F.struct("sec", "event_id")).alias("content_hash"))
    )
    kept = files.select("machine_id", nfc(F.col("file_path")).alias("file_path"), "content_hash").join(gone, ["machine_id", "file_path"], "left_anti")
    return upsert(kept, put, ["machine_id", "file_path"], ["content_hash"])


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep_if_null: list[str]) -> DataFrame:
    """Keyed upsert: new rows replace old ones, but a null in one of ``keep_if_null`` keeps the old value."""
    n, o = new.alias("n"), old.alias("o")
    on = None
    for k in keys:
        c = F.col(f"n.{k}").eqNullSafe(F.col(f"o.{k}"))
        on = c if on is None else on & c
    hit = F.col("n.__sl_new").isNotNull()
    joined = new.withColumn("__sl_new", F.lit(1)).alias("n").join(o, on, "full_outer")
    out = []
    for c in old.columns:
        fresh = F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")) if c in keep_if_null else F.col(f"n.{c}")
        out.append(F.when(hit, fresh).otherwise(F.col(f"o.{c}")).alias(c))
    return joined.select(*out)


def newest(files: DataFrame) -> DataFrame:
    """One row per (machine_id, file_path): the newest by (updated_at, file_id); its hash, or the newest known one if it has none."""
    order = F.struct("updated_at", "file_id")
    cols = [c for c in files.columns if c not in ("machine_id", "file_path", "content_hash")]
    return (
        files.withColumn("file_path", nfc(F.col("file_path")))
        .groupBy("machine_id", "file_path")
        .agg(F.max_by(F.struct(*cols), order).alias("f"), F.max_by("content_hash", F.when(F.col("content_hash").isNotNull(), order)).alias("content_hash"))
        .select("machine_id", "file_path", "f.*", "content_hash")
    )


def hash_short_circuit(events: DataFrame, stored: DataFrame) -> DataFrame:
    """(event_id, unchanged): whether an upsert's hash equals the stored one of its file, both known."""
    s = stored.select("machine_id", F.col("file_path").alias("path"), F.col("content_hash").alias("__sl_old"))
    up = events.filter(F.col("event_type").isin("CREATE", "MODIFY") & F.col("content").isNotNull())
    return up.join(s, ["machine_id", "path"], "left").select("event_id", F.coalesce(F.col("content_hash") == F.col("__sl_old"), F.lit(False)).alias("unchanged"))


def batches(events: DataFrame, size: int = 50) -> DataFrame:
    """(project, event_id, batch_no): events of a project in order, ``size`` to a batch. Numbered in parallel: counts per stretch of time, then within."""
    stretch = F.col("sec").cast("long") - F.col("sec").cast("long") % 86_400
    rows = events.select("project", "event_id", "sec", stretch.alias("day"))
    earlier = Window.partitionBy("project").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    days = rows.groupBy("project", "day").agg(F.count(F.lit(1)).alias("n")).withColumn("offset", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy("project", "day").orderBy("sec", "event_id")) - 1
    d = days.select(F.col("project").alias("p2"), F.col("day").alias("d2"), "offset")
    return rows.withColumn("i", inside).join(d, F.col("project").eqNullSafe(F.col("p2")) & F.col("day").eqNullSafe(F.col("d2"))).select("project", "event_id", F.floor((F.col("offset") + F.col("i")) / size).cast("long").alias("batch_no"))


def unchanged_run(events: DataFrame) -> DataFrame:
    """Events whose hash equals that of the event before for the same file: the batch form of the stateful skip."""
    before = F.lag("content_hash").over(Window.partitionBy("machine_id", "path").orderBy("sec", "event_id"))
    up = events.filter(F.col("event_type").isin("CREATE", "MODIFY") & F.col("content_hash").isNotNull())
    return up.withColumn("b", before).filter(F.col("content_hash") == F.col("b")).select("event_id")


#: Names and endings of paths that are never watched.
IGNORED = "node_modules vendor .git .svn .hg .idea .vscode .vs venv .venv env .env __pycache__ .pytest_cache .mypy_cache build dist out target bin obj .next .nuxt .svelte-kit coverage .coverage htmlcov".split()
IGNORED_ENDINGS = (".log", ".tmp", ".swp", ".swo", ".DS_Store")


def ignored(path: Column) -> Column:
    """Whether a path (relative to its root) is never watched."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    return F.arrays_overlap(parts, F.array(*map(F.lit, IGNORED))) | F.coalesce(F.try_element_at(parts, F.lit(-1)).rlike("(" + "|".join(e.replace(".", "\\.") for e in IGNORED_ENDINGS) + ")$"), F.lit(False))


def ignore_rules(lines: list[str]) -> list[tuple[str, bool]]:
    """The rules of an ignore file as (pattern of paths relative to its folder, whether it ignores them), in order; the last that matches counts."""
    rules = []
    for line in lines:
        line = re.sub(r"(?<!\\)\s+$", "", line.rstrip("\r\n"))
        if not line or line.startswith("#"):
            continue
        ignores, line = not line.startswith("!"), line.removeprefix("!")
        line = line[1:] if line[:2] in ("\\#", "\\!") else line
        folder, body = line.endswith("/"), line.strip("/")
        if not body:
            continue
        out = "^" if "/" in line.rstrip("/") else "^(?:.*/)?"
        for part in re.findall(r"\*\*/|/\*\*$|\*\*|\*|\?|\[!?[^\]]+\]|\\.|.", body):
            if part == "**/":
                out += "(?:.*/)?"
            elif part == "/**":
                out += "/.*"
            elif part in ("*", "**"):
                out += "[^/]*" if part == "*" else ".*"
            elif part == "?":
                out += "[^/]"
            elif part[0] == "[" and len(part) > 1:
                out += part.replace("[!", "[^")
            else:
                out += re.escape(part[-1])
        rules.append((out + ("/.*$" if folder else "(?:/.*)?$"), ignores))
    return rules


def ignored_by(path: Column, lines: list[str] = (), docker_lines: list[str] = (), globs: list[str] = ()) -> Column:
    """Whether a relative path is ignored: by the names that are never watched, by .gitignore or .dockerignore lines, or by globs for its last component."""
    out = ignored(path)
    for rules in (ignore_rules(list(lines)), ignore_rules(list(docker_lines))):
        verdict = F.lit(False)
        for pattern, ignores in rules:
            verdict = F.when(path.rlike(pattern), ignores).otherwise(verdict)
        out = out | verdict
    for glob in globs:
        out = out | F.element_at(F.split(path, "/"), -1).rlike("^" + "".join("[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c) for c in glob) + "$")
    return out


def with_fallback(events: DataFrame, machine_id: Column, project: Column) -> DataFrame:
    """Events without a machine or project of their own get those of their batch."""
    own = lambda c: F.nullif(F.col(c), F.lit(""))
    return events.withColumns({"machine_id": F.coalesce(own("machine_id"), machine_id), "project": F.coalesce(own("project"), project)})


def longest_prefix(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """(path, project): the project of the longest root that contains the path, else the name of the parent folder.

    Paths are exploded into their ancestors and joined by equality, never by comparing all pairs.
    """
    parts = F.split("path", "/")
    ancestors = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(F.array_join(F.slice(parts, F.lit(1), n), "/").alias("root"), n.alias("depth")))
    distinct = paths.select("path").filter("path IS NOT NULL").distinct()
    hits = distinct.select("path", F.explode(ancestors).alias("a")).select("path", "a.*").join(roots.select("root", "project"), "root")
    best = hits.groupBy("path").agg(F.max_by("project", "depth").alias("project"))
    parent = F.when(F.size(parts) > 1, F.element_at(parts, -2)).otherwise("")
    return distinct.join(best, "path", "left").select("path", F.coalesce("project", parent).alias("project"))
