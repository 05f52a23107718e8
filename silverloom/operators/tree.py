"""Project trees: paths below the project's component, all directories, and the drawing."""

from __future__ import annotations

import os

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MAX_LINES = 300


def tree_paths(files: DataFrame) -> DataFrame:
    """(machine_id, project, path, is_dir) of every node below a project's root; a file outside of it counts by its name."""
    parts = F.filter(F.split("file_path", "/"), lambda p: p != "")
    at = F.array_position(parts, F.col("project"))
    below = F.when(at > 0, F.slice(parts, at.cast("int") + 1, F.size(parts))).otherwise(F.slice(parts, F.size(parts), F.lit(1)))
    rows = files.filter("project IS NOT NULL").select("machine_id", "project", below.alias("p")).filter(F.size("p") > 0)
    nodes = rows.select("machine_id", "project", F.explode(F.transform(F.sequence(F.lit(1), F.size("p")), lambda n: F.struct(F.array_join(F.slice("p", F.lit(1), n), "/").alias("path"), (n < F.size("p")).alias("is_dir")))).alias("n"))
    return nodes.groupBy("machine_id", "project", "n.path").agg(F.max("n.is_dir").alias("is_dir"))


def _draw(pdf: pd.DataFrame) -> str:
    """The first lines of a project: nodes in drawing order, with whether each is the last of its folder."""
    lines: list[str] = []
    last: dict[str, bool] = {}
    for path, is_dir, is_last in pdf.sort_values("key")[["path", "is_dir", "is_last"]].itertuples(index=False):
        parts = path.split("/")
        above = ["/".join(parts[:n]) for n in range(1, len(parts))]
        lines.append("".join("    " if last[a] else "│   " for a in above) + ("└── " if is_last else "├── ") + parts[-1] + ("/" if is_dir else ""))
        last[path] = is_last
    return "\n".join([*lines[:MAX_LINES], "[truncated]"] if len(lines) > MAX_LINES else lines)


def render_trees(paths: DataFrame) -> DataFrame:
    """(machine_id, project, tree): the drawing of each project, at most 300 lines.

    A node's sort key puts the tree into drawing order (files before folders, then by name), so that only the first 301 nodes of
    a project reach the task that draws it, however large the project is.
    """
    parts = F.split("path", "/")
    above = F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda p: F.concat(F.lit("1"), p, F.lit("\u0001")))
    key = F.concat(F.array_join(above, ""), F.when(F.col("is_dir"), "1").otherwise("0"), F.element_at(parts, -1), F.when(F.col("is_dir"), "\u0001").otherwise(""))
    nodes = paths.select("machine_id", "project", "path", "is_dir", key.alias("key"), F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "/").alias("parent"))
    rank = F.row_number().over(Window.partitionBy("machine_id", "project").orderBy("key"))
    first = nodes.withColumn("r", rank).filter(F.col("r") <= MAX_LINES + 1)
    ends = nodes.groupBy("machine_id", "project", "parent").agg(F.max("key").alias("end"))
    drawn = first.join(ends, ["machine_id", "project", "parent"]).withColumn("is_last", F.col("key") == F.col("end"))

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        head = pdf.iloc[0]
        return pd.DataFrame({"machine_id": [head["machine_id"]], "project": [head["project"]], "tree": [f"{head['project']}/\n{_draw(pdf)}"]})

    return drawn.groupBy("machine_id", "project").applyInPandas(draw, "machine_id string, project string, tree string")


def project_tree(asked: DataFrame, trees: DataFrame) -> DataFrame:
    """(machine_id, project, tree) of asked projects: the stored drawing, at most ``MAX_LINES`` lines of it, or a note that there is none."""
    lines = F.split("tree", "\n")
    cut = F.when(F.size(lines) > MAX_LINES, F.concat(F.array_join(F.slice(lines, 1, MAX_LINES), "\n"), F.lit("\n[truncated]"))).otherwise(F.col("tree"))
    note = F.concat(F.lit("[project not found: "), F.coalesce("project", F.lit("")), F.lit("]"))
    return asked.join(trees, ["machine_id", "project"], "left").select("machine_id", "project", F.coalesce(cut, note).alias("tree"))


#: Folders that a walk leaves out.
NOT_WALKED = frozenset(".git node_modules __pycache__ .venv venv .idea .vscode target dist build".split())


def walked_tree(root: str, max_depth: int = 4, max_entries: int = 200) -> str:
    """The drawing of a local folder, for a project that is not stored: so many levels and entries, then a note that it was cut."""
    lines, entries, stack = [os.path.basename(root.rstrip("/")) + "/"], 0, [(root, "", 0, None)]
    while stack:
        folder, indent, depth, names = stack.pop()
        if names is None:
            if depth >= max_depth:
                return "\n".join([*lines, indent + "└── ...", "[truncated]"])
            try:
                names = sorted(set(os.listdir(folder)) - NOT_WALKED, reverse=True)
            except PermissionError:
                lines.append(f"{indent}{os.path.basename(folder)}/ [permission denied]")
                continue
        if not names:
            continue
        if entries >= max_entries or len(lines) >= MAX_LINES:
            return "\n".join([*lines, "[truncated]"])
        name, entries = names.pop(), entries + 1
        inside = os.path.join(folder, name)
        lines.append(indent + ("├── " if names else "└── ") + name + "/" * os.path.isdir(inside))
        stack.append((folder, indent, depth, names))
        if os.path.isdir(inside):
            stack.append((inside, indent + ("│   " if names else "    "), depth + 1, None))
    return "\n".join(lines)
