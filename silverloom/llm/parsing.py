"""Source files that do not parse.

Every file with a known extension is parsed in all supported languages, which are ranked by the words of the text. A file that is valid in the language of its
extension is valid; else the first language of the ranking that accepts it shows a wrong extension, and if none does it is
corrupt. Rates are given per project and language.

Defined cases: null content or path, or an unknown extension: no row; an empty content is valid in every language but Go, which needs a
package clause; texts are parsed whole; a text nested too deeply for the parser of its language is "undecided" and no failure; equal texts that
follow each other in a task are parsed once; further columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from silverloom.llm.grammars import parsed_as

#: The language of each extension.
LANGUAGE = {"py": "python", "go": "go", "js": "javascript", "mjs": "javascript", "jsx": "jsx", "ts": "typescript", "tsx": "tsx"}
#: Words and signs that speak for a language.
SIGNS = {
    "python": "def elif self None True False lambda except import from pass with raise".split(),
    "go": "func package := chan defer nil struct range fmt map go interface".split(),
    "javascript": "const let function => === async await export import new null this".split(),
    "typescript": "const let => interface type string number boolean as readonly export import Promise".split(),
}
_WORD = re.compile(r":=|=>|===|[A-Za-z_]+")
_JSX = re.compile(r"</[A-Za-z]|/>")


def ranked(text: str) -> list[str]:
    """All languages, the likeliest by the words of ``text`` first."""
    count = Counter(_WORD.findall(text))
    score = {lang: sum(count[w] for w in words) for lang, words in SIGNS.items()}
    score["jsx"], score["tsx"] = score["javascript"], score["typescript"]
    favour = ("jsx", "tsx") if _JSX.search(text) else ("javascript", "typescript")
    return sorted(score, key=lambda lang: (-score[lang], lang not in favour, lang))


def judge(text: str, language: str, accepted: dict[str, bool | None] | None = None) -> tuple[str, str | None]:
    """("valid", language), ("wrong extension", another language), ("corrupt", None) or ("undecided", None). ``accepted``: ``parsed_as(text)``."""
    accepted = parsed_as(text) if accepted is None else accepted
    if accepted[language]:
        return "valid", language
    if accepted[language] is None:
        return "undecided", None
    others = [x for x in accepted if accepted[x]] if text.strip() else []
    if others:
        return "wrong extension", min(others, key=ranked(text).index)
    return "corrupt", None


FAILED = ("wrong extension", "corrupt")
_SCHEMA = "delivery_id long, project string, language string, verdict string, parses_as string, accepted_by array<string>"


def parsed_files(events: DataFrame, key: str = "delivery_id") -> DataFrame:
    """A row (delivery_id, project, language, verdict, parses_as, accepted_by) for each row with content and a known extension; accepted_by: all languages that accept it."""
    ext = F.regexp_extract(F.lower("path"), r"\.([a-z]+)$", 1)
    todo = events.filter(F.col("content").isNotNull() & ext.isin(*LANGUAGE)).select(F.col(key).alias("delivery_id"), "project", ext.alias("ext"), "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, accepted = None, {}
        for batch in batches:
            languages = [LANGUAGE[x] for x in batch.column("ext").to_pylist()]
            verdicts, by = [], []
            for language, text in zip(languages, batch.column("content")):
                text = text.as_py()
                if text != last:
                    last, accepted = text, parsed_as(text)
                verdicts.append(judge(text, language, accepted))
                by.append([x for x in accepted if accepted[x]])
            yield pa.RecordBatch.from_arrays(
                [batch.column("delivery_id"), batch.column("project"), pa.array(languages, pa.string()), pa.array([v[0] for v in verdicts], pa.string()), pa.array([v[1] for v in verdicts], pa.string()), pa.array(by, pa.list_(pa.string()))],
                names=["delivery_id", "project", "language", "verdict", "parses_as", "accepted_by"],
            )

    return todo.mapInArrow(run, _SCHEMA)


def parse_rates(parsed: DataFrame) -> DataFrame:
    """Files and failures per project and language."""
    n = F.count(F.lit(1))
    return parsed.groupBy("project", "language").agg(
        n.alias("n_files"),
        F.count_if(F.col("verdict") == "wrong extension").alias("n_wrong_extension"),
        F.count_if(F.col("verdict") == "corrupt").alias("n_corrupt"),
        F.count_if(F.col("verdict") == "undecided").alias("n_undecided"),
        F.round(F.count_if(F.col("verdict").isin(*FAILED)) / n, 6).alias("failure_rate"),
    )
