"""Embedders as objects: a name, prefixes for documents and queries, and how to encode a list of texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from silverloom.functions.extraction import embed

MAX_TEXTS = 32


@dataclass(frozen=True)
class Embedder:
    """``encode`` takes at most ``batch`` texts at a time, with their prefix; it must be importable on the executors."""

    name: str
    encode: Callable[[list[str]], list[list[float]]]
    document_prefix: str = "search_document: "
    query_prefix: str = "search_query: "
    batch: int = MAX_TEXTS

    def embedded(self, rows: DataFrame, key: str, text: str, mode: str = "document") -> DataFrame:
        """(key, embedding) of the rows with a text. ``mode``: "document" or "query"."""
        if mode not in ("document", "query"):
            raise ValueError(f"unknown mode {mode}")
        prefix = self.document_prefix if mode == "document" else self.query_prefix

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for given in batches:
                texts = [prefix + t for t in given.column("t").to_pylist()]
                vectors = [v for at in range(0, len(texts), self.batch) for v in self.encode(texts[at : at + self.batch])]
                yield pa.RecordBatch.from_arrays([given.column(key), pa.array(vectors, pa.list_(pa.float32()))], names=[key, "embedding"])

        return rows.filter(F.col(text).isNotNull()).select(key, F.col(text).alias("t")).mapInArrow(run, f"{key} {dict(rows.dtypes)[key]}, embedding array<float>")


def _hashed(texts: list[str]) -> list[list[float]]:
    return [embed(t) for t in texts]


#: The known embedders; "hash" is the stand-in that needs no model.
BACKENDS: dict[str, Embedder] = {"hash": Embedder("hash", _hashed)}


def get_embedder(name: str | None = None) -> Embedder:
    """The embedder of a name, in any case; without one, or for "auto" and unknown names, the stand-in."""
    return BACKENDS.get((name or "auto").lower(), BACKENDS["hash"])
