"""Syntax checkers for the supported languages. Each takes a text and tells whether it is valid source, without building a tree.

The parsers are recursive Python functions, whose frames lie on the heap. While one runs, the interpreter's recursion limit is raised to
``FRAMES`` (some hundred MB, 200,000 nested brackets and more); a text nested deeper than that gets None, neither valid nor invalid.
"""

import sys
from collections.abc import Iterator
from contextlib import contextmanager

from silverloom.llm.grammars.ecma import all_ecma, valid_ecma
from silverloom.llm.grammars.go import valid_go
from silverloom.llm.grammars.python3 import valid_python

__all__ = ["LANGUAGES", "parsed_as", "room", "valid_ecma", "valid_go", "valid_python"]

FRAMES = 1_000_000
#: JSX is part of the languages "jsx" and "tsx" only.
LANGUAGES = ("python", "go", "javascript", "jsx", "typescript", "tsx")


@contextmanager
def room() -> Iterator[None]:
    """Room for deeply nested texts."""
    before = sys.getrecursionlimit()
    sys.setrecursionlimit(max(before, FRAMES))
    try:
        yield
    finally:
        sys.setrecursionlimit(before)


def parsed_as(text: str) -> dict[str, bool | None]:
    """Whether a text is valid in each of the languages; None where it is nested too deeply to tell."""
    with room():
        return {"python": valid_python(text), "go": valid_go(text), **all_ecma(text)}
