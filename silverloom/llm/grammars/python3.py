"""Python 3, by the running interpreter's own parser."""

from __future__ import annotations

import warnings

#: A statement that parses but is refused right after parsing, so that nothing is compiled and no tree of Python objects is built.
_STOP = "nonlocal _\n"
_STOPPED = ("nonlocal declaration not allowed at module level", "from __future__ imports must occur at the beginning of the file", "future feature ")


def valid_python(text: str) -> bool | None:
    """Whether ``text`` parses as a Python 3 module (the grammar only: names, scopes and control flow are not judged); None if the parser's own stack does not suffice to tell."""
    if "\x00" in text:
        return False
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        try:
            compile(_STOP + text.removeprefix("\ufeff"), "<text>", "exec", dont_inherit=True)
        except SyntaxError as e:
            return str(e.msg).startswith(_STOPPED)
        except RecursionError:  # raised by the stages after the parser, which has accepted the text by then
            return True
        except MemoryError:
            return None
        except (ValueError, OverflowError):
            return False
    return True
