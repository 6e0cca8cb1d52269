"""Errors raised on the line that makes the mistake, before Spark sees it."""

from __future__ import annotations

import difflib


class ColumnNotFoundError(KeyError):
    def __init__(self, name: str, known):
        near = difflib.get_close_matches(name, list(known), n=1)
        hint = f"; did you mean {near[0]!r}?" if near else ""
        self.message = f"no column {name!r}{hint} Columns: {', '.join(known)}"
        super().__init__(self.message)

    def __str__(self) -> str:
        return self.message


class ExprTypeError(TypeError):
    pass


class DuplicateColumnError(ValueError):
    pass


class GroupError(ValueError):
    pass


class BackendError(RuntimeError):
    pass
