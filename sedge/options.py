"""How frames show themselves."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass
class Options:
    """`interactive`: whether showing a frame runs it; `preview_rows`: how many of its rows are shown."""

    interactive: bool = True
    preview_rows: int = 10


options = Options()
