"""Modules of typed columns for editors and type checkers: python -m sedge.stubs orders.parquet -o tables.py"""

from __future__ import annotations

import argparse
import keyword
import re
import sys
from pathlib import Path

from . import dtypes as D
from .functions.expr import typed_col
from .sources.io import read


def _python_name(text: str) -> str:
    name = re.sub(r"\W", "_", text)
    return f"c_{name}" if not name or name[0].isdigit() or keyword.iskeyword(name) else name


def module_of(paths: list[str]) -> str:
    """Python source with, for each file, a class of its columns, a frame class that has them as `c`, and a function that reads it."""
    used: set[str] = set()
    body: list[str] = []
    for path in paths:
        schema = read(path).schema
        stem = _python_name(Path(path).name.split(".")[0])
        title = "".join(p.capitalize() for p in stem.split("_"))
        body += ["", "", f"class {title}Columns:"]
        for column, kind in schema.items():
            found = "Expr" if kind == D.Null else type(typed_col(column, kind)).__name__
            used.add(found)
            body.append(f"    {_python_name(column)}: {found}" + ("" if _python_name(column) == column else f'  # c["{column}"]'))
        body += ["", "", f"class {title}Frame(Frame):", f"    c: {title}Columns"]
        body += ["", "", f"def read_{stem}() -> {title}Frame:", f"    return cast({title}Frame, read({path!r}))"]
    head = ['"""Typed columns of files, made by sedge.stubs."""', "", "from __future__ import annotations", "", "from typing import cast", "", "from sedge import Frame, read"]
    return "\n".join([*head, f"from sedge.functions.expr import {', '.join(sorted(used))}" if used else "", *body, ""])


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="sedge.stubs", description=__doc__)
    parser.add_argument("files", nargs="+")
    parser.add_argument("-o", "--output", help="the module to write; else it is printed")
    found = parser.parse_args(args)
    text = module_of(found.files)
    if found.output:
        Path(found.output).write_text(text)
    else:
        sys.stdout.write(text)
    return 0


if __name__ == "__main__":
    sys.exit(main())
