"""One list of cells, three forms: script, notebook, walkthrough. A cell is (is_code, text)."""

from __future__ import annotations

import json
from collections.abc import Sequence

Cells = list[tuple[bool, str]]


def script(cells: Cells) -> str:
    """The first prose cell is the docstring, later ones are comments without their heading marks."""
    out = []
    for i, (is_code, text) in enumerate(cells):
        lines = [x.lstrip("#").strip() if x.startswith("#") else x for x in text.splitlines()]
        if is_code:
            out.append(text)
        elif i == 0:
            out.append('"""' + "\n".join(lines) + '\n"""')
        else:
            out.append("\n".join(("# " + x).rstrip() for x in lines))
    return "\n\n".join(out) + "\n"


def walkthrough(cells: Cells, outputs: Sequence[str] = ()) -> str:
    """Prose and fenced code; ``outputs`` has what each code cell printed. A table or an image in it stays Markdown."""
    shown = iter(outputs)
    out = []
    for is_code, text in cells:
        out.append("\n".join(["```python", text, "```"]) if is_code else text)
        got = next(shown, "").strip() if is_code else ""
        if got:
            out.append(got if got[0] == "|" or got.startswith("![") else f"```\n{got}\n```")
    return "\n\n".join(out) + "\n"


def notebook(cells: Cells) -> str:
    """nbformat 4.5 JSON."""

    def cell(i: int, is_code: bool, text: str) -> dict:
        base = {"id": f"cell-{i}", "metadata": {}, "source": text.splitlines(keepends=True), "cell_type": "code" if is_code else "markdown"}
        return base | ({"outputs": [], "execution_count": None} if is_code else {})

    kernel = {"display_name": "Python 3", "name": "python3", "language": "python"}
    return json.dumps({"nbformat": 4, "nbformat_minor": 5, "metadata": {"kernelspec": kernel}, "cells": [cell(i, *c) for i, c in enumerate(cells)]}, indent=1) + "\n"
