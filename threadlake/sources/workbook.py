"""Rows of a spreadsheet file: a small reader for use inside tasks, a file at a time."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
CELL = re.compile(r"([A-Z]{1,3})([1-9][0-9]{0,6})$")
ROWS, COLUMNS = 1_048_576, 16_384


class WorkbookError(ValueError):
    """The file is no plain spreadsheet."""


def _checked(raw: bytes) -> zipfile.ZipFile:
    """The package, if its entries are safe and hold no macros or embedded programs."""
    try:
        package = zipfile.ZipFile(io.BytesIO(raw))
    except zipfile.BadZipFile as e:
        raise WorkbookError("not a zip package") from e
    names = [n.replace("\\", "/") for n in package.namelist()]
    if len({n.lower() for n in names}) != len(names):
        raise WorkbookError("an entry occurs twice")
    for n in names:
        if n.startswith("/") or ":" in n or ".." in n.split("/"):
            raise WorkbookError(f"unsafe entry {n}")
        if re.search(r"(?i)vbaproject|activex|/embeddings/|\.bin$", n):
            raise WorkbookError(f"active content {n}")
    return package


def _text(node) -> str:
    return "".join(t.text or "" for t in node.iter(f"{MAIN}t"))


def _column(letters: str) -> int:
    n = 0
    for c in letters:
        n = n * 26 + ord(c) - 64
    return n


def _value(cell, shared: list[str]) -> str:
    kind, v = cell.get("t", "n"), cell.find(f"{MAIN}v")
    text = v.text or "" if v is not None else ""
    if kind == "s":
        if not text.isdigit() or int(text) >= len(shared):
            raise WorkbookError("shared string out of range")
        return shared[int(text)]
    if kind == "inlineStr":
        inline = cell.find(f"{MAIN}is")
        return _text(inline) if inline is not None else ""
    return {"1": "TRUE", "0": "FALSE"}.get(text, text) if kind == "b" else text


def rows_of(raw: bytes) -> Iterator[tuple[str, int, dict[str, str]]]:
    """(sheet, row number, cells by column letters) of every row with a value."""
    package = _checked(raw)
    names = set(package.namelist())
    if "xl/workbook.xml" not in names:
        raise WorkbookError("no workbook")
    targets = {}
    if "xl/_rels/workbook.xml.rels" in names:
        for r in ElementTree.fromstring(package.read("xl/_rels/workbook.xml.rels")):
            targets[r.get("Id")] = r.get("Target", "")
    shared = [_text(si) for si in ElementTree.fromstring(package.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
    for sheet in ElementTree.fromstring(package.read("xl/workbook.xml")).iter(f"{MAIN}sheet"):
        target = targets.get(sheet.get(RELATION), "")
        part = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
        if part not in names:
            raise WorkbookError(f"sheet {sheet.get('name')} has no part")
        last = 0
        with package.open(part) as stream:
            for _, row in ElementTree.iterparse(stream):
                if row.tag != f"{MAIN}row":
                    continue
                number = int(row.get("r", last + 1))
                if not last < number <= ROWS:
                    raise WorkbookError("rows out of order")
                last, cells = number, {}
                for cell in row.iter(f"{MAIN}c"):
                    m = CELL.match(cell.get("r", ""))
                    if not m or int(m[2]) != number or _column(m[1]) > COLUMNS or m[1] in cells:
                        raise WorkbookError(f"bad cell reference {cell.get('r')}")
                    cells[m[1]] = _value(cell, shared)
                if any(v.strip() for v in cells.values()):
                    yield sheet.get("name", ""), number, cells
                row.clear()
