"""Workbooks as plain OOXML, with the standard library alone.

Rows are written as they come, so a sheet never stands in memory; one that is longer than
the format allows goes on in further sheets.
"""

from __future__ import annotations

import io
import re
import shutil
import zipfile
from collections.abc import Iterable, Iterator, Sequence
from itertools import chain, islice
from pathlib import Path
from xml.sax.saxutils import XMLGenerator, quoteattr, unescape

# Fixed values of the format.
MOST_ROWS = 1_048_576
_NS = "http://schemas.openxmlformats.org"
_MAIN, _OFFICE = f"{_NS}/spreadsheetml/2006/main", f"{_NS}/officeDocument/2006/relationships"
_PACKAGE, _SHEET = f"{_NS}/package/2006", "application/vnd.openxmlformats-officedocument.spreadsheetml"


class _Xml:
    """Elements written straight to a binary stream."""

    def __init__(self, out):
        self.text = io.TextIOWrapper(out, "utf-8", write_through=True)
        self.sax = XMLGenerator(self.text, "utf-8", short_empty_elements=True)
        self.sax.startDocument()

    def open(self, tag: str, **attributes) -> None:
        self.sax.startElement(tag, {k.replace("__", ":"): str(v) for k, v in attributes.items()})

    def close(self, tag: str) -> None:
        self.sax.endElement(tag)

    def leaf(self, tag: str, text: str | None = None, **attributes) -> None:
        self.open(tag, **attributes)
        if text is not None:
            self.sax.characters(text)
        self.close(tag)

    def end(self) -> None:
        self.text.detach()


def column_name(index: int) -> str:
    """The letters of column ``index``, counted from 0: base 26 with digits A to Z and no zero."""
    return (column_name(index // 26 - 1) if index > 25 else "") + "ABCDEFGHIJKLMNOPQRSTUVWXYZ"[index % 26]


def _cell(xml: _Xml, place: str, value) -> None:
    if value is None:
        return xml.leaf("c", r=place)
    kind = {bool: "b", int: "n", float: "n"}.get(type(value), "inlineStr")
    xml.open("c", r=place, t=kind)
    if kind == "inlineStr":
        xml.open("is")
        xml.leaf("t", str(value), xml__space="preserve")
        xml.close("is")
    else:
        xml.leaf("v", str(int(value) if kind == "b" else value))
    xml.close("c")


def _sheet(out, rows: Iterable[Sequence]) -> None:
    xml = _Xml(out)
    xml.open("worksheet", xmlns=_MAIN)
    xml.open("sheetData")
    for number, row in enumerate(rows, 1):
        xml.open("row", r=number)
        for i, value in enumerate(row):
            _cell(xml, f"{column_name(i)}{number}", value)
        xml.close("row")
    xml.close("sheetData")
    xml.close("worksheet")
    xml.end()


def _links(out, links: list[tuple[str, str]]) -> None:
    xml = _Xml(out)
    xml.open("Relationships", xmlns=f"{_PACKAGE}/relationships")
    for i, (kind, target) in enumerate(links, 1):
        xml.leaf("Relationship", Id=f"rId{i}", Type=f"{_OFFICE}/{kind}", Target=target)
    xml.close("Relationships")
    xml.end()


def _parts(rows: Iterable[Sequence], most: int) -> Iterator[Iterable[Sequence]]:
    """The rows in runs of at most ``most``, each with the first row, the headings, on top; one run at least."""
    rows = iter(rows)
    head = list(islice(rows, 1))
    yield chain(head, islice(rows, most - 1))
    while first := list(islice(rows, 1)):
        yield chain(head, first, islice(rows, most - 2))


def write(path: str | Path, sheets: dict[str, Iterable[Sequence]], most_rows: int = MOST_ROWS) -> Path:
    """The workbook with one sheet per entry, of which the first row holds the headings, or several where one is too short."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    names: list[str] = []
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, rows in sheets.items():
            for i, part in enumerate(_parts(rows, most_rows), 1):
                names.append(name if i == 1 else f"{name} {i}")
                with z.open(f"xl/worksheets/sheet{len(names)}.xml", "w", force_zip64=True) as out:
                    _sheet(out, part)
        with z.open("xl/workbook.xml", "w") as out:
            xml = _Xml(out)
            xml.open("workbook", xmlns=_MAIN, xmlns__r=_OFFICE)
            xml.open("sheets")
            for i, name in enumerate(names, 1):
                xml.leaf("sheet", name=name, sheetId=i, r__id=f"rId{i}")
            xml.close("sheets")
            xml.close("workbook")
            xml.end()
        with z.open("xl/_rels/workbook.xml.rels", "w") as out:
            _links(out, [("worksheet", f"worksheets/sheet{i}.xml") for i in range(1, len(names) + 1)])
        with z.open("_rels/.rels", "w") as out:
            _links(out, [("officeDocument", "xl/workbook.xml")])
        with z.open("[Content_Types].xml", "w") as out:
            xml = _Xml(out)
            xml.open("Types", xmlns=f"{_PACKAGE}/content-types")
            xml.leaf("Default", Extension="rels", ContentType="application/vnd.openxmlformats-package.relationships+xml")
            for target, kind in [("workbook", "sheet.main"), *[(f"worksheets/sheet{i}", "worksheet") for i in range(1, len(names) + 1)]]:
                xml.leaf("Override", PartName=f"/xl/{target}.xml", ContentType=f"{_SHEET}.{kind}+xml")
            xml.close("Types")
            xml.end()
    return path


_TAG_SHEET, _TAG_LINK = re.compile(r"<sheet\b[^>]*?/>"), re.compile(r"<Relationship\b[^>]*?/>")


def _attribute(tag: str, name: str) -> str:
    found = re.search(rf'\b{name}\s*=\s*("[^"]*"|\'[^\']*\')', tag)
    return unescape(found.group(1)[1:-1], {"&quot;": '"', "&apos;": "'"}) if found else ""


def update(path: str | Path, sheets: dict[str, Iterable[Sequence]], most_rows: int = MOST_ROWS) -> Path:
    """Puts the sheets into a workbook: new ones are added, those of the same name replaced, all else stays byte for byte.

    Of the package only the list of sheets, its links and the list of types are edited. A
    workbook that does not exist is written. Sheets go on in further ones as in ``write``.
    """
    path = Path(path)
    if not path.exists():
        return write(path, sheets, most_rows)
    part = path.with_suffix(".part")
    with zipfile.ZipFile(path) as old, zipfile.ZipFile(part, "w", zipfile.ZIP_DEFLATED) as z:
        read = lambda name: old.read(name).decode("utf-8")
        book, links, types = read("xl/workbook.xml"), read("xl/_rels/workbook.xml.rels"), read("[Content_Types].xml")
        targets = {_attribute(t, "Id"): _attribute(t, "Target") for t in _TAG_LINK.findall(links)}
        gone = set()
        ours = re.compile("|".join(f"{re.escape(n)}( [0-9]+)?" for n in sheets)) if sheets else re.compile(r"(?!)")
        for tag in _TAG_SHEET.findall(book):
            if ours.fullmatch(_attribute(tag, "name")):
                link = _attribute(tag, "id")
                target = targets.get(link, "")
                member = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
                gone |= {member, f"xl/worksheets/_rels/{member.rsplit('/', 1)[-1]}.rels"}
                book = book.replace(tag, "")
                links = "".join("" if t.startswith("<Relationship") and _attribute(t, "Id") == link else t for t in re.split(r"(<Relationship\b[^>]*?/>)", links))
                types = "".join("" if t.startswith("<Override") and _attribute(t, "PartName") == f"/{member}" else t for t in re.split(r"(<Override\b[^>]*?/>)", types))
        edited = {"xl/workbook.xml", "xl/_rels/workbook.xml.rels", "[Content_Types].xml"}
        kept = [m for m in old.infolist() if m.filename not in gone | edited]
        for m in kept:
            with old.open(m) as source, z.open(m.filename, "w", force_zip64=True) as out:
                shutil.copyfileobj(source, out)
        taken, ids = {m.filename for m in kept}, [int(x) for x in re.findall(r'sheetId="(\d+)"', book)]
        used, tags = set(re.findall(r'\bId="([^"]*)"', links)), {"book": "", "links": "", "types": ""}
        number = 0
        for name, rows in sheets.items():
            for i, piece in enumerate(_parts(rows, most_rows), 1):
                number += 1
                while f"xl/worksheets/sheet{number}.xml" in taken or f"rIdS{number}" in used:
                    number += 1
                ids.append(max(ids, default=0) + 1)
                title = name if i == 1 else f"{name} {i}"
                tags["book"] += f'<sheet xmlns:r="{_OFFICE}" name={quoteattr(title)} sheetId="{ids[-1]}" r:id="rIdS{number}"/>'
                tags["links"] += f'<Relationship Id="rIdS{number}" Type="{_OFFICE}/worksheet" Target="worksheets/sheet{number}.xml"/>'
                tags["types"] += f'<Override PartName="/xl/worksheets/sheet{number}.xml" ContentType="{_SHEET}.worksheet+xml"/>'
                with z.open(f"xl/worksheets/sheet{number}.xml", "w", force_zip64=True) as out:
                    _sheet(out, piece)
        z.writestr("xl/workbook.xml", book.replace("</sheets>", tags["book"] + "</sheets>"))
        z.writestr("xl/_rels/workbook.xml.rels", links.replace("</Relationships>", tags["links"] + "</Relationships>"))
        z.writestr("[Content_Types].xml", types.replace("</Types>", tags["types"] + "</Types>"))
    return part.replace(path)
