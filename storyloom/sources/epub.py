"""EPUB files to lines with the boundaries of their table of contents."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import unquote
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame

from storyloom.sources.html import text_blocks

# Fixed values.
CONTAINER = "META-INF/container.xml"
TEXT_TYPES = {"application/xhtml+xml", "text/html", "application/xml"}
NCX_TYPE = "application/x-dtbncx+xml"
FALLBACK_LEVEL = 3


def local(name: str) -> str:
    return re.split(r"[}:]", name)[-1].lower()


def squeezed(text: str) -> str:
    return re.sub(r"\s+", " ", text).strip()


def resolve(base: str, href: str) -> tuple[str, str | None]:
    """(path in the archive, fragment) of a link in the file base."""
    path, _, fragment = href.partition("#")
    path = unquote(path)
    whole = posixpath.normpath(posixpath.join(posixpath.dirname(base), path)) if path else base
    return whole.lstrip("/").removeprefix("../"), unquote(fragment) or None


class Archive:
    """Entries of a ZIP file, found regardless of case."""

    def __init__(self, content: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(content))
        self.names = {n.lower(): n for n in self.zip.namelist()}

    def text(self, path: str) -> str | None:
        name = self.names.get(path.lower())
        return None if name is None else self.zip.read(name).decode("utf-8-sig", "replace")


def parsed(xml: str) -> ElementTree.Element:
    """An element tree; entities of HTML that XML does not know are blanked."""
    xml = re.sub(r"<!DOCTYPE[^>\[]*(\[[^\]]*\])?[^>]*>", "", xml)
    return ElementTree.fromstring(re.sub(r"&(?!(?:amp|lt|gt|quot|apos|#\d+|#x[0-9a-fA-F]+);)", "&amp;", xml))


@dataclass
class Package:
    title: str | None = None
    author: str | None = None
    manifest: dict[str, tuple[str, str, list[str]]] = field(default_factory=dict)
    spine: list[str] = field(default_factory=list)
    ncx: str | None = None

    @property
    def nav(self) -> str | None:
        return next((i for i, (_, _, p) in self.manifest.items() if "nav" in p), None)


def package(xml: str, path: str) -> Package:
    out = Package()
    for el in parsed(xml).iter():
        kind, told = local(el.tag), {local(k): v for k, v in el.attrib.items()}
        if kind == "item" and "id" in told and "href" in told:
            out.manifest[told["id"]] = (resolve(path, told["href"])[0], told.get("media-type", "").strip().lower(), told.get("properties", "").split())
        elif kind == "spine":
            out.ncx = told.get("toc")
        elif kind == "itemref" and "idref" in told and told.get("linear") != "no":
            out.spine.append(told["idref"])
        elif kind in ("metadata", "dc-metadata"):
            for child in el:
                own = squeezed("".join(child.itertext()))
                if own and local(child.tag) == "title" and out.title is None:
                    out.title = own
                elif own and local(child.tag) == "creator" and out.author is None:
                    out.author = own
    return out


Target = tuple[str, str | None]
Entry = tuple[str, Target, bool]


def outline(top: ElementTree.Element | None, entry: str, told) -> list[tuple[int, str, Target | None]]:
    """(depth, label, target) of the elements called entry below top, in document order; told(element) gives the last two."""
    rows, waiting = [], [] if top is None else [(top, 0)]
    while waiting:
        el, depth = waiting.pop()
        if local(el.tag) == entry:
            rows.append((depth, *told(el)))
            depth += 1
        waiting += [(c, depth) for c in reversed(el)]
    return rows


def linked(rows: list[tuple[int, str, Target | None]]) -> list[Entry]:
    """Rows that have a label and a place, each with whether such rows lie below it; one without a link of its own has
    the place of the first of those. Read from the end: what matters is the next such row, and the least depth up to it."""
    out, ahead, least = [], None, 0
    for depth, label, target in reversed(rows):
        inside = ahead is not None and least > depth
        place = target or (ahead if inside else None)
        least = min(least, depth)
        if label and place:
            out.append((label, place, inside))
            ahead, least = place, depth
    return out[::-1]


def first_of(el: ElementTree.Element | None, *names: str) -> ElementTree.Element | None:
    """The first element of one of these names, in document order."""
    return None if el is None else next((x for x in el.iter() if local(x.tag) in names), None)


def nav_entries(html: str, path: str) -> list[Entry]:
    """Entries of the navigation document's list called toc, or of its first list."""

    def told(item):
        head = next((c for c in item if local(c.tag) != "ol"), ElementTree.Element("none"))
        link = first_of(head, "a")
        href = None if link is None else link.get("href")
        return squeezed("".join(head.itertext())), None if href is None else resolve(path, href)

    is_toc = lambda n: any(local(k) == "type" and "toc" in re.findall(r"\w+", v.lower()) for k, v in n.attrib.items())
    lists = sorted((n for n in parsed(html).iter() if local(n.tag) == "nav"), key=lambda n: not is_toc(n))
    return linked(outline(first_of(lists[0], "ol") if lists else None, "li", told))


def ncx_entries(xml: str, path: str) -> list[Entry]:
    """Entries of the older format's map."""

    def told(point):
        own = {local(c.tag): c for c in reversed(point)}
        label, content = own.get("navlabel"), own.get("content")
        src = None if content is None else content.get("src")
        return "" if label is None else squeezed("".join(label.itertext())), None if src is None else resolve(path, src)

    return linked(outline(first_of(parsed(xml), "navmap"), "navpoint", told))


def contents(archive: Archive, pkg: Package) -> list[Entry]:
    """The navigation document's entries, else the NCX's."""
    nav = pkg.manifest.get(pkg.nav or "")
    ncx = pkg.manifest.get(pkg.ncx or "") or next((x for x in pkg.manifest.values() if x[1] == NCX_TYPE), None)
    for item, read in ((nav, nav_entries), (ncx, ncx_entries)):
        text = archive.text(item[0]) if item else None
        if text is not None and (found := read(text, item[0])):
            return found
    return []


def book_lines(content: bytes) -> tuple[Package, list[tuple[str, list[tuple[str, bool]]]], list[str]]:
    """(package, lines with the boundaries that open at them, warnings)."""
    archive = Archive(content)
    container = archive.text(CONTAINER)
    if container is None:
        raise ValueError("no EPUB: META-INF/container.xml is missing")
    at = next(el.attrib["full-path"] for el in parsed(container).iter() if local(el.tag) == "rootfile")
    pkg = package(archive.text(at) or "", at)
    entries, warnings, lines = contents(archive, pkg), [], []
    spine = [pkg.manifest[i] for i in pkg.spine if i in pkg.manifest and i != pkg.nav]
    spine = [x for x in spine if x[1] in TEXT_TYPES or (not x[1] and re.search(r"\.(x?html?|xml)$", x[0], re.I))]
    there = {x[0] for x in spine}
    warnings += [f"outside the reading order: {label}" for label, (path, _), _ in entries if path not in there and path != (pkg.manifest.get(pkg.nav or "") or ("",))[0]]
    for path, _, _ in spine:
        html = archive.text(path)
        if html is None:
            warnings.append(f"missing: {path}")
            continue
        blocks = text_blocks(html)
        opens: dict[int, list[tuple[str, bool]]] = {}
        if entries:
            own = [(label, fragment, kids) for label, (p, fragment), kids in entries if p == path]
            places = [0 if f is None else next((i for i, b in enumerate(blocks) if f in b[1]), -1) for _, f, _ in own]
            for (label, _, kids), place in zip(own, places, strict=True):
                if not blocks or (place < 0 and max(places) >= 0):
                    warnings.append(f"no place for: {label}")
                    continue
                if place < 0:
                    warnings.append(f"put at the start: {label}")
                opens.setdefault(max(place, 0), []).append((label, kids))
        else:
            opens = {i: [(text, False)] for i, (text, _, level) in enumerate(blocks) if level and level <= FALLBACK_LEVEL}
        lines += [(text, opens.get(i, [])) for i, (text, _, _) in enumerate(blocks)]
    if not entries:
        warnings.append("no table of contents: headings stand in for it")
    return pkg, lines, warnings


LINES = "path string, line_no int, text string, indented boolean, boundaries array<struct<label:string,has_children:boolean>>, book_title string, author string"


def _lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for path, content in zip(b["path"], b["content"], strict=True):
            pkg, found, _ = book_lines(bytes(content))
            yield pd.DataFrame(
                {
                    "path": path,
                    "line_no": range(len(found)),
                    "text": [t for t, _ in found],
                    "indented": False,
                    "boundaries": [[{"label": x, "has_children": k} for x, k in opens] for _, opens in found],
                    "book_title": pkg.title,
                    "author": pkg.author,
                }
            )


def lines(files: DataFrame) -> DataFrame:
    """Lines of the EPUB files among (path, content, is_zip), with the boundaries of their tables of contents."""
    return files.where("is_zip").select("path", "content").mapInPandas(_lines, LINES)
