"""Placemarks of KML documents and KMZ archives: rows of files in, rows of placemarks out."""

from __future__ import annotations

import io
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PLACEMARKS = "path string, seq int, id string, name string, description string, kind string, coordinates array<string>, properties map<string,string>, style string, folders array<string>, error string"
ENTRIES = "path string, entry string, bytes long, kind string"


def _tag(node) -> str:
    return node.tag.rsplit("}", 1)[-1]


def _child(node, name: str):
    return next((c for c in node if _tag(c) == name), None)


def _text(node, name: str) -> str | None:
    found = _child(node, name)
    return found.text.strip() if found is not None and found.text else None


def _geometry(node) -> tuple[str, list[str]] | None:
    """Kind and coordinate strings of the first geometry; of a collection its first child."""
    for c in node:
        kind = _tag(c)
        if kind in ("Point", "LineString", "LinearRing"):
            return kind, [_text(c, "coordinates") or ""]
        if kind == "Polygon":
            rings = [r for side in ("outerBoundaryIs", "innerBoundaryIs") for b in c if _tag(b) == side for r in b if _tag(r) == "LinearRing"]
            return kind, [_text(r, "coordinates") or "" for r in rings]
        if kind == "MultiGeometry":
            for wanted in ("Point", "LineString", "Polygon"):
                own = next((g for g in c if _tag(g) == wanted), None)
                if own is not None:
                    return _geometry([own])
    return None


def _placemarks(path: str, content: bytes) -> Iterator[tuple]:
    try:
        root = ET.fromstring(content)
    except ET.ParseError as error:
        yield path, -1, None, None, None, None, None, None, None, None, f"not well-formed: {error}"
        return
    seq = 0

    def walk(node, folders: list[str]) -> Iterator[tuple]:
        nonlocal seq
        for c in node:
            if _tag(c) == "Folder":
                yield from walk(c, [*folders, _text(c, "name") or ""])
            elif _tag(c) == "Document":
                yield from walk(c, folders)
            elif _tag(c) == "Placemark":
                geometry = _geometry(c)
                data = {d.get("name"): (_text(d, "value") if _tag(d) == "Data" else (d.text or "").strip()) or "" for d in c.iter() if _tag(d) in ("Data", "SimpleData") and d.get("name")}
                if geometry:
                    yield path, seq, c.get("id"), _text(c, "name"), _text(c, "description"), *geometry, data, _text(c, "styleUrl"), folders, None if all(geometry[1]) and geometry[1] else "no coordinates"
                seq += 1

    yield from walk(root if _tag(root) != "kml" else root, [])


def placemarks(files: DataFrame) -> DataFrame:
    """Placemarks of files (path, content); a document that cannot be read gives one row with its error."""

    def step(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in PLACEMARKS.split(", ")]
        for pdf in frames:
            yield pd.DataFrame([r for p, c in zip(pdf["path"], pdf["content"]) for r in _placemarks(p, bytes(c))], columns=names)

    return files.select("path", F.col("content").cast("binary").alias("content")).mapInPandas(step, PLACEMARKS)


STYLES = "path string, style string, line_color string, line_width double, fill_color string, filled boolean"
HEADS = "path string, name string, description string"


def _roots(pdf: pd.DataFrame) -> Iterator[tuple[str, ET.Element]]:
    """The roots of the documents that can be read."""
    for path, content in zip(pdf["path"], pdf["content"]):
        try:
            yield path, ET.fromstring(bytes(content))
        except ET.ParseError:
            pass


def styles(files: DataFrame) -> DataFrame:
    """Styles with an id of documents (path, content): line colour and width (1 if not given), fill colour and whether filled (yes if not given); nulls without such a part."""

    def step(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for path, root in _roots(pdf):
                for node in (n for n in root.iter() if _tag(n) == "Style" and n.get("id")):
                    line, poly = _child(node, "LineStyle"), _child(node, "PolyStyle")
                    rows.append((
                        path, node.get("id"), _text(line, "color") if line is not None else None, float(_text(line, "width") or 1.0) if line is not None else None,
                        _text(poly, "color") if poly is not None else None, (_text(poly, "fill") or "1") == "1" if poly is not None else None,
                    ))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in STYLES.split(", ")]).astype({"line_width": "float64", "filled": "object"})

    return files.select("path", F.col("content").cast("binary").alias("content")).mapInPandas(step, STYLES)


def heads(files: DataFrame) -> DataFrame:
    """Name and description of each document (path, content)."""

    def step(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            found = [(path, next((n for n in root.iter() if _tag(n) == "Document"), None)) for path, root in _roots(pdf)]
            yield pd.DataFrame([(path, _text(n, "name"), _text(n, "description")) for path, n in found if n is not None], columns=["path", "name", "description"])

    return files.select("path", F.col("content").cast("binary").alias("content")).mapInPandas(step, HEADS)


def _opened(content: bytes) -> zipfile.ZipFile | None:
    try:
        return zipfile.ZipFile(io.BytesIO(content))
    except zipfile.BadZipFile:
        return None


def archive_entries(files: DataFrame) -> DataFrame:
    """Entries of archives (path, content): name, size, and whether KML, image or other; a broken one gives kind corrupt."""

    def kind(name: str) -> str:
        end = name.lower().rsplit(".", 1)[-1]
        return "kml" if end == "kml" else "image" if end in ("png", "jpg", "jpeg", "gif", "bmp") else "other"

    def step(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for p, c in zip(pdf["path"], pdf["content"]):
                z = _opened(bytes(c))
                rows += [(p, i.filename, i.file_size, kind(i.filename)) for i in z.infolist()] if z else [(p, None, None, "corrupt")]
            yield pd.DataFrame(rows, columns=["path", "entry", "bytes", "kind"])

    return files.select("path", F.col("content").cast("binary").alias("content")).mapInPandas(step, ENTRIES)


def documents(archives: DataFrame) -> DataFrame:
    """path and content of the KML of each archive: a doc.kml anywhere, else the first one."""

    def step(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for p, c in zip(pdf["path"], pdf["content"]):
                z = _opened(bytes(c))
                names = [n for n in z.namelist() if n.lower().endswith(".kml")] if z else []
                if names:
                    rows.append((p, z.read(next((n for n in names if n.rsplit("/", 1)[-1].lower() == "doc.kml"), names[0]))))
            yield pd.DataFrame(rows, columns=["path", "content"])

    return archives.select("path", F.col("content").cast("binary").alias("content")).mapInPandas(step, "path string, content binary")


def archive_checks(files: DataFrame, warn: int = 100 << 20, most: int = 500 << 20) -> DataFrame:
    """Per archive its issues: size, corrupt, no KML or several, dangerous files."""
    size = files.select("path", F.octet_length("content").alias("size"))
    found = archive_entries(files).groupBy("path").agg(F.count_if(F.col("kind") == "kml").alias("kmls"), F.bool_or(F.col("kind") == "corrupt").alias("corrupt"), F.bool_or(F.lower("entry").rlike(r"\.(exe|bat|sh|dll|js)$")).alias("danger"))
    issues = F.array_compact(F.array(
        F.when(F.col("size") > most, "over the size limit").when(F.col("size") > warn, "large archive"), F.when(F.col("corrupt"), "corrupt archive"), F.when(~F.col("corrupt") & (F.col("kmls") == 0), "no KML"),
        F.when(F.col("kmls") > 1, "several KML files"), F.when(F.col("danger"), "dangerous file"),
    ))
    return size.join(found, "path").select("path", issues.alias("issues"))
