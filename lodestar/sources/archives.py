"""Zipped files of places as a Spark source and sink: `spark.read.format("place_archive").load(path)` after `register(spark)`.

The path is an archive (.zip, .kmz) or a folder of them. The driver reads the archives'
directories, and each member that `members` (a pattern) matches is a task's; a member
is unpacked as a stream and never held whole. Rows are archive, member, at (the place's
number in the member, from 0), form, record and error.

A .kml member gives one row for each Placemark: its record has lon, lat, name,
description and style, texts without spaces around them, of its first coordinates; a
Placemark whose coordinates are missing or no numbers has no row. Any other member
gives one row for each line that isn't blank, in Latin-1, as record["line"].

What can't be read is reported, not dropped: an archive without a directory, one
without a matching member, and a member that breaks off are a row with an error each;
what came before the break stays.
"""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree
from xml.sax.saxutils import escape

from pyarrow import ArrowInvalid
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition
from pyspark.sql.types import StructType

from lodestar.sources.files import FolderWriter, listed, located

SCHEMA = "archive string, member string, at bigint, form string, record map<string,string>, error string"
#: The members that hold places.
MEMBERS = r"(?i)(\.kml|ATOTALES_CCI\.ASC)$"
#: What a broken archive or member raises; a file system's errors are not among them, so Spark runs such a task again.
BROKEN = (zipfile.BadZipFile, zlib.error, EOFError, ElementTree.ParseError, NotImplementedError, RuntimeError, UnicodeError, ArrowInvalid)


def _text(mark: ElementTree.Element | None, default: str = "") -> str:
    return default if mark is None else (mark.text or default).strip()


def _place(mark: ElementTree.Element) -> dict | None:
    """The record of a Placemark whose tags have no namespace."""
    coordinates = next(mark.iter("coordinates"), None)
    parts = _text(coordinates).split(",")
    try:
        lon, lat = float(parts[0]), float(parts[1])
    except (ValueError, IndexError):
        return None
    return {"lon": repr(lon), "lat": repr(lat), "name": _text(mark.find("name")), "description": _text(mark.find("description")), "style": _text(mark.find("styleUrl"))}


def placemarks(data) -> Iterator[dict | None]:
    """Placemarks of a stream of KML in their order, None where one has no place; a read one is forgotten."""
    above: list[ElementTree.Element] = []
    for event, mark in ElementTree.iterparse(data, ("start", "end")):
        if event == "start":
            mark.tag = mark.tag.rsplit("}", 1)[-1]
            above.append(mark)
            continue
        above.pop()
        if mark.tag == "Placemark":
            yield _place(mark)
        if not any(a.tag == "Placemark" for a in above) and above:
            above[-1].remove(mark)


def lines(data) -> Iterator[dict | None]:
    for line in io.TextIOWrapper(data, "latin-1"):
        if line.strip():
            yield {"line": line.rstrip("\r\n")}


@dataclass
class Member(InputPartition):
    archive: str
    name: str | None
    error: str | None = None


class ArchiveReader(DataSourceReader):
    def __init__(self, path: str, members: str):
        self.path, self.members = path, members

    def partitions(self) -> list[Member]:
        out, (system, _) = [], located(self.path)
        for archive in listed(self.path, (".zip", ".kmz")):
            try:
                with system.open_input_file(archive) as data, zipfile.ZipFile(data) as z:
                    names = [n for n in z.namelist() if re.search(self.members, n)]
                out += [Member(archive, n) for n in names] or [Member(archive, None, "no member of places")]
            except BROKEN as wrong:
                out.append(Member(archive, None, f"not an archive: {wrong}"))
        return out or [Member("", None)]

    def read(self, partition: Member) -> Iterator[tuple]:
        archive, member = partition.archive, partition.name
        short = archive.rsplit("/", 1)[-1]
        if partition.error:
            yield short, None, None, None, None, partition.error
        if not member:
            return
        form = "kml" if member.lower().endswith(".kml") else "line"
        system, _ = located(self.path)
        at = 0
        try:
            with system.open_input_file(archive) as data, zipfile.ZipFile(data) as z, z.open(member) as content:
                for record in placemarks(content) if form == "kml" else lines(content):
                    if record is not None:
                        yield short, member, at, form, record, None
                    at += 1
        except BROKEN as wrong:
            yield short, member, at, form, None, f"{type(wrong).__name__}: {wrong}"


def _put_kml(rows: Iterator, out) -> None:
    """Rows with lon, lat, name, description and style as the one member of an archive."""
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z, z.open("doc.kml", "w", force_zip64=True) as member:
        member.write(b'<?xml version="1.0" encoding="UTF-8"?>\n<kml xmlns="http://www.opengis.net/kml/2.2"><Document>\n')
        for r in rows:
            text = lambda n: escape(r[n] or "")  # noqa: B023, E731
            member.write(f"<Placemark><name>{text('name')}</name><description>{text('description')}</description><styleUrl>{text('style')}</styleUrl>"
                         f"<Point><coordinates>{r['lon']!r},{r['lat']!r},0</coordinates></Point></Placemark>\n".encode())
        member.write(b"</Document></kml>\n")


def _put_lines(rows: Iterator, out) -> None:
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z, z.open("ATOTALES_CCI.ASC", "w", force_zip64=True) as member:
        for r in rows:
            member.write(f"{r['line']}\r\n".encode("latin-1"))


class PlaceArchive(DataSource):
    @classmethod
    def name(cls) -> str:
        return "place_archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> ArchiveReader:
        return ArchiveReader(self.options["path"], self.options.get("members", MEMBERS))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        """Rows with a column `line` become zipped lines, others a KMZ; one archive for each task."""
        if "line" in schema.fieldNames():
            return FolderWriter(self.options["path"], ".zip", _put_lines, overwrite)
        return FolderWriter(self.options["path"], ".kmz", _put_kml, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PlaceArchive)
