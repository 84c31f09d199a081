"""Items as files, event streams as text, and the text of office documents."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.views import table

#: Media types of the formats an item can be exported in.
TYPES = {"md": "text/markdown", "txt": "text/plain", "csv": "text/csv", "html": "text/html"}


def export_item(title: Column, content: Column, kind: str) -> Column:
    """file name, media type and body of an item in a format."""
    if kind not in TYPES:
        raise ValueError(f"export format must be one of {sorted(TYPES)}")
    name = F.concat(F.substring(F.regexp_replace(title, r"[^A-Za-z0-9_.-]", "_"), 1, 80), F.lit(f".{kind}"))
    body = content
    if kind == "html":
        shown = T.escape_html(title)
        body = F.concat(F.lit("<!doctype html><html><meta charset=utf-8><title>"), shown, F.lit("</title><body><h1>"), shown, F.lit("</h1><pre>"), T.escape_html(content), F.lit("</pre></body></html>"))
    return F.struct(name.alias("name"), F.lit(f"{TYPES[kind]}; charset=utf-8").alias("type"), body.alias("body"))


def event_line(event: Column) -> Column:
    """A frame of an event stream: the event as JSON, and a blank line."""
    return F.concat(F.lit("data: "), F.to_json(event), F.lit("\n\n"))


@dataclass(frozen=True)
class Office:
    """Where a kind of office document keeps its text: the parts' names, and the elements that end a piece."""

    parts: str
    piece: str
    strings: str | None = None


#: Names of parts and elements in the open formats of words, slides and sheets.
OFFICE = {
    "docx": Office(r"word/document\.xml", "p"),
    "pptx": Office(r"ppt/slides/slide(\d+)\.xml", "p"),
    "xlsx": Office(r"xl/worksheets/sheet(\d+)\.xml", "c", r"xl/sharedStrings\.xml"),
}
#: Bytes and parts beyond which a document isn't unpacked.
UNPACKED, PARTS = 20_000_000, 2000
_CELL = pa.struct([("label", pa.string()), ("ref", pa.int32()), ("text", pa.string())])
_READ = pa.schema([("path", pa.string()), ("strings", pa.list_(pa.string())), ("parts", pa.list_(pa.struct([("part", pa.int64()), ("lines", pa.list_(pa.list_(_CELL)))]))), ("fault", pa.string())])
#: Bytes of files that a task reads before it tells what they hold.
READ_BYTES = 4_000_000


def office_pieces(raw: bytes, kind: str, unpacked: int = UNPACKED, parts: int = PARTS) -> Iterator[tuple]:
    """(part, line, place, label, ref, text) of a document, as its elements end; a ref stands for the text of a string in part -1."""
    layout = OFFICE[kind]
    with zipfile.ZipFile(io.BytesIO(raw)) as packed:
        held = packed.infolist()
        if len(held) > parts or sum(i.file_size for i in held) > unpacked:
            raise ValueError(f"more than {parts} parts or {unpacked} bytes")
        if not any(re.fullmatch(layout.parts, i.filename) for i in held):
            raise ValueError(f"no part with text of a {kind} document")
        for info in held:
            if layout.strings and re.fullmatch(layout.strings, info.filename):
                for i, text in enumerate(t for name, t, _, _ in _ended(packed, info, "si") if name == "si"):
                    yield -1, 0, i, None, None, text
            elif found := re.fullmatch(layout.parts, info.filename):
                number, line, place = int(found[1]) if found.groups() else 0, 0, 0
                for name, text, at, value in _ended(packed, info, layout.piece, "row"):
                    place += 1
                    if name == "row":
                        line += 1
                    elif kind != "xlsx":
                        line += 1
                        yield number, line, place, None, None, text
                    elif at.get("t") == "s":
                        yield number, line, place, at.get("r", ""), int(value), None
                    else:
                        yield number, line, place, at.get("r", ""), None, text if at.get("t") == "inlineStr" else value


def _ended(packed: zipfile.ZipFile, info: zipfile.ZipInfo, *names: str) -> Iterator[tuple[str, str, dict, str]]:
    """Name, text, attributes and value of the named elements in the order of their ends; what has been told is let go."""
    words, value = [], ""
    with packed.open(info) as part:
        for _, e in ElementTree.iterparse(part):
            name = e.tag.rpartition("}")[2]
            if name == "t":
                words.append(e.text or "")
            elif name in ("br", "cr", "tab"):
                words.append("\t" if name == "tab" else "\n")
            elif name == "v":
                value = e.text or ""
            elif name in names:
                yield name, "".join(words), dict(e.attrib), value
                words, value = [], ""
                e.clear()


def office_parts(raw: bytes, kind: str, unpacked: int = UNPACKED, parts: int = PARTS) -> tuple[list, list]:
    """Shared strings of a document, and its parts with text: (part, lines), a line being a list of (label, ref, text)."""
    strings, held, last = [], {}, None
    for part, line, _, label, ref, text in office_pieces(raw, kind, unpacked, parts):
        if part < 0:
            strings.append(text)
            continue
        lines = held.setdefault(part, [])
        if not lines or last != (part, line):
            lines.append([])
        last = part, line
        lines[-1].append((label, ref if ref is None or 0 <= ref < 1 << 31 else -1, text))
    return strings, sorted(held.items())


def doc_extract(files: DataFrame, unpacked: int = UNPACKED, parts: int = PARTS) -> DataFrame:
    """path, text and error of files (path, content): office documents, else UTF-8 text; one of the last two is null.

    Tasks read a document's shared strings and its parts, whose size is bounded, into one row; Spark looks up the strings and
    puts cells, lines and parts together there. A slide or sheet begins with a line of its name; the cells of a row stand
    as "A1: value" with tabs between them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0
            for path, raw in zip(batch["path"], batch["content"], strict=True):
                path, raw = path.as_py(), raw.as_py()
                kind = path.rpartition(".")[2].lower()
                try:
                    strings, held = office_parts(raw, kind, unpacked, parts) if kind in OFFICE else ([], [(0, [[(None, None, raw.decode("utf-8-sig"))]])])
                    rows.append((path, strings, held, None))
                except (ValueError, KeyError, zipfile.BadZipFile, ElementTree.ParseError) as fault:
                    rows.append((path, [], [], f"{type(fault).__name__}: {fault}"[:200]))
                size += len(raw)
                if size >= READ_BYTES:
                    yield told(rows)
                    rows, size = [], 0
            if rows:
                yield told(rows)

    def told(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _READ, strict=True)], schema=_READ)

    read = files.select("path", "content").mapInArrow(run, "path string, strings array<string>, parts array<struct<part: bigint, lines: array<array<struct<label: string, ref: int, text: string>>>>>, fault string")
    joined = lambda of, one, mark: F.array_join(F.transform(of, one), mark)
    cell = lambda c: F.when(c["label"].isNotNull(), F.concat(c["label"], F.lit(": "), F.coalesce(F.get("strings", c["ref"]), c["text"], F.lit("")))).otherwise(c["text"])
    kind = F.lower(F.substring_index("path", ".", -1))
    title = F.when(kind == "pptx", F.lit("slide ")).when(kind == "xlsx", F.lit("sheet "))
    named = lambda p: F.concat(F.coalesce(F.concat(title, p["part"].cast("string"), F.lit("\n")), F.lit("")), joined(p["lines"], lambda line: joined(line, cell, "\t"), "\n"))
    return read.select("path", F.when(F.col("fault").isNull(), joined("parts", named, "\n")).alias("text"), F.col("fault").alias("error"))


def _packed(rows: DataFrame) -> DataFrame:
    """path and content of rows (id, text) as office documents: even ids as paragraphs, odd ones as a sheet of one column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain = lambda t: t.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
        for batch in batches:
            paths, files = [], []
            for i, text in zip(batch[0].to_pylist(), batch[1].to_pylist(), strict=True):
                lines, held = [plain(t) for t in text.split("\n")], io.BytesIO()
                with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
                    if i % 2:
                        z.writestr("xl/sharedStrings.xml", "<sst>" + "".join(f"<si><t>{t}</t></si>" for t in lines) + "</sst>")
                        z.writestr("xl/worksheets/sheet1.xml", "<worksheet>" + "".join(f'<row><c r="A{k + 1}" t="s"><v>{k}</v></c></row>' for k in range(len(lines))) + "</worksheet>")
                    else:
                        z.writestr("word/document.xml", "<d>" + "".join(f"<p><r><t>{t}</t></r></p>" for t in lines) + "</d>")
                paths.append(f"{i}.{'xlsx' if i % 2 else 'docx'}")
                files.append(held.getvalue())
            yield pa.RecordBatch.from_arrays([pa.array(paths), pa.array(files, pa.binary())], ["path", "content"])

    return rows.mapInArrow(run, "path string, content binary")


def _extracted(s, d) -> DataFrame:
    """Digests of the text that documents give when they are read from office files made of them."""
    return doc_extract(_packed(table(s, d, "documents").select("doc_id", "text"))).select("path", F.sha2("text", 256).alias("digest"), "error")


def _exported(s, d) -> DataFrame:
    rows = None
    for kind in TYPES:
        own = table(s, d, "pages").select("page_id", F.lit(kind).alias("kind"), export_item(F.col("url"), F.col("html"), kind).alias("x"))
        rows = own if rows is None else rows.unionByName(own)
    return rows.select("page_id", "kind", "x.name", "x.type", F.sha2("x.body", 256).alias("digest"))


QUERIES = {
    "export_item": _exported,
    "doc_extract": _extracted,
    "sse_sink": lambda s, d: table(s, d, "events").select("event_id", event_line(F.struct(F.col("event_type").alias("type"), "user_id")).alias("frame")),
}
_E = lambda c: f"replace(replace(replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"
_HTML_BODY = f"concat('<!doctype html><html><meta charset=utf-8><title>', {_E('url')}, '</title><body><h1>', {_E('url')}, '</h1><pre>', {_E('html')}, '</pre></body></html>')"
ORACLES = {
    "export_item": " UNION ALL ".join(f"SELECT page_id, '{kind}' AS kind, concat(substr(regexp_replace(url, '[^A-Za-z0-9_.-]', '_', 'g'), 1, 80), '.{kind}') AS name, '{media}; charset=utf-8' AS type, sha256({_HTML_BODY if kind == 'html' else 'html'}) AS digest FROM pages" for kind, media in TYPES.items()),
    "doc_extract": """SELECT concat(doc_id, CASE WHEN doc_id % 2 = 0 THEN '.docx' ELSE '.xlsx' END) AS path, NULL::VARCHAR AS error, sha256(CASE WHEN doc_id % 2 = 0 THEN text
  ELSE concat('sheet 1', chr(10), array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: concat('A', i, ': ', x)), chr(10))) END) AS digest FROM documents""",
    "sse_sink": "SELECT event_id, concat('data: {\"type\":\"', event_type, '\",\"user_id\":', user_id, '}', chr(10), chr(10)) AS frame FROM events",
}
