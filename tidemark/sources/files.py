"""Document files (text, Markdown, HTML, DOCX, ODT, PDF) as tables of sections."""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dom

#: Fixed values.
FORMATS = {"docx": "docx", "odt": "odt", "pdf": "pdf", "md": "md", "markdown": "md", "txt": "txt", "text": "txt", "html": "html", "htm": "html"}
MOST_BYTES, MOST_NESTING, TITLE_BYTES = 100 << 20, 256, 200


def format_of(name: Column | str) -> Column:
    """Format by the extension of a file name, null if unknown."""
    c = F.col(name) if isinstance(name, str) else name
    table = F.create_map(*(F.lit(x) for pair in FORMATS.items() for x in pair))
    return F.get(F.array(F.try_element_at(table, F.lower(F.regexp_extract(c, r"\.([^./]*)$", 1)))), F.lit(0))


def _spaced(s: str) -> str:
    return " ".join(s.split())


def _cut(s: str, most: int = TITLE_BYTES) -> str:
    return s.encode()[:most].decode(errors="ignore")


def _section(kind: str, text: str, title: str = "", level: int = 0, page: int | None = None) -> dict:
    return {"kind": kind, "title": title, "text": text, "level": level, "page": page}


def read_text(data: bytes) -> tuple[str, list[dict]]:
    text = _spaced(data.decode(errors="replace"))
    return _cut(text), [_section("paragraph", text)] if text else []


def read_markdown(data: bytes) -> tuple[str, list[dict]]:
    out, run, title = [], [], ""

    def flush() -> None:
        if run:
            out.append(_section("paragraph", " ".join(run)))
            run.clear()

    for line in data.decode(errors="replace").splitlines():
        line = line.strip()
        if line.startswith("#"):
            flush()
            head = line.lstrip("#")
            level = min(6, len(line) - len(head))
            out.append(_section("heading", head.strip(), head.strip(), level))
            title = title or head.strip()
        elif line:
            run.append(line)
        else:
            flush()
    flush()
    return title or (_cut(out[0]["text"].split("\n")[0]) if out else ""), out


def read_html(data: bytes) -> tuple[str, list[dict]]:
    doc = dom.parse(data.decode(errors="replace"))
    out: list[dict] = []

    def go(n: dom.Node) -> None:
        for c in n.children:
            if not c.tag or c.tag in dom.SKIPPED or c.tag in ("nav", "footer", "header", "head") or dom.is_hidden(c):
                continue
            kind = "heading" if re.fullmatch("h[1-6]", c.tag) else {"p": "paragraph", "table": "table", "ul": "list", "ol": "list"}.get(c.tag)
            if kind is None:
                go(c)
            elif text := dom.visible_text(c):
                out.append(_section(kind, text, text if kind == "heading" else "", int(c.tag[1]) if kind == "heading" else 0))

    go(doc)
    if not out and (text := dom.visible_text(doc)):
        out.append(_section("paragraph", text))
    return dom.first_title(doc) or next((s["text"] for s in out if s["kind"] == "heading"), ""), out


def _events(xml: bytes) -> Iterator[tuple[str, ET.Element]]:
    """Starts and ends up to the first fault; too deep a nesting is an error."""
    depth = 0
    try:
        for event, e in ET.iterparse(io.BytesIO(xml), events=("start", "end")):
            depth += 1 if event == "start" else -1
            if depth > MOST_NESTING:
                raise ValueError("nested too deeply")
            yield event, e
    except ET.ParseError:
        return


def _name(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2]


def _attr(e: ET.Element, name: str) -> str:
    return next((v for k, v in e.attrib.items() if k.rpartition("}")[2] == name), "")


def heading_level(style: str) -> int:
    s = style.lower()
    if s == "title":
        return 1
    if s == "subtitle":
        return 2
    m = re.match(r"(?:heading|titre|überschrift)\s*([1-6])", s)
    return int(m[1]) if m else 0


def read_docx(data: bytes) -> tuple[str, list[dict]]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        xml = z.read("word/document.xml")
    out, style = [], ""
    for event, e in _events(xml):
        if event == "start" and _name(e) == "p":
            style = ""
        elif event == "end" and _name(e) == "pStyle":
            style = _attr(e, "val")
        elif event == "end" and _name(e) == "p":
            text = _spaced("".join(x.text or "" for x in e.iter() if _name(x) == "t"))
            if text:
                level = heading_level(style)
                out.append(_section("heading" if level else "paragraph", text, text if level else "", level))
    return next((s["text"] for s in out if s["kind"] == "heading"), ""), out


def read_odt(data: bytes) -> tuple[str, list[dict]]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        xml = z.read("content.xml")
    out, in_list = [], False
    for event, e in _events(xml):
        kind = _name(e)
        if kind == "list":
            in_list = event == "start"  # the first list that closes ends it
        elif event == "end" and kind in ("h", "p"):
            text = _spaced("".join(e.itertext()))
            if text:
                level = int(_attr(e, "outline-level") or 1) if kind == "h" else 0
                out.append(_section("heading" if kind == "h" else "list" if in_list else "paragraph", text, text if level else "", level))
    return next((s["text"] for s in out if s["kind"] == "heading"), ""), out


_ESCAPES = {"n": "\n", "r": "\r", "t": "\t", "b": "\b", "f": "\f"}


def pdf_string(s: str) -> str:
    return re.sub(r"\\(?:([0-7]{1,3})|(.))", lambda m: chr(int(m[1], 8) & 255) if m[1] else _ESCAPES.get(m[2], m[2]), s, flags=re.S)


def pdf_content(stream: str) -> str:
    """Text of the show operators of a content stream, line by line; moves add a space, T* and ' a new line."""
    out = []
    for line in stream.splitlines():
        line = line.strip()
        strings = "".join(pdf_string(x) for x in re.findall(r"\(((?:\\.|[^()\\])*)\)", line, flags=re.S))
        if line.endswith(("Tj", "TJ")):
            out.append(strings)
        elif line.endswith("'"):
            out.append("\n" + strings)
        elif line.endswith(("Td", "TD")):
            out.append(" ")
        elif line.endswith("T*"):
            out.append("\n")
    lines = [_spaced("".join(c for c in x if c.isprintable() and not "" <= c <= "" and c != "�")) for x in "".join(out).split("\n")]
    return "\n".join(x for x in lines if x)


def read_pdf(data: bytes) -> tuple[str, list[dict]]:
    """A section for each content stream with text, in the order of the file: a plain reader of unencrypted files without object streams."""
    pages = []
    for m in re.finditer(rb"<<(.*?)>>\s*stream\r?\n(.*?)\r?\nendstream", data, flags=re.S):
        raw = m[2]
        if b"/FlateDecode" in m[1]:
            try:
                raw = zlib.decompress(raw)
            except zlib.error:
                continue
        if b"/Subtype" not in m[1] and (b"Tj" in raw or b"TJ" in raw):
            pages.append(pdf_content(raw.decode("latin-1")))
    out = [_section("page", t, page=i + 1) for i, t in enumerate(pages) if t]
    if not out:
        raise ValueError("no text in the document")
    return _cut(next(line for line in out[0]["text"].split("\n") if line.strip())), out


def pdf_has_images(data: bytes) -> bool:
    return re.search(rb"/Subtype\s*/Image", data) is not None


READERS = {"txt": read_text, "md": read_markdown, "html": read_html, "docx": read_docx, "odt": read_odt, "pdf": read_pdf}
_SECTION = pa.struct([("kind", pa.string()), ("title", pa.string()), ("text", pa.string()), ("level", pa.int32()), ("page", pa.int32())])
_DDL = "path string, format string, title string, sections array<struct<kind:string,title:string,text:string,level:int,page:int>>, raw_text string, has_images boolean, error string"


def _read(name: str, data: bytes) -> dict:
    kind = FORMATS.get(name.rpartition(".")[2].lower()) if "." in name.rpartition("/")[2] else None
    row = {"path": name, "format": kind, "title": None, "sections": None, "raw_text": None, "has_images": None, "error": None}
    try:
        if kind is None:
            raise ValueError("unknown format")
        if len(data) > MOST_BYTES:
            raise ValueError("document too large")
        title, sections = READERS[kind](data)
    except (ValueError, KeyError, zipfile.BadZipFile) as e:
        return row | {"error": str(e)}
    raw = "\n".join((s["title"] + "\n" if s["title"] else "") + s["text"] for s in sections)
    return row | {"title": title, "sections": sections, "raw_text": raw, "has_images": kind == "pdf" and pdf_has_images(data)}


def read_documents(files: DataFrame) -> DataFrame:
    """path, format, title, sections, raw_text, has_images, error of files (path, content), such as the binaryFile source gives."""
    schema = pa.schema([("path", pa.string()), ("format", pa.string()), ("title", pa.string()), ("sections", pa.list_(_SECTION)), ("raw_text", pa.string()), ("has_images", pa.bool_()), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                yield pa.RecordBatch.from_pylist([_read(path, content.as_py() or b"")], schema=schema)

    return files.select("path", "content").mapInArrow(run, _DDL)


def load_documents(spark: SparkSession, path: str) -> DataFrame:
    return read_documents(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path))


def pdf_quality(docs: DataFrame) -> DataFrame:
    """Metrics of extraction of the PDF rows of read_documents, and whether they need OCR or leave figures unread."""
    from ..functions import text

    pages = F.size("sections")
    q = docs.where("format = 'pdf' AND error IS NULL").select(
        "path", pages.alias("page_count"), (F.aggregate("sections", F.lit(0), lambda a, s: a + F.char_length(s["text"])) / F.greatest(pages, F.lit(1))).alias("chars_per_page"),
        text.printable_ratio("raw_text").alias("printable_ratio"), text.wordlike_ratio("raw_text").alias("wordlike_ratio"), "has_images", text.visual_references("raw_text").alias("visual_refs"),
    )
    return q.withColumn("needs_ocr", text.needs_ocr(F.col("chars_per_page"), F.col("has_images"), F.col("printable_ratio"))).withColumn("visual_gap", text.has_visual_gap(F.col("visual_refs"), F.col("has_images")))
