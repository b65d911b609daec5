"""Raw files to documents: directory scan, readers by extension, failures apart.

A reader only takes a file apart into parts; which field is the title or the text, how they are put together and what
is metadata are column expressions over all parts.
"""

from __future__ import annotations

import csv
import io
import json
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.text import cleaned, document_id
from quillspark.schemas import DOCUMENT

# Names under which title and text are looked for, in this order.
CSV_TITLES = ("title", "question", "query", "topic", "q")
CSV_TEXTS = ("answer", "text", "content", "body", "description", "a")
JSON_TITLES = ("title", "question", "topic", "name", "header")
JSON_TEXTS = ("text", "content", "body", "answer", "description")


class UnreadableFile(ValueError):
    """A file that its reader can't read, or of a type without a reader."""


@dataclass
class Part:
    """What a reader takes out of a file: a whole ``text``, or the named ``fields`` of a record; ``extra`` is metadata.

    ``kind`` tells the rules for title and text: text, csv, json or item.
    """

    kind: str
    text: str | None = None
    title: str | None = None
    fields: dict[str, str] = field(default_factory=dict)
    shown: str | None = None
    extra: dict[str, str] = field(default_factory=dict)


Reader = Callable[[bytes], Iterator[Part]]


def read_txt(data: bytes) -> Iterator[Part]:
    """UTF-8, else Latin-1."""
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError:
        text = data.decode("latin-1")
    yield Part("text", text, extra={"byte_size": str(len(data))})


def read_csv(data: bytes) -> Iterator[Part]:
    """A record a row, in file order; broken bytes are replaced."""
    for row in csv.DictReader(io.StringIO(data.decode("utf-8", "replace"), newline="")):
        filled = {k: v for k, v in row.items() if k and v is not None}
        yield Part("csv", fields=filled, shown="\n".join(f"{k}: {v}" for k, v in filled.items() if v), extra={"byte_size": str(len(data))})


def _as_text(value: object) -> str:
    return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def read_json(data: bytes) -> Iterator[Part]:
    """A record for each object of a list, or for the one object; other values are texts themselves."""
    try:
        tree = json.loads(data.decode("utf-8"))
    except ValueError as e:
        raise UnreadableFile(f"malformed JSON: {e}") from e
    for item in tree if isinstance(tree, list) else [tree]:
        if isinstance(item, dict):
            yield Part("json", fields={k: _as_text(v) for k, v in item.items() if v is not None}, shown=json.dumps(item, indent=2, ensure_ascii=False))
        else:
            yield Part("item", str(item))


def _literal_strings(stream: bytes) -> str:
    """The strings shown by a content stream."""
    try:
        stream = zlib.decompress(stream)
    except zlib.error:
        pass
    shown = re.findall(rb"\(((?:\\.|[^\\()])*)\)\s*(?:Tj|'|\")", stream)
    return "\n".join(re.sub(rb"\\([()\\])", rb"\1", t).decode("latin-1") for t in shown)


def extract_pdf(data: bytes) -> tuple[str | None, list[str | None]]:
    """(title of the metadata, text of each page, None for one that fails): by pypdf, else the literal strings of each content stream."""
    try:
        from pypdf import PdfReader
    except ImportError:
        if not data.startswith(b"%PDF"):
            raise UnreadableFile("not a PDF") from None
        title = re.search(rb"/Title\s*\(((?:\\.|[^\\()])*)\)", data)
        return title[1].decode("latin-1") if title else None, [_literal_strings(m[1]) for m in re.finditer(rb"stream\r?\n(.*?)\r?\nendstream", data, re.S)]
    reader = PdfReader(io.BytesIO(data))
    if reader.is_encrypted:
        reader.decrypt("")
    pages: list[str | None] = []
    for page in reader.pages:
        try:
            pages.append(page.extract_text() or "")
        except Exception:
            pages.append(None)
    return getattr(reader.metadata, "title", None), pages


def read_pdf(data: bytes) -> Iterator[Part]:
    """All pages that have text; a page that fails is left out."""
    try:
        title, pages = extract_pdf(data)
    except UnreadableFile:
        raise
    except Exception as e:
        raise UnreadableFile(f"unreadable PDF: {e}") from e
    kept = [p for p in pages if p and p.strip()]
    yield Part("text", "\n\n".join(kept), title, extra={"page_count": str(len(pages)), "extracted_pages": str(len(kept)), "byte_size": str(len(data))})


#: Readers by lower-case extension; :func:`register_reader` adds to them.
READERS: dict[str, Reader] = {".txt": read_txt, ".csv": read_csv, ".json": read_json, ".pdf": read_pdf}


def register_reader(extension: str, reader: Reader) -> None:
    """A reader for one more extension."""
    READERS[extension.lower()] = reader


def scan_documents(spark: SparkSession, folder: str) -> DataFrame:
    """path, filename, extension, size_bytes, sha256, content of the regular files right in a folder, hidden ones left out, by name."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(folder)
    root = re.sub("^file:/+", "file:/", at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toString().rstrip("/"))
    files = spark.read.format("binaryFile").load(f"{folder}/*")
    name = F.element_at(F.split("path", "/"), -1)
    own = F.regexp_replace(F.regexp_replace("path", "^file:/+", "file:/"), "/[^/]*$", "") == root
    extension = F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1))
    return files.filter(own & ~name.startswith(".")).select("path", name.alias("filename"), extension.alias("extension"), F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"), "content").orderBy("filename")


_PART = "kind string, no int, text string, title string, fields map<string,string>, shown string, extra map<string,string>, reason string"


def _named(names: tuple[str, ...]) -> Column:
    """The record's own spelling of the first of ``names`` that it has, whatever case and blanks."""
    own = F.map_from_entries(F.transform(F.array_distinct(F.transform(F.map_keys("fields"), lambda k: F.lower(F.trim(k)))), lambda k: F.struct(k, F.element_at(F.filter(F.map_keys("fields"), lambda x: F.lower(F.trim(x)) == k), -1))))
    return F.coalesce(*(F.try_element_at(own, F.lit(n)) for n in names))


def _field(name: str) -> Column:
    """A record's value under the name that column ``name`` holds; '' where there is none."""
    return F.coalesce(F.try_element_at("fields", name), F.lit(""))


def load_files(files: DataFrame) -> DataFrame:
    """Documents and failures of scanned files; ``reason`` is null for documents.  A bad file never stops the others."""
    readers = dict(READERS)
    columns = [c.split(" ")[0] for c in re.sub("<[^>]*>", "", _PART).split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows: list[tuple] = []
            for path, name, extension, content in zip(batch["path"], batch["filename"], batch["extension"], batch["content"], strict=True):
                begun = len(rows)
                try:
                    if (reader := readers.get(extension)) is None:
                        raise UnreadableFile(f"unsupported file type: {extension or 'none'}")
                    rows += [(path, name, extension, p.kind, i, p.text, p.title, p.fields, p.shown, p.extra, None) for i, p in enumerate(reader(bytes(content)))]
                except Exception as e:
                    rows[begun:] = [(path, name, extension, *[None] * (len(columns) - 1), f"{type(e).__name__}: {e}")]
            yield pd.DataFrame(rows, columns=["path", "filename", "extension", *columns])

    parts = files.select("path", "filename", "extension", "content").mapInPandas(run, f"path string, filename string, extension string, {_PART}")
    return _composed(parts)


def _composed(parts: DataFrame) -> DataFrame:
    """Title, text and metadata of the parts of files, by the rules of their kind."""

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        return texts.map(cleaned)

    # Kept where it stands, so that a text is cleaned once: neither pushed into filters nor repeated by collapsed projections.
    clean = clean.asNondeterministic()
    kind, stem, number = F.col("kind"), F.regexp_replace("filename", r"(?<=.)\.[^.]*$", ""), F.col("no") + 1
    is_csv, is_json, is_record = kind == "csv", kind == "json", kind.isin("csv", "json")
    rows = parts.withColumn("title_at", F.when(is_csv, _named(CSV_TITLES)).when(is_json, _named(JSON_TITLES))).withColumn("text_at", F.when(is_csv, _named(CSV_TEXTS)).when(is_json, _named(JSON_TEXTS)))
    rows = rows.withColumn("body", _field("text_at")).withColumn("named", F.when(is_csv, clean(_field("title_at"))).otherwise(F.regexp_replace(_field("title_at"), r"(?U)^\s+|\s+$", "")))
    fresh = (F.col("named") != "") & ~F.contains("body", "named")
    composed = (
        F.when(~is_record, F.col("text")).when(F.col("body") == "", F.col("shown"))
        .when(fresh & is_csv, F.concat(F.lit("Question: "), "named", F.lit("\nAnswer: "), "body")).when(fresh, F.concat_ws("\n\n", "named", "body")).otherwise(F.col("body"))
    )
    rows = rows.withColumn("clean", clean(composed))
    first_line = F.nullif(F.substring(F.substring_index("clean", "\n", 1), 1, 100), F.lit(""))
    numbered = lambda word: F.concat(stem, F.lit(word), number.cast("string"))
    csv_title = F.when((F.col("body") != "") & (F.col("named") != ""), F.col("named")).otherwise(numbered(" Row "))
    title = (
        F.when(is_csv, csv_title).when(is_json, F.coalesce(F.nullif("named", F.lit("")), numbered(" #"))).when(kind == "item", numbered(" Item "))
        .otherwise(F.coalesce(F.nullif(F.trim("title"), F.lit("")), first_line, stem))
    )
    others = F.map_filter("fields", lambda k, _: ~F.coalesce(k == F.col("title_at"), F.lit(False)) & ~F.coalesce(k == F.col("text_at"), F.lit(False)))
    order = F.create_map(F.when(is_csv, "row_index").otherwise("index"), F.col("no").cast("string"))
    own = F.when(is_json | (is_csv & (F.col("body") != "")), others).otherwise(F.create_map().cast("map<string,string>"))
    fixed = F.when(kind == "text", F.col("extra")).otherwise(F.map_concat(order, F.coalesce("extra", F.create_map().cast("map<string,string>"))))
    metadata = F.map_concat(F.map_filter(own, lambda k, _: ~F.array_contains(F.map_keys(fixed), k)), fixed)
    part = F.when(kind == "text", "").otherwise(F.col("no").cast("string"))
    made = rows.select(
        "path", "reason", document_id(F.col("filename"), part).alias("document_id"), "filename", F.col("path").alias("source"), F.substring("extension", 2, 16).alias("document_type"),
        title.alias("title"), F.col("clean").alias("text"), metadata.alias("metadata"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("ingestion_timestamp"),
    )
    return made.filter("reason is not null or text <> ''")


def documents(loaded: DataFrame) -> DataFrame:
    """The documents of :func:`load_files`."""
    return loaded.filter("reason is null").select(*[c.strip().split(" ")[0] for c in DOCUMENT.replace("<string,string>", "").split(",")])


def ingest_failures(loaded: DataFrame) -> DataFrame:
    """The files that gave no documents, with the reason."""
    return loaded.filter("reason is not null").select("path", "reason")
