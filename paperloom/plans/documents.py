"""Documents as rows: files are parsed once, by one Arrow function; everything after is relational."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..sources.containers import NotAContainer, detect
from ..sources.crypt import decrypt
from ..sources.doc import read_doc
from ..sources.docx import Encrypted, read_docx

BLOCK = "struct<ord:int,kind:string,section:int,style:string,heading_level:int,list_level:int,list_label:string,text:string>"
SCHEMA = (
    "format string, error string, text string, markdown string, html string, blocks array<" + BLOCK + ">, "
    "styles array<struct<style_id:string,name:string,kind:string,based_on:string,is_default:boolean>>, "
    "media array<struct<name:string,content_type:string,data:binary>>, metadata map<string,string>, "
    "diagnostics array<struct<severity:string,location:string,message:string>>, "
    "sections array<struct<section:int,width:int,height:int,landscape:boolean,columns:int,start:string,title_page:boolean,"
    "page_number_start:int,page_number_format:string,borders:string,headers:map<string,string>,footers:map<string,string>>>"
)
#: Files and bytes of a batch that leaves at a time.
FILES, BYTES = 64, 16 << 20
OUTPUTS = ("text", "markdown", "html")


def read_document(data: bytes, password: str | None = None):
    """The model of a file's bytes; raises ValueError for what can't be read."""
    kind = detect(data)
    if kind == "encrypted_docx" and password is not None:
        return read_docx(decrypt(data, password))
    if kind == "docx":
        return read_docx(data)
    if kind == "doc":
        return read_doc(data, password)
    if kind == "encrypted_docx":
        raise Encrypted("the document is encrypted")
    raise NotAContainer(f"{kind} files are not read")


def parse_one(data: bytes | None, wanted: tuple[str, ...], password: str | None = None) -> dict:
    """A row of ``SCHEMA``; failures become ``error``."""
    from ..outputs import blocks_view, to_html, to_markdown, to_text
    from ..outputs.walk import Resolver

    row: dict = {"format": detect(data or b""), "error": None, "text": None, "markdown": None, "html": None, "blocks": [], "styles": [], "media": [], "metadata": [], "diagnostics": [], "sections": []}
    try:
        doc = read_document(data or b"", password)
        resolver = Resolver(doc)
        if "text" in wanted:
            row["text"] = to_text(doc, resolver=resolver)
        if "markdown" in wanted:
            row["markdown"] = to_markdown(doc, resolver=resolver)
        if "html" in wanted:
            row["html"] = to_html(doc, resolver=resolver)
    except (ValueError, RecursionError, IndexError, KeyError) as e:
        return row | {"error": f"{type(e).__name__}: {e}"}
    row["blocks"] = [{"ord": i} | b for i, b in enumerate(blocks_view(doc, resolver))]
    row["styles"] = [{"style_id": s.id, "name": s.name, "kind": s.kind, "based_on": s.based_on, "is_default": s.default} for s in doc.styles.values()]
    row["media"] = [{"name": m.name, "content_type": m.content_type, "data": m.data} for m in doc.media]
    row["metadata"] = list(doc.metadata.items())
    row["sections"] = [
        {"section": n, "columns": f.columns.count, "headers": list(f.headers.items()), "footers": list(f.footers.items())}
        | {k: getattr(f, k) for k in ("width", "height", "landscape", "start", "title_page", "page_number_start", "page_number_format", "borders")}
        for n, f in enumerate(doc.section_formats)
    ]
    row["diagnostics"] = [{"severity": a, "location": b, "message": c} for a, b, c in doc.diagnostics]
    return row


def parse(files: DataFrame, key: str = "path", content: str = "content", outputs: tuple[str, ...] = OUTPUTS, password: str | None = None) -> DataFrame:
    """(key, content) rows -> one row a file with ``SCHEMA``. A file that fails has its ``error`` and no more.

    At most FILES rows go out at a time, and fewer where their files have more than BYTES together.
    """
    own = files.select(F.col(key).alias("key"), F.col(content).alias("content"))
    kind = own.schema["key"].dataType
    schema = f"key {kind.simpleString()}, {SCHEMA}"
    arrow = _arrow_schema(files.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for at in range(len(batch)):
                data = batch.column(1)[at].as_py()
                rows.append({"key": batch.column(0)[at].as_py()} | parse_one(data, outputs, password))
                held += len(data or b"")
                if len(rows) == FILES or held > BYTES:
                    yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return own.mapInArrow(run, schema).withColumnRenamed("key", key)


def _arrow_schema(spark: SparkSession, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark.createDataFrame([], ddl).schema)


def read_documents(spark: SparkSession, path: str, glob: str = "*.{docx,doc}", outputs: tuple[str, ...] = OUTPUTS, password: str | None = None) -> DataFrame:
    """Files under a path, parsed. Files are spread by count, since one large file is one row anyway."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return parse(files.select("path", "content"), outputs=outputs, password=password)


def listing(spark: SparkSession, path: str | list[str], glob: str = "*.{docx,doc}") -> DataFrame:
    """(path, name, size) of the files under a path, by name and size; of equal ones the first path. No file is read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    named = files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"))
    return named.groupBy("name", "size").agg(F.min("path").alias("path")).select("path", "name", "size").orderBy("name", "size")


def extract_texts(spark: SparkSession, paths: str | list[str], strict: bool = True) -> DataFrame:
    """(ord, path, text) of the listed files, in the order of the list; a folder's files are listed by path.

    A failure raises when strict, else gives a null text. A path that is listed twice is read once and given twice.
    """
    if isinstance(paths, str):
        rows = read_documents(spark, paths, outputs=("text",)).select("path", "text", "error")
        ordered = rows.withColumn("ord", F.col("path"))
    else:
        wanted = [p if "://" in p or p.startswith("file:") else f"file:{os.path.abspath(p)}" for p in paths]
        listed = spark.createDataFrame(list(enumerate(wanted)), "ord int, path string")
        files = spark.read.format("binaryFile").load(sorted(set(wanted))) if wanted else spark.createDataFrame([], "path string, content binary")
        rows = parse(files.select("path", "content"), outputs=("text",)).select("path", "text", "error")
        same = lambda c: F.regexp_replace(c, "^file:/+", "file:/")
        ordered = listed.withColumn("_at", same("path")).join(rows.withColumn("_at", same("path")).drop("path"), "_at", "left")
    if strict:
        failed = F.raise_error(F.concat_ws(": ", "path", F.coalesce("error", F.lit("not found"))))
        fine = F.col("error").isNull() & F.col("text").isNotNull()
        ordered = ordered.withColumn("text", F.when(fine, F.col("text")).otherwise(failed.cast("string")))
    out = ordered.select("ord", "path", "text").orderBy("ord")
    return out if not isinstance(paths, str) else out.select("path", "text")


def sections(documents: DataFrame, key: str = "path") -> DataFrame:
    """A row a section, with the header and footer ids that are in force: a kind that a section leaves out is
    that of the section before."""
    rows = documents.select(key, F.explode("sections").alias("s")).select(key, "s.*")
    over = W.partitionBy(key).orderBy("section").rowsBetween(W.unboundedPreceding, 0)
    for part in ("headers", "footers"):
        for kind in ("first", "default", "even"):
            rows = rows.withColumn(f"{part[:-1]}_{kind}", F.last(F.try_element_at(part, F.lit(kind)), ignorenulls=True).over(over))
    return rows.drop("headers", "footers")


def unneeded_gone(diagnostics: DataFrame, skipped: DataFrame, key: str = "path") -> DataFrame:
    """Diagnostics without those that name a part that was left out on purpose: (key, location) rows."""
    return diagnostics.join(skipped.select(key, "location").distinct(), [key, "location"], "left_anti")


def block_view(documents: DataFrame, key: str = "path") -> DataFrame:
    return documents.select(key, F.explode("blocks").alias("b")).select(key, "b.*")


def media(documents: DataFrame, key: str = "path") -> DataFrame:
    return documents.select(key, F.explode("media").alias("m")).select(key, "m.*")


def diagnostics(documents: DataFrame, key: str = "path") -> DataFrame:
    return documents.select(key, F.posexplode("diagnostics").alias("ord", "d")).select(key, "ord", "d.*")


def info(documents: DataFrame, key: str = "path") -> DataFrame:
    """Counts of a document: blocks by kind, styles, media, diagnostics by severity."""
    count = lambda kind: F.size(F.filter("blocks", lambda b: b["kind"] == kind)).alias(f"n_{kind}")
    level = lambda s: F.size(F.filter("diagnostics", lambda d: d["severity"] == s)).alias(f"n_{s}")
    return documents.select(key, "format", "error", *(count(k) for k in ("heading", "paragraph", "list_item", "table")), F.size("styles").alias("n_styles"), F.size("media").alias("n_media"), level("dropped"), level("approximated"))


def to_files(texts: DataFrame, key: str = "doc_id", text: str = "text", markdown: bool = False) -> DataFrame:
    """(key, content): each text as a DOCX file, a paragraph a line, or read as Markdown."""
    from ..model import Document, Paragraph, Piece
    from ..sinks.docx import write_docx
    from ..sources.markdown import read_markdown

    own = texts.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def build(value: str) -> bytes:
        if markdown:
            return write_docx(read_markdown(value))
        blocks = [Paragraph(pieces=[Piece("text", line)] if line else []) for line in value.split("\n")]
        return write_docx(Document(sections=[blocks]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 64):
                part = batch.slice(at, 64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([build(t) for t in part.column(1).to_pylist()], pa.binary())], ["key", "content"])

    return own.mapInArrow(run, f"key {own.schema['key'].dataType.simpleString()}, content binary").withColumnRenamed("key", key)
