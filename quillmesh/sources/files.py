"""Document files and bulk manifests as DataFrames.

Containers (ZIP with XML) are opened in Arrow batches; everything after that is Column expressions.
Formats that need a parser outside the standard library are a hook: pass `parsers` an extension and a
function from bytes to text.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.functions.text import extension, latex_text, trimmed
from quillmesh.sources.pdf import pdf_text

MOST_BYTES, MOST_WORDS, MOST_ROWS = 50 * 1024 * 1024, 50_000, 10_000
_SLIDE = re.compile(r"ppt/slides/slide(\d+)\.xml")
_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&"))


def _part(archive: zipfile.ZipFile, name: str) -> str:
    try:
        return archive.read(name).decode("utf-8", "replace")
    except KeyError:
        return ""


def _decoded(xml: str) -> str:
    for entity, char in _ENTITIES:
        xml = xml.replace(entity, char)
    return xml


def docx_text(data: bytes) -> str:
    """Paragraphs of the main part, one line each."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = _part(z, "word/document.xml")
    lines = ("".join(_decoded(t) for t in re.findall(r"<w:t(?:\s[^>]*)?>([^<]*)</w:t>", p)) for p in re.split(r"</w:p>", body))
    return "\n\n".join(x for x in lines if x.strip())


def pptx_text(data: bytes) -> str:
    """Text runs of each slide in slide order; slides without text are left out."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        slides = sorted((int(m[1]), n) for n in z.namelist() if (m := _SLIDE.fullmatch(n)))
        pages = (" ".join(x for t in re.findall(r"<a:t[^>]*>([\s\S]*?)</a:t>", _part(z, n)) if (x := _decoded(t).strip())) for _, n in slides)
        return "\n\n".join(p for p in pages if p)


def read_files(spark: SparkSession, path: str, parsers: dict[str, Callable[[bytes], str]] | None = None) -> DataFrame:
    """(path, file_name, kind, text, error) of every file: unreadable, empty and oversized ones have an error instead of text."""
    known = {"docx": docx_text, "pptx": pptx_text, "pdf": pdf_text} | (parsers or {})

    def opened(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, errors = [], []
            for data, kind in zip(batch["content"], batch["kind"]):
                try:
                    texts.append(known[kind](data) if kind in known else bytes(data).decode("utf-8", "replace"))
                    errors.append(None)
                except Exception as e:  # a broken container is a row with an error, not a failed job
                    texts.append(None)
                    errors.append(f"unreadable: {type(e).__name__}")
            yield pd.DataFrame({"path": batch["path"], "file_name": batch["file_name"], "kind": batch["kind"], "text": texts, "error": errors})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    fits = files.where(F.col("length") <= MOST_BYTES).select("path", name.alias("file_name"), extension(name).alias("kind"), "content")
    read = fits.mapInPandas(opened, "path string, file_name string, kind string, text string, error string")
    large = files.where(F.col("length") > MOST_BYTES).select("path", name.alias("file_name"), extension(name).alias("kind"), F.lit(None).cast("string").alias("text"), F.lit("too large").alias("error"))
    text = F.when(F.col("kind").isin("tex", "latex"), latex_text(F.col("text"))).otherwise(F.col("text"))
    read = read.withColumn("text", text)
    words = F.size(F.split(trimmed(F.col("text")), r"\s+"))
    error = F.coalesce("error", F.when(trimmed(F.col("text")) == "", "empty").when(words > MOST_WORDS, "too many words"))
    return read.withColumn("error", error).unionByName(large)


def sniffed(content: Column) -> Column:
    """pdf, zip or plain by the first 16 bytes; null if neither."""
    head = F.hex(F.substring(content, 1, 16))
    return F.when(head.startswith("25504446"), "pdf").when(head.startswith("504B0304"), "zip").when(head.rlike("^(?:09|0A|0D|00|[2-6][0-9A-F]|7[0-9A-E])+$"), "plain")


def csv_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(file_name, text) of each manifest: a heading, then name and text parted by the first comma alone.

    Of each file the first line that isn't empty is the heading, and at most MOST_ROWS lines after it count.
    """
    lines = spark.read.text(path, wholetext=True).select(F.filter(F.split("value", r"\r\n|\n"), lambda x: F.trim(x) != "").alias("lines"))
    rows = lines.select(F.explode(F.slice("lines", 2, MOST_ROWS)).alias("line"))
    parts = rows.select(F.trim(F.regexp_extract("line", r"^([^,]*),(.*)$", 1)).alias("file_name"), F.trim(F.regexp_extract("line", r"^([^,]*),(.*)$", 2)).alias("text"))
    return parts.where("file_name <> '' and text <> ''")


def json_bulk(spark: SparkSession, path: str) -> DataFrame:
    """(file_name, text) of the first MOST_ROWS entries of each JSON body's documents; entries without either are left out."""
    body = spark.read.schema("documents array<struct<filename: string, text: string>>").option("multiLine", True).json(path)
    rows = body.select(F.explode(F.slice("documents", 1, MOST_ROWS)).alias("d"))
    return rows.select(F.col("d.filename").alias("file_name"), "d.text").where("file_name is not null and text is not null")


def docx_meta(spark: SparkSession, path: str) -> DataFrame:
    """One row for each DOCX file: authors, times, counts, fonts, styles, tracked changes and what they suggest."""

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = {"core": "docProps/core.xml", "app": "docProps/app.xml", "document": "word/document.xml", "styles": "word/styles.xml"}
        for batch in batches:
            out = []
            for p, data in zip(batch["path"], batch["content"]):
                try:
                    with zipfile.ZipFile(io.BytesIO(data)) as z:
                        out.append((p, *[_part(z, n) for n in names.values()]))
                except zipfile.BadZipFile:
                    continue
            yield pd.DataFrame(out, columns=["path", *names])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.docx").load(path)
    return suspicion(files.select("path", "content").mapInPandas(parts, "path string, core string, app string, document string, styles string"))


def attribute(xml: Column, element: str, name: str) -> Column:
    """The value of an attribute of the first such element that has it; null if none."""
    found = F.regexp_extract(xml, rf'<{element}[^>]*\b{name}="([^"]+)"', 1)
    return F.when(found != "", found)


def suspicion(parts: DataFrame) -> DataFrame:
    """Metadata and flags from the XML parts (path, core, app, document, styles)."""

    def tag(part: str, name: str) -> Column:
        found = F.regexp_extract(part, f"<{name}[^>]*>([^<]*)</{name}>", 1)
        return F.when(found != "", found)

    fonts = F.array_distinct(F.concat(F.regexp_extract_all("document", F.lit('w:ascii="([^"]+)"'), 1), F.regexp_extract_all("document", F.lit('w:hAnsi="([^"]+)"'), 1)))
    meta = parts.select(
        "path", tag("core", "dc:creator").alias("author"), tag("core", "cp:lastModifiedBy").alias("editor"), tag("core", "dcterms:created").alias("created"), tag("core", "dcterms:modified").alias("modified"), tag("core", "cp:revision").try_cast("int").alias("revisions"),
        tag("app", "TotalTime").try_cast("int").alias("minutes"), F.coalesce(tag("app", "Words").try_cast("int"), F.lit(0)).alias("words"), tag("app", "Application").alias("application"),
        fonts.alias("fonts"), F.regexp_count("styles", F.lit("<w:style ")).alias("styles"), (F.regexp_count("document", F.lit("<w:ins ")) + F.regexp_count("document", F.lit("<w:del "))).alias("tracked"),
    )
    n = lambda c: F.col(c).cast("string")
    # Codes, severities, thresholds and messages of the flags.
    rules = (
        ("FAST_CREATION", "HIGH", (F.col("words") > 300) & (F.col("minutes") < 3), F.concat(F.lit("Document has "), n("words"), F.lit(" words but total edit time is only "), n("minutes"), F.lit(" minute(s). Likely copy-pasted rather than typed."))),
        ("LOW_REVISIONS", "WARN", (F.col("revisions") <= 2) & (F.col("words") > 500), F.concat(F.lit("Only "), n("revisions"), F.lit(" revision(s) for a "), n("words"), F.lit("-word document. Documents written organically typically have many more revisions."))),
        ("FONT_DIVERSITY", "WARN", F.size("fonts") > 6, F.concat(F.size("fonts").cast("string"), F.lit(" distinct font families detected: "), F.array_join(F.slice("fonts", 1, 6), ", "), F.lit(". Multiple fonts suggest text was pasted from different sources."))),
        ("MULTIPLE_AUTHORS", "WARN", F.col("author") != F.col("editor"), F.concat(F.lit('Created by "'), "author", F.lit('" but last modified by "'), "editor", F.lit('". Multiple authors on a submission warrant review.'))),
        ("APP_MISMATCH", "INFO", F.col("application").rlike("(?i)google|libreoffice|openoffice"), F.concat(F.lit('Document created with "'), "application", F.lit('". Different from the expected institutional word processor.'))),
        ("TRACKED_CHANGES", "INFO", F.col("tracked") > 20, F.concat(n("tracked"), F.lit(" tracked changes found. Review the accept/reject history."))),
        ("STYLE_COUNT", "INFO", F.col("styles") > 50, F.concat(n("styles"), F.lit(" styles in document — higher than typical. May indicate content assembled from multiple documents."))),
    )
    flags = F.array(*[F.when(condition, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), message.alias("message"))) for code, severity, condition, message in rules])
    return meta.withColumn("flags", F.filter(flags, lambda f: f.isNotNull()))
