"""Reading a corpus of filings: company master, manifest, raw documents of several files, PDF text.

Nothing lists or reads files on the driver but the one search for the manifest; documents are rows of the
``binaryFile`` source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gyeol.functions.text import html_to_text, major_kind
from gyeol.sources.schemas import MANIFEST, TABLES, column_names

SUFFIXES = ["xml", "html", "pdf"]


def suffix_glob(suffixes: list[str]) -> str:
    """File names with these suffixes in any case, so that no other file's bytes are read."""
    return "*.{" + ",".join("".join(f"[{c}{c.upper()}]" for c in s) for s in suffixes) + "}"


def files(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(root)


def corpus_root(spark: SparkSession, base: str) -> str:
    """Folder of the only manifest.jsonl below ``base``."""
    hits = [r.path for r in files(spark, base, "manifest.jsonl").select("path").limit(2).collect()]
    if not hits:
        raise FileNotFoundError(f"no manifest.jsonl below {base}")
    if len(hits) > 1:
        raise RuntimeError(f"more than one manifest.jsonl below {base}")
    return hits[0].rpartition("/")[0]


def nfc(c: Column) -> Column:
    """Composed form of a path; file systems may list it decomposed."""
    return F.when(c.isNotNull(), F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), F.coalesce(c, F.lit("")), F.lit(False)))


def load_companies(spark: SparkSession, root: str) -> DataFrame:
    """The company master; a missing column is an error. A byte-order mark is dropped by the reader."""
    head = spark.read.option("header", True).csv(f"{root}/universe.csv").columns
    if missing := [c for c in column_names("company") if c not in head]:
        raise KeyError(f"universe.csv has no column {missing}")
    kinds = dict(x.split() for x in TABLES["company"].split(", "))
    raw = spark.read.schema(", ".join(f"`{c}` STRING" for c in head)).option("header", True).csv(f"{root}/universe.csv")
    return raw.select(*[F.col(c).try_cast("double").cast("bigint").cast(kinds[c].lower()).alias(c) if kinds[c] in ("INT", "BIGINT") else F.col(c) for c in column_names("company")])


def load_manifest(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(MANIFEST).json(f"{root}/manifest.jsonl")


def build_documents(manifest: DataFrame) -> DataFrame:
    """The document table of a manifest: kinds of decisions derived, categories null, numbers typed."""
    own = {
        "major_kind": F.when(F.col("doc_group") == "major", major_kind(F.col("report_nm"))), "category": F.lit(None).cast("string"), "base_year": F.col("base_year").cast("int"),
        "base_month": F.col("base_month").cast("int"), "is_correction": F.col("is_correction").cast("int"),
    }
    return manifest.select(*[own[c].alias(c) if c in own else F.col(c) for c in column_names("document")])


def document_files(spark: SparkSession, root: str, suffixes: list[str] = SUFFIXES) -> DataFrame:
    """(folder, path, suffix, content) of the files of all document folders; folder is relative and composed."""
    raw = files(spark, root, suffix_glob(suffixes)).select("path", "content")
    inside = F.regexp_replace(F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))), "^file:/+", "/")
    out = raw.withColumn("full", inside).withColumn("folder", nfc(F.regexp_replace("full", r"/[^/]*$", ""))).withColumn("suffix", F.lower(F.regexp_extract("full", r"\.([^./]+)$", 1)))
    return out.where(F.col("suffix").isin(suffixes)).select("folder", F.col("full").alias("path"), "suffix", "content")


def raw_documents(spark: SparkSession, root: str, manifest: DataFrame) -> DataFrame:
    """(doc_id, raw) of all documents: their XML and HTML files in name order, bad bytes replaced; '' without files."""
    base = F.lit(root.replace("file://", "").replace("file:", "").rstrip("/") + "/")
    docs = manifest.select("doc_id", nfc(F.concat(base, "file_path")).alias("folder"))
    text = F.make_valid_utf8(F.col("content").cast("string"))
    parts = document_files(spark, root, ["xml", "html"]).select("folder", F.struct("path", text.alias("t")).alias("x"))
    joined = docs.join(parts, "folder", "left").groupBy("doc_id").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    return joined.select("doc_id", F.array_join(F.transform("xs", lambda x: x["t"]), "").alias("raw"))


def document_texts(raw: DataFrame, keep_cells: bool = True) -> DataFrame:
    return raw.select("doc_id", html_to_text(F.col("raw"), keep_cells).alias("text"))


def pdf_texts(spark: SparkSession, root: str, stop: str | None = None, max_pages: int = 40) -> DataFrame:
    """(folder, text) of PDF files, page by page up to ``stop`` or ``max_pages``; '' where no PDF reader is installed."""

    def run(batches):
        import io

        import pandas as pd

        try:
            from pypdf import PdfReader
        except ImportError:
            PdfReader = None
        for pdf in batches:
            texts = []
            for content in pdf["content"]:
                pages: list[str] = []
                for i, page in enumerate(PdfReader(io.BytesIO(content)).pages if PdfReader else ()):
                    pages.append(page.extract_text() or "")
                    if (stop and stop in pages[-1]) or i + 1 >= max_pages:
                        break
                texts.append("\n".join(pages))
            yield pd.DataFrame({"folder": pdf["folder"], "path": pdf["path"], "text": texts})

    pdfs = document_files(spark, root, ["pdf"]).select("folder", "path", "content")
    got = pdfs.mapInPandas(run, "folder string, path string, text string")
    return got.groupBy("folder").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "text"))), lambda x: x["text"]), "\n").alias("text"))
