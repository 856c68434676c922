"""Files of a library: discovery, hashes, incremental scans, text and layout readers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.text import blank_to_null, excluded, strip
from corpusloom.operators.rewrites import last_wins

LIBRARY = ("pdf", "djvu")
STORE = ("pdf", "txt", "md", "docx", "doc", "html", "htm")
TEXT_LIMIT = 6000
#: Fixed values of the store's cost estimate.
TOKENS_A_FILE, DOLLARS_A_MILLION = 100_000, 0.15


def stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "[/\\\\]"), -1), r"(?<=.)\.[^.]*$", "")


def collect(spark: SparkSession, root: str, extensions: tuple[str, ...] = LIBRARY, skip: tuple[str, ...] = (), max_bytes: int | None = None) -> DataFrame:
    """``path, modificationTime, length, content`` of the library's files.  Listing and filters come before contents are read."""
    glob = "*.{" + ",".join(x for e in extensions for x in (e, e.upper())) + "}"
    out = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    if blank := _blank(spark, root, extensions):
        out = out.union(spark.createDataFrame(blank, out.schema))
    if max_bytes is not None:
        out = out.where(F.col("length") <= max_bytes)
    return out.where(~excluded(F.col("path"), skip)) if skip else out


def _blank(spark: SparkSession, root: str, extensions: tuple[str, ...]) -> list[tuple]:
    """Files without a byte, which Spark's readers leave out."""
    from datetime import datetime

    where = spark._jvm.org.apache.hadoop.fs.Path(root)
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(where, True)
    out = []
    while found.hasNext():
        f = found.next()
        name = f.getPath().getName()
        if f.getLen() == 0 and name[:1] not in "._" and name.rsplit(".", 1)[-1] in {x for e in extensions for x in (e, e.upper())}:
            out.append((f.getPath().toString(), datetime.fromtimestamp(f.getModificationTime() / 1000), 0, bytearray()))
    return out


def hashed(files: DataFrame) -> DataFrame:
    return files.withColumn("hash", F.sha2("content", 256))


def to_index(files: DataFrame, state: DataFrame, limit: int | None = None) -> DataFrame:
    """The files that changed since they were indexed; with ``limit`` the first by path.  Paths are sorted, never contents."""
    from corpusloom.operators.state import dirty

    out = dirty(hashed(files), state)
    return out.join(out.select("path").orderBy("path").limit(limit), "path", "left_semi") if limit else out


def texts(files: DataFrame, limit: int = TEXT_LIMIT) -> DataFrame:
    """``path, text``: the beginning that extraction reads, null where there is none."""
    text = F.col("content").cast("string")
    return files.select("path", blank_to_null(strip(F.substring(text, 1, limit))).alias("text"))


def missing_pdf(paths: DataFrame) -> DataFrame:
    """DjVu files without a PDF of the same name beside them."""
    base = F.regexp_replace(F.col("path"), r"\.[^./]*$", "")
    ext = F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1))
    rows = paths.withColumn("__base", base).withColumn("__ext", ext)
    return rows.where("__ext = 'djvu'").join(rows.where("__ext = 'pdf'").select("__base"), "__base", "left_anti").select("path")


def to_upload(files: DataFrame, uploaded: DataFrame) -> DataFrame:
    return files.join(uploaded.select("path"), "path", "left_anti")


def upload_cost(files: DataFrame) -> DataFrame:
    n = F.count("*")
    return files.agg(n.alias("files"), F.coalesce(F.sum("length"), F.lit(0)).cast("long").alias("bytes"), F.round(n * TOKENS_A_FILE / 1e6 * DOLLARS_A_MILLION, 6).alias("dollars"))


def bibliography_index(items: DataFrame) -> DataFrame:
    """One row an attachment's file stem, of several the last: ``items`` has ``ord, citekey, title, author, date, language, type, attachments``."""
    a = items.select("*", F.posexplode("attachments").alias("n", "a")).where("a.path <> ''")
    a = a.select(F.lower(stem(F.col("a.path"))).alias("stem"), F.struct("ord", "n").alias("at"), "citekey", "title", "author", "date", "language", "type")
    return last_wins(a, ["stem"], "at").drop("at")


def with_bibliography(files: DataFrame, index: DataFrame) -> DataFrame:
    """Files with the bibliographic data of their stem, and defaults for those without."""
    out = files.withColumn("stem", F.lower(stem(F.col("path")))).join(index, "stem", "left")
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    return out.select(*files.columns, blank("citekey").alias("zotero_key"), F.coalesce("title", stem(F.col("path"))).alias("title"), blank("author").alias("author"), F.when(F.col("date") != "", F.substring("date", 1, 4)).alias("year"), blank("language").alias("language"), F.coalesce("type", F.lit("other")).alias("publication_type"))


def pdf_pages(files: DataFrame) -> DataFrame:
    """``path, page, text`` of PDF files, where a PDF library is installed; else an error names it."""
    from corpusloom.functions.text import page_text

    def run(batches):
        import fitz
        import pandas as pd

        for pdf in batches:
            rows = [(path, i + 1, page.get_text()) for path, content in zip(pdf["path"], pdf["content"]) for i, page in enumerate(fitz.open(stream=content, filetype="pdf"))]
            yield pd.DataFrame(rows, columns=["path", "page", "text"])

    return files.select("path", "content").mapInPandas(run, "path string, page int, text string").withColumn("text", page_text(F.col("text")))


def ocr_pages(text: Column) -> Column:
    """Pages of an OCR engine's one text, split at its page headings."""
    return F.split(text, r"\n#{1,3} Page \d+")


def convert(files: DataFrame, command: tuple[str, ...], suffix: str = ".pdf", seconds: int = 300) -> DataFrame:
    """``path, converted, error``: each file through an external program, in parallel.

    ``command`` has ``{source}`` and ``{target}``; output of a run that failed or
    took too long is removed.  The program and the files must be where tasks run.
    """

    def run(batches):
        import os
        import subprocess

        import pandas as pd

        for pdf in batches:
            rows = []
            for path in pdf["path"]:
                source = path.removeprefix("file:")
                target = source[: source.rindex(".")] + suffix
                try:
                    done = subprocess.run([a.format(source=source, target=target) for a in command], capture_output=True, timeout=seconds)
                    error = done.stderr.decode(errors="replace")[:500] if done.returncode else None
                except (OSError, subprocess.TimeoutExpired) as e:
                    error = str(e)[:500]
                if error is not None and os.path.exists(target):
                    os.remove(target)
                rows.append((path, target if error is None else None, error))
            yield pd.DataFrame(rows, columns=["path", "converted", "error"])

    return files.select("path").mapInPandas(run, "path string, converted string, error string")


def log_tail(lines: DataFrame, n: int = 80) -> DataFrame:
    """The last ``n`` lines (``line_no, line``)."""
    return lines.orderBy(F.desc("line_no")).limit(n)
