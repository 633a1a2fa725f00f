"""JSON, JSON lines, manifests, registries, texts, CSV and DOCX as tables, each with its policy for what is broken."""

from __future__ import annotations

import html
import io
import re
import uuid
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import collapse

ENTRY = "source string, status string, output_folder string, video string, secondary_video string, audio string, translated_vtt string, original_transcription string"
REGISTRY = "source_name string, sha256 string, size long, archive_name string, output_folders array<string>, processed_at timestamp, status string"
# Fixed value: the most bytes of a context file.
PROMPT_BYTES = 2 << 20


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    return bool(found) and len(found) > 0


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON-lines file with file order `pos`; blank, broken and non-object lines are skipped, wrong types are null."""
    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("pos"))
    parsed = lines.select("pos", F.try_parse_json("value").alias("v")).filter(F.schema_of_variant("v").startswith("OBJECT"))
    fields = T.StructType.fromDDL(schema).fields
    return parsed.select("pos", *[F.try_variant_get("v", f"$.{f.name}", f.dataType.simpleString()).alias(f.name) for f in fields])


def successes(registry: DataFrame) -> DataFrame:
    return registry.filter("status = 'success'")


def manifest(spark: SparkSession, path: str, entry: str = ENTRY) -> DataFrame:
    """version, pos and the entries of a manifest: an object (version 1 if it names none or 0) or a bare list (version 1).

    Broken JSON raises; where there is no file there are no entries.
    """
    if not _exists(spark, path):
        return spark.createDataFrame([], T.StructType([T.StructField("version", T.IntegerType()), T.StructField("pos", T.IntegerType()), *T.StructType.fromDDL(entry).fields]))
    whole = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("v"))
    bare = F.schema_of_variant("v").startswith("ARRAY")
    kind = f"array<struct<{', '.join(f'{f.name}: {f.dataType.simpleString()}' for f in T.StructType.fromDDL(entry).fields)}>>"
    entries = F.when(bare, F.variant_get("v", "$", kind)).otherwise(F.variant_get("v", "$.entries", kind))
    version = F.when(bare, F.lit(1)).otherwise(F.coalesce(F.nullif(F.variant_get("v", "$.version", "int"), F.lit(0)), F.lit(1)))
    return whole.select(version.alias("version"), F.posexplode(entries).alias("pos", "e")).select("version", "pos", "e.*")


def write_json_document(spark: SparkSession, document: str, path: str) -> None:
    """One document, published whole: written beside the path, synced, then renamed over it in one step."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    target = hadoop.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    part = hadoop.Path(f"{path}.{uuid.uuid4().hex}.part")
    out = fs.create(part, False)
    try:
        out.write(bytearray(document.encode()))
        out.hsync()
    finally:
        out.close()
    rename = spark._jvm.org.apache.hadoop.fs.Options.Rename
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    context = hadoop.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    try:
        context.rename(fs.makeQualified(part), fs.makeQualified(target), how)
    except Exception:
        fs.delete(part, False)
        raise


def append_json_lines(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def text_file(spark: SparkSession, path: str) -> DataFrame:
    """path, text of whole UTF-8 files, without a byte order mark; missing, empty and invalid ones raise."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    p = hadoop.Path(path)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p) or []
    if not len(found):
        raise FileNotFoundError(path)
    if any(s.isFile() and s.getLen() == 0 for s in found):  # the reader passes over these
        raise ValueError(f"empty file in {path}")
    files = spark.read.format("binaryFile").load(path)
    checked = F.when(~F.is_valid_utf8(F.col("content").cast("string")), F.raise_error(F.concat(F.lit("not UTF-8: "), F.col("path"))))
    text = F.regexp_replace(F.col("content").cast("string"), "^﻿", "")
    return files.select("path", F.coalesce(checked.cast("string"), text).alias("text"))


def csv_text(spark: SparkSession, path: str) -> DataFrame:
    """path, text: the cells of a CSV file, trimmed, without empty ones, row by row, joined by comma and space."""
    rows = spark.read.option("header", False).option("multiLine", True).csv(path)
    cells = F.array_compact(F.array(*[F.nullif(F.trim(c), F.lit("")) for c in rows.columns]))
    lines = rows.select(F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("i"), F.array_join(cells, ", ").alias("line")).filter("line <> ''")
    return lines.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "line"))), lambda x: x["line"]), ", ").alias("text"))


def docx_text(files: DataFrame, most_bytes: int = PROMPT_BYTES) -> DataFrame:
    """path, text, error of DOCX files (path, content): the text runs that aren't blank, trimmed, joined by spaces; DTDs and entities are refused."""

    @F.pandas_udf(T.StructType.fromDDL("text string, error string"))
    def read(content: pd.Series) -> pd.DataFrame:
        def one(data):
            try:
                with zipfile.ZipFile(io.BytesIO(data)) as z:
                    info = z.getinfo("word/document.xml")
                    if info.file_size > most_bytes:
                        return None, "too large"
                    xml = z.read(info).decode("utf-8")
            except (zipfile.BadZipFile, KeyError, UnicodeDecodeError, TypeError) as e:
                return None, type(e).__name__
            if re.search(r"<!\s*(DOCTYPE|ENTITY)", xml, re.IGNORECASE):
                return None, "entities"
            runs = re.findall(r"<w:t(?:\s[^>]*)?>(.*?)</w:t>", xml, re.DOTALL)
            return " ".join(html.unescape(t).strip() for t in runs if t.strip()), None

        return pd.DataFrame([one(c) for c in content], columns=["text", "error"])

    return files.select("path", read("content").alias("r")).select("path", "r.*")


def prompt(spark: SparkSession, literal: str | None, candidates: list[str]) -> str | None:
    """The prompt itself, or the text of the first candidate file that exists, white space collapsed; files over 2 MiB raise."""
    if literal:
        return " ".join(literal.split())
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    for path in candidates:
        p = hadoop.Path(path)
        fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(p):
            continue
        if fs.getFileStatus(p).getLen() > PROMPT_BYTES:
            raise ValueError(f"{path} exceeds {PROMPT_BYTES} bytes")
        rows = csv_text(spark, path) if path.lower().endswith(".csv") else docx_text(spark.read.format("binaryFile").load(path)) if path.lower().endswith(".docx") else text_file(spark, path)
        got = rows.select(collapse(F.col("text")).alias("text")).first()
        return got["text"] if got and got["text"] else None
    return None


def rewritten(patched: DataFrame, path: str, partition: str = "manifest") -> list[str]:
    """Writes the partitions of a manifest folder (Parquet, by `partition`) in which rows are `changed`; the others keep their files.

    patched: all rows of the folder with changed (as listings.patched gives them), read from where they are written.  What
    is to be written is stored first, so a failure while reading loses nothing, and each partition is replaced when the
    whole write commits.  The values of the partitions that were written; none changed, none written.
    """
    from ..operators.running import stored

    spark = patched.sparkSession
    found = patched.filter("changed").select(F.col(partition).alias("_part")).distinct()
    touched = [r[0] for r in found.collect()]  # a manifest is a run; runs that one patch touches are few
    if touched:
        rows = patched.join(F.broadcast(found), F.col(partition).eqNullSafe(F.col("_part"))).drop("_part", "changed")
        kept = stored(rows, "manifests")
        kept.repartition(partition).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
    return touched
