"""Sinks: CSV, NDJSON and XLSX reports, manifests, segments, snapshots and the metadata-only bundle."""

from __future__ import annotations

import re
import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_SHEET_ROWS = 1_048_575


def guarded(cell: Column) -> Column:
    """A cell no spreadsheet takes for a formula."""
    text = cell.cast("string")
    return F.when(text.rlike(r"^[\t\r\n ]*[=+\-@]"), F.concat(F.lit("'"), text)).otherwise(text)


def write_csv(df: DataFrame, path: str) -> None:
    """Distributed CSV with a header; every cell is guarded, nested ones are JSON."""
    flat = [F.to_json(c.name) if c.dataType.typeName() in ("array", "map", "struct") else F.col(c.name) for c in df.schema]
    df.select(*[guarded(c).alias(f.name) for c, f in zip(flat, df.schema)]).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_ndjson(df: DataFrame, path: str) -> None:
    """Distributed JSON lines, nulls written out."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def column_letters(n: int) -> str:
    """Spreadsheet name of the column at ``n`` (from 0)."""
    out = ""
    n += 1
    while n:
        n, rest = divmod(n - 1, 26)
        out = chr(65 + rest) + out
    return out


_BAD_XML = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]")


def write_xlsx(sheets: dict[str, DataFrame], path: str) -> None:
    """A workbook with inline text, streamed row by row; a sheet with too many rows is refused."""
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    package = "http://schemas.openxmlformats.org/package/2006"
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(sheets) + 1))
        z.writestr(
            "[Content_Types].xml",
            f'{head}<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{kinds}</Types>',
        )
        z.writestr("_rels/.rels", f'{head}<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'{head}<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{escape(n, {chr(34): "&quot;"})}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(sheets, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="{package}/relationships">' + "".join(f'<Relationship Id="rId{i}" Type="{rel}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1)) + "</Relationships>")
        for i, df in enumerate(sheets.values(), 1):
            rows = df.select(*[guarded(F.col(c)).alias(c) for c in df.columns])
            with z.open(f"xl/worksheets/sheet{i}.xml", "w", force_zip64=True) as out:
                out.write(f'{head}<worksheet xmlns="{main}"><sheetData>'.encode())
                out.write(_row(1, df.columns))
                for number, row in enumerate(rows.toLocalIterator(prefetchPartitions=True), 2):
                    if number > MAX_SHEET_ROWS:
                        raise ValueError("too many rows for a sheet")
                    out.write(_row(number, row))
                out.write(b"</sheetData></worksheet>")


def _row(number: int, cells) -> bytes:  # noqa: ANN001
    said = "".join(f'<c r="{column_letters(k)}{number}" t="inlineStr"><is><t xml:space="preserve">{escape(_BAD_XML.sub("", str(v)))}</t></is></c>' for k, v in enumerate(cells) if v is not None)
    return f'<row r="{number}">{said}</row>'.encode("utf-8", "replace")


def bundle(pages: DataFrame, issues: DataFrame) -> DataFrame:
    """Metadata-only diagnostics, one JSON per crawl: counts by class and rule, no urls or texts."""
    a = pages.groupBy("crawl_id").agg(F.count(F.lit(1)).alias("pages"), F.count_if(F.col("status_code") >= 400).alias("failing"))
    b = issues.groupBy("crawl_id", "rule_id").agg(F.count(F.lit(1)).alias("n")).groupBy("crawl_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("rule_id", "n")))).alias("issues"))
    return a.join(b, "crawl_id", "left").select("crawl_id", F.to_json(F.struct("pages", "failing", "issues")).alias("bundle"))


def write_segments(df: DataFrame, path: str, key: str, known: DataFrame | None = None) -> DataFrame:
    """Write a snapshot partitioned by ``key`` and return its manifest: ``key``, rows and an order-free checksum.

    Segments are never changed: where ``known``, the manifest of what is there, has another checksum for one of
    them, nothing is written and ValueError is raised; equal ones are written again to the same end.
    """
    now = manifest(df, key)
    if known is not None:
        clash = now.join(known.select(key, F.col("checksum").alias("was")), key).filter("checksum <> was")
        if not clash.isEmpty():
            raise ValueError("a segment is there with other content")
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)
    return now


def manifest(df: DataFrame, key: str) -> DataFrame:
    """Rows and checksum of each part, for a later ``verify_segments``.

    The checksum doesn't depend on the order of rows: each row is written as text, column by column in order of
    names, times as microseconds and nulls as a sign of their own, and the first 60 bits of its MD5 are added up.
    """
    rest = sorted(c for c in df.columns if c != key)

    def said(name: str) -> Column:
        kind = df.schema[name].dataType.typeName()
        if kind == "timestamp":
            return F.unix_micros(name).cast("string")
        return F.to_json(name) if kind in ("map", "struct", "array", "variant") else F.col(name).cast("string")

    text = F.concat_ws("\x1f", *[F.coalesce(said(c), F.lit("\x00")) for c in rest])
    digest = F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("decimal(20,0)")
    return df.groupBy(F.col(key).cast("string").alias(key)).agg(F.count(F.lit(1)).alias("rows"), F.sum(digest).cast("decimal(38,0)").cast("string").alias("checksum"))


def record(df: DataFrame, path: str, kind: str, days: int | None = None) -> DataFrame:
    """Write an artifact and return its record: ``path, kind, rows, checksum, created_at, expires_at``.

    The files become visible at once when the job commits; a folder that holds other content is refused, one that
    holds the same is left as it is, so a repeated run gives the same record.
    """
    spark = df.sparkSession
    one = lambda x: manifest(x.withColumn("__all", F.lit("all")), "__all").first()
    now = one(df)
    rows, checksum = (now["rows"], now["checksum"]) if now else (0, "0")
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        there = one(spark.read.parquet(path))
        if (there["rows"], there["checksum"]) != (rows, checksum) if there else rows:
            raise ValueError(f"{path} holds other content")
    else:
        df.write.mode("errorifexists").parquet(path)
    out = spark.createDataFrame([(path, kind, rows, checksum)], "path string, kind string, rows long, checksum string")
    ends = F.lit(None).cast("timestamp") if days is None else F.current_timestamp() + F.expr(f"interval {int(days)} day")
    return out.withColumns({"created_at": F.current_timestamp(), "expires_at": ends})


def backup(spark: SparkSession, source: str, target: str, key: str) -> DataFrame:
    """Copy a snapshot and return its manifest; ValueError where the copy isn't equal part by part."""
    rows = spark.read.parquet(source)
    before = manifest(rows, key)
    rows.write.mode("errorifexists").parquet(target)
    if not verify_segments(spark.read.parquet(target), before, key).isEmpty():
        raise ValueError(f"{target} differs from {source}")
    return before


def verify_segments(df: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Parts that are missing, new or different from their manifest."""
    now = manifest(df, key).select(key, F.struct("rows", "checksum").alias("now"))
    both = known.select(key, F.struct("rows", "checksum").alias("was")).join(now, key, "full_outer")
    state = F.when(F.col("now").isNull(), "missing").when(F.col("was").isNull(), "unlisted").when(F.col("now") != F.col("was"), "changed")
    return both.select(key, state.alias("state")).filter("state is not null")


def expired(artifacts: DataFrame, now: Column) -> DataFrame:
    """Manifest rows past their time."""
    return artifacts.filter(F.col("expires_at") <= now)


def orphaned_files(files: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Listed files no manifest row names."""
    return files.join(artifacts.select("path"), "path", "left_anti")
