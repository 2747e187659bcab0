"""Sinks: JSON lines, partitioned files, graph exports, reports."""

from __future__ import annotations

import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def json_out(df: DataFrame, path: str, mode: str = "overwrite", by: str | None = None) -> None:
    """K-01 to K-04, K-15 to K-17, K-19: JSON lines, appended or anew, one folder a value of `by`."""
    w = df.write.mode(mode)
    (w.partitionBy(by) if by else w).json(path)


def csv_out(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """K-11: CSV with a header; nested columns become JSON."""
    flat = [F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in df.dtypes]
    df.select(*flat).write.mode(mode).option("header", True).csv(path)


def wiki_records(df: DataFrame, topic: str) -> DataFrame:
    """K-16: question, answer, thoughts and meta."""
    return df.select("question", "answer", "cot", F.struct(F.length("cot").alias("cot_length"), F.lit(topic).alias("topic")).alias("meta"))


def graph_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """K-05: one JSON line a node and an edge."""
    return nodes.select(F.to_json(F.struct(F.lit("node").alias("kind"), "id", "type")).alias("value")).unionByName(edges.select(F.to_json(F.struct(F.lit("edge").alias("kind"), "src", "rel", "dst")).alias("value")))


def cypher(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """K-06: statements that make the graph; quotes are escaped."""
    q = lambda c: F.concat(F.lit("'"), F.replace(F.replace(F.col(c).cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("'"))
    made = nodes.select(F.concat(F.lit("MERGE (n:Entity {id: "), q("id"), F.lit("}) SET n.type = "), q("type"), F.lit(";")).alias("value"))
    joined = edges.select(F.concat(F.lit("MATCH (a:Entity {id: "), q("src"), F.lit("}), (b:Entity {id: "), q("dst"), F.lit("}) MERGE (a)-[:REL {type: "), q("rel"), F.lit("}]->(b);")).alias("value"))
    return made.unionByName(joined)


def cytoscape(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """K-07: elements as JSON lines."""
    s = lambda c: F.col(c).cast("string")
    return nodes.select(F.to_json(F.struct(F.struct(s("id").alias("id"), F.col("type").alias("type")).alias("data"))).alias("value")).unionByName(edges.select(F.to_json(F.struct(F.struct(s("src").alias("source"), s("dst").alias("target"), F.col("rel").alias("relation")).alias("data"))).alias("value")))


def gml(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """K-08: blocks of the graph modelling language, without the frame around them."""
    s = lambda c: F.col(c).cast("string")
    return nodes.select(F.concat(F.lit('node [ id "'), s("id"), F.lit('" type "'), s("type"), F.lit('" ]')).alias("value")).unionByName(edges.select(F.concat(F.lit('edge [ source "'), s("src"), F.lit('" target "'), s("dst"), F.lit('" label "'), s("rel"), F.lit('" ]')).alias("value")))


def text_out(df: DataFrame, path: str) -> None:
    """K-05 to K-08."""
    df.select("value").write.mode("overwrite").text(path)


def markdown(title: str, tables: dict[str, DataFrame], most: int = 50) -> str:
    """K-10: a report of aggregates, which have few rows; at most so many of each are shown."""
    out = [f"# {title}"]
    for name, df in tables.items():
        rows = df.limit(most).collect()
        out += ["", f"## {name}", "", "| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
        out += ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows]
    return "\n".join(out) + "\n"


def seed_export(df: DataFrame, date: str, flag: str) -> DataFrame:
    """K-13: dates and flags as text."""
    return df.withColumn(date, F.date_format(date, "yyyy-MM-dd")).withColumn(flag, F.when(F.col(flag), "是").otherwise("否"))


def sheets_out(df: DataFrame, folder: str, heads: list[str] | None = None) -> DataFrame:
    """K-09: one .xlsx file a partition with rows in its only sheet, under headings; rows stream into the file. Returns path and rows.

    Files of failed attempts are left and not told.
    """
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(folder)
    store.create_dir(base, recursive=True)
    names = heads or df.columns
    part = lambda name, what: f'<Override PartName="/{name}" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.{what}+xml"/>'
    head, rel = '<?xml version="1.0" encoding="UTF-8"?>', "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    fixed = {
        "[Content_Types].xml": f'{head}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>{part("xl/workbook.xml", "sheet.main")}{part("xl/worksheets/sheet1.xml", "worksheet")}</Types>',
        "_rels/.rels": f'{head}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/_rels/workbook.xml.rels": f'{head}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{rel}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/workbook.xml": f'{head}<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="{rel}"><sheets><sheet name="rows" sheetId="1" r:id="r1"/></sheets></workbook>',
    }
    row = lambda cells: "<row>" + "".join("<c/>" if c is None else f'<c t="inlineStr"><is><t xml:space="preserve">{escape(str(c))}</t></is></c>' for c in cells) + "</row>"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n = TaskContext.get(), 0
        path = f"{base}/part-{task.partitionId():05d}-{task.taskAttemptId()}.xlsx"
        with fs.FileSystem.from_uri(folder)[0].open_output_stream(path, compression=None) as raw, zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as z:
            for name, text in fixed.items():
                z.writestr(name, text)
            with z.open("xl/worksheets/sheet1.xml", "w") as xml:
                xml.write(f'{head}<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{row(names)}'.encode())
                for batch in batches:
                    xml.write("".join(row(cells) for cells in zip(*(c.to_pylist() for c in batch.columns), strict=True)).encode())
                    n += batch.num_rows
                xml.write(b"</sheetData></worksheet>")
        yield pa.RecordBatch.from_pydict({"path": [path], "rows": [n]}, pa.schema([("path", pa.string()), ("rows", pa.int64())]))

    out = df.toDF(*(f"c{i}" for i in range(len(df.columns)))).mapInArrow(write, "path string, rows long")
    out.write.parquet(f"{folder}.told")
    return df.sparkSession.read.parquet(f"{folder}.told")
