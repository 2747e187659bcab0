"""Scans: JSON lines, whole files, CSV dialects, uploads with headers, spreadsheets and XML, as DataFrames with bad rows told apart."""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

BAD = "_corrupt_record"
FILE = "_metadata.file_name"


def json_lines(spark: SparkSession, path: str | list[str], schema: str, recursive: bool = False) -> DataFrame:
    """S-01, S-03, S-22, S-28: rows of schema with the file's name; blank lines are no rows, bad ones have _corrupt_record."""
    read = spark.read.schema(f"{schema}, {BAD} string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BAD).option("recursiveFileLookup", recursive)
    return read.json(path).select("*", F.col(FILE).alias("file_name"))


def good_and_bad(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """S-01, S-22, S-29: rows that parsed, and those that didn't."""
    return df.where(F.col(BAD).isNull()).drop(BAD), df.where(F.col(BAD).isNotNull())


def theses(df: DataFrame, sources: list[str], default: str = "proquest_papers") -> DataFrame:
    """S-02: rows of known sources, or with id and text; the label stands in for a missing source."""
    return df.where(F.lower("source").isin([s.lower() for s in sources]) | (F.col("text").isNotNull() & F.col("id").isNotNull())).withColumn("source", F.coalesce("source", "label", F.lit(default)))


def json_files(spark: SparkSession, path: str, schema: str, recursive: bool = False) -> DataFrame:
    """S-04: files that are one object or list each."""
    return spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", recursive).json(path).select("*", F.col(FILE).alias("file_name"))


def file_range(df: DataFrame, first: int, last: int) -> DataFrame:
    """S-05: rows of the first-th to last-th file by path, from 1. Files are numbered in a table of their own."""
    files = df.select(F.col("file_name")).distinct()
    picked = files.withColumn("at", F.row_number().over(Window.orderBy("file_name"))).where(F.col("at").between(first, last)).drop("at")
    return df.join(picked, "file_name", "left_semi")


def allowed_files(df: DataFrame, names: DataFrame) -> DataFrame:
    """S-06, S-07, J-04: rows of the files in a list (name)."""
    return df.join(names.select(F.col("name").alias("file_name")).distinct(), "file_name", "left_semi")


def whole_texts(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """S-08: path and text of each file."""
    return spark.read.option("recursiveFileLookup", recursive).text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """P-25."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"), "length")


#: Header dialects of triples: canonical name to the names a file may use.
TRIPLES = {"head": ["subject", "source", "head"], "relation": ["relation", "relationship", "predicate"], "tail": ["object", "target", "tail"], "head_type": ["subject_type", "source type", "head_type"], "tail_type": ["object_type", "target type", "tail_type"]}


def triples(spark: SparkSession, path: str, limit: int | None = None, encoding: str = "UTF-8") -> DataFrame:
    """S-11 to S-15: triples of either header dialect; a file that isn't UTF-8 is read as Latin-1."""
    read = lambda e: spark.read.option("header", True).option("encoding", e).csv(path)
    df = read(encoding)
    if df.where(F.exists(F.array(*[F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in df.columns]), lambda v: v.contains("�"))).limit(1).count():
        df = read("ISO-8859-1")
    names = {c.strip().lower(): c for c in df.columns}
    # the second dialect calls the head "source", which the first uses for a citation
    second = "target" in names
    pick = lambda options: next((names[o] for o in options if o in names and not (o == "source" and not second)), None)
    out = df.select(*[(F.trim(F.col(f"`{c}`")) if (c := pick(options)) else F.lit(None).cast("string")).alias(k) for k, options in TRIPLES.items()]).where("head is not null and tail is not null")
    return out.limit(limit) if limit else out


def with_header(df: DataFrame, kind: str = "dataset") -> tuple[DataFrame, DataFrame]:
    """S-21, S-23: of text rows (file_name, line, value) the header records, and question rows with what else they hold."""
    is_head = (F.col("line") == 1) & (F.get_json_object("value", "$.__type__") == kind)
    heads = df.where(is_head).select("file_name", F.get_json_object("value", "$.name").alias("name"))
    ok = df.where(~F.coalesce(is_head, F.lit(False)) & F.get_json_object("value", "$.question").isNotNull())
    extra = F.map_filter(F.from_json("value", "map<string,string>"), lambda k, v: ~k.isin("question", "answer"))
    return heads, ok.select("file_name", "line", F.get_json_object("value", "$.question").alias("question"), F.get_json_object("value", "$.answer").alias("answer"), extra.alias("extra"))


TRUE, FALSE = ["true", "1", "yes", "y", "是", "已验证"], ["false", "0", "no", "n", "否", "未验证", ""]


def seed_questions(df: DataFrame, required: list[str], date: str, flag: str) -> DataFrame:
    """S-24: the date of either format, the flag of any synonym, and what is wrong with a row."""
    from curato.functions.values import parse_date

    low = F.lower(F.trim(F.coalesce(flag, F.lit(""))))
    made = df.withColumn("on_date", parse_date(date)).withColumn("verified", F.when(low.isin(TRUE), True).when(low.isin(FALSE), False))
    errors = [F.when(F.coalesce(F.trim(c), F.lit("")) == "", F.lit(f"missing:{c}")) for c in required]
    errors += [F.when((F.coalesce(F.trim(date), F.lit("")) != "") & F.col("on_date").isNull(), F.lit("bad:date")), F.when(F.col("verified").isNull(), F.lit("bad:flag"))]
    return made.withColumn("errors", F.array_compact(F.array(*errors)))


def id_of_cell(cell: Column) -> tuple[Column, Column]:
    """S-18: the id in a cell, which is a file's name without its ending, and the relative path if the cell is one."""
    text = F.replace(F.trim(cell), F.lit("\\"), F.lit("/"))
    name = F.element_at(F.split(text, "/"), -1)
    ident = F.when(name.contains("."), F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(name)
    return F.nullif(ident, F.lit("")), F.when(text.contains("/"), F.regexp_replace(text, "^/+", ""))


def id_list(df: DataFrame, cell: str, other: str, order: str) -> DataFrame:
    """S-17, S-18: id, rel_path, alt_id, alt_rel_path of rows that name a document in either column: the first column's id, with
    the other's as alternative if it differs. Of rows with one id and alternative the first by order stays."""
    (a, ra), (b, rb) = id_of_cell(F.col(cell)), id_of_cell(F.col(other))
    both = F.coalesce(a != b, F.lit(False))
    rows = df.select(F.col(order).alias("row"), F.coalesce(a, b).alias("id"), F.when(a.isNotNull(), ra).otherwise(rb).alias("rel_path"), F.when(both, b).alias("alt_id"), F.when(both, rb).alias("alt_rel_path")).where("id is not null")
    return rows.groupBy("id", "alt_id").agg(*[F.min_by(c, "row").alias(c) for c in ("rel_path", "alt_rel_path")], F.min("row").alias("row"))


def keyword_table(df: DataFrame, label: str, keywords: str) -> DataFrame:
    """S-19, S-31: one row a keyword of a comma-separated list."""
    return df.select(F.trim(label).alias("label"), F.explode(F.split(keywords, "[,，;；、]")).alias("w")).select(F.lower(F.trim("w")).alias("word"), "label").where("word != ''").distinct()


def ratios(text: str) -> dict[str, float]:
    """S-20: 'name: number' lines of a small configuration file, normalised to sum to 1."""
    got = {m[1].strip(): float(m[2]) for m in re.finditer(r"(?m)^\s*([^#:\n]+):\s*([0-9.]+)\s*$", text)}
    total = sum(got.values())
    return {k: v / total for k, v in got.items()} if total else got


def articles(spark: SparkSession, path: str) -> DataFrame:
    """S-32: id, title and abstract of XML article records."""
    schema = "MedlineCitation struct<PMID:string,Article:struct<ArticleTitle:string,Abstract:struct<AbstractText:string>>>"
    read = spark.read.schema(schema).option("rowTag", "PubmedArticle").format("xml").load(path)
    return read.select(F.col("MedlineCitation.PMID").alias("id"), F.col("MedlineCitation.Article.ArticleTitle").alias("title"), F.col("MedlineCitation.Article.Abstract.AbstractText").alias("abstract"))


def allow_list(stats: DataFrame, counts: str, k: int | None = None) -> DataFrame:
    """S-33: names of a map of counts, the k largest if asked."""
    rows = stats.select(F.explode(counts).alias("name", "n")).orderBy(F.desc("n"), "name")
    return (rows.limit(k) if k else rows).select("name")


class SheetSource(DataSource):
    """S-16 to S-19: rows of all sheets of .xlsx files as (file, sheet, row, cells), read from their XML without other packages.

    Option path: files, parted by semicolons, in any store that Arrow reads; each file is a partition. Cells are placed by
    their column letters, so an empty one is null and keeps those behind it in their columns.
    """

    @classmethod
    def name(cls) -> str:
        return "sheet"

    def schema(self) -> str:
        return "file string, sheet int, row int, cells array<string>"

    def reader(self, schema) -> DataSourceReader:
        return SheetReader([p for p in self.options["path"].split(";") if p])


class SheetReader(DataSourceReader):
    def __init__(self, paths: list[str]):
        self.paths = paths

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in self.paths]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(partition.value)
        tag = lambda e: e.tag.rsplit("}", 1)[-1]
        with store.open_input_file(path) as raw, zipfile.ZipFile(raw) as z:
            shared = []
            if "xl/sharedStrings.xml" in z.namelist():
                shared = ["".join(t.text or "" for t in si.iter() if tag(t) == "t") for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")) if tag(si) == "si"]
            sheets = sorted((int(m[1]), n) for n in z.namelist() if (m := re.fullmatch(r"xl/worksheets/sheet(\d+)\.xml", n)))
            for number, name in sheets:
                with z.open(name) as xml:
                    at = 0
                    for _, row in ElementTree.iterparse(xml):
                        if tag(row) != "row":
                            continue
                        cells: list[str | None] = []
                        for c in (c for c in row if tag(c) == "c"):
                            letters = re.match(r"[A-Z]*", c.get("r", ""))[0]
                            place = sum((ord(x) - 64) * 26**i for i, x in enumerate(reversed(letters))) - 1 if letters else len(cells)
                            cells += [None] * (place - len(cells))
                            if c.get("t") == "inlineStr":
                                cells.append("".join(t.text or "" for t in c.iter() if tag(t) == "t"))
                            else:
                                value = next((v.text for v in c if tag(v) == "v"), None)
                                cells.append(shared[int(value)] if c.get("t") == "s" and value is not None else value)
                        yield partition.value, number, at, cells
                        at += 1
                        row.clear()


def sheets(spark: SparkSession, files: list[str]) -> DataFrame:
    spark.dataSource.register(SheetSource)
    return spark.read.format("sheet").option("path", ";".join(files)).load()


#: What a heading of a column holds in small letters, the last column that fits counts.
QUESTION_HEADS, SUB_HEADS, CATEGORY_HEADS = ["问题", "question"], ["sub_category", "sub-category", "子类别", "子分类", "亚类"], ["category", "类别", "分类", "类型"]


def sheet_questions(rows: DataFrame) -> DataFrame:
    """S-16: question, category, sub_category, file, sheet, row (from 1) of sheets with a column of questions, by fuzzy headings;
    questions of three characters or less are left out, a missing category is empty."""
    holds = lambda c, words: F.lower(c).rlike("|".join(words))
    kind = lambda c: F.when(holds(c, QUESTION_HEADS), "q").when(holds(c, SUB_HEADS), "s").when(holds(c, CATEGORY_HEADS), "c").otherwise("")
    kinds = F.transform("cells", lambda c: F.coalesce(kind(c), F.lit("")))
    last = lambda k: F.coalesce(F.array_max(F.transform(kinds, lambda x, i: F.when(x == k, i + 1))), F.lit(0))
    heads = rows.where("row = 0").select("file", "sheet", last("q").alias("q"), last("c").alias("c"), last("s").alias("s")).where("q > 0")
    cell = lambda at: F.trim(F.coalesce(F.when((F.col(at) > 0) & (F.col(at) <= F.size("cells")), F.element_at("cells", F.greatest(F.col(at), F.lit(1)))), F.lit("")))
    told = rows.where("row > 0").join(heads, ["file", "sheet"]).select(cell("q").alias("question"), cell("c").alias("category"), cell("s").alias("sub_category"), "file", "sheet", "row")
    return told.where("length(question) > 3")
