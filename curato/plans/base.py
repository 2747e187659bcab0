"""How queries are told: a DataFrame plan over a folder of tables, and the SQL that says what it returns."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curato.session import ready

Plan = Callable[[SparkSession, str], DataFrame]


@dataclass
class Catalog:
    """Queries by name, in the order they were told."""

    plans: dict[str, Plan] = field(default_factory=dict)
    sql: dict[str, str] = field(default_factory=dict)

    def query(self, name: str, sql: str | None = None) -> Callable[[Callable], Callable]:
        """Registers a function of a Tables as a query; sql may be None where SQL can't express it."""

        def add(plan: Callable[[Tables], DataFrame]) -> Callable:
            self.plans[name] = lambda spark, sf_dir: plan(Tables(ready(spark), sf_dir))
            if sql:
                self.sql[name] = sql
            return plan

        return add


class Tables:
    """Tables of a folder by attribute, read when asked for."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def qa(self) -> DataFrame:
        """Documents as question (up to the first full stop) and answer (what follows)."""
        question, answer = "trim(split_part(text, '.', 1))", "trim(substr(text, length(split_part(text, '.', 1)) + 2))"
        return self.documents.select("doc_id", "lang", "source", "text", F.expr(question).alias("q"), F.expr(answer).alias("a"))


#: The same in SQL.
QA_SQL = "qa AS (SELECT doc_id, lang, source, text, trim(split_part(text, '.', 1)) AS q, trim(substr(text, length(split_part(text, '.', 1)) + 2)) AS a FROM documents)"


def all_replaced(what: str, *steps: tuple[str, str]) -> str:
    """SQL that replaces all matches of each pattern in turn."""
    for pattern, by in steps:
        what = f"regexp_replace({what}, '{pattern}', '{by}', 'g')"
    return what
