"""Scalar functions over dates, JSON, arrays and tagged values. Python is used where text must be repaired or a tokenizer asked."""

from __future__ import annotations

import hashlib
import hmac
import json
import os
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curato.functions.text import C, col, strip


def parse_date(c: C) -> Column:
    """P-50: yyyyMMdd or yyyy-MM-dd; null else."""
    return F.coalesce(F.try_to_date(col(c), "yyyyMMdd"), F.try_to_date(col(c), "yyyy-MM-dd"))


def published(year: C, month: C, day: C) -> Column:
    """P-51: the parts that are known."""
    return F.concat_ws("-", *[col(x).cast("string") for x in (year, month, day)])


def rate(n: Column, start: Column, end: Column) -> Column:
    """P-53: n a second; null for no time."""
    return n / F.nullif(F.timestamp_diff("MICROSECOND", start, end) / 1e6, F.lit(0))


def epoch_ms(c: C) -> Column:
    """Milliseconds since 1970 of a time without zone, read as UTC."""
    return F.timestamp_diff("MILLISECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), col(c))


@F.pandas_udf(T.StringType())
def without_nulls(s: pd.Series) -> pd.Series:
    """P-61: JSON without nulls, at any depth; text that is no JSON is null."""

    def bare(x):
        if isinstance(x, dict):
            return {k: bare(y) for k, y in x.items() if y is not None}
        return [bare(y) for y in x if y is not None] if isinstance(x, list) else x

    def one(t):
        try:
            return None if t is None else json.dumps(bare(json.loads(t)), separators=(",", ":"), ensure_ascii=False)
        except ValueError:
            return None

    return s.map(one)


def record_text(c: C, paths: list[str]) -> Column:
    """P-62: the first path that has text; a list of texts is joined by line breaks."""
    one = lambda p: F.coalesce(F.array_join(F.from_json(F.get_json_object(col(c), p), "array<string>"), "\n"), F.get_json_object(col(c), p))
    return F.coalesce(*[F.nullif(strip(F.when(F.get_json_object(col(c), p).startswith("["), one(p)).otherwise(F.get_json_object(col(c), p))), F.lit("")) for p in paths])


def reasoning_text(c: C) -> Column:
    """P-43: the reasoning of a reply, in any of its shapes."""
    joined = lambda p: F.array_join(F.from_json(F.get_json_object(col(c), p), "array<string>"), " ")
    return F.coalesce(F.get_json_object(col(c), "$.reasoning.content"), F.nullif(joined("$.reasoning_content"), F.lit("")), F.get_json_object(col(c), "$.reasoning_content"), F.get_json_object(col(c), "$.reasoning"))


def first_filled(arrays: list[tuple[str, Column]]) -> Column:
    """P-63: the name of the first array with elements."""
    out = F.lit(None).cast("string")
    for name, a in reversed(arrays):
        out = F.when(F.size(a) > 0, F.lit(name)).otherwise(out)
    return out


def closed(text: str) -> str:
    """Text with the quotes, brackets and braces closed that it leaves open, and no comma before them."""
    stack, quoted, escaped = [], False, False
    for ch in text:
        if escaped:
            escaped = False
        elif quoted:
            escaped, quoted = ch == "\\", ch != '"'
        elif ch == '"':
            quoted = True
        elif ch in "{[":
            stack.append("}" if ch == "{" else "]")
        elif ch in "}]" and stack:
            stack.pop()
    text = (text + '"' if quoted else text).rstrip().rstrip(",:")
    return text + "".join(reversed(stack))


def best_json(text: str | None) -> str | None:
    """The first JSON object or array of a text: inside fences, as a balanced span, or cut short and closed."""
    if text is None:
        return None
    fenced = re.findall(r"```(?:json)?\s*(.*?)```", text, re.DOTALL)
    for part in [*fenced, text]:
        at = min((i for i in (part.find("{"), part.find("[")) if i >= 0), default=-1)
        if at < 0:
            continue
        try:
            return json.dumps(json.JSONDecoder(strict=False).raw_decode(part[at:])[0], ensure_ascii=False)
        except ValueError:
            pass
        mended = re.sub(r",\s*([}\]])", r"\1", closed(part[at:]))
        try:
            return json.dumps(json.loads(mended, strict=False), ensure_ascii=False)
        except ValueError:
            continue
    return None


@F.pandas_udf(T.StringType())
def find_json(s: pd.Series) -> pd.Series:
    """P-64, P-65."""
    return s.map(best_json)


def json_documents(c: C) -> Column:
    """P-66: documents of a reply, from any of its lists."""
    kind = "array<struct<title:string,text:string,source:string>>"
    return F.coalesce(*[F.from_json(F.get_json_object(col(c), p), kind) for p in ("$.documents", "$.results", "$.data")])


def prefixed(tags: C, prefix: str) -> Column:
    """P-68: what follows the prefix, distinct and in order."""
    return F.array_distinct(F.filter(F.transform(F.filter(col(tags), lambda t: t.startswith(prefix)), lambda t: F.trim(F.substring(t, len(prefix) + 1, 1 << 30))), lambda t: t != ""))


def first_message(role: C, turn: C, text: C, wanted: str) -> Column:
    """P-69: an aggregate; the first text of a role by turn."""
    return F.min_by(F.when(col(role) == wanted, col(text)), F.when(col(role) == wanted, col(turn)))


def simple_value(kind: C, raw: C) -> Column:
    """P-67: the value of a tagged union as text; choices are joined by commas."""
    get = lambda p: F.get_json_object(col(raw), p)
    return F.when(col(kind) == "choice", F.array_join(F.from_json(get("$.choice"), "array<string>"), ",")).when(col(kind) == "score", get("$.score")).when(col(kind) == "category", get("$.category")).when(col(kind) == "binary", get("$.binary")).otherwise(get("$.text"))


def keyed_hashes(c: C, key: str) -> Column:
    """P-24: blake2b and HMAC-SHA256."""

    @F.pandas_udf("blake2b string, hmac string")
    def both(s: pd.Series) -> pd.DataFrame:
        raw = s.map(lambda t: None if t is None else t.encode())
        return pd.DataFrame({"blake2b": raw.map(lambda b: None if b is None else hashlib.blake2b(b).hexdigest()), "hmac": raw.map(lambda b: None if b is None else hmac.new(key.encode(), b, "sha256").hexdigest())})

    return both(col(c))


def model_tokens(c: C, vocabulary: str | None = None) -> Column:
    """P-22: tokens of a tokenizer file (tokenizer.json), else words times 1.3."""
    if vocabulary is None or not os.path.exists(vocabulary):
        from curato.functions.text import tokens_by_words

        return tokens_by_words(c)

    @F.pandas_udf("int")
    def count(s: pd.Series) -> pd.Series:
        from tokenizers import Tokenizer

        made = Tokenizer.from_file(vocabulary)
        return pd.Series([len(e.ids) for e in made.encode_batch(s.fillna("").tolist())])

    return count(col(c))


QA_ITEMS = "array<struct<question:string,answer:string,species:string,type:string,difficulty:string>>"


def qa_items(reply: C) -> Column:
    """P-75, P-76, Q-06, T-11, T-12: questions of a model's reply, whatever stands around its JSON; items without a question go."""
    found = find_json(col(reply))
    items = F.coalesce(F.from_json(found, QA_ITEMS), F.from_json(F.get_json_object(found, "$.questions"), QA_ITEMS), F.array(F.from_json(found, QA_ITEMS.removeprefix("array<")[:-1])))
    return F.filter(items, lambda x: F.coalesce(F.trim(x["question"]), F.lit("")) != "")
