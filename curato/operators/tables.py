"""Joins, windows, sets, DML-like rewrites, quotas and samples over any tables."""

from __future__ import annotations

from collections import Counter, deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curato.functions.text import once


def unseen(df: DataFrame, seen: DataFrame, *keys: str) -> DataFrame:
    """J-03, D-11, D-12, R-01, R-02: rows whose keys are not in seen."""
    return df.join(seen.select(*keys).distinct(), list(keys), "left_anti")


def seen_only(df: DataFrame, seen: DataFrame, *keys: str) -> DataFrame:
    """J-04."""
    return df.join(seen.select(*keys).distinct(), list(keys), "left_semi")


def lookup_either(df: DataFrame, table: DataFrame, first: tuple[str, str], second: tuple[str, str], value: str) -> DataFrame:
    """J-05, S-09: value by the first key, else by the second; pairs are (key of df, key of table)."""
    one = table.select(F.col(first[1]).alias("__k1"), F.col(value).alias("__v1")).dropDuplicates(["__k1"])
    two = table.select(F.col(second[1]).alias("__k2"), F.col(value).alias("__v2")).dropDuplicates(["__k2"])
    both = df.join(one, df[first[0]] == F.col("__k1"), "left").join(two, df[second[0]] == F.col("__k2"), "left")
    return both.withColumn(value, F.coalesce("__v1", "__v2")).drop("__k1", "__v1", "__k2", "__v2")


def find_files(df: DataFrame, files: DataFrame, path: str = "path", parts: int = 8) -> DataFrame:
    """S-10: df with the file of files(file) that its path means, and by which rule: exact (the path without blanks at its ends is a
    file), tidied (so it is with / for \\, without ./ and double /), tail (the longest run of two or more last parts in common),
    name (the last part) or stem (the last part without its ending). Of files found alike the first as text; null where none is.
    Letters are compared as they are for exact, else in lower case. Null and blank paths find nothing.

    Every path gives its keys, and of the files of one key only the first stays before the join, so that a name that many folders
    hold is one row and the join is of equal keys, one to one.
    """
    known = files.select("file").where("trim(file) != ''").distinct()
    index = known.select("file", F.explode(_path_keys("file", parts)).alias("k")).groupBy("k").agg(F.min("file").alias("file"))
    asked = df.select(F.col(path).alias("__path")).where("trim(__path) != ''").distinct()
    asked = asked.select("__path", F.explode(_path_keys("__path", parts)).alias("k"))
    best = asked.join(index, "k").groupBy("__path").agg(F.min(F.struct(F.col("k.rule").alias("rule"), (-F.col("k.n")).alias("n"), "file")).alias("b"))
    rules = F.array(*[F.lit(x) for x in ("exact", "tidied", "tail", "name", "stem")])
    told = best.select("__path", F.col("b.file").alias("file"), F.element_at(rules, F.col("b.rule") + 1).alias("rule"))
    return df.join(told, F.col(path) == F.col("__path"), "left").drop("__path")


def _path_keys(c: str, parts: int) -> Column:
    """Structs of rule, number of parts and text."""
    plain = F.trim(F.col(c))
    tidy = F.regexp_replace(F.regexp_replace(F.lower(plain), r"[/\\]+", "/"), r"^(\./)+|(?<=/)(\./)+", "")
    # empty parts of a leading or closing slash are none
    split = F.array_remove(F.split(tidy, "/"), "")
    key = lambda rule, n, text: F.struct(F.lit(rule).alias("rule"), n.cast("int").alias("n"), text.alias("text"))
    last = F.element_at(split, -1)
    tails = F.transform(F.sequence(F.lit(2), F.greatest(F.lit(2), F.least(F.lit(parts), F.size(split)))), lambda n: key(2, n, F.concat_ws("/", F.slice(split, F.greatest(-n, -F.size(split)), n))))
    tails = F.when(F.size(split) >= 2, tails).otherwise(F.filter(tails, lambda _: F.lit(False)))
    some = F.concat(F.array(key(0, F.lit(0), plain), key(1, F.lit(0), tidy)), tails, F.array(key(3, F.lit(0), last), key(4, F.lit(0), F.regexp_replace(last, r"(?<=.)\.[^.]*$", ""))))
    return F.when(F.size(split) > 0, some).otherwise(F.array(key(0, F.lit(0), plain)))


def orphans(child: DataFrame, parent: DataFrame, key: str, parent_key: str) -> DataFrame:
    """J-15, M-06, G-14: rows whose parent is missing."""
    return child.where(F.col(key).isNotNull()).join(parent.select(F.col(parent_key).alias(key)).distinct(), key, "left_anti")


def keep_first(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """W-02, D-02, D-03, D-07, D-08: the first row of each key."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__r = 1").drop("__r")


def keep_last(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """W-11, R-06: the last row of each key."""
    return keep_first(df, keys, [F.desc(order)])


def rank_in(df: DataFrame, by: str, *order: str) -> DataFrame:
    """W-01, J-14: position inside a group, from 0."""
    return numbered_in(df, by, list(order), "rank").withColumn("rank", F.col("rank") - 1)


def fill_down(df: DataFrame, value: str, by: str, order: str) -> DataFrame:
    """W-03, S-25: the last value that is not null, inside a group."""
    return df.withColumn(value, F.last(value, ignorenulls=True).over(Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


def _dealt(df: DataFrame, by: str, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """df dealt to ranges of (group, order), __part, and rows of each group in each range (__n); so a group of most rows is many tasks'."""
    from curato.operators.nearness import stored

    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stored(df.repartitionByRange(n, by, *order).withColumn("__part", F.spark_partition_id()))
    return dealt, dealt.groupBy("__part", by).agg(F.count(F.lit(1)).alias("__n"))


def numbered_in(df: DataFrame, by: str, order: list[str], name: str) -> DataFrame:
    """df with numbers from 1 inside each group, in two steps: rows before a range, and row numbers inside it. Null is a group."""
    dealt, counts = _dealt(df, by, order)
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    told = counts.select(F.col("__part").alias("__p"), F.col(by).alias("__by"), before.alias("__before"))
    inside = F.row_number().over(Window.partitionBy("__part", by).orderBy(*order))
    met = dealt.withColumn("__in", inside).join(told, (F.col("__part") == F.col("__p")) & F.col(by).eqNullSafe(F.col("__by")))
    return met.withColumn(name, F.col("__before") + F.col("__in")).drop("__part", "__p", "__by", "__before", "__in")


def recent_count(df: DataFrame, by: str, order: list[str], rows: int = 1000) -> DataFrame:
    """W-05: rows of the same group among the last so many of it, the row itself included."""
    return numbered_in(df, by, order, "recent").withColumn("recent", F.least("recent", F.lit(rows).cast("long")))


def balanced(strategies: list[str], rows: int = 1000) -> tuple[list[str], int]:
    """L-13: the strategies that a balancer gives one after another, and from which place on they come again in turn.

    Each time it is the one least used among the last so many, of equal ones the first by name. What it gives depends on its last
    rows only, so it goes round in the end: places past the list count on from there.
    """
    names, used, last, out, met = sorted(set(strategies)), Counter(), deque(), [], {}
    while (state := tuple(last)) not in met:
        met[state] = len(out)
        out.append(min(names, key=lambda n: (used[n], n)))
        used[out[-1]] += 1
        last.append(out[-1])
        if len(last) > rows:
            used[last.popleft()] -= 1
    return out, met[state]


def least_used(df: DataFrame, order: list[str], strategies: list[str], rows: int = 1000, name: str = "strategy") -> DataFrame:
    """L-13, W-05: each row, in order, with the strategy that is least used among the last so many rows.

    Rows are numbered over all ranges of the order, and a number tells the strategy; the table of turns follows the strategies and
    the window, not the rows, and is broadcast. Strategies that repeat count once; there must be one.
    """
    turns, again = balanced(strategies, rows)
    told = df.sparkSession.createDataFrame(list(enumerate(turns)), f"__turn long, {name} string")
    at = F.col("__at") - 1
    turn = F.when(at < len(turns), at).otherwise(again + (at - again) % (len(turns) - again))
    return numbered(df, order, "__at").withColumn("__turn", turn).join(F.broadcast(told), "__turn").drop("__turn", "__at")


def smoothed(df: DataFrame, by: str, order: str, value: str, keep: float = 0.9, start: float = 0.5) -> DataFrame:
    """W-06: an exponential mean of each group's values in order: values weigh less by each row that follows.

    A range of a group is summed by the rows that follow inside it, and then weighed once by those in later ranges.
    """
    dealt, counts = _dealt(df, by, [order])
    behind = F.row_number().over(Window.partitionBy("__part", by).orderBy(F.desc(order))) - 1
    sums = dealt.withColumn("__behind", behind).groupBy("__part", by).agg(F.sum(F.col(value).cast("double") * (1 - keep) * F.pow(F.lit(keep), "__behind")).alias("__s"))
    after = F.coalesce(F.sum("__n").over(Window.partitionBy(by).orderBy(F.desc("__part")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    told = counts.select(F.col("__part").alias("__p"), F.col(by).alias("__by"), "__n", after.alias("__after"))
    met = sums.join(told, (F.col("__part") == F.col("__p")) & F.col(by).eqNullSafe(F.col("__by")))
    return met.groupBy(by).agg((F.sum(F.coalesce("__s", F.lit(0.0)) * F.pow(F.lit(keep), "__after")) + start * F.pow(F.lit(keep), F.sum("__n"))).alias("mean"))


def around(words: Column, hit: Column, reach: int = 5) -> Column:
    """W-07: words around each word for which hit holds."""
    return F.transform(F.filter(F.sequence(F.lit(1), F.size(words)), lambda i: hit(F.element_at(words, i.cast("int")))), lambda i: F.slice(words, F.greatest(F.lit(1), i - reach), F.least(i - 1, F.lit(reach)) + reach + 1))


def swap(df: DataFrame, key: str, order: str, a: int, b: int) -> DataFrame:
    """W-10: two rows change places."""
    pair = df.where(F.col(key).isin(a, b)).agg(F.max(F.when(F.col(key) == a, F.col(order))).alias("__a"), F.max(F.when(F.col(key) == b, F.col(order))).alias("__b"))
    return df.join(pair, F.lit(True)).withColumn(order, F.when(F.col(key) == a, F.col("__b")).when(F.col(key) == b, F.col("__a")).otherwise(F.col(order))).drop("__a", "__b")


def page(df: DataFrame, order: list[Column], skip: int, limit: int) -> DataFrame:
    """L-01, L-19: a page of an ordered list; the order must tell all rows apart."""
    return df.orderBy(*order).offset(skip).limit(limit)


def newest(df: DataFrame, by: str, order: list[Column], n: int) -> DataFrame:
    """L-02, L-04, L-18: the first n of each group."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("__r") <= n).drop("__r")


def top_counts(df: DataFrame, key: str, k: int) -> DataFrame:
    """L-03, G-21."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), key).limit(k)


def hash_sample(df: DataFrame, key: str, n: int, seed: str) -> DataFrame:
    """L-08, L-09, L-10, S-06: n rows in the order of a seeded hash."""
    return df.orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}"))), key).limit(n)


def quotas(total: int, shares: dict[str, float]) -> dict[str, int]:
    """L-11, L-12, X14: whole parts of total by largest remainder; they sum to total."""
    weight = sum(shares.values())
    exact = {k: total * s / weight for k, s in shares.items()}
    out = {k: int(v) for k, v in exact.items()}
    for k in sorted(shares, key=lambda k: (out[k] - exact[k], list(shares).index(k)))[: total - sum(out.values())]:
        out[k] += 1
    return out


def quota_sample(df: DataFrame, group: str, level: str, order: list[str | Column], most: int, ratio: dict[str, float]) -> DataFrame:
    """L-05, L-06, W-04: up to most rows of each group, by quota of each level; what is short is filled in order."""
    plan = quotas(most, ratio)
    share = F.coalesce(*[F.when(F.col(level) == k, F.lit(n)) for k, n in plan.items()], F.lit(0))
    inside = F.row_number().over(Window.partitionBy(group, level).orderBy(*order))
    marked = df.withColumn("__in", inside).withColumn("__first", (F.col("__in") > share).cast("int"))
    filled = F.row_number().over(Window.partitionBy(group).orderBy("__first", *order))
    return marked.withColumn("__r", filled).where(F.col("__r") <= most).drop("__in", "__first", "__r")


def assign_types(df: DataFrame, key: str, plan: dict[str, int], seed: str) -> DataFrame:
    """L-12: types dealt to rows in hash order, as many of each as planned; rows beyond get none."""
    at, rules = 0, F.lit(None).cast("string")
    edges = []
    for kind, n in plan.items():
        edges.append((kind, at, at + n))
        at += n
    ranked = hash_sample(df, key, at, seed).withColumn("__r", F.row_number().over(Window.orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}"))), key)))
    for kind, lo, hi in reversed(edges):
        rules = F.when((F.col("__r") > lo) & (F.col("__r") <= hi), F.lit(kind)).otherwise(rules)
    return ranked.withColumn("kind", rules).drop("__r")


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """S-23: df with numbers from 1 in an order over all rows: ranges of the order are counted first, then rows inside a range."""
    from curato.operators.nearness import stored

    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stored(df.repartitionByRange(n, *order).withColumn("__part", F.spark_partition_id()))
    # as many rows as partitions
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = dealt.groupBy("__part").agg(F.count(F.lit(1)).alias("__n")).select("__part", before.alias("__before"))
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return dealt.join(F.broadcast(counts), "__part").withColumn(name, F.col("__before") + inside).drop("__part", "__before")


def replace_links(links: DataFrame, wanted: DataFrame, owner: str, *owners: int) -> DataFrame:
    """U-05, M-01: the links of these owners are replaced by those wanted."""
    return links.where(~F.col(owner).isin(*owners)).unionByName(wanted.where(F.col(owner).isin(*owners)))


def upsert(old: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """R-05, R-06, M-01: rows of new, and rows of old that new doesn't have."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new)


def claim(df: DataFrame, key: str, owner: str, me: str, row: int) -> DataFrame:
    """M-02: the row becomes mine if nobody has it; a pure rewrite, not a lock."""
    return df.withColumn(owner, F.when((F.col(key) == row) & F.col(owner).isNull(), F.lit(me)).otherwise(F.col(owner)))


def claim_all(df: DataFrame, key: str, owner: str, requests: DataFrame) -> DataFrame:
    """M-02: many claims at once, as one step: requests(key, who, at). A row that nobody owns goes to its earliest request, of equally
    early ones to the smallest who; owned rows keep their owner, and later requests lose."""
    won = requests.groupBy(F.col(key).alias("__k")).agg(F.min_by("who", F.struct("at", "who")).alias("__who"))
    return df.join(won, df[key] == F.col("__k"), "left").withColumn(owner, F.coalesce(owner, "__who")).drop("__k", "__who")


def release(df: DataFrame, key: str, owner: str, me: str, row: int) -> DataFrame:
    """M-02: a row of mine is free again."""
    return df.withColumn(owner, F.when((F.col(key) == row) & (F.col(owner) == me), F.lit(None)).otherwise(F.col(owner)))


def cascade_delete(child: DataFrame, key: str, gone: DataFrame, parent_key: str) -> DataFrame:
    """M-03: children of deleted parents go."""
    return child.join(gone.select(F.col(parent_key).alias(key)).distinct(), key, "left_anti")


def set_null(child: DataFrame, key: str, gone: DataFrame, parent_key: str) -> DataFrame:
    """M-03: children of deleted parents lose them."""
    marks = gone.select(F.col(parent_key).alias("__k")).distinct().withColumn("__gone", F.lit(True))
    return child.join(marks, child[key] == F.col("__k"), "left").withColumn(key, F.when(F.col("__gone"), F.lit(None)).otherwise(F.col(key))).drop("__k", "__gone")


def keyword_hits(df: DataFrame, key: str, text: str, words: DataFrame) -> DataFrame:
    """J-09, C-13, C-15, S-19: words(word, label) that occur as words of a text: tokens are exploded and joined by hash."""
    tokens = df.select(key, F.explode(F.array_distinct(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"))).alias("word"))
    return tokens.join(words, "word").groupBy(key, "label").agg(F.count(F.lit(1)).alias("hits"))


def in_context(df: DataFrame, key: str, text: str, word: str, around: int) -> DataFrame:
    """W-07: key, i, around: each place of a word among the blank-separated words of a text, and the words on either side.

    Places are found inside the row, so only hits and their own few words are exploded.
    """
    lo = lambda i: F.greatest(F.lit(1), i - around)
    near = lambda w, i: F.array_join(F.slice(w, lo(i), i + around - lo(i) + 1), " ")
    places = lambda w: F.filter(F.sequence(F.lit(1), F.size(w)), lambda i: F.element_at(w, i) == word)
    hits = once(F.split(F.col(text), " "), lambda w: F.transform(places(w), lambda i: F.struct(i.cast("long").alias("i"), near(w, i).alias("around"))))
    return df.select(key, F.explode(hits).alias("h")).select(key, "h.i", "h.around")


def retrieve(queries: DataFrame, docs: DataFrame, k: int = 5) -> DataFrame:
    """J-06, S-26: the k documents that share most of a query's words, weighed by idf; queries(qid, q), docs(did, d).

    An inverted index: tokens of both sides are joined by hash and added up. Only words of some query are kept of a document,
    before they are dealt out; frequent words stay, with their small idf, and what a query's words give a document is added up
    before the shuffle by query and document. Scores are rounded to six decimals and rank as such, because sums of one set of words
    in another order differ in their last bits; of equal scores the smallest did comes first.
    """
    words = lambda df, key, text: df.select(key, F.explode(F.array_distinct(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"))).alias("w")).where("w != ''")
    asked = words(queries, "qid", "q")
    index = words(docs, "did", "d").join(asked.select("w").distinct(), "w", "left_semi")
    n = docs.count()
    idf = index.groupBy("w").agg(F.count(F.lit(1)).alias("df")).select("w", F.log(F.lit(n + 1) / (F.col("df") + 0.5)).alias("idf"))
    score = asked.join(idf, "w").join(index, "w").groupBy("qid", "did").agg(F.round(F.sum("idf"), 6).alias("score"))
    return newest(score, "qid", [F.desc("score"), F.col("did")], k)


def spread(df: DataFrame, models: list[str]) -> DataFrame:
    """J-16: each row for each model."""
    return df.withColumn("model", F.explode(F.array(*[F.lit(m) for m in models])))


def variants(df: DataFrame, n: Column) -> DataFrame:
    """J-17: n numbered variants of each row."""
    return df.withColumn("variant", F.explode(F.when(n > 0, F.sequence(F.lit(1), n.cast("int")))))


def merged_sources(df: DataFrame, key: str, order: str, source: str, *fields: str) -> DataFrame:
    """D-01, A-31: the first row of each key, with the sorted distinct sources of all its rows."""
    return df.groupBy(key).agg(*[F.min_by(c, order).alias(c) for c in fields], F.sort_array(F.collect_set(source)).alias("sources"), F.count(F.lit(1)).alias("copies"))


def capped(df: DataFrame, by: str, flag: str, order: list[str | Column], share: float) -> DataFrame:
    """Q-11: flagged rows up to a share of their group's rows, the first by order; the others all."""
    n = df.groupBy(by).agg(F.count(F.lit(1)).alias("__n"))
    rank = F.row_number().over(Window.partitionBy(by, flag).orderBy(*order))
    return df.withColumn("__r", rank).join(n, by).where(~F.col(flag) | (F.col("__r") <= F.floor(F.col("__n") * share))).drop("__r", "__n")
