"""Annotation analytics over a results table (item, config, value ...), a configs table and links, as group-bys.

None of these looks at rows on the driver; every result follows from one or two aggregations, so they run at any size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def completion(results: DataFrame, configs: DataFrame, items: DataFrame) -> DataFrame:
    """A-01, U-03: one row of totals: items, configs, results, and items with any and with all configs and their rates.

    results(item, config), configs(config), items(item). A config without results empties the intersection.
    """
    per = results.join(configs, "config").groupBy("item").agg(F.countDistinct("config").alias("n"))
    n_configs, n_items = configs.agg(F.countDistinct("config").alias("n_configs")), items.agg(F.countDistinct("item").alias("n_items"))
    seen = per.join(items.select("item").distinct(), "item").groupBy("n").count()
    # one row a number of configs done; totals are single rows, so these joins have one row on a side
    done = n_configs.join(seen, F.lit(True), "left").agg(F.coalesce(F.sum(F.when(F.col("n") > 0, F.col("count"))), F.lit(0)).alias("any_config"), F.coalesce(F.sum(F.when(F.col("n") == F.col("n_configs"), F.col("count"))), F.lit(0)).alias("all_configs"), F.first("n_configs").alias("n_configs"))
    share = lambda c: F.coalesce(F.col(c) / F.nullif("n_items", F.lit(0)), F.lit(0.0))
    return n_items.join(done, F.lit(True)).select("n_items", "n_configs", "any_config", "all_configs", share("any_config").alias("union_rate"), share("all_configs").alias("intersection_rate"))


def coverage(results: DataFrame, items: DataFrame) -> DataFrame:
    """A-01, A-11: results and distinct items of each config, and their share of all items."""
    n = items.agg(F.countDistinct("item").alias("n_items"))
    return results.groupBy("config").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("item").alias("covered")).join(n, F.lit(True)).select("config", "n", "covered", (F.col("covered") / F.col("n_items")).alias("coverage"))


def score_stats(results: DataFrame, value: str) -> DataFrame:
    """A-02: count, valid, mean, least, most of each config."""
    return results.groupBy("config").agg(F.count(F.lit(1)).alias("n"), F.count(value).alias("n_valid"), F.avg(value).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most"))


def distribution(results: DataFrame, value: str | Column, name: str = "value") -> DataFrame:
    """A-02 to A-04, A-32: how often each value of a config occurs, its share and whether it is the mode."""
    value = F.col(value) if isinstance(value, str) else value
    counts = results.groupBy("config", value.alias(name)).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("config")
    top = F.row_number().over(w.orderBy(F.desc("n"), F.col(name).asc_nulls_last()))
    return counts.select("config", name, "n", (F.col("n") / F.sum("n").over(w)).alias("share"), (top == 1).alias("is_mode"))


def choices(results: DataFrame, options: str) -> DataFrame:
    """A-03: how often each option of an array occurs."""
    return results.select("config", F.explode(options).alias("option")).groupBy("config", "option").agg(F.count(F.lit(1)).alias("n"))


def binary_stats(results: DataFrame, value: str) -> DataFrame:
    """A-05: true, false and the share of true among all rows and among those that aren't null."""
    return results.groupBy("config").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(value)).alias("n_true"), F.count_if(~F.col(value)).alias("n_false"), (F.count_if(F.col(value)) / F.count(F.lit(1))).alias("true_ratio"), (F.count_if(F.col(value)) / F.nullif(F.count(value), F.lit(0))).alias("valid_ratio"))


def text_stats(df: DataFrame, by: str, text: str) -> DataFrame:
    """A-06: characters and words."""
    words = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.avg(F.length(text)).alias("mean_chars"), F.max(F.length(text)).alias("max_chars"), F.min(F.length(text)).alias("min_chars"), F.avg(words).alias("mean_words"))


def progress(results: DataFrame, required: DataFrame, items: DataFrame) -> DataFrame:
    """A-08, A-09, F-26: of each dataset, its items, those with every required config, and their share.

    items(dataset, item), results(item, config), required(dataset, config). A dataset without required configs is done
    where an item has any result.
    """
    need = required.groupBy("dataset").agg(F.countDistinct("config").alias("need"))
    have = items.join(results, "item").join(required.withColumn("req", F.lit(1)), ["dataset", "config"], "left").groupBy("dataset", "item").agg(F.countDistinct(F.when(F.col("req") == 1, F.col("config"))).alias("have"))
    full = have.join(need, "dataset", "left").where(F.col("have") >= F.coalesce("need", F.lit(0))).groupBy("dataset").agg(F.count(F.lit(1)).alias("done"))
    total = items.groupBy("dataset").agg(F.countDistinct("item").alias("n_items"))
    return total.join(full, "dataset", "left").select("dataset", "n_items", F.coalesce("done", F.lit(0)).alias("done"), (F.coalesce("done", F.lit(0)) / F.col("n_items")).alias("progress"))


def grouped_list(df: DataFrame, group: str, order: str, item: str) -> DataFrame:
    """A-12: ordered items of each group."""
    return df.groupBy(group).agg(F.array_sort(F.collect_set(F.struct(order, item))).alias("s")).select(group, F.transform("s", lambda s: s[item]).alias("items"))


def notes(df: DataFrame, by: str, note: str) -> DataFrame:
    """A-07: notes and how many."""
    return df.where(F.coalesce(F.trim(note), F.lit("")) != "").groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_set(note)).alias("notes"))


def quality_stats(df: DataFrame, score: str) -> DataFrame:
    """A-15: mean, most, least, four grades and the share that passes, of scores to 100."""
    s = F.col(score)
    return df.agg(F.count(F.lit(1)).alias("n"), F.bround(F.avg(s), 2).alias("mean"), F.max(s).alias("most"), F.min(s).alias("least"), F.count_if(s >= 90).alias("excellent"), F.count_if((s >= 75) & (s < 90)).alias("good"), F.count_if((s >= 60) & (s < 75)).alias("acceptable"), F.count_if(s < 60).alias("poor"), F.bround(F.count_if(s >= 60) / F.nullif(F.count(s), F.lit(0)) * 100, 2).alias("pass_rate"))


def verification_report(df: DataFrame, total: str, passes: Column) -> DataFrame:
    """A-16: the share that passes over all rows, means over rows with a total above 0."""
    valid = F.col(total) > 0
    return df.agg(F.count(F.lit(1)).alias("n"), F.count_if(valid).alias("n_valid"), (F.count_if(passes) / F.count(F.lit(1))).alias("passing_rate"), F.avg(F.when(valid, F.col(total))).alias("mean_total"), F.count_if(passes).alias("passing"), (F.count(F.lit(1)) - F.count_if(passes)).alias("failing"))


def diversity(df: DataFrame, method: str, category: str, seed: str, question: str, n_methods: int) -> DataFrame:
    """A-17: distinct methods, categories and seeds, lengths, and the weighted score."""
    made = df.agg(F.count(F.lit(1)).alias("n"), F.countDistinct(method).alias("methods"), F.countDistinct(category).alias("categories"), F.countDistinct(seed).alias("seeds"), F.avg(F.length(question)).alias("mean_chars"))
    score = (F.col("methods") / n_methods * 0.4 + F.col("categories") / F.greatest("seeds", F.lit(1)) * 0.3 + F.col("seeds") / F.greatest("n", F.lit(1)) * 0.3) * 100
    return made.withColumn("score", F.bround(F.when(F.col("n") > 0, score).otherwise(0.0), 2))


def two_level(df: DataFrame, outer: str, inner: str) -> DataFrame:
    """A-18, A-29: counts of both levels, and totals, by rollup."""
    return df.rollup(outer, inner).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("level"))


def length_buckets(df: DataFrame, n: str, cuts: tuple[int, int] = (1000, 3000)) -> DataFrame:
    """A-19."""
    c = F.col(n)
    return df.agg(F.count(F.lit(1)).alias("n"), F.avg(c).alias("mean"), F.max(c).alias("most"), F.min(c).alias("least"), F.count_if(c < cuts[0]).alias("short"), F.count_if((c >= cuts[0]) & (c < cuts[1])).alias("medium"), F.count_if(c >= cuts[1]).alias("long"))


def funnel(df: DataFrame, reason: str) -> DataFrame:
    """A-20, A-21, F-12, Q-10: rows by the reason that rejects them; null is kept. Counts sum to the rows before."""
    return df.groupBy(F.coalesce(F.col(reason), F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def log_totals(df: DataFrame, ok: Column, tokens: str, seconds: str) -> DataFrame:
    """A-22, A-23, A-35: rows, successes, tokens, and rates that are null for nothing."""
    return df.agg(F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("n_ok"), F.sum(tokens).alias("tokens"), F.avg(seconds).alias("mean_seconds"), (F.count_if(ok) / F.nullif(F.count(F.lit(1)), F.lit(0))).alias("success_rate"))


def tag_rate(df: DataFrame, tags: str, tag: str) -> DataFrame:
    """A-25."""
    return df.agg(F.avg(F.array_contains(tags, tag).cast("double")).alias("rate"))


def top_words(df: DataFrame, text: str, stop: tuple[str, ...], k: int = 5) -> DataFrame:
    """A-28: the k commonest words; ties by the word."""
    words = df.select(F.explode(F.split(text, r"[\s，。！？、；：]+")).alias("word")).where((F.length("word") > 1) & ~F.lower("word").isin(*stop))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "word").limit(k)


def null_counts(df: DataFrame) -> DataFrame:
    """A-30: rows and nulls of each column, one row a column."""
    one = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(F.col(c).isNull()).alias(f"n_{i}") for i, c in enumerate(df.columns)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col("rows"), F.col(f"n_{i}").alias("nulls")) for i, c in enumerate(df.columns)])).alias("s")).select("s.*")


def nested_export(results: DataFrame, items: DataFrame, configs: DataFrame) -> DataFrame:
    """J-07, K-11: items with their results as an ordered array of structs; results of unknown configs are left out."""
    told = results.join(configs, "config").groupBy("item").agg(F.array_sort(F.collect_list(F.struct("config", "value"))).alias("annotations"))
    return items.join(told, "item")
