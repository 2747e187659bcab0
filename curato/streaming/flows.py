"""Structured Streaming: the same operators kept up to date as rows come, with watermarks, state and resume by checkpoint."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from curato.session import shared_folder


def read_files(spark: SparkSession, path: str, schema: str, kind: str = "parquet", files: int = 100) -> DataFrame:
    """R-01, S-14: new files of a folder; what is done is in the query's checkpoint."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).format(kind).load(path)


def windowed(df: DataFrame, ts: str, late: str, size: str, slide: str | None, *by: str) -> DataFrame:
    """R-09, R-10: counts and means of value by tumbling or sliding window and group."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    return df.withWatermark(ts, late).groupBy(w.alias("w"), *by).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n", "mean")


def sessions(df: DataFrame, ts: str, late: str, gap: str, by: str) -> DataFrame:
    """R-10: sessions of a group that end after a gap."""
    return df.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n")


def first_only(df: DataFrame, ts: str, late: str, *keys: str) -> DataFrame:
    """R-07, D-07: the first row of each key; keys are forgotten once the watermark has passed them."""
    return df.withWatermark(ts, late).dropDuplicatesWithinWatermark(list(keys))


def usage(df: DataFrame, by: str, ok: str, keep: float = 0.9, start: float = 0.5) -> DataFrame:
    """W-05, W-06, A-73: rows seen and the exponential mean of successes of each group, as state."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, mean = state.get if state.exists else (0, start)
        for b in batches:
            for x in b[ok]:
                n, mean = n + 1, mean * keep + float(x) * (1 - keep)
        state.update((n, mean))
        yield pd.DataFrame({by: [key[0]], "n": [n], "mean": [mean]})

    kind = dict(df.dtypes)[by]
    return df.groupBy(by).applyInPandasWithState(fold, f"{by} {kind}, n long, mean double", "n long, mean double", "update", GroupStateTimeout.NoTimeout)


class KeepFirst(StatefulProcessor):
    """The items of one scope that are kept, as state: their vectors in a list, their texts in a map."""

    def __init__(self, least: float, live: int):
        self.least, self.live = least, live

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getListState("kept", "id long, at long, v array<double>")
        self.seen = handle.getMapState("seen", "text string", "id long, at long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = pd.concat(rows)
        micros = new["at"].astype("datetime64[us]").astype("int64").to_numpy()
        order = np.lexsort((new["id"].to_numpy(), micros))
        held = [tuple(x) for x in self.kept.get()] if self.kept.exists() else []
        ids, ats = [x[0] for x in held], [x[1] for x in held]
        width = next((len(v) for v in [*(x[2] for x in held), *new["v"]] if v is not None and len(v)), 1)
        # unit vectors of what is kept, in an array that doubles
        room = np.zeros((max(16, 2 * len(held)), width))
        for i, x in enumerate(held):
            room[i] = x[2]
        told = []
        for i in order:
            at, row = int(micros[i]), new.iloc[int(i)]
            like, how = None, "kept"
            if row["text"] is not None and self.seen.containsKey((row["text"],)):
                first = self.seen.getValue((row["text"],))
                if first[1] >= at - self.live:
                    like, how = first[0], "same"
            unit = np.zeros(width)
            if row["v"] is not None and len(row["v"]) == width and (norm := np.linalg.norm(row["v"])) > 0:
                unit = np.asarray(row["v"], float) / norm
            if like is None and ids:
                score = room[: len(ids)] @ unit
                alike = np.flatnonzero((score >= self.least) & (np.asarray(ats) >= at - self.live))
                if len(alike) and unit.any():
                    like, how = ids[alike[0]], "alike"
            if like is None:
                if row["text"] is not None:
                    self.seen.updateValue((row["text"],), (int(row["id"]), at))
                if len(ids) == len(room):
                    room = np.vstack([room, np.zeros_like(room)])
                room[len(ids)] = unit
                ids.append(int(row["id"]))
                ats.append(at)
            told.append((*key, row["id"], row["at"], how, like))
        newest = max(int(micros.max()), max(ats, default=0))
        live = [i for i, at in enumerate(ats) if at >= newest - self.live]
        self.kept.put([(ids[i], ats[i], room[i].tolist()) for i in live]) if live else self.kept.clear()
        for text, (_, at) in list(self.seen.iterator()) if self.seen.exists() else []:
            if at < newest - self.live:
                self.seen.removeKey(text)
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer((newest + self.live) // 1000 + 1)
        out = pd.DataFrame(told, columns=["scope", "id", "at", "how", "like"])
        yield out.astype({"like": "Int64"})

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.kept.clear()
        self.seen.clear()
        yield pd.DataFrame({"scope": [], "id": [], "at": [], "how": [], "like": []})

    def close(self) -> None:
        pass


def keep_first(df: DataFrame, late: str, least: float, live_seconds: int) -> DataFrame:
    """R-07, D-06: of a stream (scope, id, at, text, v), what is kept, as a decision for each row: scope, id, at, how, like.

    In order of at and id inside a micro-batch, and of micro-batches, a row is dropped if a row of its scope that was kept at most
    live_seconds before has the same text (how same) or a vector of cosine at least `least` (alike); like is that row. Null texts
    equal nothing, and null, zero and vectors of another length are alike to nothing. Rows behind the watermark are left out by
    Spark. What is older than live_seconds leaves the state with the scope's next rows, or when the watermark passes it.

    State is kept in RocksDB, which this sets for the session. A task holds the vectors of one scope that are still alive, and
    its new rows: choose scopes and life so that they fit.
    """
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    kind = dict(df.dtypes)["scope"]
    rows = df.withWatermark("at", late).groupBy("scope")
    return rows.transformWithStateInPandas(KeepFirst(least, live_seconds * 1_000_000), f"scope {kind}, id long, at timestamp, how string, like long", "append", "eventtime", eventTimeColumnName="at")


def run(df: DataFrame, path: str, checkpoint: str, mode: str = "append", kind: str = "parquet") -> StreamingQuery:
    """K-02, R-01: all that is there now, and what came since the last run, once."""
    return df.writeStream.format(kind).option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()


def each_batch(df: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "update") -> StreamingQuery:
    """K-03, R-03, R-04: work on each micro-batch, whose number makes it safe to repeat."""
    return df.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()


def progress(log: DataFrame) -> DataFrame:
    """R-03: file, state, error, at of a log of events (file, state, error, at): once completed a file stays so, else its last failure counts."""
    done = F.max(F.when(F.col("state") == "completed", F.col("at")))
    last = F.max_by(F.struct("state", "error", "at"), F.struct("at", "error"))
    told = log.groupBy("file").agg(done.alias("done"), last.alias("last"))
    return told.select("file", F.when(F.col("done").isNotNull(), "completed").otherwise(F.col("last.state")).alias("state"), F.when(F.col("done").isNull(), F.col("last.error")).alias("error"), F.coalesce("done", "last.at").alias("at"))


def pending(files: DataFrame, log: DataFrame) -> DataFrame:
    """R-01, R-03: files (file) that no event of the log has completed."""
    return files.join(log.where("state = 'completed'").select("file").distinct(), "file", "left_anti")


def until_quota(df: DataFrame, order: str, cost: str, quota: float, start: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """R-04: rows from the start (one row, last_file) on whose costs together, by order, stay within the quota; and the state to go on
    from (last_file): the first row that didn't fit, or none.

    Costs before a row are sums of whole ranges of the order, found first, and a running sum inside its range, so no task sees all rows.
    """
    if start is not None:
        df = df.join(F.broadcast(start.select("last_file").limit(1)), F.col(order) >= F.col("last_file")).drop("last_file")
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(n, order).withColumn("__part", F.spark_partition_id())
    path = f"{shared_folder(df.sparkSession)}/quota-{uuid.uuid4().hex}"
    dealt.write.parquet(path)
    dealt = df.sparkSession.read.schema(dealt.schema).parquet(path)
    # as many rows as partitions
    sums = dealt.groupBy("__part").agg(F.sum(cost).alias("__sum"))
    before = sums.withColumn("__before", F.coalesce(F.sum("__sum").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__sum")
    inside = F.sum(cost).over(Window.partitionBy("__part").orderBy(order))
    ran = dealt.join(F.broadcast(before), "__part").withColumn("__total", F.col("__before") + inside)
    fits = ran.where(F.col("__total") <= quota).drop("__part", "__before", "__total")
    return fits, ran.where(F.col("__total") > quota).agg(F.min(order).alias("last_file")).where("last_file is not null")


def cache_key(query: Column, k: Column, sources: Column) -> Column:
    """R-05."""
    return F.md5(F.concat_ws(":", query, k.cast("string"), F.array_join(F.array_sort(sources), ",")))


class Services:
    """X-01, X-02, X-03: named functions from text to text that rows can call, a batch at a time, with retries.

    A function takes a list of prompts and returns a list of replies; the built-in "echo" serves tests without a network.
    """

    def __init__(self):
        self.known: dict[str, Callable[[list[str]], list[str]]] = {"echo": lambda prompts: [f"echo: {p}" for p in prompts]}

    def register(self, name: str, call: Callable[[list[str]], list[str]]) -> None:
        self.known[name] = call

    def ask(self, df: DataFrame, name: str, prompt: str, reply: str = "reply", tries: int = 3) -> DataFrame:
        from pyspark.sql import types as T

        call = self.known[name]

        @F.pandas_udf(T.StringType())
        def answer(s: pd.Series) -> pd.Series:
            for left in reversed(range(tries)):
                try:
                    return pd.Series(call(s.fillna("").tolist()), index=s.index)
                except OSError:
                    if not left:
                        raise
            return s

        return df.withColumn(reply, answer(prompt))
