"""Tables of pipeline state: what is indexed, extracted, queued; what is to be done next."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RETRY_CAP = 5
INDEXED = ("indexed", "embedded_no_qdrant")
DAILY_CALLS = 490


def status_table(index: DataFrame, graph: DataFrame, queue: DataFrame) -> DataFrame:
    """One row a path of any input, with defaults for what it lacks.

    ``index``: ``path, status, chunks_indexed``; ``graph``: ``path, status,
    objects_extracted, relationships_extracted``; ``queue``: ``queue, path``.
    All three are brought to one row a path and meet on it.
    """
    q = queue.groupBy("path").agg(F.bool_or(F.col("queue") == "index").alias("qi"), F.bool_or(F.col("queue") == "graph").alias("qg"))
    i = index.select("path", F.col("status").alias("i"), "chunks_indexed")
    g = graph.select("path", F.col("status").alias("g"), "objects_extracted", "relationships_extracted")
    out = i.join(g, "path", "full_outer").join(q, "path", "full_outer").where("path <> ''")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select(
        "path", F.element_at(F.split("path", "/"), -1).alias("file_name"), F.coalesce(F.nullif(F.regexp_replace("path", "/?[^/]*$", ""), F.lit("")), F.lit(".")).alias("folder"),
        F.coalesce("i", F.when(F.col("qi"), "queued").otherwise("not_started")).alias("index_status"), zero("chunks_indexed"),
        F.coalesce("g", F.when(F.col("qg"), "queued").otherwise("pending")).alias("graph_status"), zero("objects_extracted"), zero("relationships_extracted"),
    )


def summary(status: DataFrame, queue: DataFrame) -> DataFrame:
    s = status.agg(F.count("*").alias("total_files"), F.count_if(F.col("index_status") == "indexed").alias("indexed"), F.count_if(F.col("graph_status") == "complete").alias("graphed"), F.coalesce(F.sum("chunks_indexed"), F.lit(0)).cast("long").alias("total_chunks"))
    q = queue.agg(F.count_if(F.col("queue") == "index").alias("queued_index"), F.count_if(F.col("queue") == "graph").alias("queued_graph"))
    return s.join(q)


def histogram(state: DataFrame) -> DataFrame:
    """Files and chunks by status, the most frequent first."""
    out = state.groupBy(F.coalesce("status", F.lit("unknown")).alias("status")).agg(F.count("*").alias("n"), F.coalesce(F.sum("chunks_indexed"), F.lit(0)).cast("long").alias("chunks"))
    return out.orderBy(F.desc("n"), "status")


def pending(index: DataFrame, graph: DataFrame, cap: int = RETRY_CAP) -> DataFrame:
    """Indexed paths whose extraction is neither complete nor given up."""
    done = graph.where((F.col("status") == "complete") | (F.coalesce("retry_count", F.lit(0)) >= cap)).select("path")
    return index.where(F.col("status").isin(*INDEXED)).select("path").distinct().join(done, "path", "left_anti")


def dirty(files: DataFrame, state: DataFrame, context_version: int = 1) -> DataFrame:
    """Files to index: not those indexed with the same non-empty hash and an up-to-date context."""
    clean = state.where((F.col("status") == "indexed") & (F.col("hash") != "") & (F.coalesce("context_version", F.lit(0)) >= context_version)).select("path", "hash")
    return files.join(clean, ["path", "hash"], "left_anti")


def enqueue(queue: DataFrame, new: DataFrame) -> DataFrame:
    """The queue with new entries whose (queue, path) it hasn't; of equal new entries the first."""
    from .rewrites import first_wins

    fresh = first_wins(new.join(queue.select("queue", "path"), ["queue", "path"], "left_anti").select(new.columns), ["queue", "path"], "ord")
    return queue.unionByName(fresh, allowMissingColumns=True)


def dequeue(queue: DataFrame, gone: DataFrame) -> DataFrame:
    return queue.join(gone, ["queue", "path"], "left_anti")


def in_order(queue: DataFrame) -> DataFrame:
    return queue.orderBy(F.desc("priority"), "ord")


def reset_failed(state: DataFrame) -> DataFrame:
    """Failed entries become empty: every column but the path is null."""
    failed = F.coalesce(F.col("status") == "failed", F.lit(False))
    return state.select("path", *(F.when(~failed, F.col(c)).alias(c) for c in state.columns if c != "path"))


def upsert(state: DataFrame, changes: DataFrame, key: str = "path") -> DataFrame:
    """``state`` with the rows of ``changes`` in place of those with the same key."""
    return state.join(changes.select(key), key, "left_anti").unionByName(changes, allowMissingColumns=True)


def recent(state: DataFrame, k: int = 5) -> DataFrame:
    return state.where("updated_at is not null").orderBy(F.desc("updated_at"), "path").limit(k)


def throughput(stamps: DataFrame, total: Column | int, done: Column | int, k: int = 10) -> DataFrame:
    """Files an hour over the last ``k`` times (``ts``) and the remaining time as text."""
    last = stamps.orderBy(F.desc("ts")).limit(k)
    span = (F.unix_micros(F.max(F.col("ts").cast("timestamp"))) - F.unix_micros(F.min(F.col("ts").cast("timestamp")))) / 3.6e9
    out = last.agg(F.count("*").alias("n"), span.alias("hours"))
    rate = F.when((F.col("n") >= 2) & (F.col("hours") > 0), (F.col("n") - 1) / F.col("hours")).otherwise(0.0)
    total, done = (F.lit(x) if isinstance(x, int) else x for x in (total, done))
    left = (total - done) / F.col("rate")
    note = F.when((F.col("rate") > 0) & (total > done), F.when(left < 1, F.concat(F.lit("~"), F.floor(left * 60).cast("string"), F.lit(" min"))).when(left < 48, F.concat(F.lit("~"), F.format_string("%.1f", left), F.lit(" hr"))).otherwise(F.concat(F.lit("~"), F.format_string("%.1f", left / 24), F.lit(" days"))))
    return out.withColumn("rate", rate).withColumn("eta", F.coalesce(note, F.when((done >= total) & (total > 0), "complete").otherwise("?")))


def batches(rows: DataFrame, order: str, after: Column | None, size: int) -> DataFrame:
    """The next ``size`` rows behind a cursor."""
    out = rows if after is None else rows.where(F.col(order) > after)
    return out.orderBy(order).limit(size)


def round_robin(workers: DataFrame, calls: DataFrame) -> DataFrame:
    """Each call (``call_no`` from 0) with its enabled worker in turn.  Workers are a handful of rows."""
    w = Window.orderBy("worker")
    on = workers.where("enabled").select("worker", (F.row_number().over(w) - 1).alias("slot"), F.count("*").over(Window.partitionBy()).alias("slots"))
    return calls.join(F.broadcast(on), F.col("call_no") % F.col("slots") == F.col("slot")).select("call_no", "worker")


def quota(calls: DataFrame, day: Column, limit: int = DAILY_CALLS) -> DataFrame:
    """Calls a day, those within the quota and those beyond it."""
    return calls.groupBy(day.alias("day")).agg(F.count("*").alias("calls")).select("day", F.least("calls", F.lit(limit)).alias("within"), F.greatest(F.col("calls") - limit, F.lit(0)).alias("beyond"))


def progress(groups: DataFrame) -> DataFrame:
    """``done`` and ``total`` of ordered groups (``ord, size, cursor``): whole groups before the current one and its cursor."""
    w = Window.orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    return groups.select("ord", (F.coalesce(F.sum("size").over(w), F.lit(0)) + F.col("cursor")).alias("done"), F.sum("size").over(Window.partitionBy()).alias("total"))


def ema(values: DataFrame, by: str, order: str, value: Column, alpha: float, seed: float) -> DataFrame:
    """The exponential moving average after all values of each group, in order: a weighted sum, so groups are never held whole."""
    age = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(order))) - 1
    rows = values.select(by, value.cast("double").alias("v"), age.alias("age"))
    fade = F.pow(F.lit(1 - alpha), F.col("age"))
    return rows.groupBy(by).agg((F.sum(F.lit(alpha) * fade * F.col("v")) + F.pow(F.lit(1 - alpha), F.count("*")) * seed).alias("ema"))


def controller(values: DataFrame, by: str, order: str, load: Column, reserve: float = 10.0) -> DataFrame:
    """The cap controller's two averages after all loads of a group: the ambient load and the cap that leaves a reserve.

    Loads are sorted by group and order and stream past; a task holds one group's two numbers.
    """
    rows = values.select(by, F.col(order).alias("__order"), F.greatest(F.lit(0.0), F.least(F.lit(100.0), load)).cast("double").alias("load"))
    kind = rows.schema[by].dataType.simpleString()

    def run(batches):
        key, ambient, cap, out = None, 30.0, 50.0, []

        def rows_out():
            cols = list(zip(*out))
            return pa.RecordBatch.from_arrays([pa.array(cols[0], type=key_type), pa.array(cols[1]), pa.array(cols[2])], names=[by, "ambient", "cap"])

        begun = False
        for batch in batches:
            key_type = batch.column(0).type
            for group, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if begun and group != key:
                    out.append((key, ambient, cap))
                    ambient, cap = 30.0, 50.0
                begun, key = True, group
                ambient = 0.3 * x + 0.7 * ambient
                cap = 0.2 * max(10.0, min(90.0, 100.0 - ambient - reserve)) + 0.8 * cap
            if len(out) > 10_000:
                yield rows_out()
                out = []
        if begun:
            out.append((key, ambient, cap))
            yield rows_out()

    ordered = rows.repartition(by).sortWithinPartitions(by, "__order", "load").select(by, "load")
    return ordered.mapInArrow(run, f"{by} {kind}, ambient double, cap double")
