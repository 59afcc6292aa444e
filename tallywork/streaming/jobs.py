"""Stream forms of the table jobs. Each runs what is available and stops; the result equals the table job."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from ..operators.duplicates import LOOKUP_KEY, find_duplicates
from ..operators.skew import kept
from ..sinks.buckets import BUCKETS, append_buckets, commit_buckets, read_buckets, touched_buckets, upsert_buckets
from ..sinks.invoices import change_images
from ..sinks.tables import latest_version, merge_latest
from ..sources.landing import content_hash, with_format

ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_available(df: DataFrame, checkpoint: str, batch: Callable[[DataFrame, int], None], mode: str = "append") -> StreamingQuery:
    """Process everything that has arrived, then stop."""
    q = (df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
         .foreachBatch(batch).trigger(availableNow=True).start())
    q.awaitTermination()
    return q


def ingest_documents(documents: DataFrame, out: str, checkpoint: str) -> None:
    """ST-1: arriving (storage_key, mime_type, content) get format and hash and are appended."""
    rows = with_format(documents).withColumn("document_hash", content_hash(F.col("content"))).drop("content")
    q = (rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()


def dispatched_once(requests: DataFrame, ts: str = "ts", keys: tuple[str, ...] = ("client_id", "batch_id", "file_name"),
                    keep: str = "1 hour", in_memory: int = 100_000) -> DataFrame:
    """ST-2: a request is dispatched unless its key was within ``keep`` before it, by event time: (keys, ts).

    Per key the time of the last dispatch is the state; it goes when the watermark
    has passed its end.  Rows of a key are taken in event-time order within a batch,
    so the answer is the same however batches cut a stream that arrives in order;
    a row older than the last dispatch counts as a repetition.

    A batch's rows of a key are read part by part and reduced to distinct times.  More than ``in_memory`` of them wait in
    keyed map state, one packed entry per stretch of ``keep``, and are then walked entry by entry, so that
    a key's rows are never in memory together.  A stretch holds one dispatch at most.  Needs the RocksDB state store, which is set here for the session's next streams.
    """
    span = int(pd.Timedelta(keep).value // 1000)
    schema = T.StructType([*[requests.schema[k] for k in keys], T.StructField(ts, T.TimestampType())])
    requests.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS_DB)

    class Dispatch(StatefulProcessor):
        def init(self, handle):
            self.handle = handle
            self.last = handle.getValueState("last", "last long")
            self.waiting = handle.getMapState("waiting", "stretch long", "times binary")

        def handleInputRows(self, key, rows, timerValues):
            held, spilled, n = {}, set(), 0

            def spill():
                for stretch, some in held.items():
                    if stretch in spilled:
                        some = np.union1d(np.frombuffer(self.waiting.getValue((stretch,))[0], np.int64), some)
                    self.waiting.updateValue((stretch,), (some.tobytes(),))
                    spilled.add(stretch)
                held.clear()

            for part in rows:
                times = np.unique(part[ts].to_numpy().astype("datetime64[us]").astype(np.int64))
                for some in np.split(times, np.flatnonzero(np.diff(times // span)) + 1):
                    stretch = int(some[0] // span)
                    held[stretch] = np.union1d(held[stretch], some) if stretch in held else some
                n += len(times)
                if n > in_memory:
                    spill()
                    n = 0
            if spilled:
                spill()
            last, sent = (self.last.get()[0] if self.last.exists() else None), []
            for stretch in sorted(spilled or held):
                times = np.frombuffer(self.waiting.getValue((stretch,))[0], np.int64) if spilled else held[stretch]
                at = 0 if last is None else int(np.searchsorted(times, last + span))
                if at < len(times):
                    last = int(times[at])
                    sent.append(last)
                if spilled:
                    self.waiting.removeKey((stretch,))
                if len(sent) == 10_000:
                    yield self._rows(key, sent)
                    sent = []
            if last is not None:
                self.last.update((last,))
                self.handle.registerTimer((last + span) // 1000 + 1)
            yield self._rows(key, sent)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            if self.last.exists() and (self.last.get()[0] + span) // 1000 + 1 <= expiredTimerInfo.getExpiryTimeInMs():
                self.last.clear()
            yield self._rows(key, [])

        def _rows(self, key, sent):
            return pd.DataFrame({**{k: pd.Series([v] * len(sent), dtype=object) for k, v in zip(keys, key)}, ts: pd.to_datetime(pd.Series(sent, dtype="int64"), unit="us")})

        def close(self):
            pass

    rows = requests.select(*keys, ts).where(F.col(ts).isNotNull()).withWatermark(ts, keep)
    return rows.groupBy(*keys).transformWithStateInPandas(Dispatch(), schema, "Append", "EventTime")


def find_duplicates_as_they_arrive(invoices: DataFrame, base: str, checkpoint: str, buckets: int = BUCKETS) -> None:
    """ST-3: duplicates against everything seen before.

    History is a key table on storage, not operator state: hashes in buckets by document hash, fiscal keys in buckets by
    key, each with the age of its row and no other column.  A batch reads the buckets its own keys fall into, and of those
    the rows that share a hash or a key with it.  Rows without a hash, or with a part of the key missing, match nothing later.
    """
    age, status = ["id", "created_at"], "processing_status"
    columns = [*age, "document_hash", status, *LOOKUP_KEY]
    spark = invoices.sparkSession
    tables = {f"{base}/by_hash": ["document_hash"], f"{base}/by_key": list(LOOKUP_KEY)}
    held = {f"{base}/by_hash": [*age, "document_hash"], f"{base}/by_key": [*age, status, *LOOKUP_KEY]}

    def batch(df: DataFrame, batch_id: int) -> None:
        rows = kept(df.select(*columns), "arrived")
        seen = rows.limit(0)
        for table, keys in tables.items():  # a repeated batch ignores its own first try
            known = read_buckets(spark, table, touched_buckets(rows, keys, buckets), batch_id)
            if known is not None:
                seen = seen.unionByName(known.join(rows.select(*keys), keys, "left_semi"), allowMissingColumns=True)
        # A row found by both halves of the history becomes one again.
        seen = seen.groupBy(*age).agg(*[F.max(c).alias(c) for c in columns if c not in age]).select(*columns)
        hits = find_duplicates(rows.unionByName(seen)).join(rows.select("id"), "id", "left_semi")
        hits.write.mode("overwrite").parquet(f"{base}/found/batch={batch_id}")
        for table, keys in tables.items():
            append_buckets(rows.select(*held[table]).dropna(subset=keys), table, batch_id, keys, "id", buckets)

    run_available(invoices, checkpoint, batch)


def _upsert(base: str, keys: list[str]) -> Callable[[DataFrame, int], None]:
    """Batch writer that merges changed rows into a table in buckets; a repeated batch does nothing."""
    def batch(df: DataFrame, batch_id: int) -> None:
        last = latest_version(df.sparkSession, base)
        if last is None or last < batch_id:
            upsert_buckets(kept(df, "changed"), base, batch_id, keys)
    return batch


def daily_throughput(invoices: DataFrame, base: str, checkpoint: str, late: str = "1 day") -> None:
    """ST-4: invoices per day in tumbling windows; changed days are merged into the table."""
    days = (invoices.withWatermark("created_at", late).groupBy(F.window("created_at", "1 day").alias("w"))
            .agg(F.count("*").alias("count")).select(F.to_date("w.start").alias("day"), "count"))
    run_available(days, checkpoint, _upsert(base, ["day"]), "update")


def rolling_windows(panes: DataFrame, days: int) -> DataFrame:
    """Counts per client in all windows of ``days`` days that hold a pane (client_id, day, total, ok_count, review_count).

    A pane enters the windows that end a day later and leaves those that end ``days`` days after that: running sums over
    two changes per pane give every window, whatever its length.
    """
    counts = ["total", "ok_count", "review_count"]
    change = lambda after, sign: F.struct(F.date_add("day", after).alias("at"), *[(sign * F.col(c)).alias(c) for c in counts])
    changes = panes.select("client_id", F.explode(F.array(change(1, F.lit(1)), change(days + 1, F.lit(-1)))).alias("x")).select("client_id", "x.*")
    changes = changes.groupBy("client_id", "at").agg(*[F.sum(c).alias(c) for c in counts])
    order = Window.partitionBy("client_id").orderBy("at")
    sums = changes.select("client_id", "at", F.lead("at").over(order).alias("until"), *[F.sum(c).over(order).alias(c) for c in counts]).where("total > 0")
    return sums.withColumn("end", F.explode(F.sequence("at", F.date_sub("until", 1)))).select("client_id", F.col("end").cast("timestamp").alias("window_end"), *counts)


def rolling_quality(invoices: DataFrame, base: str, checkpoint: str, days: int = 30, late: str = "1 day") -> None:
    """ST-5: outcome counts per client in windows of 30 days that move by a day.

    Panes of a day are the streaming state and are kept in ``base``-panes; the windows of clients in touched buckets
    are computed from them again, so a late day corrects all its windows.
    """
    status = lambda s: F.count_if(F.col("processing_status") == s)
    panes = (invoices.withWatermark("created_at", late)
             .groupBy("client_id", F.window("created_at", "1 day").alias("w"))
             .agg(F.count("*").alias("total"), status("ok").alias("ok_count"), status("requires_review").alias("review_count"))
             .select("client_id", F.to_date("w.start").alias("day"), "total", "ok_count", "review_count"))
    spark, kept_panes = invoices.sparkSession, f"{base}-panes"

    def batch(df: DataFrame, batch_id: int) -> None:
        last = latest_version(spark, base)
        if last is not None and last >= batch_id:
            return
        touched = upsert_buckets(kept(df, "panes"), kept_panes, batch_id, ["client_id", "day"], by=["client_id"])
        if touched:
            windows = rolling_windows(read_buckets(spark, kept_panes, touched, batch_id + 1), days)
            commit_buckets(windows, base, batch_id, ["client_id"], touched, touched)

    run_available(panes, checkpoint, batch, "update")


def supplier_profiles(classified: DataFrame, base: str, checkpoint: str) -> None:
    """ST-6: uses and last use per supplier and account, kept up to date."""
    p = classified.groupBy("supplier_id", "gl_account_id").agg(
        F.count("*").alias("match_count"), F.max("classified_at").alias("last_seen_at"))
    run_available(p, checkpoint, _upsert(base, ["supplier_id", "gl_account_id"]), "update")


def audit_changes(changes: DataFrame, base: str, log: str, checkpoint: str, key: str = "id", order: str | Column = "updated_at",
                  table: str = "invoices") -> None:
    """ST-7: arriving row versions are merged into the table; what changed is logged as before and after images."""
    spark = changes.sparkSession

    def batch(df: DataFrame, batch_id: int) -> None:
        last = latest_version(spark, base)
        if last is not None and last >= batch_id:
            return
        rows = kept(df, "versions")
        touched = touched_buckets(rows, [key])
        old = read_buckets(spark, base, touched, batch_id)
        before = rows.limit(0) if old is None else old
        after = merge_latest(before, rows, [key], [c for c in rows.columns if c != key], order)
        changed = rows.select(key).distinct()
        images = change_images(before.join(changed, key, "left_semi"), after.join(changed, key, "left_semi"), key, table)
        images.write.mode("overwrite").parquet(f"{log}/batch={batch_id}")
        commit_buckets(after, base, batch_id, [key], touched, touched)

    run_available(changes, checkpoint, batch)
