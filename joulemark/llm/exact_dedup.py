"""Exact deduplication by a stateful stream.

A stream of key rows (digest, identifier, locator) meets keyed state on disk (RocksDB) that never expires: per digest it
holds the identifier that stays, where its content lies, and how many rows came. A digest that comes again is a hit: the
full bytes of its rows are compared, those of the rows of this call as they are scanned and that of the row retained
before as its locator says, so that even a collision of digests does no harm. The texts never enter the state.

With a state folder the stream goes on where the last call ended: only new rows are read and digested, and their hits
among all earlier rows are found. A call that failed half way goes on when it is made again under its name.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, exists, free_name, lookup, new_path, remove, rows, written

#: The state store, without room laid out in advance: there is a small store for each partition, which is closed as soon as
#: its task has ended, so that an executor never holds those of all its partitions. Old versions go early.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true", "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "200",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false", "spark.sql.streaming.minBatchesToRetain": "2",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
}
KEY = "digest binary, doc_id bigint, call string, row bigint, file string, at bigint"
GROUP = "digest binary, keep struct<doc_id:bigint,call:string,row:bigint,file:string,at:bigint>, n bigint"


def sha256_digest(text: Column) -> Column:
    return F.unhex(F.sha2(F.encode(text, "UTF-8"), 256))


def _save(df: DataFrame, batch: int, out: str) -> None:
    """A batch's groups; made again after a failure, it overwrites itself."""
    df.write.mode("overwrite").parquet(f"{out}/batch={batch}")


def digest_stream(spark: SparkSession, state: str, files_per_batch: int = 1000) -> DataFrame:
    """Takes the key rows in state/keys that no call has taken yet. All groups so far, as the batches left them: digest, keep, n, batch."""
    keys = spark.readStream.schema(KEY).option("maxFilesPerTrigger", files_per_batch).parquet(f"{state}/keys")
    # the sum of a batch's rows is built before the shuffle, so a digest of a third of all rows is no burden
    groups = keys.groupBy("digest").agg(F.max(F.struct("doc_id", "call", "row", "file", "at")).alias("keep"), F.count("*").alias("n"))
    before = {k: spark.conf.get(k, None) for k in STATE}
    for k, v in STATE.items():
        spark.conf.set(k, v)
    try:
        query = (
            groups.writeStream.outputMode("update").option("checkpointLocation", f"{state}/stream").trigger(availableNow=True)
            .foreachBatch(lambda df, k: _save(df, k, f"{state}/groups")).start()
        )
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return _groups(spark, state)


def _read(spark: SparkSession, schema: str, path: str) -> DataFrame:
    """A Parquet table of the state; empty where there is none yet."""
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


def _groups(spark: SparkSession, state: str) -> DataFrame:
    return _read(spark, GROUP + ", batch long", f"{state}/groups")


def _latest(groups: DataFrame) -> DataFrame:
    """A later batch's row of a digest has a larger n and keep."""
    return groups.groupBy("digest").agg(F.max("keep").alias("keep"), F.max("n").alias("n"), F.max("batch").alias("batch"))


def _located(docs: DataFrame, state: str, call: str) -> DataFrame:
    """doc_id and text (null as empty) with where they lie: file and place in it. Rows that do not come from Parquet files
    are written into the state's folder first."""
    try:
        at = docs.metadataColumn("_metadata")
        return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), at["file_path"].alias("file"), at["row_index"].alias("at"))
    except AnalysisException:
        path = f"{state}/contents/{call}"
        docs.select("doc_id", "text").write.mode("overwrite").parquet(path)
        return _located(docs.sparkSession.read.schema("doc_id bigint, text string").parquet(path), state, call)


def _texts(spark: SparkSession, places: DataFrame) -> DataFrame:
    """places, a written table with file and at, and their texts. Only the files named are read."""
    files = [r["file"] for r in places.select("file").distinct().collect()]  # names of files, not of rows
    if not files:
        return places.withColumn("text", F.lit(""))
    found = spark.read.schema("text string").parquet(*files)
    at = found.metadataColumn("_metadata")
    found = found.select(F.coalesce("text", F.lit("")).alias("text"), at["file_path"].alias("file"), at["row_index"].alias("at"))
    return places.join(found, ["file", "at"])


def exact_dedup(docs: DataFrame, digest=sha256_digest, state: str | None = None, call: str | None = None, files_per_batch: int = 1000) -> DataFrame:
    """One row per row of docs (doc_id, text, ...): doc_id, row, keep_id, group_size, kept, digest.

    state is a folder that all machines see; with it, the rows of earlier calls count too, and the result has a row for
    each row of all calls, as a later row may take an earlier one's place. Without it the call stands alone, and what it
    kept is removed. The digest must be the same in all calls. call names this one: made again with its name, and the
    same docs, after a failure, it goes on from what has been done, and no row counts twice.

    Texts are equal when their bytes are; null counts as empty. Of equal texts the row with the largest doc_id stays;
    of rows with that same doc_id, one. A null doc_id counts as smaller than any; if all of a group are null, one row
    stays and its keep_id is null. Very long texts are digested whole. An empty table gives an empty result. Columns
    besides doc_id and text are not read.
    """
    spark, name = docs.sparkSession, call or uuid.uuid4().hex
    folder = state or new_path(spark, "dedup")
    last = _groups(spark, folder).agg(F.max("batch")).first()[0]
    last = -1 if last is None else last
    again = call is not None and not _read(spark, KEY, f"{folder}/keys").where(F.col("call") == name).isEmpty()
    own = _located(docs.withColumn("doc_id", F.col("doc_id").cast("long")), folder, name)
    if not again:  # all of its keys appear at once, when their write is committed
        keyed = own.select(digest(F.col("text")).alias("digest"), "doc_id", F.lit(name).alias("call"), F.monotonically_increasing_id().alias("row"), "file", "at")
        keyed.write.mode("append").parquet(f"{folder}/keys")
    keys = spark.read.schema(KEY).parquet(f"{folder}/keys")
    groups = digest_stream(spark, folder, files_per_batch)
    hits = written(_latest(groups).where("n > 1"), "dedup-hits")

    # on hits of this call the full bytes are compared: of its rows, and of what was retained before it
    fresh = (hits if again else hits.where(F.col("batch") > last)).select("digest")
    n = rows(hits)
    same = lookup(own.select(digest(F.col("text")).alias("digest"), "text"), fresh, "digest", "left_semi", n=n)
    if last >= 0:
        old = _latest(groups.where(F.col("keep.call") != name)).select("digest", "keep.file", "keep.at")
        old = written(lookup(old, fresh, "digest", "left_semi", n=n), "dedup-retained")
        same = same.unionByName(_texts(spark, old).select("digest", "text"))
    wrong = same.groupBy("digest").agg(F.min("text").alias("a"), F.max("text").alias("b")).where("a <> b").select("digest")
    if last >= 0:  # those known to collide go on doing so
        wrong = wrong.unionByName(_read(spark, "digest binary", f"{folder}/collisions")).distinct()
    wrong = written(wrong, "dedup-collisions")
    if state and rows(wrong):
        wrong.write.mode("append").parquet(f"{folder}/collisions")

    out = lookup(keys.select("doc_id", "call", "row", "digest"), hits.select("digest", "keep", "n"), "digest", n=n)
    out = out.select(
        "doc_id", "row", F.coalesce("keep.doc_id", "doc_id").alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (F.col("keep").isNull() | ((F.col("keep.row") == F.col("row")) & (F.col("keep.call") == F.col("call")))).alias("kept"), "digest",
    )
    if rows(wrong):
        # digests that hold several texts: their rows are fetched and grouped by the text
        apart = _texts(spark, written(lookup(keys, wrong, "digest", "left_semi"), "dedup-places"))
        apart = written(apart, "dedup-apart")
        best = apart.groupBy("digest", "text").agg(F.max(F.struct("doc_id", "call", "row")).alias("keep"), F.count("*").alias("group_size"))
        apart = apart.join(written(best, "dedup-apart-groups"), ["digest", "text"])
        apart = apart.select("doc_id", "row", F.col("keep.doc_id").alias("keep_id"), "group_size", ((F.col("keep.row") == F.col("row")) & (F.col("keep.call") == F.col("call"))).alias("kept"), "digest")
        out = lookup(out, wrong, "digest", "left_anti").unionByName(apart)
    out = written(out, "dedup-result")
    discard(hits, wrong)
    if not state:
        remove(spark, folder)
    return out


def without_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with the columns of docs, whatever their names. Of rows with one doc_id and one text, one stays."""
    name, gone, of = (free_name(c, docs.columns) for c in ("digest", "lost", "lost_digest"))
    found = exact_dedup(docs)
    lost = found.where(~F.col("kept")).select(F.col("doc_id").alias(gone), F.hex("digest").alias(of)).distinct()
    kept = found.where("kept").select(F.col("doc_id").alias("_id"), F.hex("digest").alias("_hex"))
    own = docs.withColumn(name, F.hex(sha256_digest(F.coalesce("text", F.lit("")))))
    lost = written(lost, "dedup-lost")
    both = F.col(gone).eqNullSafe(F.col("_id")) & (F.col(of) == F.col("_hex"))
    if not lost.join(kept, both, "left_semi").isEmpty():  # whole rows repeat
        own = own.dropDuplicates(["doc_id", name])
        lost = written(lost.join(kept, both, "left_anti"), "dedup-lost")
    on = F.col("doc_id").eqNullSafe(F.col(gone)) & (F.col(name) == F.col(of))
    return own.join(F.broadcast(lost) if rows(lost) <= 200_000 else lost, on, "left_anti").select(docs.columns)
