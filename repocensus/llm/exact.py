"""Exact deduplication over disk-backed streaming state (operator 4).

Documents are staged once as a table in the shared folder. A stream over that table keeps, per digest
of the normalised text and without expiry, the smallest identifier with its content locator (the staged
row) and the number of rows; the state lives in RocksDB and is checkpointed in the shared folder.
On a hit (a digest with more than one row) the whole normalised texts are compared, so a
digest collision never merges different texts.

* Texts are equal when identical after replacing each run of white space by one space; null counts
  as empty. Of equal texts the row with the smallest ``doc_id`` stays (null last; of repeated rows with
  the same id one stays). Empty tables give empty results; other columns are only carried in ``doc``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repocensus.llm.tables import SPACES, place_of, scratch_folder, stored

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# Disk-backed state, without disk reserved ahead for each of many small stores.
STATE_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
SALTS = 16


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _first() -> Column:
    """The row that stays: known ids before null, small before large, then by locator."""
    return F.min(F.struct(F.col("doc.doc_id").isNull().alias("no_id"), F.col("doc.doc_id").alias("id"), F.col("locator"))).alias("first")


def digest_state(staged: DataFrame, files_per_batch: int = 1000) -> DataFrame:
    """``digest``, ``first`` (identifier and locator), ``n``: the state after streaming the staged table."""
    spark = staged.sparkSession
    place = scratch_folder(spark, "exact-state")
    before = {key: spark.conf.get(key, None) for key in STATE_SETTINGS}
    for key, value in STATE_SETTINGS.items():
        spark.conf.set(key, value)
    try:
        stream = (
            spark.readStream.schema(staged.schema)
            .option("maxFilesPerTrigger", files_per_batch)
            .parquet(place_of(staged))
            .groupBy("digest")
            .agg(_first(), F.count("*").alias("n"))
        )
        query = (
            stream.writeStream.outputMode("update")
            .format("noop")
            .option("checkpointLocation", place)
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
        state = spark.read.format("statestore").load(place)
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    # The state's values are the aggregates' buffers, in their order.
    low, count = (f"value.`{c}`" for c in state.schema["value"].dataType.names)
    return stored(state.select("key.digest", F.col(low).alias("first"), F.col(count).alias("n")), "exact-groups")


def staged_documents(docs: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """``doc`` (the whole row), ``locator``, ``digest`` and ``text_sha256``, in the shared folder."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")
    text = normalised(F.col("text"))
    return stored(
        docs.select(whole, F.monotonically_increasing_id().alias("locator"), digest(text).alias("digest"), sha256(text).alias("text_sha256")),
        "exact-staged",
    )


def exact_verdicts(staged: DataFrame) -> DataFrame:
    """One row per staged row: ``locator``, ``doc_id``, ``text_sha256``, ``keep_id``, ``group_size``, ``kept``."""
    groups = digest_state(staged)

    # Full bytes on hits. A digest may have a third of all rows: its rows are dealt over salts, and
    # equal texts meet only after a combine in each task.
    hits = groups.where("n > 1").select("digest", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = staged.withColumn("salt", F.pmod(F.col("locator"), F.lit(SALTS)).cast("int"))
    texts = stored(
        salted.join(hits, ["digest", "salt"], "left_semi")
        .groupBy("digest", normalised(F.col("doc.text")).alias("whole"))
        .agg(_first(), F.count("*").alias("n")),
        "exact-texts",
    )
    clashing = texts.groupBy("digest").agg(F.count("*").alias("texts")).where("texts > 1").select("digest")

    rows = staged.select("locator", F.col("doc.doc_id").alias("doc_id"), "digest", "text_sha256").join(groups, "digest")
    if not clashing.isEmpty():
        apart = texts.join(clashing, "digest", "left_semi").withColumnRenamed("digest", "of_digest")
        own = staged.join(
            apart, (F.col("digest") == F.col("of_digest")) & (normalised(F.col("doc.text")) == F.col("whole"))
        ).select("locator", F.col("first").alias("own_first"), F.col("n").alias("own_n"))
        rows = rows.join(own, "locator", "left").select(
            "locator", "doc_id", "text_sha256", F.coalesce("own_first", "first").alias("first"), F.coalesce("own_n", "n").alias("n")
        )
    return rows.select(
        "locator",
        "doc_id",
        "text_sha256",
        F.col("first.id").alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("locator") == F.col("first.locator")).alias("kept"),
    )


def exact_stage(docs: DataFrame) -> DataFrame:
    """One row of each group of equal texts."""
    staged = staged_documents(docs)
    stay = exact_verdicts(staged).where("kept").select("locator")
    return staged.join(stay, "locator", "left_semi").select("doc.*")


def exact_query(docs: DataFrame) -> DataFrame:
    verdicts = exact_verdicts(staged_documents(docs.select("doc_id", "text")))
    return verdicts.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


EXACT_SQL = r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(COALESCE(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, MIN(doc_id) AS keep_id, COUNT(*) AS group_size FROM t GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM t JOIN g USING (text_sha256)
"""
