"""Exact dedup (operator 2): stateful streaming deduplication.

Documents arrive as a stream of (digest, doc_id, locator).  A streaming
aggregation holds, in RocksDB (on disk, no watermark, so nothing expires), one
entry for each digest: the smallest doc_id seen, that document's locator and
the number of rows.  Rows are combined before the shuffle, so a digest with a
third of all rows costs one row for each task.  A hit (a digest met again) is
then proven on the full bytes: the texts of the group's members are compared
with the text that the locator points to, in salted pieces of at most
``SALT_ROWS`` members, so that no task gets a whole hot group.  Rows whose
bytes differ show a digest collision; the rows of such a digest are grouped anew,
by their whole text.

Edge cases: a null text counts as empty; equal doc_ids with equal texts are
one document and get the same answer in every row; of rows with a null doc_id
the group's smallest non-null doc_id stays, and where all are null they stay
(``kept`` compares null-safe); an empty table gives an empty result; further
columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glenfare.llm.common import settings, shared_path, stored, table, unused

SALT_ROWS = 2000
#: Bytes of the log that one micro-batch takes.
BATCH_BYTES = 64 << 30
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def normalised(text: str | Column = "text") -> Column:
    """The text with each run of ASCII white space as one space.  Single spaces
    need no change, so only other runs are matched."""
    c = F.col(text) if isinstance(text, str) else text
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"[\t-\r][\x20\t-\r]*|\x20[\x20\t-\r]+", " ")


def sha256_digest(norm: Column) -> Column:
    return F.sha2(norm, 256)


def arrival_log(docs: DataFrame, path: str, digest: Callable[[Column], Column] = sha256_digest) -> DataFrame:
    """(doc_id, text_sha256, digest, locator), stored at ``path``: what the stream reads.
    The content locator is the document's id and the byte length of its text."""
    norm = normalised("text")
    log = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.sha2(norm, 256).alias("text_sha256"),
        digest(norm).cast("string").alias("digest"), F.octet_length(norm).cast("long").alias("n_bytes"))
    return stored(log, "dedup-log", path)


def keyed_state(log: DataFrame, path: str, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """Run the log (the table at ``path``) through the stateful stream; one row
    for each digest: digest, keep_id, keep_bytes, n_rows, n_ids."""
    spark = log.sparkSession
    out, offsets = shared_path(spark, "dedup-state"), shared_path(spark, "dedup-offsets")
    arrivals = spark.readStream.schema(log.schema).option("maxBytesPerTrigger", str(batch_bytes)).parquet(path)
    # min over (id is null, id, bytes): a null id stays only where there is no other
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "n_bytes")).alias("first")
    state = arrivals.groupBy("digest").agg(first, F.count(F.lit(1)).alias("n_rows"))

    def emit(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{out}/batch={batch_id:09d}")

    with settings(spark, spark__sql__streaming__stateStore__providerClass=ROCKSDB,
                  # many small stores: no disk is reserved ahead for their logs
                  spark__sql__streaming__stateStore__rocksdb__allowFAllocate="false",
                  # and together they hold little memory, which an executor gets back soon after the stream's end
                  spark__sql__streaming__stateStore__rocksdb__boundedMemoryUsage="true",
                  spark__sql__streaming__stateStore__rocksdb__maxMemoryUsageMB="200",
                  spark__sql__streaming__stateStore__rocksdb__writeBufferSizeMB="8",
                  spark__sql__streaming__stateStore__maintenanceInterval="10s"):
        query = (state.writeStream.outputMode("update").foreachBatch(emit).trigger(availableNow=True)
                 .option("checkpointLocation", offsets).start())
        query.awaitTermination()
    n = sum(1 for p in query.recentProgress if p["numInputRows"])
    schema = "digest string, first struct<no_id: boolean, doc_id: bigint, n_bytes: bigint>, n_rows bigint, batch_id int"
    if not n:
        changes = spark.createDataFrame([], schema)
    else:
        changes = spark.read.schema(schema).parquet(f"{out}/batch=*")
    if n > 1:  # the entry of the last batch that touched a digest is its final state
        changes = (changes.groupBy("digest")
                   .agg(F.max_by(F.struct("first", "n_rows"), "batch_id").alias("s")).select("digest", "s.*"))
    return changes.select("digest", F.col("first.doc_id").alias("keep_id"),
                          F.col("first.n_bytes").alias("keep_bytes"), "n_rows")


def hit_texts(docs: DataFrame, members: DataFrame, digest) -> DataFrame:
    """(digest, doc_id, keep_id, n_rows, norm): the full texts of all rows whose digest was met again."""
    hits = members.filter(F.col("n_rows") > 1).select("digest", "doc_id", "keep_id", "n_rows").distinct()
    texts = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalised("text").alias("norm"))
             .withColumn("digest", digest(F.col("norm")).cast("string")))
    return (texts.join(hits, (texts.digest == hits.digest) & texts.doc_id.eqNullSafe(hits.doc_id))
            .select(hits.digest, hits.doc_id, "keep_id", "n_rows", "norm"))


def collisions(hits: DataFrame, salt_rows: int) -> DataFrame:
    """The digests of which some row's bytes are not those of the document that the locator names."""
    n_salts = F.ceil(F.col("n_rows") / salt_rows).cast("int")
    located = (hits.filter(F.col("doc_id").eqNullSafe(F.col("keep_id")))
               .select("digest", "n_rows", F.col("norm").alias("kept_norm")).dropDuplicates(["digest"])
               .withColumn("salt", F.explode(F.sequence(F.lit(0), n_salts - 1))).drop("n_rows"))
    salted = hits.withColumn("salt", F.pmod(F.xxhash64("doc_id"), n_salts).cast("int"))
    return (salted.join(located, ["digest", "salt"]).filter(F.col("norm") != F.col("kept_norm"))
            .select("digest").distinct())


def exact_groups(docs: DataFrame, digest: Callable[[Column], Column] = sha256_digest,
                 batch_bytes: int = BATCH_BYTES, salt_rows: int = SALT_ROWS) -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    path = shared_path(docs.sparkSession, "dedup-log")
    log = arrival_log(docs, path, digest)
    state = keyed_state(log, path, batch_bytes)
    members = stored(log.join(state, "digest"), "dedup-members")
    hits = stored(hit_texts(docs, members, digest), "dedup-hits")
    odd = stored(collisions(hits, salt_rows), "dedup-collisions")
    cols = ["doc_id", "keep_id", "group_size", "text_sha256"]
    out = members.withColumn("group_size", F.col("n_rows"))
    if not odd.isEmpty():
        own = hits.join(odd, "digest", "left_semi").select("digest", "doc_id", "norm")
        groups = own.groupBy("digest", "norm").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        regrouped = own.join(groups, ["digest", "norm"]).withColumn("text_sha256", F.sha2("norm", 256))
        out = out.join(odd, "digest", "left_anti").select(cols).unionByName(regrouped.select(cols))
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
                      "text_sha256")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents")) \
        .select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def kept_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay: one for each text (where the only ids of a
    text are null, one of its rows)."""
    groups = exact_groups(docs)
    keep = stored(groups.filter("kept").groupBy("doc_id", "text_sha256").agg(F.count(F.lit(1)).alias("n_same")),
                  "dedup-kept")
    again = not keep.filter("n_same > 1").isEmpty()
    own_sha, key_sha, key_id = unused(docs, "own_sha", "key_sha", "key_id")
    d = docs.withColumn(own_sha, F.sha2(normalised("text"), 256))
    k = keep.select(F.col("doc_id").alias(key_id), F.col("text_sha256").alias(key_sha))
    out = d.join(k, (F.col(own_sha) == F.col(key_sha)) & F.col("doc_id").cast("long").eqNullSafe(F.col(key_id)),
                 "left_semi")
    return (out.dropDuplicates([own_sha]) if again else out).select(docs.columns)


QUERIES = {"op2_exact_dedup": op2_exact_dedup}

SQL = {"op2_exact_dedup": r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
     g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY norm)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.norm) AS text_sha256
FROM n JOIN g USING (norm)"""}
