"""Exact duplicates by a stateful stream over a table's files.

1. Arrivals: a stream reads each file once. Each task digests the texts of an Arrow batch and joins equal ones on the spot,
   their bytes compared, so a text with a third of all rows becomes one row a batch before anything is shuffled.
2. State: a second stream reads those rows, without texts, into keyed state: RocksDB on disk, without expiry. It holds per
   digest the stable identifier and the content locator (file, row in the file) of the first document that had it, and
   gives out the digests that a batch touched.
3. Arrivals of a digest that is known already are hits, and are checked on full bytes: the texts at the locators of hits
   and first documents are read again (a bitmap keeps the others out of the shuffle) and must be one text a class. Where
   they are not, two texts share a digest, and rows of that digest are told apart by the texts themselves.
4. Every batch leaves its members in a folder of its own, written anew if the batch is tried again. The result joins them
   with their class's largest id and size.

Opened again on the same `work` folder, the streams read only files that have come since, and join their documents to the
classes known.

Defined results: null text is the empty text and equal to it; nothing else is normalised. Of equal texts the row with the
largest id stays, null ids last; of rows with the same text and id the one in the last file and row. Extra columns are not
read. An empty table gives no rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from auditweave.llm.common import marked
from auditweave.storage import shared_dir, stored

ROCKSDB = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # each partition has a store of its own, and RocksDB would set aside several MB of disk for each one's manifest beforehand
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
CLASS = ["class_file", "class_row"]
PLACE = ["file", "row"]


def local_classes(docs: DataFrame, digest_bits: int) -> DataFrame:
    """docs (id, text, file, row) to one row per batch, file and text: key, sha, file, row (of the first), members (id, row)."""

    def run(batches):
        import hashlib

        import pyarrow as pa

        for batch in batches:
            ids, files, places = batch.column(0), batch.column(2).to_pylist(), batch.column(3).to_pylist()
            classes: dict[tuple[str, str], list] = {}  # (sha, file) -> [text, members], several only if texts share a digest
            found = []
            for n, text in enumerate(batch.column(1).cast(pa.binary()).to_pylist()):
                text = text or b""
                sha = hashlib.sha256(text).hexdigest()
                alike = classes.setdefault((sha, files[n]), [])
                own = next((c for c in alike if c[0] == text), None)
                if own is None:
                    own = (text, [])
                    alike.append(own)
                    found.append((sha, own[1]))
                own[1].append(n)
            order = [n for _, members in found for n in members]
            offsets = [0]
            for _, members in found:
                offsets.append(offsets[-1] + len(members))
            members = pa.StructArray.from_arrays([ids.take(pa.array(order, pa.int64())), pa.array([places[n] for n in order], pa.int64())], ["id", "row"])
            yield pa.RecordBatch.from_arrays(
                [pa.array([s[: digest_bits // 4] for s, _ in found], pa.string()), pa.array([s for s, _ in found], pa.string()), pa.array([files[m[0]] for _, m in found], pa.string()), pa.array([places[m[0]] for _, m in found], pa.int64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), members)],
                names=["key", "sha", "file", "row", "members"],
            )

    return docs.mapInArrow(run, f"key string, sha string, file string, row long, members array<struct<id:{docs.schema[0].dataType.simpleString()},row:long>>")


def first_of_each(arrivals: DataFrame) -> DataFrame:
    """key, first (batch, file, row, id: the stable identifier and locator), last batch: the keyed state of a stream of arrivals."""
    first = F.min(F.struct("batch", *PLACE, F.col("members")[0].id.alias("id")))
    return arrivals.groupBy("key").agg(first.alias("first"), F.max("batch").alias("last"))


def texts_at(content: DataFrame, places: DataFrame) -> DataFrame:
    """places (file, row, ...) with the texts that lie there; content: file, row, text."""
    at = F.xxhash64(*PLACE)
    near = marked(content.withColumn("at", at), "at", places.withColumn("at", at)).where("marked").select("row.*").drop("at")
    return near.join(places, PLACE)


def checked(rows: DataFrame, content: DataFrame, known: DataFrame | None) -> DataFrame:
    """Arrivals with class_file and class_row, by their digests, to arrivals with classes in which all texts are equal byte by byte.

    known: the members of earlier batches.
    """
    hits = rows.where("file <> class_file or row <> class_row")
    if hits.isEmpty():
        return rows
    firsts = hits.select(F.col("class_file").alias("file"), F.col("class_row").alias("row"), *CLASS).distinct()
    texts = texts_at(content, hits.select(*PLACE, *CLASS).union(firsts))
    mixed = texts.groupBy(*CLASS).agg((F.min("text") != F.max("text")).alias("mixed")).where("mixed").select(*CLASS)
    keys = stored(rows.join(mixed, CLASS, "left_semi").select("key").distinct(), "dedup-shared-digests")
    if keys.isEmpty():
        return rows
    # Texts that share a digest: every class known under it and every new row is named by its text.
    new = rows.join(keys, "key", "left_semi")
    places = new.select("key", *PLACE, F.lit(1).alias("new"))
    if known is not None:
        places = places.union(known.join(keys, "key", "left_semi").select("key", F.col("class_file"), F.col("class_row"), F.lit(0)).distinct())
    named = stored(texts_at(content, places), "dedup-named")
    first = named.groupBy("key", "text").agg(F.min(F.struct("new", *PLACE)).alias("first"))
    own = named.where("new = 1").join(first, ["key", "text"]).select(*PLACE, F.col("first.file").alias("class_file"), F.col("first.row").alias("class_row"))
    return rows.join(keys, "key", "left_anti").unionByName(new.drop(*CLASS).join(own, PLACE))


def members_of(spark: SparkSession, path: str, *, text: str = "text", doc_id: str = "doc_id", work: str | None = None, files_per_batch: int | None = None, digest_bits: int = 256) -> DataFrame:
    """Reads what is new in the Parquet files at path; batch, key, sha, file, row, members, class_file, class_row of all read so far."""
    work = (work or f"{shared_dir(spark)}/exact-dedup-{uuid.uuid4().hex}").rstrip("/")
    schema = spark.read.parquet(path).schema
    columns = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")]
    content = spark.read.schema(schema).parquet(path).select(F.coalesce(text, F.lit("")).alias("text"), *columns)
    # as a pattern, so that the stream takes a folder of files and a single file alike
    pattern = f"{path.rstrip('/')[:-1]}[{path.rstrip('/')[-1]}]"
    reader = spark.readStream.schema(schema)
    read = (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(pattern)
    local = local_classes(read.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), *columns), digest_bits).withColumn("batch", F.lit(0))
    arrived = local.schema

    def arrive(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{work}/arrivals/{number}")

    def settle(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{work}/touched/{number}")
        touched = spark.read.schema(held.schema).parquet(f"{work}/touched/{number}")
        known = spark.read.schema(members).parquet(*(f"{work}/members/{n}" for n in range(number))) if number else None
        done = known.agg(F.max("batch")).first()[0] if known is not None else None
        top, done = touched.agg(F.max("last")).first()[0], -1 if done is None else done
        if top is None:
            rows = spark.createDataFrame([], arrived)
        else:
            rows = spark.read.schema(arrived).parquet(*(f"{work}/arrivals/{n}" for n in range(done + 1, top + 1)))
        classes = touched.select("key", F.col("first.file").alias("class_file"), F.col("first.row").alias("class_row"))
        rows = stored(rows.join(classes, "key"), "dedup-classified")
        checked(rows, content, known).select(members.names).write.mode("overwrite").parquet(f"{work}/members/{number}")

    run(spark, local, arrive, f"{work}/arrivals-checkpoint")
    held = first_of_each(spark.readStream.schema(arrived).parquet(f"{work}/arrivals/*"))
    members = StructType([*arrived, *(StructField(c, t) for c, t in zip(CLASS, (StringType(), LongType())))])
    run(spark, held, settle, f"{work}/state-checkpoint")
    return spark.read.schema(members).option("recursiveFileLookup", "true").parquet(f"{work}/members")


def run(spark: SparkSession, stream: DataFrame, each, checkpoint: str) -> None:
    """Runs a stream, its state in RocksDB, until all that is there is read."""
    old = {k: spark.conf.get(k, None) for k in ROCKSDB}
    try:
        for k, v in ROCKSDB.items():
            spark.conf.set(k, v)
        query = stream.writeStream.outputMode("update").foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    query.awaitTermination()


def deduplicate(spark: SparkSession, path: str, **options) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every document in the Parquet files at path; options as in members_of()."""
    members = members_of(spark, path, **options)
    one = F.transform("members", lambda m: F.struct(m.id.alias("id"), F.col("file").alias("file"), m.row.alias("row")))
    members = members.select("sha", *CLASS, one.alias("members"))
    whole = members.groupBy(*CLASS).agg(F.max(F.array_max("members")).alias("best"), F.sum(F.size("members").cast("long")).alias("group_size"))
    each = members.join(whole, CLASS).select("sha", "best", "group_size", F.explode("members").alias("m"))
    return each.select(F.col("m.id").alias("doc_id"), F.col("best.id").alias("keep_id"), "group_size", (F.col("m") == F.col("best")).alias("kept"), F.col("sha").alias("text_sha256"))


SQL = """select doc_id, max(doc_id) over w as keep_id, (count(*) over w)::bigint as group_size, doc_id = max(doc_id) over w as kept, sha256(coalesce(text, '')) as text_sha256
from documents window w as (partition by coalesce(text, ''))"""
