"""Exact deduplication by recipes of content-defined chunks.

A text is normalised (white space deleted) and cut where a rolling hash of its last bytes says so, so equal texts have
equal chunks. A chunk's identifier is a keyed hash. Identifiers are verified: every different chunk is moved once, and
if two different chunks share an identifier, all are drawn anew, twice as wide, under another key. From then on only recipes
move: texts are equal exactly if their ordered lists of identifiers are, and long texts don't move again.

Of equal texts the row with the most code points stays, then the smallest id (null last), then the first row read.

Edge cases: null and empty texts, and texts of white space only, have an empty recipe and are equal; repeated rows are
copies of each other and exactly one is kept; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridweave.llm.common import SPACES, Workspace, documents, keep_rows, look_up, text_key, text_of

#: Bytes of a chunk: mean, least, most.
MEAN, LEAST, MOST = 2048, 512, 16384
#: Identifiers that a task remembers to send each chunk once; forgotten when full, which only sends some again.
REMEMBERED = 200_000


def gear() -> np.ndarray:
    """A random 64-bit number per byte value, from a fixed rule."""
    return np.array([int.from_bytes(hashlib.blake2b(bytes([b]), digest_size=8).digest(), "little") for b in range(256)], np.uint64)


def cuts(data: bytes, table: np.ndarray) -> list[int]:
    """Ends of the chunks. A chunk may end where the rolling hash of the last 16 bytes is 0 in its top bits."""
    n = len(data)
    if n <= LEAST:
        return [n] if n else []
    h = table[np.frombuffer(data, np.uint8)]
    for k in (1, 2, 4, 8):
        moved = np.zeros_like(h)
        moved[k:] = h[:-k] << np.uint64(k)
        h = h + moved
    marks = np.flatnonzero(h >> np.uint64(64 - MEAN.bit_length() + 1) == 0) + 1
    out, at, i = [], 0, 0
    while n - at > LEAST:
        i = np.searchsorted(marks, at + LEAST)
        end = min(int(marks[i]) if i < len(marks) else n, at + MOST, n)
        out.append(end)
        at = end
    if at < n:
        out.append(n)
    return out


def normalise(text: str | None) -> bytes:
    return (text or "").encode().translate(None, SPACES.encode())


def chunk_ids(data: bytes, table: np.ndarray, key: bytes, width: int) -> Iterator[tuple[bytes, bytes]]:
    at = 0
    for end in cuts(data, table):
        body = data[at:end]
        yield hashlib.blake2b(body, digest_size=width, key=key).digest(), body
        at = end


def chunks(docs: DataFrame, key: bytes, width: int) -> DataFrame:
    """(id, body) of every chunk, each once per task as far as remembered."""
    table = gear()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # What was sent is remembered by another hash of the body, never by the identifier that is to be verified.
        sent: set[bytes] = set()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                ids, bodies = [], []
                for t in batch.slice(at, 512).column("text").to_pylist():
                    for i, body in chunk_ids(normalise(t), table, key, width):
                        full = xxhash.xxh3_128_digest(body)
                        if full not in sent:
                            sent.add(full)
                            ids.append(i)
                            bodies.append(body)
                if len(sent) > REMEMBERED:
                    sent.clear()
                yield pa.record_batch([pa.array(ids, pa.binary()), pa.array(bodies, pa.binary())], names=["id", "body"])

    return docs.select(text_of().alias("text")).mapInArrow(run, "id binary, body binary")


def verified(docs: DataFrame, key: bytes, width: int) -> bool:
    """Whether no two different chunks share an identifier; every different chunk is compared byte by byte."""
    different = chunks(docs, key, width).repartition("id").dropDuplicates(["id", "body"])
    return different.groupBy("id").count().where("count > 1").isEmpty()


RECIPES = "doc_id long, text_key long, points long, text_sha256 string, recipe binary"


def recipes(docs: DataFrame, key: bytes, width: int) -> DataFrame:
    """doc_id, code points of the original text, hash of the normalised text, and its ordered identifiers end to end."""
    table = gear()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = part.column("text").to_pylist()
                bodies = [normalise(t) for t in texts]
                found = [b"".join(i for i, _ in chunk_ids(b, table, key, width)) for b in bodies]
                yield pa.record_batch([part.column("doc_id"), part.column("text_key"), pa.array(map(len, texts), pa.int64()), pa.array([hashlib.sha256(b).hexdigest() for b in bodies], pa.string()), pa.array(found, pa.binary())], names=[x.split()[0] for x in RECIPES.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_key"), text_of().alias("text")).mapInArrow(run, RECIPES)


def deduplicate(docs: DataFrame, width: int = 16) -> DataFrame:
    """Every row of docs: doc_id, keep_id, group_size, kept, text_sha256, text_key."""
    spark = docs.sparkSession
    key = b"chunks 0"
    for attempt in range(1, 9):
        if verified(docs, key, width):
            break
        key, width = b"chunks %d" % attempt, min(64, width * 2)
    else:
        raise RuntimeError("different chunks share 512-bit identifiers under eight keys")
    work = Workspace(spark, "chunk-dedup")
    rows = work.write(recipes(docs, key, width).withColumn("row", F.monotonically_increasing_id()), "recipes")
    # The most code points, then the smallest id with null last, then the first row, as one struct to take the max of.
    rank = F.struct("points", F.coalesce(-F.col("doc_id"), F.lit(-(1 << 63))).alias("i"), (-F.col("row")).alias("r"), "doc_id", "row")
    groups = rows.groupBy("recipe").agg(F.count(F.lit(1)).alias("group_size"), F.max(rank).alias("best")).where("group_size > 1")
    groups = work.write(groups.select("recipe", "group_size", F.col("best.doc_id").alias("keep"), F.col("best.row").alias("keep_row")), "groups")
    out = look_up(rows, groups, ["recipe"], "group_size")
    alone = F.col("group_size").isNull()
    return out.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("row") == F.col("keep_row"))).alias("kept"),
        "text_sha256",
        "text_key",
    )


def without_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs that deduplication keeps."""
    rows = deduplicate(docs).where("kept")
    return keep_rows(docs, rows.select("doc_id", "text_key", (F.col("group_size") > 1).alias("once")))


def op6_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(documents(spark, sf_dir)).drop("text_key")


OP6_SQL = r"""
WITH norm AS (
  SELECT doc_id, length(coalesce(text, '')) AS points, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body
  FROM documents
), ranked AS (
  SELECT doc_id, sha256(body) AS text_sha256,
    first_value(doc_id) OVER (PARTITION BY body ORDER BY points DESC, doc_id NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS keep_id,
    count(*) OVER (PARTITION BY body) AS group_size,
    row_number() OVER (PARTITION BY body ORDER BY points DESC, doc_id NULLS LAST) = 1 AS kept
  FROM norm
)
SELECT doc_id, keep_id, group_size, kept, text_sha256 FROM ranked
"""
