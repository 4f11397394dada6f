"""Codes of vectors by product quantisation, with the candidates of a grid cell memoised.

A vector is cut into PARTS equal parts; each part is coded by the nearest of at most ENTRIES codebook entries, which Lloyd's
rounds in integers move. To find the nearest entry, a part is put into a coarse cell of a grid. For a cell seen first, the
least and the greatest distance from its box to every entry are worked out: an entry whose least distance lies above some
other's greatest is dominated all over the box. The others are cached under the cell's hash, so parts that fall there later
are held against those alone, by exact squared distances. The cache belongs to a task; it is emptied when it holds CELLS
cells of a part, which costs time but changes nothing. Cells that share a hash are told apart by their coordinates: a part
that isn't in the cached cell is held against all entries.

Each round is one pass: a task returns a sum and a count for every entry and place, and the driver gets a row per entry
and place. The driver holds the codebooks alone: ENTRIES vectors.

Edge cases: null, empty and non-finite vectors, and those with a component of 2**60 or more after scaling, are dropped, as are
vectors of another length than the commonest (of equally common ones the longest counts). A length that PARTS doesn't divide
is filled with zeros at its end, which changes no distance. Fewer than ENTRIES rows give as many entries. Null ids come
last among the ids; rows of the same id are ordered by their vectors; repeated rows each get a row. Rows without a label are summed together. An
error, or a label's sum, that doesn't fit a long is null. An empty table gives no rows. Extra columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridweave.llm import vectors
from gridweave.llm.common import Workspace, look_up

SCALE, PARTS, ENTRIES, ROUNDS = 4096.0, 8, 16, 6
#: Cells of a part that a task caches before it starts anew.
CELLS = 1 << 16
#: Below this, squared distances of parts of up to 4096 places stay within 64 bits.
NARROW = 1 << 24
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def cut(x: np.ndarray, parts: int = PARTS) -> np.ndarray:
    """Rows of vectors as rows of parts, filled with zeros at the end."""
    width = -(-x.shape[1] // parts)
    return np.pad(x, [(0, 0), (0, width * parts - x.shape[1])]).reshape(len(x), parts, width)


def cell_side(codebooks: np.ndarray) -> int:
    """A power of two near half the spread of the entries, so that boxes are small against the room between them."""
    spread = float(np.sqrt(np.mean((codebooks.astype(float) - codebooks.astype(float).mean(0)) ** 2)))
    return 1 << max(0, round(np.log2(max(spread, 2.0))) - 1)


class Nearest:
    """The nearest entry to each part of one position; ties go to the lower index."""

    def __init__(self, entries: np.ndarray, side: int, cells: int = CELLS):
        self.entries, self.side, self.most = entries, side, cells
        self.weights = np.resize(_MIX, entries.shape[1]) * (2 * np.arange(entries.shape[1], dtype=np.uint64) + np.uint64(1))
        self.evaluated = self.parts = 0
        self.forget()

    def forget(self) -> None:
        self.hashes = np.empty(0, np.uint64)
        self.cells = np.empty((0, self.entries.shape[1]), np.int64)
        self.live = np.empty((0, len(self.entries)), bool)

    def _rivals(self, cells: np.ndarray) -> np.ndarray:
        """Per cell, which entries no other dominates all over its box."""
        live = np.empty((len(cells), len(self.entries)), bool)
        for at in range(0, len(cells), 4096):
            low = vectors.exact(cells[at : at + 4096] * self.side, NARROW)[:, None]
            under, over = low - self.entries, self.entries - (low + (self.side - 1))
            nearest = np.maximum(np.maximum(under, over), 0)
            farthest = np.maximum(np.abs(under), np.abs(over))
            nearest, farthest = (nearest * nearest).sum(2), (farthest * farthest).sum(2)
            live[at : at + 4096] = nearest <= farthest.min(1)[:, None]
        return live

    def _candidates(self, cells: np.ndarray) -> np.ndarray:
        """Per part, which entries to hold it against."""
        hashed = (cells.view(np.uint64) * self.weights).sum(1, dtype=np.uint64)
        hashed ^= hashed >> np.uint64(29)
        found, first, back = np.unique(hashed, return_index=True, return_inverse=True)
        if len(self.hashes) + len(found) > self.most:
            self.forget()
        at = np.searchsorted(self.hashes, found)
        known = np.zeros(len(found), bool)
        inside = at < len(self.hashes)
        known[inside] = self.hashes[at[inside]] == found[inside]
        if not known.all():
            fresh = cells[first[~known]]
            hashes = np.concatenate([self.hashes, found[~known]])
            order = np.argsort(hashes)
            self.hashes = hashes[order]
            self.cells = np.concatenate([self.cells, fresh])[order]
            self.live = np.concatenate([self.live, self._rivals(fresh)])[order]
            at = np.searchsorted(self.hashes, found)
        at = at[back]
        live = self.live[at]
        live[(self.cells[at] != cells).any(1)] = True
        return live

    def __call__(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of the nearest entry, for rows of parts."""
        if not len(x):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        live = self._candidates(np.ascontiguousarray(x // self.side))
        row, entry = np.nonzero(live)
        self.evaluated, self.parts = self.evaluated + len(row), self.parts + len(x)
        step = vectors.exact(x, NARROW)[row] - self.entries[entry]
        apart = (step * step).sum(1)
        begins = np.searchsorted(row, np.arange(len(x)))
        least = np.minimum.reduceat(apart, begins)
        hits = np.flatnonzero((apart == least[row]).astype(bool))
        hits = hits[np.unique(row[hits], return_index=True)[1]]  # the first of a row: the lower index
        return entry[hits], least


def first_entries(rows: DataFrame, width: int, vector: str, entries: int = ENTRIES) -> np.ndarray:
    """(part, entry, place): the parts of the rows with the smallest ids."""
    first = rows.select("vec_id", F.col(vector).alias("v")).orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).collect()
    x = np.floor(np.array([r["v"] for r in first], float).reshape(len(first), width) * SCALE).astype(np.int64)
    return cut(x).transpose(1, 0, 2)


def _assigners(codebooks: np.ndarray, side: int) -> list[Nearest]:
    return [Nearest(vectors.exact(book, NARROW), side) for book in codebooks]


def next_entries(rows: DataFrame, width: int, vector: str, codebooks: np.ndarray, side: int) -> np.ndarray:
    """One round: every entry becomes the floor of the mean of its parts; unused ones stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = _assigners(codebooks, side)
        sums = np.zeros(codebooks.shape, object)
        counts = np.zeros(codebooks.shape[:2], np.int64)
        for b in batches:
            x = cut(vectors.integers(b.column("v"), width, SCALE))
            for part, book in enumerate(near):
                at, _ = book(x[:, part])
                counts[part] += np.bincount(at, minlength=len(book.entries))
                inner = vectors.exact(x[:, part], (1 << 62) // max(len(x), 1))
                for entry in np.unique(at):
                    sums[part, entry] += inner[at == entry].sum(0)
        part, entry, place = np.nonzero(np.broadcast_to(counts[:, :, None] > 0, codebooks.shape))
        total = pa.array([int(v) for v in sums[part, entry, place]], pa.decimal128(38, 0))
        yield pa.record_batch([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(place, pa.int32()), pa.array(counts[part, entry], pa.int64()), total], names=["part", "entry", "place", "n", "s"])

    partial = rows.select(F.col(vector).alias("v")).mapInArrow(run, "part int, entry int, place int, n long, s decimal(38, 0)")
    new = codebooks.copy()
    for r in partial.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect():
        new[r["part"], r["entry"], r["place"]] = int(r["s"]) // r["n"]
    return new


def fit(rows: DataFrame, width: int, vector: str = "embedding", entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[np.ndarray, int]:
    """Codebooks (part, entry, place) of rows that vectors.kept gave, and the side of the cells."""
    codebooks = first_entries(rows, width, vector, entries)
    side = cell_side(codebooks)
    for _ in range(rounds):
        codebooks = next_entries(rows, width, vector, codebooks, side)
    return codebooks, side


def encode(rows: DataFrame, width: int, codebooks: np.ndarray, side: int, vector: str = "embedding") -> DataFrame:
    """vec_id, label, code and error of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = _assigners(codebooks, side)
        for b in batches:
            x = cut(vectors.integers(b.column("v"), width, SCALE))
            found = [book(x[:, part]) for part, book in enumerate(near)]
            codes = np.stack([at for at, _ in found], 1)
            error = np.sum([vectors.exact(d, 1 << 59) for _, d in found], 0)
            code = pa.array([row.tobytes().hex() for row in codes.astype(np.uint8)], pa.string())
            yield pa.record_batch([b.column("vec_id"), b.column("label"), code, vectors.longs(error)], names=["vec_id", "label", "code", "error"])

    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"), F.col(vector).alias("v"))
    return rows.mapInArrow(run, "vec_id long, label int, code string, error long")


def digest(codebooks: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(int(v)) for v in codebooks.reshape(-1)).encode()).hexdigest()


def quantise(embeddings: DataFrame) -> DataFrame:
    """Code and error of every kept row, its label's error, and the codebooks' hash."""
    spark = embeddings.sparkSession
    rows, width = vectors.kept(embeddings.select("vec_id", "embedding", "label"), "embedding", SCALE)
    if not width:
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    codebooks, side = fit(rows, width)
    coded = Workspace(spark, "codes").write(encode(rows, width, codebooks, side), "coded")
    # Labels may be many, or one may hold most rows: sums are looked up by rows that are dealt anew where a label is large.
    sums = Workspace(spark, "labels").write(coded.groupBy("label").agg(F.expr("try_sum(error)").alias("label_error"), F.count(F.lit(1)).alias("rows")), "sums")
    none = sums.where("label IS NULL").select("label_error").first()
    named = look_up(coded, sums.where("label IS NOT NULL"), ["label"], "rows")
    total = F.when(F.col("label").isNull(), F.lit(none[0] if none else None).cast("long")).otherwise(F.col("label_error"))
    return named.select("vec_id", "code", "error", total.alias("label_error"), F.lit(digest(codebooks)).alias("codebooks_sha256"))


def op13_grid_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantise(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _sql() -> str:
    """The same in SQL: a row per part and place, the rounds written one after the other."""
    width = "(SELECT max(len(embedding)) // 8 FROM kept)"
    near = """
{out} AS MATERIALIZED (SELECT part, row_id, min(dist * 16 + entry) AS best FROM (
  SELECT x.part, x.row_id, c.entry, sum((x.v - c.v) * (x.v - c.v)) AS dist FROM x JOIN {book} c ON c.part = x.part AND c.place = x.place
  GROUP BY x.part, x.row_id, c.entry) GROUP BY part, row_id)"""
    means = """
{out} AS MATERIALIZED (SELECT c.part, c.entry, c.place, coalesce(m.v, c.v) AS v FROM {book} c LEFT JOIN (
  SELECT part, entry, place, ((s - ((s % n) + n) % n) // n)::BIGINT AS v FROM (
    SELECT x.part, a.best % 16 AS entry, x.place, sum(x.v) AS s, count(*) AS n FROM x JOIN {near} a ON a.part = x.part AND a.row_id = x.row_id
    GROUP BY x.part, a.best % 16, x.place)) m ON m.part = c.part AND m.entry = c.entry AND m.place = c.place)"""
    steps = [
        """
kept AS MATERIALIZED (SELECT vec_id, label, embedding, row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS row_id FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda e: e IS NULL OR isnan(e) OR isinf(e))) = 0)""",
        f"""
x AS MATERIALIZED (SELECT row_id, (i // {width})::INT AS part, (i % {width})::INT AS place, v FROM (
  SELECT row_id, unnest(range(len(embedding)))::INT AS i, floor(unnest(embedding)::DOUBLE * 4096)::BIGINT AS v FROM kept))""",
        """
b0 AS MATERIALIZED (SELECT part, row_id AS entry, place, v FROM x WHERE row_id < 16)""",
    ]
    for at in range(ROUNDS):
        steps += [near.format(out=f"a{at}", book=f"b{at}"), means.format(out=f"b{at + 1}", book=f"b{at}", near=f"a{at}")]
    steps.append(near.format(out="last", book=f"b{ROUNDS}"))
    steps.append("""
coded AS MATERIALIZED (SELECT k.vec_id, k.label, string_agg(format('{:02x}', (l.best % 16)::INT), '' ORDER BY l.part) AS code, sum(l.best // 16)::BIGINT AS error
  FROM kept k JOIN last l ON l.row_id = k.row_id GROUP BY k.row_id, k.vec_id, k.label)""")
    return "WITH " + ",".join(steps) + f"""
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
  (SELECT sha256(string_agg(v::VARCHAR, ',' ORDER BY part, entry, place)) FROM b{ROUNDS}) AS codebooks_sha256 FROM coded"""


OP13_SQL = _sql()
