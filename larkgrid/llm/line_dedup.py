"""Line deduplication by levelled sorted runs of line hashes.

Every document's lines give keys (the line stripped of ASCII white space, A-Z lower-cased) of 128 bits. The documents come in
batches of falling doc_id. Each batch is aggregated to one row per key and merge-anti-joined with the runs so far. The new keys
are added as a run of their own, with the keeper that they have in this batch; of the known ones, whose keeper is in an earlier
batch, only the number of further documents is noted. So each key stands in one run. When a level holds `fanout` runs they are
merged into one run of the next level.

Runs are tables bucketed and sorted by key, all into the same buckets, so a batch meets them without an exchange or a sort of
what they hold: only the batch moves.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkgrid.llm.common import all_salts, bounded_batches, delete_path, materialize, new_path, released, salt_of

MIN_CHARS, MIN_DOCS, BATCHES, FANOUT = 40, 5, 4, 2


def line_key(line: bytes, min_chars: int) -> bytes | None:
    key = line.strip().lower()  # of bytes: ASCII white space and A-Z only
    if len(key) < min_chars or (not key.isascii() and len(key.decode("utf-8", "replace")) < min_chars):
        return None
    return hashlib.blake2b(key, digest_size=16).digest()


def line_keys(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """One row (h, doc_id) for each distinct long line of a row of docs that has a doc_id."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys: list[bytes] = []
            counts = []
            for text in batch.column(1):
                found = {k for line in (text.as_py() or b"").split(b"\n") if len(line) >= min_chars and (k := line_key(line, min_chars))}
                keys.extend(found)
                counts.append(len(found))
            ids = batch.column(0).take(pa.array(np.repeat(np.arange(len(counts)), counts)))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), ids], ["h", "doc_id"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.where("doc_id is not null").select("doc_id", F.col("text").cast("binary")).mapInArrow(released(emit), f"h binary, doc_id {kind}")


class LineRuns:
    """The store: levels of sorted runs (h, n_docs, keeper) in the shared folder, each key in one of them, and notes (h, n_docs) of
    further documents. A batch must hold lower doc_ids than those before."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT, buckets: int | None = None):
        self.spark, self.fanout = spark, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = [[]]
        self.notes: list[str] = []
        self.paths: dict[str, str] = {}

    @contextmanager
    def sorted_scans(self):
        """Spark takes the order of a bucket's only file for granted under this setting alone; it is set back afterwards."""
        setting = "spark.sql.legacy.bucketedTableScan.outputOrdering"
        before = self.spark.conf.get(setting)
        self.spark.conf.set(setting, "true")
        try:
            yield
        finally:
            self.spark.conf.set(setting, before)

    def _write(self, df: DataFrame, level: int) -> None:
        """A run of df, whose rows are dealt by h into as many partitions as there are buckets: a file per bucket."""
        name = f"line_run_{uuid.uuid4().hex}"
        self.paths[name] = new_path(self.spark, f"line-run-{level}")
        with self.sorted_scans():
            df.write.bucketBy(self.buckets, "h").sortBy("h").option("path", self.paths[name]).saveAsTable(name)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE {name}")
        delete_path(self.spark, self.paths.pop(name))

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name in level]

    def unknown(self, own: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The rows of a batch (h, n_docs, keeper) whose key no run has, and those whose key one has."""
        own = own.withColumn("known", F.lit(None).cast("boolean"))
        for run in self.runs():
            own = own.join(run.select("h", F.lit(True).alias("here")).hint("merge"), "h", "left").withColumn("known", F.coalesce("known", "here")).drop("here")
        return own.where("known is null").select("h", "n_docs", "keeper"), own.where("known").select("h", "n_docs")

    def add(self, keys: DataFrame) -> None:
        """Merge-anti-join a batch of (h, doc_id) with the runs and add the new keys as a run."""
        own = keys.groupBy("h").agg(F.countDistinct("doc_id").alias("n_docs"), F.max("doc_id").alias("keeper"))
        if self.buckets != int(self.spark.conf.get("spark.sql.shuffle.partitions")):
            own = own.repartition(self.buckets, "h")
        with self.sorted_scans():
            new, known = self.unknown(own)
            if self.runs():
                self.notes.append(new_path(self.spark, "line-notes"))
                known.write.parquet(self.notes[-1])
        self._write(new, 0)
        level = 0
        while len(self.levels[level]) >= self.fanout:
            self.compact(level)
            level += 1

    def compact(self, level: int) -> None:
        """Merges the runs of a level, whose keys differ, into one of the next: a full join of sorted buckets."""
        names, self.levels[level] = self.levels[level], []
        with self.sorted_scans():
            merged = self.spark.table(names[0])
            for name in names[1:]:
                other = self.spark.table(name).select("h", *[F.col(c).alias(f"{c}_") for c in ("n_docs", "keeper")])
                merged = merged.join(other.hint("merge"), "h", "full_outer").select("h", *[F.coalesce(c, f"{c}_").alias(c) for c in ("n_docs", "keeper")])
            self._write(merged, level + 1)
        for name in names:
            self._drop(name)

    def frequent(self, min_docs: int) -> DataFrame:
        """Keys of at least min_docs documents and the doc_id that keeps them, written to the shared folder."""
        notes = self.spark.read.parquet(*self.notes).groupBy("h").agg(F.sum("n_docs").alias("more")) if self.notes else None
        out = None
        for run in self.runs():
            if notes is not None:
                run = run.join(notes.hint("merge"), "h", "left").withColumn("n_docs", F.col("n_docs") + F.coalesce("more", F.lit(0))).drop("more")
            run = run.where(F.col("n_docs") >= min_docs)
            out = run if out is None else out.unionByName(run)
        with self.sorted_scans():
            return materialize(out, "frequent-lines")

    def close(self) -> None:
        """Deletes runs and notes."""
        for level in self.levels:
            for name in level:
                self._drop(name)
        for path in self.notes:
            delete_path(self.spark, path)
        self.levels, self.notes = [[]], []


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES, fanout: int = FANOUT, counts: tuple[str, str] = ("n_lines", "n_dropped")) -> DataFrame:
    """docs with repeated lines taken out of text, and n_lines (before) and n_dropped as further columns, under the given names.

    Lines are what \\n separates; null or empty text is one empty line (null text stays null). A line goes if its key has at
    least min_chars code points and is found in at least min_docs documents, unless its document has the largest doc_id of
    those. Rows of equal doc_id are one document. Rows without a doc_id stay as they are and count for nothing. An empty
    table gives an empty table. Extra columns pass through; existing ones of these names are replaced. Texts are worked on
    whole, one at a time.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    keys = materialize(line_keys(docs, min_chars), "line-keys")
    cuts = keys.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 10_000)).first()[0] if batches > 1 else None
    bounds = [None, *sorted(set(cuts or []), reverse=True), None]
    store = LineRuns(spark, fanout)
    for above, below in zip(bounds, bounds[1:]):
        part = keys
        if above is not None:
            part = part.where(F.col("doc_id") <= F.lit(above))
        if below is not None:
            part = part.where(F.col("doc_id") > F.lit(below))
        store.add(part)
    often = store.frequent(min_docs).select("h", "keeper", all_salts("salt"))
    store.close()
    gone = (
        keys.withColumn("salt", salt_of("doc_id"))
        .join(often, ["h", "salt"])
        .where(F.col("doc_id") != F.col("keeper"))
        .groupBy(F.col("doc_id").alias("__gone_id"))
        .agg(F.collect_set("h").alias("__gone"))
    )
    rest = [c for c in docs.columns if c.lower() not in counts]
    # rows without doc_id would meet in one task
    joined = docs.where("doc_id is not null").select(*rest).join(gone, F.col("doc_id") == F.col("__gone_id"), "left").drop("__gone_id")
    joined = joined.unionByName(docs.where("doc_id is null").select(*rest, F.lit(None).cast(joined.schema["__gone"].dataType).alias("__gone")))
    at = next(i for i, c in enumerate(joined.columns) if c.lower() == "text")
    names = [*rest, *counts]

    def rewrite(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            texts, before, dropped = [], [], []
            for text, gone_keys in zip(batch.column(at), batch.column(batch.num_columns - 1)):
                raw = text.as_py()
                lines = (raw or b"").split(b"\n")
                drop = set(gone_keys.as_py() or ())
                kept = [x for x in lines if not (len(x) >= min_chars and (k := line_key(x, min_chars)) and k in drop)] if drop else lines
                before.append(len(lines))
                dropped.append(len(lines) - len(kept))
                texts.append(raw if raw is None or len(kept) == len(lines) else b"\n".join(kept))
            cols = [batch.column(i) for i in range(len(rest))]
            cols[at] = pa.array(texts, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*cols, pa.array(before, pa.int64()), pa.array(dropped, pa.int64())], names)

    fields = docs.select(*rest).schema
    out = fields.add(counts[0], "long").add(counts[1], "long")
    sent = joined.select(*[F.col(c).cast("binary").alias(c) if c.lower() == "text" else F.col(c) for c in rest], "__gone")
    return sent.mapInArrow(released(rewrite), out)
