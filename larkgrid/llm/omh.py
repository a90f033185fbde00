"""Document fingerprints by Order MinHash.

The k-mers are runs of 8 UTF-8 bytes, numbered by occurrence (the third "the same" differs from the first). For each of
`sketches` random orders, the `tuple_size` smallest are selected, put back in the order in which they stand in the text, and
hashed as a tuple. Two texts agree in a sketch with a probability that falls with their edit distance, not only with their
shared content, because moved passages change the order within tuples.

Texts that begin alike share the selection over the k-mers of that beginning, whose occurrence numbers are the same in both; so
the fingerprint of an edited text costs its new part alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkgrid.llm.common import bounded_batches, released, shared_array
from larkgrid.llm.tokens import U64, mix64, seeds

K, SKETCHES, TUPLE, SEED = 8, 128, 2, 5
#: k-mers that one step of all sketches works on, so that memory is bounded for long texts.
STEP = 1 << 12
#: Text bytes of one range of documents, which one task streams.
RANGE_BYTES = 1 << 25

U32 = np.uint32
_room = np.empty(0, U32)


def _scratch(rows: int, columns: int) -> np.ndarray:
    """One array for all steps of a process, as a new one for each would cost more than what is written to it."""
    global _room
    if len(_room) < rows * columns:
        _room = np.empty(rows * columns, U32)
    return _room[: rows * columns].reshape(rows, columns)


def numbered_kmers(text: bytes) -> np.ndarray:
    """uint32 per k-mer: a hash of its bytes and of how often it stood before. A text of fewer than k bytes is padded with zero bytes."""
    data = np.frombuffer(text + b"\0" * max(0, K - len(text)), np.uint8)
    n = len(data) - K + 1
    kmers = np.empty(n, U64)
    for a in range(min(K, n)):
        kmers[a::K] = np.frombuffer(data[a : a + (n - a + K - 1) // K * K].tobytes(), "<u8")
    low = (U64(1) << U64(max(1, int(n - 1).bit_length()))) - U64(1)
    with np.errstate(over="ignore"):
        h = mix64(kmers)
        keyed = np.sort((h & ~low) | np.arange(n, dtype=U64))  # equal k-mers stand together, in text order
        top = keyed & ~low
        again = np.flatnonzero(top[1:] == top[:-1]) + 1
        if len(again):
            # the place within its run: distance to the last place that isn't a repetition
            first = np.arange(n)
            first[again] = 0
            np.maximum.accumulate(first, out=first)
            pos = (keyed[again] & low).astype(np.int64)
            h[pos] = mix64(h[pos] + (again - first[again]).astype(U64) * U64(0x9E3779B97F4A7C15))
    return (h >> U64(32)).astype(U32)


class Orders:
    """Random orders of k-mers (by their hashes times an odd number), and the selection under them."""

    def __init__(self, sketches: int = SKETCHES, tuple_size: int = TUPLE, seed: int = SEED):
        self.n, self.size = sketches, tuple_size
        self.mult = ((seeds(sketches, seed + 1) >> U64(32)).astype(U32) | U32(1))[:, None]
        self.rows = np.arange(sketches)

    def smallest(self, h: np.ndarray, begin: int, end: int) -> np.ndarray:
        """uint64 [sketches, tuple_size at most]: rank << 32 | position of the least k-mers in [begin, end), equal ranks by position."""
        found = []
        with np.errstate(over="ignore"):
            for i in range(begin, end, STEP):
                part = _scratch(self.n, min(STEP, end - i))
                np.multiply(h[None, i : min(i + STEP, end)], self.mult, out=part)
                for _ in range(min(self.size, part.shape[1])):
                    first = part.argmin(axis=1)  # of equal ones the first in the text
                    found.append((part[self.rows, first].astype(U64) << U64(32)) | (i + first).astype(U64))
                    part[self.rows, first] = U32(0xFFFFFFFF)
        return self.least(found)

    def least(self, found: list[np.ndarray]) -> np.ndarray:
        if not found:
            return np.empty((self.n, 0), U64)
        best = np.stack(found, axis=1) if found[0].ndim == 1 else np.concatenate(found, axis=1)
        if best.shape[1] > self.size:
            best.partition(self.size - 1, axis=1)
            best = best[:, : self.size]
        return best

    def signature(self, h: np.ndarray, best: np.ndarray) -> np.ndarray:
        """uint32 per sketch of the selected k-mers, in text order."""
        chosen = np.sort((best & U64(0xFFFFFFFF)).astype(np.int64), axis=1)
        out = np.zeros(self.n, U64)
        with np.errstate(over="ignore"):
            for j in range(chosen.shape[1]):
                out = mix64(out * U64(0x100000001B3) + h[chosen[:, j]].astype(U64) + U64(j + 1))
        return (out >> U64(32)).astype(U32)

    def of(self, text: bytes, shared: int = 0) -> tuple[np.ndarray, np.ndarray, int]:
        """(signature, selection over the k-mers within the first `shared` bytes, their number), the latter two for after()."""
        h = numbered_kmers(text)
        n = min(len(h), max(0, shared - K + 1))
        head = self.smallest(h, 0, n)
        return self.signature(h, self.least([head, self.smallest(h, n, len(h))])), head, n

    def after(self, text: bytes, head: np.ndarray, n: int) -> np.ndarray:
        """The signature of a text whose first n k-mers are those that `head` was selected from."""
        h = numbered_kmers(text)
        return self.signature(h, self.least([head, self.smallest(h, n, len(h))]))


def order_minhash(text: bytes, sketches: int = SKETCHES, tuple_size: int = TUPLE, seed: int = SEED) -> np.ndarray:
    """uint32 per sketch; equal texts have equal ones. A text of fewer than k bytes has one k-mer, padded with zero bytes."""
    return Orders(sketches, tuple_size, seed).of(text)[0]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float(np.count_nonzero(a == b)) / len(a)


def to_hex(signature: np.ndarray) -> str:
    return signature.astype(">u4").tobytes().hex()


def fingerprints(docs: DataFrame, sketches: int = SKETCHES, tuple_size: int = TUPLE) -> DataFrame:
    """docs with `fingerprint`, a hexadecimal string. Null text counts as empty. Extra columns pass through."""

    @F.pandas_udf("string")
    def of(texts: pd.Series) -> pd.Series:
        orders = Orders(sketches, tuple_size)
        return texts.map(lambda t: to_hex(orders.of((t or "").encode("utf-8", "surrogatepass"))[0]))

    rest = [c for c in docs.columns if c.lower() != "fingerprint"]
    return docs.select(*rest, of("text").alias("fingerprint"))


NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
OUT = "doc_id {}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def ranges(docs: DataFrame, range_bytes: int) -> tuple[DataFrame, int]:
    """docs (doc_id, text, h) with `bucket`, rising along descending (doc_id, h), nulls last, and the number of buckets.

    Bounds are quantiles of doc_id. A doc_id that is several of them holds so many shares of the rows, and is cut further along
    h, the hash of the text; so are the rows without doc_id.
    """
    facts = docs.agg(F.sum(F.octet_length("text")).alias("bytes"), F.count("doc_id").alias("ids"), F.count(F.lit(1)).alias("n")).first()
    shares = max(1, ceil(facts.bytes / range_bytes))
    of_ids = max(1, ceil(shares * facts.ids / facts.n))
    cuts = docs.agg(F.percentile_approx("doc_id", [i / of_ids for i in range(1, of_ids)], 20 * of_ids)).first()[0] if of_ids > 1 and facts.ids else None
    rising = shared_array(docs.sparkSession, np.array(sorted(cuts or [])))  # a number per range
    of_nulls = max(1, shares - of_ids)

    @F.pandas_udf("int")
    def place(doc_id: pd.Series, h: pd.Series) -> pd.Series:
        bounds = rising.value
        out = np.zeros(len(h), np.int64)
        u = ((h.to_numpy(np.int64) >> 11) + (1 << 52)) / float(1 << 53)
        known = doc_id.notna().to_numpy()
        if known.any():
            ids = doc_id[known].to_numpy()
            ids = ids.astype(bounds.dtype) if len(bounds) else ids
            left, right = np.searchsorted(bounds, ids, "left"), np.searchsorted(bounds, ids, "right")
            out[known] = len(bounds) - right + np.floor(u[known] * (right - left + 1)).astype(np.int64)
        out[~known] = len(bounds) + np.floor(u[~known] * of_nulls).astype(np.int64)
        return pd.Series(out.astype(np.int32))

    return docs.withColumn("bucket", place("doc_id", "h")), len(cuts or []) + of_nulls


def edited_neighbours(docs: DataFrame, range_bytes: int = RANGE_BYTES, sketches: int = SKETCHES, tuple_size: int = TUPLE) -> DataFrame:
    """Each document's fingerprint against its half-edited text and against the next document.

    Next is by descending doc_id, nulls last, equal ids by a hash of the text; after the last comes the first. The last half of a
    text is replaced by as much of the next one's beginning. The rows are dealt by ranges of (doc_id, hash); each range also gets
    the first row of the range after it, so each task sees all neighbours while it streams its sorted rows, one text at a time.
    Only rows equal in both share a range whatever their number. An only document is its own next one; an empty table gives an
    empty table. Columns but doc_id and text are not read.
    """
    bounded_batches(docs.sparkSession)
    docs = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text")).withColumn("h", F.xxhash64("text"))
    kind = dict(docs.dtypes)["doc_id"]
    if docs.isEmpty():
        return docs.sparkSession.createDataFrame([], OUT.format(kind))
    dealt, buckets = ranges(docs, range_bytes)
    # nulls are the least of a struct, so the greatest (doc_id, not h) is the first row of a range
    firsts = dealt.groupBy("bucket").agg(F.max(F.struct("doc_id", F.bitwise_not("h").alias("g"))).alias("k")).toPandas().sort_values("bucket")  # a row a range
    places = firsts["bucket"].tolist()
    order = {b: places[i - 1] for i, b in enumerate(places)}  # the range that ends where this one begins; the first follows the last
    spark = docs.sparkSession
    keys = spark.createDataFrame([(int(b), int(order[b]), k["doc_id"], ~k["g"]) for b, k in zip(places, firsts["k"])], f"b int, to int, id {kind}, g long")
    first = docs.join(F.broadcast(keys), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("h") == F.col("g")))
    tails = first.groupBy("b", "to", "doc_id", "h").agg(F.min("text").alias("text")).select("doc_id", "text", "h", F.col("to").alias("bucket"), F.lit(1).alias("tail"))
    both = dealt.select("doc_id", "text", "h", "bucket", F.lit(0).alias("tail")).unionByName(tails)
    both = both.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket", "tail", F.col("doc_id").desc_nulls_last(), "h", "text")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orders = Orders(sketches, tuple_size)
        last = None  # id, bucket, text as code points, bytes of the half that stays, signature, selection, its k-mers
        for batch in batches:
            rows = []
            for doc_id, text, where, tail in zip(*(batch.column(i) for i in (0, 1, 3, 4))):
                raw, where, tail = text.as_py(), where.as_py(), tail.as_py()
                if tail:
                    own, doc = orders.of(raw)[0], None
                else:
                    chars = raw.decode("utf-8", "replace")
                    stays = chars[: len(chars) - len(chars) // 2].encode("utf-8")
                    own, head, n = orders.of(raw, len(stays))
                    doc = (doc_id.as_py(), where, raw, len(chars), stays, own, head, n)
                if last is not None and last[1] == where:
                    rows.append(edited_row(last, raw, own, orders))
                last = doc
            if rows:
                kinds = [batch.schema.field(0).type, pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], NAMES)

    return both.mapInArrow(released(stream), OUT.format(kind))


def edited_row(last: tuple, next_text: bytes, next_signature: np.ndarray, orders: Orders) -> tuple:
    doc_id, _, raw, n_chars, stays, own, head, n = last
    edited = stays + next_text[: 4 * (n_chars // 2)].decode("utf-8", "replace")[: n_chars // 2].encode("utf-8")
    signature = own if edited == raw else orders.after(edited, head, n)
    return doc_id, n_chars, hashlib.sha256(edited).hexdigest(), to_hex(own), to_hex(signature), likeness(own, signature), likeness(own, next_signature)
