"""Benchmark decontamination by spaced-seed hashing.

A seed is a span of words under a fixed mask; positions where the mask is 0 may differ. Benchmark items give a hash per
position and mask. Documents give the same hashes; those that a fixed-size bit filter of the benchmark's hashes lets through
are joined with the benchmark. Each joined hit fixes a diagonal (document position minus item position), along which the
item's words are compared with the document's: substitutions break single positions only, so an overlap around the hit is
accepted if enough of its positions agree.

Items too short for that have seeds of their own: an item shorter than every mask its whole sequence, one that may differ in s
words the s + 1 runs that it is cut into, of which one at least is always intact.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkgrid.llm.common import all_salts, bit_filter, bounded_batches, drop_ids, in_filter, released, row_groups, salt_of, text_buffers
from larkgrid.llm.tokens import U64, mix64, seeds, words

#: Fixed masks: 1 is compared, 0 is ignored. Weight 6 over spans of 6 to 11 words.
MASKS = ("111111", "11101011", "1101100101", "11001010011")
#: An overlap must agree in MIN_WORDS words and in MIN_IDENTITY of its positions; see needed() for short items.
MIN_WORDS, MIN_IDENTITY, FILTER_BITS = 12, 0.75, 1 << 23
#: The mask numbers of runs of k words are RUN + k, of whole items of k words WHOLE + k.
RUN, WHOLE = 1000, 2000


def needed(n: int, min_words: int, min_identity: float, shortest: int = len(MASKS[0])) -> int:
    """How many words of an item of n words must agree: all if it is shorter than every mask, else its share, min_words at most."""
    return n if n < shortest else min(min_words, ceil(min_identity * n - 1e-9))


def short_seeds(n: int, min_words: int, min_identity: float, shortest: int) -> list[tuple[int, int, int]]:
    """(mask number, position, words) of the further seeds of an item of n words."""
    need = needed(n, min_words, min_identity, shortest)
    if n < shortest:
        return [(WHOLE + n, 0, n)] if n else []
    if need >= min_words:
        return []
    cuts = [n * i // (n - need + 1) for i in range(n - need + 2)]
    return [(RUN + b - a, a, b - a) for a, b in zip(cuts, cuts[1:])]


def seed_hashes(h: np.ndarray, before: np.ndarray, mask: str, salt: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, position in the row) of every place where the mask fits into a row; a row shorter than the mask's span has none."""
    span = len(mask)
    mult = seeds(span + 1, 1000 + salt) | U64(1)
    counts = np.diff(before)
    with np.errstate(over="ignore"):
        n = max(0, len(h) - span + 1)
        value = np.zeros(n, U64)
        for i, bit in enumerate(mask):
            if bit == "1":
                value += h[i : i + n] * mult[i]
        row = np.repeat(np.arange(len(counts)), counts)
        at = np.arange(len(h)) - before[:-1][row]
        full = np.flatnonzero(counts[row] - at >= span)
        return mix64(value[full]), row[full], at[full]


def _texts(df: DataFrame, key: str) -> DataFrame:
    return df.where(F.col(key).isNotNull() & F.col("text").isNotNull()).select(F.col(key).alias("id"), "text")


def item_seeds(benchmark: DataFrame, masks: tuple = MASKS, min_words: int = MIN_WORDS, min_identity: float = MIN_IDENTITY) -> DataFrame:
    """(h, item_id, at, mask) of all seeds of the benchmark."""
    shortest = min(len(m) for m in masks)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            h, before = words(data, offsets)
            for m, mask in enumerate(masks):
                value, row, at = seed_hashes(h, before, mask, m)
                yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), batch.column(0).take(pa.array(row)), pa.array(at.astype(np.int32)), pa.array(np.full(len(row), m, np.int32))], ["h", "item_id", "at", "mask"])
            rows = []
            for r, (a, b) in enumerate(zip(before[:-1].tolist(), before[1:].tolist())):
                for number, at, k in short_seeds(b - a, min_words, min_identity, shortest):
                    value = seed_hashes(h[a + at : a + at + k], np.array([0, k]), "1" * k, number)[0]
                    rows.append((int(value.view(np.int64)[0]), r, at, number))
            if rows:
                value, row, at, number = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(value, pa.int64()), batch.column(0).take(pa.array(row)), pa.array(at, pa.int32()), pa.array(number, pa.int32())], ["h", "item_id", "at", "mask"])

    return _texts(benchmark, "item_id").mapInArrow(released(emit), f"h long, item_id {dict(benchmark.dtypes)['item_id']}, at int, mask int")


def find_hits(docs: DataFrame, seeds_of_items: DataFrame, masks: tuple = MASKS, bits: int = FILTER_BITS) -> DataFrame:
    """Distinct (doc_id, item_id, diagonal) where a document and an item share a seed."""
    shared = docs.sparkSession.sparkContext.broadcast(bit_filter(seeds_of_items, "h", bits))  # bits / 8 bytes
    kind = dict(docs.dtypes)["doc_id"]
    # a number per length of the short items' seeds
    short = sorted(r["mask"] for r in seeds_of_items.where(F.col("mask") >= RUN).select("mask").distinct().collect())
    searched = [*enumerate(masks), *((m, "1" * (m - (WHOLE if m >= WHOLE else RUN))) for m in short)]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            for i, j in row_groups(offsets):
                h, before = words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                for m, mask in searched:
                    value, row, at = seed_hashes(h, before, mask, m)
                    hit = in_filter(table, value)
                    if m >= WHOLE and len(hit):  # one place in a document is enough
                        hit = hit[np.sort(np.unique(np.stack([row[hit].astype(U64), value[hit]]), axis=1, return_index=True)[1])]
                    if len(hit):
                        yield pa.RecordBatch.from_arrays([pa.array(value[hit].view(np.int64)), batch.column(0).take(pa.array(row[hit] + i)), pa.array(at[hit].astype(np.int32)), pa.array(np.full(len(hit), m, np.int32))], ["h", "doc_id", "doc_at", "mask"])

    found = _texts(docs, "doc_id").mapInArrow(released(emit), f"h long, doc_id {kind}, doc_at int, mask int").withColumn("salt", salt_of("doc_id"))
    items = seeds_of_items.select("*", all_salts("salt"))
    return found.join(items, ["h", "mask", "salt"]).select("doc_id", "item_id", (F.col("doc_at") - F.col("at")).alias("diagonal")).distinct()


def overlap(doc: np.ndarray, item: np.ndarray, diagonal: int, min_words: int, min_identity: float) -> tuple[int, int, int, int] | None:
    """(first, last + 1, positions that agree, start in doc) of the best stretch of the item along the diagonal, or None.

    The best stretch maximises agreements minus a penalty of min_identity / (1 - min_identity) for each disagreement, so its
    share of agreements, and that of each of its ends, is at least min_identity. An item that needs fewer than min_words is
    taken from its first word that agrees to its last.
    """
    need = needed(len(item), min_words, min_identity)
    lo, hi = max(0, -diagonal), min(len(item), len(doc) - diagonal)
    if hi <= lo:
        return None
    same = item[lo:hi] == doc[lo + diagonal : hi + diagonal]
    total = np.concatenate([[0.0], np.cumsum(np.where(same, 1.0, -min_identity / (1 - min_identity)))])
    floor = np.minimum.accumulate(total)
    end = int(np.argmax(total - floor))
    start = int(np.flatnonzero(total[: end + 1] == floor[end])[0])
    if need < min_words and same.any():
        start, end = int(np.argmax(same)), len(same) - int(np.argmax(same[::-1]))
    agree = int(np.count_nonzero(same[start:end]))
    if agree < need or not agree or agree < min_identity * (end - start):
        return None
    return lo + start, lo + end, agree, lo + start + diagonal


def find_leaks(docs: DataFrame, benchmark: DataFrame, masks: tuple = MASKS, min_words: int = MIN_WORDS, min_identity: float = MIN_IDENTITY, bits: int = FILTER_BITS) -> DataFrame:
    """One row per document and benchmark item that share a passage: doc_id, item_id, n_same (words that agree), n_span
    (positions of the overlap), item_words, doc_at (word position).

    Rows without an id or text match nothing; empty tables give an empty table; equal rows are one. Ties between overlaps go to
    the earlier place. Very common passages cost one row per document and item; items of fewer than 15 words, one per place
    where a run of 2 to 4 of their words stands.
    """
    bounded_batches(docs.sparkSession)
    items = item_seeds(benchmark, masks, min_words, min_identity)
    hits = find_hits(docs, items, masks, bits)
    kind, item_kind = dict(docs.dtypes)["doc_id"], dict(benchmark.dtypes)["item_id"]
    by_pair = hits.groupBy("doc_id", "item_id").agg(F.collect_set("diagonal").alias("diagonals")).withColumn("salt", salt_of("doc_id"))
    texts = _texts(benchmark, "item_id").select(F.col("id").alias("item_id"), F.col("text").alias("item_text")).distinct().select("*", all_salts("salt"))
    by_doc = by_pair.join(texts, ["item_id", "salt"]).groupBy("doc_id").agg(F.collect_list(F.struct("item_id", "item_text", "diagonals")).alias("hits"))
    joined = docs.select(F.col("doc_id").alias("id"), "text").join(by_doc, F.col("id") == F.col("doc_id")).select("doc_id", "text", "hits")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in range(batch.num_rows):
                doc_id, cands = batch.column(0)[r].as_py(), batch.column(2)[r].as_py()
                d, offs = text_buffers(batch.column(1).slice(r, 1))
                doc = words(d, offs)[0]
                data, offsets = text_buffers(pa.array([c["item_text"] for c in cands], pa.string()))
                h, before = words(data, offsets)
                for k, c in enumerate(cands):
                    item = h[before[k] : before[k + 1]]
                    found = [(x[2], -x[3], x) for g in sorted(c["diagonals"]) if (x := overlap(doc, item, g, min_words, min_identity))]
                    if found:
                        start, end, agree, at = max(found)[2]
                        out.append((doc_id, c["item_id"], agree, end - start, len(item), at))
            if out:
                cols = list(zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], batch.schema.field(0).type), pa.array(cols[1], batch.schema.field(2).type.value_type.field("item_id").type), *[pa.array(c, pa.int64()) for c in cols[2:]]], ["doc_id", "item_id", "n_same", "n_span", "item_words", "doc_at"])

    leaks = joined.mapInArrow(released(verify), f"doc_id {kind}, item_id {item_kind}, n_same long, n_span long, item_words long, doc_at long")
    best = F.max(F.struct("n_same", (-F.col("doc_at")).alias("m"), "n_span", "item_words", "doc_at")).alias("b")  # equal items, equal documents
    return leaks.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.n_same", "b.n_span", "b.item_words", "b.doc_at")


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of docs that share no passage with the benchmark; rows without doc_id or text stay."""
    return drop_ids(docs, find_leaks(docs, benchmark, **options), "doc_id")
