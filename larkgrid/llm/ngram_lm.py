"""Language-model scoring with an Elias-Fano n-gram trie that is sharded over the cluster.

Texts are cut into blocks. A block sends its distinct words, with their training counts, to the shards of the word level, and
gets back identifiers (shards number their words by rank) and counts. From then on it holds these instead of its words. Then it
sends its distinct pairs (context, word) to the shards of the pair level. A shard of that level is a trie: contexts, pointers to
their successors and the successors themselves, relative to the context before, are rising sequences in Elias-Fano form, next to
8-bit codes of the smoothed probabilities. The shard maps it from a file, answers its requests by successor search and returns two
bytes per distinct pair. So the model is spread over all machines, nothing is pruned, and what moves is one number per distinct pair
of a block.

With order 3, shards of a third level do the same for triples. Their contexts, pairs of words, are named by hashes of as many bits
as a 64-bit key has beside the word; two contexts of a shard share a name with a probability of about one in a million.

What is sent to the pair and triple levels is by far the largest. It crosses the cluster twice, first for the discounts, which need
the counts of all shards, then for the answers, and is written to no table. Shuffles go with their step, the tables of words with the
last that reads them; the numbered blocks and the answers stay, as the result is read from them.

Smoothing is interpolated absolute discounting with three discounts per level: p(w|u) = alpha(u,w) + gamma(u) p(w), and likewise
p(w|t,u) = alpha(t,u,w) + gamma(t,u) p(w|u); p(unknown) is what the discounts of the word level leave. The start of a text has the
end token as its context, twice.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkgrid.llm.chosen_path import grouped
from larkgrid.llm.common import bounded_batches, delete_path, new_path, released, row_groups, shuffles_freed, text_buffers
from larkgrid.llm.elias_fano import EliasFano, encode, map_block, pack, squeeze, unsqueeze
from larkgrid.llm.tokens import U64, mix64, words

BLOCK_BYTES, TOKENS_PER_SHARD, LEAST_SHARDS, HOT_SPLIT = 1 << 22, 3_000_000, 48, 64
#: A word is hot, and its successors are spread, from this part of a shard's mean number of tokens.
HOT_PART = 16
#: Shards of the triple level for one of the pair level: a text has more distinct triples than pairs.
TRIPLE_SHARDS = 2
END = mix64(np.array([0xE0D], U64))[0]
#: Codes of log10 values: 1 to 255 stand for LOWEST to 0 in equal steps, 0 for nothing.
LOWEST = -10.0


def to_code(log10: np.ndarray) -> np.ndarray:
    return np.clip(np.rint((log10 - LOWEST) / -LOWEST * 254) + 1, 1, 255).astype(np.uint8)


_VALUE = np.concatenate([[0.0], 10.0 ** (LOWEST + np.arange(255) / 254 * -LOWEST)])


def discounts(n1: int, n2: int, n3: int, n4: int) -> np.ndarray:
    """What is taken from counts of 0, 1, 2 and more; each at least 0.05 and less than its count."""
    y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    d = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return np.array([0.0, *(min(max(x, 0.05), k - 0.05) for k, x in zip((1, 2, 3), d))])


def discounted(counts: np.ndarray, d: np.ndarray) -> np.ndarray:
    return counts - d[np.minimum(counts, 3).astype(np.int64)]


def blocks(docs: DataFrame, shards: int) -> DataFrame:
    """docs: key, train (boolean), text. One row per block: keys, train flags, tokens per text (end included), distinct words by shard
    and value, the number of the end token among them, and the texts as such numbers."""
    kind = dict(docs.dtypes)["key"]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            data, offsets = text_buffers(batch.column(2))
            train = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for i, j in row_groups(offsets, BLOCK_BYTES):
                h, before = words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                h = np.insert(h, before[1:], END)
                codes, uniques = pd.factorize(h)
                order = np.lexsort((uniques, uniques % U64(shards)))
                number_of = np.empty_like(order)
                number_of[order] = np.arange(len(order))
                codes, uniques = number_of[codes], uniques[order]
                keys = pa.ListArray.from_arrays(pa.array([0, j - i], pa.int32()), batch.column(0).slice(i, j - i))
                sizes = np.diff(before) + 1
                tokens = np.bincount(codes, weights=np.repeat(train[i:j], sizes), minlength=len(uniques))
                number += 1
                end = np.flatnonzero(uniques == END)
                blobs = (np.packbits(train[i:j]).tobytes(), squeeze(sizes), squeeze(uniques, True), squeeze(tokens), squeeze(codes))
                yield pa.RecordBatch.from_arrays([pa.array([number]), keys, pa.array(end, pa.int64()), *[pa.array([x], pa.binary()) for x in blobs]], ["block", "keys", "end", "train", "sizes", "words", "counts", "codes"])

    return docs.mapInArrow(released(emit), f"block long, keys array<{kind}>, end long, train binary, sizes binary, words binary, counts binary, codes binary")


def _rows(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys with a positive sum of counts, sorted, and the sums."""
    k, c = np.concatenate(keys), np.concatenate(counts)
    k, c = k[c > 0], c[c > 0]
    order = np.argsort(k)
    k, c = k[order], c[order]
    if not len(k):
        return k, c
    starts = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    return k[starts], np.add.reduceat(c, starts)


def together(asked: list[np.ndarray], search) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The two answers to each of several lists of keys, all searched in one pass over the level."""
    sizes = [len(a) for a in asked]
    keys = np.concatenate(asked)
    order = np.argsort(keys)
    found = []
    for answer in search(keys[order]):
        back = np.empty_like(answer)
        back[order] = answer
        found.append(back)
    ends = np.cumsum(sizes)
    for a, b in zip(ends - sizes, ends):
        yield found[0][a:b], found[1][a:b]


def word_level(blocks_: DataFrame, shards: int, parts: int) -> DataFrame:
    """Requests and answers of the words: per block and shard (block, shard, n, known, ids, counts), and a row with block -1 per shard with its statistics."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                uniques, counts = unsqueeze(batch.column(1)[r].as_py(), True), unsqueeze(batch.column(2)[r].as_py())
                rows = []
                for s, at in by_shard(uniques % U64(shards), uniques):
                    rows.append((s, batch.column(0)[r].as_py(), squeeze(uniques[at], True), squeeze(counts[at])))
                yield _rows(rows, ["shard", "block", "words", "counts"], [pa.int64(), pa.int64(), pa.binary(), pa.binary()])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["block", "shard", "n", "known", "ids", "counts", "stats"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64())]
        for group in grouped(batches):
            shard = group.column("shard")[0].as_py()
            asked = [unsqueeze(x.as_py(), True) for x in group.column("words")]
            hashes, counts = merged(asked, [unsqueeze(x.as_py()) for x in group.column("counts")])
            level = EliasFano(encode(hashes))  # the words of this shard, held compact while it answers
            del hashes
            stats = [len(counts), int(counts.sum()), *(int(np.count_nonzero(counts == k)) for k in (1, 2, 3, 4))]
            yield _rows([(-1, shard, None, None, None, None, stats)], names, kinds)
            for block, (at, equal) in zip(group.column("block").to_pylist(), together(asked, level.successor)):
                yield _rows([(block, shard, len(equal), np.packbits(equal).tobytes(), squeeze(at[equal], True), squeeze(counts[at[equal]]), None)], names, kinds)

    sent = blocks_.select("block", "words", "counts").mapInArrow(released(ask), "shard long, block long, words binary, counts binary")
    sent = sent.repartition(parts, "shard").sortWithinPartitions("shard", "block")
    return sent.mapInArrow(released(answer), "block long, shard long, n long, known binary, ids binary, counts binary, stats array<long>")


def hot_words(answered: DataFrame, shards: int, hot: float) -> dict[int, int]:
    """Identifier and training count of every word with more than `hot` occurrences, read from the answers. As each is a part of a
    shard's mean tokens, there are at most HOT_PART for each shard."""

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for shard, ids, counts in zip(*(c.to_pylist() for c in batch.columns)):
                n = unsqueeze(counts).astype(np.int64)
                at = np.flatnonzero(n > hot)
                if len(at):
                    found.extend(zip((unsqueeze(ids, True)[at].astype(np.int64) * shards + shard).tolist(), n[at].tolist()))
            if found:
                yield _rows(found, ["id", "n"], [pa.int64(), pa.int64()])

    rows = answered.where("block >= 0").select("shard", "ids", "counts").mapInArrow(released(pick), "id long, n long")
    return {r.id: r.n for r in rows.distinct().collect()}


def by_shard(shard: np.ndarray, order_by: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, indices in rising order of order_by) for each shard that occurs."""
    order = np.lexsort((order_by, shard))
    s = shard[order]
    starts = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else []
    for a, b in zip(starts, [*starts[1:], len(s)]):
        yield int(s[a]), order[a:b]


def numbered(joined: DataFrame, shards: int, unknown: int) -> DataFrame:
    """joined: blocks with the answers of the word level. Blocks with identifiers and counts instead of words."""
    names = ["block", "keys", "end", "train", "sizes", "codes"]

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                ids, counts = [], []
                for a in sorted(batch.column(len(names))[r].as_py(), key=lambda a: a["shard"]):  # the order of a block's words
                    known = np.unpackbits(np.frombuffer(a["known"], np.uint8), count=a["n"]).astype(bool)
                    ids.append(np.full(a["n"], unknown, U64))
                    ids[-1][known] = unsqueeze(a["ids"], True) * U64(shards) + U64(a["shard"])
                    counts.append(np.zeros(a["n"], U64))
                    counts[-1][known] = unsqueeze(a["counts"])
                blobs = [pa.array([squeeze(np.concatenate(x))], pa.binary()) for x in (ids, counts)]
                yield pa.RecordBatch.from_arrays([*[batch.column(i).slice(r, 1) for i in range(len(names))], *blobs], [*names, "ids", "counts"])

    kinds = dict(joined.dtypes)
    return joined.select(*names, "answers").mapInArrow(released(settle), ", ".join(f"{n} {kinds[n]}" for n in names) + ", ids binary, counts binary")


class Block:
    """A block with the identifiers and counts of its words, and its distinct pairs."""

    def __init__(self, row: dict, hot: float):
        self.ids, self.counts = unsqueeze(row["ids"]), unsqueeze(row["counts"]).astype(np.int64)
        self.codes = unsqueeze(row["codes"]).astype(np.int64)
        self.sizes = unsqueeze(row["sizes"]).astype(np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)[:-1]])
        self.train = np.unpackbits(np.frombuffer(row["train"], np.uint8), count=len(self.sizes)).astype(bool)
        context = np.empty_like(self.codes)
        context[1:] = self.codes[:-1]
        context[self.starts] = row["end"]
        # distinct pairs, only of known contexts; all unknown words are one
        word = np.where(self.counts > 0, np.arange(len(self.ids)), len(self.ids))[self.codes]
        local = context * (len(self.ids) + 1) + word
        self.pair, pairs = pd.factorize(local)
        self.u, self.w = pairs // (len(self.ids) + 1), pairs % (len(self.ids) + 1)
        self.ask = np.flatnonzero(self.counts[self.u] > 0)
        self.hot, self.word = hot, word

    def triples(self) -> None:
        """Distinct triples, as a pair that is the context (the number of pairs at the start of a text), and the pair that ends them."""
        context = np.empty_like(self.pair)
        context[1:] = self.pair[:-1]
        context[self.starts] = len(self.u)
        local = context.astype(np.int64) * (len(self.ids) + 1) + self.word
        self.triple, distinct = pd.factorize(local)
        self.t_context, self.t_word = distinct // (len(self.ids) + 1), distinct % (len(self.ids) + 1)
        self.t_pair = np.empty(len(distinct), np.int64)
        self.t_pair[self.triple] = self.pair
        known = np.append((self.counts[self.u] > 0) & (self.w < len(self.ids)), True)
        self.t_ask = np.flatnonzero(known[self.t_context])

    def triple_keys(self, unknown: int, bits: int, shards: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(shard, triple numbers, keys rising) for each shard of the triple level."""
        ids = np.append(self.ids, U64(unknown))
        with np.errstate(over="ignore"):
            named = mix64(mix64(ids[np.append(self.u, len(self.ids))]) + ids[np.append(self.w, len(self.ids))])
        h = named[self.t_context[self.t_ask]]
        key = (h >> U64(bits) << U64(bits)) | ids[self.t_word[self.t_ask]]
        for s, at in by_shard((h & ((U64(1) << U64(bits)) - U64(1))) % U64(shards), key):
            yield s, self.t_ask[at], key[at]

    def keys(self, unknown: int, bits: int, shards: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(shard, pair numbers, keys rising) for each shard of the pair level."""
        u, w = self.ids[self.u[self.ask]], np.append(self.ids, U64(unknown))[self.w[self.ask]]
        key = (u << U64(bits)) | w
        part = np.where(self.counts[self.u[self.ask]] > self.hot, (w % U64(HOT_SPLIT)) + U64(1), U64(0))
        with np.errstate(over="ignore"):
            shard = mix64(u * U64(HOT_SPLIT + 1) + part) % U64(shards)
        for s, at in by_shard(shard, key):
            yield s, self.ask[at], key[at]


def build_trie(keys: np.ndarray, counts: np.ndarray, bits: int, d: np.ndarray, hot: dict[int, tuple[float, float]]) -> bytes:
    """The pair level of one shard, packed for mapping. hot: (count, gamma) of contexts whose successors are spread over shards."""
    u = keys >> U64(bits)
    starts = np.flatnonzero(np.concatenate([[True], u[1:] != u[:-1]])) if len(u) else np.zeros(0, np.int64)
    contexts = u[starts]
    ends = np.append(starts[1:], len(u))
    rest = discounted(counts.astype(np.int64), d)
    totals = np.add.reduceat(counts.astype(np.float64), starts) if len(u) else np.zeros(0)
    gamma = (totals - np.add.reduceat(rest, starts)) / totals if len(u) else np.zeros(0)
    for i in np.flatnonzero(np.isin(contexts, np.array(list(hot), U64))) if hot else ():
        totals[i], gamma[i] = hot[int(contexts[i])]
    alpha = rest / np.repeat(totals, ends - starts)
    # relative successors: each context's begin where those of the context before end
    w = keys & ((U64(1) << U64(bits)) - U64(1))
    lasts = w[ends - 1] + U64(1) if len(u) else np.zeros(0, U64)
    base = np.concatenate([[U64(0)], np.cumsum(lasts, dtype=U64)]).astype(U64)
    relative = w + np.repeat(base[:-1], ends - starts)
    levels = {"context": encode(contexts), "pointer": encode(np.append(starts, len(u)).astype(U64)), "base": encode(base), "successor": encode(relative)}
    arrays = {f"{k}.{p}": a for k, parts in levels.items() for p, a in parts.items()}
    return pack(arrays | {"alpha": to_code(np.log10(np.maximum(alpha, 1e-30))), "gamma": to_code(np.log10(np.maximum(gamma, 1e-30)))})


class Trie:
    """The pair level of one shard, memory-mapped."""

    def __init__(self, block: bytes, bits: int, hot: dict[int, tuple[float, float]]):
        self.hot = np.array(sorted(hot), U64)
        self.hot_gamma = to_code(np.log10([max(hot[u][1], 1e-30) for u in sorted(hot)])) if hot else np.zeros(0, np.uint8)
        arrays = map_block(block)
        level = lambda k: EliasFano({p: arrays[f"{k}.{p}"] for p in ("head", "low", "high", "at")})
        self.context, self.pointer, self.base, self.successor = (level(k) for k in ("context", "pointer", "base", "successor"))
        self.alpha, self.gamma, self.bits = arrays["alpha"], arrays["gamma"], bits

    def query(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of alpha and gamma for rising keys; alpha is 0 for pairs, and gamma for contexts, that the trie lacks."""
        alpha, gamma = np.zeros(len(keys), np.uint8), np.zeros(len(keys), np.uint8)
        if len(self.hot):  # also where this shard has no successor of them
            u = keys >> U64(self.bits)
            at = np.minimum(np.searchsorted(self.hot, u), len(self.hot) - 1)
            gamma = np.where(self.hot[at] == u, self.hot_gamma[at], gamma)
        at, found = self.context.successor(keys >> U64(self.bits))
        q = np.flatnonzero(found)
        if not len(q):
            return alpha, gamma
        ctx = at[q]
        gamma[q] = self.gamma[ctx]
        # context-relative successor search within [pointer, next pointer)
        target = (keys[q] & ((U64(1) << U64(self.bits)) - U64(1))) + self.base.at_index(ctx)
        inside = target < self.base.at_index(ctx + 1)
        q, ctx, target = q[inside], ctx[inside], target[inside]
        where, equal = self.successor.successor(target)
        equal &= (where >= self.pointer.at_index(ctx).astype(np.int64)) & (where < self.pointer.at_index(ctx + 1).astype(np.int64))
        alpha[q[equal]] = self.alpha[where[equal]]
        return alpha, gamma


def requests(known: DataFrame, shards: int, unknown: int, bits: int, hot: float, parts: int, order: int) -> DataFrame:
    """The distinct pairs and triples of all blocks with their training counts, by shard. The shards of the triple level follow those of
    the pair level."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                b = Block(row, hot)
                counts = np.bincount(b.pair, weights=np.repeat(b.train, b.sizes), minlength=len(b.u)).astype(np.int64)
                rows = [(s, row["block"], squeeze(key, True), squeeze(counts[at])) for s, at, key in b.keys(unknown, bits, shards)]
                if order > 2:
                    b.triples()
                    counts = np.bincount(b.triple, weights=np.repeat(b.train, b.sizes), minlength=len(b.t_word)).astype(np.int64)
                    rows += [(shards + s, row["block"], squeeze(key, True), squeeze(counts[at])) for s, at, key in b.triple_keys(unknown, bits, TRIPLE_SHARDS * shards)]
                if rows:
                    yield _rows(rows, ["shard", "block", "pairs", "counts"], [pa.int64(), pa.int64(), pa.binary(), pa.binary()])

    sent = known.drop("keys").mapInArrow(released(ask), "shard long, block long, pairs binary, counts binary")
    return sent.repartition(parts, "shard").sortWithinPartitions("shard", "block")


def merged_group(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Distinct training keys of the requests to one shard, and their counts."""
    return merged([unsqueeze(x.as_py(), True) for x in group.column("pairs")], [unsqueeze(x.as_py()).astype(np.int64) for x in group.column("counts")])


def statistics(sent: DataFrame, shards: int, bits: int, hot_ids: list[int]) -> DataFrame:
    """Per shard: the numbers of keys that occur once to four times, and for each hot context those of its successors here that occur
    once, twice and more often."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches):
            shard = group.column("shard")[0].as_py()
            keys, counts = merged_group(group)
            stats = [int(np.count_nonzero(counts == k)) for k in (1, 2, 3, 4)]
            mine = np.isin(keys >> U64(bits), np.array(hot_ids if shard < shards else [], U64))
            spread = []
            if mine.any():
                u, kind = (keys[mine] >> U64(bits)).astype(np.int64), np.minimum(counts[mine], 3)
                for x in np.unique(u).tolist():
                    spread.append([x, *(int(np.count_nonzero(kind[u == x] == k)) for k in (1, 2, 3))])
            yield _rows([(shard, stats, spread)], ["shard", "stats", "spread"], [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.list_(pa.int64()))])

    return sent.mapInArrow(released(count), "shard long, stats array<long>, spread array<array<long>>")


def answers_of_pairs(sent: DataFrame, shards: int, bits: int, d: np.ndarray, d_triple: np.ndarray, hot: dict[int, tuple[float, float]]) -> DataFrame:
    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches):
            shard = group.column("shard")[0].as_py()
            own, spread = (d, hot) if shard < shards else (d_triple, {})
            trie = Trie(build_trie(*merged_group(group), bits, own, spread), bits, spread)
            rows = []
            asked = [unsqueeze(x.as_py(), True) for x in group.column("pairs")]
            for block, (alpha, gamma) in zip(group.column("block").to_pylist(), together(asked, trie.query)):
                rows.append((block, shard, squeeze(alpha), squeeze(gamma)))
                if len(rows) == 64:
                    yield _rows(rows, ["block", "shard", "alpha", "gamma"], [pa.int64(), pa.int64(), pa.binary(), pa.binary()])
                    rows = []
            if rows:
                yield _rows(rows, ["block", "shard", "alpha", "gamma"], [pa.int64(), pa.int64(), pa.binary(), pa.binary()])

    return sent.mapInArrow(released(answer), "block long, shard long, alpha binary, gamma binary")


def written(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """df, written to the shared folder and read back, and its path. No shuffle files are left."""
    path = new_path(df.sparkSession, label)
    with shuffles_freed(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


SCORES = "n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score_texts(docs: DataFrame, key: str, train: Column, order: int = 3) -> DataFrame:
    """(key, train, n_tokens, n_known, train_tokens, base_score, score) per row of docs (key, text); the model learns from rows where train is true.

    Null and empty texts have the end token alone. base_score is of additive smoothing over words (0.5 each, one unknown word
    more), score of the trie; both in log10. Without training rows all words are unknown and scores are 0. Rows are kept one to
    one, with null and repeated keys; an empty table gives an empty table. Texts are scored whole; one of more than BLOCK_BYTES is a
    block of its own. Columns but the key, text and what train needs are not read.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.col(key).alias("key"), train.alias("train"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    kind = dict(rows.dtypes)["key"]
    n_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(LEAST_SHARDS, ceil(n_bytes / 6 / TOKENS_PER_SHARD))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    all_blocks, blocks_path = written(blocks(rows, shards), "lm-blocks")
    answered, words_path = written(word_level(all_blocks, shards, parts), "lm-words")
    stats = answered.where("block = -1").select(*[F.col("stats")[i].alias(f"s{i}") for i in range(6)]).agg(F.max("s0"), *[F.sum(f"s{i}") for i in range(6)]).first()
    widest, n_words, n_train, *ones = (int(x or 0) for x in stats)
    unknown = (widest + 1) * shards
    bits = max(1, unknown.bit_length())
    if 2 * bits > 64:
        raise ValueError("more than 2**32 words; give shards a wider key")
    hot = n_train / (shards * HOT_PART)
    top_counts = hot_words(answered, shards, hot)
    heard = answered.where("block >= 0").groupBy("block").agg(F.collect_list(F.struct("shard", "n", "known", "ids", "counts")).alias("answers"))
    known, _ = written(numbered(all_blocks.drop("words", "counts").join(heard, "block"), shards, unknown), "lm-numbered")
    delete_path(spark, blocks_path)
    delete_path(spark, words_path)
    sent = requests(known, shards, unknown, bits, hot, parts, order)
    level, _ = written(statistics(sent, shards, bits, list(top_counts)), "lm-counts")
    of_level = lambda own: discounts(*[int(x or 0) for x in level.where(own).agg(*[F.sum(F.col("stats")[i]) for i in range(4)]).first()])
    d_word, d_pair, d_triple = discounts(*ones), of_level(F.col("shard") < shards), of_level(F.col("shard") >= shards)
    spread = level.select(F.explode("spread").alias("s")).groupBy(F.col("s")[0].alias("u")).agg(*[F.sum(F.col("s")[i]).alias(f"n{i}") for i in (1, 2, 3)]).collect()  # as many as top_counts
    hot_gamma = {r.u: (float(top_counts[r.u]), float(np.dot([r.n1, r.n2, r.n3], d_pair[1:]) / top_counts[r.u])) for r in spread}
    pair_answers, _ = written(answers_of_pairs(sent, shards, bits, d_pair, d_triple, hot_gamma), "lm-answers")
    heard2 = pair_answers.groupBy("block").agg(F.collect_list(F.struct("shard", "alpha", "gamma")).alias("pair_answers"))
    final = known.join(heard2, "block", "left")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = {n: i for i, n in enumerate(["block", "keys", "end", "train", "sizes", "codes", "ids", "counts", "pair_answers"])}
        kinds = [pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        p_unknown = float(np.dot([ones[0], ones[1], n_words - ones[0] - ones[1]], d_word[1:]) / n_train) if n_train else 1.0
        for batch in batches:
            for r in range(batch.num_rows):
                row = {n: batch.column(i)[r].as_py() for n, i in at.items() if n != "keys"}
                b = Block(row, hot)
                c = b.counts
                p = np.where(c > 0, discounted(c, d_word) / max(n_train, 1), p_unknown)
                p = np.append(_VALUE[to_code(np.log10(np.maximum(p, 1e-30)))], _VALUE[to_code(np.log10([max(p_unknown, 1e-30)]))])
                alpha, gamma = np.zeros(len(b.u), np.uint8), np.full(len(b.u), 255, np.uint8)
                heard_of = {a["shard"]: a for a in row["pair_answers"] or ()}
                for s, pairs, _ in b.keys(unknown, bits, shards):
                    alpha[pairs], gamma[pairs] = unsqueeze(heard_of[s]["alpha"]), unsqueeze(heard_of[s]["gamma"])
                by_pair = _VALUE[alpha] + _VALUE[np.where(gamma == 0, 255, gamma)] * p[b.w]
                of_token = np.log10(by_pair)[b.pair]
                if order > 2:
                    b.triples()
                    alpha, gamma = np.zeros(len(b.t_word), np.uint8), np.zeros(len(b.t_word), np.uint8)
                    for s, triples, _ in b.triple_keys(unknown, bits, TRIPLE_SHARDS * shards):
                        alpha[triples], gamma[triples] = unsqueeze(heard_of[shards + s]["alpha"]), unsqueeze(heard_of[shards + s]["gamma"])
                    of_token = np.log10(_VALUE[alpha] + _VALUE[np.where(gamma == 0, 255, gamma)] * by_pair[b.t_pair])[b.triple]
                base = np.log10((c + 0.5) / (n_train + 0.5 * (n_words + 1)))
                per_text = lambda v: np.add.reduceat(v, b.starts)
                cols = [b.train, b.sizes, per_text((c > 0).astype(np.int64)[b.codes]), np.full(len(b.sizes), n_train), per_text(base[b.codes]), per_text(of_token)]
                yield pa.RecordBatch.from_arrays([batch.column(at["keys"])[r].values, *[pa.array(x, k) for x, k in zip(cols, kinds)]], [key, "train", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    final = final.select("block", "keys", "end", "train", "sizes", "codes", "ids", "counts", "pair_answers")
    return final.mapInArrow(released(score), f"{key} {kind}, train boolean, {SCORES}")
