"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained and run in numpy.

A word enters as its own vector (words of the training sample) next to a vector pooled from its characters (the maximum over
its character n-grams, word ends marked), so unseen forms of a known stem are recognised. A text is cut into overlapping
windows; each window's states, read in both directions, are pooled by learnt attention into a logit; a text's logit is the
largest of its windows. Training passes the gradient to that window. Word and n-gram vectors start with their smoothed log
odds in the first place and small random numbers in the others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkgrid.llm.common import bounded_batches, released, row_groups, text_buffers
from larkgrid.llm.tokens import LOWER, U64, hashes, mix64, spans

WINDOW, STRIDE, HIDDEN, ATTEND, WORD_DIM, CHAR_DIM, CHAR_BINS = 48, 32, 16, 8, 6, 6, 1 << 16
N_GRAMS = (4, 5, 6)
#: About so many labelled rows of each class, and bytes of all their texts, are used for training at most; of any length, and whole.
FIT_POSITIVE, FIT_NEGATIVE, FIT_BYTES, EPOCHS, BATCH = 1000, 2000, 24_000_000, 4, 64
_PUNCT = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, without ASCII marks at their ends (words of marks alone are left whole), and the number before each row."""
    starts, ends, before = spans(data, offsets)
    if not len(starts):
        return starts, ends, before
    s, e = starts.copy(), ends.copy()
    for _ in range(4):
        s += (e - s > 1) & _PUNCT[data[s]]
        e -= (e - s > 1) & _PUNCT[data[e - 1]]
    return s, e, before


def char_bins(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, step: int = 1 << 14) -> tuple[np.ndarray, np.ndarray]:
    """Bins of the character n-grams of each word, word ends marked, and where each word's begin. Every word has one at least. Works through `step` words at a time."""
    parts = [_char_bins(data, starts[i : i + step], ends[i : i + step]) for i in range(0, len(starts), step)]
    if not parts:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    shift = np.cumsum([0, *(len(b) for b, _ in parts[:-1])])
    return np.concatenate([b for b, _ in parts]), np.concatenate([a + k for (_, a), k in zip(parts, shift)])


def _char_bins(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = ends - starts
    at = np.concatenate([[0], np.cumsum(n + 2)])
    buf = np.full(int(at[-1]) + max(N_GRAMS), 0x02, np.uint8)
    inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    buf[np.repeat(at[:-1] + 1, n) + inner] = LOWER[data[np.repeat(starts, n) + inner]]
    buf[at[1:] - 1] = 0x03
    size = n + 2
    values, owner = [], []
    pos = np.arange(int(at[-1]))
    word = np.repeat(np.arange(len(n)), size)
    left = at[1:][word] - pos
    for g in N_GRAMS:
        ok = np.flatnonzero((left >= g) | ((pos == at[:-1][word]) & (g == N_GRAMS[0])))  # a short word is one n-gram
        code = np.zeros(len(ok), U64)
        with np.errstate(over="ignore"):
            for i in range(g):
                inside = i < left[ok]
                code = code * U64(257) + np.where(inside, buf[np.minimum(ok + i, len(buf) - 1)], 0).astype(U64)
            values.append(mix64(code + U64(g)) % U64(CHAR_BINS))
        owner.append(word[ok])
    values, owner = np.concatenate(values), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return values[order].astype(np.int32), np.searchsorted(owner[order], np.arange(len(n)))


def windows(before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and lengths of all windows, and their rows. Rows without words have none."""
    counts = np.diff(before)
    per = np.where(counts > 0, np.maximum(0, -(-(counts - WINDOW) // STRIDE)) + 1, 0)
    row = np.repeat(np.arange(len(counts)), per)
    nth = np.arange(int(per.sum())) - np.repeat(np.cumsum(per) - per, per)
    start = nth * STRIDE
    return before[:-1][row] + start, np.minimum(WINDOW, counts[row] - start), row


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


class Network:
    """Parameters in self.p; vectors of words in word, by rank of their hash in vocab (0: none), of n-gram bins in char."""

    def __init__(self, vocab: np.ndarray, word_odds: np.ndarray, char_odds: np.ndarray, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.vocab = vocab
        small = lambda *s: (rng.standard_normal(s) * 0.1).astype(np.float32)
        dim = WORD_DIM + CHAR_DIM
        scale = lambda a, b: (rng.standard_normal((a, b)) / np.sqrt(a)).astype(np.float32)
        self.p = {"word": small(len(vocab) + 1, WORD_DIM) * 0.3, "char": small(CHAR_BINS, CHAR_DIM) * 0.3}
        self.p["word"][1:, 0], self.p["word"][0] = word_odds, 0
        self.p["char"][:, 0] = char_odds
        for d in "fb":
            self.p |= {f"W{d}": scale(dim, 3 * HIDDEN), f"U{d}": scale(HIDDEN, 3 * HIDDEN), f"c{d}": np.zeros(3 * HIDDEN, np.float32)}
        self.p |= {"A": scale(2 * HIDDEN, ATTEND), "a": np.zeros(ATTEND, np.float32), "v": small(ATTEND, 1) * 5, "out": scale(2 * HIDDEN, 1), "bias": np.array([-1.0], np.float32)}

    def ranks(self, h: np.ndarray) -> np.ndarray:
        if not len(self.vocab):
            return np.zeros(len(h), np.int64)
        at = np.minimum(np.searchsorted(self.vocab, h), len(self.vocab) - 1)
        return np.where(self.vocab[at] == h, at + 1, 0)

    def inputs(self, ranks: np.ndarray, bins: np.ndarray, begins: np.ndarray) -> np.ndarray:
        return np.concatenate([self.p["word"][ranks], np.maximum.reduceat(self.p["char"][bins], begins, axis=0)], axis=1)

    def run(self, ids: np.ndarray, lengths: np.ndarray, gates: dict[str, np.ndarray], keep: bool = False) -> tuple[np.ndarray, dict]:
        """Logits of windows. ids: [WINDOW, windows] into the rows of gates (input projections); lengths must not rise."""
        p, n = self.p, ids.shape[1]
        active = np.searchsorted(-lengths, -np.arange(WINDOW), side="left")  # windows longer than t
        states = np.zeros((WINDOW, n, 2 * HIDDEN), np.float32)
        trace: dict = {"f": {}, "b": {}}
        for d, order, part in (("f", range(WINDOW), slice(0, HIDDEN)), ("b", range(WINDOW - 1, -1, -1), slice(HIDDEN, 2 * HIDDEN))):
            h = np.zeros((n, HIDDEN), np.float32)
            for t in order:
                k = active[t]
                if not k:
                    continue
                old = h[:k]
                x, g = gates[d][ids[t, :k]], old @ p[f"U{d}"]
                zr = sigmoid(x[:, : 2 * HIDDEN] + g[:, : 2 * HIDDEN])
                z, r, gn = zr[:, :HIDDEN], zr[:, HIDDEN:], g[:, 2 * HIDDEN :]
                new = np.tanh(x[:, 2 * HIDDEN :] + r * gn)
                out = new + z * (old - new)
                if keep:
                    trace[d][t] = (old.copy(), z, r, gn, new)
                h[:k] = out
                states[t, :k, part] = out
        hidden = np.tanh(states.reshape(-1, 2 * HIDDEN) @ p["A"] + p["a"])
        weight = (hidden @ p["v"]).reshape(WINDOW, n)
        weight[np.arange(WINDOW)[:, None] >= lengths[None, :]] = -1e30
        weight = np.exp(weight - weight.max(axis=0))
        weight /= weight.sum(axis=0)
        pooled = np.einsum("tn,tnh->nh", weight, states)
        if keep:
            trace |= {"states": states, "hidden": hidden, "weight": weight, "pooled": pooled, "active": active}
        return (pooled @ p["out"])[:, 0] + p["bias"][0], trace

    def gradients(self, ids: np.ndarray, trace: dict, d_logit: np.ndarray) -> tuple[dict, dict[str, np.ndarray]]:
        """Of the parameters but word and char, and of the input projections [WINDOW, windows, 3 HIDDEN] by direction."""
        p, n = self.p, ids.shape[1]
        states, hidden, weight, pooled, active = (trace[k] for k in ("states", "hidden", "weight", "pooled", "active"))
        g = {"bias": d_logit.sum(keepdims=True), "out": pooled.T @ d_logit[:, None]}
        d_pooled = d_logit[:, None] * p["out"][:, 0]
        d_states = weight[:, :, None] * d_pooled
        d_weight = np.einsum("nh,tnh->tn", d_pooled, states)
        d_score = weight * (d_weight - (weight * d_weight).sum(axis=0))
        g["v"] = hidden.T @ d_score.reshape(-1, 1)
        d_hidden = d_score.reshape(-1, 1) * p["v"][:, 0] * (1 - hidden**2)
        g["A"], g["a"] = states.reshape(-1, 2 * HIDDEN).T @ d_hidden, d_hidden.sum(axis=0)
        d_states = d_states + (d_hidden @ p["A"].T).reshape(WINDOW, n, 2 * HIDDEN)
        d_gates = {}
        for d, order, part in (("f", range(WINDOW - 1, -1, -1), slice(0, HIDDEN)), ("b", range(WINDOW), slice(HIDDEN, 2 * HIDDEN))):
            dh, dx_all, du = np.zeros((n, HIDDEN), np.float32), np.zeros((WINDOW, n, 3 * HIDDEN), np.float32), np.zeros_like(p[f"U{d}"])
            for t in order:
                k = active[t]
                if not k:
                    continue
                old, z, r, gn, new = trace[d][t]
                dh_t = dh[:k] + d_states[t, :k, part]
                d_new = dh_t * (1 - z) * (1 - new**2)
                dz = dh_t * (old - new) * z * (1 - z)
                dr = d_new * gn * r * (1 - r)
                dg = np.concatenate([dz, dr, d_new * r], axis=1)
                dx_all[t, :k] = np.concatenate([dz, dr, d_new], axis=1)
                du += old.T @ dg
                dh[:k] = dh_t * z + dg @ p[f"U{d}"].T
            g[f"U{d}"], d_gates[d] = du, dx_all
        return g, d_gates

    def gates(self, x: np.ndarray) -> dict[str, np.ndarray]:
        return {d: x @ self.p[f"W{d}"] + self.p[f"c{d}"] for d in "fb"}


def window_ids(token_ids: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    at = starts[None, :] + np.minimum(np.arange(WINDOW)[:, None], lengths[None, :] - 1)
    return token_ids[at]


def score_rows(net: Network, data: np.ndarray, offsets: np.ndarray, step: int = 4096) -> np.ndarray:
    """The logit of each row; rows without words have that of the bias."""
    starts, ends, before = words_of(data, offsets)
    out = np.full(len(offsets) - 1, -np.inf, np.float32)
    if len(starts):
        h = hashes(data, starts, ends)
        codes, uniques = pd.factorize(h)
        first = np.full(len(uniques), -1, np.int64)
        first[codes[::-1]] = np.arange(len(codes))[::-1]
        gates = net.gates(net.inputs(net.ranks(uniques), *char_bins(data, starts[first], ends[first])))
        w_start, w_len, w_row = windows(before)
        order = np.argsort(-w_len, kind="stable")
        for i in range(0, len(order), step):
            at = order[i : i + step]
            logits, _ = net.run(window_ids(codes, w_start[at], w_len[at]), w_len[at], gates)
            np.maximum.at(out, w_row[at], logits)
    out[np.isneginf(out)] = net.p["bias"][0]
    return out


def distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def log_odds(row: np.ndarray, labels: np.ndarray, n: int, items_of, strength: float = 8.0, step: int = 128) -> tuple[np.ndarray, np.ndarray]:
    """Smoothed log odds of the positive class for each of n items by the texts it is in, and in how many.

    row: of each token, rising; items_of(tokens a to b): (rows, items) of these. Works through `step` texts at a time.
    """
    df, pos = np.zeros(n), np.zeros(n)
    for i in range(0, len(labels), step):
        a, b = np.searchsorted(row, [i, i + step])
        rows, items = items_of(int(a), int(b))
        pairs = distinct((rows - i).astype(np.int64) * n + items)
        df += np.bincount(pairs % n, minlength=n)
        pos += np.bincount(pairs % n, weights=labels[i + pairs // n], minlength=n)
    share = float(labels.mean())
    odds = np.log((pos + strength * share) / (df - pos + strength * (1 - share))) - np.log(share / (1 - share))
    return odds.astype(np.float32), df


def fit(texts: list[bytes], labels: np.ndarray, positive_share: float, epochs: int = EPOCHS, seed: int = 7) -> Network:
    """Trains on whole texts, four of five; the others set the final scale and bias. positive_share: of the population that the
    sample stands for. A small sample, or a fifth without both classes, is used for both."""
    rng = np.random.default_rng(seed)
    texts, labels = list(texts), labels.astype(np.float32)
    aside = np.arange(len(texts)) % 5 == 4
    if len(texts) < 200 or not 0 < labels[aside].mean() < 1 or not 0 < labels[~aside].mean() < 1:
        aside[:] = False
    judged = [t for t, a in zip(texts, aside) if a or not aside.any()], labels[aside] if aside.any() else labels
    texts, labels = [t for t, a in zip(texts, aside) if not a], labels[~aside]
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    starts, ends, before = words_of(data, offsets)
    row = np.repeat(np.arange(len(texts)), np.diff(before))
    codes, uniques = pd.factorize(hashes(data, starts, ends))
    first = np.full(len(uniques), -1, np.int64)
    first[codes[::-1]] = np.arange(len(codes))[::-1]
    bins, begins = char_bins(data, starts[first], ends[first])
    n_bins = np.diff(np.append(begins, len(bins)))
    odds, df = log_odds(row, labels, len(uniques), lambda a, b: (row[a:b], codes[a:b]))

    def bins_of(a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        pair = distinct(row[a:b].astype(np.int64) * len(uniques) + codes[a:b])
        r, u = pair // len(uniques), pair % len(uniques)
        at = np.repeat(begins[u], n_bins[u]) + np.arange(int(n_bins[u].sum())) - np.repeat(np.cumsum(n_bins[u]) - n_bins[u], n_bins[u])
        return np.repeat(r, n_bins[u]), bins[at]

    char_odds, char_df = log_odds(row, labels, CHAR_BINS, bins_of)
    char_odds[char_df < 5] = 0
    keep = np.flatnonzero(df >= 3)
    keep = keep[np.argsort(uniques[keep])]
    net = Network(uniques[keep], odds[keep] / 2, char_odds / 2, seed)
    ranks = net.ranks(uniques)
    w_start, w_len, w_row = windows(before)
    first_window = np.searchsorted(w_row, np.arange(len(texts) + 1))
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    pos_weight = float((1 - labels.mean()) / max(labels.mean(), 1e-6)) ** 0.5
    steps = 0
    for epoch in range(epochs):
        rate = 0.01 * (1 - epoch / epochs) + 0.001
        for batch in np.array_split(rng.permutation(len(texts)), max(1, len(texts) // BATCH)):
            batch = batch[np.diff(before)[batch] > 0]
            if not len(batch):
                continue
            at = np.concatenate([np.arange(first_window[b], first_window[b + 1]) for b in batch])
            at = at[np.argsort(-w_len[at], kind="stable")]
            ids = window_ids(codes, w_start[at], w_len[at])
            inverse, own = pd.factorize(ids.ravel())
            inverse = inverse.reshape(ids.shape)
            own_bins = np.repeat(begins[own], n_bins[own]) + np.arange(int(n_bins[own].sum())) - np.repeat(np.cumsum(n_bins[own]) - n_bins[own], n_bins[own])
            own_begins = np.cumsum(n_bins[own]) - n_bins[own]
            r = np.where(rng.random(len(own)) < 0.25, 0, ranks[own])  # so that characters are learnt from too
            x = net.inputs(r, bins[own_bins], own_begins)
            gates = net.gates(x)
            logits, _ = net.run(inverse, w_len[at], gates)
            # the gradient goes through the largest window of each text
            by_row = np.lexsort((-logits, w_row[at]))
            top = np.sort(by_row[np.concatenate([[True], np.diff(w_row[at][by_row]) != 0])])
            sub, y = inverse[:, top], labels[w_row[at][top]]
            logit, trace = net.run(sub, w_len[at][top], gates, keep=True)
            d_logit = ((sigmoid(logit) - y) * np.where(y > 0, pos_weight, 1.0) / len(top)).astype(np.float32)
            g, d_gates = net.gradients(sub, trace, d_logit)
            dx = np.zeros_like(x)
            for d in "fb":
                sums = np.zeros((len(own), 3 * HIDDEN), np.float32)
                np.add.at(sums, sub.ravel(), d_gates[d].reshape(-1, 3 * HIDDEN))
                g[f"W{d}"], g[f"c{d}"] = x.T @ sums, sums.sum(axis=0)
                dx += sums @ net.p[f"W{d}"].T
            touched = np.flatnonzero(np.abs(dx).max(axis=1) > 0)
            g["word"], g["char"] = np.zeros_like(net.p["word"]), np.zeros_like(net.p["char"])
            np.add.at(g["word"], r[touched], dx[touched, :WORD_DIM])
            g["word"][0] = 0
            grams = net.p["char"][bins[own_bins]]
            for u in touched:
                a, b = own_begins[u], own_begins[u] + n_bins[own[u]]
                best = grams[a:b].argmax(axis=0)
                g["char"][bins[own_bins[a + best]], np.arange(CHAR_DIM)] += dx[u, WORD_DIM:]
            steps += 1
            for k, grad in g.items():
                m, v = moment[k]
                m *= 0.9
                m += 0.1 * grad
                v *= 0.999
                v += 0.001 * grad**2
                net.p[k] -= (rate * (m / (1 - 0.9**steps)) / (np.sqrt(v / (1 - 0.999**steps)) + 1e-6)).astype(np.float32)
    ends_at = np.concatenate([[0], np.cumsum([len(t) for t in judged[0]])]).astype(np.int64)
    calibrate(net, score_rows(net, np.frombuffer(b"".join(judged[0]), np.uint8), ends_at), judged[1], positive_share)
    return net


def calibrate(net: Network, logits: np.ndarray, labels: np.ndarray, positive_share: float) -> None:
    """Set scale and bias so that the logits fit the labels, weighted to the population's share (two parameters, Newton steps)."""
    share = float(labels.mean())
    weight = np.where(labels > 0, positive_share / max(share, 1e-9), (1 - positive_share) / max(1 - share, 1e-9))
    x = np.stack([logits - net.p["bias"][0], np.ones_like(logits)], axis=1).astype(np.float64)
    beta = np.array([1.0, float(net.p["bias"][0])])
    for _ in range(25):
        q = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (weight * (q - labels)) + 0.5 * (beta - [1.0, 0.0])
        hess = (x * (weight * q * (1 - q))[:, None]).T @ x + 0.5 * np.eye(2)
        beta -= np.clip(np.linalg.solve(hess, grad), -2, 2)
    beta[0] = max(beta[0], 0.05)
    net.p["out"] = (net.p["out"] * beta[0]).astype(np.float32)
    net.p["bias"] = np.array([beta[1]], np.float32)


def training_sample(docs: DataFrame, labels: DataFrame, may_learn: Column) -> tuple[list[bytes], np.ndarray, float]:
    """Texts and labels of about FIT_POSITIVE and FIT_NEGATIVE labelled documents at most, by a hash of doc_id, or fewer if their
    texts would have more than FIT_BYTES; and the share of positives. Whether a text is taken doesn't depend on its length.
    Null texts teach nothing, rows of equal doc_id have one label, and without labels of both classes there is no sample."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & may_learn).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r.y: r.n for r in known.groupBy((F.col("toxic") > 0).alias("y")).agg(F.count(F.lit(1)).alias("n")).collect()}
    n_pos, n_neg = counts.get(True, 0), counts.get(False, 0)
    if not n_pos or not n_neg:
        return [], np.zeros(0), 0.0
    texts = docs.where(F.col("text").isNotNull()).select("doc_id", F.octet_length("text").alias("size"), "text")
    sizes = texts.select("doc_id", "size").join(known, "doc_id").groupBy((F.col("toxic") > 0).alias("y")).agg(F.sum("size").alias("s"))
    sizes = {r.y: max(1, r.s) for r in sizes.collect()}
    bytes_ = lambda y: FIT_BYTES / 2 / sizes.get(y, 1)
    share = F.when(F.col("toxic") > 0, min(1.0, FIT_POSITIVE / n_pos, bytes_(True))).otherwise(min(1.0, FIT_NEGATIVE / n_neg, bytes_(False)))
    sample = known.where(F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(1_000_000)) < share * 1_000_000)
    rows = texts.join(F.broadcast(sample), "doc_id")  # bounded by the two numbers
    found = rows.select("doc_id", F.col("text").cast("binary").alias("text"), (F.col("toxic") > 0).cast("int").alias("y")).toPandas().sort_values(["doc_id", "text"])
    return [bytes(x) for x in found["text"]], found["y"].to_numpy(), n_pos / (n_pos + n_neg)


def score_texts(docs: DataFrame, net: Network | None, key: str = "doc_id") -> DataFrame:
    """(key, score) per row of docs: 0 to 1, higher for toxic. Null and empty texts have the score of no evidence; without a network (no labels of both classes) all have 0.
    Rows are kept one to one, null and repeated keys included; texts of any length are scored whole, an empty table gives an empty
    table, and columns but the key and text are not read."""
    bounded_batches(docs.sparkSession)
    if net is None:
        return docs.select(key, F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(net)  # bounded by the training sample

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            for i, j in row_groups(offsets):
                logits = score_rows(shared.value, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(sigmoid(logits.astype(np.float64)))], [key, "score"])

    return docs.select(key, "text").mapInArrow(released(score), f"{key} {dict(docs.dtypes)[key]}, score double")


def train(docs: DataFrame, labels: DataFrame, may_learn: Column) -> Network | None:
    texts, y, share = training_sample(docs, labels, may_learn)
    return fit(texts, y, share) if len(texts) and 0 < y.mean() < 1 else None
