"""Language identification by Bayesian evidence fusion.

The text's likelihood under each language comes from byte trigrams of letters (a naive Bayes model, tempered so that a long
text counts as at most TEMPER independent observations). It is combined with P(declared markup language | language), P(address
suffix | language) and a prior of the host that is smoothed towards its parent domain and that towards all documents. These
tables are counted by grouped aggregation over all documents, labelled by their text alone. One more class, a uniform
background, stands for text in no known language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkgrid.llm.common import all_salts, bounded_batches, drop_ids, materialize, released, row_groups, salt_of, text_buffers
from larkgrid.llm.tokens import LOWER, mix64

BINS, TEMPER, KAPPA, ACCEPT, UNKNOWN = 1 << 16, 60, 20.0, 0.5, "und"
#: Log prior odds of the background class.
BACKGROUND = -5.0

_CLASS = LOWER.copy()
_CLASS[[i for i in range(128) if not chr(i).isalpha()]] = 0x20


def trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bins of all byte trigrams within rows that hold a letter, and the number before each row. All but letters count as blanks."""
    b = _CLASS[data]
    if len(b) < 3:
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    letter = b != 0x20
    code = (b[:-2].astype(np.uint32) << 16) | (b[1:-1].astype(np.uint32) << 8) | b[2:]
    keep = letter[:-2] | letter[1:-1] | letter[2:]
    inside = np.ones(len(b), bool)
    for back in (1, 2):
        at = offsets[1:] - back
        inside[at[(at >= 0)]] = False
    at = np.flatnonzero(keep & inside[: len(code)])
    with np.errstate(over="ignore"):
        x = code[at] * np.uint32(2654435761)
    return (x >> np.uint32(16)).astype(np.int64), np.searchsorted(at, offsets)


class Model:
    def __init__(self, languages: list[str], log_p: np.ndarray):
        self.languages, self.log_p = languages, log_p  # log_p: float32 [languages, BINS]


def fit(docs: DataFrame, text: str = "text", language: str = "lang") -> Model:
    """From all labelled rows, equal texts of a language counting once. Counting is distributed; the driver gets one row per
    language and bin."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(language).alias("language"), F.col(text).alias("text")).where("language is not null and text is not null")
    rows = rows.select("language", "text", F.xxhash64("language", "text").alias("h"))

    def first_of_each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # a hash per distinct row of the task
        for batch in batches:
            new = [i for i, h in enumerate(batch.column(2).to_pylist()) if not (h in seen or seen.add(h))]
            if new:
                yield batch if len(new) == batch.num_rows else batch.take(pa.array(new))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in first_of_each(batches):
            names = np.array(batch.column(0).to_pylist(), object)
            data, offsets = text_buffers(batch.column(1))
            for i, j in row_groups(offsets):
                bins, before = trigrams(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                of = np.repeat(names[i:j], np.diff(before))
                for name in set(names[i:j]):
                    sums[name] = sums.get(name, 0) + np.bincount(bins[of == name], minlength=BINS)
        for name, v in sums.items():
            at = np.flatnonzero(v)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at)), pa.array(at), pa.array(v[at])], ["language", "bin", "n"])

    # copies within a task go before the exchange, so a text in a third of all rows crosses it once a task
    rows = rows.mapInArrow(released(first_of_each), rows.schema).repartition("h")
    counts = rows.mapInArrow(released(count), "language string, bin long, n long").groupBy("language", "bin").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(counts["language"].unique())
    table = np.full((len(languages), BINS), 0.5)
    for i, name in enumerate(languages):
        own = counts[counts["language"] == name]
        table[i, own["bin"].to_numpy()] += own["n"].to_numpy()
    return Model(languages, np.log(table / table.sum(axis=1, keepdims=True)).astype(np.float32))


def text_evidence(rows: DataFrame, model: Model) -> DataFrame:
    """rows (text last) with n_grams and ll, the mean log likelihood per trigram of each language and of the background, in place of text."""
    shared = rows.sparkSession.sparkContext.broadcast(model.log_p)  # a fixed number of bins per language
    names = rows.columns[:-1]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            data, offsets = text_buffers(batch.column(len(names)))
            for i, j in row_groups(offsets):
                bins, before = trigrams(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                n = np.diff(before)
                out = np.full((j - i, len(table) + 1), -np.log(BINS))
                full = np.flatnonzero(n)
                for k, row in enumerate(table):
                    if len(full):
                        out[full, k] = np.add.reduceat(row[bins], before[:-1][full], dtype=np.float64) / n[full]
                ll = pa.FixedSizeListArray.from_arrays(pa.array(out.ravel()), len(table) + 1).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(i, j - i) for c in range(len(names))], pa.array(n), ll], [*names, "n_grams", "ll"])

    fields = rows.select(*names).schema.add("n_grams", "long").add("ll", T.ArrayType(T.DoubleType()))
    return rows.mapInArrow(released(score), fields)


def identify(docs: DataFrame, model: Model, key: str = "doc_id", text: str | Column = "text", host: Column | None = None, suffix: Column | None = None, declared: Column | None = None, accept: float = ACCEPT) -> DataFrame:
    """(key, language, confidence, text_language, n_grams, accepted) per row of docs.

    host, suffix and declared are columns or None; where they are null they tell nothing. A row is accepted if its text has
    letters and the best language, not the background, has at least `accept` of the posterior. Text that is null or without
    letters gives the language of the priors and is not accepted. A model without languages gives `und` for all rows. Ties go
    to the first language by name. Rows are kept one to one, repeated and null keys included.
    """
    none = F.lit(None).cast("string")
    rows = docs.select(F.col(key).alias(key), *[(c if c is not None else none).cast("string").alias(n) for n, c in (("host", host), ("suffix", suffix), ("declared", declared))], (F.col(text) if isinstance(text, str) else text).alias("text"))
    bounded_batches(docs.sparkSession)
    names = model.languages
    k = len(names)
    if not k:
        return docs.select(key, F.lit(UNKNOWN).alias("language"), F.lit(0.0).alias("confidence"), F.lit(UNKNOWN).alias("text_language"), F.lit(0).cast("long").alias("n_grams"), F.lit(False).alias("accepted"))
    best = F.array_position("ll", F.array_max("ll")) - 1
    weight = F.least(F.col("n_grams"), F.lit(TEMPER)).cast("double")
    evid = materialize(text_evidence(rows, model).withColumns({"label": F.when(F.col("n_grams") > 0, best), "parent": F.when(F.size(F.split("host", r"\.")) > 2, F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1)).otherwise(F.col("host"))}), "evidence")
    one_hot = F.array(*[F.sum((F.col("label") == i).cast("long")) for i in range(k)]).alias("n")
    known = evid.where(F.col("label") < k)

    def counts(by: str) -> DataFrame:
        return known.where(F.col(by).isNotNull()).groupBy(by).agg(one_hot)

    total = F.array(*[F.coalesce(F.sum((F.col("label") == i).cast("long")), F.lit(0)) for i in range(k)])
    n_all = list(known.agg(total.alias("n")).first()[0])
    p_all = [(x + 1) / (sum(n_all) + k) for x in n_all]
    prior = F.array(*[F.lit(p) for p in p_all])

    def smoothed(n: str, towards: Column) -> Column:
        size = F.aggregate(n, F.lit(0).cast("long"), lambda a, x: a + x)
        return F.when(F.col(n).isNull(), towards).otherwise(F.transform(towards, lambda p, i: (F.get(F.col(n), i) + F.lit(KAPPA) * p) / (size + KAPPA)))

    def likelihood(n: str) -> Column:
        """log P(value | language) up to a constant, flat where there is no value."""
        size = F.array(*[F.lit(float(x)) for x in n_all])
        return F.when(F.col(n).isNull(), F.array(*[F.lit(0.0)] * k)).otherwise(F.transform(size, lambda s, i: F.log((F.get(F.col(n), i) + 1.0) / (s + F.lit(float(KAPPA))))))

    joined = evid.withColumn("salt", salt_of(key, "host"))
    for by, name in (("host", "n_host"), ("parent", "n_parent"), ("suffix", "n_suffix"), ("declared", "n_declared")):
        joined = joined.join(counts(by).select(F.col(by).alias(f"__{by}"), F.col("n").alias(name), all_salts("__salt")), (F.col(by) == F.col(f"__{by}")) & (F.col("salt") == F.col("__salt")), "left").drop(f"__{by}", "__salt")
    p_host = smoothed("n_host", smoothed("n_parent", prior))
    joined = joined.withColumns({"p_host": p_host, "l_suffix": likelihood("n_suffix"), "l_declared": likelihood("n_declared")})
    scores = F.transform("p_host", lambda p, i: weight * F.get("ll", i) + F.log(p) + F.get("l_suffix", i) + F.get("l_declared", i))
    # the background has the mean of the other evidence
    mean = F.aggregate(F.transform("l_suffix", lambda x, i: (x + F.get("l_declared", i)) / k), F.lit(0.0), lambda a, x: a + x)
    joined = joined.withColumn("s", F.concat(scores, F.array(weight * F.get("ll", F.lit(k)) + mean + F.lit(BACKGROUND))))
    joined = joined.withColumn("top", F.array_max("s"))
    at = F.array_position("s", F.col("top")) - 1
    labels = F.array(*[F.lit(x) for x in [*names, UNKNOWN]])
    confidence = F.lit(1.0) / F.aggregate(F.transform("s", lambda x: F.exp(x - F.col("top"))), F.lit(0.0), lambda a, x: a + x)
    out = joined.select(key, F.get(labels, at.cast("int")).alias("language"), confidence.alias("confidence"), F.coalesce(F.get(labels, F.col("label").cast("int")), F.lit(UNKNOWN)).alias("text_language"), "n_grams")
    return out.withColumn("accepted", (F.col("n_grams") > 0) & (F.col("language") != UNKNOWN) & (F.col("confidence") >= accept))


def page_evidence(pages: DataFrame) -> dict[str, Column]:
    """The columns that identify() takes, for pages (url, html)."""
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    suffix = F.regexp_extract(host, r"([^.]+)$", 1)
    declared = F.lower(F.regexp_extract("html", r"(?i)<html\b[^>]*\blang\s*=\s*[\"']?([A-Za-z]{2,3})", 1))
    text = F.regexp_replace(F.col("html"), r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ")
    empty = lambda c: F.when(c != "", c)
    return {"host": empty(host), "suffix": empty(suffix), "declared": empty(declared), "text": text}


def keep_identified(docs: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """The rows of docs (doc_id, text, lang, source) whose language is accepted, the source taken as the host.

    Rows of equal doc_id go only if all are rejected; rows without doc_id stay. lang only serves to fit the model; where no row
    has it, there is nothing to judge by and all rows stay.
    """
    model = fit(docs)
    if not model.languages:
        return docs
    judged = identify(docs, model, host=F.col("source"), accept=accept)
    return drop_ids(docs, judged.groupBy("doc_id").agg(F.max("accepted").alias("any")).where("not any"), "doc_id")
