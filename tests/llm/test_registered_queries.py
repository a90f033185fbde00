"""The registered queries on whole small tables: against their SQL, or against brute force."""

import collections
import math
import os
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from larkgrid.llm import decontaminate, langid, ngram_lm, queries, toxicity

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def make(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


def plain(v):
    return None if v is None or (isinstance(v, float) and math.isnan(v)) else float(f"{v:.9g}") if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "pages"):
        duck.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries.queries()[name](spark, SF)
    found = duck.sql(queries.oracle_sql()[name])
    cols = sorted(df.columns)
    assert cols == sorted(found.columns)
    mine = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=str)
    theirs = sorted((tuple(plain(dict(zip(found.columns, r))[c]) for c in cols) for r in found.fetchall()), key=str)
    assert mine == theirs


def test_warc_query_with_null_and_repeated_ids_equals_sql(spark, tmp_path):
    big = "é" * 600
    rows = [(1, "http://a.example/", big), (7, "http://b.example/", big), (7, "http://c.example/", big), (None, "http://d.example/", big), (None, None, "p" * 2000), (None, None, "p" * 2000), (8, "x", None), (9, "x", ""), (10, "y", "s")]
    make(spark, rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    duck = duckdb.connect()
    duck.sql(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    mine = [tuple(r) for r in queries.op8_warc(spark, str(tmp_path)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()]
    assert sorted(mine, key=str) == sorted(duck.sql(queries.OP8_SQL).fetchall(), key=str)


def lower(s):
    return s.translate({i: i + 32 for i in range(65, 91)})


def brute_leaks(docs, items, min_words=decontaminate.MIN_WORDS, least=decontaminate.MIN_IDENTITY):
    """Every pair that shares a seed of the fixed masks, and whose best stretch along any diagonal with one is long enough."""
    split = lambda t: [lower(w) for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
    found = set()
    for i, t in docs:
        doc = split(t)
        for j, u in items:
            item = split(u)
            if i is None or j is None or t is None or not item:
                continue
            for g in range(-len(item) + 1, len(doc)):
                lo, hi = max(0, -g), min(len(item), len(doc) - g)
                same = [item[k] == doc[k + g] for k in range(lo, hi)]
                seeded = any(all(same[s + k] for k, bit in enumerate(m) if bit == "1") for m in decontaminate.MASKS for s in range(len(same) - len(m) + 1))
                need = decontaminate.needed(len(item), min_words, least)
                if need < min_words:
                    agree = [k for k, x in enumerate(same) if x]
                    if agree and len(agree) >= need and len(agree) >= least * (agree[-1] - agree[0] + 1):
                        found.add((i, j))
                elif seeded:
                    best, total, count = (0.0, 0), 0.0, 0
                    for x in same:
                        total, count = total + (1.0 if x else -least / (1 - least)), count + x
                        if total <= 1e-12:
                            total, count = 0.0, 0
                        if total > best[0] + 1e-12:
                            best = (total, count)
                    if best[1] >= min_words:
                        found.add((i, j))
    return found


def test_decontamination_matches_brute_force_over_all_pairs(spark):
    rng = random.Random(21)
    vocab = [f"v{i}" for i in range(60)]
    items = [(j, " ".join(rng.choices(vocab, k=n))) for j, n in enumerate([1, 2, 3, 5, 6, 7, 8, 9, 11, 13, 14, 15, 16, 18, 20, 25, 30, 40])]
    docs = []
    for i in range(150):
        words = rng.choices(vocab, k=rng.randint(0, 60))
        part = items[rng.randrange(len(items))][1].split()
        a = rng.randint(0, len(part) // 3)
        part = [w if rng.random() > rng.choice([0, 0.1, 0.25]) else "other" for w in part[a:]]
        at = rng.randint(0, len(words))
        docs.append((i, " ".join(words[:at] + part + words[at:])))
    docs += [(900, None), (901, ""), (902, items[-1][1] + " " + "long " * 50_000)]
    extra = make(spark, docs).withColumns({"item_id": F.lit("clash"), "hits": F.lit(1), "salt": F.lit(2)})
    bench = make(spark, [*items, (77, None), (None, items[9][1])], "item_id long, text string").withColumn("doc_id", F.lit("clash"))
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(extra, bench).collect()}
    assert got == brute_leaks(docs, items)


def brute_identify(rows, model, accept=langid.ACCEPT):
    """rows: (key, text, host, suffix, declared). The fusion by plain loops."""
    k = len(model.languages)
    ll = {}
    for key, text, *_ in rows:
        data = np.frombuffer((text or "").encode(), np.uint8)
        bins, _ = langid.trigrams(data, np.array([0, len(data)]))
        ll[key] = (len(bins), [float(model.log_p[i][bins].astype(float).mean()) for i in range(k)] + [-math.log(langid.BINS)] if len(bins) else None)
    label = {key: int(np.argmax(ll[key][1])) for key, *_ in rows if ll[key][0]}
    tables = {n: collections.defaultdict(lambda: [0] * k) for n in ("host", "parent", "suffix", "declared")}
    parent = lambda h: None if h is None else ".".join(h.split(".")[-2:]) if h.count(".") > 1 else h
    n_all = [0] * k
    for key, _, host, suffix, declared in rows:
        if label.get(key, k) < k:
            n_all[label[key]] += 1
            for name, v in (("host", host), ("parent", parent(host)), ("suffix", suffix), ("declared", declared)):
                if v is not None:
                    tables[name][v][label[key]] += 1
    p_all = [(x + 1) / (sum(n_all) + k) for x in n_all]
    smooth = lambda n, p: p if n is None else [(c + langid.KAPPA * q) / (sum(n) + langid.KAPPA) for c, q in zip(n, p)]
    out = {}
    for key, _, host, suffix, declared in rows:
        get = lambda name, v: tables[name][v] if v in tables[name] else None
        prior = smooth(get("host", host), smooth(get("parent", parent(host)), p_all))
        more = [[math.log((c + 1) / (s + langid.KAPPA)) for c, s in zip(n, n_all)] if (n := get(name, v)) else [0.0] * k for name, v in (("suffix", suffix), ("declared", declared))]
        w = min(ll[key][0], langid.TEMPER)
        text = ll[key][1] or [0.0] * (k + 1)
        score = [w * text[i] + math.log(prior[i]) + more[0][i] + more[1][i] for i in range(k)]
        score.append(w * text[k] + sum(a + b for a, b in zip(*more)) / k + langid.BACKGROUND)
        top = max(score)
        at = score.index(top)
        confidence = 1 / sum(math.exp(s - top) for s in score)
        out[key] = ([*model.languages, langid.UNKNOWN][at], confidence, ll[key][0] > 0 and at < k and confidence >= accept)
    return out


def test_page_languages_match_brute_force(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    model = langid.fit(spark.read.parquet(f"{SF}/documents.parquet"))
    evidence = langid.page_evidence(pages)
    rows = [tuple(r) for r in pages.select("page_id", evidence["text"].alias("t"), *[evidence[n].alias(n) for n in ("host", "suffix", "declared")]).collect()]
    assert all(r[2] and r[3] and r[4] for r in rows)
    expect = brute_identify(rows, model)
    got = {r.page_id: r for r in queries.page_languages(spark, SF).collect()}
    assert got.keys() == expect.keys()
    for i, (language, confidence, accepted) in expect.items():
        assert (got[i].language, got[i].accepted) == (language, accepted) and math.isclose(got[i].confidence, confidence, rel_tol=1e-4, abs_tol=1e-6)


def test_language_query_keeps_rows_and_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text, r.source, None, None) for r in docs.collect()]
    expect = brute_identify(rows, langid.fit(docs))
    got = {r.doc_id: r for r in queries.op7_language_id(spark, SF).collect()}
    assert all((got[i].language, got[i].accepted) == (x[0], x[2]) for i, x in expect.items())
    assert langid.identify(docs.limit(0), langid.fit(docs), host=F.col("source")).count() == 0


def brute_logit(net, words):
    """A text's logit by loops over its windows, one word after the other."""
    p, h = net.p, toxicity.HIDDEN
    sigma = lambda v: 1 / (1 + np.exp(-v))
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    s, e, _ = toxicity.words_of(data, np.array([0, len(data)]))
    ranks = net.ranks(toxicity.hashes(data, s, e))
    bins, begins = toxicity.char_bins(data, s, e)
    ends = [*begins[1:].tolist(), len(bins)]
    x = [np.concatenate([p["word"][r], p["char"][bins[a:b]].max(axis=0)]) for r, a, b in zip(ranks, begins.tolist(), ends)]
    logits, at = [], 0
    while True:
        part = x[at : at + toxicity.WINDOW]
        states = []
        for d, seq in (("f", part), ("b", part[::-1])):
            state, out = np.zeros(h), []
            for v in seq:
                g, u = v @ p[f"W{d}"] + p[f"c{d}"], state @ p[f"U{d}"]
                z, r = sigma(g[:h] + u[:h]), sigma(g[h : 2 * h] + u[h : 2 * h])
                new = np.tanh(g[2 * h :] + r * u[2 * h :])
                state = (1 - z) * new + z * state
                out.append(state)
            states.append(out if d == "f" else out[::-1])
        both = np.array([np.concatenate(y) for y in zip(*states)])
        score = (np.tanh(both @ p["A"] + p["a"]) @ p["v"])[:, 0]
        weight = np.exp(score - score.max())
        logits.append(float(((weight / weight.sum()) @ both) @ p["out"][:, 0] + p["bias"][0]))
        if at + toxicity.WINDOW >= len(x):
            return max(logits)
        at += toxicity.STRIDE


def test_network_matches_a_forward_pass_by_loops():
    rng = np.random.default_rng(5)
    texts = [" ".join("".join(rng.choice(list("abcdefg"), rng.integers(1, 9))) for _ in range(n)) for n in (1, 3, 47, 48, 49, 80, 81, 200)]
    raw = [t.encode() for t in texts]
    data, offs = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]).astype(np.int64)
    s, e, _ = toxicity.words_of(data, offs)
    vocab = np.unique(toxicity.hashes(data, s, e))[::2]
    net = toxicity.Network(vocab, rng.standard_normal(len(vocab)).astype(np.float32), rng.standard_normal(toxicity.CHAR_BINS).astype(np.float32))
    got = toxicity.score_rows(net, data, offs, step=3)
    assert np.allclose(got, [brute_logit(net, t.split()) for t in texts], atol=1e-4)


def test_long_labelled_texts_teach_too(spark, monkeypatch):
    """One word, deep in texts of over 300 KB, tells the classes apart."""
    filler = " ".join(f"word{i % 50}" for i in range(45_000))
    rows = [(i, filler + (" vexxor" if i % 2 else " harmless")) for i in range(12)] + [(100 + i, f"short word{i}") for i in range(40)]
    docs, labels = make(spark, rows).withColumn("toxic", F.lit("clash")), make(spark, [(i, i % 2 if i < 100 else 0) for i, _ in rows], "doc_id long, toxic int")
    texts, y, share = toxicity.training_sample(docs, labels, F.lit(True))
    assert sorted(map(len, texts))[-12] > 300_000 and len(texts) == len(rows) and int(y.sum()) == 6
    monkeypatch.setattr(toxicity, "FIT_BYTES", 2_000_000)
    assert 0 < len(toxicity.training_sample(docs, labels, F.lit(True))[0]) < len(rows)
    assert toxicity.score_texts(make(spark, []), None).count() == 0
    assert toxicity.training_sample(docs.limit(0), labels, F.lit(True))[0] == []


def test_more_hot_words_than_one_shard_splits(spark, monkeypatch):
    """Over 64 hot words fall into one of two shards; every one of them is known to all shards."""
    monkeypatch.setattr(ngram_lm, "LEAST_SHARDS", 2)
    monkeypatch.setattr(ngram_lm, "TOKENS_PER_SHARD", 1 << 40)
    monkeypatch.setattr(ngram_lm, "HOT_PART", 400)
    asked = []
    whole = ngram_lm.hot_words
    monkeypatch.setattr(ngram_lm, "hot_words", lambda *a: asked.append(whole(*a)) or asked[-1])
    from test_models_and_pages import brute_lm

    rng = random.Random(31)
    rows = [(i, " ".join(rng.choices([f"w{k}" for k in range(220)], k=rng.randint(20, 90)))) for i in range(150)]
    got = {r.doc_id: (r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in ngram_lm.score_texts(make(spark, rows), "doc_id", F.col("doc_id") % 4 != 1, 2).collect()}
    expect = brute_lm(rows, lambda i: i % 4 != 1)
    by_shard = collections.Counter(i % 2 for i in asked[0])
    assert max(by_shard.values()) > 64
    for i in expect:
        assert got[i][:3] == expect[i][:3] and np.allclose(got[i][3:], expect[i][3:], rtol=1e-9)


def test_pipeline_keeps_columns_of_clashing_names_and_empty_tables(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(4)
    rows = [(i, " ".join(rng.choices("the and thing with that here was".split(), k=40)), "en", "s", 10, "mine", "own", "kept", 7) for i in range(30)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, n_lines string, n_dropped string, target string, copies int"
    for name, part in (("some", rows), ("none", [])):
        spark.createDataFrame(part, schema).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
    out = corpus_pipeline.run(spark, f"{tmp_path}/some")
    assert out.columns == [*[c.split()[0] for c in schema.split(", ")], "copy"]
    assert {(r.n_lines, r.n_dropped, r.target, r.copies) for r in out.collect()} == {("mine", "own", "kept", 7)}
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


