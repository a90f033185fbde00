"""Findings of a review: operators that did less than the whole job."""

import collections
import os
import random
import threading
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkgrid.llm import chosen_path, components, decontaminate, langid, omh, queries, style_tree, warc
from test_models_and_pages import alone, brute_lm


def make(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


def brute_fit(rows):
    """Log probabilities of all distinct (text, language) by a plain count."""
    counts = collections.defaultdict(lambda: np.full(langid.BINS, 0.5))
    for text, language in set(rows):
        data = np.frombuffer(text.encode(), np.uint8)
        bins, _ = langid.trigrams(data, np.array([0, len(data)]))
        np.add.at(counts[language], bins, 1)
    return {k: np.log(v / v.sum()) for k, v in counts.items()}


def test_language_model_counts_every_labelled_text(spark):
    common = [(f"word{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676 % 26)} and", "en") for i in range(40_000)]
    rare = [("слово здесь", "ru"), ("ещё одно", "ru")]
    rows = common + rare + [("the copied notice", "en")] * 20_000  # a third of all rows is one text
    model = langid.fit(make(spark, rows, "text string, lang string"))
    expect = brute_fit(rows)
    assert model.languages == ["en", "ru"]
    for language, got in zip(model.languages, model.log_p):
        assert np.allclose(got, expect[language], atol=1e-5)


def test_half_edited_texts_are_always_near():
    rng = random.Random(11)
    vocab = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9))) for _ in range(2000)]
    for _ in range(120):
        text, other = (" ".join(rng.choices(vocab, k=150)).encode() for _ in range(2))
        half = len(text) // 2
        edited = text[: len(text) - half] + other[:half]
        own, near, far = (omh.order_minhash(x) for x in (text, edited, other))
        assert omh.likeness(own, near) > omh.likeness(own, far)


def test_short_benchmark_items_are_found(spark):
    rng = random.Random(12)
    fill = lambda: [f"f{rng.randrange(500)}" for _ in range(40)]
    items = {n: [f"i{n}w{k}" for k in range(n)] for n in range(1, 15)}
    docs, expect = [], set()
    for n, words in items.items():
        most = n // 4 if n >= 6 else 0  # 3 of 4 words must agree, of fewer than 6 all
        for off in range(most + 2):
            for turn in range(6):
                text = words[:]
                for p in rng.sample(range(n), min(off, n)):
                    text[p] = "other"
                doc_id = n * 1000 + off * 10 + turn
                a = fill()
                docs.append((doc_id, " ".join(a[:20] + text + a[20:])))
                if off <= most:
                    expect.add((doc_id, n))
    docs.append((1, " ".join(["i1w0"] * 50)))
    expect.add((1, 1))
    bench = make(spark, [(n, " ".join(w)) for n, w in items.items()], "item_id long, text string")
    found = [(r.doc_id, r.item_id) for r in decontaminate.find_leaks(make(spark, docs), bench).collect()]
    assert set(found) == expect and len(found) == len(expect)


LONG = "the long story of a page " * 20


@pytest.mark.parametrize(
    "page, text",
    [
        ("<body><form><div>menu</div><article><p>story</p></article></form></body>", "story"),
        (f"<body><form><p>{LONG}</p></form></body>", LONG.strip()),
        ("<nav><ul><li>link</li></ul><article><p>story</p></article>", "story"),
        ("<aside><p>link</p><main><p>story</p></main>", "story"),
        ("<main><p>story</p></main><aside><article>teaser</article></aside>", "story"),
        ("<div hidden><article>unseen</article></div><p>seen</p>", "seen"),
        ("<nav hidden><article>unseen</article></nav>", ""),
        (f"<div class='content with-sidebar'><p>{LONG}</p><div class='sidebar'>links</div></div>", LONG.strip()),
        (f"<body><div class='no-comments has-banner social'><p>{LONG}</p></div></body>", LONG.strip()),
        ("<div class='ad'>buy</div>", "buy"),
        (f"<div><p>{LONG}</p></div><article>teaser</article>", LONG.strip() + " teaser"),
        (f"<main><article><div class='comments'>{LONG}</div><p>story</p></article></main>", "story"),
        ("<div class='content no-sidebar'><p>story</p></div>", "story"),
        ("<div id=page class='layout-with-sidebar'><p>story</p></div>", "story"),
        ("<article><section class='social-science'>one</section><div class='share-price'>two</div></article>", "one two"),
        (f"<article class='teaser'>teaser</article><div class='story'><p>{LONG}</p></div>", "teaser " + LONG.strip()),
    ],
)
def test_priors_do_not_lose_the_main_text(page, text):
    assert alone(page) == text


def test_style_tree_acts_inside_the_article(spark):
    page = "<html><body><article><h1>title {0}</h1><p>story {0} is told here</p><ul><li>Subscribe to our letter</li><li>All rights kept</li></ul></article></body></html>"
    rows = [(i, f"http://site.example/{i}", page.format(i)) for i in range(12)] + [(20, "http://other.example/", page.format(20))]
    got = {r.page_id: r.text for r in style_tree.extract(make(spark, rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"title {i} story {i} is told here" for i in range(12))
    assert got[20].endswith("Subscribe to our letter All rights kept")  # one page tells nothing of its site


def test_revisits_are_resolved_through_refers_to(spark, tmp_path, monkeypatch):
    big = "é" * 600
    make(spark, [(1, "http://a.example", big), (7, "http://b.example", big), (3, "http://c.example", "short")], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    whole, seen = warc.assemble, []

    def without_notes(records):  # archives of other writers have none
        seen.extend(records.columns)
        return whole(records.withColumn("fields", F.map_filter("fields", lambda k, v: k == "page-id")))

    monkeypatch.setattr(warc, "assemble", without_notes)
    got = {r.page_id: (r.payload_bytes, r.record_type, r.refers_to) for r in queries.op8_warc(spark, str(tmp_path)).collect()}
    assert got == {1: (1200, "revisit", 7), 7: (1200, "response", None), 3: (5, "response", None)}
    assert "payload" in seen and "http_headers" in seen


def test_near_duplicates_broadcast_no_table_that_grows(spark, monkeypatch):
    sizes = []
    plain = F.broadcast
    monkeypatch.setattr(F, "broadcast", lambda df: sizes.append(df.count()) or plain(df))
    # 35 000 texts, each twice, and 70 000 vertices in chains of five
    v = F.col("id")
    docs = spark.range(70_000).select(v.alias("doc_id"), F.concat_ws(" ", *[F.concat(F.lit(x), F.floor(v / 2).cast("string")) for x in "abc"]).alias("text"))
    found = chosen_path.near_duplicates(docs, 3, 85)
    assert found.where("n_shingles = 1 AND component_id = doc_id - doc_id % 2 AND kept = (doc_id % 2 = 0)").count() == found.count() == 70_000
    chains = components.components(spark.range(70_000).where("id % 5 < 4").select(v.alias("a"), (v + 1).alias("b")))
    assert chains.where("c = v - v % 5").count() == chains.count() == 70_000
    assert max(sizes, default=0) <= 30_000


def test_registered_language_model_has_three_levels(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choices([f"w{k}" for k in range(12)], k=rng.randint(0, 60)))) for i in range(120)] + [(120, None), (121, "never seen")]
    make(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    learnt = lambda i: zlib.crc32(str(i).encode()) % 5 != 1
    expect, pairs = brute_lm(rows, learnt, 3), brute_lm(rows, learnt, 2)
    got = {r.doc_id: r for r in queries.op2_lm_score(spark, str(tmp_path)).collect()}
    assert got.keys() == expect.keys() and any(abs(expect[i][4] - pairs[i][4]) > 1 for i in expect)
    for i, r in got.items():
        assert (r.n_tokens, r.n_known, r.train_tokens) == expect[i][:3] and r.held_out == (not learnt(i))
        assert np.allclose((r.base_score, r.score), expect[i][3:], rtol=1e-9)


def used(folders):
    """Bytes of the files in the folders, some of which may go meanwhile."""
    total = 0
    for folder in folders:
        for d, _, names in os.walk(folder):
            for name in names:
                try:
                    total += os.lstat(f"{d}/{name}").st_size
                except FileNotFoundError:
                    pass
    return total


def test_language_model_keeps_within_its_disk(spark, tmp_path):
    rng = np.random.default_rng(8)
    rows = [(i, " ".join(f"{k:x}" for k in rng.zipf(1.2, 700) % 3_000_000)) for i in range(2000)]
    make(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    size = used([f"{tmp_path}/documents.parquet"])
    env = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get()
    folders = [spark.conf.get("spark.checkpoint.dir").removeprefix("file:"), *env.blockManager().diskBlockManager().localDirsString()]
    spark.sparkContext._jvm.System.gc()  # shuffles of other tests should not go meanwhile
    before, most, over = used(folders), [0], threading.Event()

    def watch():
        while not over.wait(0.05):
            most[0] = max(most[0], used(folders) - before)

    watcher = threading.Thread(target=watch)
    watcher.start()
    try:
        assert queries.op2_lm_score(spark, str(tmp_path)).where("score < 0").count() == 2000
    finally:
        over.set()
        watcher.join()
    assert size < most[0] < 4 * size
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"  # as it was
