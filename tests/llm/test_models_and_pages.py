"""Language models, language ID, toxicity, mixing, WARC, HTML extraction and the pipeline, on small tables."""

import collections
import gzip
import hashlib
import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkgrid.llm import elias_fano, langid, mixing, ngram_lm, style_tree, toxicity, warc
from larkgrid.llm.tokens import U64


def make(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize("n, top", [(0, 0), (1, 0), (1, 2**63), (10_000, 50), (20_000, 2**62), (9_000, 9_000)])
def test_elias_fano_round_trip(n, top):
    rng = np.random.default_rng(n)
    values = np.sort(rng.integers(0, top + 1, n, dtype=np.uint64))
    ef = elias_fano.EliasFano(elias_fano.map_block(elias_fano.pack(elias_fano.encode(values))))
    assert (ef.decode(0, n) == values).all() and (ef.decode(n // 3, n // 2) == values[n // 3 : n // 2]).all()
    asked = np.sort(rng.integers(0, top + 2, 500, dtype=np.uint64))
    index, equal = ef.successor(asked)
    assert (index == np.searchsorted(values, asked)).all() and (equal == np.isin(asked, values)).all()
    assert (elias_fano.unsqueeze(elias_fano.squeeze(values, True), True) == values).all()


def test_trie_answers_like_a_dictionary():
    rng = np.random.default_rng(2)
    bits = 20
    keys = np.unique((rng.zipf(1.3, 20_000).clip(1, 5000).astype(np.uint64) << U64(bits)) | rng.integers(0, 90_000, 20_000).astype(np.uint64))
    counts = rng.integers(1, 9, len(keys))
    d = np.array([0, 0.6, 1.0, 1.4])
    trie = ngram_lm.Trie(ngram_lm.build_trie(keys, counts, bits, d, {}), bits, {})
    asked = np.sort(np.concatenate([keys[::3], rng.integers(0, 5200 << bits, 3000).astype(np.uint64)]))
    alpha, gamma = trie.query(asked)
    total, taken = collections.Counter(), collections.Counter()
    for k, c in zip(keys.tolist(), counts.tolist()):
        total[k >> bits] += c
        taken[k >> bits] += d[min(c, 3)]
    known = dict(zip(keys.tolist(), counts.tolist()))
    for k, a, g in zip(asked.tolist(), alpha, gamma):
        u = k >> bits
        assert g == (ngram_lm.to_code(np.log10([taken[u] / total[u]]))[0] if u in total else 0)
        assert a == (ngram_lm.to_code(np.log10([(known[k] - d[min(known[k], 3)]) / total[u]]))[0] if k in known else 0)


def brute_lm(rows, train, order=2):
    tokens = {i: (t or "").split() + ["\n"] for i, t in rows}
    c = collections.Counter(w for i in tokens if train(i) for w in tokens[i])
    pairs = collections.Counter(p for i in tokens if train(i) for p in zip(["\n", *tokens[i]], tokens[i]))
    n, v = sum(c.values()), len(c)
    ones = lambda x: [sum(y == k for y in x.values()) for k in (1, 2, 3, 4)]
    d1, d2 = ngram_lm.discounts(*ones(c)), ngram_lm.discounts(*ones(pairs))
    q = lambda p: ngram_lm._VALUE[ngram_lm.to_code(np.log10([p]))[0]]
    p_unknown = sum(d1[min(x, 3)] for x in c.values()) / n
    taken = collections.Counter()
    for (u, _), x in pairs.items():
        taken[u] += d2[min(x, 3)]
    triples = collections.Counter(p for i in tokens if train(i) for p in zip(["\n", "\n", *tokens[i]], ["\n", *tokens[i]], tokens[i]))
    d3, of, gone = ngram_lm.discounts(*ones(triples)), collections.Counter(), collections.Counter()
    for (t, u, _), x in triples.items():
        of[t, u] += x
        gone[t, u] += d3[min(x, 3)]
    out = {}
    for i, ws in tokens.items():
        score = base = 0.0
        for t, u, w in zip(["\n", "\n", *ws], ["\n", *ws], ws):
            p1 = q((c[w] - d1[min(c[w], 3)]) / n) if c[w] else q(p_unknown)
            a = q((pairs[u, w] - d2[min(pairs[u, w], 3)]) / c[u]) if (u, w) in pairs else 0.0
            p2 = a + (q(taken[u] / c[u]) if c[u] else 1.0) * p1
            if order > 2:
                b = q((triples[t, u, w] - d3[min(triples[t, u, w], 3)]) / of[t, u]) if (t, u, w) in triples else 0.0
                p2 = b + (q(gone[t, u] / of[t, u]) if of[t, u] else 1.0) * p2
            score += math.log10(p2)
            base += math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1)))
        out[i] = (len(ws), sum(c[w] > 0 for w in ws), n, base, score)
    return out


def test_language_model_matches_brute_force(spark):
    rng = random.Random(1)
    vocab = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choices(vocab, weights=[1 / (k + 1) for k in range(60)], k=rng.randint(0, 80)))) for i in range(200)]
    rows += [(200, None), (201, ""), (202, "never seen words"), (203, " ".join(["hot"] * 30_000))]
    for order in (2, 3):
        got = {r.doc_id: (r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in ngram_lm.score_texts(make(spark, rows).withColumn("train", F.lit("clash")), "doc_id", F.col("doc_id") % 4 != 1, order).collect()}
        expect = brute_lm(rows, lambda i: i % 4 != 1, order)
        assert got.keys() == expect.keys()
        for i in expect:
            assert got[i][:3] == expect[i][:3] and np.allclose(got[i][3:], expect[i][3:], rtol=1e-9)


def test_language_model_of_nothing(spark):
    assert ngram_lm.score_texts(make(spark, []), "doc_id", F.lit(True)).count() == 0
    got = ngram_lm.score_texts(make(spark, [(None, "a b"), (1, None), (1, None)]), "doc_id", F.lit(False)).collect()
    assert sorted([r.n_tokens for r in got]) == [1, 1, 3] and all(r.train_tokens == 0 and r.score == 0 and r.base_score == 0 for r in got)


EN, DE = "the and thing with that tion was here".split(), "der und nicht schön keit eine über straße".split()


def labelled(n, seed):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choices(EN if i % 2 else DE, k=rng.randint(3, 60))), "en" if i % 2 else "de", f"h{i % 7}.{'uk' if i % 2 else 'de'}") for i in range(n)]


def test_language_id_fuses_evidence(spark):
    schema = "doc_id long, text string, lang string, source string"
    docs = make(spark, labelled(300, 1), schema)
    model = langid.fit(docs)
    got = langid.identify(docs, model, host=F.col("source")).collect()
    assert len(got) == 300 and all(r.accepted and r.language == ("en" if r.doc_id % 2 else "de") for r in got)
    odd = make(spark, [(1, None, "h1.uk", "uk", "en"), (2, "", None, None, None), (3, "12345 !!", None, "de", None), (4, "Ж" * 300, None, None, None), (5, "th", "h0.de", "de", "de"), (None, "the and thing", None, None, None)], "doc_id long, text string, host string, tld string, said string")
    pages = odd.unionByName(make(spark, [(i + 100, t, s, s[-2:], l) for i, t, l, s in labelled(200, 2)], odd.schema))
    out = {r.doc_id: r for r in langid.identify(pages, model, host=F.col("host"), suffix=F.col("tld"), declared=F.col("said")).collect()}
    assert len(out) == 206 and [out[i].accepted for i in (1, 2, 3, 4, None)] == [False, False, False, False, True]
    assert out[1].language == "en" and out[5].language == "de"  # host, suffix and declaration outweigh two letters


def test_language_filter_keeps_clean_documents(spark):
    schema = "doc_id long, text string, lang string, source string"
    rows = labelled(200, 3) + [(900, None, "en", None), (901, "...", None, "x"), (None, None, None, None)]
    kept = langid.keep_identified(make(spark, rows, schema)).collect()
    assert sorted([r.doc_id for r in kept], key=str) == sorted([*range(200), None], key=str)
    assert langid.keep_identified(make(spark, [], schema)).count() == 0
    assert langid.keep_identified(make(spark, [(1, "x", None, None)], schema)).count() == 1


def test_mixing_meets_targets(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(["w"] * rng.randint(0, 40)), rng.choice(["a"] * 12 + ["b", "c", "d", "Z", None])) for i in range(3000)]
    rows += [(5000, None, "a"), (5001, "", "only-empty"), (5001, "", "only-empty")]
    docs = make(spark, rows, "doc_id long, text string, source string")
    sized = docs.select("doc_id", "source", mixing.n_words(F.col("text")).alias("size")).cache()
    plan = {r.source: (r.source_size, r.weight, r.target) for r in mixing.source_targets(sized).collect()}
    names = sorted([s for s in plan if s is not None]) + [None]
    total = sum(v[0] for v in plan.values())
    expect = dict.fromkeys(plan, 0.0)
    capped = set()
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    while True:  # clamp and share the rest anew until none is above
        free = [s for s in names if s not in capped]
        level = (1.5 * total - sum(2 * plan[s][0] for s in capped)) / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > 2 * plan[s][0]}
        if not over:
            break
        capped |= over
    expect = {s: 2.0 * plan[s][0] if s in capped else weight[s] * level for s in names}
    assert all(math.isclose(plan[s][2], expect[s]) and plan[s][1] == weight[s] for s in names)
    got = mixing.with_copies(sized, mixing.mix_plan(sized)).collect()
    taken = collections.Counter()
    for r in got:
        taken[r.source] += r.copies * r["size"]
        assert 0 <= r.copies <= 2
    assert len(got) == len(rows) and all(abs(taken[s] - expect[s]) <= 41 for s in names)
    mixed = mixing.mix_sources(docs.withColumn("copy", F.lit("clash")).withColumn("bits", F.lit(1)))
    again = mixing.mix_sources(docs)
    assert mixed.columns == ["doc_id", "text", "source", "bits", "copy"] and sorted(map(str, mixed.select("doc_id", "copy").collect())) == sorted(map(str, again.select("doc_id", "copy").collect()))


def test_mixing_of_nothing(spark):
    docs = make(spark, [], "doc_id long, text string, source string")
    assert mixing.mix_sources(docs).count() == 0
    assert mixing.mix_sources(make(spark, [(1, None, None)], docs.schema)).count() == 0


def test_warc_round_trip(spark):
    big, trap = "é" * 600, "WARC/1.1\r\nContent-Length: 5\r\n\r\nx\r\n\r\n" * 40
    rows = [(1, "http://a.example/x y\r\n", big), (7, "https://b.example", big), (3, None, big), (4, "http://c.example/p?q", trap), (5, "x", None), (6, "x", ""), (8, "y", "short"), (9, "y", "short"), (7, "https://b.example", big), (None, "n", big), (10, "z", "L" * 500_000)]
    pages = make(spark, rows, "page_id long, url string, html string")
    got = warc.captures(pages, classes=((1000, 5), (10_000, 4), (None, 3))).collect()
    seen = []
    for r in got:
        assert len(r.requests) == 1 and len(r.metadata) == 1 and r.requests[0].http_headers.startswith("GET ")
        page = r.metadata[0].fields["page-id"]
        seen.append((int(page) if page else None, r.response.warc_type, None if r.response.warc_type == "revisit" else r.response.payload.decode(), r.metadata[0].fields["refers-to-page-id"]))
    expect = [(i, "revisit", None, "7") if h == big and not (i == 7 and k == 1) else (i, "response", h or "", "") for k, (i, _, h) in enumerate(rows)]
    assert sorted(seen, key=str) == sorted(expect, key=str)
    ids = {r.capture_id for r in got}
    assert len(ids) == len(rows) and all(r.response.refers_to in ids for r in got if r.response.warc_type == "revisit")
    assert warc.captures(make(spark, [], pages.schema)).count() == 0


def test_warc_reader_and_chains(spark):
    records = [{"warc_type": t, "record_id": i, "concurrent_to": c} for t, i, c in [("response", "r1", ["q1"]), ("request", "q1", []), ("metadata", "m1", ["q1"]), ("request", "q9", ["gone"]), ("response", "r2", [])]]
    full = [tuple(r.get(c, {} if c in ("headers", "fields") else None) for c in ("warc_type", "record_id", "concurrent_to", "headers", "fields")) for r in records]
    df = spark.createDataFrame(full, "warc_type string, record_id string, concurrent_to array<string>, headers map<string,string>, fields map<string,string>")
    got = {r.capture_id: ([x.record_id for x in r.requests], [x.record_id for x in r.metadata]) for r in warc.assemble(df).collect()}
    assert got == {"r1": (["q1"], ["m1"]), "r2": ([], [])}
    block = b"HTTP/1.1 404 Not Found\r\nA: b\r\n\r\n\r\n\r\nbody"
    data = b"junk\nWARC/1.0\r\nWARC-Type: response\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\nWARC/1.0\r\nContent-Length: 99\r\n\r\ncut"
    (one,) = warc.parse_archive(data)
    assert one["payload"] == b"\r\n\r\nbody" and one["http_status"] == 404 and one["payload_sha1"] == hashlib.sha1(b"\r\n\r\nbody").hexdigest()
    for packed in (gzip.compress(data), b"".join(gzip.compress(data[i : i + 7]) for i in range(0, len(data), 7)), gzip.compress(data) + b"tail", gzip.compress(data)[:-9]):
        assert [x["payload"] for x in warc.parse_archive(packed)] == [one["payload"]]
    long = b"WARC/1.0\r\nContent-Length: 9000000\r\n\r\n" + b"\r\nWARC/1.0\r\n" * 700_000 + b"x" * 600_000 + b"\r\n\r\n" + data[5:]
    assert [len(x["payload"]) for x in warc.parse_archive(gzip.compress(long, 1))] == [9_000_000, 8]


def brute_noise(pages):
    """The style tree of a site's pages by dictionaries: path -> log odds of being main text; what is negative is noise."""
    seen, prior = collections.defaultdict(list), {}
    for page in dict.fromkeys(pages):
        for path, p, kind, value in style_tree.page_features(page):
            seen[path, kind].append(value)
            prior[path] = min(p, prior.get(path, p))
    odds = {}
    for path in prior:
        top = bottom = pages_of = 0.0
        for (q, kind), values in seen.items():
            if (q + "/").startswith(path + "/"):
                m = len(values)
                entropy = -sum(c / m * math.log(c / m) for c in collections.Counter(values).values()) / math.log(m) if m > 1 else 1.0
                weight = style_tree.GAMMA ** (q.count("/") - path.count("/")) * m
                top, bottom, pages_of = top + weight * entropy, bottom + weight, pages_of + m * (q == path)
        odds[path] = prior[path] + style_tree.STRENGTH * (top / bottom - 0.5) * pages_of / (pages_of + style_tree.KAPPA)
    return {style_tree.path_hash(p) for p, o in odds.items() if o < 0}


def alone(page):
    """The main text of the only page of its site."""
    return style_tree.main_text(page, brute_noise([page]))


def random_page(rng):
    box = lambda tag, inner, c="": f"<{tag}{f' class={chr(34)}{c}{chr(34)}' if c else ''}>{inner}</{tag}>"
    fill = lambda n: " ".join(rng.choices("abcdefghijk", k=n))
    parts = [box("nav", box("ul", "".join(box("li", fill(1)) for _ in range(3)))), box("div", rng.choice(["buy now", "click here", fill(3)]), rng.choice(["ad", "share-price", "teaser"]))]
    parts.append(box(rng.choice(["article", "main", "div"]), box("h1", fill(4)) + "".join(box("p", fill(20)) for _ in range(rng.randint(1, 4))) + box("ul", "<li>Subscribe<li>Follow us")))
    return "<html><body>" + "".join(rng.sample(parts, rng.randint(1, 3))) + box("footer", "all rights") + "</body></html>"


def test_style_tree_matches_brute_force(spark):
    rng = random.Random(12)
    rows = [(i, f"http://h{rng.choice([0, 0, 0, 0, 1, 1, 2, 3 + i])}.example/{i}", random_page(rng)) for i in range(150)]
    rows += [(200, None, random_page(rng)), (201, rows[0][1], None), (202, rows[0][1], ""), (203, rows[0][1], rows[0][2])]
    pages = make(spark, rows, "page_id long, url string, html string")
    by_host = collections.defaultdict(list)
    for _, u, h in rows:
        if h is not None:
            by_host[u and u.split("/")[2]].append(h)
    noise = {host: brute_noise(p) for host, p in by_host.items()}
    found = {r.host or None: set(r.paths) for r in style_tree.noise_branches(pages).collect()}
    assert found == {host: n for host, n in noise.items() if n}
    got = {r.page_id: r.text for r in style_tree.extract(pages).collect()}
    assert got == {i: style_tree.main_text(h or "", noise[u and u.split("/")[2]]) for i, u, h in rows}
    assert sum(got[i] != style_tree.main_text(h or "") for i, _, h in rows) > 100  # without the tree


def test_deep_and_long_pages_take_linear_time():
    began = time.process_time()
    page = "<div>x" * 170_000
    assert style_tree.main_text(page, {1}) == " ".join(["x"] * 170_000) and len(style_tree.page_features(page)) == style_tree.DEPTH
    assert style_tree.main_text("<article>x</article>" + page, {1}) == " ".join(["x"] * 170_001)
    assert style_tree.main_text("<p><i>" * 60_000 + "y</span>" * 60_000, {1}).count("y") == 60_000
    assert time.process_time() - began < 60


@pytest.mark.parametrize(
    "page, text",
    [
        ("", ""),
        ("plain &lt;text&gt;\n two", "plain <text> two"),
        ("<html><head><title>T</title><style>p{}</style></head><body><script>var t='</p>';</script><p>A<b>b</b>&nbsp;c<p>d<br>e</body>", "Ab c d e"),
        ("<body class='with-sidebar'><header>H</header><main><div class=menu>m</div><h1>x</h1><ul><li>1<li>2</ul></main><div id=sidebar>s</div><footer>f</footer>", "x 1 2"),
        ("<article><header><h1>t</h1></header><p>one</p><aside>z</aside><form>f</form><div class='post-comments'><p>c</p></div></article><p>outside</p>", "t one"),
        ("<div class='ad'>buy</div><div class='cookie-notice'>ok</div><p>kept</p><div hidden>no</div><div style='display: none'>no</div>", "kept"),
        ("<table><tr><td>a<td>b<tr><td>c</table><!-- gone <p>x</p> -->end", "a b c end"),
        ("<p title='a>b'>q</p><unclosed", "q <unclosed"),
        ("<article>" + "<div>" * 3000 + "deep" + "</div>" * 3000 + "</article>", "deep"),
    ],
)
def test_main_text(page, text):
    assert alone(page) == text


def test_style_tree_removes_what_a_site_repeats(spark):
    page = "<html><body><div class='top'><span>Same everywhere</span></div><div class='story'><p>story {0} is told here {0}</p></div><div class='end'><p>All rights kept</p></div></body></html>"
    rows = [(i, f"http://site.example/{i}", page.format(i)) for i in range(12)] + [(20, "http://other.example/", page.format(20)), (21, None, None), (22, "http://copy.example/1", page.format(0)), (23, "http://copy.example/2", page.format(0))]
    pages = make(spark, rows, "page_id long, url string, html string").withColumn("Text", F.lit("clash"))
    got = {r.page_id: r.text for r in style_tree.extract(pages).collect()}
    assert all(got[i] == f"story {i} is told here {i}" for i in range(12))
    assert got[20].startswith("Same everywhere story 20") and got[21] == "" and got[22].startswith("Same everywhere story 0")
    assert style_tree.extract(make(spark, [], "page_id long, url string, html string")).count() == 0


def toxic_rows(n, seed):
    rng = random.Random(seed)
    vocab = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(400)]
    rows = []
    for i in range(n):
        text, bad = rng.choices(vocab, k=rng.randint(5, 200)), rng.random() < 0.3
        if bad:
            text[rng.randrange(len(text))] = rng.choice(["zzscum,", "Zzidiot", "vexxor" + rng.choice(["a", "en", "ik", "um", "ost"])])
        rows.append((i, " ".join(text), int(bad)))
    return rows


def test_toxicity_network_learns_words_and_stems(spark):
    rows = toxic_rows(900, 5)
    docs, labels = make(spark, [r[:2] for r in rows]), make(spark, [(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    net = toxicity.train(docs, labels, F.col("doc_id") % 3 != 0)
    odd = make(spark, [(5000, None), (5001, ""), (None, "clean"), (5002, "aa " * 60_000 + "zzscum")])
    got = {r.doc_id: r.score for r in toxicity.score_texts(docs.unionByName(odd), net).collect()}
    held = [(got[i] >= 0.5) == bool(y) for i, _, y in rows if i % 3 == 0]
    assert sum(held) / len(held) > 0.95 and len(got) == 904 and all(0 <= s <= 1 for s in got.values())
    assert got[5000] == got[5001] < 0.5 < got[5002]
    assert toxicity.train(docs, labels.where("toxic = 0"), F.lit(True)) is None and toxicity.score_texts(docs, None).where("score = 0").count() == 900


def test_toxicity_gradients():
    rng = np.random.default_rng(1)
    net = toxicity.Network(np.sort(rng.integers(0, 2**63, 5).astype(np.uint64)), np.zeros(5, np.float32), np.zeros(toxicity.CHAR_BINS, np.float32))
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x = rng.standard_normal((9, toxicity.WORD_DIM + toxicity.CHAR_DIM))
    ids, lengths = rng.integers(0, 9, (toxicity.WINDOW, 4)), np.array([48, 30, 7, 1])
    loss = lambda: float(net.run(ids, lengths, net.gates(x))[0].sum())
    _, trace = net.run(ids, lengths, net.gates(x), keep=True)
    grads, d_gates = net.gradients(ids, trace, np.ones(4))
    for name in ("Uf", "Ub", "A", "v", "out"):
        at = tuple(rng.integers(0, s) for s in net.p[name].shape)
        held = net.p[name][at]
        net.p[name][at] = held + 1e-3
        up = loss()
        net.p[name][at] = held - 1e-3
        down = loss()
        net.p[name][at] = held
        assert abs((up - down) / 2e-3 - grads[name][at]) < 2e-3 * max(1, abs(grads[name][at])), name


def test_pipeline_stages_take_effect(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(9)
    vocab = EN + [f"{a}{b}" for a in EN for b in EN]
    clean = [" ".join(rng.choices(vocab, k=120)) for _ in range(40)]
    bench = " ".join(rng.choices(vocab, k=30))
    line = "this very common line is found in many of the documents here"
    rows = [(i, t, "en", "s1" if i % 2 else "s0", len(t)) for i, t in enumerate(clean)]
    rows += [(100, clean[0].upper(), "en", "s0", 0), (101, clean[1] + " more", "en", "s1", 0), (102, "the " + bench, "en", "s0", 0), (103, "...", "en", "s0", 3), (104, None, None, None, None)]
    rows += [(200 + k, " ".join(rng.choices(vocab, k=60)) + "\n" + line, "en", "s1", 0) for k in range(6)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = [{r.doc_id for r in docs.collect()}]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = f"{tmp_path}/stage{i}"
        stage(spark, docs, str(tmp_path)).write.parquet(path)
        docs = spark.read.parquet(path)
        seen.append({r.doc_id for r in docs.collect()})
        if i < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if i == 1:
            assert {r.doc_id for r in docs.where(F.col("text").contains(line)).collect()} == {205}
    assert [seen[i] - seen[i + 1] for i in range(4)] == [{103, 104}, set(), {100, 101}, {102}]
    assert seen[5] <= seen[4]
    run = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(str, run.collect())) == sorted(map(str, docs.collect()))
