"""Line dedup, near-duplicates, decontamination, fingerprints: against brute force on small tables."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkgrid.llm import chosen_path, common, components, decontaminate, line_dedup, omh
from larkgrid.llm.tokens import shingles, words

DOCS = "doc_id long, text string, source string, TEXT2 string, n_lines string, c string"


def make(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


def lower(s):
    return s.translate({i: i + 32 for i in range(65, 91)})


def brute_lines(rows, min_chars=40, min_docs=5):
    docs = {}
    for i, t in rows:
        if i is not None:
            for x in (t or "").split("\n"):
                k = lower(x.strip(" \t\n\x0b\x0c\r"))
                if len(k) >= min_chars:
                    docs.setdefault(k, set()).add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or not (len(docs.get(k := lower(x.strip(" \t\n\x0b\x0c\r")), ())) >= min_docs and i != max(docs[k]))]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def test_line_dedup_matches_brute_force(spark):
    rng = random.Random(1)
    common = [("Ä" if k % 2 else "a") * 38 + f"{k:02d}" for k in range(6)] + ["x" * 39, "é" * 40]
    rows = []
    for i in range(60):
        lines = [rng.choice([c, c.upper() if c.isascii() else c, f" \t{c}\x0b", f"own {i} {rng.random()}"]) for c in rng.choices(common, k=rng.randint(0, 6))]
        rows.append((i, "\n".join(lines)))
    rows += [(60, None), (61, ""), (62, "\n\n"), (7, rows[7][1]), (None, common[0]), (63, "z" * 300_000 + "\n" + common[0])]
    got = sorted([(r.doc_id, r.n_lines, r.n_dropped, r.text or "") for r in line_dedup.dedup_lines(make(spark, rows)).collect()], key=str)
    assert got == brute_lines(rows)


def test_line_dedup_levels_compact_and_extra_columns_stay(spark):
    line = "a line that is certainly long enough to count"
    rows = [(i, line, None, "t2", "clash", "c") for i in range(12)]
    out = line_dedup.dedup_lines(make(spark, rows, DOCS), batches=6, fanout=2)
    assert out.columns == ["doc_id", "text", "source", "TEXT2", "c", "n_lines", "n_dropped"]
    assert sorted((r.doc_id, r.text, r.n_dropped) for r in out.collect()) == [(i, "" if i < 11 else line, int(i < 11)) for i in range(12)]
    store = line_dedup.LineRuns(spark, fanout=2)
    for lo in (8, 4, 0):
        store.add(make(spark, [(b"k", i) for i in range(lo, lo + 4)], "h binary, doc_id long"))
    assert [len(x) for x in store.levels] == [1, 1] and store.frequent(5).collect() == [(b"k", 12, 11)]
    store.close()


def test_line_runs_hold_a_key_once_and_are_met_without_exchanges(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(f"{rng.randrange(300):03d}".encode(), i) for i in range(1000) for _ in range(2)]
    batches = [make(spark, [r for r in rows if lo <= r[1] < lo + 125], "h binary, doc_id long") for lo in range(875, -1, -125)]
    store = line_dedup.LineRuns(spark, fanout=2)
    for b in batches[:7]:
        store.add(b)
    assert [len(x) for x in store.levels] == [1, 1, 1]
    held = [r.h for run in store.runs() for r in run.collect()]
    assert len(held) == len(set(held))
    own = batches[7].groupBy("h").agg(F.countDistinct("doc_id").alias("n_docs"), F.max("doc_id").alias("keeper"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        with store.sorted_scans():
            new = store.unknown(own)[0]
            plan = new._jdf.queryExecution().executedPlan().toString()
            alone = own._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert plan.count("SortMergeJoin") == 3 and plan.count("Exchange") == alone.count("Exchange")
    assert plan.count("Sort [") == 1  # of the batch
    store.add(batches[7])
    docs = {}
    for h, i in rows:
        docs.setdefault(h, set()).add(i)
    expect = sorted((h, len(d), max(d)) for h, d in docs.items() if len(d) >= 5)
    assert sorted(tuple(r) for r in store.frequent(5).collect()) == expect
    store.close()
    # without the anti-join, keys stand in several runs, each with a keeper of its own
    monkeypatch.setattr(line_dedup.LineRuns, "unknown", lambda self, own: (own, own.limit(0).select("h", "n_docs")))
    broken = line_dedup.LineRuns(spark, fanout=9)
    for b in batches:
        broken.add(b)
    assert sorted(tuple(r) for r in broken.frequent(5).collect()) != expect
    broken.close()


@pytest.mark.parametrize("run", [line_dedup.dedup_lines, chosen_path.near_duplicates, omh.edited_neighbours, omh.fingerprints, lambda d: decontaminate.find_leaks(d, d.withColumnRenamed("doc_id", "item_id"))])
def test_empty_tables(spark, run):
    assert run(make(spark, [])).count() == 0


def test_words_and_shingles_match_python():
    texts = ["", "  ", "One two\tTHREE\n one Two three four", "é É a", "x", "a b", "a\x0bb\x0cc\rd", "a b c a b c"]
    raw = [t.encode() for t in texts]
    data, offs = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]).astype(np.int64)
    h, before = words(data, offs)
    expect = [[lower(w) for w in re.findall(r"[^\x20\x09-\x0D]+", t)] for t in texts]
    assert np.diff(before).tolist() == [len(e) for e in expect]
    named = {}
    for w, x in zip(itertools.chain(*expect), h.tolist()):
        assert named.setdefault(w, x) == x
    assert len(set(named.values())) == len(named)
    values, bounds = shingles(h, before, 3)
    assert np.diff(bounds).tolist() == [len({tuple(e[i : i + 3]) for i in range(max(1, len(e) - 2))}) if e else 0 for e in expect]
    assert values[bounds[2] : bounds[3]].tolist() == sorted(set(values[bounds[2] : bounds[3]].tolist()))


def brute_components(rows, k, percent):
    def shingle(t):
        w = [lower(x) for x in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()

    sets = [(i, shingle(t)) for i, t in rows]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (i, a), (j, b) in itertools.combinations(sets, 2):
        if a and b and 100 * len(a & b) >= percent * len(a | b):
            x, y = sorted((find(i), find(j)))
            parent[y] = x
    return sorted((i, len(s), find(i), find(i) == i) for i, s in sets)


def family(rng, vocab, n, edits, length=120):
    base = rng.choices(vocab, k=length)
    out = [" ".join(base)]
    for _ in range(n - 1):
        copy = base[:]
        for _ in range(rng.randint(0, edits)):
            copy[rng.randrange(length)] = rng.choice(vocab)
        out.append(" ".join(copy))
    return out


def test_near_duplicates_match_brute_force(spark):
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(3000)]
    texts = [t for _ in range(12) for t in family(rng, vocab, rng.choice([1, 2, 5, 12]), 3)]
    texts += ["", None, " \n", "one two", "ONE  two", "one", "a b c", "A B C", " ".join(rng.choices(vocab, k=20_000))]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    for k, percent in ((3, 85), (5, 80)):
        got = chosen_path.near_duplicates(make(spark, rows), k, percent).collect()
        assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == brute_components(rows, k, percent)


def test_large_groups_of_near_copies_are_whole(spark):
    """A family larger than a leaf goes through hubs, pruning and chunks."""
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(3000)]
    rows = list(enumerate(family(rng, vocab, 150, 4) + family(rng, vocab, 40, 2) + [" ".join(rng.choices(vocab, k=60)) for _ in range(40)]))
    docs = make(spark, rows)
    for options in ({"leaf": 64, "chunk": 32, "exact": 9000}, {"leaf": 16, "chunk": 32, "part_shingles": 500}):
        got = chosen_path.near_duplicates(docs, 3, 85, **options).collect()
        assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == brute_components(rows, 3, 85)


def test_unlinked_documents_with_a_template_part_ways(spark, monkeypatch):
    """Nodes branch until they are small: no pairs by the square, and the few links among them are found."""
    rng = random.Random(14)
    vocab = [f"w{i}" for i in range(5000)]
    template = rng.choices(vocab, k=60)
    own = [rng.choices(vocab, k=60) for _ in range(500)]
    pairs = [[" ".join(template + x), " ".join(template + x[:58] + ["changed", "end"])] for x in (rng.choices(vocab, k=60) for _ in range(40))]
    rows = list(enumerate([" ".join(template + x) for x in own] + [t for p in pairs for t in p]))
    asked, whole = [], chosen_path.candidates

    def noted(groups, *more):
        sizes = groups.groupBy("gid").agg(F.count_if(F.col("side") == 0).alias("own"), F.count(F.lit(1)).alias("n"))
        asked.append(sizes.agg(F.sum(F.col("own") * (F.col("n") - F.col("own")) + F.col("own") * (F.col("own") - 1) / 2)).first()[0] or 0)
        return whole(groups, *more)

    monkeypatch.setattr(chosen_path, "candidates", noted)
    for exact in (0, chosen_path.EXACT):  # by branching alone, and as one family
        asked.clear()
        got = chosen_path.near_duplicates(make(spark, rows), 3, 85, leaf=128, exact=exact).collect()
        assert {(r.component_id, r.doc_id) for r in got if not r.kept} == {(500 + 2 * i, 501 + 2 * i) for i in range(40)}
        assert sum(asked) < len(rows) * np.log2(len(rows)) * 128


def test_bit_filter_knows_every_hash(spark):
    rows = [(int(x),) for x in np.random.default_rng(3).integers(-(2**63), 2**63 - 1, 5000)] + [(0,), (-1,), (65535,), (65536,)]
    for bits in (1 << 16, 1 << 20):
        table = common.bit_filter(make(spark, rows, "h long"), "h", bits)
        values = np.array([r[0] for r in rows]).view(np.uint64)
        assert len(table) * 32 == bits and len(common.in_filter(table, values)) == len(rows)
        assert sum(int(x).bit_count() for x in table) == len({int(v) % bits for v in values})


def test_near_duplicates_of_null_and_repeated_ids(spark):
    rows = [(None, "a b c d"), (None, "a b c d"), (5, "a b c d"), (5, "p q r s"), (9, "p q r s")]
    got = sorted([(r.doc_id, r.component_id, r.kept) for r in chosen_path.near_duplicates(make(spark, rows), 3, 85).collect()], key=str)
    assert got == sorted([(None, None, True)] * 2 + [(5, 5, True)] * 2 + [(9, 5, False)], key=str)
    assert sorted([r.doc_id for r in chosen_path.drop_near_duplicates(make(spark, rows)).collect()], key=str) == sorted([None, None, 5, 5], key=str)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 100 + i) for i in range(1, 20)] + [(200, 200)]
    got = {r.v: r.c for r in components.components(make(spark, edges, "a long, b long")).collect()}
    assert got == {r.v: r.c for r in components.components(make(spark, edges, "a long, b long"), small=0).collect()}
    assert got == {i: 0 for i in range(31)} | {100 + i: 100 for i in range(20)} | {200: 200}


def test_decontamination_finds_substituted_passages(spark):
    rng = random.Random(5)
    vocab = [f"v{i}" for i in range(400)]
    items = [rng.choices(vocab, k=rng.randint(14, 60)) for _ in range(20)]
    rows, leaky = [], set()
    for i in range(120):
        text = rng.choices(vocab, k=rng.randint(0, 300))
        if i % 3 == 0:
            item = items[i % 20][:]
            for p in range(5, len(item), 11):  # every eleventh word differs
                item[p] = "changed"
            at = rng.randint(0, len(text))
            text[at:at] = item
            leaky.add((i, i % 20))
        rows.append((i, " ".join(text).upper() if i % 2 else " ".join(text)))
    rows += [(500, None), (501, ""), (None, " ".join(items[0])), (502, " ".join(items[1])), (502, " ".join(items[1]))]
    bench = make(spark, [*[(j, " ".join(x)) for j, x in enumerate(items)], (90, None), (91, "short"), (None, "no id at all here")], "item_id long, text string")
    found = decontaminate.find_leaks(make(spark, rows), bench).collect()
    assert {(r.doc_id, r.item_id) for r in found} == leaky | {(502, 1)} and len(found) == len(leaky) + 1
    kept = decontaminate.decontaminate(make(spark, rows), bench).collect()
    assert sorted([r.doc_id for r in kept], key=str) == sorted([i for i, _ in rows if i != 502 and (i, (i or 0) % 20) not in leaky], key=str)


def test_chance_overlaps_are_not_leaks(spark):
    bench = make(spark, [(1, " ".join(f"b{i}" for i in range(40)))], "item_id long, text string")
    docs = make(spark, [(1, "x y " + " ".join(f"b{i}" for i in range(7)) + " z"), (2, " ".join(f"b{i}" for i in range(5, 18)))])
    assert [r.doc_id for r in decontaminate.find_leaks(docs, bench).collect()] == [2]


def brute_omh(text: bytes, m, ell, seed):
    from larkgrid.llm.tokens import U64, mix64, seeds

    data = text + b"\0" * max(0, omh.K - len(text))
    n, seen, h = len(data) - omh.K + 1, {}, []
    bits = max(1, (n - 1).bit_length())
    low = (1 << bits) - 1
    mix = lambda x: int(mix64(np.array([x & (2**64 - 1)], U64))[0])
    for i in range(n):
        x = mix(int.from_bytes(data[i : i + omh.K], "little"))
        nth = seen[x & ~low] = seen.get(x & ~low, -1) + 1
        h.append((mix(x + nth * 0x9E3779B97F4A7C15) if nth else x) >> 32)
    out = []
    for mult in ((seeds(m, seed + 1) >> U64(32)).astype(np.uint32) | np.uint32(1)).tolist():
        best = sorted(i for _, i in sorted((x * mult % 2**32, i) for i, x in enumerate(h))[: min(ell, n)])
        acc = 0
        for j, i in enumerate(best):
            acc = mix(acc * 0x100000001B3 + h[i] + j + 1)
        out.append(acc >> 32)
    return out


def test_order_minhash_matches_brute_force():
    rng = random.Random(6)
    for text in (b"", b"a", b"abcdefgh", b"aaaaaaaaaaaaaaaaaaaaaaaa", bytes(rng.choices(b"ab", k=500)), "größe ".encode() * 40, bytes(rng.choices(b"abcdef ", k=9000))):
        with np.errstate(over="ignore"):
            expect = brute_omh(text, 8, 3, 2)
        assert omh.order_minhash(text, 8, 3, 2).tolist() == expect
        for keep in (0, 5, len(text) // 2, len(text)):  # a shared beginning is selected from once
            orders = omh.Orders(8, 3, 2)
            own, head, n = orders.of(text, keep)
            edited = text[:keep] + b"quite another end"
            assert own.tolist() == expect and orders.after(edited, head, n).tolist() == omh.order_minhash(edited, 8, 3, 2).tolist()


def test_order_minhash_feels_order():
    rng = random.Random(7)
    text = bytes(rng.choices(b"abcdefghijklmnop ", k=3000))
    swapped = text[1500:] + text[:1500]
    a = omh.order_minhash(text, 256)
    same_content = omh.likeness(a, omh.order_minhash(swapped, 256))
    near = omh.likeness(a, omh.order_minhash(text[:1400] + b"#" * 20 + text[1420:], 256))
    assert omh.likeness(a, a) == 1 and near > 0.9 > 0.75 > same_content > 0.2


def test_edited_neighbours_match_brute_force(spark):
    rng = random.Random(8)
    rows = [(i * 3, "".join(rng.choices("abc äé\n", k=rng.randint(0, 400)))) for i in range(70)]
    rows += [(300, None), (301, ""), (9, "repeated id"), (None, "no id"), (None, "another"), (302, "x" * 200_000)]
    rows += [(i, f"{w} {k}") for k in range(60) for i, w in ((150, "hot id"), (None, "without id"))]
    h = {r.text: r.h for r in make(spark, rows).select(F.coalesce("text", F.lit("")).alias("text")).select("text", F.xxhash64(F.col("text").cast("binary")).alias("h")).collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), h[r[1] or ""]))
    expect = []
    for (i, t), (_, nxt) in zip(order, order[1:] + order[:1]):
        t, nxt = t or "", nxt or ""
        half = len(t) // 2
        e = t[: len(t) - half] + nxt[:half]
        a, b, c = (omh.order_minhash(x.encode()) for x in (t, e, nxt))
        expect.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), omh.to_hex(a), omh.to_hex(b), omh.likeness(a, b), omh.likeness(a, c)))
    for size in (1000, 1 << 25):
        got = [tuple(r) for r in omh.edited_neighbours(make(spark, rows), range_bytes=size).collect()]
        assert sorted(got, key=str) == sorted(expect, key=str)


def test_hot_ids_and_rows_without_ids_are_cut_into_ranges(spark):
    rows = [(i, f"{w} {k} " + "x" * 100) for k in range(400) for i, w in ((150, "hot"), (None, "none"), (k, "own"))]
    docs = make(spark, rows).withColumn("text", F.col("text").cast("binary")).withColumn("h", F.xxhash64("text"))
    dealt, buckets = omh.ranges(docs, 4000)
    found = dealt.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("hi"), F.min("doc_id").alias("lo")).orderBy("bucket").collect()
    assert max(r.n for r in found) < 120 and found[-1].bucket < buckets and len(found) > 25
    assert all(a.lo >= b.hi for a, b in zip(found, found[1:]) if a.lo is not None and b.hi is not None)
