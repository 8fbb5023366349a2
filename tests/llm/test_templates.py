"""Pages of one template: many that share most sketches, few that are linked."""

import numpy as np
import pytest

from tramo.llm import ngram_join


def pages(rng, n, own=1, base=13, copies=3):
    words = [f"common{k}" for k in range(base)]
    rows = []
    for i in range(n):
        w = [*words]
        for k in range(own):
            w.insert(int(len(w) * (k + 1) / own), f"id{i}x{k}")
        rows.append((i, " ".join(w)))
    more = []
    for i in range(0, n, max(1, n // copies)):
        w = rows[i][1].split()
        more += [(n + i, " ".join([*w[:-1], "changed"])), (2 * n + i, " ".join([*w, "tail", "of", "it"])), (3 * n + i, " ".join(w[3:]))]
    return rows + more + [(10**6, " ".join(words)), (10**6 + 1, " ".join(words[:-2]))]


def brute(rows, k, percent):
    sets = {i: ngram_join.shingles(t, k) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in range(len(ids)):
        for b in range(a):
            x, y = sets[ids[a]], sets[ids[b]]
            both = len(x & y)
            if x and 100 * both >= percent * (len(x) + len(y) - both):
                p, q = find(ids[a]), find(ids[b])
                root[max(p, q)] = min(p, q)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("k, percent, own, base", [(3, 90, 1, 13), (5, 80, 1, 30), (3, 90, 4, 60), (3, 80, 2, 40), (3, 90, 2, 90)])
def test_classes_of_templates(spark, monkeypatch, k, percent, own, base):
    monkeypatch.setattr(ngram_join, "HOT", 20)
    monkeypatch.setattr(ngram_join, "BLOCK", 16)
    rows = pages(np.random.default_rng(1), 90, own, base)
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in ngram_join.classes(d, ngram_join.Join(k=k, percent=percent)).collect()}
    assert got == brute(rows, k, percent)


def test_drawn_families(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "HOT", 12)
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    rng = np.random.default_rng(7)
    rows = []
    for family in range(3):
        words = [f"f{family}w{k}" for k in range(40 + 30 * family)]
        for _ in range(50):
            w = [*words]
            for _ in range(int(rng.integers(0, 5))):
                w[int(rng.integers(0, len(w)))] = f"x{int(rng.integers(0, 12))}"
            rows.append((len(rows), " ".join(w[int(rng.integers(0, 3)) :])))
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for k, percent in ((3, 90), (3, 75), (5, 80)):
        got = {r.doc_id: r.component_id for r in ngram_join.classes(d, ngram_join.Join(k=k, percent=percent)).collect()}
        assert got == brute(rows, k, percent), (k, percent)


def test_pairs_grow_with_the_pages(spark, monkeypatch):
    made = []
    was = ngram_join._open_pairs

    def counted(rest, *a):
        out = was(rest, *a)
        made.append((rest.count(), out.count()))
        return out

    monkeypatch.setattr(ngram_join, "_open_pairs", counted)
    monkeypatch.setattr(ngram_join, "HOT", 256)
    sizes = {}
    for n in (600, 2400):
        made.clear()
        rows = [(i, " ".join([f"terms{k}" for k in range(13)] + ["see", f"id{i}"])) for i in range(n)]
        d = spark.createDataFrame(rows, "doc_id long, text string")
        got = ngram_join.classes(d, ngram_join.Join(k=3, percent=90))
        assert got.where("doc_id <> component_id").count() == 0
        sizes[n] = (sum(x for x, _ in made), sum(y for _, y in made))
    assert sizes[2400][0] <= 5 * max(sizes[600][0], 200) and sizes[2400][1] <= 5 * max(sizes[600][1], 200), sizes


def drawn(rng, n):
    return [" ".join(f"w{x}" for x in rng.integers(0, 10**6, int(rng.integers(150, 400)))) for _ in range(n)]


def test_sketches_of_sets_are_not_written(spark, monkeypatch):
    """They are more bytes than the texts; only those that several sets have are."""
    written = []
    was = ngram_join.staging.stage

    def stage(df, name):
        out = was(df, name)
        written.append((name, out.columns, out.count()))
        return out

    monkeypatch.setattr(ngram_join.staging, "stage", stage)
    d = spark.createDataFrame(list(enumerate(drawn(np.random.default_rng(3), 60))), "doc_id long, text string")
    assert ngram_join.classes(d, ngram_join.Join()).where("doc_id <> component_id").count() == 0
    assert all("keys" not in c and rows <= 60 for _, c, rows in written), written


@pytest.mark.parametrize("k, percent", [(3, 90), (5, 80)])
def test_keys_of_instances_and_bits_of_unrelated_sets(spark, k, percent):
    join, texts = ngram_join.Join(k=k, percent=percent), drawn(np.random.default_rng(4), 40)
    d = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    bands, owners = join.bands(), {}
    for r in ngram_join.keys(d, join).collect():
        n = len(ngram_join.shingles(texts[r.node], k))
        instance = int(np.searchsorted(bands["low"], n, side="right")) - 1 + r.up
        assert (r.key & (2**64 - 1)) >> 55 == instance and r.key % 65536 == 0
        owners.setdefault(r.key, set()).add(r.node)
    assert all(len(x) == 1 for x in owners.values())
    h, doc = ngram_join.hashed(texts, k)
    n = np.bincount(doc)
    top = np.full(len(texts), int(np.searchsorted(bands["low"], n.max(), side="right")) - 1)
    bits = [int.from_bytes(b) for b in ngram_join.bit_sketches(h, doc, top, bands)]
    assert all((bits[i] ^ bits[j]).bit_count() > join.apart(n[i] + n[j]) for i in range(40) for j in range(i))


def near_misses(n):
    """Pages of one text that differ a little more than linked ones may, and for each tenth two that it links with."""
    base, rows = [f"common{k}" for k in range(200)], []
    for i in range(n):
        w = [*base]
        for at in (1, 50, 100, 150):
            w[at] = f"id{i}at{at}"
        rows.append((i, " ".join(w)))
        if i % 10 == 0:
            rows += [(n + i, " ".join([*w[:-1], "changed"])), (2 * n + i, " ".join(["begun", *w[1:-1], "changed"]))]
    return rows


def test_rows_of_open_keys_grow_with_the_pages(spark, monkeypatch):
    made, was = [], ngram_join.staging.stage

    def stage(df, name):
        out = was(df, name)
        if {"a", "b"} <= {*out.columns}:
            made.append((name, out.count()))
        return out

    monkeypatch.setattr(ngram_join.staging, "stage", stage)
    sizes = {}
    for n in (100, 300):
        made.clear()
        rows = near_misses(n)
        d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        got = {r.doc_id: r.component_id for r in ngram_join.classes(d, ngram_join.Join(k=3, percent=90)).collect()}
        assert got == brute(rows, 3, 90)
        sizes[n] = sum(x for _, x in made)
        assert max(x for _, x in made) <= 20 * len(rows), made
    assert sizes[300] <= 4 * sizes[100], sizes


@pytest.mark.parametrize("whole", [1, 300, 1 << 17])
def test_links_of_open_keys_by_whole_sets(spark, monkeypatch, whole):
    """In blocks of any size, whether keys are compared as one group or (chained) one by one."""
    monkeypatch.setattr(ngram_join, "WHOLE", whole)
    join, rows = ngram_join.Join(k=3, percent=90), near_misses(40)
    docs = spark.createDataFrame(rows, "id long, text string")
    ids = [i for i, _ in rows]
    none = spark.createDataFrame([], "node long, component long")
    want = brute(rows, 3, 90)
    chained = [(k // 2, i) for k, i in enumerate(ids)] + [(100 + k // 2, i) for k, i in enumerate(ids[1:])]
    for keyed in ([(k, i) for k in (5, 6) for i in ids], chained):
        shared = spark.createDataFrame(keyed, "key long, node long")
        found = ngram_join._open_links(shared, none, docs, join, ngram_join.stage)
        links = {(r.a, r.b) for r in found.collect()}
        met = {(a, b) for k in {k for k, _ in keyed} for a in ids for b in ids if a < b and {(k, a), (k, b)} <= {*keyed}}
        text, root = dict(rows), {i: i for i in ids}
        for a, b in links:
            x, y = ngram_join.shingles(text[a], 3), ngram_join.shingles(text[b], 3)
            assert 100 * len(x & y) >= 90 * len(x | y) and (a, b) in met
        got = {r.node: r.component for r in ngram_join.components(found).collect()}
        if keyed is chained:
            assert all(got.get(a, a) == got.get(b, b) for a, b in met if want[a] == want[b] and abs(a - b) % 40 == 0)
        else:
            assert {i: got.get(i, i) for i in ids} == want
        assert len(found.collect()) <= 60 * len(keyed)
