"""Operators 11 to 13 against plain code and SQL, and disguised words and number signs that once slipped through."""

import hashlib
import itertools
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.test_small_tables import LONG, ROWS, SCHEMA, docs, none  # noqa: F401
from tramo.llm import audit, chat, langid, quality, queries, toxicity, trie

SF = "/root/testdata/sf0.001"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def terms_of(text):
    return re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(text))


def plain_audit(rows, least=10, top=10):
    rows = [(t or "", lang or "", source or "") for t, lang, source in rows]
    docs_with, counts, groups = Counter(), defaultdict(Counter), {(lang, source) for _, lang, source in rows}
    for t, lang, source in rows:
        words = terms_of(t)
        counts[lang, source].update(words)
        docs_with.update({(lang, w) for w in words})
    out = set()
    for lang in {g[0] for g in groups}:
        kept = [w for (x, w), n in docs_with.items() if x == lang and n >= least]
        mine = sorted(s for x, s in groups if x == lang)
        total = {w: sum(counts[lang, s][w] for s in mine) for w in kept}
        share = lambda c, size: 1 + 1_000_000_000 * (c + 2) // (size + 2 * len(kept))  # noqa: B023, E731
        size = {s: sum(counts[lang, s][w] for w in kept) for s in mine}
        p = {s: {w: share(counts[lang, s][w], size[s]) for w in kept} for s in mine}
        q = {w: share(total[w], sum(total.values())) for w in kept}
        far = lambda a, b: (a - b) ** 2 // (a + b)
        for s in mine:
            pairs = sorted(((-sum(far(p[s][w], p[o][w]) for w in kept), o.encode(), o) for o in mine if o != s))
            out |= {(lang, s, "pair", o, -v, k) for k, (v, _, o) in enumerate(pairs, 1)}
            own = sorted((-far(p[s][w], q[w]), w.encode(), w) for w in kept if counts[lang, s][w] and p[s][w] > q[w])[:top]
            out |= {(lang, s, "term", w, -v, k) for k, (v, _, w) in enumerate(own, 1)}
    return out


def audited(df, **changes):
    return {tuple(r) for r in audit.sources(df, audit.Audit(**changes)).select("lang", "source", "part", "item", "value", "rank").collect()}


@pytest.fixture(scope="module")
def corpus():
    rng = np.random.default_rng(3)
    words = ["The", "THE", "rivér", "石", "a1b", "x_y", "tail", "hut", "ΑΒΓ", "ß", "end.", "one-two", "Straße", "İx"]
    rows = []
    for k in range(160):
        lang, source = ["en", "de", None][k % 3], ["s1", "s2", "S10", None, "s2"][k % 5]
        n = int(rng.integers(0, 25))
        rows.append((" ".join(rng.choice(words, n, p=np.roll(np.linspace(1, 14, 14), k % 5) / 105)) if k % 17 else None, lang, source))
    return rows + [("only words here " * 3, "es", "s1"), ("", "es", "s9"), ("!!", "fr", "s1")] + rows[:6]


def test_audit_by_plain_code(spark, corpus):
    d = spark.createDataFrame(corpus, "text string, lang string, source string").repartition(4)
    want = plain_audit(corpus)
    assert len(want) > 60 and audited(d) == want
    # in many blocks and tiles, and with other columns of the names used inside
    odd = d.withColumns({c: F.lit(1) for c in ("term", "n", "src", "total", "block", "value", "size", "doc_id")})
    assert audited(odd, block=4, tile=1) == want and audited(odd, block=6, tile=2) == want
    few = {x for x in plain_audit(corpus, 3, 2)}
    assert audited(d, least=3, top=2) == few


def test_audit_of_odd_rows(spark, docs, none):  # noqa: F811
    want = plain_audit([(t, lang, source) for _, t, lang, source in ROWS], 1, 10)
    assert audited(docs, least=1) == want
    assert audited(none) == set()
    # no term is kept: pairs of value 0, in order of their names
    assert {x[4] for x in audited(docs)} == {0} and {x[2] for x in audited(docs)} == {"pair"}


def test_slices_that_share_a_hash_are_told_apart():
    texts = pa.array(["Ab cd", None, "", "AB", "cd ab é", "x" * 300, "éa", "a"])
    for of in (lambda b: 7, lambda b: len(b), None):
        names, term, doc = audit.slices(texts, of) if of else audit.slices(texts)
        got = [(d, names[k].decode()) for k, d in zip(term.tolist(), doc.tolist(), strict=True)]
        assert got == [(d, w) for d, t in enumerate(texts.to_pylist()) for w in terms_of(t)]
        assert len({*names}) == len(names) or of  # a name may stand twice only where hashes met
        assert {names[k] for k in term.tolist()} == {*names}
    sliced = texts.slice(3, 3)
    names, term, doc = audit.slices(sliced)
    assert [(d, names[k].decode()) for k, d in zip(term.tolist(), doc.tolist(), strict=True)] == [(0, "ab"), (1, "cd"), (1, "ab"), (1, "é"), (2, "x" * 300)]


def test_counts_that_are_given_out_early(spark, corpus, monkeypatch):
    monkeypatch.setattr(audit, "TOGETHER", 20)
    monkeypatch.setattr(audit, "GIVEN", 10)
    c, out = audit._Counts(), Counter()
    for t, lang, source in corpus:
        names, term, doc = audit.slices(pa.array([t or ""]))
        c.add([(lang or "", source or "")], names, term, doc)
        for b in c.give() if c.full() else ():
            out.update({(r["lang"], r["source"], r["term"]): r["n"] for r in b.to_pylist()})
    for b in c.give():
        out.update({(r["lang"], r["source"], r["term"]): r["n"] for r in b.to_pylist()})
    assert out == Counter((lang or "", source or "", w) for t, lang, source in corpus for w in terms_of(t))


def test_shares_are_exact():
    for n, total in ((0, 7), (3, 7), (7, 7), (123_456_789_012, 900_000_000_000_007), (8_999_999_999_999_998, 8_999_999_999_999_999)):
        assert int(audit.shares(np.array([n]), np.array([total]), 1_000_000_000)[0]) == 1 + 1_000_000_000 * n // total


@pytest.mark.parametrize("name", ["op11_audit", "op13_trie"])
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want, got = con.sql(queries.ORACLE_SQL[name]), queries.QUERIES[name](spark, SF)
    k = sorted(range(len(want.columns)), key=lambda i: want.columns[i])
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(tuple(r[c] for c in sorted(got.columns)) for r in got.fillna(-1).collect()) == sorted(tuple(-1 if r[i] is None else r[i] for i in k) for r in want.fetchall())


def plain_trie(rows):
    by = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            by[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for *_, r, t in sorted(v)] for c, v in by.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(np.sign(c)) * (abs(c) % 100)
        built[c] = own.get(base, [])[:h] + own[c][h:]
    members = defaultdict(list)
    for c, x in built.items():
        for d in range(len(x) + 1):
            members[tuple(x[:d])].append(c)
    kids = defaultdict(list)
    for node in members:
        if node:
            kids[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[k] for k in kids[node]) if kids[node] else 1
        saved[node] = sum(saved[k] for k in kids[node]) + (len(members[node]) - 1) * (len(node[-1][1]) if node else 0)
    out = []
    for node, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(built[c]) == len(node))))
        out.append((min(m), len(node), min(members[node[:-1]]) if node else None, len(m), len(kids[node]), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def talks(seed=4):
    rng = np.random.default_rng(seed)
    rows = []
    for c in [*range(0, 60), *range(100, 140), 205, 731, -1, -150, 10**12, 10**12 + 7]:
        for turn in range(int(rng.integers(1, 9))):
            rows.append((int(c), turn, ["user", "assistant", None][turn % 3 if c % 11 == 0 else turn % 2], str(rng.choice(["hi", "", "é🙂", "go on", "x" * 70]))))
    rows += [(7, 3, "user", "hi"), (7, 3, "user", "again"), (7, 3, "assistant", None), (7, None, "user", "first"), (7, None, None, None), (None, 0, "user", "lost"), (700, 0, "user", "hi")]
    rows += [(800, k, "user", f"long{k}") for k in range(300)] + [(801, 0, "user", "one")]
    return rows + [(900 + k, 0, "user", "same") for k in range(40)] + rows[:3]


TALK = "conv_id long, turn long, role string, text string"


def tries(d):
    return sorted(map(repr, (tuple(r[c] for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")) for r in d.collect())))


def test_trie_by_plain_code(spark, monkeypatch):
    rows = talks()
    d = spark.createDataFrame(rows, TALK).repartition(5).withColumns({c: F.lit(1) for c in ("at", "tie", "path", "r", "n", "node", "lo")})
    want = sorted(map(repr, plain_trie(rows)))
    assert len(want) > 300 and tries(trie.trie(d)) == want
    # heavy parents apart, ids in many pieces
    monkeypatch.setattr(trie, "HEAVY", 10**6)
    monkeypatch.setattr(trie, "PIECE", 3)
    assert tries(trie.trie(d)) == want


def test_trie_without_rows_and_of_one_turn(spark):
    d = spark.createDataFrame([], TALK)
    assert trie.trie(d).count() == 0
    one = spark.createDataFrame([(5, None, None, None)], TALK)
    assert tries(trie.trie(one)) == sorted(map(repr, plain_trie([(5, None, None, None)])))


def surfaces(rng, n):
    words = ["river", "stone", "the", "of", "bread,", "window", "and", "garden.", "winter", "is"]
    rows = []
    for k in range(n):
        w = [str(x) for x in rng.choice(words, int(rng.integers(30, 120)))]
        if k % 5 == 0:
            w = [x.upper() + "!!" for x in w]
        elif k % 7 == 0:
            w = list(itertools.chain.from_iterable([x] * 12 for x in w[:8]))
        rows.append((k, " ".join(w), 0 if k % 5 == 0 or k % 7 == 0 else 1))
    return rows


def test_bradley_terry_finds_the_smallest_loss():
    rng = np.random.default_rng(1)
    good, bad = rng.normal(0.5, 1, (200, 3)), rng.normal(0, 1, (200, 3))
    w = quality.bradley_terry(good, bad)
    loss = lambda w: np.logaddexp(0, -(good - bad) @ w).mean() + quality.PULL / 2 * w @ w
    for step in np.concatenate([np.eye(3), -np.eye(3), rng.normal(size=(20, 3))]) * 1e-3:
        assert loss(w) <= loss(w + step) + 1e-12
    # apart without an error: the pull keeps weights finite
    assert np.isfinite(quality.bradley_terry(good + 100, bad)).all()


def test_pairs_have_every_row():
    for a, b in ((3, 2), (1, 50), (100, 7), (500, 400)):
        i, j = quality.pairs(a, b)
        assert {*i.tolist()} == {*range(a)} and {*j.tolist()} == {*range(b)} and len(i) == len(j) <= quality.PAIRS * max(a, b)
    assert quality.pairs(0, 5)[0].size == 0


def test_features_by_plain_code():
    texts = ["The cat sat. The cat sat.", "", None, "   \n ", "A A A b", "SHOUT!! NOW!!", "x | y | z", "é è", "w" * 40, "foo$$$ bar%%%"]
    x = quality.features(pa.array(texts))
    assert x.shape == (len(texts), quality.FEATURES) and np.isfinite(x).all()
    for k, t in enumerate(texts):
        w = re.split(r"[ \t\n\x0b\x0c\r]+", (t or "").strip(" \t\n\x0b\x0c\r")) if (t or "").strip() else []
        if not w:
            assert not x[k].any()
            continue
        assert x[k, 0] == pytest.approx(np.log1p(len(w))) and x[k, 1] == pytest.approx(np.log1p(len({*w})))
        assert x[k, 4] ** 2 == pytest.approx(sum(a == b for a, b in itertools.pairwise(w)) / len(w))
        assert x[k, 11] ** 2 == pytest.approx(w.count("|") / len(w)) and x[k, 12] ** 2 == pytest.approx(sum(len(v.encode()) > 24 for v in w) / len(w))
        assert x[k, 5] ** 2 == pytest.approx(sum(v.isascii() and v.upper() == v and sum(c.isupper() for c in v) > 1 for v in w) / len(w))
    # a text has the same features in any batch
    assert np.array_equal(quality.features(pa.array(texts[3:5])), x[3:5])


def test_quality_by_plain_code(spark):
    rows = surfaces(np.random.default_rng(6), 400)
    d = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    more = spark.createDataFrame([(1000, None), (1001, ""), (1002, LONG), (None, "the river"), (3, "THE!! THE!!")], "doc_id long, text string")
    labels = d.select("doc_id", "quality").union(spark.createDataFrame([(1, 0), (2, None), (None, 1), (5000, 1)], "doc_id long, quality int"))
    every = d.select("doc_id", "text").union(more).withColumns({c: F.lit(2) for c in ("id", "label", "score", "lot", "features")})
    got = quality.judge(every, labels).collect()
    assert len(got) == 405 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 0
    assert all(r.held_out == held(r.doc_id) for r in got)
    truth = {i: y for i, _, y in rows}
    late = [r for r in got if r.held_out and r.doc_id in truth and r.doc_id != 3]
    assert sum(r.predicted == truth[r.doc_id] for r in late) >= 0.97 * len(late) > 50
    # the same by plain code: labels of the other folds, the largest of an id's
    most = {}
    for r in labels.collect():
        if r.doc_id is not None and r.quality is not None and not held(r.doc_id):
            most[r.doc_id] = max(r.quality, most.get(r.doc_id, 0))
    texts = defaultdict(list)
    for r in every.collect():
        texts[r.doc_id].append(r.text)
    ids = sorted(i for i in most if i in texts)
    x = np.array([min(quality.features(pa.array(texts[i])).tolist()) for i in ids])
    model = quality.learn(x, np.array([most[i] for i in ids]), np.ones(len(ids)))
    want = {t: float(model.score(quality.features(pa.array([t])))[0]) for v in texts.values() for t in v}
    seen = {r.doc_id: r.score for r in got if len(texts[r.doc_id]) == 1}
    assert seen == pytest.approx({i: want[texts[i][0]] for i in seen}, abs=1e-6)


def test_quality_without_labels_or_rows(spark, docs, none):  # noqa: F811
    no = spark.createDataFrame([], "doc_id long, quality int")
    assert all(r.score == pytest.approx(0.3, abs=1e-6) for r in quality.judge(docs, no).collect())
    one = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, quality int")
    assert quality.judge(docs, one).count() == len(ROWS) and quality.judge(none, one).count() == 0


def test_signs_at_the_ends_of_words(spark):
    words = ["class", "ass", "badass", "stupid", "idiot", "stupit", "the", "glass", "last", "call", "all", "is"]
    rng = np.random.default_rng(4)
    d = spark.createDataFrame([(i, " ".join(rng.choice(words, 40))) for i in range(80)], "doc_id long, text string")
    channel = toxicity.Channel(toxicity.costs(toxicity.count_letters(d)))
    assert [channel.restore(w) for w in ("a$$", "cla$$", "bad@$$", "idi0+", "(lass", "glas$.", "(the)", "class!!", "the)", "cla$$!!")] == ["ass", "class", "badass", "idiot", "class", "glass", "the", "class", "the", "class"]


def test_number_signs_are_no_letters(spark):
    assert [langid.has_letter(t) for t in ("½ ²", "①", "Ⅷ", "", "12 %", "½ a", "é", "石", "_")] == [False] * 5 + [True, True, True, False]


def test_records_of_several_layouts_say_the_same(spark):
    rows = [(k, t, ["user", "assistant", "system", ""][t % 4], f"t{k}.{t} \"</s>\n") for k in range(60) for t in range(k % 5 + 1)] + [(60, 0, "human", "a"), (60, 1, "bot", None), (61, None, None, None), (61, 4, "gpt", "b")]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    records = chat.records_of_rows(d, "conv_id", "turn", "role", "text", mixed=True)
    got = chat.to_turns(records, "conv_id").collect()
    want = defaultdict(list)
    for c, t, role, text in sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        want[c].append((role or "", text or ""))
    assert {r.conv_id: [tuple(t) for t in r.turns] for r in got} == want
    assert len({r.fingerprint for r in got}) == 7


def test_chat_query_has_several_layouts(spark):
    seen = []
    was = chat.to_turns
    chat.to_turns = lambda records, *a: seen.append(records) or was(records, *a)
    try:
        queries.op3_chat_formatting(spark, SF).count()
    finally:
        chat.to_turns = was
    assert was(seen[0], "conv_id").select("fingerprint").distinct().count() > 3 and was(seen[0], "conv_id").where("turns is null").count() == 0


def test_quality_learns_from_every_label(spark):
    n = 50_000
    text = F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.col("doc_id") % 7 + 1), lambda k: F.concat(F.lit("w"), (F.col("doc_id") * k % 11).cast("string"))))
    d = spark.range(n).withColumnRenamed("id", "doc_id").withColumn("text", text)
    model = quality.fit(d, d.select("doc_id", (F.col("doc_id") % 7 > 2).cast("int").alias("quality")))
    x = np.concatenate([quality.features(pa.array([r.text])) * r["count"] for r in d.groupBy("text").count().collect()])
    assert model.mean == pytest.approx(x.sum(0) / n, abs=1e-8)


def test_quality_blocks_have_both_classes(spark, monkeypatch):
    monkeypatch.setattr(quality, "BLOCK", 16)
    monkeypatch.setattr(quality, "OTHERS", 4)
    for low, high in ((200, 3), (5, 170), (100, 90), (300, 30)):
        rows = [(i, int(i >= low), [float(i)] * quality.FEATURES) for i in range(low + high)]
        d = spark.createDataFrame(rows, "id long, label int, features array<double>")
        got = [[(x.label, x.id) for x in r.rows] for r in quality.blocks(d, {0: low, 1: high}).collect()]
        rare = int(high < low)
        common = [i for b in got for y, i in b if y != rare]
        assert sorted(common) == [i for i, y, _ in rows if y != rare] and all(len(b) == len({*b}) for b in got)
        assert {i for b in got for y, i in b if y == rare} == {i for i, y, _ in rows if y == rare}
        assert all(sum(y == rare for y, _ in b) >= min(3, low, high) and 0 < sum(y != rare for y, _ in b) <= 16 for b in got)


def test_quality_threshold_of_all_scores(spark):
    rng = np.random.default_rng(8)
    for raw in (rng.normal(size=5000), np.round(rng.normal(size=5000), 1), np.round(rng.normal(size=40)), np.array([0.5, 0.5, 0.5])):
        label = (raw + rng.normal(size=len(raw)) > 0.4).astype(int)
        label[:2] = 0, 1
        d = spark.createDataFrame(list(zip(raw.tolist(), label.tolist(), strict=True)), "raw double, label int")
        assert quality._cut(d) == pytest.approx(quality.threshold(raw, label, np.ones(len(raw))), abs=1e-12)


def test_quality_of_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(quality, "BLOCK", 32)
    rows = surfaces(np.random.default_rng(9), 600)
    d = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    got = {r.doc_id: r for r in quality.judge(d.select("doc_id", "text"), d.select("doc_id", "quality")).collect()}
    late = [i for i, r in got.items() if r.held_out]
    assert sum(got[i].predicted == rows[i][2] for i in late) >= 0.97 * len(late) > 80
    again = quality.judge(d.select("doc_id", "text").repartition(5), d.select("doc_id", "quality").repartition(2)).collect()
    assert {r.doc_id: r.score for r in again} == {i: r.score for i, r in got.items()}
