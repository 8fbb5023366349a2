"""Operators that SQL can't express against plain Python that does the same in the simplest way, and cases that once failed."""

import itertools
import json
import math
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_small_tables import LONG, MIX, ROWS, SCHEMA, brute_classes, brute_mix, low
from tramo.llm import chat, exact_dedup, langid, mixing, ngram_join, pivot_index, sharding, token_file, toxicity, units
from tramo.llm.queries import multilingual_bpe, op9_sharding


def words_of(rng, words, n):
    return " ".join(rng.choice(words, n))


@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(8)
    words = ["the", "of", "river", "stone", "bread", "window", "garden", "winter", "is", "on", "2024", "5417", "$100", "a"]
    disguises = ["idiot", "1d10t", "i d i o t", "idiooot", "loser", "l0$er", "@$$hat", "l o s e r"]
    rows = []
    for i in range(300):
        w = words_of(rng, words, 25).split()
        if i % 4 == 0:
            w[int(rng.integers(0, 25))] = disguises[i // 4 % len(disguises)]
        rows.append((i, " ".join(w), int(i % 4 == 0)))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int")


@pytest.fixture(scope="module")
def model(labelled):
    return toxicity.fit(labelled.drop("toxic"), labelled.select("doc_id", "toxic"))


def paths_of(channel, cells, i=0, a=0, b=0):
    """All readings of cells from i on, with their costs."""
    if i == len(cells):
        yield (channel.cost[a][b][0] if b else 0.0), ""
        return
    for stop, said, extra in channel._arcs(cells, i, cells[i]):
        x, y, total, out = a, b, extra, ""
        for s in said:
            code = 0 if s == " " else toxicity._CODE.get(s, toxicity.A - 1)
            if code or y:
                total += channel.cost[x][y][code]
                x, y = y, code
                out += s
        for rest, text in paths_of(channel, cells, stop, x, y):
            yield total + rest, out + text


def test_decoding_finds_the_cheapest_reading(model):
    channel, rng = toxicity.Channel(model.cost), np.random.default_rng(2)
    for _ in range(60):
        cells = [str(c) for c in rng.choice(["a", "s", "d", "1", "0", "@", "$", "!", ".", "", "s"], int(rng.integers(1, 6)))]
        best = min(paths_of(channel, cells))
        readings = {text.strip() for cost, text in paths_of(channel, cells) if cost < best[0] + 1e-4}
        assert channel.decode(cells) in readings


def plain_features(channel, text):
    found, run = set(), []
    for u in [*(text or "").split(), None]:
        if u is not None:
            found |= {*toxicity.features(channel.restore(u))}
        if u is not None and toxicity._is_single(u):
            run.append(u)
        else:
            if len(run) > 2:
                found |= {*toxicity.features(channel.restore_spaced(run))}
            run = []
    return found


def plain_score(model, text):
    e = sum(model.weight[f] for f in plain_features(toxicity.Channel(model.cost), text) if model.weight[f] >= toxicity.LEAST)
    return 1 / (1 + math.exp(-(model.slope * math.log1p(e) + model.shift)))


def test_toxicity_scores_and_weights(spark, labelled, model):
    channel = toxicity.Channel(model.cost)
    counts, n = np.zeros((2, toxicity.FEATURES)), [0, 0]
    for r in labelled.collect():
        n[r.toxic] += 1
        counts[r.toxic, list(plain_features(channel, r.text))] += 1
    weight = toxicity.log_odds(counts[1], counts[0], n[1], n[0])
    weight[weight < toxicity.LEAST] = 0
    assert np.allclose(weight, model.weight)
    more = spark.createDataFrame([(1000, None), (1001, ""), (1002, LONG), (1003, "a  $ $ x\n1 d 1 0 t"), (1004, "@$$hat!")], "doc_id long, text string")
    d = labelled.drop("toxic").union(more)
    for r in toxicity.score(d, model).collect():
        assert r.score == pytest.approx(plain_score(model, r.text), abs=1e-9)


def test_words_of_signs_only_reach_the_lattice(spark):
    rng = np.random.default_rng(4)
    d = spark.createDataFrame([(i, words_of(rng, ["ass", "salt", "ease", "the", "last"], 30)) for i in range(60)], "doc_id long, text string")
    channel = toxicity.Channel(toxicity.costs(toxicity.count_letters(d)))
    assert [channel.restore(w) for w in ("@$$", "@$$!", "5417", "455", "(@$$)")] == ["ass", "ass", "salt", "ass", "ass"]
    assert [channel.restore(w) for w in ("--", "12", "%", "", "1" * 17, "100%)")][:5] == [""] * 5


def test_keep_clean_with_clashing_names(spark, labelled):
    d = labelled.drop("toxic").withColumns({c: F.lit(7) for c in ("_toxic_score", "toxic_score", "score", "a b", "x`y")})
    got = toxicity.keep_clean(d, labelled.select("doc_id", "toxic"))
    assert got.columns == d.columns and 0 < got.count() < 300 and got.where("toxic_score <> 7").count() == 0


def test_language_by_plain_vectors(spark):
    rng = np.random.default_rng(6)
    sounds = {"xx": ["ka", "to", "mi", "ru", "no"], "yy": ["sch", "ung", "ein", "pf", "zu"]}
    rows = [(i, words_of(rng, sounds[k], int(rng.integers(1, 30))), k) for i in range(240) for k in [sorted(sounds)[i % 2]]]
    rows += [(900, "KA to 12 mi", "xx"), (901, "", "yy"), (902, None, None), (903, "№ 7", None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learn = [(t, k) for i, t, k in rows if zlib.crc32(str(i).encode()) % 4 != 2 and t is not None and k is not None]
    model = langid.fit(d.where("pmod(crc32(cast(cast(doc_id as string) as binary)), 4) <> 2"))
    df = np.zeros(langid.DIMS)
    for t, _ in learn:
        df[langid.grams([t])[0]] += 1
    idf = np.log((len(learn) + 1) / (df + 1)) + 0.1
    assert np.allclose(idf, model.idf) and sorted({*model.langs}) == ["xx", "yy"]

    def vector(text):
        at, n = langid.grams([text])
        v = dict(zip(at.tolist(), ((1 + np.log(n)) * idf[at]).tolist(), strict=True))
        size = math.sqrt(sum(x * x for x in v.values())) or 1.0
        return {k: x / size for k, x in v.items()}

    for r in langid.judge(d).collect():
        text = next(t for i, t, _ in rows if i == r.doc_id)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        if not any(c.isalpha() for c in text or ""):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        v = vector(text)
        cosine = [sum(x * float(c[k]) for k, x in v.items()) for c in model.centroids]
        assert r.score == pytest.approx(max(0.0, max(cosine)), abs=1e-5)
        assert r.lang_pred in {model.langs[k] for k, c in enumerate(cosine) if c > max(cosine) - 1e-5}


def shard_rows(spark, hot=0):
    rng = np.random.default_rng(9)
    rows = [(i, "hot text" if i < hot else "" if i % 9 == 0 else words_of(rng, ["a", "bb", "ccc"], int(rng.integers(1, 40)))) for i in range(3000)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string").repartition(4)


@pytest.mark.parametrize(("hot", "part"), [(0, 50_000), (1000, 50_000), (0, 7), (1000, 7)])
def test_sharding_by_plain_rules(spark, monkeypatch, hot, part):
    monkeypatch.setattr(sharding, "PART_ROWS", part)
    rows, d = shard_rows(spark, hot)
    got = sharding.shard(d, 8).collect()
    assert len(got) == len(rows)
    size, text, homes = [0] * 8, dict(rows), {}
    for r in got:
        b = text[r.doc_id].encode()
        assert (r["size"], r.text_crc32) == (len(b) + 1, zlib.crc32(b))
        size[r.shard] += r["size"]
        homes.setdefault(text[r.doc_id], set()).add(r.shard)
    for k in range(8):
        assert sorted(r.slot for r in got if r.shard == k) == list(range(sum(r.shard == k for r in got)))
    assert max(size) < 1.02 * min(size)
    # groups of equal texts that fit a shard stay together
    most = sum(size) / 8
    for t, where in homes.items():
        assert len(where) == 1 or sum(x == t for x in text.values()) * (len(t) + 1) > most


def test_splitters_are_quantiles(spark):
    _, d = shard_rows(spark)
    keyed = d.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("key"), (F.octet_length("text") + 1).cast("long").alias("size"))
    rows = [(r.key, r["size"]) for r in keyed.collect()]
    total = sum(s for _, s in rows)
    cuts, got = sharding.splitters(keyed, total, 20)
    assert cuts == sorted({*cuts}) and len(cuts) < 60
    want = {}
    for k, s in rows:
        want.setdefault(int(np.searchsorted(cuts, k, side="right")), []).append((k, s))
    assert got == {k: (sum(s for _, s in v), len(v), min(v)[0], max(v)[0]) for k, v in want.items()}
    largest = max(sum(s for k, s in rows if k == x) for x, _ in rows[:400])
    assert max(x[0] for x in got.values()) < max(sharding.OVERFULL * total / 20, 1.01 * max(largest, sum(s for k, s in rows if k == rows[0][0]))) + total / 9


def test_sharding_query(spark, tmp_path):
    _, d = shard_rows(spark, 30)
    d.write.parquet(f"{tmp_path}/documents.parquet")
    got = op9_sharding(spark, str(tmp_path))
    assert got.count() == 3000 and {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"} <= {*got.columns}
    assert [tuple(r) for r in got.select("law", "grown_shard").distinct().collect()] == [("bytes", None)]


def test_mixing_leaves_all_names_alone(spark):
    names = ["_full", "_rest", "_end", "_before", "_lang", "_bucket", "_key", "_room", "row", "l0", "id", "n", "key", "bucket", "taken", "a.b", "full"]
    d = spark.createDataFrame([r for r in ROWS if r[0] is not None], SCHEMA).withColumn("domain", F.lit("web")).withColumn("n_tokens", mixing.n_words(F.col("text"))).withColumns({c: F.lit(3) for c in names})
    got = mixing.select(d, mixing.Mixture(budget_permille=1500))
    assert got.columns == [*d.columns, "epoch", "take_tokens"]
    assert got.count() and all(r[c] == 3 for r in got.collect() for c in names)


PARTIAL = {"messages": [{"role": "user", "content": "q"}, {"role": "assistant"}]}
MIXED = {"messages": [{"role": "user", "text": "q", "turn": 1}, {"role": "assistant", "text": "a", "turn": "2"}]}
NESTED = {"data": {"messages": [{"role": "human", "content": "q"}, {"role": "gpt", "content": "a"}]}}
DEEP = {"turns": [{"author": {"role": "user"}, "content": {"text": "q"}}, {"author": {"role": "bot"}, "content": {"text": "a"}}]}
PAIR = {"example": {"prompt": "q", "response": "a"}}
DOTTED = {"data.messages": [{"role": "user", "content": "q"}]}


def test_layouts_that_only_some_items_have_give_no_turns(spark):
    said = [("user", "q"), ("assistant", "a")]
    cases = [(PARTIAL, None), (MIXED, None), (NESTED, said), (DEEP, said), (PAIR, said), (DOTTED, None), ({"messages": {"role": "user", "content": "q"}}, None), ([], None), (5, None)]
    d = spark.createDataFrame([(k, json.dumps(r)) for k, (r, _) in enumerate(cases)], "id long, record string")
    got = {r.id: r.turns and [tuple(t) for t in r.turns] for r in chat.to_turns(d, "id").collect()}
    assert got == {k: want for k, (_, want) in enumerate(cases)}
    assert chat.fingerprint(chat.paths(NESTED)) != chat.fingerprint(chat.paths(PARTIAL))


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80)])
def test_sketches_of_linked_sets_meet(k, percent):
    join, rng = ngram_join.Join(k, percent), np.random.default_rng(k)
    bands = join.bands()
    for n in [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 12, 15, 19, 25, 33, 47, 80, 200] * 6:
        a = rng.integers(0, 1 << 62, n).astype(np.uint64)
        for _ in range(4):
            cut, new = int(rng.integers(0, join.apart(2 * n) + 1)), int(rng.integers(0, join.apart(2 * n) + 1))
            b = np.concatenate([a[cut:], rng.integers(0, 1 << 62, new).astype(np.uint64)])
            if not len(b) or 100 * (n - cut) < percent * (n + new):
                continue
            x, y = (np.searchsorted(bands["low"], len(s), side="right") - 1 for s in (a, b))
            top = max(x, y)
            assert abs(int(x) - int(y)) < 2
            h, doc = np.concatenate([a, b]), np.repeat([0, 1], [len(a), len(b)])
            keys, many = ngram_join.sketch_keys(h, doc, np.full(2, top), bands)
            assert {*keys[: many[0]].tolist()} & {*keys[many[0] :].tolist()}


def test_small_sets_have_few_keys():
    rng = np.random.default_rng(0)
    for k, percent, n, most in ((3, 90, 10, 5), (5, 80, 30, 18), (5, 80, 100, 42)):
        bands = ngram_join.Join(k, percent).bands()
        h, doc = rng.integers(0, 1 << 62, 200 * n).astype(np.uint64), np.repeat(np.arange(200), n)
        _, many = ngram_join.sketch_keys(h, doc, np.full(200, np.searchsorted(bands["low"], n, side="right") - 1), bands)
        assert many.mean() <= most


def test_candidates_share_pivots_before_they_are_verified():
    row = {"label": 0, "pivot": 0, "cell": 0, "n": 1, "part": 0, "parts": 0}
    near = {1: [0, 5, 2], 2: [5, 0, 3], 3: [0, 7, 8], 4: [1, 0, 5]}
    rows = [row | {"node": k, "vec": [1.0, 0.001 * k], "near": v} for k, v in near.items()]

    def found(index, pivot=0):
        out = [r for b in pivot_index._compare(index)(iter([pa.RecordBatch.from_pylist([r | {"pivot": pivot} for r in rows if pivot in r["near"]])])) for r in b.to_pylist()]
        return {r["a"]: r["links"] for r in out if r["links"]}

    index = pivot_index.Index(prefix=3)
    assert found(index) == {1: 2, 2: 2, 4: 2}  # 3 shares one pivot with each of the others
    assert found(index, 5) == {}  # those pairs were counted in the list of pivot 0
    assert found(pivot_index.Index(prefix=3, shared=1)) == {1: 3, 2: 3, 3: 3, 4: 3}


def test_pivots_grow_with_the_vectors(spark):
    rng = np.random.default_rng(1)
    d = spark.createDataFrame([([float(x) for x in v],) for v in rng.normal(size=(600, 12))], "vec array<double>")
    index = pivot_index.Index(vectors_a_pivot=10, pivots=(8, 50), apart=2.0)
    assert [len(pivot_index.choose_pivots(d.limit(n), index)) for n in (5, 60, 300, 600)] == [5, 8, 30, 50]


def test_recall_of_the_index(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(120, 24)).repeat(12, axis=0) + rng.normal(size=(1440, 24)) * 0.07
    d = spark.createDataFrame([(i, [float(c) for c in v], int(i // 12 % 3)) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    unit, label = x / np.linalg.norm(x, axis=1, keepdims=True), np.arange(1440) // 12 % 3
    links = (unit @ unit.T >= 0.98) & (label[:, None] == label[None, :])
    got = sum(r.n_links for r in pivot_index.near_duplicates(d).collect())
    assert links.sum() - 1440 > 1000 and got >= 0.97 * (links.sum() - 1440) and got <= links.sum() - 1440


def narrow(rng, n: int, width: int, cosine: float) -> np.ndarray:
    """n pairs of near vectors (cosine 0.981 or more) in a cone: vectors of different pairs have about the given cosine."""
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    x = np.sqrt(cosine) * np.eye(width)[0] + np.sqrt(1 - cosine) * unit(rng.normal(size=(n, width)))
    off = rng.normal(size=(n, width))
    off = unit(off - (off * x).sum(axis=1, keepdims=True) * x)
    c = rng.uniform(0.981, 1, (n, 1))
    return np.vstack([x, c * x + np.sqrt(1 - c**2) * off])


@pytest.mark.parametrize("index", [pivot_index.Index(), pivot_index.Index(a_task=64)])
def test_vectors_in_a_narrow_cone(spark, index):
    x = narrow(np.random.default_rng(5), 800, 48, 0.87)
    d = spark.createDataFrame([(i, [float(c) for c in v], 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    pivots = pivot_index.choose_pivots(d.select(F.col("embedding").alias("vec")), index)
    # one rule of directions would leave two of them, and all vectors in every list
    assert 200 <= len(pivots) <= 256
    assert len(np.unique(pivots, axis=0)) == len(pivots)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = (unit @ unit.T >= 0.98).sum() - len(x)
    got = sum(r.n_links for r in pivot_index.near_duplicates(d, index).collect())
    assert 0.95 * links <= got <= links
    nearest = np.argsort(-(unit @ pivots.T), axis=1)[:, : index.prefix]
    assert np.bincount(nearest.ravel()).max() < len(x) // 4  # no list holds most vectors


def test_pivots_of_several_tasks_keep_apart(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(40, 16)).repeat(20, axis=0) + rng.normal(size=(800, 16)) * 0.05
    d = spark.createDataFrame([([float(c) for c in v],) for v in x], "vec array<double>")
    pivots = pivot_index.choose_pivots(d, pivot_index.Index(a_task=32))
    assert len(pivots) == len(pivot_index.choose_pivots(d, pivot_index.Index()))  # one for each direction, however many tasks chose
    assert np.triu(pivots @ pivots.T, 1).max() < 0.85


def test_memo_keeps_its_bounds():
    memo = units.Memo(lambda keys: units.lists([[len(k), len(k)] for k in keys]), most=50, left=10)
    for turn in range(40):
        keys = [f"often{k}" for k in range(8)] + [f"{turn}-{k}" for k in range(20)]
        at = memo.find(keys)
        ids, n = units.gather(at, memo.ids, memo.start, memo.n)
        assert ids.tolist() == [len(k) for k in keys for _ in (0, 1)] and n.tolist() == [2] * len(keys)
        memo.trim()
        assert len(memo.at) <= 50 and len(memo.ids) == int(memo.n.sum())
    assert all(f"often{k}" in memo.at for k in range(8))
    memo.trim(True)
    assert len(memo.at) <= 10


def test_pieces_hold_all_rows_in_order():
    texts = [None if k % 7 == 0 else "x" * (k * 37 % 400) for k in range(500)] + ["y" * 5000, "", "z"]
    table = pa.table({"id": range(len(texts)), "text": texts})
    for most, rows in ((1, 3), (1000, 20_000), (10**9, 20_000), (700, 2)):
        got = list(units.pieces(iter(table.to_batches(max_chunksize=33)), "text", most, rows))
        assert [x for b in got for x in b.column("id").to_pylist()] == list(range(len(texts)))
        assert all(b.num_rows <= rows and (b.num_rows == 1 or sum(len(t or "") for t in b.column("text").to_pylist()[:-1]) <= most) for b in got)
    assert list(units.pieces(iter([]))) == []


def test_a_file_written_again_replaces_the_first(spark, tmp_path):
    import public_tokenizers as P

    d = spark.createDataFrame([(1, "one two"), (2, "three")], "doc_id long, text string")
    for _ in range(2):
        got = token_file.encode_to_files(spark, d, P.path("byte_bpe_50k.json"), folder=f"file://{tmp_path}/tokens").collect()
    assert [r.doc_id for r in sorted(got, key=lambda r: r.start)] == [1, 2]
    assert not list(tmp_path.glob("tokens/*.tmp"))


def test_equal_texts_with_a_few_counters(spark):
    rows = [(i, "T" * (i % 40)) for i in range(2000)] + [(None, None), (None, "t"), (3000, "")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    want = {}
    for i, t in rows:
        want.setdefault(low(t), []).append(i)
    for counters in (8, 4096):
        for r in exact_dedup.decide(d, counters=counters).collect():
            ids = want[next(low(t) for i, t in rows if i == r.doc_id)] if r.doc_id is not None else None
            if ids:
                assert (r.keep_id, r.group_size) == (max(i for i in ids if i is not None), len(ids))


def test_pipeline_by_plain_rules(spark, tmp_path):
    """Each stage, on what its predecessor kept, keeps exactly what plain Python does."""
    rng = np.random.default_rng(12)
    words = [f"w{k}" for k in range(300)]
    rows = []
    for i in range(90):
        w = words_of(rng, words, int(rng.integers(1, 60))).split()
        if i % 6 == 0:
            w.insert(0, ["idiot", "1d10t", "i d i o t"][i // 6 % 3])
        rows.append((i, " ".join(w), ["en", "de", None][i % 3], f"src{i % 4 * 6}"))
    for i in range(90, 130):
        j = int(rng.integers(0, 90))
        w = rows[j][1].split(" ")
        if i % 2:
            w[-1:] = ["edited"]
        rows.append((i, " ".join(w).upper() if i % 4 == 0 else " ".join(w), rows[j][2], rows[j][3]))
    rows += [(200, None, "en", "src0"), (201, "", "en", "src0"), (202, LONG, "de", "src13")]
    d = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], SCHEMA + ", n_chars long").repartition(3)
    d.write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, int("idiot" in (t or "").lower() or "1d10t" in (t or "").lower() or "i d i o t" in (t or "").lower())) for i, t, *_ in rows]
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for name, step in corpus_pipeline.STAGES:
        step(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{len(seen)}")
        docs = spark.read.parquet(f"{tmp_path}/{len(seen)}")
        seen.append({r.doc_id: r for r in docs.collect()})
    model = toxicity.fit(d, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    clean = {i: t for i, t, *_ in rows if plain_score(model, t) < 0.5}
    assert {*seen[0]} == {*clean} and 0 < len(rows) - len(clean) < 60
    last = {}
    for i, t in clean.items():
        last[low(t)] = max(i, last.get(low(t), -1))
    once = {i: clean[i] for i in last.values()}
    assert {*seen[1]} == {*once} and len(once) < len(clean)
    classes = brute_classes([(i, t) for i, t in once.items()], 5, 80)
    apart = {i: t for i, t in once.items() if classes[i][1] == i}
    assert {*seen[2]} == {*apart} and len(apart) < len(once)
    n = {i: len((t or "").split()) for i, t in apart.items()}
    by = {r[0]: r for r in rows}
    leaf = lambda i: ("web" if int(by[i][3][3:]) <= 11 else "books" if int(by[i][3][3:]) <= 16 else "reference", by[i][2] or "", by[i][3])
    supply = {}
    for i in apart:
        if n[i]:
            supply[leaf(i)] = supply.get(leaf(i), 0) + n[i]
    mix = mixing.Mixture(weights=MIX.weights, budget_permille=MIX.budget_permille, max_epochs=1)
    want = brute_mix(supply, mix)
    took = {}
    for i, r in seen[3].items():
        k = len(r.text.split())
        assert r.text == apart[i] if k == n[i] else r.text == " ".join(apart[i].split()[:k])
        assert r.n_chars == len(r.text)
        took[leaf(i)] = took.get(leaf(i), 0) + k
    assert took == {k: v for k, v in want.items() if v}
    assert sum(len(r.text.split()) < n[i] for i, r in seen[3].items()) <= len(supply)
    encoder = multilingual_bpe()
    ids, size = encoder.encode([seen[3][i].text for i in sorted(seen[3])])
    ends = itertools.accumulate(size.tolist())
    for i, e, k in zip(sorted(seen[3]), ends, size.tolist(), strict=True):
        assert (seen[4][i].token_ids, seen[4][i].n_tokens) == (ids[e - k : e].tolist(), k)
    assert {*seen[4]} == {*seen[3]}
    again = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert again == seen[4]
