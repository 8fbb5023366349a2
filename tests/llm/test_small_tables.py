"""Every operator over nulls, empty and long texts, ties, repeated rows, empty tables and extra columns, against plain code."""

import base64
import hashlib
import json
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tramo.llm import bpe, chat, exact_dedup, langid, mixing, ngram_join, pivot_index, sharding, token_file, toxicity
from tramo.llm.queries import MIX, multilingual_bpe, with_domain
from tramo.llm.staging import new_folder

LONG = " ".join(f"w{k % 977}x{k}" for k in range(12_000))
NEAR = " ".join(f"common{k}" for k in range(60))
ROWS = [
    (1, "The cat sat on the mat", "en", "src0"), (2, "the CAT sat on the mat", "en", "src0"), (3, None, "en", "src1"), (4, "", None, "src1"), (5, LONG, "de", "src13"),
    (6, NEAR + " end", "en", "src0"), (7, NEAR + " other", "en", None), (8, "É é", "fr", "src2"), (9, "é é", "fr", "src2"), (10, " \n\t ", "de", "src0"),
    (11, "one two", "en", "src0"), (12, "ONE two", "en", "src18"), (13, NEAR + " end", "en", "src0"), (13, NEAR + " end", "en", "src0"), (None, "one two", "en", "src0"),
    (15, "x" * 5000, "es", "src19"), (16, "1 2 3 !!", "es", "src0"), (17, "a  b \n c <|endoftext|> \\ </s>", "en", "src0"),
]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def docs(spark):
    d = spark.createDataFrame(ROWS, SCHEMA).repartition(3).withColumn("n_chars", F.char_length("text").cast("long"))
    # names that the operators use inside
    return d.withColumns({c: F.lit(1) for c in ("id", "key", "digest", "size", "n", "label", "epoch", "bits", "shard", "score")})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA + ", n_chars long")


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def test_exact_dedup(docs, none):
    want = {}
    for i, t, *_ in ROWS:
        want.setdefault(low(t), []).append(i)
    got = exact_dedup.decide(docs).collect()
    assert len(got) == len(ROWS)
    by_id = {r.doc_id: r for r in got}
    for t, ids in want.items():
        top = max((i for i in ids if i is not None), default=None)
        for i in ids:
            r = by_id[i]
            assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (top, len(ids), i == top, hashlib.sha256(t.encode()).hexdigest())
    kept = [r.doc_id for r in exact_dedup.keep_one(docs).collect()]
    assert sorted(kept) == [2, 4, 5, 7, 8, 9, 10, 12, 13, 13, 15, 16, 17]
    assert exact_dedup.decide(none).count() == 0


def test_exact_dedup_with_few_counters_is_exact(spark):
    d = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("t"), F.col("id") % 700)).alias("text"))
    got = exact_dedup.decide(d, counters=64)
    assert got.where("kept").count() == d.select("text").distinct().count()
    assert got.where("group_size = 1000").count() == 1000


def brute_classes(rows, k, percent):
    sets = [(i, ngram_join.shingles(t, k)) for i, t, *_ in rows]
    low_of = {i: i for i, _ in sets}

    def find(i):
        while low_of[i] != i:
            i = low_of[i]
        return i

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if i is not None and j is not None and s and t and 100 * len(s & t) >= percent * len(s | t):
                p, q = find(i), find(j)
                low_of[max(p, q)] = min(p, q)
    return {i: (len(s), find(i)) for i, s in sets}


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80)])
def test_ngram_join(spark, docs, none, k, percent):
    rng = np.random.default_rng(1)
    more = []
    base = [f"v{x}" for x in rng.integers(0, 40, 120)]
    for i in range(100, 170):  # a group whose members link here and there
        w = list(base)
        for at in rng.integers(0, len(w), rng.integers(0, 5)):
            w[at] = "edit"
        more.append((i, " ".join(w[: 120 - int(rng.integers(0, 6))]), "en", "src0"))
    d = docs.select("doc_id", "text").union(spark.createDataFrame(more, SCHEMA).select("doc_id", "text"))
    got = ngram_join.classes(d, ngram_join.Join(k, percent)).collect()
    want = brute_classes(ROWS + more, k, percent)
    assert len(got) == len(ROWS) + len(more)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert ngram_join.classes(none, ngram_join.Join(k, percent)).count() == 0


@pytest.mark.parametrize("pairs", [0, 4])
def test_blocks_of_a_sketch_lose_no_pair(spark, docs, monkeypatch, pairs):
    """Many small blocks, keys that are frequent already with a few rows, and (0) no block whose pairs are all taken at once."""
    for name, value in (("BLOCK", 3), ("COUNTERS", 32), ("PAIRS", pairs)):
        monkeypatch.setattr(ngram_join, name, value)
    test_ngram_join(spark, docs, docs.limit(0), 3, 90)


def test_hamming_is_a_lower_bound():
    join = ngram_join.Join(3, 80)
    bands = join.bands()
    rng = np.random.default_rng(3)
    for _ in range(50):
        a = rng.integers(0, 1 << 62, 80).astype(np.uint64)
        b = np.concatenate([a[:70], rng.integers(0, 1 << 62, 12).astype(np.uint64)])
        h, doc = np.concatenate([a, b]), np.repeat([0, 1], [len(a), len(b)])
        band = np.full(2, np.searchsorted(bands["low"], 82, side="right") - 1)
        x, y = ngram_join.bit_sketches(h, doc, band, bands)
        assert (int.from_bytes(x) ^ int.from_bytes(y)).bit_count() <= 22


def brute_mix(leaves, mix):
    """leaves: {(domain, lang, source): supply}. The same rule, recursively."""

    def share(budget, nodes):
        got, left = {}, {k: v for k, v in nodes.items() if v[0] > 0}
        budget = min(budget, sum(c for _, c in left.values()))
        while True:
            total = sum(w for w, _ in left.values())
            over = [k for k, (w, c) in left.items() if c * total <= budget * w]
            if not over:
                break
            k = min(over, key=lambda k: (left[k][1] / left[k][0], k))
            got[k] = left.pop(k)[1]
            budget -= got[k]
        parts = {k: (budget * w // total, budget * w % total) for k, (w, _) in left.items()}
        spare = budget - sum(p for p, _ in parts.values())
        for n, k in enumerate(sorted(parts, key=lambda k: (-parts[k][1], k))):
            got[k] = parts[k][0] + (n < spare)
        return got

    def weight(level, name):
        return mix.weights[level].get(name, mix.defaults[level])

    def down(budget, level, inside):
        names = {}
        for leaf, supply in inside.items():
            names.setdefault(leaf[level], {})[leaf] = supply
        caps = {n: (weight(level, n), sum(s * mix.max_epochs for s in v.values())) for n, v in names.items()}
        out = {}
        for n, b in share(budget, caps).items():
            out |= {next(iter(names[n])): b} if level == 2 else down(b, level + 1, names[n])
        return out

    return down(sum(leaves.values()) * mix.budget_permille // 1000, 0, leaves)


def test_mixing(docs, none):
    d = with_domain(docs).withColumn("n_tokens", mixing.n_words(F.col("text")))
    for mix in (MIX, mixing.Mixture(weights=MIX.weights, max_epochs=1), mixing.Mixture(weights=({"web": 1}, {"en": 3, "fr": 0}, {}), budget_permille=2500, bucket_rows=1)):
        rows = [r for r in d.select("doc_id", "domain", F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), "n_tokens").collect() if r.n_tokens]
        leaves = {}
        for r in rows:
            leaves[r.domain, r.lang, r.source] = leaves.get((r.domain, r.lang, r.source), 0) + r.n_tokens
        # a subtree without weight can't give
        open_ = {k: v for k, v in leaves.items() if all(mix.weights[i].get(k[i], mix.defaults[i]) for i in range(3))}
        want = brute_mix(open_, mix) if open_ == leaves else None
        got = {}
        for r in mixing.select(d, mix).collect():
            assert 0 < r.take_tokens <= r.n_tokens and r.epoch < mix.max_epochs
            k = (r.domain, r.lang or "", r.source or "")
            got[k] = got.get(k, 0) + r.take_tokens
        if want is not None:
            assert got == {k: v for k, v in want.items() if v}
        assert all(k in open_ for k in got)
    assert mixing.select(with_domain(none).withColumn("n_tokens", mixing.n_words(F.col("text"))), MIX).count() == 0


def test_sharding(docs, none, spark):
    got = sharding.shard(docs, 8).collect()
    assert len(got) == len(ROWS)
    for k in range(8):
        slots = sorted(r.slot for r in got if r.shard == k)
        assert slots == list(range(len(slots)))
    text = {i: t for i, t, *_ in ROWS}
    for r in got:
        b = (text[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32) == (len(b) + 1, zlib.crc32(b))
    assert sharding.shard(none).count() == 0
    d = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.repeat(F.lit("h"), F.lit(50))).otherwise(F.repeat(F.col("id").cast("string"), (F.col("id") % 20).cast("int"))).alias("text"))
    sizes = [r[1] for r in sharding.shard(d, 8).groupBy("shard").agg(F.sum("size")).collect()]
    assert len(sizes) == 8 and max(sizes) < 1.02 * min(sizes)


def test_token_files(spark, docs, none):
    path = P.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    rows = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0))
    for bits in (False, True):
        manifest = token_file.write(docs, path, new_folder(spark, "tokens"), 0, bits)
        got = sorted(token_file.read_index(manifest).collect(), key=lambda r: r.start)
        at = 0
        for (i, t, *_), r in zip(rows, got, strict=True):
            ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
            assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
            at += len(ids)
    assert {r.doc_id: r.ids for r in token_file.tokens(manifest).collect()}[11] == [*tok.encode("one two", add_special_tokens=False).ids, 0]
    assert token_file.encode_to_files(spark, none, path).count() == 0


@pytest.mark.parametrize("n", [0, 1, 7, 8, 1000])
def test_planes_round_trip(n):
    ids = np.random.default_rng(n).integers(0, 1 << 32, n, dtype=np.uint32)
    for bits in (False, True):
        assert (token_file.from_planes(token_file.to_planes(ids, bits), n) == ids).all()


def test_bpe(docs, none):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    own = multilingual_bpe()
    assert own.hash.find(own.vocabulary).tolist() == list(range(len(own.vocabulary))) and own.hash.find([b"not a token \xff"]).tolist() == [-1]
    assert sorted(own.hash.value_at.tolist()) == list(range(len(own.vocabulary)))
    text = {i: t or "" for i, t, *_ in ROWS}
    for r in bpe.round_trip(docs, own).collect():
        ids = enc.encode_ordinary(text[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text[r.doc_id].encode()).hexdigest())
    for r in bpe.encode(docs, own).collect():
        assert r.token_ids == enc.encode_ordinary(text[r.doc_id])
    assert bpe.round_trip(none, own).count() == 0
    odd = ["  a  b ", "\n\n x\n y \n", "x\x1c y\x1d z", "don't I'LL we'd", "é̀ x\r\n\r\n  z", " \t a", "日本語 テキスト　全角 ", "🎉 🎉🎉 x", "\x85 a \x85b", "aaaaaaaaaaaaaaaaaaaaaaaaa " * 20]
    ids, n = own.encode(odd)
    ends = np.cumsum(n)
    assert [ids[e - k : e].tolist() for e, k in zip(ends, n, strict=True)] == [enc.encode_ordinary(t) for t in odd]


def test_chat(spark):
    texts = ["</s>[INST] ok [/INST]", "", None, "a\\b \\. <|text|><|end|>\n<|turn|>x", "<|<||>|>", "$1 \\$ \\\\.", "\n \U0001f389", "<<SYS>><</SYS>>" * 50]
    rows = [(k // 3, k % 3, ("user", "assistant", None)[k % 3], t) for k, t in enumerate(texts * 2)] + [(None, 0, "user", "x"), (90, None, "user", "b"), (90, 1, "assistant", "c"), (90, 1, "assistant", "c")]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("record", F.lit(1))
    want = {}
    for c, n, r, t in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or 0)):
        want.setdefault(c, []).append((r or "", t or ""))
    formatted = chat.format_chats(chat.to_turns(chat.records_of_rows(d, "conv_id", "turn", "role", "text"), "conv_id"), "conv_id").cache()
    for r in chat.digest(formatted, "conv_id").collect():
        turns = want[r.conv_id]
        loss = "".join(t for role, t in turns if role == "assistant")
        assert r.n_turns == len(turns) and r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    for r in formatted.collect():
        body = r.formatted.replace(chat.OPEN, "").replace(chat.BODY, "").replace(chat.CLOSE, "")
        assert not any(c in body for c in chat.CONTROL)
    assert chat.records_of_rows(d.limit(0), "conv_id", "turn", "role", "text").count() == 0


def test_chat_layouts(spark):
    said = [("user", "q"), ("assistant", "a")]
    records = [
        ({"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}, said),
        ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}, said),
        ({"system": "s", "conversations": [{"from": "human", "value": "q"}]}, [("system", "s"), ("user", "q")]),
        ({"prompt": "q", "completion": "a"}, said),
        ({"instruction": "q", "output": "a"}, said),
        ({"instruction": "q", "input": "i", "output": "a"}, [("user", "q\n\ni"), ("assistant", "a")]),
        ({"system": "s", "prompt": "q", "response": "a"}, [("system", "s"), *said]),
        ({"unknown": 1}, None), ([], None), (3, None),
    ]
    d = spark.createDataFrame([(k, json.dumps(r)) for k, (r, _) in enumerate(records)] + [(98, "{"), (99, None)], "id long, record string")
    got = {r.id: r for r in chat.to_turns(d, "id").collect()}
    for k, (_, turns) in enumerate(records):
        assert (None if got[k].turns is None else [tuple(t) for t in got[k].turns]) == turns
    assert got[98].turns is None and got[99].fingerprint is None
    assert got[3].fingerprint != got[4].fingerprint


@pytest.fixture(scope="module")
def talk(spark):
    rng = np.random.default_rng(5)
    words = ["the", "of", "and", "river", "stone", "bread", "window", "garden", "winter", "paper", "letter", "summer", "is", "on", "in"]
    rows = []
    for i in range(400):
        w = [words[k] for k in rng.integers(0, len(words), 30)]
        bad = i % 4 == 0
        if bad:
            w[int(rng.integers(0, 30))] = "idiot" if i % 8 else "loser"
        rows.append((i, " ".join(w), int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int")


def test_toxicity(spark, talk, docs, none):
    labels = talk.select("doc_id", "toxic").union(spark.createDataFrame([(None, 1), (3, None), (0, 1)], "doc_id long, toxic int"))
    got = toxicity.judge(talk.drop("toxic"), labels).join(talk, "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert {r.held_out for r in got if zlib.crc32(str(r.doc_id).encode()) % 5 == 0} == {True} and len(got) == 400
    assert np.mean([r.predicted == r.toxic for r in held]) > 0.95
    model = toxicity.fit(talk, labels)
    channel = toxicity.Channel(model.cost)
    assert [channel.restore(w) for w in ("1d10t", "idiooot", "l0ser!!", "i.d.i.o.t", "window", "2024")] == ["idiot", "idiot", "loser", "idiot", "window", ""]
    assert channel.restore_spaced("i d i o t".split()) == "idiot"
    odd = spark.createDataFrame([(1, "the river of 1d10t stone"), (2, "winter i d i o t bread"), (3, None), (4, ""), (5, "the garden is winter"), (6, LONG)], "doc_id long, text string").withColumn("label", F.lit(9))
    score = {r.doc_id: r.score for r in toxicity.score(odd, model).collect()}
    assert min(score[1], score[2]) >= 0.5 > max(score[3], score[4], score[5], score[6])
    assert toxicity.judge(none, labels).count() == 0
    assert {r.predicted for r in toxicity.judge(docs, labels.limit(0)).collect()} == {0}


def test_language(spark, docs, none):
    rng = np.random.default_rng(2)
    sounds = {"xx": ["ka", "to", "mi", "ru"], "yy": ["sch", "ung", "ein", "pf"], "zz": ["éa", "oui", "eau", "ç"]}
    rows = []
    for i in range(300):
        lang = sorted(sounds)[i % 3]
        rows.append((i, " ".join("".join(rng.choice(sounds[lang], 3)) for _ in range(20)), lang))
    d = spark.createDataFrame([*rows, (900, None, "xx"), (901, "123 !!", "yy"), (902, "", None)], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.judge(d).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang in rows)
    assert [(got[i].lang_pred, got[i].score) for i in (900, 901, 902)] == [("und", 0.0)] * 3
    assert all(0 <= r.score <= 1 for r in got.values())
    assert {i for i, r in got.items() if r.held_out} == {i for i in got if zlib.crc32(str(i).encode()) % 4 == 2}
    assert langid.judge(none).count() == 0 and langid.judge(docs).count() == len(ROWS)


@pytest.mark.parametrize("index", [pivot_index.Index(), pivot_index.Index(block=8), pivot_index.Index(pivots=(1, 1))])
def test_pivots(spark, index):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 16))
    near = np.concatenate([x[:3].repeat(25, axis=0) + rng.normal(size=(75, 16)) * 0.05, x])
    rows = [(i, [float(v) for v in row], int(i % 2)) for i, row in enumerate(near)]
    rows += [(500, rows[0][1], 0), (501, rows[0][1], None), (502, None, 0), (503, [0.0] * 16, 0), (504, [float("nan")] * 16, 0), (505, [None] + [1.0] * 15, 0), (506, [float("inf")] * 16, 1), (507, [], 0), (500, rows[0][1], 0)]
    got = pivot_index.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("node", F.lit(0)), index).collect()
    assert len(got) == len(rows)
    good = [(i, np.array(v), k) for i, v, k in rows if k is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    unit = np.stack([v / np.linalg.norm(v) for _, v, _ in good])
    kind = np.array([k for *_, k in good])
    links = (unit @ unit.T >= 0.98) & (kind[:, None] == kind[None, :])
    reach = links.copy()
    for _ in range(8):
        reach = (reach.astype(int) @ reach.astype(int)) > 0
    ids = np.array([i for i, *_ in good])
    want = {i: (int(links[k].sum()) - 1, int(ids[reach[k]].min())) for k, i in enumerate(ids.tolist())}
    for r in got:
        n, c = want.get(r.vec_id, (0, r.vec_id))
        assert (r.n_links, r.component_id, r.kept) == (n, c, r.vec_id == c)
    assert pivot_index.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_pipeline_stages(spark, docs, none, tmp_path):
    spark.createDataFrame([(1, 0), (11, 1)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for d in (docs, none):
        for name, step in corpus_pipeline.STAGES:
            out = step(spark, d, str(tmp_path))
            assert name == corpus_pipeline.STAGES[-1][0] or out.columns == d.columns
            rows = out.count()
            assert rows <= d.count()
            d = out
    assert d.columns == ["doc_id", "lang", "source", "token_ids", "n_tokens"]
