"""Each of the ten operators on small tables: defined results for odd rows, and brute force where SQL cannot state it."""

import base64
import hashlib
import json
import os
import re
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from footfall.llm import licenses, mixing, neardup, packing, quality, rules, secret_scan, sharding, topk, urls
from footfall.llm.queries import tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "word number " + " ".join(f"w{i}" for i in range(4000))


@pytest.fixture(scope="module")
def odd(spark):
    """Null and empty texts, a very long one, repeated rows, ids null and repeated, columns whose names clash with ours."""
    rows = [
        (1, None, "en", "a", None), (2, "", "en", "a", 0), (3, LONG, "en", "b", len(LONG)), (4, "one two", "fr", "b", 7), (4, "one two", "fr", "b", 7),
        (5, " \n\t ", "de", "b", 4), (None, "no id here at all now", "en", None, 3), (6, "Über straße ### token = 'abcdefgh1234'", None, "c", 9), (7, "one two", "en", "a", 7),
    ]
    df = spark.createDataFrame(rows, DOCS)
    for name in ("score", "rate", "p", "slot", "shard", "rep", "digest", "spans", "size", "term"):
        df = df.withColumn(name, F.lit("clash"))
    return df


def empty(odd):
    return odd.limit(0)


def test_topk_brute_force(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 6)).astype(float)
    x[100:220] = x[100]  # many ties
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(400, None), (401, [1.0, None] * 3), (402, [float("nan")] * 6), (None, [0.0] * 6), (7, x[7].tolist()), (450, [1.0, 2.0])]
    vectors = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("cell", F.lit("clash")))
    got = topk.search(vectors, vectors.where("vec_id % 50 = 0")).toPandas()
    q = np.floor(256 * x).astype(int)
    for i in range(0, 400, 50):
        s = q @ q[i]
        order = [j for j in np.lexsort((np.arange(400), -s)) if j != i][:5]
        mine = got[got["query_id"] == i].sort_values("rank")
        assert list(zip(mine["vec_id"], mine["score"])) == [(j, s[j]) for j in order]
    assert not (got["query_id"] == 450).any()
    assert topk.search(vectors.limit(0), vectors.limit(0)).count() == 0


def test_topk_large_components_and_repeated_rows(spark):
    """Finite vectors of any size take part, with exact scores; every row is a candidate, a repeated one twice."""
    rows = [(0, [3e5, 1.0]), (1, [2.5e5, -1.0]), (1, [2.5e5, -1.0]), (2, [2e8, 2.0]), (3, [0.0, 0.0]), (0, [3e5, 1.0])]
    vectors = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = topk.search(vectors, vectors.where("vec_id % 50 = 0")).orderBy("rank").toPandas()
    q = [[int(256 * x) for x in v] for _, v in rows]
    want = sorted(((-sum(a * b for a, b in zip(q[0], q[i])), rows[i][0]) for i in (1, 2, 3, 4)))
    assert list(zip(-got["score"], got["vec_id"])) == want and len(got) == 4
    with pytest.raises(Exception, match="64 bits"):
        big = topk.quantised(spark.createDataFrame([(0, [1e15]), (1, [1e15])], "vec_id long, embedding array<double>"))
        topk.search(big, big.where("vec_id % 50 = 0")).collect()


def test_topk_prunes_clustered_vectors():
    """Tight clusters: most products are never computed, and the results stay those of brute force. Levels halve."""
    rng = np.random.default_rng(6)
    centres = rng.normal(scale=400, size=(40, 8))
    y = np.floor(centres[rng.integers(0, 40, 4000)] + rng.normal(scale=10, size=(4000, 8)))
    met = []
    found = list(topk.dual_search(y[:400] + 0, np.arange(400), np.full(400, topk.NONE), y, np.arange(4000), 5, met))
    assert sum(met) < 0.25 * 400 * 4000
    score = (y[:400] @ y.T).astype(int)
    np.fill_diagonal(score, topk.NONE)
    assert sorted(s for p, _, s in found if p == 7) == sorted(np.sort(score[7])[-5:])
    tree = topk.CoverTree(y)
    for _, _, radius, _, children in tree.nodes:
        assert all(tree.nodes[c][2] <= radius / 2 for c in children)


def test_topk_prunes_nothing_it_needs():
    rng = np.random.default_rng(5)
    centres = rng.normal(scale=400, size=(6, 8))
    y = np.floor(centres[rng.integers(0, 6, 1500)] + rng.normal(scale=20, size=(1500, 8)))
    x = y[:80] + 0
    found = list(topk.dual_search(x, np.arange(80), np.full(80, topk.NONE), y, np.arange(1500), 5))
    for p in range(80):
        s = (y @ x[p]).astype(int)
        order = [j for j in np.lexsort((np.arange(1500), -s)) if j != p][:5]
        assert sorted((i, v) for q, i, v in found if q == p) == sorted((j, s[j]) for j in order)


def test_mixing_matches_targets_and_brute_force(spark, odd):
    words = {"en": "the of and to in", "fr": "le la de et un", "de": "der die und das ein"}
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(rng.choice(words[d].split(), rng.integers(20, 200))), d) for i, d in enumerate(rng.choice(["en", "fr", "de"], 300, p=[0.7, 0.2, 0.1]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, domain string")
    targets = {"en": 0.5, "fr": 0.2, "de": 0.3}
    mixture = mixing.fit(docs, docs, targets)
    assert mixture.miss < mixing.TOLERANCE and not mixture.unreachable
    got = mixing.rated(mixture).orderBy("doc_id").toPandas()
    p, tokens = np.stack(got["p"].to_list()), got["n_tokens"].to_numpy()
    total = (p * (got["rate"] * tokens).to_numpy()[:, None]).sum(0)
    assert np.allclose(total / total.sum(), list(targets.values()), atol=2e-3)
    assert (got["rate"] >= 0).all() and got["rate"].min() > 0.9
    # the same steps over all rows at once
    share = tokens / tokens.sum()
    want, w = p.T @ share, 1 / (p.T**2 @ share)
    goal = (want / np.array(list(targets.values()))).max() * np.array(list(targets.values()))
    rate = point = np.ones(len(p))
    t = 1.0
    for _ in mixture.steps.history:
        moved = np.clip(point - p @ (w * (p.T @ (share * point) - goal)) / 3 - mixing.RIDGE / 3 * (point - 1), 0, mixing.MOST)
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        point, rate, t = moved + (t - 1) / after * (moved - rate), moved, after
    assert np.allclose(rate, got["rate"], atol=1e-9)
    copies = mixing.repeated(docs, docs, targets)
    assert copies.columns == docs.columns and copies.count() == got["copies"].sum()
    labelled = odd.withColumn("domain", F.col("lang"))
    found = mixing.rated(mixing.fit(odd, labelled, targets)).toPandas()
    assert len(found) == 9 and (found.loc[found["n_tokens"] == 0, "rate"] == 1).all()
    clashing = odd.withColumn("copies", F.lit("mine")).withColumn("n_tokens", F.lit("mine")).withColumn("p_0", F.lit("mine"))
    again = mixing.repeated(clashing, labelled, targets, least=1.0)
    assert again.columns == clashing.columns and again.where("rate = 'clash' and p = 'clash' and copies = 'mine' and n_tokens = 'mine' and p_0 = 'mine'").count() == again.count() >= 9
    none = mixing.fit(empty(odd), labelled.limit(0), targets)
    assert mixing.rated(none).count() == 0 and none.unreachable == list(targets)


def test_mixing_without_a_domain(spark):
    """A domain that the corpus does not hold is left out, and said to be; the others are mixed as before."""
    words = {"en": "the of and to in", "fr": "le la de et un", "de": "der die und das ein"}
    rng = np.random.default_rng(1)
    draw = lambda i, d: (i, " ".join(rng.choice(words[d].split(), 300)), d)
    labelled = spark.createDataFrame([draw(i, d) for i, d in enumerate(["en", "fr", "de"] * 20)], "doc_id long, text string, domain string")
    docs = spark.createDataFrame([draw(i, d) for i, d in enumerate(["en"] * 60 + ["fr"] * 20)], "doc_id long, text string, domain string")
    mixture = mixing.fit(docs, labelled, {"en": 0.5, "fr": 0.25, "de": 0.25}, least=1.0)
    assert mixture.unreachable == ["de"] and mixture.miss < mixing.TOLERANCE
    got = mixing.rated(mixture).toPandas()
    by = (got["rate"] * got["n_tokens"]).groupby(got["p"].map(np.argmax)).sum()
    assert abs(by[0] / by.sum() - 2 / 3) < 1e-3 and got["rate"].between(1, mixing.MOST).all()
    only = mixing.fit(docs.where("domain = 'en'"), labelled, {"en": 0.5, "fr": 0.25, "de": 0.25}, least=1.0)
    assert only.unreachable == ["fr", "de"] and np.allclose(mixing.rated(only).toPandas()["rate"], 1)


def test_mixing_keeps_every_document(spark):
    """Domains that share words: copies of the scarce ones carry some of the largest, and still no document goes."""
    words = {"en": "the of and to in a b c d", "fr": "le la de et un a b c d", "de": "der die und das ein a b c d"}
    odds = np.array([0.01] * 5 + [0.95 / 4] * 4)
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(rng.choice(words[d].split(), rng.integers(5, 40), p=odds)), d) for i, d in enumerate(rng.choice(["en", "fr", "de"], 2000, p=[0.7, 0.2, 0.1]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, domain string")
    targets = {"en": 0.5, "fr": 0.2, "de": 0.3}
    loose = mixing.rated(mixing.fit(docs, docs, targets)).toPandas()
    assert loose["rate"].min() < 1 and (loose["copies"] == 0).any()
    mixture = mixing.fit(docs, docs, targets, least=1.0)
    got = mixing.rated(mixture).toPandas()
    assert got["rate"].min() >= 1 and got["copies"].min() >= 1
    total = (np.stack(got["p"].to_list()) * (got["rate"] * got["n_tokens"]).to_numpy()[:, None]).sum(0)
    assert np.allclose(total / total.sum(), list(targets.values()), atol=5e-3)
    assert set(mixing.repeated(docs, docs, targets, least=1.0).toPandas()["doc_id"]) == set(range(2000))


def test_sharding(spark, odd):
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.expr("repeat('x', cast(id % 97 as int))").alias("text"))
    sized = sharding.with_sizes(docs)
    sizes = sharding.slot_sizes(sized)
    plan = sharding.plan_map(sizes, 40).persist()
    placed = sharding.place(sized, plan).toPandas()
    assert len(placed) == 2000
    loads = placed.groupby("shard")["size"].sum()
    assert len(loads) == 40 and loads.max() - loads.min() <= placed["size"].max()
    for _, part in placed.groupby("shard"):
        assert sorted(part["position"]) == list(range(len(part)))
    # largest first onto the emptiest shard
    slots = sizes.toPandas().sort_values(["bytes", "vslot"], ascending=[False, True])
    want, load = {}, np.zeros(40, int)
    for v, b in zip(slots["vslot"], slots["bytes"]):
        want[v] = int(load.argmin())
        load[want[v]] += b
    assert {r["vslot"]: r["shard"] for r in plan.collect()} == want
    edited = sharding.rebalance(sizes, plan, 41).toPandas().set_index("vslot")["shard"]
    moved = [v for v in want if edited[v] != want[v]]
    assert 0 < len(moved) < len(want) / 10
    assert (edited == 40).any()
    got = sharding.place(sharding.with_sizes(odd), sharding.plan_map(sharding.slot_sizes(sharding.with_sizes(odd)), 3)).toPandas()
    assert len(got) == 9
    assert got[got["doc_id"] == 1][["size", "text_crc32"]].values.tolist() == [[16, 0]]
    assert set(got[got["doc_id"] == 6]["text_crc32"]) == {zlib.crc32("Über straße ### token = 'abcdefgh1234'".encode())}
    none = sharding.with_sizes(empty(odd))
    assert sharding.place(none, sharding.plan_map(sharding.slot_sizes(none), 3)).count() == 0


def test_versioned_map(spark, tmp_path):
    sizes = spark.createDataFrame([(i, 10 + i, 1) for i in range(20)], "vslot int, bytes long, n_rows long")
    first = sharding.save_map(sharding.plan_map(sizes, 2), f"file://{tmp_path}/map", 0)
    second = sharding.save_map(sharding.rebalance(sizes, first, 3), f"file://{tmp_path}/map", 1)
    assert first.where("shard = 2").count() == 0 < second.where("shard = 2").count()
    assert sharding.load_map(spark, f"file://{tmp_path}/map", 0).count() == 20


def test_quality_separates_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    judged = quality.judge(docs, labels)
    assert judged.columns == [*docs.columns, "score", "predicted"]
    held = judged.where(quality.held_out(F.col("doc_id"))).join(labels, "doc_id").toPandas()
    right = (held["predicted"] == held["quality"]).mean()
    assert right > 0.97, right
    trained = quality.labelled_texts(docs, labels).select("doc_id").toPandas()["doc_id"]
    assert all(zlib.crc32(str(d).encode()) % 5 != 0 for d in trained)


def test_quality_learns_as_plain_ftrl(spark):
    """The learner's weights against the update rule stated over single features in plain Python."""
    rng = np.random.default_rng(8)
    rows = [(i, " ".join(rng.choice(["a", "bb", "C", "12", "!!"], rng.integers(0, 9))), int(rng.integers(0, 2))) for i in range(60)]
    labelled = spark.createDataFrame(rows, "doc_id long, text string, label int")
    got = quality.train(labelled, max_rows=50, epochs=2)
    taken = sorted(rows, key=lambda r: (hashlib.md5(str(r[0]).encode()).hexdigest(), r[2]))[:50]
    z, n = {}, {}

    def weight(i):
        if abs(z.get(i, 0.0)) <= quality.L1:
            return 0.0
        return -(z[i] - np.sign(z[i]) * quality.L1) / ((quality.BETA + n.get(i, 0.0) ** 0.5) / quality.ALPHA + quality.L2)

    for _ in range(2):
        for _, text, label in taken:
            found = dict(zip(*quality.features(text, quality._Tokens())))
            w = {i: weight(i) for i in found}
            p = 1 / (1 + np.exp(-sum(w[i] * v for i, v in found.items())))
            for i, v in found.items():
                g = (p - label) * v
                z[i] = z.get(i, 0.0) + g - ((n.get(i, 0.0) + g * g) ** 0.5 - n.get(i, 0.0) ** 0.5) / quality.ALPHA * w[i]
                n[i] = n.get(i, 0.0) + g * g
    assert np.allclose(got, [weight(i) for i in range(quality.DIM)]) and np.count_nonzero(got) > 20
    docs = labelled.select("doc_id", "text")
    for r in quality.score(docs, got).collect():
        at, value = quality.features(r["text"], quality._Tokens())
        assert abs(r["score"] - 1 / (1 + np.exp(-got[at] @ value))) < 1e-12


def test_quality_features_of_text():
    """Features by hand: positions of hashed grams with square roots of relative counts, and the bias."""
    at, value = quality.features("a a", quality._Tokens())
    assert len(at) == len(value) and value[-1] == 1.0 and at[-1] == 0
    # unigram a twice, bigram once; shapes a and repeated-a, one shape bigram, no trigram
    assert sorted(np.round(value[:-1] ** 2 * 2).astype(int)) == [1, 1, 1, 1, 2]
    assert quality.features(None, quality._Tokens())[0].tolist() == quality.features("", quality._Tokens())[0].tolist() == [0]


def test_quality_odd_rows(spark, odd):
    labels = spark.createDataFrame([(3, 1), (4, 0), (4, 0), (99, None), (None, 1)], "doc_id long, quality int")
    got = quality.judge(odd, labels).toPandas()
    assert len(got) == 9 and got["score"].between(0, 1).all()
    kept = quality.accepted(odd, labels)
    assert kept.columns == odd.columns and kept.where("score = 'clash'").count() == kept.count() == (got["predicted"] == 1).sum()
    assert quality.judge(empty(odd), labels.limit(0)).count() == 0
    assert (quality.judge(odd, labels.limit(0)).toPandas()["score"] == 0.5).all()


def _em(rows):
    """Expectation-maximisation over single rows, in NumPy: the posterior of good texts, and the learned chances."""
    v = np.array(rows)
    n, k = v.shape
    prior = rules.prior_model(k)
    pi0, p0 = np.array(prior.shares), np.array(prior.chances)
    pi, p = pi0, p0
    for turn in range(rules.ROUNDS + 1):
        joint = np.stack([pi[c] * np.prod([p[c, j, v[:, j]] for j in range(k)], axis=0) for c in range(k + 1)])
        post = joint / joint.sum(axis=0)
        if turn == rules.ROUNDS:
            return post[0], p
        pi = (post.sum(axis=1) + rules.PRIOR_TEXTS * pi0) / (n + rules.PRIOR_TEXTS)
        counts = np.array([[np.bincount(v[:, j], post[c], 4) for j in range(k)] for c in range(k + 1)])
        p = (counts + rules.PRIOR_TEXTS * p0) / (post.sum(axis=1)[:, None, None] + rules.PRIOR_TEXTS)


def test_rules_weigh_votes(spark):
    """Not all must pass: some texts with a bad vote are kept, some without one go, and rules differ in what is learned."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    got = rules.judge(docs).toPandas()
    names = list(rules.RULES)
    post, chances = _em(got[names].values)
    assert np.allclose(got["posterior"], post, atol=1e-9)
    passed = (got[names] > rules.RATHER_BAD).all(axis=1)
    assert (got["kept"] & ~passed).any() and (~got["kept"] & ~got["base_failed"] & passed).any()
    assert len(set(np.round(chances[0, :, : rules.ABSTAIN].sum(axis=1), 4))) > 3
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").toPandas().set_index("doc_id")["quality"]
    judged = got[~got["base_failed"]].set_index("doc_id")["kept"].to_frame().join(labels, how="inner")
    assert (judged["kept"] == (judged["quality"] == 1)).mean() > 0.99


def test_rules_against_numpy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = rules.judge(docs).toPandas()
    names = list(rules.RULES)
    assert np.allclose(got["posterior"], _em(got[names].values)[0], atol=1e-9)
    texts = docs.toPandas().set_index("doc_id")["text"]
    for row in got.itertuples():
        text = texts[row.doc_id] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        hit = {i + d for i, g in enumerate(grams) if grams.count(g) > 1 for d in range(3)} if len(grams) < 600 else None
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (row.n_words, row.word_chars, row.n_dup_lines) == (len(w), sum(map(len, w)), len(lines) - len(set(lines)))
        assert hit is None or row.n_repeat_words == len(hit)
        assert row.n_symbols == sum(text.count(c) for c in rules.SYMBOLS)


def test_rules_odd_rows(odd):
    got = rules.judge(odd).toPandas()
    assert len(got) == 9 and got["base_failed"].sum() == 8 and not got.loc[got["base_failed"], "kept"].any()
    assert rules.judge(empty(odd)).count() == 0


def _classes(rows):
    """Brute-force classes of (doc_id, text) by full sets."""
    sets = {}
    for d, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
        sets[d] = {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: find(d) for d in sets}, {d: len(s) for d, s in sets.items()}


def test_neardup_brute_force(spark):
    rng = np.random.default_rng(4)
    base = [f"t{i}" for i in rng.integers(0, 5000, 120)]
    rows = []
    for d in range(150):  # a crowd of near copies, from almost equal to far apart
        w = list(base)
        for at in rng.integers(0, len(w), d // 12):
            w[at] = f"n{rng.integers(0, 10**6)}"
        rows.append((d, " ".join(w)))
    rows += [(200 + d, " ".join(base[:60] + [f"q{rng.integers(0, 10**6)}" for _ in range(60)])) for d in range(30)]
    rows += [(300, "a b"), (301, "A  B"), (302, "a b c"), (303, None), (304, ""), (305, rows[3][1].upper())]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("comp", F.lit("clash"))
    got = neardup.classes(docs).toPandas().set_index("doc_id")
    comps, sizes = _classes(rows)
    assert got["component_id"].to_dict() == comps
    assert got["n_shingles"].to_dict() == sizes
    assert (got["kept"] == (got.index == got["component_id"])).all()
    assert neardup.deduplicated(docs).count() == got["kept"].sum()


def test_neardup_odd_rows(odd):
    got = neardup.classes(odd).toPandas()
    assert len(got) == 9
    assert got[got["doc_id"].isna()][["kept"]].values.tolist() == [[True]]
    assert got[got["doc_id"] == 7]["component_id"].tolist() == [4]
    assert neardup.classes(empty(odd)).count() == 0


def test_neardup_guarantee():
    """Signatures within the distance share a key."""
    rng = np.random.default_rng(9)
    for _ in range(200):
        same = np.zeros(neardup.SYMBOLS, bool)
        same[rng.permutation(neardup.SYMBOLS)[: neardup.SYMBOLS - neardup.MAX_ERRORS]] = True
        assert (same.reshape(neardup.CHUNKS, neardup.CHUNK).sum(1) >= neardup.CHUNK - 1).any()


def _der(tag, body):
    n = len(body)
    return bytes([tag]) + (bytes([n]) if n < 128 else bytes([0x82]) + n.to_bytes(2, "big")) + body


def test_secret_structures():
    numbers = b"".join(_der(2, bytes([i + 1]) * 40) for i in range(8))
    key = _der(0x30, _der(2, b"\0") + numbers)
    assert secret_scan.der_key(key) and not secret_scan.der_key(key[:-1]) and not secret_scan.der_key(key + b"\0")
    text = f"see {base64.b64encode(key).decode()} end"
    assert [k for k, _, _ in secret_scan.confirmed_spans(text)] == ["der"]
    assert [k for k, _, _ in secret_scan.confirmed_spans(f"x {key.hex()} y")] == ["der"]
    assert secret_scan.confirmed_spans("x " + hashlib.sha512(b"a").hexdigest() + " " + base64.b64encode(bytes(range(200))).decode()) == []
    part = lambda x: base64.urlsafe_b64encode(json.dumps(x).encode()).decode().rstrip("=")
    token = f"{part({'alg': 'HS256'})}.{part({'sub': 1})}.c2ln"
    assert secret_scan.confirmed_spans(f"a {token} b") == [("jwt", 2, 2 + len(token))]
    assert secret_scan.confirmed_spans(f"{part({'typ': 1})}.{part({'sub': 1})}.c2ln") == []
    pem = f"-----BEGIN RSA PRIVATE KEY-----\n{base64.b64encode(key).decode()}\n-----END RSA PRIVATE KEY-----"
    assert secret_scan.confirmed_spans(pem) == [("pem", 0, len(pem))]
    assert secret_scan.redacted(f"a {token} b", secret_scan.confirmed_spans(f"a {token} b")) == "a [SECRET] b"


def test_secret_keys_after_an_equals_sign():
    numbers = b"".join(_der(2, bytes([i + 1]) * 40) for i in range(8))
    der = base64.b64encode(_der(0x30, _der(2, b"\0") + numbers)).decode()
    field = lambda x: len(x).to_bytes(4, "big") + x
    ssh = base64.b64encode(b"openssh-key-v1\0" + field(b"none") * 2 + field(b"") + b"\0\0\0\1" + field(b"k" * 40)).decode()
    for text, kind, at in ((f"PRIVATE_KEY={der} end", "der", 12), (f"SSL_KEY={der}", "der", 8), (f"http://a.io/?key={ssh}&x=1", "ssh", 17)):
        found = secret_scan.confirmed_spans(text)
        assert [(k, s) for k, s, _ in found] == [(kind, at)]
        assert der not in (clean := secret_scan.redacted(text, found)) and ssh not in clean


def _keys():
    """A PKCS#1 key, a PKCS#8 key, the latter encrypted, a SEC 1 key, all in DER, and an OpenSSH container."""
    rng = np.random.default_rng(11)
    octets = lambda n: rng.bytes(n)
    pkcs1 = _der(0x30, _der(2, b"\0") + b"".join(_der(2, b"\1" + octets(63)) for _ in range(8)))
    pkcs8 = _der(0x30, _der(2, b"\0") + _der(0x30, _der(6, bytes.fromhex("2a864886f70d010101")) + b"\5\0") + _der(4, pkcs1))
    locked = _der(0x30, _der(0x30, _der(6, bytes.fromhex("2a864886f70d01050d")) + _der(0x30, octets(40))) + _der(4, octets(640)))
    sec1 = _der(0x30, _der(2, b"\1") + _der(4, octets(32)) + _der(0xA0, _der(6, bytes.fromhex("2a8648ce3d030107"))) + _der(0xA1, _der(3, b"\0" + octets(65))))
    field = lambda x: len(x).to_bytes(4, "big") + x
    ssh = b"openssh-key-v1\0" + field(b"none") * 2 + field(b"") + b"\0\0\0\1" + field(octets(51)) + field(octets(160))
    return {"pkcs1": pkcs1, "pkcs8": pkcs8, "locked": locked, "sec1": sec1, "ssh": ssh}


def test_secret_key_forms():
    """Every key in every form that it is written in, put between other text: the span found is the one put there."""
    wrap = lambda x, n, end: end.join(x[i : i + n] for i in range(0, len(x), n))
    for name, key in _keys().items():
        b64 = base64.b64encode(key).decode()
        kind = "ssh" if name == "ssh" else "der"
        for form in (b64, wrap(b64, 64, "\n"), wrap(b64, 76, "\r\n"), wrap(b64, 64, "\\n"), wrap(b64, 64, "\n    ")):
            for before, after in (("PRIVATE_KEY=", " end"), ("key: ", "\n\nNext lines of words"), ('{"k": "', '"}'), ("see\n", ".")):
                assert secret_scan.confirmed_spans(before + form + after) == [(kind, len(before), len(before) + len(form))], (name, before)
        for end in ("\n", "\r\n", "\\n"):
            title = {"pkcs1": "RSA PRIVATE KEY", "locked": "ENCRYPTED PRIVATE KEY", "sec1": "EC PRIVATE KEY", "ssh": "OPENSSH PRIVATE KEY"}.get(name, "PRIVATE KEY")
            pem = f"-----BEGIN {title}-----{end}{wrap(b64, 64, end)}{end}-----END {title}-----{end}"
            text = '"private_key": "' + pem + '", "id": 1'
            assert secret_scan.confirmed_spans(text) == [("pem", 16, 16 + len(pem) - len(end))]
        assert secret_scan.confirmed_spans("x " + key.hex() + " y") == [(kind, 2, 2 + len(key.hex()))]
        # one byte less, or one changed length, is no key
        broken = base64.b64encode(key[:-1]).decode()
        assert secret_scan.confirmed_spans(f"x {broken} y") == [] or name == "ssh"
    # words on the line below a wrapped key do not hide it
    b64 = base64.b64encode(_keys()["pkcs8"]).decode()
    text = wrap(b64, 64, "\n") + "\nword"
    assert secret_scan.confirmed_spans(text)[0][:2] == ("der", 0)
    assert secret_scan.redacted(text, secret_scan.confirmed_spans(text)) == "[SECRET]\nword"


def test_secret_legacy_encrypted_and_clean_text():
    body = base64.b64encode(np.random.default_rng(1).bytes(608)).decode()
    pem = f"-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-256-CBC,0123456789ABCDEF0123456789ABCDEF\n\n{body}\n-----END RSA PRIVATE KEY-----"
    assert secret_scan.confirmed_spans(pem) == [("pem", 0, len(pem))]
    many = _der(0x30, _der(2, b"\0") + b"".join(_der(2, bytes([i % 100 + 1]) * 40) for i in range(30)))
    assert secret_scan.der_key(many)
    digest = _der(0x30, _der(0x30, _der(6, bytes.fromhex("608648016503040201")) + b"\5\0") + _der(4, bytes(32)))
    public = _der(0x30, _der(0x30, _der(6, bytes.fromhex("2a864886f70d010101")) + b"\5\0") + _der(3, b"\0" + bytes(200)))
    rng = np.random.default_rng(2)
    for data in (digest, public, *(rng.bytes(n) for n in range(60, 400, 7))):
        b64 = base64.b64encode(data).decode()
        assert secret_scan.confirmed_spans(f"a {b64} b\nM{b64}\n{b64}") == []


def test_secret_scan_brute_force(spark, odd):
    keyword = r"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    assign = re.compile(keyword + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = secret_scan.scan(docs).toPandas().set_index("doc_id")
    for d, text in docs.select("doc_id", "text").toPandas().itertuples(index=False):
        spans = [("assign", *m.span()) for m in assign.finditer(text) if len(m[1]) >= 6]
        spans += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
        spans += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
        spans.sort(key=lambda s: (s[1], ["assign", "access", "hex"].index(s[0])))
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert got.loc[d, "base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert set(joined.split(",")) <= set(got.loc[d, "spans"].split(",")) | {""}
    odd_rows = secret_scan.scan(odd).toPandas()
    assert len(odd_rows) == 9 and odd_rows[odd_rows["doc_id"] == 6]["n_assign"].tolist() == [1]
    clean = secret_scan.redact(odd)
    assert clean.columns == odd.columns and clean.where("doc_id = 6").first()["text"].endswith("### [SECRET]'")
    assert secret_scan.scan(empty(odd)).count() == 0


def _check_pieces(frame, texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    ids = {d: np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [1], "<u4") for d, t in texts}
    for d, part in frame.groupby("doc_id"):
        part = part.sort_values("start")
        assert part["start"].tolist() == [0, *part["length"].cumsum()[:-1]] and part["length"].sum() == len(ids[d])
    for r in frame.itertuples():
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) and r.doc_tokens == len(ids[r.doc_id])
    for _, part in frame.groupby("sequence_id"):
        part = part.sort_values("offset")
        assert part["offset"].tolist() == [0, *part["length"].cumsum()[:-1]] and part["length"].sum() <= packing.WINDOW


def test_packing_round_trip(spark, odd):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = packing.pack(docs, tokenizer_path(), 100_000, 300_000).toPandas()
    _check_pieces(got, docs.select("doc_id", "text").toPandas().itertuples(index=False))
    assert got["length"].sum() > 0.9 * packing.WINDOW * got["sequence_id"].nunique()
    plain = odd.where("doc_id is not null").dropDuplicates(["doc_id"])
    _check_pieces(packing.pack(plain, tokenizer_path()).toPandas(), plain.select("doc_id", "text").toPandas().itertuples(index=False))
    whole = packing.pack(odd, tokenizer_path()).toPandas()
    assert whole["length"].sum() == whole.drop_duplicates(["sequence_id", "offset"])["length"].sum()
    assert packing.pack(empty(odd), tokenizer_path()).count() == 0


@pytest.mark.parametrize("text", ["It's 3rd, isn't?!", "ÀÉÎ naïve Straße ẞ İstanbul K Å Σας ﬁ é", "<|endoftext|> a", "x_y __z__ 'll 're'd", "日本語 テスト　 mixed\x1ctext\x85a\x1f b\u2028c\u205fd\u180ee\x0bf\xa0g\u2007h", "'s'T ''m a'b .,;!a!! ª º µ ÿŸ", "퟿​﻿ zero width", ""])
def test_chunk_encoding_equals_tokenizer(text):
    chunks = packing._Chunks(tokenizer_path())
    texts = [text, "", text.lower(), text * 3, "plain words"]
    for _ in range(2):  # new chunks, then known ones
        got = [np.frombuffer(x, chunks.dtype).tolist() for x in chunks.texts(texts)]
        assert got == [chunks.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_random_texts_and_a_full_table(monkeypatch):
    """Random texts of many scripts, with a table that has to start anew again and again."""
    monkeypatch.setattr(packing, "CACHE", 500)
    rng = np.random.default_rng(12)
    letters = [*"abcXYZ019 \n\t.,'-_#", "é", "ß", "Ж", "中", "\u3000", "\x85", "e\u0301", "\u200b", "🙂", "ﬁ", "İ"]
    texts = ["".join(rng.choice(letters, rng.integers(0, 80))) for _ in range(3000)]
    chunks = packing._Chunks(tokenizer_path())
    for at in range(0, 3000, 150):
        part = texts[at : at + 150]
        assert [np.frombuffer(x, chunks.dtype).tolist() for x in chunks.texts(part)] == [e.ids for e in chunks.tokenizer.encode_batch(part, add_special_tokens=False)]


class _Counting:
    """A tokenizer that notes what it is given."""

    def __init__(self, tokenizer):
        self.tokenizer, self.given = tokenizer, []

    def encode_batch_fast(self, texts, **options):
        self.given += " ".join(texts).split()
        return self.tokenizer.encode_batch_fast(texts, **options)


def test_words_are_encoded_once_whatever_marks_follow():
    chunks = packing._Chunks(tokenizer_path())
    plain, chunks.tokenizer = chunks.tokenizer, _Counting(chunks.tokenizer)
    for text in ["Qualmstern zorbel,", "qualmstern, zorbel\nQualmstern.", "zorbel. ZORBEL, straße!", "Straße, qualmstern!", "zorbel"]:
        assert np.frombuffer(chunks.texts([text])[0], chunks.dtype).tolist() == plain.encode(text, add_special_tokens=False).ids
    assert sorted(chunks.tokenizer.given) == sorted(["qualmstern", "zorbel", "straße", ",", ".", "!"])


def test_a_text_of_more_chunks_than_the_table_holds(monkeypatch):
    """The table stays as small as it should within one text, and chunks that come again stay in a table that is full."""
    monkeypatch.setattr(packing, "CACHE", 1000)
    monkeypatch.setattr(packing, "ROUND", 100)
    rng = np.random.default_rng(14)
    new = lambda n: ["".join(rng.choice(list("abcdefghij"), 8)) + str(rng.choice(["", ",", "9"])) for _ in range(n)]
    text = " ".join(w for i in range(60) for w in [*new(90), *["again", "and", "again,"] * 3])
    chunks = packing._Chunks(tokenizer_path())
    assert np.frombuffer(chunks.texts([text])[0], chunks.dtype).tolist() == chunks.tokenizer.encode(text, add_special_tokens=False).ids
    assert len(set(text.split())) > 5000 and chunks.held <= 1000
    plain, chunks.tokenizer = chunks.tokenizer, _Counting(chunks.tokenizer)
    part = " ".join([*new(400), "and again, again"])
    assert np.frombuffer(chunks.texts([part])[0], chunks.dtype).tolist() == plain.encode(part, add_special_tokens=False).ids
    assert not {"again", "and"} & set(chunks.tokenizer.given)


def test_tokenizers_that_keep_white_space():
    for name in sorted(os.listdir(os.path.dirname(tokenizer_path()))):
        if name.endswith(".json") and name != os.path.basename(tokenizer_path()):
            try:
                chunks = packing._Chunks(tokenizer_path(name))
            except Exception:  # not a tokenizer of this library
                continue
            texts = ["Some text, of two words.\n Next  line", "", "x"]
            assert [np.frombuffer(x, chunks.dtype).tolist() for x in chunks.texts(texts)] == [chunks.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def _corpus(texts, frequency=1.0):
    """Ids of texts, the tokenizer's marks of word ends, and a corpus in which all classes are equally frequent."""
    chunks = packing._Chunks(tokenizer_path())
    ids = chunks.texts(texts)
    found = packing.terms(ids, chunks.ends, chunks.dtype)
    return ids, found, packing.Corpus(len(texts), len(found.doc) / len(texts), np.full(1 << packing.TERM_BITS, frequency)), chunks


def test_packing_prefers_neighbours():
    texts = ["alpha beta gamma", "one two three", "alpha beta delta", "four five six"]
    _, found, corpus, _ = _corpus(texts)
    assert packing.Index(found, 4, corpus).neighbours(0, np.array([False, True, True, True])).tolist() == [2]


def test_neighbours_come_best_first_without_sorting_all(monkeypatch):
    """The first run holds the best, with all ties of the last of them; the runs in a row are all neighbours in order."""
    rng = np.random.default_rng(15)
    words = ["".join(rng.choice(list("abcdefgh"), 6)) for _ in range(12)]
    texts = [" ".join(rng.choice(words, rng.integers(1, 6))) for _ in range(300)]
    _, found, corpus, _ = _corpus(texts, 20.0)
    runs = list(packing.Index(found, 300, corpus).ranked(0, np.arange(300) > 0))
    monkeypatch.setattr(packing, "BEST", 1000)
    (whole,) = packing.Index(found, 300, corpus).ranked(0, np.arange(300) > 0)
    assert len(runs) == 2 and 32 < len(runs[0]) < len(whole) and np.concatenate(runs).tolist() == whole.tolist()


def test_packing_takes_all_neighbours():
    """A window takes every document that shares a term, be it one of the least weighted, before any that does not."""
    own = " ".join(f"own{chr(97 + i)}" for i in range(12))
    texts = [own, *[f"longer unrelated text number{i}" for i in range(40)], *[f"own{chr(97 + i % 12)} near{i}" for i in range(40)]]
    texts = [re.sub(r"(\d+)", lambda m: "".join(chr(97 + int(c)) for c in m[1]), t) for t in texts]
    _, found, corpus, chunks = _corpus(texts)
    corpus.frequency[packing.terms(chunks.texts(["ownl"]), chunks.ends, chunks.dtype).term] = 60
    lengths = np.array([600, *[100] * 40, *[20] * 40])
    index = packing.Index(found, len(texts), corpus)
    assert sorted(index.neighbours(0, np.arange(81) > 0)) == list(range(41, 81))
    first = [doc for doc, _, _, sequence, _ in packing.plan(lengths, index) if sequence == 0]
    assert sorted(first[:41]) == [0, *range(41, 81)]


def test_packing_scores_are_bm25(spark):
    """Terms, frequencies and neighbours against BM25 over plain words."""
    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list("abcdefgh"), 6)) for _ in range(60)]
    texts = [" ".join(rng.choice(words, rng.integers(1, 30))) for _ in range(50)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    known = packing._Chunks(tokenizer_path())
    corpus = packing.corpus_statistics(packing.encoded(docs, tokenizer_path()), known.ends, known.dtype)
    split = [t.split() for t in texts]
    assert corpus.n_docs == 50 and abs(corpus.mean - sum(map(len, split)) / 50) < 1e-12 and corpus.frequency.sum() == sum(len(set(w)) for w in split)
    df = {w: sum(w in x for x in split) for w in words}

    def score(seed, other):
        total = 0.0
        for w in set(split[seed]) & set(split[other]):
            n = split[other].count(w)
            total += np.log(1 + (50 - df[w] + 0.5) / (df[w] + 0.5)) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(split[other]) / corpus.mean))
        return total

    index = packing.Index(packing.terms(known.texts(texts), known.ends, known.dtype), 50, corpus)
    for seed in range(50):
        want = {o: score(seed, o) for o in range(50) if o != seed}
        got = index.neighbours(seed, np.arange(50) != seed).tolist()
        assert set(got) == {o for o, v in want.items() if v > 0}
        assert all(want[a] >= want[b] - 1e-9 for a, b in zip(got, got[1:]))


def test_packing_deals_by_content(spark):
    """Related documents meet in one shard, though the corpus fills many, and a crowd of copies is spread over several tasks."""
    rng = np.random.default_rng(5)
    words = lambda k, n: " ".join(rng.choice([f"t{chr(97 + k % 26)}{chr(97 + k // 26)}{chr(97 + i)}" for i in range(5)], n))
    common = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(200)]
    rows = [(i, words(i % 60, 40) + " " + " ".join(rng.choice(common, 60))) for i in range(600)] + [(1000 + i, "copy of one text " * 30) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = packing._Chunks(tokenizer_path())
    ids = packing.encoded(docs, tokenizer_path())
    corpus = packing.corpus_statistics(ids, known.ends, known.dtype)
    got = packing.dealt(ids, corpus, known.ends, known.dtype, 8_000).select("doc_id", F.spark_partition_id().alias("task")).toPandas()
    assert sorted(got["doc_id"]) == sorted(d for d, _ in rows)
    assert got[got["doc_id"] >= 1000]["task"].nunique() > 2
    own = got[got["doc_id"] < 1000].assign(topic=lambda f: f["doc_id"] % 60)
    n_tasks = got["task"].max() + 1
    together = own.merge(own, on="topic")
    assert n_tasks > 8 and (together["task_x"] == together["task_y"]).mean() > 3 / n_tasks


def _canonical(text):
    """The normal form of a text once more, line by line in plain Python."""
    year = re.compile(r"\b(19|20)\d\d\b", re.ASCII)
    lines = []
    for line in text.lower().split("\n"):
        bare = re.sub(r"^[^\w(©&<\[]+", "", line)
        marked = any(m in bare for m in ("©", "&copy;", "(c)", "<year>", "[year]", "[yyyy]"))
        states = bare.startswith(("©", "&copy;", "copyright by ")) or re.match(r"copyright\b", bare) and (marked or year.search(bare)) or re.match(r"\(c\)[ \t]*(copyright\b|(19|20)\d\d\b)", bare)
        if states or re.fullmatch(r"all rights reserved[^\w]*", bare):
            line = " "
        for one, other in licenses.SPELLINGS:
            line = re.sub(rf"\b{re.escape(one)}\b", other, line, flags=re.ASCII)
        lines.append(" ".join(re.findall(r"[^\W_]+", line)))
    return lines


def test_licenses_against_plain_python(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    got = {r["doc_id"]: r for r in licenses.scan(docs, licenses.known_digests(spark)).collect()}
    known = {}
    for name, text in licenses.KNOWN:
        form = " ".join(" ".join(_canonical(text)).split())
        known[form] = min(name, known.get(form, name))
    seen = 0
    for doc_id, text in docs.collect():
        lines = _canonical(text)
        whole = " ".join(" ".join(lines).split())
        assert got[doc_id]["digest"] == hashlib.md5(whole.encode()).hexdigest() and got[doc_id]["license"] == known.get(whole)
        notices = sorted({known[x] for x in lines if x in known})
        assert set(notices) <= set(got[doc_id]["notices"])
        seen += bool(notices)
    assert seen > 20


def test_licenses(spark, odd):
    known = licenses.known_digests(spark)
    text = {name: t for name, t in licenses.KNOWN if len(t) > 400}
    notice = "This  work is LICENCED under the GNU General Public Licence, version 3!"
    mit = next(t for n, t in licenses.KNOWN if n == "MIT" and t.startswith("MIT License"))
    wrapped = mit.replace("<year> <copyright holders>", "2020 A. N. Other").replace("AUTHORS OR COPYRIGHT HOLDERS", "AUTHORS OR\nCOPYRIGHT HOLDERS")
    rows = [
        (1, notice, "GPL-3.0", ["GPL-3.0"]), (2, f"Some text.\n{notice}\nReleased under the MIT License.\nmore", None, ["GPL-3.0", "MIT"]),
        (3, "Copyright 2020 A. N. Other\n" + mit, "MIT", []), (4, None, None, []), (5, "", None, []), (5, "", None, []),
        # wrapped anew, so that a line starts with "copyright"; each line in a comment; with © and a reservation of rights
        (6, wrapped, "MIT", []), (7, "\n".join("# " + x for x in wrapped.split("\n")), "MIT", []), (8, "/*\n" + "\n".join(" * " + x for x in wrapped.split("\n")) + "\n */", "MIT", []),
        (9, "\u00a9 Some One\nAll rights reserved.\n\n" + text["BSD-3-Clause"].split("\n\n", 2)[2], "BSD-3-Clause", []),
        (10, "// SPDX-License-Identifier: GPL-2.0-or-later\nint main() {}", None, ["GPL-2.0-or-later"]),
        (11, "intro\n\n" + next(t for n, t in licenses.KNOWN if n == "MPL-2.0" and "Mozilla" in t).replace(" Mozilla", "\n# Mozilla") + "\n\nbody", None, ["MPL-2.0"]),
        (12, "この著作物は自由に使えます", None, []), (None, notice, "GPL-3.0", ["GPL-3.0"]), (1, "other text", None, []),
    ]
    got = licenses.scan(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").withColumn("raw", F.lit("clash")), known).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(((r["doc_id"], r["license"], list(r["notices"])) for r in got), key=key) == sorted(((r[0], r[2], r[3]) for r in rows), key=key)
    empty_digest = hashlib.md5(b"").hexdigest()
    assert [r["digest"] for r in got if r["doc_id"] == 12] != [empty_digest] and [r["digest"] for r in got if r["doc_id"] == 4] == [empty_digest]
    # any table of known texts, also without the words of the usual ones
    own = licenses.known_digests(spark, spark.createDataFrame([("X-1", "Take it and run (CC-BY)")], "license string, text string"))
    assert licenses.scan(spark.createDataFrame([(1, "a\ntake it, and run: cc by\nb")], "doc_id long, text string"), own).first()["notices"] == ["X-1"]
    assert licenses.scan(odd, known).count() == 9 and licenses.scan(empty(odd), known).count() == 0
    assert licenses.scan(odd, known.limit(0)).where("license is not null").count() == 0


def _page(url, links=()):
    return url, "".join(f'<a href="{u}">x</a>' for u in links) if links is not None else None


def test_urls(spark):
    pages = [
        _page("http://A.example.NET/en/x?y"), _page("https://b.net/"), _page("https://b.net"), _page("http://c.org/fr/1", ["http://good.io/p", "//good.io/q"]),
        _page("http://bad.io/1", ["https://b.net/spam", "/local"]), _page("http://good.io/"), _page("http://alone.io/", None), _page(None), _page("no scheme"), _page("http://x.example.com/de/#f"),
        _page("http://alone.io/", None),
    ]
    df = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(pages)], "page_id long, url string, html string").withColumn("host", F.lit("clash"))
    got = urls.judge(df).orderBy("page_id").collect()
    assert [r["host"] for r in got[:4]] == ["a.example.net", "b.net", "b.net", "c.org"]
    assert [r["rule"] for r in got] == ["example.net/en/", "net/", None, "org/fr/", None, None, None, None, None, "example.com/de/", None]
    assert [r["verdict"] for r in got] == ["allow", "block", "block", "allow", "block", "allow", "allow", "allow", "allow", "block", "allow"]
    assert (got[7]["host"], got[7]["path"], got[8]["host"]) == ("", "", "")
    assert urls.judge(df.limit(0)).count() == 0


def test_urls_far_from_seeds(spark):
    """A chain of twelve hosts that leads only to a blocked one: all of it is blocked."""
    pages = [_page(f"http://h{i}.io/", [f"http://h{i + 1}.io/"]) for i in range(11)] + [_page("http://h11.io/", ["http://bad.net/"]), _page("http://bad.net/"), _page("http://c.org/fr/1")]
    got = urls.judge(spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(pages)], "page_id long, url string, html string")).orderBy("page_id").collect()
    assert [r["verdict"] for r in got] == ["block"] * 13 + ["allow"]
    assert np.allclose([r["distrust"] for r in got[:13]], [0.15 * 0.85 ** (12 - i) for i in range(13)], atol=1e-4)


def test_pagerank_against_numpy(spark):
    rng = np.random.default_rng(3)
    a = np.triu(rng.random((8, 8)) < 0.4, 1).astype(float) * rng.integers(1, 4, (8, 8))
    edges = spark.createDataFrame([(f"h{i}", f"h{j}", float(a[i, j])) for i, j in zip(*np.nonzero(a))], "src string, dst string, w double")
    seeds = spark.createDataFrame([("h0", 2.0), ("h1", 1.0)], "host string, mass double")
    kind = F.lit("k").alias("kind")
    walks = urls.personalised_pagerank(edges.select(kind, "*"), seeds.select(kind, "*"), 5)
    got = {r["host"]: r["score"] for r in walks.scores.collect()}
    p = a / np.maximum(a.sum(1, keepdims=True), 1)
    base = np.array([2, 1, 0, 0, 0, 0, 0, 0]) / 3
    score = base
    for _ in range(5):
        score = 0.85 * p.T @ score + 0.15 * base
    assert np.allclose([got.get(f"h{i}", 0.0) for i in range(8)], score) and walks.rounds == 5
    settled = urls.personalised_pagerank(edges.select(kind, "*"), seeds.select(kind, "*"))
    assert settled.moved < urls.TOLERANCE and settled.rounds <= urls.ROUNDS


def test_urls_ties_hosts_under_one_domain(spark):
    """Domains are nodes without pages of their own: what is blocked on one host tells against its neighbours."""
    pages = [_page(f"http://a{i}.bad.io/de/x") for i in range(6)] + [_page("http://new.bad.io/"), _page("http://x.good.io/"), _page("http://1.2.3.4/"), _page("http://1.2.3.9/")]
    df = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(pages)], "page_id long, url string, html string")
    edges = urls.host_edges(urls.with_rule(df)).toPandas()
    assert len(edges) == 16 and set(edges["dst"]) > {"bad.io", "good.io"}
    got = urls.judge(df, rules=(("block", "bad.io", "/de/"),)).orderBy("page_id").collect()
    assert [r["verdict"] for r in got] == ["block"] * 7 + ["allow"] * 3 and got[6]["rule"] is None
    deep = urls.ancestors(spark.createDataFrame([("a.b.c.d",)], "host string")).orderBy("src").collect()
    assert [tuple(r) for r in deep] == [("a.b.c.d", "b.c.d"), ("b.c.d", "c.d")]
