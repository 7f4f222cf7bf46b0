"""Phrases, conversations and decontamination: brute force, odd rows, and the structures they rest on."""

import hashlib
import itertools
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from footfall.llm import contamination, conversations, phrases
from footfall.llm.fmindex import FMIndex, suffix_array

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


# --- decontamination -------------------------------------------------------------------------------------------------


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words_of(text):
    return re.findall("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", lower(text))


def plain_hits(text, items):
    w, hit, names = words_of(text), set(), set()
    for name, item in items:
        x = words_of(item)
        size = min(10, len(x))
        for i in range(max(1, len(x) - 9)) if x else ():
            for j in range(len(w) - size + 1):
                if w[j : j + size] == x[i : i + size]:
                    hit.update(range(j, j + size))
                    if name is not None:
                        names.add(name)
    return len(w), len(hit), sorted(map(str, names))


@pytest.mark.parametrize("text", ["", "a", "banana", "abababababab", "mississippi", "aaaaaaaaaaaaaaaaaaaaaaaaa"])
def test_suffix_array(text):
    s = np.array([ord(c) - 95 for c in text] + [0])
    assert suffix_array(s).tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())


def test_index_finds_all_occurrences():
    rng = np.random.default_rng(5)
    for _ in range(20):
        words = rng.choice([1, 2, 3, 4], size=400, p=[0.1, 0.3, 0.3, 0.3])
        index = FMIndex(words, 5)
        wanted = [rng.choice([2, 3, 4], size=n) for n in (1, 2, 3, 4, 5, 7) for _ in range(5)]
        rows = np.zeros((len(wanted), 8), np.int64)
        for row, x in zip(rows, wanted):
            row[8 - len(x) :] = x
        low, high = index.search(rows, np.array(list(map(len, wanted))))
        for x, a, b in zip(wanted, low, high):
            places = [i for i in range(len(words) - len(x) + 1) if (words[i : i + len(x)] == x).all()]
            assert sorted(index.locate(np.arange(a, max(a, b)))) == places


def test_contamination_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(2)
    word = lambda: str(rng.choice(["ab", "Cd", "é", "x1", "zz"]))
    text = lambda n: "".join(word() + str(rng.choice([" ", ", ", "\n", "-"])) for _ in range(n))
    items = [(i, text(int(n))) for i, n in enumerate((12, 10, 9, 3, 25, 4))] + [(4, text(3)), (None, text(4)), (9, None), (10, " ..."), (11, "ab")]
    shared = [t for _, t in items if t]
    docs = [(i, text(60) + str(rng.choice(shared)) + text(20)) for i in range(40)] + [(None, shared[0]), (1, shared[1]), (1, shared[1]), (50, None), (51, ""), (52, " .,"), (2**60 + 1, "ab " * 3000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("items", F.lit("clash")).withColumn("spans", F.lit(1)).withColumn("n_words", F.lit("x"))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("name", F.lit("clash"))
    want = Counter((d, *plain_hits(t, items)) [:3] + (tuple(plain_hits(t, items)[2]),) for d, t in docs)
    # the shards of one index, and the items of one pass, are many parts here
    for shard, words in ((1 << 20, 1 << 20), (64, 40)):
        monkeypatch.setattr(contamination, "PASS_WORDS", words)
        monkeypatch.setattr(contamination, "SHARD_WORDS", shard)
        phrases_ = contamination.Phrases([str(a) if a is not None else None for a, _ in items], [t for _, t in items])
        found = phrases_.found([t for _, t in docs], [[]] * len(docs), [[]] * len(docs))
        assert Counter((d, n, h, tuple(x)) for (d, _), (n, h, x, _) in zip(docs, found)) == want
        got = contamination.scan(df, bench).collect()
        assert Counter((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in got) == want
    judged = {(r["doc_id"], r["n_words"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in contamination.judged(contamination.scan(df, bench)).collect()}
    assert judged == {(d, n, len(x), hashlib.sha256(",".join(x).encode()).hexdigest(), h > 0) for d, n, h, x in want}
    assert contamination.scan(df.limit(0), bench).count() == 0
    assert contamination.scan(df, bench.limit(0)).where("n_hit > 0").count() == 0


def test_removal_spans(spark):
    docs = spark.createDataFrame([(1, "Éé one TWO, three\U0001f600 four end"), (2, "nothing here"), (3, "one two three"), (4, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "one two"), (2, "Three\U0001f600 four")], "item_id long, text string")
    found = contamination.scan(docs, bench).join(docs, "doc_id").withColumn("left", contamination.without_spans(F.col("text"), F.col("spans")))
    got = {r["doc_id"]: ([tuple(s) for s in r["spans"]], r["left"]) for r in found.collect()}
    assert got == {1: ([(3, 23)], "Éé  end"), 2: ([], "nothing here"), 3: ([(0, 7)], " three"), 4: ([], None)}


# --- conversations ---------------------------------------------------------------------------------------------------


def plain_edits(rows):
    """Cheapest edits by all audits in order of cost, then ASCII: a plain search over (row, state)."""
    best = {(0, "_"): (0, "", ())}
    after = {"_": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    added = {"_": "u", "s": "u", "u": "a", "a": "u"}
    roles = {"u": "user", "a": "assistant"}

    def put(table, key, value):
        if key not in table or value < table[key]:
            table[key] = value

    for i in range(len(rows) + 1):
        for _ in range(4):
            for (at, q), (cost, audit, out) in list(best.items()):
                if at == i:
                    put(best, (i, added[q]), (cost + 2, audit + "I", out + (roles[added[q]] + ":",)))
        if i < len(rows):
            role, text, fault = rows[i]
            more = 1 if fault == "truncated" else 0
            for (at, q), (cost, audit, out) in list(best.items()):
                if at != i:
                    continue
                put(best, (i + 1, q), (cost + 3, audit + "D", out))
                if fault not in ("blank", "duplicate"):
                    if role[:1] in after[q]:
                        put(best, (i + 1, role[:1]), (cost + more, audit + "K", (*out, f"{role}:{text}")))
                    put(best, (i + 1, added[q]), (cost + 2 + more, audit + "R", (*out, f"{roles[added[q]]}:{text}")))
    return min(best[k] for k in best if k[0] == len(rows) and k[1] in "_a")


def plain_report(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, marked = set(), []
    for turn, role, text in rows:
        end = text.strip(" \t\n\x0b\x0c\r")[-1:]
        marked.append((role, text, "blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end not in ".!?" else ""))
        seen.add((role, text))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:]))
    cost, audit, out = plain_edits(marked)
    return (gaps, *(sum(f == n for _, _, f in marked) for n in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def test_runs_and_their_powers_against_single_rows():
    for n, symbols in itertools.product((1, 2, 3, 7, 8, 100), (["u0"], ["a1", "u0"], ["s0", "x2", "u1"], ["2", "a0"])):
        runs = tuple((s, n) for s in symbols)
        illegal, cost, edits, tail = conversations.solve(runs)
        rows = [(s[:-1], "", {"0": "", "1": "truncated", "2": "blank"}[s[-1]]) for s in symbols for _ in range(n)]
        assert (cost, "".join(edits) + tail) == plain_edits(rows)[:2]
    assert conversations.solve((("u0", 10**5),))[1] == 10**5  # every other one is made an assistant
    assert conversations.solve(()) == (0, 0, [], "")


def test_conversations_brute_force(spark):
    rng = np.random.default_rng(7)
    rows = []
    for conv in range(120):
        for turn in range(int(rng.integers(1, 9))):
            rows.append((conv, turn + int(rng.integers(0, 2)), str(rng.choice(["system", "user", "assistant", "tool", "", "User"], p=[0.1, 0.4, 0.35, 0.05, 0.05, 0.05])), str(rng.choice(["Yes.", "No!", "cut off", " \t", "", "Why? ", "end.\n", "fff"]))))
    rows += [(None, 0, "user", "Hi."), (None, 1, "assistant", "Yes."), (200, None, "user", "a."), (200, None, "user", "a."), (200, 5, None, None), (200, 2, "assistant", None), (201, 0, None, "text."), (202, None, "u", "z.")]
    rows += [(2**60 + 1, t, ("user", "assistant")[t % 2], f"text {t}.") for t in range(700)] + [(2**60 + 3, 1, "user", "same.")] * 600
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("pos", F.lit("clash")).withColumn("fault", F.lit(1)).withColumn("cost", F.lit("x"))
    groups = {}
    for conv, turn, role, text in rows:
        groups.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    report, repaired = conversations.repair(df)
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    got = {r["conv_id"]: tuple(r[n] for n in names) for r in report.collect()}
    assert got == {conv: plain_report(x) for conv, x in groups.items()}
    legal = repaired.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("pos", "place", F.substring("line", 1, 1).alias("i")))).alias("x")).collect()
    assert all(re.fullmatch("(s?(ua)+)?", "".join(y["i"] for y in r["x"])) for r in legal)
    assert conversations.repair(df.limit(0))[0].count() == 0


def test_conversations_lost_whole(spark):
    """Conversations all of whose rows are dropped are reported with zeros."""
    lost = [c for c in range(300) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    df = spark.createDataFrame([(c, 0, "user", "Hi.") for c in lost] + [(10**6, None, None, None)], "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in conversations.report_all(df, conversations.damaged(df)).collect()}
    assert set(got) == {*lost, 10**6} and lost
    assert all(got[c]["cost"] == 0 and got[c]["audit"] == "" and got[c]["repaired_sha256"] == hashlib.sha256(b"").hexdigest() for c in lost)


# --- phrases ---------------------------------------------------------------------------------------------------------


def plain_phrases(docs, least, most=2000):
    out = []
    by_lang = {}
    for lang, text in docs:
        by_lang.setdefault("und" if lang is None else lang, []).append(text)
    for lang, texts in by_lang.items():
        f = Counter()
        for text in texts:
            for piece in re.split("[.,;:!?\\x0A-\\x0D]", lower(text)):
                w = re.findall("[^\\x20\\x09]+", piece)
                f.update(tuple(w[i : i + k]) for k in range(1, 5) for i in range(len(w) - k + 1))
        n = sum(v for k, v in f.items() if len(k) == 1)
        frequent = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        held = Counter()
        for p, a in frequent.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    held[p[i : i + m]] = max(held[p[i : i + m]], a)
        rows = []
        for p, a in frequent.items():
            if 100 * held[p] >= 80 * a:
                continue
            score, _, l, r = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i, p.decode(), -a, l, r, n, -s) for i, (s, a, p, l, r) in enumerate(sorted(rows)[:most], 1)]
    return sorted(out)


def test_phrases_brute_force(spark):
    rng = np.random.default_rng(3)
    vocabulary = ["the", "cat", "Sat", "é", "on", "x y", "mat"]
    text = lambda n: "".join(str(rng.choice(vocabulary)) + str(rng.choice([" ", "  ", "\t", ". ", "\n", ","], p=[0.7, 0.1, 0.05, 0.05, 0.05, 0.05])) for _ in range(n))
    fixed = "one passage that repeats itself and never changes at all"
    docs = [(i, text(80) + fixed + text(10), str(rng.choice(["en", "de"]))) for i in range(60)] + [(None, "the cat " * 50, None), (1, "the cat", "und"), (1, "", "fr"), (2, None, "en"), (3, " .\t\n", "en"), (4, "a a a a a a a a a a", "")]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumn("bucket", F.lit("clash")).withColumn("phrase", F.lit(1)).withColumn("f", F.lit("x"))
    for least, most in ((6, 2000), (3, 10)):
        got = sorted(tuple(r) for r in phrases.mine(df, least, most).collect())
        assert got == plain_phrases([(lang, t) for _, t, lang in docs], least, most)
    assert phrases.mine(df.limit(0)).count() == 0
    counted = phrases.counts(df, 6)
    compacted = phrases.paths(counted, phrases.links(counted)).collect()
    # unary paths hold every frequent edge once, with its count
    edges = Counter()
    for r in compacted:
        w = r["path"].split(" ")
        assert len(w) == r["n_edges"] + 3
        edges.update((r["lang"], " ".join(w[i : i + 4]), r["weight"]) for i in range(r["n_edges"]))
    assert edges == Counter((r["lang"], r["phrase"], r["f"]) for r in counted.where("k = 4").collect())
    assert max(r["n_edges"] for r in compacted) >= 6  # the passage, but for its last word, which others follow at once
