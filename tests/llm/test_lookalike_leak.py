"""Problems 5 and 8 against brute force, and on odd input."""

import random

import numpy as np
from pyspark.sql import functions as F

from lexloom.llm import leak, lookalike

E_ACUTE, DECOMPOSED = "é", "é"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "x", i) for i, t in enumerate(texts)], "doc_id long, text string, class_id string, text_id int")


def test_pairs(spark):
    t = [
        f"caf{E_ACUTE} now", f"caf{DECOMPOSED} now", "cafe now", "Café now", "café now", "cаfé now", "ca​fé now", "ｃａｆé now",
        "café now!", "ﬁne", "fine", None, None, "", "​", "café now",
    ]
    got = {tuple(r) for r in lookalike.pairs(docs(spark, t)).collect()}
    same = [0, 1, 4, 5, 6, 7, 15]
    want = {(a, b) for a in same for b in same if a < b and t[a] != t[b]} | {(9, 10), (13, 14)}
    assert got == want
    c = {r.doc_id: r for r in lookalike.canonical(docs(spark, t)).collect()}
    assert len({c[i].class_id for i in same}) == 1 and 11 not in c and c[0].class_id != c[2].class_id
    assert lookalike.pairs(docs(spark, t).filter("false")).count() == 0


def test_hot_copies_make_no_pairs(spark):
    d = docs(spark, ["same text"] * 3000 + ["sаme text"])
    assert lookalike.pairs(d).count() == 3000


def edits(words, n, rng):
    w = list(words)
    for _ in range(n):
        i = rng.randrange(1, len(w) - 1)
        kind = rng.choice("sdi")
        if kind == "s":
            w[i] = f"zz{rng.randrange(99)}"
        elif kind == "d":
            del w[i]
        else:
            w.insert(i, f"zz{rng.randrange(99)}")
    return w


def test_leaks(spark):
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(300)]
    items = [[rng.choice(vocab) for _ in range(40)] for _ in range(30)]
    texts, want = [], set()
    for k in range(120):
        item = rng.randrange(30)
        n = rng.choice([8, 12, 14, 20, 30])
        a = rng.randrange(40 - n + 1)
        passage = items[item][a : a + n]
        e = rng.choice([0, n // 10]) if n >= 14 else 0
        body = edits(passage, e, rng)
        texts.append(" ".join([f"q{rng.randrange(999)}" for _ in range(10)] + body + [f"q{rng.randrange(999)}" for _ in range(5)]))
        if n >= 14:
            want.add((k, item))
    texts += [None, "", "w1 " * 50_000]
    it = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)] + [(99, None), (98, "too short")], "item_id long, text string")
    got = {tuple(r) for r in leak.find(docs(spark, texts), it).collect()}
    brute = {(i, j) for i, t in enumerate(texts[:120]) for j, w in enumerate(items) if leak.leaked(t.split(), w)}
    assert got == brute
    assert len(want - got) <= 4  # an edit at a passage's end shortens it under fourteen words
    assert {i for i, _ in got} <= {i for i, _ in want}
    n = {r.item_id: r.n_docs for r in leak.by_item(leak.find(docs(spark, texts), it), it).collect()}
    assert n[99] == 0 and sum(n.values()) == len(got)


def test_marks_case_and_letters_do_not_count():
    import re

    base = "the quick brown fox jumps over the lazy dog while seven cats watch it quietly today".split()
    assert leak.leaked(base, base) and not leak.leaked(base[:13], base)
    one = base[:6] + ["extra"] + base[6:]
    assert leak.leaked(one, base) and not leak.leaked(base[:4] + ["x"] + base[4:9] + ["y"] + base[9:14], base)
    assert re.sub(leak.MARKS, " ", "a [cont.] b 2/5 c").split() == ["a", "b", "c"]


def test_doubled_and_dropped_equal_words(spark):
    base = "the quick brown fox jumps over over a lazy dog while seven old cats watch it quietly".split()
    doubled = base[:9] + base[8:]  # lazy lazy
    dropped = base[:6] + base[7:]  # one of two "over"
    assert leak.leaked(doubled, base) and leak.leaked(dropped, base)
    assert not leak.leaked(base[:4] + ["x"] + doubled[4:9] + ["y"] + doubled[9:14], base)
    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(300)]
    items, texts, want = [], [], set()
    for k in range(40):
        w = rng.sample(vocab, 20)
        w[8:8] = [w[7]]
        items.append(w)
        i = rng.randrange(5, 13)
        body = w[: i + 1] + w[i:] if k % 2 else w[:8] + w[9:]
        texts.append(" ".join(["q1", *body, "q2"]))
        want.add((k, k))
    it = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    assert want <= {tuple(r) for r in leak.find(docs(spark, texts), it).collect()}


def test_canonical_is_a_member(spark):
    t = ["Сегодня в Москве", "Ceгодня в Mocкве", "Сегодня в Москве", "a cop", "а сор", "cop", "сор", "𝐛old", "bold", "Мир", None, "bold"]
    c = {r.doc_id: r for r in lookalike.canonical(docs(spark, t)).collect()}
    assert [c[i].canonical_text for i in (0, 1, 2)] == [t[0]] * 3 and not c[0].changed and c[1].changed and c[2].changed
    assert c[4].canonical_text == "a cop" and c[6].canonical_text == c[5].canonical_text in ("cop", "сор") and c[7].canonical_text == "bold" and not c[9].changed and 10 not in c
    assert (c[0].n_links, c[7].n_links, c[8].n_links, c[9].n_links) == (2, 2, 1, 0)
    assert c[0].class_id == c[1].class_id != c[3].class_id
    assert lookalike.canonical(docs(spark, t).filter("false")).count() == 0


def test_blocks_lose_no_pair(spark, monkeypatch):
    monkeypatch.setattr(lookalike, "BLOCK", 3)
    t = ["cope" + "​" * (i % 8) for i in range(40)] + ["сope"] * 9
    got = [tuple(r) for r in lookalike.pairs(docs(spark, t)).collect()]
    want = {(a, b) for a in range(49) for b in range(a + 1, 49) if t[a] != t[b]}
    assert len(got) == len(set(got)) and set(got) == want


def test_canonically_equivalent_texts_share_a_skeleton(spark):
    import unicodedata

    chars = [chr(c) for r in (range(0x20, 0x3000), range(0xAC00, 0xAC40), range(0xF900, 0xFB50)) for c in r if unicodedata.category(chr(c)) not in ("Cn", "Co", "Cs")]
    rows = [(f"x{c}y", unicodedata.normalize(n, f"x{c}y")) for c in chars for n in ("NFC", "NFD")]
    d = spark.createDataFrame([r for r in rows if r[0] != r[1]], "a string, b string")
    assert d.filter(lookalike.skeleton(F.col("a")) != lookalike.skeleton(F.col("b"))).count() == 0
    assert lookalike.pairs(docs(spark, ["no 1", "no ١", "no ①"])).count() == 0


def brute_leak(doc, item, least=14, one_in=10):
    """By dynamic programming over edit distances: some ``least`` or more words of the item, the first and last intact, within one edit in ``one_in``."""
    doc = np.array(doc)
    at = np.arange(len(doc) + 1)
    for a in range(len(item) - least + 1):
        cost = np.full(len(doc) + 1, 10**6)
        cost[1:][doc == item[a]] = 0  # ends of a document passage that starts with the item's word a
        cost = np.minimum.accumulate(cost - at) + at
        for b in range(a + 1, len(item)):
            same = doc == item[b]
            kept = np.where(same, cost[:-1], 10**6)
            if b - a + 1 >= least and kept.min(initial=10**6) <= (b - a + 1) // one_in:
                return True
            nxt = np.concatenate([[10**6], np.minimum(kept, cost[:-1] + 1)])
            nxt = np.minimum(nxt, cost + 1)
            cost = np.minimum.accumulate(nxt - at) + at
    return False


def test_leaks_against_edit_distance(spark):
    rng = random.Random(5)
    items, texts, pairs = [], [], []
    for k in range(160):
        n = rng.choice([13, 14, 15, 19, 20, 21, 30, 34])
        vocab = [f"w{i}" for i in range(rng.choice([12, 60, 400]))]
        item = [rng.choice(vocab) for _ in range(n + 6)]
        body = item[3 : 3 + n]
        for _ in range(rng.choice([0, n // 10, n // 10, n // 10 + 1])):
            i = rng.randrange(1, len(body) - 1)
            kind = rng.choice(["change", "drop", "add", "double"])
            body[i : i + 1] = {"change": ["zz"], "drop": [], "add": ["yy", body[i]], "double": [body[i]] * 2}[kind]
        items.append(item)
        texts.append(["q1", "q2", *body, "q3"])
        pairs.append((k, k))
    want = {(k, k) for k, _ in pairs if brute_leak(texts[k], items[k])}
    it = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    d = docs(spark, [" ".join(t) for t in texts])
    got = {tuple(r) for r in leak.find(d, it).collect()}
    assert {(a, b) for a, b in got if a == b} == want and 50 < len(want) < 150
    others = [(a, b) for a, b in got if a != b]
    assert all(brute_leak(texts[a], items[b]) for a, b in others)
    narrow = {tuple(r) for r in leak.find(d, it, gaps=(0,)).collect()}
    assert narrow < got  # the ignored word earns its place


def test_join_paths_agree(spark, monkeypatch):
    base = [f"w{i}" for i in range(40)]
    d = docs(spark, [" ".join(base)] * 50 + ["a " + " ".join(base[5:25]), None, "", "w1"])
    it = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(base[10:30])), (3, None)], "item_id long, text string")
    few = sorted(map(tuple, leak.find(d, it).collect()))
    monkeypatch.setattr(leak, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, leak.find(d, it).collect())) == few == sorted([(i, j) for i in range(51) for j in (1, 2)])
    assert leak.find(d.filter("false"), it).count() == 0 == leak.find(d, it.filter("false")).count()
