import random

import numpy as np
import pytest

from reelgrain.llm import leakage

ITEMS, DOCS = "item_id long, lang string, text string, doc_id int", "doc_id long, text string, lang string, item_id string"


def found(spark, items, docs, **kw):
    got = leakage.leaks(spark.createDataFrame([(*i, 0) for i in items], ITEMS), spark.createDataFrame([(*d, "x", "y") for d in docs], DOCS), **kw)
    return got.collect()


def one_edit(test, text, need):
    """Brute force: text holds ``need`` tokens of test with at most one changed, dropped or added."""
    n, m = len(test), len(text)

    def lcp(i, j):
        k = 0
        while i + k < n and j + k < m and test[i + k] == text[j + k]:
            k += 1
        return k

    for i in range(n):
        for j in range(m):
            a = lcp(i, j)
            if not a:
                continue
            best = a
            if i + a < n:
                best = max(best, a + 1 + lcp(i + a + 1, j + a + 1), a + 1 + lcp(i + a + 1, j + a))
            best = max(best, a + lcp(i + a, j + a + 1))
            # an edit in front
            if i > 0:
                best = max(best, a + 1)
            if best >= need:
                return True
    return False


def test_suffix_order_is_sorted():
    rng = np.random.default_rng(0)
    t = np.append(rng.integers(1, 4, 300), 0)
    order = leakage.suffix_order(t, np.arange(len(t)), 400)
    s = [tuple(t[i:]) for i in order]
    assert s == sorted(s)


@pytest.mark.parametrize("seed", range(4))
def test_against_brute_force(spark, seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    items = [(i, "en", " ".join(rng.choice(words) for _ in range(rng.randrange(5, 60)))) for i in range(12)]
    docs = []
    for d in range(60):
        text = [rng.choice(words) for _ in range(rng.randrange(0, 50))]
        src = leakage.words_of(rng.choice(items)[2])
        at, size = rng.randrange(len(src)), rng.randrange(8, 40)
        part = src[at : at + size]
        for _ in range(rng.choice([0, 1, 1, 2])):
            k = rng.randrange(len(part) + 1)
            how = rng.randrange(3)
            part = part[:k] + ([rng.choice(words)] if how < 2 else []) + part[k + (how != 1) :]
        where = rng.randrange(len(text) + 1)
        docs.append((d, " ".join(text[:where] + part + text[where:])))
    got = {(r.item_id, r.doc_id) for r in found(spark, items, docs, min_words=16, shard_words=400)}
    want = {(i, d) for i, _, t in items for d, x in docs if one_edit(leakage.words_of(t), leakage.words_of(x), 16)}
    assert got == want


def test_disguises_and_positions(spark):
    item = "Cable ZX-12015 explains why the contact stretch was drawn over plug NF-41184 near the far wall it had moved two metres in many frames and touched the wedge robot"
    dirty = item.upper().replace("CONTACT", "**con­tact**").replace("WALL", "<b>WALL</b>").replace(" ", "  \n").replace("12015", "１２０１５")
    short = " ".join(item.split()[:18])
    rows = found(spark, [(1, "en", item), (2, "en", None), (3, "en", "")], [(1, f"Before. {dirty} after"), (2, short), (3, None), (4, ""), (5, item), (5, item)])
    assert sorted((r.item_id, r.doc_id) for r in rows) == [(1, 1), (1, 5)]
    assert next(r for r in rows if r.doc_id == 1).doc_start == 1
    assert next(r for r in rows if r.doc_id == 5).span == len(leakage.words_of(item))


def test_characters_for_scripts_without_spaces(spark):
    rng = random.Random(3)
    han = [chr(0x4E00 + i) for i in range(500)]
    item = "".join(rng.choice(han) for _ in range(120))
    hit, miss, edited = item[20:64], item[20:63], item[20:40] + "文" + item[41:70]
    docs = [(1, "前言。" + "，".join(hit[i : i + 9] for i in range(0, 44, 9)) + "。"), (2, miss), (3, edited), (4, "no han here at all")]
    rows = found(spark, [(1, "zh", item), (2, "en", item)], docs)
    assert [(r.item_id, r.doc_id, r.kind) for r in rows] == [(1, 1, "chars")]


def test_a_passage_many_items_and_documents_share(spark, monkeypatch):
    monkeypatch.setattr(leakage, "PLACES", 100)
    shared = " ".join(f"w{i}" for i in range(40))
    items = [(i, "en", f"a{i} {shared} b{i}") for i in range(12)]
    rows = found(spark, items, [(d, f"{shared} d{d} <{'q' * 400}>") for d in range(25)])
    assert sorted((r.item_id, r.doc_id) for r in rows) == [(i, d) for i in range(12) for d in range(25)]
    # 40 words and a changed or dropped one before or behind them
    assert {r.span for r in rows} == {41}


def test_clean_and_empty(spark):
    item = " ".join(f"w{i}" for i in range(30))
    items = spark.createDataFrame([(1, "en", item, 0)], ITEMS)
    docs = spark.createDataFrame([(1, item, "a", "b"), (2, "fine", "a", "b"), (3, None, "a", "b")], DOCS)
    assert sorted(r.doc_id for r in leakage.clean(items, docs).collect()) == [2, 3]
    assert leakage.leaks(items.limit(0), docs).count() == 0
    assert leakage.leaks(items, docs.limit(0)).count() == 0
