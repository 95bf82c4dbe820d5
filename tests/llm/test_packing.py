import random

from reelgrain.llm import packing


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, terms string")


def test_tokens():
    assert packing.tokens_of("Don't stop-me_now 3.5!!  (ok)") == ["Don", "'", "t", "stop", "-", "me_now", "3", ".", "5", "!!", "(", "ok", ")"]
    assert packing.tokens_of("हिन्दी में। ไทยที่") == ["हिन्दी", "में", "।", "ไทยที่"]
    assert packing.tokens_of(" \n\t") == []


def test_every_token_once_and_little_room(spark):
    rng = random.Random(1)
    topics = [[f"w{t}x{i}" for i in range(80)] for t in range(6)]
    rows = [(i, " ".join(rng.choice(topics[i % 6]) for _ in range(int(rng.expovariate(1 / 60)) + 1)), None) for i in range(1500)]
    rows += [(10_000, "long " * 1000, None), (10_001, "", None), (10_002, None, None), (10_003, "  \n ", None), (None, "x", None), (10_004, "b " * 256, None), (10_005, "b " * 257, None)]
    got = packing.pack(docs(spark, rows), capacity=256, shard=300).collect()
    filled, of = {}, {}
    for r in got:
        filled.setdefault(r.container, []).append(r)
        of.setdefault(r.doc_id, []).append(r)
    for members in filled.values():
        n = sum(r.n_tokens for r in members)
        assert n <= 256 and all(r.filled == n for r in members)
    for doc_id, text, _ in rows:
        n = len(packing.tokens_of(text or ""))
        pieces = sorted((r.start_token, r.n_tokens) for r in of.get(doc_id, [])) if doc_id is not None else []
        assert sum(p[1] for p in pieces) == (n if doc_id is not None else 0)
        assert [p[0] for p in pieces] == [256 * i for i in range(len(pieces))]
        assert len(pieces) == (-(-n // 256) if doc_id is not None else 0)
    total = sum(r.n_tokens for r in got)
    assert len(filled) <= total / 256 * 1.03 + 2
    assert {r.doc_id for r in packing.cut_documents(docs(spark, rows), 256).collect()} == {i for i, t, _ in rows if i is not None and len(packing.tokens_of(t or "")) > 256}


def test_repeated_rows_stay_apart(spark):
    rng = random.Random(4)
    texts = [" ".join(f"w{rng.randrange(900)}" for _ in range(rng.randrange(20, 300))) for _ in range(200)]
    rows = [(i, t, None) for i, t in enumerate(texts)] * 3
    got = packing.pack(docs(spark, rows), capacity=256, shard=60).collect()
    want = [len(packing.tokens_of(t)) for _, t, _ in rows]
    assert sum(r.n_tokens for r in got) == sum(want) and len(got) == sum(-(-n // 256) for n in want)
    filled = {}
    for r in got:
        filled.setdefault(r.container, []).append(r.n_tokens)
        assert r.filled <= 256
    assert all(sum(x) <= 256 for x in filled.values()) and sum(1 for x in filled.values() if x == [256]) >= sum(n // 256 for n in want)


def test_neighbours_share_a_container(spark):
    rng = random.Random(2)
    topics = [[f"t{t}w{i}" for i in range(30)] for t in range(4)]
    rows = [(i, " ".join(rng.choice(topics[i % 4]) for _ in range(20)), None) for i in range(400)]
    boxes = {}
    for r in packing.pack(docs(spark, rows), capacity=200).collect():
        boxes.setdefault(r.container, []).append(r.doc_id % 4)
    same = sum(max(b.count(t) for t in range(4)) for b in boxes.values())
    assert same / 400 > 0.8  # by chance it would be under a half


def test_pieces_that_never_combine_and_empty(spark):
    rows = [(i, "a " * 60, None) for i in range(50)]
    assert len({r.container for r in packing.pack(docs(spark, rows), capacity=100).collect()}) == 50
    assert packing.pack(docs(spark, [])).count() == 0
    assert packing.pack(docs(spark, [(1, None, None), (2, "", None)])).count() == 0
    twice = packing.pack(docs(spark, [(1, "a b c", None), (1, "a b c", None)])).collect()
    assert len(twice) == 2


def test_punctuation_only(spark):
    got = packing.pack(docs(spark, [(1, "!!! ??", None), (2, "...", None)])).collect()
    assert sorted((r.doc_id, r.n_tokens, r.filled) for r in got) == [(1, 2, 3), (2, 1, 3)]
