"""Ranked search, packing and the conversation trie, held against plain versions."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import contract, packing, search, trie

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def plain_ranks(docs, items, k):
    terms = [TERM.findall(lower(t)) for _, t in docs]
    n_docs, n_terms = sum(bool(t) for t in terms), sum(map(len, terms))
    df = collections.Counter(t for own in terms for t in set(own))
    out = []
    for item, text in items:
        scored = []
        for (doc, _), own in zip(docs, terms, strict=True):
            tf, m = collections.Counter(own), 10 + 90 * len(own) * n_docs // max(n_terms, 1)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 8 * m)) for t in set(TERM.findall(lower(text))) if tf[t])
            if score:
                scored.append((-score, doc is not None, doc or 0))
        out += [(item, r, d if known else None, -s) for r, (s, known, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def searched(spark, docs, items, k=10):
    d = spark.createDataFrame([(*x, 1, 2) for x in docs], "doc_id long, text string, terms int, `key.x` int")
    i = spark.createDataFrame([(*x, 3) for x in items], "item_id long, text string, rank int")
    return sorted(map(tuple, search.rank_documents(d, i, k).select("item_id", "rank", "doc_id", "score").collect()), key=str)


def test_search_equals_a_plain_ranking(spark):
    r = random.Random(5)
    vocabulary = ["".join(r.choices("abcéß0", k=r.randint(1, 3))) for _ in range(120)]
    draw = lambda n: " ".join(r.choice(vocabulary[: r.choice([5, 120])]) for _ in range(n))
    docs = [(i, draw(r.randint(1, 40))) for i in range(500)] + [(1_000 + i, "A b, c-0 É") for i in range(90)] + [(7, None), (8, ""), (9, "!!"), (None, "a b"), (None, "a b"), (3, "a b"), (3, "a b"), (4, draw(50_000))]
    items = [(i, draw(12)) for i in range(20)] + [(5, "a a a b"), (5, "a a a b"), (None, "c 0 é"), (77, None), (78, "?"), (79, "nowhere"), (80, "x" * 100_000)]
    assert searched(spark, docs, items) == plain_ranks(docs, items, 10)
    assert searched(spark, docs, items, 3) == plain_ranks(docs, items, 3)


def test_search_with_a_floor_and_with_small_trees(spark, monkeypatch):
    r = random.Random(6)
    docs = [(i, " ".join(f"w{int(r.paretovariate(0.7))}" for _ in range(8))) for i in range(5_000)]
    items = [(i, docs[i * 7][1]) for i in range(30)] + [(99, "w1 w2")]
    assert searched(spark, docs, items) == plain_ranks(docs, items, 10)
    monkeypatch.setattr(search, "TERMS", 40)  # several parts
    assert searched(spark, docs[:300], items) == plain_ranks(docs[:300], items, 10)
    assert searched(spark, [], items) == [] and searched(spark, docs, []) == [] and searched(spark, [(1, None)], items) == []


def test_no_bound_is_below_a_score_and_trees_prune():
    r = np.random.default_rng(3)
    themes = [np.sort(r.choice(400, 20, replace=False)) for _ in range(40)]
    rows = [np.unique(np.concatenate([r.choice(themes[i % 40], 15), r.choice(400, 2)])) for i in range(2_000)]
    terms, ends = np.concatenate(rows), np.concatenate([[0], np.cumsum([len(x) for x in rows])])
    values = r.integers(500_000, 900_000, len(terms))
    items = search.Items([t[:12] for t in themes], r.integers(9_000, 20_000, 400))
    tree = search.Tree(ends, terms, values, items)
    assert sorted(np.concatenate([x for x in tree.rows if x is not None])) == list(range(2_000))
    dense = np.zeros((2_000, 400), np.int64)
    for i, row in enumerate(rows):
        dense[i, row] = values[ends[i] : ends[i + 1]]
    scores = np.stack([dense[:, t[:12]] @ items.weights[t[:12]] for t in themes])

    def below(n):
        return tree.rows[n] if tree.rows[n] is not None else np.concatenate([below(c) for c in tree.nodes[n][3:]])

    for n in range(len(tree.nodes)):
        assert (tree.bounds(n) >= scores[:, below(n)].max(1)).all()
    best = [[] for _ in themes]
    met = search.descend(tree, best, 5, [(False, -i) for i in range(2_000)])
    leaves = sum(x is not None for x in tree.rows)
    assert met < 0.5 * leaves * len(themes)
    for i, top in enumerate(best):
        assert sorted((-s, -k[1]) for s, k, _ in top) == sorted((-int(scores[i, d]), d) for d in range(2_000))[:5]


TOKENIZER = packing.public_words()


def test_pieces_equal_the_library(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(TOKENIZER)
    texts = ["The cat, the dog; don't!", "Größe ÀÉ ÷ × İstanbul ſ ﬁ K Å é ́x", "a\x1cb\x85c\xa0d e\tf\vg", "<|endoftext|> x<|startoftext|>y", "12 3.4 'S 'll", "日本語 テスト 🙂🙂", "x" * 300, None, "", " \n ", "word " * 5_000, "Ab1" * 400_000]
    rows = spark.createDataFrame([(i, x, "n") for i, x in enumerate(texts)], "doc_id long, text string, length string")
    out = packing.pieces(rows, TOKENIZER, room=1_000, end=1, ids=True).orderBy("doc_id", "piece").collect()
    for i, x in enumerate(texts):
        want = t.encode(x or "", add_special_tokens=False).ids + [1]
        own = [r for r in out if r.doc_id == i]
        assert [v for r in own for v in r.token_ids] == want, x
        assert [r.piece for r in own] == list(range(-(-len(want) // 1_000))) and all(r.start == 1_000 * r.piece and r.length == len(r.token_ids) for r in own)
        assert all(r.ids_crc32 == zlib.crc32(np.array(r.token_ids, "<u4").tobytes()) for r in own)


def test_fullest_is_the_fullest():
    r = random.Random(4)
    for _ in range(300):
        counts, room = {r.randint(1, 30): r.randint(0, 3) for _ in range(r.randint(0, 6))}, r.randint(0, 60)
        sums = {0}
        for n, c in counts.items():
            sums |= {s + n * k for s in sums for k in range(c + 1)}
        taken = packing.fullest(counts, room)
        assert all(k <= counts[n] for n, k in taken.items()) and sum(n * k for n, k in taken.items()) == max(s for s in sums if s <= room)


def test_packing(spark):
    r = random.Random(8)
    words = lambda n: " ".join(["the"] * n)
    rows = [(i, words(r.randint(0, 60))) for i in range(900)] + [(i, words(9)) for i in range(600)] + [(5, None), (5, None), (None, ""), (6, words(1_234))]
    df = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, offset int")
    out = packing.pack_documents(df, TOKENIZER, room=100, ids=True)
    got = out.collect()
    total = sum(len((t or "").split()) + 1 for _, t in rows)
    assert sum(x.length for x in got) == total and len(got) == len(rows) + 12
    bins = collections.defaultdict(list)
    for x in got:
        bins[x.sequence_id].append((x.offset, x.length))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 100
    assert len(bins) == -(-total // 100)
    whole = {s.sequence_id: s for s in packing.sequences(out).collect()}
    assert set(whole) == set(bins) and all(len(s.token_ids) == s.length == sum(n for _, n in bins[i]) for i, s in whole.items())
    assert packing.pack_documents(df.limit(0), TOKENIZER).count() == 0
    with pytest.raises(ValueError):
        packing.pieces(df, TOKENIZER, room=0)


def plain_trie(rows):
    convs = collections.defaultdict(list)
    for conv, turn, role, text in sorted(rows, key=lambda x: (x[1] is not None, x[1] or 0)):
        convs[conv].append((role or "", text or ""))
    convs.pop(None, None)
    made = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        made[c] = convs.get(c - c % 5, [])[:h] + own[h:]
    members, kids = collections.defaultdict(list), collections.defaultdict(set)
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
            if d:
                kids[tuple(turns[: d - 1])].add(tuple(turns[:d]))
    total = {}
    for node in sorted(members, key=len, reverse=True):
        leaves, saved = int(not kids[node]), (len(members[node]) - 1) * (len(node[-1][1].encode()) if node else 0)
        total[node] = (leaves + sum(total[k][0] for k in kids[node]), saved + sum(total[k][1] for k in kids[node]))
    out = []
    for node, own in members.items():
        ends = ",".join(str(c) for c in sorted(own) if len(made[c]) == len(node))
        out.append((min(own), len(node), min(members[node[:-1]]) if node else None, len(own), len(kids[node]), *total[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def made_trie(spark, rows):
    df = spark.createDataFrame([(*x, 0) for x in rows], "conv_id long, turn long, role string, text string, depth int")
    return sorted(map(tuple, trie.conversation_trie(df).collect()), key=str)


def test_trie_equals_a_plain_one(spark, monkeypatch):
    r = random.Random(9)
    rows = [(c, t, r.choice(["user", "bot", None]), r.choice(["a", "bé", "", None, "long " * 50])) for c in range(150) for t in range(r.randint(1, 12)) if c % 5 or c % 3]
    rows += [(1_000 + c, t, "user", "same") for c in range(80) for t in range(4)]  # a hot conversation
    rows += [(2_000, t, "user", f"t{t % 7}") for t in range(700)] + [(2_001, None, "user", "first"), (2_001, 5, "x", "y" * 1_000_000), (-7, 1, "user", "below")]  # a long one
    rows += [(None, 1, "user", "nobody's")]
    want = plain_trie(rows)
    assert made_trie(spark, rows) == want
    monkeypatch.setattr(trie, "RUN", 20)  # several runs of ids
    assert made_trie(spark, rows) == want
    assert made_trie(spark, []) == [] and made_trie(spark, [(None, 1, "a", "b")]) == []


def test_repeated_turns_and_ties_are_turns(spark):
    rows = [(5, 1, "user", "a")] * 3 + [(5, 1, "bot", "a"), (5, None, "user", "z")]
    out = made_trie(spark, rows)
    assert len(out) == 6 and max(x[1] for x in out) == 5


def test_contraction_of_chains_stars_and_forests(spark):
    r = random.Random(2)
    up = {i: i - 1 for i in range(1, 400)} | {i: 37 for i in range(400, 900)} | {i: r.randint(0, i - 1) for i in range(900, 1_500)}
    up |= {2_000: None, 2_001: 2_000, 0: None}
    level = {}
    for i in sorted(up):
        level[i] = 0 if up[i] is None else level[up[i]] + 1
    value = {i: r.randint(0, 9) for i in up}
    want = dict(value)
    for i in sorted(up, reverse=True):
        if up[i] is not None:
            want[up[i]] += want[i]
    nodes = spark.createDataFrame([(i, up[i], level[i], value[i], 1) for i in up], "id long, parent long, level long, v long, n_nodes int")
    got = contract.subtree_totals(nodes, ["v", "n_nodes"]).collect()
    assert {x.id: x.v for x in got} == want and len(got) == len(up)
    assert {x.id: x.n_nodes for x in got}[0] == sum(i < 2_000 for i in up)
    with pytest.raises(RuntimeError):
        contract.subtree_totals(nodes.filter("id < 2").withColumn("parent", 1 - F.col("id")), ["v"], most=3)
