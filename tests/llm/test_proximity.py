"""Proximity matches against a plain scan, and rows that hold much of the test set."""

from __future__ import annotations

import collections
import random
import re

from lodestone.llm import decontaminate

WORD = re.compile(r"[0-9a-z]+")


def test_proximity_equals_a_plain_scan(spark):
    r = random.Random(5)
    vocabulary = [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(r.choices(vocabulary, k=r.randint(0, 60)))) for i in range(120)] + [(500, None), (501, "w1 " * 3_000 + "w2 " * 3_000)]
    items = [(i, " ".join(r.choices(vocabulary, k=n))) for i, n in enumerate([12, 10, 4, 1, 15])] + [(9, None), (10, "w1 w2")]
    seen = collections.Counter(w for _, t in docs for w in WORD.findall(t or ""))
    want = set()
    for item, text in items:
        words = WORD.findall(text or "")
        for start in range(max(1, len(words) - 5 + 1) if words else 0):
            window = sorted(range(start, min(start + 5, len(words))), key=lambda p: (seen[words[p]], p))
            if seen[words[window[0]]] == 0:
                continue
            one, two = words[window[0]], words[window[min(1, len(window) - 1)]]
            for doc, t in docs:
                own = WORD.findall(t or "")
                x, y = [i for i, w in enumerate(own) if w == one], [i for i, w in enumerate(own) if w == two]
                if x and y and (one == two or min(abs(p - y[0 if p < y[0] else -1]) if p < y[0] or p > y[-1] else min(abs(p - q) for q in y) for p in x) <= 3):
                    want.add((doc, str(item), start))
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = [tuple(x) for x in decontaminate.proximity_matches(*frames, size=5, slack=3).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_a_row_that_holds_the_whole_test_set(spark):
    r = random.Random(6)
    items = [(i, " ".join(f"x{r.randint(0, 400)}" for _ in range(30))) for i in range(300)]
    whole = " ".join(t for _, t in items) + " and " + " ".join(items[7][1] for _ in range(50))
    frames = spark.createDataFrame([(1, whole), (2, "x1 x2 x3")], "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {x.doc_id: x for x in decontaminate.phrase_matches(*frames).collect()}
    assert len(got[1].item_ids) == 300 and got[1].n_words == 300 * 30 + 1 + 50 * 30 and got[1].n_hit == got[1].n_words - 1 and got[2].n_hit == 0
