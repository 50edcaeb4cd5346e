"""Near-duplicates, decontamination, BPE and PII against brute force, and on awkward rows."""

from __future__ import annotations

import datetime
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from lodestone.llm import bpe, decontaminate, near_dup, pii

LOW = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
SPACED, ALNUM = re.compile(rb"[^\x20\x09-\x0D]+"), re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def docs(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, node string, fp string")


def near_rows():
    r = random.Random(11)
    word = lambda: "".join(r.choices("abcdefgh", k=r.randint(2, 5)))
    rows, i = [], 0
    for size in (1, 1, 3, 8, 60):
        base = [word() for _ in range(r.randint(40, 120))]
        for _ in range(size):
            t = list(base)
            for _ in range(r.randint(0, 5)):
                t[r.randrange(len(t))] = word()
            rows.append((i, " ".join(t)))
            i += 1
    rows += [(i, None), (i + 1, ""), (i + 2, " \n "), (i + 3, "One two"), (i + 4, "one  TWO"), (i + 5, "z " * 30_000), (i + 6, rows[3][1]), (None, rows[3][1]), rows[4]]
    return rows


def components(rows, width, percent):
    sets = {}
    for i, t in rows:
        w = SPACED.findall((t or "").encode().translate(LOW))
        sets[i] = frozenset(tuple(w[j : j + width]) for j in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])
    root = {i: i for i in sets if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in root:
        for b in root:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in root}


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates(spark, width, percent):
    rows = near_rows()
    out = near_dup.near_duplicates(docs(spark, rows), width, percent).collect()
    want = components(rows, width, percent)
    assert len(out) == len(rows)
    for r in out:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.doc_id == r.component_id)
    kept = near_dup.keep_first(docs(spark, rows), width, percent)
    assert kept.columns == ["doc_id", "text", "node", "fp"]


def test_near_duplicates_of_nothing(spark):
    assert near_dup.near_duplicates(docs(spark, [])).count() == 0


def test_a_hot_list_is_compared_in_blocks(spark, monkeypatch):
    """All links of a group of near copies around the threshold, though its lists are too long for pairs."""
    monkeypatch.setattr(near_dup, "PAIRED", 3)
    rows = near_rows()
    want = components(rows, 3, 85)
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(docs(spark, rows), 3, 85).collect() if r.doc_id is not None}
    assert got == {i: c for i, (_, c) in want.items()}


def test_match_threshold():
    assert near_dup.least_matches(64, 0.85) < 0.85 * 64
    assert near_dup.least_matches(64, 0.85, 1e-3) > near_dup.least_matches(64, 0.85, 1e-9)


def windows(rows, items, size=10):
    win, out = {}, []
    words = lambda t: ALNUM.findall((t or "").encode().translate(LOW))
    for i, t in items:
        w = words(t)
        n = min(size, len(w))
        for j in range(len(w) - n + 1 if n else 0):
            win.setdefault(tuple(w[j : j + n]), set()).add("" if i is None else str(i))
    for i, t in rows:
        w, cover, hit = words(t), set(), set()
        for n in {len(k) for k in win}:
            for j in range(len(w) - n + 1):
                if tuple(w[j : j + n]) in win:
                    hit |= win[tuple(w[j : j + n])]
                    cover.update(range(j, j + n))
        out.append((i, len(w), len(cover), len(hit), hashlib.sha256(",".join(sorted(hit)).encode()).hexdigest(), bool(cover)))
    return sorted(out, key=str)


def test_decontamination(spark):
    r = random.Random(2)
    word = lambda: "".join(r.choices("abcé", k=r.randint(1, 2)))
    items = [(i, " ".join(word() for _ in range(r.randint(8, 25)))) for i in range(12)] + [(90, "solo"), (91, None), (92, ""), (93, "a, a"), (None, "zz yy xx"), (2, "aa aa aa aa aa aa aa aa aa aa aa")]
    rows = []
    for i in range(60):
        w = [word() for _ in range(r.randint(0, 60))]
        if i % 3 == 0:
            t = r.choice(items)[1] or ""
            w[len(w) // 2 : len(w) // 2] = t.upper().split()[r.randint(0, 3) :]
        rows.append((i, "; ".join(w)))
    rows += [(70, None), (71, ""), (72, "Solo!"), (73, "aa " * 5000), (74, "zz-yy.xx"), rows[0], (None, "solo solo")]
    got = decontaminate.digest(decontaminate.phrase_matches(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string")))
    assert sorted(map(tuple, got.collect()), key=str) == windows(rows, items)
    clean = decontaminate.keep_clean(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string"))
    assert clean.columns == ["doc_id", "text", "node", "fp"] and clean.count() == sum(not x[5] for x in windows(rows, items))


def test_decontamination_of_nothing(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.phrase_matches(docs(spark, []), none).count() == 0
    assert [r.n_hit for r in decontaminate.phrase_matches(docs(spark, [(1, "a b")]), none).collect()] == [0]


def test_proximity(spark):
    items = spark.createDataFrame([(1, "red green blue")], "item_id long, text string")
    out = decontaminate.proximity_matches(docs(spark, [(1, "blue x x red x green"), (2, "red " + "x " * 60 + "green blue")]), items, slack=5)
    assert {r.doc_id for r in out.collect()} <= {1, 2} and 1 in {r.doc_id for r in out.collect()}


def reference_encoder():
    import tiktoken

    path, pattern = bpe.public_ranks()
    return tiktoken.Encoding("test", pat_str=pattern, mergeable_ranks=bpe.read_ranks(path), special_tokens={})


def test_bpe_equals_the_library(spark):
    r = random.Random(4)
    texts = [None, "", " ", "a" * 4000, "ab" * 2000, "the  cat\n \n sat ", "don't I'LL", "日本語 テキスト", "é́ ½²", "\U00016ea7x 1՘"] + ["".join(r.choices(" \n\tab'stRe.1２é中😀\x1c", k=r.randint(1, 40))) for _ in range(400)]
    rows = [(i, t) for i, t in enumerate(texts)]
    out = {x.doc_id: x for x in bpe.encode(docs(spark, rows), *bpe.public_ranks()).collect()}
    enc = reference_encoder()
    for i, t in rows:
        ids = enc.encode_ordinary(t or "")
        x = out[i]
        assert (x.n_tokens, list(x.token_ids or [])) == (len(ids), ids)
        assert x.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert x.decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    fast = bpe.encode(docs(spark, rows), *bpe.public_ranks(), shortcuts=True)
    assert {x.doc_id: x.ids_sha256 for x in fast.collect()} == {i: x.ids_sha256 for i, x in out.items()}
    back = bpe.decode(bpe.encode(docs(spark, rows), *bpe.public_ranks()), bpe.public_ranks()[0])
    assert all(bytes(x.decoded).decode() == (x.text or "") for x in back.collect())


def test_bpe_of_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK", 2000)
    monkeypatch.setattr(bpe, "BUCKET", 500)
    r = random.Random(5)
    some = ["the", "Katze", "日本", "x1.5", "isn't", "zzzzzz,", "😀", "  ", "a\n"]
    rows = [(i, None if i % 50 == 7 else "" if i % 50 == 8 else " ".join(r.choices(some, k=r.randint(1, 60)))) for i in range(600)]
    rows += [(1, "the the"), (1, "the the"), (2, "w " * 30000 + "end")] + [(9, "same words here, again")] * 300
    enc = reference_encoder()
    want = sorted((i, ",".join(map(str, enc.encode_ordinary(t or "")))) for i, t in rows)
    table = docs(spark, rows).withColumn("block", F.lit(3)).withColumn("words", F.lit("w")).repartition(5)
    for shortcuts in (False, True):
        out = bpe.encode(table, *bpe.public_ranks(), shortcuts=shortcuts, text=False)
        assert out.columns == ["doc_id", "node", "fp", "block", "words", "n_tokens", "ids_sha256", "decoded_sha256", "token_ids"]
        got = out.collect()
        assert sorted((x.doc_id, ",".join(map(str, x.token_ids))) for x in got) == want
        assert {(x.block, x.words) for x in got} == {(3, "w")}
    assert bpe.encode(table.limit(0), *bpe.public_ranks()).count() == 0


def test_replay_of_many_places_equals_that_of_few(monkeypatch):
    ranks = bpe.read_ranks(bpe.public_ranks()[0])
    r = random.Random(9)
    pieces = ["".join(r.choices("abcdeththeing", k=r.randint(1, 30))).encode() for _ in range(1500)]
    slow = bpe.MergeReplay(ranks)
    monkeypatch.setattr(bpe, "MANY", 10**9)
    want = slow.encode(pieces)
    monkeypatch.setattr(bpe, "MANY", 2)
    assert bpe.MergeReplay(ranks).encode(pieces) == want


def luhn(s):
    d = [int(c) for c in reversed(s)]
    return sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(d)) % 10 == 0


def test_pseudonyms(spark):
    rows = [(1, "card 4207051279108084, ip 28.125.121.88"), (2, "again 4207051279108084"), (3, "bad 4207051279108085 and 999.1.1.1"), (4, "mail a.b@c.example.org tel +1 (927) 555-7911"), (5, None), (6, ""), (7, "iban DE89370400440532013000 born 1984-02-29"), (8, "plain words, 12 of them"), (9, "x" * 200_000), (1, "repeated id 4207051279108084")]
    out = {}
    for r in pii.pseudonymise(docs(spark, rows), "key").collect():
        out.setdefault(r.doc_id, r.text)
    card = re.search(r"\d{16}", out[1])[0]
    assert card != "4207051279108084" and luhn(card) and card in out[2]
    assert out[3] == rows[2][1] and out[5] is None and out[6] == "" and out[8] == rows[7][1] and out[9] == rows[8][1]
    assert "28.125.121.88" not in out[1] and "a.b@c" not in out[4] and "555-7911" not in out[4] and re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}", out[4])
    iban = re.search(r"DE\d{20}", out[7])[0]
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1
    datetime.date.fromisoformat(re.search(r"\d{4}-\d\d-\d\d", out[7])[0])
    assert pii.pseudonymise(docs(spark, []), "key").count() == 0


def test_permutations_are_one_to_one(spark):
    df = spark.range(2000).select(F.lpad(F.col("id").cast("string"), 4, "0").alias("d"), F.date_add(F.lit("1990-01-01").cast("date"), F.col("id").cast("int")).cast("string").alias("day"))
    out = df.select(pii.digits_permuted(F.col("d"), "k", "t").alias("d"), pii.date_pseudonym(F.col("day"), "k").alias("day"))
    assert out.agg(F.countDistinct("d"), F.countDistinct("day"), F.max(F.length("d")), F.min(F.length("d"))).first() == (2000, 2000, 4, 4)
