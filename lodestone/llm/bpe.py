"""Byte-level BPE by merge replay over the corpus's distinct words, and decoding.

1. Each task cuts its documents into blocks of a few megabytes. It sends a block's distinct words, one compressed list for
   each bucket that words hash to, and later the block's documents, as one compressed row.
2. The lists of a bucket meet, so that each distinct word of the corpus is encoded once. The pieces of the words (what the
   split pattern matches) are laid out in one array of symbols; an inverted index holds, for each mergeable token pair, the
   positions where it stands. Merges are applied in rank order, and each touches only its two neighbours, whose new pairs
   enter the index. A piece of any length costs n log n. Pieces don't interact, so it doesn't matter where one is replayed.
3. Each block meets the ids of its words again, and its documents are put together from them.

Documents move once, compressed; a word moves once a block, and its ids once back. The number of buckets follows the corpus's size, so a bucket's
distinct words stay below BUCKET bytes, and a word that every block has makes one entry a block. Give a table read from
files: a task that is run again then cuts the same blocks. Ids come
back in the order of a block's sorted words, with a digest of these; should a block lack a word's ids, they are made there.

Text is cut at single spaces before the pattern runs: every match that holds a space between other characters starts
with it, so " word" splits alike wherever it stands. Where white space runs make that untrue, the whole text is split.
The public pattern is assumed by this shortcut only; with any other, a word is a match of the pattern.

Cases: a null or empty text has no tokens. Rows with equal texts or ids are encoded alike, each on its own row. An empty
table gives an empty result. Texts of any length are encoded whole, several to a block or one by itself. Columns with the
names that are added give way. Decoding null gives no bytes; an array with an id that no token has decodes to null.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lodestone.llm.common import column, give_back, load, runs, utf8

#: Bytes of documents in a block; bytes of the corpus for one bucket of words, and buckets at least.
BLOCK, BUCKET, BUCKETS = 8 << 20, 64 << 20, 64
#: From so many places on, a merge is applied to all of them by vector operations.
MANY = 40
#: Letters and digits of Unicode 17 and 18, which the pattern engine of tiktoken (Unicode 16) takes for
#: other characters.
NEWER = (
    "\u0558\u058b-\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce-\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1\uab6c-\uab6d\U000107bb-\U000107bf"
    "\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a\U00011db0-\U00011ddb\U00011de0-\U00011de9\U00011df1\U0001246f"
    "\U00012475-\U0001247f\U00012550-\U00012686\U00016ea0-\U00016eb8\U00016ebb-\U00016ed3\U00016ff2-\U00016ff6\U000187f8-\U000187ff"
    "\U00018cd6-\U00018cda\U00018d09-\U00018d20\U00018d80-\U00018df2\U00018e00-\U00019191\U000191a0-\U000191d2\U0001b123-\U0001b128\U0001b168"
    "\U0001d6a6\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff\U0001e6c0-\U0001e6de\U0001e6e0-\U0001e6e2"
    "\U0001e6e4-\U0001e6e5\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4\U0001e6fe-\U0001e6ff\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead"
    "\U000323b0-\U00033479\U0003d000-\U0003fc3f"
)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class MergeReplay:
    """Encodes sets of pieces by replaying the merges of a rank table over all of them at once."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        #: (left id << 20 | right id) -> rank of the merged token
        self.merge: dict[int, int] = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    self.merge[a << 20 | b] = rank
        self.single = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        self.codes = np.array(sorted(self.merge), np.int64)
        self.made = np.array([self.merge[c] for c in self.codes.tolist()], np.int64)
        #: Tokens that stand in a merge of lower rank than their own: making one can call for an earlier merge.
        early = (self.made < self.codes >> 20) | (self.made < self.codes & 0xFFFFF)
        self.early = set(np.concatenate([(self.codes >> 20)[early], (self.codes & 0xFFFFF)[early]]).tolist())
        self.text = {i: str(i) for i in ranks.values()}

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair's merge, or -1."""
        code = left << 20 | right
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where((self.codes[at] == code) & (left >= 0) & (right >= 0), self.made[at], -1)

    def _calls_earlier(self, rank: int, sym: np.ndarray, nxt: np.ndarray, prev: np.ndarray) -> bool:
        """Whether tokens of this rank, between such neighbours, make a merge of lower rank possible."""
        made = np.concatenate([self._rank(np.int64(rank), sym[nxt[nxt >= 0]]), self._rank(sym[prev[prev >= 0]], np.int64(rank))])
        return bool(((made >= 0) & (made < rank)).any())

    def encode(self, pieces: list[bytes]) -> list[str]:
        """Comma-joined ids of each piece: the whole piece's own id if it has one, else what the merges leave."""
        out = [str(self.ranks[p]) if p in self.ranks else "" for p in pieces]
        todo = [i for i, x in enumerate(out) if not x and pieces[i]]
        if not todo:
            return out
        ends = np.cumsum([len(pieces[i]) for i in todo])
        sym = self.single[np.frombuffer(b"".join(pieces[i] for i in todo), np.uint8)]
        self._replay(sym, ends)
        left = np.flatnonzero(sym >= 0)
        ids = list(map(self.text.__getitem__, sym[left].tolist()))
        at = 0
        for i, end in zip(todo, np.searchsorted(left, ends).tolist(), strict=True):
            out[i] = ",".join(ids[at:end])
            at = end
        return out

    def _replay(self, sym: np.ndarray, ends: np.ndarray) -> None:
        """Merge in place; a symbol taken into its left neighbour becomes -1."""
        n = len(sym)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[ends - 1] = -1
        before[ends[:-1]] = -1
        index: dict[int, list[np.ndarray | int]] = defaultdict(list)
        heap: list[int] = []

        def post(ranks: np.ndarray, places: np.ndarray) -> None:
            """Enter places into the index under their pairs' ranks (-1: no merge)."""
            some = np.flatnonzero(ranks >= 0)
            if not len(some):
                return
            some = some[np.argsort(ranks[some], kind="stable")]
            ranks, places = ranks[some], places[some]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            for r, part in zip(ranks[np.concatenate([[0], cuts])].tolist(), np.split(places, cuts), strict=True):
                if r not in index:
                    heapq.heappush(heap, r)
                index[r].append(part)

        start = np.flatnonzero(after >= 0)
        post(self._rank(sym[start], sym[start + 1]), start)
        s, nx, pv = memoryview(sym), memoryview(after), memoryview(before)
        merge = self.merge
        while heap:
            rank = heapq.heappop(heap)
            entries = index.pop(rank, None)
            if entries is None:
                continue
            size = sum(1 if isinstance(x, int) else len(x) for x in entries)
            if size >= MANY:
                i = np.unique(np.concatenate([[x] if isinstance(x, int) else x for x in entries]))
                j = after[i]
                ok = (j >= 0) & (sym[i] >= 0)
                i, j = i[ok], j[ok]
                ok = self._rank(sym[i], sym[j]) == rank
                i, j = i[ok], j[ok]
                chained = np.concatenate([[False], j[:-1] == i[1:]])
                if rank not in self.early or not (chained.any() or self._calls_earlier(rank, sym, after[j], before[i])):
                    if chained.any():  # of places that overlap, the first, third, ... merge
                        at = np.arange(len(i))
                        ok = (at - np.maximum.accumulate(np.where(chained, 0, at))) % 2 == 0
                        i, j = i[ok], j[ok]
                    sym[i], sym[j] = rank, -1
                    nxt = after[j]
                    after[i] = nxt
                    inner = nxt >= 0
                    before[nxt[inner]] = i[inner]
                    prev = before[i]
                    post(self._rank(sym[i[inner]], sym[nxt[inner]]), i[inner])
                    outer = prev >= 0
                    post(self._rank(sym[prev[outer]], sym[i[outer]]), prev[outer])
                    continue
            places = sorted({y for x in entries for y in ([x] if isinstance(x, int) else x.tolist())})
            for k, i in enumerate(places):
                j = nx[i]
                if j < 0 or s[i] < 0 or merge.get(s[i] << 20 | s[j]) != rank:
                    continue  # a neighbour has changed since this place was entered
                s[i], s[j] = rank, -1
                nx[i] = nxt = nx[j]
                least = rank
                if nxt >= 0:
                    pv[nxt] = i
                    if (r := merge.get(rank << 20 | s[nxt])) is not None:
                        if r not in index:
                            heapq.heappush(heap, r)
                        index[r].append(i)
                        least = min(least, r)
                if (p := pv[i]) >= 0 and (r := merge.get(s[p] << 20 | rank)) is not None:
                    if r not in index:
                        heapq.heappush(heap, r)
                    index[r].append(p)
                    least = min(least, r)
                if least < rank:  # an earlier merge has become possible: it comes first
                    if k + 1 < len(places):
                        if rank not in index:
                            heapq.heappush(heap, rank)
                        index[rank].extend(places[k + 1 :])
                    break


class Codec:
    """Cuts texts into words and encodes and decodes them; ids are kept as comma-joined decimals, the form that is hashed."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, shortcuts: bool = False):
        self.replay, self.pattern, self.shortcuts = MergeReplay(ranks), regex.compile(pattern), shortcuts
        self.newer = regex.compile(f"[{NEWER}]")
        self.token = {str(i): t for t, i in ranks.items()}
        white = [c for c in map(chr, range(0x3001)) if regex.match(r"\s", c)]
        self.runs = [c + " " for c in white]

    def words(self, text: str) -> list[str]:
        """Parts of a text of which each is encoded by itself; joined, they are what the pattern matches in it."""
        if not self.shortcuts or any(r in text for r in self.runs):
            return [x for x in self._findall(text) if x]
        first, *rest = text.split(" ")
        return [first] * bool(first) + [" " + x for x in rest]

    def pieces(self, word: str) -> list[str]:
        """What the pattern matches in a word."""
        if not self.shortcuts:
            return [word]
        bare = word[1:] if word[:1] == " " else word
        if bare.isalpha():
            return [word]
        if word[-1:] in (".", ",") and bare[:-1].isalpha():
            return [word[:-1], word[-1]]
        return self._findall(word)

    def _findall(self, text: str) -> list[str]:
        if not self.newer.search(text):
            return self.pattern.findall(text)
        # Stand-ins of the same length that the pattern takes for neither letter, digit nor white space.
        at, out = 0, []
        for x in self.pattern.findall(self.newer.sub("\uffff", text)):
            out.append(text[at : at + len(x)])
            at += len(x)
        return out

    def encode(self, words: list[str]) -> list[str]:
        """The ids of each word."""
        split = [self.pieces(w) for w in words]
        pieces = list({x for xs in split for x in xs})
        ids = dict(zip(pieces, self.replay.encode([x.encode() for x in pieces]), strict=True))
        return [ids[xs[0]] if len(xs) == 1 else ",".join([ids[x] for x in xs]) for xs in split]

    def decode(self, ids: str) -> bytes:
        return b"".join(map(self.token.__getitem__, ids.split(","))) if ids else b""


@lru_cache(1)
def _codec(name: str, pattern: str, shortcuts: bool) -> Codec:
    """One for each Python worker; the rank file comes with the job."""
    return Codec(read_ranks(SparkFiles.get(name)), pattern, shortcuts)


def _packed(part: list[pa.RecordBatch]) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, part[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        for batch in part:
            out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _pack_list(strings: list[str]) -> bytes:
    return zstandard.compress(json.dumps(strings, ensure_ascii=False, separators=(",", ":")).encode())


def _unpack_list(data: bytes) -> list[str]:
    return json.loads(zstandard.decompress(data))


def _digest(words: list[str]) -> bytes:
    return hashlib.blake2b(json.dumps(words).encode(), digest_size=16).digest()


def _by_bucket(words: Iterable[str], buckets: int) -> dict[int, list[str]]:
    """The distinct words, sorted, by the bucket that each hashes to."""
    lists: dict[int, list[str]] = defaultdict(list)
    for w in sorted(set(words)):
        lists[zlib.crc32(w.encode()) % buckets].append(w)
    return lists


def _blocks(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """The task's rows in numbered blocks of about BLOCK bytes of text."""
    number, part, size = TaskContext.get().partitionId() << 32, [], 0
    for batch in (whole.slice(a, b - a) for whole in batches for a, b in runs(utf8(column(whole, text))[1], BLOCK // 8)):
        part.append(batch)
        size += len(utf8(column(batch, text))[0])
        if size >= BLOCK or sum(map(len, part)) >= BLOCK // 64:
            yield number, part
            number, part, size = number + 1, [], 0
    if part:
        yield number, part


def _documents(docs: DataFrame, text: str) -> DataFrame:
    """(block, packed): the rows of `docs` in blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, part in _blocks(batches, text):
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([_packed(part)], pa.binary())], names=["block", "packed"])
        give_back()

    return docs.mapInArrow(run, "block long, packed binary")


def _words(docs: DataFrame, text: str, buckets: int, codec: Callable[[], Codec]) -> DataFrame:
    """(block, bucket, packed): the distinct words of each block by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = codec().words
        for number, part in _blocks(batches, text):
            lists = _by_bucket((w for batch in part for t in column(batch, text).to_pylist() if t for w in words(t)), buckets)
            packed = pa.array(map(_pack_list, lists.values()), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([number] * len(lists), pa.int64()), pa.array(list(lists), pa.int32()), packed], names=["block", "bucket", "packed"])
        give_back()

    return docs.select(text).mapInArrow(run, "block long, bucket int, packed binary")


def _replayed(lists: DataFrame, codec: Callable[[], Codec]) -> DataFrame:
    """(block, bucket, digest, ids): of each list the words' digest, and the ids of each word. A bucket's lists come one after another; each word is encoded once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, str] = {}
        last = None
        for batch in (whole.slice(a, 64) for whole in batches for a in range(0, len(whole), 64)):
            of = column(batch, "bucket").to_pylist()
            words = [_unpack_list(x) for x in column(batch, "packed").to_pylist()]
            ids = []
            for bucket in dict.fromkeys(of):
                if bucket != last:
                    known, last = {}, bucket
                mine = [w for w, x in zip(words, of, strict=True) if x == bucket]
                new = list({w for ws in mine for w in ws}.difference(known))
                known.update(zip(new, codec().encode(new), strict=True))
                ids.extend(_pack_list([known[w] for w in ws]) for ws in mine)
            cols = [column(batch, "block"), column(batch, "bucket"), pa.array(map(_digest, words), pa.binary()), pa.array(ids, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["block", "bucket", "digest", "ids"])
        give_back()

    return lists.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "block long, bucket int, digest binary, ids binary")


def encode(docs: DataFrame, ranks_path: str, pattern: str, ids: bool = True, shortcuts: bool = False, text: bool = True) -> DataFrame:
    """All columns of `docs` with n_tokens, ids_sha256 and decoded_sha256, and with `ids` the ids themselves.

    The digests take the names n_tokens, ids_sha256, decoded_sha256 and token_ids; columns of `docs` with such names
    give way. decoded_sha256 hashes the bytes that decoding the ids gives. `shortcuts` says that the pattern cuts words and
    white space as the public one does; without `text` the column text goes.
    """
    spark = docs.sparkSession
    spark.sparkContext.addFile(ranks_path)
    name = ranks_path.rstrip("/").rpartition("/")[2]
    codec = lambda: _codec(name, pattern, shortcuts)
    added = [("n_tokens", "long"), ("ids_sha256", "string"), ("decoded_sha256", "string"), *([("token_ids", "array<int>")] if ids else [])]
    own = [f for f in docs.schema if f.name not in {x for x, _ in added}]
    at = f"c{[f.name for f in own].index('text')}"
    renamed = docs.select(*[F.col(f"`{f.name}`").alias(f"c{i}") for i, f in enumerate(own)])
    size = renamed.agg(F.sum(F.octet_length(at))).first()[0] or 0
    buckets = max(BUCKETS, -(-size // BUCKET))
    coded = _replayed(_words(renamed, at, buckets, codec), codec)
    kept = [(f"c{i}", f) for i, f in enumerate(own) if text or f.name != "text"]

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for _, f in kept), *(f"{x} {k}" for x, k in added)])
    empty = to_arrow_schema(StructType.fromDDL(schema)).empty_table()

    def run(packed: pa.Table, found: pa.Table) -> pa.Table:
        if not len(packed):  # words of a task that was run again and cut other blocks
            return empty
        c, sha = codec(), lambda b: hashlib.sha256(b).hexdigest()
        rows = pa.concat_tables(pa.ipc.open_stream(x).read_all() for x in packed["packed"].to_pylist())
        known: dict[str, str] = {}
        cut = [c.words(t) if t else [] for t in rows[at].to_pylist()]
        lists = _by_bucket((w for ws in cut for w in ws), buckets)
        for bucket, digest, made in zip(*(found[x].to_pylist() for x in ("bucket", "digest", "ids")), strict=True):
            if _digest(lists[bucket]) == digest:
                known.update(zip(lists[bucket], _unpack_list(made), strict=True))
        lacking = [w for ws in lists.values() for w in ws if w not in known]
        known.update(zip(lacking, c.encode(lacking), strict=True))
        out = [",".join(map(known.__getitem__, ws)) for ws in cut]
        n = [x.count(",") + 1 if x else 0 for x in out]
        cols = [pa.array(n, pa.int64()), pa.array([sha(x.encode()) for x in out], pa.string()), pa.array([sha(c.decode(x)) for x in out], pa.string())]
        if ids:
            flat = np.concatenate([np.zeros(0, np.int32), *[np.fromstring(x, np.int32, sep=",") for x in out if x]])
            cols.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(flat)))
        return pa.Table.from_arrays([*[rows[x] for x, _ in kept], *cols], names=[*[f.name for _, f in kept], *[x for x, _ in added]])

    return _documents(renamed, at).groupBy("block").cogroup(coded.groupBy("block")).applyInArrow(run, schema)


def _joined(by_id: dict[int, bytes], ids: list[int]) -> bytes | None:
    """The tokens' bytes, or None where an id has no token."""
    found = [by_id.get(i) for i in ids]
    return None if None in found else b"".join(found)


def decode(tokens: DataFrame, ranks_path: str) -> DataFrame:
    """All columns of `tokens` with `decoded` (binary): the bytes of its token_ids (null: none)."""
    spark = tokens.sparkSession
    spark.sparkContext.addFile(ranks_path)
    name = ranks_path.rstrip("/").rpartition("/")[2]
    kept = tokens.drop("decoded")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_id = _tokens(name)
        for batch in batches:
            out = [_joined(by_id, x or []) for x in column(batch, "token_ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*batch.schema.names, "decoded"])

    return kept.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema), "decoded binary"]))


@lru_cache(1)
def _tokens(name: str) -> dict[int, bytes]:
    return {i: t for t, i in read_ranks(SparkFiles.get(name)).items()}


def public_ranks() -> tuple[str, str]:
    """The rank file and split pattern that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(load(spark, sf_dir, "documents").select("doc_id", "text"), *public_ranks(), ids=False, shortcuts=True, text=False)
