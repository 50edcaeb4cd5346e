"""Packing documents into sequences of a fixed length, by minimum bin slack.

1. Each task turns texts into token ids, ends them with a mark and cuts what is longer than a sequence. A piece's ids are
   kept as a checksum (or whole), so narrow rows move.
2. Pieces are counted by length: at most `room` numbers, whatever the corpus's size. Bin after bin, the longest piece left
   is put in, and a subset-sum program over the lengths left, held as the bits of one number, finds the combination that
   fills the bin most. It is removed; as long as every length of it is there, the next bin's fullest combination is the
   same, so it is removed as often as the counts allow. A length runs out each time: steps follow the lengths, not the rows.
3. Pieces are numbered within their length, and take the places of the combinations in this order. A length's pieces are
   numbered in about sqrt(n) buckets with running offsets, so that a length of a third of all pieces is no single task's.

The result is a heuristic's; on the tables of the tests it meets the bound of total length / room, rounded up.

Cases: a null or empty text is the end mark alone. Repeated rows and ids are pieces of their own; where rows are equal in
all columns it doesn't matter which takes which place. An empty table gives no rows. Texts of any length are encoded whole
and cut. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lodestone.llm.common import column, give_back, load, utf8
from lodestone.storage import materialize

#: Words whose ids a worker keeps (twice), and bytes of the longest one kept.
KEPT, LONG = 400_000, 64
#: The normalizer and split of the word vocabulary whose words may be encoded one by one.
NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Words that the split leaves whole, but for a last mark: Latin letters that are composed and lower case has one letter for.
PLAIN = re.compile("([a-zß-öø-ÿ]+)([.,;:!?]?)").fullmatch


class _Words(dict):
    """The ids of a word as bytes, encoded when first met. Words not met for a while go."""

    def __init__(self, tokenizer):
        super().__init__()
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer, self.old = tokenizer, {}
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        self.written = {ord(c): level.pre_tokenize_str(c)[0][0] for c in map(chr, range(0xDF, 0x100)) if c != "÷"}

    def __missing__(self, word: bytes) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            text = word.decode("utf-8", "replace")
            if len(word) <= LONG and (plain := PLAIN(text.lower())):
                parts = [plain[1].translate(self.written), *plain[2]]
                ids = array("I", [t.id for p in parts for t in self.tokenizer.model.tokenize(p)]).tobytes()
            else:
                ids = array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        if len(word) <= LONG:
            if len(self) >= KEPT:
                self.old = dict(self)
                self.clear()
            self[word] = ids
        return ids


@lru_cache(maxsize=2)
def _encoder(blob: str):
    """A function from a text's UTF-8 bytes to its ids as bytes (unsigned, 32 bits, little-endian).

    White space separates the words of the vocabulary named above, so that a text's ids are those of its words. Any other
    tokenizer encodes whole texts.
    """
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks share the cores
    from tokenizers import Tokenizer

    spec, tokenizer = json.loads(blob), Tokenizer.from_str(blob)
    first = ((spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
    apart = (spec.get("normalizer") or {}).get("normalizers") == NORMAL and (first.get("pattern") or {}).get("Regex") == SPLIT and first.get("behavior") == "Removed" and first.get("invert") is True
    apart = apart and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] or t["content"].split() != [t["content"]] for t in spec.get("added_tokens", []))
    apart = apart and spec.get("post_processor") is None and spec["model"].get("dropout") is None and spec.get("truncation") is None and spec.get("padding") is None
    if not apart:
        return lambda raw: array("I", tokenizer.encode(raw.decode("utf-8", "replace"), add_special_tokens=False).ids).tobytes()
    ids = _Words(tokenizer)
    return lambda raw: b"".join([ids[w] for w in raw.split()])  # bytes split at ASCII white space


def pieces(docs: DataFrame, tokenizer: str, room: int = 4096, end: int = 1, ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and token_ids): each document's tokens and end mark, cut to `room`.

    tokenizer: the JSON text of a `tokenizers` file.
    """
    if room < 1:
        raise ValueError("room must be positive")
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    more = StructType.fromDDL("piece int, start long, length long, ids_crc32 long" + ", token_ids array<int>" * ids)
    out = StructType([rows.schema["doc_id"], *more.fields])
    arrow = to_arrow_schema(out)
    blob, mark = spark.sparkContext.broadcast(tokenizer), array("I", [end]).tobytes()

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(blob.value)
        for batch in batches:
            raw, at = utf8(column(batch, "text"))
            raw, at = raw.tobytes(), at.tolist()
            of, piece, start, length, crc, whole = [], [], [], [], [], []
            for i in range(batch.num_rows):
                got = encode(raw[at[i] : at[i + 1]]) + mark
                for k, a in enumerate(range(0, len(got), 4 * room)):
                    part = got[a : a + 4 * room]
                    of.append(i)
                    piece.append(k)
                    start.append(a // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if ids:
                        whole.append(np.frombuffer(part, np.uint32))
            made = [column(batch, "doc_id").take(pa.array(of, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(v, pa.int64()) for v in (start, length, crc))]
            yield pa.RecordBatch.from_arrays(made + ([pa.array(whole, pa.list_(pa.int32()))] if ids else []), schema=arrow)
        give_back()

    return rows.mapInArrow(cut, out)


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """Of the lengths available, so many of each, the combination with the greatest sum up to `room`."""
    reach, layers, mask = 1, [], (1 << (room + 1)) - 1
    for length in sorted((n for n, c in counts.items() if c > 0 and n <= room), reverse=True):
        left, k = min(counts[length], room // length), 1
        while left > 0:
            k = min(k, left)
            layers.append((length, k, reach))
            reach |= (reach << (length * k)) & mask
            left, k = left - k, 2 * k
        if reach >> room & 1:
            break
    total, taken = reach.bit_length() - 1, {}
    for length, k, before in reversed(layers):
        if not before >> total & 1:
            total -= length * k
            taken[length] = taken.get(length, 0) + k
    return taken


def combinations(counts: dict[int, int], room: int) -> list[tuple[dict[int, int], int]]:
    """Bins by minimum slack: (pieces of each length, number of bins filled so)."""
    left, out = {n: c for n, c in counts.items() if c}, []
    while left:
        top = max(left)
        left[top] -= 1
        taken = fullest(left, room - top)
        left[top] += 1
        taken[top] = taken.get(top, 0) + 1
        bins = min(left[n] // k for n, k in taken.items())
        out.append((taken, bins))
        for n, k in taken.items():
            left[n] -= k * bins
            if not left[n]:
                del left[n]
    return out


def _runs(counts: dict[int, int], room: int) -> np.ndarray:
    """For ranks of a length from `first` on: (length, first, copies in a bin, number of the first bin, offset of the first copy)."""
    used, bins, out = dict.fromkeys(counts, 0), 0, []
    for taken, n in combinations(counts, room):
        at = 0
        for length, k in sorted(taken.items(), reverse=True):
            out.append((length, used[length], k, bins, at))
            used[length] += k * n
            at += length * k
        bins += n
    return np.array(sorted(out), np.int64).reshape(-1, 5)


def pack(parts: DataFrame, room: int = 4096) -> DataFrame:
    """`parts` (a table with `length` from 1 to `room`, read from files) with sequence_id and offset."""
    spark, own = parts.sparkSession, parts.columns
    counts = {r.length: r.n for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `room` rows
    if counts and not 1 <= min(counts) <= max(counts) <= room:
        raise ValueError("lengths must be from 1 to room")
    runs = spark.sparkContext.broadcast(_runs(counts, room))
    buckets = spark.createDataFrame([(n, int(c**0.5) + 1) for n, c in counts.items()], "length long, _buckets int")
    keys = [c for c in own if c != "token_ids"]
    put = parts.join(F.broadcast(buckets), "length").withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.col("_buckets"))).drop("_buckets")
    upto = W.partitionBy("length").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)  # about sqrt(n) rows
    starts = put.groupBy("length", "_bucket").agg(F.count("*").alias("n")).select("length", "_bucket", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("_at"))
    number = F.row_number().over(W.partitionBy("length", "_bucket").orderBy(*[F.col(c).asc_nulls_first() for c in keys])) - 1
    ranked = put.withColumn("_n", number).join(starts, ["length", "_bucket"]).select(*own, (F.col("_n") + F.col("_at")).alias("_rank"))
    out = StructType([*parts.schema.fields]).add("sequence_id", "long").add("offset", "long")
    arrow = to_arrow_schema(out)

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length_of, first, copies, bins, offset = runs.value.T
        lengths, begins = np.unique(length_of, return_index=True)
        ends = np.append(begins[1:], len(length_of))
        for batch in batches:
            n, rank = (column(batch, c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "_rank"))
            run = np.zeros(len(n), np.int64)
            for value in np.unique(n):
                at = np.searchsorted(lengths, value)
                rows = n == value
                run[rows] = begins[at] + np.searchsorted(first[begins[at] : ends[at]], rank[rows], "right") - 1
            bin_no, copy = np.divmod(rank - first[run], copies[run])
            made = [pa.array(bins[run] + bin_no), pa.array(offset[run] + copy * n)]
            yield pa.RecordBatch.from_arrays([column(batch, c).cast(arrow.field(c).type) for c in own] + made, schema=arrow)

    return ranked.mapInArrow(place, out)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, length, token_ids, doc_ids and starts of the pieces, from packed pieces with `token_ids`; at most `room` tokens each."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "token_ids")))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), parts.alias("_p")).select(
        "sequence_id", "length", F.flatten("_p.token_ids").alias("token_ids"), F.col("_p.doc_id").alias("doc_ids"), F.col("_p.offset").alias("starts")
    )


def pack_documents(docs: DataFrame, tokenizer: str, room: int = 4096, end: int = 1, ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset (and token_ids)."""
    return pack(materialize(pieces(docs, tokenizer, room, end, ids), "pieces"), room)


def public_words() -> str:
    """The JSON text of the public word vocabulary."""
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        return f.read()


def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(load(spark, sf_dir, "documents"), public_words())
