"""Packing of tokenised documents into sequences of a fixed length, planned on a histogram.

Best-fit decreasing runs over the counts of piece lengths, at most `window` of them,
and gives runs of equal slots; pieces then take the slots of their length by their
rank within it. Documents themselves are never brought together.
"""

from __future__ import annotations

import re
from array import array
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorequery.llm.common import durable, slices

WINDOW = 1024
END = 2
#: Chunks whose ids a task remembers; rows of one length that one task ranks, about.
CACHE, RANKED = 300_000, 250_000


class ByteBpe:
    """Ids of whole texts as little-endian unsigned 32-bit bytes, by a byte-level BPE of the tokenizers library.

    A text without odd white space is the concatenation of its chunks " word", so the
    ids of chunks seen before are reused. Chunks of common letters go through the same
    vocabulary's rank file, others and odd texts through the library itself.
    """

    def __init__(self, vocabulary: str, ranks: str | None):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(vocabulary)
        self.special = {t.content for t in self.library.get_added_tokens_decoder().values()}
        self.fast = None
        if ranks:
            import base64

            import public_tokenizers
            import tiktoken

            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks, "rb"))}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
        self.common = re.compile(r"[\x00-\x1b\x20-\x84\x86-\x9f\xa1-ɏ]*").fullmatch
        self.first, self.later = Known(self, ""), Known(self, " ")

    def whole(self, text: str) -> bytes:
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def chunk(self, chunk: str) -> bytes | None:
        """None: white space at an end, so that its ids depend on what stands beside it."""
        word = chunk[1:] if chunk[:1] == " " else chunk
        if not word or word[0].isspace() or word[-1].isspace():
            return None
        if self.fast and self.common(chunk):
            return array("I", self.fast.encode_ordinary(chunk)).tobytes()
        return self.whole(chunk)

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if any(s in text for s in self.special):
            return self.whole(text)
        first, *rest = text.split(" ")
        self.first.tidy(())
        self.later.tidy(rest)
        out = list(map(self.later.__getitem__, rest))
        if first:
            out.insert(0, self.first[first])
        return self.whole(text) if None in out else b"".join(out)


class Known(dict):
    """Ids of chunks with what stands before them, made when first asked for."""

    def __init__(self, coder: ByteBpe, before: str):
        self.coder, self.before = coder, before

    def __missing__(self, chunk: str) -> bytes | None:
        ids = self.coder.chunk(self.before + chunk)
        if len(chunk) < 100:
            self[chunk] = ids
        return ids

    def tidy(self, used) -> None:
        """When full, keep what the text at hand uses: frequent chunks are among it."""
        if len(self) > CACHE:
            kept = {c: self[c] for c in used if c in self}
            self.clear()
            self.update(kept)


def pieces(docs: DataFrame, vocabulary: str, ranks: str | None = None, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end: int = END) -> DataFrame:
    """(id, piece, start, length, ids_crc32): the ids of each text and `end`, cut into pieces.

    Only documents longer than the window are cut; all pieces but the first are full.
    """
    schema = f"{docs.select(F.col(id_col)).schema[0].dataType.simpleString()}"

    def run(batches):
        coder = ByteBpe(vocabulary, ranks)
        tail = int(end).to_bytes(4, "little")
        kind = None
        for part in slices(batches, "__text"):
            kind = part.schema.field(0).type
            rows = [], [], [], [], []
            for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                ids = coder.encode(text or "") + tail
                total = len(ids) // 4
                first = (total - 1) % window + 1
                for k, begin in enumerate([0, *range(first, total, window)]):
                    size = first if k == 0 else window
                    for column, value in zip(rows, (key, k, begin, size, crc32(ids[4 * begin : 4 * (begin + size)]))):
                        column.append(value)
            kinds = [kind, pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(rows, kinds)], names=["id", "piece", "start", "length", "ids_crc32"])

    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("__text")).mapInArrow(run, f"id {schema}, piece int, start long, length long, ids_crc32 long")
    return out.withColumnRenamed("id", id_col)


def plan(counts: dict[int, int], window: int = WINDOW) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over counts: runs (length, first rank, count, first sequence, offset).

    The pieces of a length with ranks first .. first + count - 1 take one sequence each,
    consecutive from first sequence, at the offset. Work and size depend on the number
    of different lengths, not on the number of pieces.
    """
    room: dict[int, list[tuple[int, int]]] = {}  # free tokens: (first sequence, count) of each class
    runs, made = [], 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            best = min((free for free in room if free >= length), default=None)
            if best is None:
                first, count, best = made, min(left, -(-left // (window // length))), window
                made += count
            else:
                first, count = room[best].pop()
                if count > left:
                    room[best].append((first + left, count - left))
                    count = left
                if not room[best]:
                    del room[best]
            runs.append((length, rank, count, first, window - best))
            if best > length:
                room.setdefault(best - length, []).append((first, count))
            rank, left = rank + count, left - count
    return runs


def pack(cut: DataFrame, window: int = WINDOW, id_col: str = "doc_id") -> DataFrame:
    """cut with sequence_id and offset: the pieces packed by the plan of their length histogram.

    cut: as pieces() gives it. Pieces of one length are ranked in salted buckets whose
    offsets come from their counts, so a length that many share loads no single task.
    """
    cut = durable(cut)
    histogram = {int(r["length"]): int(r["n"]) for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `window` rows
    runs = sorted(plan(histogram, window))
    spark = cut.sparkSession
    table = spark.sparkContext.broadcast(np.array(runs, dtype=np.int64).reshape(-1, 5))
    salt = max(8, -(-max(histogram.values(), default=0) // RANKED))
    dealt = cut.withColumn("bucket", F.pmod(F.xxhash64(id_col, "piece"), F.lit(salt)))
    sizes = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = sizes.select("length", "bucket", (F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("before"))
    ranked = dealt.withColumn("own", F.row_number().over(Window.partitionBy("length", "bucket").orderBy(id_col, "piece")))
    ranked = ranked.join(before, ["length", "bucket"]).select(*cut.columns, (F.col("before") + F.col("own") - 1).alias("rank"))

    own = cut.columns

    def place(batches):
        runs = table.value
        step = 1 << 40  # over any rank: a length and a rank make one sortable number
        keys = runs[:, 0] * step + runs[:, 1]
        for batch in batches:
            names = batch.schema.names
            length, rank = (batch.column(names.index(c)).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            at = np.searchsorted(keys, length * step + rank, side="right") - 1
            arrays = [batch.column(names.index(c)) for c in own] + [pa.array(runs[at, 3] + rank - runs[at, 1]), pa.array(runs[at, 4])]
            yield pa.RecordBatch.from_arrays(arrays, names=[*own, "sequence_id", "offset"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema)
    return ranked.mapInArrow(place, f"{kinds}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, vocabulary: str, ranks: str | None = None, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end: int = END) -> DataFrame:
    """One row a piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are the single id `end`. Repeated rows are packed each; a null
    id is carried along. Empty input gives no rows; other columns are ignored.
    """
    return pack(pieces(docs, vocabulary, ranks, id_col, text_col, window, end), window, id_col)
