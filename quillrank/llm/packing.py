"""Packing by power-of-two decomposition.

A document's ids are cut into pieces whose lengths are powers of two, the longest first: as many of
``capacity`` as fit, then one for each set bit of the rest. A piece is a sequence by itself, so no
sequence holds two documents and none needs padding; sequences of one length form a bucket, from
which batches of a constant number of ids are drawn.

Edge cases: a null or empty text is the closing id alone (one piece of 1); repeated rows are packed
once for each row; a null doc_id is kept; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import os
import re
import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillrank.llm.common import Recent, claim, coded_words, steps, tidy
from quillrank.shipping import ship

CAPACITY = 4096
#: Bytes that each generation of a worker's two memories (words, runs of one kind) holds; bytes of text that one step encodes.
MEMORY, STEP = 12 << 20, 2 << 20
#: What any word may hold of which the tokenizer's normal form and pattern are plain: printable ASCII and the letters of Latin-1.
_PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
#: The tokenizer's pattern for such words in lower case.
_RUNS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")
_CACHE: dict[tuple, "WordIds"] = {}
assert sys.byteorder == "little" and array("I").itemsize == 4


def _byte_level() -> dict[int, str]:
    """How a byte-level model spells the Latin-1 letters: bytes that print stand for themselves, the others for code points from 256 on, in order."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    odd = [b for b in range(256) if b not in prints]
    spelt = {b: chr(b) for b in prints} | {b: chr(256 + i) for i, b in enumerate(odd)}
    return {c: "".join(spelt[b] for b in chr(c).encode()) for c in range(0xC0, 0x100)}


class WordIds:
    """Ids of whole texts by a tokenizer that drops white space, lowers case, parts letters, digits and signs and spells runs of them in bytes.

    A step's distinct words between ASCII white space are encoded each once: no normal form and no pattern reaches across
    a space. A plain word is parted into its runs, and each distinct run goes to the tokenizer's model; any other word
    goes to the tokenizer as it is. Ids of the texts are gathered from the words' by their places.
    """

    def __init__(self, path: str, closing: int):
        from tokenizers import Tokenizer

        self.tokenizer, self.closing = Tokenizer.from_file(path), np.array([closing], "<u4").tobytes()
        self.words, self.runs, self.spelt = Recent(MEMORY), Recent(MEMORY), _byte_level()

    def forget(self) -> None:
        self.words.forget()
        self.runs.forget()

    def _plain(self, words: list[str]) -> list[bytes]:
        parted = list(map(_RUNS.findall, words))
        model, spelt = self.tokenizer.model, self.spelt
        new = self.runs.missing(list({r for runs in parted for r in runs}))
        self.runs.put(new, [array("I", [t.id for t in model.tokenize(r if r.isascii() else r.translate(spelt))]).tobytes() for r in new])
        known = self.runs.young
        return [known[runs[0]] if len(runs) == 1 else b"".join([known[r] for r in runs]) for runs in parted]

    def learn(self, words: list[bytes]) -> dict[bytes, bytes]:
        plain, other, texts = [], [], []
        for w in self.words.missing(words):
            t = w.decode("utf-8", "replace")
            if _PLAIN.fullmatch(t) and "<|" not in t:
                plain.append(w)
                texts.append(t.lower())
            else:
                other.append(w)
        for k in range(0, len(plain), 1 << 16):
            self.words.put(plain[k : k + (1 << 16)], self._plain(texts[k : k + (1 << 16)]))
        for k in range(0, len(other), 4096):
            part = other[k : k + 4096]
            found = self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in part], add_special_tokens=False)
            self.words.put(part, [array("I", e.ids).tobytes() for e in found])
        return self.words.young

    def raw(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, the closing one last in each, and how many each has."""
        words, index, count = coded_words(texts, unless="<|")  # special tokens are found before letters are made lower
        known = self.learn(words)
        parts = [known[w] for w in words] + [self.closing]
        size = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        index = np.insert(index, np.cumsum(count), len(words))
        each = size[index]
        ends = np.cumsum(each)
        first = (np.cumsum(size) - size)[index]
        ids = np.frombuffer(b"".join(parts), "<u4")[np.repeat(first - (ends - each), each) + np.arange(ends[-1] if len(ends) else 0)]
        last = ends[np.cumsum(count + 1) - 1]
        return ids, np.diff(last, prepend=0)


def lengths(total: int, capacity: int = CAPACITY) -> list[int]:
    """The binary pieces of a document of so many ids, longest first."""
    rest = total % capacity
    return [capacity] * (total // capacity) + [1 << b for b in range(capacity.bit_length() - 1, -1, -1) if rest >> b & 1]


def _encoder(path: str, closing: int) -> WordIds:
    if (path, closing) not in _CACHE:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _CACHE[path, closing] = WordIds(path, closing)
    return _CACHE[path, closing]


def pack(docs: DataFrame, tokenizer_path: str, closing_id: int = 2, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, bucket (log2 of the length), sequence_id, offset; and the ids, if asked for.

    No shuffle: a piece needs nothing but its own document. sequence_id is unique, and stays so when a lost partition is computed again, since it is made of the partition and the row in it.
    """
    if capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())]
    schema = pa.schema(fields + [("ids", pa.list_(pa.int32()))] * with_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("packing", _CACHE.clear)
        encoder = _encoder(tokenizer_path, closing_id)
        for batch in batches:
            for part in steps(batch, size_bytes=STEP):
                ids, totals = encoder.raw(part.column("text"))
                raw, at = memoryview(ids.tobytes()), 0
                rows: list[list] = [[] for _ in schema]
                for doc_id, total in zip(part.column("doc_id").to_pylist(), totals.tolist(), strict=True):
                    start = 0
                    for n in lengths(total, capacity):
                        piece = raw[4 * at : 4 * (at + n)]
                        for column, value in zip(rows, (doc_id, start, n, zlib.crc32(piece), total, np.frombuffer(piece, "<i4") if with_ids else None), strict=False):
                            column.append(value)
                        start += n
                        at += n
                yield pa.record_batch([pa.array(c, t.type) for c, t in zip(rows, schema, strict=True)], schema=schema)
        encoder.forget()

    ship(docs.sparkSession)
    kind = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids
    pieces = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(run), kind)
    return pieces.withColumns({"bucket": F.round(F.log2("length")).cast("int"), "sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})


def batches(pieces: DataFrame, ids_per_batch: int = 8 * CAPACITY) -> DataFrame:
    """Numbers batches of a constant number of ids within each bucket and input partition: columns of pieces and batch (text ``bucket-partition-number``).

    A bucket never meets in one task: rows are counted where they lie, by partition, so a last batch of each may be short.
    """
    from pyspark.sql import Window

    part = F.shiftright("sequence_id", 33)
    row = F.row_number().over(Window.partitionBy(part, "bucket").orderBy("sequence_id")) - 1
    return pieces.withColumn("batch", F.format_string("%d-%d-%d", "bucket", part, F.floor(row * F.col("length") / ids_per_batch)))
