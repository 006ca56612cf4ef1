"""Encoding and decoding with merge-type subword vocabularies, in Arrow batches.

A text becomes symbols (its characters, a space written as the marker U+2581, one marker in front). An agenda holds each
adjacent pair whose joined form is in the vocabulary, the highest score first, of equal ones the leftmost; the first
entry is merged and its new neighbours go on the agenda, until it is empty. A symbol that the vocabulary lacks becomes its
bytes. No merge crosses a place where the vocabulary holds no piece with those two characters side by side, so texts are
cut there first. Short runs of one length keep their agendas as the rows of one matrix, of which each round takes every
row's first entry; a long run has a heap of its own. A step's distinct words are merged each once and remembered, and a
text's ids are gathered from its words'.

Each word met for the first time is also encoded by the sentencepiece library, and a difference raises: what the agenda
gives is what the library gives. Ids are turned back into text by the library's decode.

Edge cases: a null text is encoded as an empty one; an empty text has no ids; repeated rows are encoded once for each row;
a null doc_id is kept; a long text is a step of its own and is decoded in slices; other columns are ignored, whatever
their names; an empty table gives an empty result. Models other than merge-type ones with byte fallback and without a
normal form of their own are refused.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain
from operator import add

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillrank.llm.common import Recent, claim, steps, tidy
from quillrank.shipping import ship

#: The marker that stands for a space.
MARK = "▁"
#: Bytes that each generation of a worker's memory of words holds, bytes of text in one step, words merged and ids decoded by the library at a time.
MEMORY, STEP, WORDS, SLICE = 48 << 20, 2 << 20, 1 << 15, 1 << 16
#: Runs of more characters than this have a heap each.
LONG = 40
#: No entry on the agenda.
NONE = np.int32(2**31 - 1)
_CACHE: dict[str, "Pieces"] = {}


class Pieces:
    """A vocabulary with scores, and what follows from it: where texts can be cut, what two symbols merge to, ids of single characters and bytes."""

    def __init__(self, path: str):
        import sentencepiece as spm
        from sentencepiece import sentencepiece_model_pb2 as model_pb2

        with open(path, "rb") as f:
            raw = f.read()
        proto = model_pb2.ModelProto()
        proto.ParseFromString(raw)
        trained, normal = proto.trainer_spec, proto.normalizer_spec
        if trained.model_type != trained.BPE or not trained.byte_fallback or trained.treat_whitespace_as_suffix:
            raise ValueError("a merge-type vocabulary with byte fallback is needed")
        if normal.precompiled_charsmap or normal.remove_extra_whitespaces or not normal.add_dummy_prefix or not normal.escape_whitespaces:
            raise ValueError("the vocabulary has a normal form that this encoder doesn't make")
        kind = model_pb2.ModelProto.SentencePiece
        if any(p.type in (kind.USER_DEFINED, kind.UNUSED) for p in proto.pieces):
            raise ValueError("pieces that are set by users or unused aren't handled")
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == kind.NORMAL}
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == kind.BYTE}
        self.starts = np.array([p.piece.startswith(MARK) and p.type == kind.NORMAL for p in proto.pieces])
        by_score = {x: k for k, x in enumerate(sorted({p.score for p in proto.pieces}, reverse=True))}
        #: Place of a piece in the order of scores, the highest first; equal scores share a place.
        self.order = {p.piece: by_score[p.score] for p in proto.pieces if p.type == kind.NORMAL}
        pairs = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        chars = sorted({c for pair in pairs for c in pair} | {MARK})
        if any(pair[1] == MARK != pair[0] for pair in pairs):
            raise ValueError("pieces that hold a marker after other characters aren't handled")
        if "\n" in chars or any(c not in self.ids or ord(c) > 0xFFFF for c in chars):
            raise ValueError("pieces that hold newlines, or characters that the vocabulary lacks, aren't handled")
        self.kind = np.zeros(0x10000, np.int32)  # 1 and on: characters that may merge
        self.kind[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.symbol = np.array([-1] + [self.ids[c] for c in chars], np.int64)
        self.beside = np.zeros((len(chars) + 1, len(chars) + 1), bool)
        for a, b in pairs:
            self.beside[self.kind[ord(a)], self.kind[ord(b)]] = True
        joins = {(self.ids[p[:k]] << 20) | self.ids[p[k:]]: p for p in self.ids for k in range(1, len(p)) if p[:k] in self.ids and p[k:] in self.ids}
        self._table(np.array(list(joins), np.int64), np.array([self.ids[p] for p in joins.values()], np.int32))
        self.place = np.full(len(proto.pieces), NONE, np.int32)
        for p, i in self.ids.items():
            self.place[i] = self.order[p]
        within = "[" + "".join(re.escape(c) for c in chars if c != MARK) + "]"
        #: Parts of a text with markers, between which nothing merges: markers with what follows, runs of characters that merge, single ones that never do.
        self.part = re.compile(f"{MARK}+{within}*|{within}+|.", re.DOTALL)
        self.library = spm.SentencePieceProcessor(model_proto=raw)
        self.known = Recent(MEMORY)

    def _table(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Open addressing over the pairs of symbols that merge."""
        size = 1 << (4 * len(keys)).bit_length()
        self.shift = np.uint64(64 - (size.bit_length() - 1))
        self.slots, self.found = np.full(size, -1, np.int64), np.full(size, -1, np.int32)
        left, at = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.slots[at] < 0
            self.slots[at[free]] = keys[left[free]]  # of several, the last stays
            won = self.slots[at] == keys[left]
            self.found[at[won]] = values[left[won]]
            left, at = left[~won], (at[~won] + 1) & (size - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def joined(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """What two symbols merge to, -1 for none."""
        keys = (left.astype(np.int64) << 20) | right
        at = self._slot(keys)
        held = self.slots[at]
        out = np.where(held == keys, self.found[at], np.int32(-1))
        open_ = np.flatnonzero((held != keys) & (held >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & (len(self.slots) - 1)
            held = self.slots[at[open_]]
            hit = held == keys[open_]
            out[open_[hit]] = self.found[at[open_[hit]]]
            open_ = open_[~hit & (held >= 0)]
        return out

    def forget(self) -> None:
        self.known.forget()

    def merged(self, text: str) -> list[str]:
        """The symbols that are left when the agenda of adjacent pairs, a heap, is empty. An entry is a number: the place of the joined piece in the order of scores, then that of its left symbol."""
        symbols = list(text)
        order = self.order
        agenda = [order[both] << 32 | k for k, both in enumerate(map(add, symbols, symbols[1:])) if both in order]
        n = len(symbols)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heapify(agenda)
        while agenda:
            entry = heappop(agenda)
            k = entry & 0xFFFFFFFF
            left, other = symbols[k], after[k]
            if not left or other >= n:
                continue
            both = left + symbols[other]
            if order.get(both) != entry >> 32:  # one of the two has merged since
                continue
            symbols[k], symbols[other] = both, ""
            after[k] = right = after[other]
            if right < n:
                before[right] = k
                found = order.get(both + symbols[right])
                if found is not None:
                    heappush(agenda, found << 32 | k)
            if k:
                found = order.get(symbols[before[k]] + both)
                if found is not None:
                    heappush(agenda, found << 32 | before[k])
        return list(filter(None, symbols))

    def merged_rows(self, symbols: np.ndarray) -> np.ndarray:
        """The same for rows of as many symbols: each round merges every row's first entry. What is left of a row stands in front, -1 behind it."""
        rows, width = symbols.shape
        out = np.full((rows, width), -1, np.int64)
        which = np.arange(rows)
        made = self.joined(symbols[:, :-1].ravel(), symbols[:, 1:].ravel()).reshape(rows, width - 1)
        agenda = np.where(made >= 0, self.place[made], NONE)
        while len(which):
            first = agenda.argmin(axis=1)
            row = np.arange(len(which))
            live = agenda[row, first] < NONE
            if not live.all():
                done = ~live
                out[which[done], : symbols.shape[1]] = symbols[done]
                which, symbols, made, agenda, first = which[live], symbols[live], made[live], agenda[live], first[live]
                row = np.arange(len(which))
                if not len(which):
                    break
            new = made[row, first]
            n = symbols.shape[1]
            if n == 2:
                out[which, 0] = new
                break
            # the right one of the two goes, and the pair with it
            symbols = np.take_along_axis(symbols, np.arange(n - 1) + (np.arange(n - 1) > first[:, None]), axis=1)
            symbols[row, first] = new
            shift = np.arange(n - 2) + (np.arange(n - 2) >= first[:, None])
            made, agenda = np.take_along_axis(made, shift, axis=1), np.take_along_axis(agenda, shift, axis=1)
            for at, has in ((first - 1, first > 0), (first, first < n - 2)):
                r, k = row[has], at[has]
                found = self.joined(symbols[r, k], symbols[r, k + 1])
                made[r, k], agenda[r, k] = found, np.where(found >= 0, self.place[found], NONE)
        return out

    def merge_all(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all parts one after another, and how many each has. Nothing merges from one part to the next."""
        text = "".join(parts)
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        size = np.fromiter(map(len, parts), np.int64, len(parts))
        kind = np.where(codes < 0x10000, self.kind[np.minimum(codes, 0xFFFF)], 0)
        cut = np.ones(len(codes) + 1, bool)
        cut[1:-1] = ~self.beside[kind[:-1], kind[1:]]
        cut[np.cumsum(size)] = True
        start = np.flatnonzero(cut)
        length, start = np.diff(start), start[:-1]
        # up to four ids for each character: bytes of one that the vocabulary lacks
        ids = np.full((len(codes), 4), -1, np.int64)
        ids[:, 0] = self.symbol[kind]
        for c in np.unique(codes[kind == 0]).tolist():
            own = self.ids.get(chr(c))
            spelt = [own] if own is not None else [self.bytes[b] for b in chr(c).encode("utf-8", "replace")]
            ids[codes == c, : len(spelt)] = spelt
        for n in np.unique(length).tolist():
            at = start[length == n]
            if n == 1:
                continue
            if n > LONG:
                for k in at.tolist():
                    found = [self.ids[x] for x in self.merged(text[k : k + n])]
                    ids[k : k + n, 0] = found + [-1] * (n - len(found))
                continue
            place = at[:, None] + np.arange(n)
            ids[place, 0] = self.merged_rows(ids[place, 0])
        used = ids >= 0
        many = np.concatenate([[0], np.cumsum(used.sum(axis=1))])
        ends = np.cumsum(size)
        return ids[used].astype("<i4"), many[ends] - many[ends - size]

    def learn(self, words: list[bytes], lead: bool) -> dict[bytes, bytes]:
        """Merges the words that aren't remembered, and holds them against the library. lead: a marker stands before each word; if not, they are parts of texts behind one byte that no text has, so that the two are remembered apart."""
        new = self.known.missing(words)
        for k in range(0, len(new), WORDS):
            part = new[k : k + WORDS]
            texts = [w.decode("utf-8") if lead else w[1:].decode("utf-8") for w in part]
            # the library puts a marker in front, and a newline never merges: behind the marker it keeps a part without one apart
            asked = self.library.encode(["\n" + t if not lead and t[0] != MARK else (t if lead else t[1:]).replace(MARK, " ") + "\n" for t in texts], num_threads=1)
            frame = self.library.encode("\n")
            theirs = [x[len(frame) :] if not lead and t[0] != MARK else x[: 1 - len(frame)] for t, x in zip(texts, asked, strict=True)]
            ids, count = self.merge_all([MARK + t.replace(" ", MARK) for t in texts] if lead else texts)
            same = np.fromiter(map(len, theirs), np.int64, len(theirs)) == count
            if not same.all() or not np.array_equal(ids, np.fromiter(chain.from_iterable(theirs), np.int64, len(ids))):
                raise ValueError(f"the agenda and the library differ on one of {texts}")
            raw, ends = ids.tobytes(), (4 * np.cumsum(count)).tolist()
            self.known.put(part, [raw[i:j] for i, j in zip([0, *ends], ends, strict=False)])
        return self.known.young

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text. Texts with single spaces alone go word by word; of others, markers are merged with what follows."""
        texts = pc.fill_null(texts, "")
        plain = np.asarray(pc.invert(pc.match_substring_regex(texts, f"^ | $|  |{MARK}|^$")))
        out: list[np.ndarray] = [np.zeros(0, "<i4")] * len(texts)
        if plain.any():
            split = pc.split_pattern(texts.filter(pa.array(plain)), " ")
            coded = split.flatten().dictionary_encode()
            words = coded.dictionary.cast(pa.binary()).to_pylist()
            known = self.learn(words, True)
            parts = [known[w] for w in words]
            size = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
            index = np.asarray(coded.indices, np.int64)
            each = size[index]
            ends = np.cumsum(each)
            flat = np.frombuffer(b"".join(parts), "<i4")[np.repeat((np.cumsum(size) - size)[index] - (ends - each), each) + np.arange(ends[-1])]
            last = ends[np.cumsum(np.asarray(pc.list_value_length(split), np.int64)) - 1]
            for k, x in zip(np.flatnonzero(plain).tolist(), np.split(flat, last[:-1]), strict=True):
                out[k] = x
        odd = [(int(k), t) for k in np.flatnonzero(~plain) if (t := texts[int(k)].as_py())]
        if odd:
            parted = [[b"\xff" + p.encode("utf-8") for p in self.part.findall(MARK + t.replace(" ", MARK))] for _, t in odd]
            known = self.learn(list({p for parts in parted for p in parts}), False)
            for (k, _), parts in zip(odd, parted, strict=True):
                out[k] = np.frombuffer(b"".join([known[p] for p in parts]), "<i4")
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The library's text of the ids; many ids go in slices that begin where a piece begins with a marker, whose space the library drops in front."""
        if len(ids) <= SLICE:
            return self.library.decode(ids.tolist())
        able, out, at = np.flatnonzero(self.starts[ids]), [], 0
        while at < len(ids):
            to = len(ids)
            if at + SLICE < to:
                found = able[np.searchsorted(able, at + SLICE, side="right") - 1] if len(able) else 0
                if found <= at:
                    later = able[np.searchsorted(able, at + SLICE) :]
                    found = later[0] if len(later) else to
                to = int(found)
            out.append(self.library.decode(ids[at:to].tolist()))
            at = to
        return " ".join(out)


def _pieces(path: str) -> Pieces:
    if path not in _CACHE:
        _CACHE[path] = Pieces(path)
    return _CACHE[path]


def encode(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id and ids of each row."""
    return _mapped(docs, model_path, "doc_id long, ids array<int>", lambda pieces, doc_ids, ids: [doc_ids, pa.array([x.tolist() for x in ids], pa.list_(pa.int32()))])


def digest(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of decimal ids joined by commas) and decoded_sha256 of each row: encoded and decoded where it lies, no shuffle."""

    def summed(pieces: Pieces, doc_ids: pa.Array, ids: list[np.ndarray]) -> list:
        sha = lambda texts: pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        numbers = pa.array(np.concatenate(ids)).cast(pa.string())
        lists = pc.binary_join(pa.LargeListArray.from_arrays(np.concatenate([[0], np.cumsum(size)]), numbers), ",").cast(pa.large_binary())
        return [doc_ids, pa.array(size), sha(memoryview(x.as_buffer()) for x in lists), sha(pieces.decode(x).encode("utf-8") for x in ids)]

    return _mapped(docs, model_path, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", summed)


def _mapped(docs: DataFrame, model_path: str, kind: str, result) -> DataFrame:
    names = [part.split()[0] for part in kind.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("subwords", _CACHE.clear)
        pieces = _pieces(model_path)
        for batch in batches:
            for part in steps(batch, size_bytes=STEP):
                ids = pieces.encode(part.column("text"))
                yield pa.RecordBatch.from_arrays(result(pieces, part.column("doc_id"), ids), names=names)
        pieces.forget()

    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(run), kind)


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """doc_id and text of rows with doc_id and ids; null ids are none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("subwords", _CACHE.clear)
        pieces = _pieces(model_path)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                texts = [pieces.decode(np.array(x or [], np.int64)) for x in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    ship(encoded.sparkSession)
    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(tidy(run), "doc_id long, text string")
