"""SentencePiece encoding and decoding with a given BPE model, by shared-prefix dynamic programming.

Text is marked (a space becomes U+2581, one is put in front) and cut into words: runs of marks with what follows.
No piece has a mark after another sign, and none holds a line feed, so words can be encoded apart; both are
checked when a model is loaded. The distinct words of a slice that are not yet known are sorted, which is the
depth-first order of their trie, and a stack holds the forward state of every prefix of the current word. The
next word keeps the states of the prefix that it shares with the last one and only computes the rest.

The model's pieces are merged by rank, so the best path is not the one of the largest sum of scores. The forward
state of a prefix is therefore the last piece of its BPE encoding, which is unique: a piece p ending the prefix is
the last one exactly if p does not merge with, or take from, the last piece before it, that is if the encoding of
the two together is the two. These pairs are looked up in a table that fills as they occur. The result is equal
to the library's for every text (the tests compare them). Signs without a piece become byte pieces.
"""

from __future__ import annotations

import re
from array import array
from functools import cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MARK = "▁"
SLICE_BYTES = 1 << 20
SLICE_ROWS = 256
CACHE_BYTES = 48 << 20  # of known words and their ids, for each running task; the tables go with the task
CACHE_PAIRS = 200_000


class Model:
    def __init__(self, path: str):
        m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = m.vocab_size()
        self.bytes: list[bytes] = []
        self.ids: dict[str, int] = {}
        self.of_byte = [0] * 256
        for i in range(n):
            p = m.id_to_piece(i)
            if m.is_byte(i):
                self.of_byte[int(p[3:5], 16)] = i
                self.bytes.append(bytes([int(p[3:5], 16)]))
            elif m.is_control(i) or m.is_unknown(i) or m.is_unused(i):
                self.bytes.append(b"")
            else:
                self.ids[p] = i
                self.bytes.append(p.replace(MARK, " ").encode())
        self.score = [m.get_score(i) for i in range(n)]
        if any(MARK in p.lstrip(MARK) or "\n" in p for p in self.ids):
            raise ValueError("this model's pieces cross words")
        lengths: dict[str, set[int]] = {}
        for p in self.ids:
            if len(p) > 2:
                lengths.setdefault(p[-3:], set()).add(len(p))
        #: For the last three signs, the lengths of the pieces of three or more that end with them, longest first.
        self.lengths = {c: sorted(k, reverse=True) for c, k in lengths.items()}
        #: All pieces' bytes in one array, and where each lies in it.
        self.blob = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.size = np.array([len(b) for b in self.bytes], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.cut = re.compile(f"{MARK}+[^{MARK}\\n]*|[^{MARK}\\n]+|\\n")
        self.forget()

    def forget(self) -> None:
        """Empty the tables that fill as texts are encoded."""
        #: Ids of known words, as bytes of 32-bit integers, and about how much memory they take.
        self.words: dict[str, bytes] = {}
        self.held = 0
        self.pairs: dict[tuple[str, str], bool] = {}

    def merge(self, text: str) -> list[str]:
        """Plain BPE of a short string: merge the adjacent pair whose piece has the best score, the leftmost first."""
        s = list(text)
        while len(s) > 1:
            best, at = None, -1
            for i in range(len(s) - 1):
                k = self.ids.get(s[i] + s[i + 1])
                if k is not None and (best is None or self.score[k] > best):
                    best, at = self.score[k], i
            if at < 0:
                break
            s[at : at + 2] = [s[at] + s[at + 1]]
        return s

    def _stays(self, before: str, piece: str) -> bool:
        """Whether piece is a last piece after before ("" at the start of a word or after a sign without a piece)."""
        key = (before, piece)
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= CACHE_PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self.merge(before + piece) == ([before, piece] if before else [piece])
        return known

    def encode_words(self, words: list[str]) -> None:
        """Put the encoding of each of the sorted words into the table."""
        ids, lengths, pairs, stays = self.ids, self.lengths, self.pairs, self._stays
        last: list[str] = [""]  # last piece of each prefix; "" after a sign without a piece
        previous = ""
        for w in words:
            k, n = 0, min(len(w), len(previous))
            while k < n and w[k] == previous[k]:
                k += 1
            del last[k + 1 :]
            for i in range(k + 1, len(w) + 1):
                found = ""
                sizes = (*lengths.get(w[i - 3 : i], ()), 2, 1) if i > 2 else (2, 1) if i == 2 else (1,)
                for size in sizes:
                    if size > i:
                        continue
                    p = w[i - size : i]
                    if p in ids:
                        before = last[i - size]
                        known = pairs.get((before, p))
                        if stays(before, p) if known is None else known:
                            found = p
                            break
                last.append(found)
            out: list[int] = []
            i = len(w)
            while i:
                p = last[i]
                if p:
                    out.append(ids[p])
                    i -= len(p)
                else:
                    out += [self.of_byte[b] for b in reversed(w[i - 1].encode("utf-8", "replace"))]
                    i -= 1
            out.reverse()
            self.words[w] = array("i", out).tobytes()
            self.held += 200 + 2 * len(w) + 4 * len(out)
            previous = w

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        cut = [self.cut.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        new = set().union(*cut) - self.words.keys()
        if self.held > CACHE_BYTES:
            self.words.clear()
            self.held = 0
            new = set().union(*cut)
        self.encode_words(sorted(new))
        get = self.words.__getitem__
        return [np.frombuffer(b"".join(map(get, c)), np.int32) for c in cut]

    def decode(self, ids: np.ndarray, count: np.ndarray) -> list[str]:
        """Texts of lists of ids, given one after another; bytes that are no UTF-8 become U+FFFD, and the mark put in front goes."""
        size = self.size[ids]
        end = np.cumsum(size)
        at = np.repeat(self.start[ids] - (end - size), size)
        at += np.arange(len(at))
        text = self.blob[at].tobytes()
        stop = np.concatenate(([0], end))[np.cumsum(count)].tolist()
        return [text[a:b].decode("utf-8", "replace").removeprefix(" ") for a, b in zip([0, *stop[:-1]], stop, strict=True)]


@cache
def model(path: str) -> Model:
    return Model(path)


def _encoded(m: Model, batch: pa.RecordBatch):
    """(slice of batch, its texts, ids of each) for about SLICE_BYTES of text at a time, a longer text for itself."""
    column = batch.column("text")
    a, size, texts = 0, 0, []
    for i in range(batch.num_rows):
        texts.append(column[i].as_py())
        size += len(texts[-1] or "")
        if size >= SLICE_BYTES or i + 1 == batch.num_rows:
            yield batch.slice(a, i + 1 - a), texts, m.encode([t or "" for t in texts])
            a, size, texts = i + 1, 0, []


def _ids_column(texts: list[str | None], ids: list[np.ndarray]) -> pa.Array:
    ends = pa.array(np.cumsum([0, *map(len, ids)]), pa.int32())
    return pa.ListArray.from_arrays(ends, pa.array(np.concatenate(ids)), mask=pa.array([t is None for t in texts]))


def _rows(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))


def encode(docs: DataFrame, model_path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, text and ids (array of int) of every whole text, one row for each row of docs.

    A null text has null ids, an empty one has none; a very long text is encoded whole, its words apart. Repeated
    rows and null ids stay; other columns are ignored. The model file must be readable at the same path on every
    executor.
    """

    def run(batches):
        m = model(model_path)
        for batch in batches:
            for part, texts, ids in _encoded(m, batch):
                yield pa.record_batch({"doc_id": part.column("doc_id"), "text": part.column("text"), "ids": _ids_column(texts, ids)})
        m.forget()

    return _rows(docs, id_column, text_column).mapInArrow(run, "doc_id long, text string, ids array<int>")


def round_trip(docs: DataFrame, model_path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, ids and round_trip (whether the ids decode to the text again; null for a null text), in one pass over docs.

    The same as decode(encode(docs)) and a comparison, without sending texts back and forth.
    """

    def run(batches):
        m = model(model_path)
        for batch in batches:
            for part, texts, ids in _encoded(m, batch):
                back = m.decode(np.concatenate(ids), np.fromiter(map(len, ids), np.int64, len(ids)))
                same = pa.array([None if t is None else t == b for t, b in zip(texts, back, strict=True)], pa.bool_())
                yield pa.record_batch({"doc_id": part.column("doc_id"), "ids": _ids_column(texts, ids), "round_trip": same})
        m.forget()

    return _rows(docs, id_column, text_column).mapInArrow(run, "doc_id long, ids array<int>, round_trip boolean")


def decode(encoded: DataFrame, model_path: str, ids_column: str = "ids", to: str = "decoded") -> DataFrame:
    """encoded with one more column: the text of its ids (null for null). Ids must be those of the model.

    The decoded text equals the encoded one, but for U+2581 in a text, which comes back as a space.
    """
    schema = T.StructType([*encoded.schema.fields, T.StructField(to, T.StringType())])

    def run(batches):
        m = model(model_path)
        for batch in batches:
            out: list[str | None] = []
            for a in range(0, batch.num_rows, SLICE_ROWS):
                lists = batch.column(ids_column).slice(a, SLICE_ROWS)
                count = np.diff(lists.offsets.to_numpy())
                texts = m.decode(lists.flatten().to_numpy(), count) if len(lists) else []
                out += [t if v else None for t, v in zip(texts, lists.is_valid().to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=[*batch.schema.names, to])

    return encoded.mapInArrow(run, schema)
