"""Token counts of a byte-level BPE vocabulary, exactly as its library counts them.

Method: rank-synchronous array merging. The distinct pre-tokens of a batch are held as one ragged numpy array
of symbols. In every round each sequence finds the lowest rank among its adjacent pairs and all its pairs of
that rank merge at once, over all sequences together; a sequence without a pair that merges is done, and what
is counted is the symbols left. Each task keeps the counts of pre-tokens that it has seen, up to a bound.

Before that, a sequence is cut wherever two adjacent bytes stand together in no entry of the vocabulary, since
no merge can cross there. A piece of more than LONG symbols even so (an unbroken word of that size) takes its
merges from a heap of ranks over linked symbols instead, so that time does not grow with its square.
"""

from __future__ import annotations

import heapq
import json
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the pre-token pattern of the byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHE_ENTRIES = 200_000
SLICE_BYTES = 1 << 20
LONG = 512
_NONE = np.int64(1 << 40)


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary: printable ones for themselves, the others from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    odd = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(odd)) for b in range(256)]


class Vocabulary:
    """Merge ranks of one vocabulary file, as sorted arrays, and the counts already known."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        vocab, merges = data["model"]["vocab"], data["model"]["merges"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        keys = left << 20 | right
        order = np.argsort(keys)
        self.keys, self.rank = keys[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        letters = _byte_letters()
        self.bytes = np.array([vocab[c] for c in letters], np.int64)
        of = {c: k for k, c in enumerate(letters)}
        #: Whether two bytes stand next to each other in any entry.
        self.together = np.zeros((256, 256), bool)
        for a, b in pairs:
            self.together[of[a[-1]], of[b[0]]] = True
        self.ranks = {(a, b): k for k, (a, b) in enumerate(zip(left.tolist(), right.tolist(), strict=True))}
        self.special = [t["content"] for t in data.get("added_tokens", [])]
        self.pattern = regex.compile(PATTERN)
        self.split = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.known: dict[str, int] = {}

    def _ranks(self, s: np.ndarray, same: np.ndarray) -> np.ndarray:
        """Rank of the pair that begins at each symbol; _NONE at the end of a sequence and for pairs that don't merge."""
        out = np.full(len(s), _NONE)
        at = np.flatnonzero(same)
        keys = s[at] << 20 | s[at + 1]
        found = np.searchsorted(self.keys, keys)
        found[found == len(self.keys)] = 0
        hit = self.keys[found] == keys
        out[at[hit]] = self.rank[found[hit]]
        return out

    def merge_counts(self, tokens: list[str]) -> np.ndarray:
        """Symbols left of each pre-token."""
        raw = [t.encode("utf-8", "replace") for t in tokens]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        code = np.frombuffer(b"".join(raw), np.uint8)
        whole = np.repeat(np.arange(len(raw)), size)
        if not len(code):
            return np.zeros(len(raw), np.int64)
        # Pieces that no merge joins, and the token of each.
        first = np.append(True, (whole[1:] != whole[:-1]) | ~self.together[code[:-1], code[1:]])
        start = np.flatnonzero(first)
        owner, length = whole[start], np.diff(np.append(start, len(code)))
        s = self.bytes[code]
        counts = np.zeros(len(start), np.int64)
        for k in np.flatnonzero(length > LONG):
            counts[k] = self._merge_long(s[start[k] : start[k] + length[k]].tolist())
        short = np.repeat(length <= LONG, length)
        counts += self._merge_pieces(s[short], np.repeat(np.arange(len(start)), length)[short], len(start))
        return np.bincount(owner, counts, len(raw)).astype(np.int64)

    def _merge_long(self, s: list[int]) -> int:
        """Symbols left of one long sequence: the lowest rank first, of equal ranks the leftmost."""
        n = len(s)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        ranks, merged = self.ranks, self.merged
        heap = [(r, i) for i in range(n - 1) if (r := ranks.get((s[i], s[i + 1]))) is not None]
        heapq.heapify(heap)
        left = n
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if s[i] < 0 or j < 0 or ranks.get((s[i], s[j])) != r:
                continue
            s[i], s[j] = int(merged[r]), -1
            after[i] = k = after[j]
            left -= 1
            if k >= 0:
                before[k] = i
                if (r := ranks.get((s[i], s[k]))) is not None:
                    heapq.heappush(heap, (r, i))
            if (h := before[i]) >= 0 and (r := ranks.get((s[h], s[i]))) is not None:
                heapq.heappush(heap, (r, h))
        return left

    def _merge_pieces(self, s: np.ndarray, seq: np.ndarray, n: int) -> np.ndarray:
        """Symbols left of each of n sequences, given one after another with their numbers."""
        count = np.zeros(n, np.int64)
        while len(s):
            rank = self._ranks(s, np.append(seq[1:] == seq[:-1], False)[: len(s)])
            start = np.flatnonzero(np.append(True, seq[1:] != seq[:-1]))
            low = np.minimum.reduceat(rank, start)
            length = np.diff(np.append(start, len(s)))
            done = low == _NONE
            count[seq[start[done]]] = length[done]
            hit = (rank == np.repeat(low, length)) & (rank != _NONE)
            at = np.flatnonzero(hit)
            if not len(at):
                break
            # In a run of hits (the same symbol again and again) every other one merges, from the left.
            first = np.append(True, at[1:] != at[:-1] + 1)
            run = np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - run) % 2 == 0]
            s = s.copy()
            s[at] = self.merged[rank[at]]
            keep = np.repeat(~done, length)
            keep[at + 1] = False
            s, seq = s[keep], seq[keep]
        return count

    def counts(self, texts: list[str]) -> list[int]:
        """Tokens of each text; the strings of special tokens inside a text count one each."""
        found, extra = [], []
        for t in texts:
            if self.split and any(x in t for x in self.special):
                parts = self.split.split(t)
                found.append([w for p in parts for w in self.pattern.findall(p)])
                extra.append(len(parts) - 1)
            else:
                found.append(self.pattern.findall(t))
                extra.append(0)
        new = list(set().union(*found) - self.known.keys())
        if len(self.known) + len(new) > CACHE_ENTRIES:
            self.known.clear()
            new = list(set().union(*found))
        self.known.update(zip(new, self.merge_counts(new).tolist(), strict=True))
        get = self.known.__getitem__
        return [sum(map(get, w)) + e for w, e in zip(found, extra, strict=True)]


@cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def token_counts(docs: DataFrame, vocabulary_path: str, id_column: str = "doc_id", text_column: str = "text", limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of every whole text, a row for each row of docs.

    A null text counts as empty: 0 bytes, 0 tokens. Repeated rows and null ids stay as they are; other columns
    are ignored. Very long texts, also those without a break, are counted whole. The vocabulary file must be
    readable at the same path on every executor.
    """

    def run(batches):
        vocab = vocabulary(vocabulary_path)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            out: list[int] = []
            a, size = 0, 0
            for i, t in enumerate(texts):
                size += len(t)
                if size >= SLICE_BYTES or i + 1 == len(texts):
                    out += vocab.counts(texts[a : i + 1])
                    a, size = i + 1, 0
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "n_bytes": batch.column("n_bytes"), "n_tokens": pa.array(out, pa.int64())})
        vocab.known.clear()

    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
