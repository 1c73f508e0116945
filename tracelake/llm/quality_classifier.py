"""Quality classifier: attention-based multiple-instance learning over the passages of whole documents.

Every passage of PASSAGE words is encoded: its features (shares of kinds of characters, word lengths, distinct
and repeated words, and a hashed histogram of adjacent characters) and the mean of the learned embeddings of its
words and pairs of words (hashed to GRAMS rows) go through one learned layer. A gated attention, learned from the labels of documents alone, weights the passages; the weighted sum is the document's
representation, and a logistic output scores it. Labels are read from a sample of at most TRAIN_DOCS labelled
documents (chosen by hash of the id, whatever the input's size); features and scores are computed in the tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PASSAGE = 64
PAIRS = 32
HIDDEN = 32
ATTENTION = 16
TRAIN_DOCS = 3000
EPOCHS = 12
SLICE_BYTES = 1 << 20
GRAM_BITS = 13
GRAMS = 1 << GRAM_BITS
GRAM_RATE, GRAM_DECAY = 0.1, 1e-2  # of the embeddings, which start at zero: few documents would else be learned by heart
BLOCK = 1 << 18  # words and pairs whose embeddings are held at once
N_FEATURES = 16 + PAIRS

_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_KIND = np.zeros((256, 7), np.float32)  # upper, digit, symbol, exclamation, bar, stop, not ASCII
_KIND[65:91, 0] = 1
_KIND[48:58, 1] = 1
_KIND[[ord(c) for c in "#*$%&<>@=+~^_\\{}[]"], 2] = 1
_KIND[ord("!"), 3] = 1
_KIND[ord("|"), 4] = 1
_KIND[[ord(c) for c in ".,;:?"], 5] = 1
_KIND[128:, 6] = 1
_SPREAD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)  # odd multipliers
_CODE = np.random.default_rng(11).integers(1, 2**63, 256).astype(np.uint64)


def passages(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Features of every passage of the texts, and the number of passages of each; an empty text has one, of zeros.

    Then the rows of the embeddings of all words and pairs, and how many each passage has: a word and what it is followed by
    in its passage (or its end) count each.
    """
    raw = [b" ".join(t.encode("utf-8", "replace").split()) for t in texts]
    words = np.array([t.count(b" ") + 1 if t else 0 for t in raw])
    count = np.maximum(1, -(-words // PASSAGE))
    first = np.cumsum(count) - count
    out = np.zeros((int(count.sum()), N_FEATURES), np.float32)
    buf = np.frombuffer(b" ".join(t for t in raw if t), np.uint8)
    if not len(buf):
        return out, count, np.zeros(0, np.int16), np.zeros(len(out), np.int64)
    gap = np.flatnonzero(buf == 32)
    start, end = np.append(0, gap + 1), np.append(gap, len(buf))
    # Passage of each word, then of each byte.
    inside = np.arange(len(start)) - np.repeat(np.cumsum(words[words > 0]) - words[words > 0], words[words > 0])
    of_word = np.repeat(first[words > 0], words[words > 0]) + inside // PASSAGE
    length = end - start
    of_byte = np.repeat(of_word, np.append(np.diff(start), len(buf) - start[-1]))
    n = len(out)
    n_words = np.bincount(of_word, minlength=n).astype(np.float32)
    n_bytes = np.maximum(np.bincount(of_word, length, n), 1).astype(np.float32)
    kinds = np.add.reduceat(_KIND[buf], starts := np.flatnonzero(np.append(True, np.diff(of_byte) != 0)), axis=0)
    at = of_byte[starts]
    some = np.maximum(n_words, 1)
    out[at, :7] = kinds / n_bytes[at, None]
    out[:, 7] = np.log1p(n_words) / 5
    out[:, 8] = n_bytes / some / 10
    out[:, 9] = np.sqrt(np.maximum(np.bincount(of_word, length.astype(np.float64) ** 2, n) / some - (n_bytes / some) ** 2, 0)) / 10
    # Words by a hash: the sum of random codes turned by their place.
    turned = _CODE[buf] * (2 * (np.arange(len(buf)) - np.repeat(start, np.append(np.diff(start), len(buf) - start[-1]))).astype(np.uint64) + np.uint64(1))
    turned[buf == 32] = 0
    word = np.add.reduceat(turned, start)
    same = np.append(False, (word[1:] == word[:-1]) & (of_word[1:] == of_word[:-1]))
    out[:, 10] = np.bincount(of_word, same, n) / some
    after = np.append(word[1:], np.uint64(0))
    after[np.append(of_word[1:] != of_word[:-1], True)] = 0
    grams = np.stack([word * _SPREAD[0], (word * _SPREAD[0] + after) * _SPREAD[1]], axis=1) >> np.uint64(64 - GRAM_BITS)
    both = np.unique((of_word.astype(np.uint64) << np.uint64(40)) | (word >> np.uint64(24)))
    out[:, 11] = np.bincount((both >> np.uint64(40)).astype(np.int64), minlength=n) / some
    last = _KIND[buf[end - 1]][:, 2:6].sum(axis=1)
    out[:, 12] = np.bincount(of_word, last, n) / some
    capital = _KIND[buf[start], 0]
    out[:, 13] = np.bincount(of_word, capital, n) / some
    out[:, 14] = np.bincount(of_word, length == 1, n) / some
    out[:, 15] = 1
    pair = (buf[:-1].astype(np.int64) * 31 + buf[1:] * 7) % PAIRS
    inner = of_byte[1:] == of_byte[:-1]
    histogram = np.bincount(of_byte[:-1][inner] * PAIRS + pair[inner], minlength=n * PAIRS).reshape(n, PAIRS)
    out[:, 16:] = 4 * histogram / n_bytes[:, None]
    return out, count, grams.ravel().astype(np.int16), 2 * np.bincount(of_word, minlength=n)


def _initial(seed: int = 3) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    w = lambda a, b: r.standard_normal((a, b)) / np.sqrt(a)
    return {"g": np.zeros((GRAMS, HIDDEN)), "w": w(N_FEATURES, HIDDEN), "wb": np.zeros(HIDDEN), "v": w(HIDDEN, ATTENTION), "u": w(HIDDEN, ATTENTION), "a": w(ATTENTION, 1)[:, 0], "c": w(HIDDEN, 1)[:, 0], "cb": np.zeros(1)}


def gram_means(table: np.ndarray, grams: np.ndarray, per: np.ndarray) -> np.ndarray:
    """Mean of the table's rows grams of each passage; zeros where it has none. About BLOCK rows are held at once."""
    out = np.zeros((len(per), table.shape[1]), table.dtype)
    ends = np.cumsum(per)
    a = 0
    while a < len(per):
        begin = ends[a] - per[a]
        b = max(a + 1, int(np.searchsorted(ends, begin + BLOCK, "right")))
        some = np.flatnonzero(per[a:b]) + a
        if len(some):
            rows = table[grams[begin : ends[b - 1]]]
            out[some] = np.add.reduceat(rows, ends[some] - per[some] - begin, axis=0) / per[some, None].astype(table.dtype)
        a = b
    return out


def _forward(p, x: np.ndarray, count: np.ndarray, grams: np.ndarray, per: np.ndarray):
    """Scores' logits of documents of count passages each, and what the gradients need."""
    first = np.cumsum(count) - count
    h = np.maximum(x @ p["w"] + gram_means(p["g"], grams, per) + p["wb"], 0)
    t, s = np.tanh(h @ p["v"]), 1 / (1 + np.exp(-(h @ p["u"])))
    e = (t * s) @ p["a"]
    e = np.exp(e - np.repeat(np.maximum.reduceat(e, first), count))
    e /= np.repeat(np.add.reduceat(e, first), count)
    z = np.add.reduceat(e[:, None] * h, first, axis=0)
    return z @ p["c"] + p["cb"], (first, h, t, s, e, z)


def gradients(p, x: np.ndarray, count: np.ndarray, grams: np.ndarray, per: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Loss (weighted cross entropy summed over documents, divided by their number) and its gradient for every weight."""
    logit, (first, h, t, s, e, z) = _forward(p, x, count, grams, per)
    loss = float((weight * (np.logaddexp(0, logit) - y * logit)).sum() / len(y))
    d = (1 / (1 + np.exp(-logit)) - y) * weight / len(y)
    g = {"c": z.T @ d, "cb": np.array([d.sum()])}
    dz = np.repeat(d, count)[:, None] * p["c"]
    de = (dz * h).sum(axis=1)
    de = e * (de - np.repeat(np.add.reduceat(e * de, first), count))
    dts = de[:, None] * p["a"]
    g["a"] = (t * s).T @ de
    dt, ds = dts * s * (1 - t * t), dts * t * s * (1 - s)
    g["v"], g["u"] = h.T @ dt, h.T @ ds
    dh = (e[:, None] * dz + dt @ p["v"].T + ds @ p["u"].T) * (h > 0)
    g["w"], g["wb"] = x.T @ dh, dh.sum(axis=0)
    each = np.repeat(dh / np.maximum(per, 1)[:, None], per, axis=0)
    g["g"] = np.bincount((grams.astype(np.int64)[:, None] * HIDDEN + np.arange(HIDDEN)).ravel(), each.ravel(), GRAMS * HIDDEN).reshape(GRAMS, HIDDEN)
    return loss, g


def train(x: np.ndarray, count: np.ndarray, grams: np.ndarray, per: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, size: int = 64, rate: float = 0.01) -> dict[str, np.ndarray]:
    """Adam over documents in a seeded order; both labels weigh the same in all."""
    p = _initial()
    m1, m2 = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    if not len(y):
        return p
    weight = np.where(y > 0, 0.5 / max(y.mean(), 1e-6), 0.5 / max(1 - y.mean(), 1e-6))
    begin, gram_begin = np.cumsum(count) - count, np.cumsum(per) - per
    spans = lambda starts, sizes: np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    r, step = np.random.default_rng(5), 0
    for _ in range(epochs):
        order = r.permutation(len(y))
        for a in range(0, len(y), size):
            ids = order[a : a + size]
            rows = spans(begin[ids], count[ids])
            g = gradients(p, x[rows], count[ids], grams[spans(gram_begin[rows], per[rows])], per[rows], y[ids], weight[ids])[1]
            step += 1
            for n in p:
                m1[n] = 0.9 * m1[n] + 0.1 * g[n]
                m2[n] = 0.999 * m2[n] + 0.001 * g[n] ** 2
                own, decay = (rate * GRAM_RATE, GRAM_DECAY) if n == "g" else (rate, 1e-4)
                p[n] = p[n] - own * (m1[n] / (1 - 0.9**step)) / (np.sqrt(m2[n] / (1 - 0.999**step)) + 1e-8) - rate * decay * p[n]
    return p


def _slices(batches):
    for batch in batches:
        texts = [t or "" for t in batch.column("text").to_pylist()]
        a, size = 0, 0
        for i, t in enumerate(texts):
            size += len(t)
            if size >= SLICE_BYTES or i + 1 == len(texts):
                yield batch.slice(a, i + 1 - a), *passages(texts[a : i + 1])
                a, size = i + 1, 0


def fit(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> dict[str, np.ndarray]:
    """Weights learned from at most train_docs documents of labels (doc_id, quality): those first by hash of the id."""
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    some = F.broadcast(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_docs))

    def run(batches):
        lists = lambda ends, values: pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(values))
        for batch, x, count, grams, per in _slices(batches):
            ends = np.cumsum(count)
            yield pa.record_batch({
                "doc_id": batch.column("doc_id"), "quality": batch.column("quality"), "x": lists(ends * N_FEATURES, x.ravel()), "per": lists(ends, per),
                "grams": lists(np.cumsum(per)[ends - 1], grams),
            })

    rows = docs.join(some, "doc_id").select("doc_id", "quality", "text").mapInArrow(run, "doc_id long, quality int, x array<float>, per array<long>, grams array<short>")
    kinds = {"x": np.float32, "per": np.int64, "grams": np.int16}
    got = [(r["doc_id"], r["quality"], *(np.array(r[n], kinds[n]) for n in kinds)) for r in rows.toLocalIterator()]
    got.sort(key=lambda r: (r[0], r[1], len(r[2]), r[2].tobytes()))
    if not got:
        return _initial()
    x, per, grams = (np.concatenate([g[n] for g in got]) for n in (2, 3, 4))
    return train(x.reshape(-1, N_FEATURES), np.array([len(g[3]) for g in got]), grams, per, np.array([float(g[1] > 0) for g in got]))


def quality_scores(docs: DataFrame, labels: DataFrame, held_out, id_column: str = "doc_id", text_column: str = "text", threshold: float = 0.3, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """doc_id, held_out, score in 0..1, predicted (score >= threshold) and n_passages for every row of docs.

    held_out is a condition on doc_id: labels of those rows are not learned from. Null and empty texts have one
    passage of zeros and are scored like any other. A null doc_id is scored, and held out. Without labels the
    untrained model scores. Repeated rows are scored each; columns but the two named are ignored.
    """
    docs = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    out = F.coalesce(held_out, F.lit(True))
    weights = fit(docs, labels.select("doc_id", F.col("quality").cast("int").alias("quality")).where(~out), train_docs)
    shared = docs.sparkSession.sparkContext.broadcast({k: v.astype(np.float32) for k, v in weights.items()})

    def run(batches):
        for batch, x, count, grams, per in _slices(batches):
            logit, _ = _forward(shared.value, x, count, grams, per)
            score = 1 / (1 + np.exp(-np.clip(logit.astype(np.float64), -50, 50)))
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "score": pa.array(score), "n_passages": pa.array(count, pa.int64())})

    rows = docs.withColumn("held_out", out).mapInArrow(run, "doc_id long, held_out boolean, score double, n_passages long")
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
