"""Language-model scoring: a gated recurrent model in numpy, with a class-factored output.

The corpus gives three things, all over whole texts of the training documents: the count of every distinct token
(a table, joined by shuffle), the frequent words with their counts (at most FREQUENT of them, sent to the tasks),
and the trained weights. A token's probability is P(class | state) * P(token | class, state):

* the CORE most frequent words and the end token lie in CLASSES classes of like frequency, and within a class the
  softmax also sees the state;
* all other words, seen or not, lie in TAILS classes by their first two bytes. Within such a class a word of
  count c has (c + 1) / (N + V + 1), with the class's own totals, so unseen words have a probability too.

Training is truncated backpropagation over windows of WINDOW tokens. The hidden state is carried from window to
window and set to zero where a document begins; scoring does the same, so each document gets the log-likelihood
of all its tokens. Training is spread over shards: the rounds split all training documents by hash, in each round
every shard takes steps on its own part of the round's documents from common weights, and the weighted mean of the
shards' weights starts the next round. So each training document is learned from once, and the number of shards
grows with the input. Output biases start at the counted frequencies, so an untrained model is a class unigram model.
"""

from __future__ import annotations

import io
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import stored

CORE = 2047
CLASSES = 32
TAILS = 16
HIDDEN = 16
FREQUENT = 150_000
ROUNDS = 3
WINDOW = 32
LANES = 256
SCORE_LANES = 512
SCORE_WINDOW = 96  # the state is carried on, so only the size of the arrays depends on it
SHARD_TOKENS = 4_000_000
SLICE_BYTES = 4 << 20
LONG_BYTES = 12_000  # longer texts of a task wait for each other: one of them alone would take a step for each token
LONG_HELD = 16 << 20  # bytes of text that wait at most, besides one more text
END = " "  # no word holds a space
_OUT = CLASSES + TAILS


def tokens(text: str | None) -> list[bytes]:
    """Words with A-Z in lower case; bytes.split() splits at exactly \\x20\\x09-\\x0D."""
    return (text or "").encode("utf-8", "replace").lower().split()


def tail_class(word: bytes) -> int:
    return zlib.crc32(word[:2]) % TAILS


def _token_counts(docs: DataFrame) -> DataFrame:
    """(word, c, docs) rows, summed per task first: counts of all tokens of docs, the end token included."""

    def run(batches):
        held: Counter = Counter()
        for batch in batches:
            for t in batch.column("text").to_pylist():
                held.update(tokens(t))
                held[END.encode()] += 1
            if len(held) > 300_000:
                yield _counted(held)
                held = Counter()
        if held:
            yield _counted(held)

    return docs.select("text").mapInArrow(run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _counted(held: Counter) -> pa.RecordBatch:
    return pa.record_batch({"word": pa.array(list(held.keys()), pa.binary()).cast(pa.string()), "c": pa.array(list(held.values()), pa.int64())})


class Ids(dict):
    """Word to index in the frequent list; -1 for any other word."""

    def __missing__(self, key):
        return -1


class Lexicon:
    """Frequent words in order of (count, word), their counts, and the totals of the tail classes."""

    def __init__(self, words: list[bytes], counts: np.ndarray, tail_sums: np.ndarray, total: int, distinct: int):
        self.words, self.counts, self.tail_sums, self.total, self.distinct = words, counts, tail_sums, total, distinct
        self.ids = Ids(zip(words, range(len(words)), strict=True))
        core = min(CORE + 1, len(words))
        # Core classes hold like shares of the square roots of the counts.
        root = np.sqrt(counts[:core].astype(np.float64))
        cut = (np.cumsum(root) - root) / max(root.sum(), 1e-9)
        self.klass = np.full(len(words), -1, np.int32)
        self.klass[:core] = np.minimum((cut * CLASSES).astype(np.int32), CLASSES - 1)
        #: Core words are in order of their classes: class c holds those from bounds[c] up to bounds[c + 1].
        self.bounds = np.searchsorted(self.klass[:core], np.arange(CLASSES + 1)).tolist()
        for i in range(core, len(words)):
            self.klass[i] = CLASSES + tail_class(words[i])
        self.core = core
        # Input ids: core words, then tail classes.
        self.input = np.where(self.klass < CLASSES, np.arange(len(words)), core + self.klass - CLASSES).astype(np.int32)
        self.tail_log = -np.log10(tail_sums[:, 0] + tail_sums[:, 1] + 1.0)
        self.base_log = -np.log10(total + distinct + 1.0)
        self.word_log = np.log10(counts + 1.0)

    def initial(self, seed: int = 7) -> dict[str, np.ndarray]:
        r = np.random.default_rng(seed)
        n_in, f = self.core + TAILS + 1, np.float32
        out = np.zeros(_OUT)
        np.add.at(out, self.klass[: self.core], self.counts[: self.core])
        out[CLASSES:] = self.tail_sums[:, 0]
        inner = np.log(self.counts[: self.core] + 0.1)
        w = lambda *s: (r.standard_normal(s) * 0.1).astype(f)
        return {"x": w(n_in, 3 * HIDDEN), "u": w(HIDDEN, 3 * HIDDEN), "b": np.zeros(3 * HIDDEN, f), "o": np.zeros((HIDDEN, _OUT), f), "ob": np.log(out + 0.5).astype(f), "i": np.zeros((self.core, HIDDEN), f), "ib": inner.astype(f)}

    def encode(self, text: str | None) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """Indexes in the frequent list (-1 if not in it) and input/output classes of a text's tokens and its end."""
        words = tokens(text)
        words.append(END.encode())
        get = self.ids
        at = np.fromiter(map(get.__getitem__, words), np.int32, len(words))
        missing = [words[i] for i in np.flatnonzero(at < 0)]
        klass = self.klass[at]
        if missing:
            klass[at < 0] = [CLASSES + tail_class(w) for w in missing]
        return at, klass, missing


def _sigmoid(x):
    y = np.negative(x)
    np.exp(y, out=y)
    y += 1
    return np.reciprocal(y, out=y)


def _lanes(docs: list[tuple[np.ndarray, np.ndarray]], n_lanes: int):
    """Put documents one after another into lanes of about equal length, the longest lane first.

    Returns per lane the list of document numbers.
    """
    order = sorted(range(len(docs)), key=lambda k: -len(docs[k][0]))
    n_lanes = min(n_lanes, len(docs))
    lanes: list[list[int]] = [[] for _ in range(n_lanes)]
    load = np.zeros(n_lanes, np.int64)
    for k in order:
        j = int(load.argmin())
        lanes[j].append(k)
        load[j] += len(docs[k][0])
    return [lanes[j] for j in np.argsort(-load, kind="stable")]


def _grid(lexicon: Lexicon, docs, n_lanes: int):
    """Arrays by step and lane: input id (that of the previous token), class, core word, document, reset, and lanes alive."""
    lanes = _lanes(docs, n_lanes)
    size = [sum(len(docs[k][0]) for k in lane) for lane in lanes]
    steps = size[0]
    start = lexicon.core + TAILS
    shape = (steps, len(lanes))
    x, klass, word, doc = (np.zeros(shape, np.int32) for _ in range(4))
    fresh = np.zeros(shape, bool)
    doc[:] = -1
    for j, lane in enumerate(lanes):
        t = 0
        for k in lane:
            at, c = docs[k]
            n = len(at)
            inputs = np.where(at >= 0, lexicon.input[at], lexicon.core + c - CLASSES)
            x[t, j], x[t + 1 : t + n, j] = start, inputs[:-1]
            klass[t : t + n, j] = c
            word[t : t + n, j] = at
            doc[t : t + n, j] = k
            fresh[t, j] = True
            t += n
    alive = (doc >= 0).sum(axis=1)
    return x, klass, word, doc, fresh, alive


def _forward(p, x, fresh, alive, h, keep=None):
    """Hidden states after each step of a window; keep, if given, gets what backpropagation needs, by step and lane."""
    d = HIDDEN
    gx = (p["x"] + p["b"])[x]
    out = np.zeros((*x.shape, d), gx.dtype)
    if keep is not None:
        keep |= {k: np.zeros((*x.shape, d), gx.dtype) for k in ("prev", "un", "n", "z", "r")}
    for t in range(len(x)):
        m = alive[t]
        if not m:
            break
        prev = h[:m].copy()
        prev[fresh[t, :m]] = 0
        u = prev @ p["u"]
        g = gx[t, :m]
        zr = _sigmoid(g[:, : 2 * d] + u[:, : 2 * d])
        z, r = zr[:, :d], zr[:, d:]
        n = r * u[:, 2 * d :]
        n += g[:, 2 * d :]
        np.tanh(n, out=n)
        now = prev - n
        now *= z
        now += n
        out[t, :m] = now
        if keep is not None:
            keep["prev"][t, :m], keep["un"][t, :m], keep["n"][t, :m], keep["z"][t, :m], keep["r"][t, :m] = prev, u[:, 2 * d :], n, z, r
        h[:m] = now
    return out


def _by_class(c: np.ndarray):
    """(class, places of the tokens of that core class) for the core classes that occur in c."""
    order = np.argsort(c, kind="stable")
    ends = np.searchsorted(c[order], np.arange(CLASSES + 1)).tolist()
    return [(g, order[ends[g] : ends[g + 1]]) for g in range(CLASSES) if ends[g] < ends[g + 1]]


def _logits(s, w, b):
    """Logits w @ s + b of states s, less each one's largest: a row for each output, so that sums and maxima run along the states."""
    y = w @ s.T
    y += b[:, None]
    y -= y.max(axis=0)
    return y


def score_docs(lexicon: Lexicon, p, docs) -> np.ndarray:
    """log10 P(classes and core words) of each document; tail words' own share comes from their counts."""
    if not docs:
        return np.zeros(0)
    x, klass, word, doc, fresh, alive = _grid(lexicon, docs, SCORE_LANES)
    total = np.zeros(len(docs))
    h = np.zeros((x.shape[1], HIDDEN), np.float32)
    for a in range(0, len(x), SCORE_WINDOW):
        b = a + SCORE_WINDOW
        m = int(alive[a])
        states = _forward(p, x[a:b, :m], fresh[a:b, :m], alive[a:b], h)
        at = np.flatnonzero(doc[a:b, :m].ravel() >= 0)
        s, c, w, k = states.reshape(-1, HIDDEN)[at], klass[a:b, :m].ravel()[at], word[a:b, :m].ravel()[at], doc[a:b, :m].ravel()[at]
        y = _logits(s, p["o"].T, p["ob"])
        got = y[c, np.arange(len(c))].astype(np.float64)
        got -= np.log(np.exp(y, out=y).sum(axis=0))
        for g, q in _by_class(c):
            lo, hi = lexicon.bounds[g], lexicon.bounds[g + 1]
            if hi - lo > 1:  # a class of one word says nothing more
                y = _logits(s[q], p["i"][lo:hi], p["ib"][lo:hi])
                own = y[w[q] - lo, np.arange(len(q))]
                got[q] += own - np.log(np.exp(y, out=y).sum(axis=0))
        total += np.bincount(k, got, len(docs))
    return total / np.log(10)


def gradients(lexicon: Lexicon, p, x, klass, word, doc, fresh, alive, h):
    """Loss (mean of -ln P over a window's tokens), its gradients, the input ids that occur, and the number of tokens.

    The arrays are those of one window of _grid, lanes alive first; h is the state carried in and is moved on.
    Backpropagation ends at the window's beginning. The gradient of "x" has a row for each input id that occurs.
    """
    d, m = HIDDEN, x.shape[1]
    kept: dict[str, np.ndarray] = {}
    states = _forward(p, x, fresh, alive, h, kept)
    at = np.flatnonzero(doc.ravel() >= 0)
    s, c, w = states.reshape(-1, d)[at], klass.ravel()[at], word.ravel()[at]
    n, loss = len(c), 0.0
    q = _logits(s, p["o"].T, p["ob"])
    loss -= float(q[c, np.arange(n)].sum())
    np.exp(q, out=q)
    total = q.sum(axis=0)
    loss += float(np.log(total).sum())
    q /= total
    q[c, np.arange(n)] -= 1
    q /= n
    grad = {"o": s.T @ q.T, "ob": q.sum(axis=1), "i": np.zeros_like(p["i"]), "ib": np.zeros_like(p["ib"]), "u": np.zeros_like(p["u"])}
    ds = q.T @ p["o"].T
    for g, r in _by_class(c):
        lo, hi = lexicon.bounds[g], lexicon.bounds[g + 1]
        if hi - lo > 1:
            own = s[r]
            y = _logits(own, p["i"][lo:hi], p["ib"][lo:hi])
            places = (w[r] - lo, np.arange(len(r)))
            loss -= float(y[places].sum())
            np.exp(y, out=y)
            total = y.sum(axis=0)
            loss += float(np.log(total).sum())
            y /= total
            y[places] -= 1
            y /= n
            grad["i"][lo:hi], grad["ib"][lo:hi] = y @ own, y.sum(axis=1)
            ds[r] += y.T @ p["i"][lo:hi]
    dstates = np.zeros((states.shape[0] * m, d), states.dtype)
    dstates[at] = ds
    dstates = dstates.reshape(-1, m, d)
    # What a state's gradient is multiplied by, for all steps at once; the loop only carries it from step to step.
    z, r, new = kept["z"], kept["r"], kept["n"]
    to_z = (kept["prev"] - new) * z * (1 - z)
    to_n = (1 - z) * (1 - new * new)
    to_r = to_n * kept["un"] * r * (1 - r)
    to_nu = to_n * r
    back = np.zeros((m, d), states.dtype)
    uz, ur, un = (np.ascontiguousarray(p["u"][:, k * d : (k + 1) * d].T) for k in range(3))
    for t in range(len(x) - 1, -1, -1):
        k = int(alive[t])
        dh = dstates[t, :k]
        dh += back[:k]
        more = (to_z[t, :k] * dh) @ uz
        more += (to_r[t, :k] * dh) @ ur
        more += (to_nu[t, :k] * dh) @ un
        more += dh * z[t, :k]
        more[fresh[t, :k]] = 0
        back[:k] = more
    for v in (to_z, to_r, to_n, to_nu):
        v *= dstates
    prev, to_z, to_r, to_n, to_nu = (v.reshape(-1, d) for v in (kept["prev"], to_z, to_r, to_n, to_nu))
    grad["u"] = np.concatenate([prev.T @ v for v in (to_z, to_r, to_nu)], axis=1)
    flat = np.concatenate([to_z, to_r, to_n], axis=1)
    grad["b"] = flat.sum(axis=0)
    ids = x.ravel()
    order = np.argsort(ids, kind="stable")
    first = np.flatnonzero(np.append(True, np.diff(ids[order]) != 0))
    grad["x"] = np.add.reduceat(flat[order], first, axis=0)
    return loss / n, grad, ids[order][first], n


def train(lexicon: Lexicon, p, docs, rate: float) -> tuple[dict[str, np.ndarray], int]:
    """One pass of truncated backpropagation with Adam over docs; the weights and the number of tokens."""
    p = {k: v.copy() for k, v in p.items()}
    if not docs:
        return p, 0
    x, klass, word, doc, fresh, alive = _grid(lexicon, docs, LANES)
    m1, m2 = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    h = np.zeros((x.shape[1], HIDDEN), np.float32)
    step, seen = 0, 0
    for a in range(0, len(x), WINDOW):
        m = int(alive[a])
        part = (v[a : a + WINDOW, :m] for v in (x, klass, word, doc, fresh))
        _, grad, rows, n = gradients(lexicon, p, *part, alive[a : a + WINDOW], h)
        norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
        scale = np.float32(min(1.0, 1.0 / max(norm, 1e-9)))
        step += 1
        seen += n
        pace = rate * n / (LANES * WINDOW)  # where few lanes are left, one document must not weigh as much as all lanes
        for k, g in grad.items():
            g *= scale
            if k == "x":  # rows not in this window stay as they are
                one, two = 0.9 * m1[k][rows] + 0.1 * g, 0.99 * m2[k][rows] + 0.01 * g * g
                m1[k][rows], m2[k][rows] = one, two
                p[k][rows] -= pace * one / (np.sqrt(two) + 1e-6)
            else:
                m1[k] += 0.1 * (g - m1[k])
                m2[k] += 0.01 * (g * g - m2[k])
                p[k] -= (pace / (1 - 0.9**step)) * m1[k] / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-6)
    return p, seen


def _dump(p) -> bytes:
    f = io.BytesIO()
    np.savez(f, **p)
    return f.getvalue()


def _load(b: bytes):
    with np.load(io.BytesIO(b)) as z:
        return {k: z[k] for k in z.files}


def _mean_weights(batches):
    """Running weighted sum of the weights that arrive; one row out."""
    total, n = None, 0
    for batch in batches:
        for w, k in zip(batch.column("weights").to_pylist(), batch.column("n").to_pylist(), strict=True):
            q = _load(w)
            total = {a: v.astype(np.float64) * k for a, v in q.items()} if total is None else {a: total[a] + v.astype(np.float64) * k for a, v in q.items()}
            n += k
    if n:
        yield pa.record_batch({"weights": pa.array([_dump({a: v / n for a, v in total.items()})], pa.binary()), "n": pa.array([n], pa.int64())})


def _partition_keys(spark, n: int) -> list[int]:
    """A key for each of n partitions that Spark's hash partitioning puts there, so that no two shards meet in one."""
    place = F.pmod(F.hash(F.col("id")), F.lit(n)).alias("place")
    rows = spark.range(40 * n + 100).groupBy(place).agg(F.min("id").alias("key")).collect()  # n rows at most
    return [r["key"] for r in rows]


def fit(docs: DataFrame, lexicon: Lexicon, rounds: int) -> tuple[dict[str, np.ndarray], int]:
    """Train on all docs (doc_id, text), split by hash into rounds and shards: the weights and the tokens learned from."""
    sc = docs.sparkSession.sparkContext
    p = lexicon.initial()
    learned = 0
    if lexicon.core == 0:
        return p, learned
    shards = max(1, round(lexicon.total / rounds / SHARD_TOKENS))
    keys = F.array(*map(F.lit, _partition_keys(docs.sparkSession, shards)))
    mark = F.pmod(F.xxhash64(F.lit("lm"), F.col("doc_id")), F.lit(rounds))
    words = sc.broadcast(lexicon)
    for k in range(rounds):
        start = sc.broadcast(p)
        rate = 0.01 / (1 + k)

        def run(batches, start=start, rate=rate):
            lex = words.value
            docs = []
            for batch in batches:
                docs += [lex.encode(t)[:2] for t in batch.column("text").to_pylist()]
            q, n = train(lex, start.value, docs, rate)
            if n:
                yield pa.record_batch({"weights": pa.array([_dump(q)], pa.binary()), "n": pa.array([n], pa.int64())})

        shard = F.get(keys, F.pmod(F.xxhash64("doc_id"), F.size(keys)).cast("int"))
        part = docs.where(mark == k).select("text", shard.alias("shard"))
        trained = part.repartition(shards, "shard").select("text").mapInArrow(run, "weights binary, n long")
        means = trained.repartition(max(1, shards // 64)).mapInArrow(_mean_weights, "weights binary, n long")
        rows = means.repartition(1).mapInArrow(_mean_weights, "weights binary, n long").collect()
        if rows:
            p = {a: v.astype(np.float32) for a, v in _load(rows[0]["weights"]).items()}
            learned += rows[0]["n"]
    return p, learned


def lexicon_of(counts: DataFrame, frequent: int) -> Lexicon:
    """The frequent words of a stored (word, c) table and the totals of the rest; frequent bounds what is fetched."""
    top = counts.where(F.col("word") != END).orderBy(F.desc("c"), "word").limit(frequent)
    rows = [(r["word"].encode(), r["c"]) for r in top.toLocalIterator()]
    sums = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v"), F.sum(F.when(F.col("word") == END, F.col("c"))).alias("ends")).first()
    rows.insert(0, (END.encode(), sums["ends"] or 0))
    words, number = [w for w, _ in rows], np.array([c for _, c in rows], np.int64)
    # Totals of the tail classes: all words, less those of the core.
    first = F.substring(F.encode("word", "UTF-8"), 1, 2)
    by = counts.where(F.col("word") != END).groupBy(F.pmod(F.crc32(first), F.lit(TAILS)).alias("g")).agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()
    tails = np.zeros((TAILS, 2))
    for r in by:
        tails[r["g"]] = (r["n"], r["v"])
    for w, c in rows[1 : CORE + 1]:
        tails[tail_class(w)] -= (c, 1)
    return Lexicon(words, number, tails, sums["n"] or 0, sums["v"] or 0)


def lm_scores(docs: DataFrame, training, id_column: str = "doc_id", text_column: str = "text", frequent: int = FREQUENT, rounds: int = ROUNDS) -> DataFrame:
    """Log probability of every whole text under the trained model, beside that of an add-one unigram model.

    training is a condition on doc_id: the rows to learn from. Returns doc_id, held_out (not learned from), n_tokens,
    n_known, train_tokens, base_score and score, one row for each row of docs. A null text is empty: its end token
    alone is scored. A null doc_id is held out. Without any training row the counts are all 0 and the model is the
    untrained one. Words beyond the frequent list are counted by a join. Very long texts are scored whole, those of
    a task together. Repeated rows are scored each; other columns are ignored.
    """
    sc = docs.sparkSession.sparkContext
    docs = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    learn = docs.where(F.coalesce(training, F.lit(False)))
    counts = stored(_token_counts(learn))
    lexicon = lexicon_of(counts, frequent)
    shared = sc.broadcast((lexicon, fit(learn, lexicon, rounds)[0]))

    def run(batches):
        lex, p = shared.value

        def scored(rows):
            """rows: of (row, doc_id, held_out, text)."""
            held = [lex.encode(r[3]) for r in rows]
            logs = score_docs(lex, p, [(at, c) for at, c, _ in held])
            n, known, base, score = [], [], [], []
            for (at, c, _), log in zip(held, logs.tolist(), strict=True):
                seen = at[at >= 0]
                tails = c[c >= CLASSES] - CLASSES
                own = at[(at >= 0) & (c >= CLASSES)]
                n.append(len(at))
                known.append(int((lex.counts[seen] > 0).sum()))
                base.append(float(lex.word_log[seen].sum() + len(at) * lex.base_log))
                score.append(float(log + lex.tail_log[tails].sum() + lex.word_log[own].sum()))
            flat = [w for *_, rare in held for w in rare]
            ends = np.cumsum([0, *(len(rare) for *_, rare in held)])
            return pa.record_batch({
                "row": pa.array([r[0] for r in rows], pa.int64()), "doc_id": pa.array([r[1] for r in rows], pa.int64()), "held_out": pa.array([r[2] for r in rows], pa.bool_()),
                "n_tokens": pa.array(n, pa.int64()), "n": pa.array(known, pa.int64()), "base": pa.array(base, pa.float64()), "own": pa.array(score, pa.float64()),
                "rare": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.binary()).cast(pa.string())),
            })

        short, size, long, waiting = [], 0, [], 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("row", "doc_id", "held_out")), batch.column("text"), strict=True):
                row = (*row[:3], row[3].as_py())
                k = len(row[3] or "")
                if k > LONG_BYTES:
                    long.append(row)
                    waiting += k
                else:
                    short.append(row)
                    size += k
                if waiting >= LONG_HELD:
                    yield scored(long)
                    long, waiting = [], 0
                if size >= SLICE_BYTES:
                    yield scored(short)
                    short, size = [], 0
        for rows in (short, long):
            if rows:
                yield scored(rows)

    held_out = ~F.coalesce(training, F.lit(False))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text", held_out.alias("held_out"))
    scored = stored(rows.mapInArrow(run, "row long, doc_id long, held_out boolean, n_tokens long, n long, base double, own double, rare array<string>"))
    # Words beyond the frequent list: their counts come by a join, once for each document that holds them.
    rare = scored.select("row", F.explode("rare").alias("word")).groupBy("word", "row").agg(F.count("*").alias("k"))
    found = rare.join(counts, "word").groupBy("row").agg(F.sum("k").alias("more"), F.sum(F.col("k") * F.log10(F.col("c") + 1)).alias("log"))
    log = F.coalesce("log", F.lit(0.0))
    return scored.join(found, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(lexicon.total).cast("long").alias("train_tokens"),
        (F.col("base") + log).alias("base_score"), (F.col("own") + log).alias("score"),
    )
