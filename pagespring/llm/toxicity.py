"""Toxic spans by a linear-chain conditional random field, and document scores.

Labels come for documents; token labels are derived from them: word beginnings that
are far likelier in documents labelled toxic than in clean ones, with enough support,
mark their words as toxic in the toxic documents.  On these labelled tokens a
two-label linear-chain CRF is trained (hashed word, prefix and suffix features, label
transitions) by its exact gradient.  Scoring runs forward-backward over every whole
text; the marginals give the toxic spans, and their sum and maximum, calibrated by
logistic regression on the training documents, give the document's score.

The model is fitted on all words of a bounded sample of the labelled rows (TOXIC_MOST and
CLEAN_MOST documents, those of the least hashes); scores use the text alone.

Defined results: a null or empty text gets the calibrated score of no toxic tokens;
a label that is null is no label, of several labels for a doc_id the larger counts;
without labels of both kinds the model is empty and every score is the share of toxic
labels; a null doc_id is scored and not held out; repeated rows are scored alike; an
empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import pickle
import re
import zlib
from array import array

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, leave, table
from .shingles import slices

TOXIC_MOST, CLEAN_MOST = 2500, 6000
BITS = 18
CACHE = 1_000_000
REJECT = 0.3
ROUNDS = 20  # of training; more fit the sample better and held-out documents worse
PIECE = 1024  # tokens of a chain that step together
SCALED = 8  # steps after which matrices are brought to size
WORD = re.compile(r"\w+")


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def word_features(word: str) -> list[int]:
    """Hashed features of one lower-case word: its beginnings, its end, itself."""
    marked = word + "$"
    names = {f"w{word}", *(f"p{marked[:n]}" for n in range(3, 7)), f"s{word[-3:]}"}
    return [zlib.crc32(x.encode()) >> (32 - BITS) for x in sorted(names)]


def beginnings(word: str) -> list[int]:
    """Hashes of a word's beginnings of 4 to 6 letters, its end counting as one, and of itself."""
    marked = word + "$"
    return [hash_of(x) for x in sorted({marked, *(marked[:n] for n in range(4, 7))})]


def hash_of(x: str) -> int:
    """63 bits that are the same everywhere."""
    data = x.encode()
    return zlib.crc32(data) << 31 ^ zlib.crc32(data[::-1], 0x9E3779B9)


def ragged(rows, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Rows of whole numbers laid end to end, and their limits."""
    flat, sizes = array(kind), array("i", [0])
    for r in rows:
        flat.extend(r)
        sizes.append(len(r))
    return np.frombuffer(flat, flat.typecode) if len(flat) else np.zeros(0, np.int64), np.cumsum(sizes)


def telling(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    """Which beginnings mark a word, by the documents of each kind that hold them: those at least
    20 times likelier in toxic documents, with some support."""
    return (toxic >= max(3, n_toxic // 200)) & ((toxic + 0.5) / (n_toxic + 1) >= 20 * (clean + 0.5) / (n_clean + 1))


def marked_words(vocabulary, words: np.ndarray, sizes: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Which words of the vocabulary begin tellingly; words: the documents' words, by place in it."""
    flat, limits = ragged(map(beginnings, vocabulary), "q")
    names, of = np.unique(flat, return_inverse=True)
    held = np.zeros((2, len(names)), np.int64)
    ends = np.cumsum(sizes)
    for end, n, y in zip(ends.tolist(), sizes.tolist(), toxic.tolist(), strict=True):
        own = np.unique(words[end - n : end])
        count = limits[own + 1] - limits[own]
        at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(limits[own], count)
        held[y, np.unique(of[at])] += 1
    marks = telling(held[1], held[0], int(toxic.sum()), int(len(toxic) - toxic.sum()))
    found = np.zeros(len(limits) - 1, bool)
    np.logical_or.at(found, np.repeat(np.arange(len(found)), np.diff(limits)), marks[of])
    return found


def _falling(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of sizes from the largest down, and how many of them reach past each step."""
    order = np.argsort(-sizes, kind="stable")
    longest = int(sizes[order[0]]) if len(order) else 0
    return order, np.searchsorted(-sizes[order], -np.arange(1, longest + 1), "right")


def _moved(m: tuple, r: np.ndarray) -> np.ndarray:
    """The ratio r of a vector's parts after a 2 x 2 matrix (m00, m01, m10, m11)."""
    return (m[2] + m[3] * r) / (m[0] + m[1] * r)


def chain_marginals(u: np.ndarray, sizes: np.ndarray, trans: np.ndarray, start: float, piece: int = PIECE) -> np.ndarray:
    """P(label 1) of every token of chains laid end to end.

    u: how much more label 1 scores than 0 at each token; trans[i, j]: the score of
    label j after i.  Exact forward-backward in ratios.  Chains are cut into pieces that all
    step together: what a piece does to a ratio is a 2 x 2 matrix, so the ratios at the cuts
    come from the pieces' matrices, and a chain of n tokens takes about n / piece + 4 * piece
    steps.
    """
    sizes = np.asarray(sizes, np.int64)
    e = np.clip(u, -30, 30)
    np.exp(e, out=e)
    a = np.exp(trans)
    forward, backward = np.empty(len(u)), np.empty(len(u))
    count = -(-sizes // piece)
    chain = np.repeat(np.arange(len(sizes)), count)
    k = np.arange(len(chain)) - np.repeat(np.cumsum(count) - count, count)
    lo = (np.cumsum(sizes) - sizes)[chain] + k * piece
    size = np.minimum(piece, sizes[chain] - k * piece)
    end = lo + size - 1
    final = k == count[chain] - 1
    by_k = np.argsort(k, kind="stable")
    at_k = np.split(by_k, np.searchsorted(k[by_k], np.arange(1, int(k.max()) + 1))) if len(k) else []

    def ahead(some: np.ndarray, r: np.ndarray | None) -> None:
        """Forward ratios of pieces from the ratio before them, or from the chain's start."""
        order, active = _falling(size[some])
        first = lo[some[order]]
        r = None if r is None else r[order]
        for t, n in enumerate(active):
            at = first[:n] + t
            q = None if r is None else r[:n]
            r = e[at] * np.exp(start) if q is None else e[at] * (a[0, 1] + q * a[1, 1]) / (a[0, 0] + q * a[1, 0])
            forward[at] = r

    if not len(k):
        return np.zeros(0)
    ahead(at_k[0], None)
    if len(at_k) > 1:
        # the matrices of whole pieces between a chain's first and last
        m = [np.ones(len(k)), np.zeros(len(k)), np.zeros(len(k)), np.ones(len(k))]
        inner = np.flatnonzero((k > 0) & ~final)
        x = [v[inner] for v in m]
        for t in range(piece if len(inner) else 0):
            g = e[lo[inner] + t]
            x = [a[0, 0] * x[0] + a[1, 0] * x[2], a[0, 0] * x[1] + a[1, 0] * x[3], g * (a[0, 1] * x[0] + a[1, 1] * x[2]), g * (a[0, 1] * x[1] + a[1, 1] * x[3])]
            if t % SCALED == 0:
                top = np.maximum(np.maximum(x[0], x[1]), np.maximum(x[2], x[3]))
                x = [v / top for v in x]
        for v, w in zip(m, x, strict=True):
            v[inner] = w
        before, after = np.zeros(len(k)), np.zeros(len(k))
        after[at_k[0]] = forward[end[at_k[0]]]
        for some in at_k[1:]:
            before[some] = after[some - 1]
            after[some] = _moved(tuple(v[some] for v in m), before[some])
        later = np.flatnonzero(k > 0)
        ahead(later, before[later])
    s = np.ones(len(k))  # the backward ratio at each piece's last token
    if len(at_k) > 1:
        later = np.flatnonzero(k > 0)
        order, active = _falling(size[later])
        some = later[order]
        x = [np.ones(len(some)), np.zeros(len(some)), np.zeros(len(some)), np.ones(len(some))]
        for t, n in enumerate(active):  # from the last token to the first
            g = e[end[some[:n]] - t]
            y = [v[:n] for v in x]
            y = [a[0, 0] * y[0] + a[0, 1] * g * y[2], a[0, 0] * y[1] + a[0, 1] * g * y[3], a[1, 0] * y[0] + a[1, 1] * g * y[2], a[1, 0] * y[1] + a[1, 1] * g * y[3]]
            if t % SCALED == 0:
                top = np.maximum(np.maximum(y[0], y[1]), np.maximum(y[2], y[3]))
                y = [v / top for v in y]
            for v, w in zip(x, y, strict=True):
                v[:n] = w
        m = [np.zeros(len(k)) for _ in range(4)]
        for v, w in zip(m, x, strict=True):
            v[some] = w
        for some in at_k[:0:-1]:
            s[some - 1] = _moved(tuple(v[some] for v in m), s[some])
    order, active = _falling(size)
    last = end[order]
    s = s[order]
    backward[last] = s
    for t in range(1, len(active)):
        n = active[t]
        at = last[:n] - t
        q = e[at + 1] * s[:n]
        s = (a[1, 0] + a[1, 1] * q) / (a[0, 0] + a[0, 1] * q)
        backward[at] = s
    forward *= backward
    backward[:] = forward
    backward += 1
    forward /= backward
    return forward


BLOCK = 1 << 19  # tokens whose expected transitions are added up together


def expected_transitions(p: np.ndarray, e: np.ndarray, a: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The expected counts of label pairs (before, at) under the marginals p."""
    total = np.zeros((2, 2))
    for lo in range(0, len(at), BLOCK):
        now = at[lo : lo + BLOCK]
        q, here, x = p[now - 1], p[now], e[now]
        # P(y_t = 1 | y_t-1) up to what follows, scaled to agree with p
        c1, c0 = a[1, 1] * x / (a[1, 1] * x + a[1, 0]), a[0, 1] * x / (a[0, 1] * x + a[0, 0])
        base = q * c1 + (1 - q) * c0
        scale1, scale0 = here / np.maximum(base, 1e-12), (1 - here) / np.maximum(1 - base, 1e-12)
        total += [[((1 - q) * (1 - c0) * scale0).sum(), ((1 - q) * c0 * scale1).sum()], [(q * (1 - c1) * scale0).sum(), (q * c1 * scale1).sum()]]
    return total


def train_chain(features, words: np.ndarray, labels: np.ndarray, sizes: np.ndarray, rounds: int = ROUNDS, l2: float = 1e-4) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights (the bias last), transitions and start score by the exact gradient (Adagrad steps).

    features: those of each distinct word; words: which of them each token is.
    """
    w, trans, start = np.zeros(1 << BITS), np.array([[2.0, -2.0], [0.0, 0.0]]), -2.0
    flat, limits = ragged(features, "i")
    many = len(limits) - 1
    of = np.repeat(np.arange(many, dtype=np.int32), np.diff(limits))
    bias = -2.0
    gw, gt, gs, gb = np.full(len(w), 1e-3), np.full((2, 2), 1e-3), 1e-3, 1e-3
    n = len(sizes)
    first = np.cumsum(sizes) - sizes
    inner = np.ones(len(labels), bool)
    inner[first] = False
    at = np.flatnonzero(inner).astype(np.int32)
    del inner
    pairs = np.bincount(2 * labels[at - 1].astype(np.int8) + labels[at], minlength=4).reshape(2, 2)
    for _ in range(rounds):
        u = np.bincount(of, w[flat], many) + bias
        p = chain_marginals(u[words], sizes, trans, start)
        expect = expected_transitions(p, np.exp(np.clip(u, -30, 30))[words], np.exp(trans), at)
        np.subtract(labels, p, out=p)  # what the labels hold beyond the marginals
        dw = np.bincount(flat, np.bincount(words, p, many)[of], len(w)) / n - l2 * w
        gw += dw * dw
        w += 0.5 * dw / np.sqrt(gw)
        dt = (pairs - expect) / n
        gt += dt * dt
        trans = trans + 0.1 * dt / np.sqrt(gt)
        ds, db = float(p[first].mean()), float(p.sum() / n)
        gs, gb = gs + ds * ds, gb + db * db
        start, bias = start + 0.1 * ds / np.sqrt(gs), bias + 0.1 * db / np.sqrt(gb)
    return np.append(w, bias), trans, start


class Model:
    """Word scores, transitions and calibration; small and the same on every executor."""

    def __init__(self, weights, trans, start, calibration) -> None:
        self.weights, self.trans, self.start, self.calibration = weights, trans, start, calibration
        self._forget()

    def _forget(self) -> None:
        # scores of known words by Python's hash of the word, 16 bytes each
        self._hashes, self._scores = np.zeros(0, np.int64), np.zeros(0)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}

    def __setstate__(self, state):
        self.__dict__ |= state
        self._forget()

    def score_words(self, words: list[str]) -> np.ndarray:
        import pyarrow as pa

        if len(self._hashes) > CACHE:
            self._forget()
        coded = pa.array(np.fromiter(map(hash, words), np.int64, len(words))).dictionary_encode()
        index, values = coded.indices.to_numpy(), coded.dictionary.to_numpy()
        by_hash = np.argsort(values)
        at = np.searchsorted(self._hashes, values[by_hash])
        scores, fresh = np.zeros(len(values)), np.ones(len(values), bool)
        if len(self._hashes):
            near = np.minimum(at, len(self._hashes) - 1)
            known = self._hashes[near] == values[by_hash]
            scores[by_hash] = np.where(known, self._scores[near], 0.0)
            fresh = ~known
        if fresh.any():
            once = np.zeros(len(values), np.int64)
            once[index[::-1]] = np.arange(len(index))[::-1]  # a value's first word
            new, bias = by_hash[fresh], self.weights[-1]
            scores[new] = np.fromiter((self.weights[word_features(words[k].lower())].sum() for k in once[new].tolist()), np.float64, len(new)) + bias
            self._hashes, self._scores = np.insert(self._hashes, at[fresh], values[new]), np.insert(self._scores, at[fresh], scores[new])
        return scores[index]

    def marginals(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """P(toxic) of the words of all texts, end to end, and the number of words of each."""
        words, sizes = [], []
        for t in texts:
            own = WORD.findall(t or "")
            sizes.append(len(own))
            words += own
        sizes = np.array(sizes, np.int64)
        u = self.score_words(words) if words else np.zeros(0)
        return chain_marginals(u, sizes[sizes > 0], self.trans, self.start), sizes

    def document_features(self, p: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        total, most = np.zeros(len(sizes)), np.zeros(len(sizes))
        full = np.flatnonzero(sizes)
        if len(full):
            cuts = (np.cumsum(sizes) - sizes)[full]
            total[full], most[full] = np.add.reduceat(p, cuts), np.maximum.reduceat(p, cuts)
        return np.stack([np.ones(len(sizes)), np.log1p(total), most], 1)

    def scores(self, p: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.document_features(p, sizes) @ self.calibration)))


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-3) -> np.ndarray:
    c = np.zeros(x.shape[1])
    for _ in range(30):  # Newton's steps
        p = 1 / (1 + np.exp(-np.clip(x @ c, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + l2 * np.eye(len(c)) * len(y)
        c = c + np.linalg.solve(h, x.T @ (y - p) - l2 * len(y) * c * np.array([0, *[1] * (len(c) - 1)]))
    return c


def fit_on(texts: list[str], toxic: np.ndarray) -> Model:
    """The model for labelled texts held in memory (a bounded sample)."""
    toxic = np.asarray(toxic, np.int64)
    prior = (toxic.sum() + 0.5) / (len(toxic) + 1) if len(toxic) else 0.0
    empty = Model(np.append(np.zeros(1 << BITS), -20.0), np.zeros((2, 2)), -5.0, np.array([np.log(max(prior, 1e-3) / (1 - min(prior, 0.999))), 0.0, 0.0]))
    if not 0 < toxic.sum() < len(toxic):
        return empty
    place: dict[str, int] = {}
    held, sizes = array("i"), []
    for t in texts:
        ws = WORD.findall((t or "").lower())
        held.extend(place.setdefault(w, len(place)) for w in ws)
        sizes.append(len(ws))
    words, sizes = np.frombuffer(held, np.int32), np.array(sizes, np.int64)
    marked = marked_words(place, words, sizes, toxic)
    labels = (marked[words] & np.repeat(toxic > 0, sizes)).astype(np.int8)
    weights, trans, start = train_chain(map(word_features, place), words, labels, sizes[sizes > 0])
    model = Model(weights, trans, start, empty.calibration)
    u = np.fromiter((weights[word_features(w)].sum() for w in place), np.float64, len(place)) + weights[-1]
    p = chain_marginals(u[words], sizes[sizes > 0], trans, start)
    model.calibration = logistic(model.document_features(p, sizes), toxic)
    return model


def fit(docs: DataFrame, labels: DataFrame, toxic_most: int = TOXIC_MOST, clean_most: int = CLEAN_MOST) -> Model:
    """The model from labels joined to docs, without the held-out rows."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.where(~held_out(F.col("doc_id")))
    sizes = dict(known.groupBy("toxic").count().collect())
    spread = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20))
    share = F.lit(0)
    for y, most in ((1, toxic_most), (0, clean_most)):
        n = sizes.get(y, 0)
        share = F.when(F.col("toxic") == y, min(1 << 20, -(-most * (1 << 20) // max(n, 1)))).otherwise(share)
    chosen = known.where(spread < share)  # about toxic_most + clean_most ids: small enough to broadcast
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic")

    def train(batches):
        import pyarrow as pa

        leave()
        texts, toxic = [], []
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                texts += batch.column(1).slice(at, 256).to_pylist()
            toxic += batch.column(2).to_pylist()
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit_on(texts, np.array(toxic)))], pa.binary())], ["model"])

    # the bounded sample is learnt in one task; only the model comes to the driver
    made = rows.repartition(1).sortWithinPartitions("doc_id", "text").mapInArrow(train, "model binary").first()
    return pickle.loads(made["model"]) if made else fit_on([], np.zeros(0))


def score(docs: DataFrame, model: Model, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The carried columns, score and spans (array of start, end in code points, p)."""
    bounded_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)
    carried = docs.select(*carry)

    def run(batches):
        import pyarrow as pa

        leave()
        model = held.value
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))
        for batch in batches:
            for at, to in slices(batch.column(len(carry)), 1024, 2 << 20):
                part = batch.slice(at, to - at)
                texts = part.column(len(carry)).to_pylist()
                p, sizes = model.marginals(texts)
                spans, ends = [], np.cumsum(sizes)
                for k, t in enumerate(texts):
                    own = p[ends[k] - sizes[k] : ends[k]]
                    found: list[dict] = []
                    if len(own) and own.max() >= 0.5:
                        last = -2
                        for n, m in enumerate(WORD.finditer(t)):
                            if own[n] >= 0.5:
                                if last == n - 1:  # neighbouring words are one span
                                    found[-1] |= {"end": m.end(), "p": max(found[-1]["p"], float(own[n]))}
                                else:
                                    found.append({"start": m.start(), "end": m.end(), "p": float(own[n])})
                                last = n
                    spans.append(found)
                kept = [part.column(k) for k in range(len(carry))]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(model.scores(p, sizes)), pa.array(spans, kind)], [*carry, "score", "spans"])

    schema = ", ".join([*(f"`{c}` {t}" for c, t in carried.dtypes), "score double", "spans array<struct<start:int,end:int,p:double>>"])
    return docs.select(*carry, F.col("text").alias("scored text")).mapInArrow(run, schema)


def rated(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = fit(docs, labels)
    return score(docs, model).select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= REJECT).cast("int").alias("predicted"),
        "spans",
    )


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    return rated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
