"""Toxicity by a bidirectional gated recurrent network with attention pooling.

A word's input is an embedding of the word and the means of embeddings of its byte n-grams and of
its beginnings; what fewer than a few documents of the sample have shares one embedding, so single
documents can't be learned by heart. A GRU reads each window of words in both directions, attention
pools its states, and a logistic unit scores the pool. Windows overlap by half and cover the whole
text, so every passage of up to half a window lies whole in one; a document's score is that of its
worst window. The network is trained in numpy from document labels: at first every window carries
its document's label, then only the window that scores highest (multiple-instance learning).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf

from . import textkernels as K
from .shared import crc_mod, read, small_batches

_BREAK = np.ones(256, bool)
for _a, _b in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _BREAK[_a:_b] = False
#: All digits are one: which number it is says nothing.
_DIGIT = np.arange(256, dtype=np.uint8)
_DIGIT[48:58] = 48
U64 = K.U64
TABLES = ("word", "char", "stem")


@dataclass(frozen=True)
class Params:
    """window, stride, train_stride: in words. buckets: the most entries of an embedding table;
    least_docs: documents of the sample that have what an entry stands for. The labelled sample has
    about toxic_docs and clean_docs rows at most, picked by a hash, all of texts of train_chars
    characters or fewer; longer texts teach nothing (they are scored whole)."""

    window: int = 40
    stride: int = 20
    train_stride: int = 32
    buckets: int = 1 << 13
    least_docs: int = 5
    word_dim: int = 8
    char_dim: int = 16
    stem_dim: int = 8
    hidden: int = 12
    attention: int = 8
    grams: tuple[int, ...] = (3, 4)
    stems: tuple[int, ...] = (5, 6, 7, 8)
    toxic_docs: int = 1500
    clean_docs: int = 3000
    train_chars: int = 12_000
    epochs: int = 5
    batch: int = 256
    rate: float = 6e-3
    decay: float = 3e-3
    clean_windows: int = 3
    seed: int = 7


class Batch:
    """Texts as word ids into the batch's distinct words, with each of these words' entries in the
    three tables: parts[table] has all words' entries in a row and how many each word has. Entries
    are 64-bit hashes until a vocabulary, the sorted hashes of each table, makes them places in it;
    place 0 is for all that it doesn't have."""

    def __init__(self, texts: pa.Array, p: Params, vocab: dict[str, np.ndarray] | None = None) -> None:
        buf = K.lowered(K.buffer_of(texts))
        buf = buf._replace(data=_DIGIT[buf.data])
        tok = K.spans(buf, _BREAK)
        h = K.span_hash(buf.data, tok.start, tok.end)
        self.key, at, self.ids = np.unique(h, return_index=True, return_inverse=True)
        self.count = tok.count
        start, end = tok.start[at], tok.end[at]
        one = np.ones(len(at), np.int64)
        self.parts = {"word": (self.key, one)}
        grams, owner = [], []
        for n in p.grams:
            size = np.maximum(end - start - n + 1, one if n == p.grams[0] else 0)
            who = np.repeat(np.arange(len(at)), size)
            begin = start[who] + np.arange(len(who)) - np.repeat(np.cumsum(size) - size, size)
            first = (begin == start[who]).astype(U64)  # a gram at the start of its word is another one
            grams.append(K.mix(K.span_hash(buf.data, begin, np.minimum(begin + n, end[who])) + first * U64(977)))
            owner.append(who)
        self.parts["char"] = self._rows(grams, owner, len(at))
        grams, owner = [], []
        for n in p.stems:
            who = np.flatnonzero((end - start >= n) | (n == p.stems[0]))
            grams.append(K.mix(K.span_hash(buf.data, start[who], np.minimum(start[who] + n, end[who])) + U64(31337)))
            owner.append(who)
        self.parts["stem"] = self._rows(grams, owner, len(at))
        if vocab is not None:
            self.number(vocab)

    @staticmethod
    def _rows(grams: list[np.ndarray], owner: list[np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray]:
        who = np.concatenate(owner)
        order = np.argsort(who, kind="stable")
        return np.concatenate(grams)[order], np.bincount(who, minlength=n)

    def number(self, vocab: dict[str, np.ndarray]) -> None:
        for t, (keys, n) in self.parts.items():
            known = vocab[t]
            at = np.searchsorted(known, keys)
            hit = known[np.minimum(at, len(known) - 1)] == keys if len(known) else np.zeros(len(keys), bool)
            self.parts[t] = (np.where(hit, at + 1, 0), n)

    @classmethod
    def of_many(cls, texts: pa.Array, p: Params) -> Batch:
        """One batch of many texts, made from small ones, so that the byte passes stay small."""
        made = [cls(x, p) for x in K.slices(texts, 1 << 20)]
        out = cls.__new__(cls)
        out.key, at, back = np.unique(np.concatenate([x.key for x in made]), return_index=True, return_inverse=True)
        shift = np.cumsum([0, *(len(x.key) for x in made)])
        out.ids = np.concatenate([back[k + x.ids] for k, x in zip(shift, made, strict=False)])
        out.count = np.concatenate([x.count for x in made])
        out.parts = {}
        for t in made[0].parts:
            buckets, n = (np.concatenate([x.parts[t][k] for x in made]) for k in (0, 1))
            out.parts[t] = (buckets[spread(np.cumsum(n) - n, n, at)], n[at])
        return out

    def embed(self, w: dict[str, np.ndarray]) -> np.ndarray:
        """Inputs of the distinct words: the means of their buckets in each table, side by side."""
        out = []
        for t, (buckets, n) in self.parts.items():
            mean, begin = np.empty((len(n), w[t].shape[1]), w[t].dtype), np.concatenate([[0], np.cumsum(n)])
            for i in range(0, len(n), 20_000):
                j = min(i + 20_000, len(n))
                mean[i:j] = np.add.reduceat(w[t][buckets[begin[i] : begin[j]]], begin[i:j] - begin[i], axis=0) / n[i:j, None]
            out.append(mean)
        return np.concatenate(out, axis=1)

    def windows(self, p: Params, stride: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(row, first word) of every window; the first word counts from the batch's start."""
        stride = stride or p.stride
        n = np.where(self.count > p.window, -(-(self.count - p.window) // stride) + 1, np.minimum(self.count, 1))
        row = np.repeat(np.arange(len(n)), n)
        k = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        begins = np.cumsum(self.count) - self.count
        return row, begins[row] + k * stride

    def cut(self, row: np.ndarray, begin: np.ndarray, p: Params) -> np.ndarray:
        """Word ids of windows, -1 past the text's end."""
        ends = np.cumsum(self.count)[row]
        at = begin[:, None] + np.arange(p.window)[None, :]
        return np.where(at < ends[:, None], self.ids[np.minimum(at, max(len(self.ids) - 1, 0))], -1)


def spread(begin: np.ndarray, n: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Positions of all entries of some rows, in the rows' order."""
    size = n[rows]
    return np.repeat(begin[rows], size) + np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)


def init(p: Params, vocab: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(p.seed)
    d, h = p.word_dim + p.char_dim + p.stem_dim, p.hidden
    rows = {t: len(vocab[t]) + 1 for t in TABLES}
    w = {"word": rng.normal(0, 0.1, (rows["word"], p.word_dim)), "char": rng.normal(0, 0.3, (rows["char"], p.char_dim)), "stem": rng.normal(0, 0.1, (rows["stem"], p.stem_dim)), "wa": rng.normal(0, 0.3, (2 * h, p.attention)), "va": rng.normal(0, 0.3, p.attention), "out": rng.normal(0, 0.3, 2 * h), "bias": np.zeros(1)}
    for way in "fb":
        w[f"x{way}"], w[f"u{way}"], w[f"b{way}"] = rng.normal(0, 0.3, (d, 3 * h)), rng.normal(0, 0.3, (h, 3 * h)), np.zeros(3 * h)
    return {k: v.astype(np.float32) for k, v in w.items()}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(0.5) * np.tanh(np.float32(0.5) * x) + np.float32(0.5)


def _gru(gates: np.ndarray, u: np.ndarray, ids: np.ndarray, mask: np.ndarray, backward: bool, keep: bool):
    """States of one direction, and what the backward pass needs. gates: by word, a last row of zeros."""
    b, t = ids.shape
    h = u.shape[0]
    state = np.zeros((b, h), np.float32)
    out = np.zeros((t, b, h), np.float32)
    trace = []
    for k in range(t - 1, -1, -1) if backward else range(t):
        x = gates[ids[:, k]]
        g = state @ u
        zr = _sigmoid(x[:, : 2 * h] + g[:, : 2 * h])
        z, r = zr[:, :h], zr[:, h:]
        n = np.tanh(x[:, 2 * h :] + r * g[:, 2 * h :])
        m = mask[k]
        new = n + z * (state - n)
        if m is not None:
            new = np.where(m, new, state)
        if keep:
            trace.append((k, state, z, r, n, g[:, 2 * h :]))
        state = new
        out[k] = state
    return out, trace


class Network:
    def __init__(self, p: Params, weights: dict[str, np.ndarray], vocab: dict[str, np.ndarray]) -> None:
        self.p, self.w, self.vocab = p, weights, vocab

    def gates(self, e: np.ndarray) -> dict[str, np.ndarray]:
        zero = np.zeros((1, 3 * self.p.hidden), np.float32)
        return {way: np.concatenate([e @ self.w[f"x{way}"] + self.w[f"b{way}"], zero]).astype(np.float32) for way in "fb"}

    def forward(self, gates: dict[str, np.ndarray], ids: np.ndarray, keep: bool = False):
        w = self.w
        live = ids >= 0
        whole = live.all(axis=0)
        mask = [None if whole[k] else live[:, k, None] for k in range(ids.shape[1])]
        f, tf = _gru(gates["f"], w["uf"], ids, mask, False, keep)
        b, tb = _gru(gates["b"], w["ub"], ids, mask, True, keep)
        states = np.concatenate([f, b], axis=2)  # window, batch, 2 hidden
        a = np.tanh(states @ w["wa"])
        s = np.where(live.T, a @ w["va"], np.float32(-1e9))
        s = np.exp(s - s.max(axis=0))
        s /= s.sum(axis=0)
        pool = np.einsum("tb,tbh->bh", s, states)
        logit = pool @ w["out"] + w["bias"][0]
        return logit, ((live, states, a, s, pool, tf, tb) if keep else None)

    def score(self, batch: Batch, most: int = 2048, stride: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, first word, logit) of every window of a batch."""
        row, begin = batch.windows(self.p, stride)
        gates = self.gates(batch.embed(self.w))
        out = [self.forward(gates, batch.cut(row[i : i + most], begin[i : i + most], self.p))[0] for i in range(0, len(row), most)]
        return row, begin, np.concatenate(out) if out else np.zeros(0, np.float32)

    def gradient(self, batch: Batch, e: np.ndarray, ids: np.ndarray, label: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        w, h = self.w, self.p.hidden
        logit, (live, states, a, s, pool, tf, tb) = self.forward(self.gates(e), ids, keep=True)
        dl = (weight * (_sigmoid(logit) - label)).astype(np.float32)
        g = {"out": pool.T @ dl, "bias": np.array([dl.sum()], np.float32)}
        dpool = dl[:, None] * w["out"]
        dstates = s[:, :, None] * dpool[None]
        ds = np.einsum("bh,tbh->tb", dpool, states)
        ds = s * (ds - (s * ds).sum(axis=0))
        ds[~live.T] = 0
        g["va"] = np.einsum("tb,tbk->k", ds, a)
        da = ds[:, :, None] * w["va"] * (1 - a * a)
        flat = states.reshape(-1, 2 * h)
        g["wa"] = flat.T @ da.reshape(-1, da.shape[2])
        dstates += da @ w["wa"].T
        de = np.zeros((len(e), e.shape[1]), np.float32)
        for way, trace, ds_way in (("f", tf, dstates[:, :, :h]), ("b", tb, dstates[:, :, h:])):
            u, dh = w[f"u{way}"], np.zeros((len(ids), h), np.float32)
            g[f"u{way}"], g[f"x{way}"], g[f"b{way}"] = np.zeros_like(u), np.zeros_like(w[f"x{way}"]), np.zeros(3 * h, np.float32)
            words, grads = [], []
            for k, before, z, r, n, hn in reversed(trace):
                dh = dh + ds_way[k]
                on = live[:, k, None]
                d = np.where(on, dh, 0)
                dn = d * (1 - z) * (1 - n * n)
                dz = d * (before - n) * z * (1 - z)
                dr = dn * hn * r * (1 - r)
                dg = np.concatenate([dz, dr, dn * r], axis=1)
                g[f"u{way}"] += before.T @ dg
                dh = np.where(on, d * z + dg @ u.T, dh)
                words.append(ids[:, k])
                grads.append(np.concatenate([dz, dr, dn], axis=1))
            words, grads = np.concatenate(words), np.concatenate(grads)
            ok = words >= 0
            words, grads = words[ok], grads[ok]
            order = np.argsort(words, kind="stable")
            words, grads = words[order], grads[order]
            first = np.flatnonzero(np.concatenate([[True], words[1:] != words[:-1]]))
            per_word = np.add.reduceat(grads, first, axis=0)
            used = words[first]
            g[f"x{way}"] = e[used].T @ per_word
            g[f"b{way}"] = per_word.sum(axis=0)
            de[used] += per_word @ w[f"x{way}"].T
        used, at = np.flatnonzero(np.abs(de).sum(axis=1) > 0), 0
        for t, (buckets, n) in batch.parts.items():
            g[t] = np.zeros_like(w[t])
            share = de[used, at : at + w[t].shape[1]] / n[used][:, None]
            at += w[t].shape[1]
            to, of = buckets[spread(np.cumsum(n) - n, n, used)], np.repeat(np.arange(len(used)), n[used])
            if not len(to):
                continue
            order = np.argsort(to, kind="stable")
            to = to[order]
            first = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
            g[t][to[first]] = np.add.reduceat(share[of[order]], first, axis=0)
        return g


class Adam:
    def __init__(self, w: dict[str, np.ndarray], rate: float, decay: float) -> None:
        self.w, self.rate, self.decay, self.n = w, rate, decay, 0
        self.start = {k: w[k].copy() for k in TABLES}
        self.m = {k: np.zeros_like(v) for k, v in w.items()}
        self.v = {k: np.zeros_like(v) for k, v in w.items()}

    def step(self, g: dict[str, np.ndarray]) -> None:
        self.n += 1
        norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
        scale = min(1.0, 5.0 / (norm + 1e-9))
        rate = self.rate * np.sqrt(1 - 0.999**self.n) / (1 - 0.9**self.n)
        for k, x in g.items():
            x = x * np.float32(scale)
            self.m[k] += np.float32(0.1) * (x - self.m[k])
            self.v[k] += np.float32(0.001) * (x * x - self.v[k])
            self.w[k] -= (rate * self.m[k] / (np.sqrt(self.v[k]) + 1e-8)).astype(np.float32)
            if k in self.start:  # buckets that few windows touched go back to where they were
                self.w[k] -= np.float32(self.decay) * (self.w[k] - self.start[k])


def learn_entries(batch: Batch, y: np.ndarray, p: Params) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    """The vocabulary of each table, and each entry's standardised log odds between toxic and clean
    documents. Entries are what least_docs documents have; of more than the table holds, those with
    the largest odds, then the smallest hashes, stay."""
    toxic, clean = float(y.sum()), float(len(y) - y.sum())
    pairs = np.unique(np.repeat(np.arange(len(batch.count)), batch.count) * len(batch.key) + batch.ids)
    cuts = np.searchsorted(pairs, np.arange(0, len(batch.count) + 200, 200) * len(batch.key))
    vocab, odds = {}, {}
    for t, (keys, n) in batch.parts.items():
        known, place = np.unique(keys, return_inverse=True)
        seen = np.zeros((2, len(known)))
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):  # whole documents, 200 at a time
            doc, word = np.divmod(pairs[i:j], len(batch.key))
            once = np.unique(np.repeat(doc, n[word]) * len(known) + place[spread(np.cumsum(n) - n, n, word)])
            doc, entry = np.divmod(once, max(len(known), 1))
            for k in (0, 1):
                seen[k] += np.bincount(entry[y[doc] == k], minlength=len(known))
        b, a = seen
        z = (np.log((a + 0.5) / (toxic - a + 0.5)) - np.log((b + 0.5) / (clean - b + 0.5))) / np.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
        often = np.flatnonzero(a + b >= p.least_docs)
        best = np.sort(often[np.lexsort((often, -np.abs(z[often])))[: p.buckets]])
        vocab[t], odds[t] = known[best], z[best]
    return vocab, odds


def prior(w: dict[str, np.ndarray], odds: dict[str, np.ndarray]) -> None:
    """Start the first embedding dimension of every entry at its standardised log odds, less what
    chance alone gives."""
    for t, z in odds.items():
        w[t][:, 0] = 0
        w[t][1:, 0] = np.clip(np.sign(z) * np.maximum(np.abs(z) - 1.5, 0) / 2, -2, 2)


def fit(texts: list[str], labels: list[int], p: Params = Params(), with_prior: bool = True) -> Network | None:
    """A network for labelled texts; None unless both labels occur."""
    y = np.array(labels, np.float32)
    if len(set(labels)) < 2:
        return None
    rng = np.random.default_rng(p.seed)
    batch = Batch.of_many(pa.array(texts, pa.string()), p)
    keep = batch.count > 0
    if len(set(y[keep].tolist())) < 2:
        return None
    vocab, odds = learn_entries(batch, y, p)
    batch.number(vocab)
    net = Network(p, init(p, vocab), vocab)
    if with_prior:
        prior(net.w, odds)
    adam = Adam(net.w, p.rate, p.decay)
    row, begin = batch.windows(p, p.train_stride)
    ids = batch.cut(row, begin, p)
    n = np.bincount(row, minlength=len(texts))
    balance = np.where(y == 1, 0.5 / max(y[keep].mean(), 1e-6), 0.5 / max(1 - y[keep].mean(), 1e-6)).astype(np.float32)
    for epoch in range(p.epochs):
        adam.rate = p.rate * (1 - 0.8 * epoch / p.epochs)
        if epoch < 2:
            weight = balance[row] / np.sqrt(n[row])
            pick = np.flatnonzero(rng.random(len(row)) < np.minimum(1, 4 / n[row]))
        else:
            logit = net.score(batch, stride=p.train_stride)[2]
            order = np.lexsort((-logit, row))
            place = np.arange(len(row)) - (np.cumsum(n) - n)[row[order]]
            worst = order[place < np.where(y[row[order]] == 1, 1, p.clean_windows)]  # one window of a toxic document, a few of a clean one
            pick, weight = worst, balance[row]
        pick = rng.permutation(pick)
        size = min(p.batch, max(32, len(pick) // 24))  # small samples take enough steps too
        for i in range(0, len(pick), size):
            j = pick[i : i + size]
            part, local = _restrict(batch, ids[j])
            g = net.gradient(part, part.embed(net.w), local, y[row[j]], weight[j] / size)
            adam.step(g)
    return net


class _Part(Batch):
    def __init__(self, parts: dict[str, tuple[np.ndarray, np.ndarray]]) -> None:
        self.parts = parts


def _restrict(batch: Batch, ids: np.ndarray) -> tuple[_Part, np.ndarray]:
    """The words of some windows alone, and the windows' ids into them."""
    used, local = np.unique(ids, return_inverse=True)
    local = local.reshape(ids.shape)
    if len(used) and used[0] == -1:
        used, local = used[1:], local - 1
    return _Part({t: (buckets[spread(np.cumsum(n) - n, n, used)], n[used]) for t, (buckets, n) in batch.parts.items()}), local


def train(docs: DataFrame, labels: DataFrame, p: Params = Params()) -> Network | None:
    """Fit on docs(doc_id, text) and labels(doc_id, toxic 0/1). A hash of the id picks about
    toxic_docs and clean_docs labelled rows; rows with nulls, and texts longer than train_chars,
    teach nothing. Of labels that repeat an id the largest counts; repeated documents count as often
    as they stand. None without texts of both labels."""
    one = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in one.groupBy("toxic").count().collect()}
    if len(counts) < 2:
        return None
    place = F.pmod(F.xxhash64("doc_id", F.lit(29)), F.lit(1 << 30))
    share = lambda k, most: int((1 << 30) * min(1.0, most / counts[k]))
    picked = one.where(((F.col("toxic") == 1) & (place < share(1, p.toxic_docs))) | ((F.col("toxic") == 0) & (place < share(0, p.clean_docs))))
    text = F.col("text").cast("string")
    rows = docs.where("text IS NOT NULL").join(F.broadcast(picked), "doc_id").where(F.length("text") <= p.train_chars).select("doc_id", "toxic", text.alias("text")).collect()
    rows = sorted(rows, key=lambda r: (r["doc_id"], r["text"]))
    return fit([r["text"] for r in rows], [r["toxic"] for r in rows], p)


def score_texts(net: Network | None, texts: pa.Array) -> np.ndarray:
    """Score of each text: of its worst window, 0 without a word or a network."""
    out = []
    for part in K.slices(texts, 1 << 20):
        best = np.full(len(part), -np.inf, np.float32)
        if net is not None:
            row, _, logit = net.score(Batch(part, net.p, net.vocab))
            np.maximum.at(best, row, logit)
        out.append(np.where(np.isfinite(best), 1 / (1 + np.exp(-best.astype(np.float64))), 0.0))
    return np.concatenate(out)


def rate(docs: DataFrame, net: Network | None, into: str = "toxicity") -> DataFrame:
    """docs(text, ...) with a double column `into`.

    Null and empty texts, texts without a word, and all texts if there is no network, score 0. Very
    long texts are scored in all of their windows; of equal windows it doesn't matter which. Repeated
    rows score alike. An empty table stays empty. Other columns stay, and one that is called like
    `into` gives way.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)
    small_batches(docs.sparkSession)

    @arrow_udf("double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array(score_texts(shared.value, texts), pa.float64())

    return docs.withColumn(into, run(F.col("text").cast("string")))


def op3_recurrent_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score, learned from the labels of those that aren't held out; rows with a
    null id are not held out and teach nothing."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False))
    net = train(docs.where(~held), read(spark, sf_dir, "labels").where(~held))
    rated = rate(docs.withColumn("held_out", held), net, "score")
    return rated.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
