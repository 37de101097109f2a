"""LM scoring: a log-bilinear neural model trained with noise-contrastive estimation.

All training words are modelled, in two steps. The first predicts a word's id from the ids of the two words before it:
frequent words have ids of their own, all others the id of their class, which their form (ending and length) names. The
second predicts the word inside its class from the word before it: its add-one share of the class times a log-bilinear
factor of hashed vectors of its beginning, its end and its whole form. Both steps are trained in numpy by
noise-contrastive estimation over all tokens of all training documents, in rounds: every task runs mini-batches over
its own part from the same parameters, and the weighted mean of the parts, taken in a tree, is the next round's start.
There are as many parts as the input has, and counts, classes' words and tokens learnt from grow with the input; the
parameters' number is fixed. Both steps' normalisers are batched matrix products, over all pairs of ids and over all
words of the corpus; a token's log-probability is then exact.

Texts are read once: a chunk of documents is stored as its distinct words and its tokens' places among them. Chunks'
words meet by the word itself, and their counts go back to their chunks, so no table of all words is broadcast or held
by one task.

Defined cases: a null or wordless text is one end token; no training documents give N = V = 0 and the untrained model;
words not met in training share one place in their class; rows are scored one by one, so repeated rows, null ids (they
are held in: crc32 of the empty text) and extra columns change nothing; an empty table gives an empty table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialise

FOLDS, HELD_FOLD = 7, 2
#: Parameters of the model; they don't depend on the input.
TOP = 800  # frequent words with an id of their own; id 0 is the end
CLASSES = 223  # of all other words
DIMENSIONS, INNER = 16, 8  # of the first and the second step
HEADS, REST = 128, 32  # words before, of the second step: most frequent ids, and groups of all other ids
FORMS = 1 << 13  # hashed vectors of the second step
NOISE, INNER_NOISE = 48, 2
BATCH = 4096
ROUNDS = 3  # each over its third of the documents
RATE = 0.06
FAN = 32  # parts merged at once
CHUNK_BYTES = 16 << 20
END = b"\n"  # no word holds a line end
STEP = 200_000  # tokens scored at once


def held_out(doc_id) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS == HELD_FOLD


# documents as chunks of words and tokens


class Places(dict):
    """word -> its place among the chunk's words; the end is the first."""

    def __init__(self):
        super().__init__({END: 0})

    def __missing__(self, word: bytes) -> int:
        at = self[word] = len(self)
        return at


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    chunk = TaskContext.get().partitionId() << 32
    places, ids, tokens, held = Places(), [], [], 0
    for b in batches:
        for i, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            words = text.as_py().lower().split()
            words.append(END)
            tokens.append(np.fromiter(map(places.__getitem__, words), np.int32, len(words)))
            ids.append(i)
            held += 8 + len(text.as_buffer() or b"")
            if held >= CHUNK_BYTES:
                yield _chunk(chunk, places, ids, tokens)
                places, ids, tokens, held = Places(), [], [], 0
                chunk += 1
    if ids:
        yield _chunk(chunk, places, ids, tokens)


def _chunk(chunk: int, places: Places, ids: list, tokens: list[np.ndarray]) -> pa.RecordBatch:
    """One row; a token takes three bytes, or four where the chunk has too many words."""
    learnt = [t for i, t in zip(ids, tokens, strict=True) if not held_out(i)]
    n = np.bincount(np.concatenate(learnt), minlength=len(places)) if learnt else np.zeros(len(places), np.int64)
    width = 3 if len(places) < 1 << 24 else 4
    packed = np.concatenate(tokens).astype("<u4").view(np.uint8).reshape(-1, 4)[:, :width].tobytes()
    row = {"chunk": chunk, "ids": ids, "sizes": [len(t) for t in tokens], "tokens": packed, "words": list(places), "n": n.tolist()}
    return pa.RecordBatch.from_arrays([pa.array([row[f.name]], f.type) for f in CHUNK], schema=CHUNK)


CHUNK = pa.schema([("chunk", pa.int64()), ("ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("tokens", pa.binary()), ("words", pa.list_(pa.binary())), ("n", pa.list_(pa.int32()))])


class Chunk:
    """A stored chunk: doc ids, first token of each document, tokens as places, and the words."""

    def __init__(self, table, row: int):
        get = lambda name: table.column(name)[row]
        self.ids = get("ids").as_py()
        sizes = get("sizes").values.to_numpy()
        self.first = np.cumsum(sizes) - sizes
        raw = np.frombuffer(get("tokens").as_buffer(), np.uint8).reshape(int(sizes.sum()), -1)
        wide = np.zeros((len(raw), 4), np.uint8)
        wide[:, : raw.shape[1]] = raw
        self.tokens = wide.view("<i4")[:, 0]
        self.words = get("words").values

    def before(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the word before last and of the last word of each token; the end stands before a text."""
        last = np.roll(ids, 1)
        last[self.first] = 0
        two = np.roll(last, 1)
        two[self.first] = 0
        return two, last


def _mixed(parts: list[np.ndarray], salt: int) -> np.ndarray:
    h = np.full(parts[0].shape, salt, np.uint64)
    for p in parts:
        h = (h ^ p.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def forms(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Class, and the three hashed vectors, of each word by its first and last bytes and its length."""
    buffers = words.buffers()
    offsets = np.frombuffer(buffers[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    data = np.concatenate([np.frombuffer(buffers[2] or b"", np.uint8), np.zeros(1, np.uint8)])
    low, high = offsets[:-1], offsets[1:]
    start = [np.where(low + k < high, data[np.minimum(low + k, len(data) - 1)], 0) for k in range(6)]
    end = [np.where(high - 1 - k >= low, data[np.maximum(high - 1 - k, 0)], 0) for k in range(6)]
    size = np.minimum(high - low, 255)
    kind = _mixed([end[0], end[1], np.minimum(size, 12) // 4], 1) % np.uint64(CLASSES)
    vectors = [_mixed(start[:3], 2), _mixed(end[:3], 3), _mixed([*start, *end, size], 4)]
    return kind.astype(np.int64), np.stack([(x % np.uint64(FORMS)).astype(np.int64) for x in vectors], axis=1)


def word_ids(words: pa.Array, top: pa.Array, kinds: np.ndarray) -> np.ndarray:
    """First-step id of each word: 0 the end, then the top words, then the classes."""
    listed = pc.index_in(words, value_set=top).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    ids = np.where(listed >= 0, listed + 1, 1 + len(top) + kinds).astype(np.int32)
    ids[pc.equal(words, pa.scalar(END, words.type)).to_numpy(zero_copy_only=False)] = 0
    return ids


# the model


class LogBilinear:
    """First step: score(w | u, v) = (R[u] * c0 + R[v] * c1) . Q[w] + bias[w]. Second: (c + 1) exp(inner[v] . forms[w])."""

    NAMES = ("R", "Q", "c", "bias", "inner", "form")

    def __init__(self, log_share: np.ndarray, top: int):
        rng, size = np.random.default_rng(7), len(log_share)
        self.top, self.log_share = top, log_share.astype(np.float32)
        self.R, self.Q = (rng.normal(0, 0.1, (size, DIMENSIONS)).astype(np.float32) for _ in range(2))
        self.c, self.bias = np.ones((2, DIMENSIONS), np.float32), self.log_share.copy()
        self.inner, self.form = (rng.normal(0, 0.1, (k, INNER)).astype(np.float32) for k in (HEADS + REST, FORMS))
        self.spread = {k: np.full(getattr(self, k).shape, 1e-10, np.float32) for k in self.NAMES}

    def packed(self) -> np.ndarray:
        return np.concatenate([getattr(self, k).ravel() for k in self.NAMES]).astype(np.float64)

    def unpack(self, flat: np.ndarray) -> LogBilinear:
        at = 0
        for k in self.NAMES:
            old = getattr(self, k)
            setattr(self, k, flat[at : at + old.size].reshape(old.shape).astype(np.float32))
            at += old.size
        return self

    def step(self, rate: float, **gradients: np.ndarray) -> None:
        for k, d in gradients.items():
            d = d.astype(np.float32)  # else the parameters would turn double
            self.spread[k] += d * d
            setattr(self, k, getattr(self, k) + rate * d / np.sqrt(self.spread[k]))

    def train(self, u: np.ndarray, v: np.ndarray, w: np.ndarray, rng: np.random.Generator, rate: float) -> None:
        """One mini-batch of the first step: data against noise words drawn by their share."""
        size, share = len(self.bias), np.exp(self.log_share.astype(np.float64))
        noise, log_k = rng.choice(size, NOISE, p=share / share.sum()), float(np.log(NOISE))  # a Python number keeps single precision
        q = self.R[u] * self.c[0] + self.R[v] * self.c[1]
        target = self.Q[w]
        g = 1 - _sigmoid(_dots(q, target) + (self.bias - self.log_share)[w] - log_k)
        g_noise = -_sigmoid(q @ self.Q[noise].T + (self.bias - self.log_share)[noise] - log_k)
        dq = g[:, None] * target + g_noise @ self.Q[noise]
        dQ, db = _rows_sum(w, g[:, None] * q, size), np.bincount(w, g, size)
        np.add.at(dQ, noise, g_noise.T @ q)
        np.add.at(db, noise, g_noise.sum(0))
        dR = _rows_sum(np.concatenate([u, v]), np.concatenate([dq * self.c[0], dq * self.c[1]]), size)
        dc = np.stack([np.einsum("ij,ij->j", dq, self.R[u]), np.einsum("ij,ij->j", dq, self.R[v])])
        self.step(rate, R=dR / len(w), Q=dQ / len(w), c=dc / len(w), bias=db / len(w))

    def train_inner(self, v: np.ndarray, own: np.ndarray, noise: np.ndarray, rate: float) -> None:
        """One mini-batch of the second step: own and noise hold words' vectors, noise drawn by the words' shares of the class."""
        a, log_k = self.inner[v], float(np.log(INNER_NOISE))
        dv, at, rows = np.zeros_like(a), [], []
        for vectors, real in [(own, 1), *((noise[:, k], 0) for k in range(INNER_NOISE))]:
            s = self.word_vectors(vectors)
            g = (real - _sigmoid(_dots(a, s) - log_k))[:, None]
            dv += g * s
            at.append(vectors.ravel())
            rows.append(np.repeat(g * a, vectors.shape[1], axis=0))
        self.step(rate, inner=_rows_sum(v, dv, len(self.inner)) / len(v), form=_rows_sum(np.concatenate(at), np.concatenate(rows), FORMS) / len(v))

    def word_vectors(self, vectors: np.ndarray) -> np.ndarray:
        return self.form[vectors[:, 0]] + self.form[vectors[:, 1]] + self.form[vectors[:, 2]]

    def learn(self, chunk: Chunk, top: pa.Array, k: int, rng: np.random.Generator, rate: float) -> int:
        """Mini-batches over all tokens of the chunk's training documents of round k; returns how many there are."""
        kinds, vectors = forms(chunk.words)
        ids = word_ids(chunk.words, top, kinds)[chunk.tokens]
        u, v = chunk.before(ids)
        taken = np.array([not held_out(i) and j % ROUNDS == k for j, i in enumerate(chunk.ids)])
        places = np.flatnonzero(np.repeat(taken, np.diff(chunk.first, append=len(ids))))
        tail = places[ids[places] > self.top]
        tail = tail[np.argsort(ids[tail], kind="stable")]  # by class, for the noise
        starts, ends = (np.searchsorted(ids[tail], ids[tail], side=s) for s in ("left", "right"))
        rng.shuffle(places)
        for at in range(0, len(places), BATCH):
            p = places[at : at + BATCH]
            self.train(u[p], v[p], ids[p], rng, rate)
        order = rng.permutation(len(tail))
        for at in range(0, len(order), BATCH):
            p = order[at : at + BATCH]
            drawn = starts[p, None] + (rng.random((len(p), INNER_NOISE)) * (ends - starts)[p, None]).astype(np.int64)
            self.train_inner(heads(v[tail[p]]), vectors[chunk.tokens[tail[p]]], vectors[chunk.tokens[tail[drawn]]], rate)
        return len(places)

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """score(w | u, v) as A[u, w] + B[v, w], and the log of its summed exponentials for each (u, v): matrix products."""
        a = (self.R * self.c[0]).astype(np.float64) @ self.Q.T + self.bias
        b = (self.R * self.c[1]).astype(np.float64) @ self.Q.T
        top_a, top_b = a.max(1, keepdims=True), b.max(1, keepdims=True)
        norm = np.log(np.exp(a - top_a) @ np.exp(b - top_b).T) + top_a + top_b.T
        return a.astype(np.float32), b.astype(np.float32), norm.astype(np.float32)

    def factors(self, vectors: np.ndarray) -> np.ndarray:
        """exp(inner[v] . forms) of words (rows) for all words before (columns)."""
        return np.exp(np.clip(self.word_vectors(vectors) @ self.inner.T, -20, 20)).astype(np.float64)


def heads(v: np.ndarray) -> np.ndarray:
    """The second step's number of the word before."""
    return np.where(v < HEADS, v, HEADS + v % REST)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return (1 / (1 + np.exp(-np.clip(x, -30, 30)))).astype(np.float32)


def _dots(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", x, y)


def _rows_sum(at: np.ndarray, rows: np.ndarray, size: int) -> np.ndarray:
    """Rows added up by their index."""
    d = rows.shape[1]
    return np.bincount((at[:, None] * d + np.arange(d)).ravel(), rows.ravel(), size * d).reshape(size, d)


# training and sums over all parts


PART = "part int, weight double, flat binary"


def tree_mean(parts: DataFrame, count: int) -> tuple[float, np.ndarray] | None:
    """Sum of the weights, and the weighted mean of the vectors, of parts(part, weight, flat), at most one for each of
    `count` partitions; FAN at a time, so a task and the driver hold FAN vectors of fixed size."""

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("part")
        weight, mean = _mean(pdf["weight"], pdf["flat"])
        return pd.DataFrame({"part": [int(pdf["part"].iloc[0]) // FAN], "weight": [weight], "flat": [mean.tobytes()]})

    while count > FAN:
        parts, count = parts.groupBy(F.expr(f"part div {FAN}")).applyInPandas(merge, PART), -(-count // FAN)
    rows = parts.orderBy("part").collect()
    return _mean([r.weight for r in rows], [r.flat for r in rows]) if rows else None


def _mean(weights, flats) -> tuple[float, np.ndarray]:
    total, out = 0.0, 0.0
    for w, flat in zip(weights, flats, strict=True):
        total, out = total + w, out + w * np.frombuffer(flat, np.float64)
    return total, out / total


def _part(weight: float, flat: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([float(weight)]), pa.array([flat.astype(np.float64).tobytes()], pa.binary())], names=["part", "weight", "flat"])


def summed(counts: DataFrame, vector) -> np.ndarray | None:
    """The sum over all counts(word, c) of vector(words, c), whose length is fixed."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for b in batches:
            for at in range(0, len(b), 20_000):
                part = b.slice(at, 20_000)
                x = vector(part.column(0), part.column(1).to_numpy().astype(np.float64))
                out = x if out is None else out + x
        if out is not None:
            yield _part(1, out)

    found = tree_mean(counts.mapInArrow(each, PART), counts.rdd.getNumPartitions())
    return None if found is None else found[0] * found[1]


class Fitted:
    """The model, counts of the corpus and both normalisers; their size is fixed."""

    def __init__(self, chunks: DataFrame, counts: DataFrame):
        self.n, self.v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
        listed = counts.where(F.col("word") != F.lit(END)).orderBy(F.desc("c"), "word").limit(TOP).collect()  # TOP rows at most
        top = pa.array([bytes(r.word) for r in listed], pa.binary())
        ends = counts.where(F.col("word") == F.lit(END)).agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]

        def classes(words: pa.Array, c: np.ndarray) -> np.ndarray:
            kinds, _ = forms(words)
            tail = word_ids(words, top, kinds) > len(top)
            return np.bincount(kinds[tail], c[tail], CLASSES)

        found = summed(counts, classes)
        count = np.concatenate([[ends], [r.c for r in listed], np.zeros(CLASSES) if found is None else found])
        model = LogBilinear(np.log((count + 1) / (count.sum() + len(count))), len(top))
        parts = chunks.rdd.getNumPartitions()
        for k in range(ROUNDS):
            start, rate = model.packed(), RATE / (1 + k)

            def fit(batches: Iterator[pa.RecordBatch], start=start, rate=rate, k=k) -> Iterator[pa.RecordBatch]:
                own, rng, seen = LogBilinear(model_share, len(top)).unpack(start), np.random.default_rng([k, TaskContext.get().partitionId()]), 0
                for b in batches:
                    for row in range(len(b)):
                        seen += own.learn(Chunk(b, row), top, k, rng, rate)
                if seen:
                    yield _part(seen, own.packed())

            model_share = model.log_share
            fitted = tree_mean(chunks.mapInArrow(fit, PART), parts)
            if fitted is not None:
                model.unpack(fitted[1])
        self.top, self.model = top, model
        self.a, self.b, self.norm = model.tables()

        def masses(words: pa.Array, c: np.ndarray) -> np.ndarray:
            kinds, vectors = forms(words)
            tail = np.flatnonzero(word_ids(words, top, kinds) > len(top))
            tail = tail[np.argsort(kinds[tail], kind="stable")]
            out = np.zeros((CLASSES, HEADS + REST))
            if len(tail):
                starts = np.flatnonzero(np.diff(kinds[tail], prepend=-1))
                out[kinds[tail[starts]]] = np.add.reduceat((c[tail] + 1)[:, None] * model.factors(vectors[tail]), starts, axis=0)
            return out.ravel()

        found = summed(counts, masses)
        # a class's last place is that of all words not met in training
        self.inner_norm = np.log(1 + (0.0 if found is None else found.reshape(CLASSES, -1)) + np.zeros((CLASSES, HEADS + REST)))
        model.spread = {}

    def log10(self, chunk: Chunk, c: np.ndarray) -> np.ndarray:
        """Log-probability of each token; c holds the training counts of the chunk's words."""
        kinds, vectors = forms(chunk.words)
        ids, out = word_ids(chunk.words, self.top, kinds), np.empty(len(chunk.tokens))
        u, v = chunk.before(ids[chunk.tokens])
        share, form = np.log(c + 1), self.model.word_vectors(vectors)
        for at in range(0, len(out), STEP):
            x, t = slice(at, at + STEP), chunk.tokens[at : at + STEP]
            w = ids[t]
            p = (self.a[u[x], w] + self.b[v[x], w] - self.norm[u[x], v[x]]).astype(np.float64)
            tail = np.flatnonzero(w > len(self.top))
            t, before = t[tail], heads(v[x][tail])
            s = np.clip(_dots(form[t], self.model.inner[before]), -20, 20)
            p[tail] += share[t] + np.where(c[t] > 0, s, 0) - self.inner_norm[kinds[t], before]
            out[x] = p
        return out / np.log(10)


def _score_chunk(shared):
    def each(table: pa.Table, counts: pa.Table) -> pa.Table:
        fitted, chunk = shared.value, Chunk(table.combine_chunks(), 0)
        c = np.zeros(len(chunk.words))
        c[counts.column("i").to_numpy()] = counts.column("c").to_numpy()
        known, deep = c > 0, fitted.log10(chunk, c)
        base = np.log10(c + 1) - np.log10(fitted.n + fitted.v + 1)
        sums = [np.add.reduceat(x, chunk.first) for x in (known[chunk.tokens].astype(np.int64), base[chunk.tokens], deep)]
        sizes, ids = np.diff(chunk.first, append=len(chunk.tokens)), chunk.ids
        out = [ids, [held_out(i) for i in ids], sizes, sums[0], np.full(len(ids), fitted.n), sums[1], sums[2]]
        return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(out, SCORED, strict=True)], schema=SCORED)

    return each


SCORED = pa.schema([("id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, Fitted]:
    """The stored chunks, the training counts of their words (chunk, i, c), and the fitted model."""
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), text.alias("text"))
    chunks = materialise(rows.mapInArrow(_chunks, "chunk bigint, ids array<bigint>, sizes array<int>, tokens binary, words array<binary>, n array<int>"), "lm-chunks")
    listed = chunks.select("chunk", F.posexplode(F.arrays_zip("words", "n")).alias("i", "w")).select("chunk", "i", F.col("w.words").alias("word"), F.col("w.n").alias("n"))
    same = Window.partitionBy("word")  # a word has one row for each chunk that has it
    counted = listed.withColumn("c", F.sum("n").over(same)).withColumn("first", F.min("chunk").over(same) == F.col("chunk"))
    counted = materialise(counted.select("chunk", "i", "c", F.when(F.col("first") & (F.col("c") > 0), F.col("word")).alias("word")), "lm-counts")
    return chunks, counted, Fitted(chunks.select("ids", "sizes", "tokens", "words"), counted.where("word IS NOT NULL").select("word", "c"))


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row."""
    chunks, counted, fitted = fit(docs, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(fitted)
    own = chunks.select("chunk", "ids", "sizes", "tokens", "words").groupBy("chunk").cogroup(counted.select("chunk", "i", "c").groupBy("chunk"))
    return own.applyInArrow(_score_chunk(shared), "id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


def query(spark, sf_dir: str) -> DataFrame:
    """op9: base and model score of every document."""
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("id", "doc_id")
