"""Language of documents by a linear-chain conditional random field over words.

Emissions are sums of hashed affix, character n-gram and word features and of lexicon features; transitions between the
labels are learned with them by gradient ascent on the conditional likelihood (expected counts by forward-backward).
Training sequences join windows of different documents, so switches of language occur in them. A document's words are
labelled by posterior marginals; its language has the largest summed marginal, its score is that sum's share.

Defined cases: a null text, or one without a letter, is `und` with score 0; all runs of letters are words, whatever
stands between them; a text of any length is labelled whole; with no
labelled training rows every document is `und`; ties go to the label that sorts first; rows are labelled one by one,
so repeated rows, null ids (they are held in) and extra columns change nothing; an empty table gives an empty table.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import release

FOLDS, HELD_FOLD = 3, 1
#: The training sample: at most so many windows of so many words for each label, one from each sampled document.
SAMPLE_DOCS = 400
WINDOW_WORDS = 24
BUCKETS = 1 << 16  # a power of two
EPOCHS = 6
RATE = 0.3
#: A word is in a label's lexicon when the label has this share of its sampled uses.
LEXICON_SHARE = 0.8
#: Tokens whose emissions one Python worker keeps; emptied when full.
KEPT = 80_000
#: Words labelled at once.
STEP_WORDS = 100_000
MIN_SCORE = 0.4

#: Scripts written without spaces: their runs of letters are cut into pairs. Other runs are cut after 40 letters.
UNSPACED = ("Han", "Hiragana", "Katakana", "Thai", "Lao", "Khmer", "Myanmar")
_MORE = r"\p{L}[\p{L}\p{M}'’-]{0,39}"
_WORDS = "[" + "".join(rf"\p{{{s}}}" for s in UNSPACED) + "]{1,2}|" + _MORE
_words, _words_and_ends = regex.compile(_WORDS).findall, regex.compile(_WORDS + r"|\n").findall
_JVM_WORDS = "[" + "".join(rf"\p{{Is{s}}}" for s in UNSPACED) + "]{1,2}|" + _MORE


def words_of(token: str) -> list[str]:
    """All runs of letters, lower-cased."""
    return _words(token.lower())


def words_of_all(tokens: list[str]) -> tuple[list[str], np.ndarray]:
    """The words of lower-cased tokens without white space, one after another, and how many each token has: one pass over all."""
    found = _words_and_ends("\n".join(tokens))
    ends = np.array([w == "\n" for w in found], bool)
    places = np.flatnonzero(ends)
    count = np.diff(np.concatenate([[-1], places, [len(found)]])) - 1
    return [w for w in found if w != "\n"], count[: len(tokens)]


def _bucket(parts: list[np.ndarray], salt: int) -> np.ndarray:
    """Hash of the characters at the same place of each part, by salt."""
    h = np.full(parts[0].shape, salt, np.uint64)
    for p in parts:
        h = (h ^ p.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return (h & np.uint64(BUCKETS - 1)).astype(np.int64)


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words' features, word after word, and how many each has: the word itself, its first and last one to
    three letters, and the pairs and triples of its letters with its ends marked."""
    marked = np.frombuffer(f"^{'$^'.join(words)}$".encode("utf-32-le", "surrogatepass"), "<u4")
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    end = np.cumsum(sizes)
    first, each = end - sizes, 2 * sizes + 4  # a word of n marked letters has n - 1 pairs, n - 2 triples, six ends and itself
    start = np.cumsum(each) - each
    flat = np.empty(int(each.sum()), np.int64)
    pairs = np.ones(len(marked), bool)
    pairs[end - 1] = False
    triples = pairs.copy()
    triples[end - 2] = False
    shift = np.repeat(start - first, sizes) + np.arange(len(marked))  # where a letter's pair goes
    at2, at3 = np.flatnonzero(pairs), np.flatnonzero(triples)
    flat[shift[at2]] = _bucket([marked[at2], marked[at2 + 1]], 2)
    flat[(shift + np.repeat(sizes - 1, sizes))[at3]] = _bucket([marked[at3], marked[at3 + 1], marked[at3 + 2]], 3)
    last = start + each - 7
    for n in (1, 2, 3):
        inside = lambda at: np.where((at > first) & (at < end - 1), marked[np.clip(at, 0, len(marked) - 1)], 0)
        flat[last + 2 * n - 2] = _bucket([inside(first + 1 + k) for k in range(n)], 10 + n)
        flat[last + 2 * n - 1] = _bucket([inside(end - 2 - k) for k in range(n)], 20 + n)
    try:
        whole = list(map(str.encode, words))
    except UnicodeEncodeError:  # a lone surrogate
        whole = [w.encode("utf-8", "surrogatepass") for w in words]
    flat[last + 6] = np.fromiter(map(zlib.crc32, whole), np.int64, len(words)) % BUCKETS
    return flat, each


class Field:
    """Emission weights (hashed features, then one lexicon feature for each label) and transitions."""

    def __init__(self, labels: list[str], lexicon: dict[str, int]):
        self.labels, self.lexicon = labels, lexicon
        k = len(labels)
        self.weights = np.zeros((BUCKETS + k, k))
        self.moves = np.eye(k)

    def rows(self, words: list[str]) -> list[np.ndarray]:
        """Feature numbers of each word, the lexicon's among them."""
        if not words:
            return []
        flat, sizes = features(words)
        own = [self.lexicon.get(w) for w in words]
        return [r if k is None else np.append(r, BUCKETS + k) for r, k in zip(np.split(flat, np.cumsum(sizes)[:-1]), own, strict=True)]

    def emissions(self, rows: list[np.ndarray]) -> np.ndarray:
        return np.add.reduceat(self.weights[np.concatenate(rows)], np.cumsum([0, *map(len, rows)])[:-1], axis=0)

    def word_emissions(self, words: list[str]) -> np.ndarray:
        """Emissions of each word, without a list for each."""
        flat, sizes = features(words)
        out = np.add.reduceat(self.weights[flat], np.cumsum(sizes) - sizes, axis=0)
        own = np.array([self.lexicon.get(w, -1) for w in words])
        out[own >= 0] += self.weights[BUCKETS + own[own >= 0]]
        return out

    def marginals(self, scores: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Forward-backward over sequences laid end to end, longest first; all sequences move one word at a time. Inside, the
        words of one step lie together."""
        a = np.exp(self.moves - self.moves.max())
        starts, top = np.cumsum(lengths) - lengths, int(lengths[0]) if len(lengths) else 0
        active = np.searchsorted(-lengths, -np.arange(top), side="left")  # sequences longer than t
        steps = np.concatenate([[0], np.cumsum(active)])
        step = np.arange(len(scores)) - np.repeat(starts, lengths)
        place = steps[step] + np.repeat(np.arange(len(lengths)), lengths)
        p = np.empty_like(scores)
        p[place] = np.exp(scores - scores.max(1, keepdims=True))
        ahead, back = np.empty_like(p), np.ones_like(p)
        same, turned = np.ones_like(a), np.ascontiguousarray(a.T)  # x @ same: the row's sum in each column
        at = steps.tolist()
        for t in range(top):
            low, high = at[t], at[t + 1]
            x = p[low:high] * (ahead[at[t - 1] : at[t - 1] + high - low] @ a) if t else p[low:high]
            np.divide(x, x @ same, out=ahead[low:high])
        for t in range(top - 2, -1, -1):
            low, high = at[t + 1], at[t + 2]
            x = (back[low:high] * p[low:high]) @ turned
            np.divide(x, x @ same, out=back[at[t] : at[t] + high - low])
        ahead *= back
        return (ahead / ahead.sum(1, keepdims=True))[place]

    def pair_counts(self, scores: np.ndarray, posterior: np.ndarray, n: int, length: int) -> np.ndarray:
        """Expected transition counts of n sequences of one length, from the same recursions."""
        p = np.exp(scores - scores.max(1, keepdims=True)).reshape(n, length, -1)
        a = np.exp(self.moves - self.moves.max())
        out, x = np.zeros_like(a), p[:, 0]
        back = [np.ones_like(x)]
        for t in range(length - 1, 0, -1):
            y = (back[0] * p[:, t]) @ a.T
            back.insert(0, y / y.sum(1, keepdims=True))
        for t in range(1, length):
            x = x / x.sum(1, keepdims=True)
            joint = x[:, :, None] * a * (p[:, t] * back[t])[:, None, :]
            out += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
            x = (x @ a) * p[:, t]
        return out


def train(windows: list[tuple[str, list[str]]]) -> Field | None:
    """windows: (label, words). Two windows of different rows make one sequence."""
    rng, by_label = np.random.default_rng(11), defaultdict(list)
    uses: dict[str, Counter] = defaultdict(Counter)
    for label, words in sorted(windows):
        if words:
            by_label[label].append((words * WINDOW_WORDS)[:WINDOW_WORDS])
            for w in words:
                uses[w][label] += 1
    if not by_label:
        return None
    labels = sorted(by_label)
    lexicon = {w: labels.index(c.most_common(1)[0][0]) for w, c in uses.items() if c.total() > 1 and c.most_common(1)[0][1] >= LEXICON_SHARE * c.total()}
    field = Field(labels, lexicon)
    rows = [(labels.index(k), field.rows(words)) for k, v in by_label.items() for words in v]
    spread, spread_moves = np.full(field.weights.shape, 1e-8), np.full(field.moves.shape, 1e-8)
    for epoch in range(EPOCHS):
        order = rng.permutation(len(rows))
        if len(order) % 2:
            order = np.append(order, order[0])
        for at in range(0, len(order), 64):
            group = order[at : at + 64]
            n, length = len(group) // 2, 2 * WINDOW_WORDS
            if not n:
                continue
            words = [r for i in group for r in rows[i][1]]
            truth = np.repeat([rows[i][0] for i in group], WINDOW_WORDS)
            scores = field.emissions(words)
            posterior = field.marginals(scores, np.full(n, length))
            error = -posterior
            error[np.arange(len(truth)), truth] += 1
            flat, sizes = np.concatenate(words), [len(r) for r in words]
            grad = np.zeros_like(field.weights)
            np.add.at(grad, flat, np.repeat(error, sizes, axis=0))
            seen = truth.reshape(n, length)
            pairs = np.zeros_like(field.moves)
            np.add.at(pairs, (seen[:, :-1].ravel(), seen[:, 1:].ravel()), 1)
            pairs -= field.pair_counts(scores, posterior, n, length)
            for x, g, s in ((field.weights, grad / n, spread), (field.moves, pairs / n, spread_moves)):
                s += g * g
                x += RATE / (1 + epoch) * g / np.sqrt(s)
    return field


class Labeller(dict):
    """Lower-cased token -> its number; a token's words, none or several, have rows of emissions one after another."""

    def __init__(self, field: Field):
        super().__init__()
        self.field = field
        self.keep([])

    def keep(self, numbers: list[int]) -> None:
        """Forgets all tokens but these."""
        names = list(self)
        kept = np.array(numbers, np.int64)
        if len(kept):
            self.table = self.table[self.places(kept)]
            self.count = self.count[kept]
        else:
            self.count, self.table = np.zeros(0, np.int64), np.zeros((0, len(self.field.labels)), np.float32)
        self.first = np.cumsum(self.count) - self.count
        self.uses = np.zeros(len(kept), np.int64)
        self.clear()
        self.update(zip([names[i] for i in numbers], range(len(kept)), strict=True))

    def learn(self, tokens: set[str]) -> None:
        new = list(tokens.difference(self))
        if not new:
            return
        found, count = words_of_all(new)
        place = {w: i for i, w in enumerate(dict.fromkeys(found))}
        real = list(place)
        rows = [self.table] if len(self) else []
        if real:
            emitted = np.concatenate([self.field.word_emissions(real[at : at + 10_000]) for at in range(0, len(real), 10_000)]).astype(np.float32)
            rows.append(emitted[np.fromiter(map(place.__getitem__, found), np.int64, len(found))])
        self.first = np.concatenate([self.first, len(self.table) + np.cumsum(count) - count])
        self.count = np.concatenate([self.count, count])
        self.uses = np.concatenate([self.uses, np.zeros(len(new), np.int64)])
        self.table = np.concatenate(rows) if rows else self.table
        self.update(zip(new, range(len(self), len(self) + len(new)), strict=True))

    def places(self, ids: np.ndarray) -> np.ndarray:
        """Rows of the table that hold these tokens' words, one after another."""
        count = self.count[ids]
        before = np.cumsum(count) - count
        return np.repeat(self.first[ids] - before, count) + np.arange(count.sum())

    def posteriors(self, texts: list[str]) -> Iterator[tuple[int, np.ndarray]]:
        """Place of each text that has a word, and the posterior of its words' labels, by groups of bounded size."""
        order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
        at = 0
        while at < len(order):
            group, tokens, sizes = [], [], []
            while at < len(order) and (not group or len(tokens) < STEP_WORDS):
                own = texts[order[at]].lower().split()
                tokens += own
                group.append(order[at])
                sizes.append(len(own))
                at += 1
            self.learn(set(tokens))
            ids = np.fromiter(map(self.__getitem__, tokens), np.int64, len(tokens))
            rows = self.table[self.places(ids)]
            upto = np.concatenate([[0], np.cumsum(self.count[ids])])[np.cumsum([0, *sizes])]
            self.uses += np.bincount(ids, minlength=len(self))
            if len(self) > KEPT:  # the tokens that came more than once stay, but half of the bound at most
                again = np.flatnonzero(self.uses > 1)
                self.keep(sorted(again[np.argsort(-self.uses[again], kind="stable")[: KEPT // 2]].tolist()))
            words = np.diff(upto)
            longest = np.argsort(-words, kind="stable")[: np.count_nonzero(words)]
            if len(longest):
                lengths = words[longest]
                before = np.cumsum(lengths) - lengths
                laid = rows[np.repeat(upto[longest] - before, lengths) + np.arange(lengths.sum())]
                posterior = self.field.marginals(laid, lengths)
                yield from zip([group[i] for i in longest], np.split(posterior, np.cumsum(lengths)[:-1]), strict=True)

    def label(self, texts: list[str]) -> list[tuple[str, float]]:
        out: list[tuple[str, float]] = [("und", 0.0)] * len(texts)
        for i, posterior in self.posteriors(texts):
            share = posterior.sum(0) / len(posterior)
            out[i] = self.field.labels[int(share.argmax())], min(1.0, float(share.max()))
        return out

    def label_words(self, texts: list[str]) -> list[list[tuple[str, str, float]]]:
        """(word, label, its probability) of each word of each text."""
        out: list[list[tuple[str, str, float]]] = [[] for _ in texts]
        for i, posterior in self.posteriors(texts):
            words = [w for t in texts[i].split() for w in words_of(t)]
            out[i] = [(w, self.field.labels[k], float(p)) for w, k, p in zip(words, posterior.argmax(1), posterior.max(1), strict=True)]
        return out


def training_windows(docs: DataFrame, id_col: str, text_col: str, lang_col: str, sample: int = SAMPLE_DOCS) -> list[tuple[str, list[str]]]:
    """At most `sample` windows for each label, of the documents whose keyed hash is smallest; windows start anywhere."""
    fold = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % FOLDS
    known = docs.where((fold != HELD_FOLD) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = known.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.pmod(F.xxhash64(F.col(id_col), F.lit("crf")), F.lit(1 << 40)).alias("h"))
    counts = rows.groupBy("lang").count().withColumn("bound", F.col("count").cast("double") ** -1 * (4 * sample) * (1 << 40))
    near = rows.join(F.broadcast(counts.select("lang", "bound")), "lang").where("h < bound")  # one row for each label
    first = near.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))).where(F.col("n") <= sample)
    words = first.select("lang", "h", F.regexp_extract_all(F.lower("text"), F.lit(_JVM_WORDS), F.lit(0)).alias("words"))
    start = F.pmod(F.col("h"), F.greatest(F.lit(1), F.size("words") - WINDOW_WORDS + 1)) + 1
    cut = words.select("lang", F.slice("words", start.cast("int"), WINDOW_WORDS).alias("words"))
    return [(r.lang, r.words) for r in cut.collect()]  # `sample` rows of bounded size for each label


def _fitted(docs: DataFrame, id_col: str, text_col: str, lang_col: str, sample: int):
    """A broadcast field or None; its size is fixed by BUCKETS, the labels and the sample."""
    return docs.sparkSession.sparkContext.broadcast(train(training_windows(docs, id_col, text_col, lang_col, sample)))


def _slices(batches: Iterator[pa.RecordBatch], at: int, rows: int = 1000) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Batches of a bounded number of rows, and the texts of their column `at`."""
    for b in batches:
        for first in range(0, len(b), rows):
            part = b.slice(first, rows)
            yield part, [t or "" for t in part.column(at).to_pylist()]
    release()


def label_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE_DOCS) -> DataFrame:
    """id, held_out, lang_pred, score of each row."""
    shared = _fitted(docs, id_col, text_col, lang_col, sample)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(shared.value) if shared.value is not None else None
        for b, texts in _slices(batches, 1):
            found = labeller.label(texts) if labeller is not None else [("und", 0.0)] * len(texts)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], names=["id", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    held = F.crc32(F.coalesce(F.col("id").cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_FOLD
    return rows.mapInArrow(each, "id bigint, lang_pred string, score double").select("id", held.alias("held_out"), "lang_pred", "score")


def label_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE_DOCS) -> DataFrame:
    """id, words (word, lang, p) of each row: the language of every word, for texts that switch between languages."""
    shared = _fitted(docs, id_col, text_col, lang_col, sample)
    kind = pa.list_(pa.struct([("word", pa.string()), ("lang", pa.string()), ("p", pa.float64())]))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(shared.value) if shared.value is not None else None
        for b, texts in _slices(batches, 1):
            found = labeller.label_words(texts) if labeller is not None else [[]] * len(b)
            words = pa.array([[{"word": w, "lang": k, "p": p} for w, k, p in own] for own in found], kind)
            yield pa.RecordBatch.from_arrays([b.column(0), words], names=["id", "words"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(each, "id bigint, words array<struct<word: string, lang: string, p: double>>")


def keep_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE_DOCS, min_score: float = MIN_SCORE) -> DataFrame:
    """The rows whose language is found with at least min_score, all columns kept; each row is judged where it is read."""
    shared, at = _fitted(docs, id_col, text_col, lang_col, sample), docs.columns.index(text_col)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(shared.value) if shared.value is not None else None
        for b, texts in _slices(batches, at):
            if labeller is not None:
                yield b.filter(pa.array([k != "und" and p >= min_score for k, p in labeller.label(texts)], pa.bool_()))

    return docs.mapInArrow(each, docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    """op4: language of every document."""
    return label_documents(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("id", "doc_id")
