"""Secret scans by grammar inference.

Labelled credentials become a prefix tree of symbols (kinds of characters) with counts. States that are statistically
compatible, by Hoeffding's bound on their ends and next symbols and on those of their successors, are merged in the
red-blue order, which gives a probabilistic automaton for each format; tokens that no rule marks give one for ordinary
text. Then every candidate token of every text is scored: the log-likelihood of its best format less that of ordinary text.
Candidates above LEAST are secrets too, beside what the fixed patterns find.

The labelled credentials are, unless given, what the patterns find in the corpus: at most SAMPLE distinct values of each
kind and of ordinary tokens, those with the smallest hashes. All texts are scanned whole, where they are read.

Defined cases: a null text is empty; spans are in code points, end exclusive; rows are scanned one by one, so repeated
rows, null ids and extra columns change nothing; without labelled credentials only the patterns find secrets; an empty
table gives an empty table.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialise, release

#: The patterns and the least lengths of what they find (the whole match; of assign, its second group).
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ASSIGN_LENGTH = 6
RUNS = {"access": re.compile(r"AKIA[A-Z0-9]{16,}"), "hex": re.compile(r"[0-9a-f]{24,}")}  # as the greedy runs of that length and more
KINDS = ["assign", "access", "hex"]
LEARNED = "like_"  # before the kind whose automaton fits

CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")
SAMPLE = 500  # distinct values of each kind that an automaton learns from
ALPHA = 0.05  # of Hoeffding's bound
SMOOTHING = 0.5  # added to each symbol's count
LEAST = 14.0  # natural log odds: one secret in a million tokens at even odds after it
#: Symbols: kinds of characters and how many characters each stands for.
SYMBOLS = [("0123456789", "d"), ("abcdef", "h"), ("ghijklmnopqrstuvwxyz", "l"), ("ABCDEF", "H"), ("GHIJKLMNOPQRSTUVWXYZ", "U")] + [(c, c) for c in "+/_.=-"]
FOLD = str.maketrans({c: s for chars, s in SYMBOLS for c in chars})
WIDTH = {s: math.log(len(chars)) for chars, s in SYMBOLS}


class State:
    __slots__ = ("ends", "paths", "to")

    def __init__(self):
        self.ends, self.paths, self.to = 0, {}, {}

    @property
    def total(self) -> int:
        return self.ends + sum(self.paths.values())


def prefix_tree(words: list[str]) -> State:
    top = State()
    for w in words:
        at = top
        for c in w:
            at.paths[c] = at.paths.get(c, 0) + 1
            at = at.to.setdefault(c, State())
        at.ends += 1
    return top


def _differ(a: int, m: int, b: int, n: int, alpha: float) -> bool:
    return m > 0 and n > 0 and abs(a / m - b / n) > math.sqrt(0.5 * math.log(2 / alpha)) * (1 / math.sqrt(m) + 1 / math.sqrt(n))


def compatible(red: State, blue: State, alpha: float) -> bool:
    """Whether the two end and go on alike, and so do their successors."""
    todo = [(red, blue)]
    while todo:
        a, b = todo.pop()
        m, n = a.total, b.total
        if _differ(a.ends, m, b.ends, n, alpha) or any(_differ(a.paths.get(c, 0), m, b.paths.get(c, 0), n, alpha) for c in a.paths.keys() | b.paths.keys()):
            return False
        todo += [(a.to[c], b.to[c]) for c in a.to.keys() & b.to.keys()]
    return True


def _fold(red: State, blue: State) -> None:
    """blue's counts become red's, successors included. blue is the top of a tree, so this ends."""
    todo = [(red, blue)]
    while todo:
        a, b = todo.pop()
        a.ends += b.ends
        for c, n in b.paths.items():
            a.paths[c] = a.paths.get(c, 0) + n
            if c in a.to:
                todo.append((a.to[c], b.to[c]))
            else:
                a.to[c] = b.to[c]


def inferred(words: list[str], alpha: float = ALPHA) -> State | None:
    """The automaton of the words: blue states, heaviest first, merge with the first compatible red state or turn red."""
    if not words:
        return None
    top = prefix_tree(words)
    red, known = [top], {id(top)}
    while True:
        blue = [(-s.total, k, c, s) for k, r in enumerate(red) for c, s in r.to.items() if id(s) not in known]
        if not blue:
            return top
        _, k, c, s = min(blue, key=lambda x: x[:3])
        same = next((r for r in red if compatible(r, s, alpha)), None)
        if same is None:
            red.append(s)
            known.add(id(s))
        else:
            red[k].to[c] = same
            _fold(same, s)


class Automaton:
    """Log-likelihoods of tokens: by state, symbol -> (log probability, next state), and the log probability of the end."""

    def __init__(self, top: State):
        states, at = [top], {id(top): 0}
        for s in states:
            for to in s.to.values():
                if id(to) not in at:
                    at[id(to)] = len(states)
                    states.append(to)
        self.steps, self.ends, self.other = [], [], []
        for s in states:
            whole = math.log(s.total + SMOOTHING * (len(WIDTH) + 1))
            self.steps.append({c: (math.log(n + SMOOTHING) - whole - WIDTH[c], at[id(s.to[c])]) for c, n in s.paths.items()})
            self.ends.append(math.log(s.ends + SMOOTHING) - whole)
            self.other.append(math.log(SMOOTHING) - whole)

    def score(self, symbols: str) -> float:
        """A symbol that a state has not seen leaves the state as it is."""
        total, at = 0.0, 0
        for c in symbols:
            p, at = self.steps[at].get(c) or (self.other[at] - WIDTH[c], at)
            total += p
        return total + self.ends[at]


class Scorer(dict):
    """symbols of a token -> (kind, log odds) of its best format."""

    def __init__(self, formats: dict[str, Automaton], plain: Automaton | None, kept: int = 200_000):
        super().__init__()
        self.formats, self.plain, self.kept = formats, plain, kept

    def __missing__(self, symbols: str) -> tuple[str, float]:
        base = self.plain.score(symbols) if self.plain else sum(-math.log(sum(len(c) for c, _ in SYMBOLS)) for _ in symbols)
        kind, odds = max(((k, a.score(symbols) - base) for k, a in self.formats.items()), key=lambda x: x[1], default=("", -math.inf))
        if len(symbols) <= 256:
            if len(self) >= self.kept:
                self.clear()
            self[symbols] = (kind, odds)
        return kind, odds


def marked(text: str) -> list[tuple[int, int, str, str]]:
    """start, end, kind, value of what the patterns find, by start, then kind."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), m.end(), "assign", m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LENGTH]
    for kind, pattern in RUNS.items():
        out += [(m.start(), m.end(), kind, m[0]) for m in pattern.finditer(text)]
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2])))


def candidates(text: str, spans: list[tuple[int, int, str, str]]) -> Iterator[tuple[int, int]]:
    """Long tokens that overlap no span, without what ends a sentence."""
    taken, at = sorted((a, b) for a, b, _, _ in spans), 0
    reach = 0  # the last end of the spans that start before a candidate's end
    for m in CANDIDATE.finditer(text):
        end = m.start() + len(m[0].rstrip(".-="))
        while at < len(taken) and taken[at][0] < end:
            reach, at = max(reach, taken[at][1]), at + 1
        if end - m.start() >= 16 and reach <= m.start():
            yield m.start(), end


def labelled_values(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """kind, value: the distinct values that the patterns find, and ordinary tokens (kind null)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = set()
            for x in b.column(0):
                text = x.as_py() or ""
                spans = marked(text)
                found |= {(k, v) for _, _, k, v in spans}
                found |= {(None, text[s:e]) for s, e in candidates(text, spans)}
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.string()), pa.array([v for _, v in found], pa.string())], names=["kind", "value"])
        release()

    return materialise(docs.select(text_col).mapInArrow(each, "kind string, value string").distinct(), "secret-values")


def chosen(labelled: DataFrame, sample: int = SAMPLE) -> list[tuple[str | None, str]]:
    """(kind, value): of each kind the values with the smallest hashes, `sample` at most."""
    values = labelled.select("kind", "value").where("value IS NOT NULL").distinct()
    kinds = [r.kind for r in values.select("kind").distinct().collect()]  # formats, a few
    out = []
    for k in kinds:
        out += values.where(F.col("kind").eqNullSafe(F.lit(k))).orderBy(F.xxhash64("value"), "value").limit(sample).collect()
    return [(r.kind, r.value) for r in out]


def fitted(labelled: list[tuple[str | None, str]]) -> Scorer:
    """Automata by kind from (kind, value) pairs; kind null for ordinary tokens."""
    words: dict[str | None, list[str]] = {}
    for kind, value in labelled:
        words.setdefault(kind, []).append(value.translate(FOLD))
    plain = inferred(words.pop(None, []))
    return Scorer({k: Automaton(inferred(v)) for k, v in sorted(words.items())}, plain and Automaton(plain))


def find_secrets(docs: DataFrame, labelled: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, least: float = LEAST) -> DataFrame:
    """id, spans (kind, start, end, odds) of each row; odds are null for what the patterns find. labelled(kind, value):
    credentials by format, and ordinary tokens with a null kind; `sample` values of each kind are learnt from."""
    labelled = labelled_values(docs, text_col) if labelled is None else labelled
    shared = docs.sparkSession.sparkContext.broadcast(fitted(chosen(labelled, sample)))  # its size is bounded by the sample
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("odds", pa.float64())]))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = shared.value
        for b in batches:
            out = []
            for x in b.column(1):
                text = x.as_py() or ""
                spans = marked(text)
                found = [{"kind": k, "start": s, "end": e, "odds": None} for s, e, k, _ in spans]
                for s, e in candidates(text, spans):
                    like, odds = score[text[s:e].translate(FOLD)]
                    if odds >= least:
                        found.append({"kind": LEARNED + like, "start": s, "end": e, "odds": odds})
                out.append(sorted(found, key=lambda f: f["start"]))  # stable: base kinds in order, none shares a learned one's start
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, kind)], names=["id", "spans"])
        release()

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(each, "id bigint, spans array<struct<kind: string, start: bigint, end: bigint, odds: double>>")


def query(spark, sf_dir: str) -> DataFrame:
    """op12: the secrets of every document."""
    found = find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.filter("spans", lambda s: s["odds"].isNull())
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select(F.col("id").alias("doc_id"), *map(count, KINDS), F.sha2(text(base), 256).alias("base_sha256"), text("spans").alias("spans"))
