"""Token counts by heap-and-linked-list byte-pair merging.

A text is cut into pre-tokens; each pre-token's bytes form a linked list whose adjacent pairs wait in a heap by merge
rank. Popping the lowest rank merges a pair and offers the two new pairs. A pre-token's count is its bytes less the
merges done; no identifier is ever made. Counts of pre-tokens met before are kept in a table of bounded size.

Defined cases: a null text is empty and has 0 bytes and 0 tokens; a special token's string inside a text is one token,
as the library does it by default; a very long pre-token costs n log n; rows are counted one by one, so repeated rows,
null ids and extra columns change nothing; an empty table gives an empty table.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pre-token counts kept by one Python worker; the table is emptied when full.
KEPT = 400_000
LIMIT = 512
#: Fixed value: the pre-token pattern that goes with the vocabulary.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary: itself if printable, else 256 and up."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


class MergeCounter(dict):
    """pre-token -> number of tokens."""

    def __init__(self, path: str):
        super().__init__()
        spec = json.load(open(path, encoding="utf-8"))
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.rank = {(a, b): i for i, (a, b) in enumerate(merges)}
        self.letters = byte_letters()
        self.pieces = regex.compile(PRETOKEN).findall
        special = [re.escape(t["content"]) for t in spec["added_tokens"]]
        self.special = re.compile("|".join(special)) if special else None

    def merged(self, piece: str) -> int:
        """Symbols left once no adjacent pair of the linked list has a rank."""
        letters, rank = self.letters, self.rank
        sym = [letters[b] for b in piece.encode("utf-8", "surrogatepass")]
        n = left = len(sym)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, sym[i], sym[i + 1]) for i in range(n - 1) if (r := rank.get((sym[i], sym[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i] if sym[i] == a else n
            if j >= n or sym[j] != b:
                continue  # one of the two was merged meanwhile
            sym[i], sym[j] = a + b, ""
            left -= 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := rank.get((sym[i], sym[k]))) is not None:
                    heapq.heappush(heap, (r, i, sym[i], sym[k]))
            h = before[i]
            if h >= 0 and (r := rank.get((sym[h], sym[i]))) is not None:
                heapq.heappush(heap, (r, h, sym[h], sym[i]))
        return left

    def __missing__(self, piece: str) -> int:
        count = self.merged(piece)
        if len(piece) <= 64:
            if len(self) >= KEPT:
                self.clear()
            self[piece] = count
        return count

    def count(self, text: str) -> int:
        if self.special is None or not self.special.search(text):
            return sum(map(self.__getitem__, self.pieces(text)))
        parts = self.special.split(text)
        return len(parts) - 1 + sum(sum(map(self.__getitem__, self.pieces(p))) for p in parts)


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, path: str | None = None) -> DataFrame:
    """id, n_bytes, n_tokens, over_limit of each row."""
    path = path or vocabulary_path()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = MergeCounter(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([counter.count(x.as_py()) for x in b.column(2)], pa.int64())], names=[id_col, "n_bytes", "n_tokens"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col), F.octet_length(text).cast("bigint").alias("n_bytes"), text.alias("text"))
    kind = dict(docs.dtypes)[id_col]
    return rows.mapInArrow(count, f"{id_col} {kind}, n_bytes bigint, n_tokens bigint").withColumn("over_limit", F.col("n_tokens") > limit)


def query(spark, sf_dir: str) -> DataFrame:
    """op2: token counts of every document."""
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
