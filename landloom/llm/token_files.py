"""Token-ID output as ORC: run-length encoded ids in stripes, row indexes and Bloom filters on the document id.

Texts are range-partitioned and sorted by id, encoded, and written as ORC by Spark: a file holds a range of ids, its
row indexes and Bloom filters let a reader skip stripes, and stripes are read in parallel. Token offsets are a running
sum: totals of files first, then positions inside a file.

Defined cases: a null text is empty and gives the end id alone; null ids come first; repeated ids are ordered by their
text's hash and keep all their rows; an empty table gives an empty file set; columns other than id and text are
neither read nor written.
"""

from __future__ import annotations

import gc
import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import new_path, release
from .token_counts import byte_letters

END_ID = 1
#: Encoded pieces that one Python worker keeps, twice; the caller's memory decides.
KEPT = 400_000
#: Runs encoded in one call.
RUNS = 20_000
#: Bytes of texts encoded and handed to the writer at once, about; a worker takes some 350 MB with 2 MB and 500 MB with 8 MB.
BATCH_BYTES = 8 << 20
STORED = "doc_id bigint, ord bigint, n_tokens int, ids array<int>"


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: The normaliser and pre-tokenizer for which texts may be encoded piece by piece.
_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_LETTERS, _MARKS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f", r"!-&(-/:-@\[-`{-~"
_word_and_marks = re.compile(f"([{_LETTERS}]*)([{_MARKS}]*)").fullmatch


def fits(spec: dict) -> bool:
    """Whether a tokenizer's file is of the kind that never joins letters across white space nor letters with marks."""
    split = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}, {}])
    model = spec["model"]
    return (
        (spec.get("normalizer") or {}).get("normalizers") == _NORMALIZERS and len(split) == 2 and split[0].get("pattern") == {"Regex": _SPLIT} and split[0].get("behavior") == "Removed" and split[0].get("invert") is True
        and all(t["content"].startswith("<|") for t in spec.get("added_tokens", [])) and split[1].get("type") == "ByteLevel" and not split[1].get("add_prefix_space") and not spec.get("post_processor") and model.get("type") == "BPE" and model.get("end_of_word_suffix") == "</w>" and model.get("dropout") is None
    )


class PieceEncoder(dict):
    """piece -> its ids (little-endian unsigned 32-bit), by the tokenizers library.

    A vocabulary that `fits` never joins letters across white space: the pieces between spaces and line ends are encoded
    once and looked up afterwards. Pieces of Latin letters and then ASCII marks (no apostrophe) are put together from the
    ids of the two runs, and new runs are encoded many in one call by the same model without the normaliser and the
    pattern, whose work is done by then (lower case, a word for each run). All other pieces, and those with `<|`, of
    which special tokens begin, go through the whole tokenizer. Any other vocabulary encodes whole texts. Pieces not met since the table of `kept` was last full are forgotten.
    """

    def __init__(self, path: str, kept: int = KEPT):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.tokenizer, self.kept, self.old = Tokenizer.from_file(path), kept, {}
        with open(path, encoding="utf-8") as f:
            self.by_piece = fits(json.load(f))
        self.words = Tokenizer(self.tokenizer.model)  # the same model, held once
        self.words.pre_tokenizer = WhitespaceSplit()
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True

    def encode_runs(self, runs: list[str]) -> dict[str, bytes]:
        """Runs of letters, lower-cased, or of marks."""
        for at in range(0, len(runs), RUNS):
            part = runs[at : at + RUNS]
            bytewise = " ".join(part).encode().decode("latin-1").translate(_BYTE_LETTERS)
            ids = np.array(self.words.encode_batch_fast([bytewise], add_special_tokens=False)[0].ids, "<u4")
            cuts = [0, *(np.flatnonzero(self.ends[ids]) + 1).tolist()]
            if len(cuts) != len(part) + 1:
                raise ValueError("the vocabulary's word ends don't match its words")
            whole = ids.tobytes()
            self.update((r, whole[4 * i : 4 * j]) for r, i, j in zip(part, cuts[:-1], cuts[1:], strict=True))

    def learn(self, missing: list[str], wanted: list[str]) -> None:
        """Makes the missing pieces known; of a full table, only wanted ones stay at hand."""
        if len(self) > self.kept:
            self.old = dict(self)
            self.clear()
            missing = wanted
        known = [p for p in missing if p in self.old]
        self.update(zip(known, map(self.old.pop, known), strict=True))
        missing = [p for p in missing if p not in self]
        found = list(map(_word_and_marks, missing))
        rest = [p for p, m in zip(missing, found, strict=True) if m is None or "<|" in p]
        plain = [(p, m[1].lower(), m[2]) for p, m in zip(missing, found, strict=True) if m is not None and "<|" not in p]
        runs = {word for _, word, _ in plain}
        runs.update([marks for _, _, marks in plain])
        runs.discard("")
        self.encode_runs([r for r in runs if r not in self])
        self[""] = b""
        self.update([(p, self[word] + self[marks] if marks else self[word]) for p, word, marks in plain])
        self.update(zip(rest, (np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch(rest, add_special_tokens=False)), strict=True))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, one after another, and how many each text has."""
        gc.disable()  # hundreds of thousands of strings are made, and no cycles
        try:
            return self._encode(texts)
        finally:
            gc.enable()

    def _encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if not self.by_piece:
            found = [e.ids for e in self.tokenizer.encode_batch(texts.to_pylist(), add_special_tokens=False)]
            return np.concatenate([np.zeros(0, "<u4"), *(np.array(x, "<u4") for x in found)]).astype("<u4"), np.array([len(x) for x in found], np.int64)
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        ends = lists.offsets.to_numpy()[1:] - lists.offsets[0].as_py()
        coded = lists.flatten().dictionary_encode()
        pieces, at = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
        known = list(map(self.get, pieces))
        missing = [p for p, ids in zip(pieces, known, strict=True) if ids is None]
        if missing:
            self.learn(missing, pieces)
            known = list(map(self.__getitem__, pieces))
            for p in missing:
                if len(p) > 64:
                    del self[p]
        flat = np.frombuffer(b"".join(known), "<u4")
        size = np.fromiter(map(len, known), np.int64, len(known)) >> 2
        first, each = np.cumsum(size) - size, size[at]
        upto = np.cumsum(each)
        ids = flat[np.repeat(first[at] - (upto - each), each) + np.arange(upto[-1] if len(upto) else 0)]
        return ids, np.diff(np.concatenate([[0], upto])[ends], prepend=0)


#: The printable letter that stands for each byte, as byte-level vocabularies have it; the space stays.
_BYTE_LETTERS = {b: letter for b, letter in enumerate(byte_letters()) if b != 32}


def packed(ids: list[int]) -> bytes:
    return np.array(ids, "<u4").tobytes()


_encoders: dict[tuple[str, int], PieceEncoder] = {}


def encoder_for(path: str, kept: int) -> PieceEncoder:
    """A worker's encoder; it outlives a task."""
    if (path, kept) not in _encoders:
        _encoders.clear()
        _encoders[path, kept] = PieceEncoder(path, kept)
    return _encoders[path, kept]


def encoded(batches: Iterator[pa.RecordBatch], path: str, end_id: int, kept: int, batch_bytes: int, across_tasks: bool) -> Iterator[pa.RecordBatch]:
    """Rows as STORED has them, of batches of id and text; a task's own encoder is gone before its memory is released."""
    encoder, ord_at = encoder_for(path, kept) if across_tasks else PieceEncoder(path, kept), 0
    for b in batches:
        sizes = pc.binary_length(b.column(1)).to_numpy(zero_copy_only=False)
        first = 0
        while first < len(b):
            held = np.cumsum(sizes[first:], dtype=np.int64)
            n = max(1, int(np.searchsorted(held, batch_bytes, side="right")))
            ids, count = encoder.encode(b.column(1).slice(first, n))
            with_end = np.full(len(ids) + n, end_id, "<u4")
            with_end[np.arange(len(ids)) + np.repeat(np.arange(n), count)] = ids
            count = count + 1
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32)), pa.array(with_end.view("<i4")))
            yield pa.RecordBatch.from_arrays([b.column(0).slice(first, n), pa.array(np.arange(ord_at, ord_at + n)), pa.array(count.astype(np.int32)), lists], names=["doc_id", "ord", "n_tokens", "ids"])
            ord_at, first = ord_at + n, first + n
            del ids, count, with_end, lists
    del encoder
    release()


def write_token_files(docs: DataFrame, target: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, path: str | None = None, kept: int = KEPT, batch_bytes: int = BATCH_BYTES, across_tasks: bool = True) -> str:
    """Writes the ids of docs to ORC files under target, in ascending id order; returns target. Encoded pieces are kept
    from task to task in a worker if across_tasks, which costs its memory afterwards."""
    path = path or vocabulary_path()
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.xxhash64(text_col).alias("h"))
    ordered = rows.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")
    writer = ordered.mapInArrow(lambda batches: encoded(batches, path, end_id, kept, batch_bytes, across_tasks), STORED).write.option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01")
    writer.option("orc.create.index", "true").option("orc.row.index.stride", "1000").option("compression", "zstd").orc(target)
    return target


def read_token_files(spark: SparkSession, source: str) -> DataFrame:
    """doc_id, ids and the id's place (file, ord), as stored."""
    return spark.read.schema(STORED).orc(source).withColumn("file", F.col("_metadata.file_name"))


def _checks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids = b.column(3)
        at, values = ids.offsets.to_numpy(), np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False), "<i4")
        crc = [zlib.crc32(values[at[i] : at[i + 1]]) for i in range(len(ids))]
        n = np.diff(at).astype(np.int64)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(n), pa.array(crc, pa.int64())], names=["doc_id", "ord", "file", "n_tokens", "ids_crc32"])


def token_index(spark: SparkSession, source: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every stored document, from the files."""
    read = read_token_files(spark, source).select("doc_id", "ord", "file", "ids")
    found = read.mapInArrow(_checks, "doc_id bigint, ord bigint, file string, n_tokens bigint, ids_crc32 bigint")
    stored = spark.read.schema(STORED).orc(source).groupBy(F.col("_metadata.file_name").alias("file"))
    # files of one id follow each other by the number in their names, whatever its width
    number = F.regexp_extract("file", r"^part-([0-9]+)", 1).cast("bigint")
    totals = stored.agg(F.sum("n_tokens").alias("file_tokens"), F.min("doc_id").alias("low")).withColumn("number", number)
    return running_sum_in_files(found, totals).select("doc_id", "start", "n_tokens", "ids_crc32")


def running_sum_in_files(found: DataFrame, totals: DataFrame) -> DataFrame:
    """Adds start. Totals has one row per file; a file's smallest id, then its number, order the files (no id comes first)."""
    before = Window.orderBy(F.col("low").asc_nulls_first(), "number", "file").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("file", F.coalesce(F.sum("file_tokens").over(before), F.lit(0)).alias("file_start"))
    inside = Window.partitionBy("file").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    return found.withColumn("in_file", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(starts, "file").withColumn("start", F.col("in_file") + F.col("file_start"))


def encode_and_index(docs: DataFrame, target: str | None = None, kept: int = KEPT, batch_bytes: int = BATCH_BYTES, across_tasks: bool = True) -> DataFrame:
    spark = docs.sparkSession
    return token_index(spark, write_token_files(docs, target or new_path(spark, "token-ids"), kept=kept, batch_bytes=batch_bytes, across_tasks=across_tasks))


def query(spark, sf_dir: str) -> DataFrame:
    """op10: every document's place in the token files."""
    return encode_and_index(spark.read.parquet(f"{sf_dir}/documents.parquet"))
