"""The pipeline as a whole, stage by stage against brute force: nulls, empty texts, repeated rows, null ids, near copies,
benchmark passages; and an empty table."""

import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from landloom.llm import decontamination, language, mixing, token_counts, token_files
from tests.compare import oracle_rows
from tests.llm.test_llm import SF, brute_classes

LOW = str.maketrans({i: i + 32 for i in range(65, 91)})


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))


def shingles(w, size):
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}


def stored(rows):
    return [(r.doc_id, r.text) for r in rows.select("doc_id", "text").collect()]


def order(x):
    return (x[0] is None, x[0] or 0, x[1] or "")


def test_pipeline_by_brute_force(spark, tmp_path):
    base = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [tuple(r) for r in base.collect()]
    item = spark.read.parquet(f"{SF}/benchmark.parquet").where("text IS NOT NULL").orderBy(F.desc(F.length("text"))).first().text
    long = [r for r in rows if r[1] and len(r[1].split()) > 120][:6]
    more = [(9000 + i, r[1] + " another", *r[2:]) for i, r in enumerate(long)] + [long[0], long[0], (None, long[1][1], *long[1][2:]), (None, None, None, None, None), (9100, None, "en", "web", 0), (9101, "", None, None, 0)]
    more += [(9102, f"{long[2][1]} {item} {long[3][1]}", "en", None, 1), (9103, "12 34 !!", "en", "web", 1), (9104, " ".join(x[1] for x in long) * 3, None, "books", 1)]
    spark.createDataFrame(rows + more, base.schema).repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, sf = spark.read.parquet(str(tmp_path / "documents.parquet")), str(tmp_path)
    after = {}
    for name, stage in corpus_pipeline.STAGES:
        after[name] = corpus_pipeline.materialise(stage(spark, docs, sf), "t")
        if name != corpus_pipeline.STAGES[-1][0]:
            assert after[name].columns == base.columns
            docs = after[name]

    labels = language.label_documents(spark.read.parquet(f"{sf}/documents.parquet").withColumn("doc_id", F.xxhash64("text", "doc_id")))
    good = {r.id for r in labels.where((F.col("lang_pred") != "und") & (F.col("score") >= language.MIN_SCORE)).collect()}
    keyed = spark.read.parquet(f"{sf}/documents.parquet").withColumn("k", F.xxhash64("text", "doc_id")).collect()
    first = stored(after["language"])
    assert Counter(first) == Counter((r.doc_id, r.text) for r in keyed if r.k in good) and len(first) < len(keyed)

    label = brute_classes([t for _, t in first])
    best = {}
    for c, row in zip(label, first, strict=True):
        best[c] = min(best.get(c, row), row, key=lambda x: (x[0] is None, x[0] or 0))
    second = stored(after["near_duplicates"])
    assert sorted(i for i, _ in second if i is not None) == sorted(i for i, _ in best.values() if i is not None) and len(second) == len(best) < len(first)

    items = [w for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect() if (w := words(r.text))]
    def leaked(text):
        w = words(text)
        by = {k: shingles(w, k) for k in range(1, 6)}
        return any(len(own & by[min(5, len(i))]) >= decontamination.CONTAINMENT * len(own) - 1e-9 for i in items for own in [shingles(i, min(5, len(i)))])
    third = stored(after["decontamination"])
    assert Counter(third) == Counter(r for r in second if not leaked(r[1])) and len(third) < len(second)

    after["decontamination"].write.parquet(str(tmp_path / "mixed" / "documents.parquet"))
    plan = oracle_rows(str(tmp_path / "mixed"), mixing.ORACLE)
    size = {i: len(words(t)) for i, t in third}
    want = Counter({int(r.doc_id): int(np.floor(r.taken / size[int(r.doc_id)] + 0.5)) for r in plan.itertuples() if size[int(r.doc_id)]})
    fourth = stored(after["mixing"])
    assert Counter(i for i, _ in fourth) == +want

    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(token_counts.vocabulary_path("word_bpe_49k.json"))
    fifth, start = after["token_ids"].orderBy("start").collect(), 0
    by_id = dict(fourth)
    assert [r.doc_id for r in fifth] == [i for i, _ in sorted(fourth, key=order)]
    for r in fifth:
        ids = [*tokenizer.encode(by_id[r.doc_id] or "", add_special_tokens=False).ids, token_files.END_ID]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_pipeline_of_nothing(spark, tmp_path):
    spark.read.parquet(f"{SF}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
