"""The operators against brute force on small fixtures: nulls, empty and long texts, ties, repeated rows, extra columns,
empty tables."""

import datetime
import gc
import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from landloom.llm import components, decontamination, exact_dedup, language, mixing, pseudonyms, scoring, simhash, token_counts, token_files, url_rules
from tests.compare import difference, oracle_rows

SF = "/root/testdata/sf0.001"
KEY = "a test key"
LOW = str.maketrans({i: i + 32 for i in range(65, 91)})
WORDS = "the of and plan road river house map zone land".split()
TEXTS = [None, "", "  \n", "One", "one", "ONE", "Ünïcode É É", "a b c d e f g", "a b c d e f g", "x" * 3000, " ".join(WORDS * 40), " ".join(WORDS * 40) + " end", "12 34 !!", "Mixed CASE words Here", "mixed case words here"]


def docs(spark, texts=TEXTS, extra=True):
    rows = [(i, t, ("en", "de", None)[i % 3], ("a", "b", None)[i % 3], 0) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    if extra:  # names that the operators might use themselves
        for c in ("id", "h", "digest", "norm", "salt", "keep_id", "score", "size", "node", "fp", "order", "start", "ord"):
            df = df.withColumn(c, F.lit("x"))
    return df


def empty(spark):
    return docs(spark).limit(0)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))


# exact dedup


def test_exact_dedup(spark):
    d = docs(spark).unionByName(docs(spark).where("doc_id = 3"))
    groups = defaultdict(list)
    for i, t in [*enumerate(TEXTS), (3, TEXTS[3])]:
        groups[(t or "").translate(LOW)].append(i)
    got = exact_dedup.duplicate_groups(d).collect()
    assert len(got) == len(TEXTS) + 1
    for r in got:
        k = (TEXTS[r.id] or "").translate(LOW)
        assert (r.keep_id, r.group_size, r.kept, bytes(r.digest)) == (max(groups[k]), len(groups[k]), r.id == max(groups[k]), hashlib.sha256(k.encode()).digest())
    assert exact_dedup.duplicate_groups(empty(spark)).count() == 0
    assert exact_dedup.drop_duplicates(docs(spark)).columns == docs(spark).columns


def test_exact_dedup_null_ids(spark):
    d = spark.createDataFrame([(None, "a"), (1, "A"), (None, "b")], "doc_id long, text string")
    got = {(r.id, r.keep_id, r.kept) for r in exact_dedup.duplicate_groups(d).collect()}
    assert got == {(None, 1, False), (1, 1, True), (None, None, True)}


def test_exact_dedup_sql(spark):
    assert difference(exact_dedup.query(spark, SF).toPandas(), oracle_rows(SF, exact_dedup.ORACLE)) == ""


# SimHash


def brute_fingerprint(t, size=3):
    w = words(t)
    sh = [" ".join(w[i : i + size]) for i in range(len(w) - size + 1)] or ([" ".join(w)] if w else [])
    c = Counter(i for s in sh for h in [xxhash.xxh64_intdigest(s.encode(), 42)] for i in range(64) if h >> i & 1)
    return sum(1 << i for i in range(64) if 2 * c[i] > len(sh))


def test_simhash_classes(spark):
    rng = random.Random(3)
    base = [rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(400)]
    texts = TEXTS + [" ".join(base[:k] + ["zz"] + base[k + 1 :]) for k in range(0, 400, 10)]
    fp = {i: brute_fingerprint(t) for i, t in enumerate(texts)}
    label = dict.fromkeys(fp)
    for i in fp:
        if label[i] is None:
            todo = [i]
            while todo:
                x = todo.pop()
                if label[x] is None:
                    label[x] = i
                    todo += [y for y in fp if (fp[x] ^ fp[y]).bit_count() <= 2]
    got = {r.id: (r.fp & (1 << 64) - 1, r.component_id) for r in simhash.near_duplicate_classes(docs(spark, texts)).collect()}
    assert got == {i: (fp[i], label[i]) for i in fp} and len(set(label.values())) < len(fp)
    assert simhash.near_duplicate_classes(empty(spark)).count() == 0


def test_similar_classes_by_similarity(spark):
    rng = random.Random(4)
    base = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    near = [" ".join(base[:k] + ["zz"] + base[k + 1 :]) for k in (20, 90, 170)]
    far = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(300)) for _ in range(5)]
    half = " ".join(base[:150] + [f"w{rng.randrange(10**6)}" for _ in range(150)])
    texts = [" ".join(base), *near, *far, half, None, ""]
    got = {r.id: r.component_id for r in simhash.similar_classes(docs(spark, texts)).collect()}
    assert [got[i] for i in range(4)] == [0] * 4 and all(got[i] == i for i in range(4, 10)) and got[10] == got[11] == 10
    kept = simhash.drop_near_duplicates(docs(spark, texts))
    assert {r.doc_id for r in kept.collect()} == {0, *range(4, 11)} and kept.columns == docs(spark, texts).columns
    assert simhash.drop_near_duplicates(empty(spark)).count() == 0


def brute_classes(texts, shingle=5, least=0.8):
    """Component of each text by comparing all pairs."""
    sets = [set(simhash.shingle_hashes((t or "").encode(), shingle, simhash.SEED).tolist()) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= least * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(texts))]


def test_similar_classes_under_templates(spark, monkeypatch):
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(10**6)}"
    texts = []
    for _ in range(3):  # a template of half to four fifths of each text; a pair's ids are far apart
        shared = [word() for _ in range(120)]
        own = [[word() for _ in range(rng.randrange(30, 90))] for _ in range(25)]
        first = [shared + o for o in own]
        texts += first + [[*t[:-4], *(word() for _ in range(4))] for t in first]
    for _ in range(6):  # families whose texts drift apart
        t = [word() for _ in range(60)]
        for _ in range(12):
            t = list(t)
            t[rng.randrange(60)] = word()
            texts.append(t)
    rng.shuffle(texts)
    texts = [" ".join(t) for t in texts]
    want = brute_classes(texts)
    assert 60 < len(set(want)) < len(texts) - 60
    for block in (simhash.BLOCK, 7):
        monkeypatch.setattr(simhash, "BLOCK", block)
        got = {r.id: r.component_id for r in simhash.similar_classes(docs(spark, texts)).collect()}
        assert got == dict(enumerate(want))


def test_similar_classes_of_short_texts(spark):
    rng = random.Random(6)
    word = lambda: f"w{rng.randrange(10**6)}"
    texts = []
    for size in range(8, 29):  # a word more at the end: similarity from exactly 0.8 up
        for _ in range(6):
            t = [word() for _ in range(size)]
            texts += [t, [*t, word()]]
    want = brute_classes([" ".join(t) for t in texts])
    assert want == [i - i % 2 for i in range(len(texts))]
    got = {r.id: r.component_id for r in simhash.similar_classes(docs(spark, [" ".join(t) for t in texts])).collect()}
    assert got == dict(enumerate(want))


def test_components_of_a_long_path(spark):
    e = spark.createDataFrame([(i * 7 % 101, (i + 1) * 7 % 101) for i in range(90)], "a long, b long")
    assert {r.root for r in components.components(e).collect()} == {min(i * 7 % 101 for i in range(91))}


# tokens


@pytest.mark.parametrize("name, count", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_tokens_match_the_library(name, count):
    from tokenizers import Tokenizer

    path = token_counts.vocabulary_path(name)
    rng = random.Random(1)
    letters = "ab Z'stéÑ#&*\t\n\r\x0b\x1c\x85\xa0́éÉ½²٣日🙂<|>_-9.,İß"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(3000)] + ["a<|endoftext|> b", "x" * 5000, " " * 300, "", *map(str, TEXTS)]
    wanted = [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    if count:
        m = token_counts.MergeCounter(path)
        assert [m.count(t) for t in texts] == list(map(len, wanted))
    else:
        for kept in (400_000, 50):  # a table that is full at once
            e = token_files.PieceEncoder(path, kept)
            for at in range(0, len(texts), 500):
                ids, sizes = e.encode(pa.array(texts[at : at + 500]))
                assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == wanted[at : at + 500]


def test_other_vocabularies_encode_whole_texts():
    from tokenizers import Tokenizer

    path = token_counts.vocabulary_path("byte_bpe_50k.json")
    ids, sizes = token_files.PieceEncoder(path).encode(pa.array(["one two  three", "", "A b"]))
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [e.ids for e in Tokenizer.from_file(path).encode_batch(["one two  three", "", "A b"], add_special_tokens=False)]


def test_token_counts_rows(spark):
    got = {r.doc_id: r for r in token_counts.token_counts(docs(spark)).collect()}
    assert (got[0].n_bytes, got[0].n_tokens, got[0].over_limit) == (0, 0, False)
    assert got[6].n_bytes == len(TEXTS[6].encode()) and got[10].over_limit == (got[10].n_tokens > 512)
    assert token_counts.token_counts(empty(spark)).count() == 0


def test_token_files_free_a_tasks_encoder_before_they_release(monkeypatch):
    alive = []
    monkeypatch.setattr(token_files, "release", lambda: alive.append(sum(isinstance(x, token_files.PieceEncoder) for x in gc.get_objects())))
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array(["one two", "", "Three!"])], names=["doc_id", "text"])
    gc.collect()
    before = sum(isinstance(x, token_files.PieceEncoder) for x in gc.get_objects())
    out = list(token_files.encoded(iter([batch]), token_files.vocabulary_path(), 1, 100, 8, False))
    assert [i for b in out for i in b.column(0).to_pylist()] == [1, 2, 3] and alive == [before]


def test_encoder_holds_its_model_once():
    encoder = token_files.PieceEncoder(token_files.vocabulary_path())
    encoder.words.model.dropout = 0.5
    assert encoder.tokenizer.model.dropout == 0.5


def test_token_files_round_trip(spark, tmp_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(token_files.vocabulary_path())
    d = docs(spark).unionByName(docs(spark).where("doc_id = 7").withColumn("doc_id", F.lit(None).cast("long")))
    path = token_files.write_token_files(d.repartition(3), str(tmp_path / "ids"))
    got = sorted(token_files.token_index(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, *range(len(TEXTS))]
    start = 0
    for r, text in zip(got, [TEXTS[7], *TEXTS], strict=True):
        ids = t.encode(text or "", add_special_tokens=False).ids + [1]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(token_files.packed(ids)))
        start += len(ids)
    assert token_files.read_token_files(spark, path).where("doc_id = 3").first().ids[-1] == 1
    assert token_files.encode_and_index(empty(spark)).count() == 0


# language


def test_language(spark):
    rng = random.Random(5)
    vocab = {"en": "the and of with road house water".split(), "de": "der und mit straße haus wasser über".split()}
    texts = [" ".join(rng.choice(vocab[k]) for _ in range(60)) for k in ("en", "de") * 60] + [None, "", "12 34 !!", "the and of der und mit the and of with"]
    rows = [(i, t, ("en", "de")[i % 2] if i < 120 else None, "s", 0) for i, t in enumerate(texts)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("score", F.lit(1))
    got = {r.id: r for r in language.label_documents(d).collect()}
    held = [i for i in range(120) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i in got)
    assert sum(got[i].lang_pred == ("en", "de")[i % 2] for i in held) >= 0.98 * len(held)
    assert [(got[i].lang_pred, got[i].score) for i in (120, 121, 122)] == [("und", 0.0)] * 3
    assert got[123].lang_pred == "en" and 0.4 < got[123].score < 1
    assert {r.lang_pred for r in language.label_documents(d.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert {r.doc_id for r in language.keep_languages(d).collect()} == {*range(120), 123}
    assert language.label_documents(empty(spark)).count() == 0


def test_forward_backward_is_exact():
    import itertools

    f = language.Field(["a", "b", "c"], {})
    rng = np.random.default_rng(0)
    f.moves = rng.normal(size=(3, 3))
    lengths, scores = np.array([5, 3, 1]), rng.normal(size=(9, 3))
    got, at = f.marginals(scores, lengths), 0
    for n in lengths:
        s, total = scores[at : at + n], np.zeros((n, 3))
        for path in itertools.product(range(3), repeat=int(n)):
            w = math.exp(sum(s[i, k] for i, k in enumerate(path)) + sum(f.moves[a, b] for a, b in itertools.pairwise(path)))
            for i, k in enumerate(path):
                total[i, k] += w
        assert np.allclose(got[at : at + n], total / total.sum(1, keepdims=True))
        at += n


# pseudonyms


def test_pseudonyms(spark):
    private = "4111 1111 1111 1111 x 4111111111111111 y GB82 WEST 1234 5698 7654 32 z 2024-02-29 and 29/02/2024 at 10.1.2.3 for x.y9@mail.example.com or +1 (017) 555-7713"
    texts = [private, private + " more", "id 4111111111111112 and 2023-02-30 and 300.1.1.1 and 12 34", None, "", "no numbers", "7" * 40]
    d = docs(spark, texts)
    got = [r.text for r in pseudonyms.pseudonymise(d, KEY).orderBy("doc_id").collect()]
    other = [r.text for r in pseudonyms.pseudonymise(d, "another key").orderBy("doc_id").collect()]
    assert other[2:] == got[2:] and other[0] != got[0]
    assert got[2:] == texts[2:] and got[1] == got[0] + " more"
    shape = lambda t: re.sub(r"[a-z]", "a", re.sub(r"\d", "9", re.sub(r"\d+\.\d+\.\d+\.\d+", "IP", t)))
    assert shape(got[0]).replace("A", "X") and len(shape(got[0])) == len(shape(private)) and got[0] != private
    cards = re.findall(r"(?<!\d)\d{4} ?\d{4} ?\d{4} ?\d{4}(?!\d)", got[0])[:2]
    assert cards[0].replace(" ", "") == cards[1] != "4111111111111111"
    total = sum(x if i % 2 == 0 else (2 * x - 9 if 2 * x > 9 else 2 * x) for i, x in enumerate(map(int, reversed(cards[1]))))
    assert total % 10 == 0
    day, same = re.search(r"(\d{4})-(\d\d)-(\d\d)", got[0]), re.search(r"(\d\d)/(\d\d)/(\d{4})", got[0])
    assert day.groups() == same.groups()[::-1]
    assert all(int(x) < 256 for x in re.search(r"at (\S+) for", got[0])[1].split("."))
    assert pseudonyms.pseudonymise(empty(spark), KEY).count() == 0


def test_pseudonyms_beside_other_numbers(spark):
    texts = ["4111 1111 1111 1111", "card 4111 1111 1111 1111 12/26", "4111111111111111 123 ok", "12 4111 1111 1111 1111", "BE68 5390 0754 7034 AND", "BE68539007547034 FOR", "BE68 5390 0754 7034 4111 1111 1111 1111", "4111 1111 1111 1112 12"]
    got = [(re.sub(r"[ /]", "", r.text), r.n_card, r.n_iban) for r in pseudonyms.pseudonymise(docs(spark, texts), KEY).orderBy("doc_id").collect()]
    card, iban = got[0][0], got[5][0].removesuffix("FOR")
    assert card != "4111111111111111" and iban != "BE68539007547034"
    assert got == [(card, 1, 0), (f"card{card}1226", 1, 0), (f"{card}123ok", 1, 0), (f"12{card}", 1, 0), (f"{iban}AND", 0, 1), (f"{iban}FOR", 0, 1), (iban + card, 1, 1), ("411111111111111212", 0, 0)]


def test_pseudonyms_keep_formats(spark):
    texts = ["02/29/2024", "29/02/2024", "2024-02-29", "12/25/1999", "1999-12-25", "12/05/1799", "1/2/2024", "01.02.2024", "079203012345", "a@mail.example.com b@mail.example.com", "000203012345", "0000-01-01"]
    got = [r.text for r in pseudonyms.pseudonymise(docs(spark, texts), KEY).orderBy("doc_id").collect()]
    assert all(x != y for x, y in zip(got[:10], texts, strict=False)) and got[10:] == texts[10:]
    assert re.fullmatch(r"\d\d/\d\d/\d{4}", got[0]) and got[0][:2] == got[1][3:5] and got[0][3:5] == got[1][:2] and got[0][6:] == got[1][6:]
    assert got[2] == f"{got[1][6:]}-{got[1][3:5]}-{got[1][:2]}" and got[4] == f"{got[3][6:]}-{got[3][:2]}-{got[3][3:5]}"
    assert re.fullmatch(r"[1-9]/[1-9]/\d{4}", got[6]) and [f"{int(x):02d}" for x in got[6].split("/")[:2]] == got[7].split(".")[:2]
    assert re.fullmatch(r"\d{12}", got[8]) and 1 <= int(got[8][:3]) <= 96
    domains = re.findall("@(\\S+)", got[9])
    assert domains[0] == domains[1] != "mail.example.com" and re.fullmatch(r"[a-z]{4}\.[a-z]{7}\.com", domains[0])


def test_pseudonyms_of_long_and_repeated_texts(spark):
    long = "4111 1111 1111 1111 " + "x 7 " * 50_000 + " 12/25/1999"
    got = [r.text for r in pseudonyms.pseudonymise(docs(spark, [long, long]), KEY).collect()]
    assert got[0] == got[1] and got[0][20:-11] == long[20:-11] and got[0][:19] != long[:19] and got[0][-10:] != long[-10:]


def luhn(d):
    return sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(map(int, reversed(d))))


def rest97(account):
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97


def feistel(values, radices, label, key):
    half = len(values) // 2
    sides, rads = [list(values[:half]), list(values[half:])], [radices[:half], radices[half:]]
    for k in range(1, pseudonyms.ROUNDS + 1):
        here, there = (0, 1) if k % 2 == 0 else (1, 0)
        seed = f"{key}|{label}|{k}|" + ",".join(map(str, sides[there]))
        hexes = [hashlib.sha256(f"{seed}|{i // 7}".encode()).hexdigest()[i % 7 * 9 : i % 7 * 9 + 9] for i in range(len(sides[here]))]
        sides[here] = [(x + int(h, 16)) % r for x, h, r in zip(sides[here], hexes, rads[here], strict=True)]
    return sides[0] + sides[1]


def moved(symbols, label, key):
    low = [48 if c.isdigit() else 65 if c.isupper() else 97 for c in symbols]
    shape = "".join(chr(x) for x in low)
    out = feistel([ord(c) - x for c, x in zip(symbols, low, strict=True)], [10 if x == 48 else 26 for x in low], f"{label}:{shape}", key)
    return "".join(chr(v + x) for v, x in zip(out, low, strict=True))


def spread(symbols, value):
    left = iter(symbols)
    return re.sub("[A-Za-z0-9]", lambda _: next(left), value)


def day_of(v):
    n = list(map(int, re.split(r"[-/.]", v)))
    for order in [n] if v[4] == "-" else [n[::-1], [n[2], n[0], n[1]]]:
        try:
            return datetime.date(*order)
        except ValueError:
            pass
    return None


def date_class(d):
    leap = (datetime.date(d.year, 3, 1) - datetime.timedelta(1)).day == 29
    return (d.year - 1800) // 400 * 400 + 1800, leap, 3 * (d.month > 9) + (d.day > 9) + (d.day > 12)


def moved_day(d, key):
    """By listing all dates of its class."""
    low, leap, kind = date_class(d)
    years = [y for y in range(max(low, 1), min(low + 400, 10_000)) if date_class(datetime.date(y, 1, 1))[1] == leap]
    days = [(x.month, x.day) for k in range(366 if leap else 365) for x in [datetime.date(2000 if leap else 2001, 1, 1) + datetime.timedelta(k)] if date_class(x)[2] == kind]
    a, b = feistel([years.index(d.year), days.index((d.month, d.day))], [len(years), len(days)], f"date:{low}:{str(leap).lower()}:{kind}", key)
    return datetime.date(years[a], *days[b])


def kind_by_hand(v):
    full = lambda p: re.fullmatch(p, v)
    plain = re.sub("[^A-Za-z0-9]", "", v)
    if full(pseudonyms._EMAIL):
        return "email"
    if full(pseudonyms._DATE):
        return "date" if day_of(v) else None
    if full(pseudonyms._IP):
        return "ip" if all(int(o) < 256 for o in v.split(".")) else None
    if full(pseudonyms._SSN):
        return "ssn"
    if full(pseudonyms._IBAN):
        return "iban" if rest97(plain) == 1 else None
    if full(pseudonyms._CARD) and luhn(plain) % 10 == 0:
        return "card"
    if full(r"\d{12}"):
        return "national" if 1 <= int(v[:3]) <= 96 else None
    return "phone" if full(pseudonyms._PHONE) or full(pseudonyms._PLUS) else None


def pseudonym_by_hand(v, kind, key):
    plain = re.sub("[^A-Za-z0-9]", "", v)
    if kind == "email":
        local, domain = v.split("@")
        host, last = domain.rsplit(".", 1)
        return spread(moved(re.sub("[^A-Za-z0-9]", "", local), kind, key), local) + "@" + spread(moved(re.sub("[^A-Za-z0-9]", "", host), "domain", key), host) + "." + last
    if kind == "date":
        new = moved_day(day_of(v), key)
        if v[4] == "-":
            return f"{new.year:04d}-{new.month:02d}-{new.day:02d}"
        x, y, _ = re.split("[/.]", v)
        m, n = (new.month, new.day) if int(y) > 12 else (new.day, new.month)
        sign = v[len(x)]
        return f"{m:0{len(x)}d}{sign}{n:0{len(y)}d}{sign}{new.year:04d}"
    if kind == "national":
        p, c, y, a, b = feistel([int(v[:3]) - 1, int(v[3]), int(v[4:6]), int(v[6:9]), int(v[9:])], [96, 10, 100, 1000, 1000], kind, key)
        return f"{p + 1:03d}{c}{y:02d}{a:03d}{b:03d}"
    if kind == "ip":
        return ".".join(map(str, feistel(list(map(int, v.split("."))), [256] * 4, kind, key)))
    if kind == "ssn":
        return spread(moved(plain, kind, key), v)
    if kind == "iban":
        account = moved(plain[4:], kind, key)
        return spread(f"{plain[:2]}{98 - rest97(plain[:2] + '00' + account):02d}{account}", v)
    if kind == "card":
        head = moved(plain[:-1], kind, key)
        return spread(head + str(-luhn(head + "0") % 10), v)
    code = re.match(r"(?:\+[0-9]{1,3}[ .-]?)?", v)[0]
    return code + spread(moved(re.sub("[^0-9]", "", v[len(code) :]), kind, key), v[len(code) :])


def pieces_by_hand(v):
    number = f"{pseudonyms._CARD}|{pseudonyms._IBAN}"
    if kind_by_hand(v) or not re.fullmatch(number, v):
        return [(v, kind_by_hand(v))]
    out, i = [], 0
    while i < len(v):
        ends = [e for e in range(len(v), i + 11, -1) if v[i] not in " -" and (i == 0 or v[i - 1] in " -") and v[e - 1] not in " -" and (e == len(v) or v[e] in " -")]
        valid = next((e for e in ends if re.fullmatch(number, v[i:e]) and kind_by_hand(v[i:e]) in ("card", "iban")), None)
        out.append((v[i : valid or i + 1], valid and kind_by_hand(v[i:valid])))
        i = valid or i + 1
    return out


def private_texts():
    draw = random.Random(5)
    digits = lambda n: "".join(draw.choice("0123456789") for _ in range(n))

    def card():
        head = digits(draw.choice((12, 14, 15, 15, 18)))
        d = head + str(-luhn(head + "0") % 10)
        return draw.choice((d, " ".join(re.findall(".{1,4}", d)), "-".join(re.findall(".{1,4}", d))))

    def iban():
        account = digits(draw.choice((12, 14, 18))) if draw.random() < 0.5 else "WEST" + digits(14)
        d = f"GB{98 - rest97('GB00' + account):02d}{account}"
        return draw.choice((d, " ".join(re.findall(".{1,4}", d))))

    date = lambda: draw.choice(("{0:04d}-{1:02d}-{2:02d}", "{2}/{1}/{0:04d}", "{2:02d}.{1:02d}.{0:04d}", "{1:02d}/{2:02d}/{0:04d}", "{1}/{2}/{0:04d}")).format(draw.choice((draw.randint(1790, 2210), draw.randint(0, 9999))), draw.randint(1, 13), draw.randint(1, 31))
    ip = lambda: ".".join(str(draw.randint(0, 270)) for _ in range(4))
    email = lambda: draw.choice(("x", "a.B9", "Long-Name_7+t")) + "@" + draw.choice(("mail.example.com", "h.org"))
    phone = lambda: draw.choice((f"+1 ({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}", f"+44 {digits(4)} {digits(3)} {digits(3)}"))
    makers = (card, iban, date, ip, email, phone, lambda: f"{digits(3)}-{digits(2)}-{digits(4)}", lambda: digits(draw.randint(1, 20)), lambda: "0" + digits(11), lambda: draw.choice(("AND", "word", "12/26", "(", ".", "Đất")))
    texts = [" ".join(draw.choice(makers)() for _ in range(draw.randint(1, 12))) for _ in range(250)]
    return [*texts, " and ".join(texts), None, "", "no numbers", "7" * 40, texts[0], texts[0]]


def test_pseudonyms_query_against_brute_force(spark, tmp_path):
    """The registered query, on drawn values of every kind and on the given documents."""
    given = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    docs(spark, [*private_texts(), *given]).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    key, seen = pseudonyms.QUERY_KEY, Counter()
    rows = pseudonyms.query(spark, str(tmp_path)).orderBy("doc_id").collect()
    assert len(rows) == len(given) + len(private_texts())
    for r, t in zip(rows, [*private_texts(), *given], strict=True):
        finds = [] if t is None else [x for m in re.finditer(pseudonyms.CANDIDATE, t) for x in pieces_by_hand(m[0])]
        n = Counter(k for _, k in finds if k)
        want = t and re.sub(pseudonyms.CANDIDATE, lambda m: "".join(pseudonym_by_hand(v, k, key) if k else v for v, k in pieces_by_hand(m[0])), t)
        assert (r.text, r.n_private, [r[f"n_{k}"] for k in pseudonyms.KINDS]) == (want, n.total(), [n[k] for k in pseudonyms.KINDS])
        seen += n
    assert all(seen[k] > 20 for k in pseudonyms.KINDS)


def test_permutation_is_one_to_one(spark):
    v = F.array((F.col("id") % 7).cast("int"), F.floor(F.col("id") / 7).cast("int"))
    out = spark.range(77).select(pseudonyms.permuted(v, F.array(F.lit(7), F.lit(11)), F.lit("t"), KEY).alias("p"))
    assert out.distinct().count() == 77 and out.where("p[0] >= 7 OR p[1] >= 11").count() == 0


# decontamination


def test_decontamination(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"
    cut = " ".join(item.split()[:-3])  # 13 of 16 shingles
    less = " ".join(item.split()[:-5])  # 11 of 16
    items = spark.createDataFrame([(1, item), (2, item.upper()), (3, "two words"), (4, None), (5, " ")], "item_id long, text string")
    texts = [f"{'pad ' * 900}{item}{' pad' * 900}", cut, less, None, "", "Two  WORDS here", item + " " + item]
    got = {(r.doc_id, r.item_id): (r.item_copies, r.shared, r.item_shingles) for r in decontamination.contained_items(docs(spark, texts), items).collect()}
    assert got == {(0, 1): (2, 16, 16), (1, 1): (2, 13, 16), (6, 1): (2, 16, 16), (5, 3): (1, 1, 1)}
    assert {r.doc_id for r in decontamination.clean(docs(spark, texts), items).collect()} == {2, 3, 4}
    assert decontamination.contained_items(docs(spark, texts), items.limit(0)).count() == 0
    assert decontamination.contained_items(empty(spark), items).count() == 0


# URL rules


def test_url_rules(spark):
    urls = ["http://EXAMPLE.org/es/1", "https://a.example.org/en/12?x", "http://x.org/", "http://org", "http://badexample.org/es/", "http://b.com/de/x#f", "http://b.com/other", None, "no scheme", "http://x.org?/q"]
    pages = spark.createDataFrame([(i, u, 1) for i, u in enumerate(urls)], "page_id long, url string, host int")
    rules = spark.createDataFrame(url_rules.RULES, "verdict string, host string, path string")
    got = [(r.host, r.path, r.rule, r.verdict) for r in url_rules.filter_urls(pages, rules).orderBy("page_id").collect()]
    assert got == [
        ("example.org", "/es/1", "example.org/es/", "block"), ("a.example.org", "/en/12", "example.org/en/1", "block"), ("x.org", "/", "org/", "allow"), ("org", "", None, "allow"), ("badexample.org", "/es/", "org/", "allow"),
        ("b.com", "/de/x", "com/de/", "block"), ("b.com", "/other", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("x.org", "", None, "allow"),
    ]
    assert url_rules.filter_urls(pages.limit(0), rules).count() == 0 and url_rules.filter_urls(pages, rules.limit(0)).where("rule IS NOT NULL").count() == 0



def test_url_of_many_labels(spark):
    """Linear in the host's length, and right at every label count."""
    rules = spark.createDataFrame([("block", "b.c.example", "/"), ("block", "example", "/x/"), ("allow", "a.b.c.example", "/x")], "verdict string, host string, path string")
    urls = ["http://" + "a." * 20_000 + "b.c.example/y", "http://" + "." * 40_000 + "/x/", "http://example/x/", "http://c.example/x/1", "http://b.c.example/", "http://z.a.b.c.example/x", "http://xb.c.example/", "http://.example/x/"]
    began = time.time()
    got = {r.page_id: (r.rule, r.verdict) for r in url_rules.filter_urls(spark.createDataFrame([*enumerate(urls)], "page_id long, url string"), rules).collect()}
    assert time.time() - began < 30
    assert got == {0: ("b.c.example/", "block"), 1: (None, "allow"), 2: ("example/x/", "block"), 3: ("example/x/", "block"), 4: ("b.c.example/", "block"), 5: ("a.b.c.example/x", "allow"), 6: (None, "allow"), 7: ("example/x/", "block")}


def test_url_rules_sql(spark):
    assert difference(url_rules.query(spark, SF).toPandas(), oracle_rows(SF, url_rules.ORACLE)) == ""


# scoring


def test_scoring(spark):
    d = docs(spark, TEXTS * 3)
    c = Counter()
    for i, t in enumerate(TEXTS * 3):
        if zlib.crc32(str(i).encode()) % 7 != 2:
            c.update([*words(t), None])
    n, v = c.total(), len(c)
    got = {r.id: r for r in scoring.score(d).collect()}
    assert len(got) == 3 * len(TEXTS)
    for i, t in enumerate(TEXTS * 3):
        w = [*words(t), None]
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (zlib.crc32(str(i).encode()) % 7 == 2, len(w), sum(c[x] > 0 for x in w), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)) and r.score < 0
    assert scoring.score(empty(spark)).count() == 0


def test_model_score_by_brute_force(spark):
    """Token by token from the parameters: both steps summed over all ids and over all words of a class, and the unmet."""
    rng = random.Random(8)
    texts = [" ".join(rng.choice(WORDS) + rng.choice(["", "s", "ing", "et", str(rng.randrange(90))]) for _ in range(rng.randrange(90))) for _ in range(60)] + TEXTS
    d = docs(spark, texts)
    _, counted, f = scoring.fit(d)
    m, top = f.model, f.top.to_pylist()
    c = {bytes(r.word): r.c for r in counted.where("word IS NOT NULL").collect()}
    kind = lambda w: int(scoring.forms(pa.array([w], pa.binary()))[0][0])
    form = lambda w: m.form[scoring.forms(pa.array([w], pa.binary()))[1][0]].astype(float).sum(0)
    number = lambda w: 0 if w == b"\n" else top.index(w) + 1 if w in top else 1 + len(top) + kind(w)
    tail = [w for w in c if number(w) > len(top)]

    def chance(u, v, w):
        q = m.R[u] * m.c[0] + m.R[v] * m.c[1]
        s = np.array([q.astype(float) @ m.Q[k] + m.bias[k] for k in range(len(m.bias))])
        p = math.exp(s[number(w)]) / np.exp(s).sum()
        if number(w) <= len(top):
            return p
        head = m.inner[v if v < scoring.HEADS else scoring.HEADS + v % scoring.REST].astype(float)
        weight = {x: (c[x] + 1) * math.exp(head @ form(x)) for x in tail if kind(x) == kind(w)}
        return p * weight.get(w, 1) / (1 + sum(weight.values()))

    got = {r.id: r.score for r in scoring.score(d).collect()}
    assert m.bias.shape == (1 + len(top) + scoring.CLASSES,)
    for i in [*range(0, 60, 7), *range(60, len(texts))]:
        w = [x.encode() for x in words(texts[i])] + [b"\n"]
        n = [0, 0, *map(number, w)]
        assert got[i] == pytest.approx(sum(math.log10(chance(n[k], n[k + 1], x)) for k, x in enumerate(w)), rel=1e-4)


def test_model_learns(monkeypatch):
    monkeypatch.setattr(scoring, "NOISE", 8)
    m = scoring.LogBilinear(np.log(np.array([0.1, 0.1, 0.4, 0.4])), 3)
    u, w = np.array([2, 3] * 200), np.array([3, 2] * 200)  # word 3 after (2, 2), word 2 after (3, 3)
    for k in range(300):
        m.train(u, u, w, np.random.default_rng(k), 0.1)
    a, b, norm = m.tables()
    p = np.exp(a[2] + b[2] - norm[2, 2])
    assert p.sum() == pytest.approx(1, abs=1e-5) and p[3] > 0.7
    for _ in range(300):  # form 5 after head 1, against form 6
        m.train_inner(np.full(50, 1), np.full((50, 3), 5), np.full((50, scoring.INNER_NOISE, 3), 6), 0.1)
    assert m.factors(np.array([[5] * 3]))[0, 1] > 3 * m.factors(np.array([[6] * 3]))[0, 1]


def test_parts_are_merged_in_a_tree(spark, monkeypatch):
    monkeypatch.setattr(scoring, "FAN", 3)
    parts = spark.createDataFrame([(i, float(i + 1), np.array([i, 2.0 * i]).tobytes()) for i in range(20)], scoring.PART)
    weight, mean = scoring.tree_mean(parts, 20)
    assert weight == 210 and mean == pytest.approx(np.array([1, 2]) * sum(i * (i + 1) for i in range(20)) / 210)


# mixing


def test_mixing(spark):
    rng = random.Random(2)
    texts = [" ".join(WORDS[: rng.randrange(10)] * rng.randrange(1, 30)) for _ in range(400)] + [None, ""]
    rows = [(i, t, None if i % 20 == 0 else "abc"[min(2, i % 7)], 0) for i, t in enumerate(texts)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long").withColumn("size", F.lit("x"))
    got = {r.id: r for r in mixing.mix(d, block=50).collect()}
    assert len(got) == len(texts) and all(got[i].size == len(words(t)) for i, t in enumerate(texts))
    total, by = sum(r.size for r in got.values()), defaultdict(list)
    for i, _, s, _ in rows:
        by[s].append(got[i])
    assert sum(v[0].target for v in by.values()) == pytest.approx(1.5 * total)
    for v in by.values():
        assert abs(sum(r.taken for r in v) - v[0].target) <= 0.5 and all(0 <= r.taken <= 2 * r.size for r in v)
    assert {r.id: r.taken for r in mixing.mix(d.repartition(5), block=50).collect()} == {i: r.taken for i, r in got.items()}
    assert mixing.mix(d.limit(0)).count() == 0 and mixing.mixed(d).columns == d.columns


def test_rows_are_judged_by_their_own_text(spark):
    """Null and repeated ids: each row keeps its own verdict."""
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    fine, near = " ".join(WORDS * 9), " ".join(WORDS * 9) + " end"
    rows = [(None, item), (None, fine), (5, item), (5, fine), (5, fine), (5, None), (6, near), (None, near)]
    d = spark.createDataFrame([(i, t, "en", "s", k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    left = lambda df: sorted(r.n_chars for r in df.collect())
    assert left(decontamination.clean(d, items)) == [1, 3, 4, 5, 6, 7]
    kept = left(simhash.drop_near_duplicates(d))
    assert len(kept) == 3 and {2, 5} < set(kept) and {3, 4} & set(kept)
    taken = defaultdict(int)
    for r in mixing.mixed(d, block=4).collect():
        taken[r.n_chars] += 1
    assert 5 not in taken and set(taken) <= set(range(8)) and taken[3] == taken[4]
    langs = spark.createDataFrame([(None, "the and of with road house", "en"), (None, "12", "en"), (3, "the and of", "en"), (3, "??", None)] * 3, "doc_id long, text string, lang string")
    assert {r.text for r in language.keep_languages(langs).collect()} == {"the and of with road house", "the and of"}


def test_links_of_crowded_segments(spark):
    rng = random.Random(9)
    base = [rng.getrandbits(64) for _ in range(4)]
    fps = {b ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(4))) & (1 << 64) - 1 for b in base for _ in range(120)}
    fps |= {base[0] ^ rng.getrandbits(32) for _ in range(150)} | {base[1] ^ rng.getrandbits(32) << 32 for _ in range(150)}
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    want = {(min(a, b), max(a, b)) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 2}
    nodes = spark.createDataFrame([(x,) for x in signed], "fp long")
    for crowd in (64, 5):
        assert {(r.a, r.b) for r in simhash.links(nodes, crowd).collect()} == want and len(want) > 100


def test_forest_keeps_components(spark):
    rng = random.Random(10)
    e = [(rng.randrange(300), rng.randrange(300)) for _ in range(260)]
    less = components.forest(spark.createDataFrame(e, "a long, b long").coalesce(1)).collect()
    find = lambda pairs: {r.node: r.root for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert find(e) == find([(r.a, r.b) for r in less]) and len(less) < len({x for p in e for x in p})


def test_all_runs_of_letters_are_words(spark):
    assert language.words_of("und/oder,HELLO") == ["und", "oder", "hello"] and language.words_of("123") == []
    assert language.words_of("中文字,很") == ["中文", "字", "很"] and max(map(len, language.words_of("x" * 5000))) == 40
    texts = ["the/and/of/with/road", "der,und,mit,straße", "the and of der und mit straße"] * 30
    d = spark.createDataFrame([(i, t, ("en", "de", None)[i % 3]) for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    got = {r.id: [(w.word, w.lang) for w in r.words] for r in language.label_words(d).collect()}
    assert got[2] == [(w, "en") for w in ("the", "and", "of")] + [(w, "de") for w in ("der", "und", "mit", "straße")]
    assert [w for w, _ in got[0]] == ["the", "and", "of", "with", "road"]


def test_mixing_sql(spark):
    assert difference(mixing.query(spark, SF).toPandas(), oracle_rows(SF, mixing.ORACLE)) == ""


def test_pipeline(spark):
    import corpus_pipeline

    got = corpus_pipeline.run(spark, SF).collect()
    assert got and sum(r.n_tokens for r in got) == max(r.start + r.n_tokens for r in got)


def test_similar_texts_are_linked_by_fingerprint(spark, monkeypatch):
    rng = random.Random(12)
    word = lambda: f"w{rng.randrange(10**6)}"
    texts = []
    for _ in range(20):
        t = [word() for _ in range(300)]
        texts += [" ".join(t), " ".join([*t[:-1], word()]), " ".join([*t, word()])]
    texts += [None, "", "a b", "A  b"]
    fps = [simhash.majority(simhash._shingles((t or "").lower().encode().split(), simhash.NEAR_SHINGLE)) & (1 << 64) - 1 for t in texts]
    near = {(i, j) for j in range(len(texts) - 4) for i in range(j) if (fps[i] ^ fps[j]).bit_count() <= simhash.MAX_BITS}
    rows = docs(spark, texts).select(F.col("doc_id").alias("id"), *simhash.text_key(F.col("text")), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    prints = simhash._nodes(rows, simhash.NEAR_SHINGLE)
    place = {r.node: r.id for r in prints.orderBy(F.desc("id")).collect()}
    got = {tuple(sorted((place[r.a], place[r.b]))) for r in simhash.fingerprint_pairs(prints).collect()}
    assert got and got <= near
    assert {min(i, j) // 3 for i, j in got} == {i // 3 for i, _ in near} and {max(p) for p in got} | {min(p) for p in got} == {i for p in near for i in p}
    linked = []
    monkeypatch.setattr(simhash, "fingerprint_roots", lambda *a, f=simhash.fingerprint_roots: linked.append(f(*a)) or linked[-1])
    assert [r.component_id for r in simhash.similar_classes(docs(spark, texts)).orderBy("id").collect()] == brute_classes(texts)
    assert {place[r.node] for r in linked[0].collect()} == {i for p in near for i in p}


def test_shingle_hashes_of_runs():
    a, b = [w.encode() for w in "a b c d e f a b c d e".split()], [b"a", b"b"]
    own = simhash._shingles(a, 5)
    assert len(own) == 7 and own[0] == own[6] and len(set(own.tolist())) == 6 and len(simhash._hashes(a, 5)) == 6
    assert len(simhash._shingles(b, 5)) == 1 and simhash._shingles(b, 5)[0] not in own and not len(simhash._hashes([], 5))


def test_labels_do_not_hang_on_what_is_kept(monkeypatch):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdeéñßЖ中ÀÉIΣ'-,.12") for _ in range(rng.randrange(1, 12)))
    tokens = list(dict.fromkeys(w for w in (word().lower() for _ in range(2000)) if w))
    found, count = language.words_of_all(tokens)
    assert [x.tolist() for x in np.split(np.array(found, object), np.cumsum(count)[:-1])] == [language.words_of(t) for t in tokens]
    assert [len(x) for x in language.words_of_all([])] == [0, 0]
    field = language.train([(k, [w + k for w in WORDS]) for k in ("a", "b", "c") for _ in range(4)])
    texts = [" ".join(["the", "The", *(word() for _ in range(rng.randrange(60)))]) for _ in range(200)] + ["", "12", "road"]
    want = language.Labeller(field).label(texts)
    monkeypatch.setattr(language, "KEPT", 300)
    monkeypatch.setattr(language, "STEP_WORDS", 400)
    kept = language.Labeller(field)
    got = kept.label(texts[:120]) + kept.label(texts[120:])
    assert [k for k, _ in got] == [k for k, _ in want] and np.allclose([p for _, p in got], [p for _, p in want], atol=1e-6)
    assert "the" in kept and len(kept) < 900
