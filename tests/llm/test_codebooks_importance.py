"""Codebooks and importance resampling, against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cipherscape.llm import codebooks, importance, queries

# -- codebooks -------------------------------------------------------------------------


def plain_codes(rows, entries=256, rounds=4, scale=1024, parts=4):
    """{id: (code, error)} and the digest, every distance computed; ``rows`` are (id, vector)."""
    whole = [(i, v) for i, v in rows if v and len(v) % parts == 0 and all(x is not None and math.isfinite(x) for x in v)]
    whole = sorted((i, [math.floor(scale * float(x)) for x in v]) for i, v in whole)
    whole = [(i, v) for i, v in whole if len(v) == len(whole[0][1])]
    x = np.array([v for _, v in whole])
    codes, errors, books = [], 0, []
    for part in np.split(x, parts, axis=1):
        book = part[:entries].copy()
        near = lambda: ((part[:, None, :] - book[None]) ** 2).sum(2)  # noqa: E731, B023
        for _ in range(rounds):
            at = near().argmin(1)
            for e in range(len(book)):
                if (at == e).any():
                    book[e] = part[at == e].sum(0) // (at == e).sum()
        far = near()
        codes.append(far.argmin(1))
        errors = errors + far.min(1)
        books.append(book)
    text = ",".join(str(v) for b in books for e in b for v in e)
    return {i: ("".join(f"{c[k]:02x}" for c in codes), int(errors[k])) for k, (i, _) in enumerate(whole)}, hashlib.sha256(text.encode()).hexdigest()


def test_codes_equal_brute_force_on_the_table(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").toPandas()
    want, digest = plain_codes([(int(i), None if v is None else list(v)) for i, v in zip(rows.vec_id, rows.embedding, strict=True)])
    label = {int(i): None if k != k else k for i, k in zip(rows.vec_id, rows.label, strict=True)}
    totals = Counter()
    for i, (_, error) in want.items():
        totals[label[i]] += error
    got = queries.op11_codebooks(spark, sf_dir).collect()
    assert {(r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in got} == {(i, c, e, totals[label[i]], digest) for i, (c, e) in want.items()}


def test_bounds_hold_and_leave_few_entries_open():
    r = np.random.default_rng(3)
    for width, entries in ((16, 256), (1, 7), (5, 1), (3, 40)):
        book = r.integers(-300, 300, (entries, width))
        book[entries // 2] = book[0]  # equal entries tie
        cells, asked = codebooks.Cells(book), np.concatenate([r.integers(-400, 400, (150, width)), book])
        exact = ((asked[:, None, :] - book[None]) ** 2).sum(2)
        lower, upper = cells.bounds(asked)
        assert (lower <= exact + 1e-6).all() and (upper >= exact - 1e-6).all()
        at, distance = cells.nearest(asked)
        assert (at == exact.argmin(1)).all() and (distance == exact.min(1)).all()
    row, _ = codebooks.Cells(r.integers(-300, 300, (256, 16))).candidates(r.integers(-300, 300, (500, 16)))
    assert len(row) < 500 * 256 / 2


@pytest.fixture(scope="module")
def vectors():
    r = np.random.default_rng(5)
    rows = [(int(i), [float(np.float32(x)) for x in r.normal(size=8)], int(i % 3)) for i in range(300)]
    rows += [(i + 1000, rows[7][1], 2) for i in range(200)]  # a large group of copies
    rows += [(5, rows[5][1], 1), (5, rows[6][1], None), (400, None, 1), (401, [], 1), (402, [1.0] * 7 + [None], 1), (403, [math.nan] + [0.0] * 7, 1), (404, [math.inf] * 8, 1), (405, [0.5] * 4, 1), (406, [0.5] * 7, 1), (407, [-0.25] * 8, None)]
    return rows


def test_hard_vectors(spark, vectors):
    df = spark.createDataFrame([(*v, "x") for v in vectors], "vec_id long, embedding array<double>, label int, code string").repartition(5)
    want, digest = plain_codes([(i, v) for i, v, _ in vectors])
    got = codebooks.compressed(df).collect()
    assert len(got) == 503 and {r.codebooks_sha256 for r in got} == {digest}
    fives = {r.code for r in got if r.vec_id == 5}
    assert all(r.error == want[r.vec_id][1] and r.code == want[r.vec_id][0] for r in got if r.vec_id != 5) and len(fives) == 2
    sums = Counter()
    for r in got:
        sums[r.label] += r.error
    assert all(r.label_error == sums[r.label] for r in got) and None in sums
    books = codebooks.trained(df.filter("vec_id < 4"), 8, "vec_id", "embedding")
    assert books.shape == (4, 4, 2)
    assert (codebooks.decoded(["00000000", "03000000"], books)[1][:2] == books[0][3]).all()


def test_no_vectors(spark, vectors):
    df = spark.createDataFrame([(*v, "x") for v in vectors], "vec_id long, embedding array<double>, label int, code string")
    for nothing in (df.filter("false"), df.filter("vec_id in (400, 401, 402, 403, 404, 406)")):
        assert codebooks.compressed(nothing).collect() == []
    with pytest.raises(Exception, match="too large"):
        codebooks.compressed(spark.createDataFrame([(1, [1e20] * 4, 1)], "vec_id long, embedding array<double>, label int")).collect()


# -- importance ------------------------------------------------------------------------

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_features(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = _WORD.findall(lower)
    return len(words), Counter(zlib.crc32(" ".join(words[i : i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(words) - n + 1))


def plain_resampled(docs, target):
    """{id: (n_features, weight, score, rank)}; ``docs`` are (id, text)."""
    made = {i: plain_features(t) for i, t in docs}
    s, t = Counter(), Counter()
    for _, f in made.values():
        s.update(f)
    for x in target:
        t.update(plain_features(x)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log(float((t[b] + 1) * (all_s + 10000)) / float((s[b] + 1) * (all_t + 10000)))) for b in range(10000)]
    rows = {}
    for i, (_, f) in made.items():
        h = int(hashlib.sha256(f"42:{i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] * n for b, n in f.items())
        rows[i] = (sum(f.values()), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))))
    long = [i for i, (n, _) in made.items() if n >= 20]
    rank = {i: k + 1 for k, i in enumerate(sorted(long, key=lambda i: (-rows[i][2], i))[: 5 * len(long) // 100])}
    return {i: (*r, rank.get(i)) for i, r in rows.items()}


def test_resampling_equals_brute_force_on_the_table(spark, sf_dir):
    docs, target = (spark.read.parquet(f"{sf_dir}/{t}.parquet").toPandas() for t in ("documents", "benchmark"))
    want = plain_resampled(list(zip(docs.doc_id, docs.text, strict=True)), target.text)
    got = {r.doc_id: (r.n_features, r.weight, r.score, r["rank"]) for r in queries.op12_importance(spark, sf_dir).collect()}
    assert got == want and sum(r[3] is not None for r in want.values()) >= 5


def test_crcs_of_joined_words():
    r, shifts = np.random.default_rng(2), importance.Shifts()
    words = [bytes(r.integers(97, 123, n).tolist()) for n in (1, 2, 3, 5, 63, 64, 65, 127, 128, 129, 1000, 4096, 70_001)]
    pairs = [(a, b) for a in words for b in words]
    crc = lambda ws: np.array([zlib.crc32(w) for w in ws], np.uint32)
    got = shifts.joined(crc([a for a, _ in pairs]), crc([b for _, b in pairs]), np.array([len(b) for _, b in pairs]))
    assert got.tolist() == [zlib.crc32(a + b" " + b) for a, b in pairs]


def test_hard_texts(spark, monkeypatch):
    target = ["alpha beta gamma delta", None, "Alpha BETA"]
    words = ["alpha", "Beta", "über", "9", "Ärger", "x", "日本語"]
    docs = [(i, " ".join(words[(i * j + j // 3) % 7] for j in range(i))) for i in range(60)]
    docs += [(100, None), (101, ""), (102, "!?.\n \x00"), (103, "a\x00b-c d e " * 9), (104, "wort " * 300), (105, "y" * 400), (106, "alpha," * 500), (107, "Alpha beta gamma " * 10)]
    want = plain_resampled(docs, target)
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, score int, _row string").repartition(7)
    ends = spark.createDataFrame([(t,) for t in target], "text string")
    for piece in (1 << 20, 64):  # also with texts of many pieces
        monkeypatch.setattr(importance, "PIECE", piece)
        shifts, known = importance.Shifts(), importance._Words()
        counts = np.zeros((len(docs), 10000), int)
        for at, bucket, _ in importance.featured([t and t.encode() for _, t in docs], shifts, known):
            np.add.at(counts, (at, bucket), 1)
        assert [Counter({b: n for b, n in enumerate(c) if n}) for c in counts.tolist()] == [plain_features(t)[1] for _, t in docs]
    got = {r.doc_id: (r.n_features, r.weight, r.score, r["rank"]) for r in importance.resampled(df, ends).collect()}
    assert got == want


def test_repeated_rows_and_empty_tables(spark):
    ends = spark.createDataFrame([("a b c",)], "text string")
    again = spark.createDataFrame([(1, "word " * 25)] * 40 + [(None, "word " * 25)] * 20 + [(2, "few")], "doc_id long, text string")
    got = importance.resampled(again, ends).collect()
    assert len(got) == 61 and sorted(r["rank"] for r in got if r["rank"]) == [1, 2, 3]
    one = {(r.n_features, r.weight, r.score) for r in got if r.doc_id == 1}
    assert len(one) == 1
    assert importance.resampled(again.filter("false"), ends).collect() == []
    none = importance.resampled(again, ends.filter(F.lit(False))).collect()
    assert len(none) == 61 and all(r.n_features >= 0 for r in none)
