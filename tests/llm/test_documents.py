"""The operators on documents against brute force, on a small table with every odd row."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cipherscape.llm import jaccard, licenses, lines, mixing, packing, packs, quality, substring
from cipherscape.llm.queries import vocabulary

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, size string, places string, bucket int"


def _rows():
    r = random.Random(4)
    vocabulary = [f"w{k}" for k in range(300)] + ["Ünï", "a b", "ÄB", "x\x1cy"]
    text = lambda n: " ".join(r.choices(vocabulary, k=n))
    shared, out = text(60), []
    base = text(120)
    out += [base, base, base.upper(), base + " " + text(3), text(2) + " " + base, base.replace(" ", "\n")]
    words = base.split(" ")
    for k in range(40):  # near copies, each with some words of its own
        own = list(words)
        for at in r.sample(range(len(own)), k % 8):
            own[at] = f"own{k}x{at}"
        out.append(" ".join(own))
    out += [text(30) + " " + shared + " " + text(20) for _ in range(40)]
    out += [None, "", " \n\t", "one", "two words", "two words", "a b c d", "a b c d e", "same " * 400, text(9000), "line\nline\nline", "© # * | <x>", "ab cd ef"]
    out += [text(r.randint(1, 80)) for _ in range(40)]
    rows = [(k, t, "en", f"s{k % 4}" if k % 9 else None, 0, k % 3, "x", "y", 1) for k, t in enumerate(out)]
    rows += [rows[0], rows[0], rows[50]]  # repeated rows
    r.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def rows():
    return _rows()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def licence_model(spark):
    return licenses.trained(spark)


def _texts(rows):
    return {i: t or "" for i, t, *_ in rows}


def _lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def _sets(rows):
    out = {}
    for i, t in _texts(rows).items():
        w = WORD.findall(_lower(t))
        out[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    return out


def _components(sets, percent=80):
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("short", [24, 2])
def test_jaccard_equals_brute_force(docs, rows, short, monkeypatch):
    monkeypatch.setattr(jaccard, "SHORT", short)
    sets = _sets(rows)
    want = _components(sets)
    got = jaccard.jaccard_classes(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), want[r.doc_id])


def test_many_buckets_by_way_of_parts(docs, rows, monkeypatch):
    """The way of a corpus with more buckets than a pack sends rows: the same results."""
    docs = docs.repartition(5).persist()
    want = [sorted(f(docs).collect(), key=str) for f in (jaccard.jaccard_classes, substring.substring_digest)]
    monkeypatch.setattr(packs, "PARTS", 4)
    monkeypatch.setattr(packs, "PER_BUCKET", 100)
    monkeypatch.setattr(packs, "PLACE_BUCKETS", 64)
    monkeypatch.setattr(packs, "BUNDLE_BYTES", 4096)
    assert [sorted(f(docs).collect(), key=str) for f in (jaccard.jaccard_classes, substring.substring_digest)] == want
    docs.unpersist()


def test_rows_follow_entries_not_packs_times_buckets(spark, docs, monkeypatch):
    """With a row a bucket each pack's rows grow with the buckets; in two steps those of a bundle do."""
    made, buckets = packs.packed(docs.repartition(12), "text"), 64
    monkeypatch.setattr(packs, "PARTS", 4)
    seen = {}

    def sent(batches):
        for batch in batches:
            for pack in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([pack] * buckets, pa.int64()), pa.array(range(buckets), pa.int32()), pa.array([b"%d" % pack] * buckets)], names=["pack", "bucket", "of"])

    def met(key, group):
        own = [int(v) for v in group.column("of").to_pylist()]
        assert own == group.column("pack").to_pylist()
        return packs.answers(own, key[0].as_py(), [1] * len(own), np.array([p % 3 == 0 for p in own]))

    for most in (1, 1 << 20):
        monkeypatch.setattr(packs, "BUNDLE_BYTES", most)
        got = packs.by_pack(packs.exchanged(made.select("pack"), sent, ["of"], met, buckets)).collect()
        seen[most] = {r["pack"]: sorted(m.bucket for m in r.marks) for r in got}
    ids = [r["pack"] for r in made.select("pack").collect()]
    assert len(ids) == 12 and seen[1] == seen[1 << 20] == {p: list(range(buckets)) for p in ids if p % 3 == 0}
    parts = [b for p in ids for b in packs.in_parts(sent([pa.record_batch({"pack": pa.array([p], pa.int64())})]), 4)]
    assert sum(len(b) for b in parts) == 12 * 4
    by_part = [b.slice(k, 1) for k in range(4) for b in parts]
    one, many = (list(packs.bundles(iter(by_part), most)) for most in (1 << 20, 1))
    assert sum(len(b) for b in one) == buckets and sum(len(b) for b in many) == 12 * buckets
    assert all(len(v) == 12 for b in one for v in b.column("pack").to_pylist())


def test_jaccard_bounds():
    for a in range(1, 60):
        for b in range(a, 60):
            need = jaccard.needed(a, b, 80)
            assert 100 * need >= 80 * (a + b - need) and 100 * (need - 1) < 80 * (a + b - need + 1)
            if need <= a:  # possible at all: then one of the first columns of either is shared
                assert jaccard.prefix_length(a, 80) + need > a and jaccard.prefix_length(b, 80) + need > b
    r = np.random.default_rng(1)
    for _ in range(50):
        p, q = (np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)) for n in r.integers(1, 400, 2))
        q = np.unique(np.concatenate((q, r.choice(p, len(p) // 2))))
        assert jaccard.most_shared(jaccard.block_counts(p), jaccard.block_counts(q)) >= len(np.intersect1d(p, q))


def test_jaccard_null_ids_and_empty(spark, empty):
    rows = spark.createDataFrame([(None, "a b c d e f g"), (7, "a b c d e f g"), (None, None)], "doc_id long, text string")
    got = jaccard.jaccard_classes(rows).collect()
    assert sorted(str((r.doc_id, r.component_id)) for r in got) == ["(7, 7)", "(None, 7)", "(None, None)"]
    assert jaccard.jaccard_classes(empty).count() == 0


def _removed(rows, width=13):
    first = {}
    words = {i: WORD.findall(t) for i, t in _texts(rows).items()}
    for i, w in words.items():
        for k in range(len(w) - width + 1):
            key = tuple(w[k : k + width])
            first[key] = min(first.get(key, i), i)
    out = {}
    for i, w in words.items():
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            if first[tuple(w[k : k + width])] < i:
                gone[k : k + width] = [True] * width
        out[i] = (w, gone)
    return out


def test_substrings_equal_brute_force(docs, rows):
    want = _removed(rows)
    got = substring.substring_digest(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        words, gone = want[r.doc_id]
        kept = " ".join(w for w, g in zip(words, gone, strict=True) if not g)
        assert (r.n_words, r.n_removed, r.kept_sha256) == (len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
        assert sum(s.stop - s.start for s in r.repeats) == sum(gone)
    assert sum(r.n_removed > 0 for r in got) > 40


def test_texts_without_repeats(docs, rows, empty):
    want = _removed(rows)
    got = substring.without_repeats(docs)
    assert got.columns == docs.columns
    for r in got.collect():
        words, gone = want[r.doc_id]
        text = _texts(rows)[r.doc_id]
        assert (r.text or "") == (" ".join(w for w, g in zip(words, gone, strict=True) if not g) if any(gone) else text)
    assert substring.substring_digest(empty).count() == 0


def test_null_ids_lose_nothing(spark):
    text = " ".join(f"w{k}" for k in range(30))
    rows = spark.createDataFrame([(None, text), (3, text), (5, text)], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in substring.substring_digest(rows).collect()} == {None: 0, 3: 0, 5: 30}


def test_lines_equal_brute_force(docs, rows, empty):
    got = lines.line_rules(docs).collect()  # the registered query's own limits
    assert len(got) == len(rows)
    texts = _texts(rows)
    host = {i: s for i, _, _, s, *_ in rows}
    norm = lambda line: " ".join(WORD.findall(line.lower()))
    count = collections.Counter((host[i], n) for i, t in texts.items() for n in {norm(x) for x in t.split("\n")} if n)
    hosts = collections.Counter(host.values())
    for r in got:
        t = texts[r.doc_id]
        w = WORD.findall(t)
        seen, same = set(), 0
        for line in t.split("\n"):
            if WORD.search(line):
                same += line in seen
                seen.add(line)
        grams = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        covered = {j for k in range(len(w) - 4) if grams[tuple(w[k : k + 5])] > 1 for j in range(k, k + 5)}
        failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
        gone = sum(len(WORD.findall(x)) for x in t.split("\n") if count[(host[r.doc_id], norm(x))] > max(2, 0.02 * hosts[host[r.doc_id]]))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), same, len(covered))
        assert (r.base_failed, r.removed_words) == (failed, gone)
        assert r.kept == (not failed and len(w) - gone >= 0.5 * len(w))
    assert any(r.removed_words for r in got) and any(not r.kept and not r.base_failed for r in got)
    assert lines.line_rules(empty).count() == 0


def test_line_limits_grow_with_the_host(spark):
    own = lambda k: "\n".join(f"w{k} line {j} of its own" for j in range(3))
    rows = [(k, own(k) + ("\nseen in two of a hundred" if k < 2 else "") + ("\nseen in five of a hundred" if k < 5 else ""), "big") for k in range(200)]
    rows += [(1000 + k, own(1000 + k) + "\nseen in three", "small") for k in range(3)] + [(2000, "seen in three\nseen in five of a hundred\n" + own(2000), "third")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r.removed_words for r in lines.line_rules(docs).collect()}
    assert {k: n for k, n in got.items() if n} == {k: 6 for k in range(5)} | {1000 + k: 3 for k in range(3)}
    assert not any(r.removed_words for r in lines.line_rules(docs.filter("doc_id < 3 or doc_id between 10 and 999")).collect())  # 3 of 193 are no 50th


def test_repeated_rows_are_one_document_for_lines(spark):
    text = "a line of words that many share\n" + " ".join(f"w{k}" for k in range(20))
    rows = spark.createDataFrame([(1, text, "h")] * 5 + [(2, text, "h"), (3, text, None)], "doc_id long, text string, source string")
    assert {r.removed_words for r in lines.line_rules(rows, max_docs=2).collect()} == {0}
    assert {r.removed_words for r in lines.line_rules(rows, max_docs=1).filter("doc_id < 3").collect()} == {27}


def test_packing_round_trip(docs, rows, empty):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary())
    got = packing.packed(docs, vocabulary(), longest=64, with_ids=True).collect()
    assert sorted(r.sequence_id for r in got) == list(range(len(got)))
    by_id = collections.defaultdict(list)
    for r in got:
        by_id[r.doc_id].append(r)
        assert r.length & (r.length - 1) == 0 and r.length <= 64 and r.offset == 0
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
    lengths = [r.length for r in sorted(got, key=lambda r: r.sequence_id)]
    assert lengths == sorted(lengths)  # bucket by bucket
    copies = collections.Counter(i for i, *_ in rows)
    for i, t in _texts(rows).items():
        want = tokenizer.encode(t, add_special_tokens=False).ids + [1]
        pieces = {r.start: r for r in by_id[i]}
        assert len(by_id[i]) == len(pieces) * copies[i]
        assert [x for s in sorted(pieces) for x in pieces[s].ids] == want and {r.doc_tokens for r in by_id[i]} == {len(want)}
    assert packing.packed(empty, vocabulary()).count() == 0
    with pytest.raises(ValueError):
        packing.packed(docs, vocabulary(), longest=100)


def test_pieces():
    for n in range(1, 300):
        cut = list(packing.pieces(n, 32))
        assert sum(m for _, m in cut) == n and [s for s, _ in cut] == [sum(m for _, m in cut[:k]) for k in range(len(cut))]
        assert len(cut) == n // 32 + (n % 32).bit_count()


def test_stems_are_encoded_once_and_ids_stay(monkeypatch):
    """Words that differ in case, commas or digits share pieces; ids are those of the whole text, with and without pieces."""
    known = packing.tokenizer(vocabulary())
    words = packing.WordIds(known)
    stems = [f"{a}ó{b}ñ" for a in ("canta", "ELLO", "x'Sy", "I'll") for b in "abcdefgh"]
    text = " ".join(f(s) for s in stems for f in (str, str.upper, "({}),".format, "{}.".format, "{}42!".format)).encode()
    hostile = ["İ'S <|endoftext|> a<|startoftext|>b <|ENDOFTEXT|> </w> a</w>", "H\u0331 e\u0301, ſ'S ŉ Ĳ Ÿ ª µ × ÷ n't'd 1a2 ..! ''s", "\x1cx a\x7fb \u0085 \u0338> Ⱥ Σς 中文, x\u0338 <\u0338", "..." * 99]
    texts = [text, *[h.encode() for h in hostile], b""]
    want = [known.encode(t.decode(), add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in words.of(texts)] == want
    assert len(words.numbers) > 160 > 100 > len(words.pieces.numbers)
    monkeypatch.setattr(packing.Pieces, "suit", lambda known: False)
    assert [x.tolist() for x in packing.WordIds(known).of(texts)] == want


def test_word_ids_forget_without_harm(monkeypatch):
    monkeypatch.setattr(packing, "KEPT_WORDS", 4)
    known = packing.tokenizer(vocabulary())
    words = packing.WordIds(known)
    texts = [b"one two three four five one two Six", b"", "naïve, (don't) 中文 e\u0301 x\u00a0y <|end|> \u2028 z".encode(), b" \n "]
    for _ in range(3):
        got = [x.tolist() for x in words.of(texts)]
        assert got == [known.encode(t.decode(), add_special_tokens=False).ids for t in texts]
    assert len(words.numbers) <= 20 and words.of([]) == []
    texts = [b"plain words first", b"then x<|endoftext|>y <|startoftext|> <|ENDOFTEXT|>", b"and plain ones again <|endoftext|>"]
    for some in (texts, texts[:1], texts[1:2], [b"other words"]):  # a word may hold the closing token
        assert [x.tolist() for x in words.of(some)] == [known.encode(t.decode(), add_special_tokens=False).ids for t in some]


def test_vocabularies_that_reach_over_white_space_are_refused(spark, tmp_path):
    import json

    whole = json.load(open(vocabulary()))
    whole["pre_tokenizer"], whole["normalizer"] = None, None
    path = tmp_path / "other.json"
    path.write_text(json.dumps(whole))
    with pytest.raises(ValueError, match="white space"):
        packing.packed(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), str(path))


def test_quality_separates_held_out_rows(spark):
    r = random.Random(1)
    rows, labels = [], []
    for k in range(400):
        good = r.random() < 0.7
        words = ["".join(r.choices("etaoins", k=r.randint(2, 8))) for _ in range(r.randint(5, 60))]
        rows.append((k, " ".join(words if good else [w.upper() + "!!" for w in words]), "extra"))
        labels.append((k, int(good)))
    rows += [(900, None, ""), (901, "", ""), (902, "word " * 20000, "")]
    labels += [(0, labels[0][1]), (5000, 1), (None, 1), (1, None)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.quality_scores(docs, labels).collect()}
    assert all(got[k].held_out == (zlib.crc32(str(k).encode()) % 3 == 1) for k in got)
    truth = {r.doc_id: r.quality for r in labels.collect() if r.quality is not None}
    held = [k for k in truth if k in got and got[k].held_out]
    assert sum(got[k].predicted == truth[k] for k in held) >= 0.97 * len(held)
    assert all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.5) for x in got.values())
    none = quality.quality_scores(docs, labels.limit(0)).select("score").distinct().collect()
    assert [r.score for r in none] == [0.5]
    assert quality.quality_scores(docs.limit(0), labels).count() == 0


def _plain_ftrl(rows, bits, passes, alpha=2.0, beta=1.0, l1=0.02, l2=0.02):
    """The same learner a feature at a time."""
    z, n, bias, bias_n = collections.defaultdict(float), collections.defaultdict(float), 0.0, 0.0
    share = collections.Counter(y for y, *_ in rows)

    def weight(i):
        return 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)

    order = np.random.default_rng(7)
    for _ in range(passes):
        for k in order.permutation(len(rows)):
            y, places, values = rows[k]
            w = {i: weight(i) for i in places}
            p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in zip(places, values, strict=True)) - bias))
            c = len(rows) / (2 * share[y]) * (p - y)
            for i, v in zip(places, values, strict=True):
                g = c * v
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha * w[i]
                n[i] += g * g
            bias_n += c * c
            bias -= 0.1 * c / math.sqrt(1e-9 + bias_n)
    return {i: weight(i) for i in z}, bias


def test_scores_equal_those_of_a_plain_learner(spark):
    r = random.Random(6)
    rows = [(k, " ".join(r.choices(["alpha", "beta", "Gamma", "x1", "!!"] if k % 3 else ["delta", "beta", "EPS"], k=r.randint(1, 30)))) for k in range(60)]
    docs = spark.createDataFrame([*rows, (70, rows[0][1] * 500), (71, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 3 > 0)) for k in range(60)] + [(500, 1)], "doc_id long, quality int")
    features, used = quality.Features(12), sorted(k for k, _ in rows)
    read = [(int(k % 3 > 0), *features.of(rows[k][1].encode())) for k in used]
    read = [(y, p.tolist(), v.astype(np.float32).tolist()) for y, p, v in read]
    weights, bias = _plain_ftrl(read, 12, 6)
    model = quality.trained(docs, labels, "quality", bits=12)
    got = {x.doc_id: x.s for x in docs.withColumn("s", quality.scored(docs, model)).collect()}
    for k, t in [*rows, (70, rows[0][1] * 500), (71, None)]:
        places, values = features.of((t or "").encode())
        want = 1 / (1 + math.exp(-sum(weights.get(i, 0.0) * v for i, v in zip(places.tolist(), values.tolist(), strict=True)) - bias))
        assert got[k] == pytest.approx(want, abs=1e-4)


def test_training_is_bounded_by_labels_that_have_a_text(spark):
    docs = spark.createDataFrame([(k % 50, ("good words here " if k % 50 % 2 else "BAD !! STUFF ") * (1 + k % 50)) for k in range(400)] + [(99, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(50)] + [(1000 + k, 0) for k in range(500)] + [(99, 1)], "doc_id long, quality int")
    model = quality.trained(docs, labels, "quality", rows=40, held=1 << 20)
    got = docs.filter("text is not null").withColumn("s", quality.scored(docs, model)).collect()
    assert all((x.s >= 0.5) == (x.doc_id % 2 == 1) for x in got)


def test_mixing_meets_targets(spark):
    r = random.Random(2)
    sources = ["a", "b", "B", "é", None]
    rows = [(k, " ".join(["w"] * min(3000, int(r.paretovariate(0.8)))), r.choices(sources, [8, 3, 1, 1, 1])[0], k % 2) for k in range(700)] + [(-1, None, "a", 0), (-2, "", "z", 0), (5, "x y", "a", 1), (5, "x y", "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, row long")
    got = mixing.mixed(docs).collect()
    assert len(got) == len(rows)
    sizes = collections.Counter()
    for _, t, s, _ in rows:
        sizes[s] += len(WORD.findall(t or ""))
    order = [s for s in sorted((s for s in sizes if s is not None), key=lambda s: s.encode())] + [None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    budget, target, open_ = 1.5 * sum(sizes.values()), {}, set(order)
    while True:  # share out, stop the full ones, share the rest
        unit = (budget - sum(target.values())) / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * unit >= 2 * sizes[s]}
        if not full:
            target |= {s: weight[s] * unit for s in open_}
            break
        target |= {s: 2.0 * sizes[s] for s in full}
        open_ -= full
    taken, largest = collections.Counter(), collections.Counter()
    for x in got:
        taken[x.source] += x.copies * x["size"]
        largest[x.source] = max(largest[x.source], x["size"])
        assert 0 <= x.copies <= 2 and x.target == pytest.approx(target[x.source]) and x.source_size == sizes[x.source]
    for s in order:
        assert abs(taken[s] - target[s]) <= max(largest[s], 1), s
    assert sum(abs(taken[s] - target[s]) for s in order) < 0.05 * budget
    key = lambda rows: sorted((str(x.doc_id), str(x.source), x.copies) for x in rows)
    assert key(mixing.mixed(docs.repartition(7)).collect()) == key(got)  # reruns agree
    same = spark.createDataFrame([(7, "a b c", "s")] * 900 + [(None, f"x y {k}", "s") for k in range(300)], "doc_id long, text string, source string")
    agree = [sorted((str(x.doc_id), x.copies) for x in mixing.mixed(same.repartition(n), share=0.7).collect()) for n in (3, 5)]
    assert agree[0] == agree[1]
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(x.copies for x in got)
    assert mixing.mixed(docs.limit(0)).count() == 0


def test_repeated_rows_lie_in_many_blocks(spark):
    rows = spark.createDataFrame([(k, 5 if k < 3000 else k) for k in range(4000)], "row long, key long").repartition(6).select(F.monotonically_increasing_id().alias("row"), "key")
    keys = [r.key for r in mixing.apart(rows).collect()]
    assert len(keys) == 4000 and len(set(keys)) == 4000
    assert set(keys) == {r.key for r in mixing.apart(rows.repartition(3).select(F.monotonically_increasing_id().alias("row"), "key")).collect()}


def test_rounding_is_unbiased(spark):
    rows = spark.createDataFrame([(k, f"s{k // 5}", k * 7919 + 1, float(1 + k % 5), 0.3) for k in range(5000)], "row long, source string, key long, size double, p double")
    got = mixing.rounded(rows, block=4).join(rows, "row").groupBy("size").agg(F.avg("extra").alias("m"), F.count("*").alias("n")).collect()
    assert sum(r.n for r in got) == 5000 and all(abs(r.m - 0.3) < 0.06 for r in got)


def test_licences_are_found_and_lookalikes_are_not(spark, licence_model):
    good = {
        1: ("MIT", "Some words.\nReleased under the MIT License."), 2: ("Apache-2.0", "Licensed under the Apache License, Version 2.0.\nmore"),
        3: ("GPL-3.0", "x\n\nThis work is licensed under the GNU General Public License, version 3."), 4: ("CC-BY-NC", "Licensed under CC BY-NC 4.0."), 5: ("Proprietary", "a\nAll rights reserved."),
    }
    other = {6: "She was granted a license to practise medicine", 7: "The driver showed his licence.\nAll the seats were reserved.", 8: None, 9: "", 10: "the public works\nversion 3 of the plan " * 200}
    rows = [(k, t, "x") for k, (_, t) in good.items()] + [(k, t, "x") for k, t in other.items()] + [(1, good[1][1], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, family string")
    got = licenses.scan(docs, model=licence_model).collect()
    assert {(r.doc_id, r.family, r.confirmed) for r in got if r.confirmed} == {(k, f, True) for k, (f, _) in good.items()}
    assert sum(r.doc_id == 1 for r in got) == 2 and {r.line for r in got if r.doc_id == 3} == {2}
    assert licenses.scan(docs.limit(0)).count() == 0


def test_wrapped_licences_are_found_whole(spark, licence_model):
    import textwrap

    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use and copy"
    gpl = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    bsd = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
    rows, want = [], set()
    for k, (family, notice) in enumerate([("MIT", mit), ("GPL-3.0", gpl), ("BSD", bsd)]):
        wrapped = {w: textwrap.wrap(notice, w) for w in (80, 60)}
        rows += [(10 * k, "\n".join(["Some words.", "", *wrapped[80], "", "more words"])), (10 * k + 1, "\n".join(wrapped[60]))]
        rows += [(10 * k + 2, "/*\n * A title\n *\n" + "".join(f" * {x}\n" for x in wrapped[80]) + " */\r\n\r\ncode = 1"), (10 * k + 3, notice)]
        want |= {(10 * k, 2, family), (10 * k + 1, 0, family), (10 * k + 2, 3, family), (10 * k + 3, 0, family)}
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), model=licence_model).collect()
    assert {(r.doc_id, r.line, r.family) for r in got if r.confirmed} == want and len(got) == len(want)
    assert {r.paragraph for r in got if r.doc_id % 10 == 1} == {mit, gpl, bsd}


def test_lines_and_paragraphs_of_a_text(spark):
    rows = spark.createDataFrame([("a b\n\n--\nc\nb x a\n",), ("",), ("\n\na",)], "text string")
    got = [[(u.start, u.line, u.n, u.paragraph, u.ngrams) for u in r[0]] for r in rows.select(licenses.units(F.col("text"), ["a", "b"], ["a"])).collect()]
    assert got == [[(0, 0, 1, "a b", ["a", "b", "a b"]), (3, 4, 1, "b x a", ["b", "a"]), (3, 3, 2, "c b x a", ["b", "a"])], [], [(2, 2, 1, "a", ["a"])]]


def _plain_scores(model, text):
    """Probabilities of a line, n-gram by n-gram."""
    tokens = [w for w in re.split(r"[^\w]+|_+", text.lower()) if w]
    grams = {" ".join(tokens[k : k + n]) for n in (1, 2, 3) for k in range(len(tokens) - n + 1)}
    score = {f: b + sum(model.fit.weights.get((g, f), 0.0) for g in grams) for f, b in model.fit.bias.items()}
    top = max(score.values())
    powers = {f: math.exp((x - top) / model.temperature) for f, x in score.items()}
    return {f: x / sum(powers.values()) for f, x in powers.items()}


# wordings that no fit, calibration or template has
UNSEEN = {
    "MIT": ("This package is made available under the MIT license", "mit licensed, see the file LICENSE", "Distributed under the MIT License, for any use"),
    "Apache-2.0": ("The library is available under the Apache License 2.0", "Code is under the Apache license, version 2.0", "This project is Apache 2.0 licensed"),
    "GPL-3.0": ("This tool is distributed under the GNU General Public License version 3", "The source is covered by the GPL v3", "GNU GPL version 3 or any later version"),
    "GPL-2.0": ("This module is distributed under the GNU General Public License version 2", "The driver is under GPL v2", "GNU GPL version 2 only"),
    "LGPL": ("This library is under the GNU Lesser General Public License", "Linked under the LGPL, version 2.1", "may be used under the terms of the GNU LGPL"),
    "BSD": ("Distributed under the 3-clause BSD license", "This code is available under a BSD license", "BSD licensed; redistribution in source and binary forms is permitted"),
    "MPL-2.0": ("Made available under the Mozilla Public License 2.0", "Files here are under the MPL, v. 2.0", "Subject to the Mozilla Public License"),
    "CC-BY-SA": ("Content is under a Creative Commons Attribution-ShareAlike licence", "Photos are CC BY-SA 4.0", "shared under creativecommons.org/licenses/by-sa/4.0"),
    "CC-BY-NC": ("Content is under a Creative Commons Attribution-NonCommercial licence", "Photos are CC BY-NC 4.0", "shared under creativecommons.org/licenses/by-nc/4.0"),
    "CC0": ("The data set is released under CC0", "placed in the public domain with CC0 1.0", "The author waived all copyright under CC0"),
}
NO_LICENCE = (
    "The minister said that the general public would be consulted", "A version of the text was found in the public library", "Version 2 of the engine has a larger tank", "They licensed the bar to sell beer until midnight",
    "Warranty claims must be sent in writing within thirty days", "Copies of the minutes are available from the clerk", "The court held that the contract was void under applicable law", "The software crashed and the file was lost",
    "Free admission for any person under twelve", "The buyer accepts the terms and conditions of sale", "The holder of the permit shall carry it at all times", "Rights of way across the field are disputed",
    "Commons debated the international treaty on Tuesday", "Creative writing is taught in the second term", "The source of the river lies in the hills", "The foundation stone was laid in June 1991",
    "Notice is hereby given that the meeting is postponed", "Distribution of food began at dawn", "An open letter to the publisher was printed", "The mozilla of the story is a lizard",
)


def test_licence_wordings_never_fitted(spark, licence_model):
    m = licence_model
    assert m.precision >= 0.95 and m.unknown_kept >= 0.95, (m.precision, m.recall, m.unknown_kept)
    seen = {t.lower() for ts in licenses.TEMPLATES.values() for t in ts}
    rows = [(f, t) for f, ts in UNSEEN.items() for t in ts] + [(licenses.UNKNOWN, t) for t in NO_LICENCE]
    assert not seen.intersection(t.lower() for _, t in rows)
    docs = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(rows)], "doc_id long, text string")
    said = {r.doc_id: r.family for r in licenses.scan(docs, model=m).collect()}
    right = sum(said.get(k) == f for k, (f, _) in enumerate(rows) if f != licenses.UNKNOWN)
    print("licences:", m.temperature, m.threshold, m.precision, m.recall, m.unknown_kept, right, len(said), {t: said.get(k) for k, (f, t) in enumerate(rows) if said.get(k, licenses.UNKNOWN) != f})
    assert right >= 0.9 * len(said) and right >= 0.7 * (len(rows) - len(NO_LICENCE))
    assert sum(k in said for k, (f, _) in enumerate(rows) if f == licenses.UNKNOWN) <= 1


def test_licence_scores_equal_brute_force(spark, licence_model):
    lines = [t for ts in licenses.TEMPLATES.values() for t in ts] + [t for ts in UNSEEN.values() for t in ts] + list(NO_LICENCE) + ["", "x " * 3000 + "licensed under the MIT license"]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(lines)] + [(-1, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan(docs, model=licence_model).collect()}
    for k, t in enumerate(lines):
        p = _plain_scores(licence_model, t)
        best = max(p, key=lambda f: (p[f], f))
        if best != licenses.UNKNOWN and abs(p[best] - licence_model.threshold) > 1e-6:
            assert (k in got) == (p[best] >= licence_model.threshold), t
        if k in got:
            assert got[k].family == best and got[k].probability == pytest.approx(p[best]), t
