"""Main text, archives and vector search."""

import gzip
import hashlib
import random
import time
import zlib

import hand_pages
import numpy as np
import pytest

from cipherscape.llm import html_crf, topk, warc


# -- main text -------------------------------------------------------------------------


def test_held_out_pages_are_labelled_right():
    model, wrong, total = html_crf.default_model(), 0, 0
    for page, content in html_crf.labelled_pages(150, seed=77):
        blocks = html_crf.blocks(page)
        labels = html_crf.labels_of(blocks, content)
        assert sum(labels) == len(content)
        found = model.viterbi(model.scores(html_crf.features(blocks)))
        wrong, total = wrong + sum(a != b for a, b in zip(labels, found, strict=True)), total + len(labels)
    assert wrong <= 0.02 * total


def test_pages_labelled_by_hand():
    model, hits, ours, theirs = html_crf.default_model(), 0, 0, 0
    for page, content in hand_pages.labelled():
        blocks = html_crf.blocks(page)
        labels = html_crf.labels_of(blocks, content)
        assert sum(labels) == len(content)
        found = model.viterbi(model.scores(html_crf.features(blocks)))
        hits, ours, theirs = hits + sum(a and b for a, b in zip(labels, found, strict=True)), ours + sum(found), theirs + sum(labels)
    assert 2 * hits >= 0.95 * (ours + theirs)


def test_viterbi_is_the_best_of_all_sequences():
    r = np.random.default_rng(5)
    model = html_crf.Model(pair=r.normal(size=(2, 2)))
    for n in range(1, 9):
        score = r.normal(size=(n, 2))
        value = lambda s: sum(score[k, x] for k, x in enumerate(s)) + sum(model.pair[a, b] for a, b in zip(s, s[1:], strict=False))  # noqa: E731, B023
        best = max(([(k >> i) & 1 for i in range(n)] for k in range(1 << n)), key=value)
        assert model.viterbi(score) == best


def test_text_rules():
    model = html_crf.default_model()
    page = (
        "<html><head><title>T</title><script>var a='<p>no</p>';</script></head><body><nav><a href=/>Home</a> <a href=/b>News</a></nav><!-- <p>no</p> -->"
        "<article><h1>Caf&eacute; &amp; more</h1><p>First  paragraph\nwith <b>bold</b>ness &lt;here&gt; and enough words to be read.<br>A second line of the same paragraph, also long.<p>Unclosed paragraph &#8212; with a reference."
        "<style>p{}</style></article><form>Subscribe <input><button>Go</button></form><footer>&copy; someone</footer>"
    )
    assert html_crf.main_text(page, model) == (
        "Café & more First paragraph with boldness <here> and enough words to be read. A second line of the same paragraph, also long. Unclosed paragraph — with a reference."
    )
    for nothing in (None, "", "   ", "<html></html>", "<script>x", "<!-- open", "<"):
        assert html_crf.main_text(nothing, model).strip("<") == ""


def test_pages_keep_their_columns(spark, sf_dir):
    pages = spark.createDataFrame([(1, None, "x"), (2, "<article><p>Some text that is long enough to be content, surely.</p></article>", "y"), (2, "", "z")], "page_id long, html string, text string")
    got = pages.withColumn("text", html_crf.extracted(pages)).collect()
    assert [r.text for r in got] == ["", "Some text that is long enough to be content, surely.", ""]
    assert pages.limit(0).withColumn("text", html_crf.extracted(pages)).count() == 0


# -- archives --------------------------------------------------------------------------


def _pages(spark):
    big = "<p>" + "x" * 1500 + "é</p>"
    rows = [(1, "http://a", "small"), (2, "http://b", "small"), (3, None, big), (4, "http://d", big), (9, "http://e\r\nX: y", big), (9, "http://e2", big), (5, "u", None), (6, "u", ""), (7, "u", big + "!")]
    return spark.createDataFrame(rows, "page_id long, url string, html string"), rows


def test_archives_round_trip(spark):
    pages, rows = _pages(spark)
    got = warc.round_trip(pages).collect()
    assert len(got) == len(rows) and {r.kind for r in got} == {"record"}
    want = []
    for i, _, h in rows:
        b = (h or "").encode()
        again = len(b) >= 1000 and b == rows[2][2].encode() and i != 9
        want.append((str(i), len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", "9" if again else None))
    key = lambda rows: sorted(map(str, rows))
    assert key((r.key, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == key(want)
    assert warc.round_trip(pages.limit(0)).count() == 0


def _archive(n=30):
    parts = []
    for k in range(n):
        payload = random.Random(k).randbytes(200 + k)
        member = zlib.compressobj(3, zlib.DEFLATED, 31)
        raw = warc.record(str(k), "http://x", "response", payload, len(payload), hashlib.sha1(payload).hexdigest(), None, "2000-01-01T00:00:00Z")
        parts.append(raw if k % 3 == 2 else member.compress(raw) + member.flush())
    return parts


def test_whole_archive_has_no_gap():
    assert [x[2] for x in warc.salvaged(b"".join(_archive()))] == ["record"] * 30
    assert list(warc.salvaged(b"")) == []


@pytest.mark.parametrize("seed", range(12))
def test_damage_costs_only_what_it_touches(seed):
    r, parts = random.Random(seed), _archive()
    hurt = set(r.sample(range(len(parts)), 4))
    for k in hurt:
        p = bytearray(parts[k])
        kind = r.randrange(3)
        if kind == 0:
            p[r.randrange(len(p) // 2, len(p) - 8)] ^= 0x55
        elif kind == 1:
            del p[len(p) // 2 :]
        else:
            p[:0] = b"garbage \x1f\x8b\x08 WARC/1.1\r\n junk"
        parts[k] = bytes(p)
    data, found = b"".join(parts), list(warc.salvaged(b"".join(parts)))
    at = 0
    for offset, length, *_ in found:  # records and gaps cover the file
        assert offset == at
        at += length
    assert at == len(data)
    got = {warc._key(what[0]["warc-record-id"]) for _, _, kind, what in found if kind == "record"}
    assert got >= {str(k) for k in range(30) if k not in hurt}
    assert any(kind == "gap" and what for _, _, kind, what in found)


def test_damaged_archives_are_read_by_spark(spark, tmp_path):
    parts = _archive()
    (tmp_path / "a.warc.gz").write_bytes(b"".join(parts[:10]) + b"noise" + b"".join(parts[10:]))
    (tmp_path / "other.txt").write_bytes(b"not an archive")
    got = warc.read_archives(spark, f"file://{tmp_path}").collect()
    assert sum(r.kind == "record" for r in got) == 30
    gap = [r for r in got if r.kind == "gap"]
    assert len(gap) == 1 and gap[0].length == 5 and gap[0].offset == sum(map(len, parts[:10]))


def test_a_member_of_several_records_is_read(spark, tmp_path):
    raw = []
    for k in range(6):
        payload = random.Random(k).randbytes(300)
        raw.append(warc.record(str(k), "http://x", "response", payload, len(payload), hashlib.sha1(payload).hexdigest(), None, "2000-01-01T00:00:00Z"))
    hurt = raw[2].replace(b"HTTP/1.1 200", b"HTTP/1.1 299")
    stream, broken = gzip.compress(b"".join(raw)), gzip.compress(b"".join([*raw[:2], hurt, *raw[3:]]))
    (tmp_path / "a.warc.gz").write_bytes(stream)
    (tmp_path / "b.warc.gz").write_bytes(broken + gzip.compress(raw[2]))
    rows = warc.read_archives(spark, f"file://{tmp_path}").collect()
    a, b = ([r for r in rows if r.file.endswith(f"{x}.warc.gz")] for x in "ab")
    assert [(r.kind, r.key, r.payload_bytes, r.offset, r.length) for r in a] == [("record", str(k), 300, 0, len(stream)) for k in range(6)]
    assert [(r.kind, r.reason, r.key, r.offset) for r in b] == [
        *[("record", None, str(k), 0) for k in (0, 1)], ("gap", "digest", None, 0), *[("record", None, str(k), 0) for k in (3, 4, 5)], ("record", None, "2", len(broken)),
    ]


def test_writes_keep_the_archives_of_other_writes(spark, tmp_path):
    pages, rows = _pages(spark)
    path = f"file://{tmp_path}/archives"
    warc.write_archives(pages, path, "page_id", "url", "html")
    warc.write_archives(pages, path, "page_id", "url", "html")
    assert warc.read_archives(spark, path).count() == 2 * len(rows)
    before = sorted(p.name for p in (tmp_path / "archives").iterdir())
    failed = warc.WarcWriter({"path": path})
    (tmp_path / "archives" / f"{failed.own}x.warc.gz").write_bytes(b"left by a failed task")
    failed.abort([])
    assert sorted(p.name for p in (tmp_path / "archives").iterdir()) == before
    with pytest.raises(Exception, match="no such"):
        broken = pages.selectExpr("page_id", "url", "if(page_id = 7, raise_error('no such'), html) as html")
        warc.write_archives(broken, path, "page_id", "url", "html")
    assert sorted(p.name for p in (tmp_path / "archives").iterdir()) == before


def test_reading_takes_time_in_proportion():
    import time

    def seconds(n):
        data = b"".join(_archive(60) * (n // 60))
        began = time.process_time()
        assert sum(kind == "record" for _, _, kind, _ in warc.salvaged(data)) == n // 60 * 60
        return time.process_time() - began

    seconds(600)
    assert seconds(24000) < 8 * seconds(6000)


def test_large_members_are_gaps():
    bomb = gzip.compress(b"WARC/1.1\r\n" + b"\0" * 3_000_000)
    with pytest.raises(warc.Damaged, match="too large"):
        warc.member_at(bomb, 0, most=1_000_000)
    assert warc.member_at(bomb + b"rest", 0) == (gzip.decompress(bomb), len(bomb))
    many = gzip.compress(random.Random(3).randbytes(300_000))  # over several chunks
    assert warc.member_at(many + many, 0)[1] == len(many) and warc.member_at(many + many, len(many))[1] == len(many)


# -- top-k -----------------------------------------------------------------------------


def _brute(rows, k=20):
    ok = [(i, np.floor(64 * np.array(v, float)).astype(int)) for i, v in rows if i is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v)]
    out = {}
    for i, q in sorted(ok, key=lambda x: (x[0], x[1].tolist()), reverse=True):
        if i % 20 == 0:
            found = sorted((-int(q @ c), j) for j, c in ok if j != i and len(c) == len(q))[:k]
            out[i] = [(n + 1, j, -s) for n, (s, j) in enumerate(found)]
    return out


@pytest.mark.parametrize(("block", "slices"), [(8192, 2), (16, 2), (7, 3), (16, 1)])
def test_topk_equals_brute_force(spark, monkeypatch, block, slices):
    monkeypatch.setattr(topk, "BLOCK", block)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 5)
    r = random.Random(block + slices)
    rows = [(k, [r.gauss(0, 1) for _ in range(6)]) for k in range(150)]
    rows += [(k, [1.0] + [0.0] * 5) for k in range(200, 280)]  # one large group of equal vectors
    rows += [(300, None), (320, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (340, [float("nan")] * 6), (360, [float("inf")] * 6), (None, [1.0] * 6), (380, []), (400, [1e12] * 6), (420, [1.0, 2.0]), (421, [2.0, 1.0])]
    rows += [rows[0], rows[41], rows[41]]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    got = {}
    for x in topk.top_k(docs, docs.vec_id % 20 == 0, slices=slices).collect():
        got.setdefault(x.query_id, []).append((x.rank, x.vec_id, x.score))
    want = _brute(rows)
    assert {k: sorted(v) for k, v in got.items()} == {k: v for k, v in want.items() if v}


def test_topk_of_nothing_and_of_few(spark):
    docs = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in topk.top_k(docs, docs.vec_id % 20 == 0).collect()] == [(0, 1, 1, 2048)]
    assert topk.top_k(docs.limit(0), docs.vec_id == 0).count() == 0


def test_topk_sends_and_multiplies_less_than_all(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    best, found, _ = topk.phases(rows, rows.vec_id % 20 == 0, 20, "vec_id", "embedding", 64.0, 2)
    done = {r.phase: r for r in topk.work(best, found).collect()}
    n, q = rows.count(), rows.filter("vec_id % 20 = 0").count()
    assert done["gather"].multiplied == 2 * n * q  # each slice its own dimensions, once
    assert done["collect"].sent < 0.2 * 2 * n * q and done["collect"].multiplied <= 2 * n * q
    print(done)


def test_short_vectors_are_not_multiplied(spark):
    r = random.Random(1)
    rows = [(k, [r.gauss(0, 1) * (10 if k < 60 else 0.01) for _ in range(6)]) for k in range(400)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    best, found, _ = topk.phases(docs, docs.vec_id == 0, 20, "vec_id", "embedding", 64.0, 2)
    done = {x.phase: x.multiplied for x in topk.work(best, found).collect()}
    assert done["collect"] < 0.5 * done["gather"]


HOSTILE = {
    "open quotes": '<a "', "other quotes": "<p x='", "stray ends": "</x>", "stray div ends": "</div>", "unclosed divs": "<div>t", "inline ends": "</b><b>", "svg": "<svg>", "svg ends": "</svg ", "comments": "<!--",
    "declarations": "<!x ", "signs": "<", "references": "&#", "lists": "<ul><li>x", "rows": "<tr><td>x", "anchors": "<a>x", "attributes": "<a class=", "plain": "word ",
}


@pytest.mark.parametrize("kind", sorted(HOSTILE))
def test_hostile_pages_take_linear_time(kind):
    model = html_crf.default_model()
    seen, took = html_crf.known(model), []
    for size in (1 << 18, 1 << 20):
        began = time.process_time()
        html_crf.main_text(HOSTILE[kind] * (size // len(HOSTILE[kind])), model, seen)
        took.append(time.process_time() - began)
    assert took[1] < 20 and took[1] < 8 * took[0] + 1


def test_many_tags_and_names_inside_each_other():
    model = html_crf.default_model()
    seen = html_crf.known(model)
    for k in ("<div class=w{0}>t", "<x{0}>t", "<b><i>", "</p><p>"):
        began = time.process_time()
        html_crf.main_text("".join(k.format(i) for i in range(60_000)) + "<p>" * 60_000, model, seen)
        assert time.process_time() - began < 20


def test_broken_tags():
    read = lambda page: [b.text for b in html_crf.blocks(page)]
    assert read("<p>a</p><p class='x>b</p><p>c</p>") == ["a", "b", "c"]
    assert read('<p title="1 > 0 < 2">a</p>') == ["a"] and read("2 < 3 and <p>b") == ["2 < 3 and", "b"]
    assert read("a<!-- x <p>b") == ["a"] and read("<svg>a<p>b") == ["a", "b"] and read("</div></p>a</b>") == ["a"]
    assert read("<table><tr><td>a<td>b<tr><td>c</table>d") == ["a", "b", "c", "d"]


def test_cue_words_count_wherever_they_stand():
    long = html_crf.blocks("<p>" + "word " * 500 + "newsletter</p>")
    assert "cue:newsletter" in html_crf.features(long)[0]


def test_members_and_headers_beyond_a_bound(tmp_path):
    block = b"x" * 300_000
    record = b"WARC/1.1\r\nWARC-Type: resource\r\nX-Long: " + b"y" * 3000 + b"\r\nContent-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"
    for data, bound in ((gzip.compress(record), {"most": 100_000}), (record, {"header": 1000})):
        assert [x[2] for x in warc.salvaged(data)] == ["record"]
        assert [x[2] for x in warc.salvaged(data, **bound)] == ["gap"]


def test_the_round_trip_leaves_no_archives(spark, sf_dir):
    from cipherscape.llm import queries
    from cipherscape.llm.common import shared_dir

    assert queries.op6_warc(spark, sf_dir).count() > 0
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/archives")
    system = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    assert not system.exists(where) or len(system.listStatus(where)) == 0
