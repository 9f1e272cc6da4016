"""Personal data: the patterns against plain ones, messages against enumeration, and what skip edges are for."""

import dataclasses
import hashlib
import itertools
import random
import re
import time

import numpy as np
import pytest

from cipherscape.llm import pii, queries


def plain_spans(text):
    """The patterns as they are stated, one by one."""
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m[0] if c.isdigit()]
        twice = [d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(reversed(digits))]
        if 12 <= len(digits) <= 19 and sum(twice) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out)


def plain_row(text):
    spans = plain_spans(text or "")
    kinds = [k for _, k, _ in spans]
    listed = ",".join(f"{('email', 'ip', 'card', 'phone')[k]}:{s}:{e}" for s, k, e in spans)
    return *(kinds.count(k) for k in range(4)), hashlib.sha256(listed.encode()).hexdigest(), listed


def test_patterns_on_random_texts():
    r = random.Random(4)
    for _ in range(4000):
        text = "".join(r.choices("0123456789 .-+()@ab\né_%", weights=[3] * 10 + [3, 4, 3, 2, 1, 1, 2, 3, 3, 1, 1, 1, 1], k=r.randint(0, 60)))
        assert pii.base_spans(text) == plain_spans(text), text
    for text in ("4111111111111111", "x 4111 1111-1111 1111.", "1.2.3.4.5.6.7.8", "a@b.c@d.e", "+1 (017) 555-7713", "001.02.3.4 256.1.1.1", "a.@b.c.", "+1 2 3 4 5 6 7 8 9 10 11 12 13", "1" * 13 + "\n" + "2" * 4):
        assert pii.base_spans(text) == plain_spans(text)


def test_query_equals_the_plain_patterns(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    got = queries.op13_personal_data(spark, sf_dir).collect()
    assert len(got) == len(docs)
    for r in got:
        *want, listed = plain_row(docs[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256] == want
        assert set(filter(None, listed.split(","))) <= set(r.spans.split(","))


def _exact(model, graph, total):
    """Marginals by enumeration of all labellings."""
    own = np.zeros((total, 5))
    np.add.at(own, np.array(graph.owner), model.weights[np.array(graph.feature)])
    out = np.zeros((total, 5))
    for labels in itertools.product(range(5), repeat=total):
        weight = np.exp(sum(own[i, x] for i, x in enumerate(labels)) + sum(model.chain[labels[a], labels[b]] for a, b in graph.chain) + sum(model.skip[labels[a], labels[b]] for a, b in graph.skip))
        for i, x in enumerate(labels):
            out[i, x] += weight
    return out / out.sum(axis=1, keepdims=True)


@pytest.mark.parametrize("loop", [False, True])
def test_messages_against_enumeration(loop, monkeypatch):
    monkeypatch.setattr(pii, "KEPT", 0.2)
    r = np.random.default_rng(1)
    model = pii.Model({}, r.normal(size=(5, 5)), r.normal(size=(5, 5)) * 0.5, r.normal(size=(5, 5)) * 0.3 + np.eye(5))
    graph = pii.Graph(count=5)
    graph.feature.extend(range(5))
    graph.owner.extend(range(5))
    graph.chain = [(0, 1), (1, 2), (3, 4)]
    graph.skip = [(2, 5), (4, 5), (0, 5)] if loop else [(2, 5), (4, 5)]
    share, chain, skip = pii.passed(model, graph, 6, 40)
    assert np.abs(share - _exact(model, graph, 6)).max() < (0.06 if loop else 1e-9)  # exact without a loop
    assert np.allclose(chain[0].sum(axis=1), share[0], atol=1e-6) and np.allclose(skip[1].sum(axis=0), share[5], atol=1e-6)


def _judged(model, data):
    hits = ours = theirs = 0
    for (_, gold), (base, spans) in zip(data, pii.all_spans([t for t, _ in data], model), strict=True):
        want, got = set(gold) - set(base), set(spans) - set(base)
        hits, ours, theirs = hits + len(want & got), ours + len(got), theirs + len(want)
        assert set(base) <= set(spans) and spans == sorted(spans)
    return hits / ours, hits / theirs


def test_held_out_texts_and_the_worth_of_skip_edges():
    model, data = pii.default_model(), pii.labelled_texts(300, seed=99)
    precision, recall = _judged(model, data)
    assert precision > 0.97 and recall > 0.93
    alone = dataclasses.replace(model, skip=np.zeros((5, 5)))
    assert _judged(alone, data)[1] < recall - 0.1


def _kinds(text):
    (base, spans) = next(pii.all_spans([text], pii.default_model()))
    return [(pii.KINDS[k], text[s:e]) for s, k, e in spans if (s, k, e) not in base]


def test_labels_agree_across_a_text():
    far = "many words that say nothing of it stand here, and more of them follow. " * 30
    assert _kinds(f"Please call 555-7713 today. {far}Then ask for 555-7713 again.") == [("phone", "555-7713")] * 2
    assert _kinds(f"Your order 555-7713 is late. {far}Then ask for 555-7713 again.") == []
    assert _kinds(f"Then ask for 555-7713 again. {far}Phone: 555-7713 or so.") == [("phone", "555-7713")] * 2
    assert ("email", "anna.bell [at] example.org") in _kinds("write to anna.bell [at] example.org now")
    assert _kinds("paid with card 77 4111111111111111 in May") == [("card", "4111111111111111")]  # 18 digits fail as one
    for clean in ("In 2019 there were 1204 of them, 12.5% more.", "see page 214 and @someone at 12:45", "version 3.11.2 of 2024-01-02, ISBN 978-3-16-148410-0", 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"'):
        assert _kinds(clean) == []


def test_a_text_alone_or_among_others_gives_the_same(monkeypatch):
    texts = [t for t, _ in pii.labelled_texts(40, seed=5)]
    together = list(pii.all_spans(texts, pii.default_model()))
    assert together == [next(pii.all_spans([t], pii.default_model())) for t in texts]
    monkeypatch.setattr(pii, "TOGETHER", 10)
    assert together == list(pii.all_spans(texts, pii.default_model()))


def test_hostile_texts_take_linear_time():
    for piece in ("a", "1", "1.", "@", "a@", "+1 ", "+", "1 ", "(", "a.", "[at] ", ":", "1-", " ", "\n1", "a@b.c "):
        began = time.time()
        next(pii.all_spans([piece * (200_000 // len(piece))], pii.default_model()))
        assert time.time() - began < 12, piece


def test_edges(spark):
    rows = [(1, None, 7), (2, "", 7), (3, "mail a@b.co", 7), (3, "mail a@b.co", 7), (None, "call 0171 5550123", None), (4, "\U0001f600 10.0.0.1", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_email int")
    got = sorted(pii.found(df).collect(), key=lambda r: (r.doc_id or 0))
    assert [(r.doc_id, r.n_email, r.n_ip, r.spans) for r in got] == [(None, 0, 0, "phone:5:17"), (1, 0, 0, ""), (2, 0, 0, ""), (3, 1, 0, "email:5:11"), (3, 1, 0, "email:5:11"), (4, 0, 1, "ip:2:10")]
    assert got[1].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert pii.found(df.filter("false")).collect() == []
