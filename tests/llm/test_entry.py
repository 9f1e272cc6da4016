"""The registered corpus queries, and the pipeline against brute force."""

import collections
import re

import corpus_pipeline
import pytest
from oracle import difference

from cipherscape.llm import queries, quality
from cipherscape.llm.common import table

NAMES = [f"op{n}_" for n in range(1, 11)]
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_ten_operators_are_registered():
    import __spark_entry__

    found = __spark_entry__.queries()
    assert "pipeline" in found and all(sum(k.startswith(n) for k in found) == 1 for n in NAMES)
    assert set(queries.oracle_sql()) <= set(queries.queries())


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, sf_dir, name):
    assert difference(spark, queries.queries()[name], queries.oracle_sql()[name], sf_dir) is None


def test_the_library_does_not_import_this_subpackage():
    from pathlib import Path

    root = Path(corpus_pipeline.__file__).parent / "cipherscape"
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert ".llm" not in path.read_text(), path


def test_pipeline_stages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "near duplicates", "repeated passages", "mixing", "packing"]

    kept = stages["quality"](spark, docs, sf_dir)
    scores = {r.doc_id: r.predicted for r in quality.quality_scores(docs, table(spark, sf_dir, "labels")).collect()}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, p in scores.items() if p == 1)
    truth = {r.doc_id: r.quality for r in table(spark, sf_dir, "labels").collect()}
    assert sum(scores[i] == q for i, q in truth.items()) >= 0.97 * len(truth)

    single = stages["near duplicates"](spark, docs, sf_dir)
    rows = {r.doc_id: r.text or "" for r in docs.collect()}
    sets = {}
    for i, t in rows.items():
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    parent = {i: i for i in rows}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in rows:
        for b in rows:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    assert sorted(r.doc_id for r in single.collect()) == sorted(i for i in rows if find(i) == i)

    cut = {r.doc_id: r for r in stages["repeated passages"](spark, docs, sf_dir).collect()}
    first, words = {}, {i: WORD.findall(t) for i, t in rows.items()}
    for i, w in words.items():
        for k in range(len(w) - 12):
            key = tuple(w[k : k + 13])
            first[key] = min(first.get(key, i), i)
    for i, w in words.items():
        gone = {j for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < i for j in range(k, k + 13)}
        want = " ".join(x for j, x in enumerate(w) if j not in gone) if gone else rows[i]
        assert (cut[i].text or "") == want and (not gone or cut[i].n_chars == len(want))

    mix = stages["mixing"](spark, docs, sf_dir)
    copies = collections.Counter(r.doc_id for r in mix.collect())
    assert set(copies.values()) <= {1, 2} and set(copies) <= set(rows)
    total = sum(len(words[i]) * n for i, n in copies.items())
    assert abs(total - 1.5 * sum(map(len, words.values()))) < 0.1 * total
    for name in list(stages)[:-1]:
        assert stages[name](spark, docs.limit(0), sf_dir).columns == docs.columns
    assert stages["packing"](spark, docs.limit(0), sf_dir).count() == 0


def test_pipeline_runs(spark, sf_dir):
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert got and sorted(r.sequence_id for r in got) == list(range(len(got)))
