"""Contents that many files hold are analysed once, and every file keeps its findings."""

from pyspark.sql import functions as F

from cipherscape.operators import copies, derive, discovery, parse, persist, rules
from cipherscape.plans import queries
from cipherscape.sources import templates


def test_the_corpus_is_parsed_once_a_content(spark, sf_dir):
    persist.forget(spark)
    files, parsed = queries._corpus(spark, sf_dir)
    assert files.count() == 200 and parsed.count() == len({t.source for t in templates.TEMPLATES})  # 200 where each file is parsed


def test_findings_are_those_of_each_file(spark):
    """As file by file: copies in several snapshots, paths that are no module, contents that don't parse or are null."""
    rows = [(f"s{k % 3}", f"p{k % 4}/{'a-b' if k % 5 == 0 else 'm'}{k}.py", t.source.encode()) for n in (0, 40) for k, t in enumerate(templates.TEMPLATES, n)]
    rows += [("s0", "none.py", None), ("s1", "__init__.py", b""), ("s2", "bad.py", b"\xff")]
    files = spark.createDataFrame(rows, "snapshot_id string, path string, content binary").withColumn("size", F.octet_length("content").cast("long"))
    each = parse.parse_files(files).persist()
    apart = parse.parse_files(copies.contents(files)).persist()
    assert apart.count() == len({(r[2] or b"") for r in rows})
    want = derive.findings(rules.matches(each), each, F.lit("github/o/n"))
    got = derive.derived(copies.shared_out(derive.shown(rules.matches(apart), apart), files), F.lit("github/o/n"))
    assert sorted(map(str, got.select(*sorted(want.columns)).collect())) == sorted(map(str, want.select(*sorted(want.columns)).collect()))
    assert got.filter("module_path is null").count() > 0 and got.count() == 2 * sum(len(t.expected) for t in templates.TEMPLATES)
    none = copies.shared_out(derive.shown(rules.hash_rule(rules.Context(apart)), apart), discovery.supported(files.limit(0)))
    assert none.count() == 0
