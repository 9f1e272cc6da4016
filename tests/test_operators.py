"""Operators on small tables: discovery, sources, rules, persistence, reads, lifecycle, streams."""

import hashlib
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from cipherscape.operators import derive, discovery, lifecycle, parse, persist, rules
from cipherscape.plans import read
from cipherscape.sources import files as sources
from cipherscape.sources import templates
from cipherscape.streaming import replay


@pytest.fixture(scope="module")
def parsed(spark):
    keys = spark.range(len(templates.TEMPLATES)).withColumnRenamed("id", "k")
    return parse.parse_files(templates.corpus(keys, "k"))


def _template(path):
    return int(path.split("_")[1].removesuffix(".py"))


def test_rules_give_exactly_what_the_templates_expect(spark, parsed):
    got = {}
    for r in rules.matches(parsed).collect():
        got.setdefault(_template(r.path), []).append(
            (r.rule_id[10:], r["loc"].start_line, r.algorithm, r.api, r.operation, r.confidence, r.evidence_basis, r.enclosing_function, r.enclosing_class)
        )
    for k, t in enumerate(templates.TEMPLATES):
        assert sorted(got.get(k, []), key=str) == sorted(t.expected, key=str), t.name


def test_a_rule_can_be_added(spark, parsed):
    def calls_of_len(context):
        found = context.calls.filter("resolved is null and chain[0] = 'len'")
        return rules.match(found, "MINE", "LEN", F.lit("len"), F.lit("HASH"), "HIGH", "DIRECT_MODULE_API")

    before = dict(rules.REGISTRY)
    try:
        rules.register_rule("MINE", calls_of_len)
        assert [(r.rule_id, _template(r.path)) for r in rules.matches(parsed, ["MINE"]).collect()] == [("MINE", 16)]
    finally:
        rules.REGISTRY.clear()
        rules.REGISTRY.update(before)


def test_findings_persist_and_read_back(spark, parsed, tmp_path):
    found = derive.findings(rules.hash_rule(rules.Context(parsed)), parsed, F.lit("github/o/n")).persist()
    tables = persist.relations(found)
    root = f"file://{tmp_path}"
    persist.write(tables, root)
    findings = persist.read(spark, root, "findings").persist()
    assert found.count() == findings.count() + 1  # one template repeats a call
    assert persist.read(spark, root, "evidence").filter("source_excerpt = ''").count() == 0
    assert lifecycle.missing_evidence(findings, persist.read(spark, root, "evidence")).count() == 0
    (tmp_path / "findings" / "run=lost").mkdir()
    spark.createDataFrame([("x",)], "id string").write.mode("overwrite").parquet(f"{root}/findings/run=lost")
    assert persist.read(spark, root, "findings").count() == findings.count()
    page = read.findings_page(findings, "s", page=1, size=3, algorithm="SHA-256")
    assert page.meta.first().total == findings.filter("algorithm = 'SHA-256'").count() and page.items.count() == 2
    assert read.findings_page(findings, "s", page=99).items.count() == 0
    detail = read.details(findings, persist.read(spark, root, "evidence"), persist.read(spark, root, "impact_nodes"), persist.read(spark, root, "review_items"))
    row = detail.filter("observed.algorithm = 'SHA-256'").first()
    assert row.review.status == "OPEN" and row.impact.node_count == len(row.impact.nodes) and row.migration.review_path == "HASH / POLICY REVIEW"
    with pytest.raises(ValueError):
        read.findings_page(findings, "s", role="NONE")
    with pytest.raises(ValueError):
        read.paged(findings, [F.col("id")], page=1, size=201)


def test_fingerprint_rejects_the_separator(spark):
    row = spark.range(1).select(*[F.lit("a\x1fb" if k == 4 else "x").alias(f"c{k}") for k in range(8)])
    with pytest.raises(Exception, match="separator"):
        row.select(derive.fingerprint(*[F.col(f"c{k}") for k in range(8)])).collect()


def test_excerpts(spark):
    lines = F.array(*[F.lit(f"l{k}") for k in range(1, 61)])
    one = lambda a, b: spark.range(1).select(derive.excerpt(lines, F.lit(a), F.lit(b)).alias("e")).first().e
    assert one(0, 2).source_excerpt == "l1\nl2" and one(60, 99).source_excerpt == "l60" and one(61, 61) is None
    assert one(1, 60).truncated and one(1, 60).source_excerpt.count("\n") == 39 and not one(1, 40).truncated


def test_tree_source_and_discovery(spark, tmp_path):
    for name, content in {
        "a.py": b"x = 1\n", "__init__.py": b"", "_p/b.py": b"y", ".hidden.py": b"z", "README.md": b"", "nul.py": b"a\0b", "latin.py": b"\xe9", ".git/c.py": b"q", "big.py": b"x" * 50,
    }.items():
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_bytes(content)
    os.symlink(tmp_path / "a.py", tmp_path / "link.py")
    sources.register(spark)
    rows = spark.read.format("source_tree").load(str(tmp_path))
    found = {r.path: r.skip_reason for r in discovery.classify(rows, max_bytes=49).collect()}
    assert found == {
        "a.py": None, "__init__.py": None, "_p/b.py": None, ".hidden.py": None, "README.md": "UNSUPPORTED_LANGUAGE", "nul.py": "BINARY_FILE", "latin.py": "INVALID_ENCODING",
        ".git/c.py": "IGNORED_PATH", "big.py": "TOO_LARGE",
    }
    total = discovery.summary(discovery.classify(rows, max_bytes=49)).first()
    assert (total.total_files, total.analyzed_files, total.skipped_files) == (9, 4, 5) and total.skipped_reasons["TOO_LARGE"] == 1
    running = hashlib.sha256()
    for path in sorted(found, key=lambda p: p.split("/")):
        running.update(path.encode() + b"\0" + hashlib.sha256((tmp_path / path).read_bytes()).hexdigest().encode() + b"\n")
    assert discovery.content_hash(rows).first().content_hash == running.hexdigest()
    assert parse.parse_files(discovery.supported(rows)).filter("error is null").count() == 5


def test_zip_source(spark, tmp_path):
    good = tmp_path / "good.zip"
    with zipfile.ZipFile(good, "w") as z:
        z.writestr("top/a.py", "x = 1")
        z.writestr("top/d/b.py", "y = 2")
        link = zipfile.ZipInfo("top/link")
        link.external_attr = 0o120777 << 16
        z.writestr(link, "d/b.py")  # one that leads out is unsafe: test_sources
    sources.register(spark)
    rows = spark.read.format("source_zip").load(str(good)).collect()
    assert sorted((r.path, bytes(r.content)) for r in rows) == [("a.py", b"x = 1"), ("d/b.py", b"y = 2")]
    for name in ("../x", "/abs", "C:/x", "a\\b"):
        bad = tmp_path / "bad.zip"
        with zipfile.ZipFile(bad, "w") as z:
            z.writestr(name, "x")
        with pytest.raises(sources.UnsafeArchive):
            list(sources.zip_rows(str(bad), "s"))
    with pytest.raises(sources.ArchiveTooLarge):
        list(sources.zip_rows(str(good), "s", max_files=1))
    with pytest.raises(sources.ArchiveTooLarge):
        list(sources.zip_rows(str(good), "s", max_bytes=6))
    good.write_bytes(good.read_bytes()[:60])
    with pytest.raises(sources.MalformedArchive):
        list(sources.zip_rows(str(good), "s"))


@pytest.mark.parametrize("url", ["http://github.com/a/b", "https://github.com/a", "https://u@github.com/a/b", "https://github.com:1/a/b", "https://github.com/a/b?c", "https://x.org/a/b", "https://github.com/-a/b", "https://github.com/a-/b", "https://github.com/a/..", "https://github.com/a/.git"])
def test_bad_repositories(spark, url):
    with pytest.raises(ValueError):
        discovery.parse_repository(url)
    assert spark.range(1).select(discovery.repository_columns(F.lit(url)).alias("r")).first().r is None


def test_good_repositories(spark):
    for url, want in {"https://github.com/A-b/c.d_e.git": ("A-b", "c.d_e"), " HTTPS://GitHub.com//own//repo/ ": ("own", "repo"), "https://github.com/a/b.git.git": ("a", "b.git")}.items():
        assert discovery.parse_repository(url) == want
        row = spark.range(1).select(discovery.repository_columns(F.lit(url)).alias("r")).first().r
        assert (row.owner, row.name, row.canonical_url) == (*want, f"https://github.com/{want[0]}/{want[1]}")


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "snapshot_id string, path string, size bigint, content binary")
    parsed = parse.parse_files(empty)
    assert rules.matches(parsed).count() == 0 and discovery.content_hash(empty).count() == 0
    assert lifecycle.replay_reviews(spark.createDataFrame([], "review_id string, seq long, status string, assigned_to string, note string")).count() == 0


def test_three_failing_attempts_fail_a_job(spark):
    moves = ["RUNNING", "FAILED", "RUNNING", "FAILED", "RUNNING", "FAILED", "RUNNING"]
    row = lifecycle.replay_jobs(spark.createDataFrame([("j", k, m) for k, m in enumerate(moves)], "job_id string, seq long, wanted string")).first()
    assert (row.status, row.attempt_count, row.rejected) == ("FAILED", 3, 1)


def test_reviews_are_audited_and_guarded(spark):
    asked = [("r", 0, "REVIEWED", "x", None), ("r", 1, "IN_REVIEW", "me", None), ("r", 2, None, None, "n"), ("r", 3, "REVIEWED", None, None), ("r", 4, "REVIEWED", None, None)]
    row = lifecycle.replay_reviews(spark.createDataFrame(asked, "review_id string, seq long, status string, assigned_to string, note string")).first()
    assert (row.status, row.assigned_to, row.note, row.rejected, row.started, row.completed) == ("REVIEWED", "me", "n", 1, 1, 1)


def test_evidence_guard_raises(spark):
    findings = spark.createDataFrame([("a",), ("b",)], "id string")
    evidence = spark.createDataFrame([("a",)], "finding_id string")
    with pytest.raises(Exception, match="missing_evidence"):
        lifecycle.checked_evidence(findings, evidence).collect()


def test_stream_equals_batch(spark, tmp_path):
    rows = [(f"r{k % 3}", k, ["OPEN", "IN_REVIEW", "REVIEWED", None][k % 4], None, f"n{k}") for k in range(24)]
    schema = "review_id string, seq long, status string, assigned_to string, note string"
    table = spark.createDataFrame(rows, schema)
    for part in range(3):
        table.filter(F.col("seq") % 3 == part).coalesce(1).write.parquet(f"{tmp_path}/in/{part}")
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    replay.stream_replay(stream, f"{tmp_path}/log", lifecycle.replay_reviews, f"{tmp_path}/check").awaitTermination()
    order = lambda df: sorted(map(str, df.collect()))
    assert order(replay.state(spark, f"{tmp_path}/log", lifecycle.replay_reviews)) == order(lifecycle.replay_reviews(table))


def test_every_finding_has_its_place_in_the_queue(spark):
    columns = "scan_id string, priority_score int, path string, start_line int, start_column int, rule_id string, api string, operation string, end_line int, end_column int"
    rows = [("a" if k % 5 else "b" if k % 2 else None, k * 37 % 11, f"p{k * 7 % 3}", k % 4, k % 2, "R", "x", "SIGN", k, 0) for k in range(1500)]
    got = read.engine_ranks(spark.createDataFrame(rows, columns).repartition(6)).collect()
    want = set()
    for scan in ("a", "b", None):
        own = sorted((r for r in rows if r[0] == scan), key=lambda r: (-r[1], *r[2:]))
        want |= {(*r, place) for place, r in enumerate(own, 1)}
    assert len(got) == len(rows) and set(map(tuple, got)) == want


def test_stripped_is_what_python_strips(spark):
    """All of Unicode's spaces at either end, texts of nothing else."""
    spaces = [chr(c) for c in range(0x110000) if chr(c).isspace()]
    texts = [f"{a}x {a}é{b}" for a, b in zip(spaces, spaces[::-1], strict=True)] + ["", " ", "".join(spaces), "\u200bx\u200b", "a\n", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", derive.stripped(F.col("t")).alias("s"))
    assert all(r.s == (r.t and r.t.strip()) for r in rows.collect())
