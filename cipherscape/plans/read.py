"""The read side: filtered, ordered, paged views of the persisted relations."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cipherscape.functions import vocab
from cipherscape.operators import derive, lifecycle, persist

PAGE_SIZE, MAX_PAGE_SIZE = 50, 200


def rank(column: str, order: list[str], otherwise: int) -> Column:
    """The place of a value in a vocabulary."""
    return reduce(lambda c, kv: c.when(F.col(column) == kv[1], kv[0]), list(enumerate(order))[1:], F.when(F.col(column) == order[0], 0)).otherwise(otherwise)


def findings_order() -> list[Column]:
    return [rank("priority", vocab.PRIORITIES, 9), rank("confidence", vocab.CONFIDENCES, 9), F.col("file_path"), F.col("start_line"), F.col("fingerprint")]


def queue_order() -> list[Column]:
    return [*findings_order()[:4], F.col("review_id")]


def legacy_queue_order() -> list[Column]:
    """Without the confidence."""
    return [rank("priority", vocab.PRIORITIES, 9), F.col("file_path"), F.col("start_line"), F.col("review_id")]


_VOCABULARIES = {
    "priority": vocab.PRIORITIES, "role": vocab.ROLES, "status": vocab.FINDING_STATUSES, "confidence": vocab.CONFIDENCES, "review_status": vocab.REVIEW_STATUSES,
}


def filtered(rows: DataFrame, **filters: str | None) -> DataFrame:
    """Rows that equal every filter given; a value outside its vocabulary is a ValueError."""
    for name, value in filters.items():
        if value is None:
            continue
        if name in _VOCABULARIES and value not in _VOCABULARIES[name]:
            raise ValueError(f"{name}: {value!r} is none of {_VOCABULARIES[name]}")
        rows = rows.filter(F.col(name) == value)
    return rows


@dataclass
class Page:
    items: DataFrame
    meta: DataFrame


def paged(rows: DataFrame, order: list[Column], page: int = 1, size: int = PAGE_SIZE) -> Page:
    """One page, in order, and its numbers (page, page_size, total, pages); a page past the end is empty."""
    if page < 1 or not 1 <= size <= MAX_PAGE_SIZE:
        raise ValueError("page or page_size out of range")
    items = rows.orderBy(*order).offset((page - 1) * size).limit(size)
    meta = rows.agg(F.count("*").alias("total")).select(
        F.lit(page).alias("page"), F.lit(size).alias("page_size"), "total", F.ceil(F.col("total") / size).cast("long").alias("pages")
    )
    return Page(items, meta)


def findings_page(findings: DataFrame, scan_id: str, page: int = 1, size: int = PAGE_SIZE, reviews: DataFrame | None = None, **filters: str | None) -> Page:
    rows = filtered(findings.filter(F.col("scan_id") == scan_id), **filters)
    return paged(list_items(rows, reviews), findings_order(), page, size)


def list_items(findings: DataFrame, reviews: DataFrame | None = None) -> DataFrame:
    """Findings with their review path, whether they are candidates for migration, and the state of their first review."""
    rows = findings.withColumn("review_path", derive.review_path(F.col("role"), F.col("algorithm"))).withColumn("is_migration_candidate", derive.is_candidate(F.col("review_path")))
    if reviews is None:
        return rows
    first = lifecycle.oldest_review(_dated(reviews)).select(F.col("finding_id").alias("id"), F.col("status").alias("review_status"))
    return rows.join(first, "id", "left")


def _dated(reviews: DataFrame) -> DataFrame:
    return reviews if "created_at" in reviews.columns else reviews.withColumn("created_at", F.lit(0))


def queue_rows(reviews: DataFrame, findings: DataFrame) -> DataFrame:
    """(review, finding): a review item and its finding, each as one struct."""
    item = F.struct(F.col("review_id").alias("id"), "finding_id", F.col("review_status").alias("status"), "assigned_to", "note")
    shown = ("fingerprint", "scan_id", "algorithm", "api", "operation", "role", "confidence", "priority", "review_path", "is_migration_candidate", "file_path", "start_line")
    rows = review_queue(reviews, list_items(findings))
    return rows.select(item.alias("review"), F.struct(F.col("finding_id").alias("id"), *shown).alias("finding"))


def legacy_queue(reviews: DataFrame, findings: DataFrame, scan_id: str, status: str | None = None) -> DataFrame:
    """A scan's review items in the older order."""
    rows = filtered(review_queue(reviews, findings.filter(F.col("scan_id") == scan_id)), review_status=status)
    return rows.orderBy(*legacy_queue_order())


def engine_documents(found: DataFrame, scan: str = "snapshot_id") -> DataFrame:
    """Derived findings as whole documents, before they are persisted: with score, reasons, nodes and edges."""
    location = F.struct(F.col("path").alias("file_path"), "start_line", "end_line", "start_column", "end_column")
    return found.select(
        F.col("fingerprint").alias("id"), F.col(scan).alias("scan_id"), "repository",
        F.struct(
            "rule_id", "algorithm", "primitive", "library", "api", "operation", location.alias("location"), "source_excerpt", "enclosing_function", "enclosing_class", "parser_version", "ruleset_version",
        ).alias("observed"),
        F.struct("role", F.col("role_rationale").alias("rationale"), "confidence", "evidence_basis").alias("inference"),
        F.struct("review_path", derive.review_rationale(F.col("review_path")).alias("rationale"), "is_migration_candidate", "pqc_ruleset_version").alias("migration"),
        F.struct(F.lit(SCOPE).alias("scope"), "node_count", F.col("impact_nodes").alias("nodes"), F.col("impact_edges").alias("relationships")).alias("impact"),
        F.struct(F.col("priority").alias("level"), F.col("priority_score").alias("score"), F.col("priority_reasons").alias("reasons")).alias("priority"),
    )


def engine_summaries(found: DataFrame, scan: str = "snapshot_id", *more: str) -> DataFrame:
    """Derived findings as rows of a list, with ``more`` of their columns."""
    columns = ("algorithm", "api", "operation", "role", "confidence", "review_path", "is_migration_candidate", "priority", "priority_score")
    return found.select(F.col("fingerprint").alias("id"), F.col(scan).alias("scan_id"), *columns, F.col("path").alias("file_path"), "start_line", "end_line", *more)


def _reviewed(found: DataFrame, scan: str, reviews: DataFrame, how: str) -> DataFrame:
    """Findings with the reviews (scan_id, fingerprint, review_id, status, assigned_to, note, updated_at) that name them."""
    named = reviews.select(F.col("scan_id").alias("_scan"), F.col("fingerprint").alias("_finding"), "review_id", F.col("status").alias("review_status"), "assigned_to", "note", "updated_at")
    return found.join(named, (F.col(scan) == F.col("_scan")) & (F.col("fingerprint") == F.col("_finding")), how).drop("_scan", "_finding")


def _counted(rows: DataFrame, scan: str) -> DataFrame:
    totals = rows.groupBy(F.col(scan).alias("_scan")).agg(F.count("*").alias("total"))  # a row for each scan
    return rows.join(totals, F.col(scan).eqNullSafe(F.col("_scan"))).drop("_scan")


def engine_page(found: DataFrame, reviews: DataFrame, scan: str = "snapshot_id") -> DataFrame:
    """The page of all findings of each scan: rows of a list with their ``place``, the scan's ``total`` and the status of their review."""
    placed = places(found, scan, [*engine_order()[1:], F.col("fingerprint")], "place")
    return engine_summaries(_counted(_reviewed(placed, scan, reviews, "left"), scan), scan, "review_status", "place", "total")


def engine_review_queue(found: DataFrame, reviews: DataFrame, scan: str = "snapshot_id") -> DataFrame:
    """The review queue of each scan: a row for each review, with its ``place`` by falling score and the scan's ``total``."""
    placed = _counted(places(_reviewed(found, scan, reviews, "inner"), scan, [*engine_order(), F.col("fingerprint")], "place"), scan)
    return placed.select(
        "review_id", F.col("fingerprint").alias("finding_id"), F.col(scan).alias("scan_id"), "algorithm", "api", "role", "review_path", "priority", "priority_score",
        F.col("review_status").alias("status"), "assigned_to", "note", F.col("path").alias("file_path"), "start_line", "updated_at", "place", "total",
    )


#: What impact covers: what static analysis has seen (a fixed value).
SCOPE = "STATICALLY_OBSERVED"
#: A finding's chain outwards, in which its nodes are shown.
CHAIN = ["ALGORITHM", "API", "FUNCTION", "CLASS", "MODULE", "FILE"]


def review_queue(reviews: DataFrame, findings: DataFrame) -> DataFrame:
    """Review items with their findings."""
    named = reviews.select(F.col("id").alias("review_id"), "finding_id", F.col("status").alias("review_status"), "assigned_to", "note")
    return named.join(findings.withColumnRenamed("id", "finding_id"), "finding_id")


def queue_page(reviews: DataFrame, findings: DataFrame, page: int = 1, size: int = PAGE_SIZE, **filters: str | None) -> Page:
    return paged(filtered(review_queue(reviews, findings), **filters), queue_order(), page, size)


ENGINE_ORDER = ("path", "start_line", "start_column", "rule_id", "api", "operation", "end_line", "end_column")


def engine_order() -> list[Column]:
    return [F.col("priority_score").desc(), *map(F.col, ENGINE_ORDER)]


def engine_queue(found: DataFrame) -> DataFrame:
    """Derived findings by falling score, then place."""
    return found.orderBy(*engine_order())


def places(rows: DataFrame, scan: str, order: list[Column], name: str, tasks: int | None = None) -> DataFrame:
    """``rows`` with ``name``: 1, 2, 3 ... in order within each scan.

    Rows are range partitioned (in ``tasks`` parts, or as Spark has it), so no task sees all rows of a scan; a row's place is its
    number in its partition and the scan's rows in the partitions before.  They are written to the shared folder first: the
    numbers and the counts of partitions must be those of one run, and bounds of ranges differ from run to run.
    """
    sort = [F.col(scan).asc(), *order]
    dealt = rows.repartitionByRange(tasks, *sort) if tasks else rows.repartitionByRange(*sort)
    placed = persist.written(dealt.sortWithinPartitions(*sort).withColumn("_m", F.monotonically_increasing_id()))
    part = F.shiftright("_m", 33)
    parts = placed.groupBy(F.col(scan).alias("_scan"), part.alias("_p")).agg(F.min("_m").alias("_first"), F.count("*").alias("_n"))  # a scan's rows are neighbours
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_scan").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counted = parts.withColumn("_before", before)  # as many rows as partitions and scans
    joined = placed.join(F.broadcast(counted), F.col(scan).eqNullSafe(F.col("_scan")) & (part == F.col("_p")))
    return joined.withColumn(name, F.col("_before") + F.col("_m") - F.col("_first") + 1).select(*rows.columns, name)


def engine_ranks(found: DataFrame, scan: str = "scan_id", tasks: int | None = None) -> DataFrame:
    """Every finding with its place (rank, from 1) in the engine's queue of its scan."""
    return places(found, scan, engine_order(), "rank", tasks)


#: Places of a scan in a block of the index.
BLOCK = 10_000


def page_index(rows: DataFrame, order: list[Column] | None = None) -> DataFrame:
    """Rows with their ``place`` in the pages of their scan, and its ``block``: to be written in folders by block.

    A page is then a range of places in one or two blocks, however deep it lies.
    """
    ranked = places(rows, "scan_id", order or findings_order(), "place")
    return ranked.withColumn("block", F.floor((F.col("place") - 1) / BLOCK).cast("int")).repartition("block", F.hash("scan_id") % 16).sortWithinPartitions("block", "scan_id", "place")


def indexed_page(index: DataFrame, scan_id: str, page: int = 1, size: int = PAGE_SIZE) -> Page:
    """One page of a written index, as ``paged`` gives it for all rows of a scan."""
    if page < 1 or not 1 <= size <= MAX_PAGE_SIZE:
        raise ValueError("page or page_size out of range")
    first, last = (page - 1) * size + 1, page * size
    mine = index.filter(F.col("scan_id") == scan_id)
    blocks = list(range((first - 1) // BLOCK, (last - 1) // BLOCK + 1))
    items = mine.filter(F.col("block").isin(blocks) & F.col("place").between(first, last)).orderBy("place")
    meta = mine.agg(F.coalesce(F.max("place"), F.lit(0)).alias("total")).select(F.lit(page).alias("page"), F.lit(size).alias("page_size"), "total", F.ceil(F.col("total") / size).cast("long").alias("pages"))
    return Page(items, meta)


def details(findings: DataFrame, evidence: DataFrame, nodes: DataFrame, reviews: DataFrame, scans: DataFrame | None = None, repositories: DataFrame | None = None) -> DataFrame:
    """One nested document for each finding, its children summed up before they are joined."""
    chain = F.struct(rank("node_type", CHAIN, len(CHAIN)).alias("place"), F.concat_ws(":", "node_type", "label").alias("id"), "node_type", "label", "relationship", "confidence")
    impact = nodes.groupBy("finding_id").agg(
        F.transform(F.array_sort(F.collect_list(chain)), lambda n: n.dropFields("place")).alias("nodes"), F.count("*").alias("node_count"),
        F.max(F.when(F.col("node_type") == "FUNCTION", F.col("label"))).alias("enclosing_function"), F.max(F.when(F.col("node_type") == "CLASS", F.col("label"))).alias("enclosing_class"),
    )
    first = lifecycle.oldest_review(_dated(reviews))
    first = first.select("finding_id", F.struct(F.col("id").alias("review_id"), "status", "assigned_to", "note").alias("review"))
    shown = evidence.select("finding_id", "source_excerpt", "rule_id", "parser_version", "ruleset_version")
    rows = findings.withColumnRenamed("id", "finding_id").join(shown, "finding_id", "left").join(impact, "finding_id", "left").join(first, "finding_id", "left")
    if scans is not None:
        rows = rows.join(scans.select(F.col("id").alias("scan_id"), "repository_id", "commit_sha", "pqc_ruleset_version"), "scan_id", "left")
    if repositories is not None:
        rows = rows.join(repositories.select(F.col("id").alias("repository_id"), "provider", "owner", "name"), "repository_id", "left")
    path = derive.review_path(F.col("role"), F.col("algorithm"))
    version = F.col("pqc_ruleset_version") if "pqc_ruleset_version" in rows.columns else F.lit(vocab.PQC_VERSION)
    extra = [F.struct("provider", "owner", "name").alias("repository")] * (repositories is not None) + ["commit_sha"] * (scans is not None)
    return rows.select(
        "finding_id", "fingerprint", "scan_id", *extra,
        F.struct(
            "algorithm", "primitive", "library", "api", "operation", "file_path", "start_line", "end_line", "enclosing_function", "enclosing_class",
            F.coalesce("source_excerpt", F.lit("")).alias("source_excerpt"), F.coalesce("rule_id", F.lit("")).alias("rule_id"), F.lit(None).cast("string").alias("evidence_basis"),
        ).alias("observed"),
        F.struct("role", "confidence", derive.role_rationale(F.col("role")).alias("rationale")).alias("inference"),
        F.struct(path.alias("review_path"), derive.review_rationale(path).alias("rationale"), derive.is_candidate(path).alias("is_candidate"), version.alias("pqc_ruleset_version")).alias("migration"),
        F.struct(
            F.lit(SCOPE).alias("scope"), F.coalesce("nodes", F.array().cast(rows.schema["nodes"].dataType)).alias("nodes"), F.coalesce("node_count", F.lit(0)).alias("node_count"),
            F.array().cast("array<struct<source:string,target:string,relationship:string>>").alias("relationships"),  # edges aren't kept
        ).alias("impact"),
        F.struct(F.col("priority").alias("level"), F.lit(None).cast("int").alias("score"), F.array().cast("array<string>").alias("reasons")).alias("priority"), "review",
    )


def scan_details(scans: DataFrame, repositories: DataFrame) -> DataFrame:
    """A scan with its repository, statistics and engine versions."""
    named = repositories.select(F.col("id").alias("repository_id"), F.struct("provider", "owner", "name").alias("repository"))
    return scans.join(named, "repository_id").select(
        F.col("id").alias("scan_id"), "repository", "commit_sha", "status", "source_state",
        F.struct("file_count", "analyzed_file_count", "skipped_file_count", "finding_count").alias("statistics"),
        F.struct("parser_version", "ruleset_version", "pqc_ruleset_version").alias("engine"),
    )


def diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(fingerprint, change): NEW, RESOLVED or UNCHANGED between two scans.  An extension: the original has no such read."""
    a, b = before.select("fingerprint").distinct().withColumn("a", F.lit(1)), after.select("fingerprint").distinct().withColumn("b", F.lit(1))
    state = F.when(F.col("a").isNull(), "NEW").when(F.col("b").isNull(), "RESOLVED").otherwise("UNCHANGED")
    return a.join(b, "fingerprint", "full").select("fingerprint", state.alias("change"))
