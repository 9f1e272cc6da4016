"""What follows from a match: evidence, role, review path, impact, priority, identity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cipherscape.functions import vocab
from cipherscape.operators.resolve import FILE

MAX_EXCERPT_LINES = 40
SEPARATOR = "\x1f"

# The families of algorithms.
SIGNATURES = ["ECDSA", "ED25519", "ED448"]
AGREEMENTS = ["ECDH", "X25519", "X448", "DH", "DIFFIE-HELLMAN"]
CIPHERS = ["AES", "CHACHA20", "3DES", "DES", "CAMELLIA"]
POST_QUANTUM = ["ML-KEM", "ML-DSA", "SLH-DSA", "KYBER", "DILITHIUM", "FALCON", "SPHINCS+", "XMSS", "LMS"]
PUBLIC_KEY = ["RSA", "DSA", "ECDSA", "ECDH", "ED25519", "ED448", "EDDSA", "X25519", "X448", "DH", "DIFFIE-HELLMAN", "ECC", "ELGAMAL"]
SYMMETRIC = ["AES", "CHACHA20", "3DES", "DES", "BLOWFISH", "RC4", "ARC4"]
LEGACY_HASHES = ["SHA-1", "MD5", "MD4"]
HASHES = [
    "SHA-1", "SHA-224", "SHA-256", "SHA-384", "SHA-512", "SHA-3", "SHA3-224", "SHA3-256", "SHA3-384", "SHA3-512", "SHAKE128", "SHAKE256",
    "SM3", "MD5", "BLAKE2B", "BLAKE2S",
]


#: What Python's str.strip takes away.
SPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def stripped(text: Column) -> Column:
    """Without white space at the ends, as Python has it."""
    return F.btrim(text, F.lit(SPACE))


def excerpt(lines: Column, start: Column, end: Column) -> Column:
    """(text, truncated) of the lines start to end, at most MAX_EXCERPT_LINES; null when start is past the last line."""
    first = F.greatest(start, F.lit(1))
    last = F.least(F.greatest(end, first), F.size(lines))
    shown = F.least(last - first + 1, F.lit(MAX_EXCERPT_LINES))
    text = F.array_join(F.slice(lines, first, F.greatest(shown, F.lit(1))), "\n")
    return F.when(lines.isNotNull() & (first <= F.size(lines)), F.struct(text.alias("source_excerpt"), (last - first + 1 > MAX_EXCERPT_LINES).alias("truncated")))


def role(primitive: Column, algorithm: Column, operation: Column) -> Column:
    """The cryptographic role; the first rule that holds decides."""
    name, primitive = F.upper(stripped(algorithm)), F.upper(stripped(primitive))
    generated = F.when(name.isin(*SIGNATURES), "DIGITAL_SIGNATURE").when(name.isin(*AGREEMENTS), "KEY_ESTABLISHMENT").otherwise("UNKNOWN")
    return (
        F.when(primitive == "HASH", "HASH")
        .when(name.isin(*CIPHERS), "SYMMETRIC_ENCRYPTION")
        .when(operation.isin("SIGN", "VERIFY"), "DIGITAL_SIGNATURE")
        .when(operation == "KEY_ESTABLISHMENT", "KEY_ESTABLISHMENT")
        .when(operation.isin("ENCRYPT", "DECRYPT") & (name == "RSA"), "KEY_ESTABLISHMENT")
        .when(operation == "KEY_GENERATION", generated)
        .otherwise("UNKNOWN")
    )


def role_rationale(role: Column) -> Column:
    """A sentence on why a role was given."""
    return (
        F.when(role == "HASH", "The observed call computes a digest.")
        .when(role == "SYMMETRIC_ENCRYPTION", "The algorithm encrypts with a shared key.")
        .when(role == "DIGITAL_SIGNATURE", "The operation makes or checks signatures, or its key can do nothing else.")
        .when(role == "KEY_ESTABLISHMENT", "The operation agrees on, wraps or unwraps a key, or its key can do nothing else.")
        .otherwise("The observed facts do not settle what this is used for.")
    )


def review_path(role: Column, algorithm: Column) -> Column:
    """The post-quantum review a use needs."""
    name = F.upper(stripped(algorithm))
    return (
        F.when((role == "DIGITAL_SIGNATURE") & name.isin("RSA", "ECDSA", "ED25519", "ED448", "DSA"), "ML-DSA / SLH-DSA")
        .when((role == "KEY_ESTABLISHMENT") & name.isin("RSA", "ECDH", "X25519", "X448", "DH", "DIFFIE-HELLMAN"), "ML-KEM")
        .when((role == "SYMMETRIC_ENCRYPTION") & name.isin(*CIPHERS), "KEY / IMPLEMENTATION REVIEW")
        .when(role == "HASH", "HASH / POLICY REVIEW")
        .otherwise("MANUAL REVIEW")
    )


def review_rationale(path: Column) -> Column:
    """A sentence on why a review path was given."""
    return (
        F.when(path == "ML-DSA / SLH-DSA", "Its signatures rest on a problem that a quantum computer solves; look at a post-quantum signature scheme.")
        .when(path == "ML-KEM", "Its key establishment rests on a problem that a quantum computer solves; look at a post-quantum key encapsulation.")
        .when(path == "KEY / IMPLEMENTATION REVIEW", "A shared-key cipher stays usable; look at key lengths, modes and the implementation.")
        .when(path == "HASH / POLICY REVIEW", "A digest stays usable if it is long enough; look at the policy that asks for it.")
        .otherwise("The facts do not settle a path; a person must look.")
    )


def is_candidate(path: Column) -> Column:
    return path.isin("ML-DSA / SLH-DSA", "ML-KEM")


def impact_nodes(algorithm: Column, api: Column, fn: Column, cls: Column, module: Column, path: Column, confidence: Column) -> Column:
    """The chain from the algorithm outwards; what a match doesn't establish is absent."""

    def node(kind: str, label: Column, relationship: str | None) -> Column:
        there = F.struct(
            F.concat(F.lit(kind + ":"), label).alias("id"), F.lit(kind).alias("node_type"), label.alias("label"),
            F.lit(relationship).cast("string").alias("relationship"), confidence.alias("confidence"),
        )
        return F.when(label.isNotNull() & (label != ""), there)

    chain = F.array(
        node("ALGORITHM", algorithm, None), node("API", api, "USES"), node("FUNCTION", fn, "CALLS"), node("CLASS", cls, "CONTAINS"),
        node("MODULE", module, "CONTAINS"), node("FILE", path, "DEFINED_IN"),
    )
    return F.filter(chain, lambda n: n.isNotNull())


def impact_edges(nodes: Column) -> Column:
    """Each node points at the one before it, but the innermost before the file points at the file."""
    steps = F.when(F.size(nodes) > 1, F.sequence(F.lit(1), F.size(nodes) - 1)).otherwise(F.array().cast("array<int>"))

    def edge(k: Column) -> Column:
        near, far = F.get(nodes, k - 1), F.get(nodes, k)
        file = far["node_type"] == "FILE"
        return F.struct(
            F.when(file, near["id"]).otherwise(far["id"]).alias("source"), F.when(file, far["id"]).otherwise(near["id"]).alias("target"),
            far["relationship"].alias("relationship"), far["confidence"].alias("confidence"),
        )

    return F.array_distinct(F.transform(steps, edge))


def priority(confidence: Column, basis: Column, algorithm: Column, operation: Column, role: Column, node_count: Column) -> Column:
    """(level, score, reasons): points for confidence, family, operation in its role, and spread."""
    name = F.upper(stripped(algorithm))
    sure = F.when(confidence == "HIGH", 30).when(confidence == "MEDIUM", 15).when(confidence == "LOW", 5).otherwise(0)
    family = (
        F.when(name.isin(*PUBLIC_KEY), 40).when(name.isin(*LEGACY_HASHES), 25).when(name.isin(*HASHES), 15).when(name.isin(*SYMMETRIC), 15).otherwise(10)
    )
    spelled = (
        F.when(operation.isin("SIGN", "VERIFY", "KEY_GENERATION", "KEY_ESTABLISHMENT"), 30)
        .when(operation.isin("ENCRYPT", "DECRYPT"), 25)
        .when(operation.isin("CONSTRUCTION", "HASH"), 10)
        .otherwise(0)
    )
    raised = F.coalesce(role.isin("DIGITAL_SIGNATURE", "KEY_ESTABLISHMENT"), F.lit(False)) & (spelled < 30)
    broad = F.coalesce(node_count >= 5, F.lit(False))
    modern = name.isin(*POST_QUANTUM)
    score = F.when(modern, sure).otherwise(sure + family + F.when(raised, 30).otherwise(spelled) + F.when(broad, 10).otherwise(0))
    kind = (
        F.when(name.isin(*PUBLIC_KEY), " is a public-key algorithm that a quantum computer breaks.")
        .when(name.isin(*LEGACY_HASHES), " is a hash that is weak already.")
        .when(name.isin(*HASHES), " is a hash; its length matters.")
        .when(name.isin(*SYMMETRIC), " is symmetric; its key length matters.")
        .otherwise(" is in no known family.")
    )
    reasons = F.filter(
        F.array(
            F.concat(confidence, F.lit(" confidence by "), basis, F.lit(".")),
            F.concat(name, kind),
            F.when(raised, F.concat(operation, F.lit(" in the role "), role, F.lit("."))).when(spelled > 0, F.concat(operation, F.lit("."))),
            F.when(role != "UNKNOWN", F.concat(F.lit("Its role is "), role, F.lit("."))),
            F.when(broad, F.concat(F.lit("It reaches "), node_count.cast("string"), F.lit(" elements."))),
        ),
        lambda r: r.isNotNull(),
    )
    settled = F.array(F.concat(name, F.lit(" is post-quantum already.")), F.lit("Review how it is used; it need not be replaced."))
    level = F.when(modern, "LOW").when(score >= 80, "HIGH").when(score >= 40, "MEDIUM").otherwise("LOW")
    return F.struct(level.alias("level"), score.cast("int").alias("score"), F.when(modern, settled).otherwise(reasons).alias("reasons"))


def fingerprint(repository: Column, path: Column, rule: Column, algorithm: Column, api: Column, operation: Column, fn: Column, cls: Column) -> Column:
    """The identity of a finding across edits: SHA-256 of its labelled parts; a separator inside a part is an error."""
    parts = {
        "repository": F.lower(stripped(repository)), "file_path": stripped(path), "rule_id": stripped(rule), "algorithm": F.upper(stripped(algorithm)),
        "api": stripped(api), "operation": F.upper(stripped(operation)), "function": stripped(F.coalesce(fn, F.lit(""))), "class": stripped(F.coalesce(cls, F.lit(""))),
    }
    return hashed(*[F.concat(F.lit(f"{k}="), F.coalesce(v, F.lit(""))) for k, v in parts.items()])


def hashed(*parts: Column) -> Column:
    clean = [F.when(F.contains(p, F.lit(SEPARATOR)), F.raise_error(F.lit("a part holds the unit separator")).cast("string")).otherwise(p) for p in parts]
    return F.sha2(F.concat_ws(SEPARATOR, *clean), 256)


def scan_identity(provider: Column, owner: Column, name: Column, commit: Column, parser: Column, ruleset: Column, pqc: Column) -> Column:
    """The digest of all that a scan's result depends on; the first four ignore case."""
    return hashed(*[F.lower(stripped(c)) for c in (provider, owner, name, commit)], *[stripped(c) for c in (parser, ruleset, pqc)])


def findings(found: DataFrame, parsed: DataFrame, repository: Column) -> DataFrame:
    """Matches with all that is derived; a match whose source can't be shown is dropped."""
    return derived(shown(found, parsed), repository)


def shown(found: DataFrame, parsed: DataFrame) -> DataFrame:
    """Matches with their source and what follows from it and the match alone, whatever file they lie in."""
    lines = parsed.filter("error is null").select(*FILE, "lines")
    rows = found.join(lines, FILE).withColumn("e", excerpt(F.col("lines"), F.col("loc.start_line"), F.col("loc.end_line"))).drop("lines").filter("e is not null")
    rows = rows.select(*[c for c in rows.columns if c not in ("loc", "e")], "loc.*", "e.*")
    rows = rows.withColumn("role", role(F.col("primitive"), F.col("algorithm"), F.col("operation"))).withColumn("role_rationale", role_rationale(F.col("role")))
    return rows.withColumn("review_path", review_path(F.col("role"), F.col("algorithm"))).withColumn("is_migration_candidate", is_candidate(F.col("review_path")))


def derived(rows: DataFrame, repository: Column) -> DataFrame:
    """Shown matches with what follows from their file too: impact, priority, identity."""
    rows = rows.withColumn("repository", repository)
    rows = rows.withColumn(
        "impact_nodes", impact_nodes(*[F.col(c) for c in ("algorithm", "api", "enclosing_function", "enclosing_class", "module_path", "path", "confidence")])
    )
    rows = rows.withColumn("impact_edges", impact_edges(F.col("impact_nodes"))).withColumn("node_count", F.size("impact_nodes"))
    rows = rows.withColumn("p", priority(*[F.col(c) for c in ("confidence", "evidence_basis", "algorithm", "operation", "role", "node_count")]))
    names = ("repository", "path", "rule_id", "algorithm", "api", "operation", "enclosing_function", "enclosing_class")
    rows = rows.withColumn("fingerprint", fingerprint(*[F.col(c) for c in names]))
    return rows.select(
        "*", F.col("p.level").alias("priority"), F.col("p.score").alias("priority_score"), F.col("p.reasons").alias("priority_reasons"),
        F.lit(vocab.PARSER_VERSION).alias("parser_version"), F.lit(vocab.PQC_VERSION).alias("pqc_ruleset_version"),
    ).drop("p")


def first_per_fingerprint(rows: DataFrame, order: list[str | Column], scan: str = "snapshot_id") -> DataFrame:
    """Of findings with one identity in a scan, the first in order."""
    place = Window.partitionBy(scan, "fingerprint").orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(place)).filter("_n = 1").drop("_n")


def observation_counts(rows: DataFrame, scan: str = "snapshot_id") -> DataFrame:
    """(scan, observations, unique_findings, duplicates)."""
    each = rows.groupBy(scan, "fingerprint").agg(F.count("*").alias("n"))
    found = each.groupBy(scan).agg(F.sum("n").alias("observations"), F.count("*").alias("unique_findings"))
    return found.withColumn("duplicates", F.col("observations") - F.col("unique_findings"))
