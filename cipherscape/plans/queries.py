"""The registered queries of the inventory and the SQL that checks them.

Two honest inputs stand in for source repositories, which the test tables don't
hold: the templated corpus (a snippet for each row of ``part``, with observations
written by hand) and synthetic observations, jobs, reviews and scans laid out over
the keys of ``lineitem``, ``events``, ``orders`` and ``customer``.  The SQL repeats a
query's meaning in its own words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from cipherscape.functions import vocab
from cipherscape.operators import copies, derive, discovery, lifecycle, parse, persist, resolve, rules
from cipherscape.plans import read
from cipherscape.sources import files as sources
from cipherscape.sources import stores, templates
from cipherscape.streaming import jobs as job_stream
from cipherscape.streaming import replay

REPOSITORY = "github/Example/Repo"
N = len(templates.TEMPLATES)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- the templated corpus ------------------------------------------------------------


#: Rows of observations that a task derives and sorts, and source files that one parses.
EACH, EACH_FILES = 1_000_000, 20_000


def _pieces(rows: DataFrame, each: int) -> int:
    """In how many pieces a table is worked on: as many as there are cores, and more as it grows, so that no task does."""
    return max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // each))


def _dealt(rows: DataFrame, each: int) -> DataFrame:
    """Rows dealt out anew where their table lies in fewer pieces, as the work on each row is what costs here."""
    pieces = _pieces(rows, each)
    return rows.repartition(pieces, *rows.columns) if rows.rdd.getNumPartitions() < pieces else rows


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.corpus(_dealt(_table(spark, sf_dir, "part").select("p_partkey"), EACH_FILES), "p_partkey")


def _parsed(spark: SparkSession, sf_dir: str, *wanted: str) -> DataFrame:
    """Every file parsed and written once, in buckets by file, the more the more files there are."""
    return _parsed_once(spark, sf_dir, discovery.supported(_files(spark, sf_dir)), "parsed", wanted or _RELATIONS, False, _pieces(_table(spark, sf_dir, "part"), EACH_FILES))


#: What the rules read of a file.
_RELATIONS = ("imports", "symbols", "calls", "names", "assignments", "annotations")


def _parsed_once(spark: SparkSession, sf_dir: str, files: DataFrame, name: str, wanted: tuple[str, ...], lines: bool, pieces: int) -> DataFrame:
    """Files made of ``part``, parsed and written in buckets, as several joins read them."""
    rows = lambda: parse.parse_files(files, wanted, lines)
    return persist.written_once(spark, rows, sf_dir, name, *wanted, str(lines), inputs=(f"{sf_dir}/part.parquet",), buckets=("snapshot_id", "path"), count=pieces)


def _contents(spark: SparkSession, sf_dir: str, files: DataFrame, name: str = "corpus") -> DataFrame:
    """Each content of files made of ``part`` parsed, in buckets, the more the more contents there are."""
    apart = persist.written_once(spark, lambda: copies.contents(files), sf_dir, name, "contents", inputs=(f"{sf_dir}/part.parquet",))
    return _parsed_once(spark, sf_dir, _dealt(apart, EACH_FILES), name, _RELATIONS, True, _pieces(apart, EACH_FILES))


def _corpus(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The supported files, and their contents parsed."""
    files = discovery.supported(_files(spark, sf_dir))
    return files, _contents(spark, sf_dir, files)


_PATH = "'pkg' || (p_partkey % 7) || '/mod_' || p_partkey || '.py'"
_EXPECTED = f"SELECT {_PATH} AS path, 'pkg' || (p_partkey % 7) || '.mod_' || p_partkey AS module, e.* FROM part JOIN {templates.expected_sql()} ON p_partkey % {N} = e.template"


def _matches(rule: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        files, parsed = _corpus(spark, sf_dir)
        found = copies.shared_out(rules.REGISTRY[rule](rules.Context(parsed)), files)
        return found.select(
            "path", F.col("loc.start_line").cast("long").alias("line"), "algorithm", "api", "operation", "confidence", "evidence_basis",
            F.col("enclosing_function").alias("fn"), F.col("enclosing_class").alias("cls"),
        )

    return query


def _hash_calls(calls: list[Row]) -> Iterator[tuple]:
    """The hash rule in Python."""
    known = {r[0]: r[2:] for r in vocab.direct_rows() if r[1] == vocab.HASH}
    for call in calls:
        if call.resolved in known:
            algorithm, api, operation, basis = known[call.resolved]
            yield call.call, algorithm, api, operation, "HIGH", basis


def rule_in_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, parsed = _corpus(spark, sf_dir)
    found = copies.shared_out(rules.in_code(vocab.HASH, _hash_calls)(rules.Context(parsed)), files)
    return found.select(
        "path", F.col("loc.start_line").cast("long").alias("line"), "algorithm", "primitive", "api", "operation", "confidence", "evidence_basis",
        F.col("enclosing_function").alias("fn"), F.col("enclosing_class").alias("cls"),
    )


def _matches_sql(rule: str) -> str:
    return f"SELECT path, CAST(line AS BIGINT) AS line, algorithm, api, operation, confidence, evidence_basis, fn, cls FROM ({_EXPECTED}) WHERE rule_id = '{rule}'"


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of all files; what is shown of each content is written first, so the files are joined with a table of known size."""
    files, parsed = _corpus(spark, sf_dir)
    shown = persist.written_once(spark, lambda: derive.shown(rules.matches(parsed), parsed), sf_dir, "shown", inputs=(f"{sf_dir}/part.parquet",))
    return derive.derived(copies.shared_out(shown, files), F.lit(REPOSITORY))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings by algorithm, role and review path."""
    return _findings(spark, sf_dir).groupBy("algorithm", "role", "review_path").agg(F.count("*").alias("n"))


def all_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _findings(spark, sf_dir).select(
        "path", "rule_id", F.col("start_line").cast("long").alias("line"), "api", "role", "review_path", "is_migration_candidate", "fingerprint", "priority",
        F.col("priority_score").cast("long").alias("priority_score"), F.col("node_count").cast("long").alias("node_count"),
    )


_ROLE = """CASE WHEN {p} = 'HASH' THEN 'HASH' WHEN upper(trim({a})) IN ('AES','CHACHA20','3DES','DES','CAMELLIA') THEN 'SYMMETRIC_ENCRYPTION'
 WHEN {o} IN ('SIGN','VERIFY') THEN 'DIGITAL_SIGNATURE' WHEN {o} = 'KEY_ESTABLISHMENT' THEN 'KEY_ESTABLISHMENT'
 WHEN {o} IN ('ENCRYPT','DECRYPT') AND upper(trim({a})) = 'RSA' THEN 'KEY_ESTABLISHMENT'
 WHEN {o} = 'KEY_GENERATION' AND upper(trim({a})) IN ('ECDSA','ED25519','ED448') THEN 'DIGITAL_SIGNATURE'
 WHEN {o} = 'KEY_GENERATION' AND upper(trim({a})) IN ('ECDH','X25519','X448','DH','DIFFIE-HELLMAN') THEN 'KEY_ESTABLISHMENT' ELSE 'UNKNOWN' END"""
_PQC = """CASE WHEN role = 'DIGITAL_SIGNATURE' AND upper(trim(algorithm)) IN ('RSA','ECDSA','ED25519','ED448','DSA') THEN 'ML-DSA / SLH-DSA'
 WHEN role = 'KEY_ESTABLISHMENT' AND upper(trim(algorithm)) IN ('RSA','ECDH','X25519','X448','DH','DIFFIE-HELLMAN') THEN 'ML-KEM'
 WHEN role = 'SYMMETRIC_ENCRYPTION' AND upper(trim(algorithm)) IN ('AES','CHACHA20','3DES','DES','CAMELLIA') THEN 'KEY / IMPLEMENTATION REVIEW'
 WHEN role = 'HASH' THEN 'HASH / POLICY REVIEW' ELSE 'MANUAL REVIEW' END"""
_SCORE = """(CASE WHEN upper(trim(algorithm)) IN ('ML-KEM','ML-DSA','SLH-DSA','KYBER','DILITHIUM','FALCON','SPHINCS+','XMSS','LMS') THEN
   (CASE confidence WHEN 'HIGH' THEN 30 WHEN 'MEDIUM' THEN 15 WHEN 'LOW' THEN 5 ELSE 0 END)
  ELSE (CASE confidence WHEN 'HIGH' THEN 30 WHEN 'MEDIUM' THEN 15 WHEN 'LOW' THEN 5 ELSE 0 END)
  + (CASE WHEN upper(trim(algorithm)) IN ('RSA','DSA','ECDSA','ECDH','ED25519','ED448','EDDSA','X25519','X448','DH','DIFFIE-HELLMAN','ECC','ELGAMAL') THEN 40
     WHEN upper(trim(algorithm)) IN ('SHA-1','MD5','MD4') THEN 25
     WHEN upper(trim(algorithm)) IN ('SHA-224','SHA-256','SHA-384','SHA-512','SHA-3','SHA3-224','SHA3-256','SHA3-384','SHA3-512','SHAKE128','SHAKE256','SM3','BLAKE2B','BLAKE2S') THEN 15
     WHEN upper(trim(algorithm)) IN ('AES','CHACHA20','3DES','DES','BLOWFISH','RC4','ARC4') THEN 15 ELSE 10 END)
  + greatest(CASE WHEN operation IN ('SIGN','VERIFY','KEY_GENERATION','KEY_ESTABLISHMENT') THEN 30 WHEN operation IN ('ENCRYPT','DECRYPT') THEN 25
     WHEN operation IN ('CONSTRUCTION','HASH') THEN 10 ELSE 0 END, CASE WHEN role IN ('DIGITAL_SIGNATURE','KEY_ESTABLISHMENT') THEN 30 ELSE 0 END)
  + (CASE WHEN node_count >= 5 THEN 10 ELSE 0 END) END)"""
_MODERN = "upper(trim(algorithm)) IN ('ML-KEM','ML-DSA','SLH-DSA','KYBER','DILITHIUM','FALCON','SPHINCS+','XMSS','LMS')"
_BAND = f"CASE WHEN {_MODERN} THEN 'LOW' WHEN priority_score >= 80 THEN 'HIGH' WHEN priority_score >= 40 THEN 'MEDIUM' ELSE 'LOW' END"


def _fingerprint_sql(path: str, fn: str, cls: str) -> str:
    parts = (
        "'repository=' || lower('github/Example/Repo')", f"'file_path=' || {path}", "'rule_id=' || rule_id", "'algorithm=' || upper(algorithm)", "'api=' || api",
        "'operation=' || upper(operation)", f"'function=' || coalesce({fn}, '')", f"'class=' || coalesce({cls}, '')",
    )
    return f"sha256(concat_ws(chr(31), {', '.join(parts)}))"


_DERIVED = f"""WITH m AS ({_EXPECTED}), r AS (SELECT *, {_ROLE.format(p="CASE WHEN rule_id = 'PY-CRYPTO-HASH' THEN 'HASH' ELSE algorithm END", a="algorithm", o="operation")} AS role,
 4 + (CASE WHEN fn IS NULL THEN 0 ELSE 1 END) + (CASE WHEN cls IS NULL THEN 0 ELSE 1 END) AS node_count FROM m),
 q AS (SELECT *, {_PQC} AS review_path, {_SCORE} AS priority_score FROM r)"""


def parse_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _files(spark, sf_dir)
    return parse.parse_summary(_parsed(spark, sf_dir, "imports"), discovery.classify(files))


def parse_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = lambda c: F.size(c).cast("long").alias(c)
    return _parsed(spark, sf_dir).select("path", "module_path", F.col("error.error_type").alias("error_type"), size("imports"), size("symbols"), size("calls"))


def import_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.import_index(_parsed(spark, sf_dir, "imports")).select("path", "local_name", "qualified_name")


_IMPORTS = [
    # written by hand: template, local name, what it refers to
    ("rsa_forms", "cryptography", "cryptography"), ("rsa_forms", "r", "asymmetric.rsa"), ("rsa_forms", "rsa", "asymmetric.rsa"), ("rsa_forms", "gen", "asymmetric.rsa.generate_private_key"),
    ("rsa_annotated", "rsa", "asymmetric.rsa"), ("rsa_annotated", "RSAPrivateKey", "asymmetric.rsa.RSAPrivateKey"), ("rsa_annotated", "Pub", "asymmetric.rsa.RSAPublicKey"),
    ("rsa_constructed", "rsa", "asymmetric.rsa"), ("rsa_alias_order", "RSAPrivateKey", "asymmetric.rsa.RSAPrivateKey"), ("rsa_erased", "rsa", "asymmetric.rsa"),
    ("rsa_scopes", "rsa", "asymmetric.rsa"), ("rsa_class_call", "RSAPrivateKey", "asymmetric.rsa.RSAPrivateKey"), ("rsa_class_call", "RSAPublicKey", "asymmetric.rsa.RSAPublicKey"),
    ("ed25519", "Ed25519PrivateKey", "asymmetric.ed25519.Ed25519PrivateKey"), ("ed25519", "Ed25519PublicKey", "asymmetric.ed25519.Ed25519PublicKey"), ("x25519", "x25519", "asymmetric.x25519"),
    ("ecdsa", "hashes", "hashes"), ("ecdsa", "ec", "asymmetric.ec"), ("ecdsa", "curves", "asymmetric.ec"), ("ecdh", "ec", "asymmetric.ec"),
    ("aes", "Cipher", "ciphers.Cipher"), ("aes", "algorithms", "ciphers.algorithms"), ("aes", "modes", "ciphers.modes"), ("aes", "AESGCM", "ciphers.aead.AESGCM"),
    ("hashes", "hashes", "hashes"), ("hashes", "B", "hashes.BLAKE2b"), ("hashes", "Hash", "hashes.Hash"), ("repeated", "hashes", "hashes"),
]


def _values(rows: list[tuple], columns: str) -> str:
    quote = lambda v: "NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return "(VALUES " + ", ".join("(" + ", ".join(map(quote, r)) + ")" for r in rows) + f") AS v({columns})"


_PLACE = {t.name: k for k, t in enumerate(templates.TEMPLATES)}
_SHAPES = _values([(k, *(t.shape or (0, 0, 0)), None if t.shape else "SYNTAX_ERROR") for k, t in enumerate(templates.TEMPLATES)], "template, imports, symbols, calls, error_type")
_INDEX = _values([(_PLACE[t], n, q if q == "cryptography" else vocab.ROOT + q) for t, n, q in _IMPORTS], "template, local_name, qualified_name")


def bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What names provably hold, after annotations, constructors, derivations and aliases."""
    files, parsed = _corpus(spark, sf_dir)
    return copies.shared_out(rules.Context(parsed).bindings, files).select("path", "rule_id", "scope", "name", "kind", "basis", "confidence")


_BINDINGS = [
    # written by hand: template, rule, scope, name, kind, basis, confidence
    ("rsa_forms", "RSA", "", "a", "PRIVATE", "CONSTRUCTOR_ASSIGNMENT", "MEDIUM"), ("rsa_forms", "RSA", "", "b", "PRIVATE", "CONSTRUCTOR_ASSIGNMENT", "MEDIUM"),
    ("rsa_forms", "RSA", "", "c", "PRIVATE", "CONSTRUCTOR_ASSIGNMENT", "MEDIUM"), ("rsa_forms", "RSA", "", "d", "PRIVATE", "CONSTRUCTOR_ASSIGNMENT", "MEDIUM"),
    ("rsa_annotated", "RSA", "f", "k", "PRIVATE", "CLASS_ANNOTATION", "HIGH"), ("rsa_annotated", "RSA", "f", "p", "PUBLIC", "CLASS_ANNOTATION", "HIGH"),
    ("rsa_annotated", "RSA", "g", "k", "PRIVATE", "CLASS_ANNOTATION", "HIGH"), ("rsa_constructed", "RSA", "f", "k", "PRIVATE", "CONSTRUCTOR_ASSIGNMENT", "MEDIUM"),
    ("rsa_constructed", "RSA", "f", "p", "PUBLIC", "CONSTRUCTOR_ASSIGNMENT", "MEDIUM"), ("rsa_constructed", "RSA", "f", "q", "PRIVATE", "ESTABLISHED_ALIAS", "MEDIUM"),
    ("rsa_alias_order", "RSA", "alias", "k", "PRIVATE", "CLASS_ANNOTATION", "HIGH"), ("rsa_alias_order", "RSA", "alias", "a", "PRIVATE", "ESTABLISHED_ALIAS", "MEDIUM"),
    ("rsa_alias_order", "RSA", "alias_then_unknown", "k", "PRIVATE", "CLASS_ANNOTATION", "HIGH"), ("rsa_alias_order", "RSA", "unknown_then_alias", "k", "PRIVATE", "CLASS_ANNOTATION", "HIGH"),
    ("rsa_alias_order", "RSA", "unknown_then_alias", "a", "PRIVATE", "ESTABLISHED_ALIAS", "MEDIUM"), ("rsa_alias_order", "RSA", "two_hops", "k", "PRIVATE", "CLASS_ANNOTATION", "HIGH"),
    ("rsa_alias_order", "RSA", "two_hops", "b", "PRIVATE", "ESTABLISHED_ALIAS", "MEDIUM"), ("rsa_scopes", "RSA", "", "KEY", "PRIVATE", "CONSTRUCTOR_ASSIGNMENT", "MEDIUM"),
    ("rsa_scopes", "RSA", "outer", "k", "PRIVATE", "CONSTRUCTOR_ASSIGNMENT", "MEDIUM"), ("ed25519", "ED25519", "f", "k", "PRIVATE", "CONSTRUCTOR_ASSIGNMENT", "MEDIUM"),
    ("ed25519", "ED25519", "f", "v", "PUBLIC", "CONSTRUCTOR_ASSIGNMENT", "MEDIUM"), ("ed25519", "ED25519", "f", "w", "PRIVATE", "CONSTRUCTOR_ASSIGNMENT", "MEDIUM"),
    ("x25519", "X25519", "f", "k", "PRIVATE", "CLASS_ANNOTATION", "HIGH"), ("x25519", "X25519", "f", "p", "PUBLIC", "CLASS_ANNOTATION", "HIGH"),
    ("x25519", "X25519", "f", "n", "PRIVATE", "CONSTRUCTOR_ASSIGNMENT", "MEDIUM"),
]
_BOUND = _values([(_PLACE[b[0]], "PY-CRYPTO-" + b[1], *b[2:]) for b in _BINDINGS], "template, rule_id, scope, name, kind, basis, confidence")


def evidence_excerpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The source shown for hash observations."""
    files, parsed = _corpus(spark, sf_dir)
    found = copies.shared_out(derive.shown(rules.hash_rule(rules.Context(parsed)), parsed), files)
    return found.select("path", F.col("start_line").cast("long").alias("line"), "api", "source_excerpt", "truncated")


_CALLED = [("asymmetric import rsa", "rsa.generate_private_key"), ("import hashes", "hashes.SHA256"), ("ciphers.algorithms import AES", "AES"), ("asymmetric import x25519", "x25519.X25519PrivateKey.generate")]


def excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is shown of calls of four rules that reach over 1 to 60 lines, at most 40 of them, over the keys of ``part``."""
    key, kind = F.col("p_partkey"), (F.col("p_partkey") % len(_CALLED) + 1).cast("int")
    pick = lambda place: F.element_at(F.array(*[F.lit(c[place]) for c in _CALLED]), kind)
    many = lambda text, n: F.array_join(F.transform(F.sequence(F.lit(0), n.cast("int")), lambda k: F.when(k > 0, F.lit(text)).otherwise("")), "")
    text = F.concat(F.lit(templates.P + "."), pick(0), F.lit("\n"), many("x = 1\n", key % 6), F.lit("k = "), pick(1), F.lit("("), many("\n    1,", key % 60), F.lit(")\ny = 2\n"))
    text = F.regexp_replace(text, r"primitives\.import", "primitives import")
    columns = F.lit("s").alias("snapshot_id"), F.concat(F.lit("x"), key.cast("string"), F.lit(".py")).alias("path"), F.encode(text, "utf-8").alias("content")
    files = _dealt(_table(spark, sf_dir, "part").select("p_partkey"), EACH_FILES).select(*columns)
    parsed = _contents(spark, sf_dir, files, "excerpts")
    found = copies.shared_out(derive.shown(rules.matches(parsed), parsed), files)
    return found.select("path", "rule_id", F.col("start_line").cast("long").alias("line"), F.col("end_line").cast("long").alias("end_line"), "source_excerpt", "truncated")


# -- sources --------------------------------------------------------------------------

_FILES = """SELECT 'a' || (k // 50) AS snapshot_id, CASE k % 6 WHEN 0 THEN 'pkg/__init__' || k || '.py' WHEN 1 THEN '_p/.hidden' || k || '.py' WHEN 2 THEN '.git/c' || k WHEN 3 THEN 'sp ace/ü%20#' || k || '.py'
 WHEN 4 THEN 'd' || (k % 7) || '/_' || k || '.md' ELSE 'm' || k || '.py' END AS path, text FROM (SELECT p_partkey // 8 AS k, string_agg('# ' || p_name || ' = ' || p_partkey, chr(10) ORDER BY p_partkey) AS text FROM part GROUP BY 1)"""


def _source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each eight rows of ``part``."""
    line = F.concat(F.lit("# "), "p_name", F.lit(" = "), F.col("p_partkey").cast("string"))
    rows = _table(spark, sf_dir, "part").groupBy(F.floor(F.col("p_partkey") / 8).alias("k")).agg(F.array_sort(F.collect_list(F.struct("p_partkey", line.alias("line")))).alias("l"))
    rows = rows.select("k", F.array_join("l.line", "\n").alias("text")).withColumn("n", F.col("k").cast("string"))
    names = {0: ("pkg/__init__", ".py"), 1: ("_p/.hidden", ".py"), 2: (".git/c", ""), 3: ("sp ace/ü%20#", ".py"), 5: ("m", ".py")}
    path = F.concat(F.lit("d"), (F.col("k") % 7).cast("string"), F.lit("/_"), "n", F.lit(".md"))
    for place, (before, after) in names.items():
        path = F.when(F.col("k") % 6 == place, F.concat(F.lit(before), "n", F.lit(after))).otherwise(path)
    return rows.select(F.concat(F.lit("a"), F.floor(F.col("k") / 50).cast("string")).alias("snapshot_id"), path.alias("path"), F.encode("text", "utf-8").alias("content"))


def _shown_files(rows: DataFrame) -> DataFrame:
    return rows.select("path", "size", F.sha2("content", 256).alias("sha256"))


def tree_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree of files, written and read back."""
    root = persist.own_folder(spark)
    pieces = _pieces(_table(spark, sf_dir, "part"), 8 * EACH_FILES)  # a file for each eight rows
    stores.write_tree(_source_files(spark, sf_dir).repartition(pieces, "path"), root)
    return _shown_files(stores.tree(spark, root, max_files=1 << 30))


def zip_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives of 50 files each, written and read back by ranges."""
    root = persist.own_folder(spark)
    stores.write_archives(_source_files(spark, sf_dir), root)
    sources.register(spark)
    return _shown_files(spark.read.format("source_zip").load(root))


def zip_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same through Spark's own reader, members dealt out."""
    root = persist.own_folder(spark)
    stores.write_archives(_source_files(spark, sf_dir), root)
    return _shown_files(stores.archives(spark, root))


_SHOWN_FILES = f"SELECT path, CAST(octet_length(encode(text)) AS BIGINT) AS size, sha256(text) AS sha256 FROM ({_FILES})"


#: Sources of each kind that parsing can meet: content, error, its line, attributes, and the constants of the calls.
_KINDS = [
    (b"x = 1\n", None, None, 0, None),
    (b"\xff\xfe", "READ_ERROR", None, 0, None),
    (b"a = 2\ndef f(:\n", "SYNTAX_ERROR", 2, 0, None),
    (b"y = " + b"-" * 12_000 + b"1\n", "SOURCE_TOO_COMPLEX", None, 0, None),
    (b"import a\na.b.c(1, 'two', k=None)\nd.e = a.g\n", None, None, 4, "int 1,str two,NoneType None"),
    (b"f('" + b"z" * 300 + b"', b'q', 2.5, True)\r\ndel h.i\n", None, None, 1, "-,bytes b'q',float 2.5,bool True"),
]


def parse_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every kind of error that parsing reports, attributes, and constants of arguments, over the keys of ``part``."""
    content = F.element_at(F.array(*[F.lit(k[0]) for k in _KINDS]), (F.col("p_partkey") % len(_KINDS) + 1).cast("int"))
    rows = _dealt(_table(spark, sf_dir, "part").select("p_partkey"), EACH_FILES).select(F.lit("s").alias("snapshot_id"), F.concat(F.lit("k"), F.col("p_partkey").cast("string"), F.lit(".py")).alias("path"), content.alias("content"))
    shown = F.transform(F.flatten("calls.args"), lambda a: F.coalesce(F.concat_ws(" ", a["constant"]["type"], a["constant"]["value"]), F.lit("")))
    constants = F.array_join(F.transform(shown, lambda c: F.when(c == "", "-").otherwise(c)), ",")
    parsed = parse.parse_files(rows, ("attributes", "calls"), False)
    return parsed.select("path", F.col("error.error_type").alias("error_type"), F.col("error.line").cast("long").alias("line"), F.size("attributes").cast("long").alias("attributes"), F.when(F.size("calls") > 0, constants).alias("constants"))


# -- discovery ------------------------------------------------------------------------

_TREE = """SELECT p_partkey, CASE p_partkey % 9 WHEN 0 THEN 'src/a' WHEN 1 THEN '.git/hooks' WHEN 2 THEN 'a-b' WHEN 3 THEN 'a' ELSE 'lib/_x' END || '/f' || p_partkey
 || (CASE p_partkey % 5 WHEN 0 THEN '.md' WHEN 1 THEN '.PY' ELSE '.py' END) AS path,
 CASE p_partkey % 4 WHEN 0 THEN 'x = 1' WHEN 1 THEN 'nul' ELSE p_name END AS text, CASE WHEN p_partkey % 6 = 0 THEN 5242881 WHEN p_partkey % 6 = 1 THEN 5242880 ELSE 10 END AS size FROM part"""


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    _table(spark, sf_dir, "part").createOrReplaceTempView("part")
    rows = spark.sql(_TREE)
    content = F.when(F.col("p_partkey") % 4 == 1, F.concat(F.encode("text", "utf-8"), F.lit(b"\x00"))).when(F.col("p_partkey") % 28 == 2, F.lit(b"\xff\xfe")).otherwise(F.encode("text", "utf-8"))
    return rows.select(F.lit("s").alias("snapshot_id"), "path", F.col("size").cast("long").alias("size"), content.alias("content"))


_SKIP = """CASE WHEN path LIKE '.git/%' THEN 'IGNORED_PATH' WHEN path NOT LIKE '%.py' THEN 'UNSUPPORTED_LANGUAGE' WHEN size > 5242880 THEN 'TOO_LARGE'
 WHEN p_partkey % 4 = 1 THEN 'BINARY_FILE' WHEN p_partkey % 28 = 2 THEN 'INVALID_ENCODING' END"""


def discover_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discovery.classify(_tree(spark, sf_dir)).drop("snapshot_id")


def skip_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discovery.summary(discovery.classify(_tree(spark, sf_dir))).select("total_files", "analyzed_files", "skipped_files", F.explode("skipped_reasons").alias("skip_reason", "n"))


def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "part").select(
        (F.col("p_partkey") % 5).cast("string").alias("snapshot_id"), F.concat(F.lit("d/"), F.col("p_partkey").cast("string"), F.lit(".py")).alias("path"), F.encode("p_name", "utf-8").alias("content")
    )
    return discovery.content_hash(rows)


_URLS = """SELECT c_custkey, CASE c_custkey % 8 WHEN 0 THEN 'https://github.com/own' || c_custkey || '/re.po' WHEN 1 THEN ' https://github.com/a-b/c_d.git ' WHEN 2 THEN 'http://github.com/a/b'
 WHEN 3 THEN 'https://github.com/a' WHEN 4 THEN 'https://user@github.com/a/b' WHEN 5 THEN 'https://github.com/a/b?x=1' WHEN 6 THEN 'https://github.com/a/b/c' ELSE 'https://github.com/O' || c_custkey || '/R/' END AS url,
 CASE c_custkey % 5 WHEN 0 THEN ' ABCDEF0123 ' WHEN 1 THEN 'abcdef' WHEN 2 THEN '0123456789abcdef0123456789abcdef01234567' WHEN 3 THEN 'xyz1234' ELSE 'abc' || (c_custkey % 10) || 'def0' END AS ref FROM customer"""


def _refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    _table(spark, sf_dir, "customer").createOrReplaceTempView("customer")
    return spark.sql(_URLS)


def repo_url_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _refs(spark, sf_dir).withColumn("r", discovery.repository_columns(F.col("url"))).select("c_custkey", "r.owner", "r.name", "r.canonical_url")


_COMMITS = "SELECT o_custkey % 7 AS repo, sha1('c' || (o_orderkey % 4000)) AS sha FROM orders UNION SELECT 3, 'abc1def0' || CAST(100000000000 + o_orderkey AS VARCHAR) || repeat('0', 20) FROM orders WHERE o_orderkey < 20"
_SHORT = """SELECT c_custkey, c_custkey % 7 AS repo, CASE c_custkey % 6 WHEN 0 THEN ' ' || upper(substr(sha1('c' || (c_custkey % 5000)), 1, 9)) WHEN 1 THEN substr(sha1('c' || (c_custkey % 5000)), 1, 7) WHEN 2 THEN sha1('z' || c_custkey)
 WHEN 3 THEN 'abc1def' WHEN 4 THEN 'nonsense' ELSE substr(sha1('c' || (c_custkey % 5000)), 1, 20) END AS ref FROM customer"""


def short_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short commit references resolved against the commits of their repository."""
    for name in ("customer", "orders"):
        _table(spark, sf_dir, name).createOrReplaceTempView(name)
    refs, commits = (spark.sql(q.replace("VARCHAR", "STRING")) for q in (_SHORT, _COMMITS))
    return discovery.resolved(refs, commits, "repo").select("c_custkey", "sha", "problem")


def sha_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _refs(spark, sf_dir).withColumn("sha", discovery.commit_sha(F.col("ref")))
    full = F.lit("abcdef0123" + "0" * 30)
    return found.select("c_custkey", "sha", F.coalesce(discovery.is_full_sha(F.col("sha")), F.lit(False)).alias("is_full"), F.coalesce(discovery.extends(full, F.col("ref")), F.lit(False)).alias("matches"))


# -- synthetic observations ------------------------------------------------------------

_OBSERVED = """SELECT CAST(l_orderkey AS BIGINT) AS k, CAST(l_linenumber AS BIGINT) AS ln, 'scan' || (l_orderkey % 4) AS scan_id,
 CASE (l_orderkey + l_linenumber) % 11 WHEN 0 THEN 'RSA' WHEN 1 THEN 'ECDSA' WHEN 2 THEN 'Ed25519' WHEN 3 THEN 'X25519' WHEN 4 THEN 'ECDH' WHEN 5 THEN 'AES' WHEN 6 THEN 'SHA-256'
  WHEN 7 THEN 'SHA-1' WHEN 8 THEN 'BLAKE2b' WHEN 9 THEN 'ML-KEM' ELSE 'FOO' END AS algorithm,
 CASE WHEN (l_orderkey + l_linenumber) % 11 IN (6, 7, 8) THEN 'HASH' ELSE 'KEYED' END AS primitive,
 CASE l_partkey % 8 WHEN 0 THEN 'SIGN' WHEN 1 THEN 'VERIFY' WHEN 2 THEN 'KEY_GENERATION' WHEN 3 THEN 'KEY_ESTABLISHMENT' WHEN 4 THEN 'ENCRYPT' WHEN 5 THEN 'DECRYPT' WHEN 6 THEN 'CONSTRUCTION' ELSE 'HASH' END AS operation,
 CASE l_suppkey % 4 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' WHEN 2 THEN 'LOW' ELSE 'UNKNOWN' END AS confidence,
 CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE 'f' || (l_partkey % 5) END AS fn, CASE WHEN l_suppkey % 2 = 0 THEN NULL ELSE 'C' || (l_suppkey % 3) END AS cls,
 CASE WHEN l_orderkey % 5 = 0 THEN NULL ELSE 'pkg.m' || (l_partkey % 20) END AS module, 'pkg/m' || (l_partkey % 20) || '.py' AS path, 'api' || (l_partkey % 8) AS api,
 'R' || ((l_orderkey + l_linenumber) % 11) AS rule_id, CAST(l_linenumber * 10 + l_partkey % 7 AS BIGINT) AS start_line FROM lineitem"""


_OBSERVED_OF = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def _observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    _dealt(_table(spark, sf_dir, "lineitem").select(*_OBSERVED_OF), EACH).createOrReplaceTempView("lineitem")
    return spark.sql(_OBSERVED.replace(" FROM lineitem", ", l_partkey, l_suppkey FROM lineitem"))


def _with_role(rows: DataFrame) -> DataFrame:
    return rows.withColumn("role", derive.role(F.col("primitive"), F.col("algorithm"), F.col("operation")))


def _nodes(rows: DataFrame) -> DataFrame:
    return rows.withColumn("nodes", derive.impact_nodes(*[F.col(c) for c in ("algorithm", "api", "fn", "cls", "module", "path", "confidence")]))


def role_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_role(_observed(spark, sf_dir)).select("k", "ln", "role")


def pqc_review_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = derive.review_path(F.col("role"), F.col("algorithm"))
    return _with_role(_observed(spark, sf_dir)).groupBy("algorithm", "role", path.alias("review_path"), derive.is_candidate(path).alias("is_candidate")).agg(F.count("*").alias("n"))


def _scored(rows: DataFrame) -> DataFrame:
    rows = _nodes(_with_role(rows)).withColumn("node_count", F.size("nodes"))
    rows = rows.withColumn("p", derive.priority(F.col("confidence"), F.lit("CLASS_IMPORT"), F.col("algorithm"), F.col("operation"), F.col("role"), F.col("node_count")))
    return rows.withColumn("priority_score", F.col("p.score").cast("long")).withColumn("priority", F.col("p.level"))


_ROLES = f"SELECT *, {_ROLE.format(p='primitive', a='algorithm', o='operation')} AS role, 3 + (CASE WHEN fn IS NULL THEN 0 ELSE 1 END) + (CASE WHEN cls IS NULL THEN 0 ELSE 1 END) + (CASE WHEN module IS NULL THEN 0 ELSE 1 END) AS node_count FROM ({_OBSERVED})"
_SCORED = f"SELECT *, {_BAND} AS priority FROM (SELECT *, CAST({_SCORE} AS BIGINT) AS priority_score FROM ({_ROLES}))"


def priority_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(_observed(spark, sf_dir)).select("k", "ln", "priority_score", "priority", F.size("p.reasons").cast("long").alias("reasons"))


def priority_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sentence of a finding's priority, in order.

    Of an inner explode Spark makes a filter on the array, which goes below all derivations and works them out again for
    each mention; of an outer one it doesn't.
    """
    rows = _scored(_observed(spark, sf_dir)).select("k", "ln", F.posexplode_outer("p.reasons").alias("place", "reason")).filter("place is not null")
    return rows.withColumn("place", F.col("place").cast("long"))


_REASONS = """CASE WHEN {modern} THEN [upper(algorithm) || ' is post-quantum already.', 'Review how it is used; it need not be replaced.'] ELSE list_filter([
 confidence || ' confidence by CLASS_IMPORT.',
 upper(algorithm) || CASE upper(algorithm) WHEN 'SHA-1' THEN ' is a hash that is weak already.' WHEN 'SHA-256' THEN ' is a hash; its length matters.' WHEN 'AES' THEN ' is symmetric; its key length matters.'
  WHEN 'FOO' THEN ' is in no known family.' WHEN 'BLAKE2B' THEN ' is a hash; its length matters.' ELSE ' is a public-key algorithm that a quantum computer breaks.' END,
 CASE WHEN operation IN ('SIGN', 'VERIFY', 'KEY_GENERATION', 'KEY_ESTABLISHMENT') THEN operation || '.' WHEN role IN ('DIGITAL_SIGNATURE', 'KEY_ESTABLISHMENT') THEN operation || ' in the role ' || role || '.' ELSE operation || '.' END,
 CASE WHEN role <> 'UNKNOWN' THEN 'Its role is ' || role || '.' END, CASE WHEN node_count >= 5 THEN 'It reaches ' || node_count || ' elements.' END], lambda r: r IS NOT NULL) END"""


def impact_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _nodes(_observed(spark, sf_dir)).select("k", "ln", F.posexplode("nodes").alias("place", "n"))
    return rows.select("k", "ln", F.col("place").cast("long").alias("place"), "n.id", "n.relationship")


def impact_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _nodes(_observed(spark, sf_dir)).select("k", "ln", F.explode(derive.impact_edges(F.col("nodes"))).alias("e"))
    return rows.select("k", "ln", "e.source", "e.target", "e.relationship")


_CHAIN = f"""SELECT k, ln, unnest(nodes) AS x, generate_subscripts(nodes, 1) - 1 AS place, nodes FROM (SELECT k, ln, list_filter([
 {{'kind': 'ALGORITHM', 'id': 'ALGORITHM:' || algorithm, 'rel': NULL}}, {{'kind': 'API', 'id': 'API:' || api, 'rel': 'USES'}}, {{'kind': 'FUNCTION', 'id': 'FUNCTION:' || fn, 'rel': 'CALLS'}},
 {{'kind': 'CLASS', 'id': 'CLASS:' || cls, 'rel': 'CONTAINS'}}, {{'kind': 'MODULE', 'id': 'MODULE:' || module, 'rel': 'CONTAINS'}}, {{'kind': 'FILE', 'id': 'FILE:' || path, 'rel': 'DEFINED_IN'}}], lambda n: n.id IS NOT NULL) AS nodes FROM ({_OBSERVED}))"""


def _identified(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("path", "rule_id", "algorithm", "api", "operation", "fn", "cls")
    return _observed(spark, sf_dir).withColumn("fingerprint", derive.fingerprint(F.lit(REPOSITORY), *[F.col(c) for c in names]))


_IDENTIFIED = f"SELECT *, {_fingerprint_sql('path', 'fn', 'cls')} AS fingerprint FROM ({_SCORED})"


def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _identified(spark, sf_dir).select("k", "ln", "fingerprint")


def scan_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _refs(spark, sf_dir)
    owner = F.concat(F.lit(" Own"), F.col("c_custkey").cast("string"))
    digest = derive.scan_identity(F.lit("GitHub"), owner, F.lit("Repo"), F.col("ref"), F.lit(vocab.PARSER_VERSION), F.lit(vocab.RULESET_VERSION), F.lit(vocab.PQC_VERSION))
    return rows.select("c_custkey", digest.alias("digest"))


_FIRST = ["path", "start_line", "rule_id", "api", "operation", "k", "ln"]


def _unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each identity the first observation; all else is derived of those that stay.

    k and ln name no row of ``lineitem`` alone; where the SQL's order ends in a tie, the greater part and supplier key decide.
    """
    order = [*_FIRST, F.desc("l_partkey"), F.desc("l_suppkey")]
    return _scored(derive.first_per_fingerprint(_identified(spark, sf_dir), order, "scan_id"))


_UNIQUE = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scan_id, fingerprint ORDER BY path, start_line, rule_id, api, operation, k, ln) AS rn FROM ({_IDENTIFIED})) WHERE rn = 1"


def dedup_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _unique(spark, sf_dir).select("scan_id", "fingerprint", "k", "ln", "start_line")


def duplicate_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive.observation_counts(_identified(spark, sf_dir), "scan_id")


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unique findings with the columns of the persisted table, written once; the reads below go to the written table."""
    rows = lambda: _unique(spark, sf_dir).withColumn("id", persist.row_id("scan_id", "fingerprint")).withColumn("file_path", F.col("path")).withColumn("status", F.lit("ACTIVE"))
    return persist.written_once(spark, rows, sf_dir, "findings", inputs=(f"{sf_dir}/lineitem.parquet",))


_STORED = f"SELECT *, sha256(concat_ws(chr(31), scan_id, fingerprint)) AS id, path AS file_path FROM ({_UNIQUE})"
_RANK_P = "CASE priority WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 3 WHEN 'INFORMATIONAL' THEN 4 ELSE 9 END"
_RANK_C = "CASE confidence WHEN 'HIGH' THEN 0 WHEN 'MEDIUM' THEN 1 WHEN 'LOW' THEN 2 ELSE 9 END"


def findings_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read.findings_page(_stored(spark, sf_dir), "scan1", page=2, size=50, confidence="HIGH").items.select("fingerprint", "file_path", "start_line", "priority", "review_path")


def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lambda: read.page_index(_stored(spark, sf_dir).select("id", "scan_id", "fingerprint", "file_path", "start_line", "priority", "confidence"))
    return persist.written_once(spark, rows, sf_dir, "pages", inputs=(f"{sf_dir}/lineitem.parquet",), by=["block"])


def findings_deep_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A late page of each scan, by its places in the index."""
    index = _index(spark, sf_dir)
    pages = [read.indexed_page(index, f"scan{k}", page, 200) for k, page in ((0, 5), (1, 3), (2, 4), (3, 999))]
    return reduce(DataFrame.unionByName, [p.items for p in pages]).select("scan_id", "place", "fingerprint", "file_path", "start_line")


def page_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    meta = read.findings_page(_stored(spark, sf_dir), "scan1", page=1, size=50, role="HASH").meta
    return meta.select(F.col("page").cast("long").alias("page"), F.col("page_size").cast("long").alias("page_size"), "total", "pages")


def _reviews(findings: DataFrame) -> DataFrame:
    status = F.when(F.col("k") % 3 == 0, "OPEN").when(F.col("k") % 3 == 1, "IN_REVIEW").otherwise("REVIEWED")
    return findings.select(persist.row_id("id", F.lit("review")).alias("id"), F.col("id").alias("finding_id"), status.alias("status"), F.lit(None).cast("string").alias("assigned_to"), F.lit(None).cast("string").alias("note"))


_QUEUE = f"SELECT *, sha256(concat_ws(chr(31), id, 'review')) AS review_id, CASE k % 3 WHEN 0 THEN 'OPEN' WHEN 1 THEN 'IN_REVIEW' ELSE 'REVIEWED' END AS review_status FROM ({_STORED})"


def review_queue_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    findings = _stored(spark, sf_dir)
    page = read.queue_page(_reviews(findings), findings, page=1, size=100, review_status="OPEN", algorithm="Ed25519")
    return page.items.select("review_id", "finding_id", "review_status", "priority", "file_path", "start_line")


def queue_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    findings = _stored(spark, sf_dir)
    return read.review_queue(_reviews(findings), findings).groupBy("scan_id", "review_status", "priority").agg(F.count("*").alias("n"))


def engine_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One scan's whole queue, in order."""
    return read.engine_queue(_spans(spark, sf_dir).filter("scan_id = 'scan2'")).select("k", "ln", "priority_score")


def engine_queue_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole queue of every scan."""
    rows = _spans(spark, sf_dir).select("scan_id", "priority_score", *read.ENGINE_ORDER, "k", "ln")
    return read.engine_ranks(rows, "scan_id", _pieces(_table(spark, sf_dir, "lineitem"), EACH)).select("scan_id", "rank", "k", "ln", "priority_score")


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored observations with a span; k and ln make up its end, so rows that tie are alike in what is shown of them."""
    return _scored(_observed(spark, sf_dir)).withColumns({"start_column": F.lit(0), "end_line": F.col("k"), "end_column": F.col("ln")})


def finding_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    findings = _stored(spark, sf_dir)
    evidence = findings.select(F.col("id").alias("finding_id"), F.concat(F.lit("line "), F.col("start_line").cast("string")).alias("source_excerpt"), "rule_id", F.lit("p").alias("parser_version"), F.lit("r").alias("ruleset_version"))
    nodes = findings.select(F.col("id").alias("finding_id"), F.explode(F.filter("nodes", lambda n: n["node_type"] != "ALGORITHM")).alias("n")).select("finding_id", "n.*").drop("id")
    findings = findings.drop("nodes", "node_count")
    shown = read.details(findings.drop("rule_id").withColumns({c: F.lit(None).cast("int") for c in ("end_line", "start_column", "end_column")} | {"library": F.lit(vocab.LIBRARY)}), evidence, nodes, _reviews(findings))
    return shown.select(
        "finding_id", F.col("observed.enclosing_function").alias("fn"), F.col("observed.enclosing_class").alias("cls"), F.col("observed.source_excerpt").alias("excerpt"),
        F.col("impact.node_count").alias("node_count"), F.col("migration.review_path").alias("review_path"), F.col("review.status").alias("review_status"),
        "impact.scope", F.array_join("impact.nodes.id", " ").alias("node_ids"), F.size("impact.relationships").cast("long").alias("edges"), F.col("migration.rationale").isNotNull().alias("has_rationale"),
        F.col("priority.score").cast("long").alias("score"), F.size("priority.reasons").cast("long").alias("reasons"), "observed.evidence_basis",
    )


def _reviewed_findings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The engine's findings, once each, and reviews of two thirds of them."""
    path = derive.review_path(F.col("role"), F.col("algorithm"))
    found = _stored(spark, sf_dir).drop("id", "file_path", "status").withColumns({"start_column": F.lit(0), "end_line": F.col("k"), "end_column": F.col("ln"), "review_path": path}).withColumn("is_migration_candidate", derive.is_candidate(F.col("review_path")))
    status = F.when(F.col("k") % 3 == 0, "OPEN").otherwise("IN_REVIEW")
    reviews = found.filter("k % 3 < 2").select("scan_id", "fingerprint", persist.row_id("scan_id", "fingerprint", F.lit("review")).alias("review_id"), status.alias("status"), F.lit("me").alias("assigned_to"), F.lit(None).cast("string").alias("note"), F.lit(0).alias("updated_at"))
    return found, reviews


def engine_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read.engine_page(*_reviewed_findings(spark, sf_dir), "scan_id")
    return rows.select("id", "scan_id", "operation", "review_path", "is_migration_candidate", "priority_score", "file_path", "end_line", "review_status", "place", "total")


def engine_review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read.engine_review_queue(*_reviewed_findings(spark, sf_dir), "scan_id")
    return rows.select("review_id", "finding_id", "scan_id", "role", "priority", "priority_score", "status", "assigned_to", "note", "file_path", "start_line", "place", "total")


_REVIEWED = f"""SELECT *, CASE k % 3 WHEN 0 THEN 'OPEN' WHEN 1 THEN 'IN_REVIEW' END AS review_status, sha256(concat_ws(chr(31), scan_id, fingerprint, 'review')) AS review_id, {_PQC} AS review_path FROM ({_UNIQUE})"""


def finding_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the list of findings, all scans."""
    findings = _stored(spark, sf_dir)
    return read.list_items(findings, _reviews(findings)).select("id", "scan_id", "review_path", "is_migration_candidate", "review_status", "priority", "file_path", "start_line")


def queue_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the review queue, all of them."""
    findings = _stored(spark, sf_dir)
    rows = read.queue_rows(_reviews(findings), findings)
    return rows.select("review.id", "review.status", F.col("finding.id").alias("finding_id"), "finding.scan_id", "finding.review_path", "finding.is_migration_candidate", "finding.operation")


def legacy_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    findings = _stored(spark, sf_dir)
    return read.legacy_queue(_reviews(findings), findings, "scan1", "OPEN").select("review_id", "finding_id", "priority", "file_path", "start_line")


def scan_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every scan with its repository and engine versions."""
    _, scans, repositories = _cache_input(spark, sf_dir)
    scans = scans.withColumns({c: F.lit(0).cast("long") for c in ("file_count", "analyzed_file_count", "skipped_file_count", "finding_count")})
    return read.scan_details(scans, repositories).select("scan_id", "repository.owner", "repository.name", "status", "source_state", "engine.ruleset_version")


def finding_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents of the engine's findings on the templated corpus."""
    rows = read.engine_documents(_findings(spark, sf_dir))
    return rows.select(
        "id", F.col("observed.rule_id").alias("rule_id"), F.col("observed.location.start_line").cast("long").alias("line"), F.col("inference.role").alias("role"), F.col("migration.review_path").alias("review_path"),
        F.col("priority.score").cast("long").alias("score"), F.size("impact.nodes").cast("long").alias("nodes"), F.size("impact.relationships").cast("long").alias("relationships"),
        F.element_at("impact.nodes", 1)["node_type"].alias("first_node"), F.element_at("impact.nodes", -1)["node_type"].alias("last_node"),
    )


def findings_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _stored(spark, sf_dir)
    return read.diff(rows.filter("scan_id = 'scan0'"), rows.filter("scan_id = 'scan1'")).groupBy("change").agg(F.count("*").alias("n"))


# -- lifecycle --------------------------------------------------------------------------

_JOBS = """SELECT CAST(o_orderkey AS VARCHAR) AS id, CASE o_orderkey % 4 WHEN 0 THEN 'QUEUED' WHEN 1 THEN 'RUNNING' WHEN 2 THEN 'COMPLETED' ELSE 'FAILED' END AS status,
 CAST(o_orderkey % 4 AS INT) AS attempt_count, 3 AS max_attempts, CASE WHEN o_orderkey % 4 = 1 AND o_orderkey % 3 > 0 THEN o_orderdate END AS locked_at, CASE WHEN o_orderkey % 4 = 1 THEN 'w' END AS locked_by,
 CASE WHEN o_orderkey % 4 > 0 THEN o_orderdate END AS started_at, CAST(NULL AS TIMESTAMP) AS completed_at, CAST(NULL AS VARCHAR) AS last_error, o_orderdate AS created_at FROM orders"""
_NOW = "2030-01-01 00:00:00"


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    _table(spark, sf_dir, "orders").createOrReplaceTempView("orders")
    return spark.sql(_JOBS.replace("VARCHAR", "STRING"))


def job_claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lifecycle.claim(_jobs(spark, sf_dir), "me", F.lit(_NOW).cast("timestamp"))
    return found.filter("locked_by = 'me'").select("id", "status", F.col("attempt_count").cast("long").alias("attempt_count"))


def stale_reclaim(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lifecycle.reclaim(_jobs(spark, sf_dir), F.expr("timestamp'1995-06-01 00:00:00'"))
    return found.groupBy("status", F.col("locked_by").isNull().alias("unlocked")).agg(F.count("*").alias("n"), F.sum(F.col("attempt_count").cast("long")).alias("attempts"))


def job_finish(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = _jobs(spark, sf_dir)
    outcomes = jobs.filter("cast(id as bigint) % 5 < 3").select("id", F.when(F.col("id").cast("long") % 5 == 0, F.lit(None).cast("string")).otherwise("boom").alias("error"))
    found = lifecycle.finish(jobs, outcomes, F.lit(_NOW).cast("timestamp"))
    return found.groupBy("status", "last_error", F.col("completed_at").isNotNull().alias("closed")).agg(F.count("*").alias("n"))


_WORK = """SELECT id, 'scan' || id AS scan_id, status, CAST(CAST(id AS BIGINT) % 3 + 1 AS INT) AS attempt_count, max_attempts, locked_at, locked_by, started_at, completed_at, last_error, created_at FROM ({jobs})"""
_WORK_SCANS = """SELECT 'scan' || id AS id, CASE status WHEN 'RUNNING' THEN 'RUNNING' ELSE 'QUEUED' END AS status, started_at, completed_at, CAST(NULL AS VARCHAR) AS error_code, CAST(NULL AS VARCHAR) AS error_message FROM ({jobs})"""


def _settled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    _table(spark, sf_dir, "orders").createOrReplaceTempView("orders")
    made = [spark.sql(q.format(jobs=_JOBS).replace("VARCHAR", "STRING")) for q in (_WORK, _WORK_SCANS)]
    number = F.col("id").cast("long")
    failed = number % 5 > 0
    outcomes = made[0].filter(number % 7 < 6).select("id", F.when(failed, F.when(number % 2 == 0, "INGESTION_FAILED").otherwise("SCAN_EXECUTION_FAILED")).alias("error_code"), F.when(failed, "boom").alias("error"))
    return lifecycle.settle(*made, outcomes, F.lit(_NOW).cast("timestamp"))


_ENDED = f"""SELECT *, hit AND bad AND n < 3 AS again FROM (SELECT *, id::BIGINT % 3 + 1 AS n, status = 'RUNNING' AND id::BIGINT % 7 < 6 AS hit, id::BIGINT % 5 > 0 AS bad FROM ({_JOBS}))"""


def retry_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs and their scans after running jobs ended: both completed, queued again, or failed."""
    jobs, scans, _ = _settled(spark, sf_dir)
    scans = scans.select(F.col("id").alias("scan_id"), F.col("status").alias("scan_status"), F.col("started_at").isNotNull().alias("scan_started"), F.col("completed_at").isNotNull().alias("scan_closed"), "error_code")
    return jobs.join(scans, "scan_id").select("id", "status", F.col("locked_by").isNotNull().alias("locked"), F.col("started_at").isNotNull().alias("started"), "last_error", "scan_status", "scan_started", "scan_closed", "error_code")


def failed_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is logged of scans that ended."""
    return _settled(spark, sf_dir)[2]


def stored_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings committed to a store, a run for each scan; one is first written wrong, and replaced."""
    store = persist.Store(spark, persist.own_folder(spark))
    rows = _stored(spark, sf_dir).select("id", "scan_id", "fingerprint", "priority", "start_line")
    wrong = store.stage({"findings": rows.filter("scan_id = 'scan2'").withColumn("priority", F.lit("?"))})
    store.commit([("findings", "scan2", wrong["findings"])])
    parts = [(f"scan{k}", store.stage({"findings": rows.filter(F.col("scan_id") == f"scan{k}")})["findings"]) for k in range(4)]
    store.commit([("findings", run, written) for run, written in parts])
    return store.read("findings", numbered=True).select("id", "run", "fingerprint", "priority", "start_line", "number")


_MOVES = """SELECT event_id, user_id AS key, CASE event_id % 5 WHEN 0 THEN 'RUNNING' WHEN 1 THEN 'RUNNING' WHEN 2 THEN 'FAILED' WHEN 3 THEN 'COMPLETED' ELSE 'QUEUED' END AS job_move,
 CASE event_id % 4 WHEN 0 THEN 'OPEN' WHEN 1 THEN 'IN_REVIEW' WHEN 2 THEN 'REVIEWED' END AS review_move, CASE WHEN event_id % 3 = 0 THEN 'a' || (event_id % 7) END AS who, CASE WHEN event_id % 5 = 0 THEN 'n' || (event_id % 9) END AS note FROM events"""


def _moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    _table(spark, sf_dir, "events").createOrReplaceTempView("events")
    return spark.sql(_MOVES)


def job_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lifecycle.replay_jobs(_moves(spark, sf_dir).select(F.col("key").alias("job_id"), F.col("event_id").alias("seq"), F.col("job_move").alias("wanted")))
    return found.select("job_id", "status", F.col("attempt_count").cast("long").alias("attempt_count"), F.col("rejected").cast("long").alias("rejected"))


def review_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = _moves(spark, sf_dir).select(F.col("key").alias("review_id"), F.col("event_id").alias("seq"), F.col("review_move").alias("status"), F.col("who").alias("assigned_to"), "note")
    return lifecycle.replay_reviews(requests).select("review_id", "status", "assigned_to", "note", F.col("rejected").cast("long").alias("rejected"), (F.col("started") + F.col("completed")).alias("audited"))


def job_locks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs with locks that run out, as a stateful stream over two spans of time; the second goes on from the first's checkpoint.

    A last event without a job, a day after all others, moves the watermark past them.
    """
    rows = _moves(spark, sf_dir).join(_table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts")), "event_id")
    rows = rows.select(F.col("key").cast("string").alias("job_id"), "ts", F.col("event_id").alias("seq"), F.col("job_move").alias("wanted"))
    seconds = F.unix_timestamp("ts")
    first, last = rows.agg(F.min(seconds), F.max(seconds)).first()
    middle = ((first or 0) + (last or 0)) // 2
    tick = spark.range(1).select(F.lit(None).cast("string").alias("job_id"), F.timestamp_seconds(F.lit((last or 0) + 86_400)).alias("ts"), F.lit(0).cast("long").alias("seq"), F.lit(None).cast("string").alias("wanted"))
    root = persist.own_folder(spark)
    for part in (rows.filter(seconds < middle), rows.filter(seconds >= middle).unionByName(tick)):
        part.write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema(rows.schema).parquet(f"{root}/in")
        job_stream.write_changes(job_stream.job_changes(stream, "8 hours"), f"{root}/out", f"{root}/checkpoint").awaitTermination()
    return job_stream.jobs_table(spark, f"{root}/out").select("job_id", "status", "attempt_count", "rejected", "reclaimed")


def review_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _moves(spark, sf_dir).filter("review_move is not null")
    current = F.when(F.col("key") % 3 == 0, "OPEN").when(F.col("key") % 3 == 1, "IN_REVIEW").otherwise("REVIEWED")
    found = lifecycle.with_validity(rows.select(current.alias("current"), F.col("review_move").alias("wanted")), vocab.REVIEW_MOVES, True)
    return found.groupBy("current", "wanted", "is_valid").agg(F.count("*").alias("n"))


_FOLD = """WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY event_id) AS rn FROM ({moves})),
 s AS ({start} UNION ALL {step}) {result}"""
_JOB_FOLD = _FOLD.format(
    moves=_MOVES,
    start="SELECT DISTINCT key, 0::BIGINT AS pos, 'QUEUED' AS status, 0::BIGINT AS attempts, 0::BIGINT AS rejected FROM e",
    step="""SELECT key, pos + 1, CASE WHEN ok THEN wanted ELSE status END, attempts + (CASE WHEN ok AND wanted = 'RUNNING' THEN 1 ELSE 0 END), rejected + (CASE WHEN ok THEN 0 ELSE 1 END) FROM (
 SELECT s.*, CASE WHEN e.job_move = 'FAILED' AND attempts < 3 THEN 'QUEUED' ELSE e.job_move END AS wanted,
 status || '>' || (CASE WHEN e.job_move = 'FAILED' AND attempts < 3 THEN 'QUEUED' ELSE e.job_move END) IN ('QUEUED>RUNNING','QUEUED>CANCELLED','RUNNING>COMPLETED','RUNNING>FAILED','RUNNING>QUEUED','RUNNING>CANCELLED') AS ok
 FROM s JOIN e ON e.key = s.key AND e.rn = s.pos + 1)""",
    result="SELECT key AS job_id, arg_max(status, pos) AS status, max(attempts) AS attempt_count, max(rejected) AS rejected FROM s GROUP BY key",
)
_LOCK_FOLD = _FOLD.format(
    moves=f"SELECT m.*, ts FROM ({_MOVES}) m JOIN events USING (event_id)",
    start="SELECT DISTINCT key, 0::BIGINT AS pos, 'QUEUED' AS status, 0::BIGINT AS attempts, 0::BIGINT AS rejected, 0::BIGINT AS reclaimed, NULL::TIMESTAMP AS held FROM e",
    step="""SELECT key, pos + 1, CASE WHEN ok THEN wanted ELSE status END, attempts + (CASE WHEN ok AND wanted = 'RUNNING' THEN 1 ELSE 0 END), rejected + (CASE WHEN ok THEN 0 ELSE 1 END), reclaimed,
 CASE WHEN ok AND wanted = 'RUNNING' THEN ts WHEN NOT ok THEN held END FROM (
 SELECT *, status || '>' || wanted IN ('QUEUED>RUNNING','QUEUED>CANCELLED','RUNNING>COMPLETED','RUNNING>FAILED','RUNNING>QUEUED','RUNNING>CANCELLED') AS ok FROM (
 SELECT s.key, s.pos, e.ts, attempts, rejected, CASE WHEN e.job_move = 'FAILED' AND attempts < 3 THEN 'QUEUED' ELSE e.job_move END AS wanted,
 CASE WHEN e.ts - held > INTERVAL 8 HOURS THEN 'QUEUED' ELSE status END AS status, reclaimed + (CASE WHEN e.ts - held > INTERVAL 8 HOURS THEN 1 ELSE 0 END) AS reclaimed,
 CASE WHEN e.ts - held <= INTERVAL 8 HOURS THEN held END AS held FROM s JOIN e ON e.key = s.key AND e.rn = s.pos + 1))""",
    result="""SELECT CAST(key AS VARCHAR) AS job_id, CASE WHEN held IS NULL THEN status ELSE 'QUEUED' END AS status, attempts AS attempt_count, rejected, reclaimed + (CASE WHEN held IS NULL THEN 0 ELSE 1 END) AS reclaimed
 FROM s QUALIFY row_number() OVER (PARTITION BY key ORDER BY pos DESC) = 1""",
).replace("ORDER BY event_id", "ORDER BY ts, event_id")
_REVIEW_FOLD = _FOLD.format(
    moves=_MOVES,
    start="SELECT DISTINCT key, 0::BIGINT AS pos, 'OPEN' AS status, NULL::VARCHAR AS assigned_to, NULL::VARCHAR AS note, 0::BIGINT AS rejected, 0::BIGINT AS audited FROM e",
    step="""SELECT key, pos + 1, CASE WHEN ok THEN wanted ELSE status END, CASE WHEN ok THEN coalesce(who, assigned_to) ELSE assigned_to END, CASE WHEN ok THEN coalesce(new_note, note) ELSE note END,
 rejected + (CASE WHEN ok THEN 0 ELSE 1 END), audited + (CASE WHEN ok AND wanted <> status AND wanted <> 'OPEN' THEN 1 ELSE 0 END) FROM (
 SELECT s.*, e.who, e.note AS new_note, coalesce(e.review_move, s.status) AS wanted, coalesce(e.review_move, s.status) = s.status
  OR s.status || '>' || e.review_move IN ('OPEN>IN_REVIEW','IN_REVIEW>REVIEWED','IN_REVIEW>OPEN','REVIEWED>IN_REVIEW') AS ok FROM s JOIN e ON e.key = s.key AND e.rn = s.pos + 1)""",
    result="SELECT key AS review_id, status, assigned_to, note, rejected, audited FROM s QUALIFY row_number() OVER (PARTITION BY key ORDER BY pos DESC) = 1",
)

_REPOS = "SELECT 'repo' || s_suppkey AS id, 'github' AS provider, 'own' || (s_suppkey % 30) AS owner, 'r' || s_suppkey AS name FROM supplier"
_SCANS = """SELECT 'scan' || o_orderkey AS id, 'repo' || (o_orderkey % 20 + 1) AS repository_id, CASE WHEN o_orderkey % 3 = 0 THEN 'FAILED' ELSE 'COMPLETED' END AS status, 'LIVE' AS source_state,
 'c' || (o_orderkey % 40) AS commit_sha, 'p' AS parser_version, 'r' || (o_orderkey % 2) AS ruleset_version, 'q' AS pqc_ruleset_version, o_orderdate AS created_at FROM orders"""
_ASKED = """SELECT 'q' || c_custkey AS request_id, 'github' AS provider, 'own' || ((c_custkey % 25 + 1) % 30) AS owner, 'r' || (c_custkey % 25 + 1) AS name, 'c' || (c_custkey % 50) AS commit_sha,
 'p' AS parser_version, 'r1' AS ruleset_version, 'q' AS pqc_ruleset_version FROM customer"""


def _cache_input(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    for name in ("supplier", "orders", "customer"):
        _table(spark, sf_dir, name).createOrReplaceTempView(name)
    return spark.sql(_ASKED), spark.sql(_SCANS), spark.sql(_REPOS)


def scan_cache_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.cache_hits(*_cache_input(spark, sf_dir)).select("request_id", "cached_scan_id")


_HITS = f"""SELECT a.request_id, arg_min(s.id, (s.created_at, s.id)) AS cached_scan_id FROM ({_ASKED}) a LEFT JOIN (SELECT s.*, r.provider, r.owner, r.name FROM ({_SCANS}) s JOIN ({_REPOS}) r ON s.repository_id = r.id WHERE s.status = 'COMPLETED') s
 USING (provider, owner, name, commit_sha, parser_version, ruleset_version, pqc_ruleset_version) GROUP BY a.request_id"""


def create_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    after, _ = lifecycle.create_scans(*_cache_input(spark, sf_dir))
    return after.groupBy("status", "source_state").agg(F.count("*").alias("n"))


def get_or_create(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, _, repositories = _cache_input(spark, sf_dir)
    return lifecycle.get_or_create(asked, repositories).select("provider", "owner", "name")


def integrity_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    findings = _stored(spark, sf_dir)
    evidence = findings.filter("k % 10 > 0").select(F.col("id").alias("finding_id"))
    return lifecycle.missing_evidence(findings, evidence).select("id", "k")


def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, scans, repositories = _cache_input(spark, sf_dir)
    left = repositories.filter("id <> 'repo3'")
    gone = lifecycle.cascade(left, scans, "repository_id").groupBy("repository_id").agg(F.count("*").alias("n"))
    nulled = lifecycle.cascade(left, scans, "repository_id", "SET NULL").groupBy("repository_id").agg(F.count("*").alias("n"))
    return gone.withColumn("rule", F.lit("CASCADE")).unionByName(nulled.withColumn("rule", F.lit("SET NULL")))


def windowed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay.windowed_counts(_table(spark, sf_dir, "events"), width="1 hour")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {f"rule_{r.rsplit('-', 1)[1].lower()}": _matches(r) for r, _, _ in vocab.RULES}
    own = (
        rule_in_code, flagship, all_findings, parse_summary, parse_shapes, parse_kinds, import_index, bindings, evidence_excerpt, excerpts, tree_scan, zip_scan, zip_members, discover_files, skip_histogram, content_hash, repo_url_parse, sha_validation, short_refs,
        role_classification, pqc_review_path, priority_score, priority_reasons, impact_nodes, impact_edges, fingerprints, scan_identity, dedup_findings, duplicate_counts, findings_page, findings_deep_page, page_meta,
        review_queue_page, queue_counts, engine_queue, engine_queue_ranks, finding_detail, engine_page, engine_review_queue, finding_list, queue_row, legacy_queue, scan_detail, finding_document, findings_diff, job_claim, stale_reclaim, job_finish, retry_decision, failed_scan, stored_findings, job_retry, job_locks, review_fold, review_transitions,
        scan_cache_hit, create_scan, get_or_create, integrity_guard, cascade_delete, windowed_events,
    )
    return found | {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    stored = f"({_STORED})"
    review_path = f"{_PQC} AS review_path"
    return {f"rule_{r.rsplit('-', 1)[1].lower()}": _matches_sql(r) for r, _, _ in vocab.RULES} | {
        "rule_in_code": f"SELECT *, 'HASH' AS primitive FROM ({_matches_sql(vocab.HASH)})",
        "flagship": f"{_DERIVED} SELECT algorithm, role, review_path, count(*) AS n FROM q GROUP BY ALL",
        "all_findings": f"""{_DERIVED} SELECT path, rule_id, CAST(line AS BIGINT) AS line, api, role, review_path, review_path IN ('ML-KEM', 'ML-DSA / SLH-DSA') AS is_migration_candidate,
 {_fingerprint_sql("path", "fn", "cls")} AS fingerprint, {_BAND} AS priority, CAST(priority_score AS BIGINT) AS priority_score, CAST(node_count AS BIGINT) AS node_count FROM q""",
        "parse_summary": f"SELECT count_if(error_type IS NULL) AS parsed_files, count_if(error_type IS NOT NULL) AS failed_files, count(*) AS total_files, count(*) AS analyzed_files, 0::BIGINT AS skipped_files FROM part JOIN {_SHAPES} ON p_partkey % {N} = template",
        "parse_shapes": f"SELECT {_PATH} AS path, 'pkg' || (p_partkey % 7) || '.mod_' || p_partkey AS module_path, error_type, imports::BIGINT AS imports, symbols::BIGINT AS symbols, calls::BIGINT AS calls FROM part JOIN {_SHAPES} ON p_partkey % {N} = template",
        "parse_kinds": f"SELECT 'k' || p_partkey || '.py' AS path, error_type, CAST(line AS BIGINT) AS line, attributes::BIGINT AS attributes, constants FROM part JOIN {_values([(k, *kind[1:]) for k, kind in enumerate(_KINDS)], 'template, error_type, line, attributes, constants')} ON p_partkey % {len(_KINDS)} = template",
        "import_index": f"SELECT {_PATH} AS path, local_name, qualified_name FROM part JOIN {_INDEX} ON p_partkey % {N} = template",
        "bindings": f"SELECT {_PATH} AS path, rule_id, scope, name, kind, basis, confidence FROM part JOIN {_BOUND} ON p_partkey % {N} = template",
        "evidence_excerpt": f"SELECT {_PATH} AS path, CAST(line AS BIGINT) AS line, api, excerpt AS source_excerpt, false AS truncated FROM part JOIN {_excerpts()} ON p_partkey % {N} = template",
        "excerpts": """SELECT path, rule_id, first AS line, first + n AS end_line, CASE WHEN n >= 40 THEN call || repeat(chr(10) || '    1,', 39) ELSE call || repeat(chr(10) || '    1,', n) || ')' END AS source_excerpt, n >= 40 AS truncated FROM (
 SELECT 'x' || p_partkey || '.py' AS path, CAST(p_partkey % 6 + 2 AS BIGINT) AS first, CAST(p_partkey % 60 AS BIGINT) AS n,
 'PY-CRYPTO-' || CASE p_partkey % 4 WHEN 0 THEN 'RSA' WHEN 1 THEN 'HASH' WHEN 2 THEN 'AES' ELSE 'X25519' END AS rule_id,
 'k = ' || CASE p_partkey % 4 WHEN 0 THEN 'rsa.generate_private_key' WHEN 1 THEN 'hashes.SHA256' WHEN 2 THEN 'AES' ELSE 'x25519.X25519PrivateKey.generate' END || '(' AS call FROM part)""",
        "tree_scan": _SHOWN_FILES,
        "zip_scan": _SHOWN_FILES,
        "zip_members": _SHOWN_FILES,
        "discover_files": f"""SELECT path, CASE WHEN skip_reason IN ('IGNORED_PATH', 'UNSUPPORTED_LANGUAGE') THEN NULL ELSE 'python' END AS language, size::BIGINT AS size, coalesce(skip_reason = 'BINARY_FILE', false) AS is_binary,
 skip_reason IS NULL AS is_supported, skip_reason FROM (SELECT *, {_SKIP} AS skip_reason FROM ({_TREE}))""",
        "skip_histogram": f"""WITH d AS (SELECT {_SKIP} AS skip_reason FROM ({_TREE})) SELECT t.*, skip_reason, n FROM (SELECT skip_reason, count(*) AS n FROM d WHERE skip_reason IS NOT NULL GROUP BY 1),
 (SELECT count(*) AS total_files, count_if(skip_reason IS NULL) AS analyzed_files, count_if(skip_reason IS NOT NULL) AS skipped_files FROM d) t""",
        "content_hash": """SELECT CAST(p_partkey % 5 AS VARCHAR) AS snapshot_id, sha256(string_agg('d/' || p_partkey || '.py' || chr(0) || sha256(p_name) || chr(10), '' ORDER BY 'd/' || p_partkey || '.py')) AS content_hash,
 count(*) AS file_count FROM part GROUP BY 1""",
        "repo_url_parse": f"""SELECT c_custkey, o AS owner, n AS name, 'https://github.com/' || o || '/' || n AS canonical_url FROM (SELECT c_custkey, CASE c_custkey % 8 WHEN 0 THEN 'own' || c_custkey WHEN 1 THEN 'a-b' WHEN 7 THEN 'O' || c_custkey END AS o,
 CASE c_custkey % 8 WHEN 0 THEN 're.po' WHEN 1 THEN 'c_d' WHEN 7 THEN 'R' END AS n FROM ({_URLS}))""",
        "short_refs": f"""WITH c AS (SELECT DISTINCT repo, sha FROM ({_COMMITS})), r AS (SELECT *, CASE WHEN regexp_full_match(lower(trim(ref)), '[0-9a-f]{{7,40}}') THEN lower(trim(ref)) END AS want FROM ({_SHORT})),
 f AS (SELECT c_custkey, any_value(want) AS want, count(c.sha) AS n, min(c.sha) AS sha FROM r LEFT JOIN c ON c.repo = r.repo AND starts_with(c.sha, r.want) GROUP BY c_custkey)
 SELECT c_custkey, CASE WHEN length(want) = 40 THEN want WHEN n = 1 THEN sha END AS sha, CASE WHEN want IS NULL THEN 'INVALID' WHEN length(want) = 40 OR n = 1 THEN NULL WHEN n = 0 THEN 'NOT_FOUND' ELSE 'AMBIGUOUS' END AS problem FROM f""",
        "sha_validation": f"""SELECT c_custkey, sha, coalesce(length(sha) = 40, false) AS is_full, coalesce(starts_with('abcdef0123' || repeat('0', 30), sha), false) AS matches
 FROM (SELECT c_custkey, CASE WHEN c_custkey % 5 IN (0, 2, 4) THEN lower(trim(ref)) END AS sha FROM ({_URLS}))""",
        "role_classification": f"SELECT k, ln, role FROM ({_ROLES})",
        "pqc_review_path": f"SELECT algorithm, role, review_path, review_path IN ('ML-KEM', 'ML-DSA / SLH-DSA') AS is_candidate, count(*) AS n FROM (SELECT *, {review_path} FROM ({_ROLES})) GROUP BY ALL",
        "priority_score": f"""SELECT k, ln, priority_score, priority, CAST(CASE WHEN {_MODERN} THEN 2 ELSE 3 + (CASE WHEN role = 'UNKNOWN' THEN 0 ELSE 1 END) + (CASE WHEN node_count >= 5 THEN 1 ELSE 0 END) END AS BIGINT) AS reasons FROM ({_SCORED})""",
        "priority_reasons": f"SELECT k, ln, generate_subscripts(r, 1)::BIGINT - 1 AS place, unnest(r) AS reason FROM (SELECT k, ln, {_REASONS.format(modern=_MODERN)} AS r FROM ({_SCORED}))",
        "impact_nodes": f"SELECT k, ln, place::BIGINT AS place, x.id AS id, x.rel AS relationship FROM ({_CHAIN})",
        "impact_edges": f"""SELECT k, ln, CASE WHEN x.kind = 'FILE' THEN nodes[place].id ELSE x.id END AS source, CASE WHEN x.kind = 'FILE' THEN x.id ELSE nodes[place].id END AS target, x.rel AS relationship
 FROM ({_CHAIN}) WHERE place > 0""",
        "fingerprints": f"SELECT k, ln, fingerprint FROM ({_IDENTIFIED})",
        "scan_identity": f"SELECT c_custkey, sha256(concat_ws(chr(31), 'github', 'own' || c_custkey, 'repo', lower(trim(ref)), 'python-ast-1', '0.3.0', '0.2.0')) AS digest FROM ({_URLS})",
        "dedup_findings": f"SELECT scan_id, fingerprint, k, ln, start_line FROM ({_UNIQUE})",
        "duplicate_counts": f"SELECT scan_id, count(*) AS observations, count(DISTINCT fingerprint) AS unique_findings, count(*) - count(DISTINCT fingerprint) AS duplicates FROM ({_IDENTIFIED}) GROUP BY 1",
        "findings_page": f"SELECT fingerprint, file_path, start_line, priority, {review_path} FROM {stored} WHERE scan_id = 'scan1' AND confidence = 'HIGH' ORDER BY {_RANK_P}, {_RANK_C}, file_path, start_line, fingerprint LIMIT 50 OFFSET 50",
        "findings_deep_page": f"""SELECT scan_id, place, fingerprint, file_path, start_line FROM (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY {_RANK_P}, {_RANK_C}, file_path, start_line, fingerprint) AS place FROM {stored})
 WHERE (scan_id = 'scan0' AND place BETWEEN 801 AND 1000) OR (scan_id = 'scan1' AND place BETWEEN 401 AND 600) OR (scan_id = 'scan2' AND place BETWEEN 601 AND 800)""",
        "page_meta": f"SELECT 1::BIGINT AS page, 50::BIGINT AS page_size, count(*) AS total, CAST(ceil(count(*) / 50.0) AS BIGINT) AS pages FROM {stored} WHERE scan_id = 'scan1' AND role = 'HASH'",
        "review_queue_page": f"""SELECT review_id, id AS finding_id, review_status, priority, file_path, start_line FROM ({_QUEUE}) WHERE review_status = 'OPEN' AND algorithm = 'Ed25519'
 ORDER BY {_RANK_P}, {_RANK_C}, file_path, start_line, review_id LIMIT 100""",
        "queue_counts": f"SELECT scan_id, review_status, priority, count(*) AS n FROM ({_QUEUE}) GROUP BY ALL",
        "engine_queue": f"SELECT k, ln, priority_score FROM ({_SCORED}) WHERE scan_id = 'scan2' ORDER BY priority_score DESC, path, start_line, rule_id, api, operation, k, ln",
        "engine_queue_ranks": f"""SELECT scan_id, row_number() OVER (PARTITION BY scan_id ORDER BY priority_score DESC, path, start_line, rule_id, api, operation, k, ln) AS rank, k, ln, priority_score
 FROM ({_SCORED})""",
        "finding_detail": f"""SELECT id AS finding_id, fn, cls, 'line ' || start_line AS excerpt, node_count::BIGINT - 1 AS node_count, {review_path}, review_status,
 'STATICALLY_OBSERVED' AS scope, concat_ws(' ', 'API:' || api, 'FUNCTION:' || fn, 'CLASS:' || cls, 'MODULE:' || module, 'FILE:' || path) AS node_ids, 0::BIGINT AS edges, true AS has_rationale,
 NULL::BIGINT AS score, 0::BIGINT AS reasons, NULL::VARCHAR AS evidence_basis FROM ({_QUEUE})""",
        "engine_page": f"""SELECT fingerprint AS id, scan_id, operation, review_path, review_path IN ('ML-KEM', 'ML-DSA / SLH-DSA') AS is_migration_candidate, priority_score, path AS file_path, k AS end_line, review_status,
 row_number() OVER (PARTITION BY scan_id ORDER BY path, start_line, rule_id, api, operation, k, ln) AS place, count(*) OVER (PARTITION BY scan_id) AS total FROM ({_REVIEWED})""",
        "engine_review_queue": f"""SELECT review_id, fingerprint AS finding_id, scan_id, role, priority, priority_score, review_status AS status, 'me' AS assigned_to, NULL::VARCHAR AS note, path AS file_path, start_line,
 row_number() OVER (PARTITION BY scan_id ORDER BY priority_score DESC, path, start_line, rule_id, api, operation, k, ln) AS place, count(*) OVER (PARTITION BY scan_id) AS total FROM ({_REVIEWED}) WHERE review_status IS NOT NULL""",
        "finding_list": f"""SELECT id, scan_id, review_path, review_path IN ('ML-KEM', 'ML-DSA / SLH-DSA') AS is_migration_candidate, review_status, priority, file_path, start_line
 FROM (SELECT *, {review_path} FROM ({_QUEUE}))""",
        "queue_row": f"""SELECT review_id AS id, review_status AS status, id AS finding_id, scan_id, review_path, review_path IN ('ML-KEM', 'ML-DSA / SLH-DSA') AS is_migration_candidate, operation
 FROM (SELECT *, {review_path} FROM ({_QUEUE}))""",
        "legacy_queue": f"SELECT review_id, id AS finding_id, priority, file_path, start_line FROM ({_QUEUE}) WHERE scan_id = 'scan1' AND review_status = 'OPEN' ORDER BY {_RANK_P}, file_path, start_line, review_id",
        "scan_detail": f"SELECT s.id AS scan_id, r.owner, r.name, s.status, s.source_state, s.ruleset_version FROM ({_SCANS}) s JOIN ({_REPOS}) r ON s.repository_id = r.id",
        "finding_document": f"""{_DERIVED} SELECT {_fingerprint_sql("path", "fn", "cls")} AS id, rule_id, CAST(line AS BIGINT) AS line, role, review_path, CAST(priority_score AS BIGINT) AS score,
 CAST(node_count AS BIGINT) AS nodes, CAST(node_count - 1 AS BIGINT) AS relationships, 'ALGORITHM' AS first_node, 'FILE' AS last_node FROM q""",
        "findings_diff": f"""SELECT CASE WHEN a.fingerprint IS NULL THEN 'NEW' WHEN b.fingerprint IS NULL THEN 'RESOLVED' ELSE 'UNCHANGED' END AS change, count(*) AS n
 FROM (SELECT fingerprint FROM {stored} WHERE scan_id = 'scan0') a FULL JOIN (SELECT fingerprint FROM {stored} WHERE scan_id = 'scan1') b ON a.fingerprint = b.fingerprint GROUP BY 1""",
        "job_claim": f"SELECT id, 'RUNNING' AS status, attempt_count::BIGINT + 1 AS attempt_count FROM ({_JOBS}) WHERE status = 'QUEUED' ORDER BY created_at, id LIMIT 1",
        "stale_reclaim": f"""SELECT CASE WHEN old THEN 'QUEUED' ELSE status END AS status, CASE WHEN old THEN NULL ELSE locked_by END IS NULL AS unlocked, count(*) AS n, sum(attempt_count)::BIGINT AS attempts
 FROM (SELECT *, coalesce(status = 'RUNNING' AND locked_at < TIMESTAMP '1995-05-31 23:45:00', false) AS old FROM ({_JOBS})) GROUP BY 1, 2""",
        "job_finish": f"""SELECT status, last_error, closed, count(*) AS n FROM (SELECT CASE WHEN NOT hit THEN status WHEN bad AND attempt_count < max_attempts THEN 'QUEUED' WHEN bad THEN 'FAILED' ELSE 'COMPLETED' END AS status,
 CASE WHEN hit AND bad THEN 'boom' END AS last_error, hit AND NOT (bad AND attempt_count < max_attempts) AS closed
 FROM (SELECT *, status = 'RUNNING' AND id::BIGINT % 5 < 3 AS hit, id::BIGINT % 5 > 0 AS bad FROM ({_JOBS}))) GROUP BY ALL""",
        "retry_decision": f"""SELECT id, CASE WHEN NOT hit THEN status WHEN again THEN 'QUEUED' WHEN bad THEN 'FAILED' ELSE 'COMPLETED' END AS status, NOT hit AND locked_by IS NOT NULL AS locked, NOT again AND started_at IS NOT NULL AS started,
 CASE WHEN hit AND bad THEN 'boom' END AS last_error, CASE WHEN again THEN 'QUEUED' WHEN hit AND bad THEN 'FAILED' WHEN hit THEN 'COMPLETED' WHEN status = 'RUNNING' THEN 'RUNNING' ELSE 'QUEUED' END AS scan_status,
 NOT again AND started_at IS NOT NULL AS scan_started, hit AND NOT again AS scan_closed, CASE WHEN hit AND bad AND NOT again THEN CASE WHEN id::BIGINT % 2 = 0 THEN 'INGESTION_FAILED' ELSE 'SCAN_EXECUTION_FAILED' END END AS error_code FROM ({_ENDED})""",
        "failed_scan": f"""SELECT 'scan' || id AS scan_id, CASE WHEN bad THEN 'SCAN_FAILED' ELSE 'SCAN_COMPLETED' END AS event_type,
 CASE WHEN bad THEN '{{"error_code":"' || CASE WHEN id::BIGINT % 2 = 0 THEN 'INGESTION_FAILED' ELSE 'SCAN_EXECUTION_FAILED' END || '","attempts":' || n || '}}' END AS metadata FROM ({_ENDED}) WHERE hit AND NOT again""",
        "stored_findings": f"SELECT id, scan_id AS run, fingerprint, priority, start_line, 2::BIGINT AS number FROM {stored}",
        "job_retry": _JOB_FOLD,
        "job_locks": _LOCK_FOLD,
        "review_fold": _REVIEW_FOLD,
        "review_transitions": f"""SELECT current, wanted, current = wanted OR current || '>' || wanted IN ('OPEN>IN_REVIEW','IN_REVIEW>REVIEWED','IN_REVIEW>OPEN','REVIEWED>IN_REVIEW') AS is_valid, count(*) AS n
 FROM (SELECT CASE key % 3 WHEN 0 THEN 'OPEN' WHEN 1 THEN 'IN_REVIEW' ELSE 'REVIEWED' END AS current, review_move AS wanted FROM ({_MOVES}) WHERE review_move IS NOT NULL) GROUP BY ALL""",
        "scan_cache_hit": _HITS,
        "create_scan": f"""WITH h AS ({_HITS}) SELECT status, source_state, count(*) AS n FROM (SELECT status, CASE WHEN id IN (SELECT cached_scan_id FROM h WHERE cached_scan_id IS NOT NULL) THEN 'CACHED_REAL' ELSE source_state END AS source_state FROM ({_SCANS})
 UNION ALL SELECT 'QUEUED', 'UNAVAILABLE' FROM h WHERE cached_scan_id IS NULL) GROUP BY ALL""",
        "get_or_create": f"SELECT provider, owner, name FROM ({_REPOS}) UNION SELECT provider, owner, name FROM ({_ASKED})",
        "integrity_guard": f"SELECT id, k FROM {stored} WHERE k % 10 = 0",
        "cascade_delete": f"""WITH s AS (SELECT s.repository_id AS asked, r.id AS there FROM ({_SCANS}) s LEFT JOIN ({_REPOS}) r ON s.repository_id = r.id AND r.id <> 'repo3')
 SELECT there AS repository_id, count(*) AS n, 'CASCADE' AS rule FROM s WHERE there IS NOT NULL GROUP BY 1 UNION ALL SELECT there, count(*), 'SET NULL' FROM s GROUP BY 1""",
        "windowed_events": "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL",
    }


def _excerpts() -> str:
    """The line of each hash observation: hand-written line numbers, cut from the snippet's text."""
    rows = [(k, e[1], e[3], t.source.split("\n")[e[1] - 1]) for k, t in enumerate(templates.TEMPLATES) for e in t.expected if e[0] == "HASH"]
    return _values(rows, "template, line, api, excerpt")
