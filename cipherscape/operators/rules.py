"""Detection rules: calls to matches, each rule a join with its dimension rows.

A call may match several rules; within one rule a call that names its evidence in
full is never matched a second time through its receiver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from cipherscape.functions import vocab
from cipherscape.operators import resolve
from cipherscape.operators.resolve import FILE

COLUMNS = [
    "rule_id", "ruleset_version", "algorithm", "primitive", "library", "api", "operation", "confidence", "evidence_basis",
    "enclosing_function", "enclosing_class", "loc", "call", "module_path",
]
ORDER = ["path", "start_line", "start_column", "rule_id", "api", "operation", "end_line", "end_column", "call"]


class Context:
    """What the rules read of the files: built once, evaluated where a rule needs it."""

    def __init__(self, parsed: DataFrame):
        self.spark = parsed.sparkSession
        # every key begins with the file: tables that lie by file need no exchange for keys that go on after it
        self.spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
        self.files = resolve.with_index(parsed)
        self.calls = resolve.calls(self.files)
        self.candidates = resolve.candidates(self.files)
        self.bound = resolve.locally_bound(self.files)
        self.bindings = resolve.key_bindings(self.files, self.candidates, self.bound)


def match(rows: DataFrame, rule: str | Column, algorithm: str | Column, api: Column, operation: Column, confidence: str | Column, basis: str | Column) -> DataFrame:
    """Rows of calls as matches."""
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    algorithm = as_column(algorithm)
    return rows.select(
        *FILE, as_column(rule).alias("rule_id"), F.lit(vocab.RULESET_VERSION).alias("ruleset_version"), algorithm.alias("algorithm"),
        F.when(as_column(rule) == vocab.HASH, "HASH").otherwise(algorithm).alias("primitive"), F.lit(vocab.LIBRARY).alias("library"), api.alias("api"),
        operation.alias("operation"), as_column(confidence).alias("confidence"), as_column(basis).alias("evidence_basis"),
        F.col("fn").alias("enclosing_function"), F.col("cls").alias("enclosing_class"), "loc", "call", "module_path",
    )


def direct(context: Context, rules: list[str] | None = None) -> DataFrame:
    """Calls that resolve to a member of a rule: generators, class methods, AES and hash constructions."""
    rows = [r for r in vocab.direct_rows() if rules is None or r[1] in rules]
    known = vocab.rows_of(context.spark, rows, "resolved,rule_id,algorithm,api,operation,basis")
    found = context.calls.join(F.broadcast(known), "resolved")
    return match(found, F.col("rule_id"), F.col("algorithm"), F.col("api"), F.col("operation"), "HIGH", F.col("basis"))


def _not_direct(calls: DataFrame, rules: list[str]) -> DataFrame:
    """Calls with the rule that matches them in full, if one of ``rules`` does."""
    spark = calls.sparkSession
    known = vocab.rows_of(spark, [(r[0], r[1]) for r in vocab.direct_rows() if r[1] in rules], "resolved,direct_rule")
    return calls.join(F.broadcast(known), "resolved", "left")


def receivers(context: Context, rules: list[str]) -> DataFrame:
    """Methods of names that hold a key of the kind the method takes."""
    rows = [(r, m, op, k, cls, a) for r, m, op, k, cls in vocab.METHODS if r in rules for n, a, _ in vocab.RULES if n == r]
    methods = vocab.rows_of(context.spark, rows, "rule_id,method,operation,kind,cls_name,algorithm")
    two = context.calls.filter(F.size("chain") == 2).withColumn("method", F.col("chain")[1]).withColumn("wanted", F.col("chain")[0])
    asked = _not_direct(two, rules).join(F.broadcast(methods), "method").filter("direct_rule is null or direct_rule <> rule_id")
    found = resolve.lookup(asked, ["call"], context.bindings, context.bound)
    held = asked.join(found, [*FILE, "rule_id", "call"]).filter(F.col("found.kind") == F.col("kind"))
    return match(held, F.col("rule_id"), F.col("algorithm"), F.concat_ws(".", "cls_name", "method"), F.col("operation"), F.col("found.confidence"), F.col("found.basis"))


def key_rule(context: Context, rule: str) -> DataFrame:
    return direct(context, [rule]).unionByName(receivers(context, [rule]))


def marker_rule(context: Context, rules: list[str]) -> DataFrame:
    """Key operations that are given a marker object: in place, or by a name that only ever holds one."""
    rows = [(r, a, vocab.ROOT + m, method, op) for r, a, m, method, op in vocab.MARKERS if r in rules]
    known = vocab.rows_of(context.spark, rows, "rule_id,algorithm,marker,attribute,operation")
    asked = context.calls.join(F.broadcast(known), "attribute").withColumn("in_place", F.coalesce(F.array_contains("arg_calls", F.col("marker")), F.lit(False)))
    named = asked.filter(~F.col("in_place")).select(*FILE, "rule_id", "call", "scope", F.explode("arg_names").alias("name"))
    named = named.join(resolve.marker_names(context.candidates), [*FILE, "rule_id", "scope", "name"]).select(*FILE, "rule_id", "call").distinct()
    found = asked.join(named.withColumn("by_name", F.lit(True)), [*FILE, "rule_id", "call"], "left").filter("in_place or by_name")
    return match(
        found, F.col("rule_id"), F.col("algorithm"), F.concat_ws(".", "algorithm", "attribute"), F.col("operation"),
        F.when(F.col("in_place"), "HIGH").otherwise("MEDIUM"), F.when(F.col("in_place"), "DIRECT_MODULE_API").otherwise("CONSTRUCTOR_ASSIGNMENT"),
    )


def aes_rule(context: Context) -> DataFrame:
    """AES constructions, and methods of names that hold an AES context in this scope or the module's."""
    two = context.calls.filter(F.size("chain") == 2).withColumn("method", F.col("chain")[1]).withColumn("name", F.col("chain")[0])
    two = _not_direct(two, [vocab.AES]).filter("direct_rule is null")
    held = resolve.aes_contexts(context.candidates)
    near = held.withColumnRenamed("kind", "near")
    outer = held.filter("scope = ''").select(*FILE, "name", F.col("kind").alias("outer"))
    found = two.join(near, [*FILE, "scope", "name"], "left").join(outer, [*FILE, "name"], "left").withColumn("kind", F.coalesce("near", "outer"))
    methods = vocab.rows_of(context.spark, vocab.AES_METHODS, "kind,method,operation,api")
    found = found.join(F.broadcast(methods), ["kind", "method"])
    contexts = match(found, vocab.AES, "AES", F.col("api"), F.col("operation"), "MEDIUM", "CONSTRUCTOR_ASSIGNMENT")
    return direct(context, [vocab.AES]).unionByName(contexts)


def hash_rule(context: Context) -> DataFrame:
    return direct(context, [vocab.HASH])


#: What a rule in code says of a call.
_SAID = ["algorithm", "api", "operation", "confidence", "evidence_basis"]


def in_code(rule_id: str, code: Callable[[list[Row]], Iterable[tuple]]) -> Callable[[Context], DataFrame]:
    """A rule written in Python, as a table function over calls, partitioned by file.

    ``code`` gets a file's calls in order (call, chain, attribute, scope, levels, resolved, arg_calls, arg_names, fn, cls,
    loc, ...) and yields (call, algorithm, api, operation, confidence, evidence_basis) for those it finds; any number
    for a call.  Its schema is that of the calls with these columns, so columns added to calls reach rules unasked.  A file's
    calls are held by one task, no more.
    """

    class Rule:
        @staticmethod
        def analyze(calls: AnalyzeArgument) -> AnalyzeResult:
            schema = StructType(list(calls.dataType.fields))
            for name in _SAID:
                schema = schema.add(name, StringType())
            return AnalyzeResult(schema, partitionBy=[PartitioningColumn(c) for c in FILE], orderBy=[OrderingColumn("call")])

        def __init__(self):
            self.calls: list[Row] = []

        def eval(self, calls: Row) -> None:
            self.calls.append(calls)

        def terminate(self) -> Iterator[tuple]:
            own = {c["call"]: c for c in self.calls}
            for call, *said in code(self.calls):
                yield (*own[call], *said)

    def rule(context: Context) -> DataFrame:
        found = F.udtf(Rule)(context.calls.asTable())
        return match(found, rule_id, F.col("algorithm"), F.col("api"), F.col("operation"), F.col("confidence"), F.col("evidence_basis"))

    return rule


#: The rules by id; a rule is a function of Context that returns matches.
REGISTRY: dict[str, Callable[[Context], DataFrame]] = {
    vocab.AES: aes_rule,
    vocab.ECDH: lambda c: marker_rule(c, [vocab.ECDH]),
    vocab.ECDSA: lambda c: marker_rule(c, [vocab.ECDSA]),
    vocab.ED25519: lambda c: key_rule(c, vocab.ED25519),
    vocab.HASH: hash_rule,
    vocab.RSA: lambda c: key_rule(c, vocab.RSA),
    vocab.X25519: lambda c: key_rule(c, vocab.X25519),
}
_BUILT_IN = dict(REGISTRY)


def register_rule(rule_id: str, rule: Callable[[Context], DataFrame]) -> None:
    """Add a rule, or replace the one of that id."""
    REGISTRY[rule_id] = rule


def matches(parsed: DataFrame, rules: list[str] | None = None) -> DataFrame:
    """All matches of the parsed files.

    The built-in rules of one shape share a plan, so seven rules read the calls
    four times and not seven.
    """
    context = Context(parsed)
    wanted = sorted(REGISTRY) if rules is None else rules
    own = [r for r in wanted if REGISTRY[r] is _BUILT_IN.get(r)]
    keys = [r for r in own if r in (vocab.RSA, vocab.ED25519, vocab.X25519)]
    markers = [r for r in own if r in (vocab.ECDSA, vocab.ECDH)]
    parts = []
    if named := [r for r in own if r not in markers and r != vocab.AES]:
        parts.append(direct(context, named))
    if keys:
        parts.append(receivers(context, keys))
    if markers:
        parts.append(marker_rule(context, markers))
    if vocab.AES in own:
        parts.append(aes_rule(context))
    parts += [REGISTRY[r](context) for r in wanted if r not in own]
    return reduce(DataFrame.unionByName, parts)
