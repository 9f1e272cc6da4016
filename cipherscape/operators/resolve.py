"""Resolution: what names in a file refer to, as joins and aggregates.

Scopes are dotted function names; the module's own scope is ''.  All keys start
with (snapshot_id, path), so one hash partitioning by file serves every join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cipherscape.functions import vocab
from cipherscape.operators.parse import import_map

FILE = ["snapshot_id", "path"]


def resolved(index: Column, chain: Column) -> Column:
    """The full dotted name of a chain whose root is imported, else null."""
    root = F.element_at(index, chain[0])
    rest = F.array_join(F.slice(chain, 2, F.size(chain)), ".")
    return F.when(root.isNotNull(), F.when(F.size(chain) > 1, F.concat(root, F.lit("."), rest)).otherwise(root))


def resolved_text(index: Column, dotted: Column) -> Column:
    return F.when(dotted.isNotNull(), resolved(index, F.split(dotted, r"\.")))


def is_class_body(fn: Column, cls: Column) -> Column:
    """Directly in a class: there is one, and no function inside it."""
    return cls.isNotNull() & (fn.isNull() | F.startswith(cls, F.concat(fn, F.lit("."))))


def scope(fn: Column) -> Column:
    return F.coalesce(fn, F.lit(""))


def function_scopes(symbols: Column) -> Column:
    kinds = F.filter(symbols, lambda s: s["kind"].isin("FUNCTION", "ASYNC_FUNCTION"))
    return F.array_distinct(F.transform(kinds, lambda s: s["qualified_name"]))


def scope_levels(fn: Column, functions: Column) -> Column:
    """The scopes a lookup walks, innermost first: enclosing functions, then the module."""
    parts = F.split(F.coalesce(fn, F.lit("")), r"\.")
    prefixes = F.transform(F.reverse(F.sequence(F.lit(1), F.size(parts))), lambda n: F.array_join(F.slice(parts, 1, n), "."))
    return F.concat(F.filter(prefixes, lambda p: F.array_contains(functions, p)), F.array(F.lit("")))


def with_index(parsed: DataFrame) -> DataFrame:
    """Parsed files that parse, with their import map and function scopes."""
    good = parsed.filter(F.col("error").isNull())
    return good.withColumn("index", import_map(F.col("imports"))).withColumn("functions", function_scopes(F.col("symbols")))


def calls(files: DataFrame) -> DataFrame:
    """Calls with what they resolve to, the levels of their scope, and their arguments' resolved callees."""
    rows = files.select(*FILE, "module_path", "index", "functions", F.explode("calls").alias("c"))
    return rows.select(
        *FILE, "module_path", F.col("c.ord").alias("call"), "c.loc", "c.chain", "c.attribute", "c.fn", "c.cls", scope(F.col("c.fn")).alias("scope"),
        scope_levels(F.col("c.fn"), F.col("functions")).alias("levels"), resolved(F.col("index"), F.col("c.chain")).alias("resolved"),
        F.transform("c.args", lambda a: resolved(F.col("index"), a["call_chain"])).alias("arg_calls"),
        F.transform(F.filter("c.args", lambda a: a["is_name"]), lambda a: a["expression"]).alias("arg_names"),
    )


def candidates(files: DataFrame) -> DataFrame:
    """Assignments of one bare name outside class bodies, with what their value resolves to."""
    rows = files.select(*FILE, "index", "functions", F.explode("assignments").alias("a")).filter(F.col("a.is_name") & ~is_class_body(F.col("a.fn"), F.col("a.cls")))
    return rows.select(
        *FILE, scope(F.col("a.fn")).alias("scope"), F.col("a.targets")[0].alias("name"), "a.loc", "a.ord", "a.value_call",
        F.when(F.col("a.value_is_name"), F.col("a.value_expression")).alias("value_name"), scope_levels(F.col("a.fn"), F.col("functions")).alias("levels"),
        resolved_text(F.col("index"), F.col("a.value_call")).alias("made_by"),
        F.transform("a.cipher_args", lambda c: resolved(F.col("index"), c)).alias("cipher_args"),
    )


def locally_bound(files: DataFrame) -> DataFrame:
    """(file, scope, name): parameters, and names stored or deleted in the scope."""
    params = files.select(*FILE, F.explode("symbols").alias("s")).filter("s.params is not null")
    params = params.select(*FILE, F.col("s.qualified_name").alias("scope"), F.explode("s.params").alias("name"))
    stored = files.select(*FILE, F.explode("names").alias("n")).filter("n.context in ('STORE', 'DELETE')").select(*FILE, scope(F.col("n.fn")).alias("scope"), "n.name")
    return params.union(stored).distinct()


def annotation_bindings(files: DataFrame) -> DataFrame:
    """(file, rule, scope, name, kind): names annotated with a key class; disagreement cancels."""
    spark = files.sparkSession
    known = vocab.rows_of(spark, [(vocab.ROOT + m + "." + c, rule, kind) for rule, m, c, kind in vocab.CLASSES], "resolved,rule_id,kind")
    rows = files.select(*FILE, "index", F.explode("annotations").alias("a")).filter(F.col("a.is_name") & ~is_class_body(F.col("a.fn"), F.col("a.cls")))
    rows = rows.select(*FILE, scope(F.col("a.fn")).alias("scope"), F.col("a.target").alias("name"), resolved(F.col("index"), F.col("a.chain")).alias("resolved"))
    found = rows.join(F.broadcast(known), "resolved").groupBy(*FILE, "rule_id", "scope", "name").agg(F.collect_set("kind").alias("kinds"))
    return found.filter(F.size("kinds") == 1).select(*FILE, "rule_id", "scope", "name", F.col("kinds")[0].alias("kind"))


def constructed(cands: DataFrame) -> DataFrame:
    """Candidates whose value is a constructor call of a rule, with (rule_id, kind)."""
    spark = cands.sparkSession
    known = vocab.rows_of(spark, [(vocab.ROOT + m + "." + c, rule, kind) for rule, m, c, kind in vocab.CONSTRUCTORS], "made_by,rule_id,kind")
    return cands.join(F.broadcast(known), "made_by")


def direct_bindings(cands: DataFrame, made: DataFrame) -> DataFrame:
    """(file, rule, scope, name, kind): every assignment of the name makes the same kind of key."""
    key = [*FILE, "scope", "name"]
    all_of = cands.groupBy(*key).agg(F.count("*").alias("n"))
    own = made.groupBy(*FILE, "rule_id", "scope", "name").agg(F.count("*").alias("m"), F.min("kind").alias("kind"), F.max("kind").alias("other"))
    return own.join(all_of, key).filter("m = n and kind = other").select(*FILE, "rule_id", "scope", "name", "kind")


def lookup(rows: DataFrame, key: list[str], bindings: DataFrame, bound: DataFrame) -> DataFrame:
    """key and found for rows (file, rule_id, key..., levels, wanted): what ``wanted`` holds there.

    The innermost level that binds the name decides; a name bound by something
    unknown stops the walk, and a binding beats that on its own level.
    """
    walk = rows.select(*FILE, "rule_id", *key, F.col("wanted").alias("name"), F.posexplode("levels").alias("depth", "scope"))
    value = F.struct(*[F.col(c) for c in bindings.columns if c not in (*FILE, "rule_id", "scope", "name")])
    held = bindings.select(*FILE, "rule_id", "scope", "name", value.alias("value"))
    walk = walk.join(held, [*FILE, "rule_id", "scope", "name"], "left").join(bound.withColumn("blocks", F.lit(True)), [*FILE, "scope", "name"], "left")
    stops = walk.filter(F.col("value").isNotNull() | F.col("blocks"))
    found = stops.groupBy(*FILE, "rule_id", *key).agg(F.min_by(F.struct("value"), "depth").alias("stop"))
    return found.select(*FILE, "rule_id", *key, F.col("stop.value").alias("found")).filter("found is not null")


def second_pass(cands: DataFrame, made: DataFrame, annotated: DataFrame, direct: DataFrame, bound: DataFrame) -> DataFrame:
    """(file, rule, scope, name, kind, basis) from derivations and aliases, one hop.

    Only assignments that construct nothing are folded, in source order: an
    unknown so far takes the next outcome, an equal kind keeps the first, and
    anything else is unknown.
    """
    spark = cands.sparkSession
    active = annotated.select(*FILE, "rule_id").union(made.select(*FILE, "rule_id")).distinct()
    other = cands.join(active, FILE).join(made.select(*FILE, "rule_id", "ord"), [*FILE, "rule_id", "ord"], "left_anti")
    derive = vocab.rows_of(spark, vocab.DERIVATIONS, "method,source,target")
    parts = F.split("value_call", r"\.")
    other = other.withColumn("method", F.when(F.size(parts) == 2, parts[1])).join(F.broadcast(derive), "method", "left")
    other = other.withColumn("wanted", F.when(F.col("target").isNotNull(), parts[0]).otherwise(F.col("value_name")))
    asked = other.filter("wanted is not null")
    seen = lookup(asked, ["ord"], annotated, bound).select(*FILE, "rule_id", "ord", F.col("found.kind").alias("seen"))
    beside = direct.select(*FILE, "rule_id", "scope", F.col("name").alias("wanted"), F.col("kind").alias("beside"))
    asked = other.join(seen, [*FILE, "rule_id", "ord"], "left").join(beside, [*FILE, "rule_id", "scope", "wanted"], "left")
    kind = F.coalesce("seen", "beside")
    derived = F.when(F.col("target").isNotNull(), F.when(kind == F.col("source"), F.struct(F.col("target").alias("kind"), F.lit("CONSTRUCTOR_ASSIGNMENT").alias("basis"))))
    aliased = F.when(F.col("target").isNull() & kind.isNotNull(), F.struct(kind.alias("kind"), F.lit("ESTABLISHED_ALIAS").alias("basis")))
    steps = asked.select(*FILE, "rule_id", "scope", "name", F.struct("loc", "ord", F.coalesce(derived, aliased).alias("e")).alias("step"))
    folded = steps.groupBy(*FILE, "rule_id", "scope", "name").agg(F.array_sort(F.collect_list("step")).alias("steps"))
    none = F.lit(None).cast("struct<kind:string,basis:string>")

    def merged(held: Column, step: Column) -> Column:
        e = step["e"]
        return F.when(held.isNull(), e).when(e["kind"] == held["kind"], held).otherwise(none)

    return folded.withColumn("e", F.aggregate("steps", none, merged)).filter("e is not null").select(*FILE, "rule_id", "scope", "name", "e.kind", "e.basis")


def key_bindings(files: DataFrame, cands: DataFrame, bound: DataFrame) -> DataFrame:
    """(file, rule, scope, name, kind, basis, confidence): an annotation beats assignments."""
    annotated, made = annotation_bindings(files), constructed(cands)
    direct = direct_bindings(cands, made)
    later = second_pass(cands, made, annotated, direct, bound)
    key = [*FILE, "rule_id", "scope", "name"]
    assigned = direct.withColumn("basis", F.lit("CONSTRUCTOR_ASSIGNMENT")).unionByName(later).withColumn("confidence", F.lit("MEDIUM"))
    first = annotated.withColumn("basis", F.lit("CLASS_ANNOTATION")).withColumn("confidence", F.lit("HIGH"))
    return first.unionByName(assigned.join(annotated.select(*key), key, "left_anti"))


def marker_names(cands: DataFrame) -> DataFrame:
    """(file, rule, scope, name): names that only ever hold a marker object."""
    spark = cands.sparkSession
    markers = vocab.rows_of(spark, sorted({(vocab.ROOT + m, rule) for rule, _, m, _, _ in vocab.MARKERS}), "marker,rule_id")
    holds = cands.groupBy(*FILE, "scope", "name").agg(F.min("made_by").alias("marker"), F.max("made_by").alias("other"), F.count("*").alias("n"), F.count("made_by").alias("m"))
    return holds.filter("n = m and marker = other").join(F.broadcast(markers), "marker").select(*FILE, "rule_id", "scope", "name")


def aes_contexts(cands: DataFrame) -> DataFrame:
    """(file, scope, name, kind): names that only ever hold one kind of AES context."""
    cipher = (F.col("made_by") == vocab.ROOT + "ciphers.Cipher") & F.exists("cipher_args", lambda c: F.coalesce(c.isin(*[f"{vocab.ROOT}ciphers.algorithms.{a}" for a in vocab.AES_BLOCK]), F.lit(False)))
    aead = F.col("made_by").isin(*[f"{vocab.ROOT}ciphers.aead.{a}" for a in vocab.AES_AEAD])
    kinds = cands.withColumn("kind", F.when(cipher, "CIPHER").when(aead, "AEAD"))
    held = kinds.groupBy(*FILE, "scope", "name").agg(F.count("*").alias("n"), F.count("kind").alias("m"), F.min("kind").alias("kind"), F.max("kind").alias("other"))
    return held.filter("n = m and kind = other").select(*FILE, "scope", "name", "kind")
