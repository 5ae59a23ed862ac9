"""The maintainability rules as DataFrame queries over the fact rows.

A rule is a function of Tables that returns findings: rel, line, function, signal, message columns.
`RULES` is the catalog: signal -> (severity, family, rule). Families collect variants for suppression
and display. Thresholds are inclusive.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orelode.functions import text as T
from orelode.operators import graphs, similarity
from orelode.sources import constants as C

FINDING = ["rel", "line", "function", "signal", "severity", "message"]


def has(flag: str) -> Column:
    return F.array_contains("flags", flag)


class Tables:
    """The fact rows by kind; `prod` leaves test files out. files: rel, content; graph and history tables are optional."""

    def __init__(self, facts: DataFrame, docs: DataFrame | None = None, churn: DataFrame | None = None, coverage: DataFrame | None = None, nodes: DataFrame | None = None, edges: DataFrame | None = None):
        self.facts = facts.withColumn("is_test", T.is_test_core(F.col("rel")))
        self.docs, self.churn, self.coverage, self.nodes, self.edges = docs, churn, coverage, nodes, edges

    def kind(self, name: str) -> DataFrame:
        return self.facts.filter(F.col("kind") == name)

    def prod(self, name: str) -> DataFrame:
        return self.kind(name).filter(~F.col("is_test"))

    def tests(self, name: str) -> DataFrame:
        return self.kind(name).filter("is_test")

    @cached_property
    def refs(self) -> DataFrame:
        """Distinct reference names by population: one shuffle serves all liveness rules."""
        return self.kind("ref").groupBy("name").agg(F.bool_or(~F.col("is_test")).alias("in_prod"), F.bool_or("is_test").alias("in_test"))


Rule = Callable[[Tables], DataFrame]
RULES: dict[str, tuple[str, str, Rule]] = {}


def rule(signal: str, severity: str, family: str = ""):
    def add(f: Rule) -> Rule:
        RULES[signal] = (severity, family or signal, f)
        return f

    return add


def out(df: DataFrame, message: Column | str, line: Column | str = "line", function: Column | str = "owner", severity: Column | None = None) -> DataFrame:
    """Findings with the severity left null where the catalog's holds."""
    col = lambda x: F.col(x) if isinstance(x, str) else x
    return df.select("rel", col(line).cast("int").alias("line"), col(function).alias("function"), (F.lit(message) if isinstance(message, str) else message).alias("message"), (severity if severity is not None else F.lit(None).cast("string")).alias("own_severity"))


def msg(template: str, *columns: str) -> Column:
    return F.format_string(template, *[F.col(c) for c in columns])


# -- functions and classes ----------------------------------------------------


@rule("complexity", "fail")
def complexity(t: Tables) -> DataFrame:
    return out(t.prod("function").filter("b >= 15"), msg("complexity %d", "b"), function="name")


@rule("long-param-list", "fail")
def long_param_list(t: Tables) -> DataFrame:
    return out(t.prod("function").filter((F.col("a") > 5) & ~has("stub")), msg("%d parameters", "a"), function="name")


@rule("large-function", "fail")
def large_function(t: Tables) -> DataFrame:
    return out(t.prod("function").filter("end - line + 1 > 120"), "a function of over 120 lines", function="name")


def _definitions(t: Tables) -> DataFrame:
    """Definitions of a module; one class beside records without methods is one concern."""
    classes = t.prod("class").filter("owner = ''").groupBy("rel").agg(F.count(F.lit(1)).alias("types"), F.count_if(F.col("a") > 0).alias("live_types"))
    functions = t.prod("function").filter((F.col("owner") == "") & ~has("decorated")).groupBy("rel").agg(F.count(F.lit(1)).alias("free"))
    modules = t.prod("module").filter(~has("generated")).select("rel")
    counts = modules.join(classes, "rel", "left").join(functions, "rel", "left").fillna(0)
    return counts.withColumn("n", F.col("types") + F.col("free")).filter("free >= 2 or live_types >= 2 or (types >= 1 and free >= 1 and types > free)").withColumn("owner", F.lit(""))


@rule("several-definitions", "warn")
def several_definitions(t: Tables) -> DataFrame:
    return out(_definitions(t).filter("n between 3 and 10"), msg("%d definitions in a module", "n"), F.lit(1))


@rule("many-definitions", "warn")
def many_definitions(t: Tables) -> DataFrame:
    return out(_definitions(t).filter("n >= 11"), msg("%d definitions in a module", "n"), F.lit(1))


@rule("closures", "fail", "latent-class")
def closures(t: Tables) -> DataFrame:
    return out(t.prod("function").filter((F.col("c") >= 2) & ((F.col("b") >= 15) | (F.col("end") - F.col("line") + 1 >= 60) | has("captures"))), msg("%d inner functions", "c"), function="name")


@rule("strewing", "fail", "latent-class")
def strewing(t: Tables) -> DataFrame:
    free = t.prod("function").filter("owner = '' and a >= 1").withColumn("type", F.substring_index(F.get("items", F.lit(0)), ":", -1))
    own = t.prod("class").select("rel", F.col("name").alias("type"))
    groups = free.join(own, ["rel", "type"], "left_semi").groupBy("rel", "type").agg(F.count(F.lit(1)).alias("n"), F.min("line").alias("line")).filter("n >= 3")
    return out(groups, msg("%d functions take %s first", "n", "type"), function="type")


@rule("misplaced-method", "fail", "latent-class")
def misplaced_method(t: Tables) -> DataFrame:
    calls = t.prod("call").filter("a >= 1 and owner like '%.%'").filter(F.forall("items", lambda x: x.startswith("self.")))
    functions = t.prod("function").filter("owner = '' and a >= 1").select("rel", "name", "a", F.col("line").alias("at"))
    return out(calls.join(functions, ["rel", "name", "a"]).groupBy("rel", "name").agg(F.min("at").alias("line")), "every argument is the caller's own state", function="name")


@rule("assembly-class", "fail", "latent-class")
def assembly_class(t: Tables) -> DataFrame:
    functions = t.prod("function").filter("owner = ''").select("rel", "name")
    calls = t.prod("call").filter("text <> ''").join(functions, ["rel", "name"], "left_semi").select("rel", "owner", "name", "text", "line", F.explode("items").alias("arg"))
    threaded = calls.filter("arg <> '?'").groupBy("rel", "owner", "arg").agg(F.countDistinct("name").alias("fns"), F.countDistinct("text").alias("results"), F.min("line").alias("line")).filter("fns >= 2 and results >= 3")
    return out(threaded.groupBy("rel", "owner").agg(F.min("line").alias("line")), "data threaded through module functions")


@rule("tuple-record", "fail", "latent-class")
def tuple_record(t: Tables) -> DataFrame:
    reads = t.prod("index_read").groupBy("rel", "name").agg(F.count(F.lit(1)).alias("reads")).filter("reads >= 3")
    return out(t.prod("tuple_dict").join(reads, ["rel", "name"]), msg("tuples of %d read by index", "a"), function="name")


@rule("wide-tuple", "fail", "latent-class")
def wide_tuple(t: Tables) -> DataFrame:
    return out(t.prod("tuple_type").filter("a >= 3"), msg("a tuple of %d", "a"), severity=F.when(F.col("a") == 3, "warn"))


@rule("data-clump", "fail", "latent-class")
def data_clump(t: Tables) -> DataFrame:
    """Pairs come from each function's own sorted parameter array."""
    f = t.prod("function").filter("owner = ''").select("rel", "name", "line", F.array_sort("items").alias("ps")).filter("size(ps) >= 2")
    pairs = F.flatten(F.transform("ps", lambda x, i: F.transform(F.slice("ps", i + 2, F.size("ps")), lambda y: F.concat_ws(", ", x, y))))
    groups = f.select("rel", "name", "line", F.explode(pairs).alias("pair")).groupBy("pair").agg(F.countDistinct("rel", "name").alias("n"), F.min(F.struct("rel", "line", "name")).alias("s")).filter("n >= 3")
    anchors = groups.groupBy(F.col("s.rel").alias("rel"), F.col("s.line").alias("line"), F.col("s.name").alias("owner")).agg(F.array_join(F.array_sort(F.collect_set("pair")), "; ").alias("pairs"))
    return out(anchors, msg("parameters travel together: %s", "pairs"))


@rule("feature-envy", "fail", "latent-class")
def feature_envy(t: Tables) -> DataFrame:
    envy = t.prod("alias_read").groupBy("rel", F.col("owner").alias("cls"), F.col("text").alias("method"), F.get("items", F.lit(1)).alias("other")).agg(F.count(F.lit(1)).alias("n"), F.min("line").alias("line"))
    own = t.prod("self_attr").filter(has("load")).groupBy("rel", F.col("owner").alias("cls"), F.col("text").alias("method")).agg(F.count(F.lit(1)).alias("own"))
    return out(envy.join(own, ["rel", "cls", "method"]).filter("n >= 4 and own >= 1 and n >= own + 3"), msg("%d reads of %s", "n", "other"), function="method")


def _lineage(t: Tables) -> DataFrame:
    """(rel, name, up_rel, up_name): each class with its ancestors and itself; base names resolve in the file, then by import of a unique name."""
    classes = t.kind("class").select("rel", "name", F.transform("items", lambda b: F.substring_index(b, ".", -1)).alias("bases"))
    key = F.concat_ws("::", "rel", "name")
    unique = classes.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("other")).filter("n = 1").select(F.col("name").alias("base"), "other")
    links = classes.select("rel", "name", F.explode("bases").alias("base"))
    same = classes.select("rel", F.col("name").alias("base"), key.alias("here"))
    edges = links.join(same, ["rel", "base"], "left").join(unique, "base", "left").select(F.concat_ws("::", "rel", "name").alias("src"), F.coalesce("here", "other").alias("dst")).filter("dst is not null and src <> dst")
    edges = graphs.settle(edges.distinct())
    known = graphs.settle(classes.select(key.alias("cls"), key.alias("up")).distinct())
    frontier = known
    while True:
        found = frontier.join(edges, F.col("up") == F.col("src")).select("cls", F.col("dst").alias("up")).distinct()
        frontier = graphs.settle(found.join(known, ["cls", "up"], "left_anti"))
        if frontier.isEmpty():
            return known
        known = graphs.settle(known.union(frontier))


@rule("undeclared-attribute", "fail")
def undeclared_attribute(t: Tables) -> DataFrame:
    stores = t.prod("self_attr").filter(has("store") & ~has("init")).groupBy(F.concat_ws("::", "rel", "owner").alias("cls"), "rel", "owner", "name").agg(F.min("line").alias("line"))
    declared = t.kind("field").select(F.concat_ws("::", "rel", "owner").alias("up"), "name").union(t.kind("self_attr").filter(has("store") & has("init")).select(F.concat_ws("::", "rel", "owner"), "name")).distinct()
    inherited = _lineage(t).join(declared, "up").select("cls", "name").distinct()
    return out(stores.join(inherited, ["cls", "name"], "left_anti"), msg("%s is not declared", "name"))


@rule("sibling-value-class", "warn")
def sibling_value_class(t: Tables) -> DataFrame:
    """Classes of one directory that share two fields and two equal accessors; equi-joins on directory and member."""
    folder = F.regexp_extract("rel", "^(.*)/", 1)
    fields = t.prod("field").union(t.prod("self_attr").filter(has("store") & has("init"))).select(folder.alias("dir"), "rel", F.col("owner").alias("cls"), F.concat(F.lit("f:"), "name").alias("m")).distinct()
    accessors = t.prod("method").filter("name not like '\\_\\_%'").select(folder.alias("dir"), "rel", F.col("owner").alias("cls"), F.concat(F.lit("m:"), "name", F.array_join("items", " ")).alias("m")).distinct()
    related = t.prod("class").select("rel", F.col("name").alias("cls"), F.filter("items", lambda b: ~F.substring_index(b, ".", -1).isin(*C.FRAMEWORK_BASES)).alias("bases")).filter("size(bases) = 0").select("rel", "cls")
    members = fields.union(accessors).join(related, ["rel", "cls"], "left_semi")
    a, b = members.alias("a"), members.alias("b")
    before = F.struct("a.rel", "a.cls") < F.struct("b.rel", "b.cls")
    pairs = a.join(b, (F.col("a.dir") == F.col("b.dir")) & (F.col("a.m") == F.col("b.m")) & before).groupBy(F.col("a.rel").alias("rel"), F.col("a.cls").alias("owner"), F.col("b.cls").alias("other")).agg(F.count_if(F.col("a.m").startswith("f:")).alias("shared"), F.count_if(F.col("a.m").startswith("m:")).alias("equal")).filter("shared >= 2 and equal >= 2")
    return out(pairs.join(t.prod("class").select("rel", F.col("name").alias("owner"), "line"), ["rel", "owner"]), msg("shares %d fields with %s", "shared", "other"))


@rule("duplicate-field", "fail", "latent-class")
def duplicate_field(t: Tables) -> DataFrame:
    fields = t.prod("field").select("rel", "owner", "name", "text", "line")
    inner = fields.select("rel", F.col("owner").alias("part"), "name")
    holds = fields.select("rel", "owner", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"(\w+)"), F.lit(1)))).alias("part")).filter("part <> owner").distinct()
    shared = holds.join(inner, ["rel", "part"]).join(fields.select("rel", "owner", "name", "line"), ["rel", "owner", "name"]).groupBy("rel", "owner", "part").agg(F.count(F.lit(1)).alias("n"), F.min("line").alias("line")).filter("n >= 2")
    return out(shared, msg("%d fields also in %s", "n", "part"))


@rule("partition", "fail", "latent-class")
def partition(t: Tables) -> DataFrame:
    """Methods linked by fields they share form components; two groups of two methods and two fields each split a class (no connector removed here)."""
    classes = t.prod("class").filter("a >= 6 and end - line + 1 >= 150").select("rel", F.col("name").alias("owner"), "line")
    uses = t.prod("self_attr").filter(~has("init")).select("rel", "owner", F.col("text").alias("method"), "name").distinct().join(classes, ["rel", "owner"])
    node = F.concat_ws("::", "rel", "owner", "method")
    edges = uses.select(node.alias("src"), F.concat_ws("::", "rel", "owner", F.concat(F.lit("."), "name")).alias("dst"))
    labels = graphs.components(edges)
    groups = labels.withColumn("field", F.col("node").contains("::.")).withColumn("cls", F.regexp_extract("node", "^(.*)::", 1)).groupBy("cls", "label").agg(F.count_if("field").alias("fields"), F.count_if(~F.col("field")).alias("methods")).filter("fields >= 2 and methods >= 2").groupBy("cls").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2")
    return out(classes.withColumn("cls", F.concat_ws("::", "rel", "owner")).join(groups, "cls"), msg("methods fall into %d groups", "n"))


@rule("record-shape", "fail")
def record_shape(t: Tables) -> DataFrame:
    exempt = t.prod("function").filter("name rlike 'from_dict|from_json|to_dict|to_json'").select("rel", F.concat_ws(".", F.when(F.col("owner") != "", F.col("owner")), "name").alias("owner"))
    types = t.prod("record_type").union(t.prod("tuple_type").filter("a >= 2")).select("rel", "owner", "line", F.concat(F.lit("a record without a name: "), "name").alias("m"))
    literals = t.prod("record_literal").select("rel", "owner", "line", F.format_string("a literal of %d keys is a record", "a").alias("m"))
    return out(types.union(literals).join(exempt.distinct(), ["rel", "owner"], "left_anti"), F.col("m"))


@rule("detached-method", "warn")
def detached_method(t: Tables) -> DataFrame:
    free = has("method") & ~has("static") & ~has("classmethod") & ~has("uses_receiver") & ~has("stub") & ~has("super") & ~has("abstract") & ~has("override") & ~has("property") & ~F.col("name").startswith("__")
    return out(t.prod("function").filter(free), "never uses its receiver", function="name")


@rule("duplicate", "warn")
def duplicate(t: Tables) -> DataFrame:
    """The first later partner of Dice 0.9; nested functions of one file aren't partners."""
    # ids that sort as files and lines do; no window over all rows
    key = F.format_string("%s\x01%09d\x01%s", "rel", "line", "name")
    skeletons = t.prod("skeleton").select(key.alias("id"), "rel", "name", "line", "end", F.col("items").alias("tokens"))
    pairs = similarity.dice_pairs(skeletons, "id", "tokens")
    a = skeletons.select(F.col("id").alias("a"), "rel", "line", "end", "name")
    b = skeletons.select(F.col("id").alias("b"), F.col("rel").alias("rel_b"), F.col("line").alias("line_b"), F.col("end").alias("end_b"), F.col("name").alias("name_b"))
    apart = pairs.join(a, "a").join(b, "b").filter("rel <> rel_b or line_b > end or line > end_b")
    first = apart.groupBy("rel", "line", "name").agg(F.min_by(F.concat_ws(":", "rel_b", "name_b"), "b").alias("other"))
    return out(first, msg("near-duplicate of %s", "other"), function="name")


@rule("duplicate-module", "fail")
def duplicate_module(t: Tables) -> DataFrame:
    """Forks of a class: equal names of members and fields across files, both non-empty."""
    members = t.prod("method").union(t.prod("field")).groupBy("rel", "owner").agg(F.array_sort(F.collect_set(F.concat_ws(":", "kind", "name"))).alias("members")).filter("size(members) >= 3")
    bodies = t.prod("method").groupBy("rel", "owner").agg(F.xxhash64(F.to_json(F.array_sort(F.collect_list(F.concat("name", F.array_join("items", " ")))))).alias("h"))
    forks = members.join(bodies, ["rel", "owner"])
    first = forks.groupBy("members", "h").agg(F.min(F.struct("rel", "owner")).alias("s"), F.countDistinct("rel").alias("n")).filter("n >= 2")
    later = forks.join(first, ["members", "h"]).filter("rel > s.rel").join(t.prod("class").select("rel", F.col("name").alias("owner"), "line"), ["rel", "owner"])
    return out(later, F.concat(F.lit("fork of "), F.col("s.rel"), F.lit(":"), F.col("s.owner")))


@rule("static-husk", "warn")
def static_husk(t: Tables) -> DataFrame:
    return out(t.prod("class").filter(has("static_only")), "only static methods, no state", function="name")


@rule("delegating-husk", "warn")
def delegating_husk(t: Tables) -> DataFrame:
    whole = t.prod("forward").filter((F.col("owner") != "") & has("whole") & ~F.col("text").contains(".")).groupBy("rel", "owner").agg(F.count(F.lit(1)).alias("n"))
    return out(t.prod("class").filter("a >= 1").withColumnRenamed("owner", "outer").withColumnRenamed("name", "owner").join(whole, ["rel", "owner"]).filter("n = a"), "every method hands its parameters on")


@rule("process-class", "fail")
def process_class(t: Tables) -> DataFrame:
    words = f"({'|'.join(C.PROCESS_WORDS)})$"
    patterns = f"({'|'.join(C.PATTERN_WORDS)})$"
    return out(t.prod("class").filter(F.col("name").rlike(words) & ~F.col("name").rlike(patterns) & (F.col("owner") == "")), "a class named by a process", function="name")


@rule("forwarding-chain", "fail")
def forwarding_chain(t: Tables) -> DataFrame:
    """Method -> module function -> a method name that is unique in the repository, behind an import."""
    methods = t.prod("forward").filter("owner <> '' and text not like '%.%'").select("rel", "owner", F.col("name").alias("method"), "line", F.col("text").alias("fn"))
    functions = t.prod("forward").filter("owner = '' and text like '%.%'").select(F.col("name").alias("fn"), F.substring_index("text", ".", -1).alias("target"), F.col("rel").alias("fn_rel"))
    unique = t.kind("method").groupBy(F.col("name").alias("target")).agg(F.count(F.lit(1)).alias("n"), F.min("owner").alias("home")).filter("n = 1")
    imported = t.prod("import").select("rel", F.col("name").alias("fn")).distinct()
    chains = methods.join(functions, "fn").join(unique, "target").filter("home <> owner")
    near = chains.join(imported.withColumn("known", F.lit(True)), ["rel", "fn"], "left").filter("known or rel = fn_rel")
    return out(near, msg("forwards through %s to %s", "fn", "target"), function="method")


@rule("closure-cluster", "warn")
def closure_cluster(t: Tables) -> DataFrame:
    return out(t.prod("function").filter((F.col("c") >= 2) & (F.col("a") == 0) & has("method") & (F.col("end") - F.col("line") + 1 >= 150)), "nested functions in a method without parameters", function="name")


@rule("vague-name", "fail")
def vague_name(t: Tables) -> DataFrame:
    return out(t.prod("class").filter(F.col("name").rlike(f"({'|'.join(C.VAGUE_SUFFIXES)})$") & ((F.col("end") - F.col("line") + 1 >= 120) | (F.col("a") >= 6))), "a role instead of a noun", function="name")


@rule("class-module", "fail")
def class_module(t: Tables) -> DataFrame:
    plain = lambda c: F.lower(F.replace(c, F.lit("_"), F.lit("")))
    modules = t.prod("module").filter("a = 0 and b >= 1 and name <> '__init__'").select("rel", F.col("name").alias("stem"))
    classes = t.prod("class").filter("owner = '' and name not like '\\_%'").groupBy("rel").agg(F.collect_list(F.struct("line", "name", "flags")).alias("cs")).join(modules, "rel")
    wrong = F.filter("cs", lambda c: (plain(c["name"]) != plain(F.col("stem"))) & ~F.array_contains(c["flags"], "protocol"))
    bad = classes.withColumn("wrong", F.array_sort(wrong)).filter("size(wrong) >= 1")
    return out(bad.withColumn("owner", F.lit("")), F.concat(F.lit("not named like the module: "), F.array_join(F.transform("wrong", lambda c: c["name"]), ", ")), F.get("wrong", F.lit(0))["line"])


# -- names, imports, state --------------------------------------------------------


@rule("builtin-shadow", "fail")
def builtin_shadow(t: Tables) -> DataFrame:
    from orelode.sources.python_facts import _BUILTIN_NAMES

    return out(t.prod("binding").filter(F.col("name").isin(*sorted(_BUILTIN_NAMES))).groupBy("rel", "owner", "name").agg(F.min("line").alias("line")), msg("%s hides a builtin", "name"))


@rule("inline-import", "fail")
def inline_import(t: Tables) -> DataFrame:
    return out(t.prod("import").filter(has("in_function")), msg("import of %s in a function", "name"))


@rule("private-import", "fail")
def private_import(t: Tables) -> DataFrame:
    return out(t.prod("import").filter(has("private")), msg("%s is private", "name"))


@rule("global-state", "fail")
def global_state(t: Tables) -> DataFrame:
    return out(t.prod("global").filter(has("statement") | ~(has("dunder") | has("called") | has("alias"))), msg("module state %s (%s)", "name", "text"))


@rule("duplicate-def", "fail")
def duplicate_def(t: Tables) -> DataFrame:
    """A module name bound again by a def or class."""
    w = Window.partitionBy("rel", "name").orderBy("line")
    again = t.prod("module_name").withColumn("before", F.lag("line").over(w)).withColumn("overloaded", F.lag(has("overload")).over(w))
    return out(again.filter(F.col("before").isNotNull() & has("def") & ~F.col("overloaded")), msg("%s is bound above", "name"), function="name")


@rule("unused", "warn")
def unused(t: Tables) -> DataFrame:
    """Definitions without a production reference, by name; a mention in a string keeps them alive (literals split to words first, so the test is an equi-join)."""
    defs = t.prod("function").filter((F.col("owner") == "") & ~has("decorated")).union(t.prod("class").filter((F.col("owner") == "") & ~has("decorated"))).filter("name <> 'main' and name not like '\\_\\_%'")
    said = t.prod("string").select(F.explode(F.array_distinct(F.regexp_extract_all("name", F.lit(r"(\w+)"), F.lit(1)))).alias("name")).distinct()
    left = defs.join(said, "name", "left_anti").join(t.refs, "name", "left").filter("not coalesce(in_prod, false)")
    return out(left, F.when(F.coalesce("in_test", F.lit(False)), "used by tests only").otherwise("never used"), function="name")


@rule("unused-setter", "warn")
def unused_setter(t: Tables) -> DataFrame:
    left = t.prod("function").filter(has("setter")).join(t.refs, "name", "left").filter("not coalesce(in_prod, false)")
    return out(left, msg("%s is never called", "name"), function="name")


@rule("over-abstraction", "fail")
def over_abstraction(t: Tables) -> DataFrame:
    """Abstract classes with exactly one concrete subclass."""
    subclasses = t.prod("class").filter(~has("abstract")).select(F.explode("items").alias("base"), F.concat_ws(":", "rel", "name").alias("sub")).select(F.substring_index("base", ".", -1).alias("name"), "sub")
    one = subclasses.groupBy("name").agg(F.countDistinct("sub").alias("n"), F.min("sub").alias("sub")).filter("n = 1")
    return out(t.prod("class").filter(has("abstract")).join(one, "name"), msg("its only implementation is %s", "sub"), function="name")


@rule("scattered-instance", "warn")
def scattered_instance(t: Tables) -> DataFrame:
    classes = t.kind("class").select("name").distinct()
    made = t.prod("call").filter(has("module_level") & (F.col("text") != "")).withColumn("name", F.substring_index("name", ".", -1)).join(classes, "name", "left_semi")
    return out(made.groupBy("rel").agg(F.count(F.lit(1)).alias("n"), F.min("line").alias("line")).filter("n >= 2").withColumn("owner", F.lit("")), msg("%d instances at module level", "n"))


@rule("middle-man", "warn")
def middle_man(t: Tables) -> DataFrame:
    """Methods that only call a member of a collaborator that a repository class declares."""
    members = t.kind("method").select(F.col("name").alias("member")).union(t.kind("field").select("name")).distinct()
    forwards = t.prod("forward").filter("owner <> '' and text like 'self.%.%' and name not like '\\_\\_%'").withColumn("member", F.substring_index("text", ".", -1))
    return out(forwards.join(members, "member", "left_semi"), msg("only calls %s", "text"), function="name")


# -- statements and expressions --------------------------------------------------


@rule("magic-number", "warn")
def magic_number(t: Tables) -> DataFrame:
    return out(t.prod("number").filter("text = ''"), msg("magic number %s", "name"))


@rule("debug-artifact", "fail")
def debug_artifact(t: Tables) -> DataFrame:
    return out(t.prod("call").filter("name in ('breakpoint', 'pdb.set_trace', 'ipdb.set_trace')"), msg("%s left in", "name"))


@rule("noop-statement", "fail")
def noop_statement(t: Tables) -> DataFrame:
    return out(t.prod("stmt").filter(has("noop")), "a value is discarded")


@rule("unreachable", "fail")
def unreachable(t: Tables) -> DataFrame:
    """The statement after an exit in the same list."""
    w = Window.partitionBy("rel", "name").orderBy("a")
    return out(t.prod("stmt").withColumn("after", F.lag(has("exit")).over(w)).filter("after").groupBy("rel", "name", "owner").agg(F.min("line").alias("line")), "never runs")


@rule("duplicate-block", "warn")
def duplicate_block(t: Tables) -> DataFrame:
    """Three statements in a row whose structure comes again in the function."""
    w = Window.partitionBy("rel", "name").orderBy("a")
    runs = t.prod("stmt").filter(has("plain") & (F.get("items", F.lit(0)) != "module")).withColumn("block", F.when(F.lead("a", 2).over(w) == F.col("a") + 2, F.concat_ws("\n", "text", F.lead("text", 1).over(w), F.lead("text", 2).over(w)))).filter("length(block) >= 120")
    again = runs.groupBy("rel", "owner", F.xxhash64("block").alias("h")).agg(F.array_sort(F.collect_list("line")).alias("at")).filter("size(at) >= 2")
    return out(again, "three statements repeat", F.get("at", F.lit(1)))


@rule("broad-except", "warn")
def broad_except(t: Tables) -> DataFrame:
    return out(t.prod("handler").filter(F.col("name").isin("Exception", "BaseException") & has("exits")), "catches everything")


@rule("swallow", "fail")
def swallow(t: Tables) -> DataFrame:
    return out(t.prod("handler").filter(has("bare") | ~has("exits")), "an error disappears here")


@rule("boolean-arg", "fail")
def boolean_arg(t: Tables) -> DataFrame:
    return out(t.prod("call").filter("c >= 1"), msg("a bare boolean for %s", "name"))


@rule("positional-literals", "warn")
def positional_literals(t: Tables) -> DataFrame:
    return out(t.prod("call").filter(has("plain") & ~has("builtin") & (F.col("b") >= 2)), msg("%d positional literals", "b"))


@rule("guard-clauses", "warn")
def guard_clauses(t: Tables) -> DataFrame:
    return out(t.prod("if_chain").filter("a >= 3"), msg("%d ifs deep", "a"))


def _visitors(t: Tables) -> DataFrame:
    chains = t.prod("chain").filter(has("types"))
    families = chains.groupBy("text").agg(F.countDistinct("rel", "owner").alias("n")).filter("n >= 2")
    return chains.join(families, "text")


@rule("latent-visitor", "warn")
def latent_visitor(t: Tables) -> DataFrame:
    return out(_visitors(t), msg("%d operations tell %s apart", "n", "text"))


@rule("conditional-polymorphism", "warn")
def conditional_polymorphism(t: Tables) -> DataFrame:
    return out(t.prod("chain").filter("a >= 4").join(_visitors(t).select("rel", "line"), ["rel", "line"], "left_anti"), msg("%d arms on %s", "a", "name"))


@rule("special-case", "warn")
def special_case(t: Tables) -> DataFrame:
    return out(t.prod("none_check").filter(~has("guard")).groupBy("rel", "owner", "name").agg(F.count(F.lit(1)).alias("n"), F.min("line").alias("line")).filter("n >= 3"), msg("%s is tested for nothing %d times", "name", "n"))


@rule("unnamed-condition", "warn")
def unnamed_condition(t: Tables) -> DataFrame:
    return out(t.prod("condition").filter((F.col("a") >= 3) & ~has("return") & (F.size("items") >= 1)), msg("%d operands without a name", "a"))


@rule("unnamed-classification", "warn")
def unnamed_classification(t: Tables) -> DataFrame:
    chains = t.prod("chain").filter("a = 3 and b >= 3").select("rel", "line", "owner", "a")
    return out(chains.union(t.prod("classify").filter((F.col("a") >= 3) & has("constants")).select("rel", "line", "owner", "a")), msg("%d arms give constants", "a"))


@rule("loop-pipeline", "warn")
def loop_pipeline(t: Tables) -> DataFrame:
    return out(t.prod("loop_build"), msg("the loop only builds %s", "name"))


@rule("duplicate-expression", "warn")
def duplicate_expression(t: Tables) -> DataFrame:
    """Groups by structure; an occurrence inside a larger reported one of the same line range is dropped where all of its sites are."""
    e = t.prod("expression").filter("a >= 15").withColumn("h", F.xxhash64("text"))
    groups = e.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.max("a").alias("nodes"), F.min(F.struct("rel", "line", "owner")).alias("s")).filter("n >= 2")
    return out(groups.select(F.col("s.rel").alias("rel"), F.col("s.line").alias("line"), F.col("s.owner").alias("owner"), "n"), msg("the expression comes %d times", "n"))


@rule("shared-path", "warn", "latent-class")
def shared_path(t: Tables) -> DataFrame:
    """Whole path expressions in two and more modules."""
    runs = t.prod("path").select("rel", "owner", "line", F.array_join("items", "/").alias("run"))
    groups = runs.groupBy("run").agg(F.countDistinct("rel").alias("modules"), F.min(F.struct("rel", "line", "owner")).alias("s")).filter("modules >= 2")
    return out(groups.select(F.col("s.rel").alias("rel"), F.col("s.line").alias("line"), F.col("s.owner").alias("owner"), "run", "modules"), msg("%s in %d modules", "run", "modules"))


@rule("restating-docstring", "warn")
def restating_docstring(t: Tables) -> DataFrame:
    return out(t.prod("docstring").filter("a >= 5 and b * 10 >= a * 9"), "says what the body says", function="name")


# -- tests and markers --------------------------------------------------------------


@rule("monkeypatch", "fail")
def monkeypatch(t: Tables) -> DataFrame:
    mocks = t.tests("import").filter("text rlike '(^|\\\\.)mock$'").select("rel", "name").distinct()
    direct = t.tests("call").filter(F.col("name").rlike(rf"^monkeypatch\.({'|'.join(C.PATCH_METHODS)})$") | F.col("name").endswith(".patch") | F.col("name").contains(".patch.")).select("rel", "owner", "line", "name")
    named = t.tests("call").join(mocks, ["rel", "name"], "left_semi").select("rel", "owner", "line", "name")
    marks = t.tests("decorator").filter("name like '%patch%'").select("rel", "owner", "line", "name")
    return out(direct.union(named).union(marks).distinct(), msg("%s patches", "name"))


@rule("skipif", "fail")
def skipif(t: Tables) -> DataFrame:
    words = "|".join(w.replace(".", r"\.") for w in C.SKIP_WORDS)
    return out(t.tests("decorator").filter(F.col("name").endswith("mark.skip") | F.col("name").endswith("skipif") & F.col("text").rlike(words)), msg("%s parks a test", "name"))


@rule("fakefs", "fail")
def fakefs(t: Tables) -> DataFrame:
    real = rf"(^open$)|\.({'|'.join(C.PATH_METHODS)})$|^os\.({'|'.join(C.OS_CALLS)})$|^shutil\.({'|'.join(C.SHUTIL_CALLS)})$|^(tempfile\.)?({'|'.join(C.TEMPFILE_CALLS)})$"
    fake = t.tests("import").filter("text like '%pyfakefs%'").select("rel").distinct()
    params = t.tests("function").filter(F.exists("items", lambda x: x.startswith("fs:"))).select("rel").distinct()
    return out(t.tests("call").filter(F.col("name").rlike(real)).join(fake, "rel", "left_anti").join(params, "rel", "left_anti"), msg("%s touches the file system", "name"))


@rule("no-assert-test", "fail")
def no_assert_test(t: Tables) -> DataFrame:
    return out(t.tests("function").filter(F.col("name").startswith("test_") & ~has("assertion")), "asserts nothing", function="name")


@rule("suppression", "fail")
def suppression(t: Tables) -> DataFrame:
    return out(t.kind("marker").filter("text = ''").withColumn("owner", F.lit("")), msg("%s is silenced without a reason", "name"))


@rule("type-ignore", "fail")
def type_ignore(t: Tables) -> DataFrame:
    return out(t.kind("bare_ignore").filter("name = 'type-ignore'"), "type: ignore without a reason")


@rule("noqa", "fail")
def noqa(t: Tables) -> DataFrame:
    return out(t.kind("bare_ignore").filter("name = 'noqa'"), "noqa without a reason")


@rule("bulk-suppression", "warn")
def bulk_suppression(t: Tables) -> DataFrame:
    """Ten and more sites of one signal, anchored at the file with most (the least name among equals)."""
    sites = t.kind("marker").groupBy("name", "rel").agg(F.count(F.lit(1)).alias("n"), F.min("line").alias("line"))
    best = F.max_by(F.struct("rel", "line"), F.struct(F.col("n"), -F.hash("rel"))).alias("s")
    groups = sites.groupBy("name").agg(F.sum("n").alias("total"), best).filter("total >= 10")
    return out(groups.select(F.col("s.rel").alias("rel"), F.col("s.line").alias("line"), F.lit("").alias("owner"), "name", "total"), msg("%s is silenced %d times", "name", "total"))


# -- folders, graph, history ------------------------------------------------------------


@rule("flat-folder", "warn")
def flat_folder(t: Tables) -> DataFrame:
    modules = t.prod("module").filter("name <> '__init__'").select("rel")
    files = modules.union(t.docs.select("rel")) if t.docs is not None else modules
    dirs = files.groupBy(F.regexp_extract("rel", "^(.*)/", 1).alias("rel")).agg(F.count(F.lit(1)).alias("n")).filter("n >= 20")
    return out(dirs.withColumn("owner", F.lit("")), msg("%d files in a folder", "n"), F.lit(0))


@rule("import-cycle", "fail")
def import_cycle(t: Tables) -> DataFrame:
    """Modules that import each other; a dotted name is a file or a package that exists."""
    files = t.prod("module").select("rel")
    path = F.replace("text", F.lit("."), F.lit("/"))
    wanted = t.prod("import").filter("text not like '.%'").select(F.col("rel").alias("src"), F.explode(F.array(F.concat(path, F.lit(".py")), F.concat(path, F.lit("/__init__.py")), F.concat(path, F.lit("/"), F.get("items", F.lit(0)), F.lit(".py")))).alias("rel")).distinct()
    edges = wanted.join(files, "rel", "left_semi").select("src", F.col("rel").alias("dst"))
    rings = graphs.cycles(edges).groupBy("label").agg(F.array_join(F.array_sort(F.collect_list("node")), " -> ").alias("ring"))
    return out(rings.select(F.col("label").alias("rel"), F.lit("").alias("owner"), "ring"), msg("%s", "ring"), F.lit(1))


@rule("hotspot", "fail")
def hotspot(t: Tables) -> DataFrame:
    """The busiest tenth with a complex function."""
    if t.churn is None:
        return _none(t)
    from orelode.operators.ranking import top_fraction

    worst = t.prod("function").groupBy("rel").agg(F.max("b").alias("cc"))
    top = top_fraction(t.churn, "n", "rel").filter("n >= 2").join(worst, "rel").filter("cc >= 15")
    return out(top.withColumn("owner", F.lit("")), msg("changed %d times, complexity %d", "n", "cc"), F.lit(0))


@rule("churn-untested", "fail")
def churn_untested(t: Tables) -> DataFrame:
    """Busy code files that the coverage snapshot knows and has no line of; absent files are unknown."""
    if t.churn is None or t.coverage is None:
        return _none(t)
    from orelode.operators.ranking import top_fraction

    code = t.churn.filter("rel like '%.py' or rel like '%.rs'").filter(~T.is_test_core(F.col("rel")))
    known = t.coverage.select("rel", F.size("lines").alias("covered"), "stale")
    top = top_fraction(code, "n", "rel").filter("n >= 2").join(known, "rel").filter("covered = 0")
    return out(top.withColumn("owner", F.lit("")), msg("changed %d times, no line covered", "n"), F.lit(0), severity=F.when(F.col("stale"), "warn"))


@rule("high-risk", "fail")
def high_risk(t: Tables) -> DataFrame:
    """Callers, tests and words of the name; 0.8 and more, the 50 riskiest."""
    if t.nodes is None or t.edges is None:
        return _none(t)
    callers = t.edges.filter("kind = 'CALLS'").groupBy(F.col("target").alias("qualified_name")).agg(F.count(F.lit(1)).alias("callers"))
    tested = t.edges.filter("kind = 'TESTED_BY'").select(F.col("target").alias("qualified_name"), F.lit(True).alias("tested")).distinct()
    scored = t.nodes.filter("kind = 'Function'").join(callers, "qualified_name", "left").join(tested, "qualified_name", "left").fillna({"callers": 0, "tested": False})
    scored = scored.withColumn("risk", T.risk_points(F.col("callers"), F.col("tested"), F.lower("name").rlike("|".join(C.SECURITY_WORDS)))).filter("risk >= 80").orderBy(F.desc("risk"), "qualified_name").limit(50)
    return out(scored.select(F.col("file_path").alias("rel"), F.coalesce("line_start", F.lit(0)).alias("line"), F.col("name").alias("owner"), "risk"), msg("risk %d of 100", "risk"))


@rule("module-cohesion", "fail")
def module_cohesion(t: Tables) -> DataFrame:
    """A3, A4: files of 150 edges whose nodes fall into two communities of two."""
    if t.nodes is None or t.edges is None:
        return _none(t)
    busy = t.edges.filter("kind in ('CALLS', 'IMPORTS_FROM', 'INHERITS', 'REFERENCES')").groupBy(F.col("file_path").alias("rel")).agg(F.count(F.lit(1)).alias("edges")).filter("edges >= 150")
    groups = t.nodes.filter("community_id is not null").groupBy(F.col("file_path").alias("rel"), "community_id").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2").groupBy("rel").agg(F.count(F.lit(1)).alias("groups")).filter("groups >= 2")
    return out(busy.join(groups, "rel").withColumn("owner", F.lit("")), msg("%d communities in a file", "groups"), F.lit(0))


@rule("layer-mix", "fail")
def layer_mix(t: Tables) -> DataFrame:
    """Files of six functions whose dominant callee modules form two groups of two."""
    if t.nodes is None or t.edges is None:
        return _none(t)
    from orelode.operators.ranking import mode_by

    target = t.nodes.select(F.col("qualified_name").alias("target"), T.module_key(F.col("file_path")).alias("module"))
    calls = t.edges.filter("kind = 'CALLS'").join(target, "target").select("source", "module")
    modes = mode_by(calls, "source", "module")
    home = t.nodes.filter("kind = 'Function'").select(F.col("qualified_name").alias("source"), F.col("file_path").alias("rel"))
    sized = home.groupBy("rel").agg(F.count(F.lit(1)).alias("fns")).filter("fns >= 6")
    groups = modes.join(home, "source").groupBy("rel", "module").agg(F.count(F.lit(1)).alias("m")).filter("m >= 2").groupBy("rel").agg(F.count(F.lit(1)).alias("groups")).filter("groups >= 2")
    return out(sized.join(groups, "rel").withColumn("owner", F.lit("")), msg("functions lean on %d modules", "groups"), F.lit(0))


@rule("folder-mix", "fail")
def folder_mix(t: Tables) -> DataFrame:
    """Folders of five files with two dominant communities of two files."""
    if t.nodes is None:
        return _none(t)
    from orelode.operators.ranking import mode_by

    modes = mode_by(t.nodes.filter("community_id is not null").select(F.col("file_path").alias("file"), "community_id"), "file", "community_id", greatest_on_tie=False)
    dirs = modes.groupBy(F.regexp_extract("file", "^(.*)/", 1).alias("rel"), "community_id").agg(F.count(F.lit(1)).alias("files")).groupBy("rel").agg(F.sum("files").alias("files"), F.count_if(F.col("files") >= 2).alias("groups")).filter("files >= 5 and groups >= 2")
    return out(dirs.withColumn("owner", F.lit("")), msg("%d communities in a folder", "groups"), F.lit(0))


def _none(t: Tables) -> DataFrame:
    return out(t.facts.limit(0), "")


def findings(t: Tables, signals: list[str] | None = None) -> DataFrame:
    """Findings of all rules (or the given ones): rel, line, function, signal, kind, severity, message."""
    parts = []
    for signal, (severity, family, f) in RULES.items():
        if signals is None or signal in signals:
            parts.append(f(t).select("rel", "line", "function", F.lit(signal).alias("signal"), F.lit(family).alias("kind"), F.coalesce("own_severity", F.lit(severity)).alias("severity"), "message"))
    return reduce(DataFrame.unionByName, parts)
