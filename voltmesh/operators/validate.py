"""Validation rules: each gives findings (severity, rule, mrid, attr, message) (2.K)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import mrid as M
from ..functions import profiles as P
from ..functions import xmltext as X
from ..functions.shared import wide
from . import compounds as C
from .model import Model
from .vocabulary import Vocabulary

#: The stable codes of the rules.
RULES = {
    "unknown-class": "CIM0001", "class-membership": "CIM0002", "unparseable-value": "CIM0003", "identifier-form": "CIM0004", "class-collision": "CIM0005", "dangling-reference": "CIM0006",
    "missing-required": "CIM0007", "cardinality": "CIM0008", "wrong-target": "CIM0009", "not-in-profile": "CIM0010", "abstract-class": "CIM0011", "deprecated": "CIM0012", "header": "CIM0013",
    "dependency": "CIM0014", "structure": "CIM0015", "datatype": "CIM0016", "fixed-value": "CIM0017", "conflicting-value": "CIM0018", "illegal-character": "CIM0019", "unwritable-identifier": "CIM0020",
    "wrong-vintage": "CIM0021", "unreadable-file": "CIM0022",
}
ALL_PROFILES = -1


def finding(rows: DataFrame, severity: str, rule: str, message: Column, attr: Column | None = None) -> DataFrame:
    return rows.select(F.lit(severity).alias("severity"), F.lit(RULES[rule]).alias("rule"), "mrid", (attr if attr is not None else F.lit(None).cast("string")).alias("attr"), message.alias("message"))


def class_membership(m: Model) -> DataFrame:
    """Values whose attribute the object's class doesn't have (K1), and fields that the compound around them, at any depth, doesn't have (K2)."""
    return value_findings(m, {class_membership})


def identifier_form(m: Model) -> DataFrame:
    """Identifiers that aren't UUIDs (K3)."""
    return object_findings(m, {identifier_form})


def dangling(m: Model) -> DataFrame:
    """References to objects that aren't there (K4)."""
    return reference_findings(m, {dangling})


def missing_required(m: Model, scope: int = ALL_PROFILES) -> DataFrame:
    """Required attributes that an object lacks, where its class is concrete in the scope and the attribute is serialised there (K5)."""
    wanted = m.vocabulary.class_attrs().where("least > 0").where(F.col("used_in").bitwiseAND(F.lit(scope)) != 0).select("class", "attr", "used_in")
    concrete = m.vocabulary.classes.where(F.col("defined_in").bitwiseAND(F.col("concrete_in")).bitwiseAND(F.lit(scope)) != 0).select("class")
    due = m.objects.join(F.broadcast(concrete), "class", "left_semi").join(F.broadcast(wanted), "class").where((F.col("profiles") == 0) | (F.col("profiles").bitwiseAND(F.col("used_in")) != 0))
    lacking = due.select("mrid", "attr").join(wide(m.slots.select("mrid", "attr")), ["mrid", "attr"], "left_anti")
    return finding(lacking, "error", "missing-required", F.col("attr"), F.col("attr"))


def cardinality(m: Model) -> DataFrame:
    """Attributes with more values than allowed, in any scope (K7), or with some but fewer than the least (K6)."""
    counts = m.slots.groupBy("mrid", "attr").agg(F.count("*").alias("n")).join(F.broadcast(m.vocabulary.attrs.select("attr", "least", "most")), "attr")
    over = finding(counts.where("n > most"), "error", "cardinality", F.concat_ws(" > ", "n", "most"), F.col("attr"))
    return over.union(finding(counts.where("n < least"), "error", "missing-required", F.concat_ws(" < ", "n", "least"), F.col("attr")))


def wrong_target(m: Model) -> DataFrame:
    """References to an object of a class that is neither below nor above the declared one (K8)."""
    return reference_findings(m, {wrong_target})


def not_in_profile(m: Model) -> DataFrame:
    """Attributes with values from files whose profiles don't declare them: one finding an attribute, with the count and an example (K9)."""
    stray = m.slots.join(F.broadcast(m.vocabulary.attrs.select("attr", "used_in")), "attr").where(~P.covers(F.col("profiles"), F.col("used_in")))
    return finding(stray.groupBy("attr").agg(F.count("*").alias("n"), F.min("mrid").alias("mrid")), "warning", "not-in-profile", F.concat(F.col("n"), F.lit(" values")), F.col("attr"))


def abstract_class(m: Model) -> DataFrame:
    """Objects of classes that have none."""
    return object_findings(m, {abstract_class})


def deprecated(m: Model) -> DataFrame:
    classes = finding(m.objects.join(F.broadcast(m.vocabulary.classes.where("deprecated").select("class")), "class"), "info", "deprecated", F.col("class"))
    attrs = m.slots.join(F.broadcast(m.vocabulary.attrs.where("deprecated").select("attr")), "attr")
    return classes.union(finding(attrs, "info", "deprecated", F.col("attr"), F.col("attr")))


def fitting() -> Column:
    """Whether a stored kind is the declared one."""
    return F.when(F.col("declared").isin("ref", "enum", "compound"), F.col("declared") == F.col("kind")).when(F.col("primitive") == "Boolean", F.col("kind") == "bool").when(F.col("primitive") == "Integer", F.col("kind") == "int").when(F.col("primitive").isin("Float", "Decimal"), F.col("kind").isin("dbl", "int")).otherwise(F.col("kind") == "text")


def datatype(m: Model) -> DataFrame:
    """Values whose stored kind isn't the declared one, literals of another enumeration, and fields inside what is no compound; at any depth."""
    return value_findings(m, {datatype})


def fixed_value(m: Model) -> DataFrame:
    """Values of attributes with another fixed value."""
    return value_findings(m, {fixed_value})


def illegal_character(m: Model) -> DataFrame:
    """Texts with characters that XML can't hold, inside compounds too."""
    return value_findings(m, {illegal_character})


def unwritable_identifier(m: Model) -> DataFrame:
    """Identifiers that no document can hold."""
    return object_findings(m, {unwritable_identifier})


def headers(h: DataFrame) -> DataFrame:
    """Missing or malformed fields of file headers (K13). ``h``: id, created, scenario_time, profiles."""
    h = h.withColumn("mrid", F.col("id"))
    return (
        finding(h.where("id is null"), "error", "header", F.lit("no identifier"))
        .union(finding(h.where("id is not null").where(~M.is_conforming(M.parse(F.col("id")))), "warning", "header", F.lit("identifier is no UUID")))
        .union(finding(h.where(F.coalesce(F.size("profiles"), F.lit(0)) <= 0), "error", "header", F.lit("no profile")))
        .union(finding(h.where("scenario_time is null"), "warning", "header", F.lit("no scenario time")))
        .union(finding(h.where("created is null"), "warning", "header", F.lit("no creation time")))
    )


def serving(h: DataFrame, vocabulary: Vocabulary, scope: int) -> DataFrame:
    """Headers that name a profile of ``scope`` (0: all headers) (D12). ``h``: id, profiles."""
    if not scope:
        return h
    named = vocabulary.resolve_iris(h.select("id", F.explode("profiles").alias("iri"))).where(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit")).bitwiseAND(F.lit(scope)) != 0)
    return h.join(wide(named.select("id").distinct()), "id", "left_semi")


def dependencies(h: DataFrame) -> DataFrame:
    """Models that a header depends on and no header has (K14). ``h``: id, depends_on."""
    wanted = h.select(F.col("id").alias("mrid"), F.explode("depends_on").alias("needed"))
    return finding(wanted.join(wide(h.select(F.col("id").alias("needed"))), "needed", "left_anti"), "warning", "dependency", F.col("needed"))


def coverage(m: Model) -> DataFrame:
    """bit of each profile, its objects, values, and required values that are missing in it."""
    used = F.broadcast(m.vocabulary.attrs.select(F.col("attr").alias("_root"), "used_in"))
    spread = m.slots.withColumn("_root", F.substring_index("attr", "/", 1)).join(used, "_root").select("mrid", F.explode(P.bits(P.effective(F.col("profiles"), F.col("used_in")))).alias("bit"))
    here = spread.groupBy("bit").agg(F.countDistinct("mrid").alias("objects"), F.count("*").alias("values"))
    lacking = missing_required(m).join(F.broadcast(m.vocabulary.attrs.select("attr", "used_in")), "attr").select(F.explode(P.bits(F.col("used_in"))).alias("bit")).groupBy("bit").agg(F.count("*").alias("missing"))
    return here.join(lacking, "bit", "full_outer").select("bit", F.coalesce("objects", F.lit(0)).alias("objects"), F.coalesce("values", F.lit(0)).alias("values"), F.coalesce("missing", F.lit(0)).alias("missing"))


def conflicting(raw: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Values of single-valued attributes that a later file replaced by others."""
    from .model import conflicts

    text = lambda v: F.coalesce(v["v_ref"], v["v_text"], v["v_int"].cast("string"), v["v_dbl"].cast("string"), v["v_bool"].cast("string"))
    return finding(conflicts(raw, vocabulary), "warning", "conflicting-value", F.concat_ws(" replaces ", text(F.col("kept")), text(F.col("discarded"))), F.col("attr"))


def rendered(findings: DataFrame) -> DataFrame:
    """Findings as lines: severity[rule] mrid attr: message."""
    return findings.select(F.concat(F.col("severity"), F.lit("["), F.col("rule"), F.lit("] "), F.concat_ws(" ", "mrid", "attr"), F.lit(": "), F.col("message")).alias("line"))


def value_findings(m: Model, rules: set) -> DataFrame:
    """``class_membership``, ``datatype``, ``fixed_value`` and ``illegal_character`` in one pass: values meet their attribute's row, by its last step, and their object's class once."""
    attrs = F.broadcast(m.vocabulary.attrs.select(F.col("attr").alias("_leaf"), F.col("kind").alias("declared"), "primitive", F.when(F.col("kind") == "enum", F.col("target")).alias("enum"), "fixed", F.lit(True).alias("known")))
    owned = F.broadcast(m.vocabulary.class_attrs().groupBy(F.col("attr").alias("_root")).agg(F.collect_set("class").alias("owners")))
    rows = m.slots.withColumns({"_leaf": C.leaf(), "_root": C.root()}).join(attrs, "_leaf", "left").join(owned, "_root", "left")
    rows = rows.join(wide(m.objects.select("mrid", "class")), "mrid", "left") if class_membership in rules else rows.withColumn("class", F.lit(None).cast("string"))
    shown = F.coalesce("lex", "v_text", F.col("v_int").cast("string"), F.col("v_bool").cast("string"))
    told = _told(rules)
    other = (F.col("kind") == "enum") & F.col("enum").isNotNull() & (F.substring_index("v_text", ".", 1) != F.col("enum"))
    checks = F.array(
        told(class_membership, F.col("class").isNotNull() & ~F.coalesce(F.array_contains("owners", F.col("class")), F.lit(False)), "error", "class-membership", F.concat(F.col("class"), F.lit(" has no "), F.col("_root"))),
        told(datatype, F.col("known") & ~fitting(), "error", "datatype", F.concat_ws(" for ", "kind", F.coalesce("primitive", "declared"))),
        told(datatype, F.col("known") & fitting() & other, "error", "datatype", F.concat_ws(" for ", "v_text", "enum")),
        told(fixed_value, (F.col("fixed") != "") & (shown != F.col("fixed")), "warning", "fixed-value", F.concat_ws(" is not ", shown, "fixed")),
        told(illegal_character, F.col("v_text").isNotNull() & X.has_illegal(F.col("v_text")), "error", "illegal-character", F.concat(F.lit("at byte "), X.illegal_offset(F.col("v_text")))),
    )
    found = rows.select("mrid", "attr", F.inline(F.filter(checks, lambda x: x.isNotNull()))).select("severity", "rule", "mrid", "attr", "message")
    steps = [name for rule, name in ((class_membership, "class-membership"), (datatype, "datatype")) if rule in rules]
    if not steps or not m.vocabulary.has_compounds():
        return found
    wrong = F.broadcast(C.judged(m.slots, m.vocabulary).where(F.col("rule").isin(steps)))  # distinct paths, bounded by the vocabulary
    within = m.slots.where(C.inside()).select("mrid", "attr").join(wrong, "attr").select("mrid", "rule", "place", "message").distinct()
    codes = F.create_map(*(F.lit(x) for name in steps for x in (name, RULES[name])))
    return found.unionByName(within.select(F.lit("error").alias("severity"), codes[F.col("rule")].alias("rule"), "mrid", F.col("place").alias("attr"), "message"))


def _told(rules: set):
    """A check that gives severity, rule and message where it is true, or nothing if its rule isn't chosen."""
    none = F.lit(None).cast("struct<severity:string,rule:string,message:string>")
    return lambda rule, when, severity, name, message: F.when(when, F.struct(F.lit(severity).alias("severity"), F.lit(RULES[name]).alias("rule"), message.alias("message"))) if rule in rules else none


def object_findings(m: Model, rules: set) -> DataFrame:
    """``identifier_form``, ``abstract_class`` and ``unwritable_identifier`` in one pass over the objects."""
    abstract = F.broadcast(m.vocabulary.classes.where("not concrete").select("class", F.lit(True).alias("abstract")))
    rows = m.objects.join(abstract, "class", "left")
    told = _told(rules)
    checks = F.array(
        told(identifier_form, ~M.is_conforming(M.parse(F.col("mrid"))), "warning", "identifier-form", F.col("mrid")),
        told(abstract_class, F.col("abstract"), "error", "abstract-class", F.col("class")),
        told(unwritable_identifier, X.identifier_form(F.col("mrid")) == "unwritable", "error", "unwritable-identifier", F.col("mrid")),
    )
    return rows.select("mrid", F.lit(None).cast("string").alias("attr"), F.inline(F.filter(checks, lambda x: x.isNotNull()))).select("severity", "rule", "mrid", "attr", "message")


def reference_findings(m: Model, rules: set) -> DataFrame:
    """``dangling`` and ``wrong_target`` from one join of references with the objects they name."""
    up = m.vocabulary.closure()
    related = F.broadcast(up.select(F.col("class").alias("target_class"), F.col("ancestor").alias("declared")).union(up.select("ancestor", "class")).distinct().withColumn("related", F.lit(True)))
    declared = F.broadcast(m.vocabulary.attrs.where("target is not null").select("attr", F.col("target").alias("declared")))
    refs = m.references().join(wide(m.objects.select(F.col("mrid").alias("target"), F.col("class").alias("target_class"))), "target", "left").join(declared, "attr", "left").join(related, ["target_class", "declared"], "left")
    missing = refs["target_class"].isNull()
    wrong = ~missing & F.col("declared").isNotNull() & F.col("related").isNull()
    keep = F.lit(False)
    keep = keep | missing if dangling in rules else keep
    keep = keep | wrong if wrong_target in rules else keep
    return refs.where(keep).select(F.when(missing, "warning").otherwise("error").alias("severity"), F.when(missing, RULES["dangling-reference"]).otherwise(RULES["wrong-target"]).alias("rule"), "mrid", "attr", F.when(missing, F.col("target")).otherwise(F.concat_ws(" is no ", "target_class", "declared")).alias("message"))


@dataclass(frozen=True)
class Options:
    rules: tuple[Callable[[Model], DataFrame], ...] = (class_membership, identifier_form, dangling, missing_required, cardinality, wrong_target, not_in_profile, abstract_class, datatype, fixed_value, illegal_character, unwritable_identifier)
    most: int = 0  # the most findings, the worst first (0: all)
    severities: dict = field(default_factory=lambda: {"error": 0, "warning": 1, "info": 2})
    scope: int = ALL_PROFILES

    @staticmethod
    def essential() -> Options:
        return Options(rules=(class_membership, dangling, cardinality, wrong_target, abstract_class, datatype, illegal_character, unwritable_identifier))

    @staticmethod
    def thorough() -> Options:
        return Options(rules=(*Options().rules, deprecated))

    @staticmethod
    def for_profiles(scope: int) -> Options:
        """The default rules, with required values looked for in a profile set only."""
        return Options(scope=scope)


VALUE_RULES = {class_membership, datatype, fixed_value, illegal_character}
OBJECT_RULES = {identifier_form, abstract_class, unwritable_identifier}
REFERENCE_RULES = {dangling, wrong_target}


def validate(m: Model, options: Options | None = None, heads: DataFrame | None = None, raw: DataFrame | None = None) -> DataFrame:
    """All findings of the chosen rules, as one table: those of headers and of conflicting values too, if they are given (K0)."""
    options = options or Options()
    parts = [] if heads is None else [headers(heads), dependencies(heads)]
    parts += [] if raw is None else [conflicting(raw, m.vocabulary)]
    # rules over the same rows are judged in one pass
    left = list(options.rules)
    for together, judge in ((VALUE_RULES, value_findings), (OBJECT_RULES, object_findings), (REFERENCE_RULES, reference_findings)):
        some = together.intersection(left)
        if some:
            parts.append(judge(m, some))
            left = [r for r in left if r not in some]
    parts += [missing_required(m, options.scope) if rule is missing_required else rule(m) for rule in left]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    if not options.most:
        return out
    rank = F.create_map(*[F.lit(x) for kv in options.severities.items() for x in kv])
    return out.orderBy(F.coalesce(F.try_element_at(rank, F.col("severity")), F.lit(9)), "rule", "mrid", "attr", "message").limit(options.most)


def by_rule(findings: DataFrame, rule: str) -> DataFrame:
    return findings.where(F.col("rule") == RULES.get(rule, rule))


def summary(findings: DataFrame) -> DataFrame:
    """Findings of each rule, most frequent first."""
    return findings.groupBy("rule", "severity").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "rule")


def severities(findings: DataFrame) -> DataFrame:
    return findings.groupBy("severity").agg(F.count("*").alias("n"))


def is_conforming(findings: DataFrame) -> bool:
    return findings.where("severity = 'error'").isEmpty()
