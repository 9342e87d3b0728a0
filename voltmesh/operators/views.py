"""Typed views of classes, with columns that follow from the vocabulary.

Every attribute of a class, inherited ones included, is a column: of the declared type, a reference as the identifier it names, a compound as a struct of its fields at any depth, a many-valued one as an
array in order. A column is named by its label; where two attributes have one label the most derived keeps it, the others are ``Owner_label``, and numbered if that is taken too. What the
vocabulary knows of a column stands in its metadata: attribute, kind, target, and unit if it is given.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .model import Model
from .vocabulary import Vocabulary

#: Where a value is by its declared primitive; texts else.
STORED = {"Boolean": "v_bool", "Integer": "v_int", "Float": "v_dbl", "Decimal": "v_dbl"}


@dataclass(frozen=True)
class Accessor:
    """A column of a view."""

    name: str
    attr: str
    owner: str
    kind: str
    primitive: str | None
    target: str | None
    many: bool


def named(found: list[tuple[int, str, str]]) -> dict[str, str]:
    """The name of each attribute: ``found`` has how far up its owner is, the attribute and the owner."""
    names: dict[str, str] = {}
    taken: set[str] = {"mrid", "class"}
    for _, attr, owner in sorted(found):
        label = attr.rpartition(".")[2]
        name = label if label.lower() not in taken else f"{owner}_{label}"
        base, n = name, 2
        while name.lower() in taken:
            name, n = f"{base}_{n}", n + 1
        taken.add(name.lower())
        names[attr] = name
    return names


def accessors(vocabulary: Vocabulary, name: str) -> list[Accessor]:
    """The columns of a class, its own first."""
    rows = vocabulary.class_attrs().where(F.col("class") == name).select("depth", "attr", "owner", "kind", "primitive", "target", "most").collect()  # attributes of one class
    names = named([(r.depth, r.attr, r.owner) for r in rows])
    return [Accessor(names[r.attr], r.attr, r.owner, r.kind, r.primitive, r.target, r.most is None or r.most > 1) for r in sorted(rows, key=lambda r: (r.depth, r.attr))]


def typed_view(m: Model, name: str, units: dict[str, str] | None = None, exact: bool = False, deepest: int = 4) -> DataFrame:
    """mrid, class and every attribute of the objects of a class and its subclasses; compounds inside compounds are followed ``deepest`` steps."""
    v = m.vocabulary
    paths: list[str] = []

    def value(path: str, a: Accessor) -> Column:
        paths.append(path)
        stored = "v_ref" if a.kind == "ref" else STORED.get(a.primitive or "", "v_text") if a.kind == "value" else "v_text"
        own = F.col("attr") == path
        if a.many:
            return F.transform(F.array_sort(F.collect_list(F.when(own, F.struct("ord", F.col(stored).alias("x"))))), lambda x: x["x"])
        return F.max(F.when(own & (F.col("ord") == 0), F.col(stored)))

    def column(path: str, a: Accessor, depth: int) -> Column | None:
        if a.kind != "compound":
            return value(path, a)
        fields = [(f.name, column(f"{path}/{f.attr}", f, depth + 1)) for f in accessors(v, a.target)] if depth < deepest and a.target else []
        fields = [c.alias(n) for n, c in fields if c is not None]
        return F.struct(*fields) if fields else None

    built = [(a, column(a.attr, a, 1)) for a in accessors(v, name)]
    told = lambda a: {k: x for k, x in {"attr": a.attr, "kind": a.kind, "target": a.target, "unit": (units or {}).get(a.attr)}.items() if x is not None}
    wide = [(a, c) for a, c in built if c is not None]
    if not wide:
        return m.of_class(name, exact).select("mrid", "class")
    rows = m.slots.where(F.col("attr").isin(paths)).groupBy("mrid").agg(*(c.alias(a.name) for a, c in wide))
    return m.of_class(name, exact).select("mrid", "class").join(rows.hint("merge"), "mrid", "left").select("mrid", "class", *(F.col(a.name).alias(a.name, metadata=told(a)) for a, _ in wide))
