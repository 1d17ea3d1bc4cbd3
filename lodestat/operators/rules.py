"""Labels from rules: a table that says which filed names make up a label.

A label has alternatives, best first. An alternative is a signed sum of pieces, and a piece is a chain of names of which the first
present one counts. A piece's role says what its absence means: without an ``all`` piece the alternative does not hold; of the
``any`` pieces one is enough and the others count as 0; an ``extra`` piece counts as 0 and never carries an alternative that has
pieces of another role. The first alternative that holds gives the label's value.

Rules are data: labels are added by adding entries, not code. A rule table is written by hand, which bounds it."""

from functools import reduce
from operator import or_
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROLES = ("all", "any", "extra")


class Piece(NamedTuple):
    names: tuple
    sign: int
    role: str


def piece(*names, sign: int = 1, role: str = "all") -> Piece:
    if role not in ROLES or not names:
        raise ValueError(f"a piece needs a name and a role of {ROLES}: {names}, {role}")
    return Piece(names, sign, role)


def alternatives(rule) -> tuple:
    """A rule as alternatives of pieces; a bare chain of names is one alternative of one piece."""
    if all(isinstance(n, str) for n in rule):
        return ((piece(*rule),),)
    return tuple(rule)


def names(rules: dict) -> list:
    """Every name that the rules read, once."""
    return sorted({n for rule in rules.values() for alt in alternatives(rule) for p in alt for n in p.names})


def _label(rule, cells: dict):
    """(value, alt, names) of the first alternative that holds, over one column per name (``cells``); NULL where none does."""
    found = []
    for number, alt in enumerate(alternatives(rule)):
        here = [F.coalesce(*[cells[n] for n in p.names]) for p in alt]
        there = [h.isNotNull() for h in here]
        needed = [t for t, p in zip(there, alt, strict=True) if p.role == "all"]
        enough = [t for t, p in zip(there, alt, strict=True) if p.role == "any"]
        holds = reduce(or_, there)
        for t in needed:
            holds = holds & t
        if enough:
            holds = holds & reduce(or_, enough)
        value, used = F.lit(0.0), []
        for p, h, t in zip(alt, here, there, strict=True):              # summed in the rule's order
            value = value + F.coalesce(F.lit(float(p.sign)) * h, F.lit(0.0))
            name = F.coalesce(*[F.when(cells[n].isNotNull(), F.lit(n)) for n in p.names])
            used.append(F.array(name) if p.role == "all" else F.when(t, F.array(name)).otherwise(F.array().cast("array<string>")))
        found.append(F.when(holds, F.struct(value.alias("value"), F.lit(number).alias("alt"), F.concat(*used).alias("names"))))
    return F.coalesce(*found)


def resolve(values: DataFrame, rules: dict, name: str = "tag", by=("entity", "end_day")) -> DataFrame:
    """(*by, label, value, alt, names): each label that an alternative gives at a key, with the alternative's number and the names
    that it was summed from. ``values`` holds at most one row per key and name; absent and NULL are the same.

    Values are exchanged once, by the key, and gathered into one cell per name, without a sort; labels are then worked out cell by
    cell. A key holds no more cells than the rules have names."""
    by, read = list(by), names(rules)
    known = values.where(F.col("value").isNotNull() & F.col(name).isin(*read)).select(*by, F.col(name).alias("name"), "value")
    cells = {n: f"_{i}" for i, n in enumerate(read)}
    keys = known.repartition(*[F.col(c) for c in by]).groupBy(*by).agg(*[F.max(F.when(F.col("name") == n, F.col("value"))).alias(c) for n, c in cells.items()])
    columns = {n: F.col(c) for n, c in cells.items()}
    labels = [F.struct(F.lit(label).alias("label"), _label(rule, columns).alias("w")) for label, rule in rules.items()]
    return keys.select(*by, F.explode(F.array(*labels)).alias("l")).where("l.w IS NOT NULL").select(*by, "l.label", "l.w.*")


def wide(resolved: DataFrame, labels, by=("entity", "end_day")) -> DataFrame:
    """One row per key, one column per label."""
    return resolved.groupBy(*by).agg(*[F.max(F.when(F.col("label") == c, F.col("value"))).alias(c) for c in labels])
