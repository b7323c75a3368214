"""A subset of Cypher as DataFrame plans.

    MATCH (a:Label {key: 'v'})-[r:TYPE]->(b:Label), (b)<-[:TYPE*1..3]-(c)  MATCH ...
    WHERE a.x = 'v' AND NOT b.name CONTAINS 'w' OR ...
    OPTIONAL MATCH ... WHERE ...
    WITH a, count(*) AS n WHERE n > 1  MATCH (a)-[]->(d) ...
    RETURN [DISTINCT] a.x AS x, type(r), count(*), collect(b.name)  ORDER BY x DESC  SKIP n  LIMIT n
    UNION [ALL] ...

Nodes become scans of their label's table, relations become joins with the edge table; conditions are filters that the
optimizer moves to the scans. A relation of variable length gives one row for each length and pair of ends. Values are
literals of the plan, never text of another query.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.plans.lineage import cut

TOKEN = re.compile(r"""\s*(?:(?P<string>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<number>\d+(?:\.\d+)?(?!\.\d)|\d+)|(?P<name>[A-Za-z_][A-Za-z0-9_]*|`[^`]+`)|(?P<op><>|<=|>=|\.\.|->|<-|[-=<>()\[\]{},:.*|]))""")
AGGREGATES = {"count", "collect", "min", "max", "sum", "avg"}


class CypherError(ValueError):
    """The query is outside the subset or names what isn't there."""


@dataclass
class Catalog:
    """``labels``: tables with a column id. ``edges``: src, dst, rel_type, src_label, dst_label. ``aliases``: property names that stand for columns."""

    labels: dict[str, DataFrame]
    edges: DataFrame
    aliases: dict[str, str] = field(default_factory=dict)


def tokenise(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    text = text.rstrip().rstrip(";")
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m:
            if not text[at:].strip():
                break
            raise CypherError(f"cannot read {text[at:].strip()[:20]!r}")
        out.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    return out


class Query:
    def __init__(self, catalog: Catalog, tokens: list[tuple[str, str]]):
        self.catalog, self.tokens, self.at = catalog, tokens, 0
        self.values: set[str] = set()  # columns that WITH has made
        self.rows: DataFrame | None = None
        self.nodes: dict[str, list[str]] = {}
        self.relations: dict[str, list[str]] = {}
        self.hidden = 0

    # reading

    def peek(self, *words: str) -> bool:
        kind, text = self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")
        return kind != "string" and text.upper() in words

    def take(self, *words: str) -> bool:
        if self.peek(*words):
            self.at += 1
            return True
        return False

    def need(self, word: str) -> None:
        if not self.take(word):
            raise CypherError(f"expected {word} at {' '.join(t for _, t in self.tokens[self.at : self.at + 3])!r}")

    def next(self, kind: str) -> str:
        if self.at >= len(self.tokens) or self.tokens[self.at][0] != kind:
            raise CypherError(f"expected a {kind}")
        self.at += 1
        return self.tokens[self.at - 1][1].strip("`") if kind == "name" else self.tokens[self.at - 1][1]

    def value(self):
        if self.at < len(self.tokens) and self.tokens[self.at][0] == "string":
            return re.sub(r"\\(.)", r"\1", self.next("string")[1:-1])
        negative = self.take("-")
        if self.at < len(self.tokens) and self.tokens[self.at][0] == "number":
            text = self.next("number")
            number = float(text) if "." in text else int(text)
            return -number if negative else number
        for word, value in (("TRUE", True), ("FALSE", False), ("NULL", None)):
            if self.take(word):
                return value
        raise CypherError("expected a value")

    # patterns

    def column(self, var: str, prop: str) -> Column:
        known = self.nodes.get(var) or self.relations.get(var)
        if known is None:
            raise CypherError(f"unknown variable {var}")
        if var in self.relations and prop in ("_label", "label"):
            prop = "rel_type"
        for name in (prop, self.catalog.aliases.get(prop)):
            if name in known:
                return F.col(f"{var}.{name}")
        raise CypherError(f"{var} has no property {prop}")

    def scan(self, var: str, label: str | None) -> DataFrame:
        if label is None:
            tables = [df.select("id", *[c for c in ("name",) if c in df.columns]) for df in self.catalog.labels.values()]
            table = tables[0]
            for other in tables[1:]:
                table = table.unionByName(other, allowMissingColumns=True)
        elif label in self.catalog.labels:
            table = self.catalog.labels[label]
        else:
            raise CypherError(f"unknown label {label}")
        self.nodes[var] = table.columns
        return table.select(F.struct(*table.columns).alias(var))

    def node(self) -> tuple[str, str | None, dict]:
        self.need("(")
        var = self.next("name") if self.tokens[self.at][0] == "name" else self.unnamed()
        label = self.next("name") if self.take(":") else None
        wanted = {}
        if self.take("{"):
            while not self.take("}"):
                key = self.next("name")
                self.need(":")
                wanted[key] = self.value()
                self.take(",")
        self.need(")")
        return var, label, wanted

    def unnamed(self) -> str:
        self.hidden += 1
        return f"__{self.hidden}"

    def join(self, df: DataFrame, on: Column | None) -> None:
        if self.rows is None:
            self.rows = df
        else:
            self.rows = self.rows.join(df, on) if on is not None else self.rows.crossJoin(df)  # patterns without a common variable

    def bind(self, var: str, label: str | None, wanted: dict, on: Column | None = None) -> None:
        if var not in self.nodes:
            table = self.scan(var, label)
            for key, value in wanted.items():
                table = table.where(self.column(var, key).eqNullSafe(F.lit(value)))
            self.join(table, on)
        else:
            if on is not None:
                self.rows = self.rows.where(on)
            for key, value in wanted.items():
                self.rows = self.rows.where(self.column(var, key).eqNullSafe(F.lit(value)))

    def relation(self) -> tuple[str, list[str], int, int, bool]:
        back = self.take("<-")
        if not back:
            self.need("-")
        var, types, low, high = self.unnamed(), [], 1, 1
        if self.take("["):
            if self.tokens[self.at][0] == "name":
                var = self.next("name")
            if self.take(":"):
                types.append(self.next("name"))
                while self.take("|"):
                    self.take(":")
                    types.append(self.next("name"))
            if self.take("*"):
                low = int(self.next("number")) if self.tokens[self.at][0] == "number" else 1
                high = low
                if self.take(".."):
                    high = int(self.next("number"))
                if not 1 <= low <= high <= 5:
                    raise CypherError("a path has 1 to 5 relations")
            self.need("]")
        if back:
            self.need("-")
        else:
            self.need("->")
        return var, types, low, high, back

    def pattern(self) -> None:
        left, label, wanted = self.node()
        self.bind(left, label, wanted)
        while self.peek("-", "<-"):
            var, types, low, high, back = self.relation()
            right, label, wanted = self.node()
            edges = self.catalog.edges.where(F.col("rel_type").isin(types)) if types else self.catalog.edges
            near, far = ("dst", "src") if back else ("src", "dst")
            if high > 1:
                edges = paths(edges, low, high, self.rows.select(F.col(f"{left}.id").alias(near)).distinct(), near, far)
            self.relations[var] = edges.columns
            self.join(edges.select(F.struct(*edges.columns).alias(var)), F.col(f"{left}.id") == F.col(f"{var}.{near}"))
            self.bind(right, label, wanted, F.col(f"{var}.{far}") == F.col(f"{right}.id"))
            left = right

    # conditions

    def operand(self) -> Column:
        if self.at < len(self.tokens) and self.tokens[self.at][0] == "name" and not self.peek("TRUE", "FALSE", "NULL"):
            name = self.next("name")
            if self.take("("):
                if name.lower() not in ("type", "label", "tolower", "toupper", "size"):
                    raise CypherError(f"unknown function {name}")
                if name.lower() in ("type", "label"):
                    inner = self.column(self.next("name"), "rel_type")
                else:
                    inner = {"tolower": F.lower, "toupper": F.upper, "size": F.length}[name.lower()](self.operand())
                self.need(")")
                return inner
            if self.take("."):
                return self.column(name, self.next("name"))
            if name in self.nodes or name in self.relations or name in self.values:
                return F.col(name)
            raise CypherError(f"unknown variable {name}")
        return F.lit(self.value())

    def comparison(self) -> Column:
        if self.take("("):
            inner = self.either()
            self.need(")")
            return inner
        left = self.operand()
        for op, use in (("=", Column.__eq__), ("<>", Column.__ne__), ("<=", Column.__le__), (">=", Column.__ge__), ("<", Column.__lt__), (">", Column.__gt__)):
            if self.take(op):
                return use(left, self.operand())
        if self.take("CONTAINS"):
            return left.contains(self.operand())
        if self.take("STARTS"):
            self.need("WITH")
            return left.startswith(self.operand())
        if self.take("ENDS"):
            self.need("WITH")
            return left.endswith(self.operand())
        if self.take("IN"):
            self.need("[")
            values = []
            while not self.take("]"):
                values.append(self.value())
                self.take(",")
            return left.isin(values)
        if self.take("IS"):
            negative = self.take("NOT")
            self.need("NULL")
            return left.isNotNull() if negative else left.isNull()
        return left

    def negated(self) -> Column:
        return ~self.negated() if self.take("NOT") else self.comparison()

    def both(self) -> Column:
        found = self.negated()
        while self.take("AND"):
            found = found & self.negated()
        return found

    def either(self) -> Column:
        found = self.both()
        while self.take("OR"):
            found = found | self.both()
        return found

    # results

    def item(self) -> tuple[str, Column, bool]:
        start = self.at
        name = self.tokens[self.at][1].lower()
        aggregate = name in AGGREGATES and self.tokens[self.at + 1 : self.at + 2] == [("op", "(")]
        if aggregate:
            self.at += 2
            distinct = self.take("DISTINCT")
            inner = F.lit(1) if self.take("*") else self.operand()
            self.need(")")
            use = {"count": F.count_distinct if distinct else F.count, "collect": (lambda c: F.array_sort(F.collect_set(c) if distinct else F.collect_list(c))), "min": F.min, "max": F.max, "sum": F.sum, "avg": F.avg}[name]
            column = use(inner)
        else:
            column = self.operand()
        text = "".join(t for _, t in self.tokens[start : self.at])
        return (self.next("name") if self.take("AS") else text), column, aggregate

    def match(self) -> None:
        self.pattern()
        while self.take(","):
            self.pattern()
        if self.take("WHERE"):
            self.rows = self.rows.where(self.either())

    def optional(self) -> None:
        """Rows that the patterns don't match, their conditions included, stay with nulls for what is new."""
        if self.rows is None:
            raise CypherError("OPTIONAL MATCH needs a MATCH before it")
        row, known = self.unnamed(), self.rows.columns
        base = cut(self.rows.withColumn(row, F.monotonically_increasing_id()))  # read twice, with the same numbers
        self.rows = base
        self.match()
        new = [c for c in self.rows.columns if c not in known and c != row]
        self.rows = base.join(self.rows.select(row, *new), row, "left").select(*known, *new)

    def project(self) -> None:
        """What WITH lets through: variables as they are, other values by name, grouped if one of them is an aggregate."""
        distinct, kept = self.take("DISTINCT"), []
        while True:
            bare = self.tokens[self.at][1] if self.tokens[self.at + 1 : self.at + 2] not in ([("op", ".")], [("op", "(")]) else None
            kept.append((self.item(), bare))
            if not self.take(","):
                break
        keys, rest = [c.alias(n) for (n, c, a), _ in kept if not a], [c.alias(n) for (n, c, a), _ in kept if a]
        self.rows = self.rows.groupBy(*keys).agg(*rest) if rest else self.rows.select(*keys)
        self.rows = self.rows.distinct() if distinct else self.rows
        source = {n: bare for (n, *_), bare in kept}
        self.nodes, self.relations = ({n: known[b] for n, b in source.items() if b in known} for known in (self.nodes, self.relations))
        self.values = {n for n in source if n not in self.nodes and n not in self.relations}
        if self.take("WHERE"):
            self.rows = self.rows.where(self.either())

    def run(self) -> DataFrame:
        if not self.peek("MATCH"):
            raise CypherError("a query begins with MATCH")
        while True:
            if self.take("MATCH"):
                self.match()
            elif self.take("OPTIONAL"):
                self.need("MATCH")
                self.optional()
            elif self.take("WITH"):
                self.project()
            else:
                break
        self.need("RETURN")
        distinct = self.take("DISTINCT")
        items = [self.item()]
        while self.take(","):
            items.append(self.item())
        plain = [c.alias(n) for n, c, a in items if not a]
        if any(a for *_, a in items):
            grouped = self.rows.select("*", *[c.alias(f"__k{k}") for k, (_, c, a) in enumerate(items) if not a])
            keys = [f"__k{k}" for k, (*_, a) in enumerate(items) if not a]
            out = grouped.groupBy(*keys).agg(*[c.alias(f"__k{k}") for k, (_, c, a) in enumerate(items) if a])
            out = out.select(*[F.col(f"__k{k}").alias(n) for k, (n, *_) in enumerate(items)])
        else:
            out = None
        order = []
        if self.take("ORDER"):
            self.need("BY")
            names = {n for n, *_ in items}
            while True:
                start = self.at
                name = self.tokens[self.at][1]
                after = self.tokens[self.at + 1 : self.at + 2]
                if name in names and after not in ([("op", ".")], [("op", "(")]):
                    self.at += 1
                    column = F.col(f"`{name}`")
                else:
                    text, column, _ = self.item()
                    if text in names:
                        column = F.col(f"`{text}`")
                    elif out is not None or distinct:
                        raise CypherError(f"cannot order by {''.join(t for _, t in self.tokens[start : self.at])}")
                down = self.take("DESC", "DESCENDING")
                if not down:
                    self.take("ASC", "ASCENDING")
                order.append(column.desc() if down else column.asc())
                if not self.take(","):
                    break
        if out is None:
            hidden = [c for c in self.rows.columns]
            out = self.rows.select(*plain).distinct() if distinct else self.rows.select(*plain, *[F.col(c).alias(f"__row_{c}") for c in hidden])
            if order:
                out = out.orderBy(*[o for o in order]) if distinct else self.rows.select("*", *plain).orderBy(*order)
            out = out.select(*[F.col(f"`{n}`") for n, *_ in items])
        else:
            out = out.distinct() if distinct else out
            out = out.orderBy(*order) if order else out
        if self.take("SKIP"):
            out = out.offset(int(self.next("number")))
        if self.take("LIMIT"):
            out = out.limit(int(self.next("number")))
        if self.at < len(self.tokens):
            raise CypherError(f"cannot read {self.tokens[self.at][1]!r}")
        return out


def paths(edges: DataFrame, low: int, high: int, starts: DataFrame, near: str, far: str) -> DataFrame:
    """(src, dst, rel_type, length): the pairs of ends that ``low`` to ``high`` edges join, once for each length.

    Paths grow level by level from ``starts``, the nodes that the pattern has bound at their ``near`` end.
    """
    step = edges.select("src", "dst").distinct()
    now, found = step.join(starts, near, "left_semi").select("src", "dst"), None
    for k in range(1, high + 1):
        if k > 1:
            now = now.withColumnRenamed(far, "mid").join(step.withColumnRenamed(near, "mid"), "mid").select("src", "dst").distinct()
        if k >= low:
            part = now.withColumn("length", F.lit(k))
            found = part if found is None else found.unionByName(part)
    return found.withColumn("rel_type", F.lit("*"))


def cypher(catalog: Catalog, text: str) -> DataFrame:
    """The rows that a query returns; parts joined by UNION are told apart by name and, without ALL, lose repeated rows."""
    parts, joins = [[]], []
    for token in tokenise(text):
        if token[0] == "name" and token[1].upper() == "UNION":
            parts.append([])
            joins.append(False)
        elif token[0] == "name" and token[1].upper() == "ALL" and len(parts) > 1 and not parts[-1]:
            joins[-1] = True
        else:
            parts[-1].append(token)
    out, *others = [Query(catalog, tokens).run() for tokens in parts]
    for other, every in zip(others, joins):
        if sorted(other.columns) != sorted(out.columns):
            raise CypherError("parts of a UNION return the same names")
        out = out.unionByName(other)
        out = out if every else out.distinct()
    return out
