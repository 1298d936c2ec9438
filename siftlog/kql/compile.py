"""From a query's tree to one boolean Column.

A leaf of a query becomes, for each type that its literal may meet, a guard (the value is
there and of that type) and a comparison. It holds if any guard and comparison hold;
negated, if any guard holds and its comparison does not. So a record without the key, or
with an unrelated type under it, matches neither a predicate nor its negation.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import wildcard
from ..plans.catalog import JsonRoot, TypedLeaf, discover, quoted, type_tag, typed_leaves, variant_at
from .parser import EQ, EXISTS, GE, GT, LE, LT, And, KqlError, Leaf, Literal, Not, Or, Path, leaves, parse, pushed

#: Arrays within arrays that a predicate descends into.
ARRAY_DEPTH = 3
#: Marks, in a table of paths, a column's paths within arrays.
IN_ARRAYS = "[]"


def any_of(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, columns) if columns else F.lit(False)


def compare(column: Column, op: str, value) -> Column:
    other = value if isinstance(value, Column) else F.lit(value)
    return {EQ: column == other, LT: column < other, LE: column <= other, GT: column > other, GE: column >= other}[op]


@dataclass
class Branch:
    guard: Column
    test: Column


@dataclass
class Scope:
    """Where keys are looked up: typed leaves, JSON roots, and namespaces of their own."""

    typed: list[TypedLeaf]
    json: list[JsonRoot] = field(default_factory=list)
    namespaces: dict[str, "Scope"] = field(default_factory=dict)
    ignore_case: bool = False


def scope_of(
    df: DataFrame,
    json_columns: tuple[str, ...] = (),
    namespaces: dict[str, list[str]] | None = None,
    ignore_case: bool = False,
    paths: dict[str, list[tuple[str, ...]]] | None = None,
    root: str | None = None,
) -> Scope:
    """Scope of a DataFrame's columns.

    json_columns: text columns that hold JSON. namespaces: columns that stand in '@' or '$'
    and not among the rest. paths: known leaf paths of JSON columns, for key wildcards and
    bare values. root: a JSON column whose keys are top-level keys.
    """
    namespaces = namespaces or {}
    away = {c for cs in namespaces.values() for c in cs}
    json_names = [f.name for f in df.schema if isinstance(f.dataType, T.VariantType) or f.name in json_columns]

    def make(names: list[str], strip: bool) -> Scope:
        fields = T.StructType([df.schema[n] for n in names])
        typed = typed_leaves(fields, frozenset(json_names))
        if strip:  # a struct column's fields are the namespace's keys
            typed = [TypedLeaf(x.tokens[1:] if len(x.tokens) > 1 else x.tokens, x.dtype, x.column) for x in typed]
        roots = []
        for n in names:
            if n in json_names:
                column = F.col(quoted(n))
                if not isinstance(df.schema[n].dataType, T.VariantType):
                    column = F.try_parse_json(column)
                known = (paths or {}).get(n)
                inside = tuple(map(tuple, (paths or {}).get(n + IN_ARRAYS, ())))
                roots.append(JsonRoot(() if strip or n == root else (n,), column, None if known is None else tuple(map(tuple, known)), inside))
        return Scope(typed, roots, {}, ignore_case)

    main = make([n for n in df.columns if n not in away], False)
    main.namespaces = {k: make(v, True) for k, v in namespaces.items()}
    return main


def lookup_paths(df: DataFrame, json_columns: tuple[str, ...]) -> dict[str, list[tuple[str, ...]]]:
    """Leaf paths of the JSON columns, from one pass over each; their number follows the
    schema of the logs, not their size."""
    out = {}
    for f in df.schema:
        if isinstance(f.dataType, T.VariantType) or f.name in json_columns:
            column = F.col(quoted(f.name))
            if not isinstance(f.dataType, T.VariantType):
                column = F.try_parse_json(column)
            found = discover(df, column).select("path", "in_array").distinct().collect()
            out[f.name] = [tuple(r["path"]) for r in found if not r["in_array"]]
            out[f.name + IN_ARRAYS] = sorted({tuple(r["path"]) for r in found if r["in_array"]} - set(out[f.name]))
    return out


def needs_paths(tree: object) -> bool:
    return any(leaf.path.wild for leaf in leaves(tree))


# -- predicates on one value


def int_test(column: Column, op: str, literal: Literal) -> Column | None:
    value = literal.value
    if literal.kind == "timestamp" or isinstance(value, int):
        return compare(column, op, F.lit(value).cast("long"))
    if op == EQ:
        return compare(column, EQ, F.lit(int(value)).cast("long")) if value.is_integer() and abs(value) < 2**63 else F.lit(False)
    bound = math.ceil(value) if op in (LT, GE) else math.floor(value)
    if not -(2**63) <= bound < 2**63:
        return F.lit((bound > 0) == (op in (LT, LE)))
    return compare(column, op, F.lit(bound).cast("long"))


def float_test(column: Column, op: str, literal: Literal) -> Column:
    if literal.kind == "timestamp":
        return compare(column, op, literal.value / 1e9)
    if isinstance(literal.value, int) and abs(literal.value) > 2**53:  # exact, not through double
        # no decimal holds every double; outside the longs the order is plain
        outside = F.when(column >= 9.3e18, compare(F.lit(1), op, 0)).when(column <= -9.3e18, compare(F.lit(-1), op, 0))
        return F.coalesce(outside, compare(column.cast("decimal(38,15)"), op, F.lit(literal.value).cast("decimal(38,15)")))
    return compare(column, op, float(literal.value))


def string_test(column: Column, op: str, literal: Literal, ignore_case: bool) -> Column | None:
    if op != EQ or literal.kind == "timestamp":
        return None
    if literal.kind == "string":
        return wildcard.matches(column, literal.value, ignore_case)
    text = F.lit(literal.text)
    return F.lower(column) == F.lower(text) if ignore_case else column == text


def timestamp_test(column: Column, dtype: T.DataType, op: str, literal: Literal) -> Column | None:
    if literal.kind == "int":
        nanos = literal.value
    elif literal.kind == "timestamp":
        nanos = literal.value
    else:
        return None
    micros, rest = divmod(nanos, 1000)
    if rest:
        if op == EQ:
            return F.lit(False)
        micros += op in (LT, GE)
    # a literal of the column's own type reaches the reader as a filter
    return compare(column, op, F.timestamp_micros(F.lit(micros)).cast(dtype))


def typed_branches(leaf: TypedLeaf, op: str, literal: Literal, ignore_case: bool) -> list[Branch]:
    column, dtype = leaf.column, leaf.dtype
    there = column.isNotNull()
    if op == EXISTS:
        return [Branch(there, F.lit(True))]
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        test = int_test(column, op, literal) if literal.kind in ("int", "float", "timestamp") else None
    elif isinstance(dtype, (T.FloatType, T.DoubleType, T.DecimalType)):
        test = float_test(column, op, literal) if literal.kind in ("int", "float", "timestamp") else None
    elif isinstance(dtype, T.StringType):
        test = string_test(column, op, literal, ignore_case)
    elif isinstance(dtype, T.BooleanType):
        test = column == F.lit(literal.value) if literal.kind == "bool" and op == EQ else None
    elif isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        test = timestamp_test(column, dtype, op, literal)
    elif isinstance(dtype, T.ArrayType):
        test = F.coalesce(F.exists(column, lambda x: element_test(x, dtype.elementType, op, literal, ignore_case)), F.lit(False))
    else:
        test = None
    return [Branch(there, test)] if test is not None else []


def element_test(x: Column, dtype: T.DataType, op: str, literal: Literal, ignore_case: bool, tokens: tuple[str, ...] = ()) -> Column:
    """Whether an array's element, or what is under ``tokens`` in it, matches."""
    if isinstance(dtype, T.StructType):
        if tokens and tokens[0] in dtype.names:
            inner = dtype[tokens[0]].dataType
            return element_test(x.getField(tokens[0]), inner, op, literal, ignore_case, tokens[1:])
        return F.lit(False)
    if isinstance(dtype, T.ArrayType):
        return F.coalesce(F.exists(x, lambda y: element_test(y, dtype.elementType, op, literal, ignore_case, tokens)), F.lit(False))
    if tokens:
        return F.lit(False)
    if literal.kind == "null" and op == EQ:
        return x.isNull() | (x == F.lit("null") if isinstance(dtype, T.StringType) else F.lit(False))
    found = typed_branches(TypedLeaf((), dtype, x), op, literal, ignore_case)
    return F.coalesce(any_of([b.guard & b.test for b in found]), F.lit(False))


def variant_branches(v: Column, op: str, literal: Literal, ignore_case: bool, depth: int = ARRAY_DEPTH) -> list[Branch]:
    """Branches of a variant value: an integer, a number, a text, a boolean, null, an array."""
    tag = type_tag(v)
    if op == EXISTS:  # an object is no leaf
        return [Branch(v.isNotNull() & (tag != "OBJECT"), F.lit(True))]

    def at(kind: str) -> Column:
        return F.try_variant_get(v, "$", kind)

    out = []
    if literal.kind in ("int", "float", "timestamp"):
        out.append(Branch(tag == "BIGINT", int_test(at("bigint"), op, literal)))
        out.append(Branch(tag.isin("DECIMAL", "DOUBLE", "FLOAT"), float_test(at("double"), op, literal)))
    if literal.kind == "bool" and op == EQ:
        out.append(Branch(tag == "BOOLEAN", at("boolean") == F.lit(literal.value)))
    if literal.kind == "null" and op == EQ:
        out.append(Branch(tag == "VOID", F.lit(True)))
    text = string_test(at("string"), op, literal, ignore_case)
    if text is not None:
        out.append(Branch(tag == "STRING", text))
    if depth:
        out.append(Branch(tag == "ARRAY", any_element(v, (), op, literal, ignore_case, depth - 1)))
    return out


def any_element(v: Column, tokens: tuple[str, ...], op: str, literal: Literal, ignore_case: bool, depth: int) -> Column:
    """Whether an element of a variant array matches under ``tokens``."""
    elements = F.try_variant_get(v, "$", "array<variant>")
    return F.coalesce(F.exists(elements, lambda x: variant_test(x, tokens, op, literal, ignore_case, depth)), F.lit(False))


def variant_test(v: Column, tokens: tuple[str, ...], op: str, literal: Literal, ignore_case: bool, depth: int) -> Column:
    """Whether a variant value, or anything its path reaches through arrays, matches."""
    here = variant_at(v, tokens)
    found = [F.coalesce(any_of([b.guard & b.test for b in variant_branches(here, op, literal, ignore_case, depth)]), F.lit(False))]
    if depth:
        for cut in range(len(tokens)):  # an array at any key before the last
            above, below = variant_at(v, tokens[:cut]), tokens[cut:]
            found.append((type_tag(above) == "ARRAY") & any_element(above, below, op, literal, ignore_case, depth - 1))
    return any_of(found)


# -- leaves of a query


def path_matches(pattern: tuple[str, ...], tokens: tuple[str, ...]) -> bool:
    """Whether keys fit a path whose '*' stands for any number of them; empty keys are transparent."""
    tokens = tuple(t for t in tokens if t)
    if not pattern:
        return not tokens
    if pattern[0] == "*":
        return any(path_matches(pattern[1:], tokens[k:]) for k in range(len(tokens) + 1))
    return bool(tokens) and tokens[0] == pattern[0] and path_matches(pattern[1:], tokens[1:])


@dataclass
class Target:
    """What one key path stands for: branches and whether anything is there."""

    branches: list[Branch]
    exists: Column
    nulls: Column


def typed_target(leaf: TypedLeaf, op: str, literal: Literal, ignore_case: bool, below: tuple[str, ...] = ()) -> Target:
    there = leaf.column.isNotNull()
    if below:  # into an array of structs
        inside = F.coalesce(F.exists(leaf.column, lambda x: element_test(x, leaf.dtype.elementType, op, literal, ignore_case, below)), F.lit(False))
        return Target([Branch(there, inside)], there, F.lit(False))
    is_null = F.coalesce(leaf.column == F.lit("null"), F.lit(False)) if isinstance(leaf.dtype, T.StringType) else F.lit(False)
    return Target(typed_branches(leaf, op, literal, ignore_case), there, is_null)


def variant_target(root: JsonRoot, tokens: tuple[str, ...], op: str, literal: Literal, ignore_case: bool) -> Target:
    v = variant_at(root.column, tokens)
    tag = type_tag(v)
    branches = variant_branches(v, op, literal, ignore_case)
    exists = v.isNotNull() & (tag != "OBJECT")
    for cut in range(len(tokens)):
        above, below = variant_at(root.column, tokens[:cut]), tokens[cut:]
        is_array = type_tag(above) == "ARRAY"
        inner = any_element(above, below, op, literal, ignore_case, ARRAY_DEPTH - 1)
        branches.append(Branch(is_array, inner))
        exists = exists | (is_array & inner if op == EXISTS else F.lit(False))
    nulls = (tag == "VOID") | ((tag == "STRING") & (F.try_variant_get(v, "$", "string") == "null"))
    return Target(branches, F.coalesce(exists, F.lit(False)), F.coalesce(nulls, F.lit(False)))


def targets(scope: Scope, path: Path, op: str, literal: Literal) -> list[Target]:
    if path.namespace in ("!", "#"):
        raise KqlError(f"namespace {path.namespace!r} is reserved")
    if path.namespace:
        inner = scope.namespaces.get(path.namespace)
        if inner is None:
            return []
        scope = Scope(inner.typed, inner.json, {}, scope.ignore_case)
    out = []
    for leaf in scope.typed:
        if path_matches(path.tokens, leaf.tokens):
            out.append(typed_target(leaf, op, literal, scope.ignore_case))
        elif isinstance(leaf.dtype, T.ArrayType) and not path.wild and path.tokens[: len(leaf.tokens)] == leaf.tokens:
            out.append(typed_target(leaf, op, literal, scope.ignore_case, path.tokens[len(leaf.tokens) :]))
    for root in scope.json:
        if path.wild:
            if root.paths is None:
                raise KqlError("key wildcards and bare values need the paths of the JSON columns")
            known = root.paths + root.inside if path.pure else root.paths
            out += [variant_target(root, p, op, literal, scope.ignore_case) for p in known if path_matches(path.tokens, root.tokens + p)]
        elif path.tokens[: len(root.tokens)] == root.tokens:
            out.append(variant_target(root, path.tokens[len(root.tokens) :], op, literal, scope.ignore_case))
    return out


def leaf_column(scope: Scope, leaf: Leaf, inverted: bool) -> Column:
    op, literal = leaf.op, leaf.literal
    found = targets(scope, leaf.path, op, literal)
    if op == EXISTS:
        there = any_of([F.coalesce(t.exists, F.lit(False)) for t in found])
        return ~there if inverted else there
    if literal.kind == "null" and op == EQ and inverted:
        return any_of([F.coalesce(t.exists & ~t.nulls, F.lit(False)) for t in found])
    positive = [any_of([b.guard & b.test for b in t.branches]) for t in found]
    if not inverted:
        return any_of(positive)
    if leaf.path.pure:  # no column at all may match
        return ~F.coalesce(any_of([F.coalesce(p, F.lit(False)) for p in positive]), F.lit(False))
    return any_of([b.guard & ~b.test for t in found for b in t.branches])


def compile_tree(tree: object, scope: Scope) -> Column:
    tree = pushed(tree)

    def walk(node: object) -> Column:
        if isinstance(node, Leaf):
            return leaf_column(scope, node, False)
        if isinstance(node, Not):
            return leaf_column(scope, node.child, True)
        left, right = walk(node.left), walk(node.right)
        return left & right if isinstance(node, And) else left | right

    assert isinstance(tree, (Leaf, Not, And, Or))
    return walk(tree)


def compile_query(df: DataFrame, query: str, **options) -> Column:
    """The query as a Column over ``df``; options as for ``scope_of``. Paths in JSON columns are
    looked up only if the query has a key wildcard or a bare value and none are given."""
    tree = parse(query)
    if needs_paths(tree) and options.get("paths") is None:
        options["paths"] = lookup_paths(df, tuple(options.get("json_columns", ())))
    return compile_tree(tree, scope_of(df, **options))
