"""What the records hold: leaf paths with their types, found from schemas and from data."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class TypedLeaf:
    """A column, or a field of a struct column, that is no struct itself."""

    tokens: tuple[str, ...]
    dtype: T.DataType
    column: Column


@dataclass(frozen=True)
class JsonRoot:
    """A VARIANT column, and the leaf paths known to be in it (None: not looked up); ``inside``
    has those that only a bare value reaches, within arrays."""

    tokens: tuple[str, ...]
    column: Column
    paths: tuple[tuple[str, ...], ...] | None = None
    inside: tuple[tuple[str, ...], ...] = ()


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def typed_leaves(schema: T.StructType, skip: frozenset[str] = frozenset()) -> list[TypedLeaf]:
    out: list[TypedLeaf] = []

    def walk(fields, tokens, column) -> None:
        for f in fields:
            here = F.col(quoted(f.name)) if column is None else column.getField(f.name)
            if isinstance(f.dataType, T.StructType):
                walk(f.dataType.fields, (*tokens, f.name), here)
            else:
                out.append(TypedLeaf((*tokens, f.name), f.dataType, here))

    walk([f for f in schema.fields if f.name not in skip], (), None)
    return out


def variant_path(tokens: tuple[str, ...]) -> str:
    """Path text for variant_get."""
    out = "$"
    for t in tokens:
        if "'" not in t:
            out += f"['{t}']"
        elif '"' not in t:
            out += f'["{t}"]'
        else:
            raise ValueError(f"a key with both kinds of quotes: {t!r}")
    return out


def variant_at(column: Column, tokens: tuple[str, ...]) -> Column:
    return F.try_variant_get(column, variant_path(tokens), "variant") if tokens else column


def json_field(df: DataFrame, json_column: str | None, tokens: tuple[str, ...]) -> Column | None:
    """The variant under a dotted name: below the JSON column if the name begins with it, and
    else among its top-level keys. None if the name is that of another column."""
    if json_column is None or tokens[0] in df.columns and tokens[0] != json_column:
        return None
    column = F.col(quoted(json_column))
    if isinstance(df.schema[json_column].dataType, T.StringType):
        column = F.try_parse_json(column)
    return variant_at(column, tokens[1:] if tokens[0] == json_column else tokens)


def type_tag(column: Column) -> Column:
    """Type of a variant's value, without the types of what is inside."""
    return F.regexp_extract(F.schema_of_variant(column), r"^[A-Z]+", 0)


def discover(df: DataFrame, column: Column) -> DataFrame:
    """(path, type, in_array) of every leaf in a VARIANT column: path is an array of keys. Arrays
    and empty objects are leaves; what is inside arrays is listed as well, and marked. Each
    level is one pass; a level with nothing to open ends it."""
    tvf = df.sparkSession.tvf
    level = df.select(F.array().cast("array<string>").alias("path"), column.alias("v"), F.lit(False).alias("in_array")).where("v IS NOT NULL")
    found: DataFrame | None = None
    while True:
        # a lateral explode gives the keys and values of an object, the elements of an array
        each = level.alias("l").lateralJoin(tvf.variant_explode(F.col("v").outer()).alias("e"))
        path = F.when(F.col("e.key").isNull(), F.col("l.path")).otherwise(F.concat("l.path", F.array("e.key")))
        opened = each.select(path.alias("path"), F.col("e.value").alias("v"), (F.col("l.in_array") | F.col("e.key").isNull()).alias("in_array"))
        tagged = opened.withColumn("type", type_tag(F.col("v")))
        inner = (F.col("type") == "OBJECT") & (F.schema_of_variant("v") != "OBJECT<>")
        leaves = tagged.where(~inner & (F.size("path") > 0)).select("path", "type", "in_array").distinct()
        found = leaves if found is None else found.union(leaves)
        level = tagged.where(inner | (F.col("type") == "ARRAY")).select("path", "v", "in_array")
        if level.isEmpty():
            break
    return found.distinct()


def column_index(df: DataFrame, json_columns: tuple[str, ...] = ()) -> DataFrame:
    """(name, type) of every leaf column, dotted; JSON text columns are opened."""
    spark = df.sparkSession
    fixed = [(".".join(x.tokens), x.dtype.simpleString()) for x in typed_leaves(df.schema, frozenset(json_columns)) if not isinstance(x.dtype, T.VariantType)]
    out = spark.createDataFrame(fixed, "name string, type string")
    for name in [*json_columns, *(f.name for f in df.schema if isinstance(f.dataType, T.VariantType))]:
        column = F.col(quoted(name))
        if not isinstance(df.schema[name].dataType, T.VariantType):
            column = F.try_parse_json(column)
        paths = discover(df, column).where(~F.col("in_array"))
        out = out.union(paths.select(F.concat_ws(".", F.array(F.lit(name)), "path").alias("name"), F.lower("type").alias("type")))
    return out


def timestamp_columns(index: DataFrame) -> DataFrame:
    """Names of the columns that hold timestamps."""
    return index.where(F.col("type").isin("timestamp", "timestamp_ntz", "date")).select("name").distinct()
