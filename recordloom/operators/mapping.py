"""Field mapping: declarative specs compiled to column lists, so Catalyst sees the whole projection.

A mapping is a whitelist: what no field names is dropped, and no fields give no columns.  Inbound, a field's value is
its expression, else its path, else its source column (null if there is none); then default, value map and element fields
apply in this order.  Outbound mirrors it without defaults.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Field:
    """One mapped field.  ``target`` is the canonical name, ``source`` the local one (the same if left out)."""

    target: str
    source: str | None = None
    expression: str | None = None
    source_path: str | None = None
    direction: str = "bidirectional"
    default: object = None
    default_expression: str | None = None
    value_map: dict[str, str] | None = None
    fallback: str = "passthrough"
    reverse_value_map: dict[str, str] | None = None
    reverse_expression: str | None = None
    element_fields: tuple[Field, ...] = ()
    reverse_required: bool = False
    normalize: str | None = None
    strategy: str | None = None
    priority: int | None = None
    master: str | None = None
    group: str | None = None
    options: dict = field(default_factory=dict, hash=False, compare=False)

    @property
    def local(self) -> str:
        return self.source or self.target


STEP = re.compile(r"([^.\[\]]+)|\[(\d+)\]")
NAME = re.compile(r"'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"|[A-Za-z_]\w*")


def at_path(path: str, schema: T.StructType | None = None) -> Column:
    """``a.b[2].c`` of a row; null where a step is missing.  A string on the way is read as JSON."""
    head, *steps = [(m[1], m[2]) for m in STEP.finditer(path)]
    out = F.col(f"`{head[0]}`")
    kind = schema[head[0]].dataType if schema and head[0] in schema.fieldNames() else None
    for i, (name, index) in enumerate(steps):
        if isinstance(kind, T.StringType):
            rest = "$" + "".join(f"[{n}]" if n else f".{s}" for s, n in steps[i:])
            return F.get_json_object(out, rest)
        out = F.get(out, F.lit(int(index))) if index else out.getField(name)
        if isinstance(kind, T.ArrayType) and index:
            kind = kind.elementType
        elif isinstance(kind, T.StructType) and name:
            kind = kind[name].dataType
        else:
            kind = None
    return out


def mapped(value: Column, table: dict[str, str], fallback: str = "passthrough") -> Column:
    """A value map; null stays null, what the map lacks passes through or becomes null."""
    if not table:
        return value if fallback == "passthrough" else F.lit(None).cast("string")
    pairs = F.create_map(*(F.lit(x) for kv in table.items() for x in kv))
    hit = F.try_element_at(pairs, value.cast("string"))
    return F.when(value.isNull(), F.lit(None).cast("string")).otherwise(F.coalesce(hit, value.cast("string")) if fallback == "passthrough" else hit)


def inverted(table: dict[str, str]) -> dict[str, str]:
    """The inverse of a value map; of keys with one value the last counts."""
    return {v: k for k, v in table.items()}


def rewritten(text: str, names: dict[str, str]) -> str:
    """A SQL expression with its column names replaced; text in quotes, functions and struct fields stay."""
    out, at = [], 0
    for m in NAME.finditer(text):
        word = m[0]
        if word in names and not word.startswith(("'", '"')) and text[m.end() :].lstrip()[:1] != "(" and text[: m.start()].rstrip()[-1:] != ".":
            out += [text[at : m.start()], names[word]]
            at = m.end()
    return "".join([*out, text[at:]])


def elements(array: str, fields: Sequence[Field], kind: T.DataType | None, inbound: bool = True, depth: int = 0) -> str:
    """SQL for an array whose structs are mapped by ``fields``, each with all that a mapping has; other elements stay as they are."""
    if not isinstance(kind, T.ArrayType) or not isinstance(kind.elementType, T.StructType):
        return array
    e, inner = f"e{depth}", kind.elementType
    have = {n: f"{e}.`{n}`" for n in inner.fieldNames()}
    done: dict[str, str] = {}
    for f in fields:
        if f.direction == ("reverse_only" if inbound else "forward_only"):
            continue
        source, name = (f.local, f.target) if inbound else (f.target, f.local)
        text = f.expression if inbound else f.reverse_expression
        if text:
            value = f"({rewritten(text, have)})"
        elif inbound and f.source_path:
            head, *rest = [m[1] if m[1] else f"[{m[2]}]" for m in STEP.finditer(f.source_path)]
            value = have.get(head, "CAST(NULL AS string)") + "".join(x if x[0] == "[" else f".`{x}`" for x in rest)
        elif source not in have:
            if not inbound or f.default is None and not f.default_expression:
                continue
            value = "NULL"
        else:
            value = have[source]
        if inbound and f.default_expression:
            value = f"coalesce({value}, {rewritten(f.default_expression, done)})"
        elif inbound and f.default is not None:
            value = f"coalesce({value}, {literal(f.default)})"
        table = f.value_map if inbound else f.reverse_value_map if f.reverse_value_map is not None else inverted(f.value_map) if f.value_map else None
        if table is not None:
            pairs = ", ".join(f"WHEN {literal(k)} THEN {literal(v)}" for k, v in table.items())
            other = f"CAST({value} AS string)" if f.fallback == "passthrough" else "NULL"
            value = f"CASE CAST({value} AS string) {pairs} ELSE {other} END" if table else other
        if f.element_fields and source in have:
            value = elements(value, f.element_fields, inner[source].dataType, inbound, depth + 1)
        done[name] = value
    cols = ", ".join(f"{literal(n)}, {v}" for n, v in done.items())
    return f"transform({array}, {e} -> IF({e} IS NULL, NULL, named_struct({cols})))"


def literal(value: object) -> str:
    """A plain value as SQL."""
    if isinstance(value, bool) or value is None:
        return str(value).upper() if value is not None else "NULL"
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'" if isinstance(value, str) else str(value)


def inbound(df: DataFrame, fields: Sequence[Field], keep: Sequence[str] = ()) -> DataFrame:
    """The canonical rows of a source; ``keep`` columns (ids, timestamps) come along.

    A missing value takes the field's default expression, which sees the fields before it in the list, else its default;
    the value map comes after these, and an array's element fields last.
    """
    out, names = df, [f"_in{i}" for i in range(len(fields))]
    done: dict[str, str] = {}
    for f, name in zip(fields, names, strict=True):
        if f.direction == "reverse_only":
            continue
        if not f.expression and not f.source_path and f.local not in df.columns:
            v = F.lit(None).cast("string")
        else:
            v = F.expr(f.expression) if f.expression else at_path(f.source_path, df.schema) if f.source_path else F.col(f"`{f.local}`")
        if f.default_expression:
            v = F.coalesce(v, F.expr(rewritten(f.default_expression, done)))
        elif f.default is not None:
            v = F.coalesce(v, F.lit(f.default))
        if f.value_map is not None:
            v = mapped(v, f.value_map, f.fallback)
        out = out.withColumn(name, v)
        if f.element_fields:
            out = out.withColumn(name, F.expr(elements(name, f.element_fields, out.schema[name].dataType)))
        done[f.target] = name
    return out.select(*keep, *(F.col(n).alias(t) for t, n in done.items()))


def _nested(paths: dict[tuple[str, ...], Column]) -> list[Column]:
    """Columns for paths; shared prefixes become one struct."""
    out: list[Column] = []
    heads = dict.fromkeys(p[0] for p in paths)
    for h in heads:
        below = {p[1:]: v for p, v in paths.items() if p[0] == h}
        out.append((below[()] if () in below else F.struct(*_nested(below))).alias(h))
    return out


def outbound(df: DataFrame, fields: Sequence[Field], keep: Sequence[str] = ()) -> DataFrame:
    """Canonical rows in a target's terms: names, paths and values mapped back.

    A reverse expression that gives a struct is spread over its fields; any other value goes to the local name.
    """
    paths: dict[tuple[str, ...], Column] = {}
    for f in fields:
        if f.direction == "forward_only":
            continue
        if f.reverse_expression:
            kind = df.select(F.expr(f.reverse_expression).alias("x")).schema["x"].dataType
            if isinstance(kind, T.StructType):
                for name in kind.fieldNames():
                    paths[(name,)] = F.expr(f.reverse_expression).getField(name)
            else:
                paths[(f.local,)] = F.expr(f.reverse_expression)
            continue
        if f.target not in df.columns:
            continue
        v = F.col(f"`{f.target}`")
        table = f.reverse_value_map if f.reverse_value_map is not None else inverted(f.value_map) if f.value_map else None
        if table is not None:
            v = mapped(v, table, f.fallback)
        if f.element_fields:
            v = F.expr(elements(f"`{f.target}`", f.element_fields, df.schema[f.target].dataType, inbound=False))
        if f.source_path and "[" in f.source_path:
            raise ValueError(f"{f.target}: a path with an index can't be written back")
        paths[tuple(f.source_path.split(".")) if f.source_path else (f.local,)] = v
    return df.select(*keep, *_nested(paths))


def required_present(df: DataFrame, fields: Sequence[Field]) -> DataFrame:
    """Outbound rows that have all fields which the target needs."""
    return df.dropna(subset=[f.local for f in fields if f.reverse_required])


def with_id_field(df: DataFrame, name: str, id_col: str) -> DataFrame:
    """The record's id as a data column; data of that name wins."""
    return df.withColumn(name, F.coalesce(F.col(name).cast("string"), F.col(id_col)) if name in df.columns else F.col(id_col))


def without_metadata(df: DataFrame) -> DataFrame:
    """Columns that begin with an underscore go."""
    return df.select(*(f"`{c}`" for c in df.columns if not c.startswith("_")))


def split_embedded(df: DataFrame, id_col: str, child: str, parent_fields: Sequence[Field], child_fields: Sequence[Field]) -> tuple[DataFrame, DataFrame]:
    """One row as a parent and a child entity; the child's id is ``<id>#<child>``."""
    return inbound(df, parent_fields, keep=[id_col]), inbound(df.withColumn(id_col, F.concat(F.col(id_col), F.lit(f"#{child}"))), child_fields, keep=[id_col])


def field_timestamp(native: Column | None, same: Column, shadow_ts: Column, updated: Column | None, ingest: Column) -> Column:
    """A field's time: its own; if unchanged the later of the known and this pass; else the record's, else this pass."""
    parts = [] if native is None else [native]
    parts += [F.when(same, F.greatest(shadow_ts, ingest))]
    parts += [] if updated is None else [updated]
    return F.coalesce(*parts, ingest)


def parse_ts(value: Column) -> Column:
    """Epoch milliseconds of a number or an ISO-8601 text; null where it is neither."""
    return F.coalesce(value.cast("string").try_cast("bigint"), F.unix_millis(F.try_to_timestamp(value.cast("string"))))


def deleted(kind: str, column: str) -> Column:
    """Soft deletion: ``deleted_flag``, ``timestamp``, ``active_flag`` or a SQL ``expression`` over the row."""
    c = F.col(column) if kind != "expression" else None
    if kind == "deleted_flag":
        return F.coalesce(c != F.lit(False), F.lit(False))
    if kind == "timestamp":
        return c.isNotNull()
    if kind == "active_flag":
        return ~c.eqNullSafe(F.lit(True))
    if kind == "expression":
        return F.coalesce(F.expr(column), F.lit(False))
    raise ValueError(f"unknown soft delete {kind!r}")


def passing(df: DataFrame, predicate: str | None) -> DataFrame:
    """Rows for which a record filter holds; null counts as not."""
    return df if predicate is None else df.where(predicate)


def routed(df: DataFrame, routes: dict[str, str | None], name: str = "route") -> DataFrame:
    """Rows of every route whose filter they pass, in one scan: a row may take several."""
    hits = F.array(*(F.when(F.lit(True) if p is None else F.expr(p), F.lit(r)) for r, p in routes.items()))
    return df.withColumn(name, F.explode(F.array_compact(hits)))
