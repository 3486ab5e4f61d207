"""Nested arrays as child records, and child records back into arrays."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordloom.operators import delta
from recordloom.state.shared import materialise

NAMESPACE = "recordloom-child"


def parsed(df: DataFrame, array: str, schema: str | None) -> DataFrame:
    """An array held as JSON text as an array; other text and other types than arrays are null."""
    kind = df.schema[array].dataType
    if isinstance(kind, T.ArrayType):
        return df
    if isinstance(kind, T.StringType) and schema is not None:
        return df.withColumn(array, F.when(F.ltrim(array).startswith("["), F.from_json(array, schema)))
    return df.withColumn(array, F.lit(None).cast(schema or "array<string>"))


def _key(key: str | None, element_id: str | None) -> Column:
    """An element's own id, else its key field, else its position."""
    own = [F.col(f"element.{c}").cast("string") for c in (element_id, key) if c]
    return F.coalesce(*own, F.col("ordinal").cast("string"))


def expand(df: DataFrame, id_col: str, array: str, key: str | None = None, parent: Sequence[str] = (), where: Callable | None = None, scalar: bool = False, lift: dict[str, Column] | None = None, element_id: str | None = None, schema: str | None = None, pass_through: bool = False) -> DataFrame:
    """One row for each element: ``(id, parent_id, elem_key, ordinal, <parent fields>, element)``.

    The child's id is ``<parent>#<array>[<key>]``; the key is the element's own id (``element_id``), else its key field, else
    its position.  where: ``(element, index)`` to a condition, applied before the rows are made, in which ``F.col`` is the
    parent's.  lift: parent values as fields of the element, unless it has a field of that name.  scalar: elements are plain
    values, and equal ones are one child.  Null elements go.  schema: the type of an array held as JSON text.  pass_through:
    a record without an array stays as a row of its own; otherwise it gives none, as an empty array does.
    """
    df = parsed(df, array, schema)
    items = F.transform(F.col(array), lambda e, i: F.struct(i.alias("ordinal"), e.alias("element")))
    items = F.filter(items, lambda x: x["element"].isNotNull() & (where(x["element"], x["ordinal"]) if where is not None else F.lit(True)))
    names = {} if not lift or scalar else {n: c for n, c in lift.items() if n not in df.schema[array].dataType.elementType.fieldNames()}
    src = df.select(F.col(id_col).alias("parent_id"), *parent, *(c.alias(f"_lift_{n}") for n, c in names.items()), F.col(array).isNull().alias("_flat"), items.alias("_items"))
    rows = src.select("parent_id", *parent, *(f"_lift_{n}" for n in names), F.inline("_items"))
    if names:
        rows = rows.withColumn("element", F.struct("element.*", *(F.col(f"_lift_{n}").alias(n) for n in names)))
    rows = rows.withColumn("elem_key", F.col("element").cast("string") if scalar else _key(key, element_id)).withColumn("id", F.concat("parent_id", F.lit(f"#{array}["), "elem_key", F.lit("]")))
    if scalar:
        rest = [c for c in rows.columns if c not in ("id", "ordinal")]
        rows = rows.groupBy("id").agg(F.min("ordinal").alias("ordinal"), *(F.min_by(c, "ordinal").alias(c) for c in rest))
    rows = rows.select("id", "parent_id", "elem_key", "ordinal", *parent, "element")
    if pass_through:
        none = lambda c: F.lit(None).cast(rows.schema[c].dataType).alias(c)
        rows = rows.unionByName(src.where("_flat").select(F.col("parent_id").cast("string").alias("id"), none("parent_id"), none("elem_key"), none("ordinal"), *parent, none("element")))
    return rows


def expand_chain(df: DataFrame, id_col: str, hops: Sequence[tuple[str, str | None]], where: Callable | None = None) -> DataFrame:
    """Nested arrays over several hops; ids concatenate, and each hop's key stays as ``key_<n>``.  where: as for :func:`expand`, for the last hop's elements only."""
    out = df.select(F.col(id_col).cast("string").alias("id"), F.col(hops[0][0]).alias("items"))
    keys: list[str] = []
    for n, (array, key) in enumerate(hops):
        rows = out.select("id", *keys, F.posexplode("items").alias("ordinal", "element")).where("element IS NOT NULL")
        if where is not None and n + 1 == len(hops):
            rows = rows.where(where(F.col("element"), F.col("ordinal")))
        rows = rows.withColumn(f"key_{n}", _key(key, None))
        out = rows.withColumn("parent_id", F.col("id")).withColumn("id", F.concat("id", F.lit(f"#{array}["), f"key_{n}", F.lit("]")))
        keys.append(f"key_{n}")
        if n + 1 < len(hops):
            out = out.select("id", *keys, F.col(f"element.{hops[n + 1][0]}").alias("items"))
    return out.select("id", "parent_id", *keys, "ordinal", "element")


def child_uuid(parent: Column, path: str, key: Column) -> Column:
    """The canonical id of a child, made of its parent's, the path and its key: a version 5 UUID layout over SHA-256."""
    h = F.sha2(F.concat(F.lit(f"{NAMESPACE}:"), parent, F.lit(f":{path}["), key, F.lit("]")), 256)
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("bigint").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def parent_map(children: DataFrame, path: str) -> DataFrame:
    """``(child_id, parent_id, array_path, element_key)``."""
    return children.select(F.col("id").alias("child_id"), "parent_id", F.lit(path).alias("array_path"), F.col("elem_key").alias("element_key"))


def parent_maps(df: DataFrame, id_col: str, hops: Sequence[tuple[str, str | None]]) -> DataFrame:
    """The parent map of every hop of a chain."""
    parts = [expand_chain(df, id_col, hops[: n + 1]).select(F.col("id").alias("child_id"), "parent_id", F.lit(array).alias("array_path"), F.col(f"key_{n}").alias("element_key")) for n, (array, _) in enumerate(hops)]
    return reduce(DataFrame.unionByName, parts)


def changed_parents(parents: DataFrame, state: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Parents that are new or differ from the state: an unchanged one is left out before its children are made."""
    return parents.join(delta.unchanged(parents, state, key, fields), key, "left_anti")


def absent_elements(before: DataFrame, now: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """For children that are gone: ``(connector, external_id)`` to delete in every member that has them, and ``(parent_id)`` to rebuild.

    ``before`` and ``now`` are ``(id, parent_id)``; links are ``(canonical_id, connector, external_id)`` with the children's ids.
    """
    gone = before.select("id", "parent_id").join(now.select("id"), "id", "left_anti")
    canon = links.join(gone.select(F.col("id").alias("external_id")), "external_id", "left_semi").select("canonical_id").distinct()
    return links.join(canon, "canonical_id", "left_semi").select("connector", "external_id"), gone.select("parent_id").distinct()


def walk_up(ids: DataFrame, parents: DataFrame, linked: DataFrame, depth: int = 16) -> DataFrame:
    """``(child_id, root_id)``: the nearest ancestor, or the child itself, that ``linked`` has; children without one are left out.

    ``ids`` and ``linked`` are ``(id)``, parents ``(child_id, parent_id)``.  All three are read once: one join marks the children
    and whatever is a parent.  What is left of the walk, until nothing is on its way, takes the marked parents alone, and the
    children meet their parents' roots at its end.
    """
    up = parents.select(F.col("child_id").alias("id"), F.col("parent_id").alias("up"))
    above = up.select(F.col("up").alias("id")).where("id IS NOT NULL").distinct()
    nodes = ids.select("id", F.lit(True).alias("start")).unionByName(above.select("id", F.lit(False).alias("start")))
    found = nodes.join(linked.select("id", F.lit(True).alias("found")), "id", "left").alias("n")
    # what is found needs no parent, and must not repeat where it has several
    marked = materialise(found.join(up.alias("u"), F.expr("n.id = u.id AND n.found IS NULL"), "left").select("n.id", "start", "found", "up"), "walk")
    done = marked.where("start AND found").select(F.col("id").alias("child_id"), F.col("id").alias("root_id"))
    if depth < 1:
        return done
    step = marked.where("NOT start").select(F.col("id").alias("at"), "found", "up")
    roots = step.where("found").select(F.col("at").alias("up"), F.col("at").alias("root_id"))
    open_ = step.where("found IS NULL AND up IS NOT NULL").select(F.col("at").alias("id"), F.col("up").alias("at"))
    for _ in range(depth - 1):
        if open_.isEmpty():
            break
        moved = materialise(open_.join(step, "at").where("found OR up IS NOT NULL").select("id", "at", "found", "up"), "walk")
        roots = roots.unionByName(moved.where("found").select(F.col("id").alias("up"), F.col("at").alias("root_id")))
        open_ = moved.where("found IS NULL").select("id", F.col("up").alias("at"))
    return done.unionByName(marked.where("start AND up IS NOT NULL").select(F.col("id").alias("child_id"), "up").join(roots, "up").select("child_id", "root_id"))


def rebuild(children: DataFrame, parent: str, order: Sequence[Column], fields: Sequence[str], where: str | None = None, parents: DataFrame | None = None) -> DataFrame:
    """``(parent, items)``: children as an array of structs, in the order given; one row for each parent.

    where: the reverse filter of elements.  parents: those to rebuild, of which one without children gets an empty array.
    """
    if parents is not None:
        children = children.join(parents.select(parent).distinct(), parent, "left_semi")
    entry = F.struct(F.struct(*order).alias("o"), F.struct(*fields).alias("v"))
    out = (children if where is None else children.where(where)).groupBy(parent).agg(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["v"]).alias("items"))
    if parents is None:
        return out
    return parents.select(parent).distinct().join(out, parent, "left").withColumn("items", F.coalesce("items", F.array().cast(out.schema["items"].dataType)))


def rebuild_scalars(children: DataFrame, parent: str, value: str, order: Sequence[Column], where: str | None = None) -> DataFrame:
    """``(parent, items)``: plain values, each once, by the least order it has."""
    once = (children if where is None else children.where(where)).groupBy(parent, value).agg(F.min(F.struct(*order)).alias("o"))
    return once.groupBy(parent).agg(F.transform(F.array_sort(F.collect_list(F.struct("o", value))), lambda x: x[value]).alias("items"))


def allowed_patches(patches: DataFrame, masters: dict[str, str]) -> DataFrame:
    """Patches ``(..., field, val, src)`` of fields without a master, or by their master."""
    keep = F.lit(True)
    for f, src in masters.items():
        keep = keep & ((F.col("field") != f) | (F.col("src") == src))
    return patches.where(keep)


def gathered(patches: DataFrame, root: Sequence[str], keys: Sequence[str], order: Column) -> DataFrame:
    """``(*root, patches)``: a map of keys, joined by a control character, to a map of fields and their last values, null ones too."""
    last = patches.groupBy(*root, *keys, "field").agg(F.max_by("val", order).alias("val"))
    by_element = last.groupBy(*root, *keys).agg(F.map_from_entries(F.collect_list(F.struct("field", "val"))).alias("set"))
    return by_element.groupBy(*root).agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("\x01", *keys), "set"))).alias("patches"))


def patch(df: DataFrame, id_col: str, hops: Sequence[tuple[str, str]], patches: DataFrame) -> DataFrame:
    """Elements of nested arrays with the fields of their patches; one write for each root.

    hops: ``(array, key)`` from the root down; patches: ``(id_col, patches)`` as :func:`gathered` makes them.  A field that a
    patch names is replaced, by null too; other fields, elements and roots stay, and no element is added.
    """
    array = hops[0][0]
    joined = df.join(patches.select(id_col, F.col("patches").alias("_patches")), id_col, "left")

    def level(items: Column, at: int, before: Column | None, kind: T.DataType) -> Column:
        name, inner = hops[at][1], kind.elementType

        def one(e: Column) -> Column:
            key = e[name].cast("string") if before is None else F.concat_ws("\x01", before, e[name].cast("string"))
            if at + 1 < len(hops):
                below = hops[at + 1][0]
                return F.when(e.isNotNull(), e.withField(below, level(e[below], at + 1, key, inner[below].dataType)))
            new, out = F.try_element_at("_patches", key), e
            for f in inner.fields:
                out = out.withField(f.name, F.when(F.map_contains_key(new, F.lit(f.name)), F.try_element_at(new, F.lit(f.name)).cast(f.dataType)).otherwise(e[f.name]))
            return F.when(new.isNull(), e).otherwise(out)

        return F.transform(items, one)

    new = level(F.col(array), 0, None, df.schema[array].dataType)
    return joined.withColumn(array, F.when(F.col("_patches").isNull(), F.col(array)).otherwise(new)).select(*df.columns)


def element_set(patches: DataFrame, parent: str, key: str, rank: Column) -> DataFrame:
    """``(parent, key, field, val, src)``: of several sources' patches for a field of an element, the least rank wins."""
    return patches.groupBy(parent, key, "field").agg(F.min_by(F.struct("val", "src"), rank).alias("w")).select(parent, key, "field", "w.*")


def ordered(array: Column, spec: Sequence[tuple[str, bool]]) -> Column:
    """Structs sorted by ``(field, ascending)``: as numbers where both are, else as text, a missing one as empty; stable."""

    def compare(a: Column, b: Column) -> Column:
        out = F.lit(0)
        for name, up in reversed(spec):
            x, y = (F.coalesce(r["e"][name].cast("string"), F.lit("")) for r in (a, b))
            nx, ny = x.try_cast("double"), y.try_cast("double")
            less = F.when(nx.isNotNull() & ny.isNotNull(), nx < ny).otherwise(x < y)
            more = F.when(nx.isNotNull() & ny.isNotNull(), nx > ny).otherwise(x > y)
            out = F.when(less, F.lit(-1 if up else 1)).when(more, F.lit(1 if up else -1)).otherwise(out)
        return F.when(out != 0, out).when(a["i"] < b["i"], F.lit(-1)).when(a["i"] > b["i"], F.lit(1)).otherwise(F.lit(0))

    numbered = F.transform(array, lambda e, i: F.struct(i.alias("i"), e.alias("e")))
    return F.transform(F.array_sort(numbered, compare), lambda x: x["e"])


def by_ordinal(array: Column, ordinal: str = "_ordinal") -> Column:
    """Structs by their ordinal, missing ones last; the ordinal goes."""
    numbered = F.transform(array, lambda e, i: F.struct(F.coalesce(e[ordinal], F.lit(2**31 - 1)).alias("o"), i.alias("i"), e.alias("e")))
    return F.transform(F.array_sort(numbered), lambda x: x["e"].dropFields(ordinal))


def neighbours(array: Column, key: str) -> Column:
    """Each struct with its position and the keys before and after it."""
    return F.transform(array, lambda e, i: e.withField("_ordinal", i).withField("_prev", F.get(array, i - 1)[key]).withField("_next", F.get(array, i + 1)[key]))


def linked_list(df: DataFrame, id_col: str, array: str, key: str = "key", before: str = "prev", after: str = "next") -> DataFrame:
    """``(id, items)``: keys of an array's structs in list order.

    The first element whose predecessor is missing is the head (the first of all if there is none); from there the list
    follows who comes next, until that is missing or met before.  Elements that are not reached follow as they stand, and
    null keys go.  The walk is serial within an array, so it runs in Arrow batches, one array at a time.
    """

    def walk(keys: list, prev: list, nxt: list) -> list[str]:
        follows = {k: (p, n) for k, p, n in zip(keys, prev, nxt, strict=True) if k is not None}
        at = next((k for k, (p, _) in follows.items() if p is None or p not in follows), next(iter(follows), None))
        out: dict = {}
        while at in follows and at not in out:
            out[at] = None
            at = follows[at][1]
        return list(out | dict.fromkeys(follows))

    def each(batches):
        for b in batches:
            cols = (b.column(c).to_pylist() for c in ("k", "p", "n"))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([None if k is None else walk(k, p, n) for k, p, n in zip(*cols, strict=True)], pa.list_(pa.string()))], ["id", "items"])

    text = lambda c: F.transform(array, lambda e: e[c].cast("string"))
    src = df.select(F.col(id_col).alias("id"), text(key).alias("k"), text(before).alias("p"), text(after).alias("n"))
    return src.mapInArrow(each, f"id {src.schema['id'].dataType.simpleString()}, items array<string>")
