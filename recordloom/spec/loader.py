"""Channel specs from mapping files.

A file has a list ``mappings``; each entry is one member of a channel.  All checks run when a spec is loaded, before
any data is read.
"""

from __future__ import annotations

import json
import os
import re
import warnings
from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from pathlib import Path

from recordloom.operators.mapping import Field
from recordloom.operators.resolve import Policy

STRATEGIES = {"last_modified", "coalesce", "collect", "bool_or", "origin_wins"}


class SpecError(ValueError):
    """A spec that can't be run; the message names the entry."""


@dataclass(frozen=True)
class Member:
    name: str
    connector: str
    entity: str
    fields: tuple[Field, ...] = ()
    filter: str | None = None
    reverse_filter: str | None = None
    id_field: str | None = None
    parent: str | None = None
    array_path: str | None = None
    element_key: str | None = None
    scalar: bool = False
    parent_fields: tuple[str, ...] = ()
    order_by: tuple[tuple[str, bool], ...] = ()
    soft_delete: tuple[str, str] | None = None
    full_snapshot: bool = False
    watermark: str | None = None
    updated: str | None = None
    created: str | None = None


@dataclass(frozen=True)
class Channel:
    name: str
    members: tuple[Member, ...]
    identity: tuple[tuple[str, ...], ...] = ()
    policy: Policy = field(default_factory=Policy)
    propagate_deletes: bool = False


def _interpolate(value, env):
    if isinstance(value, str):
        return re.sub(r"\$\{(\w+)\}", lambda m: env.get(m[1], ""), value)
    if isinstance(value, list):
        return [_interpolate(v, env) for v in value]
    if isinstance(value, dict):
        return {k: _interpolate(v, env) for k, v in value.items()}
    return value


def _field(raw, where: str) -> Field:
    if isinstance(raw, str):
        raw = {"target": raw}
    raw = dict(raw)
    if "target" not in raw:
        raise SpecError(f"{where}: a field without a target")
    name = f"{where}.{raw['target']}"
    if raw.get("source") and raw.get("source_path"):
        raise SpecError(f"{name}: source and source_path exclude each other")
    if "[" in (raw.get("source_path") or "") and raw.get("direction") != "forward_only":
        raise SpecError(f"{name}: a path with an index is forward_only")
    if raw.get("value_map") and raw.get("expression"):
        raise SpecError(f"{name}: value_map and expression exclude each other")
    if raw.get("strategy") and raw["strategy"] not in STRATEGIES:
        raise SpecError(f"{name}: unknown strategy {raw['strategy']!r}")
    if raw.get("direction", "bidirectional") not in ("bidirectional", "forward_only", "reverse_only"):
        raise SpecError(f"{name}: unknown direction {raw['direction']!r}")
    if raw.get("entity_connector") and not raw.get("entity"):
        raise SpecError(f"{name}: entity_connector needs an entity")
    table = raw.get("value_map") or {}
    if len(set(table.values())) < len(table) and not raw.get("reverse_value_map"):
        warnings.warn(f"{name}: several keys of the value map have one value; the last one is written back", stacklevel=2)
    if "value_map_fallback" in raw:
        raw["fallback"] = raw.pop("value_map_fallback")
    raw["element_fields"] = tuple(_field(f, name) for f in raw.get("element_fields", ()))
    known = {k: v for k, v in raw.items() if k in Field.__dataclass_fields__}
    return Field(**known, options={k: v for k, v in raw.items() if k not in known})


def _member(raw: dict, channel: str) -> Member:
    name = raw.get("name") or f"{raw.get('connector')}.{raw.get('entity')}"
    where = f"{channel}/{name}"
    if not raw.get("connector") and not raw.get("parent"):
        raise SpecError(f"{where}: a member needs a connector")
    if raw.get("scalar") and raw.get("element_key"):
        raise SpecError(f"{where}: scalar and element_key exclude each other")
    if sum(bool(raw.get(k)) for k in ("order_by", "order", "order_linked_list")) > 1:
        raise SpecError(f"{where}: one way of ordering at most")
    if raw.get("array_path") and (raw.get("soft_delete") or raw.get("full_snapshot")):
        raise SpecError(f"{where}: array members take neither soft_delete nor full_snapshot")
    if raw.get("parent") and not raw.get("array_path") and not raw.get("entity"):
        raise SpecError(f"{where}: a child in its parent's row needs an entity")
    order = tuple((o, True) if isinstance(o, str) else (o["field"], o.get("direction", "asc") != "desc") for o in raw.get("order_by", ()))
    soft = raw.get("soft_delete")
    return Member(
        name, raw.get("connector", ""), raw.get("entity") or raw.get("array_path") or "", tuple(_field(f, where) for f in raw.get("fields", ())), raw.get("filter"), raw.get("reverse_filter"), raw.get("id_field"), raw.get("parent"), raw.get("array_path"),
        raw.get("element_key"), bool(raw.get("scalar")), tuple(raw.get("parent_fields", ())), order, (soft["type"], soft.get("field") or soft.get("expression", "")) if soft else None, bool(raw.get("full_snapshot")),
        raw.get("watermark"), raw.get("updated"), raw.get("created"),
    )


def _over(common: dict, own: dict) -> dict:
    """A channel's conflict settings over the common ones, key by key; ``fields`` has strategies by field."""
    own = dict(own)
    blocks = own.pop("fields", {})
    if blocks:
        if "strategy" in blocks:
            raise SpecError("conflict.fields: 'strategy' is no field name")
        own["field_strategies"] = {f: b["strategy"] if isinstance(b, dict) else b for f, b in blocks.items()} | own.get("field_strategies", {})
    for f, strategy in own.get("field_strategies", {}).items():
        if strategy not in STRATEGIES:
            raise SpecError(f"conflict: unknown strategy {strategy!r} of {f}")
    return {k: {**common[k], **own[k]} if k in own and isinstance(common.get(k), dict) else own.get(k, common.get(k)) for k in {**common, **own}}


def _promote(members: Sequence[Member], where: str, declared: dict) -> Policy:
    """Field hints of all members as one policy; two members must not contradict each other."""
    strategies: dict[str, str] = {}
    masters: dict[str, str] = dict(declared.get("field_masters", {}))
    groups: dict[str, str] = {}
    normalize: dict[str, str] = {}
    priorities: dict[tuple[str, str], int] = {}
    for m in members:
        for f in m.fields:
            for table, value in ((strategies, f.strategy), (groups, f.group), (normalize, f.normalize)):
                if value is not None and table.setdefault(f.target, value) != value:
                    raise SpecError(f"{where}: {f.target} has both {table[f.target]!r} and {value!r}")
            if f.master:
                if masters.setdefault(f.target, m.connector) != m.connector:
                    raise SpecError(f"{where}: {f.target} has two masters")
            if f.priority is not None and priorities.setdefault((m.connector, f.target), f.priority) != f.priority:
                raise SpecError(f"{where}: {m.connector}.{f.target} has two priorities")
    return Policy(declared.get("strategy", "last_modified"), strategies | declared.get("field_strategies", {}), declared.get("priorities", {}), priorities, masters, declared.get("reducers", {}), normalize, groups)


def parse_channels(docs: Sequence[dict], env: dict[str, str] | None = None) -> dict[str, Channel]:
    """Channels of parsed files, merged in the order given."""
    entries: dict[str, list[dict]] = {}
    settings: dict[str, dict] = {}
    common: dict = {}
    for doc in docs:
        doc = _interpolate(doc, os.environ if env is None else env)
        common = _over(common, doc.get("conflict", {}))
        for c in doc.get("channels", ()):
            settings.setdefault(c["id"], {}).update(c)
        for e in doc.get("mappings", ()):
            if "channel" not in e:
                raise SpecError(f"{e.get('name', 'an entry')}: no channel")
            entries.setdefault(e["channel"], []).append(e)
    out, names = {}, {}
    for channel, raws in entries.items():
        members = [_member(r, channel) for r in raws]
        for m in members:
            if m.name in names:
                raise SpecError(f"{channel}: two members are named {m.name!r}")
            names[m.name] = m
        own = settings.get(channel, {})
        groups = tuple((g,) if isinstance(g, str) else tuple(g["fields"] if isinstance(g, dict) else g) for g in own.get("identity", ()))
        out[channel] = Channel(channel, tuple(members), groups, _promote(members, channel, _over(common, own.get("conflict", {}))), bool(own.get("propagate_deletes")))
    for c in out.values():  # an array child without a name of its own is called after its source
        named = [replace(m, entity=f"{names[m.parent].entity}/{m.array_path}") if m.array_path and m.parent in names and m.entity == m.array_path else m for m in c.members]
        out[c.name] = replace(c, members=tuple(named))
    known = {m.entity for c in out.values() for m in c.members}
    for c in out.values():
        for m in c.members:
            for f in m.fields:
                if f.options.get("entity") and f.options["entity"] not in known:
                    warnings.warn(f"{m.name}.{f.target}: no channel has the entity {f.options['entity']!r}", stacklevel=2)
    for m in names.values():
        seen, at = {m.name}, m
        while at.parent:
            if at.parent not in names:
                raise SpecError(f"{m.name}: unknown parent {at.parent!r}")
            at = names[at.parent]
            if at.name in seen:
                raise SpecError(f"{m.name}: parents in a circle")
            seen.add(at.name)
            if m.connector and at.connector and m.connector != at.connector:
                raise SpecError(f"{m.name}: its parent is of another connector")
    return out


def load_channels(folder: str) -> dict[str, Channel]:
    """All mapping files of a folder, in order of their names."""
    docs = []
    for p in sorted(Path(folder).iterdir()):
        if p.suffix == ".json":
            docs.append(json.loads(p.read_text()))
        elif p.suffix in (".yaml", ".yml"):
            import yaml

            docs.append(yaml.safe_load(p.read_text()) or {})
    return parse_channels(docs)
