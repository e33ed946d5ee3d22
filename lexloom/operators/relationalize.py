"""Nested records to related flat tables by shared inlining (problem 1).

1. The schema graph is analysed. The distinct shapes of all records are counted
   (an aggregate, so only distinct shapes travel) and taken apart into edges
   (path of an object, key, kind); only the distinct edges reach the driver,
   with a checked bound. Objects at different paths are one element if their shapes say so:
   an object whose keys are for the most part those of an object above it is that element again
   (recursion); two objects under one key, or with all keys alike, whose shapes agree are one
   shared element; and so are objects under the same key of what is one element.
2. Shared inlining decides the tables: the root, and every repeated, shared or
   recursive element, get a table; a singleton descendant is inlined as columns
   of the nearest ancestor with one. ``keep`` names elements that get a table although they are singletons.
3. Each table is one projection of the parsed records. Rows carry their own key
   and the key of their parent row; a shared element's rows name the table and the path of their parent too.

A lone object where others hold an array counts as an array of one entry. Null,
absent and oddly shaped values give no child rows and NULL columns. Records
that are no JSON object are left out (``operators.quarantine`` separates them). Recursion through
another table (a user's pinned message with a user) is refused with a message that names the elements.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.sources.tweets import once

MAX_EDGES = 20_000
COMMON, LIKE = 3, 0.5  #: keys that an object and its recurrence share at least, and the share of the smaller one's keys
SEP = "\x1f"
_NAME = re.compile(r"\s*(?:`((?:[^`]|``)*)`|([^:<>,]+?))\s*:\s*")
Path = tuple[str, ...]


def parse_shape(ddl: str) -> object:
    """``OBJECT<a: BIGINT, b: ARRAY<...>>`` as nested ('object', {key: type}), ('array', type) or a scalar name."""
    pos = 0

    def read() -> object:
        nonlocal pos
        if ddl.startswith("OBJECT<", pos):
            pos += 7
            out: dict[str, object] = {}
            while ddl[pos] != ">":
                m = _NAME.match(ddl, pos)
                if not m:
                    raise ValueError(f"shape not understood at {pos}: {ddl[:200]}")
                pos = m.end()
                out[(m[1] or "").replace("``", "`") or m[2]] = read()
                if ddl[pos] == ",":
                    pos += 1
            pos += 1
            return ("object", out)
        if ddl.startswith("ARRAY<", pos):
            pos += 6
            inner = read()
            pos += 1
            return ("array", inner)
        m = re.compile(r"[A-Z_]+(\(\d+, ?\d+\))?").match(ddl, pos)
        if not m:
            raise ValueError(f"shape not understood at {pos}: {ddl[:200]}")
        pos = m.end()
        return m[0].split("(")[0]

    return read()


def shape_edges(shape: object) -> set[tuple[str, str, str]]:
    """Edges (path of an object, key, kind) of a shape; paths are keys joined with SEP, and pass through arrays."""
    out: set[tuple[str, str, str]] = set()
    todo: list[tuple[Path, object]] = [((), shape)]
    while todo:
        at, x = todo.pop()
        if not (isinstance(x, tuple) and x[0] == "object"):
            continue
        for k, v in x[1].items():
            kind = v[0] if isinstance(v, tuple) else v
            inner = v
            while isinstance(inner, tuple) and inner[0] == "array":
                inner = inner[1]
            if kind == "array":
                kind = "array:" + (inner[0] if isinstance(inner, tuple) else inner)
            out.add((SEP.join(at), k, kind))
            todo.append(((*at, k), inner))
    return out


def schema_graph(recs: DataFrame, rec: str = "rec", most: int = MAX_EDGES) -> list[tuple[str, str, str, int]]:
    """Distinct edges with the number of records that have them. Refused if there are more than ``most``, as when keys are data."""
    shape = F.regexp_replace(F.schema_of_variant(F.col(rec)), r"DECIMAL\(\d+,\s?\d+\)", "DECIMAL")
    shapes = recs.filter(F.col(rec).isNotNull()).select(shape.alias("shape")).groupBy("shape").agg(F.count("*").alias("n"))

    def edges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(*e, n) for s, n in zip(b["shape"], b["n"]) for e in shape_edges(parse_shape(s))]
            df = pd.DataFrame(rows, columns=["parent", "key", "kind", "n"])
            yield df.groupby(["parent", "key", "kind"], as_index=False)["n"].sum()

    g = shapes.mapInPandas(edges, "parent string, key string, kind string, n long").groupBy("parent", "key", "kind").agg(F.sum("n").alias("n"))
    rows = g.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} edges in the schema graph: keys seem to be data")
    return sorted(tuple(r) for r in rows)


@dataclass
class Element:
    """Objects (or array entries) that are one element: ``keys`` has the kinds of each key over all its paths."""

    paths: list[Path]
    keys: dict[str, set[str]]
    child: dict[str, int] = field(default_factory=dict)  #: key: element


def _is_object(kinds: set[str]) -> bool:
    return bool(kinds & {"object", "array:object"})


def _is_array(kinds: set[str]) -> bool:
    return any(k.startswith("array") for k in kinds)


def elements(edges: list[tuple[str, str, str, int]]) -> tuple[list[Element], int]:
    """The elements of a schema graph, the root's first, and how often the root's recurs on a path."""
    kinds: dict[tuple[Path, str], set[str]] = {}
    keys: dict[Path, dict[str, set[str]]] = {(): {}}
    for parent, key, kind, _ in edges:
        at = tuple(parent.split(SEP)) if parent else ()
        keys.setdefault(at, {}).setdefault(key, set()).add(kind)
        kinds.setdefault((at, key), set()).add(kind)
    paths = sorted(keys, key=lambda p: (len(p), p))
    up = {p: p for p in paths}

    def find(p: Path) -> Path:
        while up[p] != p:
            up[p] = up[up[p]]
            p = up[p]
        return p

    def merge(p: Path, q: Path) -> bool:
        p, q = sorted((find(p), find(q)), key=lambda x: (len(x), x))
        up[q] = p
        return p != q

    def close() -> None:  # the same key of one element is one element
        changed = True
        while changed:
            changed, seen = False, {}
            for p in paths:
                if p:
                    at = (find(p[:-1]), p[-1])
                    changed |= at in seen and merge(seen[at], p)
                    seen.setdefault(at, p)

    def like(p: Path, q: Path) -> bool:
        a, b = set(keys[p]), set(keys[q])
        return len(a & b) >= max(1, LIKE * min(len(a), len(b)))

    for p in paths:  # recursion: the nearest ancestor with such a shape
        for n in range(len(p) - 1, -1, -1):
            if len(set(keys[p]) & set(keys[p[:n]])) >= COMMON and like(p, p[:n]):
                merge(p, p[:n])
                break
    close()
    by_key: dict[str, list[Path]] = {}
    by_shape: dict[frozenset[str], list[Path]] = {}
    for p in paths[1:]:
        by_key.setdefault(p[-1], []).append(p)
        if len(keys[p]) >= COMMON:
            by_shape.setdefault(frozenset(keys[p]), []).append(p)
    for same in (*by_key.values(), *by_shape.values()):  # shared
        for p in same[1:]:
            if like(same[0], p):
                merge(same[0], p)
    close()
    roots = sorted({find(p) for p in paths}, key=lambda x: (len(x), x))
    at = {r: i for i, r in enumerate(roots)}
    out = [Element([], {}) for _ in roots]
    for p in paths:
        e = out[at[find(p)]]
        e.paths.append(p)
        for k, v in keys[p].items():
            e.keys.setdefault(k, set()).update(v)
            if (*p, k) in up:
                e.child[k] = at[find((*p, k))]
    depth = max(sum(find(p[:n]) == () for n in range(1, len(p) + 1)) for p in paths)
    return out, depth


@dataclass
class Relation:
    name: str
    element: int | None  #: None for arrays of scalars
    sites: list[tuple[str, tuple[tuple[str, bool], ...]]]  #: where its rows hang: relation, and the keys from there with whether each may be an array
    repeated: bool
    again: list[tuple[tuple[str, bool], ...]] = field(default_factory=list)  #: from a row to a row of the same relation
    columns: dict[str, tuple[Path, str]] = field(default_factory=dict)  #: column: (path, type)
    depth: int = 0  #: how often the element recurs


@dataclass
class Schema:
    relations: dict[str, Relation]

    @property
    def depth(self) -> int:
        return next(iter(self.relations.values())).depth


_TYPES = {"BIGINT": "bigint", "DOUBLE": "double", "DECIMAL": "double", "BOOLEAN": "boolean"}


def inline(edges: list[tuple[str, str, str, int]], root: str = "tweet", keep: tuple[str, ...] = ()) -> Schema:
    """Shared inlining of a schema graph; elements reached by a key in ``keep`` get a table although they are singletons."""
    els, root_depth = elements(edges)
    into: dict[int, set[tuple[int, str]]] = {}
    for i, e in enumerate(els):
        for k, c in e.child.items():
            into.setdefault(c, set()).add((i, k))

    tables = {i for i in range(len(els)) if i == 0 or len(into.get(i, ())) > 1 or any(k in keep or _is_array(els[p].keys[k]) for p, k in into.get(i, ()))}

    def below(i: int, seen: set[int]) -> set[int]:
        for c in els[i].child.values():
            if c not in seen and c not in tables:
                seen.add(c)
                below(c, seen)
        return seen

    tables |= {i for i in range(len(els)) if i in below(i, set())}  # cycles without a table

    def name_of(path: Path) -> str:
        return "_".join(path) or root

    schema = Schema({root: Relation(root, 0, [], False, depth=root_depth)})
    names = {0: root}

    def visit(i: int, rel: Relation, keys: tuple[tuple[str, bool], ...]) -> None:
        e = els[i]
        for k in sorted(e.keys):
            kinds, step = e.keys[k], (*keys, (k, _is_array(e.keys[k])))
            scalar = sorted({x.removeprefix("array:") for x in kinds} - {"object", "array", "VOID"})
            kind = _TYPES.get(scalar[0], "string") if len(scalar) == 1 else "string"
            c = e.child.get(k)
            if c is not None and _is_object(kinds):
                if c not in tables:
                    visit(c, rel, step)
                elif c == rel.element:
                    rel.again.append(step)
                elif c in names:
                    schema.relations[names[c]].sites.append((rel.name, step))
                else:
                    name = name_of(els[c].paths[0])
                    new = schema.relations[name] = Relation(name, c, [(rel.name, step)], _is_array(kinds))
                    new.depth = max(sum(p[:n] in els[c].paths for n in range(1, len(p) + 1)) for p in els[c].paths) - 1
                    names[c] = name
                    if scalar:
                        new.columns["value"] = ((), kind)
                    visit(c, new, ())
            elif _is_array(kinds):
                name = name_of((*e.paths[0], k))
                schema.relations[name] = Relation(name, None, [(rel.name, step)], True, columns={"value": ((), kind)})
            else:
                col = "_".join(x for x, _ in step)
                while col in rel.columns:  # a_b beside a.b
                    col += "_"
                rel.columns[col] = (tuple(x for x, _ in step), kind)

    visit(0, schema.relations[root], ())
    for r in schema.relations.values():
        for parent, _ in r.sites:
            up, seen = parent, set()
            while up not in seen:
                seen.add(up)
                if up == r.name:
                    raise ValueError(f"recursion of {r.name} through the table {parent}: leave {parent} out of keep, or relationalize it by itself")
                up = schema.relations[up].sites[0][0] if schema.relations[up].sites else up
    return schema


def _path(keys: Path) -> str:
    return "$" + "".join("['" + k.replace("'", "\\'") + "']" if re.search(r"\W", k) else f".{k}" for k in keys)


def entries(v: Column, keys: Path) -> Column:
    """Array of the values at a path: an array's elements, a lone value as one, nothing where null or absent."""
    many = F.try_variant_get(v, _path(keys), "array<variant>")
    lone = F.try_variant_get(v, _path(keys), "variant")
    return F.when(many.isNotNull(), many).when(lone.isNull() | F.is_variant_null(lone), F.expr("array()").cast("array<variant>")).otherwise(F.array(lone))


def walk(v: Column, steps: tuple[tuple[str, bool], ...]) -> Column:
    """Array of the values at the end of a path, through arrays on the way."""
    keys: list[str] = []
    for i, (k, many) in enumerate(steps):
        keys.append(k)
        if many and i < len(steps) - 1:
            rest = steps[i + 1 :]
            return F.flatten(F.transform(entries(v, tuple(keys)), lambda x: walk(x, rest)))  # noqa: B023
    return entries(v, tuple(keys))


def _is_obj(x: Column) -> Column:
    return x.isNotNull() & F.startswith(F.schema_of_variant(x), F.lit("OBJECT"))


def _levels(first: Column, rel: Relation, by_level: bool = True) -> Column:
    """``first`` (array of structs nest_level, id, up, node) and all that recurs below, as one array, so the source is read once whatever the depth.

    With one recursive key that is never an array the id is the level, else the keys and positions on the way.
    """
    simple = by_level and len(rel.again) == 1 and not any(m for _, m in rel.again[0])
    out, last = [first], first

    def step(s: Column, k: int, steps: tuple[tuple[str, bool], ...]) -> Column:
        tail = "." + ".".join(x for x, _ in steps) + "."
        id_ = (lambda i: F.lit(str(k))) if simple else (lambda i: F.concat(s["id"], F.lit(tail), i.cast("string")))
        return F.transform(walk(s["node"], steps), lambda x, i: F.struct(F.lit(k).alias("nest_level"), id_(i).alias("id"), s["id"].alias("up"), x.alias("node")))

    def grow(k: int) -> Callable[[Column], Column]:
        def one(s: Column) -> Column:
            parts = [step(s, k, steps) for steps in rel.again]
            return F.filter(parts[0] if len(parts) == 1 else F.concat(*parts), lambda x: _is_obj(x["node"]))

        return one

    for k in range(1, rel.depth + 1):
        last = F.flatten(F.transform(last, grow(k)))
        out.append(last)
    return out[0] if len(out) == 1 else F.concat(*out)


def element_rows(recs: DataFrame, schema: Schema, key: str, rec: str = "rec", carry: tuple[str, ...] = ()) -> DataFrame:
    """Rows of the root element: key, carry..., nest_level (0 for the record itself), id, up (the id of the parent) and ``node``."""
    r = next(iter(schema.relations.values()))
    first = F.array(F.struct(F.lit(0).alias("nest_level"), F.lit("0").alias("id"), F.lit(None).cast("string").alias("up"), F.col(rec).alias("node")))
    nodes = F.filter(_levels(first, r), lambda s: _is_obj(s["node"]))
    return recs.filter(F.col(rec).isNotNull()).select(key, *carry, F.inline(nodes))


_OWN = ("nest_level", "row_key", "parent_key", "parent_table", "parent_path", "ord_no")


def field_columns(rel: Relation, node: str, key: str) -> list[Column]:
    """Columns of a relation's fields; a field named like a key column gets a trailing underscore."""
    taken = {key, *_OWN}
    return [F.try_variant_get(node, _path(p), t).alias(c + "_" if c in taken else c) for c, (p, t) in rel.columns.items()]


def row_key(key: str, id_: Column) -> Column:
    return F.concat_ws(":", F.col(key).cast("string"), id_)


def root_table(nodes: DataFrame, schema: Schema, root: str, key: str) -> DataFrame:
    """One row per occurrence of the root element; parent_key is NULL for the records themselves."""
    cols = field_columns(schema.relations[root], "node", key)
    parent = F.when(F.col("up").isNotNull(), row_key(key, F.col("up")))
    return nodes.select(key, "nest_level", row_key(key, F.col("id")).alias("row_key"), parent.alias("parent_key"), *cols)


def _child_rows(nodes: DataFrame, schema: Schema, name: str, key: str) -> DataFrame:
    """key, nest_level, row_key, parent_key, parent_table, parent_path, ord_no and ``__x`` of the entries of a table below the root."""
    rel = schema.relations[name]
    parts = []
    for i, (parent, steps) in enumerate(rel.sites):
        if schema.relations[parent].sites:
            up = _child_rows(nodes, schema, parent, key).select(key, "nest_level", F.col("row_key").alias("parent_key"), F.col("__x").alias("__v"))
        else:
            up = nodes.select(key, "nest_level", row_key(key, F.col("id")).alias("parent_key"), F.col("node").alias("__v"))
        path = ".".join(k for k, _ in steps)
        d = up.select(key, "nest_level", "parent_key", F.posexplode(walk(F.col("__v"), steps)).alias("ord_no", "__x"))
        mine = F.col("ord_no").cast("string") if len(rel.sites) == 1 else F.concat(F.lit(f"{i}."), F.col("ord_no").cast("string"))
        d = d.withColumn("row_key", F.concat_ws(":", "parent_key", mine)).withColumns({"parent_table": F.lit(parent), "parent_path": F.lit(path)})
        if rel.again:
            first = F.array(F.struct(F.lit(0).alias("nest_level"), F.col("row_key").alias("id"), F.lit(None).cast("string").alias("up"), F.col("__x").alias("node")))
            d = d.withColumn("__l", F.explode(_levels(first, rel, False)))
            below = F.col("__l.up").isNotNull()
            d = d.select(key, "nest_level", F.coalesce("__l.up", "parent_key").alias("parent_key"), F.when(~below, F.col("ord_no")).alias("ord_no"), F.col("__l.node").alias("__x"), F.col("__l.id").alias("row_key"), F.when(below, F.lit(rel.name)).otherwise(F.col("parent_table")).alias("parent_table"), F.when(below, F.lit(None).cast("string")).otherwise(F.col("parent_path")).alias("parent_path"))
        parts.append(d.select(key, "nest_level", "row_key", "parent_key", "parent_table", "parent_path", "ord_no", "__x"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def child_table(nodes: DataFrame, schema: Schema, name: str, key: str) -> DataFrame:
    """One row per entry of a repeated, shared or recursive element below the root, with the key of the row it belongs to.

    ord_no is the position from 0 within the parent. A shared or recursive element's rows also have their own key and say which table
    and path their parent_key is of.
    """
    rel = schema.relations[name]
    more = ["row_key", "parent_table", "parent_path"] if len(rel.sites) > 1 or rel.again else []
    return _child_rows(nodes, schema, name, key).select(key, "nest_level", "parent_key", *more, "ord_no", *field_columns(rel, "__x", key))


def relationalize(lines: DataFrame, key: str = "line_no", rec: str = "rec", root: str = "tweet", keep: tuple[str, ...] = ()) -> tuple[Schema, dict[str, DataFrame]]:
    """All tables of parsed records: the root's under ``root``, the others by the first path of their element joined with ``_``."""
    schema = inline(schema_graph(lines, rec), root, keep)
    nodes = once(element_rows(lines, schema, key, rec), F.col("node"), "__n").drop("node").withColumnRenamed("__n", "node")
    out = {root: root_table(nodes, schema, root, key)}
    for name in schema.relations:
        if name != root:
            out[name] = child_table(nodes, schema, name, key)
    return schema, out
