"""Deeply nested records into related flat tables, by shared inlining.

The records arrive as JSON text. A first pass gathers the *schema graph*: one node for each element (key), one edge
for each (parent, child) seen, with the kinds the child took. The plan made from it follows shared inlining:

* an element that occurs once below its parent is inlined into the parent's table (``intent`` gives ``intent.raw_prompt``);
* an element gets a table of its own if it repeats (a list somewhere, or named in ``lists``), if it is an object
  below several parents (shared), or if it lies on a cycle of the graph (recursive);
* each row of such a table holds its parent's table, row and position as a foreign key, and what doesn't depend on the plan:
  ``owner_element`` and ``owner_pos``, the nearest element around it, inlined ones (position -1) included, ``depth``, how
  many there are, and its ``path`` from the record where that is asked for. Elements named ``transparent`` don't count.

A second pass emits the rows of all tables at once; both passes are narrow, only the graph's edges are shuffled and
collected. Their number is bounded by the number of distinct keys and is checked against ``max_edges``.

Defined cases
* Payload null, blank, cut off, not JSON, or without a record: no rows. A leading byte order mark is skipped; JSON text
  inside a string is read where the element is an object elsewhere or never plain text.
* A record is the shallowest object that has one of ``root_keys``; envelopes and one-entry lists around it are skipped.
* A null entry keeps its position and gives no row; a lone value in place of a list has position 0; an object whose keys
  are all digits labels its entries with their positions; labels beyond a bigint take the last places there are, in their
  order; an empty list or object gives none.
* Key styles (camelCase, kebab-case, spaces) are unified. On a repeated key the last value counts, as in JSON readers.
* Unpaired surrogates come out as ``?``. Nesting may have any depth, numbers any length.
* Identical payloads under different ids give rows under each id; extra columns of the input are ignored.
* An empty input gives empty tables with the declared ``lists`` present.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumora.session import ensure_checkpoint_dir

ROOT = "record"
NODE_SCHEMA = (
    "doc_id {id}, element string, row_id int, parent_element string, parent_row_id int, parent_pos bigint, pos bigint, value string, "
    "attributes map<string,string>, owner_element string, owner_pos bigint, depth int, path string"
)
LAST_PLACE = (1 << 63) - 1
_CAMEL = re.compile(r"(?<=[a-z0-9])([A-Z])")
_SEPARATORS = re.compile(r"[\s\-]+")
_TOKEN = re.compile(r'[ \t\n\r]*([\[\]{},:]|"(?:[^"\\\x00-\x1f]|\\.)*"|-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null|NaN|-?Infinity)')


def element_name(key: str) -> str:
    """One spelling for a key: ``filesRead``, ``files-read`` and ``files_read`` are the same element."""
    return _SEPARATORS.sub("_", _CAMEL.sub(r"_\1", key.strip())).lower()


def _deep(text: str):
    """JSON nested deeper than the interpreter's stack allows, read with a stack of its own."""
    root: list = []
    open_, keys, at, state = [root], [""], 0, "value"
    while (m := _TOKEN.match(text, at)) is not None:
        t, at, top = m.group(1), m.end(), open_[-1]
        closing = (t == "]" and state in ("first", "after") and isinstance(top, list)) or (t == "}" and state in ("first key", "after") and isinstance(top, dict))
        if closing and len(open_) > 1:
            open_.pop()
            keys.pop()
            state = "after"
        elif state in ("value", "first") and t not in "]},:":
            value = [] if t == "[" else {} if t == "{" else _loads(t)
            if isinstance(top, list):
                top.append(value)
            else:
                top[keys[-1]] = value
            if t in "[{":
                open_.append(value)
                keys.append("")
            state = "first" if t == "[" else "first key" if t == "{" else "after"
        elif state in ("key", "first key") and t[0] == '"':
            keys[-1], state = _loads(t), "colon"
        elif state == "colon" and t == ":":
            state = "value"
        elif state == "after" and t == "," and len(open_) > 1:
            state = "key" if isinstance(top, dict) else "value"
        else:
            raise ValueError("not JSON")
    if state != "after" or len(open_) > 1 or text[at:].strip(" \t\n\r"):
        raise ValueError("not JSON")
    return root[0]


def _loads(text: str):
    try:
        return json.loads(text)
    except RecursionError:
        return _deep(text)
    except json.JSONDecodeError:
        raise
    except ValueError:  # a number of more digits than the interpreter turns into one
        return json.loads(text, parse_int=str)


def _dumps(x) -> str:
    try:
        return json.dumps(x, ensure_ascii=False)
    except RecursionError:
        out, todo = [], [(x, False)]
        while todo:
            x, done = todo.pop()
            if done or not isinstance(x, (dict, list)):
                out.append(x if done else json.dumps(x, ensure_ascii=False))
                continue
            ends = "{}" if isinstance(x, dict) else "[]"
            parts: list[tuple] = [(ends[0], True)]
            for i, e in enumerate(x):
                comma = ", " if i else ""
                parts += [(f"{comma}{json.dumps(e, ensure_ascii=False)}: ", True), (x[e], False)] if isinstance(x, dict) else [(comma, True), (e, False)]
            todo += reversed([*parts, (ends[1], True)])
        return "".join(out)


def _read(text: str | None):
    try:
        value = _loads(text.lstrip("﻿"))
        return _loads(value) if isinstance(value, str) else value
    except (ValueError, AttributeError):
        return None


def _unwrapped(x):
    """JSON text replaced by what it holds."""
    return inner if isinstance(x, str) and (inner := _inner(x)) is not None else x


def _inner(text: str):
    """The object or list that a string holds as JSON text, else None."""
    if text[:1].lstrip() in ("{", "[", "") and (t := text.strip())[:1] in ("{", "["):
        return _read(t)
    return None


def find_record(value, root_keys: frozenset[str]) -> dict | None:
    level = [value]
    while level:
        deeper = []
        for x in level:
            if isinstance(x, str):
                x = _inner(x)
            if isinstance(x, dict):
                if any(element_name(k) in root_keys for k in x):
                    return x
                deeper += x.values()
            elif isinstance(x, list):
                deeper += x
        level = deeper
    return None


def _labelled(x: dict) -> bool:
    return all(k.isascii() and k.isdigit() for k in x)


def _kind(x) -> str:
    if x is None:
        return "null"
    if isinstance(x, dict):
        return "list" if x and _labelled(x) else "object"
    if isinstance(x, list):
        return "list"
    return "json_text" if isinstance(x, str) and _inner(x) is not None else "scalar"


def _entries(x) -> Iterator[tuple[int, object]]:
    if isinstance(x, list):
        yield from enumerate(x)
    elif isinstance(x, dict) and _labelled(x):
        # the order of numbers of any length: by their digits without leading zeros
        places = sorted(((k.lstrip("0") or "0", v) for k, v in x.items()), key=lambda e: (len(e[0]), e[0]))
        for i, (digits, v) in enumerate(places):
            fits = len(digits) < 19 or (len(digits) == 19 and int(digits) <= LAST_PLACE)
            yield (int(digits) if fits else LAST_PLACE - (len(places) - 1 - i)), v
    else:
        yield 0, x


@dataclass(frozen=True)
class InliningPlan:
    """Which elements become tables and which are inlined, with the inlined columns of each table."""

    tables: frozenset[str]
    complex: frozenset[str]
    columns: dict[str, tuple[str, ...]] = field(default_factory=dict)


def schema_edges(df: DataFrame, id_col: str, text_col: str, root_keys: Iterable[str]) -> DataFrame:
    """(parent, child, kind, n) over all payloads; counted per task before the shuffle."""
    roots = frozenset(root_keys)

    def walk(x, parent: str, seen: dict) -> None:
        stack = [(x, parent)]
        while stack:
            x, parent = stack.pop()
            if isinstance(x, dict):
                for k, v in x.items():
                    name, kind = element_name(k), _kind(v)
                    seen[parent, name, kind] = seen.get((parent, name, kind), 0) + 1
                    if kind == "json_text":
                        v = _inner(v)
                    if isinstance(v, dict) and not (v and _labelled(v)):
                        stack.append((v, name))
                    elif isinstance(v, (list, dict)):
                        for _, e in _entries(v):
                            entry = _inner(e) if isinstance(e, str) else e
                            if isinstance(entry, dict):
                                seen[parent, name, "object"] = seen.get((parent, name, "object"), 0) + 1
                                stack.append((entry, name))

    def edges(batches):
        seen: dict[tuple[str, str, str], int] = {}
        for b in batches:
            for text in b.column(0).to_pylist():
                if (record := find_record(_read(text), roots)) is not None:
                    walk(record, ROOT, seen)
        safe = [(*(p.encode("utf-8", "replace").decode() for p in k), n) for k, n in seen.items()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in safe], pa.string() if i < 3 else pa.int64()) for i in range(4)], ["parent", "child", "kind", "n"]
        )

    found = df.select(F.col(text_col)).mapInArrow(edges, "parent string, child string, kind string, n bigint")
    return found.groupBy("parent", "child", "kind").agg(F.sum("n").alias("n"))


def plan_inlining(edges: DataFrame, lists: Iterable[str] = (), max_edges: int = 100_000) -> InliningPlan:
    """Decide tables and inlined columns from the schema graph."""
    rows = edges.limit(max_edges + 1).collect()
    if len(rows) > max_edges:
        raise ValueError(f"the schema graph has over {max_edges} edges; keys seem to be data")
    lists, kinds, parents, children = set(lists), {}, {}, {}
    for r in rows:
        kinds.setdefault(r.child, {})[r.kind] = kinds.get(r.child, {}).get(r.kind, 0) + r.n
        parents.setdefault(r.child, set()).add(r.parent)
        children.setdefault(r.parent, set()).add(r.child)
    objects = {c for c, k in kinds.items() if "object" in k or ("json_text" in k and "scalar" not in k)}
    repeated = {c for c, k in kinds.items() if "list" in k} | lists
    shared = {c for c in objects if len(parents[c]) > 1}

    def reaches_itself(start: str) -> bool:
        todo, seen = [start], set()
        while todo:
            for c in children.get(todo.pop(), ()):
                if c == start:
                    return True
                if c in objects and c not in seen:
                    seen.add(c)
                    todo.append(c)
        return False

    own = repeated | shared | {c for c in objects if reaches_itself(c)}
    columns: dict[str, tuple[str, ...]] = {}
    for t in {ROOT, *own}:
        names, todo = [], [("", t)]
        while todo:
            prefix, at = todo.pop()
            for c in sorted(children.get(at, ())):
                if c in own:
                    continue
                if c in objects:
                    todo.append((f"{prefix}{c}.", c))
                else:
                    names.append(f"{prefix}{c}")
        columns[t] = tuple(sorted(names))
    return InliningPlan(frozenset(own), frozenset(objects | repeated), columns)


def shred(
    df: DataFrame, id_col: str, text_col: str, plan: InliningPlan, root_keys: Iterable[str],
    keep: Iterable[str] | None = None, transparent: Iterable[str] = (), paths: Iterable[str] = (),
) -> DataFrame:
    """The rows of all tables, or of the tables in ``keep``, with foreign keys, in one narrow pass."""
    roots, tables, complex_ = frozenset(root_keys), plan.tables, plan.complex
    kept, clear = None if keep is None else frozenset(keep), frozenset(transparent)
    # a row's path is followed as long as it begins a wanted one
    begun = frozenset(".".join(p.split(".")[: i + 1]) for p in paths for i in range(p.count(".") + 1))

    def text_of(x) -> str | None:
        if x is None:
            return None
        s = x if isinstance(x, str) else _dumps(x)
        return s.encode("utf-8", "replace").decode()

    def step(path: str | None, name: str) -> str | None:
        if path is None:
            return None
        p = f"{path}.{name}" if path else name
        return p if p in begun else None

    def rows_of(record: dict) -> list[tuple]:
        out: list[tuple] = []
        n = 0
        todo: list[tuple] = [(record, ROOT, None, None, -1, 0, None, -1, 0, "")]
        while todo:
            x, element, parent_element, parent_row, parent_pos, pos, owner, owner_pos, depth, path = todo.pop()
            wanted, number = kept is None or element in kept, n
            n += 1
            attributes: list[tuple] = []
            if element in complex_:
                x = _unwrapped(x)
            value = text_of(x) if wanted and not isinstance(x, dict) else None
            if wanted:
                out.append((element, number, parent_element, parent_row, parent_pos, pos, value, attributes, owner, owner_pos, depth, path))
            if not isinstance(x, dict):
                continue
            if parent_element is not None and element not in clear:
                owner, owner_pos, depth = text_of(element), pos, depth + 1
            below: list[tuple] = []
            inline = [("", x, owner, owner_pos, depth, path)]
            while inline:
                prefix, obj, owner, owner_pos, depth, path = inline.pop()
                for k, v in obj.items():
                    name = element_name(k)
                    if name in complex_:
                        v = _unwrapped(v)
                    if v is None:
                        continue
                    if name in tables:
                        at = step(path, name)
                        below += [(e, name, element, number, pos, p, owner, owner_pos, depth, at) for p, e in _entries(v) if e is not None]
                    elif isinstance(v, dict):
                        around = (owner, owner_pos, depth) if name in clear else (text_of(name), -1, depth + 1)
                        inline.append((f"{prefix}{name}.", v, *around, step(path, name)))
                    elif wanted:
                        attributes.append((f"{prefix}{name}".encode("utf-8", "replace").decode(), text_of(v)))
            todo += reversed(below)
        return out

    def emit(batches):
        names = ["doc_id", "element", "row_id", "parent_element", "parent_row_id", "parent_pos", "pos", "value", "attributes", "owner_element", "owner_pos", "depth", "path"]
        long, text = pa.int64(), pa.string()
        types = [text, pa.int32(), text, pa.int32(), long, long, text, pa.map_(text, text), text, long, pa.int32(), text]
        for b in batches:
            picks, rows = [], []
            for i, payload in enumerate(b.column(1).to_pylist()):
                if (record := find_record(_read(payload), roots)) is not None:
                    got = rows_of(record)
                    rows += got
                    picks += [i] * len(got)
            ids = b.column(0).take(pa.array(picks, pa.int64()))
            # on a repeated key the last value counts
            cols = [pa.array([list(dict(r[i]).items()) if i == 7 else r[i] for r in rows], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([ids, *cols], names)

    kind = df.select(id_col).dtypes[0][1]
    return df.select(F.col(id_col), F.col(text_col)).mapInArrow(emit, NODE_SCHEMA.format(id=kind))


@dataclass(frozen=True)
class Inlined:
    """The outcome: ``rows`` of all tables and ``table(name)`` with real columns."""

    rows: DataFrame
    plan: InliningPlan

    def written(self) -> Inlined:
        """The same with its rows written once into the shared folder, apart by element, so that a table reads its own rows only."""
        folder = f"{ensure_checkpoint_dir(self.rows.sparkSession)}/inlined-{uuid.uuid4().hex}"
        self.rows.write.partitionBy("element").parquet(folder)
        return Inlined(self.rows.sparkSession.read.schema(self.rows.schema).parquet(folder), self.plan)

    def table(self, element: str) -> DataFrame:
        keys = [F.col(c) for c in ("doc_id", "row_id", "parent_element", "parent_row_id", "parent_pos", "pos", "value")]
        columns = [F.col("attributes")[c].alias(c) for c in self.plan.columns.get(element, ())]
        return self.rows.filter(F.col("element") == element).select(*keys, *columns)


def inline(
    df: DataFrame, id_col: str, text_col: str, root_keys: Iterable[str], lists: Iterable[str] = (),
    keep: Iterable[str] | None = None, transparent: Iterable[str] = (), paths: Iterable[str] = (),
) -> Inlined:
    """Shared inlining of the JSON records in ``text_col``; ``lists`` names elements declared to repeat, ``keep`` the tables wanted."""
    root_keys = tuple(root_keys)
    plan = plan_inlining(schema_edges(df, id_col, text_col, root_keys), lists)
    return Inlined(shred(df, id_col, text_col, plan, root_keys, keep, transparent, paths), plan)
