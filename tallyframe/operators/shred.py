"""Deeply nested records into related flat tables.

Each record is shredded into columns, one per leaf path, with a repetition level (which repeated
ancestor starts anew) and a definition level (how deep the path is present) per entry. Tables are
rebuilt per repeated ancestor from the level sequences alone, with the place of every row in each
of its ancestors.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

_WRAPPERS = ("record", "results", "result", "item", "items", "data")  # fixed values: envelopes around one record


@dataclass(frozen=True)
class Group:
    """A repeated group: its dotted lower-case path; ``depth`` repeated levels lead to it."""

    path: str

    @property
    def steps(self) -> tuple[str, ...]:
        return tuple(self.path.split("."))

    @property
    def depth(self) -> int:
        return len(self.steps)


def _no_twice(pairs):
    out = {}
    for k, v in pairs:
        out[k] = v
    return out


def parse_record(text: str | None, wanted: frozenset[str] = frozenset()):
    """The record as a dict, out of any envelope; None if the text isn't JSON or holds no object.

    An envelope is an object of any size that holds one nested member, named like an envelope, and
    only scalars beside it; it is opened however many lie around each other, unless the object has a
    member in ``wanted`` (lower case) itself. NaN constants are accepted as nulls. A list of one object
    is that object. Text nested too deep counts as unparsable.
    """
    if text is None:
        return None
    try:
        rec = json.loads(text, parse_constant=lambda _: None, object_pairs_hook=_no_twice)
    except (ValueError, RecursionError):
        return None
    while True:  # every round takes off one level of nesting or one layer of quoting
        if isinstance(rec, list) and len(rec) == 1:
            rec = rec[0]
        elif isinstance(rec, str):
            try:
                rec = json.loads(rec)
            except (ValueError, RecursionError):
                return None
        elif isinstance(rec, dict):
            inside = _enveloped(rec, wanted)
            if inside is None:
                return rec
            rec = inside
        else:
            return None


def _enveloped(rec: dict, wanted: frozenset[str]):
    """What an envelope holds (an object or a list of one element), or None if this is no envelope."""
    nested = [k for k, v in rec.items() if isinstance(v, (dict, list))]
    if len(nested) != 1 or nested[0].strip().lower() not in _WRAPPERS or any(k.strip().lower() in wanted for k in rec):
        return None
    value = rec[nested[0]]
    return value if isinstance(value, dict) or len(value) == 1 else None


def elements(value) -> list:
    """The array a value stands for: a list, the JSON text of one, an object keyed '0', '1', ...
    (by number, gaps are not filled) or a lone object. Anything else: no array."""
    if isinstance(value, str):
        s = value.strip()
        if s[:1] not in ("[", "{"):
            return []
        try:
            value = json.loads(s)
        except (ValueError, RecursionError):
            return []
        if isinstance(value, str):
            return elements(value)
    if isinstance(value, list):
        return value
    if isinstance(value, dict):
        if value and all(k.strip().isdigit() for k in value):
            return [value[k] for k in sorted(value, key=lambda k: int(k))]
        return [value] if value else []
    return []


def _key(obj: dict, name: str):
    """Member of an object by name whatever its case; the exact spelling wins, then the first non-null."""
    if name in obj:
        return obj[name]
    hit = None
    for k, v in obj.items():
        if k.strip().lower() == name:
            if v is not None:
                return v
            hit = v
    return hit


def _as_object(value):
    if isinstance(value, str) and value.strip()[:1] == "{":
        try:
            value = json.loads(value)
        except (ValueError, RecursionError):
            return None
    return value if isinstance(value, dict) else None


class Columns:
    """Level sequences of one repeated group over any number of records.

    ``repetition`` and ``definition`` hold one entry per element of the group, or per record or parent
    without one. Every leaf shares them: a leaf is kept as the entries where it has a value, and
    :meth:`leaf` gives its own three sequences. The definition level of an entry counts the repeated
    levels that are present on its path, one more if the element is an object with keys, and for a leaf
    one more if it has a value.
    """

    def __init__(self, path: str, inner: set[str]):
        self.steps = Group(path).steps
        self.inner = inner
        self.repetition: list[int] = []
        self.definition: list[int] = []
        self.leaves: dict[str, tuple[list[int], list[str]]] = {}

    def add(self, record: dict, leaves: bool) -> None:
        self._walk(record, 0, 0, leaves)

    def _entry(self, repetition: int, definition: int) -> None:
        self.repetition.append(repetition)
        self.definition.append(definition)

    def _walk(self, obj: dict, level: int, rep: int, leaves: bool) -> None:
        items = elements(_key(obj, self.steps[level]))
        if not items:
            self._entry(rep, level)
        for i, raw in enumerate(items):
            r = level + 1 if i else rep
            item = _as_object(raw)
            if level + 1 == len(self.steps):
                if leaves and item:
                    self._values(item)
                self._entry(r, level + 2 if item else level + 1)
            elif item is None:
                self._entry(r, level + 1)
            else:
                self._walk(item, level + 1, r, leaves)

    def _values(self, item: dict) -> None:
        at = len(self.repetition)
        for k, v in item.items():
            name = k.strip().lower()
            if name in self.inner or v is None:
                continue
            entries, texts = self.leaves.setdefault(name, ([], []))
            if not entries or entries[-1] != at:  # the first of two spellings of a key counts
                entries.append(at)
                texts.append(v if isinstance(v, str) else json.dumps(v, ensure_ascii=False))

    def leaf(self, name: str) -> list[tuple[int, int, str | None]]:
        """(repetition, definition, value) of a leaf, one per entry."""
        top = len(self.steps) + 2
        found = dict(zip(*self.leaves.get(name, ([], []))))
        return [(r, top if i in found else d, found.get(i)) for i, (r, d) in enumerate(zip(self.repetition, self.definition))]


def shred(records: Iterable[dict], groups: list[str], leaves: bool = True) -> dict[str, Columns]:
    """group path -> its columns over all ``records``. A leaf is a scalar member of the group's objects
    (lower-case name); nested members that are no group of ``groups`` stay JSON text."""
    out = {p: Columns(p, {g.split(".")[Group(p).depth] for g in groups if g.startswith(p + ".")}) for p in groups}
    for record in records:
        for columns in out.values():
            columns.add(record, leaves)
    return out


def rebuild(columns: Columns) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(entries, record numbers, places) of every object with keys, from the level sequences alone.

    A repetition level r tells that the element at level r is the next of its array; every level below
    starts again at 0, and 0 begins the next record. Places are one column per level from the outermost
    array inwards and count all elements, also empty ones.
    """
    depth = len(columns.steps)
    rep = np.array(columns.repetition, np.int32)
    record = np.cumsum(rep == 0) - 1
    places = np.zeros((len(rep), depth), np.int64)
    entry = np.arange(len(rep))
    for level in range(1, depth + 1):
        steps = np.cumsum(rep == level)
        began = np.maximum.accumulate(np.where(rep < level, entry, 0)) if len(rep) else entry
        places[:, level - 1] = steps - steps[began]
    full = np.nonzero(np.array(columns.definition, np.int32) > depth)[0]
    return full, record[full], places[full]


def _dotted(places: np.ndarray) -> pa.Array:
    columns = [pa.array(places[:, i]).cast(pa.string()) for i in range(places.shape[1])]
    return pc.binary_join_element_wise(*columns, ".") if columns else pa.array([""] * len(places), pa.string())


def _fields(columns: Columns, entries: np.ndarray) -> pa.Array:
    """Map of leaf name to text per entry, from the leaf columns."""
    per: dict[int, list[tuple[str, str]]] = {int(e): [] for e in entries}
    for name, (at, texts) in columns.leaves.items():
        for e, text in zip(at, texts):
            per[e].append((name, text))
    return pa.array(list(per.values()), pa.map_(pa.string(), pa.string()))


def shred_tables(df: DataFrame, key: str, column: str, groups: list[str], fields: bool = True) -> DataFrame:
    """All flat tables in one long frame: ``key``, array_path, pos_path, parent_path and, unless left out
    by ``fields``, the map fields.

    ``pos_path`` joins the places by dots (from 0); ``parent_path`` is the parent row's pos_path
    ('' for the record itself); ``fields`` maps lower-case names to the values that aren't null. Nulls,
    texts that don't parse and records without such arrays give no rows; a repeated key gives its rows
    again. Records go through Arrow batches, each shredded into one set of columns; without ``fields``
    no leaf is built; nothing is shuffled.
    """
    kind = df.schema[key].dataType.simpleString()
    base = df.selectExpr(f"`{key}` AS __key", f"`{column}` AS __text").where("__text IS NOT NULL")
    wanted = frozenset(g.split(".")[0] for g in groups)

    def run(batches):
        for batch in batches:
            keys = batch.column(0)
            parsed = [(i, r) for i, t in enumerate(batch.column(1).to_pylist()) if (r := parse_record(t, wanted)) is not None]
            rows = np.array([i for i, _ in parsed], np.int64)
            for path, columns in shred([r for _, r in parsed], groups, fields).items():
                entries, record, places = rebuild(columns)
                got = [keys.take(pa.array(rows[record])), pa.array([path] * len(entries), pa.string()), _dotted(places), _dotted(places[:, :-1])]
                names = ["k", "array_path", "pos_path", "parent_path"]
                if fields:
                    got.append(_fields(columns, entries))
                    names.append("fields")
                yield pa.RecordBatch.from_arrays(got, names=names)

    kinds = f"k {kind}, array_path string, pos_path string, parent_path string" + (", fields map<string,string>" if fields else "")
    return base.mapInArrow(run, kinds).withColumnRenamed("k", key)


COMPLAINT_GROUPS = ["products", "products.components", "products.components.events", "attachments"]
RECALL_GROUPS = ["products", "products.plants", "remedies", "remedies.parts"]
