"""Drafts as nested documents: JSON payloads taken apart into tables, and put together again.

A payload has ``meta`` (match fields), ``rows`` (the scoreboard), ``bans``, ``files``, ``conflicts``, ``superseded`` and
``editing_match_id``.  Each match or row field is a cell of value, source, origin and confidence.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import materialize, partitions_for

# The documents' fields and types.
META = {"played_at": "string", "map_id": "bigint", "mode": "string", "result": "string", "team_size": "bigint", "duration_seconds": "bigint", "rank_range_low": "bigint", "rank_range_high": "bigint", "notes": "string"}
CELLS = {"player_name": "string", "role": "string", "hero_id": "bigint", "eliminations": "bigint", "assists": "bigint", "deaths": "bigint", "damage": "bigint", "healing": "bigint", "mitigation": "bigint"}
PARTS = ["value", "source", "origin", "confidence"]  # of a cell
PASSED = {"player_id": "bigint", "nameplate_phash": "string", "nameplate_width": "bigint", "nameplate_crop": "string", "nameplate_crop_url": "string", "nameplate_confidence": "double", "portrait_phash": "string", "portrait_crop": "string", "portrait_crop_url": "string"}
LISTS = {
    "bans": {"hero_id": "bigint", "slot_index": "bigint"},
    "files": {"path": "string", "sha256": "string", "kind": "string", "ingested_at": "string"},
    "conflicts": {"path": "string", "mine": "string", "theirs": "string", "theirs_origin": "string", "theirs_confidence": "double"},
    "superseded": {"path": "string", "value": "string"},
}


def cell_type(value: str, text: Sequence[str] = ("source", "origin")) -> str:
    return struct_of({"value": value} | {k: "string" for k in ("source", "origin") if k in text} | {"confidence": "double"})


def struct_of(names: dict[str, str]) -> str:
    return "struct<" + ", ".join(f"{k}: {v}" for k, v in names.items()) + ">"


def payload_type(typed: bool = False, parts: Sequence[str] = PARTS, passed: Sequence[str] = tuple(PASSED)) -> str:
    """The payload's type as it is read: cells' values are text, as anything may stand there; if ``typed``, of the fields' types.

    Text that is not in ``parts`` or ``passed`` is passed over: any value is text, so it can't make a payload unfit.  What may is always read.
    """
    cells = lambda names: {k: cell_type(kind if typed else "string", parts) for k, kind in names.items()}
    row = {"team": "string", "row_index": "bigint", "is_me": "boolean"} | passed_read(passed) | cells(CELLS)
    parts = {"editing_match_id": "bigint", "meta": struct_of(cells(META)), "rows": f"array<{struct_of(row)}>"} | {k: f"array<{struct_of(v)}>" for k, v in LISTS.items()}
    return struct_of(parts | {"_malformed": "string"})


@dataclass
class Documents:
    """Drafts taken apart.  All tables have ``draft_id``; lists have ``place``, their order in the document."""

    meta: DataFrame  #: editing_match_id, and a cell a match field
    rows: DataFrame  #: place, team, row_index, is_me, what is passed through, and a cell a row field
    bans: DataFrame
    files: DataFrame
    conflicts: DataFrame
    superseded: DataFrame
    rejects: DataFrame  #: reason, payload: drafts that are in no other table


def passed_read(passed: Sequence[str]) -> dict[str, str]:
    return {k: kind for k, kind in PASSED.items() if k in passed or kind != "string"}


def cells_typed(names: dict[str, str], of: Column, parts: Sequence[str]) -> list[Column]:
    return [F.when(of[k].isNotNull(), F.struct(of[k]["value"].try_cast(kind).alias("value"), *(of[k][c].alias(c) for c in PARTS[1:] if c in parts or c == "confidence"))).alias(k) for k, kind in names.items()]


def unreadable(names: dict[str, str], of: Column) -> Column:
    """The first field of a struct of cells whose value isn't blank and is not of its type."""
    bad = [F.when(of[k]["value"].rlike(r"\S") & of[k]["value"].try_cast(kind).isNull(), F.lit(k)) for k, kind in names.items() if kind != "string"]
    return F.coalesce(*bad)


Derived = Mapping[str, Callable[[Column], Column]]  # columns by name, made of a struct of cells


def parse(
    drafts: DataFrame, keep: bool = False, parts: Sequence[str] = PARTS, passed: Sequence[str] = tuple(PASSED), cells: Sequence[str] = tuple(CELLS),
    of_meta: Derived | None = None, of_row: Derived | None = None, read: Sequence[str] | None = None,
) -> Documents:
    """Takes the payloads of ``drafts`` (id, payload) apart.

    A draft whose payload is no JSON object, lacks ``meta`` or ``rows``, has two rows of one seat or a value of the wrong type is a reject with its reason.
    Missing fields are null, missing lists empty; keys that the format doesn't have are not kept.  A row without ``is_me`` isn't the operator's.
    A payload is read with the fields' types; only one that doesn't fit them, as numbers given as text do, is read again as text and judged value by value.
    What comes of it is written (``materialize``, to which ``keep`` goes), and all tables are read from there; of what was read, cells keep
    ``parts`` and rows ``passed`` and ``cells``.  ``of_meta`` and ``of_row`` are columns more of those tables, which may be made of
    all cells with the parts ``read`` (by default ``parts``), a value and its confidence among them, whether they are kept or not.
    """
    of_meta, of_row, read_parts = of_meta or {}, of_row or {}, parts if read is None else read
    how = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_malformed"}
    fits = lambda c: F.col(c).isNotNull() & F.col(f"{c}._malformed").isNull()
    read = drafts.select(F.col("id").alias("draft_id"), "payload").withColumn("d", F.from_json("payload", payload_type(True, read_parts, passed), how))
    read = read.withColumn("s", F.when(~fits("d"), F.from_json("payload", payload_type(False, read_parts, passed), how)))
    meta, rows = F.col("s.meta"), F.col("s.rows")
    wrong = F.coalesce(unreadable(META, meta), F.get(F.filter(F.transform(rows, lambda r: unreadable(CELLS, r)), lambda x: x.isNotNull()), F.lit(0)))
    as_is = ["team", "row_index", "is_me", *passed_read(passed)]
    typed = F.struct(
        F.col("s.editing_match_id").alias("editing_match_id"), F.when(meta.isNotNull(), F.struct(*cells_typed(META, meta, read_parts))).alias("meta"),
        F.transform(rows, lambda r: F.when(r.isNotNull(), F.struct(*(r[c].alias(c) for c in as_is), *cells_typed(CELLS, r, read_parts)))).alias("rows"), *(F.col(f"s.{k}").alias(k) for k in LISTS), F.col("s._malformed").alias("_malformed"),
    )
    read = read.select("draft_id", "payload", F.when(F.col("s").isNotNull(), wrong).alias("wrong"), F.when(fits("d"), F.col("d")).when(fits("s"), typed).alias("d"))
    seats = F.transform("d.rows", lambda r: F.concat_ws(":", r["team"], r["row_index"].cast("string")))
    reason = (
        F.when(F.col("d").isNull(), "not a JSON object of this shape")
        .when(F.col("d.meta").isNull(), "no meta").when(F.col("d.rows").isNull(), "no rows")
        .when(F.size(F.array_distinct(seats)) < F.size("d.rows"), "two rows of one seat")
        .when(F.col("wrong").isNotNull(), F.concat(F.lit("not a number: "), "wrong"))
    )
    judged = read.withColumn("reason", reason)
    bad = F.col("reason").isNotNull()
    judged = judged.select("draft_id", "reason", F.when(bad, F.col("payload")).alias("payload"), F.when(~bad, F.col("d")).alias("d"))
    # one line for each row of the scoreboard, the first with what the document has once: columns of their own, of which readers take those that they need
    lines = judged.select("*", F.posexplode_outer("d.rows").alias("place", "r"))
    cell = lambda of, k: F.col(f"{of}.{k}") if list(parts) == PARTS else F.when(F.col(f"{of}.{k}").isNotNull(), F.struct(*(F.col(f"{of}.{k}.{x}").alias(x) for x in parts)))
    once = {"editing_match_id": F.col("d.editing_match_id")} | {k: cell("d.meta", k) for k in META} | {k: F.col(f"d.{k}") for k in LISTS} | {k: make(F.col("d.meta")) for k, make in of_meta.items()}
    first = F.coalesce(F.col("place"), F.lit(0)) == 0
    lines = lines.select(
        "draft_id", "reason", "payload", *(F.when(first, c).alias(k) for k, c in once.items()),
        "place", "r.team", "r.row_index", F.coalesce("r.is_me", F.lit(False)).alias("is_me"), *(f"r.{c}" for c in passed), *(cell("r", c).alias(c) for c in cells), *(make(F.col("r")).alias(k) for k, make in of_row.items()),
    )
    lines = materialize(lines, "parsed", keep)
    good = lines.filter((F.col("reason").isNull()) & first)
    rows = lines.filter("place IS NOT NULL").select("draft_id", "place", "team", "row_index", "is_me", *passed, *cells, *of_row)
    lists = {k: good.select("draft_id", F.posexplode(k).alias("place", "x")).select("draft_id", "place", "x.*") for k in LISTS}
    return Documents(meta=good.select("draft_id", "editing_match_id", *META, *of_meta), rows=rows, rejects=lines.filter("reason IS NOT NULL").select("draft_id", "reason", "payload"), **lists)


def build(docs: Documents) -> DataFrame:
    """(draft_id, payload): the documents again, lists in the order of ``place``; parsing them gives the same tables."""
    parts = {"_meta": docs.meta.select("draft_id", F.struct("editing_match_id", F.struct(*META).alias("meta")).alias("_meta"))}
    for name in ("rows", *LISTS):
        table = getattr(docs, name)
        cols = [c for c in table.columns if c not in ("draft_id", "place")]
        parts[name] = table.select("draft_id", F.struct("place", F.struct(*cols).alias("x")).alias(name))
    # one column a table, so that all are dealt and collected at once
    kinds = {name: part.schema[name].dataType for name, part in parts.items()}
    out = None
    for name, part in parts.items():
        part = part.select("draft_id", *(F.col(k) if k == name else F.lit(None).cast(kind).alias(k) for k, kind in kinds.items()))
        out = part if out is None else out.union(part)
    lists = (F.array_sort(F.collect_list(name)).alias(name) for name in ("rows", *LISTS))  # one document's; nulls aren't collected
    # a document is many times its packed rows, by whose size Spark would make few tasks of them
    out = out.repartition(partitions_for(out), "draft_id").groupBy("draft_id").agg(F.first("_meta", ignorenulls=True).alias("_meta"), *lists).filter("_meta IS NOT NULL")
    out = out.select("draft_id", "_meta.*", *(F.transform(name, lambda x: x["x"]).alias(name) for name in ("rows", *LISTS)))
    return out.select("draft_id", F.to_json(F.struct("editing_match_id", "meta", "rows", *LISTS), {"ignoreNullFields": "false"}).alias("payload"))


def cells(docs: Documents) -> DataFrame:
    """(draft_id, path, value, source, origin, confidence): every cell with a value that isn't blank, as text."""
    one = lambda path, c: F.struct(path.alias("path"), F.col(c)["value"].cast("string").alias("value"), *(F.col(c)[k].alias(k) for k in ("source", "origin", "confidence")))
    seat = F.concat(F.lit("rows["), "team", F.lit(":"), F.col("row_index").cast("string"), F.lit("]."))
    meta = docs.meta.select("draft_id", F.explode(F.array(*(one(F.lit(f"meta.{c}"), c) for c in META))).alias("c"))
    rows = docs.rows.select("draft_id", F.explode(F.array(*(one(F.concat(seat, F.lit(c)), c) for c in CELLS))).alias("c"))
    return meta.union(rows).select("draft_id", "c.*").filter(F.col("value").rlike(r"(?U)\S"))


def manual(value: Column) -> Column:
    """A cell that the operator has typed."""
    return F.struct(value.alias("value"), F.lit("manual").alias("source"), F.lit("manual").alias("origin"), F.lit(1.0).alias("confidence"))


def same(a: Documents, b: Documents) -> bool:
    """Whether two sets of documents have the same rows in each table."""
    return all(x.exceptAll(y.select(x.columns)).isEmpty() and y.select(x.columns).exceptAll(x).isEmpty() for x, y in ((getattr(a, f.name), getattr(b, f.name)) for f in fields(Documents)))
