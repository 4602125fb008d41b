"""Conversation repair: the cheapest edits that give every conversation the turns of a grammar.

Initials of the repaired roles read ``(s?(ua)+)?``.  The grammar has four states
(nothing yet, after s, after u, after a).  Turns become one letter each; a
conversation's letters are cut into segments of ``SEGMENT`` turns, which Spark
deals out by the hash of conversation and segment, so that one endless
conversation is many tasks.  Inside a task DuckDB runs one recursive query over a
batch of segments: each recursion advances one turn in all of them and keeps, for
every grammar state, the least cost and of its audits the least.  A segment that
isn't its conversation's first starts from each state; a second recursive query
then advances one segment at a time.  Equal costs can't have one audit begin the
other (they consumed the same turns, and an insert costs), so the least whole is
made of least parts.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import bounded_batches, materialise

BLANKS = " \t\n\x0b\f\r"
#: Turns of a segment, and segments that one recursive query advances together.
SEGMENT, BATCH = 512, 4096
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1

#: The state after a letter, by state; nothing else is grammatical.
_AFTER = {(0, "s"): 1, **{(k, "u"): 2 for k in (0, 1, 3)}, (2, "a"): 3}
_ENDS = (0, 3)


def _inserted(state: int) -> list[tuple[str, int, int]]:
    """(audit, cost, state) of up to two inserts; more only come back to a state at a cost."""
    out = [("", 0, state)]
    for _ in range(2):
        audit, cost, at = out[-1]
        at = _AFTER[at, "a" if at == 2 else "u"]
        if at != state:
            out.append((audit + "I", cost + INSERT, at))
    return out


def _moves() -> list[tuple[int, str, int, int, str]]:
    """(state, code, next state, cost, audit) of all inserts before a turn and one edit of it.

    Codes: d for a turn that must go, else the role's initial or x, upper case if truncated.
    """
    out = []
    for state in range(4):
        for audit, cost, at in _inserted(state):
            for code in "dsuaxSUAX":
                out.append((state, code, at, cost + DELETE, audit + "D"))
                if code == "d":
                    continue
                extra = TRUNCATED * code.isupper()
                if (kept := _AFTER.get((at, code.lower()))) is not None:
                    out.append((state, code, kept, cost + KEEP + extra, audit + "K"))
                out.append((state, code, _AFTER[at, "a" if at == 2 else "u"], cost + REROLE + extra, audit + "R"))
    return out


_ADVANCE = """
WITH RECURSIVE best(k, start, state, turn, x) USING KEY (k, start, state) AS (
    SELECT k, s, s, 0, row(0::BIGINT, '') FROM segments, unnest(CASE WHEN seg = 0 THEN [0] ELSE [0, 1, 2, 3] END) AS t(s)
  UNION
    SELECT b.k, b.start, m.state, any_value(b.turn) + 1, min(row(b.x[1] + m.cost, b.x[2] || m.audit))
    FROM best AS b JOIN segments AS s ON s.k = b.k JOIN moves AS m ON m.old = b.state AND m.code = s.codes[b.turn + 1]
    WHERE b.turn < length(s.codes) GROUP BY b.k, b.start, m.state
)
SELECT b.k, b.start, b.state, b.x[1] AS cost, b.x[2] AS audit FROM best AS b JOIN segments AS s ON s.k = b.k WHERE b.turn = length(s.codes)
"""

_CHAIN = """
WITH RECURSIVE best(k, state, seg, x) USING KEY (k, state) AS (
    SELECT DISTINCT k, 0, 0, row(0::BIGINT, '') FROM parts
  UNION
    SELECT b.k, p.state, any_value(b.seg) + 1, min(row(b.x[1] + p.cost, b.x[2] || p.audit))
    FROM best AS b JOIN parts AS p ON p.k = b.k AND p.seg = b.seg AND p.start = b.state GROUP BY b.k, p.state
)
SELECT k, x[1] AS cost, x[2] AS audit FROM (
    SELECT b.k, min(row(b.x[1] + e.cost, b.x[2] || e.audit)) AS x
    FROM best AS b JOIN (SELECT k, max(seg) + 1 AS n FROM parts GROUP BY k) AS c ON c.k = b.k AND c.n = b.seg JOIN ends AS e ON e.old = b.state GROUP BY b.k)
"""


def _database():
    """In memory, one thread, no files: batches are bounded."""
    import duckdb

    base = duckdb.connect(config={"threads": 1, "temp_directory": ""})
    rows = lambda r: ", ".join(map(repr, r))
    base.execute(f"CREATE TABLE moves AS SELECT * FROM (VALUES {rows(_moves())}) AS t(old, code, state, cost, audit)")
    ends = [(state, cost, audit) for state in range(4) for audit, cost, at in _inserted(state) if at in _ENDS]
    base.execute(f"CREATE TABLE ends AS SELECT * FROM (VALUES {rows(ends)}) AS t(old, cost, audit)")
    return base


def _gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def _advance(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    base = _database()
    for table in _gathered(batches, BATCH):
        base.register("segments", pa.table({"k": pa.array(range(len(table)), pa.int64()), "seg": table["seg"], "codes": table["codes"]}))
        found = base.sql(_ADVANCE).to_arrow_table()
        base.unregister("segments")
        k = found["k"].combine_chunks()
        out = pa.table({"conv_id": table["conv_id"].take(k), "seg": table["seg"].take(k)} | {c: found[c].cast(t) for c, t in (("start", pa.int32()), ("state", pa.int32()), ("cost", pa.int64()), ("audit", pa.string()))})
        yield from out.combine_chunks().to_batches()


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    base = _database()
    for table in _gathered(batches, BATCH):
        parts = table["parts"].combine_chunks()
        flat = pa.Table.from_struct_array(parts.flatten())
        k = pa.compute.list_parent_indices(parts)
        base.register("parts", flat.append_column("k", k.cast(pa.int64())))
        found = base.sql(_CHAIN).to_arrow_table()
        base.unregister("parts")
        out = pa.table({"conv_id": table["conv_id"].take(found["k"].combine_chunks()), "cost": found["cost"].cast(pa.int64()), "audit": found["audit"].cast(pa.string())})
        yield from out.combine_chunks().to_batches()


def _edited(audit: str, rows: list[dict]) -> list[dict]:
    """The turns that an audit makes of a conversation's rows."""
    out, at, state = [], 0, 0
    for edit in audit:
        row = None if edit == "I" else rows[at]
        at += edit != "I"
        if edit == "D":
            continue
        if edit == "K":
            state = _AFTER[state, row["role"][:1]]
            out.append({"role": row["role"], "text": row["text"]})
        else:
            role = "assistant" if state == 2 else "user"
            state = _AFTER[state, role[0]]
            out.append({"role": role, "text": row["text"] if row else ""})
    return out


def _repaired(audit: pa.Array, rows: pa.Array) -> pa.Array:
    kind = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
    return pa.array([_edited(a.as_py() or "", r.as_py() or []) for a, r in zip(audit, rows)], kind)


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of conversations with faults set by crc32("conv_id:turn") modulo 20.

    0 drops the row, 1 empties its text, 2 takes its ``.!?`` out, 3 repeats it, 4 makes
    it a user's.  Null role and text become one space, and so does a null id or turn
    inside the key.  Repeated rows are damaged alike; an empty table gives no rows;
    other columns are dropped.
    """
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20
    d = conversations.select("conv_id", "turn", part("role").alias("role"), part("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return d.select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("time")).drop("time")


def faults(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, place (from 1), new_turn, illegal (against the turn before), fault (blank, duplicate, truncated or null), code.

    Turns stand in the order of turn (nulls first), role, text.  Blank: no other
    character than ASCII white space; duplicate: its role and text stood earlier;
    truncated: the last other character is none of ``.!?``.
    """
    d = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    initial = F.substring("role", 1, 1)
    d = d.withColumns({"place": F.row_number().over(order).cast("long"), "before": F.lag(initial).over(order), "last_turn": F.lag("turn").over(order)})
    # dealt out by conversation as it is, so this sorts but doesn't shuffle again
    again = F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy("place")) > 1
    core = F.rtrim(F.col("text"), F.lit(BLANKS))
    fault = F.when(core == "", "blank").when(F.col("again"), "duplicate").when(~F.right(core, F.lit(1)).isin(".", "!", "?"), "truncated")
    d = d.withColumn("again", again).withColumn("fault", fault)
    code = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    code = F.when(F.col("fault").isin("blank", "duplicate"), "d").when(F.col("fault") == "truncated", F.upper(code)).otherwise(code)
    return d.select(
        "conv_id", "turn", "role", "text", "place",
        (F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(F.col("last_turn"))).alias("new_turn"),
        (F.col("before").isNotNull() & ~F.concat("before", initial).isin("su", "ua", "au")).alias("illegal"), "fault", code.alias("code"),
    )


def audits(coded: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """conv_id, cost, audit of coded(conv_id, place, code): the cheapest edits, of equal ones the ASCII-least initials."""
    seg = F.floor((F.col("place") - 1) / segment).cast("int")
    letters = F.array_sort(F.collect_list(F.struct("place", "code")))
    segments = coded.select("conv_id", seg.alias("seg"), "place", "code").groupBy("conv_id", "seg").agg(F.array_join(letters["code"], "").alias("codes"))
    parts = segments.mapInArrow(_advance, coded.select("conv_id").withColumns({"seg": F.lit(0), "start": F.lit(0), "state": F.lit(0), "cost": F.lit(0).cast("long"), "audit": F.lit("")}).schema)
    whole = parts.groupBy("conv_id").agg(F.collect_list(F.struct("seg", "start", "state", "cost", "audit")).alias("parts"))
    return whole.mapInArrow(_chain, coded.select("conv_id").withColumns({"cost": F.lit(0).cast("long"), "audit": F.lit("")}).schema)


def repair(turns: DataFrame, ids: DataFrame | None = None, segment: int = SEGMENT) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired (array of role, text) of every conversation.

    turns(conv_id, turn, role, text); ids(conv_id) names further conversations, which
    have no turns left.  gaps: turn numbers missing between least and greatest.  An edit
    keeps a turn (K), gives it another role (R), deletes (D) or inserts (I) one; blank
    and duplicate turns must go, a truncated one that stays costs ``TRUNCATED``.  Null
    role and text count as one space, a null turn stands first, a null conv_id is a
    conversation of its own.  Repeated rows are turns of their own, and duplicates.  A
    conversation without turns has zeros, an empty audit and no turns; an empty table
    gives a row for each of ids.  Other columns are ignored.  A very long conversation
    is cut into segments; only its result is one row.
    """
    bounded_batches(turns.sparkSession)
    rows = materialise(faults(turns), "turns")
    row = F.struct("place", "role", "text").alias("row")
    d = rows.select("conv_id", "turn", "new_turn", "illegal", "fault", row)
    d = d.unionByName(audits(rows, segment), allowMissingColumns=True)
    d = d.unionByName((rows if ids is None else ids).select("conv_id").distinct(), allowMissingColumns=True)
    many = lambda x, name: F.count(F.when(x, 1)).alias(name)
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count(F.when(F.col("new_turn"), 1)), F.lit(0)).alias("gaps")
    g = d.groupBy("conv_id").agg(
        gaps, *[many(F.col("fault") == k, k) for k in ("blank", "duplicate", "truncated")], many(F.col("illegal"), "illegal"),
        F.coalesce(F.max("cost"), F.lit(0)).alias("cost"), F.coalesce(F.max("audit"), F.lit("")).alias("audit"), F.array_sort(F.collect_list("row")).alias("rows"),
    )
    named = F.transform("rows", lambda r: F.struct(r["role"].alias("role"), r["text"].alias("text")))
    turned = F.arrow_udf(_repaired, "array<struct<role:string,text:string>>")
    return g.withColumn("repaired", turned("audit", named)).drop("rows")


def repaired_text(repaired: str) -> Column:
    """``role:text`` of all repaired turns, a line feed between."""
    return F.array_join(F.transform(repaired, lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
