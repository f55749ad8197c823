"""Conversation structure repair: the cheapest edits that give a conversation a legal order of roles.

A grammar of four states accepts `(s?(ua)+)?` over the initials of roles. Rows of
all conversations are put in order across partitions, so that one conversation may
lie in many, and cut into pieces of ROWS rows. Pieces are dealt to tasks by hash;
in a batch of pieces, a recursive DuckDB query advances one turn at a time in all of
them at once and keeps, for each state that a piece may begin in and each that it may
be in, the least cost and its audit. Such tables compose: the pieces of a long
conversation are put together by the same query, FAN of them at a time, in which a
step is a piece. Faults and gaps are counted along with that.

What is left to a single task is the digest of one conversation, which no machine can
split: it is streamed row by row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import duckdb
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftpool.llm.textops import parts_for, written

ROWS = 64  # of a piece
FAN = 64  # pieces of a conversation put together in one step
BATCH = 16_384  # rows or pieces in one query, about
SPACES = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5  # costs
#: States: nothing yet, after a system turn, after a user's, after an assistant's; where an initial leads.
STEPS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
#: Cost and audit of ending in a state: what has to be inserted.
ENDS = {0: (0, ""), 1: (2 * INSERT, "II"), 2: (INSERT, "I"), 3: (0, "")}
FACTS = ("n", "blank", "duplicate", "truncated", "illegal", "turns")
EDGES = ("first_initial string", "last_initial string", "first_turn bigint", "last_turn bigint", "least_turn bigint")


def damaged(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The rows after damage by CRC-32 of "conv:turn" modulo 20; nulls of all four columns count as one space there, those of role and text stay one."""
    own = rows.select(F.col(conv).cast("bigint").alias(conv), F.col(turn).cast("bigint").alias(turn), *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in (role, text)))
    kind = F.pmod(F.crc32(F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (conv, turn))).cast("binary")), F.lit(20))
    own = own.withColumn("kind__", kind).where("kind__ != 0").withColumns(
        {
            text: F.when(F.col("kind__") == 1, "").when(F.col("kind__") == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(F.col(text)),
            role: F.when(F.col("kind__") == 4, "user").otherwise(F.col(role)),
            "copy__": F.explode(F.when(F.col("kind__") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))),
        }
    )
    return own.drop("kind__", "copy__")


@cache
def moves() -> pa.Table:
    """Rows (initial, fault, origin, upto, cost, audit): a row's edit in a state, after what is inserted before it; the best of each pair of states."""
    best: dict[tuple, tuple[int, str]] = {}
    for origin in range(4):
        before = {origin: (0, "")}
        for _ in range(2):  # more insertions come back to a state
            for state, (cost, audit) in list(before.items()):
                for initial in "ua":
                    to = STEPS.get((state, initial))
                    if to is not None:
                        before[to] = min(before.get(to, (1 << 40, "")), (cost + INSERT, audit + "I"))
        for initial in "sua-":
            for fault in ("delete", "truncated", "none"):
                for state, (cost, audit) in before.items():
                    options = [(state, DELETE, "D")]
                    if fault != "delete":
                        more = TRUNCATED if fault == "truncated" else 0
                        options += [(STEPS.get((state, initial)), KEEP + more, "K"), *((STEPS.get((state, to)), REROLE + more, "R") for to in "ua")]
                    for upto, price, edit in options:
                        if upto is not None:
                            key = (initial, fault, origin, upto)
                            best[key] = min(best.get(key, (1 << 40, "")), (cost + price, audit + edit))
    rows = [(*k, *v) for k, v in best.items()]
    return pa.table(dict(zip(("initial", "fault", "origin", "upto", "cost", "audit"), map(list, zip(*rows)))))


#: Puts the steps of each piece together, one step of all pieces at a time.
_ADVANCE = """
    WITH RECURSIVE dp AS (
        SELECT piece, 1 AS i, origin, upto, cost, audit FROM steps WHERE i = 1
        UNION ALL
        SELECT piece, i, origin, upto, best.cost, best.audit FROM (
            SELECT d.piece, d.i + 1 AS i, d.origin, s.upto, min(struct_pack(cost := d.cost + s.cost, audit := d.audit || s.audit)) AS best
            FROM dp d JOIN steps s ON s.piece = d.piece AND s.i = d.i + 1 AND s.origin = d.upto
            GROUP BY d.piece, d.i, d.origin, s.upto
        )
    ),
    ends AS (SELECT piece, max(i) AS i FROM steps GROUP BY piece)
    SELECT piece, list(struct_pack(origin := origin, upto := upto, cost := cost, audit := audit) ORDER BY origin, upto) AS ways
    FROM dp JOIN ends USING (piece, i) GROUP BY piece
"""
#: Rows to steps and facts; only a row that begins a block of positions may continue a conversation.
_ROWS = f"""
    CREATE OR REPLACE TEMP TABLE own AS
    SELECT *, min(pos) OVER w AS piece, row_number() OVER (w ORDER BY pos) AS i, lag(initial) OVER (w ORDER BY pos) AS before, lag(turn) OVER (w ORDER BY pos) AS turn_before
    FROM (SELECT pos, seg, conv, turn, initial, CASE WHEN blank THEN 'blank' WHEN NOT first THEN 'duplicate' WHEN truncated THEN 'truncated' ELSE 'none' END AS fault
          FROM (SELECT pos, seg, any_value(conv) conv, any_value(turn) turn, any_value(initial) initial, any_value(blank) blank, any_value(truncated) truncated, bool_or(first) AS first FROM batch GROUP BY pos, seg))
    WINDOW w AS (PARTITION BY seg, conv);
    CREATE OR REPLACE TEMP TABLE steps AS
    SELECT piece, i, origin, upto, cost::BIGINT AS cost, audit FROM own JOIN moves m
    ON m.initial = own.initial AND m.fault = CASE WHEN own.fault IN ('blank', 'duplicate') THEN 'delete' ELSE own.fault END
    WHERE i > 1 OR origin = 0 OR piece % {ROWS} = 0;
    CREATE OR REPLACE TEMP TABLE facts AS
    SELECT piece, any_value(conv) AS conv, count(*) AS n, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
        count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE i > 1 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal,
        count(*) FILTER (WHERE turn IS NOT NULL AND turn IS DISTINCT FROM turn_before) AS turns,
        arg_min(initial, pos) AS first_initial, arg_max(initial, pos) AS last_initial, arg_min_null(turn, pos) AS first_turn, arg_max_null(turn, pos) AS last_turn, min(turn) AS least_turn
    FROM own GROUP BY piece
"""
#: Pieces to steps and facts of larger pieces.
_PIECES = """
    CREATE OR REPLACE TEMP TABLE own AS
    SELECT * EXCLUDE (piece), min(piece) OVER w AS piece, row_number() OVER (w ORDER BY piece) AS i, lag(last_initial) OVER (w ORDER BY piece) AS before, lag(last_turn) OVER (w ORDER BY piece) AS turn_before
    FROM batch WINDOW w AS (PARTITION BY conv, block);
    CREATE OR REPLACE TEMP TABLE steps AS SELECT piece, i, way.origin, way.upto, way.cost, way.audit FROM (SELECT piece, i, unnest(ways) AS way FROM own);
    CREATE OR REPLACE TEMP TABLE facts AS
    SELECT piece, any_value(conv) AS conv, sum(n)::BIGINT AS n, sum(blank)::BIGINT AS blank, sum(duplicate)::BIGINT AS duplicate, sum(truncated)::BIGINT AS truncated,
        (sum(illegal) + count(*) FILTER (WHERE i > 1 AND before || first_initial NOT IN ('su', 'ua', 'au')))::BIGINT AS illegal,
        (sum(turns) - count(*) FILTER (WHERE first_turn = turn_before))::BIGINT AS turns,
        arg_min(first_initial, i) AS first_initial, arg_max(last_initial, i) AS last_initial, arg_min_null(first_turn, i) AS first_turn, arg_max_null(last_turn, i) AS last_turn, min(least_turn) AS least_turn
    FROM own GROUP BY piece
"""
_NAMES = ["piece", "conv", *FACTS, *(e.split()[0] for e in EDGES), "ways"]
_PIECE = f"piece bigint, conv bigint, {', '.join(f'{f} bigint' for f in FACTS)}, {', '.join(EDGES)}, ways array<struct<origin:int,upto:int,cost:bigint,audit:string>>"


def _batches(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of about BATCH rows; rows of one key, which come one after another, stay together."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        while batch.num_rows:
            if size >= BATCH:
                last, keys = held[-1].column(key)[-1].as_py(), batch.column(key).to_pylist()
                n = next((i for i, k in enumerate(keys) if k != last), len(keys))
                held.append(batch.slice(0, n))
                batch = batch.slice(n)
                if not batch.num_rows:
                    break
                yield pa.Table.from_batches(held)
                held, size = [], 0
            part = batch.slice(0, BATCH)
            held.append(part)
            size += part.num_rows
            batch = batch.slice(BATCH)
    if size:
        yield pa.Table.from_batches(held)


def _advanced(prepare: str, key: str):
    """Batches of rows or pieces to pieces."""

    def run(batches):
        with duckdb.connect(config={"threads": 1}) as con:
            con.register("moves", moves())
            for table in _batches(batches, key):
                con.register("batch", table)
                for statement in prepare.split(";"):
                    con.execute(statement)
                got = con.sql(f"SELECT {', '.join(_NAMES)} FROM facts JOIN ({_ADVANCE}) USING (piece)").to_arrow_table()
                yield from got.cast(_ARROW).to_batches()
                con.unregister("batch")

    return run


_ARROW = pa.schema([("piece", pa.int64()), ("conv", pa.int64()), *((f, pa.int64()) for f in FACTS), ("first_initial", pa.string()), ("last_initial", pa.string()), ("first_turn", pa.int64()), ("last_turn", pa.int64()), ("least_turn", pa.int64()), ("ways", pa.list_(pa.struct([("origin", pa.int32()), ("upto", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])))])


def _pieces(turns: DataFrame, parts: int) -> DataFrame:
    """Pieces of ROWS rows of a conversation, from rows (pos, conv, turn, initial, blank, truncated, said)."""
    first = turns.where("not blank").groupBy("conv", "said").agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("first"))
    told = turns.drop("said").withColumn("first", F.lit(False)).unionByName(first, allowMissingColumns=True)
    told = told.withColumn("seg", F.floor(F.col("pos") / ROWS).cast("bigint")).repartition(parts, "seg").sortWithinPartitions("seg")
    return told.mapInArrow(_advanced(_ROWS, "seg"), _PIECE)


def _whole(pieces: DataFrame, parts: int) -> DataFrame:
    """One piece for each conversation."""
    done: DataFrame | None = None
    shift = ROWS
    while True:
        count = pieces.groupBy("conv").agg(F.count("*").alias("pieces")).withColumnRenamed("conv", "of")
        counted = written(pieces.join(count, F.col("conv").eqNullSafe(F.col("of"))).drop("of"), "pieces")
        single = counted.where("pieces = 1").drop("pieces")
        done = single if done is None else done.unionByName(single)
        rest = counted.where("pieces > 1")
        if rest.isEmpty():
            return done
        shift *= FAN
        rest = rest.withColumn("block", F.when(F.col("pieces") <= FAN, F.lit(-1)).otherwise(F.floor(F.col("piece") / shift)).cast("bigint")).drop("pieces")
        rest = rest.withColumn("grp", F.xxhash64("conv", "block")).repartition(parts, "grp").sortWithinPartitions("grp")
        pieces = rest.mapInArrow(_advanced(_PIECES, "grp"), _PIECE)


def _ended() -> Column:
    """(cost, audit) of a whole conversation: the best of its ways from nothing, with what its end takes."""

    def of(way: Column) -> Column:
        cost, audit = F.lit(0), F.lit("")
        for state, (price, edits) in ENDS.items():
            cost = F.when(way["upto"] == state, F.lit(price)).otherwise(cost)
            audit = F.when(way["upto"] == state, F.lit(edits)).otherwise(audit)
        return F.struct((way["cost"] + cost).alias("cost"), F.concat(way["audit"], audit).alias("audit"))

    return F.array_min(F.transform(F.filter("ways", lambda w: w["origin"] == 0), of))


def _roles(audit: str) -> Iterator[str]:
    """The role that each undeleted or inserted turn of a repaired conversation has."""
    n = len(audit) - audit.count("D")
    if n % 2:
        yield "system"
    for _ in range(n // 2):
        yield from ("user", "assistant")


def _edited(audit: str, rows: Iterator[tuple[str, str]]) -> Iterator[str]:
    """The turns of a repaired conversation as role:text; rows are read as edits need them."""
    roles = _roles(audit)
    for edit in audit:
        if edit == "I":
            yield f"{next(roles)}:"
            continue
        role, text = next(rows)
        if edit != "D":
            wanted = next(roles)
            yield f"{role if edit == 'K' else wanted}:{text}"


def repaired(rows: DataFrame, every: DataFrame | None = None, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows (conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256), one for each conversation of every (or of rows).

    Rows of a conversation are taken by turn, nulls first, ties by role and
    text. The first fault of each counts: blank (nothing but spaces), duplicate
    (role and text of an earlier row), truncated (does not end in one of .!?).
    Keep is free, rerole to user or assistant costs 1, delete 2, insert an empty
    turn 5, a truncated row that stays 5; blank and duplicate rows are deleted.
    audit holds the initials of the cheapest edits in order, the least in ASCII
    of equal ones. gaps are the turns missing between the first and the last,
    illegal the neighbours whose initials are not su, ua or au. Null roles and
    texts are one space; rows of a null conversation make one. Conversations
    without rows have zeros, an empty audit and the digest of nothing. Other
    columns are not read; an empty table gives no rows.
    """
    parts = parts_for(rows.sparkSession)
    own = rows.select(F.col(conv).cast("bigint").alias("conv"), F.col(turn).cast("bigint").alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit(" ")).alias("text"))
    order = ["conv", "turn", "role", "text"]
    placed = own.repartitionByRange(parts, "conv", "turn", "role", F.substring("text", 1, 64)).sortWithinPartitions(*order)
    bare = F.rtrim("text", F.lit(SPACES))
    initial = F.substring("role", 1, 1)
    turns = placed.select(
        F.monotonically_increasing_id().alias("at"),
        "conv",
        "turn",
        F.when(initial.isin("s", "u", "a"), initial).otherwise("-").alias("initial"),
        (bare == "").alias("blank"),
        (~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("truncated"),
        F.unhex(F.sha2(F.concat_ws(":", F.length("role"), "role", "text"), 256)).alias("said"),
    )
    turns = written(turns, "turns")
    # positions: partitions one after another, each with room for the largest, in whole pieces
    inside = F.col("at").bitwiseAND((1 << 33) - 1)
    most = turns.agg(F.max(inside)).first()[0] or 0
    room = ROWS * (most // ROWS + 1)
    numbered = turns.withColumn("pos", F.shiftright("at", 33) * room + inside).drop("at")
    whole = _whole(_pieces(numbered, parts), parts)

    gaps = F.when(F.col("least_turn").isNull(), 0).otherwise(F.col("last_turn") - F.col("least_turn") + 1 - F.col("turns"))
    facts = whole.select(F.col("conv").alias("of"), gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", _ended().alias("end"))
    ids = (rows if every is None else every).select(F.col(conv).cast("bigint").alias("conv")).distinct()
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    heads = ids.join(facts, F.col("conv").eqNullSafe(F.col("of")), "left").withColumn("cost", F.col("end.cost"))
    heads = heads.select("conv", *(F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in numbers), F.coalesce("end.audit", F.lit("")).alias("text"), F.lit(0).alias("tag"))
    told = heads.unionByName(own.withColumn("tag", F.lit(1)), allowMissingColumns=True).repartition(parts, "conv").sortWithinPartitions("conv", "tag", "turn", "role", "text")

    def run(batches):
        names = ["conv", "tag", "role", "text", *numbers]
        flat = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in names)))
        now = next(flat, None)

        def body(of):
            nonlocal now
            while now is not None and now[1] == 1 and now[0] == of:
                row, now = now, next(flat, None)
                yield row[2], row[3]

        out = []
        while now is not None:
            head, now = now, next(flat, None)
            digest, first, left = hashlib.sha256(), True, body(head[0])
            if head[1] == 0:  # rows of a conversation that is not asked for have no head
                for line in _edited(head[3], left):
                    digest.update((line if first else "\n" + line).encode())
                    first = False
                out.append((head[0], *head[4:], head[3], digest.hexdigest()))
            for _ in left:
                pass
            if len(out) >= 1024:
                yield told_batch(out)
                out = []
        if out:
            yield told_batch(out)

    columns = ["conv", *numbers, "audit", "repaired_sha256"]
    types = [pa.int64()] * 7 + [pa.string()] * 2

    def told_batch(out):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], columns)

    schema = "conv bigint, " + ", ".join(f"{c} bigint" for c in numbers) + ", audit string, repaired_sha256 string"
    return told.mapInArrow(run, schema).withColumnRenamed("conv", conv)
