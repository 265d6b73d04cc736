"""Conversation structure repair by depth-first branch and bound.

A conversation is well formed when its roles' initials are an optional system
turn and then pairs of user and assistant, or nothing at all.  Rows are kept,
given another role or deleted, and empty turns are inserted, at least cost; of
equal costs the ASCII-least string of the edits' initials (the audit) wins.

`repair` is the search.  A node is a prefix of the rows with the last role
given out.  Suffix lower bounds, one for each row and role, come from a sweep
from the end.  A dive by those bounds gives the first incumbent; then an
explicit stack expands edits in ASCII order, drops what the bound or a node's
dominance table (the least cost with which it was reached, so far by the
ASCII-least edits) rules out, and ends once the incumbent meets the root's
bound, which proves it.  From any role each edit leads to one other, so the
search is linear in the rows.

Rows are range-partitioned by conversation, turn and row, so that a
conversation of any size is spread, and each task streams its sorted rows.  A
conversation that lies inside one task is settled there.  The first and last of
each task, and those above HELD_ROWS rows or HELD_BYTES of text, may go on in
another task; their rows are written to a table instead.  For those, repeats
are found by an aggregate over (conversation, role, digest), one code byte for
each row is gathered in pieces, and the texts are streamed once more, sorted,
through SHA-256.  What one task holds of such a conversation is its codes and
edits, a few bytes for each row, as long as the audit that the result has as
one value; SHA-256 itself must see a conversation's bytes in order.

Nulls in any column count as one space; a null turn sorts first and is in no
gap.  Rows of one turn are ordered by role and then by the text's digest;
repeated rows are duplicates of the first.  Only the initials s, u and a can be
kept; an empty role has none.  Texts of any length are read whole.  A null
conv_id is a conversation.  An empty table gives no rows.  Columns other than
conv_id, turn, role and text are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import common

#: Costs of the edits, and of a truncated row that stays.
KEEP, REROLE, DELETE, INSERT, CUT = 0, 1, 2, 5, 5
#: Rows and bytes of text that a task holds of one conversation; rows of a piece of codes.
HELD_ROWS, HELD_BYTES, PIECE_ROWS = 4_096, 8_000_000, 65_536

START, SYSTEM, USER, ASSISTANT = range(4)
#: The role that must come next, and the names of roles given out.
NEXT, NAMES = (USER, USER, ASSISTANT, USER), ("", "system", "user", "assistant")
#: Codes: the initial's role (0: none of s, u, a), and flags for a row that must go, a truncated one, and one whose role and text were seen earlier.
MUST_GO, TRUNCATED, AGAIN = 4, 8, 16
FAR = 1 << 60


def after(state: int, role: int) -> int | None:
    """The state once a kept row of that role follows, None if it may not."""
    return role if role and (role == NEXT[state] or (role == SYSTEM and state == START)) else None


def suffix_bounds(codes: bytes) -> list[tuple[int, int, int, int]]:
    """The least that rows from each on can cost, for each last role."""
    now = (0, FAR, FAR, 0)
    bounds = [settle(now)]
    for code in reversed(codes):
        later, role, stay = bounds[-1], code & 3, CUT if code & TRUNCATED else 0
        now = []
        for state in range(4):
            least = DELETE + later[state]
            if not code & MUST_GO:
                least = min(least, REROLE + stay + later[NEXT[state]])
                if (to := after(state, role)) is not None:
                    least = min(least, KEEP + stay + later[to])
            now.append(least)
        bounds.append(settle(tuple(now)))
    return bounds[::-1]


def settle(least: tuple[int, int, int, int]) -> tuple[int, int, int, int]:
    """The same with empty turns inserted first where that costs less."""
    user, assistant = min(least[USER], INSERT + least[ASSISTANT]), min(least[ASSISTANT], INSERT + least[USER])
    return min(least[START], INSERT + user), min(least[SYSTEM], INSERT + user), user, assistant


def edits(code: int | None, state: int) -> Iterator[tuple[str, int, int, int]]:
    """Letter, rows taken, cost and next state of each edit, in ASCII order; code is None after the last row."""
    if code is not None:
        yield "D", 1, DELETE, state
    yield "I", 0, INSERT, NEXT[state]
    if code is not None and not code & MUST_GO:
        stay = CUT if code & TRUNCATED else 0
        if (to := after(state, code & 3)) is not None:
            yield "K", 1, KEEP + stay, to
        yield "R", 1, REROLE + stay, NEXT[state]


def repair(codes: bytes) -> tuple[int, str]:
    """Least cost, and the ASCII-least audit of that cost."""
    n, bounds = len(codes), suffix_bounds(codes)
    code_at = lambda row: codes[row] if row < n else None
    row, state, cost, dive = 0, START, 0, []
    while row < n or state not in (START, ASSISTANT):
        letter, taken, price, to = min(edits(code_at(row), state), key=lambda e: (e[2] + bounds[row + e[1]][e[3]], e[0]))
        row, state, cost = row + taken, to, cost + price
        dive.append(letter)
    incumbent, proved = (cost, "".join(dive)), bounds[0][START]
    reached: dict[int, int] = {}  # dominance: the least cost of each (row, state)
    stack, path = [(0, 0, START, 0, "")], []
    while stack:
        depth, row, state, cost, letter = stack.pop()
        if cost + bounds[row][state] > incumbent[0] or reached.get(row * 4 + state, FAR) <= cost:
            continue
        reached[row * 4 + state] = cost
        path[max(depth - 1, 0) :] = [letter] if depth else []
        if row == n and state in (START, ASSISTANT):
            incumbent = min(incumbent, (cost, "".join(path)))
            if incumbent[0] == proved:
                break
            continue
        stack += [(depth + 1, row + taken, to, cost + price, e) for e, taken, price, to in reversed(list(edits(code_at(row), state)))]
    return incumbent


def repaired_lines(audit: str, role_of: Callable[[int], str], text_of: Callable[[int], str], codes: bytes) -> Iterator[str]:
    """`role:text` of the repaired turns, in order."""
    row, state = 0, START
    for letter in audit:
        if letter == "I":
            state = NEXT[state]
            yield f"{NAMES[state]}:"
            continue
        if letter != "D":
            state = codes[row] & 3 if letter == "K" else NEXT[state]
            yield f"{role_of(row) if letter == 'K' else NAMES[state]}:{text_of(row)}"
        row += 1


def spaced(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit(" "))


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role and text after the damage; `dropped` rows stay in the table so that no conversation is lost."""
    fate = F.crc32(F.concat(spaced(F.col("conv_id")), F.lit(":"), spaced(F.col("turn"))).cast("binary")) % 20
    read = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), spaced(F.col("role")).alias("role"), spaced(F.col("text")).alias("text"), fate.alias("fate"))
    text = F.when(F.col("fate").isin(0, 1), "").when(F.col("fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("fate") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return read.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("fate") == 0).alias("dropped"), copies.alias("copy")).drop("copy")


def faults(rows: DataFrame) -> DataFrame:
    """The same with each row's digest and code; what is seen earlier is found by its order later."""
    white = " \t\n\x0b\x0c\r"
    bare = F.rtrim(F.col("text"), F.lit(white))
    initial = F.substring("role", 1, 1)
    code = F.when(initial == "s", SYSTEM).when(initial == "u", USER).when(initial == "a", ASSISTANT).otherwise(0)
    code = code + F.when(bare == "", MUST_GO).when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), TRUNCATED).otherwise(0)
    return rows.withColumns({"digest": F.unhex(F.sha2("text", 256)), "code": code.cast("byte")})


@dataclass
class Tally:
    """What is known of one conversation's rows in one task, in their order."""

    codes: bytearray = field(default_factory=bytearray)
    roles: list[str] = field(default_factory=list)
    texts: list[str] = field(default_factory=list)
    turns: list[int | None] = field(default_factory=list)
    seen: set[tuple[str, bytes]] = field(default_factory=set)
    held: int = 0

    def fresh(self, role: str, digest: bytes) -> bool:
        size = len(self.seen)
        self.seen.add((role, digest))
        return len(self.seen) > size


RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def resolved(marked: bytes) -> tuple[bytes, int]:
    """Codes by each row's first fault, and how many rows are duplicates: a blank one is none, and a duplicate must go."""
    repeats = [bool(code & AGAIN) and not code & MUST_GO for code in marked]
    return bytes(code & 3 | MUST_GO if again else code & 15 for code, again in zip(marked, repeats, strict=True)), sum(repeats)


def counts(codes: bytes, repeats: int) -> dict[str, int]:
    pairs = {(SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}
    gone = sum(1 for c in codes if c & MUST_GO)
    return {"blank": gone - repeats, "duplicate": repeats, "truncated": sum(1 for c in codes if c & TRUNCATED), "illegal": sum((a & 3, b & 3) not in pairs for a, b in zip(codes, codes[1:], strict=False))}


def settled(own: Tally) -> dict[str, object]:
    """A whole conversation's row."""
    codes, repeats = resolved(bytes(own.codes))
    cost, audit = repair(codes)
    lines = repaired_lines(audit, own.roles.__getitem__, own.texts.__getitem__, codes)
    turns = {t for t in own.turns if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return {"gaps": gaps, "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest()} | counts(codes, repeats)


def repaired(rows: DataFrame) -> DataFrame:
    """One row for each conversation: conv_id and RESULT."""
    conv = rows.schema["conv_id"].dataType
    marked = faults(damaged(rows)).withColumn("uid", F.monotonically_increasing_id())
    keys = ["conv_id", "turn", "role", "digest", "uid"]
    ordered = marked.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("uid")
    shape = T.StructType([T.StructField("conv_id", conv), *T.StructType.fromDDL(RESULT).fields, *T.StructType.fromDDL("part int, at long, turn long, role string, text string, digest binary, code byte, again boolean, dropped boolean").fields])
    found = common.materialize(ordered.mapInArrow(streamed(shape), shape), "conversations")
    result = ["conv_id", *T.StructType.fromDDL(RESULT).names]
    whole = found.where("part is null").select(*result)
    return whole.unionByName(spread(found.where("part is not null"), conv).select(*result))


def streamed(shape: T.StructType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Settles conversations that lie inside the task; passes the rows of others on, with their places."""
    schema = to_arrow_schema(shape)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        out: list[dict[str, object]] = []
        waiting: list[dict[str, object]] = []  # rows of the conversation at hand, until it is known to be whole
        own, conv, at, first, passing = Tally(), None, 0, True, True

        def end(last: bool) -> None:
            nonlocal own, waiting
            if last or passing:
                out.extend(waiting)
            else:
                out.append({"conv_id": conv} | settled(own))
            own, waiting = Tally(), []

        for batch in common.slices(batches):
            for row in batch.to_pylist():
                if first or row["conv_id"] != conv:
                    if not first:
                        end(False)
                        passing = False
                    conv, first = row["conv_id"], False
                again = not row["dropped"] and not own.fresh(row["role"], row["digest"])
                place = {n: row[n] for n in ("conv_id", "turn", "role", "text", "digest", "code", "dropped")} | {"part": part, "at": at, "again": again}
                at += 1
                own.held += len(row["text"]) + 100
                waiting.append(place)
                if not row["dropped"] and not passing:
                    own.codes.append(row["code"] | AGAIN * again)
                    own.roles.append(row["role"]), own.texts.append(row["text"]), own.turns.append(row["turn"])
                if not passing and (len(waiting) > HELD_ROWS or own.held > HELD_BYTES):
                    passing = True
                    own.codes, own.roles, own.texts, own.turns = bytearray(), [], [], []
                if passing:
                    out.extend(waiting)
                    waiting = []
                if len(out) >= 1_000 or own.held > HELD_BYTES:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out, own.held = [], 0
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
        if not first:
            end(True)
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    return run


def spread(rows: DataFrame, conv: T.DataType) -> DataFrame:
    """The result of conversations whose rows may lie in several tasks' parts."""
    rows = rows.select("conv_id", "part", "at", "turn", "role", "text", "digest", "code", "again", "dropped")
    # A digest's first row of each part is left, so that no group here has more rows than there are parts.
    firsts = rows.where("not dropped and not again").groupBy("conv_id", "role", "digest").agg(F.sort_array(F.collect_list("part")).alias("parts")).where("size(parts) > 1")
    later = firsts.select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), F.explode(F.slice("parts", F.lit(2), F.size("parts"))).alias("p"))
    compact = rows.select("conv_id", "part", "at", "turn", "role", "digest", "code", "again", "dropped").where("not dropped")
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d"))
    late = compact.where("not again").join(later, same, "left_semi").select("part", "at", F.lit(True).alias("late"))
    named = compact.drop("role", "digest").join(late, ["part", "at"], "left")
    again = F.when(F.col("again") | F.coalesce("late", F.lit(False)), AGAIN).otherwise(0)
    coded = named.select("conv_id", "part", "at", "turn", (F.col("code").cast("int") + again).alias("code"), F.expr(f"at div {PIECE_ROWS}").alias("piece"))
    pieces = coded.groupBy("conv_id", "part", "piece").agg(F.sort_array(F.collect_list(F.struct("at", "code"))).alias("c")).select("conv_id", "part", "piece", F.col("c.at").alias("at"), F.col("c.code").alias("code"))
    fields = "part int, at long, line string, before array<string>, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
    shape = T.StructType([T.StructField("conv_id", conv), *T.StructType.fromDDL(fields).fields])
    steps = common.materialize(pieces.groupBy("conv_id").applyInArrow(solver(shape), shape), "edits")
    turns = coded.where("turn is not null").groupBy("conv_id", "turn").agg(F.lit(1)).groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count("*")).alias("gaps"))
    # Each row's own lines: turns inserted before it, and the row itself unless it is deleted.
    placed = rows.select("conv_id", "part", "at", "role", "text").join(steps.where("part is not null").select("part", "at", "line", "before"), ["part", "at"])
    kept = F.when(F.col("line") == "K", F.concat("role", F.lit(":"), "text")).when(F.col("line") != "D", F.concat("line", F.lit(":"), "text"))
    tail = steps.where("part is null").select("conv_id", F.lit(2**31 - 1).alias("part"), F.lit(0).cast("long").alias("at"), "before", F.lit(None).cast("string").alias("own"))
    lines = placed.select("conv_id", "part", "at", "before", kept.alias("own")).unionByName(tail)
    hash_shape = T.StructType([T.StructField("conv_id", conv), T.StructField("repaired_sha256", T.StringType())])
    hashes = lines.repartition("conv_id").sortWithinPartitions("conv_id", "part", "at").select("conv_id", "before", "own").mapInArrow(hasher(hash_shape), hash_shape)
    result = rows.select("conv_id").distinct()
    for other in (steps.where("part is null").drop("part", "at", "line", "before"), turns, hashes):
        other = other.withColumnRenamed("conv_id", "other_id")
        result = result.join(other, F.col("conv_id").eqNullSafe(F.col("other_id")), "left").drop("other_id")
    zero = {n: F.coalesce(n, F.lit(0).cast("long")) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    return result.withColumns(zero | {"audit": F.coalesce("audit", F.lit("")), "repaired_sha256": F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest()))})


def solver(shape: T.StructType) -> Callable[[pa.Table], pa.Table]:
    """From one conversation's pieces of codes: each row's edit, and a row for the whole with what is inserted at the end."""
    schema = to_arrow_schema(shape)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("part", "ascending"), ("piece", "ascending")]).combine_chunks()
        at, marked = (table.column(n).combine_chunks().flatten().to_numpy(zero_copy_only=False) for n in ("at", "code"))
        part = np.repeat(table.column("part").to_numpy(), np.diff(np.asarray(table.column("at").combine_chunks().offsets)))
        codes, repeats = resolved(marked.astype(np.uint8).tobytes())
        cost, audit = repair(codes)
        lines, before, inserted, state = [], [], [], START
        for letter in audit:
            if letter != "D":
                state = codes[len(lines)] & 3 if letter == "K" else NEXT[state]
            if letter == "I":
                inserted.append(NAMES[state])
            else:
                lines.append(NAMES[state] if letter == "R" else letter)
                before.append(inserted)
                inserted = []
        n, conv = len(lines), table.column("conv_id")[0].as_py()
        whole = {"conv_id": conv, "before": inserted, "cost": cost, "audit": audit} | counts(codes, repeats)
        own = {"conv_id": pa.array([conv] * n, schema.field("conv_id").type), "part": pa.array(part, pa.int32()), "at": pa.array(at, pa.int64()), "line": pa.array(lines, pa.string()), "before": pa.array(before, pa.list_(pa.string()))}
        edited = pa.table([own.get(f.name, pa.nulls(n, f.type)) for f in schema], schema=schema)
        return pa.concat_tables([edited, pa.Table.from_pylist([whole], schema)])

    return run


def hasher(shape: T.StructType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """SHA-256 of each conversation's lines, from rows in order; holds one row at a time."""
    schema = to_arrow_schema(shape)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, digest, empty = None, None, True
        for batch in common.slices(batches, "own"):
            for row in batch.to_pylist():
                if digest is not None and row["conv_id"] != conv:
                    yield pa.RecordBatch.from_pylist([{"conv_id": conv, "repaired_sha256": digest.hexdigest()}], schema)
                    digest = None
                if digest is None:
                    conv, digest, empty = row["conv_id"], hashlib.sha256(), True
                for line in [f"{name}:" for name in row["before"]] + ([row["own"]] if row["own"] is not None else []):
                    digest.update(("" if empty else "\n").encode() + line.encode())
                    empty = False
        if digest is not None:
            yield pa.RecordBatch.from_pylist([{"conv_id": conv, "repaired_sha256": digest.hexdigest()}], schema)

    return run


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


#: The same results by another way: the best prefix for each row and last role, in a recursion over all conversations at once.
ORACLE = {
    "op12_conversation_repair": """
with recursive hashed as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
    xor(list_reduce(list_concat([4294967295::bigint], [ascii(x)::bigint for x in string_split(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '), '')]),
      lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda p, q: xor(p >> 1, case when p & 1 = 1 then 3988292384::bigint else 0::bigint end))), 4294967295::bigint) % 20 as fate
  from conversations),
damaged as (
  select conv_id, turn, case when fate = 4 then 'user' else role end as role,
    case when fate = 1 then '' when fate = 2 then translate(text, '.!?', '') else text end as text, unnest(case when fate = 3 then [1, 2] else [1] end) as copy
  from hashed where fate <> 0),
placed as (select *, row_number() over (partition by conv_id order by turn nulls first, role, sha256(text), copy) as i, trim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as bare from damaged),
seen as (select *, row_number() over (partition by conv_id, role, text order by i) > 1 as again from placed),
faulty as (select *, case when bare = '' then 'blank' when again then 'duplicate' when right(bare, 1) not in ('.', '!', '?') then 'truncated' else '' end as fault,
  case left(role, 1) when 's' then 1 when 'u' then 2 when 'a' then 3 else 0 end as kind,
  left(role, 1) as initial, lag(left(role, 1)) over (partition by conv_id order by i) as initial_before from seen),
counted as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0)::bigint as gaps, count(*) filter (fault = 'blank')::bigint as blank, count(*) filter (fault = 'duplicate')::bigint as duplicate,
  count(*) filter (fault = 'truncated')::bigint as truncated, count(*) filter (initial_before is not null and initial_before || initial not in ('su', 'ua', 'au'))::bigint as illegal, count(*) as n from faulty group by conv_id),
following(state, next) as (values (0, 2), (1, 2), (2, 3), (3, 2)),
inserting as (select state, state as to_state, 0 as cost, '' as letters from following union all select state, next, 5, 'I' from following
  union all select a.state, b.next, 10, 'II' from following a join following b on a.next = b.state),
best as (
  select conv_id, 0::bigint as i, 0 as state, {'cost': 0, 'audit': ''} as found from counted
  union all
  select b.conv_id, b.i + 1, e.to_state, min({'cost': b.found.cost + s.cost + e.cost, 'audit': b.found.audit || s.letters || e.letter})
  from best b join inserting s on s.state = b.state join faulty r on r.conv_id is not distinct from b.conv_id and r.i = b.i + 1
  join following f on f.state = s.to_state,
  lateral (select 'D' as letter, 2 as cost, s.to_state as to_state
    union all select 'R', 1 + case when r.fault = 'truncated' then 5 else 0 end, f.next where r.fault not in ('blank', 'duplicate')
    union all select 'K', case when r.fault = 'truncated' then 5 else 0 end, r.kind where r.fault not in ('blank', 'duplicate') and (r.kind = f.next or (r.kind = 1 and s.to_state = 0))) e
  group by b.conv_id, b.i, e.to_state),
ended as (select c.conv_id, min({'cost': b.found.cost + s.cost, 'audit': b.found.audit || s.letters}) as found
  from best b join counted c on c.conv_id is not distinct from b.conv_id and c.n = b.i join inserting s on s.state = b.state where s.to_state in (0, 3) group by c.conv_id),
letters as (select conv_id, pos, substr(found.audit, pos, 1) as letter from ended, unnest(range(1, length(found.audit) + 1)) as t(pos)),
numbered as (select *, sum((letter <> 'I')::int) over w as i, sum((letter <> 'D')::int) over w as place from letters window w as (partition by conv_id order by pos)),
turned as (select n.*, r.role, r.text, max(case when n.place = 1 and n.letter = 'K' and r.kind = 1 then 1 else 0 end) over (partition by n.conv_id) as system
  from numbered n left join faulty r on r.conv_id is not distinct from n.conv_id and r.i = n.i),
written as (select conv_id, string_agg(case when letter = 'K' then role when (place - system) % 2 = 1 then 'user' else 'assistant' end || ':' || case when letter = 'I' then '' else text end, chr(10) order by pos) as lines
  from turned where letter <> 'D' group by conv_id)
select o.conv_id, coalesce(c.gaps, 0) as gaps, coalesce(c.blank, 0) as blank, coalesce(c.duplicate, 0) as duplicate, coalesce(c.truncated, 0) as truncated, coalesce(c.illegal, 0) as illegal,
  coalesce(e.found.cost, 0)::bigint as cost, coalesce(e.found.audit, '') as audit, sha256(coalesce(w.lines, '')) as repaired_sha256
from (select distinct conv_id from conversations) o left join counted c on c.conv_id is not distinct from o.conv_id
left join ended e on e.conv_id is not distinct from o.conv_id left join written w on w.conv_id is not distinct from o.conv_id
"""
}
