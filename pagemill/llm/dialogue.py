"""Conversation structure repair: least-cost edits by a Viterbi search made parallel through rank convergence.

A conversation's rows, in order of their turns, become role initials ``(s?(ua)+)?`` by edits: keep (0), rerole to
user or assistant (1), delete (2), insert an empty user or assistant row (5); an undeleted truncated row costs 5 more,
blank and duplicate rows must go. The search runs backwards over four states (nothing yet, after system, after user,
after assistant); a step is a min-plus product with the vector of the least costs from there to the end.

Rows are dealt into ranges of (conversation, turn) and cut into chunks of bounded rows and bytes; a conversation that
lies in one chunk is repaired there. Longer ones, and those at the edges of ranges, are solved chunk by chunk in
parallel: every chunk starts from a speculative cost vector, that of a conversation ending there. A fix-up pass hands
each chunk the vector that the next one came to; chunks rerun until what they are handed differs only by a
constant from what they used (vectors are kept less their least entry, so it differs by nothing). Each pass joins chunks into
runs twice as long, gone through one after the other in one task as a stream, so that passes are at most the
logarithm of the chunks even where vectors never converge. Constants don't matter to the tracing forwards, which goes along the least costs and
takes the ASCII-least edit where several cost the same; it starts from speculative states and is fixed up in the same way.

``repair`` returns pieces: one for a conversation, several in order for one of several chunks; ``digest`` folds them
into a row for each conversation, as a stream in order.

Defined results: a null role or text counts as one space; null turns come first; rows of one turn come by role, then by the hash of
role and text (equal rows are alike in any order); null conversation ids are one conversation; an empty
table gives an empty result; extra columns are left out. A conversation without rows that exist has no piece; ``digest`` gives
it zeros, an empty audit and the hash of nothing.
"""

from __future__ import annotations

import hashlib
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Memo, Stored, cut, lean, prepare

#: Rows and bytes of text of a chunk (one row at least).
CHUNK_ROWS, CHUNK_BYTES = 1024, 4 << 20
SPACE = " \t\n\x0b\x0c\r"

#: States, by what was put out last, and costs of the edits and of a truncated row that stays.
START, SYSTEM, USER, ASSISTANT = range(4)
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: The state after a user or assistant row in each state (which of the two may follow is given).
NEXT = (USER, USER, ASSISTANT, USER)
NAMES = {USER: "user", ASSISTANT: "assistant"}
#: A row's symbol: the class of its initial and whether it is truncated; or that it must go.
CLASSES, MUST_GO = "sua", "8"


def kept_state(state: int, kind: int) -> int | None:
    """The state after keeping a row of class ``kind``; none if it can't follow."""
    if kind == 0:
        return SYSTEM if state == START else None
    return NEXT[state] if NEXT[state] == (None, USER, ASSISTANT, None)[kind] else None


def closed(raw: list[float]) -> tuple:
    """Least costs with insertions, less the least of them."""
    user, assistant = min(raw[USER], INSERT + raw[ASSISTANT]), min(raw[ASSISTANT], INSERT + raw[USER])
    costs = (min(raw[START], INSERT + user), min(raw[SYSTEM], INSERT + user), user, assistant)
    least = min(costs)
    return tuple(int(c - least) for c in costs)


END = closed([0, float("inf"), float("inf"), 0])


def edits(after: tuple, symbol: str, state: int) -> list[tuple[str, int, int]]:
    """What can be done with a row, in ASCII order: (initial, cost, state after it)."""
    out = [("D", DELETE, state)]
    if symbol != MUST_GO:
        kind, extra = int(symbol) // 2, int(symbol) % 2 * TRUNCATED
        if (to := kept_state(state, kind)) is not None:
            out.append(("K", extra, to))
        out.append(("R", REROLE + extra, NEXT[state]))
    return out


def before(after: tuple, symbol: str) -> tuple:
    """The step backwards over one row."""
    return closed([min(cost + after[to] for _, cost, to in edits(after, symbol, s)) for s in range(4)])


def choice(after: tuple, symbol: str, state: int) -> tuple[str, int, int]:
    """The ASCII-least cheapest edits up to and with one row: (initials, cost, state)."""
    raw = [min(cost + after[to] for _, cost, to in edits(after, symbol, s)) for s in range(4)]
    user, assistant = min(raw[USER], INSERT + raw[ASSISTANT]), min(raw[ASSISTANT], INSERT + raw[USER])
    best = [min(raw[START], INSERT + user), min(raw[SYSTEM], INSERT + user), user, assistant]
    audit, total = "", 0
    while True:
        options = edits(after, symbol, state)
        options.insert(1, ("I", INSERT, -1))  # D < I < K < R
        for initial, cost, to in options:
            if best[state] == cost + (best[NEXT[state]] if initial == "I" else after[to]):
                break
        audit, total = audit + initial, total + cost
        if initial != "I":
            return audit, total, to
        state = NEXT[state]


class Search:
    """Both directions over a chunk's symbols; steps are remembered, as there are few vectors."""

    def __init__(self):
        self.back = Memo(lambda k: before(*k))
        self.forth = Memo(lambda k: choice(*k))

    def vectors(self, symbols: str, end: tuple) -> list[tuple]:
        """The vector before each row and ``end`` after the last."""
        out = [end]
        for s in reversed(symbols):
            out.append(self.back[out[-1], s])
        out.reverse()
        return out

    def trace(self, symbols: str, end: tuple, state: int, final: bool) -> tuple[str, int, int]:
        """(audit, cost, state after it) from ``state``; what is still missing is inserted at the end of a conversation."""
        parts, total = [], 0
        for s, after in zip(symbols, self.vectors(symbols, end)[1:], strict=True):
            audit, cost, state = self.forth[after, s, state]
            parts.append(audit)
            total += cost
        while final and state in (SYSTEM, USER):
            parts.append("I")
            total, state = total + INSERT, NEXT[state]
        return "".join(parts), total, state


def symbols_of(roles: list[str], faults: list[int], first: list[bool]) -> str:
    out = []
    for role, fault, new in zip(roles, faults, first, strict=True):
        out.append(MUST_GO if fault == 1 or not new else str((CLASSES.find(role[:1]) if role else -1) % 4 * 2 + (fault == 2)))
    return "".join(out)


def repaired(audit: str, state: int, roles: list[str], texts: list[str]) -> list[dict]:
    """The rows that ``audit`` leads to from ``state``."""
    out, row = [], 0
    for edit in audit:
        role = text = None
        if edit != "I":
            role, text = roles[row], texts[row]
            row += 1
        if edit == "D":
            continue
        to = kept_state(state, CLASSES.find(role[:1])) if edit == "K" else NEXT[state]
        out.append({"role": role if edit == "K" else NAMES[to], "text": text or ""})
        state = to
    return out


def _pieces(columns: dict, lo: int, hi: int, size: np.ndarray):
    """Cuts of rows ``lo`` to ``hi`` at the bounds of a chunk; ``size``: bytes of text before each row."""
    while lo < hi:
        to = min(hi, lo + CHUNK_ROWS, max(lo + 1, int(np.searchsorted(size, size[lo] + CHUNK_BYTES, "right")) - 1))
        yield lo, to
        lo = to


COLUMNS = ("turn", "role", "text", "fault", "digest")


def _chunks(batches):
    """Sorted rows as chunks: ``number`` counts a partition's chunks that may not be a whole conversation, else it is -1."""
    from pyspark import TaskContext

    part, number, first, opened, held = TaskContext.get().partitionId(), 0, True, False, None
    for batch in chain(batches, [None]):
        if batch is not None and not batch.num_rows:
            continue
        some = [x for x in (held, batch) if x is not None]
        if not some:
            return
        rows = pa.Table.from_batches(some).combine_chunks().to_batches()[0]
        key = rows.column(0)
        a, b = key[:-1], key[1:]
        same = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b)))
        edges = [0, *(np.flatnonzero(~same.to_numpy(zero_copy_only=False)) + 1).tolist(), rows.num_rows]
        size = np.concatenate([[0], np.cumsum(pc.binary_length(rows.column(3)).to_numpy(zero_copy_only=False))])
        cuts, numbers, held = [], [], None
        for at, (lo, hi) in enumerate(pairwise(edges)):
            last = at + 2 == len(edges)
            pieces = list(_pieces(rows, lo, hi, size))
            if last and batch is not None:
                held = rows.slice(pieces[-1][0])
                opened_before, pieces = opened, pieces[:-1]
                opened = opened_before or bool(pieces)
            whole = not (first or opened or last or len(pieces) > 1)
            for piece in pieces:
                cuts.append(piece)
                numbers.append(-1 if whole else number)
                number += not whole
            if not last:
                first = opened = False
        if cuts:
            lists = pa.array([lo for lo, _ in cuts] + [cuts[-1][1]], pa.int32())
            nested = [pa.ListArray.from_arrays(lists, rows.column(i + 1)) for i in range(len(COLUMNS))]
            heads = [key.take(lists[:-1]), pa.array([part] * len(cuts), pa.int32()), pa.array(numbers, pa.int64())]
            yield pa.RecordBatch.from_arrays([*heads, *nested], names=["key", "part", "number", *COLUMNS])


PIECE = ("alone boolean, piece long, first_turn long, last_turn long, turns long, first_initial string, last_initial string, blank long, duplicate long, "
         "truncated long, illegal long, cost long, audit string, repaired array<struct<role:string,text:string>>")
LEGAL = {"su", "ua", "au"}


def _finish(batches):
    """Chunks as pieces; ``firsts`` (row numbers that are no duplicates), ``end`` and ``state`` are null for whole conversations."""
    search = Search()
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            roles, faults = r["role"], r["fault"]
            if r["piece"] is None:
                seen, first = set(), []
                for d in r["digest"]:
                    first.append(d not in seen)
                    seen.add(d)
            else:
                new = set(r["firsts"] or ())
                first = [i in new for i in range(len(roles))]
            symbols = symbols_of(roles, faults, first)
            state = START if r["state"] is None else int(r["state"])
            audit, cost, _ = search.trace(symbols, END if r["end"] is None else _vector(r["end"]), state, not r["goes_on"])
            turns = [t for t in r["turn"] if t is not None]
            initials = [x[:1] for x in roles]
            blank, again = faults.count(1), sum(not new and f != 1 for f, new in zip(faults, first, strict=True))
            out.append({
                "key": r["key"], "alone": r["alone"], "piece": r["piece"] or 0, "first_turn": turns[0] if turns else None, "last_turn": turns[-1] if turns else None,
                "turns": len(set(turns)), "first_initial": initials[0], "last_initial": initials[-1], "blank": blank, "duplicate": again,
                "truncated": sum(f == 2 and new for f, new in zip(faults, first, strict=True)),
                "illegal": sum(a + b not in LEGAL for a, b in pairwise(initials)), "cost": cost, "audit": audit,
                "repaired": repaired(audit, state, roles, r["text"])})
        yield pa.RecordBatch.from_pylist(out, schema=_piece_schema(batch.schema.field("key").type))


def _piece_schema(key: pa.DataType) -> pa.Schema:
    long, text = pa.int64(), pa.string()
    kinds = {"alone": pa.bool_(), "first_initial": text, "last_initial": text, "audit": text, "repaired": pa.list_(pa.struct([("role", text), ("text", text)]))}
    names = [x.split(" ")[0] for x in PIECE.split(", ")]
    return pa.schema([("key", key), *((n, kinds.get(n, long)) for n in names)])


def _vector(text: str) -> tuple:
    return tuple(map(int, text.split(",")))


def settle(chunks: DataFrame, step, backwards: bool, edge: str, guess: str) -> DataFrame:
    """(g, used, gave) of every chunk, when each has used what its neighbour gave.

    ``step(row, value)`` takes a chunk from the value handed to it to the value that it hands on; ``linked`` says whether
    it has a neighbour that does (chunk g + 1 if ``backwards``, else g - 1); without one it gets ``edge``, at first ``guess``.
    """
    linked = F.col("goes_on" if backwards else "went_on")
    to, done, power = (-1 if backwards else 1), None, 0

    def sweep(batches):
        at = value = None
        for batch in batches:
            used, gave = [], []
            for r in batch.to_pylist():
                following = at is not None and r["linked"] and at[0] == r["unit"] and r["g"] - at[1] == to
                used.append(value if following else r["came"])
                value, at = step(r, used[-1]), (r["unit"], r["g"])
                gave.append(value)
            yield pa.RecordBatch.from_arrays([batch.column("g"), pa.array(used, pa.string()), pa.array(gave, pa.string())], names=["g", "used", "gave"])

    while True:
        rows = chunks.withColumn("linked", linked)
        if done is None:
            rows = rows.withColumn("came", F.when(linked, F.lit(guess)).otherwise(F.lit(edge)))
        else:
            came = done.select((F.col("g") + to).alias("g"), F.col("gave").alias("came"))
            rows = rows.join(came, "g", "left").withColumn("came", F.when(linked, F.col("came")).otherwise(F.lit(edge)))
        rows = rows.withColumn("unit", F.expr(f"shiftright(g, {power})"))
        rows = rows.repartition("unit").sortWithinPartitions("unit", F.desc("g") if backwards else F.asc("g"))
        done = cut(rows.mapInArrow(sweep, "g long, used string, gave string"))
        came = done.select((F.col("g") + to).alias("g"), F.col("gave").alias("came"))
        off = chunks.where(linked).select("g").join(done, "g").join(came, "g").where(F.col("used") != F.col("came"))
        if off.isEmpty():
            return done
        power += 1


def _back(search: Search):
    return lambda row, end: ",".join(map(str, search.vectors(row["symbols"], _vector(end))[0]))


def _forth(search: Search):
    return lambda row, state: str(search.trace(row["symbols"], _vector(row["end"]), int(state), False)[2])


def repair(rows: DataFrame, *, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", exists: Column | None = None) -> DataFrame:
    """Pieces of repaired conversations: ``key`` and ``PIECE``; rows where ``exists`` is not true are left out."""
    spark = prepare(rows.sparkSession)
    if exists is not None:
        rows = rows.where(exists)
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = rows.select(F.col(key).alias("key"), F.col(turn).cast("long").alias("turn"), one(role).alias("role"), one(text).alias("text"))
    body = F.rtrim(F.col("text"), F.lit(SPACE))
    fault = F.when(body == "", 1).when(F.substring(body, -1, 1).isin(".", "!", "?"), 0).otherwise(2)
    digest = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256))
    rows = rows.select("*", fault.cast("tinyint").alias("fault"), digest.alias("digest"), F.monotonically_increasing_id().alias("__row"))
    order = [F.asc_nulls_first(c) for c in ("key", "turn", "role", "digest", "__row")]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("key", *COLUMNS)
    lists = T.StructType([rows.schema["key"], T.StructField("part", T.IntegerType()), T.StructField("number", T.LongType()),
                          *(T.StructField(c, T.ArrayType(rows.schema[c].dataType)) for c in COLUMNS)])
    stored = Stored(rows.mapInArrow(lean(_chunks), lists)).read()

    # chunks at the edges of partitions and of long conversations, numbered on by prefix sums over the partitions
    base, total = [], 0
    for r in stored.where("number >= 0").groupBy("part").agg(F.max("number").alias("n")).orderBy("part").collect():
        base.append((r.part, total))
        total += r.n + 1
    some = stored.where("number >= 0").join(F.broadcast(spark.createDataFrame(base, "part int, base long")), "part")
    some = some.withColumn("g", F.col("base") + F.col("number")).drop("part", "number", "base")
    keys = cut(some.select("g", "key", "role", "fault", "digest"))
    there = keys.select("g", "key")
    for name, by in (("goes_on", -1), ("went_on", 1)):
        other = keys.select((F.col("g") + by).alias("g"), F.col("key").alias("k"), F.lit(True).alias("has"))
        there = there.join(other, "g", "left").withColumn(name, F.coalesce(F.col("has") & F.col("key").eqNullSafe(F.col("k")), F.lit(False))).drop("k", "has")
    each = keys.select("g", "key", F.posexplode("digest").alias("i", "d"))
    firsts = each.groupBy("key", "d").agg(F.min(F.struct("g", "i")).alias("at")).select("at.*").groupBy("g").agg(F.collect_list("i").alias("firsts"))
    known = keys.join(there.drop("key"), "g").join(firsts, "g", "left")

    def coded(batches):
        for batch in batches:
            made = []
            for r in batch.to_pylist():
                new = set(r["firsts"] or ())
                made.append(symbols_of(r["role"], r["fault"], [i in new for i in range(len(r["role"]))]))
            yield pa.RecordBatch.from_arrays([batch.column("g"), pa.array(made, pa.string()), batch.column("goes_on"), batch.column("went_on"), batch.column("firsts")],
                                             names=["g", "symbols", "goes_on", "went_on", "firsts"])

    chunks = cut(known.select("g", "role", "fault", "goes_on", "went_on", "firsts")
                 .mapInArrow(coded, "g long, symbols string, goes_on boolean, went_on boolean, firsts array<int>"))
    search, end = Search(), ",".join(map(str, END))
    ends = settle(chunks, _back(search), True, end, end)
    chunks = chunks.join(ends.select("g", F.col("used").alias("end")), "g")
    states = settle(chunks, _forth(search), False, str(START), str(ASSISTANT))
    facts = chunks.join(states.select("g", F.col("used").alias("state")), "g")
    some = some.join(facts.select("g", "goes_on", "went_on", "firsts", "end", "state"), "g")
    some = some.withColumn("alone", ~(F.col("goes_on") | F.col("went_on"))).withColumnRenamed("g", "piece")
    whole = stored.where("number < 0").drop("part", "number")
    names = ["key", *COLUMNS, "piece", "goes_on", "firsts", "end", "state", "alone"]
    none = {"piece": "CAST(NULL AS long)", "goes_on": "false", "firsts": "CAST(NULL AS array<int>)", "end": "CAST(NULL AS string)", "state": "CAST(NULL AS string)", "alone": "true"}
    whole = whole.selectExpr("key", *COLUMNS, *(f"{v} AS {k}" for k, v in none.items()))
    out = T.StructType([rows.schema["key"], *T.StructType.fromDDL(PIECE).fields])
    pieces = whole.mapInArrow(lean(_finish), out).unionByName(some.select(*names).mapInArrow(lean(_finish), out))
    return pieces.withColumnRenamed("key", key)


DIGEST = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
COUNTS = ("blank", "duplicate", "truncated", "illegal", "cost")


def _fold(batches):
    """Pieces in order as rows of conversations: what is kept of one is its counts, its audit and a running hash."""
    now = None
    for batch in chain(batches, [None]):
        done = []
        for r in [None] if batch is None else batch.to_pylist():
            if now is not None and (r is None or r["alone"] or r["key"] != now["key"] or r["piece"] != now["piece"] + 1):
                gaps = 0 if now["first_turn"] is None else now["last_turn"] - now["first_turn"] + 1 - now["turns"]
                done.append({"key": now["key"], "gaps": gaps, **{c: now[c] for c in COUNTS}, "audit": "".join(now["audits"]), "repaired_sha256": now["hash"].hexdigest()})
                now = None
            if r is None:
                continue
            data = "\n".join(f"{x['role']}:{x['text']}" for x in r["repaired"]).encode()
            if now is None:
                now = r | {"audits": [], "hash": hashlib.sha256(), "rows": 0}
            else:
                for c in COUNTS:
                    now[c] += r[c]
                now["illegal"] += now["last_initial"] + r["first_initial"] not in LEGAL
                now["turns"] += r["turns"] - (r["turns"] > 0 and r["first_turn"] == now["last_turn"])
                now["first_turn"] = r["first_turn"] if now["first_turn"] is None else now["first_turn"]
                now["last_turn"] = now["last_turn"] if r["last_turn"] is None else r["last_turn"]
                now["last_initial"], now["piece"] = r["last_initial"], r["piece"]
            if r["repaired"]:
                now["hash"].update(b"\n" + data if now["rows"] else data)
                now["rows"] += len(r["repaired"])
            now["audits"].append(r["audit"])
        if done:
            yield done


def digest(pieces: DataFrame, conversations: DataFrame | None = None, *, key: str = "conv_id") -> DataFrame:
    """A row for each conversation of ``pieces``; and for each other one of ``conversations`` (column ``key``)."""
    rows = pieces.withColumnRenamed(key, "key")
    schema = T.StructType([rows.schema["key"], *T.StructType.fromDDL(DIGEST).fields])
    kind = rows.schema["key"].dataType
    names = [f.name for f in schema]

    def fold(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        types = [to_arrow_type(kind), *[pa.int64()] * 6, pa.string(), pa.string()]
        for done in _fold(batches):
            yield pa.RecordBatch.from_pylist(done, schema=pa.schema(list(zip(names, types, strict=True))))

    several = rows.where("NOT alone").repartition("key").sortWithinPartitions("key", "piece")
    out = rows.where("alone").mapInArrow(lean(fold), schema).unionByName(several.mapInArrow(lean(fold), schema))
    if conversations is not None:
        zero = [F.lit(0).cast("long").alias(c) for c in ("gaps", *COUNTS)]
        lost = conversations.select(F.col(key).alias("key"), *zero, F.lit("").alias("audit"), F.lit(hashlib.sha256().hexdigest()).alias("repaired_sha256"))
        out = out.unionByName(lost)
    return out.withColumnRenamed("key", key)


def damage(rows: DataFrame) -> DataFrame:
    """``conversations`` with faults by a hash of the row: ``there`` is false for rows that are dropped."""
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(one("conv_id"), F.lit(":"), one("turn")).cast("binary")) % 20
    rows = rows.select("conv_id", "turn", one("role").alias("role"), one("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
                       (F.col("kind") != 0).alias("there"), copies)


def repaired_digest(conversations: DataFrame) -> DataFrame:
    """The digest of damaged and repaired ``conversations``, one row for every id."""
    rows = damage(conversations)
    absent = rows.groupBy("conv_id").agg(F.max("there").alias("any")).where(~F.col("any"))
    return digest(repair(rows, exists=F.col("there")), absent)


#: crc32 by its table of 256 remainders; bytes are those of digits, a sign, a colon and a space.
ORACLE = r"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0],
           lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
given AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
dealt AS (
  SELECT given.*, xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split(k, ''), lambda x: CAST(ascii(x) AS BIGINT))),
           lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS d FROM given, crc),
damaged AS (
  SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role,
         CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM dealt, unnest(range(CASE WHEN d = 3 THEN 2 ELSE 1 END)) AS c(copy) WHERE d <> 0),
placed AS (
  SELECT *, row_number() OVER w AS i,
         lag(left(role, 1)) OVER w || left(role, 1) AS pair,
         rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body
  FROM damaged WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
counted AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS again FROM placed),
marked AS (
  SELECT *, body = '' AS blank, body <> '' AND again > 1 AS duplicate,
         body <> '' AND again = 1 AND right(body, 1) NOT IN ('.', '!', '?') AS truncated, left(role, 1) AS r FROM counted),
sums AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         sum(blank::INT) AS blank, sum(duplicate::INT) AS duplicate, sum(truncated::INT) AS truncated,
         sum((pair NOT IN ('su', 'ua', 'au'))::INT) AS illegal
  FROM marked GROUP BY conv_id),
-- b: least costs from before row i, by what was put out last (nothing, system, user, assistant)
back AS (
  SELECT conv_id, n + 1 AS i, [0, 10, 5, 0] AS b FROM sums
  UNION ALL
  SELECT conv_id, i, [least(w[1], 5 + u), least(w[2], 5 + u), u, least(w[4], 5 + w[3])]
  FROM (SELECT *, least(w[3], 5 + w[4]) AS u FROM (
    SELECT m.conv_id, m.i, CASE WHEN blank OR duplicate THEN list_transform(b, lambda x: x + 2) ELSE
      [least(2 + b[1], e + b[3] + (r <> 'u')::INT, CASE WHEN r = 's' THEN e + b[2] ELSE 1e9::BIGINT END),
       least(2 + b[2], e + b[3] + (r <> 'u')::INT), least(2 + b[3], e + b[4] + (r <> 'a')::INT), least(2 + b[4], e + b[3] + (r <> 'u')::INT)] END AS w
    FROM (SELECT *, 5 * truncated::INT AS e FROM marked) AS m JOIN back ON back.i = m.i + 1 AND back.conv_id IS NOT DISTINCT FROM m.conv_id))),
walk AS (
  SELECT conv_id, 1::BIGINT AS i, 1 AS s, '' AS audit, []::VARCHAR[] AS out, 0::BIGINT AS cost FROM sums
  UNION ALL
  SELECT conv_id, i + (edit <> 'I')::INT, CASE edit WHEN 'D' THEN s WHEN 'K' THEN CASE WHEN r = 's' THEN 2 ELSE nx END ELSE nx END,
         audit || edit, CASE WHEN edit = 'D' THEN out ELSE list_append(out, CASE WHEN edit = 'K' THEN role WHEN nx = 3 THEN 'user' ELSE 'assistant' END
                                                              || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END) END,
         cost + CASE edit WHEN 'D' THEN 2 WHEN 'I' THEN 5 ELSE (edit = 'R')::INT + 5 * truncated::INT END
  FROM (
    SELECT v.*, m.role, m.text, m.r, m.truncated, CASE WHEN v.s = 3 THEN 4 ELSE 3 END AS nx,
           CASE WHEN m.i IS NULL THEN 'I' WHEN 2 + bn.b[v.s] = bi.b[v.s] THEN 'D' WHEN 5 + bi.b[CASE WHEN v.s = 3 THEN 4 ELSE 3 END] = bi.b[v.s] THEN 'I'
                WHEN (v.s = 1 AND m.r = 's' AND 5 * m.truncated::INT + bn.b[2] = bi.b[1])
                  OR (m.r = CASE WHEN v.s = 3 THEN 'a' ELSE 'u' END AND 5 * m.truncated::INT + bn.b[CASE WHEN v.s = 3 THEN 4 ELSE 3 END] = bi.b[v.s]) THEN 'K'
                ELSE 'R' END AS edit
    FROM walk AS v JOIN back AS bi ON bi.i = v.i AND bi.conv_id IS NOT DISTINCT FROM v.conv_id
    LEFT JOIN back AS bn ON bn.i = v.i + 1 AND bn.conv_id IS NOT DISTINCT FROM v.conv_id
    LEFT JOIN marked AS m ON m.i = v.i AND m.conv_id IS NOT DISTINCT FROM v.conv_id
    WHERE m.i IS NOT NULL OR v.s IN (2, 3))),
ends AS (SELECT w.* FROM walk AS w JOIN sums USING (conv_id) WHERE w.i = n + 1 AND s IN (1, 4)
         UNION ALL SELECT w.* FROM walk AS w, sums WHERE w.conv_id IS NULL AND sums.conv_id IS NULL AND w.i = n + 1 AND s IN (1, 4))
SELECT g.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost,
       coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(out, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) AS g
LEFT JOIN sums ON sums.conv_id IS NOT DISTINCT FROM g.conv_id LEFT JOIN ends ON ends.conv_id IS NOT DISTINCT FROM g.conv_id
"""
