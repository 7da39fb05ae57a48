"""op13 against a search over all edits, with every way that rows can be cut into chunks."""

import hashlib
import random
import zlib
from functools import cache

import pytest

from pagemill.llm import dialogue
from pagemill.llm.queries import QUERIES

from .conftest import SF, same

SCHEMA = "conv_id long, turn long, role string, text string, key string, audit long"


def cheapest(rows):
    """(cost, audit, roles and texts) of rows (role, text, fault), by trying every edit everywhere."""
    @cache
    def best(i, last, inserted):
        options = [(0, "", ())] if i == len(rows) and last in "a" else []
        follows = {"": "u", "s": "u", "u": "a", "a": "u"}[last]
        name = {"u": "user", "a": "assistant"}[follows]

        def add(cost, edit, at, state, out, n=0):
            c, a, o = best(at, state, n)
            options.append((cost + c, edit + a, (*out, *o)))

        if i < len(rows):
            role, text, fault = rows[i]
            add(2, "D", i + 1, last, ())
            if fault not in ("blank", "duplicate"):
                extra = 5 * (fault == "truncated")
                if role[:1] and (role[:1] == follows or (role[:1] == "s" and last == "")):
                    add(extra, "K", i + 1, role[:1], ((role, text),))
                add(1 + extra, "R", i + 1, follows, ((name, text),))
        if inserted < 2:
            add(5, "I", i, follows, ((name, ""),), inserted + 1)
        return min(options, default=(10**9, "", ()))

    return best(0, "", 0)


def brute(rows, hurt=True):
    """(conv_id, turn, role, text) → the digest of each conversation, by id."""
    convs = {}
    for conv, turn, role, text in rows:
        some = convs.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if hurt else 9
        if kind == 0:
            continue
        text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
        some += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = []
    for conv, some in convs.items():
        some.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()))
        seen, marked, n = set(), [], dict.fromkeys(("blank", "duplicate", "truncated", ""), 0)
        for _, role, text in some:
            body = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
            seen.add((role, text))
            n[fault] += 1
            marked.append((role, text, fault))
        turns = [t for t, _, _ in some if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:], strict=False))
        cost, audit, final = cheapest(tuple(marked))
        out.append((conv, gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit,
                    hashlib.sha256("\n".join(f"{r}:{t}" for r, t in final).encode()).hexdigest()))
    return out


def made(seed, convs, most):
    pick = random.Random(seed)
    rows = []
    for conv in range(convs):
        for turn in range(pick.randrange(most)):
            role = pick.choice(["user", "assistant", "user", "assistant", "system", "s", "unit", "tool", "", None, "Ärzte"])
            text = pick.choice(["Yes.", "no", "", " \t", None, "Why?", "a.\n ", "so ", "é!", "x" * 50])
            rows.append((pick.choice([None, conv]) if conv < 3 else conv, pick.choice([None, turn, turn, turn, turn // 2, -turn * 10]), role, text))
    return rows


@pytest.fixture(scope="module")
def frame(spark):
    return lambda rows: spark.createDataFrame([(*r, "mine", 5) for r in rows], SCHEMA).repartition(3)


def test_every_edit(frame):
    rows = made(1, 60, 9)
    same(dialogue.repaired_digest(frame(rows)).collect(), brute(rows))


@pytest.mark.parametrize("rows_a_chunk, bytes_a_chunk", [(1, 1 << 20), (2, 3), (5, 1 << 20)])
def test_small_chunks(frame, monkeypatch, rows_a_chunk, bytes_a_chunk):
    """Conversations of many chunks, some that go past all partitions, some that never converge (all rows are to go)."""
    monkeypatch.setattr(dialogue, "CHUNK_ROWS", rows_a_chunk)
    monkeypatch.setattr(dialogue, "CHUNK_BYTES", bytes_a_chunk)
    rows = made(2, 4, 30) + [(100, i, "user", "same.") for i in range(40)] + [(101, i, ("user", "assistant")[i % 2], f"{i}") for i in range(25)]
    rows += [(102, i, ("user", "assistant")[i % 2], f"{i}.") for i in range(30)] + [(103, 1, "user", "Hi.")]
    df = frame(rows)
    found = dialogue.digest(dialogue.repair(df))
    same(found.collect(), [b for b in brute(rows, False)])


def test_pieces_and_order(spark, frame):
    rows = [(1, 2, "assistant", "B."), (1, 1, "user", "A."), (1, 3, "tool", "C."), (2, 1, "system", "S."), (3, 7, "user", " ")]
    pieces = sorted(dialogue.repair(frame(rows)).collect(), key=lambda r: (r.conv_id, r.piece))
    one = [r for r in pieces if r.conv_id == 1]
    assert [(x.role, x.text) for r in one for x in r.repaired] == [("user", "A."), ("assistant", "B.")]
    assert "".join(r.audit for r in one) == "KKD" and sum(r.cost for r in one) == 2
    assert [(r.audit, r.repaired, r.alone) for r in pieces[-2:]] == [("D", [], True)] * 2


def test_long_conversations_in_few_passes(spark, monkeypatch):
    """A conversation of a third of all rows, in many chunks: each partition has its share."""
    monkeypatch.setattr(dialogue, "CHUNK_ROWS", 50)
    rows = spark.range(6000).selectExpr("CASE WHEN id % 3 = 0 THEN 7 ELSE id DIV 4 + 10 END AS conv_id", "id AS turn",
                                        "IF(id % 2 = 0, 'user', 'assistant') AS role", "concat(IF(id % 1000 < 500, 'same', string(id)), IF(id % 7 = 0, '', '.')) AS text")
    passes = []
    whole, real = dialogue.cut, dialogue.settle
    monkeypatch.setattr(dialogue, "cut", lambda df: passes.append(df) or whole(df))
    pieces = dialogue.repair(rows, exists=dialogue.F.lit(True))
    assert real is dialogue.settle and len(passes) <= 2 + 2 * 8
    hot = pieces.where("conv_id = 7").collect()
    assert len(hot) >= 40 and max(len(r.audit.replace("I", "")) for r in hot) <= 50
    found = {r.conv_id: r for r in dialogue.digest(pieces).collect()}
    some = sorted((r.turn, r.role, r.text) for r in rows.where("conv_id = 7").collect())
    state, seen, marked = 0, set(), []
    for _, role, text in some:
        fault = "duplicate" if (role, text) in seen else "" if text[-1] == "." else "truncated"
        seen.add((role, text))
        marked.append((role, text, fault))
    search = dialogue.Search()
    symbols = dialogue.symbols_of([m[0] for m in marked], [2 if m[2] == "truncated" else 0 for m in marked], [m[2] != "duplicate" for m in marked])
    audit, cost, state = search.trace(symbols, dialogue.END, 0, True)
    assert (found[7].audit, found[7].cost) == (audit, cost) and state in (0, 3)


def test_empty_and_absent(frame, spark):
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    assert dialogue.repaired_digest(frame([(gone, 0, "user", "x.")]).where("false")).collect() == []
    same(dialogue.repaired_digest(frame([(gone, 0, "user", "x.")])).collect(), [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())])
    same(dialogue.digest(dialogue.repair(frame([(1, 1, "user", "x.")]).where("false"))).collect(), [])


def test_query_and_sql(spark, tmp_path, frame):
    import duckdb

    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    same([tuple(r) for r in QUERIES["op13_conversation_repair"](spark, SF).collect()], brute(rows))
    more = [(c, t, r, x) for i, (c, _, r, x) in enumerate(made(3, 30, 8)) for t in [None if i % 50 == 7 else i]]
    frame(more).write.parquet(f"{tmp_path}/c")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/c/*.parquet'")
    same(con.execute(dialogue.ORACLE).fetchall(), brute(more))
