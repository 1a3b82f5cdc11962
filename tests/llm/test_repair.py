import hashlib
import itertools
import random
import zlib

import pytest
from pyspark.sql import functions as F

from ostinato.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string"
SPACES = " \t\n\x0b\x0c\r"


def damaged(rows):
    """Rows after damage, with nulls as one space."""
    out = []
    for c, t, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        d = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if d == 1:
            text = ""
        if d == 2:
            text = "".join(x for x in text if x not in ".!?")
        if d == 4:
            role = "user"
        out += [(c, t, role, text)] * (0 if d == 0 else 2 if d == 3 else 1)
    return out


def legal(roles):
    """Whether the initials match (s?(ua)+)?."""
    if roles[:1] == ["s"]:
        roles = roles[1:]
        if not roles:
            return False
    return len(roles) % 2 == 0 and roles == ["u", "a"] * (len(roles) // 2)


def cheapest(rows):
    """(cost, audit, repaired lines) by a plain walk over rows and states; rows are (role, text, fault)."""
    best = {}
    for i in range(len(rows), -1, -1):
        for _ in range(3):  # insertions lead from one state to the next at the same row
            for state in "", "s", "u", "a":
                found = [best[i, state]] if (i, state) in best else []
                if i == len(rows) and state in ("", "a"):
                    found.append((0, "", ()))
                turn = "assistant" if state == "u" else "user"
                if (i, turn[0]) in best:
                    c, a, lines = best[i, turn[0]]
                    found.append((c + 2, "I" + a, (turn + ":", *lines)))
                if i < len(rows):
                    role, text, fault = rows[i]
                    extra = int(fault == "truncated")
                    if (i + 1, state) in best:
                        c, a, lines = best[i + 1, state]
                        found.append((c + 3, "D" + a, lines))
                    if fault not in ("blank", "duplicate"):
                        ini = role[:1]
                        if ini and ini in {"": "su", "s": "u", "u": "a", "a": "u"}[state] and (i + 1, ini) in best:
                            c, a, lines = best[i + 1, ini]
                            found.append((c + extra, "K" + a, (f"{role}:{text}", *lines)))
                        if (i + 1, turn[0]) in best:
                            c, a, lines = best[i + 1, turn[0]]
                            found.append((c + 2 + extra, "R" + a, (f"{turn}:{text}", *lines)))
                if found:
                    best[i, state] = min(found)
    return best[0, ""]


def brute(rows, damage=True):
    """Result rows by conversation."""
    after, out = damaged(rows) if damage else [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows], {}
    for conv in {r[0] for r in rows}:
        mine = [r for r in after if r[0] == conv]
        mine.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), hashlib.sha256(r[3].encode()).digest()))
        seen, marked = set(), []
        for _, _, role, text in mine:
            core = text.rstrip(SPACES)
            fault = "blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else ""
            seen.add((role, text))
            marked.append((role, text, fault))
        turns = [r[1] for r in mine if r[1] is not None]
        initials = [r[0][:1] for r in marked]
        cost, audit, lines = cheapest(marked)
        assert legal([x[:1] for x in lines])
        count = [f for _, _, f in marked].count
        out[conv] = (min(2**63 - 1, max(turns) - min(turns) + 1 - len(set(turns))) if turns else 0, count("blank"), count("duplicate"), count("truncated"),
                     sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def check(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("c", "t", "r", "h", "o", "n", "copy", "place", "block", "f_c"):
        df = df.withColumn(name, F.lit("other"))
    got = {r.conv_id: tuple(r)[1:] for r in repair.digest(df.repartition(3)).collect()}
    assert got == brute(rows)


def test_exhaustive_small_conversations(spark):
    kinds = [("user", "a."), ("assistant", "b"), ("system", "c!"), ("tool", "d?"), ("user", "")]
    rows, conv = [], 0
    for n in range(4):
        for seq in itertools.product(kinds, repeat=n):
            conv += 1
            rows += [(conv, t, role, text and f"{t}{text}") for t, (role, text) in enumerate(seq)]
    check(spark, rows)


def test_random_and_odd_rows(spark):
    rnd = random.Random(1)
    rows = [(c, rnd.choice([None, 0, 1, 2, 3, 3, 9, 2**40]), rnd.choice(["user", "assistant", "system", "", None, "User", "unicorn"]),
             rnd.choice([None, "", " \n", "Hi.", "Hi", "wo?! ", "ü\x0b", "é."])) for c in [None, -3, *range(60)] for _ in range(rnd.randint(1, 9))]
    check(spark, rows + rows[:40] + [(1000, -2**63, "user", "x."), (1000, 2**63 - 1, "assistant", "y. " * 50000)])


def test_long_conversation_in_many_blocks(spark, monkeypatch):
    """Blocks of four places: the answer may not depend on how a conversation is cut."""
    monkeypatch.setattr(repair, "BLOCK_BITS", 2)
    rnd = random.Random(2)
    rows = [(1, t, rnd.choice(["user", "user", "assistant", "system"]), rnd.choice(["a.", "b", "c!", "", f"{t}."])) for t in range(200)]
    check(spark, rows + [(1, 7, "user", "again.")] * 50 + [(2, None, "user", "x")] * 30)


def test_general_interface(spark):
    rows = [(1, 0, "assistant", "Yes."), (1, 1, "assistant", "No"), (2, 5, "user", "Hi."), (2, 5, "user", "Hi.")]
    df = spark.createDataFrame(rows, SCHEMA).toDF("a", "b", "c", "d")
    report, turns = repair.repair(df, "a", "b", "c", "d")
    expected = brute(rows, damage=False)
    assert {r.conv_id: tuple(r)[1:] for r in report.collect()} == {k: v[:-1] for k, v in expected.items()}
    assert [(r.edit, r.role, r.text) for r in turns.where("conv_id = 2").orderBy("place", "part").collect()] == [("K", "user", "Hi."), ("I", "assistant", "")]


def test_empty(spark):
    assert repair.digest(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("n", [1, 2, 7, 4096, 10**12])
def test_powers(n):
    """Cached binary powers give the same costs as single steps; a run of rows to delete of any length is cheap."""
    if n < 10**6:
        for symbol in "suaxSUAXd":
            costs = list(repair.END)
            for _ in range(n):
                costs = repair.before(repair.power(symbol, 0), costs)
            assert repair.before(repair.run_matrix(symbol, n), list(repair.END)) == costs
    assert repair.before(repair.run_matrix("d", n), list(repair.END))[0] == 3 * n
