"""Repair of the turn structure of conversations by run-length dynamic programming.

The rows of a conversation become symbols: the role's initial (s, u, a or another) with its fault, where blank and duplicate rows are one
symbol that can only be deleted. Edits are keep (cost 0), rerole to user or assistant (2), delete (3) and insert of an empty user or assistant turn (2);
a truncated row that stays costs 1 more. The roles must end as an optional system turn and pairs of user and assistant, or as nothing.
A symbol is a 4 x 4 min-plus matrix over the states start, system, user and assistant; equal consecutive symbols are one run, whose matrix is the product of
cached binary powers. The cost-to-go behind each run then unrolls the choices; of the cheapest audits the ASCII-least is taken, which is
the least edit at each step, as each edit has one next state. Deletions come before insertions in ASCII, so runs of rows to delete need no search.

Plan: texts are first reduced to digests. Equal rows are counted (so a row repeated any number of times is one entry), first copies are
marked by an equi-join on all keys, and entries are ordered by range partitioning over conversation, turn, role and digest, so a long conversation spans many tasks.
Blocks of at most ``BLOCK`` places are solved apart: each gives its matrix; the matrices of a conversation (one a block) give the cost-to-go at the end
of each block; each block unrolls its choices for every state it may start from, and the blocks' ends select the start. Texts are
shuffled only to meet the rows that stay. What grows with one conversation in one row is its audit and the list of its blocks; digests are streamed.

Rows are in the order of turn (nulls first), then role, then SHA-256 of the text; repeated rows follow each other. A null role or text counts as one space.
An empty role has no initial. Gaps beyond the range of a long are held at its end. Texts of any length are only hashed and searched. A null conversation id is a conversation of its own. Empty tables give
no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache, reduce
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ostinato.session import cut

BLOCK_BITS = 12
BLOCK = 1 << BLOCK_BITS
SPACES = " \t\n\x0b\x0c\r"
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
ROLES = {USER: "user", ASSISTANT: "assistant"}
NEVER = 1 << 60
#: Turn that must follow each state.
NEXT = (USER, USER, ASSISTANT, USER)
#: States a kept row may follow, and the state it gives, by its initial.
KEEP = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}, "x": {}}
#: Cheapest insertions between two states.
INSERTS = ((0, NEVER, 2, 4), (NEVER, 0, 2, 4), (NEVER, NEVER, 0, 2), (NEVER, NEVER, 2, 0))
#: Cost of what must follow the last row in each state.
END = (0, 4, 2, 0)
LEGAL = {"su", "ua", "au"}
MOST = (1 << 63) - 1


def options(symbol: str, state: int) -> list[tuple[str, int, int]]:
    """(edit, cost, next state) in ASCII order; symbols are d (delete) or an initial, in capitals if truncated."""
    found, extra = [("D", 3, state), ("I", 2, NEXT[state])], int(symbol.isupper())
    if symbol != "d":
        if state in KEEP[symbol.lower()]:
            found.append(("K", extra, KEEP[symbol.lower()][state]))
        found.append(("R", 2 + extra, NEXT[state]))
    return found


def times(a: tuple, b: tuple) -> tuple:
    """Min-plus product of two matrices."""
    return tuple(tuple(min(NEVER, *[x + b[k][j] for k, x in enumerate(row)]) for j in STATES) for row in a)


def before(matrix: tuple, costs: list[int]) -> list[int]:
    """Cost-to-go before the rows of ``matrix``, given that behind them."""
    return [min(x + costs[k] for k, x in enumerate(row)) for row in matrix]


@lru_cache(maxsize=None)
def power(symbol: str, k: int) -> tuple:
    """Matrix of ``2 ** k`` rows of one symbol; 9 symbols by at most 63 powers are kept."""
    if k:
        return times(power(symbol, k - 1), power(symbol, k - 1))
    edit = [[NEVER] * 4 for _ in STATES]
    for i in STATES:
        for name, cost, j in options(symbol, i):
            if name != "I":
                edit[i][j] = min(edit[i][j], cost)
    return times(INSERTS, tuple(map(tuple, edit)))


@lru_cache(maxsize=1 << 14)
def run_matrix(symbol: str, n: int) -> tuple:
    """Matrix of ``n`` rows of one symbol."""
    return reduce(times, [power(symbol, k) for k in range(n.bit_length()) if n >> k & 1])


def runs_of(symbols: Iterable[str], copies: Iterable[int]) -> list[tuple[str, int]]:
    """Runs of equal symbols; all copies of a row but the first are to be deleted."""
    flat = [x for s, n in zip(symbols, copies) for x in ([(s, n)] if s == "d" else [(s, 1), ("d", n - 1)]) if x[1]]
    return [(s, sum(n for _, n in group)) for s, group in groupby(flat, key=lambda x: x[0])]


def unroll(runs: list[tuple[str, int]], costs: list[int], state: int) -> tuple[str, int]:
    """Audit of the runs from ``state``, and the state behind them; ``costs`` is the cost-to-go there."""
    behind = [costs]
    for symbol, n in reversed(runs[1:]):
        behind.append(before(run_matrix(symbol, n), behind[-1]))
    audit = []
    for (symbol, n), end in zip(runs, reversed(behind)):
        if symbol == "d":
            audit.append("D" * n)
            continue
        steps = [end]
        for _ in range(n):
            steps.append(before(power(symbol, 0), steps[-1]))
        left = n
        while left:
            for name, cost, after in options(symbol, state):
                if cost + steps[left if name == "I" else left - 1][after] == steps[left][state]:
                    audit.append(name)
                    state, left = after, left - (name != "I")
                    break
    return "".join(audit), state


def closing(state: int) -> str:
    """Insertions behind the last row."""
    return "I" * (END[state] // 2)


def items_of(symbols: str, copies: list[int], state: int, audit: str) -> Iterator[tuple[int, int, str, str | None]]:
    """(entry, place, edit, role) of the turns that stay or come in; the role of kept rows is None."""
    at = i = 0
    for i, (symbol, n) in enumerate(zip(symbols, copies)):
        place = 0
        while at < len(audit):
            edit, at = audit[at], at + 1
            if edit != "D":
                state = KEEP[symbol.lower()][state] if edit == "K" else NEXT[state]
                yield i, place, edit, None if edit == "K" else ROLES[state]
            place += 1
            if edit != "I":
                break
        at += n - 1
    for place, edit in enumerate(audit[at:]):
        state = NEXT[state]
        yield i, BLOCK + place, edit, ROLES[state]


def keyed(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """Columns c, t, r, x of conversation, turn, role and text, and the text's digest h."""
    named = rows.select(F.col(conv).alias("c"), F.col(turn).alias("t"), F.coalesce(F.col(role), F.lit(" ")).alias("r"), F.coalesce(F.col(text), F.lit(" ")).alias("x"))
    return named.withColumn("h", F.unhex(F.sha2("x", 256)))


def entries(rows: DataFrame) -> DataFrame:
    """Different rows in order: c, t, r, h, copies n, fault of the first copy, place o (rising within and across tasks)."""
    core = F.rtrim(F.col("x"), F.lit(SPACES))
    kind = F.when(core == "", "blank").when(F.substring(core, -1, 1).isin(".", "!", "?"), "whole").otherwise("truncated")
    counted = rows.select("c", "t", "r", "h", kind.alias("kind")).groupBy("c", "t", "r", "h", "kind").agg(F.count(F.lit(1)).alias("n"))
    first = counted.groupBy("c", "r", "h").agg(F.min(F.struct("t")).alias("f")).select(*[F.col(x).alias(f"f_{x}") for x in "crh"], F.col("f.t").alias("f_t"))
    same = reduce(lambda a, b: a & b, [F.col(x).eqNullSafe(F.col(f"f_{x}")) for x in "ctrh"])
    fault = F.when(F.col("kind") == "blank", "blank").when(F.col("f_h").isNull(), "duplicate").otherwise(F.col("kind"))
    marked = counted.join(first, same, "left").select("c", "t", "r", "h", "n", fault.alias("fault"))
    ordered = marked.repartitionByRange("c", "t", "r", "h").sortWithinPartitions("c", "t", "r", "h")
    return cut(ordered.withColumn("o", F.monotonically_increasing_id()), "turns")


def symbol() -> Column:
    initial = F.lower(F.substring("r", 1, 1))
    name = F.when(F.substring("r", 1, 1).isin("s", "u", "a"), initial).otherwise("x")
    return F.when(F.col("fault").isin("blank", "duplicate"), "d").when(F.col("fault") == "truncated", F.upper(name)).otherwise(name)


def blocks_of(ordered: DataFrame) -> DataFrame:
    """Entries by conversation and block of places: places, symbols, copies and initials in order; at most ``BLOCK`` a row."""
    one = F.struct("o", symbol().alias("s"), "n", F.substring("r", 1, 1).alias("i"))
    grouped = ordered.groupBy("c", F.shiftright("o", BLOCK_BITS).alias("block")).agg(F.sort_array(F.collect_list(one)).alias("e"))
    return cut(grouped.select("c", "block", F.col("e.o").alias("places"), F.array_join("e.s", "").alias("symbols"), F.col("e.n").alias("copies"), F.col("e.i").alias("initials")), "blocks")


def arrow_map(frame: DataFrame, schema: str, fn) -> DataFrame:
    """``fn`` of each row as dict gives the rows of the result as tuples; batches stay small."""
    target = frame.sparkSession.createDataFrame([], schema).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        shape = to_arrow_schema(target)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                found = [x for row in batch.slice(at, 256).to_pylist() for x in fn(row)]
                columns = list(zip(*found)) or [()] * len(shape)
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, shape)], schema=shape)

    return frame.mapInArrow(run, target)


def broken_pairs(initials: list[str], copies: list[int]) -> int:
    """Neighbours whose initials may not follow each other; copies of a row never may."""
    return sum(n - 1 for n in copies) + sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))


def summary(row: dict):
    matrix = reduce(times, [run_matrix(s, n) for s, n in runs_of(row["symbols"], row["copies"])])
    yield row["c"], row["block"], [x for line in matrix for x in line], broken_pairs(row["initials"], row["copies"]), row["initials"][0], row["initials"][-1]


def fold(row: dict):
    """For each block of a conversation the cost-to-go behind it; with the first one, what holds for the conversation."""
    costs, out = list(END), []
    for b in reversed(row["b"]):
        out.append((b["block"], costs))
        costs = before([b["matrix"][i:i + 4] for i in range(0, 16, 4)], costs)
    illegal = sum(b["illegal"] for b in row["b"]) + sum(a["last"] + b["first"] not in LEGAL for a, b in zip(row["b"], row["b"][1:]))
    for k, (block, behind) in enumerate(reversed(out)):
        head, tail = k == 0, k == len(out) - 1
        yield row["c"], block, behind, head, tail, costs[START] if head else None, illegal if head else None


def choices(row: dict):
    """Audit and end state of a block for each state it may start from."""
    runs, found = runs_of(row["symbols"], row["copies"]), []
    for state in ([START] if row["head"] else STATES):
        audit, end = unroll(runs, row["behind"], state)
        found.append((audit + closing(end) if row["tail"] else audit, end))
    yield row["c"], row["block"], [a for a, _ in found], [e for _, e in found]


def chosen(row: dict):
    """The blocks of a conversation with their start state and audit."""
    state = START
    for b in row["b"]:
        yield row["c"], b["block"], state, b["audits"][state]
        state = b["ends"][state]


def turns_of(row: dict):
    for i, place, edit, role in items_of(row["symbols"], row["copies"], row["state"], row["audit"]):
        yield row["places"][i], place, edit, role


def repair(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Two frames. Report: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit of each conversation that has rows.
    Turns: conv_id, place, part (together their order), edit (K, R, I), role, text of the repaired conversations."""
    named = keyed(rows, conv, turn, role, text)
    ordered = entries(named)
    blocks = blocks_of(ordered)
    kind = dict(named.dtypes)["c"]
    sums = arrow_map(blocks, f"c {kind}, block long, matrix array<long>, illegal long, first string, last string", summary)
    per_conv = sums.groupBy("c").agg(F.sort_array(F.collect_list(F.struct("block", "matrix", "illegal", "first", "last"))).alias("b"))
    ends = cut(arrow_map(per_conv, f"c {kind}, block long, behind array<long>, head boolean, tail boolean, cost long, illegal long", fold), "costs")

    def with_block(side: DataFrame) -> DataFrame:
        side = side.withColumnsRenamed({"c": "k_c", "block": "k_block"})
        return blocks.join(side, F.col("c").eqNullSafe(F.col("k_c")) & (F.col("block") == F.col("k_block"))).drop("k_c", "k_block")

    found = arrow_map(with_block(ends.select("c", "block", "behind", "head", "tail")), f"c {kind}, block long, audits array<string>, ends array<int>", choices)
    chains = found.groupBy("c").agg(F.sort_array(F.collect_list(F.struct("block", "audits", "ends"))).alias("b"))
    picked = cut(arrow_map(chains, f"c {kind}, block long, state int, audit string", chosen), "audits")
    return report(ordered, ends, picked), repaired(named, ordered, arrow_map(with_block(picked), "o long, place int, edit string, own string", turns_of))


def held(value: Column) -> Column:
    """A wide number as long, held at the end of its range."""
    return F.when(value.isNotNull(), F.least(value, F.lit(MOST).cast("decimal(38,0)"))).cast("long")


def report(ordered: DataFrame, ends: DataFrame, picked: DataFrame) -> DataFrame:
    fault, wide = F.col("fault"), F.col("t").cast("decimal(38,0)")
    turns = ordered.groupBy("c", "t").agg(
        F.sum(F.when(fault == "blank", F.col("n")).otherwise(0)).alias("blank"),
        F.sum(F.when(fault == "duplicate", F.col("n")).when(fault != "blank", F.col("n") - 1).otherwise(0)).alias("duplicate"),
        F.sum(F.when(fault == "truncated", 1).otherwise(0)).alias("truncated"))
    gaps = F.coalesce(held(F.max(wide) - F.min(wide) + 1 - F.count("t")), F.lit(0).cast("long"))
    counts = turns.groupBy("c").agg(gaps.alias("gaps"), *[F.sum(x).alias(x) for x in ("blank", "duplicate", "truncated")])
    parts = [counts, ends.where("head").select("c", "illegal", "cost"), picked.select("c", F.struct("block", "audit").alias("a"))]
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    one = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).groupBy("c").agg(
        *[F.max(x).alias(x) for x in numbers], F.array_join(F.sort_array(F.collect_list("a"))["audit"], "").alias("audit"))
    return one.withColumnRenamed("c", "conv_id")


def repaired(named: DataFrame, ordered: DataFrame, items: DataFrame) -> DataFrame:
    placed = items.withColumnRenamed("o", "p").join(ordered.select("c", "t", "r", "h", "o"), F.col("p") == F.col("o"))
    stay = placed.where("edit <> 'I'").select(*[F.col(x).alias(f"k_{x}") for x in "ctrh"], "o", "place", "edit", F.coalesce("own", "r").alias("role"))
    texts = named.groupBy("c", "t", "r", "h").agg(F.any_value("x").alias("x"))
    same = reduce(lambda a, b: a & b, [F.col(x).eqNullSafe(F.col(f"k_{x}")) for x in "ctrh"])
    kept = texts.join(stay, same).select("c", "o", "place", "edit", "role", F.col("x").alias("text"))
    new = placed.where("edit = 'I'").select("c", "o", "place", "edit", F.col("own").alias("role"), F.lit("").alias("text"))
    return kept.unionByName(new).select(F.col("c").alias("conv_id"), F.col("o").alias("place"), F.col("place").alias("part"), "edit", "role", "text")


def turns_digest(turns: DataFrame) -> DataFrame:
    """SHA-256 of each conversation's ``role:text`` lines, streamed in order."""
    kind = dict(turns.dtypes)["conv_id"]

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest, schema = None, None, None
        done: list[tuple] = []
        for batch in batches:
            schema = batch.schema
            for c, role, text in zip(*[batch.column(x).to_pylist() for x in ("conv_id", "role", "text")]):
                if digest is None or c != now:
                    if digest is not None:
                        done.append((now, digest.hexdigest()))
                    now, digest = c, hashlib.sha256()
                else:
                    digest.update(b"\n")
                digest.update(f"{role}:{text}".encode())
            if done:
                yield made(done, schema)
                done = []
        if digest is not None:
            yield made([(now, digest.hexdigest())], schema)

    def made(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], schema.field("conv_id").type), pa.array([r[1] for r in rows], pa.string())], names=["conv_id", "repaired_sha256"])

    lines = turns.repartition("conv_id").sortWithinPartitions("conv_id", "place", "part")
    return lines.select("conv_id", "role", "text").mapInArrow(stream, f"conv_id {kind}, repaired_sha256 string")


def damage(rows: DataFrame) -> DataFrame:
    """Rows damaged by the remainder of crc32(``conv_id:turn``) by 20: dropped, emptied, without ends of sentences, repeated, or made the user's."""
    name = [F.coalesce(F.col(x).cast("string"), F.lit(" ")) for x in ("conv_id", "turn")]
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    d = F.crc32(F.concat(name[0], F.lit(":"), name[1])) % 20
    copies = F.when(d == 0, F.array().cast("array<int>")).when(d == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", F.when(d == 4, "user").otherwise(role).alias("role"),
                       F.when(d == 1, "").when(d == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"), F.explode(copies).alias("copy")).drop("copy")


def digest(rows: DataFrame) -> DataFrame:
    """Rows of the query: the report of all conversations of ``rows`` after damage, with the digest of their repaired turns."""
    found, turns = repair(damage(rows.select("conv_id", "turn", "role", "text")))
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    parts = [rows.select("conv_id").distinct(), found, turns_digest(turns)]
    one = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).groupBy("conv_id").agg(*[F.max(x).alias(x) for x in [*numbers, "audit", "repaired_sha256"]])
    return one.select("conv_id", *[F.coalesce(x, F.lit(0)).cast("long").alias(x) for x in numbers], F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))


#: The same by steps of one row, from the last to the first for the audits and forward for the turns.
ORACLE = r"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS t),
marked AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_prepend(4294967295, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT)),
      lambda a, b: xor(a >> 8, t[1 + (xor(a, b) & 255)])), 4294967295) % 20 AS d FROM conversations, crc),
damaged AS (
  SELECT conv_id, turn, CASE d WHEN 4 THEN 'user' ELSE role END AS role, CASE d WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM (SELECT *, unnest(range(CASE d WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) FROM marked)),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i,
    regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS tail, role[1] AS ini FROM damaged),
faults AS (
  SELECT *, CASE WHEN tail = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN tail NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    lag(ini) OVER (PARTITION BY conv_id ORDER BY i) AS past FROM numbered),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (past IS NOT NULL AND past || ini NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM faults GROUP BY conv_id),
steps AS (
  SELECT conv_id, n AS i, {'c': 0, 'a': ''} AS v0, {'c': 4, 'a': 'II'} AS v1, {'c': 2, 'a': 'I'} AS v2, {'c': 0, 'a': ''} AS v3 FROM counts
  UNION ALL
  SELECT conv_id, i - 1, list_sort([w0, {'c': w2.c + 2, 'a': 'I' || w2.a}, {'c': w3.c + 4, 'a': 'II' || w3.a}])[1], list_sort([w1, {'c': w2.c + 2, 'a': 'I' || w2.a}, {'c': w3.c + 4, 'a': 'II' || w3.a}])[1],
    list_sort([w2, {'c': w3.c + 2, 'a': 'I' || w3.a}])[1], list_sort([w3, {'c': w2.c + 2, 'a': 'I' || w2.a}])[1]
  FROM (
    SELECT s.conv_id, s.i,
      list_sort([{'c': v0.c + 3, 'a': 'D' || v0.a}, {'c': CASE WHEN gone THEN 999999999 WHEN ini = 's' THEN v1.c + t WHEN ini = 'u' THEN v2.c + t ELSE 999999999 END, 'a': 'K' || CASE ini WHEN 's' THEN v1.a ELSE v2.a END},
        {'c': CASE WHEN gone THEN 999999999 ELSE v2.c + 2 + t END, 'a': 'R' || v2.a}])[1] AS w0,
      list_sort([{'c': v1.c + 3, 'a': 'D' || v1.a}, {'c': CASE WHEN NOT gone AND ini = 'u' THEN v2.c + t ELSE 999999999 END, 'a': 'K' || v2.a},
        {'c': CASE WHEN gone THEN 999999999 ELSE v2.c + 2 + t END, 'a': 'R' || v2.a}])[1] AS w1,
      list_sort([{'c': v2.c + 3, 'a': 'D' || v2.a}, {'c': CASE WHEN NOT gone AND ini = 'a' THEN v3.c + t ELSE 999999999 END, 'a': 'K' || v3.a},
        {'c': CASE WHEN gone THEN 999999999 ELSE v3.c + 2 + t END, 'a': 'R' || v3.a}])[1] AS w2,
      list_sort([{'c': v3.c + 3, 'a': 'D' || v3.a}, {'c': CASE WHEN NOT gone AND ini = 'u' THEN v2.c + t ELSE 999999999 END, 'a': 'K' || v2.a},
        {'c': CASE WHEN gone THEN 999999999 ELSE v2.c + 2 + t END, 'a': 'R' || v2.a}])[1] AS w3
    FROM steps s JOIN (SELECT *, fault IN ('blank', 'duplicate') AS gone, CAST(fault = 'truncated' AS INT) AS t FROM faults) f ON s.conv_id IS NOT DISTINCT FROM f.conv_id AND s.i = f.i WHERE s.i > 0)),
audits AS (SELECT conv_id, v0.c AS cost, v0.a AS audit FROM steps WHERE i = 0),
walk AS (
  SELECT conv_id, audit, 1 AS p, 1 AS i, 0 AS state, CAST([] AS VARCHAR[]) AS lines FROM audits
  UNION ALL
  SELECT w.conv_id, audit, p + 1, CASE audit[p] WHEN 'I' THEN w.i ELSE w.i + 1 END,
    CASE audit[p] WHEN 'D' THEN state WHEN 'K' THEN CASE f.ini WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END ELSE CASE state WHEN 2 THEN 3 ELSE 2 END END,
    CASE audit[p] WHEN 'D' THEN lines WHEN 'K' THEN list_append(lines, f.role || ':' || f.text)
      ELSE list_append(lines, CASE state WHEN 2 THEN 'assistant:' ELSE 'user:' END || CASE audit[p] WHEN 'R' THEN f.text ELSE '' END) END
  FROM walk w LEFT JOIN faults f ON w.conv_id IS NOT DISTINCT FROM f.conv_id AND w.i = f.i WHERE p <= length(audit)),
ready AS (SELECT conv_id, sha256(coalesce(array_to_string(lines, chr(10)), '')) AS mark FROM walk WHERE p = length(audit) + 1)
SELECT o.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(cost, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, coalesce(mark, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON o.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN audits a ON o.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN ready r ON o.conv_id IS NOT DISTINCT FROM r.conv_id"""
