"""Sampled SentencePiece segmentations by forward filtering and backward sampling, and lossless decoding.

A text, with one blank in front, is cut into units: blanks and the word after them; line feeds and the like, which are in
no piece, are units too. No piece crosses the end of a unit, so the lattice of a text is the product of its units' lattices. Forward filtering gives each place of a unit the probabilities of the pieces that
end there; they depend on the unit only and are kept in a bounded worker table. Backward sampling walks from the end of every unit
at once, in arrays; its random numbers are a function of row key, seed, unit number and step, so a row has one segmentation
wherever and however often it is computed.

Unigram models give piece weights ``exp(alpha * score)``. In BPE models scores are merge ranks; weights are ``(1 + rank) ** -alpha``. Characters
without a piece of their own may become byte pieces, a literal U+2581 among them, so decoding gives every text back exactly.

Null and empty texts have no pieces. Rows with equal keys and texts get equal segmentations. Very long texts and words are
handled in parts of bounded size. Columns of the input stay; those named like a result are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ostinato.llm.common import keeps_columns, text_or_empty, worker_cached

CHUNK, EDGES, LONG_UNIT, ROWS = 1 << 16, 1 << 20, 40, 512
GOLDEN, STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)


class Texts:
    """Bytes of the pieces of a model file, end to end; the blank mark is held as a blank."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        texts = [b""] * n
        self.byte_ids = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(n) if sp.is_byte(i)}
        for b, i in self.byte_ids.items():
            texts[i] = bytes([b])
        self.plain = {}
        for i in range(n):
            if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i)):
                piece = sp.id_to_piece(i).replace("▁", " ")
                texts[i] = piece.encode("utf-8")
                self.plain[i] = (piece, sp.get_score(i))
        self.blob = np.frombuffer(b"".join(texts), dtype=np.uint8)
        self.sizes = np.array([len(t) for t in texts], dtype=np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.sizes)[:-1]))

    def text_of(self, ids: np.ndarray) -> bytes:
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        return self.blob[np.arange(total) + np.repeat(self.starts[ids] - ends + sizes, sizes)].tobytes()


class Model(Texts):
    """Pieces with their weights."""

    def __init__(self, path: str, alpha: float):
        super().__init__(path)
        n, scores = len(self.sizes), [s for _, s in self.plain.values()]
        ranked = all(s <= 0 and s == int(s) for s in scores)
        self.prefixes: dict[str, tuple[int, float]] = {}
        for i, (piece, score) in self.plain.items():
            for k in range(1, len(piece)):
                self.prefixes.setdefault(piece[:k], (-1, 0.0))
            self.prefixes[piece] = (i, (1.0 - score) ** -alpha if ranked else float(np.exp(alpha * score)))
        self.byte_weight = float(1 + n) ** -alpha if ranked else float(np.exp(alpha * (min(scores) - 10)))
        self.table = PrefixTable(self.prefixes, float(1 + n) ** (alpha / 2) if ranked else 1.0)
        self.singles = {p for p, (i, _) in self.prefixes.items() if len(p) == 1 and i >= 0}
        apart = "".join(c for c in "\n\r\t" if c not in self.prefixes and not any(c in p for p in self.prefixes))
        self.unit = re.compile(rf" *[^ {apart}]+| +|[{apart}]" if apart else " *[^ ]+| +")


class PrefixTable:
    """Prefixes of pieces by two rolling hashes, for look-ups in arrays: the first finds a slot, the second must agree too.

    Weights are raised by a power of the length, which leaves all probabilities the same and keeps products of many in range.
    """

    BASE1, BASE2, SLOT_BITS = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), 19

    def __init__(self, prefixes: dict[str, tuple[int, float]], level: float):
        self.longest = max(map(len, prefixes))
        one, two = [], []
        for p in prefixes:
            a = b = 0
            for c in map(ord, p):
                a, b = (a * int(self.BASE1) + c + 1) % (1 << 64), (b * int(self.BASE2) + c + 1) % (1 << 64)
            one.append(a)
            two.append(b)
        self.one, self.two = np.array(one, dtype=np.uint64), np.array(two, dtype=np.uint64)
        self.ids = np.array([i for i, _ in prefixes.values()], dtype=np.int32)
        self.weights = np.array([w * level ** len(p) for p, (_, w) in prefixes.items()])
        bits = max(self.SLOT_BITS, len(one).bit_length() + 2)
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.slots = np.full(1 << bits, -1, dtype=np.int32)
        for row, slot in enumerate(self.slot_of(self.one).tolist()):
            while self.slots[slot] >= 0:
                slot = (slot + 1) & self.mask
            self.slots[slot] = row

    def slot_of(self, one: np.ndarray) -> np.ndarray:
        return ((one * GOLDEN) >> self.shift).astype(np.int64)

    def find(self, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row of each hash pair (0 where there is none), and whether there is one."""
        slot = self.slot_of(one)
        row = self.slots[slot]
        other = np.flatnonzero((row >= 0) & (self.one[row] != one))
        while len(other):
            slot[other] = (slot[other] + 1) & self.mask
            again = self.slots[slot[other]]
            row[other] = again
            other = other[(again >= 0) & (self.one[again] != one[other])]
        found = (row >= 0) & (self.two[row] == two)
        return np.where(found, row, 0), found


class Lattices:
    """Forward-filtered lattices of units, end to end: the first edge of each node, and for each edge its cumulative
    probability among the edges into its node, the node before it (-1 at the unit's start), and its piece."""

    def __init__(self, model: Model):
        self.model = model
        self.first = np.empty(1 << 16, np.int32)
        self.keys, self.before, self.pieces = np.empty(1 << 16, np.float32), np.empty(1 << 16, np.int32), np.empty(1 << 16, np.int32)
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.used, self.nodes = 0, 0

    def append(self, first, keys, before, pieces) -> None:
        """Add nodes by their first edges (counted from the first new edge) and edges."""
        nodes, edges = self.nodes + len(first), self.used + len(keys)
        if nodes > len(self.first):
            self.first = grown(self.first, self.nodes, nodes)
        if edges > len(self.keys):
            self.keys, self.before, self.pieces = (grown(x, self.used, edges) for x in (self.keys, self.before, self.pieces))
        self.first[self.nodes:nodes] = np.asarray(first) + self.used
        self.keys[self.used:edges], self.before[self.used:edges], self.pieces[self.used:edges] = keys, before, pieces
        self.nodes, self.used = nodes, edges

    def ends_of(self, units: list[str]) -> np.ndarray:
        """Numbers of the units' last nodes; unknown units are filtered together, odd and long ones one by one."""
        known = self.known
        ends = list(map(known.get, units))
        new, odd = {u for u, e in zip(units, ends) if e is None}, []
        if new:
            odd = self.filter_many([u for u in new if len(u) <= LONG_UNIT]) + [u for u in new if len(u) > LONG_UNIT]
            for u in odd:
                known[u] = self.filter(u)
            ends = [known[u] if e is None else e for u, e in zip(units, ends)]
        for u in odd:
            if len(u) > LONG_UNIT:
                del known[u]
        return np.array(ends, dtype=np.int64)

    def filter_many(self, units: list[str]) -> list[str]:
        """Filter short units whose characters all have pieces; the others are returned.

        Nodes are numbered by place first and unit second, longer units before shorter ones, so the nodes of one place, and the
        edges into them, lie together and are summed at once.
        """
        singles, table = self.model.singles, self.model.table
        odd = [u for u in units if not singles.issuperset(u)]
        units = sorted((u for u in units if singles.issuperset(u)), key=len, reverse=True) if odd else sorted(units, key=len, reverse=True)
        if not units:
            return odd
        codes = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64) + np.uint64(1)
        sizes = np.fromiter(map(len, units), dtype=np.int64, count=len(units))
        longest = int(sizes[0])
        unit = np.repeat(np.arange(len(units)), sizes)
        place = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        left = sizes[unit] - place
        # level[d]: first node of place d
        level = np.concatenate(([0], np.cumsum(np.searchsorted(-sizes, -np.arange(longest + 1), side="right"))))
        at, one, two, edges = np.arange(len(codes)), np.zeros(len(codes), np.uint64), np.zeros(len(codes), np.uint64), []
        number = np.zeros(level[-1], dtype=np.int64)  # edges into each node
        for n in range(1, min(table.longest, longest) + 1):
            inside = left[at] >= n
            at, one, two = at[inside], one[inside], two[inside]
            if not len(at):
                break
            code = codes[at + n - 1]
            one, two = one * table.BASE1 + code, two * table.BASE2 + code
            row, found = table.find(one, two)
            at, one, two, row = at[found], one[found], two[found], row[found]
            whole = np.flatnonzero(table.ids[row] >= 0)
            u, p = unit[at[whole]], place[at[whole]]
            to = level[p + n] + u
            number[to] += 1
            edges.append((level[p] + u, to, row[whole]))
        first = np.cumsum(number) - number
        fill, total = first.copy(), int(number.sum())
        before, rows = np.empty(total, dtype=np.int64), np.empty(total, dtype=np.int32)
        for source, to, row in reversed(edges):  # long pieces first: likely edges are tried first
            slot = fill[to]
            before[slot], rows[slot] = source, row
            fill[to] += 1
        weight, mass, share = table.weights[rows], np.ones(level[-1]), np.empty(total, dtype=np.float32)
        for lo, hi in zip(level[1:-1].tolist(), level[2:].tolist()):
            a, b = int(first[lo]), int(first[hi - 1] + number[hi - 1])
            part, counts = mass[before[a:b]] * weight[a:b], number[lo:hi]
            sums = np.add.reduceat(part, first[lo:hi] - a)
            mass[lo:hi] = sums
            run = np.cumsum(part / np.repeat(sums, counts)) - np.repeat(np.arange(hi - lo, dtype=np.float64), counts)  # each node's parts sum to one
            run[first[lo:hi] - a + counts - 1] = 1.0
            share[a:b] = np.clip(run, 0.0, 1.0)
        base = self.nodes
        self.append(first, share, np.where(before < level[1], -1, base + before), table.ids[rows])
        self.known.update(zip(units, (base + level[sizes] + np.arange(len(units))).tolist()))
        return odd

    def filter(self, unit: str) -> int:
        """Filter one unit; characters without a piece are spelled in byte pieces, with a node for each byte."""
        model, n = self.model, len(unit)
        prefixes, singles = model.prefixes, model.singles
        place, spelled = list(range(n + 1)), {}
        if not singles.issuperset(unit):
            place = [0]
            for k, c in enumerate(unit):
                if c not in singles:
                    spelled[k] = c.encode("utf-8", "surrogatepass")
                place.append(place[-1] + len(spelled.get(k, b"x")))
        incoming: list[list[tuple[int, int, float]]] = [[] for _ in range(place[n] + 1)]
        first, keys, before, pieces, base = [0], [], [], [], self.nodes

        def close(node: int, total: float) -> None:
            run = 0.0
            first.append(len(keys))
            for k, (a, i, w) in enumerate(incoming[node]):
                run += w / total
                keys.append(1.0 if k + 1 == len(incoming[node]) else min(run, 1.0))
                before.append(base + a if a else -1)
                pieces.append(i)

        for s in range(n + 1):
            node, total = place[s], 1.0
            if s:
                total = sum(e[2] for e in incoming[node])
                close(node, total)
                if not 1e-100 < total < 1e100:  # only ratios matter: bring what is under way near 1
                    for later in incoming[node + 1:node + 1 + 4 * model.table.longest]:
                        later[:] = [(a, i, w / total) for a, i, w in later]
                    total = 1.0
            for e in range(s + 1, n + 1):
                known = prefixes.get(unit[s:e])
                if known is None:
                    break
                if known[0] >= 0:
                    incoming[place[e]].append((node, known[0], total * known[1]))
            for k, b in enumerate(spelled.get(s, b"")):
                incoming[node + k + 1].append((node + k, model.byte_ids[b], total * model.byte_weight))
                if k + 1 < len(spelled[s]):
                    close(node + k + 1, total * model.byte_weight)
        self.append(first, keys, before, pieces)
        return self.nodes - 1

    def sample(self, ends: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of all units in order, and their number for each unit, walking back from ``ends``."""
        live, node, walked = np.arange(len(ends)), ends, []
        count = np.zeros(len(ends), dtype=np.int64)
        while len(live):
            state = state + STEP
            u, edge = uniform(state), self.first[node]
            on = np.flatnonzero(u >= self.keys[edge])
            while len(on):
                edge[on] += 1
                on = on[u[on] >= self.keys[edge[on]]]
            walked.append((live, self.pieces[edge]))
            count[live] += 1
            node = self.before[edge]
            on = np.flatnonzero(node >= 0)
            live, node, state = live[on], node[on], state[on]
        out = np.empty(int(count.sum()), dtype=np.int32)
        first = np.cumsum(count) - 1
        for k, (units, found) in enumerate(walked):
            out[first[units] - k] = found
        return out, count


def grown(x: np.ndarray, used: int, need: int) -> np.ndarray:
    out = np.empty(max(need, 2 * len(x)), dtype=x.dtype)
    out[:used] = x[:used]
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def uniform(x: np.ndarray) -> np.ndarray:
    """Numbers in [0, 1) of 24 bits, which single precision holds exactly."""
    return (mixed(x) >> np.uint64(40)).astype(np.float32) / np.float32(1 << 24)


def encode_texts(lattices: Lattices, texts: list[str], keys: np.ndarray) -> list[np.ndarray]:
    """Piece ids of each text; ``keys`` are unsigned row keys. Units of many texts, or parts of long ones, are sampled together."""
    parts: list[list[np.ndarray]] = [[] for _ in texts]
    cut, units = lattices.model.unit, []
    owners, bounds, states = [], [], []

    def flush() -> None:
        if units:
            out, count = lattices.sample(lattices.ends_of(units), np.concatenate(states))
            stops = np.cumsum(count)[np.array(bounds) - 1]
            for owner, a, b in zip(owners, np.concatenate(([0], stops[:-1])), stops):
                parts[owner].append(out[a:b])
        for x in (units, owners, bounds, states):
            x.clear()
        if lattices.used > EDGES:
            lattices.clear()

    for d, text in enumerate(texts):
        found, at = cut.finditer(" " + text) if text else iter(()), 0
        whole = cut.findall(" " + text) if 0 < len(text) < CHUNK else None
        while chunk := [m.group() for m in islice(found, CHUNK)] if whole is None else whole:
            units.extend(chunk)
            owners.append(d)
            bounds.append(len(units))
            states.append(mixed(keys[d] + (np.arange(at, at + len(chunk), dtype=np.uint64) + np.uint64(1)) * GOLDEN))
            at += len(chunk)
            if len(units) >= CHUNK:
                flush()
            if whole is not None:
                break
    flush()
    return [np.concatenate(p) if p else np.empty(0, dtype=np.int32) for p in parts]


def list_array(rows: list) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum([len(i) for i in rows]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(rows) if rows else np.empty(0, dtype=np.int32)))


def decoder(path: str):
    """Column function ``array<int> -> string``; null for null."""

    @F.arrow_udf("string")
    def decode(ids: pa.Array) -> pa.Array:
        model = worker_cached("piece_texts", path, lambda: Texts(path))
        values = np.asarray(ids.values)
        offsets = np.asarray(ids.offsets)
        texts = (model.text_of(values[a:b])[1:].decode("utf-8", "replace") for a, b in zip(offsets[:-1], offsets[1:]))
        return pa.array([t if ok else None for t, ok in zip(texts, ids.is_valid().to_pylist())], type=pa.string())

    return decode


@keeps_columns
def encode_pieces(docs: DataFrame, model: str, key: Column, text: str = "text", alpha: float = 1.0, seed: int = 0, decoded: str | None = None) -> DataFrame:
    """The documents with ``ids`` and ``n_pieces``; ``model`` is the path of a model file that all workers can read.

    With ``decoded``, the ids are also decoded into a column of that name, by the same worker. Some hundred rows are encoded at a time and handed on.
    """
    made = {"ids": "array<int>", "n_pieces": "long"} | ({decoded: "string"} if decoded else {})
    taken = {n.lower() for n in made}
    kept = [c for c in docs.columns if c.lower() not in taken]
    rows = docs.select(*[F.col(f"`{c}`") for c in kept], text_or_empty(text).alias("_text"), F.xxhash64(key).alias("_key"))
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField(n, T._parse_datatype_string(t)) for n, t in made.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        lattices = worker_cached("pieces", f"{model}:{alpha}", lambda: Lattices(Model(model, alpha)))
        shape = to_arrow_schema(schema)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                salted = mixed(np.array(part.column("_key").fill_null(0), dtype=np.int64).view(np.uint64) + np.uint64(seed) * STEP)
                ids = encode_texts(lattices, part.column("_text").to_pylist(), salted)
                new = [list_array(ids), pa.array([len(i) for i in ids], pa.int64())]
                if decoded:
                    new.append(pa.array([lattices.model.text_of(i)[1:].decode("utf-8", "replace") for i in ids], pa.string()))
                yield pa.RecordBatch.from_arrays([part.column(k).cast(f.type) for k, f in enumerate(shape) if k < len(kept)] + [c.cast(shape.field(len(kept) + k).type) for k, c in enumerate(new)], schema=shape)

    return rows.mapInArrow(run, schema)


def decode_pieces(encoded: DataFrame, model: str, ids: str = "ids", name: str = "text") -> DataFrame:
    """The rows with their decoded texts in ``name``."""
    return encoded.withColumn(name, decoder(model)(F.col(ids)))
