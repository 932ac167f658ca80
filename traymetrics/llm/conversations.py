"""Operator 12, conversation structure repair by a cost DP and prefix-doubling path ranking.

A repaired conversation has the role initials ``(s?(ua)+)?``. Rows are kept (K), given another role
(R) or deleted (D), and empty rows are inserted (I). The nodes of the problem are (rows done, state):
nothing written, a system row, a user row last, an assistant row last. A backward DP gives each node
the least cost to the end, and the arcs on which that cost is reached form a graph in which every
path is a cheapest repair.

Of those the one with the least audit (the letters in order) is wanted. Nodes are ranked by the
letters of their best path, one letter first, then two, four, and so on: the rank for twice the
length is that of the pair (own rank, rank of the node that many steps on), and pointers double along
with it. A node's arc is the one of least letter, then of least rank of its target (in this graph the
arcs of a node differ in their letters). The path is read by following the doubled pointers.

Conversations of any length are spread: rows are put in order by range and a task solves the pieces of
a chunk. Where a conversation crosses chunks, its pieces hand over 4 x 4 costs, the state each is left
in for each state it is entered in, and the role of its last row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traymetrics.llm.common import land, query, table
from traymetrics.operators.ordering import BROADCAST_ROWS, CHUNK, POS, ordered_chunks

REROLE, DELETE, INSERT, UNFINISHED = 2, 3, 2, 1  # costs of edits; the last is added for a truncated row that stays
LETTERS = "DIKR"
_D, _I, _K, _R = range(4)
_START, _SYSTEM, _USER, _ASSISTANT = range(4)
_NEXT = (_USER, _USER, _ASSISTANT, _USER)  # the state after the one of user and assistant that is due
_ROLE = {_USER: "user", _ASSISTANT: "assistant"}
_FAR = 1 << 40
_DONE = (0, _FAR, _FAR, 0)  # a conversation can't end in the states system and user
_BLANK = "\t\n\x0b\x0c\r "

Arc = tuple[int, int, int, int]  # state, letter, state after, cost


def _arcs(initial: str, fault: str | None) -> list[Arc]:
    """The arcs that a row allows to the next layer of nodes."""
    out = [(q, _D, q, DELETE) for q in range(4)]
    if fault in ("blank", "duplicate"):
        return out
    extra = UNFINISHED if fault == "truncated" else 0
    kept = {"s": [(_START, _SYSTEM)], "u": [(q, _USER) for q in range(4) if _NEXT[q] == _USER], "a": [(_USER, _ASSISTANT)]}
    out += [(q, _K, after, extra) for q, after in kept.get(initial, [])]
    return out + [(q, _R, _NEXT[q], REROLE + extra) for q in range(4)]


_KINDS = [(initial, fault) for initial in ("s", "u", "a", "") for fault in (None, "truncated", "duplicate")]
_ARCS = [_arcs(*k) for k in _KINDS]
_KIND_OF = {k: i for i, k in enumerate(_KINDS)} | {(i, "blank"): _KINDS.index((i, "duplicate")) for i in ("s", "u", "a", "")}


def kind_of(role: str, fault: str | None) -> int:
    return _KIND_OF[role[:1] if role[:1] in ("s", "u", "a") else "", fault]


def _with_inserts(v: list[int]) -> list[int]:
    for _ in range(2):
        v = [min(v[q], INSERT + v[_NEXT[q]]) for q in range(4)]
    return v


@dataclass
class Piece:
    """Rows ``lo`` to ``hi`` of a chunk that belong to one conversation."""

    lo: int
    hi: int
    entry: int = _START
    end: tuple[int, ...] | None = None  # costs after the last row, where the conversation goes on in another chunk


def _costs(kinds: list[int], end: list[int]) -> list[list[int]]:
    """The cost DP: for each layer of nodes the least cost from each state to the end."""
    out = [end]
    for kind in reversed(kinds):
        below, here = out[-1], [_FAR] * 4
        for q, _, after, cost in _ARCS[kind]:
            if cost + below[after] < here[q]:
                here[q] = cost + below[after]
        out.append(_with_inserts(here))
    return out[::-1]


def piece_costs(kinds: list[int]) -> list[int]:
    """Costs (4 x 4, flat) from each state before the rows to each state after them."""
    columns = [_costs(kinds, [0 if q == r else _FAR for q in range(4)])[0] for r in range(4)]
    return [min(columns[r][q], _FAR) for q in range(4) for r in range(4)]


class Repairs:
    """The cheapest repairs of least audit of all pieces of a chunk."""

    def __init__(self, kinds: list[int], pieces: list[Piece]):
        self.pieces = pieces
        # a piece has a layer of nodes more than rows; layer of row i of piece k: i - first row + k
        cost = [v for p in pieces for v in _costs(kinds[p.lo : p.hi], list(p.end) if p.end else _with_inserts(list(_DONE)))]
        cost = np.array(cost, np.int64).reshape(-1, 4)
        sizes = np.array([p.hi - p.lo for p in pieces], np.int64)
        self.first = np.cumsum(sizes + 1) - sizes - 1
        piece_of_row = np.repeat(np.arange(len(pieces)), sizes)
        layer = np.arange(len(kinds)) + piece_of_row
        self.row_of = np.full(len(cost), -1, np.int64)
        self.row_of[layer] = np.arange(len(kinds))
        self._rank(cost, layer, np.array(kinds, np.int64))

    def _optimal(self, cost: np.ndarray, layer: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(node, letter, target) of the arcs that keep the least cost; node: 4 * layer + state."""
        found = []
        for kind, arcs in enumerate(_ARCS):
            at = layer[kinds == kind]
            for q, letter, after, c in arcs:
                best = at[cost[at, q] == c + cost[at + 1, after]]
                found.append((4 * best + q, np.full(len(best), letter), 4 * (best + 1) + after))
        inside = np.ones(len(cost), bool)  # layers with inserts: all but the last of a piece that goes on
        inside[[f + p.hi - p.lo for f, p in zip(self.first, self.pieces) if p.end]] = False
        at = np.flatnonzero(inside)
        for q in range(4):
            best = at[cost[at, q] == INSERT + cost[at, _NEXT[q]]]
            found.append((4 * best + q, np.full(len(best), _I), 4 * best + _NEXT[q]))
        node, letter, target = map(np.concatenate, zip(*found))
        return node, letter, target

    def _rank(self, cost: np.ndarray, layer: np.ndarray, kinds: np.ndarray) -> None:
        node, letter, target = self._optimal(cost, layer, kinds)
        n = cost.size
        rank = np.zeros(n, np.int64)  # of no letter at all
        self.letter = np.full(n, -1, np.int64)
        self.jumps = []
        while True:
            # the best arc of each node: least letter, then least rank of what follows
            order = np.lexsort((rank[target], letter, node))
            best = order[np.concatenate([[True], node[order][1:] != node[order][:-1]])] if len(order) else order
            step = np.arange(n)
            step[node[best]] = target[best]
            self.letter[node[best]] = letter[best]
            if not self.jumps:
                self.jumps = [step]
                rank = self.letter + 1  # the end comes before every letter
            jump = self.jumps[-1]
            _, rank = np.unique(rank * (rank.max() + 1) + rank[jump], return_inverse=True)
            further = jump[jump]
            if np.array_equal(further, jump):
                break
            self.jumps.append(further)

    def exits(self) -> list[list[int]]:
        """For each piece the state after its rows, for each state before them."""
        ends = self.jumps[-1]
        return [[int(ends[4 * f + q] % 4) for q in range(4)] for f in self.first]

    def paths(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(piece, layer row or -1 after the last, node) of every edit, in order."""
        node = 4 * self.first + np.array([p.entry for p in self.pieces], np.int64)
        piece, place = np.arange(len(node)), np.zeros(len(node), np.int64)
        for k, jump in enumerate(self.jumps):
            live = self.letter[node] >= 0
            node, piece, place = node[live], piece[live], place[live]
            node, piece, place = np.concatenate([node, jump[node]]), np.tile(piece, 2), np.concatenate([place, place + (1 << k)])
        live = self.letter[node] >= 0
        order = np.lexsort((place[live], piece[live]))
        node = node[live][order]
        return piece[live][order], self.row_of[node // 4], node

    def edits(self) -> tuple[list[str], list[list[int]]]:
        """For each row its edit letters and the states they lead to; inserts after the last row go with that row."""
        n = int((self.row_of >= 0).sum())
        letters, states = [""] * n, [[] for _ in range(n)]
        piece, row, node = self.paths()
        after = self.jumps[0][node] % 4
        for p, r, a, q in zip(piece.tolist(), row.tolist(), self.letter[node].tolist(), after.tolist()):
            at = r if r >= 0 else self.pieces[p].hi - 1
            letters[at] += LETTERS[a]
            states[at].append(q)
        return letters, states


def damage(rows: DataFrame) -> DataFrame:
    """The rows (conv_id, turn, role, text, copies) after the test damage; nulls are one space."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", spaced("conv_id"), spaced("turn")).cast("binary")) % 20
    kinds = rows.select("conv_id", "turn", spaced("role").alias("role"), spaced("text").alias("text"), kind.alias("_kind")).filter("_kind <> 0")
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("_kind") == 4, "user").otherwise(F.col("role"))
    return kinds.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(F.col("_kind") == 3, 2).otherwise(1).cast("long").alias("copies"))


def find_faults(rows: DataFrame) -> DataFrame:
    """Distinct rows of (conv_id, turn, role, text, copies) with the first fault of their first copy, or null.

    Equal rows of one turn become one row with their number, combined before the shuffle. Whether role
    and text were seen earlier is told by the first turn that has them.
    """
    rows = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies")).withColumn("_said", F.sha2("text", 256))
    rows = land(rows, "turns")
    place = F.struct(F.col("turn").isNotNull().alias("given"), "turn")
    seen = rows.groupBy(F.col("conv_id").alias("_c"), F.col("role").alias("_r"), F.col("_said").alias("_s")).agg(F.min(place).alias("_first"))
    same = F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("role") == F.col("_r")) & (F.col("_said") == F.col("_s"))
    end = F.right(F.rtrim(F.col("text"), F.lit(_BLANK)), F.lit(1))
    fault = F.when(end == "", "blank").when(~place.eqNullSafe(F.col("_first")), "duplicate").when(~end.isin(".", "!", "?"), "truncated")
    return rows.join(seen, same).select("conv_id", "turn", "role", "text", "copies", fault.alias("fault"))


def _pieces(table: pa.Table) -> tuple[list[int], list[Piece]]:
    """Kinds of the rows of a chunk, and its pieces with what other chunks have handed over."""
    conv, entry, end = (table.column(c).to_pylist() for c in ("conv_id", "_entry", "_end"))
    cuts = [0, *(i for i in range(1, len(conv)) if conv[i] != conv[i - 1]), len(conv)]
    pieces = [Piece(a, b, entry[a] or _START, tuple(end[a]) if end[a] else None) for a, b in zip(cuts[:-1], cuts[1:])]
    return [kind_of(r, f) for r, f in zip(table.column("role").to_pylist(), table.column("fault").to_pylist())], pieces


def _in_chunks(rows: DataFrame, solve, schema: str) -> DataFrame:
    def task(table: pa.Table) -> pa.Table:
        table = table.sort_by(POS)
        return solve(table, *_pieces(table))

    return rows.groupBy(CHUNK).applyInArrow(task, schema)


def _of_piece(kind: str, order: str, fn, pieces: DataFrame) -> DataFrame:
    """``fn`` over the pieces of each conversation, in order; a conversation has one a chunk at most."""

    def task(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(CHUNK, ascending=order == "forward", ignore_index=True)
        return fn(group)

    return pieces.groupBy("conv_id").applyInPandas(task, f"conv_id {kind}, {CHUNK} int, _end array<long>, _entry int, _before string")


def _handed_over(chunks: DataFrame) -> DataFrame | None:
    """(conv_id, chunk, _end, _entry, _before) of the pieces of conversations that cross chunks; None without any."""
    kind = chunks.schema["conv_id"].dataType.simpleString()
    crossing = chunks.groupBy(F.col("conv_id").alias("_c")).agg(F.min(CHUNK).alias("_from"), F.max(CHUNK).alias("_to")).filter("_from < _to").select("_c")
    crossing = land(crossing, "crossing")  # fewer rows than chunks
    n = crossing.count()
    if not n:
        return None
    rows = chunks.join(F.broadcast(crossing) if n <= BROADCAST_ROWS else crossing, F.col("conv_id").eqNullSafe(F.col("_c")), "left_semi").select("conv_id", "role", "fault", CHUNK, POS)

    def summed(table: pa.Table, kinds: list[int], pieces: list[Piece]) -> pa.Table:
        role = table.column("role").to_pylist()
        return pa.table({"conv_id": table.column("conv_id").take([p.lo for p in pieces]), CHUNK: table.column(CHUNK).take([p.lo for p in pieces]), "costs": pa.array([piece_costs(kinds[p.lo : p.hi]) for p in pieces], pa.list_(pa.int64())), "last_role": pa.array([role[p.hi - 1][:1] for p in pieces], pa.string())})

    free = rows.withColumn("_entry", F.lit(None).cast("int")).withColumn("_end", F.lit(None).cast("array<long>"))
    sums = land(_in_chunks(free, summed, f"conv_id {kind}, {CHUNK} int, costs array<long>, last_role string"), "pieces")

    def backward(group: pd.DataFrame) -> pd.DataFrame:
        end, ends = _with_inserts(list(_DONE)), []
        for k, flat in enumerate(group["costs"]):
            ends.append(end if k else None)  # the last piece ends the conversation
            end = _with_inserts([min(int(flat[4 * q + r]) + end[r] for r in range(4)) for q in range(4)])
        before = [*group["last_role"][1:], None]
        return pd.DataFrame({"conv_id": group["conv_id"], CHUNK: group[CHUNK], "_end": ends, "_entry": 0, "_before": before})

    ends = land(_of_piece(kind, "backward", backward, sums), "ends")
    on = lambda a, b: F.col(f"{a}.conv_id").eqNullSafe(F.col(f"{b}.conv_id")) & (F.col(f"{a}.{CHUNK}") == F.col(f"{b}.{CHUNK}"))

    def left(table: pa.Table, kinds: list[int], pieces: list[Piece]) -> pa.Table:
        return pa.table({"conv_id": table.column("conv_id").take([p.lo for p in pieces]), CHUNK: table.column(CHUNK).take([p.lo for p in pieces]), "exits": pa.array(Repairs(kinds, pieces).exits(), pa.list_(pa.int32()))})

    known = rows.alias("a").join(ends.alias("b"), on("a", "b")).select("a.*", "b._end", F.lit(None).cast("int").alias("_entry"))
    exits = _in_chunks(known, left, f"conv_id {kind}, {CHUNK} int, exits array<int>")

    def forward(group: pd.DataFrame) -> pd.DataFrame:
        entry, entries = _START, []
        for flat in group["exits"]:
            entries.append(entry)
            entry = int(flat[entry])
        return group[["conv_id", CHUNK, "_end", "_before"]].assign(_entry=entries)[["conv_id", CHUNK, "_end", "_entry", "_before"]]

    both = exits.alias("a").join(ends.alias("b"), on("a", "b")).select("a.*", "b._end", "b._before")
    return land(_of_piece(kind, "forward", forward, both), "handed")


def repair(rows: DataFrame) -> DataFrame:
    """The repair of each conversation, an edited row for each distinct row of a turn.

    ``rows`` has conv_id, turn, role, text and, if wanted, copies (times the row stands there); other
    columns don't matter. Nulls of role and text are one space, conversations without an id are one, and
    turns without a number come first. Rows of one turn go by role and text.

    Gives conv_id, turn, role, text, copies, fault (blank, duplicate, truncated or null, of the first copy),
    edits (letters in order, the extra copies deleted last, then inserts after the conversation's last row),
    lines (the repaired ``role:text`` lines it leaves), cost, illegal (pairs with the row before, and of its
    copies) and the place ``_chunk``, ``_pos`` in the order of all rows.
    """
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    copies = F.col("copies").cast("long") if "copies" in rows.columns else F.lit(1).cast("long")
    kind, turn = (rows.schema[c].dataType.simpleString() for c in ("conv_id", "turn"))
    judged = find_faults(rows.select("conv_id", "turn", spaced("role"), spaced("text"), copies.alias("copies")))
    chunks = ordered_chunks(judged, F.col("conv_id"), F.col("turn"), F.col("role"), F.col("text"))
    handed = _handed_over(chunks)
    if handed is None:
        placed = chunks.withColumns({"_end": F.lit(None).cast("array<long>"), "_entry": F.lit(None).cast("int"), "_before": F.lit(None).cast("string")})
    else:
        few = handed.withColumnsRenamed({"conv_id": "_c", CHUNK: "_k"})
        few = F.broadcast(few) if few.count() <= BROADCAST_ROWS else few  # one row for each chunk that a conversation crosses
        placed = chunks.join(few, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col(CHUNK) == F.col("_k")), "left").drop("_c", "_k")

    def solve(table: pa.Table, kinds: list[int], pieces: list[Piece]) -> pa.Table:
        edits, states = Repairs(kinds, pieces).edits()
        role, text, copies, fault, before = (table.column(c).to_pylist() for c in ("role", "text", "copies", "fault", "_before"))
        lines, cost, illegal = [], [], []
        for p in pieces:
            last = before[p.lo]
            for i in range(p.lo, p.hi):
                said, total, body = [], DELETE * (copies[i] - 1), ""
                for letter, q in zip(edits[i], states[i]):
                    if letter == "I":
                        said.append(f"{_ROLE[q]}:")
                        total += INSERT
                    elif letter == "D":
                        total += DELETE
                    else:
                        said.append(f"{role[i] if letter == 'K' else _ROLE[q]}:{text[i]}")
                        total += (letter == "R") * REROLE + (fault[i] == "truncated") * UNFINISHED
                    body += letter if letter == "I" else letter + "D" * (copies[i] - 1)
                edits[i] = body
                lines.append(said)
                cost.append(total)
                illegal.append(copies[i] - 1 + (last is not None and last + role[i][:1] not in ("su", "ua", "au")))
                last = role[i][:1]
        columns = {c: table.column(c) for c in ("conv_id", "turn", "role", "text", "copies", "fault", CHUNK, POS)}
        return pa.table(columns | {"edits": pa.array(edits, pa.string()), "lines": pa.array(lines, pa.list_(pa.string())), "cost": pa.array(cost, pa.int64()), "illegal": pa.array(illegal, pa.int64())})

    return _in_chunks(placed, solve, f"conv_id {kind}, turn {turn}, role string, text string, copies long, fault string, {CHUNK} int, {POS} long, edits string, lines array<string>, cost long, illegal long")


_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def report(repaired: DataFrame) -> DataFrame:
    """One row for each conversation: counts, cost, audit and the hash of its lines.

    The hash runs over the rows in order, so a conversation's rows pass through one task as a stream.
    """
    n, first = F.col("copies"), F.col("fault")
    counts = {"blank": F.when(first == "blank", n), "duplicate": F.when(first == "duplicate", n).when(first.isNull() | (first == "truncated"), n - 1), "truncated": F.when(first == "truncated", 1)}
    sums = [F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(k) for k, c in counts.items()]
    turns = F.max("turn").cast("long") - F.min("turn").cast("long") + 1
    told = repaired.groupBy("conv_id", "turn").agg(*sums, F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"))
    told = told.groupBy("conv_id").agg(F.coalesce(turns - F.count("turn"), F.lit(0)).alias("gaps"), *[F.sum(c).alias(c) for c in _COUNTS[1:]])
    kind = repaired.schema["conv_id"].dataType.simpleString()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, audit, sha, started, lines = None, [], None, False, 0

        def done():
            return pa.RecordBatch.from_arrays([pa.array([conv], kinds), pa.array(["".join(audit)]), pa.array([sha.hexdigest()])], ["_c", "audit", "repaired_sha256"])

        for batch in batches:
            kinds = batch.column(0).type
            for c, letters, said in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if not started or c != conv:
                    if started:
                        yield done()
                    conv, audit, sha, started, lines = c, [], hashlib.sha256(), True, 0
                audit.append(letters)
                for line in said:
                    sha.update((("\n" if lines else "") + line).encode())
                    lines += 1
        if started:
            yield done()

    ordered = repaired.select("conv_id", "edits", "lines", CHUNK, POS).repartition("conv_id").sortWithinPartitions("conv_id", CHUNK, POS)
    heard = ordered.mapInArrow(task, f"_c {kind}, audit string, repaired_sha256 string")
    return told.join(heard, F.col("conv_id").eqNullSafe(F.col("_c"))).drop("_c")


# The same DP forwards: s0 .. s3 hold the least (cost, audit) of each state, with the lines it leaves.
_TAIL = "right(rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1)"


def _sql_step(q: int, cost: str, letter: str, line: str = "''") -> str:
    return f"{{'c': s{q}.c + {cost}, 'a': s{q}.a || '{letter}', 'l': s{q}.l || {line}}}"


def _sql_if(condition: str, then: str) -> str:
    return f"CASE WHEN {condition} THEN {then} ELSE {{'c': {_FAR}, 'a': '', 'l': ''}} END"


def _sql_states() -> str:
    """The states after a row without inserts (n0 .. n3)."""
    options = {q: [_sql_step(q, str(DELETE), "D")] for q in range(4)}
    line = {"K": "chr(10) || role || ':' || text", _USER: "chr(10) || 'user:' || text", _ASSISTANT: "chr(10) || 'assistant:' || text"}
    for initial, q, after in [("s", _START, _SYSTEM), *[("u", q, _USER) for q in (_START, _SYSTEM, _ASSISTANT)], ("a", _USER, _ASSISTANT)]:
        options[after].append(_sql_if(f"free AND initial = '{initial}'", _sql_step(q, "late", "K", line["K"])))
    for q in range(4):
        options[_NEXT[q]].append(_sql_if("free", _sql_step(q, f"{REROLE} + late", "R", line[_NEXT[q]])))
    return ", ".join(f"least({', '.join(o)}) AS n{q}" if len(o) > 1 else f"{o[0]} AS n{q}" for q, o in options.items())


def _sql_insert(node: str, role: str) -> str:
    return f"{{'c': {node}.c + {INSERT}, 'a': {node}.a || 'I', 'l': {node}.l || chr(10) || '{role}:'}}"


_SQL = f"""
    WITH RECURSIVE named AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
    drawn AS (SELECT *, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), [CAST(ord(x) AS BIGINT) FOR x IN string_split(k, '')]), lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda v, i: xor(v >> 1, CAST(3988292384 AS BIGINT) * (v & 1))))) % 20 AS m FROM named),
    damaged AS (SELECT conv_id, turn, CASE WHEN m = 4 THEN 'user' ELSE role END AS role, CASE m WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN m = 3 THEN 2 ELSE 1 END)) AS copy FROM drawn WHERE m <> 0),
    judged AS (SELECT *, left(role, 1) AS initial, row_number() OVER w AS j, left(lag(role) OVER w, 1) AS before,
        CASE WHEN {_TAIL} = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 THEN 'duplicate' WHEN {_TAIL} NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault
        FROM damaged WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)),
    lines AS MATERIALIZED (SELECT *, fault NOT IN ('blank', 'duplicate') AS free, CAST(fault = 'truncated' AS BIGINT) AS late FROM judged),
    walk AS (
        SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS j, {{'c': CAST(0 AS BIGINT), 'a': '', 'l': ''}} AS s0, {{'c': CAST({_FAR} AS BIGINT), 'a': '', 'l': ''}} AS s1, {{'c': CAST({INSERT} AS BIGINT), 'a': 'I', 'l': chr(10) || 'user:'}} AS s2, {{'c': CAST({2 * INSERT} AS BIGINT), 'a': 'II', 'l': chr(10) || 'user:' || chr(10) || 'assistant:'}} AS s3 FROM lines
        UNION ALL
        SELECT conv_id, j, n0, n1, c2, least(n3, {_sql_insert("c2", "assistant")})
        FROM (SELECT *, least(n2, {_sql_insert("n0", "user")}, {_sql_insert("n1", "user")}, {_sql_insert("n3", "user")}) AS c2
            FROM (SELECT lines.conv_id, lines.j, {_sql_states()} FROM walk JOIN lines ON lines.conv_id IS NOT DISTINCT FROM walk.conv_id AND lines.j = walk.j + 1))),
    told AS (SELECT conv_id, max(j) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
        count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM lines GROUP BY conv_id),
    best AS (SELECT told.*, least(s0, s3) AS s FROM told JOIN walk ON told.conv_id IS NOT DISTINCT FROM walk.conv_id AND walk.j = told.n)
    SELECT every.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(s.c, 0) AS cost, coalesce(s.a, '') AS audit, sha256(coalesce(substr(s.l, 2), '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) every LEFT JOIN best ON every.conv_id IS NOT DISTINCT FROM best.conv_id
"""


@query("op12_conversations", _SQL)
def op12_conversations(spark, folder):
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    found = report(land(repair(damage(rows)), "repaired"))
    every = rows.select(F.col("conv_id").alias("_every")).distinct()
    out = every.join(found, F.col("_every").eqNullSafe(F.col("conv_id")), "left")
    return out.select(F.col("_every").alias("conv_id"), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in _COUNTS], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
