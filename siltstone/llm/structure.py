"""Conversation structure repair by lazy weighted determinisation.

Allowed conversations are those whose role initials read (s?(ua)+)?; the edits of a turn and the insertions between turns are the weighted
arcs of an automaton over that pattern. Its determinisation is lazy: the costs of the four pattern states, less the smallest, are a
state of the determinised automaton, found when a conversation first leads there and cached with its arcs in a transition table. A pattern state that can't be
on a cheapest path any more is dropped from the vector (GREED bounds what one state's future may cost above another's), so there are
finitely many vectors, about as many as there are symbols. One scan of the table gives the cost. Table cells also hold which arcs are tight (cost
of start plus weight equals cost of end); a scan backward along tight arcs marks what reaches an end, and a walk forward takes the least
letter there, which gives the audit.

A turn is a byte here: its role's initial and its first fault. A conversation is one stretch of a sorted partition, read as a stream: no text
is held, but a byte a turn is (its audit is as long). Texts meet their edits by place, and the repaired text is hashed as it streams by.

Edits: K keep, R give the role of user or assistant (COST_REROLE), D delete (COST_DELETE; blank and duplicate turns must go), I insert an empty turn
of either (COST_INSERT); a truncated turn that stays adds COST_TRUNCATED. Of equal costs the ASCII-least audit counts.

Defined cases: null roles and texts are one space; turns are in order of turn (nulls first), then role, then text; null conversation ids form one
conversation; rows that repeat a turn stay, as a duplicate if role and text are equal; a role without a first letter s, u or a can't be kept; an empty table gives an empty
result; other columns are ignored. Running lengths, costs and counts are longs.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.common import forget, materialise

WHITE = " \t\n\x0b\x0c\r"
COST_REROLE, COST_DELETE, COST_INSERT, COST_TRUNCATED = 3, 4, 3, 3
NOTHING, SYSTEM, USER, PAIR = range(4)  # what has been read: nothing; s; ... u; ... ua
NEXT = {(NOTHING, "s"): SYSTEM, (NOTHING, "u"): USER, (SYSTEM, "u"): USER, (PAIR, "u"): USER, (USER, "a"): PAIR}
ENDS = (NOTHING, PAIR)
#: From PAIR all goes on that goes on from NOTHING, but for a system turn, which it can delete; and all that goes on from SYSTEM.
GREED = {NOTHING: COST_DELETE, SYSTEM: 0}
SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)
INITIALS = "?sua"
ROLES = {"u": "user", "a": "assistant"}
LEGAL = {"su", "ua", "au"}
FAR = 1 << 60


class Automaton:
    """The determinised automaton, as far as it has been asked for. A symbol is 4 * initial + fault."""

    def __init__(self) -> None:
        self.names: dict[tuple[int, ...], int] = {}
        self.vectors: list[tuple[int, ...]] = []
        self.table: list[list[tuple[int, int] | None]] = []  # state, symbol -> state, cost
        self.backs: dict[tuple[int, int], list[int]] = {}
        self.start = self._named(self._closed([0, FAR, FAR, FAR]))[0]

    @staticmethod
    def _closed(costs: list[int]) -> list[int]:
        """Insertions may follow, three at most before a state comes again; then states that can't win are dropped."""
        costs = list(costs)
        for _ in range(3):
            for (p, _), q in ((k, q) for k, q in NEXT.items() if k[1] != "s"):
                costs[q] = min(costs[q], costs[p] + COST_INSERT)
        return [FAR if p in GREED and c > costs[PAIR] + GREED[p] else c for p, c in enumerate(costs)]

    def _named(self, costs: list[int]) -> tuple[int, int]:
        least = min(costs)
        vector = tuple(min(c - least, FAR) if c < FAR else FAR for c in costs)
        if vector not in self.names:
            self.names[vector] = len(self.vectors)
            self.vectors.append(vector)
            self.table.append([None] * 16)
        return self.names[vector], least

    @staticmethod
    def arcs(symbol: int) -> list[tuple[str, int, int, int, str]]:
        """letter, from, to, cost, role letter ('' keeps the role or there is none)."""
        initial, fault = INITIALS[symbol >> 2], symbol & 3
        out = [("D", p, p, COST_DELETE, "") for p in range(4)]
        if fault in (SOUND, TRUNCATED):
            more = COST_TRUNCATED * (fault == TRUNCATED)
            out += [("K", p, q, more, "") for (p, x), q in NEXT.items() if x == initial]
            out += [("R", p, q, more + COST_REROLE, x) for (p, x), q in NEXT.items() if x != "s"]
        return out

    def step(self, state: int, symbol: int) -> tuple[int, int]:
        found = self.table[state][symbol]
        if found is None:
            costs = [FAR] * 4
            for _, p, q, w, _ in self.arcs(symbol):
                costs[q] = min(costs[q], self.vectors[state][p] + w)
            found = self.table[state][symbol] = self._named(self._closed(costs))
        return found

    def inserted(self, state: int, ends: int) -> int:
        """States from which tight insertions lead to one of the ends (bit sets), those among them."""
        v = self.vectors[state]
        for _ in range(3):
            for (p, x), q in NEXT.items():
                if x != "s" and ends >> q & 1 and v[p] + COST_INSERT == v[q] < FAR:
                    ends |= 1 << p
        return ends

    def back(self, state: int, symbol: int) -> list[int]:
        """For each set of states after the symbol, the states before it from which tight arcs lead there."""
        if (state, symbol) not in self.backs:
            after, least = self.step(state, symbol)
            v, w = self.vectors[state], self.vectors[after]
            tight = [(p, q) for _, p, q, c, _ in self.arcs(symbol) if v[p] < FAR and w[q] < FAR and v[p] + c == w[q] + least]
            self.backs[state, symbol] = [self.inserted(state, sum({1 << p for p, q in tight if ends >> q & 1})) for ends in range(16)]
        return self.backs[state, symbol]

    def scan(self, symbols: bytes) -> tuple[int, array, int]:
        """Cost of the cheapest repair, the states on the way, and the cost of the best end above the last state's least."""
        states, cost, table = array("I", [self.start]), 0, self.table
        at = self.start
        for s in symbols:
            at, more = table[at][s] or self.step(at, s)
            cost += more
            states.append(at)
        best = min(self.vectors[at][p] for p in ENDS)
        return cost + best, states, best

    def audit(self, symbols: bytes, states: array, best: int) -> Iterator[tuple[str, str]]:
        """For each turn, and the end, the letters of its edits (insertions before it first) and the role letters that these give (- for none)."""
        n, last = len(symbols), self.vectors[states[-1]]
        alive = bytearray(n + 1)
        alive[n] = self.inserted(states[n], sum(1 << p for p in ENDS if last[p] == best))
        for i in range(n - 1, -1, -1):
            alive[i] = self.back(states[i], symbols[i])[alive[i + 1]]
        at = NOTHING  # edits so far settle the roles so far, and so the state
        for i in range(n + 1):
            v, letters, roles = self.vectors[states[i]], "", ""
            while True:
                tight = []
                if i < n:
                    w, more = self.vectors[states[i + 1]], self.step(states[i], symbols[i])[1]
                    tight = [(a, q, r or "-") for a, p, q, c, r in self.arcs(symbols[i]) if p == at and w[q] < FAR and v[p] + c == w[q] + more and alive[i + 1] >> q & 1]
                elif at in ENDS and v[at] == best:
                    break
                tight += [("I", q, x) for (p, x), q in NEXT.items() if x != "s" and p == at and v[p] + COST_INSERT == v[q] < FAR and alive[i] >> q & 1]
                letter, at, role = min(tight)
                letters, roles = letters + letter, roles + role
                if letter != "I":
                    break
            yield letters, roles


def turns(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv (the id as a string, one space for null), place (from 1), turn, role, text, symbol: the turns of each conversation in order,
    with initial and first fault. Earlier copies are found by the first place of each role and text, which is met by place, so a turn that
    repeats a million times is no hot key."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    own = rows.select(space(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), space(role_col).alias("role"), space(text_col).alias("text"))
    order = Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    placed = materialise(own.withColumn("place", F.row_number().over(order).cast("long")), "turns")
    firsts = placed.groupBy("conv", "role", F.sha2("text", 256).alias("_text")).agg(F.min("place").alias("place")).select("conv", "place", F.lit(True).alias("_first"))
    end = F.rtrim("text", F.lit(WHITE))
    fault = F.when(end == "", BLANK).when(F.col("_first").isNull(), DUPLICATE).when(~F.right(end, F.lit(1)).isin(".", "!", "?"), TRUNCATED).otherwise(SOUND)
    initial = F.instr(F.lit(INITIALS[1:]), F.when(F.left("role", F.lit(1)).isin(*INITIALS[1:]), F.left("role", F.lit(1))).otherwise("-"))
    out = materialise(placed.join(firsts, ["conv", "place"], "left").select("conv", "place", "turn", "role", "text", (initial * 4 + fault).cast("int").alias("symbol")), "turns")
    forget(rows.sparkSession, placed)
    return out


def _streams(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[str, Iterator[pd.DataFrame]]]:
    """Groups of consecutive rows of one conversation, as streams of frames."""
    held: list[pd.DataFrame] = []
    frames = iter(frames)

    def pull() -> bool:
        while not held:
            frame = next(frames, None)
            if frame is None:
                return False
            if len(frame):
                held.append(frame)
        return True

    def run(conv: str) -> Iterator[pd.DataFrame]:
        while pull() and held[0]["conv"].iloc[0] == conv:
            frame = held.pop()
            cut = int((frame["conv"].to_numpy() != conv).argmax()) if frame["conv"].iloc[-1] != conv else len(frame)
            if cut < len(frame):
                held.append(frame[cut:])
            yield frame[:cut]

    while pull():
        conv = held[0]["conv"].iloc[0]
        stream = run(conv)
        yield conv, stream
        for _ in stream:
            pass


EDITS = "conv string, place long, edits string, roles string, audit string, blank long, duplicate long, truncated long, illegal long, cost long"


def _edit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row a turn with its edits, and one at the end of each conversation (place n + 1) with its measures."""
    automaton, held = Automaton(), []
    for conv, stream in _streams(frames):
        symbols = b"".join(frame["symbol"].to_numpy("uint8").tobytes() for frame in stream)
        cost, states, best = automaton.scan(symbols)
        codes, audit = np.frombuffer(symbols, np.uint8), bytearray()
        pairs, faults = np.bincount((codes[:-1] >> 2) * 4 + (codes[1:] >> 2), minlength=16), np.bincount(codes & 3, minlength=4)
        illegal = sum(int(n) for at, n in enumerate(pairs) if INITIALS[at >> 2] + INITIALS[at & 3] not in LEGAL)
        for place, (letters, roles) in enumerate(automaton.audit(symbols, states, best), 1):
            audit += letters.encode()
            ends = (audit.decode(), int(faults[BLANK]), int(faults[DUPLICATE]), int(faults[TRUNCATED]), illegal, cost) if place == len(states) else (None,) * 6
            held.append((conv, place, letters, roles, *ends))
            if len(held) >= 10000:
                yield _edited(held)
                held = []
    if held:
        yield _edited(held)


def _edited(rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=[c.split()[0] for c in EDITS.split(", ")])
    return frame.astype({c: "Int64" for c in frame.columns[5:]})


def edits(ordered: DataFrame) -> DataFrame:
    """conv, place, edits, roles and, at place n + 1, the audit and the measures of the conversation. ordered: as turns() gives."""
    stream = _by_conversation(ordered.select("conv", "place", "symbol"), "place")
    return materialise(stream.mapInPandas(_edit, EDITS), "edits")


def repaired(ordered: DataFrame, made: DataFrame) -> DataFrame:
    """conv, place, nth, role, text: the turns of the repaired conversations, in order of place and nth."""
    both = made.select("conv", "place", "edits", "roles").join(ordered.select("conv", "place", "role", "text"), ["conv", "place"], "left")
    steps = both.select("conv", "place", "role", "text", F.posexplode(F.split("edits", "")).alias("nth", "edit"), "roles").where("edit in ('I', 'K', 'R')")
    letter = F.substring("roles", F.col("nth") + 1, F.lit(1))
    given = F.when(letter == "u", "user").otherwise("assistant")
    return steps.select("conv", "place", "nth", F.when(F.col("edit") == "K", F.col("role")).otherwise(given).alias("role"), F.when(F.col("edit") == "I", "").otherwise(F.col("text")).alias("text"))


def _hash(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for conv, stream in _streams(frames):
        digest, lead = hashlib.sha256(), ""
        for frame in stream:
            for piece in frame["piece"]:
                digest.update((lead + piece).encode("utf-8", "surrogatepass"))
                lead = "\n"
        yield pd.DataFrame({"conv": [conv], "repaired_sha256": [digest.hexdigest()]})


def _by_conversation(rows: DataFrame, *order: str) -> DataFrame:
    return rows.repartition("conv").sortWithinPartitions("conv", *order)


def damage(rows: DataFrame, every: int = 20, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The four columns with planted faults, by crc32 of "conv:turn" modulo every: 0 drops, 1 empties, 2 removes sentence ends, 3 repeats, 4 gives the role user."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    lot: Column = F.crc32(F.concat(space(conv_col), F.lit(":"), space(turn_col)).cast("binary")) % every
    hurt = rows.select(F.col(conv_col), F.col(turn_col), F.when(lot == 4, "user").otherwise(space(role_col)).alias(role_col),
                       F.when(lot == 1, "").when(lot == 2, F.translate(space(text_col), ".!?", "")).otherwise(space(text_col)).alias(text_col), lot.alias("_lot")).where("_lot <> 0")
    copies = F.when(F.col("_lot") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return hurt.withColumn("_copy", F.explode(copies)).drop("_lot", "_copy")


def report(original: DataFrame, rows: DataFrame, **columns: str) -> DataFrame:
    """conv_id of every conversation of original, with the gaps, faults, cost, audit and digest of the repair of its rows. Gaps too many for a long are its largest."""
    ordered = turns(rows, **columns)
    made = edits(ordered)
    ids = original.select(F.col(columns.get("conv_col", "conv_id")).alias("conv_id")).distinct().withColumn("conv", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")))
    spread = F.max("turn").cast("decimal(20,0)") - F.min("turn").cast("decimal(20,0)") + 1 - F.count_distinct("turn")
    gaps = ordered.groupBy("conv").agg(F.least(spread, F.lit(2**63 - 1)).cast("long").alias("gaps"))
    measures = made.where("cost is not null").select("conv", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    pieces = repaired(ordered, made).select("conv", "place", "nth", F.concat("role", F.lit(":"), "text").alias("piece"))
    hashes = _by_conversation(pieces, "place", "nth").mapInPandas(_hash, "conv string, repaired_sha256 string")
    out = ids.join(gaps, "conv", "left").join(measures, "conv", "left").join(hashes, "conv", "left")
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    out = out.fillna(0, names).fillna({"audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()}).select("conv_id", *names, "audit", "repaired_sha256")
    out = materialise(out, "structure")
    for gone in (ordered, made):
        forget(out.sparkSession, gone)
    return out
