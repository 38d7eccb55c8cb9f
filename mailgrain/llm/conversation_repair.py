"""Conversation structure repair by a secondary-sorted stream with dynamic programming.

Rows are dealt by conversation and sorted by turn; one pass reads every conversation as a stream over Arrow batches and
carries the state of the cheapest repairs: per grammar state its cost, its place in the order of the edit strings so far
and the running hash of the repaired text. Nothing else of a conversation is kept but one 32-bit backpointer word per
row. When a conversation has more than `block_rows` rows, full blocks of backpointers leave the task as rows of a
table in the shared folder; a second pass walks these blocks backwards. So memory does not grow with a conversation,
but for its one answer, and a lost executor loses nothing that Spark can't make again. One conversation is one stream
by definition (its hash runs over its whole text); conversations are spread over tasks.

Edits of a row: K keep (0), R set role user or assistant (1), D delete (2, required for blank and repeated rows);
I inserts an empty user or assistant row anywhere (5). Every truncated row that stays adds 5. The role initials of the
result match `(s?(ua)+)?`. Of the cheapest edits the ASCII-least string wins.

Given a prefix of edits the next role is forced, so equal edit strings are equal repairs; at the end of a row no edit
string of another state is a proper prefix of this one, so their order is one rank per state and strings are never built
before the end.

Null conv_id is one conversation of its own; a null turn sorts first; null role or text count as one space (a role that
is neither s, u nor a can't be kept, an empty role neither). Rows of the same turn follow role, then text. Repeated rows
are rows like others. A conversation whose rows were all dropped, and an empty table, give zeros or no rows. Columns
beyond the four are ignored, whatever their names.
"""

import hashlib
from array import array

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

START, SYSTEM, USER, ASSISTANT = range(4)
DELETE, KEEP, REROLE = range(3)
LETTERS = "DKR"
INSERT_COST, TRUNCATED_COST, OP_COST = 5, 5, (2, 0, 1)
CLEAN, BLANK, DUPLICATE, TRUNCATED, DROPPED = range(5)
FAULTS = ("blank", "duplicate", "truncated")
LEGAL = {"su", "ua", "au"}
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def damaged(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, role, text, gone): the rows after damage; dropped rows stay as empty rows with `gone`, so that every conversation is seen."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = rows.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), blank(role).alias("role"), blank(text).alias("text"),
                       (F.crc32(F.concat(blank(conv), F.lit(":"), blank(turn)).cast("binary")) % 20).alias("hit"))
    gone = F.col("hit") == 0
    text = F.when(F.col("hit") <= 1, "").when(F.col("hit") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(gone, "").when(F.col("hit") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv", "turn", role.alias("role"), text.alias("text"), gone.alias("gone"),
                       F.explode(F.array_repeat(F.lit(0), F.when(F.col("hit") == 3, 2).otherwise(1))).alias("copy")).drop("copy")


def faults(rows: DataFrame) -> DataFrame:
    """`rows` as from `damaged`, dealt by conversation, with `fault`: each row's first one.

    The window needs no shuffle of its own: rows of one conversation are together already."""
    seen = Window.partitionBy("conv", "gone", "role", "text").orderBy(F.col("turn").asc_nulls_first())
    ends = F.rlike("text", F.lit(r"[.!?][\x20\x09-\x0D]*\z"))
    fault = F.when(F.col("gone"), DROPPED).when(~F.rlike("text", F.lit(r"[^\x20\x09-\x0D]")), BLANK).when(
        F.row_number().over(seen) > 1, DUPLICATE).when(~ends, TRUNCATED).otherwise(CLEAN)
    return rows.repartition("conv").withColumn("fault", fault)


def _inserted(state: int, k: int) -> tuple:
    """State after k inserts, and the roles inserted."""
    roles = []
    for _ in range(k):
        roles.append("assistant" if state == USER else "user")
        state = ASSISTANT if state == USER else USER
    return state, roles


def _emitted(state: int, initial: str):
    """State after a row of that initial, or None."""
    if initial == "s":
        return SYSTEM if state == START else None
    if initial == "u":
        return None if state == USER else USER
    return ASSISTANT if initial == "a" and state == USER else None


def _moves(initial: str, fault: int):
    """[(source, target, cost, letters, code, roles, own)]: the best way between any two states over one row."""
    best = {}
    for source in range(4):
        for k in range(3):
            middle, roles = _inserted(source, k)
            ways = [(DELETE, middle, None)]
            if fault in (CLEAN, TRUNCATED):
                kept = _emitted(middle, initial)
                if kept is not None:
                    ways.append((KEEP, kept, ""))
                ways.append((REROLE, *((ASSISTANT, "assistant") if middle == USER else (USER, "user"))))
            for op, target, own in ways:
                cost = INSERT_COST * k + OP_COST[op] + (TRUNCATED_COST if fault == TRUNCATED and op != DELETE else 0)
                move = (cost, "I" * k + LETTERS[op], source | k << 2 | op << 4, roles, own)
                if (source, target) not in best or move[:2] < best[source, target][:2]:
                    best[source, target] = move
    return [(s, t, *move) for (s, t), move in best.items()]


MOVES = {(i, f): _moves(i, f) for i in ("s", "u", "a", "") for f in (CLEAN, BLANK, DUPLICATE, TRUNCATED)}
FINISH = {START: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}  # inserts that end a repair


class Stream:
    """State of one conversation."""

    def __init__(self, block_rows: int):
        self.block_rows, self.plans = block_rows, {}
        self.begin(None)

    def begin(self, conv):
        self.conv, self.rows, self.blocks = conv, 0, 0
        self.counts = dict.fromkeys(COUNTS, 0)
        self.base, self.costs, self.ranks = 0, (0, None, None, None), (0, None, None, None)
        self.hashes = [hashlib.sha256(), None, None, None]
        self.back = array("I")
        self.low = self.high = self.turn = None
        self.turns, self.initial = 0, None

    def _plan(self, initial, fault):
        """What one row does to costs (less their smallest) and ranks; met again and again, so it is kept."""
        key = (initial, fault, self.costs, self.ranks)
        if key not in self.plans:
            best = {}
            for source, target, cost, letters, code, roles, own in MOVES[initial, fault]:
                if self.costs[source] is not None:
                    found = (self.costs[source] + cost, self.ranks[source], letters, source, code, roles, own)
                    if target not in best or found[:3] < best[target][:3]:
                        best[target] = found
            least = min(b[0] for b in best.values())
            order = sorted(best, key=lambda t: best[t][1:3])
            self.plans[key] = (
                least, tuple(best[t][0] - least if t in best else None for t in range(4)),
                tuple(order.index(t) if t in best else None for t in range(4)),
                sum(b[4] << 6 * t for t, b in best.items()),
                [(t, b[3], [r.encode() + b":" for r in b[5]], b[6]) for t, b in best.items()])
        return self.plans[key]

    def row(self, turn, role, text, fault):
        counts, initial = self.counts, role[:1]
        if fault in (BLANK, DUPLICATE, TRUNCATED):
            counts[FAULTS[fault - 1]] += 1
        if self.rows and self.initial + initial not in LEGAL:
            counts["illegal"] += 1
        self.initial = initial
        self.rows += 1
        if turn is not None:
            if self.low is None:
                self.low = turn
            self.turns += turn != self.turn
            self.high = self.turn = turn
        least, self.costs, self.ranks, code, steps = self._plan(initial if initial in ("s", "u", "a") else "", fault)
        self.base += least
        self.back.append(code)
        before, after = self.hashes, [None] * 4
        for target, source, inserts, own in steps:
            lines = inserts if own is None else [*inserts, f"{own or role}:{text}".encode()]
            after[target] = _extended(before[source], source == START, lines)
        self.hashes = after

    def spilled(self):
        """A full block of backpointers as a row, or None."""
        if len(self.back) < self.block_rows:
            return None
        return self._block()

    def _block(self, **more):
        out = dict(conv=self.conv, seq=self.blocks, block=self.back.tobytes(), **more)
        self.blocks += 1
        self.back = array("I")
        return out

    def end(self):
        ways = [(self.costs[s] + INSERT_COST * k, self.ranks[s], "I" * k, s, k) for s, k in FINISH.items() if self.costs[s] is not None]
        cost, _, _, state, k = min(ways)
        _, roles = _inserted(state, k)
        digest = _extended(self.hashes[state], state == START, [r.encode() + b":" for r in roles]).hexdigest()
        self.counts["cost"] = self.base + cost
        if self.low is not None:
            self.counts["gaps"] = self.high - self.low + 1 - self.turns
        made = dict(self.counts, repaired_sha256=digest)
        if self.blocks:
            return self._block(last=state | k << 2, **made)
        return dict(conv=self.conv, seq=0, audit=walked(self.back, state)[0] + "I" * k, **made)


def _extended(old, empty: bool, lines):
    if not lines:
        return old
    new = old.copy()
    new.update((b"" if empty else b"\n") + b"\n".join(lines))
    return new


def walked(back, state: int):
    """(edit string, state before): follows backpointers from `state` after the last row to the first."""
    letters = []
    for code in reversed(back):
        mine = code >> 6 * state & 63
        letters.append("I" * (mine >> 2 & 3) + LETTERS[mine >> 4])
        state = mine & 3
    return "".join(reversed(letters)), state


STREAMED = "conv string, seq int, audit string, repaired_sha256 string, last int, block binary, " + ", ".join(f"{c} long" for c in COUNTS)
_COLUMNS = ["conv", "seq", "audit", "repaired_sha256", "last", "block", *COUNTS]


def _frame(rows):
    out = pd.DataFrame(rows, columns=_COLUMNS, dtype=object)
    return out.astype({c: "Int64" for c in (*COUNTS, "seq", "last")})


def streamed(rows: DataFrame, block_rows: int = 1 << 20) -> DataFrame:
    """One row per conversation, or for a giant one a row per block of backpointers; the last one holds its counts."""

    def run(batches):
        stream, started = Stream(block_rows), False
        for batch in batches:
            out = []
            # the running hash needs whole rows in order; everything else of a row is a look-up
            for conv, turn, role, text, fault in zip(*(batch[c].tolist() for c in ("conv", "turn", "role", "text", "fault"))):
                if not started or conv != stream.conv:
                    if started:
                        out.append(stream.end())
                    stream.begin(conv)
                    started = True
                if fault != DROPPED:
                    stream.row(None if turn is None else int(turn), role, text, fault)
                    block = stream.spilled()
                    if block:
                        out.append(block)
            yield _frame(out)
        if started:
            yield _frame([stream.end()])

    ordered = faults(rows).sortWithinPartitions("conv", F.col("turn").asc_nulls_first(), "role", "text")
    text = lambda c: F.col(c).cast("string").alias(c)  # pandas has no whole numbers beside nulls
    return ordered.select(text("conv"), text("turn"), "role", "text", "fault").mapInPandas(run, STREAMED)


def _unwound(blocks: DataFrame) -> DataFrame:
    """(conv, audit) of giant conversations: their blocks walked from the last to the first."""

    def run(batches):
        conv, state, pieces, tail, started = None, 0, [], "", False
        for batch in batches:
            for key, last, block in zip(batch["conv"].tolist(), batch["last"].tolist(), batch["block"].tolist()):
                if not started or key != conv:
                    if started:
                        yield pd.DataFrame({"conv": [conv], "audit": ["".join(reversed(pieces)) + tail]})
                    conv, state, tail, pieces, started = key, int(last) & 3, "I" * (int(last) >> 2), [], True
                back = array("I")
                back.frombytes(block)
                piece, state = walked(back, state)
                pieces.append(piece)
        if started:
            yield pd.DataFrame({"conv": [conv], "audit": ["".join(reversed(pieces)) + tail]})

    ordered = blocks.repartition("conv").sortWithinPartitions("conv", F.desc("seq"))
    return ordered.select("conv", "last", "block").mapInPandas(run, "conv string, audit string")


def repaired(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", block_rows: int = 1 << 20) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256): one row per conversation of `rows` (as they are, see `damaged`)."""
    kind = dict(rows.dtypes)[conv]
    made = written(streamed(damaged(rows, conv, turn, role, text), block_rows), "repairs")
    columns = [F.col("conv").cast(kind).alias(conv), *COUNTS, "audit", "repaired_sha256"]
    small = made.where("block IS NULL").select(*columns)
    giant = made.where("block IS NOT NULL")
    audits = _unwound(giant).withColumnRenamed("conv", "owner")
    ends = giant.where("last IS NOT NULL").drop("audit")
    return small.unionByName(ends.join(audits, F.col("conv").eqNullSafe(F.col("owner"))).select(*columns))
