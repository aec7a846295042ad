"""Conversation structure repair: cheapest edits by a time-major dynamic program in numpy.

A conversation's roles are to read ``(s?(ua)+)?`` by their initials. Keeping a row costs 0, giving it the
role user or assistant 3, deleting it 4 (blank rows and repeats must go), inserting an empty user or
assistant row 3; a truncated row that stays costs 3 more. Four states tell where a reading
stands: at the start, after s, after u, after a.

The rows of a conversation are brought together by one shuffle and sorted there. What the program
needs of a row (initial, blank, truncated, a digest of role and text) goes to numpy in Arrow
batches; texts stay on the JVM. Conversations are put in buckets by length, a power of two; a
bucket is a tensor with time as its first axis: from the last row to the first, one step
updates the four costs of all its conversations, and the costs of every step are stored. The
edits are then traced forwards, one step of all conversations at a time, always by the least letter
that keeps the least cost, which gives the least string. A bucket is worked on CELLS rows at
a time, so memory is bounded by that and by the longest conversation.

Defined results. Null roles and texts are one space. Rows go by turn (nulls first), then by role and text. A null conv_id is
a conversation of its own. A row counts as blank before duplicate before truncated; a repeat is a row
whose role and text stand earlier, found by 128 bits of a digest. A role that is empty or begins with
another letter than s, u, a can't be kept. A conversation without rows has costs and counts of zero, no
edits and no text. A conversation is one value: its rows are in one task, and Spark's bound of a
value, 2 GB, holds for it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.plans.columns import settled

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
SPACE = " \t\n\u000b\f\r"
#: States: start, after s, after u, after a; the state after the one letter that a user or assistant row may add in each.
NEXT = np.array([2, 2, 3, 2])
#: State after keeping a row of initial s, u, a in each state; -1: not allowed.
KEPT = np.array([[1, 2, -1], [-1, 2, -1], [-1, -1, 3], [-1, 2, -1]])
NEVER = 1 << 29
CELLS = 1 << 20

RESULT = "blank long, duplicate long, truncated long, illegal long, cost long, audit string, made array<int>"


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text as the contract's damage leaves them: some dropped, emptied, cut, repeated, or with another role."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = rows.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), (F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20).alias("harm"))
    harm = F.col("harm")
    text = F.when(harm == 1, "").when(harm == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(harm == 4, "user").otherwise(F.col("role"))
    copies = F.when(harm == 3, 2).when(harm == 0, 0).otherwise(1)
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copies"))


def gathered(rows: DataFrame) -> DataFrame:
    """One row for each conversation (conv_id, turn, role, text, copies): its log, sorted, without rows of no copies."""
    # With every conversation in the groups, those that lost all rows are there too.
    logs = rows.groupBy("conv_id").agg(F.collect_list(F.when(F.col("copies") > 0, F.struct("turn", "role", "text", "copies"))).alias("log"))
    repeated = F.flatten(F.transform(F.array_sort("log"), lambda r: F.array_repeat(F.struct(r.turn.alias("turn"), r.role.alias("role"), r.text.alias("text")), r.copies)))
    return settled(logs, rows=repeated).drop("log")


def marks(row: Column) -> Column:
    """A row's code: its initial (0 s, 1 u, 2 a, 3 other), 4 more if blank, 8 more if truncated."""
    initial, solid = F.substring(row.role, 1, 1), F.translate(row.text, SPACE, "")
    blank = F.length(solid) == 0
    cut = ~F.substring(solid, -1, 1).isin(".", "!", "?")
    first = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    return first + F.when(blank, 4).when(cut, 8).otherwise(0)


def repeats(owner: np.ndarray, digests: np.ndarray) -> np.ndarray:
    """Which rows have the digests of an earlier row of the same owner; rows stand in order of owner and place."""
    order = np.lexsort((np.arange(len(owner)), digests[:, 1], digests[:, 0], owner))
    same = (owner[order[1:]] == owner[order[:-1]]) & (digests[order[1:]] == digests[order[:-1]]).all(1)
    found = np.zeros(len(owner), bool)
    found[order[1:][same]] = True
    return found


def costs(initial: np.ndarray, must_go: np.ndarray, cut: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Least costs [row, conversation, state] of what follows; rows beyond a conversation's size change nothing."""
    n_rows, n = initial.shape
    held = np.empty((n_rows + 1, n, 4), np.int32)
    held[n_rows] = (0, 2 * INSERT, INSERT, 0)
    # With a column for an initial that can't be kept, and a fifth state that is never left.
    keep = np.where(KEPT < 0, 4, KEPT)
    keep = np.concatenate([keep, np.full((4, 1), 4)], 1)
    for t in range(n_rows - 1, -1, -1):
        after = np.concatenate([held[t + 1], np.full((n, 1), NEVER, np.int32)], 1)
        kept = after[np.arange(n)[:, None], keep[:, initial[t]].T]
        stay = np.minimum(kept, REROLE + after[:, NEXT]) + TRUNCATED * cut[t][:, None]
        least = np.minimum(DELETE + after[:, :4], np.where(must_go[t][:, None], NEVER, stay))
        once = np.minimum(least, INSERT + least[:, NEXT])
        least = np.minimum(once, INSERT + once[:, NEXT])
        held[t] = np.where((t < size)[:, None], least, held[t + 1])
    return held


def traced(held: np.ndarray, initial: np.ndarray, must_go: np.ndarray, cut: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(letters, made), each [step, conversation]: the edits, 0 where there are none, and what they leave.

    made: 4 * row + 0 for a row kept, + 1 (+ 2) for one with the role user (assistant); -2 (-3) for such a row inserted; -1 for nothing.
    """
    n = len(size)
    at, state, everyone = np.zeros(n, np.int64), np.zeros(n, np.int64), np.arange(n)
    letters, made = [], []
    last = len(initial) - 1
    while True:
        now = held[at, everyone, state]
        ended = at >= size
        if not (now[ended].any() or not ended.all()):
            break
        row = np.minimum(at, last)
        here, gone, short = initial[row, everyone], must_go[row, everyone], TRUNCATED * cut[row, everyone]
        after = held[np.minimum(at + 1, last + 1), everyone]
        to = NEXT[state]
        kept = np.where(here < 3, KEPT[state, np.minimum(here, 2)], -1)
        deletes = ~ended & (DELETE + after[everyone, state] == now)
        inserts = ~deletes & (now > 0) & (INSERT + held[at, everyone, to] == now)
        keeps = ~ended & ~deletes & ~inserts & ~gone & (kept >= 0) & (short + after[everyone, np.maximum(kept, 0)] == now)
        reroles = ~ended & ~deletes & ~inserts & ~keeps
        role = np.where(to == 3, 2, 1)
        letters.append(np.select([deletes, inserts, keeps, reroles], [ord("D"), ord("I"), ord("K"), ord("R")], 0).astype(np.uint8))
        made.append(np.select([inserts, keeps, reroles], [-1 - role, 4 * at, 4 * at + role], -1).astype(np.int32))
        state = np.where(keeps, kept, np.where(inserts | reroles, to, state))
        at = at + (deletes | keeps | reroles)
    if not letters:
        return np.zeros((0, n), np.uint8), np.zeros((0, n), np.int32)
    return np.stack(letters), np.stack(made)


def solve(codes: list[np.ndarray], digests: list[np.ndarray]) -> pd.DataFrame:
    """RESULT for each conversation, given the marks of its rows and two digests a row."""
    n = len(codes)
    sizes = np.array([len(c) for c in codes], np.int64)
    owner = np.repeat(np.arange(n), sizes)
    code = np.concatenate([*codes, np.zeros(0, np.int32)]).astype(np.int32)
    again = repeats(owner, np.concatenate([*[d.reshape(-1, 2) for d in digests], np.zeros((0, 2), np.int64)]))
    initial, blank = code & 3, (code & 4) > 0
    again &= ~blank
    cut = ((code & 8) > 0) & ~again
    total = lambda flags: np.bincount(owner, flags, n).astype(np.int64)
    pair = (owner[1:] == owner[:-1]) & ~np.isin(4 * initial[:-1] + initial[1:], (1, 6, 9))  # su, ua, au
    out = pd.DataFrame({"blank": total(blank), "duplicate": total(again), "truncated": total(cut), "illegal": np.bincount(owner[1:], pair, n).astype(np.int64)})
    cost, audit, made = np.zeros(n, np.int64), np.full(n, "", object), np.full(n, None, object)
    starts = np.cumsum(sizes) - sizes
    widths = np.where(sizes > 0, 1 << np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64), 0)
    for width in np.unique(widths):
        bucket = np.flatnonzero(widths == width)
        share = max(1, CELLS // max(1, int(width)))
        for part in (bucket[k : k + share] for k in range(0, len(bucket), share)):
            size = sizes[part]
            place = np.arange(size.max())[:, None]
            inside = place < size
            where = np.where(inside, starts[part] + place, 0)
            pick = lambda a: np.where(inside, a[where], 0) if len(a) else np.zeros(inside.shape, a.dtype)  # noqa: E731, B023
            told = pick(initial), pick(blank | again).astype(bool), pick(cut).astype(bool), size
            if not len(place):
                made[part] = [[] for _ in part]
                continue
            held = costs(*told)
            cost[part] = held[0, :, 0]
            letters, left = traced(held, *told)
            for k, c in enumerate(part):
                audit[c] = letters[:, k].tobytes().replace(b"\0", b"").decode()
                made[c] = [int(x) for x in left[:, k] if x != -1]
    return out.assign(cost=cost, audit=audit, made=made)


def repaired(codes: pd.Series, digests: pd.Series) -> pd.DataFrame:
    return solve([np.asarray(c, np.int32) for c in codes], [np.asarray(d, np.int64) for d in digests])


def repair(logs: DataFrame) -> DataFrame:
    """Logs (conv_id, rows: an array of turn, role, text, in order) with gaps, the counts, cost, audit and repaired, an array of role and text."""
    logs = settled(logs, codes=F.transform("rows", marks))
    digests = F.flatten(F.transform("rows", lambda r: F.array(F.xxhash64(F.lit(1), r.role, r.text), F.xxhash64(F.lit(2), r.text, r.role))))
    solved = logs.withColumn("found", F.pandas_udf(repaired, RESULT)("codes", digests))
    turns = F.array_distinct(F.filter(F.transform("rows", lambda r: r.turn), lambda t: t.isNotNull()))
    gaps = F.coalesce(F.array_max(turns) - F.array_min(turns) + 1 - F.size(turns), F.lit(0)).cast("long")
    role = lambda m, own: F.when(m == -2, "user").when(m == -3, "assistant").when(m % 4 == 1, "user").when(m % 4 == 2, "assistant").otherwise(own)

    def line(m: Column) -> Column:
        row = F.get("rows", F.when(m >= 0, F.floor(m / 4).cast("int")))
        return F.struct(role(m, row.role).alias("role"), F.coalesce(row.text, F.lit("")).alias("text"))

    told = [F.col("found")[c].alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost", "audit")]
    return solved.select("conv_id", gaps.alias("gaps"), *told, F.transform(F.col("found").made, line).alias("repaired"))


def op11_repair(spark, sf_dir: str) -> DataFrame:
    from quire.plans.tables import table

    found = repair(gathered(damaged(table(spark, sf_dir, "conversations"))))
    text = F.array_join(F.transform("repaired", lambda r: F.concat(r.role, F.lit(":"), r.text)), "\n")
    return found.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.sha2(text, 256).alias("repaired_sha256"))
