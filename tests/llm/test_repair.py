import hashlib
import random
import zlib
from functools import lru_cache

import numpy as np
import pytest

from quire.llm import repair as R

ALLOWED = {"su", "ua", "au"}


def slow_edits(rows):
    """(cost, audit, repaired) of rows (initial, must go, truncated, role, text): the cheapest of all edits, then the least string."""
    full = {"u": "user", "a": "assistant"}

    @lru_cache(None)
    def go(t, state, inserts):
        """The best from row t on after an initial ('' at the start), with so many insertions allowed before the next row."""
        found = [(0, "", ())] if t == len(rows) and state in ("", "a") else []
        step = "a" if state == "u" else "u"

        def add(cost, letter, rest, *line):
            found.append((cost + rest[0], letter + rest[1], (*line, *rest[2])))

        if inserts:
            add(3, "I", go(t, step, inserts - 1), (full[step], ""))
        if t < len(rows):
            initial, gone, cut, role, text = rows[t]
            add(4, "D", go(t + 1, state, 3))
            if not gone:
                if initial == step or initial == "s" and state == "":
                    add(3 * cut, "K", go(t + 1, initial, 3), (role, text))
                add(3 + 3 * cut, "R", go(t + 1, step, 3), (full[step], text))
        return min(found, key=lambda x: x[:2], default=(10**9, "", ()))

    return go(0, "", 3)


def slow(turns):
    """The contract's result for the damaged rows (turn, role, text) of one conversation, in order."""
    seen, rows, blank, duplicate, truncated = set(), [], 0, 0, 0
    for _, role, text in turns:
        solid = text.strip(R.SPACE)
        is_blank, again = not solid, (role, text) in seen
        cut = not is_blank and not again and solid[-1] not in ".!?"
        blank, duplicate, truncated = blank + is_blank, duplicate + (again and not is_blank), truncated + cut
        seen.add((role, text))
        rows.append((role[:1], is_blank or again, cut, role, text))
    illegal = sum(a[0] + b[0] not in ALLOWED for a, b in zip(rows, rows[1:], strict=False))
    known = [t for t, _, _ in turns if t is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    cost, audit, told = slow_edits(rows)
    return gaps, blank, duplicate, truncated, illegal, cost, audit, "\n".join(f"{r}:{t}" for r, t in told)


def slow_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        harm = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if harm == 1 else "".join(c for c in text if c not in ".!?") if harm == 2 else text
        out += [(conv, turn, "user" if harm == 4 else role, text)] * {0: 0, 3: 2}.get(harm, 1)
    return out


def random_rows(rng, n_conv, most):
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "sys", "User", "", None]
    texts = ["Yes.", "no", "Why?  \n", "", " ", None, "A!", "tail.x", "é😀.", "Yes."]
    rows = []
    for conv in [*range(n_conv), None]:
        for t in range(rng.randrange(0, most)):
            row = (conv, rng.choice([t, t, t, t + 1, 2 * t, None]), rng.choice(roles[: rng.choice([2, 3, 10])]), rng.choice(texts))
            rows += [row] * rng.choice([1, 1, 1, 2])
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = random_rows(rng, 150, rng.choice([6, 20]))
    frame = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, rows string")
    harmed = {}
    for c, *row in slow_damage(rows):
        harmed.setdefault(c, []).append(tuple(row))
    want = {}
    for c in {r[0] for r in rows}:
        turns = sorted(harmed.get(c, []), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        want[c] = slow(turns)
    got = R.repair(R.gathered(R.damaged(frame))).collect()
    assert len(got) == len(want)
    for r in got:
        text = "\n".join(f"{x.role}:{x.text}" for x in r.repaired)
        assert (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, text) == want[r.conv_id], r.conv_id
        # Edits give legal roles, and the audit's letters their number.
        initials = "".join(x.role[:1] for x in r.repaired)
        assert initials.removeprefix("s") == "ua" * (len(initials.removeprefix("s")) // 2) and initials != "s"
        assert sum(a in "KRI" for a in r.audit) == len(r.repaired)


def test_no_rows_and_all_dropped(spark):
    dropped = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    frame = spark.createDataFrame([(dropped, 0, "user", "Hi.")], "conv_id long, turn long, role string, text string")
    r = R.repair(R.gathered(R.damaged(frame))).first()
    assert (r.conv_id, r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired) == (dropped, 0, 0, 0, 0, 0, 0, "", [])
    assert R.repair(R.gathered(R.damaged(frame.limit(0)))).count() == 0


def test_long_conversations_and_buckets(monkeypatch):
    """Buckets split by CELLS and one long conversation give what each conversation gives alone."""
    rng = np.random.default_rng(3)
    codes = [rng.choice([0, 1, 2, 1, 2, 3, 5, 9, 10], n).astype(np.int32) for n in [0, 1, 2, 3, 5000, 7, 0, 64, 65, 2]]
    digests = [rng.integers(0, 200, 2 * len(c)) for c in codes]
    alone = [R.solve([c], [d]).iloc[0] for c, d in zip(codes, digests, strict=True)]
    for cells in (1, 100, 1 << 20):
        monkeypatch.setattr(R, "CELLS", cells)
        both = R.solve(codes, digests)
        for k, one in enumerate(alone):
            assert all(np.array_equal(one[c], both.iloc[k][c]) for c in both.columns)


def test_query_digest(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").collect()
    harmed = {}
    for c, *row in slow_damage([(r.conv_id, r.turn, r.role, r.text) for r in rows]):
        harmed.setdefault(c, []).append(tuple(row))
    got = R.op11_repair(spark, "/root/testdata/sf0.001").collect()
    assert {r.conv_id for r in got} == {r.conv_id for r in rows}
    for r in got:
        *want, text = slow(sorted(harmed.get(r.conv_id, [])))
        assert [r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit] == want
        assert r.repaired_sha256 == hashlib.sha256(text.encode()).hexdigest()
