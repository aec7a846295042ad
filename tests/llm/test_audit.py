from itertools import permutations

from quire.llm import audit as A

LONG = " ".join(f"w{k}" for k in range(120))


def slow(docs, labels):
    """Every document under every order, filter by filter."""
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    least = {}
    for d, text, _ in docs:
        if d is not None:
            least[text or ""] = min(d, least.get(text or "", d))
    rows = []
    for d, text, lang in docs:
        t = text or ""
        w = [x for x in "".join(" " if c in A.SPACE else c for c in t).split(" ") if x]
        fails = {
            "A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t),
            "D": any(c in "#$%&*|" for c in t), "E": d is not None and d > least[t],
        }
        rows.append((lang or "", fails, d in good, d in toxic))
    out = {}
    for part in {r[0] for r in rows}:
        mine, credit = [r for r in rows if r[0] == part], dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            live = mine
            for k, c in enumerate(order):
                gone = [r for r in live if r[1][c]]
                live_ids = {id(r) for r in live}
                dead = [r for r in mine if id(r) not in live_ids]
                live = [r for r in live if not r[1][c]]
                alone = sum(r[1][c] and sum(r[1].values()) == 1 for r in mine)
                out[part, order, k + 1] = [len(live), len(gone), sum(r[1][c] for r in dead), alone, sum(r[2] for r in gone), sum(r[3] for r in gone)]
                credit[c] += len(gone)
        for order in map("".join, permutations("ABCDE")):
            for k, c in enumerate(order):
                out[part, order, k + 1].append(credit[c])
    return out


def test_audit_equals_brute_force(spark):
    docs = [
        (1, LONG, "en"), (2, LONG, "en"), (2, LONG, "en"), (3, LONG + " #", "en"), (4, None, None), (5, "", None), (None, "", "de"), (6, LONG.upper(), "de"),
        (None, LONG, "en"), (7, "a a a", "en"), (8, "a " * 30_000, "en"), (9, LONG + " x", "de"), (10, "ABC é😀", ""), (11, LONG + "\x0b|", "en"), (11, "other", "de"),
    ]
    docs += [(k, "copied text", "en") for k in range(100, 400)] + [(50, "copied text", "fr")]
    labels = [(1, 1, 0), (1, 0, 1), (2, 1, None), (6, 0, 1), (7, 1, 1), (None, 1, 1), (150, 1, 0), (50, 1, 1), (999, 1, 1)]
    frame = spark.createDataFrame([(*d, 0, "x") for d in docs], "doc_id long, text string, lang string, flags int, part string")
    told = spark.createDataFrame([(*x, 0.5) for x in labels], "doc_id long, quality int, toxic int, n double")
    got = A.audit(frame, told).collect()
    want = slow(docs, labels)
    assert len(got) == len(want) == 600 * len({d[2] or "" for d in docs})
    for r in got:
        assert [r[m] for m in A.MEASURES] + [r.shapley] == want[r.part, r.filter_order, r.step], (r.part, r.filter_order, r.step)
    assert A.audit(frame.limit(0), told).count() == 0
    bare = A.audit(frame, told.limit(0)).groupBy().sum("good_lost", "toxic_lost").first()
    assert tuple(bare) == (0, 0)


def test_texts_are_not_shuffled(spark):
    plan = A.op12_audit(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoopJoin" in plan and "Python" not in plan
    assert not any("text#" in line for line in plan.splitlines() if "Exchange" in line)
