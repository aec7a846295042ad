import random

import corpus_pipeline as C
from quire.llm.decontaminate import decontaminate
from quire.llm.simhash import fingerprint


def test_stages_on_small_tables(spark, tmp_path):
    line = "the house and the garden of a man who was in town for a week with his wife and that is all there is to say about it"
    say = lambda k: "\n".join(" ".join(f"{w}{'x' * ((k * 7 + i * j) % 5)}" for i, w in enumerate(line.split())) for j in range(1, 6))
    bench = "q1 q2 q3 q4 q5 q6 q7 q8 q9 q10 q11 q12 q13 q14 q15"
    rows = [(k, say(k), "en", "s", 1, "keep") for k in range(8)]
    rows += [(50, say(3), "en", "s", 1, "copy"), (51, None, "en", "s", 0, "null"), (52, "1 2 3", None, None, 0, "no letter"), (53, "too short", "en", "s", 1, "short"), (3, say(3), "en", "s", 1, "again"), (None, None, None, None, None, None)]
    rows += [(60, say(61) + " " + bench * 2, "en", "s", 1, "bench")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, quality string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, bench), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in C.STAGES[:-1]:
        after = stage(spark, docs, str(tmp_path))
        assert after.columns == docs.columns and stage(spark, docs.limit(0), str(tmp_path)).count() == 0
        docs = C.staged(after, name)
    left = sorted(r.doc_id for r in docs.collect())
    assert 51 not in left and 52 not in left and 53 not in left and 50 not in left and 60 not in left
    assert len(left) == len(set(left)) and 3 in left
    out = C.run(spark, str(tmp_path))
    assert sorted({r.doc_id for r in out.collect()}) == left


def test_near_dedup_equals_brute_force(spark, tmp_path):
    rng = random.Random(4)
    words = "river house stone green walk paper cloud table lamp road".split()
    texts = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(12)]
    texts += [None, "", "   ", texts[0].upper(), texts[1] + " "]
    rows = [(rng.choice([None, *range(8)]), rng.choice(texts), {"k": rng.choice("ab")}, rng.randrange(2)) for _ in range(150)]
    rows += [(3, texts[0], None, 0), (5, texts[0], None, 0), (5, texts[2], None, 0), (5, texts[2], None, 0)] + rows[:20]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id map<string,string>, component_id int").repartition(3)
    docs.write.parquet(f"{tmp_path}/d.parquet")
    docs = spark.read.parquet(f"{tmp_path}/d.parquet")
    got = C.near_dedup(spark, docs, "").collect()
    fps = [fingerprint(r[1] and r[1].encode()) for r in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                old, new = root[i], root[j]
                root = [new if x == old else x for x in root]
    groups = {}
    for r, g in zip(rows, root, strict=True):
        groups.setdefault(g, []).append(r)
    assert len(got) == len(groups)
    order = lambda k: (k is None, k)
    for r in got:
        row = (r.doc_id, r.text, r.id, r.component_id)
        of = [g for g in groups.values() if row in g]
        assert len(of) == 1 and order(row[0]) == min((order(x[0]) for x in of[0]))
        groups = {k: g for k, g in groups.items() if g is not of[0]}
    assert not groups


def test_run_keeps_clean_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    clean = {r.doc_id for r in C.language_id(spark, docs, sf).select("doc_id").collect()}
    assert len(clean) > 0.98 * docs.count()
    kept = C.decontamination(spark, docs, sf)
    found, at = decontaminate(docs, spark.read.parquet(f"{sf}/benchmark.parquet"), keep=["doc_id"])
    assert kept.count() == found.filter(f"not {at}.contaminated").count()


def test_language_id_rejects_foreign_and_random_texts(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rng = random.Random(1)
    junk = [" ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 10))) for _ in range(n)) for n in (3, 10, 50, 300) * 10]
    junk += ["Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw", "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan",
             "Все люди рождаются свободными и равными в своем достоинстве и правах", "人人生而自由，在尊严和权利上一律平等"]
    extra = spark.createDataFrame([(-1 - k, t) for k, t in enumerate(junk)], "doc_id long, text string")
    kept = C.language_id(spark, docs.unionByName(extra, allowMissingColumns=True), sf).select("doc_id").toPandas().doc_id
    assert set(kept) == {r.doc_id for r in docs.filter(r"text rlike '\\p{L}'").select("doc_id").collect()}
