import math
import re

from quire.llm import quality as Q


def slow_base(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    wins = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    rep = {p for i, g in enumerate(wins) if wins.count(g) > 1 for p in range(i, i + 3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(rep)


def test_base_counts_and_edges(spark):
    texts = [None, "", " \n\t", "a b", "a b c a b c", "x\ny\nx\n \n ", "# * é😀 &|<> #", "w " * 400, "a b c d e f g a b c z z z z", "  a b", "k l m " * 30 + "ü\x0b\x0cé"]
    rows = [(k, t, lang, k) for k, t in enumerate(texts) for lang in ("en", None, "xx")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, _quality_words int")
    found, at = Q.judge(docs, Q.references(docs))
    assert found.columns == [*docs.columns, at]
    out = found.collect()
    assert len(out) == len(rows)
    for r in out:
        q = r[at]
        assert (q.n_words, q.word_chars, q.n_symbols, q.n_dup_lines, q.n_repeat_words) == slow_base(r.text), r.text
        assert q.base_failed == (q.n_words < 50 or 100 * q.n_repeat_words > 50 * q.n_words) and not (q.base_failed and q.kept)
    assert Q.judge(docs.limit(0), {})[0].count() == 0 and Q.references(docs.limit(0)) == {}


def test_distance(spark):
    p, q = [3, 1, 0, 4], [0.25, 0.25, 0.5, 0.0]
    s = [x / 8 for x in p]
    want = math.sqrt(sum((a * math.log2(2 * a / (a + b)) if a else 0) + (b * math.log2(2 * b / (a + b)) if b else 0) for a, b in zip(s, q, strict=True)) / 2)
    from pyspark.sql import functions as F

    got = spark.range(1).select(Q.jensen_shannon(F.array(*[F.lit(x).cast("long") for x in p]), q).alias("d")).first().d
    assert abs(got - want) < 1e-12


def test_verdict_follows_the_labels_and_is_native(spark):
    sf = "/root/testdata/sf0.01"
    got = Q.op7_quality(spark, sf)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    both = got.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("not base_failed").toPandas()
    assert both[both.quality == 1].kept.mean() > 0.99 and both[both.quality == 0].kept.mean() < 0.4
