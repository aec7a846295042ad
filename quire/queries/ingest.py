"""Queries on catalog records, made by fixed arithmetic from documents."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.operators import ingest as I
from quire.plans.staging import new_path, removed, staged
from quire.plans.tables import table
from quire.queries import query
from quire.sources import archives, files

FILES = T.ArrayType(T.StructType([T.StructField("url", T.StringType()), T.StructField("extent", T.StringType())]))
AGENTS = T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("birth", T.IntegerType()), T.StructField("death", T.IntegerType())]))


def record_table(spark, sf_dir):
    """Records with rights, people, subjects and files that depend on doc_id alone."""
    i = F.col("doc_id")
    person = F.struct(
        F.when(i % 4 == 0, "Doe, Jane (Janet)").otherwise("Roe, Richard").alias("name"), F.when(i % 5 != 0, (1780 + i % 150).cast("int")).alias("birth"),
        F.when(i % 3 != 0, (1850 + i % 140).cast("int")).alias("death"),
    )
    agents = F.when(i % 17 == 0, F.array().cast(AGENTS)).when(i % 2 == 0, F.array(person)).otherwise(F.array(person, F.struct(F.lit("Homer").alias("name"), F.lit(-750).alias("birth"), F.lit(None).cast("int").alias("death"))))
    themes = F.array(*[F.lit(x) for x in ("Detective stories", "Science fiction", "Ghosts -- Poetry", "World War, 1914-1918", "Erotic fiction", "PR", "Natural history", "Fairy tales")])
    subjects = F.array_distinct(F.array(F.get(themes, (i % 8).cast("int")), F.get(themes, (i * 3 % 8).cast("int"))))
    files = F.when(i % 19 == 0, F.array().cast(FILES)).otherwise(
        F.array(F.struct(F.lit("pg.txt").alias("url"), F.col("n_chars").cast("string").alias("extent")), F.struct(F.lit("pg.cover.medium.jpg").alias("url"), F.lit(None).cast("string").alias("extent")))
    )
    d = table(spark, sf_dir, "documents")
    return d.select(
        i.alias("gid"), F.when(i % 23 == 0, "Sound").otherwise("Text").alias("type"), F.when(i % 29 == 0, "Copyrighted.").otherwise("Public domain in the USA.").alias("rights"),
        F.array(F.col("lang")).alias("languages"), F.when(i % 31 == 0, "Ulysses").otherwise(F.concat(F.lit("Work : $b "), i.cast("string"), F.lit("\nA tale"))).alias("title"),
        F.when(i % 31 == 0, F.array(F.lit("Joyce, James"))).otherwise(F.array(person["name"])).alias("creators"), agents.alias("agents"), subjects.alias("subjects"), F.array(F.lit("Category: Novels")).alias("shelves"),
        (i % 101).alias("downloads"), F.lit("About it. (This is an automatically generated summary.)").alias("description"), files.alias("files"),
    )


def rows(spark, sf_dir):
    denied = table(spark, sf_dir, "labels").filter("toxic = 1").select(F.col("doc_id").alias("gid"))
    return I.parsed(record_table(spark, sf_dir), denied)


_SUBJECTS = "['Detective stories', 'Science fiction', 'Ghosts -- Poetry', 'World War, 1914-1918', 'Erotic fiction', 'PR', 'Natural history', 'Fairy tales']"
_ROWS_SQL = f"""
    r AS (
      SELECT doc_id AS gid, lang, n_chars, list_filter(CASE WHEN doc_id % 8 = doc_id * 3 % 8 THEN [{_SUBJECTS}[doc_id % 8 + 1]] ELSE [{_SUBJECTS}[doc_id % 8 + 1], {_SUBJECTS}[doc_id * 3 % 8 + 1]] END, lambda x: x <> 'PR') AS subjects,
        CASE WHEN doc_id % 5 <> 0 THEN 1780 + doc_id % 150 END AS birth, CASE WHEN doc_id % 3 <> 0 THEN 1850 + doc_id % 140 END AS death, doc_id % 17 = 0 AS alone FROM documents),
    h AS (SELECT *, lower(array_to_string(subjects, ' | ')) || CASE WHEN len(subjects) > 0 THEN ' | ' ELSE '' END || 'novels' AS hay FROM r),
    e AS (
      SELECT *, CASE WHEN gid % 23 = 0 THEN 'not_text' WHEN gid % 29 = 0 THEN 'not_pd_usa' WHEN lang IS NULL OR lang NOT IN ('en', 'fr', 'es', 'it', 'pt', 'hi') THEN 'language' WHEN gid % 19 = 0 THEN 'no_plaintext' END AS skip,
        list_filter([CASE WHEN gid IN (SELECT doc_id FROM labels WHERE toxic = 1) THEN 'racist_ideology' END, CASE WHEN alone THEN 'no_agents' END,
          CASE WHEN NOT alone AND death > 1971 THEN 'death_too_recent' END, CASE WHEN NOT alone AND death IS NULL AND (birth IS NULL OR birth > 1850) THEN 'unverifiable_person' END,
          CASE WHEN contains(hay, 'erotic') OR gid % 31 = 0 THEN 'explicit' END], lambda x: x IS NOT NULL) AS reasons FROM h)"""


@query("catalog_rows", f"""
    WITH {_ROWS_SQL}
    SELECT gid, skip, array_to_string(reasons, ', ') AS excluded, len(reasons) = 0 AS curated, array_to_string(subjects, '; ') AS subjects,
      CASE WHEN gid % 31 = 0 THEN 'Ulysses' ELSE 'Work : ' || gid || ': A tale' END AS title, CASE WHEN gid % 31 = 0 THEN 'James Joyce' WHEN gid % 4 = 0 THEN 'Jane Doe' ELSE 'Richard Roe' END AS authors,
      CAST(CASE WHEN gid % 19 = 0 THEN 0 ELSE n_chars END AS BIGINT) AS text_bytes, 'About it.' AS description FROM e""")
def catalog_rows(spark, sf_dir):
    return rows(spark, sf_dir).select("gid", "skip", "excluded", "curated", "subjects", "title", "authors", "text_bytes", "description")


@query("people_spans", """
    SELECT doc_id AS gid, CASE WHEN doc_id % 17 = 0 THEN '' ELSE CASE WHEN doc_id % 4 = 0 THEN 'Jane Doe' ELSE 'Richard Roe' END
      || CASE WHEN doc_id % 5 = 0 AND doc_id % 3 = 0 THEN '' ELSE ' (' || CASE WHEN doc_id % 5 <> 0 THEN CAST(1780 + doc_id % 150 AS VARCHAR) ELSE '?' END || '–' || CASE WHEN doc_id % 3 <> 0 THEN CAST(1850 + doc_id % 140 AS VARCHAR) ELSE '?' END || ')' END
      || CASE WHEN doc_id % 2 = 1 THEN '; Homer (750 BCE–?)' ELSE '' END END AS authors_full FROM documents""")
def people_spans(spark, sf_dir):
    return rows(spark, sf_dir).select("gid", "authors_full")


@query("reason_histogram", f"""
    WITH {_ROWS_SQL} SELECT 'skip' AS kind, skip AS reason, count(*) AS count FROM e WHERE skip IS NOT NULL GROUP BY skip
    UNION ALL SELECT 'excluded', x, count(*) FROM (SELECT unnest(reasons) AS x FROM e WHERE skip IS NULL) GROUP BY x""")
def reason_histogram(spark, sf_dir):
    return I.reason_counts(rows(spark, sf_dir))


_LISTS = " UNION ALL ".join(
    f"SELECT {k} AS o, '{g.replace(chr(39), chr(39) * 2)}' AS g, {[w for w in ws]!r} AS words" for k, (g, ws) in enumerate(I.GENRES.items())
)


@query("genre_tags", f"""
    WITH {_ROWS_SQL}, rules AS ({_LISTS})
    SELECT gid, coalesce(string_agg(g, ', ' ORDER BY o) FILTER (WHERE len(list_filter(words, lambda w: contains(hay, w))) > 0), '') AS genres FROM h, rules GROUP BY gid""")
def genre_tags(spark, sf_dir):
    return rows(spark, sf_dir).select("gid", "genres")


@query("bundled_texts", """
    SELECT doc_id AS gid, CAST(length(coalesce(text, '')) AS BIGINT) AS n_chars, md5(coalesce(text, '')) AS digest FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)""")
def bundled_texts(spark, sf_dir):
    """All documents are written to zip bundles; of those only the labelled ones are read again."""
    i, path = F.col("doc_id").cast("string"), new_path(spark, "bundles")
    docs = table(spark, sf_dir, "documents").filter("doc_id IS NOT NULL")
    archives.write_zips(docs.select(F.concat(i, F.lit("/pg"), i, F.lit(".txt")).alias("name"), F.coalesce("text", F.lit("")).cast("binary").alias("content")), path)
    texts = files.bundle_texts(spark, path, table(spark, sf_dir, "labels").select(F.col("doc_id").alias("gid")))
    found = staged(texts.select("gid", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("digest")), "bundled-texts")
    removed(spark, path)
    return found
