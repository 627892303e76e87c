import hashlib
import random
import re
from collections import defaultdict

import corpus_pipeline
import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F
from test_bpe_and_counts import reference
from test_jaccard import brute
from test_tiling import expected

from strandloom.llm.common import shared_dir


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").first()
    clean = "a text with words of its own that stands nowhere else in all of this small corpus of documents"
    planted = spark.createDataFrame(
        [(10**6, clean, "en", "s", 90), (10**6 + 1, clean + " again", "en", "s", 96), (10**6 + 2, "12 34 !", "en", "s", 7), (10**6 + 3, "Intro. " + bench.text, "en", "s", 90), (10**6 + 4, None, None, None, None), (None, "a row without an id, kept as it is", "en", "s", 34)],
        docs.schema,
    )
    now = docs.union(planted)
    sizes = [now.count()]
    for name, stage in corpus_pipeline.STAGES:
        before = now
        now = spark.createDataFrame(stage(spark, now, SF).collect(), stage(spark, now, SF).schema)
        sizes.append(now.count())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert now.columns == docs.columns
        assert not now.join(before, "doc_id", "left_anti").filter("doc_id IS NOT NULL").count()
    left = {r.doc_id: r for r in now.collect()}
    assert 10**6 in left and None in left
    assert not {10**6 + k for k in (1, 2, 3, 4)} & set(left)
    assert np.frombuffer(left[10**6].ids, "<u2").tolist() == reference().encode_ordinary(clean)
    assert sizes == sorted(sizes, reverse=True)


def test_stages_against_brute_force(spark):
    """Each stage's rows, from its own input, by plain Python."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    again = docs.filter("doc_id < 5").withColumn("text", F.array_join(F.reverse(F.split("text", r"\s+")), " "))
    now = docs.union(docs.filter("doc_id < 3")).union(again)

    def rows(df):
        return [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]

    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, after = rows(now), stage(spark, now, SF)
        path = shared_dir(spark)
        after.write.parquet(path)
        now = spark.read.parquet(path)
        got = sorted(rows(now))
        if name == "language_id":
            assert set(got) <= set(before) and not [t for _, t in set(before) - set(got) if len(set(t.split())) > 20]
        elif name == "line_dedup":
            assert got == sorted(plain_lines(before))
        elif name == "ngram_jaccard_join":
            unique = {(i, hashlib.sha256(t.encode()).hexdigest()): t for i, t in before}  # of equal rows one stays, and the least of a component
            label = {k: c for (k, _, c) in brute(list(unique.items()), corpus_pipeline.NEAR_WORDS, corpus_pipeline.NEAR_PERCENT)}
            assert got == sorted((k[0], t) for k, t in unique.items() if label[str(k)] == str(k))
        else:
            hits = expected([(k, t) for k, (_, t) in enumerate(before)], items)
            assert got == sorted(d for k, d in enumerate(before) if not hits[k])
    assert len({i for i, _ in got}) < len(got)  # an id with two texts


def test_near_copies_are_caught(spark):
    """Copies with every thirtieth word edited go; texts that share half of their words' runs at most stay."""
    rng = random.Random(3)
    draw = lambda n: [f"{rng.choice('bcdfg')}{rng.randint(0, 4000)}" for _ in range(n)]
    rows, near = [], []
    for d in range(150):
        words = draw(rng.randint(40, 300))
        rows.append(words)
        for _ in range(2):
            edited = [rng.choice([[], draw(1), [w, *draw(1)]]) if rng.random() < 1 / 30 else [w] for w in words]
            near.append([w for part in edited for w in part])
        half = len(words) // 3
        rows.append(words[:half] + draw(len(words) - half))  # shares a passage
    made = [(k, " ".join(x), "en", "s", 0) for k, x in enumerate(rows + near)]
    left = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long"), SF).collect()}
    assert set(range(len(rows))) <= left
    assert len(left - set(range(len(rows)))) <= 0.1 * len(near)


def test_rows_without_an_id_meet_in_no_task(spark):
    """They are in no join, group or window of the near-duplicate stage."""
    rows = [(None, f"text {k} of no id", "en", "s", 12) for k in range(50)] + [(1, "twice", "en", "s", 5), (1, "twice", "en", "s", 5), (2, "once", None, None, None)]
    made = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), SF)
    assert made.filter("doc_id IS NULL").count() == 50 and made.count() == 52
    assert "Window" not in made._jdf.queryExecution().executedPlan().toString()


def plain_lines(rows):
    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\v\f\r"))
    holders = defaultdict(set)
    for i, text in rows:
        for line in text.split("\n"):
            holders[key(line)].add(i)
    gone = lambda i, line: len(key(line)) >= 40 and len(holders[key(line)]) >= 5 and max(holders[key(line)]) != i
    return [(i, "\n".join(x for x in text.split("\n") if not gone(i, x))) for i, text in rows]


MADE = "1 AS score, 'x' AS LANG_PRED, 2 AS typical, 3 AS n_lines, 4 AS kept_text, 5 AS contaminated, 6 AS component_id, 7 AS `key`, 8 AS ids, 9 AS N_tokens, 10 AS `a.b`, 11 AS stays, 12 AS `row`"


def test_columns_of_any_name(spark):
    """Columns named like those that operators make keep their values through all stages."""
    now = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("*", *MADE.split(", "))
    columns = now.columns
    for name, stage in corpus_pipeline.STAGES:
        now = spark.createDataFrame(stage(spark, now, SF).collect(), stage(spark, now, SF).schema)
        if name != "byte_bpe":
            assert now.columns == columns
            assert now.select(*[f"`{c}`" for c in columns[5:]]).distinct().collect() == [(1, "x", 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12)]
    assert now.select("document_ids", "document_N_tokens", "score", "`a.b`").distinct().collect() == [(8, 9, 1, 10)]


@pytest.mark.parametrize("stage", range(5))
def test_odd_tables(spark, odd, empty, stage):
    """No rows, nulls in every column, one very long text, repeated rows."""
    name, run = corpus_pipeline.STAGES[stage]
    none = run(spark, empty, SF)
    assert none.count() == 0
    got = run(spark, odd, SF)
    assert got.count() <= odd.count()
    kept = {r.doc_id for r in got.collect()}
    if name == "ngram_jaccard_join":
        assert kept == {r.doc_id for r in odd.collect()} and got.filter("doc_id = 1").count() == 1
    elif name == "language_id":
        assert not {2, 3, 4, 5} & kept
    else:
        assert got.count() == odd.count()
    only_null = spark.createDataFrame([(None,) * 5] * 3, empty.schema)
    assert run(spark, only_null, SF).count() == (0 if name == "language_id" else 3)


def test_run_and_registry(spark):
    import __spark_entry__

    known = __spark_entry__.queries()
    assert "pipeline" in known and all(any(q.startswith(f"op{n}_") for q in known) for n in range(1, 14))
    assert set(__spark_entry__.oracle_sql()) <= set(known)
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_language_stage_rejects_what_it_has_not_learned(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    foreign = [
        "Tämä on suomenkielinen lause, jossa on monta sanaa eikä yhtään tuttua kieltä",
        "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw",
        "Все люди рождаются свободными и равными в своем достоинстве и правах",
        "漢字の文章はここにあります 人人生而自由在尊嚴和權利上一律平等",
        "xqzv kjqw zzxk vbnq wqxj kkzq pfxv qjzx",
        "the words of this text are 漢字の文章はここにあります人人生而自由在尊嚴和權利上一律平等",
    ]
    short = ["That it.", "Thnt th anrendat oneses thea ingshly with.", "Des enberge die enver.", "Pachque çaneux et.", "a row without an id, kept as it is"]
    planted = spark.createDataFrame([(10**6 + k, t, None, "s", len(t)) for k, t in enumerate(foreign + short)], docs.schema)
    kept = corpus_pipeline.language_id(spark, docs.union(planted), SF)
    assert {r.doc_id - 10**6 for r in kept.filter("doc_id >= 1000000").collect()} == {*range(len(foreign), len(foreign) + len(short))}
    clean = docs.filter("length(text) > 0 AND lang IS NOT NULL").count()
    assert kept.filter("doc_id < 1000000").count() >= 0.99 * clean
