"""What is worked out inside a text's row, against the same from rows a word."""

from pyspark.sql import functions as F

from spanloom.functions import text
from spanloom.operators import detectors, leak, sweeps
from spanloom.plans import catalog, demo


def world(spark):
    docs = spark.createDataFrame([(1, "ab cd, efg\U0001d5d4 hij kl"), (2, "xy"), (3, ""), (4, None), (5, "--- one two"), (6, "very plain words")], "doc_id long, text string")
    gold = spark.createDataFrame([(1, 0, 5, "PERSON", 0), (1, 4, 9, "DATE", 1), (1, 4, 9, "ADDRESS", 1), (1, 1, 12, "IGNORE", 2), (1, 12, 14, "NOT_PII", 3), (5, 4, 8, "URL", 0), (2, 0, 2, "IGNORE", 0)], "doc_id long, start int, end int, label string, pos int")
    preds = spark.createDataFrame([(1, 1, 4, "PERSON", 0.5), (1, 3, 4, "PERSON", 0.7), (1, 5, 6, "DATE", 0.9), (5, 0, 5, "URL", 0.25), (5, 0, 2, "URL", 1.0), (2, 0, 2, "DATE", -1.0)], "doc_id long, start int, end int, label string, score double")
    return docs, gold, preds


def same(a, b):
    left, right = (sorted(repr(tuple(x)) for x in d.collect()) for d in (a.select(*b.columns), b))
    assert left == right


def test_runs_are_scored_in_the_row(spark):
    docs, gold, preds = world(spark)
    r = text.word_runs(docs).select("doc_id", "idx", "start", "end")
    flat = leak.run_bins(r, preds)
    same(leak.scored_texts(docs, preds, gold), leak.labelled_runs(flat, gold).select("doc_id", "idx", "start", "end", "bin", "n_pii", "n_non"))
    same(leak.typed_texts(docs, preds, gold, 0.5), leak.type_recall(flat, gold, 0.5))
    spans = preds.select("doc_id", "start", "end").distinct()
    same(leak.expanded_texts(docs, spans), leak.expanded(spans, r))
    both = preds.withColumn("variant", F.lit("a")).unionByName(preds.withColumn("variant", F.lit("b")).where("score > 0.6"))
    same(sweeps.text_histograms(docs, both, gold, ["a", "b", "none"]), sweeps.histograms(leak.labelled_runs(r.withColumn("bin", F.lit(0)), gold), both, ["a", "b", "none"]))


def test_mentions_and_bins_are_made_in_the_row(spark, sf):
    docs, gold, preds = world(spark)
    gold = gold.unionByName(spark.createDataFrame([(1, 9, 10, "DATE", 4), (1, 10, 13, "URL", 5), (6, 0, 4, "URL", 0)], gold.schema))
    preds = preds.unionByName(spark.createDataFrame([(1, 10, 13, "URL", 0.5)], preds.schema))
    flat = leak.scored_texts(docs, preds, gold)
    for t in (0.0, 0.5, 0.8):
        want = leak.mention_masks(flat, gold, t)
        same(leak.mention_texts(docs, preds, gold, t), want)
        whole = leak.mention_texts(docs, preds, gold, t, surface=True)
        same(whole, want.join(docs, "doc_id").select("doc_id", "start", "end", "label", "masked", F.expr("substring(text, start + 1, end - start)").alias("surface")))
        same(leak.consistency(whole), leak.consistency(want, docs))
    want = flat.groupBy("doc_id", "bin").agg(F.sum("n_pii").alias("n_pii"), F.sum("n_non").alias("n_non"))
    same(leak.binned_texts(docs, preds, gold).select(want.columns), want)
    for name in ("recall_by_length", "span_exposure", "consistency"):  # by their plans: a row a word was joined, and dealt
        plan = catalog.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "_cell" not in plan and "SortMergeJoin" not in plan and "idx" not in plan.replace("pidx", ""), name


def test_no_row_a_word_is_dealt(spark, sf):
    s = catalog.scored(spark, sf)[0]
    plan = s._jdf.queryExecution().executedPlan().toString()
    assert "_cell" not in plan and "Sort " not in plan and "idx" not in "".join(x for x in plan.splitlines() if "Exchange" in x)
    r, g, p = demo.world(spark, sf)
    want = leak.histograms(leak.labelled_runs(leak.run_bins(r, p), g))
    same(leak.histograms(s), want)
    same(leak.typed_texts(demo.documents(spark, sf), p, g, 0.5), leak.type_recall(leak.run_bins(r, p), g, 0.5))


def test_texts_wait_for_python_as_texts(spark, tmp_path):
    """Arrays of words are not made before the step in Python, whose queue held them and spilled."""
    at = str(tmp_path / "texts")
    spark.createDataFrame([(1, "ab cd")], "doc_id long, text string").write.parquet(at)
    plan = text.word_runs(spark.read.parquet(at), word=False)._jdf.queryExecution().executedPlan().toString()
    assert [x.strip()[:20] for x in plan.splitlines() if "regexp_extract_all" in x and "ArrowEvalPython" not in x] == []


def test_windows_do_not_carry_the_text(spark, tmp_path):
    at = str(tmp_path / "texts")
    spark.createDataFrame([(1, "mail a@b.cd now " * 200), (2, None), (3, "")], "doc_id long, text string").write.parquet(at)
    found = detectors.detections(spark.read.parquet(at), "patterns")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.splitlines() if "Generate" in x and "text#" in x]
    assert sorted((r.start, r.end) for r in detectors.accepted(found).collect()) == [(16 * i + 5, 16 * i + 11) for i in range(200)]


def test_surfaces_are_cut_from_a_text_at_once(spark, sf):
    """The text was carried and walked from its beginning for every prediction."""
    plan = catalog.QUERIES["propagated"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "substring(text" not in plan


def test_options_are_sorted_without_a_comparator(spark, sf):
    """array_sort() calls its comparator, an interpreted expression, for each two options; words are read in one pass."""
    plan = catalog.QUERIES["span_questions"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "array_sort(" not in plan and "sort_array(" in plan and "/candidates-" not in plan
