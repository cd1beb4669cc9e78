"""The pipeline against a restatement in plain Python, on planted documents."""

import random

import corpus_pipeline
from llm.test_duplicates import components_by_hand, exact_by_hand
from llm.test_formats_and_mixes import targets_by_hand
from llm.test_text_scans import contamination_by_hand

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def planted():
    rng = random.Random(11)
    say = lambda n: " ".join("".join(rng.choice("aeioursntl") for _ in range(rng.randrange(3, 7))) for _ in range(n))
    passage = say(40)
    texts = [say(60) for _ in range(60)]
    toxic = {}
    for k in range(0, 24):
        words = say(50).split()
        for _ in range(3):
            words[rng.randrange(50)] = rng.choice(["snarkulous", "snarkulant", "snarkuling"])
        toxic[len(texts)] = 1
        texts.append(" ".join(words))
    texts += [texts[0], texts[0] + " ", texts[1].replace(" ", "\n"), texts[2] + " tail", texts[3] + " x", texts[4] + " " + passage, passage, None, "", "", "short"]
    rows = [(k, t, "en", rng.choice(["a", "b", None]), len(t or "")) for k, t in enumerate(texts)]
    return rows, [(k, 1, toxic.get(k, 0)) for k in range(84)], [(0, passage)], set(toxic)


def test_stages_equal_plain_python(spark, tmp_path):
    rows, labels, items, toxic = planted()
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "ngram_join", "decontamination", "mixing"]
    now = spark.createDataFrame(rows, SCHEMA)
    as_rows = lambda df: sorted(tuple(r) for r in df.collect())
    stage = dict(corpus_pipeline.STAGES)

    kept = stage["toxicity"](spark, now, str(tmp_path))
    assert kept.columns == now.columns
    left = as_rows(kept)
    assert {r[0] for r in left} == {r[0] for r in rows} - toxic

    kept = stage["exact_dedup"](spark, spark.createDataFrame(left, SCHEMA), str(tmp_path))
    want = {r[0] for r in exact_by_hand(left) if r[3]}
    left = as_rows(kept)
    assert {r[0] for r in left} == want and len(left) == len(want)

    kept = stage["ngram_join"](spark, spark.createDataFrame(left, SCHEMA), str(tmp_path))
    want = {r[2] for r in components_by_hand(left)}
    left = as_rows(kept)
    assert {r[0] for r in left} == want

    kept = stage["decontamination"](spark, spark.createDataFrame(left, SCHEMA), str(tmp_path))
    want = {r[0] for r in contamination_by_hand(left, items) if not r[4]}
    assert kept.columns == now.columns
    left = as_rows(kept)
    assert {r[0] for r in left} == want

    got = stage["mixing"](spark, spark.createDataFrame(left, SCHEMA), str(tmp_path)).collect()
    sizes: dict = {}
    for r in left:
        sizes[r[3]] = sizes.get(r[3], 0) + len((r[1] or "").split())
    for s, target in targets_by_hand(sizes).items():
        assert abs(sum(r["taken"] for r in got if r["source"] == s) - target) <= 1
    ran = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in ran) == sorted((r["doc_id"], r["taken"]) for r in got)


def test_repeated_rows_nulls_and_extra_columns(spark, tmp_path):
    rows = [(1, "same text here", "en", "a", 3, True), (1, "same text here", "en", "a", 3, True), (None, None, None, None, None, None), (2, "other text", None, None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA + ", kept boolean")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    counts = []
    for name, f in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(f(spark, docs, str(tmp_path)).collect(), f(spark, docs, str(tmp_path)).schema)
        counts.append((name, docs.count()))
    assert counts == [("toxicity", 4), ("exact_dedup", 3), ("ngram_join", 3), ("decontamination", 3), ("mixing", 3)]
    empty = spark.createDataFrame([], SCHEMA)
    assert all(f(spark, empty, str(tmp_path)).count() == 0 for _, f in corpus_pipeline.STAGES)


def test_every_row_is_decided_by_itself(spark, tmp_path):
    """Toxic rows without identifier go, clean rows that repeat a toxic or contaminated row's identifier stay; so do columns of any name."""
    rows, labels, items, toxic = planted()
    bad, passage, texts = next(rows[k][1] for k in toxic), items[0][1], [r[1] for r in rows]
    given = [
        (None, bad, "en", "a", 1, "x", 1), (207, bad, "en", "a", 1, "x", 1), (207, texts[5], "en", "a", 1, "x", 1),
        (208, passage, "en", "a", 1, "x", 1), (208, texts[6], "en", "a", 1, "x", 1), (None, passage + " more", "en", "a", 1, "x", 1), (None, texts[7], "en", "a", 1, "x", 1),
        (None, texts[8], "en", "a", 1, "x", 1), (None, texts[8] + " z", "en", "a", 1, "x", 1), (209, texts[9] + " y", "en", "a", 1, "x", 1), (209, texts[9], "en", "a", 1, "x", 1),
    ]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    stage = dict(corpus_pipeline.STAGES)
    schema = SCHEMA + ", row string, key int"
    texts_of = lambda df: sorted(r["text"] or "" for r in df.collect())
    known = spark.createDataFrame([(*r, "x", 1) for r in rows], schema)
    every = known.unionByName(spark.createDataFrame(given, schema))
    left = stage["toxicity"](spark, every, str(tmp_path))
    assert left.columns == every.columns and bad not in texts_of(left) and texts_of(left).count(texts[5]) == 2
    clean = spark.createDataFrame(given[2:], schema)
    assert texts_of(stage["decontamination"](spark, clean, str(tmp_path))) == sorted(r[1] for r in given[2:] if passage not in r[1])
    near = texts_of(stage["ngram_join"](spark, clean, str(tmp_path)))
    assert len(near) == 6 and texts[5] in near and texts[6] in near and passage in near and passage + " more" not in near
    assert stage["ngram_join"](spark, clean, str(tmp_path)).columns == clean.columns == stage["exact_dedup"](spark, clean, str(tmp_path)).columns
