import zlib

import duckdb
import numpy as np
import pytest
from llm.data import docs
from pyspark.sql import functions as F

from partita.llm import quality as q
from partita.llm import toxicity as t
from partita.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def auc(score, label):
    rank = np.argsort(np.argsort(score))
    n = label.sum()
    return (rank[label == 1].sum() - n * (n - 1) / 2) / (n * (len(label) - n))


def rated(spark, name, column):
    frame = QUERIES[name](spark, SF).toPandas()
    labels = duckdb.sql(f"select doc_id, {column} as y from '{SF}/labels.parquet'").df()
    return frame, frame.merge(labels, on="doc_id").query("held_out")


def test_toxicity_held_out(spark):
    frame, held = rated(spark, "op2_toxicity", "toxic")
    assert len(frame) == 1000 and frame["score"].between(0, 1).all() and ((frame["score"] >= 0.5) == (frame["predicted"] == 1)).all()
    assert (frame["held_out"] == [zlib.crc32(str(i).encode()) % 5 == 0 for i in frame["doc_id"]]).all()
    assert auc(held["score"].to_numpy(), held["y"].to_numpy()) > 0.9


def test_quality_held_out(spark):
    frame, held = rated(spark, "op4_quality", "quality")
    assert frame["expected_grade"].between(0, 2).all() and (frame["selected"] == (frame["tail_prob"] >= 0.5)).all()
    assert auc(held["tail_prob"].to_numpy(), held["y"].to_numpy()) > 0.95 and ((held["tail_prob"] >= 0.5) == (held["y"] == 1)).mean() > 0.9


def test_unseen_misspellings_share_vectors():
    rng = np.random.default_rng(1)
    plain = lambda: " ".join("".join(rng.choice(list("aeiourstn"), 5)) for _ in range(40))
    insults = ["grumblefox", "grumblefux", "grumblefoxx", "gruumblefox", "grumblfox"]
    texts, labels = [], []
    for k in range(300):
        words = plain().split()
        if k % 4 == 0:
            words[rng.integers(len(words))] = insults[k // 4 % 4]
        texts.append(" ".join(words).encode())
        labels.append(int(k % 4 == 0))
    model = t.fit(texts, labels)
    bad = [f"{plain()} {insults[4]} {plain()}".encode() for _ in range(20)]
    good = [f"{plain()} {plain()}".encode() for _ in range(20)]
    assert model.scores(bad).min() > model.scores(good).max() and (model.scores(bad) >= 0.5).all() and (model.scores(good) < 0.5).mean() > 0.9
    assert np.allclose(model.scores(bad + good), np.concatenate([model.scores([x]) for x in bad + good]))


def test_ordinal_grades_are_ordered():
    rng = np.random.default_rng(2)
    texts, grades = [], []
    for k in range(300):
        g = k % 4
        texts.append(" ".join("good" if rng.random() < g / 3 else "junk" for _ in range(60)).encode())
        grades.append(g)
    model = q.fit(texts, grades, 4)
    assert (np.diff(model.thresholds) > 0).all()
    tails = model.tails(texts)
    assert (np.diff(tails, axis=1) <= 1e-12).all()
    means = [tails.sum(axis=1)[np.array(grades) == g].mean() for g in range(4)]
    assert means == sorted(means) and means[3] - means[0] > 1.5


@pytest.mark.parametrize("labelled", [[], [(1, 1)], [(1, 1), (2, 0), (None, 1), (3, None), (6, 7), (2, 0)]])
def test_awkward_rows(spark, labelled):
    labels = spark.createDataFrame([(i, y, "s") for i, y in labelled], "doc_id long, toxic int, score string")
    got = t.toxicity(docs(spark), labels).collect()
    assert len(got) == 11 and all(0 <= r["score"] <= 1 for r in got) and len({r["score"] for r in got if r["doc_id"] in (3, 4, 5)}) == 1
    graded = q.quality(docs(spark), labels, F.col("toxic"), 2).collect()
    assert len(graded) == 11 and all(0 <= r["tail_prob"] <= 1 for r in graded)
    assert t.toxicity(docs(spark, []), labels).count() == 0 and q.quality(docs(spark, []), labels, F.col("toxic"), 2).count() == 0


def test_held_out_rows_and_other_columns_do_not_matter(spark):
    base = docs(spark)
    held = [i for i in range(1, 11) if zlib.crc32(str(i).encode()) % 5 == 0]
    labels = [(i, i % 2) for i in range(1, 11)]
    one = spark.createDataFrame(labels, "doc_id long, toxic int")
    two = spark.createDataFrame([(i, 1 - y if i in held else y) for i, y in labels], "doc_id long, toxic int")
    scores = lambda d, x: sorted((r["doc_id"] or 0, r["score"]) for r in t.toxicity(d, x).collect())
    assert held and scores(base, one) == scores(base, two) == scores(base.withColumn("source", F.lit("z")).withColumn("lang", F.lit(None)), one)


def test_gradient_equals_differences():
    rng = np.random.default_rng(4)
    f, theta, y = rng.normal(0, 2, 40), np.array([-1.0, 0.2, 1.7]), rng.integers(0, 4, 40)
    _, d_f, d_theta = q.likelihood(f, theta, y)
    loss = lambda f, theta: -np.mean([np.log(p) for x, g in zip(f, y, strict=True) for tails in [[1, *(1 / (1 + np.exp(t - x)) for t in theta), 0]] for p in [tails[g] - tails[g + 1]]])
    assert np.isclose(q.likelihood(f, theta, y)[0], loss(f, theta))
    for analytic, at in ((d_f, f), (d_theta, theta)):
        for k in range(len(at)):
            step = np.zeros(len(at))
            step[k] = 1e-5
            up, down = (loss(f + s, theta) if at is f else loss(f, theta + s) for s in (step, -step))
            assert abs(analytic[k] - (up - down) / 2e-5) < 1e-7


def mixed(x):
    """The splitmix64 finaliser on one integer."""
    m = (1 << 64) - 1
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & m
    x = (x ^ x >> 27) * 0x94D049BB133111EB & m
    return x ^ x >> 31


def toxic_by_hand(model, text):
    """The mean logit of the worst window of two words, by loops over words and n-grams."""
    code = [mixed((7 + b) * 0x9E3779B97F4A7C15 & (1 << 64) - 1) for b in range(256)]
    words = "".join(chr(b) for b in text.translate(t._FOLD)).split(" ")
    words = [w.encode("latin-1") for w in words if w]
    grams = []
    for w in words:
        marked, mine = b" " + w + b" ", []
        for n in (3, 4, 5):
            for i in range(len(marked) - n + 1):
                h = n
                for b in marked[i : i + n]:
                    h = (h * 0x100000001B3 + code[b]) & (1 << 64) - 1
                mine.append(model.logit[mixed(h) & t.BUCKETS - 1])
        grams.append(mine)
    windows = [grams[k] + grams[k + 1] for k in range(len(grams) - 1)] or grams
    top = max((sum(map(float, x)) / max(1, len(x)) for x in windows), default=0.0)
    return 1 / (1 + np.exp(-(model.bias + top)))


def sampled(spark, column):
    """Texts and labels of the rows that a model may learn from, in the order of their hash."""
    labels = spark.read.parquet(f"{SF}/labels.parquet").withColumn("h", F.xxhash64("doc_id")).toPandas()
    texts = dict(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    mine = labels[[zlib.crc32(str(i).encode()) % 5 != 0 for i in labels["doc_id"]]].sort_values(["h", "doc_id"])
    return [(texts[i] or "").encode() for i in mine["doc_id"]], mine, texts


def test_scores_equal_brute_force(spark):
    sample, mine, texts = sampled(spark, "toxic")
    assert len(sample) < t.SAMPLE_ROWS and sum(map(len, sample)) < t.SAMPLE_BYTES
    toxic = t.fit(sample, mine["toxic"].tolist())
    graded = q.fit(sample, [0 if a == 0 else 1 if b == 1 else 2 for a, b in zip(mine["quality"], mine["toxic"], strict=True)], 3)
    scores = {r["doc_id"]: r["score"] for r in QUERIES["op2_toxicity"](spark, SF).collect()}
    grades = {r["doc_id"]: (r["expected_grade"], r["tail_prob"]) for r in QUERIES["op4_quality"](spark, SF).collect()}
    assert scores.keys() == grades.keys() == texts.keys()
    for i in sorted(texts, key=lambda i: len(texts[i] or ""))[:400]:
        text = (texts[i] or "").encode()
        assert abs(scores[i] - toxic_by_hand(toxic, text)) < 1e-4
        at, value = q.features(text)
        f = sum(graded.weight[k] * v for k, v in zip(at.tolist(), value.tolist(), strict=True))
        tails = [1 / (1 + np.exp(x - f)) for x in graded.thresholds]
        assert np.allclose(grades[i], (sum(tails), tails[0]), atol=1e-9)
