import hashlib
import random

import pytest
from llm.data import docs
from pyspark.sql import functions as F

from partita.llm.chat_format import HOSTILE_TEXT, Template, digests, format_chats, hostile_conversation, read_back, segments
from partita.llm.mixing import _share_below, mix_sources, source_targets, uniform

HOSTILE = ["", " ", "\\", "\\\\", "#", "##", "###", "####", "\\###", "</turn>", " </turn>\n", "\\</turn>", "### User: ", "a\n### Assistant: b </turn>\n", HOSTILE_TEXT, "<", "</", "é日\0"]
ROLES = ["system", "user", "assistant", "Assistant", "tool", "", "a: b", "\\", "### x", "{role}", "x\ny"]


TEMPLATES = [
    Template(),
    Template(open="<|im_start|>{role}\n", close="<|im_end|>\n", names={}, escape="~"),
    Template(open="{role}>>", close="\n\n", names={"user": "Human", "assistant": "AI"}, escape="%"),
    Template(open="[{role}]\n", close="aXa", names={"user": "u0"}, escape="^"),
]


@pytest.mark.parametrize("template", TEMPLATES)
def test_round_trip_of_hostile_texts(template):
    """Any roles and texts, those made of the template's own signs first of all, come back; no text holds a control string."""
    rng = random.Random(9)
    signs = [template.before, template.after, template.close, template.escape, template.close[:-1], template.close[1:], template.close * 2, template.escape + "0", template.escape + "2", template.before + "user" + template.after + "x" + template.close]
    hostile, roles = HOSTILE + signs, [*ROLES, *signs, *template.names.values(), template.escape + "2Human"]
    for _ in range(3000):
        turns = [(rng.choice(roles), "".join(rng.choice(hostile) for _ in range(rng.randrange(4)))) for _ in range(rng.randrange(5))]
        pieces, _ = segments(turns, template)
        assert read_back("".join(x for x, _ in pieces), template) == turns
        assert [template.restore(x) for x, loss in pieces if loss] == [t for r, t in turns if r == "assistant"]
        assert not any(template.close in x for x, _ in pieces[1::3])


@pytest.mark.parametrize("wrong", [{"open": "user: "}, {"open": "<{role}"}, {"close": ""}, {"escape": "#"}, {"names": {"user": "a: b"}}, {"names": {"user": "x", "assistant": "x"}}])
def test_templates_that_cannot_be_read_back_are_refused(wrong):
    with pytest.raises(ValueError):
        Template(**wrong)


@pytest.mark.parametrize("roles, legal", [("sua", True), ("ua", True), ("uaua", True), ("a", False), ("uua", False), ("su", False), ("usa", False), ("", False), ("uat", False)])
def test_machine(roles, legal):
    names = {"s": "system", "u": "user", "a": "assistant", "t": "tool"}
    assert (segments([(names[r], "x") for r in roles], Template())[1] is None) == legal


def test_conversations(spark):
    rows = [(1, 1, "assistant", "b", 0), (1, 0, "user", None, 0), (2, 0, None, "x", 0), (None, 0, "user", "n", 0), (3, None, "user", "q", 0), (3, 1, "assistant", "r", 0), (4, 0, "user", "same", 0), (4, 0, "user", "same", 0)]
    given = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, valid int")
    formatted = format_chats(given.unionByName(hostile_conversation(spark).withColumn("valid", F.lit(1))))
    for r in formatted.collect():
        assert [s["start"] for s in r["segments"]] + [len(r["formatted"])] == [0, *(s["end"] for s in r["segments"])]
    got = {r["conv_id"]: r for r in digests(formatted).collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert got[1]["turns_sha256"] == sha("user\n\nassistant\nb\n") and got[1]["loss_chars"] == 1 and got[1]["valid"]
    assert got[2]["turns_sha256"] == sha("\nx\n") and got[3]["turns_sha256"] == sha("user\nq\nassistant\nr\n") and got[4]["n_turns"] == 2 and not got[4]["valid"] and got[None]["n_turns"] == 1
    assert got[-7]["turns_sha256"] == sha(f"user\n{HOSTILE_TEXT}\nassistant\n{HOSTILE_TEXT}\n") and got[-7]["loss_sha256"] == sha(HOSTILE_TEXT) and got[-7]["loss_chars"] == len(HOSTILE_TEXT)
    assert format_chats(given.limit(0)).count() == 0


def targets_by_hand(sizes, share=1.5, epochs=2, weights=(3, 1, 2)):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    capped, budget = set(), share * sum(sizes.values())
    while True:
        left = budget - sum(epochs * sizes[s] for s in capped)
        total = sum(weight[s] for s in order if s not in capped)
        target = {s: epochs * sizes[s] if s in capped else weight[s] * left / total for s in order}
        over = {s for s in order if s not in capped and target[s] > epochs * sizes[s]}
        if not over:
            return target
        capped |= over


def test_targets_equal_repeated_sharing(spark):
    rng = random.Random(3)
    for _ in range(6):
        sizes = {s: rng.choice([0, 1, 50, 1000, 30_000]) + rng.randrange(9) for s in ["b", "a", None, "é", "z", "Z"][: rng.randrange(1, 7)]}
        if not sum(sizes.values()):
            continue
        given = spark.createDataFrame(list(sizes.items()), "source string, size long")
        got = {r["source"]: r["target"] for r in source_targets(given).collect()}
        assert got.keys() == sizes.keys() and all(abs(got[s] - t) < 1e-6 * (1 + t) for s, t in targets_by_hand(sizes).items())


def test_mix_meets_targets(spark):
    rng = random.Random(4)
    rows = [(k, " ".join(["w"] * rng.choice([1, 5, 40])), "hot" if k % 3 else rng.choice(["a", "b", None]), "x") for k in range(900)]
    got = mix_sources(docs(spark, rows), rows_per_range=20).collect()
    assert len(got) == 900 and all(r["taken"] <= 2 * r["size"] for r in got)
    sums, epochs = {}, {}
    for r in got:
        sums.setdefault(r["source"], [0, r["target"]])[0] += r["taken"]
        epochs.setdefault(r["source"], set()).add(r["taken"] // max(1, r["size"]))
    assert all(abs(t - target) <= 1 for t, target in sums.values()) and all(len(e) <= 2 for e in epochs.values())
    key = lambda rs: sorted((r["doc_id"], r["taken"]) for r in rs)
    assert key(got) == key(mix_sources(docs(spark, rows).repartition(7), rows_per_range=300).collect())


def test_heavier_documents_come_first(spark):
    rows = [(k, ("good words here " if k % 2 else "123 456 789 ") * 5, "s", "x") for k in range(2000)] + [(k, "filler", "t", "x") for k in range(2000, 2100)]
    got = [r for r in mix_sources(docs(spark, rows)).collect() if r["source"] == "s"]
    extra = lambda odd: sum(r["taken"] > r["size"] for r in got if (r["doc_id"] % 2 == 1) == odd)
    assert extra(True) > 1.3 * extra(False) > 0


def test_awkward_rows(spark):
    got = mix_sources(docs(spark)).collect()
    assert len(got) == 11 and {r["doc_id"]: r["size"] for r in got}[3] == 0 and all(r["taken"] >= 0 for r in got)
    assert mix_sources(docs(spark, [])).count() == 0
    assert all(r["target"] == 0 and r["taken"] == 0 for r in mix_sources(docs(spark, [(1, None, "a", "x"), (2, " ", None, "x")])).collect())


@pytest.mark.parametrize("weight", ["0.1", "5", "if(id % 3 = 0, 0.01, 20)", "1e-9"])
def test_ranges_are_even_whatever_the_weights(spark, weight):
    keyed = spark.range(20_000).withColumn("weight", F.expr(weight).cast("double")).withColumn("key", -F.log(uniform(F.col("id"))) / F.col("weight"))
    counts = sorted(r["count"] for r in keyed.groupBy(F.floor(_share_below(keyed) * 50)).count().collect())
    assert sum(counts) == 20_000 and counts[-1] <= 3 * counts[len(counts) // 2] and len(counts) >= 45


def test_rows_without_identifiers_and_odd_weights(spark):
    rows = [(None, f"text {k}", "s", "x") for k in range(400)] + [(k, "a b", "t", "x") for k in range(100)]
    for weight in ("double('NaN')", "double('inf')", "0", "-1", "null", "if(n_chars > 0, 2, 3)"):
        got = mix_sources(docs(spark, rows), weight=F.expr(weight), rows_per_range=50).collect()
        assert len(got) == 500 and abs(sum(r["taken"] for r in got if r["source"] == "s") - got[0]["target"]) <= 1
    taken = [r["taken"] - r["epochs"] * r["size"] for r in got if r["source"] == "s"]
    assert 0 < sum(x > 0 for x in taken) < 400 or sum(taken) in (0, 800)
