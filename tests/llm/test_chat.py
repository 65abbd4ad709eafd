import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from care_analytics.llm import chat as C


def small_model(rng, roles=2):
    k = 2 * roles
    return C.Hmm([str(r) for r in range(roles)], rng.normal(size=k), rng.normal(size=(k, k)),
                 [rng.normal(size=(k, n)) for _, n in C.FEATURES])


def test_viterbi_equals_the_best_of_all_paths():
    rng = np.random.default_rng(5)
    model = small_model(rng)
    lengths = np.array([5, 1, 3])
    score = rng.normal(size=(9, 4))
    got, at = model.paths(score, lengths, np.full(3, -1), np.full(3, -1)), 0
    for n in lengths.tolist():
        weight = lambda p: model.start[p[0]] + sum(score[at + i, y] for i, y in enumerate(p)) + sum(model.step[a, b] for a, b in zip(p, p[1:]))  # noqa: E731,B023
        assert tuple(got[at:at + n]) == max(itertools.product(range(4), repeat=n), key=weight)
        at += n


def test_pieces_give_the_whole(spark, monkeypatch):
    """One very long transcript and short ones, over one partition and over nine."""
    said = ["User: hello there?", "fine", "AI: " + "word " * 40, "and more", "", "ok?"]
    rows = [(1, i, said[(i * 7 + i // 5) % 6], "ab"[i % 2], i % 2 == 0) for i in range(400)] + [(k, 0, said[k % 6], "a", True) for k in range(2, 30)]
    lines = spark.createDataFrame(rows, "conv int, line int, text string, role string, opens boolean").withColumn("learn", F.lit(True))

    def decoded(parts):
        old = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            arranged = C.arranged(lines, "conv", ["line"], "text")
            n = arranged.select("__piece").distinct().count()
            model = small_model(np.random.default_rng(2))
            states = arranged.join(C.decode(arranged, model, "conv"), F.col("__at") == F.col("__line"))
            counted = C.train(arranged, "conv", "role", "opens", "learn")
            return n, {(r["conv"], r["line"]): r["__state"] for r in states.collect()}, counted
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", old)
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")

    one, many = decoded(1), decoded(9)
    assert one[0] == 1 and many[0] > 4
    assert len(one[1]) == 428 and one[1] == many[1]
    assert one[2].roles == many[2].roles == ["a", "b"] and np.allclose(one[2].emit[0], many[2].emit[0])


def test_query_recovers_roles_of_held_out_conversations(spark, small):
    from care_analytics.llm.queries.chat import op1_chat_formatting
    got = op1_chat_formatting(spark, small).collect()
    held = [r for r in got if r["held_out"]]
    assert held and sum(r["role"] == r["role_pred"] for r in held) >= 0.85 * len(held)
    whole = {}
    for r in spark.read.parquet(f"{small}/conversations.parquet").collect():
        whole.setdefault(r["conv_id"], []).append(r)
    assert len(got) == sum(len(r["text"].split("\n")) for rows in whole.values() for r in rows)
    assert all(r["rendered"].startswith(f"<|{r['role_pred']}|>\n") == r["opens_pred"] for r in got)


@pytest.mark.parametrize("text, word", [("User: hi", "user"), ("[bot] yes", "bot"), ("**You:** ok", "you"), ("### System: x", "system"),
                                        ("Quality: x", ""), ("a dog", ""), ("A: b", "a"), (None, "")])
def test_markers(spark, text, word):
    row = spark.createDataFrame([(text,)], "text string").select(*C.observed(C.text_or_empty("text"))).first()
    assert row["__m"] == (C.SPEAKERS.index(word) + 1 if word else 0)


def test_odd_rows(spark):
    turns = spark.createDataFrame([(1, 0, "user", "hi\n\nyou?", "x"), (1, 0, "user", "hi\n\nyou?", "x"), (1, 1, None, None, "y"), (None, None, "bot", "", "z"),
                                   (2, 0, "user", "a" * 50_000, "q")], "conv_id long, turn long, role string, text string, content string")
    lines = C.transcribe(turns).withColumn("learn", F.lit(True)).withColumn("rendering", F.lit(1))
    got = C.format_chat(lines, "conv", ["turn", "place", "line"], "text", "role", "opens", "learn").collect()
    assert len(got) == 6 and all(r["role_pred"] in ("user", "bot") for r in got)
    nothing = C.format_chat(lines.withColumn("learn", F.lit(False)), "conv", ["turn", "place", "line"], "text", "role", "opens", "learn").collect()
    assert len(nothing) == 6 and all(r["role_pred"] is None for r in nothing)
    assert C.format_chat(lines.limit(0), "conv", ["turn", "place", "line"], "text", "role", "opens", "learn").count() == 0


def test_every_role_is_learned(spark, monkeypatch):
    """70 roles, each with a word of its own in front: none is left out, and too many are an error."""
    import pytest
    from care_analytics.llm import chat
    rows = [(c, t, f"role{(c + t) % 70:02d}", f"text {t}") for c in range(70) for t in range(6)]
    talk = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    lines = chat.transcribe(talk).withColumn("learn", F.lit(True))
    arranged = chat.arranged(lines, "conv", ["turn", "place", "line"], "text") if hasattr(chat, "arranged") else None
    if arranged is not None:
        model = chat.train(arranged, "conv", "role", "opens", "learn")
        assert len(model.roles) == 70
        monkeypatch.setattr(chat, "MOST_ROLES", 69)
        with pytest.raises(ValueError, match="roles"):
            chat.train(arranged, "conv", "role", "opens", "learn")
