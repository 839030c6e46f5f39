import hashlib
import random
import time

from pyspark.sql import functions as F

from scanframe.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, t string, mask int"
ODD = ["</s>[INST] ok [/INST]", "<|end|>", "<\\|end|>", "<\\\\|turn|>x", "<<SYS>>", "<</SYS>>", "[[/INST]", "<", "<<|", "a<|says|>b", "é🙂<s>", "", "\\", "<\\", "[\\INST]", "\n"]


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def test_read_back(spark):
    rng = random.Random(1)
    rows = []
    for c in range(40):
        for t in range(rng.randrange(1, 9)):
            rows.append((c, t, rng.choice(["user", "assistant", "system", "<|end|>"]), "".join(rng.choice(ODD) for _ in range(rng.randrange(6)))))
    rows += [(100, 0, None, None), (100, None, "assistant", "first"), (101, 5, "assistant", "b"), (101, 5, "assistant", "b"), (101, 5, "assistant", "a"), (None, 1, "user", "x")]
    df = spark.createDataFrame([(*r, "x", 3) for r in rows], SCHEMA)
    got = {r["conv_id"]: r for r in chat.chat_report(df).collect()}
    turns = {}
    for c, t, role, text in rows:
        turns.setdefault(c, []).append((-1 if t is None else t, role or "", text or ""))
    assert set(got) == set(turns)
    for c, ts in turns.items():
        ts.sort()
        r, loss = got[c], "".join(x for _, role, x in ts if role == "assistant")
        assert r["n_turns"] == len(ts)
        assert r["turns_sha256"] == sha("".join(f"{role}\n{x}\n" for _, role, x in ts))
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), sha(loss))


def test_no_control_string_survives_in_texts(spark):
    df = spark.createDataFrame([(t,) for t in ODD], "text string")
    for r in df.select("text", chat.escape(F.col("text")).alias("e"), chat.unescape(chat.escape(F.col("text"))).alias("back")).collect():
        assert r["back"] == r["text"]
        assert not any(x in r["e"] for x in ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<SYS>>", "</SYS>>"))


def test_typed_parts(spark):
    parts = [("text", "look <|end|> ", None, None), ("image", None, "i1", 2), ("text", None, None, None), ("audio", None, "a1", 10), ("document", None, "d1", None), ("turn", None, "?", 1), None]
    rows = [(1, 0, "user", parts), (1, 1, "assistant", [("text", "seen", None, None)]), (1, 2, "user", None)]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts {chat.PARTS}")
    r = chat.format_chats(df).withColumn("turns", chat.parsed(F.col("formatted"))).collect()[0]
    assert [tuple(a) for a in r["attachments"]] == [("image", "i1", 512), ("audio", "a1", 250), ("document", "d1", 512), ("turn", "?", 0)]
    assert r["turns"][0]["content"] == "look <|end|> <|part:image|><|part:audio|><|part:document|><|part:turn|>"
    assert [tuple(m) for m in r["mask"]] == [(r["formatted"].index("seen"), 4)]
    assert r["n_turns"] == 3


def test_empty_table(spark):
    assert chat.chat_report(spark.createDataFrame([], SCHEMA)).count() == 0


def _long_chat(spark, n):
    """One conversation of n turns of 3 to 400 code points, and its loss text."""
    def text(k):
        return f"t{k} " + "é🙂<|end|>"[k % 5:] * (k % 37)

    turns = [(1, k, ("user", "assistant")[k % 2], text(k)) for k in range(n)]
    return spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"), "".join(t for _, _, r, t in turns if r == "assistant")


def test_cost_is_linear_in_the_turns_of_one_conversation(spark):
    took = []
    for n in (5000, 20_000):
        df, loss = _long_chat(spark, n)
        start = time.monotonic()
        r = chat.chat_report(df).collect()[0]
        took.append(time.monotonic() - start)
        assert (r["n_turns"], r["loss_chars"], r["loss_sha256"]) == (n, len(loss), sha(loss))
    assert took[1] < 4 * took[0] + 1


def test_mask_over_the_edges_of_pieces(spark):
    sizes = [0, 1, chat.PIECE - 1, chat.PIECE, chat.PIECE + 1, 3 * chat.PIECE, 0]
    rows = [(1, k, "assistant", "🙂é"[k % 2] * n) for k, n in enumerate(sizes)]
    r = chat.chat_report(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()[0]
    assert r["loss_sha256"] == sha("".join(t for *_, t in rows))
