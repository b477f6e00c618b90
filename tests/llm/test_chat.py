import hashlib

from gridloom.llm import chat

SCHEMA = "tree_id long, msg_id long, parent_id long, role string, text string, score double"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def test_best_branch_of_a_tree(spark):
    rows = [
        (1, 1, None, "user", "root", 0.0), (1, 2, 1, "assistant", "low", 0.1), (1, 3, 1, "assistant", "high", 0.9), (1, 4, 2, "user", "deep <b> & \"", 0.5),
        (1, 5, 3, "user", None, None), (1, None, 3, "user", "no id", 9.0), (1, 2, 1, "assistant", "zz", 0.1),
        (2, 7, 99, "assistant", "orphan", None), (3, 1, 2, "user", "circle", 1.0), (3, 2, 1, "user", "circle", 1.0), (None, 1, None, None, "</turn>\n", None), (4, 1, 1, "user", "", 1.0),
    ]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS branch", "2 AS place")
    got = {}
    for r in chat.format_trees(df, branches=2).selectExpr("*", "formatted AS f").select("tree_id", "branch", "formatted", chat.parse(chat.F.col("formatted")).alias("turns"), chat.loss_text(chat.F.col("formatted"), chat.F.col("loss_spans")).alias("loss")).collect():
        got[r.tree_id, r.branch] = ([(t.role, t.text) for t in r.turns], r.loss)
        assert r.formatted.count("</turn>\n") == len(r.turns)
    assert got == {
        (1, 1): ([("user", "root"), ("assistant", "high"), ("user", "")], "high"),
        (1, 2): ([("user", "root"), ("assistant", "low"), ("user", 'deep <b> & "')], "low"),
        (2, 1): ([("assistant", "orphan")], "orphan"),
        (None, 1): ([("", "</turn>\n")], ""),
        (4, 1): ([("user", "")], ""),
    }


def test_long_thread_and_hostile_texts(spark):
    texts = ["&lt;turn role=\"x\">\n", "</turn>", "&amp;amp;", "\\### Assistant: </turn> ok", "", None, "é🙂<", "a\nb"] * 9
    rows = [(5, t, ("user", "assistant")[t % 2], x) for t, x in enumerate(texts)] + [(6, 0, "assistant", "one"), (6, 0, "assistant", "one"), (6, None, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.tree_id: r for r in chat.read_back(chat.format_trees(chat.thread_messages(df))).collect()}
    turns = [(("user", "assistant")[k % 2], x or "") for k, x in enumerate(texts)]
    loss = "".join(x for role, x in turns if role == "assistant")
    assert (got[5].n_turns, got[5].turns_sha256) == (len(turns), sha("".join(f"{r}\n{x}\n" for r, x in turns)))
    assert (got[5].loss_chars, got[5].loss_sha256) == (len(loss), sha(loss))
    assert (got[6].n_turns, got[6].loss_chars, got[6].turns_sha256) == (3, 6, sha("\n\nassistant\none\nassistant\none\n"))


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.format_trees(chat.thread_messages(df))).count() == 0
