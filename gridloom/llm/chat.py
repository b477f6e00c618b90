"""Chat formatting from reply trees (operator 8), with DataFrame functions only.

Messages form trees by parent ids. Self-joins of the jump table double the distance each round, so a
tree of depth d takes log2(d) rounds: they give every leaf the length and the summed score of its path from
the root, branches are ranked by score, and a second run over the same jump tables enumerates the messages
of the chosen paths. Each chosen path becomes one text:

    <turn role="R">\\n TEXT </turn>\\n        (without the blanks shown here)

``&`` and ``<`` of a text are written ``&amp;`` and ``&lt;`` (in a role ``"`` is ``&quot;`` too), so no text
can hold a control string, and ``parse`` gives roles and texts back unchanged.

Defined results: a null text, role or score is empty, empty or 0; a message without an id is skipped; of
messages with one id in one tree the first by (parent, score, role, text) counts; a parent that does not
exist makes a root; messages on a circle have no root and are left out; branches of equal score go by
length (longer first), then by leaf id. A null tree id is a tree of its own. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.shared import cut, drop_cut

OPEN, HEAD_END, CLOSE = '<turn role="', '">\n', "</turn>\n"


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&quot;"), F.lit('"')), F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def thread_messages(conversations: DataFrame) -> DataFrame:
    """Messages of linear conversations: every turn answers the one before it (ties by role, then text)."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    m = conversations.select(F.col("conv_id").alias("tree_id"), F.row_number().over(order).cast("long").alias("msg_id"), "role", "text")
    return m.select("tree_id", "msg_id", F.when(F.col("msg_id") > 1, F.col("msg_id") - 1).alias("parent_id"), "role", "text", F.lit(0.0).alias("score"))


def _on_parent(left: DataFrame, right: DataFrame, key: str, how: str) -> DataFrame:
    r = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns])
    return left.join(r, F.col("tree_id").eqNullSafe(F.col("r_tree_id")) & (F.col(key) == F.col("r_msg_id")), how)


def chosen_paths(messages: DataFrame, branches: int = 1) -> DataFrame:
    """(tree_id, branch, place, role, text): the best ``branches`` root-to-leaf paths of each tree."""
    first = F.min(F.struct("parent_id", F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")))
    nodes = cut(
        messages.filter(F.col("msg_id").isNotNull()).groupBy("tree_id", "msg_id").agg(first.alias("m")).select("tree_id", "msg_id", F.when(F.col("m.parent_id") != F.col("msg_id"), F.col("m.parent_id")).alias("parent_id"), "m.score", "m.role", "m.text"),
        "nodes",
    )
    ids = nodes.select("tree_id", "msg_id", "parent_id", "score")
    # up: the message at the jump's distance; total: scores from here up to just below it; hops: messages so
    tables = [cut(_on_parent(ids, ids.select("tree_id", "msg_id"), "parent_id", "left").select("tree_id", "msg_id", F.col("r_msg_id").alias("up"), F.col("score").alias("total"), F.lit(1).cast("long").alias("hops")), "jump")]
    jumps = [tables[0].filter(F.col("up").isNotNull())]
    rooted = tables[0].filter(F.col("up").isNull())
    open_before = None
    while (still := jumps[-1].count()) and still != open_before:  # only messages that have not met their root go on
        open_before = still
        step = _on_parent(jumps[-1], jumps[-1].unionByName(rooted), "up", "left").select(
            "tree_id", "msg_id", F.col("r_up").alias("up"), (F.col("total") + F.coalesce("r_total", F.lit(0.0))).alias("total"), (F.col("hops") + F.coalesce("r_hops", F.lit(0))).alias("hops")
        )
        tables.append(cut(step, "jump"))
        jumps.append(tables[-1].filter(F.col("up").isNotNull()))
        rooted = rooted.unionByName(tables[-1].filter(F.col("up").isNull()))
    parents = ids.filter(F.col("parent_id").isNotNull()).select("tree_id", F.col("parent_id").alias("msg_id")).distinct()
    leaves = _on_parent(rooted, parents, "msg_id", "left_anti")
    rank = Window.partitionBy("tree_id").orderBy(F.desc("total"), F.desc("hops"), "msg_id")
    path = leaves.withColumn("branch", F.row_number().over(rank)).filter(F.col("branch") <= branches)
    path = cut(path.select("tree_id", "branch", "msg_id", F.col("hops").alias("place")), "path")
    parts = [path]
    for k, jump in enumerate(jumps[:-1]):
        above = _on_parent(path, jump.select("tree_id", "msg_id", "up"), "msg_id", "inner")
        above = above.select("tree_id", "branch", F.col("r_up").alias("msg_id"), (F.col("place") - (1 << k)).alias("place"))
        path = cut(path.unionByName(above), "path")
        parts.append(path)
    out = _on_parent(path, nodes.select("tree_id", "msg_id", "role", "text"), "msg_id", "inner")
    out = out.select("tree_id", "branch", "place", F.col("r_role").alias("role"), F.col("r_text").alias("text"))
    drop_cut(*tables, *parts[:-1])
    return out


def format_paths(paths: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """One row for each path: tree_id, branch, formatted, loss_spans (code points [start, end) of ``formatted``)."""
    role = F.replace(escape(F.col("role")), F.lit('"'), F.lit("&quot;"))
    pieces = paths.select("tree_id", "branch", "place", "role", F.concat(F.lit(OPEN), role, F.lit(HEAD_END)).alias("head"), escape(F.col("text")).alias("body"))
    size = F.length("head") + F.length("body") + len(CLOSE)
    before = Window.partitionBy("tree_id", "branch").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("start", F.coalesce(F.sum(size.cast("long")).over(before), F.lit(0).cast("long")) + F.length("head"))
    span = F.struct("place", F.col("start"), (F.col("start") + F.length("body")).alias("end"))
    grouped = pieces.groupBy("tree_id", "branch").agg(
        F.sort_array(F.collect_list(F.struct("place", F.concat("head", "body", F.lit(CLOSE)).alias("turn")))).alias("turns"),
        F.sort_array(F.collect_list(F.when(F.col("role") == trained_role, span))).alias("spans"),
    )
    return grouped.select("tree_id", "branch", F.array_join("turns.turn", "").alias("formatted"), F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias("loss_spans"))


def parse(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted path, as they were before formatting."""
    blocks = F.filter(F.split(formatted, CLOSE), lambda b: b != "")

    def turn(b: Column) -> Column:
        at = F.instr(b, HEAD_END)
        return F.struct(unescape(F.substr(b, F.lit(len(OPEN) + 1), at - len(OPEN) - 1)).alias("role"), unescape(F.substr(b, at + len(HEAD_END))).alias("text"))

    return F.transform(blocks, turn)


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")


def read_back(formatted: DataFrame) -> DataFrame:
    """What a reader of the output gets: counts and digests by tree and branch."""
    back = formatted.select("tree_id", "branch", parse(F.col("formatted")).alias("turns"), loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "tree_id", "branch", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars"
    )


def format_trees(messages: DataFrame, branches: int = 1, trained_role: str = "assistant") -> DataFrame:
    return format_paths(chosen_paths(messages, branches), trained_role)
