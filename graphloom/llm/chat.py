"""Operator 4: reply trees to conversations: paths by iterative self-joins, ranked branches, a reversible chat template."""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import cut, table

# Fixed values of the template. A turn is OPEN, role, MIDDLE, text, CLOSE. Inside roles and texts a backslash stands before
# every backslash, '#', '<' and ':' so that no control string can occur there.
OPEN, MIDDLE, CLOSE = "### ", ": ", " </turn>\n"
_ESCAPED = re.compile(r"[\\#<:]")
_TURN = re.compile(r"### ((?:[^\\#<:]|\\.)*): ((?:[^\\#<:]|\\.)*) </turn>\n", re.S)
#: The role whose texts the loss is taken over.
LEARNED = "assistant"


def escape(text: str) -> str:
    return _ESCAPED.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def format_turns(turns: list[tuple[str | None, str | None]], learned: str = LEARNED) -> tuple[str, list[list[int]]]:
    """The conversation as one string, and the [start, end) code points of the texts that the loss is taken over. Nulls are empty."""
    out, mask, at = [], [], 0
    for role, text in turns:
        head, body = f"{OPEN}{escape(role or '')}{MIDDLE}", escape(text or "")
        if (role or "") == learned:
            mask.append([at + len(head), at + len(head) + len(body)])
        out.append(head + body + CLOSE)
        at += len(out[-1])
    return "".join(out), mask


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) pairs that ``format_turns`` was given."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


def _formatter(batches):
    for batch in batches:
        made = [format_turns([(t["role"], t["text"]) for t in turns]) for turns in batch.column("turns").to_pylist()]
        rest = batch.drop_columns(["turns"])
        yield pa.RecordBatch.from_arrays([*rest.columns, pa.array([f for f, _ in made], pa.string()), pa.array([m for _, m in made], pa.list_(pa.list_(pa.int64())))], names=[*rest.schema.names, "formatted", "mask"])


def _ancestors(nodes: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(tree, node, root, depth, total) of nodes that have a root, and for each k the (tree, node, jump) that lead 2^k up.

    Each self-join doubles the reach of every node, so a chain of n messages takes log2(n) of them. Messages in a cycle of
    parents, or below one, never reach a root; they end with the rounds, whose number the rows bound.
    """
    known = nodes.select("tree", F.col("node").alias("parent"), F.lit(True).alias("there")).distinct()
    state = nodes.join(known, ["tree", "parent"], "left")
    up = F.when(F.col("there"), F.col("parent"))
    state = cut(state.select("tree", "node", up.alias("jump"), F.when(up.isNull(), F.col("node")).alias("root"), F.lit(0).cast("long").alias("depth"), "score"), "tree")
    most, jumps = state.count(), []
    while True:
        step = state.filter("jump is not null").select("tree", "node", "jump")
        if (1 << len(jumps)) > most or step.isEmpty():
            return state.filter("root is not null").select("tree", "node", "root", "depth", F.col("score").alias("total")), jumps
        jumps.append(step)
        # only nodes that still have a way to go are joined; what a node jumps to is done, if it has no further jump
        above = state.select("tree", F.col("node").alias("jump"), F.col("jump").alias("next"), F.col("root").alias("r"), F.col("depth").alias("d"), F.col("score").alias("s"))
        moved = state.filter("jump is not null").join(above, ["tree", "jump"])
        depth = F.when(F.col("next").isNull(), F.col("d") + (1 << (len(jumps) - 1))).otherwise(F.col("depth"))
        moved = moved.select("tree", "node", F.col("next").alias("jump"), F.col("r").alias("root"), depth.alias("depth"), (F.col("score") + F.col("s")).alias("score"))
        state = cut(state.filter("jump is null").union(moved), "tree")


def reply_paths(messages: DataFrame, branches: int = 1) -> DataFrame:
    """One row per chosen root-to-leaf path of ``messages`` (tree, node, parent, role, text, score): tree, root, leaf, rank, score, turns.

    A message whose parent is null or not there is a root. A branch's score is the mean of its messages' scores (null: 0); the
    ``branches`` best of each root stay, of equal ones the deeper, then the one with the smaller leaf. ``turns`` holds (role,
    text) from root to leaf. Rows without a node are left out, of rows with the same tree and node the smallest one counts, a
    null tree is a tree. Messages in a cycle of parents belong to no path. Empty in, empty out.
    """
    spoken = messages.filter("node is not null").groupBy(F.struct("tree").alias("tree"), "node").agg(F.min(F.struct(F.col("parent"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"), "role", "text")).alias("m")).select("tree", "node", "m.*")
    spoken = cut(spoken, "messages")
    nodes = spoken.select("tree", "node", "parent", "score")
    found, jumps = _ancestors(nodes)
    leaves = found.join(nodes.select("tree", F.col("parent").alias("node")).distinct(), ["tree", "node"], "left_anti")
    scored = leaves.select("tree", "root", F.col("node").alias("leaf"), "depth", (F.col("total") / (F.col("depth") + 1)).alias("score"))
    best = Window.partitionBy("tree", "root").orderBy(F.desc("score"), F.desc("depth"), "leaf")
    chosen = scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= branches)
    on_path = chosen.select("tree", "leaf", F.col("leaf").alias("node"), F.lit(0).cast("long").alias("up"))
    for k, jump in enumerate(jumps):
        on_path = cut(on_path.union(on_path.join(jump, ["tree", "node"]).select("tree", "leaf", F.col("jump").alias("node"), F.col("up") + (1 << k))), "paths")
    turns = on_path.join(spoken.select("tree", "node", "role", "text"), ["tree", "node"]).groupBy("tree", "leaf").agg(F.sort_array(F.collect_list(F.struct((-F.col("up")).alias("at"), "role", "text"))).alias("turns"))
    turns = turns.withColumn("turns", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))))
    return chosen.join(turns, ["tree", "leaf"]).select(F.col("tree.tree").alias("tree"), "root", "leaf", "rank", "score", "turns")


def format_paths(paths: DataFrame) -> DataFrame:
    """``turns`` of each row formatted: formatted and mask (code point ranges under the loss) in its place. One row is one conversation."""
    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in paths.schema.fields if f.name != "turns")
    return paths.mapInArrow(_formatter, kept + "formatted string, mask array<array<bigint>>")


def linear(conversations: DataFrame) -> DataFrame:
    """Messages of a reply tree from conversations (conv_id, turn, role, text): each row answers the one before it by turn.

    Rows with the same turn follow each other by role and text; null turns come first. A conversation is one record in the end,
    so its rows are numbered in one task.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = conversations.select("conv_id", "turn", "role", "text").withColumn("node", F.row_number().over(order))
    return rows.select(F.col("conv_id").alias("tree"), "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def _read_back(batches):
    for batch in batches:
        out = {k: [] for k in ("n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")}
        for formatted, mask in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            turns = parse_turns(formatted)
            loss = "".join(unescape(formatted[a:b]) for a, b in mask)
            out["n_turns"].append(len(turns))
            out["turns_sha256"].append(hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest())
            out["loss_chars"].append(len(loss))
            out["loss_sha256"].append(hashlib.sha256(loss.encode()).hexdigest())
            out["formatted_chars"].append(len(formatted))
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, k) for v, k in zip(out.values(), kinds))], names=["conv_id", *out])


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.createDataFrame([(-7, t, r, r"\### Assistant: </turn> ok") for t, r in enumerate(("user", "assistant"))], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    written = cut(format_paths(reply_paths(linear(rows))).select(F.col("tree").alias("conv_id"), "formatted", "mask"), "chat")
    return written.mapInArrow(_read_back, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


_ESC = r"regexp_replace({}, '([\\#<:])', '\\\1', 'g')"
OP4_SQL = f"""
with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text, role as r0, text as t0 from conversations
  union all select -7, 0, 'user', '\\### Assistant: </turn> ok', 'user', '\\### Assistant: </turn> ok'
  union all select -7, 1, 'assistant', '\\### Assistant: </turn> ok', 'assistant', '\\### Assistant: </turn> ok')
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, r0 nulls first, t0 nulls first)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, r0 nulls first, t0 nulls first) filter (role = 'assistant'), '')) as loss_sha256,
  sum({len(OPEN) + len(MIDDLE) + len(CLOSE)} + length({_ESC.format('role')}) + length({_ESC.format('text')}))::bigint as formatted_chars
from c group by conv_id
"""
