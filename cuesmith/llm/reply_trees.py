"""Chat formatting of reply trees.

Messages point to the message they answer. Pointer jumping - each round joins
the table with itself and doubles the distance every message looks back - finds
depth, root and the sum of scores up to it in log2(longest path) joins. So branches
are ranked while they are still one row a leaf - by the mean score of their
messages (ties: longer, then smaller leaf) - and only from the best ``keep``
leaves of a root the jumps are walked again, doubling, which enumerates the
messages of their paths; each path is formatted as one conversation.

A message is marked ``<s>[X]\\n...[/X]</s>\\n``, X being INST, OUT or SYS for user,
assistant and system, else ``ROLE=`` and the role in hexadecimal. Inside texts a
backslash is doubled, and each control string has one after its first
character, so no text can open or close a message and the original comes back
exactly. Loss spans cover the escaped text of assistant messages, in code points
of the formatted string.

Cases: null texts and roles count as empty; messages whose tree is null are one
tree; a parent that is not there makes its
child a root; messages on a circle of answers belong to no tree and take no part;
equal (tree, message) ids are one message each if their rows are numbered first
(:func:`chain` does so); an empty table gives no row; other columns are not
carried.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuesmith.llm.common import clear_columns, staged

MARKS = {"user": "INST", "assistant": "OUT", "system": "SYS"}
#: Every string that the template gives a meaning.
CONTROLS = ("<s>", "</s>", *(f"[{x}]" for x in MARKS.values()), *(f"[/{x}]" for x in MARKS.values()), "[ROLE=", "[/ROLE=")
MESSAGE = re.compile(r"<s>\[(INST|OUT|SYS|ROLE=[0-9A-F]*)\]\n(.*?)\[/\1\]</s>\n", re.S)


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROLS:
        out = F.replace(out, F.lit(c), F.lit(c[0] + "\\" + c[1:]))
    return out


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


def mark(role: Column) -> Column:
    out = F.concat(F.lit("ROLE="), F.hex(F.encode(role, "UTF-8")))
    for name, x in MARKS.items():
        out = F.when(role == name, x).otherwise(out)
    return out


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) messages of a formatted conversation."""
    names = {x: name for name, x in MARKS.items()}
    return [(names.get(m[1]) or bytes.fromhex(m[1][5:]).decode(), unescape(m[2])) for m in MESSAGE.finditer(formatted)]


def chain(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as trees without branches: each answers the one before."""
    turns = clear_columns(turns, "conv_id", "turn", "role", "text")
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    turns = turns.withColumn("node", F.row_number().over(order).cast("long"))
    return turns.select(F.col("conv_id").alias("tree"), "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def _keyed(nodes: DataFrame) -> DataFrame:
    """``tree`` as a struct that is never null, so that joins on it keep the null tree."""
    return nodes.withColumn("tree", F.struct(F.col("tree").alias("id")))


def paths(nodes: DataFrame) -> DataFrame:
    """(tree, root, leaf, pos, node) for every root-to-leaf path; ``pos`` 0 is the root."""
    return _paths(_keyed(nodes), None).drop("n_turns").withColumn("tree", F.col("tree.id"))


def _paths(nodes: DataFrame, keep: int | None) -> DataFrame:
    """As :func:`paths` with ``n_turns``, for the ``keep`` best leaves of each root."""
    links = nodes.select("tree", "node", "parent", F.coalesce("score", F.lit(0.0)).alias("total"))
    known = links.select("tree", F.col("node").alias("parent"), F.lit(True).alias("there"))
    links = links.join(known, ["tree", "parent"], "left").select("tree", "node", F.when(F.col("there"), F.col("parent")).alias("up"), "total")
    # jumps[k]: the ancestor 2**k steps up, where there is one; total: scores from the message to below that ancestor
    step = staged(links.withColumn("root", F.when(F.col("up").isNull(), F.col("node"))).withColumn("depth", F.when(F.col("up").isNull(), 0).cast("long")), "tree-0")
    leaves = step.select("tree", F.col("node").alias("leaf")).join(step.select("tree", F.col("up").alias("leaf")), ["tree", "leaf"], "left_anti")
    jumps, most = [], max(1, nodes.count()).bit_length() + 1
    done, open_ = step.where("up is null"), step.where("up is not null")
    while open_.head(1) and len(jumps) <= most:  # what is left after that lies on, or hangs from, a circle
        jumps.append(open_.select("tree", "node", "up"))
        above = done.unionByName(open_).select("tree", F.col("node").alias("up"), F.col("up").alias("next"), F.col("root").alias("r"), F.col("depth").alias("d"), F.col("total").alias("more"))
        # only messages whose root is not known yet are looked up
        looked = staged(open_.select("tree", "node", "up", "total").join(above, ["tree", "up"]).select(
            "tree", "node", F.when(F.col("r").isNull(), F.col("next")).alias("up"), F.col("r").alias("root"),
            (F.col("d") + (1 << len(jumps) - 1)).alias("depth"), (F.col("total") + F.col("more")).alias("total"),
        ), f"tree-{len(jumps)}")
        done, open_ = done.unionByName(looked.where("root is not null")), looked.where("root is null")
    ends = leaves.join(done.select("tree", F.col("node").alias("leaf"), "root", "depth", "total"), ["tree", "leaf"])
    ends = ends.withColumn("n_turns", F.col("depth") + 1)
    if keep is not None:
        best = Window.partitionBy("tree", "root").orderBy(F.desc(F.col("total") / F.col("n_turns")), F.desc("n_turns"), "leaf")
        ends = staged(ends.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= keep), "leaves")
    out = ends.select("tree", "root", "leaf", "n_turns", F.col("leaf").alias("node"), F.col("depth").alias("pos"))
    for k in reversed(range(len(jumps))):
        here = F.struct("node", "pos")
        above = F.when(F.col("pos") >= 1 << k, F.struct(F.col("up").alias("node"), (F.col("pos") - (1 << k)).alias("pos")))
        out = out.join(jumps[k], ["tree", "node"], "left").withColumn("at", F.explode(F.array_compact(F.array(here, above))))
        out = out.select("tree", "root", "leaf", "n_turns", "at.node", "at.pos")
    return out


def conversations(nodes: DataFrame, keep: int = 1) -> DataFrame:
    """(tree, leaf, n_turns, formatted, spans): the ``keep`` best branches of each root, formatted.

    ``nodes``: tree, node, parent (null: a root), role, text, score.
    """
    nodes = _keyed(nodes)
    walked = _paths(nodes, keep)
    texts = nodes.select("tree", "node", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    x, body = mark(F.col("role")), escape(F.col("text"))
    said = texts.select("tree", "node", (F.col("role") == "assistant").alias("loss"), x.alias("x"), body.alias("body"))
    said = said.select(
        "tree", "node", "loss", F.concat(F.lit("<s>["), "x", F.lit("]\n"), "body", F.lit("[/"), "x", F.lit("]</s>\n")).alias("said"),
        (F.length("x") + 6).cast("long").alias("head"), F.length("body").cast("long").alias("size"),
    )
    rows = walked.join(said, ["tree", "node"])
    before = Window.partitionBy("tree", "leaf").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("at", F.coalesce(F.sum(F.length("said")).over(before), F.lit(0)) + F.col("head"))
    turn = F.struct("pos", "said", "loss", "at", (F.col("at") + F.col("size")).alias("end"))
    whole = rows.groupBy("tree", "leaf").agg(F.first("n_turns").alias("n_turns"), F.array_sort(F.collect_list(turn)).alias("turns"))
    return whole.select(
        F.col("tree.id").alias("tree"), "leaf", "n_turns", F.array_join(F.transform("turns", lambda t: t["said"]), "").alias("formatted"),
        F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: F.struct(t["at"].alias("start"), t["end"].alias("end"))).alias("spans"),
    )
