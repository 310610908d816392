"""Chat formatting of reply trees: root-to-leaf paths by iterative self-joins, ranked, each formatted as one conversation.

1. Every message knows its parent. Self-joins double the reach of each message's ancestor link, so all depths and path scores
   are known after about log2(depth) joins; each round's links are stored.
2. Leaves are ranked within their tree by the mean score of their path (then the longer path, then the smaller leaf id), and the best
   ``best`` of them are chosen, or all.
3. The same links, applied shortest first, list the messages of the chosen paths only.
4. Messages are formatted and put together in order, in pieces of at most ``per_piece`` messages: a conversation is the concatenation of
   its pieces. Each piece carries its loss mask, the stretches of assistant text.

The template of a message is ``### role: text</turn>`` and a line feed. Inside texts and roles a backslash is put before every backslash, ``###`` and
``</turn>`` (in roles also before a colon), so marks are unambiguous and ``unescape`` restores the text.

Defined results: null texts and roles are empty. A message whose parent is null or unknown is a root. Messages on or below a cycle have no
root and are in no path. Messages with a null tree or node belong to no tree and are left out. Among repeated (tree, node) rows the
smallest (parent, role, text) counts. A null score counts as 0. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodemine.llm.common import slices
from lodemine.session import materialize

END = "</turn>"
#: One formatted message: role and text, still escaped.
MESSAGE = re.compile(r"### ((?:[^\\:]++|\\.)*+): ((?:[^\\<]++|\\.|<(?!/turn>))*+)</turn>\n", re.S)


def escaped(value: Column, role: bool = False) -> Column:
    out = F.coalesce(value, F.lit(""))
    for mark in ("\\", "###", END, *([":"] if role else [])):
        out = F.replace(out, F.lit(mark), F.lit("\\" + mark))
    return out


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def chosen_paths(messages: DataFrame, best: int | None = None) -> DataFrame:
    """(tree, leaf, rank, place, role, text): the messages of the chosen paths, numbered from the root.

    ``messages`` has the columns tree, node, parent, role, text and score.
    """
    clean = (
        messages.where(F.col("tree").isNotNull() & F.col("node").isNotNull())
        .groupBy("tree", "node")
        .agg(F.min(F.struct("parent", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("score", F.lit(0.0)).alias("score"))).alias("m"))
        .select("tree", "node", "m.*")
    )
    clean = materialize(clean)
    nodes = clean.select("tree", F.col("node").alias("parent"), F.lit(True).alias("known"))
    link = clean.select("tree", "node", "parent", "score").join(nodes, ["tree", "parent"], "left")
    link = link.select("tree", "node", F.when(F.col("known"), F.col("parent")).alias("up"), F.lit(1).cast("bigint").alias("size"), F.col("score").alias("total"))
    # A link that has passed its root is done; only the others are joined on.
    link = materialize(link)
    done, links = [link.where("up IS NULL")], [link.where("up IS NOT NULL")]
    n_nodes = clean.count()
    while (1 << (len(links) - 1)) < n_nodes and not links[-1].isEmpty():
        state = links[-1]
        for part in done:
            state = state.unionByName(part)
        far = state.select("tree", F.col("node").alias("up"), F.col("up").alias("up2"), F.col("size").alias("size2"), F.col("total").alias("total2"))
        # Sizes and totals cover the messages from the node up to, but without, its link's target.
        further = links[-1].join(far, ["tree", "up"]).select(
            "tree", "node", F.col("up2").alias("up"), (F.col("size") + F.col("size2")).alias("size"), (F.col("total") + F.col("total2")).alias("total")
        )
        further = materialize(further)
        done.append(further.where("up IS NULL"))
        links.append(further.where("up IS NOT NULL"))
    parents = links[0].select("tree", F.col("up").alias("node"))
    whole = done[0]
    for part in done[1:]:
        whole = whole.unionByName(part)
    leaves = whole.join(parents, ["tree", "node"], "left_anti")
    order = Window.partitionBy("tree").orderBy(F.desc(F.col("total") / F.col("size")), F.desc("size"), "node")
    ranked = leaves.withColumn("rank", F.row_number().over(order))
    if best is not None:
        ranked = ranked.where(F.col("rank") <= best)
    paths = ranked.select("tree", F.col("node").alias("leaf"), "rank", "node", (F.col("size") - 1).alias("place"))
    for k, known in enumerate(links):
        step = known.select("tree", "node", "up")
        above = paths.join(step, ["tree", "node"]).select("tree", "leaf", "rank", F.col("up").alias("node"), (F.col("place") - (1 << k)).alias("place"))
        paths = materialize(paths.unionByName(above))
    return paths.join(clean.select("tree", "node", "role", "text"), ["tree", "node"]).select("tree", "leaf", "rank", "place", "role", "text")


def formatted(paths: DataFrame, per_piece: int = 200) -> DataFrame:
    """(tree, leaf, rank, piece, text, mask): formatted conversations in pieces; masks hold code-point offsets within the piece."""
    head = F.concat(F.lit("### "), escaped(F.col("role"), role=True), F.lit(": "))
    turn = F.struct("place", F.concat(head, escaped(F.col("text")), F.lit(END + "\n")).alias("text"), F.length(head).alias("head"), (F.col("role") == "assistant").alias("loss"))
    pieces = paths.groupBy("tree", "leaf", "rank", F.floor(F.col("place") / per_piece).alias("piece")).agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    # Sizes of the turns before each turn, added up along the piece.
    offsets = F.aggregate(
        "turns",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("mask")),
        lambda s, t: F.struct(
            (s["at"] + F.length(t["text"])).alias("at"),
            F.when(
                t["loss"], F.concat(s["mask"], F.array(F.struct((s["at"] + t["head"]).alias("start"), (s["at"] + F.length(t["text"]) - len(END) - 1).alias("end"))))
            ).otherwise(s["mask"]).alias("mask"),
        ),
        lambda s: s["mask"],
    )
    return pieces.select("tree", "leaf", "rank", "piece", F.array_join("turns.text", "").alias("text"), offsets.alias("mask"))


def read_back(pieces: DataFrame) -> DataFrame:
    """(tree, leaf, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), parsed from formatted pieces.

    The pieces of a conversation follow each other in one task, which keeps two running digests and no text.
    """
    kind = dict(pieces.dtypes)
    schema = f"tree {kind['tree']}, leaf {kind['leaf']}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    names = ["tree", "leaf", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        key, state = None, None
        done: list[tuple] = []

        def finished() -> tuple:
            return (*key, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4])

        def sent(rows: list[tuple], kinds: list[pa.DataType]) -> pa.RecordBatch:
            columns = zip(*rows, strict=True) if rows else [[] for _ in names]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

        kinds = None
        for batch in slices(batches, "text"):
            kinds = [batch.schema.field("tree").type, batch.schema.field("leaf").type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            for tree, leaf, text, mask in zip(*[batch.column(c).to_pylist() for c in ("tree", "leaf", "text", "mask")], strict=True):
                if key != (tree, leaf):
                    if key is not None:
                        done.append(finished())
                    key, state = (tree, leaf), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for m in MESSAGE.finditer(text):
                    state[0] += 1
                    for part in m.groups():
                        state[1].update((unescape(part) + "\n").encode("utf-8", "surrogatepass"))
                for span in mask:
                    part = unescape(text[span["start"] : span["end"]])
                    state[2] += len(part)
                    state[3].update(part.encode("utf-8", "surrogatepass"))
                state[4] += len(text)
            yield sent(done, kinds)
            done = []
        if key is not None:
            yield sent([finished()], kinds)

    ordered = pieces.select("tree", "leaf", "piece", "text", "mask").repartition("tree", "leaf").sortWithinPartitions("tree", "leaf", "piece")
    return ordered.mapInArrow(parse, schema)
