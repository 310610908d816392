import hashlib
import random
from collections import Counter

from lodemine.llm import reply_trees

F = reply_trees.F
SCHEMA = "tree bigint, node bigint, parent bigint, role string, text string, score double"


def brute(rows, best=None):
    """Paths by walking up from every leaf."""
    first = {}
    for r in rows:
        if r[0] is None or r[1] is None:
            continue
        r = (*r[:3], r[3] or "", r[4] or "", r[5] or 0.0)
        key = lambda x: (x[2] is not None, x[2] or 0, x[3], x[4])
        if r[:2] not in first or key(r) < key(first[r[:2]]):
            first[r[:2]] = r
    used = {(t, r[2]) for (t, _), r in first.items() if r[2] is not None}
    paths = {}
    for tree, leaf in first:
        if (tree, leaf) in used:
            continue
        path, at = [], leaf
        while at is not None and (tree, at) in first and len(path) <= len(first):
            path.append(first[tree, at])
            at = first[tree, at][2]
        if len(path) <= len(first):
            paths.setdefault(tree, []).append((-sum(p[5] for p in path) / len(path), -len(path), leaf, path[::-1]))
    out = []
    for tree, found in paths.items():
        for rank, (_, _, leaf, path) in enumerate(sorted(found, key=lambda x: x[:3])[:best], start=1):
            out += [(tree, leaf, rank, place, p[3], p[4]) for place, p in enumerate(path)]
    return sorted(out)


def test_paths_match_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for tree in range(6):
        n = rng.choice([1, 2, 30])
        rows += [(tree, k, rng.randrange(k) if k else None, rng.choice(["user", "assistant"]), f"t{k}", float(rng.randrange(8))) for k in range(n)]
    rows += [(50, k, k - 1 if k else None, "user", "x", 1.0) for k in range(70)]  # a chain
    rows += [(60, 1, 2, "user", "cycle", 1.0), (60, 2, 1, "user", "cycle", 1.0), (60, 3, 1, "user", "below", 1.0), (60, 4, 99, None, None, None)]
    rows += [(None, 1, None, "user", "lost", 1.0), (1, None, None, "user", "lost", 1.0), rows[0]]
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("rank", F.lit("clash"))
    for best in (None, 1, 2):
        assert sorted(map(tuple, reply_trees.chosen_paths(frame, best).collect())) == brute(rows, best)


def test_formatting_is_reversible_and_masks_assistant_text(spark):
    odd = ["\\### Assistant: </turn> ok", "", None, "</turn>\n### user: hi</turn>\n", "\\\\</turn", "####", "é\n\\", "a" * 100_000 + "###"]
    rows = []
    for tree, texts in enumerate([odd, odd[::-1], [None], ["x"] * 450]):
        rows += [(tree, k, k - 1 if k else None, ["user", "assistant", None, "od:d\\"][k % 4], t, 0.0) for k, t in enumerate(texts)]
    pieces = reply_trees.formatted(reply_trees.chosen_paths(spark.createDataFrame(rows, SCHEMA)), per_piece=3)
    got = {r["tree"]: r for r in reply_trees.read_back(pieces).collect()}
    sizes = Counter()
    for r in pieces.collect():
        sizes[r["tree"]] += len(r["text"])
    for tree in got:
        mine = [r for r in rows if r[0] == tree]
        turns = "".join(f"{r[3] or ''}\n{r[4] or ''}\n" for r in mine)
        loss = "".join(r[4] or "" for r in mine if r[3] == "assistant")
        r = got[tree]
        assert (r["n_turns"], r["turns_sha256"]) == (len(mine), hashlib.sha256(turns.encode()).hexdigest())
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r["formatted_chars"] == sizes[tree]


def test_empty(spark):
    pieces = reply_trees.formatted(reply_trees.chosen_paths(spark.createDataFrame([], SCHEMA)))
    assert reply_trees.read_back(pieces).count() == 0
