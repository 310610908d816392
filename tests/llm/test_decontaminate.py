import random
import re

from lodemine.llm import decontaminate

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(text, items, window=13):
    own, hit, found = words(text), set(), set()
    for item, value in items:
        w = words(value)
        for s in range(max(1, len(w) - window + 1)) if w else []:
            part = w[s : s + window]
            for at in range(len(own) - len(part) + 1):
                if own[at : at + len(part)] == part:
                    hit.update(range(at, at + len(part)))
                    if item is not None:
                        found.add(str(item))
    return len(own), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(own)


def test_matches_brute_force_in_one_and_in_many_blocks(spark):
    rng = random.Random(3)

    def some(n):
        return "".join(rng.choice(["a", "B", "É", "a1"]) + rng.choice([" ", "--", ".\n"]) for _ in range(n))

    items = [(i, some(rng.choice([0, 1, 3, 13, 15, 30]))) for i in range(12)] + [(None, some(4)), (50, None), (51, " .. "), (3, "solo Word")]
    docs = [(i, some(rng.randrange(0, 120)), 7) for i in range(30)] + [(90, None, 1), (91, "", 1), (92, "\x00 SOLO\tword", 1), (None, "solo word", 1)]
    docs += [(93, "x " + items[5][1] + " pad" * 3, 2), docs[0]]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string, n_hit int")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    want = sorted((str(d[0]), *brute(d[1], items)) for d in docs)
    for block_words in (100_000, 20):
        found = decontaminate.find_overlaps(frame, bench, frame.columns, block_words=block_words).collect()
        got = sorted((str(r["doc"]["doc_id"]), r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in found)
        assert got == want
        for r in found:  # the stretches of the original text hold the hit words, and begin and end with one
            parts = [r["doc"]["text"][s["start"] : s["end"]] for s in r["spans"]]
            assert sum(len(words(p)) for p in parts) == r["n_hit"]
            assert all(WORD.match(p.translate(LOWER)) and words(p) for p in parts)


def test_clean_documents_keep_their_columns(spark):
    frame = spark.createDataFrame([(1, "one two", 5), (2, "three", None)], "doc_id bigint, text string, items int")
    bench = spark.createDataFrame([(9, "one")], "item_id bigint, text string")
    assert decontaminate.clean_documents(frame, bench).collect() == [(2, "three", None)]
    assert decontaminate.clean_documents(frame, bench.limit(0)).count() == 2
    assert decontaminate.clean_documents(frame.limit(0), bench).columns == frame.columns
