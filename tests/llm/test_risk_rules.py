import random
import re
from fractions import Fraction
from math import comb

from lodemine.llm import risk_rules

F = risk_rules.F
DOCS = "doc_id bigint, text string, lang string, kept int"


def brute(text):
    text = text or ""
    w = re.findall("[^\x20\x09-\x0d]+", text)
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    repeated = {p for i, x in enumerate(windows) if windows.count(x) > 1 for p in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated)


def test_statistics_match_brute_force(spark):
    rng = random.Random(2)
    texts = [None, "", " ", "\n\n", "a", "a b", "a b c", "a b c a b c", "a a a a", "é\x0b|ü\x0c<\r>", "x  y\nx  y\n x  y\n", "  a"]
    texts += ["".join(rng.choice(["a", "b", "c#", "dé"]) + rng.choice([" ", "\n", "  ", "\t"]) for _ in range(rng.randrange(60))) for _ in range(60)]
    texts += ["".join(f"w{rng.randrange(400)} " for _ in range(3000))]
    docs = spark.createDataFrame([(i, t, "x", 5) for i, t in enumerate(texts)], DOCS)
    got = risk_rules.statistics(docs, "text", [F.col("doc_id")]).select("doc_id", *risk_rules.COUNTS).collect()
    assert {r[0]: tuple(r)[1:] for r in got} == {i: brute(t) for i, t in enumerate(texts)}


def test_bound_is_the_exact_binomial(spark):
    cases = [(n, risk, level) for n in (1, 5, 60, 300, 1200) for risk in (0.005, 0.05, 0.3) for level in (0.2, 0.003)]
    frame = spark.createDataFrame([(n,) for n in sorted({c[0] for c in cases})], "n bigint")
    for risk, level in {c[1:] for c in cases}:
        for row in frame.select("n", risk_rules.most_rejections(F.col("n"), risk, F.lit(level)).alias("k")).collect():
            n, want, total, share = row["n"], -1, 0, Fraction(str(risk))
            for k in range(n + 1):
                total += comb(n, k) * share**k * (1 - share) ** (n - k)
                if total > level:
                    break
                want = k
            assert row["k"] == want


def test_cutoffs_stop_at_the_first_failure(spark):
    rng = random.Random(0)
    good = [("=en", rng.random() * 0.2) for _ in range(3000)] + [("=de", 0.5), ("=de", 0.1)]
    frame = spark.createDataFrame(good, "stratum string, v double")
    grid = [0.9, 0.5, 0.3, 0.2, 0.199, 0.19, 0.1]
    got = {r["stratum"]: r["r_cutoff"] for r in risk_rules.cutoffs(frame, "stratum", {"r": (F.col("v"), grid)}, 0.02, 0.05).collect()}
    assert got["=de"] is None
    rejected = sum(v > got["=en"] for s, v in good if s == "=en")
    level = 0.05 / 2
    assert sum(comb(3000, k) * 0.02**k * 0.98 ** (3000 - k) for k in range(rejected + 1)) <= level
    stricter = grid[grid.index(got["=en"]) + 1]
    more = sum(v > stricter for s, v in good if s == "=en")
    assert more > 100 or sum(comb(3000, k) * 0.02**k * 0.98 ** (3000 - k) for k in range(more + 1)) > level


def test_verdicts_and_odd_rows(spark):
    clean = " ".join(f"word{i}" for i in range(80))
    rows = [(i, clean + f" x{i}", "en" if i % 2 else None, 0) for i in range(4000)]
    odd = [(9000, "$$$ " * 10 + " ".join(f"#{i}##" for i in range(90)), "en", 0), (9001, None, None, 0), (9002, "", "en", 0), (9003, "a b c " * 40, "zz", 0), (None, clean, "zz", 0), (0, rows[0][1], None, 0)]
    docs = spark.createDataFrame(rows + odd, DOCS)
    labels = spark.createDataFrame([(i, 1) for i in range(4000)] + [(9000, 0), (9001, None), (None, 1)], "doc_id bigint, quality int")
    got = {}
    for r in risk_rules.judge(docs, labels).collect():
        got.setdefault(r["doc_id"], []).append((r["base_failed"], r["kept"]))
    assert all(got[i] == [(False, True)] for i in range(1, 4000)) and got[0] == [(False, True)] * 2
    assert got[9000] == [(False, False)] and got[9001] == got[9002] == got[9003] == [(True, False)] and got[None] == [(False, True)]
    none = risk_rules.judge(docs.where("doc_id in (1, 9001)"), labels.limit(0)).collect()
    assert sorted((r["doc_id"], r["kept"]) for r in none) == [(1, True), (9001, False)]
    assert risk_rules.judge(docs.limit(0), labels).count() == 0


def test_small_strata_are_tested_in_one_pool(spark):
    good = [("=en", 0.01)] * 2000 + [(s, 0.02) for s in ("=de", "=es", "=fr") for _ in range(450)] + [("=odd", 0.35)] * 3
    frame = spark.createDataFrame(good, "stratum string, v double")
    rules = {r: (F.col("v"), [0.9, 0.5, 0.3, 0.05, 0.01]) for r in ("a", "b", "c", "d")}
    got = {r["stratum"]: (r["n_good"], r["a_cutoff"], r["d_cutoff"]) for r in risk_rules.cutoffs(frame, "stratum", rules, 0.005, 0.05).collect()}
    assert got["=en"] == (2000, 0.01, 0.01)
    assert {got[s] for s in ("=de", "=es", "=fr")} == {(450, 0.5, 0.5)}  # three rejections in 1,353 labels are too many
    assert got["=odd"] == (3, 0.5, 0.5)
    more = frame.unionByName(spark.createDataFrame([("=de", 0.02)] * 3000, frame.schema).withColumn("stratum", F.concat(F.lit("=x"), (F.rand(1) * 10).cast("int"))))
    got = {r["stratum"]: r["a_cutoff"] for r in risk_rules.cutoffs(more, "stratum", rules, 0.005, 0.05).collect()}
    assert got["=de"] == got["=x3"] == 0.05 and got["=odd"] == 0.5
    few = frame.where("stratum IN ('=en', '=de')")
    assert {r["stratum"]: r["a_cutoff"] for r in risk_rules.cutoffs(few, "stratum", rules, 0.005, 0.05).collect()} == {"=en": 0.01, "=de": None}
