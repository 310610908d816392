import hashlib
import random
import re

from lodemine.llm import pseudonyms

KEY = "k"


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def feistel(kind, a, b, ra, rb):
    for r in range(pseudonyms.ROUNDS):
        step = int(hashlib.sha256(f"{KEY}|{kind}|{r}|{a if r % 2 else b}".encode()).hexdigest()[:15], 16)
        if r % 2:
            b = (b + step % rb) % rb
        else:
            a = (a + step % ra) % ra
    return a, b


def run(spark, texts, undo=False):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").withColumn("kinds", pseudonyms.F.lit(1))
    out = (pseudonyms.reveal if undo else pseudonyms.pseudonymise)(docs, KEY)
    return [(r["text"], r["kinds"]) for r in sorted(out.collect(), key=lambda r: r["doc"]["doc_id"])]


def cards(rng, n):
    out = []
    for _ in range(n):
        body = "".join(rng.choice("0123456789") for _ in range(rng.choice([12, 13, 15, 18])))
        out.append(next(body + c for c in "0123456789" if luhn(body + c)))
    return out


def test_formats_and_exact_round_trip(spark):
    rng = random.Random(1)
    values = cards(rng, 30) + ["4111 1111 1111 1111", "4111-1111-1111-1111"]
    values += [f"+1 ({rng.randrange(200, 1000)}) 555-{rng.randrange(10000):04d}" for _ in range(20)] + ["212-555-0199", "1 999.000.0000", "+1 (017) 555-7713"]
    values += [f"{rng.randrange(1, 666):03d}-{rng.randrange(1, 100):02d}-{rng.randrange(1, 10000):04d}" for _ in range(20)] + ["667-01-0001", "899-99-9999", "001-01-0001", "665-01-0001"]
    values += [".".join(str(rng.randrange(256)) for _ in range(4)) for _ in range(20)]
    values += ["1800-01-01", "2199-12-31", "2024-02-29", "12/31/1999", "29.02.2000", "01.03.1900"]
    texts = [f"é {v}, and {v}. End\n" for v in values]
    new = run(spark, texts)
    for value, text, (changed, kinds) in zip(values, texts, new, strict=True):
        assert len(kinds) == 2 and kinds[0] == kinds[1]
        found = re.fullmatch(r"é (.*), and (.*)\. End\n", changed, re.S)
        assert found[1] == found[2]
        if kinds[0] != "ip":
            assert re.sub("[0-9]", "0", found[1]) == re.sub("[0-9]", "0", value)
        if kinds[0] == "card":
            assert luhn(re.sub("[^0-9]", "", found[1]))
        assert changed != text or value in ("x",)
    assert [t for t, _ in run(spark, [t for t, _ in new], undo=True)] == texts
    assert new[30][0].replace(" ", "-") == new[31][0].replace(" ", "-")


def test_permutation_is_the_documented_network(spark):
    (text, kinds), = run(spark, ["10.2.3.4"])
    a, b = feistel("ip", 10 * 256 + 2, 3 * 256 + 4, 65536, 65536)
    assert kinds == ["ip"] and text == f"{a // 256}.{a % 256}.{b // 256}.{b % 256}"


def test_invalid_values_and_odd_texts_stay(spark):
    texts = [None, "", "no values", "4111111111111112", "256.1.1.1", "1.2.3.4.5", "000-12-3456", "666-01-0001", "2023-02-29", "13/40/2000", "1799-12-31", "123", "112-555-0000"]
    assert [t for t, _ in run(spark, texts)] == texts
    assert all(k == [] for _, k in run(spark, texts))


def test_values_beside_each_other(spark):
    """A neighbour neither hides a value nor changes its pseudonym."""
    card, grouped, phone, ip = "4111111111111111", "4111 1111 1111 1111", "555-123-4567", "144.137.247.239"
    alone = {v: run(spark, [v])[0][0] for v in (card, grouped, phone, ip)}
    texts = [f"{card} 123", f"order 12 {grouped}", f"{grouped} 123", f"{grouped} {phone}", f"{card} {ip}", f"{grouped} {ip}", f"{card} {phone} {ip}", f"1234 {grouped}", f"{grouped} {grouped}"]
    new = run(spark, texts)
    for text, (got, _) in zip(texts, new, strict=True):
        want = text
        for value, pseudonym in alone.items():
            want = want.replace(value, pseudonym)
        assert got == want and all(v not in got for v in alone)
    assert [t for t, _ in run(spark, [t for t, _ in new[:7]], undo=True)] == texts[:7]
    assert alone[grouped].replace(" ", "") == alone[card]


def test_more_layouts_and_their_links(spark):
    values = ["25/12/1999", "31/01/2000", "29/02/2000", "1999/12/25", "5551234567", "(555)1234567", "(555) 1234567", "+15551234567", "+44 20 7946 0958", "+442079460958", "+49 (0)30 901820"]
    values += ["3782 822463 10005", "3056-930902-5904", "4111-1111-1111-1111-110"]
    got = run(spark, values)
    assert all(len(k) == 1 and t != v for v, (t, k) in zip(values, got, strict=True))
    new = [t for t, _ in got]
    assert [t for t, _ in run(spark, new, undo=True)] == values
    for v, t in zip(values, new, strict=True):
        assert re.sub("[0-9]", "0", v) == re.sub("[0-9]", "0", t)
    assert int(new[0][:2]) > 12 and new[3].replace("/", "-") == run(spark, ["1999-12-25"])[0][0]
    bare = [re.sub("[^0-9]", "", t) for t in new]
    assert bare[4] == bare[5] == bare[6] == bare[7][1:] and bare[8] == bare[9] and new[8][:3] == "+44"


def test_all_days_behind_the_twelfth_are_permuted_among_each_other(spark):
    import datetime

    days = [datetime.date(1800, 1, 1) + datetime.timedelta(d) for d in range(0, 146097, 37)]
    values = [d.strftime("%d/%m/%Y") for d in days if d.day > 12]
    new = [t for t, _ in run(spark, values)]
    assert len(set(new)) == len(values) and all(int(t[:2]) > 12 for t in new)
    assert [t for t, _ in run(spark, new, undo=True)] == values


def test_numbers_that_are_no_phone(spark):
    texts = ["3.5551234567", "id-5551234567", "5551234567.25", "x5551234567", "1551234567", "55512345678"]
    assert [t for t, _ in run(spark, texts)] == texts


def test_long_runs_take_linear_time(spark):
    import time

    run(spark, ["a@b.cc"])
    start = time.time()
    texts = ["a" * 1_000_000, "x@" + "a" * 1_000_000, "1" * 1_000_000, "a@" * 300_000, "1 " * 300_000, "1234 " * 2_000 + "x", "a.b-" * 250_000]
    assert [len(t) for t, _ in run(spark, texts)] == [len(t) for t in texts]
    assert time.time() - start < 60


def test_mails_are_linked_and_long_texts_whole(spark):
    long = "Ann a.b@x.example.com " + "word " * 100_000 + "A.B@x.example.com."
    (text, kinds), (again, _) = run(spark, [long, "a.b@x.example.com"])
    found = re.findall(r"u[0-9a-f]{16}@mail\.invalid", text)
    assert kinds == ["email", "email"] and found == [again, again] and text.count("word ") == 100_000


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id int, text string")
    assert pseudonyms.pseudonymise(docs, KEY).count() == 0
