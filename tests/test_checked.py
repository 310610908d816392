from lodemine.sources import checked


def write(path, text):
    path.write_text(text, encoding="utf8")
    return str(path)


def kept(c):
    return sorted(map(repr, c.good().collect())), sorted((r.line, r.reason) for r in c.rejects().collect())


def test_json_lines(spark, tmp_path):
    lines = ['{"a":1,"b":"x"}', "{oops", '{"a":"one","b":"x"}', "[1]", "7", '{"b":null}', "", '{"a":2,"b":"y","c":[1]}', '{"a":1,"b":"x"}']
    c = checked.json_lines(spark, write(tmp_path / "in.json", "\n".join(lines)), "a bigint, b string")
    good, bad = kept(c)
    assert good == sorted(["Row(a=1, b='x')", "Row(a=1, b='x')", "Row(a=None, b=None)", "Row(a=2, b='y')"])
    assert bad == sorted([("{oops", "not json"), ('{"a":"one","b":"x"}', "wrong type"), ("[1]", "not json"), ("7", "not json")])


def test_csv_lines_drop_every_header_line(spark, tmp_path):
    folder = tmp_path / "csv"
    folder.mkdir()
    write(folder / "1.csv", 'id,name\n1,"a, b"\n2,c,d\nid,name\n\n3,\n')
    write(folder / "2.csv", 'id,name\nx,"say ""hi"""\n4,"say ""hi"""\n5\n')
    c = checked.csv_lines(spark, str(folder), "id bigint, name string").stored()
    good, bad = kept(c)
    assert good == sorted(["Row(id=1, name='a, b')", "Row(id=3, name=None)", "Row(id=4, name='say \"hi\"')"])
    assert bad == sorted([("2,c,d", "field count"), ('x,"say ""hi"""', "wrong type"), ("5", "field count")])
    counts = {r.file.rsplit("/", 1)[1]: (r.n_lines, r.n_rejected) for r in c.counts().collect()}
    assert counts == {"1.csv": (3, 1), "2.csv": (3, 2)}


def test_points(spark, tmp_path):
    path = write(tmp_path / "p.csv", "0,-1,1.5,2\n1,3,0\n2,1,x,1\n,1,1,1\n3,0,1e3,-4.25\n")
    good, bad = kept(checked.points(spark, path, 2))
    assert good == ["Row(id=0, truth=-1, features=[1.5, 2.0])", "Row(id=3, truth=0, features=[1000.0, -4.25])"]
    assert bad == sorted([("1,3,0", "field count"), ("2,1,x,1", "wrong type"), (",1,1,1", "wrong type")])


def test_empty_file(spark, tmp_path):
    path = write(tmp_path / "e.txt", "")
    for c in (checked.json_lines(spark, path, "a bigint"), checked.csv_lines(spark, path, "a bigint"), checked.points(spark, path, 1)):
        assert kept(c) == ([], []) and c.counts().count() == 0
