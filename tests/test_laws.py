"""Laws: merges do not depend on order, grouping or repetition; codecs and formats invert each other."""

import random
import struct

import pytest
from pyspark.sql import functions as F

from siltmark.functions import paths, ron64, slices
from siltmark.operators import crdt, documents, keyspace, merkle, swarm, tree, vectors, versioned
from siltmark.sources import formats

OPS = [(1, "f", r, s, v) for r, s, v in [(1, 1, 1), (2, 2, 2), (2, 1, 3), (-2, 3, 3), (5, 1, 9), (-5, 2, 4)]] + [(2, "g", -3, 1, 7), (2, "g", 1, 2, 8)]


def ops(spark, rows):
    return spark.createDataFrame(rows, "obj bigint, field string, rev bigint, src bigint, val bigint")


@pytest.mark.parametrize("merge", [lambda d: crdt.lww(d, "obj", "field"), lambda d: crdt.grow_counter(d, "obj"), lambda d: crdt.counter(d, "obj"), lambda d: crdt.live_elements(d, "obj"), lambda d: crdt.live_pairs(d, "obj", "field")])
def test_merges_are_order_free(spark, merge):
    want = sorted(merge(ops(spark, OPS)).collect())
    draw = random.Random(1)
    for _ in range(3):
        shuffled = OPS * 2
        draw.shuffle(shuffled)
        assert sorted(merge(ops(spark, shuffled).repartition(3)).collect()) == want


def test_merge_is_associative(spark):
    whole = sorted(crdt.lww(ops(spark, OPS), "obj", "field").collect())
    half = crdt.lww(ops(spark, OPS[:4]), "obj", "field").unionByName(crdt.lww(ops(spark, OPS[4:]), "obj", "field"))
    assert sorted(crdt.lww(half, "obj", "field").collect()) == whole


def test_lww_order(spark):
    """Greatest |rev|, then value, then source."""
    one = lambda rows: crdt.lww(ops(spark, [(1, "f", *r) for r in rows]), "obj").first()
    assert one([(1, 1, 1), (2, 2, 2), (2, 1, 3)]).val == 3
    assert one([(2, 1, 5), (-3, 9, 0)]).rev == -3
    assert one([(2, 1, 5), (2, 9, 5)]).src == 9


def test_array_weave(spark):
    rows = [(1, 1, None, True), (1, 2, 1, True), (1, 3, 1, True), (1, 4, 2, False)] + [(2, i, i - 1 if i else None, True) for i in range(40)]
    out = crdt.array_order(spark.createDataFrame(rows, "obj bigint, id bigint, parent bigint, live boolean")).collect()
    order = lambda o: [r.id for r in sorted((r for r in out if r.obj == o), key=lambda r: r.path)]
    assert order(1) == [1, 3, 2, 4] and order(2) == list(range(40))


def test_vectors(spark):
    v = lambda rows: spark.createDataFrame(rows, "src bigint, seq bigint")
    a, b = v([(1, 5), (2, 0)]), v([(1, 3), (3, 1)])
    assert sorted(map(tuple, vectors.merge(a, b).collect())) == [(1, 5), (2, 0), (3, 1)]
    assert sorted(map(tuple, vectors.interest(a, b).collect())) == [(1, 3), (2, 0)]
    assert not vectors.seen(a, b).first()[0] and vectors.seen(vectors.merge(a, b), b).first()[0]
    assert vectors.seen(a, b.limit(0)).first()[0]


def test_ron64_round_trip(spark):
    numbers = [0, 9, 10, 35, 36, 37, 63, 64, 4095, 4096, (1 << 62) + 12345, (1 << 63) - 1]
    out = spark.createDataFrame([(n,) for n in numbers], "n bigint").select("n", ron64.encode(F.col("n")).alias("t")).withColumn("back", ron64.decode(F.col("t"))).collect()
    texts = {r.n: r.t for r in out}
    assert {texts[0], texts[10], texts[63], texts[64], texts[4095], texts[4096]} == {"0", "A", "~", "10", "~~", "100"}
    assert all(r.back == r.n for r in out if len(r.t) <= 10)
    bad = spark.createDataFrame([("",), ("a b",), ("é",), (None,)], "t string").select(ron64.decode(F.col("t")).alias("n")).collect()
    assert all(r.n is None for r in bad)


def test_paths_and_slices(spark):
    row = spark.createDataFrame([("/a//b/c.txt", "héllo", [1, 2, 3])], "p string, s string, a array<int>")
    p, s, a = F.col("p"), F.col("s"), F.col("a")
    got = row.select(paths.join(paths.split(p)), paths.parent(p), paths.basename(p), paths.canonical(p), F.decode(slices.byte_range(s, 0, 2), "UTF-8"), F.decode(slices.byte_range(s, -2, -1), "UTF-8"), slices.array_at(a, -1), slices.array_at(a, 5), slices.array_range(a, -2, 9), slices.without_first(a), slices.without_last(a), slices.array_range(a, 2, 0)).first()
    assert list(got) == ["a/b/c.txt", "/a//b", "c.txt", False, "hé", "lo", 3, None, [2, 3], [2, 3], [1, 2], []]
    glob = lambda t, g: spark.createDataFrame([(t,)], "t string").select(paths.glob(F.col("t"), g)).first()[0]
    assert glob("a.b", "a.?") and not glob("axb", "a.b") and glob("a/b/c", "*c") and not glob("abc", "ab") and glob("a+[b", "a+[*")


def test_ttl_and_lists(spark):
    keys = spark.sql("SELECT * FROM VALUES ('a', timestamp'2024-01-01 00:00:00', 1000L), ('b', timestamp'2024-01-01 00:00:00', NULL), ('c', timestamp'2024-01-01 00:00:00', 999999L) AS t(key, set_at, ttl_ms)")
    assert {r.key: r.ttl for r in keyspace.ttl(keys, F.lit("2024-01-01 00:00:10").cast("timestamp")).collect()} == {"a": -2, "b": -1, "c": 989999}
    commands = [("k", 1, "RPUSH", 1), ("k", 2, "LPUSH", 2), ("k", 3, "LPOP", None), ("k", 4, "RPOP", None), ("k", 5, "RPOP", None), ("k", 6, "LPUSH", 9)]
    out = keyspace.fold_list(spark.createDataFrame(commands, "key string, seq bigint, cmd string, item bigint")).first()
    assert out["items"] == [9]


def test_keep_versions(spark):
    log = spark.createDataFrame([("a", 1, 1.0, False), ("a", 2, 2.0, False), ("a", 9, 3.0, False), ("b", 1, 1.0, False), ("b", 3, 0.0, True)], "key string, offset bigint, value double, is_tombstone boolean")
    at = lambda **k: sorted((r.key, r.offset) for r in versioned.keep_versions(log, 5, **k).collect())
    assert at() == [("a", 2), ("a", 9)] and at(bottom=False) == [("a", 2), ("a", 9), ("b", 3)]
    assert [r.key for r in versioned.latest(log).collect()] == ["a"]


def test_tree_round_trip(spark):
    files = spark.createDataFrame([("a/x", "1"), ("a/y", "2"), ("b", "3")], "path string, content string")
    objects = tree.build(files, 2).cache()
    root = objects.where("path = ''").first()["hash"]
    walked = {r.path for r in tree.listing(spark, tree.entries(objects), root).collect()}
    assert walked == {"a", "a/x", "a/y", "b"}
    moved = tree.build(files.where("path <> 'b'").unionByName(spark.createDataFrame([("b", "4")], "path string, content string")), 2)
    assert {(r.path, r.status) for r in tree.diff(objects, moved).collect()} == {("", "changed"), ("b", "changed")}


def test_walk_verifies_the_copy_of_its_place(spark):
    """Of two files of equal content one is spoilt: the other is still sound."""
    files = spark.createDataFrame([("a/x", "1"), ("a/y", "1"), ("b/x", "1")], "path string, content string")
    objects = tree.build(files, 2).cache()
    held = objects.join(files.withColumn("content", F.when(F.col("path") == "a/x", "?").otherwise(F.col("content"))), "path", "left")
    wanted = spark.createDataFrame([("a/x",), ("a/y",), ("b/x",), ("b",), ("b/none",)], "path string")
    got = tree.walk(tree.entries(objects), held, wanted, objects.where("path = ''").first()["hash"], 3)
    assert {r.path: r.verified for r in got.collect()} == {"a/x": False, "a/y": True, "b/x": True, "b": True}


def test_ancestors_of_long_chains(spark):
    """A chain of any length, a branch, one start alone; a version listed twice; a cycle is an error."""
    rows = [(i, i - 1 if i else None) for i in range(150)] + [(200, 3)]
    versions = spark.createDataFrame(rows, "root bigint, parent bigint")
    got = sorted(map(tuple, tree.ancestors(spark, versions).collect()))
    assert got == sorted([(i, j, i - j) for i in range(150) for j in range(i + 1)] + [(200, 200, 0)] + [(200, j, 4 - j) for j in range(4)])
    one = tree.ancestors(spark, versions, spark.createDataFrame([(200,)], "root bigint"))
    assert sorted(map(tuple, one.collect())) == [(200, 0, 4), (200, 1, 3), (200, 2, 2), (200, 3, 1), (200, 200, 0)]
    twice = spark.createDataFrame([(1, None), (1, None), (2, 1), (2, 1)], "root bigint, parent bigint")
    assert sorted(map(tuple, tree.ancestors(spark, twice).collect())) == [(1, 1, 0)] * 2 + [(2, 1, 1)] * 4 + [(2, 2, 0)] * 2
    with pytest.raises(RuntimeError):
        tree.ancestors(spark, spark.createDataFrame([(1, 2), (2, 1)], "root bigint, parent bigint"))


def test_merkle(spark):
    import hashlib

    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    leaves = [sha(str(i)) for i in range(5)]
    df = spark.createDataFrame(list(enumerate(leaves)), "idx bigint, hash string")
    nodes = merkle.build(df, 5)
    two = lambda a, b: sha(a + "\n" + b + "\n")
    top = two(two(leaves[0], leaves[1]), two(leaves[2], leaves[3]))
    assert {(r.level, r.offset, r.hash) for r in merkle.peaks(nodes, 5).collect()} == {(2, 0, top), (0, 4, leaves[4])}
    cells = [leaves[4], merkle.ZERO, top] + [merkle.ZERO] * 29
    assert merkle.root(merkle.peaks(nodes, 5)).first()[0] == sha("".join(c + "\n" for c in cells))
    assert all(r.peak == (top if r.idx < 4 else leaves[4]) for r in merkle.folded(merkle.proofs(nodes, df, 5), df).collect())


def test_document_round_trip(spark):
    texts = ['{"a":1,"b":{"c":"x\\"y","d":["p","q"]},"e":true,"f":null}', '{"k":[[1,2],[3]]}', "not json"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id bigint, doc string")
    leaves = documents.flatten_json(docs, "id", "doc")
    back = {r.id: r.json for r in documents.unflatten(leaves, "id").collect()}
    assert back == {0: texts[0], 1: texts[1]}


def test_locate_prefers_narrow_ranges(spark):
    peers = spark.createDataFrame([(5,), (70000,), (10**9,)], "ip bigint")
    ranges = spark.createDataFrame([(0, 100000, "wide"), (4, 6, "narrow")], "first bigint, last bigint, name string")
    assert {r.ip: r.name for r in swarm.locate(peers, ranges).collect()} == {5: "narrow", 70000: "wide"}


RECORDS = [("First row", "one", "g1", [1, 0, 1, 1, 0, 0, 0, 1], ("https://x.example/r", 7), 8.5), ("Ünï", "u", "", [0] * 8, ("", 0), 0.0), ("B", "b", "g2", [1] * 8, ("r", 10), 0.1)]


def test_record_formats(spark, tmp_path):
    rows = spark.createDataFrame(RECORDS, formats.ROW)
    want = sorted(map(str, rows.collect()))
    raw = [r.raw for r in formats.write_records(rows).collect()]
    expected = [struct.pack("<32s16s8s8B59sBf", n.encode(), lg.encode(), g.encode(), *p, pr[0].encode(), pr[1], m) for n, lg, g, p, pr, m in RECORDS]
    assert sorted(raw) == sorted(bytearray(e) for e in expected)
    (tmp_path / "a.bin").write_bytes(b"".join(expected))
    (tmp_path / "b.bin").write_bytes(b"".join(expected)[:-5])
    parsed, rejects = formats.read_records(spark, str(tmp_path / "*.bin"))
    names = ["name", "login", "grp", "practice", "project", "mark"]
    assert sorted(map(str, parsed.select(names).collect())) == want and rejects.count() == 1
    assert parsed.where(formats.valid()).count() == 3
    numbered = rows.withColumn("place", F.monotonically_increasing_id())
    assert sorted(map(str, formats.from_lines(formats.to_lines(numbered, "place")).select(names).collect())) == want
    assert sorted(map(str, formats.from_json(formats.to_json(rows)).collect())) == want


def test_lines_are_dealt_by_their_number(spark, monkeypatch):
    """Lines go to parts of bounded size before they are grouped; lines out of form, and fields that are absent, stay out."""
    monkeypatch.setattr(formats, "PART_LINES", 100, raising=False)
    lines = spark.range(500).select(F.explode(F.array(F.format_string("[%d].name: n%d", "id", "id"), F.format_string("[%d].practice[1]: 1", "id"), F.lit("noise"))).alias("line"))
    back = formats.from_lines(lines)
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "hashpartitioning(place" in plan and ", 16)" in plan
    assert {tuple(r) for r in back.select("place", "name", F.col("practice")[1], "login").collect()} == {(i, f"n{i}", 1, None) for i in range(500)}


def test_invalid_records(spark):
    bad = [("A\x00B", "a", "g", [0] * 8, ("r", 1), 1.0), ("A", "a", "g", [2] + [0] * 7, ("r", 1), 1.0), ("A", "a", "g", [0] * 8, ("r", 11), 1.0), ("A", "a", "g", [0] * 8, ("r", 1), float("nan")), ("A", "a", "g", [0] * 8, ("r", 1), 10.5)]
    assert spark.createDataFrame(bad, formats.ROW).where(formats.valid()).count() == 0


def test_addresses_and_numstat(spark, tmp_path):
    (tmp_path / "ips").write_bytes(struct.pack("<3I", 1, 4294967295, 167772161))
    assert sorted(r.ip for r in formats.read_addresses(spark, str(tmp_path / "ips"))[0].collect()) == [1, 167772161, 4294967295]
    (tmp_path / "n.txt").write_text("3\t4\ta/b\n-\t-\tbin\nnoise\n")
    assert sorted(map(str, formats.read_numstat(spark, str(tmp_path / "n.txt")).collect())) == sorted(["Row(added=3, deleted=4, path='a/b')", "Row(added=None, deleted=None, path='bin')"])


def test_xml_and_json_round_trips(spark):
    rows = spark.createDataFrame(RECORDS, formats.ROW)
    for there, back in ((formats.to_xml, formats.from_xml), (formats.to_json, formats.from_json)):
        got = back(there(rows))
        assert got.columns == rows.columns
        assert sorted((r.login, r["name"], [*r.practice], r.project.mark, r.mark) for r in got.collect()) == sorted((r.login, r["name"], [*r.practice], r.project.mark, r.mark) for r in rows.collect())


def test_files(spark, tmp_path):
    """CSV with numbers that do not parse; addresses and files of another size."""
    (tmp_path / "t.csv").write_text("a,b,c\nx,1,2.5\ny,?,\n")
    got = formats.read_csv(spark, str(tmp_path / "t.csv"), "a string, b int, c double", ["b", "c"]).collect()
    assert sorted(map(tuple, got)) == [("x", 1, 2.5), ("y", 0, 0.0)]
    folder = tmp_path / "ips"
    folder.mkdir()
    (folder / "good").write_bytes(struct.pack("<3I", 1, 0x7F000001, 0xFFFFFFFF))
    (folder / "odd").write_bytes(b"12345")
    ips, rejects = formats.read_addresses(spark, str(folder))
    assert sorted(r.ip for r in ips.collect()) == [1, 0x7F000001, 0xFFFFFFFF]
    assert [(r.file.rpartition("/")[2], r.length) for r in rejects.collect()] == [("odd", 5)]


def test_bencode():
    from siltmark.functions import bencode

    assert bencode._parse(b"d1:al1:b0:i-7ee1:cdee") == {"a": ["b", "", -7], "c": {}}
    assert bencode._parse(b"l" * 5000 + b"e" * 5000)
    for bad in (b"", b"i1", b"5:abc", b"l", b"e", b"di1e1:ae", b"i1ei2e", b"d1:ae", b"-1:a"):
        with pytest.raises(ValueError):
            bencode._parse(bad)


def test_records_cut_short(spark):
    """Records that are cut short, or of no known tag, decode to nothing."""
    one = spark.range(1).select(documents.encode_leaf(F.lit("s"), F.lit("k"), F.lit("v" * 300)).alias("r")).first().r
    two = spark.range(1).select(documents.encode_leaf(F.lit("n"), F.lit("key"), F.lit("12")).alias("r")).first().r
    assert bytes(one[:6]) == b"S" + struct.pack("<IB", 300, 1) and bytes(two) == b"n\x32key12"
    data = [bytes(one + two), bytes(one + two)[:-1], bytes(one)[:5], b"x\x11ab", b"", bytes(two) * 3]
    got = [r.out for r in spark.createDataFrame([(i, x) for i, x in enumerate(data)], "i int, x binary").select("i", documents.decode_records(F.col("x")).alias("out")).orderBy("i").collect()]
    assert [None if x is None else [(r.tag, r.key, r.value[:5]) for r in x] for x in got] == [[("S", "k", "vvvvv"), ("n", "key", "12")], None, None, None, [], [("n", "key", "12")] * 3]


def test_long_streams_take_linear_time(spark):
    """Two hundred thousand records in one stream; a cut end gives none."""
    import time

    began = time.perf_counter()
    stream = spark.range(1).select(F.expr("unhex(repeat('6e116b31', 200000))").alias("s"))
    got = stream.select(F.posexplode(documents.decode_records(F.col("s"))).alias("place", "x")).agg(F.count("*").alias("n"), F.max("place").alias("last"), F.count_if(F.expr("x.tag = 'n' and x.key = 'k' and x.value = '1'")).alias("right")).first()
    assert tuple(got) == (200_000, 199_999, 200_000) and time.perf_counter() - began < 30
    odd = [None, bytes(b"\xffab"), bytes(b"S\x01\x00"), bytes(b"s\x00" * 3), bytes(b"s\x00s")]
    out = spark.createDataFrame([(i, x) for i, x in enumerate(odd)], "i int, x binary").select("i", documents.decode_records(F.col("x")).alias("out")).orderBy("i").collect()
    assert [None if r.out is None else [tuple(x) for x in r.out] for r in out] == [None, None, None, [("s", "", "")] * 3, None]


def test_ron64_of_eleven_digits(spark):
    numbers = [0, 63, 64, (1 << 60) - 1, 1 << 60, (1 << 63) - 1]
    rows = spark.createDataFrame([(n,) for n in numbers], "n bigint").select("n", ron64.encode(F.col("n")).alias("s"))
    assert sorted((r.n, r.back) for r in rows.withColumn("back", ron64.decode(F.col("s"))).collect()) == [(n, n) for n in numbers]
    odd = spark.createDataFrame([("8" + "0" * 10,), ("0" * 12,), ("",), ("a-b",)], "s string")
    assert all(r.n is None for r in odd.select(ron64.decode(F.col("s")).alias("n")).collect())


def test_json_strings_keep_their_characters(spark):
    """Control characters, quotes and backslashes survive, at any depth."""
    import json

    docs = [{"a": "tab\t nul\u0001 quote\" back\\ line\n", "b": [{"c": [[["deep"]]]}, None, True, 1.5]}, {"x": {"y": {"z": {"w": {"v": {"u": {"t": {"s": {"r": {"q": "ten"}}}}}}}}}}]
    rows = spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(docs)], "k int, doc string")
    got = documents.unflatten(documents.flatten_json(rows, "k", "doc"), "k")
    assert {r.k: json.loads(r.json) for r in got.collect()} == dict(enumerate(docs))
