"""Objects by key: listing in tasks, reads by key, write-once stores."""

import pytest

from covenant.sources import objects as OB

SCHEMA = "document_id long, version int, name string, content binary"


@pytest.fixture(scope="module")
def base(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("objects")
    rows = [(i, 1, f"a b{i}.txt", bytes([i % 256]) * i) for i in range(40)]
    rows += [(7, v, "x.bin", b"" if v % 2 else b"\x00\xff" * v) for v in range(2, 30)]      # one document with most versions
    rows += [(8, 2, "..", b"up"), (9, 2, None, b"nameless"), (10, 2, "no.txt", None)]
    made = OB.store_objects(spark.createDataFrame(rows, SCHEMA), str(base)).collect()
    assert [r.key for r in made if r.outcome == "no content"] == ["doc-10/v2/no.txt"]
    assert [r.key for r in made if r.outcome == "bad key"] == ["doc-8/v2/.."]
    (base / "doc-x").mkdir()
    (base / "doc-3" / "latest").mkdir()
    (base / "doc-3" / "v1" / "~half").write_bytes(b"half")
    (base / "note.txt").write_bytes(b"note")
    (base.parent / "secret").write_bytes(b"outside")
    kept = {f"doc-{i}/v{v}/{(n or 'document').replace(' ', '_')}": c for i, v, n, c in rows if c is not None and n != ".."}
    return str(base), kept


def test_every_object_comes_back_byte_for_byte(spark, base):
    path, kept = base
    for at, parts in ((path, 1), (path, 5), ("file://" + path, 16)):
        got = OB.read_tree(OB.list_objects(spark, at, parts), at).collect()
        assert len(got) == len(kept) and {r.key: bytes(r.content) for r in got} == kept
        assert all(r.length == len(r.content) and r.key == f"doc-{r.document_id}/v{r.version}/{r.name}" for r in got)


def test_bounds_on_documents_reach_the_source(spark, base):
    path, kept = base
    listed = OB.list_objects(spark, path)
    for where, want in (("document_id >= 5 and document_id < 8", {5, 6, 7}), ("document_id = 7", {7}), ("document_id in (7, 39, 4000)", {7, 39}),
                        ("document_id > 37 and document_id <= 39 and version = 1", {38, 39}), ("document_id = 7 and document_id > 7", set())):
        rows = listed.where(where).collect()
        assert {r.document_id for r in rows} == want
    assert listed.where("document_id = 7").count() == sum(k.startswith("doc-7/") for k in kept)


def test_named_documents_need_no_listing():
    reader = OB.ObjectReader({"path": "/nowhere", "parts": "4"})
    left = list(reader.pushFilters([OB.In(("document_id",), (9, 2, None, 5)), OB.GreaterThan(("document_id",), 2), OB.EqualTo(("version",), 1)]))
    assert left == [OB.EqualTo(("version",), 1)] and sorted(i for p in reader.partitions() for i in p.ids) == [5, 9]


def test_keys_without_an_object(spark, base):
    path, _ = base
    keys = [(1, "doc-1/v1/a_b1.txt"), (2, "doc-1/v9/a_b1.txt"), (3, None), (4, "../secret"), (5, "doc-1/v1/.."), (6, "doc-0/v1/a_b0.txt"), (7, "doc-7/v2")]
    df = spark.createDataFrame([(n, k, "own") for n, k in keys], "n int, key string, length string")
    got = {r.n: (r.length, r.content) for r in OB.read_keys(df, path).collect()}
    assert got == {1: (1, bytearray(b"\x01")), 6: (0, bytearray()), **{n: (None, None) for n in (2, 3, 4, 5, 7)}}


def test_stores_are_write_once(spark, tmp_path):
    one = spark.createDataFrame([(1, 1, "a", b"x"), (1, 1, "a", b"x"), (2, 1, "b", b"")], SCHEMA)
    for _ in range(2):      # tried again: the same outcome
        assert {(r.key, r.outcome) for r in OB.store_objects(one, str(tmp_path)).collect()} == {("doc-1/v1/a", "stored"), ("doc-2/v1/b", "stored")}
    other = spark.createDataFrame([(1, 1, "a", b"y"), (3, 1, "c", b"1"), (3, 1, "c", b"2")], SCHEMA)
    assert sorted((r.key, r.outcome) for r in OB.store_objects(other, str(tmp_path)).collect()) \
        == [("doc-1/v1/a", "conflict"), ("doc-3/v1/c", "conflict"), ("doc-3/v1/c", "stored")]
    assert (tmp_path / "doc-1/v1/a").read_bytes() == b"x" and not list(tmp_path.rglob("~*"))


def test_no_base(spark, tmp_path):
    assert OB.list_objects(spark, str(tmp_path / "none")).collect() == []
    assert OB.read_keys(spark.createDataFrame([], "key string"), str(tmp_path)).collect() == []


def test_large_objects_in_several_batches(spark, tmp_path):
    rows = [(i, 1, "a", bytes(1 << 20)) for i in range(40)]
    OB.store_objects(spark.createDataFrame(rows, SCHEMA).repartition(4), str(tmp_path)).count()
    got = OB.read_tree(OB.list_objects(spark, str(tmp_path)), str(tmp_path)).selectExpr("document_id", "length", "octet_length(content) AS n").collect()
    assert len(got) == 40 and all(r.length == r.n == 1 << 20 for r in got)
