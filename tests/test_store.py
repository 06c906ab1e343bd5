import io

import numpy as np
import pytest

from tesseral import Enum, Filters, Table, cli, open_store, types
from tesseral.sources.catalog import ClosedStoreError, NodeError, NoSuchNodeError, StoreModeError, UndoRedoError, is_store
from tesseral.sources.filenode import new_node, open_node, read_from_filenode, save_to_filenode


@pytest.fixture
def s(spark, tmp_path):
    s = open_store(spark, str(tmp_path / "s"), "w")
    s.create_group("/", "g", "a group")
    s.create_table("/g", "t", {"k": types.Int32Col(), "n": types.StringCol(3)}, "rows", [(k, b"x") for k in range(6)])
    s.create_array("/", "a", np.arange(6.0).reshape(2, 3))
    return s


def paths(s):
    return [n.path for n in s.walk_nodes("/")]


def test_tree(s, spark):
    assert paths(s) == ["/", "/a", "/g", "/g/t"] or paths(s) == ["/", "/g", "/a", "/g/t"] or set(paths(s)) == {"/", "/a", "/g", "/g/t"}
    assert s.root_group.g.t.title == "rows" and "t" in s.root_group.g and len(s.root_group) == 2
    assert [n.path for n in s.list_nodes("/", "group")] == ["/g"] and s.get_node("/g", "t", "Leaf").depth == 2
    with pytest.raises(NoSuchNodeError):
        s.get_node("/nowhere")
    with pytest.raises(NodeError):
        s.create_group("/", "g")
    s.create_group("/deep/er", "est", createparents=True)
    s.move_node("/g", "/deep")
    assert "/deep/g/t" in s and "/g" not in s
    s.copy_node("/deep/g", "/", "h", recursive=True)
    s.rename_node("/h/t", "u")
    with pytest.raises(NodeError):
        s.remove_node("/h")
    with pytest.raises(NodeError):
        s.move_node("/deep", "/deep/er")
    s.remove_node("/h", recursive=True)
    assert "/h/u" not in s
    with pytest.warns(UserWarning):
        s.create_group("/", "not natural")
    s.create_group("/", "_i_hidden")
    assert not s.is_visible_node("/_i_hidden")


def test_data_come_back(s, spark):
    again = open_store(spark, s.root)
    t = again.open_data("/g/t")
    assert isinstance(t, Table) and t.nrows == 6 and bytes(t[0]["n"]) == b"x" and dict(t.description.paths())["n"].itemsize == 3
    np.testing.assert_array_equal(again.open_data("/a").to_numpy(), np.arange(6.0).reshape(2, 3))
    with pytest.raises(StoreModeError):
        again.create_group("/", "no")
    again.close()
    with pytest.raises(ClosedStoreError):
        again.get_node("/")
    sub = open_store(spark, s.root, "r", "/g")
    assert sub.open_data("/t").nrows == 6
    with pytest.raises(OSError):
        open_store(spark, s.root + "-none")


def test_edits_are_written(s, spark):
    t = s.open_data("/g/t")
    t.remove_rows(0, 2)
    t.append([(9, b"y")])
    t.cols.k.create_csindex()
    t.cols.k.attrs["unit"] = "m"
    t.flush()
    u = open_store(spark, s.root).open_data("/g/t")
    assert [r["k"] for r in u.iterrows()] == [2, 3, 4, 5, 9] and u.cols.k.index.is_csi and u.cols.k.attrs["unit"] == "m"
    assert s.vacuum() == 1


def test_attributes(s):
    a = s.get_node("/g").attrs
    a.colour, a["size"], a.grid = "red", np.int16(4), [1, 2]
    assert a.colour == "red" and a.size == 4 and isinstance(a.size, np.int16) and a.grid == [1, 2]
    assert a.names() == ["colour", "grid", "size"] and a.names("sys") == ["CLASS", "TITLE", "VERSION"]
    a.rename("colour", "hue")
    a.copy("/a")
    del a.hue
    assert "hue" not in a and s.get_node("/a").attrs.hue == "red"
    with pytest.raises(AttributeError):
        a.hue


def test_links(s, spark, tmp_path):
    soft = s.create_soft_link("/", "l", "/g/t")
    assert soft().path == "/g/t" and s.open_data("/l").nrows == 6
    assert s.create_soft_link("/", "bad", "/none").is_dangling()
    s.create_hard_link("/", "h", "/g/t")
    s.remove_node("/g/t")
    assert soft.is_dangling() and s.open_data("/h").nrows == 6
    other = open_store(spark, str(tmp_path / "o"), "w")
    ext = other.create_external_link("/", "e", "s:/h")
    assert ext().data().nrows == 6


def test_undo(s):
    with pytest.raises(UndoRedoError):
        s.undo()
    s.enable_undo()
    s.create_group("/", "one")
    s.mark("m")
    s.create_group("/", "two")
    s.get_node("/two").attrs.x = 1
    s.undo()
    assert "/two" not in s and "/one" in s
    s.undo()
    assert "/one" not in s
    s.redo("m")
    assert "/one" in s and "/two" not in s
    s.goto(-1)
    assert s.get_node("/two").attrs.x == 1
    s.undo("m")
    s.create_group("/", "three")
    with pytest.raises(UndoRedoError):
        s.redo()
    with pytest.raises(UndoRedoError):
        s.mark("m")
    s.disable_undo()
    assert not s.is_undo_enabled() and "/three" in s


def test_streams(s, tmp_path):
    with new_node(s, "/", "f") as f:
        f.write(b"first line\nsecond\n" + bytes(3_000_000))
    with open_node(s, "/f") as f:
        assert f.readline() == b"first line\n" and f.seek(-2, 2) == 3_000_016 and f.read() == b"\0\0"
        f.seek(2_097_150)
        assert f.read(4) == bytes(4)
        with pytest.raises(OSError):
            f.write(b"x")
    with open_node(s, "/f", "a") as f:
        f.truncate(5)
        f.write(b"!")
    (tmp_path / "in").write_bytes(b"abc")
    save_to_filenode(s, str(tmp_path / "in"), "/g", "copy")
    read_from_filenode(s, "/g/copy", str(tmp_path / "out"))
    assert (tmp_path / "out").read_bytes() == b"abc"
    with open_node(s, "/f") as f:
        assert f.read() == b"first!"


def test_commands(s, spark, tmp_path):
    out = io.StringIO()
    t = s.open_data("/g/t")
    t.cols.k.create_csindex()
    t.flush()
    cli.dump(s, out=out, data=True, attrs=True, colinfo=True, idxinfo=True, stop=2)
    assert "k: int32" in out.getvalue() and "[1]" in out.getvalue() and "[2]" not in out.getvalue().split("/g/t")[1]
    rows = cli.tree(s, "/", io.StringIO())
    assert rows[0][0] == "/" and rows[0][3] == 100
    to = open_store(spark, str(tmp_path / "p"), "w")
    cli.repack(s, to, start=1, filters=Filters(5, "blosc:zstd"), sortby="k", propindexes=True)
    assert to.open_data("/g/t").nrows == 5 and to.get_node("/g/t").filters().codec == "zstd"
    s.copy_to(str(tmp_path / "c"))
    assert is_store(str(tmp_path / "c")) and not is_store(str(tmp_path))


def test_filters(spark):
    df = Filters(1, "zlib", least_significant_digit=1).apply(spark.createDataFrame([(1.26, 3)], "x double, k int"))
    assert df.first()["x"] == 1.25
    for bad in (dict(complevel=10), dict(complib="none")):
        with pytest.raises(ValueError):
            Filters(**bad)


def test_enums(spark):
    e = Enum({"r": 4, "g": 2})
    assert e["r"] == e.r == 4 and e(2) == "g" and e(9, None) is None and "b" not in e and len(e) == 2 and e == Enum([("r", 4), ("g", 2)] and {"g": 2, "r": 4})
    for bad in ({"a": 1, "b": 1}, [], ["_x"], ["a", "a"]):
        with pytest.raises(ValueError):
            Enum(bad)
    with pytest.raises(TypeError):
        Enum("abc")
    with pytest.raises(KeyError):
        e["b"]
    t = Table.from_rows(spark, {"c": types.EnumCol(e, "g")}, [{"c": "r"}, {}])
    assert [r["c"] for r in t.iterrows()] == [4, 2] and t.get_enum("c") == e


def test_stream_tail(spark, tmp_path):
    from tesseral.streaming import append_stream, tail

    src, dst = str(tmp_path / "src"), str(tmp_path / "dst")
    spark.range(10).write.parquet(src)
    schema = spark.read.parquet(src).schema
    for want in (3, 5):
        q = append_stream(tail(spark, src, schema, "id > 6", {}), dst, str(tmp_path / "ck"))
        q.awaitTermination(60)
        assert spark.read.parquet(dst).count() == want
        spark.range(5, 9).write.mode("append").parquet(src)


def test_numpy_records(s):
    kind = np.dtype([("name", "S3"), ("k", "i4"), ("v", "f8", (2,)), ("in", [("flag", "?")])])
    leaf = s.create_table("/", "records", obj=np.array([(b"abc", 1, [1.0, 2.0], (True,)), (b"d", 2, [3.0, 4.0], (False,))], kind))
    t = leaf.data()
    assert t.colnames == ["name", "k", "v", "in"] and t[1]["v"] == [3.0, 4.0] and t[0]["in"]["flag"] is True
    assert sum(c[2] for c in leaf.chunk_info()) == 2 and t.to_numpy(1)["k"].tolist() == [2]
    r = t[0]
    assert r["k"] == r[1] == 1 and tuple(r[1:2]) == (1,)
