"""Whole merges of files, scans, sinks, encodings, streams and the command line."""

import hashlib
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from sluice import cli
from sluice.functions import encodings, sniff, sniff_columns, text, timestamps
from sluice.operators import dedup, join, merge, profile
from sluice.plans import files as plans
from sluice.sources import files, lines, sinks
from sluice.spec import DedupSpec, FilterSpec, MergeSpec, TimestampSpec
from sluice.streaming.lines import cleaned, stream_lines

A = "name,age,city\nAlice,25,Beijing\nBob,30,Shanghai\nCharlie,35,Guangzhou\n"
B = "name,age,city\nDavid,28,Shenzhen\nEve,32,Hangzhou\nFrank,40,Chengdu\n"


@pytest.fixture
def folder(tmp_path):
    def write(**contents):
        out = []
        for name, data in contents.items():
            path = tmp_path / name.replace("__", ".")
            path.write_bytes(data if isinstance(data, bytes) else data.encode())
            out.append(str(path))
        return out

    write.path = tmp_path
    return write


def merged(spark, inputs, out, **options):
    said = []
    plans.merge_to_file(spark, inputs, MergeSpec.from_options(options), str(out), said.append)
    assert said == ["planned", "written"]
    return out.read_bytes().decode()


def test_sequential_and_interleaved(spark, folder):
    inputs = folder(b__csv=B, a__csv=A)
    head, *a = A.split("\n")[:-1]
    b = B.split("\n")[1:-1]
    assert merged(spark, inputs, folder.path / "o1.txt", mode="seq") == "\n".join([head, *a, *b]) + "\n"
    zipped = [x for pair in zip(a, b) for x in pair]
    assert merged(spark, inputs, folder.path / "o2.txt", mode="i") == "\n".join([head, *zipped]) + "\n"
    assert merged(spark, inputs, folder.path / "o3.txt", mode="s", header=False) == "\n".join([*a, *b]) + "\n"


def test_interleaved_short_file_and_dedup(spark, folder):
    inputs = folder(a__csv="h,x\na,1\nb,1\nc,1\n", b__csv="h,x\nd,1\n")
    assert merged(spark, inputs, folder.path / "o.txt", mode="interleave") == "h,x\na,1\nd,1\nb,1\nc,1\n"
    assert merged(spark, inputs, folder.path / "p.txt", mode="seq", dedup="columns", dedup_first=1, dedup_last=1) == "h,x\na,1\n"
    assert merged(spark, inputs, folder.path / "q.txt", mode="seq", dedup="columns", dedup_first=1, dedup_last=1, dedup_keep="last") == "h,x\nd,1\n"
    assert merged(spark, inputs, folder.path / "r.txt", mode="seq", dedup="columns", dedup_first=1, dedup_keep="last", compat="observed") == "h,x\na,1\n"


@pytest.mark.parametrize("how, want", [("inner", ["1,a,1,x", "1,a,1,y"]), ("left", ["1,a,1,x", "1,a,1,y", "2,b,,"]), ("right", ["1,a,1,x", "1,a,1,y", ",,3,z"]), ("full", ["1,a,1,x", "1,a,1,y", "2,b,,", ",,3,z"]), ("right_anti", [",,3,z"])])
def test_joins(spark, folder, how, want):
    inputs = folder(l__csv="1,a\n2,b\n", r__csv="1,x\n1,y\n3,z\n")
    assert merged(spark, inputs, folder.path / "o.txt", mode="join", join_type=how).split("\n")[:-1] == want


def test_join_by_name_with_header_and_filter(spark, folder):
    inputs = folder(a__csv="id,v\r\nk,a\r\nm,b\r\n", b__csv="w,id\nx,k\ny,m\nz,m\n")
    out = merged(spark, inputs, folder.path / "o.txt", mode="join", key="id", delimiter=";", exclude=("y",))
    assert out == "id;v;w;id\nk;a;x;k\nm;b;z;m\n"  # the name is found in each file's own header
    rows = join.rows_of(spark.createDataFrame([(1, "a"), (2, ""), (3, "b,c")], "line_no long, content string"))
    assert join.joined(rows, rows, 1, 1).count() == 1  # rows without a key match nothing


def test_timestamps_carry_forward(spark, folder, monkeypatch):
    monkeypatch.setattr(merge, "BLOCK", 2)
    inputs = folder(a__log="start\n2024-01-02 00:00:00 a\n  trace 1\n  trace 2\n  trace 3\n2024-01-01 00:00:00 z\n", b__log="2024-01-01 12:00:00 b\n")
    assert merged(spark, inputs, folder.path / "o.txt", mode="ts") == "start\n2024-01-01 00:00:00 z\n2024-01-01 12:00:00 b\n2024-01-02 00:00:00 a\n  trace 1\n  trace 2\n  trace 3\n"


def test_scan(spark, folder):
    (path,) = folder(x__txt=b"\xef\xbb\xbfa\rb\r\n\nlast")
    assert [tuple(r) for r in lines.scan_lines(spark, [path]).orderBy("line_no").collect()] == [(0, path, 1, "a\rb"), (0, path, 2, ""), (0, path, 3, "last")]
    big = "".join(f"line {k}\n" for k in range(20000))
    paths = folder(big__txt=big, _hidden__txt="h1\nh2\n", empty__txt="", **{"sp ace+%__txt": "s\n"})
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
    try:
        got = lines.scan_lines(spark, [paths[0]])
        assert got.rdd.getNumPartitions() > 3 and got.where("content <> concat('line ', line_no - 1)").count() == 0 and got.count() == 20000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    some = lines.scan_lines(spark, paths[1:]).orderBy("file_idx", "line_no").collect()
    assert [(r.file_idx, r.path, r.line_no, r.content) for r in some] == [(0, paths[1], 1, "h1"), (0, paths[1], 2, "h2"), (2, paths[3], 1, "s")]


@pytest.mark.parametrize("encoding", ["utf-16-le", "utf-16-be", "gbk", "big5", "utf-32-le", "latin-1"])
def test_encodings(spark, folder, encoding):
    word = "café" if encoding == "latin-1" else "名字"
    (path,) = folder(x__txt=encodings.with_mark(f"{word},1\r\n{word},2\n".encode(encoding), encoding))
    assert merged(spark, [path], folder.path / "o.txt", mode="seq", source_encoding=encoding) == f"{word},1\n{word},2\n"
    spec = MergeSpec.from_options({"mode": "seq", "source_encoding": encoding, "target_encoding": encoding})
    plans.merge_to_file(spark, [path], spec, str(folder.path / "p.txt"))
    assert encodings.without_mark((folder.path / "p.txt").read_bytes()).decode(encoding) == f"{word},1\n{word},2\n"
    df = spark.createDataFrame([(word + "x",)], "s string")
    assert df.select(encodings.decoded(encodings.encoded(F.col("s"), encoding), encoding)).first()[0] == word + "x"


def test_detection():
    assert encodings.detect("姓名,年龄".encode())[0] == "utf-8" and encodings.detect("Ça va, café".encode())[0] == "utf-8"
    assert encodings.detect("姓名年龄".encode("gbk"))[0] == "gbk" and encodings.detect(b"plain")[0] == "ascii" and encodings.detect("ab".encode("utf-16-le"))[0] == "utf-16-le"
    assert encodings.detect(b"\xff\xfea\0")[0] == "utf-16-le" and encodings.detect(b"caf\xe9 ")[0] == "latin-1" and encodings.detect(b"\xc3\xfb")[0] == "gbk"
    assert encodings.named("GB2312") == "gbk" and encodings.named("none") is None


@pytest.mark.parametrize("name", ["x__txt", "_x__txt"])
@pytest.mark.parametrize("encoding, word", [("gbk", "名字"), ("latin-1", "café "), ("utf-8", "naïve")])
def test_encoding_is_of_all_bytes(spark, folder, encoding, word, name):
    lines_ = ["plain ascii"] * 9000 + [f"{word},{k}" for k in range(9)]
    data = "".join(f"{x}\n" for x in lines_).encode(encoding)
    assert b"\n".join(data[: plans.HEAD].split(b"\n")).isascii()
    (path,) = folder(**{name: data})
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40001")
    try:
        assert plans.profile(spark, path).encoding == encoding == plans.profiles_table(spark, [path]).first().encoding
        assert merged(spark, [path], folder.path / "o.txt", mode="seq") == "".join(f"{x}\n" for x in lines_)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_counts_of_splits_are_those_of_the_file(spark, folder):
    rnd = random.Random(6)
    contents = {f"f{k}__bin": bytes(rnd.choices(range(256), [20, *[1] * 9, 20, *[1] * 245], k=100_001 + k)) for k in range(4)}
    contents["u__txt"] = "名a\n".encode("utf-16-le") * 30_001
    paths = folder(**contents)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9001")
    try:
        got = lines.byte_counts(spark, paths)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    for path, data in zip(paths, contents.values()):
        assert got[path] == encodings.counts_of(data)
        assert got[path].high == sum(b >= 0x80 for b in data) + sum(m[0][1] < 0x80 for m in re.finditer(rb"[\x81-\xfe][\x40-\x7e\x80-\xfe]", data))
        assert got[path].good / max(1, got[path].high) == encodings.gbk_share(data)


def test_listing_and_binary(spark, folder):
    inputs = folder(b__bin=b"\x00\x01", a__bin=b"", c__bin=b"\xff\n")
    assert files.expand_inputs([str(folder.path)]) == sorted(inputs) == files.expand_inputs([f"{folder.path}/*.bin", inputs[0]])
    assert files.expand_inputs([str(folder.path)], output=inputs[0]) == sorted(inputs[1:]) and files.expand_inputs([f"{folder.path}/[ab].bin"]) == sorted(inputs[:2])
    os.mkdir(folder.path / "sub")
    (folder.path / "sub" / ".x").write_text("y")
    assert files.list_files(str(folder.path), recursive=True)[-1].endswith("sub/.x") and files.list_directories(str(folder.path)) == [str(folder.path / "sub")]
    assert plans.merge_to_file(spark, inputs, MergeSpec(mode="binary"), str(folder.path / "out")) == {"n_bytes": 4}
    assert (folder.path / "out").read_bytes() == b"\x00\x01\xff\n"
    assert spark.createDataFrame([(bytearray(b"123456789"),)], "content binary").select(F.hex(F.crc32("content"))).first()[0] == "CBF43926"
    scanned = lines.scan_bytes(spark, [*inputs, *folder(d__bin=b"\x00\x01")])
    assert tuple(merge.same_content(scanned, inputs[0], str(folder.path / "d.bin")).first()) == (True, True)
    assert tuple(merge.same_content(scanned, inputs[0], inputs[2]).first()) == (True, False) and not merge.same_content(scanned, inputs[0], "none").first()[0]
    with pytest.raises(plans.MergeError):
        plans.merge_files(spark, [str(folder.path / "no")], MergeSpec())


def test_binary_merge_holds_no_file(spark, folder, monkeypatch):
    """Files are copied, not read as rows: hidden ones, and one beyond what a row may hold."""
    inputs = folder(a__bin=b"\x00\n\xff", _b__bin=b"", c__bin=b"x" * 300_001)
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup()
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "1000")
    try:
        assert plans.merge_to_file(spark, [inputs[2], f"file://{inputs[0]}", inputs[1]], MergeSpec(mode="binary"), str(folder.path / "out")) == {"n_bytes": 300_004}
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    assert (folder.path / "out").read_bytes() == b"\x00\n\xff" + b"x" * 300_001
    assert spark.sparkContext.statusTracker().getJobIdsForGroup() == jobs
    assert files.digest(str(folder.path / "out")) == hashlib.md5(b"\x00\n\xff" + b"x" * 300_001).hexdigest()


def test_sink_appends_and_marks_once(spark, folder):
    df = spark.createDataFrame([(2, "b"), (1, "a"), (3, ""), (4, "d")], "o long, content string")
    out = folder.path / "new" / "o.txt"
    assert sinks.write_file(df, ["o"], str(out), "utf8-bom")["n_lines"] == 3
    sinks.write_file(df, ["o"], str(out), "utf8-bom", append=True)
    assert out.read_bytes() == b"\xef\xbb\xbfa\nb\nd\na\nb\nd\n"
    assert os.listdir(out.parent) == ["o.txt"]


def test_dedup_keeps(spark):
    df = spark.createDataFrame([(1, "A,k"), (2, "B,m"), (3, "C,k")], "o long, content string")
    run = lambda keep, compat="documented": [r[0] for r in dedup.deduplicated(df, DedupSpec("columns", keep, first=1), ["o"], compat=compat).orderBy("o").select("content").collect()]
    assert run("first") == ["A,k", "B,m"] and run("last") == ["B,m", "C,k"] and run("last_in_place") == ["C,k", "B,m"] and run("all") == ["A,k", "B,m", "C,k"] and run("all", "observed") == ["A,k", "B,m"]
    assert tuple(dedup.duplicate_counts(df, DedupSpec("columns", first=1)).first()) == (3, 2, 1)


def test_profile(spark):
    rows = spark.createDataFrame([(["1", "x", "", "n/a"],), (["2.5", "yy", "NULL"],), (["3", "é", "?", "z", "extra"],)], "fields array<string>")
    got = [tuple(r) for r in profile.column_profile(rows, 4, ["a", "b"]).orderBy("col").collect()]
    assert got == [(0, "a", 0, 1, 3, True, False, False), (1, "b", 0, 1, 2, False, False, False), (2, "col_2", 3, 0, 0, True, True, True), (3, "col_3", 1, 1, 1, False, False, False)]


def test_numbering_over_partitions(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("o1"))
    got = merge.numbered(df, ["o1"], partitions=13)
    assert got.where("seq <> o1 + 1").count() == 0 and got.count() == 5000


def test_options():
    spec = MergeSpec.from_options({"mode": "TS", "join_type": "outer", "dedup": "full", "time_format": "rfc", "key": "2", "delimiter": "\\t"})
    assert (spec.mode, spec.join_type, spec.dedup.key, spec.timestamp.kind, spec.key, spec.delimiter) == ("timestamp", "full", "line", "rfc2822", 2, "\t")
    for bad in ({"mode": "x"}, {"nope": 1}, {"dedup": "x"}):
        with pytest.raises(ValueError):
            MergeSpec.from_options(bad)


def test_header_warnings():
    with pytest.warns(UserWarning, match="number of columns"):
        merge.check_headers(["a,b", "a"])
    with pytest.warns(UserWarning, match="some files"):
        merge.check_headers(["a,b", None])


def test_stream(spark, folder):
    (folder.path / "in").mkdir()
    (folder.path / "in" / "a.txt").write_text("2024-01-01 00:00:00 x\n\n2024-01-01 00:00:00 x\n# c\n2024-01-01 00:00:05 y\n")
    out = cleaned(stream_lines(spark, str(folder.path / "in")), FilterSpec(skip_blank=True, skip_comments=True), DedupSpec("line"), TimestampSpec())
    q = out.select("content").writeStream.format("memory").queryName("cleaned_lines").option("checkpointLocation", str(folder.path / "ck")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert sorted(r[0] for r in spark.sql("select * from cleaned_lines").collect()) == ["2024-01-01 00:00:00 x", "2024-01-01 00:00:05 y"]


def test_command_line(spark, folder, capsys):
    inputs = folder(a__csv=A, b__csv=B)
    out = str(folder.path / "o.txt")
    assert cli.main(["-m", "seq", "--include", "*a*", "--dedup-columns", "0-0", "-o", out, *inputs]) == 0
    assert "n_lines" in capsys.readouterr().out and open(out).read().startswith("name,age,city\nBob")
    assert cli.main(["--detect", *inputs]) == 0 and "format: csv" in capsys.readouterr().out
    assert cli.main(["-m", "what", "-o", out, *inputs]) == 1


def test_file_helpers(tmp_path):
    a, b = str(tmp_path / "d" / "a"), str(tmp_path / "e" / "b")
    files.write_lines(a, ["x", "é"])
    files.write_text(a, "tail", append=True)
    assert files.read_text(a) == "x\né\ntail" and files.read_bytes(a) == "x\né\ntail".encode()
    files.copy(a, b)
    assert files.same_files(a, b) and files.crc32(a) == files.crc32(b)
    files.move(b, b + "2")
    assert files.remove(b + "2") and not files.remove(b)
    files.write_bytes(a, b"123456789")
    assert files.crc32(a) == 0xCBF43926


def test_byte_classes():
    assert encodings.decodes("😀".encode("utf-16-le"), "utf16le") and not encodings.decodes(b"\x00\xd8", "utf16le") and not encodings.decodes(b"\xc0\x80", "utf8")
    assert encodings.is_ascii(b"a") and encodings.could_be_latin1(b"\xe9") and not encodings.could_be_latin1(b"\x85") and encodings.could_be_gbk("名字".encode("gbk"))
    assert encodings.looks_binary(b"a\0") and not encodings.looks_binary(b"text\n")


def test_inputs_of_other_file_systems(spark, folder, tmp_path_factory):
    out = tmp_path_factory.mktemp("out") / "o.txt"
    inputs = folder(a__csv="name,age\nAlice,25\nBob,30\n", b__csv="name,age\nEve,32\n")
    conf = spark._jsc.hadoopConfiguration()
    conf.set("fs.viewfs.mounttable.other.link./in", f"file://{folder.path}")
    want = "name,age\nAlice,25\nBob,30\nEve,32\n"
    assert files.expand_inputs([f"file://{folder.path}"], spark=spark) == sorted(inputs)
    for given in (["viewfs://other/in/*.csv"], ["viewfs://other/in"], ["viewfs://other/in/b.csv", "viewfs://other/in/a.csv"], [f"file://{folder.path}/*.csv"]):
        assert merged(spark, given, out, mode="seq") == want
    assert [r["size"] for r in plans.profiles_table(spark, ["viewfs://other/in/a.csv"]).collect()] == [len("name,age\nAlice,25\nBob,30\n")]
    assert files.expand_inputs(["viewfs://other/in/*.txt"], spark=spark) == []


def test_ignored_and_unknown_options():
    assert MergeSpec.from_options({"mode": "seq", "max_memory": "1G", "file_type": "csv", "smart_io": True}) == MergeSpec()
    assert MergeSpec.from_options({"mode": "nonsense", "dedup": "nonsense", "compat": "observed"}) == MergeSpec(dedup=DedupSpec("line"), compat="observed")
    with pytest.raises(ValueError, match="unknown option"):
        MergeSpec.from_options({"mode": "nonsense"})


def test_last_in_place_keeps_null_lines(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "A"), (4, None)], "n long, content string")
    got = dedup.deduplicated(df, DedupSpec("line", "last_in_place", ignore_case=True), ["n"]).collect()
    assert sorted(map(tuple, got)) == [(1, "A"), (2, None)]


def test_bad_expressions_are_told_at_once(spark):
    df = spark.createDataFrame([("a1",)], "content string")
    assert df.where(text.matches(F.col("content"), r"re:\p{L}\d")).count() == 1
    with pytest.raises(ValueError, match="bad pattern"):
        text.matches(F.col("content"), "re:(")


def test_observed_joins_lose_keyless_rows_of_the_second_file(spark, folder):
    inputs = folder(l__csv="1,a\n2,b\n", r__csv="x,1\nz,3\nlone\n")
    rows = [joined_rows(spark, inputs, how, keyless) for how in ("full", "right_anti") for keyless in (True, False)]
    assert rows == [["1,a,x,1", "2,b", "z,3", "lone"], ["1,a,x,1", "2,b", "z,3"], ["z,3", "lone"], ["z,3"]]
    with pytest.raises(plans.MergeError, match="no rows"):
        plans.merge_files(spark, folder(a__csv="1,a\n", e__csv=""), MergeSpec(mode="conditional", compat="observed"))


def joined_rows(spark, inputs, how, keyless):
    l, r = (join.rows_of(lines.scan_lines(spark, [p])) for p in inputs)  # noqa: E741
    out = join.joined(l, r.withColumn("line_no", F.col("line_no") + 10), 0, 1, how, keyless=keyless)
    return [",".join(x.fields) for x in out.orderBy(F.coalesce("left_no", "right_no")).collect()]


def test_observed_joins_pass_bytes_through(spark, folder):
    left, right = "名字,k\n李雷,1\n韩梅,2\n".encode("gbk"), "k,城\n1,北京\n2,巴黎\n".encode()
    inputs, out = folder(l__csv=left, r__csv=right), folder.path / "o.txt"
    options = {"mode": "join", "key": "k", "exclude": ("巴黎",)}
    plans.merge_to_file(spark, inputs, MergeSpec.from_options(options | {"compat": "observed"}), str(out))
    assert out.read_bytes() == "名字,k,".encode("gbk") + "k,城\n".encode() + "李雷,1,".encode("gbk") + "1,北京\n".encode()
    plans.merge_to_file(spark, inputs, MergeSpec.from_options(options), str(out))
    assert out.read_text() == "名字,k,k,城\n李雷,1,1,北京\n"


@pytest.mark.parametrize("pattern, line, documented, observed", [("x[^a]y", "xby", True, False), ("x[^a]y", "x^y", True, True), ("x[*]y", "x.y", False, True), ("x[?]y", "x?y", True, False), ("x[?]y", "x.y", False, True), ("x[a-c]y", "1xby2", True, True), ("x[]y", "1x[]y", False, False), ("x[]y", "x[]y", True, True)])
def test_globs_with_brackets(spark, pattern, line, documented, observed):
    df = spark.createDataFrame([(line,)], "content string")
    for compat, want in (("documented", documented), ("observed", observed)):
        assert df.where(text.matches(F.col("content"), pattern, compat=compat)).count() == want, compat


def test_strict_conversion(spark):
    bad = "é".encode() + b"\xff\xfe" + "李".encode()
    assert encodings.converted(bad, "utf-8", "latin-1") == (b"\xe9???", 5, True)  # two bytes, two marks and a sign that Latin-1 lacks
    assert encodings.converted(bad, "utf-8", "latin-1", strict=True) == (b"\xe9", 3, False)
    assert encodings.converted(bad, "utf8", "utf-8", strict=True) == (bad, 0, True)
    assert encodings.converted("李雷".encode(), "utf-8", "gbk", strict=True) == ("李雷".encode("gbk"), 0, True)
    with pytest.raises(ValueError, match="cannot convert"):
        encodings.converted(b"", "what", "utf-8")
    df = spark.createDataFrame([(1, bytearray(bad)), (2, None), (3, bytearray())], "n int, b binary")
    got = df.select("n", encodings.converted_column(F.col("b"), "utf-8", "latin-1", True).alias("c")).orderBy("n").select("c").collect()
    assert [c and (bytes(c.output), c.n_lost, c.success) for (c,) in got] == [(b"\xe9", 3, False), None, (b"", 0, True)]


def test_paths_and_time_patterns(spark):
    paths = {"/a/./b//../c": "/a/c", "../a/../..": "../..", "/..": "/", "a/..": ".", "": ".", "a/b/": "a/b"}
    df = spark.createDataFrame([*paths.items()], "p string, want string")
    assert df.where(text.normal_path(F.col("p")) == F.col("want")).count() == len(paths)
    both = spark.createDataFrame([("a/", "b", "a/b"), ("a", "/b", "/b"), ("", "b", "b"), ("a", "", "a"), ("/", "b", "/b")], "l string, r string, want string")
    assert both.where(text.combined_path(F.col("l"), F.col("r")) == F.col("want")).count() == 5
    at = F.lit("2024-03-05 07:08:09").cast("timestamp")
    shown = spark.range(1).select(timestamps.formatted(at, "%d/%b/%Y %H:%M:%S 100%% it's"), timestamps.formatted(at, "%F %I%p %j")).first()
    assert tuple(shown) == ("05/Mar/2024 07:08:09 100% it's", "2024-03-05 07AM 065")
    with pytest.raises(ValueError, match="unknown part"):
        timestamps.formatted(at, "%Q")


def test_whole_file_is_split_once(spark, folder):
    """A file in UTF-16 is split in the generator alone, not again beside each of its lines."""
    (path,) = folder(x__txt="a\r\n\nb\n\n".encode("utf-16-le"))
    df = lines.scan_lines(spark, [path], "utf-16-le")
    assert df._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
    assert [(r.line_no, r.content) for r in df.orderBy("line_no").collect()] == [(1, "a"), (2, ""), (3, "b"), (4, "")]
    (empty, blank) = folder(e__txt=b"", n__txt="\n".encode("utf-16-le"))
    assert [(r.file_idx, r.line_no, r.content) for r in lines.scan_lines(spark, [empty, blank], "utf-16-le").collect()] == [(1, 1, "")]


@pytest.mark.parametrize("encoding", [*lines.FEEDS])
@pytest.mark.parametrize("split", ["128m", "97", "64"])
def test_wide_files_are_split(spark, folder, monkeypatch, encoding, split):
    """No file of UTF-16 is a row; feeds across two characters end no line."""
    rnd = random.Random(split)
    contents = {f"f{k}__txt": "".join(rnd.choices(chars, k=900)) + end for k, (chars, end) in enumerate([("ab\n\r名", ""), ("a\n\nਅ一ĀĊ上", "\n"), ("上Ċ\n", "\n\n"), ("ਅ一", "x"), ("\n", "")])}
    data = {n: encodings.with_mark(t.encode(encoding), encoding if n == "f0__txt" else "") for n, t in contents.items()}
    data["empty__txt"] = b""
    cut = b"\xef\xbb\xbf\x00" if encoding == "utf-16-le" else b"\xef\xbb\xbf\x4e"
    if not encoding.startswith("utf-32"):  # starts with what would be a mark in UTF-8
        data["g__txt"] = cut + "x\ny".encode(encoding)
        contents["g__txt"] = cut.decode(encoding) + "x\ny"
    paths = folder(**data)
    want = [(k, n + 1, x.removesuffix("\r")) for k, name in enumerate(data) if contents.get(name) for n, x in enumerate(contents[name].removesuffix("\n").split("\n"))]
    for size, most in ((-1, "1"), (1 << 20, "2147483647")):
        monkeypatch.setattr(lines, "WHOLE", size)
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.sources.binaryFile.maxLength", most)
        try:
            got = sorted((r.file_idx, r.line_no, r.content) for r in lines.scan_lines(spark, paths, encoding).collect())
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
        assert got == want


def test_headers_that_differ_are_told(spark):
    with pytest.warns(UserWarning, match="some files only"):
        merge.check_headers(["a,b", None])
    with pytest.warns(UserWarning, match="another number of columns"):
        merge.check_headers(["a,b", "a"])
    with pytest.warns(UserWarning, match="other names"):
        merge.check_headers(["a,b", "a,c"])


def test_sniffing_and_detection_of_columns(spark):
    rnd = random.Random(3)
    data = [b"", b"a", "naïve".encode(), "名字".encode("gbk"), b"caf\xe9 ", "ab\n".encode("utf-16-be"), "名a".encode("utf-16-le"), b"\xff\xfea\0", b"\0", b"\x01\x02x\xc3\xa9", b"\xef\xbb\xbfx"]
    data += [bytes(rnd.choices(range(256), [rnd.choice([1, 200]), *[1] * 127, *[rnd.choice([0, 3])] * 128], k=rnd.randrange(1, 40))) for _ in range(300)]
    got = spark.createDataFrame([*enumerate(data), (-1, None)], "id int, b binary").select("id", encodings.detected(F.col("b")).alias("d")).collect()
    want = {k: encodings.judged(encodings.counts_of(b), encodings.mark_of(b)) for k, b in enumerate(data)}
    assert {r.id: r.d and tuple(r.d) for r in got} == want | {-1: None}
    words = ["a,b", "a\tb,c", "", "  ", '{"a": [1', "]}", "<x>", "2024-01-02 03:04:05 x", "an error", '"a,b",c', "x;y", "[", "plain"]
    samples = [[rnd.choice(words) for _ in range(rnd.randrange(1, 6))] for _ in range(300)]
    rows = spark.createDataFrame([*enumerate(samples)], "id int, l array<string>")
    out = rows.select("id", sniff_columns.content_format(F.col("l")).alias("f"), sniff_columns.delimiter_confidence(F.col("l"), ",").alias("c"), sniff_columns.delimiter_of_line(F.get("l", F.lit(0))).alias("d")).collect()
    assert {r.id: (r.f, r.c, r.d) for r in out} == {k: (sniff.content_format(x), sniff.delimiter_confidence(x, ","), sniff.delimiter_of_line(x[0])) for k, x in enumerate(samples)}
