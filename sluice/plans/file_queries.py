"""Registered queries that render tables to files and read, sniff, decode or merge them.

Folders of part files are written and scanned by the executors, in any shared
folder; queries that end in one file need one that the driver sees as a path.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import encodings, sniff, sniff_columns, text
from ..functions.timestamps import formatted
from ..operators import dedup, merge
from ..sources import files, sinks
from ..sources.lines import scan_lines
from ..sources.shared import scratch_dir
from ..spec import DedupSpec, MergeSpec
from .catalogue import _LINES, _csv, _doc_lines, _table, query
from .files import merge_files, merge_to_file, profile

PARTS = "part-*"


def _parts(spark: SparkSession, there: str, recursive: bool = False) -> list[str]:
    return files.expand_inputs([there if files.is_uri(there) else f"file://{there}"], recursive, PARTS, spark=spark)


def _local(there: str) -> str:
    """A scratch folder as a path of the driver, made."""
    path = there.removeprefix("file://").removeprefix("file:")
    if files.is_uri(path):
        raise ValueError(f"{there} is no folder of a file system that the driver sees")
    os.makedirs(path, exist_ok=True)
    return path


def _headed(df: DataFrame, header: str, key: str, content) -> DataFrame:
    """Lines of a table under a header: at (from -1, the header's), content."""
    head = df.sparkSession.createDataFrame([(-1, header)], "at long, content string")
    return head.union(df.select(F.col(key).cast("long"), content))


def _in_order(lines: DataFrame) -> DataFrame:
    return merge.numbered(lines, merge.ORDER).select("seq", "content")


# ---- scans and sinks -------------------------------------------------------
@query("scan_parts", f"WITH {_LINES} SELECT row_number() OVER (ORDER BY doc_id, line_no) AS seq, content FROM lines WHERE content <> ''")
def scan_parts(spark: SparkSession, d: str) -> DataFrame:
    """Lines written in order to a folder of files, and read in the files' order."""
    there = scratch_dir(spark, "lines")
    sinks.write_lines(_doc_lines(spark, d), ["doc_id", "line_no"], there)
    return _in_order(merge.sequential(scan_lines(spark, _parts(spark, there))))


@query("scan_line_numbers", f"WITH {_LINES} SELECT count(*) AS n_lines, true AS from_one, true AS whole, true AS same_written FROM lines WHERE content <> ''")
def scan_line_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Whether the lines of each file are numbered from 1 without gaps."""
    there = scratch_dir(spark, "lines")
    written = sinks.write_lines(_doc_lines(spark, d), ["doc_id", "line_no"], there)
    per_file = scan_lines(spark, _parts(spark, there)).groupBy("path").agg(F.count("*").alias("n"), F.min("line_no").alias("low"), F.max("line_no").alias("high"), F.count_distinct("line_no").alias("distinct"))
    total = F.coalesce(F.sum("n"), F.lit(0))
    return per_file.agg(total.alias("n_lines"), F.bool_and(F.col("low") == 1).alias("from_one"), F.bool_and((F.col("high") == F.col("n")) & (F.col("distinct") == F.col("n"))).alias("whole"), (total == written["n_lines"]).alias("same_written"))


@query("scan_carriage_returns", f"WITH {_LINES} SELECT content || chr(13) AS with_cr, content AS without_cr, count(*) AS n FROM lines GROUP BY content")
def scan_carriage_returns(spark: SparkSession, d: str) -> DataFrame:
    """Lines that end in two bytes, read with and without the first; blank ones too."""
    there = scratch_dir(spark, "lines")
    sinks.write_lines(_doc_lines(spark, d).withColumn("content", F.concat("content", F.lit("\r"))), ["doc_id", "line_no"], there)
    paths = _parts(spark, there)
    as_is = scan_lines(spark, paths, keep_cr=True).withColumnRenamed("content", "with_cr")
    cut = scan_lines(spark, paths).withColumnRenamed("content", "without_cr")
    return as_is.join(cut.select("file_idx", "line_no", "without_cr"), ["file_idx", "line_no"]).groupBy("with_cr", "without_cr").agg(F.count("*").alias("n"))


@query("append_parts", "SELECT concat_ws(',', n_nationkey, n_name) AS content FROM nation UNION ALL SELECT concat_ws(',', r_regionkey, r_name) FROM region")
def append_parts(spark: SparkSession, d: str) -> DataFrame:
    """A folder written over, then written to again."""
    there = scratch_dir(spark, "lines")
    nation = _table(spark, d, "nation").select("n_nationkey", _csv("n_nationkey", "n_name").alias("content"))
    region = _table(spark, d, "region").select("r_regionkey", _csv("r_regionkey", "r_name").alias("content"))
    for df, mode in ((region, "overwrite"), (nation, "overwrite"), (region, "append")):
        sinks.write_lines(df, df.columns[:1], there, mode=mode)
    return scan_lines(spark, _parts(spark, there)).select("content")


_WRITTEN = ("utf-8", "utf-8-sig", "utf-16-le", "utf-16-be")


@query("scan_encodings", f"""WITH {_LINES}, e AS (SELECT unnest(['{"', '".join(_WRITTEN)}']) AS written)
SELECT written, written AS detected, row_number() OVER (PARTITION BY written ORDER BY doc_id, line_no) AS line_no, content FROM lines, e WHERE content <> ''""")
def scan_encodings(spark: SparkSession, d: str) -> DataFrame:
    """One file in each encoding, with its mark: what it is taken for, and its lines."""
    there = _local(scratch_dir(spark, "encodings"))
    tables = []
    for encoding in _WRITTEN:
        path = f"{there}/{encoding}.txt"
        sinks.write_file(_doc_lines(spark, d), ["doc_id", "line_no"], path, encoding)
        found = profile(spark, path).encoding
        tables.append(scan_lines(spark, [path], found).select(F.lit(encoding).alias("written"), F.lit(found).alias("detected"), "line_no", "content"))
    out = tables[0]
    for t in tables[1:]:
        out = out.union(t)
    return out


@query("file_helpers", "SELECT r_name AS name, r_name || chr(10) || r_name || chr(10) AS text, (2 * strlen(r_name) + 2)::BIGINT AS n_bytes, true AS same, false AS same_after_append, false AS there, r_name AS folder FROM region")
def file_helpers(spark: SparkSession, d: str) -> DataFrame:
    """The driver's file helpers, once for each region."""
    there, rows = _local(scratch_dir(spark, "helpers")), []
    for (name,) in _table(spark, d, "region").select("r_name").collect():
        first, second, third = (f"{there}/{name}/{x}.txt" for x in ("a", "b", "c"))
        files.write_lines(first, [name])
        files.write_lines(first, [name], append=True)
        files.copy(first, second)
        same = files.same_files(first, second) and files.crc32(first) == files.crc32(second)
        files.write_text(second, "x", append=True)
        differs = files.same_files(first, second) or files.crc32(first) == files.crc32(second)
        files.move(first, third)
        read = files.read_text(third)
        size = len(files.read_bytes(third))
        files.remove(second)
        folder = next(os.path.basename(x) for x in files.list_directories(there) if files.list_files(x) == [third])
        rows.append((name, read, size, same, differs, files.remove(first), folder))
    return spark.createDataFrame(rows, "name string, text string, n_bytes long, same boolean, same_after_append boolean, there boolean, folder string")


# ---- merges of files -------------------------------------------------------
@query("files_sequential", """SELECT row_number() OVER (ORDER BY f, k) AS seq, content FROM (SELECT 0 AS f, -1 AS k, 'custkey,name' AS content
  UNION ALL SELECT 1, c_custkey, concat_ws(',', c_custkey, c_name) FROM customer UNION ALL SELECT 2, s_suppkey, concat_ws(',', s_suppkey, s_name) FROM supplier)""")
def files_sequential(spark: SparkSession, d: str) -> DataFrame:
    """Two folders of files with a header in the first of each, expanded, sniffed and
    merged: the second header goes."""
    there = scratch_dir(spark, "merge")
    for name, table, key, column in (("a", "customer", "c_custkey", "c_name"), ("b", "supplier", "s_suppkey", "s_name")):
        sinks.write_lines(_headed(_table(spark, d, table), "custkey,name", key, _csv(key, column)), ["at"], f"{there}/{name}")
    return _in_order(merge_files(spark, _parts(spark, there, True), MergeSpec.from_options({"mode": "seq"})))


@query("files_interleaved", """SELECT row_number() OVER (ORDER BY n, f) AS seq, content FROM (SELECT 0 AS n, 0 AS f, 'key,name' AS content
  UNION ALL SELECT row_number() OVER (ORDER BY c_custkey), 0, concat_ws(',', c_custkey, c_name) FROM customer UNION ALL SELECT row_number() OVER (ORDER BY s_suppkey), 1, concat_ws(',', s_suppkey, s_name) FROM supplier)""")
def files_interleaved(spark: SparkSession, d: str) -> DataFrame:
    """Two files by turns, the first header only."""
    there = scratch_dir(spark, "merge")
    for name, table, key, column in (("a", "customer", "c_custkey", "c_name"), ("b", "supplier", "s_suppkey", "s_name")):
        sinks.write_lines(_headed(_table(spark, d, table), "key,name", key, _csv(key, column)), ["at"], f"{there}/{name}", partitions=1)
    return _in_order(merge_files(spark, _parts(spark, there, True), MergeSpec.from_options({"mode": "interleave"})))


@query("files_joined", """WITH l AS (SELECT c_custkey AS k, c_name AS name FROM customer), r AS (SELECT o_orderkey AS o, o_custkey + 3 AS k, o_orderstatus AS s FROM orders)
SELECT row_number() OVER (ORDER BY h, lk NULLS LAST, o) AS seq, content FROM (SELECT 0 AS h, 0 AS lk, 0 AS o, 'custkey;name;orderkey;custkey;status' AS content
  UNION ALL SELECT 1, l.k, o, coalesce(l.k::VARCHAR, '') || ';' || coalesce(name, '') || ';' || coalesce(o::VARCHAR, '') || ';' || coalesce(r.k::VARCHAR, '') || ';' || coalesce(s, '') FROM l FULL JOIN r ON l.k = r.k)""")
def files_joined(spark: SparkSession, d: str) -> DataFrame:
    """Two files joined by a column that their headers name, rows without partners
    included, written with another delimiter."""
    there = scratch_dir(spark, "merge")
    orders = _table(spark, d, "orders").withColumn("k", F.col("o_custkey") + 3)
    sinks.write_lines(_headed(_table(spark, d, "customer"), "custkey,name", "c_custkey", _csv("c_custkey", "c_name")), ["at"], f"{there}/a", partitions=1)
    sinks.write_lines(_headed(orders, "orderkey,custkey,status", "o_orderkey", _csv("o_orderkey", "k", "o_orderstatus")), ["at"], f"{there}/b", partitions=1)
    return _in_order(merge_files(spark, _parts(spark, there, True), MergeSpec.from_options({"mode": "join", "join_type": "outer", "key": "custkey", "delimiter": ";"})))


@query("files_by_time", """SELECT row_number() OVER (ORDER BY sec, f, event_id) AS seq, strftime(sec, '%Y-%m-%d %H:%M:%S') || ' ' || event_id || ' ' || event_type AS content
FROM (SELECT date_trunc('second', ts) AS sec, event_id % 2 AS f, event_id, event_type FROM events)""")
def files_by_time(spark: SparkSession, d: str) -> DataFrame:
    """Log files of two sources merged by the seconds of their lines; ties by file and line."""
    there = scratch_dir(spark, "merge")
    line = F.concat_ws(" ", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.col("event_id").cast("string"), "event_type")
    for k, name in enumerate("ab"):
        sinks.write_lines(_table(spark, d, "events").where(F.col("event_id") % 2 == k).select("event_id", line.alias("content")), ["event_id"], f"{there}/{name}")
    return _in_order(merge_files(spark, _parts(spark, there, True), MergeSpec.from_options({"mode": "ts", "time_format": "iso"})))


@query("files_binary", f"""WITH {_LINES}, b AS (SELECT string_agg(content || chr(10), '' ORDER BY doc_id, line_no) AS t FROM lines WHERE content <> '')
SELECT strlen(t)::BIGINT AS n_bytes, strlen(t)::BIGINT AS n_written, md5(t) AS md5 FROM b""")
def files_binary(spark: SparkSession, d: str) -> DataFrame:
    """Files put after one another as bytes; the result is of any size, so it is
    read back in blocks."""
    there = _local(scratch_dir(spark, "bytes"))
    sinks.write_lines(_doc_lines(spark, d), ["doc_id", "line_no"], f"{there}/in")
    out = f"{there}/out"
    written = merge_to_file(spark, _parts(spark, f"{there}/in"), MergeSpec.from_options({"mode": "binary"}), out)
    return spark.createDataFrame([(os.path.getsize(out), written["n_bytes"], files.digest(out))], "n_bytes long, n_written long, md5 string")


@query("files_summary", """WITH c AS (SELECT min(o_orderkey) || ',' || o_orderstatus || ',' || o_orderpriority AS x FROM orders GROUP BY o_orderstatus, o_orderpriority)
SELECT count(*) + 1 AS n_lines, (sum(length(x)) + 19)::BIGINT AS n_chars, 'planned,written' AS said FROM c""")
def files_summary(spark: SparkSession, d: str) -> DataFrame:
    """What a merge into one file, the first line of each pair of fields, says of itself."""
    there, said = _local(scratch_dir(spark, "merge")), []
    sinks.write_lines(_headed(_table(spark, d, "orders"), "key,status,priority", "o_orderkey", _csv("o_orderkey", "o_orderstatus", "o_orderpriority")), ["at"], f"{there}/in")
    options = {"mode": "seq", "dedup": "columns", "dedup_first": 1, "dedup_last": 2}
    counts = merge_to_file(spark, _parts(spark, f"{there}/in"), MergeSpec.from_options(options), f"{there}/out.csv", said.append)
    return spark.createDataFrame([(counts["n_lines"], counts["n_chars"], ",".join(said))], "n_lines long, n_chars long, said string")


# ---- duplicates that stay --------------------------------------------------
for _name, _spec in (("dedup_keep_all", DedupSpec("line", "all")), ("dedup_none", DedupSpec("none"))):
    query(_name, f"WITH {_LINES} SELECT content, count(*) AS n FROM lines GROUP BY content")(
        lambda spark, d, spec=_spec: dedup.deduplicated(_doc_lines(spark, d), spec, ["doc_id", "line_no"]).groupBy("content").agg(F.count("*").alias("n"))
    )


# ---- sniffing --------------------------------------------------------------
@query("detect_bytes", r"""SELECT doc_id, CASE WHEN text IS NULL THEN NULL WHEN regexp_matches(text, '[^\x00-\x7F]') THEN 'utf-8' ELSE 'ascii' END AS plain,
  CASE WHEN text IS NULL THEN NULL WHEN regexp_matches(text, '[^\x00-\x7F]') THEN 0.95 ELSE 0.9 END::DOUBLE AS plain_confidence,
  CASE WHEN text IS NOT NULL THEN 'utf-16-le' END AS marked, CASE WHEN text IS NOT NULL THEN 0.95 END::DOUBLE AS marked_confidence FROM documents""")
def detect_bytes(spark: SparkSession, d: str) -> DataFrame:
    """Texts as UTF-8, and as UTF-16 with a mark (none has control characters)."""
    marked = F.concat(F.lit(b"\xff\xfe"), encodings.encoded(F.col("text"), "utf-16le"))
    found = _table(spark, d, "documents").select("doc_id", encodings.detected(F.col("text").cast("binary")).alias("p"), encodings.detected(marked).alias("m"))
    return found.select("doc_id", F.col("p.encoding").alias("plain"), F.col("p.confidence").alias("plain_confidence"), F.col("m.encoding").alias("marked"), F.col("m.confidence").alias("marked_confidence"))


_DELIMITERS = r"[',', chr(9), ' ', ':', ';', '|']"


@query("delimiter_of_line", f"""WITH {_LINES}, n AS (SELECT doc_id, line_no, list_transform({_DELIMITERS}, lambda x: length(content) - length(replace(content, x, ''))) AS c FROM lines)
SELECT doc_id, line_no, {_DELIMITERS}[list_position(c, list_max(c))] AS delimiter FROM n""")
def delimiter_of_line(spark: SparkSession, d: str) -> DataFrame:
    return _doc_lines(spark, d).select("doc_id", "line_no", sniff_columns.delimiter_of_line(F.col("content")).alias("delimiter"))


_CONFIDENCE = "CASE WHEN len({w}) = 0 THEN 0.0 WHEN len(list_distinct({w})) = 1 THEN CASE WHEN {w}[1] >= 2 THEN 0.9 ELSE 0.1 END WHEN list_max({w}) >= 2 THEN 0.5 + 0.3 * (1 - (len(list_distinct({w})) - 1)::DOUBLE / len({w})) ELSE 0.1 END::DOUBLE"


@query("delimiter_confidence", rf"""WITH w AS (SELECT doc_id, list_transform(list_filter(string_split(replace(text, '"', ''), chr(10)), lambda x: regexp_matches(x, '[^ \t\n\x0b\f\r]')), lambda x: length(x) - length(replace(x, ' ', '')) + 1) AS w FROM documents)
SELECT doc_id, {_CONFIDENCE.format(w="w")} AS confidence FROM w""")
def delimiter_confidence(spark: SparkSession, d: str) -> DataFrame:
    """How well spaces part the lines of each text, quotes taken out."""
    lines = F.split(F.replace("text", F.lit('"'), F.lit("")), "\n", -1)
    return _table(spark, d, "documents").select("doc_id", sniff_columns.delimiter_confidence(lines, " ").alias("confidence"))


_DRESSED = """CASE doc_id % 6 WHEN 0 THEN '{"k": 1}' || chr(10) || text WHEN 1 THEN '<page>' || chr(10) || text WHEN 2 THEN replace('2024-01-02 03:04:05 ' || text, '. ', chr(10) || '2024-01-02 03:04:05 ')
  WHEN 3 THEN replace(replace(replace(text, ',', ''), ' ', chr(9)), '"', '') WHEN 4 THEN replace(replace(text, ', ', ' '), ',', ' ') ELSE replace(text, '. ', '.,') END"""


@query("content_formats", rf"""WITH t AS (SELECT doc_id, string_split(replace({_DRESSED}, '"', ''), chr(10))[1:30] AS l FROM documents WHERE text IS NOT NULL),
s AS (SELECT *, list_filter(list_transform(l, lambda x: regexp_replace(regexp_replace(x, '^[ \t\n\x0b\f\r]+', ''), '[ \t\n\x0b\f\r]+$', '')), lambda x: x <> '') AS shown, array_to_string(l, '') AS flat FROM t),
w AS (SELECT *, list_transform(shown, lambda x: length(x) - length(replace(x, ',', '')) + 1) AS wc, list_transform(list_filter(l, lambda x: regexp_matches(x, '[^ \t\n\x0b\f\r]')), lambda x: length(x) - length(replace(x, chr(9), '')) + 1) AS wt FROM s),
c AS (SELECT *, {_CONFIDENCE.format(w="wc")} AS comma, {_CONFIDENCE.format(w="wt")} AS tab FROM w)
SELECT doc_id, CASE WHEN len(list_filter(l, lambda x: regexp_matches(x, '\d{{4}}[-/]\d{{1,2}}[-/]\d{{1,2}}\s+\d{{1,2}}:\d{{1,2}}:\d{{1,2}}|(?i)\b(INFO|DEBUG|WARN|ERROR|FATAL|TRACE)\b'))) > 0.3 * len(l) THEN 'log'
  WHEN len(shown) > 0 AND (shown[1][1] IN ('[', '{{') OR contains(l[1], '{{') AND length(replace(flat, '{{', '')) = length(replace(flat, '}}', '')) OR contains(l[1], '[') AND length(replace(flat, '[', '')) = length(replace(flat, ']', ''))) THEN 'json'
  WHEN len(list_filter(shown, lambda x: starts_with(x, '<?xml') OR starts_with(x, '<!DOCTYPE') OR length(x) > 2 AND starts_with(x, '<') AND ends_with(x, '>'))) > 0 THEN 'xml'
  WHEN tab > 0.5 AND tab > comma THEN 'tsv' WHEN comma > 0.5 THEN 'csv' ELSE 'text' END AS format FROM c""")
def content_formats(spark: SparkSession, d: str) -> DataFrame:
    """What the first 30 lines (the sniffer's sample) of texts in six dresses, without quotes, are taken for."""
    dressed = F.expr(_DRESSED.replace("chr(10)", "'\\n'").replace("chr(9)", "'\\t'"))
    texts = _table(spark, d, "documents").where("text is not null").select("doc_id", F.replace(dressed, F.lit('"'), F.lit("")).alias("t"))
    return texts.select("doc_id", sniff_columns.content_format(F.slice(F.split("t", "\n", -1), 1, sniff.SAMPLE)).alias("format"))


# ---- strings, paths and times ----------------------------------------------
@query("affixes", f"""WITH {_LINES} SELECT doc_id, line_no, starts_with(content, 'El') AS starts, ends_with(content, '.') AS ends, contains(content, 'tion') AS has,
  contains(translate(content, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'the') AS has_any_case, contains(content, '. A') AS has_signs FROM lines""")
def affixes(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("content")
    return _doc_lines(spark, d).select("doc_id", "line_no", c.startswith("El").alias("starts"), c.endswith(".").alias("ends"), c.contains("tion").alias("has"), text.contains_ignoring_case(c, "THE").alias("has_any_case"), c.rlike(text.quoted(". A")).alias("has_signs"))


@query("path_functions", r"""WITH p AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^?#]*)', 1) AS p FROM pages)
SELECT page_id, '/data/' || p AS below, '/' || p AS absolute, true AS is_absolute, regexp_replace(p, '/$', '') AS normal, '../' || regexp_replace(p, '/$', '') AS outside, CASE WHEN contains(n, '.') THEN regexp_extract(n, '^(.*)\.[^.]*$', 1) ELSE n END AS stem
FROM (SELECT *, regexp_extract(p, '([^/]*)$', 1) AS n FROM p)""")
def path_functions(spark: SparkSession, d: str) -> DataFrame:
    p = F.regexp_extract("url", "^[a-z]+://([^?#]*)", 1)
    slash, up = F.lit("/"), F.lit("..")
    rows = _table(spark, d, "pages").select("page_id", p.alias("p"))
    p = F.col("p")
    absolute = text.combined_path(F.lit("/data"), F.concat(slash, p))
    return rows.select("page_id", text.combined_path(F.lit("/data/"), p).alias("below"), absolute.alias("absolute"), text.is_absolute(absolute).alias("is_absolute"),
        text.normal_path(F.concat(F.lit("./x//../"), p, F.lit("/./y/.."))).alias("normal"), text.normal_path(F.concat_ws("/", F.lit("x"), up, up, p)).alias("outside"), text.stem(p).alias("stem"))


@query("ts_pattern", "SELECT event_id, strftime(ts, '%d/%m/%y %H-%M-%S, day %j: 100%%') AS t, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso FROM events")
def ts_pattern(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "events").select("event_id", formatted(F.col("ts"), "%d/%m/%y %H-%M-%S, day %j: 100%%").alias("t"), formatted(F.col("ts"), "%FT%T").alias("iso"))
