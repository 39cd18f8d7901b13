"""Registered queries of the line operators over whole tables, each with its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import encodings, sniff, text
from ..functions.timestamps import iso_text, timestamp_of
from ..operators import dedup, filters, join, merge, profile
from ..spec import DedupSpec, FilterSpec, MergeSpec, TimestampSpec

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _csv(*columns: str):
    return text.csv_line(F.array(*(F.col(c).cast("string") for c in columns)))


def _file(df: DataFrame, order: list[str], content, file_idx: int) -> DataFrame:
    """A table's rows as the lines of a file, in the order of a key."""
    numbered = merge.numbered(df, order, "line_no")
    return numbered.select(F.lit(file_idx).alias("file_idx"), F.lit(f"f{file_idx}").alias("path"), "line_no", content.alias("content"), F.lit(False).alias("is_header"))


def _doc_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of documents: doc_id, line_no (from 1), content."""
    lines = _table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "content"))
    return lines.select("doc_id", (F.col("at") + 1).cast("long").alias("line_no"), "content")


_LINES = "lines AS (SELECT doc_id, i AS line_no, string_split(text, chr(10))[i] AS content FROM documents, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS t(i))"
_SPACE = r"[ \t\n\x0b\f\r]"


# ---- order -----------------------------------------------------------------
@query("sequential_union", """
SELECT row_number() OVER (ORDER BY f, k) AS seq, content FROM (
  SELECT 0 AS f, n_nationkey AS k, concat_ws(',', n_nationkey, n_name, n_regionkey) AS content FROM nation
  UNION ALL SELECT 1, r_regionkey, concat_ws(',', r_regionkey, r_name) FROM region)""")
def sequential_union(spark: SparkSession, d: str) -> DataFrame:
    nation = _file(_table(spark, d, "nation"), ["n_nationkey"], _csv("n_nationkey", "n_name", "n_regionkey"), 0)
    region = _file(_table(spark, d, "region"), ["r_regionkey"], _csv("r_regionkey", "r_name"), 1)
    return merge.numbered(merge.sequential(nation.union(region)), merge.ORDER).select("seq", "content")


def _interleaved(chunk: int) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        a = _file(_table(spark, d, "customer"), ["c_custkey"], _csv("c_custkey", "c_name"), 0)
        b = _file(_table(spark, d, "supplier"), ["s_suppkey"], _csv("s_suppkey", "s_name"), 1)
        return merge.numbered(merge.interleaved(a.union(b), chunk), merge.ORDER).select("seq", "content")

    return run


for _chunk in (1, 3):
    query(f"interleave_c{_chunk}", f"""
SELECT row_number() OVER (ORDER BY (n - 1) // {_chunk}, f, (n - 1) % {_chunk}) AS seq, content FROM (
  SELECT 0 AS f, row_number() OVER (ORDER BY c_custkey) AS n, concat_ws(',', c_custkey, c_name) AS content FROM customer
  UNION ALL SELECT 1, row_number() OVER (ORDER BY s_suppkey), concat_ws(',', s_suppkey, s_name) FROM supplier)""")(_interleaved(_chunk))


# ---- joins -----------------------------------------------------------------
def _customers(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "customer").select(F.col("c_custkey").alias("line_no"), F.array(F.col("c_custkey").cast("string"), "c_name", "c_mktsegment").alias("fields"))


def _orders(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "orders").select(F.col("o_orderkey").alias("line_no"), F.array(F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string"), "o_orderstatus").alias("fields"))


def _joined(how: str, customers_left: bool = True) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        c, o = _customers(spark, d), _orders(spark, d)
        rows = join.joined(c, o, 0, 1, how, 3, 3) if customers_left else join.joined(o, c, 1, 0, how, 3, 3)
        return rows.select("left_no", "right_no", text.csv_line(F.col("fields")).alias("content"))

    return run


_C = "concat_ws(',', c_custkey, c_name, c_mktsegment)"
_O = "concat_ws(',', o_orderkey, o_custkey, o_orderstatus)"
query("join_inner", f"SELECT c_custkey AS left_no, o_orderkey AS right_no, {_C} || ',' || {_O} AS content FROM customer JOIN orders ON c_custkey = o_custkey")(_joined("inner"))


def _outer(how: str, customers_left: bool) -> Query:
    """Some customers and orders have keys that the other side lacks, and some are
    too short to have a key."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        c, o = _table(spark, d, "customer"), _table(spark, d, "orders")
        key = F.when(F.col("c_custkey") % 7 == 0, F.concat(F.lit("x"), F.col("c_custkey").cast("string"))).otherwise(F.col("c_custkey").cast("string"))
        c = c.select(F.col("c_custkey").alias("line_no"), F.when(F.col("c_custkey") % 11 == 0, F.array("c_name")).otherwise(F.array(F.col("c_name"), key, F.col("c_mktsegment"))).alias("fields"))
        key, number = F.when(F.col("o_orderkey") % 17 == 0, F.concat(F.lit("y"), F.col("o_custkey").cast("string"))).otherwise(F.col("o_custkey").cast("string")), F.col("o_orderkey").cast("string")
        o = o.select(F.col("o_orderkey").alias("line_no"), F.when(F.col("o_orderkey") % 13 == 0, F.array(number)).otherwise(F.array(number, key, F.col("o_orderstatus"))).alias("fields"))
        rows = join.joined(*((c, o) if customers_left else (o, c)), 1, 1, how, 3, 3)
        return rows.select("left_no", "right_no", text.csv_line(F.col("fields")).alias("content"))

    return run


_OUTER = """WITH c AS (SELECT c_custkey AS no, k, CASE WHEN k IS NULL THEN c_name ELSE concat_ws(',', c_name, k, c_mktsegment) END AS line
  FROM (SELECT *, CASE WHEN c_custkey % 11 = 0 THEN NULL WHEN c_custkey % 7 = 0 THEN 'x' || c_custkey ELSE c_custkey::VARCHAR END AS k FROM customer)),
o AS (SELECT o_orderkey AS no, k, CASE WHEN k IS NULL THEN o_orderkey::VARCHAR ELSE concat_ws(',', o_orderkey, k, o_orderstatus) END AS line
  FROM (SELECT *, CASE WHEN o_orderkey % 13 = 0 THEN NULL WHEN o_orderkey % 17 = 0 THEN 'y' || o_custkey ELSE o_custkey::VARCHAR END AS k FROM orders))
SELECT l.no AS left_no, r.no AS right_no, coalesce(l.line, ',,') || ',' || coalesce(r.line, ',,') AS content FROM """
for _name, _how, _left, _sql in [
    ("join_left", "left", True, "c l LEFT JOIN o r ON l.k = r.k"), ("join_right", "right", False, "o l RIGHT JOIN c r ON l.k = r.k"), ("join_full", "full", False, "o l FULL JOIN c r ON l.k = r.k"),
    ("join_right_observed", "right_anti", False, "o l RIGHT JOIN c r ON l.k = r.k WHERE l.no IS NULL"),
]:
    query(_name, _OUTER + _sql)(_outer(_how, _left))


@query("join_ragged", """
SELECT n_nationkey::BIGINT AS left_no, r_regionkey::BIGINT AS right_no, concat_ws(',', n_name, n_regionkey, r_regionkey, r_name) AS content
FROM nation JOIN region ON n_regionkey = r_regionkey WHERE length(n_name) % 2 = 0""")
def join_ragged(spark: SparkSession, d: str) -> DataFrame:
    """Nations of names of odd length have no second field and so no key."""
    n = _table(spark, d, "nation")
    fields = F.when(F.length("n_name") % 2 == 0, F.array("n_name", F.col("n_regionkey").cast("string"))).otherwise(F.array("n_name"))
    left = n.select(F.col("n_nationkey").cast("long").alias("line_no"), fields.alias("fields"))
    right = _table(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("line_no"), F.array(F.col("r_regionkey").cast("string"), "r_name").alias("fields"))
    return join.joined(left, right, 1, 0).select("left_no", "right_no", text.csv_line(F.col("fields")).alias("content"))


@query("join_then_filter", f"""
SELECT c_custkey AS left_no, o_orderkey AS right_no, content FROM (SELECT *, {_C} || ',' || {_O} AS content FROM customer JOIN orders ON c_custkey = o_custkey)
WHERE regexp_matches(content, 'BUILD.*,F') AND NOT contains(content, 'MACHINERY')""")
def join_then_filter(spark: SparkSession, d: str) -> DataFrame:
    spec = FilterSpec(include=("BUILD*,F",), exclude=("MACHINERY",))
    return filters.filtered(_joined("inner")(spark, d), spec)


# ---- timestamps ------------------------------------------------------------
def _log_lines(spark: SparkSession, d: str) -> DataFrame:
    ms = F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS")
    a = _file(_table(spark, d, "events"), ["event_id"], F.concat(ms, F.lit(" [INFO] "), "event_type"), 0)
    b = _file(_table(spark, d, "orders"), ["o_orderkey"], F.concat(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z order "), F.col("o_orderkey").cast("string")), 1)
    return a.union(b)


@query("ts_sort_iso", """
SELECT row_number() OVER (ORDER BY (epoch_us(ts) // 1000), f, k) AS seq, content FROM (
  SELECT 0 AS f, event_id AS k, date_trunc('millisecond', ts) AS ts, strftime(ts, '%Y-%m-%d %H:%M:%S.%g') || ' [INFO] ' || event_type AS content FROM events
  UNION ALL SELECT 1, o_orderkey, o_orderdate, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || 'Z order ' || o_orderkey FROM orders)""")
def ts_sort_iso(spark: SparkSession, d: str) -> DataFrame:
    placed = merge.timestamp_sorted(_log_lines(spark, d), TimestampSpec(kind="iso8601"))
    return merge.numbered(placed, merge.ORDER).select("seq", "content")


def _stamps(render: str, kind: str, **more) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        line = F.expr(render)
        return _table(spark, d, "events").select("event_id", F.unix_millis(timestamp_of(line, kind, **more)).alias("millis"))

    return run


query("ts_unix", "SELECT event_id, (epoch_us(ts) // 1000) // 1000 * 1000 AS millis FROM events")(_stamps("concat('at ', unix_seconds(cast(ts as timestamp)), ' ok')", "unix"))
query("ts_unix_ms", "SELECT event_id, (epoch_us(ts) // 1000) AS millis FROM events")(_stamps("concat(unix_millis(cast(ts as timestamp)), ' ok')", "unix"))
query("ts_unix_observed", "SELECT event_id, (epoch_us(ts) // 1000) // 1000 * 1000 AS millis FROM events")(_stamps("concat(unix_millis(cast(ts as timestamp)), ' ok')", "unix", epoch_ms=False))
query("ts_rfc", "SELECT event_id, (epoch_us(ts) // 1000) // 1000 * 1000 AS millis FROM events")(_stamps("date_format(ts, \"'Date: 'EEE, dd MMM yyyy HH:mm:ss' +0200'\")", "rfc2822"))
query("ts_rfc_zone", "SELECT event_id, ((epoch_us(ts) // 1000) // 1000 - 7200) * 1000 AS millis FROM events")(_stamps("date_format(ts, \"EEE, dd MMM yyyy HH:mm:ss' +0200'\")", "rfc2822", honor_tz=True))
query("ts_auto", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN (epoch_us(ts) // 1000) // 1000 * 1000 WHEN 1 THEN (epoch_us(ts) // 1000) ELSE epoch_ms(date_trunc('day', ts)) END AS millis FROM events")(
    _stamps("case event_id % 3 when 0 then concat('2001-01-01 ', unix_seconds(cast(ts as timestamp))) when 1 then date_format(ts, \"'x 'yyyy-MM-dd'T'HH:mm:ss.SSS'+01:00'\") else date_format(ts, 'yyyy-MM-dd') end", "auto"))
query("ts_column", "SELECT event_id, (epoch_us(ts) // 1000) AS millis FROM events")(_stamps("concat(event_type, '| ', date_format(ts, 'yyyy-MM-dd HH:mm:ss.SSS'), ' |', user_id)", "iso8601", column=1, delimiter="|"))
query("ts_custom", "SELECT event_id, epoch_ms(date_trunc('minute', ts)) AS millis FROM events")(_stamps("date_format(ts, 'yyyy/MM/dd HH:mm')", "custom", pattern="%d/%m/%Y"))


@query("ts_normalise_overflow", """
SELECT l_orderkey, l_linenumber, epoch_ms((make_date(2024, 1, 1) + to_months(l_linenumber::INT + 8) + to_days(l_quantity::INT - 1) + to_hours(l_linenumber::INT + 20))::TIMESTAMP) AS millis FROM lineitem""")
def ts_normalise_overflow(spark: SparkSession, d: str) -> DataFrame:
    line = F.concat(F.lit("2024-"), (F.col("l_linenumber") + 9).cast("string"), F.lit("-"), F.col("l_quantity").cast("int").cast("string"), F.lit(" "), (F.col("l_linenumber") + 20).cast("string"), F.lit(":00:00"))
    return _table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.unix_millis(timestamp_of(line, "iso8601")).alias("millis"))


@query("ts_carry_forward", """
SELECT conv_id, turn, last_value(CASE WHEN turn % 3 = 1 THEN 1700000000000 + 60000 * (conv_id + turn) END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn) AS millis FROM conversations""")
def ts_carry_forward(spark: SparkSession, d: str) -> DataFrame:
    c = _table(spark, d, "conversations").select(F.col("conv_id").alias("file_idx"), (F.col("turn") + 1).alias("line_no"), F.when(F.col("turn") % 3 == 1, F.timestamp_seconds(1700000000 + 60 * (F.col("conv_id") + F.col("turn")))).alias("ts"))
    out = merge.carried_forward(c)
    return out.select(F.col("file_idx").alias("conv_id"), (F.col("line_no") - 1).alias("turn"), F.unix_millis("eff_ts").alias("millis"))


# ---- duplicates ------------------------------------------------------------
def _deduplicated(spec: DedupSpec) -> Query:
    return lambda spark, d: dedup.deduplicated(_doc_lines(spark, d), spec, ["doc_id", "line_no"])


_FIRST = "SELECT doc_id, line_no, content FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY doc_id {way}, line_no {way}) AS n FROM lines) WHERE n = 1"
_ASCII_LOWER = "translate(content, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
query("dedup_line", f"WITH {_LINES} {_FIRST.format(key='content', way='')}")(_deduplicated(DedupSpec("line")))
_SHOUTED = "shouted AS (SELECT doc_id, line_no, CASE WHEN line_no % 3 = 0 THEN translate(content, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') ELSE content END AS content FROM lines)"


@query("dedup_line_ci", f"WITH {_LINES}, {_SHOUTED} {_FIRST.format(key=_ASCII_LOWER, way='').replace('FROM lines', 'FROM shouted')}")
def dedup_line_ci(spark: SparkSession, d: str) -> DataFrame:
    """Every third line is in capitals."""
    shouted = F.when(F.col("line_no") % 3 == 0, text.ascii_upper(F.col("content"))).otherwise(F.col("content"))
    return dedup.deduplicated(_doc_lines(spark, d).withColumn("content", shouted), DedupSpec("line", ignore_case=True), ["doc_id", "line_no"])


query("dedup_last", f"WITH {_LINES} {_FIRST.format(key='content', way='DESC')}")(_deduplicated(DedupSpec("line", "last")))
query("dedup_last_in_place", f"""WITH {_LINES}, k AS (SELECT *, {_ASCII_LOWER} AS key FROM lines)
SELECT min(doc_id * 1000000 + line_no) // 1000000 AS doc_id, min(doc_id * 1000000 + line_no) % 1000000 AS line_no, arg_max(content, doc_id * 1000000 + line_no) AS content FROM k GROUP BY key""")(_deduplicated(DedupSpec("line", "last_in_place", True)))


@query("dedup_columns", """
SELECT seq, content FROM (SELECT l_orderkey * 10 + l_linenumber AS seq, concat_ws(',', l_orderkey, l_returnflag, l_linestatus, l_linenumber) AS content,
  row_number() OVER (PARTITION BY l_returnflag, l_linestatus, l_linenumber ORDER BY l_orderkey * 10 + l_linenumber) AS n FROM lineitem) WHERE n = 1""")
def dedup_columns(spark: SparkSession, d: str) -> DataFrame:
    lines = _table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), _csv("l_orderkey", "l_returnflag", "l_linestatus", "l_linenumber").alias("content"))
    return dedup.deduplicated(lines, DedupSpec("columns", first=1), ["seq"])


@query("dedup_counts", f"WITH {_LINES} SELECT count(*) AS n_lines, count(DISTINCT content) AS n_unique, count(*) - count(DISTINCT content) AS n_duplicates FROM lines")
def dedup_counts(spark: SparkSession, d: str) -> DataFrame:
    return dedup.duplicate_counts(_doc_lines(spark, d), DedupSpec("line"))


# ---- filters ---------------------------------------------------------------
def _filtered(spec: FilterSpec) -> Query:
    return lambda spark, d: filters.filtered(_doc_lines(spark, d), spec)


_WHERE = f"WITH {_LINES} SELECT doc_id, line_no, content FROM lines WHERE "
query("filter_blank", _WHERE + rf"regexp_matches(content, '[^ \t\n\x0b\f\r]')")(_filtered(FilterSpec(skip_blank=True)))
query("filter_comment", _WHERE + rf"NOT regexp_matches(content, '^{_SPACE}*The')")(_filtered(FilterSpec(skip_comments=True, comment_prefix="The")))
query("filter_include", _WHERE + "regexp_matches(content, 'tion.*ing') OR contains(content, 'heit')")(_filtered(FilterSpec(include=("tion*ing", "heit"))))
query("filter_exclude", _WHERE + "NOT (regexp_matches(content, 'en.the') OR contains(content, 'License'))")(_filtered(FilterSpec(exclude=("en?the", "License"))))
query("filter_class", _WHERE + r"regexp_matches(content, 'th[aeo]nd.*er') OR content LIKE 'th[aeo]nd%er'")(_filtered(FilterSpec(include=("th[aeo]nd*er",))))
query("filter_regex", _WHERE + r"regexp_matches(content, '\d+\.\d+|@') OR contains(content, '\d+\.\d+|@')")(_filtered(FilterSpec(include=(r"re:\d+\.\d+|@",))))
query("filter_ignore_case", _WHERE + f"regexp_matches(content, '(?i)apache') OR contains({_ASCII_LOWER}, 'apache')")(_filtered(FilterSpec(include=("APACHE",), ignore_case=True)))
query("filter_custom", _WHERE + "length(content) > 200")(_filtered(FilterSpec(custom=lambda c: F.char_length(c) > 200)))


@query("merge_filter_dedup", f"""
WITH lines AS (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS content, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM conversations),
f AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, i) AS n FROM lines),
g AS (SELECT conv_id, n, content FROM f WHERE regexp_matches(content, '[^ \\t\\n\\x0b\\f\\r]') AND NOT contains(content, 'que')),
u AS (SELECT *, row_number() OVER (PARTITION BY content ORDER BY (n - 1) // 2, conv_id, (n - 1) % 2) AS k FROM g)
SELECT row_number() OVER (ORDER BY (n - 1) // 2, conv_id, (n - 1) % 2) AS seq, content FROM u WHERE k = 1""")
def merge_filter_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as files: interleaved by two lines, filtered, without repeats."""
    c = _table(spark, d, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("i", "content"))
    # A conversation's lines before a turn: added up over its turns, not its lines.
    turns = _table(spark, d, "conversations").select("conv_id", "turn", F.size(F.split("text", "\n")).cast("long").alias("n"))
    before = turns.select("conv_id", "turn", (F.sum("n").over(Window.partitionBy("conv_id").orderBy("turn")) - F.col("n")).alias("before"))
    lines = c.join(before, ["conv_id", "turn"]).select(F.col("conv_id").cast("int").alias("file_idx"), F.lit("").alias("path"), (F.col("before") + F.col("i") + 1).alias("line_no"), "content", F.lit(False).alias("is_header"))
    spec = MergeSpec(mode="interleaved", chunk=2, filter=FilterSpec(skip_blank=True, exclude=("que",)), dedup=DedupSpec("line"))
    return merge.numbered(merge.merged(lines, spec), merge.ORDER).select("seq", "content")


@query("clean_counts", f"""WITH {_LINES}, f AS (SELECT content, regexp_matches(content, '[^ \\t\\n\\x0b\\f\\r]') AND NOT contains(content, 'que') AS stays FROM lines)
SELECT count(*) AS n_in, count(*) FILTER (NOT stays) AS n_filtered, count(*) FILTER (stays) - count(DISTINCT content) FILTER (stays) AS n_duplicates, count(DISTINCT content) FILTER (stays) AS n_out FROM f""")
def clean_counts(spark: SparkSession, d: str) -> DataFrame:
    stays = filters.condition(F.col("content"), FilterSpec(skip_blank=True, exclude=("que",)))
    return dedup.cleaned_counts(_doc_lines(spark, d), stays, DedupSpec("line"))


@query("wildcard_match", _WHERE + "content LIKE 'The%tion_'")
def wildcard_match(spark: SparkSession, d: str) -> DataFrame:
    return _doc_lines(spark, d).where(F.col("content").rlike(text.wildcard("The*tion?")))


@query("pad_rows", "SELECT r_regionkey, concat_ws(',', r_regionkey, r_name) || ',,' AS content FROM region")
def pad_rows(spark: SparkSession, d: str) -> DataFrame:
    fields = F.array(F.col("r_regionkey").cast("string"), F.col("r_name"))
    return _table(spark, d, "region").select("r_regionkey", text.csv_line(text.padded(fields, 4)).alias("content"))


@query("ts_format", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN (epoch_us(ts) // 1000) % 1000 > 0 THEN strftime(ts, '.%g') ELSE '' END || 'Z' AS iso FROM events")
def ts_format(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "events").select("event_id", iso_text(F.col("ts").cast("timestamp")).alias("iso"))


# ---- fields ----------------------------------------------------------------
@query("csv_roundtrip", """
SELECT page_id, 2::BIGINT AS n_fields, true AS same, length(q(url)) + length(q(html)) + 1 AS n_chars FROM (SELECT * FROM pages)""".replace("q(url)", "CASE WHEN regexp_matches(url, '[\",\\n\\r]') THEN '\"' || replace(url, '\"', '\"\"') || '\"' ELSE url END").replace("q(html)", "CASE WHEN regexp_matches(html, '[\",\\n\\r]') THEN '\"' || replace(html, '\"', '\"\"') || '\"' ELSE html END"))
def csv_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    p = _table(spark, d, "pages").withColumn("line", _csv("url", "html")).withColumn("back", text.csv_fields(F.col("line")))
    return p.select("page_id", F.size("back").cast("long").alias("n_fields"), ((F.get("back", F.lit(0)) == F.col("url")) & (F.get("back", F.lit(1)) == F.col("html"))).alias("same"), F.char_length("line").cast("long").alias("n_chars"))


@query("csv_fields", f"""WITH {_LINES}, q AS (SELECT *, string_split(content, '"') AS p FROM lines),
c AS (SELECT *, list_transform(p, lambda x, i: CASE WHEN i % 2 = 1 THEN length(x) - length(replace(x, ',', '')) ELSE 0 END) AS commas FROM q),
e AS (SELECT *, coalesce(list_min(list_filter(range(1, len(p) + 1), lambda i: commas[i] > 0)), len(p)) AS j FROM c)
SELECT doc_id, line_no, CASE WHEN content = '' THEN 0 ELSE 1 + list_sum(commas) END::BIGINT AS n_fields, CASE WHEN content <> '' THEN array_to_string(
  list_transform(p[1:j], lambda x, i: CASE WHEN i = j AND commas[i] > 0 THEN split_part(x, ',', 1) WHEN i % 2 = 1 AND i > 1 AND i < j AND x = '' THEN '"' ELSE x END), '') END AS first FROM e""")
def csv_fields(spark: SparkSession, d: str) -> DataFrame:
    """Of every line. In SQL, parts between quotes are inside quotes by turns, and an
    empty part outside them stands for a doubled quote."""
    lines = _doc_lines(spark, d).withColumn("f", text.csv_fields(F.col("content")))
    return lines.select("doc_id", "line_no", F.size("f").cast("long").alias("n_fields"), text.field(F.col("f"), 0).alias("first"))


@query("column_profile", r"""
WITH c AS (SELECT 0 AS col, 'key' AS name, o_orderkey::VARCHAR AS v FROM orders UNION ALL SELECT 1, 'status', o_orderstatus FROM orders
  UNION ALL SELECT 2, 'priority', CASE WHEN o_orderkey % 5 = 0 THEN 'n/a' ELSE o_orderpriority END FROM orders UNION ALL SELECT 3, 'col_3', strftime(o_orderdate, '%Y-%m-%d') FROM orders),
s AS (SELECT *, lower(trim(v)) IN ('', 'null', 'nil', 'none', 'na', 'n/a', 'undefined', '?') AS nul FROM c)
SELECT col::INT AS col, name, count(*) FILTER (nul) AS n_null, coalesce(min(strlen(v)) FILTER (NOT nul), 0)::INT AS min_length, coalesce(max(strlen(v)) FILTER (NOT nul), 0)::INT AS max_length,
  coalesce(bool_and(regexp_matches(trim(v), '^[+-]?(\d+\.?\d*|\.\d*)([eE][+-]?\d*)?$')) FILTER (NOT nul), true) AS all_numeric,
  coalesce(bool_and(lower(trim(v)) IN ('true', 'false', 'yes', 'no', '1', '0', 'on', 'off')) FILTER (NOT nul), true) AS all_boolean,
  coalesce(bool_and(strlen(v) >= 6 AND regexp_matches(v, '\d{4}[-/]\d{1,2}[-/]\d{1,2}|\d{1,2}[-/]\d{1,2}[-/]\d{2,4}|\d{1,2}:\d{1,2}|\d{8}')) FILTER (NOT nul), true) AS all_datetime
FROM s GROUP BY col, name""")
def column_profile(spark: SparkSession, d: str) -> DataFrame:
    priority = F.when(F.col("o_orderkey") % 5 == 0, "n/a").otherwise(F.col("o_orderpriority"))
    rows = _table(spark, d, "orders").select(F.array(F.col("o_orderkey").cast("string"), "o_orderstatus", priority, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("fields"))
    return profile.column_profile(rows, 4, ["key", "status", "priority"])


@query("classify_fields", r"""
WITH c AS (SELECT 'price' AS k, o_orderkey AS id, CAST(o_totalprice AS DECIMAL(18,2))::VARCHAR AS v FROM orders UNION ALL SELECT 'date', o_orderkey, strftime(o_orderdate, '%Y/%m/%d') FROM orders
  UNION ALL SELECT 'flag', l_orderkey * 10 + l_linenumber, CASE l_returnflag WHEN 'N' THEN ' No ' WHEN 'R' THEN '' ELSE 'x' END FROM lineitem)
SELECT k, count(*) FILTER (regexp_matches(trim(v), '^[+-]?(\d+\.?\d*|\.\d*)([eE][+-]?\d*)?$')) AS n_numeric, count(*) FILTER (lower(trim(v)) IN ('true', 'false', 'yes', 'no', '1', '0', 'on', 'off')) AS n_boolean,
  count(*) FILTER (strlen(v) >= 6 AND regexp_matches(v, '\d{4}[-/]\d{1,2}[-/]\d{1,2}|\d{1,2}[-/]\d{1,2}[-/]\d{2,4}|\d{1,2}:\d{1,2}|\d{8}')) AS n_datetime,
  count(*) FILTER (lower(trim(v)) IN ('', 'null', 'nil', 'none', 'na', 'n/a', 'undefined', '?')) AS n_null FROM c GROUP BY k""")
def classify_fields(spark: SparkSession, d: str) -> DataFrame:
    o, li = _table(spark, d, "orders"), _table(spark, d, "lineitem")
    flag = F.when(F.col("l_returnflag") == "N", " No ").when(F.col("l_returnflag") == "R", "").otherwise("x")
    rows = o.select(F.lit("price").alias("k"), F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias("v")).union(o.select(F.lit("date"), F.date_format("o_orderdate", "yyyy/MM/dd"))).union(li.select(F.lit("flag"), flag))
    out = profile.field_classes(rows, "v")
    return out.groupBy("k").agg(*(F.count_if(F.col(f"is_{c}")).alias(f"n_{c}") for c in ("numeric", "boolean", "datetime", "null")))


@query("format_detect", """SELECT * FROM (VALUES ('nation.csv', 'csv', 0.9::DOUBLE, ',', true, 3), ('region', 'tsv', 0.7, chr(9), false, 2), ('events.log', 'log', 0.9, ',', false, 0), ('props', 'json', 0.7, ',', false, 0))
AS t(name, format, confidence, delimiter, has_header, width)""")
def format_detect(spark: SparkSession, d: str) -> DataFrame:
    """What the sniffer makes of tables rendered as files (their first lines)."""
    rendered = {
        "nation.csv": [["id,name,region"], _table(spark, d, "nation").select("n_nationkey", _csv("n_nationkey", "n_name", "n_regionkey"))],
        "region": [[], _table(spark, d, "region").select("r_regionkey", F.concat_ws("\t", F.col("r_regionkey").cast("string"), "r_name"))],
        "events.log": [[], _table(spark, d, "events").select("event_id", F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" [INFO] "), "event_type"))],
        "props": [[], _table(spark, d, "events").select("event_id", "props")],
    }
    rows = []
    for name, (head, df) in rendered.items():
        p = sniff.profile_lines(head + [r[1] for r in df.orderBy(df.columns[0]).limit(sniff.SAMPLE).collect()], name)
        rows.append((name, p.format, p.confidence, p.delimiter, p.has_header, p.width))
    return spark.createDataFrame(rows, "name string, format string, confidence double, delimiter string, has_header boolean, width int")


# ---- bytes and strings -----------------------------------------------------
@query("encode_utf16_len", r"SELECT doc_id, (2 * length(text) + 2 * len(regexp_extract_all(text, '[\x{10000}-\x{10FFFF}]')))::BIGINT AS n_bytes, true AS same FROM documents")
def encode_utf16_len(spark: SparkSession, d: str) -> DataFrame:
    out = _table(spark, d, "documents").withColumn("b", encodings.encoded(F.col("text"), "utf-16le"))
    return out.select("doc_id", F.octet_length("b").cast("long").alias("n_bytes"), (encodings.decoded(F.col("b"), "utf-16le") == F.col("text")).alias("same"))


@query("utf8_valid", "SELECT doc_id, CASE WHEN text IS NOT NULL THEN true END AS valid, CASE WHEN text IS NOT NULL THEN false END AS cut_valid FROM documents")
def utf8_valid(spark: SparkSession, d: str) -> DataFrame:
    """Every text: valid, and not so with a lone lead byte; nulls for null."""
    b = F.col("text").cast("binary")
    return _table(spark, d, "documents").select("doc_id", encodings.is_valid_utf8(b).alias("valid"), encodings.is_valid_utf8(F.concat(b, F.lit(b"\xc3"))).alias("cut_valid"))


@query("gbk_roundtrip")
def gbk_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    out = _table(spark, d, "documents").withColumn("b", encodings.encoded(F.col("text"), "gbk"))
    return out.select("doc_id", F.octet_length("b").alias("n_bytes"), F.crc32("b").alias("crc32"), encodings.decoded(F.col("b"), "gbk").alias("back"))


@query("crc32_docs", """
WITH tab AS (SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n::BIGINT)) AS t),
d AS (SELECT doc_id, hex(text) AS h, strlen(text) AS n FROM documents)
SELECT doc_id, xor(list_reduce(list_transform(range(n), lambda i: ('0x' || substr(h, (2 * i + 1)::INT, 2))::BIGINT), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295) AS crc32 FROM d, tab""")
def crc32_docs(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "documents").select("doc_id", text.crc32_of(F.col("text").cast("binary")).alias("crc32"))


@query("byte_totals", "SELECT count(*) AS n_files, sum(strlen(text))::BIGINT AS n_bytes, sum((strlen(text) + 1023) // 1024)::BIGINT AS n_chunks FROM documents")
def byte_totals(spark: SparkSession, d: str) -> DataFrame:
    return merge.byte_totals(_table(spark, d, "documents").select(F.col("text").cast("binary").alias("content")), 1024)


@query("occurrences", "SELECT doc_id, (length(text) - length(replace(text, 'tion', ''))) // 4 AS n, replace(text, 'the', 'THE') AS replaced FROM documents")
def occurrences(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return _table(spark, d, "documents").select("doc_id", text.occurrences(t, "tion").alias("n"), text.replace_all(t, "the", "THE").alias("replaced"))


@query("split_join", "SELECT doc_id, len(string_split(text, '. '))::BIGINT AS n_parts, len(list_filter(string_split(text, ' '), lambda x: x <> ''))::BIGINT AS n_full, array_to_string(string_split(text, '. '), '|') AS joined FROM documents")
def split_join(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return _table(spark, d, "documents").select("doc_id", F.size(text.split_literal(t, ". ")).cast("long").alias("n_parts"), F.size(text.split_literal(t, " ", keep_empty=False)).cast("long").alias("n_full"), text.join_parts(text.split_literal(t, ". "), "|").alias("joined"))


@query("trim_and_case", rf"WITH {_LINES} SELECT doc_id, line_no, regexp_replace(regexp_replace(content, '^{_SPACE}+', ''), '{_SPACE}+$', '') AS trimmed, translate(content, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') AS upper FROM lines")
def trim_and_case(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("content")
    return _doc_lines(spark, d).select("doc_id", "line_no", text.trim_space(c).alias("trimmed"), text.ascii_upper(c).alias("upper"))


@query("path_parts", r"""SELECT page_id, regexp_extract(url, '^(.*)/[^/]*$', 1) AS directory, regexp_extract(url, '([^/]*)$', 1) AS name, regexp_extract(regexp_extract(url, '([^/]*)$', 1), '(\.[^.]*)$', 1) AS extension FROM pages""")
def path_parts(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("url")
    return _table(spark, d, "pages").select("page_id", text.directory(u).alias("directory"), text.file_name(u).alias("name"), text.extension(u).alias("extension"))
