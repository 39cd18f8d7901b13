"""Quality rules with adaptive thresholds, in DataFrame operations only.

Four whole-number measures of each text (mean word length in hundredths, symbols
per 1000 words, repeated lines and words in repeated windows in thousandths) go
into quantile sketches: counts by (language, source, measure, bucket), where
buckets are exact up to 127 and above that keep a value's leading seven bits, so
a quantile is off by less than 1/64. Sketches merge by adding counts: a source
with fewer than MIN_ROWS rows in a language uses the language's merged sketch,
a small language the merged sketch of all. Thresholds are the quartiles widened
by SPREAD interquartile ranges and a least slack, joined to the documents.

Aggregation is partial before each shuffle, so a source with most rows costs no
more than its buckets. Null texts have no words and fail the base rules. Null
languages and sources are groups of their own. No rows: no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, kept

MIN_ROWS, SPREAD = 100, 3
#: Least distance of a threshold from its quartile, by measure.
SLACK = {"mean_word": 50, "symbol_rate": 100, "dup_line_rate": 300, "repeat_rate": 200}
#: Measures that fail below a threshold too.
TWO_SIDED = ("mean_word",)


def bucket(v: Column) -> Column:
    """The bucket of a whole number from 0 on."""
    drop = F.length(F.bin(v)) - 7
    return F.when(v < 128, v).otherwise(drop * 64 + F.expr("shiftright(value, length(bin(value)) - 7)")).cast("long")


def floor_of(b: Column) -> Column:
    """The least number in a bucket."""
    return F.when(b < 128, b).otherwise(F.expr("shiftleft(bucket % 64 + 64, cast((bucket - 64) div 64 as int))")).cast("long")


def measured(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", window: int = 3) -> DataFrame:
    """doc_id, lang, source and the counts n_words, word_chars, n_symbols,
    n_lines, n_dup_lines, n_repeat_words."""
    space = f"[{SPACE}]"
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), text.alias("text"))
    rows = rows.select(
        "doc_id", "lang", "source",
        F.array_remove(F.split("text", f"{space}+"), "").alias("words"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike(f"[^{SPACE}]")).alias("lines"),
        F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
    )
    # Hashes of the windows; sorted, equal ones are neighbours.
    at = F.transform(F.sequence(F.lit(0), F.size("words") - window), lambda i: F.xxhash64(*(F.get("words", i + k) for k in range(window))))
    rows = rows.withColumn("windows", F.when(F.size("words") >= window, at).otherwise(F.array().cast("array<bigint>")))
    rows = rows.withColumn("sorted", F.sort_array("windows"))
    rows = rows.withColumn("repeats", F.exists(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("sorted") - 1)), lambda k: F.get("sorted", k) == F.get("sorted", k - 1)))
    placed = F.sort_array(F.transform("windows", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    rows = rows.withColumn("placed", F.when(F.col("repeats"), placed))
    same = lambda e, j: (e["h"] == F.get("placed", j - 1)["h"]) | (e["h"] == F.get("placed", j + 1)["h"])
    found = F.filter(F.transform("placed", lambda e, j: F.when(F.coalesce(same(e, j), F.lit(False)), e["i"]).otherwise(-1)), lambda i: i >= 0)
    rows = rows.withColumn("starts", F.sort_array(found))
    own = F.transform("starts", lambda x, j: F.least(F.lit(window), F.coalesce(F.get("starts", j + 1) - x, F.lit(window))))
    return rows.select(
        "doc_id", "lang", "source",
        F.size("words").cast("long").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        "n_symbols",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(F.aggregate(own, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def rates(rows: DataFrame) -> DataFrame:
    """Adds base_failed and the measures (null for texts that fail the base rules)."""
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    per = lambda n, scale, of: F.when(~failed, F.expr(f"{scale} * {n} div {of}"))
    return rows.withColumns({
        "base_failed": failed, "mean_word": per("word_chars", 100, "n_words"), "symbol_rate": per("n_symbols", 1000, "n_words"),
        "dup_line_rate": per("n_dup_lines", 1000, "n_lines"), "repeat_rate": per("n_repeat_words", 1000, "n_words"),
    })


def sketches(rows: DataFrame) -> DataFrame:
    """Quantile sketches: lang, source, measure, bucket, n."""
    each = rows.where(~F.col("base_failed")).select("lang", "source", F.explode(F.create_map(*(x for m in SLACK for x in (F.lit(m), F.col(m))))).alias("measure", "value"))
    return each.groupBy("lang", "source", "measure", bucket(F.col("value")).alias("bucket")).agg(F.count("*").alias("n"))


def merged(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches of coarser groups: counts added up."""
    return sketch.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))


def quartiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """keys, measure, rows, q25 and q75 of each group."""
    by = Window.partitionBy(*keys, "measure")
    ranked = sketch.withColumn("upto", F.sum("n").over(by.orderBy("bucket"))).withColumn("rows", F.sum("n").over(by)).withColumn("value", floor_of(F.col("bucket")))
    at = lambda k: F.min(F.when(4 * F.col("upto") >= k * F.col("rows"), F.col("value")))
    return ranked.groupBy(*keys, "measure").agg(F.max("rows").alias("rows"), at(1).alias("q25"), at(3).alias("q75"))


def thresholds(sketch: DataFrame) -> DataFrame:
    """lang, source, and low_m and high_m for each measure m."""
    own = quartiles(sketch, ["lang", "source"]).alias("o")
    lang = quartiles(merged(sketch, ["lang"]), ["lang"]).alias("l")
    whole = quartiles(merged(sketch, []), []).alias("w")
    pick = lambda q: F.when(F.col("o.rows") >= MIN_ROWS, F.col(f"o.{q}")).when(F.col("l.rows") >= MIN_ROWS, F.col(f"l.{q}")).otherwise(F.col(f"w.{q}"))
    both = own.join(lang, F.col("o.lang").eqNullSafe(F.col("l.lang")) & (F.col("o.measure") == F.col("l.measure"))).join(whole, F.col("o.measure") == F.col("w.measure"))
    rows = both.select("o.lang", "o.source", "o.measure", pick("q25").alias("q25"), pick("q75").alias("q75"))
    spread = SPREAD * (F.col("q75") - F.col("q25"))
    of = lambda m, x: F.max(F.when(F.col("measure") == m, x))
    columns = [of(m, F.col("q75") + spread + s).alias(f"high_{m}") for m, s in SLACK.items()] + [of(m, F.col("q25") - spread - SLACK[m]).alias(f"low_{m}") for m in TWO_SIDED]
    return rows.groupBy("lang", "source").agg(*columns)


def judged(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """One row per row of df: the id, the counts, base_failed and kept."""
    rows = kept(rates(measured(df, id_col, text_col, lang_col, source_col)), "measures")
    limits = kept(thresholds(kept(sketches(rows), "sketches")), "thresholds")
    limits = limits.select(F.col("lang").alias("l"), F.col("source").alias("s"), *(c for c in limits.columns if "_" in c))
    inside = F.lit(True)
    for m in SLACK:
        inside = inside & (F.col(m) <= F.col(f"high_{m}"))
    for m in TWO_SIDED:
        inside = inside & (F.col(m) >= F.col(f"low_{m}"))
    both = rows.join(limits, F.col("lang").eqNullSafe(F.col("l")) & F.col("source").eqNullSafe(F.col("s")), "left")
    return both.select(F.col("doc_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.coalesce(~F.col("base_failed") & inside, F.lit(False)).alias("kept"))


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_VALUES = {"mean_word": "100 * word_chars // n_words", "symbol_rate": "1000 * n_symbols // n_words", "dup_line_rate": "1000 * n_dup_lines // n_lines", "repeat_rate": "1000 * n_repeat_words // n_words"}


def _quartiles_sql(name: str, keys: str) -> str:
    by = f"{keys}, measure" if keys else "measure"
    return f"""{name} AS (SELECT {by}, max(rows) AS rows, min(CASE WHEN 4 * upto >= rows THEN value END) AS q25, min(CASE WHEN 4 * upto >= 3 * rows THEN value END) AS q75 FROM (
  SELECT *, CASE WHEN bucket < 128 THEN bucket ELSE (bucket % 64 + 64) << ((bucket - 64) // 64) END AS value, sum(n) OVER (PARTITION BY {by} ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY {by}) AS rows
  FROM (SELECT {by}, bucket, sum(n) AS n FROM sketch GROUP BY {by}, bucket)) GROUP BY {by})"""


#: DuckDB SQL for judged() over the table documents.
ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, {_WORDS} AS w, row_number() OVER () AS r FROM documents),
lines AS (SELECT r, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM d),
shingles AS (SELECT r, i, w[i:i + 2] AS s FROM d, unnest(range(1, len(w) - 1)) AS t(i)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS n FROM shingles) WHERE n > 1),
repeated AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, range(3) AS t(k) GROUP BY r),
counts AS (SELECT doc_id, lang, source, d.r, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
  len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM d JOIN lines USING (r) LEFT JOIN repeated USING (r)),
rated AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counts),
measures AS ({" UNION ALL ".join(f"SELECT r, lang, source, '{m}' AS measure, CAST({v} AS BIGINT) AS value FROM rated WHERE NOT base_failed" for m, v in _VALUES.items())}),
sketch AS (SELECT lang, source, measure, CASE WHEN value < 128 THEN value ELSE (length(bin(value)) - 7) * 64 + (value >> (length(bin(value)) - 7)) END AS bucket, count(*) AS n FROM measures GROUP BY ALL),
{_quartiles_sql("own", "lang, source")}, {_quartiles_sql("by_lang", "lang")}, {_quartiles_sql("whole", "")},
chosen AS (SELECT o.lang, o.source, o.measure,
  CASE WHEN o.rows >= {MIN_ROWS} THEN o.q25 WHEN l.rows >= {MIN_ROWS} THEN l.q25 ELSE w.q25 END AS q25,
  CASE WHEN o.rows >= {MIN_ROWS} THEN o.q75 WHEN l.rows >= {MIN_ROWS} THEN l.q75 ELSE w.q75 END AS q75
  FROM own o JOIN by_lang l ON o.lang IS NOT DISTINCT FROM l.lang AND o.measure = l.measure JOIN whole w ON o.measure = w.measure),
outside AS (SELECT DISTINCT m.r FROM measures m JOIN chosen c ON m.lang IS NOT DISTINCT FROM c.lang AND m.source IS NOT DISTINCT FROM c.source AND m.measure = c.measure
  WHERE value > q75 + {SPREAD} * (q75 - q25) + CASE m.measure {" ".join(f"WHEN '{m}' THEN {s}" for m, s in SLACK.items())} END
  OR m.measure IN ({", ".join(f"'{m}'" for m in TWO_SIDED)}) AND value < q25 - {SPREAD} * (q75 - q25) - CASE m.measure {" ".join(f"WHEN '{m}' THEN {SLACK[m]}" for m in TWO_SIDED)} END)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND r NOT IN (SELECT r FROM outside) AS kept FROM rated
"""
