import re

import duckdb
import pyarrow as pa
from pyspark.sql import functions as F

from sluice.llm import quality_rules as qr

SCHEMA = "doc_id long, text string, lang string, source string, words string, n long"


def counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = {}
    for i in range(len(words) - 2):
        windows.setdefault(tuple(words[i : i + 3]), []).append(i)
    covered = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def rows():
    base = " ".join(f"word{k}" for k in range(60))
    texts = [None, "", " \n\t", "a", "a b", "a b c", "a b c a b c", "x x x x x", "l1\nl1\n\n \nl1 \n", "é# 中$ 文|\x0b\x0cz\r\n", base, base + " ##" * 40, "\n".join(["one line of text"] * 30), "very " + "longwordlongword " * 3 + base, "q " * 40000, "ab\x00c d"]
    out = [(k, t, "en" if k % 2 else None, f"s{k % 3}", None, None) for k, t in enumerate(texts)]
    out += [(100 + k, f"{base} tail{k} end{k % 7}." + "\nsame line" * (k % 4), "en", "big", None, None) for k in range(150)]
    return [*out, (100, out[-1][1], "en", "big", None, None), (None, base, None, None, None, None), (900, base + " %" * 300, "en", "big", None, None), (901, " ".join("w" * 30 + str(k) for k in range(60)), "en", "big", None, None)]


def test_counts_against_brute_force(spark):
    data = rows()
    got = qr.measured(spark.createDataFrame(data, SCHEMA)).collect()
    key = lambda x: str(x)
    assert sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got), key=key) == sorted(((i, *counts(t)) for i, t, *_ in data), key=key)


def test_verdicts_against_sql(spark):
    data = [r for r in rows() if "\x00" not in (r[1] or "")]
    got = sorted(map(str, (tuple(r) for r in qr.judged(spark.createDataFrame(data, SCHEMA)).collect())))
    documents = pa.table({c: pa.array([r[k] for r in data], t) for k, (c, t) in enumerate([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string())])})  # noqa: F841
    want = sorted(map(str, duckdb.sql(qr.ORACLE_SQL).fetchall()))
    assert got == want
    verdict = {eval(x)[0]: eval(x)[-1] for x in got}
    assert not verdict[900] and not verdict[901] and all(verdict[100 + k] for k in range(1, 150))


def test_buckets(spark):
    values = [*range(300), 1000, 4095, 4096, 123456, 2**40 + 12345]
    df = spark.createDataFrame([(v,) for v in values], "value long").withColumn("bucket", qr.bucket(F.col("value"))).withColumn("floor", qr.floor_of(F.col("bucket")))
    got = [(r.value, r.bucket, r.floor) for r in df.orderBy("value").collect()]
    assert all(f <= v < f + max(1, v // 64 + 1) for v, _, f in got)
    assert [b for _, b, _ in got] == sorted(b for _, b, _ in got)


def test_empty_table(spark):
    assert qr.judged(spark.createDataFrame([], SCHEMA)).count() == 0
