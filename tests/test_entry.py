import subprocess
import sys

import __spark_entry__


def test_contract(spark):
    assert __spark_entry__.entry(spark).count() > 0
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert sql.keys() <= queries.keys() and all(map(callable, queries.values()))


def test_works_without_the_subpackage():
    code = "import sys; sys.modules['sluice.llm'] = None; import __spark_entry__ as e; assert e.queries() and not any(k.startswith('op1_') for k in e.queries())"
    subprocess.run([sys.executable, "-c", code], check=True)
