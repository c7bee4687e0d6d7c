import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def spark():
    from quern.session import session

    s = session("tests", "local[8]", 8, **{"spark.ui.showConsoleProgress": "false", "spark.driver.memory": "6g"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    """Run SQL over the tables of a data folder; rows as dicts, columns by name."""
    import duckdb

    def run(sql: str, sf_dir: str) -> list[dict]:
        con = duckdb.connect()
        con.sql("SET TimeZone='UTC'")
        for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
        r = con.sql(sql)
        return [dict(zip(r.columns, x)) for x in r.fetchall()]

    return run
