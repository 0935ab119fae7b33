"""Row sets of Spark and DuckDB as sorted text."""

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def oracle(sql: str, folder: str) -> pd.DataFrame:
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return c.execute(sql).df()


def plain(df: pd.DataFrame) -> pd.DataFrame:
    def text(v):
        if v is None or v is pd.NaT or (isinstance(v, float) and v != v):
            return "-"
        return str(int(v)) if isinstance(v, float) and v == int(v) else str(v)

    cols = sorted(df.columns)
    return df[cols].map(text).sort_values(cols).reset_index(drop=True)
