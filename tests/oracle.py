import glob
import os

import duckdb


def run(sql, sf_dir):
    """Rows of the SQL over the tables, as sorted tuples by sorted column names."""
    c = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        c.sql(f"create view {name} as select * from read_parquet('{path if os.path.isfile(path) else path + '/*.parquet'}')")
    found = c.sql(sql)
    order = sorted(range(len(found.columns)), key=lambda i: found.columns[i])
    return sorted(found.columns), sorted((tuple(r[i] for i in order) for r in found.fetchall()), key=repr)


def rows(df):
    names = sorted(df.columns)
    return names, sorted((tuple(r) for r in df.select(*names).collect()), key=repr)
