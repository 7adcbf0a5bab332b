"""SQL twins of the registered queries, run on the same tables by DuckDB."""

from __future__ import annotations


def all_sql() -> dict[str, str]:
    from ledgerspark.oracles import finance, jobs, people

    return {**finance.SQL, **jobs.SQL, **people.SQL}
