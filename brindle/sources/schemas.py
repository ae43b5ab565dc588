"""Versioned schemas of the tables, and how rows of an older version become rows of the present one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: By table: the columns that each version added, as DDL. The newest version is the last.
VERSIONS: dict[str, list[str]] = {
    "gsc_page_daily": ["tenant string, site string, date date, clicks bigint, impressions bigint, ctr double, position double", "state string, seq bigint", "page string, loaded_at timestamp_ntz"],
    "crawl_page": ["crawl_id bigint, run string, tenant string, site string, url string, depth int, status int, content_type string, bytes bigint, duration_ms bigint, redirect_chain array<string>, error string, in_sitemap boolean, facts string", "render_diff string, fetched_at timestamp_ntz"],
    "engine_answer": ["run string, prompt string, run_index int, text string, refusal string, fetch_error string", "grounding array<string>, latency_ms bigint, answered_at timestamp_ntz"],
    "brand_entity": ["id string, tenant string, name string, variants array<string>", "exclusions array<string>, version int", "is_own boolean, created_at timestamp_ntz"],
}


def version(table: str) -> int:
    return len(VERSIONS[table])


def schema(table: str, at: int | None = None) -> T.StructType:
    """The schema of a table at a version, the present one by default."""
    return T.StructType.fromDDL(", ".join(VERSIONS[table][: at or version(table)]))


def migrated(df: DataFrame, table: str) -> DataFrame:
    """Rows of any version as rows of the present one: columns that came later are null, types are those of the schema, other
    columns are dropped. A column of the first version that is missing is an error."""
    have = set(df.columns)
    missing = [f.name for f in schema(table, 1) if f.name not in have]
    if missing:
        raise ValueError(f"{table} lacks {', '.join(missing)}")
    return df.select(*((F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema(table)))
