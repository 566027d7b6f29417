"""Every query of the library by name, with the SQL that it is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestream.plans.eventlog import EVENTLOG
from lodestream.plans.more import MORE
from lodestream.plans.relational import RELATIONAL, TABLES
from lodestream.plans.sql import sql
from lodestream.sources.episodes import load


def _relational(text: str) -> Callable[[SparkSession, str], DataFrame]:
    words = set(text.replace(",", " ").replace("(", " ").replace(")", " ").split())
    used = [t for t in TABLES if t in words]
    return lambda spark, sf_dir: sql(spark, text, **{t: load(spark, sf_dir, t) for t in used})


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: _relational(v if isinstance(v, str) else v[0]) for k, v in RELATIONAL.items()}
ORACLE_SQL: dict[str, str] = {k: v if isinstance(v, str) else v[1] for k, v in RELATIONAL.items()}
QUERIES |= {k: q for k, (q, _) in (EVENTLOG | MORE).items()}
ORACLE_SQL |= {k: v for k, (_, v) in (EVENTLOG | MORE).items() if v}
