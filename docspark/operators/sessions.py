"""Agent sessions: ordered messages, session lists, handoffs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.operators.changes import latest


def messages(df: DataFrame, session: object, since=None, before=None, order: str = "asc", limit: int | None = None, session_col: str = "session", ts_col: str = "ts") -> DataFrame:
    """Messages of a session in time order; since is inclusive, before exclusive."""
    out = df.where(F.col(session_col) == session)
    if since is not None:
        out = out.where(F.col(ts_col) >= since)
    if before is not None:
        out = out.where(F.col(ts_col) < before)
    out = out.orderBy(F.col(ts_col).desc() if order == "desc" else F.col(ts_col))
    return out if limit is None else out.limit(limit)


def live_sessions(sessions: DataFrame, now_ms: int, agent: str | None = None, ttl_ms: int = 3_600_000) -> DataFrame:
    """Sessions touched within their sliding time to live."""
    out = sessions.where(F.col("touched") + ttl_ms > now_ms)
    return out if agent is None else out.where(F.col("agent") == agent)


def pinned(df: DataFrame, session: object, session_col: str = "session", ts_col: str = "ts") -> DataFrame:
    """The pinned context of a session: what is pinned and not unpinned later, oldest first. df: session, ts, key, pinned, ..."""
    rows = latest(df.where(F.col(session_col) == session), "key", ts_col)
    return rows.where("pinned").orderBy(ts_col, "key")


def data_map(df: DataFrame, session: object, session_col: str = "session", ts_col: str = "ts") -> DataFrame:
    """key, value of a session's data: the last value set under each key, without deleted ones (null)."""
    rows = latest(df.where(F.col(session_col) == session), "key", ts_col)
    return rows.where("value IS NOT NULL").select("key", "value")


def handoffs(df: DataFrame, **equal) -> DataFrame:
    """Handoffs by to, from, status, space or chain_root."""
    for column, value in equal.items():
        df = df.where(F.col(column.rstrip("_")) == value)
    return df.orderBy("chain_root", "chain_depth", "id")
