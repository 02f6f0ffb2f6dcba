"""Chat rows folded into sessions: rows wait until a chat has enough text, then all that wait are one session."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

LEAST_CHARS = 500
BUNDLES = "chat string, session_id string, first_id long, last_id long, n_rows long, user_msg_count long, asst_msg_count long, total_chars long, started_at string, ended_at string"


def _bundle(chat: str, rows: list[tuple]) -> tuple:
    """rows: (id, role, chars, ts) in order of id. All times are the last row's."""
    users = sum(r[1] == "user" for r in rows)
    return (chat, f"chat-{rows[0][0]}-{rows[-1][0]}", rows[0][0], rows[-1][0], len(rows), users, len(rows) - users, sum(r[2] for r in rows), rows[-1][3], rows[-1][3])


def _fold(chat: str, rows: list[tuple], least: int) -> tuple[list[tuple], list[tuple]]:
    """(bundles, rows that still wait)."""
    out, wait, n = [], [], 0
    for r in rows:
        wait.append(r)
        n += r[2]
        if n >= least:
            out.append(_bundle(chat, wait))
            wait, n = [], 0
    return out, wait


def bundle_chats(rows: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """Sessions of ``rows(chat, id, role, text, ts)``: in order of id, each as soon as ``least_chars`` characters wait.

    Only lengths travel to the fold. Rows that still wait at the end give nothing.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("id")
        done, _ = _fold(group["chat"].iloc[0], list(zip(group["id"], group["role"], group["chars"], group["ts"], strict=True)), least_chars)
        return pd.DataFrame(done, columns=[c.split()[0] for c in BUNDLES.split(", ")])

    sized = rows.select("chat", "id", "role", F.coalesce(F.length("text"), F.lit(0)).alias("chars"), "ts")
    return sized.groupBy("chat").applyInPandas(run, BUNDLES)


class _Chats(StatefulProcessor):
    def __init__(self, least: int):
        self.least = least

    def init(self, handle: StatefulProcessorHandle) -> None:
        kind = T.StructType([T.StructField("id", T.LongType()), T.StructField("role", T.StringType()), T.StructField("chars", T.LongType()), T.StructField("ts", T.StringType())])
        self.waiting = handle.getListState("waiting", kind)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        wait = list(self.waiting.get()) if self.waiting.exists() else []
        last = wait[-1][0] if wait else None
        new = sorted((int(a), b, int(c), d) for part in rows for a, b, c, d in zip(part["id"], part["role"], part["chars"], part["ts"], strict=True))
        done, wait = _fold(key[0], [*wait, *(r for r in new if last is None or r[0] > last)], self.least)
        if wait:
            self.waiting.put(wait)
        else:
            self.waiting.clear()
        yield pd.DataFrame(done, columns=[c.split()[0] for c in BUNDLES.split(", ")])

    def close(self) -> None:
        pass


def stream_chats(rows: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """The same over a stream; rows of a chat come in order of id. Each trigger closes every bundle that its rows fill."""
    sized = rows.select("chat", F.col("id").cast("long").alias("id"), "role", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("chars"), "ts")
    schema = T.StructType([T.StructField(c.split()[0], T.LongType() if c.endswith("long") else T.StringType()) for c in BUNDLES.split(", ")])
    return sized.groupBy("chat").transformWithStateInPandas(_Chats(least_chars), outputStructType=schema, outputMode="Append", timeMode="None")


def chat_rows_after(rows: DataFrame, watermark: int) -> DataFrame:
    """Batch source: rows that a progress table's watermark has not passed."""
    return rows.filter(F.col("id") > watermark)
