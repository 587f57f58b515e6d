"""Where results go: files, the terminal, syslog."""

from __future__ import annotations

import json
import socket
import time
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def terminal(df: DataFrame, rows: int = 20) -> DataFrame:
    df.show(rows, truncate=False)
    return df


def file(data: str | DataFrame, path: str, kind: str = "json") -> None:
    """A text to one file (mode 0644), or a frame to a folder of part files."""
    if isinstance(data, DataFrame):
        data.write.mode("overwrite").format(kind).save(path)
        return
    Path(path).write_text(data)
    Path(path).chmod(0o644)


def syslog(df: DataFrame, server: str, port: int = 514, facility: int = 77, severity: int = 6, interval_ms: int = 1) -> None:
    """Each record as one UDP message of JSON, sent from the executors."""

    def send(rows: Any) -> None:
        with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as s:
            for r in rows:
                s.sendto(f"<{facility * 8 + severity}>{r['m']}".encode(), (server, port))
                time.sleep(interval_ms / 1000)

    df.select(F.to_json(F.struct("*")).alias("m")).foreachPartition(send)


def as_python(df: DataFrame) -> list[Any]:
    """Results of `Plan.results` as Python values, in order of input."""
    return [json.loads(r["result"]) for r in df.orderBy("input").collect()]
