"""Reports: small results written by the driver."""

from __future__ import annotations

import csv
import json
import os
from datetime import datetime
from typing import Any

from pyspark.sql import DataFrame

from ..fixed import REPORT_TITLE


def confined(folder: str, root: str | None) -> str:
    """The folder's real path; an error where it leaves root."""
    real = os.path.realpath(folder)
    if root and os.path.commonpath([real, os.path.realpath(root)]) != os.path.realpath(root):
        raise ValueError(f"{folder} is outside {root}")
    os.makedirs(real, exist_ok=True)
    return real


def _write_rows(f, df: DataFrame) -> None:
    out = csv.writer(f, lineterminator="\n")
    out.writerow(df.columns)
    for row in df.toLocalIterator():
        out.writerow(["" if x is None else x for x in row])


def daily_report(daily: DataFrame, summary: dict[str, Any], folder: str = "reports", now: datetime | None = None, root: str | None = None) -> str:
    """daily_report_<date>.csv: the summary as comment lines, then the daily rows, newest first."""
    now = now or datetime.now()
    path = os.path.join(confined(folder, root), f"daily_report_{now:%Y%m%d}.csv")
    with open(path, "w", encoding="utf-8") as f:
        f.write(f"# {REPORT_TITLE}: {now:%Y-%m-%d %H:%M:%S}\n")
        f.writelines(f"# {k}: {v}\n" for k, v in summary.items())
        f.write("#\n")
        _write_rows(f, daily.orderBy(daily["stat_date"].desc()))
    return path


def data_report(result: DataFrame, summary: dict[str, Any], folder: str = "reports", now: datetime | None = None, root: str | None = None) -> str:
    """data_report_<date>.csv with the rows and data_summary_<date>.json with the summary; gives the CSV's path."""
    now = now or datetime.now()
    folder = confined(folder, root)
    path = os.path.join(folder, f"data_report_{now:%Y%m%d}.csv")
    rows = result.orderBy("_stat_date") if "_stat_date" in result.columns else result
    with open(path, "w", encoding="utf-8") as f:
        _write_rows(f, rows)
    with open(os.path.join(folder, f"data_summary_{now:%Y%m%d}.json"), "w", encoding="utf-8") as f:
        json.dump(summary, f, ensure_ascii=False, indent=2, default=str)
    return path


def print_report(summary: dict[str, Any]) -> None:
    for k, v in summary.items():
        print(f"{k}: {v}")
