"""Timestamps of the tests."""

import datetime as dt


def ts(s: str) -> dt.datetime:
    return dt.datetime.fromisoformat(s)
