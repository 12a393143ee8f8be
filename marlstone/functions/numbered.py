"""Numbered redaction of a column in Arrow batches."""

import pandas as pd

from marlstone.functions.text import redact_numbered


def redact_series(s: pd.Series) -> pd.DataFrame:
    found = [redact_numbered(x) for x in s]
    return pd.DataFrame({"text": [t for t, _ in found], "n": [len(k) for _, k in found]})
