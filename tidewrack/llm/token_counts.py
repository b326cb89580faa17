"""Token counts by the whole-token shortcut.

Offline, each vocabulary string is encoded by itself; those that come back as that one
token are proved whole.  Segments that equal a proved string count one token without
any merge; only the rest are merged, each distinct one once while the memo holds it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from . import vocab
from .arrow_text import add_columns


def count_tokens(df: DataFrame, text: str = "text", model: str | None = None, limit: int = 4096, carry: list[str] | None = None) -> DataFrame:
    """Adds n_bytes, n_tokens, n_whole (tokens found by the shortcut) and over_limit.

    A null text counts as empty, which has no tokens.  Rows are independent, so ties and
    repeated rows each get their own count; an empty table gives an empty one.  Texts are
    counted whole, whatever their length.  Columns with the name of an added one are replaced.
    """
    path = model or vocab.model_path()

    def measure(texts: pa.Array) -> dict:
        v = vocab.load(path)
        n, whole = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        for i, j, per_row, short in v.count(texts):
            n[i:j], whole[i:j] = per_row, short
        return {"n_bytes": pc.binary_length(texts).cast(pa.int64()), "n_tokens": n, "n_whole": whole, "over_limit": n > limit}

    return add_columns(df, text, "n_bytes long, n_tokens long, n_whole long, over_limit boolean", measure, carry)
