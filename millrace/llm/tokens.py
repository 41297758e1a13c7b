"""Token counts with a public tokenizer; its vocabulary file is a parameter and is read on each worker."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.runtime import materialize, spread

TOKENIZER = "byte_bpe_50k.tiktoken"


@lru_cache(2)
def encoder(path: str):
    """The byte-level BPE of a rank file. A bare file name is looked up among the installed public tokenizers."""
    import public_tokenizers
    import tiktoken

    if "/" not in path:
        path = public_tokenizers.path(path)
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), tokenizer: str = TOKENIZER) -> DataFrame:
    """``keep`` columns and n_tokens; null and empty texts have none. Written once, as it is read several times."""
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(tokenizer)
        for b in batches:
            out = b[list(keep)].copy()
            out["n_tokens"] = [len(enc.encode_ordinary(t)) if isinstance(t, str) and t else 0 for t in b[text]]
            yield out

    return materialize(spread(df.select(*keep, F.col(text))).mapInPandas(run, f"{shape}, n_tokens long"), "tokens")
