"""Token counts of whole texts with a public tokenizer file."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterlake.session import widen

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"


def with_token_counts(
    df: DataFrame, text_col: str = "text", tokenizer: str = TOKENIZER, count_col: str = "n_tokens", prompt_col: str | None = None
) -> DataFrame:
    """``df`` without its text, with the number of tokens of the text; null texts have 0.

    ``prompt_col``, if named, gets the number of tokens that begin in the first line (with its line end) of a text of several
    lines: in instruction data the part that bears no loss. It is read off the one encoding of the text. The tokenizer is loaded once per Python worker.
    """
    keep = [f for f in df.schema.fields if f.name != text_col]
    names = [f.name for f in keep]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep) + f", `{count_col}` long"
    if prompt_col:
        schema += f", `{prompt_col}` long"

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(tokenizer)
        t.encode_special_tokens = True

        for pdf in batches:
            texts = ["" if x is None else x for x in pdf[text_col]]
            breaks = [x.index("\n") + 1 if "\n" in x.strip() else 0 for x in texts]
            sizes, prompts = [], []
            for i in range(0, len(texts), 256):
                for e, x, at in zip(t.encode_batch(texts[i : i + 256], add_special_tokens=False), texts[i:], breaks[i:]):
                    sizes.append(len(e))
                    # tokens before the one that holds the first letter after the line
                    prompts.append(next((k for j in range(at, len(x)) if (k := e.char_to_token(j)) is not None), 0) if at else 0)
            out = pdf[names].copy()
            out[count_col] = sizes
            if prompt_col:
                out[prompt_col] = prompts
            yield out

    return widen(df.select(*[F.col(f"`{n}`") for n in names], text_col)).mapInPandas(count, schema)
