import os

import pytest

from rosterlake.llm.tokens import TOKENIZER, with_token_counts


@pytest.mark.skipif(not os.path.exists(TOKENIZER), reason="no tokenizer file")
def test_counts(spark):
    df = spark.createDataFrame([(1, "hello world", 5), (2, None, 5), (3, "", 5), (4, "a\nb b", 5), (5, "<|endoftext|>", 5), (6, "word " * 5000, 5)], "doc_id long, text string, n int")
    got = {r["doc_id"]: (r["n_tokens"], r["n_prompt"]) for r in with_token_counts(df, prompt_col="n_prompt").collect()}
    assert got[1] == (2, 0) and got[2] == (0, 0) and got[3] == (0, 0)
    assert got[4][1] == 2 and got[4][0] == 4 and got[5][0] > 1 and got[6][0] >= 5000
