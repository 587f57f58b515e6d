import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from textplan.llm import token_counts
from textplan.llm.token_counts import PieceCounter, count_tokens, drops_space, load

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, n_bytes int, content int"


def texts():
    r = random.Random(2)
    parts = ["the", "don't", "'s", "<|endoftext|>", "a<|startoftext|>b", "É", "é", " ", " ", "\x1c", "\x85", "́", "日本語", "1234", "!!", "ΣΑΣ", "İ", "​", "x" * 3000, "﻿", "ﬁ", "...'re", "<|endof"]
    space = [" ", "\n", "\t", "\x0b", "  ", "", "\r\n", "\x0c"]
    return ["".join(r.choice(parts) + r.choice(space) for _ in range(r.randint(0, 40))) for _ in range(400)]


def test_pieces_add_up():
    assert drops_space(PATH) and not drops_space(public_tokenizers.path("byte_bpe_50k.json")) and not drops_space(public_tokenizers.path("piece_bpe_32k.model"))
    count = PieceCounter(load(PATH), most=200)
    whole = [len(e) for e in Tokenizer.from_file(PATH).encode_batch(texts(), add_special_tokens=False)]
    for _ in range(2):
        assert count([t.encode() for t in texts()]) == whole


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model", "byte_bpe_50k.json"])
def test_counts_and_cache(spark, name, tmp_path, monkeypatch):
    path = public_tokenizers.path(name)
    rows = [(i, t, 1, 2) for i, t in enumerate(texts()[:60])] + [(None, None, None, None), (1, "", 1, 1), (7, "the end", 1, 1), (7, "the end", 1, 1), (8, "the end", 1, 1), (9, "word " * 3000, 1, 1)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    cache = str(tmp_path / "cache")
    count = load(path)
    want = sorted([(r[0], len((r[1] or "").encode()), count([r[1] or ""])[0], count([r[1] or ""])[0] > 2048) for r in rows], key=str)
    for _ in range(2):
        out = count_tokens(df, path, cache)
        assert out.columns == ["doc_id", "content", "n_bytes", "n_tokens", "over_limit"]
        assert sorted([(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in out.collect()], key=str) == want
    stored = spark.read.parquet(cache)
    assert stored.count() == len({r[1] or "" for r in rows})  # the second run missed nothing
    # A stored count is taken; another tokenizer version misses it.
    monkeypatch.setattr(token_counts, "tokenizer_version", lambda p: "other")
    assert count_tokens(df, path, cache).count() == len(rows)
    assert spark.read.parquet(cache).count() == 2 * stored.count()


def test_empty_table(spark):
    assert count_tokens(spark.createDataFrame([], SCHEMA), PATH).count() == 0
