"""Token counts through a digest cache.

A count is stored under two digests: of the normalised content and of the
tokenizer's version (library, library version and vocabulary file). Counting a
corpus joins its contents' digests with the cache, encodes each distinct
content that misses once, appends those counts, and joins the counts back to
the rows. Normalisation must not change a count, so it only maps null to the
empty text and leaves the bytes as they are.

Copies are collapsed by partial aggregation on the digest before texts are
shuffled, so a content held by a third of all rows is one row a task.

Within a task, a tokenizer that drops white space (its declaration is checked)
is applied to distinct space-separated pieces, whose counts add up; a bounded
memo keeps those already counted.

Defined results: null and empty texts have no bytes and no tokens (or what the
library gives the empty text); ids may be null or repeat, each row is
returned; other columns are carried unless named like a result column; an
empty table gives an empty result and an empty append.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable, Iterator
from importlib import metadata

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._store import Scratch
from ._text import pieces

RESULT = ("n_bytes", "n_tokens", "over_limit")
CACHE = "tokenizer string, content binary, n_tokens long"
#: Pieces whose counts a task remembers; it starts anew beyond that.
MEMO = 1 << 19
_loaded: dict[str, object] = {}


def _library(path: str) -> str:
    return "sentencepiece" if path.endswith(".model") else "tokenizers"


def tokenizer_version(path: str) -> str:
    """Digest of all that a count depends on besides the text."""
    lib = _library(path)
    with open(path, "rb") as f:
        return hashlib.sha256(f"{lib} {metadata.version(lib)} ".encode() + f.read()).hexdigest()


def drops_space(path: str) -> bool:
    """Whether texts fall apart at ASCII white space: their pieces' counts add up to the text's."""
    if _library(path) != "tokenizers":
        return False
    with open(path) as f:
        t = json.load(f)
    steps = (t.get("normalizer") or {}).get("normalizers", [])
    split = ((t.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
    free = all(s["type"] in ("NFC", "Lowercase") or s == {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "} for s in steps)
    parts = split.get("pattern", {}).get("Regex", "").split("|")
    plain = bool(parts[0]) and all(p in (r"[\p{L}]+", r"[\p{N}]", r"[^\s\p{L}\p{N}]+") or (p[:1] == "'" and p[1:].isalpha()) for p in parts)
    added = all(not (a["lstrip"] or a["rstrip"] or a["single_word"] or a["normalized"]) and not any(map(str.isspace, a["content"])) for a in t.get("added_tokens", []))
    return free and plain and split.get("behavior") == "Removed" and split.get("invert") is True and added and t.get("post_processor") is None and t.get("truncation") is None and t.get("padding") is None


def load(path: str) -> Callable[[list[str]], list[int]]:
    """A function from texts to token counts, without added special tokens."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if path not in _loaded:
        if _library(path) == "sentencepiece":
            import sentencepiece

            piece = sentencepiece.SentencePieceProcessor(model_file=path)
            _loaded[path] = lambda texts: [len(x) for x in piece.encode(texts, num_threads=1)]
        else:
            from tokenizers import Tokenizer

            t = Tokenizer.from_file(path)
            t.no_truncation()
            t.no_padding()
            _loaded[path] = lambda texts: [len(e) for e in t.encode_batch_fast(texts, add_special_tokens=False)]
    return _loaded[path]


class PieceCounter:
    """Counts of texts as sums over their space-separated pieces."""

    def __init__(self, count: Callable[[list[str]], list[int]], most: int = MEMO):
        self.count, self.most, self.memo = count, most, {}

    def __call__(self, texts: list[bytes]) -> list[int]:
        split = [t.split() for t in texts]
        memo = self.memo
        new = list({p for s in split for p in s} - memo.keys())
        if len(memo) + len(new) > self.most:
            memo.clear()
            new = list({p for s in split for p in s})
        memo.update(zip(new, self.count([p.decode() for p in new]), strict=True))
        known = memo.__getitem__
        return [sum(map(known, s)) for s in split]


def _encode(path: str, by_piece: bool):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = load(path)
        pieces_of = PieceCounter(count)
        for b in pieces(batches):
            if by_piece:
                n = pieces_of(b["text"].cast(pa.binary()).to_pylist())
            else:
                n = count(b["text"].to_pylist())
            yield pa.RecordBatch.from_arrays([b["content"], pa.array(n, pa.int64())], names=["content", "n_tokens"])

    return go


def read_cache(spark: SparkSession, path: str, version: str) -> DataFrame:
    """Counts of one tokenizer version; empty where nothing was stored yet."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], CACHE).select("content", "n_tokens")
    return spark.read.schema(CACHE).parquet(path).where(F.col("tokenizer") == version).groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, tokenizer_path: str, cache_path: str | None = None, limit: int = 2048, text_col: str = "text") -> DataFrame:
    """Count the tokens of every text.

    cache_path: a Parquet table (CACHE) that is read and appended to; without
    one, a fresh one in the shared folder. Returns the other columns of `docs`
    and n_bytes, n_tokens, over_limit (n_tokens > limit).
    """
    spark = docs.sparkSession
    cache_path = cache_path or Scratch(spark, "token-counts").path("cache")
    version = tokenizer_version(tokenizer_path)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    content = F.unhex(F.sha2(text.cast("binary"), 256))
    wanted = docs.select(content.alias("content"), text.alias("text")).groupBy("content").agg(F.first("text").alias("text"))
    misses = wanted.join(read_cache(spark, cache_path, version).select("content"), "content", "left_anti")
    counted = misses.mapInArrow(_encode(tokenizer_path, drops_space(tokenizer_path)), "content binary, n_tokens long")
    counted.select(F.lit(version).alias("tokenizer"), "content", "n_tokens").write.mode("append").parquet(cache_path)

    carry = [c for c in docs.columns if c not in RESULT and c != text_col]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry], F.lit(0).alias("_")).alias("rest"), content.alias("content"), F.octet_length(text).cast("long").alias("n_bytes"))
    out = rows.join(read_cache(spark, cache_path, version), "content")
    return out.select(*[F.col(f"rest.`{c}`") for c in carry], "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
