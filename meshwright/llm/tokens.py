"""Encoding and decoding of a corpus with a public tokenizer, each distinct word once.

Texts are cut into pre-tokens by the tokenizer's own rule. A block of texts keeps
a dictionary of its words and, per text, the dictionary places in order; only the
dictionaries are shuffled by word, so that every distinct word of the corpus is
encoded once, and its ids go back to the blocks, where texts are put together by
position. A word that occurs in every text costs one row a block, not one a use.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwright.session import materialize

#: Where the tokenizer's file lies; only the driver reads it.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
#: Characters of text in a block, unless one text alone is longer.
BLOCK_CHARS = 1_000_000


# The tokenizer's rule for pre-tokens in terms of ``re``'s classes, and
# ranges of characters on which those classes (letter, digit, space, the rest) are the
# tokenizer's. Texts with any other character are cut by the tokenizer itself.
PATTERN = r"'(?:[stmd]|re|ve|ll)| ?[^\W\d_]+| ?\d+| ?(?:[^\w\s]|_)+|\s+(?!\S)|\s+"
SETTLED = (
    r"\x00-\x1b\x20-\xb1\xb4-\xb8\xba\xbb\xbf-\u024f\u0391-\u03a1\u03a3-\u03c9\u0400-\u0481\u048a-\u04ff"
    r"\u2010-\u2027\u202f-\u205e\u20a0-\u20ba\u2190-\u21ff\u2200-\u22ff\u2600-\u26ff\u2714\u3000-\u3006\u3008-\u3020"
    r"\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3\ufe0f\uff01-\uff5e\u200d\u200b"
    r"\U0001f1e6-\U0001f1ff\U0001f300-\U0001f64f\U0001f680-\U0001f6ff\U0001f900-\U0001f9ff"
)
_SETTLED, _PATTERN = re.compile(f"[{SETTLED}]*"), re.compile(PATTERN)


class _Places(dict):
    """Word to place in the dictionary, in order of first use."""

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


class _Words:
    """The tokenizer, loaded once per Python worker from its JSON text."""

    _held: dict[int, object] = {}

    @classmethod
    def load(cls, text: str):
        from tokenizers import Tokenizer

        key = hash(text)
        if key not in cls._held:
            t = Tokenizer.from_str(text)
            t.encode_special_tokens = True  # their spellings in a text are ordinary text
            cls._held[key] = t
        return cls._held[key]


def tokenizer_text(path: str = TOKENIZER) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


_PIECE = "block long, doc_id string, places array<int>, place int, word string"


def _cut(tokenizer: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        exact = _Words.load(tokenizer).pre_tokenizer.pre_tokenize_str

        def cut(text: str) -> list[str]:
            return _PATTERN.findall(text) if _SETTLED.fullmatch(text) else [text[a:b] for _, (a, b) in exact(text)]

        context = TaskContext.get()
        block = (context.partitionId() if context else 0) << 36
        docs, words, size = [], _Places(), 0

        def flush() -> pd.DataFrame:
            out = pd.DataFrame(
                {
                    "block": block,
                    "doc_id": [d for d, _ in docs] + [None] * len(words),
                    "places": [p for _, p in docs] + [None] * len(words),
                    "place": pd.array([None] * len(docs) + list(words.values()), dtype="Int32"),
                    "word": [None] * len(docs) + list(words),
                }
            )
            return out

        for pdf in batches:
            for doc_id, text in zip(pdf["doc_id"], pdf["text"]):
                places = []
                if isinstance(text, str) and text:
                    if size and size + len(text) > BLOCK_CHARS:
                        yield flush()
                        block, docs, words, size = block + 1, [], _Places(), 0
                    places = list(map(words.__getitem__, cut(text)))
                    size += len(text)
                docs.append((doc_id, np.asarray(places, dtype=np.int32)))
        if docs:
            yield flush()

    return run


def _encode(tokenizer: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = _Words.load(tokenizer)
        for pdf in batches:
            got = t.encode_batch(pdf["word"].tolist(), add_special_tokens=False)
            yield pd.DataFrame({"word": pdf["word"], "ids": [np.asarray(e.ids, dtype=np.int32) for e in got]})

    return run


def _join_ids(docs: pd.DataFrame, words: pd.DataFrame) -> pd.DataFrame:
    ids = [None] * len(words)
    for place, one in zip(words["place"], words["ids"]):
        ids[place] = one
    lengths = np.array([len(x) for x in ids], dtype=np.int64)
    flat = np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32)
    starts = np.cumsum(lengths) - lengths
    out = []
    for places in docs["places"]:
        p = np.asarray(places, dtype=np.int64)
        if len(p) == 0:
            out.append(np.zeros(0, np.int32))
            continue
        n = lengths[p]
        at = np.repeat(starts[p] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        out.append(flat[at])
    return pd.DataFrame({"doc_id": docs["doc_id"], "ids": out})


def _sum_ids(docs: pd.DataFrame, words: pd.DataFrame) -> pd.DataFrame:
    n = np.zeros(len(words), dtype=np.int64)
    n[words["place"].to_numpy()] = words["n"].to_numpy()
    return pd.DataFrame({"doc_id": docs["doc_id"], "tokens": [int(n[np.asarray(p, dtype=np.int64)].sum()) for p in docs["places"]]})


def _pieces(docs: DataFrame, tokenizer: str) -> tuple[DataFrame, DataFrame]:
    """(block, doc_id, places) of each text, and (owner, place, ids) of each block's words."""
    # ids travel as text: a null among them would turn a batch's ids into floats
    docs = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    cut = materialize(docs.mapInPandas(_cut(tokenizer), _PIECE), "pieces")
    texts = cut.where(F.col("place").isNull()).select("block", "doc_id", "places")
    words = cut.where(F.col("place").isNotNull()).select("block", "place", "word")
    coded = words.select("word").distinct().mapInPandas(_encode(tokenizer), "word string, ids array<int>")
    return texts, words.join(coded, "word").select(F.col("block").alias("owner"), "place", "ids")


def encode(docs: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """(doc_id, ids): the ids of every document's whole text, without special tokens.

    An empty text and a null one give an empty list. Every row of ``docs`` gives one
    row, repeated texts and ids too; other columns aren't read.
    """
    texts, words = _pieces(docs, tokenizer_text(path))
    return texts.groupBy("block").cogroup(words.groupBy("owner")).applyInPandas(_join_ids, "doc_id string, ids array<int>").withColumn("doc_id", F.col("doc_id").cast("bigint"))


def token_counts(docs: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """(doc_id, tokens): how many ids ``encode`` gives; only counts are shuffled back."""
    texts, words = _pieces(docs, tokenizer_text(path))
    words = words.select("owner", "place", F.size("ids").alias("n"))
    return texts.groupBy("block").cogroup(words.groupBy("owner")).applyInPandas(_sum_ids, "doc_id string, tokens long").withColumn("doc_id", F.col("doc_id").cast("bigint"))


def byte_table(spark: SparkSession, path: str = TOKENIZER) -> DataFrame:
    """(id, bytes): what each id stands for; as many rows as the vocabulary has."""
    vocabulary = json.loads(tokenizer_text(path))["model"]["vocab"]
    # byte-level vocabularies write a byte that doesn't print as a character from 256 on
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    back = {chr(b): b for b in shown}
    back |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    rows = [(i, bytearray(back[c] for c in w) if all(c in back for c in w) else bytearray(w.encode())) for w, i in vocabulary.items()]
    return spark.createDataFrame(rows, "id int, bytes binary")


def decode(encoded: DataFrame, table: DataFrame) -> DataFrame:
    """(doc_id, text) of (doc_id, ids): ids are joined to their bytes and put together by position.

    An empty list gives an empty text; bytes that aren't UTF-8 become U+FFFD. doc_id
    must be unique. Ids of one document are first joined in stretches of 1,000, so
    that no row holds more than a stretch before the last step.
    """
    spread = encoded.select("doc_id", F.posexplode_outer("ids").alias("position", "id"))
    joined = spread.join(table, "id", "left").withColumn("stretch", F.floor(F.col("position") / 1000))
    parts = joined.groupBy("doc_id", "stretch").agg(F.sort_array(F.collect_list(F.when(F.col("bytes").isNotNull(), F.struct("position", F.hex("bytes").alias("h"))))).alias("p"))
    parts = parts.select("doc_id", "stretch", F.array_join(F.col("p.h"), "").alias("h"))
    whole = parts.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("stretch", "h"))).alias("p"))
    return whole.select("doc_id", F.decode(F.unhex(F.array_join(F.col("p.h"), "")), "UTF-8").alias("text"))
