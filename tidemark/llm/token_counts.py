"""Token counts from pre-token frequencies, without materialising ids.

Every text is cut at single spaces into chunks, which a byte-level pre-tokeniser never looks across; the
distinct chunks of a task are pre-tokenised once, the pieces of each distinct pre-token are counted once, and
a document's count is the sum over its chunk frequencies of those counts. The dictionaries live in the Python
worker and are emptied at a fixed number of entries, so memory is bounded and no shuffle is needed: the join of
frequencies with counts is a look-up inside the task that holds the document, and no key can be hot.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table

SCHEMA = "doc_id long, n_bytes long, n_pretokens long, n_tokens long, over_limit boolean"
#: Entries after which a worker's dictionary starts anew. It changes speed and memory only, never a count.
DICTIONARY_SIZE = 400_000
#: Two white-space characters in a row: the pre-tokeniser then looks across single spaces.
_RUN = re.compile(r"[\s᠎]{2}")


class PieceCounts(dict):
    """chunk -> (pre-tokens, pieces), counted on first sight. ``lead`` is put before each chunk."""

    def __init__(self, tokenizer, lead: str, counts: dict[str, int]):
        self.tokenizer, self.lead, self.counts = tokenizer, lead, counts
        added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None

    def __missing__(self, chunk: str) -> tuple[int, int]:
        parts = self.special.split(self.lead + chunk) if self.special else [self.lead + chunk]
        found = pieces = len(parts) - 1
        model, counts = self.tokenizer.model, self.counts
        for part in parts:
            if part:
                for pre, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(part):
                    if (n := counts.get(pre)) is None:
                        n = counts[pre] = len(model.tokenize(pre))
                    pieces += n
                    found += 1
        self[chunk] = out = (found, pieces)
        return out


_KEPT: dict = {}


def _dictionaries(path: str) -> tuple[PieceCounts, PieceCounts]:
    if path not in _KEPT:
        from tokenizers import Tokenizer

        tokenizer, counts = Tokenizer.from_file(path), {}
        if tokenizer.normalizer is not None:
            raise ValueError("counts by pre-token need a tokenizer without a normaliser")
        _KEPT.clear()
        _KEPT[path] = PieceCounts(tokenizer, "", counts), PieceCounts(tokenizer, " ", counts)
    first, rest = _KEPT[path]
    if len(rest) + len(first) > DICTIONARY_SIZE or len(rest.counts) > DICTIONARY_SIZE:
        for d in (first, rest, rest.counts):
            d.clear()
    return first, rest


def count_text(text: str, first: PieceCounts, rest: PieceCounts) -> tuple[int, int]:
    """(pre-tokens, tokens) of one whole text."""
    if not text:
        return 0, 0
    if _RUN.search(text):
        # Cut before each single space between two characters that are no white space; the rest stays together.
        head, *chunks = re.split(r"(?<![\s᠎]) (?![\s᠎])", text)
    else:
        head, *chunks = text.split(" ")
    found, pieces = first[head] if head else (0, 0)
    if len(first) > DICTIONARY_SIZE:
        first.clear()
    for chunk, n in Counter(chunks).items():
        f, p = rest[chunk]
        found += f * n
        pieces += p * n
    return found, pieces


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, limit: int = 512) -> DataFrame:
    """One row per document: bytes, pre-tokens, tokens, and whether it has more than ``limit`` tokens.

    Null text counts as empty (0 tokens); a null id is kept; repeated rows give repeated rows; an empty table
    gives an empty result; other columns are ignored. Added special tokens inside a text count as one token
    each, as the library does by default. Texts of any length are counted whole.
    """
    path = tokenizer or public_tokenizers.path("byte_bpe_50k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, rest = _dictionaries(path)
            out = [[], [], []]
            for text in batch.column(1):
                text = text.as_py() or ""
                if len(rest) > DICTIONARY_SIZE:
                    first, rest = _dictionaries(path)
                found, pieces = count_text(text, first, rest)
                for column, x in zip(out, (len(text.encode()), found, pieces)):
                    column.append(x)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), *(pa.array(x, pa.int64()) for x in out), pa.array([x > limit for x in out[2]], pa.bool_())],
                names=["doc_id", "n_bytes", "n_pretokens", "n_tokens", "over_limit"],
            )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read_table(spark, sf_dir, "documents"))
