"""Exact token counts with a whole-token shortcut.

Before the job, every vocabulary string that ends a word is tried alone: those that the library gives as a
single token are proven, and a pre-token among them counts 1 without merging. Only the other pre-tokens are
merged, each distinct one once while it stays in a bounded memory. The proven set is bounded by the vocabulary.

Defined cases: a null text counts as empty (0 tokens); each row gives one row, repeated or not; other columns
are ignored; special strings inside a text are read as the library reads them by default.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_chunks
from .tokenizing import NOT_PLAIN, WORD_SPLIT, Memo, by_model, kept_in_process, load, special


def proven(path: str) -> frozenset[str]:
    """Vocabulary strings that alone are one token, as text."""
    tok = load(path)
    ends = [t[:-4] for t in tok.get_vocab() if t.endswith("</w>") and t.isascii() and len(t) > 4]
    ends = [t for t in ends if WORD_SPLIT.fullmatch(t)]
    got = tok.encode_batch(ends, add_special_tokens=False)
    return frozenset(t for t, g in zip(ends, got, strict=True) if len(g.ids) == 1)


def token_counts(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each row; `path` names a word-end BPE file of the tokenizers library."""
    whole = proven(path)

    def make():
        tok = load(path)
        return tok, special(tok), Memo(by_model(tok), len)

    def run(batches):
        tok, marks, memo = kept_in_process(f"count:{path}", make)
        for batch in text_chunks(batches):
            counts, slow, slow_at = [0] * batch.num_rows, [], []
            memo.trim()
            for i, text in enumerate(batch.column(1).to_pylist()):
                if NOT_PLAIN.search(text) or ("<" in text and marks.search(text)):
                    slow.append(text)
                    slow_at.append(i)
                else:
                    words = WORD_SPLIT.findall(text.lower())
                    rest = [w for w in words if w not in whole]
                    counts[i] = len(words) - len(rest) + sum(map(memo.__getitem__, rest))
            for i, got in zip(slow_at, tok.encode_batch(slow, add_special_tokens=False) if slow else [], strict=True):
                counts[i] = len(got.ids)
            n = pc.binary_length(batch.column(1)).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), n, pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
