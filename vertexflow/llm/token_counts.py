"""Token counts with a whole-token shortcut.

``whole_tokens`` proves which vocabulary strings encode alone as exactly one token;
a pre-token that is one of them counts as one without running any merge. Only the
other pre-tokens go through the library.

Defined results: a null or empty text has 0 bytes and 0 tokens; a null doc_id is
kept; repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

import json
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .pieces import PieceEncoder, sized_batches

#: The pre-token pattern of the byte-level vocabularies (fixed value).
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=4)
def whole_tokens(path: str) -> frozenset[str]:
    """Strings of the vocabulary that are one pre-token and encode alone as one token."""
    import regex

    from .pieces import load

    tokenizer = load(path)
    special = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
    names = [tokenizer.decode([i], skip_special_tokens=False) for i in range(tokenizer.get_vocab_size())]
    names = [s for s in dict.fromkeys(names) if s and "�" not in s and s not in special]
    if not json.loads(tokenizer.pre_tokenizer.__getstate__()).get("use_regex"):
        raise ValueError(f"{path} doesn't split texts by the byte-level pattern")
    one = regex.compile(PRE_TOKENS)
    return frozenset(s for s, e in zip(names, tokenizer.encode_batch_fast(names, add_special_tokens=False)) if len(e.ids) == 1 and one.fullmatch(s))


class TokenCounter(PieceEncoder):
    """Counts per piece: pre-tokens found in the whole-token table count directly, the rest are merged."""

    joined = staticmethod(sum)

    def __init__(self, path: str):
        import regex

        super().__init__(path, False, "<u4")
        self.whole = whole_tokens(path)
        self.find = regex.compile(PRE_TOKENS).findall
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def counts(self, texts: pa.Array) -> np.ndarray:
        """The number of tokens of each text."""
        _, totals, places, rest = self._batch(texts)
        sums = np.zeros(len(texts), np.int64)
        sums[places] = totals
        for i, n in rest:
            sums[i] = n
        return sums

    def _gather(self, found: list[int], places: np.ndarray, bounds: np.ndarray):
        running = np.append(0, np.array(found, np.int64)[places].cumsum())
        return None, np.diff(running[bounds]) if len(bounds) else np.zeros(0, np.int64)

    def _encode_all(self, texts: list[str]) -> list[int]:
        whole, counts, rest, at = self.whole, [], [], []
        for i, text in enumerate(texts):
            if text in whole:
                counts.append(1)
            elif any(s in text for s in self.special):
                counts.append(0)
                rest.append(text)
                at.append(i)
            else:
                pre = self.find(text)
                merge = [p for p in pre if p not in whole]
                counts.append(len(pre) - len(merge))
                rest += merge
                at += [i] * len(merge)
        for i, ids in zip(at, super()._encode_all(rest)):
            counts[i] += len(ids) // 4
        return counts


@lru_cache(maxsize=1)
def counter(path: str, query: str) -> TokenCounter:
    """The Python worker's counter, which keeps its pieces between tasks of one query."""
    return TokenCounter(path)


def count_tokens(docs: DataFrame, path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than ``limit`` tokens) of every whole text."""
    query = uuid.uuid4().hex

    def run(batches):
        own = counter(path, query)
        for batch in batches:
            for part in sized_batches(batch):
                n = own.counts(part.column(1))
                sizes = pc.fill_null(pc.binary_length(part.column(1)), 0).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), sizes, pa.array(n), pa.array(n > limit)], [id_col, "n_bytes", "n_tokens", "over_limit"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")
