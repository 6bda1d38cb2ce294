"""Token counts by overlap resynchronisation.

A text is encoded as chunks of ``chunk_chars`` that overlap by ``overlap_chars``; a text of one chunk or less is one chunk. Each
chunk gives units (offset, tokens). Two neighbours are spliced at a boundary that both encodings have and that is proven
stable: a unit that starts right after white space. (The vocabularies handled here drop white space and never merge across
it, so the tokens of a run of other characters depend on this run alone.) Where the overlap holds no such boundary it is
widened, in the end to all that remains, so the count is always the library's count of the whole text.

The units of a chunk of plain characters (Latin script and common punctuation) are the words that the tokenizer's splitting
pattern finds, counted through a bounded memo, which the tokenizer fills; those of any other chunk are the tokens themselves.
Both give the library's count.

Null text: no bytes and no tokens; empty text: likewise. Repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

import bisect
import functools
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadmill.llm._shared import plain

#: Characters that Python's \\s takes as white space and the tokenizer's doesn't.
ODD_SPACE = re.compile("[\x1c-\x1f]")
#: What the last token of a word ends with.
WORD_END = "</w>"
_SPACE, _LETTER, _NUMBER = r"\t-\r \x85\xa0", r"a-z\xaa\xb5\xba\xdf-\xf6\xf8-\u024f", r"0-9\xb2\xb3\xb9\xbc-\xbe"
#: The splitting pattern of the vocabulary, over lower-cased plain text.
WORD = re.compile(f"'(?:[stmd]|re|ve|ll)|[{_LETTER}]+|[{_NUMBER}]|[^{_SPACE}{_LETTER}{_NUMBER}]+")
SPACE_THEN_WORD = re.compile(r"\s(?=\S)")

#: Offsets of units and the tokens in each.
Units = tuple[list[int], list[int]]


def stable_boundaries(text: str, start: int, end: int) -> set[int]:
    """Positions in (start, end) that follow white space and hold another character."""
    return {m.end() for m in SPACE_THEN_WORD.finditer(text, start, end) if not ODD_SPACE.match(m.group())}


def resynchronised(text: str, encode: Callable[[str], Units], chunk: int, overlap: int) -> Iterator[Units]:
    """The units of a text, in parts: chunks encoded alone, spliced at stable boundaries common to neighbours."""
    if not 0 < overlap < chunk:
        raise ValueError("0 < overlap < chunk is needed")
    n, low = len(text), 0
    end = min(n, chunk)
    at, tokens = encode(text[:end])
    while end < n:
        wide = overlap
        while True:
            start = max(low, end - wide)
            stop = min(n, max(start + chunk, end + wide))
            own, counts = encode(text[start:stop])
            right = [a + start for a in own]
            common = stable_boundaries(text, max(start, low + 1), end)
            common.intersection_update(at[bisect.bisect_left(at, start) :])
            common.intersection_update(right[: bisect.bisect_right(right, end)])
            if common or (start == low and stop == n):
                break
            wide *= 2  # no common stable boundary: look further back and further ahead
        splice = max(common) if common else low
        cut, first = bisect.bisect_left(at, splice), bisect.bisect_left(right, splice)
        yield at[:cut], tokens[:cut]
        at, tokens, low, end = right[first:], counts[first:], splice, stop
    yield at, tokens


class TokenCounter:
    """Counts tokens of a text with one tokenizer; memo: distinct words kept at most."""

    def __init__(self, path: str, memo: int = 400_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.memo = Tokenizer.from_file(path), memo
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.known: dict[str, int] = {}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends_word[[i for token, i in vocabulary.items() if token.endswith(WORD_END)]] = True

    def offsets(self, text: str) -> list[tuple[int, int]]:
        return self.tokenizer.encode(text, add_special_tokens=False).offsets

    def learn(self, words: list[str]) -> None:
        """Count the tokens of words, encoded together: white space keeps them apart."""
        ids = np.asarray(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, dtype=np.int64)
        counts = np.diff(np.flatnonzero(self.ends_word[ids]), prepend=-1).tolist()
        if len(counts) != len(words):
            counts = [len(self.offsets(w)) for w in words]
        self.known.update(zip(words, counts, strict=True))

    def counted(self, words: list[str]) -> list[int]:
        """Tokens of each word."""
        try:
            return list(map(self.known.__getitem__, words))
        except KeyError:
            if len(self.known) > self.memo:
                self.known.clear()
            self.learn(list(set(words).difference(self.known)))
            return list(map(self.known.__getitem__, words))

    def units(self, chunk: str) -> Units:
        if not plain(chunk):
            at = [a for a, _ in self.offsets(chunk)]
            return at, [1] * len(at)
        low = chunk.lower()
        return [m.start() for m in WORD.finditer(low)], self.counted(WORD.findall(low))

    def count(self, text: str | None, chunk: int, overlap: int) -> int:
        if not text:
            return 0
        if len(text) > chunk:
            return sum(sum(tokens) for _, tokens in resynchronised(text, self.units, chunk, overlap))
        if plain(text):  # one chunk: no offsets are needed
            return sum(self.counted(WORD.findall(text.lower())))
        return len(self.tokenizer.encode(text, add_special_tokens=False).ids)


@functools.cache
def counter_for(path: str) -> TokenCounter:
    """One a Python worker, so that its memo serves all of the worker's tasks."""
    return TokenCounter(path)


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 2048, chunk_chars: int = 4096, overlap_chars: int = 128) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit), for every row of docs(doc_id, text).

    tokenizer_path: a file of the tokenizers library whose tokens never hold white space. The work of a row follows its
    length, and nothing is shuffled.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = counter_for(tokenizer_path)
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_bytes": pdf["n_bytes"], "n_tokens": [counter.count(t, chunk_chars, overlap_chars) for t in pdf["text"]]})

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    return rows.mapInPandas(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
