"""Token counts, with a shortcut for pre-tokens that are one token each."""

from __future__ import annotations

import json
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidegauge.llm.common import whole_text

NAME, LIMIT = "word_bpe_49k.json", 2048
#: Distinct strings whose counts a worker remembers before it starts anew.
MEMORY = 400_000
#: The file's own pre-token pattern (fixed value).
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Blanks to Python that aren't to the tokenizer.
_NOT_BLANK = regex.compile(r"[\x1c-\x1f]")
_BLANK = regex.compile(r"\s+")


def vocabulary_path(name: str = NAME) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Counter:
    """Counts tokens as the library does, remembering what each string between blanks came to.

    Blanks separate pre-tokens and neither composition nor lower-casing crosses one, so a text's count is the sum over its
    strings between blanks. A string is cut into pre-tokens; those in `whole` are one token each, others are merged. Printable
    ASCII is cut by the pattern; other strings by the library's own normaliser and pre-tokeniser, which give the bytes of each
    pre-token as the vocabulary writes them. Only a string with a special token inside goes to the library whole.
    """

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.normal, self.parts = self.library.normalizer.normalize_str, self.library.pre_tokenizer.pre_tokenize_str
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.whole = prove_whole(path)
        self.cut = regex.compile(PRE_TOKEN).findall
        self.seen: dict[str, int] = {}

    def pre_tokens(self, s: str) -> list[str] | None:
        """The pre-tokens of a string between blanks, as the vocabulary writes them; None if it has a special token inside."""
        if any(t in s for t in self.special):
            return None
        if s.isascii() and s.isprintable():
            return self.cut(s.lower())
        return [p for p, _ in self.parts(self.normal(s))]

    def string(self, s: str) -> int:
        found = self.pre_tokens(s)
        if found is None:
            return len(self.library.encode(s, add_special_tokens=False).ids)
        merge, whole = self.library.model.tokenize, self.whole
        return sum(1 if p in whole else len(merge(p)) for p in found)

    def text(self, text: str) -> int:
        seen = self.seen
        strings = _BLANK.split(text) if _NOT_BLANK.search(text) else text.split()
        try:
            return sum(map(seen.__getitem__, strings))
        except KeyError:
            total = 0
            for s in strings:
                if s:
                    n = seen.get(s)
                    if n is None:
                        if len(seen) >= MEMORY:
                            seen.clear()
                        n = seen[s] = self.string(s)
                    total += n
            return total


@lru_cache(2)
def prove_whole(path: str) -> frozenset[str]:
    """Strings that are one token as a pre-token, in the vocabulary's writing of bytes: its words that its own merges put together again.

    Worked out from the file alone, before any text is read: a word counts only if the merges, applied to its characters,
    end in that single token.
    """
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    end = model["end_of_word_suffix"]
    merge = Tokenizer.from_file(path).model.tokenize
    words = (v[: -len(end)] for v in model["vocab"] if v.endswith(end))
    return frozenset(w for w in words if w and len(merge(w)) == 1)


@lru_cache(2)
def counter(path: str) -> Counter:
    return Counter(path)


def _count(name: str):
    def run(batches):
        count = counter(vocabulary_path(name)).text
        for batch in batches:
            numbers = [count(x) for x in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in batch.schema.names if c != "text"), pa.array(numbers, pa.int64())], [*(c for c in batch.schema.names if c != "text"), "n_tokens"])

    return run


def token_counts(docs: DataFrame, name: str = NAME, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of each row of docs; other columns are left out. Null texts count as empty: no tokens.

    Repeated rows give a row each; very long texts are counted whole; an empty table gives an empty one.
    Nothing is shuffled; a worker keeps one table of counts of bounded size over all its tasks.
    """
    sized = docs.select("doc_id", F.octet_length(whole_text()).cast("long").alias("n_bytes"), whole_text().alias("text"))
    counted = sized.mapInArrow(_count(name), "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op9(docs: DataFrame) -> DataFrame:
    return token_counts(docs)
