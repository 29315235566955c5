"""SentencePiece encoding and decoding, with seeded merge-dropout."""

from __future__ import annotations

import heapq
import re
import sys
from functools import lru_cache
from itertools import repeat
from math import inf
from operator import add

import numpy as np
import pyarrow as pa
import sentencepiece
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import whole_text

NAME = "piece_bpe_32k.model"
#: Share of merge types that a variant skips, number of variants, and the seed of the keyed hashes.
DROPOUT, VARIANTS, SEED = 0.1, 4, 20_240_601
#: Distinct strings that a worker remembers for each variant, with their pieces in four bytes each, before it starts anew.
MEMORY = 250_000
#: Characters of a string whose agenda is a plain list.
SHORT = 40
SPACE = "▁"
_LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
_MARKS = "\n\t,.;:!?*()\"'-/#%&|<>=[]{}@$_+~"


def borders(pieces) -> re.Pattern:
    """Finds the strings of a text that no piece of the vocabulary reaches beyond, worked out from the vocabulary alone.

    A string ends before a space mark, and between a letter and a punctuation mark that no piece has side by side.
    """
    joined = "\0".join(pieces)
    apart = "".join(re.escape(m) for m in _MARKS if not re.search(f"[{_LETTER}]{re.escape(m)}|{re.escape(m)}[{_LETTER}]", joined))
    if not apart:
        return re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
    return re.compile(f"{SPACE}*(?:(?:[{_LETTER}]++(?![{apart}])|[{apart}]++(?![{_LETTER}])|[^{SPACE}{_LETTER}{apart}]++)+(?:[{_LETTER}]++|[{apart}]++)?|[{_LETTER}]++|[{apart}]++)|{SPACE}+")


def vocabulary_path(name: str = NAME) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Pieces:
    """Encodes and decodes with the vocabulary of a SentencePiece BPE model with byte fallback and no normalisation."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.model, self.ids, self.rank = model, {}, {}
        for i in range(model.vocab_size()):
            piece = model.id_to_piece(i)
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)):
                self.ids[piece], self.rank[piece] = i, -model.get_score(i)
        self.bytes = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.packed = {p: i.to_bytes(4, sys.byteorder) for p, i in self.ids.items()}
        self.raw = {i: p.replace(SPACE, " ").encode() for p, i in self.ids.items()} | {i: bytes([b]) for b, i in enumerate(self.bytes)}
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("a piece has a space mark inside: texts can't be cut at them")
        self.strings = borders(self.ids).findall
        self.seen: dict[tuple, dict[str, bytes]] = {}
        self.skipped: dict[tuple, dict[tuple, bool]] = {}

    def _skips(self, key: tuple, merged: str, left: str, skipped: dict[tuple, bool]) -> bool:
        """Whether the merge type left + rest is skipped: a hash keyed by seed and variant, below the dropout's share."""
        kind = merged, len(left)
        known = skipped.get(kind)
        if known is None:
            dropout, variant, seed = key
            name = f"{left} {merged[len(left):]}"
            known = skipped[kind] = xxhash.xxh64_intdigest(name.encode("utf-8", "surrogatepass"), (seed + variant * 0x9E3779B97F4A7C15) % 2**64) < dropout * 2**64
        return known

    def _merged_short(self, string: str, key: tuple) -> list[str]:
        """merged() for a short string: the agenda is a list with a place for each neighbouring pair."""
        rank, dropout, skipped = self.rank.get, key[0], self.skipped.setdefault(key, {})
        known = skipped.get
        parts = list(string)
        agenda = list(map(rank, map(add, parts, parts[1:]), repeat(inf)))
        while agenda and (best := min(agenda)) < inf:
            i = agenda.index(best)
            left = parts[i]
            whole = left + parts[i + 1]
            if dropout:
                skips = known((whole, len(left)))
                if self._skips(key, whole, left, skipped) if skips is None else skips:
                    agenda[i] = inf
                    continue
            parts[i] = whole
            del parts[i + 1], agenda[i]
            if i < len(agenda):
                agenda[i] = rank(whole + parts[i + 1], inf)
            if i:
                agenda[i - 1] = rank(parts[i - 1] + whole, inf)
        return parts

    def merged(self, string: str, key: tuple) -> list[str]:
        """The string's pieces: an agenda of neighbouring pairs, best score first and leftmost of equals; a candidate whose type is skipped is dropped when its turn comes."""
        if len(string) <= SHORT:
            return self._merged_short(string, key)
        rank, dropout = self.rank, key[0]
        skipped = self.skipped.setdefault(key, {})
        parts: list[str | None] = list(string)
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = [(rank[p], i, p) for i in range(n - 1) if (p := parts[i] + parts[i + 1]) in rank]
        heapq.heapify(agenda)
        while agenda:
            _, i, whole = heapq.heappop(agenda)
            left = parts[i]
            if left is None or (j := after[i]) >= n or len(left) + len(parts[j]) != len(whole) or left + parts[j] != whole:
                continue
            if dropout and self._skips(key, whole, left, skipped):
                continue
            parts[i], parts[j] = whole, None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (p := whole + parts[k]) in rank:
                    heapq.heappush(agenda, (rank[p], i, p))
            if (h := before[i]) >= 0 and (p := parts[h] + whole) in rank:
                heapq.heappush(agenda, (rank[p], h, p))
        return [p for p in parts if p is not None]

    def _string(self, string: str, key: tuple) -> bytes:
        parts = self.merged(string, key)
        try:
            return b"".join(map(self.packed.__getitem__, parts))
        except KeyError:
            return b"".join(self.packed[p] if p in self.packed else self._bytes(p) for p in parts)

    def _bytes(self, part: str) -> bytes:
        return b"".join(self.bytes[b].to_bytes(4, sys.byteorder) for b in part.encode())

    def encode_packed(self, text: str, dropout: float = 0.0, variant: int = 0, seed: int = SEED) -> bytes:
        """encode() as the bytes of 32-bit ids."""
        if not text:
            return b""
        key = (dropout, variant, seed)
        seen = self.seen.setdefault(key, {})
        if len(seen) >= MEMORY:
            seen.clear()
        out: list[bytes] = []
        for k, part in enumerate(text.split(SPACE)):
            marked = part.replace(" ", SPACE)
            if k:
                out.append(self._bytes(SPACE))
            else:
                marked = SPACE + marked
            strings = self.strings(marked)
            long = {}
            for string in set(strings).difference(seen):
                (seen if len(string) < 64 else long)[string] = self._string(string, key)
            out.extend(map(seen.__getitem__, strings) if not long else (long[x] if x in long else seen[x] for x in strings))
        return b"".join(out)

    def encode(self, text: str, dropout: float = 0.0, variant: int = 0, seed: int = SEED) -> list[int]:
        """Ids of the text's pieces. A space mark that the text itself holds goes to bytes, so that it comes back as it was."""
        return np.frombuffer(self.encode_packed(text, dropout, variant, seed), np.int32).tolist()

    def decode(self, ids: list[int]) -> str:
        """The text that encode() got, character for character."""
        text = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text else text


@lru_cache(2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def _encode(name: str, dropout: float, variants: int, seed: int):
    def run(batches):
        own = pieces(vocabulary_path(name))
        for batch in batches:
            columns = {c: batch[c] for c in batch.schema.names}
            texts = columns.pop("text_").to_pylist()
            packed = [own.encode_packed(t, dropout, v, seed) for t, v in zip(texts, columns["variant"].to_pylist(), strict=True)]
            ends = np.cumsum([0, *(len(x) // 4 for x in packed)])
            ids = np.frombuffer(b"".join(packed), np.int32)
            columns["n_pieces"] = pa.array(np.diff(ends), pa.int64())
            columns["lossless"] = pa.array([own.decode(ids[a:b].tolist()) == t for a, b, t in zip(ends, ends[1:], texts, strict=False)], pa.bool_())
            columns["pieces"] = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids))
            yield pa.RecordBatch.from_pydict(columns)

    return run


def encode(docs: DataFrame, dropout: float = DROPOUT, variants: int = VARIANTS, seed: int = SEED, name: str = NAME) -> DataFrame:
    """doc_id, variant, n_pieces, lossless and pieces (the ids) of each row of docs; other columns are left out.

    A document's variant is a seeded hash of its doc_id (0 for a null one). For each variant a keyed hash fixes which merge
    types are skipped, so a word may be cut differently from variant to variant but alike wherever a variant has it, and
    reruns agree. With dropout 0 the pieces are the library's own. lossless: decoding gave the text back, checked for each
    row. Null and empty texts have no pieces; repeated rows give a row each; very long texts are encoded whole, a worker holding
    one of them at a time; an empty table gives an empty one. Nothing is shuffled.
    """
    chosen = F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(variants)))
    sent = docs.select("doc_id", chosen.cast("int").alias("variant"), whole_text().alias("text_"))
    return sent.mapInArrow(_encode(name, dropout, variants, seed), "doc_id long, variant int, n_pieces long, lossless boolean, pieces array<int>")


def _decode(name: str):
    def run(batches):
        own = pieces(vocabulary_path(name))
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"], "text": pa.array([own.decode(i or []) for i in batch["pieces"].to_pylist()], pa.string())})

    return run


def decode(encoded: DataFrame, name: str = NAME) -> DataFrame:
    """doc_id and text from the doc_id and pieces of encode(); null pieces give an empty text."""
    return encoded.select("doc_id", "pieces").mapInArrow(_decode(name), "doc_id long, text string")


def op3(docs: DataFrame) -> DataFrame:
    return encode(docs)
