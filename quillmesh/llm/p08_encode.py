"""Corpus encoding by a public byte-level BPE as a bounded-lookahead streaming transducer."""

from __future__ import annotations

import base64
import codecs
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

CHUNK = 1 << 16  # code points that are fed at once
MEMO = 1 << 17  # words remembered by a worker

# Fixed value: the splitting pattern of the vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """Where the installed vocabulary file lies."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


class MergeList:
    """Ranks of a byte-level BPE and what can be derived from them."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.of = {i: t for t, i in self.rank.items()}
        self.longest = max(map(len, self.rank))
        self._pairs: dict[tuple[bytes, bytes], bool] = {}

    def merge(self, data: bytes) -> list[bytes]:
        """The plain definition: join the adjacent pair of the lowest rank until none is left."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.rank.get(parts[i] + parts[i + 1], 1 << 60))
            if parts[best] + parts[best + 1] not in self.rank:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def adjacent(self, a: bytes, b: bytes) -> bool:
        """Whether b can follow a: a list of tokens is an encoding exactly if all its neighbours can."""
        known = self._pairs.get((a, b))
        if known is None:
            if len(self._pairs) > MEMO:
                self._pairs.clear()
            known = self._pairs[a, b] = self.merge(a + b) == [a, b]
        return known

    def lookahead(self) -> int:
        """Bytes after which a position can only be inside a token that starts later.

        A token of any continuation that covers the next byte starts within the last
        ``longest - 1`` bytes. Everything that the encodings of those prefixes share is final.
        """
        return self.longest - 1


class Transducer:
    """Encodes the bytes of one word piece by piece; keeps only what is not yet final.

    For each byte position the last token of the encoding of the prefix is kept (it is the
    only token that ends there and can follow the last token before it). Tokens that all
    positions within the lookahead share are emitted and forgotten.
    """

    def __init__(self, merges: MergeList):
        self.m, self.data, self.last = merges, b"", []  # last[i]: token that ends after byte i of data
        self.before: bytes | None = None  # the token emitted last

    def feed(self, data: bytes) -> list[int]:
        out: list[int] = []
        for k in range(len(data)):
            self.data += data[k : k + 1]
            end = len(self.data)
            for n in range(min(self.m.longest, end), 0, -1):
                t = self.data[end - n :]
                left = self.last[end - n - 1] if end > n else self.before
                if t in self.m.rank and (left is None or self.m.adjacent(left, t)):
                    self.last.append(t)
                    break
            if end >= 2 * self.m.longest and end % self.m.longest == 0:
                out += self._stable()
        return out

    def _chain(self, end: int) -> list[int]:
        ends = []
        while end > 0:
            ends.append(end)
            end -= len(self.last[end - 1])
        return ends

    def _stable(self) -> list[int]:
        n = len(self.data)
        shared = set(self._chain(n))
        for end in range(max(1, n - self.m.lookahead()), n):
            shared &= set(self._chain(end))
            if not shared:
                return []
        end = max(shared)
        out = [self.m.rank[self.last[e - 1]] for e in reversed(self._chain(end))]
        self.before = self.last[end - 1]
        self.data, self.last = self.data[end:], self.last[end:]
        return out

    def finish(self) -> list[int]:
        out = [self.m.rank[self.last[e - 1]] for e in reversed(self._chain(len(self.data)))]
        self.data, self.last, self.before = b"", [], None
        return out


class Encoder:
    """Text to ids, fed in chunks of any size."""

    def __init__(self, path: str):
        self.m = MergeList(path)
        self.split = regex.compile(PATTERN)
        self.memo: dict[str, list[int]] = {}

    def word(self, w: str) -> list[int]:
        ids = self.memo.get(w)
        if ids is None:
            data = w.encode("utf-8")
            if data in self.m.rank:
                ids = [self.m.rank[data]]
            else:
                t = Transducer(self.m)
                ids = t.feed(data) + t.finish()
            if len(w) <= 64:
                if len(self.memo) >= MEMO:
                    self.memo.clear()
                self.memo[w] = ids
        return ids

    def stream(self, chunks: Iterable[str]) -> Iterator[list[int]]:
        """Ids of each word as soon as no later text can change the word's end.

        The pattern looks one code point past a match, so a match is final once two code
        points follow it; the rest is carried to the next chunk. A word longer than a chunk
        keeps its place in the splitting pattern by being carried whole.
        """
        carry = ""
        for chunk in chunks:
            text, at = carry + chunk, 0
            for match in self.split.finditer(text):
                if match.end() > len(text) - 3:
                    break
                yield self.word(match.group())
                at = match.end()
            carry = text[at:]
        for w in self.split.findall(carry):
            yield self.word(w)

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        return [i for ids in self.stream(text[k : k + CHUNK] for k in range(0, len(text), CHUNK)) for i in ids]


class Decoder:
    """Ids to text as an incremental state machine: gives out only complete code points."""

    def __init__(self, path: str):
        self.of, self.state = MergeList(path).of, codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        return "".join(self.state.decode(self.of[i]) for i in ids)

    def finish(self) -> str:
        text = self.state.decode(b"", final=True)
        self.state.reset()
        return text


_encoders: dict[str, Encoder] = {}


def encode_corpus(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(key, ids) of every row: the ids of its text without special tokens.

    Null and empty texts give an empty list. Rows with a null key are kept; repeated rows give
    repeated results. Texts of any length are fed in chunks, in constant memory besides the
    row itself. Other columns are not read.
    """
    where = path or vocabulary_path()
    small = df.select(key, text)
    kind = small.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoders.get(where) or _encoders.setdefault(where, Encoder(where))
        for batch in batches:
            ids = [encoder.encode(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=[key, "ids"])

    return small.mapInArrow(run, f"{key} {kind}, ids array<int>")
