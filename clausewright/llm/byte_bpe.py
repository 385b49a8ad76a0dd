"""Byte-level BPE encoding and decoding by prefix dynamic programming.

For each prefix of a piece's bytes exactly one token can be the last one of its encoding. Stored for
every prefix, these last tokens are the whole state: following them back from the end gives the
encoding; an append only adds prefixes; an edit recomputes from its first byte until the stored
tokens agree again for as many bytes as the longest token has.

A token may follow another only if encoding the two's bytes together gives just these two. That
test is made once for each pair of tokens and remembered.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
import pyarrow.fs
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, read, text_or_empty

#: Most pieces a worker remembers the encoding of; beyond, it starts anew.
CACHE_PIECES = 150_000
#: Most pairs of tokens whose border a worker remembers.
CACHE_PAIRS = 250_000
#: Longer pieces are encoded each time.
CACHED_LENGTH = 64
#: Characters of text that are split and encoded together.
GROUP_CHARS = 2 << 20


class Vocabulary:
    """Ranks of a byte-level BPE vocabulary."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {v: k for k, v in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        #: Tokens by their bytes from last to first; a token's id is at ``-1``.
        self.endings: dict = {}
        for token, rank in ranks.items():
            node = self.endings
            for byte in reversed(token):
                node = node.setdefault(byte, {})
            node[-1] = rank
        self._pairs: dict[int, bool] = {}
        self._halves: dict[int, tuple[int, int] | None] = {}

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        """From a tiktoken rank file at a local path or a URI."""
        if "://" in path:
            fs, path = pa.fs.FileSystem.from_uri(path)
            data = fs.open_input_stream(path).read()
        else:
            with open(path, "rb") as f:
                data = f.read()
        return cls({base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)})

    def merge(self, piece: bytes) -> list[int]:
        """The definition: merge the adjacent pair of lowest rank, leftmost first, until none is left."""
        ranks, parts = self.ranks, [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            best, at = min(((ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1)))
            if best == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None if its bytes don't merge to it, or for a byte."""
        if token in self._halves:
            return self._halves[token]
        data, ranks = self.tokens[token], self.ranks
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 2:
            best, at = min(((ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1)))
            if best == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        self._halves[token] = found = (ranks[parts[0]], ranks[parts[1]]) if len(parts) == 2 else None
        return found

    def made(self, token: int) -> bool:
        """Whether merging the token's bytes gives the token; others only ever stand for a whole piece."""
        return len(self.tokens[token]) == 1 or self.halves(token) is not None

    def follows(self, left: int, right: int) -> bool:
        """Whether the bytes of ``left`` and ``right`` together encode as these two tokens.

        Goes back in time from the two tokens: of the parts at their border the one merged last came
        apart first. If two parts that met there would have merged before either went into a larger
        part, the border would be gone. Of equal ranks the left merge is done first.
        """
        tokens, ranks = self.tokens, self.ranks
        never = 1 << 60
        left_until = right_until = never
        while True:
            merged = ranks.get(tokens[left] + tokens[right])
            if merged is not None and merged < left_until and merged <= right_until and merged < never:
                return False
            left_born = left if len(tokens[left]) > 1 else -1
            right_born = right if len(tokens[right]) > 1 else -1
            if left_born < 0 and right_born < 0:
                return True
            if left_born > right_born:
                halves = self.halves(left)
                if halves is None:
                    return False
                left_until, left = left, halves[1]
            else:
                halves = self.halves(right)
                if halves is None:
                    return False
                right_until, right = right, halves[0]

    def extend(self, data: bytes, last: list[int], start: int, stop: int) -> None:
        """Fill ``last[start:stop]``: the last token of each prefix's encoding, by the prefix's end."""
        pairs, endings = self._pairs, self.endings
        if len(pairs) > CACHE_PAIRS:
            pairs.clear()
        for end in range(start, stop):
            node, at, found = endings, end, []
            while at:  # the tokens that end here, shortest first
                at -= 1
                node = node.get(data[at])
                if node is None:
                    break
                if -1 in node:
                    found.append((at, node[-1]))
            for at, token in reversed(found):
                if at == 0:
                    if self.made(token):
                        last[end] = token
                        break
                    continue
                key = last[at] << 24 | token
                fits = pairs.get(key)
                if fits is None:
                    fits = pairs[key] = self.follows(last[at], token)
                if fits:
                    last[end] = token
                    break

    def encode_piece(self, piece: bytes) -> list[int]:
        """A whole piece that is a token is that token; any other is encoded prefix by prefix."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        return Prefixes(self, piece).tokens()

    def encode_sorted(self, pieces: list[bytes]) -> Iterator[tuple[int, ...]]:
        """``encode_piece`` of sorted pieces: what a piece shares with the one before isn't computed again."""
        ranks, tokens = self.ranks, self.tokens
        before, last = b"", [-1]
        for piece in pieces:
            whole = ranks.get(piece)
            if whole is not None:
                yield (whole,)
                continue
            shared = 0
            for a, b in zip(piece, before):  # noqa: B905
                if a != b:
                    break
                shared += 1
            end = len(piece)
            last[shared + 1 :] = [-1] * (end - shared)
            self.extend(piece, last, shared + 1, end + 1)
            before, out = piece, []
            while end:
                out.append(last[end])
                end -= len(tokens[last[end]])
            yield tuple(out[::-1])

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class Prefixes:
    """A piece's bytes with the last token of each prefix; supports exact appends and local edits."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, b"", [-1]
        self.append(data)

    def append(self, more: bytes) -> Prefixes:
        start = len(self.data) + 1
        self.data += more
        self.last += [-1] * len(more)
        self.vocabulary.extend(self.data, self.last, start, len(self.data) + 1)
        return self

    def edit(self, at: int, removed: int, put: bytes) -> int:
        """Replace ``removed`` bytes at ``at``; returns how many prefixes were computed anew."""
        old, shift = self.last, len(put) - removed
        self.data = self.data[:at] + put + self.data[at + removed :]
        n, longest = len(self.data), self.vocabulary.longest
        self.last = old[: at + 1] + [-1] * (n - at)
        agree = done = 0
        for end in range(at + 1, n + 1):
            self.vocabulary.extend(self.data, self.last, end, end + 1)
            done += 1
            before = end - shift
            # Beyond the new bytes, a last token depends on its predecessors within a token's reach only.
            agree = agree + 1 if end - longest > at + len(put) and before > 0 and old[before] == self.last[end] else 0
            if agree >= longest:
                self.last[end + 1 :] = old[before + 1 :]
                break
        return done

    def tokens(self) -> list[int]:
        out, end = [], len(self.data)
        tokens, last = self.vocabulary.tokens, self.last
        while end:
            out.append(last[end])
            end -= len(tokens[last[end]])
        return out[::-1]


class _Pieces(dict):
    """Piece to ids, computed when first asked for."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary = vocabulary

    def learn(self, found: list[list[str]]) -> None:
        """Encode the new pieces of a batch together, in order, so that they share prefixes."""
        if len(self) >= CACHE_PIECES:
            self.clear()
        new = set(chain.from_iterable(found)).difference(self)
        order = sorted((p.encode(), p) for p in new if len(p) <= CACHED_LENGTH)
        self.update(zip((p for _, p in order), self.vocabulary.encode_sorted([b for b, _ in order]), strict=True))

    def __missing__(self, piece: str) -> tuple[int, ...]:
        return tuple(self.vocabulary.encode_piece(piece.encode()))


@lru_cache(maxsize=2)
def _coder(path: str, pattern: str) -> tuple[Vocabulary, _Pieces, regex.Pattern]:
    vocabulary = Vocabulary.load(path)
    return vocabulary, _Pieces(vocabulary), regex.compile(pattern)


def _encode_all(texts: list[str], path: str, pattern: str) -> Iterator[list[int]]:
    """The ids of each text; texts are taken in groups, whose new pieces are encoded together."""
    _, pieces, split = _coder(path, pattern)
    start = held = 0
    for k, text in enumerate(texts):
        held += len(text)
        if held >= GROUP_CHARS or k + 1 == len(texts):
            found = list(map(split.findall, texts[start : k + 1]))
            pieces.learn(found)
            for f in found:
                yield list(chain.from_iterable(map(pieces.__getitem__, f)))
            start, held = k + 1, 0


def encode(text: str, path: str, pattern: str) -> list[int]:
    """Token ids of a text; each match of ``pattern`` is encoded by itself, without special tokens."""
    _, pieces, split = _coder(path, pattern)
    return list(chain.from_iterable(map(pieces.__getitem__, split.findall(text))))


def decode(ids: list[int], path: str, pattern: str) -> bytes:
    return _coder(path, pattern)[0].decode(ids)


def encode_column(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``ids array<int>`` to the id column and the columns in ``keep``.

    Defined results: a null or empty text has no ids; a long text is encoded whole; repeated rows
    each get their row; an empty table gives an empty result; other columns are not read.
    """
    source = docs.select(*(F.col(c) for c in (id_col, *keep)), text_or_empty(text_col).alias("__text"))
    fields = [f for f in source.schema.fields if f.name != "__text"]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", ids array<int>"

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            ids = pa.array(_encode_all(batch.column(batch.num_columns - 1).to_pylist(), path, pattern), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], ids], names=[*batch.schema.names[:-1], "ids"])

    return source.mapInArrow(run, ddl)


_DIGESTS = pa.schema([("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256 of every whole text, encoded and decoded again.

    Defined results as for ``encode_column``; the digests of a null or empty text are those of no
    bytes; a null id stays null.
    """
    source = docs.select(F.col(id_col), text_or_empty(text_col).alias("__text"))
    id_type = source.schema.fields[0].dataType.simpleString()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[int, str] = {}
        for batch in it:
            vocabulary = _coder(path, pattern)[0]
            if not names:
                names.update((i, str(i)) for i in vocabulary.tokens)
            made = []
            for ids in _encode_all(batch.column(1).to_pylist(), path, pattern):
                written = ",".join(map(names.__getitem__, ids)).encode()
                made.append((len(ids), hashlib.sha256(written).hexdigest(), hashlib.sha256(vocabulary.decode(ids)).hexdigest()))
            for part in batches(_DIGESTS, made, size=len(made) or 1):
                yield pa.RecordBatch.from_arrays([batch.column(0), *part.columns], names=[id_col, *_DIGESTS.names])

    return source.mapInArrow(run, f"`{id_col}` {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op4_byte_bpe(spark, sf_dir):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return round_trip(read(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)
