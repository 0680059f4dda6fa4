"""Byte-level BPE by backtracking from longest matches."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wrenchlake.llm.common import bounded_batches

#: Bytes of encodings of chunks (a word and the white space before it) that a task keeps, in two halves: when the younger is full, the older goes.
#: A worker that is used again keeps them for the next task.
CACHED_BYTES = 256 << 20
CACHED_LENGTH, ENTRY = 48, 350
#: Pairs of a token and a longest match after it whose compatible prefix a task remembers, about 200 bytes each.
FITS = 100_000
#: The characters of the property White_Space, which ``\\s`` of the split pattern matches.
WHITE = "\t-\r \u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

CODED = "struct<n_tokens: long, ids_sha256: string, decoded_sha256: string>"


class ByteCodec:
    """Encoder and decoder of one rank file and split pattern; no special tokens.

    A match of the pattern is coded alone. The automaton gives the longest token at a byte. From the left, the
    longest token is taken that is compatible with the one before it (both, merged as one string, stay as they are); if none of its own
    prefixes that are tokens is, the place is marked dead and the last token gives way to its next shorter prefix. As every
    prefix of a text has one encoding and neighbours decide validity, the first way through is the encoding that merging by rank makes.
    Each place is marked dead once at most, so the work is linear in the bytes.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.bytes_of = {i: t for t, i in ranks.items()}
        if len(self.bytes_of) != len(ranks) or any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("ranks must be distinct and hold every byte")
        self.pattern = regex.compile(pattern)
        self.chunks = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
        halves = {t: two for t in ranks if len(t) > 1 and (two := self._halves(t))}
        # tokens that merging can't make are only ever whole matches; the automaton has the others, a Latin-1 character for each byte
        made = [*halves, *[bytes([b]) for b in range(256)]]
        self.automaton = ahocorasick.Automaton()
        for t in made:
            self.automaton.add_word(t.decode("latin-1"), ranks[t])
        self.halves = {ranks[t]: (ranks[a], ranks[b]) for t, (a, b) in halves.items()}
        known, n = set(made), max(self.bytes_of) + 1
        self.size, self.shorter = [0] * n, [-1] * n  # by id: bytes, and the longest token that is a proper prefix
        for t in made:
            self.size[ranks[t]] = len(t)
            self.shorter[ranks[t]] = next((ranks[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in known), -1)
        self.id_of = {t.decode("latin-1"): i for t, i in ranks.items()}
        self.decimal = {i: str(i) for i in self.bytes_of}
        #: By each path into the automaton, the longest token along it.
        self.longest: dict[str, int] = {}
        for t in sorted(made, key=len):
            path = t.decode("latin-1")
            for k in range(1, len(path)):
                if path[:k] not in self.longest:
                    self.longest[path[:k]] = self.longest[path[: k - 1]]
            self.longest[path] = ranks[t]
        self.most = max(map(len, made))
        self.following = lru_cache(FITS)(self._next)
        self.kept = _Kept(self._chunk)

    def _halves(self, token: bytes) -> tuple[bytes, bytes] | None:
        """The two tokens whose merge makes the token when its bytes are merged by rank, leftmost of equals first; None if that ends elsewhere."""
        ranks, parts = self.ranks, [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best = min(((ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks), default=None)
            if best is None:
                return None
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        return (parts[0], parts[1])

    def _fits(self, left: int, right: int) -> bool:
        """Whether merging both tokens' bytes as one string ends with these two tokens.

        The merges are undone from the last one back. While the border stands between two parts, these must not have been merged with each
        other before the earlier undone part was made; of equal ranks the left merge comes first.
        """
        ranks, halves, bytes_of = self.ranks, self.halves, self.bytes_of
        before, ties = 1 << 62, False
        while True:
            across = ranks.get(bytes_of[left] + bytes_of[right])
            if across is not None and (across < before or ties and across == before):
                return False
            a, b = left if left in halves else -1, right if right in halves else -1
            if a < 0 and b < 0:
                return True
            if b >= a:  # the right part was made last
                before, ties, right = b, True, halves[right][0]
            else:
                before, ties, left = a, False, halves[left][1]

    def _next(self, last: int, token: int) -> int:
        """The longest of the token and its prefixes that are tokens which is compatible with the token before it; -1 for none."""
        while token >= 0 and not self._fits(last, token):
            token = self.shorter[token]
        return token

    def split(self, piece: str) -> list[int]:
        """The ids of one match of the pattern, given with a Latin-1 character for each byte."""
        whole = self.id_of.get(piece)
        if whole is not None:
            return [whole]
        n, reach, longest, most, size, following = len(piece), self.automaton.longest_prefix, self.longest, self.most, self.size, self.following
        last = longest[piece[: reach(piece)]]
        out, at, dead = [last], size[last], set()
        while at < n:
            ahead = piece[at : at + most]
            token = following(last, longest[ahead[: reach(ahead)]])
            while dead and token >= 0 and at + size[token] in dead:
                token = following(last, self.shorter[token])
            while token < 0:  # nothing goes on from here: the last token gives way to a shorter one
                dead.add(at)
                token = self.shorter[out.pop()]
                at -= size[last]
                last = out[-1] if out else -1
                while token >= 0 and (at + size[token] in dead or last >= 0 and not self._fits(last, token)):
                    token = self.shorter[token]
            out.append(token)
            at += size[token]
            last = token
        return out

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        for piece in self.pattern.findall(text):
            ids += self.split(piece if piece.isascii() else piece.encode("utf-8").decode("latin-1"))
        return ids

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.bytes_of[i] for i in ids])

    def _chunk(self, chunk: str) -> tuple[int, str, bytes]:
        """Number of ids, the ids in decimal, and the bytes they decode to."""
        ids = self.encode(chunk)
        return len(ids), " ".join([self.decimal[i] for i in ids]), self.decode(ids)

    def coded(self, text: str) -> tuple[int, str, bytes]:
        """As ``_chunk``, of a whole text. It is cut before white space that follows another character: no match of the pattern goes on
        there, and what a match looks ahead at is in the same chunk."""
        if not text:
            return 0, "", b""
        numbers, ids, decoded = zip(*map(self.kept.__getitem__, self.chunks.findall(text)), strict=True)
        return sum(numbers), " ".join(ids), b"".join(decoded)

    def forget(self) -> None:
        """Empty the caches."""
        self.kept.empty()
        self.following.cache_clear()


class _Kept(dict):
    """Encodings by chunk, made where missing, in two generations: when the younger is full, the older goes."""

    def __init__(self, make):
        super().__init__()
        self.make = make
        self.empty()

    def __missing__(self, chunk: str) -> tuple[int, str, bytes]:
        out = self.old.get(chunk) or self.make(chunk)
        if len(chunk) <= CACHED_LENGTH:
            if self.bytes >= CACHED_BYTES // 2:
                old = dict(self)
                self.empty()
                self.old = old
            self[chunk] = out
            self.bytes += ENTRY + 4 * len(chunk) + len(out[1]) + len(out[2])
        return out

    def empty(self) -> None:
        self.clear()
        self.old: dict[str, tuple[int, str, bytes]] = {}
        self.bytes = 0


_codecs: dict[bytes, ByteCodec] = {}


def _codec(ranks: bytes, pattern: str) -> ByteCodec:
    """The worker's codec, made once; another file's goes."""
    key = hashlib.sha256(ranks + pattern.encode()).digest()
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = ByteCodec(parse_ranks(ranks), pattern)
    return _codecs[key]


def parse_ranks(file: bytes) -> dict[bytes, int]:
    """Lines of a token in base64, a space and its rank."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file.splitlines()) if token}


def digests(text: Column, ranks: bytes, pattern: str) -> Column:
    """A struct of the number of ids, the SHA-256 of the decimal ids joined by one space and that of the decoded bytes; ``text`` is binary, not null."""
    bounded_batches()

    @F.pandas_udf(CODED)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        codec = _codec(ranks, pattern)
        for batch in batches:
            rows = []
            for raw in batch:
                n, ids, decoded = codec.coded(str(raw, "utf-8", "replace"))
                rows.append((n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded).hexdigest()))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return run(text)


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` per row: whole texts encoded by the rank file, then decoded again.

    Null texts count as empty, which has no ids; bytes that aren't UTF-8 count as U+FFFD. Null ids and repeated rows are kept, other columns are
    not read, whatever their names; an empty table gives an empty one. A text is one value of a row, so a task holds the texts of one batch
    at a time. No shuffle.
    """
    with open(ranks_path, "rb") as file:
        ranks = file.read()
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    return docs.select(F.col(id_col).alias("doc_id"), digests(text, ranks, pattern).alias("coded")).select("doc_id", "coded.*")
