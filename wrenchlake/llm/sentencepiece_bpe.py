"""SentencePiece BPE by a table of each prefix's last token."""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pandas as pd
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wrenchlake.llm.common import bounded_batches, text_of

SPACE = "▁"
#: Bytes of encodings of chunks (a word and the spaces before it) that a worker keeps from task to task, in two halves: when the younger is
#: full, the older goes. An entry takes ``ENTRY`` bytes besides what it holds. With ``SMALL_BYTES``, for stages that share executors with much else, all go when a
#: task ends.
CACHED_BYTES, SMALL_BYTES = 256 << 20, 48 << 20
CACHED_LENGTH, ENTRY = 64, 350
#: Pairs of tokens whose compatibility a task remembers, about 200 bytes each.
FITS = 100_000

ENCODED = "struct<n_tokens: long, ids_sha256: string, decoded_sha256: string>"


class PieceCodec:
    """Encoder and decoder of one BPE model of byte fallback and identity normalisation.

    The state of a text is one number per prefix: the last token of the prefix's encoding, which is unique. For
    the prefix ending at position e it is the one token that the automaton finds ending at e, that starts
    at some s where the prefix ending at s has last token t, and that is compatible with t: t and it, encoded
    as one string, stay as they are. Following last tokens back from the end gives the encoding. Texts are cut before each
    run of spaces that follows another character and at characters that no longer piece holds; no merge crosses
    such a cut, since no piece does.
    """

    def __init__(self, model: bytes):
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.bos, self.eos, self.unk = sp.bos_id(), sp.eos_id(), sp.unk_id()
        self.pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        self.byte_id, self.byte_of, self.rank, self.id = {}, {}, {}, {}
        for i, piece in enumerate(self.pieces):
            if sp.is_byte(i):
                self.byte_id[int(piece[3:5], 16)], self.byte_of[i] = i, int(piece[3:5], 16)
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.rank[piece], self.id[piece] = -sp.get_score(i), i
        if len(self.byte_id) != 256:
            raise ValueError("the model has no byte fallback")
        if any(SPACE in p.lstrip(SPACE) for p in self.pieces if p in self.id):
            raise ValueError("pieces reach over word borders")
        joined = {c for p in self.id if len(p) > 1 for c in p}
        self.alone = re.compile("|".join(map(re.escape, sorted({"\n", "\r", "\t"} - joined))) or r"(?!)")
        self.chunks = re.compile(rf"[\n\r\t]|{SPACE}*[^{SPACE}\n\r\t]+|{SPACE}+" if not {"\n", "\r", "\t"} & joined else rf"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self.halves: dict[str, tuple[str, str]] = {}
        self.automaton = ahocorasick.Automaton()
        for p in self.id:
            if len(p) > 1 and (halves := self._halves(p)):  # pieces that merging can't make are never last
                self.halves[p] = halves
                self.automaton.add_word(p, (len(p), p))
        self.automaton.make_automaton()
        if any(self.rank[h] > self.rank[p] for p, two in self.halves.items() for h in two if h in self.halves):
            raise ValueError("a piece ranks before what it is made of")
        self.fits = lru_cache(FITS)(self._fits)
        self.kept = _Kept(self._chunk)
        self.meaning = [self._meaning(i) for i in range(len(self.pieces))]

    def _halves(self, piece: str) -> tuple[str, str] | None:
        """The two tokens whose merge makes the piece, by the merge rule: best-ranked neighbours first, leftmost of
        equals. None if merging its characters ends elsewhere."""
        parts = list(piece)
        while len(parts) > 2:
            best = min(((self.rank[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.rank), default=None)
            if best is None:
                return None
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        return (parts[0], parts[1]) if len(parts) == 2 and parts[0] + parts[1] == piece else None

    def _fits(self, left: str, right: str) -> bool:
        """Whether the encoding of both tokens as one string is these two tokens.

        Merges are undone from the last one back. At each time the tokens at the border must not have merged before
        either of them was merged further; of equal ranks the leftmost merge is the first.
        """
        rank, halves = self.rank, self.halves
        none = float("inf")
        limit, strict = none, False  # the border's tokens must not merge before this rank
        while True:
            crossing = rank.get(left + right, none)
            if crossing < limit or (strict and crossing == limit and crossing != none):
                return False
            a = rank[left] if left in halves else -none
            b = rank[right] if right in halves else -none
            if a == b == -none:
                return True
            if b > a or (a == b and right in halves):  # the right token was made last
                limit, strict, right = b, True, halves[right][0]
            else:
                limit, strict, left = a, False, halves[left][1]

    def last_tokens(self, chunk: str) -> list[str]:
        """For every prefix of the chunk, the last token of its encoding: a longer piece that fits, else the last character."""
        last, done, fits = list(chunk), -1, self.fits
        for end, (n, piece) in self.automaton.iter(chunk):
            if end != done and (n > end or fits(last[end - n], piece)):
                last[end], done = piece, end
        return last

    def split(self, chunk: str) -> list[str]:
        """The chunk's tokens, found backwards."""
        last, out, end = self.last_tokens(chunk), [], len(chunk)
        while end:
            out.append(last[end - 1])
            end -= len(out[-1])
        return out[::-1]

    def ids_of(self, chunk: str) -> list[int]:
        ids = []
        for token in self.split(chunk):
            known = self.id.get(token)
            ids += [known] if known is not None else [self.byte_id[b] for b in token.encode("utf-8", "replace")]
        return ids

    def _meaning(self, i: int) -> bytes:
        """What a piece stands for: spaces as such, a byte, or nothing for a control piece."""
        if i in self.byte_of:
            return bytes([self.byte_of[i]])
        return b" \xe2\x81\x87 " if i == self.unk else b"" if i in (self.bos, self.eos) else self.pieces[i].replace(SPACE, " ").encode("utf-8")

    def bytes_of(self, ids: list[int]) -> bytes:
        return b"".join([self.meaning[i] for i in ids])

    def _chunk(self, chunk: str) -> tuple[bytes, bytes]:
        """The chunk's ids as unsigned 32-bit integers, and what they decode to."""
        ids = self.ids_of(chunk)
        return array("I", ids).tobytes(), self.bytes_of(ids)

    def forget(self) -> None:
        """Empty the caches."""
        self.kept.empty()
        self.fits.cache_clear()

    def encode_decode(self, text: str) -> tuple[bytes, bytes]:
        """Ids with begin and end, packed little-endian, and the bytes they decode to (one leading space is dropped)."""
        parts = map(self.kept.__getitem__, self.chunks.findall((" " + text).replace(" ", SPACE)) if text else [])
        ids, decoded = ([b"".join(x) for x in zip(*parts, strict=True)] or [b"", b""])
        ids = array("I", [self.bos]).tobytes() + ids + array("I", [self.eos]).tobytes()
        return ids, decoded[1:] if decoded[:1] == b" " else decoded

    def encode(self, text: str) -> list[int]:
        return array("I", self.encode_decode(text)[0]).tolist()

    def decode(self, ids: list[int]) -> str:
        """The text of ids; bytes that aren't UTF-8 become U+FFFD, one each."""
        raw = self.bytes_of([i for i in ids if i not in (self.bos, self.eos)])
        first = next((i for i in ids if i not in (self.bos, self.eos)), None)
        raw = raw[1:] if first is not None and first not in self.byte_of and first != self.unk and raw[:1] == b" " else raw
        out, at = [], 0
        while at < len(raw):
            try:
                out.append(raw[at:].decode("utf-8"))
                break
            except UnicodeDecodeError as e:
                out.append(raw[at : at + e.start].decode("utf-8") + "�")
                at += e.start + 1
        return "".join(out)


class _Kept(dict):
    """Encodings by chunk, made where missing, of at most ``limit`` bytes in two generations."""

    def __init__(self, make):
        super().__init__()
        self.make, self.limit = make, CACHED_BYTES
        self.empty()

    def __missing__(self, chunk: str) -> tuple[bytes, bytes]:
        out = self.old.get(chunk) or self.make(chunk)
        if len(chunk) <= CACHED_LENGTH:
            if self.bytes >= self.limit // 2:
                young = dict(self)
                self.empty()
                self.old = young
            self[chunk] = out
            self.bytes += ENTRY + 4 * len(chunk) + len(out[0]) + len(out[1])
        return out

    def empty(self) -> None:
        self.clear()
        self.old: dict[str, tuple[bytes, bytes]] = {}
        self.bytes = 0


_codecs: dict[bytes, PieceCodec] = {}


def _codec(model: bytes, limit: int = CACHED_BYTES) -> PieceCodec:
    """The worker's codec of this model, made once; another model's goes."""
    key = hashlib.sha256(model).digest()
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = PieceCodec(model)
    _codecs[key].kept.limit = limit
    return _codecs[key]


def read_model(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def digests(text: Column, model: bytes) -> Column:
    """A struct of the number of ids, the SHA-256 of the packed ids and that of the decoded text.

    ``text`` must not be null. The model's bytes go to the tasks with the function.
    """

    bounded_batches()

    @F.pandas_udf(ENCODED)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        codec = _codec(model)
        for batch in batches:
            rows = []
            for text in batch:
                ids, decoded = codec.encode_decode(text)
                rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest()))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return run(text)


def token_ids(text: Column, model: bytes) -> Column:
    """The packed ids, unsigned 32-bit little-endian. Its caches are small and go with the task."""

    bounded_batches()

    @F.pandas_udf("binary")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = _codec(model, SMALL_BYTES)
        try:
            for batch in batches:
                yield pd.Series([codec.encode_decode(t)[0] for t in batch], dtype=object)
        finally:
            codec.forget()

    return run(text)


def encode_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` per row; null texts count as empty, repeated rows and
    null ids are kept, other columns are not read. No shuffle."""
    coded = digests(text_of(text_col), read_model(model_path))
    return docs.select(F.col(id_col).alias("doc_id"), coded.alias("coded")).select("doc_id", "coded.*")
