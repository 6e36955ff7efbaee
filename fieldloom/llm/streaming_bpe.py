"""Byte-level BPE as a streaming transducer with bounded lookahead, and incremental decoding.

lookahead() computes from the merge list how far the end of what has been read can influence tokens: a merge changes only
because bytes are still missing, or because a merge of lower rank that shares a part with it changes. Tokens that end that
far before the end of the window are final; their bytes leave the window, since no merge crosses a final border. So the
window stays bounded, however long a piece is.

Decoding feeds token bytes through a UTF-8 state machine that keeps the bytes of at most one unfinished character;
malformed bytes become U+FFFD as in lossy decoding.

The classes of characters that the pattern names are those of the tokenizer's own table: where the table here differs, a
stand-in of the right class takes a character's place while a text is cut. Texts go through in slices, also those without
white space; a long piece goes through the transducer slice by slice. What a worker remembers of short pieces is bounded.

Defined results: a null text is empty: no tokens, digests of the empty string; strings of special tokens in a text are
those tokens; rows that repeat a doc_id are encoded each; an empty table gives an empty one; extra columns are ignored.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from fieldloom.llm.common import tidy

#: The public pattern of byte-level BPE that splits a text into pieces before the merges.
PIECES = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
_CUT = regex.compile(r"\S(?=\s)")  # a piece ends there for certain
_SLICE = 1 << 16
_TOGETHER = 4096  # pieces of a slice without white space that are handed on at once
#: Pieces a worker remembers, and the longest such piece. Half of them are the last ones seen, the other half older ones.
_REMEMBER, _PIECE = 800_000, 48
#: A character of each class: letter, number, white space, any other.
_STAND_INS = {"L": "a", "N": "1", "S": "\t", "O": "!"}


def stray_characters(path: str) -> list[tuple[int, int, str]]:
    """Ranges (first, last, stand-in) of the code points whose class in the tokenizer's table differs from the one here.

    All code points in a row go through the tokenizer's own cutter: its pieces are runs of one class, which one character
    of the run then tells, set behind a character of each class."""
    from tokenizers import Tokenizer

    cut = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
    here = {k: regex.compile(p) for k, p in (("L", r"\p{L}+"), ("N", r"\p{N}+"), ("S", r"\s+"), ("O", r"[^\s\p{L}\p{N}]+"))}
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    out: list[tuple[int, int, str]] = []
    for _, (lo, hi) in cut(every):
        lo += every[lo] == " " and hi - lo > 1  # a space that leads a piece of another class
        kind = next((k for k, c in _STAND_INS.items() if k != "S" and len(cut(c + every[lo])) == 1), "S")
        same = {at for m in here[kind].finditer(every, lo, hi) for at in range(*m.span())}
        for at in range(lo, hi) if len(same) < hi - lo else ():
            if at not in same:
                c = ord(every[at])
                if out and out[-1][1] == c - 1 and out[-1][2] == _STAND_INS[kind]:
                    out[-1] = (out[-1][0], c, out[-1][2])
                else:
                    out.append((c, c, _STAND_INS[kind]))
    return out


def byte_characters() -> dict[str, int]:
    """The public mapping of byte-level BPE: printable Latin-1 characters are their own byte, the others follow from U+0100."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Vocabulary:
    """A tokenizer file's merges on ids, token bytes and special tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, chars = spec["model"], byte_characters()
        ids: dict[str, int] = model["vocab"]
        self.bytes_of: dict[int, bytes] = {i: bytes(chars[c] for c in t) for t, i in ids.items() if all(c in chars for c in t)}
        self.byte_ids = [0] * 256
        for c, b in chars.items():
            self.byte_ids[b] = ids[c]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"] or []}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        #: left << 32 | right -> rank << 32 | merged; a pair listed again keeps its last rank, as in a map.
        self.merges: dict[int, int] = {}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        for rank, (a, b) in enumerate(pairs):
            self.merges[ids[a] << 32 | ids[b]] = rank << 32 | ids[a + b]
        self.size = {i: len(b) for i, b in self.bytes_of.items()}

    def lookahead(self) -> int:
        """Bytes before the end of a window from which on every token is final.

        reach of a merge: how far before a window's end it may begin and still come out differently with more bytes. It is
        at least its length less one (it may cross the end); it grows to the left over the parts that it shares with a
        merge of lower rank that itself may come out differently."""
        size = self.size
        order = sorted(((v >> 32, v & 0xFFFFFFFF, k >> 32, k & 0xFFFFFFFF) for k, v in self.merges.items()))
        made: dict[int, int] = {}  # reach of the merges that make a token
        by_left: dict[int, int] = {}  # greatest reach so far of merges with this left part
        by_right: dict[int, int] = {}  # greatest reach so far, less the left part, of merges with this right part
        most = 0
        for _, token, left, right in order:
            reach = size[token] - 1
            reach = max(reach, made.get(left, 0), by_left.get(left, 0), by_right.get(left, 0))
            reach = max(reach, size[left] + max(made.get(right, 0), by_left.get(right, 0)))
            made[token] = max(made.get(token, 0), reach)
            by_left[left] = max(by_left.get(left, 0), reach)
            by_right[right] = max(by_right.get(right, 0), reach - size[left])
            most = max(most, reach)
        return most


_NONE = 1 << 62


def merge(ids: list[int], merges: dict[int, int]) -> list[int]:
    """Apply merges to a list of ids, which is changed: lowest rank first, from the left."""
    get = merges.get
    found = [get(a << 32 | b, _NONE) for a, b in zip(ids, ids[1:])]  # noqa: B905
    while found:
        best = min(found)
        if best == _NONE:
            break
        i = found.index(best)
        new = best & 0xFFFFFFFF
        ids[i] = new
        del ids[i + 1], found[i]
        if i:
            found[i - 1] = get(ids[i - 1] << 32 | new, _NONE)
        if i < len(found):
            found[i] = get(new << 32 | ids[i + 1], _NONE)
    return ids


class Transducer:
    """Encodes one piece of any length from a stream of bytes; feed() and end() return the ids that have become final."""

    def __init__(self, vocabulary: Vocabulary, lookahead: int | None = None):
        self.vocabulary = vocabulary
        self.lookahead = vocabulary.lookahead() if lookahead is None else lookahead
        self.window = bytearray()
        self.most = 0  # the most bytes that the window ever held

    def feed(self, data: bytes) -> list[int]:
        out: list[int] = []
        room = 2 * self.lookahead + 256
        for at in range(0, len(data), room):
            self.window += data[at : at + room]
            self.most = max(self.most, len(self.window))
            if len(self.window) >= room:
                out += self._final(self.lookahead)
        return out

    def end(self) -> list[int]:
        return self._final(0)

    def _final(self, keep: int) -> list[int]:
        v = self.vocabulary
        ids = merge([v.byte_ids[b] for b in self.window], v.merges)
        if not keep:
            self.window.clear()
            return ids
        used = n = 0
        for i in ids:
            if used + v.size[i] > len(self.window) - keep:
                break
            used += v.size[i]
            n += 1
        del self.window[:used]
        return ids[:n]


class Decoder:
    """Ids to text, piece by piece; between calls it keeps the bytes of at most one unfinished character."""

    def __init__(self, vocabulary: Vocabulary):
        self.bytes_of = vocabulary.bytes_of
        self.machine = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        return self.machine.decode(b"".join(map(self.bytes_of.__getitem__, ids)))

    def feed_bytes(self, data: bytes) -> str:
        return self.machine.decode(data)

    def end(self) -> str:
        return self.machine.decode(b"", True)


class Codec:
    """Whole texts through the transducer; short pieces are remembered as (ids as text, bytes of their tokens).

    strays: of stray_characters, where that is at hand."""

    def __init__(self, path: str, strays: list[tuple[int, int, str]] | None = None):
        self.vocabulary = Vocabulary(path)
        self.lookahead = self.vocabulary.lookahead()
        self.known: dict[str, tuple[bytes, bytes]] = {}
        self.older: dict[str, tuple[bytes, bytes]] = {}
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.vocabulary.special, key=len, reverse=True))) + ")") if self.vocabulary.special else None
        strays = stray_characters(path) if strays is None else strays
        self.stand_ins = {c: x for lo, hi, x in strays for c in range(lo, hi + 1)}
        self.first_stray = min(self.stand_ins, default=0)
        self.strays = re.compile("[" + "".join(f"{chr(lo)}-{chr(hi)}" for lo, hi, _ in strays) + "]") if strays else None

    def piece_ids(self, piece: str) -> list[int]:
        data = piece.encode("utf-8")
        v = self.vocabulary
        if len(data) <= self.lookahead:  # within the window: no token is final before the end
            return merge([v.byte_ids[b] for b in data], v.merges)
        t = Transducer(v, self.lookahead)
        return t.feed(data) + t.end()

    def _made(self, ids: list[int]) -> tuple[bytes, bytes]:
        return b",".join(b"%d" % i for i in ids), b"".join(map(self.vocabulary.bytes_of.__getitem__, ids))

    def _digest(self, piece: str) -> tuple[bytes, bytes]:
        made = self.older.get(piece) or self._made(self.piece_ids(piece))
        if len(piece) <= _PIECE:
            if len(self.known) >= _REMEMBER // 2:
                self.older, self.known = self.known, {}
            self.known[piece] = made
        return made

    def _joined(self, pieces: list[str]) -> tuple[bytes, bytes]:
        known, make = self.known, self._digest
        got = [known.get(p) or make(p) for p in pieces]
        return b",".join([g[0] for g in got]), b"".join([g[1] for g in got])

    def _streamed(self, text: str, lo: int, hi: int) -> Iterator[tuple[bytes, bytes]]:
        """One long piece, text[lo:hi], through the transducer; ids are handed on as they become final."""
        t = Transducer(self.vocabulary, self.lookahead)
        for at in range(lo, hi, _SLICE):
            ids = t.feed(text[at : min(at + _SLICE, hi)].encode("utf-8"))
            if ids:
                yield self._made(ids)
        yield self._made(t.end())

    def _unbroken(self, text: str, shape: str, at: int) -> Iterator[tuple[bytes, bytes] | int]:
        """Pieces from at on until a slice is done, then where they end; for stretches without white space."""
        held, end = [], at
        for m in PIECES.finditer(shape, at):
            lo, end = m.span()
            if end - lo > _SLICE:
                if held:
                    yield self._joined(held)
                    held = []
                yield from self._streamed(text, lo, end)
            else:
                held.append(text[lo:end])
                if len(held) >= _TOGETHER:
                    yield self._joined(held)
                    held = []
            if end - at >= _SLICE:
                break
        if held:
            yield self._joined(held)
        yield end

    def _shape(self, part: str) -> str:
        """part, with stand-ins for characters whose class differs; itself where it has none."""
        if self.strays is None or part.isascii():
            return part
        try:
            part.encode("latin-1")  # the fast way to tell that all are below the first stray one
            return part if self.first_stray > 0xFF else part.translate(self.stand_ins)
        except UnicodeEncodeError:
            return part.translate(self.stand_ins) if self.strays.search(part) else part

    def segments(self, text: str) -> Iterator[tuple[bytes, bytes]]:
        """(ids in decimal joined by commas, bytes of the tokens) of successive slices of a text."""
        for part in self.special.split(text) if self.special else [text]:
            if part in self.vocabulary.special:
                yield b"%d" % self.vocabulary.special[part], part.encode()
                continue
            shape = self._shape(part)
            at = 0
            while at < len(part):
                end = len(part)
                if end - at > _SLICE:
                    cut = _CUT.search(shape, at + _SLICE, at + 2 * _SLICE)
                    if cut is None:
                        for made in self._unbroken(part, shape, at):
                            if isinstance(made, int):
                                at = made
                            else:
                                yield made
                        continue
                    end = cut.start() + 1
                yield self._joined(PIECES.findall(part, at, end) if shape is part else [part[m.start() : m.end()] for m in PIECES.finditer(shape, at, end)])
                at = end

    def encode(self, text: str) -> list[int]:
        return [int(i) for ids, _ in self.segments(text) for i in ids.split(b",")]

    def decode(self, ids: Iterable[int]) -> str:
        d = Decoder(self.vocabulary)
        return d.feed(ids) + d.end()

    def digests(self, text: str) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the ids, SHA-256 of the decoded text."""
        n, ids_hash, text_hash, decoder = 0, hashlib.sha256(), hashlib.sha256(), Decoder(self.vocabulary)
        for ids, data in self.segments(text):
            ids_hash.update(b"," + ids if n else ids)
            n += ids.count(b",") + 1
            text_hash.update(decoder.feed_bytes(data).encode("utf-8"))
        text_hash.update(decoder.end().encode("utf-8"))
        return n, ids_hash.hexdigest(), text_hash.hexdigest()


_codecs: dict[str, Codec] = {}


def codec(path: str, strays: list[tuple[int, int, str]] | None = None) -> Codec:
    """The worker's codec of a tokenizer file."""
    if path not in _codecs:
        _codecs[path] = Codec(path, strays)
    return _codecs[path]


def encode_documents(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, ids (array of int), decoded (text decoded from them) of every row; no shuffle."""
    strays = stray_characters(tokenizer)

    @tidy
    def run(batches):
        c = codec(tokenizer, strays)
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = c.encode(text.as_py() or "")
                yield pa.RecordBatch.from_arrays([pa.array([doc_id], pa.int64()), pa.array([ids], pa.list_(pa.int32())), pa.array([c.decode(ids)], pa.string())], names=["doc_id", "ids", "decoded"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def digest_documents(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row: encoded and decoded slice by slice, without keeping either."""
    strays = stray_characters(tokenizer)

    @tidy
    def run(batches):
        c = codec(tokenizer, strays)
        for batch in batches:
            rows = [c.digests(t.as_py() or "") for t in batch.column("text")]
            n, a, b = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
