"""Best-fit packing of tokenised documents into sequences under several capacities at once.

Every open sequence has residual capacities for tokens, documents and attention cost (the sum of squared lengths). Pieces
go in falling order of size to the sequence that fits under every constraint and has the smallest weighted norm of what
is left ("norm"), or the smallest weighted dot product of demand and residual ("dot"). Packing runs in independent groups
of a bounded number of tokens, dealt by a hash, so that it grows with the number of tasks; each group ends with at most a
few sequences that are not full.

Defined results: a null or empty text is one piece, the end token; an empty table gives an empty one; rows that repeat a
doc_id, null or not, are documents of their own; ties go to the older sequence; extra columns are ignored. By default the
limits on documents and attention cost are as wide as a sequence of tokens allows, so they only weigh in the choice of a
sequence; narrower ones bind.
"""

from __future__ import annotations

import math
import os
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.common import materialize, tidy

_TOGETHER = 4000  # stems of letters that are encoded at a time
_REMEMBER = 300_000  # stems, and runs of marks, whose ids a worker keeps
_TEXTS = 4 << 20  # characters of texts whose words are counted once, at least one text
_MARKS = ".,;:!?|#$%&*"
_BEFORE_MARKS = r"(?s)^.*[^.,;:!?|#$%&*]"  # greedy: up to the last other character


@dataclass(frozen=True)
class Capacities:
    """Limits of a sequence. None: documents as many as tokens, attention cost as of one document of full length."""

    tokens: int = 4096
    documents: int | None = None
    attention: float | None = None

    def vector(self) -> np.ndarray:
        return np.array([self.tokens, self.documents or self.tokens, self.attention or float(self.tokens) ** 2], float)


class WordEncoder:
    """Ids of texts by a tokenizer that lower-cases, drops white space and never joins characters over it.

    Space and newline always separate, so a text's ids are those of its words in turn. Words are cut, counted once each and
    put together again as Arrow and NumPy arrays. Of a word that ends in one run of plain punctuation, which is a piece of
    its own, stem and run are encoded apart; stems of letters only go many at a time, as each ends with a token that is
    marked as a word's end. Ids of _REMEMBER stems at most are kept from one call to the next."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.letters = Tokenizer(self.tokenizer.model)  # the same merges, for what is lower-case ASCII already
        self.letters.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.known, self.pool, self.edges = pa.array([], pa.large_string()), np.zeros(0, "<u4"), np.zeros(1, np.int64)

    def _encode(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of every unit, one after the other, and where each unit's ids begin."""
        units = units.cast(pa.large_string())
        spot = pc.index_in(units, value_set=self.known)
        fresh = units.filter(pc.is_null(spot))
        new, cuts = self._fresh(fresh) if len(fresh) else (self.pool[:0], self.edges[:1])
        pool, edges = np.concatenate([self.pool, new]), np.concatenate([self.edges, cuts[1:] + len(self.pool)])
        spot = spot.to_numpy(zero_copy_only=False)
        unknown = np.isnan(spot) if spot.dtype.kind == "f" else np.zeros(len(spot), bool)
        at = np.where(unknown, len(self.known) - 1 + np.cumsum(unknown), np.nan_to_num(spot)).astype(np.int64)
        length = np.diff(edges)[at]
        if len(self.known) + len(fresh) <= _REMEMBER and fresh.nbytes + self.known.nbytes <= 16 << 20:
            self.known, self.pool, self.edges = pa.concat_arrays([self.known, fresh]), pool, edges
        elif fresh.nbytes <= 16 << 20:
            self.known, self.pool, self.edges = fresh, new, cuts
        return _ragged(pool, edges[at], length), np.concatenate([[0], np.cumsum(length)])

    def _fresh(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        letters = pc.utf8_is_alpha(units)
        ascii_only = pc.string_is_ascii(units)
        pools, where, counts = [], [], []
        rest = [np.flatnonzero(pc.invert(letters).to_numpy(zero_copy_only=False))]
        for tokenizer, chosen in ((self.letters, pc.and_(letters, ascii_only)), (self.tokenizer, pc.and_(letters, pc.invert(ascii_only)))):
            at = np.flatnonzero(chosen.to_numpy(zero_copy_only=False))
            for lo in range(0, len(at), _TOGETHER):
                part = at[lo : lo + _TOGETHER]
                ids = np.array(tokenizer.encode_batch_fast([" ".join(units.take(pa.array(part)).to_pylist())], add_special_tokens=False)[0].ids, "<u4")
                cuts = np.flatnonzero(self.ends[ids]) + 1
                if len(cuts) == len(part):
                    pools.append(ids)
                    where.append(part)
                    counts.append(np.diff(cuts, prepend=0))
                else:
                    rest.append(part)
        at = np.concatenate(rest)
        for lo in range(0, len(at), _TOGETHER):
            part = at[lo : lo + _TOGETHER]
            found = [e.ids for e in self.tokenizer.encode_batch_fast(units.take(pa.array(part)).to_pylist(), add_special_tokens=False)]
            pools.append(np.array([i for ids in found for i in ids], "<u4"))
            where.append(part)
            counts.append(np.array([len(ids) for ids in found], np.int64))
        order, count = np.concatenate(where), np.concatenate(counts)
        begin, length = np.empty(len(units), np.int64), np.empty(len(units), np.int64)
        begin[order], length[order] = np.cumsum(count) - count, count
        return _ragged(np.concatenate(pools), begin, length), np.concatenate([[0], np.cumsum(length)])

    def many(self, texts: list[str]) -> list[bytes]:
        """The ids of every text as little-endian unsigned 32-bit numbers."""
        if not texts:
            return []
        lists = pc.split_pattern(pc.replace_substring(pa.array(texts, pa.large_string()), "\n", " "), " ")
        coded = lists.values.dictionary_encode()
        words = coded.dictionary.cast(pa.large_string())
        stems = pc.utf8_rtrim(words, characters=_MARKS)
        last = pc.utf8_slice_codeunits(stems, -1)  # a letter that splits into letter and mark keeps the run beside it
        apart = pc.and_(pc.utf8_is_alnum(pc.utf8_slice_codeunits(pc.utf8_normalize(last, "NFC"), -1)), pc.not_equal(last, "\u0130"))
        stems = pc.if_else(apart, stems, words)
        # special tokens are matched before the tokenizer lower-cases: <|ENDOFTEXT|> is none
        stems = pc.if_else(pc.match_substring(stems, "<|"), stems, pc.ascii_lower(stems))
        marks = pc.utf8_slice_codeunits(words, 0, 0)
        if pc.any(apart).as_py():
            marks = pc.if_else(apart, pc.replace_substring_regex(words, _BEFORE_MARKS, ""), marks)
        units = pa.chunked_array([stems, marks]).combine_chunks().dictionary_encode()
        pool, edges = self._encode(units.dictionary)
        unit = units.indices.to_numpy().reshape(2, -1).T.ravel()  # stem and run of every word in turn
        pool, length = _ragged(pool, edges[unit], np.diff(edges)[unit]), np.diff(edges)[unit].reshape(-1, 2).sum(1)
        begin = np.cumsum(length) - length
        word = coded.indices.to_numpy()
        ids = _ragged(pool, begin[word], length[word])
        ends = np.concatenate([[0], np.cumsum(length[word])])[lists.offsets.to_numpy()].tolist()
        return [ids[lo:hi].tobytes() for lo, hi in zip(ends, ends[1:])]


def _ragged(pool: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The runs pool[begin : begin + length], one after the other."""
    ends = np.cumsum(length)
    kind = np.int32 if max(len(pool), ends[-1] if len(ends) else 0) < 1 << 31 else np.int64
    at = np.repeat((begin - ends + length).astype(kind), length)
    at += np.arange(len(at), dtype=kind)
    return pool[at]


_encoders: dict[str, WordEncoder] = {}


def token_pieces(docs: DataFrame, tokenizer: str, tokens: int = 4096, end_id: int = 1, block: int = _TEXTS) -> DataFrame:
    """doc_id, piece, start, length, ids (binary, little-endian unsigned 32 bits): every document's ids and end_id, cut
    into pieces of at most tokens ids. block: characters whose words are counted together. No shuffle."""

    @tidy
    def cut(batches):
        if tokenizer not in _encoders:
            _encoders[tokenizer] = WordEncoder(tokenizer)
        encoder = _encoders[tokenizer]
        last = np.array([end_id], "<u4").tobytes()
        step = 4 * tokens

        def flush(rows):
            ids, piece, start, length, data = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(data, pa.binary())],
                names=["doc_id", "piece", "start", "length", "ids"],
            )

        def flush_texts(ids, texts):
            rows, held = [], 0
            for doc_id, data in zip(ids, encoder.many(texts), strict=True):
                data += last
                for k, at in enumerate(range(0, len(data), step)):
                    part = data[at : at + step]
                    rows.append((doc_id, k, at // 4, len(part) // 4, part))
                    held += len(part)
                if held > 4 << 20:
                    yield flush(rows)
                    rows, held = [], 0
            if rows:
                yield flush(rows)

        for batch in batches:
            ids, texts, size = [], [], 0
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids.append(doc_id)
                texts.append(text.as_py() or "")
                size += len(texts[-1])
                if size > block:
                    yield from flush_texts(ids, texts)
                    ids, texts, size = [], [], 0
            if ids:
                yield from flush_texts(ids, texts)

    return docs.select("doc_id", "text").mapInArrow(cut, "doc_id long, piece int, start long, length long, ids binary")


def best_fit(lengths: np.ndarray, capacities: np.ndarray, weights: np.ndarray, rule: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of every length; lengths come in the order in which they are to be placed."""
    lengths = np.asarray(lengths, float)
    demand = np.stack([lengths, np.ones(len(lengths)), lengths**2], 1) / capacities
    where, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    free = np.empty((1024, 3))  # residual shares of open bins
    number, filled = np.empty(1024, np.int64), np.empty(1024, np.int64)
    n_open = made = 0
    slack = 1e-9
    least = demand[::-1, 0]
    least = np.minimum.accumulate(least)[::-1] if len(least) else least
    for i in range(len(lengths)):
        a = demand[i]
        r = free[:n_open]
        left = r - a
        ok = (left >= -slack).all(1)
        if ok.any():
            at = np.flatnonzero(ok)
            score = ((left[at] ** 2) @ weights) if rule == "norm" else (r[at] * a) @ weights
            j = at[np.argmin(score)]
        else:
            if n_open == len(free):
                free, number, filled = np.concatenate([free, np.empty_like(free)]), np.concatenate([number, np.empty_like(number)]), np.concatenate([filled, np.empty_like(filled)])
            j = n_open
            free[j], number[j], filled[j] = 1.0, made, 0
            n_open += 1
            made += 1
        free[j] -= a
        where[i], offset[i] = number[j], filled[j]
        filled[j] += int(lengths[i])
        if i % 256 == 255 and i + 1 < len(lengths):  # bins too full for whatever is still to come are closed
            live = free[:n_open, 0] >= least[i + 1] - slack
            k = int(live.sum())
            free[:k], number[:k], filled[:k] = free[:n_open][live], number[:n_open][live], filled[:n_open][live]
            n_open = k
    return where, offset


def pack_pieces(pieces: DataFrame, capacities: Capacities = Capacities(), weights=(1.0, 0.01, 0.01), rule: str = "norm", group_tokens: int = 16 << 20, most_groups: int = 100_000) -> DataFrame:
    """Adds sequence_id and offset to rows with row, doc_id, piece and length (at most capacities.tokens); row, a number of
    its own for every piece, is dropped.

    A task packs about group_tokens tokens, or more where that would make over most_groups tasks. Pieces are dealt to groups
    by a hash of row, so that no doc_id, null or repeated, gathers pieces in one of them."""
    total = pieces.agg(F.sum("length")).first()[0] or 0
    n = min(most_groups, max(1, math.ceil(total / group_tokens)))
    limits, share = capacities.vector(), np.asarray(weights, float)

    @tidy
    def pack(batches):
        table = pa.Table.from_batches(list(batches), schema=None) if (batches := [b for b in batches if b.num_rows]) else None
        if table is None:
            return
        length = table.column("length").to_numpy()
        if (length > limits[0]).any():
            raise ValueError("a piece is longer than a sequence")
        ids = table.column("doc_id").fill_null(-(1 << 62)).to_numpy()
        order = np.lexsort((table.column("row").to_numpy(), table.column("piece").to_numpy(), ids, -length))
        table = table.drop_columns(["row"])
        where, offset = best_fit(length[order], limits, share, rule)
        base = TaskContext.get().partitionId() << 32
        yield from table.take(pa.array(order)).append_column("sequence_id", pa.array(where + base)).append_column("offset", pa.array(offset)).to_batches(max_chunksize=1 << 16)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields if f.name != "row") + ", sequence_id long, offset long"
    return pieces.repartition(n, F.xxhash64("row")).mapInArrow(pack, schema)


def pack_documents(docs: DataFrame, tokenizer: str, capacities: Capacities = Capacities(), end_id: int = 1, block: int = _TEXTS, **how) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    pieces = token_pieces(docs, tokenizer, capacities.tokens, end_id, block)
    slim = pieces.select(F.monotonically_increasing_id().alias("row"), "doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return pack_pieces(materialize(slim, "pieces"), capacities, **how)
