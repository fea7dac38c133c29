"""Piece vocabularies: agenda encoding of merge-type models, and unigram counts over a shared trie.

Texts are cut into *chunks* at places no piece spans (before a word mark, around line
ends), so chunks are encoded independently and each distinct one only once per batch.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import record_batch, slices

MARK = "▁"
#: Chunks wider than this go through the heap one by one.
WIDE = 64
#: Entries that a worker remembers between batches; then it starts afresh.
REMEMBERED = 400_000
#: How far below the worst piece an unknown character scores.
UNKNOWN_PENALTY = 10.0


#: Rank of no pair, and the sizes of the tables of pairs and pieces.
NONE, SLOT_BITS, PIECE_BITS = 1 << 30, 20, 18


def taken(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The runs of ``values`` that belong to ``rows``, one after another."""
    n = sizes[rows]
    shift = np.repeat(starts[rows] - (np.cumsum(n) - n), n)
    return values[shift + np.arange(len(shift))]


class Places:
    """Open-addressed table of distinct 64-bit keys: the place of each, -1 for others."""

    def __init__(self, keys: np.ndarray, bits: int) -> None:
        self.keys, self.bits = np.append(keys.astype(np.uint64), np.uint64(0)), bits
        self.slots = np.full(1 << bits, -1, dtype=np.int32)
        for k, at in enumerate(self._slot(self.keys[:-1]).tolist()):
            while self.slots[at] >= 0:
                at = (at + 1) & ((1 << bits) - 1)
            self.slots[at] = k

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * BASE) >> np.uint64(64 - self.bits)).astype(np.int64)

    def of(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        found = self.slots[slot]
        open_ = np.flatnonzero((self.keys[found] != keys) & (found >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            found[open_] = self.slots[slot[open_]]
            open_ = open_[(self.keys[found[open_]] != keys[open_]) & (found[open_] >= 0)]
        return found


class Met:
    """Ids of the chunks a worker has met: a number for each chunk, all ids in one array, and whether the library agreed."""

    def __init__(self) -> None:
        self.number: dict[str, int] = {}
        self.values, self.starts, self.sizes = np.zeros(1 << 16, np.int32), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.agreed = np.zeros(1 << 14, bool)
        self.used = 0

    def add(self, chunks: list[str], values: np.ndarray, sizes: np.ndarray, agreed: np.ndarray) -> None:
        """New chunks, in the order in which ``number`` already holds them."""
        first = len(self.number) - len(chunks)
        self.values = self._room(self.values, self.used + len(values))
        self.starts, self.sizes, self.agreed = (self._room(x, len(self.number)) for x in (self.starts, self.sizes, self.agreed))
        self.agreed[first : len(self.number)] = agreed
        self.values[self.used : self.used + len(values)] = values
        self.starts[first : len(self.number)] = self.used + np.cumsum(sizes) - sizes
        self.sizes[first : len(self.number)] = sizes
        self.used += len(values)

    @staticmethod
    def _room(array: np.ndarray, size: int) -> np.ndarray:
        return array if len(array) >= size else np.concatenate([array, np.zeros(max(len(array), size - len(array)), array.dtype)])


class Vocabulary:
    """Pieces, scores and merge pairs of a sentencepiece model file."""

    def __init__(self, path: str) -> None:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        kinds = model.SentencePiece
        self.score = {p.piece: p.score for p in model.pieces if p.type == kinds.NORMAL}
        self.id = {p.piece: i for i, p in enumerate(model.pieces) if p.type == kinds.NORMAL}
        self.bytes = {int(p.piece[1:-1], 16): i for i, p in enumerate(model.pieces) if p.type == kinds.BYTE}
        self.unknown = next(i for i, p in enumerate(model.pieces) if p.type == kinds.UNKNOWN)
        #: What a worker has met: ids of chunks, and their unigram counts.
        self.met = Met()
        self.counted: dict[str, int] = {}
        self.prefixed = model.normalizer_spec.add_dummy_prefix
        self.plain = not model.normalizer_spec.precompiled_charsmap and not model.normalizer_spec.remove_extra_whitespaces
        spanned = {c for p in self.id if len(p) > 1 for c in p}
        cuts = "".join(re.escape(c) for c in "\n\t\r" if c not in spanned)
        inner = any(MARK in p[1:].lstrip(MARK) or (MARK in p and not p.startswith(MARK)) for p in self.id)
        self.chunk = re.compile(f"[{cuts}]|{MARK}*[^{MARK}{cuts}]+|{MARK}+" if not inner else r"(?s).+")
        self.symbol = dict(self.id)
        for c in {c for p in self.id for c in p} - set(self.id):
            self.symbol[c] = len(model.pieces) + len(self.symbol)
        self.many = len(model.pieces) + len(self.symbol) + 1
        ranks = {x: k for k, x in enumerate(sorted(set(self.score.values()), reverse=True))}
        pairs = [(self.symbol[p[:k]] * self.many + self.symbol[p[k:]], self.id[p], ranks[self.score[p]]) for p in self.id for k in range(1, len(p)) if p[:k] in self.symbol and p[k:] in self.symbol]
        self.pair = np.array([x[0] for x in pairs] + [-1])
        self.merged = np.array([x[1] for x in pairs] + [0], dtype=np.int32)
        self.rank = np.array([x[2] for x in pairs] + [NONE], dtype=np.int32)
        self.places = Places(self.pair[:-1], SLOT_BITS)
        self.spelled = [str(i) for i in range(len(model.pieces))]
        self._strings = {i: p for p, i in self.symbol.items()}
        self._symbols = np.full(0x110000, -1, dtype=np.int32)
        for p, i in self.symbol.items():
            if len(p) == 1:
                self._symbols[ord(p)] = i
        self._final = np.zeros(self.many, dtype=bool)
        self._final[list(self.id.values())] = True

    def chunks(self, text: str) -> list[str]:
        return self.chunk.findall((MARK if self.prefixed else "") + text.replace(" ", MARK)) if text else []

    def ids(self, symbols: list[str]) -> list[int]:
        out: list[int] = []
        for s in symbols:
            if s in self.id:
                out.append(self.id[s])
            elif self.bytes:
                out += [self.bytes[b] for b in s.encode("utf-8", "replace")]
            else:
                out.append(self.unknown)
        return out

    # ------------------------------------------------------------ agenda, one chunk

    def agenda(self, chunk: str) -> list[int]:
        """Best adjacent pair first, leftmost among equals, until no pair is a piece."""
        part: list[str] = list(chunk)
        after, before = list(range(1, len(part) + 1)), list(range(-1, len(part) - 1))
        queue: list[tuple[float, int, str]] = []

        def offer(left: int) -> None:
            right = after[left] if left >= 0 else len(part)
            if left >= 0 and right < len(part) and (both := part[left] + part[right]) in self.score:
                heapq.heappush(queue, (-self.score[both], left, both))

        for k in range(len(part) - 1):
            offer(k)
        while queue:
            _, left, both = heapq.heappop(queue)
            right = after[left]
            if not part[left] or right >= len(part) or part[left] + part[right] != both:
                continue
            part[left], part[right] = both, ""
            after[left] = after[right]
            if after[left] < len(part):
                before[after[left]] = left
            offer(before[left])
            offer(left)
        return self.ids([p for p in part if p])

    # ------------------------------------------------------------ agenda, many chunks at once

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Place of each adjacent pair in the pair tables; -1, the last place, where they don't merge."""
        wanted = left.astype(np.int64) * self.many + right
        wanted[(left < 0) | (right < 0)] = -2
        return self.places.of(wanted.view(np.uint64))

    def agendas(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """``agenda`` of every chunk: all ids in a row, and how many each chunk has."""
        lengths = np.array([len(c) for c in chunks], dtype=np.int64)
        order = np.argsort(lengths, kind="stable")
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        for at in range(0, len(order), 4096):
            rows = order[at : at + 4096]
            short = rows[lengths[rows] <= WIDE]
            if len(short):
                parts.append(self._block([chunks[k] for k in short.tolist()], lengths[short]))
            for k in rows[len(short) :].tolist():
                ids = self.agenda(chunks[k])
                parts.append((np.array(ids, dtype=np.int32), np.array([len(ids)])))
        if not parts:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        values, sizes = (np.concatenate(x) for x in zip(*parts, strict=True))
        back = np.empty(len(order), dtype=np.int64)
        back[order] = np.arange(len(order))
        return taken(values, np.cumsum(sizes) - sizes, sizes, back), sizes[back]

    def _block(self, chunks: list[str], lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each round takes the head of every chunk's agenda, until no chunk has one."""
        width, n = int(lengths.max()), len(chunks)
        symbols = np.full((n, width + 1), -2, dtype=np.int32)  # -2: beyond the end; -3 - code: unknown character
        codes = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int32)
        known = self._symbols[codes]
        symbols[:, :width][np.arange(width)[None, :] < lengths[:, None]] = np.where(known < 0, -3 - codes, known)
        done, live, columns = np.empty_like(symbols), np.arange(n), np.arange(width)
        pairs = self._pairs(symbols[:, :-1].ravel(), symbols[:, 1:].ravel()).reshape(n, width)
        while len(live):
            ranks = self.rank[pairs]
            best = ranks.argmin(axis=1)
            rows = np.arange(len(live))
            merges = ranks[rows, best] < NONE
            if not merges.all():
                done[live[~merges]] = symbols[~merges]
                live, best, symbols, pairs = live[merges], best[merges], symbols[merges], pairs[merges]
                rows = rows[: len(live)]
            if not len(live):
                break
            symbols[rows, best] = self.merged[pairs[rows, best]]
            later = columns[None, :] > best[:, None]
            symbols[:, :-1] = np.where(later, symbols[:, 1:], symbols[:, :-1])
            symbols[:, -1] = -2
            pairs[:, :-1] = np.where(later[:, :-1], pairs[:, 1:], pairs[:, :-1])
            pairs[:, -1] = -1
            pairs[rows, best] = self._pairs(symbols[rows, best], symbols[rows, best + 1])
            before = rows[best > 0]
            pairs[before, best[before] - 1] = self._pairs(symbols[before, best[before] - 1], symbols[before, best[before]])
        there = done != -2
        sizes = there.sum(axis=1)
        odd = np.flatnonzero((there & ~(self._final[np.maximum(done, 0)] & (done >= 0))).any(axis=1))
        values = done[there]
        if len(odd):  # byte pieces take the place of characters that are no pieces
            at = np.cumsum(sizes) - sizes
            spelled = {k: self.ids([self._strings[s] if s >= 0 else chr(-3 - s) for s in values[at[k] : at[k] + sizes[k]].tolist()]) for k in odd.tolist()}
            pieces = np.split(values, at[1:])
            for k, ids in spelled.items():
                pieces[k] = np.array(ids, dtype=np.int32)
                sizes[k] = len(ids)
            values = np.concatenate(pieces)
        return values, sizes

    # ------------------------------------------------------------ unigram counts over a trie

    @property
    def _table(self) -> tuple[Places, np.ndarray, int, float]:
        """Places of the pieces by hash, their scores, the longest piece, the score of an unknown character."""
        if not hasattr(self, "_hashed"):
            pieces = list(self.score)
            usual = [s for s in self.score.values() if s > -1e8]
            self._hashed = (Places(np.array([_fold(p) for p in pieces], dtype=np.uint64), PIECE_BITS), np.array([*map(self.score.__getitem__, pieces), -np.inf]), max(map(len, pieces)), min(usual) - UNKNOWN_PENALTY)
        return self._hashed

    def unigram_counts(self, chunks: list[str]) -> list[int]:
        """Tokens in the best unigram segmentation of each chunk (ties: fewest tokens).

        The sorted distinct chunks are walked as a trie, level by level: a node is one
        distinct prefix, its forward score is computed once from those of its ancestors,
        and the node where a chunk ends holds the chunk's count.
        """
        distinct, ends = sorted(set(chunks)), {}
        left = 0
        for width in (12, 20, 4 * WIDE):  # a trie for each range of lengths, so that one long chunk doesn't widen all
            part = [c for c in distinct if left < len(c) <= width]
            left = width
            for at in range(0, len(part), 4096):
                ends.update(zip(part[at : at + 4096], self._trie(part[at : at + 4096]), strict=True))
        ends.update((c, self._single(c)) for c in distinct if len(c) > left)
        return [ends[c] for c in chunks]

    def _single(self, chunk: str) -> int:
        """Count of one very long chunk: a trie of one branch, walked character by character."""
        _, _, longest, unknown = self._table
        cost, count = [0.0], [0]
        for d in range(1, len(chunk) + 1):
            c = chunk[d - 1]
            known = self.score.get(c)
            best, fewest = (cost[d - 1] + known, count[d - 1] + 1) if known is not None else (cost[d - 1] + unknown, count[d - 1] + (len(c.encode("utf-8", "replace")) if self.bytes else 1))
            for size in range(2, min(longest, d) + 1):
                known = self.score.get(chunk[d - size : d])
                if known is not None:
                    score, tokens = cost[d - size] + known, count[d - size] + 1
                    if score > best or (score == best and tokens < fewest):
                        best, fewest = score, tokens
            cost.append(best)
            count.append(fewest)
        return count[-1]

    def _trie(self, words: list[str]) -> list[int]:
        places, scores, longest, unknown = self._table
        n, width = len(words), max(map(len, words))
        lengths = np.array([len(w) for w in words])
        codes = np.zeros((n, width), dtype=np.uint64)
        codes[np.arange(width)[None, :] < lengths[:, None]] = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype="<u4")
        prefix = np.zeros((n, width + 1), dtype=np.uint64)
        for d in range(width):
            prefix[:, d + 1] = prefix[:, d] * BASE + codes[:, d] + np.uint64(1)
        same = np.zeros(n, dtype=int)  # characters shared with the word before
        if n > 1:
            equal = (codes[1:] == codes[:-1]) & (np.arange(width)[None, :] < np.minimum(lengths[1:], lengths[:-1])[:, None])
            same[1:] = np.logical_and.accumulate(equal, axis=1).sum(axis=1)
        cost, count = np.zeros((n, width + 1)), np.zeros((n, width + 1), dtype=np.int64)  # by first word of the node
        node = np.zeros((n, width + 1), dtype=np.int64)  # word: first word of its node at each depth
        rows = np.arange(n)
        for d in range(1, width + 1):
            first = (lengths >= d) & (same < d)
            node[:, d] = np.maximum.accumulate(np.where(first, rows, 0))
            new = rows[first]
            best, fewest = np.full(len(new), -np.inf), np.zeros(len(new), dtype=np.int64)
            for size in range(1, min(longest, d) + 1):
                at = places.of(prefix[new, d] - prefix[new, d - size] * POWERS[size])
                there = at >= 0
                if size > 1:  # few substrings are pieces: only those are weighed
                    rows_ = np.flatnonzero(there)
                    back = node[new[rows_], d - size]
                    score, tokens = cost[back, d - size] + scores[at[rows_]], count[back, d - size] + 1
                    better = (score > best[rows_]) | ((score == best[rows_]) & (tokens < fewest[rows_]))
                    best[rows_[better]], fewest[rows_[better]] = score[better], tokens[better]
                    continue
                back = node[new, d - size]
                score, tokens = cost[back, d - size] + scores[at], count[back, d - size] + 1
                if not there.all():
                    c = codes[new, d - 1]
                    spelled = 1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF) if self.bytes else np.ones(len(c), dtype=np.int64)
                    score = np.where(there, score, cost[back, d - 1] + unknown)
                    tokens = np.where(there, tokens, count[back, d - 1] + spelled)
                best, fewest = score, tokens.astype(np.int64)
            cost[new, d], count[new, d] = best, fewest
        return count[node[rows, lengths], lengths].tolist()


BASE = np.uint64(0x9E3779B97F4A7C15)


def _powers(n: int) -> np.ndarray:
    out = np.ones(n, dtype=np.uint64)
    for k in range(1, n):
        out[k] = out[k - 1] * BASE
    return out


with np.errstate(over="ignore"):
    POWERS = _powers(512)


def _fold(piece: str) -> np.uint64:
    with np.errstate(over="ignore"):
        h = np.uint64(0)
        for c in piece:
            h = h * BASE + np.uint64(ord(c) + 1)
    return h


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


_ENCODED = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("agenda_agrees", pa.bool_()), ("whole_agrees", pa.bool_())])
ENCODED = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, agenda_agrees boolean, whole_agrees boolean"


def checked(words: Vocabulary, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids and sizes of ``chunks`` by the agenda, and for each whether the library gives the same.

    The library puts a word mark before each text: a chunk with one is given without it,
    any other chunk behind a line end, whose ids are then taken off.
    """
    values, sizes = words.agendas(chunks)
    lead = len(words.library.encode("\n"))
    bare = [c.startswith(MARK) and words.prefixed for c in chunks]
    told = words.library.encode([(c[1:] if b else "\n" + c).replace(MARK, " ") for c, b in zip(chunks, bare, strict=True)], num_threads=1)
    told = [[words.id[MARK]] if c == MARK else ids if b else ids[lead:] for c, b, ids in zip(chunks, bare, told, strict=True)]
    agreed = np.fromiter(map(len, told), np.int64, len(told)) == sizes
    if agreed.all() and np.array_equal(np.fromiter(chain.from_iterable(told), np.int32, len(values)), values):
        return values, sizes, agreed
    ends = np.cumsum(sizes)
    return values, sizes, np.array([values[b - n : b].tolist() == ids for b, n, ids in zip(ends.tolist(), sizes.tolist(), told, strict=True)], dtype=bool)


def _digest(s: str) -> str:
    return hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()


def encoded_rows(words: Vocabulary, batch: pa.RecordBatch, every: int) -> pa.RecordBatch:
    """The rows of one slice (doc_id, text): the agenda's ids of its chunks, put together."""
    texts = [t or "" for t in batch.column(1).to_pylist()]
    cut = [words.chunks(t) for t in texts]
    if len(words.met.number) > REMEMBERED:
        words.met = Met()
    met = words.met
    number = met.number
    chunks = list(chain.from_iterable(cut))
    rows = list(map(number.get, chunks))
    new: list[str] = []
    if None in rows:
        for k in [k for k, r in enumerate(rows) if r is None]:
            if chunks[k] not in number:
                number[chunks[k]] = len(number)
                new.append(chunks[k])
            rows[k] = number[chunks[k]]
    if new:
        met.add(new, *checked(words, new))
    at = np.array(rows, dtype=np.int64)
    upto = np.cumsum([0, *map(len, cut)])
    flat = taken(met.values, met.starts, met.sizes, at).tolist()
    ends = np.concatenate([[0], np.cumsum(met.sizes[at])])[upto].tolist()
    ids = [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
    wrong = np.concatenate([[0], np.cumsum(~met.agreed[at])])[upto]
    whole: list[bool | None] = [None] * len(ids)
    whole[::every] = [a == b for a, b in zip(ids[::every], words.library.encode(texts[::every], num_threads=1), strict=True)]
    lines = [",".join(map(words.spelled.__getitem__, i)) for i in ids]
    return record_batch(_ENCODED, doc_id=batch.column(0), n_tokens=list(map(len, ids)), ids_sha256=list(map(_digest, lines)), decoded_sha256=list(map(_digest, words.library.decode(ids))), agenda_agrees=(np.diff(wrong) == 0).tolist(), whole_agrees=whole)


def encoded(docs: DataFrame, model: str, every: int = 4) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, agenda_agrees, whole_agrees for every whole text.

    The ids are the agenda's. Those of every chunk that a worker meets are compared with
    the library's (agenda_agrees: all chunks of the text agree), those of the first of
    each ``every`` texts also as a whole (whole_agrees, null for the others): the cuts
    between chunks are places that no piece of the vocabulary spans.
    Null texts are empty: no ids, digest of nothing. Repeated rows are encoded each. An
    empty table gives no rows. Columns other than doc_id and text are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(model)
        for batch in slices(batches, 128):
            yield encoded_rows(words, batch, every)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, ENCODED)


_COUNTED = pa.schema([("doc_id", pa.int64()), ("n_chunks", pa.int64()), ("n_tokens", pa.int64())])


def token_counts(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_chunks (pre-tokens) and n_tokens: pieces of the best unigram segmentation of the whole text.

    Scores are the vocabulary's own; characters outside it count as their UTF-8 bytes
    where the vocabulary has byte pieces. Null and empty texts count 0; repeated rows
    are counted each; an empty table gives no rows; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(model)
        known = words.counted
        for batch in slices(batches):
            cut = [words.chunks(t or "") for t in batch.column(1).to_pylist()]
            if len(known) > REMEMBERED:
                known.clear()
            found = [list(map(known.get, line)) for line in cut]
            new = list({c for line, counts in zip(cut, found, strict=True) if None in counts for c, n in zip(line, counts, strict=True) if n is None})
            known.update(zip(new, words.unigram_counts(new), strict=True))
            tokens = [sum(counts) if None not in counts else sum([known[c] for c in line]) for line, counts in zip(cut, found, strict=True)]
            yield record_batch(_COUNTED, doc_id=batch.column(0), n_chunks=[len(line) for line in cut], n_tokens=tokens)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_chunks long, n_tokens long")
