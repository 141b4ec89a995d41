"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the
pieces drives a single-pass Viterbi search. The ids are the library's.

The automaton reads the normalised text once. At every position it is in the
state of the longest suffix that begins a piece; following the output links
from there yields every piece that ends at this position, and each of them
relaxes the position. The path of the last position is the segmentation.

For a unigram model a position keeps its best score, ``best[end] = max(best[start] +
score)``; of equal ones the longer last piece wins. A character that no piece covers
costs a fixed penalty and is spelled in byte pieces.

A BPE model's scores are no log probabilities but minus the merge rank, so a
greatest sum means nothing there: it would avoid every late piece, common or
not. For such a model (``MergeCodec``; ``encode`` reads the kind from the model) a
position is relaxed by *compatibility* in place of the score: what must come last in
the encoding of the text up to here is the piece that stands unchanged beside the last
piece of the text before it, that is, merging the characters of the two together gives
just these two. Of the pieces that end at a position exactly one does, so the table holds
one way a position, and the encoding of every beginning of the text is known from one
pass. Two pieces are compatible unless at some moment of their own merges the two
parts that meet at the border would have been joined first; ``fits`` steps back through these
moments, and tables of a piece's last merge make each step a lookup. Answers for
pairs are kept. A character that is no piece is spelled in byte pieces and parts what is
before it from what is after it.

Normalisation is the model's: a space becomes U+2581, one is put in front, and
nothing else changes. So a text that holds U+2581 itself decodes with a space
there; every other text comes back exactly.

Work split: a piece has U+2581 only in front (checked when the vocabulary is
loaded), so no piece crosses the border between a word and the white space
after it; the best path of a text is the best paths of these parts, one after
another, and no merge goes across. Parts repeat, so each task keeps the answers of short ones in a bounded
table. The new short parts of a batch of texts go through the automaton side by
side, one character of all of them at a time (``Codec.search_many``: the same
search with a resolved transition table for common characters); long parts and rare
characters take the plain search. Texts are read in Arrow batches, whole,
and the model (32,000 pieces) is the only thing that is broadcast.

Cases: a null or empty text has no ids and decodes to the empty text; equal
rows give equal rows; an empty table gives no rows; other columns are not
read. Ids out of range decode to nothing.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SPACE = "▁"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
# Parts of at most so many characters are remembered, about twice so many of them per worker.
CACHE_CHARS, CACHE_PARTS = 40, 100_000
BATCH_ROWS, SEARCH_PARTS = 256, 20_000
# Characters with a column in the transition table.
COMMON = SPACE + "".join(map(chr, [*range(0x21, 0x7F), *range(0xA1, 0x100)]))
DROP_COMMON = dict.fromkeys(map(ord, COMMON))
UNKNOWN_PENALTY = 10.0
# Pairs of pieces whose compatibility is kept (a power of 2).
SLOTS = 1 << 20


def load_vocabulary(path: str = MODEL) -> list[tuple[str, float, str]]:
    """(piece, score, kind) by id; kind: text, byte or control."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    out = []
    for i in range(sp.get_piece_size()):
        kind = "byte" if sp.is_byte(i) else "control" if sp.is_control(i) or sp.is_unknown(i) else "text"
        out.append((sp.id_to_piece(i), sp.get_score(i), kind))
    return out


def is_bpe(path: str = MODEL) -> bool:
    """Whether the model's scores are merge ranks."""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    return model.trainer_spec.model_type == model.trainer_spec.BPE


class Automaton:
    """Aho-Corasick over the pieces: goto (one table of children per state),
    failure links, and output links to the nearest state where a piece ends."""

    def __init__(self, words: Iterable[tuple[str, int]]):
        self.children: list[dict[str, int]] = [{}]
        self.piece = array("i", [-1])
        self.length = array("i", [0])
        for word, ident in words:
            at = 0
            for c in word:
                nxt = self.children[at].get(c)
                if nxt is None:
                    nxt = self.children[at][c] = len(self.children)
                    self.children.append({})
                    self.piece.append(-1)
                    self.length.append(self.length[at] + 1)
                at = nxt
            self.piece[at] = ident
        n = len(self.children)
        self.fail, self.output = array("i", [0]) * n, array("i", [0]) * n
        self.order = queue = list(self.children[0].values())
        for at in queue:  # breadth first: grows while it is read
            for c, child in self.children[at].items():
                f = self.fail[at]
                while f and c not in self.children[f]:
                    f = self.fail[f]
                f = self.children[f].get(c, 0)
                self.fail[child] = f
                self.output[child] = f if self.piece[f] >= 0 else self.output[f]
                queue.append(child)

    def endings(self, at: int) -> list[tuple[int, int]]:
        """(length, id) of the pieces that end in a state, by its output links."""
        out = []
        at = at if self.piece[at] >= 0 else self.output[at]
        while at:
            out.append((self.length[at], self.piece[at]))
            at = self.output[at]
        return out


class Codec:
    def __init__(self, vocabulary: list[tuple[str, float, str]]):
        text = [(p, i) for i, (p, _, kind) in enumerate(vocabulary) if kind == "text"]
        self.scores = [s for _, s, _ in vocabulary]
        self.byte_ids = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(vocabulary) if kind == "byte"}
        if len(self.byte_ids) != 256:
            raise ValueError("the vocabulary has no piece for each byte")
        self.unknown = min(s for (_, s, kind) in vocabulary if kind == "text") - UNKNOWN_PENALTY
        self.automaton = Automaton(text)
        # What the output links of a state give, kept once it has been met.
        self.endings: list[list[tuple[int, float, int]] | None] = [None] * len(self.automaton.children)
        by_byte = {i: bytes([b]) for b, i in self.byte_ids.items()}
        self.as_bytes = [
            p.replace(SPACE, " ").encode() if kind == "text" else by_byte.get(i, b"")
            for i, (p, _, kind) in enumerate(vocabulary)
        ]
        # Parts are independent only if no piece goes from a word into white space.
        inner = any(SPACE in p.lstrip(SPACE) for p, _ in text)
        outside = "" if inner or any("\n" in p for p, _ in text) else "\n"
        # A line end that is in no piece is always a part of its own.
        self.parts = re.compile(r"(?s).+") if inner else re.compile(rf"[{outside}]|{SPACE}*[^{SPACE}{outside}]+|{SPACE}+" if outside else rf"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self._tables()
        # A part's ids as 32-bit integers, and the generation before.
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def viterbi(self, part: str) -> list[int]:
        """Ids of the best segmentation of normalised text."""
        children, fail, endings, unknown = self.automaton.children, self.automaton.fail, self.endings, self.unknown
        best, came = [0.0], [(0, -1)]
        state = 0
        for end, c in enumerate(part, start=1):
            follow = children[state].get(c)
            while follow is None and state:
                state = fail[state]
                follow = children[state].get(c)
            state = follow or 0
            found = endings[state]
            if found is None:
                found = endings[state] = [(n, self.scores[i], i) for n, i in self.automaton.endings(state)]
            top, how = float("-inf"), (end - 1, -1)
            n = 0
            for n, score, ident in found:  # longest first
                score += best[end - n]
                if score > top:
                    top, how = score, (end - n, ident)
            if n != 1 and best[end - 1] + unknown > top:
                top, how = best[end - 1] + unknown, (end - 1, -1)
            best.append(top)
            came.append(how)
        ids: list[int] = []
        end = len(part)
        while end:
            start, ident = came[end]
            if ident >= 0:
                ids.append(ident)
            else:
                ids.extend(self.byte_ids[b] for b in reversed(part[start:end].encode()))
            end = start
        ids.reverse()
        return ids

    def _tables(self) -> None:
        """The automaton as arrays: transitions with the failure links worked
        in, and each state's first output, its length, score, id and next output."""
        a = self.automaton
        n = len(a.children)
        self.classes = np.zeros(0x110000, np.uint8)
        for k, c in enumerate(COMMON, start=1):
            self.classes[ord(c)] = k
        self.table = np.zeros((n, len(COMMON) + 1), np.uint16 if n < 2**16 else np.int32)
        for at in (0, *a.order):
            if at:
                self.table[at] = self.table[a.fail[at]]
            for c, child in a.children[at].items():
                if k := self.classes[ord(c)]:
                    self.table[at, k] = child
        self.ident = np.array(a.piece, np.int32)
        self.chars = np.array(a.length, np.int32)
        self.link = np.array(a.output, np.int32)
        self.first = np.where(self.ident >= 0, np.arange(n), self.link).astype(np.int32)
        self.gain = np.where(self.ident >= 0, np.array(self.scores)[self.ident], 0.0)

    def search_many(self, parts: list[str]) -> None:
        """``viterbi`` for many short parts at once, into the table of answers."""
        parts = sorted(parts, key=len, reverse=True)
        n, sizes = len(parts), np.array([len(p) for p in parts])
        width = int(sizes[0])
        points = np.array(parts, f"<U{width}").view(np.uint32).reshape(n, width)
        classes = self.classes[points].T.copy()
        # By position, then by part: a step works on neighbouring memory.
        best = np.zeros((width + 1) * n)
        last = np.zeros((width + 1) * n, np.int32)  # the state of the last piece, 0 for a character in bytes
        state = np.zeros(n, np.int32)
        reach = np.searchsorted(-sizes, -np.arange(width + 1), side="right")  # parts that go so far
        for end in range(1, width + 1):
            m, here = int(reach[end]), end * n
            state = self.table[state[:m], classes[end - 1, :m]]
            top = np.full(m, -np.inf)
            how = np.zeros(m, np.int32)
            at = self.first.take(state)
            rows = np.flatnonzero(at)
            at = at.take(rows)
            while len(rows):
                score = best.take(here - self.chars.take(at) * n + rows)
                score += self.gain.take(at)
                better = score > top.take(rows)
                r = rows[better]
                top[r], how[r] = score[better], at[better]
                at = self.link.take(at)
                more = at > 0
                rows, at = rows[more], at[more]
            lone = best[here - n : here - n + m] + self.unknown
            worse = lone > top
            how[worse] = 0
            best[here : here + m] = np.where(worse, lone, top)
            last[here : here + m] = how
        self._keep(parts, sizes, last)

    def _keep(self, parts: list[str], sizes: np.ndarray, last: np.ndarray) -> None:
        """Back along the ways, all parts at a time, into the table of answers. ``last``: by
        position, then by part, the state of the last piece; 0 for a character in bytes."""
        n, width = len(parts), int(sizes[0])
        ids = np.zeros((n, width), np.int32)
        begin = np.full(n, width)
        at, rows = sizes.copy(), np.arange(n)
        plain = np.ones(n, bool)
        while len(rows):
            piece = last.take(at[rows] * n + rows)
            plain[rows[piece == 0]] = False
            begin[rows] -= 1
            ids[rows, begin[rows]] = self.ident.take(piece)
            at[rows] -= np.maximum(self.chars.take(piece), 1)
            rows = rows[at[rows] > 0]
        raw, step = ids.tobytes(), width * 4
        for k, (part, b, ok) in enumerate(zip(parts, begin.tolist(), plain.tolist())):
            # A character spelled in bytes takes the plain search.
            self.cache[part] = raw[k * step + b * 4 : (k + 1) * step] if ok else self._alone(part)

    def _alone(self, part: str) -> bytes:
        return np.array(self.viterbi(part), np.int32).tobytes()

    def encode(self, text: str | None) -> np.ndarray:
        return self.encode_many([text])[0]

    def encode_many(self, texts: list[str | None]) -> list[np.ndarray]:
        if len(self.cache) > CACHE_PARTS:
            # Parts that are used go on into the next generation.
            self.older, self.cache = self.cache, {}
        cache, older = self.cache, self.older
        split = [self.parts.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        new = set().union(*split).difference(cache)
        for part in new.intersection(older):
            cache[part] = older[part]
        new.difference_update(older)
        together = [p for p in new if len(p) <= CACHE_CHARS and not p.translate(DROP_COMMON)]
        for i in range(0, len(together), SEARCH_PARTS):
            self.search_many(together[i : i + SEARCH_PARTS])
        for part in new.difference(together):
            cache[part] = self._alone(part)
        out = [np.frombuffer(b"".join(map(cache.__getitem__, parts)), np.int32) for parts in split]
        for part in new:
            if len(part) > CACHE_CHARS:
                del cache[part]
        return out

    def decode(self, ids: Iterable[int] | None) -> str:
        ids = np.asarray(ids if ids is not None else (), np.int64)
        known = ids[(ids >= 0) & (ids < len(self.as_bytes))].tolist()
        # itemgetter with one index gives no tuple.
        raw = b"".join(itemgetter(*known)(self.as_bytes)) if len(known) > 1 else b"".join(self.as_bytes[i] for i in known)
        text = raw.decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


class MergeCodec(Codec):
    """Encodes with a BPE model."""

    def _tables(self) -> None:
        """Pairs of pieces that make a piece (left * size + right, ascending, with the
        piece's rank), and of each piece the moment it is made and the two it is made of."""
        super()._tables()
        a, self.size = self.automaton, len(self.scores)
        # 0 is merged first; equal scores have one rank.
        rank = np.unique(-np.array(self.scores), return_inverse=True)[1].astype(np.int32)
        self.never = np.int32(self.size)
        self.pairs: dict[int, tuple[int, int]] = {}
        ways: dict[int, list[tuple[int, int]]] = {}
        single = {}
        todo = [(0, [])]
        while todo:
            at, way = todo.pop()
            if (whole := a.piece[at]) >= 0:
                if len(way) == 1:
                    single[self._point(whole)] = whole
                for n, right in a.endings(at):
                    if n < len(way) and (left := a.piece[way[-n - 1]]) >= 0:
                        self.pairs[left * self.size + right] = (int(rank[whole]), whole)
                        ways.setdefault(whole, []).append((left, right))
            todo.extend((child, [*way, child]) for child in a.children[at].values())
        # Ended by a pair that no two pieces make.
        self.keys = np.array([*sorted(self.pairs), self.size**2], np.int64)
        self.made_rank = np.array([*[self.pairs[k][0] for k in self.keys[:-1].tolist()], self.never], np.int32)
        self.char_ids = np.full(0x110000, -1, np.int32)
        self.char_ids[list(single)] = list(single.values())
        # When a piece is made: characters are there from the start, and what merges never make, never.
        self.made = np.full(self.size, self.never, np.int32)
        self.made[list(single.values())] = -1
        self.halves = np.zeros((2, self.size), np.int32)
        # Slots of answers: the pair asked last, and whether it fits.
        self.asked = np.full(SLOTS, -1, np.int64)
        self.answer = np.zeros(SLOTS, bool)
        # Parts are made before the whole (runs of spaces share a rank and grow to the right),
        # and of several ways one has parts that fit until then.
        for whole in sorted(ways, key=lambda w: (int(rank[w]), len(self.as_bytes[w]))):
            for left, right in ways[whole]:
                if max(self.made[left], self.made[right]) <= rank[whole] and self._stays(left, right, int(rank[whole])):
                    self.made[whole], self.halves[:, whole] = rank[whole], (left, right)
                    break
        self.known = {}

    def _point(self, ident: int) -> int:
        # In the text, U+2581 stands where the piece as bytes has a space.
        c = self.as_bytes[ident].decode()
        return ord(SPACE if c == " " else c)

    def _stays(self, left: int, right: int, limit: int) -> bool:
        """Whether two pieces beside each other are each made as if alone, up to the moment ``limit``."""
        made, (lefts, rights) = self.made, self.halves
        while True:
            found = self.pairs.get(left * self.size + right)
            if found and found[0] < limit:
                return False
            # Undo the later of the two merges; of equal ones the left one came first.
            if made[left] > made[right]:
                limit, left = int(made[left]), int(rights[left])
            elif made[right] >= 0:
                # The border lies to the left of this merge, so at its rank the border went first.
                limit, right = int(made[right]) + 1, int(lefts[right])
            else:
                return True

    def _fits(self, left: int, right: int) -> bool:
        key = left * self.size + right
        fits = self.known.get(key)
        if fits is None:
            if len(self.known) >= SLOTS:
                self.known.clear()
            fits = self.known[key] = self.made[right] < self.never and self._stays(left, right, self.size)
        return fits

    def fits(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """``_fits`` for many pairs."""
        key = left.astype(np.int64) * self.size + right
        slot = (key * 0x9E3779B1 >> 7) & (SLOTS - 1)
        out = self.answer.take(slot)
        new = np.flatnonzero(self.asked.take(slot) != key)
        if not len(new):
            return out
        left, right = left[new], right[new]
        ok = self.made.take(right) < self.never
        rows, limit = np.flatnonzero(ok), np.full(int(ok.sum()), self.never)
        left, right = left[rows], right[rows]
        lefts, rights = self.halves
        while len(rows):
            pair = left.astype(np.int64) * self.size + right
            at = np.searchsorted(self.keys, pair)
            joined = np.where(self.keys.take(at) == pair, self.made_rank.take(at), self.never) < limit
            ok[rows[joined]] = False
            a, b = self.made.take(left), self.made.take(right)
            go = ~joined & ((a >= 0) | (b >= 0))
            rows, left, right, a, b = rows[go], left[go], right[go], a[go], b[go]
            first = a > b
            limit = np.where(first, a, b + 1)
            left, right = np.where(first, rights.take(left), left), np.where(first, right, lefts.take(right))
        out[new] = ok
        self.asked[slot[new]], self.answer[slot[new]] = key[new], ok
        return out

    def viterbi(self, part: str) -> list[int]:
        """Ids of normalised text: one pass over the automaton, one piece a position."""
        children, fail, endings = self.automaton.children, self.automaton.fail, self.endings
        last = [(-1, 0)]  # the last piece up to here and its characters; -1 for a character in bytes
        state = 0
        for end, c in enumerate(part, start=1):
            follow = children[state].get(c)
            while follow is None and state:
                state = fail[state]
                follow = children[state].get(c)
            state = follow or 0
            found = endings[state]
            if found is None:
                found = endings[state] = [(n, 0.0, i) for n, i in self.automaton.endings(state)]
            for n, _, ident in found:
                before = last[end - n][0]
                if self._fits(before, ident) if before >= 0 else self.made[ident] < self.never:
                    last.append((ident, n))
                    break
            else:
                last.append((-1, 1))
        ids: list[int] = []
        end = len(part)
        while end:
            ident, n = last[end]
            if ident >= 0:
                ids.append(ident)
            else:
                ids.extend(self.byte_ids[b] for b in reversed(part[end - 1].encode()))
            end -= n
        ids.reverse()
        return ids

    def search_many(self, parts: list[str]) -> None:
        """``viterbi`` for many short parts at once, into the table of answers."""
        parts = sorted(parts, key=len, reverse=True)
        n, sizes = len(parts), np.array([len(p) for p in parts])
        width = int(sizes[0])
        points = np.array(parts, f"<U{width}").view(np.uint32).reshape(n, width)
        classes = self.classes[points].T.copy()
        last = np.zeros((width + 1) * n, np.int32)
        state = np.zeros(n, np.int32)
        reach = np.searchsorted(-sizes, -np.arange(width + 1), side="right")  # parts that go so far
        for end in range(1, width + 1):
            m, here = int(reach[end]), end * n
            state = self.table[state[:m], classes[end - 1, :m]]
            at = self.first.take(state)
            rows = np.flatnonzero(at)
            at = at.take(rows)
            while len(rows):
                before = last.take(here - self.chars.take(at) * n + rows)
                ident = self.ident.take(at)
                fit = self.made.take(ident) < self.never
                some = np.flatnonzero(before)
                fit[some] = self.fits(self.ident.take(before[some]), ident[some])
                last[here + rows[fit]] = at[fit]
                at = self.link.take(at)
                more = ~fit & (at > 0)
                rows, at = rows[more], at[more]
        self._keep(parts, sizes, last)


_CODECS: dict[str, Codec] = {}


def _codec(model: str, vocabulary) -> Codec:
    """One per model and Python worker, kept with its table between tasks."""
    if model not in _CODECS:
        pieces, bpe = vocabulary.value
        _CODECS[model] = MergeCodec(pieces) if bpe else Codec(pieces)
    return _CODECS[model]


def encode(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, ids, n_pieces, round_trip) for every row of ``docs``
    (doc_id, text); round_trip: the ids decode to the text again."""
    vocabulary = docs.sparkSession.sparkContext.broadcast((load_vocabulary(model), is_bpe(model)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model, vocabulary)
        for batch in batches:
            # A part of the batch at a time, since ids take more room than texts.
            for i in range(0, batch.num_rows, BATCH_ROWS):
                some = batch.slice(i, BATCH_ROWS)
                texts = [t or "" for t in some.column("text").to_pylist()]
                ids = codec.encode_many(texts)
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                columns = [
                    some.column("doc_id"),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids))),
                    pa.array(np.diff(ends).astype(np.int64)),
                    pa.array([codec.decode(x) == t for x, t in zip(ids, texts)]),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "n_pieces", "round_trip"])

    typed = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {typed}, ids array<int>, n_pieces long, round_trip boolean"
    )


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, text) from (doc_id, ids)."""
    vocabulary = encoded.sparkSession.sparkContext.broadcast((load_vocabulary(model), is_bpe(model)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model, vocabulary)
        for batch in batches:
            texts = pa.array([codec.decode(x) for x in batch.column("ids").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), texts], ["doc_id", "text"])

    typed = dict(encoded.dtypes)["doc_id"]
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {typed}, text string")
