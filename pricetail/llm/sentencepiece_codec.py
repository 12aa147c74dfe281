"""Exact encoding and decoding with a merge-type (BPE) sentencepiece model.

A text is cut before every run of spaces; no piece of such a model has a space
after another character, so no merge crosses a cut.  Each part is encoded by
backtracking:

* Aho-Corasick finds the longest piece that starts at every position;
* a piece may follow another only if merging both pieces' characters anew gives
  just these two (checked once a pair, then remembered);
* where neither the longest piece nor any shorter one fits, the position is
  marked as failed and the piece before it is replaced by a shorter one.

The first sequence of pairwise compatible pieces that reaches the end is the
sequence that merging gives.  Characters outside the vocabulary become byte
pieces.

New parts of many texts are searched together: the goto function of the automaton,
the shorter pieces and the checked pairs are arrays, and one step of all searches
is a few numpy calls.

Defined results: null and empty texts encode to the begin and end ids alone and
decode to the empty text.  Texts of any length are encoded whole.  Repeated rows
give equal results; an empty table gives an empty one; extra columns are kept,
except one that has the name of the result (``to``), which is replaced.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
# Words and pairs remembered by a worker; beyond it a memo starts anew.
MEMO_ENTRIES = 400_000
# Slots for checked pairs; a pair that finds its slot taken is checked again.
PAIR_SLOTS = 1 << 21
# Characters of texts whose new parts are searched together.
TOGETHER = 2_000_000
# Bytes of a batch that are Python objects at a time; the rest of it stays in Arrow's buffers.
AT_ONCE = 2_000_000
# Longer parts are searched alone and not remembered.
LONGEST = 64
MARKS = ",.;:!?$%&*#|"
_PARTS = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")


class PieceCodec:
    """Encoder and decoder made from the serialised model."""

    def __init__(self, model: bytes, memo: int | None = None):
        self.memo = memo
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        if sp.encode("e  ﬁ ") != sp.encode(f"e{SPACE}{SPACE}ﬁ{SPACE}") or sp.decode(sp.encode("ﬁ  x ")) != "ﬁ  x ":
            raise ValueError("only models that keep texts as they are, with a leading space, are supported")
        size = sp.vocab_size()
        self.unk = sp.unk_id()
        self.begin, self.end = struct.pack("<I", sp.bos_id()), struct.pack("<I", sp.eos_id())
        self.pieces = [sp.id_to_piece(i) for i in range(size)]
        self.silent = {i for i in range(size) if sp.is_control(i)}
        self.byte_of = {i: int(self.pieces[i][3:5], 16) for i in range(size) if sp.is_byte(i)}
        self.byte_id = {b: i for i, b in self.byte_of.items()}
        self.rank = {
            p: -sp.get_score(i)
            for i, p in enumerate(self.pieces)
            if i not in self.byte_of and i not in self.silent and i != self.unk and not sp.is_unused(i)
        }
        self.ids = {p: i for i, p in enumerate(self.pieces) if p in self.rank}
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("a piece has a space after another character")
        # A piece that merging never makes can't be part of a result.
        usable = {p: i for p, i in self.ids.items() if len(p) == 1 or self.merge(p) == [p]}
        self.automaton = ahocorasick.Automaton()
        for p, i in usable.items():
            self.automaton.add_word(p, i)
        self.automaton.make_automaton()
        self.shorter: list[int] = [-1] * size
        # For every start of a piece, the longest piece that is a start of it.
        self.best: dict[str, int] = {}
        for p in sorted(usable, key=len):
            for n in range(1, len(p) + 1):
                if p[:n] not in self.best or n == len(p):
                    self.best[p[:n]] = usable.get(p[:n], self.best.get(p[: n - 1], -1))
            self.shorter[usable[p]] = self.best.get(p[:-1], -1)
        self.reach = max(map(len, usable))
        self.lone = {*self.byte_of, *self.silent, self.unk}
        self.length = [len(p) for p in self.pieces]
        # What decoding shows for an id; byte pieces are put together first.
        self.shown = ["" if i in self.silent else " ⁇ " if i == self.unk else p for i, p in enumerate(self.pieces)]
        self.odd = np.zeros(size, bool)
        self.odd[list(self.byte_of)] = True
        self._arrays(usable)
        self.pairs: dict[int, bool] = {}
        self.words: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {}

    @property
    def most(self) -> int:
        """Entries that each memo holds: those asked for, or MEMO_ENTRIES."""
        return self.memo or MEMO_ENTRIES

    def _arrays(self, usable: dict[str, int]) -> None:
        """The automaton's goto function as a hash table of (node, character), and what a search looks up."""
        nodes = {p: n for n, p in enumerate(["", *self.best])}
        self.kind = np.zeros(0x110000, np.int64)
        letters = sorted({p[-1] for p in self.best})
        self.kind[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.kinds = len(letters) + 1
        edges = np.array([nodes[p[:-1]] * self.kinds + self.kind[ord(p[-1])] for p in self.best], np.int64)
        size = 1 << (len(edges) * 8).bit_length()
        self.edge, self.node = np.full(size, -1, np.int64), np.zeros(size, np.int64)
        slots = self._slots(edges, size)
        for n, (key, slot) in enumerate(zip(edges.tolist(), slots.tolist()), 1):
            while self.edge[slot] >= 0:
                slot = (slot + 1) % size
            self.edge[slot], self.node[slot] = key, n
        # Longest usable piece of a node, _OUTSIDE where there is none.
        self.piece_at = np.array([_OUTSIDE, *(_OUTSIDE if i < 0 else i for i in self.best.values())], np.int64)
        self.shorter_at, self.length_at = np.array(self.shorter, np.int64), np.array(self.length, np.int64)
        self.pair, self.fits = np.full(PAIR_SLOTS, -1, np.int64), np.zeros(PAIR_SLOTS, bool)
        self.byte_ids = np.array([self.byte_id.get(b, self.unk) for b in range(256)], np.int64)

    @staticmethod
    def _slots(keys: np.ndarray, size: int) -> np.ndarray:
        """Fibonacci hashing to a power of two."""
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(65 - size.bit_length())).astype(np.int64)

    def _children(self, nodes: np.ndarray, kinds: np.ndarray) -> np.ndarray:
        """The node after a character, 0 if there is none."""
        keys = nodes * self.kinds + kinds
        slots = self._slots(keys, len(self.edge))
        out = np.where(self.edge[slots] == keys, self.node[slots], 0)
        open_ = np.flatnonzero((out == 0) & (self.edge[slots] >= 0))
        while len(open_):
            slots[open_] = (slots[open_] + 1) % len(self.edge)
            there = self.edge[slots[open_]]
            hit = there == keys[open_]
            out[open_[hit]] = self.node[slots[open_[hit]]]
            open_ = open_[~hit & (there >= 0)]
        return out

    def _longest(self, chars: np.ndarray) -> np.ndarray:
        """The longest piece that starts at every place, _OUTSIDE where none does."""
        kinds = self.kind[chars]
        out = np.full(len(chars), _OUTSIDE, np.int64)
        places = np.flatnonzero(kinds)
        nodes = np.zeros(len(places), np.int64)
        for depth in range(self.reach):
            inside = places + depth < len(chars)
            places, nodes = places[inside], nodes[inside]
            nodes = self._children(nodes, kinds[places + depth])
            places, nodes = places[nodes > 0], nodes[nodes > 0]
            if not len(places):
                break
            out[places] = self.piece_at[nodes]
        return out

    def _pairs_fit(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left << 20 | right
        slots = self._slots(keys, PAIR_SLOTS)
        out = self.fits[slots]
        new = np.flatnonzero(self.pair[slots] != keys)
        if len(new):
            distinct, back = np.unique(keys[new], return_inverse=True)
            checked = np.array([self._check(k >> 20, k & 0xFFFFF) for k in distinct.tolist()], bool)
            out[new] = checked[back]
            at = self._slots(distinct, PAIR_SLOTS)
            # Of pairs with one slot the last one stays, in both arrays.
            last = len(at) - 1 - np.unique(at[::-1], return_index=True)[1]
            self.pair[at[last]], self.fits[at[last]] = distinct[last], checked[last]
        return out

    def parts(self, texts: list[str]) -> list[bytes]:
        """Ids of many parts without a zero character, searched together as ``part`` does one by one."""
        joined = "\0".join(texts) + "\0"
        chars = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        ends = np.flatnonzero(chars == 0)
        at = np.concatenate([[0], ends[:-1] + 1])
        longest = self._longest(chars)
        failed = np.zeros(len(chars), bool)
        chosen = np.full(len(chars), _NONE, np.int64)
        back = np.full(len(chars), -1, np.int64)
        last = np.full(len(at), -1, np.int64)
        piece = longest[at]
        alone: list[np.ndarray] = []
        active = np.flatnonzero(at < ends)
        while len(active):
            here, p = at[active], piece[active]
            # The piece at hand: taken if the rest may start behind it and it follows the one before.
            mine = np.flatnonzero(p >= 0)
            who, place, this = active[mine], here[mine], p[mine]
            stop = place + self.length_at[this]
            fits = ~failed[stop]
            asked = np.flatnonzero(fits & (last[who] >= 0))
            if len(asked):
                fits[asked] = self._pairs_fit(last[who[asked]], this[asked])
            taken, stop = who[fits], stop[fits]
            chosen[place[fits]] = this[fits]
            back[stop] = place[fits]
            at[taken], last[taken], piece[taken] = stop, this[fits], longest[stop]
            piece[who[~fits]] = self.shorter_at[this[~fits]]
            # No piece is left: the place has failed, the piece before it becomes shorter.
            stuck = active[p == -1]
            if len(stuck):
                failed[at[stuck]] = True
                before = back[at[stuck]]
                if (before < 0).any():
                    alone.append(stuck[before < 0])
                    stuck, before = stuck[before >= 0], before[before >= 0]
                piece[stuck] = self.shorter_at[chosen[before]]
                chosen[before] = _NONE
                at[stuck] = before
                more = back[before]
                last[stuck] = np.where(more >= 0, chosen[more], -1)
            # Outside the vocabulary: nothing before it has to change.
            outside = active[p == _OUTSIDE]
            if len(outside):
                chosen[at[outside]] = _OUTSIDE
                at[outside] += 1
                last[outside] = -1
                piece[outside] = longest[at[outside]]
            active = active[at[active] < ends[active]]
            if alone:
                active = active[~np.isin(active, alone[-1])]
        places = np.flatnonzero(chosen != _NONE)
        ids, found = chosen[places], chars[places]
        raw = ids == _OUTSIDE
        widths = np.ones(len(ids), np.int64)
        if self.byte_id:
            widths[raw] = 1 + (found[raw] > 0x7F) + (found[raw] > 0x7FF) + (found[raw] > 0xFFFF)
        starts = np.concatenate([[0], np.cumsum(widths)])
        out = np.repeat(np.where(raw, self.unk, ids), widths)
        if self.byte_id and raw.any():
            text = found[raw].astype("<u4").tobytes().decode("utf-32-le").encode()
            out[np.repeat(raw, widths)] = self.byte_ids[np.frombuffer(text, np.uint8)]
        packed = out.astype("<u4").tobytes()
        cuts = (4 * starts[np.searchsorted(places, np.concatenate([[0], ends]))]).tolist()
        result = [packed[a:b] for a, b in zip(cuts, cuts[1:])]
        for i in np.concatenate(alone).tolist() if alone else []:
            result[i] = _packed(self.part(texts[i]))
        return result

    def merge(self, text: str) -> list[str]:
        """Pieces by merging from single characters: best score first, then leftmost."""
        parts, rank, none = list(text), self.rank, float("inf")
        costs = [rank.get(a + b, none) for a, b in zip(parts, parts[1:])]
        while costs:
            best = min(costs)
            if best == none:
                break
            at = costs.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del costs[at]
            if at:
                costs[at - 1] = rank.get(parts[at - 1] + parts[at], none)
            if at < len(costs):
                costs[at] = rank.get(parts[at] + parts[at + 1], none)
        return parts

    def compatible(self, left: int, right: int) -> bool:
        known = self.pairs.get(left << 20 | right)
        if known is None:
            known = self._check(left, right)
            if len(self.pairs) >= self.most:
                self.pairs.clear()
            self.pairs[left << 20 | right] = known
        return known

    def _check(self, left: int, right: int) -> bool:
        """A pair that is itself a piece merges on; bytes and the unknown id never merge."""
        if left in self.lone or right in self.lone:
            return True
        a, b = self.pieces[left], self.pieces[right]
        return a + b not in self.ids and self.merge(a + b) == [a, b]

    def part(self, text: str) -> list[int]:
        """Ids of one part: spaces and what follows up to the next space."""
        length, shorter, known = self.length, self.shorter, self.pairs.get
        reach, prefix, best = self.reach, self.automaton.longest_prefix, self.best.get
        end = len(text)
        failed = bytearray(end + 1)
        out: list[int] = []
        at, piece, last = 0, None, -1
        while at < end:
            if piece is None:
                # The longest piece that starts here, -1 if the character has none.
                ahead = text[at : at + reach]
                piece = best(ahead[: prefix(ahead)], -1)
            if piece < 0:
                # Outside the vocabulary: no merge crosses it, so nothing before it has to change.
                out += [self.byte_id[b] for b in text[at].encode()] if self.byte_id else [self.unk]
                at, last, piece = at + 1, -1, None
                continue
            stop = at + length[piece]
            if not failed[stop]:
                fits = last < 0 or known(last << 20 | piece)
                if fits or (fits is None and self.compatible(last, piece)):
                    out.append(piece)
                    at, last, piece = stop, piece, None
                    continue
            piece = shorter[piece]
            while piece < 0:
                failed[at] = 1
                piece = out.pop()
                at -= length[piece]
                last = out[-1] if out and out[-1] not in self.lone else -1
                piece = shorter[piece]
        return out

    def _word(self, part: str) -> bytes:
        """Ids of a part that isn't remembered.

        Pairwise compatible pieces are the result of merging, so a stem and the
        marks after it may be encoded apart if the pieces at the seam fit.
        """
        found = self.old.get(part)
        if found is not None:
            self.words[part] = found
            return found
        stem = part.rstrip(MARKS)
        if 0 < len(stem) < len(part):
            head = self.words.get(stem) or self._word(stem)
            tail = self.marks.get(part[len(stem) :])
            if tail is None:
                tail = _packed(self.part(part[len(stem) :]))
                if len(self.marks) < self.most and len(part) <= LONGEST:
                    self.marks[part[len(stem) :]] = tail
            seam = _UNSIGNED(head, len(head) - 4)[0], _UNSIGNED(tail)[0]
            found = head + tail if self.compatible(*seam) else _packed(self.part(part))
        else:
            found = _packed(self.part(part))
        if len(part) <= LONGEST:
            if len(self.words) >= self.most:
                # What is used again moves on to the new memo.
                self.old, self.words = self.words, {}
            self.words[part] = found
        return found

    def encode(self, text: str | None) -> bytes:
        """Begin id, ids of the whole text and end id, as little-endian unsigned 32-bit integers."""
        if not text:
            return self.begin + self.end
        text = SPACE + text.replace(" ", SPACE)
        get, word = self.words.get, self._word
        return self.begin + b"".join([get(p) or word(p) for p in _PARTS.findall(text)]) + self.end

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """``encode`` of many texts; new parts are searched together."""
        out: list[bytes] = []
        lot: list[str] = []
        held = 0
        for text in texts:
            lot.append(text or "")
            held += len(lot[-1])
            if held >= TOGETHER:
                out += self._lot(lot)
                lot, held = [], 0
        return out + self._lot(lot)

    def _lot(self, texts: list[str]) -> list[bytes]:
        split = [_PARTS.findall(SPACE + t.replace(" ", SPACE)) if t else () for t in texts]
        new = set().union(*split).difference(self.words)
        if len(self.words) + len(new) > self.most:
            # What is used again moves on to the new memo.
            self.old, self.words = self.words, {}
            new = set().union(*split)
        again = new.intersection(self.old)
        self.words.update((p, self.old[p]) for p in again)
        new = [p for p in new.difference(again) if len(p) <= LONGEST and "\0" not in p]
        if new:
            self.words.update(zip(new, self.parts(new)))
        get, word = self.words.get, self._word
        return [self.begin + b"".join([get(p) or word(p) for p in parts]) + self.end for parts in split]

    def decode(self, ids: bytes | None) -> str:
        """The text of ids; control ids are silent, the leading space goes."""
        if not ids:
            return ""
        found = np.frombuffer(ids, "<u4")
        pieces = self.shown
        if not self.odd[found].any():
            text = "".join(map(pieces.__getitem__, found.tolist()))
        else:
            out: list[str] = []
            run = bytearray()
            for i in found.tolist():
                if i in self.byte_of:
                    run.append(self.byte_of[i])
                    continue
                if run:
                    out.append(_utf8(run))
                    run = bytearray()
                out.append(pieces[i])
            if run:
                out.append(_utf8(run))
            text = "".join(out)
        first = next((i for i in found[:8].tolist() if i not in self.silent), None)
        if first is None:
            first = next((i for i in found.tolist() if i not in self.silent), self.unk)
        if pieces[first].startswith(SPACE):
            text = text[1:]
        return text.replace(SPACE, " ")


# No piece starts here; no piece is chosen here.
_OUTSIDE, _NONE = -2, -3

_UNSIGNED = struct.Struct("<I").unpack_from


_PACK = [struct.Struct(f"<{n}I").pack for n in range(33)]


def _packed(ids: list[int]) -> bytes:
    return _PACK[len(ids)](*ids) if len(ids) < len(_PACK) else np.array(ids, "<u4").tobytes()


def _utf8(run: bytearray) -> str:
    """Bytes as text; every byte that starts no valid character is one replacement character."""
    try:
        return run.decode()
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(run):
            for n in (1, 2, 3, 4):
                try:
                    out.append(run[at : at + n].decode())
                    at += n
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                at += 1
        return "".join(out)


_CODECS: dict[tuple[bytes, int | None], PieceCodec] = {}


def codec(model: bytes, memo: int | None = None) -> PieceCodec:
    """One codec a worker, model and memo size; its memos serve all tasks of the worker."""
    if (model, memo) not in _CODECS:
        _CODECS[model, memo] = PieceCodec(model, memo)
    return _CODECS[model, memo]


def _slices(rows: pa.Array, most: int | None = None) -> Iterator[pa.Array]:
    """The rows in order, cut where AT_ONCE bytes are full; a longer row is a slice of its own."""
    most = AT_ONCE if most is None else most
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(rows), 0).cast(pa.int64())))
    start, before = 0, 0
    while start < len(rows):
        stop = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield rows.slice(start, stop - start)
        start, before = stop, int(ends[stop - 1])


def _joined(parts: list[pa.Array], kind: pa.DataType) -> pa.Array:
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


def read_model(path: str) -> bytes:
    """The model file, read once on the driver; tasks get its bytes, about half a megabyte."""
    with open(path, "rb") as f:
        return f.read()


def encoded(text: Column, model: bytes, memo: int | None = None) -> Column:
    """Binary column: ids as little-endian unsigned 32-bit integers.

    ``memo`` bounds the words and pairs that a worker remembers (MEMO_ENTRIES if none is given).
    """

    @F.arrow_udf("binary")
    def encode_texts(texts: pa.Array) -> pa.Array:
        c = codec(model, memo)
        return _joined([pa.array(c.encode_all(some.to_pylist()), pa.binary()) for some in _slices(texts)], pa.binary())

    return encode_texts(text)


def decoded(ids: Column, model: bytes, memo: int | None = None) -> Column:
    """The text of a binary column of ids; ``memo`` as in ``encoded``, so that both share a codec."""

    @F.arrow_udf("string")
    def decode_ids(rows: pa.Array) -> pa.Array:
        c = codec(model, memo)
        return _joined([pa.array([c.decode(r) for r in some.to_pylist()], pa.string()) for some in _slices(rows)], pa.string())

    return decode_ids(ids)


def encode_documents(docs: DataFrame, model_path: str, text: str = "text", to: str = "token_ids") -> DataFrame:
    return docs.withColumn(to, encoded(F.col(text), read_model(model_path)))


def decode_documents(docs: DataFrame, model_path: str, ids: str = "token_ids", to: str = "decoded") -> DataFrame:
    return docs.withColumn(to, decoded(F.col(ids), read_model(model_path)))
