"""SentencePiece encoding and decoding by weighted finite-state transduction.

The normaliser rewrites the longest of its rules at each place, folds and trims blanks where the model says
so, makes a blank the visible space and puts one before the text.  It is a function of the text, so what it
gives is a chain, and it is applied before the lattice is made rather than compiled to arcs of it.  The pieces are a trie whose finals give ids.  Byte fallback gives an arc for each character that no
piece covers.  A text is composed with them into a lattice, and the path of least weight (tropical semiring:
weights add up along a path, the least of several counts) is its encoding.

Unigram pieces weigh minus their score, in single precision as the models' own library adds them.  A BPE
piece weighs 0, and so does its following another, but for infinity where merging the characters of both by
the model's scores would join them across their border.  The one path of finite weight is the BPE encoding,
and so is each of its beginnings that of its own text; so a place keeps one state, with its last piece.  A border is judged on the two merge trees: their edges are undone from
the latest merge back, and no pair of edges that stood side by side may have a better merge than those that
used them up.

No piece goes on after a space that follows another character, so the lattice is cut there.  Cuts that
are new to a group of texts are solved together, as arrays over all of them; long ones by themselves.  What
is remembered is bounded by bytes and given up at the end of a task.  Models with user-defined pieces or a
space as suffix are refused with an error.

Defined results: a null or empty text has no ids and decodes to the empty text; null doc_ids and repeated
rows stay; a visible space in a text counts as a space; ids beyond the model decode to nothing, and the unknown
id to the model's sign for it; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import text_of, with_small_batches

SPACE = "▁"
CACHE_BYTES = 64 << 20
ENTRY_BYTES = 250  # of a remembered cut besides its ids
GROUP_CHARS = 1 << 20
LONG_CUT = 48
TOGETHER = 1 << 13  # cuts
NORMAL, USER_DEFINED, BYTE = 1, 4, 6  # kinds of pieces in a model's file
UNIGRAM, BPE = 1, 2  # kinds of models
UNKNOWN_PENALTY = np.float32(10)
_CUTS = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
_CHAR = 21  # bits of a character
_PIECE = 24  # bits of a piece
_NEVER = np.iinfo(np.int64).max


class Table:
    """A fixed map of whole numbers, looked up as arrays: levels of slots, each for keys whose slot was taken before."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, level: int = 0):
        bits = max(6, (2 * len(keys)).bit_length())
        self._odd, self._shift = np.uint64(0x9E3779B97F4A7C15 + 2 * 0x632BE59BD9B4E019 * level & (1 << 64) - 1), np.uint64(64 - bits)
        self._keys, self._values, self._next = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int64), None
        slots, first = np.unique(self._slots(keys), return_index=True)
        self._keys[slots], self._values[slots] = keys[first], values[first]
        if len(first) < len(keys):
            rest = np.delete(np.arange(len(keys)), first)
            self._next = Table(keys[rest], values[rest], level + 1)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * self._odd >> self._shift).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The values, or -1."""
        slots = self._slots(keys)
        held = self._keys[slots]
        found = np.where(held == keys, self._values[slots], -1)
        if self._next is not None and len(rest := np.flatnonzero((held != keys) & (held >= 0))):
            found[rest] = self._next(keys[rest])
        return found


class Normaliser:
    """``rules``: texts and what they become; the longest rule that fits a place is taken, from left to right."""

    def __init__(self, rules: dict[str, str], prefix: bool = True, fold_blanks: bool = False):
        self.rules, self.prefix, self.fold_blanks = rules, prefix, fold_blanks
        self.most: dict[str, int] = {}
        for text in rules:
            self.most[text[0]] = max(self.most.get(text[0], 0), len(text))
        self._first = re.compile("[" + "".join(map(re.escape, self.most)) + "]") if rules else None

    def __call__(self, text: str) -> str:
        text = self._rewritten(text) if self._first else text
        if self.fold_blanks:
            text = re.sub(" +", " ", text).strip(" ")
        if not text:
            return ""
        text = (SPACE if self.prefix else "") + text.replace(" ", SPACE)
        return text.rstrip(SPACE) if self.fold_blanks else text

    def _rewritten(self, text: str) -> str:
        out, at = [], 0
        while found := self._first.search(text, at):
            start = found.start()
            size = next((n for n in range(self.most[text[start]], 0, -1) if text[start : start + n] in self.rules), 0)
            out += [text[at:start], self.rules[text[start : start + size]] if size else text[start]]
            at = start + max(1, size)
        return "".join(out) + text[at:]


def charsmap_rules(blob: bytes) -> dict[str, str]:
    """The rules in a model's character map: a double-array trie of bytes, and its targets, each ended by a zero byte."""
    size = int.from_bytes(blob[:4], "little")
    units, targets = np.frombuffer(blob, "<u4", size // 4, 4), blob[4 + size :]
    labels = np.arange(256, dtype=np.uint32)
    offset = lambda unit: int(unit) >> 10 << ((int(unit) & 1 << 9) >> 6)
    rules: dict[str, str] = {}
    todo = [(offset(units[0]), b"")]
    while todo:
        at, key = todo.pop()
        places = at ^ labels
        places = places[places < len(units)]
        for place in places[units[places] & np.uint32(1 << 31 | 255) == at ^ places].tolist():
            unit, longer = int(units[place]), key + bytes([place ^ at])
            if place == at:  # the zero label leads to no key
                continue
            below = place ^ offset(unit)
            if unit >> 8 & 1:
                value = int(units[below]) & (1 << 31) - 1
                rules[longer.decode()] = targets[value : targets.index(b"\0", value)].decode()
            todo.append((below, longer))
    return rules


class Transducer:
    """``pieces``: (text, score, kind) by id; ``bpe``: merges by score, else unigram weights."""

    def __init__(self, pieces: list[tuple[str, float, int]], bpe: bool, normaliser: Normaliser | None = None, unknown_text: str = ""):
        if any(kind == USER_DEFINED for *_, kind in pieces):
            raise ValueError("user-defined pieces are not supported")
        self.bpe, self.normaliser = bpe, normaliser or Normaliser({})
        self.ids = {text: i for i, (text, _, kind) in enumerate(pieces) if kind == NORMAL}
        self.score = {text: np.float32(score) for text, score, kind in pieces if kind == NORMAL}
        self.bytes = {int(text[3:5], 16): i for i, (text, _, kind) in enumerate(pieces) if kind == BYTE}
        self.unknown = next((i for i, (text, *_) in enumerate(pieces) if text == "<unk>"), 0)
        self.fallback_weight = np.float32(0) if bpe else UNKNOWN_PENALTY - min(self.score.values(), default=np.float32(0))
        self.cut = not any(re.search(f"[^{SPACE}]{SPACE}", text) for text in self.ids)
        self._shown(pieces, unknown_text)
        self._chars = {c: len(pieces) + k for k, c in enumerate(sorted({c for text in self.ids for c in text} - self.ids.keys()))}
        self._names = {i: text for text, i in [*self.ids.items(), *self._chars.items()]}
        n = len(pieces) + len(self._chars)
        self.weight = np.zeros(n, np.float32)
        if bpe:
            self._merge_trees(n)
        else:
            for text, i in self.ids.items():
                self.weight[i] = -self.score[text]
        self._trie()
        self.release()

    def release(self) -> None:
        """Gives up what was remembered."""
        self._paths: dict[str, bytes] = {}
        self._pairs: dict[tuple[int, int], bool] = {}
        self._room = CACHE_BYTES

    # Compilation

    def _shown(self, pieces: list[tuple[str, float, int]], unknown_text: str) -> None:
        raw = [bytes([int(text[3:5], 16)]) if kind == BYTE else text.replace(SPACE, " ").encode("utf-8", "surrogatepass") if kind == NORMAL else b"" for text, _, kind in pieces]
        if pieces and not raw[self.unknown]:
            raw[self.unknown] = unknown_text.encode()
        self._blob = np.frombuffer(b"".join(raw), np.uint8)
        self._lengths = np.array([len(x) for x in raw], np.int64)
        self._starts = np.cumsum(self._lengths) - self._lengths
        self.is_byte = np.array([kind == BYTE for *_, kind in pieces] or [False], bool)

    def _trie(self) -> None:
        step: dict[int, int] = {}
        final = [-1]
        for text, i in self.ids.items():
            if self.bpe and self._rank[i] < 0 and len(text) > 1:
                continue  # no merges lead to it
            node = 0
            for c in text:
                key = node << _CHAR | ord(c)
                node = step.get(key, -1)
                if node < 0:
                    node = step[key] = len(final)
                    final.append(-1)
            final[node] = i
        self._step, self._final, self._ends = step, final, np.array(final, np.int64)
        self._move = Table(np.fromiter(step, np.int64, len(step)), np.fromiter(step.values(), np.int64, len(step)))

    def merged(self, chars: str, until: int = 1) -> list[str]:
        """The characters merged by best score, leftmost first, while more than ``until`` parts are left."""
        parts = list(chars)
        while len(parts) > until:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = self.score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _merge_trees(self, n: int) -> None:
        """Each piece's rank (better merges are lower, characters -1) and the two parts of its last merge."""
        by_score = {s: k for k, s in enumerate(sorted(set(self.score.values()), reverse=True))}
        self._rank, self._left, self._right = (np.full(n, -1, np.int64) for _ in range(3))
        part = lambda text: self.ids.get(text, self._chars.get(text, -1))
        keys, ranks = [], []
        self._tied = np.zeros(n, bool)  # whether some part comes no earlier than what it is merged to
        for text, i in sorted(self.ids.items(), key=lambda x: len(x[0])):
            for k in range(1, len(text)):
                a, b = part(text[:k]), part(text[k:])
                if a >= 0 and b >= 0:
                    keys.append(a << _PIECE | b)
                    ranks.append(by_score[self.score[text]])
            if len(text) > 1:
                last = self.merged(text, 2)
                if len(last) == 2:
                    self._left[i], self._right[i] = part(last[0]), part(last[1])
                    self._rank[i] = by_score[self.score[text]]
                    self._tied[i] = any(self._tied[part(x)] or len(x) > 1 and self._rank[part(x)] >= self._rank[i] for x in last)
        self._joined = Table(np.array(keys, np.int64), np.array(ranks, np.int64))

    # Borders of merges

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the pieces b may follow the pieces a (-1: the start)."""
        good = np.ones(len(a), bool)
        tied = (a >= 0) & (self._tied[a] | self._tied[b])
        if tied.any():  # no order to undo merges in, so merging has to be tried
            good[tied] = [self._follows(x, y) for x, y in zip(a[tied].tolist(), b[tied].tolist())]
        live = np.flatnonzero((a >= 0) & ~tied)
        x, y = a[live], b[live]
        over_x = over_y = np.full(len(live), _NEVER)
        while len(live):
            joined, rank_x, rank_y = self._joined(x << _PIECE | y), self._rank[x], self._rank[y]
            bad = (joined >= 0) & (joined < over_x) & (joined <= over_y)  # the left of two equal merges is first
            good[live[bad]] = False
            on = np.flatnonzero(~bad & ((rank_x >= 0) | (rank_y >= 0)))
            x, y, rank_x, rank_y, live = x[on], y[on], rank_x[on], rank_y[on], live[on]
            undo = rank_x > rank_y
            over_x, over_y = np.where(undo, rank_x, over_x[on]), np.where(undo, over_y[on], rank_y)
            x, y = np.where(undo, self._right[x], x), np.where(undo, y, self._left[y])
        return good

    def _follows(self, a: int, b: int) -> bool:
        """The same for one pair, which is remembered."""
        if a < 0:
            return True
        if (a, b) not in self._pairs:
            if len(self._pairs) > 100_000:
                self._pairs.clear()
            if self._tied[a] or self._tied[b]:
                self._pairs[a, b] = self.merged(self._names[a] + self._names[b]) == [self._names[a], self._names[b]]
            else:
                self._pairs[a, b] = bool(self.apart(np.array([a]), np.array([b]))[0])
        return self._pairs[a, b]

    # Shortest paths

    def _fallback(self, code: int) -> list[int]:
        return [self.bytes[b] for b in chr(code).encode("utf-8", "surrogatepass")] if self.bytes else [self.unknown]

    def shortest_path(self, chars: str) -> list[int]:
        """Ids of the path of least weight through the lattice of one normalised text.

        A place keeps its best state: (weight, last piece, ids of the last arc, place before).
        """
        n, step, final, weight = len(chars), self._step, self._final, self.weight
        codes = list(map(ord, chars))
        states: list[tuple | None] = [None] * (n + 1)
        states[0] = (np.float32(0), -1, (), 0)
        for i in range(n):
            if states[i] is None:
                continue
            so_far, last = states[i][:2]
            node, j, alone = 0, i, False
            while j < n and (node := step.get(node << _CHAR | codes[j], -1)) >= 0:
                j += 1
                piece = final[node]
                if piece < 0:
                    continue
                alone = alone or j == i + 1
                total, known = so_far + weight[piece], states[j]
                if (known is None or total < known[0]) and not (self.bpe and not self._follows(last, piece)):
                    states[j] = (total, piece, (piece,), i)
            if not alone:
                total, known, char = so_far + self.fallback_weight, states[i + 1], self._chars.get(chars[i], -1)
                if (known is None or total < known[0]) and not (self.bpe and char >= 0 and not self._follows(last, char)):
                    states[i + 1] = (total, char, tuple(self._fallback(codes[i])), i)
        at, out = n, []
        while at:
            out.append(states[at][2])
            at = states[at][3]
        return [k for ids in reversed(out) for k in ids]

    def shortest_paths(self, cuts: list[str]) -> list[bytes]:
        """The same for many texts, some of about one length at once."""
        order = sorted(range(len(cuts)), key=lambda k: -len(cuts[k]))
        out = [b""] * len(cuts)
        for at in range(0, len(order), TOGETHER):
            own = order[at : at + TOGETHER]
            for k, ids in zip(own, self._solved([cuts[k] for k in own])):
                out[k] = ids
        return out

    def _solved(self, texts: list[str]) -> list[bytes]:
        """Shortest paths of texts, the longest first: place by place, all texts' arcs from it together."""
        sizes = np.array([len(t) for t in texts], np.int64)
        n, most = len(texts), int(sizes.max(initial=0))
        flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        which = np.repeat(np.arange(n), sizes)
        chars = np.zeros((most, n), np.int64)
        chars[np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes), which] = flat
        longer = np.searchsorted(-sizes, -np.arange(most), "left")  # how many texts go beyond each place
        best = np.full((most + 1, n), np.inf, np.float32)
        best[0] = 0
        last = np.full((most + 1, n), -1, np.int64)  # the last piece, for borders
        arc = np.full((most + 1, n), -1, np.int64)  # its id, or -2 - the character of a fallback
        back = np.zeros((most + 1, n), np.int64)
        for i in range(most):
            rows = np.flatnonzero(np.isfinite(best[i, : longer[i]]))
            node = np.zeros(len(rows), np.int64)
            for j in range(i, most):
                rows = rows[: np.searchsorted(rows, longer[j])]
                node = self._move(node[: len(rows)] << _CHAR | chars[j, rows])
                if j == i:
                    alone = np.where(node >= 0, self._ends[node], -1) >= 0
                    self._relax(i, i + 1, rows[~alone], None, chars, best, last, arc, back)
                on = np.flatnonzero(node >= 0)
                if not len(on):
                    break
                rows, node = rows[on], node[on]
                piece = self._ends[node]
                ends = np.flatnonzero(piece >= 0)
                self._relax(i, j + 1, rows[ends], piece[ends], chars, best, last, arc, back)
        return self._traced(sizes, arc, back)

    def _relax(self, i: int, j: int, rows: np.ndarray, piece: np.ndarray | None, chars: np.ndarray, best: np.ndarray, last: np.ndarray, arc: np.ndarray, back: np.ndarray) -> None:
        """Takes arcs from place i to j where they make lighter paths; ``piece`` None: the fallback of the character."""
        if not len(rows):
            return
        codes = None if piece is not None else chars[i, rows]
        total = best[i, rows] + (self.weight[piece] if piece is not None else self.fallback_weight)
        piece = piece if codes is None else np.array([self._chars.get(chr(c), -1) for c in codes.tolist()], np.int64)
        better = np.flatnonzero(total < best[j, rows])
        rows, piece, total = rows[better], piece[better], total[better]
        if self.bpe:
            asked = np.flatnonzero(piece >= 0)
            total[asked] = np.where(self.apart(last[i, rows[asked]], piece[asked]), total[asked], np.float32(np.inf))
        new = np.flatnonzero(total < best[j, rows])
        rows = rows[new]
        best[j, rows], last[j, rows], back[j, rows] = total[new], piece[new], i
        arc[j, rows] = piece[new] if codes is None else -2 - codes[better][new]

    def _traced(self, sizes: np.ndarray, arc: np.ndarray, back: np.ndarray) -> list[bytes]:
        at, rows, steps = sizes.copy(), np.flatnonzero(sizes), []
        while len(rows):
            steps.append((rows, arc[at[rows], rows]))
            at[rows] = back[at[rows], rows]
            rows = rows[at[rows] > 0]
        if not steps:
            return [b""] * len(sizes)
        rows, ids = (np.concatenate(x) for x in zip(*reversed(steps)))
        sort = np.argsort(rows, kind="stable")
        rows, ids = rows[sort], ids[sort]
        if (ids < 0).any():
            spelled = {c: self._fallback(-2 - c) for c in np.unique(ids[ids < 0]).tolist()}
            times = np.ones(len(ids), np.int64)
            for c, own in spelled.items():
                times[ids == c] = len(own)
            places = np.cumsum(times) - times
            rows, wide = np.repeat(rows, times), np.repeat(ids, times)
            for c, own in spelled.items():
                first = places[ids == c]
                for k, i in enumerate(own):
                    wide[first + k] = i
            ids = wide
        raw = ids.astype("<u4").tobytes()
        ends = (4 * np.cumsum(np.bincount(rows, minlength=len(sizes)))).tolist()
        return [raw[a:b] for a, b in zip([0, *ends[:-1]], ends)]

    # Texts

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        normal = map(self.normaliser, texts)
        cuts = [_CUTS.findall(t) for t in normal] if self.cut else [[t] if t else [] for t in normal]
        known = self._paths
        new = list(set().union(*cuts).difference(known))
        short = [c for c in new if len(c) <= LONG_CUT]
        known.update(zip(short, self.shortest_paths(short)))
        known.update((c, np.array(self.shortest_path(c), "<u4").tobytes()) for c in new if len(c) > LONG_CUT)
        out = [np.frombuffer(b"".join(map(known.__getitem__, own)), "<u4") for own in cuts]
        for c in new:
            self._room -= ENTRY_BYTES + len(known[c]) + 2 * len(c)
            if self._room < 0 or len(c) > LONG_CUT:
                self._room += ENTRY_BYTES + len(known[c]) + 2 * len(c)
                del known[c]
        if not self.bytes:  # neighbouring unknown characters are one unknown id
            out = [ids[np.concatenate([[True], (ids[1:] != self.unknown) | (ids[:-1] != self.unknown)])] if len(ids) else ids for ids in out]
        return out

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]

    def decode_all(self, coded: list[np.ndarray]) -> list[str]:
        kept = [ids[ids < len(self._lengths)].astype(np.int64) for ids in coded]
        flat = np.concatenate([np.zeros(0, np.int64), *kept])
        sizes = self._lengths[flat]
        ends = np.cumsum(sizes)
        raw = self._blob[np.repeat(self._starts[flat] - (ends - sizes), sizes) + np.arange(int(sizes.sum()))].tobytes()
        stops = np.concatenate([[0], ends])[np.cumsum([0, *map(len, kept)])].tolist()
        texts = [self._text(raw[a:b]) for a, b in zip(stops, stops[1:])]
        return [t[self._blank_pieces(ids) :] for t, ids in zip(texts, kept)]

    def _blank_pieces(self, ids: np.ndarray) -> int:
        """How many blanks go: one of the first piece, and where blanks are folded one of each up to the first with more than it."""
        gone = 0
        if self.normaliser.prefix or self.normaliser.fold_blanks:
            for i in ids.tolist():
                if i == self.unknown or not self._lengths[i] or self._blob[self._starts[i]] != 32:
                    break
                gone += 1
                if self._lengths[i] > 1 or not self.normaliser.fold_blanks:
                    break
        return gone

    @staticmethod
    def _text(raw: bytes) -> str:
        try:
            return raw.decode("utf-8")
        except UnicodeDecodeError:
            return raw.decode("utf-8", "replace")

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_all([ids])[0]


@lru_cache(maxsize=2)
def transducer(path: str) -> Transducer:
    """Compiled once in each worker and for each model file."""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:  # a vocabulary that each machine has installed
        model.ParseFromString(f.read())
    rules, kind = model.normalizer_spec, model.trainer_spec.model_type
    if not rules.escape_whitespaces or kind not in (UNIGRAM, BPE) or model.trainer_spec.treat_whitespace_as_suffix:
        raise ValueError("the model's normalisation or type is not supported")
    normaliser = Normaliser(charsmap_rules(rules.precompiled_charsmap) if rules.precompiled_charsmap else {}, rules.add_dummy_prefix, rules.remove_extra_whitespaces)
    return Transducer([(p.piece, p.score, p.type) for p in model.pieces], kind == BPE, normaliser, model.trainer_spec.unk_surface)


def _rows(docs: DataFrame) -> DataFrame:
    return with_small_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")))


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int | None], list[str]]]:
    """Rows (id, text) in groups of a bounded size, or one long text."""
    for batch in batches:
        names, texts, size = [], [], 0
        for name, text in zip(batch.column(0), batch.column(1)):
            names.append(name.as_py())
            texts.append(text.as_py())
            size += len(texts[-1])
            if size >= GROUP_CHARS:
                yield names, texts
                names, texts, size = [], [], 0
        if names:
            yield names, texts


def encode(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, ids) of each document."""
    kinds = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = transducer(model)
        try:
            for names, texts in _groups(batches):
                ids = own.encode_all(texts)
                ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
                flat = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(ids).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), flat], schema=kinds)
        finally:
            own.release()

    return _rows(docs).mapInArrow(encoded, "doc_id long, ids array<int>")


def decode(coded: DataFrame, model: str) -> DataFrame:
    """(doc_id, text) of rows of (doc_id, ids)."""
    kinds = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = transducer(model)
        for batch in batches:
            texts = [own.decode(np.array([i for i in ids.as_py() or [] if i is not None and i >= 0], "<u4")) for ids in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], schema=kinds)

    return coded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(decoded, "doc_id long, text string")


def round_trip(docs: DataFrame, model: str) -> DataFrame:
    """A digest per document: its ids' number and crc32, ids of bytes, decoded length, and whether the text came back."""
    kinds = pa.schema([("doc_id", pa.int64()), ("n_ids", pa.int64()), ("ids_crc32", pa.int64()), ("n_byte_ids", pa.int64()), ("n_chars", pa.int64()), ("text_back", pa.bool_())])

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = transducer(model)
        try:
            for names, texts in _groups(batches):
                coded = own.encode_all(texts)
                back = own.decode_all(coded)
                columns = [
                    names, [len(ids) for ids in coded], [zlib.crc32(ids.tobytes()) for ids in coded], [int(own.is_byte[ids].sum()) for ids in coded],
                    [len(t) for t in back], [b == t.replace(SPACE, " ") for b, t in zip(back, texts)],
                ]
                yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(columns, kinds)], schema=kinds)
        finally:
            own.release()

    return _rows(docs).mapInArrow(both, "doc_id long, n_ids long, ids_crc32 long, n_byte_ids long, n_chars long, text_back boolean")
