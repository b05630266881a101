"""SentencePiece encoding and decoding by a batched Viterbi search in numpy.

Words of one length advance together: at each place all substrings that end there are looked up by hash in the sorted
piece keys, and the best one is stored as a backpointer for every word at once. For a unigram model the maximum is taken
over the sum of the scores. For a BPE model a sum says nothing; there the one candidate that can follow the best path to
its start is taken: a piece fits after another if merging in the order of the scores would not cross the border between
them, so the path is the one that merging yields, and the ids are those that the public library returns.

Long words (texts of scripts without spaces are one word) are first cut at their safe borders, which no piece of the model
spans: nothing before such a border has to do with what follows. The parts then advance together as words do.
"""

from __future__ import annotations

import heapq
import itertools
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import carried, documents, releasing, uncarried

SPACE = "▁"
_BASE = 0x9E3779B97F4A7C15
_NORMAL, _UNKNOWN, _CONTROL, _USER, _BYTE, _UNUSED = 1, 2, 3, 4, 6, 5
MAX_MODEL_BYTES = 64 << 20
#: Words that a worker holds within a task, and those (the ones met first, which tend to be the frequent ones) that it goes on with.
CACHED_WORDS, KEPT_WORDS = 1_000_000, 300_000
#: Words from this length on are cut at safe borders; characters that are looked through at once, parts that are encoded at
#: once, and substrings that one step of the search looks up.
LONG_WORD, STRETCH, PARTS, LOOKUPS = 256, 1 << 16, 1 << 16, 1 << 21


def _varint(b: bytes, i: int) -> tuple[int, int]:
    x = shift = 0
    while True:
        c = b[i]
        i += 1
        x |= (c & 127) << shift
        shift += 7
        if c < 128:
            return x, i


def _fields(b: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a protocol-buffer message."""
    i = 0
    while i < len(b):
        tag, i = _varint(b, i)
        kind = tag & 7
        if kind == 0:
            value, i = _varint(b, i)
        else:
            size, i = _varint(b, i) if kind == 2 else ({1: 8, 5: 4}[kind], i)
            value, i = b[i : i + size], i + size
        yield tag >> 3, value


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class Model:
    """Pieces of a model file as arrays: keys sorted by hash, scores, order of merging, and how each piece is merged last."""

    def __init__(self, raw: bytes):
        self.pieces: list[str] = []
        scores, kinds = [], []
        bpe, dummy, extra, escape = False, True, True, True
        for number, value in _fields(raw):
            if number == 1:
                d = dict(_fields(value))
                self.pieces.append(d[1].decode())
                scores.append(struct.unpack("<f", d[2])[0] if 2 in d else 0.0)
                kinds.append(d.get(3, _NORMAL))
            elif number == 2:
                kind = dict(_fields(value)).get(3, 1)
                if kind not in (1, 2):
                    raise ValueError("only unigram and BPE models are read")
                bpe = kind == 2
            elif number == 3:
                d = dict(_fields(value))
                if d.get(2):
                    raise ValueError("a model with its own character map is not read")
                dummy, extra, escape = bool(d.get(3, 1)), bool(d.get(4, 1)), bool(d.get(5, 1))
        if extra or not escape:
            raise ValueError("a model that drops or keeps plain spaces is not read")
        self.bpe, self.dummy = bpe, dummy
        self.scores, self.kinds = np.array(scores), np.array(kinds)
        self.unknown = next((i for i, k in enumerate(kinds) if k == _UNKNOWN), 0)
        self.byte_ids = {int(self.pieces[i][3:5], 16): i for i in np.flatnonzero(self.kinds == _BYTE).tolist()}
        usable = [i for i, k in enumerate(kinds) if k == _NORMAL and self.pieces[i]]
        self.ids = {self.pieces[i]: i for i in usable}
        self.longest = max((len(self.pieces[i]) for i in usable), default=1)
        self.powers = np.array([pow(_BASE, n, 1 << 64) for n in range(self.longest + 1)], np.uint64)
        hashes = np.array([self._hash(self.pieces[i]) for i in usable], np.uint64)
        order = np.argsort(_mixed(hashes), kind="stable")
        self.keys, self.key_ids = _mixed(hashes)[order], np.array(usable, np.int64)[order]
        if (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two pieces share a hash")
        #: Where the keys of each leading bit pattern start, so that a probe looks at a few keys only.
        self.shift = np.uint64(64 - max(8, int(len(usable) * 4).bit_length()))
        leading = (self.keys >> self.shift).astype(np.int64)
        self.starts = np.searchsorted(leading, np.arange((1 << int(64 - int(self.shift))) + 1))
        self.crowded = int(np.diff(self.starts).max(initial=0))
        #: Pieces that do not start with the space mark never hold one, so words can be split there.
        self.splits = not any(SPACE in self.pieces[i].lstrip(SPACE) for i in usable)
        n = len(self.pieces)
        self.hash_of, self.len_of = np.zeros(n + 1, np.uint64), np.zeros(n + 1, np.int64)
        self.hash_of[usable], self.len_of[usable] = hashes, [len(self.pieces[i]) for i in usable]
        self.worst = min((scores[i] for i in usable), default=0.0) - 10
        if bpe:
            self._order()

    @staticmethod
    def _hash(s: str) -> int:
        h = 0
        for c in s:
            h = (h * _BASE + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
        return h

    def _order(self) -> None:
        """turn: when a piece is merged (-1: single characters); left, right: the two pieces of its last merge."""
        n = len(self.pieces)
        merged = sorted((i for i in self.ids.values() if len(self.pieces[i]) > 1), key=lambda i: -self.scores[i])
        self.turn = np.full(n + 1, -1, np.int64)
        self.left, self.right = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
        self.turn[merged] = np.arange(len(merged))
        turn, left, right = self.turn.tolist(), self.left.tolist(), self.right.tolist()
        pieces, ids = self.pieces, self.ids
        #: Pieces with one score are merged from the left; words with them are merged one by one.
        same = {}
        for i in merged:
            same.setdefault(self.scores[i], []).append(i)
        self.tied = {i for group in same.values() if len(group) > 1 for i in group}
        lost = []

        def fits(a: int, b: int) -> bool:
            limit = len(merged)
            while True:
                c = ids.get(pieces[a] + pieces[b])
                if c is not None and turn[c] < limit:
                    return False
                if turn[a] < 0 and turn[b] < 0:
                    return True
                if turn[a] > turn[b]:
                    limit, a = turn[a], right[a]
                else:
                    limit, b = turn[b] + 1, left[b]

        gone = set()
        for t, i in enumerate(merged):
            s = pieces[i]
            for j in range(1, len(s)):
                a, b = ids.get(s[:j]), ids.get(s[j:])
                # before its own turn a piece cannot be merged, so its halves meet if nothing earlier crosses their border
                if a is not None and b is not None and a not in gone and b not in gone and turn[a] < t and turn[b] < t:
                    turn[i] = len(merged)
                    ok = fits(a, b)
                    turn[i] = t
                    if ok:
                        left[i], right[i] = a, b
                        break
            else:
                gone.add(i)
                lost.append(i)
        #: A piece that merging never yields is no candidate.
        self.reached = np.ones(n + 1, bool)
        self.reached[lost] = False
        self.left, self.right = np.array(left), np.array(right)


class Encoder:
    def __init__(self, model: Model):
        self.m = model
        self.clear()
        self.shown = None
        size = 1 << 20
        self.seen, self.verdict = np.full(size, -1, np.int64), np.zeros(size, bool)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Ids of the pieces with these hashes, or -1."""
        m = self.m
        flat = _mixed(hashes.ravel())
        lead = (flat >> m.shift).astype(np.int64)
        at, stop = m.starts[lead], m.starts[lead + 1]
        out = np.full(len(flat), -1, np.int64)
        live = np.flatnonzero(at < stop)
        at, stop, want = at[live], stop[live], flat[live]
        for _ in range(m.crowded):
            same = m.keys[at] == want
            out[live[same]] = m.key_ids[at[same]]
            more = ~same & (at + 1 < stop)
            live, at, stop, want = live[more], at[more] + 1, stop[more], want[more]
            if not len(live):
                break
        return out.reshape(hashes.shape)

    def fits(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether piece b can stand after piece a; what is once found out is kept in a table of fixed size."""
        n = len(self.m.pieces)
        code = a * n + b
        slot = ((code.astype(np.uint64) * np.uint64(_BASE)) >> np.uint64(44)).astype(np.int64)
        out = self.verdict[slot]
        new = np.flatnonzero(self.seen[slot] != code)
        if len(new):
            code, first = np.unique(code[new], return_index=True)
            found = self._fits(a[new][first], b[new][first])
            out[new] = found[np.searchsorted(code, (a[new] * n + b[new]))]
            slot = slot[new][first]
            self.seen[slot], self.verdict[slot] = code, found
            # two codes may share a slot; the one written last counts
            self.verdict[slot] = found[np.searchsorted(code, self.seen[slot])]
        return out

    def _fits(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        m = self.m
        a, b = a.copy(), b.copy()
        out = np.ones(len(a), bool)
        live = np.arange(len(a))
        limit = np.full(len(a), len(m.pieces), np.int64)
        while len(live):
            x, y = a[live], b[live]
            size = m.len_of[x] + m.len_of[y]
            c = self.find(m.hash_of[x] * m.powers[np.minimum(m.len_of[y], m.longest)] + m.hash_of[y])
            crossed = (size <= m.longest) & (c >= 0) & (m.turn[c] < limit[live])
            out[live[crossed]] = False
            done = crossed | ((m.turn[x] < 0) & (m.turn[y] < 0))
            live, x, y = live[~done], x[~done], y[~done]
            tx, ty = m.turn[x], m.turn[y]
            from_left = tx > ty
            limit[live] = np.where(from_left, tx, ty + 1)
            a[live] = np.where(from_left, m.right[x], x)
            b[live] = np.where(from_left, y, m.left[y])
        return out

    def viterbi(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of one length, which advance together, one after another, and how many each has."""
        m, n, size = self.m, len(words), len(words[0])
        unknown = len(m.pieces)
        w = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(n, size).astype(np.uint64) + np.uint64(1)
        prefix = np.zeros((n, size + 1), np.uint64)
        for j in range(size):
            prefix[:, j + 1] = prefix[:, j] * np.uint64(_BASE) + w[:, j]
        most = min(m.longest, size)
        # pieces that end in a stretch of places are looked up together; the arrays of a word of any length are its own size
        step = max(1, LOOKUPS // (most * n))
        last, back = np.full((size + 1, n), unknown, np.int32), np.ones((size + 1, n), np.int32)
        total = np.zeros((1 if m.bpe else size + 1, n))
        for j in range(1, size + 1):
            if (j - 1) % step == 0:
                found = self._ending(prefix, j, min(size, j + step - 1), most)
            most_here = min(most, j)
            cand = found[(j - 1) % step, :most_here]
            before = last[j - most_here : j][::-1]
            k, i = np.nonzero(cand >= 0)
            if m.bpe:
                value = np.zeros((most_here, n))
                a, b = before[k, i], cand[k, i]
                free = (k + 1 == j) | (a == unknown)
                ok = free.copy()
                ask = np.flatnonzero(~free)
                ok[ask] = self.fits(a[ask], b[ask])
                value[k[ok], i[ok]] = k[ok] + 1
                best = value.argmax(axis=0)
                none = value.max(axis=0) == 0
            else:
                value = np.full((most_here, n), -np.inf)
                value[k, i] = total[j - 1 - k, i] + m.scores[cand[k, i]]
                value[0] = np.where(cand[0] >= 0, value[0], total[j - 1] + m.worst)
                best = value.argmax(axis=0)
                total[j] = value.max(axis=0)
                none = cand[best, np.arange(n)] < 0
            back[j] = np.where(none, 1, best + 1)
            last[j] = np.where(none, unknown, cand[np.where(none, 0, best), np.arange(n)])
        ids, rows, pos, col = np.full((n, size), -1, np.int32), np.arange(n), np.full(n, size), size
        while len(rows):
            col -= 1
            ids[rows, col] = last[pos, rows]
            pos = pos - back[pos, rows]
            rows, pos = rows[pos > 0], pos[pos > 0]
        sizes = (ids >= 0).sum(axis=1)
        strange = np.flatnonzero((ids == unknown).any(axis=1))
        if not len(strange):
            return ids[ids >= 0], sizes
        parts = [r[r >= 0] for r in ids]
        for i in strange.tolist():
            path, j = [], size
            while j:
                path.append((int(last[j, i]), words[i][j - 1]))
                j -= int(back[j, i])
            parts[i] = np.array(self._bytes(path[::-1]), np.int64)
        return np.concatenate(parts), np.array([len(x) for x in parts])

    def _ending(self, prefix: np.ndarray, first: int, last: int, most: int) -> np.ndarray:
        """Of words with these prefix hashes: ids (or -1) of the substrings that end at the places first to last, by place, length less one, and word."""
        m = self.m
        out = np.full((last - first + 1, most, len(prefix)), -1, np.int64)
        for k in range(1, most + 1):
            a = max(first, k)
            if a > last:
                break
            ids = self.find(prefix[:, a : last + 1] - prefix[:, a - k : last + 1 - k] * m.powers[k])
            if m.bpe:
                ids = np.where((ids >= 0) & m.reached[ids], ids, -1)
            out[a - first :, k - 1, :] = ids.T
        return out

    def parts(self, word: str) -> list[str]:
        """A word cut at its safe borders: places that no piece of the model spans."""
        m, size = self.m, len(word)
        code = np.frombuffer(word.encode("utf-32-le"), "<u4")
        safe = []
        for at in range(0, size, STRETCH):
            low, high = max(0, at - m.longest), min(size, at + STRETCH + m.longest)
            w = code[low:high].astype(np.uint64) + np.uint64(1)
            spanned = np.zeros(len(w) + 1, np.int64)
            hashes = w
            for k in range(2, min(m.longest, len(w)) + 1):
                hashes = hashes[:-1] * np.uint64(_BASE) + w[k - 1 :]
                start = np.flatnonzero(self.find(hashes) >= 0)
                spanned[start + 1] += 1
                np.add.at(spanned, start + k, -1)
            free = np.flatnonzero(np.cumsum(spanned)[: len(w)] == 0) + low
            safe.append(free[(free > 0) & (free >= at) & (free < at + STRETCH)])
        cuts = [0, *np.concatenate(safe).tolist(), size] if safe else [0, size]
        return [word[a:b] for a, b in itertools.pairwise(cuts)]

    def long_word(self, word: str) -> np.ndarray:
        """Ids of a long word by those of its parts."""
        m, parts = self.m, self.parts(_marked(word))
        out: list[np.ndarray] = []
        for i in range(0, len(parts), PARTS):
            by_size: dict[int, set[str]] = {}
            for p in parts[i : i + PARTS]:
                by_size.setdefault(len(p), set()).add(p)
            ids: dict[str, np.ndarray] = {}
            for size, group in by_size.items():
                some = sorted(group)
                step = max(1, (1 << 19) // (size * min(size, m.longest)))
                for j in range(0, len(some), step):
                    flat, sizes = self.viterbi(some[j : j + step])
                    ids.update(zip(some[j : j + step], np.split(flat, np.cumsum(sizes)[:-1]), strict=True))
            out += [ids[p] for p in parts[i : i + PARTS]]
        flat = np.concatenate(out)
        if not m.byte_ids:  # characters without a piece in a row are one unknown
            flat = flat[~((flat == m.unknown) & (np.append(-1, flat[:-1]) == m.unknown))]
        return flat

    def _bytes(self, path: list[tuple[int, str]]) -> tuple[int, ...]:
        m, out = self.m, []
        for i, c in path:
            if i < len(m.pieces):
                out.append(i)
            elif m.byte_ids:
                out += [m.byte_ids[b] for b in c.encode()]
            elif not out or out[-1] != m.unknown:
                out.append(m.unknown)
        return tuple(out)

    def merged(self, word: str) -> tuple[int, ...]:
        """Ids of one word by merging, for pieces with one score and as a check."""
        m = self.m
        part, after, before = list(word), list(range(1, len(word) + 1)), list(range(-1, len(word) - 1))
        heap: list[tuple[float, int, int, str]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < len(word) and (t := m.ids.get(part[i] + part[j])) is not None:
                heapq.heappush(heap, (-m.scores[t], i, j, part[i] + part[j]))

        for i in range(len(word) - 1):
            offer(i)
        while heap:
            _, i, j, s = heapq.heappop(heap)
            if not part[i] or after[i] != j or part[i] + part[j] != s:
                continue
            part[i], part[j], after[i] = s, "", after[j]
            if after[j] < len(word):
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return self._bytes([(m.ids.get(s, len(m.pieces)), s) for s in part if s])

    def learn(self, words: set[str]) -> None:
        """Put the ids of the words into the cache."""
        m = self.m
        by_size: dict[int, list[str]] = {}
        odd: list[str] = []
        for word in words:
            if m.bpe and m.tied and _DOUBLE.search(word):
                odd.append(word)
            elif len(word) >= LONG_WORD:
                ids = self.long_word(word)
                self._store([word], ids, np.array([len(ids)]))
            else:
                by_size.setdefault(len(word), []).append(word)
        if odd:
            got = [self.merged(_marked(w)) for w in odd]
            self._store(odd, np.array([i for x in got for i in x], np.int64), np.array([len(x) for x in got], np.int64))
        for size, group in by_size.items():
            step = max(1, (1 << 19) // (size * min(size, m.longest)))
            for i in range(0, len(group), step):
                part = group[i : i + step]
                self._store(part, *self.viterbi([_marked(w) for w in part]))

    def _store(self, words: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        n = len(self.cache)
        while n + len(words) > len(self.first):
            self.first, self.count = (np.concatenate([x, np.zeros_like(x)]) for x in (self.first, self.count))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.first[n : n + len(words)] = self.used + np.cumsum(sizes) - sizes
        self.count[n : n + len(words)] = sizes
        self.used += len(ids)
        self.cache.update(zip(words, range(n, n + len(words)), strict=True))

    def clear(self) -> None:
        self.cache: dict[str, int] = {}
        self.first, self.count, self.flat, self.used = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(4096, np.int32), 0

    def shrink(self, kept: int = KEPT_WORDS) -> None:
        """Forget all but the words that were met first."""
        n = min(kept, len(self.cache))
        self.cache = dict(itertools.islice(self.cache.items(), n))
        self.used = int(self.first[n - 1] + self.count[n - 1]) if n else 0
        self.first, self.count = self.first[: max(n, 1)].copy(), self.count[: max(n, 1)].copy()
        self.flat = self.flat[: max(self.used, 1)].copy()

    def encode_flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and where those of each text start (with the end of the last)."""
        m = self.m
        split: list[list[str]] = []
        for text in texts:
            if not text:
                split.append([])
            elif m.splits:
                split.append(_WORDS.findall(" " + text if m.dummy else text))
            else:
                split.append([" " + text if m.dummy else text])
        words = set().union(*split)
        if len(self.cache) + len(words) > CACHED_WORDS:
            self.shrink()
        if new := words.difference(self.cache):
            self.learn(new)
        each = np.array([len(x) for x in split], np.int64)
        at = np.fromiter(map(self.cache.__getitem__, itertools.chain.from_iterable(split)), np.int64, int(each.sum()))
        count = self.count[at]
        total = np.concatenate([[0], np.cumsum(count)])
        flat = self.flat[np.repeat(self.first[at] - total[:-1], count) + np.arange(total[-1])]
        return flat, total[np.concatenate([[0], np.cumsum(each)])]

    def encode(self, texts: list[str]) -> list[list[int]]:
        flat, at = self.encode_flat(texts)
        return [flat[a:b].tolist() for a, b in itertools.pairwise(at.tolist())]

    def decode_flat(self, flat: np.ndarray, at: np.ndarray) -> list[str]:
        """Texts of the ids between the places at."""
        m = self.m
        if self.shown is None:
            raw = [p.replace(SPACE, " ").encode() for p in m.pieces]
            for i in np.flatnonzero(m.kinds == _CONTROL).tolist():
                raw[i] = b""
            raw[m.unknown] = " ⁇ ".encode()
            for value, i in m.byte_ids.items():
                raw[i] = bytes([value])
            size = np.array([len(x) for x in raw], np.int64)
            self.shown = (np.frombuffer(b"".join(raw), np.uint8), np.cumsum(size) - size, size)
        data, first, size = self.shown
        count = size[flat]
        total = np.concatenate([[0], np.cumsum(count)])
        joined = data[np.repeat(first[flat] - total[:-1], count) + np.arange(total[-1])].tobytes()
        out = []
        for a, b in itertools.pairwise(total[at].tolist()):
            text = joined[a:b].decode(errors="replace")
            out.append(text[1:] if m.dummy and text.startswith(" ") else text)
        return out

    def decode(self, many: list[list[int]]) -> list[str]:
        at = np.concatenate([[0], np.cumsum([len(x) for x in many])]).astype(np.int64)
        return self.decode_flat(np.array([i for x in many for i in x], np.int64), at)


#: Words: space marks (or spaces, which become marks) and what follows them; a word never goes on after a mark.
_WORDS = re.compile(f"[ {SPACE}]*[^ {SPACE}]+|[ {SPACE}]+")
_DOUBLE = re.compile(f"[ {SPACE}][ {SPACE}]")


def _marked(word: str) -> str:
    return word.replace(" ", SPACE)


_held: dict[int, Encoder] = {}


def _encoder(model) -> Encoder:
    """One encoder per worker and model, with its cache of words."""
    m = model.value
    if id(m) not in _held:
        _held.clear()
        _held[id(m)] = Encoder(m)
    return _held[id(m)]


def load_model(path: str) -> Model:
    with open(path, "rb") as f:
        raw = f.read(MAX_MODEL_BYTES + 1)
    if len(raw) > MAX_MODEL_BYTES:
        raise ValueError("the model is larger than MAX_MODEL_BYTES, and each task holds it whole")
    return Model(raw)


def encode(docs: DataFrame, model_path: str, carry: tuple[str, ...] = (), column: str | None = None) -> DataFrame:
    """doc_id, ids (array of int) and text, then the columns named in carry; column: the text of the ids too, decoded in the same pass.

    Nulls: a null text is empty and has no ids; a row with a null doc_id is left out. Repeated rows are encoded each. A
    character without a piece becomes the ids of its UTF-8 bytes. Texts are encoded whole; one word may be as long as
    its text, and takes memory in proportion to it. Ties of scores go to the earlier place, as in the public library.
    Columns that are not carried are not read; a carried one may not be named like one of the result. An empty table
    gives no rows.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(load_model(model_path))
    d = documents(docs, *carried(carry, "doc_id", "ids", "text", *([column] if column else [])))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = _encoder(shared)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            at = 0
            while at < len(texts):  # texts of some megabytes at a time
                held, to = 0, at
                while to < len(texts) and held < 1 << 20:
                    held += len(texts[to])
                    to += 1
                flat, offsets = e.encode_flat(texts[at:to])
                part = batch.slice(at, to - at)
                more = [pa.array(e.decode_flat(flat, offsets), pa.string())] if column else []
                yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(offsets.astype(np.int32), pa.array(flat)), *more], names=[*part.schema.names, "ids", *([column] if column else [])])
                at = to
        e.shrink()  # the worker lives on, and other operators need the memory

    out = d.mapInArrow(releasing(run), f"{kinds}, ids array<int>" + (f", `{column}` string" if column else ""))
    return out.select("doc_id", "ids", "text", *([column] if column else []), *uncarried(carry))


def decode(encoded: DataFrame, model_path: str, column: str = "decoded") -> DataFrame:
    """The rows of encoded with the text of their ids (null ids: null) in one more column.

    The round trip is exact but for the mark U+2581 itself, which comes back as a space, as in the public library.
    """
    shared = encoded.sparkSession.sparkContext.broadcast(load_model(model_path))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    at = encoded.columns.index("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = _encoder(shared)
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                ids = part.column(at)
                sizes = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                texts = e.decode_flat(ids.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(sizes)]))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string(), mask=ids.is_null().to_numpy(zero_copy_only=False))], names=[*part.schema.names, column])

    return encoded.mapInArrow(releasing(run), f"{kinds}, `{column}` string")


def digest(encoded: DataFrame) -> list[Column]:
    """Digest columns of decoded rows: n_tokens, ids_hash (xxhash64 of the ids), exact (the text comes back)."""
    return [F.size("ids").cast("long").alias("n_tokens"), F.xxhash64("ids").alias("ids_hash"), (F.col("decoded") == F.col("text")).alias("exact")]
