"""Byte-level BPE as two compiled transducers.

1. A pre-token transducer over character classes.  Every fixed-size chunk of a batch
   yields a *state map* (end state for each possible start state); the maps compose
   with a parallel prefix scan, which gives each chunk its true start state.  A second
   pass then marks where pre-tokens begin.
2. A BPE transducer over the bytes of one pre-token.  A state is what later bytes can
   still change: for each open start position the trie node, the last token before it
   and its token count relative to now.  A transition is annotated with the number of
   tokens that it emits (negative when a merge takes tokens back), so a word's token
   count is the sum of its annotations.  States are determinised when first reached.
"""

from __future__ import annotations

import json
from array import array
from functools import cached_property, lru_cache

import numpy as np

from .common import Memo, release_memory

CHUNK = 128
#: Lanes are carried for every start state until this many steps; most chunks agree by then.
CONVERGE = 16
#: Compiled states of a process; a full table starts anew.
STATES = 400_000
#: Characters that are worked on at once, and rows whose texts are made Python strings at once.
SLAB, ROWS = 500_000, 2000

# Character classes: letters that can occur in a contraction have their own.
_LETTER, _NUMBER, _OTHER, _SPACE, _WHITE, _APOS = range(6)
_CONTRACT = "stmdrevl"
_END = 6 + len(_CONTRACT)
# States.
_START, _L, _N, _O, _SP, _W, _RUN_SPACE, _RUN_WHITE, _A, _AR, _AV, _AL, _DONE = range(13)
N_STATES = 13


@lru_cache(maxsize=1)
def char_classes() -> np.ndarray:
    """Class of every code point, as the library sees it.

    Where two Unicode versions at hand disagree on a code point, the library itself is asked.
    """
    import unicodedata

    import regex
    from tokenizers.pre_tokenizers import ByteLevel

    out = np.full(0x110000, _OTHER, np.uint8)
    points = "".join(map(chr, range(0xD800))) + "".join(map(chr, range(0xE000, 0x110000)))
    for pattern, k in ((r"\p{L}", _LETTER), (r"\p{N}", _NUMBER), (r"\s", _WHITE)):
        hits = "".join(regex.findall(pattern, points))
        out[np.frombuffer(hits.encode("utf-32-le"), "<u4")] = k
    ours = np.array([{"L": _LETTER, "N": _NUMBER, "Z": _WHITE}.get(unicodedata.category(c)[0], _OTHER) for c in points], np.uint8)
    at = np.frombuffer(points.encode("utf-32-le"), "<u4")
    split = ByteLevel(add_prefix_space=False).pre_tokenize_str
    for c in at[ours != out[at]].tolist():
        found = [k for k, x in ((_LETTER, "a"), (_NUMBER, "1"), (_OTHER, "!")) if len(split(x + chr(c))) == 1]
        out[c] = found[0] if found else _WHITE
    out[ord(" ")], out[ord("'")] = _SPACE, _APOS
    for i, c in enumerate(_CONTRACT):
        out[ord(c)] = 6 + i
    return out


@lru_cache(maxsize=1)
def pretoken_table() -> np.ndarray:
    """[state * 16 + class] -> next state | 16 * (token starts here) | 32 * (token starts at the previous character)."""
    letters = {_LETTER, *range(6, _END)}
    cls = {c: 6 + i for i, c in enumerate(_CONTRACT)}

    def fresh(c):
        if c in letters:
            return _L
        return {_NUMBER: _N, _OTHER: _O, _SPACE: _SP, _WHITE: _W, _APOS: _A, _END: _START}[c]

    def joined(c):  # what follows a token's leading space
        return _L if c in letters else _N if c == _NUMBER else _O

    def step(s, c):
        new = fresh(c) | 16
        white = c in (_SPACE, _WHITE)
        if s == _L:
            return _L if c in letters else new
        if s == _N:
            return _N if c == _NUMBER else new
        if s == _O:
            return _O if c in (_OTHER, _APOS) else new
        if s in (_SP, _W, _RUN_SPACE, _RUN_WHITE):
            if white:
                return _RUN_SPACE if c == _SPACE else _RUN_WHITE
            if c == _END:
                return new
            if s == _SP:
                return joined(c)
            if s == _W:
                return new
            return joined(c) | 32 if s == _RUN_SPACE else new | 32
        if s == _A:
            if c in (cls["s"], cls["t"], cls["m"], cls["d"]):
                return _DONE
            if c in (cls["r"], cls["v"], cls["l"]):
                return {cls["r"]: _AR, cls["v"]: _AV, cls["l"]: _AL}[c]
            return _O if c in (_OTHER, _APOS) else new
        if s in (_AR, _AV, _AL):
            if c == (cls["l"] if s == _AL else cls["e"]):
                return _DONE
            return (_L if c in letters else new) | 32
        return new  # _START, _DONE

    table = np.zeros(16 * 16, np.uint8)
    for s in range(N_STATES):
        for c in range(_END + 1):
            table[s * 16 + c] = step(s, c)
    return table


def chunk_maps(classes: np.ndarray) -> np.ndarray:
    """State map of each chunk: classes is (CHUNK, chunks); returns (chunks, N_STATES)."""
    table = pretoken_table() & 15
    n = classes.shape[1]
    state = np.repeat(np.arange(N_STATES, dtype=np.uint8)[:, None], n, axis=1)
    for t in range(min(CONVERGE, len(classes))):
        state = table[(state << 4) | classes[t]]
    apart = np.flatnonzero((state != state[0]).any(axis=0))
    lane = state[0]
    rest = state[:, apart]
    for t in range(CONVERGE, len(classes)):
        lane = table[(lane << 4) | classes[t]]
        if len(apart):
            rest = table[(rest << 4) | classes[t][apart]]
    maps = np.repeat(lane[:, None], N_STATES, axis=1)
    maps[apart] = rest.T
    return maps


def scan_maps(maps: np.ndarray) -> np.ndarray:
    """Inclusive parallel prefix composition: row i maps a start state before chunk 0 to the state after chunk i."""
    maps, d = maps.copy(), 1
    while d < len(maps):
        maps[d:] = np.take_along_axis(maps[d:], maps[:-d], axis=1)
        d *= 2
    return maps


def token_starts(classes: np.ndarray) -> np.ndarray:
    """Positions where a pre-token (or an end mark) begins."""
    n = len(classes)
    chunks = -(-n // CHUNK)
    grid = np.full(chunks * CHUNK, _END, np.uint8)
    grid[:n] = classes
    grid = np.ascontiguousarray(grid.reshape(chunks, CHUNK).T)
    state = np.empty(chunks, np.uint8)
    state[0] = _START
    state[1:] = scan_maps(chunk_maps(grid))[:-1, _START]
    table, out = pretoken_table(), np.empty_like(grid)
    for t in range(CHUNK):
        out[t] = table[(state << 4) | grid[t]]
        state = out[t] & 15
    marks = np.ascontiguousarray(out.T).reshape(-1)
    starts = (marks & 16) > 0
    starts[:-1] |= (marks[1:] & 32) > 0
    return np.flatnonzero(starts[:n])


class Bpe:
    """The second transducer, compiled from the vocabulary and merges of a tokenizer file."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(visible)]
        byte_of = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.ids = {bytes(byte_of[c] for c in w): i for w, i in spec["model"]["vocab"].items() if w not in self.special}
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        order = [spec["model"]["vocab"][a + b] for a, b in merges]
        if order != sorted(order):
            raise ValueError("the ids of merged tokens do not follow the merges' order")
        self.merge = tiktoken.Encoding("bpe", pat_str=r"[\s\S]+", mergeable_ranks=self.ids, special_tokens={})._core_bpe.encode_single_piece
        self.bytes_of = {i: w for w, i in self.ids.items()}
        self.states: list[tuple] = []

    @cached_property
    def trie(self) -> tuple[dict[int, int], list[int], set[int]]:
        """node * 256 + byte -> node, with root 0; the token that ends at each node, or -1; nodes that go on. For counting only."""
        after: dict[int, int] = {}
        token = [-1]
        for w, i in self.ids.items():
            node = 0
            for b in w:
                key = node << 8 | b
                child = after.get(key)
                if child is None:
                    child = after[key] = len(token)
                    token.append(-1)
                node = child
            token[node] = i
        return after, token, {k >> 8 for k in after}

    @cached_property
    def pairs(self) -> dict[tuple[int, int], bool]:
        return {}

    def _reset(self):
        self.states = []
        self.edges: list[dict[int, tuple[int, int]]] = []
        self.index: dict[tuple, int] = {}
        self.pairs.clear()
        self._state(((0, -1, 0),))

    def _state(self, parts: tuple) -> int:
        at = self.index.get(parts)
        if at is None:
            at = self.index[parts] = len(self.states)
            self.states.append(parts)
            self.edges.append({})
        return at

    def _fits(self, left: int, right: int) -> bool:
        if left < 0:
            return True
        ok = self.pairs.get((left, right))
        if ok is None:
            ok = self.pairs[left, right] = self.merge(self.bytes_of[left] + self.bytes_of[right]) == [left, right]
        return ok

    def _compile(self, state: int, byte: int) -> tuple[int, int]:
        """The transition: (state, emitted tokens)."""
        open_, last, emitted = [], None, 0
        after, token, inner = self.trie
        for node, before, count in self.states[state]:
            child = after.get(node << 8 | byte)
            if child is None:
                continue
            t = token[child]
            if last is None and t >= 0 and self._fits(before, t):
                last, emitted = t, count + 1
            if child in inner:
                open_.append((child, before, count))
        parts = tuple((n, b, c - emitted) for n, b, c in open_) + ((0, last, 0),)
        edge = self.edges[state][byte] = (self._state(parts), emitted)
        return edge

    def count(self, word: bytes) -> int:
        """Tokens of one pre-token: the sum of the transitions' annotations."""
        if not self.states or len(self.states) > STATES:
            self._reset()
        state = total = 0
        edges = self.edges
        for b in word:
            edge = edges[state].get(b) or self._compile(state, b)
            state = edge[0]
            total += edge[1]
        return total


@lru_cache(maxsize=2)
def load(path: str) -> Bpe:
    return Bpe(path)


@lru_cache(maxsize=4)
def _memo(path: str, kind: str) -> Memo:
    bpe = load(path)
    if kind == "count":
        return Memo(lambda w: 1 if w in bpe.special else bpe.count(w.encode()))
    return Memo(lambda w: array("I", [bpe.special[w]] if w in bpe.special else bpe.merge(w.encode())).tobytes())


def _slabs(texts: list[str]):
    """Index ranges of consecutive texts with about SLAB characters."""
    a = size = 0
    for b, t in enumerate(texts):
        if size and size + len(t) > SLAB:
            yield a, b
            a, size = b, 0
        size += len(t)
    if a < len(texts):
        yield a, len(texts)


def words_of(texts: list[str], special: dict[str, int]) -> tuple[list[str], np.ndarray]:
    """Pre-tokens of the texts, in order, and how many each text has.  A special string is one pre-token."""
    segments, owner, whole = [], [], []
    for i, t in enumerate(texts):
        parts = [t]
        for s in special:
            parts = [y for x in parts for y in ([x] if x in special or s not in x else [z for k, p in enumerate(x.split(s)) for z in ((s, p) if k else (p,))])]
        for p in parts:
            segments.append(p)
            owner.append(i)
            whole.append(p in special)
    big = "\0".join(segments) + "\0"
    sizes = np.fromiter(map(len, segments), np.int64, len(segments))
    ends = np.cumsum(sizes + 1) - 1
    classes = char_classes()[np.frombuffer(big.encode("utf-32-le"), "<u4")]
    classes[ends] = _END
    starts = token_starts(classes)
    stops = np.append(starts[1:], len(classes))
    inside = classes[starts] != _END
    if any(whole):
        seg = np.searchsorted(ends, starts)
        is_whole = np.array(whole)[seg]
        first = starts == (ends - sizes)[seg]
        stops = np.where(is_whole & first, ends[seg], stops)
        inside &= ~is_whole | first
    starts, stops = starts[inside], stops[inside]
    per_text = np.bincount(np.array(owner, np.int64)[np.searchsorted(ends, starts)], minlength=len(texts))
    return [big[a:b] for a, b in zip(starts.tolist(), stops.tolist())], per_text


def count_tokens(texts: list[str], path: str) -> np.ndarray:
    """Token count of each text, as the library gives it without added special tokens."""
    bpe, memo = load(path), _memo(path, "count")
    out = np.zeros(len(texts), np.int64)
    for a, b in _slabs(texts):
        words, per_text = words_of(texts[a:b], bpe.special)
        sums = np.concatenate(([0], np.cumsum(np.fromiter(map(memo.__getitem__, words), np.int64, len(words)))))
        ends = np.cumsum(per_text)
        out[a:b] = sums[ends] - sums[ends - per_text]
    return out


def encode(texts: list[str], path: str):
    """Yields (index of the first text, concatenated ids, ids per text) of runs of texts."""
    bpe, memo = load(path), _memo(path, "ids")
    for a, b in _slabs(texts):
        words, per_text = words_of(texts[a:b], bpe.special)
        parts = list(map(memo.__getitem__, words))
        sums = np.concatenate(([0], np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts))))) // 4
        ends = np.cumsum(per_text)
        yield a, np.frombuffer(b"".join(parts), "<u4"), sums[ends] - sums[ends - per_text]


def trim(path: str) -> None:
    """For when a task ends: the ids of the words that it met need not be kept."""
    memo = _memo(path, "ids")
    memo.clear()
    memo.held = 0
    memo.trim()
    release_memory()
