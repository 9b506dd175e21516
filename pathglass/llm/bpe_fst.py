"""Byte-level BPE as a lazily determinised finite-state transducer.

For a BPE vocabulary whose tokens encode to themselves, a token sequence is the
encoding of a string exactly if every adjacent pair of it is: encoding the bytes
of the pair gives the pair back. So every prefix of a string has exactly one
encoding, and a longer string can only continue one of the encodings of those
prefixes after which the bytes read so far begin some token. These continuations
are the hypotheses of a nondeterministic transducer; a state of the determinised
one is the set of live hypotheses, and what all of them agree on is emitted. The
longest token bounds how far emission lags behind reading.

States and transitions are made when first met and kept in bounded tables.
"""

from __future__ import annotations

import base64
import json
import re
import struct
from functools import lru_cache

import regex

#: Fixed value: the split pattern of the public rank files.
SPLIT_PATTERN = (
    r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
)

#: Unicode White_Space, spelled out: Python's own \s holds four more characters.
_WS = " \t\n\r\x0b\x0c\x85\xa0  -     　"

#: Places where white space follows another character. No match of SPLIT_PATTERN and
#: no special string without white space spans such a place.
BREAK = re.compile(f"(?<=[^{_WS}])(?=[{_WS}])")

#: Characters of a text split at a time, and tokens packed at a time.
SEGMENT, TOKENS = 1 << 16, 1 << 16


class Vocabulary:
    """Token bytes by id, and the merge that each pair of ids allows."""

    def __init__(self, tokens: dict[int, bytes], merges, whole_first: bool, specials: dict[str, int]):
        self.tokens = tokens
        self.ids = {b: i for i, b in tokens.items()}
        self.merges = merges  # (left id, right id) -> (rank, merged id)
        self.whole_first = whole_first  # a piece that is a token stays whole
        self.specials = specials
        # The tokens as a trie: (node * 256 + byte) -> node; 0 is the root.
        self.trie, self.token_at, self.inner = {}, [-1], [True]
        for b, i in self.ids.items():
            node = 0
            for byte in b:
                self.inner[node] = True
                key = node << 8 | byte
                node = self.trie.get(key)
                if node is None:
                    node = self.trie[key] = len(self.token_at)
                    self.token_at.append(-1)
                    self.inner.append(False)
            self.token_at[node] = i

    def merge_steps(self, piece: bytes) -> list[tuple[int, ...]]:
        """BPE by its definition, with every stage; for tokens, short pieces and tests."""
        ids = [self.ids[piece[k : k + 1]] for k in range(len(piece))]
        steps = [tuple(ids)]
        while True:
            best, at = None, -1
            for k in range(len(ids) - 1):
                m = self.merges.get((ids[k], ids[k + 1]))
                if m is not None and (best is None or m[0] < best[0]):
                    best, at = m, k
            if best is None:
                return steps
            ids[at : at + 2] = [best[1]]
            steps.append(tuple(ids))


def _from_ranks(path: str) -> Vocabulary:
    tokens = {}
    with open(path, "rb") as lines:
        for line in lines:
            if line.strip():
                a, b = line.split()
                tokens[int(b)] = base64.b64decode(a)
    ids = {b: i for i, b in tokens.items()}
    merges = {}
    for i, b in tokens.items():
        for k in range(1, len(b)):
            left, right = ids.get(b[:k]), ids.get(b[k:])
            if left is not None and right is not None:
                merges[left, right] = (i, i)
    return Vocabulary(tokens, merges, True, {})


def byte_letters() -> dict[str, int]:
    """The printable stand-ins for bytes that byte-level vocabulary files use."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def _from_json(path: str) -> Vocabulary:
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    plain = (
        model.get("type") == "BPE"
        and spec.get("normalizer") is None
        and pre.get("type") == "ByteLevel"
        and pre.get("use_regex")
        and not pre.get("add_prefix_space")
        and not (model.get("ignore_merges") or model.get("dropout") or model.get("continuing_subword_prefix"))
        and not any(a["lstrip"] or a["rstrip"] or a["single_word"] for a in spec["added_tokens"])
    )
    if not plain:
        raise ValueError(f"not a plain byte-level BPE file: {path}")
    letters = byte_letters()
    specials = {a["content"]: a["id"] for a in spec["added_tokens"]}
    raw = lambda s: bytes(letters[c] for c in s)
    vocab = {raw(s): i for s, i in model["vocab"].items() if s not in specials}
    merges = {}
    for rank, pair in enumerate(model["merges"]):
        a, b = map(raw, pair if isinstance(pair, list) else pair.split(" "))
        merges[vocab[a], vocab[b]] = (rank, vocab[a + b])
    return Vocabulary({i: b for b, i in vocab.items()}, merges, False, specials)


@lru_cache(maxsize=4)
def load_vocabulary(path: str) -> Vocabulary:
    """A ``.tiktoken`` rank file or a byte-level ``tokenizer.json``."""
    return _from_json(path) if path.endswith(".json") else _from_ranks(path)


class _State:
    """hypotheses: (tokens not yet emitted, last token, trie node of the token being read)."""

    __slots__ = ("hypotheses", "next", "tail")

    def __init__(self, hypotheses):
        self.hypotheses = hypotheses
        self.next = {}
        self.tail = next(out for out, _, node in hypotheses if not node)


class Transducer:
    """Encodes pieces; every transition carries the tokens it emits and their number."""

    def __init__(self, vocabulary: Vocabulary, max_states: int = 120_000, max_pairs: int = 250_000):
        self.v = vocabulary
        self.max_states, self.max_pairs = max_states, max_pairs
        self.states: dict = {}
        self.pairs: dict = {}
        self.halves: dict = {}
        self.rank = {made: rank for rank, made in vocabulary.merges.values()}
        self.reset()

    def reset(self) -> None:
        for state in self.states.values():  # the states refer to each other
            state.next.clear()
        self.states = {}
        self.start = self._state((((), None, 0),))

    def _state(self, hypotheses) -> _State:
        s = self.states.get(hypotheses)
        if s is None:
            s = self.states[hypotheses] = _State(hypotheses)
        return s

    def _halves(self, token: int):
        """The two tokens whose merge makes ``token`` last; () for a single byte, None if its bytes encode otherwise."""
        got = self.halves.get(token)
        if got is None and token not in self.halves:
            piece = self.v.tokens[token]
            steps = self.v.merge_steps(piece)
            got = self.halves[token] = () if len(piece) == 1 else steps[-2] if steps[-1] == (token,) else None
        return got

    def _fits(self, left, right: int) -> bool:
        """Whether ``right`` may follow ``left`` in an encoding.

        Goes back in time from the finished pair, undoing the later of the two
        tokens' last merges each time. The pair is no encoding if the tokens then
        touching across the boundary would have merged before the undone merge:
        by a lower rank, or by the same rank and further left.
        """
        got = self.pairs.get((left, right))
        if got is not None:
            return got
        if len(self.pairs) >= self.max_pairs:
            self.pairs.clear()
        got = self._halves(right) is not None
        if got and left is not None:
            a, b, limit, rank, merges = left, right, None, self.rank, self.v.merges
            while True:
                m = merges.get((a, b))
                if m is not None and (limit is None or m[0] < limit):
                    got = False
                    break
                ra, rb = rank.get(a, -1), rank.get(b, -1)
                if ra < 0 and rb < 0:
                    break
                if ra > rb:
                    a, limit = self._halves(a)[1], ra
                else:
                    b, limit = self._halves(b)[0], rb + 1
        self.pairs[left, right] = got
        return got

    def _expand(self, state: _State, byte: int):
        if len(self.states) >= self.max_states:
            self.reset()  # the state at hand lives on, without its transitions
        trie, token_at, inner, pairs = self.v.trie, self.v.token_at, self.v.inner, self.pairs
        found, ended = [], False
        for out, last, node in state.hypotheses:
            node = trie.get(node << 8 | byte)
            if node is None:
                continue
            t = token_at[node]
            if t >= 0 and not ended:  # one encoding ends here, no more
                fits = pairs.get((last, t))
                if self._fits(last, t) if fits is None else fits:
                    found.append(((*out, t), t, 0))
                    ended = True
            if inner[node]:
                found.append((out, last, node))
        agreed = found[0][0]
        for out, _, _ in found[1:]:
            if not agreed:
                break
            k = 0
            while k < len(agreed) and k < len(out) and agreed[k] == out[k]:
                k += 1
            agreed = agreed[:k]
        k = len(agreed)
        if k:
            found = [(out[k:], last, node) for out, last, node in found]
        found = tuple(found)
        to = self.states.get(found)
        if to is None:
            to = self.states[found] = _State(found)
        step = state.next[byte] = (to, agreed, k)
        return step

    def encode(self, piece: bytes) -> list[int]:
        return [t for part in self._emitted(piece) for t in part]

    def pack(self, piece: bytes) -> bytes:
        """The ids as little-endian 32-bit integers; long pieces are packed part by part."""
        return b"".join(struct.pack(f"<{len(part)}I", *part) for part in self._emitted(piece))

    def _emitted(self, piece: bytes):
        if self.v.whole_first and (t := self.v.ids.get(piece)) is not None:
            yield [t]
            return
        state, out = self.start, []
        for byte in piece:
            step = state.next.get(byte) or self._expand(state, byte)
            if step[2]:
                out += step[1]
                if len(out) >= TOKENS:
                    yield out
                    out = []
            state = step[0]
        out += state.tail
        yield out

    def count(self, piece: bytes) -> int:
        if self.v.whole_first and piece in self.v.ids:
            return 1
        state, n = self.start, 0
        for byte in piece:
            step = state.next.get(byte) or self._expand(state, byte)
            n += step[2]
            state = step[0]
        return n + len(state.tail)


class PieceTable(dict):
    """Remembers results for pieces of text: the latest ``limit``, and those met among the ``limit`` before."""

    def __init__(self, make, limit: int = 120_000, longest: int = 64):
        super().__init__()
        self.make, self.limit, self.longest, self.older = make, limit, longest, {}

    def __missing__(self, piece: str):
        got = self.older.get(piece)
        if got is None:
            got = self.make(piece)
        if len(piece) <= self.longest:
            if len(self) >= self.limit:
                self.older = dict(self)
                self.clear()
            self[piece] = got
        return got


#: SPLIT_PATTERN, spelled out here for texts without a character above U+017F, for the faster standard library.
_SPLIT_LATIN = re.compile(
    r"""'s|'t|'re|'ve|'m|'ll|'d"""
    r"""| ?[A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u017f]+"""
    r"""| ?[0-9\xb2\xb3\xb9\xbc-\xbe]+"""
    r"""| ?[^\t-\r \x85\xa0A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u017f0-9\xb2\xb3\xb9\xbc-\xbe]+"""
    r"""|[\t-\r \x85\xa0]+(?![^\t-\r \x85\xa0])|[\t-\r \x85\xa0]+"""
)
_BEYOND_LATIN = re.compile("[^\x00-\u017f]")
_SPLIT = regex.compile(SPLIT_PATTERN)


def _splitter(text: str):
    return _SPLIT if _BEYOND_LATIN.search(text) else _SPLIT_LATIN


def split_pieces(text: str):
    """The matches of SPLIT_PATTERN, which cover the whole text; one by one if it is long."""
    if len(text) <= 4 * SEGMENT:
        return _splitter(text).findall(text)
    return (m.group() for m in _splitter(text).finditer(text))


class _Alphabet(dict):
    """Whether the tokenizers library and ``regex`` class a character alike; their Unicode tables differ."""

    def __missing__(self, c: str) -> bool:
        from tokenizers.pre_tokenizers import ByteLevel

        pre, probe = ByteLevel(add_prefix_space=False), f"a{c}a 1{c}1 .{c}. {c}"
        got = self[c] = [probe[a:b] for _, (a, b) in pre.pre_tokenize_str(probe)] == _SPLIT.findall(probe)
        return got


_alike = _Alphabet()


def split_as_library(text: str):
    """The pieces of the tokenizers library's byte-level splitter."""
    if not _BEYOND_LATIN.search(text) or all(map(_alike.__getitem__, set(_BEYOND_LATIN.findall(text)))):
        return split_pieces(text)
    from tokenizers.pre_tokenizers import ByteLevel

    return [text[a:b] for _, (a, b) in ByteLevel(add_prefix_space=False).pre_tokenize_str(text)]


def segments(text: str):
    """The text in parts of about SEGMENT characters, cut at breaks; one without breaks stays whole."""
    at = 0
    while len(text) - at > 2 * SEGMENT and (m := BREAK.search(text, at + SEGMENT)):
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


class TextEncoder:
    """Whole texts to little-endian 32-bit ids, by the vocabulary's merges.

    Memory beyond the text and its ids is bounded, however long a text or a piece of it is.
    """

    def __init__(self, vocabulary: Vocabulary, scale: float = 1):
        self.fst = Transducer(vocabulary, int(120_000 * scale), int(250_000 * scale))
        self.specials = vocabulary.specials
        self.cut = re.compile("|".join(map(re.escape, sorted(self.specials, key=len, reverse=True)))) if self.specials else None
        self.ids = PieceTable(lambda p: self.fst.pack(p.encode()), int(120_000 * scale))
        self.counts = PieceTable(lambda p: self.fst.count(p.encode()), int(120_000 * scale))
        self.split = split_pieces if vocabulary.whole_first else split_as_library

    def _parts(self, text: str):
        """Text between special strings, and the special ids between those."""
        if self.cut is None or not self.cut.search(text):
            return [text], []
        return self.cut.split(text), [self.specials[s] for s in self.cut.findall(text)]

    def encode(self, text: str) -> bytes:
        if len(text) <= SEGMENT and (self.cut is None or not self.cut.search(text)):
            return b"".join(map(self.ids.__getitem__, self.split(text)))
        plain, special = self._parts(text)
        out = bytearray()
        for k, part in enumerate(plain):
            for x in segments(part):
                for piece in self.split(x):
                    out += self.ids[piece]
            if k < len(special):
                out += special[k].to_bytes(4, "little")
        return bytes(out)

    def count(self, text: str) -> int:
        plain, special = self._parts(text)
        return len(special) + sum(sum(map(self.counts.__getitem__, self.split(x))) for part in plain for x in segments(part))


@lru_cache(maxsize=4)
def encoder(path: str, scale: float = 1) -> TextEncoder:
    """One encoder for each vocabulary file and Python worker.

    ``scale`` multiplies the bounds of its tables, about 200 MB at 1: larger ones make
    fewer states anew, smaller ones leave more memory to Spark.
    """
    return TextEncoder(load_vocabulary(path), scale)


def forget() -> None:
    """Let go of this worker's encoders and their vocabularies."""
    encoder.cache_clear()
    load_vocabulary.cache_clear()


class Utf8Decoder:
    """Turns a stream of token ids into text, however tokens cut characters.

    The state between two chunks of ids is the unfinished character's bytes (three at
    most). Malformed bytes yield U+FFFD as ``bytes.decode(errors="replace")`` does.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.token = [vocabulary.tokens.get(i, b"") for i in range(max(vocabulary.tokens, default=0) + 1)].__getitem__
        self.pending = b""

    @staticmethod
    def split_complete(data: bytes) -> tuple[str, bytes]:
        """The text of all finished characters, and the bytes of an unfinished last one."""
        for back in range(1, min(3, len(data)) + 1):
            b = data[-back]
            if b & 0xC0 == 0x80:
                continue
            need = 2 if 0xC2 <= b <= 0xDF else 3 if 0xE0 <= b <= 0xEF else 4 if 0xF0 <= b <= 0xF4 else 0
            if need > back and Utf8Decoder._may_continue(data[-back:]):
                return data[:-back].decode("utf-8", "replace"), data[-back:]
            break
        return data.decode("utf-8", "replace"), b""

    @staticmethod
    def _may_continue(part: bytes) -> bool:
        """False if the second byte already rules the character out (overlong, surrogate, too large)."""
        if len(part) < 2:
            return True
        low, high = {0xE0: (0xA0, 0xBF), 0xED: (0x80, 0x9F), 0xF0: (0x90, 0xBF), 0xF4: (0x80, 0x8F)}.get(part[0], (0x80, 0xBF))
        return low <= part[1] <= high

    def feed(self, ids) -> str:
        text, self.pending = self.split_complete(self.pending + b"".join(map(self.token, ids)))
        return text

    def finish(self) -> str:
        rest, self.pending = self.pending.decode("utf-8", "replace"), b""
        return rest
