"""Token ids of whole texts by the tokenizers library, with a memo of chunks.

The vocabulary's pattern starts a new piece at every space that is followed by anything but white space, and a
byte-level BPE encodes each piece by itself.  So texts may be cut before each space, the distinct chunks looked up in a
memo, and the library asked only for those not met before: many in one call, its answer cut again where an id
starts with a space.  A chunk of a word and a sign, or with a line end inside, is put together from its parts.  A text in
which a space follows white space and stands before white space or the end goes to the library whole, as does one that
holds an added token of the vocabulary, such as an end marker, which the library turns into that token's id.  Ids are the
library's own either way.

The memo holds arrays, not Python objects: sorted 64-bit hashes, a second 64-bit hash against collisions, and where
a chunk's ids lie.  It starts anew when it is full.
"""

from __future__ import annotations

import os
import re
import string

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from keyloom.llm.kernels import _BASE, _BYTE, _stream, mix64

VOCABULARY = "byte_bpe_50k.json"
MEMO_CHUNKS = 2_000_000
#: Characters of the texts that are encoded at once.
LOT = 1 << 21
#: Up to here (Latin letters and signs) the pattern engines' tables of letters surely agree.
_BEYOND = "ɐ"
_JOINED = re.compile(r"\s (?:\s|$)")
_BYTE_2 = _stream(256, 41)

_encoders: dict[str, "Encoder"] = {}


def _hashes(chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each string."""
    offsets = np.frombuffer(chunks.buffers()[1], np.int64)[chunks.offset : chunks.offset + len(chunks) + 1]
    data = np.frombuffer(chunks.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    length = np.diff(offsets)
    one, two = np.zeros(len(chunks), dtype=np.uint64), np.zeros(len(chunks), dtype=np.uint64)
    some = np.flatnonzero(length)
    if len(some):
        first = (offsets[:-1] - offsets[0])[some]
        place = np.arange(len(data)) - np.repeat(first, length[some])
        with np.errstate(over="ignore"):
            power = np.cumprod(np.full(int(length.max()), _BASE))[place]
            salt = length[some].astype(np.uint64)
            one[some] = mix64(np.add.reduceat(_BYTE[data] * power, first) + salt)
            two[some] = mix64(np.add.reduceat(_BYTE_2[data] * power, first) + salt)
    return one, two


class Ragged:
    """Lists of ids end to end."""

    def __init__(self, flat: np.ndarray, length: np.ndarray):
        self.flat, self.length = flat, length
        self.begin = np.cumsum(length) - length

    @staticmethod
    def of(lists: list[np.ndarray]) -> "Ragged":
        return Ragged(np.concatenate([np.zeros(0, np.uint32), *lists]), np.array([len(x) for x in lists], dtype=np.int64))

    def take(self, which: np.ndarray) -> "Ragged":
        length = self.length[which]
        end = np.cumsum(length)
        at = np.repeat(self.begin[which] - end + length, length) + np.arange(int(end[-1]) if len(end) else 0)
        return Ragged(self.flat[at], length)

    @staticmethod
    def taken(parts: list["Ragged"], which: np.ndarray) -> "Ragged":
        """Rows `which` of the parts end to end, without putting the parts together."""
        ends = np.cumsum([len(p.length) for p in parts])
        of = np.searchsorted(ends, which, "right")
        rows = [np.flatnonzero(of == k) for k in range(len(parts))]
        some = [p.take(which[at] - (end - len(p.length))) for p, at, end in zip(parts, rows, ends.tolist(), strict=True)]
        length = np.zeros(len(which), dtype=np.int64)
        for at, own in zip(rows, some, strict=True):
            length[at] = own.length
        out = Ragged(np.zeros(int(length.sum()), dtype=np.uint32), length)
        for at, own in zip(rows, some, strict=True):
            out.flat[np.repeat(out.begin[at] - own.begin, own.length) + np.arange(len(own.flat))] = own.flat
        return out

    def __add__(self, other: "Ragged") -> "Ragged":
        return Ragged(np.concatenate([self.flat, other.flat]), np.concatenate([self.length, other.length]))


class Memo:
    """Chunks and their ids."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.key, self.check = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint64)
        self.slot = np.zeros(0, dtype=np.int32)
        self.ids = Ragged(np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64))

    def __len__(self) -> int:
        return len(self.key)

    def find(self, key: np.ndarray, check: np.ndarray) -> np.ndarray:
        """Rows of `ids`, -1 for what is not there."""
        if not len(self):
            return np.full(len(key), -1, dtype=np.int64)
        at = np.minimum(np.searchsorted(self.key, key), len(self) - 1)
        return np.where((self.key[at] == key) & (self.check[at] == check), self.slot[at], -1)

    def add(self, key: np.ndarray, check: np.ndarray, ids: Ragged) -> None:
        """What find() has not found; of two chunks with one key the first stays, the other is looked up anew each time."""
        if not len(key):
            return
        order = np.argsort(key, kind="stable")
        order = order[np.concatenate([[True], key[order][1:] != key[order][:-1]])]
        at = np.searchsorted(self.key, key[order])
        free = np.ones(len(order), dtype=bool)
        inside = at < len(self)
        free[inside] = self.key[at[inside]] != key[order][inside]
        order, at = order[free], at[free]
        n = len(self.ids.length)
        self.ids = self.ids + ids.take(order)
        self.key, self.check = np.insert(self.key, at, key[order]), np.insert(self.check, at, check[order])
        self.slot = np.insert(self.slot, at, np.arange(n, n + len(order), dtype=np.int32))


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        #: Tokens that the library finds in a text before anything else: such a text is not cut.
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.vocab_size = self.library.get_vocab_size()
        begins = {sign: np.zeros(self.vocab_size, dtype=bool) for sign in "ĠĊ"}
        for token, i in self.library.get_vocab().items():
            if token[0] in begins:
                begins[token[0]][i] = True
        self.space, self.newline = begins["Ġ"], begins["Ċ"]
        self.sign = {c: i for i, c in enumerate(string.punctuation)}
        self.sign_ids = self.whole(list(string.punctuation))
        #: Chunks without their leading space; what stands after a line end, without it.
        self.memo, self.lines = Memo(), Memo()

    def whole(self, texts: list[str]) -> Ragged:
        return Ragged.of([np.array(e.ids, dtype=np.uint32) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)])

    def _joined(self, chunks: list[str], before: str, begins: np.ndarray) -> Ragged:
        """The ids of `before` and each chunk, encoded in one text; `begins` marks the ids that each begins with and nothing else in it has."""
        if not chunks:
            return Ragged.of([])
        ids = np.array(self.library.encode_batch_fast(["".join([before + c for c in chunks])], add_special_tokens=False)[0].ids, dtype=np.uint32)
        cuts = np.flatnonzero(begins[ids])
        if len(cuts) != len(chunks):
            return self.whole([before + c for c in chunks])
        return Ragged(ids, np.diff(np.append(cuts, len(ids))))

    def _known(self, memo: Memo, chunks: list[str], before: str, begins: np.ndarray) -> Ragged:
        """The ids of each of the distinct chunks, learned if need be."""
        key, check = _hashes(pa.array(chunks, pa.large_string()))
        slot = memo.find(key, check)
        new = np.flatnonzero(slot < 0)
        ids = self._joined([chunks[i] for i in new.tolist()], before, begins)
        row = slot.copy()
        row[new] = len(memo.ids.length) + np.arange(len(new))
        out = Ragged.taken([memo.ids, ids], row)
        memo.add(key[new], check[new], ids)
        return out

    def _learn(self, new: list[str]) -> Ragged:
        """The ids of chunks (a space before each) that the memo does not hold."""
        core, tail, alone = {}, {}, []
        parts = np.full((len(new), 3), -1, dtype=np.int64)  # word, sign, line; or a chunk that is encoded alone
        single = np.full(len(new), -1, dtype=np.int64)
        for i, c in enumerate(new):
            if c.isalpha():
                parts[i, 0] = core.setdefault(c, len(core))
                continue
            head, newline, rest = c.partition("\n")
            if not c or max(c) >= _BEYOND or (newline and not (head and rest and rest.isprintable())) or not head.isprintable():
                single[i] = len(alone)  # white space at an end could join a neighbour's piece; beyond Latin the library decides
                alone.append(" " + c)
                continue
            if head[-1] in self.sign and head[:-1].isalpha():  # a sign after a word is a piece of its own
                parts[i, 1] = self.sign[head[-1]]
                head = head[:-1]
            parts[i, 0] = core.setdefault(head, len(core))
            if newline:
                parts[i, 2] = tail.setdefault(rest, len(tail))
        if len(self.lines) + len(tail) > MEMO_CHUNKS // 8:
            self.lines.clear()
        pools = [self._known(self.memo, list(core), " ", self.space), self.sign_ids, self._known(self.lines, list(tail), "\n", self.newline), self.whole(alone)]
        pool = pools[0] + pools[1] + pools[2] + pools[3] + Ragged(np.zeros(0, np.uint32), np.zeros(1, np.int64))
        base = np.cumsum([0, *[len(p.length) for p in pools]])
        empty = int(base[4])
        which = np.where(parts >= 0, parts + base[:3], empty)
        which[:, 0] = np.where(single >= 0, single + base[3], which[:, 0])
        made = pool.take(which.ravel())
        return Ragged(made.flat, made.length.reshape(-1, 3).sum(axis=1))

    def many(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        if not texts:
            return []
        uncut = [_JOINED.search(t) is not None or any(a in t for a in self.added) for t in texts]
        cut = pc.split_pattern(pa.array(["" if u else t for u, t in zip(uncut, texts, strict=True)], pa.large_string()), " ")
        offsets = cut.offsets.to_numpy()
        coded = cut.values.dictionary_encode()
        words = coded.dictionary
        if len(self.memo) + 2 * len(words) > MEMO_CHUNKS:
            self.memo.clear()
        key, check = _hashes(words)
        slot = self.memo.find(key, check)
        new = np.flatnonzero(slot < 0)
        ids = self._learn(words.take(pa.array(new)).to_pylist())
        slot[new] = len(self.memo.ids.length) + np.arange(len(new))  # _learn() may have added parts, but at the end
        # a text's first chunk has no space before it; a text that is not cut is its own first chunk
        first = coded.indices.to_numpy()[offsets[:-1]]
        heads = words.take(pa.array(first)).to_pylist()
        pools = [self.memo.ids, ids, self.whole([t if u else h for t, u, h in zip(texts, uncut, heads, strict=True)])]
        part = slot[coded.indices.to_numpy()]
        part[offsets[:-1]] = len(self.memo.ids.length) + len(ids.length) + np.arange(len(texts))
        out = Ragged.taken(pools, part)
        again = self.memo.find(key[new], check[new]) < 0  # a word may have become known as another's part
        self.memo.add(key[new][again], check[new][again], ids.take(np.flatnonzero(again)))
        return np.split(out.flat, np.cumsum(out.length)[offsets[1:-1] - 1])


def in_lots(texts: list[str], limit: int = LOT):
    """Index ranges of about `limit` characters of texts; a longer text is alone."""
    lo, size = 0, 0
    for i, t in enumerate(texts):
        if i > lo and size + len(t) > limit:
            yield lo, i
            lo, size = i, 0
        size += len(t)
    if lo < len(texts):
        yield lo, len(texts)


def default_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path(VOCABULARY))


def encoder(path: str) -> Encoder:
    """One encoder for each path and Python worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
