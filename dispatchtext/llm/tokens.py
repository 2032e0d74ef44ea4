"""Tokenising whole texts with files of the tokenizers library, one distinct piece at a time.

Both files here split a text before the merges. Where it is plain (ASCII and Latin letters) that split is found
for the bytes of many texts at once, and each distinct piece is encoded once per Python worker, many of them in one
call; the tests hold the ids against plain encode(). Neither file joins a character that is not white space to a
space that follows it, so a text may be cut in front of every single space: a stretch between such cuts that holds any
other character goes to the library as it is. A text that holds a special token of the file goes to the library whole.
"""

from __future__ import annotations

import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer, pre_tokenizers

#: Distinct pieces and ids kept while a task runs, about 110 MB; the cache starts anew beyond that (results do not change).
MAX_UNITS, MAX_IDS = 500_000, 8_000_000
#: Distinct pieces in one call of the library.
BATCH = 64

#: The byte_bpe file splits by `'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+`, the
#: word_bpe file lower-cases, splits by `'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+` and drops white space.
#: Kinds of a byte; the last three: beyond plain text, the same and perhaps the end of white space, outside the text.
SPACE, WHITE, LETTER, DIGIT, MARK, BEYOND, HIDDEN, EDGE = range(8)

#: A piece of plain text; multiplication and division sign are no letters, and a dotted capital I makes two characters in lower case.
_PLAIN = re.compile(rb"(?:[\t\n\r -~]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]|\xc4[\x80-\xaf\xb1-\xbf]|[\xc5-\xc8][\x80-\xbf])*+\Z")
_NO_LETTERS = (0xC397, 0xC3B7, 0xC4B0)


def _kinds() -> np.ndarray:
    """Kind of each byte; Latin letters of two bytes are told by both."""
    kinds = np.full(256, BEYOND, np.uint8)
    kinds[:32] = HIDDEN
    kinds[[0x80, 0x81, 0x82, 0x83, 0x84, 0x85, 0x86, 0x87, 0x88, 0x89, 0x8A, 0x9F, 0xA0, 0xA8, 0xA9, 0xAF]] = HIDDEN
    kinds[33:127] = MARK
    kinds[[ord(c) for c in "\t\n\r"]], kinds[32] = WHITE, SPACE
    kinds[ord("0") : ord("9") + 1] = DIGIT
    kinds[ord("A") : ord("Z") + 1] = kinds[ord("a") : ord("z") + 1] = LETTER
    return kinds


def _byte_letters() -> dict[int, str]:
    """Byte-level alphabet: printable bytes stand for themselves, the others for letters from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


_KINDS = _kinds()
_LETTERS = np.array([ord(_c) for _, _c in sorted(_byte_letters().items())], np.uint32)


def _letters(data: bytes) -> str:
    return _LETTERS[np.frombuffer(data, np.uint8)].tobytes().decode("utf-32-le")


#: Stands between joint pieces; plain text has no byte 0.
_APART = _letters(b"\x00")


class Coder:
    """ids of texts. `fold`: the file lower-cases and drops white space (word_bpe), else byte-level (byte_bpe).

    `special`: special tokens written in a text get their own ids, as the library does by default; else they
    are encoded like other text.
    """

    def __init__(self, path: str, fold: bool, max_units: int = MAX_UNITS, special: bool = False):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        names = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = "|".join(names) if special else ""
        self.fold, self.max_units = fold, max_units
        self.model = self.tokenizer.model
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        self.last = np.zeros(max(vocab.values()) + 1, bool)  # ids that end a piece among joint pieces
        if fold:  # the model sets its suffix at the end of each word
            self.words = Tokenizer(self.model)
            self.words.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
            suffix = self.model.end_of_word_suffix
            self.joint = bool(suffix) and all(chr(c) + suffix in vocab for c in _LETTERS.tolist())
            ends = [i for t, i in vocab.items() if suffix and t.endswith(suffix)]
        else:  # no merge takes byte 0
            self.joint = [t for t in vocab if _APART in t] == [_APART]
            ends = [vocab[_APART]] if self.joint else []
        self.last[ends] = True
        self.clear()

    def clear(self) -> None:
        self.units: dict[bytes, int] = {}
        self.ids, self.starts = array("I"), array("Q", [0])

    def _encode_plain(self, keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids in a row, number of ids of each piece) of plain pieces."""
        if self.fold:
            keys = [k.strip().decode().lower().encode() for k in keys]
        if not self.joint:
            each = [[t.id for t in self.model.tokenize(_letters(k))] for k in keys]
            return np.array([i for ids in each for i in ids], np.uint32), np.array([len(ids) for ids in each], np.int64)
        sizes, flat = np.zeros(len(keys), np.int64), []
        at = np.flatnonzero([k != b"" for k in keys])  # white space has no ids in the word_bpe file
        keys = [k for k in keys if k]
        for i in range(0, len(keys), BATCH):
            joint = _letters(b"\x00".join(keys[i : i + BATCH]))
            if self.fold:
                flat += self.words.encode(joint.replace(_APART, " "), add_special_tokens=False).ids
            else:
                flat += [t.id for t in self.model.tokenize(joint + _APART)]
        ids = np.array(flat, np.uint32)
        last = self.last[ids]
        sizes[at] = np.diff(np.flatnonzero(last), prepend=-1) - (not self.fold)
        return (ids if self.fold else ids[~last]), sizes

    def _keep(self, keys: list[bytes], ids: np.ndarray, sizes: np.ndarray) -> None:
        base = len(self.starts) - 1
        self.starts.frombytes((np.cumsum(sizes) + len(self.ids)).astype(np.uint64).tobytes())
        self.ids.frombytes(ids.astype(np.uint32).tobytes())
        self.units.update(zip(keys, range(base, base + len(keys))))

    def _lookup(self, keys: list[bytes]) -> np.ndarray:
        known = self.units
        new = [k for k in keys if k not in known]
        plain = [k for k in new if _PLAIN.match(k)]
        if plain:
            self._keep(plain, *self._encode_plain(plain))
        if len(plain) < len(new):
            other = [k for k in new if k not in known]
            own = [self._encode_whole(k.decode()) for k in other]
            self._keep(other, np.concatenate(own), np.array([len(x) for x in own]))
        return np.fromiter(map(known.__getitem__, keys), np.int64, len(keys))

    def _encode_whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _cut(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Where the pieces of texts that lie in a row begin. The word_bpe file's pieces begin with the white space before them."""
        kind = _KINDS[data]
        lead = np.flatnonzero((data >= 0xC3) & (data <= 0xC8))
        lead = lead[lead + 1 < len(data)]
        pair = data[lead].astype(np.uint16) << 8 | data[lead + 1]
        lead = lead[(pair >> 6 & 3 == 2) & ~np.isin(pair, _NO_LETTERS)]
        kind[lead] = kind[lead + 1] = LETTER
        first = bounds[:-1][bounds[:-1] < bounds[1:]]
        before, after = np.full_like(kind, EDGE), np.full_like(kind, EDGE)
        before[1:], after[:-1] = kind[:-1], kind[1:]
        before[first] = after[first[1:] - 1] = EDGE

        start = (before > WHITE) & (before != kind)
        if self.fold:
            start |= (kind == DIGIT) & (before == DIGIT)
        else:  # the last character of white space goes to what follows if it is a space, else it is a piece
            start |= (before == WHITE) & (kind > WHITE)
            start |= (before <= WHITE) & (kind <= WHITE) & (after > WHITE) & (after != EDGE)

        at = np.flatnonzero(data == ord("'"))  # 's and its like, where no sign and no space of the piece stands before
        at = at[(after[at] == LETTER) & (before[at] != MARK) & ((before[at] != SPACE) | self.fold)]
        one = data[at + 1] | (32 if self.fold else 0)
        two = np.where(after[at + 1] == LETTER, data[np.minimum(at + 2, len(data) - 1)], 0) | (32 if self.fold else 0)
        size = np.isin(one, list(b"stmd")) + 2 * np.isin(one.astype(np.uint16) << 8 | two, [int.from_bytes(x) for x in (b"re", b"ve", b"ll")])
        at, size = at[size > 0], size[size > 0]
        start[at + 1] = False
        start[(at + size + 1)[after[at + size] == LETTER]] = True

        beyond = np.flatnonzero(kind >= BEYOND)
        if len(beyond):
            whole = (kind == SPACE) & (before > WHITE) & (before != HIDDEN)
            whole[first] = True
            cuts = np.flatnonzero(whole)
            k = np.unique(np.searchsorted(cuts, beyond, "right") - 1)
            low, size = cuts[k], np.diff(cuts, append=len(data))[k]
            start[np.repeat(low - (np.cumsum(size) - size), size) + np.arange(size.sum())] = False
            start[low] = True
        return np.flatnonzero(start)

    def encode_array(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(all ids in a row, number of ids of each text). Nulls count as empty."""
        if len(self.units) > self.max_units or len(self.ids) > MAX_IDS:
            self.clear()
        texts = texts.fill_null("").cast(pa.large_string())
        whole = np.zeros(len(texts), bool)
        if self.special:
            whole = pc.match_substring_regex(texts, self.special).to_numpy(zero_copy_only=False)
        own = [self._encode_whole(t) for t in texts.filter(pa.array(whole)).to_pylist()]
        if own:
            texts = pc.if_else(pa.array(whole), pa.scalar("", texts.type), texts)
        bounds = np.concatenate(([0], np.cumsum(pc.binary_length(texts).to_numpy()))).astype(np.int64)
        if bounds[-1]:
            offset = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset]
            data = np.frombuffer(texts.buffers()[2], np.uint8)[offset : offset + bounds[-1]]
            begin = self._cut(data, bounds)
            pieces = pa.Array.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(np.append(begin, len(data))), pa.py_buffer(data)]).dictionary_encode()
            unit, index = self._lookup(pieces.dictionary.to_pylist()), pieces.indices.to_numpy()
            out, size = self._gather(unit, index)
            bounds = np.concatenate(([0], np.cumsum(size)))[np.searchsorted(begin, bounds)]
        else:
            out = np.empty(0, np.uint32)
        n = np.diff(bounds)
        if own:
            n[whole] = [len(x) for x in own]
            out = np.insert(out, np.repeat(bounds[:-1][whole], n[whole]), np.concatenate(own))
        return out, n

    def _gather(self, unit: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of unit[index] in a row, number of ids of each)."""
        ids, starts = np.frombuffer(self.ids, np.uint32), np.frombuffer(self.starts, np.uint64).astype(np.int64)
        begin, size = starts[unit][index], (starts[unit + 1] - starts[unit])[index]
        ends = np.cumsum(size)
        return ids[np.repeat(begin - (ends - size), size) + np.arange(ends[-1])], size

    def encode_many(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        return self.encode_array(pa.array(texts, pa.string()))


_coders: dict[tuple, Coder] = {}


def coder(path: str, fold: bool) -> Coder:
    """One coder per worker process; its ids are those of the library's defaults."""
    if (path, fold) not in _coders:
        _coders[path, fold] = Coder(path, fold, special=True)
    return _coders[path, fold]
