"""Token ids of whole texts by the tokenizers library, each word encoded once a worker.

For the lower-casing word-level BPE vocabulary (word_bpe_49k): its normalizer turns white space into
one space and its pattern never matches white space, so a text's ids are its words' ids, joined.
Arrow splits texts into words and finds the distinct ones of a few megabytes of text; ids are made
for those and dealt back to the texts as arrays. Words of Latin letters, with punctuation behind them
or not, are taken apart into the pattern's pieces, which repeat more than words do; the library's
model gets each new piece once, with its bytes spelled as the vocabulary spells them. Other words go
to the library one by one; bounded memos hold the ids of both. Texts with anything that may cross
words (special tokens' strings, the separators U+001C to U+001F) go to the library whole.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from string import punctuation

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: The pattern of the vocabulary file, as it applies to lower-cased text.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
#: Characters that composition (NFC) leaves alone and that lower-case one by one.
LATIN = regex.compile("[\x21-\x7e\xa1-\u012f\u0131-\u024f]+")  # without U+0130, which lower-cases to two
#: The words that are letters of those, then punctuation; what may cross words.
LETTERS, SIGNS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u012f\u0131-\u024f", r"!-/:-@\[-`{-~"
PLAIN, CROSSING = f"^[{LETTERS}]+[{SIGNS}]*$", "<\\||[\x1c-\x1f]"
PACKERS = [struct.Struct(f"<{n}I").pack for n in range(32)]
WORDS, PARTS, CHUNK = 600_000, 1_200_000, 1 << 23


def byte_letters() -> dict[int, int]:
    """The byte-level alphabet: printable bytes stand for themselves, others for U+0100 and up, in order."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    return {b: 256 + n for n, b in enumerate(sorted({*range(256)} - plain))}


def pieces_of(word: str) -> list[str]:
    """PIECES of a Latin word, lower-cased."""
    core = word.rstrip(punctuation)
    if core.isalpha():
        return [core.lower(), word[len(core) :]] if len(core) < len(word) else [core.lower()]
    return PIECES.findall(word.lower())


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Memo(dict):
    """Values of keys, made when first asked for."""

    def __init__(self, made: Callable[[str], bytes]) -> None:
        self.made = made

    def __missing__(self, key: str) -> bytes:
        value = self[key] = self.made(key)
        return value


class WordIds:
    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.size = self.library.get_vocab_size()
        self.letters = byte_letters()
        self.words, self.parts = Memo(self._word), Memo(self._piece)

    def _whole(self, text: str) -> bytes:
        return self.pack(self.library.encode(text, add_special_tokens=False).ids)

    def _piece(self, piece: str) -> bytes:
        spelled = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)
        return self.pack([x.id for x in self.model.tokenize(spelled)])

    @staticmethod
    def pack(ids: list[int]) -> bytes:
        return PACKERS[len(ids)](*ids) if len(ids) < len(PACKERS) else struct.pack(f"<{len(ids)}I", *ids)

    def _word(self, word: str) -> bytes:
        if not (word.isascii() and word.isprintable() or LATIN.fullmatch(word)):
            return self._whole(word)
        parts = self.parts
        return b"".join([parts[p] for p in pieces_of(word)])

    def _table(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, joined; number of ids of each)."""
        plain = pc.match_substring_regex(words, PLAIN)
        is_plain = plain.to_numpy(zero_copy_only=False)
        known = words.filter(plain)
        core = pc.utf8_rtrim(known, characters=punctuation)
        ends = pc.not_equal(pc.binary_length(core), pc.binary_length(known))
        cores = pc.utf8_lower(core).dictionary_encode()
        tails = pc.replace_substring_regex(known.filter(ends), f"^[{LETTERS}]+", "").dictionary_encode()
        values = [self.parts[x] for x in strings(cores.dictionary)]
        values += [self.parts[x] for x in strings(tails.dictionary)]
        values += [self.words[x] for x in strings(words.filter(pc.invert(plain)))]
        values.append(b"")
        # a word's two values: of letters and of punctuation, or its own, and none
        c, t = len(cores.dictionary), len(tails.dictionary)
        two = np.full((len(words), 2), len(values) - 1)
        two[is_plain, 0] = cores.indices
        two[np.flatnonzero(is_plain)[ends.to_numpy(zero_copy_only=False)], 1] = c + tails.indices.to_numpy()
        two[~is_plain, 0] = np.arange(c + t, len(values) - 1)
        sizes = np.fromiter(map(len, values), np.int64, len(values)) // 4
        ids = dealt(np.frombuffer(b"".join(values), "<u4"), sizes, two.reshape(-1))
        return ids, sizes[two].sum(axis=1)

    def _chunk(self, texts: pa.StringArray) -> list[bytes]:
        crossing = pc.fill_null(pc.match_substring_regex(texts, CROSSING), False)
        lists = pc.utf8_split_whitespace(pc.if_else(crossing, "", texts))
        words = lists.flatten().dictionary_encode()
        flat, sizes = self._table(words.dictionary)
        of = words.indices.to_numpy()
        raw = dealt(flat, sizes, of).tobytes()
        upto = np.concatenate([[0], np.cumsum(sizes[of])]) * 4
        ends = upto[np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy())].tolist()
        out = [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        for i in np.flatnonzero(crossing.to_numpy(zero_copy_only=False)).tolist():
            out[i] = self._whole(texts[i].as_py())
        if len(self.words) > WORDS:
            self.words.clear()
        if len(self.parts) > PARTS:
            self.parts.clear()
        return out

    def chunks(self, texts: pa.Array, most: int | None = None) -> Iterator[tuple[int, list[bytes]]]:
        """(place of the first, ids) of as many texts at a time as hold `most` bytes (else CHUNK), or of one that holds more."""
        upto = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(), dtype=np.int64)
        at = 0
        while at < len(texts):
            end = int(np.searchsorted(upto, (upto[at - 1] if at else 0) + (most or CHUNK), side="right"))
            found = self._chunk(texts.slice(at, max(end - at, 1)))
            yield at, found
            at += len(found)

    def ids(self, texts: list[str | None] | pa.Array) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text; null: none."""
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        return [x for _, found in self.chunks(texts) for x in found]


def strings(column: pa.StringArray) -> list[str]:
    """Its values, none of which holds a space."""
    return pc.binary_join(pa.ListArray.from_arrays([0, len(column)], column), " ")[0].as_py().split(" ") if len(column) else []


def dealt(flat: np.ndarray, sizes: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Values that lie joined in flat, in the order and as often as of names them."""
    n = sizes[of]
    ends = np.cumsum(n)
    first = (np.cumsum(sizes) - sizes)[of]
    return flat[np.repeat(first - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]


@lru_cache(maxsize=4)
def word_ids(path: str) -> WordIds:
    """One for each Python worker and vocabulary."""
    return WordIds(path)


def crc32(raw: bytes) -> int:
    return zlib.crc32(raw) & 0xFFFFFFFF
