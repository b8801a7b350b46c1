"""Token ids of whole texts by a public word-level BPE file, with a bounded cache of words."""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from threatloom.operators.embed import text_slices

EOT_ID = 1
CACHE_WORDS = 1 << 16
#: Text of which each distinct word is looked up once.
_SLICE_BYTES = 2 << 20
_WORD_END, _BETWEEN = "\x00", "\x01"
_LAST_LATIN = "\u024f"
#: Characters with a meaning here, and ASCII separators that `str.split` takes for white space and the tokenizer does not.
_ODD = _WORD_END + _BETWEEN + "\x1c\x1d\x1e\x1f"
_PIECE = regex.compile(r"\x01|'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}\x01]+")


def default_tokenizer() -> str:
    """Path of the tokenizer file on the machine that asks; the file is part of the environment."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordBpe:
    """The ids `tokenizers` gives for a lower-casing word BPE, looked up by white-space separated word.

    Words the bounded cache lacks are merged by `tiktoken`, with the end of a word as a byte of its own. Words with letters
    beyond the Latin blocks, and texts with strings of special tokens or odd characters, are given to `tokenizers` as they are.
    """

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        import tiktoken
        from tokenizers import Tokenizer

        self._whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab = spec["model"]["vocab"]
        self._special = [t["content"] for t in spec["added_tokens"]]
        self._odd = "|".join([*map(re.escape, self._special), *(rf"\x{ord(c):02x}" for c in _ODD)])
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        shifted = iter(range(256, 512))
        chars = [chr(b) if b in printable else chr(next(shifted)) for b in range(256)]
        byte_of = {c: b for b, c in enumerate(chars)}
        end = _WORD_END.encode()
        # rank of each token's bytes: single bytes, bytes that end a word, then the merges in their order
        ranks = {bytes([b]): b for b in range(256)} | {bytes([b]) + end: 256 + b for b in range(256)}
        ids = [vocab[c] for c in chars] + [vocab[c + "</w>"] for c in chars]
        for merge in spec["model"]["merges"]:
            token = "".join(merge.split(" ") if isinstance(merge, str) else merge)
            ends = token.endswith("</w>")
            ranks[bytes(byte_of[c] for c in token[: -4 if ends else None]) + end * ends] = len(ids)
            ids.append(vocab[token])
        self._id_of_rank = ids
        self._ids_of_ranks, self._rank_between = np.array(ids, np.uint16), ranks[_BETWEEN.encode() + end]
        pieces = r"[^\x00]+\x00"
        self._merge = tiktoken.Encoding("words", pat_str=pieces, mergeable_ranks=ranks, special_tokens={})._core_bpe
        self._bound = cache_words
        self._words: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}

    def _word(self, word: str) -> bytes:
        """Ids of a word the young cache lacks. A full cache becomes the old one, so that words in use stay known."""
        ids = self._old.get(word)
        if ids is None:
            if not word.isascii() and max(word) > _LAST_LATIN:
                ids = array("H", self._whole.encode(word, add_special_tokens=False).ids).tobytes()
            else:
                lowered = word.lower()  # composed letters only, so that there is nothing to normalise
                ranks: list[int] = []
                for piece in [lowered] if lowered.isascii() and lowered.isalpha() else _PIECE.findall(lowered):
                    ranks += self._merge.encode_single_piece((piece + _WORD_END).encode())
                ids = array("H", map(self._id_of_rank.__getitem__, ranks)).tobytes()
        if len(self._words) >= self._bound:
            self._old, self._words = self._words, {}
        self._words[word] = ids
        return ids

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of one text as uint16; a null text is empty."""
        if not text:
            return np.empty(0, np.uint16)
        if any(s in text for s in self._special) or any(c in text for c in _ODD):
            return np.array(self._whole.encode(text, add_special_tokens=False).ids, np.uint16)
        known, add = self._words.get, self._word
        return np.frombuffer(b"".join([known(w) or add(w) for w in text.split()]), np.uint16)

    def document(self, text: str | None) -> np.ndarray:
        """Ids of one text and the closing id."""
        return np.append(self.encode(text), np.uint16(EOT_ID))

    def documents(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """What `document` gives for each text in turn. Arrow splits a slice of texts, and each distinct word is merged once."""
        for part in text_slices(texts, _SLICE_BYTES):
            part = pc.fill_null(part, "")
            odd = pc.match_substring_regex(part, self._odd)
            split = pc.ascii_split_whitespace(pc.if_else(odd, "", part))
            words = split.flatten().dictionary_encode()
            ids, begin, length = self._distinct(words.dictionary)
            place = words.indices.to_numpy()
            length, end = length[place], np.concatenate(([0], np.cumsum(length[place])))
            ids = ids[np.repeat(begin[place] - end[:-1], length) + np.arange(end[-1])]
            edges = end[np.concatenate(([0], np.cumsum(pc.list_value_length(split).to_numpy())))].tolist()
            for at, whole in enumerate(odd.to_pylist()):
                if whole:
                    yield self.document(part[at].as_py())
                else:
                    yield np.append(ids[edges[at] : edges[at + 1]], np.uint16(EOT_ID))

    def _distinct(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of words without odd characters; where those of each word begin, and how many they are."""
        wide = pc.match_substring_regex(words, r"[\x{250}-\x{10ffff}]")
        # words of letters are pieces as they are; the others are cut, with those of the one letter that lower case splits
        letters = pc.and_not(pc.match_substring_regex(words, r"^\pL+$"), pc.or_(wide, pc.match_substring(words, "\u0130")))
        mixed = pc.invert(pc.or_(letters, wide))
        pieces = _PIECE.findall(_joined(words.filter(mixed), _BETWEEN).lower())
        marked = _joined(words.filter(letters), _WORD_END + _BETWEEN + _WORD_END).lower() + _WORD_END.join([*pieces, ""])
        ranks = np.frombuffer(self._merge.encode_to_tiktoken_buffer(marked, set()), np.uint32)
        between = ranks == self._rank_between
        others = [self._words.get(w) or self._word(w) for w in words.filter(wide).to_pylist()]
        lengths = np.concatenate((
            np.diff(np.flatnonzero(between), prepend=-1) - 1, np.fromiter((len(ids) // 2 for ids in others), np.int64, len(others)),
        ))
        order = np.concatenate([np.flatnonzero(x.to_numpy(zero_copy_only=False)) for x in (letters, mixed, wide)])
        length, begin = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
        length[order], begin[order] = lengths, np.cumsum(lengths) - lengths
        own = self._ids_of_ranks[ranks[~between]]
        return np.concatenate((own, np.frombuffer(b"".join(others), np.uint16))), begin, length


def _joined(words: pa.Array, after: str) -> str:
    """The words, one string, each with another string after it."""
    one = pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words)
    return pc.binary_join(one, after)[0].as_py() + after * (len(words) > 0)


@lru_cache(maxsize=2)
def word_bpe(path: str | None = None) -> WordBpe:
    """One tokenizer per worker process; without a path, the public file of this machine."""
    return WordBpe(path or default_tokenizer())
