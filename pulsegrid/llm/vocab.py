"""Encoding of many texts with a public vocabulary through the ``tokenizers`` library.

A text is cut at spaces where the vocabulary's own splitting must cut as well, so every part is encoded on its own;
each distinct part goes through the library once and is then looked up.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Regex, Tokenizer, decoders, models, pre_tokenizers

from pulsegrid.llm.common import remember, spread

MAX_PARTS = 500_000  # parts remembered per worker before the memory starts afresh
MAX_WORDS = 1_000_000  # the same where marks are cut off ahead
CLOSING = ".,;:!?%#$&*()[]\"-"
INNER_SPACE = re.compile(r"(?<=\S) (?=\S)")
LINE_BREAK = re.compile(r"(?<=\S)(\n)(?=\S)")
CLOSED = r"([A-Za-z0-9])([" + re.sub(r"(.)", r"\\\1", CLOSING) + r"]+)(\s|\z)"  # as ``pieces`` cuts, for ASCII stems
SPACE_BY_SPACE = r"[\s\v\x1c-\x1f\x{85}\pZ] | [\s\v\x1c-\x1f\x{85}\pZ]"


def parts_without_space(texts: pa.Array) -> pa.ListArray:
    """Parts for vocabularies that drop white space and case: cut at ASCII white space and before closing marks.

    A word and the word with a mark behind it are then one part and the mark, not two parts to remember.
    ASCII letters are lower-cased ahead, which makes fewer parts. It could change what a letter and a combining mark
    compose to, so texts with marks are left alone.
    """
    if not pc.any(pc.match_substring_regex(texts, r"\pM")).as_py():
        texts = pc.ascii_lower(texts)
    return pc.ascii_split_whitespace(pc.replace_substring_regex(texts, CLOSED, r"\1 \2\3"))


def parts_with_space(texts: pa.Array) -> pa.ListArray:
    """Parts for vocabularies that keep a space before the next word; every part but a text's first has lost its space.

    A cut stands only at a single space between two other characters: every alternative of the split pattern
    ends there, and none looks further back. Runs of white space stay whole.
    """
    parts = pc.split_pattern(texts, " ")
    odd = pc.match_substring_regex(texts, SPACE_BY_SPACE).to_numpy(zero_copy_only=False)
    if not odd.any():
        return parts
    given = [INNER_SPACE.split(t.as_py()) if o else p.as_py() for t, p, o in zip(texts, parts, odd, strict=True)]
    return pa.array(given, pa.list_(pa.string()))


def pieces(part: str) -> list[str]:
    """A part cut where any split pattern here cuts: around a lone line feed, and between a letter or digit and closing marks."""
    out = []
    for piece in LINE_BREAK.split(part) if "\n" in part else [part]:
        stem = piece.rstrip(CLOSING)
        if len(stem) < len(piece) and stem and stem[-1].isalnum() and stem[-1].lower()[-1].isalnum():
            out += [stem, piece[len(stem) :]]
        else:
            out.append(piece)
    return out


class PartEncoder:
    """Token ids of texts by way of their distinct parts."""

    def __init__(self, tokenizer: Tokenizer, parts: Callable[[pa.Array], pa.ListArray], spaced: bool, most: int = MAX_PARTS):
        self.tokenizer, self.parts, self.spaced, self.most = tokenizer, parts, spaced, most
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.used = np.zeros(1 << 16, np.int32), 0
        self.first, self.count = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def _learn(self, new: list[str]) -> None:
        cut = {part: pieces(part) for part in new}
        fresh = [p for p in dict.fromkeys(chain.from_iterable(cut.values())) if p not in self.known]
        for at in range(0, len(fresh), 20_000):
            chunk = fresh[at : at + 20_000]
            (got,) = self.tokenizer.encode_batch([chunk], is_pretokenized=True, add_special_tokens=False)
            counts = np.bincount(np.array(got.word_ids, np.int64), minlength=len(chunk))
            self._add(chunk, np.array(got.ids, np.int32), counts)
        joined = [part for part, own in cut.items() if len(own) > 1]
        if joined:
            at = np.array([self.known[p] for part in joined for p in cut[part]], np.int64)
            ends = np.cumsum(self.count[at])[np.cumsum([len(cut[part]) for part in joined]) - 1]
            self._add(joined, self.flat[spread(self.first[at], self.count[at])], np.diff(ends, prepend=0))

    def _add(self, parts: list[str], ids: np.ndarray, counts: np.ndarray) -> None:
        n, used = len(self.known), self.used
        self.flat = _room(self.flat, used + len(ids))
        self.first, self.count = _room(self.first, n + len(parts)), _room(self.count, n + len(parts))
        self.flat[used : used + len(ids)] = ids
        self.first[n : n + len(parts)] = used + np.cumsum(counts) - counts
        self.count[n : n + len(parts)] = counts
        self.known.update(zip(parts, range(n, n + len(parts)), strict=True))
        self.used += len(ids)

    def _look_up(self, distinct: list[str]) -> np.ndarray:
        found = list(map(self.known.get, distinct))
        if None in found:
            new = [p for p, at in zip(distinct, found, strict=True) if at is None]
            if len(self.known) + 2 * len(new) > self.most:
                self._forget()
                new = distinct
            self._learn(new)
            found = list(map(self.known.__getitem__, distinct))
        return np.array(found, np.int64)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and the number of ids of each text. ``texts`` holds no nulls."""
        split = self.parts(texts)
        starts = split.offsets.to_numpy().astype(np.int64)
        flat = split.values.slice(starts[0], starts[-1] - starts[0]).dictionary_encode()
        starts = starts - starts[0]
        sizes, code = np.diff(starts), flat.indices.to_numpy()
        words = flat.dictionary.to_numpy(zero_copy_only=False).tolist()
        if self.spaced:
            lead = starts[:-1][sizes > 0]
            firsts = [words[c] for c in code[lead].tolist()]
            at = self._look_up([*(" " + w for w in words), *firsts])
            code = code.astype(np.int64)
            code[lead] = np.arange(len(words), len(words) + len(firsts))
            at = at[code]
        else:
            at = self._look_up(words)[code]
        counts = self.count[at]
        ids = self.flat[spread(self.first[at], counts)]
        ends = np.concatenate([[0], np.cumsum(counts)])
        return ids, np.diff(ends[starts])


def _room(array: np.ndarray, size: int) -> np.ndarray:
    if size <= len(array):
        return array
    grown = np.zeros(max(size, 2 * len(array)), array.dtype)
    grown[: len(array)] = array
    return grown


@lru_cache(maxsize=4)
def word_encoder(path: str) -> PartEncoder:
    """Encoder of a ``tokenizers`` file whose splitting drops white space."""
    remember(word_encoder.cache_clear)
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return PartEncoder(tokenizer, parts_without_space, spaced=False, most=MAX_WORDS)


def byte_table() -> list[str]:
    """The printable character that stands for each byte: itself if printable, else the next from U+0100 on."""
    printable = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@lru_cache(maxsize=2)
def byte_tokenizer(path: str, pattern: str) -> Tokenizer:
    """A byte-level BPE tokenizer with the merges that a rank file implies.

    Any two neighbours whose joined bytes are a token may merge, lowest rank first, so each token brings every split of
    it into two tokens. A part that is itself a token is taken as it is.
    """
    ranks, chars = read_ranks(path), byte_table()
    shown = {token: "".join(map(chars.__getitem__, token)) for token in ranks}
    merges = [
        (shown[token[:k]], shown[token[k:]])
        for token in sorted(ranks, key=ranks.__getitem__)
        for k in range(1, len(token))
        if token[:k] in ranks and token[k:] in ranks
    ]
    tokenizer = Tokenizer(models.BPE({shown[t]: r for t, r in ranks.items()}, merges, ignore_merges=True))
    tokenizer.pre_tokenizer = pre_tokenizers.Sequence(
        [pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
    )
    tokenizer.decoder = decoders.ByteLevel()
    return tokenizer


@lru_cache(maxsize=2)
def byte_encoder(path: str, pattern: str) -> PartEncoder:
    remember(byte_encoder.cache_clear)
    return PartEncoder(byte_tokenizer(path, pattern), parts_with_space, spaced=True)


@lru_cache(maxsize=2)
def token_bytes(path: str) -> list[bytes]:
    """Bytes of each id."""
    ranks = read_ranks(path)
    out = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        out[rank] = token
    return out
