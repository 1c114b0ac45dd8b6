"""Token ids of texts by a public tokenizer file, a chunk of texts at a time.

The vocabulary's pre-tokenizer never joins what ASCII white space parts, so the ids of a text are the ids of
its words in turn. A word of plain letters, digits and signs (most are) is cut at evident places into runs of
letters, single digits and runs of signs; any other word stays whole. These units are hashed all at once and
looked up in a table of set size that a worker keeps; the plain ones that are not there go to the tokenizers
library's model together, the whole words through all of its steps.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .common import SPACE, Words, byte_view, chunks, span_hashes

WORD_BPE = "word_bpe_49k.json"
#: Slots of a worker's table (a power of two), and ids that a slot holds; longer units are encoded each time.
SLOTS, SLOT_IDS = 1 << 20, 8
#: Bytes of a text encoded at once; a longer one is cut at white space.
PART_BYTES = 1 << 20

_HELD = np.arange(SLOT_IDS, dtype=np.int8)
_OTHER, _SPACE, _LETTER, _DIGIT, _SIGN = range(5)
#: What each byte is: "'" opens contractions and so is no plain sign; 0xC3 leads the letters from U+00C0 on.
_KIND = np.zeros(256, np.uint8)
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = _LETTER
_KIND[0x30:0x3A] = _DIGIT
_KIND[[b for b in range(0x21, 0x7F) if _KIND[b] == _OTHER and b != 0x27]] = _SIGN
_KIND[SPACE] = _SPACE
#: Second bytes of letters after 0xC3, all but the signs of multiplication and division, and their lower case.
_TRAIL = np.zeros(256, bool)
_TRAIL[[b for b in range(0x80, 0xC0) if b not in (0x97, 0xB7)]] = True
_LOWER, _LOWER_TRAIL = np.arange(256, dtype=np.uint8), np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_LOWER_TRAIL[[b for b in range(0x80, 0x9F) if b != 0x97]] += 0x20


def tokenizer_path(name: str = WORD_BPE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself, or the next free code point from 256 on."""
    spare = iter(range(256, 512))
    return {b: chr(b) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b else chr(next(spare)) for b in range(256)}


class Encoder:
    """Ids of chunks of texts; what a worker keeps of them has a set size."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.pieces = Tokenizer(self.tokenizer.model)
        self.pieces.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        size = self.tokenizer.get_vocab_size()
        self.wide = np.uint32 if size > 1 << 16 else np.uint16
        self.last = np.zeros(size, bool)  # ids that end a piece
        for text, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            self.last[i] = text.endswith("</w>")
        self.visible = byte_letters()
        self.keys = np.zeros(SLOTS, np.uint64)
        self.sizes = np.zeros(SLOTS, np.int8)
        self.ids = np.zeros((SLOTS, SLOT_IDS), self.wide)

    def missing(self, units: list[bytes], plain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of some units one after the other, and how many each has."""
        found = [b"" if p else np.array(self.tokenizer.encode(u.decode(), add_special_tokens=False).ids, self.wide) for u, p in zip(units, plain.tolist())]
        line = b" ".join(u for u, p in zip(units, plain.tolist()) if p)
        line = line.decode() if line.isascii() else line.decode("latin1").translate({b: c for b, c in self.visible.items() if b != 0x20})
        made = np.array(self.pieces.encode_batch_fast([line], add_special_tokens=False)[0].ids, self.wide)
        ends = np.flatnonzero(self.last[made]) + 1
        for k, s, e in zip(np.flatnonzero(plain).tolist(), [0, *ends[:-1].tolist()], ends.tolist()):
            found[k] = made[s:e]
        return np.concatenate(found), np.array([len(x) for x in found])

    def chunk(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the texts of a byte view one after the other, and how many each text has."""
        w = Words(data, offsets, SPACE)
        raw, n, rows = w.data, len(w.data), len(offsets) - 1
        if not len(w.starts):
            return np.empty(0, self.wide), np.zeros(rows, np.int64)
        kind, lower = _KIND[raw], _LOWER[raw]
        space = np.ones(n + 1, bool)
        space[:n] = kind == _SPACE
        lead = np.flatnonzero(raw[:-1] == 0xC3)
        lead = lead[_TRAIL[raw[lead + 1]]]
        kind[lead] = kind[lead + 1] = _LETTER
        lower[lead + 1] = _LOWER_TRAIL[raw[lead + 1]]
        token = np.flatnonzero(raw[:-1] == 0x3C)
        kind[token[raw[token + 1] == 0x7C]] = _OTHER  # "<|" opens a special token, in its own case only
        whole = np.unique(np.searchsorted(w.ends, np.flatnonzero(kind == _OTHER), side="right"))
        inside = np.zeros(n, bool)  # in a word that stays whole
        if len(whole):
            edge = np.zeros(n + 1, np.int8)
            edge[w.starts[whole]] += 1
            edge[w.ends[whole]] -= 1
            inside = np.cumsum(edge[:-1], dtype=np.int8).view(bool)
            lower[inside] = raw[inside]
        stop = np.ones(n + 1, bool)  # where a unit begins, at white space, and where a text ends
        stop[1:n] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
        stop[:n] &= ~inside
        stop[w.starts] = stop[w.ends] = True
        starts = np.flatnonzero(stop & ~space)
        ends = np.flatnonzero(stop[1:] & ~space[:-1]) + 1
        plain = ~inside[starts]
        keys = span_hashes(lower, starts, ends) ^ (~plain).astype(np.uint64)
        slots = (keys >> np.uint64(64 - SLOTS.bit_length() + 1)).astype(np.int64)
        missed = np.flatnonzero(self.keys[slots] != keys)
        sizes, table = self.sizes[slots].astype(np.int32), self.ids[slots]
        over: list[tuple[np.ndarray, np.ndarray]] = []
        if len(missed):
            _, one, back = np.unique(keys[missed], return_index=True, return_inverse=True)
            one = missed[one]
            text = lower.tobytes()
            ids, counts = self.missing([text[s:e] for s, e in zip(starts[one].tolist(), ends[one].tolist())], plain[one])
            at = np.cumsum(counts) - counts
            kept = np.zeros((len(one), SLOT_IDS), self.wide)
            for k in range(SLOT_IDS):
                there = np.flatnonzero(counts > k)
                kept[there, k] = ids[at[there] + k]
            short = counts <= SLOT_IDS
            self.keys[slots[one[short]]], self.sizes[slots[one[short]]], self.ids[slots[one[short]]] = keys[one[short]], counts[short], kept[short]
            sizes[missed], table[missed] = counts[back], kept[back]
            for k in np.flatnonzero(~short).tolist():
                over.append((missed[back == k], ids[at[k] : at[k] + counts[k]]))
        if over:
            out = np.empty(int(sizes.sum()), self.wide)
            place = np.cumsum(sizes, dtype=np.int64) - sizes
            held = _HELD < np.where(sizes <= SLOT_IDS, sizes, 0)[:, None]
            out[(place[:, None] + np.arange(SLOT_IDS))[held]] = table[held]
            for units, ids in over:
                out[(place[units][:, None] + np.arange(len(ids))).ravel()] = np.tile(ids, len(units))
        else:
            out = table[_HELD < sizes.astype(np.int8)[:, None]]
        row = np.searchsorted(w.offsets, starts, side="right") - 1
        return out, np.bincount(row, sizes, rows).astype(np.int64)

    def texts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As chunk(), for a text of any length alone or some texts that are short."""
        if len(offsets) != 2 or offsets[1] - offsets[0] <= PART_BYTES:
            return self.chunk(data, offsets)
        parts, at, end = [], int(offsets[0]), int(offsets[1])
        while at < end:
            cut = min(at + PART_BYTES, end)
            while cut < end and not SPACE[data[cut]]:
                gap = np.flatnonzero(SPACE[data[cut : min(cut + PART_BYTES, end)]])
                cut = cut + int(gap[0]) if len(gap) else min(cut + PART_BYTES, end)
            parts.append(self.chunk(data, np.array([at, cut]))[0])
            at = cut
        ids = np.concatenate(parts)
        return ids, np.array([len(ids)])


_open: dict[str, Encoder] = {}


def encoder(name: str = WORD_BPE) -> Encoder:
    if name not in _open:
        _open[name] = Encoder(tokenizer_path(name))
    return _open[name]


def encode_chunks(texts: pa.Array, name: str = WORD_BPE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Ranges of rows (first, end), their ids one after the other (16 bits; 32 for larger vocabularies), and how many each has."""
    own = encoder(name)
    data, offsets = byte_view(texts)
    for first, end in chunks(offsets):
        yield first, end, *own.texts(data, offsets[first : end + 1])


def encode(texts: pa.Array, name: str = WORD_BPE) -> Iterator[np.ndarray]:
    """Per row its ids; null counts as empty."""
    for _, _, ids, counts in encode_chunks(texts, name):
        yield from np.split(ids, np.cumsum(counts)[:-1])
