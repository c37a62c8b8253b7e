"""Token ids by a public byte-level BPE vocabulary, each distinct chunk of text encoded once.

A batch of texts is cut into chunks where no token can reach across, the chunks are
dictionary-encoded by Arrow, and the ids of all texts are gathered from those of the
distinct chunks: no Python object per word or per document.
"""

from __future__ import annotations

import ctypes
import os
import re
from array import array

import numpy as np
import pyarrow as pa

#: Chunks that a worker remembers, and the longest of them in bytes.
MOST_CHUNKS = 400_000
LONGEST = 128


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


#: A chunk that is one piece of the pre-tokenizer: letters, or marks but for the apostrophe, with a blank before them or none.
PIECE = re.compile(rb" ?(?:(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+|[!-&(-/:-@\[-`{-~]+)")


def byte_characters() -> dict[int, int]:
    """The visible character that stands for each byte in a byte-level vocabulary: its own, or the next of those from 256 on."""
    own = [b for b in range(256) if 33 <= b < 127 or 161 <= b < 173 or b > 173]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: b for b in own} | {b: 256 + i for i, b in enumerate(rest)}


def cuts(data: np.ndarray) -> np.ndarray:
    """For each byte of UTF-8 text, whether a chunk begins there.

    The byte-level pre-tokenizer's pieces hold white space only at their beginning, and before a
    visible character only one blank of it. So a piece begins at a blank before a visible
    character, at a line feed after one, and after a line feed between two of them; and
    between a letter and a digit or mark, or a mark other than the apostrophe and a letter.
    Bytes that may belong to white space outside ASCII count as neither.
    """
    out = np.zeros(len(data), bool)
    seen = (data > 32) & (data < 127)
    # the first bytes of the characters that white space outside ASCII may begin with don't count
    begins = seen | ((data >= 0xC3) & (data != 0xE1) & (data != 0xE2) & (data != 0xE3))
    out[:-1] |= (data[:-1] == 32) & begins[1:]
    feed = data == 10
    out[1:] |= feed[1:] & seen[:-1]
    out[2:] |= seen[2:] & feed[1:-1] & seen[:-2]
    low = data | 32
    letter = (low >= 97) & (low <= 122)
    ends = letter.copy()
    ends[1:] |= (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)
    other = seen & ~letter
    out[1:] |= ends[:-1] & other[1:]
    mark = other & ((data < 48) | (data > 57)) & (data != 39)
    out[1:] |= mark[:-1] & letter[1:]
    return out


def gathered(values: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The slices values[start:start + count], one after another."""
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.repeat(starts - ends + counts, counts) + np.arange(total)]


class Encoder:
    """Ids of whole texts, equal to those of ``Tokenizer.encode(text, add_special_tokens=False)``.

    A text that holds the string of a special token is encoded whole, by that call. The cache of
    chunks is of bounded size; when it is full the older chunks go, down to half.
    """

    _made: dict[str, Encoder] = {}

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.characters = byte_characters()
        self.cache: dict[bytes, bytes] = {}

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    @classmethod
    def forget(cls) -> None:
        """Gives back what this worker keeps from encoding, for a stage that doesn't encode."""
        if cls._made:
            cls._made.clear()
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)

    def _ids(self, texts: list[bytes]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)]

    def _new(self, chunks: list[bytes]) -> dict[bytes, bytes]:
        """Ids of chunks: the model's own of those that are one piece, and of the rest by the whole tokenizer."""
        tokenize, out, rest = self.tokenizer.model.tokenize, {}, []
        for c in chunks:
            if PIECE.fullmatch(c):
                out[c] = array("I", [t.id for t in tokenize(c.decode("latin-1").translate(self.characters))]).tobytes()
            else:
                rest.append(c)
        return out | dict(zip(rest, self._ids(rest)))

    def _of_chunks(self, chunks: list[bytes]) -> list[bytes]:
        found = self._new([c for c in chunks if c not in self.cache])
        out = [found[c] if c in found else self.cache[c] for c in chunks]
        self.cache.update((k, v) for k, v in found.items() if len(k) <= LONGEST)
        if len(self.cache) > MOST_CHUNKS:
            for k in list(self.cache)[: len(self.cache) - MOST_CHUNKS // 2]:
                del self.cache[k]
        return out

    def _special_rows(self, raw: bytes, offsets: np.ndarray) -> list[int]:
        """Rows that hold the string of a special token."""
        rows = set()
        for s in self.special:
            at = raw.find(s)
            while at >= 0:
                row = int(np.searchsorted(offsets, at, "right")) - 1
                if at + len(s) <= offsets[row + 1]:
                    rows.add(row)
                    at = raw.find(s, int(offsets[row + 1]))
                else:
                    at = raw.find(s, at + 1)
        return sorted(rows)

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, each with end_id after it; where each text's begin, and their total). Null texts are empty."""
        texts = texts.cast(pa.large_binary()).fill_null(b"")
        _, places, data = texts.buffers()
        offsets = np.frombuffer(places, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(texts) else np.empty(0, np.uint8)
        offsets = offsets - offsets[0]
        begin, full = cuts(raw), np.flatnonzero(np.diff(offsets))
        begin[offsets[full + 1] - 1] &= raw[offsets[full + 1] - 1] != 32  # a blank that ends a text is before no character
        begin[offsets[full]] = True
        starts = np.flatnonzero(begin)
        chunks = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.append(starts, len(raw)).astype(np.int64)), pa.py_buffer(raw)]).dictionary_encode()
        distinct = [*self._of_chunks(chunks.dictionary.to_pylist()), array("I", [end_id]).tobytes()]
        counts = np.fromiter(map(len, distinct), np.int64, len(distinct)) // 4
        # the end is one chunk more of each text
        code = np.insert(chunks.indices.to_numpy(), np.searchsorted(starts, offsets[1:]), len(distinct) - 1)
        ids = gathered(np.frombuffer(b"".join(distinct), np.uint32), (np.cumsum(counts) - counts)[code], counts[code])
        upto = np.concatenate([[0], np.cumsum(counts[code])])
        bounds = np.concatenate([[0], upto[np.flatnonzero(code == len(distinct) - 1) + 1]])
        rows = self._special_rows(raw.tobytes(), offsets) if len(raw) else []
        if rows:
            parts = [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
            for row in rows:
                parts[row] = np.append(np.frombuffer(self._ids([raw[offsets[row] : offsets[row + 1]].tobytes()])[0], np.uint32), np.uint32(end_id))
            ids, bounds = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        return ids, bounds.astype(np.int64)
