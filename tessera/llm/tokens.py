"""Token ids of whole texts by a public tokenizer file, piece by piece.

A byte-level BPE never joins a non-space character with a white-space
character after it, so a text may be cut before every white-space run and its
pieces encoded apart.  A block of texts is cut by numpy.  Its distinct
pieces of Latin letters, with at most one white-space byte before and marks after,
are cut into the parts that the splitter would make; the library's model encodes
many parts in one call, set apart by a byte that no merge holds.  Other pieces are
encoded one by one.  One gather puts the ids of all pieces together.  Pieces are
found equal by a key and then compared byte by byte.  Texts with characters whose
white-space class differs between engines or with an added token of the file
(such as an end-of-text mark) are encoded whole, as are all texts when the file
is no byte-level BPE with the usual split.
"""

from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np

from . import textkernel as tk
from .support import arrow_text, doc_blocks

#: White space beyond ASCII and separators that engines class differently (fixed values).
_WIDE = re.compile(
    b"[\x1c-\x1f]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe1\xa0\x8e|\xe2\x80[\x80-\x8b\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80|\xef\xbb\xbf"
)
_LEADS = np.zeros(256, bool)
_LEADS[[*range(0x1C, 0x20), 0xE1, 0xE2, 0xE3, 0xEF]] = True
#: Byte-level BPE writes bytes that are no visible Latin-1 character as U+0100 on.
_HIDDEN = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174)]
_BYTE_CHARS = {b: 256 + i for i, b in enumerate(_HIDDEN)}
#: The character of each byte.
_CHAR = np.array([_BYTE_CHARS.get(b, b) for b in range(256)], "<u4")
_ASCII = np.arange(256) < 128
_LETTERS = np.array([chr(b).isalpha() for b in range(256)]) & _ASCII
_MARKS = (np.arange(256) > 32) & (np.arange(256) < 127) & ~np.array([chr(b).isalnum() for b in range(256)])
#: Texts per library call, bytes of parts per call of the model, bytes per block.
_CALL, _PARTS, _BLOCK = 64, 1 << 8, 4 << 20
_loaded: dict[str, "Encoder"] = {}


class Encoder:
    """Encodes texts to ids with a file of the tokenizers library."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.vocab = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2") if self.vocab <= 1 << 16 else np.dtype("<u4")
        self._code = "H" if self.dtype.itemsize == 2 else "I"
        spec = json.loads(self.tokenizer.to_str())
        #: Texts that hold one of these are encoded whole, as the library finds them before it splits.
        self._added = [t["content"].encode() for t in spec.get("added_tokens") or ()]
        split = spec.get("pre_tokenizer") or {}
        #: Only a byte-level BPE with the usual split pattern may be cut into pieces.
        self.by_piece = (
            split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
            and spec["model"]["type"] == "BPE" and not spec.get("normalizer")
        )
        model = spec["model"]
        within = set("".join(t for t in self.tokenizer.get_vocab() if len(t) > 1))
        lone = [b for b in range(9) if chr(_CHAR[b]) not in within and self.tokenizer.token_to_id(chr(_CHAR[b])) is not None]
        odd = ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")
        #: A control byte that stands in no longer token, so nothing merges across it.
        self._wall = lone[0] if self.by_piece and lone and not any(model.get(k) for k in odd) else None
        del spec, model, within
        if self._wall is not None:
            self._wall_id = self.tokenizer.token_to_id(chr(_CHAR[self._wall]))
            self._model = self.tokenizer.model

    def _whole(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for i in range(0, len(texts), _CALL):  # the library frees small batches much faster
            done = self.tokenizer.encode_batch_fast(texts[i : i + _CALL], add_special_tokens=False)
            out += [array(self._code, e.ids).tobytes() for e in done]
        return out

    def _apart(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of pieces, each a text of its own, and how many each has."""
        pieces = [raw[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        ids = self._whole(pieces)
        return np.frombuffer(b"".join(ids), self.dtype), np.fromiter(map(len, ids), np.int64, len(ids)) // self.dtype.itemsize

    def _side_by_side(self, raw: np.ndarray, starts: np.ndarray, body: np.ndarray, tail: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for pieces whose letters begin at ``body`` and end at ``tail``."""
        # up to three parts a piece: white space but a space, letters with a space before, marks
        glued = (body == starts) | (raw[starts] == 32)
        edges = np.stack([starts, np.where(glued, starts, body), tail, ends], axis=1)
        lo, hi = edges[:, :-1].ravel(), edges[:, 1:].ravel()
        some = hi > lo
        lo, n = lo[some], (hi - lo)[some] + 1
        upto = np.cumsum(n)
        data = raw[np.minimum(np.arange(upto[-1]) + np.repeat(lo - (upto - n), n), len(raw) - 1)]
        data[upto - 1] = self._wall
        cuts = upto[np.searchsorted(upto, np.arange(_PARTS, upto[-1], _PARTS))].tolist()
        cuts = sorted({0, *cuts, int(upto[-1])})
        chars = _CHAR[data].tobytes()
        ids = array(self._code)
        for a, b in zip(cuts, cuts[1:], strict=False):
            ids.extend([t.id for t in self._model.tokenize(chars[4 * a : 4 * b].decode("utf-32-le"))])
        ids = np.frombuffer(ids, self.dtype)
        wall = ids == self._wall_id
        per_part = np.diff(np.flatnonzero(wall), prepend=-1) - 1
        per_piece = np.zeros(some.size, np.int64)
        per_piece[some] = per_part
        return ids[~wall], per_piece.reshape(-1, 3).sum(axis=1)

    def _plain(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        """Which pieces can stand side by side, and where their letters begin and end."""
        body = starts + ~tk.NOT_SPACE[raw[starts]]
        lead = (raw >= 0xC3) & (raw <= 0xC9)
        fine = _LETTERS[raw] | lead | (raw & 0xC0 == 0x80)
        # multiplication and division signs, and what follows U+024F
        fine[1:] &= ~((raw[:-1] == 0xC3) & ((raw[1:] == 0x97) | (raw[1:] == 0xB7)) | (raw[:-1] == 0xC9) & (raw[1:] > 0x8F))
        # a two-byte character is a lead and one byte more
        fine[1:] &= (raw[1:] & 0xC0 == 0x80) == lead[:-1]
        none = np.append(np.flatnonzero(~fine), len(raw))
        tail = np.minimum(none[np.searchsorted(none, body)], ends)
        none = np.append(np.flatnonzero(~_MARKS[raw]), len(raw))
        return (tail > body) & (none[np.searchsorted(none, tail)] >= ends), body, tail

    def _block(self, raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a block of texts, and how many each text has."""
        space = ~tk.NOT_SPACE[raw]
        first = np.empty(len(raw), bool)
        first[0] = True
        np.logical_and(space[1:], ~space[:-1], out=first[1:])
        first[bounds[:-1][bounds[:-1] < len(raw)]] = True
        starts = np.flatnonzero(first)
        ends = np.append(starts[1:], len(raw))
        _, at, which = np.unique(tk.piece_keys(raw, starts, ends), return_index=True, return_inverse=True)
        same = at[which]
        if not (np.array_equal(ends - starts, (ends - starts)[same]) and tk.same_bytes(raw, ends - starts, starts, starts[same])):
            at = which = np.arange(len(starts))  # two pieces share a key: each is encoded by itself
        # distinct pieces in the order of the text, so that what follows reads it in order
        order = np.argsort(at)
        place = np.empty(len(at), np.int64)
        place[order] = np.arange(len(at))
        at, which = at[order], place[which]
        a, b = starts[at], ends[at]
        lens, begin = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        plain = np.zeros(len(at), bool)
        parts = []
        if self._wall is not None:
            plain, body, tail = self._plain(raw, a, b)
        if plain.any():
            parts.append((plain, *self._side_by_side(raw, a[plain], body[plain], tail[plain], b[plain])))
        parts.append((~plain, *self._apart(raw, a[~plain], b[~plain])))
        total = 0
        for mask, ids, n in parts:
            lens[mask], begin[mask] = n, total + np.cumsum(n) - n
            total += len(ids)
        flat = np.concatenate([ids for _, ids, _ in parts])
        mine = lens[which]
        done = np.cumsum(mine)
        at_type = np.int32 if done[-1] < 1 << 30 else np.int64
        shift = (begin[which] - (done - mine)).astype(at_type)
        out = flat[np.repeat(shift, mine) + np.arange(done[-1], dtype=at_type)]
        before = np.concatenate([[0], done])[np.searchsorted(starts, bounds)]
        return out, np.diff(before)

    def _holds_added(self, data: bytes) -> bool:
        return any(t in data for t in self._added)

    def encode_column(self, col):
        """(first row, ids per row, all ids) of blocks of an Arrow string column; null is empty."""
        raw, bounds = arrow_text(col)
        for i, j in doc_blocks(bounds, _BLOCK):
            own, at = raw[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i]
            if not len(own):
                yield i, np.zeros(j - i, np.int64), np.zeros(0, self.dtype)
                continue
            data = own.tobytes()
            if self.by_piece and not (_LEADS[own] | (own == 0xC2)).any() and not self._holds_added(data):
                ids, n = self._block(own, at)
                yield i, n, ids
            else:  # look closer, text by text
                for k in range(j - i):
                    text = data[at[k] : at[k + 1]]
                    if not text:
                        yield i + k, np.zeros(1, np.int64), np.zeros(0, self.dtype)
                    elif self.by_piece and not _WIDE.search(text) and not self._holds_added(text):
                        ids, n = self._block(own[at[k] : at[k + 1]], np.array([0, len(text)]))
                        yield i + k, n, ids
                    else:
                        ids = np.frombuffer(self._whole([text.decode("utf-8", "replace")])[0], self.dtype)
                        yield i + k, np.array([len(ids)]), ids


def with_end(n: np.ndarray, ids: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The same ids with ``end`` after each text's, and offsets of the texts."""
    at = np.zeros(len(n) + 1, np.int64)
    np.cumsum(n + 1, out=at[1:])
    out = np.full(at[-1], end, ids.dtype)
    inside = np.ones(at[-1], bool)
    inside[at[1:] - 1] = False
    out[inside] = ids
    return out, at


def encoder(path: str) -> Encoder:
    """The encoder of ``path`` in this process, loaded once."""
    if path not in _loaded:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _loaded[path] = Encoder(path)
    return _loaded[path]
