"""Byte-level BPE ids through the ``tokenizers`` library, with a bounded memo.

Byte-level pre-tokenisation never joins characters across a single blank or line end between two
non-space characters, nor a letter with ASCII punctuation up to the next blank, so a text may be cut
there.  The memo holds the library's ids of up to ``MEMO_PIECES`` pieces seen lately; the new pieces of a
batch are encoded in one call, as one text, and told apart by the byte lengths of their tokens.  Texts with
other white space, and tokenizers of any other kind, get whole texts.
"""

from __future__ import annotations

import json
import os
import re
from itertools import chain, filterfalse, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MEMO_PIECES = 300_000

_CUT = "\x01"
#: closing punctuation between a letter and a blank is a piece of its own, marked as one without a blank before it
_CLOSING = r"(\p{L})([!-/:-@\[-`{-~]+)( |$)"
#: letters by any version of Unicode
_LETTERS = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+").fullmatch
#: byte-level characters: printable bytes of Latin-1 stand for themselves, the others for 256, 257, ... in order; a blank separates
_OWN = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTE_CHARACTERS = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _OWN) if b != 32}
_encoders: dict[str, "Encoder"] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_level(spec: dict) -> bool:
    pre = spec.get("pre_tokenizer") or {}
    return (
        spec.get("normalizer") is None
        and pre.get("type") == "ByteLevel"
        and not pre.get("add_prefix_space")
        and pre.get("use_regex", True)
        and all(t["special"] for t in spec.get("added_tokens", []))
    )


class Encoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        self.cut = _byte_level(json.loads(self.library.to_str()))
        if self.cut:
            vocabulary = self.library.get_vocab()
            self.bytes_of = np.zeros(max(vocabulary.values()) + 1, np.int64)
            for token, i in vocabulary.items():
                self.bytes_of[i] = len(token)
        self._forget()

    def _forget(self) -> None:
        """An empty memo: row of " " + piece in a table of id lists; pieces that begin with a line end or ``_CUT`` have no blank."""
        self.memo: dict[str, int] = {}
        self.lists = Lists()

    def _library(self, texts: list[str]) -> list[bytes]:
        found = self.library.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, np.uint32).tobytes() for e in found]

    def _rows(self, pieces: list[str]) -> np.ndarray:
        """Rows of distinct pieces in ``lists``; unknown ones are encoded first."""
        if len(self.memo) > MEMO_PIECES:
            self._forget()
        rows = np.fromiter(map(self.memo.get, pieces, repeat(-1)), np.int64, len(pieces))
        missing = np.flatnonzero(rows < 0)
        if len(missing):
            new = [pieces[i] for i in missing.tolist()]
            uncut = [p for p in new if p[:1] == _CUT]
            if uncut:
                raws = self._library([p[1:] for p in uncut])
                self._add(uncut, np.frombuffer(b"".join(raws), np.uint32), [len(r) // 4 for r in raws])
            if len(uncut) < len(new):
                blank = [p for p in new if p[:1] != _CUT] if uncut else new
                words = list(filter(_LETTERS, blank))
                if words:
                    self._encode_words(words)
                if len(words) < len(blank):
                    self._encode_pieces(list(filterfalse(_LETTERS, blank)))
            rows[missing] = [self.memo[p] for p in new]
        return rows

    def _add(self, pieces: list[str], ids: np.ndarray, sizes) -> None:
        first = self.lists.add(ids, sizes)
        self.memo.update(zip(pieces, range(first, first + len(pieces))))

    def _encode_words(self, new: list[str]) -> None:
        """A blank and letters are one piece for the merges; its bytes are given as the characters that stand for them."""
        tokenize = self.library.model.tokenize
        plain, other = list(filter(str.isascii, new)), list(filterfalse(str.isascii, new))
        raws = plain + " ".join(other).encode().decode("latin-1").translate(_BYTE_CHARACTERS).split(" ") if other else plain
        lists = [[t.id for t in tokenize("\u0120" + raw)] for raw in raws]
        self._add(plain + other, np.fromiter(chain.from_iterable(lists), np.uint32), list(map(len, lists)))

    def _encode_pieces(self, new: list[str]) -> None:
        """One call for all: tokens don't cross the cuts before pieces, so byte lengths tell them apart."""
        text = f" {' '.join(new)}".replace(" \n", "\n")
        ids = np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
        token_ends = np.cumsum(self.bytes_of[ids])
        column = pa.array(new, pa.large_string())
        blanks = 1 - pc.starts_with(column, "\n").to_numpy(zero_copy_only=False).astype(np.int64)
        piece_ends = np.cumsum(pc.binary_length(column).to_numpy() + blanks)
        at = np.searchsorted(token_ends, piece_ends)
        if at[-1] >= len(ids) or not np.array_equal(token_ends[at], piece_ends):
            raise ValueError("tokens cross a cut between pieces")
        self._add(new, ids, np.diff(at, prepend=-1))

    def _tight(self, text: str) -> bool:
        """Whether all white space is single blanks and single line ends between words."""
        words = text.split()
        # the numbers are equal only if no other white space makes up for a missing gap; the lengths, only if all gaps are single
        gaps = text.count(" ") + text.count("\n")
        return len(words) == gaps + 1 and len(" ".join(words)) == len(text) and _CUT not in text

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text as an unsigned 32-bit array, without special tokens.

        Pieces between blanks are told apart and dictionary-encoded by Arrow; only distinct pieces of
        the batch are looked up, and all ids are gathered in one step.
        """
        out: list[np.ndarray] = [np.empty(0, np.uint32)] * len(texts)
        tight = [i for i, t in enumerate(texts) if t and self._tight(t)] if self.cut else []
        inside = set(tight)
        loose = [i for i, t in enumerate(texts) if t and i not in inside]
        for i, raw in zip(loose, self._library([texts[i] for i in loose])):
            out[i] = np.frombuffer(raw, np.uint32)
        if tight:
            # a line end stands before the piece that it begins; closing punctuation and a first piece have no blank before them
            column = pa.array([texts[i] for i in tight], pa.large_string())
            marked = pc.replace_substring_regex(pc.replace_substring(column, "\n", " \n"), _CLOSING, rf"\1 {_CUT}\2\3")
            pieces = pc.split_pattern(pc.binary_join_element_wise(pa.scalar(_CUT, pa.large_string()), marked, pa.scalar("", pa.large_string())), " ")
            coded = pieces.values.dictionary_encode()
            rows = self._rows(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
            ids, n = self.lists.gather(rows[coded.indices.to_numpy()])
            begin = 0
            for i, end in zip(tight, np.concatenate(([0], np.cumsum(n)))[pieces.offsets.to_numpy()[1:]].tolist()):
                out[i] = ids[begin:end]
                begin = end
        return out


class Lists:
    """A growing table of lists of ids, flat."""

    def __init__(self):
        self.ids, self.begin, self.size = np.empty(1 << 16, np.uint32), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.rows = self.used = 0

    def add(self, ids: np.ndarray, sizes) -> int:
        """Appends lists of the given sizes, whose ids are ``ids``; returns the first one's row."""
        sizes = np.asarray(sizes, np.int64)
        first, rows, used = self.rows, self.rows + len(sizes), self.used + len(ids)
        if used > len(self.ids):
            self.ids = np.resize(self.ids, max(used, 2 * len(self.ids)))
        if rows > len(self.size):
            self.begin, self.size = (np.resize(x, max(rows, 2 * len(x))) for x in (self.begin, self.size))
        self.ids[self.used : used] = ids
        self.size[first:rows] = sizes
        self.begin[first:rows] = self.used + np.cumsum(sizes) - sizes
        self.rows, self.used = rows, used
        return first

    def gather(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all ``rows``, one list after the other, and their sizes."""
        n = self.size[rows]
        shift = self.begin[rows] - (np.cumsum(n) - n)
        return self.ids[np.repeat(shift, n) + np.arange(int(n.sum()))], n


def encoder(path: str) -> Encoder:
    """One encoder per file and worker process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
