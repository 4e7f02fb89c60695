"""Whole texts to token ids with the tokenizers library, each distinct piece once.

The pre-tokenizers of both vocabularies never join a character that is not
white space with white space after it, so a text may be cut at every such
place, and the ids of the pieces concatenated are the ids of the text.  Arrow
cuts the texts of a batch and numbers the distinct pieces; the library sees the
distinct ones alone, and numpy puts the ids together.
"""

from __future__ import annotations

import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .workers import per_stage

#: Distinct pieces that a worker remembers, of some 40 bytes each, and the longest, in bytes.
CACHE_ENTRIES, CACHE_LONGEST = 1_000_000, 64
#: Characters of texts whose pieces are numbered at once, and put together at once.
NUMBERED, JOINED = 1 << 24, 1 << 20
_CHUNKS = re.compile(r"[ \t-\r]*[^ \t-\r]+|[ \t-\r]+")
#: Special tokens and white space beyond ASCII's usual six: such a text is encoded in one piece.
_ODD = r"<\||[\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Besides these, texts with runs of white space, or other than blanks and line feeds.
_RUNS = r"[\t\x0b-\r]|[ \n][ \n]"
#: A Latin letter or digit and a mark of ASCII: both pre-tokenizers part them, and a contraction begins with its mark.
_CUT = r"([0-9A-Za-zÀ-ÖØ-öø-ſ])([!-/:-@\[-`{-~])"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_alphabet() -> dict[int, str]:
    """The printable stand-ins of byte-level vocabularies: printable Latin-1
    bytes stand for themselves, the others for 256 and up in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = (b for b in range(256) if b not in set(plain))
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


def gathered(flat: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The stretches of ``flat`` in a row."""
    ends = np.cumsum(length)
    return flat[np.repeat(start - ends + length, length) + np.arange(ends[-1] if len(ends) else 0)]


class Remembered:
    """Pieces and their ids in a row: Arrow looks pieces up in far less memory
    than a dictionary takes.  If they would be more than ``most``, those of the
    last call alone stay; it may have more."""

    def __init__(self, most: int):
        self.most, self.pieces = most, None
        self.flat, self.start, self.length = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def find(self, pieces: pa.Array) -> np.ndarray:
        """Each piece's place, -1 for what isn't known."""
        if self.pieces is None:
            return np.full(len(pieces), -1, np.int64)
        return pc.fill_null(pc.index_in(pieces, value_set=self.pieces), -1).to_numpy().astype(np.int64)

    def add(self, pieces: pa.Array, flat: np.ndarray, start: np.ndarray, length: np.ndarray) -> None:
        short = pc.less_equal(pc.binary_length(pieces), CACHE_LONGEST)
        at = np.flatnonzero(short.to_numpy(zero_copy_only=False))
        pieces, start, length = pieces.filter(short), start[at], length[at]
        flat, own = gathered(flat, start, length), np.cumsum(length) - length
        if self.pieces is None:
            self.pieces, self.flat, self.start, self.length = pieces, flat, own, length
        else:
            self.start, self.length = np.concatenate([self.start, own + len(self.flat)]), np.concatenate([self.length, length])
            self.pieces, self.flat = pa.concat_arrays([self.pieces, pieces]), np.concatenate([self.flat, flat])


class Encoder:
    """``drop_space``: the vocabulary's normaliser drops white space and lowers
    letters.  ``separator``: a special token that parts pieces which are
    encoded in one call."""

    def __init__(self, path: str, drop_space: bool = False, separator: str = "<|endoftext|>"):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.model = self.tok.model
        self.drop_space = drop_space
        self.separator, self.sep_id = separator, self.tok.token_to_id(separator)
        self.known = Remembered(CACHE_ENTRIES)
        self.bytes = str.maketrans({chr(b): c for b, c in byte_alphabet().items()})

    def _ids_of_new(self, new: list[str]) -> list[tuple[int, ...]]:
        """Words of Latin letters alone go to the library's model as they are:
        pre-tokenizers keep them whole and normalisers lower them at most.
        Others go through all of its steps."""
        tokenize, table, lower, out, rest = self.model.tokenize, self.bytes, self.drop_space, [], []
        for k, x in enumerate(new):
            if x.isascii():
                if x.isalpha():
                    out.append(tuple([t.id for t in tokenize(x)]))
                    continue
                if x[:1] == " " and x[1:].isalpha():
                    out.append(tuple([t.id for t in tokenize("Ġ" + x[1:])]))
                    continue
            elif (x[1:] if x[:1] == " " else x).isalpha() and max(x) < "ƀ" and "İ" not in x:
                x = (x.lower() if lower else x).encode().decode("latin-1").translate(table)
                out.append(tuple([t.id for t in tokenize(x)]))
                continue
            out.append(())
            rest.append(k)
        plain = [k for k in rest if "<|" not in new[k]]
        for i in range(0, len(plain), 500):
            part = plain[i : i + 500]
            ids = np.array(self._ids(self.separator.join([new[k] for k in part])), np.int64)
            ends = [*np.flatnonzero(ids == self.sep_id).tolist(), len(ids)]
            ids, at = ids.tolist(), 0
            for k, end in zip(part, ends, strict=True):
                out[k], at = tuple(ids[at:end]), end + 1
        for k in rest:
            if "<|" in new[k]:
                out[k] = tuple(self._ids(new[k]))
        return out

    def _ids(self, text: str) -> list[int]:
        return self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _pieces(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """All pieces in a row, and where each text's begin (one more at the end)."""
        odd = pc.match_substring_regex(texts, _ODD if self.drop_space else f"{_ODD}|{_RUNS}")
        plain = pc.if_else(odd, "", texts) if pc.any(odd).as_py() else texts
        # Both pre-tokenizers part a letter or digit and a mark, and a line feed and a letter.
        if self.drop_space:
            plain = pc.replace_substring_regex(pc.ascii_lower(plain), _CUT, r"\1 \2")
            for c in "\t\n\x0b\x0c\r":
                plain = pc.replace_substring(plain, c, " ")
            cut = pc.split_pattern(plain, " ")
        else:
            plain = pc.replace_substring(plain, "\n", "\x1f\n\x1f")
            plain = pc.replace_substring_regex(pc.replace_substring(plain, " ", "\x1f "), _CUT, "\\1\x1f\\2")
            cut = pc.split_pattern(plain, "\x1f")
        pieces, at = cut.flatten(), cut.offsets.to_numpy().astype(np.int64)
        at -= at[0]
        if not pc.any(odd).as_py():
            return pieces, at
        # Texts with odd white space are one piece, those with runs go by them.
        lists, before = [], 0
        strange = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        whole = pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False)
        n = np.diff(at)
        for k in strange.tolist():
            lists.append(pieces.slice(before, at[k] - before))
            t = texts[k].as_py()
            own = [t] if whole[k] else _CHUNKS.findall(t)
            lists.append(pa.array(own, pa.string()))
            n[k], before = len(own), at[k + 1]
        lists.append(pieces.slice(before))
        return pa.concat_arrays(lists), np.concatenate([[0], np.cumsum(n)])

    def _rows(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct pieces in a row, and each one's start and length."""
        known = self.known
        at = known.find(distinct)
        new = np.flatnonzero(at < 0)
        pieces = distinct.take(pa.array(new))
        ids = self._ids_of_new(pieces.to_pylist())
        length = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), np.uint32, int(length.sum()))
        start = np.cumsum(length) - length
        at[new] = len(known.start) + np.arange(len(new))
        lengths = np.concatenate([known.length, length])[at]
        starts = np.concatenate([known.start, start + len(known.flat)])[at]
        own = gathered(np.concatenate([known.flat, flat]), starts, lengths)
        starts = np.cumsum(lengths) - lengths
        if len(known.start) + len(new) > known.most:
            self.known = Remembered(known.most)
            self.known.add(distinct, own, starts, lengths)
        elif len(new):
            known.add(pieces, flat, start, length)
        return own, starts, lengths

    def encode(self, texts: pa.Array):
        """(from, to, ids, counts) for runs of the rows: all their ids in a row,
        and how many each text has.  Null texts have none."""
        texts = pc.fill_null(texts, "")
        for i, j in text_slices(texts, NUMBERED):
            pieces, at = self._pieces(texts.slice(i, j - i))
            numbered = pieces.dictionary_encode()
            index = numbered.indices.to_numpy()
            flat, start, length = self._rows(numbered.dictionary)
            del pieces, numbered
            for a, b in text_slices(texts.slice(i, j - i), JOINED):
                which = index[at[a] : at[b]]
                n = length[which]
                ends = np.concatenate([[0], np.cumsum(n)])
                ids = flat[np.repeat(start[which] - ends[:-1], n) + np.arange(ends[-1])]
                yield i + a, i + b, ids, np.diff(ends[at[a : b + 1] - at[a]])


def encoder(path: str, drop_space: bool = False) -> Encoder:
    """This worker's encoder, until another stage begins."""
    return per_stage((path, drop_space), lambda: Encoder(path, drop_space))


def text_slices(texts, most: int = 1 << 20):
    """(from, to) runs of about ``most`` characters (of an Arrow array: bytes),
    one text at least."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy() if isinstance(texts, pa.Array) else np.fromiter((len(t or "") for t in texts), np.int64, len(texts))
    ends, i = np.cumsum(sizes, dtype=np.int64), 0
    while i < len(ends):
        before = ends[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(ends, before + most, "right")))
        yield i, j
        i = j
