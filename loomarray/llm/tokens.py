"""Tokenizer access for Arrow functions: safe boundaries, balanced batches, memoised pieces.

A *safe boundary* is a place where a text may be cut so that the ids of the parts, put together,
are the ids of the whole.  Both kinds below hold for any text, special strings in it included:

* byte-level BPE cuts a text by a pattern whose matches never continue from a character that is
  not white space into white space, and that looks ahead only inside white space.  So a text may
  be cut before any white space that follows something else.
* word BPE drops white space, and none of its matches spans any.  So a text may be cut at any
  run of ASCII white space, which then need not be kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain, filterfalse

import numpy as np

from loomarray.llm.common import RELEASE

#: Unicode's White_Space property.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PIECE = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
#: Marks that compose with ASCII letters; a comma or full stop at the end of a word.
MARK, STOP = re.compile("[\u0300-\u036f]"), re.compile(rb"(?<=[a-z])(?=[,.] )")
#: At most so many pieces, of so many bytes with their ids, are remembered in a worker; the others are encoded
#: each time they occur.
MEMO, MEMO_BYTES = 1_600_000, 96 << 20
#: Texts longer than this are cut at safe boundaries, and about so much is encoded in one call.
SEGMENT_CHARS, CALL_CHARS = 1 << 15, 1 << 18

_loaded: dict = {}
RELEASE.append(_loaded.clear)


def tokenizer(path: str):
    """The tokenizer of a `.json` file, loaded once in each process."""
    if path not in _loaded:
        import os

        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        tok = Tokenizer.from_file(path)
        tok.no_truncation()
        tok.no_padding()
        _loaded[path] = tok
    return _loaded[path]


def drops_white_space(path: str) -> bool:
    """Whether the file is of the word kind, told from its behaviour."""
    key = ("drops", path)
    if key not in _loaded:
        tok = tokenizer(path)
        ids = lambda s: tok.encode(s, add_special_tokens=False).ids
        _loaded[key] = ids("ab \n cd") == ids("ab") + ids("cd") and not ids(" \n\t ")
    return _loaded[key]


def breaks_at_white_space(path: str) -> bool:
    """Whether a text may be cut before white space that follows something else, told from its behaviour."""
    key = ("breaks", path)
    if key not in _loaded:
        ids = lambda s: tokenizer(path).encode(s, add_special_tokens=False).ids
        parts = [["ab", " cd", " ef"], ["don't", "\n\n stop"], ["x1", "\t y", "  z."], ["a,", " b", "\u3000c", "\x85d"], ["The", " the", " of"]]
        _loaded[key] = all(ids("".join(p)) == [i for x in p for i in ids(x)] for p in parts)
    return _loaded[key]


def lowers_and_parts(path: str) -> bool:
    """Whether ASCII letters count as their lower case, and a comma or full stop after one is a piece of its
    own, told from its behaviour."""
    key = ("lowers", path)
    if key not in _loaded:
        ids = lambda s: tokenizer(path).encode(s, add_special_tokens=False).ids
        letters = "abcdefghijklmnopqrstuvwxyz"
        lowers = all(ids(c.upper()) == ids(c) and ids("x" + c.upper() + "y") == ids("x" + c + "y") for c in letters)
        stops = all(ids(f"a{c}{s} {c}b") == ids("a" + c) + ids(s) + ids(c + "b") for c in letters for s in ",.")
        _loaded[key] = lowers and stops
    return _loaded[key]


def opening(path: str) -> np.ndarray:
    """For each id of a byte-level vocabulary, whether its text begins with a space."""
    key = ("opens", path)
    if key not in _loaded:
        vocabulary = tokenizer(path).get_vocab(with_added_tokens=True)
        opens = np.zeros(max(vocabulary.values()) + 1, bool)
        opens[[i for token, i in vocabulary.items() if token.startswith(("\u0120", " "))]] = True  # byte-level alphabets write a space so
        _loaded[key] = opens
    return _loaded[key]


def special_strings(path: str) -> list[str]:
    """Strings that stand for one id wherever they occur."""
    return [t.content for t in tokenizer(path).get_added_tokens_decoder().values() if t.content]


def cut(text: str, most: int = SEGMENT_CHARS) -> Iterator[str]:
    """Parts of about `most` characters, cut only before white space that follows something else.

    A text without such a place stays whole.
    """
    at = 0
    while len(text) - at > most:
        found = CUT.search(text, at + most)
        if not found:
            break
        yield text[at : found.start() + 1]
        at = found.start() + 1
    yield text[at:]


CUT = re.compile(f"[^{WHITE}](?=[{WHITE}])")
#: White space by which a text is not simply split: other than spaces and lines' ends, or with a space after it.
MIXED = re.compile("[\t\x0b-\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]|[ \n] ")


class Lengths:
    """Token counts by the library's batch call: long texts cut where the tokenizer's behaviour allows it, calls balanced by size."""

    def __init__(self, path: str):
        self.path = path
        if path.endswith(".model"):
            import sentencepiece

            sp = _loaded.setdefault(path, None) or sentencepiece.SentencePieceProcessor(model_file=path)
            _loaded[path] = sp
            # white space inside a piece, or no mark before the first word: then nothing may be cut
            inner = any("▁" in sp.id_to_piece(i).lstrip("▁") for i in range(sp.get_piece_size()))
            whole = inner or sp.encode("ab cd") != sp.encode("ab") + sp.encode("cd")
            self.parts = (lambda s: [s]) if whole else cut_words
            self.count = lambda xs: [len(x) for x in sp.encode(xs, num_threads=1, add_bos=False, add_eos=False)]
        else:
            tok = tokenizer(path)
            spaced = any(re.search(f"[{WHITE}]", s) for s in special_strings(path))
            safe = not spaced and (breaks_at_white_space(path) or drops_white_space(path))
            self.parts = cut if safe else lambda s: [s]
            self.count = lambda xs: [len(x) for x in tok.encode_batch_fast(xs, add_special_tokens=False)]

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros(len(texts), np.int64)
        call, owners, chars = [], [], 0

        def flush():
            nonlocal call, owners, chars
            np.add.at(out, owners, self.count(call))
            call, owners, chars = [], [], 0

        for i, text in enumerate(texts):
            for part in self.parts(text) if len(text) > SEGMENT_CHARS else (text,):
                if part:
                    call.append(part)
                    owners.append(i)
                    chars += len(part)
                    if chars >= CALL_CHARS:
                        flush()
        if call:
            flush()
        return out


def cut_words(text: str, most: int = SEGMENT_CHARS) -> Iterator[str]:
    """For models that put a mark before each word: cut at a lone space between letters, and drop it."""
    at = 0
    while len(text) - at > most:
        found = LONE.search(text, at + most)
        if not found:
            break
        yield text[at : found.start() + 1]
        at = found.start() + 2
    yield text[at:]


LONE = re.compile("[a-z](?= [a-z])")


class Ids:
    """Whole texts to bytes of little-endian ids, through a memo of the pieces between safe boundaries."""

    def __init__(self, path: str, dtype: str = "<u4"):
        self.tok, self.dtype = tokenizer(path), dtype
        special = special_strings(path)
        spaced = any(re.search(f"[{WHITE}]", s) for s in special)  # then no white space is a safe place
        self.words = drops_white_space(path) and not spaced
        self.lowers = self.words and lowers_and_parts(path)
        self.breaks = not spaced and breaks_at_white_space(path)
        self.special = [s.lower().encode() for s in special]
        self.opens = opening(path) if self.breaks and not self.words else None
        self.memo, self.held = _loaded.setdefault(("memo", path, dtype), ({}, [0]))

    def pieces(self, text: str) -> list:
        if not self.words:
            return PIECE.findall(text) if self.breaks else [text] if text else []
        data = text.encode()
        if not self.lowers:
            return data.split()
        # The library lowers letters and parts them from other signs; doing both first makes pieces
        # recur.  Not where that could touch a special string, or a letter that a mark composes with.
        lower = data.lower()
        if any(s in lower for s in self.special) or not (text.isascii() or MARK.search(text) is None):
            return data.split()
        return STOP.sub(b" ", lower).split()

    def keys(self, text: str) -> list[str]:
        """Pieces of a text that may be cut before white space, by a split at its spaces.

        A key that begins with a space stands for what follows, one that begins with a line's end for
        itself, any other for a space and itself.
        """
        spaced = text.replace("\n", " \n").replace("\n \n", "\n\n")
        if MIXED.search(spaced):
            plain = lambda x: x if x[0] == "\n" else x[1:] if x[0] == " " and x[1:2] not in ("", " ", "\n") else " " + x
            return [plain(x) for x in PIECE.findall(text)]
        out = spaced.split(" ")
        if out[0]:
            out[0] = " " + out[0]
            return out
        return out[1:]

    def encoded(self, keys: list[str]) -> dict[str, bytes]:
        """Ids of keys: words after a space in one text, whose ids are parted where one begins with a space."""
        joins = lambda k: k and k[0] not in " \n" and " " not in k and not k[-1].isspace()
        words, others = [k for k in keys if joins(k)], [k for k in keys if not joins(k)]
        out = {}
        for k in range(0, len(words), 1024):
            some = words[k : k + 1024]
            ids = np.array(self.tok.encode_batch_fast([" " + " ".join(some)], add_special_tokens=False)[0].ids, self.dtype)
            at = np.flatnonzero(self.opens[ids])
            if len(at) != len(some) or at[0]:  # the library takes spaces together with something else
                others += some
                continue
            data, step = ids.tobytes(), ids.itemsize
            ends = [*(at[1:] * step).tolist(), len(data)]
            out.update(zip(some, [data[a:b] for a, b in zip((at * step).tolist(), ends, strict=True)], strict=True))
        for k in range(0, len(others), 8192):
            some = others[k : k + 8192]
            found = self.tok.encode_batch_fast([x[1:] if x[:1] == " " else x if x[:1] == "\n" else " " + x for x in some], add_special_tokens=False)
            out.update((x, np.array(y.ids, self.dtype).tobytes()) for x, y in zip(some, found, strict=True))
        return out

    def by_spaces(self, texts: list[str]) -> list[bytes]:
        cut_up = [self.keys(x) for x in texts]
        flat = list(chain.from_iterable(cut_up))
        memo = self.memo
        data = list(map(memo.get, flat))
        missing = [k for k, x in enumerate(data) if x is None]
        if missing:
            fresh = self.encoded(list({flat[k] for k in missing}))
            for k in missing:
                data[k] = fresh[flat[k]]
            size = sum(map(len, fresh)) + sum(map(len, fresh.values()))
            if len(memo) + len(fresh) <= MEMO and self.held[0] + size <= MEMO_BYTES:
                memo.update(fresh)
                self.held[0] += size
        ends = np.cumsum([0, *map(len, cut_up)]).tolist()
        return [b"".join(data[a:b]) for a, b in zip(ends, ends[1:], strict=False)]

    def __call__(self, texts: list[str]) -> list[bytes]:
        if self.opens is not None:
            return self.by_spaces(texts)
        cut_up = [self.pieces(x) for x in texts]
        memo = self.memo
        new = list(set(filterfalse(memo.__contains__, chain.from_iterable(cut_up))))
        look = memo
        if new:
            fresh = {}
            for k in range(0, len(new), 8192):
                some = new[k : k + 8192]
                found = self.tok.encode_batch_fast([x.decode() for x in some] if self.words else some, add_special_tokens=False)
                flat = [x.ids for x in found]
                sizes = np.fromiter(map(len, flat), np.int64, len(flat)) * np.dtype(self.dtype).itemsize
                data = np.fromiter(chain.from_iterable(flat), self.dtype).tobytes()
                ends = np.cumsum(sizes).tolist()
                fresh.update((p, data[e - n : e]) for p, e, n in zip(some, ends, sizes.tolist(), strict=True))
            size = sum(map(len, fresh)) + sum(map(len, fresh.values()))
            if len(memo) + len(fresh) <= MEMO and self.held[0] + size <= MEMO_BYTES:
                memo.update(fresh)
                self.held[0] += size
            else:
                look = Layered(memo, fresh)
        get = look.__getitem__
        return [b"".join(map(get, x)) for x in cut_up]


class Layered:
    def __init__(self, first: dict, second: dict):
        self.first, self.second = first, second

    def __getitem__(self, key):
        found = self.first.get(key)
        return self.second[key] if found is None else found
