"""Blank-separated pieces of text, each encoded by the tokenizers library once and remembered."""

from __future__ import annotations

import os
import re
from array import array
from operator import attrgetter

_LOADED: dict = {}


def load(path: str):
    """The tokenizer of a file, once per Python worker, on one thread, without truncation and padding."""
    if path not in _LOADED:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.no_truncation()
        tok.no_padding()
        _LOADED[path] = tok
    return _LOADED[path]


def byte_signs() -> list[str]:
    """The visible sign that byte-level tokenizers write for each byte: itself, or the next free sign from 256 on."""
    signs, free = [], 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174:
            signs.append(chr(b))
        else:
            signs.append(chr(free))
            free += 1
    return signs


_SIGNS = dict(enumerate(byte_signs()))
#: ASCII marks. A run of them behind letters is a pre-token by itself.
_MARKS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum())
_id, _value = attrgetter("id"), attrgetter("value")


class PieceMemo:
    """piece -> ids (bytes of little-endian unsigned 32-bit integers), bounded in entries.

    ``lead`` is put before every piece when it is encoded ("" or one blank). Letters with marks behind them, alone or
    twice with a line end between, go straight to the tokenizer's BPE model, letters and marks apart; every other
    piece goes through the whole tokenizer. ``lower`` says that the tokenizer's normalizer folds case, ``decoded``
    that the pieces' decoded texts are kept too.

    Entries live in two generations: when the younger holds half of ``most``, it becomes the older one, whose entries
    come back when they are asked for and are dropped else, so frequent pieces are not learnt again.
    """

    def __init__(self, path: str, lead: str = "", most: int = 400_000, lower: bool = False, decoded: bool = False):
        self.tok, self.lead, self.most, self.lower, self.decoded = load(path), lead, most, lower, decoded
        self.tokenize = self.tok.model.tokenize
        self.line_end = not lower  # a tokenizer that folds case here also drops white space
        self.ids: dict[str, bytes] = {}
        self.texts: dict[str, bytes] = {}
        self.older: tuple[dict, dict] = ({}, {})
        self.bare: dict[str, tuple[bytes, bytes]] = {}  # pre-tokens that stand without the lead

    def _encode(self, part: str) -> tuple[bytes, bytes]:
        """Ids and decoded text of one pre-token."""
        if not part.isascii():
            part = part.encode().decode("latin-1").translate(_SIGNS)
        elif part[0] <= " ":
            part = _SIGNS[ord(part[0])] + part[1:]
        tokens = self.tokenize(part)
        return array("I", map(_id, tokens)).tobytes(), " ".join(map(_value, tokens)).encode() if self.decoded else b""

    def _bare(self, part: str) -> tuple[bytes, bytes]:
        got = self.bare.get(part)
        if got is None:
            if len(self.bare) > self.most // 4:
                self.bare.clear()
            got = self.bare[part] = self._encode(part)
        return got

    def learn(self, pieces: set[str]) -> None:
        """Make every one of the pieces known. Entries are dropped only here, before a batch is encoded."""
        new = pieces.difference(self.ids)
        if not new:
            return
        if len(self.ids) + len(new) > self.most // 2 and self.ids:
            self.older, self.ids, self.texts, new = (self.ids, self.texts), {}, {}, pieces
        ids, texts, lead, decoded, encode, bare = self.ids, self.texts, self.lead, self.decoded, self._encode, self._bare
        old_ids, old_texts = self.older

        def known(word: str) -> bytes:
            """Ids of a word behind the lead; the word is learnt as a piece."""
            got = ids.get(word)
            if got is None:
                got = old_ids.get(word)
                if got is None:
                    got, text = encode(lead + word)
                else:
                    text = old_texts[word] if decoded else b""
                ids[word] = got
                if decoded:
                    texts[word] = text
            return got

        odd = []
        for p in new:
            got = old_ids.get(p)
            if got is not None:
                ids[p] = got
                if decoded:
                    texts[p] = old_texts[p]
                continue
            word = p.lower() if self.lower else p
            if _letters(word):
                ids[p] = known(word)
                if decoded:
                    texts[p] = texts[word]
                continue
            head, below, last = word.partition("\n")
            first, second = head.rstrip(_MARKS), last.rstrip(_MARKS)
            if not _letters(first) or below and not _letters(second):
                odd.append(p)
                continue
            got = [known(first)]
            text = [texts[first]] if decoded else None
            rest = [head[len(first) :]] if len(first) < len(head) else []
            if below:
                rest += ["\n", second] if self.line_end else [second]
                if len(second) < len(last):
                    rest.append(last[len(second) :])
            for x in rest:
                i, t = bare(x)
                got.append(i)
                if decoded:
                    text.append(t)
            ids[p] = b"".join(got)
            if decoded:
                texts[p] = b" ".join(text)
        for i in range(0, len(odd), 5000):
            part = odd[i : i + 5000]
            for p, e in zip(part, self.tok.encode_batch_fast([lead + p for p in part], add_special_tokens=False), strict=True):
                ids[p] = array("I", e.ids).tobytes()
                if decoded:
                    texts[p] = self.tok.decode(e.ids, skip_special_tokens=False).encode()


def _letters(word: str) -> bool:
    """ASCII or Latin-1 letters alone; what is outside goes through the whole tokenizer."""
    return word.isalpha() and (word.isascii() or _LATIN(word) is not None)


_LATIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+").fullmatch
_CUT = re.compile(r"(?<=\S)(?= )")


def spaced_pieces(text: str) -> tuple[str, list[str]]:
    """Cut a text for a byte-level BPE at blanks: the first piece as it is, the others without their leading blank.

    A cut before a single blank never changes the pattern's matches: a run of letters, digits or marks ends there
    and the blank belongs to what follows. In runs of blanks only the place after a visible character is cut.
    """
    if "  " not in text:
        first, *rest = text.split(" ")
        return first, rest
    first, *rest = _CUT.split(text)
    return first, [p[1:] for p in rest]
