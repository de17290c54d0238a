"""Byte-pair encoding by chunks that no token crosses, each encoded once and remembered."""

from __future__ import annotations

import json
import re
from array import array

import numpy as np

from webgrain.llm.common import tokenizer_path

#: So many chunks a generation, of which there are two, are remembered a worker (about 80 MB each); longer ones are encoded anew each time.
KEPT, LONG = 400_000, 64

_LOADED: dict[str, ChunkEncoder] = {}


#: A word and the ASCII punctuation after it; both pre-tokenisers cut between the two.
_TAIL = re.compile(r"([^\W_]+)([!-&(-/:-@\[-`{-~]+)").fullmatch
#: Words that both pre-tokenisers leave whole and whose lower case is the same everywhere.
_LATIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+").fullmatch
#: The byte alphabet of both vocabularies: printable bytes stand for themselves, the others follow from 256 on.
_SELF = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTES = dict(zip([b for b in range(256) if b not in _SELF], range(256, 512), strict=False))
_WIDE_SPACES = "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


class ChunkEncoder:
    """Ids of whole texts by the tokenizers library, without special tokens added.

    A text is cut where both supported pre-tokenisers end a token: at white space
    between two other characters, and between a word and punctuation. So the ids of the
    text are the ids of its chunks in order; the tests hold this against the library.
    Texts with white space in a row (where spaces belong to tokens), or with the string
    of a special token, go to the library in one piece. Distinct chunks are
    encoded once while they are remembered: a full table becomes the old generation, from
    which chunks that come again are taken over, and the older one goes. So the memory is
    bounded and the frequent chunks stay.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        #: Whether a space belongs to the token that follows it; else white space is dropped and case folded.
        self.keeps_space = '"use_regex": true' in json.dumps(spec["pre_tokenizer"])
        self.marks = [t["content"] for t in spec["added_tokens"]] + list("\x1c\x1d\x1e\x1f")
        if self.keeps_space:
            self.marks += list("\t\r\x0b\x0c")
        #: Ids by chunk behind a space, or by line end and chunk; and the generation before.
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        #: A string of one token of its own that no chunk holds, and its id.
        self.apart = "\n" if self.keeps_space else spec["added_tokens"][0]["content"]
        (self.apart_id,) = self.tokenizer.encode(self.apart, add_special_tokens=False).ids
        self.long: list[str] = []

    def whole(self, text: str) -> bool:
        """Whether a text isn't words with one space or line end between them, or holds a special token."""
        if any(m in text for m in self.marks):
            return True
        if not self.keeps_space:
            return False
        return not text.isascii() and any(c in text for c in _WIDE_SPACES) or len(text.split()) != text.count(" ") + text.count("\n") + 1

    def library(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32).tobytes()

    def latin(self, words: list[str], lead: str) -> list[bytes]:
        """The ids of words of Latin letters behind a lead, by the vocabulary's merges alone."""
        tokenize, before = self.model.tokenize, (lead if self.keeps_space else "").replace(" ", chr(_BYTES[32]))
        pieces = words if self.keeps_space else map(str.lower, words)
        return [array("I", [t.id for t in tokenize(before + (p if p.isascii() else p.encode().decode("latin-1").translate(_BYTES)))]).tobytes() for p in pieces]

    def fresh(self, chunks: list[str], lead: str) -> list[bytes]:
        """The ids of each chunk behind a lead: words by the merges, the others in one call that is cut at a token between them."""
        out = [b""] * len(chunks)
        plain = [i for i, c in enumerate(chunks) if _LATIN(c)]
        for i, ids in zip(plain, self.latin([chunks[i] for i in plain], lead), strict=True):
            out[i] = ids
        if len(plain) < len(chunks):
            left = [i for i, c in enumerate(chunks) if not out[i]]
            for i, ids in zip(left, self.together([chunks[i] for i in left], lead), strict=True):
                out[i] = ids
        return out

    def together(self, chunks: list[str], lead: str) -> list[bytes]:
        mark = self.apart + lead
        (got,) = self.tokenizer.encode_batch_fast([mark + mark.join(chunks)], add_special_tokens=False)
        ids = np.asarray(got.ids, np.uint32)
        at = 4 * np.flatnonzero(ids == self.apart_id)
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip((at + 4).tolist(), [*at[1:].tolist(), len(raw)], strict=True)]

    def missing(self, chunks: set[str]) -> list[str]:
        """The chunks that neither generation knows; those that only the old one knows are taken over."""
        known, before = self.known, self.before
        out = [c for c in chunks if c not in known]
        if not before:
            return out
        known.update((c, before[c]) for c in out if c in before)
        return [c for c in out if c not in before]

    def learn(self, chunks: set[str]) -> None:
        """Learn chunks behind a space, and those that begin with a line end."""
        missing = self.missing(chunks)
        lined = [c for c in missing if c[0] == "\n"]
        if lined:
            end = np.uint32(self.apart_id).tobytes()
            self.known.update((c, end + ids) for c, ids in zip(lined, self.fresh([c[1:] for c in lined], ""), strict=True))
            missing = [c for c in missing if c[0] != "\n"]
        if missing:
            self.known.update(zip(missing, self.fresh(missing, " "), strict=True))
        self.long += [c for c in (*lined, *missing) if len(c) > LONG]

    def fill(self, words: set[str]) -> None:
        """Learn words, those behind a space from their stems and punctuation where they have both."""
        missing = self.missing(words)
        tails = [(w, m[1], m[2]) for w in missing if (m := _TAIL(w))]
        apart = {w for w, _, _ in tails}
        # Where a space belongs to the token behind it, punctuation without one is taken from behind a line end.
        lead, skip = ("\n", 4) if self.keeps_space else ("", 0)
        self.learn({w for w in missing if w not in apart} | {s for _, s, _ in tails} | {lead + p for _, _, p in tails})
        known = self.known
        after = {p: known[lead + p][skip:] for p in {p for _, _, p in tails}}
        known.update((w, known[stem] + after[p]) for w, stem, p in tails)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text, one after another; null is the empty text."""
        out, at, held = [b""] * len(texts), [], 0
        for i, text in enumerate(texts):
            if not text:
                continue
            if self.whole(text):
                out[i] = self.library(text)
                continue
            at.append(i)
            held += len(text)
            if held > 2_000_000:
                self.several(texts, at, out)
                at, held = [], 0
        self.several(texts, at, out)
        return out

    def several(self, texts: list[str | None], at: list[int], out: list[bytes]) -> None:
        if not self.keeps_space:
            # Of bytes, only ASCII letters become lower case; the library folds the others.
            cut = [texts[i].encode().lower().decode().split() for i in at]
        else:
            # The first word of a line keeps the line end before it; the text's first word gets one, whose id is cut off.
            cut = [("\n" + texts[i].replace("\n", " \n")).split(" ") for i in at]
        self.fill(set().union(*cut))
        known, skip = self.known.__getitem__, 4 * self.keeps_space
        for i, words in zip(at, cut, strict=True):
            out[i] = b"".join(map(known, words))[skip:]
        for chunk in self.long:
            self.known.pop(chunk, None)
        self.long.clear()
        if len(self.known) > KEPT:
            self.known, self.before = {}, self.known


def encoder(name: str) -> ChunkEncoder:
    """One encoder a worker and vocabulary (``byte_bpe_50k.json`` or ``word_bpe_49k.json``, or a path to one)."""
    path = tokenizer_path(name)
    if path not in _LOADED:
        _LOADED[path] = ChunkEncoder(path)
    return _LOADED[path]
