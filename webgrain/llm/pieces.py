"""SentencePiece encoding and decoding with a table of last tokens.

For every prefix of a text, byte-pair encoding leaves exactly one last token. An
Aho-Corasick automaton over the vocabulary gives the tokens that end at a position;
the last token there is the one that is compatible with the last token of the prefix
before it, and the ids follow from the end backwards. Two tokens are compatible if
encoding their joined text gives the two again, so the test is made once a pair. The
work is linear in the text, however long a run without spaces is.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from webgrain.llm.common import map_rows, pick, tokenizer_path

#: So many chunks and token pairs are remembered a worker; longer chunks never are.
KEPT_CHUNKS, KEPT_PAIRS, LONG = 400_000, 300_000, 64

SPACE = "▁"
_LOADED: dict[str, PieceCodec] = {}


class PieceCodec:
    """Encodes and decodes as the sentencepiece library does with a byte-pair model: a dummy space in front, white
    space kept, unknown characters as bytes. No begin or end ids, no sampling.

    A piece has the space mark only in front or is made of it alone, so no token crosses
    from another character to a space mark; texts are cut there, and each distinct chunk
    is encoded once a worker.
    """

    def __init__(self, path: str):
        import ahocorasick
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        self.unknown = model.unk_id()
        self.text: list[str] = []
        self.bytes: dict[int, int] = {}
        self.rank: dict[str, float] = {}
        self.matches = ahocorasick.Automaton()
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
                self.text.append("")
            elif model.is_control(i) or model.is_unknown(i):
                self.text.append(" ⁇ " if i == self.unknown else "")
            else:
                self.text.append(piece)
                self.rank[piece] = model.get_score(i)
                self.matches.add_word(piece, (len(piece), i))
        self.matches.make_automaton()
        # What this class assumes of a model: no normalisation but the dummy space, and all pieces made by merges.
        for probe in ("ﬁ x  y ", " A\u00a0e\u0301 ", "\t①\n"):
            if model.normalize(probe) != SPACE + probe.replace(" ", SPACE):
                raise ValueError(f"{path}: models that normalise texts are not supported")
        if any(model.is_unused(i) for i in range(model.get_piece_size())):
            raise ValueError(f"{path}: models with unused pieces are not supported")
        #: Neighbouring characters that some token holds; no token crosses between any others.
        self.held = {p[i : i + 2] for p in self.rank for i in range(len(p) - 1)}
        self.parts: dict[str, tuple[int, str, str]] = {}
        self.size = [len(t) for t in self.text]
        self.of_byte = {i: b for b, i in self.bytes.items()}
        self.fits: dict[int, bool] = {}
        self.known: dict[str, tuple[int, str, str]] = {}
        self.cut = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+").findall

    def merged(self, text: str) -> list[str]:
        """Byte-pair merges of a short text: the best-scored pair first, the leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.rank.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, left: int, right: int) -> bool:
        key = left << 32 | right
        found = self.fits.get(key)
        if found is None:
            if len(self.fits) >= KEPT_PAIRS:
                self.fits.clear()
            a, b = self.text[left], self.text[right]
            found = self.fits[key] = self.merged(a + b) == [a, b]
        return found

    def encode_chunk(self, chunk: str) -> list[int]:
        """Ids of a chunk in which spaces are marks. -1-c stands for an unknown character c in the table."""
        n = len(chunk)
        none = -1 - 0x110000
        last, done, fits = [none] * n, -1, self.fits
        # Matches come by their end, the longest first; the one that is compatible with the token before it is the last token there.
        for end, (size, token) in self.matches.iter(chunk):
            if last[end] != none:
                continue
            while done < end - 1:
                done += 1
                if last[done] == none:
                    last[done] = -1 - ord(chunk[done])
            if size > end:
                last[end] = token
            else:
                before = last[end - size]
                if before < 0:
                    last[end] = token
                else:
                    fit = fits.get(before << 32 | token)
                    if fit or (fit is None and self.compatible(before, token)):
                        last[end] = token
        for at in range(n):
            if last[at] == none:
                last[at] = -1 - ord(chunk[at])
        out: list[int] = []
        i = n - 1
        while i >= 0:
            token = last[i]
            if token < 0:
                out.extend([self.bytes[b] for b in reversed(chr(-1 - token).encode())])
                i -= 1
            else:
                out.append(token)
                i -= self.size[token]
        out.reverse()
        return out

    def chunks(self, text: str | None) -> list[str]:
        return self.cut(SPACE + text.replace(" ", SPACE)) if text else []

    def encode(self, text: str | None) -> list[int]:
        return [i for c in self.chunks(text) for i in self.encode_chunk(c)]

    def decode(self, ids: list[int]) -> str:
        """Text of ids; bytes in a row are read as UTF-8, each byte that fits nowhere becomes U+FFFD."""
        return self.unmarked(self.decode_marked(ids))

    def decode_marked(self, ids: list[int]) -> str:
        parts = [self.text[i] for i in ids]
        if all(parts):
            return "".join(parts)
        parts = []
        raw = bytearray()
        for i in ids:
            byte = self.of_byte.get(i)
            if byte is None:
                if raw:
                    parts.append(_utf8(raw))
                    raw.clear()
                parts.append(self.text[i])
            else:
                raw.append(byte)
        if raw:
            parts.append(_utf8(raw))
        return "".join(parts)

    @staticmethod
    def unmarked(marked: str) -> str:
        return marked.replace(SPACE, " ")[marked[:1] == SPACE :]

    def entry(self, chunk: str) -> tuple[int, str, str]:
        """Of a chunk: how many ids, the ids as text, and what they decode to. It is cut where no token crosses, so a word before a comma is known from elsewhere."""
        held = self.held
        cuts = [i for i in range(1, len(chunk)) if chunk[i - 1 : i + 1] not in held]
        if not cuts:
            return self.part(chunk)
        found = [self.part(chunk[a:b]) for a, b in zip([0, *cuts], [*cuts, len(chunk)], strict=True)]
        return sum(f[0] for f in found), ",".join([f[1] for f in found]), "".join([f[2] for f in found])

    def part(self, chunk: str) -> tuple[int, str, str]:
        found = self.parts.get(chunk)
        if found is None:
            ids = self.encode_chunk(chunk)
            found = len(ids), ",".join(map(str, ids)), self.decode_marked(ids)
            if len(chunk) <= LONG:
                if len(self.parts) >= KEPT_CHUNKS:
                    self.parts.clear()
                self.parts[chunk] = found
        return found

    def entries(self, text: str | None) -> list[tuple[int, str, str]]:
        """The entries of a text's chunks. Where single spaces alone part the words, a chunk is a mark and a word."""
        if not text:
            return []
        if SPACE in text or "  " in text or text[-1] == " " or text[0] == " ":
            return [self.known.get(c) or self.learnt(c) for c in (c[1:] if c[0] == SPACE and c[1:2] != SPACE else "  " + c for c in self.chunks(text))]
        known = self.known
        return [known.get(word) or self.learnt(word) for word in text.split(" ")]

    def learnt(self, key: str) -> tuple[int, str, str]:
        """Remember a chunk's entry. The key is the chunk without its mark; one that has none, or several, has two spaces in front."""
        found = self.entry(key[2:] if key[:2] == "  " else SPACE + key)
        if len(key) <= LONG:
            if len(self.known) >= KEPT_CHUNKS:
                self.known.clear()
            self.known[key] = found
        return found


def _utf8(raw: bytes | bytearray) -> str:
    out, at = [], 0
    raw = bytes(raw)
    while at < len(raw):
        for size in (1, 2, 3, 4):
            try:
                out.append(raw[at : at + size].decode())
                at += size
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


def codec(name: str = "piece_bpe_32k.model") -> PieceCodec:
    path = tokenizer_path(name)
    if path not in _LOADED:
        _LOADED[path] = PieceCodec(path)
    return _LOADED[path]


def encode_pieces(df: DataFrame, text: str = "text", key: str = "doc_id", model: str = "piece_bpe_32k.model") -> DataFrame:
    """``key`` and ``ids`` of each row's whole text; null and empty texts have no ids. A null key stays null."""

    def start():
        c = codec(model)
        return lambda x: {"key": x["key"], "ids": [[int(i) for _, s, _ in c.entries(t) for i in s.split(",")] for t in x["text"]]}

    rows = pick(df, key=key, text=text)
    kind = rows.schema["key"].dataType.simpleString()
    return map_rows(rows, f"key {kind}, ids array<int>", start).withColumnRenamed("key", key)


def decode_pieces(df: DataFrame, ids: str = "ids", key: str = "doc_id", model: str = "piece_bpe_32k.model") -> DataFrame:
    """``key`` and ``text`` of each row's ids; null ids give the empty text."""

    def start():
        c = codec(model)
        return lambda x: {"key": x["key"], "text": [c.decode(i or []) for i in x["ids"]]}

    rows = pick(df, key=key, ids=ids)
    kind = rows.schema["key"].dataType.simpleString()
    return map_rows(rows, f"key {kind}, text string", start).withColumnRenamed("key", key)


def piece_digests(df: DataFrame, text: str = "text", key: str = "doc_id", model: str = "piece_bpe_32k.model") -> DataFrame:
    """Digests of each whole text's ids and of what they decode to, without keeping the ids.

    One row a row, repeated rows too. ``n_tokens`` counts all ids; ``ids_sha256`` is of the
    decimal ids joined by commas; ``decoded_sha256`` of the decoded text in UTF-8. Null
    texts are empty texts: no ids, digests of nothing.
    """

    def start():
        c = codec(model)

        def apply(x: dict[str, list]) -> dict[str, list]:
            n, ids, decoded = [], [], []
            for text in x["text"]:
                found = c.entries(text)
                n.append(sum(e[0] for e in found))
                ids.append(hashlib.sha256(",".join([e[1] for e in found]).encode()).hexdigest())
                decoded.append(hashlib.sha256(c.unmarked("".join([e[2] for e in found])).encode()).hexdigest())
            return {"key": x["key"], "n_tokens": n, "ids_sha256": ids, "decoded_sha256": decoded}

        return apply

    rows = pick(df, key=key, text=text)
    kind = rows.schema["key"].dataType
    assert isinstance(kind, T.DataType)
    return map_rows(rows, f"key {kind.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string", start).withColumnRenamed("key", key)
