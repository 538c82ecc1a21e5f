"""Exact BPE encoding by dynamic programming over prefixes, and decoding.

The encoding of every prefix of a word ends in exactly one token.  An automaton with suffix links
over the vocabulary gives, for each prefix, the tokens that are its suffixes; the right one is the
only one that is compatible with the last token of the prefix before it.  Two tokens are
compatible if no merge across their border would have come earlier than the merges that made
them.  Following the stored tokens backwards from the end of the word gives its ids.

Contract: null and empty texts have no ids and decode to the empty text.  Texts of any length are
read whole.  Repeated rows give repeated results; columns besides the text pass through.  Ids equal
the tokenizers library's for every character.  Its Unicode tables are not those of this Python: a
character that its splitting shows to be classed or composed differently has the text that holds it
split by the library.  Encoding is ours in any case.
"""

from __future__ import annotations

import json
import unicodedata

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from tableward.llm.common import map_texts

#: The byte-level splitting pattern that such tokenizers use where the file names none.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Lifts the last symbol of a word out of the way of the same byte inside words.
END = 0x1000
#: Entries a worker remembers before it starts afresh; decides speed and memory only.
REMEMBERED = 400_000


def byte_symbols() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class PrefixBpe:
    """A BPE tokenizer file, encoded by prefixes."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.symbols = byte_symbols()
        self.byte_of = {c: b for b, c in self.symbols.items()}
        self.library = Tokenizer.from_file(path)
        self.agreed: dict[str, bool] = {}
        self._read_steps(spec)
        self._read_merges(model["vocab"], model["merges"])
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        self.special_pattern = regex.compile("|".join(
            regex.escape(t) for t in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.text_of = {i: t for t, i in model["vocab"].items()} | {i: t for t, i in self.special.items()}
        self.joined_by_space = spec.get("decoder") is None
        self.pairs: dict[tuple[int, int], bool] = {}
        self.words: dict[str, tuple[int, ...]] = {}

    def _read_steps(self, spec: dict) -> None:
        steps = spec.get("normalizer")
        steps = [] if steps is None else steps.get("normalizers", [steps])
        kinds = [s["type"] for s in steps]
        if set(kinds) - {"NFC", "Replace", "Lowercase"}:
            raise ValueError(f"normalizers not supported: {kinds}")
        self.nfc, self.lower = "NFC" in kinds, "Lowercase" in kinds
        self.replace = [(regex.compile(s["pattern"]["Regex"]), s["content"]) for s in steps if s["type"] == "Replace"]
        before = spec["pre_tokenizer"]
        split = [s for s in before.get("pretokenizers", [before]) if s["type"] == "Split"]
        self.pattern = regex.compile(split[0]["pattern"]["Regex"] if split else BYTE_LEVEL_PATTERN)
        #: No piece holds white space, so texts may be cut at it.
        self.free_of_space = bool(split) and split[0]["behavior"] == "Removed" and split[0]["invert"]

    def _read_merges(self, vocab: dict[str, int], merges: list) -> None:
        """Number tokens by the order in which merges make them, single symbols first."""
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        made = {a + b for a, b in pairs} if not self.suffix else {a.removesuffix(self.suffix) + b for a, b in pairs}
        single = [t for t in vocab if t not in made and len(t.removesuffix(self.suffix) or t) == 1]
        self.order = {t: n for n, t in enumerate(single)}
        self.merge: dict[tuple[int, int], int] = {}
        self.parents: dict[int, tuple[int, int]] = {}
        for n, (a, b) in enumerate(pairs, len(single)):
            token = a + b
            if token in self.order:
                raise ValueError("two merges make one token")
            self.order[token] = n
            self.merge[self.order[a], self.order[b]] = n
            self.parents[n] = (self.order[a], self.order[b])
        self.ids = {n: vocab[t] for t, n in self.order.items()}
        self.right = {n: self._spine(n, 1) for n in self.ids}
        self.left = {n: self._spine(n, 0) for n in self.ids}
        whole = set(range(len(single)))
        self.automaton = ahocorasick.Automaton()
        for token, n in self.order.items():
            if n >= len(single):
                a, b = self.parents[n]
                if a not in whole or b not in whole or not self._apart(a, b, own=n):
                    continue  # no text is encoded with it
                whole.add(n)
            key = self._lifted(token)
            self.automaton.add_word(key, (n, len(key)))
        self.automaton.make_automaton()

    def _lifted(self, token: str) -> str:
        if self.suffix and token.endswith(self.suffix) and token != self.suffix:
            token = token.removesuffix(self.suffix)
            return token[:-1] + chr(ord(token[-1]) + END)
        return token

    def _spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """Tokens at one border of ``token``, outermost first, with the merge that ends each."""
        found, ends = [], 1 << 60
        while True:
            found.append((token, ends))
            if token not in self.parents:
                return found
            token, ends = self.parents[token][side], token

    def _apart(self, a: int, b: int, own: int = -1) -> bool:
        """Whether no merge joins the border of ``a`` and ``b``; of equal merges the left comes first."""
        merge = self.merge.get
        for x, x_ends in self.right[a]:
            for y, y_ends in self.left[b]:
                n = merge((x, y))
                if n is not None and n != own and n < x_ends and n <= y_ends:
                    return False
        return True

    def compatible(self, a: int, b: int) -> bool:
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) > 4 * REMEMBERED:
                self.pairs.clear()
            known = self.pairs[a, b] = self._apart(a, b)
        return known

    def encode_word(self, word: str) -> tuple[int, ...]:
        """Ids of one piece of text."""
        known = self.words.get(word)
        if known is not None:
            return known
        symbols = self.symbols
        line = "".join([symbols[b] for b in word.encode("utf-8", "replace")])
        if self.suffix:
            line = line[:-1] + chr(ord(line[-1]) + END)
        last: list[tuple[int, int] | None] = [None] * len(line)
        for at, (token, size) in self.automaton.iter(line):
            if last[at] is None:
                before = at - size
                if before < 0 or last[before] is not None and self.compatible(last[before][0], token):
                    last[at] = (token, size)
        found, at = [], len(line) - 1
        while at >= 0:
            token, size = last[at]
            found.append(self.ids[token])
            at -= size
        ids = tuple(reversed(found))
        if len(word) <= 40:
            if len(self.words) > REMEMBERED:
                self.words.clear()
            self.words[word] = ids
        return ids

    def _plain(self, text: str) -> list[int]:
        encode = self.encode_word
        return [i for word in self.split(text) for i in encode(word)]

    def split(self, text: str) -> list[str]:
        if text.isascii() or all(map(self._agrees, set(text))):
            return self._own_split(text)
        return self._library_split(text)

    def _agrees(self, c: str) -> bool:
        """Whether both split texts alike that hold a character alone, among others and among marks."""
        known = self.agreed.get(c)
        if known is None:
            probe = f"{c} a{c}a {c}{c} 1{c}1 !{c}! a\u0301{c}\u0323"
            known = self.agreed[c] = c.isascii() or self._own_split(probe) == self._library_split(probe)
        return known

    def _library_split(self, text: str) -> list[str]:
        if self.library.normalizer is not None:
            text = self.library.normalizer.normalize_str(text)
        byte = self.byte_of
        return [bytes([byte[c] for c in piece]).decode() for piece, _ in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def _own_split(self, text: str) -> list[str]:
        if self.nfc and not text.isascii():
            text = unicodedata.normalize("NFC", text)
        if not self.free_of_space:
            for pattern, content in self.replace:
                text = pattern.sub(content, text)
        if self.lower:  # one character at a time: no rule looks at the neighbours
            text = text.lower() if text.isascii() else "".join([c.lower() for c in text])
        return self.pattern.findall(text)

    def encode(self, text: str) -> list[int]:
        """Ids of a text; the strings of special tokens in it become their ids."""
        if self.special_pattern is None:
            return self._plain(text)
        found, at = [], 0
        for m in self.special_pattern.finditer(text):
            found += self._plain(text[at:m.start()])
            found.append(self.special[m[0]])
            at = m.end()
        return found + self._plain(text[at:]) if at else self._plain(text)

    def decode(self, ids: list[int]) -> bytes:
        """UTF-8 bytes of the decoded text."""
        if self.joined_by_space:
            return " ".join([self.text_of[i] for i in ids]).encode()
        special, back = set(self.special.values()), self.byte_of
        raw = b"".join([self.text_of[i].encode() if i in special else bytes([back[c] for c in self.text_of[i]])
                        for i in ids])
        return raw.decode("utf-8", "replace").encode()


class Pieces(dict):
    """Remembers, for a run without white space, its packed ids and its decoded text."""

    def __init__(self, bpe: PrefixBpe):
        super().__init__()
        self.bpe = bpe

    def __missing__(self, run: bytes) -> tuple[bytes, bytes]:
        ids = self.bpe.encode(run.decode("utf-8", "replace"))
        found = (pack(ids), self.bpe.decode(ids))
        if len(run) <= 40:
            if len(self) > REMEMBERED:
                self.clear()
            self[run] = found
        return found


def pack(ids: list[int]) -> bytes:
    return b"".join([i.to_bytes(4, "little") for i in ids])


_LOADED: dict[str, Pieces] = {}


def _pieces(path: str) -> Pieces:
    if path not in _LOADED:
        _LOADED[path] = Pieces(PrefixBpe(path))
    return _LOADED[path]


def encode_decode(df: DataFrame, text: str, keep: list[str], path: str) -> DataFrame:
    """``keep`` plus ``ids`` (packed little-endian unsigned 32-bit) and ``decoded`` of each text."""

    def work(texts: list[bytes | None], pieces: Pieces) -> list[pa.Array]:
        ids, decoded = [], []
        for t in texts:
            if pieces.bpe.free_of_space and pieces.bpe.joined_by_space:
                # Cutting at ASCII white space changes no piece: none spans it, and no
                # composition of characters reaches over it.
                found = [pieces[run] for run in t.split()] if t else []
                ids.append(b"".join([f[0] for f in found]))
                decoded.append(b" ".join([f[1] for f in found if f[1]]))
            else:
                made = pieces.bpe.encode(t.decode("utf-8", "replace")) if t else []
                ids.append(pack(made))
                decoded.append(pieces.bpe.decode(made))
        return [pa.array(ids, pa.binary()), pa.array(decoded, pa.binary()).cast(pa.string())]

    return map_texts(df, text, keep, work, "ids binary, decoded string", setup=lambda: _pieces(path))
