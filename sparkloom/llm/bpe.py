"""Byte-pair encoding by backtracking, and decoding by an offset table.

Encoding: an Aho-Corasick automaton over all tokens lists, in one pass, every token that starts at each byte. From the
left the longest token is taken whose pair with the token before it is compatible; where none fits, the token before
is given up for its next shorter form, and the place is barred, so each place is tried once and the time is linear.
Two tokens are compatible if no merge across their border would come before the merges that build them; the answers
are kept in a table. A sequence whose neighbours are all compatible is the one that merging by rank gives.

Decoding: the bytes of all tokens stand in one array with their offsets; ids become ranges of it.

Defined results: null and empty texts give no ids and the digests of empty bytes; repeated rows are encoded one by
one; very long words are encoded in linear time; extra columns are passed over; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.frames import add_columns, documents, prepare

#: White space as Unicode has it (the pre-tokenizer's \s).
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Stretches that never share a pre-token: an optional blank with what follows it, or white space.
STRETCH = re.compile(rf" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
#: The pre-tokenizer's pattern, fixed by the vocabulary.
PIECE = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A stretch that is one pre-token for sure.
PLAIN = re.compile(r" ?[A-Za-z]+|\n")
#: Stretches whose ids are remembered by a worker, in two generations of this size.
REMEMBERED = 250_000


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 as it is, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class Bpe:
    """Encoder and decoder for a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str) -> None:
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"]
        if spec["normalizer"] or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"]:
            raise ValueError("only plain byte-level BPE is supported")
        self.piece = regex.compile(PIECE)
        byte_of = {c: b for b, c in enumerate(byte_letters())}
        vocab = spec["model"]["vocab"]
        raw = {t: bytes(map(byte_of.__getitem__, t)) for t in vocab if all(c in byte_of for c in t)}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.special_at = regex.compile("|".join(regex.escape(x) for x in sorted(self.special, key=len, reverse=True))) if self.special else None
        # time: when a token comes to be; halves: what it is merged from
        self.time = {vocab[t]: -1 for t, b in raw.items() if len(b) == 1}
        self.halves: dict[int, tuple[int, int]] = {}
        self.merge: dict[tuple[int, int], int] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            a, b, whole = vocab[left], vocab[right], vocab[left + right]
            self.merge.setdefault((a, b), rank)
            if whole not in self.halves and whole not in self.time:
                self.halves[whole], self.time[whole] = (a, b), rank
        size = max([*vocab.values(), *self.special.values()]) + 1
        text = [b""] * size
        for t, b in raw.items():
            text[vocab[t]] = b
        for t, i in self.special.items():
            text[i] = t.encode()
        self.length = np.array([len(x) for x in text])
        self.offset = np.concatenate(([0], np.cumsum(self.length)))[:-1]
        self.bytes = np.frombuffer(b"".join(text), np.uint8)
        self.find = ahocorasick.Automaton()
        for t, b in raw.items():
            if vocab[t] in self.time and self._builds_itself(vocab[t]):
                self.find.add_word(b.decode("latin-1"), (vocab[t], len(b)))
        self.find.make_automaton()
        self.fits: dict[int, bool] = {}
        self.sizes = self.length.tolist()
        self.shorter = [-1] * size  # the longest other token that a token begins with
        of_use = {text[i]: i for _, (i, _) in self.find.items()}
        for b, i in of_use.items():
            self.shorter[i] = next((of_use[b[:n]] for n in range(len(b) - 1, 0, -1) if b[:n] in of_use), -1)
        self.pieces = Known(lambda word: struct.pack(f"<{len(ids := self.encode_piece(word))}I", *ids))

    def _builds_itself(self, token: int) -> bool:
        """A token is of use if merging its bytes by rank gives it: then its halves are compatible until they merge."""
        return token not in self.halves or not self._crossed(*self.halves[token], self.time[token])

    def _crossed(self, a: int, b: int, until: float) -> bool:
        """Whether a merge across the border of a and b comes before time `until`, while both its parts stand there."""
        right_edge, end = [(a, until)], a
        while end in self.halves:
            t = self.time[end]
            end = self.halves[end][1]
            right_edge.append((end, t))
        left_edge, end = [(b, until)], b
        while end in self.halves:
            t = self.time[end]
            end = self.halves[end][0]
            left_edge.append((end, t))
        for x, x_gone in right_edge:
            for y, y_gone in left_edge:
                at = self.merge.get((x, y))
                # at equal rank the pair further left merges first
                if at is not None and at < x_gone and at <= y_gone and at < until:
                    return True
        return False

    def compatible(self, a: int, b: int) -> bool:
        key = a << 20 | b
        known = self.fits.get(key)
        if known is None:
            if len(self.fits) > 400_000:
                self.fits.clear()
            known = self.fits[key] = not self._crossed(a, b, float("inf"))
        return known

    def encode_piece(self, word: str) -> list[int]:
        """Ids of one pre-token, whose bytes are given as Latin-1 letters."""
        n = len(word)
        longest = [-1] * n
        for end, (token, size) in self.find.iter(word):
            longest[end - size + 1] = token  # longer ones come later, as they end later
        fits, sizes, shorter = self.fits, self.sizes, self.shorter
        out: list[int] = []
        barred = bytearray(n + 1)
        at, before, token = 0, -1, longest[0]
        while at < n:
            while token >= 0:
                to = at + sizes[token]
                if not barred[to]:
                    if before < 0:
                        break
                    ok = fits.get(before << 20 | token)
                    if ok is None:
                        ok = self.compatible(before, token)
                    if ok:
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                before, at = token, to
                if at < n:
                    token = longest[at]
            else:
                barred[at] = 1
                token = out.pop()  # single bytes are tokens, so there is one
                at -= sizes[token]
                token = shorter[token]
                before = out[-1] if out else -1
        return out

    def encode_stretch(self, stretch: str) -> bytes:
        word = stretch if stretch.isascii() else stretch.encode().decode("latin-1")
        if PLAIN.fullmatch(stretch):
            return self.pieces[word]
        if stretch.isascii():
            return b"".join(map(self.pieces.__getitem__, self.piece.findall(stretch)))
        return b"".join([self.pieces[p.encode().decode("latin-1")] for p in self.piece.findall(stretch)])

    def encode(self, text: str, known: Known) -> bytes:
        """Ids as little-endian 32-bit integers. Strings of special tokens become those tokens."""
        if self.special_at is None or "<" not in text or not self.special_at.search(text):
            return b"".join(map(known.__getitem__, STRETCH.findall(text)))
        out, at = [], 0
        for m in self.special_at.finditer(text):
            out += map(known.__getitem__, STRETCH.findall(text[at : m.start()]))
            out.append(np.array([self.special[m[0]]], "<u4").tobytes())
            at = m.end()
        out += map(known.__getitem__, STRETCH.findall(text[at:]))
        return b"".join(out)

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        if not len(ids):
            return b""
        size = self.length[ids]
        ends = np.cumsum(size)
        return self.bytes[np.repeat(self.offset[ids] - ends + size, size) + np.arange(ends[-1])].tobytes()

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


class Known(dict):
    """Ids of stretches seen lately: two generations, so that it stays bounded and keeps what comes often."""

    def __init__(self, make) -> None:
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, stretch: str) -> bytes:
        found = self.old.get(stretch)
        if found is None:
            found = self.make(stretch)
        if len(stretch) < 64:
            if len(self) >= REMEMBERED:
                self.old = dict(self)
                self.clear()
            self[stretch] = found
        return found


_held: dict[str, tuple[Bpe, Known]] = {}


def encoder(path: str) -> tuple[Bpe, Known]:
    """The worker's encoder for a vocabulary file, built once."""
    if path not in _held:
        bpe = Bpe(path)
        _held[path] = bpe, Known(bpe.encode_stretch)
    return _held[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


FIELDS = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_and_decode(docs: DataFrame, keep: list[str] | None = None, path: str | None = None, fields: str = FIELDS) -> DataFrame:
    """Each row of `docs` with FIELDS; with "ids array<long>, decoded string" as `fields`, the ids and text themselves."""
    prepare(docs.sparkSession)
    path = path or default_path()
    real = fields != FIELDS

    def make(texts):
        bpe, known = encoder(path)
        counts, ids_digest, text_digest, lists, decoded = [], [], [], [], []
        for text in texts.to_pylist():
            raw = bpe.encode(text or "", known)
            ids = np.frombuffer(raw, "<u4")
            back = bpe.decode_bytes(ids)
            if real:
                lists.append(ids.astype(np.int64))
                decoded.append(back.decode("utf-8", "replace"))
                continue
            counts.append(len(ids))
            ids_digest.append(hashlib.sha256(raw).hexdigest())
            try:
                str(back, "utf-8")
            except UnicodeDecodeError:
                back = back.decode("utf-8", "replace").encode()
            text_digest.append(hashlib.sha256(back).hexdigest())
        if real:
            return [pa.array(lists, pa.list_(pa.int64())), pa.array(decoded, pa.string())]
        return [pa.array(counts, pa.int64()), pa.array(ids_digest, pa.string()), pa.array(text_digest, pa.string())]

    return add_columns(docs, make, fields, keep)


def op9_bpe(spark, sf_dir: str) -> DataFrame:
    return encode_and_decode(documents(spark, sf_dir).select(F.col("doc_id").cast("long").alias("doc_id"), "text"), keep=["doc_id"])
