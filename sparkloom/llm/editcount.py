"""Token counts of edited texts without encoding them anew.

A document's pre-tokens and special tokens, with their lengths and token counts, are the leaves of a segment tree, in
blocks; inner nodes hold sums. An edit finds its place by descending the sums, cuts and encodes from an old border
before the touched characters on (as far before as the cut looks ahead) until the new cut meets an old border after
them, puts the new leaves in place and updates the sums on the way to the root. The count is the root's.

Defined results: null counts as the empty text; edits beyond the text are brought inside it; edits are applied in
order, each to the text that the one before left; strings of special tokens are those tokens, also where an edit makes
or breaks one; repeated rows are counted one by one; extra columns are passed over.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import bpe
from sparkloom.llm.frames import add_columns, documents, prepare
from sparkloom.session import written

#: Leaves of a block when a tree is built; a block that edits made larger than LARGE has the tree built anew.
BLOCK, LARGE = 64, 1024
#: Characters and tokens of one leaf.
PAIR = struct.Struct("<ii")


def leaves_of_stretches(encoder: bpe.Bpe) -> bpe.Known:
    """The leaves of stretches seen lately, as little-endian 32-bit pairs of characters and tokens."""

    def make(stretch: str) -> bytes:
        if bpe.PLAIN.fullmatch(stretch):
            return PAIR.pack(len(stretch), len(encoder.pieces[stretch]) // 4)
        return b"".join([PAIR.pack(len(p), _tokens(encoder, p)) for p in encoder.piece.findall(stretch)])

    return bpe.Known(make)


def _tokens(encoder: bpe.Bpe, piece: str) -> int:
    return len(encoder.pieces[piece if piece.isascii() else piece.encode().decode("latin-1")]) // 4


#: For a tree that is not built from its text.
_NO_LEAVES: dict[str, bytes] = {}


class SegmentTree:
    """Pre-tokens of one text: characters and tokens of each, with sums over blocks and over blocks of blocks."""

    def __init__(self, text: str, encoder: bpe.Bpe, leaves: bpe.Known | None = None) -> None:
        self.text, self.encoder = text, encoder
        self.special = encoder.special_at
        # a border stands if the characters up to here behind it do
        self.ahead = 1 + max(map(len, encoder.special), default=1)
        known = (leaves_of_stretches(encoder) if leaves is None else leaves).__getitem__
        out, at = [], 0
        for m in self.special.finditer(text) if self.special else ():
            out += map(known, bpe.STRETCH.findall(text[at : m.start()]))
            out.append(PAIR.pack(len(m[0]), 1))
            at = m.end()
        out += map(known, bpe.STRETCH.findall(text[at:] if at else text))
        pairs = np.frombuffer(b"".join(out), "<i4").reshape(-1, 2).astype(np.int64)
        self.encoded = len(pairs)
        self._build(pairs)

    def _build(self, leaves: np.ndarray) -> None:
        self.blocks = [leaves[i : i + BLOCK] for i in range(0, len(leaves), BLOCK)] or [leaves]
        n = 1 << (len(self.blocks) - 1).bit_length()
        self.sums = np.zeros((2 * n, 2), np.int64)
        if len(leaves):
            self.sums[n : n + len(self.blocks)] = np.add.reduceat(leaves, np.arange(0, len(leaves), BLOCK))
        while n > 1:
            self.sums[n // 2 : n] = self.sums[n : 2 * n : 2] + self.sums[n + 1 : 2 * n : 2]
            n //= 2

    @classmethod
    def kept(cls, text: str, leaves: bytes, encoder: bpe.Bpe) -> SegmentTree:
        """The tree of a text whose leaves have been kept: nothing is encoded."""
        tree = cls("", encoder, _NO_LEAVES)
        tree.text = text
        tree._build(np.frombuffer(leaves, "<i4").reshape(-1, 2).astype(np.int64))
        return tree

    def leaves(self) -> bytes:
        """What kept() takes: characters and tokens of all leaves in order."""
        return np.concatenate(self.blocks).astype("<i4").tobytes()

    @property
    def n_tokens(self) -> int:
        return int(self.sums[1, 1])

    def _find(self, at: int) -> tuple[int, int, int]:
        """(block, leaf, start of the leaf) of the character `at`; the last leaf for the end of the text."""
        node, n, left = 1, len(self.sums) // 2, at
        while node < n:
            node *= 2
            if left >= self.sums[node, 0] and self.sums[node + 1, 0]:
                left -= int(self.sums[node, 0])
                node += 1
        block = node - n
        ends = np.cumsum(self.blocks[block][:, 0])
        leaf = max(min(int(np.searchsorted(ends, left, side="right")), len(ends) - 1), 0)
        return block, leaf, at - left + (int(ends[leaf - 1]) if leaf else 0)

    def _cut(self, text: str, at: int) -> Iterator[tuple[int, int]]:
        """(end, tokens) of each leaf of the text from the border `at` on."""
        while at < len(text):
            m = self.special.search(text, at) if self.special else None
            for p in self.encoder.piece.finditer(text, at, m.start() if m else len(text)):
                yield p.end(), _tokens(self.encoder, p[0])
            if not m:
                return
            at = m.end()
            yield at, 1

    def edit(self, start: int, end: int, new: str) -> None:
        """Replace text[start:end]."""
        size = len(self.text)
        start = min(max(start, 0), size)
        end = min(max(end, start), size)
        block, leaf, lo = self._find(max(start - self.ahead, 0))
        self.text = text = self.text[:start] + new + self.text[end:]
        shift = len(text) - size
        last, after = len(self.blocks) - 1, len(self.blocks[-1])
        leaves, at = [], lo
        for to, tokens in self._cut(text, lo):
            leaves.append((to - at, tokens))
            at = to
            if end + shift <= at < len(text):  # a border on both sides: what follows is cut as before
                b, i, old = self._find(at - shift)
                if old == at - shift:
                    last, after = b, i
                    break
        self.encoded += len(leaves)
        head, tail = self.blocks[block][:leaf], self.blocks[last][after:]
        for b in range(block + 1, last + 1):
            self.blocks[b] = tail[:0]
        self.blocks[block] = np.concatenate((head, np.array(leaves, np.int64).reshape(-1, 2), tail))
        if len(self.blocks[block]) > LARGE:
            self._build(np.concatenate(self.blocks))
            return
        n = len(self.sums) // 2
        nodes = set()
        for b in range(block, last + 1):
            self.sums[n + b] = self.blocks[b].sum(axis=0)
            nodes.add((n + b) // 2)
        while nodes:
            above = set()
            for x in nodes:
                if x:
                    self.sums[x] = self.sums[2 * x] + self.sums[2 * x + 1]
                    above.add(x // 2)
            nodes = above - {0}


def own_edits(text: str) -> list[tuple[int, int, str]]:
    """Edits drawn from the text itself: a deletion, an insertion in the middle, an appendix."""
    n = len(text)
    return [(n // 4, n // 4 + 10, ""), (n // 2, n // 2, " " + text[: min(40, n)]), (n * 2, n * 2, "\n" + text[:30])]


_held: dict[str, bpe.Known] = {}

FIELDS = "n_tokens long, n_edits long, n_tokens_edited long, n_encoded_again long"


def count_edited(docs: DataFrame, keep: list[str] | None = None, edits=own_edits, path: str | None = None) -> DataFrame:
    """Each row of `docs` with FIELDS: its tokens before and after edits(text), and the leaves encoded for the edits."""
    prepare(docs.sparkSession)
    path = path or bpe.default_path()

    def make(texts):
        encoder, _ = bpe.encoder(path)
        if path not in _held:
            _held[path] = leaves_of_stretches(encoder)
        out = []
        for text in texts.to_pylist():
            tree = SegmentTree(text or "", encoder, _held[path])
            before, first, made = tree.n_tokens, tree.encoded, edits(text or "")
            for e in made:
                tree.edit(*e)
            out.append((before, len(made), tree.n_tokens, tree.encoded - first))
        return [pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [[], [], [], []])]

    return add_columns(docs, make, FIELDS, keep)


TREES = "doc_id long, text string, leaves binary, n_tokens long"


def trees(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text, leaves, n_tokens): the trees of all documents, to be written and kept; null texts have that of the empty one."""
    prepare(docs.sparkSession)
    path = path or bpe.default_path()

    def make(texts):
        encoder, _ = bpe.encoder(path)
        if path not in _held:
            _held[path] = leaves_of_stretches(encoder)
        made = [SegmentTree(text or "", encoder, _held[path]) for text in texts.to_pylist()]
        return [pa.array([t.leaves() for t in made], pa.binary()), pa.array([t.n_tokens for t in made], pa.int64())]

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return add_columns(slim, make, "leaves binary, n_tokens long").select("doc_id", "text", "leaves", "n_tokens")


def apply_edits(kept: DataFrame, edits: DataFrame, path: str | None = None) -> DataFrame:
    """Kept trees after edits (doc_id, seq, start, end, new), as trees() gives them, with `n_encoded`, the leaves cut for the edits.

    Only trees that have an edit are read by Python, and of those only the places that the edits touch are encoded; all
    others go through as they are. The edits of a document follow its tree in order of seq (ties: of start, end and
    text), one after the other, so none is gathered. Rows that repeat an id are each edited; edits of unknown or null
    ids are passed over; null places count as 0 and a null text as the empty one.
    """
    prepare(kept.sparkSession)
    path = path or bpe.default_path()
    kept = written(kept.select("doc_id", "text", "leaves", "n_tokens", F.monotonically_increasing_id().alias("tree")), "trees")
    own = edits.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("seq").cast("long").alias("seq"), *[F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(c) for c in ("start", "end")], F.coalesce(F.col("new").cast("string"), F.lit("")).alias("new"))
    asked = kept.select("doc_id", "tree").join(own, "doc_id").drop("doc_id")
    touched = asked.select("tree").distinct()
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    first = kept.join(touched, "tree", "left_semi").select("tree", F.lit(0).alias("kind"), none("long", "seq"), none("long", "start"), none("long", "end"), F.col("text").alias("new"), "doc_id", "leaves")
    then = asked.select("tree", F.lit(1).alias("kind"), "seq", "start", "end", "new", none("long", "doc_id"), none("binary", "leaves"))
    rows = first.unionByName(then).repartition("tree").sortWithinPartitions("tree", "kind", "seq", "start", "end", "new")

    def run(batches):
        encoder, _ = bpe.encoder(path)
        tree, doc = None, None
        done: list[tuple] = []

        def out():
            nonlocal done
            columns = list(zip(*done, strict=True))
            done = []
            kinds = (pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "text", "leaves", "n_tokens", "n_encoded"])

        def close():
            if tree is not None:
                done.append((doc, tree.text, tree.leaves(), tree.n_tokens, tree.encoded))

        for b in batches:
            for kind, start, end, new, own_id, leaves in zip(*(b.column(i).to_pylist() for i in (1, 3, 4, 5, 6, 7)), strict=True):
                if kind == 0:
                    close()
                    tree, doc = SegmentTree.kept(new, leaves, encoder), own_id
                else:
                    tree.edit(start, end, new)
            if done:
                yield out()
        close()
        if done:
            yield out()

    changed = rows.mapInArrow(run, f"{TREES}, n_encoded long")
    same = kept.join(touched, "tree", "left_anti").select("doc_id", "text", "leaves", "n_tokens", F.lit(0).cast("long").alias("n_encoded"))
    return changed.unionByName(same)


def op2_edit_counts(spark, sf_dir: str) -> DataFrame:
    return count_edited(documents(spark, sf_dir).select(F.col("doc_id").cast("long").alias("doc_id"), "text"), keep=["doc_id"])
