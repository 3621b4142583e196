"""Token ids in shards compressed by a Re-Pair grammar, written and read by Spark.

File format: a Parquet table with one row per shard. A shard holds whole documents, in ascending order of doc_id, of
SHARD_IDS ids or a little more in all:

    part, first    range partition, and ids of that partition before this shard
    doc_ids, sizes documents of the shard and their numbers of ids
    base, rules    least nonterminal; pairs of symbols, rule i makes nonterminal base + i
    span_wide, spans  bits of a length (8 at least); ids that each nonterminal stands for
    wide, symbols  bits of a symbol (8 at least), here and in rules; the symbols left, the high bits first
    marks          ids before each MARK-th symbol (64 bits), so that any range is decoded from the symbols it needs

Re-Pair: pairs of neighbours are counted (in a run of equal symbols every other one), those that occur at least LEAST
times become nonterminals, the more frequent first where they overlap, and the same is done to what results, until no
pair occurs LEAST times. A pair of which overlaps leave a single place waits for a later round, so each rule is used
twice at least. A pair that was rare once stays rare, so rounds count only pairs with a new symbol and those still frequent.

Defined results: null is the empty text and has the end id only; repeated ids and rows stay apart, ties in doc_id go by
text, null ids come first; a document larger than a shard makes a shard of its own; extra columns are passed over; an
empty table makes an empty file.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.llm.frames import documents, prepare, width
from sparkloom.session import new_path

END_ID = 1
SHARD_IDS = 1 << 19
LEAST, MARK = 2, 1024
HASH = np.uint64(0x9E3779B97F4A7C15)
REMEMBERED = 1_000_000
#: Rules are spelled out to read a shard if that takes at most so many ids for each symbol and rule.
SPELLED = 16
#: New words that the library gets as one text, if they are one pre-token for sure.
TOGETHER, PLAIN = 256, re.compile(r"[a-zß-öø-ÿ]+")
#: A pre-token ends between one of these letters and any sign but the apostrophe (the lower-case form of others may end in a mark).
AFTER_WORD = r"([a-zß-öø-ÿ])([!-&(-/:-@\[-`{-~])"

SHARD = "part int, first long, doc_ids array<long>, sizes array<long>, base int, rules binary, span_wide int, spans binary, wide int, symbols binary, marks binary"


def grouped(pairs: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pairs in order, their places `at`, heads of equal ones); equal pairs keep the order of their places."""
    bits = int(at[-1]).bit_length()
    if width + bits <= 64:
        packed = np.sort(pairs << np.uint64(bits) | at.astype(np.uint64))
        ordered, at = packed >> np.uint64(bits), (packed & np.uint64((1 << bits) - 1)).astype(np.int64)
    else:
        order = np.argsort(pairs, kind="stable")
        ordered, at = pairs[order], at[order]
    return ordered, at, np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))


def settle(place: np.ndarray, at: np.ndarray, none: int) -> np.ndarray:
    """Places, of those in `at`, that a walk through the pairs by rank would replace; all others overlap one of them."""
    out = []
    while len(at):
        own = place[at]
        won = at[(own < place[at - 1]) & (own <= place[np.minimum(at + 1, len(place) - 1)])]
        out.append(won)
        for step in (-1, 0, 1):
            place[np.minimum(won + step, len(place) - 1)] = none
        at = at[place[at] < none]
    return np.sort(np.concatenate(out)) if out else at


def compress(ids: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """(base, rules, symbols) of a Re-Pair grammar for ids."""
    seq = ids.astype(np.uint32)
    base = int(seq.max()) + 1 if len(seq) else 0
    made, n_rules = [np.zeros((0, 2), np.uint32)], 0
    live = np.ones(len(seq), bool)  # pairs, by their first symbol, that may be frequent
    while len(seq) > 1:
        maybe = live[:-1].copy()
        twin = np.flatnonzero(seq[:-1] == seq[1:])
        if len(twin):
            first = np.concatenate(([True], np.diff(twin) > 1))
            maybe[twin[(twin - twin[first][np.cumsum(first) - 1]) % 2 == 1]] = False
        at = np.flatnonzero(maybe)
        if not len(at):
            break
        half = (base + n_rules).bit_length()
        pairs, at, heads = grouped(seq[at].astype(np.uint64) << np.uint64(half) | seq[at + 1], at, 2 * half)
        counts = np.diff(np.append(heads, len(pairs)))
        often = counts >= LEAST
        frequent = np.repeat(often, counts)
        live[at[~frequent]] = False
        if not often.any():
            break
        chosen, counts = pairs[heads[often]], counts[often]
        by_rank = np.lexsort((chosen * HASH, -counts))
        rank = np.empty(len(chosen), np.int32)
        rank[by_rank] = np.arange(len(chosen), dtype=np.int32)
        # rank of the pair at each place (0: most frequent), or past all; places count from 1
        none = len(chosen)
        place = np.full(len(seq) + 1, none, np.int32)
        place[at[frequent] + 1] = np.repeat(rank, counts)
        odd = twin[~maybe[twin]]
        value = seq[odd].astype(np.uint64) << np.uint64(half) | seq[odd]
        seat = np.minimum(np.searchsorted(chosen, value), none - 1)
        odd, odd_rank = odd[chosen[seat] == value] + 1, rank[seat[chosen[seat] == value]]
        known = place.copy()
        known[odd] = odd_rank
        at = settle(place, np.flatnonzero(place < none), none)
        # what stays free next to pairs used once, and in runs of which a neighbour took the first symbol
        while True:
            uses = np.bincount(known[at], minlength=none)
            known[known < none] = np.where(uses[known[known < none]] > 1, known[known < none], none)
            at = at[known[at] < none]
            free = known.copy()
            for step in (-1, 0, 1):
                free[at + step] = none
            more = settle(free, np.flatnonzero(free < none), none)
            if not len(more):
                break
            at = np.sort(np.concatenate([at, more]))
        used = np.flatnonzero(uses > 1)
        names, at = known[at], at - 1
        number = np.zeros(none, np.uint32)
        number[used] = base + n_rules + np.arange(len(used))
        new = chosen[by_rank[used]]
        made.append(np.stack([new >> np.uint64(half), new & np.uint64((1 << half) - 1)], 1).astype(np.uint32))
        n_rules += len(used)
        seq[at] = number[names]
        live[at] = True
        live[np.maximum(at - 1, 0)] = True
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        seq, live = seq[keep], live[keep]
    return base, np.concatenate(made), seq


def packed(symbols: np.ndarray, wide: int) -> bytes:
    return np.packbits(np.unpackbits(symbols.astype(">u4").view(np.uint8)).reshape(-1, 32)[:, 32 - wide :]).tobytes()


def unpacked(raw: bytes, wide: int) -> np.ndarray:
    n = len(raw) * 8 // wide
    bits = np.zeros((n, 32), np.uint8)
    bits[:, 32 - wide :] = np.unpackbits(np.frombuffer(raw, np.uint8), count=n * wide).reshape(n, wide)
    return np.packbits(bits).view(">u4").astype(np.uint32)


def lengths(base: int, rules: np.ndarray) -> np.ndarray:
    """Ids that each nonterminal stands for, a stretch of rules at a time that only needs earlier ones."""
    out = np.ones(len(rules), np.int64)
    top, i = np.maximum.accumulate(rules.max(1, initial=0)), 0
    while i < len(rules):
        j = int(np.searchsorted(top, base + i))
        out[i:j] = symbol_sizes(base, out, rules[i:j].ravel()).reshape(-1, 2).sum(1)
        i = j
    return out


def symbol_sizes(base: int, size: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    out = np.ones(len(symbols), np.int64)
    big = symbols >= base
    out[big] = size[symbols[big].astype(np.int64) - base]
    return out


def expand(base: int, rules: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    """Ids of a run of symbols: all nonterminals are replaced by their pairs until none is left."""
    seq = symbols.astype(np.uint32)
    while (big := seq >= base).any():
        wide = 1 + big
        second = (np.cumsum(wide) - 1)[big]
        pairs = rules[seq[big] - base]
        seq = np.repeat(seq, wide)
        seq[second - 1], seq[second] = pairs[:, 0], pairs[:, 1]
    return seq


def expand_all(base: int, rules: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    """The same for the symbols of a whole shard: what each rule stands for is spelled once, then copied wherever it is used."""
    spans = lengths(base, rules)
    if int(spans.sum()) > SPELLED * (len(symbols) + len(rules)) or base > SPELLED * (1 << 20):
        return expand(base, rules, symbols)
    # terminals stand for themselves at the front, nonterminal i at base + at[i]
    spelled = np.concatenate((np.arange(base, dtype=np.uint32), np.zeros(int(spans.sum()), np.uint32)))
    at = base + np.cumsum(spans) - spans

    def copied(run: np.ndarray) -> np.ndarray:
        size, start = symbol_sizes(base, spans, run), run.astype(np.int64)
        big = start >= base
        start[big] = at[start[big] - base]
        ends = np.cumsum(size)
        return spelled[np.repeat(start - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]

    top, i = np.maximum.accumulate(rules.max(1, initial=0)), 0
    while i < len(rules):
        j = int(np.searchsorted(top, base + i))
        spelled[at[i] : at[j - 1] + spans[j - 1]] = copied(rules[i:j].ravel())
        i = j
    return copied(symbols)


def ids_between(base: int, rules: np.ndarray, spans: np.ndarray, symbols: np.ndarray, marks: np.ndarray, start: int, end: int) -> np.ndarray:
    """Ids start..end of a shard: the lengths of symbols lead from the last mark before `start` to those that are expanded."""
    if end <= start or not len(marks):
        return np.zeros(0, np.uint32)
    lo = max(int(np.searchsorted(marks, start, side="right")) - 1, 0) * MARK
    hi = int(np.searchsorted(marks, end)) * MARK
    ends = int(marks[lo // MARK]) + np.cumsum(symbol_sizes(base, spans, symbols[lo:hi]))
    a, z = np.searchsorted(ends, start, side="right"), np.searchsorted(ends, end) + 1
    skip = start - int(ends[a - 1] if a else marks[lo // MARK])
    return expand(base, rules, symbols[lo + a : lo + z])[skip : skip + end - start]


class Words:
    """Ids of stretches without ASCII white space. No pre-token of this vocabulary crosses white space, so stretches are encoded one by one."""

    def __init__(self, path: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        vocabulary = self.library.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, bool)  # tokens that end a pre-token
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.seat: dict[str, int] = {}
        self.ids, self.start, self.size, self.used = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64), 0

    def _add(self, words: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        n, m = len(self.seat), len(words)
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while n + m > len(self.start):
            self.start, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.size))
        self.ids[self.used : self.used + len(ids)] = ids
        self.size[n : n + m] = sizes
        self.start[n : n + m] = self.used + np.cumsum(sizes) - sizes
        self.used += len(ids)
        self.seat.update(zip(words, range(n, n + m), strict=True))

    def _learn(self, words: list[str]) -> None:
        """Plain words go to the library as running text, cut again where pre-tokens end."""
        plain, odd = [], []
        for w in words:
            (plain if PLAIN.fullmatch(w) else odd).append(w)
        for i in range(0, len(plain), TOGETHER):
            some = plain[i : i + TOGETHER]
            ids = np.array(self.library.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, np.uint32)
            border = np.flatnonzero(self.ends[ids]) + 1
            if len(border) == len(some):
                self._add(some, ids, np.diff(border, prepend=0))
            else:
                odd += some
        for i in range(0, len(odd), 4096):
            some = odd[i : i + 4096]
            found = [e.ids for e in self.library.encode_batch_fast(some, add_special_tokens=False)]
            self._add(some, np.fromiter((x for e in found for x in e), np.uint32), np.fromiter(map(len, found), np.int64, len(found)))

    def encode(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each); each text is followed by the end id, if one is given."""
        import pyarrow.compute as pc

        if len(self.seat) > REMEMBERED:
            self.clear()
        if not pc.any(pc.match_substring(texts, "<|")).as_py():  # special tokens are found before anything else
            texts = pc.replace_substring_regex(pc.ascii_lower(texts), AFTER_WORD, r"\1 \2")
        lists = pc.ascii_split_whitespace(texts)
        bounds = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        coded = pc.dictionary_encode(lists.flatten())
        names = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if new := [w for w in names if w not in self.seat]:
            self._learn(new)
        seats = np.fromiter(map(self.seat.__getitem__, names), np.int64, len(names))
        seats = seats[coded.indices.to_numpy()] if len(names) else np.zeros(0, np.int64)
        size, start, ids = self.size[seats], self.start[seats], self.ids
        if end_id is not None:
            size, start, ids = np.insert(size, bounds[1:], 1), np.insert(start, bounds[1:], self.used), np.append(ids[: self.used], np.uint32(end_id))
            bounds = bounds + np.arange(len(bounds))
        ends = np.cumsum(size)
        flat = ids[np.repeat(start - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]
        return flat, np.diff(np.concatenate(([0], ends))[bounds])


_held: dict[str, Words] = {}


def words(path: str) -> Words:
    if path not in _held:
        _held[path] = Words(path)
    return _held[path]


def shard(part: int, first: int, ids: list[np.ndarray], sizes: list[int], doc_ids: list[int | None]) -> pa.RecordBatch:
    base, rules, symbols = compress(np.concatenate(ids))
    spans = lengths(base, rules)
    marks = np.concatenate(([0], np.cumsum(symbol_sizes(base, spans, symbols))))[:-1][::MARK]
    wide, span_wide = max(8, int(base + len(rules)).bit_length()), max(8, int(spans.max(initial=1)).bit_length())
    row = [part, first, doc_ids, sizes, base, packed(rules.ravel(), wide), span_wide, packed(spans.astype(np.uint32), span_wide), wide, packed(symbols, wide), marks.astype("<i8").tobytes()]
    kinds = [pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int32(), pa.binary(), pa.int32(), pa.binary(), pa.int32(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names=["part", "first", "doc_ids", "sizes", "base", "rules", "span_wide", "spans", "wide", "symbols", "marks"])


def write_ids(docs: DataFrame, path: str, vocabulary: str, end_id: int = END_ID) -> None:
    """Encode all texts and write the shards to `path`."""
    spark = docs.sparkSession
    prepare(spark)

    def run(batches):
        from pyspark import TaskContext

        part, first, held, sizes, names, n = TaskContext.get().partitionId(), 0, [], [], [], 0
        book = words(vocabulary)
        for b in batches:
            flat, size = book.encode(b.column(1), end_id)
            ends, at, doc_ids = np.cumsum(size), 0, b.column(0).to_pylist()
            while at < len(size):
                # documents until the shard has its ids, the last of them in whole
                to = min(int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SHARD_IDS - n)) + 1, len(size))
                held.append(flat[ends[at] - size[at] : ends[to - 1]])
                sizes += size[at:to].tolist()
                names += doc_ids[at:to]
                n += len(held[-1])
                at = to
                if n >= SHARD_IDS:
                    yield shard(part, first, held, sizes, names)
                    first, held, sizes, names, n = first + n, [], [], [], 0
        if held:
            yield shard(part, first, held, sizes, names)

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    dealt = slim.repartitionByRange(width(spark), F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    dealt.mapInArrow(run, SHARD).write.parquet(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of the documents in the shards at `path`."""
    prepare(spark)
    shards = spark.read.schema(SHARD).parquet(path)
    # one row per range partition
    totals = shards.select("part", F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")).groupBy("part").agg(F.sum("n").alias("n"))
    before = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                symbols, rules = unpacked(r["symbols"], r["wide"]), unpacked(r["rules"], r["wide"]).reshape(-1, 2)
                ids = expand_all(r["base"], rules, symbols).astype("<u4", copy=False)
                sizes = np.array(r["sizes"], np.int64)
                ends = np.cumsum(sizes)
                crc = [zlib.crc32(ids[a:z]) for a, z in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(r["doc_ids"], pa.int64()), pa.array(r["before"] + r["first"] + ends - sizes), pa.array(sizes), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return shards.join(F.broadcast(before), "part").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_documents(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """(doc_id, ids) of the documents of the file whose ids are in `wanted` (doc_id), each decoded by itself from its shard."""
    prepare(spark)
    shards = spark.read.schema(SHARD).parquet(path).withColumn("shard", F.struct("part", "first"))
    asked = shards.select("shard", F.posexplode("doc_ids").alias("seat", "doc_id")).join(wanted.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct(), "doc_id")
    asked = asked.groupBy("shard").agg(F.collect_list("seat").alias("seats"))

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                symbols, rules, spans = unpacked(r["symbols"], r["wide"]), unpacked(r["rules"], r["wide"]).reshape(-1, 2), unpacked(r["spans"], r["span_wide"]).astype(np.int64)
                marks, ends = np.frombuffer(r["marks"], "<i8"), np.cumsum(r["sizes"])
                seats = sorted(r["seats"])
                lists = [ids_between(r["base"], rules, spans, symbols, marks, int(ends[i]) - r["sizes"][i], int(ends[i])).astype(np.int64) for i in seats]
                yield pa.RecordBatch.from_arrays([pa.array([r["doc_ids"][i] for i in seats], pa.int64()), pa.array(lists, pa.list_(pa.int64()))], names=["doc_id", "ids"])

    return shards.join(asked, "shard").drop("shard").mapInArrow(run, "doc_id long, ids array<long>")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op4_repair(spark, sf_dir: str) -> DataFrame:
    path = new_path(spark, "ids")
    write_ids(documents(spark, sf_dir), path, default_path())
    return read_ids(spark, path)
