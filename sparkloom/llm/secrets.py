"""Secrets by patterns, and by how much a string adds to what is compressed already.

The patterns are fixed (`assign`, `access`, `hex` below). Beside their matches, every string of STRING characters that
stands in a sensitive context is a candidate: a word of SENSITIVE within CONTEXT bytes before it, on its line or the
line before. Its novelty is its marginal cost: the bytes that zstandard needs for the surrounding text and the string,
less those for the surrounding text alone, with a dictionary of identifiers primed for both. The dictionary holds
common words of code and the corpus' own most frequent identifiers, counted over all documents; they have letters only,
so that no key of digits and letters teaches itself. Names and prose are matched by it or by what stands around them and
cost little; a random string costs about its entropy. A candidate of which each character costs RATE bytes or more, and
which costs LEAST in all, is reported as `novel`, unless a pattern's match covers part of it.

Spans are code points, end exclusive. Defined results: null texts count as empty; a text without spans has an empty list
and the hash of the empty string; repeated rows and ids are judged one by one; extra columns are passed over, or carried
along where asked for (but for those that bear a name of this result); an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import textbytes as tb
from sparkloom.llm.frames import add_columns, documents, prepare

# Fixed patterns: kind, expression, group whose length counts, least length.
PATTERNS = [
    ("assign", rb"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", rb"AKIA[A-Z0-9]+", 0, 16),
    ("hex", rb"[0-9a-f]+", 0, 32),
]
STRING = rb"[A-Za-z0-9+/_=~!@#$%^&*-]{12,}"
CONTEXT, AROUND, RATE, LEAST = 64, 1024, 0.92, 11
IDENTIFIERS, MERGED, LEVEL = 4096, 32, 3
# Words that announce a secret, and words of code that the dictionary starts with.
SENSITIVE = """
access accesskey apikey auth authorization aws bearer cert certificate cookie credential credentials key login oauth pass passcode passphrase passwd password
pem pin private privatekey pwd secret secrets seed session signature signing ssh token webhook
"""
CODE = """
abstract address alert append application argument array assert async attribute author await boolean branch browser buffer build button cache callback
catch category channel character checkout class client close cloud cluster collection column command comment commit common component config configuration connect
connection console const constant constructor container content context controller convert cookie counter create current database dataframe datetime debug default
define delete deploy description detail development device dictionary directory disable display document domain double download element email enable encode
endpoint enum environment error event example exception execute export extends factory false field filename filter final finally float folder format
function generate global group handler header height history hostname identifier image import include index initialize input insert instance integer interface
internal invalid iterator javascript keyword label language length library license listener local location logger login machine manager mapping master
maximum member memory message metadata method middleware minimum model module monitor namespace network notification number object offset operation option output
package page parameter parent parse password path pattern payload permission platform plugin policy position prefix previous print private process production profile
project promise property protected protocol provider public python query queue random reader record redirect reference register release remote remove render
replace repository request require reset resource response result return router schedule schema scope script search secret section select send sequence server
service session setting signature source stack standard start state static status storage stream string struct submit subscribe suffix switch system table target
task template terminal test text thread throw timeout timestamp title token transaction transform trigger true type undefined unique update upload username util
valid validate value variable vector version view virtual void volume warning watch webhook width window worker workspace wrapper write yaml
"""

_dictionaries: dict[str, object] = {}


def identifiers(docs: DataFrame, most: int = IDENTIFIERS) -> list[str]:
    """The words of 4 to 32 letters that most texts have, the most frequent last; at most `most` of them."""
    words = F.array_distinct(F.regexp_extract_all(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit("[A-Za-z]{4,32}"), F.lit(0)))
    counts = docs.select(F.explode(words).alias("w")).groupBy("w").agg(F.count("*").alias("n")).where("n > 1")
    # each partition gives its first ones to the driver, so there must be few partitions, whatever the input
    return [r.w for r in counts.repartition(MERGED).orderBy(F.desc("n"), "w").limit(most).collect()][::-1]


def primed(words: list[str]):
    """The compressor of this worker, with the identifiers as its dictionary."""
    import zstandard

    name = hashlib.sha256("\n".join(words).encode()).hexdigest()
    if name not in _dictionaries:
        content = "\n".join([*CODE.split(), *words]).encode()
        known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        known.precompute_compress(level=LEVEL)
        _dictionaries.clear()
        _dictionaries[name] = zstandard.ZstdCompressor(dict_data=known, write_checksum=False, write_content_size=False)
    return _dictionaries[name]


def marginal(press, around: bytes, string: bytes) -> int:
    """Bytes that the string adds after its surroundings."""
    return len(press.compress(around + string)) - len(press.compress(around))


def hex_runs(data: np.ndarray, least: int) -> np.ndarray:
    """Starts and ends of the runs of at least so many lower-case hexadecimal digits."""
    on = np.zeros(len(data) + 2, np.int8)
    on[1:-1] = ((data >= 48) & (data <= 57)) | ((data >= 97) & (data <= 102))
    step = np.diff(on)
    found = np.stack([np.flatnonzero(step == 1), np.flatnonzero(step == -1)], axis=1)
    return found[found[:, 1] - found[:, 0] >= least]


def _sensitive() -> re.Pattern:
    """A sensitive word that isn't a part of a longer one; `apiKey` and `API_KEY` hold one."""
    words = sorted(SENSITIVE.split(), key=len, reverse=True)
    plain, inner = "|".join(words), "|".join(w.title() for w in words)
    return re.compile(f"(?:(?<![A-Za-z])(?i:{plain})|(?<=[a-z])(?:{inner}))s?(?![a-z])".encode())


class Finder:
    """All spans of one text after another, as byte places: (start, number of the kind, end)."""

    def __init__(self, words: list[str]) -> None:
        self.press = primed(words)
        self.patterns = [(i, re.compile(p), group, least) for i, (kind, p, group, least) in enumerate(PATTERNS) if kind != "hex"]
        self.hexes, self.least_hex = next((i, least) for i, (kind, _, _, least) in enumerate(PATTERNS) if kind == "hex")
        self.string, self.sensitive = re.compile(STRING), _sensitive()

    def spans(self, text: bytes) -> list[tuple[int, int, int]]:
        base = [(a, self.hexes, b) for a, b in hex_runs(np.frombuffer(text, np.uint8), self.least_hex).tolist()]
        for i, pattern, group, least in self.patterns:
            base += [(m.start(), i, m.end()) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
        return sorted(base + self.novel(text, base))

    def novel(self, text: bytes, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Strings in a sensitive context that cost about as much as noise and that no pattern has found."""
        taken = sorted((a, b) for a, _, b in base)
        out, i, reach = [], 0, 0
        for m in self.string.finditer(text):
            start, end = m.span()
            while i < len(taken) and taken[i][0] < end:
                reach = max(reach, taken[i][1])
                i += 1
            if reach <= start and self.announced(text, start) and self.costly(text, start, end):
                out.append((start, len(PATTERNS), end))
        return out

    def announced(self, text: bytes, start: int) -> bool:
        before = text[max(0, start - CONTEXT) : start]
        lines = before.split(b"\n")
        return self.sensitive.search(b"\n".join(lines[-2:])) is not None

    def costly(self, text: bytes, start: int, end: int) -> bool:
        around = text[max(0, start - AROUND) : start] + text[end : end + AROUND]
        cost = marginal(self.press, around, text[start:end])
        return cost >= LEAST and cost >= RATE * (end - start)


def find(docs: DataFrame, keep: list[str] | None = None, words: list[str] | None = None) -> DataFrame:
    """The documents with `found`, an array of (kind, start, end), by start and then in the order of kinds.

    words: the identifiers of the dictionary; by default those of the documents themselves.
    """
    prepare(docs.sparkSession)
    known = identifiers(docs) if words is None else words
    kinds = [*(kind for kind, *_ in PATTERNS), "novel"]

    def make(texts):
        finder = Finder(known)
        data, at = tb.utf8(texts)
        counts, kind, start, end = [0], [], [], []
        for i in range(len(at) - 1):
            text = data[at[i] : at[i + 1]]
            spans = finder.spans(text.tobytes())
            if spans:
                a, k, b = np.array(spans).T
                # a code point for each byte that doesn't go on from the one before
                place = np.concatenate(([0], np.cumsum((text & 0xC0) != 0x80)))
                kind += [kinds[j] for j in k]
                start += place[a].tolist()
                end += place[b].tolist()
            counts.append(len(kind))
        rows = pa.StructArray.from_arrays([pa.array(kind, pa.string()), pa.array(start, pa.int64()), pa.array(end, pa.int64())], names=["kind", "start", "end"])
        return [pa.ListArray.from_arrays(pa.array(counts, pa.int32()), rows)]

    return add_columns(docs, make, "found array<struct<kind: string, start: long, end: long>>", keep)


def op12_zstd_novelty(spark, sf_dir: str) -> DataFrame:
    found = find(documents(spark, sf_dir), keep=["doc_id"])
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("found", lambda s: s["kind"] != "novel")
    return found.select("doc_id", *[count(kind) for kind, *_ in PATTERNS], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))
