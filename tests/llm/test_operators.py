"""Each operator against a plain reckoning of the same, with nulls, empty texts, repeated rows, ties and empty tables."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from sparkloom.llm import bpe, editcount, hostrepeats, minhash, perspectives, repair, repeats, spotsigs, toxicity, winnowing

LOW = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, h1 int"


def texts(seed=1):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 6)))
    long = " ".join(word() for _ in range(900))
    out = [None, "", " \n", "A b", "a B", long, long[:-30] + " zz", long[300:900] + " own", "é" * 250, "ab" * 300]
    return out + [" ".join(word() for _ in range(r.randint(1, 60))) for _ in range(8)] + [long[:700]]


def table(spark, rows=None):
    rows = texts() if rows is None else rows
    data = [(i, t, "en", "s", len(t or ""), "x", 1) for i, t in enumerate(rows)]
    data += data[3:4] + ([(None, "no id", None, None, None, None, None)] if rows else [])
    return spark.createDataFrame(data, SCHEMA).repartition(3)


@pytest.mark.parametrize("crowd", [repeats.CROWD, 0])  # anchors compared in tasks, and counted window by window
def test_repeats(spark, monkeypatch, crowd):
    monkeypatch.setattr(repeats, "CROWD", crowd)
    docs = table(spark)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.digests(docs).collect())
    raw = [(r.doc_id, (r.text or "").encode()) for r in docs.collect()]
    seen = {}
    for _, b in raw:
        for i in range(len(b) - 199):
            seen[b[i : i + 200]] = seen.get(b[i : i + 200], 0) + 1
    want = []
    for i, b in raw:
        hit = bytearray(len(b))
        for p in range(len(b) - 199):
            if seen[b[p : p + 200]] > 1:
                hit[p : p + 200] = b"\1" * 200
        kept = bytes(x for x, h in zip(b, hit) if not h)
        want.append((i is None, i or 0, len(b), sum(hit), len(re.findall(b"\1+", bytes(hit))), hashlib.sha256(kept).hexdigest()))
    assert got == sorted(want)


def test_anchors_do_not_depend_on_the_batch():
    r = random.Random(12)
    text = bytes(r.choice(b"ab ") for _ in range(900))
    alone = repeats.anchor_runs(np.frombuffer(text, np.uint8), np.array([0, 900]))
    filler = bytes(r.choice(b"xyz") for _ in range(300_000))
    later = repeats.anchor_runs(np.frombuffer(filler + text, np.uint8), np.array([0, 300_000, 300_900]))
    n = len(alone[0])
    assert all((a == b[-n:]).all() for a, b in zip(alone[:2], later[:2], strict=True)) and (later[2][-n:] - 300_000 == alone[2]).all()


def test_minhash(spark):
    docs = table(spark)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id, r.kept) for r in minhash.near_groups(docs).collect())
    rows = [(r.doc_id, re.findall(r"[^\x20\x09-\x0D]+", (r.text or "").translate(LOW))) for r in docs.collect()]
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []) for _, w in rows]
    group = list(range(len(rows)))
    for _ in rows:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= 75 * len(a | b):
                    group[i] = group[j] = min(group[i], group[j])
    want = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if group[j] == group[i] and rows[j][0] is not None]
        c = (min(ids) if ids else None) if sets[i] else d
        want.append((d is None, d or 0, len(sets[i]), c, c is not None and c == d))
    assert got == sorted(want)


def test_winnowing(spark):
    r = random.Random(4)
    v = ["a", "B", "cé", "d9"]
    items = [(i, " ".join(r.choice(v) for _ in range(n))) for i, n in enumerate([0, 1, 9, 10, 15, 40])] + [(5, None), (None, "d9 d9 a a B")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [None, "", items[5][1], items[4][1][:20], *(" ".join(r.choice(v) for _ in range(30)) for _ in range(5))]
    docs = table(spark, rows)

    def plain(t):
        words = lambda x: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (x or "").translate(LOW))
        d, hit, names = words(t), set(), set()
        for name, x in items:
            w = words(x)
            m = min(10, len(w))
            grams = {tuple(w[i : i + m]) for i in range(len(w) - m + 1)} if m else set()
            for i in range(len(d) - m + 1):
                if tuple(d[i : i + m]) in grams:
                    hit.update(range(i, i + m))
                    names.add("" if name is None else str(name))
        return len(d), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)

    for limit in (winnowing.BROADCAST_BYTES, 0):  # sent whole, and joined
        got = winnowing.decontaminate(docs, bench, broadcast_bytes=limit).collect()
        assert len(got) == docs.count()
        for x in got:
            assert (x.n_words, x.n_hit, x.n_items, x.items_sha256, x.contaminated) == plain(x.text)
        none = winnowing.decontaminate(docs, bench.limit(0), broadcast_bytes=limit).where("contaminated").count()
        assert none == 0 and winnowing.decontaminate(docs.limit(0), bench, broadcast_bytes=limit).count() == 0


def test_winnowing_on_one_word(spark):
    """20,000 equal words against as many: linear, or it would never end."""
    same = " ".join(["w"] * 20_000)
    bench = spark.createDataFrame([("x", same), ("y", "w " * 12 + "v")], "item_id string, text string")
    docs = spark.createDataFrame([(1, same), (2, "w " * 9)], "doc_id long, text string")
    for limit in (winnowing.BROADCAST_BYTES, 0):
        got = {r.doc_id: (r.n_words, r.n_hit, r.n_items) for r in winnowing.decontaminate(docs, bench, broadcast_bytes=limit).collect()}
        assert got == {1: (20_000, 20_000, 2), 2: (9, 0, 0)}


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    return {n: Tokenizer.from_file(public_tokenizers.path(n)) for n in ("byte_bpe_50k.json", "word_bpe_49k.json")}


def odd_texts():
    r = random.Random(2)
    letters = "aAbé \n\t日本x'sl0189 .,!?<|>\x85　́😀ΣİtheÅ"
    return ["".join(r.choice(letters) for _ in range(r.randint(0, 80))) for _ in range(300)] + ["a" * 700, " " * 90, "<|endoftext|>A <|endoftext|>", "it's I'VE"]


def test_bpe(spark, library):
    tok = library["byte_bpe_50k.json"]
    encoder, known = bpe.encoder(bpe.default_path())
    for t in odd_texts():
        ids = tok.encode(t, add_special_tokens=False).ids
        mine = np.frombuffer(encoder.encode(t, known), "<u4")
        assert mine.tolist() == ids and encoder.decode(mine) == tok.decode(ids, skip_special_tokens=False)
    docs = table(spark)
    for r in bpe.encode_and_decode(docs).collect():
        assert r.n_tokens == len(tok.encode(r.text or "", add_special_tokens=False).ids)
        assert r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()


def test_edit_counts():
    encoder, known = bpe.encoder(bpe.default_path())
    r = random.Random(5)
    for _ in range(400):
        letters = list("ab \n\t.'slve 1é")
        if r.random() < 0.5:  # whole special tokens, and such that edits make and break
            letters += ["<|endoftext|>", "<|endoftext|>", "<|endof", "text|>", "<"]
        x = "".join(r.choice(letters) for _ in range(r.choice([0, 1, 60, 900])))
        tree = editcount.SegmentTree(x, encoder)
        for _ in range(8):
            s, e, new = r.randint(0, len(x)), r.randint(0, len(x)), "".join(r.choice(letters) for _ in range(r.choice([0, 1, 9])))
            e = max(s, e)
            x = x[:s] + new + x[e:]
            tree.edit(s, e, new)
            assert tree.text == x and tree.n_tokens == len(encoder.encode(x, known)) // 4


def test_repair(spark, library, tmp_path):
    r = random.Random(6)
    for n in (0, 1, 50, 5000):
        x = np.array([r.randint(0, 3) for _ in range(n)], np.uint32)
        assert (repair.expand(*repair.compress(x)) == x).all()
    path = f"file://{tmp_path}/ids"
    docs = table(spark)
    repair.write_ids(docs, path, repair.default_path())
    got = sorted(((r.doc_id is not None, r.doc_id or 0, r.start, r.n_tokens, r.ids_crc32) for r in repair.read_ids(spark, path).collect()), key=lambda x: x[2])
    at, want = 0, []
    for d in sorted(docs.collect(), key=lambda d: (d.doc_id is not None, d.doc_id or 0, d.text or "")):
        ids = [*library["word_bpe_49k.json"].encode(d.text or "", add_special_tokens=False).ids, 1]
        want.append((d.doc_id is not None, d.doc_id or 0, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == want
    some = spark.createDataFrame([(5,), (1,), (8,), (999,)], "doc_id long")
    back = {r.doc_id: r.ids for r in repair.read_documents(spark, path, some).collect()}
    text = {d.doc_id: d.text for d in docs.collect()}
    assert back == {i: [*library["word_bpe_49k.json"].encode(text[i] or "", add_special_tokens=False).ids, 1] for i in (1, 5, 8)}
    empty = f"file://{tmp_path}/none"
    repair.write_ids(docs.limit(0), empty, repair.default_path())
    assert repair.read_ids(spark, empty).count() == 0


def test_repair_shards_read_at_random(spark, library, tmp_path, monkeypatch):
    """Small shards of whole documents; each document is decoded by itself."""
    monkeypatch.setattr(repair, "SHARD_IDS", 50)
    monkeypatch.setattr(repair, "MARK", 4)
    r = random.Random(9)
    rows = [(i, " ".join(r.choice(["the", "tall", "houses,", "fell."]) for _ in range(r.randint(0, 40)))) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    ids = {i: [*library["word_bpe_49k.json"].encode(t, add_special_tokens=False).ids, 1] for i, t in rows}
    flat = np.concatenate(list(ids.values())).astype(np.uint32)
    base, rules, symbols = repair.compress(flat)
    spans = repair.lengths(base, rules)
    marks = np.concatenate(([0], np.cumsum(repair.symbol_sizes(base, spans, symbols))))[:-1][:: repair.MARK]
    for a in range(0, len(flat), 7):
        for z in (a + 1, a + 20, len(flat)):
            assert repair.ids_between(base, rules, spans, symbols, marks, a, min(z, len(flat))).tolist() == flat[a:z].tolist()
    path = f"file://{tmp_path}/small"
    repair.write_ids(docs, path, repair.default_path())
    assert {x.doc_id: x.ids for x in repair.read_documents(spark, path, docs.select("doc_id")).collect()} == ids


def test_repair_leaves_no_pair_twice():
    r = random.Random(8)
    part = [r.randint(0, 900) for _ in range(1500)]
    for x in ([5] * 10_000, part * 2 + [7] * 3 + part, [r.randint(0, 3) for _ in range(5000)], [70_000, 1] * 2):
        x = np.array(x, np.uint32)
        base, rules, symbols = repair.compress(x)
        assert len({tuple(p) for p in rules.tolist()}) == len(rules)
        found, i = Counter(), 0
        text = symbols.tolist()
        while i + 1 < len(text):
            found[text[i], text[i + 1]] += 1
            # in a run of one symbol, every other pair
            i += 2 if text[i : i + 3] == [text[i]] * 3 else 1
        assert max(found.values(), default=0) < 2
        wide = int(base + len(rules)).bit_length()
        assert (repair.unpacked(repair.packed(symbols, max(8, wide)), max(8, wide)) == symbols).all()
        size = repair.symbol_sizes(base, repair.lengths(base, rules), symbols)
        marks = np.concatenate(([0], np.cumsum(size)))[:-1][:: repair.MARK]
        spans = repair.lengths(base, rules)
        for a, z in ((0, len(x)), (1, 2), (len(x) // 3, len(x) // 2), (len(x) - 1, len(x)), (3, 3)):
            assert repair.ids_between(base, rules, spans, symbols, marks, a, z).tolist() == x[a:z].tolist()
    assert len(repair.compress(np.full(10_000, 5, np.uint32))[2]) < 20


def test_word_cache_is_exact(library):
    book = repair.Words(repair.default_path())
    for some in (odd_texts(), [t for t in odd_texts() if "<|" not in t], ["The END. it's é. x.́ a_b ÀB,c", "", " "]):
        ids, sizes = book.encode(pa.array(some))
        want = [library["word_bpe_49k.json"].encode(t, add_special_tokens=False).ids for t in some]
        assert sizes.tolist() == list(map(len, want)) and ids.tolist() == [x for w in want for x in w]


def signatures(text):
    """Chains of a common word and the next three others, as they stand; of texts without common words, from each word."""
    words, common = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(LOW)), set(spotsigs.COMMON)
    if not words:
        return {("", text)} if text else set()
    spots = [i for i, w in enumerate(words) if w in common] or range(len(words))
    return {(words[i], *[w for w in words[i + 1 :] if w not in common][: spotsigs.CHAIN]) for i in spots}


def ratio(a, b):
    return len(a & b) / len(a | b) if a and b else float(a == b)


def test_spotsigs(spark):
    r = random.Random(8)
    prose = lambda: " ".join(r.choice(["the", "of", "La", "house", "tree", "Übung", "river", "stone", "sky", "road"]) for _ in range(r.randint(2, 80)))
    docs = table(spark, [*texts(), *(prose() for _ in range(12))])
    got = {(r.doc_id, r.n_chars): r for r in spotsigs.compared(docs).collect()}
    rows = sorted([(d.doc_id is not None, d.doc_id or 0, d.text or "", d.doc_id) for d in docs.collect()])
    for i, (_, _, t, d) in enumerate(rows):
        n = len(t) // 4
        x = got[d, len(t)]
        assert x.edited_sha256 == hashlib.sha256((t[: len(t) - n] + rows[(i + 1) % len(rows)][2][:n]).encode()).hexdigest()
        assert 0 <= x.near_edited <= 1 and 0 <= x.near_next <= 1
    plain = [signatures(t) for _, _, t, _ in rows]
    prints = {}
    for i, (_, _, t, d) in enumerate(rows):
        x, n = got[d, len(t)], len(t) // 4
        follows = (i + 1) % len(rows)
        new = signatures(t[: len(t) - n] + rows[follows][2][:n])
        assert len(x.fingerprint) == 8 * len(plain[i]) and len(x.edited_fingerprint) == 8 * len(new)
        assert x.near_edited == pytest.approx(ratio(plain[i], new)) and x.near_next == pytest.approx(ratio(plain[i], plain[follows]))
        prints.setdefault(x.fingerprint, set()).add(frozenset(plain[i]))
    assert all(len(v) == 1 for v in prints.values()) and len(prints) == len({frozenset(x) for x in plain})
    a = "the quick brown fox of great speed and some other words to come"
    same, near, far = spotsigs.sets_of([a, a + " again", "zz yy xx"])
    assert spotsigs.likeness(same, same) == 1 and spotsigs.likeness(same, near) > spotsigs.likeness(same, far)
    pairs = spotsigs.near_pairs(spark.createDataFrame([(1, a), (2, a + " again"), (3, "zz yy"), (4, a)], "doc_id long, text string"), 0.5)
    assert [(p.a, p.b) for p in pairs.collect()] == [(1, 2)]


def test_near_pairs_against_all_pairs(spark):
    """Edited texts at many likenesses, a third of them copies, signatures that all share, ids that are null or stand twice."""
    r = random.Random(12)
    rows = [(i, "the same words here and the common end of it") for i in range(60)] + [(None, None), (900, ""), (901, "zz"), (902, "zz")]
    for size in (12, 90):
        base = [r.choice(["the", "of", "and", f"w{r.randrange(40)}", f"v{r.randrange(9999)}"]) for _ in range(size)]
        for i in range(45):
            words = list(base)
            for _ in range(r.choice([0, 1, 1, size // 20, size // 10])):
                words[r.randrange(size)] = f"e{r.randrange(99)}"
            rows.append((r.choice([None, 7, 100 + size + i]), " ".join(words[: size - r.choice([0, 0, size // 9])])))
    r.shuffle(rows)
    docs = spark.createDataFrame([(*x, "clash") for x in rows], "doc_id long, text string, key string")
    sets = {}
    for (i, t), sigs in zip(rows, spotsigs.sets_of([t or "" for _, t in rows]), strict=True):
        if len(sigs):
            sets.setdefault(frozenset(sigs.tolist()), []).append(i)
    name = {k: min((i for i in ids if i is not None), default=None) for k, ids in sets.items()}
    order = lambda i: (i is not None, i or 0)
    for like in (0.5, 0.75):
        want = []
        every = list(sets)
        for n, x in enumerate(every):
            for y in every[:n]:
                ratio = len(x & y) / len(x | y)
                if ratio >= like:
                    want.append((*sorted((name[x], name[y]), key=order), round(ratio, 9)))
        got = spotsigs.near_pairs(docs, like).collect()
        assert len(got) == len({(p.key_a, p.key_b) for p in got}) and len(want) > 20
        assert sorted(((p.a, p.b, round(p.likeness, 9)) for p in got), key=repr) == sorted(want, key=repr)
    members = spotsigs.keyed_sets(docs).groupBy("key").count().collect()
    assert sorted(m["count"] for m in members) == sorted(map(len, sets.values()))
    assert spotsigs.near_pairs(docs.limit(0)).count() == 0


PAGES = "page_id long, url string, html string, host string, text string, rank int"


def extracted(spark, rows):
    frame = spark.createDataFrame([(*r, "own", "own", 3) for r in rows], PAGES)
    return sorted(((r.page_id, r.url, r.text, r.n_chars) for r in hostrepeats.extract(frame).collect()), key=repr)


def test_host_repeats(spark):
    foot = "one two three four five six seven eight nine"
    page = lambda body: f"<html><head><title>t</title></head><body><nav>n</nav>{body}<div>{foot}</div></body></html>"
    rows = [
        (1, "http://a.example/1", page("<article><h1>T &amp; U</h1><p>x<br>y <!-- c --><p>z &amp<b>amp;</b></article>")),
        (2, "http://a.example/2", page("<div>first own words</div>")),
        (2, "http://a.example/2", page("<div>first own words</div>")),
        (3, "http://a.example/3", page("<div>second <b>own</b> words</div><div class='ad'>buy</div><script>if (a<b) {}</script>")),
        (4, None, None),
        (5, "x", ""),
        (None, "http://a.example/6", "<article>" + "long text " * 30_000 + "<p>"),
    ]
    want = {1: "T & U\n\nx y\n\nz &amp;", 2: "first own words", 3: "second own words", 4: "", 5: "", None: ("long text " * 30_000).strip()}
    assert extracted(spark, rows) == sorted(((i, u, want[i], len(want[i])) for i, u, _ in rows), key=repr)
    assert hostrepeats.extract(spark.createDataFrame([], PAGES)).count() == 0


def test_host_repeats_decide_under_names(spark):
    often = "menu words that stand on both of the pages here"
    rows = [
        (1, "http://a.example/1", "<main class='search-page'><p>kept by its element</p><div class='ad'>buy</div></main><p>other</p>"),
        (2, "http://a.example/2", f"<div class='has-sidebar'><article><p>the first text</p><p>{often}</p><article class='comment'>c</article></article></div>"),
        (3, "http://a.example/3", f"<div class='has-sidebar'><article><p>a second piece</p><p>{often}</p></article></div>"),
        (4, "http://a.example/4", "<article>own</article><div class='related'><article>teaser</article></div><aside><article>more</article></aside>"),
        (5, "http://a.example/5", f"<article><div class='article-header'><h1>Title</h1></div><p>t</p><div class='end-banner'>{often}</div><div class='commentlist'>me</div></article>"),
    ]
    want = {1: "kept by its element", 2: "the first text", 3: "a second piece", 4: "own", 5: "Title\n\nt"}
    assert {i: t for i, _, t, _ in extracted(spark, rows)} == want


def test_host_repeats_against_all_substrings(spark):
    """Pages without article: each token that a string of eight tokens on other pages of the host covers goes."""
    r = random.Random(11)
    common = [[f"c{k}{r.randrange(9)}" for _ in range(r.randint(5, 14))] for k in range(6)]
    rows, words = [], []
    for i in range(40):
        host = r.choice("ab")
        parts = [r.choice(common) if r.random() < 0.5 else [f"w{r.randrange(400)}" for _ in range(r.randint(1, 12))] for _ in range(6)]
        if i % 10 == 9:  # a copy of another page isn't a second page
            host, parts = words[0]
        words.append((host, parts))
        rows.append((i, f"https://{host}.example/{i}", "".join(f"<div>{' '.join(p)}</div>" for p in parts)))
    pages = {}
    for host, parts in words:
        flat = [w for p in parts for w in p]
        for k in range(len(flat) - 7):
            pages.setdefault((host, tuple(flat[k : k + 8])), set()).add(tuple(map(tuple, parts)))
    want = []
    for (i, url, _), (host, parts) in zip(rows, words, strict=True):
        flat = [w for p in parts for w in p]
        hit = [any(len(pages.get((host, tuple(flat[k : k + 8])), ())) > 1 for k in range(max(j - 7, 0), j + 1) if k + 8 <= len(flat)) for j in range(len(flat))]
        at, out = 0, []
        for p in parts:
            left = [w for w, h in zip(p, hit[at : at + len(p)], strict=True) if not h]
            at += len(p)
            out += [" ".join(left)] if left else []
        want.append((i, url, "\n\n".join(out), len("\n\n".join(out))))
    assert extracted(spark, rows) == sorted(want, key=repr)
    assert 0 < sum(len(t) for _, _, t, _ in want) < sum(len(" ".join(p)) for _, parts in words for p in parts) * 0.9


def test_perspectives(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (None, 1, None, "x"), (-1, 1, "unknown", "y"), (-1, None, "unknown", "first"), (-1, 1, "unknown", "y"), (-1, 1, None, "z"), (2, 0, "system", "alone")]
    rows += [(3, i, r, "w" * (i % 7)) for i in range(1500) for r in ("a", "b")]
    frame = spark.createDataFrame([(*r, "own", 5) for r in rows], "conv_id long, turn long, role string, text string, head string, size int")
    whole = {}
    for r in perspectives.perspectives(frame).collect():
        whole.setdefault((r.conv_id, r.perspective), []).append(r)
    assert set(whole) == {(1, "ann"), (1, "bob"), (None, None), (-1, "unknown"), (-1, None), (3, "a"), (3, "b")}
    first = lambda x: (x is not None, x)
    for (conv, who), parts in whole.items():
        want = ""
        for _, turn, role, text in sorted((r for r in rows if r[0] == conv), key=lambda r: (first(r[1]), first(r[2]), r[3] or "")):
            want += ("<|system|>" if role == "system" else "<|assistant|>" if role == who else f"<|user|>{role or ''}") + f"\n{text or ''}<|end|>\n"
        got = "".join(p.rendered for p in sorted(parts, key=lambda p: p.start))
        assert got == want
        for p in parts:
            assert got[p.start : p.end] == p.rendered and (p.mask_start is not None) == (p.role == who)
            assert p.mask_start is None or got[p.mask_start : p.mask_end].endswith("<|end|>")
    assert perspectives.perspectives(frame.limit(0)).count() == 0


def test_toxicity(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6)))
    rows, marks = [], []
    for i in range(400):
        w = [word() for _ in range(r.randint(3, 60))]
        if i % 3 == 0:
            w[r.randrange(len(w))] = "vile" + r.choice(["st", "ness", "ly"])
        rows.append(" ".join(w))
        marks.append(i % 3 == 0)
    net = toxicity.train(rows[:300], np.array(marks[:300]))
    s = toxicity.scores(net, pa.array([*rows[300:], "", None], pa.string()))
    y = np.array(marks[300:])
    assert ((s[:100] >= 0.7) == y).mean() > 0.9 and (s[100:] < 0.7).all()
    assert toxicity.train([], np.array([])) == 0.5
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    assert toxicity.with_scores(table(spark), toxicity.fitted(table(spark), labels)).where("score != 0.5").count() == 0


def test_network_against_plain_loops():
    """Forward pass word by word, and gradients by finite differences."""
    r = np.random.default_rng(5)
    letters = list("abcdefg")
    rows = [" ".join("".join(r.choice(letters, r.integers(2, 6))) for _ in range(n)) for n in (3, 20, 41)]
    words = toxicity.Words(*toxicity.tb.utf8(pa.array(rows, pa.large_string())))
    net = toxicity.Network(np.sort(words.names[::2]))
    windows, _ = words.windows()
    p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, _, _ = net.inputs(words)
    h, sig = toxicity.HIDDEN, lambda a: 1 / (1 + np.exp(-a))
    for row, got in zip(windows, net.logits(words, windows), strict=True):
        seen = [w for w in row if w < len(words.names)]
        states = []
        for side, order in (("f", seen), ("b", seen[::-1])):
            s, out = np.zeros(h), []
            for w in order:
                a, q = x[w] @ p[f"w{side}"] + p[f"c{side}"], s @ p[f"u{side}"]
                reset, keep = sig(a[:h] + q[:h]), sig(a[h : 2 * h] + q[h : 2 * h])
                s = keep * s + (1 - keep) * np.tanh(a[2 * h :] + reset * q[2 * h :])
                out.append(s)
            states.append(out if side == "f" else out[::-1])
        both = np.concatenate(states, axis=1)
        weight = np.exp(both @ p["v"])
        assert abs((weight / weight.sum()) @ both @ p["o"] + p["b"][0] - got) < 1e-4
    target, weight = np.arange(len(windows)) % 2.0, np.linspace(1, 2, len(windows))

    def loss():
        q = sig(net.logits(words, windows).astype(np.float64))
        return -(weight * (target * np.log(q) + (1 - target) * np.log(1 - q))).mean()

    for name, g in net.gradients(words, windows, target, weight).items():
        flat, g = net.p[name].reshape(-1), np.asarray(g).reshape(-1)
        for i in np.argsort(-np.abs(g))[:6]:
            old = flat[i]
            flat[i] = old + 0.01
            up = loss()
            flat[i] = old - 0.01
            down = loss()
            flat[i] = old
            assert abs((up - down) / 0.02 - g[i]) < 0.02 * abs(g[i]) + 2e-4, name


def test_empty_tables(spark):
    none = table(spark, []).limit(0)
    assert repeats.digests(none).count() == minhash.near_groups(none).count() == bpe.encode_and_decode(none).count() == spotsigs.compared(none).count() == 0
    assert toxicity.with_scores(none, 0.5).count() == 0


CLASHING = "doc_id long, text string, `__id` long, `__hash` string, `__kept` int, `__cut` int, `__text` string, `a.b` int, score double, n_items int, __own_text string"


def small_world(spark, d, rows, schema=SCHEMA):
    spark.createDataFrame([(1, 0)], "doc_id long, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(12)))], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame(rows, schema).write.parquet(f"{d}/documents.parquet")
    return spark.read.parquet(f"{d}/documents.parquet")


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    clean = [" ".join(f"u{i}x{j}" for j in range(40)) for i in range(4)]
    leak = "here " + " ".join(f"w{i}" for i in range(12))
    d = f"file://{tmp_path}/a"
    rows = table(spark, [*clean, clean[0] + " end", leak, "", None])
    docs = small_world(spark, d, rows.collect())
    for name, f in corpus_pipeline.STAGES[:-1]:
        docs = f(spark, docs, d)
        assert docs.columns == [x.split()[0] for x in SCHEMA.split(", ")], name
    assert sorted(r.doc_id if r.doc_id is not None else -1 for r in docs.collect()) == [-1, 0, 1, 2, 3, 6, 7]
    assert corpus_pipeline.run(spark, d).count() == 7
    # columns named like the stages' own are carried along untouched
    d = f"file://{tmp_path}/b"
    docs = small_world(spark, d, [(i, t, i, "h", i, i, "t", i, 0.5, i, "o") for i, t in enumerate([*clean, clean[0] + " end", leak])], CLASHING)
    for name, f in corpus_pipeline.STAGES[:-1]:
        docs, names = f(spark, docs, d), docs.columns
        assert docs.columns == names, name
    assert sorted(tuple(r) for r in docs.collect()) == [(i, clean[i], i, "h", i, i, "t", i, 0.5, i, "o") for i in range(4)]
    d = f"file://{tmp_path}/c"
    assert small_world(spark, d, []).count() == corpus_pipeline.run(spark, d).count() == 0


def test_edit_counts_as_columns(spark):
    encoder, known = bpe.encoder(bpe.default_path())
    docs = table(spark, [*texts()[:6], "", None])
    count = lambda t: len(encoder.encode(t, known)) // 4
    got = editcount.count_edited(docs.withColumnRenamed("score", "n_tokens")).collect()
    assert len(got) == docs.count()
    for r in got:
        text = r.text or ""
        assert r.n_tokens == count(text) and r.n_edits == 3
        for a, z, new in editcount.own_edits(text):
            a = min(a, len(text))
            text = text[:a] + new + text[min(max(z, a), len(text)) :]
        assert r.n_tokens_edited == count(text)
    assert editcount.count_edited(docs.limit(0)).count() == 0


def test_minhash_links_past_the_centre(spark, monkeypatch):
    """Edited texts, some longer than a sketch, in buckets that hold many groups; blocks far smaller than usual."""
    monkeypatch.setattr(minhash, "BLOCK", 4)
    r = random.Random(7)
    rows = []
    for size in (40, 1500):
        base = [f"w{r.randrange(9999)}" for _ in range(size)]
        for _ in range(40):
            edited = list(base)
            for _ in range(r.choice([1, size // 40, size // 30, size // 20])):
                edited[r.randrange(size)] = f"e{r.randrange(99999)}"
            rows.append(" ".join(edited))
    got = {r.doc_id: r.component_id for r in minhash.near_groups(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    words = [t.split() for t in rows]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in words]
    group = list(range(len(rows)))
    for _ in rows:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets[:i]):
                if 100 * len(a & b) >= 75 * len(a | b):
                    group[i] = group[j] = min(group[i], group[j])
    assert len(set(group)) > 10
    assert got == dict(enumerate(group))
