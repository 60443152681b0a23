"""Each training-data operator against brute force on a small table of awkward rows, and on empty tables."""

import base64
import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tidewater.llm import decontaminate, langid, neardup, packing, quality, secrets, substrings, tokencount, tokenfile, warc
from tidewater.llm.queries import QUERIES, tokenizer

SCHEMA = "doc_id long, text string, lang string, n_words string, id string, t string, chunk int, score string, start string, part int"
PROSE = " ".join(f"word{k} thing{k % 7}" for k in range(60))
TEXTS = [
    None, "", "   \n\t ", "one", "!!!", PROSE, PROSE, PROSE + " tail", PROSE.upper(), "Ünïcode 中文 😀 é " * 30, "a" * 5000, ("same line here now\n" * 40), "<|endoftext|> mid <|endoftext|>",
    "x" + " y" * 9000, "password = hunter2222 and AKIA" + "Q" * 20, " ".join(f"q{k}" for k in range(200)) + " " + PROSE,
]
ROWS = [(k, t, "en" if t and "中" not in t else None, "clash", "i", "t", 1, "s", "st", 0) for k, t in enumerate(TEXTS)]
ROWS += [ROWS[5], (None, PROSE, "en", None, None, None, None, None, None, None), (100, None, None, None, None, None, None, None, None, None), (7, "another text for the same number " * 5, "en", None, None, None, None, None, None, None)]
SPACED = re.compile("[^\x20\x09-\x0d]+")
PLAIN = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_warc(spark, tmp_path):
    rows = [(1, "http://a", "<p>x</p>"), (2, "http://b\r\nX: y", "<p>x</p>"), (3, None, None), (4, "u", ""), (9, "u", "é" * 3000), (None, "u", "<p>x</p>"), (2, "again", "<p>x</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumnRenamed("url", "url")
    files = warc.write_warc(pages, f"file://{tmp_path}/w")
    got = warc.read_warc(spark, files, payload=True).collect()
    assert len(got) == len(rows)
    by = {(r.record_id, r.target_uri): r for r in got}
    one = by["urn:page:1", "http://a"]
    assert (one.record_type, one.refers_to, one.payload_bytes, one.payload) == ("revisit", "urn:page:2", 8, None)
    assert one.payload_digest == base64.b32encode(hashlib.sha1(b"<p>x</p>").digest()).decode()
    assert sum(r.record_type == "response" and r.record_id == "urn:page:2" for r in got) == 2
    assert by["urn:page:3", None].refers_to == "urn:page:4" and by["urn:page:", "u"].record_type == "response"
    assert by["urn:page:9", "u"].payload.decode() == "é" * 3000
    read = spark.read.format("warc").option("split", "64").load(",".join(files))
    assert read.count() == len(rows) and read.where("record_type = 'revisit'").count() == 2
    assert warc.write_warc(pages.limit(0)) == [] and warc.read_warc(spark, []).count() == 0


def test_warc_reads_other_writers(tmp_path, spark):
    import gzip

    record = warc.record("urn:x:1", "response", "http://x", b"hello", 5, warc.digest(b"hello"), None)
    for name, raw in (("a.warc", record * 3), ("b.warc.gz", gzip.compress(record) * 3)):
        (tmp_path / name).write_bytes(raw)
    got = warc.read_warc(spark, [f"{tmp_path}/a.warc", f"{tmp_path}/b.warc.gz"], payload=True).collect()
    assert [r.payload for r in got] == [b"hello"] * 6
    (tmp_path / "a.warc").write_bytes(record.replace(b"hello", b"hellu"))
    with pytest.raises(Exception, match="digest"):
        warc.read_warc(spark, [f"{tmp_path}/a.warc"], payload=True).collect()


@pytest.mark.parametrize("n, top", [(1, 2), (2, 1), (255, 50000), (257, 3), (5000, 2**32), (70_000, 2**17), (530_000, 900)])
def test_token_blocks_come_back(n, top):
    ids = np.random.default_rng(n).integers(0, top, n).astype(np.uint32)[: tokenfile.BLOCK]
    block = tokenfile.encode_block(ids)
    assert (tokenfile.decode_block(block) == ids).all()
    for at in {0, 5, len(block) // 2, len(block) - 20, len(block) - 1}:
        try:  # the last bits of a lane may not matter
            assert (tokenfile.decode_block(block[:at] + bytes([block[at] ^ 0x55]) + block[at + 1 :]) == ids).all()
        except ValueError:
            pass


def test_token_coder_beats_zlib_and_the_static_entropy(sf):
    import pyarrow.parquet as pq

    from tidewater.llm.tokenizing import encoder

    texts = pq.read_table(f"{sf.replace('0.001', '0.01')}/documents.parquet").column("text").to_pylist()
    raw = b"".join(encoder(tokenizer("word_bpe_49k.json")).ids(t) + b"\x02\0\0\0" for t in texts)
    ids = np.frombuffer(raw, "<u4")
    blocks = [ids[k : k + tokenfile.BLOCK] for k in range(0, len(ids), tokenfile.BLOCK)]
    bits = 8 * sum(len(tokenfile.encode_block(x)) for x in blocks) / len(ids)
    share = np.bincount(ids)[np.unique(ids)] / len(ids)
    assert bits < 8 * sum(len(zlib.compress(x.tobytes(), 9)) for x in blocks) / len(ids)
    assert bits < -(share * np.log2(share)).sum()


def test_a_damaged_block_costs_no_other(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tokenfile, "BLOCK", 1 << 19)
    rng = np.random.default_rng(5)
    own = [rng.integers(0, 3000, n).astype("<u4").tobytes() for n in (0, 300_000, 1, 700_000, 40, 600_000, 5, 0)]
    with open(tmp_path / "x.twid", "wb") as f:
        writer = tokenfile.Writer(f, 2)
        for k, ids in enumerate(own):
            writer.add(k if k else None, ids)
        writer.close()
    read = lambda **kw: {r.doc_id: r.ids for r in tokenfile.read_tokens(spark, [{"file": str(tmp_path / "x.twid"), "documents": 8, "ids": writer.ids}], keep_ids=True, **kw).collect()}
    assert read() == {k or None: x for k, x in enumerate(own)}
    with open(tmp_path / "x.twid", "rb") as f:
        assert (tokenfile.Reader(f).block(1) == np.frombuffer(b"".join(own), "<u4")[tokenfile.BLOCK : 2 * tokenfile.BLOCK]).all()
    raw = bytearray((tmp_path / "x.twid").read_bytes())
    raw[writer.blocks[1][0] + 5000] ^= 1
    (tmp_path / "x.twid").write_bytes(raw)
    # the second block holds ids 524,288 to 1,048,575: parts of the documents 3 and 5, and document 4
    assert read(keep_damaged=True) == {k or None: None if k in (3, 4, 5) else bytes(x) for k, x in enumerate(own)}
    with pytest.raises(Exception, match="damaged|checksum|size"):
        read()


def test_token_files_roll(spark, monkeypatch):
    monkeypatch.setattr(tokenfile, "FILE_IDS", 50)
    path = tokenizer("word_bpe_49k.json")
    table = spark.createDataFrame([(5, "some words of a text that come again " * 3)] * 40 + [(None, None)], "doc_id long, text string")
    manifest = tokenfile.write_tokens(table, path, 2)
    got = tokenfile.read_tokens(spark, manifest).orderBy("start").collect()
    assert len(manifest) > 10 and len(got) == 41 and got[0].doc_id is None and len({r.ids_crc32 for r in got[1:]}) == 1
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()


def test_token_files(spark, docs, none):
    path = tokenizer("word_bpe_49k.json")
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    got = tokenfile.read_tokens(spark, tokenfile.write_tokens(docs, path, 2), keep_ids=True).collect()
    want = Counter((r[0], tuple([*library.encode(r[1] or "", add_special_tokens=False).ids, 2])) for r in ROWS)
    assert Counter((r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in got) == want
    ordered = sorted(got, key=lambda r: r.start)
    assert [r.start for r in ordered] == np.cumsum([0, *(r.n_tokens for r in ordered)])[:-1].tolist()
    assert [r.doc_id for r in ordered] == sorted((r.doc_id for r in ordered), key=lambda d: (d is not None, d or 0))
    assert all(r.ids_crc32 == zlib.crc32(r.ids) for r in got)
    assert tokenfile.write_tokens(none, path, 2) == [] and tokenfile.read_tokens(spark, []).count() == 0


def test_language(spark, sf, docs, none):
    model = langid.fit(docs)
    got = langid.identify(docs, model).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 for r in got)
    assert {r.lang_pred for r in got if r.text in (None, "", "!!!", "   \n\t ")} == {"und"}
    assert langid.identify(none, langid.fit(none)).count() == 0
    assert {r.lang_pred for r in langid.identify(docs, langid.fit(none)).collect()} == {"und"}
    held = QUERIES["op3_language"](spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").collect()
    right = sum(r.lang == r.lang_pred for r in held)
    assert right >= 0.95 * len(held)


def test_token_counts(docs, none):
    count = tokencount.counter(tokenizer("piece_bpe_32k.model"))
    got = tokencount.token_counts(docs, tokenizer("piece_bpe_32k.model"), budget=10, store=True).collect()
    assert len(got) == len(ROWS)
    for r in got:
        stored = np.frombuffer(r.prefix_counts, "<i4")
        assert r.n_tokens == len(count.model.encode(r.text or "")) == stored[-1]
        cut = (r.text or "")[: r.fit_chars]
        assert len(count.model.encode(cut)) <= 10 or not cut
    for text in ("héllo  wörld\n\nab 中文😀", "▁▁ a", "1234 5x"):
        assert [int(x) for x in count.prefix_counts(text)][1:] == [len(count.model.encode(text[:i])) for i in range(1, len(text) + 1)]
    assert tokencount.token_counts(none, tokenizer("piece_bpe_32k.model")).count() == 0


def test_decontamination(spark, docs, none):
    items = spark.createDataFrame([(1, PROSE[:200]), (2, "Q3, Q4!"), (2, "q3 q4"), (None, "one"), (3, None), (4, ""), (5, "absent words here")], "item_id long, text string")
    for block in (1 << 20, 50):
        got = decontaminate.decontaminate(docs, items, block_bytes=block).collect()
        assert len(got) == len(ROWS)
        for r in got:
            words = PLAIN.findall((r.text or "").translate(LOWER))
            hit, found = [False] * len(words), set()
            for i, t in [(x.item_id, x.text) for x in items.collect()]:
                w = PLAIN.findall((t or "").translate(LOWER))
                for k in range(max(1, len(w) - 9)) if w else ():
                    window = w[k : k + 10]
                    for p in range(len(words) - len(window) + 1):
                        if words[p : p + len(window)] == window:
                            hit[p : p + len(window)] = [True] * len(window)
                            found.add(i)
            names = sorted(str(x) for x in found if x is not None)
            assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (len(words), sum(hit), len(names), any(hit))
            assert r.items_sha256 == hashlib.sha256(",".join(names).encode()).hexdigest()
            assert sum(len(PLAIN.findall(r.text.translate(LOWER)[s.start : s.end])) for s in r.hits) == sum(hit)
    assert decontaminate.decontaminate(none, items).count() == 0
    assert not any(r.contaminated for r in decontaminate.decontaminate(docs, items.limit(0)).collect())


def test_substrings(docs, none):
    got = substrings.remove_repeats(docs).collect()
    words = [SPACED.findall(r[1] or "") for r in ROWS]
    windows = Counter(tuple(w[i : i + 35]) for w in words for i in range(len(w) - 34))
    want = Counter()
    for r, w in zip(ROWS, words, strict=True):
        drop = [False] * len(w)
        for i in range(len(w) - 34):
            if windows[tuple(w[i : i + 35])] > 1:
                drop[i : i + 35] = [True] * 35
        kept = " ".join(x for x, d in zip(w, drop, strict=True) if not d)
        want[r[0], len(w), sum(drop), kept, hashlib.sha256(kept.encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_text, r.kept_sha256) for r in got) == want
    assert got[0].id in ("i", None)
    assert substrings.remove_repeats(none).count() == 0


def test_difference_cover():
    for shift in range(substrings.PERIOD):
        assert any((c - shift) % substrings.PERIOD in substrings.COVER for c in substrings.COVER)


def test_packing(docs, none):
    path = tokenizer("byte_bpe_50k.json")
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    got = packing.pack(docs, path, 1, keep_ids=True).collect()
    want = Counter((r[0], tuple([*library.encode(r[1] or "", add_special_tokens=False).ids, 1])) for r in ROWS)
    assert sum(len(k[1]) * n for k, n in want.items()) == sum(r.length for r in got)
    assert Counter(r.doc_id for r in got if r.start == 0) == Counter(r[0] for r in ROWS)
    windows: dict = {}
    for r in got:
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length <= 8192
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length, r.padded_length))
    assert sorted(windows) == list(range(len(windows)))
    for own in windows.values():
        own.sort()
        assert [x[0] for x in own] == np.cumsum([0, *(x[1] for x in own)])[:-1].tolist()
        filled = sum(x[1] for x in own)
        assert filled <= 2048 and {x[2] for x in own} == {filled if filled & (filled - 1) == 0 else 2048}
    assert packing.pack(none, path, 1).count() == 0


def test_best_fit_decreasing():
    rng = np.random.default_rng(3)
    lengths = np.minimum(rng.exponential(300, 1500).astype(int) + 1, 2048)
    plan = packing.Plan({int(k): int(n) for k, n in zip(*np.unique(lengths, return_counts=True), strict=True)})
    bins: list[int] = []
    for length in sorted(lengths.tolist(), reverse=True):
        fits = [(room, k) for k, room in enumerate(bins) if room >= length]
        if fits:
            bins[min(fits)[1]] -= length
        else:
            bins.append(2048 - length)
    size = np.sort(lengths)
    rank = np.arange(len(size)) - np.searchsorted(size, size)
    sequence, offset, _ = plan.place(size, rank)
    filled = np.bincount(sequence, weights=size, minlength=plan.n_sequences)
    assert sorted(bins) == sorted((2048 - filled).astype(int).tolist())
    assert len({(s, o) for s, o in zip(sequence.tolist(), offset.tolist(), strict=True)}) == len(size)


def test_quality(spark, docs, none):
    rules = [(quality.Condition("symbols", True, 0.5),), (quality.Condition("words", True, 5000.0), quality.Condition("upper", False, 0.5))]
    got = quality.judge(docs, rules).collect()
    assert len(got) == len(ROWS)
    for r in got:
        text = r.text or ""
        w = SPACED.findall(text)
        c = Counter(zip(w, w[1:], w[2:], strict=False))
        repeated = {j for i in range(len(w) - 2) if c[w[i], w[i + 1], w[i + 2]] > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in text.split("\n") if SPACED.search(x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(text.count(x) for x in "#*$%&|<>"), len(lines) - len(set(lines)), len(repeated))
        assert r.base_failed == (len(w) < 50 or 100 * len(repeated) > 50 * len(w))
        assert not (r.kept and r.base_failed)
    plan = quality.judge(docs, rules)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
    labels = spark.createDataFrame([(5, 1, 0), (None, 0, 0), (6, None, 0)], "doc_id long, quality int, toxic int")
    assert quality.fit(docs, labels) == [] and quality.fit(none, labels.limit(0)) == []
    assert quality.judge(none, []).count() == 0


def test_decision_list_finds_a_planted_rule():
    rng = np.random.default_rng(0)
    rows = [({"a": float(x), "b": float(y)}, bool(x > 0.7 and y < 0.4)) for x, y in rng.random((900, 2))]
    rules = quality.learn(rows)
    wrong = sum(any(all(c.holds(r) for c in rule) for rule in rules) != bad for r, bad in rows)
    assert rules and wrong <= 20


def test_near_duplicates(spark, docs, none):
    words = [f"w{k}" for k in range(300)]
    near = [(200 + k, " ".join(words[:k] + [f"new{k}"] + words[k + 1 :])) for k in range(0, 60, 3)]
    far = [(300 + k, " ".join(f"z{k}_{i}" for i in range(50))) for k in range(5)]
    extra = spark.createDataFrame([(k, t, "en", *[None] * 7) for k, t in near + far], SCHEMA)
    table = docs.unionByName(extra)
    rows = [(r.doc_id, r.text) for r in table.collect()]
    got = neardup.near_duplicates(table).collect()
    assert Counter(r.doc_id for r in got) == Counter(d for d, _ in rows)

    def grams(text):
        w = PLAIN.findall((text or "").translate(LOWER))
        return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()

    def alike(x, y):
        both = len(x.keys() & y.keys())
        if not both:
            return False
        plain = both / len(x.keys() | y.keys())
        prob = sum(1 / sum(max(x[e] / x[d], y[e] / y[d]) for e in x.keys() | y.keys()) for d in x.keys() & y.keys()) if plain < 0.8 else 0
        return max(plain, prob) >= 0.8

    parent = {d: d for d, _ in rows if d is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    known = [(d, t, grams(t)) for d, t in rows if d is not None]
    for i, (a, s, x) in enumerate(known):
        for b, t, y in known[:i]:
            if (s and s == t) or alike(x, y):
                low, high = sorted((find(a), find(b)))
                parent[high] = low
    assert {r.doc_id: r.class_id for r in got} == {d: find(d) for d in parent} | {None: None}
    assert neardup.near_duplicates(none).count() == 0


def test_probminhash_estimates_weighted_similarity():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 2**63, 400).astype(np.uint64)
    a, b = np.arange(300), np.arange(60, 400)
    wa, wb = np.ones(300), np.ones(340)
    sig = neardup.signatures(np.r_[np.zeros(300, int), np.ones(340, int)], np.r_[h[a], h[b]], np.r_[wa, wb], 2, 4000)
    assert abs((sig[0] == sig[1]).mean() - 240 / 400) < 0.04


def test_components(spark):
    links = spark.createDataFrame([(k + 1, k) for k in range(1, 40)] + [(90, 80), (80, 85), (70, 70)], "a long, b long")
    got = {r.id: r.root for r in neardup.components(links).collect()}
    assert {k: got.get(k, k) for k in [*range(1, 41), 80, 85, 90]} == dict.fromkeys(range(1, 41), 1) | {80: 80, 85: 80, 90: 80}


def test_secrets(docs, none):
    got = secrets.scan_secrets(docs).collect()
    assert len(got) == len(ROWS)
    assert all(r.spans == "" and r.n_assign == 0 for r in got if not r.text)
    own = next(r for r in got if r.text and r.text.startswith("password"))
    assert own.spans == "assign:0:21,access:26:50" and (own.n_assign, own.n_access, own.n_hex) == (1, 1, 0)
    clean = {r.text for r in secrets.redact(secrets.scan_secrets(docs)).collect()}
    assert "[secret] and [secret]" in clean
    assert secrets.scan_secrets(none).count() == 0


@pytest.mark.parametrize("layers", [("b64",), ("url",), ("uni",), ("gz", "b64"), ("b64", "b64"), ("zlib", "b64", "url"), ("b64", "uni")])
def test_nested_secrets(layers):
    import gzip
    import urllib.parse

    wrap = {
        "b64": lambda b: base64.b64encode(b), "url": lambda b: "".join(f"%{c:02x}" for c in b).encode(), "uni": lambda b: "".join(f"\\u{c:04x}" for c in b).encode(), "gz": gzip.compress, "zlib": zlib.compress,
    }
    raw = b"password=hunter22abc"
    for layer in layers:
        raw = wrap[layer](raw)
    inner = raw.decode()
    text = f"é before {inner} after"
    base, every = secrets.scan(text)
    assert not base and [k for _, _, k in every] == ["assign"]
    start, end, _ = every[0]
    assert 9 <= start < end <= 9 + len(inner)


def test_base_spans_are_leftmost_and_whole():
    assert secrets.base_spans("secret:token:abcdef") == []
    assert secrets.base_spans("API_KEY: 'abc/def+1' aPiKeY=123456") == [(0, 19, "assign"), (21, 34, "assign")]
    assert secrets.base_spans("0" * 23) == [] and secrets.base_spans("g" + "0" * 24) == [(1, 25, "hex")]


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, function in corpus_pipeline.STAGES[:-1]:
        out = function(spark, docs, sf)
        assert out.dtypes == docs.dtypes, name
        empty = function(spark, docs.limit(0), sf)
        assert empty.count() == 0 and empty.columns == docs.columns, name
        docs = corpus_pipeline.staged(out, name)
    assert docs.count() > 100
    packed = corpus_pipeline.pack(spark, docs, sf)
    assert packed.select("doc_id").distinct().count() == docs.count()


def test_hot_leader_is_dealt_in_copies(spark, monkeypatch):
    monkeypatch.setattr(neardup, "SHARE", 3)
    base = [f"word{k}" for k in range(200)]
    rows = [(k, " ".join([*base, f"tail{k}"])) for k in range(40)] + [(100 + k, " ".join(f"other{k}x{j}" for j in range(60))) for k in range(5)]
    got = dict(neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == {k: 0 if k < 40 else k for k, _ in rows}


@pytest.mark.parametrize("star_rounds", [2, 0])
def test_repeated_passage_keeps_plain_similarity(spark, star_rounds):
    rows = []
    for k in range(12):
        words, line = " ".join(f"v{k}_{i}" for i in range(100)), " ".join(f"u{k}_{i}" for i in range(12))
        rows += [(2 * k, f"{words} {line}"), (2 * k + 1, f"{words} " + f"{line} " * 20)]
    got = dict(neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), star_rounds=star_rounds).collect())
    assert got == {d: d - d % 2 for d, _ in rows}


_SECRET = "password=hunter22abc"
_QUOTED = "".join(f"%{ord(c):02x}" for c in _SECRET)
_UNITS = "".join(f"\\u{ord(c):04x}" for c in _SECRET)
_TOKEN = base64.b64encode(_SECRET.encode()).decode()


@pytest.mark.parametrize("text", [
    f"?q=caf%E9&x={_QUOTED}", f"?a=%00&x={_QUOTED}&b=%FF", f'{{"m":"\\ud83d\\ude00","n":"{_UNITS}"}}', f'"\\ud83d","{_UNITS}"',
    f"https://host/cb/{_TOKEN}", f"https://hosts/cb/{_TOKEN}", base64.b64encode(b"\x00\xff\x01" + _SECRET.encode() + b"\x00\xfe").decode(),
    "\n".join(re.findall(".{1,10}", base64.b64encode(f"some words {_SECRET} and more".encode()).decode())),
])
def test_layers_beside_odd_characters(text):
    assert _SECRET not in text
    assert "assign" in [kind for _, _, kind in secrets.scan(text)[1]]


@pytest.mark.parametrize("filler", ["x é " * 700_000, "é" * 700_000 + " "])
@pytest.mark.parametrize("kind", ["gzip", "zlib", "bz2", "lzma"])
def test_secrets_behind_a_megabyte(kind, filler):
    raw = __import__(kind).compress(f"x{filler}{_SECRET} {filler}AKIA{'Q' * 20}".encode())
    text = "see " + base64.b64encode(raw).decode() + " end"
    assert secrets.scan(text)[1] == [(4, len(text) - 4, "assign"), (4, len(text) - 4, "access")]


def test_secrets_in_the_second_member(monkeypatch):
    import gzip

    text = base64.b64encode(gzip.compress(b"nothing to be seen") + gzip.compress(_SECRET.encode())).decode()
    assert secrets.scan(text)[1] == [(0, len(text), "assign")]
    for x, n in (("RATIO", 0), ("SPARE", 10)):
        monkeypatch.setattr(secrets, x, n, raising=False)
    assert secrets.scan(text)[1] == [(0, len(text), "unread")]
