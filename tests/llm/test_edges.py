"""Cases that once gave wrong results or took too long, and brute-force versions of whole queries."""

import gzip
import hashlib
import math
import re
import time
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewater.llm import common, decontaminate, langid, neardup, quality, secrets, substrings, warc
from tidewater.llm.queries import QUERIES

SPACED = re.compile("[^\x20\x09-\x0d]+")
#: Two words of 1,024 letters that any sum of powers modulo 2**64 takes for one.
TWIN_A = "".join("ab"[bin(k).count("1") % 2] for k in range(1024))
TWIN_B = TWIN_A.translate(str.maketrans("ab", "ba"))


# ---- archives
def test_records_inside_payloads_are_no_records(spark, tmp_path):
    inner = b"".join(warc.record(f"urn:in:{k}", "response", "http://in", b"nested", 6, warc.digest(b"nested"), None) for k in range(6))
    payloads = [inner, b"see\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n", gzip.compress(inner), b"plain"]
    rows = [warc.record(f"urn:out:{k}", "response", "http://out", p, len(p), warc.digest(p), None) for k, p in enumerate(payloads)]
    (tmp_path / "x.warc").write_bytes(b"".join(rows))
    (tmp_path / "y.warc.gz").write_bytes(b"".join(warc.member(r) for r in rows))
    for name in ("x.warc", "y.warc.gz"):
        warc.register(spark)
        got = spark.read.format("warc").option("split", "300").option("payload", "true").load(str(tmp_path / name)).collect()
        assert sorted(bytes(r.payload) for r in got) == sorted(payloads)


def test_written_archives_are_cut_at_listed_records(spark, tmp_path):
    rows = [(k, f"http://p/{k}", "".join(chr(97 + (k * 7 + i) % 26) for i in range(400)) + str(k) + inner) for k in range(60) for inner in ("\r\n\r\nWARC/1.1\r\n",)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    files = warc.write_warc(pages, f"file://{tmp_path}/w", mark=600)
    read = spark.read.format("warc").option("split", "1000").option("payload", "true").load(",".join(files))
    assert read.rdd.getNumPartitions() > 3 * len(files)
    assert sorted((r.target_uri, bytes(r.payload).decode()) for r in read.collect()) == sorted((u, h) for _, u, h in rows)


def test_digests_that_a_header_lacks_are_found(spark, tmp_path):
    record = warc.record("urn:x:1", "response", "http://x", b"hello", 5, warc.digest(b"hello"), None)
    bare = re.sub(rb"WARC-Payload-Digest: [^\r]*\r\n", b"", record)
    (tmp_path / "a.warc").write_bytes(bare + record + record.replace(b"urn:x:1", b"urn:x:2"))
    read = warc.read_warc(spark, [f"{tmp_path}/a.warc"], payload=True)
    assert read.where(f"payload_digest = '{warc.digest(b'hello')}'").count() == 3
    assert read.where("payload_digest = 'X'").count() == 0 and read.where("record_id = 'urn:x:2'").count() == 1


def test_http_blocks_without_a_blank_line(spark, tmp_path):
    head = b"HTTP/1.1 204 No Content\r\nServer: x\r\n"
    record = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:h:1>\r\nContent-Type: application/http\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(head), head)
    (tmp_path / "a.warc").write_bytes(record * 2)
    got = warc.read_warc(spark, [f"{tmp_path}/a.warc"], payload=True).collect()
    assert [(r.payload_bytes, bytes(r.payload)) for r in got] == [(0, b"")] * 2


# ---- language
def test_marks_alone_are_no_letters(spark):
    model = langid.fit(spark.createDataFrame([(1, "some words", "en"), (2, "einige Wörter", "de")], "doc_id long, text string, lang string"))
    for text in ("❤️", "́", "1́ ️", "", None):
        assert langid.score(model, [text])[0] == ["und"]
    assert langid.score(model, ["é"])[0] != ["und"]


def test_language_equals_plain_naive_bayes(spark):
    rows = [(k, " ".join(f"{w}{(k * j) % 13}{w}" for j in range(30)), lang) for k, (w, lang) in enumerate([("the", "en"), ("und", "de"), ("que", "es")] * 8)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))

    def grams(text):
        letters = ["".join(c if unicodedata.category(c)[0] in "LM" else " " for c in text.lower())]
        joined = f" {re.sub(' +', ' ', letters[0]).strip()} "
        points = np.array([ord(c) for c in joined], np.uint32)
        return Counter(int(b) for n in langid.ORDERS for i in range(len(points) - n + 1) for b in [_bucket(points[i : i + n])])

    def _bucket(own):
        return next(int(b) for r, b in zip(*langid._buckets(own), strict=True) if True) if len(own) == 1 else int(langid._buckets(own)[1][-1])

    sums = {x: Counter() for x in ("en", "de", "es")}
    for _, text, lang in rows:
        sums[lang] += grams(text)
    used = len(set().union(*sums.values()))
    tests = ["the quick one", "und so weiter und so fort", "que pasa aqui", "x"]
    names, scores = langid.score(model, [*tests, None])
    for text, name in zip(tests, names, strict=False):
        log = {x: math.log(9 / 27) + sum(n * math.log((c[b] + 0.5) / (c.total() + 0.5 * used)) for b, n in grams(text).items()) for x, c in sums.items()}
        assert log[name] == pytest.approx(max(log.values()), abs=1e-3)
    assert names[-1] == "und" and scores[-1] == 0
    alone = [langid.score(model, [t]) for t in tests]
    assert [a[0][0] for a in alone] == names[:-1] and np.allclose([a[1][0] for a in alone], scores[:-1])


def test_language_sample_is_bounded_and_whole(spark):
    long = "zzz " * 3000 + "qqq"
    hot = spark.createDataFrame([(1, "a a a", "en")] * 50 + [(k, long, "de") for k in range(2, 30)], "doc_id long, text string, lang string")
    model = langid.fit(hot, rows=20)
    assert model.languages == ("de",)
    b = int(langid._buckets(np.array([ord(c) for c in "qqq"], np.uint32))[1][-1])
    assert model.weight[0, b] > model.weight[0].min()
    assert langid.fit(hot.where("doc_id = 1"), rows=20).languages == ("en",)


# ---- hashes
def test_words_that_differ_hash_apart(spark):
    tail = [f"w{k}" for k in range(60)]
    docs = spark.createDataFrame([(1, " ".join([TWIN_A, *tail[:30], TWIN_A, *tail])), (2, " ".join([TWIN_B, *(x + "!" for x in tail[:30])]))], "doc_id long, text string")
    data = np.frombuffer((TWIN_A + TWIN_B).encode(), np.uint8)
    assert len(set(common.word_hashes(data, np.array([0, 1024]), np.array([1024, 2048])).tolist())) == 2
    pair = spark.createDataFrame([(1, " ".join([TWIN_A, *tail])), (2, " ".join([TWIN_B, *tail]))], "doc_id long, text string")
    assert [r.n_removed for r in substrings.remove_repeats(pair).orderBy("doc_id").collect()] == [60, 60]
    assert [r.n_removed for r in substrings.remove_repeats(docs).collect()] == [0, 0]
    short = spark.createDataFrame([(1, TWIN_A), (2, TWIN_B)], "doc_id long, text string")
    assert dict(neardup.near_duplicates(short).collect()) == {1: 1, 2: 2}


@pytest.mark.parametrize("width", [1, 2, 3, 5, 15, 35])
def test_window_tables_depend_on_their_words_in_order(width):
    words = np.random.default_rng(width).integers(0, 3, 400).astype(np.uint64)
    table = common.window_table(words, width)
    known = {}
    for i, h in enumerate(table.tolist()):
        assert known.setdefault(tuple(words[i : i + width].tolist()), h) == h
    assert len(set(known.values())) == len(known)
    assert len(common.window_table(words[: width - 1], width)) == 0


# ---- near duplicates
def test_a_loop_at_the_end_keeps_the_link(spark):
    words = " ".join(f"w{k}" for k in range(300))
    docs = spark.createDataFrame([(1, words), (2, words + " again and again and on" * 200)], "doc_id long, text string")
    assert dict(neardup.near_duplicates(docs).collect()) == {1: 1, 2: 1}


@pytest.mark.parametrize("block", [4, 16])
def test_buckets_larger_than_a_block(spark, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    # chains: neighbours are alike, the ends are not, so one leader does not reach all
    rows = [(c * 1000 + k, " ".join(f"c{c}w{j}" for j in range(4 * k, 4 * k + 120))) for c in range(2) for k in range(40)]
    got = dict(neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), star_rounds=0).collect())
    assert got == {d: d // 1000 * 1000 for d, _ in rows}
    tables = [t.name for t in spark.catalog.listTables() if t.name.startswith("shingles_")]
    assert tables == []


# ---- benchmark items
def test_many_blocks_of_items(spark):
    items = [(k, " ".join(f"i{k}x{j}" for j in range(14))) for k in range(30)] + [(99, "short item")]
    docs = [(k, f"before {items[k % 31][1]} between {items[(k * 3) % 31][1]} after short ITEM!" if k % 2 else "nothing of that kind " * 9) for k in range(40)]
    docs_df, items_df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame(items, "item_id long, text string")
    one, many = ({r.doc_id: r for r in decontaminate.decontaminate(docs_df, items_df, block_bytes=b).collect()} for b in (1 << 20, 900))
    assert one == many and sum(r.contaminated for r in one.values()) == 20


# ---- secrets
@pytest.mark.parametrize("text", ["a" * 1_000_000 + " \\d 5% x", "ab1/" * 250_000 + " %zz \\x &#", "!" * 1_000_000 + "%41", "\\x" * 300_000, "a\n" * 300_000 + "%4", "secret " * 100_000, "password" + " " * 800_000])
def test_very_long_tokens_are_scanned_in_time(text):
    began = time.process_time()
    secrets.scan(text)
    assert time.process_time() - began < 5


def test_base_columns_against_brute_force(spark, sf):
    """Reads characters one by one, without the module's patterns."""
    alnum = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    names = ["password", "passwd", "secret", "token", "api_key", "apikey"]
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})

    def run(text, at, chars):
        end = at
        while end < len(text) and text[end] in chars:
            end += 1
        return end

    def assign(text, at):
        low = text[at : at + 8].translate(lower)
        name = next((n for n in names if low.startswith(n)), None)
        if name is None:
            return None
        at += len(name)
        at += at < len(text) and text[at] in "\"'"
        at = run(text, at, " ")
        if at >= len(text) or text[at] not in ":=":
            return None
        at = run(text, at + 1, " ")
        at += at < len(text) and text[at] in "\"'"
        end = run(text, at, alnum + "+/_.=-")
        return (end, end - at >= 6) if end > at else None

    def access(text, at):
        end = run(text, at + 4, alnum[:26] + alnum[52:]) if text.startswith("AKIA", at) else at
        return (end, end - at >= 20) if end > at + 4 else None

    def hexes(text, at):
        end = run(text, at, "0123456789abcdef")
        return (end, end - at >= 24) if end > at else None

    def brute(text):
        found = []
        for k, (kind, match) in enumerate((("assign", assign), ("access", access), ("hex", hexes))):
            at = 0
            while at < len(text):
                if got := match(text, at):
                    if got[1]:
                        found.append((at, k, got[0], kind))
                    at = got[0]
                else:
                    at += 1
        return sorted(found)

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    more = [(10**6 + k, t) for k, t in enumerate([None, "", "secret:token:abcdef", "API_KEY: 'abc/def+1' aPiKeY=123456", "AKIAAKIA" + "Q" * 20, "token = \"abcdef\nsecret='x'", "ſecret=abcdef toKen=abcdef", "f" * 24 + "g" + "0" * 50])]
    got = QUERIES["op10_secrets"](spark, sf).collect() + secrets.scan_secrets(spark.createDataFrame(more, "doc_id long, text string")).collect()
    texts |= dict(more)
    assert len(got) == len(texts)
    for r in got:
        want = brute(texts[r.doc_id] or "")
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(x[3] == k for x in want) for k in secrets.KINDS)
        assert r.base_sha256 == hashlib.sha256(",".join(f"{kind}:{a}:{b}" for a, _, b, kind in want).encode()).hexdigest()
        assert all(f"{kind}:{a}:{b}" in r.spans.split(",") for a, _, b, kind in want)


# ---- quality
def test_quality_keeps_other_columns_and_its_verdict_is_the_list(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rules = quality.fit(docs, labels)
    odd = docs.selectExpr("doc_id", "text", *(f"'{c}' AS _{c}" for c in "tbwzhls"), "1 AS __w")
    got = quality.judge(odd, rules).collect()
    assert all(r[f"_{c}"] == c for r in got for c in "tbwzhls") and all(r["__w"] == 1 for r in got)
    for r in got:
        text = r.text or ""
        letters = sum(unicodedata.category(c)[0] == "L" for c in text)
        words = max(r.n_words, 1)
        row = {
            "words": r.n_words, "word_length": r.word_chars / words, "symbols": r.n_symbols / words, "dup_lines": r.n_dup_lines, "repeats": r.n_repeat_words / words,
            "upper": sum(unicodedata.category(c) == "Lu" for c in text) / max(letters, 1), "letters": letters / max(r.word_chars, 1), "exclaim": sum(text.count(c) for c in "!?") / words,
            "digits": sum(text.count(c) for c in "0123456789") / max(r.word_chars, 1), "ends": sum(text.count(c) for c in ".,;:") / words,
        }
        assert r.kept == (not r.base_failed and not any(all(c.holds(row) for c in rule) for rule in rules))
    again = labels.unionByName(labels).unionByName(labels)
    assert quality.fit(docs.unionByName(docs), again) == rules


# ---- pipeline
def test_pipeline_keeps_columns_named_like_results(spark, sf):
    import corpus_pipeline

    names = ["n_words", "spans", "found", "lang_pred", "score", "_score", "_language", "contaminated", "hits", "row", "n", "class_id", "a.b"]
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    for name in names:
        docs = docs.withColumn(name, __import__("pyspark").sql.functions.lit(f"own {name}"))
    for name, function in corpus_pipeline.STAGES[:-1]:
        out = function(spark, docs, sf)
        assert out.columns == docs.columns, name
        got = out.collect()
        assert got and all(r[x] == f"own {x}" for r in got for x in names), name


def test_pipeline_drops_near_duplicates_without_moving_texts(spark, tmp_path):
    import corpus_pipeline

    words = [" ".join(f"w{k}x{j}" for j in range(80)) for k in range(40)]
    rows = [(k, words[k % 30], k) for k in range(60)] + [(7, words[31], 100), (7, words[32], 101), (200, words[33], 102), (200, words[34], 103), (None, words[0], 104), (None, None, 105), (300, None, 106)]
    table = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    table.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    want = Counter([*range(30), 200, 300, None, None])
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for docs in (table, spark.read.parquet(str(tmp_path / "documents.parquet"))):  # rows without a place in a file, and with one
            got = corpus_pipeline.near_duplicates(spark, docs, "")
            assert got.columns == docs.columns
            assert Counter(r.doc_id for r in got.collect()) == want
        single = docs.where("doc_id is null or doc_id not in (7, 37, 200)")
        found = corpus_pipeline.near_duplicates(spark, single, "")
        assert Counter(r.doc_id for r in found.collect()) == want - Counter([7, 200])
        assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_marked_keys_equal_a_semi_join(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "LISTED", 7)
    path = str(tmp_path / "rows")
    spark.range(1000).selectExpr("if(id % 11 = 0, null, id % 300) as k", "id as n").repartition(3).write.parquet(path)
    ids = spark.range(0, 300, 4)
    want = {r.n for r in spark.read.parquet(path).collect() if r.k is not None and r.k % 4 == 0}
    read = spark.read.parquet(path)
    for docs in (read, read.select("n", "k"), read.union(read.limit(0)), read.join(ids.limit(0), F.lit(False), "left").select("k", "n"), read.withColumn("_metadata", F.lit(1))):
        rows, condition = common.marked(docs, "k", ids)
        got = [r.n for r in rows.where(condition).collect()]
        assert set(got) == want and len(got) == len(want)
        assert rows.where(~condition).count() == 1000 - len(want)


def test_workers_drop_tables_of_other_operators(spark):
    from tidewater.llm import tokenizing
    from tidewater.llm.queries import tokenizer

    class Rows:
        def mapInArrow(self, function, schema):
            self.function = function
            return self

    rows = Rows()
    rows.sparkSession = spark
    neardup._sign(rows)
    tokenizing.encoder(tokenizer("byte_bpe_50k.json")).ids("some words")
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["a few words"])], names=["id", "t"])
    assert [b.num_rows for b in rows.function(iter([batch]))] == [1]
    assert not tokenizing._ENCODERS


def test_shuffle_files_go_when_a_table_is_staged(spark, tmp_path):
    tracker = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker()
    kept = spark.range(1000).repartition(3, "id")
    before = {*re.findall(r"\d+", str(tracker.shuffleStatuses().keys()))}
    common.stage(kept, "kept")
    time.sleep(1)
    assert {*re.findall(r"\d+", str(tracker.shuffleStatuses().keys()))} <= before
    assert spark.conf.get(common._CLEANUP) == "false"


def test_batches_of_long_texts_are_bounded(spark):
    texts = spark.range(64).selectExpr("id", "repeat(md5(cast(id as string)), 1 << 15) as text").coalesce(1)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["n"])

    langid.identify(spark.createDataFrame([(1, "a")], "id long, text string"), langid.Model((), np.zeros(0), np.zeros((0, langid.BUCKETS), np.float32)))
    seen = [r.n for r in texts.mapInArrow(sizes, "n long").collect()]
    assert len(seen) > 2 and max(seen) <= 2 * common.BATCH_BYTES


def test_substrings_leave_no_shuffle_files(spark):
    tracker = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker()
    text = " ".join(f"w{k}" for k in range(60))
    docs = spark.createDataFrame([(1, text), (2, text)], "doc_id long, text string")
    before = {*re.findall(r"\d+", str(tracker.shuffleStatuses().keys()))}
    found = substrings.remove_repeats(docs)
    time.sleep(1)
    assert {*re.findall(r"\d+", str(tracker.shuffleStatuses().keys()))} <= before
    assert [r.n_removed for r in found.collect()] == [60, 60]


def test_substrings_pack_the_hashes_of_a_chunk(spark):
    store = spark.sparkContext._jsc.sc().statusStore()

    def stages() -> dict:
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        found = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
        return {found.apply(k).stageId(): found.apply(k).shuffleWriteRecords() for k in range(found.size())}

    texts = [" ".join(f"w{k + 700 * (n // 2)}" for k in range(1000)) for n in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8, "doc_id")
    before = stages()
    found = substrings.remove_repeats(docs)
    got = {r.doc_id: r.n_removed for r in found.collect()}
    # the JVM reads a list of files again, and no texts
    assert re.findall(r"ReadSchema: struct<([^>]*)>", found._jdf.queryExecution().executedPlan().toString()) in (["part:bigint,name:string"], ["part:bigint,name:string"] * 2)
    windows = Counter(w for t in texts for w in zip(*[t.split()[i:] for i in range(35)], strict=False))
    for n, t in enumerate(texts):
        words = t.split()
        drop = {j for i in range(len(words) - 34) if windows[tuple(words[i : i + 35])] > 1 for j in range(i, i + 35)}
        assert got[n] == len(drop)
    # at most a row for each of 8 chunks and each bucket, a few times over; 40,000 windows are repeated
    assert sum(n for k, n in stages().items() if k not in before) < 1000


@pytest.mark.parametrize("buckets", [1, 3, 50])
def test_packed_places_are_those_of_repeated_hashes(buckets):
    rng = np.random.default_rng(buckets)
    reports, want, total = [], set(), Counter()
    for chunk in range(5):
        a, b = rng.choice(np.arange(1, 60, dtype=np.uint64) << np.uint64(58), 12), np.zeros(12, np.uint64)
        b[:] = (a >> np.uint64(60)) + np.uint64(chunk // 4) << np.uint64(32)  # the last chunk differs in these bits only
        reports.append((chunk, np.arange(12) + 10 * chunk, a, b))
        total.update(zip(a.tolist(), b.tolist(), strict=True))
    batches = [x for chunk, p, a, b in reports for x in substrings._reports(chunk, p, a, b, buckets)]
    for chunk, p, a, b in reports:
        seen = {}
        for k in range(12):
            seen.setdefault((int(a[k]), int(b[k])), int(p[k]))
        want |= {(chunk, place) for key, place in seen.items() if total[key] > 1}
    rows = pa.Table.from_batches(batches)
    got = set()
    for bucket in set(rows.column("bucket").to_pylist()):
        out = substrings._met_again(rows.filter(pa.compute.equal(rows.column("bucket"), bucket)))
        got |= {(r["chunk"], p) for r in out.to_pylist() for p in np.frombuffer(r["places"], np.int32).tolist()}
    assert got == want
