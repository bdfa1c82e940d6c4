"""Packing, token files, WARC archives, URL rules."""

import io
import zlib

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from shroud.llm import common, packing, queries, tokenfile, urlfilter, warc

from . import brute


def encode(name, texts, end):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.vocabulary(name))
    return [np.array([*e.ids, end], "<u4") for e in t.encode_batch(texts, add_special_tokens=False)]


ODD = ["hello <|endoftext|> world", "<|endoftext|><|endoftext|>", " <|startoftext|>a  b<|endoftext|>\n", "<|ENDOFTEXT|> <|endoftext|", "", " ", "a", " a", "a ", "a  b", "a \n b", "a\n\nb\n", "it's we'll\tx", "<|endoftext|> x", "ünï\u00a0cö\u2003d", "\u0301x \u0301y",
       "1234 567,8", "x" * 3000, "\n \n", "A B\r\nC", "don't  stop 'S", "a\x1cb c", "a.", "a, b.\nc.d, e..", ".", ", .", "1. 2,", "\nab", "ab\n", " ", "\n", "é. è,", "a.\n", "don't."]


@pytest.mark.parametrize("name,spaces", [(queries.BYTE_BPE, "leading"), (queries.WORD_BPE, "dropped")])
def test_pieces_give_the_ids_of_whole_texts(spark, name, spaces):
    texts = ODD + [r.text for r in brute.documents(spark).limit(60).collect()]
    tok = common.PieceTokenizer(queries.vocabulary(name), spaces, max_pieces=500)
    want = [x[:-1].tobytes() for x in encode(name, texts, 0)]
    assert tok.ids(texts) == want and tok.ids(texts) == want
    assert len(tok.known) <= 500


def check_pack(rows, ids, top=1024):
    """Every id in one piece, windows gapless; share of padding."""
    padded = total = 0
    windows, docs = {}, {}
    for r in rows:
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
        docs.setdefault(r.doc_id, []).append((r.start, r.length, r.ids, r.doc_tokens))
    for w in windows.values():
        at = 0
        for offset, n in sorted(w):
            assert offset == at and n > 0
            at += n
        assert at <= top
        padded += 0 if at & (at - 1) == 0 else top - at
        total += at
    assert docs.keys() == ids.keys()
    for i, pieces in docs.items():
        assert b"".join(bytes(p[2]) for p in sorted(pieces)) == ids[i].tobytes()
        assert all(len(p[2]) == 4 * p[1] and p[3] == len(ids[i]) for p in pieces)
    return padded / max(total, 1)


def test_packing_loses_no_id(spark):
    docs = brute.documents(spark)
    rows = packing.pack_documents(docs, queries.vocabulary(queries.BYTE_BPE), spaces="leading", block_tokens=20_000).collect()
    d = docs.collect()
    ids = dict(zip([r.doc_id for r in d], encode(queries.BYTE_BPE, [r.text for r in d], 0), strict=True))
    assert check_pack(rows, ids) < 0.02
    load = {}
    for r in {(r.step_group, r.sequence_id, r.tier) for r in rows}:
        load[r[0]] = load.get(r[0], 0) + r[2]
    assert all(r.tier >= r.length + r.offset for r in rows)


def test_pack_block_fills_windows_from_shorter_tiers():
    lengths = [(0, n) for n in (5000, 1000, 700, 600, 300, 200, 130, 100, 60, 24, 1)]
    windows, left = packing.pack_block(lengths, (64, 128, 256, 512, 1024), False)
    assert all(sum(p[2] for p in pieces) == size for size, pieces in windows)
    assert sum(s for s, _ in windows) + sum(p[2] for p in left) == sum(n for _, n in lengths)
    assert sum(p[2] for p in left) < 64
    assert any(len(pieces) > 1 and size == 1024 for size, pieces in windows)
    windows, left = packing.pack_block([(0, 70)], (64, 128), True)
    assert not left and windows[-1][0] == 128 and packing.pack_block([], (64,), True) == ([], [])


def test_step_groups_are_balanced():
    sizes = [1024] * 20 + [512] * 9 + [64] * 30
    groups = packing.step_groups(sizes, 4096)
    load = [sum(s for s, g in zip(sizes, groups, strict=True) if g == k) for k in range(max(groups) + 1)]
    assert max(load) - min(load) <= 1024


def test_packing_odd_rows(spark):
    rows = packing.pack_documents(brute.odd_documents(spark).where("doc_id is null or doc_id not in (5, 8)"),
                                  queries.vocabulary(queries.BYTE_BPE), spaces="leading").collect()
    assert {r.doc_id: r.doc_tokens for r in rows}[1] == 1 and sum(r.doc_id is None and r.start == 0 for r in rows) == 2
    assert packing.pack_documents(brute.empty_documents(spark), queries.vocabulary(queries.BYTE_BPE)).count() == 0
    with pytest.raises(ValueError):
        packing.pack_documents(brute.empty_documents(spark), "x", tiers=(100,))


def test_token_files_round_trip(spark):
    docs = brute.documents(spark)
    folder = tokenfile.token_folder(spark)
    manifest = tokenfile.write_token_files(docs, queries.vocabulary(queries.WORD_BPE), folder, spaces="dropped", frame_bytes=5000)
    got = {r.doc_id: r for r in tokenfile.read_token_files(manifest, folder).collect()}
    d = sorted(docs.collect())
    at = 0
    for r, ids in zip(d, encode(queries.WORD_BPE, [r.text for r in d], 2), strict=True):
        assert got[r.doc_id].start == at and bytes(got[r.doc_id].ids) == ids.tobytes() and got[r.doc_id].n_tokens == len(ids)
        at += len(ids)
    # files roll over at a bound of bytes or documents
    folder2 = tokenfile.token_folder(spark)
    small = tokenfile.write_token_files(docs, queries.vocabulary(queries.WORD_BPE), folder2, spaces="dropped", frame_bytes=5000, file_bytes=40_000, file_docs=9, shards=3)
    files = small.orderBy("shard", "part").collect()
    assert len(files) > 20 and all(f.docs <= 9 and (f.docs == 1 or 4 * f.tokens <= 40_000) for f in files)
    assert {r.doc_id: (r.start, bytes(r.ids)) for r in tokenfile.read_token_files(small, folder2).collect()} == {i: (r.start, bytes(r.ids)) for i, r in got.items()}
    some = {3, 77, 150}
    part = tokenfile.read_token_files(manifest, folder, some).collect()
    assert {r.doc_id for r in part} == some and all(r.start == got[r.doc_id].start for r in part)


def test_token_file_frames_and_checksums():
    out = io.BytesIO()
    w = tokenfile.FrameWriter(out, frame_bytes=40)
    data = {i: np.arange(i, dtype="<u4").tobytes() for i in (3, 9, 0, 30, 5)}
    for i, ids in data.items():
        w.add(i or None, ids)
    assert w.finish() == 5
    raw = out.getvalue()
    r = tokenfile.FrameReader(io.BytesIO(raw))
    assert {(i or 0): x for i, _, x in r.documents()} == data
    one = tokenfile.FrameReader(io.BytesIO(raw))
    assert [x for _, _, x in one.documents({30})] == [data[30]] and one.read_frames == 1
    # any decoder reads the frames in order and passes over the index and the table
    with zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw), read_across_frames=True) as s:
        assert s.read() == b"".join(data.values())
    broken = bytearray(raw)
    broken[8] ^= 0xFF
    with pytest.raises((ValueError, zstandard.ZstdError)):
        list(tokenfile.FrameReader(io.BytesIO(bytes(broken))).documents())


def test_token_files_odd_rows(spark):
    folder = tokenfile.token_folder(spark)
    docs = brute.odd_documents(spark)
    m = tokenfile.write_token_files(docs, queries.vocabulary(queries.WORD_BPE), folder, spaces="dropped")
    rows = sorted(tokenfile.read_token_files(m, folder).collect(), key=lambda r: r.start)
    assert len(rows) == 12 and [r.doc_id for r in rows][:4] == [None, None, 1, 2]
    assert rows[2].n_tokens == 1 and [r.doc_id for r in rows] == sorted([r.doc_id for r in rows], key=lambda x: (x is not None, x or 0))
    empty = tokenfile.token_folder(spark)
    m = tokenfile.write_token_files(brute.empty_documents(spark), queries.vocabulary(queries.WORD_BPE), empty)
    assert tokenfile.read_token_files(m, empty).count() == 0


PAGES = [(4, "http://a.net/x", "p" * 200), (2, "http://b.net/", "p" * 200), (9, None, "p" * 200), (5, "u", "short"), (6, "u", "short"),
         (7, "bad\r\nWARC-Type: revisit", None), (8, "", ""), (None, "n", "p" * 200), (10, "é://ü", "ß\r\n\r\nWARC/1.1\r\n" * 20)]


@pytest.mark.parametrize("compress", [True, False])
def test_warc_round_trip(spark, compress):
    pages = spark.createDataFrame([(*p, "clash") for p in PAGES], "page_id long, url string, html string, payload string")
    folder = warc.archive_folder(spark)
    warc.write_archives(pages, folder, compress=compress, archive_bytes=700)
    got = {r.page_id: r for r in warc.read_pages(spark, folder).collect()}
    assert len(got) == len(PAGES)
    for i, _, html in PAGES:
        raw = (html or "").encode()
        r = got[None if i is None else str(i)]
        again = html == "p" * 200 and i != 2
        assert (r.payload_bytes, r.payload_digest) == (len(raw), brute.sha(html or ""))
        assert (r.record_type, r.refers_to) == (("revisit", "2") if again else ("response", None))


def test_warc_filters_and_columns(spark):
    folder = warc.archive_folder(spark)
    warc.write_archives(spark.createDataFrame(PAGES, "page_id long, url string, html string"), folder)
    warc.register(spark)
    df = spark.read.format("warc").load(folder)
    assert {r.page_id for r in df.where("record_type = 'revisit'").collect()} == {"4", "9", None}
    hit = df.where(F.col("target_uri").startswith("http://") & F.col("record_type").isin("response", "metadata")).select("page_id", "payload")
    assert [(r.page_id, bytes(r.payload)) for r in hit.collect()] == [("2", b"p" * 200)]
    assert df.where("target_uri = 'u' and payload_length = 5").count() == 2
    plain = spark.read.format("warc").schema("page_id string").load(folder)
    assert plain.count() == len(PAGES)
    empty = warc.archive_folder(spark)
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), empty)
    assert warc.read_pages(spark, empty).count() == 0


def test_warc_skips_by_length_and_reads_foreign_members():
    recs = [warc.record({"WARC-Type": t, "X-Page-Id": i}, b"b" * (50_000 * i)) for i, t in enumerate(["response", "revisit", "response"])]
    with_length = b"".join(warc.member(r) for r in recs)
    c = [zlib.compressobj(6, zlib.DEFLATED, 31) for _ in recs]
    foreign = b"".join(x.compress(r) + x.flush() for x, r in zip(c, recs, strict=True))
    for raw in (with_length, foreign, b"".join(recs)):
        got = [(h["x-page-id"], len(p)) for h, p in warc.scan(io.BytesIO(raw), lambda h: h["warc-type"] == "response", True)]
        assert got == [("0", 0), ("2", 100_000)]
        assert [p for _, p in warc.scan(io.BytesIO(raw), lambda h: True, False)] == [b""] * 3


URLS = ["http://www.example.net/en/1", "https://EXAMPLE.net/de/", "http://m.example.com/de/x?y=/fr/", "http://example.com/de", "http://a.org/fr/z#q",
        "http://a.org/en/", "http://x.net", "http://notexample.net/en/", "ftp://org/fr/", None, "nothing", "http://", "x://y.net?z/", "http://example.net/en/a://b.com/de/"]


def slow_rule(host, path, rules):
    fit = [(len(h.split(".")) if h else 0, len(p), v, h + p) for v, h, p in rules
           if (not h or host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit, default=(0, 0, None, None), key=lambda x: (x[0], x[1], x[2] == "block"))[2:]


@pytest.mark.parametrize("bound", [100, 1])
def test_url_rules(spark, bound):
    rules = [*queries.URL_RULES, ("block", "a.org", "/fr"), ("allow", "a.org", "/fr"), ("block", "y.net", ""), ("block", "www.example.net", "/en/1")]
    pages = spark.createDataFrame([(i, u, "old") for i, u in enumerate(URLS + URLS)], "page_id long, url string, verdict string")
    table = spark.createDataFrame(rules, "verdict string, host string, path string")
    rows = urlfilter.judge_urls(pages, table, max_trie_rules=bound).collect()
    assert len(rows) == 2 * len(URLS)
    for r in rows:
        u = URLS[r.page_id % len(URLS)] or ""
        rest = u.partition("://")[2] if "://" in u else ""
        host = rest.split("/")[0].split("?")[0].split("#")[0]
        path = rest[len(host):].split("?")[0].split("#")[0]
        verdict, rule = slow_rule(host.lower(), path, rules)
        assert (r.host, r.path, r.rule, r.verdict) == (host.lower(), path, rule, verdict or "allow"), u


def test_url_rules_no_rows(spark):
    none = spark.createDataFrame([], "verdict string, host string, path string")
    pages = spark.createDataFrame([(1, "http://a.b/c")], "page_id long, url string")
    for bound in (10, -1):
        assert urlfilter.judge_urls(pages, none, default="block", max_trie_rules=bound).collect()[0].verdict == "block"
    assert urlfilter.judge_urls(pages.where("false"), none).count() == 0
