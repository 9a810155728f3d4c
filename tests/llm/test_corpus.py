"""Corpus operators against plain versions, over a table with the awkward cases."""

import base64
import hashlib
import random
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from decisionlog.llm import components, decontaminate, jaccard, packing, pieces, quality, queries, sharding, substrings, suffixes, url_filter, warc  # noqa: F401
from decisionlog.llm.shared import shared_folder
from decisionlog.llm.textscan import mix
from tests.llm import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_words int, ids string, component_id string"


def prose(seed, n):
    draw = random.Random(seed)
    return " ".join("".join(draw.choice(["an", "the", "ti", "ö", "re", "st", "ha"]) for _ in range(draw.randint(1, 4))) for _ in range(n))


def corpus():
    base, passage = prose(1, 120), prose(2, 40)
    texts = [base, base, base.replace(" ", "  ", 3), base + " more", prose(3, 90), "", None, "one two", "One TWO", "   ", passage + " " + prose(4, 60), prose(5, 50) + " " + passage]
    texts += [base[: len(base) // 2] + " changed here " + base[len(base) // 2 :], "\n".join(["same line here"] * 30), "x" * 5000, prose(6, 4000), prose(6, 3900) + " end", "# $ % & * " * 9, "a b " * 300]
    texts += [prose(7, 30) + "\n" + prose(7, 30), "word " * 13, "word " * 14, "é" * 900 + " " + "é" * 900, "tail\u3000of ＡＢＣ ① ▁ mark"]
    return [(i, t, "en", "src0", 1, "x", "y") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def odd(spark):
    """Null ids and repeated rows."""
    rows = corpus()
    return spark.createDataFrame([*rows, rows[0], rows[10], (None, rows[0][1], None, None, None, None, None), (None, None, None, None, None, None, None)], SCHEMA)


@pytest.fixture(scope="module")
def texts():
    return {r[0]: r[1] for r in corpus()}


def test_near_groups(spark, docs, odd, texts):
    for width, percent in ((4, 85), (5, 80)):
        want = brute.near_groups(texts, width, percent)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_groups(docs, width=width, percent=percent).collect()}
        assert got == want
    rows = jaccard.near_groups(odd).collect()
    assert len(rows) == odd.count() and all(r.component_id is None for r in rows if r.doc_id is None)
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, (_, c) in want.items() if c == i)
    assert jaccard.near_groups(docs.limit(0)).count() == 0


def test_near_groups_in_tiles(spark, monkeypatch):
    draw = random.Random(9)
    base = prose(11, 60).split()
    texts = {}
    for i in range(70):
        w = list(base)
        for _ in range(draw.randint(0, 3)):
            w[draw.randrange(len(w))] = f"v{draw.randrange(40)}"
        texts[i] = " ".join(w)
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_groups(df).collect()}
    assert got == brute.near_groups(texts, 4, 85)


def test_heavy_shingles_keep_their_links(monkeypatch):
    monkeypatch.setattr(jaccard, "FLUSH", 5)
    monkeypatch.setattr(jaccard, "HEAVY", 3)
    import pyarrow as pa

    from decisionlog.llm.packed import dealt_table

    draw = np.random.default_rng(0)
    entries = [(t, int(r), 100 + int(r) % 3 * 40) for t in range(4) for r in draw.choice(30, 12, replace=False)]
    batches = []
    for at in range(0, len(entries), 5):
        t, r, n = (np.array(c) for c in zip(*entries[at : at + 5], strict=True))
        batches += dealt_table(t.astype(np.uint64), 1, at, ["tokens", "refs", "sizes"], r.astype(np.int64), n.astype(np.uint32)).to_batches()
    groups = defaultdict(set)
    for out in jaccard._hubs(85)(iter(batches)):
        for hub, member in zip(*(c.to_pylist() for c in pa.Table.from_batches([out]).columns), strict=True):
            groups[hub] |= {hub, member}
    for t, a, m in entries:
        for u, b, n in entries:
            if t == u and a != b and 100 * min(m, n) >= 85 * max(m, n):
                assert any({a, b} <= g for g in groups.values())


def test_components(spark):
    draw = random.Random(4)
    links = [(draw.randrange(300), draw.randrange(300)) for _ in range(180)] + [(k, k + 1) for k in range(400, 480)]
    label = {x: x for link in links for x in link}
    for _ in range(300):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {n: r for n, r in label.items() if n != r}


def test_repeated_passages(spark, docs, odd, texts):
    gone = brute.repeated_words(texts, 13)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.dedup_report(docs).collect()}
    for i, t in texts.items():
        kept = [w for w, g in zip(brute.words(t), gone[i], strict=True) if not g]
        assert got[i] == (len(gone[i]), sum(gone[i]), hashlib.sha256(" ".join(kept).encode()).hexdigest()), i
    out = substrings.remove_repeats(docs)
    assert out.columns == docs.columns
    want = {i: t if not any(gone[i]) else brute.without_words(t, gone[i]) for i, t in texts.items() if not gone[i] or not all(gone[i])}
    assert {r.doc_id: r.text for r in out.collect()} == want
    rows = substrings.dedup_report(odd).collect()
    assert len(rows) == odd.count() and all(r.n_removed == 0 for r in rows if r.doc_id is None or r.doc_id == 0)
    assert substrings.dedup_report(docs.limit(0)).count() == 0


def test_repeated_bytes(spark, docs, odd):
    for table in (docs, odd):
        rows = table.select("doc_id", "text").collect()
        want = sorted((r.doc_id is None, r.doc_id or 0, *w) for r, w in zip(rows, brute.repeated_bytes([r.text for r in rows], 400), strict=True))
        got = sorted((r.doc_id is None, r.doc_id or 0, *r[1:]) for r in suffixes.dedup_report(table).collect())
        assert got == want
    assert suffixes.dedup_report(docs.limit(0)).count() == 0


def test_repeated_bytes_of_long_texts(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "UNIT_BYTES", 1500)
    a, b = prose(20, 900), prose(21, 900)
    rows = [a, b + a[1000:4000], "z" * 3000, a[:420] + "?" + a[421:900], b[10:500]]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = [tuple(r)[1:] for r in suffixes.dedup_report(df).orderBy("doc_id").collect()]
    assert got == brute.repeated_bytes(rows, 400)


def test_leaks(spark, docs, odd, texts):
    items = [(3, texts[4][:120]), (12, "Two"), (20, texts[10]), (7, ""), (8, None), (9, "one, TWO"), (9, "one, TWO")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.leak_report(docs, benchmark).collect()}
    clean = {}
    for i, t in texts.items():
        w, hit, found = brute.leaks(t, items, 10)
        r = got[i]
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (len(w), sum(hit), len(found), any(hit)), i
        assert r.items_sha256 == hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        if not any(hit):
            clean[i] = t
    assert {r.doc_id: r.text for r in decontaminate.remove_leaks(docs, benchmark, remove="documents").collect()} == clean
    left = {r.doc_id: r.text for r in decontaminate.remove_leaks(docs, benchmark).collect()}
    assert clean.items() <= left.items() and 7 not in left and "Two" not in (left.get(8) or "")
    assert decontaminate.leak_report(odd, benchmark).count() == odd.count()
    assert decontaminate.leak_report(docs, benchmark.limit(0)).filter("contaminated").count() == 0


def test_leaks_of_items_without_id(spark, docs, texts):
    benchmark = spark.createDataFrame([(None, texts[10]), (None, texts[4]), ("i1", texts[4]), (None, None)], "item_id string, text string")
    got = {r.doc_id: r for r in decontaminate.leak_report(docs, benchmark).collect()}
    named, none = hashlib.sha256(b"i1").hexdigest(), hashlib.sha256(b"").hexdigest()
    assert (got[10].n_items, got[10].items_sha256, got[10].contaminated, got[10].n_hit) == (1, none, True, got[10].n_words)
    assert (got[4].n_items, got[4].items_sha256, got[4].contaminated) == (2, named, True)
    left = {r.doc_id for r in decontaminate.remove_leaks(docs, benchmark).collect()}
    assert left.isdisjoint({4, 10})

    db = duckdb.connect()
    text = "NULL" if texts[10] is None else "'" + texts[10].replace("'", "''") + "'"
    db.execute(f"create table documents as select 10 as doc_id, {text} as text")
    db.execute("create table benchmark as select CAST(NULL AS VARCHAR) as item_id, text from documents")
    assert db.execute(queries.OP8_SQL).fetchall() == [tuple(decontaminate.leak_report(docs.filter("doc_id = 10"), benchmark.limit(1)).first())]


def test_leaks_in_slices(spark, docs, texts, monkeypatch):
    benchmark = spark.createDataFrame([(1, texts[4]), (2, texts[10])], "item_id long, text string")
    whole = sorted(map(tuple, decontaminate.leak_report(docs, benchmark).collect()))
    monkeypatch.setattr(decontaminate, "SLICE_WINDOWS", 40)
    assert sorted(map(tuple, decontaminate.leak_report(docs, benchmark).collect())) == whole


def test_texts_cut_in_some_batches_only(spark, docs, texts):
    """Partitions of several batches, of which some are left as they are."""
    benchmark = spark.createDataFrame([(3, texts[4][:120])], "item_id long, text string")
    one = docs.coalesce(1)
    want = [sorted(map(tuple, f.collect()), key=str) for f in (decontaminate.remove_leaks(one, benchmark), substrings.remove_repeats(one))]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        assert [sorted(map(tuple, f.collect()), key=str) for f in (decontaminate.remove_leaks(one, benchmark), substrings.remove_repeats(one))] == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_quality(spark, docs, odd, texts):
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.kept) for r in quality.report(docs).collect()}
    want = {i: brute.quality(t) for i, t in texts.items()}
    assert got == want
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, w in want.items() if w[-1]}
    assert quality.report(odd).count() == odd.count() and quality.report(docs.limit(0)).count() == 0
    plan = quality.keep_good(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_url_filter(spark):
    urls = [None, "", "no scheme", "http://A.Example.com/en/x?q", "https://www.example.com/en/", "http://x.net/es/1", "http://x.org/a/", "https://X.org/a?utm_source=1", "x://y.org", "http://com", "http://com/", "://a.b/c://d"]
    pages = spark.createDataFrame([(i, u, "z") for i, u in enumerate(urls)] + [(3, urls[3], "z")], "page_id long, url string, verdict string")
    listed = spark.createDataFrame([("x.org/a",), ("x.org/a",), (None,), ("other/z",)], "u string")
    rows = {r.page_id: r for r in url_filter.filter_urls(pages, listed, queries.URL_RULES).collect()}
    assert len(rows) == 12 and (rows[3].host, rows[3].path, rows[3].rule, rows[3].verdict) == ("a.example.com", "/en/x", "example.com/en/", "block")
    assert (rows[0].host, rows[0].path, rows[0].rule, rows[0].verdict) == ("", "", None, "allow")
    assert rows[4].rule == "www.example.com/en/" and rows[5].verdict == "block" and rows[9].rule is None and rows[10].rule == "com/"
    assert [rows[i].verdict for i in (6, 7, 8)] == ["block", "block", "allow"] and rows[11].host == "a.b"
    assert url_filter.filter_urls(pages, listed.limit(0), []).filter("verdict = 'block'").count() == 0
    # the filter never loses a listed key
    many = spark.range(5000).selectExpr("concat('h', id, '.org/p') AS url")
    some = url_filter.filter_urls(many.selectExpr("1L AS page_id", "concat('http://', url) AS url"), many.limit(2000), [])
    assert some.filter("listed").count() == 2000 and some.filter("possible and not listed").count() < 100


def test_sharding(spark, docs):
    shards = [f"s{k}" for k in range(7)]
    owner = sharding.lookup_table(shards, 1009)
    count = np.bincount(owner)
    assert count.max() - count.min() <= 1 and len(count) == 7
    less = sharding.lookup_table(shards[:-1], 1009)
    moved = (np.array(shards)[owner] != np.array(shards)[less]) & (owner != 6)
    assert moved.sum() < 1009 * 0.15
    placed = sharding.place(docs.withColumn("shard", docs.doc_id), ["doc_id"], shards, 1009)
    assert set(placed.columns) == {*docs.columns, "shard"}
    slots = {r.doc_id: r.slot for r in docs.select("doc_id", sharding.slot_of([docs.doc_id], 1009).alias("slot")).collect()}
    for r in placed.collect():
        assert r.shard == shards[owner[slots[r.doc_id]]]
        assert slots[r.doc_id] == int(hashlib.md5(f"={r.doc_id}".encode()).hexdigest()[:15], 16) % 1009
    path = shared_folder(spark)
    sharding.write_shards(docs, ["doc_id"], shards, path, parts=2, slots=1009)
    assert spark.read.parquet(path).count() == docs.count()
    with pytest.raises(ValueError):
        sharding.lookup_table(shards, 1000)


def test_sharding_table_by_hand():
    """Owners against a fill with whole permutations and plain integers, and placement from name to shard."""

    def drawn(name, salt):
        value = salt
        for byte in name.encode():
            value = int(mix(np.array([(value + byte + 1) % 2**64], np.uint64))[0])
        return value

    def fill(names, slots):
        orders = [[(drawn(s, 11) + k * (drawn(s, 23) % (slots - 1) + 1)) % slots for k in range(slots)] for s in names]
        assert all(sorted(o) == list(range(slots)) for o in orders)  # a prime size: each order is a permutation
        owner = {}
        while len(owner) < slots:
            for shard, order in enumerate(orders):
                if len(owner) < slots:
                    owner[next(x for x in order if x not in owner)] = shard
        return [owner[x] for x in range(slots)]

    for names, slots in ((["a", "b", "c"], 307), (["only"], 101), ([f"shard-{k}" for k in range(9)], 1009), (["é", "", " "], 401)):
        assert sharding.lookup_table(names, slots).tolist() == fill(names, slots)


def test_n_best(spark, docs, texts):
    v = pieces.load_vocabulary()
    encoder = pieces._Encoder(v, 4)
    draw = random.Random(3)

    def paths(text):
        edges, out = pieces._edges(text, v), []

        def walk(at, score, ids):
            if at == 0:
                out.append((round(score, 3), ids))
            for a, s, piece in edges[at]:
                walk(a, score + s, pieces._spell(text, a, at, piece, v) + ids)

        walk(len(text), 0.0, [])
        return sorted(out, key=lambda x: -x[0])

    for _ in range(40):
        text = "".join(draw.choice(["the", " ", "an", "é", "x\n", "ti", "①", "  "]) for _ in range(4))
        ((raw, score, alternatives, lossless),) = encoder.encode_all([text])
        ids = np.frombuffer(raw, np.int32).tolist()
        got = [(round(score, 3), ids)] + [(round(a["score"], 3), pieces.apply_edits(ids, a["edits"])) for a in alternatives]
        all_paths = paths(pieces.MARK + text.replace(" ", pieces.MARK))
        assert [g[0] for g in got] == [w[0] for w in all_paths[:4]] and lossless
        assert all(g in all_paths for g in got) and len({tuple(i) for _, i in got}) == len(got)
    long_word = "thean" * 30
    ids, score, loss = pieces.best_path(pieces.MARK + long_word, v)
    (many,) = pieces.best_paths([pieces.MARK + long_word], v, encoder.table)
    assert (np.frombuffer(many[0], np.int32).tolist(), many[1], many[2]) == (ids, score, loss)

    out = pieces.decode(pieces.encode(docs), "ids")
    assert set(out.columns) == {"doc_id", "lang", "source", "n_words", "component_id", "ids", "score", "alternatives", "lossless", "decoded"}
    for r in out.collect():
        assert r.lossless == (r.decoded == (texts[r.doc_id] or "")) and r.lossless == ("▁" not in (texts[r.doc_id] or ""))
        assert all(a.score <= r.score for a in r.alternatives)
        for a in r.alternatives:
            other = pieces.apply_edits(r.ids, [e.asDict() for e in a.edits])
            assert pieces.decode_ids(other, v) == r.decoded and other != r.ids
    assert pieces.encode(docs.limit(0)).count() == 0


def test_packing(spark, docs, odd, texts):
    tokenizer = packing.Tokenizer(packing.load_ranks())
    for t in [*texts.values(), "a  b\n\n c\t d", "it's  \n x", "\x1c a\x85b"]:
        assert tokenizer.ids(t).tolist() == tokenizer.encoding.encode_ordinary(t or "")
    draw = np.random.default_rng(1)
    for _ in range(5):
        sizes, rooms, plain = draw.integers(1, 50, 200), [], []
        for k in np.argsort(-sizes, kind="stable"):
            fit = [(r, i) for i, r in enumerate(rooms) if r >= sizes[k]]
            if not fit:
                rooms.append(50)
                plain.append([])
                fit = [(50, len(rooms) - 1)]
            i = min(fit)[1]
            rooms[i] -= sizes[k]
            plain[i].append(k)
        got = packing.best_fit(sizes, 50)
        assert len(got) == len(plain) and all(sizes[g].sum() <= 50 for g in got) and sorted(x for g in got for x in g) == list(range(200))
        assert sorted(sizes[g].sum() for g in got) == sorted(sizes[p].sum() for p in plain)
    for table in (docs, odd):
        found = defaultdict(list)
        for r in packing.pack(table, length=256).collect():
            ids, places = np.frombuffer(r.ids, np.uint16), np.frombuffer(r.positions, np.uint16)
            assert len(ids) == 256 and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens
            for doc, offset, a, b in zip(r.doc_ids, r.offsets, r.cu_seqlens, r.cu_seqlens[1:], strict=False):
                found[doc].append((offset, ids[a:b].tolist()))
                assert places[a:b].tolist() == list(range(b - a))
        rows = [(r.doc_id, tokenizer.ids(r.text).tolist()) for r in table.select("doc_id", "text").collect()]
        assert sum(len(x) for _, x in rows) == sum(len(p) for x in found.values() for _, p in x)
        if table is docs:
            for doc, ids in rows:
                assert [x for _, p in sorted(found[doc]) for x in p] == ids
    path = shared_folder(spark)
    packing.write_matrices(packing.pack(docs, length=256), path, rows=4)
    blocks = spark.read.parquet(path).collect()
    assert all(len(b.ids) == b.n_rows * 512 and len(b.cu_seqlens) == b.n_rows <= 4 for b in blocks)


def test_warc(spark):
    rows = [(0, "http://a/ b\n", "<p>x</p>"), (1, None, "<p>x</p>"), (2, "http://c", ""), (3, "http://d", None), (4, "http://é", "é\r\n\r\nü"), (0, "http://a", "<p>x</p>"), (None, "http://n", "<p>x</p>"), (None, "http://m", "alone")]
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, record_type string")
    want = []
    for i, _, h in rows:
        raw = (h or "").encode()
        first = min((j for j, _, g in rows if (g or "") == (h or "") and j is not None), default=None)
        revisit = first is not None and first != i
        want.append((str(i), len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", first if revisit else None))
    got = [(str(r[0]), *r[1:]) for r in warc.round_trip(pages).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    index = warc.write_archives(pages, shared_folder(spark))
    some = warc.read_records(index.filter("page_id = 4")).collect()
    assert len(some) == 1 and bytes(some[0].payload) == "é\r\n\r\nü".encode() and some[0].url == "http://é"
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_pipeline(spark, docs, texts):
    """The whole pipeline against plain versions of its stages."""
    import corpus_pipeline

    folder = shared_folder(spark)
    docs.drop("ids").withColumn("n_chars", docs.n_words).write.parquet(f"{folder}/documents.parquet")
    items = [(3, texts[4][:120]), (12, "changed here")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    left = {i: t for i, t in texts.items() if brute.quality(t)[-1]}
    left = {i: left[i] for i, (_, c) in brute.near_groups(left, 5, 80).items() if c == i}
    gone = brute.repeated_words(left, 13)
    left = {i: brute.without_words(t, gone[i]) if any(gone[i]) else t for i, t in left.items() if not all(gone[i])}
    want = {}
    for i, t in left.items():
        _, hit, _ = brute.leaks(t, items, 10)
        if not any(hit):
            want[i] = t
        elif not all(hit):
            want[i] = None  # cut by words of another kind; its clean words are compared below
    v = pieces.load_vocabulary()
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, folder).collect()}
    assert got.keys() == want.keys()
    for i, t in want.items():
        text = pieces.decode_ids(list(got[i].ids), v)
        assert got[i].n_chars == len(text)
        if t is None:
            assert not any(brute.leaks(text, items, 10)[1])
            assert brute.leaks(text, [], 10)[0] == [w for w, h in zip(*brute.leaks(left[i], items, 10)[:2], strict=True) if not h]
        else:
            assert text == t.replace("▁", " ")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, spark.read.parquet(f"{folder}/documents.parquet").limit(0), folder)
        assert set(out.columns) == {*docs.columns, "n_chars"} - {"ids"} and out.count() == 0


def test_columns_with_the_operators_names(spark):
    schema = "doc_id long, text string, __spans int, __items string, __words int, shard_slot int, slot int, part int"
    rows = [(1, "a b c d e f g h i j k", 7, "x", 8, 1, 2, 3), (2, None, None, None, None, None, None, None), (3, "other words", 1, "y", 2, 3, 4, 5)]
    docs = spark.createDataFrame(rows, schema)
    bench = spark.createDataFrame([("t", "b c d e f g h i j k")], "item_id string, text string")
    cut = decontaminate.remove_leaks(docs, bench)
    assert cut.columns == docs.columns
    assert sorted(map(tuple, cut.collect()), key=repr) == sorted([(1, "a ", *rows[0][2:]), rows[1], rows[2]], key=repr)
    kept = decontaminate.remove_leaks(docs, bench, remove="documents")
    assert sorted(map(tuple, kept.collect()), key=repr) == sorted(rows[1:], key=repr)
    placed = sharding.place(docs, ["doc_id"], ["p", "q"], slots=211)
    assert sorted(tuple(r)[:-1] for r in placed.filter("doc_id <> 2").collect()) == [rows[0], rows[2]] and placed.count() == 3


def test_long_words_leave_the_caches(spark):
    held = pieces.load_vocabulary()
    encoder = pieces._Encoder(held, 2)
    texts = ["x" * 3000, "a word " * 3, "y" * 3000]
    once = encoder.encode_all(texts)
    assert not encoder.long and max(map(len, encoder.cache)) <= pieces.LONG_WORD
    assert [pieces._Encoder(held, 2).encode_all([t])[0] for t in texts] == once and all(x[3] for x in once)
    tokenizer = packing.Tokenizer(packing.load_ranks())
    assert len(tokenizer.ids("z" * 500)) and not tokenizer.cache


def test_buckets_of_a_worker_share_a_tokenizer():
    ranks = {bytes([i]): i for i in range(256)}
    first = packing.tokenizer_of(ranks)
    assert first.ids("ab ab").tolist() == [97, 98, 32, 97, 98]
    assert packing.tokenizer_of(ranks) is first and "ab" in first.cache
    assert packing.tokenizer_of(dict(ranks)) is not first
