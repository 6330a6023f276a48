"""The operators on Spark: brute force on small tables, and nulls, empty texts, repeated rows, empty tables, clashing columns."""

import hashlib
import random
import re
import zlib

import pytest
import xxhash

import corpus_pipeline
from test_arrays import brute_quality
from lexspark.llm import common, components, jpeg, packing, pieces, pii, quality, queries, simhash, suffix, token_store, toxicity, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "long text " * 30_000
LINE = "A passage that is long enough to be found again: it has more than one hundred bytes, all of them the same in each place."
HARD = [
    (3, None, "en", "row_key", 0), (3, None, "en", None, None), (None, "null id " * 40, "en", "a", 1), (5, "", None, "a", 0), (7, LINE + " tail one", "en", "a", 1), (8, "head two " + LINE, "en", "a", 1),
    (8, "head two " + LINE, "en", "a", 1), (8, LINE, "en", "a", 1), (9, LONG, "en", "a", 1), (10, "Mail bob@example.com or +1 (076) 555-8046 now", "en", "a", 1), (11, "é" * 150 + LINE, "fr", "a", 1), (12, " \t\n", "en", "a", 3),
]


@pytest.fixture(scope="module")
def hard(spark):
    return spark.createDataFrame(HARD, SCHEMA).withColumns({c: common.F.lit("x") for c in ("start", "runs", "score", "fp", "media", "rep", "entities")})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def brute_removed(rows):
    """(n_bytes, n_removed, n_spans, kept) by row, in order."""
    seen, out = set(), []
    for text in rows:
        b = (text or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 99):
            s = b[i : i + 100]
            if s in seen:
                gone[i : i + 100] = b"\1" * 100
            seen.add(s)
        out.append((len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), bytes(c for c, g in zip(b, gone, strict=True) if not g)))
    return out


def test_suffix_dedup(spark, sf, hard, empty):
    rows = sorted(HARD, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    got = suffix.remove_repeats(hard).orderBy("row_key").collect()
    assert [r["doc_id"] for r in got] == [r[0] for r in rows]
    assert [(r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in got] == brute_removed([r[1] for r in rows])
    assert suffix.remove_repeats(empty).count() == 0
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    have = {r["doc_id"]: tuple(r)[1:] for r in queries.op3_suffix_dedup(spark, sf).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()}
    rows = docs.orderBy("doc_id").collect()
    assert have == {r["doc_id"]: (n, m, k, hashlib.sha256(left).hexdigest()) for r, (n, m, k, left) in zip(rows, brute_removed([r["text"] for r in rows]), strict=True)}


def test_suffix_dedup_splits_frequent_anchors(spark):
    """A line that most rows hold, with one neighbour or many: dealt to blocks, and the same result."""
    r = random.Random(4)
    line = " ".join(f"w{r.randrange(1000)}" for _ in range(60))
    rows = [(i, f"{r.choice('abc') * 40}{i if i % 3 else ''} {line} {r.randrange(9)}{'xyz'[i % 3] * 30} {i}") for i in range(120)] + [(200 + i, line[k:] + line[:k] * 2) for i, k in enumerate(range(0, 200, 9))]
    docs = spark.createDataFrame(rows, "row_key long, text string")
    wanted = {k: (n, s) for (k, _), (_, n, s, _) in zip(rows, brute_removed([t for _, t in rows]), strict=True)}
    for sample, least, block in ((1, 2, 16), (1, 10**9, 16), (2, 3, 5)):
        heavy = suffix.frequent_anchors(docs, sample=sample, least=least)
        assert bool(heavy) == (least < 10**9)
        size, suffix.BLOCK = suffix.BLOCK, block
        try:
            found = suffix.repeats(docs, sample=sample, frequent=least).select("row_key", "runs").collect()
        finally:
            suffix.BLOCK = size
        merged = suffix._union(common.pa.array([[x.asDict() for x in r["runs"] or []] for r in found]))
        assert {r["row_key"]: (sum(b - a for a, b in m), len(m)) for r, m in zip(found, merged, strict=True)} == wanted


def _runs_of(spark, rows, **limits):
    found = suffix.repeats(spark.createDataFrame(rows, "row_key long, text string"), **limits).select("row_key", "runs").collect()
    merged = suffix._union(common.pa.array([[x.asDict() for x in r["runs"] or []] for r in found]))
    return {r["row_key"]: (sum(b - a for a, b in m), len(m)) for r, m in zip(found, merged, strict=True)}


def test_suffix_dedup_sends_runs_not_strings(spark, monkeypatch):
    """A line in all rows, between words of each row's own: no row leaves the index for each string that may be elsewhere."""
    r = random.Random(7)
    line = " ".join(f"w{r.randrange(1000)}" for _ in range(60))
    rows = [(i, f"{r.randrange(10**60)} {line} {r.randrange(10**60)}") for i in range(150)]
    real, made = suffix._expanded, []
    monkeypatch.setattr(suffix, "_expanded", lambda *a: made.append(real(*a)) or made[-1])
    monkeypatch.setattr(suffix, "BLOCK", 16)
    assert _runs_of(spark, rows, sample=1, frequent=2) == {k: (n, s) for (k, _), (_, n, s, _) in zip(rows, brute_removed([t for _, t in rows]), strict=True)}
    assert made[0].count() <= 2 * len(rows)


def test_suffix_dedup_of_an_anchor_larger_than_an_index(spark, monkeypatch):
    """The segments of an anchor stay together, however many slices of an index they fill and wherever they begin in one."""
    r = random.Random(8)
    lines = [" ".join(f"w{r.randrange(1000)}" for _ in range(40)) for _ in range(6)]
    rows = [(i, f"{'pqr'[i % 3] * r.randrange(60)} {lines[i % 6]} {'xyz'[i % 3] * r.randrange(60)}{r.randrange(4)} {'to ' * r.randrange(80)}{r.randrange(9)}") for i in range(300)]
    monkeypatch.setattr(suffix, "INDEX_BYTES", 2048)
    assert _runs_of(spark, rows) == {k: (n, s) for (k, _), (_, n, s, _) in zip(rows, brute_removed([t for _, t in rows]), strict=True)}


def test_simhash(spark, sf, hard, empty):
    def fingerprint(t):
        w = (t or "").encode().lower().split()
        h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
        return sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h))

    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    prints = {r["doc_id"]: fingerprint(r["text"]) for r in rows}
    root = {d: d for d in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in prints:
        for b in prints:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 3 and (x := find(a)) != (y := find(b)):
                root[max(x, y)] = min(x, y)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op5_simhash_covering(spark, sf).collect()}
    assert got == {d: (f"{f:016x}", find(d)) for d, f in prints.items()}
    out = simhash.near_duplicates(hard).collect()
    assert len(out) == len(HARD) and {r["component_id"] for r in out if r["fingerprint"] == "0" * 16} == {3}
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.keep_one(hard)
    assert kept.columns == hard.columns and sum(r["doc_id"] == 8 for r in kept.collect()) == 2 and sum(not (r["text"] or "").strip() for r in kept.collect()) == 1


def test_similar_groups_lose_no_link_in_large_buckets(spark):
    """1,300 texts of one passage, each with a word of its own: far over a text's partners, a bucket's block and a cell."""
    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}" for _ in range(60)]
    texts = []
    for i in range(1300):
        words = list(base)
        words[6 * rng.randrange(1, 9) + rng.choice([0, 0, 0, 2])] = f"own{i}"  # away from the ends, where a word is in fewer shingles
        texts.append(" ".join(words))
    sets = [set(simhash.shingle_hashes(t, 5)) for t in texts]
    root = list(range(len(texts)))

    def top(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for j in range(len(texts)):
        for i in range(j):
            both = len(sets[i] & sets[j])
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                root[max(top(i), top(j))] = min(top(i), top(j))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(docs, 5, 5, 0.8).collect()}
    assert len(set(got.values())) > 5
    assert got == {i: top(i) for i in range(len(texts))}


def test_near_dedup_reaches_its_similarity(spark, sf):
    r = random.Random(6)
    rows, gone, i = [], set(), 0
    for _ in range(40):
        base = [f"w{r.randrange(10**6)}" for _ in range(120)]
        rows.append((i := i + 1, " ".join(base)))
        for changed, near in ((1, True), (2, True), (4, False)):  # of 116 shingles 111, 106, 96 stay: 0.92, 0.84, 0.71
            copy = list(base)
            for k in range(changed):
                copy[20 + 25 * k] = f"x{r.randrange(10**6)}"
            rows.append((i := i + 1, " ".join(copy)))
            gone |= {i} if near else set()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {d for d, _ in rows} - {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, sf).collect()} == gone


def test_components(spark):
    pairs = [(i, i + 1) for i in range(1, 40)] + [(100, 90), (90, 80), (80, 100), (7, 7), (200, 201), (200, 201), (None, 3)]
    got = {r["vertex"]: r["component"] for r in components.connected_components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {80: 80, 90: 80, 100: 80, 200: 200, 201: 200}
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_token_store(spark, sf, hard, empty):
    encoder = token_store.ChunkEncoder(queries.tokenizer_path("word_bpe_49k.json"), "drop")
    got = queries.op6_token_store(spark, sf).orderBy("doc_id").collect()
    start = 0
    for r, d in zip(got, spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect(), strict=True):
        ids = [*encoder.lib.encode(d["text"] or "", add_special_tokens=False).ids, 2]
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (d["doc_id"], start, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids)))
        start += len(ids)
    for docs, n in ((hard, len(HARD)), (empty, 0)):
        out = token_store.read_tokens(token_store.write_tokens(docs, token_store.token_folder(docs), queries.tokenizer_path("word_bpe_49k.json"), 2))
        rows = out.orderBy("start").collect()
        assert len(rows) == n and [r["doc_id"] for r in rows] == sorted((r[0] for r in HARD), key=lambda x: (x is not None, x))[:n]


def test_packing(spark, sf, hard, empty):
    path = queries.tokenizer_path("byte_bpe_50k.json")
    library = packing.ChunkEncoder(path, "keep").lib
    for docs in (spark.read.parquet(f"{sf}/documents.parquet"), hard):
        rows = packing.pack(docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]), path).collect()
        texts = {r["doc_id"]: r["text"] for r in docs.collect()}
        by_doc, by_sequence = {}, {}
        for r in rows:
            by_doc.setdefault(r["doc_id"], []).append(r)
            by_sequence.setdefault(r["sequence_id"], []).append(r)
        for d, parts in by_doc.items():
            if [x[0] for x in HARD].count(d) > 1 and docs is hard:
                continue
            ids = [*library.encode(texts[d] or "", add_special_tokens=False).ids, 0]
            at = 0
            for r in sorted(parts, key=lambda r: r["start"]):
                assert r["start"] == at and r["doc_tokens"] == len(ids)
                assert r["ids_crc32"] == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids[at : at + r["length"]]))
                at += r["length"]
            assert at == len(ids)
        for parts in by_sequence.values():
            at = 0
            for r in sorted(parts, key=lambda r: r["offset"]):
                assert r["offset"] == at
                at += r["length"]
            assert at <= 1024
    assert packing.pack(empty, path).count() == 0 and packing.pack(hard, path).where("doc_tokens = 1").count() == 3


def test_quality(spark, sf, hard, empty):
    limits, docs = quality.Limits(), {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.op9_repetition_quality(spark, sf).collect()
    assert len(got) == len(docs) and 0 < sum(r["kept"] for r in got) < len(got)
    for r in got:
        assert all(r[c] == pytest.approx(v) for c, v in brute_quality(docs[r["doc_id"]], limits).items()), r["doc_id"]
    rows = {r["doc_id"]: r for r in quality.quality(hard).collect()}
    assert rows[5]["base_failed"] and rows[9]["n_words"] == 60_000 and not rows[9]["kept"] and rows[10]["n_words"] == 7
    assert quality.quality(empty).count() == 0


def test_media(spark, hard, empty):
    got = jpeg.digest(jpeg.load_images(jpeg.store_texts(hard), details=True)).collect()
    full = {(r["doc_id"], r["payload_sha256"]) for r in jpeg.digest(jpeg.load_images(jpeg.store_texts(hard, subsampled=False), details=True)).collect()}
    assert len(got) == len(HARD) and full == {(r["doc_id"], r["payload_sha256"]) for r in got}
    bad = spark.createDataFrame([(99, 1, b"no image"), (98, 1, None), (97, 1, jpeg.encode(b"x" * 192)[:200])], "doc_id long, n_bytes long, media binary")
    assert [r["payload_sha256"] for r in jpeg.digest(jpeg.load_images(bad, details=True)).collect()] == [None] * 3
    for r in got:
        candidates = [jpeg.payload(x[1]) for x in HARD if x[0] == r["doc_id"]]
        assert any(hashlib.sha256(p).hexdigest() == r["payload_sha256"] and n == r["n_bytes"] and len(p) == r["payload_bytes"] and zlib.crc32(p[-16:]) == r["tail_crc32"] for p, n in candidates)
    images = jpeg.load_images(jpeg.store_texts(hard).union(spark.createDataFrame([(99, 1, b"no image"), (98, 1, None)], "doc_id long, n_bytes long, media binary"))).collect()
    assert all((len(r["rgb"]) == r["width"] * r["height"] * 3) if r["doc_id"] not in (98, 99) else r["rgb"] is None for r in images)
    assert jpeg.digest(jpeg.load_images(jpeg.store_texts(empty), details=True)).count() == 0


def test_toxicity(spark, hard, empty):
    r = [(i, ("some plain words here " * (i % 5 + 1)) + ("vile" if i % 10 == 0 else "fine") + f" n{chr(97 + i % 26)}") for i in range(1500)]
    docs = spark.createDataFrame(r, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 if i % 10 == 0 else 0) for i in range(0, 1500)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    out = toxicity.score(docs, model).collect()
    unseen = [x for x in out if x["held_out"]]
    assert 200 < len(unseen) < 400 and all(x["held_out"] == (zlib.crc32(str(x["doc_id"]).encode()) % 5 == 0) for x in out)
    assert sum((x["doc_id"] % 10 == 0) == (x["predicted"] == 1) for x in unseen) / len(unseen) > 0.99
    assert toxicity.drop_toxic(docs, model).count() == 1350
    rows = toxicity.score(hard, model).collect()
    assert len(rows) == len(HARD) and all(0 <= x["score"] <= 1 for x in rows)
    none = toxicity.train(hard, labels.where("false"))
    assert not none.weights and toxicity.drop_toxic(hard, none).columns == hard.columns and toxicity.drop_toxic(hard, none).count() == len(HARD)
    assert toxicity.score(empty, model).count() == 0 and not toxicity.train(empty, labels).weights


def test_personal_data(spark, hard, empty):
    out = pii.pseudonymize(hard, "k")
    assert set(out.columns) == set(hard.columns)
    rows = {r["doc_id"]: r for r in out.collect()}
    assert rows[10]["entities"] == 2 and "bob@" not in rows[10]["text"] and rows[3]["text"] is None and rows[9]["text"] == LONG
    spans = pii.pseudonymize(hard, "k", keep_entities=True)
    assert {r["type"]: (r["entities"], r["surrogates"], r["collisions"]) for r in pii.collisions(spans).collect()} == {"email": (1, 1, 0), "phone": (1, 1, 0)}
    assert pii.pseudonymize(empty, "k").count() == 0


def test_pieces(spark, hard, empty):
    path = queries.tokenizer_path("piece_bpe_32k.model")
    rows = pieces.encode_nbest(hard, path, digest=True).collect()
    assert len(rows) == len(HARD) and all(r["round_trip"] for r in rows) and all(r["nbest_scores"] == sorted(r["nbest_scores"], reverse=True) for r in rows)
    full = {r["doc_id"]: r for r in pieces.encode_nbest(hard, path, 2).collect()}
    assert len(full[10]["nbest"]) == 2 and full[5]["nbest"][0]["ids"] == [] and full[9]["round_trip"]
    assert pieces.encode_nbest(empty, path).count() == 0


def test_warc(spark, sf, tmp_path):
    same, small = "p" * 1000, "s" * 999
    pages = spark.createDataFrame([(1, "http://a", same), (2, "http://b\r\nX: y", same), (9, None, same), (9, "http://d", same), (4, "u", small), (5, "u", small), (None, "u", same), (6, "u", None), (7, "u", "é" * 500)], "page_id long, url string, html string")
    warc.register(spark)
    for compress in (True, False):
        folder = f"{tmp_path}/{compress}"
        n = warc.write_warc(pages.withColumn("digest", common.F.lit(1)), folder, warc.revisits(pages), compress).agg({"records": "sum"}).first()[0]
        archive = spark.read.format("warc").load(folder)
        got = sorted((tuple(r) for r in warc.page_digests(archive).collect()), key=str)
        sha = lambda t: hashlib.sha1(t.encode()).hexdigest()
        assert n == 9 and got == sorted([(1, 1000, sha(same), "revisit", 9), (2, 1000, sha(same), "revisit", 9), (9, 1000, sha(same), "response", None), (9, 1000, sha(same), "response", None), (4, 999, sha(small), "response", None), (5, 999, sha(small), "response", None), (None, 1000, sha(same), "response", None), (6, 0, sha(""), "response", None), (7, 1000, sha("é" * 500), "response", None)], key=str)
        only = spark.read.format("warc").option("payload", "false").load(folder).where("record_type = 'revisit' AND refers_to = '<urn:lexspark:page:9>'")
        assert only.count() == 2 and only.where("payload IS NOT NULL").count() == 0
        assert archive.where("record_id = 'x'").count() == 0
    none = pages.where("false")
    assert warc.write_warc(none, f"{tmp_path}/none", warc.revisits(none)).count() == 0 and spark.read.format("warc").load(f"{tmp_path}/none").count() == 0
    assert queries.op7_warc_source(spark, sf).count() == spark.read.parquet(f"{sf}/pages.parquet").count()


def test_warc_repeated_ids_keep_their_payloads(spark, tmp_path):
    a, b = "a" * 1200, "b" * 1300
    pages = spark.createDataFrame([(5, "u", a), (5, "u", b), (9, "u", a), (8, "u", b)], "page_id long, url string, html string")
    warc.register(spark)
    warc.write_warc(pages, f"{tmp_path}/w", warc.revisits(pages)).collect()
    got = [(r["page_id"], r["payload_digest"], r["refers_to"]) for r in warc.page_digests(spark.read.format("warc").load(f"{tmp_path}/w")).collect()]
    da, db = (hashlib.sha1(x.encode()).hexdigest() for x in (a, b))
    assert sorted(got, key=str) == sorted([(5, da, 9), (5, db, 8), (9, da, None), (8, db, None)], key=str)


def test_warc_splits_large_archives(spark, tmp_path):
    pages = spark.createDataFrame([(i, "u", f"{i} " * 3000) for i in range(60)], "page_id long, url string, html string").coalesce(1)
    warc.register(spark)
    for compress in (True, False):
        folder = f"{tmp_path}/{compress}"
        warc.write_warc(pages, folder, warc.revisits(pages), compress, index_bytes=2000).collect()
        archive = spark.read.format("warc").option("partitionBytes", "5000").load(folder)
        assert archive.rdd.getNumPartitions() > 3
        assert sorted(r["page_id"] for r in warc.page_digests(archive).collect()) == list(range(60))
        assert archive.where("record_id = '<urn:lexspark:page:31>' AND payload IS NOT NULL").count() == 1


def test_warc_nulls_of_foreign_headers(spark, tmp_path):
    (tmp_path / "x.warc").write_bytes(b"WARC/1.0\r\nContent-Length: 0\r\n\r\n\r\n\r\n" + b"WARC/1.0\r\nWARC-Type: metadata\r\nContent-Length: 0\r\n\r\n\r\n\r\n")
    warc.register(spark)
    archive = spark.read.format("warc").load(f"{tmp_path}")
    assert archive.count() == 2 and archive.where("record_type IS NOT NULL").count() == 1 and archive.where("record_id IS NOT NULL").count() == 0


def test_token_files_are_bounded(spark):
    docs = spark.createDataFrame([(None if i % 2 else 7, f"text {i} " * 50) for i in range(200)], "doc_id long, text string")
    manifest = token_store.write_tokens(docs, token_store.token_folder(docs), queries.tokenizer_path("word_bpe_49k.json"), 2, files=4, file_tokens=500).collect()
    assert len({r["part"] for r in manifest}) > 2  # rows without an id, or of one id, are in several partitions
    assert sum(r["n_docs"] for r in manifest) == 200
    rows = token_store.read_tokens(spark.createDataFrame(manifest, token_store.MANIFEST)).orderBy("start").collect()
    assert [r["doc_id"] for r in rows] == [None] * 100 + [7] * 100 and rows[-1]["start"] + rows[-1]["n_tokens"] == sum(r["n_tokens"] for r in manifest)


def test_pipeline(spark, sf, empty):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, now, seen = docs.columns, docs, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = common.materialize(stage(spark, now, sf), name)
        assert now.columns == columns
        seen.append(now.count())
    assert seen[0] >= seen[1] > seen[2] == seen[3] == seen[4]
    assert sum(m for _, m, _, _ in brute_removed([r["text"] for r in now.orderBy("doc_id").collect()])) < 2000
    packed = corpus_pipeline.STAGES[-1][1](spark, now, sf)
    assert packed.select("doc_id").distinct().count() == seen[4] == corpus_pipeline.run(spark, sf).select("doc_id").distinct().count()
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf).count() == 0
