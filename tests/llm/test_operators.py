import base64
import hashlib
import re
import tracemalloc
import zlib
from fractions import Fraction
from itertools import combinations_with_replacement

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
import xxhash
import zstandard
from brute import classes, least_reachable, removed, simhash, similar_classes, statistics
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerloom.llm import bpe, packing, pii, quality, queries, sharding, simhash as sim, substrings, topk, url_lists, warc
from ledgerloom.llm.words import Packed, forget
from ledgerloom.storage import written

WORD_BPE, RANKS = P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.tiktoken")


def by_key(found):
    return sorted(map(tuple, found), key=str)


@pytest.mark.parametrize("per_block", [16, 65_536])
def test_topk(spark, per_block):
    rng = np.random.default_rng(1)
    vectors = rng.normal(0, 0.2, (150, 7)).round(2).tolist()
    rows = [(i, v) for i, v in enumerate(vectors)] + [(20, vectors[20]), (20, vectors[9]), (150, vectors[3]), (160, [1e-3] * 3), (180, [0.5] * 3)]
    rows += [(240, [3e5, -4e7, 1.0, 0.0, 2.0, 1e6, -1e6]), (241, [2.5e8, 1.0, 2.0, 0.0, 0.1, 1.0, 1.0])]  # long scores all the same
    rows += [(200, None), (201, [1.0, None]), (202, [float("nan")] * 7), (203, [float("inf")] * 7), (None, vectors[0]), (204, []), (220, [])]
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, rank string, row int")
    q = topk.quantised(table)
    got = by_key(topk.search(q, q.filter("vec_id % 20 = 0"), 20, per_block, per_block).collect())
    fine = [(i, [int(np.floor(64 * float(np.float32(x)))) for x in v]) for i, v in rows[:157] + rows[-2:]]
    want = []
    for a, (i, v) in enumerate(fine):
        if i % 20 == 0:
            best = sorted((-sum(x * y for x, y in zip(v, w)), j) for b, (j, w) in enumerate(fine) if a != b and len(w) == len(v))[:20]
            want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    assert got == by_key(want)
    assert topk.search(q.limit(0), q, 20).count() == 0 and topk.search(q, q.limit(0), 20).count() == 0


def test_topk_scores_beyond_a_long(spark):
    rows = [(20, [3e38, 1.0]), (1, [3e38, 0.0]), (2, [-3e38, 0.0]), (3, [0.0, 1.0])]
    q = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = [tuple(r) for r in topk.search(q, q.filter("vec_id = 20"), 20).orderBy("rank").collect()]
    assert got == [(20, 1, 1, 2**63 - 1), (20, 2, 3, 4096), (20, 3, 2, -(2**63))]


def test_sharding(docs, rows):
    got = sharding.shard_report(docs, 5).toPandas()
    size = lambda t: len((t or "").encode())
    assert by_key(got[["doc_id", "size", "text_crc32"]].astype(object).where(got.notna(), None).values) == by_key(
        (float(i) if i is not None else None, size(t) + 16, zlib.crc32((t or "").encode())) for i, t in rows
    )
    assert (got.groupby("text_crc32")["shard"].nunique() == 1).all()
    for _, g in got.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    assert sharding.shard(docs.limit(0)).count() == 0


def best_capacity(sizes, held):
    """The least greatest shard of all contiguous partitions of the order, by trying every one."""
    best = sum(sizes) + sum(held)
    for ends in combinations_with_replacement(range(len(sizes) + 1), len(held) - 1):
        cuts = [0, *ends, len(sizes)]
        best = min(best, max(h + sum(sizes[a:b]) for h, a, b in zip(held, cuts, cuts[1:])))
    return best


def test_smallest_capacity():
    rng = np.random.default_rng(2)
    for _ in range(150):
        sizes = sorted(rng.integers(1, 30, rng.integers(1, 14)).tolist(), reverse=True)
        held = rng.integers(0, 40, rng.integers(1, 5)).tolist()
        order = sharding.Order([(s, sizes.count(s), s * sizes.count(s)) for s in set(sizes)])
        cuts = [0, *sharding.cut(order, held), len(sizes)]
        assert max(h + sum(sizes[a:b]) for h, a, b in zip(held, cuts, cuts[1:])) == best_capacity(sizes, held)


@pytest.mark.parametrize("sf, spread", [("0.01", 0.01), ("0.1", 0.01)])
def test_shards_are_near_equal(spark, sf, spread):
    table = spark.read.parquet(f"/root/testdata/sf{sf}/documents.parquet")
    got = sharding.shard(table).groupBy("shard").agg(F.sum("size").alias("n")).toPandas()["n"]
    assert len(got) == 40 and got.max() - got.min() < spread * got.mean()


def test_shards_around_a_giant(spark):
    rng = np.random.default_rng(3)
    rows = [(0, "x" * 500_000), (1, None)] + [(2 + i, "y" * int(n)) for i, n in enumerate(rng.integers(1, 5000, 600))]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), 8).groupBy("shard").agg(F.sum("size").alias("n")).toPandas()["n"]
    rest = sorted(got)[:-1]
    assert len(got) == 8 and max(got) == 500_016 and rest[-1] - rest[0] < 0.02 * np.mean(rest)


def test_warc(spark):
    big, small = "é" * 600, "tiny"
    rows = [(1, "http://a/\r\nx", big), (2, "u", big), (3, None, big), (3, "again", big), (4, "u", small), (5, "u", small), (6, "u", None), (7, "u", ""), (None, "u", big)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string")
    got = by_key(warc.archive(pages).collect())
    want = []
    for i, _, h in rows:
        data = (h or "").encode()
        again = len(data) >= 1000 and i != 3
        want.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", 3 if again else None))
    assert got == by_key(want)
    assert warc.archive(pages.limit(0)).count() == 0


def test_bundles_can_be_sought(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://h/{i}", f"<p>{i}</p>" * 50) for i in range(40)], "page_id long, url string, html string")
    index = warc.write_bundles(warc.with_revisits(pages), str(tmp_path), frame_bytes=2_000, bundle_bytes=1_000)
    assert index.count() > 5
    back = warc.read_bundles(index.filter(F.array_contains("page_ids", 17)), str(tmp_path)).filter("page_id = 17").first()
    assert bytes(back["payload"]).decode() == "<p>17</p>" * 50 and back["url"] == "http://h/17"


def test_whole_bundle_is_a_warc_file(spark, tmp_path):
    """Unpacked from start to end without the index: a warcinfo, then records with the mandatory fields, all dated."""
    rows = [(1, "u", "a\r\n\r\nb" * 300, "2024-05-06 07:08:09"), (2, "u", "a\r\n\r\nb" * 300, None), (3, "u", None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, at string").withColumn("at", F.to_timestamp("at")).coalesce(1)
    warc.write_bundles(warc.with_revisits(pages, fetched="at").coalesce(1), f"file://{tmp_path}").count()
    (file,) = tmp_path.glob("*.warc.zst")
    with zstandard.ZstdDecompressor().stream_reader(file.open("rb"), read_across_frames=True) as f:
        data = f.read()
    found = {}
    while data:
        fields, payload = warc.parse(data)
        size = data.index(b"\r\n\r\n") + 4 + int(fields["Content-Length"])
        assert data[size : size + 4] == b"\r\n\r\n" and {"WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Type"} <= set(fields)
        found[fields["WARC-Record-ID"] if found else "info"], data = (fields, payload), data[size + 4 :]
    assert found["info"][0]["WARC-Type"] == "warcinfo" and len(found) == 4
    assert found["<urn:page:2>"][1].decode() == rows[0][2] and found["<urn:page:3>"][1] == b""
    first = found["<urn:page:1>"][0]
    assert first["WARC-Type"] == "revisit" and first["WARC-Refers-To"] == "<urn:page:2>" and first["WARC-Date"] == "2024-05-06T07:08:09Z"


def test_url_lists(spark):
    entries = spark.createDataFrame(
        [("b.com", "2020-01-05", 1, "block"), ("b.com", "2020-01-05", 2, "allow"), ("b.com", "2020-02-01", 1, "block"), ("a.b.com", "2020-02-03", 1, "allow"),
         ("a.b.com", "2020-02-05", 1, "drop"), (None, "2020-01-01", 1, "block"), ("c.com", None, 1, "block"), ("local", "2020-01-01", 1, "block")],
        "pattern string, d string, seq int, action string",
    ).select("pattern", F.to_date("d").alias("entry_date"), "seq", "action")
    asked = [("http://A.b.com/x", "2020-01-04", "pass", None), ("http://a.b.com", "2020-01-05", "allow", "b.com"), ("https://u@a.b.com:8/", "2020-02-02", "block", "b.com"),
             ("http://a.b.com", "2020-02-03", "allow", "a.b.com"), ("http://a.b.com", "2020-02-05", "block", "b.com"), ("http://xb.com", "2020-02-05", "pass", None),
             (None, "2020-02-05", "pass", None), ("nonsense", "2020-02-05", "pass", None), ("http://local/", "2020-02-05", "block", "local"), ("http://b.com", None, "pass", None)]
    captures = spark.createDataFrame([(u, d, "x") for u, d, _, _ in asked] * 2, "url string, d string, verdict string").withColumn("fetch_date", F.to_date("d"))
    got = url_lists.filter_captures(captures, entries).select("url", "d", "verdict", "pattern").collect()
    assert by_key(got) == by_key(asked * 2)
    assert url_lists.filter_captures(captures, entries.limit(0)).filter("verdict <> 'pass'").count() == 0


def check_packing(got, want):
    """Every id lies in one piece, and sequences are gapless and within the limit."""
    assert sum(got["length"]) == sum(map(len, want))
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s["offset"].tolist() == [0, *np.cumsum(s["length"])[:-1]] and s["length"].sum() <= packing.LIMIT


def test_packing(docs, rows):
    tokenizer = Tokenizer.from_file(WORD_BPE)
    ids = [(i, np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4")) for i, t in rows]
    got = packing.pack_documents(docs, WORD_BPE).toPandas()
    check_packing(got, [x for _, x in ids])
    want = [(i, s, min(4096, len(x) - s), zlib.crc32(x[s : s + 4096].tobytes()), len(x)) for i, x in ids for s in range(0, len(x), 4096)]
    rows_ = got[["doc_id", "start", "length", "ids_crc32", "doc_tokens"]].astype(object).where(got.notna(), None).values
    assert by_key((None if r[0] is None else int(r[0]), *r[1:]) for r in rows_) == by_key(want)
    assert packing.pack_documents(docs.limit(0), WORD_BPE).count() == 0


@pytest.mark.parametrize("text", ["İ, É! Å. á. x́!! DON'T, 1,2. ab's. <|ENDOFTEXT|> <|endoftext|>x", "ΣΑΣ Σ. ß, ªº Ǆ", "\x1c a\x85b\xa0c　d 日本🙂", "I'll 's 'S x's"])
def test_ids_of_runs(text):
    want = Tokenizer.from_file(WORD_BPE).encode(text, add_special_tokens=False).ids
    assert np.frombuffer(packing.Ids(WORD_BPE).encode([text])[0], "<u4").tolist() == want


def test_plan_is_close_to_the_bound():
    rng = np.random.default_rng(3)
    demand = np.bincount(np.minimum(511, (rng.lognormal(4.2, 0.9, 20_000)).astype(int)), minlength=512)
    plan = packing.plan(demand, 512)
    placed = np.zeros(512, int)
    for pattern, times in plan:
        assert sum((c + 1) * n for c, n in pattern) <= 512
        for c, n in pattern:
            placed[c] += n * times
    assert (placed == demand).all()
    assert sum(t for _, t in plan) <= 1.01 * (demand * (np.arange(512) + 1)).sum() / 512 + 2
    assert packing.plan(np.zeros(512, int), 512) == []


def test_bpe(docs, rows):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    plain = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for i, t in rows:
        ids = np.array(plain.encode_ordinary(t or ""), "<u4")
        want.append((i, len(ids), sha(ids.tobytes()), sha((t or "").encode())))
    assert by_key(bpe.token_digests(docs, RANKS, P.PATTERN).collect()) == by_key(want)
    assert bpe.token_digests(docs.limit(0), RANKS, P.PATTERN).count() == 0
    extra = bpe.encode(docs, RANKS, P.PATTERN)
    assert extra.columns == [*(c for c in docs.columns if c != "ids"), "ids"]


def test_bpe_with_a_full_memory():
    codec = bpe.Codec(bpe.read_ranks(RANKS), P.PATTERN)
    codec.known.limit = 5
    text = "Nonsensical zqxjk wvutsr qqqqzz xxyyzzqq, zqxjk pppooo lllkkk jjjhhh nnnmmm"
    first = codec.encode(text)
    assert codec.encode(text) == first and codec.decode(first) == text.encode()


@pytest.mark.parametrize("text", ["ab" * 40_000, "é日🙂" * 9_000, "zq xj, " * 70_000, "!?" * 30_000 + "\n" * 5_000])
def test_bpe_of_long_runs(text):
    ranks = bpe.read_ranks(RANKS)
    plain = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    codec = bpe.codec(RANKS, P.PATTERN)
    ids = codec.encode(text)
    assert np.frombuffer(ids, "<u4").tolist() == plain.encode_ordinary(text) and codec.decode(ids) == text.encode()


def test_bpe_round_trip_of_columns(docs, rows):
    back = bpe.decode(bpe.encode(docs, RANKS, P.PATTERN), RANKS)
    assert by_key((r["doc_id"], bytes(r["decoded"])) for r in back.collect()) == by_key((i, (t or "").encode()) for i, t in rows)


def dense_mcd(x, least, tries=30, share=0.75):
    """A plain minimum-covariance-determinant estimate: random starts of a few rows, exact subsets, dense matrices."""
    rng, n = np.random.default_rng(0), len(x)
    h = int(np.ceil(share * n))
    best = (np.inf, None, None)

    def guarded(c):
        return c + np.diag(np.maximum(least**2 - c.diagonal(), 0))

    for _ in range(tries):
        near = rng.choice(n, min(n, x.shape[1] + 1), replace=False)
        last = np.inf
        while True:
            mean, cov = x[near].mean(axis=0), np.cov(x[near].T, bias=True)
            det = np.linalg.slogdet(guarded(cov))[1]
            if len(near) == h and det >= last - 1e-12:
                break
            last = det if len(near) == h else np.inf
            if last < best[0]:
                best = (last, mean, cov)
            inverse = np.linalg.pinv(guarded(cov))
            near = np.argsort(np.einsum("ij,jk,ik->i", x - mean, inverse, x - mean), kind="stable")[:h]
    return best


def transformed(part):
    n = np.maximum(part["n_words"], 1)
    share = lambda c: np.log1p(100.0 * part[c] / n)
    raw = [np.log1p(part["n_words"]), np.log1p(part["word_chars"] / n), share("n_symbols"), share("n_dup_lines"), share("n_repeat_words")]
    return np.array(raw).T


def test_quality(spark, docs, rows):
    table = docs.withColumns({c: F.lit("own") for c in ("n", "l_name", "m_id", "all", "m", "salt", "d2", "y_0")})
    got = quality.quality_report(docs).collect()
    assert by_key(tuple(r)[:7] for r in got) == by_key((i, *statistics(t)) for i, t in rows)
    assert all(not r["kept"] for r in got if r["base_failed"])
    assert quality.quality_report(docs.limit(0)).count() == 0
    judged = quality.judged(quality.with_statistics(table))
    others = [c for c in table.columns if c not in (*quality.STATISTICS, "kept")]
    assert [c for c in judged.columns if c in others] == others and judged.columns[-1] == "kept"
    assert by_key(judged.select(*others).collect()) == by_key(table.select(*others).collect())
    assert sum(r["kept"] for r in judged.collect()) == sum(r["kept"] for r in got)


def test_outliers_against_dense_estimates(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").filter("lang = 'en' or source in ('src1', 'src2')")
    measured = written(quality.with_statistics(table).drop("text"), "measured")
    got = quality.judged(measured).toPandas()
    rows = measured.filter("not base_failed").select(*quality._keyed())
    mine = {(r["lang_"], r["source_"]): r for r in quality.estimates(written(rows, "features")).collect()}
    least = np.array(list(quality.FEATURES.values()))
    share, k, same, n, deeper = quality.KEPT_SHARE, len(least), 0, 0, []
    for key, part in got[~got["base_failed"]].groupby(["lang", "source"]):
        x = transformed(part)
        det, mean, cov = dense_mcd(x, least)
        own = mine[f"={key[0]}", f"={key[1]}"]
        deeper.append(own["log_det"] - 2 * k * np.log(quality.SCALE) - det)
        assert share * len(x) <= own["h"] <= share * len(x) + 0.1 * len(x) + 2
        cov = cov * quality.consistency(share, k)
        cov += np.diag(np.maximum(least**2 - cov.diagonal(), 0))
        d2 = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
        alike = (d2 <= quality.chi2_quantile(1 - quality.TAIL, k)) == part["kept"]
        same += alike.sum()
        n += len(x)
        if abs(deeper[-1]) < 0.15:  # both searches ended in the same minimum
            assert alike.sum() >= len(x) - 1
    assert len(mine) == got[~got["base_failed"]].groupby(["lang", "source"]).ngroups and same >= 0.99 * n
    assert np.median(deeper) < 0.1 and np.mean(np.abs(deeper) < 0.15) > 0.8  # mostly as deep as thirty random starts
    assert 0.02 < (~got["kept"][~got["base_failed"]]).mean() < 0.2


def test_each_source_is_judged_by_itself(spark):
    """What is usual in one source is an outlier in another, and repeated lines are rejected below the base limit."""
    rng = np.random.default_rng(9)
    plain = lambda n: " ".join(rng.integers(0, 10**6, n).astype(str))
    marked = lambda n: " ".join(f"#{w}#" for w in rng.integers(0, 10**6, n))
    rows = [(i, plain(rng.integers(60, 200)), "a") for i in range(60)] + [(100 + i, marked(rng.integers(60, 200)), "b") for i in range(60)]
    rows += [(300, marked(100), "a"), (301, plain(60) + "\none two" * 20, "a"), (400, plain(100), "b"), (500, marked(80), "c"), (501, plain(80), None)]
    table = spark.createDataFrame([(i, t, "en", s) for i, t, s in rows], "doc_id long, text string, lang string, source string")
    lost = [r["doc_id"] for r in quality.quality_report(table).filter("not kept").collect()]
    assert sorted(lost) == [300, 301, 400]


def test_near_duplicates(docs, rows):
    prints = [simhash(t) for _, t in rows]
    root = classes(prints)
    least = {}
    for (i, _), p in zip(rows, prints):
        if i is not None:
            least[root[p]] = min(i, least.get(root[p], i))
    want = [(i, f"{p:016x}", least.get(root[p])) for (i, _), p in zip(rows, prints)]
    assert by_key(sim.near_duplicate_report(docs).collect()) == by_key(want)
    assert sim.near_duplicate_report(docs.limit(0)).count() == 0
    kept = sim.representatives(docs).collect()
    assert len(kept) == len(set(root.values())) and sim.representatives(docs).columns == docs.columns
    assert {r["doc_id"] for r in kept if r["doc_id"] is not None} == set(least.values())


@pytest.mark.parametrize("largest", [1024, 2])
def test_similar_texts(docs, rows, largest):
    want = similar_classes([(i, t) for i, t in rows])
    kept = sim.similar_representatives(docs, largest=largest)
    assert kept.columns == docs.columns
    got = kept.collect()
    assert sorted((r["doc_id"] for r in got), key=str) == sorted(want, key=str)
    assert all((r["kept"], r["fp"], r["shard"]) == ("x", 1, 1) for r in got)
    assert sim.similar_representatives(docs.limit(0), largest=largest).count() == 0


@pytest.mark.parametrize("largest, hot_from", [(1024, 16_384), (2, 16_384), (2, 2)])
def test_similar_texts_are_those_of_the_exact_similarity(spark, largest, hot_from):
    rng, rows = np.random.default_rng(4), []
    for i in range(150):
        words = rng.integers(0, 5000, 200).astype(str)
        other = words.copy()
        other[rng.choice(200, rng.integers(1, 8), replace=False)] = "changed"
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other[: rng.integers(180, 201)]))]
    # 0.8 to the shingle: 100 of 125, and just below it: 100 of 126
    x, y = ([f"{c}{k}" for k in range(130)] for c in "xy")
    rows += [(300, " ".join(x[:104])), (301, " ".join(x[:129])), (302, " ".join(y[:104])), (303, " ".join(y))]
    # few shingles, where ties of the majority are frequent: 4 of 5
    rows += [(304 + 2 * i + k, " ".join(f"s{i}_{j}" for j in range(8 + k))) for i in range(40) for k in (0, 1)]
    want = similar_classes(rows)
    assert 190 < len(want) < 350 and set(range(300, 304)) & set(want) == {300, 302, 303} and 305 not in want
    table = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sim.similar_representatives(table, largest=largest, hot_from=hot_from)
    assert sorted(r["doc_id"] for r in kept.collect()) == want


def test_similar_texts_meet_in_hot_buckets(spark):
    """A long template in every text; with small blocks and a low bound all its shingles are hot."""
    rng, rows = np.random.default_rng(6), []
    template = [f"t{k}" for k in range(120)]
    for i in range(30):
        own = [f"o{i}_{k}" for k in range(rng.integers(8, 40))]
        other = own[: -rng.integers(1, 6)] + ["changed"]
        rows += [(2 * i, " ".join(template + own)), (2 * i + 1, " ".join(template + other))]
    for rows in (rows, [(i, t.replace("t0 ", f"a{i // 2} ").replace(" t60 ", f" b{i // 2} ")) for i, t in rows]):
        table = spark.createDataFrame(rows, "doc_id long, text string")
        want = similar_classes(rows)
        assert len(want) <= 30
        for largest, hot_from in ((1024, 16_384), (2, 16_384), (2, 2)):
            kept = sim.similar_representatives(table, largest=largest, hot_from=hot_from)
            assert sorted(r["doc_id"] for r in kept.collect()) == want


def test_entries_meet_once_however_many_shingles_are_hot(spark, monkeypatch):
    """Each round of hot shingles made all entries meet again, and left out those of touched sets one by one."""
    line = [f"t{k}" for k in range(60)]
    rows = [(i, " ".join([*line, *(f"o{i // 2}_{k}" for k in range(60))] + ["end"] * (i % 2))) for i in range(20)]
    exact, met, shared = Fraction(4, 5), [], sim._shared
    table = spark.createDataFrame(rows, "id long, text string")
    sketches = sim.written(sim.sketched(table, exact, "set").select("id", "set.n", "set.prefix", "set.fp", "set.odd"), "sketches")

    def counted(entries, similarity):
        met.append(entries)
        return shared(entries, similarity)

    monkeypatch.setattr(sim, "_shared", counted)
    found = sim._cooled(sketches, table, exact, 4).collect()
    assert len(met) == 1
    late = {int(h) for h in sim.shingle_set(" ".join(line))}
    assert late & {int(h) for r in sketches.collect() for h in r["prefix"]}
    assert not late & {r["key"] for r in found} and {r["k"] for r in found} == {2}
    assert {(r["id"], r["n"]) for r in found} == {(i, len(sim.shingle_set(t))) for i, t in rows}


def test_a_group_of_near_copies_does_not_bring_all_its_pairs(spark):
    rng, base = np.random.default_rng(8), [f"w{k}" for k in range(150)]
    rows = []
    for i in range(200):
        copy = list(base)
        for k in rng.choice(150, 3, replace=False):
            copy[k] = f"e{i}_{k}"
        rows.append((i, " ".join(copy)))
    sets = {i: sim.shingle_set(t) for i, t in rows}
    exact = Fraction(4, 5)
    sketch = [(i, len(h), h[: sim.prefix_length(len(h), exact)].tolist(), sim.wide_fingerprint(h), sim.parity_map(h)) for i, h in sets.items()]
    sketches = spark.createDataFrame(sketch, "id long, n long, prefix array<bigint>, fp binary, odd binary")
    met = sim._dealt(sim._shared(sketches.select("id", "n", F.explode("prefix").alias("key")), exact), 1024).join(sketches.drop("prefix"), "id")
    assert sim._candidates(met.withColumn("root", F.col("id")), exact, True).select("a", "b").distinct().count() < 200 * 20
    found = sim.similar_links(spark.createDataFrame(rows, "id long, text string"), sketches, 0.8).collect()
    root = least_reachable(sorted(sets), [(r["a"], r["b"]) for r in found])
    assert sorted(set(root.values())) == similar_classes(rows)


@pytest.mark.parametrize("largest, spread", [(1024, 16), (8, 16), (8, 0)])
def test_texts_just_below_the_limit_do_not_bring_all_pairs_with_a_group(spark, monkeypatch, largest, spread):
    """A group of near copies and strangers, each of which may be similar to every copy and is to none but its twin."""
    rng, base, rows = np.random.default_rng(9), [f"w{k}" for k in range(300)], []
    for i in range(120):
        rows.append((i, " ".join([*base[:296], *(f"e{i}_{k}" for k in range(1 + i % 4))])))
    for i in range(40):
        far = [f"f{i}_{k}" for k in range(36)]
        rows += [(200 + 2 * i + k, " ".join([*base[:264], *far[: 36 - k]])) for k in (0, 1)]
    rows = [rows[i] for i in rng.permutation(len(rows))]
    want = similar_classes(rows)
    assert want == [0, *range(200, 280, 2)]
    made, keep = [], sim.written

    def counted(df, label):
        out = keep(df, label)
        made.extend([out.count()] if label == "pairs" else [])
        return out

    monkeypatch.setattr(sim, "written", counted)
    exact = Fraction(4, 5)
    table = spark.createDataFrame(rows, "id long, text string")
    sketches = keep(sim.sketched(table, exact, "set").select("id", "set.n", "set.prefix", "set.fp", "set.odd"), "sketches")
    found = sim.similar_links(table, sketches, 0.8, largest=largest, spread=spread).collect()
    root = least_reachable([i for i, _ in rows], [(r["a"], r["b"]) for r in found])
    assert sorted(set(root.values())) == want
    # forests of small blocks, two by two, are many
    assert largest < 1024 or sum(made) + len(found) < 20 * len(rows)


@pytest.mark.parametrize("largest", [1024, 3])
def test_large_buckets_are_parted_without_loss(spark, largest):
    rng = np.random.default_rng(0)
    base = [int(x) for x in rng.integers(0, 2**63, 60)]
    near = {x ^ sum(1 << int(b) for b in rng.choice(63, rng.integers(0, 6), replace=False)) for x in base for _ in range(5)}
    every = sorted({*base, *near})
    found = sim.classes(spark.createDataFrame([(x,) for x in every], "fp long"), largest).collect()
    assert {r["fp"]: r["root"] for r in found} == classes(every)


@pytest.mark.parametrize("often", [1, 16])
def test_substrings(docs, rows, often):
    assert by_key(substrings.removal_report(docs, often).collect()) == removed(rows)
    assert substrings.removal_report(docs.limit(0)).count() == 0


def test_windows_that_share_a_hash(monkeypatch):
    lines = [" ".join(f"{c}{i}" for i in range(14)).encode() for c in "abab"]
    monkeypatch.setattr(substrings._Text, "hashes", lambda self, start, end: np.zeros(len(start), np.uint64))
    order, new = substrings.equal_windows(substrings._Text(b"\n".join(lines)), np.array([14 * i + j for i in range(4) for j in range(2)]))
    assert new.sum() == 4 and sorted(order.tolist()) == list(range(8))


def test_pii(docs, rows):
    got = {r["doc_id"]: r for r in pii.replace(docs, b"k").collect()}
    mail = got[309]["text"].split(" ")
    assert mail[1].rstrip(",").lower() == mail[2].lower() and mail[2].isupper() and mail[1].endswith("@mail2.example.com,") is False
    phones = [m.entity for m in pii.mentions(got[309]["text"]) if m.kind == "phone"]
    assert len(phones) == 2 and phones[0] == phones[1] != "+17435553824"
    for private in ("jo.doe1", "3824", "70.23.22.57", "0641917ea4", "e3b3ed3cc8", "Erika", "Muster"):
        assert private not in got[309]["text"] + got[310]["text"]
    assert "Mrs. " in got[310]["text"] and got[300]["text"] is None and got[301]["text"] == "" and got[307]["n_entities"] == 0
    assert all(got[i]["text"] == t for i, t in rows if i is not None and i < 100)
    assert pii.replace(docs.limit(0), b"k").count() == 0
    clash = pii.replace(docs.withColumns({c: F.lit("own") for c in ("_again", "again", "row", "all", "kind")}), b"k")
    assert clash.columns[-1] == "n_entities" and {(r["again"], r["row"], r["kind"]) for r in clash.collect()} == {("own",) * 3}
    joined = {r["doc_id"]: r["text"] for r in pii.replace(docs, b"k", sent_to_all=-1).collect()}
    assert joined == {i: r["text"] for i, r in got.items()}


def test_forms_of_one_person_agree():
    text = "Mrs. Jane Smith met Mrs. Smith and Dr. Smith.\nLater Jane Smith wrote to John Q. Miller; Miller knew Dr. Jane Smith, Ann Smith and smith."
    new, n = pii._rewrite(text, b"k", {})
    words = re.findall(r"[A-Za-z]+", new)
    jane, smith, john, miller = words[1], words[2], words[words.index("to") + 1], words[words.index("to") + 3]
    assert new == text.replace("Jane", jane).replace("Smith", smith).replace("John", john).replace("Miller", miller)
    assert len({jane, smith, john, miller, "Jane", "Smith", "John", "Miller"}) == 8 and jane.endswith("a") and john.endswith("o")
    assert n == 2 + 1 + 1 + 2 + 2 + 1 + 2 + 1  # given and family names
    other = pii._rewrite("Herr Smith und Frau Anna Müller-Lüdenscheid, г-жа Ольга Петрова", b"k", {})[0]
    assert other.split(" ")[1] == smith and re.fullmatch(r"Herr \w+ und Frau [A-Z][a-z]+a [A-Z][a-z]+, г-жа [А-Я][а-я]+а [А-Я][а-я]+", other)


@pytest.mark.parametrize("text", ["John and Mary went. The Smith works", "std::vector<int> a::b", "at 12:30:45", "DE00 1234 5678 9012 3456 78", "password: none", "Peter said"])
def test_what_only_looks_private_stays(text):
    assert pii._rewrite(text, b"k", {}) == (text, 0)


@pytest.mark.parametrize(
    "kind, found",
    [("iban", "DE89 3704 0044 0532 0130 00"), ("iban", "GB82WEST12345698765432"), ("ip6", "2001:db8::8a2e:370:7334"), ("ip6", "FE80:0:0:0:202:B3FF:FE1E:8329"),
     ("secret", "password: xyz123"), ("phone", "555-123-4567"), ("phone", "030 1234567"), ("email", "Müller@firma.de")],
)
def test_kinds_keep_their_format(kind, found):
    shape = lambda t: re.sub("[0-9]", "9", re.sub("[A-ZÀ-Þ]", "A", re.sub("[a-zà-ÿ]", "a", t)))
    for text in (found, f"see {found}, then", f"({found})"):
        assert [(m.kind, m.found) for m in pii.mentions(text)] == [(kind, found)]
        new, n = pii._rewrite(text, b"k", {})
        again = pii.mentions(new)
        assert n == 1 and [m.kind for m in again] == [kind] and again[0].found != found and new == text.replace(found, again[0].found)
        if kind == "ip6":
            assert re.sub("[0-9A-Fa-f]", "x", again[0].found) == re.sub("[0-9A-Fa-f]", "x", found)
        else:
            assert shape(again[0].found) == shape(found)
    if kind == "iban":
        assert pii._remainder(again[0].entity) == 1


def test_one_number_in_several_forms_is_one_entity():
    forms = ["(415) 555-0132", "+1 415 555 0132", "415.555.0132", "1-415-555-0132"]
    assert {m.entity for f in forms for m in pii.mentions(f)} == {"+14155550132"}
    new = [pii._rewrite(f, b"k", {})[0] for f in forms]
    assert len({re.sub("[^0-9]", "", x)[-10:] for x in new}) == 1 and not set(new) & set(forms)


def test_a_whole_table_keeps_entities_apart_and_alike(spark):
    """Over all documents: one entity has one surrogate, no two share one, none is real, and nothing else changes."""
    table = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    new = {r["doc_id"]: (r["text"], r["n_entities"]) for r in pii.replace(table, b"k").collect()}
    seen, real = {}, set()
    for r in table.collect():
        old, (text, n) = pii.mentions(r["text"]), new[r["doc_id"]]
        assert len(old) == n
        real |= {(m.kind, m.entity) for m in old}
        at = done = 0
        for i, m in enumerate(old):
            gap = r["text"][at : m.start]
            assert text.startswith(gap, done)
            done += len(gap)
            rest = r["text"][m.end : old[i + 1].start if i + 1 < len(old) else None]
            end = done + len(m.found) if m.kind not in ("given", "family") else done + len(re.match(r"\w+", text[done:])[0])
            made = text[done:end]
            assert text.startswith(rest, end) and [c.isdigit() for c in made] == [c.isdigit() for c in m.found] or m.kind in ("given", "family", "key", "secret", "ip", "ip6")
            if m.kind not in ("ip",):
                seen.setdefault((m.kind, m.entity), set()).add(made.lower() if m.kind not in ("phone", "card", "ssn") else re.sub("[^0-9]", "", made)[-9:])
            else:
                break  # its length changes, and so do all places behind it
            at, done = m.end, end
    assert len(seen) > 300 and all(len(x) == 1 for x in seen.values())
    kinds = {k for k, _ in seen}
    for kind in kinds:
        made = [min(x) for (k, _), x in seen.items() if k == kind]
        assert len(set(made)) == len(made)
        assert not set(made) & {e.rpartition("|")[2].lower() if kind in ("given", "family") else e for k, e in real if k == kind}


PHONES = """415-555-0132|415.555.0132|415 555 0132|1-415-555-0132|(415) 555 0132|(415) 555-0132|0171 2345678|020 7946 0958
01 23 45 67 89|01.23.45.67.89|030/1234567|(0171) 2345678|0171-2345678|+49 171 2345678"""


@pytest.mark.parametrize("kind, found", [("phone", x) for x in PHONES.replace("\n", "|").split("|")] + [("card", "3782 822463 10005"), ("card", "3782-822463-10005")])
def test_national_phones_and_grouped_cards(kind, found):
    for text in (found, f"call {found}.", f"({found}), then"):
        got = [(m.kind, m.found) for m in pii.mentions(text)]
        assert got == [(kind, found)]
    made = pii.shown(kind, found, pii.surrogate(kind, pii.normal(kind, found), b"k"))
    assert made != found and [(m.kind, m.found) for m in pii.mentions(made)] == [(kind, made)]


@pytest.mark.parametrize("text", ["v415.555.01325", "415-555-01329", "2415-555-0132", "2023-01-02", "05-12-2023 14:30", "01.02.2023", "978-0-306-40615-7", "10 000 000 1234", "0.123 4567", "1 000 000"])
def test_other_numbers_are_no_phones(text):
    assert not list(pii.mentions(text))


def test_plain_runs_of_13_digits_are_cards_by_issuer_and_luhn():
    for text in ("at 1700000000000 ms", "ISBN 9780306406157", "4222222222223"):
        assert not list(pii.mentions(text)) and pii._rewrite(text, b"k", {}) == (text, 0)
    for text in ("4222222222222", "4222 2222 2222 2", "41111111111111", "4111111111111111"):
        assert [m.found for m in pii.mentions(text)] == [text]
        new, n = pii._rewrite(text, b"k", {})
        assert n == 1 and new != text and [m.found for m in pii.mentions(new)] == [new]


def test_surrogates_stay_apart(spark):
    for kind, many in (("ssn", [f"{i:09}" for i in range(3000)]), ("ip", [f"1.2.{i // 256}.{i % 256}" for i in range(3000)]), ("family", [f"latin|N{i}" for i in range(3000)]), ("given", [f"f|latin|N{i}" for i in range(3000)])):
        new = {pii.surrogate(kind, e, b"k") for e in many}
        assert len(new) == len(many) or kind in ("given", "family")
    tight = spark.createDataFrame([("ssn", f"{i:02}") for i in range(40)], "kind string, entity string")
    again = {r["entity"]: r["attempt"] for r in pii.redrawn(tight, b"k").collect()}
    final = [pii.surrogate("ssn", f"{i:02}", b"k", again.get(f"{i:02}", 0)) for i in range(40)]
    assert len(set(final)) == 40 and not set(final) & {f"{i:02}" for i in range(40)}
    assert pii._luhn(pii.surrogate("card", "4111111111111111", b"k")) == 0


def test_hash_is_the_standard_one(spark):
    texts = ["", "a", "abc def ghi", "é" * 40, "x" * 1000]
    got = [r[0] & (2**64 - 1) for r in spark.createDataFrame([(t,) for t in texts], "t string").select(F.xxhash64("t")).collect()]
    assert got == [xxhash.xxh64_intdigest(t.encode(), 42) for t in texts]


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 11))


def test_hashes_of_bytes_take_little_memory():
    data = b" ".join([b"x" * 999] * 2000)
    tracemalloc.start()
    text = substrings._Text(data)
    h = text.hashes(text.start, text.end)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(set(h.tolist())) == 1 and peak < 16 * len(data)


def test_workers_forget_words():
    kept, other = Packed(100, {b"a": b"1"}), packing.Ids(WORD_BPE, 1000)
    kept.learn({b"b": b"2"})
    other.encode(["some words"])
    assert b"b" in kept and other.known
    forget()
    assert dict(kept) == {b"a": b"1"} and not other.known and other.known.size == 0
    assert other.encode(["some words"])[0] == packing.Ids(WORD_BPE).encode(["some words"])[0]
