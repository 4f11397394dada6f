"""The training-data operators against brute force, round trips and held-out rows."""

import collections
import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridweave.llm import chat, chunk_dedup, components, language_id, matroska, mixing, ngram_join, packing, quality_rules, shard_tree, url_filter
from gridweave.llm.common import Workspace, gapless_rank, id_remainder

SMALL = "/root/testdata/sf0.001"
#: Extra columns bear names that operators use themselves.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, size long, node long, row long, shard int, token long"


def docs_of(spark, rows):
    """rows: (doc_id, text[, lang, source])"""
    return spark.createDataFrame([(*r, *[None] * (4 - len(r)), 0, 0.5, 1, 2, 3, 4, 5) for r in rows], SCHEMA)


LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "One"), (6, "a b c d e"), (6, "a b c d e"), (7, LONG), (8, LONG + " end"), (None, "a b c d e"), (9, "é ü 日本 ñ")]


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    return docs_of(spark, ODD)


@pytest.fixture(scope="module")
def none(spark):
    return docs_of(spark, ODD).where("false")


def classes(rows, width, percent):
    """Brute force: (n_shingles, component) of each place in rows of (doc_id, text)."""
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= percent * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least.setdefault(find(i), []).extend([doc] if doc is not None else [])
    return [(len(s), min(least[find(i)], default=None)) for i, s in enumerate(sets)]


@pytest.mark.parametrize("width,percent", [(4, 85), (5, 80)])
def test_ngram_join(spark, width, percent):
    rng = random.Random(3)
    base = [f"v{rng.randrange(400)}" for _ in range(60)]
    rows = [(r[0], r[1]) for r in ODD]
    for i in range(150):  # one large group of near copies with up to 12 edits
        words = base[:]
        for _ in range(rng.randrange(12)):
            words[rng.randrange(60)] = f"e{rng.randrange(10**6)}"
        rows.append((100 + i, " ".join(words)))
    rows += [(400 + i, " ".join(f"q{rng.randrange(10**6)}" for _ in range(rng.randrange(3, 50)))) for i in range(60)]
    got = ngram_join.join_classes(docs_of(spark, rows), width, percent).collect()
    want = classes(rows, width, percent)
    assert collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == collections.Counter((d, *w) for (d, _), w in zip(rows, want, strict=True))


def test_ngram_join_small_tables(spark, small, none):
    rows = [(r["doc_id"], r["text"]) for r in small.collect()]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.join_classes(small, 4, 85).collect()}
    assert got == {d: w for (d, _), w in zip(rows, classes(rows, 4, 85), strict=True)}
    assert ngram_join.join_classes(none).count() == 0


def test_blocks_lose_no_link():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 120).astype(np.uint64)
    sets = []
    for _ in range(60):
        s = base.copy()
        s[rng.integers(0, 120, rng.integers(0, 9))] = rng.integers(0, 2**63)
        sets.append(np.unique(s))
    levels = ngram_join.Levels(np.sort(base[:40]), np.full(40, 50))
    first = [s[ngram_join.prefix(s, levels.of(s), 0, 85)] for s in sets]

    def joined(pairs):
        parent = list(range(60))

        def find(i):
            while parent[i] != i:
                i = parent[i]
            return i

        for a, b in pairs:
            parent[max(find(a), find(b))] = min(find(a), find(b))
        return [find(i) for i in range(60)]

    links = []
    for token in np.unique(np.concatenate(first)):
        own = [i for i in range(60) if token in first[i]]
        for side in (np.zeros(len(own), int), np.arange(len(own)) % 2):  # one block, and two blocks that meet
            links += [(own[a], own[b]) for a, b in ngram_join.compare_block(token, np.array(own), side, [sets[i] for i in own], levels, 85)]
    similar = lambda a, b: len(np.intersect1d(sets[a], sets[b])) * 100 >= 85 * len(np.union1d(sets[a], sets[b]))
    assert all(similar(a, b) for a, b in links)
    assert joined(links) == joined([(a, b) for a in range(60) for b in range(a) if similar(a, b)])


def test_hub_of_a_large_bucket(spark):
    common = [f"c{i}" for i in range(29)]
    rows = [(0, " ".join([*common, "own"]))]  # shares one prefix token with texts of 33, the ends of its sizes suggest two
    rows += [(i, " ".join([*common, *(f"o{i}x{k}" for k in range(5 if i == 64 else 4))])) for i in range(1, 65)]
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.join_classes(docs_of(spark, rows), 1, 85).collect()}
    assert got == {d: c for (d, _), (_, c) in zip(rows, classes(rows, 1, 85), strict=True)}
    assert collections.Counter(got.values())[0] == 64


@pytest.mark.parametrize("percent", [80, 85])
def test_fewest_shared_tokens_are_bounded_by_the_ends(spark, percent):
    n = spark.range(4, 300).selectExpr("id AS n")
    pairs = n.crossJoin(n.selectExpr("n AS m")).where(f"n * {percent} <= m * 100 AND m * {percent} <= n * 100")
    a, b = F.col("n"), F.col("m")
    found = pairs.select("n", ngram_join._fewest(a, b, percent).alias("f"), ngram_join._above(a, b, percent).alias("g"), "m").groupBy("n").agg(F.min("f").alias("f"), F.min_by("g", "m").alias("lo"), F.max_by("g", "m").alias("hi"))
    assert found.where(F.floor(F.least("lo", "hi")) + 1 > F.col("f")).count() == 0


def test_components(spark):
    rng = random.Random(5)
    edges = [(0, i) for i in range(1, 300)] + [(i, i + 1) for i in range(1000, 1040)] + [(rng.randrange(2000, 2100), rng.randrange(2000, 2100)) for _ in range(80)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long"), Workspace(spark, "t"), "c").collect()}
    parent = {}

    def find(i):
        while parent.setdefault(i, i) != i:
            i = parent[i]
        return i

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    assert got == {i: find(i) for i in list(parent) if find(i) != i}


def test_chunk_dedup(spark, odd, none):
    rows = [tuple(r) for r in chunk_dedup.deduplicate(odd).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()]
    norm = lambda t: "".join(c for c in (t or "") if c not in " \t\n\v\f\r")
    groups = collections.defaultdict(list)
    for d, t in ODD:
        groups[norm(t)].append((-len(t or ""), d is None, d or 0, d))
    want = collections.Counter()
    for d, t in ODD:
        g = groups[norm(t)]
        want[(d, min(g)[3], len(g), hashlib.sha256(norm(t).encode()).hexdigest())] += 1
    assert collections.Counter((a, b, c, e) for a, b, c, _, e in rows) == want
    assert sum(r[3] for r in rows) == len(groups)
    assert chunk_dedup.without_copies(odd).count() == len(groups)
    assert chunk_dedup.without_copies(odd).columns == odd.columns
    assert chunk_dedup.deduplicate(none).count() == 0


def test_chunk_ids_are_verified(small):
    assert not chunk_dedup.verified(small, b"k", 1)  # one-byte identifiers collide
    a = {(r["doc_id"], r["keep_id"]) for r in chunk_dedup.deduplicate(small, width=1).collect()}
    assert a == {(r["doc_id"], r["keep_id"]) for r in chunk_dedup.deduplicate(small).collect()}


def test_chunks_follow_content():
    table = chunk_dedup.gear()
    data = np.random.default_rng(0).integers(0, 256, 200_000).astype(np.uint8).tobytes()
    ends = chunk_dedup.cuts(data, table)
    assert ends[-1] == len(data) and all(b - a <= chunk_dedup.MOST for a, b in zip([0, *ends], ends, strict=False))
    own = {i for i, _ in chunk_dedup.chunk_ids(data, table, b"k", 16)}
    moved = {i for i, _ in chunk_dedup.chunk_ids(b"inserted" + data, table, b"k", 16)}
    assert len(own & moved) > 0.9 * len(own)


def test_packing(spark, odd, none):
    from tokenizers import Tokenizer

    path = packing.tokenizer_path()
    rows = ODD + [(100 + i, " ".join(f"Word{j % (i + 3)}, it's" for j in range(i * 7))) for i in range(120)]
    got = packing.pack(docs_of(spark, rows), path).collect()
    model = Tokenizer.from_file(path)
    want = collections.Counter(tuple([*model.encode(t or "", add_special_tokens=False).ids, 1]) for _, t in rows)
    by = collections.defaultdict(list)
    for r in got:
        if r["doc_id"] in (6,):
            continue  # repeated rows can't be told apart here
        by[(r["doc_id"], r["doc_tokens"])].append(r)
    whole = collections.Counter()
    for pieces in by.values():
        pieces.sort(key=lambda r: r["start"])
        ids = np.concatenate([np.frombuffer(r["ids"], "<u4") for r in pieces]).tolist()
        assert [r["start"] for r in pieces] == np.cumsum([0, *[r["length"] for r in pieces[:-1]]]).tolist()
        whole[tuple(ids)] += 1
    six = tuple([*model.encode("a b c d e", add_special_tokens=False).ids, 1])
    assert whole + collections.Counter({six: 2}) == want
    sequences = collections.defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    sizes = []
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        sizes.append(at)
    assert max(sizes) <= 2048 and sum(s < 2048 for s in sizes) <= 1
    assert packing.pack(none, path).count() == 0


def test_packing_plan_uses_combinations():
    histogram = np.zeros(65, np.int64)
    histogram[[10, 20, 34, 32, 64]] = [30, 30, 30, 11, 4]
    p = packing.plan(histogram, 64)
    assert (p["step"] == 0).sum() <= 1  # 10 + 20 + 34 and 32 + 32 fill windows; only one 32 is left
    x = packing.non_negative_least_squares(packing.combinations(histogram, 64), histogram.astype(float))
    assert (x >= 0).all()


def test_shard_tree(spark, odd, none):
    base = shard_tree.topology(8)
    rows = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    got = shard_tree.shard_documents(rows, base, [*base, shard_tree.Shard(2, 4, 8)]).collect()
    counts = collections.Counter(r["shard"] for r in got)
    assert all(abs(counts[s] - 2500) < 250 for s in range(8))
    for s in range(8):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(counts[s]))
    moved = [r for r in got if r["shard"] != r["grown_shard"]]
    assert {r["grown_shard"] for r in moved} == {8} and abs(len(moved) / 20_000 - 1 / 9) < 0.02
    heavier = [shard_tree.Shard(s.region, s.rack, s.shard, 2.0 if s.shard == 3 else 1.0) for s in base]
    after = shard_tree.place(shard_tree.place(rows, ["doc_id"], base, "a"), ["doc_id"], heavier, "b").where("a != b").select("b").distinct().collect()
    assert {r["b"] for r in after} <= {0, 1, 2, 3}  # only the region of shard 3 gains weight
    edge = shard_tree.shard_documents(odd, base, base).collect()
    assert len(edge) == len(ODD) and {(r["doc_id"], r["size"]) for r in edge} >= {(1, 1), (2, 1), (4, 4)}
    assert shard_tree.shard_documents(none, base, base).count() == 0


def test_gapless_rank(spark):
    rows = spark.range(5000).select((F.col("id") % 3).alias("g"), "id")
    got = gapless_rank(rows, ["g"], [F.col("id")], 16, "r").groupBy("g").agg(F.min("r"), F.max("r"), F.countDistinct("r"), F.count("r")).collect()
    assert all(r[1] == 0 and r[2] + 1 == r[3] == r[4] for r in got)


def test_mixing(spark, small, odd, none):
    got = mixing.apportion_documents(small).collect()
    by = collections.defaultdict(lambda: [0, 0.0, 0])
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"] and r["size"] == len((r["text"] or "").encode().split())
        by[r["source"]][0] += r["size"]
        by[r["source"]][1] = r["target"]
        by[r["source"]][2] += r["taken"]
    total = sum(v[0] for v in by.values())
    assert abs(sum(v[1] for v in by.values()) - 1.5 * total) < 1e-3 * total
    for size, target, taken in by.values():
        assert target <= 2 * size + 1e-6 and abs(taken - target) <= 200 + 0.05 * target
    again = {(r["doc_id"], r["taken"]) for r in mixing.apportion_documents(small).collect()}
    assert again == {(r["doc_id"], r["taken"]) for r in got}
    assert mixing.apportion_documents(odd).count() == len(ODD) and mixing.apportion_documents(none).count() == 0


def test_mix_meets_targets_in_whole_documents(spark, odd, none):
    rng = np.random.default_rng(4)
    lengths = np.minimum(rng.lognormal(5, 1, 1200).astype(int) + 1, 4000).tolist()
    docs = docs_of(spark, [(i, " ".join(["w"] * n), None, f"s{i % 6}") for i, n in enumerate(lengths)])
    target = {r["source"]: r["target"] for r in mixing.apportion_documents(docs).select("source", "target").distinct().collect()}
    times = collections.Counter(r["doc_id"] for r in mixing.mix(docs).select("doc_id").collect())
    words = collections.Counter()
    for i, n in enumerate(lengths):
        words[f"s{i % 6}"] += n * times[i]
    assert all(abs(words[s] - t) <= 64 + 0.005 * t for s, t in target.items())
    blocks = mixing.apportion_documents(docs, whole=False).groupBy("source").agg({"taken": "sum"}).collect()
    assert all(abs(r[1] - target[r[0]]) <= 64 + 0.005 * target[r[0]] for r in blocks)
    copies = docs_of(spark, [(1, "a b c", None, "s")] * 7 + [(2, "a b", None, "t")] * 40)
    assert {r["doc_id"]: r["count"] for r in mixing.mix(copies).groupBy("doc_id").count().collect()} == {1: 14, 2: 40}  # at the cap; one block once
    assert mixing.mix(odd).count() > 0 and mixing.mix(none).count() == 0


def test_whole_times():
    rng = np.random.default_rng(6)
    for ratio in (0.3, 0.8, 1.3, 1.7):
        sizes = np.sort(np.minimum(rng.lognormal(5, 1, 400).astype(int) + 1, 4000))[::-1]
        long = 0
        for _ in range(50):
            times = mixing.whole_times(sizes, np.floor(sizes * ratio).astype(int), rng.random(400), 2)
            assert times.min() >= 0 and times.max() <= 2 and abs((times * sizes).sum() - np.floor(sizes * ratio).sum()) <= 20
            long += times[:20].mean() / 50
        assert abs(long - ratio) < 0.1  # long documents come as often as others
    assert mixing.whole_times(np.array([900, 100, 0]), np.array([800, 90, 0]), np.array([0.0, 0.0, 0.0]), 2).tolist() == [1, 0, 0]


def test_sainte_lague_is_highest_quotients():
    rng = np.random.default_rng(2)
    for _ in range(40):
        w, seats = rng.integers(0, 500, 9).astype(float), int(rng.integers(0, 200))
        caps = rng.integers(0, 60, 9).tolist()
        want = [0] * 9
        for _ in range(min(seats, sum(c for c, x in zip(caps, w, strict=True) if x > 0))):
            q = [x / (2 * k + 1) if k < c and x > 0 else -1 for x, k, c in zip(w, want, caps, strict=True)]
            want[int(np.argmax(q))] += 1
        assert mixing.sainte_lague(w.tolist(), seats, caps) == want


def test_matroska(spark, odd, none):
    for r in matroska.digests(matroska.encode(odd)).collect():
        text = next(t for d, t in ODD if d == r["doc_id"] and (t or "") is not None)
        payload = matroska.pad((text or "").encode())
        if r["doc_id"] != 6:
            assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["payload_bytes"] == len(payload)
    assert matroska.digests(matroska.encode(none)).count() == 0
    assert matroska.packets(matroska.encode(odd)).where("length != 576").count() == 0
    rng = random.Random(0)
    for lacing in (matroska.XIPH, matroska.EBML_LACING):  # frames of unequal sizes
        frames = [rng.randbytes(rng.randrange(0, 900)) for _ in range(20)]
        body = matroska.block(300, -5, frames, lacing)
        data = matroska.element(matroska.SEGMENT, matroska.element(matroska.CLUSTER, matroska.number(matroska.TIMESTAMP, 70) + matroska.element(matroska.BLOCK_GROUP, matroska.element(matroska.BLOCK, body))))
        found = matroska.parse(data).packets
        assert [data[s : s + n] for _, _, s, n, _ in found] == frames and {(t, ts) for t, ts, *_ in found} == {(300, 65)}
    media = matroska.parse(matroska.mux(bytes(576 * 200)))
    assert [p[1] for p in media.packets] == [576 * i for i in range(200)] and len(media.cues) == len(media.clusters) == 4
    with pytest.raises(ValueError):
        matroska.parse(matroska.mux(bytes(576))[:-30])


def test_url_filter(spark):
    urls = [None, "", "no scheme", "http://ORG", "http://org/", "https://a.org/x", "http://example.org/es/1?q#f", "http://m.example.org/en/12", "http://notexample.org/es/", "http://a.com/x.example.org/es/", "http://b.com/de/" + "x" * 5000, "x://y://z.com/fr/", "http://example.org#/es/", "http://Exämple.COM/fr/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(pages).collect()}
    assert len(got) == len(urls)
    for i, url in enumerate(urls):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:].split("?")[0].split("#")[0]
        fits = [(len(r), r, v) for v, r in url_filter.RULES for h, p in [(r[: r.index("/")], r[r.index("/") :])] if (host == h or host.endswith("." + h)) and path.startswith(p)]
        want = max(fits)[1:] if fits else (None, "allow")
        assert got[i] == (host, path, *want), url


def test_language_id(spark, odd, none):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.fit(docs.where(id_remainder(3) != 1))
    rows = language_id.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert rows.where("lang = lang_pred").count() > 0.97 * rows.count()
    got = language_id.predict(odd, model).collect()
    assert all((r["lang_pred"], r["score"]) == ("und", 0.0) for r in got if r["doc_id"] in (1, 2, 3)) and all(0 <= r["score"] <= 1 for r in got)
    assert language_id.fit(none) is None and language_id.predict(none, None).count() == 0
    code = language_id.codewords(12)
    assert min((code[a] != code[b]).sum() for a in range(12) for b in range(a)) >= 15


def test_quality_rules(spark, odd, none):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    ensemble = quality_rules.train(docs, labels.where(id_remainder(4) != 2))
    rows = quality_rules.score_documents(docs, ensemble).join(labels, "doc_id").where(id_remainder(4) == 2)
    assert rows.where("predicted = quality").count() > 0.95 * rows.count()
    values = quality_rules.statistics(docs).select("_s.*").toPandas().to_numpy(float)
    compiled = np.sort(quality_rules.score_documents(docs, ensemble).toPandas()["score"].to_numpy())
    assert np.allclose(np.sort(ensemble.scores(values)), compiled)
    got = quality_rules.score_documents(odd, ensemble)
    assert got.count() == len(ODD) and got.where("score BETWEEN 0 AND 1").count() == len(ODD)
    assert quality_rules.score_documents(none, quality_rules.train(none, labels.where("false"))).count() == 0


def test_chat_rotation(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "hi"), (1, 2, None, None), (1, 2, "user", "hi"), (None, 0, "user", "x"), (2, None, "a", "")] + [(3, i, "ab"[i % 2], f"m{i}") for i in range(700)]
    got = chat.rotate(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r["conv_id"], r["perspective"]].append(r)
    assert set(by) == {(c, who or "unknown") for c, _, who, _ in rows}
    for (conv, who), parts in by.items():
        parts.sort(key=lambda r: r["begin"])
        whole = "".join(r["rendered"] for r in parts)
        own = [(t or "") for c, _, _, t in rows if c == conv]
        assert sorted(whole[r["begin"] : r["end"]] for r in parts) == sorted(own)
        assert all((r["mask"] == 1) == (r["speaker"] == who) for r in parts)


def test_shingles_match_words():
    texts = [None, "", "a", "A b", "a b c d e a b c d", "x\x1cy z w v"]
    sizes = [len(s) for s in ngram_join.shingles(pa.array(texts, pa.string()), 4)]
    assert sizes == [0, 0, 1, 1, 6 - 1, 1]
