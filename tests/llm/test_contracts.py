"""The operators' results column by column against plain Python, and the cases their docstrings name."""

import collections
import hashlib
import math
import random
import re
import struct
import time
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from gridweave.llm import chat, chunk_dedup, language_id, matroska, mixing, ngram_join, packing, quality_rules, shard_tree, url_filter
from gridweave.llm.common import Workspace, bucket_count, look_up, word_count
from tests.llm.test_operators import LONG, ODD, SMALL, classes, docs_of, none, odd, small  # noqa: F401

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
BREAKS = ["a  ", "a \u0085", " b\n", " a\r\n", " ", "a　b c", "\x1cq\x1d r", "x\n \n"]


def xx64(seed, *values):
    """Spark's xxhash64 of ints (4 bytes), longs (as (value,)) and strings; nulls leave the hash as it is."""
    h = 42
    for v in (seed, *values):
        if v is not None:
            raw = v.encode() if isinstance(v, str) else struct.pack("<q", v[0]) if isinstance(v, tuple) else struct.pack("<i", v)
            h = xxhash.xxh64_intdigest(raw, h)
    return h


def signed(h):
    return h - (1 << 64) if h >> 63 else h


def test_word_count(spark):
    texts = [None, "", *BREAKS, *(t for _, t in ODD if t)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", word_count().alias("n")).collect()
    assert {r["i"]: r["n"] for r in rows} == {i: len(WORDS.findall(t or "")) for i, t in enumerate(texts)}


def brute_mix(rows, weights=(3, 1, 2), share=1.5, cap=2, block=64, seed=11):
    """rows: (doc_id, text, source), ids distinct. (size, source_size, target, taken) by id, word by word."""
    size = {d: len(WORDS.findall(t or "")) for d, t, _ in rows}
    sources = sorted({s for *_, s in rows}, key=lambda s: (s is None, s or ""))
    total = {s: sum(size[d] for d, _, x in rows if x == s) for s in sources}
    weight = {s: weights[i % len(weights)] for i, s in enumerate(sources)}
    target, fixed = {}, {}
    while True:
        left = share * sum(total.values()) - sum(fixed.values())
        free = [s for s in sources if s not in fixed]
        target = fixed | {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if target[s] > cap * total[s]]
        if not over:
            break
        fixed |= {s: float(cap * total[s]) for s in over}
        if len(fixed) == len(sources):
            target = fixed
            break
    shards = bucket_count(len(rows), 200)
    lines = collections.defaultdict(list)
    for d, t, s in rows:
        h = xx64(seed, (d,), t)
        shard = signed(xx64((signed(h),), seed + 1)) % shards
        lines[sources.index(s), shard].append((signed(h), d))
    lines = {k: sorted(v) for k, v in sorted(lines.items()) if sum(size[d] for _, d in v)}
    words = {k: sum(size[d] for _, d in v) for k, v in lines.items()}
    blocks = {k: max(1, round(n / block)) for k, n in words.items()}

    def seats(parties, n, most):
        got = dict.fromkeys(parties, 0)
        for _ in range(min(n, sum(most[p] for p in parties if parties[p] > 0))):
            best = max((p for p in parties if got[p] < most[p]), key=lambda p: (parties[p] / (2 * got[p] + 1), -list(parties).index(p)))
            got[best] += 1
        return got

    own = {i: [k for k in lines if k[0] == i] for i in {k[0] for k in lines}}
    wanted = {i: target[sources[i]] / total[sources[i]] * sum(blocks[k] for k in own[i]) for i in sorted(own)}
    per_source = seats(wanted, round(sum(wanted.values())), {i: cap * sum(blocks[k] for k in own[i]) for i in own})
    rng, taken = np.random.default_rng(seed), dict.fromkeys(size, 0)
    quota = {}
    for i in sorted(own):
        quota |= seats({k: float(words[k]) for k in own[i]}, per_source[i], {k: cap * blocks[k] for k in own[i]})
    for k, docs in lines.items():
        n = blocks[k]
        a, b = int(rng.integers(1, n + 1)), int(rng.integers(0, n))
        while math.gcd(a, n) != 1:
            a = a % n + 1
        chosen = {j for j in range(n) if (a * j + b) % n < quota[k] % n}
        owner = [d for _, d in docs for _ in range(size[d])]
        for j in range(n):
            for w in range(math.floor(j * words[k] / n), math.floor((j + 1) * words[k] / n)):
                taken[owner[w]] += quota[k] // n + (j in chosen)
    return {d: (size[d], total[s], target[s], taken[d]) for d, _, s in rows}


def test_mixing_block_by_block(spark, small):
    rng = random.Random(8)
    rows = [(r["doc_id"], r["text"], r["source"]) for r in small.collect()]
    rows += [(10_000 + i, " ".join(["w"] * rng.randrange(300)), rng.choice(["s", None, "lone"])) for i in range(300)]
    rows += [(20_000 + i, t, "odd") for i, t in enumerate([None, "", *BREAKS, LONG])]
    got = mixing.apportion_documents(spark.createDataFrame(rows, "doc_id long, text string, source string"), whole=False, keep=["doc_id"])
    want = brute_mix(rows)
    for r in got.collect():
        size, source_size, target, taken = want[r["doc_id"]]
        assert (r["size"], r["source_size"], r["taken"]) == (size, source_size, taken) and math.isclose(r["target"], target)


def test_mixing_bounds_its_sources(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SOURCES", 3)
    with pytest.raises(ValueError):
        mixing.apportion_documents(docs_of(spark, [(i, "a", None, f"s{i}") for i in range(4)]), whole=False)


def test_matroska_digest(spark):
    texts = [None, "", "one", "é" * 400, "x" * 576, "y" * 577, LONG, "one"]
    files = {r["doc_id"]: bytes(r["media"]) for r in matroska.encode(docs_of(spark, list(enumerate(texts)))).collect()}
    for r in matroska.digests(matroska.encode(docs_of(spark, list(enumerate(texts))))).collect():
        raw = (texts[r["doc_id"]] or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        data, frames = files[r["doc_id"]], len(payload) // 576
        feature = f"packets={frames};clusters={-(-frames // 56)};cues={-(-frames // 56)};last={576 * (frames - 1)};codec=A_PCM/INT/LIT;mean={sum(payload) // len(payload)}"
        assert tuple(r)[1:] == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), feature)


def live(clusters, block):
    """A file as a live muxer leaves it: the segment and its clusters have no size."""
    no_size = b"\x01" + b"\xff" * 7
    body = b"".join(matroska.CLUSTER.to_bytes(4, "big") + no_size + matroska.number(matroska.TIMESTAMP, 10 * i) + matroska.element(matroska.SIMPLE_BLOCK, block) for i in range(clusters))
    return matroska.SEGMENT.to_bytes(4, "big") + no_size + body


def test_live_files_are_parsed_in_one_pass():
    block = matroska.block(1, 0, [b"abc"], matroska.NO_LACING)
    data = live(10_000, block) + live(2, block)
    began = time.time()
    media = matroska.parse(data)
    assert time.time() - began < 5
    assert [p[1] for p in media.packets] == [10 * i for i in range(10_000)] + [0, 10] and len(media.clusters) == 10_002
    assert all(data[s : s + n] == b"abc" for _, _, s, n, _ in media.packets)


def test_every_cut_and_flip_is_a_value_error_or_a_result():
    rng = random.Random(1)
    frames = [rng.randbytes(rng.randrange(0, 600)) for _ in range(6)]
    files = [matroska.mux(bytes(576 * 9)), live(3, matroska.block(2, 1, frames, matroska.XIPH)), live(2, matroska.block(2, 1, frames, matroska.EBML_LACING))]
    for data in files:
        for at in [*range(0, min(len(data), 400)), *(rng.randrange(len(data)) for _ in range(100))]:
            for broken in (data[:at], data[:at] + bytes([data[at] ^ 1 << rng.randrange(8)]) + data[at + 1 :]):
                try:
                    matroska.parse(broken)
                except ValueError:
                    pass
    for body in (b"\x81", b"\x81\0\0", matroska.size_vint(1) + struct.pack(">hB", 0, 2), matroska.size_vint(1) + struct.pack(">hB", 0, 2) + b"\x05\xff\xff"):
        with pytest.raises(ValueError):
            matroska.parse(matroska.element(matroska.SEGMENT, matroska.element(matroska.CLUSTER, matroska.element(matroska.SIMPLE_BLOCK, body))))


def test_language_slices_and_letters(spark):
    text = "Grüße aus 日本 " * 50
    whole = np.sort(language_id.n_grams(b" " + text.lower().encode() + b" ", 1 << 30))
    for width in (1, 2, 3, 7, 64, 10**6):
        assert (np.sort(np.concatenate(list(language_id.pieces(text, width)))) == whole).all()
    model = language_id.fit(spark.read.parquet(f"{SMALL}/documents.parquet"))
    rows = docs_of(spark, [(i, t) for i, t in enumerate(["²½", "Ⅷ", "12 _ !", "", None, " ", "é"])])
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.predict(rows, model).collect()}
    assert [got[i] for i in range(6)] == ["und"] * 6 and got[6] in model.languages


def test_language_decoding_in_plain_python(spark, small):
    model = language_id.fit(small)
    mask = (1 << 32) - 1
    for r in language_id.predict(small.limit(40), model).join(small, "doc_id").collect():
        b = b" " + r["text"].lower().encode() + b" "
        grams = [(x * 0x9E3779B1 + y * 0x85EBCA6B & mask) >> 20 for x, y in zip(b, b[1:], strict=False)]
        grams += [(x * 0xC2B2AE35 + y * 0x27D4EB2F + z * 0x165667B1 & mask) >> 20 for x, y, z in zip(b, b[1:], b[2:], strict=False)]
        margin = [math.fsum(float(model.weights[g, k]) for g in grams) / len(grams) + model.bias[k] for k in range(model.code.shape[1])]
        loss = [sum(t * math.log1p(math.exp(-c * m)) for t, c, m in zip(model.trust[i], model.code[i], margin, strict=True)) for i in range(len(model.languages))]
        share = [math.exp(min(loss) - x) for x in loss]
        best = int(np.argmax(share))
        assert r["lang_pred"] == model.languages[best] and math.isclose(r["score"], share[best] / sum(share), rel_tol=1e-5)


def test_logistic_by_rows_is_gradient_descent_on_weights():
    rng = np.random.default_rng(3)
    x, y = rng.random((60, 200)), np.where(rng.random((60, 3)) < 0.5, -1.0, 1.0)
    a, decay = np.hstack([x, np.ones((60, 1))]), 1e-2
    w = language_id.logistic(x, y, steps=20_000, decay=decay)
    slope = -(a.T @ (y / (1 + np.exp(y * (a @ w))))) / 60 + decay * w
    assert np.abs(slope).max() < 1e-6  # at the minimum


def test_languages_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(language_id, "LANGUAGES", 2)
    with pytest.raises(ValueError):
        language_id.fit(docs_of(spark, [(i, "text", lang) for i, lang in enumerate("abc")]))


def test_shards_draw_by_draw(spark, small):
    def draw(level, node, weight, doc):
        return -math.log(((xx64(7, level, node, None if doc is None else (doc,)) >> 12) + 0.5) / (1 << 52)) / weight

    def descend(shards, doc):
        for level, of in (("region", lambda s: s.region), ("rack", lambda s: s.rack), ("shard", lambda s: s.shard)):
            nodes = {of(s) for s in shards}
            best = min(nodes, key=lambda n: draw(level, n, sum(s.weight for s in shards if of(s) == n), doc)) if len(nodes) > 1 else next(iter(nodes))
            shards = [s for s in shards if of(s) == best]
        return shards[0].shard

    base = shard_tree.topology(8)
    grown = [*base, shard_tree.Shard(2, 4, 8)]
    rows = [(r["doc_id"], r["text"]) for r in small.collect()] + [(10_000 + i, t) for i, t in enumerate(["", None, "é", LONG])] + [(None, "n"), (3, "again"), (3, "again")]
    got = shard_tree.shard_documents(docs_of(spark, rows), base, grown).collect()
    want = collections.Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), "key", descend(base, d), descend(grown, d)) for d, t in rows)
    assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"], r["law"], r["shard"], r["grown_shard"]) for r in got) == want
    for s in range(8):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))


def test_packing_digest(spark, small):
    packed = packing.pack(small, packing.tokenizer_path())
    ids = {(r["doc_id"], r["start"]): bytes(r["ids"]) for r in packed.collect()}
    for r in packing.digest(packing.pack(small, packing.tokenizer_path())).collect():
        body = ids[r["doc_id"], r["start"]]
        assert r["ids_crc32"] == zlib.crc32(body) and 4 * r["length"] == len(body)


def test_quality_statistics(spark, odd):
    texts = [t for _, t in ODD if t] + ["AbC! 12 12 12 | x", "a, b. c; d:", "UPPER UPPER #$ {}", "l1\nl2\n\nl3", "ÀÉ ß two two"]
    rows = quality_rules.statistics(docs_of(spark, list(enumerate(texts)))).select("doc_id", "_s.*").collect()
    for r in rows:
        t = texts[r["doc_id"]]
        w = WORDS.findall(t)
        chars, words = len(t), len(w)
        per = lambda x, n: x / n if n else 0.0
        spaced = re.split(r"[ \t\n\x0b\f\r]+", t)
        repeats = sum(a == b and a != "" for a, b in zip(spaced, spaced[1:], strict=False))
        want = {
            "chars": chars, "words": words, "word_length": per(chars, words), "distinct": per(len(set(w)), words), "repeats": per(repeats, words),
            "upper": per(sum(c.isupper() for c in t), chars), "digits": per(sum(c in "0123456789" for c in t), chars), "exclaims": per(sum(c in "!?" for c in t), words),
            "symbols": per(sum(c in "#$%&*+<=>@^~\\{}[]" for c in t), words), "bars": per(t.count("|"), words), "stops": per(sum(c in ".,;:" for c in t), words), "lines": t.count("\n"),
        }
        for k, v in want.items():
            assert math.isclose(r[k], v), (t[:40], k)


def test_quality_fits_a_row_a_label(spark):
    docs = docs_of(spark, [(1, "a b")] * 50 + [(1, f"t{i}") for i in range(50)] + [(2, "c c c")] * 20)
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (3, None), (None, 1)], "doc_id long, quality int")
    ensemble = quality_rules.train(docs, labels)
    assert quality_rules.score_documents(docs, ensemble).where("score BETWEEN 0 AND 1").count() == 120


@pytest.mark.parametrize("bytes_of_name", [1, 8])
def test_sets_that_share_a_name_are_told_apart(spark, bytes_of_name):
    rng = random.Random(9)
    base = [f"v{i}" for i in range(40)]
    rows = [(i, " ".join([*base[: 30 + i % 10], f"x{i // 3}"])) for i in range(40)] + [(100 + i, " ".join(f"q{rng.randrange(10**6)}" for _ in range(8))) for i in range(300)]
    got = ngram_join.join_classes(docs_of(spark, rows), 4, 85, bytes_of_name=bytes_of_name).collect()
    assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got} == {(d, *w) for (d, _), w in zip(rows, classes(rows, 4, 85), strict=True)}


def test_look_up_spreads_large_classes(spark):
    rows = spark.range(20_000).select(F.when(F.col("id") % 3 > 0, F.lit(7)).when(F.col("id") % 2 > 0, F.col("id")).alias("k"), "id")
    found = Workspace(spark, "t").write(rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("k IS NOT NULL"), "classes")
    got = look_up(rows, found, ["k"], "n", most=64, least=10)
    assert got.count() == 20_000 and got.where("k = 7 AND n != 13333").count() == got.where("k IS NULL AND n IS NOT NULL").count() == 0
    assert got.where("k != 7 AND n != 1").count() == 0 and got.where("k IS NOT NULL AND n IS NULL").count() == 0
    assert look_up(rows, found.where("false"), ["k"], "n").where("n IS NOT NULL").count() == 0


def test_chat_edges(spark):
    schema = "conv_id long, turn long, role string, text string, span int, perspective string, size int"
    rng = random.Random(2)
    rows = [(1, None, rng.choice("ab"), f"t{rng.randrange(40)}") for _ in range(400)] + [(2, 10**12 * i, "ab"[i % 2], LONG if i == 3 else f"m{i}") for i in range(40)]
    rows += [(3, 5, "a", "same")] * 30 + [(None, 1, None, None), (None, 2, "a", "x")]
    table = spark.createDataFrame([(*r, 1, "p", 2) for r in rows], schema)
    parts = collections.defaultdict(list)
    for r in chat.rotate(table).collect():
        parts[r["conv_id"], r["perspective"]].append(r)
    assert set(parts) == {(c, who or "unknown") for c, _, who, _ in rows}
    for (conv, who), mine in parts.items():
        mine.sort(key=lambda r: r["begin"])
        own = sorted(((t is not None, t or 0, s or "unknown", x or "") for c, t, s, x in rows if c == conv))
        whole = "".join(("<|assistant|>" if s == who else f"<|user name={s}|>") + "\n" + x + "<|end|>\n" for _, _, s, x in own)
        assert "".join(r["rendered"] for r in mine) == whole
        assert [(r["speaker"], whole[r["begin"] : r["end"]], r["mask"], r["role"]) for r in mine] == [(s, x, int(s == who), "assistant" if s == who else "user") for _, _, s, x in own]
    assert chat.rotate(table.where("false")).count() == 0


def test_url_edges(spark):
    pages = spark.createDataFrame([(1, "http://a.org/", "x", 3), (1, "http://a.org/", "x", 3), (2, None, None, None), (None, "http://example.org/es/" + "z" * 70_000, "y", 1)], "page_id long, url string, host string, rule int")
    got = collections.Counter((r["page_id"], r["host"], len(r["path"]), r["rule"], r["verdict"]) for r in url_filter.judge(pages).collect())
    assert got == collections.Counter({(1, "a.org", 1, "org/", "allow"): 2, (2, "", 0, None, "allow"): 1, (None, "example.org", 70_004, "example.org/es/", "block"): 1})
    assert {r["verdict"] for r in url_filter.judge(pages, [], "block").collect()} == {"block"}
    assert url_filter.judge(pages.where("false")).count() == 0
    many = [("block", f"h{i}.net/p{i}") for i in range(150)]  # over a thousand positions, so many words
    urls = spark.createDataFrame([(i, f"http://{'s.' * (i % 2)}h{i}.net/p{i}/q") for i in range(160)], "page_id long, url string")
    assert {r["page_id"]: r["rule"] for r in url_filter.judge(urls, many).collect()} == {i: many[i][1] if i < 150 else None for i in range(160)}


def test_chunk_recipes_keep_the_longest_original(spark):
    rows = [(1, "a b"), (2, "a  b"), (3, "ab"), (4, " a b "), (5, " a b ")]
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in chunk_dedup.deduplicate(docs_of(spark, rows)).collect()}
    assert got == {i: (4, 5, i == 4) for i in range(1, 6)}


def test_language_fit_takes_copies_once(spark, monkeypatch):
    """100,000 copies of one labelled text bring one row to the driver, and no language more than its share."""
    plain = [(i, f"the and of to in number {i} a", "en") for i in range(30)] + [(100 + i, f"der und die das nicht zahl {i} ein", "de") for i in range(30)]
    rows = spark.createDataFrame(plain, "doc_id long, text string, lang string")
    copies = spark.range(1000, 101_000).select(F.col("id").alias("doc_id"), F.lit("the same text again and again").alias("text"), F.lit("en").alias("lang"))
    seen = []
    real = np.stack
    monkeypatch.setattr(language_id.np, "stack", lambda a, *b, **c: (seen.append(len(a)), real(a, *b, **c))[1])
    model = language_id.fit(rows.unionByName(copies), per_language=20)
    assert seen[0] <= 40 and model.languages == ["de", "en"]
    assert language_id.fit(rows.unionByName(copies)).languages == ["de", "en"] and max(seen) <= 61
