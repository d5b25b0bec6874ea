"""GIF round trips and files, mixing against brute force, quality and language on held-out rows."""

import hashlib
import math
import os
import random
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest

from sluice.llm import gif_media as gif
from sluice.llm import language_id, mixing, quality

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("rows", [1, 3, 64, 65, 130])
def test_payloads_come_back(rows):
    rng = random.Random(rows)
    n = gif.ROW * rows
    for payload in (os.urandom(n), b"a" * n, bytes(rng.choice(b"abc ") for _ in range(n)), bytes(range(256)) * (n // 256) + b"\xff" * (n % 256)):
        frames = [(np.ascontiguousarray(f.drawn[..., 0]).tobytes(), f.at_ms) for f in gif.read_gif(gif.write_gif(payload))]
        assert b"".join(p for p, _ in frames) == payload
        assert len(frames) == -(-rows // gif.FRAME_ROWS) and frames[-1][1] == (len(frames) - 1) * 10 * gif.DELAY_CS


def image(pixels, w, h, left=0, top=0, minimum=2, palette=b"", flags=0, control=None):
    """A frame of a hand-made file: codes are written with a clear before every second pixel, so widths never grow."""
    clear, width, bits, n = 1 << minimum, minimum + 1, 0, 0
    for k, p in enumerate(pixels):
        for c in ([clear] if k % 2 == 0 else []) + [p]:
            bits |= c << n
            n += width
    bits |= (clear + 1) << n
    data = bits.to_bytes((n + width + 7) // 8, "little")
    out = b"" if control is None else struct.pack("<BBBBHBB", 0x21, 0xF9, 4, control[0] << 2 | (control[2] is not None), control[1], control[2] or 0, 0)
    return out + struct.pack("<BHHHHB", 0x2C, left, top, w, h, flags) + palette + bytes([minimum, len(data)]) + data + b"\0"


RED, GREEN, BLUE, WHITE = (255, 0, 0), (0, 255, 0), (0, 0, 255), (255, 255, 255)


def file(*frames, w=2, h=2, palette=(RED, GREEN, BLUE, WHITE)):
    return b"GIF89a" + struct.pack("<HHBBB", w, h, 0x81, 0, 0) + bytes(v for c in palette for v in c) + b"".join(frames) + b";"


def colours(f):
    return [[tuple(map(int, p)) for p in row] for row in f.canvas]


def test_transparency_disposal_and_local_palettes():
    local = bytes((9, 9, 9, 8, 8, 8))
    raw = file(
        image([0, 1, 2, 3], 2, 2, control=(1, 5, None)),
        image([1, 0], 1, 2, left=1, control=(2, 7, 1)),  # green is transparent; the area is cleared afterwards
        image([1], 1, 1, palette=local, flags=0x80, control=(3, 0, None)),  # back to what was before, afterwards
        image([2], 1, 1, top=1),
    )
    a, b, c, d = [(f.at_ms, f.delay_ms, colours(f)) for f in map(lambda f: gif.Frame(**{**f.__dict__, "canvas": f.canvas.copy()}), gif.read_gif(raw))]
    o = lambda c: (*c, 255)
    none = (0, 0, 0, 0)
    assert a == (0, 50, [[o(RED), o(GREEN)], [o(BLUE), o(WHITE)]])
    assert b == (50, 70, [[o(RED), o(GREEN)], [o(BLUE), o(RED)]])
    assert c == (120, 0, [[(8, 8, 8, 255), none], [o(BLUE), none]])
    assert d == (120, 0, [[o(RED), none], [o(BLUE), none]])


def test_interlaced_rows():
    f = next(gif.read_gif(file(image([0, 1, 2, 3, 0], 1, 5, flags=0x40), w=1, h=5)))
    assert [r[0] for r in colours(f)] == [(*RED, 255), (*WHITE, 255), (*BLUE, 255), (*RED, 255), (*GREEN, 255)]


def test_frames_table(spark):
    media = spark.createDataFrame([(1, file(image([0, 1, 2, 3], 2, 2))), (2, None), (3, b"nonsense"), (4, file(image([0, 1, 2, 3], 2, 2))[:-9])], "doc_id long, media binary")
    got = {(r.doc_id, r.frame): r for r in gif.frames(media).collect()}
    assert set(got) == {(1, 0), (3, None), (4, None)} and got[3, None].error
    assert sum(got[1, 0].red) == 4 and got[1, 0].red[-1] == 2 and got[1, 0].width == 2


def test_media_digests(spark):
    rows = [(1, "héllo"), (2, None), (3, ""), (None, "x" * 576), (5, "y " * 40_000), (6, "héllo"), (6, "héllo")]
    docs = spark.createDataFrame([(i, t, "f") for i, t in rows], "doc_id long, text string, feature string")
    got = gif.media_digests(docs).collect()
    for r, (i, t) in zip(got, rows, strict=True):
        raw = (t or "").encode()
        payload = raw + b"\xff" * ((-len(raw)) % 576 if raw else 576)
        assert (r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (i, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        media = gif.write_gif(payload)
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
    assert got[0].feature == got[5].feature and gif.media_digests(docs.where("false")).count() == 0
    files = gif.stored(docs).collect()
    assert hashlib.sha256(files[0].media).hexdigest() == got[0].media_sha256


# mixing


def brute_targets(sizes):
    """Targets by repeated resharing."""
    total, names = sum(sizes.values()), sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    capped = set()
    while True:
        left = total - sum(3 * sizes[s] for s in capped)
        w = sum(weight[s] for s in names if s not in capped)
        over = [s for s in names if s not in capped and left * weight[s] / w > 3 * sizes[s]]
        if not over:
            return {s: 3.0 * sizes[s] if s in capped else left * weight[s] / w for s in names}
        capped.update(over)


def mix_rows():
    rng = random.Random(8)
    rows = [(i, "w " * rng.randint(1, 300), rng.choice(["a"] * 30 + ["b", "c", "é", None])) for i in range(400)]
    return rows + [(900, None, "a"), (901, "", "z"), (902, "x " * 50_000, "a"), (None, "w w w", "b"), (5, "again again", "c"), (5, "again again", "c")]


def test_mix(spark):
    rows = mix_rows()
    docs = spark.createDataFrame([(i, t, s, 1) for i, t, s in rows], "doc_id long, text string, source string, taken int").repartition(4)
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    sizes, taken, target = {}, {}, {}
    for i, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    source = {(i, len((t or "").split())): s for i, t, s in rows}
    for r in got:
        s = source[r.doc_id, r.size]
        assert r.source_size == sizes[s] and 0 <= r.taken <= 3 * r.size
        taken[s], target[s] = taken.get(s, 0) + r.taken, r.target
    want = brute_targets(sizes)
    assert target.keys() == want.keys()
    for s in want:
        assert target[s] == pytest.approx(want[s]) and abs(taken[s] - want[s]) <= max(1, min(32, 0.01 * want[s]))
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(2)).collect()))
    assert mixing.mix(docs.where("false")).count() == 0 and {r.taken for r in mixing.mix(docs.where("text is null")).collect()} == {0}


def test_small_sources_meet_their_targets(spark):
    from pyspark.sql import functions as F

    for tiny in (1, 10, 20, 65, 200):
        rows = [(i, "w " * 100, "big") for i in range(300)] + [(1000 + i, "w " * 100, "mid") for i in range(200)] + [(2000, "w " * tiny, "tiny"), (2001, "w " * (2 * tiny), None)]
        got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).groupBy("source_size").agg(F.first("target").alias("target"), F.sum("taken").alias("taken"), F.max(F.col("taken") / F.col("size")).alias("most")).collect()
        assert {r.source_size: r.taken for r in got if r.source_size <= 400} == {tiny: 3 * tiny, 2 * tiny: 6 * tiny}
        assert all(abs(r.taken - r.target) <= 32 and r.most <= 3 for r in got), got


def test_mixed_documents_hold_the_taken_words(spark):
    docs = spark.createDataFrame([(i, t, s, -1, 7, "x", "y") for i, t, s in mix_rows() if i is not None and i != 5], "doc_id long, text string, source string, n_chars long, row int, words string, epoch string")
    taken = {r.doc_id: r.taken for r in mixing.mix(docs).collect()}
    out = mixing.mixed_documents(docs).collect()
    words = dict.fromkeys(taken, 0)
    for r in out:
        words[r.doc_id] += len(r.text.split())
        assert r.n_chars == len(r.text)
    assert words == taken


def test_permutations_are_bijections(spark):
    from pyspark.sql import functions as F

    for n in (1, 2, 3, 100, 1009):
        for key in (1, 2):
            got = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(key)).alias("p")).collect()
            assert sorted(r.p for r in got) == list(range(n))


def test_permutations_have_inverses(spark):
    from pyspark.sql import functions as F

    for n in (1, 2, 100):
        there = mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(5))
        got = spark.range(n).select("id", mixing.permuted(there, F.lit(n).cast("long"), F.lit(5), inverse=True).alias("p")).collect()
        assert all(r.p == r.id for r in got)


def test_slots_name_every_draw_once(spark):
    docs = spark.createDataFrame([(i, t, s) for i, t, s in mix_rows()], "doc_id long, text string, source string")
    sources = mixing.targets(mixing.sizes(docs), 64).persist()
    slots = mixing.slots(sources, 100, 17).collect()
    draws = {r.source: r.draws for r in sources.collect()}
    blocks = {r.source: r.blocks for r in sources.collect()}
    seen = {(s.source, s.epoch, s.block) for s in slots}
    assert len(seen) == len(slots) == sum(draws.values())
    for name, n in draws.items():
        mine = [s for s in slots if s.source == name]
        assert len(mine) == n and all(0 <= s.block < blocks[name] for s in mine)
        for epoch in range(n // blocks[name] if n else 0):  # whole epochs have every block
            assert {s.block for s in mine if s.epoch == epoch} == set(range(blocks[name]))
    counts = {(r.shard, r.source): r.n for r in mixing.shard_counts(sources, 100, 17).collect()}
    drawn = {}
    for s in slots:
        drawn[s.shard, s.source] = drawn.get((s.shard, s.source), 0) + 1
    assert drawn == counts


def test_shard_counts_look_multinomial(spark):
    docs = spark.createDataFrame([(i, "w " * 640, "ab"[i % 2]) for i in range(4000)], "doc_id long, text string, source string")
    sources = mixing.targets(mixing.sizes(docs), 64)
    counts = mixing.shard_counts(sources, 400, 17).collect()
    for name in "ab":
        n = np.array([r.n for r in counts if r.source == name])
        assert len(n) == 100
        chi = ((n - n.mean()) ** 2 / n.mean()).sum()  # 99 degrees of freedom, each draw alike
        assert 55 < chi < 155


def brute_mix(rows, block_words, shard_slots, seed, spark):
    """Takes word by word, with the hashes that the operator draws by."""
    from pyspark.sql import functions as F

    def h(*parts):
        return spark.range(1).select(F.xxhash64(*[F.lit(p) for p in parts])).first()[0]

    def hashes(items):  # one job for many
        df = spark.createDataFrame([(i, *x) for i, x in enumerate(items)], "i long, k string, seed int, source string, draw long")
        return [r.h for r in df.select("i", F.xxhash64("k", "seed", "source", "draw").alias("h")).orderBy("i").collect()]

    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    target = brute_targets(sizes)
    out, draws, plan = {}, {}, {}
    buckets = max(1, math.isqrt(len(rows)))
    df = spark.createDataFrame([(i, len(t.split())) for i, t, _ in rows], "doc_id long, size long")
    bucket = {r.doc_id: r.b for r in df.select("doc_id", F.pmod(F.xxhash64(F.lit("bucket"), "doc_id", "size"), F.lit(buckets).cast("long")).alias("b")).collect()}
    for s, size in sizes.items():
        words = max(1, min(block_words, size // mixing.MIN_BLOCKS))
        line = [i for i, t, _ in sorted((r for r in rows if r[2] == s), key=lambda r: (bucket[r[0]], r[0])) for _ in t.split()]
        blocks = [line[k : k + words] for k in range(0, size, words)]
        epochs, n = int(target[s] // size), len(blocks)
        perm = lambda e: [r.p for r in spark.range(n).select("id", mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(seed), F.lit(s), F.lit(e).cast("long")).alias("p")).orderBy("id").collect()]  # noqa: E731, B023
        orders = [perm(e) for e in range(min(3, epochs + 1))]
        rest, best = target[s] - epochs * size, (float("inf"), 0)
        if epochs < 3:
            total = 0
            best = (abs(rest), 0)
            for d, b in enumerate(orders[epochs], 1):
                total += len(blocks[b])
                best = min(best, (abs(total - rest), d))
        draws[s], plan[s] = epochs * n + best[1], (blocks, orders)
    shards = -(-sum(draws.values()) // shard_slots)
    taken, by_shard = {}, {}
    for s, n in draws.items():
        blocks, orders = plan[s]
        counts = [0] * shards
        for x in hashes([("shard", seed, s, k) for k in range(n)]):
            counts[x % shards] += 1
        index = 0
        for shard, c in enumerate(counts):
            for _ in range(c):
                for i in blocks[orders[index // len(blocks)][index % len(blocks)]]:
                    taken[i] = taken.get(i, 0) + 1
                    by_shard[i, shard] = by_shard.get((i, shard), 0) + 1
                index += 1
    return taken, by_shard, target


def test_the_mix_equals_brute_force(spark):
    rng = random.Random(4)
    rows = [(i, "w " * rng.randint(1, 300), rng.choice(["a"] * 30 + ["b", "c", "d"])) for i in range(300)] + [(900, "x " * 5000, "a"), (901, "one", "tiny"), (902, "w " * 10, "ten"), (903, "w " * 60, "sixty")]
    taken, by_shard, target = brute_mix(rows, 64, 50, 17, spark)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = mixing.mix(docs, shard_slots=50).collect()
    assert {r.doc_id: r.taken for r in got if r.taken} == taken
    assert {(r.doc_id, x.shard): x.words for r in got for x in r.shards} == by_shard
    of = {i: s for i, _, s in rows}
    for s, want in target.items():
        words = sum(r.taken for r in got if of[r.doc_id] == s)
        assert abs(words - want) <= max(1, min(32, 0.01 * want)), (s, words, want)


def test_shards_are_in_the_result(spark):
    docs = spark.createDataFrame([(i, f"t{i} " * 64, "ab"[i % 2]) for i in range(200)], "doc_id long, text string, source string")
    slots = mixing.slots(mixing.targets(mixing.sizes(docs), 64), 20, 17).collect()
    want, got = {}, {}
    for s in slots:  # a document is a block here
        want[s.source, s.shard] = want.get((s.source, s.shard), 0) + 64
    mixed = mixing.mix(docs, shard_slots=20).collect()
    for r in mixed:
        assert sum(x.words for x in r.shards) == r.taken
        for x in r.shards:
            key = "ab"[r.doc_id % 2], x.shard
            got[key] = got.get(key, 0) + x.words
    assert got == want and len({k for _, k in got}) == 10
    shards = {r.doc_id: sorted(x.shard for x in r.shards for _ in range(x.words // 64)) for r in mixed}
    order = [r.doc_id for r in mixing.mixed_documents(docs, shard_slots=20).collect()]
    left = {i: list(v) for i, v in shards.items()}
    at = 0
    for i in order:  # each row in turn has a shard of its document that is not before the one reached
        later = [k for k in left[i] if k >= at]
        assert later
        at = later[0]
        left[i].remove(at)
    assert not any(left.values())


# language and quality


def test_language_on_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = language_id.language_report(docs).toPandas().merge(docs.select("doc_id", "lang").toPandas(), on="doc_id")
    held = got[got.held_out]
    assert len(got) == 1000 and held.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2).all() and (~got[~got.held_out].doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)).all()
    assert (held.lang_pred == held.lang).mean() > 0.97 and got.score.between(0, 1).all()


def test_language_edges(spark):
    rows = [(1, "the cat sat on the mat", "en"), (2, "le chat est sur le tapis", "fr"), (3, None, "en"), (4, "", None), (5, "123 !?", "fr"), (None, "the mat", None), (7, "the " * 40_000, "en"), (7, "the " * 40_000, "en")]
    docs = spark.createDataFrame([(i, t, x, 1) for i, t, x in rows], "doc_id long, text string, lang string, score int")
    model = language_id.train(docs)
    got = language_id.identify(docs, model).collect()
    assert [r.lang_pred for r in got] == ["en", "fr", "und", "und", "und", "en", "en", "en"]
    assert [r.score for r in got[2:5]] == [0, 0, 0] and got[0].lang == "en"
    assert language_id.language_report(docs.where("false")).count() == 0
    none = language_id.language_report(docs.withColumn("lang", docs["lang"].substr(0, 0)).withColumn("lang", __import__("pyspark.sql.functions", fromlist=["lit"]).lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in none} == {"und"}


def brute_language(train_rows, texts):
    """Word-first backoff written plainly, over dictionaries."""
    import regex

    letters, counts = regex.compile(r"\p{L}+"), {}
    for t, lang in train_rows:
        for w in letters.findall(t.lower()):
            counts.setdefault(lang, {})[w] = counts.setdefault(lang, {}).get(w, 0) + 1
    langs = sorted(counts)
    total = {x: sum(counts[x].values()) for x in langs}

    def table(by):
        out = {}
        for item in {i for x in langs for i in by[x]}:
            rates = [by[x].get(item, 0) / total[x] for x in langs]
            logs = [math.log(0.9 * r + 0.1 * sum(rates) / len(langs)) for r in rates]
            out[item] = [v - sum(logs) / len(langs) for v in logs]
        return out

    words, pieces = table(counts), {x: {} for x in langs}
    for x in langs:
        for w, n in counts[x].items():
            for k in range(1, language_id.LONGEST + 1):
                m = w if k == 1 else f"<{w}>"
                for i in range(len(m) - k + 1):
                    pieces[x][m[i : i + k]] = pieces[x].get(m[i : i + k], 0) + n
    grams, out = table(pieces), []
    for t in texts:
        found = letters.findall((t or "").lower())
        if not found:
            out.append(("und", 0.0))
            continue
        s = [0.0] * len(langs)
        for w in found:
            add = words.get(w)
            for k in range(language_id.LONGEST, 0, -1) if add is None else ():
                m = w if k == 1 else f"<{w}>"
                known = [grams[m[i : i + k]] for i in range(len(m) - k + 1) if m[i : i + k] in grams]
                if known:
                    add = [sum(c) / len(known) for c in zip(*known, strict=True)]
                    break
            s = [a + b for a, b in zip(s, add or [0.0] * len(langs), strict=True)]
        p = [math.exp((v - max(s)) / math.sqrt(len(found))) for v in s]
        out.append((langs[s.index(max(s))], max(p) / sum(p)))
    return out


def test_language_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    extra = ["½² Ⅷ ٣ 一", "½² Ⅷ", "zzzqq unseenword", "der die das 12 §", "x" * 700, None, "", "ÀÉ naïve"]
    docs = docs.unionByName(spark.createDataFrame([(10_000 + i, t, None, "s", 0) for i, t in enumerate(extra)], docs.schema))
    rows = docs.collect()
    held = {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in rows}
    want = brute_language([(r.text, r.lang) for r in rows if r.text is not None and r.lang is not None and not held[r.doc_id]], [r.text for r in rows])
    got = {r.doc_id: r for r in language_id.language_report(docs).collect()}
    for r, (lang, score) in zip(rows, want, strict=True):
        assert (got[r.doc_id].lang_pred, got[r.doc_id].score) == (lang, pytest.approx(score, abs=1e-6)), r.text


def test_rare_languages_are_learned(spark):
    rows = [(i, f"the cat number {i} sat on the mat", "en") for i in range(3000)] + [(9000 + i, "le chat est sur le tapis", "fr") for i in range(3)] + [(None, "the same dog", "en")] * 50
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = {r.lang: r["count"] for r in language_id.sampled(df, 200).groupBy("lang").count().collect()}
    assert found == {"en": 100, "fr": 3}
    assert language_id.train(df, 200).predict("le tapis")[0] == "fr"


def test_unseen_words_back_off(spark):
    rows = [(i, t, x) for i, (t, x) in enumerate([("singing ringing bringing", "en"), ("nation station ration", "fr")] * 5)]
    model = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.predict("zinging")[0] == "en" and model.predict("oration")[0] == "fr" and model.predict("жж")[1] <= 0.5


def test_quality_on_held_out_labels(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.fit(docs, labels.where("doc_id % 4 <> 1"))
    assert model.taught[1] > 0  # the text view taught the metadata view
    got = quality.score(docs, model).toPandas().merge(labels.where("doc_id % 4 = 1").toPandas(), on="doc_id")
    assert ((got.score >= 0.5) == (got.quality == 1)).mean() > 0.97


def test_quality_edges(spark):
    rows = [(1, "good text here", "s", "en", 3), (2, None, None, None, None), (3, "", "s", "", -5), (None, "|" * 90_000, "s", "en", 1), (1, "good text here", "s", "en", 3)]
    docs = spark.createDataFrame([(*r, 0.0) for r in rows], "doc_id long, text string, source string, lang string, n_chars long, score double")
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, None), (None, 0), (3, 0)], "doc_id long, quality int")
    assert len(quality.quality_scores(docs, labels).collect()) == 5
    assert {r.score for r in quality.quality_scores(docs, labels.where("false")).collect()} == {0.5}
    assert quality.quality_scores(docs.where("false"), labels).count() == 0


def test_quality_teaches_every_confident_document(spark):
    rng = random.Random(3)
    good = [" ".join(rng.choice(["river", "stone", "walked", "quietly", "morning", "light"]) + str(rng.randint(1, 99)) for _ in range(rng.randint(20, 40))) for _ in range(3000)]
    bad = ["|#" * rng.randint(20, 90) for _ in range(3000)]
    rows = [(i, t, f"s{i % 2}", "en", 100 + 400 * (i % 2)) for i, t in enumerate(t for pair in zip(good, bad, strict=True) for t in pair)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(400)], "doc_id long, quality int")
    few, many = quality.fit(docs.repartition(2), labels), quality.fit(docs.repartition(7), labels)
    pool = rows[400:]
    x = [quality.text_features(pa.array([r[1] for r in pool])), quality.meta_features(*[[r[k] for r in pool] for k in (2, 3, 4)])]
    assert few.taught == many.taught == [5600, 5600]  # both views are sure of every document
    for a, b in zip(few.scores(*x), many.scores(*x), strict=True):
        assert np.allclose(a, b, atol=1e-9) and ((a > 0.5) == np.array([r[0] % 2 == 0 for r in pool])).all()


def plain_co_training(x, y, pool, rounds):
    """Co-training with all rows in memory: labels are kept as lists, and each fit is a gradient search of its own."""
    apart = np.arange(len(y)) % 4 == 3
    labels, share = y[~apart], y.mean()
    odds = lambda z, w: np.array([sum(a * b for a, b in zip(row, w, strict=True)) for row in z])
    sigmoid = lambda o: 1 / (1 + np.exp(-np.clip(o, -30, 30)))
    z, zp = [], []
    for v in (0, 1):
        every = np.concatenate([x[v][~apart], pool[v]])
        mean, scale = every.mean(axis=0), np.maximum(every.std(axis=0), 1e-6)
        prepared = [np.column_stack([np.ones(len(p)), np.clip((p - mean) / scale, -8, 8)]) for p in (x[v][~apart], pool[v])]
        z.append(prepared[0])
        zp.append(prepared[1])

    def fit(a, t, weight):
        w = np.zeros(a.shape[1])
        for _ in range(200):
            p = sigmoid(a @ w)
            g = a.T @ (weight * (p - t)) + w
            h = (a * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ a + np.eye(len(w))
            d = np.linalg.solve(h, g)
            loss = lambda u: (weight * (np.logaddexp(0, a @ u) - t * (a @ u))).sum() + u @ u / 2  # noqa: E731, B023
            while loss(w - d) > loss(w) + 1e-9 * abs(loss(w)):
                d = d / 2
            w = w - d
            if np.abs(d).max() < 1e-9:
                break
        return w

    w = [fit(z[v], labels, np.ones(len(labels))) for v in (0, 1)]
    taught = [np.full(len(pool[0]), np.nan) for _ in (0, 1)]
    for _ in range(rounds):
        for v in (0, 1):
            p = sigmoid(odds(zp[1 - v], w[1 - v]))
            new = np.isnan(taught[v]) & (np.maximum(p, 1 - p) >= quality.CONFIDENT)
            taught[v][new] = p[new] > 0.5
        for v in (0, 1):
            some = ~np.isnan(taught[v])
            weight = np.zeros(len(pool[0]))
            for side, of_labels in ((0, 1 - share), (1, share)):
                mine = taught[v] == side
                weight[mine] = quality.TAUGHT_WEIGHT * min(1.0, len(labels) * of_labels / max(1, mine.sum()))
            w[v] = fit(np.concatenate([z[v], zp[v][some]]), np.concatenate([labels, taught[v][some]]), np.concatenate([np.ones(len(labels)), weight[some]]))
    return w, [int((~np.isnan(t)).sum()) for t in taught]


def test_co_training_equals_plain_co_training():
    rng = np.random.default_rng(2)
    truth = rng.integers(0, 2, 900).astype(float)
    x = [truth[:, None] * s + rng.normal(size=(900, k)) for s, k in ((1.2, 4), (1.0, 3))]
    lab, rest = slice(0, 120), slice(120, None)
    pool = [v[rest] for v in x]
    model = quality.co_train([v[lab] for v in x], truth[lab], lambda f: f(pool))
    w, taught = plain_co_training([v[lab] for v in x], truth[lab], pool, quality.ROUNDS)
    assert model.taught == taught and min(taught) > 100
    for view, want in zip(model.views, w, strict=True):
        assert np.allclose(view.w, want, atol=1e-3)


def test_quality_sample_is_bounded_and_null_ids_are_unlabelled(spark):
    rows = [(None if i % 3 == 0 else 1 if i % 3 == 1 else i, f"text number {i}", "s", "en", 20) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long")
    labels = spark.createDataFrame([(i, i % 2) for i in range(900)] + [(None, 1)] * 50, "doc_id long, quality int")
    seen = []
    kept = quality.co_train
    quality.co_train = lambda x, y, pool, **k: seen.append(len(y)) or kept(x, y, pool, **k)
    try:
        quality.fit(docs, labels, max_labelled=100)
    finally:
        quality.co_train = kept
    assert 0 < seen[0] <= 100
    assert quality.quality_scores(docs, labels).count() == 900
