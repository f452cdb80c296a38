"""Operators on documents against brute force, with nulls, empty and long texts, ties, repeats, empty tables and extra columns."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import decontaminate, langid, licenses, lm, mixing, quality, simhash, tokens
from tessera.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, keep int"


def corpus(spark, rows):
    return spark.createDataFrame([(i, t, lang, src, None if t is None else len(t), "extra", 1) for i, t, lang, src in rows], SCHEMA)


def texts(n=60, seed=1):
    rng = random.Random(seed)
    words = ["Alpha", "beta", "gamma,", "Delta.", "é", "naïve", "x1", "!!", "it's", "zeta"] + [f"w{i}" for i in range(40)]
    out = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 60))) for _ in range(n)]
    return [*out, None, "", "  \n\t", out[0], out[0], "word " * 6000, "日本 語", "a<|endoftext|>b", "one"]


@pytest.fixture(scope="module")
def docs(spark):
    return corpus(spark, [(i if i != 5 else None, t, ["en", "de", None][i % 3], f"s{i % 4}" if i % 7 else None) for i, t in enumerate(texts())])


@pytest.fixture(scope="module")
def empty(spark):
    return corpus(spark, [])


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


# 1 -------------------------------------------------------------------------------------------------------------------


def junk(rng):
    return " ".join("".join(rng.choice("abcdefg") for _ in range(5)) + rng.choice(["###", "$$$", "%%%"]) for _ in range(40))


def clean(rng):
    return " ".join("".join(rng.choice("abcdefg") for _ in range(rng.randrange(2, 9))) for _ in range(40)) + "."


def test_quality_tells_junk(spark):
    rng = random.Random(2)
    rows = [(i, junk(rng) if i % 5 == 0 else clean(rng), "en", f"s{i % 3}") for i in range(400)]
    labels = spark.createDataFrame([(i, 0 if i % 5 == 0 else 1) for i in range(200)] + [(300, 0), (300, 1), (None, 1)], "doc_id long, quality int")
    frame = corpus(spark, rows)
    model = quality.fit_quality(frame, labels)
    got = {r["doc_id"]: r["keep"] for r in quality.score_quality(frame, model).collect()}
    assert sum(got[i] == (i % 5 != 0) for i in range(200, 400)) >= 196
    kept = quality.keep_quality(frame, model)
    assert kept.schema == frame.schema and {r["doc_id"] for r in kept.collect()} == {i for i, k in got.items() if k}


def test_quality_without_labels_keeps_all(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = quality.fit_quality(docs, none)
    assert model is None and quality.keep_quality(docs, model).count() == docs.count()
    assert {r["score"] for r in quality.score_quality(docs, model).collect()} == {1.0}
    assert quality.score_quality(empty, quality.fit_quality(empty, none)).count() == 0


# 4 -------------------------------------------------------------------------------------------------------------------


def test_tokens_round_trip(spark, docs, empty):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    rows = sorted(((r["doc_id"], r["h"], r["text"]) for r in docs.withColumn("h", F.xxhash64("text")).collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want, at = [], 0
    for key, _, text in rows:
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 2]
        want.append((key, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    shards = tokens.write_shards(docs, tokenizer_path(), shard_ids=500)
    got = tokens.read_documents(shards)
    assert sorted(map(tuple, got.collect()), key=lambda r: r[1]) == want
    assert tokens.read_documents(tokens.write_shards(empty, tokenizer_path())).count() == 0
    for row in shards.collect():
        shard = tokens.Shard(row["payload"])
        whole = shard.all()
        for i in range(len(shard)):
            own = whole[int(shard.before[i]) : int(shard.before[i + 1])]
            assert (shard.decode(i) == own).all()
            assert (shard.slice(i, len(own) // 3, 2 * len(own) // 3) == own[len(own) // 3 : 2 * len(own) // 3]).all()


@pytest.mark.parametrize("seed", range(4))
def test_grammar(seed):
    rng = np.random.default_rng(seed)
    ids = rng.integers(0, 6, 3000).astype(np.uint32)
    ids[1000:2000] = 3
    ends = np.unique(np.append(rng.integers(1, 3000, 40), 3000))
    raw = tokens.compress(ids, ends, least=4)
    shard = tokens.Shard(raw)
    assert (shard.all() == ids).all() and len(shard.symbols) < len(ids) // 2 and len(shard.rules) == len(shard.lengths)
    # rounds go on until no pair is frequent within a document (runs of one symbol: every second)
    left = collections.Counter()
    for i in range(len(shard)):
        own, last = shard.symbols[int(shard.begins[i]) : int(shard.begins[i + 1])].tolist(), None
        for pair in zip(own, own[1:], strict=False):
            last = None if pair == last and pair[0] == pair[1] else pair
            left[pair] += last is not None
    assert max(left.values()) < 8


def test_grammar_folds_periods_and_many_rules():
    ids = np.tile(np.array([5, 9, 7], np.uint32), 20_000)
    shard = tokens.Shard(tokens.compress(ids, np.array([len(ids)])))
    assert len(shard.symbols) < 60 and (shard.all() == ids).all()
    ids = np.repeat(np.random.default_rng(5).integers(0, 49_000, (20_000, 2)), 16, axis=0).astype(np.uint32).ravel()
    shard = tokens.Shard(tokens.compress(ids, np.array([len(ids)])))  # over 2^16 symbols: three bytes each
    assert shard.base + len(shard.rules) > 1 << 16 and (shard.all() == ids).all()


def test_pieces_of_one_hash_keep_their_ids(spark):
    a = "a"
    for _ in range(11):
        a += a.translate(str.maketrans("ab", "ba"))
    b = a.translate(str.maketrans("ab", "ba"))  # collides with a for every odd base modulo 2^64
    e = tokens.WordEncoder(tokenizer_path())
    want = [x.ids for x in e.tokenizer.encode_batch([f"{a} x", f"{b} y", "plain"], add_special_tokens=False)]
    assert e.by_piece and [x.tolist() for x in e.encode([f"{a} x", f"{b} y", "plain"])] == want
    assert e.by_pieces([b])[0] is None and e.by_pieces([a])[0] is not None


def test_encode_calls_are_bounded():
    import pyarrow as pa

    texts = ["abc", None, "d" * 50, "", "e", "f" * 9]
    runs = list(tokens.bounded(pa.array(texts), 10))
    assert [t for _, run in runs for t in run] == [t or "" for t in texts] and all(len(run) == 1 or sum(map(len, run)) <= 10 for _, run in runs)
    assert [at for at, _ in runs] == np.cumsum([0, *(len(run) for _, run in runs)])[:-1].tolist()


# 5 -------------------------------------------------------------------------------------------------------------------


def test_language(spark, empty):
    rng = random.Random(4)
    say = {"en": "the and ing thou tion ere".split(), "de": "der die und schen ß ung".split(), "fr": "le la é ment eux qu".split()}
    rows = [(i, "".join(rng.choice(say[k]) + rng.choice(["", " "]) for _ in range(60)), k, "s") for i in range(300) for k in [["en", "de", "fr"][i % 3]]]
    rows += [(900, None, "en", "s"), (901, "123 !!", "en", "s"), (902, "der die und schen", None, "s"), (903, "\u00bd \u00b2 \u2460 \u2167 _", "en", "s"), (904, "", "de", "s"), (905, "der schen und " * 40_000, None, "s")]
    frame = corpus(spark, rows)
    model = langid.fit_langid(frame, F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict_langid(frame, model).collect()}
    held = [r for r in rows[:300] if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert sum(got[r[0]][0] == r[2] for r in held) >= 0.97 * len(held)
    assert got[900] == ("und", 0.0) and got[901] == got[903] == got[904] == ("und", 0.0) and got[902][0] == got[905][0] == "de" and all(0 <= s <= 1 for _, s in got.values())
    assert (model.weights == 0).mean() > 0.3
    # rows without ids, or of one id, are drawn within the bound
    for key in (None, 7):
        few = langid.fit_langid(corpus(spark, [(key, t, k, "s") for _, t, k, _ in rows[:300]]), F.lit(True), max_rows=90)
        assert few.langs == ["de", "en", "fr"]
    one = langid.fit_langid(corpus(spark, rows[:300:3]), F.lit(True))
    assert {tuple(r) for r in langid.predict_langid(frame.where("doc_id < 9"), one).select("lang_pred", "score").collect()} == {("en", 1.0)}
    assert langid.fit_langid(empty, F.lit(True)) is None and langid.predict_langid(frame, None).where("lang_pred <> 'und'").count() == 0


# 6 -------------------------------------------------------------------------------------------------------------------


def is_leak(item, passage):
    """By the rule alone: shingles of the whole item, or of both its parts."""
    w, p = re.findall(r"\w+", item.lower()), re.findall(r"\w+", passage.lower())
    asked = len(re.findall(r"\w+", item[: item.rfind("?") + 1]))
    at = asked if 0 < asked < len(w) else max(1, len(w) * 2 // 3)

    def held(part):
        n = min(5, len(part))
        wanted = {tuple(part[i : i + n]) for i in range(len(part) - n + 1)}
        return sum(x in {tuple(p[i : i + n]) for i in range(len(p) - n + 1)} for x in wanted) / max(1, len(wanted))

    return held(w) >= 0.8 or at >= 5 and at < len(w) and min(held(w[:at]), held(w[at:])) >= 0.8


def windows(text, item):
    width = decontaminate.width_of(len(re.findall(r"\w+", item)))
    w = re.findall(r"\w+", text.lower())
    return [" ".join(w[s : s + 2 * width]) for s in range(0, max(1, len(w) - width), width)]


def test_leaks_against_all_pairs(spark, empty):
    rng = random.Random(5)
    vocabulary = ["the", "of", "and", "is"] * 20 + [f"v{i}" for i in range(300)]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, say(rng.randrange(4, 160)) + ("?" if i % 2 else "") + " " + say(6)) for i in range(30)]
    items += [(90, "Where is Zorbgrad? In Blefuscu."), (91, None), (92, " ?! "), (0, items_0 := say(30)), (None, say(12)), (93, items_0)]
    rows = []
    for i in range(120):
        text = say(rng.randrange(0, 400))
        if i % 4 == 0:
            cut = rng.randrange(len(text) + 1)
            text = text[:cut] + "\n" + items[i % 30][1].upper() + "\n" + text[cut:]
        rows.append((i, text, "en", "s"))
    rows += [(500, None, None, None), (501, "", None, None), (502, items_0, None, None), (502, items_0, None, None), (503, items[3][1][: len(items[3][1]) // 2], None, None)]
    rows += [(504, say(40) + " where is zorbgrad in BLEFUSCU " + say(9), None, None), (505, "where is Zorbgrad? We don't know.", None, None), (506, say(6_000) + " " + items[7][1] + " " + say(200), None, None), (None, items[34][1], None, None)]
    frame, bench = corpus(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    want = {(i, -1 if j is None else j) for i, t, _, _ in rows for j, x in items if x and re.search(r"\w", x) and any(is_leak(x, p) for p in windows(t or "", x))}
    found = decontaminate.find_leaks(frame.withColumn("item_id", F.lit("clash")), bench.withColumn("doc_id", F.lit(1))).collect()
    got = [(r["doc_id"], r["item_id"]) for r in found]
    assert set(got) == want and got.count((502, 0)) == 2 and (504, 90) in want and (506, 7) in want and (None, -1) in want and (505, 90) not in want
    # an index in shards finds the same, with the same scores; two texts of one id in one document are two rows of it
    key = lambda rows: sorted(map(str, map(tuple, rows)))
    assert key(decontaminate.find_leaks(frame, bench, max_items=7).collect()) == key(found)
    kept = decontaminate.drop_leaks(frame, bench)
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted((r[0] for r in rows if r[0] not in {i for i, _ in want}), key=str) and kept.schema == frame.schema
    assert decontaminate.drop_leaks(frame, bench, max_items=7).count() == kept.count()
    assert decontaminate.find_leaks(frame, bench.limit(0)).count() == 0 and decontaminate.find_leaks(empty, bench).count() == 0


@pytest.mark.parametrize("block", [1, 4, 64])
def test_search_retrieves_all_above_threshold(block):
    rng = random.Random(6)
    say = lambda n: [f"v{int(rng.paretovariate(0.6)) % 200}" for _ in range(n)]
    index = decontaminate.Index([(i, " ".join(say(rng.randrange(1, 70)))) for i in range(60)], share=0.5, block=block)
    passages = [say(rng.randrange(1, 900)) for _ in range(40)] + [[]]
    got = sorted((t, a, item.key, round(score, 6)) for t, a, _, item, score in index.retrieve(passages))
    want = []
    for c in index.classes:
        for t, p in enumerate(passages):
            for at in range(0, max(1, len(p) - c.width), c.width) if p else ():
                seen = set(p[at : at + 2 * c.width])
                for item in c.items:
                    score = sum(g for w, g in item.gain.items() if w in seen)
                    if score >= item.need - 1e-9:
                        want.append((t, at, item.key, round(score, 6)))
    assert got == sorted(want) and len(index.classes) == 3 and want


def test_search_skips_blocks():
    """A passage that shares nothing but one item's words is scored in that item's block alone."""
    items = [(i, " ".join(f"w{i}x{k}" for k in range(10 + i % 3))) for i in range(64)]
    index = decontaminate.Index(items, block=4)
    (only,) = index.classes
    blocks, scored = [], only._scored
    only._scored = lambda own, term, pivot, n: blocks.append(set(pivot[own].tolist())) or scored(own, term, pivot, n)
    text = items[17][1].split()
    assert [item.key for *_, item, _ in index.retrieve([text])] == [17]
    assert blocks == [{next(k for k, i in enumerate(only.items) if i.key == 17) // 4}]


def test_edited_copies_are_leaks():
    rng = random.Random(12)
    say = lambda n: [f"v{int(rng.paretovariate(0.6)) % 3000}" for _ in range(n)]
    items = [(i, " ".join(say(rng.randrange(3, 60)))) for i in range(60)]
    index = decontaminate.Index(items)
    copies, want = [], []
    for _, text in items * 10:
        w = text.split()
        if rng.random() < 0.3 and len(w) > 4:  # the words of one end are left out
            cut = rng.randrange(1, 1 + len(w) // 4)
            w = w[cut:] if rng.random() < 0.5 else w[:-cut]
        else:
            for _ in range(rng.randrange(0, 3)):
                w[rng.randrange(len(w))] = "changed"
        page = ["x"] * rng.randrange(90) + w + ["x"] * rng.randrange(90)
        copies.append(" ".join(page))
        want.append(any(is_leak(text, p) for p in windows(copies[-1], text)))
    got = [i in [leak[0] for leak in leaks] for (i, _), leaks in zip(items * 10, index.leaks(copies), strict=True)]
    assert got == want and 100 < sum(want) < 550


# 7 -------------------------------------------------------------------------------------------------------------------


def naive_print(text, n=3):
    w = [x.encode() for x in words(text)]
    grams = [b" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(n, links):
    label = list(range(n))
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(label[a], label[b])
            changed |= label[a] != m or label[b] != m
            label[a] = label[b] = m
    return label


def test_fingerprints_against_all_pairs(spark, docs, empty):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    fps = [naive_print(t) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2]
    label = classes(len(rows), links)
    least = {c: min((rows[i][0] for i in range(len(rows)) if label[i] == c and rows[i][0] is not None), default=None) for c in label}
    want = sorted(((rows[i][0], fps[i], least[label[i]]) for i in range(len(rows))), key=str)
    got = simhash.fingerprint_groups(docs)
    assert sorted(((r["doc_id"], r["fp"] & (1 << 64) - 1, r["component_id"]) for r in got.collect()), key=str) == want
    assert simhash.fingerprint_groups(empty).count() == 0


@pytest.mark.parametrize("full", [4, 2048])
def test_links_of_crowded_fingerprints(spark, full):
    rng = random.Random(7)
    base = [rng.getrandbits(64) for _ in range(6)]
    fps = list({b ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(4))) & (1 << 64) - 1 for b in base for _ in range(60)})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    nodes = spark.createDataFrame([(f,) for f in signed], "fp long")
    edges = [(r["a"], r["b"]) for r in simhash.fingerprint_edges(nodes, 2, 4, full).collect()]
    at = {f: i for i, f in enumerate(signed)}
    links = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2]
    assert all((fps[at[a]] ^ fps[at[b]]).bit_count() <= 2 for a, b in edges)
    assert classes(len(fps), [(at[a], at[b]) for a, b in edges]) == classes(len(fps), links)


@pytest.mark.parametrize("radius", [0, 1, 2, 5, 20])
def test_bit_sliced_distances(radius):
    rng = np.random.default_rng(radius)
    fps = rng.integers(0, 1 << 63, 150, dtype=np.uint64)
    fps[50:100] = fps[:50] ^ (np.uint64(1) << rng.integers(0, 64, 50).astype(np.uint64))
    near = simhash.within_radius(fps, simhash.planes_of(fps), radius)
    got = np.unpackbits(near.view(np.uint8), axis=1, bitorder="little")[:, :150].astype(bool)
    assert (got == (np.bitwise_count(fps[:, None] ^ fps[None]) <= radius)).all()


def test_similar_texts(spark, empty):
    rng = random.Random(8)
    say = lambda n: [f"v{rng.randrange(5000)}" for _ in range(n)]
    rows, group = [], []
    for g in range(25):
        base = say(rng.randrange(60, 300))
        for _ in range(4):
            w = list(base)
            w[rng.randrange(len(w))] = "changed"
            rows.append((len(rows), " ".join(w), "en", "s"))
            group.append(g)
    rows += [(200, None, "en", "s"), (201, "", "en", "s"), (202, rows[0][1], "en", "s"), (202, rows[0][1], "en", "s"), (None, rows[4][1], "en", "s")]
    sets = [{tuple(words(t)[i : i + 5]) for i in range(max(1, len(words(t)) - 4))} for _, t, _, _ in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    label = classes(len(rows), links)
    least = {c: min(rows[i][0] for i in range(len(rows)) if label[i] == c and rows[i][0] is not None) for c in label}
    frame = corpus(spark, rows)
    found = simhash.similar_groups(frame)
    assert sorted(((r["doc_id"], r["component_id"]) for r in found.collect()), key=str) == sorted(((rows[i][0], least[label[i]]) for i in range(len(rows))), key=str)
    kept = sorted((r["doc_id"] for r in simhash.keep_representatives(frame, found).collect()), key=str)
    assert kept == sorted([*set(least.values()), None], key=str)
    assert simhash.similar_groups(empty).count() == 0


def template_corpus(pages, seed):
    """Pages of one template: look-alikes at 0.7 to 0.79, and planted pairs just above 0.8 among them."""
    rng = random.Random(seed)
    shared = [f"t{i}" for i in range(176)]
    say = lambda n: [f"u{rng.randrange(10**9)}" for _ in range(n)]
    out = []
    for i in range(pages):
        own = say(28)
        out.append(shared + own)
        if i % 4 == 0:
            out.append(shared + own[:9] + say(19))
    rng.shuffle(out)
    return [" ".join(w) for w in out]


def links_of_bands(rows):
    """Links by brute force: a similarity of 0.8 or more, and a band in common."""
    sets = [{tuple(words(t)[i : i + 5]) for i in range(len(words(t)) - 4)} for t in rows]
    bands = [set(simhash.band_keys(simhash.shingle_hashes(simhash.words_of(t), 5)).tolist()) for t in rows]
    near = [(len(sets[i] & sets[j]) / len(sets[i] | sets[j]), i, j) for i in range(len(rows)) for j in range(i) if bands[i] & bands[j]]
    assert sum(0.7 <= s < 0.8 for s, _, _ in near) > 20 * sum(s >= 0.8 for s, _, _ in near) > 0
    return [(i, j) for s, i, j in near if s >= 0.8]


@pytest.mark.parametrize("tile", [512, 16])
def test_template_with_look_alikes(spark, tile):
    rows = template_corpus(120, 10)
    frame = corpus(spark, [(i, t, "en", "s") for i, t in enumerate(rows)])
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(frame, tile=tile).collect()}
    assert [got[i] for i in range(len(rows))] == classes(len(rows), links_of_bands(rows))


def test_class_that_hangs_by_a_text_without_doc_id(spark):
    middle = [f"m{i}" for i in range(200)]
    first, last = [f"a{i}" for i in range(12)] + middle[12:], middle[:-12] + [f"b{i}" for i in range(12)]
    frame = corpus(spark, [(1, " ".join(first), "en", "s"), (None, " ".join(middle), "en", "s"), (2, " ".join(last), "en", "s"), (3, "alone", "en", "s"), (None, "too", "en", "s")])
    got = sorted(((r["doc_id"], r["component_id"]) for r in simhash.similar_groups(frame).collect()), key=str)
    assert got == [(1, 1), (2, 1), (3, 3), (None, 1), (None, None)]


def test_pairs_that_meet_in_a_later_band_alone(spark):
    """Of lone pairs of similarity 0.81 one in fourteen shares none of the first bands: no pair is left out."""
    rng = random.Random(12)
    rows = []
    for p in range(300):
        words_ = [f"p{p}w{rng.randrange(10**6)}" for _ in range(200)]
        rows += [" ".join(words_), " ".join(words_[:-20] + [f"q{p}w{i}" for i in range(20)])]
    keys = [set(simhash.band_keys(simhash.shingle_hashes(simhash.words_of(t), 5))[: simhash.FIRST].tolist()) for t in rows]
    assert sum(not keys[2 * p] & keys[2 * p + 1] for p in range(300)) > 5
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(corpus(spark, [(i, t, "en", "s") for i, t in enumerate(rows)])).collect()}
    assert [got[i] for i in range(600)] == [i - i % 2 for i in range(600)]


@pytest.mark.parametrize("cut", [False, True])
def test_forest_of_sets(cut):
    rng = np.random.default_rng(11)
    base = rng.integers(0, 1 << 32, 150, dtype=np.uint32)
    sets = [np.unique(np.concatenate([base[: rng.integers(100, 150)], rng.integers(0, 1 << 32, rng.integers(0, 40), dtype=np.uint32)])) for _ in range(70)]
    sets.append(np.zeros(0, np.uint32))
    parts = np.arange(71) % 2 if cut else None
    labels = np.arange(71)
    labels[10:14] = 10
    edges = simhash.similar_forest(sets, labels, parts, 0.8)
    like = lambda i, j: len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j]))
    links = [(i, j) for i in range(71) for j in range(i) if like(i, j) and (not cut or (i - j) % 2)]
    known = [(10, i) for i in range(11, 14)]
    assert all(like(i, j) for i, j in edges) and len(edges) < 71
    assert classes(71, known + edges) == classes(71, known + links)


# 8 -------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("chunk", [50, 1_000_000])
def test_language_model(spark, docs, empty, chunk):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    held = [zlib.crc32(str("" if i is None else i).encode()) % 5 == 1 for i, _ in rows]
    said = [[*words(t), None] for _, t in rows]
    counts = collections.Counter(w for s, h in zip(said, held, strict=True) if not h for w in s)
    n, v = sum(counts.values()), len(counts)
    frame = lm.score_texts(docs, F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 1, chunk_tokens=chunk, range_entries=40)
    got = sorted(frame.collect(), key=lambda r: (str(r["doc_id"]), r["n_tokens"]))
    want = sorted(((i, h, len(s), sum(counts[w] > 0 for w in s), n, sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in s)) for (i, _), h, s in zip(rows, held, said, strict=True)), key=lambda r: (str(r[0]), r[2]))
    assert [tuple(r)[:5] for r in got] == [w[:5] for w in want]
    assert [r["base_score"] for r in got] == pytest.approx([w[5] for w in want])
    # the mixture by brute force: counts without the tuning texts, the same cells, and every token's three estimates
    marks = docs.select("doc_id", "text", (F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1000)) < 100).alias("tune")).collect()
    tunes = [r["tune"] and not h for r, h in zip(marks, held, strict=True)]

    def table(chosen):
        one, two = collections.Counter(), collections.Counter()
        for s, c in zip(said, chosen, strict=True):
            if c:
                one.update(["<begin>", *s])
                two.update(zip(["<begin>", *s], s, strict=False))
        return one, two, sum(k for w, k in one.items() if w != "<begin>"), len(one) - ("<begin>" in one)

    def estimate(s, one, two, n):
        for a, b in zip(["<begin>", *s], s, strict=False):
            yield (0 if not one[a] else math.ceil(math.log2(one[a] + 1))), (two[a, b] / one[a] if one[a] else 0.0), one[b] / max(1, n)

    one, two, n_kept, v_kept = table([not h and not t for h, t in zip(held, tunes, strict=True)])
    cells = collections.Counter()
    for s, t in zip(said, tunes, strict=True):
        if t:
            cells.update((b, *(round(-math.log2(p) * 8) if p else -1 for p in (x, y))) for b, x, y in estimate(s, one, two, n_kept))
    weights = lm.learn([(*k, c) for k, c in cells.items()], v_kept, 8).weights
    one, two, n_all, v_all = table([not h for h in held])
    full = {(str(i), len(s)): sum(math.log10(weights[b] @ [x, y, 1 / (v_all + 1)]) for b, x, y in estimate(s, one, two, n_all)) for (i, _), s in zip(rows, said, strict=True)}
    assert any(tunes) and [r["score"] for r in got] == pytest.approx([full[str(r["doc_id"]), r["n_tokens"]] for r in got])
    assert lm.score_texts(empty, F.lit(False)).count() == 0
    assert {r["train_tokens"] for r in lm.score_texts(docs, F.lit(True)).collect()} == {0}


def test_mixture_sums_to_one_and_learns():
    cells = [(3, 8, 64, 90), (3, -1, 32, 10), (0, -1, 16, 5)]
    w = lm.learn(cells, 100, 8).weights
    assert np.allclose(w.sum(axis=1), 1) and w[3, 0] > 0.8 and w[0, 0] == 0 and (w[:, 2] > 0).all()


# 9 -------------------------------------------------------------------------------------------------------------------


def test_mixing(spark, docs, empty):
    rng = random.Random(9)
    rows = [(i, "w " * rng.randrange(1, 40), "en", "big" if i % 3 else f"s{i % 5}" if i % 4 else None) for i in range(900)]
    frame = corpus(spark, rows)
    tokens_of = {i: len(t.split()) for i, t, _, _ in rows}
    total = collections.Counter()
    for i, _, _, s in rows:
        total[s] += tokens_of[i]
    got = mixing.mix(frame, max_repeats=2.0).collect()
    taken, times = collections.Counter(), collections.Counter()
    for r in got:
        taken[r["source"]] += tokens_of[r["doc_id"]]
        times[r["doc_id"], r["mix_epoch"]] += 1
    assert set(times.values()) == {1} and {d for d, _ in times} == set(tokens_of)
    plan = {r["source"]: r for r in mixing.mixing_plan(frame.groupBy("source").agg(F.sum(mixing.tokens_in(F.col("text"))).alias("tokens")), 2.0, None, None).collect()}
    assert sum(p["weight"] for p in plan.values()) == pytest.approx(1) and max(p["target"] / p["tokens"] for p in plan.values()) == pytest.approx(2, rel=1e-6)
    for s, p in plan.items():
        assert p["target"] - 40 <= taken[s] <= p["target"] + 1e-6, s
    some = mixing.mix(frame, max_repeats=None, entropy_share=0.95, budget=3000).collect()
    assert 3000 - 40 * len(total) <= sum(tokens_of[r["doc_id"]] for r in some) <= 3000
    weights = collections.Counter()
    for r in some:
        weights[r["source"]] += tokens_of[r["doc_id"]] / 3000
    assert -sum(w * math.log(w) for w in weights.values()) >= 0.93 * math.log(len(total))
    # the exponent and the documents by brute force
    live = {s: t for s, t in total.items() if t}
    lo, hi = 0.0, 1.0
    for _ in range(60):
        mid = (lo + hi) / 2
        ratios = [t ** (mid - 1) for t in live.values()]
        lo, hi = (lo, mid) if max(ratios) / min(ratios) <= 2 else (mid, hi)
    assert next(iter(plan.values()))["alpha"] == pytest.approx(hi, abs=1e-9)
    order = {r["doc_id"]: r["o"] for r in frame.select("doc_id", F.xxhash64(F.lit(3), F.col("doc_id").cast("string"), F.col("text")).alias("o")).collect()}
    for s, p in plan.items():
        passes = math.floor(p["target"] / p["tokens"] + 1e-9)
        own = sorted((order[i] & (1 << 64) - 1) >> 54 << 64 | order[i] + (1 << 63) for i, _, _, x in rows if x == s)
        back = {(order[i] & (1 << 64) - 1) >> 54 << 64 | order[i] + (1 << 63): i for i, _, _, x in rows if x == s}
        rest, more = p["target"] - passes * p["tokens"], set()
        for key in own:
            rest -= tokens_of[back[key]]
            if rest < -1e-6:
                break
            more.add(back[key])
        for i in back.values():
            assert sum(times.get((i, e), 0) for e in range(9)) == max(1, passes + (i in more)), (s, i)
    entropy = mixing.exponent(frame.groupBy("source").agg(F.sum(mixing.tokens_in(F.col("text"))).alias("tokens")), None, 0.95)
    measure = lambda a: -sum(w * math.log(w) for w in (t**a / sum(x**a for x in live.values()) for t in live.values()))
    assert measure(entropy) == pytest.approx(0.95 * math.log(len(live)), abs=1e-6)
    clash = mixing.mix(frame.withColumn("mix_epoch", F.lit("mine")).withColumn("o", F.lit(1)).withColumn("d", F.lit(2)))
    assert clash.columns[-5:] == ["o", "d", "mix_epoch_", "mix_block", "mix_order"] and clash.where("mix_epoch <> 'mine'").count() == 0 and clash.count() == len(got)
    assert mixing.mix(empty).count() == 0
    assert mixing.mix(docs).select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


# 10 ------------------------------------------------------------------------------------------------------------------


def test_licenses_against_all_windows(spark, docs, empty):
    rng = random.Random(10)
    say = lambda n: [f"v{rng.randrange(50)}" for _ in range(n)]
    rows = []
    for i, (_, template) in enumerate(licenses.TEMPLATES * 4):
        w = template.split()
        if i % 3 == 1 and len(w) > 12:
            w[len(w) // 2] = "changed" if i % 2 else w[len(w) // 2]
        if i % 3 == 2:
            w = w[: len(w) // 2]
        rows.append((i, " ".join([*say(rng.randrange(0, 90)), *w, *say(rng.randrange(0, 90))]), "en", "s"))
    rows += [(900, None, None, None), (901, "Licensed", None, None), (None, licenses.TEMPLATES[1][1], None, None), (0, rows[0][1], None, None)]
    cut = lambda t: re.findall(r"[^\W_]+", t.lower())
    grams = lambda w, n=5: {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))}
    templates, want = [*licenses.TEMPLATES, ("short", "BSD, 2-Clause!")], {}
    rows += [(950 + i, " ".join([*say(i), "bsd", "2", "clause", *say(9 - i)]), "en", "s") for i in range(10)]
    for i, text, _, _ in rows:
        for name, template in templates:
            n = min(5, len(cut(template)))
            w, t = cut(text or ""), grams(cut(template), n)
            level = len(cut(template))
            best = max((len(grams(w[s : s + 2 * level], n) & t) / len(t) for s in range(0, max(1, len(w) - level), level)), default=0) if w else 0
            if best >= 0.8:
                want[i, name] = max(best, want.get((i, name), 0))
    got = {(r["doc_id"], r["template"]): r["containment"] for r in licenses.scan_licenses(corpus(spark, rows).withColumn("template", F.lit("clash")).withColumn("containment", F.lit(2)), templates).collect()}
    assert got == pytest.approx(want) and len(want) > 30
    assert licenses.scan_licenses(empty).count() == 0 and licenses.scan_licenses(docs, []).count() == 0


def test_every_short_notice_is_found(spark):
    rng = random.Random(11)
    say = lambda n: [f"v{rng.randrange(5000)}" for _ in range(n)]
    short = [t for t in licenses.TEMPLATES if len(t[1].split()) < 10]
    rows = [(i, " ".join([*say(rng.randrange(0, 40)), short[i % len(short)][1], *say(rng.randrange(0, 40))]), "en", "s") for i in range(2000 * len(short))]
    got = {(r["doc_id"], r["template"]) for r in licenses.scan_licenses(corpus(spark, rows)).collect()}
    assert not {(i, short[i % len(short)][0]) for i, *_ in rows} - got


def test_bands_keep_the_bound():
    for n in range(1, 60):
        size, bands = licenses.shape(n, 0.8)
        shingle_count = n - size + 1
        k = math.ceil(0.8 * shingle_count - 1e-9)
        assert (1 - k / (2 * n - size + 1 + shingle_count - k)) ** bands <= 1.0001e-9
