"""The training-data operators: odd inputs, brute force, exact round trips, held-out accuracy."""

import collections
import hashlib
import math
import random
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from diffspark.llm import langid, quality, toxicity
from diffspark.llm.components import components
from diffspark.llm.imatch import imatch, with_next
from diffspark.llm.line_dedup import line_dedup
from diffspark.llm.minhash import near_duplicates, prefix_sides
from diffspark.llm.mixing import mix, source_targets
from diffspark.llm.packing import Encoder, best_fill, pack, plan_windows
from diffspark.llm.suffix_dedup import _runs as suffix_runs
from diffspark.llm.suffix_dedup import common_prefixes, later, previous_factors, suffix_dedup, suffix_repeats, text_runs
from diffspark.llm.suffix_tree import suffix_tree_scores
from diffspark.llm.word_tree import Root, expand_small, squeeze, squeeze_small, token_shares

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, size string, _row int"


def docs(spark, texts, sources=None):
    data = [(i, t, "en", sources[k] if sources else "s", 0, 0.5, "x", 1) for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(data, SCHEMA)


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "One two"), (4, "One two"), (None, "null id"), (5, "é" * 300), (6, "a b c d e f g " * 3000), (7, "\x00 \x1c odd \x85 bytes"), (-8, "same text here"), (9, "same text here")]


def table(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


@pytest.fixture(scope="module")
def odd(spark):
    return docs(spark, ODD)


def brute_lines(texts, least):
    key = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    seen = collections.defaultdict(set)
    for i, t in texts:
        for line in (t or "").split("\n"):
            if key(line):
                seen[key(line)].add((i, t))
    return [(i, "\n".join(x for x in (t or "").split("\n") if len(seen[key(x)]) < least)) for i, t in texts]


def test_line_dedup(spark, odd):
    rng = random.Random(2)
    texts = [(i, "\n".join(rng.choice(["A b", " a B ", "", "x", f"own {i}", "é"]) for _ in range(rng.randrange(8)))) for i in range(60)] + ODD
    got = sorted((str(r["doc_id"]), r["text"]) for r in line_dedup(docs(spark, texts), min_docs=10).collect())
    assert got == sorted((str(i), t) for i, t in brute_lines(texts, 10))
    out = line_dedup(odd.withColumn("n_lines", F.lit("clash")), min_docs=2)
    assert out.count() == len(ODD) and dict(out.dtypes)["n_lines"] == "bigint"
    assert line_dedup(odd.limit(0)).isEmpty()


def test_mixing_meets_targets(spark):
    rng = random.Random(4)
    texts = [(i, words(rng, rng.randint(1, 40))) for i in range(900)]
    sources = [rng.choice(["a", "a", "a", "a", "b", "c", None]) for _ in texts]
    out = mix(docs(spark, texts, sources)).collect()
    assert len(out) == 900 and all(r["taken"] <= 3 * r["size"] for r in out)
    per = collections.defaultdict(lambda: [0, 0.0, 0])
    for r in out:
        per[r["source"]][0] += r["taken"]
        per[r["source"]][1], per[r["source"]][2] = r["target"], r["source_size"]
    assert sum(v[1] for v in per.values()) == pytest.approx(sum(v[2] for v in per.values()))
    for taken, target, size in per.values():
        assert abs(taken - target) <= 40 and target <= 3 * size + 1e-6
    again = mix(docs(spark, texts, sources).repartition(7))
    assert {r["doc_id"]: r["taken"] for r in again.collect()} == {r["doc_id"]: r["taken"] for r in out}


def test_mixing_odd(spark, odd):
    assert mix(odd).count() == len(ODD)
    assert mix(odd.limit(0)).isEmpty()
    assert {r["taken"] for r in mix(odd.where("doc_id in (1, 2)")).collect()} == {0}


def test_water_level(spark):
    sizes = spark.createDataFrame([("a", 100), ("b", 1), ("c", 1)], "source string, size long")
    got = {r["source"]: r["target"] for r in source_targets(sizes).collect()}
    assert got == pytest.approx({"a": 96.0, "b": 3.0, "c": 3.0})


def test_encoder_is_the_tokenizer():
    plain, fast = Tokenizer.from_file(PATH), Encoder(PATH, True)
    rng = random.Random(1)
    alphabet = "aàéßIi'stredmvl12½²!?.,<|>-_ \t\n\x0b\x1c\x85\xa0\xadΣςİ中́"
    texts = ["<|endoftext|> x<|startoftext|>", "I'm it's'S DON'T"] + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(800)]
    texts += ["".join(chr(rng.choice([*range(32, 127), *range(0xA0, 0x180)])) for _ in range(rng.randrange(40))) for _ in range(1500)] + [chr(c) for c in range(1, 0x250)]
    for some in (texts[:3], texts[3:], texts):
        for t, ids in zip(some, fast.batch(pa.array(some)), strict=True):
            assert ids == np.array(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), repr(t)


def test_best_fill_against_enumeration():
    rng = random.Random(6)
    for _ in range(200):
        counts = {rng.randint(1, 12): rng.randint(1, 4) for _ in range(rng.randint(0, 5))}
        room = rng.randint(0, 30)
        sums = {0}
        for k, n in counts.items():
            sums = {s + k * j for s in sums for j in range(n + 1) if s + k * j <= room}
        got = best_fill(counts, room)
        assert sum(k * n for k, n in got.items()) == max(sums) and all(n <= counts[k] for k, n in got.items())


def test_plan_places_all():
    rng = np.random.default_rng(1)
    lengths, n = np.unique(np.minimum(256, rng.lognormal(4, 1, 3000).astype(int) + 1), return_counts=True)
    counts = dict(zip(lengths.tolist(), n.tolist(), strict=True))
    rows, seen, filled = plan_windows(dict(counts), 256), collections.Counter(), collections.Counter()
    for length, first, ranks, copies, sequence, _ in rows:
        assert first == seen[length]
        seen[length] += ranks
        for k in range(ranks // copies):
            filled[sequence + k] += copies * length
    assert seen == counts and max(filled.values()) <= 256
    assert len(filled) <= -(-sum(k * v for k, v in counts.items()) // 256) + 1


def test_packing_round_trip(spark):
    rng = random.Random(3)
    texts = [(100 + i, words(rng, rng.randint(0, 60))) for i in range(80)] + ODD
    out = pack(docs(spark, texts), PATH, capacity=64, with_ids=True).collect()
    plain = Tokenizer.from_file(PATH)
    want = sorted((str(i), plain.encode(t or "", add_special_tokens=False).ids + [2]) for i, t in texts if i != 4)
    parts, slots = collections.defaultdict(list), collections.defaultdict(list)
    for r in out:
        assert r["length"] == len(r["ids"]) <= 64 and zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"]
        slots[r["sequence_id"]].append((r["offset"], r["length"]))
        if r["doc_id"] != 4:
            parts[str(r["doc_id"])].append((r["start"], r["ids"]))
    assert sorted((i, [x for _, p in sorted(v) for x in p]) for i, v in parts.items()) == want
    for s in slots.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 64
    assert sorted(slots) == list(range(len(slots)))
    assert sum(1 for r in out if r["doc_id"] == 4) == 2
    assert pack(docs(spark, texts[:0] or []), PATH).isEmpty()


def shingle_set(t):
    w = (t or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def brute_components(texts):
    sets = {i: shingle_set(t) for i, t in texts}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                ra, rb = find(a), find(b)
                root[max(ra, rb)] = min(ra, rb)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(8)
    base = [words(rng, rng.randint(30, 120)).split() for _ in range(12)]
    passage = words(rng, 40)
    texts = []
    for i in range(260):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 4, 8])):
            w[rng.randrange(len(w))] = f"e{rng.randrange(1000)}"
        texts.append((i, " ".join(w) if i % 4 else passage + " " + words(rng, 30)))
    texts += [(1000, "one two"), (1001, "ONE two"), (1002, "one two three")]
    got = near_duplicates(docs(spark, texts))
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got.collect()} == brute_components(texts)


def test_near_duplicates_odd(spark, odd):
    out = near_duplicates(odd).collect()
    assert len(out) == len(ODD)
    by = {r["doc_id"]: r for r in out}
    assert by[9]["component_id"] == -8 and not by[9]["kept"] and by[1]["n_shingles"] == 0 and by[2]["component_id"] == 2
    assert near_duplicates(odd.limit(0)).isEmpty()


def test_near_duplicates_of_repeated_ids(spark):
    rng = random.Random(21)
    a, b, c, d = (words(rng, 60) for _ in range(4))
    edited = a.rsplit(" ", 1)[0] + " end"
    rows = [(1, a), (2, b), (2, edited), (3, c), (3, d), (4, d), (5, b), (None, a)]
    out = collections.defaultdict(set)
    for r in near_duplicates(docs(spark, rows)).collect():
        out[r["doc_id"]].add((r["component_id"], r["kept"]))
    assert out == {1: {(1, True)}, 2: {(1, False)}, 3: {(3, True)}, 4: {(3, False)}, 5: {(1, False)}, None: {(None, True)}}


def test_near_duplicates_around_one_text(spark):
    """Hundreds of near copies of one text, many of them too far from it and from each other."""
    rng = random.Random(22)
    base = words(rng, 150, 100_000).split()
    texts = []
    for i in range(400):
        w = list(base)
        for _ in range(rng.randrange(14)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(300)}"
        texts.append((i, " ".join(w)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates(docs(spark, texts)).collect()}
    assert got == brute_components(texts) and len({c for _, c in got.values()}) > 20


@pytest.mark.parametrize("own", [15, 20, 30])
def test_pages_of_one_template_meet_under_no_shingle(spark, own):
    """Pages that share most words, but too few to be alike, make no candidate pairs, however many they are."""
    total = 100
    shared = total - own
    rows = [(k, d, total, shared - k) for d in range(300) for k in range(shared)]
    smaller, larger = prefix_sides(spark.createDataFrame(rows, "shingle long, rep long, size long, left long"), 75)
    assert smaller.isEmpty() and larger.isEmpty() == (own > 25)


def test_prefix_sides_lose_no_pair(spark):
    """Any two sizes whose overlap may reach the threshold at some place of both meet there, the smaller as such."""
    rng = random.Random(4)
    rows = [(0, i, size, rng.randint(-(-75 * size // 100), size)) for i, size in enumerate([*range(1, 40), *(rng.randint(1, 3000) for _ in range(160))])]
    posts = spark.createDataFrame(rows, "shingle long, rep long, size long, left long")
    smaller, larger = prefix_sides(posts, 75)
    met = smaller.alias("x").join(larger.alias("y"), "shingle").select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b"))
    got = {(r["a"], r["b"]) for r in met.collect()}
    want = {(a, b) for _, a, s, p in rows for _, b, t, q in rows if s <= t and min(p, q) * 175 >= 75 * (s + t)}
    assert want <= got and len(want) > 500


def test_many_pages_of_one_template(spark):
    rng = random.Random(9)
    head, tail = words(rng, 42, 10**6), words(rng, 42, 10**6)
    texts = [(i, f"{head} {words(rng, 20, 10**6)} {tail}") for i in range(1500)] + [(5000 + i, f"{head} {words(rng, 6, 10**6)} {tail}") for i in range(3)]
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(docs(spark, texts)).collect()}
    assert got == {i: 5000 if i >= 5000 else i for i, _ in texts}


def test_components_of_a_long_path(spark):
    edges = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r["component"] for r in components(edges).collect()} == {0} and components(edges).count() == 301
    assert components(edges.limit(0)).isEmpty()


def brute_suffix(texts, length):
    seen, out = {}, {}
    for i, t in sorted(texts):
        b = (t or "").encode()
        gone = bytearray(len(b))
        own = set()
        for k in range(len(b) - length + 1):
            w = b[k : k + length]
            if w in seen:
                gone[k : k + length] = b"\1" * length
            else:
                own.add(w)
        seen |= dict.fromkeys(own)
        spans = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone, strict=True) if not g)).hexdigest())
    return out


@pytest.mark.parametrize("length", [20, 50, 56])
def test_suffix_dedup_against_brute_force(spark, length):
    rng = random.Random(length)
    pool = ["".join(rng.choice("abcé \n") for _ in range(rng.randint(30, 200))) for _ in range(12)]
    texts = []
    for i in range(150):
        parts = [rng.choice(pool)[rng.randrange(20) :] for _ in range(rng.randint(0, 4))] + ["".join(rng.choice("xyz") for _ in range(rng.randrange(60)))]
        rng.shuffle(parts)
        texts.append((i * 3, "".join(parts)))
    texts += [(1000, "a" * 500), (1001, "a" * 700), (1002, "ab" * 300), (1003, None), (1004, pool[0][:49])]
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup(docs(spark, texts), length=length).collect()}
    assert got == brute_suffix(texts, length)


def test_suffix_dedup_of_a_long_stretch(spark):
    texts = [(1, "=" * 80), (2, "=" * 70_000)]
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup(docs(spark, texts), length=50).collect()}
    assert got == {1: (80, 0, 0, hashlib.sha256(b"=" * 80).hexdigest()), 2: (70_000, 70_000, 1, hashlib.sha256(b"").hexdigest())}


def test_runs_are_told_by_both_hashes():
    """Two runs whose mixes of anchor and segment collide are not equal; an equal one beside them is."""
    anchor, odd = 7, 0x9E3779B97F4A7C15
    other = pow(odd, -1, 1 << 64)
    a2 = next(a for a in range(1, 1 << 22) if ((anchor ^ (12345 * odd % (1 << 64)) ^ a) * other % (1 << 64)) >> 48 == 0 and a != anchor)
    s2 = (anchor ^ (12345 * odd % (1 << 64)) ^ a2) * other % (1 << 64)
    rows = np.array([(anchor, 12345, 1, 0, 1), (a2, s2, 2, 0, 1), (a2, s2, 3, 0, 1)], suffix_runs)
    assert (anchor ^ (12345 * odd)) % (1 << 64) == (a2 ^ (s2 * odd)) % (1 << 64)
    assert later(rows[:2]).tolist() == [False, False] and later(rows[1:]).tolist() == [False, True]
    assert later(rows[:0]).tolist() == []


def test_long_text_is_cut():
    rng = random.Random(3)
    data = np.array([rng.choice(b"abc") for _ in range(4000)], "u1")
    whole = text_runs(data, np.array([4000]), np.array([9]), 50)
    parts = text_runs(data, np.array([4000]), np.array([9]), 50, most=700)
    windows = lambda r: sorted((int(x["start"]) + k, int(x["anchor"])) for x in r for k in range(int(x["count"])))
    assert windows(whole) == windows(parts) and len(windows(parts)) == 3951
    assert len(text_runs(data[:20], np.array([20]), np.array([9]), 50, most=10)) == 0


def test_suffix_dedup_of_periodic_texts(spark):
    rng = random.Random(2)
    unit = "".join(rng.choice("abcdefghijklmnop") for _ in range(32))
    texts = [(1, unit * 8000), (2, (unit * 8001)[5:])]
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"]) for r in suffix_dedup(docs(spark, texts), length=50).collect()}
    assert got == {1: (256_000, 0, 0), 2: (256_027, 256_027, 1)}


@pytest.mark.parametrize("length", [20, 50, 56])
def test_previous_factors(length):
    rng = random.Random(length)
    pool = [bytes(rng.choice(b"ab") for _ in range(length)) for _ in range(6)]
    rows = [rng.choice(pool)[: rng.choice([0, 3, 8, 9, length - 1, length])] for _ in range(300)]
    rows = [(r + bytes(rng.choice(b"abc") for _ in range(length)))[:length] for r in rows]
    owners = np.array([rng.randrange(40) for _ in rows])
    at = [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]
    keys = [np.array([int.from_bytes(r[k : k + 8], "big") for r in rows], "u8") for k in at]
    share = lambda a, b: next((k for k in range(length) if a[k] != b[k]), length)
    want = [max((share(a, b) for b, e in zip(rows, owners, strict=True) if e < d), default=0) for a, d in zip(rows, owners, strict=True)]
    got = previous_factors(keys, at, owners, length)
    assert all(g == w if w == length else g <= w for g, w in zip(got.tolist(), want, strict=True)) and length in want
    order = np.lexsort(keys[::-1])
    near = common_prefixes([k[order] for k in keys], at, length).tolist()
    assert near == [0, *(share(rows[a], rows[b]) for a, b in zip(order[:-1], order[1:], strict=True))]


@pytest.mark.parametrize("length", [20, 50, 56])
def test_suffix_repeats_in_parts(length):
    rng = random.Random(length)
    pool = [bytes(rng.choice(b"ab") for _ in range(90)) for _ in range(4)]
    segments = [rng.choice(pool)[rng.randrange(20) :] for _ in range(60)]
    owners, counts = np.array([rng.randrange(30) for _ in segments]), np.array([len(s) - length + 1 for s in segments])
    least: dict[bytes, int] = {}
    windows = [(s[k : k + length], d) for s, d, c in zip(segments, owners.tolist(), counts.tolist(), strict=True) for k in range(c)]
    for w, d in windows:
        least[w] = min(d, least.get(w, d))
    want = [d > least[w] for w, d in windows]
    assert suffix_repeats(segments, owners, counts, length).tolist() == want
    assert suffix_repeats(segments, owners, counts, length, most=100).tolist() == want


def test_suffix_dedup_odd(spark, odd):
    out = suffix_dedup(odd, length=20, with_text=True).collect()
    assert len(out) == len(ODD)
    assert {r["n_removed"] for r in out if r["doc_id"] == 4} == {0}
    same = docs(spark, [(2, "a passage of more than twenty bytes"), (None, "a passage of more than twenty bytes")])
    assert {r["doc_id"]: bytes(r["kept"]) for r in suffix_dedup(same, length=20, with_text=True).collect()} == {2: b"a passage of more than twenty bytes", None: b""}
    assert suffix_dedup(odd.limit(0)).isEmpty()


def test_suffix_tree(spark, odd):
    rng = random.Random(5)
    texts = [(i, " ".join(f"{a} {a}s" for a in words(rng, rng.randint(5, 60), 60).split())) for i in range(300)]
    got = table(suffix_tree_scores(docs(spark, texts)))
    tokens = {i: (t or "").encode().lower().split() + [b"\n"] for i, t in texts}
    train = [i for i in tokens if zlib.crc32(str(i).encode()) % 10]
    c = collections.Counter(w for i in train for w in tokens[i])
    n, v = sum(c.values()), len(c)
    for i, w in tokens.items():
        r = got[i]
        assert r["n_tokens"] == len(w) and r["train_tokens"] == n and r["n_known"] == sum(x in c for x in w) and r["held_out"] == (i not in train)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w))
    out = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in out) > 0.8 * sum(r["base_score"] for r in out)  # a word tells the next
    assert suffix_tree_scores(odd).count() == len(ODD)
    assert suffix_tree_scores(odd.limit(0)).isEmpty()


def brute_tree(train, depth, symbol_share, least_share, gain):
    """The model in plain dictionaries: log10 probability of a list of tokens."""
    c = collections.Counter(w for t in train for w in t)
    n = sum(c.values())
    top = {w for w, k in c.items() if k >= symbol_share * n or w == b"\n"}
    once, twice = (sum(k == j for k in c.values()) for j in (1, 2))
    discount = min(0.9, max(0.1, once / max(once + 2 * twice, 1)))
    rest, freed = n - sum(c[w] for w in top), discount * max(len(c) - len(top), 1)
    symbols = lambda t: [w if w in top else None for w in t]
    after = collections.defaultdict(collections.Counter)
    for t in train:
        s = [b"\n"] * depth + symbols(t)
        for i in range(depth, len(s)):
            for k in range(depth + 1):
                after[tuple(s[i - k : i])][s[i]] += 1
    kept = {()}
    for x, own in after.items():
        total = sum(own.values())
        if x and total >= least_share * n:
            short, whole = after[x[1:]], sum(after[x[1:]].values())
            if len(x) == 1 or sum(short.values()) >= least_share * n:
                if sum(k * math.log(k * whole / (total * short[y])) for y, k in own.items()) >= gain:
                    kept.add(x)

    def p(x, y):
        while x not in kept:
            x = x[1:]
        own, total = after[x], sum(after[x].values())
        if not x:
            return own[y] / total if y in own else 1.0
        return (own[y] + len(own) * p(x[1:], y)) / (total + len(own))

    def score(t):
        s, out = [b"\n"] * depth + symbols(t), 0.0
        for i, w in enumerate(t):
            out += math.log10(p(tuple(s[i : i + depth]), s[i + depth]))
            if w not in top:
                out += math.log10((max(c[w] - discount, 1e-9) if c[w] else freed) / max(rest, freed))
        return out

    return score


@pytest.mark.parametrize("share", [0.02, 0.001])
def test_suffix_tree_against_brute_force(spark, share):
    rng = random.Random(6)
    texts = [(i, " ".join(f"{a} {a}s" for a in words(rng, rng.randint(5, 60), 60).split()) + f" own{i}") for i in range(300)]
    got = table(suffix_tree_scores(docs(spark, texts), symbol_share=share, least_share=0.001, gain=5.0))
    tokens = {i: t.encode().split() + [b"\n"] for i, t in texts}
    score = brute_tree([w for i, w in tokens.items() if zlib.crc32(str(i).encode()) % 10], 2, share, 0.001, 5.0)
    for i, w in tokens.items():
        assert got[i]["score"] == pytest.approx(score(w), rel=1e-6)


def brute_words(train, depth, gain):
    """The tree of all words in plain dictionaries: log10 probability of a list of tokens."""
    after = collections.defaultdict(collections.Counter)
    for t in train:
        s = [b"\n"] * depth + t
        for i in range(depth, len(s)):
            for k in range(depth + 1):
                after[tuple(s[i - k : i])][s[i]] += 1
    c = after[()]
    n, once, twice = sum(c.values()), sum(k == 1 for k in c.values()), sum(k == 2 for k in c.values())
    discount = min(0.9, max(0.1, once / max(once + 2 * twice, 1)))
    total = {x: sum(own.values()) for x, own in after.items()}
    kept = {x for x, own in after.items() if x and sum(k * math.log(k * total[x[1:]] / (total[x] * after[x[1:]][y])) for y, k in own.items()) >= gain}

    def p(x, y):
        while x and x not in kept:
            x = x[1:]
        if not x:
            return (c[y] - discount if c[y] else discount * len(c)) / n
        return (after[x][y] + len(after[x]) * p(x[1:], y)) / (total[x] + len(after[x]))

    def score(t):
        s = [b"\n"] * depth + t
        return sum(math.log10(p(tuple(s[i : i + depth]), s[i + depth])) for i in range(len(t)))

    return score, kept


@pytest.mark.parametrize(("depth", "gain"), [(1, 2.0), (3, 2.0), (3, 5.0), (4, 0.5)])
def test_suffix_tree_of_all_words(spark, depth, gain):
    """Words far below any share of the tokens are contexts and are told by them, three words back and more; the most frequent word is dealt out over several buckets."""
    rng = random.Random(16)
    few = lambda k: [f"c{k}x{rng.randrange(3)} the d{k}" for _ in range(3)]
    texts = [(i, " ".join(few(i % 40) + words(rng, rng.randint(0, 40), 300).split() + ["the " + w for w in words(rng, 9, 60).split()]) + (f" own{i}" if i % 3 else "")) for i in range(240)]
    got = table(suffix_tree_scores(docs(spark, texts).repartition(5), depth=depth, gain=gain))
    tokens = {i: t.encode().split() + [b"\n"] for i, t in texts}
    score, kept = brute_words([w for i, w in tokens.items() if zlib.crc32(str(i).encode()) % 10], depth, gain)
    assert max(map(len, kept)) == depth
    n = sum(len(w) for w in tokens.values())
    assert any(sum(w.count(x[-1]) for w in tokens.values()) < 0.003 * n for x in kept)
    for i, w in tokens.items():
        assert got[i]["score"] == pytest.approx(score(w), rel=1e-9)


def positions_after(rng, size, kinds):
    """Positions after a few words, most of them after word 1, half of these after 2 1."""
    before = [1 + np.minimum(rng.geometric(0.5, size) - 1, kinds).astype("i4") for _ in range(3)]
    w = (before[0] + before[1] * rng.integers(0, 2, size) + rng.integers(0, kinds, size)).astype("i8")
    train = rng.random(size) < 0.9
    return before, w, train, np.bincount(w, train).astype("i8")


@pytest.mark.parametrize("piece", [3, 60, 700])
def test_suffix_tree_cuts_what_follows_a_word(piece):
    """However its positions are cut, and whether or not others have told what follows the word 4, a bucket gives the same shares."""
    before, w, train, count = positions_after(np.random.default_rng(3), 4000, 9)
    before[1][before[0] == 5] = 0
    before[2][before[1] == 0] = 0
    root = Root(int(count.sum()), len(count), 0.5)
    none = {0: tuple(np.zeros(0, "i8") for _ in range(3))}
    four = np.flatnonzero((before[0] == 4) & train)
    told = {0: (before[0][four].astype("i8"), w[four], np.ones(len(four), "i8"))}
    want = token_shares(before, w, train, none, count, root, 3.0)
    for t in (none, told):
        assert token_shares(before, w, train, t, count, root, 3.0, piece=piece) == pytest.approx(want, rel=1e-12)


def test_suffix_tree_memory_of_a_frequent_word():
    """What a task holds beside its positions doesn't grow with those after one word."""
    before, w, train, count = positions_after(np.random.default_rng(4), 400_000, 200)
    before[0][:] = 7
    before[1] = np.random.default_rng(5).integers(1, 5000, len(w)).astype("i4")
    root = Root(int(count.sum()), len(count), 0.5)
    tracemalloc.start()
    token_shares(before, w, train, {0: tuple(np.zeros(0, "i8") for _ in range(3))}, count, root, 20.0, piece=20_000)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60 * len(w)  # some 200 bytes a position, if all are worked on together


def test_suffix_tree_numbers_come_back():
    rng = np.random.default_rng(1)
    for most in (1, 127, 128, 256, 70_000, 2**31, 2**31 + 1, 2**53):
        a = np.append(rng.integers(0, most, 300), most - 1)
        got = expand_small(squeeze_small([a, a[:0], a // 3], -a), 3)
        assert all((x == y).all() and len(x) == len(y) for x, y in zip(got, (a, a[:0], a // 3, -a), strict=True))
    zipf = np.minimum(1 / rng.random(200_000), 3e6).astype("i8") * 51
    assert len(squeeze_small([zipf])) < 0.9 * len(squeeze(zipf))


@pytest.mark.parametrize("common", ["", "the "])
def test_suffix_tree_of_few_long_texts(spark, common):
    """The end is rare among the tokens of long texts, and counts all the same."""
    rng = random.Random(7)
    texts = [(i, " ".join(common + f"w{rng.randrange(9000)}" for _ in range(24_000))) for i in (1, 2, 3)]
    got = table(suffix_tree_scores(docs(spark, texts)))
    tokens = {i: t.encode().split() + [b"\n"] for i, t in texts}
    c = collections.Counter(w for i in tokens if zlib.crc32(str(i).encode()) % 10 for w in tokens[i])
    n, v = sum(c.values()), len(c)
    for i, w in tokens.items():
        assert (got[i]["n_tokens"], got[i]["n_known"]) == (len(w), sum(x in c for x in w))
        assert got[i]["base_score"] == pytest.approx(sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w))


def test_suffix_tree_rows_of_one_id(spark):
    texts = [(1, "a b c"), (1, "a b c"), (1, "b"), (None, "a b c"), (None, "q"), (None, None), (2, "a a"), (2**63 - 1, "b b")]
    out = sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], round(r["base_score"], 9)) for r in suffix_tree_scores(docs(spark, texts)).collect())
    train = [(i, (t or "").split() + ["\n"]) for i, t in texts if zlib.crc32(b"" if i is None else str(i).encode()) % 10]
    c = collections.Counter(w for _, t in train for w in t)
    n, v = sum(c.values()), len(c)
    want = [(str(i), len(w), sum(x in c for x in w), round(sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), 9)) for i, w in ((i, (t or "").split() + ["\n"]) for i, t in texts)]
    assert out == sorted(want)


def corpus(rng, n):
    en, fr = ["the", "and", "house", "river", "walking"], ["les", "maison", "être", "rivière", "marche"]
    rows = []
    for i in range(n):
        vocabulary = en if i % 2 else fr
        text = ". ".join(" ".join(rng.choice(vocabulary) for _ in range(12)) for _ in range(6))
        rows.append((i, text, "en" if i % 2 else "fr"))
    return rows


def test_language_held_out(spark):
    rows = corpus(random.Random(3), 200)
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    filters = langid.fit(d, among=F.col("doc_id") < 100)
    got = langid.language(d.where("doc_id >= 100"), filters).collect()
    assert all(r["lang_pred"] == r["lang"] and 0 <= r["score"] <= 1 for r in got)
    odd = spark.createDataFrame([(1, None, "en"), (None, "12 ... 34", None), (3, "", "fr"), (3, "the", None), (3, "the", None)], "doc_id long, text string, lang string")
    assert [r["lang_pred"] for r in langid.language(odd, filters).collect()] == ["und", "und", "und", "en", "en"]
    assert langid.language(odd.limit(0), langid.fit(odd.limit(0))).isEmpty()


def test_more_than_64_languages(spark):
    rng = random.Random(8)
    rows = []
    for k in range(70):
        own = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(12)]
        rows += [(k * 4 + i, " ".join(rng.choice(own) for _ in range(60)), f"l{k:02}") for i in range(4)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    filters = langid.fit(d, among=F.col("doc_id") % 4 != 0)
    assert len(filters.languages) == 70
    got = langid.language(d.where("doc_id % 4 = 0"), filters).collect()
    assert all(r["lang_pred"] == r["lang"] and r["score"] > 0.25 for r in got)


def test_toxicity_held_out_and_located(spark):
    rng = random.Random(9)
    rows, labels = [], []
    for i, text, _ in corpus(rng, 400):
        bad = i % 5 == 0
        rows.append((i, text + (". You vile horrid person. " if bad else ". ") + text))
        labels.append((i, 1, int(bad)))
    d, y = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.fit(d, y, among=F.col("doc_id") < 300)
    for r in toxicity.toxicity(d.where("doc_id >= 300"), model).join(d, "doc_id").collect():
        assert r["predicted"] == int(r["doc_id"] % 5 == 0)
        for s in r["offending"]:
            assert b"vile" in r["text"].encode()[s["start"] : s["end"]]
    odd = docs(spark, ODD)
    assert all(0 <= r["score"] <= 1 for r in toxicity.toxicity(odd, model).collect())
    assert toxicity.toxicity(odd, toxicity.fit(odd, y.limit(0))).count() == len(ODD)
    assert toxicity.toxicity(odd.limit(0), model).isEmpty()


def brute_statistics(text):
    text = text or ""
    w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", text) if x]
    windows = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] >= 2 for k in range(3)}
    lines = text.split("\n")
    dup = sum(1 for i, x in enumerate(lines) if x.strip(" \t\n\x0b\x0c\r") and x in lines[:i])
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(hit)


def test_quality(spark):
    rng = random.Random(7)
    texts = [t for _, t in ODD] + ["\n".join(words(rng, rng.randint(0, 12), 4) for _ in range(rng.randint(1, 9))) for _ in range(60)]
    for t in texts:
        assert quality.statistics(t)[0] == brute_statistics(t), repr(t)
    good = [(i, words(rng, 80)) for i in range(200)]
    bad = [(1000 + i, " ".join(f"{w}###" for w in words(rng, 80).split())) for i in range(60)]
    d = docs(spark, good + bad)
    y = spark.createDataFrame([(i, int(i < 1000), 0) for i, _ in good[::2] + bad[::2]], "doc_id long, quality int, toxic int")
    got = table(quality.quality(d, quality.fit(d, y)))
    assert sum(got[i]["kept"] for i, _ in good) >= 190 and sum(got[i]["kept"] for i, _ in bad) <= 6
    assert not any(r["base_failed"] for r in got.values())


def test_quality_catches_what_the_base_rules_pass(spark):
    """Held-out rows: a few symbols among the words, which no good row has, set a row apart though all else is alike."""
    rng = random.Random(17)
    good = [(i, words(rng, rng.randint(55, 300))) for i in range(400)]
    bad = [(1000 + i, " ".join(w + (" |" if rng.random() < rng.choice([0.1, 0.3]) else "") for w in words(rng, rng.randint(55, 300)).split())) for i in range(80)]
    d = docs(spark, good + bad)
    y = spark.createDataFrame([(i, int(i < 1000), 0) for i, _ in good + bad], "doc_id long, quality int, toxic int")
    got = table(quality.quality(d, quality.fit(d, y, among=F.col("doc_id") % 2 == 0)))
    assert sum(not got[i]["kept"] for i, _ in bad if i % 2) >= 0.9 * len(bad) / 2
    assert sum(got[i]["kept"] for i, _ in good if i % 2) >= 0.97 * len(good) / 2
    odd = docs(spark, ODD)
    assert quality.quality(odd, quality.fit(odd, y.limit(0))).count() == len(ODD)
    assert quality.quality(odd.limit(0), quality.fit(odd.limit(0), y.limit(0))).isEmpty()


def test_small_tables_leave_few_shuffle_files(spark):
    """Dealt out over many partitions, a small graph is worked on by few tasks: each task of a shuffle leaves files, however few its rows are."""
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 300, 2)] + [(i, i + 2) for i in range(1, 40, 2)], "a long, b long")
    groups = spark.sparkContext.statusTracker()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 50)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.sparkContext.setJobGroup("few", "components of a small graph")
    try:
        got = {r["node"]: r["component"] for r in components(edges.repartition(50)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.sparkContext.setJobGroup("rest", "other jobs")
    # The pairs (0, 1), (2, 3), ... are chained by their odd ends up to 41.
    assert got == {i: 0 if i <= 41 else i - i % 2 for i in range(300)}
    stages = {k for j in groups.getJobIdsForGroup("few") for k in groups.getJobInfo(j).stageIds}
    wide = [x for k in stages if (x := groups.getStageInfo(k)) and x.numTasks >= 50]
    assert len(wide) < len(stages) / 2


def test_components_of_no_edges(spark):
    """An empty table may have no partitions at all."""
    none = spark.createDataFrame([], "a long, b long")
    assert components(none).isEmpty() and components(none.repartition(50)).isEmpty()
    assert components(none.join(none, ["a", "b"])).isEmpty()


def test_quality_learns_from_all_labelled_rows(spark):
    """Each of over 2,000 labelled rows counts: the threshold is that of all rows of the calibrating half, and the trees draw from all rows of the other."""
    rng = random.Random(19)
    rows = [(i, words(rng, rng.randint(5, 15)) + (" |" if i % 9 == 0 else "")) for i in range(6000)]
    d, y = docs(spark, rows), spark.createDataFrame([(i, int(i % 9 > 0), 0) for i, _ in rows], "doc_id long, quality int, toxic int")
    forest = quality.fit(d, y, trees=20)
    stats = quality.rule_statistics(d).withColumn("hash", F.xxhash64("doc_id", "features"))
    got = quality.scored(stats.withColumn("half", F.pmod(F.xxhash64("hash", F.lit("half")), F.lit(2))), forest, "doc_id", "half").where("half = 1").collect()
    good, bad = (sorted(r["anomaly"] for r in got if (r["doc_id"] % 9 > 0) == g) for g in (True, False))
    assert len(good) > 2500 and len(bad) > 250
    cuts = sorted({*good, *bad})
    gain = [(sum(b > c for b in bad)) * len(good) - sum(g > c for g in good) * len(bad) for c in cuts]
    assert forest.threshold == max(good[min(len(good) - 1, math.ceil(0.99 * len(good)))], cuts[gain.index(max(gain))])


def test_imatch(spark, odd):
    rng = random.Random(11)
    texts = [(i * 7, words(rng, 90, 1500)) for i in range(300)] + [(5000, "tail"), (5001, "tail")]
    got = table(imatch(docs(spark, texts)))
    order = sorted(texts, reverse=True)
    for k, (i, t) in enumerate(order):
        part = len(t) // 3
        edited = t[: len(t) - part] + order[(k + 1) % len(order)][1][:part]
        assert got[i]["n_chars"] == len(t) and got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[i]["near_next"] <= 1
    assert got[5000]["fingerprint"] == got[5001]["fingerprint"] and got[5001]["near_next"] == 1
    mean = lambda c: sum(r[c] for r in got.values()) / len(got)
    assert mean("near_edited") > 0.15 > 10 * mean("near_next") / 2
    assert imatch(odd).count() == len(ODD) and imatch(odd.limit(0)).isEmpty()


@pytest.mark.parametrize("ids", [[-(2**63) + 5, 2**63 - 10, 0, 7], [5] * 6 + [2**62 + k for k in range(5)], [None] * 8, [3, None, 10**12, 4, 4, 1]])
def test_successors_of_any_ids(spark, ids):
    texts = [(i, f"text {k}") for k, i in enumerate(ids)]
    rows = with_next(docs(spark, texts), doc_id="doc_id", text="text", per_range=2, spans=4).collect()
    assert sorted(r["text"] for r in rows) == sorted(r["next_text"] for r in rows) == sorted(t for _, t in texts)
    order = sorted({i for i in ids if i is not None}, reverse=True) + [None] * (None in ids)
    of = {t: i for i, t in texts}
    steps = collections.Counter((r["id"], of[r["next_text"]]) for r in rows)
    for a, b in zip(order, order[1:] + order[:1], strict=True):
        assert steps[a, b] >= 1 and (len(order) == 1 or steps[a, b] == 1)
    assert all(a == b for (a, b) in steps if (a, b) not in set(zip(order, order[1:] + order[:1], strict=True)))


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(12)
    rows = [(i, t + "\nshared line", "s" if i % 3 else None, y) for i, t, y in corpus(rng, 60)] + [(900 + i, rows_text, "s", "en") for i, rows_text in enumerate(["12 34", None, ""])]
    d = spark.createDataFrame([(i, t, y, s, len(t or "")) for i, t, s, y in rows], "doc_id long, text string, lang string, source string, n_chars long")
    d.write.parquet(str(tmp_path / "documents.parquet"))
    step = d
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, step, str(tmp_path)).write.parquet(str(tmp_path / name))
        step = spark.read.parquet(str(tmp_path / name))
        assert step.columns == corpus_pipeline.COLUMNS
        if name == "language_id":
            assert step.count() == 60
        if name == "line_dedup":
            assert step.where(F.col("text").contains("shared")).isEmpty()
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


def test_pipeline_mixing_weighs_by_labels(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(13)
    texts = [(i, words(rng, 20)) for i in range(1200)]
    d = docs(spark, texts, ["a" if i % 3 else "b" for i, _ in texts]).select(corpus_pipeline.COLUMNS)  # a's target is half its size
    plain = corpus_pipeline.mixing(spark, d, str(tmp_path))
    assert collections.Counter(r["doc_id"] for r in plain.collect()) == {r["doc_id"]: r["epochs"] for r in mix(d).where("epochs > 0").collect()}
    spark.createDataFrame([(i, i // 3 % 2, 0) for i, _ in texts if i % 3], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    taken = collections.Counter(r["doc_id"] // 3 % 2 for r in corpus_pipeline.mixing(spark, d, str(tmp_path)).where("source = 'a'").collect())
    assert taken[1] > 2 * taken[0] > 0


def test_pipeline_stages_odd(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(14)
    text = lambda: ". ".join(" ".join(rng.choice(["the", "and", "house", "river", "walking", f"w{rng.randrange(300)}"]) for _ in range(12)) for _ in range(6))
    twice = text()
    texts = [*((i, text()) for i in range(40)), (50, twice), (50, twice), (51, twice), (60, text()), (60, text()), (None, text()), (None, text()), (70, None), (71, ""), (72, "the house " * 30_000)]
    d = docs(spark, texts, [None if k % 3 else "s" for k in range(len(texts))])  # with columns that clash
    for name, stage in corpus_pipeline.STAGES:
        for rows in (d, d.limit(0)):
            out = stage(spark, rows, str(tmp_path)).collect()
            got = collections.Counter((r["doc_id"], r["text"]) for r in out) if name != "packing" else None
            if rows is d and name == "language_id":
                assert got == {k: n for k, n in collections.Counter(texts).items() if k[1]}
            if rows is d and name == "near_dedup":
                assert got == {k: n for k, n in (collections.Counter(texts) | {(50, twice): 1}).items() if k[0] != 51 and k != (50, twice)} | {(50, twice): 1}
            if rows is d and name == "packing":
                assert {r["doc_id"] for r in out} == {i for i, _ in texts}
            assert out == [] or rows is d
